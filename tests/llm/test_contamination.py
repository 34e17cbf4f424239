"""Decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from cases import SCHEMA, prose, rows

from feedloom.llm import contamination
from feedloom.plans.compare import compare

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(contamination.WORD, (t or "").translate(LOWER))


def brute(docs, items, window=10):
    wanted = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for x in range(len(w) - k + 1) if k else ():
            wanted.setdefault(tuple(w[x : x + k]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, named = set(), set()
        for k in {len(x) for x in wanted}:
            for x in range(len(w) - k + 1):
                if (found := wanted.get(tuple(w[x : x + k]))) is not None:
                    hit |= set(range(x, x + k))
                    named |= found
        edges = [i for i in sorted(hit) if i - 1 not in hit]
        spans = [(a, next(b for b in range(a, len(w) + 1) if b not in hit)) for a in edges]
        out.append((d, len(w), spans, sorted(str(i) for i in named if i is not None)))
    return sorted(out, key=repr)


def test_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for size, n in ((1, 1), (2, 300), (5, 2_000), (300, 5_000)):
        s = rng.integers(0, size, n)
        index = contamination.FmIndex(s, size, sample=5)
        for length in (1, 2, 3, 6):
            patterns = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(s, length)[:40] if n >= length else np.zeros((0, length), int), rng.integers(0, size, (20, length))]), axis=0)
            which, low, high = index.search(patterns)
            got = {tuple(patterns[w]): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
            view = np.lib.stride_tricks.sliding_window_view(s, length) if n >= length else np.zeros((0, length), int)
            want = {tuple(p): np.flatnonzero((view == p).all(1)).tolist() for p in patterns}
            assert got == {p: at for p, at in want.items() if at}


def cases():
    item = prose(501, 40)
    near = [*item.split()[:15], "other", *item.split()[16:]]
    items = [(1, item), (2, " ".join(item.split()[5:30])), (10, "Uniqueword"), (9, "two words"), (None, prose(77, 12)), (3, None), (4, " -- "), (5, ""), (6, prose(88, 10)), (6, prose(89, 11)), (7, "日本 É é x1 y2 Z3 a b c d e f")]
    docs = [(r[0], r[1]) for r in rows()]
    docs += [(100, prose(1, 30) + "\n" + item.upper() + ", end"), (101, item), (102, item), (103, " ".join(near)), (104, " ".join(item.split()[3:12])), (105, "so uniqueword! UNIQUEWORD; two  words two"), (106, prose(77, 12) + " " + prose(88, 10)), (107, prose(89, 11).replace(" ", " ")), (108, "--日本 É é X1 y2 z3 a b c d;"), (109, " ".join([item] * 3)), (None, item), (110, item.replace(" ", "-"))]
    docs += [(200 + i, " ".join(item.split()[-9:])) for i in range(2)] + [(202, " ".join(item.split()[:9]))]  # side by side in a shard, yet no match crosses
    return docs, items


@pytest.mark.parametrize("shard,block,window", [(8_000_000, 2_000_000, 10), (1, 2_000_000, 10), (500, 30, 10), (8_000_000, 1, 3)])
def test_operator_equals_brute_force(spark, shard, block, window):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, "", "", 0, "", "", "", "") for d, t in docs], SCHEMA).repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = contamination.contaminated(df, bench, shard=shard, block=block, window=window).collect()
    assert sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in got), key=repr) == brute(docs, items, window)
    left = {r["doc_id"]: r["kept"] for r in got}
    if window == 10:
        assert left[100] == prose(1, 30) + "\n, end" and left[3] is None and left[105] == "so  two" and left[1] == prose(1, 120)


def test_empty_tables(spark):
    docs, items = cases()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination.contaminated(df.limit(0), bench).count() == 0
    none = contamination.contaminated(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["spans"] or r["items"] for r in none)


def test_query_on_awkward_tables(spark, tmp_path):
    docs, items = cases()
    docs = [(d, t) for d, t in docs if len(t or "") < 50_000]  # DuckDB copies a text's words for each of its windows
    spark.createDataFrame([(d, t, "", "", 0, "", "", "", "") for d, t in docs], SCHEMA).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    same, what = compare(spark, contamination.op12_contamination, contamination.ORACLE, str(tmp_path))
    assert same, what
    got = {r["doc_id"]: r for r in contamination.op12_contamination(spark, str(tmp_path)).collect()}
    assert got[101]["items_sha256"] == hashlib.sha256(b"1,2").hexdigest() and got[101]["n_hit"] == 40
