"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from cases import SCHEMA, prose, rows, words
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import word_runs


def brute(w):
    """Every period by itself: stretches where words q apart agree; the least period of a stretch counts."""
    n, out = len(w), {}
    ids = np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        edge = np.diff(np.concatenate([[False], ids[q:] == ids[:-q], [False]]).astype(int))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 6), st.integers(0, 40))
def test_runs_equal_brute_force(ids, p, tail):
    ids = np.array([*ids, *([ids[-p:][i % len(ids[-p:])] for i in range(tail)])])
    assert word_runs.runs_of(np.unique(ids, return_inverse=True)[1]) == brute(ids.tolist())


def test_long_periodic_texts_stay_linear():
    assert word_runs.runs_of(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    assert word_runs.runs_of(np.arange(30_000) % 5_000) == [(0, 30_000, 5_000)]


def test_numbered_lines_have_no_run():
    """One passage after ever different words recurs without a period."""
    ids = np.array([x for i in range(3_000) for x in (10 + i, 1, 2, 3, 4, 5, 6)])
    assert word_runs.runs_of(np.unique(ids, return_inverse=True)[1]) == []


@pytest.fixture(scope="module")
def awkward(spark):
    made = [*rows(), (30, "x " * 5, "", "", 0, "", "", "", ""), (31, "x " * 6, "", "", 0, "", "", "", ""), (32, "go " + "a b c\t" * 7 + "stop", "", "", 0, "", "", "", ""), (33, "é x " * 9, "", "", 0, "", "", "", "")]
    return made, spark.createDataFrame(made, SCHEMA).repartition(3)


def test_operator_on_awkward_tables(spark, awkward):
    made, df = awkward
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs.word_runs(df).collect()), key=repr)

    def want(t):
        w = words(t)
        found = brute(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        return found, " ".join(x for i, x in enumerate(w) if i not in gone)

    assert got == sorted(((r[0], *want(r[1])) for r in made), key=repr)
    assert word_runs.word_runs(df.limit(0)).count() == 0


def test_query_on_awkward_tables(spark, awkward, tmp_path):
    """The digests, the rebuilt texts and the strongest run, restated in Python; enough ids that a tenth is rebuilt."""
    made = [*awkward[0], *[(100 + i, prose(i, 7 * i % 90), "", "", 0, "", "", "", "") for i in range(60)]]
    spark.createDataFrame(made, SCHEMA).repartition(2).write.parquet(f"file://{tmp_path}/documents.parquet")

    def want(i, t):
        w = words(t)
        n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        return i, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))

    got = sorted((tuple(r) for r in word_runs.op13_word_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((want(r[0], r[1]) for r in made), key=repr)
    assert any(r[1] for r in got if r[0] and r[0] >= 100)
