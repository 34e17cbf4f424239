"""Prefix tries against brute force."""

import hashlib
import random
import zlib
from functools import partial

import numpy as np
import pytest

from feedloom.llm import prefix_trie
from feedloom.plans.compare import compare

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, path string, id string"


def turn(role, text):
    role, text = role or "", text or ""
    d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32].upper()
    return f"{d}{len(text):08X}"


def brute(convs):
    """convs: {conv_id: [turn in hex]} -> rows of the trie."""
    below, kids = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            below.setdefault(tuple(ts[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(ts[: d - 1]), set()).add(tuple(ts[:d]))
    out = []
    for p, members in below.items():
        under = [q for q in below if q[: len(p)] == p]
        saved = sum((len(below[q]) - 1) * int(q[-1][32:], 16) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if tuple(convs[c]) == p)))
        out.append((min(members), len(p), min(below[p[:-1]]) if p else None, len(members), len(kids.get(p, ())), sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_convs(seed, n):
    rng = random.Random(seed)
    made = {}
    for c in rng.sample(range(-200, 30_000), n):
        made[c] = [turn("user", "ab" * rng.randrange(3)) for _ in range(rng.choice([0, 1, 2, 2, 3, 5]))]
        if rng.random() < 0.3:
            made[c] = list(rng.choice(list(made.values()))) + [turn("assistant", f"x{rng.randrange(4)}")] * rng.randrange(2)
    return made


@pytest.mark.parametrize("room", [1, 7, 40, 10_000])
def test_chunks_of_any_size_give_the_same_nodes(spark, monkeypatch, room):
    """With few turns a chunk nearly all nodes are shared."""
    monkeypatch.setattr(prefix_trie, "_tries", partial(prefix_trie._tries, room=room))
    convs = random_convs(room, 150)
    df = spark.createDataFrame(list(convs.items()), "conv_id long, turns array<string>").repartition(3)
    assert sorted((tuple(r) for r in prefix_trie.nodes(df).collect()), key=repr) == brute(convs)


def test_double_array_holds_exactly_its_sequences():
    rng = random.Random(3)
    seqs = sorted({tuple(rng.randrange(1, 9) for _ in range(rng.randrange(6))) for _ in range(300)})
    flat = lambda s: (np.array([c for x in s for c in x], np.int64), np.cumsum([len(x) for x in s]) - [len(x) for x in s], np.array([len(x) for x in s]))
    trie = prefix_trie.DoubleArray(*flat(seqs))
    prefixes = {x[:d] for x in seqs for d in range(len(x) + 1)}
    assert int((trie.check >= 0).sum()) == len(prefixes) - 1
    others = [tuple(rng.randrange(1, 12) for _ in range(rng.randrange(7))) for _ in range(500)]
    reached = dict.fromkeys(range(len(others)), -1)
    for d, (live, _) in enumerate(trie.walk(*flat(others))):
        reached |= dict.fromkeys(live.tolist(), d)
    assert [reached[i] for i in range(len(others))] == [max(d for d in range(len(x) + 1) if x[:d] in prefixes) for x in others]


def awkward():
    rng = random.Random(5)
    made = [(c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", "é", None, "日本"]), 0, "", "", "") for c in [*range(95, 130), 200, 207, 300, 301, -3] for t in [*range(rng.randrange(1, 7)), None][:: rng.choice([1, -1])]]
    made += [(None, 1, "user", "no conversation", 0, "", "", "")] * 3
    made += [(101, 0, "user", "tie", 0, "", "", ""), (101, 0, "user", "tie", 0, "", "", ""), (101, 0, "user", "other tie", 0, "", "", "")]
    made += [(400, t, "user", "long " * 20_000 if t == 3 else "s", 0, "", "", "") for t in range(300)] + [(409, 0, "user", "s", 0, "", "", "")]
    return made


def test_query_on_awkward_tables(spark, tmp_path):
    made = awkward()
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    own = {}
    for c, t, role, text, *_ in made:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, turn(role, text)))
    own = {c: [x[2] for x in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h, head = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        convs[c] = [*own.get(head, [])[:h], *ts[h:]]
    assert any(not t for t in convs.values())
    assert sorted((tuple(r) for r in prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()), key=repr) == brute(convs)
    same, what = compare(spark, prefix_trie.op11_prefix_trie, prefix_trie.ORACLE, str(tmp_path))
    assert same, what


def test_empty_table_has_no_nodes(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert prefix_trie.op11_prefix_trie(spark, str(tmp_path)).count() == 0


def test_ends_over_many_blocks(spark):
    """One path of all conversations: its ids are hashed block by block."""
    df = spark.range(0, 60_000, 2).selectExpr("id as conv_id", f"array('{turn('u', 't')}') as turns")
    got = {r["depth"]: r for r in prefix_trie.nodes(df).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(0, 60_000, 2))).encode()).hexdigest() and got[1]["n_convs"] == 30_000
