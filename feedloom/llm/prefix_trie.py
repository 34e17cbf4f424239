"""Prefix trie of conversations: every distinct sequence of first turns, with what the conversations below it share.

1. A turn becomes TURN bytes: a digest of role and text, and the text's length. A conversation is the row of its turns in order, its path.
   Equal paths are one row with a count and the least conversation, before anything meets.
2. The distinct paths are dealt out by ranges in order, so that a prefix shard is a stretch of neighbouring paths, however many
   share a prefix. A task takes its stretch in chunks of about ROOM turns. Each chunk numbers its turns densely and packs a
   double-array trie: state t follows state s by turn c if BASE[s] + c = t and CHECK[t] = s. The paths are walked through it
   together, turn by turn, for counts and least members; sums over subtrees then go up from the last level.
3. Only the nodes on the first and the last path of a chunk can have a part in other chunks. Their sums are added up globally; what two
   neighbouring chunks both counted (the nodes that the last path of one and the first of the next share) is taken off again.
   All other nodes are final where they are.
4. The conversations that end at a node are joined to blocks of ids, and the blocks of a node are hashed one after the other as they
   come in order, so that a path that a third of all conversations have needs no list of them.

The range bounds look at the first KEY turns. A conversation's turns (TURN bytes each) are one row. A lost executor costs its chunks.

Cases: null roles and texts are empty; turns are ordered by turn, nulls first, ties by the turn's bytes, so repeated rows are repeated turns;
rows without conv_id belong to no conversation; other columns are not looked at; an empty table has no nodes, not even a root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table

#: Bytes of a turn: 16 of its digest, 4 of its text's length.
TURN = 20
KEY = 64
ROOM = 300_000
#: Ids of a block differ by less than this.
BLOCK = 10_000
NODE = "id binary, parent binary, depth long, conv long, n long, children long, leaves long, weight long, once long, class binary"
OUT = f"kind int, {NODE}, parent_conv long, first binary, last binary"


class DoubleArray:
    """A trie over sorted distinct sequences of numbers from 1: BASE and CHECK."""

    def __init__(self, codes: np.ndarray, offset: np.ndarray, length: np.ndarray):
        self.base, self.check, self.used, self.free = np.zeros(1024, np.int64), np.full(1024, -1, np.int64), bytearray(1024), 1
        self.used[0] = 1
        state, live, d = np.zeros(len(length), np.int64), np.flatnonzero(length > 0), 0
        while len(live):
            s, c = state[live], codes[offset[live] + d]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
            parent, code = s[new], c[new]
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(parent)], strict=True):
                self._place(int(parent[a]), code[a:b])
            state[live] = self.base[s] + c
            d += 1
            live = live[length[live] > d]

    def _place(self, parent: int, codes: np.ndarray) -> None:
        """The first place where all children of a state are free."""
        own = codes.tolist()
        least, span = min(own), max(own) - min(own)
        while self.used[self.free]:
            self.free += 1
            self._room(self.free)
        at = self.free
        while True:
            self._room(at + span)
            if not self.used[at] and (len(own) == 1 or not any(self.used[at - least + c] for c in own)):
                break
            at += 1
        self.base[parent] = at - least
        self.check[codes + (at - least)] = parent
        for c in own:
            self.used[at - least + c] = 1

    def _room(self, at: int) -> None:
        if at >= len(self.used):
            more = max(at + 1 - len(self.used), len(self.used))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.used += bytes(more)

    def walk(self, codes: np.ndarray, offset: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth the sequences that are so long and the states that they reach; a sequence that isn't in the trie ends where it leaves it."""
        state, live, d = np.zeros(len(length), np.int64), np.arange(len(length)), 0
        yield live, state
        while len(live := live[length[live] > d]):
            to = self.base[state[live]] + codes[offset[live] + d]
            inside = (to >= 0) & (to < len(self.check))
            inside[inside] = self.check[to[inside]] == state[live[inside]]
            live, to = live[inside], to[inside]
            state[live] = to
            d += 1
            yield live, to


def node_id(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()[:16]


#: The root's.
ROOT = bytes(16)


def _turns(path: bytes) -> list[bytes]:
    return [path[i : i + TURN] for i in range(0, len(path), TURN)]


def chunk_nodes(paths: list[bytes], count: list[int], least: list[int]) -> dict[str, list]:
    """Columns of NODE, parent_conv and whether a node may have a part in other chunks, of sorted distinct paths."""
    split = [_turns(p) for p in paths]
    length = np.array([len(t) for t in split], np.int64)
    offset = np.cumsum(length) - length
    number: dict[bytes, int] = {}
    codes = np.zeros(int(length.sum()), np.int64)
    live, d = np.flatnonzero(length > 0), 0
    while len(live):  # by depth, so that the children of upper nodes have near numbers
        codes[offset[live] + d] = [number.setdefault(split[i][d], len(number) + 1) for i in live.tolist()]
        d += 1
        live = live[length[live] > d]
    turn = [b"", *number]
    chars = np.array([0, *(int.from_bytes(t[16:], "big") for t in number)], np.int64)
    trie = DoubleArray(codes, offset, length)
    size = len(trie.check)
    n, conv, own = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    shared, ends = np.zeros(size, bool), np.full(size, -1, np.int64)
    counts, leasts, levels = np.array(count, np.int64), np.array(least, np.int64), []
    for d, (live, state) in enumerate(trie.walk(codes, offset, length)):
        np.add.at(n, state, counts[live])
        np.minimum.at(conv, state, leasts[live])
        if d:
            own[state] = codes[offset[live] + d - 1]
        shared[state[(live == 0) | (live == len(paths) - 1)]] = True
        last = length[live] == d
        ends[state[last]] = live[last]
        levels.append(np.unique(state))
    children, leaves, weight, once = (np.zeros(size, np.int64) for _ in range(4))
    for d in range(len(levels) - 1, -1, -1):
        s = levels[d]
        leaves[s] += children[s] == 0
        weight[s] += n[s] * chars[own[s]]
        once[s] += chars[own[s]]
        if d:
            up = trie.check[s]
            np.add.at(children, up, 1)
            for x in (leaves, weight, once):
                np.add.at(x, up, x[s])
    ids: list = [None] * size
    ids[0] = ROOT
    out: dict[str, list] = {c: [] for c in ("shared", "id", "parent", "depth", "conv", "n", "children", "leaves", "weight", "once", "class", "parent_conv")}
    for d, s in enumerate(levels):
        up = trie.check[s] if d else np.zeros(1, np.int64)
        if d:
            for x, u, c in zip(s.tolist(), up.tolist(), own[s].tolist(), strict=True):
                ids[x] = node_id(ids[u], turn[c])
        out["id"] += [ids[x] for x in s.tolist()]
        out["parent"] += [ids[u] if d else None for u in up.tolist()]
        out["parent_conv"] += [None if not d or shared[u] else int(conv[u]) for u in up.tolist()]
        out["class"] += [hashlib.sha256(paths[e]).digest()[:16] if e >= 0 else None for e in ends[s].tolist()]
        out["depth"] += [d] * len(s)
        for c, x in (("shared", shared), ("conv", conv), ("n", n), ("children", children), ("leaves", leaves), ("weight", weight), ("once", once)):
            out[c] += x[s].tolist()
    return out


def _record(pa, rows: dict[str, list], size: int):
    kinds = [("kind", pa.int32()), ("id", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv", "n", "children", "leaves", "weight", "once")], ("class", pa.binary()), ("parent_conv", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(rows.get(c, [None] * size), k) for c, k in kinds], [c for c, _ in kinds])


def _tries(batches: Iterator, room: int = ROOM) -> Iterator:
    """Sorted distinct paths, counts and least conversations -> nodes (kind 0: final, 1: in part), and the ends of each chunk (kind 2)."""
    import pyarrow as pa

    def flush():
        rows = chunk_nodes(paths, count, least)
        size = len(rows["id"])
        rows["kind"] = [int(x) for x in rows["shared"]]
        yield _record(pa, rows, size)
        yield _record(pa, {"kind": [2], "first": [paths[0]], "last": [paths[-1]]}, 1)

    paths, count, least, size = [], [], [], 0
    for batch in batches:
        for p, n, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            paths.append(p)
            count.append(n)
            least.append(c)
            size += len(p) // TURN + 1
            if size >= room:
                yield from flush()
                paths, count, least, size = [], [], [], 0
    if paths:
        yield from flush()


def _twice(batches: Iterator) -> Iterator:
    """Last path of a chunk and first of the next -> what both counted, as sums to take off."""
    import pyarrow as pa

    for batch in batches:
        for last, after in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            a, b = _turns(last), _turns(after)
            common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            chars = np.array([0, *(int.from_bytes(t[16:], "big") for t in a[:common])], np.int64)
            again = np.cumsum(chars[::-1])[::-1]
            ids = [ROOT]
            for t in a[:common]:
                ids.append(node_id(ids[-1], t))
            n = len(ids)
            extended = int(common == len(a))  # the last path went on, so its end is no leaf
            yield _record(pa, {"id": ids, "depth": list(range(n)), "n": [0] * n, "children": [-1] * common + [0], "leaves": [-extended] * n, "weight": [0] * n, "once": (-again).tolist()}, n)


def _hashed(batches: Iterator) -> Iterator:
    """Classes and their parts, sorted -> the digest of each class's parts, joined by commas, with no more than a part in memory."""
    import pyarrow as pa

    now, sha = None, None
    for batch in batches:
        done: list[tuple] = []
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(part.encode())
            else:
                sha.update(b"," + part.encode())  # type: ignore[union-attr]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["class", "ends"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["class", "ends"])


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns: the conversation's turns in order, each as TURN bytes in hex."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turn = F.upper(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0")))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).isNotNull().alias("a"), F.col(turn_col).alias("b"), turn.alias("c"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "c")))["c"].alias("turns"))


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (as turns() gives them), a row a conversation -> the trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    n = partitions(spark)
    path = F.unhex(F.array_join("turns", ""))
    rows = cut(conversations.select("conv_id", path.alias("path")), "paths")
    distinct = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    dealt = distinct.repartitionByRange(n, F.substring("path", 1, KEY * TURN)).sortWithinPartitions("path")
    found = cut(dealt.mapInArrow(_tries, OUT), "nodes")
    # the ends of chunks: a row a chunk
    after = found.filter("kind = 2").select("last", F.lead("first").over(Window.orderBy("first")).alias("after")).filter("after is not null")
    names = [c.split()[0] for c in NODE.split(", ")]
    parts = found.filter("kind = 1").select(*names).union(after.mapInArrow(_twice, OUT).select(*names))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "weight", "once")]
    upper = cut(parts.groupBy("id").agg(F.max("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), *sums, F.max("class").alias("class")), "upper")
    above = upper.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
    inner = found.filter("kind = 0")
    columns = [*names[2:], "parent_conv"]
    all_ = inner.filter("parent_conv is not null").select(*columns)
    all_ = all_.union(inner.filter("parent_conv is null").drop("parent_conv").join(above, "parent").select(*columns))
    all_ = all_.union(upper.filter("parent is not null").join(above, "parent").select(*columns)).union(upper.filter("parent is null").select(*names[2:], F.lit(None).cast("long")))
    cls = F.unhex(F.substring(F.sha2("path", 256), 1, 32))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = rows.groupBy(cls.alias("class"), F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("part"))
    ends = blocks.repartition(n, "class").sortWithinPartitions("class", "block").select("class", "part").mapInArrow(_hashed, "class binary, ends string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = all_.filter("class is null").withColumn("ends", none).unionByName(all_.filter("class is not null").join(ends, "class"))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("weight") - F.col("once")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def with_heads(conversations: DataFrame) -> DataFrame:
    """The contract's conversations: the first turns of another one in front of a conversation's own rest. Each of these has at most a hundred."""
    c: Column = F.col("conv_id")
    heads = conversations.select(c.alias("head_id"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return conversations.join(heads, c - c % 100 == F.col("head_id"), "left").select("conv_id", F.concat(head, rest).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(with_heads(turns(table(spark, sf_dir, "conversations"))))


ORACLE = r"""
with t as (select conv_id, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as k, length(coalesce(text, '')) as n from conversations where conv_id is not null),
c as (select conv_id, list({k: sha256(k), n: n} order by turn nulls first, substr(sha256(k), 1, 32), n) as ts,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda s, z: xor(s // 2, 3988292384 * (s % 2)))) as crc from t group by conv_id),
r as (select a.conv_id, list_concat(coalesce(b.ts[1 : xor(a.crc, 4294967295) % 6], []), a.ts[xor(a.crc, 4294967295) % 6 + 1 :]) as ts
  from c a left join c b on b.conv_id = a.conv_id - a.conv_id % 100),
p as (select conv_id, d, len(ts) as size, sha256(array_to_string(list_transform(ts[1 : d], lambda x: x.k), '')) as id,
    case when d > 0 then sha256(array_to_string(list_transform(ts[1 : d - 1], lambda x: x.k), '')) end as parent, case when d > 0 then ts[d].n else 0 end as chars
  from (select *, unnest(range(len(ts) + 1)) as d from r)),
nodes as (select id, any_value(parent) as parent, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = size), '') as ends from p group by id),
kids as (select parent, count(*) as n_children from nodes where parent is not null group by parent),
full_ as (select n.*, coalesce(n_children, 0) as n_children, m.conv_id as parent_conv_id from nodes n left join kids k on k.parent = n.id left join nodes m on m.id = n.parent),
under as (select distinct up.id as top, f.id from full_ f join p on p.conv_id = f.conv_id and p.d = f.depth join p up on up.conv_id = p.conv_id and up.d <= p.d),
sums as (select top, sum((n_convs - 1) * chars)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from under join full_ using (id) group by top)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) as ends_sha256 from full_ join sums on top = id
"""
