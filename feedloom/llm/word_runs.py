"""Periodic run detection: stretches of a text that repeat one passage over and over, word for word.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_LENGTH, TIMES * q) words that no
neighbouring word extends. Runs are the maximal pairs of a text whose distance is small against their common extension:

1. The words of a slice of texts become numbers, and the places whose first LEAST words come once in their text are put aside by a
   hash: no pair starts there. Texts without other places have no runs.
2. The suffixes of the rest are sorted by prefix doubling, by numbers of words, never by hashes; the ranks of each doubling give
   the common prefixes of neighbours.
3. The tree of LCP intervals is walked from the bottom up. An interval keeps its places in order, each with the word to its left, the
   class that maximal pairs must differ in. Where two children meet at common prefix l, the smaller looks up its places in the
   larger one. Places at most l / (TIMES - 1) apart lie in one periodic stretch, where all but the first have the same word to
   the left, so the nearest place behind and the farthest before within that distance decide: no other pair can be maximal.
4. A maximal pair (x, y) with common extension l is the run [x, y + l) of period y - x; of several at one stretch the least is the period.

A text is judged by itself, in the task that reads it: nothing is shuffled. Cases: a null or empty text has no words and no runs;
repeated rows are judged alike; null ids stay; other columns are not looked at; an empty table gives no rows. Long texts are taken whole:
memory is some 4 bytes a word and doubling, time grows with n log(n)^2."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, words
from .set_join import _mix

#: Fixed values of the contract.
MIN_LENGTH, TIMES = 6, 4
#: Least common prefix of a pair: of period 1, MIN_LENGTH - 1; of longer ones (TIMES - 1) * 2.
LEAST = 5
#: Characters of text that are numbered together.
SLICE = 1_000_000
BLOCK = 512


class Places:
    """Numbers in order, in blocks."""

    __slots__ = ("blocks", "first", "size")

    def __init__(self, place: int):
        self.blocks, self.first, self.size = [[place]], [place], 1

    def at_least(self, x: int) -> int | None:
        k = bisect_right(self.first, x) - 1
        if k >= 0:
            b = self.blocks[k]
            i = bisect_left(b, x)
            if i < len(b):
                return b[i]
        return self.first[k + 1] if k + 1 < len(self.first) else None

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.first, x) - 1)
        b = self.blocks[k]
        insort(b, x)
        self.first[k] = b[0]
        self.size += 1
        if len(b) > 2 * BLOCK:
            self.blocks.insert(k + 1, b[BLOCK:])
            del b[BLOCK:]
            self.first.insert(k + 1, self.blocks[k + 1][0])


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the common prefix of each with the one before."""
    n = len(ids)
    rank = np.full(n + 1, -1, np.int64)
    order = np.argsort(ids, kind="stable")
    new = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, h, open_ = [rank.astype(np.int32)], 1, np.arange(n)
    while True:
        size = np.bincount(rank[open_], minlength=n)
        open_ = open_[size[rank[open_]] > 1]  # the others stand where they belong
        if not len(open_):
            break
        key = rank[open_] * (n + 2) + rank[np.minimum(open_ + h, n)] + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        part = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        rank[open_] = old + part - group
        h *= 2
        levels.append(rank.astype(np.int32))
    sa = np.empty(n, np.int64)
    sa[rank[:-1]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for j in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[j][a] == levels[j][b])
        a[same] += 1 << j
        b[same] += 1 << j
    lcp[1:] = a - sa[:-1]
    return sa, lcp


def maximal_pairs(sa: list[int], lcp: list[int], left: list[int], found: dict[tuple[int, int], int]) -> None:
    """The runs of neighbouring suffixes whose common prefixes (lcp[0] apart) are LEAST or more: start and end with the least period."""

    def meet(a: Places, b: Places, l: int) -> Places:
        if a.size < b.size:
            a, b = b, a
        most = l // (TIMES - 1)
        own = [z for block in b.blocks for z in block]
        for z in own:
            y = a.at_least(z + 1)
            if y is not None and y - z <= most and left[y] != left[z]:
                found[z, y + l] = min(y - z, found.get((z, y + l), y))
            x = a.at_least(z - most)
            if x is not None and x < z and left[x] != left[z]:
                found[x, z + l] = min(z - x, found.get((x, z + l), z))
        for z in own:
            a.add(z)
        return a

    stack: list[list] = []
    last = Places(sa[0])
    for place, l in zip([*sa[1:], -1], [*lcp[1:], 0], strict=True):
        while stack and stack[-1][0] > l:
            depth, places = stack.pop()
            last = meet(places, last, depth)
        if stack and stack[-1][0] == l:
            stack[-1][1] = meet(stack[-1][1], last, l)
        else:
            stack.append([l, last])
        last = Places(place)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text of numbered words, by start, then period."""
    sa, lcp = suffixes(ids)
    deep = lcp >= LEAST
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    left = [-1, *ids.tolist()]
    found: dict[tuple[int, int], int] = {}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        maximal_pairs(sa[a - 1 : b].tolist(), lcp[a - 1 : b].tolist(), left, found)
    return sorted(((x, end - x, q) for (x, end), q in found.items()), key=lambda r: (r[0], r[2]))


def _recurring(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each text has LEAST words in a row that come twice in it, as far as a hash tells: it never misses one."""
    out = np.zeros(int(doc[-1]) + 1 if len(doc) else 0, bool)
    n = len(ids) - LEAST + 1
    if n < 2:
        return out
    word = _mix(ids.astype(np.uint64) + np.uint64(1))
    key = _mix(doc[:n].astype(np.uint64))
    for k in range(LEAST):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[LEAST - 1 :])
    order = at[np.argsort(key[at])]
    out[doc[order[1:][key[order[1:]] == key[order[:-1]]]]] = True
    return out


def _find(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts, low = batch.column(1).cast(pa.binary()), 0
        while low < len(texts):
            split, size, high = [], 0, low
            while high < len(texts) and size < SLICE:
                text = texts[high].as_py() or b""
                split.append(text.split())  # bytes are split at the white space of the contract, no other
                size += len(text)
                high += 1
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for s in split for w in s], np.int64)
            ends = np.cumsum([len(s) for s in split])
            again = _recurring(ids, np.repeat(np.arange(len(split)), [len(s) for s in split]))
            runs, collapsed = [], []
            for k, s in enumerate(split):
                found = runs_of(np.unique(ids[ends[k] - len(s) : ends[k]], return_inverse=True)[1]) if k < len(again) and again[k] else []
                runs.append(found)
                if found:
                    edge = np.zeros(len(s) + 1, np.int64)
                    x = np.array(found)
                    np.add.at(edge, x[:, 0] + x[:, 2], 1)
                    np.add.at(edge, x[:, 0] + x[:, 1], -1)
                    s = [s[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(s))
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(found) for found in runs])]).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), struct), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])
            low = high


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period) and collapsed: the words joined by one space, without
    those that a run holds after its first period."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, of equal ones the first in order; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda b, r: r["length"] * b["period"] > b["length"] * r["period"]
    return F.aggregate(runs, none, lambda b, r: F.when(b.isNull() | more(b, r), r).otherwise(b))


def rebuilt(id_: Column, text: Column) -> Column:
    """The contract's texts: in those with crc32(id) % 10 = 0, the words from a on repeat the p words there."""
    w = words(text)
    h = F.crc32(id_.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(w)
    a = (g % n).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(text)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", rebuilt(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = word_runs(docs).withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of places with five equal words, a period apart, as islands; the least period of a stretch is its own.
ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w0,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda s, z: xor(s // 2, 3988292384 * (s % 2)))) as c
  from documents),
e as (select rid, doc_id, w0, len(w0) as n, case when doc_id is null then 1 else xor(c, 4294967295) end as h from d),
f as (select *, h // 10 as g, case when n > 0 then (h // 10) % n end as a from e),
k as (select *, 1 + (n - a) // (3 + g % 8) as p from f),
x as (select rid, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w0[i + 1] else w0[a + (i - a) % p + 1] end) else w0 end as w from k),
pos as (select rid, n, unnest(range(n)) as i, unnest(w) as word from x where n >= 6),
gram as (select rid, i, n, list(word) over (partition by rid order by i rows between current row and 4 following) as gr from pos),
five as (select rid, i, hash(gr) as hg, gr from gram where i + 5 <= n),
pairs as (select l.rid, l.i, r.i - l.i as q from five l join five r on l.rid = r.rid and l.hg = r.hg and l.gr = r.gr and r.i > l.i),
isl as (select rid, q, i, i - row_number() over (partition by rid, q order by i) as grp from pairs),
cand as (select rid, q, min(i) as start, count(*) + 4 + q as length from isl group by rid, q, grp having count(*) + 4 + q >= greatest(6, 4 * q)),
runs as (select rid, start, length, min(q) as period from cand group by rid, start, length),
top as (select *, row_number() over (partition by rid order by length::double / period desc, start, period) as rn from runs),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from runs),
kept as (select rid, list(word order by i) as ws from (select x.rid, unnest(range(n)) as i, unnest(w) as word from x) anti join gone using (rid, i) group by rid),
says as (select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t from runs group by rid)
select doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(t, '')) as runs_sha256,
  sha256(coalesce(array_to_string(ws, ' '), '')) as collapsed_sha256
from x left join says using (rid) left join (select rid, start, length, period from top where rn = 1) using (rid) left join kept using (rid)
"""
