"""Benchmark decontamination: finds and removes the passages of a corpus that test items hold too.

A window is `window` consecutive words of an item (a shorter item is one window); whatever a document has of one is contaminated.

1. The items go to the shared folder. A task reads them from there and numbers their words; a word of a document that no item has
   is a gap, which no window crosses, so stretches between gaps that are shorter than the shortest window are left out. The rest of a
   shard of texts (equal texts once) is its stream of numbers.
2. The stream gets an FM-index: suffixes sorted by prefix doubling, the last column as a wavelet matrix of packed bits, and the places of
   every SAMPLE-th position.
3. All windows of a block of items are searched at a time from their last word to the first: each step maps both ends of a window's range
   of suffixes through the ranks of the wavelet matrix. Rows of ranges that aren't empty at the end are walked back to a sampled position.
4. The windows' places are merged into spans of words by document, and the items they belong to are listed.

Nothing is shuffled, and no group is gathered. Memory of a task is bounded by SHARD characters of text, the distinct words of the items, and
BLOCK words of items at a time (items within BLOCK are kept between shards). The spans and items of a document are its result.

Cases: a null or empty text has no words; items without words have no window; a null item id marks words as hit, but isn't listed or counted;
rows of items with one id are one item; repeated documents are judged alike, null ids and all; a document column of another
name is not looked at; without documents or items the result is empty, or without hits. Texts are taken whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, open_fs, table
from .word_runs import suffixes

#: Fixed values of the contract.
WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a shard's texts; words of items that are searched at a time; distance of sampled positions.
SHARD = 8_000_000
BLOCK = 2_000_000
SAMPLE = 16
#: A-Z to a-z, and what isn't part of a word to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


class Bits:
    """Bits with rank: how many of the first i are set."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FmIndex:
    """Count and locate of patterns in a stream of numbers from 0 to size - 1."""

    def __init__(self, stream: np.ndarray, size: int, sample: int = SAMPLE):
        self.n, self.sample = len(stream), sample
        sa, _ = suffixes(np.concatenate([stream.astype(np.int64) + 1, [0]]))
        last = np.concatenate([stream.astype(np.int64) + 1, [0]])[sa - 1]
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=size + 1))])
        marked = sa % sample == 0
        self.marked, self.places = Bits(marked), sa[marked]
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(size).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), int(len(last) - ones.sum())))
            last = np.concatenate([last[~ones], last[ones]])
        self.base = self._down(np.arange(size + 1), np.zeros(size + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Positions of the last column through all levels of the wavelet matrix, as if symbol stood there."""
        for bit, bits, zeros in self.levels:
            r = bits.rank(i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + r, i - r)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The first row, or the one after the last, of symbol followed by what the rows before i start with."""
        return self.smaller[symbol] + self._down(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (a row each) that occur, and the first row and the one after the last of their suffixes."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n + 1, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, j].astype(np.int64) + 1
            low, high = self.step(symbol, low), self.step(symbol, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out = np.zeros(len(rows), np.int64)
        at, row = np.arange(len(rows)), rows.copy()
        for walked in range(self.sample):
            hit = self.marked.at(row)
            out[at[hit]] = self.places[self.marked.rank(row[hit])] + walked
            at, row = at[~hit], row[~hit]
            if not len(at):
                break
            i, symbol = row, np.zeros(len(row), np.int64)
            for bit, bits, zeros in self.levels:
                one, r = bits.at(i), bits.rank(i)
                symbol |= one.astype(np.int64) << bit
                i = np.where(one, zeros + r, i - r)
            row = self.smaller[symbol] + i - self.base[symbol]
        return out


class Phrases:
    """The items in the shared folder, their words numbered from 1."""

    def __init__(self, path: str, window: int, block: int):
        self.path, self.window, self.block = path, window, block
        self.number: dict[bytes, int] = {}
        self.shortest, total = window, 0
        for _, text in self._rows():
            w = plain_words(text)
            total += len(w)
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
            if w:
                self.shortest = min(self.shortest, len(w))
        self.kept = list(self._blocks()) if total <= block else None

    def _rows(self) -> Iterator[tuple[str | None, bytes]]:
        import pyarrow.dataset as ds
        import pyarrow as pa

        fs, at = open_fs(self.path)
        for batch in ds.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["item", "text"], batch_size=1024):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)

    def _blocks(self) -> Iterator[tuple[list, list]]:
        """(item ids, groups of windows of one length, each with the distinct windows, and the items by window)."""
        names, ids, size = [], [], 0
        for name, text in self._rows():
            w = plain_words(text)
            if w:
                names.append(name)
                ids.append(np.array([self.number[x] for x in w], np.int32))
                size += len(w)
                if size >= self.block:
                    yield names, self._windows(ids)
                    names, ids, size = [], [], 0
        if names:
            yield names, self._windows(ids)

    def _windows(self, ids: list[np.ndarray]) -> list:
        out = []
        for length in sorted({min(len(x), self.window) for x in ids}):
            own = [i for i, x in enumerate(ids) if min(len(x), self.window) == length]
            all_ = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids[i], length) for i in own])
            item = np.repeat(own, [len(ids[i]) - length + 1 for i in own])
            patterns, which = np.unique(all_, axis=0, return_inverse=True)
            order = np.lexsort((item, which.ravel()))
            which, item = which.ravel()[order], item[order]
            out.append((patterns, item, np.searchsorted(which, np.arange(len(patterns) + 1))))
        return out

    def blocks(self) -> Iterator:
        yield from self._blocks() if self.kept is None else self.kept


def _pairs_of(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k], first[k] + 1, ... count[k] times, and k."""
    owner = np.repeat(np.arange(len(first)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set]]:
    """Spans of words, in order, and item ids of each text of a shard."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(phrases.number.get, chain.from_iterable(texts), repeat(0)), np.int32, int(sizes.sum()))
    ends = np.cumsum(sizes)
    spans, items = [[] for _ in texts], [set() for _ in texts]  # type: ignore[var-annotated]
    known = np.concatenate([[False], ids > 0, [False]])
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(ids))]
    edge = np.diff(known.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a stretch ends where its text does
    both = inner[known[inner] & known[inner + 1]]
    begin, end = np.sort(np.concatenate([begin, both])), np.sort(np.concatenate([end, both]))
    begin, end = np.unique(begin), np.unique(end)
    long = end - begin >= phrases.shortest
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return spans, items
    at, owner = _pairs_of(begin, size)
    to = np.cumsum(size + 1) - size - 1  # where a stretch starts in the stream, a gap after each
    stream = np.zeros(int(size.sum()) + len(size), np.int32)
    stream[at - begin[owner] + to[owner]] = ids[at]
    index = FmIndex(stream, len(phrases.number) + 1)
    hit = np.zeros(len(ids) + 1, np.int32)
    for names, groups in phrases.blocks():
        for patterns, item, from_ in groups:
            which, low, high = index.search(patterns)
            rows, pattern = _pairs_of(low, high - low)
            for part in range(0, len(rows), 1_000_000):
                place, own = index.locate(rows[part : part + 1_000_000]), which[pattern[part : part + 1_000_000]]
                k = np.searchsorted(to, place, side="right") - 1
                start = begin[k] + place - to[k]
                np.add.at(hit, start, 1)
                np.add.at(hit, start + patterns.shape[1], -1)
                met = np.unique(np.stack([np.searchsorted(ends, start, side="right"), own], 1), axis=0)
                at, row = _pairs_of(from_[met[:, 1]], from_[met[:, 1] + 1] - from_[met[:, 1]])
                for d, i in np.unique(np.stack([met[row, 0], item[at]], 1), axis=0).tolist():
                    items[d].add(names[i])
    covered = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
    both = inner[covered[inner] & covered[inner + 1]]
    edge = np.diff(covered.astype(np.int8))
    begin = np.unique(np.concatenate([np.flatnonzero(edge == 1), both]))
    end = np.unique(np.concatenate([np.flatnonzero(edge == -1), both]))
    doc = np.searchsorted(ends, begin, side="right")
    for d, x, y in zip(doc.tolist(), (begin - ends[doc] + sizes[doc]).tolist(), (end - ends[doc] + sizes[doc]).tolist(), strict=True):
        spans[d].append((x, y))
    return spans, items


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each span."""
    if not spans:
        return text
    at = [m.span() for m in re.finditer(WORD, text.translate(_LOWER))]
    out, last = [], 0
    for x, y in spans:
        out.append(text[last : at[x][0]])
        last = at[y - 1][1]
    return "".join([*out, text[last:]])


_LOWER = {c: c + 32 for c in range(65, 91)}
_HELD: dict[tuple, Phrases] = {}


def _search(batches: Iterator, path: str, window: int, shard: int, block: int, texts: bool) -> Iterator:
    import pyarrow as pa

    if (path, window, block) not in _HELD:
        _HELD.clear()
        _HELD[path, window, block] = Phrases(path, window, block)
    phrases = _HELD[path, window, block]

    def flush():
        spans, items = search_shard(distinct, phrases)
        number = [len(w) for w in distinct]
        flat = np.array([s for k in own for s in spans[k]], np.int64).reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum([len(spans[k]) for k in own])]).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], ["start", "end"])
        columns = [pa.array(ids, pa.int64()), pa.array([number[k] for k in own], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), struct), pa.array([sorted(x for x in items[k] if x is not None) for k in own], pa.list_(pa.string()))]
        if texts:
            columns.append(pa.array([None if t is None else without_spans(t.decode(), spans[k]) for t, k in zip(raw, own, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items", *["kept"] * texts])

    seen: dict[bytes, int] = {}
    distinct, own, ids, raw, size = [], [], [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = t.as_py()
            key = text or b""
            if key not in seen:
                seen[key] = len(distinct)
                distinct.append(plain_words(key))
                size += len(key)
            own.append(seen[key])
            ids.append(d)
            if texts:
                raw.append(text)
            if size >= shard or len(own) >= 50_000:
                yield flush()
                seen.clear()
                distinct, own, ids, raw, size = [], [], [], [], 0
    if own:
        yield flush()


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, texts: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (array of start, end: numbers of words), items (the ids, as strings, of items with a window there) and, if texts, kept:
    the text without its spans (null for null)."""
    path = fresh_path(docs.sparkSession, "items")
    items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).write.parquet(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>" + ", kept string" * texts
    return rows.mapInArrow(partial(_search, path=path, window=window, shard=shard, block=block, texts=texts), schema)


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), texts=False)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


#: Windows by their words, joined; each occurrence covers its words.
ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, k, ws from (select item_id, least(10, len(w)) as k, unnest(list_transform(range(len(w) - least(10, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(10, len(w))], ' '))) as ws from b where len(w) > 0)),
sizes as (select distinct k from bw),
dw as (select rid, k, unnest(range(len(w) - k + 1)) as i, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) as ws from d, sizes where len(w) >= k),
found as (select rid, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.ws = bw.ws),
hits as (select rid, count(distinct p) as n_hit from (select distinct rid, unnest(range(i, i + k)) as p from found) group by rid),
names as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as t from (select distinct rid, item_id::varchar as item from found where item_id is not null) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(t, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (rid) left join names using (rid)
"""
