"""Suffix-array dedup: removes the bytes of every long string that an earlier document holds too.

Suffixes are the starts of windows of LENGTH bytes. They are dealt out by prefix polynomial hashes and sorted
by their bytes:

1. Among the short substrings (GRAM bytes) of a window the one of least hash is its anchor, so equal
   windows have equal anchors at equal places. The windows of one anchor are a run; the text
   that they span is the run's context. Equal runs of a slice of texts become one row, so that a passage of many documents
   costs a row a slice. Anchors, digests of contexts and least documents go to hash ranges as packed arrays.
2. Runs with the same anchor and context as a run of an earlier document are covered whole; contexts are
   equal when a cryptographic digest of their bytes is, beside the anchor's hash (64 and 40 bits).
   Where contexts differ around the same anchor, as at the ends of a repeated passage,
   the runs of the earliest document of each context are kept for comparison.
3. The windows of those are suffix-sorted within their anchor: by WORD bytes at a time from the front, and a suffix that
   differs from all others has its place. Those that the last bytes leave together are equal.
   An anchor with more contexts than MOST_CONTEXTS (a passage that a third of all documents
   frame differently) isn't gathered: its windows are dealt out by their digests and the
   earliest document is found by a grouped minimum.
4. A last pass over the texts joins the covered ranges and drops them.

Memory a task doesn't follow the input: texts are hashed in pieces of SLICE bytes, also inside a long text (a run
that a piece cuts is one of another context, which step 3 resolves), hash ranges hold the runs of about
RANGE bytes of text, and a task reads its ranges one after the other in sorted order.

The texts are written once as shards to the shared folder; the later passes read them there, so
texts are never shuffled. The runs of a shard are found once and kept beside it, in about two bytes a run.

Defined cases: a null text is empty; a text under LENGTH bytes loses nothing; repetition within
a document, or in rows of the same doc_id, isn't removed; a null doc_id counts as the smallest;
very long texts are used whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fresh_path, open_fs, partitions
from .set_join import _RANDOM, _by_first, _mix, _powers

#: Fixed value of the contract.
LENGTH = 50
GRAM = 20
MOST_CONTEXTS = 50_000
#: Bytes of text that are hashed together, and whose runs a hash range holds.
SLICE = 400_000
RANGE = 8_000_000
#: Bytes of suffixes that are sorted together, beside 24 bits for the group that they stand in.
WORD = 5
#: Bits of a position within a piece, in the low end of an anchor's rank.
PLACE = np.uint64((1 << 20) - 1)
NO_ID = -(1 << 63)


class Hashed:
    """Bytes with prefix polynomial hashes: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * self.up[:-1], out=self.prefix[1:])

    def of(self, start, size):
        return (self.prefix[start + size] - self.prefix[start]) * self.down[start]

    def all(self, size: int) -> np.ndarray:
        """Of each place that has so many bytes."""
        return (self.prefix[size:] - self.prefix[:-size]) * self.down[: len(self.prefix) - size]


def suffix_sort(text: Hashed, starts: np.ndarray, segment: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """The order of suffixes by segment (which must not fall), then by their first limit bytes."""
    return _sorted(text.data, starts, segment, limit)[0]


def _sorted(data: np.ndarray, starts: np.ndarray, segment: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and the places in it whose suffix has the segment and the bytes of the one before. All
    segments are sorted at a time, by WORD bytes from the front; what stands alone then isn't sorted further."""
    n = len(starts)
    order, same = np.arange(n), np.zeros(n, bool)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))  # the eight bytes at each place
    first = np.concatenate([[True], segment[1:] != segment[:-1]])[:n]
    at, group, depth = order, first, 0
    while True:
        alone = first & np.concatenate([first[1:], [True]])[: len(first)]
        at, group = at[~alone], np.cumsum(first[~alone]).astype(np.uint64)
        if not len(at) or depth >= limit:
            break
        take = min(WORD if len(at) < 1 << 24 else 4, limit - depth)
        key = (group << np.uint64(8 * take)) | (words[starts[order[at]] + depth].byteswap() >> np.uint64(64 - 8 * take))
        moved = np.argsort(key, kind="stable")
        order[at], key = order[at[moved]], key[moved]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        depth += take
    if len(at):
        same[at[1:]] = group[1:] == group[:-1]
    return order, same


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last window, hash of the anchor and digest of the context, of all runs of the
    documents at starts..ends of a stream, piece by piece."""
    edge = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge[:-1]))
    none = np.zeros(0, np.int64)
    parts = [(none, none, none, none.astype(np.uint64), none.astype(np.uint64))]
    for low in range(0, len(data), SLICE):
        own = windows[np.searchsorted(windows, low) : np.searchsorted(windows, low + SLICE)]
        if len(own):
            anchor, first, last, gram, context = _piece(data[low : low + SLICE + LENGTH - 1], own - low)
            parts.append((anchor + low, first + low, last + low, gram, context))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _piece(data: np.ndarray, windows: np.ndarray):
    text = Hashed(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = _mix(text.all(GRAM))
    low, have, span = (gram & ~PLACE) | at.astype(np.uint64), 1, LENGTH - GRAM + 1
    places = len(low)
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: places - span + 1], low[span - have : places - have + 1])
    anchor = (low[windows] & PLACE).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    first, last = windows[cuts], windows[np.concatenate([cuts[1:], [len(windows)]]) - 1]
    anchor, raw = anchor[cuts], data.tobytes()
    digest = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]), np.uint64)
    return anchor, first, last, gram[anchor], digest ^ _mix((anchor - first + 1).astype(np.uint64))  # where the anchor stands in the context is part of it


def _equal_runs(gram: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each run among equal ones, and the first run and the least document of each class; classes are
    numbered by their first runs."""
    if not len(gram):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), doc
    order = np.argsort(context, kind="stable")
    g, c = gram[order], context[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
    first = order[new]
    rank = np.argsort(first)
    number = np.empty(len(rank), np.int64)
    number[rank] = np.arange(len(rank))
    which = np.empty(len(order), np.int64)
    which[order] = number[np.cumsum(new) - 1]
    return which, first[rank], np.minimum.reduceat(doc[order], np.flatnonzero(new))[rank]


def _shard(path: str) -> Iterator[tuple[int, list, list[bytes]]]:
    """(position, doc_ids, texts) of the slices of a shard, always in the same order."""
    import pyarrow.parquet as pq

    fs, at = open_fs(path)
    position = 0
    with fs.open_input_file(at) as f:
        ids, texts, size = [], [], 0
        for batch in pq.ParquetFile(f).iter_batches(batch_size=512):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(NO_ID if d is None else d)
                texts.append(b if (b := t.as_py()) is not None else b"")
                size += len(texts[-1])
                if size >= SLICE:
                    yield position, ids, texts
                    position += size
                    ids, texts, size = [], [], 0
        if ids:
            yield position, ids, texts


def _slices(path: str):
    """position, doc_ids, texts, where they start and end, and their bytes as one stream."""
    for position, ids, texts in _shard(path):
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        yield position, ids, texts, starts, ends, np.frombuffer(b"".join(texts), np.uint8)


#: Of the runs of a slice, which follow each other in the windows of its texts: windows, where the anchor stands, whether an equal one came
#: before, and the class of each that has.
_RUNS = ["lengths", "offsets", "again", "numbers"]


def _known(path: str, runs_path: str, shard: int):
    """What _slices gives of a shard, and its runs as _send has found them: first, last, anchor's place, document and class
    among equal runs; least document of each class."""
    import pyarrow as pa

    fs, root = open_fs(runs_path)
    with fs.open_input_stream(f"{root}/{shard}") as f, pa.ipc.open_stream(f) as kept:
        for (position, ids, texts, starts, ends, data), batch in zip(_slices(path), kept, strict=True):
            length, offset, again, number = (np.frombuffer(c[0].as_py(), kind) for c, kind in zip(batch.columns, (np.uint8, np.uint8, np.uint8, np.uint32), strict=True))
            again = np.unpackbits(again, count=len(length)).astype(bool)
            long = np.flatnonzero(ends - starts >= LENGTH)
            windows = (ends - starts)[long] - LENGTH + 1
            before, nth = np.cumsum(windows) - windows, np.cumsum(length, dtype=np.int64) - length
            of = np.searchsorted(before, nth, side="right") - 1
            first = starts[long][of] + nth - before[of]
            doc = np.array(ids, np.int64)[long[of]]
            which = np.cumsum(~again) - 1
            which[again] = number
            least = doc[~again]
            np.minimum.at(least, number, doc[again])
            yield position, ids, texts, starts, ends, data, (first, first + length - 1, offset.astype(np.int64), doc, which, least)


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of numbers, first all lowest ones, so that what is zero or alike in them takes no room when compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)[:, :size].T.tobytes()


def _from_planes(b: bytes, size: int, kind) -> np.ndarray:
    out = np.zeros((len(b) // size, np.dtype(kind).itemsize), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(size, -1).T
    return out.view(kind).ravel()


def _five(x: np.ndarray) -> bytes:
    """The high five bytes of rising numbers."""
    return _planes(np.diff(x >> np.uint64(24), prepend=np.uint64(0)), 5)


def _from_five(b: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(b, 5, np.uint64), dtype=np.uint64)


def _send(batches: Iterator, ranges: int, runs_path: str) -> Iterator:
    """Shards and their paths -> for each hash range the anchors, contexts, class numbers and documents."""
    import pyarrow as pa
    from pyspark import TaskContext

    fs, root = open_fs(runs_path)
    fs.create_dir(root, recursive=True)
    schema = pa.schema([(c, pa.binary()) for c in _RUNS])
    for batch in batches:
        for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            number, held, size = 0, [], 0
            own = f"{root}/_{TaskContext.get().taskAttemptId()}-{shard}"
            with fs.open_output_stream(own) as f, pa.ipc.new_stream(f, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for _, ids, _, starts, ends, data in _slices(path):
                    anchor, first, last, gram, context = runs(data, starts, ends)
                    which, run, least = _equal_runs(gram, context, np.array(ids, np.int64)[np.searchsorted(ends, first, side="right")])
                    again = np.ones(len(first), bool)
                    again[run] = False
                    stored = (last - first + 1).astype(np.uint8), (anchor - first).astype(np.uint8), np.packbits(again), which[again].astype(np.uint32)
                    out.write_batch(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in stored], schema=schema))
                    held.append((gram[run], context[run], np.arange(number, number + len(run), dtype=np.uint32), least))
                    number += len(run)
                    size += len(run)
                    if size > 200_000:
                        yield _dealt(pa, held, shard, ranges)
                        held, size = [], 0
            fs.move(own, f"{root}/{shard}")
            if size:
                yield _dealt(pa, held, shard, ranges)


def _dealt(pa, held, shard: int, ranges: int):
    gram, context, number, doc = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(gram)
    gram, context, number, doc = gram[order], context[order], number[order], doc[order]
    part = ((gram >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    rows: list[list] = [[] for _ in range(7)]
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            known, which = np.unique(doc[a:b], return_inverse=True)
            wide = np.uint16 if len(known) <= 1 << 16 else np.uint32
            for column, x in zip(rows, (p, shard, _five(gram[a:b]), context[a:b].tobytes(), _planes(number[a:b], 4), _planes(which.astype(wide), wide().itemsize), known.tobytes()), strict=True):
                column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[2:]]], ["part", "shard", "grams", "contexts", "numbers", "which", "docs"])


def _judge(batches: Iterator) -> Iterator:
    """The rows of hash ranges, sorted by range -> for each shard the classes that an earlier document holds too, and those to compare
    with their anchors and the number of contexts there."""
    import pyarrow as pa

    for rows in _by_first(batches):
        held = []
        for _, shard, grams, contexts, numbers, which, docs in rows:
            number, known = _from_planes(numbers, 4, np.uint32), np.frombuffer(docs, np.int64)
            own = _from_planes(which, 2, np.uint16) if len(which) == 2 * len(number) else _from_planes(which, 4, np.uint32)
            held.append((_from_five(grams), np.frombuffer(contexts, np.uint64), number, known[own], np.full(len(number), shard, np.int32)))
        del rows
        gram, context, number, doc, shard = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        twice = g[1:] == g[:-1]
        order = order[np.concatenate([[False], twice]) | np.concatenate([twice, [False]])]  # an anchor met once has no equal windows elsewhere
        if not len(order):
            continue
        gram, context, number, doc, shard = gram[order], context[order], number[order], doc[order], shard[order]
        order = np.lexsort((doc, context, gram))
        gram, context, number, doc, shard = gram[order], context[order], number[order], doc[order], shard[order]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_context = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
        earliest = doc[new_context]  # documents rise within a context
        late = doc > earliest[np.cumsum(new_context) - 1]
        of = np.flatnonzero(new_gram[new_context])
        contexts = np.diff(np.concatenate([of, [len(earliest)]]))
        mixed = np.minimum.reduceat(earliest, of) < np.maximum.reduceat(earliest, of)
        group = np.cumsum(new_gram) - 1
        compare = ~late & (mixed & (contexts > 1))[group]
        keep = late | compare
        late, compare, gram, number, shard, contexts = late[keep], compare[keep], gram[keep], number[keep], shard[keep], contexts[group[keep]]
        order = np.argsort(shard, kind="stable")
        if not len(order):
            continue
        out: list[list] = [[] for _ in range(5)]
        for rows_ in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            c, k = rows_[late[rows_]], rows_[compare[rows_]]
            for column, x in zip(out, (int(shard[rows_[0]]), number[c].tobytes(), number[k].tobytes(), gram[k].tobytes(), contexts[k].astype(np.uint32).tobytes()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["shard", "late", "compare", "anchors", "contexts"])


def _joined(blobs: list[bytes] | None, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or []), kind)


def _contexts(batches: Iterator, runs_path: str) -> Iterator:
    """Shards with their classes to compare -> the contexts of those classes' runs in their least document."""
    import pyarrow as pa

    for batch in batches:
        for shard, path, numbers, anchors, counts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            number, key, count = _joined(numbers, np.uint32), _joined(anchors, np.uint64).view(np.int64), _joined(counts, np.uint32)
            order = np.argsort(number)
            number, key, count = number[order], key[order], count[order]
            base = 0
            for position, _, _, _, _, data, (first, last, offset, doc, which, least) in _known(path, runs_path, shard):
                a, b = np.searchsorted(number, (base, base + len(least)))
                at = np.full(len(least), -1)
                at[number[a:b].astype(np.int64) - base] = np.arange(a, b)
                base += len(least)
                own = np.flatnonzero((at[which] >= 0) & (doc == least[which]))
                if not len(own):
                    continue
                asked, raw = at[which[own]], data.tobytes()
                spans = [raw[x:y] for x, y in zip(first[own].tolist(), (last[own] + LENGTH).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[asked]), pa.array(count[asked].astype(np.int64)), pa.array(np.full(len(own), shard, np.int32)), pa.array(doc[own]), pa.array(position + first[own]), pa.array(offset[own]), pa.array(spans, pa.binary())],
                    ["anchor", "contexts", "shard", "doc", "first", "offset", "span"],
                )


def _compare(batches: Iterator) -> Iterator:
    """Contexts sorted by anchor -> for each shard the covered ranges, as pairs of positions."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 20_000:
            rows = pa.Table.from_batches(held).combine_chunks()
            anchor = rows.column(0).to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            yield from _covered(pa, rows.slice(0, whole))
            held, size = rows.slice(whole).to_batches(), size - whole
    if size:
        yield from _covered(pa, pa.Table.from_batches(held))


def _covered(pa, rows) -> Iterator:
    if not rows.num_rows:
        return
    anchor, shard, doc, begin, offset = (rows.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
    spans = rows.column(6).to_pylist()
    sizes = np.array([len(x) for x in spans])
    begins = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    context = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    # equal windows have the anchor at the same place, so a segment is an anchor and a place
    segment = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))[context] * (LENGTH + 1) + (offset[context] - inner)
    order = np.argsort(segment, kind="stable")
    moved, same = _sorted(np.frombuffer(b"".join(spans), np.uint8), (begins[context] + inner)[order], segment[order], LENGTH)
    twice = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
    if not len(twice):
        return
    own, new = order[moved[twice]], np.flatnonzero(~same[twice])
    docs = doc[context[own]]
    least = np.repeat(np.minimum.reduceat(docs, new), np.diff(np.concatenate([new, [len(own)]])))
    w = np.sort(own[docs > least])
    if not len(w):
        return
    cuts = np.concatenate([[True], (w[1:] != w[:-1] + 1) | (context[w[1:]] != context[w[:-1]])])
    from_, to = w[cuts], w[np.concatenate([np.flatnonzero(cuts)[1:], [len(w)]]) - 1]
    c = context[from_]
    yield from _ranges(pa, shard[c], begin[c] + inner[from_], begin[c] + inner[to] + LENGTH)


def _ranges(pa, shard, x, y) -> Iterator:
    order = np.argsort(shard, kind="stable")
    shard, pairs = shard[order], np.stack([x, y], 1)[order].astype(np.int64)
    own = np.unique(shard)
    cuts = [*np.searchsorted(shard, own).tolist(), len(shard)]
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["shard", "ranges"])


def _windows(batches: Iterator) -> Iterator:
    """Contexts -> two independent hashes, document, shard and position of each of their windows."""
    import pyarrow as pa

    for batch in batches:
        for shard, doc, first, span in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 6)), strict=True):
            h = [int.from_bytes(hashlib.blake2b(span[i : i + LENGTH], digest_size=16).digest(), "little") for i in range(len(span) - LENGTH + 1)]
            low = np.array([x & (2**64 - 1) for x in h], np.uint64).view(np.int64)
            high = np.array([x >> 64 for x in h], np.uint64).view(np.int64)
            n = len(h)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.full(n, doc)), pa.array(np.full(n, shard, np.int32)), pa.array(first + np.arange(n))], ["h1", "h2", "doc", "shard", "start"])


def _pack(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(1))
            yield from _ranges(pa, np.asarray(batch.column(0)), x, x + LENGTH)


def _kept(batches: Iterator, runs_path: str) -> Iterator:
    """Shards with the classes that earlier documents hold and covered ranges -> doc_id, text, what is kept of it and the removed counts."""
    import pyarrow as pa

    for batch in batches:
        for shard, path, late, ranges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            number = np.sort(_joined(late, np.uint32))
            pairs = _joined(ranges, np.int64).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0])]
            base = 0
            for position, ids, texts, starts, ends, data, (first, last, _, doc, which, least) in _known(path, runs_path, shard):
                a, b = np.searchsorted(number, (base, base + len(least)))
                elsewhere = np.zeros(len(least), bool)
                elsewhere[number[a:b].astype(np.int64) - base] = True
                base += len(least)
                covered = elsewhere[which] | (doc > least[which])
                n = len(data)
                c, d = np.searchsorted(pairs[:, 0], (position, position + n))
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, np.concatenate([first[covered], pairs[c:d, 0] - position]), 1)
                np.add.at(edge, np.concatenate([last[covered] + LENGTH, pairs[c:d, 1] - position]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                # a removed run starts where the byte before isn't removed, or at a document's start
                begin = gone & ~np.concatenate([[False], gone[:-1]])[:n]
                inner = starts[(starts < ends)]
                begin[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(begin)])
                rest = [t if removed[s] == removed[e] else data[s:e][~gone[s:e]].tobytes() for t, s, e in zip(texts, starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == NO_ID else i for i in ids], pa.int64()), pa.array(ends - starts), pa.array(removed[ends] - removed[starts]), pa.array(spans[ends] - spans[starts]), pa.array([hashlib.sha256(r).hexdigest() for r in rest]), pa.array(rest, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every document."""
    spark = docs.sparkSession
    path, kept = fresh_path(spark, "texts"), fresh_path(spark, "runs")
    text = F.encode(F.col(text_col), "UTF-8")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("size")).write.option("compression", "zstd").parquet(path)
    written = spark.read.schema("doc_id long, text binary, size long").parquet(path)
    parts, paths = partitions(spark), sorted(written.inputFiles())
    ranges, n = max(parts, -(-(written.agg(F.sum("size")).first()[0] or 0) // RANGE)), max(1, len(paths))
    shards = spark.createDataFrame(list(enumerate(paths)), "shard int, path string").repartition(n, "shard")
    sent = shards.mapInArrow(partial(_send, ranges=ranges, runs_path=kept), "part int, shard int, grams binary, contexts binary, numbers binary, which binary, docs binary")
    judged = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_judge, "shard int, late binary, compare binary, anchors binary, contexts binary")
    flags = cut(judged.groupBy("shard").agg(*[F.collect_list(c).alias(c) for c in ("late", "compare", "anchors", "contexts")]), "flags")
    one = lambda df: shards.join(df, "shard", "left").repartition(n, "shard")
    spans = one(flags.filter("exists(compare, x -> octet_length(x) > 0)").select("shard", "compare", "anchors", "contexts")).select("shard", "path", "compare", "anchors", "contexts")
    spans = spans.filter("compare is not null").mapInArrow(partial(_contexts, runs_path=kept), "anchor long, contexts long, shard int, doc long, first long, offset long, span binary")
    spans = cut(spans, "spans")
    near = spans.filter(F.col("contexts") <= most_contexts).repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = near.mapInArrow(_compare, "shard int, ranges binary")
    hot = spans.filter(F.col("contexts") > most_contexts).mapInArrow(_windows, "h1 long, h2 long, doc long, shard int, start long")
    least = hot.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    late = hot.join(least, ["h1", "h2"]).filter("doc > least").select("shard", "start")
    found = found.union(late.mapInArrow(_pack, "shard int, ranges binary"))
    ranges_ = cut(found.groupBy("shard").agg(F.collect_list("ranges").alias("ranges")), "ranges")
    last = one(flags.select("shard", "late").join(ranges_, "shard", "full")).select("shard", "path", "late", "ranges")
    return last.mapInArrow(partial(_kept, runs_path=kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")
