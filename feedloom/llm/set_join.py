"""N-gram Jaccard join: exact self-join of shingle sets, and its connected components.

Sets are distinct shingles of 4 words, or as many as asked for, as 64-bit hashes. Two sets link when their Jaccard
similarity reaches the threshold. The work is dealt out in these steps:

1. Equal sets become one class, so copies cost one set, however many there are.
2. Every set is put into one global order of its elements: those of a hash region (REGION of
   all hashes) by how many sets hold them, then the rest by hash. Two linked sets share
   an element among the first |x| - ceil(t |x|) + 1 of each, and the smaller one has it among its first
   |x| - ceil(2t / (1 + t) |x|) + 1 (prefix filter). Counting sends packed arrays of
   hashes to hash ranges; only elements that two or more sets hold come back, and a set
   with too few of those has no partner and leaves.
3. An index list (an element and the sets with it in their prefix) is cut into blocks by size. A block holds
   the sets that can be the smaller of a pair (lower ones) and those that can be the larger; sets that no lower one of the
   block can reach by size, or by the position of the element in them, are skipped.
4. Each block is a star: its members are compared with one of its lower sets, the least edited one, whose answer is
   computed in full; each member is kept as its difference from that centre. The centre is sent once a star, or once a part of a
   large star, never once a pair.
5. Members that link to the centre share its component and need nothing more. The others' answers
   are derived from the centre's: overlaps follow from the differences, through index lists of the differences whose members stand by
   size, so that the part of a list that can't reach the threshold is skipped by position. Only links that join two
   components are given out, so a group of thousands of near copies costs a row a member, not all pairs.
6. Components come from repeated minimum labels over the links.

Memory a task doesn't follow the input: hash ranges are as many as keep ELEMENTS elements in one, a task reads its
ranges one after the other in sorted order, and a star of over PART members is dealt out in parts of MEMBERS at most.

Truncated hashes in the counting step can only add candidates. Shingle hashes have 64 bits; at
n distinct shingles the chance of any collision is n^2 / 2^65.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a
text of fewer words than a shingle is one shingle; equal texts link (similarity 1); rows with
equal doc_id are one document each and give a row each; rows with a null doc_id link like others and take the
least doc_id of their component, which is null if none of its rows has one; very long texts are used whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, partitions, tidy

#: Fixed values of the contract.
SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
#: The part of the hash space whose elements are counted.
REGION = 0.35
#: Bytes of a long text that are hashed at a time.
PIECE = 1_000_000
_BLANK = re.compile(rb"[ \t-\r]")
#: Counted elements of a hash range, which a task holds at a time.
ELEMENTS = 600_000
#: Bits of the filter that says which texts are read again: 8 MB, whatever the input. With very many
#: candidates it lets more texts through, which costs time and changes nothing.
FILTER = 1 << 26
#: Members of a star that are compared in one place; larger stars are dealt out in parts, then by pairs of parts.
MEMBERS = 4_000
#: A smaller star is dealt out too, in parts of about PART members, but in no more than PARTS, so that a member is sent to few places.
PART, PARTS = 250, 16
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base^0.. and base^-0.. modulo 2^64, kept from call to call."""
    have = cache.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        cache["p"] = have = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


_RANDOM = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text, A-Z lower-cased; long texts are hashed in pieces."""
    short = [t if len(t) <= 2 * PIECE else b"" for t in texts]
    return [s if t is x else _long(t, n) for t, x, s in zip(texts, short, _hashed(short, n), strict=True)]


def _long(text: bytes, n: int) -> np.ndarray:
    """Pieces end between words and start with the last n - 1 words of the one before."""
    found, lead, at = np.zeros(0, np.uint64), [], 0
    while at < len(text):
        end = m.start() if (m := _BLANK.search(text, at + PIECE)) else len(text)
        words = text[at:end].split()
        if len(lead) + len(words) >= n or not len(found) and end == len(text):
            found = np.union1d(found, _hashed([b" ".join([*lead, *words])], n)[0])
        lead, at = [*lead, *words][1 - n :] if n > 1 else [], end
    return found


def _hashed(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """All texts are hashed in one pass: words by prefix polynomial hashes, shingles from the words' hashes."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in texts]
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[:-1], out=prefix[1:])
    word = _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, bounds)
    gram = np.zeros(len(word), np.uint64)
    k = len(word) - n + 1
    if k > 0:
        acc = np.zeros(k, np.uint64)
        for i in range(n):
            acc = _mix(acc * _MULT + word[i : i + k] + np.uint64(i + 1))
        gram[:k] = acc
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            acc = np.array([b - a], np.uint64)
            for w in word[a:b]:
                acc = _mix(acc * _MULT + w)
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(size, num: int = NUMERATOR, den: int = DENOMINATOR):
    return size - (num * size + den - 1) // den + 1


def _slices(column, size: int = 1_000_000):
    """The binaries of a column in lists of about so many bytes: hashing holds some 60 bytes a byte."""
    part, n = [], 0
    for x in column:
        part.append(b"" if (v := x.as_py()) is None else v)
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _region() -> np.uint64:
    return np.uint64(int(REGION * 2**64))


def _key(s: np.ndarray) -> int | None:
    """One number for a whole set; None for the empty one."""
    if not len(s):
        return None
    x = np.bitwise_xor.reduce(_mix(s + _MULT), keepdims=True) + np.add.reduce(_mix(s ^ _BASE), keepdims=True) * _MULT
    return int(_mix(x + np.uint64(len(s))).view(np.int64)[0])


def _set_rows(batches: Iterator, num: int, den: int, size: int) -> Iterator:
    """doc_id, place, text -> doc_id, place, n, key, inside (elements in the counted region) and beyond (the
    elements outside it that the prefix may need)."""
    import pyarrow as pa

    for batch in batches:
        at = 0
        for texts in _slices(batch.column(2)):
            sets = shingles(texts, size)
            inside = [int(np.searchsorted(s, _region())) for s in sets]
            beyond = [s[i : max(i, int(prefix_length(len(s), num, den)))].tobytes() if len(s) else b"" for s, i in zip(sets, inside, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64()), pa.array(inside, pa.int64()), pa.array(beyond, pa.binary())],
                ["doc_id", "place", "n", "key", "inside", "beyond"],
            )
            at += len(texts)


def _key_sets(batches: Iterator, wanted, size: int) -> Iterator:
    """bit, text -> key and hashes of the sets of the texts whose bit is wanted."""
    import pyarrow as pa

    bits = np.frombuffer(wanted.value, np.uint8)
    for batch in batches:
        bit = np.asarray(batch.column(0))
        own = batch.column(1).take(pa.array(np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)))
        for texts in _slices(own):
            got = [s for s in shingles(texts, size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["key", "hashes"])


def _filter(bits: DataFrame):
    """A broadcast bitmap of FILTER bits with those of bits (bit) set."""
    size = 1 << 15  # bits of a row of Spark's bitmap functions
    out = bytearray(FILTER // 8)
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    for r in rows.toLocalIterator():
        at = (r["n"] - 1) * size // 8
        out[at : at + size // 8] = r["map"]
    return bits.sparkSession.sparkContext.broadcast(bytes(out))


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) // ((_region() >> np.uint64(32)) + np.uint64(1))).astype(np.int64)


def _spread(batches: Iterator, ranges: int, words: int) -> Iterator:
    """text -> rows (part, hashes, owners, keys): the counted elements of many sets, sorted, by range.
    hashes are the upper 6 bytes; owners point into keys. Equal sets of a slice are sent once."""
    import pyarrow as pa

    held, size = {}, 0
    for batch in batches:
        for texts in _slices(batch.column(0)):
            for s in shingles(texts, words):
                if (k := _key(s)) is not None:
                    held[k] = s[: np.searchsorted(s, _region())].copy()
                    size += len(held[k])
            if size > 1_000_000 or len(held) > 40_000:
                yield from _packed(pa, held, ranges)
                held, size = {}, 0
    if held:
        yield from _packed(pa, held, ranges)


def _packed(pa, sets: dict[int, np.ndarray], ranges: int) -> Iterator:
    keys = np.array(list(sets), np.int64)
    for low in range(0, len(keys), 1 << 16):
        own = [sets[int(k)] for k in keys[low : low + (1 << 16)]]
        h, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(s) for s in own]).astype(np.uint16)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        cuts = np.searchsorted(_range_of(h, ranges), np.arange(ranges + 1))
        out: list[list] = [[], [], [], []]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                used, local = np.unique(owner[a:b], return_inverse=True)
                six = (h[a:b] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                for column, x in zip(out, (p, six.tobytes(), local.astype(np.uint16).tobytes(), keys[low:][used].tobytes()), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["part", "hashes", "owners", "keys"])


def _unpack(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _by_first(batches: Iterator) -> Iterator[list[tuple]]:
    """Rows that are sorted by their first column, in groups of equal values."""
    held: list[tuple] = []
    for batch in batches:
        for i, first in enumerate(batch.column(0).to_pylist()):
            if held and first != held[0][0]:
                yield held
                held = []
            held.append((first, *[c[i].as_py() for c in batch.columns[1:]]))
    if held:
        yield held


def _shared(batches: Iterator, buckets: int) -> Iterator:
    """The rows of hash ranges, sorted by range -> for each bucket of sets the (set, element, count) of elements that two
    or more sets hold."""
    import pyarrow as pa

    for rows in _by_first(batches):
        h = np.concatenate([_unpack(r[1]) for r in rows])
        o = np.concatenate([np.frombuffer(r[3], np.int64)[np.frombuffer(r[2], np.uint16)] for r in rows])
        del rows
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        twice = h[1:] == h[:-1]
        keep = np.concatenate([[False], twice]) | np.concatenate([twice, [False]])
        h, o = h[keep], o[keep]
        order = np.lexsort((o, h))
        h, o = h[order], o[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])[: len(h)]  # equal sets came from several tasks
        h, o = h[fresh], o[fresh]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        count = np.diff(np.concatenate([new, [len(h)]]))
        count = np.repeat(count, count)
        keep = count > 1
        if not keep.any():
            continue
        h, o, count = h[keep], o[keep], count[keep]
        bucket = (_mix(o.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((o, bucket))
        bucket, table = bucket[order], np.stack([o[order], h[order].view(np.int64), count[order].astype(np.int64)], 1)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([table[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "rows"])


def _merged(batches: Iterator) -> Iterator:
    """Buckets of sets, sorted by bucket -> key and (element, count) pairs of each set, one row a set."""
    import pyarrow as pa

    for group in _by_first(batches):
        rows = np.concatenate([np.frombuffer(r[1], np.int64).reshape(-1, 3) for r in group])
        del group
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]]))
        pairs = np.ascontiguousarray(rows[:, 1:])
        for at in range(0, len(cuts) - 1, 4096):
            own = cuts[at : at + 4097]
            yield pa.RecordBatch.from_arrays([pa.array(rows[own[:-1], 0]), pa.array([pairs[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())], ["key", "pairs"])


def _prefixes(batches: Iterator, num: int, den: int) -> Iterator:
    """key, n, inside, beyond, pairs (of all ranges) -> one row for each element of the prefix that
    other sets may have in theirs, with its position and the number of counted elements that no other set holds."""
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for key, n, inside, beyond, blobs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            pairs = np.frombuffer(blobs or b"", np.int64).reshape(-1, 2)
            alone, p = inside - len(pairs), int(prefix_length(n, num, den))
            take = np.lexsort((pairs[:, 0], pairs[:, 1]))[: max(0, p - alone)]
            rest = np.frombuffer(beyond, np.int64)[: max(0, p - inside)]
            # elements of the region have 6 bytes, so they can't be taken for others
            out[0] += [key] * (len(take) + len(rest))
            out[1] += pairs[take, 0].tolist() + rest.tolist()
            out[2] += [n] * (len(take) + len(rest))
            out[3] += [*range(alone, alone + len(take)), *range(inside, inside + len(rest))]
            out[4] += [alone] * (len(take) + len(rest))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "element", "n", "position", "alone"])


def stars(lists: DataFrame, num: int, den: int) -> DataFrame:
    """key, element, n, position, alone -> pairs (a, b, low) of a centre and a member. low: b can be the smaller of a pair in
    some block of that centre."""
    step = 1.0001 * math.log(den / num) if num < den else 1.0  # a pair's sizes are in one band or in neighbouring ones
    n, p = F.col("n"), F.col("position")
    low = p < n - F.ceil(2 * num * n / F.lit(num + den)) + 1
    rows = lists.select("key", "element", "n", "position", "alone", low.alias("low"), F.floor(F.log(n.cast("double")) / step).alias("band"))
    rows = rows.select("key", "element", "n", "position", "alone", F.explode(F.array(F.struct("band", "low"), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("low")))).alias("x"))
    rows = rows.select("key", "element", "n", "position", "alone", "x.band", "x.low")
    lower = lambda x: F.when(F.col("low"), x)
    blocks = rows.groupBy("element", "band").agg(
        F.min(lower(F.struct((F.col("alone") / n).alias("own"), "key"))).alias("centre"), F.min(lower(n)).alias("least"), F.max(lower(n)).alias("most"), F.count("*").alias("members")
    )
    blocks = blocks.filter("members > 1 and centre is not null").select("element", "band", F.col("centre.key").alias("a"), "least", "most")
    met = rows.join(blocks, ["element", "band"]).filter(F.col("key") != F.col("a"))
    met = met.filter((n >= F.col("least")) & (num * n <= den * F.col("most")) & ((n - p) * (num + den) >= num * (n + F.col("least"))))
    return met.groupBy("a", F.col("key").alias("b")).agg(F.max("low").alias("low"))


def _difference(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What t lacks of s, and what it adds."""
    there = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s
    return s[~there], t[s[np.minimum(np.searchsorted(s, t), len(s) - 1)] != t]


class _Star:
    """Members of a star as their differences from the centre."""

    def __init__(self, centre: int, num: int, den: int):
        self.centre, self.num, self.den = centre, num, den
        self.keys: list[int] = []
        self.lacks: list[int] = []
        self.diffs: list[np.ndarray] = []
        self.low: list[bool] = []
        self.linked: list[bool] = []
        self.side: list[int] = []

    def add(self, key: int, low: bool, lacks: int, difference: np.ndarray, side: int = 0) -> None:
        n = self.centre - lacks + len(difference) - lacks
        common = self.centre - lacks
        self.keys.append(key)
        self.low.append(low)
        self.lacks.append(lacks)
        self.diffs.append(difference)
        self.side.append(side)
        self.linked.append(self.den * common >= self.num * (self.centre + n - common))

    def links(self, between: bool = False) -> list[tuple[int, int]]:
        """Links of members that don't link to the centre, as few as join what links. The overlap of two members follows
        from their differences: |c| - lacks x - lacks y + what the differences share. between: only links of two sides."""
        if all(self.linked) or not any(self.low) or len(self.keys) < 2:
            return []
        num, den, m = self.num, self.den, len(self.keys)
        sizes = np.array([len(d) for d in self.diffs])
        lacks = np.array(self.lacks)
        by_size = np.lexsort((np.array(self.keys), self.centre - 2 * lacks + sizes))
        keys, lacks, sizes = np.array(self.keys)[by_size], lacks[by_size], sizes[by_size]
        low, linked, side = (np.array(x)[by_size] for x in (self.low, self.linked, self.side))
        n = self.centre - 2 * lacks + sizes
        flat, owner = np.concatenate([self.diffs[i] for i in by_size]), np.repeat(np.arange(m), sizes)
        _, token = np.unique(flat, return_inverse=True)
        posts = np.sort(token * m + owner)  # the index lists, one after the other, members by size
        begins = np.cumsum(sizes) - sizes
        root = np.where(linked, -1, np.arange(m))  # -1: with the centre
        out = []
        for x in np.flatnonzero(~linked):
            first, last = np.searchsorted(n, -(-num * n[x] // den)), np.searchsorted(n, den * n[x] // num, side="right")
            own = token[begins[x] : begins[x] + sizes[x]] * m
            a, b = np.searchsorted(posts, own + first), np.searchsorted(posts, own + last)
            length = b - a
            at = np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())
            y = np.arange(first, last)
            shared = np.bincount(posts[at] % m - first, minlength=len(y))
            common = self.centre - lacks[x] - lacks[y] + shared
            hit = (den * common >= num * (n[x] + n[y] - common)) & (y != x) & (low[y] | low[x])
            if between:
                hit &= side[y] != side[x]
            y = y[hit]
            _, firsts = np.unique(root[y], return_index=True)
            for other in y[firsts]:
                if root[other] != root[x]:
                    out.append((int(keys[x]), int(keys[other])))
                    root[root == max(root[x], root[other])] = min(root[x], root[other])
        return out


STAR = "a long, b long, linked boolean, low boolean, centre long, lacks long, difference binary"


def _star_rows(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "linked", "low", "centre", "lacks", "difference"])


def _compared(batches: Iterator, num: int, den: int) -> Iterator:
    """Stars, or parts of them, sorted with the centre first: a, part, parts, member, key, low, hashes -> the links of a whole
    star; of a part the links to the centre and all members' differences."""
    at, whole, c, star = None, True, None, None

    def done():
        rows = [(at[0], k, True, low, None, None, None) if whole else (at[0], k, linked, low, star.centre, lacks, d.tobytes()) for k, low, linked, lacks, d in zip(star.keys, star.low, star.linked, star.lacks, star.diffs, strict=True) if linked or not whole]
        if whole:
            rows += [(min(x), max(x), True, None, None, None, None) for x in star.links()]
        return _star_rows(rows)

    for batch in batches:
        sets = batch.column(6)
        for i, (a, part, parts, member, key, low) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True)):
            own = np.frombuffer(sets[i].as_buffer(), np.uint64)
            if (a, part) != at:
                if star is not None:
                    yield done()
                at, whole, c, star = (a, part), parts == 1, own.copy(), _Star(len(own), num, den)
            if member:
                lacks, adds = _difference(c, own)
                star.add(key, low, len(lacks), np.concatenate([lacks, adds]))
    if star is not None:
        yield done()


def _within(batches: Iterator, num: int, den: int) -> Iterator:
    """Pairs of parts of large stars: a, lo, hi, b, low, centre, lacks, difference, side -> links of their members."""
    at, star = None, None

    def done():
        return _star_rows([(min(x), max(x), True, None, None, None, None) for x in star.links(between=at[1] != at[2])])

    for batch in batches:
        for a, lo, hi, b, low, centre, lacks, difference, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, lo, hi) != at:
                if star is not None:
                    yield done()
                at, star = (a, lo, hi), _Star(centre, num, den)
            star.add(b, low, lacks, np.frombuffer(difference, np.uint64), side)
    if star is not None:
        yield done()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of edges (a, b), by alternating
    large-star and small-star steps, each round written to the shared folder."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node point to the least of its neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u <> v")
        # small star: a node and its neighbours below point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(e.select("v", "v").distinct())


def _parts(n: Column) -> Column:
    """Into how many parts a star of n members is dealt."""
    return F.greatest(F.ceil(n / MEMBERS), F.least(F.lit(PARTS), F.ceil(n / PART))).cast("int")


def similar_components(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    text, doc_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    # where a text is found again: by its doc_id, or without one by its hash
    place = F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.xxhash64(text)).alias("at"))
    docs = docs.select(doc_id.alias("doc_id"), place.alias("place"), F.encode(text, "UTF-8").alias("text"))
    bound = {"num": num, "den": den}
    rows = cut(docs.mapInArrow(tidy(partial(_set_rows, **bound, size=shingle)), "doc_id long, place struct<none boolean, at long>, n long, key long, inside long, beyond binary"), "sets")
    parts = partitions(spark)
    ranges = max(parts, -(-(rows.agg(F.sum("inside")).first()[0] or 0) // ELEMENTS))
    sent = docs.select("text").mapInArrow(tidy(partial(_spread, ranges=ranges, words=shingle)), "part int, hashes binary, owners binary, keys binary")
    counted = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(partial(_shared, buckets=ranges)), "bucket int, rows binary")
    shared = counted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_merged), "key long, pairs binary")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.first("n").alias("n"), F.first("inside").alias("inside"), F.first("beyond").alias("beyond"))
    # a class without shared elements can only link by elements outside the region
    wanted = classes.join(shared, "key", "left").filter("pairs is not null or octet_length(beyond) > 0").select("key", "n", "inside", "beyond", "pairs")
    lists = cut(wanted.mapInArrow(tidy(partial(_prefixes, **bound)), "key long, element long, n long, position long, alone long"), "lists")
    pairs = cut(stars(lists, num, den), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "place"), "key")
    bit = F.pmod(F.xxhash64("place"), F.lit(FILTER))
    wanted = _filter(named.select((bit + 1).alias("bit")))  # Spark counts bits from 1
    # only the sets of candidates are sent; of texts that share a bit or a doc_id, those that no star asks for fall out in the join
    sets = docs.select(bit.alias("bit"), "text").mapInArrow(tidy(partial(_key_sets, wanted=wanted, size=shingle)), "key long, hashes binary").dropDuplicates(["key"])
    # a star goes to one place, or its parts to several, with the centre in each
    dealt = pairs.join(pairs.groupBy("a").agg(_parts(F.count("*")).alias("parts")), "a")
    members = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "parts", F.lit(True).alias("member"), F.col("b").alias("key"), "low")
    centres = dealt.select("a", "parts").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(False).alias("member"), F.col("a").alias("key"), F.lit(True).alias("low"))
    both = members.union(centres).join(sets, "key").select("a", "part", "parts", "member", "key", "low", "hashes")
    both = both.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "member")
    found = cut(both.mapInArrow(tidy(partial(_compared, **bound)), STAR), "stars")
    # large stars with members that don't link to the centre are looked at once more, by pairs of parts
    large = found.filter("difference is not null")
    opened = large.groupBy("a").agg(_parts(F.count("*")).alias("parts"), F.count_if(~F.col("linked")).alias("open"), F.count_if("low").alias("lows")).filter("open > 0 and lows > 0")
    again = large.join(opened, "a").withColumn("side", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    again = again.select("a", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "b", "low", "centre", "lacks", "difference", "side")
    more = again.repartition(parts, "a", "lo", "hi").sortWithinPartitions("a", "lo", "hi").mapInArrow(tidy(partial(_within, **bound)), STAR)
    links = found.filter("linked").select("a", "b").union(more.select("a", "b"))
    final = components(links).withColumnRenamed("node", "key")
    merged = classes.select("key", "least").join(final, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = merged.join(least, "component").select("key", "component_id")
    return rows.select("doc_id", "n", "key").join(ids, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))
