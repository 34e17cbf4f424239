"""Texts as chunks that a byte-level BPE with the usual pre-split never merges across.

The pre-split pattern starts a new piece at every space that is followed by other than
white space, and at every newline between two non-spaces. Splitting there gives chunks
that recur, so each worker encodes a distinct chunk once and a document becomes a join
of cached pieces. The distinct chunks of a slice of texts are found by Arrow, so that Python handles each once a slice. Texts with other runs of white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Cached chunks a task, about 150 bytes each; what doesn't fit is encoded again where it recurs.
CACHE = 600_000
#: Bytes of texts handled at a time, so that a worker's memory doesn't follow the batch size.
SLICE = 4_000_000
#: Fixed value: the pre-split makes a piece of one of these at the end of a chunk, behind a letter.
MARKS = frozenset(",.;:!?")


def regular(chunk: str) -> bool:
    """True if the chunk's pieces don't depend on what stands before it."""
    if not chunk:
        return False
    if chunk[0] == "\n":
        return len(chunk) > 1 and not chunk[1].isspace()
    return not chunk[0].isspace()


def marked(chunk: str) -> bool:
    """True if the chunk is another one with a mark behind its last letter."""
    return chunk[-1:] in MARKS and (x := chunk[-2:-1]).isascii() and x.isalpha()


class Encoder:
    """encode_many: texts to ids, each text by itself. ids are stored with dtype. Chunks that hold a string of apart are
    never cut further."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable], dtype: str = "<u2", cache: int = CACHE, apart: Iterable[str] = ()):
        self.encode_many, self.dtype, self.size, self.apart = encode_many, dtype, cache, list(apart)
        self.marks: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        """At the end of a task, so that a worker that waits holds no more than when it started."""
        self.first: dict[str, bytes] = {"": b""}
        self.later: dict[str, bytes] = {}

    def _stored(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as they are stored; encode_many may give them so."""
        return [i if isinstance(i, bytes) else np.asarray(i, self.dtype).tobytes() for i in self.encode_many(texts)] if texts else []

    def _firsts(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that texts begin with."""
        missing = list({c for c in chunks if c not in self.first})
        fresh = dict(zip(missing, self._stored(missing), strict=True))
        if len(self.first) < self.size:
            self.first |= fresh
            return self.first
        return {c: fresh[c] if c in fresh else self.first[c] for c in chunks}

    def _laters(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks behind a space or a newline that aren't cached. One with a mark at its end is the chunk before the
        mark, which recurs more, and the mark."""
        if not self.marks:
            self.marks = dict(zip(sorted(MARKS), self._stored(sorted(MARKS)), strict=True))
        joined = "\n".join(missing) if self.apart else ""
        apart = [x for x in self.apart if x in joined]
        ends = [c for c in missing if marked(c) and not any(x in c for x in apart)]
        plain = set(missing).difference(ends)
        plain.update(b for c in ends if (b := c[:-1]) not in self.later)
        todo = list(plain)
        fresh = dict(zip(todo, self._stored([c if c[0] == "\n" else " " + c for c in todo]), strict=True))
        for c in ends:
            base = c[:-1]
            fresh[c] = (fresh.get(base) or self.later[base]) + self.marks[c[-1]]
        if len(self.later) < self.size:
            self.later |= fresh
        return fresh

    def coded(self, texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of an Arrow array of texts: ids of its distinct chunks, for each chunk of the texts in order which of them
        it has, and where the chunks of each text begin and end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        distinct = split.values.dictionary_encode()
        names, codes = distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy().astype(np.int64)
        starts = bounds[:-1]
        behind = np.ones(len(codes), bool)
        behind[starts] = False
        used = np.zeros(len(names), bool)
        used[codes[behind]] = True

        get = self.later.get
        values = [get(c) if u else b"" for c, u in zip(names, used.tolist(), strict=True)]
        missing = [i for i, v in enumerate(values) if v is None]
        odd = np.zeros(len(names), bool)
        odd[[i for i in missing if not regular(names[i])]] = True
        fresh = self._laters([names[i] for i in missing if not odd[i]])
        for i in missing:
            values[i] = fresh.get(names[i], b"")

        heads = [names[i] for i in codes[starts].tolist()]
        first = self._firsts(heads)
        codes[starts] = len(values) + np.arange(len(heads))
        whole = np.unique(np.searchsorted(bounds, np.flatnonzero(behind & odd[np.where(behind, codes, 0)]), "right") - 1).tolist() if odd.any() else []
        values += [first[c] for c in heads]
        values.append(b"")
        for i, ids in zip(whole, self._stored([texts[i].as_py() for i in whole]), strict=True):
            codes[bounds[i] : bounds[i + 1]] = len(names) + len(heads)
            codes[bounds[i]] = len(values)
            values.append(ids)
        return values, codes, bounds

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its chunks, in order."""
        import pyarrow as pa

        if not len(texts):
            return []
        values, codes, bounds = self.coded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return [[values[k] for k in codes[a:b].tolist()] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def gathered(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values that codes name one after another, and where those of each text begin and end."""
    import pyarrow as pa

    taken = pa.array(values, pa.large_binary()).take(pa.array(codes))
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][: len(codes) + 1]
    return memoryview(taken.buffers()[2] or b"")[at[0] : at[-1]], at[bounds] - at[0]


def slices(column, size: int = SLICE):
    """An Arrow column of texts in arrays of about so many bytes, null as ''."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(column, "")
    if not len(texts):
        return
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(low, high - low)
