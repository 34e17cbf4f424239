"""Byte-level BPE encoding and decoding with recursive DuckDB queries per partition.

The rank file becomes a merge table (pair of tokens, rank of the merged one). In a task, the
distinct pieces not seen before become words of tokens, a character each. A recursive
query turns every word into token-position rows, joins neighbouring rows with the merge table and contracts, in each
word, the leftmost pair of minimum rank, until no pair is left. Decoding joins ids with the vocabulary and aggregates
the bytes in position order, GROUP tokens at a time. A task keeps the ids of chunks it has met, so a document
costs one lookup a chunk; the cache is bounded and dropped, with the merge table, at the end of the task if asked for. The rank file
(bounded by the vocabulary) is read on the driver and broadcast.

Pieces of any length go this way. Two facts keep the rounds of long ones few, and change no result:

* no merge crosses two neighbouring bytes that stand beside each other in no token, so a piece is cut there into words;
* a round contracts all occurrences of the pair of minimum rank at a time, from the left, if no token that
  holds the merged one has a lower rank, since then no pair that arises comes before the next occurrence. Else it contracts the leftmost alone.

Defined cases: null and empty texts have no tokens; repeated rows are encoded alike; very
long texts are used whole; an empty table gives no rows; extra columns are ignored unless
asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import chunks
from .common import documents, give_back

#: Bytes of words that one recursive query works on, to bound its memory.
BYTES = 100_000
#: Characters handled at a time, cached chunks and rows of an Arrow batch where memory is to be left to others: a worker takes about half as much.
LEAN_SLICE, LEAN_CACHE, LEAN_ROWS = 250_000, 100_000, 1_000
#: Tokens whose bytes one group of the decoding query puts in order.
GROUP = 1024
#: Token 0 as a character: the planes from there on hold no surrogates.
ZERO = 0x20000

#: Tokens of a word and its neighbouring pairs: taken out one by one, which suits short words, or from a list, whose time grows with the word alone.
PAIRS = "select w, s, p, substring(s, p, 2) as pair from (select w, s, unnest(range(1, length(s))) as p from st where length(s) > 1)"
PAIRS_OF_LONG = """select w, s, unnest(range(1, len(c))) as p, unnest(c[:-2]) || unnest(c[2:]) as pair
          from (select w, s, string_split(s, '') as c from st where length(s) > 1)"""
#: Bytes from which a word is long.
LONG = 48
ENCODE = f"""
with recursive st(w, s) using key (w) as (
  select w, s from seed
  union
  select w, case when k & 1 = 1 then s[:(k >> 1 & 2147483647) - 1] || chr((k >> 32)::integer + {ZERO}) || s[(k >> 1 & 2147483647) + 2:]
    else replace(s, s[(k >> 1 & 2147483647):(k >> 1 & 2147483647) + 1], chr((k >> 32)::integer + {ZERO})) end
  from (
    select w, any_value(s) as s, min((m.merged::bigint << 32) | (p << 1) | m.alone) as k
    from ({{pairs}}) x
    join merges m using (pair)
    group by w))
select s from st order by w
"""
DECODE = """
select x.part, string_agg(v.bytes, '' order by x.place) as bytes
from toks x join vocab v on v.id = x.id
group by x.part order by x.part
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Bpe:
    """Encoding and decoding of pieces with the ranks of one file, in one process."""

    def __init__(self, data: bytes, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex

        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.byte = {b: chr(self.ranks[bytes([b])] + ZERO) for b in range(256)}
        ranks = self.ranks
        pairs = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        low = {x for a, b, r in pairs for x in (a, b) if x > r}  # tokens that are part of one of lower rank
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "128MB"})
        self.con.register("m", pa.table({"pair": [chr(a + ZERO) + chr(b + ZERO) for a, b, _ in pairs], "merged": pa.array([r for *_, r in pairs], pa.int32()), "alone": pa.array([int(r in low) for *_, r in pairs], pa.int64())}))
        self.con.register("v", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [b.decode("latin-1") for b in ranks]}))
        self.con.execute("create table merges as select * from m; create table vocab as select * from v")
        flat = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int64)
        last = np.cumsum([len(b) for b in ranks])[:-1] - 1
        beside = np.delete(flat[:-1] * 256 + flat[1:], last)
        self.beside = np.bincount(beside, minlength=1 << 16) > 0
        self.encoder = chunks.Encoder(self.encode_chunks, "<u4" if max(ranks.values()) > 65535 else "<u2")
        #: The tokens themselves, as stored ids.
        self.stored = {b: np.array([r], self.encoder.dtype).tobytes() for b, r in ranks.items()}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(b) for b in ranks]
        self.decoded: dict[bytes, bytes] = {}
        self.keep = chunks.CACHE

    def clear(self) -> None:
        self.encoder.clear()
        self.decoded = {}

    def lean(self) -> None:
        """Small caches from now on; what building the tables took goes back to the system."""
        self.encoder.size = self.keep = LEAN_CACHE
        give_back()

    def words(self, pieces: list[bytes]) -> list[list[bytes]]:
        """Pieces, cut where no merge can cross."""
        import numpy as np

        out = [[p] for p in pieces]
        if not pieces:
            return out
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum([len(p) for p in pieces])
        apart = ~self.beside[flat[:-1] * 256 + flat[1:]]
        apart[ends[:-1] - 1] = False
        cuts = np.flatnonzero(apart) + 1
        owner = np.searchsorted(ends, cuts, side="right")
        for i, own in zip(np.unique(owner).tolist(), np.split(cuts, np.flatnonzero(np.diff(owner)) + 1), strict=True) if len(cuts) else ():
            p = pieces[i]
            at = [0, *(own - (ends[i] - len(p))).tolist(), len(p)]
            out[i] = [p[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def contract(self, words: list[bytes]) -> list[bytes]:
        """ids, as they are stored, of words, each merged by itself."""
        import numpy as np
        import pyarrow as pa

        out: list[bytes] = []
        if not words:
            return out
        ends = np.cumsum([len(w) for w in words])
        cuts = [0, *(np.flatnonzero(np.diff(ends // BYTES)) + 1).tolist(), len(words)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            seed = [w.decode("latin-1").translate(self.byte) for w in words[low:high]]
            self.con.register("seed", pa.table({"w": np.arange(len(seed), dtype="i4"), "s": seed}))
            done = self.con.sql(ENCODE.format(pairs=PAIRS if max(map(len, seed)) < LONG else PAIRS_OF_LONG)).to_arrow_table()["s"].to_pylist()
            ids = (np.frombuffer("".join(done).encode("utf-32-le"), "<u4") - np.uint32(ZERO)).astype(self.encoder.dtype).tobytes()
            at = (np.concatenate([[0], np.cumsum([len(s) for s in done])]) * np.dtype(self.encoder.dtype).itemsize).tolist()
            out += [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The stored ids of each piece."""
        known, out, names, raw = self.stored, {}, [], []
        for p in pieces:
            b = p.encode()
            if (k := known.get(b)) is not None:
                out[p] = k
            else:
                names.append(p)
                raw.append(b)
        split = self.words(raw)
        todo = sorted({w for ws in split for w in ws if w not in known}, key=len)  # those of a query take about as many rounds
        ids = dict(zip(todo, self.contract(todo), strict=True))
        for p, ws in zip(names, split, strict=True):
            out[p] = ids[ws[0]] if len(ws) == 1 else b"".join([ids.get(w) or known[w] for w in ws])
        return out

    def split(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text. Short chunks are split as the lines of one text: a newline before a space is a piece of its own."""
        find = self.pattern.findall
        out: list = [None] * len(texts)
        lines = [i for i, t in enumerate(texts) if t[:1] == " " and t.split() == [t[1:]]]
        pieces = find("\n".join([texts[i] for i in lines]))
        cuts = [k for k, p in enumerate(pieces) if p == "\n"]
        if len(cuts) == len(lines) - 1:
            for i, low, high in zip(lines, [0, *(k + 1 for k in cuts)], [*cuts, len(pieces)], strict=True):
                out[i] = pieces[low:high]
        return [find(t) if s is None else s for s, t in zip(out, texts, strict=True)]

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        split = self.split(texts)
        ids = self.encode_pieces(list({p for s in split for p in s}))
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[p] for p in s]) for s in split]

    def decode(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Bytes of runs of ids, which come as they are stored."""
        import numpy as np
        import pyarrow as pa

        missing = list({r for r in runs if r not in self.decoded and r})
        fresh = {b"": b""}
        if missing:
            ids = np.frombuffer(b"".join(missing), self.encoder.dtype).astype("i4")
            place = np.arange(len(ids), dtype="i4")
            self.con.register("toks", pa.table({"part": place // GROUP, "place": place, "id": ids}))
            whole = "".join(self.con.sql(DECODE).to_arrow_table()["bytes"].to_pylist()).encode("latin-1")
            ends = np.cumsum([len(r) for r in missing]) // np.dtype(self.encoder.dtype).itemsize
            at = [0, *np.cumsum(self.lengths[ids])[ends - 1].tolist()]
            fresh |= {r: whole[a:b] for r, a, b in zip(missing, at[:-1], at[1:], strict=True)}
        if len(self.decoded) < self.keep:
            self.decoded |= fresh
            return self.decoded
        return {r: self.decoded.get(r) or fresh[r] for r in set(runs)}


_OPEN: dict[tuple, Bpe] = {}


def opened(data: bytes, pattern: str) -> Bpe:
    """One Bpe a process: workers are used again, and so are their merge tables."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Bpe(data, pattern)
    return _OPEN[key]


def forget(bpe: Bpe) -> None:
    """Gives up what the process holds: caches, merge tables and the connection."""
    bpe.clear()
    _OPEN.clear()


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hold: bool = True) -> DataFrame:
    """id_col, the columns of keep, n_tokens, ids (binary, little-endian unsigned 32-bit) and
    decoded (binary) of every text. hold: whether a worker holds its bounded cache for its next task, which saves time; without
    it the cache and the slices are small, and the memory is free for other stages."""
    return _run(docs, rank_file, pattern, id_col, text_col, keep, digests=False, hold=hold)


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hold: bool = True) -> DataFrame:
    """As encode, with hex digests (ids_sha256, decoded_sha256) in place of the bytes."""
    return _run(docs, rank_file, pattern, id_col, text_col, keep, digests=True, hold=hold)


def _run(docs: DataFrame, rank_file: str, pattern: str, id_col: str, text_col: str, keep, digests: bool, hold: bool) -> DataFrame:
    from pyspark.sql import types as T

    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(id_col, *keep, docs[text_col].cast("string").alias("__text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = opened(shared.value, pattern)
        size = chunks.SLICE if hold else LEAN_SLICE
        if not hold:
            bpe.lean()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            at = 0
            for texts in chunks.slices(batch.column(len(kept)), size):
                values, codes, bounds = bpe.encoder.coded(texts)
                table = bpe.decode(values)
                n, ids, decoded = [], [], []
                x, xs = chunks.gathered(values, codes, bounds)
                width = np.dtype(bpe.encoder.dtype).itemsize
                x, xs = memoryview(np.frombuffer(x, bpe.encoder.dtype).astype("<u4").view(np.uint8)), (xs // width * 4).tolist()
                y, ys = chunks.gathered([table[r] for r in values], codes, bounds)
                for k, (a, b) in enumerate(zip(ys[:-1].tolist(), ys[1:].tolist(), strict=True)):
                    i, d = x[xs[k] : xs[k + 1]], y[a:b]
                    n.append(len(i) // 4)
                    ids.append(sha(i) if digests else bytes(i))
                    decoded.append(sha(d) if digests else bytes(d))
                cols = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))]
                kind = pa.string() if digests else pa.binary()
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], [*kept, "n_tokens", *names])
                at += len(texts)
        if not hold:
            forget(bpe)
            del bpe
            give_back()  # its parts refer to each other

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kind = T.StringType() if digests else T.BinaryType()
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), *[T.StructField(n, kind) for n in names]])
    return rows.mapInArrow(run, schema)


def multi_50k() -> tuple[str, str]:
    """(rank file, pattern) of the many-language vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *multi_50k())
