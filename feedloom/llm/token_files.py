"""Token ids as length-delimited binary records with a separate offset index.

A shard holds records in ascending doc_id order. A record is

    length (u64 LE) | masked checksum of length (u32) | payload | masked checksum of payload (u32)

with the CRC-32 of each part rotated right by 15 bits plus a constant, so that a checksum
of data that holds checksums stays useful. The payload is the ids of one document, as
unsigned 16-bit integers if the vocabulary allows it, else 32-bit. Beside a shard
`part-00012.rec` stands `part-00012.idx`: the width of an id (u32), the number of records (u32),
and for each record its doc_id (i64), offset (u64) and number of ids (u32), so that shuffled
reads can go to any record.

Shards are the partitions of a range partitioning by doc_id; a shard is written under a
temporary name and renamed when complete, so a task that runs again replaces its own work
and never leaves half a shard. Reading checks both checksums of each record.

Defined cases: a null or empty text holds the end id alone; equal doc_ids stay beside each
other; null doc_ids come first; very long texts are one record; an empty table writes no
records and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .common import documents, fresh_path, open_fs, partitions

#: Fixed value: added to the rotated checksum.
MASK = 0xA282EAD8
#: Stands for a null doc_id in the index.
NO_ID = -(1 << 63)
HEAD, INDEX = struct.Struct("<QI"), struct.Struct("<qQI")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of a whole record; ValueError if a checksum doesn't hold."""
    size, check = HEAD.unpack_from(record)
    payload = record[HEAD.size : HEAD.size + size]
    if check != masked(record[:8]) or len(record) != HEAD.size + size + 4:
        raise ValueError("damaged length")
    if struct.unpack_from("<I", record, HEAD.size + size)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


class Library:
    """Encoding with a tokenizers file, one a process."""

    _open: dict[str, Library] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # their strings in a text are encoded as the library does, each by itself
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.newline = self.encode(["\n"])[0]
        #: The model takes a piece by itself if the pre-split is the usual one and leaves its bytes alone.
        split = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        self.model = self.tokenizer.model if plain else None
        self.encoder = chunks.Encoder(self.encode_chunks, f"<u{self.width}", apart=self.special)

    @classmethod
    def opened(cls, path: str) -> Library:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, texts: list[str]) -> list[bytes | list[int]]:
        """A chunk of a space and letters is one piece, which the library's model encodes by itself. Other short chunks are encoded as the lines of one text: a newline before a
        chunk is a piece of its own, so the ids between newlines are the chunk's, cut out as they are stored."""
        import numpy as np

        out: list = [None] * len(texts)
        joined = "\n".join(texts)
        special = [x for x in self.special if x in joined]
        if self.model is not None:
            tokenize = self.model.tokenize
            # the byte-level alphabet writes ASCII letters as they are and a space as U+0120
            for i, t in enumerate(texts):
                if t[:1] == " " and t.isascii() and t[1:].isalpha() and not (special and any(x in t for x in special)):
                    out[i] = np.array([x.id for x in tokenize("\u0120" + t[1:])], f"<u{self.width}").tobytes()
        lines = [i for i, t in enumerate(texts) if out[i] is None and t[:1] == " " and len(t) < 100 and t.split() == [t[1:]] and not (special and any(x in t for x in special))]
        if len(self.newline) == 1:
            for at in range(0, len(lines), 2000):
                part = lines[at : at + 2000]
                ids = np.array(self.encode(["\n".join([texts[i] for i in part])])[0], f"<u{self.width}")
                cuts = (np.flatnonzero(ids == self.newline[0]) * self.width).tolist()
                if len(cuts) == len(part) - 1:
                    raw, low = ids.tobytes(), 0
                    for i, high in zip(part, [*cuts, len(raw)], strict=True):
                        out[i] = raw[low:high]
                        low = high + self.width
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.encode([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def _write_shard(batches: Iterator, tokenizer_file: str, path: str, end_id: int) -> Iterator:
    """One task: its texts, which are sorted, as one shard."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    library = Library.opened(tokenizer_file)
    end = np.array([end_id], f"<u{library.width}").tobytes()
    fs, root = open_fs(path)
    name, own = f"part-{context.partitionId():06d}", f"{root}/_{context.taskAttemptId()}"
    fs.create_dir(root, recursive=True)
    index, at, ids = [], 0, 0
    with fs.open_output_stream(f"{own}.rec") as out:
        for batch in batches:
            doc_ids, k = batch.column(0), 0
            for texts in chunks.slices(batch.column(1)):
                stored, bounds = chunks.gathered(*library.encoder.coded(texts))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    payload = b"".join((stored[a:b], end))
                    out.write(record := frame(payload))
                    d = doc_ids[k].as_py()
                    index.append(INDEX.pack(NO_ID if d is None else d, at, len(payload) // library.width))
                    at, k, ids = at + len(record), k + 1, ids + len(payload) // library.width
    with fs.open_output_stream(f"{own}.idx") as out:
        out.write(struct.pack("<II", library.width, len(index)) + b"".join(index))
    fs.move(f"{own}.rec", f"{root}/{name}.rec")
    fs.move(f"{own}.idx", f"{root}/{name}.idx")
    yield pa.RecordBatch.from_pydict({"shard": [name], "records": [len(index)], "ids": [ids]})


def write(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode and write all texts to shards below path; (shard, records, ids) of each shard in
    order. The list has one entry a shard, not a document."""
    spark = docs.sparkSession
    n = shards or partitions(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    done = rows.mapInArrow(partial(_write_shard, tokenizer_file=tokenizer_file, path=path, end_id=end_id), "shard string, records long, ids long").collect()
    return sorted((r["shard"], r["records"], r["ids"]) for r in done if r["records"])


def _read_shards(batches: Iterator, path: str) -> Iterator:
    """One task: the records of its shards, checked."""
    import numpy as np
    import pyarrow as pa

    fs, root = open_fs(path)
    for batch in batches:
        for row in batch.to_pylist():
            with fs.open_input_stream(f"{root}/{row['shard']}.idx") as f:
                index = f.read()
            width, n = struct.unpack_from("<II", index)
            start, out = row["first"], []
            with fs.open_input_stream(f"{root}/{row['shard']}.rec") as f:
                for doc_id, _, k in INDEX.iter_unpack(index[8:]):
                    ids = np.frombuffer(unframe(f.read(HEAD.size + k * width + 4)), f"<u{width}")
                    out.append((None if doc_id == NO_ID else doc_id, start, k, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += k
            if len(out) != n:
                raise ValueError(f"{row['shard']}: {len(out)} of {n} records")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens and ids_crc32 of every record, read
    from the files."""
    table = spark.createDataFrame(shards, "shard string, records long, ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    table = table.repartition(max(1, len(shards)), "shard")

    return table.mapInArrow(partial(_read_shards, path=path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def record_at(path: str, shard: str, n: int) -> list[int]:
    """The ids of the n-th record of a shard, by its offset: what a shuffled reader does."""
    import numpy as np

    fs, root = open_fs(path)
    with fs.open_input_file(f"{root}/{shard}.idx") as f:
        width = struct.unpack("<I", f.read(4))[0]
        f.seek(8 + n * INDEX.size)
        _, at, k = INDEX.unpack(f.read(INDEX.size))
    with fs.open_input_file(f"{root}/{shard}.rec") as f:
        f.seek(at)
        return np.frombuffer(unframe(f.read(HEAD.size + k * width + 4)), f"<u{width}").tolist()


def byte_50k() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    return read(spark, path, write(documents(spark, sf_dir), byte_50k(), path))
