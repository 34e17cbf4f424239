"""Landed pages as a data source: what a pull from a paged service has put down, a JSON file a page.

`landed_pages` reads a folder of page-<number>.json files, each a list of records, as a table or as a stream:

* batch: a partition is as many pages in a row as come to TASK_BYTES, of few pages one; option `first` and `last` bound them. Pages count from 1 without gaps, so a missing one is an error and
  not a hole in the data; a page that isn't a list of records is one too.
* stream: the offset is the number of the last page that was read, which Spark keeps in the checkpoint: after a restart no page is read
  twice and none is left out. A page that lands later is read once all before it are there.
* `newer(rows, ...)` keeps what changed since a stored mark; `Mark` stores it beside the data, so the next pull knows where to go on.

Records are parsed by the schema that the reader is given (.schema(...)); fields that a record lacks are null."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from feedloom.plans.registry import query
from feedloom.plans.storage import exists, fresh_path
from feedloom.sources.posts import Tables

_PAGE = re.compile(r"page-(\d+)\.json$")


def _store(path: str):
    """(filesystem, path) of a local, HDFS or object store folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: Bytes of pages that one task reads at most (a larger page is a task of its own), and tasks over which fewer bytes are spread.
TASK_BYTES, TASKS = 8_000_000, 64


class Pages(InputPartition):
    def __init__(self, pages: list[tuple[int, str]]):
        self.pages = pages


def _numbers(path: str) -> dict[int, tuple[str, int]]:
    """Path and size of each page."""
    from pyarrow import fs

    store, folder = _store(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {int(m[1]): (f.path, f.size) for f in found if (m := _PAGE.search(f.path))}


def _tasks(path: str, found: dict[int, tuple[str, int]], first: int, last: int) -> list[InputPartition]:
    """The pages from first to last, in order, dealt out to tasks."""
    missing = [n for n in range(first, last + 1) if n not in found]
    if missing:
        raise FileNotFoundError(f"pages {missing[:5]} of {path} are missing")
    out: list[InputPartition] = []
    pages: list[tuple[int, str]] = []
    held, most = 0, min(TASK_BYTES, sum(found[n][1] for n in range(first, last + 1)) // TASKS)
    for n in range(first, last + 1):
        file, size = found[n]
        if pages and held + size > most:
            out.append(Pages(pages))
            pages, held = [], 0
        pages.append((n, file))
        held += size
    return [*out, Pages(pages)] if pages else out


def _rows(path: str, pages: list[tuple[int, str]], schema: StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    store, _ = _store(path)
    names, kind = schema.fieldNames(), to_arrow_schema(schema)
    for number, file in pages:
        with store.open_input_file(file) as f:
            records = json.loads(f.read())
        if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
            raise ValueError(f"page {number} of {path} isn't a list of records")
        yield pa.RecordBatch.from_arrays([pa.array([number if n == "page" else _value(r.get(n)) for r in records], t) for n, t in zip(names, kind.types, strict=True)], schema=kind)


def _value(x):
    return json.dumps(x) if isinstance(x, dict) else x


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.first, self.last = int(options.get("first", 1)), options.get("last")

    def partitions(self) -> list[InputPartition]:
        found = _numbers(self.path)
        return _tasks(self.path, found, self.first, max(found, default=0) if self.last is None else int(self.last))

    def read(self, partition):
        return _rows(self.path, partition.pages, self.schema)


class _Stream(DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path, self.first = schema, options["path"], int(options.get("first", 1))

    def initialOffset(self) -> dict:
        return {"page": self.first - 1}

    def latestOffset(self) -> dict:
        found, n = _numbers(self.path), self.first - 1
        while n + 1 in found:
            n += 1
        return {"page": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _tasks(self.path, _numbers(self.path), start["page"] + 1, end["page"])

    def read(self, partition):
        return _rows(self.path, partition.pages, self.schema)


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)


class Mark:
    """The greatest value that a pull has seen, stored under a path as a table of one row a pull."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self):
        if not exists(self.spark, self.path):
            return None
        return self.spark.read.parquet(self.path).agg(F.max("mark")).first()[0]

    def put(self, rows: DataFrame, column: str) -> None:
        """Moves the mark up to the greatest value in rows; nothing if they have none."""
        rows.agg(F.max(column).alias("mark")).filter("mark is not null").write.mode("append").parquet(self.path)


def newer(rows: DataFrame, mark: Mark, column: str) -> DataFrame:
    """The rows whose column isn't below the mark (a row at the mark may have come after it was taken, so those are read again), rows without a value left out;
    all rows that have one where there is no mark yet. Take them to the sink by id, then put the mark."""
    seen = mark.get()
    return rows.filter(F.col(column).isNotNull() if seen is None else F.col(column) >= F.lit(seen))


PAGE_SCHEMA = "page long, id long, product_id long, processed_at string, body string"


def land(posts: DataFrame, path: str, size: int) -> None:
    """Puts posts down as a service would give them: pages of `size` in order of id. A page's number follows from counts by range, so that no task sees all rows."""
    span = posts.withColumn("g", F.floor(F.col("id") / size)).select("g", "id", "product_id", F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"), "body")
    pages = span.groupBy("g").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "product_id", "processed_at", "body"))), {"ignoreNullFields": "false"}).alias("value"))  # at most `size` ids share a page

    def write(rows) -> None:
        store, folder = _store(path)
        for r in rows:
            with store.open_output_stream(f"{folder}/page-{r['g'] + 1:06d}.json") as f:
                f.write(r["value"].encode())

    store, folder = _store(path)
    store.create_dir(folder)
    pages.foreachPartition(write)


@query("select product_id, count(*)::bigint as n, max(id)::bigint as last, count(*) filter (body is null)::bigint as empty from posts group by 1")
def scan_landed_pages(t: Tables, size: int = 500) -> DataFrame:
    """Posts landed as pages, read by the stream reader to the end in two goes, the second from the stored offset: each page once."""
    path = fresh_path(t.spark, "landed")
    land(t.posts, path, size)
    register(t.spark)
    stream = t.spark.readStream.format("landed_pages").schema(PAGE_SCHEMA).load(path)
    sink = fresh_path(t.spark, "pulled")
    for _ in range(2):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start(f"{sink}/rows").awaitTermination()
    rows = t.spark.read.schema(PAGE_SCHEMA).parquet(f"{sink}/rows")
    return rows.groupBy("product_id").agg(F.count("*").alias("n"), F.max("id").alias("last"), F.count_if(F.col("body").isNull()).alias("empty"))


@query("""with m as (select max(strftime(collected_at, '%Y-%m-%dT%H:%M:%S')) as mark from posts where id < 5000) select platform_id, count(*)::bigint as n from posts, m where strftime(collected_at, '%Y-%m-%dT%H:%M:%S') >= mark group by 1""".replace("with m as", "select * from (with m as") + ")")
def scan_newer_than_mark(t: Tables) -> DataFrame:
    """A second pull takes what the first one's stored mark leaves."""
    mark = Mark(t.spark, fresh_path(t.spark, "mark"))
    rows = t.posts.select("id", "platform_id", F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    mark.put(rows.filter("id < 5000"), "at")
    return newer(rows, mark, "at").groupBy("platform_id").agg(F.count("*").alias("n"))
