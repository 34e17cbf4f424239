"""Rollups as stored tables that know what they were made from.

A rollup's folder holds versions of its rows and a manifest a version: the source's files (name, time of change, length) with the days in
each, and which version holds each day's rows. A reader lists the source; if nothing changed it reads the rows. Else the days of the changed files are
rebuilt as the next version and the others stay where they are. Files are never overwritten, and a version counts once its
manifest is there, so readers see a rollup whole and a lost executor costs a task."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.plans.storage import shared_dir

#: Paths of a file as a listing and as a scan give them.
_NAME = "regexp_replace({}, '^([a-zA-Z0-9]+):/+', '$1:/')"


class Rollup:
    """A rollup by day of one source table. build(days) gives the rows of the days in a DataFrame (column day), of all days for None.
    Its folder outlives the session; of two sessions that bring it up to date at a time the later version holds, and both are whole."""

    _seen: dict[tuple[str, str], tuple[str, str, T.StructType, list[str]]] = {}

    def __init__(self, spark: SparkSession, name: str, source: str, build: Callable[[DataFrame | None], DataFrame], source_day: str = "to_date(ts)", day: str = "day", definition: str = ""):
        self.spark, self.name, self.source, self.build, self.source_day, self.day = spark, name, source, build, source_day, day
        # rows that another definition made aren't this rollup's
        self.root = f"{shared_dir(spark)}/rollups/{name}-{hashlib.sha256(f'{source}|{definition}'.encode()).hexdigest()[:16]}"
        self.key = (spark.sparkContext.applicationId, self.root)

    def files(self) -> DataFrame:
        """The source's files now: a listing, which reads none of them."""
        found = self.spark.read.format("binaryFile").load(self.source).select(F.expr(_NAME.format("path")).alias("file"), "path", F.col("modificationTime").alias("changed"), F.col("length").alias("size"))
        return found.filter("file not rlike '/[_.][^/]*$'")

    @staticmethod
    def _mark(files: DataFrame) -> str:
        """One figure for all files, their times and lengths."""
        n, x = files.agg(F.count("*"), F.sum(F.xxhash64("file", "changed", "size").cast("decimal(38,0)"))).first()
        return f"{n}:{x}"

    def _days_of(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*paths)
        return rows.select(F.expr(_NAME.format("_metadata.file_path")).alias("file"), F.expr(self.source_day).alias("day")).distinct()

    def _table(self, kind: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/version={version}")

    def _names(self, version: str) -> list[str]:
        """The versions that hold rows of days, in order."""
        return sorted(r[0] for r in self._table("days", version).select("held").distinct().collect())

    def versions(self) -> list[str]:
        """Names of the versions whose manifest is complete, in order."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [p.getPath() for p in fs.listStatus(path) if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
        return sorted(p.getName().removeprefix("version=") for p in done)

    def current(self) -> DataFrame:
        """The rollup's rows, brought up to date."""
        mark = self._mark(self.files())
        if self._seen.get(self.key, ("", ""))[1] != mark:
            self._bring_up_to_date(mark)
        version, _, schema, names = self._seen[self.key]
        if not names:
            return self.spark.createDataFrame([], schema)
        fields = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        rows = self.spark.read.schema(fields).option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/version={v}" for v in names])
        if len(names) > 1:
            held = self._table("days", version).select(F.col("day").alias("__day"), F.col("held").alias("version"))
            rows = rows.join(held, (rows[self.day].eqNullSafe(held["__day"])) & (rows["version"] == held["version"]), "left_semi")
        return rows.drop("version")

    def _bring_up_to_date(self, mark: str) -> None:
        files, before = self.files(), self.versions()
        version = f"v{len(before):06d}-{uuid.uuid4().hex[:8]}"
        if not before:
            rows, touched = self.build(None), None
            pairs = files.join(self._days_of([self.source]), "file", "left")
        else:
            old = self._table("files", before[-1])
            was = old.select("file", F.col("changed").alias("then"), F.col("size").alias("was")).distinct()
            both = files.join(was, "file", "full").withColumn("same", F.coalesce((F.col("changed") == F.col("then")) & (F.col("size") == F.col("was")), F.lit(False)))
            gone = both.filter("not same and was is not null").select("file")
            fresh = both.filter("not same and size is not null").select("file", "path", "changed", "size")
            paths = [r[0] for r in fresh.select("path").collect()]  # the names of changed files, which the reader needs to open them
            if not paths and gone.isEmpty():
                names = self._names(before[-1])
                self._seen[self.key] = (before[-1], mark, self._table("rows", names[-1] if names else before[-1]).schema, names)
                return
            pairs = old.join(gone, "file", "left_anti").select("file", "path", "changed", "size", "day")
            touched = old.join(gone, "file").select("day")
            if paths:
                days = self._days_of(paths)
                pairs, touched = pairs.unionByName(fresh.join(days, "file", "left")), touched.union(days.select("day"))
            touched.distinct().write.parquet(f"{self.root}/touched/version={version}")
            touched = self._table("touched", version)
            rows = self.build(touched)
        rows.write.parquet(f"{self.root}/rows/version={version}")
        held = self.spark.read.schema(rows.schema).parquet(f"{self.root}/rows/version={version}").select(F.col(self.day).alias("day")).distinct().withColumn("held", F.lit(version))
        if touched is not None:
            kept = self._table("days", before[-1]).join(touched.withColumnRenamed("day", "t"), F.col("day").eqNullSafe(F.col("t")), "left_anti")
            held = kept.union(held)
        held.write.parquet(f"{self.root}/days/version={version}")
        pairs.select("file", "path", "changed", "size", "day").write.parquet(f"{self.root}/files/version={version}")
        self._seen[self.key] = (version, mark, rows.schema, self._names(version))

    def freshness(self) -> DataFrame:
        """name, newest (day), days, files and pending (files that changed since), from the manifest and a listing; the rollup is made if there is none."""
        if not self.versions():
            self.current()
        version = self.versions()[-1]
        held = self._table("days", version).agg(F.max("day").alias("newest"), F.count("*").alias("days"))
        was = self._table("files", version).select("file", F.col("changed").alias("then"), F.col("size").alias("was")).distinct()
        same = F.coalesce((F.col("changed") == F.col("then")) & (F.col("size") == F.col("was")), F.lit(False))
        pending = self.files().join(was, "file", "full").agg(F.count("was").alias("files"), F.count_if(~same).alias("pending"))
        return held.crossJoin(pending).select(F.lit(self.name).alias("name"), "newest", "days", "files", "pending")
