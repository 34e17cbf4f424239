"""Landed files: tolerant JSON lines, and exports as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans.registry import query
from feedloom.plans.storage import fresh_path
from feedloom.sources.posts import Tables

EXPORT_COLUMNS = ("id", "product_id", "platform_id", "country_code", "language", "label", "score", "categories", "likes", "comments", "published_at")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't parse are dropped; the schema is given, so nothing is read twice."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def export_rows(posts: DataFrame, text_columns=("country_code", "language", "label")) -> DataFrame:
    """The columns of an export as text: arrays joined by |, scores with four digits, UTC times, no
    NUL and no line break in a text."""
    clean = lambda c: F.regexp_replace(F.col(c), "[\\x00\\r\\n]+", " ")
    forms = {c: clean(c) for c in text_columns} | {
        "categories": F.array_join("categories", "|"),
        "score": F.format_string("%.4f", F.col("score")),
        "published_at": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    return posts.select(*[forms.get(c, F.col(c)).cast("string").alias(c) for c in EXPORT_COLUMNS])


def write_export(posts: DataFrame, path: str) -> None:
    """Gzipped CSV with a header, one file a task."""
    export_rows(posts).write.option("header", True).option("compression", "gzip").option("escape", '"').csv(path)


@query("select event_type, count(*)::bigint as n, sum(regexp_extract(props, '([0-9]+)', 1)::bigint)::bigint as k from events where event_id % 10 <> 0 group by 1")
def scan_jsonl_tolerant(t: Tables) -> DataFrame:
    """Events landed as JSON lines, a tenth of them cut short, read without the damaged ones."""
    path = fresh_path(t.spark, "jsonl")
    line = F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")))
    t.table("events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 4)).otherwise(line).alias("value")).write.text(path)
    return read_json_lines(t.spark, path, "event_type string, k long").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("""select label, count(*)::bigint as n, sum(len(coalesce(array_to_string(categories, '|'), '')))::bigint as chars, round(sum(round(score, 4)), 2) as score from posts group by 1""")
def sink_csv_gzip(t: Tables) -> DataFrame:
    """An export, read back."""
    path = fresh_path(t.spark, "export")
    write_export(t.posts, path)
    back = t.spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in EXPORT_COLUMNS)).csv(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("categories")), F.lit(0)).cast("long").alias("chars"), F.round(F.sum(F.col("score").try_cast("double")), 2).alias("score"))
