"""Changes of a stored table. A table is a folder of Parquet files that readers see whole: a change writes the next version beside the
old one, and the caller swaps them. Each registered query makes a change, reads the new version back and counts what is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import day
from feedloom.plans.registry import query
from feedloom.plans.storage import fresh_path
from feedloom.sources.posts import Tables


def update_by_id(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of changes, which has a row a key, where their key is; a null there is set too."""
    mark = changes.withColumn("__there", F.lit(True)).withColumnsRenamed({c: f"__new_{c}" for c in changes.columns if c != key})
    new = lambda c: F.when(F.col("__there"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.join(mark, key, "left").select(*[new(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, stamp, column: str = "archived_at") -> DataFrame:
    """Stamps the rows of ids; those that have a stamp keep it."""
    return rows.join(ids.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left").select(*[F.when(F.col("__gone") & F.col(c).isNull(), stamp).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])


def delete_repeats(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one of least order stays; a null key is equal to a null."""
    first = rows.groupBy(*keys).agg(F.min(order).alias("__first"))
    same = F.col(f"a.{order}") == F.col("b.__first")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return rows.alias("a").join(first.alias("b"), same, "left_semi")


def stored(t: Tables, rows: DataFrame, kind: str) -> DataFrame:
    path = fresh_path(t.spark, kind)
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query("""select product_id, count(*)::bigint as n, count(*) filter (label = 'negative')::bigint as neg from (select case when product_id is null then comments % 5 + 1 else product_id end as product_id, case when product_id is null then 'negative' else label end as label from posts) group by 1""")
def sink_update_by_id(t: Tables) -> DataFrame:
    """Posts without a product are linked again, with a label, by id."""
    changes = t.posts.filter("product_id is null").select("id", (F.col("comments") % 5 + 1).alias("product_id"), F.lit("negative").alias("label"))
    out = stored(t, update_by_id(t.posts, changes, "id"), "updated")
    return out.groupBy("product_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "negative").alias("neg"))


@query("select coalesce(archived_at, case when label is null then timestamp '2024-01-31' end) is null as active, count(*)::bigint as n, max(coalesce(archived_at, case when label is null then timestamp '2024-01-31' end))::date as newest from posts group by 1")
def sink_soft_delete(t: Tables) -> DataFrame:
    """Posts without a label are stamped as archived; earlier stamps stay."""
    out = stored(t, soft_delete(t.posts, t.posts.filter("label is null").select("id"), "id", t.as_of), "stamped")
    return out.groupBy(F.col("archived_at").isNull().alias("active")).agg(F.count("*").alias("n"), F.max(day("archived_at")).alias("newest"))


@query("select platform_id, count(*)::bigint as n, sum(id)::bigint as ids from (select platform_id, body, min(id) as id from posts group by 1, 2) group by 1")
def sink_delete_repeats(t: Tables) -> DataFrame:
    """Of posts with the same text on a platform the first stays."""
    out = stored(t, delete_repeats(t.posts.select("id", "platform_id", "body"), ["platform_id", "body"], "id"), "single")
    return out.groupBy("platform_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""select platform_id, count(*)::bigint as n, sum(len(coalesce(body, '')[:200]))::bigint as chars from posts group by 1""")
def sink_csv_bom(t: Tables, chars: int = 200) -> DataFrame:
    """CSV files that start with a byte order mark, with the start of each text, read back."""
    path = fresh_path(t.spark, "csv")
    rows = t.posts.select(F.col("id").alias("﻿id"), "platform_id", F.substring(F.coalesce("body", F.lit("")), 1, chars).alias("body"))
    rows.write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)
    back = t.spark.read.schema("id long, platform_id long, body string").option("header", True).option("enforceSchema", True).csv(path)
    return back.groupBy("platform_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))


@query("""select day, n, neg from (select published_at::date as day, count(*)::bigint as n, count(*) filter (label = 'negative')::bigint as neg from posts group by 1) order by day desc limit 7""")
def scan_json_snapshots(t: Tables, newest: int = 7) -> DataFrame:
    """Daily figures as JSON snapshots, one folder a day. The folders are listed, and only the newest are read."""
    path = fresh_path(t.spark, "snapshots")
    g = t.posts.groupBy(day().alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "negative").alias("neg"))
    g.withColumn("taken", F.col("day").cast("string")).write.partitionBy("taken").json(path)
    return newest_snapshots(t.spark, path, "day date, n long, neg long", newest)


def newest_snapshots(spark, path: str, schema: str, newest: int) -> DataFrame:
    """The rows of the newest folders taken=... below path; the listing opens no file."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "/taken=([^/]+)/", 1).alias("taken")).filter("taken <> ''")
    last = [r[0] for r in names.distinct().orderBy(F.desc("taken")).limit(newest).collect()]  # at most newest names
    return spark.read.schema(f"{schema}, taken string").json(path).filter(F.col("taken").isin(last)).drop("taken")


@query("""select ok, reason, count(*)::bigint as n from (select body is not null and product_id is not null as ok, case when body is null then 'no text' when product_id is null then 'no product' else '' end as reason from posts) group by 1, 2""")
def sink_dead_letters(t: Tables) -> DataFrame:
    """An import in one pass: good records go to the table, the others with their reason to the dead letters."""
    reason = F.when(F.col("body").isNull(), "no text").when(F.col("product_id").isNull(), "no product").otherwise("")
    out = stored(t, t.posts.select("id", "product_id", "body", reason.alias("reason"), (reason == "").alias("ok")), "imported")
    return out.groupBy("ok", "reason").agg(F.count("*").alias("n"))


@query("""select platform_id, count(*)::bigint as n, max(published_at)::date as upto from posts where published_at > (select quantile_disc(published_at, 0.5) from posts) group by 1""")
def scan_since_watermark(t: Tables) -> DataFrame:
    """The posts after the stored watermark, here the median time; a reader keeps the greatest time that it has seen."""
    seen = t.posts.groupBy("published_at").agg(F.count("*").alias("k"))
    total = seen.agg(F.sum("k").alias("n"))
    by_day = seen.groupBy(day().alias("d")).agg(F.sum("k").alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("d")) - F.col("m"))
    ranked = seen.withColumn("d", day()).join(by_day, "d").withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("d").orderBy("published_at"))).crossJoin(total)
    mark = ranked.filter(F.col("upto") >= F.ceil(F.col("n") / 2)).agg(F.min("published_at").alias("mark"))
    return t.posts.crossJoin(mark).filter("published_at > mark").groupBy("platform_id").agg(F.count("*").alias("n"), F.max(day()).alias("upto"))
