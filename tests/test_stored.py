"""Stored rollups follow the files that they were made from; queries on tables whose names look like nobody's."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from feedloom.operators import analytics, community, rollups
from feedloom.plans import registry
from feedloom.sources.posts import Tables


@pytest.fixture
def folder(spark, sf, tmp_path):
    """The given tables, with the events in three files."""
    for name in ("part", "supplier", "nation", "region"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").repartitionByRange(3, "event_id").write.parquet(f"file://{tmp_path}/events.parquet")
    return tmp_path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, folder):
    t = Tables(spark, str(folder))
    return rows(rollups.stored_edges(t)), rows(rollups.kg_edges(t)), rollups.rollup(t, "kg_edges", rollups.kg_edges)


def rebuilt_days(r):
    return {x["day"] for x in r._table("touched", r.versions()[-1]).collect()}


def test_new_changed_and_removed_files_reach_the_reader(spark, folder):
    got, want, r = edges(spark, folder)
    assert got == want and len(r.versions()) == 1
    assert edges(spark, folder)[0] == want and len(r.versions()) == 1  # nothing changed, nothing is made
    sums = rows(analytics.kg_graph(Tables(spark, str(folder))))
    # the probe: all events once more
    all_ = spark.read.parquet(f"{folder}/events.parquet")
    all_.withColumn("event_id", F.col("event_id") + 1_000_000).coalesce(1).write.mode("append").parquet(f"file://{folder}/events.parquet")
    got, want, r = edges(spark, folder)
    assert got == want and len(r.versions()) == 2
    assert {n: w for n, w, _ in rows(analytics.kg_graph(Tables(spark, str(folder))))} != {n: w for n, w, _ in sums}
    # two late rows touch one day, and only that day is made again
    all_.limit(2).withColumn("ts", F.lit(dt.datetime(2024, 1, 9, 5)).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{folder}/events.parquet")
    got, want, r = edges(spark, folder)
    assert got == want and rebuilt_days(r) == {dt.date(2024, 1, 9)}
    assert r.freshness().first()["pending"] == 0
    # a file that goes takes its rows with it
    last = max((folder / "events.parquet").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    last.unlink()
    assert r.freshness().first()["pending"] == 1
    got, want, r = edges(spark, folder)
    assert got == want and rebuilt_days(r) == {dt.date(2024, 1, 9)}


def test_another_session_finds_the_versions(spark, folder):
    got, want, r = edges(spark, folder)
    r._seen.clear()
    assert edges(spark, folder)[0] == want
    assert len(r.versions()) == 1
    r._seen.clear()
    spark.read.parquet(f"{folder}/events.parquet").limit(1).withColumn("ts", F.lit(dt.datetime(2024, 2, 9)).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{folder}/events.parquet")
    got, want, r = edges(spark, folder)
    assert got == want and len(r.versions()) == 2 and rebuilt_days(r) == {dt.date(2024, 2, 9)}


def test_readers_of_rollups_follow(spark, folder):
    t = Tables(spark, str(folder))
    before = rows(community.tmp_series(t))
    spark.read.parquet(f"{folder}/events.parquet").withColumn("event_id", F.col("event_id") + 1_000_000).coalesce(1).write.mode("append").parquet(f"file://{folder}/events.parquet")
    after = rows(community.tmp_series(Tables(spark, str(folder))))
    assert [(w, p, 2 * n) for w, p, n, _ in before] == [r[:3] for r in after]


def foreign(spark, sf):
    """Posts whose ids, categories, codes, bodies and times look unlike the derived ones."""
    t = Tables(spark, sf)
    names = F.array(F.lit("battery"), F.lit("écran"), F.lit(""), F.lit("a b"))
    posts = t.posts.withColumn("categories", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(names, (F.col("id") % 4 + 1).cast("int")), F.lit("screen"))))
    posts = posts.withColumn("id", 9_000_000_000 - F.col("id") * 3).withColumn("country_code", F.when(F.col("country_code").isNotNull(), F.concat(F.lit("Region "), F.col("platform_id").cast("string"))))
    posts = posts.withColumn("body", F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.lit("배터리 battery 100% ' \\ \" (x) %_")))
    keywords = posts.select(F.col("id").alias("post_id"), F.explode(F.array(F.lit("battery life"), F.lit("화면"), F.concat(F.lit("k"), (F.col("id") % 9).cast("string")))).alias("keyword"))
    return Tables(spark, sf, posts=posts.cache(), keywords=keywords)


@pytest.fixture(scope="module")
def others(spark):
    return foreign(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_on_foreign_tables(spark, others, name):
    """None of them needs the names of the derived posts."""
    registry._FOUND[name][0](others).write.format("noop").mode("overwrite").save()


def test_silent_platforms(spark, sf):
    from feedloom.operators.reports import report_silent_platforms

    t = Tables(spark, sf)
    extra = spark.createDataFrame([(900, "quiet", "X", True), (901, "closed", "X", False)], "id long, code string, region string, is_active boolean")
    found = [r["code"] for r in report_silent_platforms(Tables(spark, sf, platforms=t.platforms.unionByName(extra)), hours=24 * 60).collect()]
    assert found == ["quiet"]
