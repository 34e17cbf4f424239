"""Queries give the whole job: every row of the tables that the operator is about."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import primitives
from feedloom.sources import files
from feedloom.sources.posts import Tables
from feedloom.streaming import events


@pytest.fixture(scope="module")
def t(spark, sf):
    return Tables(spark, sf)


def test_append_takes_all_posts_without_the_category(t):
    got = {r["id"]: r["tagged"].split("|") for r in primitives.filter_array_all_append(t).collect()}
    want = {r["id"]: sorted({*(r["categories"] or []), "cat3"}) for r in t.posts.select("id", "categories").collect() if "cat3" not in (r["categories"] or [])}
    assert got == want and {i % 3 for i in got} == {0, 1, 2}


def test_left_join_keeps_all_posts(t):
    code = {r["id"]: r["code"] for r in t.products.collect()}
    region = {r["id"]: r["region"] for r in t.platforms.collect()}
    got = {r["id"]: (r["product"], r["region"]) for r in primitives.join_left_dims(t).collect()}
    assert got == {r["id"]: (code.get(r["product_id"], "none"), region.get(r["platform_id"], "none")) for r in t.posts.select("id", "product_id", "platform_id").collect()}


def test_sink_takes_all_events(t):
    got = {r["event_type"]: r["n"] for r in events.st_idempotent_sink(t).collect()}
    assert got == {r["event_type"]: r["count"] for r in t.table("events").groupBy("event_type").count().collect()}


def test_export_takes_all_posts(t):
    got = {r["label"]: (r["n"], r["chars"]) for r in files.sink_csv_gzip(t).collect()}
    chars = F.coalesce(F.sum(F.length(F.array_join("categories", "|"))), F.lit(0))
    want = t.posts.groupBy("label").agg(F.count("*").alias("n"), chars.alias("chars")).collect()
    assert got == {r["label"]: (r["n"], r["chars"]) for r in want}


@pytest.mark.parametrize("name", ["st_tumbling", "st_sliding", "st_session", "st_dedup", "st_cooldown"])
def test_streams_read_a_folder_like_a_file(spark, sf, t, tmp_path_factory, name):
    folder = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"file://{folder}/events.parquet")
    f = getattr(events, name)
    rows = sorted(map(tuple, f(Tables(spark, f"file://{folder}")).collect()), key=str)
    assert rows == sorted(map(tuple, f(t).collect()), key=str) and rows


def test_upserts_keep_the_latest_row_of_a_key(spark, tmp_path):
    for k, part in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("c", 5), ("a", 1)])):
        spark.createDataFrame(part, "k string, n long").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    got = events.drain(stream.groupBy("k").agg(F.sum("n").alias("n")), "update", ["k"])
    assert {tuple(r) for r in got.collect()} == {("a", 4), ("b", 1), ("c", 5)}
