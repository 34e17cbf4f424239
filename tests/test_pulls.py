"""Landed pages, marks, cooldown with timers, clusters and quotas."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import community, sampling
from feedloom.sources import landed
from feedloom.streaming import cooldown
from feedloom.streaming.events import drain


def put(folder, number, records):
    (folder / f"page-{number:06d}.json").write_text(json.dumps(records))


def record(i):
    return {"id": i, "product_id": i % 3, "processed_at": None, "body": f"text {i}", "other": {"a": 1}}


@pytest.fixture
def pages(spark, tmp_path):
    landed.register(spark)
    folder = tmp_path / "landed"
    folder.mkdir()
    for n in range(1, 4):
        put(folder, n, [record(10 * n + i) for i in range(4)])
    return folder


def test_pages_as_a_table(spark, pages):
    got = spark.read.format("landed_pages").schema(landed.PAGE_SCHEMA + ", other string").load(str(pages))
    assert got.rdd.getNumPartitions() == 3
    rows = got.orderBy("id").collect()
    assert [(r["page"], r["id"]) for r in rows] == [(n, 10 * n + i) for n in range(1, 4) for i in range(4)]
    assert rows[0]["other"] == '{"a": 1}' and rows[0]["processed_at"] is None
    assert spark.read.format("landed_pages").schema(landed.PAGE_SCHEMA).option("first", 2).option("last", 2).load(str(pages)).count() == 4
    put(pages, 4, [])
    assert spark.read.format("landed_pages").schema(landed.PAGE_SCHEMA).load(str(pages)).count() == 12


def test_many_pages_share_tasks(spark, pages):
    for n in range(4, 601):
        put(pages, n, [record(10 * n + i) for i in range(4)])
    got = spark.read.format("landed_pages").schema(landed.PAGE_SCHEMA).load(str(pages))
    assert got.rdd.getNumPartitions() < 130
    assert sorted((r["page"], r["id"]) for r in got.collect()) == [(n, 10 * n + i) for n in range(1, 601) for i in range(4)]


def test_a_missing_or_broken_page_is_an_error(spark, pages):
    put(pages, 5, [record(50)])
    read = lambda: spark.read.format("landed_pages").schema(landed.PAGE_SCHEMA).load(str(pages)).count()
    with pytest.raises(Exception, match="missing"):
        read()
    put(pages, 4, {"not": "a list"})
    with pytest.raises(Exception, match="isn't a list"):
        read()


def test_a_restart_reads_nothing_twice(spark, pages, tmp_path):
    def run():
        stream = spark.readStream.format("landed_pages").schema(landed.PAGE_SCHEMA).load(str(pages))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/rows").awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    three = [10 * n + i for n in range(1, 4) for i in range(4)]
    assert run() == three and run() == three
    put(pages, 5, [record(50)])
    assert run() == three  # page 4 isn't there yet
    put(pages, 4, [record(40)])
    assert run() == [*three, 40, 50]


def test_marks(spark, tmp_path):
    mark = landed.Mark(spark, f"file://{tmp_path}/mark")
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "id long, at string")
    assert mark.get() is None and landed.newer(rows, mark, "at").count() == 2
    mark.put(rows.filter("id = 3"), "at")
    assert mark.get() is None
    mark.put(rows, "at")
    mark.put(rows.filter("id = 1"), "at")  # never back
    assert mark.get() == "c" and [r["id"] for r in landed.newer(rows, mark, "at").collect()] == [2]


def firings(rows, seconds):
    last, out = {}, []
    for ts, i, rule, metric in sorted(rows):
        if (rule, metric) not in last or (ts - last[rule, metric]).total_seconds() >= seconds:
            last[rule, metric] = ts
            out.append((rule, metric, i))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 10])
def test_cooldown_is_the_same_for_one_batch_and_for_ten_shuffled_ones(spark, tmp_path, files):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=rng.randrange(20_000)), i, f"r{rng.randrange(2)}", rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(start, 500, "late", "x"), (start + dt.timedelta(hours=9), 501, "late", "x")]
    rng.shuffle(rows)
    source = f"{tmp_path}/in{files}"
    for k in range(files):
        spark.createDataFrame(rows[k::files], "ts timestamp, id long, rule string, metric string").coalesce(1).write.mode("append").parquet(source)
    # the watermark passes all of them only with the last file
    end = [(start + dt.timedelta(days=90), 999, "end", "end"), (None, 998, "r0", "a")]
    spark.createDataFrame(end, "ts timestamp, id long, rule string, metric string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp, id long, rule string, metric string").option("maxFilesPerTrigger", 1).parquet(source)
    with cooldown.rocksdb(spark):
        got = drain(cooldown.firings(stream, 6 * 3600, "40 days"), "append").collect()
    want = firings([(t, i, r, m or "") for t, i, r, m in rows], 6 * 3600)
    assert sorted((r["rule"], r["metric"], r["id"]) for r in got) == want


def test_separable_points_fall_into_their_clusters(spark):
    rng = random.Random(1)
    points = [(i, (1.0, 10.0)[i % 2] + rng.random() / 9, (1.0, 10.0)[i % 2] + rng.random() / 9) for i in range(40)]
    df = spark.createDataFrame(points, "id long, x double, y double").repartition(3)
    found, centres, took = community.kmeans(df, 2)
    got = {r["id"]: r["cluster"] for r in found.collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and len(set(got.values())) == 2 and took >= 1
    assert sorted(round(c[0]) for c in centres) == [1, 10]
    again = {r["id"]: r["cluster"] for r in community.kmeans(df.repartition(1), 2)[0].collect()}
    assert again == got


def test_as_many_clusters_as_points_or_more_and_equal_points(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "id long, x double, y double")
    for k in (4, 10):
        found, centres, took = community.kmeans(df, k)
        assert sorted(r["cluster"] for r in found.collect()) == [0, 1, 2, 3] and len(centres) == 4 and took == 0
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "id long, x double, y double")
    assert {r["cluster"] for r in community.kmeans(same, 3)[0].collect()} == {0}


@pytest.mark.parametrize("sizes,total", [([3, 10, 10], 12), ([1, 1, 50, 2], 20), ([5, 5], 100), ([7], 3), ([4, 4, 4], 8), ([9, 2, 9, 9], 10), ([3, 3], 0)])
def test_quotas_are_level_and_add_up(spark, sizes, total):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "s string, size long").repartition(2)
    got = {r["s"]: r["quota"] for r in sampling.quotas(df, total, "s").collect()}
    want, left = [0] * len(sizes), min(total, sum(sizes))
    while left:  # one by one to the least filled that has more, the first by name
        i = min((i for i in range(len(sizes)) if want[i] < sizes[i]), key=lambda i: (want[i], i))
        want[i] += 1
        left -= 1
    assert [got[f"s{i}"] for i in range(len(sizes))] == want


def test_samples_have_their_size_though_a_stratum_is_short(spark):
    rows = [(i, "ab"[i % 40 == 0]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, s string")
    q = sampling.quotas(df.groupBy("s").agg(F.count("*").alias("size")), 20, "s")
    got = sampling.sampled(df, q, ["s"], "id", 7, 20).collect()
    assert len(got) == 20 and sum(r["s"] == "b" for r in got) == 3
