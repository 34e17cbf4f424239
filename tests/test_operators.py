"""Operators on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators.community import change_points
from feedloom.operators.monitoring import evaluate_rules, label_metrics
from feedloom.operators.primitives import ntiles
from feedloom.operators.rollups import refresh_days
from feedloom.plans.graphs import connected_components
from feedloom.streaming.events import append_new


def test_components(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("d", "c"), ("q", "q")], "a string, b string")
    assert {tuple(r) for r in connected_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}


def test_components_without_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,k", [(0, 5), (3, 5), (10, 5), (13, 4)])
def test_ntiles_is_ntile(spark, n, k):
    df = spark.createDataFrame([(i, i * 7 % 3) for i in range(n)], "id long, v long")
    got = {(r["id"], r["bucket"]) for r in ntiles(df, "v", "id", k).collect()}
    want = {(r["id"], r["b"]) for r in df.selectExpr("id", f"ntile({k}) over (order by v, id) as b").collect()}
    assert got == want


def test_change_point_is_found(spark):
    rows = [("a", i, 1.0 if i < 5 else 10.0) for i in range(10)] + [("b", i, 2.0) for i in range(10)]
    found = change_points(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v").collect()
    assert {r["k"] for r in found} == {"a"} and 5 in {r["i"] for r in found}


def test_rules_skip_inactive_and_missing(spark):
    m = spark.createDataFrame([("x", 2.0)], "metric string, value double")
    r = spark.createDataFrame([(1, "x", ">", 1.0, True), (2, "x", ">", 1.0, False), (3, "y", ">", 0.0, True), (4, "x", "==", 2.0, True), (5, "x", "<", 1.0, True)], "id int, metric string, op string, threshold double, is_active boolean")
    assert {x["id"] for x in evaluate_rules(m, r).collect()} == {1, 4}


def test_label_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, f string")
    got = {r["class"]: (r["precision"], r["recall"]) for r in label_metrics(df, "t", "f").collect()}
    assert got == {"a": (1.0, 0.5), "b": (0.5, 1.0)}


def test_refresh_rebuilds_touched_days_only(spark):
    old = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 1)], "day string, n long").withColumn("day", F.to_date("day"))
    late = spark.createDataFrame([("2024-01-02 10:00:00",)], "collected_at string").withColumn("collected_at", F.to_timestamp("collected_at"))
    got = refresh_days(old, late, lambda days: days.withColumn("n", F.lit(9).cast("long")))
    assert {(str(r["day"]), r["n"]) for r in got.collect()} == {("2024-01-01", 1), ("2024-01-02", 9)}


def test_append_new_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    for _ in range(2):
        append_new(rows, f"file://{tmp_path}/sink", ["id"])
    assert spark.read.parquet(f"file://{tmp_path}/sink").count() == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("The theory of the engine and a TOKEN here", 0, 0, 0), ("", 9999, 0, 0), (None, 0, 0, 1)], "t string, l long, c long, s long")
    got = df.select(text.tokens(F.col("t")).alias("w"), text.content_hash(F.col("t")).alias("h"), text.engagement_score(F.col("l"), F.col("c"), F.col("s")).alias("e")).collect()
    assert got[0]["w"] == ["theory", "engine", "token", "here"] and len(got[0]["h"]) == 16
    assert got[1]["w"] == [] and got[1]["h"] is None and got[1]["e"] == 100.0
    assert got[2]["w"] is None and got[2]["h"] is None
