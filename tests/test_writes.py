"""Changes of stored tables and details on small inputs with known answers."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import details, writes
from feedloom.operators.deep import top_nodes
from feedloom.sources.posts import Tables


def test_update_sets_nulls_and_leaves_others(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id int, v string, w string")
    changes = spark.createDataFrame([(1, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, writes.update_by_id(rows, changes, "id").collect())) == [(1, None, "x"), (2, "b", "y"), (3, "c", "z")]


def test_soft_delete_keeps_earlier_stamps(spark):
    old, new = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    rows = spark.createDataFrame([(1, None), (2, old), (3, None)], "id int, archived_at date")
    ids = spark.createDataFrame([(1,), (2,), (1,)], "id int")
    assert sorted(map(tuple, writes.soft_delete(rows, ids, "id", F.lit(new)).collect())) == [(1, new), (2, old), (3, None)]


def test_repeats_with_null_keys(spark):
    rows = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", "b"), (4, None, None)], "id int, k string, l string")
    assert sorted(r["id"] for r in writes.delete_repeats(rows, ["k", "l"], "id").collect()) == [1, 2, 4]


def test_csv_starts_with_a_mark(spark, sf, tmp_path):
    writes.sink_csv_bom(Tables(spark, sf)).collect()


def test_unknown_nodes_have_no_samples(spark, sf):
    t = Tables(spark, sf)
    assert details.kg_node_samples(t, "planet:x").count() == 0
    assert details.kg_node_samples(t, "category:cat3", 4).count() == 4


def test_top_nodes_by_weighted_degree(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "d", 9)], "k1 string, k2 string, w long")
    assert [tuple(r) for r in top_nodes(e, 2).collect()] == [("c", 11), ("d", 9)]
