"""Rules with their cooldown and changes of rules, on small fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators.alerting import add_rules, fire_rules, patch_rules

RULES = "id long, name string, metric string, op string, threshold double, cooldown_sec long, is_active boolean"


def _rules(spark):
    return spark.createDataFrame([(1, "a", "m", ">", 1.0, 60, True), (2, "b", "m", ">=", 2.0, 3600, True), (3, "c", "m", ">", 0.0, 0, False), (4, "d", "none", ">", 0.0, 0, True)], RULES)


def test_a_rule_is_held_back_in_its_own_cooldown(spark):
    metrics = spark.createDataFrame([("m", 2.0), ("none", None)], "metric string, value double")
    log = spark.createDataFrame([(i, datetime(2024, 1, 1, 11, 50)) for i in (1, 2)] + [(2, datetime(2024, 1, 1, 13))], "id long, fired_at timestamp_ntz")
    now = F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))
    got = {r["id"]: (r["quiet_seconds"], r["fires"]) for r in fire_rules(metrics, _rules(spark), log, now).collect()}
    assert got == {1: (600, True), 2: (600, False)}
    assert all(r["fires"] and r["quiet_seconds"] is None for r in fire_rules(metrics, _rules(spark), log.limit(0), now).collect())


def test_patches_leave_what_they_do_not_name(spark):
    patches = spark.createDataFrame([(1, 7.0, None), (2, None, False), (9, 1.0, True)], "id long, threshold double, is_active boolean")
    got = {r["id"]: (r["threshold"], r["is_active"]) for r in patch_rules(_rules(spark), patches).collect()}
    assert got == {1: (7.0, True), 2: (2.0, False), 3: (0.0, False), 4: (0.0, True)}
    with pytest.raises(ValueError):
        patch_rules(_rules(spark), patches.withColumn("name", F.lit("x")))


def test_new_rules_need_new_names(spark):
    new = spark.createDataFrame([(11, "a"), (13, "e"), (12, "e")], "id long, name string")
    got = add_rules(_rules(spark).select("id", "name"), new)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 12]
