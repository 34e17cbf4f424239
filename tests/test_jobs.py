"""Runs, violations, rounds, claims and drift on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.operators import claims, jobs

def as_of():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def log(spark, rows):
    return spark.createDataFrame([(ts, i, *r) for i, (ts, *r) in enumerate(rows)], "ts timestamp_ntz, seq long, run_id string, script string, event string, dry_run boolean").repartition(2)


def test_open_failed_dry_and_repeated_runs(spark):
    rows = [
        (at(20), "a", "send", "start", False), (at(20, 1), "a", "send", "end", False),
        (at(26), "b", "send", "start", False), (at(26, 1), "b", "send", "failed", False), (at(26, 2), "b", "send", "end", False),
        (at(30, 1), "c", "send", "start", True), (at(30, 2), "c", "send", "end", True),
        (at(30, 5), "d", "send", "step", False), (at(30, 6), "d", "send", "verified", False),
        (at(30, 3), "x", "pack", "start", False), (at(30, 9), "x", "pack", "end", False), (at(30, 10), "x", "pack", "start", False), (at(30, 11), None, "wait", "step", True),
    ]
    got = {r["script"]: r.asDict() for r in jobs.script_status(log(spark, rows), as_of()).collect()}
    send = got["send"]
    assert (send["last_event"], send["last_run_id"], send["started_at"], send["ended_at"], send["ok"]) == ("verified", "d", None, None, False)
    assert send["last_success_at"] == at(30, 6)
    assert [send[f"{c}_24h"] for c in ("runs", "ok", "fail", "dry")] == [2, 1, 0, 1]
    assert [send[f"{c}_7d"] for c in ("runs", "ok", "fail", "dry")] == [3, 1, 1, 1]
    pack = got["pack"]  # a run id that comes again is one run, from its first start to its last end
    assert (pack["started_at"], pack["ended_at"], pack["n_events"], pack["ok"], pack["last_event"]) == (at(30, 3), at(30, 9), 3, True, "start")
    assert got["wait"]["last_run_id"] == "" and not got["wait"]["ok"]
    assert jobs.script_status(log(spark, rows).limit(0), as_of()).count() == 0


def test_recent_runs_are_cut_by_time(spark):
    rows = [(at(d), f"r{d}", "send", e, d % 2 == 0) for d in range(1, 8) for e in ("start", "failed" if d == 7 else "end")]
    got = jobs.recent_runs(log(spark, rows), 3).collect()
    assert sorted((r["run_id"], r["status"], r["mode"]) for r in got) == [("r5", "ok", "apply"), ("r6", "ok", "dry_run"), ("r7", "error", "apply")]


def test_rules_and_their_exemptions(spark):
    schema = "event_id long, script string, mode string, status string, preserve boolean, backup boolean, dry_run boolean, data_touched boolean"
    cases = [
        ("retag", "apply", "ok", False, False, None, None, ["preserve_existing_off/critical", "backup_disabled/critical"]),
        ("retag", "apply", "ok", None, True, None, None, ["preserve_existing_off/critical"]),
        ("retag", "apply", "ok", True, None, None, None, ["backup_disabled/warning"]),
        ("retag", "dry_run", "error", None, None, None, None, ["status_error/info"]),
        ("retag", "apply", "error", None, None, True, None, ["status_error/info"]),
        ("retag", "FULL", "ok", True, True, False, None, ["dry_run_off_full/warning"]),
        ("retag", "apply", "ok", None, None, False, False, []),
        ("collect", "apply", "ERROR", None, None, None, None, ["status_error/warning"]),
        ("dedup", "apply", "ok", None, None, None, True, ["backup_disabled/critical"]),
        (None, None, None, True, True, None, None, []),
    ]
    df = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], schema)
    got = {}
    for r in jobs.violations(df).orderBy("event_id", "place").collect():
        got.setdefault(r["event_id"], []).append(f"{r['rule']}/{r['risk']}")
    assert got == {i: c[-1] for i, c in enumerate(cases) if c[-1]}


def test_classes_of_rounds(spark):
    seen = {"once": [3], "quiet": [0], "clean": [0, 0, None], "fixed": [2, 1, 0], "open": [0, 0, 1], "still": [1, 1], None: [1, 0]}
    rows = [(r, at(i + 1), i, a) for r, alerts in seen.items() for i, a in enumerate(alerts)]
    df = spark.createDataFrame(rows, "round string, at timestamp_ntz, seq long, alerts long").repartition(3)
    assert {r["round"]: r["class"] for r in jobs.round_classes(df).collect()} == {"once": "one_shot", "quiet": "clean", "clean": "clean", "fixed": "resolved", "open": "persistent", "still": "persistent", "?": "resolved"}


def test_claims_by_line_and_unknown_metrics(spark):
    text = "Chars: 1,000 and chars: 1_100\nnothing\nshare 12.5% of 8 %\nlines: ,,"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "report long, text string")
    live = spark.createDataFrame([(1, "chars", 1000.0, False), (1, "lines", 4.0, True), (3, "chars", 0.0, False)], "report long, metric string, actual double, approximate boolean")
    got = sorted((r["metric"], r["line"], r["reported"], r["drift_pct"], r["alert"], r["note"]) for r in claims.checked(claims.claims_of(df), live).collect())
    assert got == [("chars", 1, 1000.0, 0.0, False, ""), ("chars", 1, 1100.0, -0.0909, True, ""), ("share", 3, 8.0, None, False, "no live measurement"), ("share", 3, 12.5, None, False, "no live measurement")]


def test_drift_of_zeros_bias_and_levels(spark):
    rows = [("none", 0.0), ("none", 0.0), ("under", 0.2), ("under", 0.3), ("over", -0.6), ("mixed", 0.5), ("mixed", -0.5)]
    got = {r["k"]: r for r in claims.drift_statistics(spark.createDataFrame(rows, "k string, drift double"), "k").collect()}
    assert (got["none"]["trust"], got["none"]["bias"]) == (100.0, None) and got["under"]["bias"] == "under_report" and got["over"]["bias"] == "over_report" and got["mixed"]["bias"] is None
    assert got["under"]["mean_abs_pct"] == 25.0 and got["under"]["std_abs_pct"] == 5.0 and got["under"]["trust"] == pytest.approx(73.1) and got["under"]["level"] == "warning"
    assert got["over"]["bin_50+"] == 1 and got["over"]["level"] == "critical"
    zero = spark.createDataFrame([(0.0, 0.0)], "a double, b double").select(claims.relative(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert zero == 0.0


@pytest.mark.parametrize("scores,action,critical,warning", [([60, 80], "insufficient_samples", None, None), ([65, 70, 75, 80, 90], "keep_current", 65.0, 80.0), ([10, 20, 30], "loosen", 10.0, 25.0), ([97, 98, 99], "tighten", 92.5, 100.0), ([], "insufficient_samples", None, None)])
def test_advised_thresholds(spark, scores, action, critical, warning):
    df = spark.createDataFrame([(float(s),) for s in scores], "trust double")
    r = claims.advised_thresholds(df).first()
    assert (r["action"], r["critical_below"], r["warning_below"]) == (action, critical, warning)
