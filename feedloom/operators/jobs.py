"""Runs of jobs from their logs: the state of each script, recent runs, runs that were risky, and rounds that a validator keeps complaining about.

A log is a row an event (ts, seq, run_id, script, event, dry_run); a run is what shares script and run_id. Every result is one or two grouped
aggregates with mergeable states, so a script with most of the events costs no single task. The given tables hold no logs: job_log,
run_records and rounds derive them from the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.registry import query
from feedloom.sources.posts import Tables

OK_EVENTS, FAIL_EVENTS = ("end", "verified"), ("failed", "aborted")
SCRIPTS = ("send", "receive", "pack")


def job_log(t: Tables) -> DataFrame:
    """Four events a run; run ids come again after 997 runs; runs may fail, stay open or be dry."""
    e = t.table("events").withColumn("run", F.floor(F.col("event_id") / 4)).withColumn("step", F.col("event_id") % 4)
    event = F.when(F.col("step") == 0, F.when(F.col("run") % 13 == 0, "step").otherwise("start")).when((F.col("step") == 3) & (F.col("run") % 9 != 0), "end").when((F.col("step") == 2) & (F.col("value") > 300), "failed").when((F.col("step") == 1) & (F.col("run") % 11 == 0), "verified").otherwise("step")
    script = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("run") % 3 + 1).cast("int"))
    return e.select("ts", F.col("event_id").alias("seq"), F.concat(F.lit("run-"), (F.col("run") % 997).cast("string")).alias("run_id"), script.alias("script"), event.alias("event"), (F.col("run") % 5 == 0).alias("dry_run"))


_LOG = """(select ts, event_id as seq, 'run-' || (event_id // 4 % 997)::varchar as run_id, ['send', 'receive', 'pack'][event_id // 4 % 3 + 1] as script,
  case when event_id % 4 = 0 then case when event_id // 4 % 13 = 0 then 'step' else 'start' end when event_id % 4 = 3 and event_id // 4 % 9 <> 0 then 'end' when event_id % 4 = 2 and value > 300 then 'failed' when event_id % 4 = 1 and event_id // 4 % 11 = 0 then 'verified' else 'step' end as event,
  event_id // 4 % 5 = 0 as dry_run from events)"""
_RUNS = f"""(select *, ended_at is not null and n_failed = 0 as ok from (select script, coalesce(run_id, '') as run_id, min(ts) filter (event = 'start') as started_at, min(ts) as first_at, max(ts) filter (event = 'end') as ended_at, max(ts) filter (event in ('end', 'verified')) as success_at,
  count(*)::bigint as n_events, count(*) filter (event in ('failed', 'aborted'))::bigint as n_failed, bool_or(dry_run) as any_dry, max(ts) as last_at, arg_max(event, (ts, seq)) as last_event, arg_max(dry_run, (ts, seq)) as last_dry, max((ts, seq)) as last from {_LOG} group by 1, 2))"""


def runs_of(log: DataFrame, ok_events=OK_EVENTS, fail_events=FAIL_EVENTS) -> DataFrame:
    """A row a run: started_at (the first start), first_at, ended_at (the last end), success_at (the last good event), n_events, n_failed, any_dry, last (the last event), ok. A run
    without an end is open: ended_at is null and it isn't ok. Events without run_id are one run of their script."""
    at = F.struct("ts", "seq")
    when = lambda names: F.when(F.col("event").isin(*names), at)
    g = log.withColumn("run_id", F.coalesce("run_id", F.lit(""))).groupBy("script", "run_id").agg(
        F.min(when(("start",)))["ts"].alias("started_at"), F.min(at)["ts"].alias("first_at"), F.max(when(("end",)))["ts"].alias("ended_at"), F.max(when(ok_events))["ts"].alias("success_at"), F.count("*").alias("n_events"),
        F.count_if(F.col("event").isin(*fail_events)).alias("n_failed"), F.bool_or("dry_run").alias("any_dry"), F.max(F.struct("ts", "seq", "event", "dry_run")).alias("last"),
    )
    return g.withColumn("ok", F.col("ended_at").isNotNull() & (F.col("n_failed") == 0))


def script_status(log: DataFrame, as_of: Column) -> DataFrame:
    """Each script's last event, last success and last run, and its runs, successes, failures and dry runs of the last 24 hours and 7 days by their start."""
    r = runs_of(log).withColumn("at", F.coalesce("started_at", "first_at"))
    since = lambda hours: F.col("at") >= as_of - F.expr(f"interval {hours} hours")
    count = lambda name, hours, cond: F.count_if(since(hours) & cond).alias(name)
    counts = [count(f"{what}_{label}", hours, cond) for label, hours in (("24h", 24), ("7d", 168)) for what, cond in (("runs", F.lit(True)), ("ok", F.col("ok")), ("fail", F.col("n_failed") > 0), ("dry", F.col("any_dry")))]
    g = r.groupBy("script").agg(F.max("success_at").alias("last_success_at"), F.max(F.struct("last.ts", "last.seq", "last.event", "last.dry_run", "run_id", "started_at", "ended_at", "n_events", "n_failed", "ok")).alias("x"), *counts)
    names = [c for c in g.columns if c not in ("script", "last_success_at", "x")]
    return g.select("script", F.col("x.event").alias("last_event"), F.col("x.ts").alias("last_event_at"), "last_success_at", F.col("x.run_id").alias("last_run_id"), "x.started_at", "x.ended_at", F.col("x.dry_run").alias("dry_run"), "x.n_events", "x.n_failed", "x.ok", *names)


_COUNTS = ", ".join(f"count(*) filter (began >= timestamp '2024-01-31' - interval {h} hours and {cond})::bigint as {what}_{label}" for label, h in (("24h", 24), ("7d", 168)) for what, cond in (("runs", "true"), ("ok", "ok"), ("fail", "n_failed > 0"), ("dry", "any_dry")))


@query(f"""select script, arg_max(last_event, last) as last_event, max(last_at) as last_event_at, max(success_at) as last_success_at, arg_max(run_id, last) as last_run_id,
  arg_max({{'v': started_at}}, last).v as started_at, arg_max({{'v': ended_at}}, last).v as ended_at, arg_max(last_dry, last) as dry_run, arg_max(n_events, last) as n_events, arg_max(n_failed, last) as n_failed, arg_max(ok, last) as ok, {_COUNTS}
  from (select *, coalesce(started_at, first_at) as began from {_RUNS}) group by script""")
def ops_sync_status(t: Tables) -> DataFrame:
    return script_status(job_log(t), t.as_of)


def recent_runs(log: DataFrame, limit: int) -> DataFrame:
    """The newest runs as records: script, run_id, mode, status, started_at, finished_at."""
    r = runs_of(log)
    status = F.when(F.col("n_failed") > 0, "error").when(F.col("ended_at").isNotNull(), "ok").otherwise("running")
    rows = r.select("script", "run_id", F.when(F.col("any_dry"), "dry_run").otherwise("apply").alias("mode"), status.alias("status"), F.coalesce("started_at", "first_at").alias("started_at"), F.col("ended_at").alias("finished_at"))
    return rows.orderBy(F.desc("started_at"), "script", "run_id").limit(limit)


@query(f"""select script, count(*)::bigint as runs, count(*) filter (status = 'ok')::bigint as ok, count(*) filter (status = 'error')::bigint as error, arg_max(coalesce(finished_at, started_at), (-r)) as last_at, arg_max(status, (-r)) as last_status, arg_max(mode, (-r)) as last_mode
  from (select *, row_number() over (order by started_at desc, script, run_id) as r from (select script, run_id, case when any_dry then 'dry_run' else 'apply' end as mode, case when n_failed > 0 then 'error' when ended_at is not null then 'ok' else 'running' end as status, coalesce(started_at, first_at) as started_at, ended_at as finished_at from {_RUNS}) order by r limit 200) group by script""", limit=200)
def ops_backfill_status(t: Tables, limit: int = 20) -> DataFrame:
    """The newest runs by script, and how each script's last one went."""
    r = recent_runs(job_log(t), limit)
    # started_at falls in the order of the page; of equal ones the first run_id is the newest
    first = F.min_by(F.struct(F.coalesce("finished_at", "started_at").alias("at"), "status", "mode"), F.struct((-F.unix_micros(F.col("started_at").cast("timestamp"))).alias("a"), F.col("run_id")))
    g = r.groupBy("script").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"), first.alias("x"))
    return g.select("script", "runs", "ok", "error", F.col("x.at").alias("last_at"), F.col("x.status").alias("last_status"), F.col("x.mode").alias("last_mode"))


#: Scripts that only insert, and scripts that have nothing to preserve.
INSERT_ONLY, NOTHING_TO_PRESERVE = ("collect",), ("dedup",)
FULL_MODES = ("full", "full_reclassify", "reclassify_all")
RECORD_SCRIPTS = ("retag", "collect", "dedup", "resentiment", "relink")


def run_records(t: Tables) -> DataFrame:
    """Runs with their settings, one of each event: null settings are settings that the run didn't state."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    n = F.floor("value").cast("long")
    tri = lambda i: F.when(i % 4 == 0, None).otherwise(i % 4 != 1)
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    return t.table("events").select(
        "event_id", F.col("ts").alias("started_at"), pick(RECORD_SCRIPTS, F.col("user_id")).alias("script"), pick(("full", "preserve_existing", "dry_run", "apply"), k).alias("mode"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), tri(k + n).alias("preserve"), tri(n).alias("backup"), F.when(k % 6 == 0, None).otherwise(k % 6 == 1).alias("dry_run"), F.when(k % 10 == 0, False).alias("data_touched"),
    )


def violations(runs: DataFrame, insert_only=INSERT_ONLY, nothing_to_preserve=NOTHING_TO_PRESERVE, full_modes=FULL_MODES) -> DataFrame:
    """A row a broken rule, in the order of the rules: nothing preserved, no backup (a warning where the old rows are preserved), a full run for real, an error
    (no more than information in a dry run). Dry runs, runs that touch no data and scripts that only insert owe neither."""
    mode = F.lower(F.coalesce("mode", F.lit("")))
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    dry = (mode == "dry_run") | F.coalesce("dry_run", F.lit(False))
    owes = ~dry & F.coalesce("data_touched", F.lit(True)) & ~F.coalesce("script", F.lit("")).isin(*insert_only)
    rule = lambda place, name, risk, cond: F.when(cond, F.struct(F.lit(place).alias("place"), F.lit(name).alias("rule"), (F.lit(risk) if isinstance(risk, str) else risk).alias("risk")))
    found = F.array(
        rule(0, "preserve_existing_off", "critical", owes & ~F.coalesce("script", F.lit("")).isin(*nothing_to_preserve) & off("preserve")),
        rule(1, "backup_disabled", F.when(off("preserve"), "critical").otherwise("warning"), owes & off("backup")),
        rule(2, "dry_run_off_full", "warning", F.coalesce(F.col("dry_run") == False, F.lit(False)) & mode.isin(*full_modes)),  # noqa: E712
        rule(3, "status_error", F.when(dry, "info").otherwise("warning"), F.lower(F.coalesce("status", F.lit(""))) == "error"),
    )
    return runs.withColumn("x", F.explode(F.array_compact(found))).select("*", "x.*").drop("x")


_BROKEN = """(select *, unnest(list_filter([
    case when owes and script <> 'dedup' and not coalesce(preserve, false) then {'place': 0, 'rule': 'preserve_existing_off', 'risk': 'critical'} end,
    case when owes and not coalesce(backup, false) then {'place': 1, 'rule': 'backup_disabled', 'risk': case when coalesce(preserve, false) then 'warning' else 'critical' end} end,
    case when dry_run = false and mode = 'full' then {'place': 2, 'rule': 'dry_run_off_full', 'risk': 'warning'} end,
    case when status = 'error' then {'place': 3, 'rule': 'status_error', 'risk': case when dry then 'info' else 'warning' end} end], lambda x: x is not null)) as x
  from (select *, mode = 'dry_run' or coalesce(dry_run, false) as dry, not (mode = 'dry_run' or coalesce(dry_run, false)) and coalesce(data_touched, true) and script <> 'collect' as owes
  from (select event_id, ts as started_at, ['retag', 'collect', 'dedup', 'resentiment', 'relink'][user_id % 5 + 1] as script, ['full', 'preserve_existing', 'dry_run', 'apply'][k % 4 + 1] as mode, case when event_type = 'error' then 'error' else 'ok' end as status,
    case when (k + n) % 4 = 0 then null else (k + n) % 4 <> 1 end as preserve, case when n % 4 = 0 then null else n % 4 <> 1 end as backup, case when k % 6 = 0 then null else k % 6 = 1 end as dry_run, case when k % 10 = 0 then false end as data_touched
  from (select *, regexp_extract(props, '([0-9]+)', 1)::bigint as k, floor(value)::bigint as n from events where ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31'))))"""


@query(f"""select script, count(*)::bigint as runs, count(*) filter (status = 'ok')::bigint as ok, count(*) filter (status = 'error')::bigint as error, coalesce(any_value(v.critical), 0)::bigint as critical, coalesce(any_value(v.warning), 0)::bigint as warning, coalesce(any_value(v.info), 0)::bigint as info
  from (select event_id, ['retag', 'collect', 'dedup', 'resentiment', 'relink'][user_id % 5 + 1] as script, case when event_type = 'error' then 'error' else 'ok' end as status from events where ts >= timestamp '2024-01-24' and ts < timestamp '2024-01-31')
  left join (select script, count(*) filter (x.risk = 'critical') as critical, count(*) filter (x.risk = 'warning') as warning, count(*) filter (x.risk = 'info') as info from {_BROKEN} group by script) v using (script) group by script""")
def ops_audit_summary(t: Tables, days: int = 7) -> DataFrame:
    """The runs of the last days by script, with how many rules of each risk they broke."""
    runs = t.recent(run_records(t), days, "started_at")
    v = violations(runs).groupBy("script").agg(*[F.count_if(F.col("risk") == r).alias(r) for r in ("critical", "warning", "info")])
    g = runs.groupBy("script").agg(F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "error")])
    return g.join(v, "script", "left").select("script", "runs", "ok", "error", *[F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in ("critical", "warning", "info")])


@query(f"""select script, count(*)::bigint as critical, count(*) filter (x.rule = 'preserve_existing_off')::bigint as preserve_off, count(*) filter (x.rule = 'backup_disabled')::bigint as backup_off,
  case arg_max(x.rule, (started_at, event_id, x.place)) when 'preserve_existing_off' then 'true_risk_preserve_off' else 'true_risk_backup_off' end as root_cause, 'operator_action_required' as fix_status
  from {_BROKEN} where x.risk = 'critical' group by script""")
def ops_audit_critical(t: Tables, days: int = 7, collectors: tuple[str, ...] = INSERT_ONLY) -> DataFrame:
    """Critical violations by script; the last one names the cause, unless the script is a known collector, which just lacks settings."""
    v = violations(t.recent(run_records(t), days, "started_at")).filter("risk = 'critical'")
    g = v.groupBy("script").agg(F.count("*").alias("critical"), F.count_if(F.col("rule") == "preserve_existing_off").alias("preserve_off"), F.count_if(F.col("rule") == "backup_disabled").alias("backup_off"), F.max_by("rule", F.struct("started_at", "event_id", "place")).alias("last"))
    known = F.col("script").isin(*collectors)
    cause = F.when(known, "collector_missing_settings").when(F.col("last") == "preserve_existing_off", "true_risk_preserve_off").otherwise("true_risk_backup_off")
    return g.select("script", "critical", "preserve_off", "backup_off", cause.alias("root_cause"), F.when(known, "settings_to_be_stated").otherwise("operator_action_required").alias("fix_status"))


def round_classes(history: DataFrame) -> DataFrame:
    """round, n, class of rows (round, at, seq, alerts): one_shot (one entry, with alerts), clean (never any), resolved (none in the last entry), else
    persistent. A round's last entry comes from a mergeable maximum, so a round with most of the entries isn't sorted anywhere."""
    g = history.groupBy(F.coalesce("round", F.lit("?")).alias("round")).agg(F.count("*").alias("n"), F.bool_or(F.coalesce("alerts", F.lit(0)) > 0).alias("any"), F.max(F.struct("at", "seq", F.coalesce("alerts", F.lit(0)).alias("alerts")))["alerts"].alias("last"))
    kind = F.when(~F.col("any"), "clean").when(F.col("n") == 1, "one_shot").when(F.col("last") == 0, "resolved").otherwise("persistent")
    return g.select("round", "n", kind.alias("class"))


def rounds(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return t.table("events").select(F.concat(F.lit("R"), F.col("user_id").cast("string"), F.lit("-"), (k % 20).cast("string")).alias("round"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.floor(F.col("value") / 50).cast("long")).otherwise(0).alias("alerts"))


@query("""select round, n, case when not any_ then 'clean' when n = 1 then 'one_shot' when last = 0 then 'resolved' else 'persistent' end as class from (select 'R' || user_id::varchar || '-' || (regexp_extract(props, '([0-9]+)', 1)::bigint % 20)::varchar as round,
  count(*)::bigint as n, bool_or(event_type = 'error' and floor(value / 50) > 0) as any_, arg_max(case when event_type = 'error' then floor(value / 50) else 0 end, (ts, event_id)) as last from events group by 1)""")
def ops_round_classes(t: Tables) -> DataFrame:
    return round_classes(rounds(t))
