"""Collection health, data quality, alert rules and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, ratio
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables


@query("select lang, substr(text, 1, 80) as prefix, count(*)::bigint as n from documents group by 1, 2 having count(*) >= 2")
def ops_noise_scan(t: Tables, floor: int = 2) -> DataFrame:
    """Texts that begin alike."""
    return t.table("documents").groupBy("lang", F.substring("text", 1, 80).alias("prefix")).agg(F.count("*").alias("n")).filter(F.col("n") >= floor)


@query("""select f.code, count(v.id) filter (collected_at >= timestamp '2024-01-30 23:00:00')::bigint as h1, count(v.id) filter (collected_at >= timestamp '2024-01-30')::bigint as h24, floor((epoch(timestamp '2024-01-31') - epoch(max(collected_at))) / 3600)::bigint as hours_since,
  case when max(collected_at) is null then 'dead' when max(collected_at) >= timestamp '2024-01-30 18:00:00' then 'active' when max(collected_at) >= timestamp '2024-01-30' then 'slow' when max(collected_at) >= timestamp '2024-01-28' then 'stale' else 'dead' end as health from platforms f left join posts v on v.platform_id = f.id group by 1""")
def ops_collection_status(t: Tables) -> DataFrame:
    ago = lambda h: t.as_of - F.expr(f"interval {h} hours")
    g = t.posts.groupBy("platform_id").agg(F.count_if(F.col("collected_at") >= ago(1)).alias("h1"), F.count_if(F.col("collected_at") >= ago(24)).alias("h24"), F.max("collected_at").alias("last"))
    p = t.platforms.join(g, F.col("id") == F.col("platform_id"), "left").na.fill(0, ["h1", "h24"])
    seconds = F.unix_timestamp(t.as_of.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) / 1e6
    health = F.when(F.col("last").isNull(), "dead").when(F.col("last") >= ago(6), "active").when(F.col("last") >= ago(24), "slow").when(F.col("last") >= ago(72), "stale").otherwise("dead")
    return p.select("code", "h1", "h24", F.floor(seconds / 3600).cast("long").alias("hours_since"), health.alias("health"))


@query("""select count(*)::bigint as total, count(product_id)::bigint as linked, count(*) filter (product_id is null and length(coalesce(body, '')) < 20)::bigint as too_short, count(*) filter (product_id is null and length(body) >= 20)::bigint as unknown,
  round(count(product_id)::double / count(*), 4) as link_rate from posts""")
def ops_coverage_status(t: Tables, shortest: int = 20) -> DataFrame:
    """How many posts have a product, and how many of the others are too short to tell one."""
    short = F.length(F.coalesce("body", F.lit(""))) < shortest
    return t.posts.agg(F.count("*").alias("total"), F.count("product_id").alias("linked"), F.count_if(F.col("product_id").isNull() & short).alias("too_short"), F.count_if(F.col("product_id").isNull() & ~short).alias("unknown"), F.round(ratio(F.count("product_id"), F.count("*")), 4).alias("link_rate"))


_METRICS = """(select 'total' as name, count(*)::double as value from posts union all select 'null_label', count(*) filter (label is null)::double / count(*) from posts
  union all select 'null_country', count(*) filter (country_code is null)::double / count(*) from posts union all select 'archived', count(archived_at)::double / count(*) from posts)"""


@query(f"select name, round(value, 6) as value, case name when 'total' then value >= 100 when 'null_label' then value <= 0.1 when 'null_country' then value <= 0.05 else value <= 0.2 end as ok from {_METRICS}")
def ops_regression_baseline(t: Tables) -> DataFrame:
    """Metrics of one pass over the posts, each against its threshold."""
    share = lambda c: ratio(F.count_if(c), F.count("*"))
    one = t.posts.agg(F.count("*").cast("double").alias("total"), share(F.col("label").isNull()).alias("null_label"), share(F.col("country_code").isNull()).alias("null_country"), share(F.col("archived_at").isNotNull()).alias("archived"))
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value"), ok.alias("ok")) for n, ok in (("total", F.col("total") >= 100), ("null_label", F.col("null_label") <= 0.1), ("null_country", F.col("null_country") <= 0.05), ("archived", F.col("archived") <= 0.2))])
    return one.select(F.inline(checks))


@query("""select platform_id, mean, round(sd / nullif(mean, 0), 4) as cv, case when mean < 0.5 then 'low' when sd / nullif(mean, 0) > 1 then 'volatile_swing' when late < 0.5 * early then 'trend_down' when late > 2 * early then 'trend_up' else 'steady' end as state from (
  select platform_id, round(avg(n), 4) as mean, stddev_pop(n) as sd, avg(n) filter (d > date '2024-01-16') as late, avg(n) filter (d <= date '2024-01-16') as early from (
    select f.platform_id, g.d::date as d, count(v.id)::double as n from (select distinct platform_id from posts) f cross join range(date '2024-01-03', date '2024-01-31', interval 1 day) g(d) left join posts v on v.platform_id = f.platform_id and v.published_at::date = g.d::date group by 1, 2) group by 1)""")
def ops_collection_trend(t: Tables, days: int = 28) -> DataFrame:
    """Daily counts with zeros for missing days, and what they say about a platform. The zeros come from sums over the days
    that exist: a day without rows adds nothing to a sum but counts in the number of days."""
    g = t.window(t.posts, days).groupBy("platform_id", day().alias("d")).agg(F.count("*").cast("double").alias("n"))
    late = F.col("d") > F.date_sub(t.anchor, days // 2)
    half = F.lit(days / 2.0)
    s = g.groupBy("platform_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.when(late, F.col("n")).otherwise(0.0)).alias("l"), F.sum(F.when(~late, F.col("n")).otherwise(0.0)).alias("e"))
    s = t.posts.select("platform_id").distinct().join(s, "platform_id", "left").na.fill(0.0, ["s", "q", "l", "e"])
    s = s.withColumn("m", F.col("s") / days).withColumn("sd", F.sqrt(F.greatest(F.col("q") / days - F.col("m") * F.col("m"), F.lit(0.0))))
    cv = ratio(F.col("sd"), F.round("m", 4))
    state = F.when(F.round("m", 4) < 0.5, "low").when(cv > 1, "volatile_swing").when(F.col("l") / half < F.col("e") / half * 0.5, "trend_down").when(F.col("l") / half > F.col("e") / half * 2, "trend_up").otherwise("steady")
    return s.select("platform_id", F.round("m", 4).alias("mean"), F.round(cv, 4).alias("cv"), state.alias("state"))


@query("""select platform_id, last_day::bigint as last_day, round(prior, 4) as prior_mean, case when last_day = 0 then 'critical' when last_day < 0.1 * prior then 'warning' else 'ok' end as state from (
  select platform_id, count(*) filter (collected_at >= timestamp '2024-01-30') as last_day, count(*) filter (collected_at >= timestamp '2024-01-23' and collected_at < timestamp '2024-01-30') / 7.0 as prior from posts group by 1)""".replace("round(prior, 4)", "round(prior, 4)::double"))
def ops_collection_health(t: Tables) -> DataFrame:
    ago = lambda d: t.as_of - F.expr(f"interval {d} days")
    at = F.col("collected_at")
    g = t.posts.groupBy("platform_id").agg(F.count_if(at >= ago(1)).alias("last_day"), (F.count_if((at >= ago(8)) & (at < ago(1))).cast("double") / 7).alias("prior"))
    return g.select("platform_id", "last_day", F.round("prior", 4).alias("prior_mean"), F.when(F.col("last_day") == 0, "critical").when(F.col("last_day") < F.col("prior") * 0.1, "warning").otherwise("ok").alias("state"))


@query("""select (select count(*) from documents)::bigint as n, (select round(avg(length(text)), 4) from documents) as avg_len, (select round(quantile_cont(length(text), 0.1), 4) from documents) as p10, (select round(quantile_cont(length(text), 0.9), 4) from documents) as p90,
  (select round(sum(k - 1)::double / sum(k), 6) from (select count(*) as k from documents group by md5(text))) as duplicate_rate""")
def ops_data_quality(t: Tables) -> DataFrame:
    """Lengths and the share of rows that repeat another's text, by digest. The percentiles come from counts by length."""
    d = t.table("documents").select(F.length("text").alias("len"), F.md5("text").alias("h"))
    g = d.groupBy("len").agg(F.count("*").alias("k"), F.count("len").alias("known"))
    at = lambda p: F.round(F.percentile("len", F.lit(p), F.col("k")), 4)
    a = g.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.round(ratio(F.sum(F.col("len") * F.col("k")), F.sum("known")), 4).alias("avg_len"), at(0.1).alias("p10"), at(0.9).alias("p90"))
    b = d.groupBy("h").agg(F.count("*").alias("k")).agg(F.round(ratio(F.sum(F.col("k") - 1), F.sum("k")), 6).alias("duplicate_rate"))
    return a.crossJoin(b)


@query("""select size, groups, rows_, cross_source from (select case when k = 2 then '2' when k <= 5 then '3-5' else '6+' end as size, count(*)::bigint as groups, sum(k)::bigint as rows_, count(*) filter (s > 1)::bigint as cross_source from (select substr(sha256(text), 1, 16) as h, count(*) as k, count(distinct source) as s from documents where length(text) >= 30 group by 1 having count(*) > 1) group by 1)""")
def dedup_report(t: Tables) -> DataFrame:
    """Groups of equal bodies by size, and those that span sources."""
    g = t.table("documents").filter(F.length("text") >= 30).groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("h")).agg(F.count("*").alias("k"), F.count_distinct("source").alias("s")).filter("k > 1")
    return g.groupBy(F.when(F.col("k") == 2, "2").when(F.col("k") <= 5, "3-5").otherwise("6+").alias("size")).agg(F.count("*").alias("groups"), F.sum("k").alias("rows_"), F.count_if(F.col("s") > 1).alias("cross_source"))


@query("select doc_id from (select doc_id, row_number() over (partition by case when length(text) >= 30 then substr(sha256(text), 1, 16) else 'short' || doc_id::varchar end order by doc_id) as r from documents) where r = 1")
def dedup_exact(t: Tables) -> DataFrame:
    """The first document of each body; short bodies have no hash and stay. A grouped minimum, so a large group of copies
    is reduced before the shuffle."""
    key = F.when(F.length("text") >= 30, F.substring(F.sha2("text", 256), 1, 16)).otherwise(F.concat(F.lit("short"), F.col("doc_id").cast("string")))
    return t.table("documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""select rule, platform_id from (select 'sentiment_drop' as rule, platform_id from posts where collected_at >= timestamp '2024-01-23' group by 2 having count(*) filter (collected_at >= timestamp '2024-01-30') >= 3 and count(*) filter (collected_at >= timestamp '2024-01-30' and label = 'negative')::double / count(*) filter (collected_at >= timestamp '2024-01-30') >= 0.1 + coalesce(count(*) filter (collected_at < timestamp '2024-01-30' and label = 'negative')::double / nullif(count(*) filter (collected_at < timestamp '2024-01-30'), 0), 0)
  union all select 'site_dead', platform_id from posts group by 2 having max(collected_at) < timestamp '2024-01-30'
  union all select 'issue_spike', platform_id from posts where collected_at >= timestamp '2024-01-23' and label = 'negative' group by 2 having count(*) filter (collected_at >= timestamp '2024-01-30') > 2 * count(*) filter (collected_at < timestamp '2024-01-30') / 7.0)""", floor=3, rise=0.1, spike_floor=0)
def ops_threshold_rules(t: Tables, floor: int = 20, rise: float = 0.3, spike_floor: int = 50, times: float = 2.0) -> DataFrame:
    """Three rules on the last day against the seven before, in one aggregation."""
    now = F.col("collected_at") >= t.as_of - F.expr("interval 1 day")
    week = F.col("collected_at") >= t.as_of - F.expr("interval 8 days")
    bad = F.col("label") == "negative"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = t.posts.groupBy("platform_id").agg(n(now).alias("n1"), n(now & bad).alias("b1"), n(week & ~now).alias("n7"), n(week & ~now & bad).alias("b7"), F.max("collected_at").alias("last"))
    drop = (F.col("n1") >= floor) & (ratio(F.col("b1"), F.col("n1")) >= F.lit(rise) + F.coalesce(ratio(F.col("b7"), F.col("n7")), F.lit(0.0)))
    rules = F.array(F.when(drop, "sentiment_drop"), F.when(F.col("n1") == 0, "site_dead"), F.when((F.col("b1") >= spike_floor) & (F.col("b1") > F.col("b7") * times / 7.0), "issue_spike"))
    return g.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"), "platform_id")


def evaluate_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metrics: metric, value; rules: id, metric, op, threshold, is_active. The rules that fire."""
    v, x = F.col("value"), F.col("threshold")
    hit = F.when(F.col("op") == ">", v > x).when(F.col("op") == "<", v < x).when(F.col("op") == ">=", v >= x).when(F.col("op") == "<=", v <= x).when(F.col("op") == "==", v == x)
    return rules.filter("is_active").join(metrics, "metric").filter(hit).select("id", "metric", "value", "threshold")


@query("""select r.id, r.metric, round(m.value, 6) as value from (select row_number() over (order by event_type)::bigint as id, 'share_' || event_type as metric, 0.15 + 0.05 * (row_number() over (order by event_type) - 1) as threshold from events group by event_type) r
  join (select 'share_' || event_type as metric, count(*)::double / (select count(*) from events) as value from events group by event_type) m on m.metric = r.metric where value > threshold""")
def ops_alert_rules(t: Tables) -> DataFrame:
    """Shares of event types against one rule each."""
    e = t.table("events").groupBy("event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    m = e.select(F.concat(F.lit("share_"), "event_type").alias("metric"), ratio(F.col("n"), F.sum("n").over(w)).alias("value"))
    r = F.row_number().over(w.orderBy("event_type"))
    rules = e.select(r.cast("long").alias("id"), F.concat(F.lit("share_"), "event_type").alias("metric"), F.lit(">").alias("op"), (F.lit(0.15) + F.lit(0.05) * (r - 1)).alias("threshold"), F.lit(True).alias("is_active"))
    return evaluate_rules(m, rules).select("id", "metric", F.round("value", 6).alias("value"))


@query("""select user_id, count(*)::bigint as fired, count(*) filter (gap < 86400)::bigint as violations, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.99), 4) as p99 from (select user_id, value, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as gap from events where event_type = 'error') group by 1""")
def ops_alert_monitor(t: Tables, cooldown_seconds: int = 86400) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.table("events").filter("event_type = 'error'").withColumn("gap", seconds - F.lag(seconds).over(w))
    return e.groupBy("user_id").agg(F.count("*").alias("fired"), F.count_if(F.col("gap") < cooldown_seconds).alias("violations"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("value", F.lit(0.99)), 4).alias("p99"))


@query("""select platform_id, ok, violation, round(100.0 * ok / (ok + violation) * (1 - least(violation::double / (ok + violation), 1)), 4) as trust from (select platform_id, count(*) filter (score is not null)::bigint as ok, count(*) filter (score is null)::bigint as violation from posts group by 1)""")
def ops_audit_trust(t: Tables) -> DataFrame:
    g = t.posts.groupBy("platform_id").agg(F.count_if(F.col("score").isNotNull()).alias("ok"), F.count_if(F.col("score").isNull()).alias("violation"))
    n = F.col("ok") + F.col("violation")
    return g.select("platform_id", "ok", "violation", F.round(ratio(F.col("ok") * 100, n) * (1 - F.least(ratio(F.col("violation"), n), F.lit(1.0))), 4).alias("trust"))


@query("""select platform_id, round((last_n - first_n)::double / nullif(days - 1, 0), 4) as slope, breaches from (select platform_id, arg_min(n, d) as first_n, arg_max(n, d) as last_n, count(*) as days, count(*) filter (n < 5)::bigint as breaches from (select platform_id, published_at::date as d, count(*) as n from posts group by 1, 2) group by 1)""")
def ops_trend_slope(t: Tables, floor: int = 5) -> DataFrame:
    g = t.posts.groupBy("platform_id", day().alias("d")).agg(F.count("*").alias("n")).groupBy("platform_id").agg(F.min_by("n", "d").alias("a"), F.max_by("n", "d").alias("b"), F.count("*").alias("k"), F.count_if(F.col("n") < floor).alias("breaches"))
    return g.select("platform_id", F.round(ratio(F.col("b") - F.col("a"), F.col("k") - 1), 4).alias("slope"), "breaches")


@query("""select (date_trunc('day', published_at + interval 9 hour))::date as day, count(*)::bigint as n, count(*) filter (label = 'negative')::bigint as neg, count(distinct platform_id)::bigint as sites from active group by 1""")
def mcp_daily_briefing(t: Tables, hours_east: int = 9) -> DataFrame:
    """Days of a time zone so many hours east of UTC."""
    local = F.to_date(F.col("published_at") + F.expr(f"interval {hours_east} hours"))
    return t.active.groupBy(local.alias("day")).agg(F.count("*").alias("n"), count_label("negative").alias("neg"), F.count_distinct("platform_id").alias("sites"))


@query("""select code, case when n = 0 then 'no_data_ever' else 'ok' end as state, n from (select f.code, count(v.id)::bigint as n from platforms f left join posts v on v.platform_id = f.id and v.collected_at >= timestamp '2024-01-30' group by 1)""")
def mcp_site_health(t: Tables) -> DataFrame:
    """The day's predicate stands in the join, so a platform silent for a day reads as one without data."""
    g = t.recent(t.posts, 1).groupBy("platform_id").count()
    n = F.coalesce("count", F.lit(0)).cast("long")
    return t.platforms.join(g, F.col("id") == F.col("platform_id"), "left").select("code", F.when(n == 0, "no_data_ever").otherwise("ok").alias("state"), n.alias("n"))


def label_metrics(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall and F1 of each class of two label columns."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), (F.col(truth) == F.col(found)).alias("hit"), F.lit(True).alias("t")), F.struct(F.col(found).alias("c"), F.lit(False).alias("hit"), F.lit(False).alias("t")))).alias("x")).select("x.*")
    g = both.groupBy("c").agg(F.count_if(F.col("hit")).alias("tp"), F.count_if(F.col("t")).alias("truth"), F.count_if(~F.col("t")).alias("found"))
    p, r = ratio(F.col("tp"), F.col("found")), ratio(F.col("tp"), F.col("truth"))
    return g.select(F.col("c").alias("class"), "tp", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


@query("""select c as class, tp, round(tp / nullif(found, 0), 4) as precision, round(tp / nullif(truth, 0), 4) as recall, round(2 * (tp / nullif(found, 0)) * (tp / nullif(truth, 0)) / nullif(tp / nullif(found, 0) + tp / nullif(truth, 0), 0), 4) as f1 from (
  select c, sum(hit)::bigint as tp, sum(t)::double as truth, sum(1 - t)::double as found from (select label as c, (label = guess)::int as hit, 1 as t from (select label, case when likes > 250 then 'positive' when likes < 50 then 'negative' else 'neutral' end as guess from posts where label is not null)
    union all select guess, 0, 0 from (select label, case when likes > 250 then 'positive' when likes < 50 then 'negative' else 'neutral' end as guess from posts where label is not null)) group by 1)""")
def alg_label_metrics(t: Tables) -> DataFrame:
    guess = F.when(F.col("likes") > 250, "positive").when(F.col("likes") < 50, "negative").otherwise("neutral")
    return label_metrics(t.posts.filter("label is not null").select("label", guess.alias("guess")), "label", "guess")
