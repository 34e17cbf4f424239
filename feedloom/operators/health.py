"""Health of collection and enrichment: platforms, rates, day-over-day checks, the history of violations, sums of watched products against reports, and a snapshot.

Facts are counted by platform, day or product before they meet anything else; what follows works on those few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import day, ratio
from feedloom.operators.claims import THRESHOLD, relative
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables

_RECENT = "collected_at >= timestamp '2024-01-31' - interval {} hours"


@query(f"""select f.code, is_active, max(collected_at) as last_at, count(v.id) filter ({_RECENT.format(24)})::bigint as posts_24h, count(v.id) filter ({_RECENT.format(168)})::bigint as posts_7d,
  round(count(v.id) filter ({_RECENT.format(168)}) / 7.0::double, 2) as mean_7d, case when count(v.id) filter ({_RECENT.format(24)}) > 0 then 'active' when count(v.id) filter ({_RECENT.format(168)}) > 0 then 'idle' else 'dead' end as status,
  f.code not in ('site3', 'site5') as scheduled from platforms f left join posts v on v.platform_id = f.id group by all""", unscheduled=("site3", "site5"))
def mon_health_check(t: Tables, unscheduled: tuple[str, ...] = ()) -> DataFrame:
    """Every platform with its last post, its posts of a day and a week, status and whether a schedule holds it."""
    since = lambda hours: F.count_if(F.col("collected_at") >= t.as_of - F.expr(f"interval {hours} hours"))
    g = t.posts.groupBy("platform_id").agg(F.max("collected_at").alias("last_at"), since(24).alias("posts_24h"), since(168).alias("posts_7d"))
    p = t.platforms.join(g, F.col("id") == F.col("platform_id"), "left").na.fill(0, ["posts_24h", "posts_7d"])
    status = F.when(F.col("posts_24h") > 0, "active").when(F.col("posts_7d") > 0, "idle").otherwise("dead")
    return p.select("code", "is_active", "last_at", "posts_24h", "posts_7d", F.round(F.col("posts_7d") / 7.0, 2).alias("mean_7d"), status.alias("status"), (~F.col("code").isin(*unscheduled)).alias("scheduled"))


@query("""select count(*)::bigint as total, count(*) filter (body is null or (language <> 'en' and length(body) < 16))::bigint as unread, count(product_id)::bigint as tagged, count(*) filter (categories is null or len(categories) = 0)::bigint as uncategorised,
  round(coalesce(count(*) filter (body is null or (language <> 'en' and length(body) < 16))::double / nullif(count(*), 0), 0), 6) as unread_rate, round(coalesce(count(product_id)::double / nullif(count(*), 0), 0), 6) as tag_rate,
  round(coalesce(count(*) filter (categories is null or len(categories) = 0)::double / nullif(count(*), 0), 0), 6) as uncategorised_rate from posts where collected_at >= timestamp '2024-01-24' and collected_at < timestamp '2024-01-31'""")
def mon_enrichment_quality(t: Tables, days: int = 7, shortest: int = 16) -> DataFrame:
    """How many posts of the week the rules left without a readable text (none, or a foreign one of a few characters), product or category."""
    unread = F.col("body").isNull() | ((F.col("language") != "en") & (F.length("body") < shortest))
    g = t.recent(t.posts, days).agg(F.count("*").alias("total"), F.count_if(unread).alias("unread"), F.count("product_id").alias("tagged"), F.count_if(F.col("categories").isNull() | (F.size("categories") == 0)).alias("uncategorised"))
    rate = lambda c: F.round(F.coalesce(ratio(F.col(c), F.col("total")), F.lit(0.0)), 6)
    return g.select("*", rate("unread").alias("unread_rate"), rate("tagged").alias("tag_rate"), rate("uncategorised").alias("uncategorised_rate"))


# When a day is a violation.
DROP_PCT, NULL_RATE, TOPIC_DROP_PCT = 30.0, 0.10, 20.0


@query("""with d as (select collected_at::date as d, count(*) as n, count(*) filter (label is null)::double / count(*) as nulls, count(*) filter (len(categories) > 0)::double / count(*) as topics from posts where collected_at >= timestamp '2024-01-28' and collected_at < timestamp '2024-01-30' group by 1),
  a as (select max(n) filter (d = date '2024-01-29') as n1, max(n) filter (d = date '2024-01-28') as n2, max(nulls) filter (d = date '2024-01-29') as s1, max(topics) filter (d = date '2024-01-29') as t1, max(topics) filter (d = date '2024-01-28') as t2 from d)
  select metric, round(value, 4) as value, threshold, value > threshold as violated from (select 'daily_drop_pct' as metric, (n2 - n1)::double / nullif(n2, 0) * 100 as value, 1.0::double as threshold from a union all select 'null_rate', s1, 0.01::double from a union all select 'topic_drop_pct', (t2 - t1) / nullif(t2, 0) * 100, 0.5::double from a)""".replace("with d as", "select * from (with d as") + ")", limits=(1.0, 0.01, 0.5))
def mon_operations(t: Tables, limits: tuple[float, float, float] = (DROP_PCT, NULL_RATE, TOPIC_DROP_PCT)) -> DataFrame:
    """The last two whole days before today: fall of the posts, share without label, fall of the share with a category; against their limits."""
    today = F.to_date(t.as_of)
    ago = F.datediff(F.date_sub(today, 1), day("collected_at"))
    v = t.posts.filter((day("collected_at") < F.date_sub(today, 1)) & (day("collected_at") >= F.date_sub(today, 3)))
    one = lambda k: F.coalesce(ago == k, F.lit(False))
    g = v.agg(*[F.count_if(one(k)).alias(f"n{k}") for k in (1, 2)], *[F.count_if(one(k) & (F.size("categories") > 0)).alias(f"t{k}") for k in (1, 2)], F.count_if(one(1) & F.col("label").isNull()).alias("s1"))
    share = lambda k: ratio(F.col(f"t{k}"), F.col(f"n{k}"))
    fall = lambda a, b: (b - a) / F.nullif(b, F.lit(0.0)) * 100
    checks = (("daily_drop_pct", fall(F.col("n1").cast("double"), F.col("n2").cast("double"))), ("null_rate", ratio(F.col("s1"), F.col("n1"))), ("topic_drop_pct", fall(share(1), share(2))))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(x).alias("threshold")) for (m, v), x in zip(checks, limits, strict=True)])
    return g.select(F.explode(rows).alias("x")).select("x.metric", F.round("x.value", 4).alias("value"), "x.threshold", (F.col("x.value") > F.col("x.threshold")).alias("violated"))


def violation_history(t: Tables, days: int, critical: float, warning: float) -> DataFrame:
    """day, code, severity: active platforms whose posts of a day fall under so many times their mean of all days of the window."""
    d = t.window(t.posts.withColumn("published_at", F.col("collected_at")), days)
    n = d.groupBy("platform_id", day("collected_at").alias("day")).agg(F.count("*").alias("n"))
    grid = t.platforms.filter("is_active").select(F.col("id").alias("platform_id"), "code").crossJoin(t.spark.range(days).select(F.date_sub(t.anchor, F.col("id").cast("int")).alias("day")))
    g = grid.join(n, ["platform_id", "day"], "left").na.fill(0, ["n"])
    mean = F.avg("n").over(Window.partitionBy("platform_id"))
    return g.withColumn("severity", F.when(F.col("n") < critical * mean, "critical").when(F.col("n") < warning * mean, "warning")).select("day", "code", "severity")


_HISTORY = """(select day, code, case when n < 0.5 * mean then 'critical' when n < 0.9 * mean then 'warning' end as severity from (select g.day, f.code, coalesce(n, 0) as n, avg(coalesce(n, 0)) over (partition by f.id) as mean
  from (select * from platforms where is_active) f cross join (select unnest(range(date '2024-01-24', date '2024-01-31', interval 1 day))::date as day) g left join (select platform_id, collected_at::date as day, count(*) as n from posts group by 1, 2) c on c.platform_id = f.id and c.day = g.day))"""


@query(f"""select day, count(*) filter (severity = 'critical')::bigint as critical, count(*) filter (severity = 'warning')::bigint as warning, count(*)::bigint as sites, case when count(*) filter (severity = 'critical') > 0 then 'critical' when count(*) filter (severity = 'warning') > 0 then 'warning' else 'ok' end as status from {_HISTORY} group by day""")
def mon_collection_history(t: Tables, days: int = 7, critical: float = 0.5, warning: float = 0.9) -> DataFrame:
    """Each day's violations, and what the day's status was."""
    count = lambda s: F.count_if(F.coalesce(F.col("severity") == s, F.lit(False))).alias(s)
    g = violation_history(t, days, critical, warning).groupBy("day").agg(count("critical"), count("warning"), F.count("*").alias("sites"))
    return g.withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").otherwise("ok"))


@query(f"""select code, count(*) filter (severity = 'critical')::bigint as critical, count(*) filter (severity = 'warning')::bigint as warning, count(*) filter (severity = 'critical') = count(*) as always, dense_rank() over (order by count(*) filter (severity = 'critical') desc) = 1 as worst from {_HISTORY} group by code""")
def mon_collection_worst(t: Tables, days: int = 7, critical: float = 0.5, warning: float = 0.9) -> DataFrame:
    """How often each site was critical, whether on every day, and which were most often."""
    count = lambda s: F.count_if(F.coalesce(F.col("severity") == s, F.lit(False))).alias(s)
    g = violation_history(t, days, critical, warning).groupBy("code").agg(count("critical"), count("warning"), F.count("*").alias("n"))
    top = g.agg(F.max("critical").alias("most"))
    return g.crossJoin(top).select("code", "critical", "warning", (F.col("critical") == F.col("n")).alias("always"), (F.col("critical") == F.col("most")).alias("worst"))


WATCHED = ("P1", "P3", "P5", "P9", "P10")


@query("select p.code, count(v.id)::bigint as n, sum(count(v.id)) over ()::bigint as total from products p left join posts v on v.product_id = p.id where p.code in ('P1', 'P3', 'P5', 'P9', 'P10') group by p.code")
def mon_watched_sums(t: Tables, codes: tuple[str, ...] = WATCHED) -> DataFrame:
    """Posts of the watched products, and of all of them together."""
    g = t.posts.groupBy("product_id").agg(F.count("*").alias("k"))
    p = t.products.filter(F.col("code").isin(*codes)).join(g, F.col("id") == F.col("product_id"), "left").select("code", F.coalesce("k", F.lit(0)).cast("long").alias("n"))
    return p.crossJoin(p.agg(F.sum("n").alias("total")))


def _delta(line: Column, context: str, bold: str, change: str) -> Column:
    """Figures of a line: bold ones, and in a line about the watched products those of a change too."""
    about = line.rlike(context)
    found = lambda name, p: F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(name).alias("metric"), F.regexp_replace(x, ",", "").cast("double").alias("reported")))
    none = F.array().cast("array<struct<metric:string,reported:double>>")
    return F.concat(F.when(about, found("watched_bold", bold)).otherwise(found("bold", bold)), F.when(about, found("watched_delta", change)).otherwise(none))


CONTEXT, BOLD, CHANGE = r"(?i)watched", r"\*\*([\d,]+) posts\*\*", r"(?i)(?:change|new|added)\D{0,20}?([\d,]+) posts"


@query(r"""with live as (select count(*)::bigint as n from posts v join products p on p.id = v.product_id where p.code in ('P1', 'P3', 'P5', 'P9', 'P10')), base as (select n // 2 as b, n - n // 2 as delta from live),
  l as (select doc_id, unnest(range(1, 4))::bigint as line, unnest(['watched: **' || format('{:,}', delta + doc_id % 5 * 100) || ' posts**', 'Watched products, new: ' || (delta - doc_id % 3)::varchar || ' posts', 'other **' || doc_id::varchar || ' posts**']) as t from documents, base),
  c as (select doc_id, line, case when regexp_matches(t, '(?i)watched') then 'watched_bold' else 'bold' end as metric, unnest(regexp_extract_all(t, '\*\*([\d,]+) posts\*\*', 1)) as raw from l union all select doc_id, line, 'watched_delta', unnest(regexp_extract_all(t, '(?i)(?:change|new|added)\D{0,20}?([\d,]+) posts', 1)) from l where regexp_matches(t, '(?i)watched')),
  r as (select doc_id, line, metric, replace(raw, ',', '')::double as reported, case when metric <> 'bold' then delta::double end as actual from c, base)
  select doc_id as report, line, metric, reported, actual, round((actual - reported) / greatest(abs(reported), abs(actual), 1e-9), 4) as drift_pct, coalesce(abs(round((actual - reported) / greatest(abs(reported), abs(actual), 1e-9), 4)) > 0.05, false) as alert from r""".replace("with live as", "select * from (with live as") + ")")
def mon_report_drift(t: Tables, threshold: float = THRESHOLD) -> DataFrame:
    """Figures that reports print in bold or call a change, held against the growth of the watched products since the last report; figures of
    other lines are listed without a check. The reports are derived: three lines for each document."""
    now = mon_watched_sums(t).agg(F.max("total").alias("n"))
    base = now.select((F.col("n") - F.floor(F.col("n") / 2)).alias("delta"))
    i = F.col("doc_id")
    lines = F.array(
        F.concat(F.lit("watched: **"), F.format_number(F.col("delta") + i % 5 * 100, 0), F.lit(" posts**")), F.concat(F.lit("Watched products, new: "), (F.col("delta") - i % 3).cast("string"), F.lit(" posts")),
        F.concat(F.lit("other **"), i.cast("string"), F.lit(" posts**")),
    )
    rows = t.table("documents").select("doc_id").crossJoin(base).select(i.alias("report"), "delta", F.posexplode(lines).alias("at", "text"))
    found = rows.withColumn("x", F.explode(_delta(F.col("text"), CONTEXT, BOLD, CHANGE))).select("report", (F.col("at") + 1).cast("long").alias("line"), "x.metric", "x.reported", F.when(F.col("x.metric") != "bold", F.col("delta").cast("double")).alias("actual"))
    out = found.withColumn("drift_pct", F.round(relative(F.col("reported"), F.col("actual")), 4))
    return out.withColumn("alert", F.coalesce(F.abs("drift_pct") > threshold, F.lit(False)))


@query(f"""select count(*)::bigint as total, count(*) filter ({_RECENT.format(24)})::bigint as posts_24h, count(*) filter ({_RECENT.format(168)})::bigint as posts_7d, (select count(*) from platforms where is_active)::bigint as active_sites,
  count(distinct platform_id) filter ({_RECENT.format(24)})::bigint as sites_24h, count(distinct platform_id) filter ({_RECENT.format(168)})::bigint as sites_7d, count(*) filter ({_RECENT.format(24)} and product_id is null)::bigint as unmapped_24h,
  count(*) filter ({_RECENT.format(24)} and platform_id = 3 and product_id is null)::bigint as site_unmapped_24h, count(*) filter (platform_id = 3)::bigint as site_total from posts""", site=3)
def mon_rollout_snapshot(t: Tables, site: int) -> DataFrame:
    """One row of figures for a rollout: posts and sites of all time, a day and a week, and how many posts found no product, everywhere and on one site."""
    since = lambda hours: F.col("collected_at") >= t.as_of - F.expr(f"interval {hours} hours")
    own, none = F.col("platform_id") == site, F.col("product_id").isNull()
    by = t.posts.groupBy("platform_id").agg(F.count("*").alias("n"), F.count_if(since(24)).alias("d"), F.count_if(since(168)).alias("w"), F.count_if(since(24) & none).alias("u"))
    g = by.agg(
        F.sum("n").alias("total"), F.sum("d").alias("posts_24h"), F.sum("w").alias("posts_7d"), F.count_if((F.col("d") > 0) & F.col("platform_id").isNotNull()).alias("sites_24h"), F.count_if((F.col("w") > 0) & F.col("platform_id").isNotNull()).alias("sites_7d"),
        F.sum("u").alias("unmapped_24h"), F.sum(F.when(own, F.col("u")).otherwise(0)).alias("site_unmapped_24h"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("site_total"),
    )
    return g.crossJoin(t.platforms.agg(F.count_if(F.col("is_active")).alias("active_sites")))
