"""Pages, reports and alert checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, engagement, has, ratio
from feedloom.operators.deep import spikes
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables


def filtered(posts: DataFrame, product=None, countries=(), label=None, category=None, first=None, last=None) -> DataFrame:
    """Posts under the predicates that are given; those left out restrict nothing."""
    if product is not None:
        posts = posts.filter(F.col("product_id") == product)
    if countries:
        posts = posts.filter(F.col("country_code").isin(*countries))
    if label is not None:
        posts = posts.filter(F.col("label") == label)
    if category is not None:
        posts = posts.filter(has("categories", category))
    if first is not None:
        posts = posts.filter(day() >= first)
    return posts if last is None else posts.filter(day() <= last)


@query("select id, likes + comments + shares as eng from active where product_id = 2 and label = 'neutral' and coalesce(list_contains(categories, 'cat1'), false) and published_at::date >= date '2024-01-05' order by published_at desc, id desc limit 20 offset 10")
def voc_page(t: Tables) -> DataFrame:
    v = filtered(t.active, product=2, label="neutral", category="cat1", first="2024-01-05")
    return v.orderBy(F.desc("published_at"), F.desc("id")).offset(10).limit(20).select("id", engagement().alias("eng"))


@query("""select region, count(*)::bigint as n, count(*) filter (label = 'negative')::bigint as neg, count(distinct v.platform_id)::bigint as sites from active v join platforms f on f.id = v.platform_id where published_at::date = date '2024-01-30' group by 1""")
def report_daily_regions(t: Tables, date: str = "2024-01-30") -> DataFrame:
    f = t.platforms.select(F.col("id").alias("platform_id"), "region")
    return t.active.filter(day() == date).join(f, "platform_id").groupBy("region").agg(F.count("*").alias("n"), count_label("negative").alias("neg"), F.count_distinct("platform_id").alias("sites"))


@query("select code, region from platforms f where is_active and not exists (select 1 from posts v where v.platform_id = f.id and collected_at >= timestamp '2024-01-30 23:00:00' and collected_at < timestamp '2024-01-31')", hours=1)
def report_silent_platforms(t: Tables, hours: int = 24) -> DataFrame:
    """Active platforms without any post in the last hours; the last hour of the given events leaves some silent, their last day none."""
    seen = t.posts.filter((F.col("collected_at") >= t.as_of - F.expr(f"interval {hours} hours")) & (F.col("collected_at") < t.as_of)).select("platform_id").distinct()
    return t.platforms.filter("is_active").join(seen, F.col("id") == F.col("platform_id"), "left_anti").select("code", "region")


@query("select product_id, country_code, min(published_at::date) as first_seen from posts where country_code is not null group by 1, 2 having min(published_at::date) > date '2024-01-02'")
def report_first_seen(t: Tables, after: str = "2024-01-02") -> DataFrame:
    """Pairs that were seen for the first time after a day; the history isn't bounded."""
    g = t.posts.filter("country_code is not null").groupBy("product_id", "country_code").agg(F.min(day()).alias("first_seen"))
    return g.filter(F.col("first_seen") > F.to_date(F.lit(after)))


@query("select product_id, published_at::date as day, count(*)::bigint as n from active where product_id is not null and published_at::date > date '2024-01-23' and published_at::date <= date '2024-01-30' group by 1, 2")
def report_product_days(t: Tables, days: int = 7) -> DataFrame:
    return t.window(t.active, days).filter("product_id is not null").groupBy("product_id", day().alias("day")).agg(F.count("*").alias("n"))


@query("""select code, n, top, worst from (select code, count(*)::bigint as n from active v join products p on p.id = v.product_id group by 1) a
  left join (select code, string_agg(category, '|' order by r) as top from (select code, category, row_number() over (partition by code order by count(*) desc, category) as r from acats v join products p on p.id = v.product_id group by 1, 2) where r <= 5 group by 1) b using (code)
  left join (select code, string_agg(id::varchar, '|' order by r) as worst from (select code, v.id, row_number() over (partition by code order by published_at desc, v.id) as r from active v join products p on p.id = v.product_id where label = 'negative') where r <= 5 group by 1) c using (code)""")
def report_product_summary(t: Tables, top: int = 5) -> DataFrame:
    """Each product with its largest categories and its latest negative posts."""
    v = t.active.join(t.products.select(F.col("id").alias("product_id"), "code"), "product_id")

    def joined(df: DataFrame, order, value: str, name: str) -> DataFrame:
        df = df.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("r") <= top)
        return df.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(value).cast("string").alias("x")))), lambda s: s["x"]), "|").alias(name))

    cats = t.by_category(v).groupBy("code", "category").agg(F.count("*").alias("k"))
    bad = v.filter("label = 'negative'").select("code", "id", "published_at")
    out = v.groupBy("code").agg(F.count("*").alias("n"))
    return out.join(joined(cats, (F.desc("k"), "category"), "category", "top"), "code", "left").join(joined(bad, (F.desc("published_at"), "id"), "id", "worst"), "code", "left")


@query("""select c.category, s.day, keyword, before, after, round((after - before)::double / greatest(before, 1) * 100, 2) as delta_pct from (select category, d as day from (
    select category, d, (n - m) / sd as z from (select *, avg(n) over (partition by category) as m, stddev_samp(n) over (partition by category) as sd from (select category, published_at::date as d, count(*)::double as n from acats where published_at::date > date '2024-01-16' and published_at::date <= date '2024-01-30' group by 1, 2)) where sd > 0)
    where z >= 1.2 order by z desc, category, d limit 15) s
  join (select a.category, a.day, keyword, count(*) filter (p.d between a.day - 1 and a.day)::bigint as after, count(*) filter (p.d = a.day - 2)::bigint as before from (select distinct category, published_at::date as day from acats) a
    join (select c.category, published_at::date as d, keyword from acats c join kws on c.id = post_id) p on p.category = a.category and p.d between a.day - 2 and a.day group by 1, 2, 3) c on c.category = s.category and c.day = s.day where after >= 2 and after > before""", z=1.2)
def deep_anomaly_with_drivers(t: Tables, days: int = 14, z: float = 2.0, top: int = 15) -> DataFrame:
    """Keywords that grew between the day before the last two days and those, for each spike."""
    s = spikes(t, days, z).orderBy(F.desc("z"), "category", "d").limit(top).select("category", F.col("d").alias("day"))
    m = t.by_category(t.active).select("id", "category", day().alias("at")).join(t.keywords, F.col("id") == F.col("post_id"))
    near = s.withColumn("at", F.explode(F.sequence(F.date_sub("day", 2), F.col("day")))).join(m, ["category", "at"])
    g = near.groupBy("category", "day", "keyword").agg(F.count_if(F.datediff("day", "at") == 2).alias("before"), F.count_if(F.datediff("day", "at") <= 1).alias("after"))
    return g.filter("after >= 2 and after > before").withColumn("delta_pct", F.round(ratio(F.col("after") - F.col("before"), F.greatest("before", F.lit(1))) * 100, 2))


@query("""select p.code, count(v.id) filter (abs(v.published_at::date - released_at) <= 7)::bigint as around, round(avg(score) filter (abs(v.published_at::date - released_at) <= 7), 6) as score,
  (select max(n) from (select count(*) as n from active x where x.product_id = p.id and x.published_at::date >= p.released_at group by x.published_at::date))::bigint as peak from products p left join active v on v.product_id = p.id group by p.id, p.code, released_at""")
def deep_release_timeline(t: Tables, around: int = 7) -> DataFrame:
    """Posts around each release and the busiest day after it, from one pass over daily sums."""
    g = t.active.groupBy("product_id", day().alias("d")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count("score").alias("c"))
    p = t.products.select(F.col("id").alias("product_id"), "code", "released_at")
    near = F.abs(F.datediff("d", "released_at")) <= around
    out = p.join(g, "product_id", "left").groupBy("code").agg(F.coalesce(F.sum(F.when(near, F.col("n"))), F.lit(0)).cast("long").alias("around"), ratio(F.sum(F.when(near, F.col("s"))), F.sum(F.when(near, F.col("c")))).alias("score"), F.max(F.when(F.col("d") >= F.col("released_at"), F.col("n"))).alias("peak"))
    return out.withColumn("score", F.round("score", 6))


@query("""select user_id, to_char as day, severity, n from (select user_id, strftime(ts, '%Y-%m-%d') as to_char, case when (props->>'k')::bigint >= 80 then 'critical' when (props->>'k')::bigint >= 40 then 'warning' else 'info' end as severity, count(*)::bigint as n from events where event_type = 'error' group by 1, 2, 3)""")
def ops_alert_history(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = t.table("events").filter("event_type = 'error'")
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(k >= 80, "critical").when(k >= 40, "warning").otherwise("info").alias("severity")).agg(F.count("*").alias("n"))


@query("""select 'negative' as kind, platform_id, round(count(*) filter (label = 'negative')::double / count(*), 4) as value from active where published_at::date > date '2024-01-23' and published_at::date <= date '2024-01-30' group by 2 having count(*) >= 30 and count(*) filter (label = 'negative')::double / count(*) >= 0.12
  union all select 'surge', platform_id, round(count(*) filter (published_at::date = date '2024-01-30') / (count(*) filter (published_at::date <> date '2024-01-30') / 6.0), 4) from active where published_at::date > date '2024-01-23' and published_at::date <= date '2024-01-30' group by 2 having count(*) filter (published_at::date = date '2024-01-30') > 1.2 * count(*) filter (published_at::date <> date '2024-01-30') / 6.0 and count(*) filter (published_at::date <> date '2024-01-30') > 0""", share=0.12, surge=1.2)
def mcp_alert_check(t: Tables, days: int = 7, share: float = 0.4, surge: float = 2.0) -> DataFrame:
    """Platforms with a high negative share or a surge on the last day, from one aggregation."""
    last = day() == t.anchor
    g = t.window(t.active, days).groupBy("platform_id").agg(F.count("*").alias("n"), count_label("negative").alias("neg"), F.count_if(last).alias("a"), F.count_if(~last).alias("b"))
    neg, rise = ratio(F.col("neg"), F.col("n")), ratio(F.col("a"), F.col("b") / (days - 1.0))
    alerts = F.array(F.when((F.col("n") >= 30) & (neg >= share), F.struct(F.lit("negative").alias("kind"), F.round(neg, 4).alias("value"))), F.when((F.col("b") > 0) & (F.col("a") > F.col("b") * surge / (days - 1.0)), F.struct(F.lit("surge").alias("kind"), F.round(rise, 4).alias("value"))))
    return g.select("platform_id", F.explode(F.filter(alerts, lambda x: x.isNotNull())).alias("x")).select("x.kind", "platform_id", "x.value")


@query("""select a.d as day, a.n as n, a.unlabelled, coalesce(e.errors, 0)::bigint as errors from (select published_at::date as d, count(*)::bigint as n, round(count(*) filter (label is null)::double / count(*), 6) as unlabelled from posts group by 1) a
  left join (select ts::date as d, count(*) as errors from events where event_type = 'error' and value > 400 group by 1) e on e.d = a.d""")
def ops_daily_status(t: Tables) -> DataFrame:
    e = t.table("events").filter("event_type = 'error' and value > 400").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("errors"))
    g = t.posts.groupBy(day().alias("day")).agg(F.count("*").alias("n"), F.round(ratio(F.count_if(F.col("label").isNull()), F.count("*")), 6).alias("unlabelled"))
    return g.join(e, "day", "left").na.fill(0, ["errors"])
