"""Composite analyses of issues, keywords, sites and releases: one lazy plan each, where a service would
loop over queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, engagement, has, label_score, ratio
from feedloom.operators.primitives import ntiles
from feedloom.plans.graphs import connected_components
from feedloom.plans.registry import query
from feedloom.plans.storage import cut
from feedloom.sources.posts import Tables


@query("""select category, keyword, first_day, last_day, peak_day, (peak_day - first_day)::bigint as days_to_peak, intensity, lifespan from (
  select category, keyword, min(d) as first_day, max(d) as last_day, arg_min(d, (-n, d)) as peak_day, max(n)::bigint as intensity, (max(d) - min(d))::bigint as lifespan
  from (select category, keyword, published_at::date as d, count(*) as n from (select id, unnest(categories) as category, published_at from active where label = 'negative'
    and published_at::date between date '2024-01-30' - 60 and date '2024-01-30') a join kws on a.id = post_id group by all)
  group by 1, 2) where lifespan >= 1 order by lifespan desc, intensity desc, category, keyword limit 20""")
def deep_issue_lifecycle(t: Tables, days: int = 60, category: str | None = None, top: int = 20) -> DataFrame:
    """Issues of the period. category: only posts of it, with all their categories."""
    v = t.since(t.active.filter("label = 'negative'"), days)
    v = v if category is None else v.filter(has("categories", category))
    v = t.by_category(v).select("id", "category", day().alias("d"))
    g = v.join(t.keywords, F.col("id") == F.col("post_id")).groupBy("category", "keyword", "d").agg(F.count("*").alias("n"))
    g = g.groupBy("category", "keyword").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("peak_day"), F.max("n").alias("intensity"))
    g = g.withColumn("lifespan", F.datediff("last_day", "first_day").cast("long")).withColumn("days_to_peak", F.datediff("peak_day", "first_day").cast("long"))
    return g.filter("lifespan >= 1").orderBy(F.desc("lifespan"), F.desc("intensity"), "category", "keyword").limit(top)


@query("""select category, product_id, n, round(s, 4) as score, case when sd is null or sd = 0 then 0.0 else round((s - m) / sd, 4) end as z from (select *, avg(s) over (partition by category) as m, stddev_samp(s) over (partition by category) as sd
  from (select category, product_id, count(*)::bigint as n, avg(case label when 'positive' then 1.0::double when 'negative' then -1.0::double else 0.0::double end) as s from acats
    where published_at::date between date '2024-01-30' - 30 and date '2024-01-30' and product_id in (select product_id from active where product_id is not null and published_at::date between date '2024-01-30' - 30 and date '2024-01-30' group by 1 order by count(*) desc, 1 limit 10) group by 1, 2 having count(*) >= 5))""")
def deep_category_product_matrix(t: Tables, days: int = 30, top: int = 10, floor: int = 5) -> DataFrame:
    v = t.since(t.active, days)
    best = v.filter("product_id is not null").groupBy("product_id").count().orderBy(F.desc("count"), "product_id").limit(top)
    g = t.by_category(v).join(best, "product_id", "left_semi").groupBy("category", "product_id").agg(F.count("*").alias("n"), label_score().alias("s")).filter(F.col("n") >= floor)
    w = Window.partitionBy("category")
    sd = F.stddev_samp("s").over(w)
    return g.select("category", "product_id", "n", F.round("s", 4).alias("score"), F.when(sd.isNull() | (sd == 0), 0.0).otherwise(F.round((F.col("s") - F.avg("s").over(w)) / sd, 4)).alias("z"))


_HOPS = """(select keyword, platform_id, first, row_number() over (partition by keyword order by first, platform_id) as hop, count(*) over (partition by keyword) as sites
    from (select keyword, platform_id, min(published_at::date) as first from amentions where published_at::date between date '2024-01-30' - 45 and date '2024-01-30' group by 1, 2))"""


@query(f"""select a.platform_id as source, b.platform_id as target, count(*)::bigint as n, round(avg(b.first - a.first), 4)::double as mean_lag from {_HOPS} a join {_HOPS} b on a.keyword = b.keyword and b.hop = a.hop + 1
  where a.keyword in (select keyword from {_HOPS} where sites >= 2 group by 1 order by 1 limit 30) group by 1, 2""")
def deep_site_diffusion(t: Tables, days: int = 45, sites: int = 2, top: int = 30) -> DataFrame:
    """How keywords spread from site to site; the first keywords in alphabetical order count."""
    g = t.mentions(t.since(t.active, days)).groupBy("keyword", "platform_id").agg(F.min(day()).alias("first"))
    order = Window.partitionBy("keyword").orderBy("first", "platform_id")
    chosen = g.groupBy("keyword").count().filter(F.col("count") >= sites).orderBy("keyword").limit(top)
    hops = g.join(chosen, "keyword", "left_semi").withColumn("target", F.lead("platform_id").over(order)).withColumn("lag", F.datediff(F.lead("first").over(order), "first"))
    return hops.filter("target is not null").groupBy(F.col("platform_id").alias("source"), "target").agg(F.count("*").alias("n"), F.round(F.avg("lag"), 4).alias("mean_lag"))


@query("""select product_id, country, n, round(s, 4) as score, round(s - avg(s) over (partition by product_id), 4) as gap from (
  select product_id, coalesce(country_code, region, 'UNK') as country, count(*)::bigint as n, (count(*) filter (label = 'positive') - count(*) filter (label = 'negative'))::double / count(*) as s
  from active v left join platforms f on f.id = v.platform_id where published_at::date between date '2024-01-30' - 30 and date '2024-01-30' and product_id in (select product_id from active where product_id is not null and published_at::date between date '2024-01-30' - 30 and date '2024-01-30' group by 1 order by count(*) desc, 1 limit 10) group by 1, 2 having count(*) >= 20)""")
def deep_country_sentiment_gap(t: Tables, days: int = 30, top: int = 10, floor: int = 20) -> DataFrame:
    f = t.platforms.select(F.col("id").alias("platform_id"), "region")
    v = t.since(t.active, days).filter("product_id is not null")
    best = v.groupBy("product_id").count().orderBy(F.desc("count"), "product_id").limit(top)
    v = v.join(best, "product_id", "left_semi").join(f, "platform_id", "left")
    g = v.groupBy("product_id", F.coalesce("country_code", "region", F.lit("UNK")).alias("country")).agg(F.count("*").alias("n"), ratio(count_label("positive") - count_label("negative"), F.count("*")).alias("s")).filter(F.col("n") >= floor)
    return g.select("product_id", "country", "n", F.round("s", 4).alias("score"), F.round(F.col("s") - F.avg("s").over(Window.partitionBy("product_id")), 4).alias("gap"))


@query("""select category, round(coalesce(case when isnan(c) then 0 else c end, 0), 4) as pearson, n from (select category, corr(bucket, neg) as c, sum(n)::bigint as n from (
  select category, bucket::double as bucket, count(*) as n, count(*) filter (label = 'negative')::double / count(*) as neg from (
    select category, label, ntile(5) over (order by eng, id, category) as bucket from (select category, label, id, likes + comments + shares as eng from acats where published_at::date between date '2024-01-30' - 30 and date '2024-01-30')) group by 1, 2) group by 1 having count(*) >= 2)""")
def deep_engagement_sentiment(t: Tables, days: int = 30) -> DataFrame:
    """Correlation of the engagement fifth with the negative share, by category."""
    v = t.by_category(t.since(t.active, days)).select("category", "label", engagement().alias("eng"), F.struct("id", "category").alias("key"))
    g = ntiles(v, "eng", "key", 5).groupBy("category", F.col("bucket").cast("double").alias("bucket")).agg(F.count("*").alias("n"), ratio(count_label("negative"), F.count("*")).alias("neg"))
    g = g.groupBy("category").agg(F.corr("bucket", "neg").alias("c"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k >= 2")
    return g.select("category", F.round(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)), 4).alias("pearson"), "n")


@query("""select keyword, first_day, active, total, case when active >= 5 and span >= 7 then 'sustained' when active <= 2 then 'flash' else 'mid' end as kind from (
  select k.keyword, first_day, count(distinct d)::bigint as active, sum(n)::bigint as total, max(d) - min(d) as span from (select keyword, min(published_at::date) as first_day from amentions group by 1 having min(published_at::date) between date '2024-01-30' - 60 and date '2024-01-30') k
  join (select keyword, published_at::date as d, count(*) as n from amentions group by 1, 2) x on x.keyword = k.keyword and d between first_day and first_day + 14 group by 1, 2) where total >= 5""")
def deep_new_term_survival(t: Tables, days: int = 60, lookback: int = 14, floor: int = 5) -> DataFrame:
    daily = t.mentions(t.active).groupBy("keyword", day().alias("d")).agg(F.count("*").alias("n"))
    first = daily.withColumn("first_day", F.min("d").over(Window.partitionBy("keyword"))).filter((F.datediff("d", "first_day") <= lookback) & F.col("first_day").between(F.date_sub(t.anchor, days), t.anchor))
    g = first.groupBy("keyword", "first_day").agg(F.count("*").alias("active"), F.sum("n").alias("total"), F.datediff(F.max("d"), F.min("d")).alias("span")).filter(F.col("total") >= floor)
    return g.select("keyword", "first_day", "active", "total", F.expr("case when active >= 5 and span >= 7 then 'sustained' when active <= 2 then 'flash' else 'mid' end").alias("kind"))


_DAYS = "published_at::date between date '2024-01-30' - 30 and date '2024-01-30'"
_PAIRS = f"select a.keyword as k1, b.keyword as k2, count(*)::bigint as w from kws a join kws b on a.post_id = b.post_id and a.keyword < b.keyword join posts on posts.id = a.post_id where {_DAYS} group by 1, 2"
_EDGES = f"""f as (select keyword, count(*) as f, avg(case label when 'positive' then 1.0::double when 'negative' then -1.0::double else 0.0::double end) as bias from mentions where {_DAYS} group by 1),
  e as (select p.*, round(w * n::double / (f1.f * f2.f), 3) as lift, f1.bias as s1, f2.bias as s2 from ({_PAIRS} having count(*) >= 5) p join f f1 on f1.keyword = k1 join f f2 on f2.keyword = k2, (select count(*) as n from active where {_DAYS})),
  ends as (select keyword, sum(w)::bigint as degree, any_value(bias) as bias from (select k1 as keyword, w, s1 as bias from e union all select k2, w, s2 from e) group by 1),
  nodes as (select * from ends order by degree desc, keyword limit 80)"""


def pairs(t: Tables, days: int) -> DataFrame:
    """Keywords of one post, with how many posts of the days hold both; a post's keywords are met once, not joined with themselves."""
    both = F.transform("ks", lambda x: F.transform(F.filter("ks", lambda y: y > x), lambda y: F.struct(x.alias("k1"), y.alias("k2"))))
    held = t.mentions(t.since(t.posts, days)).groupBy("post_id").agg(F.sort_array(F.collect_list("keyword")).alias("ks"))
    return held.select(F.explode(F.flatten(both)).alias("p")).groupBy("p.k1", "p.k2").agg(F.count("*").alias("w"))


def keyword_edges(t: Tables, days: int, floor: int) -> DataFrame:
    """k1, k2, w, lift and both biases. The pairs count archived posts too, the total doesn't."""
    f = t.mentions(t.since(t.posts, days)).groupBy("keyword").agg(F.count("*").alias("f"), label_score().alias("bias"))
    n = t.since(t.active, days).agg(F.count("*").cast("double").alias("n"))
    side = lambda i: f.select(F.col("keyword").alias(f"k{i}"), F.col("f").alias(f"f{i}"), F.col("bias").alias(f"s{i}"))
    p = pairs(t, days).filter(F.col("w") >= floor).join(side(1), "k1").join(side(2), "k2").crossJoin(n)
    return p.select("k1", "k2", "w", F.round(F.col("w") * F.col("n") / (F.col("f1") * F.col("f2")), 3).alias("lift"), "s1", "s2")


def top_nodes(edges: DataFrame, top: int, *more: str) -> DataFrame:
    """The nodes of largest weighted degree."""
    ends = F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("keyword"), "w", *[F.col(f"{c}{i}").alias(c) for c in more]) for i in (1, 2)])).alias("x")
    g = edges.select(ends).groupBy("x.keyword").agg(F.sum("x.w").alias("degree"), *[F.first(f"x.{c}").alias(c) for c in more])
    return g.orderBy(F.desc("degree"), "keyword").limit(top)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    k = nodes.select("keyword")
    return edges.join(k.withColumnRenamed("keyword", "k1"), "k1", "left_semi").join(k.withColumnRenamed("keyword", "k2"), "k2", "left_semi")


@query(f"select * from (with {_EDGES} select k1, k2, w, lift from e where k1 in (select keyword from nodes) and k2 in (select keyword from nodes))")
def deep_keyword_cooccurrence(t: Tables, days: int = 30, floor: int = 5, top: int = 80) -> DataFrame:
    """Edges between the top nodes; the edges are written once, since they give the nodes too."""
    e = cut(keyword_edges(t, days, floor))
    return induced(e, top_nodes(e, top)).select("k1", "k2", "w", "lift")


@query(f"select * from (with {_EDGES} select keyword, degree, round(bias, 4) as bias from nodes)")
def deep_keyword_nodes(t: Tables, days: int = 30, floor: int = 5, top: int = 80) -> DataFrame:
    return top_nodes(keyword_edges(t, days, floor).withColumnsRenamed({"s1": "bias1", "s2": "bias2"}), top, "bias").select("keyword", "degree", F.round("bias", 4).alias("bias"))


@query(f"select * from (with {_EDGES} select k1, k2, w, lift, round((s1 + s2) / 2, 4) as skew from e order by lift desc, w desc, k1, k2 limit 30)")
def deep_keyword_pairs(t: Tables, days: int = 30, floor: int = 5, top: int = 30) -> DataFrame:
    """Pairs by lift, whether their keywords are top nodes or not."""
    return keyword_edges(t, days, floor).orderBy(F.desc("lift"), F.desc("w"), "k1", "k2").limit(top).select("k1", "k2", "w", "lift", F.round((F.col("s1") + F.col("s2")) / 2, 4).alias("skew"))


@query(f"""select * from (with recursive e as materialized ({_PAIRS} having count(*) >= 10), ends as (select keyword, sum(w)::bigint as degree from (select k1 as keyword, w from e union all select k2, w from e) group by 1),
  nodes as materialized (select * from ends order by degree desc, keyword limit 80), b as materialized (select k1 as u, k2 as v from e where k1 in (select keyword from nodes) and k2 in (select keyword from nodes) union select k2, k1 from e where k1 in (select keyword from nodes) and k2 in (select keyword from nodes)),
  r(u, v) as (select keyword, keyword from nodes union select r.u, b.v from r join b on b.u = r.v),
  f as (select keyword, sum(n)::bigint as f, arg_min(language, (-n, language)) as language from (select keyword, language, count(*) as n from mentions where {_DAYS} group by 1, 2) group by 1)
select u as keyword, min(v) as community, any_value(degree) as degree, any_value(f.f) as f, any_value(f.language) as language from r join nodes on nodes.keyword = u join f on f.keyword = u group by u)""")
def deep_keyword_network(t: Tables, days: int = 30, floor: int = 10, top: int = 80) -> DataFrame:
    """The top nodes with their weighted degree, frequency, modal language and community: the connected component among
    them, named by its least keyword."""
    e = pairs(t, days).filter(F.col("w") >= floor)
    nodes = top_nodes(e, top)
    parts = connected_components(induced(e, nodes).select(F.col("k1").alias("a"), F.col("k2").alias("b")))
    by = t.mentions(t.since(t.posts, days)).groupBy("keyword", "language").agg(F.count("*").alias("n"))
    f = by.groupBy("keyword").agg(F.sum("n").alias("f"), F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))
    named = nodes.join(parts.select(F.col("node").alias("keyword"), "component"), "keyword", "left").join(f, "keyword")
    return named.select("keyword", F.coalesce("component", "keyword").alias("community"), "degree", "f", "language")


_SPIKES = """(select category, d, n, (n - m) / sd as z from (select *, avg(n) over (partition by category) as m, stddev_samp(n) over (partition by category) as sd
    from (select category, published_at::date as d, count(*)::double as n from acats where published_at::date > date '2024-01-16' and published_at::date <= date '2024-01-30' group by 1, 2)) where sd > 0 and (n - m) / sd >= 1.2)"""


@query(f"""select s.category, s.d as day, s.n::bigint as n, round(s.z, 4) as z, k.keyword, k.delta from (select * from {_SPIKES} order by z desc, category, d limit 20) s
  join (select category, d, keyword, delta, row_number() over (partition by category, d order by delta desc, keyword) as r from (
    select s.category, s.d, m.keyword, (count(*) filter (m.day between s.d - 1 and s.d) - count(*) filter (m.day between s.d - 4 and s.d - 2))::bigint as delta from {_SPIKES} s
    join (select c.category, c.published_at::date as day, keyword from acats c join kws on c.id = post_id) m on m.category = s.category and m.day between s.d - 4 and s.d group by 1, 2, 3) where delta > 0) k
  on k.category = s.category and k.d = s.d and k.r <= 5""", z=1.2)
def deep_anomaly_context(t: Tables, days: int = 14, z: float = 2.5, top: int = 20) -> DataFrame:
    """Spikes of a category with the keywords that grew most, from one join of spikes with posts by category and day."""
    s = spikes(t, days, z).orderBy(F.desc("z"), "category", "d").limit(top)
    m = t.by_category(t.active).select("id", "category", day().alias("day")).join(t.keywords, F.col("id") == F.col("post_id"))
    near = s.withColumn("day", F.explode(F.sequence(F.date_sub("d", 4), F.col("d")))).join(m, ["category", "day"])
    delta = F.count_if(F.datediff("d", "day") <= 1) - F.count_if(F.datediff("d", "day") >= 2)
    g = near.groupBy("category", "d", "n", "z", "keyword").agg(delta.alias("delta")).filter("delta > 0")
    r = F.row_number().over(Window.partitionBy("category", "d").orderBy(F.desc("delta"), "keyword"))
    return g.withColumn("r", r).filter("r <= 5").select("category", F.col("d").alias("day"), F.col("n").cast("long").alias("n"), F.round("z", 4).alias("z"), "keyword", "delta")


def spikes(t: Tables, days: int, z: float) -> DataFrame:
    """Days of a category that lie z sample deviations above its mean over the days that it has."""
    w = Window.partitionBy("category")
    g = t.by_category(t.window(t.active, days)).groupBy("category", day().alias("d")).agg(F.count("*").cast("double").alias("n"))
    g = g.withColumn("m", F.avg("n").over(w)).withColumn("sd", F.stddev_samp("n").over(w)).filter("sd > 0")
    return g.select("category", "d", "n", ((F.col("n") - F.col("m")) / F.col("sd")).alias("z")).filter(F.col("z") >= z)


@query("""select keyword, language, round(b, 4) as before, round(a, 4) as after, round(a - b, 4) as delta from (select keyword, language,
    count(*) filter (now) as na, count(*) filter (not now) as nb, count(*) filter (now and label = 'negative')::double / nullif(count(*) filter (now), 0) as a, count(*) filter (not now and label = 'negative')::double / nullif(count(*) filter (not now), 0) as b
  from (select *, published_at::date > date '2024-01-15' as now from amentions where published_at::date > date '2024-01-01' and published_at::date <= date '2024-01-30' ) group by 1, 2) where na >= 5 and nb >= 5""")
def deep_sentiment_driver(t: Tables, days: int = 29, floor: int = 5) -> DataFrame:
    """Change of the negative rate of a keyword between the halves of the window."""
    now, bad = day() > F.date_sub(t.anchor, 15), F.col("label") == "negative"
    g = t.mentions(t.window(t.active, days)).groupBy("keyword", "language").agg(F.count_if(now).alias("na"), F.count_if(~now).alias("nb"), F.count_if(now & bad).alias("ba"), F.count_if(~now & bad).alias("bb"))
    g = g.filter((F.col("na") >= floor) & (F.col("nb") >= floor)).withColumn("a", ratio(F.col("ba"), F.col("na"))).withColumn("b", ratio(F.col("bb"), F.col("nb")))
    return g.select("keyword", "language", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"), F.round(F.col("a") - F.col("b"), 4).alias("delta"))


@query("""select category, week, n, share, round(coalesce(regr_slope(case when back <= 4 then share end, x) over (partition by category), 0), 4) as slope from (
  select category, week, n, round(100.0::double * n / sum(n) over (partition by week), 3) as share, row_number() over (partition by category order by week)::double as x, row_number() over (partition by category order by week desc) as back from (
    select category, date_trunc('week', published_at)::date as week, count(*)::bigint as n from acats where published_at::date between date '2024-01-30' - 60 and date '2024-01-30' group by 1, 2))""")
def deep_category_momentum(t: Tables, days: int = 60, bucket: str = "week", points: int = 4) -> DataFrame:
    """Shares of the categories in a week, and the slope of each category's last points."""
    g = t.by_category(t.since(t.active, days)).groupBy("category", F.to_date(F.date_trunc(bucket, "published_at")).alias("week")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("category")
    g = g.withColumn("share", F.round(ratio(F.col("n") * 100, F.sum("n").over(Window.partitionBy("week"))), 3))
    g = g.withColumn("x", F.row_number().over(own.orderBy("week")).cast("double")).withColumn("back", F.row_number().over(own.orderBy(F.desc("week"))))
    slope = F.regr_slope(F.when(F.col("back") <= points, F.col("share")), F.col("x")).over(own)
    return g.select("category", "week", "n", "share", F.round(F.coalesce(slope, F.lit(0.0)), 4).alias("slope"))


@query("""select stage, count(*)::bigint as n, round(avg(days_alive), 4)::double as days_alive from (select keyword, days_alive, case when days_alive <= 2 then 'new' when days_alive <= 7 and peak >= 3 then 'growth' when days_alive between 8 and 21 then 'plateau' else 'decline' end as stage from (
  select keyword, max(d) - first_day as days_alive, max(n) as peak, sum(n) as total from (select keyword, min(published_at::date) as first_day from amentions group by 1 having min(published_at::date) between date '2024-01-30' - 90 and date '2024-01-30')
  join (select keyword, published_at::date as d, count(*) as n from mentions group by 1, 2) using (keyword) where d between first_day and first_day + 30 group by keyword, first_day) where total >= 3) group by 1""")
def deep_lifecycle_funnel(t: Tables, days: int = 90, around: int = 30, floor: int = 3) -> DataFrame:
    """Stages of the keywords that first came up in the period, by the days that they lived within a month. Archived posts count
    as mentions, not as a first one."""
    live = F.col("archived_at").isNull()
    daily = t.mentions().groupBy("keyword", day().alias("d")).agg(F.count("*").alias("n"), F.count_if(live).alias("live"))
    first = F.min(F.when(F.col("live") > 0, F.col("d"))).over(Window.partitionBy("keyword"))
    near = daily.withColumn("first_day", first).filter(F.col("first_day").between(F.date_sub(t.anchor, days), t.anchor) & F.datediff("d", "first_day").between(0, around))
    g = near.groupBy("keyword", "first_day").agg(F.datediff(F.max("d"), F.col("first_day")).alias("days_alive"), F.max("n").alias("peak"), F.sum("n").alias("total")).filter(F.col("total") >= floor)
    stage = F.expr("case when days_alive <= 2 then 'new' when days_alive <= 7 and peak >= 3 then 'growth' when days_alive between 8 and 21 then 'plateau' else 'decline' end")
    return g.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("days_alive"), 4).alias("days_alive"))


@query("""select platform_id, n, round(0.3 * eng / max(eng) over () + 0.25 * neg + 0.25 * (tanh(coalesce(lead, 0) / 3) + 1) / 2 + 0.2 * reach / max(reach) over (), 4) as influence from (
  select platform_id, count(*)::bigint as n, avg(likes + comments + shares) as eng, count(*) filter (label = 'negative')::double / count(*) as neg, count(distinct country_code)::double as reach from active where published_at::date between date '2024-01-30' - 30 and date '2024-01-30' group by 1 having count(*) >= 20)
  left join (select platform_id, avg(g - first) as lead from (select *, min(first) over (partition by keyword) as g from (select platform_id, keyword, min(published_at::date) as first from amentions where published_at::date between date '2024-01-30' - 30 and date '2024-01-30' group by 1, 2)) group by 1) using (platform_id) order by influence desc, platform_id limit 30""")
def deep_influence_rank(t: Tables, days: int = 30, floor: int = 20, top: int = 30) -> DataFrame:
    """Engagement, negativity, lead and reach of a platform. The lead is never positive."""
    v = t.since(t.active, days)
    g = v.groupBy("platform_id").agg(F.count("*").alias("n"), F.avg(engagement()).alias("eng"), ratio(count_label("negative"), F.count("*")).alias("neg"), F.count_distinct("country_code").cast("double").alias("reach")).filter(F.col("n") >= floor)
    first = t.mentions(v).groupBy("platform_id", "keyword").agg(F.min(day()).alias("first"))
    lead = first.withColumn("g", F.min("first").over(Window.partitionBy("keyword"))).groupBy("platform_id").agg(F.avg(F.datediff("g", "first")).alias("lead"))
    w = Window.partitionBy(F.lit(1))
    total = F.lit(0.3) * F.col("eng") / F.max("eng").over(w) + F.col("neg") * 0.25 + (F.tanh(F.coalesce("lead", F.lit(0.0)) / 3) + 1) * 0.125 + F.col("reach") * 0.2 / F.max("reach").over(w)
    return g.join(lead, "platform_id", "left").select("platform_id", "n", F.round(total, 4).alias("influence")).orderBy(F.desc("influence"), "platform_id").limit(top)


@query("""select p.code, s.stage, count(v.id)::bigint as n, count(v.id) filter (label = 'negative')::bigint as neg from products p cross join (values ('before', -7, 0), ('launch', 1, 14), ('month', 15, 30)) s(stage, lo, hi)
  left join active v on v.product_id = p.id and v.published_at::date between p.released_at + lo and least(p.released_at + hi, date '2024-01-30') group by 1, 2""")
def deep_product_funnel(t: Tables, stages=(("before", -7, 0), ("launch", 1, 14), ("month", 15, 30))) -> DataFrame:
    stage = None
    off = F.datediff("d", "released_at")
    for name, lo, hi in stages:
        c = off.between(lo, hi)
        stage = F.when(c, name) if stage is None else stage.when(c, name)
    p = t.products.select(F.col("id").alias("product_id"), "code", "released_at")
    g = t.active.filter(day() <= t.anchor).groupBy("product_id", day().alias("d")).agg(F.count("*").alias("n"), count_label("negative").alias("neg"))
    g = g.join(p, "product_id").withColumn("stage", stage).filter("stage is not null").groupBy("code", "stage").agg(F.sum("n").alias("n"), F.sum("neg").alias("neg"))
    grid = p.select("code", F.explode(F.array(*[F.lit(s) for s, _, _ in stages])).alias("stage"))
    return grid.join(g, ["code", "stage"], "left").na.fill(0, ["n", "neg"])


@query("""select p.code, p.series, row_number() over (partition by p.series order by p.released_at, p.id)::bigint as generation, count(v.id)::bigint as n, round(avg(case when v.id is null then 0.0 else coalesce(v.score, 0.0) end), 4) as score
  from products p left join posts v on v.product_id = p.id group by p.id, p.code, p.series, p.released_at""")
def deep_series_comparison(t: Tables) -> DataFrame:
    """Products of a series by release; archived posts count, a missing score is 0."""
    g = t.posts.groupBy("product_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("s"))
    order = Window.partitionBy("series").orderBy("released_at", "id")
    out = t.products.withColumn("generation", F.row_number().over(order).cast("long")).join(g, F.col("id") == F.col("product_id"), "left")
    return out.select("code", "series", "generation", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("score"))


@query("""select related, n, round(s, 8) as score from (select b.keyword as related, count(distinct b.post_id)::bigint as n, avg(v.score) as s from kws a join kws b on a.post_id = b.post_id and b.keyword <> a.keyword join active v on v.id = a.post_id where a.keyword = 'kw5' group by 1) order by n desc, related limit 10""")
def deep_keyword_detail(t: Tables, keyword: str = "kw5", top: int = 10) -> DataFrame:
    a = t.keywords.filter(F.col("keyword") == keyword).select("post_id")
    b = t.keywords.filter(F.col("keyword") != keyword).join(a, "post_id")
    v = t.active.select(F.col("id").alias("post_id"), "score")
    return b.join(v, "post_id").groupBy(F.col("keyword").alias("related")).agg(F.count_distinct("post_id").alias("n"), F.round(F.avg("score"), 8).alias("score")).orderBy(F.desc("n"), "related").limit(top)


@query("""select keyword, now::bigint as now, round(before / 14.0, 4)::double as mean_before from (select keyword, count(*) filter (published_at::date = date '2024-01-20') as now, count(*) filter (published_at::date < date '2024-01-20') as before
  from amentions where published_at::date between date '2024-01-06' and date '2024-01-20' group by 1) where now > 0 order by now - before / 14.0 desc, keyword limit 10""")
def deep_anomaly_drilldown(t: Tables, date: str = "2024-01-20", top: int = 10) -> DataFrame:
    """Keywords of one day against the mean of the 14 days before."""
    d = F.to_date(F.lit(date))
    v = t.mentions(t.active.filter(day().between(F.date_sub(d, 14), d)))
    g = v.groupBy("keyword").agg(F.count_if(day() == d).alias("now"), (F.count_if(day() < d) / 14.0).alias("before")).filter("now > 0")
    return g.orderBy((F.col("now") - F.col("before")).desc(), "keyword").limit(top).select("keyword", "now", F.round("before", 4).cast("double").alias("mean_before"))


@query("""select c.name, count(*)::bigint as n, round(count(*) filter (label = 'negative')::double / count(*), 4) as neg_rate, count(distinct platform_id)::bigint as sites from (values ('one', 1, date '2024-01-05', date '2024-01-12'), ('two', 2, date '2024-01-10', date '2024-01-20'), ('three', 3, date '2024-01-02', date '2024-01-28')) c(name, pid, lo, hi)
  join active v on v.product_id = c.pid and v.published_at::date between lo and hi group by 1""")
def deep_crisis_cases(t: Tables, cases=(("one", 1, "2024-01-05", "2024-01-12"), ("two", 2, "2024-01-10", "2024-01-20"), ("three", 3, "2024-01-02", "2024-01-28"))) -> DataFrame:
    c = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).cast("long").alias("pid"), F.to_date(F.lit(lo)).alias("lo"), F.to_date(F.lit(hi)).alias("hi")) for n, p, lo, hi in cases])
    v = t.active.filter(F.col("product_id").isin(*[p for _, p, _, _ in cases])).withColumn("c", F.explode(F.filter(c, lambda x: (x["pid"] == F.col("product_id")) & day().between(x["lo"], x["hi"]))))
    return v.groupBy(F.col("c.name").alias("name")).agg(F.count("*").alias("n"), F.round(ratio(count_label("negative"), F.count("*")), 4).alias("neg_rate"), F.count_distinct("platform_id").alias("sites"))
