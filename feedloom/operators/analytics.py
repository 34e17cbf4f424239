"""Analytics, insights and dashboard operators. Time counts back from as_of or the anchor date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, engagement, ratio
from feedloom.operators.rollups import stored_edges
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables


@query("""select product_id, date_trunc('week', published_at)::date as week, count(*)::bigint as total, count(*) filter (label = 'positive')::bigint as positive, count(*) filter (label = 'negative')::bigint as negative,
  count(*) filter (label = 'neutral')::bigint as neutral, round(avg(score), 8) as avg_score from active where product_id is not null and published_at::date > date '2024-01-30' - 28 and published_at::date <= date '2024-01-30' group by 1, 2""")
def sentiment_trend(t: Tables, days: int = 28, bucket: str = "week") -> DataFrame:
    v = t.window(t.active, days).filter("product_id is not null")
    return v.groupBy("product_id", F.to_date(F.date_trunc(bucket, "published_at")).alias("week")).agg(F.count("*").alias("total"), *[count_label(x).alias(x) for x in ("positive", "negative", "neutral")], F.round(F.avg("score"), 8).alias("avg_score"))


@query("select product_id, category, n, round(100.0 * n / sum(n) over (partition by product_id), 1)::double as pct from (select product_id, category, count(*)::bigint as n from acats where product_id is not null group by 1, 2)")
def ana_category_distribution(t: Tables) -> DataFrame:
    g = t.by_category(t.active).filter("product_id is not null").groupBy("product_id", "category").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(ratio(F.col("n") * 100, F.sum("n").over(Window.partitionBy("product_id"))), 1))


@query("select country_code, count(*)::bigint as n, round(avg(score), 8) as avg_score, round(count(*) filter (label = 'positive')::double / count(*) * 100, 1) as pos_pct from active where country_code is not null group by 1")
def ana_country_heatmap(t: Tables) -> DataFrame:
    return t.active.filter("country_code is not null").groupBy("country_code").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("avg_score"), F.round(ratio(count_label("positive"), F.count("*")) * 100, 1).alias("pos_pct"))


@query("""select category, n, neg_pct, sample from (select category, count(*)::bigint as n, round(count(*) filter (label = 'negative')::double / count(*) * 100, 1) as neg_pct from acats where collected_at >= timestamp '2024-01-17' group by 1 order by n desc, category limit 10)
  left join (select category, string_agg(id::varchar, ',' order by r) as sample from (select category, id, row_number() over (partition by category order by likes + comments + shares desc, id) as r from acats where label = 'negative' and collected_at >= timestamp '2024-01-17') where r <= 3 group by 1) using (category)""")
def ana_top_issues(t: Tables, days: int = 14, top: int = 10) -> DataFrame:
    """The largest categories with the ids of three negative posts of most engagement."""
    v = t.by_category(t.recent(t.active, days))
    g = v.groupBy("category").agg(F.count("*").alias("n"), F.round(ratio(count_label("negative"), F.count("*")) * 100, 1).alias("neg_pct")).orderBy(F.desc("n"), "category").limit(top)
    w = Window.partitionBy("category").orderBy(F.desc("eng"), "id")
    s = v.filter("label = 'negative'").select("category", "id", engagement().alias("eng")).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    s = s.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("sample"))
    return g.join(s, "category", "left")


@query("""select p.code, c.category, case when s is null or s = 0.0 then 50.0 else round((s + 1) / 2 * 100, 1) end as score from products p cross join (select distinct category from acats) c
  left join (select product_id, category, round(avg(score), 6) as s from acats group by 1, 2) x on x.product_id = p.id and x.category = c.category""")
def ana_compare_products(t: Tables) -> DataFrame:
    """(mean + 1) / 2 in percent; a mean that is missing or exactly 0 reads 50."""
    v = t.by_category(t.active)
    cats = v.select("category").distinct().agg(F.collect_list("category").alias("cs"))
    grid = t.products.select(F.col("id").alias("product_id"), "code").crossJoin(cats).select("product_id", "code", F.explode("cs").alias("category"))
    s = v.groupBy("product_id", "category").agg(F.round(F.avg("score"), 6).alias("s"))
    return grid.join(s, ["product_id", "category"], "left").select("code", "category", F.when(F.col("s").isNull() | (F.col("s") == 0), 50.0).otherwise(F.round((F.col("s") + 1) / 2 * 100, 1)).alias("score"))


@query("select country_code, label, n, round(n::double / sum(n) over (partition by country_code), 4) as share from (select country_code, label, count(*)::bigint as n from active where label is not null and country_code in ('C1', 'C2', 'C3') group by 1, 2)")
def ana_cohort_compare(t: Tables, countries=("C1", "C2", "C3")) -> DataFrame:
    g = t.active.filter(F.col("label").isNotNull() & F.col("country_code").isin(*countries)).groupBy("country_code", "label").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("country_code"))), 4))


@query("""select f.code, count(v.id) filter (collected_at >= timestamp '2024-01-30')::bigint as n_24h, count(v.id) filter (collected_at >= timestamp '2024-01-24')::bigint as n_7d,
  round(avg(likes), 1) as avg_likes, round(100.0 * count(*) filter (len(categories) > 0) / nullif(count(v.id), 0), 1)::double as tagged_pct from platforms f left join posts v on v.platform_id = f.id group by 1""")
def ana_site_health(t: Tables) -> DataFrame:
    since = lambda d: F.col("collected_at") >= t.as_of - F.expr(f"interval {d} days")
    g = t.posts.groupBy("platform_id").agg(F.count_if(since(1)).alias("a"), F.count_if(since(7)).alias("b"), F.round(F.avg("likes"), 1).alias("avg_likes"), F.round(ratio(F.count_if(F.size("categories") > 0) * 100, F.count("*")), 1).alias("tagged_pct"))
    return t.platforms.join(g, F.col("id") == F.col("platform_id"), "left").select("code", F.coalesce("a", F.lit(0)).cast("long").alias("n_24h"), F.coalesce("b", F.lit(0)).cast("long").alias("n_7d"), "avg_likes", "tagged_pct")


@query("select id, platform_id, likes + comments + shares as eng from active where label = 'negative' order by published_at desc, id limit 20")
def ana_recent_issues(t: Tables, top: int = 20) -> DataFrame:
    return t.active.filter("label = 'negative'").orderBy(F.desc("published_at"), "id").limit(top).select("id", "platform_id", engagement().alias("eng"))


@query("""select published_at::date as day, count(*)::bigint as n, sum((label = 'positive')::int)::bigint as positive, sum((label = 'negative')::int)::bigint as negative, sum((label = 'neutral')::int)::bigint as neutral, round(avg(score), 3) as avg_score
from active where published_at >= timestamp '2024-01-31' - interval 30 day and body ilike '%kw1%' group by 1""", keyword="kw1")
def ana_keyword_track(t: Tables, keyword: str, days: int = 30, bucket: str = "day") -> DataFrame:
    """Posts whose text holds a keyword, by day, week or month."""
    v = t.active.filter((F.col("published_at") >= t.as_of - F.expr(f"interval {days} days")) & F.col("body").ilike(f"%{keyword}%"))
    label = lambda x: F.sum((F.col("label") == x).cast("int")).cast("long").alias(x)
    return v.groupBy(F.to_date(F.date_trunc(bucket, "published_at")).alias("day")).agg(F.count("*").alias("n"), label("positive"), label("negative"), label("neutral"), F.round(F.avg("score"), 3).alias("avg_score"))


@query("""select product_id, count(*)::bigint as total, count(*) filter (label = 'negative')::bigint as neg, round(count(*) filter (label = 'negative')::double / count(*), 4) as neg_rate,
  count(distinct platform_id)::bigint as sites, min(published_at)::date as first_day, max(published_at)::date as last_day from active group by 1""")
def voc_product_stats(t: Tables) -> DataFrame:
    return t.active.groupBy("product_id").agg(F.count("*").alias("total"), count_label("negative").alias("neg"), F.round(ratio(count_label("negative"), F.count("*")), 4).alias("neg_rate"), F.count_distinct("platform_id").alias("sites"), F.min(day()).alias("first_day"), F.max(day()).alias("last_day"))


@query("select v.product_id, h.h::bigint as hour, count(*)::bigint as n, round(avg(score), 8) as avg_score from active v join range(24) h(h) on extract(hour from published_at) = h.h where published_at::date > date '2024-01-16' and published_at::date <= date '2024-01-30' group by 1, 2")
def ins_hourly_pattern(t: Tables, days: int = 14) -> DataFrame:
    return t.window(t.active, days).groupBy("product_id", F.hour("published_at").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("avg_score"))


@query("select (isodow(published_at) - 1)::bigint as weekday, count(*)::bigint as n, round(100.0 * count(*) filter (label = 'negative') / count(*), 2)::double as neg_rate from active where published_at::date > date '2024-01-02' and published_at::date <= date '2024-01-30' group by 1")
def ins_weekday_pattern(t: Tables, days: int = 28) -> DataFrame:
    """Monday is 0; the rate is in percent."""
    return t.window(t.active, days).groupBy(F.weekday("published_at").cast("long").alias("weekday")).agg(F.count("*").alias("n"), F.round(ratio(count_label("negative") * 100, F.count("*")), 2).alias("neg_rate"))


@query("""select keyword, this, prev, round((this - prev)::double / greatest(prev, 1), 4) as growth, case when this >= prev + 2 then 'emerging' when prev >= this + 2 then 'declining' else 'flat' end as state
  from (select keyword, count(*) filter (published_at::date > date '2024-01-23')::bigint as this, count(*) filter (published_at::date <= date '2024-01-23')::bigint as prev
    from mentions where published_at::date > date '2024-01-16' and published_at::date <= date '2024-01-30' group by 1) where this + prev >= 3""")
def ins_emerging_keywords(t: Tables, days: int = 7) -> DataFrame:
    """This period against the one before, archived posts included."""
    now = day() > F.date_sub(t.anchor, days)
    g = t.mentions(t.window(t.posts, 2 * days)).groupBy("keyword").agg(F.count_if(now).alias("this"), F.count_if(~now).alias("prev")).filter("this + prev >= 3")
    return g.select("keyword", "this", "prev", F.round(ratio(F.col("this") - F.col("prev"), F.greatest("prev", F.lit(1))), 4).alias("growth"), F.expr("case when this >= prev + 2 then 'emerging' when prev >= this + 2 then 'declining' else 'flat' end").alias("state"))


@query("""select keyword, language, min(published_at::date) as first_seen, count(*)::bigint as n from mentions r where published_at::date > date '2024-01-30' - 29 and published_at::date <= date '2024-01-30' and not exists (select 1 from mentions o where o.keyword = r.keyword
  and coalesce(o.language, '') = coalesce(r.language, '') and o.published_at::date <= date '2024-01-30' - 29 and o.published_at::date > date '2024-01-30' - 119) group by 1, 2 having count(*) >= 2 order by n desc, first_seen desc, keyword, language limit 50""", days=29)
def ins_new_terms(t: Tables, days: int = 30, history: int = 90, floor: int = 2, top: int = 50) -> DataFrame:
    """Keywords of a language in the last days that the days before lack. One aggregation gives both, archived posts included."""
    edge = F.date_sub(t.anchor, days)
    new = day() > edge
    g = t.mentions(t.window(t.posts, days + history)).groupBy("keyword", "language").agg(F.min(day()).alias("first_seen"), F.count_if(new).alias("n"), F.count_if(~new).alias("old"))
    return g.filter((F.col("old") == 0) & (F.col("n") >= floor)).orderBy(F.desc("n"), F.desc("first_seen"), "keyword", "language").limit(top).select("keyword", "language", "first_seen", "n")


@query("""select product_id, n, round(a, 4) as after, round(b, 4) as before, round(a - b, 4) as delta_pp from (select product_id, count(*)::bigint as n, avg(score) filter (published_at::date > date '2024-01-23') as a, avg(score) filter (published_at::date <= date '2024-01-23') as b
  from active where product_id is not null and published_at::date > date '2024-01-16' and published_at::date <= date '2024-01-30' group by 1) where n >= 10 order by abs(round(a - b, 4)) desc, product_id""", floor=10)
def ins_sentiment_swing(t: Tables, days: int = 14, floor: int = 50) -> DataFrame:
    now = day() > F.date_sub(t.anchor, days // 2)
    g = t.window(t.active, days).filter("product_id is not null").groupBy("product_id").agg(F.count("*").alias("n"), F.avg(F.when(now, F.col("score"))).alias("a"), F.avg(F.when(~now, F.col("score"))).alias("b")).filter(F.col("n") >= floor)
    return g.select("product_id", "n", F.round("a", 4).alias("after"), F.round("b", 4).alias("before"), F.round(F.col("a") - F.col("b"), 4).alias("delta_pp")).orderBy(F.abs("delta_pp").desc(), "product_id")


@query("""select p.code, o.o::bigint as offset_days, count(v.id)::bigint as n, round(avg(score), 8) as avg_score from products p cross join (values (0), (7), (14)) o(o)
  left join active v on v.product_id = p.id and v.published_at::date between p.released_at + o.o - 3 and p.released_at + o.o + 3 group by 1, 2""")
def ins_product_lifecycle(t: Tables, offsets=(0, 7, 14), around: int = 3) -> DataFrame:
    """Days around fixed distances from each release, in one join on product."""
    at = t.products.select(F.col("id").alias("product_id"), "code", F.explode(F.sequence(F.date_sub("released_at", around), F.date_add("released_at", max(offsets) + around))).alias("day"), "released_at")
    at = at.withColumn("offset_days", F.explode(F.array(*[F.lit(o) for o in offsets]))).filter(F.abs(F.datediff("day", F.expr("date_add(released_at, offset_days)"))) <= around)
    g = t.active.groupBy("product_id", day().alias("day")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count("score").alias("c"))
    return at.join(g, ["product_id", "day"], "left").groupBy("code", F.col("offset_days").cast("long").alias("offset_days")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.round(ratio(F.sum("s"), F.sum("c")), 8).alias("avg_score"))


@query("""select platform_id, region, n, round(lag_days, 4) as lag_days, case when hi = lo then 50.0 else round((raw - lo) / (hi - lo) * 100, 3) end as influence from (select *, min(raw) over () as lo, max(raw) over () as hi from (
  select platform_id, region, n, (eng + 1) * (100.0::double * neg / n + 1) / (1 + exp(greatest(-20.0, least(20.0, lag_days / 2)))) as raw, lag_days from (
    select platform_id, region, count(*)::bigint as n, avg(likes + comments + shares) as eng, count(*) filter (label = 'negative') as neg, (sum(s)::double / count(*) - (select sum(s)::double / count(*) from (select datediff('second', timestamp '2024-01-01', published_at) as s from active where published_at::date between date '2024-01-30' - 30 and date '2024-01-30'))) / 86400 as lag_days
    from (select *, datediff('second', timestamp '2024-01-01', published_at) as s from active) v join platforms f on f.id = v.platform_id where published_at::date between date '2024-01-30' - 30 and date '2024-01-30' group by 1, 2 having count(*) >= 5)))""")
def ins_platform_influence(t: Tables, days: int = 30, floor: int = 5) -> DataFrame:
    """Engagement times negative share times a sigmoid of the lead, scaled to 0..100 over the platforms. A platform leads
    if its mean time lies before that of all posts."""
    v = t.since(t.active, days).withColumn("s", F.expr("timestampdiff(SECOND, timestamp_ntz '2024-01-01', published_at)"))
    mean = lambda s, n: F.sum(s).cast("double") / F.sum(n)
    g = v.groupBy("platform_id").agg(F.count("*").alias("n"), F.avg(engagement()).alias("eng"), count_label("negative").alias("neg"), F.sum("s").alias("s"))
    everything = g.agg(mean("s", "n").alias("middle"))
    lag = (F.col("s").cast("double") / F.col("n") - F.col("middle")) / 86400
    g = g.filter(F.col("n") >= floor).join(t.platforms.select(F.col("id").alias("platform_id"), "region"), "platform_id").crossJoin(everything).withColumn("lag_days", lag)
    raw = (F.col("eng") + 1) * (ratio(F.col("neg") * 100, F.col("n")) + 1) / (1 + F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("lag_days") / 2))))
    g = g.withColumn("raw", raw)
    g = g.crossJoin(g.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")))
    scaled = F.when(F.col("hi") == F.col("lo"), 50.0).otherwise(F.round((F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100, 3))
    return g.select("platform_id", "region", "n", F.round("lag_days", 4).alias("lag_days"), scaled.alias("influence"))


@query("""select count(*)::bigint as total, round(100.0 * count(*) filter (label = 'negative') / count(*), 2)::double as neg_pct,
  (select count(*) from (select product_id from active where collected_at >= timestamp '2024-01-24' and product_id is not null group by 1 having count(*) >= 10 and count(*) filter (label = 'negative') > 0.15 * count(*)))::bigint as alert_products
from active where collected_at >= timestamp '2024-01-24'""", share=0.15)
def dash_overview(t: Tables, days: int = 7, share: float = 0.5) -> DataFrame:
    v = t.recent(t.active, days)
    by = v.filter("product_id is not null").groupBy("product_id").agg(F.count("*").alias("n"), count_label("negative").alias("neg"))
    alert = by.agg(F.count_if((F.col("n") >= 10) & (F.col("neg") > share * F.col("n"))).alias("alert_products"))
    kpi = v.agg(F.count("*").alias("total"), F.round(ratio(count_label("negative") * 100, F.count("*")), 2).alias("neg_pct"))
    return kpi.crossJoin(alert)


@query("""select d.d::date as day, count(v.id)::bigint as n, count(v.id) filter (label = 'negative')::bigint as neg from range(date '2024-01-17', date '2024-01-31', interval 1 day) d(d) left join active v on v.published_at::date = d.d::date group by 1""")
def chart_daily_filled(t: Tables, days: int = 14) -> DataFrame:
    domain = t.spark.range(days).select(F.date_sub(t.anchor, F.col("id").cast("int")).alias("day"))
    g = t.window(t.active, days).groupBy(day().alias("day")).agg(F.count("*").alias("n"), count_label("negative").alias("neg"))
    return domain.join(g, "day", "left").na.fill(0, ["n", "neg"])


@query("""select source as node, sum(weight)::bigint as weight, count(*)::bigint as edges from (select source, target, sum(weight) as weight from (
    select 'product:' || product_id::varchar as source, 'category:' || category as target, count(*) as weight from cats where product_id is not null group by 1, 2
    union all select 'product:' || product_id::varchar, 'platform:' || platform_id::varchar, count(*) from posts where product_id is not null group by 1, 2
    union all select 'product:' || product_id::varchar, 'country:' || country_code, count(*) from posts where product_id is not null and country_code is not null group by 1, 2) group by 1, 2 having sum(weight) >= 5) group by 1""")
def kg_graph(t: Tables, floor: int = 5) -> DataFrame:
    """Products of the knowledge graph with the summed weights of their edges, from the stored rollup."""
    e = stored_edges(t).groupBy("source", "target").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= floor)
    return e.groupBy(F.col("source").alias("node")).agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))


@query("""select kind, key, score from (select 'keyword' as kind, keyword as key, case when keyword = 'kw1' then 100 when keyword like 'kw1%' then 60 else 40 end + least(count(*), 50)::bigint as score from kws where keyword like '%kw1%' group by 2
  union all select 'product', code, case when lower(code) = 'p1' then 100 when lower(code) like 'p1%' then 60 else 40 end from products where lower(code) like '%p1%') order by score desc, kind, key limit 12""")
def kg_search(t: Tables, word: str = "kw1", product: str = "p1", top: int = 12) -> DataFrame:
    """Typed hits: exact, prefix and inner matches, keywords with a bonus by frequency."""
    rank = lambda c, q: F.when(c == q, 100).when(c.startswith(q), 60).otherwise(40)
    k = t.keywords.filter(F.col("keyword").contains(word)).groupBy("keyword").count()
    k = k.select(F.lit("keyword").alias("kind"), F.col("keyword").alias("key"), (rank(F.col("keyword"), word) + F.least("count", F.lit(50))).cast("long").alias("score"))
    p = t.products.filter(F.lower("code").contains(product)).select(F.lit("product").alias("kind"), F.col("code").alias("key"), rank(F.lower("code"), product).cast("long").alias("score"))
    return k.unionByName(p).orderBy(F.desc("score"), "kind", "key").limit(top)
