"""The further parts of analyses that give several results: what a page about a product, a day, a case or the whole shows beside its first table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, label_score, ratio
from feedloom.operators.deep import deep_sentiment_driver
from feedloom.operators.rollups import stored_edges
from feedloom.plans.graphs import connected_components
from feedloom.plans.registry import query
from feedloom.plans.storage import cut
from feedloom.sources.posts import Tables


def firsts(df: DataFrame, keys: list[str], name: str, k: int, alias: str) -> DataFrame:
    """Of each group the k most frequent names, of equal ones the first by name, joined by a bar."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), name))
    best = df.withColumn("__r", r).filter(F.col("__r") <= k)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__r", name))), lambda x: x[name]), "|").alias(alias))


_NOW = "published_at::date > date '2024-01-15' and published_at::date <= date '2024-01-30'"


@query(f"""select k.keyword, k.language, before, after, round((after - before) * 100, 2) as delta_pp, top from (select keyword, language, round(b, 4) as before, round(a, 4) as after, a - b as d from (select keyword, language, count(*) filter (now) as na, count(*) filter (not now) as nb,
    count(*) filter (now and label = 'negative')::double / nullif(count(*) filter (now), 0) as a, count(*) filter (not now and label = 'negative')::double / nullif(count(*) filter (not now), 0) as b
    from (select *, published_at::date > date '2024-01-15' as now from amentions where published_at::date > date '2024-01-01' and published_at::date <= date '2024-01-30') group by 1, 2) where na >= 5 and nb >= 5 order by round(a - b, 4) desc, keyword, language limit 20) k
  left join (select keyword, language, string_agg(c, '|' order by r) as top from (select keyword, language, c, row_number() over (partition by keyword, language order by count(*) desc, c) as r from (select keyword, language, unnest(categories) as c from amentions where {_NOW}) group by 1, 2, 3) where r <= 3 group by 1, 2) x
    on x.keyword = k.keyword and x.language is not distinct from k.language""")
def deep_sentiment_drivers_top(t: Tables, days: int = 29, floor: int = 5, top: int = 20, k: int = 3) -> DataFrame:
    """The keywords whose negative rate rose most, with the categories that come up with them most often."""
    best = deep_sentiment_driver(t, days, floor).orderBy(F.desc("delta"), "keyword", "language").limit(top)
    now = t.mentions(t.window(t.active, days).filter(day() > F.date_sub(t.anchor, 15)))
    near = now.join(best.select("keyword").distinct(), "keyword", "left_semi").select("keyword", "language", F.explode("categories").alias("category")).groupBy("keyword", "language", "category").agg(F.count("*").alias("n"))
    tops = firsts(near, ["keyword", "language"], "category", k, "top").select(F.col("keyword").alias("k2"), F.col("language").alias("l2"), "top")
    rows = best.join(tops, (F.col("keyword") == F.col("k2")) & F.col("language").eqNullSafe(F.col("l2")), "left")
    return rows.select("keyword", "language", "before", "after", F.round((F.col("after") - F.col("before")) * 100, 2).alias("delta_pp"), "top")


#: Stages of a product's life in days from its release; the last is as long as the period.
STAGES = (("release", -7, 0), ("awareness", 1, 14), ("interest", 15, 30), ("consideration", 31, 60), ("use", 61, 120), ("leaving", 121, 365))
_STAGE_ROWS = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in STAGES)
_STAGES = f"(select s.*, p.id as pid, p.code, released_at, released_at + lo as first, least(released_at + hi, date '2024-01-30') as last from (values {_STAGE_ROWS}) s(stage, lo, hi), products p)"


@query(f"""select s.code, s.stage, case when first > date '2024-01-30' then released_at + hi else last end as last, first, coalesce(n, 0)::bigint as n, round(coalesce(score, 0), 4) as score, coalesce(top, '') as top from {_STAGES} s
  left join (select code, stage, count(*) as n, avg(case label when 'positive' then 1.0 when 'negative' then -1.0 else 0.0 end) as score from {_STAGES} s join active v on v.product_id = pid and v.published_at::date between first and last group by 1, 2) a using (code, stage)
  left join (select code, stage, string_agg(keyword, '|' order by r) as top from (select code, stage, keyword, row_number() over (partition by code, stage order by count(*) desc, keyword) as r from {_STAGES} s join amentions v on v.product_id = pid and v.published_at::date between first and last group by 1, 2, 3) where r <= 5 group by 1, 2) b using (code, stage)""")
def deep_product_stages(t: Tables, stages=STAGES, k: int = 5) -> DataFrame:
    """Posts, mean label and top keywords of every stage of every product since its release; stages that haven't begun are empty."""
    stage = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in stages])
    p = t.products.filter("released_at is not null").select(F.col("id").alias("product_id"), "code", "released_at", F.explode(stage).alias("s")).select("product_id", "code", "s.stage", F.date_add("released_at", F.col("s.lo")).alias("first"), F.date_add("released_at", F.col("s.hi")).alias("end"))
    p = p.withColumn("last", F.least("end", t.anchor))
    v = t.active.withColumn("d", day())
    # by product and day first: the stages then meet a row a day
    inside = lambda df: df.join(p.select("product_id", "stage", "first", "last"), "product_id").filter(F.col("d").between(F.col("first"), F.col("last")))
    points = F.when(F.col("label") == "positive", 1).when(F.col("label") == "negative", -1).otherwise(0)
    g = inside(v.groupBy("product_id", "d").agg(F.count("*").alias("n"), F.sum(points).alias("s"))).groupBy("product_id", "stage").agg(F.sum("n").alias("n"), ratio(F.sum("s"), F.sum("n")).alias("score"))
    words = inside(t.mentions(t.active).withColumn("d", day()).groupBy("product_id", "d", "keyword").agg(F.count("*").alias("n"))).groupBy("product_id", "stage", "keyword").agg(F.sum("n").alias("n"))
    out = p.join(g, ["product_id", "stage"], "left").join(firsts(words, ["product_id", "stage"], "keyword", k, "top"), ["product_id", "stage"], "left")
    return out.select("code", "stage", "first", F.when(F.col("first") > t.anchor, F.col("end")).otherwise(F.col("last")).alias("last"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.coalesce("top", F.lit("")).alias("top"))


#: Cases: a name, the product's code and the first and last day.
CASES = (("one", "P1", "2024-01-05", "2024-01-12"), ("two", "P2", "2024-01-10", "2024-01-20"), ("three", "P3", "2024-01-02", "2024-01-28"), ("four", "P8", "2024-01-15", "2024-01-18"), ("none", "P77", "2024-01-01", "2024-01-30"))
_CASE_ROWS = ", ".join(f"('{n}', '{c}', date '{a}', date '{b}')" for n, c, a, b in CASES)
_CASES = f"(select c.*, p.id as pid from (values {_CASE_ROWS}) c(name, code, lo, hi) left join products p on p.code = c.code)"


def case_posts(t: Tables, posts: DataFrame, cases=CASES) -> DataFrame:
    """Posts with the name of each case that they fall into. Cases of other products go before the join."""
    c = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("code"), F.to_date(F.lit(a)).alias("lo"), F.to_date(F.lit(b)).alias("hi")) for n, p, a, b in cases])).alias("c")).select("c.*")
    c = c.join(t.products.select(F.col("id").alias("product_id"), "code"), "code")
    return posts.join(c, "product_id").filter(day().between(F.col("lo"), F.col("hi")))


@query(f"""select c.name, c.code, coalesce(n, 0)::bigint as n, coalesce(neg_rate, 0.0) as neg_rate, peak_day, coalesce(peak, 0)::bigint as peak, coalesce(keywords, '') as keywords, coalesce(sites, '') as sites from {_CASES} c
  left join (select name, count(*) as n, round(count(*) filter (label = 'negative')::double / count(*), 4) as neg_rate from {_CASES} c join active v on v.product_id = pid and published_at::date between lo and hi group by 1) a using (name)
  left join (select name, arg_min(d, (-k, d)) as peak_day, max(k) as peak from (select name, published_at::date as d, count(*) as k from {_CASES} c join active v on v.product_id = pid and published_at::date between lo and hi group by 1, 2) group by 1) p using (name)
  left join (select name, string_agg(keyword, '|' order by r) as keywords from (select name, keyword, row_number() over (partition by name order by count(*) desc, keyword) as r from {_CASES} c join amentions v on v.product_id = pid and published_at::date between lo and hi group by 1, 2) where r <= 10 group by 1) k using (name)
  left join (select name, string_agg(site, '|' order by r) as sites from (select name, f.code as site, row_number() over (partition by name order by count(*) desc, f.code) as r from {_CASES} c join active v on v.product_id = pid and published_at::date between lo and hi join platforms f on f.id = v.platform_id group by 1, 2) where r <= 10 group by 1) s using (name)""")
def deep_crisis_summary(t: Tables, cases=CASES, k: int = 10) -> DataFrame:
    """Each case with its posts, negative rate, peak day, top keywords and top sites; a case of an unknown product is empty."""
    v = case_posts(t, t.active, cases)
    daily = v.groupBy("name", day().alias("d")).agg(F.count("*").alias("n"), count_label("negative").alias("neg"))
    g = daily.groupBy("name").agg(F.sum("n").alias("n"), F.round(ratio(F.sum("neg"), F.sum("n")), 4).alias("neg_rate"), F.min(F.struct((-F.col("n")).alias("k"), "d")).alias("x"))
    words = case_posts(t, t.mentions(t.active), cases).groupBy("name", "keyword").agg(F.count("*").alias("n"))
    sites = v.groupBy("name", "platform_id").agg(F.count("*").alias("n")).join(t.platforms.select(F.col("id").alias("platform_id"), F.col("code").alias("site")), "platform_id")
    all_ = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("code")) for n, c, _, _ in cases])).alias("c")).select("c.*")
    out = all_.join(g, "name", "left").join(firsts(words, ["name"], "keyword", k, "keywords"), "name", "left").join(firsts(sites, ["name"], "site", k, "sites"), "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("name", "code", zero(F.col("n")).alias("n"), F.coalesce("neg_rate", F.lit(0.0)).alias("neg_rate"), F.col("x.d").alias("peak_day"), zero(-F.col("x.k")).alias("peak"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("sites", F.lit("")).alias("sites"))


@query(f"""select name, d as day, n, n = max(n) over (partition by name) as peak from (select name, published_at::date as d, count(*)::bigint as n from {_CASES} c join active v on v.product_id = pid and published_at::date between lo and hi group by 1, 2)""")
def chart_crisis_timeline(t: Tables, cases=CASES) -> DataFrame:
    """Posts by day of each case; the days of most posts are marked."""
    g = case_posts(t, t.active, cases).groupBy("name", day().alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("peak", F.col("n") == F.max("n").over(Window.partitionBy("name")))


@query("""select round(case when coalesce(sd, 0) = 0 then 0 else (c - mu) / sd end, 3) as z, c::double as value, round(mu, 2) as baseline, category from (select category, max(c) filter (d = date '2024-01-20') as c, avg(c) filter (d < date '2024-01-20') as mu, stddev_samp(c) filter (d < date '2024-01-20') as sd
  from (select published_at::date as d, category, count(*) as c from acats where published_at::date between date '2024-01-06' and date '2024-01-20' group by 1, 2) group by 1) where c is not null and mu is not null order by case when coalesce(sd, 0) = 0 then 0 else (c - mu) / sd end desc, category limit 1""", date="2024-01-20")
def deep_anomaly_summary(t: Tables, date: str, lookback: int = 14) -> DataFrame:
    """The category that stands out most on a day, against its days before."""
    d = F.to_date(F.lit(date))
    daily = t.by_category(t.active.filter(day().between(F.date_sub(d, lookback), d))).groupBy(day().alias("d"), "category").agg(F.count("*").alias("c"))
    before = F.when(F.col("d") < d, F.col("c"))
    g = daily.groupBy("category").agg(F.max(F.when(F.col("d") == d, F.col("c"))).alias("c"), F.avg(before).alias("mu"), F.stddev_samp(before).alias("sd")).filter("c is not null and mu is not null")
    z = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 0.0).otherwise((F.col("c") - F.col("mu")) / F.col("sd"))
    return g.withColumn("z", z).orderBy(F.desc("z"), "category").limit(1).select(F.round("z", 3).alias("z"), F.col("c").cast("double").alias("value"), F.round("mu", 2).alias("baseline"), "category")


@query("""select h.h::bigint as hour, count(v.id)::bigint as n, round(coalesce(avg(case when v.id is null then null when label = 'positive' then 1.0 when label = 'negative' then -1.0 else 0.0 end), 0), 4) as score, round(coalesce(count(v.id) filter (label = 'negative')::double / nullif(count(v.id), 0), 0), 4) as neg_rate
  from range(24) h(h) left join active v on v.published_at::date = date '2024-01-20' and hour(published_at) = h.h group by 1""", date="2024-01-20")
def deep_anomaly_hours(t: Tables, date: str) -> DataFrame:
    """All 24 hours of a day, those without posts with zeros."""
    g = t.active.filter(day() == F.to_date(F.lit(date))).groupBy(F.hour("published_at").cast("long").alias("hour")).agg(F.count("*").alias("n"), label_score().alias("s"), ratio(count_label("negative"), F.count("*")).alias("r"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return t.spark.range(24).withColumnRenamed("id", "hour").join(g, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("s").alias("score"), zero("r").alias("neg_rate"))


_DAYWORDS = "(select keyword, language, count(*) filter (published_at::date = date '2024-01-20') as now, count(*) filter (published_at::date < date '2024-01-20') / 14.0::double as before from amentions where published_at::date between date '2024-01-06' and date '2024-01-20' group by 1, 2)"


@query(f"""select k.keyword, k.language, now::bigint as n, round((now - before) / greatest(before, 1.0) * 100, 2) as delta_pct, coalesce(related, '') as related from (select * from {_DAYWORDS} where now >= 2 order by now desc, keyword, language limit 15) k
  left join (select keyword, string_agg(code, '|' order by r) as related from (select keyword, p.code, row_number() over (partition by keyword order by count(*) desc, p.code) as r from amentions v join products p on p.id = v.product_id where published_at::date = date '2024-01-20' group by 1, 2) where r <= 3 group by 1) x using (keyword)""", date="2024-01-20")
def deep_anomaly_keywords(t: Tables, date: str, floor: int = 2, top: int = 15, lookback: int = 14, k: int = 3) -> DataFrame:
    """The keywords of a day with their growth over the mean of the days before, and the products that they come up with."""
    d = F.to_date(F.lit(date))
    g = t.mentions(t.active.filter(day().between(F.date_sub(d, lookback), d))).groupBy("keyword", "language").agg(F.count_if(day() == d).alias("n"), (F.count_if(day() < d) / float(lookback)).alias("before"))
    best = g.filter(F.col("n") >= floor).orderBy(F.desc("n"), "keyword", "language").limit(top)
    on = t.mentions(t.active.filter(day() == d)).join(best.select("keyword").distinct(), "keyword", "left_semi").groupBy("keyword", "product_id").agg(F.count("*").alias("n"))
    on = on.join(t.products.select(F.col("id").alias("product_id"), "code"), "product_id")
    out = best.join(firsts(on, ["keyword"], "code", k, "related"), "keyword", "left")
    return out.select("keyword", "language", "n", F.round((F.col("n") - F.col("before")) / F.greatest("before", F.lit(1.0)) * 100, 2).alias("delta_pct"), F.coalesce("related", F.lit("")).alias("related"))


def _filtered(t: Tables, posts: DataFrame, product: str | None, country: str | None, platform: str | None) -> DataFrame:
    if product is not None:
        posts = posts.join(t.products.filter(F.col("code") == product.upper()).select(F.col("id").alias("product_id")), "product_id", "left_semi")
    if country is not None:
        posts = posts.filter(F.col("country_code") == country.upper())
    if platform is not None:
        posts = posts.join(t.platforms.filter(F.col("code") == platform).select(F.col("id").alias("platform_id")), "platform_id", "left_semi")
    return posts


@query("""select count(*)::bigint as total, coalesce(round(100.0::double * count(*) filter (label = 'negative') / nullif(count(*), 0), 1), 0) as neg_rate, (select p.code from active v join products p on p.id = v.product_id where collected_at >= timestamp '2024-01-24' and country_code = 'C1' group by 1 order by count(*) desc, 1 limit 1) as top_product,
  (select count(*) from (select product_id from active where collected_at >= timestamp '2024-01-24' and country_code = 'C1' and product_id in (select id from products) group by 1 having count(*) >= 10 and 100.0 * count(*) filter (label = 'negative') / count(*) > 15))::bigint as alerts
  from active where collected_at >= timestamp '2024-01-24' and country_code = 'C1'""", country="c1", share=15.0)
def dash_kpis(t: Tables, days: int = 7, product: str | None = None, country: str | None = None, platform: str | None = None, floor: int = 10, share: float = 50.0) -> DataFrame:
    """The head of the overview under its filters: posts, negative percent, the product of most posts, and products with enough posts of which too many are negative."""
    v = _filtered(t, t.recent(t.active, days), product, country, platform)
    by = v.groupBy("product_id").agg(F.count("*").alias("n"), count_label("negative").alias("neg"))
    named = by.join(t.products.select(F.col("id").alias("product_id"), "code"), "product_id")
    all_ = by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.round(ratio(F.sum("neg") * 100, F.sum("n")), 1), F.lit(0.0)).alias("neg_rate"))
    head = named.agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("top_product"), F.count_if((F.col("n") >= floor) & (ratio(F.col("neg") * 100, F.col("n")) > share)).alias("alerts"))
    return all_.crossJoin(head)


@query("select collected_at::date as day, count(*)::bigint as n, round(avg(score), 3) as score from active v join products p on p.id = v.product_id where collected_at >= timestamp '2024-01-17' and p.code = 'P3' group by 1", product="p3")
def dash_trend(t: Tables, days: int = 14, product: str | None = None, country: str | None = None, platform: str | None = None) -> DataFrame:
    v = _filtered(t, t.recent(t.active, days), product, country, platform)
    return v.groupBy(day("collected_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score"))


@query("select f.code, count(*)::bigint as n, round(avg(score), 3) as score from active v join platforms f on f.id = v.platform_id where collected_at >= timestamp '2024-01-24' group by 1 order by n desc, code limit 5")
def dash_sites(t: Tables, days: int = 7, top: int = 5, product: str | None = None, country: str | None = None, platform: str | None = None) -> DataFrame:
    g = _filtered(t, t.recent(t.active, days), product, country, platform).groupBy("platform_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score"))
    return g.join(t.platforms.select(F.col("id").alias("platform_id"), "code"), "platform_id").orderBy(F.desc("n"), "code").limit(top).select("code", "n", "score")


def kg_edges_top(t: Tables, first: str, last: str, floor: int, top: int, kinds=(), products=()) -> DataFrame:
    """The heaviest edges of the graph in a period, with the mean of their daily scores by weight; days without a score weigh in the denominator."""
    e = stored_edges(t).filter(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    if kinds:
        e = e.filter(F.col("edge_type").isin(*kinds))
    if products:
        e = e.filter(F.col("source").isin(*[f"product:{p}" for p in products]))
    g = e.groupBy("source", "target", "edge_type").agg(F.sum("weight").alias("weight"), F.round(ratio(F.sum(F.col("sent_avg") * F.col("weight")), F.sum("weight")), 4).alias("score")).filter(F.col("weight") >= floor)
    return g.orderBy(F.desc("weight"), "source", "target").limit(top)


_EDGES = """(select source, target, edge_type, sum(weight)::bigint as weight, round(sum(sent_avg * weight) / sum(weight), 4) as score from (
  select collected_at::date as day, 'product-category' as edge_type, 'product:' || product_id::varchar as source, 'category:' || category as target, count(*) as weight, round(avg(score), 10) as sent_avg from cats where product_id is not null group by all
  union all select collected_at::date, 'product-platform', 'product:' || product_id::varchar, 'platform:' || platform_id::varchar, count(*), round(avg(score), 10) from posts where product_id is not null group by all
  union all select collected_at::date, 'product-country', 'product:' || product_id::varchar, 'country:' || country_code, count(*), round(avg(score), 10) from posts where product_id is not null and country_code is not null group by all)
  where day between date '2024-01-03' and date '2024-01-28' group by 1, 2, 3 having sum(weight) >= 5 order by weight desc, source, target limit 80)"""


@query(f"select * from {_EDGES}", first="2024-01-03", last="2024-01-28")
def kg_links(t: Tables, first: str, last: str, floor: int = 5, top: int = 80) -> DataFrame:
    return kg_edges_top(t, first, last, floor, top)


@query(f"select node, split_part(node, ':', 1) as kind, sum(weight)::bigint as weight, round(sum(score * weight) / sum(weight), 4) as score from (select source as node, weight, score from {_EDGES} union all select target, weight, score from {_EDGES}) group by 1", first="2024-01-03", last="2024-01-28")
def kg_nodes(t: Tables, first: str, last: str, floor: int = 5, top: int = 80) -> DataFrame:
    """Both ends of the heaviest edges, of every kind, with the edges' weight and mean score."""
    e = cut(kg_edges_top(t, first, last, floor, top))
    both = e.select(F.col("source").alias("node"), "weight", "score").union(e.select("target", "weight", "score"))
    return both.groupBy("node").agg(F.sum("weight").alias("weight"), F.round(ratio(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 4).alias("score")).select("node", F.substring_index("node", ":", 1).alias("kind"), "weight", "score")


@query("select country_code as country, count(*)::bigint as n, round(avg(score), 3) as score from active v join products p on p.id = v.product_id where country_code is not null and p.code = 'P4' group by 1 order by n desc, country limit 15", product="p4")
def chart_country_distribution(t: Tables, product: str | None = None, top: int = 15) -> DataFrame:
    v = _filtered(t, t.active.filter("country_code is not null"), product, None, None)
    return v.groupBy(F.col("country_code").alias("country")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score")).orderBy(F.desc("n"), "country").limit(max(1, min(top, 50)))


@query("select category, count(*)::bigint as n, round(avg(score), 3) as score from acats group by 1 order by n desc, category limit 15")
def chart_category_distribution(t: Tables, product: str | None = None, top: int = 15) -> DataFrame:
    v = t.by_category(_filtered(t, t.active, product, None, None))
    return v.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score")).orderBy(F.desc("n"), "category").limit(max(1, min(top, 50)))


@query("""select p.code as product, date_trunc('week', published_at)::date as period, count(*)::bigint as n, round(avg(score), 3) as score from active v join products p on p.id = v.product_id where p.code in ('P1', 'P2', 'P7') and published_at >= timestamp '2024-01-31' - interval 90 day group by 1, 2""", products=("p1", "p2", "p7"))
def chart_sentiment_series(t: Tables, products: tuple[str, ...], days: int = 90, bucket: str = "week") -> DataFrame:
    p = t.products.filter(F.col("code").isin(*[c.upper() for c in products])).select(F.col("id").alias("product_id"), F.col("code").alias("product"))
    v = t.active.filter(F.col("published_at") >= t.as_of - F.expr(f"interval {days} days")).join(p, "product_id")
    return v.groupBy("product", F.to_date(F.date_trunc(bucket, "published_at")).alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score"))


def keyword_graph(t: Tables, days: int, floor: int, most: int, product: str | None) -> tuple[DataFrame, DataFrame]:
    """Edges between keywords that come up together, and the nodes of greatest degree with their community among themselves. The edges are written once."""
    v = _filtered(t, t.active.filter(F.col("published_at") >= t.as_of - F.expr(f"interval {days} days")), product, None, None)
    words = v.select(F.col("id").alias("post_id"), "language").join(t.keywords, "post_id").select("post_id", "keyword", "language").distinct()
    a, b = words.select("post_id", F.col("keyword").alias("a")), words.select("post_id", F.col("keyword").alias("b"))
    edges = cut(a.join(b, "post_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("w")).filter(F.col("w") >= floor))
    degree = edges.select(F.col("a").alias("keyword"), "w").union(edges.select("b", "w")).groupBy("keyword").agg(F.sum("w").alias("degree"))
    best = cut(degree.orderBy(F.desc("degree"), "keyword").limit(most))  # at most `most` rows
    name = lambda c: best.select(F.col("keyword").alias(c))
    inner = cut(edges.join(name("a"), "a", "left_semi").join(name("b"), "b", "left_semi"))
    count = words.join(best.select("keyword"), "keyword", "left_semi").groupBy("keyword").agg(F.count("*").alias("n"), F.mode("language", True).alias("language"))
    community = connected_components(inner.select("a", "b")).select(F.col("node").alias("keyword"), F.col("component").alias("community"))
    nodes = best.join(count, "keyword").join(community, "keyword", "left").select("keyword", "degree", "n", "language", F.coalesce("community", "keyword").alias("community"))
    return inner, nodes


_PAIRS = """(select a.keyword as a, b.keyword as b, count(*)::bigint as w from (select distinct post_id, keyword from kws) a join (select distinct post_id, keyword from kws) b on a.post_id = b.post_id and a.keyword < b.keyword
  join active v on v.id = a.post_id and published_at >= timestamp '2024-01-31' - interval 10 day where product_id = 5 group by 1, 2 having count(*) >= 3)"""
_BEST = f"(select keyword, sum(w)::bigint as degree from (select a as keyword, w from {_PAIRS} union all select b, w from {_PAIRS}) group by 1 order by degree desc, keyword limit 20)"


@query(f"select a, b, w from {_PAIRS} where a in (select keyword from {_BEST}) and b in (select keyword from {_BEST})", days=10, product="p5", most=20)
def chart_keyword_links(t: Tables, days: int = 30, floor: int = 3, most: int = 40, product: str | None = None) -> DataFrame:
    return keyword_graph(t, days, max(2, floor), max(5, min(most, 80)), product)[0]


@query(f"""with recursive best as materialized (select * from {_BEST}), e as materialized (select a, b from {_PAIRS} where a in (select keyword from best) and b in (select keyword from best)), both_ as materialized (select a, b from e union select b, a from e union select keyword, keyword from best),
  r(a, b) as (select a, b from both_ union select r.a, x.b from r join both_ x on x.a = r.b), c as (select a as keyword, min(b) as community from r group by 1)
  select keyword, degree, n, language, community from best join c using (keyword) join (select keyword, sum(k)::bigint as n, arg_min(language, (-k, language)) as language from (select keyword, language, count(*) as k from (select distinct post_id, keyword from kws) x join active v on v.id = x.post_id where published_at >= timestamp '2024-01-31' - interval 10 day and product_id = 5 group by 1, 2) group by 1) using (keyword)""".replace("with recursive best", "select * from (with recursive best") + ")", days=10, product="p5", most=20)
def chart_keyword_nodes(t: Tables, days: int = 30, floor: int = 3, most: int = 40, product: str | None = None) -> DataFrame:
    return keyword_graph(t, days, max(2, floor), max(5, min(most, 80)), product)[1]


@query("""select c.code, coalesce(n, 0)::bigint as n, round(coalesce(score, 0), 4) as score, coalesce(neg, 0)::bigint as neg, coalesce(pos, 0)::bigint as pos, coalesce(categories, '') as categories, coalesce(keywords, '') as keywords from (values ('P2'), ('P6'), ('P99')) c(code)
  left join (select p.code, count(*) as n, avg(score) as score, count(*) filter (label = 'negative') as neg, count(*) filter (label = 'positive') as pos from active v join products p on p.id = v.product_id where published_at::date between date '2024-01-30' - 14 and date '2024-01-30' group by 1) a using (code)
  left join (select code, string_agg(category, '|' order by r) as categories from (select p.code, category, row_number() over (partition by p.code order by count(*) desc, category) as r from acats v join products p on p.id = v.product_id where published_at::date between date '2024-01-30' - 14 and date '2024-01-30' group by 1, 2) where r <= 3 group by 1) b using (code)
  left join (select code, string_agg(keyword, '|' order by r) as keywords from (select p.code, keyword, row_number() over (partition by p.code order by count(*) desc, keyword) as r from mentions v join products p on p.id = v.product_id where label = 'negative' and published_at::date between date '2024-01-30' - 14 and date '2024-01-30' group by 1, 2) where r <= 5 group by 1) k using (code)""", products=("p2", "P6", "p99"), days=14)
def ins_compare_payload(t: Tables, products: tuple[str, ...], days: int = 30) -> DataFrame:
    """What a comparison of products starts from: their figures, top categories, and the keywords of their negative posts, archived ones too; unknown products have none."""
    codes = [c.upper() for c in products]
    p = t.products.filter(F.col("code").isin(*codes)).select(F.col("id").alias("product_id"), "code")
    v = t.since(t.active, days).join(p, "product_id")
    g = v.groupBy("code").agg(F.count("*").alias("n"), F.avg("score").alias("score"), count_label("negative").alias("neg"), count_label("positive").alias("pos"))
    cats = t.by_category(v).groupBy("code", "category").agg(F.count("*").alias("n"))
    bad = t.mentions(t.since(t.posts.filter("label = 'negative'"), days).join(p, "product_id")).groupBy("code", "keyword").agg(F.count("*").alias("n"))
    all_ = t.spark.range(1).select(F.explode(F.array(*map(F.lit, codes))).alias("code"))
    out = all_.join(g, "code", "left").join(firsts(cats, ["code"], "category", 3, "categories"), "code", "left").join(firsts(bad, ["code"], "keyword", 5, "keywords"), "code", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("code", zero("n"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), zero("neg"), zero("pos"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("keywords", F.lit("")).alias("keywords"))
