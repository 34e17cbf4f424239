"""Details behind an analysis: the rows, breakdowns and searches that a user opens next, and the aggregates, sorts and
set operations that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, engagement, has, ratio
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables

#: Negative posts first, positive last.
_URGENCY = "case when label = 'negative' then 0 when label = 'positive' then 2 else 1 end"


def _named(t: Tables, posts: DataFrame) -> DataFrame:
    p = t.products.select(F.col("id").alias("product_id"), F.col("code").alias("product"))
    f = t.platforms.select(F.col("id").alias("platform_id"), F.col("code").alias("platform"))
    return posts.join(p, "product_id", "left").join(f, "platform_id", "left")


_JOINED = "left join products p on p.id = v.product_id left join platforms f on f.id = v.platform_id"


@query(f"""select v.id, p.code as product, f.code as platform, body[:200] as preview, label, round(score, 4) as score, likes + comments + shares as eng, (select count(*) from active where published_at::date = date '2024-01-20' and hour(published_at) = 9)::bigint as total
from active v {_JOINED} where published_at::date = date '2024-01-20' and hour(published_at) = 9 order by {_URGENCY}, eng desc, v.id desc limit 20""", date="2024-01-20", hour=9)
def deep_anomaly_drilldown_hour(t: Tables, date: str, hour: int, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of one hour's posts, the most urgent first, with how many there are."""
    v = t.active.filter((day() == F.to_date(F.lit(date))) & (F.hour("published_at") == hour)).withColumn("eng", engagement())
    page = v.orderBy(F.expr(_URGENCY), F.desc("eng"), F.desc("id")).offset(offset).limit(limit)
    return _named(t, page).crossJoin(v.agg(F.count("*").alias("total"))).select("id", "product", "platform", F.substring("body", 1, 200).alias("preview"), "label", F.round("score", 4).alias("score"), "eng", "total")


def keyword_posts(t: Tables, keyword: str, days: int, language: str | None = None) -> DataFrame:
    """Posts of the days that hold a keyword; the keyword is filtered before the join."""
    k = t.keywords.filter(F.col("keyword") == keyword).select(F.col("post_id").alias("id"))
    v = t.since(t.active, days)
    return (v if language is None else v.filter(F.col("language") == language)).join(k, "id")


_OF = "from (select * from amentions where keyword = 'kw5' and published_at::date between date '2024-01-30' - 7 and date '2024-01-30') v"


@query(f"select count(distinct v.id)::bigint as n, round(avg(score), 8) as score {_OF}", keyword="kw5")
def deep_keyword_stats(t: Tables, keyword: str, days: int = 7) -> DataFrame:
    return keyword_posts(t, keyword, days).agg(F.count_distinct("id").alias("n"), F.round(F.avg("score"), 8).alias("score"))


@query(f"select v.id, body[:200] as preview, label, p.code as product, f.code as platform {_OF} {_JOINED} order by {_URGENCY}, published_at desc nulls last, v.id desc limit 5", keyword="kw5")
def deep_keyword_samples(t: Tables, keyword: str, days: int = 7, limit: int = 5) -> DataFrame:
    v = keyword_posts(t, keyword, days).orderBy(F.expr(_URGENCY), F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)
    return _named(t, v).select("id", F.substring("body", 1, 200).alias("preview"), "label", "product", "platform")


@query(f"select unnest(categories) as category, count(*)::bigint as n {_OF} group by 1 order by n desc, category limit 8", keyword="kw5")
def deep_keyword_categories(t: Tables, keyword: str, days: int = 7, top: int = 8) -> DataFrame:
    return t.by_category(keyword_posts(t, keyword, days)).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


@query(f"""select * from (select 'product' as kind, p.code, count(*)::bigint as n {_OF} join products p on p.id = v.product_id group by 2 order by n desc, code limit 5)
union all select * from (select 'platform', f.code, count(*)::bigint as n {_OF} join platforms f on f.id = v.platform_id group by 2 order by n desc, code limit 5)""", keyword="kw5")
def deep_keyword_places(t: Tables, keyword: str, days: int = 7, top: int = 5) -> DataFrame:
    """The products and the platforms where a keyword comes up most."""
    v = keyword_posts(t, keyword, days)

    def best(kind: str, dim: DataFrame) -> DataFrame:
        g = v.groupBy(F.col(f"{kind}_id").alias("id")).agg(F.count("*").alias("n")).join(dim.select("id", "code"), "id")
        return g.orderBy(F.desc("n"), "code").limit(top).select(F.lit(kind).alias("kind"), "code", "n")

    return best("product", t.products).union(best("platform", t.platforms))


@query(f"""select 'hour' as part, hour(published_at)::varchar as name, count(*)::bigint as n, count(*) filter (label = 'negative')::bigint as neg from active where published_at::date = date '2024-01-20' group by 2
union all select * from (select 'category', category, count(*)::bigint as n, count(*) filter (label = 'negative')::bigint from acats where published_at::date = date '2024-01-20' group by 2 order by n desc, category limit 10)
union all select * from (select 'product', coalesce(p.code, 'none'), count(*)::bigint as n, count(*) filter (label = 'negative')::bigint from active v {_JOINED} where published_at::date = date '2024-01-20' group by 2 order by n desc, 2 limit 10)
union all select * from (select 'platform', coalesce(f.code, 'none'), count(*)::bigint as n, count(*) filter (label = 'negative')::bigint from active v {_JOINED} where published_at::date = date '2024-01-20' group by 2 order by n desc, 2 limit 10)""", date="2024-01-20")
def deep_anomaly_drilldown_parts(t: Tables, date: str, top: int = 10) -> DataFrame:
    """One day by hour, category, product and platform. The day's posts are pruned before each part."""
    v = _named(t, t.active.filter(day() == F.to_date(F.lit(date))))

    def part(name: str, df: DataFrame, by: Column, limit: int | None) -> DataFrame:
        g = df.groupBy(by.alias("name")).agg(F.count("*").alias("n"), count_label("negative").alias("neg"))
        return (g if limit is None else g.orderBy(F.desc("n"), "name").limit(limit)).select(F.lit(name).alias("part"), "name", "n", "neg")

    none = lambda c: F.coalesce(c, F.lit("none"))
    return part("hour", v, F.hour("published_at").cast("string"), None).union(part("category", t.by_category(v), F.col("category"), top)).union(part("product", v, none("product"), top)).union(part("platform", v, none("platform"), top))


@query(f"select v.id, body[:240] as snippet, label, score, f.code as platform, country_code from active v {_JOINED} where p.code = 'P3' order by published_at desc, v.id desc limit 5", node="product:p3")
def kg_node_samples(t: Tables, node: str, limit: int = 5) -> DataFrame:
    """The newest posts of a node of the graph; an unknown kind of node has none."""
    kind, _, label = node.partition(":")
    v = _named(t, t.active)
    where = {"product": F.col("product") == label.upper(), "platform": F.col("platform") == label, "country": F.col("country_code") == label.upper(), "category": has("categories", label)}.get(kind, F.lit(False))
    return v.filter(where).orderBy(F.desc("published_at"), F.desc("id")).limit(max(1, min(limit, 50))).select("id", F.substring("body", 1, 240).alias("snippet"), "label", "score", "platform", "country_code")


def _search_sql(q: str) -> str:
    score = lambda c: f"case when lower({c}) = '{q}' then 1.0::double when lower({c}) like '{q}%' then 0.8::double else 0.5::double end"
    one = lambda domain, c, source: f"select * from (select '{domain}' as domain, {c} as name, {score(c)} as score from {source} where lower({c}) like '%{q}%' order by score desc, name limit 5)"
    return " union all ".join((one("product", "code", "products"), one("platform", "code", "(select * from platforms where is_active)"), one("category", "category", "(select distinct category from cats)"), one("keyword", "keyword", "(select distinct keyword from kws)")))


@query(_search_sql("t1"), text="T1")
def global_search(t: Tables, text: str, limit: int = 5) -> DataFrame:
    """Names in four domains: whole matches, then those that start with the text, then those that hold it."""
    q = text.lower()
    domains = {"product": (t.products, "code"), "platform": (t.platforms.filter("is_active"), "code"), "category": (t.by_category().select("category").distinct(), "category"), "keyword": (t.keywords.select("keyword").distinct(), "keyword")}
    found = None
    for domain, (df, c) in domains.items():
        name = F.lower(c)
        score = F.when(name == q, 1.0).when(name.startswith(q), 0.8).otherwise(0.5)
        hits = df.filter(name.contains(q)).select(F.lit(domain).alias("domain"), F.col(c).alias("name"), score.alias("score")).orderBy(F.desc("score"), "name").limit(limit)
        found = hits if found is None else found.union(hits)
    return found


@query("""select code, total, pos_rate, neg_rate, avg_score, c.top as top_categories from (select p.code, count(*)::bigint as total, round(100.0::double * count(*) filter (label = 'positive') / count(*), 1) as pos_rate, round(100.0::double * count(*) filter (label = 'negative') / count(*), 1) as neg_rate, round(avg(score), 3) as avg_score
  from active v join products p on p.id = v.product_id where collected_at >= timestamp '2024-01-31' - interval 7 day group by 1) left join (select code, string_agg(category || '(' || n || ')', ', ' order by n desc, category) as top from (
    select p.code, category, count(*) as n, row_number() over (partition by p.code order by count(*) desc, category) as r from acats v join products p on p.id = v.product_id where collected_at >= timestamp '2024-01-31' - interval 7 day group by 1, 2) where r <= 5 group by 1) c using (code)""")
def mcp_voc_summary(t: Tables, days: int = 7, top: int = 5) -> DataFrame:
    """Summary of each product: totals, rates in percent and the top categories as text."""
    v = t.active.filter(F.col("collected_at") >= t.as_of - F.expr(f"interval {days} days")).join(t.products.select(F.col("id").alias("product_id"), "code"), "product_id")
    share = lambda x: F.round(ratio(count_label(x) * 100, F.count("*")), 1)
    g = v.groupBy("code").agg(F.count("*").alias("total"), share("positive").alias("pos_rate"), share("negative").alias("neg_rate"), F.round(F.avg("score"), 3).alias("avg_score"))
    c = t.by_category(v).groupBy("code", "category").agg(F.count("*").alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "category"))).filter(F.col("r") <= top)
    c = c.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "category", "n"))), lambda x: F.format_string("%s(%d)", x["category"], x["n"])), ", ").alias("top_categories"))
    return g.join(c, "code", "left")


@query("""select word, count(*)::bigint as n from (select unnest(regexp_extract_all(lower(body), '[a-z][a-z0-9]+')) as word from active v join products p on p.id = v.product_id where collected_at > timestamp '2024-01-31' - interval 7 day and coalesce(body, '') <> '') group by 1 order by n desc, word limit 20""")
def mcp_top_keywords(t: Tables, days: int = 7, product: str | None = None, top: int = 20) -> DataFrame:
    """Words of the recent posts of products, all of them."""
    p = t.products if product is None else t.products.filter(F.col("code") == product.upper())
    v = t.active.filter(F.col("collected_at") > t.as_of - F.expr(f"interval {days} days")).join(p.select(F.col("id").alias("product_id")), "product_id")
    return v.select(F.explode(F.regexp_extract_all(F.lower("body"), F.lit("[a-z][a-z0-9]+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


@query("""select *, round(after - before, 4) as delta, round(100.0::double * (after - before) / nullif(before, 0), 2) as pct from (select platform_id, (count(*) filter (d > date '2024-01-30' - 7))::double / 7 as after, (count(*) filter (d <= date '2024-01-30' - 7))::double / 7 as before from (
  select *, published_at::date as d from active where published_at::date > date '2024-01-30' - 14 and published_at::date <= date '2024-01-30') group by 1)""")
def cmp_half_windows(t: Tables, days: int = 14) -> DataFrame:
    """Mean a day of the later half of a window against the earlier half."""
    half = days // 2
    now = day() > F.date_sub(t.anchor, half)
    g = t.window(t.active, days).groupBy("platform_id").agg((F.count_if(now).cast("double") / half).alias("after"), (F.count_if(~now).cast("double") / half).alias("before"))
    return g.withColumn("delta", F.round(F.col("after") - F.col("before"), 4)).withColumn("pct", F.round((F.col("after") - F.col("before")) * 100 / F.nullif("before", F.lit(0.0)), 2))


# aggregates, sorts and sets
@query("select platform_id, count(distinct country_code) filter (label = 'negative')::bigint as bad_countries, count(distinct product_id) filter (score > 0)::bigint as liked from posts group by 1")
def agg_distinct_filter(t: Tables) -> DataFrame:
    return t.posts.groupBy("platform_id").agg(F.count_distinct(F.when(F.col("label") == "negative", F.col("country_code"))).alias("bad_countries"), F.count_distinct(F.when(F.col("score") > 0, F.col("product_id"))).alias("liked"))


@query("""select platform_id, max(likes) filter (r = greatest(1, ceil(0.5 * n))) as p50, max(likes) filter (r = greatest(1, ceil(0.95 * n))) as p95 from (
  select platform_id, likes, row_number() over (partition by platform_id order by likes) as r, count(*) over (partition by platform_id) as n from posts where likes is not null) group by 1""")
def agg_nearest_rank(t: Tables, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles that are values: the one at rank ceil(p n). Counts by value are ranked, not the posts."""
    g = t.posts.filter("likes is not null").groupBy("platform_id", "likes").agg(F.count("*").alias("k"))
    w = Window.partitionBy("platform_id")
    g = g.withColumn("upto", F.sum("k").over(w.orderBy("likes").rangeBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(w))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p).cast("decimal(6,4)")))
    return g.groupBy("platform_id").agg(*[F.min(F.when(F.col("upto") >= rank(p), F.col("likes"))).alias(f"p{round(p * 100)}") for p in shares])


@query("""select product_id, '[' || string_agg('{"category":"' || category || '","n":' || n || '}', ',' order by n desc, category) || ']' as top from (select *, row_number() over (partition by product_id order by n desc, category) as r from (
  select product_id, category, count(*)::bigint as n from acats where product_id is not null group by 1, 2)) where r <= 3 group by 1""")
def agg_json_objects(t: Tables, top: int = 3) -> DataFrame:
    """A JSON array of objects a group, in order."""
    g = t.by_category(t.active).filter("product_id is not null").groupBy("product_id", "category").agg(F.count("*").alias("n"))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("n"), "category"))).filter(F.col("r") <= top)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("r", "category", "n"))), lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n")))
    return g.groupBy("product_id").agg(F.to_json(rows).alias("top"))


@query("""select bin, coalesce(n, 0)::bigint as n from range(10) b(bin) left join (select least(9, floor((score + 1) * 5))::bigint as bin, count(*) as n from active where score is not null group by 1) using (bin)""")
def agg_drift_bins(t: Tables, bins: int = 10, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Histogram of the scores over equal bins, empty ones included; the top end falls in the last."""
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") - low) * bins / (high - low)))
    g = t.active.filter("score is not null").groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return t.spark.range(bins).select(F.col("id").alias("bin")).join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select id, country_code, score from posts order by score desc nulls last, country_code asc nulls first, id limit 40")
def sort_nulls(t: Tables, top: int = 40) -> DataFrame:
    return t.posts.orderBy(F.desc_nulls_last("score"), F.asc_nulls_first("country_code"), "id").limit(top).select("id", "country_code", "score")


@query("""select product_id, round(delta, 6) as delta from (select product_id, avg(score) filter (published_at::date > date '2024-01-15') - avg(score) filter (published_at::date <= date '2024-01-15') as delta from active where product_id is not null group by 1)
  where delta is not null order by abs(delta) desc, product_id limit 5""")
def sort_absolute(t: Tables, top: int = 5) -> DataFrame:
    now = day() > F.date_sub(t.anchor, 15)
    g = t.active.filter("product_id is not null").groupBy("product_id").agg((F.avg(F.when(now, F.col("score"))) - F.avg(F.when(~now, F.col("score")))).alias("delta"))
    return g.filter("delta is not null").orderBy(F.abs("delta").desc(), "product_id").limit(top).select("product_id", F.round("delta", 6).alias("delta"))


@query("""select product_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(categories, [])))))[:30], '|') as all_categories from posts where product_id is not null group by 1""")
def set_array_union(t: Tables, cap: int = 30) -> DataFrame:
    """The distinct elements of a group's arrays, at most cap of them in order; each is counted once before it is gathered."""
    one = t.by_category(t.posts.filter("product_id is not null")).select("product_id", "category").distinct()
    some = one.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy("category"))).filter(F.col("r") <= cap)
    g = some.groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list("category")), "|").alias("x"))
    return t.posts.filter("product_id is not null").select("product_id").distinct().join(g, "product_id", "left").select("product_id", F.coalesce("x", F.lit("")).alias("all_categories"))


@query("""select k.keyword, k.n, (select string_agg(category, ',' order by n desc, category) from (select category, count(*) as n from acats c join kws m on m.post_id = c.id where m.keyword = k.keyword group by 1 order by n desc, category limit 3)) as top_categories
from (select keyword, count(*)::bigint as n from amentions group by 1 order by n desc, keyword limit 10) k""")
def join_correlated_topk(t: Tables, top: int = 10, categories: int = 3) -> DataFrame:
    """The top keywords with each one's top categories: a correlated subquery with a limit as a ranked join."""
    k = t.mentions(t.active).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(top)
    c = t.by_category(t.mentions(t.active).join(k.select("keyword"), "keyword", "left_semi")).groupBy("keyword", "category").agg(F.count("*").alias("c"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("c"), "category"))).filter(F.col("r") <= categories)
    c = c.groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]), ",").alias("top_categories"))
    return k.join(c, "keyword", "left")


@query("""select platform_id, round_no, trust, place, (lag(place) over (partition by platform_id order by round_no) - place)::bigint as risen from (select *, row_number() over (partition by round_no order by trust desc, platform_id)::bigint as place from (
  select platform_id, (date_diff('day', date '2024-01-01', published_at::date) // 7)::bigint as round_no, round(1 - (count(*) filter (label is null))::double / count(*), 6) as trust from active group by 1, 2))""")
def win_rank_delta(t: Tables, start: str = "2024-01-01", every: int = 7) -> DataFrame:
    """The place of a platform by its labelled share in each round, and how far it rose since its round before."""
    number = F.floor(F.datediff(day(), F.to_date(F.lit(start))) / every).alias("round_no")
    g = t.active.groupBy("platform_id", number).agg(F.round(1 - ratio(F.count_if(F.col("label").isNull()), F.count("*")), 6).alias("trust"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("round_no").orderBy(F.desc("trust"), "platform_id")).cast("long"))
    return g.withColumn("risen", (F.lag("place").over(Window.partitionBy("platform_id").orderBy("round_no")) - F.col("place")).cast("long"))


@query("""select count(*)::bigint as n, count(*) filter (a = b)::bigint as exact, count(*) filter (a <> b and len(list_intersect(a, b)) > 0)::bigint as part, round(avg(case when len(a) = 0 and len(b) = 0 then 1.0::double else len(list_intersect(a, b))::double / len(list_distinct(a || b)) end), 6) as jaccard from (
  select list_sort(coalesce(categories, [])) as a, list_sort(list_distinct(list_filter(coalesce(categories, []), lambda x: x <> 'cat3') || case when likes % 4 = 0 then ['cat1'] else [] end)) as b from posts)""")
def alg_label_set_metrics(t: Tables) -> DataFrame:
    """Two label sets of a post, here before and after a relabelling: equal, overlapping, and their mean similarity."""
    none = F.array().cast("array<string>")
    a = F.array_sort(F.coalesce("categories", none))
    b = F.array_sort(F.array_distinct(F.concat(F.filter(F.coalesce("categories", none), lambda x: x != "cat3"), F.when(F.col("likes") % 4 == 0, F.array(F.lit("cat1"))).otherwise(none))))
    common, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    similar = F.when(either == 0, 1.0).otherwise(ratio(common, either))
    return t.posts.select(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("exact"), F.count_if((F.col("a") != F.col("b")) & (common > 0)).alias("part"), F.round(F.avg(similar), 6).alias("jaccard"))
