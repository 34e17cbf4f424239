"""Relational building blocks in the forms that the analytics use: filters, joins, aggregates,
windows, sorts and set operations with the null, tie and rounding rules that they rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, engagement, has, label_score, ratio
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables


@query("select id, product_id, label, substr(language, 1, 1) as lang1, case when score < 0 then 'low' when score > 0 then 'high' else 'flat' end as band from posts where platform_id between 3 and 7 and label in ('negative', 'positive')")
def scan_filter_project(t: Tables) -> DataFrame:
    band = F.when(F.col("score") < 0, "low").when(F.col("score") > 0, "high").otherwise("flat")
    return t.posts.filter(F.col("platform_id").between(3, 7) & F.col("label").isin("negative", "positive")).select("id", "product_id", "label", F.substring("language", 1, 1).alias("lang1"), band.alias("band"))


@query("select id, published_at::date as day from active where published_at::date > date '2024-01-23' and published_at::date <= date '2024-01-30'")
def filter_date_window(t: Tables) -> DataFrame:
    return t.window(t.active, 7).select("id", day().alias("day"))


@query("select id, len(categories)::bigint as n from posts where coalesce(list_contains(categories, 'cat3'), false)")
def filter_array_contains(t: Tables) -> DataFrame:
    return t.posts.filter(has("categories", "cat3")).select("id", F.size("categories").cast("long").alias("n"))


@query("select id, not coalesce(list_contains(categories, 'cat3'), false) as untagged, list_aggregate(list_sort(list_distinct(coalesce(categories, []) || ['cat3'])), 'string_agg', '|') as tagged from posts where not coalesce(list_contains(categories, 'cat3'), false)")
def filter_array_all_append(t: Tables) -> DataFrame:
    """Rows without a category, with that category appended."""
    held = F.coalesce("categories", F.array().cast("array<string>"))
    out = t.posts.filter(~F.array_contains(held, "cat3"))
    return out.select("id", F.lit(True).alias("untagged"), F.array_join(F.array_sort(F.array_union(held, F.array(F.lit("cat3")))), "|").alias("tagged"))


@query("select doc_id, lang from documents where text ilike '%the %' and lower(text) like 'th%'")
def filter_ilike(t: Tables) -> DataFrame:
    return t.table("documents").filter(F.col("text").ilike("%the %") & F.lower("text").like("th%")).select("doc_id", "lang")


@query(r"select doc_id, regexp_extract(text, '(?i)licen[sc]ed? under ([^\n.]{1,40})', 1) as found from documents where regexp_matches(text, '(?i)licen[sc]ed? under')")
def filter_regex(t: Tables) -> DataFrame:
    return t.table("documents").filter(F.col("text").rlike("(?i)licen[sc]ed? under")).select("doc_id", F.regexp_extract("text", r"(?i)licen[sc]ed? under ([^\n.]{1,40})", 1).alias("found"))


@query("select a.id from posts a where a.country_code is not distinct from 'C4' or (a.country_code is not distinct from null and a.platform_id = 1)")
def filter_null_safe(t: Tables) -> DataFrame:
    return t.posts.filter(F.col("country_code").eqNullSafe("C4") | (F.col("country_code").eqNullSafe(F.lit(None)) & (F.col("platform_id") == 1))).select("id")


@query("select language, count(*)::bigint as n from posts group by language having count(*) >= 5 and count(distinct platform_id) >= 2")
def having_floors(t: Tables) -> DataFrame:
    g = t.posts.groupBy("language").agg(F.count("*").alias("n"), F.count_distinct("platform_id").alias("sites"))
    return g.filter("n >= 5 and sites >= 2").select("language", "n")


@query("select p.code, count(*)::bigint as n, sum(likes)::bigint as likes from posts v join products p on p.id = v.product_id group by p.code")
def join_inner_dim(t: Tables) -> DataFrame:
    return t.posts.join(t.products.select(F.col("id").alias("product_id"), "code"), "product_id").groupBy("code").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))


@query("select f.code, f.region, count(v.id)::bigint as n from platforms f left join posts v on v.platform_id = f.id and v.label = 'negative' group by f.code, f.region")
def join_left_keep_empty(t: Tables) -> DataFrame:
    """The label predicate stands in the join, so platforms without such posts stay."""
    bad = t.posts.filter("label = 'negative'").groupBy("platform_id").count()
    return t.platforms.join(bad, F.col("id") == F.col("platform_id"), "left").select("code", "region", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("select v.id, coalesce(p.code, 'none') as product, coalesce(f.region, 'none') as region from posts v left join products p on p.id = v.product_id left join platforms f on f.id = v.platform_id")
def join_left_dims(t: Tables) -> DataFrame:
    p = t.products.select(F.col("id").alias("product_id"), F.col("code").alias("product"))
    f = t.platforms.select(F.col("id").alias("platform_id"), "region")
    out = t.posts.join(p, "product_id", "left").join(f, "platform_id", "left")
    return out.select("id", F.coalesce("product", F.lit("none")).alias("product"), F.coalesce("region", F.lit("none")).alias("region"))


@query("""
select coalesce(a.keyword, b.keyword) as keyword, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after
from (select keyword, count(*)::bigint as n from mentions where published_at::date between date '2024-01-10' and date '2024-01-12' and platform_id < 4 group by 1) a
full join (select keyword, count(*)::bigint as n from mentions where published_at::date between date '2024-01-13' and date '2024-01-15' and platform_id < 4 group by 1) b on a.keyword = b.keyword""")
def join_full_before_after(t: Tables) -> DataFrame:
    def part(lo: str, hi: str, name: str) -> DataFrame:
        return t.mentions(t.posts.filter(day().between(lo, hi) & (F.col("platform_id") < 4))).groupBy("keyword").agg(F.count("*").alias(name))

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return part("2024-01-10", "2024-01-12", "before").join(part("2024-01-13", "2024-01-15", "after"), "keyword", "full").select("keyword", zero("before"), zero("after"))


@query("select category, count(*)::bigint as n, round(count(*)::double / (select count(*) from posts), 4) as share from cats group by category")
def join_one_row_total(t: Tables) -> DataFrame:
    total = t.posts.agg(F.count("*").alias("total"))
    g = t.by_category().groupBy("category").agg(F.count("*").alias("n"))
    return g.crossJoin(total).select("category", "n", F.round(ratio(F.col("n"), F.col("total")), 4).alias("share"))


@query("select a.keyword as k1, b.keyword as k2, count(*)::bigint as w from kws a join kws b on a.post_id = b.post_id and a.keyword < b.keyword group by 1, 2 having count(*) >= 5")
def join_self_pairs(t: Tables) -> DataFrame:
    a, b = t.keywords.withColumnRenamed("keyword", "k1"), t.keywords.withColumnRenamed("keyword", "k2")
    return a.join(b, "post_id").filter("k1 < k2").groupBy("k1", "k2").agg(F.count("*").alias("w")).filter("w >= 5")


@query("""select platform_id, count(*)::bigint as n from posts r where published_at::date > date '2024-01-26'
  and not exists (select 1 from posts o where o.published_at::date <= date '2024-01-26' and o.platform_id = r.platform_id and coalesce(o.country_code, '') = coalesce(r.country_code, '') and o.product_id is not distinct from r.product_id) group by 1""")
def join_anti_new(t: Tables) -> DataFrame:
    """Rows of the last days whose platform, country and product were never seen before; null and '' are one country."""
    key = lambda df: df.withColumns({"c": F.coalesce("country_code", F.lit("")), "p": F.coalesce("product_id", F.lit(-1))})
    old = key(t.posts.filter(day() <= "2024-01-26")).select("platform_id", "c", "p").distinct()
    return key(t.posts.filter(day() > "2024-01-26")).join(old, ["platform_id", "c", "p"], "left_anti").groupBy("platform_id").agg(F.count("*").alias("n"))


@query("select v.product_id, count(*)::bigint as n from posts v where v.product_id in (select product_id from posts where product_id is not null group by 1 order by count(*) desc, 1 limit 3) and label = 'positive' group by 1")
def join_semi_topn(t: Tables) -> DataFrame:
    top = t.posts.filter("product_id is not null").groupBy("product_id").count().orderBy(F.desc("count"), "product_id").limit(3)
    return t.posts.filter("label = 'positive'").join(top, "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("n"))


@query("select p.code, (v.published_at::date - p.released_at)::bigint as offset_days, count(*)::bigint as n from posts v join products p on p.id = v.product_id and abs(v.published_at::date - p.released_at) <= 3 group by 1, 2")
def join_interval_release(t: Tables) -> DataFrame:
    p = t.products.select(F.col("id").alias("product_id"), "code", "released_at")
    off = F.datediff(day(), F.col("released_at")).cast("long")
    return t.posts.join(p, "product_id").withColumn("offset_days", off).filter("abs(offset_days) <= 3").groupBy("code", "offset_days").agg(F.count("*").alias("n"))


@query("""select e.marker, v.product_id, count(*)::bigint as n from (select id as pid, code || '-release' as marker, released_at from products) e
  join posts v on v.published_at::date between e.released_at - 2 and e.released_at + 2 group by 1, 2""")
def join_interval_exploded(t: Tables) -> DataFrame:
    """An interval join without an equal key: the few markers are spread over the days that they
    reach, so the fact table joins by day and isn't compared with every marker."""
    e = t.products.select(F.concat("code", F.lit("-release")).alias("marker"), F.explode(F.sequence(F.date_sub("released_at", 2), F.date_add("released_at", 2))).alias("day"))
    return t.posts.withColumn("day", day()).join(e, "day").groupBy("marker", "product_id").agg(F.count("*").alias("n"))


@query("""select coalesce(a.country_code, '-') as country, a.n as n1, b.n as n2 from (select country_code, count(*)::bigint as n from posts where label = 'negative' group by 1) a
  join (select country_code, count(*)::bigint as n from posts where label = 'positive' group by 1) b on a.country_code is not distinct from b.country_code""")
def join_null_safe(t: Tables) -> DataFrame:
    g = lambda x, n: t.posts.filter(F.col("label") == x).groupBy("country_code").agg(F.count("*").alias(n))
    a, b = g("negative", "n1"), g("positive", "n2").withColumnRenamed("country_code", "c2")
    return a.join(b, F.col("country_code").eqNullSafe(F.col("c2"))).select(F.coalesce("country_code", F.lit("-")).alias("country"), "n1", "n2")


@query("select language, count(*) filter (label = 'negative')::bigint as neg, count(*) filter (label is null)::bigint as unlabelled, sum((label = 'positive')::int)::bigint as pos, round(avg(case when label = 'negative' then score end), 4) as neg_score from posts group by 1")
def agg_conditional(t: Tables) -> DataFrame:
    return t.posts.groupBy("language").agg(count_label("negative").alias("neg"), F.count_if(F.col("label").isNull()).alias("unlabelled"), F.sum((F.col("label") == "positive").cast("int")).alias("pos"), F.round(F.avg(F.when(F.col("label") == "negative", F.col("score"))), 4).alias("neg_score"))


@query("select platform_id, round(avg(case label when 'positive' then 1.0 when 'negative' then -1.0 else 0.0 end), 4)::double as label_score from posts group by 1")
def agg_label_score(t: Tables) -> DataFrame:
    return t.posts.groupBy("platform_id").agg(F.round(label_score(), 4).alias("label_score"))


@query("""select product_id, round(sum(a * n) / nullif(sum(n), 0), 4) as weighted, sum(n)::bigint as n from (select product_id, country_code, count(*) as n, round(avg(score), 8) as a from posts group by 1, 2) group by 1""")
def agg_weighted_mean(t: Tables) -> DataFrame:
    """Groups without a mean weigh in the denominator alone, as the rollup readers do it."""
    g = t.posts.groupBy("product_id", "country_code").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("a"))
    return g.groupBy("product_id").agg(F.round(ratio(F.sum(F.col("a") * F.col("n")), F.sum("n")), 4).alias("weighted"), F.sum("n").alias("n"))


@query("select language, round(quantile_cont(likes, 0.5), 4) as p50, round(quantile_cont(likes, 0.9), 4) as p90, round(stddev_samp(score), 6) as sd, round(stddev_pop(score), 6) as sdp from posts group by 1")
def agg_percentile_stddev(t: Tables) -> DataFrame:
    return t.posts.groupBy("language").agg(F.round(F.percentile("likes", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("likes", F.lit(0.9)), 4).alias("p90"), F.round(F.stddev_samp("score"), 6).alias("sd"), F.round(F.stddev_pop("score"), 6).alias("sdp"))


@query("select product_id, (select label from posts b where b.product_id is not distinct from a.product_id and label is not null group by 1 order by count(*) desc, 1 limit 1) as usual, count(distinct country_code)::bigint as countries from posts a group by product_id")
def agg_mode(t: Tables) -> DataFrame:
    """The most frequent label, the least of equals."""
    return t.posts.groupBy("product_id").agg(F.mode("label", True).alias("usual"), F.count_distinct("country_code").alias("countries"))


@query("""select keyword, arg_min(d, (-n, d)) as peak_day, max(n)::bigint as peak, count(*)::bigint as days from (select keyword, published_at::date as d, count(*) as n from mentions group by 1, 2) group by 1""")
def agg_argmax_peak(t: Tables) -> DataFrame:
    """Two-level aggregation; of days with equal counts the first is the peak."""
    g = t.mentions().groupBy("keyword", day().alias("d")).agg(F.count("*").alias("n"))
    return g.groupBy("keyword").agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("peak_day"), F.max("n").alias("peak"), F.count("*").alias("days"))


@query("select d as day, country, grouping_id(d, country)::bigint as level, count(*)::bigint as n from (select published_at::date as d, coalesce(country_code, 'none') as country from posts) group by grouping sets ((d, country), (d), ())")
def agg_grouping_sets(t: Tables) -> DataFrame:
    v = t.posts.select(day().alias("day"), F.coalesce("country_code", F.lit("none")).alias("country"))
    return v.rollup("day", "country").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("""select keyword, platform_id, hop, gap from (select *, row_number() over w as hop, (first - lag(first) over w)::bigint as gap
  from (select keyword, platform_id, min(published_at::date) as first from mentions group by 1, 2) window w as (partition by keyword order by first, platform_id)) where hop <= 4""")
def win_row_number_hop(t: Tables) -> DataFrame:
    w = Window.partitionBy("keyword").orderBy("first", "platform_id")
    g = t.mentions().groupBy("keyword", "platform_id").agg(F.min(day()).alias("first"))
    g = g.withColumn("hop", F.row_number().over(w)).withColumn("gap", F.datediff("first", F.lag("first").over(w)).cast("long"))
    return g.filter("hop <= 4").select("keyword", "platform_id", F.col("hop").cast("long").alias("hop"), "gap")


@query("""select platform_id, count(*)::bigint as n, count(*) filter (gap < 3600)::bigint as soon from (
  select platform_id, epoch(published_at) - lag(epoch(published_at)) over (partition by platform_id order by published_at, id) as gap from posts where label = 'negative') group by 1""")
def win_lag_gap(t: Tables) -> DataFrame:
    seconds = F.unix_micros(F.col("published_at").cast("timestamp")) / 1e6
    w = Window.partitionBy("platform_id").orderBy("published_at", "id")
    v = t.posts.filter("label = 'negative'").withColumn("gap", seconds - F.lag(seconds).over(w))
    return v.groupBy("platform_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") < 3600).alias("soon"))


@query("select bucket, count(*)::bigint as n, min(eng)::bigint as low, max(eng)::bigint as high from (select ntile(5) over (order by eng, id)::bigint as bucket, eng from (select id, likes + comments + shares as eng from posts)) group by 1")
def win_ntile_quintile(t: Tables) -> DataFrame:
    return ntiles(t.posts.select("id", engagement().alias("eng")), "eng", "id", 5).groupBy("bucket").agg(F.count("*").alias("n"), F.min("eng").alias("low"), F.max("eng").alias("high"))


def ntiles(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """Adds bucket, as ntile(k) over (order by value, tie) would, without one partition for all rows: rows are
    counted by value, the few distinct values get running counts, and only ties are numbered within a value."""
    counts = df.groupBy(value).agg(F.count("*").alias("__c"))
    span = counts.withColumn("__g", F.floor(F.col(value).cast("double") / 64))
    heads = span.groupBy("__g").agg(F.sum("__c").alias("__gc"))
    heads = heads.withColumn("__gb", F.coalesce(F.sum("__gc").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = heads.withColumn("__n", F.sum("__gc").over(Window.partitionBy(F.lit(1))))
    inner = Window.partitionBy("__g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    span = span.join(heads, "__g").select(value, (F.col("__gb") + F.coalesce(F.sum("__c").over(inner), F.lit(0))).alias("__before"), "__n")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(value).orderBy(tie)) - 1
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    long_rows = extra * (small + 1)
    bucket = F.when(F.col("__r") < long_rows, F.floor(F.col("__r") / (small + 1))).otherwise(extra + F.floor((F.col("__r") - long_rows) / F.greatest(small, F.lit(1)))) + 1
    return df.join(span, value).withColumn("__r", rank).withColumn("bucket", bucket.cast("long")).drop("__before", "__n", "__r")


@query("select category, label, n, round(n::double / sum(n) over (partition by category), 4) as share from (select category, label, count(*)::bigint as n from cats group by 1, 2)")
def win_share_of_total(t: Tables) -> DataFrame:
    g = t.by_category().groupBy("category", "label").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("category"))), 4))


@query("""select platform_id, day, n, case when row_number() over w >= 7 then round(avg(n) over (partition by platform_id order by day rows between 6 preceding and current row), 4) end as ma7,
  round((n - lag(n) over w)::double / nullif(abs(lag(n) over w), 0) * 100, 4) as delta_pct from (select platform_id, published_at::date as day, count(*)::bigint as n from posts group by 1, 2) window w as (partition by platform_id order by day)""")
def win_moving_average_delta(t: Tables) -> DataFrame:
    w = Window.partitionBy("platform_id").orderBy("day")
    g = t.posts.groupBy("platform_id", day().alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(w)
    return g.withColumn("ma7", F.when(F.row_number().over(w) >= 7, F.round(F.avg("n").over(w.rowsBetween(-6, 0)), 4))).withColumn("delta_pct", F.round(ratio(F.col("n") - before, F.abs(before)) * 100, 4))


@query("""select id as product_id, day, round(m, 4) as score, round(avg(m) over (partition by id order by day rows between 6 preceding and current row), 4) as ma7, round((m - last_value(m ignore nulls) over (partition by id order by day rows between unbounded preceding and 1 preceding)) / nullif(abs(last_value(m ignore nulls) over (partition by id order by day rows between unbounded preceding and 1 preceding)), 0) * 100, 2) as delta_pct
  from (select p.id, g.day::date as day, s.m from products p cross join range(date '2024-01-01', date '2024-01-31', interval 1 day) g(day) left join (select product_id, published_at::date as d, avg(score) as m from amentions where keyword = 'kw5' group by 1, 2) s on s.product_id = p.id and s.d = g.day::date)""", keyword="kw5")
def win_gaps_skipped(t: Tables, keyword: str, days: int = 30) -> DataFrame:
    """A keyword's daily score by product, with days that have none: the moving average of seven rows and the change since the last day with a score pass over them."""
    s = t.mentions(t.active).filter(F.col("keyword") == keyword).groupBy("product_id", day().alias("day")).agg(F.avg("score").alias("m"))
    grid = t.products.select(F.col("id").alias("product_id")).crossJoin(t.spark.range(days).select(F.date_sub(t.anchor, F.col("id").cast("int")).alias("day")))
    w = Window.partitionBy("product_id").orderBy("day")
    last = F.last("m", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = grid.join(s, ["product_id", "day"], "left")
    return rows.select("product_id", "day", F.round("m", 4).alias("score"), F.round(F.avg("m").over(w.rowsBetween(-6, 0)), 4).alias("ma7"), F.round((F.col("m") - last) / F.nullif(F.abs(last), F.lit(0.0)) * 100, 2).alias("delta_pct"))


@query("select product_id, keyword, n, r from (select product_id, keyword, n, row_number() over (partition by product_id order by n desc, keyword)::bigint as r from (select product_id, keyword, count(*)::bigint as n from mentions where product_id is not null group by 1, 2)) where r <= 3")
def win_topk_per_group(t: Tables) -> DataFrame:
    g = t.mentions().filter("product_id is not null").groupBy("product_id", "keyword").agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("n"), "keyword")).cast("long")).filter("r <= 3")


@query("""select category, round(regr_slope(n, x), 4) as slope from (select category, d, n, row_number() over (partition by category order by d)::double as x, row_number() over (partition by category order by d desc) as back
  from (select category, published_at::date as d, count(*)::double as n from cats group by 1, 2)) where back <= 4 group by 1""")
def win_slope4(t: Tables) -> DataFrame:
    g = t.by_category().groupBy("category", day().alias("d")).agg(F.count("*").cast("double").alias("n"))
    by = Window.partitionBy("category")
    g = g.withColumn("x", F.row_number().over(by.orderBy("d")).cast("double")).withColumn("back", F.row_number().over(by.orderBy(F.desc("d"))))
    return g.filter("back <= 4").groupBy("category").agg(F.round(F.regr_slope("n", "x"), 4).alias("slope"))


@query("select id, label, likes + comments + shares as eng from posts where published_at::date = date '2024-01-20' order by case label when 'negative' then 0 when 'neutral' then 1 when 'positive' then 2 else 3 end, eng desc, id desc limit 10 offset 5")
def sort_priority_page(t: Tables) -> DataFrame:
    rank = F.when(F.col("label") == "negative", 0).when(F.col("label") == "neutral", 1).when(F.col("label") == "positive", 2).otherwise(3)
    return t.posts.filter(day() == "2024-01-20").select("id", "label", engagement().alias("eng")).orderBy(rank, F.desc("eng"), F.desc("id")).offset(5).limit(10)


@query("select id, category from (select id, category, row_number() over (partition by category order by md5(id::varchar || 'seed7'), id) as r from cats) where r <= 5")
def sample_md5_stratified(t: Tables) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("seed7"))), "id")
    return t.by_category().withColumn("r", F.row_number().over(w)).filter("r <= 5").select("id", "category")


@query("""select count(*)::bigint as n, kind from (select distinct keyword, case when a and b then 'both' when a then 'early' else 'late' end as kind
  from (select keyword, bool_or(published_at::date <= date '2024-01-10') as a, bool_or(published_at::date >= date '2024-01-20') as b from mentions where platform_id = 2 group by 1) where a or b) group by kind""")
def set_intersect_except(t: Tables) -> DataFrame:
    of = lambda c: t.mentions(t.posts.filter((F.col("platform_id") == 2) & c)).select("keyword").distinct()
    early, late = of(day() <= "2024-01-10"), of(day() >= "2024-01-20")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    parts = count(early.intersect(late), "both").unionByName(count(early.subtract(late), "early")).unionByName(count(late.subtract(early), "late"))
    return parts.filter("n > 0")


@query("""select coalesce(a.category, b.category) as category, case when a.category is null then 'added' when b.category is null then 'removed' when a.n <> b.n then 'changed' else 'same' end as state
  from (select category, count(*) as n from cats where platform_id = 3 and published_at::date < date '2024-01-16' group by 1) a full join (select category, count(*) as n from cats where platform_id = 3 and published_at::date >= date '2024-01-16' group by 1) b on a.category = b.category""")
def set_keyed_diff(t: Tables) -> DataFrame:
    of = lambda c, n: t.by_category(t.posts.filter((F.col("platform_id") == 3) & c)).groupBy("category").agg(F.count("*").alias(n))
    both = of(day() < "2024-01-16", "a").join(of(day() >= "2024-01-16", "b"), "category", "full")
    return both.select("category", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


@query("""select event_type, k as k, count(*)::bigint as n, max(len(props))::bigint as longest from (select event_type, (props->>'k')::bigint as k, props from events) group by 1, 2""")
def json_path_counts(t: Tables) -> DataFrame:
    e = t.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.max(F.length("props")).cast("long").alias("longest"))


@query("""select p.id as product_id, h.h::bigint as hour, count(v.id)::bigint as n from products p cross join range(24) h(h) left join posts v on v.product_id = p.id and extract(hour from v.published_at) = h.h group by 1, 2""")
def gapfill_hourly(t: Tables) -> DataFrame:
    """Every product has 24 rows: the hours are a sequence exploded beside the small dimension."""
    domain = t.products.select(F.col("id").alias("product_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    n = t.posts.groupBy("product_id", F.hour("published_at").alias("hour")).agg(F.count("*").alias("n"))
    return domain.join(n, ["product_id", "hour"], "left").select("product_id", F.col("hour").cast("long").alias("hour"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""select platform_id, country, n from (select platform_id, coalesce(country_code, 'none') as country, count(*)::bigint as n from posts group by 1, 2)
  where platform_id in (select platform_id from posts group by 1 order by count(*) desc, 1 limit 5)""")
def top_groups_matrix(t: Tables) -> DataFrame:
    top = t.posts.groupBy("platform_id").count().orderBy(F.desc("count"), "platform_id").limit(5)
    return t.posts.join(top, "platform_id", "left_semi").groupBy("platform_id", F.coalesce("country_code", F.lit("none")).alias("country")).agg(F.count("*").alias("n"))


@query("""select product_id, coalesce(max(n) filter (label = 'negative'), 0)::bigint as negative, coalesce(max(n) filter (label = 'neutral'), 0)::bigint as neutral, coalesce(max(n) filter (label = 'positive'), 0)::bigint as positive
  from (select product_id, label, count(*) as n from posts group by 1, 2) group by 1""")
def agg_pivot(t: Tables) -> DataFrame:
    labels = ["negative", "neutral", "positive"]
    return t.posts.groupBy("product_id").pivot("label", labels).count().na.fill(0, labels)
