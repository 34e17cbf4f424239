"""Rollups: the pre-aggregated tables that readers scan, and the refresh of touched days.

Each is one partial-plus-final aggregation on its grain; only groups are shuffled."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, is_label, ratio
from feedloom.plans.registry import query
from feedloom.plans.stored import Rollup
from feedloom.sources.posts import Tables


def rollup(t: Tables, name: str, build) -> Rollup:
    """A rollup of the given tables' posts by their days; build(tables) makes it."""

    def of_days(days: DataFrame | None) -> DataFrame:
        if days is None:
            return build(t)
        posts = t.posts.join(days.withColumnRenamed("day", "__day"), day("collected_at").eqNullSafe(F.col("__day")), "left_semi")
        part = Tables(t.spark, t.sf_dir, posts=posts)
        part.as_of, part.anchor = t.as_of, t.anchor
        return build(part)

    return Rollup(t.spark, name, f"{t.sf_dir}/events.parquet", of_days, definition=inspect.getsource(build))


def stored(t: Tables, name: str, build) -> DataFrame:
    """A rollup given to Tables by its name, or the stored one, brought up to date. Posts of a user's own have no files that
    a manifest could name, so their rollups are computed unless they are given too."""
    if name in t.given:
        return getattr(t, name)
    return build(t) if t.given else rollup(t, name, build).current()


def daily_scores(t: Tables) -> DataFrame:
    """Posts a day, product and country, with the sum and number of their scores, from which means of any groups follow."""
    return stored(t, "daily_scores", build_daily_scores)


def build_daily_scores(t: Tables) -> DataFrame:
    return t.posts.groupBy(day("collected_at").alias("day"), "product_id", "country_code").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("decimal(28,12)")).alias("s"), F.count("score").alias("c"))


def stored_edges(t: Tables) -> DataFrame:
    return stored(t, "kg_edges", kg_edges)


def _sums(df: DataFrame, *keys, rounded: bool = False) -> DataFrame:
    """n, mean score and label counts. A group whose labels are all null has null counts."""
    label_sum = lambda x: F.sum(is_label(x).cast("int")).cast("long")
    score = F.round(F.avg("score"), 10)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), score.alias("sent_avg"), label_sum("positive").alias("pos"), label_sum("negative").alias("neg"), label_sum("neutral").alias("neu"))


_SUMS = """count(*)::bigint as n, round(avg(score), 10) as sent_avg, sum((label = 'positive')::int)::bigint as pos,
  sum((label = 'negative')::int)::bigint as neg, sum((label = 'neutral')::int)::bigint as neu"""


@query(f"select collected_at::date as day, product_id, platform_id, country_code, language, {_SUMS} from posts group by all")
def mv_daily(t: Tables) -> DataFrame:
    return _sums(t.posts, day("collected_at").alias("day"), "product_id", "platform_id", "country_code", "language")


@query(f"select collected_at::date as day, product_id, category, country_code, language, {_SUMS} from cats group by all")
def mv_category_daily(t: Tables) -> DataFrame:
    return _sums(t.by_category(), day("collected_at").alias("day"), "product_id", "category", "country_code", "language")


@query(f"select collected_at::date as day, country_code, product_id, coalesce(product_id, -1) as product_key, {_SUMS} from posts where country_code is not null group by all")
def mv_country_daily(t: Tables) -> DataFrame:
    return _sums(t.posts.filter("country_code is not null"), day("collected_at").alias("day"), "country_code", "product_id", F.coalesce("product_id", F.lit(-1).cast("long")).alias("product_key"))


@query("""
select collected_at::date as day, 'product-category' as edge_type, 'product:' || product_id::varchar as source, 'category:' || category as target, count(*)::bigint as weight, round(avg(score), 10) as sent_avg from cats where product_id is not null group by all
union all
select collected_at::date, 'product-platform', 'product:' || product_id::varchar, 'platform:' || platform_id::varchar, count(*)::bigint, round(avg(score), 10) from posts where product_id is not null group by all
union all
select collected_at::date, 'product-country', 'product:' || product_id::varchar, 'country:' || country_code, count(*)::bigint, round(avg(score), 10) from posts where product_id is not null and country_code is not null group by all""")
def mv_kg_edges(t: Tables) -> DataFrame:
    return kg_edges(t)


def kg_edges(t: Tables) -> DataFrame:
    """Typed edges between a product and its categories, platforms and countries."""

    def edges(df: DataFrame, kind: str, target: str) -> DataFrame:
        name = lambda prefix, c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))
        df = df.filter(f"product_id is not null and {target} is not null")
        return df.groupBy(day("collected_at").alias("day"), F.lit(f"product-{kind}").alias("edge_type"), name("product", "product_id").alias("source"), name(kind, target).alias("target")).agg(F.count("*").alias("weight"), F.round(F.avg("score"), 10).alias("sent_avg"))

    return edges(t.by_category(), "category", "category").unionByName(edges(t.posts, "platform", "platform_id")).unionByName(edges(t.posts, "country", "country_code"))


@query("""
select p.id as platform_id, p.code, count(v.id) filter (collected_at >= timestamp '2024-01-30')::bigint as posts_24h, count(v.id) filter (collected_at >= timestamp '2024-01-24')::bigint as posts_7d,
  round(avg(score) filter (collected_at >= timestamp '2024-01-24'), 10) as sent_avg_7d, max(collected_at)::date as last_day,
  case when count(v.id) filter (collected_at >= timestamp '2024-01-30') > 0 then 'active' when count(v.id) filter (collected_at >= timestamp '2024-01-24') > 0 then 'idle' else 'dead' end as status
from platforms p left join posts v on v.platform_id = p.id group by p.id, p.code""")
def mv_platform_health(t: Tables) -> DataFrame:
    return platform_health(t)


def platform_health(t: Tables) -> DataFrame:
    """All platforms, those without posts too. Posts are counted before the join."""
    since = lambda days: F.col("collected_at") >= t.as_of - F.expr(f"interval {days} days")
    counts = t.posts.groupBy("platform_id").agg(F.count_if(since(1)).alias("posts_24h"), F.count_if(since(7)).alias("posts_7d"), F.round(F.avg(F.when(since(7), F.col("score"))), 10).alias("sent_avg_7d"), F.to_date(F.max("collected_at")).alias("last_day"))
    p = t.platforms.select(F.col("id").alias("platform_id"), "code").join(counts, "platform_id", "left")
    p = p.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("posts_24h", "posts_7d")})
    return p.withColumn("status", F.when(F.col("posts_24h") > 0, "active").when(F.col("posts_7d") > 0, "idle").otherwise("dead"))


@query("""select v.product_id, date_trunc('month', published_at)::date as month, count(*)::bigint as n, round(avg(score), 10) as sent_avg,
  round(count(*) filter (label = 'negative')::double / count(*), 4) as neg_rate from posts v join products p on p.id = v.product_id group by all""")
def mv_product_month(t: Tables) -> DataFrame:
    v = t.posts.join(t.products.select(F.col("id").alias("product_id")), "product_id")
    return v.groupBy("product_id", F.to_date(F.date_trunc("month", "published_at")).alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 10).alias("sent_avg"), F.round(ratio(count_label("negative"), F.count("*")), 4).alias("neg_rate"))


@query("""
select count(*)::bigint as posts_24h, round(avg(score), 10) as sent_avg_24h, round(count(*) filter (label = 'negative')::double / nullif(count(*), 0), 4) as neg_rate_24h,
  (select count(*) from platforms where is_active)::bigint as active_platforms, (select count(*) from platforms where not is_active)::bigint as inactive_platforms,
  (select product_id from posts where collected_at >= timestamp '2024-01-30' and product_id is not null group by 1 order by count(*) desc, 1 limit 1) as top_product,
  (select platform_id from posts where collected_at >= timestamp '2024-01-30' group by 1 order by count(*) desc, 1 limit 1) as top_platform
from posts where collected_at >= timestamp '2024-01-30'""")
def mv_kpi(t: Tables) -> DataFrame:
    """One row; the scalar parts are one-row aggregates."""
    last = t.recent(t.posts, 1)
    top = lambda c: last.filter(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias(f"top_{c[:-3]}"))
    kpi = last.agg(F.count("*").alias("posts_24h"), F.round(F.avg("score"), 10).alias("sent_avg_24h"), F.round(ratio(count_label("negative"), F.count("*")), 4).alias("neg_rate_24h"))
    sites = t.platforms.agg(F.count_if(F.col("is_active")).alias("active_platforms"), F.count_if(~F.col("is_active")).alias("inactive_platforms"))
    for df in (sites, top("product_id"), top("platform_id")):
        kpi = kpi.crossJoin(df)
    return kpi


def refresh_days(rollup: DataFrame, changed: DataFrame, build, day_column: str = "day") -> DataFrame:
    """A rollup after late rows: the days that changed posts fall in are rebuilt by build(posts of
    those days), the others are kept. Write it with dynamic partition overwrite by day."""
    days = changed.select(day("collected_at").alias(day_column)).distinct()
    return rollup.join(days, day_column, "left_anti").unionByName(build(days))


@query(f"select collected_at::date as day, product_id, platform_id, country_code, language, {_SUMS} from posts where collected_at::date in (date '2024-01-29', date '2024-01-30') group by all")
def mv_daily_refresh(t: Tables) -> DataFrame:
    """The rollup without its last two days, refreshed by the posts of those days."""
    late = t.posts.filter(day("collected_at") >= F.date_sub(t.anchor, 1))
    old = t.posts.filter(day("collected_at") < F.date_sub(t.anchor, 1))
    keys = [day("collected_at").alias("day"), "product_id", "platform_id", "country_code", "language"]
    build = lambda days: _sums(t.posts.join(days, day("collected_at") == F.col("day"), "left_semi"), *keys)
    return refresh_days(_sums(old, *keys), late, build).filter(F.col("day") >= F.date_sub(t.anchor, 1))


@query("""select name, max(day) as newest, count(distinct day)::bigint as days, datediff('day', max(day), date '2024-01-30')::bigint as days_behind, 0::bigint as pending, datediff('day', max(day), date '2024-01-30') > 1 as stale from (
  select 'daily_scores' as name, collected_at::date as day from posts union all select 'kg_edges', collected_at::date from posts where product_id is not null) group by 1""")
def ops_rollup_freshness(t: Tables, limit: int = 1) -> DataFrame:
    """How far each stored rollup lags behind the anchor date, and how many files changed since it was made; from its manifest."""
    both = rollup(t, "daily_scores", build_daily_scores).freshness().union(rollup(t, "kg_edges", kg_edges).freshness())
    behind = F.datediff(t.anchor, "newest")
    return both.select("name", "newest", "days", behind.cast("long").alias("days_behind"), "pending", ((behind > limit) | (F.col("pending") > 0)).alias("stale"))
