"""Samples of a fixed size over strata: what a stratum lacks goes to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.registry import query
from feedloom.sources.posts import Tables


def quotas(sizes: DataFrame, total, *strata: str) -> DataFrame:
    """sizes: strata and size, a row a stratum -> with quota. All strata get the same, except that one with less gives all it has and the others share the
    rest; what doesn't divide goes to the first strata by name that have more. The quotas add up to total, or to all there is. total: a number or a
    one-row column of sizes. The water level comes from running sums over the strata, of which there are few."""
    total = total if not isinstance(total, int) else F.lit(total)
    by_size, by_name = Window.orderBy("size", *strata), Window.partitionBy("full").orderBy(*strata)
    rows = sizes.withColumn("total", total).withColumn("before", F.coalesce(F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left", F.count("*").over(Window.partitionBy()) - F.row_number().over(by_size) + 1)
    rows = rows.withColumn("full", F.col("size") * F.col("left") + F.col("before") <= F.col("total"))
    rest = F.greatest(F.col("total") - F.sum(F.when(F.col("full"), F.col("size")).otherwise(0)).over(Window.partitionBy()), F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("m", F.count_if(~F.col("full")).over(Window.partitionBy())).withColumn("i", F.row_number().over(by_name))
    level = F.floor(F.col("rest") / F.greatest("m", F.lit(1)))
    quota = F.when(F.col("full"), F.col("size")).otherwise(level + F.when(F.col("i") <= F.col("rest") - level * F.col("m"), 1).otherwise(0))
    return rows.select(*strata, "size", quota.cast("long").alias("quota"))


def sampled(rows: DataFrame, quota: DataFrame, strata: list[str], id_col: str, seed: int, most: int) -> DataFrame:
    """The first quota rows of each stratum in the order of a hash of seed and id. most: no quota is larger, so that Spark drops the rest of a large stratum
    before the shuffle."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")), id_col)
    first = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most)
    return first.join(quota.select(*strata, "quota"), strata).filter("__r <= quota").drop("__r", "quota")


_POOL = "(select id, categories[1] as topic, case when len(categories) >= 2 then 'multi' else 'single' end as tier from posts where len(categories) >= 1 and body is not null)"
_LEVELS = """select tier, topic, size, case when full_ then size else rest // greatest(m, 1) + case when i <= rest - rest // greatest(m, 1) * m then 1 else 0 end end as quota from (
  select *, row_number() over (partition by full_ order by topic) as i, count(*) filter (not full_) over () as m, greatest(total - coalesce(sum(size) filter (full_) over (), 0), 0)::bigint as rest from (
    select *, size * (cnt - r + 1) + coalesce(before, 0) <= total as full_ from (select *, count(*) over () as cnt, row_number() over (order by size, topic) as r, sum(size) over (order by size, topic rows between unbounded preceding and 1 preceding) as before from ({sizes}))))"""
_MULTI = f"""(select tier, topic, size, least(size, 70 // cnt + case when i <= 70 % cnt then 1 else 0 end) as quota from (select tier, topic, count(*)::bigint as size, count(*) over () as cnt, row_number() over (order by topic) as i from {_POOL} where tier = 'multi' group by 1, 2))"""
_SINGLE = f"(select tier, topic, count(*)::bigint as size, (select 30 + 70 - coalesce(sum(quota), 0) from {_MULTI})::bigint as total from {_POOL} where tier = 'single' group by 1, 2)"


@query(f"""select tier, topic, id from (select p.*, quota, row_number() over (partition by tier, topic order by md5(id::varchar || '7'), id) as r from {_POOL} p
  join (select tier, topic, quota from {_MULTI} union all select tier, topic, quota from ({_LEVELS.format(sizes=_SINGLE)})) using (tier, topic)) where r <= quota""", seed=7)
def sample_quota_transfer(t: Tables, multi: int = 70, single: int = 30, seed: int = 24) -> DataFrame:
    """So many posts with several categories, spread evenly over their first one, and so many with one; what the first kind lacks goes to the second, where it
    is levelled over the categories, so that the whole has its size as long as there are enough posts."""
    pool = t.posts.filter("size(categories) >= 1 and body is not null").select("id", F.col("categories")[0].alias("topic"), F.when(F.size("categories") >= 2, "multi").otherwise("single").alias("tier"))
    sizes = pool.groupBy("tier", "topic").agg(F.count("*").alias("size"))
    many = sizes.filter("tier = 'multi'").withColumn("k", F.count("*").over(Window.partitionBy("tier"))).withColumn("i", F.row_number().over(Window.partitionBy("tier").orderBy("topic")))
    share = F.floor(F.lit(multi) / F.col("k")) + F.when(F.col("i") <= multi % F.col("k"), 1).otherwise(0)
    first = many.select("tier", "topic", "size", F.least("size", share).alias("quota"))
    lacking = first.agg((F.lit(multi + single) - F.coalesce(F.sum("quota"), F.lit(0))).cast("long").alias("goal"))
    second = quotas(sizes.filter("tier = 'single'").crossJoin(lacking), F.col("goal"), "tier", "topic")
    return sampled(pool, first.unionByName(second), ["tier", "topic"], "id", seed, multi + single).select("tier", "topic", "id")
