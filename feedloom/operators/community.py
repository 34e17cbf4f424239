"""Community, temporal and geographic operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.columns import count_label, day, ratio
from feedloom.operators.rollups import platform_health
from feedloom.operators.rollups import daily_scores
from feedloom.plans.registry import query
from feedloom.plans.storage import cut
from feedloom.sources.posts import Tables


@query("select f.region, count(*)::bigint as sites, count(*) filter (not exists (select 1 from posts v where v.platform_id = f.id and collected_at >= timestamp '2024-01-24'))::bigint as dead from platforms f group by 1")
def com_platforms_health(t: Tables) -> DataFrame:
    h = platform_health(t).join(t.platforms.select("code", "region"), "code")
    return h.groupBy("region").agg(F.count("*").alias("sites"), F.count_if(F.col("status") == "dead").alias("dead"))


@query("select platform_id, product_id, count(*)::bigint as n, round(avg(score), 8) as avg_score, round(100.0 * count(*) filter (label = 'negative') / count(*), 2)::double as neg_pct from active where collected_at >= timestamp '2024-01-24' and product_id is not null group by 1, 2")
def com_product_matrix(t: Tables, days: int = 7) -> DataFrame:
    v = t.recent(t.active, days).filter("product_id is not null")
    return v.groupBy("platform_id", "product_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("avg_score"), F.round(ratio(count_label("negative") * 100, F.count("*")), 2).alias("neg_pct"))


@query("""select platform_id, n, round(q1, 8) as q1, round(q2, 8) as q2, round(q3, 8) as q3, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 8) as low, round(least(hi, q3 + 1.5 * (q3 - q1)), 8) as high from (
  select platform_id, count(*)::bigint as n, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.5) as q2, quantile_cont(score, 0.75) as q3, min(score) as lo, max(score) as hi from active where score is not null group by 1 having count(*) >= 8)""")
def com_dispersion(t: Tables, floor: int = 8) -> DataFrame:
    """Quartiles of the score by platform, whiskers clamped to the data."""
    q = lambda p: F.percentile("score", F.lit(p))
    g = t.active.filter("score is not null").groupBy("platform_id").agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.min("score").alias("lo"), F.max("score").alias("hi")).filter(F.col("n") >= floor)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return g.select("platform_id", "n", *[F.round(c, 8).alias(c) for c in ("q1", "q2", "q3")], F.round(F.greatest("lo", F.col("q1") - reach), 8).alias("low"), F.round(F.least("hi", F.col("q3") + reach), 8).alias("high"))


@query("""select platform_id, round(after - before, 4) as delta, first_below from (
  select platform_id, avg(m) filter (d > date '2024-01-16') as after, avg(m) filter (d <= date '2024-01-16') as before, count(*) filter (d > date '2024-01-16') as na, count(*) filter (d <= date '2024-01-16') as nb from (select platform_id, published_at::date as d, avg(score) as m from active where score is not null and published_at::date > date '2024-01-02' and published_at::date <= date '2024-01-30' group by 1, 2) group by 1) h
  left join (select x.platform_id, min(x.d) as first_below from (select platform_id, published_at::date as d, avg(score) as m from active where score is not null and published_at::date > date '2024-01-16' and published_at::date <= date '2024-01-30' group by 1, 2) x
    join (select platform_id, avg(m) as base from (select platform_id, published_at::date as d, avg(score) as m from active where score is not null and published_at::date > date '2024-01-02' and published_at::date <= date '2024-01-16' group by 1, 2) group by 1) b on b.platform_id = x.platform_id and x.m < b.base group by 1) f using (platform_id) where na >= 3 and nb >= 3""")
def com_early_signal(t: Tables, days: int = 28) -> DataFrame:
    """Change of the mean of daily means, and the first late day below the earlier mean."""
    late = F.col("d") > F.date_sub(t.anchor, days // 2)
    g = t.window(t.active.filter("score is not null"), days).groupBy("platform_id", day().alias("d")).agg(F.avg("score").alias("m"))
    g = g.withColumn("base", F.avg(F.when(~late, F.col("m"))).over(Window.partitionBy("platform_id")))
    g = g.groupBy("platform_id").agg(F.avg(F.when(late, F.col("m"))).alias("a"), F.first("base").alias("b"), F.count_if(late).alias("na"), F.count_if(~late).alias("nb"), F.min(F.when(late & (F.col("m") < F.col("base")), F.col("d"))).alias("first_below"))
    return g.filter("na >= 3 and nb >= 3").select("platform_id", F.round(F.col("a") - F.col("b"), 4).alias("delta"), "first_below")


def _draw(seed: int, step: int, id_: Column) -> Column:
    """A number between 0 and 1 for an id, another one each step."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{step}:"), id_.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def kmeans(points: DataFrame, k: int, seed: int = 42, rounds: int = 50, settled: float = 1e-6) -> tuple[DataFrame, list[tuple[float, float]], int]:
    """points id, x, y -> the points with their cluster, the centres, and the rounds it took. The first centre is drawn evenly, each other one by the squared distance to
    the nearest centre so far: the point of least exponential key -ln(u) / weight, with u from a hash of seed, step and id, so that a
    draw is one aggregate and comes out the same in any order. Then Lloyd's rounds, an aggregate each, until no centre moves. A cluster that
    loses all points keeps its centre. With k points or fewer each is its own centre, by id. Only the k centres come to the driver."""
    points = cut(points)
    n = points.count()
    if n <= k:
        own = points.withColumn("cluster", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))  # k points at most
        return own, [(r["x"], r["y"]) for r in own.orderBy("cluster").collect()], 0
    square = lambda c: (F.col("x") - F.lit(c[0])) * (F.col("x") - F.lit(c[0])) + (F.col("y") - F.lit(c[1])) * (F.col("y") - F.lit(c[1]))
    least = lambda cs: F.least(*map(square, cs)) if len(cs) > 1 else square(cs[0])
    centres: list[tuple[float, float]] = []
    for step in range(k):
        u = -F.log(_draw(seed, step, F.col("id")))
        weight = least(centres) if centres else F.lit(1.0)
        key = F.struct(F.when(weight > 0, 0).otherwise(1), F.when(weight > 0, u / weight).otherwise(u), "id")
        r = points.agg(F.min_by(F.struct("x", "y"), key).alias("c")).first()["c"]
        centres.append((r["x"], r["y"]))

    def assigned() -> DataFrame:
        nearest = F.array_min(F.array(*[F.struct(square(c).alias("d"), F.lit(i).cast("long").alias("i")) for i, c in enumerate(centres)]))
        return points.withColumn("cluster", nearest["i"])

    took = 0
    for took in range(1, rounds + 1):
        means = {r["cluster"]: (r["x"], r["y"]) for r in assigned().groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        shift = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(centres, moved, strict=True))
        centres = moved
        if shift < settled:
            break
    return assigned(), centres, took


def cluster_points(t: Tables, days: int = 7, floor: int = 5) -> DataFrame:
    """Active platforms with enough posts in the last days, by positive and negative percent."""
    pct = lambda x: ratio(count_label(x) * 100, F.count("*"))
    g = t.recent(t.posts, days).groupBy("platform_id").agg(F.count("*").alias("n"), pct("positive").alias("x"), pct("negative").alias("y"), F.avg("score").alias("score")).filter(F.col("n") >= floor)
    return t.platforms.filter("is_active").select(F.col("id").alias("platform_id")).join(g, "platform_id").withColumnRenamed("platform_id", "id")


_DIST = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)"
_NEAR = f"list_sort(list_transform(c, lambda q, i: {{'d': {_DIST}, 'i': i - 1}}))[1].i"
#: All points are one list, the state of the recursion is the list of centres: six draws, then rounds of means.
_KMEANS = f"""(with recursive pts as materialized (select list({{'id': id, 'x': x, 'y': y, 'n': n, 'score': score}} order by id) as ps from (
    select platform_id as id, count(*)::bigint as n, 100.0::double * count(*) filter (label = 'positive') / count(*) as x, 100.0::double * count(*) filter (label = 'negative') / count(*) as y, avg(score) as score
    from posts where collected_at >= timestamp '2024-01-24' and collected_at < timestamp '2024-01-31' and platform_id in (select id from platforms where is_active) group by 1 having count(*) >= 5)),
  f(step, c) as (select 0, []::struct(x double, y double)[] union all
    select step + 1, case when step < 6 then list_append(c, list_transform([list_sort(list_transform(ps, lambda p: {{'a': case when coalesce(list_min(list_transform(c, lambda q: {_DIST})), 1) > 0 then 0 else 1 end,
        'k': -ln((('0x' || substr(md5('42:' || step::varchar || ':' || p.id::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double) / case when coalesce(list_min(list_transform(c, lambda q: {_DIST})), 1.0::double) > 0 then coalesce(list_min(list_transform(c, lambda q: {_DIST})), 1.0::double) else 1.0::double end,
        'id': p.id, 'x': p.x, 'y': p.y}}))[1]], lambda w: {{'x': w.x, 'y': w.y}})[1])
      else list_transform(c, lambda m, j: case when len(list_filter(ps, lambda p: {_NEAR} = j - 1)) = 0 then m else
        {{'x': list_avg(list_transform(list_filter(ps, lambda p: {_NEAR} = j - 1), lambda p: p.x)), 'y': list_avg(list_transform(list_filter(ps, lambda p: {_NEAR} = j - 1), lambda p: p.y))}} end) end
    from f, pts where step < 46)
  select p.id as platform_id, p.n as n, p.x as x, p.y as y, p.score as score, {_NEAR} as cluster, c from (select c, unnest(ps) as p from f, pts where step = 46))"""


@query(f"select platform_id, n, round(x, 3) as x, round(y, 3) as y, cluster from {_KMEANS}")
def com_clusters(t: Tables, k: int = 6, seed: int = 42) -> DataFrame:
    """Clusters of platforms by their positive and negative percent."""
    found, _, _ = kmeans(cluster_points(t), max(2, min(k, 10)), seed)
    return found.select(F.col("id").alias("platform_id"), "n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "cluster")


@query(f"select cluster, count(*)::bigint as size, round(c[any_value(cluster) + 1].x, 3) as x, round(c[any_value(cluster) + 1].y, 3) as y, round(avg(score), 4) as score from {_KMEANS} group by cluster, c")
def com_cluster_centres(t: Tables, k: int = 6, seed: int = 42) -> DataFrame:
    """The centres with the number and mean score of their platforms; a centre without platforms isn't listed."""
    found, centres, _ = kmeans(cluster_points(t), max(2, min(k, 10)), seed)
    at = lambda axis: F.element_at(F.array(*[F.lit(round(c[axis], 3)) for c in centres]), (F.col("cluster") + 1).cast("int"))
    return found.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("score"), 4).alias("score")).select("cluster", "size", at(0).alias("x"), at(1).alias("y"), "score")


@query("""select platform_id, kind from (select *, case when p7 = 0 then 'dead_7d' end as a, case when p7 > 0 and p24 = 0 then 'idle_24h' end as b, case when s <= -0.05 then 'extreme_negative' end as c, case when p7 >= 14 and p24 < 0.9 * p7 / 7 then 'drop_rate' end as d from (
  select f.id as platform_id, count(v.id) filter (collected_at >= timestamp '2024-01-24') as p7, count(v.id) filter (collected_at >= timestamp '2024-01-30') as p24, round(avg(score), 6) as s from platforms f left join posts v on v.platform_id = f.id group by 1)), unnest([a, b, c, d]) u(kind) where kind is not null""", extreme=-0.05, drop=0.9)
def com_anomalies(t: Tables, extreme: float = -0.3, drop: float = 0.3) -> DataFrame:
    since = lambda d: F.count_if(F.col("collected_at") >= t.as_of - F.expr(f"interval {d} days"))
    g = t.posts.groupBy("platform_id").agg(since(7).alias("p7"), since(1).alias("p24"), F.round(F.avg("score"), 6).alias("s"))
    p = t.platforms.select(F.col("id").alias("platform_id")).join(g, "platform_id", "left").na.fill(0, ["p7", "p24"])
    kinds = F.array(F.when(F.col("p7") == 0, "dead_7d"), F.when((F.col("p7") > 0) & (F.col("p24") == 0), "idle_24h"), F.when(F.col("s") <= extreme, "extreme_negative"), F.when((F.col("p7") >= 14) & (F.col("p24") < F.col("p7") * drop / 7), "drop_rate"))
    return p.select("platform_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def change_points(df: DataFrame, key: str, at: str, value: str, w: int = 3, times: float = 2.0) -> DataFrame:
    """Rows where the means of w rows before and of w rows from here on differ by more than so many times the largest
    of both windows' population deviations and 5 % of the series' own. Constant series have none."""
    order, whole = Window.partitionBy(key).orderBy(at), Window.partitionBy(key)
    before, after = order.rowsBetween(-w, -1), order.rowsBetween(0, w - 1)
    d = df.select(
        key, at, F.avg(value).over(before).alias("__b"), F.avg(value).over(after).alias("__a"), F.stddev_pop(value).over(before).alias("__sb"), F.stddev_pop(value).over(after).alias("__sa"),
        F.stddev_pop(value).over(whole).alias("__all"), F.count("*").over(whole).alias("__k"), F.row_number().over(order).alias("__i"),
    )
    hit = F.abs(F.col("__a") - F.col("__b")) > F.greatest("__sb", "__sa", F.col("__all") * 0.05) * times
    inner = (F.col("__all") > 0) & (F.col("__i") > w) & (F.col("__i") <= F.col("__k") - w)
    return d.filter(inner & hit).select(key, at, F.round("__b", 4).alias("before"), F.round("__a", 4).alias("after"))


_BOTH = "over (partition by metric, category order by day rows between"


@query(f"""select metric, category, day, round(b, 4) as before, round(a, 4) as after from (select metric, category, day, avg(v) {_BOTH} 3 preceding and 1 preceding) as b, avg(v) {_BOTH} current row and 2 following) as a,
    stddev_pop(v) {_BOTH} 3 preceding and 1 preceding) as sb, stddev_pop(v) {_BOTH} current row and 2 following) as sa, stddev_pop(v) over (partition by metric, category) as sd, count(*) over (partition by metric, category) as k, row_number() over (partition by metric, category order by day) as i
  from (select 'count' as metric, category, published_at::date as day, count(*)::double as v from acats group by 2, 3 union all select 'sent_avg', category, published_at::date, avg(score) from acats group by 2, 3 having avg(score) is not null))
  where sd > 0 and i > 3 and i <= k - 3 and abs(a - b) > 2 * greatest(sb, sa, sd * 0.05)""")
def alg_change_points(t: Tables) -> DataFrame:
    """Change points of the daily counts and of the daily means of each category."""
    g = t.by_category(t.active).groupBy("category", day().alias("day")).agg(F.count("*").cast("double").alias("n"), F.avg("score").alias("s"))
    of = lambda c, name: change_points(g.filter(F.col(c).isNotNull()), "category", "day", c).withColumn("metric", F.lit(name))
    return of("n", "count").unionByName(of("s", "sent_avg"))


@query("""select week, product_id, n, round(s / nullif(c, 0), 4) as sent_avg from (select date_trunc('week', collected_at)::date as week, product_id, count(*)::bigint as n, sum(score::decimal(28,12))::double as s, count(score) as c from posts where product_id is not null group by 1, 2)""")
def tmp_series(t: Tables, bucket: str = "week") -> DataFrame:
    """From the stored rollup."""
    v = daily_scores(t).filter("product_id is not null").groupBy(F.to_date(F.date_trunc(bucket, "day")).alias("week"), "product_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    return v.select("week", "product_id", "n", F.round(ratio(F.col("s"), F.col("c")), 4).alias("sent_avg"))


@query("""select a.day, a.n as n1, b.n as n2, (a.n - b.n)::bigint as diff from (select published_at::date as day, count(*)::bigint as n from active where product_id = 1 group by 1) a join (select published_at::date as day, count(*)::bigint as n from active where product_id = 2 group by 1) b on a.day = b.day""")
def tmp_compare(t: Tables, first: int = 1, second: int = 2) -> DataFrame:
    of = lambda p, n: t.active.filter(F.col("product_id") == p).groupBy(day().alias("day")).agg(F.count("*").alias(n))
    return of(first, "n1").join(of(second, "n2"), "day").withColumn("diff", F.col("n1") - F.col("n2"))


def _z(x: Column, w) -> Column:
    sd = F.stddev_pop(x).over(w)
    return F.when(sd.isNull() | (sd == 0), 0.0).otherwise((x - F.avg(x).over(w)) / sd)


@query("""select country_code, n, round(m, 4) as sent_avg, case when coalesce(stddev_pop(m) over (), 0) = 0 then 0.0 else round((m - avg(m) over ()) / stddev_pop(m) over (), 4) end as z from (select country_code, count(*)::bigint as n, avg(score) as m from posts where country_code is not null and collected_at >= timestamp '2024-01-17' group by 1)""")
def geo_choropleth(t: Tables, days: int = 14) -> DataFrame:
    """From the stored rollup: whole days up to as_of."""
    first = F.to_date(t.as_of - F.expr(f"interval {days} days"))
    g = daily_scores(t).filter((F.col("day") >= first) & F.col("country_code").isNotNull()).groupBy("country_code").agg(F.sum("n").alias("n"), ratio(F.sum("s"), F.sum("c")).alias("m"))
    return g.select("country_code", "n", F.round("m", 4).alias("sent_avg"), F.round(_z(F.col("m"), Window.partitionBy(F.lit(1))), 4).alias("z"))


@query("""select kind, key, n from (select 'site' as kind, platform_id::varchar as key, count(*)::bigint as n, row_number() over (order by count(*) desc, platform_id::varchar) as r from active where country_code = 'C1' group by 2
  union all select 'product', product_id::varchar, count(*)::bigint, row_number() over (order by count(*) desc, product_id::varchar) from active where country_code = 'C1' and product_id is not null group by 2
  union all select 'category', category, count(*)::bigint, row_number() over (order by count(*) desc, category) from acats where country_code = 'C1' group by 2) where r <= 5""")
def geo_drilldown(t: Tables, country: str = "C1", top: int = 5) -> DataFrame:
    v = t.active.filter(F.col("country_code") == country)
    best = lambda df, kind, c: df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top).withColumn("kind", F.lit(kind))
    return best(v, "site", "platform_id").unionByName(best(v, "product", "product_id")).unionByName(best(t.by_category(v), "category", "category"))


@query("select date_trunc('week', published_at)::date as frame, country_code, count(*)::bigint as n from active where product_id = 1 and country_code is not null group by 1, 2")
def geo_diffusion(t: Tables, product: int = 1, bucket: str = "week") -> DataFrame:
    v = t.active.filter((F.col("product_id") == product) & F.col("country_code").isNotNull())
    return v.groupBy(F.to_date(F.date_trunc(bucket, "published_at")).alias("frame"), "country_code").agg(F.count("*").alias("n"))


@query("""select c.c as country_code, coalesce(n, 0)::bigint as n, round(coalesce(m, 0), 8) as mean, round(coalesce(m - 1.96 * 0.5 / sqrt(n), 0), 8) as low, round(coalesce(m + 1.96 * 0.5 / sqrt(n), 0), 8) as high from (values ('C1'), ('C2'), ('ZZ')) c(c)
  left join (select country_code, count(*) as n, avg(score) as m from active where product_id = 3 group by 1) x on x.country_code = c.c""")
def geo_product_compare(t: Tables, product: int = 3, countries=("C1", "C2", "ZZ")) -> DataFrame:
    """Requested countries stay with zeros where the product has no posts there."""
    g = t.active.filter((F.col("product_id") == product) & F.col("country_code").isin(*countries)).groupBy("country_code").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    domain = t.spark.range(1).select(F.explode(F.array(*map(F.lit, countries))).alias("country_code"))
    half = F.lit(1.96 * 0.5) / F.sqrt("n")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 8)
    return domain.join(g, "country_code", "left").select("country_code", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero(F.col("m")).alias("mean"), zero(F.col("m") - half).alias("low"), zero(F.col("m") + half).alias("high"))
