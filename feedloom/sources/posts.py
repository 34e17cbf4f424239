"""The customer-post data model over the given tables.

`posts` is the fact table, one customer post a row. It and its children come from the driver's
tables by fixed rules, so that every operator runs on data that grows with the input; a user with a
real post table passes DataFrames to Tables instead.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for the current time: the end of the events. Every window counts back from it.
AS_OF = "2024-01-31 00:00:00"
ANCHOR = "2024-01-30"


class Tables:
    """Lazily read tables. Any of them can be given as a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF, anchor: str = ANCHOR, **given: DataFrame):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of, self.anchor = F.to_timestamp_ntz(F.lit(as_of)), F.to_date(F.lit(anchor))
        self.given = frozenset(given)
        for name, df in given.items():
            self.__dict__[name] = df

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def posts(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
        kind, value, null = F.col("event_type"), F.col("value"), F.lit(None)
        label = F.when(kind == "error", "negative").when(kind.isin("purchase", "signup"), "positive").when((kind == "view") & (F.col("k") % 13 == 0), null).otherwise("neutral")
        score = F.when(kind == "error", -F.least(value, F.lit(100.0)) / 100).when(kind.isin("purchase", "signup"), F.least(value, F.lit(100.0)) / 100)
        score = score.when((kind == "view") & (F.col("k") % 13 == 0), null).otherwise(0.0)
        first = F.concat(F.lit("cat"), (F.col("k") % 12).cast("string"))
        cats = F.when(F.col("k") % 11 == 0, null).when(F.col("k") % 2 == 0, F.array(first)).otherwise(F.array(first, F.concat(F.lit("cat"), ((F.col("k") + 5) % 12).cast("string"))))
        return self.table("events").withColumn("k", k).select(
            F.col("event_id").alias("id"), F.when(F.col("k") % 7 != 0, F.col("k") % 10 + 1).alias("product_id"), (F.col("user_id") % 20 + 1).alias("platform_id"),
            F.when(F.col("user_id") % 9 != 0, F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string"))).alias("country_code"),
            F.when(F.col("k") % 3 == 0, "ko").when(F.col("k") % 3 == 1, "en").otherwise("de").alias("language"),
            label.alias("label"), score.alias("score"), cats.alias("categories"), F.floor("value").cast("long").alias("likes"), F.col("k").alias("comments"), (F.col("k") % 5).alias("shares"),
            F.col("ts").alias("published_at"), F.col("ts").alias("collected_at"), F.when(F.col("event_id") % 10 == 0, F.col("ts")).alias("archived_at"),
            F.when(F.col("k") % 17 != 0, F.concat(kind, F.lit(" at KW"), (F.col("k") % 40).cast("string"), F.lit(", kw"), (40 + F.floor("value") % 30).cast("string"), F.repeat(F.lit("!"), F.col("k").cast("int") % 3))).alias("body"),
        )

    @cached_property
    def active(self) -> DataFrame:
        return self.posts.filter(F.col("archived_at").isNull())

    @cached_property
    def keywords(self) -> DataFrame:
        """post_id, keyword: three a post."""
        word = lambda n: F.concat(F.lit("kw"), n.cast("string"))
        three = F.array(word(F.col("comments") % 40), word(40 + F.col("likes") % 30), word(70 + (F.col("comments") + F.col("likes")) % 25))
        return self.posts.select(F.col("id").alias("post_id"), F.explode(three).alias("keyword"))

    def mentions(self, posts: DataFrame | None = None) -> DataFrame:
        """Posts joined with their keywords: a row a mention."""
        posts = self.posts if posts is None else posts
        return posts.join(self.keywords, posts["id"] == F.col("post_id"))

    def by_category(self, posts: DataFrame | None = None) -> DataFrame:
        return (self.posts if posts is None else posts).withColumn("category", F.explode("categories"))

    @cached_property
    def products(self) -> DataFrame:
        p = self.table("part").filter("p_partkey <= 10")
        return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), F.when(F.col("p_partkey") <= 5, "S1").otherwise("S2").alias("series"), F.date_add(F.lit("2024-01-03").cast("date"), (F.col("p_partkey") - 1).cast("int")).alias("released_at"))

    @cached_property
    def platforms(self) -> DataFrame:
        s = self.table("supplier").filter("s_suppkey <= 20").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("site"), F.col("s_suppkey").cast("string")).alias("code"), F.col("r_name").alias("region"), (F.col("s_suppkey") % 10 != 0).alias("is_active"))

    def recent(self, posts: DataFrame, days: int, column: str = "collected_at") -> DataFrame:
        """Rows of the last days before as_of, half open."""
        return posts.filter((F.col(column) >= self.as_of - F.expr(f"interval {days} days")) & (F.col(column) < self.as_of))

    def since(self, posts: DataFrame, days: int) -> DataFrame:
        """Rows published from days before the anchor date to that date, both included."""
        return posts.filter(F.to_date("published_at").between(F.date_sub(self.anchor, days), self.anchor))

    def window(self, posts: DataFrame, days: int) -> DataFrame:
        """Rows published in the days up to and with the anchor date."""
        day = F.to_date("published_at")
        return posts.filter((day > F.date_sub(self.anchor, days)) & (day <= self.anchor))


SQL_VIEWS = """
with posts as (
  select event_id as id, case when k % 7 <> 0 then k % 10 + 1 end as product_id, user_id % 20 + 1 as platform_id,
    case when user_id % 9 <> 0 then 'C' || (user_id % 25)::varchar end as country_code,
    case k % 3 when 0 then 'ko' when 1 then 'en' else 'de' end as language,
    case when event_type = 'error' then 'negative' when event_type in ('purchase', 'signup') then 'positive' when event_type = 'view' and k % 13 = 0 then null else 'neutral' end as label,
    case when event_type = 'error' then -least(value, 100.0) / 100 when event_type in ('purchase', 'signup') then least(value, 100.0) / 100 when event_type = 'view' and k % 13 = 0 then null else 0.0 end as score,
    case when k % 11 = 0 then null when k % 2 = 0 then ['cat' || (k % 12)::varchar] else ['cat' || (k % 12)::varchar, 'cat' || ((k + 5) % 12)::varchar] end as categories,
    floor(value)::bigint as likes, k as comments, k % 5 as shares, ts as published_at, ts as collected_at, case when event_id % 10 = 0 then ts end as archived_at,
    case when k % 17 <> 0 then event_type || ' at KW' || (k % 40)::varchar || ', kw' || (40 + floor(value)::bigint % 30)::varchar || repeat('!', (k % 3)::int) end as body
  from (select *, regexp_extract(props, '([0-9]+)', 1)::bigint as k from events)),
active as (select * from posts where archived_at is null),
kws as (select id as post_id, unnest(['kw' || (comments % 40)::varchar, 'kw' || (40 + likes % 30)::varchar, 'kw' || (70 + (comments + likes) % 25)::varchar]) as keyword from posts),
cats as (select * exclude (categories), unnest(categories) as category from posts),
acats as (select * from cats where archived_at is null),
mentions as (select * from posts join kws on id = post_id),
amentions as (select * from active join kws on id = post_id),
products as (select p_partkey as id, 'P' || p_partkey::varchar as code, case when p_partkey <= 5 then 'S1' else 'S2' end as series, date '2024-01-03' + (p_partkey - 1)::int as released_at from part where p_partkey <= 10),
platforms as (select s_suppkey as id, 'site' || s_suppkey::varchar as code, r_name as region, s_suppkey % 10 <> 0 as is_active
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey <= 20)
"""
