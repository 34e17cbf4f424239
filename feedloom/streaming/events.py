"""Event-time streams over the events table: windows with watermarks, deduplication and rule cooldown.

Each runs as a Structured Streaming query with trigger(availableNow), so the same plan serves a
backlog and a live stream; the result of a registered query is what the sink holds at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.plans.registry import query
from feedloom.plans.storage import exists, fresh_path
from feedloom.sources.posts import Tables


def read_events(t: Tables) -> DataFrame:
    """The events as a stream; event time as a timestamp, which watermarks need."""
    path = f"{t.sf_dir}/[e]vents.parquet"  # as a pattern it may be a file or a folder that new files come into
    raw = t.spark.readStream.schema(t.table("events").schema).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there. Every batch's rows are written to the shared folder by
    foreachBatch, a replayed batch over its own. Mode update with keys is an upsert: of each key the latest batch's row holds, so that
    the state keeps only what the watermark leaves open. With mode complete the last batch is the whole result."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream")
    parts: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        parts.append(number)

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
    started.awaitTermination()
    if not parts:
        return spark.createDataFrame([], stream.schema)
    keep = parts[-1:] if mode == "complete" else sorted(set(parts))
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={n}" for n in keep])
    if not keys:
        return rows.select(*stream.columns)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


@query("select event_type, ts::date as day, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def st_tumbling(t: Tables) -> DataFrame:
    e = read_events(t).withWatermark("ts", "1 day")
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drain(g, "update", ["window", "event_type"]).select("event_type", F.to_date("window.start").alias("day"), "n", F.round("total", 4).alias("total"))


@query("select s.s::date as day, event_type, count(*)::bigint as n from events join range(date '2023-12-30', date '2024-02-02', interval 1 day) s(s) on ts >= s.s and ts < s.s + interval 3 day group by 1, 2")
def st_sliding(t: Tables) -> DataFrame:
    """Three-day windows that start each day."""
    g = read_events(t).withWatermark("ts", "1 day").groupBy(F.window("ts", "3 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drain(g, "update", ["window", "event_type"]).select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("""select user_id, count(*)::bigint as sessions, max(n)::bigint as longest from (select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id) as s from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 12 hour then 0 else 1 end as new from events)) group by 1, 2) group by 1""")
def st_session(t: Tables) -> DataFrame:
    """Sessions of a user that end after 12 hours of silence. The last ones are still open when the backlog ends, and
    Spark has no update mode for sessions, so the stream completes; a live one appends, which frees what the watermark has passed."""
    g = read_events(t).withWatermark("ts", "1 day").groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n"))
    return drain(g, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("select event_type, count(distinct event_id)::bigint as n from events group by 1")
def st_dedup(t: Tables) -> DataFrame:
    """Each event once: the stream is joined with itself as a redelivery and deduplicated within the watermark."""
    e = read_events(t).select("event_id", "ts", "event_type")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "2 days")
    return drain(twice.dropDuplicatesWithinWatermark(["event_id"]), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with recursive e as materialized (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as r from events where event_type = 'error'),
  f(user_id, r, last, fired) as (select user_id, r, ts, 1 from e where r = 1 union all select e.user_id, e.r, case when e.ts - f.last >= interval 2 day then e.ts else f.last end, f.fired + (case when e.ts - f.last >= interval 2 day then 1 else 0 end) from f join e on e.user_id = f.user_id and e.r = f.r + 1)
select user_id, max(fired)::bigint as fired from f group by 1""".replace("with recursive e", "select * from (with recursive e") + ")")
def st_cooldown(t: Tables, seconds: int = 2 * 86400) -> DataFrame:
    """How often each user's rule fires when a firing silences it for two days. The state is the time of the last firing, held
    by key; a batch's events of a key come in time order."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        last, fired = state.get if state.exists else (None, 0)
        times = sorted(x for b in batches for x in b["at"].tolist())
        for x in times:
            if last is None or x - last >= seconds * 1_000_000:
                last, fired = x, fired + 1
        state.update((last, fired))
        yield pd.DataFrame({"user_id": [key[0]], "fired": [fired]})

    e = read_events(t).filter("event_type = 'error'").select("user_id", F.unix_micros("ts").alias("at"))
    out = e.groupBy("user_id").applyInPandasWithState(step, "user_id long, fired long", "last long, fired long", "update", GroupStateTimeout.NoTimeout)
    return drain(out, "update").groupBy("user_id").agg(F.max("fired").alias("fired"))


@query("select event_type, count(*)::bigint as n from events group by 1")
def st_idempotent_sink(t: Tables) -> DataFrame:
    """An append sink that ignores rows it already has: a replayed batch adds nothing."""
    path = fresh_path(t.spark, "sink")
    rows = t.table("events")
    for _ in range(2):
        append_new(rows, path, ["event_id"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the sink lacks, one a key: what an insert with
    on-conflict-do-nothing does."""
    spark: SparkSession = rows.sparkSession
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in rows.columns if c not in keys]))).filter("__r = 1").drop("__r")
    have = spark.read.parquet(path).select(*keys) if exists(spark, path) else None
    (first if have is None else first.join(have, keys, "left_anti")).write.mode("append").parquet(path)
