"""Cooldown of alert rules as a stateful stream with event-time timers.

A key is a rule and a metric. An event waits in the key's state until the watermark has passed it, so that late ones are judged in their place: then, in order
of time, it fires if the key's last firing is at least the cooldown away. A timer wakes a key that gets no more events, and when the cooldown
of its last firing is over too, its state is given up: a key that is silent costs nothing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.plans.registry import query
from feedloom.sources.posts import Tables
from feedloom.streaming.events import drain, read_events

FIRED = "rule string, metric string, id long, fired_at timestamp"


class Cooldown(StatefulProcessor):
    """Rows rule, metric, id, ts -> those that fire. Nothing else is kept than waiting events and the last firing, in milliseconds."""

    def __init__(self, seconds: int):
        self.wait = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        fresh = [(int(at), int(i)) for part in rows for at, i in zip(part["ts"].astype("datetime64[ms]").astype("int64"), part["id"], strict=True)]
        yield from self._judge(key, timerValues, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._judge(key, timerValues, [])

    def _judge(self, key, timerValues, fresh: list[tuple[int, int]]) -> Iterator:
        import pandas as pd

        seen = timerValues.getCurrentWatermarkInMs()
        events = sorted([(x[0], x[1]) for x in self.waiting.get()] + fresh) if self.waiting.exists() else sorted(fresh)
        last = self.last.get()[0] if self.last.exists() else None
        fired, rest = [], []
        for at, i in events:
            if at > seen:
                rest.append((at, i))
            elif last is None or at - last >= self.wait:
                last = at
                fired.append((at, i))
        if last is not None and last + self.wait <= seen and not rest:
            last = None  # the cooldown is over for every event that can still come
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(rest[0][0])
        elif last is not None:
            self.handle.registerTimer(last + self.wait)
        if fired:
            yield pd.DataFrame({"rule": [key[0]] * len(fired), "metric": [key[1]] * len(fired), "id": [i for _, i in fired], "fired_at": pd.to_datetime([at for at, _ in fired], unit="ms")})


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, which timers need; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def firings(stream: DataFrame, seconds: int, delay: str) -> DataFrame:
    """The events of a stream (rule, metric, id, ts) that fire, each once the watermark, delay behind the latest event, has passed it. Events that
    come later than that are dropped; null rules and metrics are keys like others, events without a time are none. Start it within rocksdb()."""
    rows = stream.filter("ts is not null").select(F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("metric", F.lit("")).alias("metric"), "id", "ts").withWatermark("ts", delay)
    return rows.groupBy("rule", "metric").transformWithStateInPandas(Cooldown(seconds), FIRED, "Append", "EventTime")


@query("""with recursive e as materialized (select 'band ' || floor(value / 100)::bigint::varchar as rule, 'm' || (user_id % 10)::varchar as metric, epoch_us(ts) // 1000 as tm, event_id as id from events where event_type = 'error'),
  g as materialized (select *, row_number() over (partition by rule, metric order by tm, id) as r from e where tm <= (select max(tm) - 86400000 from e)),
  f(rule, metric, r, last, fired) as (select rule, metric, r, tm, 1 from g where r = 1 union all select g.rule, g.metric, g.r, case when g.tm - f.last >= 172800000 then g.tm else f.last end, f.fired + case when g.tm - f.last >= 172800000 then 1 else 0 end from f join g on g.rule = f.rule and g.metric = f.metric and g.r = f.r + 1)
select rule, metric, max(fired)::bigint as fired, max(last)::bigint as last from f group by 1, 2""".replace("with recursive e", "select * from (with recursive e") + ")")
def st_cooldown_timers(t: Tables, seconds: int = 2 * 86400, delay: str = "1 day") -> DataFrame:
    """How often each rule and metric fires up to the watermark, and when last, in milliseconds."""
    e = read_events(t).filter("event_type = 'error'")
    rows = e.select(F.concat(F.lit("band "), F.floor(F.col("value") / 100).cast("string")).alias("rule"), F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("metric"), F.col("event_id").alias("id"), "ts")
    with rocksdb(t.spark):
        fired = drain(firings(rows, seconds, delay), "append")
    return fired.groupBy("rule", "metric").agg(F.count("*").alias("fired"), F.max(F.unix_millis("fired_at")).alias("last"))
