"""What operations say of themselves while they run: keyed state over a stream of their events, with time-outs.

    started, progressed and finished events of an operation -> a row each, and `timed out` where nothing more was heard

The stream keeps one small row of state for each open operation and a timer in event time; `narrated_batch` says the same of
events that are all there, by windows. Watermarks decide how long a stream waits for late events, which it leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STARTED, PROGRESSED, FINISHED, TIMED_OUT = "started", "progressed", "finished", "timed out"
#: Events: an operation's key, what it says, when (microseconds and as a timestamp), and a number that orders ties.
ROWS = "key string, state string, at_us long, n_progress long, elapsed_us long"
STATE = "started_us long, last_us long, n_progress long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def narration_events(df: DataFrame, key: str, kind: str, ts: str, number: str, kinds: dict[str, str]) -> DataFrame:
    """Rows (key, kind, ts, at_us, number) of events whose kind is one of kinds (theirs to ours)."""
    ours = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col(kind))
    at = F.col(ts).cast("timestamp")
    out = df.filter(F.col(kind).isin(*kinds)).select(F.col(key).cast("string").alias("key"), ours.alias("kind"), at.alias("ts"), F.unix_micros(at).alias("at_us"), F.col(number).cast("long").alias("number"))
    return out.filter("key is not null and ts is not null")


class Narrator(StatefulProcessor):
    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _set(self, now: tuple[int, int, int] | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
            self.handle.registerTimer((now[1] + self.timeout_us) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A key's events of a batch in their order; what state has is the last that is known of it."""
        events = pd.concat(list(rows)).sort_values(["at_us", "number"])
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for kind, at in zip(events["kind"], events["at_us"].astype(int), strict=True):
            if now and at - now[1] > self.timeout_us:
                out.append((TIMED_OUT, now[1] + self.timeout_us, now[2], now[1] + self.timeout_us - now[0]))
                now = None
            if kind == STARTED:
                now = (at, at, 0)
                out.append((STARTED, at, 0, 0))
            elif now and kind == PROGRESSED:
                now = (now[0], at, now[2] + 1)
                out.append((PROGRESSED, at, now[2], at - now[0]))
            elif now and kind == FINISHED:
                out.append((FINISHED, at, now[2], at - now[0]))
                now = None
        self._set(now)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            began, last, n = tuple(self.open.get())
            out.append((TIMED_OUT, last + self.timeout_us, n, last + self.timeout_us - began))
            self.open.clear()
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in ROWS.split(", ")])

    def close(self) -> None:
        pass


def narrated_stream(events: DataFrame, timeout_s: float, late: str = "0 seconds") -> DataFrame:
    """Rows ROWS of a stream of events (narration_events). The session's state store is set to the one that keeps
    timers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=Narrator(int(timeout_s * 1e6)), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")


def narrated_batch(events: DataFrame, timeout_s: float, until_us: int | None = None) -> DataFrame:
    """Rows ROWS of events that are all there. until_us: what was last heard at all (default: the last event); an
    operation that is open then has timed out if its time was over before."""
    timeout = int(timeout_s * 1e6)
    until = until_us if until_us is not None else events.agg(F.max("at_us")).first()[0]
    w = Window.partitionBy("key").orderBy("at_us", "number")
    e = events.withColumn("before", F.lag("at_us").over(w)).withColumn("after", F.lead("at_us").over(w))
    e = e.withColumn("part", F.sum((F.coalesce(F.col("at_us") - F.col("before") > timeout, F.lit(False))).cast("int")).over(w))
    past = Window.partitionBy("key", "part").orderBy("at_us", "number").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(F.col("kind").isin(STARTED, FINISHED), F.struct("kind", "at_us"))
    e = e.withColumn("edge", F.last(edge, ignorenulls=True).over(past))
    e = e.filter((F.col("kind") == STARTED) | (F.col("edge.kind") == STARTED)).withColumn("began", F.when(F.col("kind") == STARTED, F.col("at_us")).otherwise(F.col("edge.at_us")))
    so_far = Window.partitionBy("key", "part", "began").orderBy("at_us", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("n", F.sum((F.col("kind") == PROGRESSED).cast("long")).over(so_far))
    said = e.select("key", F.col("kind").alias("state"), "at_us", F.col("n").alias("n_progress"), (F.col("at_us") - F.col("began")).alias("elapsed_us"))
    over = F.col("at_us") + timeout
    silent = e.filter((F.col("kind") != FINISHED) & F.when(F.col("after").isNotNull(), F.col("after") > over).otherwise(over < F.lit(until)))
    return said.unionByName(silent.select("key", F.lit(TIMED_OUT).alias("state"), over.alias("at_us"), F.col("n").alias("n_progress"), (over - F.col("began")).alias("elapsed_us")))


def narrate(events: DataFrame, to: str, checkpoint: str, timeout_s: float, late: str = "0 seconds", once: bool = True) -> StreamingQuery:
    """Write what a stream of events says below to. once: what is there now, then stop."""
    w = narrated_stream(events, timeout_s, late).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def narrated_files(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A stream of events (narration_events) that are written to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
