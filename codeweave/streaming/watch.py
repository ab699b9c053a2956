"""Live refresh: file events, filtered and debounced, trigger an incremental build.

The debounce is global, as there is one index to refresh: a burst ends after a quiet gap. In a table, bursts are
found within stretches of time first, each stretch on its own; only one row a stretch then decides which bursts go on
in the next one.

A stream keeps one open burst. It ends when an event comes whose time is more than the gap later, or, with no further
event at all, when the gap has passed on the clock: a processing-time timeout of the state, for which Spark runs batches
without data. So the last save is refreshed too. (After a restart Spark runs these batches from the first new event on; a
burst that was open then ends with it. The watch command indexes the tree when it starts, so nothing waits for that.) Events are put together within each partition before they meet, so what
the one state sees is a row for each burst of an Arrow batch, not a row for each event.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeweave.functions.text import language_of
from codeweave.sources.rules import SKIPPED

EVENT = "src_path string, dest_path string, is_directory boolean, ts timestamp"
GAP = "1.5 seconds"


def relevant(path: Column, root: str) -> Column:
    """A source file under ``root`` with no hidden or skipped directory on the way; null paths aren't."""
    inside = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)
    parts = F.split(inside, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(above, lambda p: F.startswith(p, F.lit(".")) | p.isin(*sorted(SKIPPED)))
    return F.coalesce(F.startswith(path, F.lit(root.rstrip("/") + "/")) & language_of(path).isNotNull() & ~bad, F.lit(False))


def is_head(path: Column, root: str) -> Column:
    return F.coalesce(path == f"{root.rstrip('/')}/.git/HEAD", F.lit(False))


def dispatch(events: DataFrame, root: str) -> DataFrame:
    """Events that matter, with ``head``: whether a branch was switched."""
    head = is_head(F.col("src_path"), root) | is_head(F.col("dest_path"), root)
    keep = head | relevant(F.col("src_path"), root) | relevant(F.col("dest_path"), root)
    return events.where(~F.coalesce("is_directory", F.lit(False)) & keep).withColumn("head", head)


def _bursts(rows: DataFrame, gap: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.session_window("ts", gap)).agg(
        F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("n_events"), F.max("head").alias("head")
    )


_BURST = "first long, last long, n long, head boolean"


def merged(parts: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Bursts (first, last, n, head; times in microseconds) of parts of bursts that may overlap."""
    parts = parts.sort_values("first", kind="stable")
    burst = (parts["first"] > parts["last"].cummax().shift() + gap).cumsum()
    return parts.groupby(burst).agg(first=("first", "min"), last=("last", "max"), n=("n", "sum"), head=("head", "max"))


def _in_stream(rows: DataFrame, gap: str) -> DataFrame:
    micros = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield merged(f, micros)

    def held(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done = pd.DataFrame([state.get], columns=["first", "last", "n", "head"])
            state.remove()
        else:
            known = [pd.DataFrame([state.get], columns=["first", "last", "n", "head"])] if state.exists else []
            bursts = merged(pd.concat([*known, *frames]), micros)
            done, now = bursts.iloc[:-1], bursts.iloc[-1]
            state.update((int(now["first"]), int(now["last"]), int(now["n"]), bool(now["head"])))
            state.setTimeoutDuration(max(1, micros // 1000))
        yield done

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = rows.select(at.alias("first"), at.alias("last"), F.lit(1).cast("long").alias("n"), "head").mapInPandas(local, _BURST)
    bursts = parts.withColumn("all", F.lit(0)).groupBy("all").applyInPandasWithState(held, _BURST, _BURST, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return bursts.select(F.timestamp_micros("first").alias("first_event"), F.timestamp_micros("last").alias("last_event"), F.col("n").alias("n_events"), "head")


def debounce(events: DataFrame, gap: str = GAP, stretch: int = 3600) -> DataFrame:
    """(first_event, last_event, n_events, reason) of each burst of events (ts, head); events without a time are in none."""
    rows = events.where("ts IS NOT NULL")
    if events.isStreaming:
        burst = _in_stream(rows, gap)
    else:
        burst = _joined(_bursts(rows.withColumn("stretch", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (stretch * 1_000_000))), gap, "stretch"), gap)
    reason = F.when(F.col("head"), "branch switched").otherwise("files changed")
    return burst.select("first_event", "last_event", "n_events", reason.alias("reason"))


def _joined(parts: DataFrame, gap: str) -> DataFrame:
    """Bursts of single stretches, put together where one goes on in the next stretch that has events."""
    edges = parts.groupBy("stretch").agg(F.min("first_event").alias("low"), F.max("last_event").alias("high"), F.count("*").alias("bursts"))
    in_time = Window.orderBy("stretch")  # over one row a stretch, not over events
    goes_on = F.coalesce(F.col("low") <= F.lag("high").over(in_time) + F.expr(f"INTERVAL {gap}"), F.lit(False))
    edges = edges.withColumn("goes_on", goes_on)
    # the stretch in which the burst began that is open at the end of this one
    began = F.last(F.when(~F.col("goes_on") | (F.col("bursts") > 1), F.col("stretch")), ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.withColumn("began", began).withColumn("before", F.when(F.col("goes_on"), F.lag("began").over(in_time)))
    at_edge = parts.join(edges, "stretch")
    open_burst = F.when(F.col("last_event") == F.col("high"), F.col("began")).when(F.col("first_event") == F.col("low"), F.col("before"))
    keyed = at_edge.withColumn("burst", open_burst).withColumn("alone", F.when(F.col("burst").isNull(), F.col("first_event")))
    return keyed.groupBy("burst", "alone").agg(
        F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), F.sum("n_events").alias("n_events"), F.max("head").alias("head")
    )


def watch(events: DataFrame, root: str, refresh: Callable[[str], None], checkpoint: str, gap: str = GAP, trigger: dict | None = None) -> StreamingQuery:
    """Calls ``refresh(reason)`` once for each burst; a failed refresh is logged, and the watch goes on."""

    def fire(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("last_event").select("reason").collect():  # one row a burst
            try:
                refresh(row["reason"])
            except Exception:
                logging.getLogger(__name__).exception("refresh failed")

    bursts = debounce(dispatch(events, root), gap)
    writer = bursts.writeStream.foreachBatch(fire).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"}))
    conf, partitions = events.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(partitions)
    conf.set(partitions, 1)  # one state; a query keeps the settings that it starts with
    try:
        return writer.start()
    finally:
        conf.set(partitions, before)
