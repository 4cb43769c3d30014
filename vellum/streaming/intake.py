"""Intake streams: validation, rate limits, routing, running views. Each has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("bug", "suggestion")
BURST, PERIOD_S, DAILY = 3, 60, 15


def first_error(kind: Column, title: Column, email: Column) -> Column:
    """The code of the first rule that a report breaks, null if none."""
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown_kind").when(F.trim(F.coalesce(title, F.lit(""))) == "", "missing_title").when(F.length(title) > 200, "title_too_long")
        .when(email.isNotNull() & ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "bad_email")
    )


def burst_limit(reports: DataFrame, key: str, ts: str, limit: int = BURST, period_s: int = PERIOD_S) -> DataFrame:
    """reports with accepted: a sliding log per key; refused requests take no place in it. Equal times go by event_id.

    A pause of a period empties the log, so a key's requests fall into bouts that are judged apart. Within one the log
    depends on order: its times are folded as one sorted array, and the fold keeps only the log.
    """
    w = Window.partitionBy(key).orderBy("t", "event_id")
    timed = reports.select(key, F.col(ts).cast("timestamp").cast("double").alias("t"), "event_id")
    bouts = timed.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w) >= period_s).cast("long"), F.lit(0))).withColumn("_bout", F.sum("_new").over(w))
    rows = bouts.groupBy(key, "_bout").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("rows"))
    zero = F.struct(F.array().cast("array<double>").alias("log"), F.array().cast("array<struct<event_id:bigint,accepted:boolean>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        log = F.filter(acc["log"], lambda t: t > r["t"] - period_s)
        ok = F.size(log) < limit
        return F.struct(F.when(ok, F.concat(log, F.array(r["t"]))).otherwise(log).alias("log"), F.concat(acc["out"], F.array(F.struct(r["event_id"].alias("event_id"), ok.alias("accepted")))).alias("out"))

    return rows.select(key, F.explode(F.aggregate("rows", zero, step)["out"]).alias("o")).select(key, "o.event_id", "o.accepted")


def daily_cap(reports: DataFrame, key: str, ts: str, cap: int = DAILY) -> DataFrame:
    """reports with accepted: the first cap of each key and UTC day."""
    w = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, "event_id")
    return reports.withColumn("accepted", F.row_number().over(w) <= cap)


def stream_burst_limit(reports: DataFrame, key: str, limit: int = BURST, period_s: int = PERIOD_S) -> DataFrame:
    """The streaming form of burst_limit on (key, ts, event_id), with state per key."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for t, event in zip(rows["ts"].map(lambda x: x.replace(tzinfo=timezone.utc).timestamp() if isinstance(x, datetime) else x), rows["event_id"], strict=True):
            log = [x for x in log if x > t - period_s]
            ok = len(log) < limit
            if ok:
                log.append(t)
            out.append((k[0], event, ok))
        state.update((log,))
        yield pd.DataFrame(out, columns=[key, "event_id", "accepted"])

    kind = reports.schema[key].dataType.simpleString()
    return reports.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def route(reports: DataFrame, private: list[str], to_private: Callable[[DataFrame], None], to_public: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: contact details to one sink, the rest to another."""

    def put(batch: DataFrame, epoch: int) -> None:
        to_private(batch.select("event_id", *private))
        to_public(batch.drop(*private))

    return put


def stream_recent(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key so far (update mode)."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("m")).select(key, F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))


def stream_progress(events: DataFrame, job: str) -> DataFrame:
    """job, stage and done: the latest stage and the count of events (update mode)."""
    return events.groupBy(job).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.count("*").alias("done"))


def stream_index(docs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """New documents' lines appended to an index of Parquet files; the checkpoint makes each file count once."""
    from ..sources.derived import doc_lines

    return doc_lines(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
