"""Streams: the state of jobs by event, and rates over sliding windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job string, status string, token long, seq long"
STATE = "token long, seq long, status string, ended boolean"
#: Statuses after which an attempt takes no more events.
TERMINAL = ("done", "error")


def apply_events(state: tuple | None, events: list[tuple[int, int, str]]) -> tuple:
    """(token, seq, status, ended) after events (token, seq, status) in order of token and seq. Events of an older attempt
    are stale; a newer attempt starts afresh; an ended attempt takes no more."""
    token, last, status, ended = state or (-1, -1, "", False)
    for t, s, what in sorted(events):
        if t < token or (t == token and (ended or s <= last)):
            continue
        token, last, status, ended = t, s, what, what in TERMINAL
    return token, last, status, ended


def job_states(events: DataFrame, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """events(job string, token long, seq long, status string), streaming -> a row per job and batch in which it changes.

    A job without an event for the timeout that hasn't ended becomes an error: its process is gone.
    With a timeout a stream runs batches without end; None is for streams that take what is there and stop.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        if state.hasTimedOut:
            token, seq, status, ended = old
            state.remove()
            if not ended:
                yield pd.DataFrame([(key[0], "error", token, seq + 1)], columns=["job", "status", "token", "seq"])
            return
        rows = [(int(t), int(s), w) for p in parts for t, s, w in zip(p["token"], p["seq"], p["status"], strict=True)]
        new = apply_events(old, rows)
        state.update(new)
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        if new != old:
            yield pd.DataFrame([(key[0], new[2], new[0], new[1])], columns=["job", "status", "token", "seq"])

    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("job").applyInPandasWithState(step, OUT, STATE, "update", kind)


def rates(events: DataFrame, ts: str, by: str, value: str, length: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Events and their value per window and group, streaming or batch; events later than `late` are dropped by a stream."""
    marked = events.withWatermark(ts, late)
    return marked.groupBy(F.window(ts, length, slide), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def upsert_batches(target: str, keys: list[str]):
    """A foreachBatch function that keeps the newest row per key (by `seq`; of equal ones the later batch's) in a versioned
    Parquet table: each batch writes version N + 1 from version N, so a batch that runs twice gives the same table, and a
    batch that comes late replaces nothing newer. Single writer."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_epoch", F.lit(epoch))
        if epoch:
            old = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/v{epoch - 1}")
            rows = rows.unionByName(old.withColumn("_epoch", F.lit(-1)))
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct("seq", "_epoch")).alias("_r")).select("_r.*")
        newest.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return write
