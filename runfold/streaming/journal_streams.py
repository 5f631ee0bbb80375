"""Structured Streaming over journals: deduplicated signals, durable timers, an idempotent relay.

Nothing here has a watermark: a journal drops no event for being late. State is kept by
run, and what ends by time ends by processing-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runfold.functions import envelope
from runfold.operators.folds import CLOSERS, OPENERS
from runfold.session import ship

INDEFINITE_MS = 253402300799000
WAIT_STATE = "step_id string, kind string, until_ms long, opened long, seq long, signals string"
WAIT_OUT = "run_id string, seq long, action string, step_id string, kind string, until_ms long"


def stream_parquet(spark: SparkSession, folder: str, glob: str, files: int = 100) -> DataFrame:
    """Files of a folder as a stream, at most ``files`` a micro-batch; the schema is that of the files present."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def distinct_signals(signals: DataFrame) -> DataFrame:
    """Each (run_id, signal_id) once, over all time. The state grows with the distinct ids and is kept by key."""
    return signals.dropDuplicates(["run_id", "signal_id"])


def split_deliveries(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): deliveries decoded, and those that can't be read with the reason."""
    decoded = raw.withColumn("__d", envelope.decode_delivery(F.col(column)))
    good = decoded.where("__d.error is null").select(*raw.columns, F.col("__d.task_id").alias("task_id"))
    return good, decoded.where("__d.error is not null").select(*raw.columns, F.col("__d.error").alias("error"))


def fold_wait(state: tuple | None, rows: list[tuple]) -> tuple | None:
    """The open wait after events (seq, event_type, step_id, until_ms) in order; null where there is none.

    The last opener counts, and a later closer of its own step closes it.
    """
    for seq, kind, step, until in rows:
        if kind in OPENERS:
            state = (step, "TIMER" if kind == "TIMER_SET" else "SIGNAL", INDEFINITE_MS if until is None or pd.isna(until) else int(until), int(seq))
        elif kind in CLOSERS and state and state[0] == step and seq > state[3]:
            state = None
    return state


def durable_waits(events: DataFrame, until_ms: Column, timers: bool = True) -> DataFrame:
    """Rows (run_id, seq, action, step_id, kind, until_ms) as waits open, close and come due.

    events: (run_id, seq, event_type, step_id). After each batch a run with news says OPEN or
    CLOSED. With ``timers``, a wait whose time has come says TIMER_FIRED or SIGNAL_WAIT_TIMED_OUT once, by processing time.
    Events of a run must come in order over batches, in any order inside one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WAIT_OUT.split(", ")]
        if state.hasTimedOut:
            wait = state.get
            state.remove()
            yield pd.DataFrame([(key[0], wait[3], "TIMER_FIRED" if wait[1] == "TIMER" else "SIGNAL_WAIT_TIMED_OUT", wait[0], wait[1], wait[2])], columns=names)
            return
        rows = sorted(r for b in batches for r in zip(b["seq"].tolist(), b["event_type"], b["step_id"], b["until_ms"].astype(object).where(b["until_ms"].notna(), None), strict=True))
        before = state.get[:4] if state.exists else None
        after = fold_wait(before, rows)
        if after:
            state.update((*after, rows[-1][0], ""))
            left = after[2] - state.getCurrentProcessingTimeMs() if timers else 0
            if timers and after[2] < INDEFINITE_MS:
                state.setTimeoutDuration(max(1, int(left)))
        elif state.exists:
            state.remove()
        shown = after or (None, None, None, None)
        yield pd.DataFrame([(key[0], rows[-1][0], "OPEN" if after else "CLOSED", shown[0], shown[1], shown[2])], columns=names)

    ship(events.sparkSession)
    keyed = events.select("run_id", "seq", "event_type", "step_id", until_ms.cast("long").alias("until_ms"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return keyed.groupBy("run_id").applyInPandasWithState(step, WAIT_OUT, WAIT_STATE, "append", timeout)


def relay(deliveries: DataFrame, out: str, checkpoint: str):
    """A sink that a batch run twice writes once: each micro-batch replaces the folder of its number."""

    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return deliveries.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat_sessions(beats: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Spans in which a worker's beats follow one another within the lease: worker_id, first and last, beats."""
    window = F.session_window("ts", gap)
    return beats.groupBy("worker_id", window.alias("w")).agg(F.count(F.lit(1)).alias("beats")).select("worker_id", F.col("w.start").alias("first"), F.col("w.end").alias("free_at"), "beats")
