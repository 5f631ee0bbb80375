"""Ordered folds over a run's log, in relational form: last opener, later closers, join verdicts.

Every fold needs the log partitioned by run once; no step gathers more than one run's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.functions import scalars as S

OPENERS = ("TIMER_SET", "SIGNAL_WAIT_STARTED")
CLOSERS = ("TIMER_FIRED", "SIGNAL_RECEIVED", "SIGNAL_WAIT_TIMED_OUT")


def last_by(rows: DataFrame, keys: list[str], order: Column, values: dict[str, Column]) -> DataFrame:
    """Values of the last row by ``order`` for each key, with map-side aggregation."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[v.alias(k) for k, v in values.items()]), order).alias("__last")).select(*keys, "__last.*")


def pending_wait(log: DataFrame, until: Column) -> DataFrame:
    """Open waits: run_id, step_id, seq, kind, until. The last opener counts, and only a later closer
    of its own step closes it. ``until``: the opener's instant; null is indefinite."""
    opened = last_by(log.where(F.col("event_type").isin(*OPENERS)), ["run_id"], F.col("seq"), {"step_id": F.col("step_id"), "seq": F.col("seq"), "kind": F.when(F.col("event_type") == "TIMER_SET", "TIMER").otherwise("SIGNAL"), "until": F.coalesce(until, F.lit(S.INDEFINITE).cast("timestamp_ntz"))})
    closed = log.where(F.col("event_type").isin(*CLOSERS)).groupBy("run_id", "step_id").agg(F.max("seq").alias("closed"))
    return opened.join(closed, ["run_id", "step_id"], "left").where("closed is null or closed < seq").drop("closed")


def fanout_children(log: DataFrame, key: str = "run_id") -> DataFrame:
    """Children of each run's last fan-out: key, opened, step, policy, n, ok, settled.

    Only a child's exact name counts. A completion settles it with success, a failure only where it
    is final; the last of these decides. ``key`` names a run; where the log is partitioned by it, nothing is shuffled.
    """
    opener = F.col("event_type") == "FAN_OUT_STARTED"
    settles = (F.col("event_type") == "TASK_COMPLETED") | ((F.col("event_type") == "TASK_FAILED") & F.col("final"))
    last = F.max(F.when(opener, F.struct(F.col("seq").alias("opened"), F.col("step_id").alias("step"), F.col("policy").alias("policy"), F.col("n_calls").alias("n")))).over(Window.partitionBy(key))
    index = S.child_index(F.col("step_id"))
    exact = (index >= 0) & (index < F.col("f.n")) & (F.col("step_id") == S.child(F.col("f.step"), index)) & (F.col("seq") > F.col("f.opened"))
    rows = log.where(opener | settles).withColumn("f", last).where("f is not null").withColumn("child", F.when(F.coalesce(settles & exact, F.lit(False)), index))
    outcome = rows.groupBy(key, "child").agg(F.max("f").alias("f"), F.max_by(F.col("event_type") == "TASK_COMPLETED", "seq").alias("ok"))
    counts = outcome.groupBy(key).agg(F.max("f").alias("f"), F.count_if(F.col("ok") & F.col("child").isNotNull()).alias("ok"), F.count("child").alias("settled"))
    return counts.select(key, "f.*", "ok", "settled")


def pending_fanout(log: DataFrame, key: str = "run_id") -> DataFrame:
    """Fan-outs whose join is not satisfied yet."""
    return fanout_children(log, key).where(~S.satisfied(F.col("policy"), F.col("n"), F.col("ok"), F.col("settled")))


def history_steps(log: DataFrame, key: str = "run_id") -> DataFrame:
    """State of each called step: decided, completed or failed.

    The last creation counts, and what came after it: a completion wins over a final failure, before or after it. A
    completion before the step's first creation is an error; a failure of a step that was never created is none of its.
    """
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("seq"))
    seen = log.where(F.col("event_type").isin("TASK_CREATED", "TASK_COMPLETED", "TASK_FAILED")).groupBy(key, "step_id").agg(
        F.min(at("TASK_CREATED")).alias("first"),
        F.max(at("TASK_CREATED")).alias("created"),
        F.min(at("TASK_COMPLETED")).alias("early"),
        F.max(at("TASK_COMPLETED")).alias("completed"),
        F.max(F.when(F.col("final"), at("TASK_FAILED"))).alias("failed"),
    )
    since = lambda c: F.coalesce(F.col(c) > F.coalesce("created", F.lit(-1)), F.lit(False))
    state = F.when(since("completed"), "COMPLETED").when(since("failed"), "FAILED").otherwise("DECIDED")
    error = F.when(F.col("early").isNotNull() & F.coalesce(F.col("early") < F.col("first"), F.lit(True)), "completion without creation")
    return seen.where("first is not null or early is not null").select(key, "step_id", state.alias("state"), error.alias("error"))


def history_waits(log: DataFrame) -> DataFrame:
    """Waits by step: open, resolved or timed out; a resolution with no wait before it is an error.

    The last opener counts and the last closer after it; a step without an opener has no state.
    """
    waits = log.where(F.col("event_type").isin(*OPENERS, *CLOSERS))
    opener = F.when(F.col("event_type").isin(*OPENERS), F.col("seq"))
    closer = F.when(F.col("event_type").isin(*CLOSERS), F.col("seq"))
    seen = waits.groupBy("run_id", "step_id").agg(F.min(opener).alias("first"), F.max(opener).alias("opened"), F.min(closer).alias("early"), F.max(closer).alias("closed"), F.max_by("event_type", closer).alias("kind"))
    state = F.when(F.col("opened").isNull(), F.lit(None).cast("string")).when(F.coalesce(F.col("closed") < F.col("opened"), F.lit(True)), "OPEN").when(F.col("kind") == "SIGNAL_WAIT_TIMED_OUT", "TIMED_OUT").otherwise("RESOLVED")
    early = F.col("early").isNotNull() & F.coalesce(F.col("early") < F.col("first"), F.lit(True))
    return seen.select("run_id", "step_id", state.alias("state"), F.when(early, "resolution without wait").alias("error"))


def static_decision(log: DataFrame, result: Column, plan_length: int) -> DataFrame:
    """A static plan's next decision: its next step, or COMPLETE with the last result after ``plan_length`` completions."""
    done = F.col("event_type") == "TASK_COMPLETED"
    state = log.groupBy("run_id").agg(F.count_if(done).alias("completed"), F.max_by(F.when(done, result), F.when(done, F.col("seq"))).alias("last_result"))
    finished = F.col("completed") >= plan_length
    return state.select("run_id", F.when(finished, "COMPLETE").otherwise("CALL_TOOL").alias("decision"), F.when(~finished, F.concat(F.lit("S"), F.col("completed") + 1)).alias("next_step"), F.when(finished, F.col("last_result")).alias("output"))


def consumed_signals(log: DataFrame, signal_id: Column) -> DataFrame:
    return log.where("event_type = 'SIGNAL_RECEIVED'").select("run_id", signal_id.alias("signal_id")).where("signal_id is not null").distinct()


def clock(log: DataFrame) -> DataFrame:
    """A run's deterministic clock: the time of its first event."""
    return log.groupBy("run_id").agg(F.min_by("created_at", "seq").alias("started_at"))


def seq_gaps(log: DataFrame) -> DataFrame:
    """Rows before which numbers are missing or repeat: run_id, seq, previous."""
    previous = F.coalesce(F.lag("seq").over(Window.partitionBy("run_id").orderBy("seq")), F.lit(0).cast("long"))
    return log.select("run_id", "seq", previous.alias("previous")).where("seq <> previous + 1")
