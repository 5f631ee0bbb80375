"""Invariants of a journal, as queries that return violations, and latency metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runfold.functions import scalars as S


def duplicate_commits(commits: DataFrame) -> DataFrame:
    return commits.groupBy("effect_key").agg(F.count(F.lit(1)).alias("commits")).where("commits > 1")


def live_leases(leases: DataFrame, now) -> DataFrame:
    """Tasks with more than one live lease."""
    return leases.where(F.col("expires_at") > now).groupBy("task_id").agg(F.count(F.lit(1)).alias("leases")).where("leases > 1")


def stuck_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Running runs with a dead-lettered task and no open one: nothing will advance them."""
    state = tasks.groupBy("run_id").agg(F.count_if(F.col("status") == "DEAD_LETTER").alias("dead"), F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("open"))
    return runs.where("status = 'RUNNING'").join(state.where("dead > 0 and open = 0"), "run_id").select("run_id", "dead")


def claimed_early(tasks: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pending tasks whose delivery is held back, though a scan over tasks would send them now."""
    held = deliveries.where("published_at is null and available_at is not null")
    return tasks.where("status = 'PENDING'").join(held.select("task_id", F.col("available_at").alias("not_before")), "task_id").where("available_at < not_before").select("task_id", "available_at", "not_before")


def unresolved_unknown(effects: DataFrame) -> DataFrame:
    """Unknown effects that no rule can resolve."""
    return effects.where((F.col("status") == "UNKNOWN") & ~S.can_auto_resolve(F.col("effect_class"))).select("effect_key", "effect_class")


def latency(log: DataFrame, start: str, end: str, key: str = "run_id") -> DataFrame:
    """Seconds from each step's first ``start`` event to its first ``end`` event after it: key, step_id, seconds."""
    rows = log.where(F.col("event_type").isin(start, end)).select(key, "step_id", "created_at", (F.col("event_type") == end).alias("__end"))
    first = F.min(F.when(~F.col("__end"), F.col("created_at"))).over(Window.partitionBy(key, "step_id"))
    after = rows.withColumn("__a", first).where("__end and created_at >= __a").groupBy(key, "step_id").agg(F.min("__a").alias("a"), F.min("created_at").alias("b"))
    return after.select(key, "step_id", F.timestamp_diff("SECOND", F.col("a"), F.col("b")).alias("seconds"))


def percentiles(rows: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles with a mergeable sketch."""
    found = rows.agg(F.percentile_approx(value, F.array(*[F.lit(p) for p in at]), F.lit(accuracy)).alias("p"))
    return found.select(*[F.col("p")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(at)])
