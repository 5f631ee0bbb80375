"""Operational queries over current state: joins, anti joins, aggregates, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.functions import scalars as S


def top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows by a total order; 0 or less means all."""
    ordered = rows.orderBy(*order)
    return ordered.limit(limit) if limit > 0 else ordered


def runs_awaiting_advance(runs: DataFrame, tasks: DataFrame, now: Column, limit: int = 0) -> DataFrame:
    """Running, ready runs without an open task."""
    ready = runs.where((F.col("status") == "RUNNING") & ~S.waiting(F.col("available_at"), now))
    open_ = tasks.where(F.col("status").isin("PENDING", "RUNNING")).select("run_id")
    return top(ready.join(open_, "run_id", "left_anti").select("run_id", "agent_name", "agent_version"), [F.col("run_id")], limit)


def expired_leases(leases: DataFrame, tasks: DataFrame, now: Column, limit: int = 0) -> DataFrame:
    """Leases at their end whose task is not terminal, oldest end first."""
    live = tasks.where(~S.task_terminal(F.col("status"))).select("task_id", "status", "attempt", "max_attempts", "step_id")
    joined = leases.where(F.col("expires_at") <= now).join(live, "task_id")
    return top(joined, [F.col("expires_at"), F.col("task_id")], limit)


def unconsumed_signal(waits: DataFrame, signals: DataFrame, consumed: DataFrame) -> DataFrame:
    """The oldest stored signal of each wait's name that the run has not consumed."""
    left = signals.join(waits, ["run_id", "name"]).join(consumed, ["run_id", "signal_id"], "left_anti")
    return left.groupBy("run_id", "name").agg(F.min(F.struct("created_at", "signal_id")).alias("s")).select("run_id", "name", "s.signal_id", "s.created_at")


def with_tool(tasks: DataFrame, tools: DataFrame) -> DataFrame:
    """Tasks with their tool's descriptor; ``error`` where there is none. Descriptors are a small table; the planner sizes it."""
    named = tools.select(F.col("name").alias("task_type"), "effect_class", "reconcilable")
    return tasks.join(named, "task_type", "left").withColumn("error", F.when(F.col("effect_class").isNull(), "tool not found"))


def pick_decider(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """How each running run finds a decider session: by agent and pinned version, else why not."""
    exact = sessions.where("decides").groupBy("agent_name", "agent_version").agg(F.min("session_id").alias("session_id"))
    agents = sessions.where("decides").select("agent_name").distinct().withColumn("__known", F.lit(True))
    joined = runs.where("status = 'RUNNING'").join(exact, ["agent_name", "agent_version"], "left").join(agents, "agent_name", "left")
    why = F.when(F.col("session_id").isNotNull(), "OK").when(F.col("__known").isNull(), "NO_WORKER").otherwise("WRONG_VERSION")
    return joined.select("run_id", "agent_name", "agent_version", "session_id", why.alias("outcome"))


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent does not exist."""
    return rows.join(parents.select(key), key, "left_anti")


def replay_mismatches(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Steps of a replay that differ from the record in tool or payload: the divergence a replay must stop at."""
    joined = recorded.alias("a").join(replayed.alias("b"), ["run_id", "step_id"])
    return joined.where((F.col("a.task_type") != F.col("b.task_type")) | ~F.col("a.payload").eqNullSafe(F.col("b.payload"))).select("run_id", "step_id", F.col("a.task_type").alias("recorded"), F.col("b.task_type").alias("replayed"))


def next_seq(runs: DataFrame, log: DataFrame) -> DataFrame:
    last = log.groupBy("run_id").agg(F.max("seq").alias("last"))
    return runs.select("run_id").join(last, "run_id", "left").select("run_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("next_seq"))


def next_wake_up(runs: DataFrame, after: Column) -> DataFrame:
    """The earliest park strictly after the instant, of running runs."""
    return runs.where("status = 'RUNNING'").where(F.col("available_at") > after).agg(F.min("available_at").alias("wake_at"))


def next_token(leases: DataFrame) -> DataFrame:
    return leases.groupBy("task_id").agg((F.max("fencing_token") + 1).alias("next_token"))


def class_conflicts(tools: DataFrame) -> DataFrame:
    """Tools whose workers declare different classes."""
    return tools.groupBy("agent_name", "name").agg(F.count_distinct("effect_class").alias("classes"), F.min("effect_class").alias("least"), F.max("effect_class").alias("most")).where("classes > 1")


def pending_tasks(tasks: DataFrame, now: Column, limit: int) -> DataFrame:
    due = tasks.where(F.col("status") == "PENDING").where(F.col("available_at") <= now)
    return top(due, [F.col("priority").desc(), F.col("created_at"), F.col("task_id")], limit)


def assign_tasks(tasks: DataFrame, workers: DataFrame, now: Column, visible: Column) -> DataFrame:
    """One due task for each worker, each task once: the n-th task by rank goes to the n-th worker.

    Only as many tasks as there are workers are ranked, so the global order is a bounded top-k.
    """
    n = workers.count()
    best = top(tasks.where(F.col("status") == "PENDING").where(F.col("available_at") <= now), [F.col("priority").desc(), F.col("available_at"), F.col("created_at"), F.col("task_id")], max(1, n))
    one = F.lit(0)
    ranked = best.withColumn("__n", F.row_number().over(Window.partitionBy(one).orderBy(F.col("priority").desc(), "available_at", "created_at", "task_id")))
    named = workers.withColumn("__n", F.row_number().over(Window.partitionBy(one).orderBy("worker_id")))
    return ranked.join(named, "__n").select("task_id", "worker_id", visible.alias("visible_at"))


def pending_deliveries(deliveries: DataFrame, now: Column, limit: int) -> DataFrame:
    due = deliveries.where("published_at is null").where(F.col("available_at").isNull() | (F.col("available_at") <= now))
    return top(due, [F.col("outbox_id")], limit)


def unresolved_effects(effects: DataFrame, before: Column, limit: int = 0) -> DataFrame:
    stale = effects.where(F.col("status").isin("RUNNING", "UNKNOWN")).where(F.col("updated_at") < before)
    return top(stale, [F.col("updated_at"), F.col("effect_key")], limit)


def round_robin(calls: DataFrame, order: list[Column], key: str, n: int) -> DataFrame:
    """Each key's calls dealt in turn to its ``n`` workers."""
    return calls.withColumn("worker", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) % n)


def scan_delay(wake: DataFrame, now: Column, interval_ms: int, floor_ms: int = 50) -> DataFrame:
    """Milliseconds until the next scan: until the wake-up, within floor and interval."""
    until = F.timestamp_diff("MILLISECOND", now, F.col("wake_at"))
    return wake.select(F.greatest(F.lit(floor_ms), F.least(F.lit(interval_ms), F.coalesce(until, F.lit(interval_ms)))).cast("long").alias("delay_ms"))


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def mark_delivered(deliveries: DataFrame, sent: DataFrame, at: Column) -> DataFrame:
    """Deliveries with those in ``sent`` (outbox_id) published at ``at``, unless they were before."""
    flags = sent.select("outbox_id").distinct().withColumn("__sent", F.lit(True))
    return deliveries.join(flags, "outbox_id", "left").withColumn("published_at", F.coalesce("published_at", F.when(F.col("__sent"), at))).drop("__sent")


def union_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both, the first source's where a key is in both."""
    return left.unionByName(right.join(left.select(key).distinct(), key, "left_anti"))


def runs_of_agent(runs: DataFrame, agent: str) -> DataFrame:
    """Running runs that belong to the agent."""
    return runs.where((F.col("status") == "RUNNING") & (F.col("agent_name") == agent))


def record_sweep(deliveries: DataFrame, sent: DataFrame, at: Column) -> DataFrame:
    """Deliveries after a sweep: sent (outbox_id, error) without an error are published, others count an attempt and keep the error."""
    what = sent.groupBy("outbox_id").agg(F.max(F.struct(F.col("error").isNotNull().alias("failed"), "error")).alias("__s"))
    joined = deliveries.join(what, "outbox_id", "left")
    open_ = F.col("published_at").isNull()
    failed = F.coalesce(F.col("__s.failed"), F.lit(False)) & open_
    published = F.coalesce("published_at", F.when(F.col("__s").isNotNull() & ~F.col("__s.failed"), at))
    return joined.withColumns({"attempts": F.col("attempts") + failed.cast("int"), "last_error": F.when(failed, F.col("__s.error")), "published_at": published}).drop("__s")


def retake(tasks: DataFrame, taken: DataFrame, now: Column, limit: int) -> DataFrame:
    """Tasks due at ``now`` after some were taken (task_id, visible_at): a taken one is hidden until its time, then due like any other."""
    hidden = tasks.join(taken.select("task_id", F.col("visible_at").alias("__visible")), "task_id", "left").withColumn("available_at", F.coalesce("__visible", "available_at")).drop("__visible")
    due = hidden.where(F.col("status") == "PENDING").where(F.col("available_at") <= now)
    return top(due, [F.col("priority").desc(), F.col("available_at"), F.col("created_at"), F.col("task_id")], limit)


def apply_migrations(versions: DataFrame, applied: DataFrame, name: str) -> DataFrame:
    """Every version with whether it is applied and the place at which a run applies it (null where it is); versions are few."""
    known = versions.select(name).distinct().join(applied.select(name).distinct().withColumn("applied", F.lit(True)), name, "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    place = F.when(~F.col("applied"), F.row_number().over(Window.partitionBy("applied").orderBy(name)))
    return known.withColumn("nth", place)
