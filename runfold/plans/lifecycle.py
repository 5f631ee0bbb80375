"""What follows for each run, task or effect, evaluated set-at-a-time as decision tables.

Nothing here calls out or writes: each function turns relations into rows that say what the
live system would do next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.functions import scalars as S


def advance_plan(runs: DataFrame, waits: DataFrame, fanouts: DataFrame, signals: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """run_id and action: the first rule that holds, from terminal runs to the decider's decision.

    waits: open waits (run_id, step_id, kind, until, name); fanouts: open unsatisfied ones (run_id);
    signals: oldest unconsumed (run_id, name, signal_id); decisions (run_id, kind, n_calls, policy).
    """
    stored = signals.select("run_id", F.col("name").alias("__name"), F.col("signal_id"))
    w = waits.join(stored, (waits["run_id"] == stored["run_id"]) & (waits["name"] == stored["__name"]), "left").select(waits["run_id"], F.col("kind").alias("wait"), "until", "signal_id")
    joined = runs.join(w, "run_id", "left").join(fanouts.select("run_id", F.lit(True).alias("joining")), "run_id", "left").join(decisions.withColumnRenamed("kind", "decision"), "run_id", "left")
    over = F.col("until") <= now
    bad = S.policy_error(F.col("policy"), F.col("n_calls")).isNotNull()
    action = (
        F.when(S.run_terminal(F.col("status")), "NONE")
        .when((F.col("wait") == "TIMER") & over, "TIMER_FIRED")
        .when((F.col("wait") == "SIGNAL") & F.col("signal_id").isNotNull(), "SIGNAL_RECEIVED")
        .when((F.col("wait") == "SIGNAL") & over, "SIGNAL_WAIT_TIMED_OUT")
        .when(F.col("wait").isNotNull() & F.col("available_at").isNull(), "REPARK")
        .when(F.col("wait").isNotNull(), "NONE")
        .when(F.col("joining"), "NONE")
        .when(F.col("decision").isNull(), "RETRY_LATER")
        .when(F.col("decision") == "ERROR", "RUN_FAILED")
        .when(F.col("decision") == "CALL_TOOL", "TASK_CREATED")
        .when((F.col("decision") == "CALL_TOOL_PARALLEL") & bad, "RUN_FAILED")
        .when(F.col("decision") == "CALL_TOOL_PARALLEL", "FAN_OUT_STARTED")
        .when(F.col("decision") == "SLEEP", "TIMER_SET")
        .when(F.col("decision") == "WAIT_FOR_SIGNAL", "SIGNAL_WAIT_STARTED")
        .when(F.col("decision") == "COMPLETE", "RUN_COMPLETED")
        .when(F.col("decision") == "FAIL", "RUN_FAILED")
        .when(F.col("decision") == "CANCEL", "RUN_CANCELLED")
        .otherwise("RUN_FAILED")
    )
    return joined.select("run_id", action.alias("action"))


def dispatch_rows(decisions: DataFrame) -> DataFrame:
    """Tasks that decisions create: one for a call, one for each child of a fan-out; decisions (run_id, step_id, kind, n_calls)."""
    steps = F.when(F.col("kind") == "CALL_TOOL", F.array("step_id")).when(F.col("kind") == "CALL_TOOL_PARALLEL", S.children(F.col("step_id"), F.col("n_calls"))).otherwise(F.array().cast("array<string>"))
    made = decisions.select("run_id", F.explode(steps).alias("step_id"))
    return made.select("run_id", "step_id", F.concat("run_id", F.lit("/"), "step_id").alias("task_id"), F.lit("PENDING").alias("status"))


def failure_plan(failures: DataFrame) -> DataFrame:
    """What a failed task leads to. failures: (task_id, step_id, attempt, max_attempts, token_current, escalated)."""
    child = S.child_index(F.col("step_id")) >= 0
    done = S.exhausted(F.col("attempt"), F.col("max_attempts")) | F.col("escalated")
    current = F.col("token_current")
    status = F.when(~current, F.lit("UNCHANGED")).when(done, "DEAD_LETTER").otherwise("PENDING")
    events = F.when(~current, F.lit("")).when(done, "TASK_FAILED(final),TASK_DEAD_LETTERED").otherwise("TASK_FAILED,TASK_RETRY_SCHEDULED")
    run = F.when(~current | ~done, F.lit("UNCHANGED")).when(F.col("escalated"), "FAILED").when(child, "ADVANCE").otherwise("FAILED")
    return failures.select("task_id", status.alias("task"), events.alias("events"), run.alias("run"))


def reaper_plan(expired: DataFrame) -> DataFrame:
    """Expired leases of running tasks: fenced off, then retried at once or dead-lettered."""
    done = S.exhausted(F.col("attempt"), F.col("max_attempts"))
    return expired.where("status = 'RUNNING'").select("task_id", F.when(done, "DEAD_LETTER").otherwise("PENDING").alias("task"), F.when(done, "LEASE_EXPIRED,TASK_DEAD_LETTERED").otherwise("LEASE_EXPIRED,TASK_RETRY_SCHEDULED").alias("events"), (F.col("fencing_token") + 1).alias("token"))


def reconcile_live(effects: DataFrame, now: Column) -> DataFrame:
    """A live task's open effect: effects with reconcilable, key_ttl_seconds and the provider's answer."""
    expired = S.key_expired(F.col("created_at"), now, F.col("key_ttl_seconds"))
    action = (
        F.when(expired, "ESCALATE")
        .when(F.col("effect_class") == "IDEMPOTENT_BY_KEY", "PERFORM")
        .when((F.col("effect_class") == "QUERYABLE") & ~F.col("reconcilable"), "ESCALATE")
        .when((F.col("effect_class") == "QUERYABLE") & (F.col("answer") == "COMMITTED"), "EFFECT_RECONCILED")
        .when((F.col("effect_class") == "QUERYABLE") & (F.col("answer") == "NOT_EXECUTED"), "PERFORM")
        .when(F.col("effect_class") == "QUERYABLE", "STAY_UNKNOWN")
        .otherwise("ESCALATE")
    )
    return effects.where(F.col("status").isin("RUNNING", "UNKNOWN")).select("effect_key", action.alias("action"))


def reconcile_background(stale: DataFrame, tools: DataFrame, now: Column) -> DataFrame:
    """The sweep over stale effects: never performs anything again. Unknown tools are skipped."""
    joined = stale.join(tools.select(F.col("name").alias("effect_type"), "reconcilable", "key_ttl_seconds"), "effect_type", "left")
    expired = S.key_expired(F.col("created_at"), now, F.col("key_ttl_seconds"))
    after = (
        F.when(F.col("reconcilable").isNull(), F.col("status"))
        .when(expired | ~F.col("reconcilable"), "UNKNOWN")
        .when(F.col("answer") == "COMMITTED", "COMMITTED")
        .when(F.col("answer") == "NOT_EXECUTED", "FAILED")
        .otherwise("UNKNOWN")
    )
    return joined.select("effect_key", F.col("status").alias("before"), after.alias("after"))


def recovery_plan(tasks: DataFrame, effects: DataFrame) -> DataFrame:
    """Action for each running task from its effect, if it has one."""
    joined = tasks.where("status = 'RUNNING'").join(effects.select("task_id", F.col("status").alias("effect_status"), "effect_class"), "task_id", "left")
    has = F.col("effect_status").isNotNull()
    return joined.select("task_id", S.recovery_action(has, F.col("effect_status"), F.col("effect_class")).alias("action"))


def wait_text(waits: DataFrame, now: Column) -> DataFrame:
    """Open waits described for people."""
    what = F.when(F.col("kind") == "TIMER", "sleeping").otherwise("waiting for a signal")
    at = F.concat(what, F.lit(" at step "), "step_id")
    until = F.concat(at, F.lit(" until "), F.date_format("until", "yyyy-MM-dd HH:mm:ss"))
    late, left = F.timestamp_diff("SECOND", F.col("until"), now), F.timestamp_diff("SECOND", now, F.col("until"))
    text = F.when(S.is_indefinite(F.col("until")), F.concat(at, F.lit(", with no scheduled wake-up"))).when(F.col("until") <= now, F.concat(until, F.lit(" (due "), S.duration_text(late), F.lit(" ago)"))).otherwise(F.concat(until, F.lit(" (in "), S.duration_text(left), F.lit(")")))
    return waits.select("run_id", text.alias("description"))


def finish_plan(decisions: DataFrame) -> DataFrame:
    """Runs that a decision ends: status, event, and whether the reason stays on the run (a cancel's is in its event alone)."""
    ends = F.create_map(*[F.lit(x) for pair in (("COMPLETE", "COMPLETED"), ("FAIL", "FAILED"), ("CANCEL", "CANCELLED")) for x in pair])
    ended = decisions.withColumn("status", F.try_element_at(ends, "kind")).where("status is not null")
    return ended.select("run_id", "status", F.concat(F.lit("RUN_"), "status").alias("event"), (F.col("kind") == "FAIL").alias("keeps_reason"))


def start_rows(asked: DataFrame, agent: str, version: str) -> DataFrame:
    """The run that each request (run_id, input) starts, pinned to a version, and its first event."""
    body = F.to_json(F.struct(F.lit(agent).alias("agent_name"), F.lit(version).alias("agent_version"), F.col("input")))
    return asked.select("run_id", F.lit(agent).alias("agent_name"), F.lit(version).alias("agent_version"), F.lit("RUNNING").alias("status"), F.lit(0).cast("long").alias("version"), F.lit(1).cast("long").alias("seq"), F.lit("RUN_STARTED").alias("event_type"), body.alias("body"))


def execute_plan(tasks: DataFrame, effects: DataFrame, tools: DataFrame) -> DataFrame:
    """How each pending task goes through the ledger, and the events that leaves before any call.

    A tool without a consequence is called past the ledger; an unknown tool is an error. A task without an effect
    reserves one; what is there decides by the recovery rule.
    """
    named = tools.select(F.col("name").alias("task_type"), F.col("effect_class").alias("__class"))
    held = effects.select("task_id", F.col("status").alias("__status"))
    joined = tasks.where("status = 'PENDING'").join(named, "task_type", "left").join(held, "task_id", "left")
    has = F.col("__status").isNotNull()
    rule = S.recovery_action(has, F.col("__status"), F.col("__class"))
    action = F.when(F.col("__class").isNull(), "UNKNOWN_TOOL").when(~S.has_consequence(F.col("__class")), "CALL").otherwise(rule)
    events = F.when(action.isin("UNKNOWN_TOOL", "CALL"), "").when(~has, "EFFECT_CREATED").when(action == "ESCALATE", "EFFECT_ESCALATED").otherwise("")
    return joined.select("task_id", action.alias("action"), events.alias("events"))


def perform_rows(calls: DataFrame) -> DataFrame:
    """Ledger rows of calls (effect_key, status, ok, certainty): into RUNNING, which has no event, then to what the call's end says."""
    end = S.classify_failure(F.col("ok"), F.col("certainty"))
    rows = F.array(
        F.struct(F.lit(1).alias("n"), F.col("status").alias("from"), F.lit("RUNNING").alias("to"), F.lit(None).cast("string").alias("event")),
        F.struct(F.lit(2).alias("n"), F.lit("RUNNING").alias("from"), end.alias("to"), F.concat(F.lit("EFFECT_"), end).alias("event")),
    )
    return calls.select("effect_key", F.explode(rows).alias("r")).select("effect_key", "r.*")


def recovery_scan(runs: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """What one scan does: (what, id) PUBLISH for each due pending task, ADVANCE for each ready run without an open one."""
    due = tasks.where((F.col("status") == "PENDING") & (F.col("available_at") <= now)).select(F.lit("PUBLISH").alias("what"), F.col("task_id").alias("id"))
    open_ = tasks.where(F.col("status").isin("PENDING", "RUNNING")).select("run_id")
    ready = runs.where((F.col("status") == "RUNNING") & ~S.waiting(F.col("available_at"), now)).join(open_, "run_id", "left_anti")
    return due.unionByName(ready.select(F.lit("ADVANCE").alias("what"), F.col("run_id").alias("id")))


def after_park(waits: DataFrame, signals: DataFrame) -> DataFrame:
    """Runs that park for a signal (run_id, step_id, name): ADVANCE at once with the oldest stored one, else WAIT."""
    oldest = signals.groupBy("run_id", "name").agg(F.min(F.struct("created_at", "signal_id")).alias("s")).select("run_id", "name", "s.signal_id")
    return waits.join(oldest, ["run_id", "name"], "left").select("run_id", "step_id", "signal_id", F.when(F.col("signal_id").isNotNull(), "ADVANCE").otherwise("WAIT").alias("action"))
