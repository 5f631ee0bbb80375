"""The registered queries over the journal relations; each has its DuckDB SQL in `runfold.oracle`."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runfold.functions import envelope as E
from runfold.functions import scalars as S
from runfold.operators import audit, folds, relations, writes
from runfold.operators import replay as replay_
from runfold.plans import lifecycle
from runfold.session import ship
from runfold.sources.journal import NOW_EVENTS, STREAM_TYPES, Journal, by_name, choose, minutes, now
from runfold.streaming import journal_streams as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Journal], DataFrame]) -> Callable[[Journal], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Journal(spark, sf_dir))
    return f


def at(c: str | Column, name: str | None = None) -> Column:
    """A time as text to the microsecond, the same in every engine."""
    column = F.col(c) if isinstance(c, str) else c
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


def tools(j: Journal) -> DataFrame:
    """Descriptors of tool0 to tool2; tool3 is not registered."""
    return j.spark.createDataFrame([("tool0", "NONE", False, 0), ("tool1", "IDEMPOTENT_BY_KEY", True, 86400), ("tool2", "QUERYABLE", True, 10**9)], "name string, effect_class string, reconcilable boolean, key_ttl_seconds long")


def stream_until() -> Column:
    """When a wait of the event log ends: timers after value minutes, signals never."""
    return F.when(F.col("event_type") == "TIMER_SET", F.col("created_at") + minutes(F.col("value")))


def near(j: Journal) -> writes.Near:
    """Lines and what is made of them are dealt by their order."""
    return "l_orderkey", j.parts


def verdict_columns(rows: DataFrame) -> list[Column]:
    return ["run_id", "policy", "n", "ok", "settled", S.policy_error(F.col("policy"), F.col("n")).alias("error"), S.satisfied(F.col("policy"), F.col("n"), F.col("ok"), F.col("settled")).alias("satisfied")]


@query
def fanout_join_verdict(j: Journal) -> DataFrame:
    flags = j.table("lineitem").groupBy(F.concat(F.lit("R"), "l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("ok"), F.count_if(F.col("l_returnflag") != "N").alias("settled"))
    rows = j.runs.join(flags, "run_id", "left").select("run_id", "policy", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "ok", "settled")])
    return rows.select(*verdict_columns(rows))


@query
def run_by_id(j: Journal) -> DataFrame:
    return j.only("R42").runs.select("run_id", "agent_name", "agent_version", "status", "version")


@query
def task_by_id(j: Journal) -> DataFrame:
    return j.only("R42").tasks.where("task_id = 'T42.0'").select("task_id", "run_id", "step_id", "task_type", "status", "priority", at("created_at"))


@query
def tasks_of_run(j: Journal) -> DataFrame:
    return j.only("R42").tasks.orderBy("created_at", "task_id").select("task_id", "step_id", "status", at("created_at"))


@query
def history_of_run(j: Journal) -> DataFrame:
    return j.only("R42").log.orderBy("seq").select("seq", "event_type", "step_id", at("created_at"))


@query
def effect_by_key(j: Journal) -> DataFrame:
    return j.only("R42").effects.where("effect_key = 'R42:S1.0:E1'").select("effect_key", "effect_class", "status")


@query
def effects_of_run(j: Journal) -> DataFrame:
    return j.only("R42").effects.orderBy("created_at", "effect_key").select("effect_key", "status", at("created_at"))


@query
def lease_by_task(j: Journal) -> DataFrame:
    return j.only("R42").leases.select("task_id", "worker_id", "fencing_token", at("expires_at"))


@query
def signals_of_run(j: Journal) -> DataFrame:
    return j.only("U7").signals.where("name = 'click'").orderBy("created_at", "signal_id").select("signal_id", at("created_at"))


@query
def runs_awaiting_advance(j: Journal) -> DataFrame:
    return relations.runs_awaiting_advance(j.runs, j.tasks, now())


@query
def expired_leases(j: Journal) -> DataFrame:
    return relations.expired_leases(j.leases, j.tasks, now(), 500).select("task_id", "worker_id", "fencing_token", at("expires_at"))


def stream_waits(j: Journal) -> DataFrame:
    return folds.pending_wait(j.stream, stream_until())


@query
def unconsumed_signal(j: Journal) -> DataFrame:
    waits = stream_waits(j).where("kind = 'SIGNAL'").select("run_id", F.lit("click").alias("name"))
    consumed = j.table("events").where("event_type = 'click' and event_id % 3 = 0").select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.concat(F.lit("G"), F.col("event_id") % 5000).alias("signal_id")).distinct()
    return relations.unconsumed_signal(waits, j.signals, consumed).select("run_id", "name", "signal_id", at("created_at"))


@query
def task_with_tool(j: Journal) -> DataFrame:
    return relations.with_tool(j.tasks, tools(j)).groupBy("task_type", "effect_class", "error").agg(F.count(F.lit(1)).alias("tasks"))


@query
def effect_with_tool(j: Journal) -> DataFrame:
    stale = relations.unresolved_effects(j.effects, now())
    return stale.join(tools(j).select(F.col("name").alias("effect_type"), "reconcilable"), "effect_type").groupBy("effect_type", "reconcilable", "status").agg(F.count(F.lit(1)).alias("effects"))


@query
def decider_for_run(j: Journal) -> DataFrame:
    sessions = j.spark.createDataFrame([("s1", "URGENT", "v0", True), ("s2", "URGENT", "v1", True), ("s3", "HIGH", "v2", True), ("s4", "LOW", "v0", False)], "session_id string, agent_name string, agent_version string, decides boolean")
    return relations.pick_decider(j.runs, sessions)


@query
def orphan_lines(j: Journal) -> DataFrame:
    """Tasks whose run is not among the runs placed before 1999."""
    early = j.runs.where(F.col("created_at") < now("1999-01-01 00:00:00"))
    return relations.orphans(j.tasks, early, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"))


@query
def replay_mismatch(j: Journal) -> DataFrame:
    recorded = j.lines.select("run_id", "step_id", F.concat(F.lit("tool"), F.col("l_partkey") % 4).alias("task_type"), F.col("l_suppkey").cast("string").alias("payload"))
    replayed = j.lines.select("run_id", "step_id", F.concat(F.lit("tool"), F.when(F.col("l_partkey") % 97 == 0, 3).otherwise(F.col("l_partkey") % 4)).alias("task_type"), F.when(F.col("l_suppkey") % 89 == 0, F.lit("?")).otherwise(F.col("l_suppkey").cast("string")).alias("payload"))
    return relations.replay_mismatches(recorded, replayed)


@query
def next_seq(j: Journal) -> DataFrame:
    return relations.next_seq(j.runs, j.log)


@query
def next_wake_up(j: Journal) -> DataFrame:
    return relations.next_wake_up(j.runs, now()).select(at("wake_at"))


@query
def scan_delay(j: Journal) -> DataFrame:
    return relations.scan_delay(relations.next_wake_up(j.runs, now()), now(), 2000)


@query
def next_token(j: Journal) -> DataFrame:
    return relations.next_token(j.leases)


@query
def delivery_attempts(j: Journal) -> DataFrame:
    failures = j.deliveries.where("outbox_id % 7 = 0 and published_at is null").select("outbox_id")
    return writes.delivery_failures(j.deliveries, failures.unionByName(failures)).groupBy("attempts").agg(F.count(F.lit(1)).alias("deliveries"))


@query
def agent_versions(j: Journal) -> DataFrame:
    return j.runs.groupBy("agent_name").agg(F.array_join(F.array_sort(F.collect_set("agent_version")), ",").alias("versions"))


@query
def tool_class_conflicts(j: Journal) -> DataFrame:
    declared = j.lines.select((F.col("l_suppkey") % 16).cast("string").alias("agent_name"), F.concat(F.lit("tool"), F.col("l_partkey") % 6).alias("name"), F.when(F.col("l_partkey") % 211 == 0, "NONE").otherwise("QUERYABLE").alias("effect_class"))
    return relations.class_conflicts(declared)


@query
def tool_names(j: Journal) -> DataFrame:
    return j.tasks.select("task_type").distinct().orderBy("task_type")


@query
def join_counts(j: Journal) -> DataFrame:
    return folds.fanout_children(renamed_children(j.log), "run_key").groupBy("policy").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum("settled").alias("settled"))


@query
def consumed_signals(j: Journal) -> DataFrame:
    rows = j.stream.withColumn("sid", F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("G"), F.col("event_id") % 500)))
    return folds.consumed_signals(rows, F.col("sid"))


@query
def pending_wait(j: Journal) -> DataFrame:
    return stream_waits(j).select("run_id", "step_id", "seq", "kind", at("until"))


@query
def wait_description(j: Journal) -> DataFrame:
    return lifecycle.wait_text(stream_waits(j), now(NOW_EVENTS))


def renamed_children(log: DataFrame) -> DataFrame:
    """The log with some settlements under names that look like a child's and are none."""
    odd = F.when(F.col("event_type").isin("TASK_COMPLETED", "TASK_FAILED") & (F.col("seq") % 7 == 0), F.regexp_replace("step_id", r"\.", ".0")).when(F.col("event_type").isin("TASK_COMPLETED", "TASK_FAILED") & (F.col("seq") % 7 == 1), F.regexp_replace("step_id", r"\.", ".-"))
    return log.withColumn("step_id", F.coalesce(odd, "step_id"))


def with_run(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run_id", F.concat(F.lit("R"), "run_key"))


@query
def pending_fanout(j: Journal) -> DataFrame:
    return with_run(folds.pending_fanout(renamed_children(j.log), "run_key")).select("run_id", "step", "policy", "n", "ok", "settled")


@query
def history_steps(j: Journal) -> DataFrame:
    """Steps of a log in which some completions come before their creation, some steps are created twice and some never."""
    task = F.col("event_type").isin("TASK_CREATED", "TASK_COMPLETED", "TASK_FAILED")
    early = task & (F.col("run_key") % 11 == 3)
    log = j.log.where(~(task & (F.col("run_key") % 13 == 5) & (F.col("event_type") == "TASK_CREATED")))
    log = log.withColumn("seq", F.when(early, 1000 - F.col("seq")).otherwise(F.col("seq")))
    return with_run(folds.history_steps(log, "run_key")).groupBy("run_id", "state", "error").agg(F.count(F.lit(1)).alias("steps"))


@query
def history_waits(j: Journal) -> DataFrame:
    return folds.history_waits(j.stream)


@query
def static_decider(j: Journal) -> DataFrame:
    return folds.static_decision(j.dialogue, F.col("result"), 2)


@query
def run_clock(j: Journal) -> DataFrame:
    return folds.clock(j.stream).select("run_id", at("started_at"))


@query
def seq_gaps(j: Journal) -> DataFrame:
    """Gaps left when every 13th event is lost."""
    return folds.seq_gaps(j.stream.where("event_id % 13 <> 0").select("run_id", "seq"))


@query
def pending_tasks_topk(j: Journal) -> DataFrame:
    return relations.pending_tasks(j.tasks, now(), 100).select("task_id", "priority", at("created_at"))


@query
def task_assignment(j: Journal) -> DataFrame:
    workers = j.leases.select("worker_id").distinct()
    return relations.assign_tasks(j.tasks, workers, now(), now() + minutes(F.lit(1))).select("task_id", "worker_id", at("visible_at"))


@query
def pending_deliveries(j: Journal) -> DataFrame:
    return relations.pending_deliveries(j.deliveries, now(), 100).select("outbox_id", "task_id")


@query
def unresolved_effects(j: Journal) -> DataFrame:
    return relations.unresolved_effects(j.effects, now(), 50).select("effect_key", "status", at("updated_at"))


@query
def round_robin(j: Journal) -> DataFrame:
    return relations.round_robin(j.tasks.select("task_id", "task_type", "run_id"), [F.col("task_id")], "run_id", 3).groupBy("worker", "task_type").agg(F.count(F.lit(1)).alias("calls"))


@query
def migrations_pending(j: Journal) -> DataFrame:
    """Versions not applied yet, the applied ones being those with an order in 1997."""
    versions = j.runs.select("agent_version").distinct()
    applied = j.runs.where((F.year("created_at") == 1997) & F.col("agent_version").isin("v1", "v3")).select("agent_version")
    return relations.difference(versions, applied, ["agent_version"])


@query
def mark_delivered(j: Journal) -> DataFrame:
    sent = j.deliveries.where("outbox_id % 5 = 0").select("outbox_id")
    marked = relations.mark_delivered(j.deliveries, sent, now())
    return marked.groupBy(F.col("published_at").isNull().alias("waiting")).agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(F.col("published_at") == now()).alias("marked"))


@query
def tool_union(j: Journal) -> DataFrame:
    extra = j.spark.createDataFrame([("tool2", "NONE"), ("tool9", "NONE")], "name string, effect_class string")
    return relations.union_first(tools(j).select("name", "effect_class"), extra, "name")


@query
def step_parent_index(j: Journal) -> DataFrame:
    steps = j.lines.select("run_id", F.when(F.col("l_linenumber") == 1, F.concat("step_id", F.lit(".7"))).when(F.col("l_linenumber") == 2, "S12").when(F.col("l_linenumber") == 3, "S1.x").otherwise(F.col("step_id")).alias("step_id"))
    return steps.groupBy(S.parent(F.col("step_id")).alias("parent"), S.child_index(F.col("step_id")).alias("child_index")).agg(F.count(F.lit(1)).alias("steps"))


@query
def children_names(j: Journal) -> DataFrame:
    n = j.table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    names = F.array_join(S.children(F.lit("S1"), F.col("n")), ",")
    return n.groupBy(names.alias("children")).agg(F.count(F.lit(1)).alias("runs"))


@query
def idempotency_key(j: Journal) -> DataFrame:
    return j.lines.select("task_id", S.idempotency_key(F.col("run_id"), F.col("step_id"), F.lit(1)).alias("idempotency_key"))


@query
def join_policy_valid(j: Journal) -> DataFrame:
    rows = with_run(folds.fanout_children(j.log, "run_key"))
    text = F.when(F.col("n") == 5, "MAJORITY").otherwise(F.col("policy"))
    return rows.select("run_id", text.alias("policy"), S.policy_kind(text).alias("kind"), S.policy_quorum(text).alias("quorum"), S.policy_error(text, F.col("n")).alias("error"), S.policy_text(S.policy_kind(text), S.policy_quorum(text)).alias("canonical"))


@query
def failure_class(j: Journal) -> DataFrame:
    ok, certainty = F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "NOT_EXECUTED").when(F.col("l_partkey") % 2 == 0, "MAYBE")
    return j.table("lineitem").groupBy(S.classify_failure(ok, certainty).alias("effect_status")).agg(F.count(F.lit(1)).alias("calls"))


@query
def recovery_action(j: Journal) -> DataFrame:
    held = j.effects.where(F.col("task_id").substr(-1, 1) != "9")
    return lifecycle.recovery_plan(j.tasks, held)


@query
def backoff_schedule(j: Journal) -> DataFrame:
    delay = S.backoff_seconds(F.col("attempt"), 2.0, 3.0, 15.0)
    return j.tasks.groupBy("attempt", delay.alias("delay_seconds")).agg(F.count(F.lit(1)).alias("tasks"))


def transitions(j: Journal, statuses: tuple[str, ...], moves: dict[str, tuple[str, ...]]) -> DataFrame:
    names = j.spark.createDataFrame([(a, b) for a in statuses for b in statuses], "`from` string, `to` string")
    return names.select("from", "to", S.moves(F.col("from"), F.col("to"), moves).alias("legal"))


@query
def run_transition_legal(j: Journal) -> DataFrame:
    return transitions(j, S.RUN_STATUS, S.RUN_MOVES)


@query
def task_transition_legal(j: Journal) -> DataFrame:
    return transitions(j, S.TASK_STATUS, S.TASK_MOVES)


@query
def effect_transition_legal(j: Journal) -> DataFrame:
    return transitions(j, S.EFFECT_STATUS, S.EFFECT_MOVES)


@query
def status_predicates(j: Journal) -> DataFrame:
    e = j.effects.select("status", "effect_class").distinct()
    return e.select("status", "effect_class", S.effect_resolved(F.col("status")).alias("resolved"), S.has_consequence(F.col("effect_class")).alias("consequence"), S.can_auto_resolve(F.col("effect_class")).alias("auto_resolves"))


@query
def run_predicates(j: Journal) -> DataFrame:
    r = j.runs
    return r.groupBy(S.run_terminal(F.col("status")).alias("terminal"), S.waiting(F.col("available_at"), now()).alias("waiting")).agg(F.count(F.lit(1)).alias("runs"))


@query
def task_predicates(j: Journal) -> DataFrame:
    t = j.tasks
    return t.groupBy(S.task_terminal(F.col("status")).alias("terminal"), S.exhausted(F.col("attempt"), F.col("max_attempts")).alias("exhausted"), F.col("status").isin(*S.TASK_STATUS).alias("valid")).agg(F.count(F.lit(1)).alias("tasks"))


@query
def key_expired(j: Journal) -> DataFrame:
    ttl = F.col("l_quantity").cast("long") * 86400 * 20 - 86400
    e = j.lines.select(F.col("task_id"), S.key_expired(F.col("l_shipdate"), now(), ttl).alias("expired"))
    return e.groupBy("expired").agg(F.count(F.lit(1)).alias("effects"), F.min("task_id").alias("least"), F.max("task_id").alias("most"))


@query
def external_reference(j: Journal) -> DataFrame:
    body = F.when(F.col("event_type") == "click", F.concat(F.lit('{"reference": "", "external_ref": "X'), "event_id", F.lit('"}'))).when(F.col("event_type") == "view", F.concat(F.lit('{"id": '), "event_id", F.lit("}"))).when(F.col("event_type") == "error", F.lit("not json")).otherwise(F.concat(F.lit('{"reference_id": "Q'), F.col("event_id") % 10, F.lit('", "k": 1}')))
    return j.table("events").select("event_id", E.external_reference(body).alias("reference"))


@query
def envelope_decode(j: Journal) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"v":2,"data":'), "props", F.lit("}"))).when(F.col("event_id") % 7 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"v":1,"data":'), "props", F.lit("}")))
    d = E.decode(wrapped, "k long")
    return j.table("events").select("event_id", d["data"]["k"].alias("k"), d["error"].alias("error"))


@query
def delivery_decode(j: Journal) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit('{"v":1,"task_id":""}')).when(F.col("event_id") % 7 == 0, F.lit('{"v":9,"task_id":"T"}')).otherwise(E.encode_delivery(F.concat(F.lit("T"), "event_id")))
    d = E.decode_delivery(raw)
    return j.table("events").select("event_id", d["task_id"].alias("task_id"), d["error"].alias("error"))


@query
def signal_request(j: Journal) -> DataFrame:
    """HTTP status of signal deliveries: runs are customers, terminal where divisible by 9."""
    request = j.table("events").select("event_id", F.concat(F.lit("U"), "user_id").alias("run_id"), F.when(F.col("event_id") % 17 == 0, "{").otherwise(F.col("props")).alias("body"), (F.col("event_id") % 1000 * 1500).alias("size"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("K"), F.col("event_id") % 50)).alias("idempotency_key"))
    runs = j.table("events").where("user_id % 10 <> 4").select("user_id").distinct().select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.when(F.col("user_id") % 9 == 0, "COMPLETED").otherwise("RUNNING").alias("status"))
    return E.signal_status(request, runs, 1 << 20).groupBy("code").agg(F.count(F.lit(1)).alias("requests"))


@query
def duration_text(j: Journal) -> DataFrame:
    seconds = F.col("event_id") * F.col("event_id") % 400000
    return j.table("events").select("event_id", S.duration_text(seconds).alias("text"))


@query
def signal_dedup(j: Journal) -> DataFrame:
    runs = j.table("events").select("user_id").distinct().where("user_id % 7 <> 3").select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.when(F.col("user_id") % 5 == 0, "CANCELLED").otherwise("RUNNING").alias("status"))
    return writes.deliver_signals(runs, j.signals, [F.col("created_at"), F.col("event_id")]).select("event_id", "outcome")


@query
def task_claim_dedup(j: Journal) -> DataFrame:
    """Each task claimed, ended or put back, claimed again and ended again."""
    end = F.when(F.col("priority") % 3 == 0, "COMPLETED").when(F.col("priority") % 3 == 1, "PENDING").otherwise("DEAD_LETTER")
    moves = F.array(F.struct(F.lit("PENDING").alias("from"), F.lit("RUNNING").alias("to")), F.struct(F.lit("RUNNING").alias("from"), end.alias("to")), F.struct(F.lit("PENDING").alias("from"), F.lit("RUNNING").alias("to")), F.struct(F.lit("RUNNING").alias("from"), F.lit("RUNNING").alias("to")))
    commands = j.tasks_by_run.select("l_orderkey", "task_id", F.posexplode(moves).alias("delivery", "m")).select("l_orderkey", "task_id", "delivery", "m.from", "m.to")
    return writes.task_transition(j.tasks_by_run, commands, [F.col("delivery")], near(j)).groupBy("delivery", "to", "outcome", "attempt").agg(F.count(F.lit(1)).alias("claims"))


@query
def run_version_cas(j: Journal) -> DataFrame:
    """Each line of an order moves its run on from the version that it expects: in turn, late by one, or of a run that is not there."""
    number = F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 0, 10**9).otherwise(0)
    commands = j.lines.select(number.alias("run_key"), F.concat(F.lit("R"), number).alias("run_id"), "task_id", "child", (F.col("l_orderkey") % 5 + F.col("child") - F.col("l_suppkey") % 2).alias("expected"), F.when(F.col("l_partkey") % 5 == 0, "COMPLETED").otherwise("RUNNING").alias("next"))
    runs = j.runs.withColumn("run_key", F.substring("run_id", 2, 20).cast("long"))
    return writes.run_cas(runs, commands, [F.col("child"), F.col("task_id")], ("run_key", j.parts)).groupBy("outcome", "next", "new_version").agg(F.count(F.lit(1)).alias("commands"))


@query
def fenced_writes(j: Journal) -> DataFrame:
    commands = j.lines.select("task_id", (F.col("l_suppkey") % 8 + 1).alias("token"))
    return writes.fenced(j.leases, commands).groupBy("outcome").agg(F.count(F.lit(1)).alias("writes"))


@query
def lease_acquire(j: Journal) -> DataFrame:
    commands = j.lines.select("l_orderkey", "task_id", F.explode(F.array(F.lit("W1"), F.lit("W2"))).alias("worker_id"))
    return writes.acquire_lease(j.leases_by_run, commands, now(), [F.col("worker_id")], near(j)).groupBy("outcome", "token", "worker_id").agg(F.count(F.lit(1)).alias("leases"))


@query
def effect_reserve(j: Journal) -> DataFrame:
    commands = j.lines.select(F.concat("run_id", F.lit(":S1."), F.col("child") % 3, F.lit(":E1")).alias("effect_key"), "task_id")
    return writes.first_per_key(commands, ["effect_key"], [F.col("task_id")]).groupBy("outcome").agg(F.count(F.lit(1)).alias("effects"))


@query
def event_append(j: Journal) -> DataFrame:
    commands = j.stream.select("run_id", (F.col("seq") - F.col("seq") % 2).alias("seq"), "event_id")
    existing = j.stream.where("seq <= 4").select("run_id", "seq")
    return writes.insert_new(existing, commands, ["run_id", "seq"], [F.col("event_id")]).groupBy("outcome").agg(F.count(F.lit(1)).alias("appends"))


@query
def worker_upsert(j: Journal) -> DataFrame:
    return writes.last_per_key(j.leases, "worker_id", F.struct("expires_at", "task_id"), ["task_id", "expires_at"]).select("worker_id", "task_id", at("expires_at"))


@query
def effect_resolve(j: Journal) -> DataFrame:
    """Two contrary verdicts on each effect."""
    verdict = lambda n: F.when((F.col("l_partkey") + n) % 2 == 0, "COMMITTED").otherwise("FAILED")
    both = F.array(*[F.struct(F.lit(n).alias("n"), verdict(n).alias("verdict"), F.when((F.col("l_partkey") + n) % 3 == 0, "ref").alias("ref")) for n in (0, 1)])
    commands = j.lines.select("l_orderkey", F.concat("run_id", F.lit(":"), "step_id", F.lit(":E1")).alias("effect_key"), F.explode(both).alias("c")).select("l_orderkey", "effect_key", "c.*")
    return writes.resolve_effects(j.effects_by_run, commands, [F.col("n")], near(j)).groupBy("n", "outcome", "new_status").agg(F.count(F.lit(1)).alias("effects"))


def decisions(j: Journal) -> DataFrame:
    kinds = ("CALL_TOOL", "CALL_TOOL_PARALLEL", "SLEEP", "WAIT_FOR_SIGNAL", "COMPLETE", "FAIL", "CANCEL", "ERROR")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("user_id") % 8 + 1).cast("int"))
    return j.table("events").select("user_id").distinct().where("user_id % 11 <> 0").select(F.concat(F.lit("U"), "user_id").alias("run_id"), kind.alias("kind"), (F.col("user_id") % 4).alias("n_calls"), F.when(F.col("user_id") % 3 == 0, "QUORUM(2)").otherwise("ALL").alias("policy"))


@query
def advance_plan(j: Journal) -> DataFrame:
    runs = j.table("events").select("user_id").distinct().select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.when(F.col("user_id") % 13 == 0, "FAILED").otherwise("RUNNING").alias("status"), F.when(F.col("user_id") % 2 == 0, now(NOW_EVENTS)).alias("available_at"))
    waits = stream_waits(j).where("step_id <> 'S2'").withColumn("name", F.lit("click"))
    waits = waits.withColumn("until", F.when((F.col("kind") == "SIGNAL") & (F.col("seq") % 2 == 0), now("2024-01-02 00:00:00")).otherwise(F.col("until")))
    signals = j.signals.where("name = 'click' and event_id % 40 = 0").groupBy("run_id", "name").agg(F.min("signal_id").alias("signal_id"))
    fanouts = runs.where("run_id like '%7'").select("run_id")
    return lifecycle.advance_plan(runs, waits, fanouts, signals, decisions(j), now("2024-01-30 12:00:00"))


@query
def dispatch_rows(j: Journal) -> DataFrame:
    return lifecycle.dispatch_rows(decisions(j).withColumn("step_id", F.lit("S3")))


@query
def task_failure_plan(j: Journal) -> DataFrame:
    failures = j.lines.select("task_id", F.when(F.col("l_linenumber") == 1, "S4").otherwise(F.col("step_id")).alias("step_id"), (F.col("l_partkey") % 3 + 1).alias("attempt"), F.lit(3).alias("max_attempts"), (F.col("l_suppkey") % 6 != 0).alias("token_current"), (F.col("l_partkey") % 7 == 0).alias("escalated"))
    return lifecycle.failure_plan(failures).groupBy("task", "events", "run").agg(F.count(F.lit(1)).alias("tasks"))


@query
def reaper_plan(j: Journal) -> DataFrame:
    return lifecycle.reaper_plan(relations.expired_leases(j.leases, j.tasks, now()))


@query
def reconcile_live(j: Journal) -> DataFrame:
    effects = j.effects.withColumn("reconcilable", F.col("effect_type") != "tool3").withColumn("key_ttl_seconds", F.lit(86400 * 700).cast("long"))
    return lifecycle.reconcile_live(effects, now()).groupBy("action").agg(F.count(F.lit(1)).alias("effects"))


@query
def reconcile_background(j: Journal) -> DataFrame:
    return lifecycle.reconcile_background(relations.unresolved_effects(j.effects, now()), tools(j), now()).groupBy("before", "after").agg(F.count(F.lit(1)).alias("effects"))


@query
def duplicate_commits(j: Journal) -> DataFrame:
    commits = j.lines.where("l_suppkey % 5 = 2").select(F.concat("run_id", F.lit(":S1."), F.col("child") % 4, F.lit(":E1")).alias("effect_key"))
    return audit.duplicate_commits(commits)


@query
def live_leases(j: Journal) -> DataFrame:
    doubled = j.leases.unionByName(j.leases.where("fencing_token > 5"))
    return audit.live_leases(doubled, now())


@query
def stuck_runs(j: Journal) -> DataFrame:
    return audit.stuck_runs(j.runs, j.tasks)


@query
def claimed_before_not_before(j: Journal) -> DataFrame:
    return audit.claimed_early(j.tasks, j.deliveries).select("task_id", at("available_at"), at("not_before"))


@query
def unresolved_unknown(j: Journal) -> DataFrame:
    return audit.unresolved_unknown(j.effects)


@query
def dispatch_latency(j: Journal) -> DataFrame:
    return audit.latency(j.log, "TASK_CREATED", "TASK_CLAIMED", "run_key").groupBy("seconds").agg(F.count(F.lit(1)).alias("steps"))


@query
def run_latency(j: Journal) -> DataFrame:
    """Minutes from a run's start to its end."""
    return run_seconds(j).groupBy(F.floor(F.col("seconds") / 60).alias("minutes")).agg(F.count(F.lit(1)).alias("runs"))


def run_seconds(j: Journal) -> DataFrame:
    ends = j.log.where(F.col("event_type").isin("RUN_STARTED", "RUN_COMPLETED")).withColumn("step_id", F.lit("run"))
    return audit.latency(ends, "RUN_STARTED", "RUN_COMPLETED", "run_key")


@query
def latency_percentiles(j: Journal) -> DataFrame:
    """p50, p95 and p99 of a run's seconds; exact while a bucket of the sketch holds one value."""
    return audit.percentiles(run_seconds(j), "seconds", accuracy=1_000_000)


@query
def first_end_after_start(j: Journal) -> DataFrame:
    """Seconds from a user's first signup to the first purchase after it, whatever was bought before."""
    rows = j.table("events").select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.lit("S").alias("step_id"), "event_type", F.col("ts").alias("created_at"))
    return audit.latency(rows, "signup", "purchase").select("run_id", "seconds")


@query
def decision_validity(j: Journal) -> DataFrame:
    e = j.table("events")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("CALL_TOOL", "CALL_TOOL_PARALLEL", "SLEEP", "WAIT_FOR_SIGNAL", "COMPLETE", "COMPENSATE")]), (F.col("event_id") % 6 + 1).cast("int"))
    tool, wake = F.when(F.col("event_id") % 4 == 0, "").otherwise("lookup"), F.when(F.col("event_id") % 5 != 2, F.col("ts"))
    signal, n = F.when(F.col("event_id") % 7 != 3, "go"), F.col("event_id") % 4
    error = S.decision_error(kind, tool, wake, signal, n, F.when(F.col("event_id") % 9 == 1, "SOME").otherwise("QUORUM(2)"))
    return e.select("event_id", kind.alias("kind"), error.alias("error"))


@query
def descriptor_validity(j: Journal) -> DataFrame:
    p = j.table("part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "QUERYABLE").when(F.col("p_partkey") % 3 == 1, "NONE").alias("effect_class"), (F.col("p_size") % 2 == 0).alias("reconcilable"))
    return p.select("p_partkey", S.descriptor_error(F.col("name"), F.col("effect_class"), F.col("reconcilable")).alias("error"))


@query
def provider_resolution(j: Journal) -> DataFrame:
    raw = F.when(F.col("l_partkey") % 5 == 0, "GARBLED").otherwise(F.col("answer"))
    e = j.effects.join(j.lines.select("task_id", "l_partkey", "l_suppkey"), "task_id")
    hook = S.hook_resolution(F.col("l_suppkey") % 3 != 0, F.when(F.col("l_suppkey") % 2 == 0, "ref"))
    return e.groupBy(S.resolution(raw).alias("resolution"), hook.alias("hook")).agg(F.count(F.lit(1)).alias("effects"))


@query
def suspension_predicates(j: Journal) -> DataFrame:
    d = decisions(j)
    until = F.when(F.col("kind") == "WAIT_FOR_SIGNAL", now(S.INDEFINITE)).otherwise(now())
    return d.select("run_id", S.is_suspension(F.col("kind")).alias("suspends"), S.is_indefinite(until).alias("indefinite"))


@query
def run_release(j: Journal) -> DataFrame:
    arrivals = j.lines.where("l_partkey % 10 = 0").select("run_id")
    return writes.release_runs(j.runs, arrivals).where("status = 'RUNNING'").groupBy(F.col("available_at").isNull().alias("ready"), "version").agg(F.count(F.lit(1)).alias("runs"))


@query
def run_finish(j: Journal) -> DataFrame:
    return lifecycle.finish_plan(decisions(j))


@query
def task_complete(j: Journal) -> DataFrame:
    """Two results of each task, the first under a token that may be stale."""
    token = F.array(F.col("l_linenumber") + F.when(F.col("l_partkey") % 3 == 0, 2).otherwise(1), F.col("l_linenumber") + 1)
    reports = j.lines.select("l_orderkey", "task_id", F.posexplode(token).alias("n", "token")).withColumn("token", F.col("token").cast("long"))
    return writes.complete_tasks(j.tasks_by_run, j.leases_by_run, reports, [F.col("n")], near(j)).groupBy("n", "outcome").agg(F.count(F.lit(1)).alias("reports"))


def effect_commands(j: Journal) -> DataFrame:
    """Four transitions of each effect with a consequence."""
    ends = F.when(F.col("answer") == "COMMITTED", "COMMITTED").when(F.col("answer") == "NOT_EXECUTED", "FAILED").otherwise("UNKNOWN")
    moves = [(F.lit("PENDING"), F.lit("RUNNING")), (F.lit("RUNNING"), ends), (F.lit("UNKNOWN"), F.lit("COMMITTED")), (F.lit("COMMITTED"), F.lit("RUNNING"))]
    each = F.array(*[F.struct(F.lit(n).alias("n"), a.alias("from"), b.alias("to"), F.when(F.lit(n == 1), F.lit("seen")).alias("answer")) for n, (a, b) in enumerate(moves)])
    return j.effects_by_run.where("effect_class <> 'NONE'").select("l_orderkey", "effect_key", F.explode(each).alias("c")).select("l_orderkey", "effect_key", "c.*")


@query
def effect_update(j: Journal) -> DataFrame:
    return writes.update_effects(j.effects_by_run, effect_commands(j), [F.col("n")], ["answer"], near(j)).groupBy("status", "answer").agg(F.count(F.lit(1)).alias("effects"))


@query
def effect_ledger(j: Journal) -> DataFrame:
    """The outcome of each transition, as the ledger would have answered."""
    return writes.effect_transition(j.effects_by_run, effect_commands(j), [F.col("n")], near(j)).groupBy("n", "from", "to", "outcome").agg(F.count(F.lit(1)).alias("commands"))


@query
def effect_status_from_log(j: Journal) -> DataFrame:
    last = F.when(F.col("status").isin("COMMITTED", "FAILED", "UNKNOWN"), F.col("status"))
    return j.effects.groupBy(S.effect_status_from_log(F.lit(True), last).alias("status")).agg(F.count(F.lit(1)).alias("effects"))


@query
def heartbeat_sessions(j: Journal) -> DataFrame:
    """Spans in which a user's events follow one another within six hours."""
    beats = j.table("events").select(F.concat(F.lit("W"), "user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.heartbeat_sessions(beats, "6 hours").select("worker_id", at("first"), at("free_at"), "beats")


@query
def retention(j: Journal) -> DataFrame:
    """Deliveries younger than the stream keeps them."""
    kept = j.table("events").where(F.col("ts") > now(NOW_EVENTS) - F.make_dt_interval(F.lit(1))).where(F.col("ts") <= now(NOW_EVENTS))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query
def canonical_json(j: Journal) -> DataFrame:
    ship(j.spark)
    rows = j.table("events").select("event_id", F.concat(F.lit('{"z": 1.0, "a": '), "props", F.lit("}")).alias("j"))
    return rows.select("event_id", replay_.canonical_json("j").alias("canonical"))


@query
def sequential_ids(j: Journal) -> DataFrame:
    """Ids of new events in each run's order."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    return j.stream.where("event_type = 'TIMER_SET'").select("run_id", "seq", F.concat("run_id", F.lit("-"), n).alias("new_id"))


@query
def null_normalised(j: Journal) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("props"))
    return j.table("events").select("event_id", E.or_null(raw).alias("payload"), E.or_empty_object(raw).alias("body"))


def scratch(j: Journal, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine only, below a temporary one."""
    at_ = j.spark.conf.get("spark.checkpoint.dir", None)
    if not at_:
        if not j.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at_ = tempfile.mkdtemp(prefix="runfold-")
    return f"{at_.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def stream_open_waits(j: Journal) -> DataFrame:
    """The open waits that the streaming fold ends with; the same rows as the batch fold."""
    ship(j.spark)
    raw = streams.stream_parquet(j.spark, j.sf_dir, "events.parquet")
    kind = by_name(F.col("event_type"), STREAM_TYPES, "OTHER")
    # events come in order of time in the files, and their id is the order inside a run
    log = raw.select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("event_type"), F.concat(F.lit("S"), F.col("event_id") % 3).alias("step_id"), "ts", "value")
    until = F.when(F.col("event_type") == "TIMER_SET", F.unix_millis((F.col("ts") + minutes(F.col("value"))).cast("timestamp")))
    out = scratch(j, "waits")
    streams.relay(streams.durable_waits(log, until, timers=False), out, scratch(j, "progress")).awaitTermination()
    rows = j.spark.read.schema(streams.WAIT_OUT).parquet(out)
    last = folds.last_by(rows, ["run_id"], F.col("seq"), {"action": F.col("action"), "step_id": F.col("step_id"), "kind": F.col("kind")})
    return last.where("action = 'OPEN'").select("run_id", "step_id", "kind")


@query
def stream_signal_dedup(j: Journal) -> DataFrame:
    """How many distinct signals each run has stored, by the streaming sink."""
    raw = streams.stream_parquet(j.spark, j.sf_dir, "events.parquet")
    signals = raw.select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.concat(F.lit("G"), F.col("event_id") % 5000).alias("signal_id"))
    out = scratch(j, "signals")
    streams.relay(streams.distinct_signals(signals), out, scratch(j, "progress")).awaitTermination()
    return j.spark.read.schema("run_id string, signal_id string").parquet(out).groupBy("run_id").agg(F.count(F.lit(1)).alias("signals"))


def two_answers(ctx: replay_.Context) -> str:
    """The body replayed over conversations: two calls, then done."""
    first = ctx.call("answer", n=1)
    return f"{first}/{ctx.call('answer', n=2)}"


@query
def replay_decision(j: Journal) -> DataFrame:
    """Next decision of a body over each conversation: its assistant turns are the answers of calls, in order."""
    ship(j.spark)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = j.table("conversations").where("role = 'assistant'").select("conv_id", "turn", nth.alias("n"), F.length("text").alias("size"))
    head = j.table("conversations").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit("RUN_STARTED").alias("event_type"), F.lit(None).cast("string").alias("step_id"), F.lit(None).cast("string").alias("body"))
    made = turns.select("conv_id", (F.col("turn") * 2).alias("seq"), F.lit("TASK_CREATED").alias("event_type"), F.concat(F.lit("S"), "n").alias("step_id"), F.format_string('{"task_type": "answer", "payload": {"n": %d}}', "n").alias("body"))
    done = turns.select("conv_id", (F.col("turn") * 2 + 1).alias("seq"), F.lit("TASK_COMPLETED").alias("event_type"), F.concat(F.lit("S"), "n").alias("step_id"), F.format_string('{"result": %d}', "size").alias("body"))
    log = head.unionByName(made).unionByName(done).withColumn("run_id", F.concat(F.lit("C"), "conv_id")).withColumn("created_at", now(NOW_EVENTS))
    return replay_.replay(log, two_answers).select("run_id", "kind", "step_id", "error")


def fan_out(ctx: replay_.Context, n: int, join: str) -> str:
    """The body replayed over orders: one call a line, then how many went well."""
    outcomes = ctx.call_parallel([("line", {"i": i}) for i in range(n)], join)
    return f"{sum(o.ok for o in outcomes)}/{sum(o.settled for o in outcomes)}"


@query
def replay_parallel(j: Journal) -> DataFrame:
    """Fan-outs as journals have them: the calls are names, and what a child was asked is in its own creation."""
    log = j.log.withColumn("n", F.max("n_calls").over(Window.partitionBy("run_key"))).withColumn("join", F.max("policy").over(Window.partitionBy("run_key")))
    kind, child = F.col("event_type"), S.child_index(F.col("step_id"))
    body = (
        F.when(kind == "RUN_STARTED", F.to_json(F.struct(F.struct("n", "join").alias("input"))))
        .when(kind == "FAN_OUT_STARTED", F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda i: F.lit("line")).alias("calls"), F.col("policy").alias("join"))))
        .when(kind == "TASK_CREATED", F.to_json(F.struct(F.lit("line").alias("task_type"), F.struct(child.alias("i")).alias("payload"))))
        .when(kind == "TASK_COMPLETED", F.lit('{"result": 1}'))
        .when(kind == "TASK_FAILED", F.to_json(F.struct("final", F.lit("x").alias("error"))))
    )
    return replay_.replay(log.withColumn("body", body), fan_out, "run_key").select("run_id", "kind", "step_id", F.when(F.col("kind") == "COMPLETE", F.translate("detail", '"', "")).alias("output"), "reissued")


def sleep_and_wait(ctx: replay_.Context) -> str:
    """The body replayed over users' events: a sleep of an hour from the start, then a signal within two."""
    ctx.sleep(3600)
    ctx.wait_for("click", 7200)
    return "done"


@query
def replay_waits(j: Journal) -> DataFrame:
    log = j.stream.withColumn("body", F.lit('{"name": "click", "wake_at": "2024-01-01T00:00:00"}'))
    found = replay_.replay(log, sleep_and_wait)
    return found.select("run_id", "kind", "step_id", "reissued", F.coalesce(F.get_json_object("detail", "$.wake_at"), F.get_json_object("detail", "$.deadline")).alias("until"), F.split("error", ":")[0].alias("error"))


def draws(ctx: replay_.Context) -> list[float]:
    return [ctx.random().random() for _ in range(3)]


@query
def replay_random(j: Journal) -> DataFrame:
    """Three random numbers of each conversation, the same at every replay."""
    log = j.dialogue.select("run_id").distinct().select("run_id", F.lit(1).cast("long").alias("seq"), F.lit("RUN_STARTED").alias("event_type"), F.lit(None).cast("string").alias("step_id"), F.lit(None).cast("string").alias("body"), now(NOW_EVENTS).alias("created_at"))
    return replay_.replay(log, draws).select("run_id", F.col("detail").alias("draws"))


@query
def step_description(j: Journal) -> DataFrame:
    """Calls in one line, some with a payload that is no object."""
    ship(j.spark)
    rows = j.table("events").select("event_id", F.concat(F.lit("tool"), F.col("event_id") % 3).alias("tool"), F.when(F.col("event_id") % 5 == 0, "[1]").when(F.col("event_id") % 5 == 1, "{").otherwise(F.col("props")).alias("payload"))
    return rows.select("event_id", replay_.describe("tool", "payload").alias("text"))


@query
def embedded_object(j: Journal) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, "[1, 2]").when(F.col("event_id") % 4 == 2, "nonsense")
    return j.table("events").select("event_id", E.as_object(raw).alias("body"))


@query
def envelope_encode(j: Journal) -> DataFrame:
    return j.table("events").select("event_id", E.wrap(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("payload"))


@query
def effect_event(j: Journal) -> DataFrame:
    """The event bodies of effects."""
    return j.effects.select("effect_key", E.effect_body(F.col("task_id"), F.col("effect_key"), F.col("effect_type"), F.col("effect_class"), F.col("status"), reference=F.when(F.col("status") == "COMMITTED", F.col("answer")), detail=F.when(F.col("status") == "UNKNOWN", "timed out")).alias("body"))


@query
def effect_class_wire(j: Journal) -> DataFrame:
    """Effect classes to their numbers and back; an unspecified one is refused."""
    sent = F.when(F.col("p_partkey") % 7 == 0, 0).when(F.col("p_partkey") % 7 == 6, 9).otherwise(S.class_number(choose(F.col("p_partkey"), S.EFFECT_CLASS)))
    p = j.table("part").select("p_partkey", sent.cast("int").alias("sent"))
    return p.select("p_partkey", "sent", S.class_of_number(F.col("sent")).alias("effect_class"), F.when(S.class_of_number(F.col("sent")).isNull(), "unknown class").alias("error"))


@query
def instants(j: Journal) -> DataFrame:
    """Instants as nanoseconds and back."""
    nanos = S.unix_nanos(F.col("ts"))
    return j.table("events").select("event_id", nanos.alias("nanos"), (S.from_nanos(nanos) == F.col("ts").cast("timestamp")).alias("same"))


@query
def enum_validity(j: Journal) -> DataFrame:
    """Which of the statuses and classes that occur are of each kind."""
    names = j.runs.select("status").union(j.tasks.select("status")).union(j.effects.select("status")).union(j.effects.select("effect_class")).distinct()
    return names.select("status", F.col("status").isin(*S.RUN_STATUS).alias("run"), F.col("status").isin(*S.TASK_STATUS).alias("task"), F.col("status").isin(*S.EFFECT_STATUS).alias("effect"), F.col("status").isin(*S.EFFECT_CLASS).alias("effect_class"))


@query
def agent_runs(j: Journal) -> DataFrame:
    """Running runs of one agent: others are not this engine's to advance."""
    return relations.runs_of_agent(j.runs, "URGENT").groupBy("agent_version").agg(F.count(F.lit(1)).alias("runs"))


@query
def start_runs(j: Journal) -> DataFrame:
    """The run row and the first event of a run for each customer."""
    asked = j.table("customer").select(F.concat(F.lit("N"), "c_custkey").alias("run_id"), F.to_json(F.struct(F.col("c_custkey").alias("customer"))).alias("input"))
    return lifecycle.start_rows(asked, "agent", "v1")


@query
def execute_plan(j: Journal) -> DataFrame:
    """What becomes of each pending task through the ledger; half of them have no effect yet."""
    held = j.effects.where(F.col("task_id").substr(-1, 1) < "2")
    found = lifecycle.execute_plan(j.tasks, held, tools(j))
    return found.groupBy("action", "events").agg(F.count(F.lit(1)).alias("tasks"))


@query
def perform_rows(j: Journal) -> DataFrame:
    """The transitions and events that a call leaves in the ledger."""
    calls = j.effects.where("status in ('PENDING', 'FAILED')").select("effect_key", "status", (F.col("answer") == "COMMITTED").alias("ok"), F.when(F.col("answer") == "NOT_EXECUTED", F.col("answer")).alias("certainty"))
    return lifecycle.perform_rows(calls).groupBy("n", "from", "to", "event").agg(F.count(F.lit(1)).alias("rows"))


@query
def recovery_scan(j: Journal) -> DataFrame:
    """One scan: pending tasks to publish again, ready runs to advance."""
    return lifecycle.recovery_scan(j.runs, j.tasks, now()).groupBy("what").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.max("id").alias("most"))


@query
def advance_after_park(j: Journal) -> DataFrame:
    """Runs that start to wait for a signal which is there already: they advance at once."""
    waits = stream_waits(j).where("kind = 'SIGNAL'").select("run_id", "step_id", F.lit("click").alias("name"))
    return lifecycle.after_park(waits, j.signals.where("event_id % 3 <> 0"))


@query
def relay_outcome(j: Journal) -> DataFrame:
    """A sweep of the outbox in which some deliveries fail and one ends it."""
    due = j.deliveries.where("published_at is null")
    sent = due.select("outbox_id", F.when(F.col("outbox_id") % 5 == 0, "refused").alias("error"))
    return relations.record_sweep(j.deliveries, sent, now()).groupBy(F.col("published_at").isNull().alias("waiting"), "attempts", "last_error").agg(F.count(F.lit(1)).alias("deliveries"))


@query
def lease_extend(j: Journal) -> DataFrame:
    """Leases after heartbeats, some of them stale, and releases."""
    beats = j.lines.select("task_id", "child", (F.col("l_linenumber") + F.when(F.col("l_partkey") % 4 == 0, 0).otherwise(1)).cast("long").alias("token"), F.when(F.col("l_partkey") % 5 == 0, now()).otherwise(now() + minutes(F.col("l_quantity"))).alias("until"))
    return writes.extend_leases(j.leases, beats, [F.col("child")]).select("task_id", "fencing_token", at("expires_at"))


@query
def retaken_tasks(j: Journal) -> DataFrame:
    """Tasks taken and not started: they are due again once their visibility ends."""
    taken = relations.assign_tasks(j.tasks, j.leases.select("worker_id").distinct(), now(), now() + minutes(F.lit(1)))
    return relations.retake(j.tasks, taken, now() + minutes(F.lit(2)), 50).select("task_id", "priority", at("available_at"))


@query
def migrations_applied(j: Journal) -> DataFrame:
    """Versions in order, with what is applied, and what a run of the migrations adds."""
    versions = j.runs.select("agent_version").distinct()
    applied = j.runs.where((F.year("created_at") == 1997) & F.col("agent_version").isin("v1", "v3")).select("agent_version").distinct()
    return relations.apply_migrations(versions, applied, "agent_version")
