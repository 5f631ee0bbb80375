"""Folds against a row-at-a-time reading of random journals, batch against stream, and replay."""

import random

import pytest
from pyspark.sql import functions as F

from runfold.operators import folds, replay
from runfold.streaming import journal_streams as streams

KINDS = ("TIMER_SET", "SIGNAL_WAIT_STARTED", "TIMER_FIRED", "SIGNAL_RECEIVED", "SIGNAL_WAIT_TIMED_OUT", "TASK_COMPLETED", "TASK_FAILED", "TASK_CREATED", "FAN_OUT_STARTED")
SCHEMA = "run_id string, seq long, event_type string, step_id string, final boolean, policy string, n_calls long, until timestamp_ntz"


def journals(seed=1, runs=150):
    r = random.Random(seed)
    rows = []
    for n in range(runs):
        for seq in range(1, r.randint(2, 14)):
            kind = r.choice(KINDS)
            step = r.choice(["S1", "S2"]) if not kind.startswith("TASK") else r.choice(["S1.0", "S1.1", "S1.2", "S2.0", "S2.1"])
            rows.append((f"R{n}", seq, kind, step, r.random() < 0.6 if kind == "TASK_FAILED" else None, r.choice(["ALL", "ANY", "QUORUM(2)", "ODD"]) if kind == "FAN_OUT_STARTED" else None, r.randint(0, 3) if kind == "FAN_OUT_STARTED" else None, None))
    r.shuffle(rows)
    return rows


def by_run(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[0], x[1])):
        out.setdefault(row[0], []).append(row)
    return out


def open_wait(events):
    found = None
    for _, seq, kind, step, *_ in events:
        if kind in folds.OPENERS:
            found = (step, seq)
        elif kind in folds.CLOSERS and found and found[0] == step:
            found = None
    return found


def open_fanout(events):
    last = None
    for _, _, kind, step, final, policy, n, _ in events:
        if kind == "FAN_OUT_STARTED":
            last = (step, policy, n, {f"{step}.{i}": None for i in range(n)})
        elif last and step in last[3]:
            if kind == "TASK_COMPLETED":
                last[3][step] = True
            elif kind == "TASK_FAILED" and final:
                last[3][step] = False
    if not last:
        return None
    step, policy, n, kids = last
    ok, bad = sum(v is True for v in kids.values()), sum(v is False for v in kids.values())
    done = {"ALL": ok + bad == n, "ANY": ok > 0 or bad == n, "QUORUM(2)": ok >= 2 or n - bad < 2}.get(policy, True)
    return None if done else (step, n, ok, ok + bad)


@pytest.mark.parametrize("seed", [1, 2])
def test_folds(spark, seed):
    rows = journals(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    want = {k: w for k, v in by_run(rows).items() if (w := open_wait(v))}
    assert {r.run_id: (r.step_id, r.seq) for r in folds.pending_wait(log, F.col("until")).collect()} == want
    want = {k: w for k, v in by_run(rows).items() if (w := open_fanout(v))}
    assert {r.run_id: (r.step, r.n, r.ok, r.settled) for r in folds.pending_fanout(log).collect()} == want
    assert folds.seq_gaps(log).isEmpty() and not folds.seq_gaps(log.where("seq <> 2")).isEmpty()


def step_states(events):
    """The steps of a run and whether each was read with an error, one event at a time."""
    steps = {}
    for _, _, kind, step, final, *_ in events:
        one = steps.get(step)
        if kind == "TASK_CREATED":
            steps[step] = ["DECIDED", one[1] if one else None]
        elif kind == "TASK_COMPLETED":
            steps[step] = ["COMPLETED", one[1]] if one else ["COMPLETED", "completion without creation"]
        elif kind == "TASK_FAILED" and final and one and one[0] == "DECIDED":
            one[0] = "FAILED"
    return {k: tuple(v) for k, v in steps.items()}


def wait_states(events):
    waits = {}
    for _, _, kind, step, *_ in events:
        if kind in folds.OPENERS:
            waits[step] = ["OPEN", waits[step][1] if step in waits else None]
        elif kind in folds.CLOSERS:
            one = waits.setdefault(step, [None, "resolution without wait"])
            if one[0]:
                one[0] = "TIMED_OUT" if kind == "SIGNAL_WAIT_TIMED_OUT" else "RESOLVED"
    return {k: tuple(v) for k, v in waits.items()}


def test_histories(spark):
    rows = journals(7)
    log = spark.createDataFrame(rows, SCHEMA)
    want = {(run, k): v for run, events in by_run(rows).items() for k, v in step_states(events).items()}
    assert {(r.run_id, r.step_id): (r.state, r.error) for r in folds.history_steps(log).collect()} == want
    want = {(run, k): v for run, events in by_run(rows).items() for k, v in wait_states(events).items()}
    assert {(r.run_id, r.step_id): (r.state, r.error) for r in folds.history_waits(log).collect()} == want


def test_only_exact_child_names_count(spark):
    rows = [("R", 1, "FAN_OUT_STARTED", "S1", None, "ALL", 2, None), *[("R", 2 + i, "TASK_COMPLETED", s, None, None, None, None) for i, s in enumerate(["S1.-1", "S1.00", "S1.0", "S1.2", "S1.+1"])]]
    got = folds.fanout_children(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.ok, r.settled) for r in got] == [(1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = journals(3, 40)
    source = f"{tmp_path}/in"
    for low, high in ((0, 4), (4, 9), (9, 99)):  # three deliveries, in order
        spark.createDataFrame([r for r in rows if low < r[1] <= high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        raw = streams.stream_parquet(spark, source, "*.parquet")
        waits = streams.durable_waits(raw, F.lit(None).cast("long"), timers=False)
        streams.relay(waits, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.schema(streams.WAIT_OUT).parquet(f"{tmp_path}/out")
    last = folds.last_by(out, ["run_id"], F.col("seq"), {"action": F.col("action"), "step_id": F.col("step_id")})
    assert {r.run_id: r.step_id for r in last.where("action = 'OPEN'").collect()} == {k: w[0] for k, v in by_run(rows).items() if (w := open_wait(v))}


def test_timers_come_due(spark, tmp_path):
    """A wait whose time is past says so in a later batch, once."""
    import time

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [("R1", 1, "TIMER_SET", "S1", None, None, None, None), ("R2", 1, "SIGNAL_WAIT_STARTED", "S1", None, None, None, None), ("R3", 1, "SIGNAL_WAIT_STARTED", "S1", None, None, None, None)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    raw = streams.stream_parquet(spark, source, "*.parquet")
    until = F.when(F.col("run_id") != "R3", F.lit(int(time.time() * 1000) + 500))
    sent = streams.durable_waits(raw, until).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    deadline = time.time() + 60
    seen = set()
    while time.time() < deadline and len(seen) < 2:
        time.sleep(1)
        try:
            seen = {(r.run_id, r.action) for r in spark.read.schema(streams.WAIT_OUT).parquet(out).where("action not in ('OPEN', 'CLOSED')").collect()}
        except Exception:  # no batch yet
            pass
    sent.stop()
    assert seen == {("R1", "TIMER_FIRED"), ("R2", "SIGNAL_WAIT_TIMED_OUT")}


def test_deliveries_are_split(spark):
    raw = spark.createDataFrame([('{"v":1,"task_id":"T"}',), ("{",), ('{"v":1,"task_id":""}',)], "value string")
    good, bad = streams.split_deliveries(raw)
    assert [r.task_id for r in good.collect()] == ["T"] and sorted(r.error for r in bad.collect()) == ["no task", "undecodable"]


def test_heartbeats(spark):
    beats = spark.createDataFrame([("W", "2024-01-01 00:00:00"), ("W", "2024-01-01 00:00:20"), ("W", "2024-01-01 00:02:00")], "worker_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.beats for r in streams.heartbeat_sessions(beats).collect()) == [1, 2]


def body(ctx, ok_first=True):
    order = ctx.call("lookup", id=7)
    if order["ok"] and ok_first:
        parts = ctx.call_parallel([("a", {}), ("b", {"n": 1})])
        ctx.sleep(60)
        return [ctx.wait_for("go", 5), [p.result for p in parts], ctx.random().random() < 2]
    return "no"


def decisions(spark, histories, body):
    """kind, step, reissued and error of each history, given as lists of (event_type, step_id, body)."""
    import datetime as dt
    import json

    rows = [(f"R{n}", i, t, s, json.dumps(b), dt.datetime(2026, 1, 1)) for n, events in enumerate(histories) for i, (t, s, b) in enumerate([("RUN_STARTED", None, {"input": {"ok_first": True}}), *events], 1)]
    log = spark.createDataFrame(rows, "run_id string, seq long, event_type string, step_id string, body string, created_at timestamp_ntz").repartition(3)
    got = {r.run_id: r for r in replay.replay(log, body).collect()}
    return [got[f"R{n}"] for n in range(len(histories))]


CALL = ("TASK_CREATED", "S1", {"task_type": "lookup", "payload": {"id": 7}})
DONE = ("TASK_COMPLETED", "S1", {"result": {"ok": True}})
FAN = ("FAN_OUT_STARTED", "S2", {"calls": ["a", "b"], "join": "ALL"})
MADE = (("TASK_CREATED", "S2.0", {"task_type": "a", "payload": {}}), ("TASK_CREATED", "S2.1", {"task_type": "b", "payload": {"n": 1}}))
KIDS = (("TASK_COMPLETED", "S2.1", {"result": 2}), ("TASK_FAILED", "S2.0", {"final": True, "error": "x"}))
SLEEP, WOKE = ("TIMER_SET", "S3", {"wake_at": "2026-01-01T00:01:00"}), ("TIMER_FIRED", "S3", {})
WAIT, GOT, LATE = ("SIGNAL_WAIT_STARTED", "S4", {"name": "go"}), ("SIGNAL_RECEIVED", "S4", {"payload": 5}), ("SIGNAL_WAIT_TIMED_OUT", "S4", {})


def test_replay(spark):
    fan = (CALL, DONE, FAN, *MADE)
    cases = [
        ((), "CALL_TOOL", "S1", False), ((CALL,), "CALL_TOOL", "S1", True), ((CALL, DONE), "CALL_TOOL_PARALLEL", "S2", False), ((*fan, KIDS[0]), "CALL_TOOL_PARALLEL", "S2", True), ((*fan, *KIDS), "SLEEP", "S3", False),
        ((*fan, *KIDS, SLEEP), "SLEEP", "S3", True), ((*fan, *KIDS, SLEEP, WOKE), "WAIT_FOR_SIGNAL", "S4", False), ((*fan, *KIDS, SLEEP, WOKE, WAIT), "WAIT_FOR_SIGNAL", "S4", True), ((*fan, *KIDS, SLEEP, WOKE, WAIT, GOT), "COMPLETE", None, False), ((*fan, *KIDS, SLEEP, WOKE, WAIT, LATE), "FAIL", None, False),
        ((CALL, DONE, CALL), "CALL_TOOL", "S1", True),
    ]
    got = decisions(spark, [c[0] for c in cases], body)
    assert [(r.kind, r.step_id, r.reissued) for r in got] == [c[1:] for c in cases]
    assert got[8].detail == "[5,[null,2],true]" and "SignalTimeout" in got[9].error


def test_divergence_and_failure(spark):
    other = ("TASK_CREATED", "S1", {"task_type": "lookup", "payload": {"id": 7.0}})
    child = ("TASK_CREATED", "S2.0", {"task_type": "a", "payload": {"m": 1}})
    failed = ("TASK_FAILED", "S1", {"final": True, "error": "gone"})
    cases = [(other,), (CALL, failed), (CALL, ("TASK_FAILED", "S1", {"final": False})), (DONE,), (CALL, DONE, FAN, child), (WOKE,)]
    got = decisions(spark, cases, body)
    assert [(r.error or r.kind).split(":")[0] for r in got] == ["Divergence", "StepFailed", "CALL_TOOL", "BrokenHistory", "Divergence", "BrokenHistory"]


def test_joins_of_a_fan_out(spark):
    def any_of(ctx, input):
        return [o.ok for o in ctx.call_parallel([("a", {}), ("b", {"n": 1})], "ANY")]

    def two_of(ctx, input):
        return [o.ok for o in ctx.call_parallel([("a", {}), ("b", {"n": 1})], "QUORUM(2)")]

    def three_of(ctx, input):
        return ctx.call_parallel([("a", {})], "QUORUM(3)")

    at = lambda events: [(t, s.replace("S2", "S1"), b) for t, s, b in events]
    cases = [at([*MADE, KIDS[0]]), at([*MADE, KIDS[1]]), at(MADE)]
    assert [(r.kind, r.detail if r.kind == "COMPLETE" else None) for r in decisions(spark, cases, any_of)] == [("COMPLETE", "[false,true]"), ("CALL_TOOL_PARALLEL", None), ("CALL_TOOL_PARALLEL", None)]
    assert [r.kind for r in decisions(spark, cases, two_of)] == ["CALL_TOOL_PARALLEL", "COMPLETE", "CALL_TOOL_PARALLEL"]
    assert [r.kind for r in decisions(spark, cases[:1], three_of)] == ["FAIL"]


def test_lint_and_canonical(spark):
    def bad(ctx):
        import time

        return time.time()

    def good(ctx):
        door = ctx.call("door")
        return door.open().time

    assert replay.lint(body) == [] and replay.lint(good) == [] and replay.lint(bad) == ["time: the clock"]
    rows = spark.createDataFrame([('{"b":1.0,"a":2}',), ("x",), (None,)], "j string")
    assert [r[0] for r in rows.select(replay.canonical_json("j")).collect()] == ['{"a":2,"b":1.0}', None, None]
