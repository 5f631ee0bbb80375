"""Arbitration of conditional writes and the plans, on cases that contend."""

from pyspark.sql import functions as F

from runfold.operators import relations, writes
from runfold.plans import lifecycle


def bag(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_one_of_many_claims_wins(spark):
    """A task delivered 21 times runs once."""
    tasks = spark.createDataFrame([("T", "PENDING", 0)], "task_id string, status string, attempt long")
    claims = spark.createDataFrame([("T", n) for n in range(21)], "task_id string, n long").withColumn("from", F.lit("PENDING")).withColumn("to", F.lit("RUNNING"))
    got = writes.task_transition(tasks, claims, [F.col("n")])
    assert bag(got.where("outcome = 'OK'"), "n", "attempt") == [(0, 1)] and got.where("outcome = 'CONFLICT'").count() == 20


def test_version_decides_not_order(spark):
    runs = spark.createDataFrame([("R", "RUNNING", 4), ("Q", "FAILED", 1)], "run_id string, status string, version long")
    rows = [("R", 1, 3, "RUNNING"), ("R", 2, 4, "COMPLETED"), ("R", 3, 4, "RUNNING"), ("Q", 4, 1, "COMPLETED"), ("X", 5, 0, "RUNNING"), ("R", 6, 4, "PARKED")]
    got = writes.run_cas(runs, spark.createDataFrame(rows, "run_id string, n long, expected long, next string"), [F.col("n")])
    assert bag(got, "n", "outcome", "new_version") == [(1, "CONFLICT", None), (2, "OK", 5), (3, "CONFLICT", None), (4, "ILLEGAL", None), (5, "NOT_FOUND", None), (6, "CONFLICT", None)]


def test_leases_are_fenced(spark):
    leases = spark.createDataFrame([("A", 3, "2026-01-01 00:00:00"), ("B", 1, "2026-01-02 00:00:00")], "task_id string, fencing_token long, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    asks = spark.createDataFrame([("A", "W1"), ("A", "W2"), ("B", "W1"), ("C", "W9")], "task_id string, worker_id string")
    got = writes.acquire_lease(leases, asks, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), [F.col("worker_id")])
    assert bag(got, "task_id", "worker_id", "outcome", "token") == [("A", "W1", "OK", 4), ("A", "W2", "LEASE_HELD", None), ("B", "W1", "LEASE_HELD", None), ("C", "W9", "OK", 1)]
    late = spark.createDataFrame([("A", 2), ("A", 3), ("Z", 1)], "task_id string, token long")
    assert bag(writes.fenced(leases, late), "task_id", "token", "outcome") == [("A", 2, "FENCED"), ("A", 3, "OK"), ("Z", 1, "NOT_FOUND")]


def test_signals_are_stored_once_and_in_order(spark):
    runs = spark.createDataFrame([("R", "RUNNING"), ("D", "COMPLETED")], "run_id string, status string")
    signals = spark.createDataFrame([("R", "s1", "go", 1), ("R", "s1", "go", 2), ("R", "s0", "go", 3), ("D", "s1", "go", 4), ("N", "s1", "go", 5)], "run_id string, signal_id string, name string, created_at long")
    stored = writes.deliver_signals(runs, signals, [F.col("created_at")])
    assert bag(stored, "created_at", "outcome") == [(1, "STORED"), (2, "DUPLICATE"), (3, "STORED"), (4, "TERMINAL"), (5, "NOT_FOUND")]
    waits = spark.createDataFrame([("R", "go")], "run_id string, name string")
    consumed = spark.createDataFrame([("R", "s1")], "run_id string, signal_id string")
    kept = stored.where("outcome = 'STORED'").drop("outcome")
    assert bag(relations.unconsumed_signal(waits, kept, consumed), "signal_id") == [("s0",)]
    assert bag(relations.unconsumed_signal(waits, kept, consumed.limit(0)), "signal_id") == [("s1",)]


def test_chains_are_judged_by_what_came_before(spark):
    runs = spark.createDataFrame([("R", "RUNNING", 4)], "run_id string, status string, version long")
    chain = spark.createDataFrame([("R", 1, 4, "RUNNING"), ("R", 2, 5, "COMPLETED"), ("R", 3, 6, "RUNNING"), ("R", 4, 6, "COMPLETED")], "run_id string, n long, expected long, next string")
    assert bag(writes.run_cas(runs, chain, [F.col("n")]), "n", "outcome", "new_version") == [(1, "OK", 5), (2, "OK", 6), (3, "ILLEGAL", None), (4, "OK", 7)]
    tasks = spark.createDataFrame([("T", "PENDING", 0)], "task_id string, status string, attempt long")
    moves = spark.createDataFrame([("T", 1, "PENDING", "RUNNING"), ("T", 2, "RUNNING", "PENDING"), ("T", 3, "PENDING", "RUNNING"), ("T", 4, "RUNNING", "COMPLETED"), ("T", 5, "RUNNING", "FAILED"), (None, 6, "PENDING", "RUNNING")], "task_id string, n long, from string, to string")
    assert bag(writes.task_transition(tasks, moves, [F.col("n")]), "n", "outcome", "attempt") == [(1, "OK", 1), (2, "OK", 1), (3, "OK", 2), (4, "OK", 2), (5, "CONFLICT", 2), (6, "NOT_FOUND", None)]
    leases = spark.createDataFrame([("T", 3)], "task_id string, fencing_token long")
    reports = spark.createDataFrame([("T", 1, 2), ("T", 2, 3), ("T", 3, 3)], "task_id string, n long, token long")
    assert bag(writes.complete_tasks(spark.createDataFrame([("T", "RUNNING")], "task_id string, status string"), leases, reports, [F.col("n")]), "n", "outcome") == [(1, "STALE"), (2, "OK"), (3, "CONFLICT")]


def test_a_random_chain_equals_a_row_at_a_time_reading(spark):
    import random

    from runfold.functions import scalars as S

    r = random.Random(4)
    tasks = [(f"T{i}", r.choice(S.TASK_STATUS), 0) for i in range(40)]
    commands = [(f"T{r.randrange(44)}", n, r.choice(S.TASK_STATUS[:3]), r.choice(S.TASK_STATUS)) for n in range(800)]
    now, want = {t: [s, 0] for t, s, _ in tasks}, []
    for t, n, a, b in commands:
        if t not in now:
            want.append((n, "NOT_FOUND", None))
            continue
        outcome = "CONFLICT" if now[t][0] != a else "OK" if b in S.TASK_MOVES.get(a, ()) else "ILLEGAL"
        if outcome == "OK":
            now[t] = [b, now[t][1] + (b == "RUNNING")]
        want.append((n, outcome, now[t][1]))
    got = writes.task_transition(spark.createDataFrame(tasks, "task_id string, status string, attempt long"), spark.createDataFrame(commands, "task_id string, n long, from string, to string").repartition(5), [F.col("n")])
    assert bag(got, "n", "outcome", "attempt") == sorted(want)


def test_effects_keep_what_an_update_leaves_out(spark):
    effects = spark.createDataFrame([("k", "RUNNING", "ref"), ("m", "COMMITTED", None), ("o", "PENDING", None)], "effect_key string, status string, external_ref string")
    rows = [("k", 1, "RUNNING", "COMMITTED", None), ("m", 2, "RUNNING", "PENDING", "x"), ("m", 3, "COMMITTED", "RUNNING", "x"), ("o", 4, "PENDING", "RUNNING", "a"), ("o", 5, "RUNNING", "UNKNOWN", None)]
    commands = spark.createDataFrame(rows, "effect_key string, n long, from string, to string, external_ref string")
    assert bag(writes.effect_transition(effects, commands, [F.col("n")]), "n", "outcome") == [(1, "OK"), (2, "CONFLICT"), (3, "ILLEGAL"), (4, "OK"), (5, "OK")]
    assert sorted(map(str, writes.update_effects(effects, commands, [F.col("n")], ["external_ref"]).collect())) == sorted(map(str, spark.createDataFrame([("k", "COMMITTED", "ref"), ("m", "COMMITTED", None), ("o", "UNKNOWN", "a")], effects.schema).collect()))
    verdicts = spark.createDataFrame([("k", 1, "COMMITTED", ""), ("k", 2, "COMMITTED", "r"), ("k", 3, "FAILED", ""), ("x", 4, "FAILED", "")], "effect_key string, n long, verdict string, ref string")
    assert bag(writes.resolve_effects(effects, verdicts, [F.col("n")]), "n", "outcome", "new_status") == [(1, "REF_NEEDED", None), (2, "OK", "COMMITTED"), (3, "NOT_OPEN", None), (4, "NOT_FOUND", None)]


def test_heartbeats_extend_their_own_lease_only(spark):
    leases = spark.createDataFrame([("A", 3, "2026-01-01 00:00:00"), ("B", 1, "2026-01-02 00:00:00")], "task_id string, fencing_token long, expires_at string")
    beats = spark.createDataFrame([("A", 1, 3, "2026-01-05"), ("A", 2, 3, "2026-01-03"), ("A", 3, 2, "2026-01-09"), ("Z", 4, 1, "2026-01-09")], "task_id string, n long, token long, until string")
    assert bag(writes.extend_leases(leases, beats, [F.col("n")]), "task_id", "expires_at") == [("A", "2026-01-03"), ("B", "2026-01-02 00:00:00")]


def test_failure_plan(spark):
    rows = [("a", "S1.0", 1, 3, True, False), ("b", "S1.0", 3, 3, True, False), ("c", "S2", 3, 3, True, False), ("d", "S1.1", 1, 3, True, True), ("e", "S2", 3, 3, False, True)]
    failures = spark.createDataFrame(rows, "task_id string, step_id string, attempt int, max_attempts int, token_current boolean, escalated boolean")
    got = bag(lifecycle.failure_plan(failures), "task_id", "task", "run")
    assert got == [("a", "PENDING", "UNCHANGED"), ("b", "DEAD_LETTER", "ADVANCE"), ("c", "DEAD_LETTER", "FAILED"), ("d", "DEAD_LETTER", "FAILED"), ("e", "UNCHANGED", "UNCHANGED")]


def test_top_and_round_robin(spark):
    rows = spark.range(5).withColumn("k", F.lit("a"))
    assert relations.top(rows, [F.col("id")], 0).count() == 5 and bag(relations.top(rows, [F.col("id").desc()], 2), "id") == [(3,), (4,)]
    assert bag(relations.round_robin(rows, [F.col("id")], "k", 2), "id", "worker") == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
