"""Golden cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from runfold.functions import envelope as E
from runfold.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("policy,n,ok,failed,want", [("ALL", 3, 2, 0, False), ("ALL", 3, 1, 2, True), ("ANY", 2, 0, 0, False), ("ANY", 2, 1, 0, True), ("ANY", 3, 0, 2, False), ("ANY", 3, 0, 3, True), ("QUORUM(3)", 5, 2, 0, False), ("QUORUM(3)", 5, 3, 0, True), ("QUORUM(3)", 5, 0, 3, True), ("QUORUM(3)", 5, 0, 2, False), ("MAJORITY_WEIGHTED", 3, 0, 0, True), ("QUORUM(0)", 3, 0, 0, True)])
def test_join_verdict(spark, policy, n, ok, failed, want):
    assert one(spark, S.satisfied(F.lit(policy), F.lit(n), F.lit(ok), F.lit(ok + failed))) is want


@pytest.mark.parametrize("policy,n,want", [("ALL", 0, "no calls"), ("ALL", 1, None), ("QUORUM(3)", 2, "quorum out of range"), ("QUORUM(2)", 2, None), ("QUORUM(0)", 2, "unknown policy"), ("SOME", 2, "unknown policy"), ("QUORUM(2) of them", 3, None)])
def test_policy_error(spark, policy, n, want):
    assert one(spark, S.policy_error(F.lit(policy), F.lit(n))) == want


@pytest.mark.parametrize("step,parent,child", [("S1.0", "S1", 0), ("S1.2.3", "S1.2", 3), ("S4", None, -1), ("S1.x", None, -1), ("S1.-2", "S1", -2), ("S1.+2", "S1", 2), ("", None, -1)])
def test_step_names(spark, step, parent, child):
    assert one(spark, S.parent(F.lit(step))) == parent and one(spark, S.child_index(F.lit(step))) == child


def test_steps_sort_by_number(spark):
    rows = spark.createDataFrame([("S10",), ("S2",), ("S2.11",), ("S2.3",)], "s string")
    assert [r.s for r in rows.orderBy(S.step_order(F.col("s"))).collect()] == ["S2", "S2.3", "S2.11", "S10"]
    assert one(spark, S.children(F.lit("S1"), F.lit(3))) == ["S1.0", "S1.1", "S1.2"] and one(spark, S.children(F.lit("S1"), F.lit(0))) == []
    assert one(spark, S.idempotency_key(F.lit("R123"), F.lit("S2"), F.lit(1))) == "R123:S2:E1"


@pytest.mark.parametrize("ok,certainty,want", [(True, None, "COMMITTED"), (False, "NOT_EXECUTED", "FAILED"), (False, None, "UNKNOWN"), (False, "UNKNOWN", "UNKNOWN"), (False, "other", "UNKNOWN")])
def test_failures(spark, ok, certainty, want):
    assert one(spark, S.classify_failure(F.lit(ok), F.lit(certainty))) == want


@pytest.mark.parametrize("has,status,kind,want", [(False, None, None, "EXECUTE"), (True, "PENDING", "NONE", "EXECUTE"), (True, "FAILED", "QUERYABLE", "EXECUTE"), (True, "COMMITTED", "NONE", "COMPLETE"), (True, "RUNNING", "QUERYABLE", "RECONCILE"), (True, "UNKNOWN", "IDEMPOTENT_BY_KEY", "RECONCILE"), (True, "UNKNOWN", "NONE", "ESCALATE"), (True, "RUNNING", "UNRECONCILABLE", "ESCALATE"), (True, "?", "QUERYABLE", "ESCALATE")])
def test_recovery(spark, has, status, kind, want):
    assert one(spark, S.recovery_action(F.lit(has), F.lit(status), F.lit(kind))) == want


@pytest.mark.parametrize("a,b,want", [("PENDING", "RUNNING", True), ("COMMITTED", "RUNNING", False), ("UNKNOWN", "UNKNOWN", True), ("FAILED", "RUNNING", True), ("FAILED", "COMMITTED", False), ("PENDING", "COMMITTED", False), ("RUNNING", "PENDING", False)])
def test_effect_moves(spark, a, b, want):
    assert one(spark, S.moves(F.lit(a), F.lit(b), S.EFFECT_MOVES)) is want


@pytest.mark.parametrize("attempt,initial,mult,cap,want", [(1, 2, 2, None, 2), (4, 2, 2, None, 16), (4, 2, 2, 10, 10), (3, 2, 0.5, None, 2), (0, 2, 2, None, 0), (2, 0, 2, None, 0)])
def test_backoff(spark, attempt, initial, mult, cap, want):
    assert one(spark, S.backoff_seconds(F.lit(attempt), initial, mult, cap)) == want


def test_jitter_stays_in_bounds(spark):
    r = spark.range(1000).select(S.jittered(F.lit(10.0), 0.4, 3).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert 6 <= r[0] < r[1] < 10 and one(spark, S.jittered(F.lit(5.0), 0, 1)) == 5


@pytest.mark.parametrize("seconds,want", [(0, "0s"), (59, "59s"), (90, "2m0s"), (66739, "18h32m0s"), (172799, "48h0m0s"), (172800, "2d0s"), (277200, "3d5h0m0s"), (3599, "1h0m0s")])
def test_durations(spark, seconds, want):
    assert one(spark, S.duration_text(F.lit(seconds))) == want


def test_times(spark):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    now = t("2026-01-01 00:00:00")
    assert [one(spark, S.elapsed(t(x), now)) for x in ("2026-01-01 00:00:00", "2025-12-31 23:00:00", "2026-01-01 00:00:00.000001", S.INDEFINITE)] == [True, True, False, False]
    assert [one(spark, S.key_expired(t(x), now, F.lit(n))) for x, n in (("2025-12-31 23:00:00", 3600), ("2025-12-31 22:59:59.999999", 3600), ("2000-01-01", 0))] == [False, True, False]
    assert one(spark, S.is_indefinite(t(S.INDEFINITE))) and not one(spark, S.waiting(F.lit(None).cast("timestamp_ntz"), now))
    assert one(spark, S.unix_nanos(t("1970-01-01 00:00:01"))) == 10**9 and one(spark, S.from_nanos(F.lit(0))) is None


@pytest.mark.parametrize("body,want", [('{"reference": "A", "id": "B"}', "A"), ('{"reference": "", "external_ref": "X"}', "X"), ('{"id": 5, "reference_id": "R"}', "R"), ('{"id": 5}', None), ("[1]", None), ("oops", None), ('"text"', None), (None, None)])
def test_external_reference(spark, body, want):
    assert one(spark, E.external_reference(F.lit(body).cast("string"))) == want


@pytest.mark.parametrize("raw,data,error", [('{"v":1,"data":{"k":3}}', 3, None), ('{"v":2,"data":{"k":3}}', None, "unknown version"), ("{", None, "undecodable"), ('{"data":{"k":3}}', None, "unknown version")])
def test_envelope(spark, raw, data, error):
    d = one(spark, E.decode(F.lit(raw), "k long"))
    assert (d.data.k if d.data else None) == data and d.error == error


def test_envelope_round_trip(spark):
    assert one(spark, E.decode(E.wrap(F.struct(F.lit(7).alias("k"))), "k long")).data.k == 7
    assert one(spark, E.decode_delivery(E.encode_delivery(F.lit("T1")))).task_id == "T1"
    assert one(spark, S.hook_resolution(F.lit(True), F.lit(None).cast("string"))) == "NOT_EXECUTED" and one(spark, S.resolution(F.lit("?"))) == "STILL_UNKNOWN"
    assert one(spark, S.descriptor_error(F.lit("t"), F.lit("QUERYABLE"), F.lit(False))) == "no reconciler" and one(spark, S.descriptor_error(F.lit("t"), F.lit(None).cast("string"), F.lit(True))) == "unspecified class"
