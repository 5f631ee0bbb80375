"""Column functions: identity rules, predicates, state machines, policies. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: State machines and enums, fixed values.
RUN_MOVES = {"RUNNING": ("COMPLETED", "FAILED", "CANCELLED")}
TASK_MOVES = {"PENDING": ("RUNNING", "CANCELLED"), "RUNNING": ("COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER", "PENDING")}
EFFECT_MOVES = {"PENDING": ("RUNNING", "FAILED"), "RUNNING": ("COMMITTED", "FAILED", "UNKNOWN"), "FAILED": ("RUNNING",), "UNKNOWN": ("COMMITTED", "FAILED", "RUNNING", "UNKNOWN")}
RUN_STATUS = ("RUNNING", "COMPLETED", "FAILED", "CANCELLED")
TASK_STATUS = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER")
EFFECT_STATUS = ("PENDING", "RUNNING", "COMMITTED", "FAILED", "UNKNOWN")
EFFECT_CLASS = ("NONE", "IDEMPOTENT_BY_KEY", "QUERYABLE", "UNRECONCILABLE")
INDEFINITE = "9999-12-31 23:59:59"
ZERO_TIME = "0001-01-01T00:00:00Z"


def step(n: Column) -> Column:
    return F.concat(F.lit("S"), n)


def child(parent: Column, n: Column) -> Column:
    return F.concat(parent, F.lit("."), n)


def children(parent: Column, n: Column) -> Column:
    """Child names 0 to n - 1, an empty array for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.concat(parent, F.lit("."), i))).otherwise(F.array().cast("array<string>"))


CHILD = r"^(.+)\.([+-]?[0-9]+)$"


def parent(step_id: Column) -> Column:
    """The fan-out of a child step; null for a step that is no child."""
    return F.nullif(F.regexp_extract(step_id, CHILD, 1), F.lit(""))


def child_index(step_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(step_id, CHILD, 2), F.lit("")).cast("long"), F.lit(-1).cast("long"))


def step_order(step_id: Column) -> Column:
    """Sort key of a step by its numbers, not its text: `S10` comes after `S2`."""
    return F.transform(F.split(F.substring(step_id, 2, 1000), r"\."), lambda x: x.cast("long"))


def idempotency_key(run: Column, step_id: Column, seq: Column) -> Column:
    return F.concat(run, F.lit(":"), step_id, F.lit(":E"), seq)


def moves(frm: Column, to: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether the state machine has this edge."""
    out = F.lit(False)
    for state, after in table.items():
        out = F.when(frm == state, to.isin(*after)).otherwise(out)
    return out


def run_terminal(status: Column) -> Column:
    return status.isin("COMPLETED", "FAILED", "CANCELLED")


def task_terminal(status: Column) -> Column:
    return status.isin("COMPLETED", "FAILED", "CANCELLED", "DEAD_LETTER")


def effect_resolved(status: Column) -> Column:
    return status.isin("COMMITTED", "FAILED")


def waiting(available_at: Column, now: Column) -> Column:
    """Parked until later; a past or absent time is ready, never late."""
    return F.coalesce(available_at > now, F.lit(False))


def elapsed(until: Column, now: Column) -> Column:
    return until <= now


def exhausted(attempt: Column, most: Column) -> Column:
    return attempt >= most


def key_expired(created: Column, now: Column, ttl_seconds: Column) -> Column:
    """Strictly later than the time to live; none where that is 0 or less."""
    age = F.timestamp_diff("MICROSECOND", created, now)
    return (ttl_seconds > 0) & (age > ttl_seconds.cast("long") * 1_000_000)


def has_consequence(effect_class: Column) -> Column:
    return effect_class != "NONE"


def can_auto_resolve(effect_class: Column) -> Column:
    return effect_class.isin("IDEMPOTENT_BY_KEY", "QUERYABLE")


def is_suspension(kind: Column) -> Column:
    return kind.isin("SLEEP", "WAIT_FOR_SIGNAL")


def is_indefinite(at: Column) -> Column:
    return at >= F.lit(INDEFINITE).cast("timestamp_ntz")


def policy_kind(policy: Column) -> Column:
    """ALL, ANY or QUORUM; null for any other text."""
    return F.when(policy.isin("ALL", "ANY"), policy).when(policy_quorum(policy) > 0, F.lit("QUORUM"))


def policy_quorum(policy: Column) -> Column:
    """k of `QUORUM(k)`, text after it allowed; null where there is none."""
    return F.nullif(F.regexp_extract(policy, r"^QUORUM\(([0-9]+)", 1), F.lit("")).cast("long")


def policy_text(kind: Column, k: Column) -> Column:
    return F.when(kind == "QUORUM", F.concat(F.lit("QUORUM("), k, F.lit(")"))).otherwise(kind)


def policy_error(policy: Column, n: Column) -> Column:
    """Why a fan-out of n calls can't have this join; null where it can."""
    k = policy_quorum(policy)
    return F.when(n < 1, "no calls").when(policy_kind(policy).isNull(), "unknown policy").when((policy_kind(policy) == "QUORUM") & (k > n), "quorum out of range")


def satisfied(policy: Column, n: Column, ok: Column, settled: Column) -> Column:
    """Join verdict: ALL when all have settled; ANY at one success and QUORUM at k, or when all have
    settled; QUORUM also once so many failed that k can't be reached; unknown policies are satisfied."""
    failed = settled - ok
    return (
        F.when(policy_kind(policy) == "ALL", settled >= n)
        .when(policy_kind(policy) == "ANY", (ok >= 1) | (settled >= n))
        .when(policy_kind(policy) == "QUORUM", (ok >= policy_quorum(policy)) | (n - failed < policy_quorum(policy)))
        .otherwise(F.lit(True))
    )


def classify_failure(ok: Column, certainty: Column) -> Column:
    """Effect status after a call: committed, surely not executed, or unknown."""
    return F.when(ok, "COMMITTED").when(F.coalesce(certainty, F.lit("UNKNOWN")) == "NOT_EXECUTED", "FAILED").otherwise("UNKNOWN")


def recovery_action(has_effect: Column, status: Column, effect_class: Column) -> Column:
    """What to do with a task whose worker was lost, from the state of its effect."""
    return (
        F.when(~has_effect, "EXECUTE")
        .when(status.isin("PENDING", "FAILED"), "EXECUTE")
        .when(status == "COMMITTED", "COMPLETE")
        .when(status.isin("RUNNING", "UNKNOWN") & can_auto_resolve(effect_class), "RECONCILE")
        .otherwise("ESCALATE")
    )


def backoff_seconds(attempt: Column, initial: float, multiplier: float = 2.0, cap: float | None = None) -> Column:
    """Delay before an attempt without jitter: 0 unless initial > 0 and attempt >= 1; a multiplier below 1 counts as 1."""
    delay = F.lit(float(initial)) * F.pow(F.lit(float(max(1.0, multiplier))), attempt - 1)
    if cap:
        delay = F.least(F.lit(float(cap)), delay)
    return F.when((F.lit(initial) <= 0) | (attempt < 1), 0.0).otherwise(delay)


def jittered(delay: Column, jitter: float, seed: int) -> Column:
    """A delay in [d * (1 - j), d) for 0 < j <= 1."""
    j = min(max(jitter, 0.0), 1.0)
    return delay * (1 - j) + delay * j * F.rand(seed) if j else delay


def resolution(answer: Column) -> Column:
    return F.when(answer.isin("COMMITTED", "NOT_EXECUTED"), answer).otherwise("STILL_UNKNOWN")


def hook_resolution(asked: Column, value: Column) -> Column:
    """A hook's answer: no value means not executed."""
    return F.when(~asked, "STILL_UNKNOWN").when(value.isNull(), "NOT_EXECUTED").otherwise("COMMITTED")


def clock_text(seconds: Column) -> Column:
    """`18h32m0s`, `5m0s` or `7s`: units from the largest that is not 0."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    tail = F.concat(s, F.lit("s"))
    return F.when(h > 0, F.concat(h, F.lit("h"), m, F.lit("m"), tail)).when(m > 0, F.concat(m, F.lit("m"), tail)).otherwise(tail)


def duration_text(seconds: Column) -> Column:
    """For people: to the minute below two days (to the second below a minute), else days and the rest to the hour."""
    s = seconds.cast("long")
    to = lambda x, unit: (F.floor(x / unit + 0.5) * unit).cast("long")
    return F.when(s < 60, clock_text(s)).when(s < 172800, clock_text(to(s, 60))).otherwise(F.concat(F.floor(s / 86400), F.lit("d"), clock_text(to(s % 86400, 3600))))


def descriptor_error(name: Column, effect_class: Column, reconcilable: Column) -> Column:
    """Why a tool descriptor is refused; null where it is not."""
    return F.when(F.coalesce(name, F.lit("")) == "", "no name").when(~F.coalesce(effect_class.isin(*EFFECT_CLASS), F.lit(False)), "unspecified class").when((effect_class == "QUERYABLE") & ~F.coalesce(reconcilable, F.lit(False)), "no reconciler")


def unix_nanos(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) * 1000


def from_nanos(n: Column) -> Column:
    """An instant from unix nanoseconds, to the microsecond; 0 is unset."""
    return F.when(n != 0, F.timestamp_micros(F.floor(n.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("long")))


def decision_error(kind: Column, tool: Column, wake_at: Column, signal: Column, n_calls: Column, policy: Column) -> Column:
    """Why a decision is refused, by its kind; null where it is not."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(kind == "CALL_TOOL", F.when(empty(tool), "no tool"))
        .when(kind == "CALL_TOOL_PARALLEL", policy_error(policy, F.coalesce(n_calls, F.lit(0))))
        .when(kind == "SLEEP", F.when(wake_at.isNull(), "no instant"))
        .when(kind == "WAIT_FOR_SIGNAL", F.when(empty(signal), "no signal"))
        .when(kind.isin("COMPLETE", "FAIL", "CANCEL"), F.lit(None).cast("string"))
        .otherwise("unknown kind")
    )


def effect_status_from_log(created: Column, last: Column) -> Column:
    """What the log alone tells of an effect: it does not record the step from pending to running."""
    return F.when(last.isNotNull(), last).when(created, "PENDING_OR_RUNNING")


def class_number(effect_class: Column) -> Column:
    """An effect class's number on the wire, in the order of EFFECT_CLASS from 1; 0, unspecified, for any other."""
    return F.array_position(F.array(*[F.lit(c) for c in EFFECT_CLASS]), effect_class).cast("int")


def class_of_number(number: Column) -> Column:
    """The effect class of a number; null, which is refused, for 0 and unknown ones."""
    return F.get(F.array(*[F.lit(c) for c in EFFECT_CLASS]), F.when(number > 0, number - 1))
