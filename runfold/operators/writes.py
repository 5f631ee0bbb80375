"""Conditional writes as batch arbitration: proposed commands in order, accepted or refused.

Rows that Spark can't lock are decided by order: each command on a key is judged by what
the last accepted one left. The result says so for each command, as the live system would have. Inserts under a
unique key and leases need no more than a rank; chains of transitions are read in order (`fold`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.functions import scalars as S
from runfold.session import ship


def first_per_key(commands: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """OK for each key's first command, CONFLICT for its others (inserts under a unique key)."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return commands.withColumn("outcome", F.when(nth == 1, "OK").otherwise("CONFLICT"))


def insert_new(existing: DataFrame, commands: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """As `first_per_key`, but keys that exist already are refused as well."""
    known = existing.select(*key).distinct().withColumn("__known", F.lit(True))
    return first_per_key(commands, key, order).join(known, key, "left").withColumn("outcome", F.when(F.col("__known"), "CONFLICT").otherwise(F.col("outcome"))).drop("__known")


#: A column that a key determines and the partitions that rows are dealt to by it: where all have it, they meet there and no join by key is needed.
Near = tuple[str, int]


def beside(commands: DataFrame, key: str, rows: dict[str, tuple[DataFrame, list[str]]], near: Near | None) -> DataFrame:
    """``commands`` and, in columns of their names, structs of the ``rows`` of their keys: one table, dealt once. Rows have one row a key."""
    out = commands.withColumns({n: F.lit(None).cast(df.select(F.struct(*columns).alias("s")).schema["s"].dataType) for n, (df, columns) in rows.items()})
    at = [near[0]] if near else []
    for n, (df, columns) in rows.items():
        out = out.unionByName(df.select(*at, key, F.struct(*columns).alias(n)), allowMissingColumns=True)
    return out.repartition(near[1], near[0]) if near else out.repartition(key)


def fold(commands: DataFrame, key: str, order: list[Column], takes: list[str], out: str, step: Callable[[dict, tuple], tuple], rows: dict[str, tuple[DataFrame, list[str]]], near: Near | None = None) -> DataFrame:
    """``commands`` with the columns ``out``: each key's commands read in order, one at a time, against what the last one left.

    step(state, values of ``takes``) gives the values of ``out`` and may change state, at a key's first command a dict of
    its ``rows``: name to their columns' values, one row a key of each at most. Rows are sorted by Spark and pass one by one, so a key of any length takes no more
    memory than one of its rows; equal rows are told apart by their place.
    """
    ship(commands.sparkSession)
    names = [x.split()[0] for x in out.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in out.split(", ")]
    given = {f"__row{i}": n for i, n in enumerate(rows)}
    kept = commands.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            new = np.ones(batch.num_rows, bool)  # where another key begins
            new[1:] = ~pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
            if keys.null_count:
                null = keys.is_null().to_numpy(zero_copy_only=False)
                new[1:] &= ~(null[1:] & null[:-1])
            new[0] = now is None or now != keys[0]
            now = keys[len(keys) - 1]
            own = np.zeros(batch.num_rows, bool)
            held = {}
            for column, name in given.items():
                values = batch.column(column)
                there = values.is_valid().to_numpy(zero_copy_only=False)
                own |= there
                at = np.flatnonzero(there)
                read_rows = zip(*(f.take(pa.array(at)).to_pylist() for f in values.flatten()), strict=True)
                held.update({int(i): (name, v) for i, v in zip(at, read_rows, strict=True)})
            found = []
            columns = [decoded(batch.column(c)) for c in takes]
            for i, (begins, *values) in enumerate(zip(new.tolist(), *columns, strict=True)):
                if begins:
                    state = {}
                if i in held:
                    name, state[name] = held[i][0], held[i][1]
                else:
                    found.append(step(state, values))
            mask = pa.array(~own)
            results = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(mask) for c in kept], *results], names=[*kept, *names])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in commands.schema.fields], *[T.StructField(n, T.StringType() if k == pa.string() else T.LongType()) for n, k in zip(names, kinds, strict=True)]])
    known = {c: (rows[n][0].where(F.col(key).isNotNull()), rows[n][1]) for c, n in given.items()}
    dealt = beside(commands, key, known, near)
    asked = F.coalesce(*[F.when(F.col(c).isNotNull(), False) for c in given], F.lit(True))
    return dealt.sortWithinPartitions(key, asked, *order).mapInArrow(read, schema)


def decoded(column: pa.Array) -> list:
    """The column's values; texts that repeat are made once."""
    if not pa.types.is_string(column.type):
        return column.to_pylist()
    coded = column.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    return [names[i] for i in pc.fill_null(coded.indices, len(names) - 1).to_numpy(zero_copy_only=False)]


def run_cas(runs: DataFrame, commands: DataFrame, order: list[Column], near: Near | None = None) -> DataFrame:
    """Compare-and-set of a run's version: commands (run_id, expected, next, ...) with outcome and new_version.

    NOT_FOUND without a run, CONFLICT when the run is at another version by then, ILLEGAL when its
    state machine has no such step; else OK, which moves the version on for the commands after it.
    """

    def step(state: dict, row: tuple) -> tuple:
        expected, after = row
        status, version = state.get("is", (None, None))
        if version is None:
            return "NOT_FOUND", None
        if version != expected:
            return "CONFLICT", None
        if after != status and after not in S.RUN_MOVES.get(status, ()):
            return "ILLEGAL", None
        state["is"] = (after, version + 1)
        return "OK", version + 1

    return fold(commands, "run_id", order, ["expected", "next"], "outcome string, new_version long", step, {"is": (runs, ["status", "version"])}, near)


def transition(rows: DataFrame, key: str, commands: DataFrame, order: list[Column], moves: dict[str, tuple[str, ...]], near: Near | None = None, attempts: bool = False) -> DataFrame:
    """commands (key, from, to, ...) on the status of ``rows``: OK, CONFLICT from another status, ILLEGAL, NOT_FOUND; ``earlier``: how often the key entered RUNNING, this command included. With ``attempts`` instead ``attempt``: that and the row's own attempts."""

    def step(state: dict, row: tuple) -> tuple:
        begin, end = row
        status, *n = state.get("row", (None,))
        n = n[0] if n else 0
        if status is None:
            return "NOT_FOUND", n if "row" in state or not attempts else None
        if status != begin:
            return "CONFLICT", n
        if end not in moves.get(begin, ()):
            return "ILLEGAL", n
        if end == "RUNNING" and n is not None:
            n += 1
        state["row"] = (end, n)
        return "OK", n

    return fold(commands, key, order, ["from", "to"], f"outcome string, {'attempt' if attempts else 'earlier'} long", step, {"row": (rows, ["status", "attempt"] if attempts else ["status"])}, near)


def task_transition(tasks: DataFrame, commands: DataFrame, order: list[Column], near: Near | None = None) -> DataFrame:
    """commands (task_id, from, to): outcome, and the task's attempts after it; entering RUNNING counts one."""
    return transition(tasks, "task_id", commands, order, S.TASK_MOVES, near, attempts=True)


def acquire_lease(leases: DataFrame, commands: DataFrame, now: Column, order: list[Column], near: Near | None = None) -> DataFrame:
    """commands (task_id, worker_id): the first for a task without a live lease gets it with the next token."""
    asked = F.col("__lease").isNull()
    task = Window.partitionBy(*([near[0]] if near else []), "task_id").orderBy(asked, *order)  # a task's lease, then its commands
    dealt = beside(commands, "task_id", {"__lease": (leases.where("task_id is not null"), ["fencing_token", "expires_at"])}, near)
    placed = dealt.withColumn("__held", F.max("__lease").over(task)).withColumn("__nth", F.sum(asked.cast("long")).over(task.rowsBetween(Window.unboundedPreceding, 0))).where(asked)
    free = F.col("__held.expires_at").isNull() | (F.col("__held.expires_at") <= now)
    won = free & (F.col("__nth") == 1)
    return placed.withColumn("outcome", F.when(won, "OK").otherwise("LEASE_HELD")).withColumn("token", F.when(won, F.coalesce("__held.fencing_token", F.lit(0)) + 1)).drop("__lease", "__held", "__nth")


def fenced(leases: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (task_id, token): OK with the lease's own token, FENCED with another, NOT_FOUND without a lease."""
    joined = commands.join(leases.select("task_id", "fencing_token"), "task_id", "left")
    outcome = F.when(F.col("fencing_token").isNull(), "NOT_FOUND").when(F.col("fencing_token") == F.col("token"), "OK").otherwise("FENCED")
    return joined.withColumn("outcome", outcome)


def extend_leases(leases: DataFrame, commands: DataFrame, order: list[Column]) -> DataFrame:
    """Leases after heartbeats and releases: commands (task_id, token, until); a release ends at its own instant, and the row stays.

    Of the commands under the lease's own token the last by ``order`` holds; others change nothing.
    """
    last = fenced(leases, commands).where("outcome = 'OK'").groupBy("task_id").agg(F.max_by("until", F.struct(*order)).alias("__until"))
    return leases.join(last, "task_id", "left").withColumn("expires_at", F.coalesce("__until", "expires_at")).drop("__until")


def last_per_key(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Upsert: the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(key, "__r.*")


def deliver_signals(runs: DataFrame, signals: DataFrame, order: list[Column]) -> DataFrame:
    """Signals on arrival: NOT_FOUND and TERMINAL runs refuse, a repeated id is a DUPLICATE, others are STORED."""
    joined = signals.join(runs.select("run_id", F.col("status").alias("__status")), "run_id", "left")
    nth = F.row_number().over(Window.partitionBy("run_id", "signal_id").orderBy(*order))
    outcome = F.when(F.col("__status").isNull(), "NOT_FOUND").when(S.run_terminal(F.col("__status")), "TERMINAL").when(nth > 1, "DUPLICATE").otherwise("STORED")
    return joined.withColumn("outcome", outcome).drop("__status")


def delivery_failures(deliveries: DataFrame, failures: DataFrame) -> DataFrame:
    """Attempts of each delivery after the failures (outbox_id) are counted."""
    n = failures.groupBy("outbox_id").agg(F.count(F.lit(1)).alias("__n"))
    return deliveries.join(n, "outbox_id", "left").withColumn("attempts", F.col("attempts") + F.coalesce("__n", F.lit(0))).drop("__n")


def resolve_effects(effects: DataFrame, commands: DataFrame, order: list[Column], near: Near | None = None) -> DataFrame:
    """An operator's verdicts (effect_key, verdict, ref): COMMITTED needs a reference; only an effect open by then can be resolved."""

    def step(state: dict, row: tuple) -> tuple:
        verdict, ref = row
        status = state.get("is", (None,))[0]
        if status is None:
            return "NOT_FOUND", None
        if status not in ("RUNNING", "UNKNOWN"):
            return "NOT_OPEN", None
        if verdict == "COMMITTED" and not ref:
            return "REF_NEEDED", None
        state["is"] = (verdict,)
        return "OK", verdict

    return fold(commands, "effect_key", order, ["verdict", "ref"], "outcome string, new_status string", step, {"is": (effects, ["status"])}, near)


def release_runs(runs: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Runs with those that a stored signal reached (run_id) unparked; the version stays."""
    reached = arrivals.select("run_id").distinct().withColumn("__reached", F.lit(True))
    return runs.join(reached, "run_id", "left").withColumn("available_at", F.when(F.col("__reached").isNull(), F.col("available_at"))).drop("__reached")


def effect_transition(effects: DataFrame, commands: DataFrame, order: list[Column], near: Near | None = None) -> DataFrame:
    """commands (effect_key, from, to, ...) with their outcome, each judged by what the last one left."""
    return transition(effects, "effect_key", commands, order, S.EFFECT_MOVES, near).drop("earlier")


def update_effects(effects: DataFrame, commands: DataFrame, order: list[Column], columns: list[str], near: Near | None = None) -> DataFrame:
    """Effects after the commands (effect_key, from, to, and ``columns``) that are OK, one row each; a null keeps what was there."""
    held = effect_transition(effects, commands, order, near).where("outcome = 'OK'")
    place = F.struct(*order)
    keys = [near[0], "effect_key"] if near else ["effect_key"]
    changed = held.select(*keys, F.col("to").alias("__status"), *[F.col(c).alias(f"__{c}") for c in columns], place.alias("__place"))
    dealt, own = beside(changed, "effect_key", {"__effect": (effects, effects.columns)}, near), Window.partitionBy(*keys)
    last = {f"__{c}": F.max_by(f"__{c}", F.when(F.col(f"__{c}").isNotNull(), F.col("__place"))).over(own) for c in ("status", *columns)}
    return dealt.withColumns(last).where("__effect is not null").select(*[F.coalesce(f"__{c}", f"__effect.{c}").alias(c) if c in ("status", *columns) else F.col(f"__effect.{c}").alias(c) for c in effects.columns])


def complete_tasks(tasks: DataFrame, leases: DataFrame, reports: DataFrame, order: list[Column], near: Near | None = None) -> DataFrame:
    """Reports of results (task_id, token): STALE under another token, CONFLICT when the task does not run by then, else OK, which completes it."""

    def step(state: dict, row: tuple) -> tuple:
        (token,) = row
        status, held = state.get("task", (None,))[0], state.get("lease", (None,))[0]
        if status is None:
            return ("NOT_FOUND",)
        if held is None or held != token:
            return ("STALE",)
        if status != "RUNNING":
            return ("CONFLICT",)
        state["task"] = ("COMPLETED",)
        return ("OK",)

    return fold(reports, "task_id", order, ["token"], "outcome string", step, {"task": (tasks, ["status"]), "lease": (leases, ["fencing_token"])}, near)
