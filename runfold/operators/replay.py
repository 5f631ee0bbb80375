"""Replay of agent bodies against recorded histories.

Spark folds each run's log to one row a step (the last call, its result or final error, the last wait
and what ended it) and these to one row a run. A body is a Python function of a `Context`: its
calls, waits and fan-outs take positions in one sequence; what a position already recorded is
answered at once, and the first one without an answer ends the replay and is the run's decision.
A step that is under way is decided again as it was recorded, which creates nothing twice. A call that differs from
the record is a divergence and becomes an error.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import inspect
import json
import operator
import random
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.operators.folds import CLOSERS, OPENERS
from runfold.session import ship

DECISIONS = "run_id string, kind string, step_id string, detail string, reissued boolean, error string"


class Suspend(Exception):
    """The body can't go on: it needs this step."""

    def __init__(self, kind: str, step: str, detail: Any = None, reissued: bool = False):
        self.kind, self.step, self.detail, self.reissued = kind, step, detail, reissued


class Divergence(Exception):
    """The body asks for something else than the history has at this position."""


class BrokenHistory(Exception):
    """A completion without a creation, or a resolution without a wait, before it."""


class StepFailed(Exception):
    """A recorded step failed for good."""


class SignalTimeout(Exception):
    """A wait for a signal ended at its deadline."""


@dataclasses.dataclass
class Outcome:
    """What became of one call of a fan-out."""

    index: int
    tool: str
    settled: bool = False
    ok: bool = False
    result: Any = None
    error: str | None = None

    def unwrap(self) -> Any:
        if not self.ok:
            raise StepFailed(f"{self.tool}: {self.error or 'not settled'}")
        return self.result


ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical(payload: Any) -> str:
    """JSON with sorted keys; 1 and 1.0 differ."""
    return ENCODER.encode(payload)


def alike(a: Any, b: Any) -> bool:
    """Whether two payloads are one in canonical JSON; objects of plain texts and whole numbers need not be written for it."""
    if type(a) is dict and type(b) is dict and len(a) == len(b) and all(type(k) is str and k in b and type(v) is type(b[k]) and type(v) in (str, int, bool) and v == b[k] for k, v in a.items()):
        return True
    return canonical(a) == canonical(b)


def satisfied(join: str, outcomes: list[Outcome]) -> bool:
    """Whether a fan-out has ended: see `scalars.satisfied`, the same rule over columns."""
    ok = sum(o.settled and o.ok for o in outcomes)
    failed = sum(o.settled and not o.ok for o in outcomes)
    if join == "ALL":
        return ok + failed == len(outcomes)
    if join == "ANY":
        return ok > 0 or failed == len(outcomes)
    return ok >= quorum(join) or len(outcomes) - failed < quorum(join)


def quorum(join: str) -> int:
    found = re.match(r"QUORUM\(([0-9]+)", join)
    if not found:
        raise ValueError(f"unknown join {join}")
    return int(found[1])


class Context:
    """What a body sees: calls, waits, the run's clock and its random numbers."""

    def __init__(self, run_id: str, started: dt.datetime | None, steps: dict[str, dict]):
        self.run_id, self._started, self._steps, self._n = run_id, started, steps, 0
        self._random = random.Random(run_id)

    def _next(self) -> tuple[str, dict]:
        self._n += 1
        name = f"S{self._n}"
        return name, self._steps.get(name, {})

    def _same(self, step: str, recorded: tuple, asked: tuple) -> None:
        if recorded[0] != asked[0] or not alike(recorded[1], asked[1]):
            raise Divergence(f"{step}: recorded {recorded[0]} {canonical(recorded[1])}, replayed {asked[0]} {canonical(asked[1])}")

    def now(self) -> dt.datetime:
        """The time of the run's first event."""
        return self._started or dt.datetime(1970, 1, 1)

    def random(self) -> random.Random:
        """A source of random numbers, the same at each replay of the run."""
        return self._random

    def call(self, tool: str, **payload: Any) -> Any:
        name, step = self._next()
        asked = {"tool": tool, "payload": payload}
        if "call" not in step:
            raise Suspend("CALL_TOOL", name, asked)
        self._same(name, step["call"], (tool, payload))
        if "error" in step:
            raise StepFailed(f"{name}: {step['error']}")
        if "result" not in step:
            raise Suspend("CALL_TOOL", name, asked, True)
        return step["result"]

    def call_parallel(self, calls: list[tuple[str, dict]], join: str = "ALL") -> list[Outcome]:
        """Outcomes in the order of the calls, once the join (ALL, ANY, QUORUM(k)) has ended; until then the fan-out is decided again.

        What a child was asked is in its own creation, so that is what each call is compared with.
        """
        if not calls:
            raise ValueError("a fan-out needs a call")
        if join not in ("ALL", "ANY") and not 0 < quorum(join) <= len(calls):
            raise ValueError(f"{join} of {len(calls)} calls can't be reached")
        name, _ = self._next()
        out = []
        for i, (tool, payload) in enumerate(calls):
            child = self._steps.get(f"{name}.{i}", {})
            if "call" in child:
                self._same(f"{name}.{i}", child["call"], (tool, payload))
            out.append(Outcome(i, tool, "error" in child or "result" in child, "result" in child, child.get("result"), child.get("error")))
        if not satisfied(join, out):
            made = any("call" in self._steps.get(f"{name}.{i}", {}) for i in range(len(calls)))
            raise Suspend("CALL_TOOL_PARALLEL", name, {"calls": [{"tool": t, "payload": p} for t, p in calls], "join": join}, made)
        return out

    def sleep(self, seconds: float | None = None, until: dt.datetime | None = None) -> None:
        """Until an instant, or for seconds from the run's start; a recorded instant stays as it was."""
        if (seconds is None) == (until is None):
            raise ValueError("sleep takes seconds or until")
        name, step = self._next()
        if "over" in step:
            return
        if "wait" in step:
            raise Suspend("SLEEP", name, {"wake_at": step["wait"][1].get("wake_at")}, True)
        if seconds is not None and seconds < 0:
            raise ValueError("a negative duration")
        raise Suspend("SLEEP", name, {"wake_at": (until or self.now() + dt.timedelta(seconds=seconds)).isoformat()})

    def wait_for(self, signal: str, timeout: float | None = None) -> Any:
        """The payload of a signal; SignalTimeout where the wait ended at its deadline, which counts from the run's start."""
        if not signal:
            raise ValueError("wait_for needs a signal")
        name, step = self._next()
        if "over" in step:
            if step["over"][0] == "SIGNAL_WAIT_TIMED_OUT":
                raise SignalTimeout(step["wait"][1].get("name") or signal)
            return step["over"][1].get("payload")
        if "wait" in step or timeout is None:
            raise Suspend("WAIT_FOR_SIGNAL", name, {"name": signal, "deadline": None}, "wait" in step)
        if timeout < 0:
            raise ValueError("a negative timeout")
        raise Suspend("WAIT_FOR_SIGNAL", name, {"name": signal, "deadline": (self.now() + dt.timedelta(seconds=timeout)).isoformat()})


def as_object(value: Any) -> dict:
    """A JSON object, also where it comes as text; anything else is an empty one."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return {}
    return value if isinstance(value, dict) else {}


@functools.lru_cache(maxsize=64)
def takes_input(body: Callable) -> bool:
    return "input" in inspect.signature(body).parameters


def arguments(body: Callable, given: dict) -> dict:
    """A run's input as a body's arguments: the whole of it for one named ``input``, else by name."""
    return {"input": given} if takes_input(body) else given


def decide(run_id: str, started: dt.datetime | None, given: str | None, rows: list[dict], body: Callable[..., Any]) -> tuple:
    """One run's decision row from its steps as `steps_of` folds them."""
    try:
        steps = {}
        for r in rows:
            if r["broken"]:
                raise BrokenHistory(f"{r['step_id']}: {r['broken']}")
            read = {c: as_object(r[c]) for c in ("call", "result", "error", "wait", "over") if r[c] is not None}
            step = steps[r["step_id"]] = {}
            if "call" in read:
                step["call"] = (read["call"].get("task_type"), as_object(read["call"].get("payload")))
            if "result" in read:
                step["result"] = read["result"].get("result")
            if "error" in read:
                step["error"] = read["error"].get("error") or "the step failed"
            for c in ("wait", "over"):
                if c in read:
                    step[c] = (r[f"{c}_kind"], read[c])
        inputs = arguments(body, as_object(as_object(given).get("input")))
        return (run_id, "COMPLETE", None, canonical(body(Context(run_id, started, steps), **inputs)), False, None)
    except Suspend as s:
        return (run_id, s.kind, s.step, None if s.detail is None else canonical(s.detail), s.reissued, None)
    except Exception as e:  # the body is the user's; its failure is the run's
        return (run_id, "FAIL", None, None, False, f"{type(e).__name__}: {e}")


def steps_of(log: DataFrame, key: str = "run_id") -> DataFrame:
    """A row for each step of log (key, seq, event_type, step_id, body): what a replay needs of it.

    The last creation and the last opener of a wait replace what was before them. Bodies are JSON text.
    """
    return folded(log, key, {}).where("known and step_id is not null").drop("known")


def folded(log: DataFrame, key: str, more: dict[str, Column]) -> DataFrame:
    """As `steps_of`, and rows of steps that a replay needs nothing of, and of what has no step; ``known`` tells them. ``more``: aggregates of each row's events."""
    kind, seq = F.col("event_type"), F.col("seq")
    final = (kind == "TASK_FAILED") & (F.get_json_object("body", "$.final") == "true")
    one = {"call": kind == "TASK_CREATED", "result": kind == "TASK_COMPLETED", "error": final, "wait": kind.isin(*OPENERS), "over": kind.isin(*CLOSERS)}
    last = [F.max(F.when(c, F.struct(seq.alias("seq"), F.coalesce("body", F.lit("{}")).alias("body"), kind.alias("kind")))).alias(n) for n, c in one.items()]
    first = [F.min(F.when(one[n], seq)).alias(f"first_{n}") for n in ("call", "result", "wait", "over")]
    known = functools.reduce(operator.or_, [F.coalesce(c, F.lit(False)) for c in one.values()])
    seen = log.groupBy(key, "step_id").agg(*last, *first, F.max(known).alias("known"), *[c.alias(n) for n, c in more.items()])
    since = lambda c, begin: F.when(F.coalesce(F.col(f"{c}.seq") > F.col(f"{begin}.seq"), F.lit(False)), F.col(f"{c}.body"))
    early = lambda c, begin: F.col(f"first_{c}").isNotNull() & F.coalesce(F.col(f"first_{c}") < F.col(f"first_{begin}"), F.lit(True))
    done = since("result", "call")
    broken = F.when(early("result", "call"), "completion without creation").when(early("over", "wait"), "resolution without wait")
    return seen.select(
        key, "step_id", F.col("call.body").alias("call"), done.alias("result"), F.when(done.isNull(), since("error", "call")).alias("error"),
        F.col("wait.body").alias("wait"), F.col("wait.kind").alias("wait_kind"), since("over", "wait").alias("over"), F.col("over.kind").alias("over_kind"), broken.alias("broken"), "known", *more,
    )


def replay(log: DataFrame, body: Callable[..., Any], key: str = "run_id") -> DataFrame:
    """The next decision of every run: log (run_id, seq, event_type, step_id, body as JSON, created_at).

    A run's row in a task holds its steps, not its events. ``key`` names a run, where the log is partitioned by another column than run_id;
    the log is read once.
    """
    names = ["step_id", "call", "result", "error", "wait", "wait_kind", "over", "over_kind", "broken"]
    of_run = {"id": F.first("run_id"), "began": F.min(F.when(F.col("seq").isNotNull(), F.struct("seq", "created_at"))), "given": F.max(F.when(F.col("event_type") == "RUN_STARTED", F.col("body")))}
    steps = F.collect_list(F.when(F.col("known") & F.col("step_id").isNotNull(), F.struct(*names)))
    runs = folded(log, key, of_run).groupBy(key).agg(F.first("id").alias("id"), F.min("began").alias("began"), F.max("given").alias("given"), steps.alias("steps"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in DECISIONS.split(", "))])
        for batch in batches:
            rows = [decide(r["id"], r["started"], r["given"], r["steps"] or [], body) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    ship(log.sparkSession)
    return runs.select("id", F.col("began.created_at").alias("started"), "given", "steps").mapInArrow(one, DECISIONS)


def canonical_json(column: str):
    """A column of JSON text with sorted keys, numbers as written; null where the text is no JSON."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else canonical(json.loads(x))
            except ValueError:
                return None

        return texts.map(one)

    return convert(F.col(column))


def describe(tool: str, payload: str):
    """A column: a call in one line, its payload's keys sorted; a payload that is no JSON object is an empty one."""

    @F.pandas_udf("string")
    def convert(tools: pd.Series, payloads: pd.Series) -> pd.Series:
        return pd.Series([f"{t}({json.dumps(as_object(p), sort_keys=True)})" for t, p in zip(tools, payloads, strict=True)])

    return convert(F.col(tool), F.col(payload))


#: Names whose use makes a body depend on more than its history; fixed values.
UNSAFE = {"time": "the clock", "datetime": "the clock", "random": "random numbers", "uuid4": "random ids", "urandom": "random bytes", "requests": "the network", "open": "files", "environ": "the environment", "getenv": "the environment"}


def lint(body: Callable) -> list[str]:
    """What in a body's code, nested functions included, reaches past the context.

    A name counts where the code loads it as a global or imports it, or as an attribute of a module; a method of any other object that is called so is none.
    """
    import dis
    import types

    found, queue = set(), [body.__code__]
    while queue:
        code, owner = queue.pop(), None
        for i in dis.get_instructions(code):
            if i.opname in ("LOAD_GLOBAL", "LOAD_NAME", "IMPORT_NAME", "IMPORT_FROM"):
                name = str(i.argval).partition(".")[0]
                owner = body.__globals__.get(name)
                if name in UNSAFE:
                    found.add(f"{name}: {UNSAFE[name]}")
            elif i.opname in ("LOAD_ATTR", "LOAD_METHOD"):
                if isinstance(owner, types.ModuleType) and i.argval in UNSAFE:
                    found.add(f"{i.argval}: {UNSAFE[i.argval]}")
                owner = getattr(owner, str(i.argval), None) if isinstance(owner, types.ModuleType) else None
            else:
                owner = None
        queue += [c for c in code.co_consts if hasattr(c, "co_names")]
    return sorted(found)
