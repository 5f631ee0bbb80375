"""Journal relations derived from the driver's tables, and the readers of real ones.

A journal is an append-only log of events, ordered by ``seq`` in each run, with the relations
around it: runs, tasks, effects, leases, signals, deliveries. `Journal` derives all of these
from orders, lineitem, events and conversations, lazily and in column expressions; times are
without zone, ids are text, counts are long.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The instant that queries over orders, and over events, take as now.
NOW, NOW_EVENTS = "2000-01-01 00:00:00", "2024-01-20 00:00:00"
LINE_TYPES = {"l_linenumber": "int", "l_partkey": "long", "l_suppkey": "long", "l_quantity": "double", "l_extendedprice": "double"}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
#: How order priorities name the join of a fan-out.
JOINS = {"1-URGENT": "ANY", "2-HIGH": "QUORUM(2)", "3-MEDIUM": "QUORUM(1)"}
CLASSES = ("NONE", "IDEMPOTENT_BY_KEY", "QUERYABLE", "UNRECONCILABLE")
EFFECT_STATUS = ("PENDING", "RUNNING", "COMMITTED", "FAILED", "UNKNOWN")
#: Lines that one task has at most, about; so a task's memory does not grow with the table.
LINES_A_TASK = 200_000
#: How the ids of runs are made, for each table: a prefix and the stored key.
RUN_KEYS = {"orders": ("R", "o_orderkey"), "lineitem": ("R", "l_orderkey"), "events": ("U", "user_id"), "conversations": ("C", "conv_id")}
STREAM_TYPES = {"signup": "SIGNAL_WAIT_STARTED", "click": "SIGNAL_RECEIVED", "view": "TIMER_SET", "purchase": "TIMER_FIRED", "error": "TASK_FAILED"}


def now(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def choose(value: Column, names: tuple[str, ...] | list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (value % len(names) + 1).cast("int"))


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def by_name(value: Column, names: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out


class Journal:
    """The relations of one data folder, or of one run in it."""

    def __init__(self, spark: SparkSession, sf_dir: str, run: str | None = None):
        self.spark, self.sf_dir, self.run = spark, sf_dir, run

    def only(self, run_id: str) -> Journal:
        """The relations of one run. Its id is turned back into the stored key, so the predicate reaches the scans."""
        return Journal(self.spark, self.sf_dir, run_id)

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key = RUN_KEYS.get(name)
        if self.run is None or key is None:
            return rows
        prefix, column = key
        number = self.run.removeprefix(prefix)
        fits = self.run.startswith(prefix) and number.isdecimal()
        return rows.where(F.col(column) == F.lit(int(number)) if fits else F.lit(False))

    @cached_property
    def parts(self) -> int:
        """Partitions that lines are dealt to by their order, each of about as many rows whatever the table's size. Counting reads no columns."""
        return 1 if self.run is not None else max(1, math.ceil(self.table("lineitem").count() / LINES_A_TASK))

    @cached_property
    def runs(self) -> DataFrame:
        """run_id, agent_name, agent_version, status, version, available_at, created_at, policy."""
        status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING")
        parked = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 60).cast("int")))
        return self.table("orders").select(
            F.concat(F.lit("R"), "o_orderkey").alias("run_id"),
            F.substring("o_orderpriority", 3, 100).alias("agent_name"),
            F.concat(F.lit("v"), F.col("o_orderkey") % 5).alias("agent_version"),
            status.alias("status"),
            (F.col("o_orderkey") % 5).alias("version"),
            parked.alias("available_at"),
            F.col("o_orderdate").alias("created_at"),
            by_name(F.col("o_orderpriority"), JOINS, "ALL").alias("policy"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """lineitem with run_id, child position, step_id and task_id; one shuffle by order."""
        nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
        lines = self.table("lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", "l_linestatus", "l_shipdate").repartition(self.parts, "l_orderkey").withColumn("child", nth.cast("long"))
        run, child = F.concat(F.lit("R"), F.col("l_orderkey")), F.col("child")
        return lines.select("*", run.alias("run_id"), F.concat(F.lit("S1."), child).alias("step_id"), F.concat(F.lit("T"), "l_orderkey", F.lit("."), child).alias("task_id"))

    @cached_property
    def tasks(self) -> DataFrame:
        """task_id, run_id, step_id, task_type, status, priority, available_at, attempt, max_attempts, created_at."""
        return self.tasks_by_run.drop("l_orderkey")

    @cached_property
    def tasks_by_run(self) -> DataFrame:
        """`tasks` with l_orderkey, by which they are dealt over `parts` partitions."""
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        status = F.when(flag == "A", "COMPLETED").when(flag == "R", "DEAD_LETTER").when(line == "O", "PENDING").otherwise("RUNNING")
        return self.lines.select(
            "l_orderkey", "task_id", "run_id", "step_id",
            F.concat(F.lit("tool"), F.col("l_partkey") % 4).alias("task_type"),
            status.alias("status"),
            F.col("l_linenumber").cast("long").alias("priority"),
            F.col("l_shipdate").alias("available_at"),
            (F.col("l_partkey") % 3 + 1).alias("attempt"),
            F.lit(3).cast("long").alias("max_attempts"),
            (F.col("l_shipdate") - minutes(F.col("l_quantity"))).alias("created_at"),
        )

    @cached_property
    def effects(self) -> DataFrame:
        """effect_key, task_id, run_id, effect_type, effect_class, status, created_at, updated_at."""
        return self.effects_by_run.drop("l_orderkey")

    @cached_property
    def effects_by_run(self) -> DataFrame:
        """`effects` with l_orderkey, by which they are dealt."""
        return self.lines.select(
            "l_orderkey", F.concat("run_id", F.lit(":"), "step_id", F.lit(":E1")).alias("effect_key"), "task_id", "run_id",
            F.concat(F.lit("tool"), F.col("l_partkey") % 4).alias("effect_type"),
            choose(F.col("l_partkey"), CLASSES).alias("effect_class"),
            choose(F.col("l_suppkey"), EFFECT_STATUS).alias("status"),
            F.col("l_shipdate").alias("created_at"),
            (F.col("l_shipdate") + minutes(F.col("l_quantity"))).alias("updated_at"),
            choose(F.col("l_quantity").cast("long"), ("COMMITTED", "NOT_EXECUTED", "STILL_UNKNOWN")).alias("answer"),
        )

    @cached_property
    def leases(self) -> DataFrame:
        """task_id, run_id, worker_id, fencing_token, expires_at of the tasks that run."""
        return self.leases_by_run.drop("l_orderkey")

    @cached_property
    def leases_by_run(self) -> DataFrame:
        """`leases` with l_orderkey, by which they are dealt."""
        return self.lines.where("l_returnflag = 'N' and l_linestatus = 'F'").select(
            "l_orderkey", "task_id", "run_id",
            F.concat(F.lit("W"), F.col("l_suppkey") % 16).alias("worker_id"),
            (F.col("l_linenumber") + 1).cast("long").alias("fencing_token"),
            (F.col("l_shipdate") + minutes(F.col("l_quantity"))).alias("expires_at"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """outbox_id, task_id, published_at, available_at, attempts: what is due to be sent for a task."""
        return self.lines.select(
            (F.col("l_orderkey") * 100 + F.col("child")).alias("outbox_id"), "task_id",
            F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("published_at"),
            F.when(F.col("l_partkey") % 2 == 0, F.col("l_shipdate") + minutes(F.col("l_quantity"))).alias("available_at"),
            (F.col("l_partkey") % 4).alias("attempts"),
        )

    @cached_property
    def stream(self) -> DataFrame:
        """run_id, seq, event_type, step_id, created_at, value, event_id, user events as a log of waits and signals."""
        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        return self.table("events").select(
            F.concat(F.lit("U"), "user_id").alias("run_id"), seq.alias("seq"),
            by_name(F.col("event_type"), STREAM_TYPES, "OTHER").alias("event_type"),
            F.concat(F.lit("S"), F.col("event_id") % 3).alias("step_id"),
            F.col("ts").alias("created_at"), "value", "event_id",
        )

    @cached_property
    def signals(self) -> DataFrame:
        """run_id, signal_id, name, created_at, event_id; ids repeat."""
        return self.table("events").select(F.concat(F.lit("U"), "user_id").alias("run_id"), F.concat(F.lit("G"), F.col("event_id") % 5000).alias("signal_id"), F.col("event_type").alias("name"), F.col("ts").alias("created_at"), "event_id")

    @cached_property
    def log(self) -> DataFrame:
        """The journal of orders: run_id, run_key, seq, event_type, step_id, created_at, attempt, final, policy, n_calls.

        RUN_STARTED, FAN_OUT_STARTED with a call for each line, TASK_CREATED for each, then what
        became of each, then RUN_COMPLETED where the run is. Orders and lines meet in one shuffle by
        ``run_key``, the number in run_id; lines are numbered, then every row becomes its events.
        """
        nil = lambda t: F.lit(None).cast(t)
        head = self.table("orders").select(F.col("o_orderkey").alias("run_key"), F.lit(0).alias("line"), *[nil(t).alias(c) for c, t in LINE_TYPES.items()], nil("string").alias("l_returnflag"), nil("string").alias("l_linestatus"), nil("timestamp_ntz").alias("l_shipdate"), "o_orderdate", "o_orderstatus", by_name(F.col("o_orderpriority"), JOINS, "ALL").alias("policy"))
        line = self.table("lineitem").select(F.col("l_orderkey").alias("run_key"), F.lit(1).alias("line"), *LINE_ORDER, "l_returnflag", "l_linestatus", "l_shipdate", nil("timestamp_ntz").alias("o_orderdate"), nil("string").alias("o_orderstatus"), nil("string").alias("policy"))
        run = Window.partitionBy("run_key")
        rows = head.unionByName(line).repartition(self.parts, "run_key").withColumn("child", F.row_number().over(run.orderBy("line", *LINE_ORDER)).cast("long")).withColumn("n_calls", F.sum("line").over(run))
        rows = rows.withColumn("child", F.when(F.col("line") == 1, F.col("child") - F.max(1 - F.col("line")).over(run) - 1).otherwise(0))
        became = F.when(F.col("l_returnflag") == "A", "TASK_COMPLETED").when(F.col("l_returnflag") == "R", "TASK_FAILED").when(F.col("l_linestatus") == "F", "TASK_CLAIMED")
        event = lambda k, kind: F.struct(F.lit(k).alias("k"), kind.alias("event_type"))
        own = F.array(event(0, F.lit("RUN_STARTED")), event(1, F.lit("FAN_OUT_STARTED")), event(4, F.when(F.col("o_orderstatus") == "F", "RUN_COMPLETED")))
        each = F.array(event(2, F.lit("TASK_CREATED")), event(3, became))
        rows = rows.withColumn("e", F.explode(F.filter(F.when(F.col("line") == 1, each).otherwise(own), lambda e: e["event_type"].isNotNull()))).select("*", "e.*")
        fans = F.col("k") == 1
        rows = rows.withColumn("seq", F.row_number().over(run.orderBy("k", "child")).cast("long"))
        return rows.select(
            F.concat(F.lit("R"), "run_key").alias("run_id"), "run_key", "seq", "event_type",
            F.when(F.col("line") == 1, F.concat(F.lit("S1."), "child")).when(fans, "S1").alias("step_id"),
            (F.coalesce("l_shipdate", "o_orderdate") + minutes(F.col("seq"))).alias("created_at"),
            F.when(F.col("line") == 1, F.col("l_partkey") % 3 + 1).alias("attempt"),
            F.when(F.col("event_type") == "TASK_FAILED", F.col("l_partkey") % 4 != 0).alias("final"),
            F.when(fans, F.col("policy")).alias("policy"), F.when(fans, F.col("n_calls")).alias("n_calls"),
        )

    @cached_property
    def dialogue(self) -> DataFrame:
        """Conversations as a log: system starts a run, a user turn is a signal, an assistant turn completes a task."""
        kind = by_name(F.col("role"), {"system": "RUN_STARTED", "user": "SIGNAL_RECEIVED", "assistant": "TASK_COMPLETED"}, "OTHER")
        return self.table("conversations").select(F.concat(F.lit("C"), "conv_id").alias("run_id"), F.col("turn").alias("seq"), kind.alias("event_type"), F.concat(F.lit("S"), F.col("turn")).alias("step_id"), F.md5(F.col("text").cast("binary")).alias("result"))


def from_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 200, **options: str) -> DataFrame:
    """A journal table of a database, read by ``parts`` ranges of a numeric key at once."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_journal(events: DataFrame, path: str) -> None:
    """Append events as Parquet by date, clustered by run so that a run's rows prune to few row groups."""
    dated = events.withColumn("event_date", F.to_date("created_at"))
    dated.repartition("event_date", F.pmod(F.xxhash64("run_id"), F.lit(64))).sortWithinPartitions("event_date", "run_id", "seq").write.mode("append").partitionBy("event_date").parquet(path)


def read_journal(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A journal that `write_journal` wrote; of one run, its predicate reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)
