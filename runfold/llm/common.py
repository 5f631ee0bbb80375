"""What the training-data operators share: the scratch area, gapless ranks and text batches.

Every operator picks the columns it needs by name as its first step, so further columns of
the input, whatever they are called, cannot clash with the operator's own.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runfold.session import ship

#: ASCII white space that ends a word: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary one is made, set
    for the session and removed at exit; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="runfold-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows of a few numbers for a task, where their count is known.
ROWS_A_TASK = 200_000


def tasks_for(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_A_TASK))


def materialize(df: DataFrame, what: str, rows: int | None = None, level: int = 3) -> DataFrame:
    """``df`` written as a table in the shared folder and read back; where at most so many ``rows`` are to come, by no more tasks than these need.

    This cuts the lineage: a lost executor costs only the tasks it was running, and what was
    computed once is not computed again. The table has known file sizes, so the planner sees
    how large it is.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, what)
    if rows is not None:
        df = df.coalesce(tasks_for(rows))
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def drop(*written: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once nothing that is still to be computed reads them."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def utf8_size(column: Column) -> Column:
    return F.octet_length(column).cast("long")


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def gapless_rank(df: DataFrame, key: str, counts: dict[int, int], order: list[Column], out: str) -> DataFrame:
    """``df`` with a rank per ``key``, gapless from 0, without gathering a key in one task.

    counts: rows per key; the caller has them already, and their number is bounded. ``df`` is read twice and must be a
    written table, whose rows keep their numbers. A key with many rows is split by a hash of ``order`` and the row's number, so that no window partition has more than
    a small share of a task's even load; ranks inside a part are shifted by the parts before
    it. The parts number at most ``len(counts)`` plus four for each shuffle partition.
    """
    spark = df.sparkSession
    goal = max(1, sum(counts.values()) // (4 * shuffle_parts(spark)))
    sizes = [(int(k), math.ceil(n / goal)) for k, n in counts.items() if n] or [(0, 1)]
    parts = spark.createDataFrame(sizes, f"`{key}` long, __parts long")
    keyed = df.join(F.broadcast(parts), key).withColumn("__part", F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.col("__parts"))).drop("__parts")
    filled = sorted(tuple(r) for r in keyed.groupBy(key, "__part").count().collect())
    shifts, key_now, total = [], None, 0
    for k, part, n in filled:
        total = total if k == key_now else 0
        key_now = k
        shifts.append((k, part, total))
        total += n
    shift = spark.createDataFrame(shifts or [(0, 0, 0)], f"`{key}` long, __part long, __shift long")
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(shift), [key, "__part"]).withColumn(out, F.col("__rank") + F.col("__shift")).drop("__part", "__rank", "__shift")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the rows before in ``order``, which must be total.

    Rows are parted by ranges of the order; what leaves a range is one row of totals, so no task sees more than its range.
    """
    spark = df.sparkSession
    placed = df.withColumns({f"__v_{n}": c for n, c in sums.items()}).repartitionByRange(shuffle_parts(spark), *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ranged")
    shifts, now = [], [0] * len(sums)
    for row in placed.groupBy("__part").agg(*[F.sum(f"__v_{n}").alias(n) for n in sums]).orderBy("__part").collect():
        shifts.append((row["__part"], *map(float, now)))
        now = [a + b for a, b in zip(now, row[1:], strict=True)]
    shift = spark.createDataFrame(shifts or [(0, *[0.0] * len(sums))], "__part int, " + ", ".join(f"`__s_{n}` double" for n in sums))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"__b_{n}": F.coalesce(F.sum(f"__v_{n}").over(before).cast("double"), F.lit(0.0)) for n in sums}).join(F.broadcast(shift), "__part")
    return out.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__s_{n}")).alias(n) for n in sums])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str) -> list[bytes]:
    """The words, split at ASCII white space only (bytes.split knows no other)."""
    return text.encode().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers (xor-shift and odd multipliers)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
