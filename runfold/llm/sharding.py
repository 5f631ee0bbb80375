"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows of equal text are a group and stay together. Groups are ordered by the digest of
their text; a shard is a run of that order. The largest shard is made as small as such runs
allow: a binary search over capacities, each tried greedily. A group above an even share of the bytes decides
that capacity alone; it has a shard to itself, and the runs before and after it are shared out over the
shards left in the same way, so that the other shards are as even as the order allows.

The order may hold any number of groups, so the search runs over blocks of digests with a
common beginning. Some blocks hold many groups; only those where a cut may fall are split
further, until the cuts fall between single groups. The driver sees block sums alone: at most
``16 ** FIRST`` of them and, per later level, 256 for each block in which a cut may fall.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm import common

#: Hexadecimal digits of the digest in the first blocks, and more at each level.
FIRST, MORE, DIGITS = 3, 2, 32


@dataclass(frozen=True)
class Block:
    """The groups whose digests begin with ``prefix``: their sizes' sum and number."""

    prefix: str
    size: int
    groups: int


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the runs that fill up to ``capacity`` one after the other; None if ``shards`` runs don't do."""
    ends, total = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if total + size > capacity:
            ends.append(i)
            total = 0
            if len(ends) == shards:
                return None
        total += size
    return [*ends, len(sizes)]


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which the greedy runs are at most ``shards``."""
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


@dataclass(frozen=True)
class Run:
    """Blocks from ``start`` up to ``end`` that get ``shards`` shards."""

    start: int
    end: int
    shards: int


def runs_around(blocks: list[Block], shards: int) -> list[Run]:
    """The blocks in runs between the groups that are above an even share of what is left; such a group is a run of one shard.

    Groups are set apart from the largest on while a shard is left for each run between them. The
    shards left are allotted to the runs by the least capacity that they do for, as if blocks of many
    groups could be cut anywhere; those then left over go to the runs of the largest load a shard.
    """
    hot: list[int] = []
    left, size = shards, sum(b.size for b in blocks)
    for i in sorted((i for i, b in enumerate(blocks) if b.groups == 1), key=lambda i: (-blocks[i].size, i)):
        more = sorted([*hot, i])
        spans = [(a + 1, b) for a, b in zip([-1, *more], [*more, len(blocks)], strict=True) if a + 1 < b]
        if blocks[i].size * left <= size or left < 2 or len(spans) + len(more) > shards:
            break
        hot, left, size = more, left - 1, size - blocks[i].size
    spans = [(a + 1, b) for a, b in zip([-1, *hot], [*hot, len(blocks)], strict=True) if a + 1 < b]
    if not hot or not spans:
        return [Run(0, len(blocks), shards)]
    need = lambda a, b, cap: len(reach(blocks[a:b], cap, shards)) + 1
    low = max([1, *(x.size for a, b in spans for x in blocks[a:b] if x.groups == 1)])
    high = max(low, max(sum(x.size for x in blocks[a:b]) for a, b in spans))
    while low < high:
        mid = (low + high) // 2
        if sum(need(a, b, mid) for a, b in spans) > left:
            low = mid + 1
        else:
            high = mid
    given = [need(a, b, low) for a, b in spans]
    loads = [sum(x.size for x in blocks[a:b]) for a, b in spans]
    for _ in range(left - sum(given)):
        at = max(range(len(spans)), key=lambda i: loads[i] / given[i])
        given[at] += 1
    runs = [Run(a, b, n) for (a, b), n in zip(spans, given, strict=True)] + [Run(i, i + 1, 1) for i in hot]
    return sorted(runs, key=lambda r: r.start)


def reach(blocks: list[Block], capacity: int, shards: int) -> list[int]:
    """For each run, the block in which it ends at the latest if groups could be cut at any size in blocks of many groups."""
    ends, total = [], 0
    for i, b in enumerate(blocks):
        left = b.size
        if b.groups == 1 and total + left > capacity:
            ends.append(i)
            total = 0
        while b.groups > 1 and total + left > capacity:
            left -= capacity - total
            ends.append(i)
            total = 0
        total += left
    return ends


def fluid_capacity(blocks: list[Block], shards: int) -> int:
    """A lower bound of the best capacity: blocks of many groups may be cut anywhere."""
    whole = sum(b.size for b in blocks)
    low, high = max([1, *(b.size for b in blocks if b.groups == 1), -(-whole // shards)]), max(1, whole)
    while low < high:
        mid = (low + high) // 2
        if len(reach(blocks, mid, shards)) + 1 > shards:
            low = mid + 1
        else:
            high = mid
    return low


def open_blocks(blocks: list[Block], shards: int) -> set[str]:
    """Blocks of many groups to split next; none once the bounds of the capacity meet.

    The bounds are the capacity needed if blocks could be cut anywhere and the one needed if
    none can be cut. The cuts of either bound tell between which blocks the best cuts are.
    """
    low, high = fluid_capacity(blocks, shards), smallest_capacity([b.size for b in blocks], shards)
    if low >= high:
        return set()
    at_low, at_high = reach(blocks, low, shards), reach(blocks, high, shards)
    at_high += [len(blocks) - 1] * (len(at_low) - len(at_high))
    spans = [(min(x, y), max(x, y)) for x, y in zip(at_low, at_high, strict=False)]
    near = {b.prefix for i, j in spans for b in blocks[i : j + 1] if b.groups > 1}
    return near or {b.prefix for b in blocks if b.groups > 1}


def cut_digests(groups: DataFrame, shards: int) -> list[str]:
    """The digests (or their beginnings) at which shards 1, 2, ... begin; of rows (digest, size)."""
    size_of = [F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("groups")]

    def sums(rows: DataFrame, digits: int) -> list[Block]:
        got = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(*size_of).collect()
        return sorted((Block(r.prefix, r["size"], r.groups) for r in got), key=lambda b: b.prefix)

    blocks = sums(groups, FIRST)
    while split := refine(blocks, shards):
        digits = len(next(iter(split)))
        finer = sums(groups.where(F.substring("digest", 1, digits).isin(sorted(split))), min(DIGITS, digits + MORE))
        blocks = sorted([b for b in blocks if b.prefix not in split] + finer, key=lambda b: b.prefix)
    cuts = []
    for run in runs_around(blocks, shards):
        sizes = [b.size for b in blocks[run.start : run.end]]
        ends = greedy(sizes, smallest_capacity(sizes, run.shards), run.shards) or []
        cuts += [run.start + i for i in ends]
    return [blocks[i].prefix for i in cuts if i < len(blocks)]


def refine(blocks: list[Block], shards: int) -> set[str]:
    """The open blocks of the shortest prefix, as one level is split at a time.

    A block of many groups that is above an even share may hold a group that is; it is split until that shows.
    """
    even = sum(b.size for b in blocks) / shards
    found = open_blocks(blocks, shards) | {b.prefix for b in blocks if b.groups > 1 and b.size > even}
    for run in runs_around(blocks, shards):
        found |= open_blocks(blocks[run.start : run.end], run.shards)
    least = min((len(p) for p in found), default=0)
    return {p for p in found if len(p) == least and least < DIGITS}


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """The number of cuts at or before the digest."""
    return sum((F.when(digest >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of each row of ``docs`` (doc_id, text).

    A row's size is its text's UTF-8 bytes and ``overhead``; a null text counts as an empty
    one. Rows of equal text share a shard, repeated rows too; slots count from 0 in each shard without a gap. Rows with
    a null doc_id are dealt like others. Shards at the end may be empty.
    """
    text = common.text_or_empty(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.utf8_size(text) + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    rows = common.materialize(rows, "rows")
    groups = common.materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    placed = rows.withColumn("shard", shard_of(F.col("digest"), cut_digests(groups, shards)))
    counts = {int(r[0]): int(r[1]) for r in placed.groupBy("shard").count().collect()}  # one row a shard
    ranked = common.gapless_rank(placed.withColumn("__shard", F.col("shard").cast("long")).drop("shard"), "__shard", counts, [F.col("doc_id"), F.col("digest")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
