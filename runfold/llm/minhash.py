"""Near-duplicate groups by MinHash.

1. Each document's set of word shingles gives many universal hash minima and a digest.
   Documents with equal sets are one class from here on.
2. Bands of minima put classes into buckets. Every class meets one member of each of
   its buckets (the centre), so a bucket of m classes costs m - 1 candidates. Of these, the
   centre met in most bands is looked at first: its minima, then its full set.
3. Links become components by alternating large-star and small-star.
4. Buckets that still hold several components are compared completely, as far as the sizes of
   the sets allow the similarity, in blocks of classes and on their minima alone (two bytes each). A pair of different components whose minima agree
   often enough is emitted in its first common bucket, so once, and its full sets are compared.

Texts are read only for classes in a pair that its minima leave, and each goes to one task a
pair; a centre's text goes out once for each ``STAR`` members. At the usual setting (32 bands of 5)
a pair at the threshold of 0.8 shares no band with probability 3e-6, and its minima agree too
rarely with less than ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm import common
from runfold.session import ship

BANDS, ROWS = 32, 5
#: Classes and shingles in a block of step 4 (16 classes at least), and members of a centre that share one copy of it.
BLOCK, SHINGLES, STAR = 1024, 2_000_000, 256
#: Probability that a pair at the threshold is lost to the comparison of minima.
MISS = 1e-6
#: So many ids, or rows of three numbers, at most are sent to every executor.
BROADCAST_IDS = 200_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(1).integers(1, 1 << 64, 256, np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of ``text``, in order; A-Z lower-cased."""
    data = np.frombuffer(text.encode(), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(inside) > 1)))
    begin = np.repeat(inside[first], np.diff(np.append(first, len(inside))))
    place = inside - begin
    if place[-1] < 64 and place.max() < 64:
        power = _POWERS[place]
    else:  # a word of more than 64 bytes
        power = common.mix64(place.astype(np.uint64)) | np.uint64(1)
        power[place < 64] = _POWERS[place[place < 64]]
    return common.mix64(np.add.reduceat(_BYTES[data[inside]] * power, first))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of all words where there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(k, len(words))
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = common.mix64(h * np.uint64(0xA0761D6478BD642F) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def universal(bands: int, rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, bands * rows, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each hash (a * x + b) over the set, its upper quarter as uint16."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (a[:, None] * shingles[None, at : at + 1024] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set) and minima (16 bits each)."""
    a, b = universal(bands, rows)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("minima", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                s = shingle_set(text, k)
                out.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), minima(s, a, b).tobytes()) if len(s) else (doc_id, 0, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return picked(docs).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, minima binary")


def picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_keys(bands: int, rows: int) -> Column:
    """The buckets of a signature: for each band a hash of its minima, with the band's number in the last bits."""
    low = (1 << max(1, (bands - 1).bit_length())) - 1
    return F.array(*[F.xxhash64(F.substring("minima", 2 * rows * i + 1, 2 * rows)).bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(i).cast("long")) for i in range(bands)])


def least_matches(n: int, percent: int, miss: float = MISS) -> int:
    """How many of ``n`` minima a pair at the threshold has in common at least, but for a probability of ``miss``."""
    p, below = percent / 100, 0.0
    for matches in range(n + 1):
        below += math.comb(n, matches) * p**matches * (1 - p) ** (n - matches)
        if below > miss:
            return matches
    return n


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity: 100 * intersection >= percent * union."""
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    joined = np.concatenate((x, y))
    joined.sort(kind="stable")
    inter = int((joined[1:] == joined[:-1]).sum())
    return 100 * inter >= percent * (both - inter)


def confirm(pairs: DataFrame, payload: DataFrame, prepare: Callable[[Any], Any], passes: Callable[[Any, Any], bool]) -> DataFrame:
    """The pairs (a, b) with a payload of a that passes with one of b.

    payload: (id, data); an id may have several. Each a's payload goes to its b's; a b
    with many pairs is split, and each part of about ``STAR`` has a copy of b's payload. A task holds b's
    and one other payload at a time.
    """
    spark = pairs.sparkSession
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    dealt = common.materialize(pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")), "dealt")
    few = dealt.count() <= BROADCAST_IDS
    send = F.broadcast if few else (lambda x: x)
    members = payload.join(send(dealt), payload["id"] == dealt["a"]).select("b", "part", "a", "data")
    centres = dealt.select("b", "part").distinct()
    centres = payload.join(send(centres), payload["id"] == centres["b"]).select("b", "part", F.lit(None).cast("long").alias("a"), "data")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in common.small_batches(batches):
            found = []
            for b, part, a, data in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "a", "data")), strict=True):
                if now != (b, part):
                    now, held = (b, part), []
                if a is None:
                    held.append(prepare(data))
                elif found[-1:] != [(a, b)]:
                    one = prepare(data)
                    if any(passes(one, x) for x in held):
                        found.append((a, b))
            yield pairs_batch(found)

    rows = centres.unionByName(members).repartition(common.shuffle_parts(spark), "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return rows.mapInArrow(check, "a long, b long").distinct()


def alike_minima(pairs: DataFrame, banded: DataFrame, percent: int) -> DataFrame:
    """The pairs whose minima agree often enough; banded: (rep, minima)."""
    return confirm(pairs, banded.select(F.col("rep").alias("id"), F.col("minima").alias("data")), lambda m: np.frombuffer(m, np.uint16), lambda x, y: np.count_nonzero(x == y) >= least_matches(len(x), percent))


def alike_texts(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are linked; texts: (id, data)."""
    return confirm(pairs, texts, lambda text: shingle_set(text or "", k), lambda x, y: alike(x, y, percent))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star: rows (node, component), component the least node.

    edges: (a, b), any direction, repeats and loops allowed. Nodes without a link to another have no row. Each
    round is written to the shared folder, and the round before it is dropped; rounds go on until nothing changes, which takes
    of the order of the square of the log of the nodes. A node with very many links is no hot task: its
    least neighbour is found with map-side aggregation, and the join that passes it on is
    split by adaptive execution (``spark.sql.adaptive.skewJoin.enabled``, on by default), which this needs.
    """
    now = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before, n = None, 2 * now.count()  # rounds add no rows: each edge gives one or none
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", n)
        large = common.materialize(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", n)
        lower = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least", n)
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", n)
        common.drop(now, least, large, lower)
        now = after
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def size_base(percent: int) -> float:
    return max(math.log(100 / percent), 1e-3) * (1 + 1e-9)


def size_class(n: Column, percent: int) -> Column:
    """Classes of set sizes such that two sets of the similarity are in one class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / size_base(percent)).cast("int")


def inside_blocks(members: DataFrame, main: DataFrame, percent: int, bands: int) -> DataFrame:
    """Step 4: the classes with a partner in each block of a bucket: rows (bucket, i, j, rep, component, minima, block).

    members: (bucket, rep, component, n_shingles, minima); main: (bucket, main), its largest component.
    A bucket is parted by `size_class` and by whether a class is of the main component, and each part into blocks.
    Blocks meet those of the same and of the neighbouring size classes, but main ones do not meet each other. A class goes
    to as many tasks as there are blocks that it meets, with its minima only.
    """
    room = lambda part: F.least(F.lit(float(BLOCK)), F.greatest(F.lit(16.0), SHINGLES / F.exp((F.floor(part / 2) + 1) * size_base(percent))))
    blocks = lambda part, n: F.ceil(n / room(part)).cast("int")
    placed = members.join(main, "bucket").withColumn("part", 2 * size_class(F.col("n_shingles"), percent) + (F.col("component") == F.col("main")).cast("int")).drop("main")
    parts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    placed = placed.join(parts, "bucket")
    number = lambda part, block: part.cast("long") * F.lit(1 << 32) + block
    own = F.filter("parts", lambda p: p["part"] == F.col("part"))[0]["n"]
    near = lambda p: F.abs(F.floor(p["part"] / 2) - F.floor(F.col("part") / 2)) <= 1
    met = F.filter("parts", lambda p: near(p) & ((p["part"] % 2 == 0) | (F.col("part") % 2 == 0)) & ((p["part"] != F.col("part")) | (p["n"] > 1)))
    others = F.flatten(F.transform(met, lambda p: F.transform(F.sequence(F.lit(0), blocks(p["part"], p["n"]) - 1), lambda k: number(p["part"], k))))
    placed = placed.withColumn("block", number(F.col("part"), F.pmod(F.xxhash64("rep"), blocks(F.col("part"), own))))
    dealt = placed.select("bucket", "rep", "component", "minima", "block", F.explode(others).alias("other"))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", "minima", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, CELL):
            some = sorted({n for x, ys in partners(rows, percent, bands) for n in (x, *ys)})
            if some:
                yield pa.RecordBatch.from_pylist([rows[n] for n in some], PARTNERS)

    # dealt by block as well: a hot bucket's blocks go to many tasks
    return dealt.repartition(common.shuffle_parts(members.sparkSession), *CELL).sortWithinPartitions(*CELL).mapInArrow(compare, "bucket long, i long, j long, rep long, component long, minima binary, block long")


CELL = ("bucket", "i", "j")
PARTNERS = pa.schema([("bucket", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("rep", pa.int64()), ("component", pa.int64()), ("minima", pa.binary()), ("block", pa.int64())])


def partner_links(found: DataFrame, texts: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """Links (a, b) between components, no more than connect them in a block; found: rows of `inside_blocks`, texts: (id, data)."""
    reps = common.materialize(found.select(F.col("rep").alias("id")).distinct(), "reps")
    texts = texts.join(F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps, "id", "left_semi")
    joined = found.join(texts, found["rep"] == texts["id"]).drop("id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, CELL):
            links = block_links(rows, k, percent, bands)
            if links:
                yield pairs_batch(links)

    return joined.repartition(common.shuffle_parts(found.sparkSession), *CELL).sortWithinPartitions(*CELL).mapInArrow(compare, "a long, b long")


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def runs_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of sorted batches in runs of equal keys, also where a run goes on in the next batch."""
    run: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for row in batch.slice(at, 1024).to_pylist():
                if run and any(row[k] != run[0][k] for k in keys):
                    yield run
                    run = []
                run.append(row)
    if run:
        yield run


def partners(rows: list[dict], percent: int, bands: int) -> Iterator[tuple[int, list[int]]]:
    """Between two blocks of a bucket, for each row those of other components whose minima agree often enough, the nearest first.

    A pair that shares several bands is looked at in the first one's bucket alone: both its
    classes are there, and with them in different components that bucket is open too.
    """
    m = np.stack([np.frombuffer(r["minima"], np.uint16) for r in rows])
    block, component = (np.array([r[c] for r in rows], np.int64) for c in ("block", "component"))
    i, j, band = rows[0]["i"], rows[0]["j"], rows[0]["bucket"] & ((1 << max(1, (bands - 1).bit_length())) - 1)
    low = least_matches(m.shape[1], percent)
    xs, ys = np.flatnonzero(block == i), np.flatnonzero(block == j)
    right, theirs = m[ys], component[ys]
    for x in xs:
        equal = right == m[x]
        same = np.count_nonzero(equal, axis=1)
        good = (same >= low) & (theirs != component[x])
        if i == j:
            good &= ys > x
        hit = np.flatnonzero(good)
        if len(hit):
            first = equal[hit].reshape(len(hit), bands, -1).all(axis=2).argmax(axis=1)
            hit = hit[first == band]
            if len(hit):
                yield int(x), ys[hit[np.argsort(-same[hit], kind="stable")]].tolist()


def block_links(rows: list[dict], k: int, percent: int, bands: int) -> list[tuple[int, int]]:
    """Links between the components of two blocks, confirmed on full sets, no more than connect them."""
    head: dict[int, int] = {}

    def root(c: int) -> int:
        while c in head:
            c = head[c]
        return c

    sets: dict[int, np.ndarray] = {}

    def of(n: int) -> np.ndarray:
        if n not in sets:
            sets[n] = shingle_set(rows[n]["data"] or "", k)
        return sets[n]

    links = []
    for x, ys in partners(rows, percent, bands):
        for y in ys:
            a, b = root(rows[x]["component"]), root(rows[y]["component"])
            if a != b and alike(of(x), of(y), percent):
                head[b] = a
                links.append((rows[x]["rep"], rows[y]["rep"]))
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id linked with it, over any number of links, itself
    included. Documents without a word (or text) are linked with nothing. Rows that share a
    doc_id count as one document with the links of all their texts. A row with a null doc_id takes its copies' component and is
    kept only where it has none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    signed = common.materialize(signatures(docs, k, bands, rows), "signed")
    some = signed.where("digest is not null and doc_id is not null")
    classes = common.materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    key = F.xxhash64("digest")
    repeated = common.materialize(some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("__low"), F.max(key).alias("__high")).where("n > 1").select("doc_id", (F.col("__low") != F.col("__high")).alias("differ")), "repeated")
    n_classes, n_repeated = classes.count(), repeated.count()
    sent = lambda rows, n: F.broadcast(rows) if n <= BROADCAST_IDS else rows
    banded = some.select("digest", F.col("doc_id").alias("rep"), "n_shingles", "minima").join(sent(classes, n_classes), ["digest", "rep"])
    banded = common.materialize((banded.dropDuplicates(["digest", "rep"]) if n_repeated else banded).select("rep", "n_shingles", "minima"), "banded")
    buckets = banded.select("rep", F.explode(bucket_keys(bands, rows)).alias("bucket"))
    # the class whose id differs from the bucket's hash least is its centre
    mask = F.xxhash64("bucket")
    centres = buckets.groupBy("bucket").agg(F.min(F.col("rep").bitwiseXOR(mask)).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centres = common.materialize(centres.select("bucket", F.col("c").bitwiseXOR(mask).alias("centre")), "centres")
    shared = common.materialize(buckets.join(centres, "bucket"), "shared")
    # the centre met in most bands, for each class
    met = shared.where("rep <> centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("n"))
    first = met.groupBy("rep").agg(F.max(F.struct("n", "centre")).alias("best")).select(F.col("rep").alias("a"), F.col("best.centre").alias("b"))
    texts = picked(docs).select(F.col("doc_id").alias("id"), F.col("text").alias("data")).where("id is not null")
    if n_repeated:
        more = repeated.select(F.col("doc_id").alias("id"))
        texts = texts.join(sent(more, n_repeated), "id", "left_anti").unionByName(texts.join(sent(more, n_repeated), "id", "left_semi").dropDuplicates())
    likely = common.materialize(alike_minima(first, banded, percent), "likely")
    links = common.materialize(alike_texts(likely, texts, k, percent), "confirmed")
    # the texts of a document belong together
    same = some.join(sent(repeated.where("differ").select("doc_id"), n_repeated), "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.unionByName(common.materialize(same, "same")) if n_repeated else links
    found = common.materialize(components(links), "components")
    labelled = shared.select("bucket", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = common.materialize(labelled, "labelled")
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"))
    open_ = common.materialize(sizes.where("n > m.n").select("bucket", F.col("m.component").alias("main")), "open")
    members = labelled.join(open_.select("bucket"), "bucket")
    reps = common.materialize(members.select("rep").distinct(), "reps")
    members = members.join(banded.join(sent(reps, reps.count()), "rep"), "rep")
    rest = common.materialize(inside_blocks(members, open_, percent, bands), "rest")
    common.drop(banded, centres, shared, labelled, open_, reps, likely)
    if not rest.isEmpty():
        more = common.materialize(partner_links(rest, texts, k, percent, bands), "confirmed")
        if not more.isEmpty():
            found = common.materialize(components(links.unionByName(more)), "components")
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    named = common.materialize(named, "named")
    full = signed.where("digest is not null").select("doc_id", "n_shingles", "digest").join(named, "digest", "left").drop("digest")
    none = signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return full.select("doc_id", "n_shingles", "component_id").unionByName(none).withColumn("kept", kept)
