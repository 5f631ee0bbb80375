"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A source at ``r`` times its size gets ``floor(r)`` whole
copies of every document for certain; the rest of the target is a fixed-size sample with
inclusion probabilities in proportion to a document's size. Documents whose probability
would reach 1 are certain too; the others are ranked by Pareto's order, their random odds
divided by their inclusion odds, and the first ones are taken until the sample has the
words that are still due.

All of it is DataFrame work: no source is gathered in a task. The order is cut by counting
words in narrow bands of the ranking key first and ranking rows only inside the one band
where a source's sample ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runfold.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
#: More sources than this are joined by a salted shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Bands of the ranking key for each source.
BANDS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """From rows (source, size): one row a source with source_size and target.

    Sources by code point, null last, weigh ``weights``, repeating. Targets share the sum of
    all sizes by weight but stop at ``most`` times a source's size, and the excess is shared
    again by weight: with the sources ordered by most * size / weight, those up to some place
    are at their limit and the others share what is left at one common level.
    """
    table = common.materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    by_name = [F.col("source").isNull(), F.col("source")]
    nth = F.pmod(F.col("__nth").cast("long"), F.lit(len(weights))) + 1
    table = common.running(table, by_name, {"__nth": F.lit(1)}).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int")))
    table = table.withColumn("__limit", F.lit(float(most)) * F.col("source_size"))
    at = F.col("__limit") / F.col("weight")
    table = common.running(table, [at, *by_name], {"__used": F.col("__limit"), "__weighed": F.col("weight")})
    words, weighed = table.agg(F.sum("source_size"), F.sum("weight")).first()
    table = table.withColumn("__level", (F.lit(words or 0) - F.col("__used")) / (F.lit(weighed or 0.0) - F.col("__weighed")))
    # the level holds from the first source whose limit it does not reach; before that, sources are at their limit
    reached = table.where(F.col("__level") * F.col("weight") <= F.col("__limit")).agg(F.min_by("__level", at)).first()[0]
    target = F.least(F.col("__limit"), F.coalesce(F.lit(reached).cast("double") * F.col("weight"), F.col("__limit")))
    return table.select("source", "source_size", target.alias("target"))


def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of their ``source`` (null fits null); a hot source does not gather in a task."""
    table = table.withColumnRenamed("source", "__source")
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("__source")) & (rows["source"].isNull() == salted["__source"].isNull()) & (F.col("__salt") == salted["__salt"])).drop("__source", "__salt")


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: int = 17) -> DataFrame:
    """From rows (doc_id, source, size, key): doc_id, size, source_size, target, copies and taken.

    ``key`` (any string, such as a digest of the text) tells apart rows that share a doc_id;
    rows equal in all four are exchangeable. No row has more than ``most`` copies; size 0 takes nothing. Equal
    inputs give equal results. ``rows`` is read several times: pass a materialized table.
    """
    table = common.materialize(source_targets(rows, weights, float(most)), "sources")
    # the copies all documents get, and the words still due, in whole words
    table = table.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long"))
    table = table.withColumn("due", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size")))
    # inclusion probability theta * size; the largest sizes, while theta * size reaches 1, are certain
    by_size = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    larger = Window.partitionBy("source").orderBy(F.col("size").desc())
    every = Window.partitionBy("source")
    sizes = with_source(by_size, table)
    words, squares = F.col("size") * F.col("n"), F.col("size").cast("double") * F.col("size") * F.col("n")
    above, above2 = F.sum(words).over(larger) - words, F.sum(squares).over(larger) - squares
    theta = (F.col("due") - above) / (F.sum(squares).over(every) - above2)
    sizes = sizes.withColumn("__theta", theta).withColumn("__certain", F.col("__theta") * F.col("size") >= 1)
    fit = sizes.groupBy("source").agg(F.max(F.when(~F.col("__certain"), F.struct("size", "__theta"))).alias("fit"), F.sum(F.when(F.col("__certain"), words)).alias("sure"))
    table = common.materialize(
        table.join(fit.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
        .select("source", "source_size", "target", "base", F.coalesce("fit.size", F.lit(0)).alias("largest"), F.coalesce("fit.__theta", F.lit(0.0)).alias("theta"), (F.col("due") - F.coalesce("sure", F.lit(0))).alias("due")),
        "thetas",
    )
    rows = with_source(rows, table)
    chance = F.col("theta") * F.col("size")
    u = common.unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("key", F.lit("")), seed=seed)
    odds = (u / (F.lit(1.0) - u)) / (chance / (F.lit(1.0) - chance))
    drawn = (F.col("size") > 0) & (F.col("size") <= F.col("largest")) & (chance > 0) & (chance < 1)
    # the odds' own order, from 0 to 1
    rows = rows.withColumn("__q", F.when(drawn, odds / (F.lit(1.0) + odds))).withColumn("__band", F.when(drawn, F.floor(F.col("__q") * BANDS).cast("int")))
    rows = common.materialize(rows.withColumn("__certain", (F.col("size") > F.col("largest")) & (F.col("base") < most) & (F.col("due") > -0.5)), "ranked")
    in_order = Window.partitionBy("source").orderBy("__band")
    bands = rows.where("__band is not null").groupBy("source", "__band", "due").agg(F.sum("size").alias("words"))
    bands = bands.withColumn("through", F.sum("words").over(in_order))
    cut = bands.where("through >= due").groupBy("source").agg(F.min(F.struct("__band", (F.col("through") - F.col("words")).alias("before"))).alias("cut"))
    cut = cut.select("source", F.col("cut.__band").alias("cut_band"), F.col("cut.before").alias("before"))
    missing = table.select("source").join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", F.coalesce("cut_band", F.lit(BANDS + 1)).alias("cut_band"), F.coalesce("before", F.lit(0)).alias("before"))
    rows = with_source(rows, common.materialize(missing, "cuts"))
    # inside the band where the sample ends, the row at which the words come nearest is the last one taken
    nth = Window.partitionBy("source", "__band").orderBy("__q", "doc_id", "key")
    at_cut = rows.where(F.col("__band") == F.col("cut_band")).withColumn("__through", F.col("before") + F.sum("size").over(nth.rowsBetween(Window.unboundedPreceding, 0)))
    at_cut = at_cut.withColumn("__more", F.col("__through") - F.col("size") / 2.0 <= F.col("due")).drop("__through")
    others = rows.where(F.col("__band").isNull() | (F.col("__band") != F.col("cut_band"))).withColumn("__more", F.col("__certain") | F.coalesce(F.col("__band") < F.col("cut_band"), F.lit(False)))
    decided = common.materialize(others.unionByName(at_cut).drop("cut_band", "before").withColumn("__row", F.monotonically_increasing_id()), "decided")
    decided = fit_last(decided)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("__more").cast("long")).otherwise(F.lit(0).cast("long"))
    return decided.withColumn("copies", copies).select("doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def fit_last(rows: DataFrame) -> DataFrame:
    """Change the choice of one drawn document of a source where this brings its words nearer to what is due.

    A source of few documents can miss its target by half its largest document; of the changes that
    are best, the document first in order is taken, and of rows that are equal in all, one. So one document a source may
    depart from Pareto order. rows: a written table, in which ``__row`` numbers the rows.
    """
    drawn = rows.where("__band is not null")
    gaps = common.materialize(drawn.groupBy("source", "due").agg(F.sum(F.when(F.col("__more"), F.col("size")).otherwise(0)).alias("words")).select("source", (F.col("due") - F.col("words")).alias("gap")), "gaps")
    change = F.when(F.col("__more"), -F.col("size")).otherwise(F.col("size"))
    miss = F.abs(F.col("gap") - change)
    best = with_source(drawn, gaps).where(miss < F.abs("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), F.col("__q").alias("q"), F.col("doc_id").alias("id"), F.col("key").alias("k"), F.col("__row").alias("row"))).alias("best"))
    every = common.materialize(rows.select("source").distinct().join(best.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "best"), "best")
    flip = F.col("__row") == F.col("best.row")
    return with_source(rows, every).withColumn("__more", F.when(F.coalesce(flip, F.lit(False)), ~F.col("__more")).otherwise(F.col("__more")))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: int = 17) -> DataFrame:
    """`mix` of documents (doc_id, text, source), sizes in words.

    Null ids, sources (a source of its own, last) and texts (size 0) are allowed. An empty table gives no rows.
    """
    return mix(common.materialize(sized(docs), "sized"), weights, most, seed)


def sized(docs: DataFrame) -> DataFrame:
    """documents as rows (doc_id, source, size, key): size in words, null text 0."""
    text = common.text_or_empty("text")
    size = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(text.cast("binary")).alias("key"))


def oracle(weights: tuple[float, ...] = WEIGHTS, most: int = 3, seed: int = 17) -> str:
    """`mix_documents` in DuckDB SQL over the view ``documents``."""
    order = "source IS NULL, source"
    same = "IS NOT DISTINCT FROM"
    weight = f"[{', '.join(f'{float(w)}::DOUBLE' for w in weights)}]"
    return f"""
WITH s AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size, md5(coalesce(text, '')) AS key FROM documents),
t0 AS (SELECT *, {float(most)}::DOUBLE * source_size AS lim FROM (SELECT source, source_size, {weight}[(row_number() OVER (ORDER BY {order}) - 1) % {len(weights)} + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1))),
t1 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0::DOUBLE)) AS level FROM t0 WINDOW b AS (ORDER BY lim / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t2 AS (SELECT source, source_size, least(lim, coalesce(l * weight, lim)) AS target FROM t1, (SELECT arg_min(level, lim / weight) AS l FROM t1 WHERE level * weight <= lim)),
t3 AS (SELECT *, greatest(0::DOUBLE, target - base * source_size) AS due FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE)::BIGINT ELSE 0 END AS base FROM t2)),
z AS (SELECT *, size::DOUBLE * size * n AS sq FROM (SELECT source, size, count(*) AS n FROM s WHERE size > 0 GROUP BY ALL)),
z1 AS (SELECT z.source, size, n, (due - (sum(size * n) OVER l - size * n)) / (sum(sq) OVER (PARTITION BY z.source) - (sum(sq) OVER l - sq)) AS theta FROM z JOIN t3 ON z.source {same} t3.source WINDOW l AS (PARTITION BY z.source ORDER BY size DESC)),
fit AS (SELECT source, max(size) FILTER (theta * size < 1) AS largest, arg_max(theta, size) FILTER (theta * size < 1) AS theta, sum(size * n) FILTER (theta * size >= 1) AS sure FROM z1 GROUP BY 1),
t AS (SELECT t3.source, source_size, target, base, coalesce(largest, 0) AS largest, coalesce(theta, 0::DOUBLE) AS theta, due - coalesce(sure, 0) AS due FROM t3 LEFT JOIN fit ON t3.source {same} fit.source),
c AS (SELECT s.doc_id, s.source, s.size, s.key, t.* EXCLUDE (source), theta * size AS chance, ((('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), key)), 1, 12))::BIGINT)::DOUBLE + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE AS u FROM s JOIN t ON s.source {same} t.source),
q AS (SELECT *, CASE WHEN drawn THEN o / (1::DOUBLE + o) END AS q, NOT drawn AND size > largest AND base < {most} AND due > -0.5::DOUBLE AS certain FROM (SELECT *, size > 0 AND size <= largest AND chance > 0 AND chance < 1 AS drawn, CASE WHEN size > 0 AND size <= largest AND chance > 0 AND chance < 1 THEN (u / (1::DOUBLE - u)) / (chance / (1::DOUBLE - chance)) END AS o FROM c)),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY floor(q * {BANDS})) AS through_band, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, key ROWS UNBOUNDED PRECEDING) AS through FROM q WHERE drawn),
cut AS (SELECT source, min(floor(q * {BANDS})) FILTER (through_band >= due) AS band FROM p GROUP BY 1),
d AS (SELECT p.*, row_number() OVER (PARTITION BY p.source, q, doc_id, key) AS twin, CASE WHEN floor(q * {BANDS}) < coalesce(band, {BANDS + 1}) THEN true WHEN floor(q * {BANDS}) = band THEN through - size / 2.0::DOUBLE <= due ELSE false END AS more FROM p JOIN cut ON p.source {same} cut.source),
g AS (SELECT source, any_value(due) - sum(CASE WHEN more THEN size ELSE 0 END) AS gap FROM d GROUP BY 1),
m AS (SELECT d.*, gap, abs(gap - CASE WHEN more THEN -size ELSE size END) AS miss FROM d JOIN g ON d.source {same} g.source),
b AS (SELECT source, q, doc_id, key, twin FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss, q, doc_id NULLS FIRST, key, twin) AS n FROM m WHERE miss < abs(gap)) WHERE n = 1),
f AS (SELECT d.doc_id, d.source, d.key, d.size, d.source_size, d.target, d.base, CASE WHEN b.q IS NULL THEN more ELSE NOT more END AS more FROM d LEFT JOIN b ON d.source {same} b.source AND d.q = b.q AND d.doc_id {same} b.doc_id AND d.key = b.key AND d.twin = b.twin
  UNION ALL SELECT doc_id, source, key, size, source_size, target, base, certain FROM q WHERE NOT drawn)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN base + more::BIGINT ELSE 0 END * size AS taken, source, CASE WHEN size > 0 THEN base + more::BIGINT ELSE 0 END AS copies FROM f"""
