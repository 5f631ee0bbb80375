"""Document quality by a byte-level convolutional network in numpy.

A filter looks at ``WIDTH`` bytes and moves on by ``STRIDE``. The text is cut to chunks that
overlap by ``WIDTH - STRIDE`` bytes, so every place of the whole document is seen by every
filter. The filters' outputs are max-pooled in each chunk; the mean, the maximum and the
minimum of the chunks' pools go through one logistic unit. Fitted on a bounded sample of labelled rows on
the driver (numpy, Adam, a fixed number of steps), applied by Spark tasks to every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm import sample
from runfold.session import ship

WIDTH, STRIDE, FILTERS = 8, 4, 16
#: Filter places in a chunk.
PLACES = 64
#: Bounds of the sample that the network is fitted on: documents a class, and bytes in all.
PER_CLASS, SAMPLE_BYTES = 1500, 8_000_000
STEPS, BATCH = 700, 32


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (3 * FILTERS,)
    shift: float

    def table(self) -> np.ndarray:
        """For each byte of a stride, its share in the filters that begin in this stride and in the one before: (STRIDE, 256, 2 * FILTERS)."""
        return np.ascontiguousarray(np.concatenate((self.filters[:STRIDE], self.filters[STRIDE:]), axis=2))


def strides(text: str) -> np.ndarray:
    """The text's UTF-8 bytes in rows of STRIDE, with zero bytes to whole chunks and one row more."""
    raw = text.encode()
    places = max(1, -(-len(raw) // STRIDE))
    chunks = -(-places // PLACES)
    data = np.zeros((chunks * PLACES + 1) * STRIDE, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return data.reshape(-1, STRIDE)


def pooled(rows: np.ndarray, table: np.ndarray, bias: np.ndarray, where: bool = False):
    """Max-pooled filter outputs of each chunk (chunks, FILTERS), and with ``where`` the places of the maxima."""
    n = len(bias)
    parts, places = [], []
    step = PLACES * 256
    for at in range(0, len(rows) - 1, step):
        x = rows[at : at + step + 1]
        both = table[0].take(x[:, 0], axis=0)
        for k in range(1, STRIDE):
            both += table[k].take(x[:, k], axis=0)
        z = (both[:-1, :n] + both[1:, n:]).reshape(-1, PLACES, n)
        if where:
            places.append(z.argmax(axis=1))
        parts.append(z.max(axis=1))
    pool = np.maximum(np.concatenate(parts) + bias, 0)
    return (pool, np.concatenate(places)) if where else pool


def probability(network: Network, table: np.ndarray, text: str) -> float:
    """Probability of label 1; an empty text is a chunk of zero bytes."""
    pool = pooled(strides(text), table, network.bias)
    return float(1 / (1 + np.exp(-np.clip(np.concatenate((pool.mean(axis=0), pool.max(axis=0), pool.min(axis=0))) @ network.out + network.shift, -30, 30))))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 5) -> Network:
    """The network fitted on ``texts`` with both labels balanced; without both labels it gives 0.5 throughout."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    rows = [strides(t) for t in texts]
    p = {"filters": rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.2, 3 * FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32)}
    if len(set(labels)) < 2:
        return Network(p["filters"], p["bias"], np.zeros(3 * FILTERS, np.float32), 0.0)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    of = [np.flatnonzero(y == c) for c in (0, 1)]
    for t in range(1, steps + 1):
        net = Network(p["filters"], p["bias"], p["out"], 0.0)
        table = net.table()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for c in (0, 1):
            for i in rng.choice(of[c], BATCH // 2):
                pool, at = pooled(rows[i], table, p["bias"], where=True)
                top, low, each = pool.argmax(axis=0), pool.argmin(axis=0), np.arange(FILTERS)
                f = np.concatenate((pool.mean(axis=0), pool[top, each], pool[low, each]))
                d = (1 / (1 + np.exp(-np.clip(f @ p["out"] + p["shift"][0], -30, 30))) - c) / BATCH
                g["out"] += d * f
                g["shift"] += d
                back = np.repeat(d * p["out"][None, :FILTERS] / len(pool), len(pool), axis=0)
                back[top, each] += d * p["out"][FILTERS : 2 * FILTERS]
                back[low, each] += d * p["out"][2 * FILTERS :]
                back[pool <= 0] = 0
                g["bias"] += back.sum(axis=0)
                place = at + np.arange(len(pool))[:, None] * PLACES
                for k in range(WIDTH):
                    byte = rows[i][place + k // STRIDE, k % STRIDE]
                    g["filters"][k] += np.bincount((byte.astype(np.int64) * FILTERS + each).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        rate = 0.02 * min(1, 2 * (1 - t / (steps + 1)))
        for k, v in p.items():
            grad = g[k] + (1e-4 * v if k in ("filters", "out") else 0)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            v -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Network(p["filters"], p["bias"], p["out"], float(p["shift"][0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on at most ``per_class`` documents of each label and ``most_bytes`` bytes of whole texts.

    Documents that would go beyond the bytes left are passed over, in the order of a hash of their ids.
    """
    rows = sample.labelled(docs, labels, "quality", learn, per_class)
    sizes = rows.select(F.xxhash64(F.lit(29), "doc_id").alias("h"), "doc_id", "label", F.octet_length("text").alias("n")).collect()  # 2 * per_class ids
    left, chosen = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for r in sorted(sizes):
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            chosen.append((r.doc_id,))
    ids = rows.sparkSession.createDataFrame(chosen or [(None,)], "doc_id long")
    got = rows.join(F.broadcast(ids.distinct()), "doc_id").orderBy("doc_id", "text").select("text", "label").collect()  # at most most_bytes
    return fit([r.text for r in got], [r.label for r in got])


def flag(docs: DataFrame, network: Network, out: str) -> DataFrame:
    """All columns and rows of ``docs`` with the score added as ``out``; nothing is shuffled."""
    ship(docs.sparkSession)
    score_text = scorer(network)
    return docs.withColumn(out, score_text(F.col("text").cast("string")))


def scorer(network: Network):
    @F.pandas_udf("double")
    def score_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = network.table()
        for texts in batches:
            yield pd.Series([probability(network, table, t or "") for t in texts], dtype="float64")

    return score_text
