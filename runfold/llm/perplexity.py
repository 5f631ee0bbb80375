"""Quality rules: counts of words and repeats, and bands of n-gram perplexity.

The language model is modified Kneser-Ney over words, one for each language: bigrams, then words by the number of
different words before them (continuation counts), then a base that spells a word by a modified Kneser-Ney trigram model of
characters. Spark counts all three in every whole document. The word model grows with the input and is never in one place:

1. Tasks count character trigrams; Spark adds them up. Characters are folded to 64
   classes, so a base has at most 64 ** 3 entries, and it alone is sent to every task. A
   language with at least ``SHARE`` of the documents has its own base, the others share one. All else is each language's own, however small its share.
2. Tasks pack the bigrams of many documents of a language, with the documents each is in, into one block for
   each bucket of contexts, and Spark deals the blocks by language and bucket, once. The number of buckets grows with the input.
3. A bucket adds its blocks up into one array of sorted bigram hashes with their counts. It asks for what other buckets
   know as well: how often counts are 1, 2, 3, 4 in the language (the discounts), in how many contexts each of its words
   is, and the sums of contexts that are split. These questions are dealt by word, added up and go back to the buckets. So every
   number is exact for the language, and no verdict depends on the number of buckets.
4. The bucket, read a second time from the same shuffle, scores each bigram of each document where its counts are; what leaves is a
   number for each document and block.

A document is scored as if it were not in the corpus: its own occurrences of a bigram are taken from the
bigram's and the context's count, and a word that follows a context in no other text has one context less. So text that repeats itself or
stands alone is not expected because it was counted. Each distinct text of a language counts once: a row weighs one in so many as
there are rows of its text.

A context with more than a bucket's share is split over several by the hash of the next word. Words and contexts are told apart by
32 bits of a hash each, contexts besides the bits of the bucket.

A document is rejected where the log of its perplexity lies outside its language's band. Above, that
is ``UPPER`` interquartile ranges over the median; below, a ratio to it: the first quartile over the third, to the power
``LOWER``. So the lower side lies where a perplexity can be (above 1), whatever the spread. Median and quartiles are taken
over the distinct texts of the language that pass the base rules.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm import common
from runfold.llm.minhash import runs_of, word_hashes
from runfold.session import ship

CLASSES = 64
SHARE = 0.02
LOWER, UPPER = 4.0, 4.0
#: The least distance of the quartiles, and the least log of their ratio.
LEAST_SPREAD = 0.03
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: The base of the languages without one of their own, and the language of documents that name none.
POOL = ""
#: Bytes of text for each bucket of contexts.
BUCKET_BYTES = 12 << 20
#: Characters of text, and documents, whose bigrams are packed together; fewer than 2 ** 20 words.
CHUNK_CHARS, CHUNK_DOCS = 3_000_000, 30_000
#: Characters of text that wait in a task for their language's chunk to be full.
WAITING_CHARS = 9_000_000
#: Words that are spelled at a time.
SPELLED = 50_000
#: Tables of at most so many texts with copies are sent to every executor.
BROADCAST_COPIES = 1_000_000
#: Bands of at most so many languages are sent to every executor.
BROADCAST_LANGS = 10_000


def hashed_class(cp):
    """The class of a code point (or of each of an array) that is told by its hash."""
    return 35 + (cp * 0x9E3779B1 % (1 << 32) >> 16) % 26


def fold_table() -> np.ndarray:
    """Class of each code point below 0x10000, without regard to A-Z or a-z.

    Letters and marks from 0x250 on are hashed to classes 35 to 60, without regard to case; other code points there are as in ASCII.
    """
    table = np.full(0x10000, 63, np.uint8)
    for cp in range(0x250, 0x10000):
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        table[cp] = 3 if c.isdigit() else 1 if kind == "Z" else 7 if kind in "PS" else hashed_class(ord(c.lower()[0]))
    for cp in range(0x250):
        c = chr(cp)
        if c.isascii() and c.isalpha():
            table[cp] = 9 + ord(c.lower()) - 97
        elif c == "\n":
            table[cp] = 2
        elif c in SPACES:
            table[cp] = 1
        elif c.isdigit():
            table[cp] = 3
        elif c in ".,":
            table[cp] = 4
        elif c in ";:":
            table[cp] = 5
        elif c in "!?":
            table[cp] = 6
        elif c in SYMBOLS:
            table[cp] = 8
        elif cp < 128:
            table[cp] = 7
        elif c.isalpha():
            table[cp] = 61 if c.islower() else 62
    return table


_FOLD = fold_table()


def trigrams(text: str) -> np.ndarray:
    """The packed trigram that ends at each character; the beginning is padded with class 0."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(cp) + 2, np.int32)
    x[2:] = np.where(cp < 0x10000, _FOLD[np.minimum(cp, 0xFFFF)], hashed_class(cp.astype(np.int64)))
    return (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]


def contexts_of(words: np.ndarray, model: str) -> np.ndarray:
    """The hash of the context of each of a document's words: the word before it, in its language; the first has the start."""
    before = np.concatenate((np.zeros(1, np.uint64), words[:-1]))
    return common.mix64(before ^ np.uint64(zlib.crc32(model.encode()) << 20 | 1))


def weighed(docs: DataFrame) -> DataFrame:
    """docs with ``copies``, 1 where they have none."""
    return docs if "copies" in docs.columns else docs.withColumn("copies", F.lit(1).cast("long"))


def with_copies(docs: DataFrame) -> DataFrame:
    """docs (text_key, ...) with ``copies``: how many rows have the text_key."""
    several = common.materialize(docs.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    few = several.count() <= BROADCAST_COPIES
    joined = docs.join(F.broadcast(several) if few else several, "text_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return joined if few else common.materialize(joined, "docs")


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(model, key, n): how often each character trigram is in the distinct texts of each model; docs: (model, text, copies)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            models, copies = batch.column("model").to_pylist(), batch.column("copies").to_pylist()
            parts: dict[tuple[str, int], list[np.ndarray]] = {}
            for model, c, text in zip(models, copies, common.texts(batch), strict=True):
                if text:
                    parts.setdefault((model, c), []).append(trigrams(text))
            for (model, c), keys in parts.items():
                for at in range(0, len(keys), 256):
                    n = np.bincount(np.concatenate(keys[at : at + 256]), minlength=CLASSES**3) / c
                    sums[model] = sums[model] + n if model in sums else n
        for model, n in sums.items():
            key = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"model": pa.array([model] * len(key), pa.string()), "key": pa.array(key.astype(np.int32)), "n": pa.array(n[key])})

    return weighed(docs).select("model", "text", "copies").mapInArrow(count, "model string, key int, n double").groupBy("model", "key").agg(F.round(F.sum("n")).cast("long").alias("n"))


@dataclass
class Model:
    """Log-probabilities by sorted n-gram hash; ``back`` holds a context's log of what is left for shorter ones."""

    tri: np.ndarray
    tri_logp: np.ndarray
    ctx: np.ndarray
    ctx_back: np.ndarray
    bi: np.ndarray
    bi_logp: np.ndarray
    uni_back: np.ndarray
    uni_logp: np.ndarray

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of the last class of each packed trigram after the two before it."""
        at = np.minimum(np.searchsorted(self.tri, keys), len(self.tri) - 1)
        out = self.tri_logp[at].astype(np.float64)
        miss = np.flatnonzero(self.tri[at] != keys)
        if len(miss):
            k = keys[miss]
            ctx, pair = k // CLASSES, k % CLASSES**2
            c = np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)
            back = np.where(self.ctx[c] == ctx, self.ctx_back[c], 0.0)
            b = np.minimum(np.searchsorted(self.bi, pair), len(self.bi) - 1)
            shorter = np.where(self.bi[b] == pair, self.bi_logp[b], self.uni_back[pair // CLASSES] + self.uni_logp[pair % CLASSES])
            out[miss] = back + shorter
        return out

    def spelling(self, words: list[str]) -> np.ndarray:
        """Log-probability of the spelling of each word and of the space that ends it, after a comma and a space."""
        sizes = np.array([len(w) + 1 for w in words])  # the space is the word's, the comma and the space after it are not
        begins = 2 + np.cumsum(sizes + 2) - (sizes + 2)
        logp = self.logp(trigrams(", " + " , ".join(words) + " , "))
        return np.add.reduceat(logp, np.column_stack((begins, begins + sizes)).ravel())[::2]


def discounts(counts: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from counts of 0, 1, 2, and 3 or more."""
    return discounts_of(*(float((counts == i).sum()) for i in range(1, 5)))


def discounts_of(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """The same from how many counts are 1, 2, 3 and 4."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 / n3 if n3 else 0)]
    return np.array([0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))])


def level(context: np.ndarray, counts: np.ndarray, shorter: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities of n-grams with ``counts``, and the weight that each context leaves to shorter ones."""
    d = discounts(counts)[np.minimum(counts, 3)]
    total = np.bincount(context, counts, size)
    left = np.bincount(context, d, size) / np.maximum(total, 1)
    return (counts - d) / total[context] + left[context] * shorter, np.where(total > 0, left, 1.0)


def fit(keys: np.ndarray, counts: np.ndarray) -> Model:
    """The model of trigram counts; keys sorted and distinct."""
    pair = keys % CLASSES**2
    bi, bi_n = np.unique(pair, return_counts=True)  # in how many contexts: the continuation count
    uni_n = np.bincount(bi % CLASSES, minlength=CLASSES)
    some = np.flatnonzero(uni_n)
    p1, rest = level(np.zeros(len(some), np.int64), uni_n[some], np.full(len(some), 1 / CLASSES), 1)
    uni = np.full(CLASSES, rest[0] / CLASSES)
    uni[some] = p1
    p2, left2 = level(bi // CLASSES, bi_n, uni[bi % CLASSES], CLASSES)
    p3, left3 = level(keys // CLASSES, counts, p2[np.searchsorted(bi, pair)], CLASSES**2)
    ctx = np.unique(keys // CLASSES)
    f = np.float32
    return Model(keys, np.log(p3).astype(f), ctx, np.log(left3[ctx]).astype(f), bi, np.log(p2).astype(f), np.log(left2).astype(f), np.log(uni).astype(f))


def models_of(docs: DataFrame) -> dict[str, Model]:
    """The spelling model of each value of ``model`` in docs (model, text, copies)."""
    rows = count_trigrams(docs).toPandas()  # at most (1 / SHARE + 1) * 64 ** 3 rows, see above
    found = {}
    for model, part in rows.groupby("model"):
        part = part.sort_values("key")
        found[model] = fit(part["key"].to_numpy(np.int64), part["n"].to_numpy(np.int64))
    return found


#: Into how many buckets a frequent context is split, by its hash.
Heavy = dict[int, int]


def frequent_contexts(docs: DataFrame) -> Heavy:
    """The contexts with more than a bucket's share of their language's words, over how many buckets each is split; docs: (model, buckets, text, copies).

    This decides only where a context is counted. In each batch those are looked at that may have the share, so all that have it are
    found; there are fewer than four for each bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[tuple[str, int], list[np.ndarray]] = {}
            for model, buckets, text in zip(batch.column("model").to_pylist(), batch.column("buckets").to_pylist(), common.texts(batch), strict=True):
                if buckets > 1 and len(h := word_hashes(text)):
                    of.setdefault((model, buckets), []).append(contexts_of(h, model))
            for (model, buckets), found in of.items():
                every = np.concatenate(found)
                key, n = np.unique(every, return_counts=True)
                key, n = key[n * 4 * buckets > len(every)], n[n * 4 * buckets > len(every)]
                yield pa.RecordBatch.from_pydict({"model": pa.array([model] * (len(key) + 1), pa.string()), "key": pa.array([*key.view(np.int64).tolist(), None], pa.int64()), "n": pa.array([*n.tolist(), len(every)], pa.int64()), "buckets": pa.array([buckets] * (len(key) + 1), pa.int64())})

    sums = docs.select("model", "buckets", "text").where("buckets > 1").mapInArrow(count, "model string, key long, n long, buckets long").groupBy("model", "key").agg(F.sum("n").alias("n"), F.max("buckets").alias("buckets"))
    sums = common.materialize(sums, "frequent")
    words = sums.where("key is null").select("model", F.col("n").alias("words"))
    parts = F.least(F.ceil(F.col("n") * F.col("buckets") / F.col("words")), F.col("buckets")).alias("parts")
    hot = sums.where("key is not null").join(words, "model").where(2 * F.col("n") * F.col("buckets") > F.col("words")).select("key", parts).where("parts > 1")
    return {r.key % (1 << 64): int(r.parts) for r in hot.collect()}


BLOCKS = "model string, bucket long, chunk long, block binary, ids binary"
#: The arrays of a block: per word that follows, the difference of its hash from the one before and its base's log-probability in steps; per bigram the difference of its code (32 bits of the context, then the word's place) from the one before and its number of documents; per bigram and document the document's place and the count; per document the difference of its place in the chunk from the one before and how many copies it has besides itself.
BLOCK = (np.uint64, np.uint8, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32)
#: Log-probabilities of spellings are rounded to this.
STEP = 0.25
PLACE = np.uint64(20)
WORD_BITS, CONTEXT_BITS = np.uint64(32), np.uint64(32)


def bigram_blocks(docs: DataFrame, models: dict[str, Model], heavy: Heavy) -> DataFrame:
    """Step 2: rows (model, bucket, chunk, block, ids); docs: (row_key, model, buckets, text, copies). The ids of a chunk are in one of its blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[tuple[str, int], list[tuple[int, str, int]]] = {}
        chars: Counter[tuple[str, int]] = Counter()
        for batch in common.small_batches(batches):
            for row_key, model, buckets, text, copies in zip(*(batch.column(c).to_pylist() for c in ("row_key", "model", "buckets")), common.texts(batch), batch.column("copies").to_pylist(), strict=True):
                of = (model, buckets)
                chunks.setdefault(of, []).append((row_key, text, copies))
                chars[of] += len(text) + 1
                if chars[of] >= CHUNK_CHARS or len(chunks[of]) >= CHUNK_DOCS:
                    chars.pop(of)
                    yield from packed(of, chunks.pop(of))
                elif chars.total() >= WAITING_CHARS:
                    of = max(chars, key=chars.__getitem__)
                    chars.pop(of)
                    yield from packed(of, chunks.pop(of))
        while chunks:
            yield from packed(*chunks.popitem())

    def packed(of: tuple[str, int], rows: list[tuple[int, str, int]]) -> Iterator[pa.RecordBatch]:
        model, buckets = of
        parts = list(chunk_blocks(rows, model, models[model if model in models else POOL], buckets, heavy))
        if parts:
            ids = np.array([r[0] for r in rows], np.int64).tobytes()
            number = int.from_bytes(hashlib.blake2b(ids, digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_pydict({"model": [model] * len(parts), "bucket": pa.array([b for b, _ in parts], pa.int64()), "chunk": pa.array([number] * len(parts), pa.int64()), "block": pa.array([x for _, x in parts], pa.binary()), "ids": pa.array([ids] + [None] * (len(parts) - 1), pa.binary())})

    return docs.select("row_key", "model", "buckets", "text", "copies").mapInArrow(pack, BLOCKS)


def chunk_blocks(rows: list[tuple[int, str, int]], name: str, model: Model, buckets: int, heavy: Heavy) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of documents (row_key, text, copies) of one language."""
    hashes, spelled = [], []
    for _, text, _ in rows:
        hashes.append(word_hashes(text))
        if len(hashes[-1]):
            spelled += text.encode().lower().split()
    sizes = [len(h) for h in hashes]
    if not sum(sizes):
        return
    contexts = np.concatenate([contexts_of(h, name) for h in hashes if len(h)])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    words, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    hashes.clear()
    base = np.concatenate([-model.spelling([spelled[i].decode() for i in first[at : at + SPELLED]]) / STEP for at in range(0, len(first), SPELLED)])
    base = np.minimum(base, 255).round().astype(np.uint8)
    spelled.clear()
    words >>= np.uint64(64) - WORD_BITS
    bucket = ((contexts & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    if heavy and buckets > 1:
        keys = np.sort(np.fromiter(heavy, np.uint64, len(heavy)))
        parts = np.array([heavy[int(k)] for k in keys], np.int64)
        at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == contexts)
        bucket[hit] = (bucket[hit] + words[which[hit]].astype(np.int64) % parts[at[hit]]) % buckets
    key = (contexts >> (np.uint64(64) - CONTEXT_BITS) << PLACE) | which.astype(np.uint64)
    del contexts
    # stable: the documents of a bigram stay in order
    order = np.argsort(key, kind="stable") if buckets == 1 else np.lexsort((key, bucket.astype(np.uint16) if buckets < 1 << 16 else bucket))
    key, doc, bucket = key[order], doc[order], bucket[order]
    del order
    other = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))
    new = np.flatnonzero(other | np.concatenate(([True], doc[1:] != doc[:-1])))
    count = np.diff(np.append(new, len(key)))
    key, doc, bucket, other = key[new], doc[new], bucket[new], other[new]
    more = np.array([r[2] for r in rows], np.int64) - 1
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        head = np.flatnonzero(other[a:b])
        code = key[a:b][head]
        next_, place = np.unique(code & np.uint64((1 << int(PLACE)) - 1), return_inverse=True)
        next_ = next_.astype(np.int64)
        here, local = np.unique(doc[a:b], return_inverse=True)
        code = (code >> PLACE << PLACE) | place.astype(np.uint64)
        arrays = (np.diff(words[next_], prepend=np.uint64(0)), base[next_], np.diff(code, prepend=np.uint64(0)), np.diff(np.append(head, b - a)), local, count[a:b], np.diff(here, prepend=0), more[here])
        yield int(bucket[a]), packed_arrays(arrays)


def packed_arrays(arrays: tuple[np.ndarray, ...]) -> bytes:
    """The arrays compressed, each byte of their numbers by itself; bytes that are all zero take no place."""
    planes = [plane for x, t in zip(arrays, BLOCK, strict=True) for plane in x.astype(t).view(np.uint8).reshape(len(x), -1).T]
    data = [zstandard.compress(plane.tobytes(), 1) if plane.any() else b"" for plane in planes]
    return np.array([*(len(arrays[i]) for i in (0, 2, 4, 6)), *map(len, data)], np.uint32).tobytes() + b"".join(data)


def unpacked(block: bytes, only: tuple[int, ...] | range = range(len(BLOCK))) -> list[np.ndarray]:
    """The arrays of a block that ``only`` names; differences are summed up again."""
    types = [np.dtype(t) for t in BLOCK]
    head = np.frombuffer(block, np.uint32, 4 + sum(t.itemsize for t in types)).astype(np.int64)
    rows = np.repeat(head[:4], 2)
    ends, plane, out = 4 * len(head) + np.cumsum(head[4:]), 0, []
    for i, t in enumerate(types):
        if i in only:
            x = np.zeros((t.itemsize, rows[i]), np.uint8)
            for j in range(t.itemsize):
                if size := head[4 + plane + j]:
                    x[j] = np.frombuffer(zstandard.decompress(block[ends[plane + j] - size : ends[plane + j]]), np.uint8)
            x = np.ascontiguousarray(x.T).view(t).ravel()
            out.append(np.cumsum(x, dtype=t) if i in (0, 2, 6) else x)
        plane += t.itemsize
    return out


class Bucket:
    """The blocks of a bucket added up: ``words`` that follow (sorted) with their ``base``, bigrams as sorted codes (context, place of the word) and their counts ``n``; ``at``: the bigram of each of the blocks' bigrams in turn."""

    def __init__(self, blocks: list[bytes]):
        parts, self.ends = [], []
        for block in blocks:
            words, base, code, docs_of, doc, count, _, more = unpacked(block)
            weight = np.add.reduceat(count / (1.0 + more)[doc], np.cumsum(docs_of, dtype=np.int64) - docs_of)
            parts.append((words, base, code, weight))
            self.ends.append(len(code))
        self.ends = np.cumsum(self.ends)
        words = np.concatenate([x[0] for x in parts])
        self.words, first, place = np.unique(words, return_index=True, return_inverse=True)
        self.base = np.concatenate([x[1] for x in parts])[first]
        low, begin, codes = np.uint64((1 << int(PLACE)) - 1), 0, []
        for x in parts:
            of = place[begin : begin + len(x[0])].astype(np.uint64)
            begin += len(x[0])
            codes.append((x[2] >> PLACE << CONTEXT_BITS) | of[(x[2] & low).astype(np.int64)])
        code, weight = np.concatenate(codes), np.concatenate([x[3] for x in parts])
        del parts, codes
        order = np.argsort(code, kind="stable")
        code = code[order]
        new = np.concatenate(([True], code[1:] != code[:-1]))
        self.at = np.empty(len(code), np.int32)
        self.at[order] = np.cumsum(new, dtype=np.int32) - 1
        self.n = np.maximum(np.rint(np.add.reduceat(weight[order], np.flatnonzero(new))).astype(np.int64), 1)  # whole, as copies meet
        self.code = code[new]
        self.word = (self.code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        context = self.code >> CONTEXT_BITS
        self.of = np.cumsum(np.concatenate(([False], context[1:] != context[:-1])))
        self.contexts = context[np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))]

    def sums(self) -> np.ndarray:
        """Per context its total and how many of its bigrams have the counts 1, 2, and more."""
        return np.stack([np.bincount(self.of, self.n), *(np.bincount(self.of, x) for x in (self.n == 1, self.n == 2, self.n > 2))], axis=1).astype(np.int64)


QUESTIONS = "model string, part long, bucket long, words binary, followed binary, contexts binary, sums binary, counts binary"


def counted(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4, and how many there are."""
    return np.array([*((n == i).sum() for i in range(1, 5)), len(n)], np.int64)


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers of 0 or more, each byte of them by itself and compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(len(x), 8).T).tobytes(), 1)


def numbers(data: bytes) -> np.ndarray:
    x = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel()


def questions(name: str, number: int, bucket: Bucket, parts: int, split: np.ndarray) -> Iterator[tuple]:
    """Step 3: what a bucket has of numbers that others have as well, one row for each part of the words; contexts and counts are in part 0."""
    of = (bucket.words % np.uint64(parts)).astype(np.int64)
    followed = np.bincount(bucket.word, minlength=len(bucket.words))
    shared = np.flatnonzero(np.isin(bucket.contexts, split))
    for part in range(parts):
        mine = of == part
        first = part == 0
        yield name, part, number, packed_numbers(np.diff(bucket.words[mine], prepend=np.uint64(0))), packed_numbers(followed[mine]), bucket.contexts[shared].tobytes() if first else b"", bucket.sums()[shared].tobytes() if first else b"", counted(bucket.n).tobytes() if first else b""


def answers(rows: list[dict]) -> Iterator[tuple]:
    """The questions of a part added up, a row for each bucket that asked; ``counts`` has those of words in this part, then in part 0 those of bigrams."""

    def added(key: list[np.ndarray], value: list[np.ndarray], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        every, place = np.unique(np.concatenate(key), return_inverse=True)
        total = np.zeros((len(every), width), np.int64)
        np.add.at(total, place, np.concatenate(value))
        ends = np.cumsum([len(k) for k in key])
        return total, [total[place[a:b]] for a, b in zip(ends - [len(k) for k in key], ends, strict=True)]

    words, followed = added([np.cumsum(numbers(r["words"]), dtype=np.uint64) for r in rows], [numbers(r["followed"]).astype(np.int64)[:, None] for r in rows], 1)
    _, sums = added([np.frombuffer(r["contexts"], np.uint64) for r in rows], [np.frombuffer(r["sums"], np.int64).reshape(-1, 4) for r in rows], 4)
    counts = counted(words.ravel()).tobytes()
    if rows[0]["part"] == 0:
        counts += sum(np.frombuffer(r["counts"], np.int64) for r in rows).tobytes()
    for r, n, whole in zip(rows, followed, sums, strict=True):
        yield r["model"], r["part"], r["bucket"], b"", packed_numbers(n.ravel()), r["contexts"], whole.tobytes(), counts  # the bucket knows its words


def bucket_scores(blocks: list[bytes], told: list[dict]) -> Iterator[tuple[bytes, bytes]]:
    """Step 4 for a bucket: per block the differences of its documents' places and the sums of their words' log-probabilities."""
    bucket = Bucket(blocks)
    parts, followed = len(told), np.zeros(len(bucket.words), np.int64)
    of = bucket.words % np.uint64(parts)
    for t in told:
        followed[of == np.uint64(t["part"])] = numbers(t["followed"]).astype(np.int64)
    word_counts = sum(np.frombuffer(t["counts"], np.int64)[:5] for t in told)
    zero = next(t for t in told if t["part"] == 0)
    bigram_counts = np.frombuffer(zero["counts"], np.int64)[5:]
    sums = bucket.sums()
    shared, whole = np.frombuffer(zero["contexts"], np.uint64), np.frombuffer(zero["sums"], np.int64).reshape(-1, 4)
    sums[np.searchsorted(bucket.contexts, shared)] = whole
    d1, d2 = discounts_of(*word_counts[:4]), discounts_of(*bigram_counts[:4])
    kinds, m = int(bigram_counts[4]), word_counts
    left1 = (d1[1] * m[0] + d1[2] * m[1] + d1[3] * (m[4] - m[0] - m[1])) / kinds
    spelled = left1 * np.exp(-STEP * bucket.base.astype(np.float64))
    known = lambda n: (n - d1[np.minimum(n, 3)]) / kinds + spelled
    p1, p1_less = known(followed), known(np.maximum(followed - 1, 0))
    total, left2 = sums[:, 0], sums[:, 1:] @ d2[1:]
    del followed, of
    for block, a, b in zip(blocks, np.append(0, bucket.ends[:-1]), bucket.ends, strict=True):
        docs_of, doc, count, here = unpacked(block, range(3, 7))
        at = np.repeat(bucket.at[a:b], docs_of)
        own = bucket.n[at] - count
        np.maximum(own, 0, out=own)
        context, word = bucket.of[at], bucket.word[at]
        rest = np.maximum(total[context] - count, 0)
        shorter = np.where(own > 0, p1[word], p1_less[word])
        some = np.maximum(rest, 1)
        p = np.where(rest > 0, (own - d2[np.minimum(own, 3)]) / some + np.minimum(left2[context] / some, 1.0) * shorter, shorter)
        scored = np.bincount(doc, np.log(np.maximum(p, 1e-300)) * count, len(here))
        yield np.diff(here.astype(np.int64), prepend=0).astype(np.uint32).tobytes(), scored.astype(np.float32).tobytes()


SCORED = "chunk long, ids binary, places binary, sums binary"


def rows_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def word_scores(blocks: DataFrame, buckets: dict[str, int], heavy: Heavy) -> DataFrame:
    """(row_key, total): the sum of the log-probabilities of each document's words.

    The blocks are shuffled once: their buckets are read for the questions and again for the scores from the same exchange.
    """
    spark = blocks.sparkSession
    tasks = max(common.shuffle_parts(spark), 2 * sum(buckets.values()))
    split = np.array(sorted({k >> (64 - int(CONTEXT_BITS)) for k in heavy}), np.uint64)
    parts = {m: max(1, n // 8) for m, n in buckets.items()}
    key = ["model", "bucket"]
    dealt = blocks.repartition(tasks, *key)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, ("model", "bucket")):
            name, number = rows[0]["model"], rows[0]["bucket"]
            found = Bucket([r["block"] for r in rows])
            rows.clear()
            yield rows_batch(list(questions(name, number, found, parts[name], split)), QUESTIONS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, ("model", "part")):
            yield rows_batch(list(answers(rows)), QUESTIONS)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        given = list(zip(*(left.column(c).to_pylist() for c in ("chunk", "block", "ids")), strict=True))
        found = bucket_scores([g[1] for g in given], right.to_pylist())
        return pa.Table.from_batches([rows_batch([(g[0], g[2], places, sums) for g, (places, sums) in zip(given, found, strict=True)], SCORED)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, ("chunk",)):
            ids = np.frombuffer(next(r["ids"] for r in rows if r["ids"] is not None), np.int64)
            total, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for r in rows:
                places = np.cumsum(np.frombuffer(r["places"], np.uint32), dtype=np.int64)
                total[places] += np.frombuffer(r["sums"], np.float32)
                seen[places] = True
            yield pa.RecordBatch.from_pydict({"row_key": pa.array(ids[seen]), "total": pa.array(total[seen])})

    asked = dealt.sortWithinPartitions(*key).mapInArrow(ask, QUESTIONS).repartition(tasks, "model", "part")
    told = asked.sortWithinPartitions("model", "part").mapInArrow(answer, QUESTIONS)
    scored = dealt.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(score, SCORED)
    sums = scored.repartition(common.shuffle_parts(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(add, "row_key long, total double")
    return sums.groupBy("row_key").agg(F.avg("total").alias("total"))  # repeated rows have equal sums


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = word_hashes(text, lower=False)
    covered = 0
    if len(words) > 3:
        windows = common.mix64(common.mix64(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:])
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mark = np.zeros(len(words), bool)
        for i in range(3):
            mark[i : i + len(windows)] |= twice
        covered = int(mark.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered


MEASURED = "row_key long, text_key long, doc_id long, model string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def measure(docs: DataFrame, least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """Base counts of each row of docs (row_key, text_key, doc_id, model, text)."""
    types = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in MEASURED.split(", "))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            rows = []
            for row_key, text_key, doc_id, model, text in zip(*(batch.column(c).to_pylist() for c in ("row_key", "text_key", "doc_id", "model")), common.texts(batch), strict=True):
                n = base_counts(text)
                rows.append((row_key, text_key, doc_id, model, *n, n[0] < least_words or 100 * n[4] > most_repeat * n[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("row_key", "text_key", "doc_id", "model", "text").mapInArrow(apply, MEASURED)


def quality_rules(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, share: float = SHARE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Base counts, base_failed, kept, perplexity (of a character) and its band for each row of ``docs`` (doc_id, text, lang).

    A null text has no words and fails the base rules; texts without a word have no perplexity. A
    lang with less than ``share`` of the documents uses the pooled spelling base, and nothing else of other langs; a
    null lang is the empty one. Repeated rows are judged alike. Rows are joined with their scores by a 64-bit hash of id and text.
    ``bucket_bytes`` changes memory and shuffles, no result.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(POOL)).alias("model"))
    langs = docs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    langs = common.materialize(langs.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.coalesce("bytes", F.lit(0)) / bucket_bytes)).cast("long")), "langs")
    total = langs.agg(F.sum("n")).first()[0]
    own = [r.model for r in langs.where((F.col("model") != POOL) & (F.col("n") >= share * (total or 0))).collect()]  # at most 1 / share
    buckets = {r.model: r.buckets for r in langs.select("model", "buckets").collect()}  # two short values a language
    few = langs.count() <= BROADCAST_LANGS
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "model", "text")).withColumn("text_key", F.xxhash64("model", "text"))
    docs = with_copies(docs)
    sizes = langs.select("model", "buckets")
    dealt = docs.join(F.broadcast(sizes) if few else sizes, "model")
    heavy = frequent_contexts(dealt)
    bases = models_of(docs.withColumn("model", F.when(F.col("model").isin(own), F.col("model")).otherwise(F.lit(POOL))))
    scores = common.materialize(word_scores(bigram_blocks(dealt, bases, heavy), buckets, heavy), "scores")
    log_ppl = F.round(-F.col("total") / (F.col("word_chars") + F.col("n_words")), 7)
    measured = common.materialize(measure(docs).join(scores, "row_key", "left").withColumn("log_ppl", log_ppl).drop("row_key", "total"), "measured")
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    distinct = measured.where(~F.col("base_failed")).groupBy("model", "text_key").agg(F.min("log_ppl").alias("log_ppl"))
    quart = distinct.groupBy("model").agg(q.alias("q")).where("q is not null")
    first, median, third = (F.greatest(F.col("q")[i], F.lit(1e-9)) for i in range(3))
    wide, ratio = F.greatest(third - first, F.lit(LEAST_SPREAD)), F.greatest(F.log(third / first), F.lit(LEAST_SPREAD))
    bands = quart.select("model", (median * F.exp(-lower * ratio)).alias("__low"), (median + upper * wide).alias("__high"))
    rows = measured.join(F.broadcast(bands) if few else bands, "model", "left")  # one row a language
    inside = F.coalesce(F.col("log_ppl").between(F.col("__low"), F.col("__high")), F.lit(True))
    return rows.select(*[c for c in measured.columns if c not in ("model", "text_key", "log_ppl")], (~F.col("base_failed") & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"), F.exp("__low").alias("lower_band"), F.exp("__high").alias("upper_band"), F.col("model").alias("language_model"))
