"""Best-fit packing of tokenized documents into sequences of a fixed length.

Only the histogram of piece lengths decides the packing: at most ``capacity`` numbers, for
any input. So Spark tokenizes and counts, the driver solves the packing on the histogram
(a bounded table), and Spark deals the pieces out to the slots by their gapless rank among
the pieces of the same length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm import common
from runfold.session import ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The separator id that ends each document.
END_ID = 0
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Word (split at ASCII white space) to its token ids as little-endian unsigned 32-bit bytes.

    The tokenizer's own rules never join what white space parts, so a text's ids are its
    words' ids in order, and a word that was met before costs one lookup. A new word of
    ASCII and Latin-1 letters, digits and ASCII signs is split by the tokenizer's pattern
    and its parts go to the tokenizer's model; any other word goes through the whole
    tokenizer. ``limit`` bounds the memory, not the words. All this holds for tokenizer files with the rules that are
    written here; with any other, whole texts go through the tokenizer.
    """

    #: The normalizer and pre-tokenizer of a file whose texts may be split into words, fixed values.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: The tokenizer file's pattern for text of these characters.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+"
    COVERED = r"[!-~À-ÖØ-öø-ÿ]+"

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokens, self.parts, self.covered = self.tokenizer.model.tokenize, re.compile(self.PATTERN).findall, re.compile(self.COVERED).fullmatch
        self.level = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.pieces: dict[str, bytes] = {}
        self.by_word = self.has_rules(json.loads(Path(path).read_text()))

    def has_rules(self, file: dict) -> bool:
        """Whether a tokenizer file has the rules that this class knows."""
        before = file.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers") or [{}]
        split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": self.SPLIT} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
        level = [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
        return (file.get("normalizer") or {}).get("normalizers") == self.NORMALIZERS and split and level and all("<|" in x["content"] for x in file.get("added_tokens", []))

    def piece(self, piece: str) -> bytes:
        if (got := self.pieces.get(piece)) is None:
            chars = piece if piece.isascii() else self.level(piece)[0][0]
            got = self.pieces[piece] = array("I", [t.id for t in self.tokens(chars)]).tobytes()
        return got

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self.covered(word):
            ids = b"".join(map(self.piece, self.parts(word.lower())))
        else:
            ids = self.whole(word)
        self[raw] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or "<|" in text:  # may hold the name of a special token, which has an id of its own
            return self.whole(text)
        if len(self) > self.limit:
            self.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_texts(docs: DataFrame, path: str, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of each document: its ids and the end id, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step, end = encoder(path).encode, 4 * capacity, END_ID.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    ship(docs.sparkSession)
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(cut, PIECES)


class Pattern:
    """Sequences filled alike: ``items`` (length, times) in order, ``repeats`` sequences."""

    def __init__(self, items: list[tuple[int, int]], repeats: int):
        self.items, self.repeats = items, repeats


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Pack counts[length] pieces of each length into sequences of ``capacity``.

    1. Exact complements: from the longest length down, the gap that a piece leaves is looked
       up among the single lengths still available; then, for what is left, among the pair
       sums, then the triple sums. A combination is used as often as its counts allow, which
       exhausts one of its lengths.
    2. What no combination completes goes best-fit decreasing: into the open sequences with
       the smallest gap that holds it, else into new ones.

    Pairs and triples waste nothing but use up small pieces, which are dear where most pieces
    are large: so the search goes up to singles, to pairs and to triples, and of the three
    packings the one with the fewest sequences holds, the deepest of equals.

    Works on counts only, so its cost depends on ``capacity`` and not on the pieces.
    """
    return min((packed(counts, capacity, depth) for depth in (3, 2, 1)), key=lambda patterns: sum(p.repeats for p in patterns))


def packed(counts: dict[int, int], capacity: int, depth: int) -> list[Pattern]:
    """`solve` with combinations of at most ``depth`` pieces to a gap."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, done = Sums(left), []
    for parts in range(depth + 1):
        for length in range(capacity, 0, -1):
            while left[length] and (found := sums.complement(length, capacity - length, parts)) is not None:
                need = Counter((length, *found))
                n = min(int(left[k]) // m for k, m in need.items())
                done.append(Pattern(sorted(need.items(), reverse=True), n))
                for k, m in need.items():
                    left[k] -= n * m
    return done + best_fit([(length, int(left[length])) for length in range(capacity, 0, -1) if left[length]], capacity)


class Sums:
    """Index of the lengths in ``left`` (how many pieces are available of each) by the sums of one, two and three of them.

    The pairs are hashed by their sum once, the most unequal first; a triple's sum is a length and a pair sum. ``left`` only falls,
    so an entry with a length that has run out never comes back: each sum has a place from which its entries
    are looked at, which moves on over them. Memory goes with the square of the number of lengths, at most 2048.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        lengths = np.flatnonzero(left)
        i, j = np.tril_indices(len(lengths))
        large, total = lengths[i], lengths[i] + lengths[j]
        fits = total < len(left)
        large, total = large[fits], total[fits]
        order = np.lexsort((-large, total))
        self.large, self.lengths = large[order], lengths[::-1].tolist()
        self.begin = np.searchsorted(total[order], np.arange(len(left) + 1)).tolist()
        self.end, self.triples = self.begin[1:], {}
        self.begin = self.begin[:-1]

    def complement(self, length: int, gap: int, parts: int) -> tuple[int, ...] | None:
        """``parts`` available lengths that sum to ``gap``, with ``length`` itself in use once; None where there are none."""
        if parts == 0 or gap == 0:
            return () if parts == gap == 0 else None
        if parts == 1:
            return (gap,) if self.enough((length, gap)) else None
        return self.pair(gap, (length,)) if parts == 2 else self.triple(gap, length)

    def enough(self, pieces: tuple[int, ...]) -> bool:
        return all(self.left[k] >= (m if m > 1 else 1) for k, m in Counter(pieces).items())

    def pair(self, total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths of this sum beside those in use."""
        at, end, left = self.begin[total], self.end[total], self.left
        while at < end and not (left[self.large[at]] and left[total - self.large[at]]):
            at += 1
        self.begin[total] = at
        for k in range(at, end):
            large = int(self.large[k])
            if self.enough((*used, large, total - large)):
                return large, total - large
        return None

    def triple(self, total: int, length: int) -> tuple[int, int, int] | None:
        """Three available lengths of this sum beside ``length``, the largest first."""
        if total not in self.triples:
            self.triples[total] = [c for c in self.lengths if c < total - 1 and 3 * c >= total and self.begin[total - c] < self.end[total - c]]
        entries = self.triples[total]
        while entries and not self.left[entries[0]]:
            entries.pop(0)
        for c in entries:
            if self.left[c] and (found := self.pair(total - c, (length, c))):
                return c, *found
        return None


def best_fit(pieces: list[tuple[int, int]], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts. ``pieces``: (length, n) by falling length."""
    groups: dict[int, list[Pattern]] = defaultdict(list)
    for length, n in pieces:
        while n:
            gap = min((g for g in groups if g >= length), default=None)
            if gap is None:
                each = capacity // length
                whole, last = divmod(n, each)
                for times, repeats in ((each, whole), (last, 1)):
                    if times and repeats:
                        groups[capacity - times * length].append(Pattern([(length, times)], repeats))
                break
            group = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
            times = min(gap // length, n)
            repeats = min(group.repeats, n // times)
            if group.repeats > repeats:
                groups[gap].append(Pattern(group.items, group.repeats - repeats))
            groups[gap - times * length].append(Pattern([*group.items, (length, times)], repeats))
            n -= times * repeats
    return [g for gap in sorted(groups) for g in groups[gap]]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Where the pieces of a length go, by rank: rows (length, first rank, sequence, offset, times), sorted."""
    rows, taken, sequence = [], defaultdict(int), 0
    for p in patterns:
        offset = 0
        for length, times in p.items:
            rows.append((length, taken[length], sequence, offset, times))
            taken[length] += times * p.repeats
            offset += length * times
        sequence += p.repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (with doc_id, piece, length up to ``capacity``) and their sequence_id and offset.

    Sequence ids count from 0; offsets in a sequence are gapless from 0. Pieces with equal
    values get different places. No piece, no row. ``pieces`` is read several times: pass a
    materialized table.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = slots(solve(counts, capacity))
    big = max(counts.values(), default=0) + 1
    keys = table[:, 0] * big + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(), rank.to_numpy()
        row = table[np.searchsorted(keys, size * big + nth, side="right") - 1]
        nth = nth - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 4], "offset": row[:, 3] + (nth % row[:, 4]) * size})

    ranked = common.gapless_rank(pieces, "length", counts, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "__nth")
    return ranked.withColumn("__at", place("length", "__nth")).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenize, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows with a null id are packed like others and
    keep the null. Repeated rows are packed each for itself.
    """
    pieces = common.materialize(cut_texts(docs, tokenizer, capacity, id_column, text_column), "pieces")
    return pack(pieces, capacity)
