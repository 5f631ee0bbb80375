"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM, stored as WAVE bytes.

mu-law and A-law samples are expanded by tables of 256 entries. ADPCM blocks of a file are
decoded side by side: the steps inside a block depend on each other, so numpy runs over the
places of a block once and over all blocks at each place. Decoded PCM is resampled and
stored as 16-bit WAVE.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm import common
from runfold.session import ship

#: WAVE format tags, fixed values.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
#: ADPCM blocks that are decoded together at most.
BLOCKS_AT_ONCE = 1 << 15
#: IMA ADPCM index changes by the low three bits, fixed values.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def step_sizes() -> np.ndarray:
    """The 89 IMA step sizes: each a tenth more than the last, by the format's integer rule."""
    # fixed values
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


STEPS = step_sizes()


def mulaw_table() -> np.ndarray:
    """The 16-bit value of each mu-law code (G.711): inverted bits, sign, exponent, mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit value of each A-law code (G.711): even bits inverted, sign set for positive values."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    value = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def wave(tag: int, data: bytes, rate: int = 8000, bits: int = 8, block: int = 1, extra: bytes = b"") -> bytes:
    """A one-channel WAVE file; chunks are padded to even length."""
    per_second = rate * block if tag != IMA_ADPCM else rate * block // max(1, block * 2 - 7)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + (b"" if tag == PCM else struct.pack("<H", len(extra)) + extra)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block size, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no audio data")


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """IMA ADPCM of one channel: blocks of a 4-byte head (first sample, index, 0) and two samples a byte, low half first."""
    whole = len(data) // block
    if not whole:
        return np.zeros(0, np.int16)
    if whole > BLOCKS_AT_ONCE:
        step = BLOCKS_AT_ONCE * block
        return np.concatenate([decode_adpcm(data[at : at + step], block) for at in range(0, whole * block, step)])
    rows = np.frombuffer(data, np.uint8, whole * block).reshape(whole, block)
    value = rows[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.clip(rows[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((whole, 2 * (block - 4)), np.int32)
    codes[:, 0::2], codes[:, 1::2] = rows[:, 4:] & 15, rows[:, 4:] >> 4
    out = np.empty((whole, codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[1]):
        code, step = codes[:, i], STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[code & 7], 0, 88)
        out[:, i + 1] = value
    return out.ravel()


def encode_adpcm(samples: np.ndarray, block: int = 256) -> bytes:
    """The inverse of `decode_adpcm` as near as the format allows, blocks side by side; the last block repeats the last sample."""
    each = 2 * (block - 4) + 1
    blocks = max(1, -(-len(samples) // each))
    x = np.zeros(blocks * each, np.int32)
    x[: len(samples)] = samples
    x[len(samples) :] = samples[-1] if len(samples) else 0
    x = x.reshape(blocks, each)
    value, index = x[:, 0].copy(), np.zeros(blocks, np.int32)
    codes = np.empty((blocks, each - 1), np.uint8)
    for i in range(1, each):
        step, left = STEPS[index], x[:, i] - value
        sign, left = np.where(left < 0, 8, 0), np.abs(left)
        code, change = np.zeros(blocks, np.int32), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = left >= part
            code, change, left = np.where(on, code | bit, code), np.where(on, change + part, change), np.where(on, left - part, left)
        value = np.clip(np.where(sign, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_MOVE[code], 0, 88)
        codes[:, i - 1] = code | sign
    out = np.zeros((blocks, block), np.uint8)
    out[:, :2] = x[:, 0].astype("<i2").view(np.uint8).reshape(-1, 2)
    out[:, 4:] = codes[:, 0::2] | (codes[:, 1::2] << 4)
    return out.tobytes()


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAVE file in one of the four formats."""
    tag, rate, block, data = read_wave(media)
    if tag == MULAW:
        return MULAW_TABLE[np.frombuffer(data, np.uint8)], rate
    if tag == ALAW:
        return ALAW_TABLE[np.frombuffer(data, np.uint8)], rate
    if tag == IMA_ADPCM:
        return decode_adpcm(data, block), rate
    if tag == PCM:
        return np.frombuffer(data, "<i2", len(data) // 2), rate
    raise ValueError(f"WAVE format {tag} is not a telephony format")


def decode_many(files: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """`decode` of each file; the ADPCM blocks of all of them are decoded side by side."""
    read = [read_wave(f) for f in files]
    out = [None if r[0] == IMA_ADPCM else decode(f) for r, f in zip(read, files, strict=True)]
    for block in {r[2] for r in read if r[0] == IMA_ADPCM}:
        of = [n for n, r in enumerate(read) if r[0] == IMA_ADPCM and r[2] == block]
        whole = [len(read[n][3]) // block for n in of]
        samples = decode_adpcm(b"".join(read[n][3][: w * block] for n, w in zip(of, whole, strict=True)), block)
        parts = np.split(samples, np.cumsum(whole)[:-1] * (2 * (block - 4) + 1))
        for n, part in zip(of, parts, strict=True):
            out[n] = (part, read[n][1])
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; the last sample holds to the end."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = -(-len(samples) * to // rate)
    if to == 2 * rate:
        wide = samples.astype(np.int32)
        out = np.empty(n, np.int16)
        out[0::2] = samples
        out[1::2][:-1] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    return np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples).round().astype(np.int16)


def to_pcm(media: bytes, to: int = 16000) -> bytes:
    """The file decoded, resampled and stored as 16-bit PCM."""
    return pcm_wave(*decode(media), to)


def pcm_wave(samples: np.ndarray, rate: int, to: int) -> bytes:
    return wave(PCM, resample(samples, rate, to).astype("<i2").tobytes(), to, 16, 2)


def pcm_column(rows: DataFrame, media: str = "media", out: str = "pcm", to: int = 16000) -> DataFrame:
    """``rows`` with the media column decoded and resampled to a PCM WAVE column.

    Null media give null; bytes that are no telephony WAVE file give null too. All rows and
    columns stay; a column named ``out`` is replaced.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def convert(column):
        def one(x):
            try:
                return None if x is None else to_pcm(bytes(x), to)
            except (ValueError, struct.error):
                return None

        return column.map(one).astype(object).where(column.notna(), None)

    return rows.withColumn(out, convert(F.col(media)))


def payload_of(text: str, unit: int = 64) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zero bytes up to a positive multiple of ``unit``, and their number without these."""
    raw = text.encode()
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


#: What 8-bit companded audio is expanded to, in ascending order.
COMPANDED = (np.unique(MULAW_TABLE), np.unique(ALAW_TABLE))
#: How hard the tables of media are compressed.
LEVEL = 12


def midpoints(even: np.ndarray) -> np.ndarray:
    """What linear interpolation puts after each sample at twice the rate; the last one holds."""
    wide = even.astype(np.int32)
    return np.append((wide[:-1] + wide[1:]) >> 1, wide[-1:]).astype(np.int16)


def pack_pcm(pcm: bytes) -> bytes:
    """A file of bytes as small as its PCM allows; `unpack_pcm` gives the same bytes again, whatever they were.

    Every other sample is stored as what interpolation of its neighbours leaves. The others take a byte each where all are values of mu-law or A-law audio.
    """
    tag, rate, _, data = read_wave(pcm)
    if len(data) % 2 or wave(PCM, data, rate, 16, 2) != pcm:
        return b"\0" + pcm
    samples = np.frombuffer(data, "<i2").astype(np.int16)
    even, odd = samples[0::2], samples[1::2]
    left = (odd - midpoints(even)[: len(odd)]).astype("<i2").tobytes()
    for kind, values in enumerate(COMPANDED, 2):
        at = np.searchsorted(values, even).clip(max=len(values) - 1)
        if np.array_equal(values[at], even):
            return struct.pack("<BII", kind, rate, len(samples)) + at.astype(np.uint8).tobytes() + left
    return struct.pack("<BII", 1, rate, len(samples)) + even.astype("<i2").tobytes() + left


def unpack_pcm(packed: bytes) -> bytes:
    if not packed[0]:
        return packed[1:]
    kind, rate, n = struct.unpack_from("<BII", packed)
    n_even = n - n // 2
    samples = np.empty(n, np.int16)
    if kind == 1:
        even = np.frombuffer(packed, "<i2", n_even, 9)
    else:
        even = COMPANDED[kind - 2][np.frombuffer(packed, np.uint8, n_even, 9)]
    samples[0::2] = even
    samples[1::2] = np.frombuffer(packed[len(packed) - n // 2 * 2 :], "<i2") + midpoints(even)[: n // 2]
    return wave(PCM, samples.astype("<i2").tobytes(), rate, 16, 2)


#: Bytes of an ADPCM block of stored payloads; a payload is a whole number of them.
BLOCK = 64
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def codec_of(payload: bytes) -> int:
    """The format that a payload is stored in, dealt by its checksum."""
    return (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]


def store(payload: bytes) -> bytes:
    """A payload as mu-law or A-law codes, or as ADPCM blocks, of a WAVE file; its bytes are kept as they are."""
    codec = codec_of(payload)
    if codec == IMA_ADPCM:
        return wave(codec, payload, 8000, 4, BLOCK, (2 * (BLOCK - 4) + 1).to_bytes(2, "little"))
    return wave(codec, payload)


def arrow_rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's padded bytes as the codes of a WAVE file."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            rows = [payload_of(t) for t in common.texts(batch)]
            yield arrow_rows([(i, n, store(p)) for i, (p, n) in zip(batch.column("doc_id").to_pylist(), rows, strict=True)], STORED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, STORED)


def read_payloads(stored: DataFrame, to: int = 16000) -> DataFrame:
    """What the stored bytes give back: payload digests, and the audio decoded, resampled and made a PCM WAVE file, packed."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            rows, files = [], batch.column("media").to_pylist()
            for doc_id, n, media, (samples, rate) in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), files, decode_many(files), strict=True):
                payload = read_wave(media)[3]
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), pack_pcm(pcm_wave(samples, rate, to))))
            yield arrow_rows(sorted(rows, key=lambda r: r[-1][0]), READ)  # files packed alike lie together, which compresses better

    return stored.mapInArrow(unpack, READ)


def describe(pcm: bytes) -> str:
    """Rate, samples, peak, mean square, sign changes and a checksum of a PCM file."""
    samples, rate = decode(pcm)
    x = samples.astype(np.int64)
    return f"rate={rate} n={len(x)} peak={int(np.abs(x).max(initial=0))} power={int((x * x).sum()) // max(1, len(x))} crossings={int(np.count_nonzero(np.diff(x >= 0)))} pcm={zlib.crc32(samples.tobytes()):08x}"


def with_features(read: DataFrame) -> DataFrame:
    """``read`` with the features of its packed PCM files in their place."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([describe(unpack_pcm(x)) for x in batch.column("pcm").to_pylist()], pa.string())], names=[*batch.schema.names[:-1], "feature"])

    return read.mapInArrow(measure, FEATURES)


def media_documents(docs: DataFrame, to: int = 16000) -> DataFrame:
    """Store every text as telephony audio, read the table back, store its resampled PCM losslessly packed, and describe what is read of that.

    Both tables are in the shared folder; the first is dropped when the second is written. The format of a text depends on its bytes alone, so
    equal texts have equal values. Null texts are empty, which is one unit of zero bytes. Repeated rows stay repeated.
    """
    ship(docs.sparkSession)
    media = common.materialize(store_payloads(docs), "media", level=LEVEL)
    pcm = common.materialize(read_payloads(media, to), "pcm", level=LEVEL)
    common.drop(media)
    return with_features(pcm)
