"""Helpers shared by the corpus operators: scratch tables, Arrow text buffers and hashes.

Everything here works on one Arrow batch or one scratch folder. Hashes of words and lines mix their bytes
eight at a time; `Sums` are polynomial sums over bytes or such hashes, for short windows and
stretches of words. Both are the same on every executor, since their constants are fixed.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2)]
_BASE = [(0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)), (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64))]

#: ASCII separators of words: blank and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch with whole texts; Spark's 10,000 take 40 MB and more, several times over in an executor and its Python workers.
BATCH_ROWS = 1000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, after its session's Arrow batches were cut to BATCH_ROWS rows, if they were larger."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def split_batches(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about `most` bytes of text each (one row at least)."""
    i = batch.schema.get_field_index(column)
    _, at = text_bytes(batch.column(i))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... (n of them); the longest list so far is kept, up to a few million."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        with np.errstate(over="ignore"):
            known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


class Sums:
    """Prefix sums of a sequence of symbols, from which the hash of any stretch follows in constant time."""

    def __init__(self, symbols: np.ndarray, kind: int = 0):
        base, inverse = _BASE[kind]
        with np.errstate(over="ignore"):
            values = _BYTE[kind][symbols] if symbols.dtype == np.uint8 else symbols
            self.total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * _powers(base, len(values)), out=self.total[1:])
        self.inverse = _powers(inverse, len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


_SEED = [U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)]
_STEP = [U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)]
_BYTES_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans beyond this many bytes are hashed one by one.
LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash of the bytes of each span. Eight bytes at a time go through the mixer, so that no sums of bytes can cancel out."""
    length = ends - starts
    if not len(length):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mixed(length.astype(np.uint64) + _SEED[kind])
        some = np.flatnonzero((length > 0) & (length <= LONG))
        for at in range(0, LONG, 8):
            some = some[length[some] > at]
            if not len(some):
                break
            lane = eight[starts[some] + at] & _BYTES_KEPT[np.minimum(length[some] - at, 8)]
            out[some] = mixed((out[some] ^ lane) * _STEP[kind])
    raw = memoryview(padded)
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]], int(_SEED[kind]))
    return out


def within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ... as one array."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
