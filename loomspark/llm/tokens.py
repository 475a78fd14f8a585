"""Token ids of documents, the packed Parquet token format, and balanced sequence packing.

Tokenizers are read from a path and never trained. A text is encoded piece by piece: the
tokenizer's pre-tokenisation never joins characters across ASCII white space, so the ids of a
text are those of its pieces in order, and each distinct piece of a batch is encoded once. (A test
holds this against encoding whole texts.)

Edge cases: a null or empty text has the end id alone; repeated rows are separate documents, those
of one doc_id in the order of their texts' hashes; a null doc_id sorts first; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import SEPARATOR, scratch_path, text_bytes, within, word_spans

END_ID = 2
#: Distinct pieces whose ids a Python worker keeps at once (about 80 MB).
MEMO = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,!?#$%&*|:;()+=-")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased pieces of all rows, and for each row the index of its first piece (one more entry than rows).

    Pieces are words, and punctuation at a word's end. Letters of ASCII and Latin-1 are lower-cased,
    as the tokenizer's own normaliser would; a run of punctuation is split off where a letter of
    these or a digit stands before it, which always ends a pre-token of the tokenizer.
    """
    low = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[after]
    low[after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    starts, ends, _ = word_spans(data, offsets)
    tail = np.flatnonzero(_PUNCT[data[ends - 1]])
    other = np.flatnonzero(~_PUNCT[data])
    found = np.searchsorted(other, ends[tail]) - 1
    cut = (other[found] if len(other) else np.zeros(0, np.int64)) + 1
    inner = np.flatnonzero((found >= 0) & (cut > starts[tail])) if len(other) else np.zeros(0, np.int64)
    cut, start = cut[inner], starts[tail[inner]]
    before, lead = low[cut - 1], low[np.maximum(cut - 2, 0)]
    plain = ((before >= 97) & (before <= 122)) | ((before >= 48) & (before <= 57)) | ((lead == 0xC3) & (cut - 2 >= start) & (before >= 0x9F) & (before <= 0xBF) & (before != 0xB7))
    cut = cut[plain]
    heads, tails = (_union(x, cut, len(data) + 1) for x in (starts, ends))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(tails - heads)])
    pieces = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(bounds), pa.py_buffer(low[~SEPARATOR[data]]))
    return pieces, np.searchsorted(heads, offsets)


def _union(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Two sets of numbers below `size` as one, in order."""
    mark = np.zeros(size, bool)
    mark[a] = True
    mark[b] = True
    return np.flatnonzero(mark)


#: The normaliser and the pre-tokenisation for which texts may be cut into pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Encodes Arrow string columns; keeps the ids of recent pieces, up to MEMO of them.

    A tokenizer that normalises or cuts texts in another way than the above encodes them whole.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        made = json.loads(self.tokenizer.to_str())
        self.by_pieces = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER and bool(self.ends_word.any())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _learn(self, fresh: list[str]) -> None:
        """Words of letters only are one pre-token each, so that many go in one call and end at ids of word ends."""
        words, others = [], []
        for w in fresh:
            (words if _LETTERS.fullmatch(w) else others).append(w)
        flat, _ = self._encode([" ".join(words[i : i + 200]) for i in range(0, len(words), 200)])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        assert len(ends) == len(words)
        more, counts = self._encode(others)
        counts = np.concatenate([np.diff(ends, prepend=0), counts])
        n = len(self.counts)
        self.known.update(zip(chain(words, others), range(n, n + len(fresh)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat = np.concatenate([self.flat, flat, more])
        self.counts = np.concatenate([self.counts, counts])

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MEMO:
            self._forget()
        codes = list(map(self.known.get, words))
        if None in codes:
            self._learn([w for w, c in zip(words, codes, strict=True) if c is None])
            codes = list(map(self.known.__getitem__, words))
        return np.array(codes, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the offsets of each text's ids."""
        data, at = text_bytes(texts)
        if not self.by_pieces or b"<|" in data.tobytes():  # may hold a special token, whose letters must stay as they are
            ids, n = self._encode(texts.fill_null("").to_pylist())
        else:
            pieces, first = _pieces(data, at)
            pieces = pieces.dictionary_encode()
            codes, index = self._codes(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), np.asarray(pieces.indices)
            counts = self.counts[codes][index]
            ids = self.flat[within(self.starts[codes][index], counts)]
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
            n = np.diff(upto[first])
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        if self.end_id is None:
            return ids, offsets
        out = np.full(len(ids) + len(n), self.end_id, np.uint32)
        out[within(offsets[:-1] + np.arange(len(n)), n)] = ids
        return out, offsets + np.arange(len(n) + 1)


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def shared_encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder for all tasks of a Python worker, so that the pieces of one task are known to the next."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())


def _small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _crc(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    return np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, len(offsets) - 1)


# --- the token format -------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> None:
    """Write the ids of docs(doc_id, text) as Parquet in ascending doc_id order, rows of one doc_id in the order of their texts' hashes.

    A row holds doc_id, start_in_file (ids of the file's documents before it), n_tokens and ids.
    ids are dictionary encoded (the vocabulary's codes take 16 bits), the long columns delta
    encoded; row groups and pages have the given sizes, and Parquet's column and offset indexes
    let a reader skip pages by doc_id. The path may be on any store that Spark writes to.
    """
    tokenizer = tokenizer or tokenizer_path()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = shared_encoder(tokenizer, end_id), 0
        for batch in _small(batches, 2000):
            ids, offsets = encoder(_texts(batch))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), lists], ["doc_id", "start_in_file", "n_tokens", "ids"])
            base += int(offsets[-1])

    # the hash deals the rows of a frequent doc_id over files; rows equal in both are alike
    keys = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    (
        ordered.mapInArrow(encode, "doc_id long, start_in_file long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start_in_file", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))


def _started(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """rows(file, start_in_file, ...) with start, the ids before a document in all files; sizes are summed over files, one row each, in the order of the numbers in their names (longer names have longer numbers)."""
    files = _rows(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "file").withColumn("start", F.col("before") + F.col("start_in_file"))


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id, start (ids of all documents before it) and the columns asked for.

    A condition on doc_id reaches the scan, which skips row groups and pages; columns not asked for
    are not read.
    """
    rows = _rows(spark, path)
    return _started(rows if where is None else rows.filter(where), spark, path).select("doc_id", "start", *columns)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids that were read; only digests are joined and shuffled, not ids."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = np.asarray(lists.flatten()).view(np.uint32)
            offsets = np.asarray(lists.offsets, np.int64)
            offsets = offsets - offsets[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("start_in_file"), pa.array(np.diff(offsets)), pa.array(_crc(ids, offsets))], ["doc_id", "file", "start_in_file", "n_tokens", "ids_crc32"])

    rows = _rows(spark, path).select("doc_id", "file", "start_in_file", "ids").mapInArrow(digest, "doc_id long, file string, start_in_file long, n_tokens long, ids_crc32 long")
    return _started(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digest(spark, path)


# --- packing ----------------------------------------------------------------------------------


def attention_cost(length: np.ndarray | float, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def balanced(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) that fill sequences of `capacity` ids.

    Documents longer than a sequence first give whole sequences. What remains is taken in
    descending length; each part goes to the cheapest sequence that has room for all of it, and
    where none has, it is cut: the sequence with the most room is filled and the rest goes on.
    There are as many sequences as the ids need, the last ones of them with powers of two as
    capacities (the binary digits of the remainder), so no sequence needs padding.
    """
    out: list[tuple[int, int, int, int]] = []
    whole = lengths // capacity
    n = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            out.append((int(d), k * capacity, capacity, n))
            n += 1
    rest = lengths - whole * capacity
    total = int(rest.sum())
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    todo = [(-int(rest[d]), int(d), int(whole[d] * capacity)) for d in np.flatnonzero(rest)]
    heapq.heapify(todo)
    while todo:
        length, d, start = heapq.heappop(todo)
        length = -length
        fits = room >= length
        if fits.any():
            s = int(np.where(fits, cost, np.inf).argmin())
            put = length
        else:
            s = int(room.argmax())
            put = int(room[s])
            heapq.heappush(todo, (put - length, d, start + put))
        out.append((d, start, put, n + s))
        room[s] -= put
        cost[s] += attention_cost(float(put), linear, quadratic)
    return out


def _packed(capacity: int, linear: float, quadratic: float, group_tokens: int, tokenizer: str, end_id: int | None):
    """Batches of documents to batches of pieces with their ids."""

    def pack(doc_ids: list, parts: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        pieces = balanced(lengths, capacity, linear, quadratic)
        pieces.sort(key=lambda p: (p[3], -p[2], p[0], p[1]))
        d, start, length, seq = (np.array(x, np.int64) for x in zip(*pieces, strict=True)) if pieces else [np.zeros(0, np.int64)] * 4
        upto = np.cumsum(length) - length
        head = np.searchsorted(seq, seq)
        flat = np.concatenate([parts[i][a : a + n] for i, a, n, _ in pieces]) if pieces else np.zeros(0, np.uint32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(upto, len(flat)), pa.int32()), pa.array(flat.view(np.int32)))
        columns = [pa.array([doc_ids[i] for i in d], pa.int64()), pa.array(start), pa.array(length), lists, pa.array(lengths[d]), pa.array(first + seq), pa.array(upto - upto[head] if len(head) else upto)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), first + (int(seq[-1]) + 1 if len(seq) else 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = shared_encoder(tokenizer, end_id), TaskContext.get().partitionId() << 32
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in _small(batches, 200):
            ids, offsets = encoder(_texts(batch))
            parts += [ids[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            doc_ids += batch.column("doc_id").to_pylist()
            held += len(ids)
            if held >= group_tokens:
                out, first = pack(doc_ids, parts, first)
                doc_ids, parts, held = [], [], 0
                yield out
        if parts:
            yield pack(doc_ids, parts, first)[0]

    return run


PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, group_tokens: int = 4_000_000, tokenizer: str | None = None, end_id: int | None = END_ID, finish=None, schema: str = PIECES) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most `capacity` ids with balanced attention cost.

    Each task packs its documents in groups of about `group_tokens` ids (memory is bounded by that
    and the longest document), so nothing is shuffled; a group of that size has about a thousand
    sequences to balance. `finish` turns batches of pieces into what is returned, in the same task.
    sequence_id is unique within the result: the partition in its upper bits, then a counter.
    """
    run = _packed(capacity, linear, quadratic, group_tokens, tokenizer or tokenizer_path(), end_id)
    finished = run if finish is None else lambda batches: finish(run(batches))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(finished, schema)


def _piece_digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        crc = pa.array(_crc(np.asarray(lists.flatten()).view(np.uint32), np.asarray(lists.offsets, np.int64)))
        yield pa.RecordBatch.from_arrays([crc if f == "ids_crc32" else b.column(f) for f in PIECE_DIGEST_FIELDS], PIECE_DIGEST_FIELDS)


PIECE_DIGEST_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE_DIGEST = ", ".join(f"{f} long" for f in PIECE_DIGEST_FIELDS)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), finish=_piece_digest, schema=PIECE_DIGEST)
