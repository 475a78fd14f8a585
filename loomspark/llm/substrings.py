"""Removal of repeated substrings: bytes by prefix-free parsing, words by relative Lempel-Ziv factors.

`repeated_bytes` (prefix-free parsing): rolling-hash triggers cut texts into phrases. The
dictionary holds each distinct phrase once; the parse says where it occurs. The suffixes of
dictionary phrases are ranked by doubling, and equal ones stand by the parse's places, which gives the
suffixes of the corpus in order up to 50 bytes; a suffix that shares these with one of a smaller
document is a repeat. Phrases overlap by 49 bytes, so that no suffix needs the phrases after its
own. Phrases that can share no suffix with another one are not sorted.

`repeated_words` (relative Lempel-Ziv): a block of phrases with common triggers is a reference.
Each phrase is factored greedily against all that stands before it in its block: the next factor
is the longest match that starts there. Factors of 20 words or more become duplicate spans, and
the windows that begin in a factor and end beyond it are looked up one by one. A text's phrases are
factored against every block that can hold a match, since a match of 20 words has a trigger.

Both use loomspark.llm.windows, where the common steps are described. A null or empty text
has no bytes and no words; texts shorter than a window repeat nothing; other columns are ignored.
Rows that share a doc_id (or have none) are separate texts: for bytes they take nothing from each
other, for words the later of them in stored order loses what an earlier one holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import split_batches, text_bytes, within, word_hashes, word_spans
from loomspark.llm.windows import Pieces, Shape, byte_symbols, covered, with_repeats

BYTES = Shape(window=50, gram=16, other_document=True)
WORDS = Shape(window=20, gram=6, other_document=False)


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(column)
    starts, ends, first = word_spans(data, at)
    return word_hashes(data, starts, ends), first


# --- suffixes of dictionary phrases, in corpus order ------------------------------------------


def ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the `depth` symbols from each place on, in their order, by doubling: a run's rank is that of the ranks of its halves, or of two overlapping runs."""
    rank, size = symbols, 1
    if symbols.dtype == np.uint8 and 8 <= depth <= len(symbols):  # eight bytes in the order of their number
        rank, size = np.ndarray((len(symbols) - 7,), ">u8", np.ascontiguousarray(symbols), strides=(1,)).astype(np.uint64), 8
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while size < depth:
        step = min(size, depth - size)
        rank = np.unique(rank[: len(rank) - step] << np.uint64(32) | rank[step:], return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank


def suffix_order(pieces: Pieces, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The piece and offset of every suffix of `depth` bytes or more, in the order of their first `depth` bytes and then of their places; and which of them differ from the one before."""
    n = np.maximum(np.diff(pieces.at) - depth + 1, 0)
    of, offset = np.repeat(np.arange(len(n)), n), within(np.zeros(len(n), np.int64), n)
    if not len(of):
        return of, offset, np.zeros(0, bool)
    rank = ranks(pieces.symbols, depth)[pieces.at[of] + offset]
    # the pieces stand in the order of their places, and so do their suffixes: a stable sort keeps that among equal ones
    order = np.argsort(rank, kind="stable")
    rank = rank[order]
    return of[order], offset[order], np.append(True, rank[1:] != rank[:-1])


def repeated_suffixes(pieces: Pieces, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, number) runs of the suffixes that follow an equal one of a smaller document in corpus order."""
    of, offset, fresh = suffix_order(pieces, shape.window)
    if not len(of):
        return of, offset, offset
    head = np.flatnonzero(fresh)
    first = np.repeat(pieces.doc[of[head]], np.diff(np.append(head, len(of))))
    again = pieces.doc[of] > first
    return _stretches(of[again], offset[again])


def _stretches(of: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places as runs of neighbours."""
    order = np.lexsort((offset, of))
    of, offset = of[order], offset[order]
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(of) else np.zeros(0, np.int64)
    return of[head], offset[head], np.diff(np.append(head, len(of)))


# --- relative Lempel-Ziv factors --------------------------------------------------------------


def longest_earlier(words: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """For each word the length of the longest match that starts there, ends in its piece and also starts earlier in the block; 0 under `least` words.

    Ranks of runs of 1, 2, 4... words index the block; a match of any length is the pair of two
    overlapping runs. Only places that still match are looked at again for a longer one.
    """
    out = np.zeros(len(words), np.int64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(words))
    rank = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    size, length, some = 1, least, np.flatnonzero(left >= least)
    while len(some):
        while 2 * size <= length:
            pairs = rank[:-size] << np.uint64(32) | rank[size:]
            rank, size = np.unique(pairs, return_inverse=True)[1].astype(np.uint64), 2 * size
        keys = rank[some] << np.uint64(32) | rank[some + length - size]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        again, shared = np.append(False, same), np.append(False, same) | np.append(same, False)
        out[some[order[again]]] = length
        some = np.sort(some[order[shared]])
        length += 1
        some = some[left[some] >= length]
    return out


def factors(longest: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in the block) of the greedy factors of all pieces, piece by piece at once; words without a match are left out."""
    following = np.where(longest > 0, np.arange(len(longest)), len(longest))
    following = np.append(np.minimum.accumulate(following[::-1])[::-1], len(longest))
    here, end, starts, ends = at[:-1].copy(), at[1:], [], []
    while len(here):
        here = following[here]
        going = here < end
        here, end = here[going], end[going]
        starts.append(here)
        here = here + longest[here]
        ends.append(here)
    starts, ends = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*ends, np.zeros(0, np.int64)])
    order = np.argsort(starts)
    return starts[order], ends[order]


def repeated_factors(pieces: Pieces, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, number) runs of the windows inside factors, and of those across a factor's end that also occur earlier."""
    longest = longest_earlier(pieces.symbols, pieces.at, shape.window)
    start, end = factors(longest, pieces.at)
    inside = end - start - shape.window + 1
    piece_end = pieces.at[np.searchsorted(pieces.at, start, "right")]
    across = within(start + inside, np.minimum(end, piece_end) - start - inside)
    windows = np.unique(np.concatenate([within(start, inside), across[longest[across] > 0]]))
    of = np.searchsorted(pieces.at, windows, "right") - 1
    return _stretches(of, windows - pieces.at[of])


def _runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of the mask, broken at row ends."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[at] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])[at])


def _spans(mask: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs as (start, end) lists within their rows, and how many each row has."""
    start, end = _runs(mask, at)
    count = np.diff(np.searchsorted(start, at))
    base = np.repeat(at[:-1], count)
    pairs = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pairs), count


def repeated_bytes(docs: DataFrame, shape: Shape = BYTES) -> DataFrame:
    """doc_id, n_bytes, spans removed (start, end in bytes), and the bytes kept, of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text", 1 << 20):
                data, at = text_bytes(batch.column("text"))
                mask = covered(at, batch.column("places"), shape.window)
                spans, _ = _spans(mask, at)
                upto = np.concatenate([[0], np.cumsum(_per_row(~mask, at))])
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data[~mask])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), spans, kept], ["doc_id", "n_bytes", "spans", "kept"])

    return with_repeats(docs, byte_symbols, np.dtype(np.uint8), shape, repeated_suffixes).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def repeated_words(docs: DataFrame, shape: Shape = WORDS) -> DataFrame:
    """doc_id, n_words, spans removed (start, end in words), and the words kept joined by blanks, of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text", 1 << 20):
                data, at = text_bytes(batch.column("text"))
                starts, ends, first = word_spans(data, at)
                mask = covered(first, batch.column("places"), shape.window)
                spans, _ = _spans(mask, first)
                left = np.flatnonzero(~mask)
                sizes = (ends - starts)[left]
                count = _per_row(~mask, first)
                head = np.concatenate([[0], np.cumsum(count)])
                last = np.zeros(len(left), bool)
                last[head[1:][count > 0] - 1] = True
                put = np.concatenate([[0], np.cumsum(sizes + ~last)])
                kept = np.full(int(put[-1]), 32, np.uint8)
                kept[within(put[:-1], sizes)] = data[within(starts[left], sizes)]
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(put[head].astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), spans, text], ["doc_id", "n_words", "spans", "kept"])

    return with_repeats(docs, word_symbols, np.dtype(np.uint64), shape, repeated_factors).mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string")


def op4_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) as n_removed", "cast(size(spans) as long) as n_spans", "sha2(kept, 256) as kept_sha256")


def op6_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "n_words", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as n_removed", "sha2(cast(kept as binary), 256) as kept_sha256")
