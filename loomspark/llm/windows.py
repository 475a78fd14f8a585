"""Repeated windows of symbols (bytes or words) over a corpus, found through a dictionary of phrases.

A text is cut at rolling-hash triggers: the trigger of a window is its gram with the least hash
(the leftmost of equal ones), so that equal windows have equal triggers at equal distances. The
windows whose trigger stands at one place form a phrase; phrases overlap by a window less one
symbol, each window lies whole in exactly one, and no phrase holds a window twice. Two phrases
with the same trigger and content hold the same windows; phrases with different triggers share
none. So the work is:

1. Texts are written once with a number for each row, by which all later steps name them.
2. Each task cuts its documents, drops phrases that it has seen before (they are repeats), and
   sends one row per distinct phrase and task to the block of its trigger.
3. A block keeps the first place of each phrase (the dictionary), reports the others as repeats,
   and reports as contested the windows of first phrases that agree with a different one on the
   trigger and on one side of it, where the window has half of its other symbols: no others can be
   shared.
4. The symbols of contested phrases go back to their block, where the operator's own method
   (a suffix array, or factors) tells which of their windows repeat.
5. The repeats of each row are joined to its text.

A phrase that fills much of the corpus costs one row per task, not one per place. A trigger that a
sample of the texts shows to be very frequent is split: its phrases go to two blocks, by what
stands left and right of it, since phrases that share a window agree on one of the two. (The
sample decides only where rows go, not what is found.) Phrases are compared by independent hashes of
40, 48, 16 and 16 bits and the block. Rows move in packed arrays.

Places are ordered by doc_id, then by row, then by position; a null doc_id stands before all
others and comes back as null. Rows that share a doc_id are separate texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Sums, mixed, split_batches, stored, text_bytes, within

NO_ID = -(2**63)
#: Phrases or windows that a task holds before it sends them on.
HELD = 500_000
#: Bytes of symbols of contested phrases that a task holds before it sends them on.
HELD_BYTES = 16 << 20
#: Documents from which frequent triggers are estimated, and the phrases of one trigger from which it is split.
SAMPLE_DOCS = 2_000
HOT_PHRASES = 100_000
#: Bytes of text for which there is a block, and the most blocks (then each has more).
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS, MOST_BLOCKS = 64, 1_000_000


class Shape(NamedTuple):
    """What repeats: windows of `window` symbols; `other_document` asks for an earlier document, else any earlier place."""

    window: int
    gram: int
    other_document: bool

    @property
    def half(self) -> int:
        """Of the symbols of a window beside its trigger, so many stand on one side at least."""
        return (self.window - self.gram + 1) // 2


#: Grams are ordered by these bits of their hashes and then by place, for which the others leave room (a billion symbols in a batch).
_ORDER = np.uint64(2**64 - 2**30)

#: The bytes of a trigger's hash that are sent.
_SENT_ONE = ~np.uint64(2**24 - 1)

#: Symbols of a batch of texts: the symbol array, the offsets of each row.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, values
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - size : width - size + len(values) - width + 1])


def phrases(symbols: np.ndarray, at: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Row, start within it, number of windows, place of the trigger in it, trigger, content, and hashes left and right of the trigger, of all phrases.

    Windows of one trigger agree on half of their other symbols to its left or to its right; a side
    on which a phrase has fewer symbols than that has hash 0, which agrees with nothing.
    """
    total, window = len(symbols), shape.window
    if total < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16))
    grams = np.arange(total - shape.gram + 1)
    sums = Sums(symbols)
    value = sums.of(grams, grams + shape.gram)
    place = sliding_minimum((value & _ORDER) | grams.astype(np.uint64), window - shape.gram + 1) & ~_ORDER
    ends = np.repeat(at[1:], np.diff(at))[: len(place)]
    places = np.flatnonzero(np.arange(window, window + len(place)) <= ends)
    place = place[places]
    fresh = np.ones(len(places), bool)
    fresh[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(fresh)
    start, n, at_gram = places[first], np.diff(np.append(first, len(places))), place[first].astype(np.int64)
    end, half = start + n + window - 1, shape.half
    left, right = np.maximum(at_gram - half, start), np.minimum(at_gram + shape.gram + half, end)
    sides = [_short(sums.of(a, b), b - a == half) for a, b in ((left, at_gram), (at_gram + shape.gram, right))]
    row = np.searchsorted(at, start, "right") - 1
    return row, start - at[row], n, at_gram - start, value[at_gram], Sums(symbols, 1).of(start, end), *sides


def _short(hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole, np.maximum(hashes >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16)


# --- packed rows ------------------------------------------------------------------------------


class Rows(NamedTuple):
    """Hashed phrases and their places; left and right are hashes of a trigger's sides and mid is its place."""

    one: np.ndarray
    two: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    mid: np.ndarray

    def take(self, which: np.ndarray) -> Rows:
        return Rows(*(x[which] for x in self))


def _joined(parts: list[Rows]) -> Rows:
    return Rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))


class Width(NamedTuple):
    """Bytes of each hash that are sent."""

    one: int
    two: int
    sides: int


PHRASE, PLACE = Width(5, 6, 2), Width(0, 0, 0)


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([x.view(np.uint8) for x in arrays]).tobytes())


def _places(rows: int, raw: bytes, ints: int) -> tuple[np.ndarray, ...]:
    """Documents, rows, and so many arrays of 32-bit numbers."""
    return (*(np.cumsum(np.frombuffer(raw, "<i8", rows, 8 * rows * k)) for k in (0, 1)), *(np.frombuffer(raw, "<i4", rows, (16 + 4 * k) * rows) for k in range(ints)))


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype("<i8")


def _pack(rows: Rows, width: Width) -> bytes:
    """The leading bytes of each hash, and places (documents and rows as differences) compressed."""
    rest = _squeezed(_steps(rows.doc), _steps(rows.row), *(x.astype("<i4") for x in (rows.start, rows.n, rows.mid)))
    hashes = [x.astype(kind).view(np.uint8).reshape(len(x), -1)[:, x.dtype.itemsize - wide :].tobytes() for x, kind, wide in zip(rows[:4], ("<u8", "<u8", "<u2", "<u2"), (width.one, width.two, width.sides, width.sides), strict=True)]
    return b"".join([len(rows.doc).to_bytes(4, "little"), len(rest).to_bytes(4, "little"), rest, *hashes])


def _unpack(blob: bytes, width: Width) -> Rows:
    rows, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    rest = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size])
    at, out = 8 + size, []
    for kind, full, wide in (("<u8", 8, width.one), ("<u8", 8, width.two), ("<u2", 2, width.sides), ("<u2", 2, width.sides)):
        x = np.zeros((rows, full), np.uint8)
        x[:, full - wide :] = np.frombuffer(blob, np.uint8, rows * wide, at).reshape(rows, wide)
        out.append(x.view(kind).ravel())
        at += rows * wide
    return Rows(*out, *_places(rows, rest, 3))


def _sorted(parts: list[Rows]) -> Rows:
    rows = _joined(parts)
    return rows.take(np.lexsort((rows.start, rows.row, rows.doc, rows.right, rows.left, rows.two, rows.one)))


def _repeats(rows: Rows, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: where a new thing starts, and which rows repeat an earlier place."""
    fresh = np.ones(len(rows.one), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)
    head = np.flatnonzero(fresh)
    of = np.repeat(head, np.diff(np.append(head, len(fresh))))
    if shape.other_document:
        return fresh, rows.doc > rows.doc[of]
    return fresh, ~fresh


def _several(rows: Rows, side: np.ndarray) -> np.ndarray:
    """Which phrases agree with a different one on the trigger and on this side of it."""
    out = np.zeros(len(rows.one), bool)
    some = np.flatnonzero(side)
    if len(some):
        order = some[np.lexsort((rows.two[some], side[some], rows.one[some]))]
        one, key, two = rows.one[order], side[order], rows.two[order]
        fresh = np.append(True, (one[1:] != one[:-1]) | (key[1:] != key[:-1]))
        head = np.flatnonzero(fresh)
        differs = ~fresh & np.append(False, two[1:] != two[:-1])
        out[order[np.repeat(np.add.reduceat(differs.astype(np.int64), head) > 0, np.diff(np.append(head, len(order))))]] = True
    return out


def _disputed(rows: Rows, shape: Shape) -> Rows:
    """The windows that a different phrase may hold too: those with enough symbols on a side on which the phrases agree."""
    left, right = _several(rows, rows.left), _several(rows, rows.right)
    last = np.where(right, rows.n, np.minimum(rows.n, rows.mid - shape.half + 1))
    first = np.where(left, 0, np.maximum(0, rows.mid - (shape.window - shape.gram - shape.half)))
    some = (left | right) & (first < last)
    return rows._replace(start=(rows.start + first).astype(np.int32), n=(last - first).astype(np.int32)).take(some)


BLOB = "block int, kind int, blob binary"
EVENT = "row long, start int, n int, kind int, block int"
REPEAT, CONTESTED = 0, 1


def _merged(rows: Rows) -> Rows:
    """The runs of windows that rows cover, without their hashes."""
    rows = rows.take(np.lexsort((rows.start, rows.row)))
    row, start, end = rows.row, rows.start.astype(np.int64), rows.start.astype(np.int64) + rows.n
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(fresh)
    none = np.zeros(len(head), np.uint64)
    return Rows(none, none, none.astype(np.uint16), none.astype(np.uint16), rows.doc[head], row[head], start[head], np.maximum.reduceat(end, head) - start[head] if len(head) else start, np.zeros(len(head), np.int32))


def _batches(out: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(out), 256):
        block, kind, blob = zip(*out[k : k + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["block", "kind", "blob"])


def _by_block(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each block of a sorted list with the stretch that goes to it."""
    head = np.flatnonzero(np.diff(to, prepend=-1))
    yield from zip(to[head].tolist(), head.tolist(), np.append(head[1:], len(to)).tolist(), strict=True)


def _targets(rows: Rows, blocks: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row goes to which block; rows of a hot trigger go to the blocks of its left and of its right side."""
    size = np.uint64(blocks)
    to = (mixed(rows.one) % size).astype(np.int64)
    split = np.flatnonzero(np.isin(rows.one, hot))
    if not len(split):
        return np.arange(len(to)), to
    sides = [np.where(side[split] > 0, (mixed(rows.one[split] ^ (side[split].astype(np.uint64) << np.uint64(k))) % size).astype(np.int64), -1) for side, k in ((rows.left, 16), (rows.right, 40))]
    to[split] = np.where(sides[0] < 0, sides[1], sides[0])
    second = (sides[1] >= 0) & (sides[1] != to[split])
    return np.append(np.arange(len(to)), split[second]), np.append(to, sides[1][second])


def _sent(held: list[Rows], shape: Shape, blocks: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed phrases of a task, without those that repeat in it; the repeats as merged runs."""
    if not held or not sum(len(x.one) for x in held):
        return
    rows = _sorted(held)
    _, again = _repeats(rows, shape)
    out = []
    if again.any():
        runs = _merged(rows.take(again))
        for k in range(0, len(runs.doc), 5000):
            part = runs.take(np.arange(k, min(k + 5000, len(runs.doc))))
            out.append((int(part.row[0]) % blocks, REPEAT, _pack(part, PLACE)))
    rows = rows.take(~again)
    which, to = _targets(rows, blocks, hot)
    order = np.lexsort((rows.start[which], rows.row[which], rows.doc[which], to))
    rows = rows.take(which[order])
    out += [(block, CONTESTED, _pack(rows.take(np.arange(a, b)), PHRASE)) for block, a, b in _by_block(to[order])]
    yield from _batches(out)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID))


def _cut(symbols: Symbols, shape: Shape, blocks: int, hot: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for whole in batches:
            for batch in split_batches(whole, "text", 1 << 20):
                at, start, n, mid, trigger, content, left, right = phrases(*symbols(batch.column("text")), shape)
                row = np.asarray(batch.column("row"))[at]
                held.append(Rows(trigger & _SENT_ONE, content, left, right, _ids(batch.column("doc_id"))[at], row, start.astype(np.int32), n.astype(np.int32), mid.astype(np.int32)))
                rows += len(row)
                if rows >= HELD:
                    yield from _sent(held, shape, blocks, hot)
                    held, rows = [], 0
        yield from _sent(held, shape, blocks, hot)

    return run


def _met(shape: Shape):
    """What a block knows: repeats, and first phrases that may share windows with another."""

    def run(table: pa.Table) -> pa.Table:
        parts: list[Rows] = []
        ready: list[tuple[Rows, int]] = []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind == REPEAT:
                ready.append((_unpack(blob, PLACE), REPEAT))
            else:
                parts.append(_unpack(blob, PHRASE))
        if parts:
            rows = _sorted(parts)
            _, again = _repeats(rows, shape)
            ready.append((_merged(rows.take(again)), REPEAT))
            ready.append((_disputed(rows.take(~again), shape), CONTESTED))
        found = _joined([r for r, _ in ready])
        kinds = np.repeat([k for _, k in ready], [len(r.doc) for r, _ in ready])
        return _events(found.row, found.start, found.n, kinds, int(table.column("block")[0].as_py()))

    return run


def _events(row: np.ndarray, start: np.ndarray, n: np.ndarray, kinds: np.ndarray, block: int) -> pa.Table:
    return pa.Table.from_arrays([pa.array(row, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (start, n, kinds, np.full(len(row), block)))], ["row", "start", "n", "kind", "block"])


def _listed(lists: pa.Array, rows: int) -> tuple[np.ndarray, ...]:
    """Rows of a batch and the fields of a column of lists of structs of numbers."""
    lists = lists.fill_null([])
    flat = lists.flatten()
    return np.repeat(np.arange(rows), np.diff(np.asarray(lists.offsets, np.int64))), *(np.asarray(flat.field(k), np.int64) for k in range(flat.type.num_fields))


class Pieces(NamedTuple):
    """Stretches of texts, with the place where each starts; all their symbols in a row, and where each begins in them."""

    doc: np.ndarray
    row: np.ndarray
    start: np.ndarray
    symbols: np.ndarray
    at: np.ndarray


def _fetch(symbols: Symbols, shape: Shape):
    """The symbols of contested phrases, packed for their blocks."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, row, start, size, block, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, row, doc, block))
        first = (np.cumsum(size) - size)[order]
        doc, row, start, size, block = (x[order] for x in (doc, row, start, size, block))
        out = []
        for to, a, b in _by_block(block):
            text = flat[within(first[a:b], size[a:b])]
            packed = _squeezed(_steps(doc[a:b]), _steps(row[a:b]), start[a:b].astype("<i4"), size[a:b].astype("<i4"), text)
            out.append((to, CONTESTED, (b - a).to_bytes(4, "little") + packed))
        yield from _batches(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in split_batches(whole, "text", 1 << 20):
                values, at = symbols(batch.column("text"))
                of, start, n, block = _listed(batch.column("places"), batch.num_rows)
                wide = n + shape.window - 1
                held.append((_ids(batch.column("doc_id"))[of], np.asarray(batch.column("row"))[of], start, wide, block, values[within(at[of] + start, wide)]))
                size += held[-1][-1].nbytes + 40 * len(of)
                if size >= HELD_BYTES:
                    yield from sent(held)
                    held, size = [], 0
        yield from sent(held)

    return run


def _unpacked(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, ...]:
    rows = int.from_bytes(blob[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    doc, row, start, size = _places(rows, raw, 2)
    return doc, row, start, size, np.frombuffer(raw, dtype, offset=24 * rows)


#: Tells of all windows of pieces (in the order of their places), as (piece, offset, number) runs, which repeat an earlier one.
Method = Callable[[Pieces, Shape], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _resolved(shape: Shape, method: Method, dtype: np.dtype):
    def run(table: pa.Table) -> pa.Table:
        doc, row, start, size, flat = (np.concatenate(x) for x in zip(*(_unpacked(b, dtype) for b in table.column("blob").to_pylist()), strict=True))
        order = np.lexsort((start, row, doc))
        flat = flat[within((np.cumsum(size, dtype=np.int64) - size)[order], size[order].astype(np.int64))]
        pieces = Pieces(doc[order], row[order], start[order].astype(np.int64), flat, np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)]))
        of, offset, n = method(pieces, shape)
        return _events(pieces.row[of], pieces.start[of] + offset, n, np.full(len(of), REPEAT), int(table.column("block")[0].as_py()))

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number for each row, written to the shared folder so that the numbers stay."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "texts")


def frequent_triggers(texts: DataFrame, symbols: Symbols, shape: Shape, rows: int, least: int = HOT_PHRASES) -> np.ndarray:
    """Triggers that seem to have `least` phrases or more, by a sample of rows; at least ten phrases of the sample must have one."""
    share = max(1, rows // SAMPLE_DOCS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text", 1 << 20):
                trigger, n = np.unique(phrases(*symbols(batch.column("text")), shape)[4] & _SENT_ONE, return_counts=True)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(trigger[some].view(np.int64)), pa.array(n[some])], ["trigger", "n"])

    counts = texts.filter(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).mapInArrow(run, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    found = counts.filter((F.col("n") >= 10) & (F.col("n") * share >= least)).select("trigger").collect()
    return np.array(sorted(r.trigger for r in found), np.int64).view(np.uint64)


def repeated(texts: DataFrame, symbols: Symbols, dtype: np.dtype, shape: Shape, method: Method) -> DataFrame:
    """Events (row, start, n): the n windows that start at symbol `start` of the row are repeats. texts is from numbered."""
    facts = texts.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    blocks = min(max(LEAST_BLOCKS, (facts.size or 0) // BLOCK_BYTES), MOST_BLOCKS)
    hot = frequent_triggers(texts, symbols, shape, facts.rows)
    met = texts.mapInArrow(_cut(symbols, shape, blocks, hot), BLOB).groupBy("block").applyInArrow(_met(shape), EVENT)
    found = stored(met, "phrases")
    places = found.filter(F.col("kind") == CONTESTED).groupBy("row").agg(F.collect_list(F.struct("start", "n", "block")).alias("places"))
    contested = texts.join(places.hint("merge"), "row").select("doc_id", "text", "row", "places")
    windows = contested.mapInArrow(_fetch(symbols, shape), BLOB).groupBy("block").applyInArrow(_resolved(shape, method, dtype), EVENT)
    return found.filter(F.col("kind") == REPEAT).unionByName(windows).select("row", "start", "n")


def with_repeats(docs: DataFrame, symbols: Symbols, dtype: np.dtype, shape: Shape, method: Method) -> DataFrame:
    """doc_id, text and places (the repeated windows as (start, n) lists) of every row."""
    texts = numbered(docs)
    places = repeated(texts, symbols, dtype, shape, method).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    return texts.join(places.hint("merge"), "row", "left").select("doc_id", "text", "places")


def covered(at: np.ndarray, places: pa.Array, window: int) -> np.ndarray:
    """Which symbols of a batch lie in a repeated window."""
    row, start, n = _listed(places, len(at) - 1)
    first = np.minimum(at[row] + start, at[row + 1])
    last = np.minimum(first + n + window - 1, at[row + 1])
    size = int(at[-1]) + 1
    return np.cumsum(np.bincount(first, minlength=size) - np.bincount(last, minlength=size))[:-1] > 0


def byte_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(column)
