"""Hard negatives by coordinate pruning over length buckets (after LEMP).

Rows are dealt into parts of a bounded number of components. In each part they stand by
descending length, cut into buckets, and each bucket holds a sorted list of every coordinate of its
unit vectors. An anchor runs through the buckets with a threshold: the least score that can still
enter its lists. A bucket whose longest vector cannot reach it ends the run. Else the threshold
gives an angle between the anchor and a row, which gives a feasible range of values for each focus
coordinate (those in which the anchor is largest); the rows whose coordinates lie in all these ranges are the
candidates, and only they are scored, exactly. Thresholds rise as the lists fill.

A first run finds the positives of each anchor, a second one its negatives: the threshold there
begins at the least score that any window of a positive admits. Rows move once for each run; anchors (a
hundredth of the rows in the registered query) are sent to every part. What leaves a part is at most a list per anchor.

Scores are exact integers: products of doubles below 2**53, beyond that Python's integers, limited to
the range of longs. Vectors of different lengths are filled up with zeros.

Edge cases: rows with a null label or vector, or a null or non-finite component, take no part; rows that share
a vec_id, or all of whose columns are equal, are separate rows (ties: smaller vec_id, a null one last, then stored
order); a row with a null vec_id is never an anchor; an anchor without a positive or negative has no result
rows; an empty vector scores 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import stored

SCALE = 256
#: Rows of a bucket.
BUCKET = 512
#: Components of the rows of a part, which a task holds.
PART = 1 << 22
#: Parts at least, for small tables.
LEAST_PARTS = 32
FOCUS = 4
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is within these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
SLACK = 1e-9
POSITIVE = "array<struct<positive_id: long, positive_score: long>>"


@dataclass
class Rows:
    """Rows of a batch: integer vectors (as doubles), lengths, labels and names."""

    v: np.ndarray
    length: np.ndarray
    label: np.ndarray
    vec_id: np.ndarray
    no_id: np.ndarray
    uid: np.ndarray

    def take(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.v[at], self.length[at], self.label[at], self.vec_id[at], self.no_id[at], self.uid[at])


def _rows(batch: pa.RecordBatch, dim: int) -> Rows:
    column = batch.column("v")
    size = np.diff(np.asarray(column.offsets))
    v = np.zeros((batch.num_rows, dim))
    v[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(column.flatten())
    v = np.floor(SCALE * v)
    with np.errstate(over="ignore"):
        length = np.sqrt((v * v).sum(axis=1))
    ids = batch.column("vec_id")
    return Rows(v, length, np.asarray(batch.column("label")), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(batch.column("uid")))


def scores(v: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products of rows with q; bound is at least the largest product of lengths."""
    if bound < 2.0**52:
        return (v @ q).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    exact = [int(x) for x in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, exact, strict=True)), low), high) for row in v], np.int64)


class Bucket:
    """Rows of similar length with a sorted list of each coordinate of their unit vectors."""

    def __init__(self, rows: Rows):
        self.rows = rows
        self.longest, self.shortest = float(rows.length.max()), float(rows.length.min())
        self.bounded = math.isfinite(self.longest)
        unit = rows.v / np.where(rows.length > 0, rows.length, 1)[:, None] if self.bounded else np.zeros_like(rows.v)
        self.order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(unit.T, self.order, axis=1)

    def candidates(self, unit: np.ndarray, length: float, focus: np.ndarray, least: float) -> np.ndarray:
        """Places of rows that can score `least` with a query of this unit vector and length."""
        n = len(self.rows.length)
        if least == -math.inf or not self.bounded or not math.isfinite(length):
            return np.arange(n)
        if length == 0 or self.longest == 0:
            return np.arange(n if least <= 0 else 0)
        if least > 0:
            cosine = least / (length * self.longest)
        else:
            cosine = least / (length * self.shortest) if self.shortest else -1.0
        cosine -= SLACK
        if cosine > 1:
            return np.arange(0)
        if cosine <= -1:
            return np.arange(n)
        angle, own = math.acos(cosine), np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(own + angle, math.pi)) - SLACK, np.cos(np.maximum(own - angle, 0)) + SLACK
        spans = [(np.searchsorted(self.sorted[f], lo, "left"), np.searchsorted(self.sorted[f], hi, "right")) for f, lo, hi in zip(focus, low, high, strict=True)]
        widths = [b - a for a, b in spans]
        first = int(np.argmin(widths))
        found = self.order[focus[first], spans[first][0] : spans[first][1]]
        for k in range(len(focus)):
            if k != first and widths[k] < n:
                x = self.rows.v[found, focus[k]] / np.where(self.rows.length[found] > 0, self.rows.length[found], 1)
                found = found[(x >= low[k]) & (x <= high[k])]
        return found


class Best:
    """The first k of the scores in [low, high] seen so far, by descending score, id and stored order."""

    def __init__(self, k: int, low: float = -math.inf, high: float = math.inf):
        self.k, self.low, self.high = k, low, high
        self.kept = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool), np.zeros(0, np.int64))

    @property
    def least(self) -> float:
        return max(self.low, float(self.kept[0][-1])) if len(self.kept[0]) == self.k else self.low

    def add(self, score: np.ndarray, rows: Rows) -> None:
        some = np.flatnonzero((score >= self.least) & (score <= self.high))
        if not len(some):
            return
        score, ids, none, uid = (np.concatenate(x) for x in zip(self.kept, (score[some], rows.vec_id[some], rows.no_id[some], rows.uid[some]), strict=True))
        # the complement turns the order of scores without leaving the range of longs
        first = np.lexsort((uid, ids, none, ~score))[: self.k]
        self.kept = score[first], ids[first], none[first], uid[first]


def _run(buckets: list[Bucket], anchor: Rows, same: bool, lists: list[Best]) -> None:
    """Fills the lists of one anchor from all buckets, which stand by descending length."""
    q, length = anchor.v[0], float(anchor.length[0])
    unit = q / length if length and math.isfinite(length) else np.zeros_like(q)
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    for bucket in buckets:
        least = min(x.least for x in lists)
        if least > length * bucket.longest * (1 + SLACK) and least > 0:
            break
        found = bucket.candidates(unit, length, focus, least)
        found = found[(bucket.rows.label[found] == anchor.label[0]) == same]
        if same:
            found = found[bucket.rows.uid[found] != anchor.uid[0]]
        if len(found):
            rows = bucket.rows.take(found)
            score = scores(rows.v, q, length * bucket.longest if length else 0.0)
            for x in lists:
                x.add(score, rows)


def _out(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * (len(names) + 1)
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-2]], pa.array(columns[-2], pa.int64(), mask=columns[-1].astype(bool))], names)


def _search(table: DataFrame, dim: int, same: bool) -> DataFrame:
    """Runs over parts in which rows (kind 0) stand before anchors (kind 1)."""
    names = ["a", "uid", "score", "vec_id"] if same else ["a", "k", "uid", "score", "vec_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, buckets = None, [], []
        for batch in batches:
            keys = np.asarray(batch.column("part")) * 2 + np.asarray(batch.column("kind"))
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                now, kind = divmod(int(keys[a]), 2)
                if now != part:
                    part, waiting, buckets = now, [], []
                rows = _rows(piece, dim)
                if kind == 0:
                    waiting.append(rows)
                    continue
                if waiting:
                    held = Rows(*(np.concatenate([getattr(w, f) for w in waiting]) for f in Rows.__dataclass_fields__))
                    held, waiting = held.take(np.argsort(-held.length, kind="stable")), []
                    buckets = [Bucket(held.take(slice(i, i + BUCKET))) for i in range(0, len(held.uid), BUCKET)]
                positives = piece.column("positives").to_pylist()
                done = []
                for i in range(len(rows.uid)):
                    if same:
                        lists = [Best(POSITIVES)]
                    else:
                        lists = [Best(NEGATIVES, -(-LOWEST * p["positive_score"] // 100), HIGHEST * p["positive_score"] // 100) for p in positives[i]]
                    open_lists = [x for x in lists if x.low <= x.high]
                    if open_lists:
                        _run(buckets, rows.take(slice(i, i + 1)), same, open_lists)
                    for k, x in enumerate(lists):
                        score, ids, none, uid = x.kept
                        done.append((np.full(len(score), rows.uid[i]), *([] if same else [np.full(len(score), k)]), uid, score, ids, none))
                yield _out(names, done)

    return table.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def prepared(rows: DataFrame, relabelled: Column) -> DataFrame:
    """uid, vec_id, label, v and length of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = rows.select(F.col("vec_id").cast("long"), relabelled.cast("long").alias("label"), x.alias("v")).filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c * c))
    return stored(some.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "v", length.alias("length")), "vectors")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, relabelled: Column) -> DataFrame:
    """The negatives of each anchor and positive among rows(vec_id, embedding, label)."""
    table = prepared(rows, relabelled)
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = max(facts.dim or 1, 1)
    parts = max(LEAST_PARTS, -(-facts.n * dim // PART))
    none = F.lit(None).cast(POSITIVE)
    held = table.select(F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"), F.lit(0).cast("long").alias("kind"), "*", none.alias("positives"))
    anchors = table.filter(is_anchor)

    def against_all(asked: DataFrame, same: bool) -> DataFrame:
        sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).cast("long").alias("kind"), *table.columns, "positives")
        dealt = held.unionByName(sent).repartition(parts, "part").sortWithinPartitions("part", "kind")
        return _search(dealt, dim, same)

    found = _first(against_all(anchors.withColumn("positives", none), True), ["a"], POSITIVES)
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))))
    positives = stored(found.groupBy(F.col("a").alias("uid")).agg(F.transform(listed, lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score"))).alias("positives")), "positives")
    asked = stored(anchors.join(positives, "uid"), "asked")
    negatives = _first(against_all(asked, False), ["a", "k"], NEGATIVES)
    named = asked.select(F.col("uid").alias("a"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("k", "p"))
    out = negatives.join(named.withColumn("k", F.col("k").cast("long")), ["a", "k"])
    return out.select("anchor_id", "p.positive_id", "rank", F.col("vec_id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


def op13_coordinate_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)
