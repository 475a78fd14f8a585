"""A stored vector index: cells of k-means with inverted lists, probed cell by cell and ranked exactly.

The centres of the cells are fitted on a bounded sample (SAMPLE_PER_CELL rows per cell, chosen by hash); every row is then
put into the list of its nearest centre. A search sends each query to the cells whose centres are nearest, reads
no other cells, and ranks their rows by exact distance. Distances are Euclidean, and returned squared.

How many cells a search reads follows from a recall: exact searches for a bounded sample of the rows (TUNED) tell in the how
many-th nearest cell their neighbours lie. Vectors without clusters need a large share of the cells, others few.

`nearest_exact` needs no luck: a row of a cell is at least as far as the cell's centre less the cell's radius, so that
after a first search only cells within reach of the k-th distance are left to read.

Edge cases: rows with a null or empty vector are not indexed; rows that share a key are separate rows; vectors of one index have
one length (another one raises); equal distances go by key; an index may hold more cells than rows, some of them empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import stored

#: Rows of the sample per cell, and rounds of the fit.
SAMPLE_PER_CELL = 64
ROUNDS = 6
#: Cells at most; their centres go to every task.
MOST_CELLS = 4096
#: Rows and queries of a cell that are compared at once.
ROWS, QUERIES = 8192, 1024
#: Cells that an exact search reads first.
PROBES = 8
#: Rows whose neighbours are searched exactly to choose the number of cells, how many neighbours, and the recall asked for.
TUNED, TUNED_K, RECALL = 64, 10, 0.95


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """The rows of a list column as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    if len(size) and (size != (dim or size[0])).any():
        raise ValueError("the vectors of an index have one length")
    return np.asarray(column.flatten()).astype(float).reshape(len(size), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _cells(found: np.ndarray) -> np.ndarray:
    return np.argmin(found, axis=1) if len(found) else np.zeros(0, np.int64)


def _vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    rows = rows.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    return rows.filter("v is not null and size(v) > 0")


def fit_centres(rows: DataFrame, cells: int) -> np.ndarray:
    """Centres by Lloyd's rounds over a bounded sample of rows(key, v); each round is one pass that sums up by cell."""
    some = stored(rows.orderBy(F.xxhash64("v", "key"), "key").limit(cells * SAMPLE_PER_CELL).select("v"), "sample")
    centres = np.array([r.v for r in some.orderBy(F.xxhash64("v", F.lit(1)), "v").dropDuplicates(["v"]).limit(cells).collect()], float)
    for _ in range(ROUNDS if len(centres) > 1 else 0):

        def sums(batches: Iterable[pa.RecordBatch], at: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"), at.shape[1])
                cell, total = _cells(squared(v, at)), np.zeros_like(at)
                np.add.at(total, cell, v)
                n = np.bincount(cell, minlength=len(at))
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(held, pa.int64()), "n": pa.array(n[held], pa.int64()), "v": pa.array(list(total[held]), pa.list_(pa.float64()))})

        each = some.mapInArrow(sums, "cell long, n long, v array<double>")
        means = each.select("cell", "n", F.posexplode("v")).groupBy("cell", "pos").agg((F.sum("col") / F.sum("n")).alias("x"))
        for r in means.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("v")).collect():
            centres[r.cell] = r.v
    return centres


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows(key, v) with their cell and the distance to its centre."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), centres.shape[1])
            cell = _cells(squared(v, centres))
            away = np.sqrt(((v - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cell, pa.int64()), pa.array(away)], ["key", "v", "cell", "away"])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(run, f"key {kind}, v array<double>, cell long, away double")


def save_index(rows: DataFrame, path: str, key: str = "vec_id", column: str = "embedding", cells: int | None = None, recall: float = RECALL) -> None:
    """Writes lists (a folder for each cell), cells (centre, radius, number of rows) and probes (how many cells give the recall). Without `cells` there are about as many as the root of the number of rows."""
    rows = _vectors(rows, key, column)
    n = cells or int(rows.count() ** 0.5)
    _write(rows, fit_centres(rows, max(1, min(n, MOST_CELLS))), path, "overwrite")
    tune(rows.sparkSession, path, recall)


def tune(spark: SparkSession, path: str, recall: float = RECALL) -> int:
    """Chooses, from exact searches for a sample, how many cells a search of a stored index reads, and stores it."""
    rows = _lists(spark, path).select("key", "v")
    some = rows.orderBy(F.xxhash64("key", "v"), "key").limit(TUNED)
    found = nearest_exact(spark, path, some, TUNED_K, other_keys=True, key="key", column="v")
    centres = centres_of(spark, path)
    order = _probed(some, centres, len(centres)).select("query", "cell", "place")
    places = sorted(r.place for r in found.join(order, ["query", "cell"]).select("place").collect())
    probes = places[min(len(places) - 1, int(recall * len(places)))] if places else 1
    spark.createDataFrame([(probes, float(recall))], "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return probes


def probes_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/probes").first().probes


def add_to_index(rows: DataFrame, path: str, key: str = "vec_id", column: str = "embedding") -> None:
    """Adds rows to the lists of a stored index; its centres stay."""
    _write(_vectors(rows, key, column), centres_of(rows.sparkSession, path), path, "append")


def _write(rows: DataFrame, centres: np.ndarray, path: str, mode: str) -> None:
    spark = rows.sparkSession
    found = stored(_assigned(rows, centres), "assigned")
    # a cell with very many rows is dealt over several tasks, so over several files
    found.repartitionByRange("cell", F.xxhash64("key")).write.mode(mode).partitionBy("cell").parquet(f"{path}/lists")
    facts = found.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    kind = dict(rows.dtypes)["key"]
    known = spark.createDataFrame([(i, c.tolist(), kind) for i, c in enumerate(centres)], "cell long, centre array<double>, kind string")
    before = stored(spark.read.parquet(f"{path}/cells"), "cells").select("cell", "radius", "n") if mode == "append" else facts.limit(0)
    facts = facts.unionByName(before).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    known.join(facts, "cell", "left").fillna(0, ["radius", "n"]).write.mode("overwrite").parquet(f"{path}/cells")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all cells; with the schema given, no file is opened but those of the cells that are asked for."""
    kind = spark.read.parquet(f"{path}/cells").first().kind
    return spark.read.schema(f"key {kind}, v array<double>, away double, cell long").parquet(f"{path}/lists")


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centre for r in spark.read.parquet(f"{path}/cells").orderBy("cell").select("centre").collect()], float)


def _probed(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query, q, cell, place) of the cells with the nearest centres, the nearest in place 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(squared(_matrix(batch.column("v"), centres.shape[1]), centres), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            place = np.tile(np.arange(1, near.shape[1] + 1), len(near))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("v").take(at), pa.array(near.ravel(), pa.int64()), pa.array(place, pa.int64())], ["query", "q", "cell", "place"])

    return queries.mapInArrow(run, f"query {dict(queries.dtypes)['key']}, q array<double>, cell long, place long")


def _least(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(k: int, other_keys: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of rows(key, cell, v) of a block the k nearest to each of queries(query, q), equal distances by key."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query": b.column("query").slice(0, 0), "key": a.column("key").slice(0, 0), "cell": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        v, q = _matrix(a.column("v")), _matrix(b.column("q"))
        keys = a.column("key").combine_chunks()
        place = np.argsort(np.asarray(pc.array_sort_indices(keys)))
        away = squared(q, v)
        if other_keys:
            away[np.asarray(b.column("query").to_pylist())[:, None] == np.asarray(keys.to_pylist())[None]] = np.inf
        # all as near as the k-th, up to rounding; these are measured again and cut by key
        most = min(k, len(v))
        edge = np.partition(away, most - 1, axis=1)[:, most - 1 :][:, :1]
        size = (q * q).sum(1)[:, None] + (v * v).sum(1)[None]
        who, at = np.nonzero(np.isfinite(away) & (away <= edge + 1e-9 * (1 + size)))
        distance = ((q[who] - v[at]) ** 2).sum(1)
        order = np.lexsort((place[at], distance, who))
        who, at, distance = who[order], at[order], distance[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, at = pa.array(who[first]), pa.array(at[first])
        return pa.table({"query": b.column("query").take(who), "key": keys.take(at), "cell": a.column("cell").take(at), "distance": distance[first]})

    return best


def _ranked(spark: SparkSession, path: str, asked: DataFrame, k: int, other_keys: bool) -> DataFrame:
    """(query, key, cell, distance): the k best of each cell's slice, for asked(query, q, cell). Only the cells that are asked are read."""
    asked = stored(asked, "asked")
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most MOST_CELLS
    rows = _lists(spark, path).filter(F.col("cell").isin(cells)).select("cell", "key", "v")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks"))
    sizes = spark.read.parquet(f"{path}/cells").select("cell", F.ceil(F.col("n") / ROWS).alias("slices"))
    shape = F.broadcast(blocks.join(sizes, "cell"))  # a row for each cell

    def spread(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    left = rows.join(shape, "cell").select("cell", F.pmod(F.xxhash64("key", "v"), F.col("slices")).alias("slice"), spread("blocks").alias("block"), "key", "v")
    right = asked.join(shape.filter("slices > 0"), "cell").select("cell", spread("slices").alias("slice"), F.pmod(F.xxhash64("query"), F.col("blocks")).alias("block"), "query", "q")
    kinds = dict(rows.dtypes)["key"], dict(asked.dtypes)["query"]
    return left.groupBy("cell", "slice", "block").cogroup(right.groupBy("cell", "slice", "block")).applyInArrow(_best(k, other_keys), f"query {kinds[1]}, key {kinds[0]}, cell long, distance double")


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, other_keys: bool = False, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query, rank, key, cell, distance): the k nearest of the rows in the cells that each query probes (as many as the index was tuned for); with other_keys rows of the query's own key are left out."""
    asked = _probed(_vectors(queries, key, column), centres_of(spark, path), probes or probes_of(spark, path))
    return _least(_ranked(spark, path, asked, k, other_keys), k).select("query", "rank", "key", "cell", "distance")


def nearest_exact(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = PROBES, other_keys: bool = False, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The same without a miss: after the first probes all cells within reach of the k-th distance are read."""
    queries, centres = _vectors(queries, key, column), centres_of(spark, path)
    radius = np.array([r.radius for r in spark.read.parquet(f"{path}/cells").orderBy("cell").select("radius").collect()])
    asked = stored(_probed(queries, centres, probes), "probes")
    first = stored(_least(_ranked(spark, path, asked, k, other_keys), k), "first")
    reach = first.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("distance"))).alias("reach"))
    far = queries.select(F.col("key"), "v").join(reach.withColumnRenamed("query", "key"), "key", "left")

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.sqrt(squared(_matrix(batch.column("v"), centres.shape[1]), centres)) - radius[None]
            most = np.array([np.inf if x is None else x for x in batch.column("reach").to_pylist()])
            who, cell = np.nonzero(low <= most[:, None] * (1 + 1e-9) + 1e-6)
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("v").take(at), pa.array(cell, pa.int64())], ["query", "q", "cell"])

    more = far.mapInArrow(within, f"query {dict(queries.dtypes)['key']}, q array<double>, cell long").join(asked.select("query", "cell"), ["query", "cell"], "left_anti")
    found = _ranked(spark, path, more.select("query", "q", "cell"), k, other_keys).unionByName(first.select("query", "key", "cell", "distance"))
    return _least(found, k).select("query", "rank", "key", "cell", "distance")


def nearest_to_each(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query, rank, key, distance): the k nearest rows of another key to each query, without an index.

    Rows go in slices and queries in blocks, and each slice meets each block as one product of matrices, which leaves the
    k best of each query.
    """
    rows, queries = _vectors(rows, key, column), _vectors(queries, key, column)
    slices, blocks = (max(1, -(-x.count() // n)) for x, n in ((rows, ROWS), (queries, QUERIES)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select(F.pmod(F.xxhash64("key", "v"), F.lit(slices)).alias("slice"), all_of(blocks).alias("block"), F.lit(0).cast("long").alias("cell"), "key", "v")
    right = queries.select(all_of(slices).alias("slice"), F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.col("key").alias("query"), F.col("v").alias("q"))
    kind = dict(rows.dtypes)["key"]
    found = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(_best(k, True), f"query {kind}, key {kind}, cell long, distance double")
    return _least(found, k).select("query", "rank", "key", "distance")
