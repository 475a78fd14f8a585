"""Near copies by odd sketches: parities of min-hash samples, compared by exclusive or.

A text's set holds its shingles. BANDS * ROWS min-hashes are taken of it; runs of ROWS of them are its bands, and
all of them are folded into a bitmap of BITS bits, in which each sample turns one bit over. The exclusive or of two
bitmaps is the bitmap of the samples in which they differ, so that its number of ones tells the similarity.
`chances` gives the distribution of that number for every similarity, exactly (a chain over the number of ones). From it
follows, for each number of ones, the highest similarity that is not refuted with a risk of RISK.

Texts that agree on a band at least are candidates (at a similarity of 0.8 all but 5e-8 of pairs). They form crowds
around hubs as in `nearcopies`. The sketches decide which of a crowd are compared with the hub on their whole sets. Those that
the hub does not link are compared with each other: first by their sketches, in tiles, and then only the texts that
have an admitted partner in their tile, on whole sets. A text that is linked to the hub is among them
only if it is near enough to the edge (one minus the similarity is a metric). Every link is confirmed on whole
sets; equal sets count once.

Edge cases: texts with fewer words than a shingle have one; a null text or one without words has an empty set and is
linked with nothing; rows that share a doc_id are separate texts; a null doc_id names a component only if all its
texts lack one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import nearcopies
from loomspark.llm.common import U64, mixed, split_batches, stored, text_bytes
from loomspark.llm.simhash import components

SHINGLE = 2
#: Least similarity, in hundredths.
SIMILAR = 80
BANDS, ROWS = 32, 4
BITS = 256
#: Chance that the sketches hide a link of two candidates.
RISK = 1e-9
TILE = 512
_SALT = np.random.Generator(np.random.PCG64(20240609)).integers(1, 2**63, (3, BANDS * ROWS), dtype=np.uint64) * U64(2) + U64(1)


# --- what a sketch tells ----------------------------------------------------------------------


@cache
def chances(similarities: int = 200) -> np.ndarray:
    """Row s: the chances of 0, 1, ... BITS ones in the exclusive or of two sketches, at a similarity of s / similarities."""
    samples, ones = BANDS * ROWS, np.arange(BITS + 1)
    turned = np.zeros((samples + 1, BITS + 1))
    now = np.zeros(BITS + 1)
    now[0] = 1
    for flips in range(2 * samples + 1):
        if flips % 2 == 0:
            turned[flips // 2] = now
        step = np.zeros(BITS + 1)
        step[1:] += (now * (BITS - ones) / BITS)[:-1]
        step[:-1] += (now * ones / BITS)[1:]
        now = step
    differ = 1 - np.arange(similarities + 1) / similarities
    mix = np.zeros((similarities + 1, samples + 1))
    log_choose = np.concatenate([[0.0], np.cumsum(np.log(np.arange(samples, 0, -1)) - np.log(np.arange(1, samples + 1)))])
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(samples + 1):
            a = np.where(k > 0, k * np.log(differ), 0.0)
            b = np.where(samples - k > 0, (samples - k) * np.log1p(-differ), 0.0)
            mix[:, k] = np.exp(log_choose[k] + a + b)
    return mix @ turned


@cache
def highest() -> np.ndarray:
    """For each number of ones the highest similarity at which so many or more still have a chance over RISK."""
    table = chances()
    upper = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
    open_to = upper > RISK
    last = open_to.shape[0] - 1 - np.argmax(open_to[::-1], axis=0)
    return np.minimum(np.where(open_to.any(axis=0), last, 0) + 1, table.shape[0] - 1) / (table.shape[0] - 1)


def estimate(ones: np.ndarray) -> np.ndarray:
    """The similarity that a number of ones speaks for."""
    share = np.minimum(2 * np.asarray(ones, float) / BITS, 1 - 1e-12)
    return 1 + BITS * np.log1p(-share) / (4 * BANDS * ROWS)


# --- sketches ---------------------------------------------------------------------------------


def sketch(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands and odd sketch of each row's n hashes, as signed longs."""
    bands, odd = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), BITS // 64), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                least = np.minimum.reduceat((hashes ^ _SALT[0, k]) * _SALT[1, k], at)
                bands[some, k // ROWS] = mixed(bands[some, k // ROWS] * U64(31) + least)
                bit = mixed(least ^ _SALT[2, k]) % U64(BITS)
                odd[some, (bit >> U64(6)).astype(np.int64)] ^= U64(1) << (bit & U64(63))
    return bands.view(np.int64), odd.view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, own (digest of the set), n (its size), bands and odd (the sketch) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text"):
                hashes, n = nearcopies.shingle_hashes(*text_bytes(batch.column("text")), SHINGLE)
                sets = nearcopies.distinct_sets(hashes, n)
                bands, odd = sketch(hashes, n)
                own = pa.array([nearcopies.digest(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), own, pa.array([len(s) for s in sets], pa.int64()), _lists(bands), _lists(odd)], ["doc_id", "key", "own", "n", "bands", "odd"])

    return nearcopies.keyed(docs).mapInArrow(run, f"doc_id long, key {nearcopies.KEY}, own binary, n long, bands array<long>, odd array<long>")


def _ones(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(BITS // 64)), F.lit(0))


def _highest(ones: Column, n: Column, m: Column) -> Column:
    """The highest similarity that sketches and sizes of two sets admit."""
    return F.least(F.get(F.lit(highest().tolist()), ones), F.least(n, m) / F.greatest(n, m))


# --- links ------------------------------------------------------------------------------------


def _to_hub(table: pa.Table) -> pa.Table:
    """Sizes of what each text of a tile shares with the hub, which is in it too, and of both together."""
    hub = table.column("hub")[0].as_py()
    own, flat, at = nearcopies.flat_sets(table)
    mine = own.index(hub)
    common = np.diff(np.concatenate([[0], np.cumsum(np.isin(flat, flat[at[mine] : at[mine + 1]]))])[at])
    n = np.diff(at)
    keep = pa.array([x != hub for x in own])
    out = pa.table({"hub": table.column("hub"), "own": table.column("own"), "common": common, "both": n + n[mine] - common})
    return out.filter(keep)


def _admitted(table: pa.Table) -> pa.Table:
    """The texts of a tile that sketches admit as partners of another one there; two that the hub links need no other link."""
    odd = np.asarray(table.column("odd").combine_chunks().flatten()).astype(np.uint64, casting="unsafe").reshape(-1, BITS // 64)
    n, linked = np.asarray(table.column("n")), np.asarray(table.column("linked"))
    top, kept = highest(), np.zeros(len(n), bool)
    for i in range(len(n)):
        ones = np.bitwise_count(odd ^ odd[i]).sum(axis=1)
        near = (top[ones] >= SIMILAR / 100) & (100 * np.minimum(n, n[i]) >= SIMILAR * np.maximum(n, n[i])) & ~(linked & linked[i])
        near[i] = False
        kept[i] = near.any()
    return table.select(["hub", "t", "u", "own"]).filter(pa.array(kept))


def _in_tile(table: pa.Table) -> pa.Table:
    """Links that connect the similar texts of a tile: one less than the texts of each component."""
    own, flat, at = nearcopies.flat_sets(table)
    common, n = nearcopies.overlaps(flat, at).astype(np.int64), np.diff(at)
    near = 100 * common >= SIMILAR * (n[:, None] + n[None] - common)
    seen, a, b = np.zeros(len(own), bool), [], []
    for k in range(len(own)):
        if seen[k]:
            continue
        seen[k] = True
        front = np.array([k])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[front] = True
            a += [own[k]] * len(front)
            b += [own[i] for i in front]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _tile(many: Column) -> Column:
    return F.pmod(F.xxhash64("own"), F.ceil(many / TILE))


def _tiles(many: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(many / TILE) - 1))


def _sets_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """own and shingles of asked(own, key)."""
    asked = stored(asked.select("key").distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() <= nearcopies.BROADCAST_KEYS else asked.hint("merge")
    found = nearcopies.shingle_sets(nearcopies.keyed(docs).join(asked, "key", "left_semi"), SHINGLE)
    return stored(found.groupBy("own").agg(F.first("shingles").alias("shingles")), "sets")


def links(docs: DataFrame, distinct: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all similar texts of each crowd(hub, own); distinct(own, key, n, odd)."""
    mine = distinct.select("own", "n", "odd")
    hubs = crowd.select("hub").distinct().join(mine.select(F.col("own").alias("hub"), F.col("n").alias("hub_n"), F.col("odd").alias("hub_odd")), "hub")
    met = crowd.filter("own != hub").join(mine, "own").join(hubs, "hub")
    met = met.select("hub", "own", "n", "odd", _highest(_ones("odd", "hub_odd"), F.col("n"), F.col("hub_n")).alias("most"))
    met = stored(met, "met")

    near = met.filter(F.col("most") >= SIMILAR / 100).select("hub", "own")
    sets = _sets_of(docs, near.select("own").union(near.select("hub")).distinct().join(distinct.select("own", "key"), "own"))
    sizes = near.groupBy("hub").agg(F.count(F.lit(1)).alias("many"))
    others = near.join(sizes, "hub").select("hub", "own", _tile(F.col("many")).alias("t"))
    themselves = sizes.select("hub", F.col("hub").alias("own"), _tiles(F.col("many")).alias("t"))
    judged = others.union(themselves).join(sets, "own").groupBy("hub", "t").applyInArrow(_to_hub, "hub binary, own binary, common long, both long")
    judged = stored(judged.select("hub", "own", (100 * F.col("common") >= SIMILAR * F.col("both")).alias("linked"), (F.col("common") / F.col("both")).alias("j")), "judged")

    known = met.join(judged, ["hub", "own"], "left").select("hub", "own", "n", "odd", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("j", "most").alias("j"))
    known = stored(known, "known")
    apart = known.filter("not linked").groupBy("hub").agg(F.max("j").alias("nearest"))
    # written down, so that a hub with very many texts can be split in the join
    left = stored(known.join(apart, "hub").filter(~F.col("linked") | (F.col("j") <= F.col("nearest") + (1 - SIMILAR / 100) + 1e-9)).drop("j", "nearest"), "left")
    many = left.groupBy("hub").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    left = left.join(many, "hub").withColumn("t", _tile(F.col("many"))).withColumn("u", _tiles(F.col("many")))
    left = left.select("hub", "own", "n", "odd", "linked", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"))
    admitted = stored(left.repartition("hub", "t", "u").groupBy("hub", "t", "u").applyInArrow(_admitted, "hub binary, t long, u long, own binary"), "admitted")
    more = admitted.select("own").distinct().join(sets.select("own"), "own", "left_anti")
    every = sets.union(_sets_of(docs, more.join(distinct.select("own", "key"), "own")))
    found = admitted.join(every, "own").groupBy("hub", "t", "u").applyInArrow(_in_tile, "a binary, b binary")
    return found.union(judged.filter("linked").select("hub", "own"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the linked documents) of every row of docs(doc_id, text)."""
    table = stored(sketches(docs), "sketches")
    distinct = stored(table.filter("n > 0").groupBy("own").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("bands").alias("bands")), "distinct")
    crowd = nearcopies.crowds(distinct.select("own", "bands"))
    found = components(links(docs, distinct, crowd)).withColumnRenamed("node", "own")
    least = table.filter("n > 0").groupBy("own").agg(F.min("doc_id").alias("least")).join(found, "own", "left").withColumn("root", F.coalesce("root", "own"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = least.join(named, "root").select("own", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return table.select("doc_id", "own", "n").join(of, "own", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def op11_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
