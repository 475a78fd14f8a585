"""Near copies by the similarity of their sets of shingles (runs of five lower-case words).

Two texts are linked if the shingles that they share are at least SIMILARITY of all that they have.
Candidates come from SimHash fingerprints of the shingles, which generalised pigeonhole (`simhash`) links at
MOST or fewer differing bits: that loses no pair within these bits, but most pairs of a similarity near SIMILARITY are farther
apart. So texts that agree on all min-hashes of one band at least are candidates too: at a similarity of exactly 0.8 a pair is
one with a probability of 1 - (1 - 0.8**4)**20 = 0.99997, above that with more. Every
candidate is then compared on its whole sets. Texts with equal sets count once.

The texts that agree on a band, or whose fingerprints are linked, form a group, and its hub is the text that meets most others in all
bands (of a text and its copies mostly the text itself). Groups with one hub are one crowd, in
which all are compared with the hub, which takes as many comparisons as texts. One minus the
similarity is a metric; so a text linked to the hub can be linked to one that is not
only if it is at most 1 - SIMILARITY nearer to the hub. Only those, and what is not linked, are
compared with each other, in tiles of a bounded size, from which only links that connect leave. No link
between candidates is lost. (A crowd of K texts that are like none of each other's still takes
K * K / 2 comparisons, spread over (K / TILE) ** 2 / 2 tiles.)

Edge cases: texts without words are equal to each other; texts under five words have one shingle;
a null doc_id links others, but its rows always stay; rows that share a doc_id are separate texts,
of which equal ones count as one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import U64, Sums, mixed, split_batches, stored, text_bytes, within, word_hashes, word_spans
from loomspark.llm import simhash
from loomspark.llm.simhash import _LOWER, components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Texts of a crowd that are compared at once.
TILE = 512
#: Texts whose keys (longs) are still broadcast, rather than shuffling all texts.
BROADCAST_KEYS = 1_000_000
_SALT = np.random.Generator(np.random.PCG64(20240608)).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * U64(2) + U64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and how many each row has."""
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    head = within(first[:-1], n)
    tail = np.minimum(head + words, np.repeat(first[1:], n))
    return Sums(word_hashes(_LOWER[data], starts, ends), 1).of(head, tail), n


def distinct_sets(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(n)
    return [np.unique(hashes[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def _bands(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), BANDS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                least = np.minimum.reduceat((hashes ^ _SALT[0, k]) * _SALT[1, k], at)
                out[some, k // ROWS] = mixed(out[some, k // ROWS] * U64(31) + least)
    return out.view(np.int64)


#: What names a row: 128 bits of its doc_id and text.
KEY = "struct<a: long, b: long>"


def _key():
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", _key())


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of doc_id and text), own (of the set of shingles), its size n, the bands and the fingerprint fp of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text"):
                data, at = text_bytes(batch.column("text"))
                hashes, n = shingle_hashes(data, at)
                sets = distinct_sets(hashes, n)
                fp = simhash._fingerprints(data, at, SHINGLE).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, pa.array(_bands(hashes, n).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), bands, pa.array(fp)], ["doc_id", "key", "own", "n", "bands", "fp"])

    return keyed(docs).mapInArrow(run, f"doc_id long, key {KEY}, own binary, n long, bands array<long>, fp long")


def shingle_sets(texts: DataFrame, words: int = SHINGLE) -> DataFrame:
    """own and the set of shingles of texts(text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text"):
                sets = distinct_sets(*shingle_hashes(*text_bytes(batch.column("text")), words))
                at = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))], ["own", "shingles"])

    return texts.select("text").mapInArrow(run, "own binary, shingles array<long>")


def flat_sets(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Names, all shingles in a row, and where each text's begin."""
    lists = table.column("shingles").combine_chunks()
    at = np.asarray(lists.offsets, np.int64)
    return table.column("own").to_pylist(), np.asarray(lists.flatten()), at - at[0]


def _to_hub(table: pa.Table) -> pa.Table:
    """Similarity of each text of a tile to the hub, which is in it too."""
    hub = table.column("hub")[0].as_py()
    own, flat, at = flat_sets(table)
    mine = own.index(hub)
    common = np.diff(np.concatenate([[0], np.cumsum(np.isin(flat, flat[at[mine] : at[mine + 1]]))])[at])
    n = np.diff(at)
    j = common / np.maximum(n + n[mine] - common, 1)
    keep = np.array([x != hub for x in own])
    return pa.table({"hub": table.column("hub").filter(pa.array(keep)), "own": table.column("own").filter(pa.array(keep)), "j": j[keep]})


def overlaps(flat: np.ndarray, at: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many shingles each two of the sets share."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    some = count[code] > 1
    of, code = of[some], shared[code[some]]
    out = np.zeros((len(at) - 1, len(at) - 1), np.float32)
    order = np.argsort(code, kind="stable")
    of, code = of[order], code[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        a, b = np.searchsorted(code, [first, first + columns])
        held = np.zeros((len(at) - 1, columns), np.float32)
        held[of[a:b], code[a:b] - first] = 1
        out += held @ held.T
    return out


def _in_tile(table: pa.Table) -> pa.Table:
    """Links (a, b) that connect the similar texts of a tile: one less than the texts of each component."""
    own, flat, at = flat_sets(table)
    common, n = overlaps(flat, at), np.diff(at)
    near = common >= SIMILARITY * (n[:, None] + n[None] - common) - 1e-6
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


def with_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct(own, bands, fp) with one more band: the component of the fingerprint within MOST bits."""
    fps = distinct.select("fp").distinct()
    found = components(simhash.links(fps, simhash.plan_groups(fps))).withColumnRenamed("node", "fp")
    joined = distinct.join(found, "fp", "left")
    return joined.withColumn("bands", F.concat("bands", F.array(F.coalesce("root", "fp")))).drop("fp", "root")


def crowds(distinct: DataFrame) -> DataFrame:
    """(hub, own) of the texts of each crowd, hubs too, from distinct(own, bands)."""
    met = distinct.select("own", F.posexplode("bands").alias("band", "v")).select(F.xxhash64("band", "v").alias("g"), "own")
    sizes = met.groupBy("g").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = stored(met.join(sizes, "g"), "members")
    weight = members.groupBy("own").agg(F.sum("many").alias("weight"))
    hubs = members.join(weight, "own").groupBy("g").agg(F.max(F.struct("weight", "own"))["own"].alias("hub"))
    return stored(members.join(hubs, "g").select("hub", "own").distinct(), "crowds")


def links(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all texts of each crowd(hub, own) that are similar; sets(own, shingles)."""

    def tile(many):
        return F.pmod(F.xxhash64("own"), F.ceil(many / TILE))

    sizes = crowd.groupBy("hub").agg(F.count(F.lit(1)).alias("many"))
    others = crowd.filter("own != hub").join(sizes, "hub").select("hub", "own", tile(F.col("many")).alias("t"))
    themselves = sizes.select("hub", F.col("hub").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("many") / TILE) - 1)).alias("t"))
    judged = others.union(themselves).join(sets, "own").groupBy("hub", "t").applyInArrow(_to_hub, "hub binary, own binary, j double")
    judged = stored(judged, "judged")
    apart = judged.filter(F.col("j") < SIMILARITY).groupBy("hub").agg(F.max("j").alias("nearest"))
    left = judged.join(apart, "hub").filter((F.col("j") < SIMILARITY) | (F.col("j") <= F.col("nearest") + (1 - SIMILARITY) + 1e-9)).select("hub", "own")
    many = left.groupBy("hub").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    left = left.join(many, "hub").withColumn("t", tile(F.col("many"))).withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("many") / TILE) - 1)))
    left = left.select("hub", "own", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"))
    near = left.join(sets, "own").groupBy("hub", "t", "u").applyInArrow(_in_tile, "a binary, b binary")
    return near.union(judged.filter(F.col("j") >= SIMILARITY).select("hub", "own"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, key and root (the same for linked texts) of every row of docs."""
    table = stored(sketches(docs), "sketches")
    distinct = stored(table.groupBy("own").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "distinct")
    distinct = stored(with_fingerprints(distinct), "distinct")
    crowd = crowds(distinct)
    asked = stored(crowd.select("own").distinct().join(distinct.select("own", "key"), "own").select("key"), "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked.hint("merge")
    sets = stored(shingle_sets(keyed(docs).join(asked, "key", "left_semi")).groupBy("own").agg(F.first("shingles").alias("shingles")), "sets")
    found = components(links(crowd, sets))
    return table.join(found.withColumnRenamed("node", "own"), "own", "left").select("doc_id", "key", F.coalesce("root", "own").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of the rows of linked texts the one with the smallest doc_id; rows without a doc_id stay."""
    least = groups(docs).filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    kept = least.select(F.col("least.key").alias("x_key"))
    known = docs.filter("doc_id is not null").withColumn("x_key", _key()).join(kept.hint("merge"), "x_key", "left_semi").dropDuplicates(["x_key"]).drop("x_key")
    return known.unionByName(docs.filter("doc_id is null"))
