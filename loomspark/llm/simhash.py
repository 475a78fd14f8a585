"""SimHash near-duplicates by generalised pigeonhole over groups of correlated bits.

Two 64-bit fingerprints are linked at MOST or fewer differing bits. The bits are split into m
groups with thresholds t_1..t_m that add up to MOST - m + 1; then any linked pair is within t_i
on the bits of some group i (a threshold of -1 leaves a group out). Correlated bits go into the
same group, m and the thresholds come from a dynamic programme over estimated costs, and every
candidate pair is verified on all bits.

Only different fingerprints are compared, so a group of equal texts counts once. A group of
bits whose value is shared by very many fingerprints is not compared pair by pair: each of its
fingerprints is sent to the 65 values within one bit of it, and those that meet at a value are
within two bits of each other; one link to the smallest there keeps them connected. That is
exact for MOST = 2 and takes 65 rows per fingerprint. (Other distances have no such step.)

Edge cases: a null text or one without words has fingerprint zero and is linked like any other;
rows with the same doc_id are separate documents; a null doc_id never names a component unless
all its documents lack one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import split_batches, stored, text_bytes, within, word_spans

SHINGLE = 3
SEED = 42
MOST = 2
#: Fingerprints of one index key that are still compared pair by pair.
PAIRWISE = 64
#: Fingerprints from which the candidate counts are estimated (a share chosen by hash).
ESTIMATE_ROWS = 200_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    sizes = ends - starts
    put = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int(put[-1] + sizes[-1] + 1), 32, np.uint8)
    joined[within(put, sizes)] = _LOWER[data[within(starts, sizes)]]
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    head = within(first[:-1], n)
    tail = np.minimum(head + shingle, np.repeat(first[1:], n)) - 1
    text, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(put[head].tolist(), (put[tail] + sizes[tail]).tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(n)
    set_in = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
    packed = np.packbits(2 * set_in > n[some][:, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batches(whole, "text"):
                fp = _fingerprints(*text_bytes(batch.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# --- the plan of bit groups -------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits that are set together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column("fp")).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for first in range(0, len(bits), 1 << 16):
                part = bits[first : first + (1 << 16)]
                total += part.T @ part
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"at": np.arange(4097), "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(4097)
    for r in rows:
        counts[r.at] = r.n
    return int(counts[4096]), counts[:4096].reshape(64, 64)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each starts with the most correlated pair left and takes the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        free = sorted(left)
        sub = corr[np.ix_(free, free)]
        group = [free[i] for i in np.unravel_index(int(sub.argmax()), sub.shape)] if size > 1 else free[:1]
        group = list(dict.fromkeys(group))
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(corr[np.ix_(rest, group)].sum(axis=1).argmax())])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def ball(width: int, radius: int) -> int:
    return 0 if radius < 0 else 1 + (width if radius >= 1 else 0) + (width * (width - 1) // 2 if radius >= 2 else 0)


def best_thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one per group, that add up to total (dynamic programme over groups and sums)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in group.items():
                if used + t not in step or cost + more < step[used + t][0]:
                    step[used + t] = (cost + more, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan_groups(fps: DataFrame, estimate_rows: int = ESTIMATE_ROWS) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds (groups left out are omitted)."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) ** 2, 0.5, 1)
    odds = (1 - agree) / agree
    options = {m: correlated_groups(n, both, m) for m in range(2, MOST + 3)}
    share = max(1, n // estimate_rows)
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)
    keys = [F.struct(F.lit(m * 100 + i).alias("g"), projected(F.col("fp"), bits).alias("v")) for m, groups in options.items() for i, bits in enumerate(groups)]
    met = sample.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.g", "k.v").count()
    same = {r.g: r.pairs * share * share for r in met.groupBy("g").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    found = []
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            o = odds[bits]
            near = [1.0, 1 + o.sum(), 1 + o.sum() + (o.sum() ** 2 - (o**2).sum()) / 2]
            pairs = max(same.get(m * 100 + i, 0.0), n * n / 2 * float(np.prod(agree[bits])))
            costs.append({t: 0.0 if t < 0 else n * (1.0 + ball(len(bits), t)) + pairs * near[t] for t in range(-1, MOST + 1)})
        cost, chosen = best_thresholds(costs, MOST - m + 1)
        found.append((cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def projected(fp, bits: list[int]):
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- links and components ---------------------------------------------------------------------


def links(fps: DataFrame, plan: list[tuple[list[int], int]], pairwise: int = PAIRWISE) -> DataFrame:
    """Pairs (a, b) of different fingerprints of fps(fp) that connect all pairs within MOST bits."""
    index = [F.struct(F.lit(i).alias("g"), projected(F.col("fp"), bits).alias("v")) for i, (bits, _) in enumerate(plan)]
    probe = []
    for i, (bits, t) in enumerate(plan):
        for r in range(1, t + 1):
            for flip in combinations(bits, r):
                probe.append(F.struct(F.lit(i).alias("g"), projected(F.col("fp"), bits).bitwiseXOR(F.lit(_signed(sum(1 << b for b in flip)))).alias("v")))
    indexed = fps.select("fp", F.explode(F.array(*index)).alias("k")).select("k.g", "k.v", "fp")
    counts = indexed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    asked = fps.select("fp", F.explode(F.array(*index, *probe)).alias("k")).select("k.g", "k.v", "fp") if probe else indexed
    asked = asked.join(counts.filter("n > 1") if not probe else counts, ["g", "v"])
    few, many = asked.filter(F.col("n") <= pairwise), asked.filter(F.col("n") > pairwise)
    pairs = few.select("g", "v", F.col("fp").alias("a")).join(indexed.withColumnRenamed("fp", "b"), ["g", "v"])
    near = pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST)).select("a", "b")
    around = many.select("fp").distinct().select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))) as v"))
    centres = around.groupBy("v").agg(F.min("fp").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = around.join(centres, "v").filter("fp != c").select(F.col("fp").alias("a"), F.col("c").alias("b"))
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Alternating star contraction: nodes hang larger neighbours below the smallest node they know,
    until all edges are stars. Each round is a few joins and ends in a table on shared storage.
    """
    state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if mark == (now.n, now.h, now.s) or not now.n:
            break
        mark = (now.n, now.h, now.s)
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        state = stored(small, "edges")
    return state.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the linked documents) of every row of docs."""
    table = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), plan_groups(distinct)))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")



def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, equal rows once; other texts with that doc_id stay, as do rows without a doc_id."""
    kept = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.filter("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.filter("doc_id is null"))
