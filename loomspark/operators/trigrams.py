"""A stored index of character n-grams that answers substring, regular expression and subsequence searches.

Texts are dealt over blocks (a folder each) and numbered there. Postings are lists: which numbers of a block hold a gram of one to
three characters of the lower-case text. A search becomes a formula over grams that every match must satisfy: the grams of a
substring, the literals of a regular expression that cannot be left out (`needed_by_pattern`), the single
characters of a subsequence. Of grams that are all needed the RAREST are enough. Texts that satisfy the formula are
candidates; only blocks with one are read, and their texts are tested as the search says. A pattern without
needed literals makes every text a candidate.

Grams of patterns are ASCII only, so that case rules of other letters can lose nothing. Edge cases: null texts
match nothing; an empty substring matches every text; rows that share a key are separate rows; an ill-formed pattern raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.catalog import subsequence_pattern
from loomspark.sources.scratch import stored

SIZES = (1, 2, 3)
#: Texts of a block; beyond so many blocks, short texts are put together up to so many characters a block.
BLOCK, BLOCKS, BLOCK_CHARS = 2000, 256, 4_000_000
#: Characters of texts whose grams are sorted at once, and texts whose lists of a gram one task writes.
CHARS, TOGETHER = 2_000_000, 512_000
#: Grams of a conjunction that are looked up.
RAREST = 6

#: A formula: True (no condition), a gram, or a conjunction or disjunction of formulas.
Formula = bool | str | tuple


# --- what a search needs ----------------------------------------------------------------------


def both(parts: Iterable[Formula]) -> Formula:
    found = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not found else found[0] if len(found) == 1 else ("and", *found)


def either(parts: Iterable[Formula]) -> Formula:
    found = list(dict.fromkeys(parts))
    return True if True in found or not found else found[0] if len(found) == 1 else ("or", *found)


def grams_of(text: str, ascii_only: bool = False) -> Formula:
    """The grams that every text holding this one holds: its longest ones, and shorter ones only where it is short."""
    text = text.lower()
    pieces = re.findall(r"[\x00-\x7f]+", text) if ascii_only else [text]
    out: list[Formula] = []
    for p in pieces:
        size = min(len(p), SIZES[-1])
        out += [p[i : i + size] for i in range(len(p) - size + 1)] if size else []
    return both(out)


def needed_by_pattern(pattern: str) -> Formula:
    """What every text with a match of a regular expression holds, whatever its case."""

    def walk(items) -> Formula:
        parts: list[Formula] = []
        run = ""

        def flush() -> None:
            nonlocal run
            parts.append(grams_of(run, True))
            run = ""

        for kind, value in items:
            if kind is op.LITERAL:
                run += chr(value)
                continue
            if kind is op.SUBPATTERN and all(k is op.LITERAL for k, _ in value[3]):
                run += "".join(chr(v) for _, v in value[3])
                continue
            if kind is op.AT:
                continue  # an anchor takes no characters
            flush()
            if kind is op.SUBPATTERN:
                parts.append(walk(value[3]))
            elif kind is op.BRANCH:
                parts.append(either(walk(x) for x in value[1]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                parts.append(walk(value[2]))
            elif kind is op.ATOMIC_GROUP:
                parts.append(walk(value))
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
                parts.append(either(grams_of(chr(v), True) for _, v in value))
        flush()
        return both(parts)

    return walk(parser.parse(pattern))


def needed_by_subsequence(name: str) -> Formula:
    return both(dict.fromkeys(name.lower()))


def grams_in(formula: Formula) -> list[str]:
    if formula is True:
        return []
    return [formula] if isinstance(formula, str) else list(dict.fromkeys(g for part in formula[1:] for g in grams_in(part)))


def thinned(formula: Formula, often: dict[str, int], most: int = RAREST) -> Formula:
    """The formula with conjunctions cut to the grams that fewest texts hold, which can only admit more."""
    if formula is True or isinstance(formula, str):
        return formula
    parts = [thinned(p, often, most) for p in formula[1:]]
    if formula[0] == "or":
        return either(parts)
    words = sorted((p for p in parts if isinstance(p, str)), key=lambda g: (often.get(g, 0), g))
    return both([p for p in parts if not isinstance(p, str)] + words[:most])


def holds(formula: Formula, have: Column) -> Column:
    """The formula over an array of the grams that a text has."""
    if formula is True:
        return F.lit(True)
    if isinstance(formula, str):
        return F.array_contains(have, formula)
    return reduce((lambda a, b: a & b) if formula[0] == "and" else (lambda a, b: a | b), [holds(p, have) for p in formula[1:]])


# --- the stored index -------------------------------------------------------------------------


def grams_held(codes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams of a size of texts laid end to end: grams in order, which one each posting is of, and its text.

    codes are code points and doc the ascending number of the text of each. A gram and its text are one number, so that one sort
    gives the postings.
    """
    n = max(len(codes) - size + 1, 0)
    here = np.flatnonzero(doc[:n] == doc[size - 1 :][:n])
    if not len(here):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.flatnonzero(np.bincount(codes))
    rank = np.zeros(letters[-1] + 1, np.int64)
    rank[letters] = np.arange(len(letters))
    if len(letters) ** size * n_docs >= 2**63 and n_docs > 1:  # very many characters: halves of the texts
        half = int(doc[-1]) + 1 - n_docs // 2
        parts = [grams_held(codes[keep], doc[keep], size=size, n_docs=k) for keep, k in ((doc < half, n_docs - n_docs // 2), (doc >= half, n_docs // 2))]
        return parts[0][0] + parts[1][0], np.concatenate([parts[0][1], parts[1][1] + len(parts[0][0])]), np.concatenate([parts[0][2], parts[1][2]])
    first = int(doc[0])
    ranks, number = rank[codes], np.zeros(len(here), np.int64)
    for i in range(size):
        number = number * len(letters) + ranks[here + i]
    number = number * n_docs + (doc[here] - first)
    number.sort()
    number = number[np.concatenate([[True], number[1:] != number[:-1]])]
    gram, text = np.divmod(number, n_docs)
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gram))))
    each, spelled = gram[starts], np.empty((len(starts), size), "<u4")
    for i in reversed(range(size)):
        each, last = np.divmod(each, len(letters))
        spelled[:, i] = letters[last]
    whole = spelled.tobytes().decode("utf-32-le")
    return [whole[k : k + size] for k in range(0, len(whole), size)], which, text + first


def _postings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """gram, block and the places in it of the texts that hold the gram, of a batch of texts; CHARS at a time."""
    texts, blocks, places = batch.column("low").to_pylist(), batch.column("block").to_numpy(), batch.column("at").to_numpy()
    lengths, order = np.array([len(t) for t in texts], np.int64), np.argsort(blocks, kind="stable")
    share = np.cumsum(lengths[order]) // CHARS
    for few in np.split(order, np.flatnonzero(np.diff(share)) + 1):
        codes = np.frombuffer("".join([texts[i] for i in few]).encode("utf-32-le"), "<u4")
        doc = np.repeat(np.arange(len(few)), lengths[few])
        for size in SIZES:
            grams, which, text = grams_held(codes, doc, len(few), size)
            if not grams:
                continue
            block = blocks[few][text]
            starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])]))
            at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(text)), pa.int32()), pa.array(places[few][text], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(grams).take(pa.array(which[starts])), pa.array(block[starts], pa.int64()), at], ["gram", "block", "at"])


def save_index(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Writes texts (a folder for each block, numbered in it), postings (gram, block, numbers; ordered by gram) and how many texts hold each gram.

    Postings are made as lists where the texts are read, so that what is shuffled is about a number for each gram of a text.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    count = rows.count()
    blocks = max(1, -(-count // BLOCK))
    if blocks > BLOCKS:  # a folder each: very many small ones take longer to write and list than their texts do
        blocks = min(blocks, max(BLOCKS, -(-rows.agg(F.sum(F.length("text"))).first()[0] // BLOCK_CHARS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("key", "text")))
    numbered.write.mode("overwrite").partitionBy("block").parquet(f"{path}/texts")
    spark.createDataFrame([(dict(rows.dtypes)["key"],)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
    low = _texts(spark, path).select("block", "at", F.lower("text").alias("low"))
    cut = low.mapInArrow(lambda batches: (out for batch in batches for out in _postings(batch)), "gram string, block long, at array<int>")
    near = F.floor(F.col("block") / max(1, TOGETHER * blocks // max(1, count)))  # a task has the lists of a gram for so many texts
    cut.repartition("gram", near).sortWithinPartitions("gram", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    counted = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("at").cast("long")).alias("n"))
    counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/often")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/kind").first().kind
    return spark.read.schema(f"key {kind}, text string, at int, block long").parquet(f"{path}/texts")


def candidates(spark: SparkSession, path: str, formula: Formula) -> DataFrame | None:
    """(block, at) of the texts that satisfy a formula; None if it has no condition."""
    if formula is True:
        return None
    asked = grams_in(formula)
    often = {r.gram: r.n for r in spark.read.parquet(f"{path}/often").filter(F.col("gram").isin(asked)).collect()}
    formula = thinned(formula, often)
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(grams_in(formula))).select("gram", "block", F.explode("at").alias("at"))
    return rows.groupBy("block", "at").agg(F.collect_set("gram").alias("have")).filter(holds(formula, F.col("have"))).select("block", "at")


def matches(spark: SparkSession, path: str, formula: Formula, test: Column) -> DataFrame:
    """(key, text) of the texts that pass the test; only blocks with a candidate are read."""
    found = candidates(spark, path, formula)
    texts = _texts(spark, path)
    if found is None:
        return texts.filter(test).select("key", "text")
    found = stored(found, "candidates")
    blocks = [r.block for r in found.select("block").distinct().orderBy("block").limit(10_001).collect()]
    if len(blocks) <= 10_000:  # else the join alone chooses the rows
        texts = texts.filter(F.col("block").isin(blocks))
    return texts.join(found, ["block", "at"], "left_semi").filter(test).select("key", "text")


def containing(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Texts that hold any of the words, in any case."""
    low = F.lower("text")
    test = reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words], F.lit(False))
    return matches(spark, path, either(grams_of(w) for w in words), test) if words else _texts(spark, path).limit(0).select("key", "text")


def matching(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Texts with a match of a regular expression."""
    return matches(spark, path, needed_by_pattern(pattern), F.col("text").rlike(pattern))


def with_subsequence(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Texts that hold the characters of a name in its order, in any case."""
    return matches(spark, path, needed_by_subsequence(name), F.lower("text").rlike(subsequence_pattern(name.lower())))
