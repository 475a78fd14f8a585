"""Keyword, vector and hybrid search.

Scores are rounded where they are returned. Vectors are compared by squared Euclidean distance;
normalise them first for cosine order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import stored

#: Parameters of BM25.
K1, B = 1.2, 0.75
#: Parts over which the postings of a token are dealt.
PARTS = 64


def words_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def keyword_scan(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which any word of the query is a part of the columns joined by blanks, in any case."""
    text = F.lower(F.concat_ws(" ", *columns))
    return rows.filter(reduce(lambda a, b: a | b, [text.contains(w) for w in words_of(query)], F.lit(False)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, tokens, tfs): each document's distinct tokens and how often it holds them, counted where its text is read."""
    cut = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").cast("long").alias("dl"), F.coalesce("t", F.array().cast("array<string>")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            words = lists.flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            n = max(len(words.dictionary), 1)
            pairs, often = np.unique(doc * n + words.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * n), pa.int32())
            held = words.dictionary.take(pa.array(pairs % n))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("dl"), pa.ListArray.from_arrays(ends, held), pa.ListArray.from_arrays(ends, pa.array(often, pa.int64()))], [key, "dl", "tokens", "tfs"])

    return cut.mapInArrow(run, f"`{key}` {dict(cut.dtypes)[key]}, dl long, tokens array<string>, tfs array<long>")


def inverted_index(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (token, key, tf) and lengths (key, dl); tokens are counted before they are shuffled."""
    cut = docs.select(key, tokens(F.col(text)).alias("t"))
    return cut.select(key, F.explode("t").alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf")), cut.select(key, F.size("t").cast("long").alias("dl"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of all documents with a query word. Only the query's words are counted; one pass gives the corpus' figures, one the scores."""
    words = words_of(query)
    cut = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), "t")
    counted = cut.select(key, "dl", *[_count(w).alias(f"tf{i}") for i, w in enumerate(words)])
    facts = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(facts.avgdl or 1.0))
    parts = [math.log(1 + (facts.n_docs - facts[f"df{i}"] + 0.5) / (facts[f"df{i}"] + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(words))]
    score = reduce(lambda x, y: x + y, parts)
    return counted.filter(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(words))])).select(key, F.round(score, 6).alias("score"))


def save_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Stores what BM25 needs: postings (token, key, tf, dl) ordered by token within files, and the corpus' figures.

    Texts are cut once, and postings shuffled once, a frequent token's in parts.
    """
    cut = stored(counted(docs, key, text), "counted")
    postings = cut.select(key, "dl", F.explode(F.arrays_zip("tokens", "tfs")).alias("e")).select(F.col("e.tokens").alias("token"), key, F.col("e.tfs").alias("tf"), "dl")
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    postings.repartition("token", part).sortWithinPartitions("token", key).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    cut.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/figures")


def indexed_bm25(spark: SparkSession, path: str, key: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """The scores of `bm25` from a stored index: only the postings of the query's tokens are read."""
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("token").isin(words_of(query)))
    figures = spark.read.parquet(f"{path}/figures").first()
    df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(figures.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(figures.avgdl or 1.0))
    scored = rows.join(F.broadcast(df), "token").withColumn("part", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm))
    return scored.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"))


MODES = ("keyword", "vector", "hybrid")


def search(rows: DataFrame, query: str, vector: list[float] | None = None, mode: str = "hybrid", limit: int = 10, page: int = 1, text: list[str] | None = None, name: str = "name", key: str = "node_id", column: str = "embedding") -> DataFrame:
    """One page of (key, rank, score) of rows, best first: by BM25 over the text columns, by nearness (score is the distance), or by both."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if limit < 1 or page < 1:
        raise ValueError("limit and page start at 1")
    if mode != "keyword" and vector is None:
        raise ValueError("a vector is needed")
    text, n = text or ["content", "name", "description"], limit * page
    if mode == "keyword":
        found = bm25(rows.select(key, F.concat_ws(" ", *text).alias("text")), key, "text", query).orderBy(F.desc("score"), key).limit(n)
        order = [F.desc("score"), F.col(key)]
    elif mode == "vector":
        found = nearest(rows, vector, n, key, column).select(key, F.round("distance", 6).alias("score"))
        order = [F.col("score"), F.col(key)]
    else:
        found = hybrid(rows, query, vector, n, text, name, key, column).select(key, "score")
        order = [F.desc("score"), F.col(key)]
    # At most limit * page rows are left, so one window is small.
    ranked_rows = found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return ranked_rows.filter(F.col("rank") > n - limit).select(key, "rank", "score")


def _count(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word))


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    return vectors.withColumn("distance", distance(F.col(column), q)).orderBy("distance", key).limit(k)


def hybrid(rows: DataFrame, query: str, vector: list[float], k: int, text: list[str], name: str, key: str = "node_id", column: str = "embedding", vector_weight: float = 0.7) -> DataFrame:
    """The k best of the min(3k, 100) nearest rows, by 0.7 vector and 0.3 keyword score.

    Keyword score: 10 for the whole phrase, 1 for each word in the text, 2 more for each in the
    name; both scores are divided by their largest among the candidates.
    """
    near = nearest(rows, vector, min(3 * k, 100), key, column)
    low, title = F.lower(F.concat_ws(" ", *text)), F.lower(F.coalesce(name, F.lit("")))
    words = query.lower().split()
    parts = [F.when(low.contains(query.lower()), 10.0).otherwise(0.0)] + [F.when(low.contains(w), 1.0).otherwise(0.0) + F.when(title.contains(w), 2.0).otherwise(0.0) for w in words]
    scored = near.withColumn("keyword", reduce(lambda a, b: a + b, parts))
    every = Window.partitionBy()
    most = {c: F.max(c).over(every) for c in ("distance", "keyword")}
    share = {c: F.col(c) / F.when(most[c] > 0, most[c]).otherwise(1.0) for c in most}
    scored = scored.withColumn("score", F.round(vector_weight * (1 - share["distance"]) + (1 - vector_weight) * share["keyword"], 6))
    return scored.orderBy(F.desc("score"), key).limit(k)


def normalised(column: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    size = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(column, lambda x: (x / size).cast("float"))).otherwise(column)


def text_to_embed(description: Column, content: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(description), F.lit("")), content)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic bag-of-words vector of unit length, for use where no model is given."""
    cells = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return normalised(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("float")))
