"""Segmented postings with block maxima: top-k keyword search that skips blocks, with additions, deletions and merges.

An index is a folder of segments. In a segment each document belongs to a range of about RANGE documents of like length,
and a token's postings of one range are a block: arrays of keys, counts and lengths, with a header of the largest count
and the least length, from which the most that the block can add to a score follows for any figures of the corpus.

A search reads headers first (`headers`). Blocks of the best bounds give a score that k documents reach at least; a range
whose blocks' bounds together stay below it holds no result, so only the blocks of the other ranges are read
(`chosen`). A document of a kept range has all its blocks there, so its score is whole.

Documents are added as a segment of their own. Deletions are rows beside the segments: which documents, and how often each
token goes with them, so that figures stay exact. A merge writes the living documents as one segment. Which segments
live is said by the manifest of the highest version, written last; a version that was not finished is not seen.

Edge cases: a null text has no tokens but counts as a document; keys are unique among living documents (an added key that
lives already replaces the older document); equal scores go by key; words are counted once in a query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.search import K1, B, tokens, words_of
from loomspark.sources.scratch import stored

#: Documents of a range.
RANGE = 128
#: Best blocks of each token that are read to find a score that k documents reach.
SCOUTS = 4


class Index:
    """A stored index of documents (key, text)."""

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B):
        self.spark, self.path, self.k1, self.b = spark, path, k1, b

    # --- what lives ---

    @classmethod
    def create(cls, docs: DataFrame, path: str, key: str, text: str) -> Index:
        index = cls(docs.sparkSession, path)
        index._segment(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), 1)
        index._publish(1, [1])
        return index

    def manifest(self) -> tuple[int, list[int]]:
        rows = self.spark.read.parquet(f"{self.path}/manifest")
        last = rows.orderBy(F.desc("version")).first()
        return last.version, list(last.segments)

    def _publish(self, version: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(version, segments)], "version long, segments array<long>").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, kind: str) -> DataFrame:
        """Rows of a part of the living segments."""
        _, segments = self.manifest()
        paths = [f"{self.path}/segment={s}/{kind}" for s in segments]
        return self.spark.read.option("basePath", self.path).parquet(*paths)

    def _gone(self, kind: str) -> DataFrame | None:
        """Rows of what deletions up to this version took from living segments."""
        version, segments = self.manifest()
        made = [r.version for r in self.spark.read.parquet(f"{self.path}/manifest").select("version").distinct().collect()]
        found = [v for v in made if v <= version and self._has_deletions(v)]
        if not found:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/deleted/{kind}/version={v}" for v in found])
        return rows.filter(F.col("segment").isin(segments))

    def _has_deletions(self, version: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/deleted/tokens/version={version}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    # --- changes ---

    def _segment(self, docs: DataFrame, number: int) -> None:
        """Writes the blocks, documents and figures of a segment of docs(key, text)."""
        cut = docs.select("key", F.sort_array(tokens(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("t")).withColumn("dl", F.size("t"))
        # tokens are counted within their document, as runs of the sorted ones, so that only postings are shuffled
        first = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
        runs = cut.withColumn("at", F.when(F.col("dl") > 0, first).otherwise(F.array().cast("array<int>")))
        token, often = F.transform("at", lambda i: F.get("t", i)), F.transform("at", lambda i, k: (F.coalesce(F.get("at", k + 1), F.col("dl")) - i).cast("long"))
        self._write(stored(runs.select("key", F.col("dl").cast("long").alias("dl"), token.alias("tokens"), often.alias("tfs")), "counted"), number)

    def _write(self, docs: DataFrame, number: int) -> None:
        """A segment of docs(key, dl, tokens, tfs), which are read from tables: postings are shuffled once, by the ranges of their blocks."""
        size_class = F.floor(2 * F.log2(F.col("dl") + 1))
        classes = docs.groupBy(size_class.alias("size_class")).agg(F.ceil(F.count(F.lit(1)) / RANGE).alias("ranges"))  # a row for each class of lengths
        ranged = docs.withColumn("size_class", size_class).join(F.broadcast(classes), "size_class").withColumn("range", F.col("size_class") * 2**40 + F.pmod(F.xxhash64("key"), F.col("ranges")))
        where = f"{self.path}/segment={number}"
        ranged.select("key", "dl", "range", "tokens", "tfs").write.mode("overwrite").option("compression", "zstd").parquet(f"{where}/docs")
        rows = self.spark.read.parquet(f"{where}/docs").select("key", "dl", "range", F.explode(F.arrays_zip("tokens", "tfs")).alias("e"))
        counted = rows.select(F.col("e.tokens").alias("token"), "range", "key", F.col("e.tfs").alias("tf"), "dl").repartitionByRange("token", "range")
        # a block holds at most the documents of a range
        entries = F.array_sort(F.collect_list(F.struct("key", "tf", "dl")))
        blocks = counted.groupBy("token", "range").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), entries.alias("entries"))
        blocks.sortWithinPartitions("token", "range").write.mode("overwrite").option("compression", "zstd").parquet(f"{where}/blocks")
        docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{where}/figures")

    def living(self) -> DataFrame:
        """key, dl, range, tokens, tfs (how often each) and segment of the documents that live."""
        docs, gone = self._read("docs"), self._gone("docs")
        return docs if gone is None else docs.join(gone.select("segment", "key"), ["segment", "key"], "left_anti")

    def _delete(self, keys: DataFrame, version: int) -> None:
        hit = stored(self.living().select("segment", "key").join(keys.select("key").distinct(), "key", "left_semi"), "hit")  # keys only, without tokens
        out = stored(self.living().join(hit, ["segment", "key"], "left_semi"), "gone")
        out.select("segment", "key", "dl").write.mode("overwrite").parquet(f"{self.path}/deleted/docs/version={version}")
        out.select("segment", F.explode("tokens").alias("token")).groupBy("segment", "token").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/deleted/tokens/version={version}")

    def delete(self, keys: DataFrame, key: str = "key") -> None:
        version, segments = self.manifest()
        self._delete(keys.select(F.col(key).alias("key")), version + 1)
        self._publish(version + 1, segments)

    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Adds documents as a segment; living documents with their keys go."""
        version, segments = self.manifest()
        docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self._delete(docs, version + 1)
        number = version + 1
        self._segment(docs, number)
        self._publish(version + 1, [*segments, number])

    def merge(self) -> None:
        """Writes the living documents as one segment; the older ones stay on disk for readers of earlier versions."""
        version, _ = self.manifest()
        self._write(self.living().select("key", "dl", "tokens", "tfs"), version + 1)
        self._publish(version + 1, [version + 1])

    # --- searches ---

    def figures(self, words: list[str]) -> tuple[int, float, dict[str, float]]:
        """Number and mean length of the living documents, and the inverse document frequency of each word that they hold."""
        n, total = self._read("figures").agg(F.sum("n_docs"), F.sum("total")).first()
        held = {r.token: r.n for r in self._read("blocks").filter(F.col("token").isin(words)).groupBy("token").agg(F.sum("n").alias("n")).collect()}
        if (gone := self._gone("docs")) is not None:
            less = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, total = n - less[0], total - less[1]
            for r in self._gone("tokens").filter(F.col("token").isin(words)).groupBy("token").agg(F.sum("n").alias("n")).collect():
                held[r.token] -= r.n
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in held.items() if d > 0}
        return n, (total / n if n else 1.0) or 1.0, idf

    def _part(self, idf: dict[str, float], mean: float, tf: str, dl: str) -> Column:
        """What a token adds to a score; it grows with tf and falls with dl."""
        weight = F.element_at(F.create_map(*[F.lit(x) for w in idf.items() for x in w]), F.col("token"))
        return weight * F.col(tf) * (self.k1 + 1) / (F.col(tf) + self.k1 * (1 - self.b + self.b * F.col(dl) / mean))

    def headers(self, idf: dict[str, float], mean: float) -> DataFrame:
        """segment, range, token, n and most (a bound of what the block adds) of the blocks of these tokens; entries are not read."""
        rows = self._read("blocks").filter(F.col("token").isin(list(idf)))
        return rows.select("segment", "range", "token", "n", self._part(idf, mean, "max_tf", "min_dl").alias("most"))

    def _scored(self, blocks: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
        """key and score of the living documents of blocks(segment, range, token, entries)."""
        rows = blocks.select("segment", "token", F.explode("entries").alias("e")).select("segment", "token", "e.*")
        scored = rows.groupBy("segment", "key").agg(F.sum(self._part(idf, mean, "tf", "dl")).alias("score"))
        gone = self._gone("docs")
        return scored if gone is None else scored.join(gone.select("segment", "key"), ["segment", "key"], "left_anti")

    def chosen(self, k: int, idf: dict[str, float], mean: float) -> DataFrame:
        """(segment, range) of the ranges that can hold one of the k best."""
        heads = stored(self.headers(idf, mean), "headers")
        bound = heads.groupBy("segment", "range").agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
        scouts = bound.orderBy(F.desc("most"), "segment", "range").limit(max(SCOUTS, -(-k // RANGE) * SCOUTS))
        best = self._scored(self._blocks(idf, scouts), idf, mean).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
        least = best.least if best.n == k else None
        return bound.filter(F.col("most") >= least * (1 - 1e-9)).select("segment", "range") if least is not None else bound.select("segment", "range")

    def _blocks(self, idf: dict[str, float], ranges: DataFrame) -> DataFrame:
        rows = self._read("blocks").filter(F.col("token").isin(list(idf)))
        return rows.join(ranges.select("segment", "range"), ["segment", "range"], "left_semi")

    def top(self, query: str, k: int) -> DataFrame:
        """(key, rank, score) of the k best documents."""
        _, mean, idf = self.figures(words_of(query))
        if not idf:
            return self.living().limit(0).select("key", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
        scored = self._scored(self._blocks(idf, stored(self.chosen(k, idf, mean), "chosen")), idf, mean)
        first = scored.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(k)
        return first.select("key", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "key")).alias("rank"), "score")  # k rows
