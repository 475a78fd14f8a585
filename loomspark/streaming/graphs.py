"""A graph that follows its source files: a stream of file versions, and the graph of any version.

Files come as (path, content, seq); a null content is a deletion, and of several versions of a path the one with the highest
seq counts, whether they come in one batch or late. For each batch only files whose content differs from the
known one are cut, read and mapped to chunks; their old chunks and names are retracted and the new ones added, in tables
with versions (`operators.versions`). Names are unified over all files when a graph is asked for, those that share an alias with
another one in order of place: the answers of the last graph are the first guess, so that few rounds follow a small change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators import build, extract
from loomspark.operators.catalog import in_order
from loomspark.operators.versions import Versions, last_of_each
from loomspark.sources.scratch import stored

FILES = "path string, content string, seq long"
CHUNKS = "path string, ord int, chunk_id string, language string, content string"
NAMES = "path string, role string, pos int, name string, type string, chunk_id string, ord int"
#: Files that one task cuts and reads.
FILES_PER_TASK = 20_000
#: The order of declarations.
PLACE = ["path", "ord", "pos", "name", "type"]


class Graph:
    """The state of a graph in a folder; `cut` makes chunks (path, ord, chunk_id, language, content) of files."""

    def __init__(self, spark: SparkSession, path: str, cut: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.cut = spark, path, cut
        self.files = Versions(spark, f"{path}/files", FILES, ["path"])
        self.chunks = Versions(spark, f"{path}/chunks", CHUNKS, ["path", "ord"])
        self.names = Versions(spark, f"{path}/names", NAMES, ["path"])

    def apply(self, batch: DataFrame, number: int | None = None) -> int:
        """Takes one batch of files(path, content, seq) in; a batch that was taken in before changes nothing."""
        before = self.files.as_of().select("path", F.col("content").alias("x_content"), F.col("seq").alias("x_seq"))
        came = last_of_each(batch.select("path", "content", "seq"), "path", "seq").join(before.hint("merge"), "path", "left")
        fresh = stored(came.filter(F.col("x_seq").isNull() | (F.col("seq") > F.col("x_seq"))), "fresh")
        # a deleted file leaves its seq behind, so that no older version brings it back
        changed = stored(fresh.filter(~F.col("content").eqNullSafe(F.col("x_content"))).select("path", "content"), "changed")
        scope, new = changed.select("path"), changed.filter("content is not null")
        new = new.repartition(max(1, -(-changed.count() // FILES_PER_TASK)))  # few bytes can be very many files
        pieces = stored(self.cut(new), "pieces")
        found = extract.located(new, self.cut)
        # each path is one row, and the entities and chunks of a file have places of their own: no two rows are equal
        self.chunks.commit(pieces, scope, number, True)
        self.names.commit(found.select(*self.names.columns), scope, number, True)
        return self.files.commit(fresh.select("path", "content", "seq"), fresh.select("path"), number, True)

    def follow(self, folder: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
        """Takes in all files that a folder of Parquet has, batch by batch."""
        rows = self.spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_at_once).parquet(folder)
        return rows.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def graph(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as of a version."""
        files = self.files.as_of(version).filter("content is not null").select("path")
        pieces, found = self.chunks.as_of(version), stored(self.names.as_of(version), "found")
        registered, rest = build.apart(found.filter("role = 'declared'"))
        if rest is not None:
            # occurrences in order of path, chunk and place; a chunk's number is only told from others
            rest = in_order(rest.withColumn("x_all", F.lit(0)), "x_all", [F.col(c) for c in PLACE], "long").drop("x_all").withColumnRenamed("rank", "occ")
            rest = stored(rest.withColumn("chunk_seq", F.xxhash64("chunk_id")), "declared")
            taken = stored(build.taken_in_order(rest, self._guess(rest)), "registered")
            self._keep(taken)
            registered = registered.unionByName(taken.select(*registered.columns))
        entities = registered.select(F.col("entity").alias("name"), "path", F.struct(*PLACE).alias("seq"))
        resolved = build.resolved_calls(found.filter("role = 'called'").select("chunk_id", F.col("name").alias("called")), entities)
        return build.build_graph(files, pieces, registered, resolved)

    KEY = ["chunk_id", "pos", "name", "type"]

    def _answers(self) -> DataFrame:
        return Versions(self.spark, f"{self.path}/answers", "chunk_id string, pos int, name string, type string, entity string", self.KEY).as_of()

    def _guess(self, decl: DataFrame) -> DataFrame:
        return decl.join(self._answers().hint("merge"), self.KEY).select("occ", "entity")

    def _keep(self, registered: DataFrame) -> None:
        """Only answers that differ from the name: a name without an answer is guessed to stand for itself."""
        kept = Versions(self.spark, f"{self.path}/answers", "chunk_id string, pos int, name string, type string, entity string", self.KEY)
        kept.commit(registered.filter("entity != name").select(*self.KEY, "entity"), None)
