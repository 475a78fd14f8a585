"""Source trees and stored graphs: reading, writing, flat exports.

An archive is unpacked by the caller beforehand: `prepared` does it for a path on the driver.
"""

from __future__ import annotations

import re
import shutil
import tarfile
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.functions.names import language
from loomspark.sources.scratch import stored


def prepared(path: str) -> str:
    """A folder for a local path: itself, or a new one with an archive's files (zip, tar, tgz, tar.gz) or the single file."""
    at = Path(path)
    if at.is_dir():
        return str(at)
    if not at.is_file():
        raise ValueError(f"no such file or folder: {path}")
    out = tempfile.mkdtemp(prefix="tree-", dir="/tmp")
    if zipfile.is_zipfile(at):
        with zipfile.ZipFile(at) as z:
            z.extractall(out)
    elif tarfile.is_tarfile(at):
        with tarfile.open(at) as t:
            t.extractall(out, filter="data")
    else:
        shutil.copy(at, out)
    return out


def read_tree(spark: SparkSession, root: str, skip_dirs: list[str] | None = None, skip_pattern: str | None = None) -> DataFrame:
    """(path, name, language, content) of all UTF-8 files below root on any store that Spark reads.

    Files in folders of the given names, or whose path below root holds the pattern, are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "")
    rows = raw.select(rel.alias("path"), "content")
    for d in skip_dirs or []:
        rows = rows.filter(~F.concat(F.lit("/"), F.col("path")).contains(f"/{d}/"))
    if skip_pattern:
        rows = rows.filter(~F.col("path").rlike(skip_pattern))
    rows = rows.filter(F.expr("is_valid_utf8(cast(content as string))"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), language(F.col("path")).alias("language"), F.col("content").cast("string").alias("content"))


def read_trees(spark: SparkSession, roots: dict[str, str], **options) -> DataFrame:
    """Several trees in one table with a `repo` column, by which it can be partitioned when written."""
    out = None
    for repo, root in roots.items():
        one = read_tree(spark, root, **options).withColumn("repo", F.lit(repo))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no trees given")
    return out


def in_one_graph(trees: DataFrame) -> DataFrame:
    """Files of several trees with their repo as the first folder of the path, so that equal paths stay apart in one graph."""
    return trees.withColumn("path", F.concat_ws("/", "repo", "path"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    nodes.write.mode("overwrite").format(fmt).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(fmt).save(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """A stored graph; edges with a missing end are dropped."""
    nodes = spark.read.format(fmt).load(f"{path}/nodes")
    return nodes, complete_edges(nodes, spark.read.format(fmt).load(f"{path}/edges"))


def complete_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are there; ids shrink so well in files that Spark would broadcast very many, so they are merged."""
    ids = nodes.select("node_id").hint("merge")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


#: The layout of graph files as JSON.
GRAPH_JSON = "nodes array<struct<id: string, class: string, data: struct<name: string, node_type: string, description: string, path: string, content: string, language: string, order_in_file: int, embedding: array<float>, entity_type: string, declaring_chunk_ids: array<string>, calling_chunk_ids: array<string>, aliases: array<string>, called_entities: array<string>, declared_entities: array<struct<name: string, type: string, dtype: string>>>>>, edges array<struct<source: string, target: string, relation: string, entities: array<string>>>"


def load_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON graph files of the layout above; an unknown class counts as a plain node, a missing root is added.

    The files are parsed once for nodes and once for edges, into tables: every use of the graph reads those.
    """
    whole = spark.read.schema(GRAPH_JSON).option("multiLine", "true").json(path)
    nodes = whole.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node_id"), F.coalesce("n.data.node_type", F.lit("node")).alias("kind"), F.coalesce("n.data.name", "n.id").alias("name"), "n.data.path", "n.data.content", "n.data.language", "n.data.order_in_file", "n.data.entity_type", "n.data.declared_entities", "n.data.called_entities", "n.data.aliases")
    nodes = stored(nodes, "nodes")
    root = spark.sql("select 'root' as node_id, 'root' as kind, 'root' as name").join(nodes.select("node_id"), "node_id", "left_anti")
    nodes = nodes.unionByName(root, allowMissingColumns=True)
    edges = whole.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation")
    edges = stored(edges, "edges")
    return nodes, complete_edges(nodes, edges)


#: The classes of nodes in graph files, by kind.
CLASSES = {"file": "FileNode", "chunk": "ChunkNode", "directory": "DirectoryNode", "entity": "EntityNode"}


def save_graph_json(nodes: DataFrame, edges: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Replaces path by JSON graph files of the layout above, each a graph file of its own with about per_file nodes and edges.

    nodes(node_id, kind, name, ...) may have any columns of the layout, others are left out. Nodes and edges are dealt
    to files one by one, so that a node with very many edges makes no file large. Equal rows stay together.
    """
    layout = StructType.fromDDL(GRAPH_JSON)
    node_type, edge_type = (layout[k].dataType.elementType for k in ("nodes", "edges"))
    renamed = {"node_type": "kind"}
    data = [F.col(c).cast(f.dataType).alias(f.name) for f in node_type["data"].dataType for c in [renamed.get(f.name, f.name)] if c in nodes.columns]
    kinds = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    one = nodes.select(F.struct(F.col("node_id").alias("id"), F.coalesce(kinds[F.col("kind")], F.lit("Node")).alias("class"), F.struct(*data).alias("data")).alias("node"))
    linked = [F.col("entities").cast(edge_type["entities"].dataType).alias("entities")] if "entities" in edges.columns else []
    two = edges.select(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", *linked).alias("edge"))
    files = max(1, -(-(nodes.count() + edges.count()) // per_file))
    both = one.withColumn("key", F.xxhash64("node.id")).unionByName(two.withColumn("key", F.xxhash64("edge.source", "edge.target", "edge.relation")), allowMissingColumns=True)
    whole = both.groupBy(F.pmod("key", F.lit(files)).alias("file")).agg(F.collect_list("node").alias("nodes"), F.collect_list("edge").alias("edges"))
    whole.select("nodes", "edges").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def flat(table: DataFrame) -> DataFrame:
    """A table with its nested columns as JSON strings, for flat exports; order_in_file is -1 where there is none."""
    nested = [f.name for f in table.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    out = table.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in table.columns])
    return out.fillna(-1, ["order_in_file"]) if "order_in_file" in out.columns else out


def unflat(table: DataFrame, nested: dict[str, str], embeddings: bool = True) -> DataFrame:
    """The inverse: columns named in nested (with their types) are parsed; without embeddings that column is blank."""
    out = table.select(*[F.from_json(c, nested[c]).alias(c) if c in nested else F.col(c) for c in table.columns])
    return out if embeddings or "embedding" not in out.columns else out.withColumn("embedding", F.lit(None).cast(nested.get("embedding", "array<float>")))
