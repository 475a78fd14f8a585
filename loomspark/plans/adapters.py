"""The relational tables as the inputs of the graph operators.

Key graph: regions contain nations, nations contain customers, customers contain orders; nations
declare suppliers, and a supplier is called by the orders that it serves. Ids carry a kind prefix.
Events as entities: a user is an entity, a sign-up declares it, any other event calls it; a minute
is a chunk and a day a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.graph import by_number


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def key_nodes(t: Tables) -> DataFrame:
    parts = [("r", "region", "r_regionkey", F.col("r_name")), ("n", "nation", "n_nationkey", F.col("n_name")), ("c", "customer", "c_custkey", F.col("c_name")), ("o", "orders", "o_orderkey", F.col("o_orderpriority")), ("s", "supplier", "s_suppkey", F.col("s_name"))]
    out = None
    for prefix, table, key, name in parts:
        one = getattr(t, table).select(_id(prefix, key).alias("node_id"), F.lit(table).alias("kind"), name.alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def key_edges(t: Tables) -> DataFrame:
    contains = [(t.nation, "r", "n_regionkey", "n", "n_nationkey"), (t.customer, "n", "c_nationkey", "c", "c_custkey"), (t.orders, "c", "o_custkey", "o", "o_orderkey")]
    out = t.supplier.select(_id("n", "s_nationkey").alias("src"), _id("s", "s_suppkey").alias("dst"), F.lit("declares").alias("relation"))
    for table, a, x, b, y in contains:
        out = out.unionByName(table.select(_id(a, x).alias("src"), _id(b, y).alias("dst"), F.lit("contains").alias("relation")))
    # keys are made distinct before they become text, and dealt by their number
    served = by_number(t.lineitem.select("l_suppkey", "l_orderkey"), t.lineitem.count(), "l_orderkey").distinct()
    return out.unionByName(served.select(_id("s", "l_suppkey").alias("src"), _id("o", "l_orderkey").alias("dst"), F.lit("called_by").alias("relation")))


#: The same in SQL.
KEY_NODES_SQL = """key_nodes AS (
  SELECT 'r:' || r_regionkey AS node_id, 'region' AS kind, r_name AS name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'orders', o_orderpriority FROM orders
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier)"""
KEY_EDGES_SQL = """key_edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains' AS relation FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'contains' FROM orders
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'declares' FROM supplier
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'o:' || l_orderkey, 'called_by' FROM lineitem)"""


def event_entities(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Declarations and calls (entity, chunk_id, file, pos, type)."""
    rows = t.events.select(F.col("user_id").alias("entity"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("chunk_id"), F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("pos"), F.col("event_type").alias("type"))
    return rows.filter("type = 'signup'"), rows.filter("type != 'signup'")


EVENT_SQL = """ev AS (SELECT user_id AS entity, strftime(ts, '%Y-%m-%d %H:%M') AS chunk_id, strftime(ts, '%Y-%m-%d') AS file, event_id AS pos, event_type AS type FROM events),
decl AS (SELECT * FROM ev WHERE type = 'signup'), call AS (SELECT * FROM ev WHERE type <> 'signup')"""


def daily_entities(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The same with a user's day as the entity: some are declared and never called, others called only."""
    return tuple(rows.withColumn("entity", F.concat_ws("/", F.col("entity").cast("string"), "file")) for rows in event_entities(t))


DAILY_SQL = EVENT_SQL.replace("user_id AS entity", "user_id || '/' || strftime(ts, '%Y-%m-%d') AS entity")


def event_chunks(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_events"))


def turns(t: Tables) -> DataFrame:
    """Conversations as files, turns as chunks."""
    return t.conversations.select(F.col("conv_id").alias("path"), F.col("turn").alias("ord"), F.col("text").alias("content"))
