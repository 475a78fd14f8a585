"""Lookups and traversals over a property graph.

nodes(node_id, kind, name, ...) and edges(src, dst, relation) are plain DataFrames. All lookups
take a whole table of nodes at once; filter the input or the result for one node. Orders always
end in an id, so results do not depend on how data are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import by_size, stored

OUT, IN = "outgoing", "incoming"


def graph_stats(nodes: DataFrame, edges: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Counts (category, label, n, pct of the category) of node kinds, entity types and relations."""
    parts = [nodes.select(F.lit("node").alias("category"), F.coalesce("kind", F.lit("Unknown")).alias("label")), edges.select(F.lit("relation").alias("category"), F.coalesce("relation", F.lit("Unknown")).alias("label"))]
    if entity_type:
        parts.append(nodes.filter("kind = 'entity'").select(F.lit("entity").alias("category"), F.coalesce(entity_type, F.lit("Unknown")).alias("label")))
    counts = [p.groupBy("category", "label").agg(F.count(F.lit(1)).alias("n")) for p in parts]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("category")), 4))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: (node_id, other, direction, relation)."""
    out = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit(OUT).alias("direction"), "relation")
    return out.unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), F.lit(IN).alias("direction"), "relation"))


def node_info(nodes: DataFrame, edges: DataFrame, first: int = 10) -> DataFrame:
    """Every node with its numbers of edges and its first children by id.

    Children are picked by an aggregate that holds `first` ids per node, so a node with very many
    edges costs no more than others.
    """
    degree = both_ways(edges).groupBy("node_id").agg(F.count_if(F.col("direction") == OUT).alias("n_out"), F.count_if(F.col("direction") == IN).alias("n_in"))
    return nodes.select("node_id", "kind", "name").join(degree, "node_id", "left").join(_first_per(edges, "src", "dst", first, "first_children").withColumnRenamed("src", "node_id"), "node_id", "left").select("node_id", "kind", "name", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("first_children", F.lit("")).alias("first_children"))


def _first_per(rows: DataFrame, key: str, value: str, first: int, name: str) -> DataFrame:
    """The first few values of each key, joined by commas; a salted rank keeps each window small."""
    salted = rows.select(key, value, F.pmod(F.xxhash64(value), F.lit(32)).alias("salt"))
    few = ranked(salted, [key, "salt"], [F.col(value)], first).drop("salt", "rank")
    few = ranked(few, [key], [F.col(value)], first)
    return few.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(name))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], first: int | None = None) -> DataFrame:
    """rows with a 1-based rank within the keys, cut after `first` (Spark then ranks before shuffling too)."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if first is None else out.filter(F.col("rank") <= first)


#: Rows of a task where work is dealt by its size, and parts into which a node's edges are dealt before its first ones are chosen.
ROWS_PER_TASK, SALTS = 1_000_000, 32


def by_number(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by keys over as many tasks as n rows take, so that a task's share does not grow with the whole."""
    return rows.repartition(max(1, -(-n // ROWS_PER_TASK)), *keys)


def _salted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges from both ends with the part of their node to which the other end belongs, and their number."""
    links = stored(edges.select("src", "dst", "relation"), "edges")
    return both_ways(links).withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS))), 2 * links.count()


def node_edges(edges: DataFrame, first: int = 20) -> DataFrame:
    """The first edges of each node and direction, with the total and whether there are more."""
    rows, n = _salted(edges)
    keys = ["node_id", "direction"]
    order = [F.col("other"), F.col("relation")]
    few = ranked(by_number(rows, n, *keys, "salt").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "salt"))), [*keys, "salt"], order, first)
    total = F.sum(F.when(F.col("rank") == 1, F.col("n"))).over(Window.partitionBy(*keys))
    out = ranked(by_number(few, n, *keys).withColumn("n_total", total), keys, order, first)
    return out.select("node_id", "direction", "rank", "other", "relation", "n_total", (F.col("n_total") > first).alias("has_more"))


def neighbors(nodes: DataFrame, edges: DataFrame, limit: int = 20, page: int = 1) -> DataFrame:
    """A page of each node's distinct neighbours by id; an outgoing edge is preferred where both exist."""
    rows, n = _salted(edges)
    one = by_number(rows.filter("node_id != other"), n, "node_id", "salt").groupBy("node_id", "salt", "other").agg(F.max(F.struct("direction", "relation")).alias("e"))
    few = ranked(one, ["node_id", "salt"], [F.col("other")], limit * page).drop("rank", "salt")
    got = ranked(by_number(few, n, "node_id"), ["node_id"], [F.col("other")], limit * page).filter(F.col("rank") > limit * (page - 1))
    far = by_number(nodes.select(F.col("node_id").alias("other"), "kind", "name"), n, "other")
    return by_number(got, n, "other").join(far, "other").select("node_id", "rank", F.col("other").alias("neighbor"), F.col("e.direction").alias("direction"), F.col("e.relation").alias("relation"), "kind", "name")


def related(nodes: DataFrame, edges: DataFrame, relation: str = "all", limit: int | None = None, page: int = 1) -> DataFrame:
    """(src, dst, relation, name): the nodes that edges of a relation (or any: "all" or "") lead to from each node; with a limit one page of them by id."""
    rows = edges if relation in ("", "all") else edges.filter(F.col("relation") == relation)
    if limit is not None:
        rows = ranked(rows.select("src", "dst", "relation"), ["src"], [F.col("dst"), F.col("relation")], limit * page).filter(F.col("rank") > limit * (page - 1))
    return rows.join(nodes.select(F.col("node_id").alias("dst"), "name").hint("merge"), "dst").select("src", "dst", "relation", "name")


def _only(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    return edges if not relations else edges.filter(F.col("relation").isin(relations))


def _frontiers(edges: DataFrame, start: DataFrame, depth: int, relations: list[str] | None, directed: bool) -> list[DataFrame]:
    """(node_id, depth, parent) of the nodes at each number of steps from start(node_id), nearest first."""
    links = _only(edges, relations).select("src", "dst")
    if not directed:
        links = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = stored(start.select("node_id").distinct().select("node_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), "reach")
    out = [seen]
    for d in range(1, depth + 1):
        found = links.join(by_size(out[-1].select(F.col("node_id").alias("src"))), "src").groupBy("dst").agg(F.min("src").alias("parent"))
        fresh = found.withColumnRenamed("dst", "node_id").join(by_size(seen.select("node_id")), "node_id", "left_anti").select("node_id", F.lit(d).alias("depth"), "parent")
        frontier = stored(fresh, "frontier")
        if frontier.isEmpty():
            break
        out.append(frontier)
        seen = seen.unionByName(frontier)
    return out


def reach(edges: DataFrame, start: DataFrame, depth: int, relations: list[str] | None = None, directed: bool = True) -> DataFrame:
    """(node_id, depth, parent) of all nodes within `depth` steps of start(node_id), by breadth-first frontiers.

    Each step joins the frontier to the edges and drops nodes seen before; it is written to shared
    storage, so that plans stay short and lost executors cost one step.
    """
    levels = _frontiers(edges, start, depth, relations, directed)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def subgraph(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2, relations: list[str] | None = None, edges_filtered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` undirected steps, and the edges among them: of all relations, or with edges_filtered only of those followed."""
    near = reach(edges, start, depth, relations, directed=False)
    inside = near.select("node_id")
    among = _only(edges, relations if edges_filtered else None)
    inside = by_size(inside)
    among = among.join(inside.withColumnRenamed("node_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return nodes.join(by_size(near.select("node_id", "depth")), "node_id"), among


def summary(nodes: DataFrame, edges: DataFrame, samples: int = 5) -> DataFrame:
    """(category, label, n, samples) of a subgraph: nodes by kind and edges by relation, with the first ids of each."""
    rows = nodes.select(F.lit("node").alias("category"), F.col("kind").alias("label"), F.col("node_id").alias("id"))
    rows = rows.unionByName(edges.select(F.lit("relation").alias("category"), F.col("relation").alias("label"), F.concat_ws(">", "src", "dst").alias("id")))
    counts = rows.groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))
    labelled = rows.select(F.struct("category", "label").alias("group"), "id")
    few = _first_per(labelled, "group", "id", samples, "samples").select("group.category", "group.label", "samples")
    return counts.join(few, ["category", "label"]).select("category", "label", "n", "samples")


def find_paths(edges: DataFrame, source: DataFrame, targets: DataFrame, max_depth: int = 5, relations: list[str] | None = None) -> DataFrame:
    """(target, status, length, path) of a shortest directed path from the one node of source to each target.

    status is found, or none within max_depth steps; ties go to the parent with the smallest id.
    """
    levels = _frontiers(edges, source, max_depth, relations, True)
    wanted = stored(targets.select(F.col("node_id").alias("target")), "targets")
    walk = None
    for level in reversed(levels):  # a walk meets only the frontier at which it stands
        ends = wanted.join(by_size(level), F.col("node_id") == F.col("target")).select("target", F.col("parent").alias("next"), "depth", F.array("node_id").alias("path"))
        if walk is not None:
            up = by_size(level.select(F.col("node_id").alias("next"), "parent"))
            ends = ends.unionByName(walk.join(up, "next").select("target", F.col("parent").alias("next"), "depth", F.concat(F.array("next"), "path").alias("path")))
        walk = ends
    found = stored(walk.select("target", F.lit("found").alias("status"), F.col("depth").alias("length"), F.array_join("path", ">").alias("path")), "found")
    rest = wanted.join(found.select("target").hint("merge"), "target", "left_anti").select("target", F.lit("none").alias("status"), F.lit(None).cast("int").alias("length"), F.lit("").alias("path"))
    return found.unionByName(rest)


def _levels(start: DataFrame, links: DataFrame, steps: int, ahead: bool) -> DataFrame:
    """(root, node, steps, path) of the nodes within a number of steps from start(root), with what the least of their shortest paths has between both.

    links(here, there); paths grow behind their root, or (ahead) in front of it where links are followed backwards.
    """
    passed = F.when(F.col("steps") > 0, F.array("node")).otherwise(F.array().cast("array<string>"))
    grown = F.concat(passed, "path") if ahead else F.concat("path", passed)
    seen = level = stored(start.select("root", F.col("root").alias("node"), F.lit(0).alias("steps"), F.array().cast("array<string>").alias("path")).distinct(), "level")
    for d in range(1, steps + 1):
        found = level.join(links.hint("merge"), level.node == links.here).select("root", F.col("there").alias("x_there"), grown.alias("path")).withColumnRenamed("x_there", "node")
        fresh = found.join(seen.select("root", "node").hint("merge"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path"))
        level = stored(fresh.select("root", "node", F.lit(d).alias("steps"), "path"), "level")
        seen = seen.unionByName(level)
    return seen


def paths_between(edges: DataFrame, pairs: DataFrame, max_depth: int = 5, relations: list[str] | None = None) -> DataFrame:
    """(src, dst, length, path) of the least shortest directed path of each of pairs(src, dst) within max_depth steps, by node ids; no row where there is none.

    Frontiers go out from all sources, and backwards from all targets, half of the way each, once for every distinct
    end however many pairs share it; each node keeps its least path to that end. A pair looks up the nodes around that of its ends that
    has fewer, so an end near very many nodes does not meet all its pairs with them; where both halves meet, the
    least of the shortest whole paths is one through the least halves. A path is met once: where its way back is whole, or,
    if it is no longer than that, at its source.
    """
    links = stored(_only(edges, relations).select("src", "dst").distinct(), "links")
    forth, back = links.select(F.col("src").alias("here"), F.col("dst").alias("there")), links.select(F.col("dst").alias("here"), F.col("src").alias("there"))
    pairs = stored(pairs.select("src", "dst").distinct(), "pairs")
    near = _levels(pairs.select(F.col("src").alias("root")), forth, (max_depth + 1) // 2, False).select(F.col("root").alias("src"), "node", F.col("steps").alias("gone"), F.col("path").alias("before"))
    far = _levels(pairs.select(F.col("dst").alias("root")), back, max_depth // 2, True).select(F.col("root").alias("dst"), "node", F.col("steps").alias("left"), F.col("path").alias("after"))
    around = lambda rows, end: rows.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}")).hint("merge")
    sized = stored(pairs.join(around(near, "src"), "src").join(around(far, "dst"), "dst"), "sized")
    back, none = F.col("left") == max_depth // 2, F.array().cast("array<string>")
    ways, wide = sized.filter("n_dst <= n_src").select("src", "dst"), sized.filter("n_dst > n_src").select("src", "dst")
    halves = ways.join(far.hint("merge"), "dst").filter(back | (F.col("node") == F.col("src")))
    at_source = halves.filter("node = src").withColumns({"gone": F.lit(0), "before": none})
    # few nodes may be that far from all targets, and then no half needs to be shuffled to meet them
    ahead = near.filter("gone > 0").join(by_size(far.filter(back).select("node").distinct()), "node", "left_semi")
    met = at_source.unionByName(halves.filter(back).join(by_size(stored(ahead, "ahead")), ["src", "node"]))
    mine = by_size(wide.select("dst").distinct())
    other = wide.join(near.join(by_size(wide.select("src").distinct()), "src", "left_semi").hint("merge"), "src")
    other = other.join(far.join(mine, "dst", "left_semi").hint("merge"), ["dst", "node"])
    met = met.unionByName(other.filter(back | (F.col("gone") == 0)))
    first = F.when(F.col("gone") > 0, F.concat(F.array("src"), "before")).otherwise(none)
    last = F.when(F.col("left") > 0, F.concat("after", F.array("dst"))).otherwise(none)
    whole = met.select("src", "dst", F.struct((F.col("gone") + F.col("left")).alias("length"), F.concat(first, F.array("node"), last).alias("path")).alias("best"))
    least = whole.groupBy("src", "dst").agg(F.min("best").alias("best"))
    return least.select("src", "dst", F.col("best.length").alias("length"), F.array_join("best.path", ">").alias("path"))


def tree(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 3, relation: str | None = "contains") -> DataFrame:
    """(root, node_id, depth, path) of every walk of at most max_depth edges below the roots; walks do not revisit a node."""
    links = _only(edges, [relation] if relation else None).select("src", "dst")
    level = roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth"), F.array("node_id").alias("path"))
    out = level
    for d in range(1, max_depth + 1):
        level = level.join(links, level.node_id == links.src).filter(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("node_id"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(level)
    return out.join(nodes.select("node_id", "kind", "name").hint("merge"), "node_id").select("root", "node_id", "kind", "name", "depth", F.array_join("path", ">").alias("path"))
