"""Listings and searches over nodes, files and entities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.graph import ranked
from loomspark.sources.scratch import stored


def paged(rows: DataFrame, order: list[Column], limit: int, page: int = 1) -> DataFrame:
    """One page of rows in the given order (which must be total); an empty one beyond the end."""
    if limit < 1 or page < 1:
        raise ValueError("limit and page start at 1")
    return rows.orderBy(*order).limit(limit * page).offset(limit * (page - 1))


def in_order(rows: DataFrame, group: str, order: list[Column], kind: str = "int") -> DataFrame:
    """Rows with their rank (from 1) in their group in the given order, which must be total.

    All rows are sorted by range over all tasks, so that no task sorts a whole group; a row's place within
    its partition, and how many rows of its group earlier partitions have, make up its rank.
    """
    row = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    sorted_rows = stored(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("x_row", row), "sorted")
    part = F.shiftright("x_row", 33)
    parts = sorted_rows.groupBy(group, part.alias("x_part")).agg(F.min("x_row").alias("x_first"), F.count(F.lit(1)).alias("x_n"))
    # a group has a row here for each partition that it reaches into
    before = F.coalesce(F.sum("x_n").over(Window.partitionBy(group).orderBy("x_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("x_before", before).select(F.col(group).alias("x_group"), "x_part", "x_first", "x_before")
    found = sorted_rows.withColumn("x_part", part).join(parts, (F.col(group).eqNullSafe(F.col("x_group"))) & (sorted_rows["x_row"] >= F.col("x_first")) & (F.shiftright(sorted_rows["x_row"], 33) == parts["x_part"]))
    return found.select(*rows.columns, (F.col("x_row") - F.col("x_first") + F.col("x_before") + 1).cast(kind).alias("rank"))


def nodes_by_type(nodes: DataFrame, kind: str = "kind", name: str = "name", node_id: str = "node_id", limit: int = 20) -> DataFrame:
    """All nodes with their type in lower case, and their place and page in the list of that type by name."""
    rows = nodes.withColumn("node_type", F.lower(kind))
    return in_order(rows, "node_type", [F.lower(name), F.col(node_id)]).withColumn("page", F.ceil(F.col("rank") / limit).cast("long"))


def subsequence_pattern(name: str) -> str:
    """A regex for texts that hold the characters of name in this order."""
    return "(?is)" + ".*?".join(re.escape(c) for c in name)


def name_score(column: Column, name: str, partial: bool = True) -> Column:
    """0 for an equal name, 1 for one that holds it, 2 for one that holds its characters in order, else null; case does not count."""
    low, want = F.lower(column), name.lower()
    score = F.when(low == want, 0)
    return score if not partial else score.when(low.contains(want), 1).when(low.rlike(subsequence_pattern(want)), 2)


def search_by_type_and_name(nodes: DataFrame, name: str, node_type: str | None = None, partial: bool = True, kind: str = "kind", column: str = "name") -> DataFrame:
    """Nodes whose name matches, with their score (see name_score); `paged` by score puts the best first."""
    rows = nodes.withColumn("score", name_score(F.col(column), name, partial)).filter("score is not null")
    return rows if node_type is None else rows.filter(F.lower(kind) == node_type.lower())


def entity_list(decl: DataFrame, call: DataFrame) -> DataFrame:
    """Every entity of decl(entity, chunk_id, type) and call(entity, chunk_id): types, numbers of chunks, and where it is known."""
    d = decl.groupBy("entity").agg(F.count(F.lit(1)).alias("n_decl"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    c = call.groupBy("entity").agg(F.count(F.lit(1)).alias("n_call"))
    rows = d.join(c, "entity", "full")
    n = {k: F.coalesce(k, F.lit(0)) for k in ("n_decl", "n_call")}
    return rows.select("entity", F.coalesce("types", F.lit("")).alias("types"), n["n_decl"].alias("n_decl"), n["n_call"].alias("n_call"), (n["n_decl"] > 0).alias("declared_in_repo"), (n["n_call"] > 0).alias("called_in_repo"))


def declared_entities(decl: DataFrame, call: DataFrame, called: bool | None = None) -> DataFrame:
    """Entities with a declaration; with called, only those that are (or are not) called too."""
    rows = decl.select("entity").distinct()
    return rows if called is None else rows.join(call, "entity", "left_semi" if called else "left_anti")


def external_entities(decl: DataFrame, call: DataFrame) -> DataFrame:
    """Entities that are called but declared nowhere (they resolve to themselves)."""
    return call.select("entity").distinct().join(decl, "entity", "left_anti")


def definitions(decl: DataFrame, chunks: DataFrame, first: int = 5) -> DataFrame:
    """The first declaring chunks of every entity with their content, and how many there are."""
    total = decl.groupBy("entity").agg(F.count(F.lit(1)).alias("n_total"))
    few = ranked(decl.select("entity", "chunk_id", "pos"), ["entity"], [F.col("pos"), F.col("chunk_id")], first)
    return few.join(total, "entity").join(chunks, "chunk_id")


def usages(call: DataFrame, chunks: DataFrame, limit: int = 20, page: int = 1) -> DataFrame:
    """A page of the chunks that call each entity; ids without a chunk are dropped after the page is cut."""
    got = ranked(call.select("entity", "chunk_id", "pos"), ["entity"], [F.col("pos"), F.col("chunk_id")], limit * page).filter(F.col("rank") > limit * (page - 1))
    return got.join(chunks, "chunk_id")


def lines(text: Column) -> Column:
    """Lines of a text: parts between line feeds, without an empty one at the end."""
    parts = F.split(text, "\n", -1)
    return F.when(F.length(text) == 0, F.lit(0)).when(text.endswith("\n"), F.size(parts) - 1).otherwise(F.size(parts))


def file_stats(files: DataFrame, chunks: DataFrame, key: str = "path", decl: DataFrame | None = None, call: DataFrame | None = None) -> DataFrame:
    """Lines, characters and number of chunks of every file; with decl(key, name) and call(key, name), how many names it declares and calls."""
    counts = {"n_chunks": chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))}
    for column, rows in (("n_declared", decl), ("n_called", call)):
        if rows is not None:
            counts[column] = rows.groupBy(key).agg(F.countDistinct("name").alias(column))
    out = files.select(key, lines(F.col("content")).cast("long").alias("n_lines"), F.length("content").cast("long").alias("n_characters"))
    for n in counts.values():
        out = out.join(n, key, "left")
    return out.fillna(0, list(counts))


def chunks_of(chunks: DataFrame, files: DataFrame, key: str = "path", limit: int | None = None, page: int = 1) -> DataFrame:
    """The chunks of files(key), in order of place; with a limit one page of them."""
    rows = chunks.join(files.select(key).distinct(), key, "left_semi")
    return rows if limit is None else paged(rows, [F.col(key), F.col("ord")], limit, page)


def glob_pattern(glob: str) -> str:
    """A regex for a shell pattern in which * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def list_files(files: DataFrame, directory: str = "", glob: str = "*", recursive: bool = True, path: str = "path") -> DataFrame:
    """Files below a directory (or directly in it) whose path or name matches the pattern, or that lie anywhere under it."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    rows = files
    if directory:
        top = directory.rstrip("/")
        rows = rows.filter(p.startswith(top + "/")) if recursive else rows.filter(F.regexp_replace(p, "/[^/]*$", "") == top)
    elif not recursive:
        rows = rows.filter(~p.contains("/"))
    return rows.filter(p.rlike(glob_pattern(glob)) | name.rlike(glob_pattern(glob)) | p.rlike(glob_pattern("*/" + glob)))


def file_names_by_regex(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Files whose name (the last part of the path) holds a match; an ill-formed pattern raises."""
    re.compile(pattern)
    return files.withColumn("name", F.element_at(F.split(path, "/"), -1)).filter(F.col("name").rlike(pattern))


#: Words that introduce an import in the languages read.
IMPORT_WORDS = ["import", "from", "require", "use", "include"]


def import_pattern(name: str) -> str:
    return rf"(?i)\b(?:{'|'.join(IMPORT_WORDS)})\b[^\n]*" + re.escape(name)


def files_importing(file_calls: DataFrame, chunks: DataFrame, name: str, first_chunks: int = 3) -> DataFrame:
    """(path, match_type, match): files that call an entity whose name holds `name`, else files with an import line for it in their first chunks."""
    named = file_calls.filter(F.lower("called").contains(name.lower())).groupBy("path").agg(F.min("called").alias("match")).select("path", F.lit("called_entity").alias("match_type"), "match")
    lines_ = chunks.filter((F.col("ord") < first_chunks) & F.col("content").rlike(import_pattern(name))).groupBy("path").agg(F.min_by(F.regexp_extract("content", import_pattern(name), 0), "ord").alias("match"))
    return named.unionByName(lines_.join(named, "path", "left_anti").select("path", F.lit("import_statement").alias("match_type"), "match"))


def concept_overview(concept: str, sources: dict[str, tuple[DataFrame, str, list[str]]], caps: dict[str, int]) -> DataFrame:
    """(category, rank, id): for each category the first rows, by id, whose columns hold the concept."""

    def one(category: str) -> DataFrame:
        rows, key, columns = sources[category]
        hit = reduce(lambda a, b: a | b, [F.lower(c).contains(concept.lower()) for c in columns])
        found = rows.filter(hit).select(F.lit(category).alias("category"), F.col(key).cast("string").alias("id"), F.col(key).alias("k")).orderBy("k").limit(caps[category])
        return ranked(found, ["category"], [F.col("k")]).drop("k")

    return reduce(DataFrame.unionByName, map(one, sources))


def inheriting(classes: DataFrame, base: str) -> DataFrame:
    """Classes of classes(name, bases) with a base of that name (its last part counts), in any case."""
    return classes.filter(F.exists("bases", lambda b: F.lower(F.element_at(F.split(b, r"::|\."), -1)) == base.lower()))


def file_structure(files: DataFrame, decl: DataFrame, chunks: DataFrame, key: str = "path", first_decl: int = 15, first_chunks: int = 10) -> DataFrame:
    """Every file with its totals, its first declared names and its first chunks."""
    d = decl.groupBy(key).agg(F.count(F.lit(1)).alias("n_declared"))
    top = ranked(decl, [key], [F.col("pos"), F.col("name")], first_decl).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("declared"))
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") < first_chunks, F.struct("ord", "chunk_id")))), lambda x: x["chunk_id"]), ",").alias("chunk_ids"))
    return files.select(key).join(d, key, "left").join(top, key, "left").join(c, key, "left").select(key, F.coalesce("n_declared", F.lit(0)).alias("n_declared"), F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"))
