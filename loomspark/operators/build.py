"""Building the graph: alias tables, resolution of calls, registration, roll-ups, nodes and edges.

Joins of names, occurrences and edges are merge joins: names that were read from texts outgrow what Spark expects
of their source, and stored ones shrink so well that a small file may hold more than a driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.names import aliases, simple_name
from loomspark.sources.scratch import by_size, stored


def alias_table(entities: DataFrame) -> DataFrame:
    """(alias, canonical, alias_seq) of entities(name, path, seq): a canonical name stands for itself, any other alias for its first entity."""
    names = entities.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by("path", "seq").alias("path"))
    rows = names.select(F.col("name").alias("canonical"), "seq", F.posexplode(aliases(F.col("name"), F.col("path"))).alias("pos", "alias"))
    rank = F.struct((F.col("alias") != F.col("canonical")).alias("other"), "seq", "pos", "canonical")
    return rows.groupBy("alias").agg(F.min_by("canonical", rank).alias("canonical"), F.min(F.struct("seq", "pos")).alias("first")).select("alias", "canonical", F.col("first.seq").alias("alias_seq"), F.col("first.pos").alias("alias_pos"))


def by_alias(asked: DataFrame, table: DataFrame) -> DataFrame:
    """asked(alias) with the canonical entity that each stands for, null where none does."""
    return asked.join(table.select("alias", "canonical"), "alias", "left")


def resolve_calls(calls: DataFrame, table: DataFrame) -> DataFrame:
    """calls(..., called) with resolved and match_kind: exact alias, else the shortest canonical with the same simple name (the first of equal ones), else the name itself."""
    exact = table.select(F.col("alias").alias("called"), F.col("canonical").alias("exact"))
    by_name = table.withColumn("simple", simple_name(F.col("alias"))).groupBy("simple").agg(F.min_by("canonical", F.struct(F.length("canonical"), "alias_seq", "alias_pos", "canonical")).alias("near"))
    rows = calls.join(exact.hint("merge"), "called", "left").withColumn("simple", simple_name(F.col("called"))).join(by_name.hint("merge"), "simple", "left")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "simple").otherwise("none")
    return rows.withColumn("resolved", F.coalesce("exact", "near", "called")).withColumn("match_kind", kind).drop("exact", "near", "simple")


#: Calls of a name beyond which it is joined without a shuffle, so that no task gets them all.
OFTEN = 10_000


def resolved_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """calls(chunk_id, called) with resolved, by what resolve_calls says over the alias table of entities(name, path, seq).

    Each called name is resolved once, and only entities with an alias of its simple name are given aliases: no other one
    can be meant. calls should be stored, since they are read several times.
    """
    asked = stored(calls.groupBy("called").agg(F.count(F.lit(1)).alias("n")), "asked")
    last = F.element_at(F.split("name", "::"), -1)
    simple = F.when(F.col("path").contains("::"), F.transform(aliases(F.col("name"), F.col("path")), simple_name)).otherwise(F.array(simple_name(F.col("name")), simple_name(last)))
    meant = entities.select("name", "path", "seq", F.explode(F.array_distinct(simple)).alias("simple"))
    meant = meant.join(by_size(asked.select(simple_name(F.col("called")).alias("simple")).distinct()), "simple", "left_semi")
    table = stored(alias_table(meant), "aliases")
    answers = resolve_calls(asked, table).filter(F.col("resolved") != F.col("called"))
    answers = stored(answers.select("called", "n", "resolved"), "answers")
    # names that are called very often are few
    often, seldom = answers.filter(F.col("n") > OFTEN).select("called", "resolved"), answers.filter(F.col("n") <= OFTEN).select("called", "resolved")
    common = F.broadcast(asked.filter(F.col("n") > OFTEN).select("called"))
    mine = calls.join(common, "called", "left_semi").join(F.broadcast(often), "called", "left")
    rest = calls.join(common, "called", "left_anti").join(by_size(seldom), "called", "left")
    return mine.unionByName(rest).withColumn("resolved", F.coalesce("resolved", "called"))


def _keys(name: Column) -> Column:
    """Hashes by which names that may share an alias meet: (key, own) of a name, of its part after the last `::`, and (not own) of what follows a dot in either.

    Each other alias is the name behind a prefix that ends in a dot, so of two names that share one, the name or last part of one is
    found at the end of the other, behind a dot, or is equal to its name or last part.
    """
    after = lambda x: F.transform(F.sequence(F.lit(1), F.size(F.split(x, r"\."))), lambda i: F.struct(F.xxhash64(F.array_join(F.slice(F.split(x, r"\."), i, F.size(F.split(x, r"\."))), ".")).alias("key"), (i == 1).alias("own")))
    last = F.element_at(F.split(name, "::"), -1)
    return F.when(name.contains("::"), F.concat(after(name), after(last))).when(name.contains("."), after(name)).otherwise(F.array(F.struct(F.xxhash64(name).alias("key"), F.lit(True).alias("own"))))


def contested(declared: DataFrame) -> DataFrame | None:
    """(name) of the names of declared(name, ...) that may share an alias with another name; None where there are none.

    A name of which no alias is another's stands for itself wherever it is declared, so only these need to be taken in order.
    """
    keys = declared.filter("name is not null").select("name", F.explode(_keys(F.col("name"))).alias("k")).select("name", "k.*")
    hashes = keys.select("key", F.col("own").cast("int").alias("own"), F.xxhash64("name").alias("a"), F.xxhash64(F.lit(1), "name").alias("b"))
    met = hashes.groupBy("key").agg(F.max("own").alias("own"), F.min("a").alias("a"), F.max("a").alias("x_a"), F.min("b").alias("b"), F.max("b").alias("x_b"))
    clash = stored(met.filter("own = 1 and (a != x_a or b != x_b)").select("key"), "clash")
    if clash.isEmpty():
        return None
    return stored(keys.select("name", "key").join(by_size(clash), "key", "left_semi").select("name").distinct(), "contested")


#: Occurrences, about, that one task takes in order.
STRETCH = 1 << 14
#: What an alias stands for, from the occurrences of a stretch: its oldest entity and when that was born, and when the alias itself became an entity.
STATE = "alias string, born long, entity string, since long"


def register(declared: DataFrame, guess: DataFrame | None = None) -> DataFrame:
    """declared(occ, chunk_seq, name, path, chunk_id, type, dtype) with the canonical entity that each joins.

    Occurrences stand in order of occ, those of a chunk together. One joins the entity that its name or else the first of
    its aliases stands for; else it is an entity of its own. Within a chunk a name stands for what it was last used
    for there; else an entity's name stands for itself, any other for the oldest entity that had it.

    Occurrences are dealt over stretches of whole chunks, and a task takes those of a stretch in order, from what
    the aliases that it holds stood for before it. Each round takes that from all earlier stretches as the round before left them: right
    answers for all earlier stretches give right ones, so the rounds end at the answer of the rule taken in order, from
    whatever guess(occ, entity) they begin. They are as many as the longest chain of stretches whose first uses of names hang on
    each other, not of occurrences: names seen before change nothing. Only aliases that came to stand for something go from round to round.
    Names that share no alias with another one are entities of their own and take no part.
    """
    alone, rest = apart(declared)
    return alone if rest is None else alone.unionByName(taken_in_order(rest, guess))


def apart(declared: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Occurrences whose names stand for themselves, with their entity, and the others, if there are any."""
    names = contested(declared)
    alone = F.col("name").alias("entity")
    if names is None:
        return declared.select("*", alone), None
    names = by_size(names)
    rest = stored(declared.join(names, "name", "left_semi").select(*declared.columns), "declared")
    return declared.join(names, "name", "left_anti").select(*declared.columns, alone), rest


def taken_in_order(declared: DataFrame, guess: DataFrame | None = None) -> DataFrame:
    """What `register` says, by taking all of declared in order."""
    rows = declared.withColumn("aliases", aliases(F.col("name"), F.col("path"))).select("occ", "chunk_seq", "name", "aliases")
    rows = rows.withColumn("first", F.min("occ").over(Window.partitionBy("chunk_seq")))
    stretches = max(1, -(-declared.count() // STRETCH))
    dealt = rows.repartitionByRange(stretches, "first").drop("first")
    rows = stored(dealt.withColumn("stretch", F.spark_partition_id()), "occurrences")
    asked = stored(rows.select("stretch", F.explode("aliases").alias("alias")).filter("alias is not null").distinct(), "aliases")
    left = stored(_guessed(rows, guess), "state") if guess is not None and stretches > 1 else None
    while stretches > 1:
        new = stored(_in_order(rows, _before(asked, left), f"stretch int, {STATE}", _left), "state")
        if left is not None and new.count() == left.count() and new.exceptAll(left).isEmpty():
            break
        left = new
    found = stored(_in_order(rows, _before(asked, left), "occ long, entity string", _answers), "entities")
    return declared.join(found.hint("merge"), "occ").select(*declared.columns, "entity")


def _guessed(rows: DataFrame, guess: DataFrame) -> DataFrame:
    """What each stretch would leave if guess(occ, entity) held, and each other occurrence were its own entity."""
    said = rows.join(guess.select("occ", "entity").hint("merge"), "occ", "left").withColumn("entity", F.coalesce("entity", "name"))
    born = said.groupBy("entity").agg(F.min(F.struct(F.col("occ").cast("long").alias("born"), "stretch")).alias("b")).select("entity", "b.born", F.col("b.stretch").alias("at"))
    used = said.select("entity", "stretch", F.explode("aliases").alias("alias")).distinct().join(born.hint("merge"), "entity").select("stretch", "alias", F.struct("born", "entity").alias("o"), F.lit(None).cast("long").alias("since"))
    own = born.select(F.col("at").alias("stretch"), F.col("entity").alias("alias"), F.lit(None).cast("struct<born: long, entity: string>").alias("o"), F.col("born").alias("since"))
    both = used.unionByName(own).groupBy("stretch", "alias").agg(F.min("o").alias("o"), F.min("since").alias("since"))
    return both.select("stretch", "alias", "o.born", "o.entity", "since")


def _before(asked: DataFrame, left: DataFrame | None) -> DataFrame | None:
    """(stretch, STATE) of what the aliases asked(stretch, alias) stood for before each stretch."""
    if left is None:
        return None
    state = left.select("stretch", "alias", F.when(F.col("entity").isNotNull(), F.struct("born", "entity")).alias("o"), "since", F.lit(False).alias("x_asked"))
    marks = asked.select("stretch", "alias", F.lit(True).alias("x_asked"))
    earlier = Window.partitionBy("alias").orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    every = state.unionByName(marks, allowMissingColumns=True).select("stretch", "alias", "x_asked", F.min("o").over(earlier).alias("o"), F.min("since").over(earlier).alias("since"))
    return every.filter("x_asked and (o is not null or since is not null)").select("stretch", "alias", "o.born", "o.entity", "since")


def _in_order(rows: DataFrame, before: DataFrame | None, schema: str, told: Callable) -> DataFrame:
    """What `told` makes of each stretch's occurrences, taken in order."""
    if before is None:
        return rows.groupBy("stretch").applyInArrow(lambda mine: told(mine, None), schema)
    return rows.groupBy("stretch").cogroup(before.groupBy("stretch")).applyInArrow(lambda mine, known: told(mine, known), schema)


def _taken(mine: pa.Table, known: pa.Table | None) -> tuple[list, list, dict, dict]:
    """occ and entity of a stretch's occurrences in order; what aliases came to stand for, and which entities were born."""
    oldest, since, new_oldest, new_since = {}, {}, {}, {}
    for x in known.to_pylist() if known is not None else ():
        if x["entity"] is not None:
            oldest[x["alias"]] = (x["born"], x["entity"])
        if x["since"] is not None:
            since[x["alias"]] = x["since"]
    mine = mine.sort_by("occ")
    occs, said, chunk, now = mine.column("occ").to_pylist(), [], None, {}
    for occ, c, name, names in zip(occs, *(mine.column(x).to_pylist() for x in ("chunk_seq", "name", "aliases")), strict=True):
        if c != chunk:
            chunk, now = c, {}
        entity, names = name, [x for x in names if x is not None]
        for x in names:
            if x in now:
                entity = now[x]
            elif x in since:
                entity = x
            elif x in oldest:
                born, entity = oldest[x]
                since.setdefault(entity, born)
            else:
                continue
            break
        said.append(entity)
        if entity is None:
            continue
        if entity not in since:
            since[entity] = new_since[entity] = occ
        met = (since[entity], entity)
        for x in names:
            now[x] = entity
            if x not in oldest or met < oldest[x]:
                oldest[x] = new_oldest[x] = met
        now[entity] = entity
    return occs, said, new_oldest, new_since


def _left(mine: pa.Table, known: pa.Table | None) -> pa.Table:
    _, _, oldest, since = _taken(mine, known)
    names = list(oldest | since)
    met = [oldest.get(x, (None, None)) for x in names]
    stretch = pa.array([mine.column("stretch")[0].as_py()] * len(names), pa.int32())
    return pa.table({"stretch": stretch, "alias": pa.array(names, pa.string()), "born": pa.array([m[0] for m in met], pa.int64()), "entity": pa.array([m[1] for m in met], pa.string()), "since": pa.array([since.get(x) for x in names], pa.int64())})


def _answers(mine: pa.Table, known: pa.Table | None) -> pa.Table:
    occs, said, _, _ = _taken(mine, known)
    return pa.table({"occ": pa.array(occs, pa.int64()), "entity": pa.array(said, pa.string())})


def directories(path: Column) -> Column:
    """All folders above a path, from the top one down."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def rolled_up(file_decl: DataFrame, keys: list[str], root: str = "") -> DataFrame:
    """(directory, *keys) once for every folder above a file that has them; `root` stands for the top and takes all files."""
    up = file_decl.select(F.explode(F.concat(F.array(F.lit(root)), directories(F.col("path")))).alias("directory"), *keys)
    return up.dropDuplicates(["directory", *keys])


def build_graph(files: DataFrame, chunks: DataFrame, registered: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(node_id, kind, name, path) and edges(src, dst, relation) of a source tree.

    files(path), chunks(path, ord, chunk_id), registered(entity, chunk_id, type), resolved(resolved,
    chunk_id). An entity's call edge goes from the entity to the chunk, unless the chunk declares it.
    Node ids carry their kind, so that a file and an entity of one name stay apart.
    """
    folders = files.select(F.explode(directories(F.col("path"))).alias("path")).distinct()

    def above(kind: str, path: str) -> Column:
        parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
        return F.when(parent == "", F.lit("root")).otherwise(F.concat(F.lit("directory:"), parent))

    entities = registered.select("entity").union(resolved.select(F.col("resolved").alias("entity"))).distinct()
    nodes = [
        files.sparkSession.createDataFrame([("root", "root", "root", "")], "node_id string, kind string, name string, path string"),
        folders.select(F.concat(F.lit("directory:"), "path"), F.lit("directory"), F.element_at(F.split("path", "/"), -1), "path"),
        files.select(F.concat(F.lit("file:"), "path"), F.lit("file"), F.element_at(F.split("path", "/"), -1), "path"),
        chunks.select(F.concat(F.lit("chunk:"), "chunk_id"), F.lit("chunk"), "chunk_id", "path"),
        entities.select(F.concat(F.lit("entity:"), "entity"), F.lit("entity"), "entity", F.lit("")),
    ]
    # an entity and a chunk make one edge: of the declaration, if there is one
    uses = registered.select("entity", "chunk_id", F.lit(1).alias("declared")).unionByName(resolved.select(F.col("resolved").alias("entity"), "chunk_id", F.lit(0).alias("declared")))
    uses = uses.groupBy("entity", "chunk_id").agg(F.max("declared").alias("declared"))
    entity, chunk, is_declared = F.concat(F.lit("entity:"), "entity"), F.concat(F.lit("chunk:"), "chunk_id"), F.col("declared") == 1
    edges = [
        folders.select(above("directory", "path"), F.concat(F.lit("directory:"), "path"), F.lit("contains")),
        files.select(above("file", "path"), F.concat(F.lit("file:"), "path"), F.lit("contains")),
        chunks.select(F.concat(F.lit("file:"), "path"), F.concat(F.lit("chunk:"), "chunk_id"), F.lit("contains")),
        uses.select(F.when(is_declared, chunk).otherwise(entity), F.when(is_declared, entity).otherwise(chunk), F.when(is_declared, "declares").otherwise("called_by")),
    ]
    return _all(nodes, ["node_id", "kind", "name", "path"]), _all(edges, ["src", "dst", "relation"])


def _all(parts: list[DataFrame], names: list[str]) -> DataFrame:
    out = parts[0].toDF(*names)
    for p in parts[1:]:
        out = out.unionByName(p.toDF(*names))
    return out


