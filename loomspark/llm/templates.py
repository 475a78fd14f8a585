"""Benchmark decontamination by canonical templates: numbers, names and units become typed slots.

A text is cut into tokens (runs of letters, or numbers). In its template a number is `0`, a
capitalised word that is no function word `1`, a unit right after a number `2`, any other word its
lower-case form; so a token has the same template wherever it stands. Windows of documents and items
are joined by the hash of their template, and by that of their lower-case tokens, which finds
what has too few words for a template or was copied in other case. Then the
slots of all matched windows of one alignment are compared: one value of the item must stand for
one value of the document throughout, unless enough windows are equal word for word. That finds an item also when its numbers or names were
exchanged, but not a text that merely has slots in the same places.

All steps are DataFrame functions. The hash of a window comes from those of its halves, so that
each token is read once. The item windows are broadcast only if there are at most
BROADCAST_WINDOWS of them; else both sides are shuffled by hash.

Edge cases: null and empty texts have no windows; items of SHORT to WINDOW - 1 tokens are matched
as a whole, by windows of SHORT tokens, shorter ones never; items with the same text are all
returned; documents without a doc_id are returned with a null one; equal rows of documents count
once; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import stored

WINDOW = 8
SHORT = 4
#: Words (not slots) that a window of each size needs to be matched by its template.
LEAST_WORDS = {WINDOW: 4, SHORT: 3}
#: Matched windows of one alignment that make a leak (or all that the item has, if fewer).
MIN_WINDOWS = 3
BROADCAST_WINDOWS = 1_000_000
#: Documents with a matched window whose keys (longs) are still broadcast, rather than shuffling all texts.
BROADCAST_KEYS = 1_000_000
#: Units, in lower case.
UNITS = "km m cm mm mi ft in kg g mg lb oz t l ml s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year usd eur gbp dollars dollar euros euro cents percent degrees".split()

#: Function words that are no names where they are capitalised.
FUNCTION_WORDS = (
    "a an the this that these those and or but if then so as at by for from in into of on to with without after before when while where who what which how why "
    "i you he she it we they his her its our their my your is are was were be has have had do does did can could will would shall should may might must not no all any each every some there here "
    "le la les un une des et ou mais il elle nous vous ils elles ce cette dans pour avec sur "
    "der die das ein eine und oder aber er sie es wir ihr ist sind war im mit von zu auf "
    "el los las una y o pero ella nosotros ellos en con para por es son"
).split()

NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
TOKEN = rf"{NUMBER}|[\p{{L}}\p{{M}}]+"


def raw_tokens(text: Column) -> Column:
    """Numbers and runs of letters as they stand."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def templates_of(raw: Column) -> Column:
    """Templates of raw tokens, one for each: a number is `0`, a unit after a number `2`, a capitalised word that is no function word `1`, others are in lower case."""

    def slot(t: Column, i: Column) -> Column:
        low, first = F.lower(t), t.substr(1, 1)
        after = F.coalesce(F.get(raw, i - 1) < ":", F.lit(False))
        capital = (t >= "A") & (t < "[") | (t > "\u007f") & (first != F.lower(first))
        return F.when(t < ":", "0").when(after & low.isin(UNITS), "2").when(capital & ~low.isin(FUNCTION_WORDS), "1").otherwise(low)

    return F.transform(raw, slot)


def template_tokens(text: Column) -> Column:
    """As many tokens as raw_tokens, with slots as single digits."""
    return templates_of(raw_tokens(text))


def _is_word(t: Column) -> Column:
    """Templates of words begin with a letter, slots are digits."""
    return t > ":"


def _joined(values: Column, step: int) -> Column:
    """Hashes of windows of twice the size from those of windows of `step` tokens."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _hashed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the hashes of all windows of SHORT and WINDOW tokens: t_4, t_8 of templates, r_4, r_8 of lower-case tokens. docs has tpl and raw."""
    out = docs.select(*keep, F.transform("tpl", lambda t: F.xxhash64(t)).alias("t_1"), F.transform("raw", lambda t: F.xxhash64(F.lower(t), F.lit(0))).alias("r_1"))
    for step in (1, 2, 4):
        kept = ["t_4", "r_4"] if step == 4 else []
        out = out.select(*keep, *kept, *(_joined(F.col(f"{x}_{step}"), step).alias(f"{x}_{2 * step}") for x in "tr"))
    return out


def _places(hashed: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """keep, hash, at, size and kind (t by its template, r by its words) of every window of these sizes."""
    parts = [(x, size) for size in sizes for x in "tr"]
    listed = F.concat(*[F.col(f"{x}_{size}") for x, size in parts])
    out = hashed.select(*keep, *[F.size(f"{x}_{size}").alias(f"n_{x}_{size}") for x, size in parts], F.posexplode(listed).alias("pos", "hash"))
    at, size, kind, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(0)
    starts = []
    for x, wide in parts:
        starts.append((x, wide, before))
        before = before + F.col(f"n_{x}_{wide}")
    for x, wide, first in starts:
        mine = F.col("pos") >= first
        at, size, kind = F.when(mine, F.col("pos") - first + 1).otherwise(at), F.when(mine, wide).otherwise(size), F.when(mine, x).otherwise(kind)
    return out.select(*keep, "hash", at.alias("at"), size.alias("size"), kind.alias("kind"))


def _cut(texts: DataFrame, keep: list[str]) -> DataFrame:
    """keep, raw and tpl tokens of texts(text)."""
    return texts.select(*keep, raw_tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("raw")).select(*keep, "raw", templates_of(F.col("raw")).alias("tpl"))


def item_windows(items: DataFrame) -> DataFrame:
    """item (the least item_id of a text), hash, at, size, raw and template slices of each window that can be matched."""
    cut = _cut(items, ["item"]).filter(F.size("raw") >= SHORT).withColumn("of", F.when(F.size("raw") >= WINDOW, WINDOW).otherwise(SHORT))
    places = _places(_hashed(cut, ["item", "of"]), ["item", "of"], [SHORT, WINDOW]).filter("size = of").drop("of")
    cut = places.join(cut, "item").select("item", "hash", "at", "size", "kind", F.slice("raw", F.col("at"), F.col("size")).alias("raw"), F.slice("tpl", F.col("at"), F.col("size")).alias("tpl"))
    least = F.when(F.col("size") == WINDOW, LEAST_WORDS[WINDOW]).otherwise(LEAST_WORDS[SHORT])
    return cut.filter((F.col("kind") == "r") | (F.size(F.filter("tpl", _is_word)) >= least)).drop("kind")


def _key() -> Column:
    """128 bits that name a document's doc_id and text."""
    doc_id, text = F.col("doc_id"), F.col("text").cast("string")
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def matched(docs: DataFrame, items: DataFrame, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """doc_id, key (of doc_id and text) and item_id of documents that hold a benchmark item, with counts of windows and slots."""
    named = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    first = named.groupBy("text").agg(F.min("item_id").alias("item"))
    asked = stored(item_windows(first), "items")
    facts = asked.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", _key())
    probes = asked.select("hash").distinct()
    probes = F.broadcast(probes) if facts.n <= BROADCAST_WINDOWS else probes
    places = _places(_hashed(_cut(keyed, ["key"]), ["key"]), ["key"], sorted(facts.sizes) or [WINDOW])
    hits = stored(places.join(probes, "hash").select("key", "hash", "at", "size").distinct(), "hits")

    found = keyed.join(_small_side(stored(hits.select("key").distinct(), "keys")), "key", "left_semi").dropDuplicates(["key"])
    cut = _cut(found, ["doc_id", "key"])
    mine = hits.join(cut, "key").select("doc_id", "key", "hash", F.col("at").alias("here"), F.slice("raw", F.col("at"), F.col("size")).alias("words"), F.slice("tpl", F.col("at"), F.col("size")).alias("mine"))
    low = lambda words: F.transform(words, F.lower)
    same = mine.join(asked, "hash").withColumn("verbatim", low("words") == low("raw")).filter(F.col("verbatim") | (F.col("mine") == F.col("tpl")))
    pairs = F.transform(F.arrays_zip(F.col("tpl").alias("t"), F.col("raw").alias("a"), F.col("words").alias("b")), lambda z: F.struct(z["t"].alias("t"), F.lower(z["a"]).alias("a"), F.lower(z["b"]).alias("b")))
    slots = F.filter(pairs, lambda z: z["t"].isin("0", "1", "2"))
    per = same.select("doc_id", "key", "item", "at", F.when(F.col("verbatim"), F.col("at")).alias("equal"), (F.col("here") - F.col("at")).alias("shift"), F.explode_outer(slots).alias("slot"))
    aligned = per.groupBy("doc_id", "key", "item", "shift").agg(F.countDistinct("at").alias("n"), F.size(F.collect_set("equal")).alias("n_equal"), F.collect_set("slot").alias("slots"), F.count_distinct("slot.t", "slot.a").alias("n_slots"))
    total = asked.groupBy("item").agg(F.countDistinct("at").alias("item_windows"), F.max("size").alias("size"))
    enough = F.when(F.col("size") == WINDOW, F.least(F.lit(min_windows), F.col("item_windows"))).otherwise(F.col("item_windows"))
    good = aligned.join(total, "item").filter((F.size("slots") == F.col("n_slots")) & (F.col("n") >= enough) | (F.col("n_equal") >= enough))
    changed = F.size(F.filter("slots", lambda s: s["a"] != s["b"]))
    best = good.groupBy("doc_id", "key", "item").agg(F.max("n").cast("long").alias("n_windows"), F.max("item_windows").cast("long").alias("item_windows"), F.max(F.col("n_slots")).cast("long").alias("n_slots"), F.min(changed).cast("long").alias("n_changed_slots"))
    # items with one text are matched once
    alike = named.join(first, "text").select("item", "item_id")
    return best.join(alike, "item").select("doc_id", "key", "item_id", "n_windows", "item_windows", "n_slots", "n_changed_slots")


def leaks(docs: DataFrame, items: DataFrame, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """Pairs (doc_id, item_id) with the counts of the best text of that doc_id."""
    found = matched(docs, items, min_windows).groupBy("doc_id", "item_id")
    return found.agg(*[F.max(c).alias(c) for c in ("n_windows", "item_windows", "n_slots")], F.min("n_changed_slots").alias("n_changed_slots"))


def _small_side(keys: DataFrame) -> DataFrame:
    """keys for a join with texts: broadcast if there are at most BROADCAST_KEYS of them, else both sides are shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, each judged by its own text, whatever its doc_id."""
    found = stored(matched(docs, items).select("key").distinct(), "leaks")
    # the row moves as one column, so that no name of it meets the key's
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"))
    return packed.join(_small_side(found), "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
