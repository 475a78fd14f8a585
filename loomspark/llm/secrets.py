"""Secret scans: fixed patterns, and tokens that look random to character Markov models.

All work on texts is done by DataFrame functions. Positions come from splitting a text at a
pattern: the pieces and the matches alternate, so that running sums of their lengths (in code
points) are the matches' places.

Two first-order Markov models over characters are trained from labelled samples: values that
the patterns found (random strings) and ordinary identifiers. These are words of letters, perhaps
numbered, that LEAST_TEXTS different texts of the sample hold, or LEAST_TEXTS_MIXED if they are candidates themselves; so a
secret that stands in one text, or in a text and a few near copies, does not train the model that it is held against. A token of
letters and digits, or of mixed case, is a further secret if its log-likelihood ratio exceeds a
threshold, which short tokens reach only if they look the more random, and it lies in no pattern's match. One that
reaches beyond pattern matches is judged, and redacted, as a whole.

Edge cases: a null or empty text has no spans; equal rows give equal results; without any
random sample no token is added; columns of other names are ignored. Digits and letters are
ASCII throughout.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import stored

#: The kinds of secrets, in the order in which spans at one place are listed.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs of 12 characters or more, with a letter and a digit, or with a capital after a small letter twice.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])|(?=[A-Za-z+/_=-]*[a-z][A-Z][A-Za-z+/_=-]*[a-z][A-Z]))[A-Za-z0-9+/_=-]{12,}"
#: Ordinary identifiers: letters and underscores, with at most a short number at the end.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{4,}[0-9]{0,3}(?![A-Za-z0-9+/_=-])"

#: Labelled samples for the two models: this many random strings, and the words of this many documents (chosen by hash).
SAMPLE_STRINGS = 20_000
SAMPLE_DOCS = 2_000
#: Texts of the sample (equal ones count once) that hold a word, for it to be an ordinary identifier.
LEAST_TEXTS = 3
#: The same for words that are candidates themselves, such as names in mixed case.
LEAST_TEXTS_MIXED = 20
THRESHOLD = 0.5
#: The whole ratio is as large at least as that of a string of so many transitions, so that short strings need more each.
LEAST_TRANSITIONS = 19
#: Weight of a character's own frequency against its frequency after the one before.
BACK_OFF = 10
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BLOCK = 256
SPAN = "array<struct<start: long, end: long, value: string>>"


def _starts(steps: Column, pieces: Column) -> Column:
    """For each match its start, from the lengths of each piece and match together: sums over blocks first, then within each block, so that long lists stay linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def running(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    heads = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x)), F.lit(0).cast("long"))
    before = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(heads, 1, F.size(heads) - 1).alias("h")), lambda z: F.slice(running(z["b"], z["h"]), 1, F.size(z["b"]))))
    return F.zip_with(before, pieces, lambda at, p: at + F.length(p))


def _spans_of(docs: DataFrame, keep: list[str], patterns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """keep and a column x_<name> for each pattern (regex, group of the value, its least length): leftmost matches that don't overlap, as (start, end, value)."""
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<string>")
    cut, counted, placed = [], [], []
    for name, (pattern, group, least) in patterns.items():
        hit = text.rlike(pattern)
        cut.append(F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{name}"))
        cut.append(F.when(hit, F.split(text, pattern, -1)).otherwise(none).alias(f"p_{name}"))
        if group:
            cut.append(F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none).alias(f"v_{name}"))
        matches, pieces, values = F.col(f"m_{name}"), F.col(f"p_{name}"), F.col(f"v_{name}" if group else f"m_{name}")
        counted += [matches, pieces, *([values] if group else [])]
        counted.append(F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: (F.length(m) + F.length(p)).cast("long")).alias(f"n_{name}"))
        starts = _starts(F.col(f"n_{name}"), F.slice(pieces, 1, F.size(matches)))
        zipped = F.arrays_zip(matches.alias("m"), values.alias("v"), starts.alias("s"))
        spans = F.transform(zipped, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["v"].alias("value")))
        if least:
            spans = _at_least(spans, least)
        placed.append(F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPAN)).alias(f"x_{name}"))
    return docs.select(*keep, *cut).select(*keep, *counted).select(*keep, *placed)


def _at_least(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


PATTERNS = {"assign": (ASSIGN, 2, ASSIGN_MIN), "access": (ACCESS, 0, 0), "hex": (HEX, 0, 0), "all": (CANDIDATE, 0, 0)}


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` and, for each text, the spans of the three patterns and the candidate tokens that lie in none of them."""
    found = _spans_of(docs, keep, PATTERNS)
    taken = F.concat("x_assign", "x_access", "x_hex")
    free = F.filter("x_all", lambda c: ~F.exists(taken, lambda s: (s["start"] <= c["start"]) & (c["end"] <= s["end"])))
    return found.withColumn("x_free", F.when(F.size("x_all") > 0, free).otherwise(F.col("x_all"))).drop("x_all")


def _transitions(strings: DataFrame) -> dict[str, int]:
    """Counts of character pairs of strings(value, n), each n times; at most the square of the alphabet."""
    pairs = strings.filter(F.length("value") > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.col("value").substr(i, F.lit(2)))).alias("pair"))
    return {r.pair: r.n for r in pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def ordinary_words(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """value and n (how many texts hold it) of the ordinary identifiers in a sample of docs(text)."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").select(F.xxhash64("text").alias("h"), "text")
    some = texts.join(F.broadcast(texts.select("h").orderBy("h").limit(sample_docs).distinct()), "h", "left_semi").dropDuplicates(["h"])
    clear = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    words = some.select(F.explode(F.array_distinct(F.regexp_extract_all(clear, F.lit(WORD), F.lit(0)))).alias("value"))
    return words.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.when(F.col("value").rlike(CANDIDATE), LEAST_TEXTS_MIXED).otherwise(LEAST_TEXTS))


def likelihood_weights(docs: DataFrame, scan: DataFrame, sample_strings: int = SAMPLE_STRINGS, sample_docs: int = SAMPLE_DOCS) -> dict[str, float]:
    """log P(random) - log P(identifier) of each character pair, smoothed by the characters' own frequencies; empty if there is no random sample."""
    values = scan.select(F.explode(F.concat("x_assign", "x_access", "x_hex")).alias("s")).select(F.col("s.value").alias("value")).distinct()
    random = _transitions(values.orderBy(F.xxhash64("value"), "value").limit(sample_strings).withColumn("n", F.lit(1)))
    if not random:
        return {}
    plain = _transitions(ordinary_words(docs, sample_docs))

    def logs(counts: dict[str, int]) -> dict[str, float]:
        rows = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        into = {b: sum(counts.get(a + b, 0) for a in ALPHABET) + 1 for b in ALPHABET}
        total = sum(into.values())
        return {a + b: math.log((counts.get(a + b, 0) + BACK_OFF * into[b] / total) / (rows[a] + BACK_OFF)) for a in ALPHABET for b in ALPHABET}

    one, other = logs(random), logs(plain)
    return {pair: round(one[pair] - other[pair], 6) for pair in one}


def looks_random(token: Column, weights: dict[str, float], threshold: float = THRESHOLD) -> Column:
    """Whether the log-likelihood ratio exceeds the threshold for each transition, and for LEAST_TRANSITIONS in all."""
    if not weights:
        return F.lit(False)
    n = len(ALPHABET)
    table = F.lit([weights[a + b] for a in ALPHABET for b in ALPHABET])
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: a * n + b)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    return total > threshold * F.greatest(F.length(token) - 1, F.lit(LEAST_TRANSITIONS))


def _spans(kinds: list[tuple[str, Column]]) -> Column:
    """All spans, by start and then by kind in the listed order."""

    def ranked(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))

    return F.array_sort(reduce(F.concat, [ranked(kind, spans) for kind, spans in kinds]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_secrets(scan: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds x_markov and x_spans (start, rank of the kind, end) to the scan."""
    scan = scan.withColumn("x_markov", F.filter("x_free", lambda c: looks_random(c["value"], weights)))
    return scan.withColumn("x_spans", _spans([(k, F.col(f"x_{k}")) for k in KINDS]))


def secret_spans(docs: DataFrame, sample_strings: int = SAMPLE_STRINGS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id and the spans of every row of docs(doc_id, text); the models are trained on bounded samples."""
    scan = stored(scanned(docs.select("doc_id", F.col("text").cast("string")), ["doc_id"]), "secrets")
    return with_secrets(scan, likelihood_weights(docs, scan, sample_strings, sample_docs))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = _spans([(k, F.col(f"x_{k}")) for k in KINDS[:3]])
    counts = [F.size(f"x_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("x_spans")).alias("spans"), counts[3])


def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed patterns alone, which SQL can state."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string")), ["doc_id"])
    base = _spans([(k, F.col(f"x_{k}")) for k in KINDS[:3]])
    return found.select("doc_id", *[F.size(f"x_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]], _joined(base).alias("base_spans"))


MARK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by a mark and n_chars counted anew; other rows and columns stay."""
    scan = scanned(docs.select(F.col("text").cast("string").alias("text")), [])
    weights = likelihood_weights(docs, stored(scan.drop("x_free").filter("size(x_assign) + size(x_access) + size(x_hex) > 0"), "secrets"))
    # the row moves as one column, so that no name of it meets those of the steps
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    found = with_secrets(scanned(packed, ["row", "text"]), weights)
    text = F.col("text")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MARK))).otherwise(acc["out"])
        return F.struct(clear.alias("out"), F.greatest(s["end"], acc["at"]).alias("at"))

    done = F.aggregate("x_spans", state, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.size("x_spans") > 0, done).otherwise(text)
    out = found.withColumn("x_text", clean)
    new = {"text": F.col("x_text"), "n_chars": F.length("x_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
