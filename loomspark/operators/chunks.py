"""Ordered chunks of files: cutting, context, windows, joining and differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 2000
HEADER = "=" * 48
GAP = "\n[...]"


def fixed_chunks(files: DataFrame, key: str = "path", content: str = "content", size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """(key, ord, content): consecutive pieces of at most `size` characters; an empty file has none."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(content) - overlap) / step), F.when(F.length(content) > 0, 1).otherwise(0)).cast("int")
    cut = files.filter(F.length(content) > 0).select(key, content, F.explode(F.sequence(F.lit(0), last - 1)).alias("ord"))
    return cut.select(key, "ord", F.substring(content, F.col("ord") * step + 1, F.lit(size)).alias("content"))


#: Where source text is cut first, by language; then at blank lines, lines, words and characters.
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n    def "],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic "],
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass "],
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble "],
    "c": ["\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nstruct "],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype "],
    "markdown": ["\n# ", "\n## ", "\n### "],
    "html": ["<body", "<div", "<p", "<table"],
}


def _cut(text: str, size: int, separators: list[str]) -> Iterator[str]:
    """Pieces of at most size characters: cut before the first separator that occurs, small neighbours merged again."""
    if len(text) <= size:
        yield text
        return
    first = next((s for s in separators if s in text[1:]), "")
    rest = separators[separators.index(first) + 1 :] if first else []
    if not first:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    head, *tail = text.split(first)
    held = ""
    for part in [head, *(first + t for t in tail)]:
        if held and len(held) + len(part) > size:
            yield from _cut(held, size, rest)
            held = ""
        held += part
    if held:
        yield from _cut(held, size, rest)


def split_source(files: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """(path, ord, content, shared) of files(path, language, content), cut at the language's separators into pieces of at most `size` characters.

    Each piece begins with `shared` characters of the one before: `overlap`, or all that one added if that is
    less. A null or empty file has no pieces; `rejoined` gives the files back.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    def pieces(text: str, language: str) -> Iterator[tuple[str, int]]:
        tail = ""
        for own in _cut(text, size - overlap, [*SEPARATORS.get(language, []), "\n\n", "\n", " "]):
            yield tail + own, len(tail)
            tail = own[-overlap:] if overlap else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, c, n) for p, lang, text in zip(batch["path"], batch["language"], batch["content"], strict=True) if text for i, (c, n) in enumerate(pieces(text, lang))]
            yield pd.DataFrame(rows, columns=["path", "ord", "content", "shared"])

    return files.select("path", "language", "content").mapInPandas(run, "path string, ord int, content string, shared int")


def rejoined(pieces: DataFrame) -> DataFrame:
    """(path, n_chunks, longest, content) of the files that `split_source` cut, without what neighbours share."""
    rows = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "content", "shared"))).alias("p"), F.max(F.length("content")).alias("longest"))
    return rows.select("path", F.size("p").alias("n_chunks"), "longest", F.array_join(F.transform("p", lambda x: F.substring(x["content"], x["shared"] + 1, F.length(x["content"]))), "").alias("content"))


def joined(pieces: Column) -> Column:
    """Texts of structs (ord, content) in order, with a mark where some are missing between."""
    return F.array_join(F.transform(pieces, lambda x, i: F.concat(F.when((i > 0) & (x["ord"] != F.get(pieces, i - 1)["ord"] + 1), F.lit(GAP + "\n")).when(i > 0, F.lit("\n")).otherwise(F.lit("")), x["content"])), "")


def chunk_context(chunks: DataFrame, key: str = "path") -> DataFrame:
    """Every chunk with the ids of its neighbours and the text of the three joined."""
    w = Window.partitionBy(key).orderBy("ord")
    rows = chunks.withColumn("prev", F.lag(F.struct("ord", "content")).over(w)).withColumn("next", F.lead(F.struct("ord", "content")).over(w))
    three = rows.withColumn("three", F.filter(F.array("prev", F.struct("ord", "content"), "next"), lambda x: x.isNotNull()))
    return three.select(key, "ord", F.col("prev.ord").alias("prev_ord"), F.col("next.ord").alias("next_ord"), joined(F.col("three")).alias("context"))


def join_files(chunks: DataFrame, key: str = "path") -> DataFrame:
    """Each file's chunks in order, under a header with its name."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("pieces"))
    return rows.select(key, F.concat(F.lit(HEADER + "\n"), F.col(key).cast("string"), F.lit("\n" + HEADER + "\n"), joined(F.col("pieces"))).alias("text"))


def ngrams(chunks: DataFrame, key: str = "path", longest: int = 4) -> DataFrame:
    """(key, first_ord, last_ord, n): all runs of 2 to `longest` consecutive chunks of a file."""
    w = Window.partitionBy(key).orderBy("ord")
    ends = F.array(*[F.lead("ord", k).over(w) for k in range(1, longest)])
    rows = chunks.select(key, F.col("ord").alias("first_ord"), ends.alias("ends"))
    spans = rows.select(key, "first_ord", F.posexplode("ends").alias("k", "last_ord"))
    return spans.filter("last_ord is not null").select(key, "first_ord", "last_ord", (F.col("k") + 2).cast("long").alias("n"))


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(id_a, text_a, id_b, text_b) with their unified line difference; an empty text gives an error instead."""

    @F.pandas_udf("struct<diff: string, error: string>")
    def diff(a: pd.Series, b: pd.Series, name_a: pd.Series, name_b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, m, n in zip(a, b, name_a, name_b, strict=True):
            if not x or not y:
                rows.append((None, "a chunk has no content"))
            else:
                rows.append(("\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), m, n, lineterm="")), None))
        return pd.DataFrame(rows, columns=["diff", "error"])

    out = pairs.withColumn("d", diff("text_a", "text_b", F.col("id_a").cast("string"), F.col("id_b").cast("string")))
    return out.select("id_a", "id_b", F.col("d.diff").alias("diff"), F.col("d.error").alias("error"))
