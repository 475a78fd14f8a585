"""Qualified names: languages, module paths, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "py": "python", "pyw": "python", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx", "rs": "rust", "go": "go", "html": "html", "htm": "html", "md": "markdown"}
#: Extensions of files from which entities are extracted.
EXTRACTED = ["py", "c", "cpp", "h", "hpp", "java", "js", "ts", "jsx", "tsx", "rs", "html"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of a file name; an unknown extension is returned itself."""
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, ext), ext)


def module_path(path: Column) -> Column:
    """A path without its extension, with dots between its parts."""
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def simple_name(name: Column) -> Column:
    """What follows the last `::`, else what follows the last dot."""
    return F.when(name.contains("::"), F.element_at(F.split(name, "::"), -1)).otherwise(F.element_at(F.split(name, r"\."), -1))


def include_path(include: Column) -> Column:
    """The module path of an included file, written in angle brackets, quotes or plain."""
    return module_path(F.regexp_replace(include, r"^[<>\"]+|[<>\"]+$", ""))


#: When a path component looks like a temporary folder's name.
TEMPORARY_PREFIX, LONGER_THAN, MORE_DIGITS_THAN = "tmp", 8, 2


def _temporary(part: Column) -> Column:
    low = F.regexp_replace(part, r"[^\p{Ll}]", "")
    digits = F.regexp_replace(part, "[^0-9]", "")
    long_id = (F.length(part) > LONGER_THAN) & part.rlike(r"^[\p{L}\p{Nd}_-]*[\p{L}\p{Nd}][\p{L}\p{Nd}_-]*$") & (F.length(low) * 2 > F.length(part)) & (F.length(digits) > MORE_DIGITS_THAN)
    return (part == "") | (part.startswith(TEMPORARY_PREFIX) & (F.length(part) > len(TEMPORARY_PREFIX))) | long_id


def aliases(name: Column, path: Column) -> Column:
    """The names by which an entity of a file can be called.

    Its own; its part after the last `::`; with a dot first, it after each suffix of the file's
    module path, parts that look temporary aside; it after that whole path; it after the path as it is.
    """
    raw = module_path(path)

    def prefixed(parts: Column) -> Column:
        n = F.size(parts)
        dotted = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("."), F.concat_ws(".", F.slice(parts, n - i + 1, i), name)))).otherwise(F.array().cast("array<string>"))
        return F.concat(dotted, F.when(n > 0, F.array(F.concat_ws(".", parts, name))).otherwise(F.array().cast("array<string>")))

    # the parts of a path are told once, not for each alias
    told = F.element_at(F.transform(F.array(F.filter(F.split(raw, r"\."), lambda p: ~_temporary(p))), prefixed), 1)
    return F.array_distinct(F.concat(F.array(name, F.element_at(F.split(name, "::"), -1)), told, F.array(F.concat(raw, F.lit("."), name))))
