"""Declared and called entities of source files.

Python is read with the standard library's parser, languages with braces by the forms of `scopes`,
and HTML by Spark's regular expressions, its scripts like other scripts.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.names import EXTRACTED, extension, language, simple_name
from loomspark.operators.scopes import _Reader, list_files, read_files

#: Decorators that declare an endpoint.
VERBS = {"get", "post", "put", "patch", "delete", "head", "options", "route", "api_view"}

#: What HTML declares and calls: (role, type, pattern, groups of which one holds the name).
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
HTML = [("declared", "element", rf"(?i)<[a-z][^<>]*?\sid{VALUE}"), ("declared", "element", rf"(?i)<[a-z][^<>]*?\sname{VALUE}"), ("declared", "class", rf"(?i)<[a-z][^<>]*?\sclass{VALUE}"), ("called", "script", rf"(?i)<script\b[^<>]*?\ssrc{VALUE}")]
#: Scripts within a page: handlers and the text of script elements without a source.
HANDLER, SCRIPT = rf"(?i)\son[a-z]+{VALUE}", r"(?is)<script(?![^>]*\ssrc\s*=)[^>]*>(.*?)</script"
#: Languages that are read as another one.
READ_AS = {"jsx": "js", "ts": "js", "tsx": "js"}


def _found(pattern: str, content: Column) -> Column:
    """Values of an attribute, in order, whichever way they are quoted."""
    groups = [F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(groups[0], lambda x, i: F.concat(x, F.get(groups[1], i), F.get(groups[2], i)))


def html_entities(pages: DataFrame) -> DataFrame:
    """Entities (path, role, pos, name, type) of the markup of pages(path, content): ids, names, each class, sources of scripts; each once."""
    hits = [F.transform(_found(pattern, F.col("content")), _as_entity(role, kind, k)) for k, (role, kind, pattern) in enumerate(HTML)]
    rows = pages.select("path", F.explode(F.flatten(F.array(*hits))).alias("e")).select("path", "e.*")
    names = F.when(F.col("type") == "class", F.split(F.trim("name"), r"\s+")).otherwise(F.array("name"))
    rows = rows.select("path", "role", "pos", F.posexplode(names).alias("k", "name"), "type").filter("name != ''")
    return rows.groupBy("path", "role", "name", "type").agg(F.min(F.struct("pos", "k")).alias("first")).select("path", "role", F.col("first.pos").alias("pos"), "name", "type")


def page_scripts(content: Column) -> Column:
    """The scripts of a page: handlers, then script elements, in one text."""
    return F.array_join(F.concat(_found(HANDLER, content), F.regexp_extract_all(content, F.lit(SCRIPT), F.lit(1))), "\n;\n")


def _as_entity(role: str, kind: str, order: int):
    return lambda name, i: F.struct(F.lit(role).alias("role"), (F.lit(order * 100_000) + i).alias("pos"), name.alias("name"), F.lit(kind).alias("type"))


#: Fields of Python's trees below which nothing is declared or called.
PLAIN_FIELDS = {"ctx", "op", "ops", "id", "attr", "arg", "name", "names", "module", "type_comment"}
#: The fields of each kind of node that are walked, last first; names and constants are not.
WALKED = {kind: tuple(f for f in reversed(kind._fields) if f not in PLAIN_FIELDS) for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and kind not in (ast.Name, ast.Constant)}


def _code(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else ast.unparse(node)


class _Python:
    """Entities of one Python module."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.scope: list[str] = []
        self.types: dict[str, str] = {}

    def visit(self, tree: ast.AST) -> None:
        """Reports a tree's nodes in order, without recursion, so that no depth is too great."""
        open_nodes: list[ast.AST | None] = [tree]
        while open_nodes:
            node = open_nodes.pop()
            if node is None:  # the end of a class
                self.scope.pop()
                continue
            kind = type(node)
            report = REPORTED.get(kind)
            if report:
                report(self, node)
                if kind is ast.ClassDef:
                    open_nodes.append(None)
            for field in WALKED[kind]:  # the last field first, since the last one in comes out first
                value = getattr(node, field, None)
                if not value:
                    continue
                if type(value) is list:
                    for x in reversed(value):
                        if type(x) in WALKED:
                            open_nodes.append(x)
                elif type(value) in WALKED:
                    open_nodes.append(value)

    def declare(self, name: str, kind: str, dtype: str | None = None, endpoint: str | None = None, method: str | None = None) -> None:
        self.rows.append(("declared", name, kind, dtype, endpoint, method))

    def call(self, name: str | None) -> None:
        if name:
            self.rows.append(("called", name, None, None, None, None))

    @staticmethod
    def methods(call: ast.Call) -> list[str]:
        """The verbs that a decorator lists as methods."""
        listed = [k.value for k in call.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple, ast.Set))]
        return [x.value.upper() for given in listed for x in given.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)]

    @staticmethod
    def dotted(node: ast.AST) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None

    def type_declared(self, node: ast.ClassDef) -> None:
        self.declare(".".join([*self.scope, node.name]), "class")
        for base in node.bases:
            self.call(self.dotted(base))
        self.scope.append(node.name)

    def function_declared(self, node: ast.FunctionDef) -> None:
        name = ".".join([*self.scope, node.name])
        self.declare(name, "method" if self.scope else "function", _code(node.returns) if node.returns else None)
        for d in node.decorator_list:
            verb = d.func.attr if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) else d.func.id if isinstance(d, ast.Call) and isinstance(d.func, ast.Name) else None
            if verb in VERBS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                for method in self.methods(d) or ["GET"] if verb in ("route", "api_view") else [verb.upper()]:
                    self.declare(name, "api_endpoint", None, d.args[0].value, method)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.arg not in ("self", "cls"):
                dtype = _code(a.annotation) if a.annotation else None
                self.declare(f"{name}.{a.arg}" if self.scope else a.arg, "variable", dtype)
                if dtype:
                    self.types[a.arg] = dtype

    def _target(self, target: ast.AST, dtype: str | None) -> None:
        if isinstance(target, ast.Name) and not self.scope:
            self.declare(target.id, "variable", dtype)
            if dtype:
                self.types[target.id] = dtype
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and self.scope:
            self.declare(f"{self.scope[-1]}.{target.attr}", "variable", dtype)

    def assigned(self, node: ast.Assign) -> None:
        dtype = self.dotted(node.value.func) if isinstance(node.value, ast.Call) else None
        for t in node.targets:
            self._target(t, dtype)

    def annotated(self, node: ast.AnnAssign) -> None:
        self._target(node.target, _code(node.annotation))

    def imported(self, node: ast.Import) -> None:
        for a in node.names:
            self.call(a.name)

    def imported_from(self, node: ast.ImportFrom) -> None:
        self.call(node.module)
        for a in node.names:
            self.call(f"{node.module}.{a.name}" if node.module else a.name)

    def called(self, node: ast.Call) -> None:
        name = self.dotted(node.func)
        if name and "." in name:
            owner, _, rest = name.partition(".")
            name = f"{self.types[owner]}.{rest}" if owner in self.types else f"{self.scope[-1]}.{rest}" if owner == "self" and self.scope else name
        self.call(name)


#: What reports a node of a kind.
REPORTED = {ast.ClassDef: _Python.type_declared, ast.FunctionDef: _Python.function_declared, ast.AsyncFunctionDef: _Python.function_declared, ast.Assign: _Python.assigned, ast.AnnAssign: _Python.annotated, ast.Import: _Python.imported, ast.ImportFrom: _Python.imported_from, ast.Call: _Python.called}


def read_entities(code: str, lang: str) -> list[tuple]:
    """Entities of one text in a language; Python that does not parse has none."""
    if lang != "python":
        return _Reader(code, lang).read()
    found = _Python()
    try:
        found.visit(ast.parse(code))
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nested too deep for the parser
        return []
    return found.rows


def python_entities(files: DataFrame) -> DataFrame:
    """Entities of Python files(path, content), each once by (role, name, type, dtype, endpoint, method), in order."""
    return read_files(files.filter(extension(F.col("path")) == "py").select("path", F.lit("python").alias("lang"), "content"), read_entities)


def entities(files: DataFrame) -> DataFrame:
    """Entities of all files(path, content) in languages that are read.

    Texts of all languages, the scripts of pages included, are read in one pass; the markup of pages is read by itself.
    """
    code = _texts(files).select("path", "lang", F.col("code").alias("content"))
    return read_files(code, read_entities).unionByName(html_entities(_pages(files)), allowMissingColumns=True)


def _texts(files: DataFrame) -> DataFrame:
    """Files with the language as which they are read, and the text (code) that is read: of pages their scripts."""
    ext = extension(F.col("path"))
    read_as = F.create_map(*[F.lit(x) for pair in READ_AS.items() for x in pair])
    lang = F.when(ext.isin("h", "hpp"), "cpp").otherwise(language(F.col("path")))
    lang = F.when(ext == "html", "js").otherwise(F.coalesce(F.element_at(read_as, lang), lang))
    text = F.when(ext == "html", page_scripts(F.col("content"))).otherwise(F.col("content"))
    return files.filter(ext.isin(EXTRACTED)).select("path", lang.alias("lang"), text.alias("code"), "content")


def _pages(files: DataFrame) -> DataFrame:
    return files.filter(extension(F.col("path")) == "html")


#: A string on one line, in either quotes; it stays, and hides what looks like a comment in it.
STRINGS = r"""(\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""


def without_comments(content: Column, lang: str) -> Column:
    """A chunk without comments (and Python docstrings), strings aside; each chunk is read by itself."""
    if lang == "python":
        return F.regexp_replace(content, r'(?s)""".*?(?:"""|\z)|\'\'\'.*?(?:\'\'\'|\z)|' + STRINGS + r"|#[^\n]*", "$1")
    return F.regexp_replace(content, r"(?s)/\*.*?(?:\*/|\z)|" + STRINGS + r"|//[^\n]*", "$1")


#: How a declaration or call shows in a chunk, by language and type; {} is its simple name. Types without a rule are not looked up.
PYTHON_RULES = {"class": r"(?m)^\s*class\s+{}[\s:(]|\b{}\s*\(", "function": r"\b{}\s*\(", "method": r"\b{}\s*\(", "api_endpoint": r"(?m)^\s*(?:async\s+)?def\s+{}\s*\(", "variable": r"\b{}\b", "called": r"\b{}\b"}
C_RULES = {"class": r"(?m)^\s*(?:class|struct)\s+{}[\s:{{]", "function": r"\b{}\s*\(", "method": r"\b{}\s*\(", "variable": r"\b{}\b", "called": r"\b{}\s*\("}
JAVA_RULES = {"class": r"\b{}\b", "function": r"\b{}\s*\(", "method": r"\b{}\s*\(", "api_endpoint": r"\b{}\s*\(", "variable": r"\b{}\b", "called": r"\b{}\b"}


def _rule(rules: dict[str, str], kind: Column, base: Column) -> Column:
    """The pattern for an entity of a kind, null where there is none."""
    quoted = F.concat(F.lit(r"\Q"), base, F.lit(r"\E"))
    out = F.lit(None).cast("string")
    for name, pattern in rules.items():
        pieces = [F.lit(p.replace("{{", "{")) for p in pattern.split("{}")]
        whole = F.concat(*[x for k, p in enumerate(pieces) for x in ((quoted, p) if k else (p,))])
        out = F.when(kind == name, whole).otherwise(out)
    return out


def entities_in_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which chunks of its file an entity shows in, comments aside: found(path, role, pos, name, type), chunks(path, ord, chunk_id, language, content).

    Entities meet chunks by a word of their simple name, so no file's entities meet all its chunks;
    the language's rule for the entity's type then decides. The words are shuffled without the chunks' code, which
    joins what has met; nothing is broadcast, since words and code outgrow what Spark expects of their source. C and C++ classes, variables and calls
    with a namespace also show where the chunk uses that namespace. Languages without rules of
    their own follow Python's.
    """
    clean = chunks.withColumn("code", _plain(F.col("language"), F.col("content")))
    per_word = clean.select("path", "ord", F.explode(_words(F.col("code"))).alias("word"))
    base = simple_name(F.col("name"))
    named = found.withColumn("base", base).withColumn("word", F.element_at(F.regexp_extract_all("base", F.lit(r"[\w$]+"), F.lit(0)), -1)).filter("word is not null")
    met = named.join(per_word.hint("merge"), ["path", "word"])
    return _showing(met.join(clean.select("path", "ord", "chunk_id", "language", "code").hint("merge"), ["path", "ord"]))


def _plain(lang: Column, content: Column) -> Column:
    return F.when(lang == "python", without_comments(content, "python")).otherwise(without_comments(content, "c"))


def _words(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"[\w$]+"), F.lit(0)))


def cut_by(pieces: Callable[[Column, Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A cut of files(path, content) into chunks(path, ord, chunk_id, language, content), by an array of structs of the last four that pieces(path, content) tells.

    What knows its `pieces` can be read and mapped to chunks file by file.
    """

    def cut(files: DataFrame) -> DataFrame:
        return files.select("path", F.explode(pieces(F.col("path"), F.col("content"))).alias("x_piece")).select("path", "x_piece.*")

    cut.pieces = pieces
    return cut


def located(files: DataFrame, cut: Callable[[DataFrame], DataFrame], once: bool = False) -> DataFrame:
    """What entities_in_chunks says of the entities and chunks of files(path, content), where each path is one row: with once each (role, name, type) of a file counts once.

    A cut by pieces is made in the pass that reads a file: its entities and chunks stand in one row, and nothing is shuffled.
    """
    if not hasattr(cut, "pieces"):
        found = entities(files)
        found = found.groupBy("path", "role", "name", "type").agg(F.min("pos").alias("pos")) if once else found
        return entities_in_chunks(found, cut(files))
    rows = list_files(_texts(files), read_entities, once).filter(F.size("entities") > 0)
    rows = rows.select("path", "entities", F.explode(cut.pieces(F.col("path"), F.col("content"))).alias("x"))
    rows = rows.select("path", "entities", "x.ord", "x.chunk_id", "x.language", _plain(F.col("x.language"), F.col("x.content")).alias("code"))
    known = F.transform("entities", lambda e: e["word"])
    rows = rows.select("*", F.explode(F.array_intersect(_words(F.col("code")), known)).alias("word"))
    rows = rows.select("path", "ord", "chunk_id", "language", "code", F.explode(F.filter("entities", lambda e: e["word"] == F.col("word"))).alias("e"))
    shown = _showing(rows.select("path", "ord", "chunk_id", "language", "code", "e.role", "e.pos", "e.name", "e.type", "e.base"))
    pages = _pages(files)
    return shown.unionByName(entities_in_chunks(html_entities(pages), cut(pages)))


def _showing(rows: DataFrame) -> DataFrame:
    """Rows of entities (with their simple name, base) and chunks that hold their word: those that show there by the rules of the chunk's language."""
    kind = F.when(F.col("role") == "called", "called").otherwise(F.col("type"))
    family = F.when(F.col("language").isin("c", "cpp"), "c").when(F.col("language") == "java", "java").otherwise("python")
    rule = F.when(family == "c", _rule(C_RULES, kind, F.col("base"))).when(family == "java", _rule(JAVA_RULES, kind, F.col("base"))).otherwise(_rule(PYTHON_RULES, kind, F.col("base")))
    spaces = F.regexp_extract_all("code", F.lit(r"(?m)^\s*using\s+namespace\s+([A-Za-z_][\w:]*)\s*;"), F.lit(1))
    in_reach = ~F.col("name").contains("::") | F.exists(spaces, lambda n: F.col("name").startswith(F.concat(n, F.lit("::"))))
    identifier = F.rlike("code", F.concat(F.lit(r"\b\Q"), F.col("base"), F.lit(r"\E\b")))
    by_space = (family == "c") & kind.isin("class", "variable", "called") & in_reach & identifier
    return rows.filter(by_space | F.coalesce(F.rlike("code", rule), F.lit(False))).select("path", "role", "pos", "name", "type", "chunk_id", "ord")
