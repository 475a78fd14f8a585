"""Entities of languages with braces, with the scopes in which they stand.

A table of forms says what a declaration looks like, in which kind of scope it counts, and what
kind of scope its braces open. One walk over a file's braces and forms, in order of place, keeps
the scopes that are open. Comments and the inside of strings are blanked first, at equal length.
The tables find what is written in the usual way: macros and regular expression literals are not
followed, and types are not resolved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENTITY = "path string, role string, pos int, name string, type string, dtype string, endpoint string, method string"


def word(*names: str, but: str = "") -> str:
    """A pattern for any of the words where one begins (and no text stands before it); a pattern that starts with letters is searched fastest."""
    return "(?:" + "|".join(rf"{n}(?<=\b{n})" + (f"(?<!{but}{n})" if but else "") for n in names) + ")"


#: Repetitions give nothing back (+ after them) wherever what follows could not use it.
PARAMS = r"\((?P<params>[^()]*+(?:\([^()]*+\)[^()]*+)*+)\)"
#: A type of Java, C or C++ before a name; lengths are bounded so that long texts take time in proportion.
JAVA_TYPE = r"(?<![\w.])(?P<type>[A-Za-z_][\w.]*+(?:\s*<[^;(){}=]{0,200}>)?(?:\s*\[\s*\])*)\s++"
C_TYPE = r"(?<![\w:])(?P<type>(?:[A-Za-z_][\w:]*+(?:<[^;(){}=]{0,200}>)?[\s*&]++){1,5}?)"
RUST_TYPE = r"(?P<type>[^,;{}<=]+(?:<[^<>{}]*(?:<[^<>{}]*>[^<>{}]*)*>)?)"


class Form(NamedTuple):
    kind: str
    pattern: str
    inside: tuple[str, ...] = ()
    opens: str = "body"
    #: Whether the scope that it opens takes part in names.
    named: bool = False


#: Forms of declarations by language.
FORMS = {
    "java": [
        Form("class", word("class", "record") + r"\s+(?P<name>\w++)[^;{}]{0,400}+(?=\{)", ("top", "type"), "type", True),
        Form("interface", word("interface") + r"\s+(?P<name>\w++)[^;{}]{0,400}+(?=\{)", ("top", "type"), "type", True),
        Form("enum", word("enum") + r"\s+(?P<name>\w++)[^;{}]{0,400}+(?=\{)", ("top", "type"), "enum", True),
        Form("method", JAVA_TYPE + r"(?P<name>\w++)\s*+" + PARAMS + r"\s*+(?:throws[\w\s,.]{1,300})?(?=[{;])", ("type",)),
        Form("constructor", r"\b(?P<name>\w++)\s*+" + PARAMS + r"\s*+(?:throws[\w\s,.]{1,300})?(?=\{)", ("type",)),
        Form("variable", JAVA_TYPE + r"(?P<name>\w++(?:\s*+,\s*+\w++)*+)\s*+(?=[=;])", ("type",)),
    ],
    "js": [
        Form("class", word("class") + r"\s+(?P<name>[\w$]++)[^;{}]{0,400}+(?=\{)", (), "type", True),
        Form("function", word("function") + r"\s*\*?\s*(?P<name>[\w$]++)\s*(?:<[^(){}]{0,200}>\s*)?" + PARAMS + r"[^{};]{0,120}+(?=\{)", (), "body", True),
        Form("function", word("const", "let", "var") + r"\s+(?P<name>[\w$]++)\s*+=\s*(?:async\s+)?(?:function\b[^(){}]*" + PARAMS + r"\s*|(?:\([^()]*\)|[\w$]++)\s*+=>\s*)", (), "body", True),
        Form("variable", word("const", "let", "var") + r"\s+(?P<name>[\w$]+)\b"),
        Form("method", r"(?<![\w$#.])(?P<name>[\w$#]++)\s*+=\s*(?:async\s+)?(?:\((?P<params>[^()]*)\)|[\w$]++)\s*+=>\s*(?=\{)", ("type",)),
        Form("method", r"(?<![\w$#])(?P<name>[\w$#]++)\s*+" + PARAMS + r"[^{};()]{0,120}+(?=\{)", ("type",)),
    ],
    "c": [
        Form("struct", word("struct") + r"\s+(?P<name>\w++)\s*+(?=\{)", (), "struct"),
        Form("typedef", word("typedef") + r"\b(?:[^;{}]{0,200}\{[^{}]{0,4000}\})?[^;{}()]{0,200}?\b(?P<name>\w+)\s*;"),
        Form("function", C_TYPE + r"(?P<name>\w++)\s*+" + PARAMS + r"\s*+(?=[{;])", ("top",)),
        Form("variable", C_TYPE + r"(?P<name>\w++)\s*+(?:\[[^\]]*+\]\s*+)*+(?=[=;])", ("top", "body")),
    ],
    "cpp": [
        Form("", word("namespace") + r"\s+(?P<name>\w+(?:::\w+)*)\s*(?=\{)", ("top",), "top", True),
        Form("class", word("class", "struct", but="enum ") + r"\s+(?P<name>\w++)[^;{}()]{0,400}+(?=\{)", ("top", "type"), "type", True),
        Form("method", r"(?<![\w:])(?P<name>[A-Za-z_]\w*+::~?\w++)\s*+" + PARAMS + r"[^;{}()]{0,60}+(?=\{)", ("top",)),
        Form("function", C_TYPE + r"(?P<name>\w++)\s*+" + PARAMS + r"[^;{}()]{0,60}+(?=[{;])", ("top",)),
        Form("method", r"(?<![\w~])(?P<name>~?\w++)\s*+" + PARAMS + r"[^;{}()]{0,60}(?=[{;:])", ("type",)),
        Form("variable", C_TYPE + r"(?P<name>\w++)\s*+(?:\[[^\]]*+\]\s*+)*+(?=[=;{])", ("top", "body")),
    ],
    "rust": [
        Form("module", word("mod") + r"\s+(?P<name>\w+)", (), "top", True),
        Form("struct", word("struct") + r"\s+(?P<name>\w+)[^;{}()]*", (), "struct", True),
        Form("enum", word("enum") + r"\s+(?P<name>\w+)[^;{}]*", (), "enum", True),
        Form("trait", word("trait") + r"\s+(?P<name>\w+)[^;{}]*", (), "type", True),
        Form("", word("impl") + r"\b(?:\s*<[^{}]{0,200}?>)?\s+(?:[^{}]{0,200}?\bfor\s+)?(?P<name>[\w:]+(?:<[^{}]{0,200}?>)?)\s*(?:where[^{}]{0,400})?(?=\{)", (), "type", True),
        Form("function", word("fn") + r"\s+(?P<name>\w+)\s*(?:<[^{}()]{0,300}>\s*)?" + PARAMS + r"[^{};]{0,400}"),
        Form("type_alias", word("type") + r"\s+(?P<name>\w+)[^;={}]*="),
        Form("constant", word("const") + r"\s+(?P<name>[A-Za-z_]\w*)\s*:\s*" + RUST_TYPE),
        Form("static", word("static") + r"\s+(?:mut\s+)?(?P<name>\w+)\s*:\s*" + RUST_TYPE),
        Form("field", r"\b(?P<name>[a-z_]\w*+)\s*+:(?!:)\s*" + RUST_TYPE, ("struct",)),
        Form("enum_variant", r"\b(?P<name>[A-Z]\w*+)\s*+(?=[,({=}])", ("enum",)),
    ],
}
#: What is called, by language: pattern and kind; the first group is the name.
CALLS = {
    "java": [(word("import") + r"\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "import"), (word("extends", "implements") + r"\s+([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*)", "base"), (r"\b([A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+)\s*+\(", "call")],
    "js": [("(?:" + word("from", "import") + r"\s+|" + word("require") + r"\(\s*)(['\"][^'\"\n]*['\"])", "import"), (word("extends") + r"\s+([A-Za-z_$][\w$.]*)", "base"), (r"(?<![\w$])([A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+)\s*+\(", "call")],
    "c": [(r"#\s*include\s*([<\"][^>\"\n]+[>\"])", "import"), (r"\b([A-Za-z_]\w*+)\s*+\(", "call")],
    "cpp": [(r"#\s*include\s*([<\"][^>\"\n]+[>\"])", "import"), (r"(?:[:,]\s*(?:virtual\s+)?(?:public|protected|private)\s+)([A-Za-z_][\w:]*)", "base"), (r"(?<![\w:])((?:[A-Za-z_]\w*+::)*+[A-Za-z_]\w*+)\s*+\(", "call")],
    "rust": [("(" + word("use") + r"\s+[^;{}]{0,400}(?:\{[^;]{0,4000}\})?\s*;)", "import"), (word("impl") + r"\b(?:\s*<[^{}]{0,200}?>)?\s+([\w:]+(?:<[^{}]{0,200}?>)?)\s+for\b", "base"), (r"(?<!\w)((?:[A-Za-z_]\w*+(?:::|\.))*+[A-Za-z_]\w*+)\s*+\(", "call"), (r"\b([A-Za-z_]\w*+!)\s*+[(\[{]", "call")],
}
#: Words of each language that are neither types nor names nor called, unless a dot stands before them.
RESERVED = {
    "java": set("if for while switch catch return super new else do throw case goto import package assert synchronized try yield instanceof".split()),
    "js": set("if for while switch catch return function super new else do typeof throw case import async await yield in of let var delete".split()),
    "c": set("if for while switch return sizeof else do case goto typedef defined".split()),
    "cpp": set("if for while switch catch return sizeof new else do throw case goto using namespace typedef delete defined try".split()),
    "rust": set("if for while match return fn else in loop impl pub move as where let mut async await use super".split()),
}
#: Words that no method of JavaScript can be told from by its form.
STATEMENTS = set("if for while switch catch function return".split())
#: Words before a Java name that are no type, and C types that are no reference.
MODIFIERS = set("public protected private static final abstract synchronized native default transient volatile".split())
BUILTIN = set("int float double char bool void long short unsigned signed size_t auto".split())
NOISE = {
    "c": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.[^'\n]{0,8}|[^'\\\n])'",
    "js": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
}
JOIN = {"js": "."}
#: Kinds that have a type.
TYPED = {"variable", "field", "constant", "static"}
#: Callees that request an address, and the verbs they know.
REQUESTS, VERBS = {"fetch", "axios", "$http", "request", "superagent"}, {"get", "post", "put", "patch", "delete", "head", "options"}
COMPILED = {lang: [(f, re.compile(f.pattern)) for f in forms] for lang, forms in FORMS.items()}
CALLED = {lang: [(re.compile(p), kind) for p, kind in calls] for lang, calls in CALLS.items()}
QUIET = {k: re.compile(p, re.S) for k, p in NOISE.items()}
NO_BRACES = str.maketrans("{};", "   ")
#: What the reader asks of every declaration: the first word of a type, braces, and what cuts names and parameters.
FIRST, COMMA = re.compile(r"[^\s*&<:]*"), re.compile(r"\s*,\s*")
#: Only variants of Rust's enums ask how deep in parentheses they stand.
BRACES = {lang: re.compile(r"[{}();]" if lang == "rust" else "[{};]") for lang in FORMS}
BETWEEN, ANNOTATED, JS_NAME = re.compile(r",(?![^<({\[]*[>)}\]])"), re.compile(r"@\w+(?:\s*\([^()]*\))?"), re.compile(r"(?:\.\.\.)?([A-Za-z_$][\w$]*)")
TYPED_NAME, QUALIFIERS = re.compile(r"(.+?[\s*&])(\w+)\s*(?:\[[^\]]*\])?(?:\s*=.*)?$"), re.compile(r"\b(?:final|const)\s+")
PLAIN, PLACE = re.compile(r"\b(?:const|static|struct|class|extern|unsigned|signed)\b|[*&]"), itemgetter(0, 1)
BLANK, STRING = re.compile(r"\s*"), re.compile(r"\s*(?:'([^'\n]*)'|\"([^\"\n]*)\"|`([^`]*)`)")
ANNOTATION = re.compile(r"@\w+\s*\((?:[^()]|\([^()]*\))*\)")
SPRING = re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(((?:[^()\"]|\"[^\"]*\"|\([^()]*\))*)\)")
ATTRIBUTE = re.compile(r"#\[(get|post|put|patch|delete|head|options|route)\s*\(\s*\"([^\"]+)\"([^\]]*)\]", re.I)


#: What can hide a comment in Rust, and the ends of comments, which nest there.
RUST_QUIET, NESTED = re.compile(r"//[^\n]*|/\*|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^'\n]{0,8}|[^'\\\n])'", re.S), re.compile(r"/\*|\*/")
#: Macros, with the lines that they go on over.
DEFINE = re.compile(r"^[ \t]*#[ \t]*define\b(?:[^\n\\]|\\.)*", re.M | re.S)


def _blank(text: str) -> str:
    return "\n".join([" " * len(line) for line in text.split("\n")])


def masked(code: str, lang: str) -> str:
    """The code at equal length, without comments and the inside of strings (and without braces in Java's annotations)."""

    def hide(m: re.Match) -> str:
        text = m.group()
        return text[0] + _blank(text[1:-1]) + text[-1] if text[0] in "\"'`" and len(text) > 1 else _blank(text)

    if lang == "rust":
        out, at = [], 0
        while m := RUST_QUIET.search(code, at):
            end, depth = m.end(), m.group() == "/*"
            while depth:
                n = NESTED.search(code, end)
                end, depth = (n.end(), depth + (1 if n.group() == "/*" else -1)) if n else (len(code), 0)
            out += [code[at : m.start()], hide(m) if m.group() != "/*" else _blank(code[m.start() : end])]
            at = end
        return "".join(out) + code[at:]
    out = QUIET["js" if lang == "js" else "c"].sub(hide, code)
    if lang in ("c", "cpp") and "define" in out:
        out = DEFINE.sub(lambda m: _blank(m.group()), out)
    return ANNOTATION.sub(lambda m: m.group().translate(NO_BRACES), out) if lang == "java" else out


def spring(head: str) -> tuple[str | None, list[str]]:
    """Path and verbs of a Java request mapping in the text before a declaration."""
    for name, given in SPRING.findall(head):
        path = re.search(r'^\s*\{?\s*"([^"]*)"|\b(?:value|path)\s*=\s*\{?\s*"([^"]*)"', given)
        if path:
            return path.group(1) or path.group(2) or "", (re.findall(r"RequestMethod\.(\w+)", given) or ["GET"]) if name == "Request" else [name.upper()]
    return None, []


def attribute(head: str) -> tuple[str | None, list[str]]:
    """Path and verbs of a Rust route attribute."""
    found = ATTRIBUTE.search(head)
    if not found:
        return None, []
    verb, path, rest = found.groups()
    named = re.search(r'method\s*=\s*"([^"]+)"', rest)
    return path, [verb.upper() if verb.lower() != "route" else named.group(1).upper() if named else "GET"]


def parameters(text: str, lang: str) -> Iterator[tuple[str, str]]:
    """(name, type) of each parameter."""
    for part in BETWEEN.split(ANNOTATED.sub("", text) if "@" in text else text):
        part = " ".join(part.split())
        if lang == "rust":
            name, colon, dtype = part.partition(":")
            if colon and name.strip() != "self":
                yield name.strip(), dtype.strip()
        elif lang == "js":
            name = JS_NAME.match(part)
            if name and "=" not in part:
                yield name.group(1), "unknown"
        else:
            found = TYPED_NAME.match(part)
            if found:
                yield found.group(2), QUALIFIERS.sub("", found.group(1)).strip() if lang == "java" else found.group(1).strip()


class Scope(NamedTuple):
    kind: str
    name: str | None
    base: str | None = None


class _Reader:
    """One file's entities."""

    def __init__(self, code: str, lang: str) -> None:
        self.code, self.lang, self.text = code, lang, masked(code, lang)
        package = re.search(r"^\s*package\s+([\w.]+)\s*;", self.text, re.M) if lang == "java" else None
        self.prefix = package.group(1) + "." if package else ""
        self.scopes, self.rows, self.names = [Scope("top", None)], [], set()

    def qualified(self, name: str) -> str:
        return JOIN.get(self.lang, "::").join([*[s.name for s in self.scopes if s.name], name])

    def declare(self, name: str, kind: str, dtype: str | None = None, endpoint: str | None = None, verb: str | None = None) -> None:
        self.rows.append(("declared", name, kind, dtype, endpoint, verb))

    def call(self, name: str, kind: str) -> None:
        self.rows.append(("called", name, kind, None, None, None))

    def declared(self, form: Form, m: re.Match, head: str) -> Scope | None:
        """Reports the declaration, if it is one, and returns the scope that its braces open."""
        name, groups = m.group("name"), m.re.groupindex
        dtype = " ".join(m.group("type").split()) if "type" in groups else ""
        first = FIRST.match(dtype).group() if dtype else ""
        kind, base, endpoint, verbs = form.kind, None, None, []
        reserved = RESERVED[self.lang]
        if name in (STATEMENTS if self.lang == "js" and kind == "method" else reserved) or first in reserved and self.lang != "rust" or (self.lang == "java" and kind in ("method", "variable") and dtype in MODIFIERS):
            return None
        if self.lang == "cpp" and kind == "variable" and (first in ("public", "private", "protected", "virtual") or first == "enum" and self.text.startswith("{", BLANK.match(self.text, m.end()).end())):
            return None
        if kind == "constructor" and name != (self.scopes[-1].name or "").rpartition(".")[2]:
            return None
        if self.lang == "java":
            endpoint, verbs = spring(head)
            if kind in ("class", "interface", "enum"):
                name, base, endpoint = self.prefix + name, endpoint, None
        elif self.lang == "rust" and kind == "function":
            endpoint, verbs = attribute(head)
            kind = "method" if any(s.name for s in self.scopes) else "function"
        full = self.qualified(name)
        if kind == "field":
            full = f"{self.qualified('')[:-2]}.{name}"
        if endpoint is not None and kind in ("method", "function"):
            above = next((s.base for s in reversed(self.scopes) if s.base), None)
            whole = endpoint if not above else above.rstrip("/") + ("/" + endpoint.lstrip("/") if endpoint.lstrip("/") else "")
            for verb in verbs:
                self.declare(full, "api_endpoint", None, whole, verb)
        elif kind:
            for one in COMMA.split(full) if self.lang == "java" and kind == "variable" else [full]:
                self.declare(one if one == full or "::" in one else self.qualified(one), kind, (dtype or "unknown") if kind in TYPED else None)
        if self.lang in ("c", "cpp") and kind == "variable":
            plain = "" if dtype in BUILTIN else PLAIN.sub(" ", dtype).strip()
            if plain and plain not in BUILTIN:
                self.call(plain, "type")
        if "params" in groups and m.group("params"):
            a, b = m.span("params")
            for p, t in parameters(self.code[a:b], self.lang):
                self.declare(f"{full}.{p}", "variable", t)
        return Scope(form.opens, name if form.named else None, base)

    def read(self) -> list[tuple]:
        events = [(m.start(), 0, m.group(), m, None) for m in BRACES[self.lang].finditer(self.text)]
        for order, (form, pattern) in enumerate(COMPILED[self.lang], 1):
            events += [(m.start("name"), order, "", m, form) for m in pattern.finditer(self.text)]
        for pattern, kind in CALLED[self.lang]:
            events += [(m.start(1), 99, kind, m, None) for m in pattern.finditer(self.text)]
        events.sort(key=PLACE)
        depth, depths, last, waiting = 0, [], 0, {}
        for at, _, what, m, form in events:
            if form:
                if at in self.names or form.inside and self.scopes[-1].kind not in form.inside or form.kind == "enum_variant" and depth:
                    continue
                opened = self.declared(form, m, self.code[last : m.start()])
                if opened:
                    self.names.add(at)
                    end = BLANK.match(self.text, m.end()).end()
                    waiting.setdefault(end, opened)
            elif what == "{":
                self.scopes.append(waiting.pop(at, Scope("enum_body" if self.scopes[-1].kind == "enum" else "body", None)))
                depths.append(depth)
                depth, last = 0, at + 1
            elif what == "}":
                if len(self.scopes) > 1:
                    self.scopes.pop()
                    depth = depths.pop()
                last = at + 1
            elif what in "();":
                depth = max(0, depth + (what == "(") - (what == ")"))
                last = at + 1 if what == ";" else last
            elif at not in self.names:
                self.called(what, m)
        return self.rows

    def called(self, kind: str, m: re.Match) -> None:
        a, b = m.span(1)
        name = self.code[a:b]
        if kind == "import":
            return self.call(name if self.lang == "rust" else name.strip("<>\"'"), kind)
        if kind == "base":
            for one in COMMA.split(name):
                self.call(one, kind)
            return None
        last = name.rpartition(".")[2]
        before = self.text[max(0, a - 2) : a]
        if before.endswith(("@", "~", "#[")) or name.split(".")[0] in RESERVED[self.lang] and not before.endswith("."):
            return None
        if self.lang in ("java", "rust", "js") and before.endswith("."):
            name = last
        self.call(name.rpartition("::")[2] if self.lang == "cpp" else name, kind)
        owner, verb = name.split(".")[0], last.lower()
        if self.lang == "js" and owner in REQUESTS and (owner == name or verb in VERBS or owner == "fetch"):
            address = STRING.match(self.code, m.end())
            if address and any(address.groups()):
                where = re.sub(r"\$\{[^}]*\}", "{param}", next(g for g in address.groups() if g))
                self.call(f"API:{verb.upper() if verb in VERBS and owner != name else 'GET'}:{where}", "api")
        return None


#: Files whose entities are handed on together.
TOGETHER = 500


def _handed_on(files: pa.RecordBatch, read: Callable[[str, str], list[tuple]]) -> pa.RecordBatch:
    """The entities of a few files as columns."""
    found = [list(dict.fromkeys(read(code, lang))) if code else [] for lang, code in zip(files.column("lang").to_pylist(), files.column("content").to_pylist(), strict=True)]
    counts = np.array([len(rows) for rows in found], np.int64)
    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    role, *others = [list(c) for c in zip(*chain.from_iterable(found))] or [[]] * 6
    path = files.column("path").take(pa.array(np.repeat(np.arange(len(found)), counts)))
    return pa.RecordBatch.from_arrays([path, pa.array(role, pa.string()), pa.array(pos, pa.int32()), *[pa.array(c, pa.string()) for c in others]], [c.split()[0] for c in ENTITY.split(", ")])


WORD = re.compile(r"[\w$]+", re.ASCII)
#: An entity in the list of its file: with its simple name, and the last word of that.
LISTED = "struct<role: string, pos: int, name: string, type: string, base: string, word: string>"


def _word(name: str) -> tuple[str, str | None]:
    """A name's simple name and the last word of that."""
    base = name.rpartition("::")[2] if "::" in name else name.rpartition(".")[2]
    return base, (WORD.findall(base) or [None])[-1]


def _listed(files: pa.RecordBatch, read: Callable[[str, str], list[tuple]], once: bool) -> pa.RecordBatch:
    """A few files with their entities that have a word, as lists."""
    rows, ends = [], [0]
    for code, lang in zip(files.column("code").to_pylist(), files.column("lang").to_pylist(), strict=True):
        found = list(dict.fromkeys(read(code, lang))) if code else []
        if once:
            found = list(dict.fromkeys(f[:3] for f in found))
        rows.extend((f[0], pos, f[1], f[2], base, word) for pos, f in enumerate(found) for base, word in (_word(f[1]),) if word is not None)
        ends.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["role", "pos", "name", "type", "base", "word"])
    return pa.RecordBatch.from_arrays([files.column("path"), files.column("content"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["path", "content", "entities"])


def list_files(files: DataFrame, read: Callable[[str, str], list[tuple]], once: bool = False) -> DataFrame:
    """files(path, lang, code, content) as (path, content, entities), a row for each file, with its entities by read(code, lang) as in read_files; with once each (role, name, type) counts once."""
    return files.select("path", "lang", "code", "content").mapInArrow(lambda batches: (_listed(b.slice(k, TOGETHER), read, once) for b in batches for k in range(0, b.num_rows, TOGETHER)), f"path string, content string, entities array<{LISTED}>")


def read_files(files: DataFrame, read: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Entities of files(path, lang, content) as read(content, lang) tells them, each once by (role, name, type, dtype, endpoint, method), in order of place; no text has none."""
    return files.select("path", "lang", "content").mapInArrow(lambda batches: (_handed_on(b.slice(k, TOGETHER), read) for b in batches for k in range(0, b.num_rows, TOGETHER)), ENTITY)
