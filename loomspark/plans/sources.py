"""The relational tables as source trees: every row becomes a file, written from a template.

In a template {k} is the row's key, {n} the next key and {g} the row's group (size, nation, day of
the month, ...). What the file declares and calls is known from the template, so SQL can state the
entities, chunks and edges that the build path must find.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import build, extract
from loomspark.plans.adapters import Tables
from loomspark.sources.scratch import stored


class Template(NamedTuple):
    table: str
    key: str
    group: str
    path: str
    code: str
    #: (role, name, type, dtype, endpoint, method) of each entity.
    found: list[tuple]


def _declared(*rows: tuple) -> list[tuple]:
    return [("declared", name, kind, dtype, endpoint, method) for name, kind, dtype, endpoint, method in ((*r, None, None, None)[:5] for r in rows)]


def _called(kind: str | None, *names: str) -> list[tuple]:
    return [("called", n, kind, None, None, None) for n in names]


PYTHON = Template(
    "part", "p_partkey", "p_size", "shop/size{g}/part_{k}.py",
    '''import shop.base
from shop.db import load
from shop.other import show_{n}


class Part_{k}(Base):
    def price(self, n: int):
        self.total = load(n)
        return self.cost({g})


app = Flask(name)


@app.route("/parts/p{k}/{g}", methods=["GET", "POST"])
def show_{k}(item: str):
    # ghost_{k}()
    return render(item)
''',
    _declared(("Part_{k}", "class"), ("Part_{k}.price", "method"), ("Part_{k}.price.n", "variable", "int"), ("Part_{k}.total", "variable", "load"), ("app", "variable", "Flask"), ("show_{k}", "function"), ("show_{k}", "api_endpoint", None, "/parts/p{k}/{g}", "GET"), ("show_{k}", "api_endpoint", None, "/parts/p{k}/{g}", "POST"), ("item", "variable", "str"))
    + _called(None, "shop.base", "shop.db", "shop.db.load", "shop.other", "shop.other.show_{n}", "Base", "load", "Part_{k}.cost", "Flask", "Flask.route", "render"),
)
JAVA = Template(
    "supplier", "s_suppkey", "s_nationkey", "src/n{g}/Supplier{k}.java",
    '''package com.n{g};
import java.util.List;

@RequestMapping("/suppliers")
public class Supplier{k} extends Party implements Named {
    private int rank = {g};
    // int ghost = 1;
    public Supplier{k}(int id) { check(id, "}"); }

    @GetMapping("/{k}")
    public List<String> find(@PathVariable("id") Long id) { return store.load(id); }

    void reset(final String a) { new Task{k}(a); }
}
''',
    _declared(("com.n{g}.Supplier{k}", "class"), ("com.n{g}.Supplier{k}::rank", "variable", "int"), ("com.n{g}.Supplier{k}::Supplier{k}", "constructor"), ("com.n{g}.Supplier{k}::Supplier{k}.id", "variable", "int"), ("com.n{g}.Supplier{k}::find", "api_endpoint", None, "/suppliers/{k}", "GET"), ("com.n{g}.Supplier{k}::find.id", "variable", "Long"), ("com.n{g}.Supplier{k}::reset", "method"), ("com.n{g}.Supplier{k}::reset.a", "variable", "String"))
    + _called("import", "java.util.List") + _called("base", "Party", "Named") + _called("call", "check", "store.load", "Task{k}"),
)
JAVASCRIPT = Template(
    "customer", "c_custkey", "c_nationkey", "web/n{g}/customer_{k}.ts",
    '''import api from 'lib/{g}';
class Customer{k} extends Party {
  open(id) { this.show(id); let shown = 1; }
}
function save{k}(row) { axios.post(`/customers/${row.id}/n{g}`, row); }
const load{k} = async (key) => { fetch('/parts/p{k}/{g}'); };
/* function ghost() {} */
var count = 0;
''',
    _declared(("Customer{k}", "class"), ("Customer{k}.open", "method"), ("Customer{k}.open.id", "variable", "unknown"), ("Customer{k}.shown", "variable", "unknown"), ("save{k}", "function"), ("save{k}.row", "variable", "unknown"), ("load{k}", "function"), ("count", "variable", "unknown"))
    + _called("import", "lib/{g}") + _called("base", "Party") + _called("call", "this.show", "axios.post", "fetch") + _called("api", "API:POST:/customers/{param}/n{g}", "API:GET:/parts/p{k}/{g}"),
)
CLANG = Template(
    "orders", "o_orderkey", "o_custkey", "src/c{g}/order_{k}.c",
    '''#include <stdio.h>
#include "order.h"
struct Order{k} { int id; };
typedef struct Order{k} Alias{k};
struct Order{k} first;
int total_{k}(int a, const char *b) {
  int sum = {g};
  puts("total(");
  return add(a, sum); // ghost();
}
''',
    _declared(("Order{k}", "struct"), ("Alias{k}", "typedef"), ("first", "variable", "struct Order{k}"), ("total_{k}", "function"), ("total_{k}.a", "variable", "int"), ("total_{k}.b", "variable", "const char *"), ("sum", "variable", "int"))
    + _called("import", "stdio.h", "order.h") + _called("type", "Order{k}") + _called("call", "puts", "add"),
)
CPLUSPLUS = Template(
    "orders", "o_orderkey", "o_custkey", "src/c{g}/order_{k}.cpp",
    '''#include "order.h"
namespace shop {
class Order{k} : public Base {
 public:
  Order{k}(int id);
  ~Order{k}() {}
  int sum(int a) const { return plus(a, {g}); }
};
int twice{k}(int v) { return v * 2; }
}
void Order{k}::run() { start(); shop::Order{k} other = make(); }
''',
    _declared(("shop::Order{k}", "class"), ("shop::Order{k}::Order{k}", "method"), ("shop::Order{k}::Order{k}.id", "variable", "int"), ("shop::Order{k}::~Order{k}", "method"), ("shop::Order{k}::sum", "method"), ("shop::Order{k}::sum.a", "variable", "int"), ("shop::twice{k}", "function"), ("shop::twice{k}.v", "variable", "int"), ("Order{k}::run", "method"), ("other", "variable", "shop::Order{k}"))
    + _called("import", "order.h") + _called("base", "Base") + _called("call", "plus", "start", "make") + _called("type", "shop::Order{k}"),
)
RUST = Template(
    "customer", "c_custkey", "c_nationkey", "src/n{g}/customer_{k}.rs",
    '''use std::collections::HashMap;
pub struct Customer{k} { pub id: u32, names: HashMap<String, Vec<u8>> }
enum State{k} { Open, Closed(u8), Moved { to: i32 } }
trait Party { fn name(&self) -> String; }
impl Party for Customer{k} { fn name(&self) -> String { log!("x {}", 1); show(self.id) } }
const NATION: i32 = {g};
#[post("/customers/{k}")]
async fn save_{k}(body: Json<u32>) -> String { keep(body) }
mod inner { pub fn deep() {} }
''',
    _declared(("Customer{k}", "struct"), ("Customer{k}.id", "field", "u32"), ("Customer{k}.names", "field", "HashMap<String, Vec<u8>>"), ("State{k}", "enum"), ("State{k}::Open", "enum_variant"), ("State{k}::Closed", "enum_variant"), ("State{k}::Moved", "enum_variant"), ("Party", "trait"), ("Party::name", "method"), ("Customer{k}::name", "method"), ("NATION", "constant", "i32"), ("save_{k}", "api_endpoint", None, "/customers/{k}", "POST"), ("save_{k}.body", "variable", "Json<u32>"), ("inner", "module"), ("inner::deep", "method"))
    + _called("import", "use std::collections::HashMap;") + _called("base", "Party") + _called("call", "log!", "show", "keep"),
)
TEMPLATES = {"python": PYTHON, "java": JAVA, "javascript": JAVASCRIPT, "c": CLANG, "cpp": CPLUSPLUS, "rust": RUST}


# --- other forms: what a file looks like follows its key -----------------------------------------

JAVA_STORE = JAVA._replace(
    path="src/n{g}/Store{k}.java",
    code='''package com.n{g};

public interface Store{k} extends Shelf { void match(int id); }

@RestController
class Delete{k} {
    @DeleteMapping("/s{k}")
    public void delete(int id) { repo.delete(id); name.match(other{k}); }
}
enum Level{k} { LOW, HIGH }
''',
    found=_declared(("com.n{g}.Store{k}", "interface"), ("com.n{g}.Store{k}::match", "method"), ("com.n{g}.Store{k}::match.id", "variable", "int"), ("com.n{g}.Delete{k}", "class"), ("com.n{g}.Delete{k}::delete", "api_endpoint", None, "/s{k}", "DELETE"), ("com.n{g}.Delete{k}::delete.id", "variable", "int"), ("com.n{g}.Level{k}", "enum"))
    + _called("base", "Shelf") + _called("call", "repo.delete", "name.match"),
)
JAVASCRIPT_CALLS = JAVASCRIPT._replace(
    path="web/n{g}/calls_{k}.js",
    code='''const tools = require('tools{g}');
export default function main{k}(a) { api.delete(`/parts/p{k}`); p.catch(fail); }
export class View{k} {
  static async load(key) { return fetch('/views/{k}'); }
}
/* function ghost{k}() {} // */
const text = "function ghost() {}";
''',
    found=_declared(("tools", "variable", "unknown"), ("main{k}", "function"), ("main{k}.a", "variable", "unknown"), ("View{k}", "class"), ("View{k}.load", "method"), ("View{k}.load.key", "variable", "unknown"), ("text", "variable", "unknown"))
    + _called("import", "tools{g}") + _called("call", "require", "api.delete", "p.catch", "fetch") + _called("api", "API:GET:/views/{k}"),
)
CPLUSPLUS_NESTED = CPLUSPLUS._replace(
    path="src/c{g}/nested_{k}.cpp",
    code='''#include <vector>
namespace shop {
namespace inner {
enum class Color{k} { RED, BLUE };
struct Point{k} { int x; };
}
template <typename T> T largest{k}(T a, T b) { return pick(a, b); }
}
''',
    found=_declared(("shop::inner::Point{k}", "class"), ("shop::largest{k}", "function"), ("shop::largest{k}.a", "variable", "T"), ("shop::largest{k}.b", "variable", "T"))
    + _called("import", "vector") + _called("call", "pick"),
)
RUST_NEW = RUST._replace(
    path="src/n{g}/new_{k}.rs",
    code='''use crate::base::Base;
pub struct P{k} { id: u64 }
impl P{k} {
    pub fn new(id: u64) -> Self { /* a /* b */ fn ghost() {} */ make(id) }
    fn get(&self) -> u64 { self.id }
}
static LIMIT: u32 = {g};
fn drop_{k}(p: P{k}) { p.delete(); Base::open(p) }
''',
    found=_declared(("P{k}", "struct"), ("P{k}.id", "field", "u64"), ("P{k}::new", "method"), ("P{k}::new.id", "variable", "u64"), ("P{k}::get", "method"), ("LIMIT", "static", "u32"), ("drop_{k}", "function"), ("drop_{k}.p", "variable", "P{k}"))
    + _called("import", "use crate::base::Base;") + _called("call", "make", "p.delete", "Base::open"),
)
#: The forms of each language; a row's key says which one its file has.
FORMS = {"java": [JAVA, JAVA_STORE], "javascript": [JAVASCRIPT, JAVASCRIPT_CALLS], "cpp": [CPLUSPLUS, CPLUSPLUS_NESTED], "rust": [RUST, RUST_NEW]}


def _filled(template: str, t: Template) -> Column:
    out = F.lit(template)
    for mark, value in (("{k}", F.col(t.key)), ("{n}", F.col(t.key) + 1), ("{g}", F.col(t.group))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


#: Files that one task writes and reads; a table of few bytes can hold very many rows.
FILES_PER_TASK = 5000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over as many tasks as their files take, by keys if there are any."""
    return rows.repartition(max(1, -(-rows.count() // FILES_PER_TASK)), *keys)


def files(tables: Tables, t: Template, once: bool = False) -> DataFrame:
    """files(path, content) of a template's table; with once each file is one row, however many rows of the table write it."""
    rows = getattr(tables, t.table).select(t.key, t.group)
    rows = spread(rows, t.key, t.group).distinct() if once else spread(rows)
    return rows.select(_filled(t.path, t).alias("path"), _filled(t.code, t).alias("content"))


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _filled_sql(column: str, t: Template) -> str:
    return f"replace(replace(replace({column}, '{{k}}', CAST({t.key} AS VARCHAR)), '{{n}}', CAST({t.key} + 1 AS VARCHAR)), '{{g}}', CAST({t.group} AS VARCHAR))"


def files_sql(t: Template) -> str:
    """SQL for the files of a template's table."""
    return f"SELECT {_filled_sql(_text(t.path), t)} AS path, {_filled_sql(_text(t.code), t)} AS content FROM {t.table}"


def entities_sql(t: Template) -> str:
    """SQL for the entities of a template's files, with '' for what is missing."""
    values = ", ".join("(" + ", ".join(_text(x or "") for x in row) + ")" for row in t.found)
    name, endpoint, dtype = (_filled_sql(c, t) for c in ("e.name", "e.endpoint", "e.dtype"))
    return f"SELECT {_filled_sql(_text(t.path), t)} AS path, e.role, {name} AS name, e.type, {dtype} AS dtype, {endpoint} AS endpoint, e.method FROM {t.table}, (VALUES {values}) AS e(role, name, type, dtype, endpoint, method)"


def entities(tables: Tables, t: Template) -> DataFrame:
    found = extract.entities(files(tables, t))
    return found.select("path", "role", "name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("type", "dtype", "endpoint", "method")])


def form_files(tables: Tables, lang: str) -> DataFrame:
    """files(path, content) of all rows of a language's table, each in the form that its key says."""
    forms = FORMS[lang]
    by_key = lambda field: F.element_at(F.array(*[_filled(getattr(f, field), f) for f in forms]), (F.pmod(F.col(forms[0].key), F.lit(len(forms))) + 1).cast("int"))
    return spread(getattr(tables, forms[0].table).select(forms[0].key, forms[0].group)).select(by_key("path").alias("path"), by_key("code").alias("content"))


def form_entities(tables: Tables) -> DataFrame:
    """Entities of the files of all languages with several forms, read together."""
    found = extract.entities(reduce(DataFrame.unionByName, [form_files(tables, lang) for lang in FORMS]))
    return found.select("path", "role", "name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("type", "dtype", "endpoint", "method")])


def forms_sql(lang: str) -> str:
    forms = FORMS[lang]
    return " UNION ALL ".join(f"{entities_sql(f)} WHERE {f.key} % {len(forms)} = {i}" for i, f in enumerate(forms))


# --- the build path over the Python files ------------------------------------------------------

#: Where the entities of PYTHON show: (role, name, type, chunks of its file).
PLACES = [
    ("declared", "Part_{k}", "class", [1]), ("declared", "Part_{k}.price", "method", [1]), ("declared", "Part_{k}.price.n", "variable", [1]), ("declared", "Part_{k}.total", "variable", [1]),
    ("declared", "app", "variable", [2, 3]), ("declared", "show_{k}", "function", [3]), ("declared", "show_{k}", "api_endpoint", [3]), ("declared", "item", "variable", [3]),
    ("called", "shop.base", "", [0]), ("called", "shop.db", "", [0]), ("called", "shop.db.load", "", [0, 1]), ("called", "shop.other", "", [0]), ("called", "shop.other.show_{n}", "", [0]),
    ("called", "Base", "", [1]), ("called", "load", "", [0, 1]), ("called", "Part_{k}.cost", "", [1]), ("called", "Flask", "", [2]), ("called", "Flask.route", "", [3]), ("called", "render", "", [3]),
]
PLACES_SQL = f"""places AS (SELECT {_filled_sql(_text(PYTHON.path), PYTHON)} AS path, {PYTHON.key} AS k, e.role, {_filled_sql("e.name", PYTHON)} AS name, e.type, e.ord
  FROM part, (VALUES {", ".join(f"({_text(r)}, {_text(n)}, {_text(k)}, {o})" for r, n, k, at in PLACES for o in at)}) AS e(role, name, type, ord))"""


def cut_at(mark: str, lang: str) -> Callable[[DataFrame], DataFrame]:
    """A cut into chunks of a language at every place of a pattern."""
    return extract.cut_by(lambda path, content: F.transform(F.split(content, mark), lambda x, i: F.struct(i.alias("ord"), F.concat_ws("_", path, i.cast("string")).alias("chunk_id"), F.lit(lang).alias("language"), x.alias("content"))))


#: The cut between two blank lines.
chunked = cut_at("\n\n\n", "python")


def mapped(tables: Tables, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files and chunks of the Python tree, and which entities show in which chunks."""
    sources = files(tables, PYTHON, True)
    return sources, chunked(sources), extract.located(sources, chunked, once)


def graph(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the Python tree."""
    sources, pieces, found = mapped(tables)
    found = stored(found, "found")  # read once, and of a known size
    # A number for every place in order of the files' keys: files, chunks and entities of a file are few.
    number = F.regexp_extract("path", r"part_(\d+)\.py$", 1).cast("long")
    decl = found.filter("role = 'declared'").select(((number * 16 + F.col("ord")) * 1000 + F.col("pos")).alias("occ"), (number * 16 + F.col("ord")).alias("chunk_seq"), "name", "path", "chunk_id", "type")
    registered = build.register(decl)
    resolved = build.resolved_calls(found.filter("role = 'called'").select("chunk_id", F.col("name").alias("called")), registered.select(F.col("entity").alias("name"), "path", F.col("occ").alias("seq")))
    return build.build_graph(sources, pieces, registered, resolved)


GRAPH_SQL = f"""WITH {PLACES_SQL}, d AS (SELECT DISTINCT path || '_' || ord AS chunk_id, name AS entity FROM places WHERE role = 'declared'),
c AS (SELECT DISTINCT path || '_' || ord AS chunk_id, CASE WHEN starts_with(name, 'shop.other.show_') AND k + 1 IN (SELECT {PYTHON.key} FROM part) THEN 'show_' || (k + 1) ELSE name END AS entity FROM places WHERE role = 'called'),
f AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM places), ch AS (SELECT path, path || '_' || unnest(range(4)) AS chunk_id FROM f)"""


# --- where the entities of other languages show --------------------------------------------------

WORD_SQL, CALL_SQL = (f"regexp_matches(code, '\\b\\Q' || base || '\\E{end}')" for end in ("\\b", "\\s*\\("))
#: When an entity shows in a chunk, told in SQL.
SHOWS_SQL = {
    "java": f"CASE WHEN role = 'called' OR type IN ('class', 'variable') THEN {WORD_SQL} WHEN type IN ('function', 'method', 'api_endpoint') THEN {CALL_SQL} ELSE false END",
    "cpp": f"""CASE WHEN (role = 'called' OR type IN ('class', 'variable')) AND NOT contains(name, '::') AND {WORD_SQL} THEN true WHEN role = 'called' OR type IN ('function', 'method') THEN {CALL_SQL}
      WHEN type = 'class' THEN regexp_matches(code, '(?m)^\\s*(?:class|struct)\\s+\\Q' || base || '\\E[\\s:{{]') WHEN type = 'variable' THEN {WORD_SQL} ELSE false END""",
}
#: Where their files are cut.
CUTS = {"java": "\n\n", "cpp": "}\n"}


def shown(tables: Tables, lang: str) -> DataFrame:
    """Which chunks of its file an entity of a Java or C++ template shows in."""
    t = TEMPLATES[lang]
    # files are distinct, and so are a file's entities: no row needs to be shuffled to be told from others
    found = extract.located(files(tables, t, True), cut_at(CUTS[lang].replace("}", "\\}"), lang), True)
    return found.select("path", "role", "name", F.coalesce("type", F.lit("")).alias("type"), "ord")


def shown_sql(lang: str) -> str:
    t = TEMPLATES[lang]
    return f"""WITH f AS ({files_sql(t)}), e AS ({entities_sql(t)}), p AS (SELECT path, string_split(content, {_text(CUTS[lang])}) AS parts FROM f),
    k AS (SELECT path, regexp_replace(unnest(parts), '(?s)/\\*.*?\\*/|//[^\n]*', '', 'g') AS code, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS ord FROM p),
    n AS (SELECT DISTINCT path, role, name, type, CASE WHEN contains(name, '::') THEN list_last(string_split(name, '::')) ELSE list_last(string_split(name, '.')) END AS base FROM e)
    SELECT DISTINCT path, role, name, type, ord FROM n JOIN k USING (path) WHERE {SHOWS_SQL[lang]}"""
