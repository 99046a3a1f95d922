"""Queries that build source files and statements from the driver tables: splitters, clauses, names across files.

Suppliers are the statements of their nation's file; each splitter query writes
blocks of several kinds one behind the other, and its SQL knows from the sizes of the
blocks where each statement has to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import loads, names, statements, styles
from tracewell.plans.registry import query
from tracewell.runtime import materialize, read_table

K = "s_suppkey"

#: Per language: blocks by supplier key, as (text, lines, first and last line within the block, squeezed text); `%` stands for the key.
PYTHON = (
    ("@deco\n@other(1)\ndef s%():\n    return  1\n", 4, 1, 4, "@deco @other(1) def s%(): return 1"),
    ("\nx% = [\n 1,\n]\n", 4, 2, 4, "x% = [ 1, ]"),
    ("class C%:\n    '''a  b\n    c'''\n", 3, 1, 3, "class C%: '''a  b\\n    c'''"),
)
SHELL = (
    ("f%() {\n  echo \"}  {\"\n}\n", 3, 1, 3, 'f%() { echo "}  {" }'),
    ("if true; then\n  ls # {\nfi\n", 3, 1, 3, "if true; then ls # { fi"),
    ("cat <<EOF\nhi {\nEOF\n", 3, 1, 3, "cat <<EOF hi { EOF"),
    ("# a note\nls \\\n  -l%\n", 3, 2, 3, "ls \\ -l%"),
)
SCRIPT = (
    ("export function f%(a) {\n  return `}${a}`;\n}\n", 3, 1, 3, "export function f%(a) { return `}${a}`; }"),
    ("const a% = {\n  b: 'c  d',\n}\n", 3, 1, 3, "const a% = { b: 'c  d', }"),
    ("// a note\nrun%()\n  .then(x => /[/}]/)\n", 3, 2, 3, "run%() .then(x => /[/}]/)"),
    ("type T% =\n  | 'x'\n", 2, 1, 2, "type T% = | 'x'"),
)


def _written(template: str) -> Column:
    pieces = [x for p in template.split("%") for x in (F.lit(p), F.col(K).cast("string"))][:-1]
    return F.concat(*pieces)


def _chosen(blocks: tuple, part: int) -> Column:
    out = None
    for i, b in enumerate(blocks):
        value = _written(b[part])
        out = F.when(F.col(K) % len(blocks) == i, value) if out is None else out.when(F.col(K) % len(blocks) == i, value)
    return out


def _files(rows: DataFrame, ext: str, text: Column) -> DataFrame:
    """(path, content): the texts of a nation's suppliers one behind the other."""
    each = rows.select(F.concat(F.lit("n"), "s_nationkey", F.lit(ext)).alias("path"), K, text.alias("t"))
    per = each.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(K, "t"))), lambda x: x["t"]), "").alias("text"))
    return per.select("path", F.col("text").cast("binary").alias("content"))


def _case(blocks: tuple, part: int) -> str:
    said = lambda x: "'" + str(x).replace("'", "''").replace("%", f"' || {K} || '") + "'" if isinstance(x, str) else str(x)
    return f"CASE {K} % {len(blocks)} " + " ".join(f"WHEN {i} THEN {said(b[part])}" for i, b in enumerate(blocks)) + " END"


def _split_sql(blocks: tuple, ext: str) -> str:
    return f"""WITH b AS (SELECT s_nationkey AS n, {K}, {_case(blocks, 1)} AS size, {_case(blocks, 2)} AS f, {_case(blocks, 3)} AS l, {_case(blocks, 4)} AS text FROM supplier),
p AS (SELECT *, sum(size) OVER (PARTITION BY n ORDER BY {K}) - size AS base FROM b)
SELECT 'n' || n || '{ext}' AS file, (base + f)::INTEGER AS first_line, (base + l)::INTEGER AS last_line, text FROM p"""


def _split(spark, d, blocks: tuple, ext: str) -> DataFrame:
    rows = read_table(spark, d, "supplier")
    return statements.split_files(_files(rows, ext, _chosen(blocks, 0)))["statements"].select("file", "first_line", "last_line", "text")


@query(_split_sql(PYTHON, ".py"))
def python_split(spark, d):
    return _split(spark, d, PYTHON, ".py")


@query(_split_sql(SHELL, ".sh"))
def shell_split(spark, d):
    return _split(spark, d, SHELL, ".sh")


@query(_split_sql(SCRIPT, ".ts"))
def script_split(spark, d):
    return _split(spark, d, SCRIPT, ".ts")


# a rule with two names, an at-rule that ends with a semicolon, an at-rule with a block and no class
STYLE = (".a%,\n.b%:is(.c, #d) { x: \"}\" }\n", '@import "x%.css";\n', "/* { */\n@media x {\n  p > q% { }\n}\n")
STYLED = f"""WITH b AS (SELECT s_nationkey AS n, {K} AS k, CASE {K} % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 4 END AS size FROM supplier),
p AS (SELECT *, (sum(size) OVER (PARTITION BY n ORDER BY k) - size)::INTEGER AS base FROM b),
u AS (
  SELECT n, base + 1 AS f, base + 1 AS l, '.a' || k || ' {{ of the rule at ' || (base + 1) || '-' || (base + 2) || ' }}' AS text, '.a' || k AS selector FROM p WHERE k % 3 = 0
  UNION ALL SELECT n, base + 2, base + 2, '.b' || k || ':is(.c, #d) {{ of the rule at ' || (base + 1) || '-' || (base + 2) || ' }}', '.b' || k || ':is(.c, #d)' FROM p WHERE k % 3 = 0
  UNION ALL SELECT n, base + 1, base + 1, '@import "x' || k || '.css";', '@import "x' || k || '.css";' FROM p WHERE k % 3 = 1
  UNION ALL SELECT n, base + 2, base + 4, '@media x {{ p > q' || k || ' {{ }} }}', '@media x' FROM p WHERE k % 3 = 2)"""


def _styled(spark, d) -> dict[str, DataFrame]:
    k = F.col(K) % 3
    text = F.when(k == 0, _written(STYLE[0])).when(k == 1, _written(STYLE[1])).otherwise(_written(STYLE[2]))
    return statements.split_files(_files(read_table(spark, d, "supplier"), ".css", text))


@query(f"{STYLED} SELECT 'n' || n || '.css' AS file, f AS first_line, l AS last_line, text FROM u")
def style_split(spark, d):
    return _styled(spark, d)["statements"].select("file", "first_line", "last_line", "text")


@query(f"{STYLED} SELECT 'n' || n || '.css' AS file, f AS first_line, 1 AS ordinal, selector, f AS line FROM u")
def style_selectors(spark, d):
    found = _styled(spark, d)
    own = found["statements"].select(F.col("id").alias("statement_id"), "file", "first_line")
    return found["selectors"].join(own, "statement_id").select("file", "first_line", "ordinal", "selector", "line")


@query(
    f"""{STYLED}, x AS (SELECT 'n' || n || '.css' AS file, selector FROM u)
SELECT file, count(*) AS rules FROM x WHERE NOT regexp_matches(selector, '[.#]') GROUP BY file"""
)
def unnamed_rules(spark, d):
    found = _styled(spark, d)
    bare = loads.unnamed_rules(found["statements"], found["selectors"])
    return found["statements"].join(bare, "id").groupBy("file").agg(F.count("*").alias("rules"))


@query(
    """SELECT 'n' || n_nationkey || CASE n_nationkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.css' WHEN 2 THEN '.sh' WHEN 3 THEN '.ts' ELSE '.md' END AS file FROM nation WHERE n_nationkey % 6 < 5"""
)
def split_errors(spark, d):
    n = F.col("n_nationkey") % 6
    path = F.concat(F.lit("n"), "n_nationkey", F.when(n == 0, ".py").when(n == 1, ".css").when(n == 2, ".sh").when(n == 3, ".ts").when(n == 4, ".md").otherwise(".py"))
    text = F.when(n == 0, "def f(:\n").when(n == 1, "a { b: 'c }\n").when(n == 2, "cat <<X\n").when(n == 3, "f({)\n").when(n == 4, "x\n").otherwise("x = 1\n")
    rows = read_table(spark, d, "nation").select(path.alias("path"), text.cast("binary").alias("content"))
    return statements.split_files(rows)["errors"].select("file")


# --- statements that are written down directly ---------------------------------------


def _statement(df: DataFrame, base: int, number: Column, file: Column, text: Column) -> DataFrame:
    return df.select((F.lit(base).cast("long") + number).alias("id"), file.alias("file"), text.alias("text"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _said(template: str, *columns: str | Column) -> Column:
    """The template with each `%` replaced by the next column."""
    pieces = template.split("%")
    return F.concat(*[x for p, c in zip(pieces, columns) for x in (F.lit(p), c if isinstance(c, Column) else F.col(c).cast("string"))], F.lit(pieces[-1]))


HUBS = """WITH f AS (SELECT s_suppkey AS k, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT c_custkey AS c, f.* FROM customer JOIN f ON k = 1 + c_custkey % 50)"""


def _hubs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A script per supplier, a barrel per nation that renames, a hub per region with stars, customers that import from hubs or use a barrel as a module."""
    s, n, c = (read_table(spark, d, t) for t in ("supplier", "nation", "customer"))
    f = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    u = c.join(f, F.col(K) == 1 + F.col("c_custkey") % 50)
    num = lambda x: F.col(x).cast("long")
    lib = _all(
        _statement(s, 0, num(K), _said("lib/s%.ts", K), _said("export function f%() { }", K)),
        _statement(s, 10_000_000, num(K), _said("lib/n%.ts", "s_nationkey"), _said('export { f% as g% } from "./s%";', K, K, K)),
        _statement(n, 20_000_000, num("n_nationkey"), _said("lib/r%.ts", "n_regionkey"), _said('export * from "./n%";', "n_nationkey")),
    )
    named = F.col("c_custkey") % 2 == 0
    bind = F.when(named, _said('import { g% } from "../lib/r%";', K, "n_regionkey")).otherwise(_said('import * as m from "../lib/n%";', "n_nationkey"))
    use = F.when(named, _said("g%();", K)).otherwise(_said("m . g%();", K))
    own = _said("app/c%.ts", "c_custkey")
    users = _all(_statement(u, 30_000_000, num("c_custkey"), own, bind), _statement(u, 40_000_000, num("c_custkey"), own, use))
    doors = _statement(n.select("n_regionkey").distinct(), 50_000_000, num("n_regionkey"), _said("app/e%.ts", "n_regionkey"), _said('export * from "../lib/r%";', "n_regionkey"))
    return lib, users, doors


def _uses(rows: DataFrame, entries: DataFrame | None = None, **settings) -> DataFrame:
    """The use links of the statements that are not import clauses."""
    entries = rows.where("false").select("id") if entries is None else entries
    return names.Names(rows).use_links(entries, **settings).select("source", "target")


@query(
    f"""{HUBS} SELECT DISTINCT 40000000 + c AS source, unnest([30000000 + c, k, 10000000 + k, 20000000 + n]) AS target FROM u WHERE c % 2 = 0
UNION SELECT 40000000 + c, unnest([30000000 + c, k, 10000000 + k]) FROM u WHERE c % 2 = 1"""
)
def re_export_uses(spark, d):
    lib, users, _ = _hubs(spark, d)
    return _uses(_all(lib, users)).where("source >= 30000000")


@query(f"{HUBS} SELECT DISTINCT 50000000 + r AS source, unnest([k, 10000000 + k, 20000000 + n]) AS target FROM f")
def published_surface(spark, d):
    lib, _, doors = _hubs(spark, d)
    return _uses(_all(lib, doors), doors.select("id")).where("source >= 50000000")


@query(
    f"""{HUBS} SELECT 'lib/n' || n || '.ts' AS file, 'g' || k AS name FROM f UNION SELECT 'lib/r' || r || '.ts', 'g' || k FROM f UNION SELECT 'lib/s' || k || '.ts', 'f' || k FROM f
UNION SELECT 'app/e' || r || '.ts', 'g' || k FROM f"""
)
def published_names(spark, d):
    lib, _, doors = _hubs(spark, d)
    return names.Names(_all(lib, doors)).published_names()


@query(f"{HUBS} SELECT k AS id, 'f' || k AS name FROM f UNION SELECT 10000000 + k, 'g' || k FROM f UNION SELECT 30000000 + c, CASE WHEN c % 2 = 0 THEN 'g' || k ELSE 'm' END FROM u")
def defined_names_record(spark, d):
    lib, users, _ = _hubs(spark, d)
    return names.Names(_all(lib, users)).defined_names()


@query(
    """WITH c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer)
SELECT 1000000 + c AS source, n AS target FROM c UNION SELECT 2000000 + c, 500 + n FROM c WHERE c % 3 < 2"""
)
def python_uses(spark, d):
    """An import in a body; J11: names of the settings file."""
    n, c = read_table(spark, d, "nation"), read_table(spark, d, "customer")
    i, k = F.col("n_nationkey").cast("long"), F.col("c_custkey").cast("long")
    said = F.when(k % 3 == 0, _said("y = settings.N%", "c_nationkey")).when(k % 3 == 1, _said("z = get('N%')", "c_nationkey")).otherwise(_said("w = N%0 + 1", "c_nationkey"))
    rows = _all(
        _statement(n, 0, i, _said("lib/m%.py", i), _said("def late%(): return 1", i)),
        _statement(n, 500, i, F.lit("conf/settings.py"), _said("N% = 3", i)),
        _statement(c, 1_000_000, k, _said("app/c%.py", k), _said("def run(): from lib.m% import late% as now, none from os import path return now()", "c_nationkey", "c_nationkey")),
        _statement(c, 2_000_000, k, _said("app/c%.py", k), said),
    )
    return _uses(rows, settings="conf/settings.py")


@query(
    """WITH c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer), s AS (SELECT s_suppkey AS k, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier)
SELECT 1000000 + c AS source, unnest([2000000 + c, 3000000 + n]) AS target FROM c UNION SELECT k, b FROM s WHERE b IS NOT NULL"""
)
def shell_and_same_file_uses(spark, d):
    """Functions of sourced scripts; J8: names of the same file."""
    from pyspark.sql import Window

    n, c, s = read_table(spark, d, "nation"), read_table(spark, d, "customer"), read_table(spark, d, "supplier")
    i, k = F.col("n_nationkey").cast("long"), F.col("c_custkey").cast("long")
    after = F.lead(K).over(Window.partitionBy("s_nationkey").orderBy(K))
    rows = _all(
        _statement(c, 1_000_000, k, _said("bin/c%.sh", k), _said("greet% now", "c_nationkey")),
        _statement(c, 2_000_000, k, _said("bin/c%.sh", k), _said('. "./lib%.sh"', "c_nationkey")),
        _statement(n, 3_000_000, i, _said("bin/lib%.sh", i), _said("greet%() { echo hi; }", i)),
        _statement(s, 0, F.col(K).cast("long"), _said("n%.ts", "s_nationkey"), _said("function s%() { return s%(); }", K, F.coalesce(after.cast("string"), F.lit("none")))),
    )
    return _uses(rows)


@query(
    """WITH c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_nationkey % 2 = 0)
SELECT c.c AS id, 'p/q/m' || n || '.py' AS target FROM c UNION ALL SELECT c, 'p/r' || n || '/__init__.py' FROM c UNION ALL SELECT c, 'p/q/__init__.py' FROM c"""
)
def relative_modules(spark, d):
    n, c = read_table(spark, d, "nation").where("n_nationkey % 2 = 0"), read_table(spark, d, "customer")
    files = _all(n.select(_said("p/q/m%.py", "n_nationkey").alias("file")), n.select(_said("p/r%/__init__.py", "n_nationkey").alias("file")), n.select(F.lit("p/q/__init__.py").alias("file"))).distinct()
    own = F.lit("p/q/own.py").alias("file")
    asked = _all(*[c.select(F.col("c_custkey").alias("id"), own, w.alias("written"), "c_nationkey") for w in (_said(".m%", "c_nationkey"), _said("..r%", "c_nationkey"), F.lit("."))])
    hits = loads.resolved(asked, files).where("verdict = 'resolved' and c_nationkey % 2 = 0")
    return hits.select("id", "target")


@query(
    """SELECT s_suppkey AS id, 'app/s' || s_suppkey || '.tsx' AS file FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1"""
)
def demoted_directives(spark, d):
    """a directive as its file's only entry counts only where something imports the file."""
    s = read_table(spark, d, "supplier")
    k = F.col(K).cast("long")
    own = _said("app/s%.tsx", K)
    rows = _all(
        _statement(s, 0, k, own, F.when(k % 3 == 2, "run();").otherwise(" 'use client';")),
        _statement(s, 1_000_000, k, own, F.lit("run();")),
        _statement(s.where(k % 2 == 0), 2_000_000, k, _said("app/i%.ts", K), _said('import "./s%";', K)),
    )
    entries = _all(s.select(k.alias("id")), s.where(k % 3 == 1).select((k + 1_000_000).alias("id")))
    none = spark.createDataFrame([], "statement_id long, ordinal int, selector string, line int")
    return loads.load_graph(rows, entries, none)["demoted"].select("id", "file")


@query("SELECT p_partkey AS id, unnest(['navBar-', 'navBar-x__']) AS beginning, 'joiner' AS way FROM part UNION ALL SELECT p_partkey, unnest(['nav', 'navBar-x__deep']), 'hump' FROM part")
def name_beginnings(spark, d):
    name = F.concat(F.lit("navBar-x__deepEND"), "p_partkey")
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    one = lambda keys, way: rows.select("id", F.explode(keys).alias("beginning"), F.lit(way).alias("way"))
    return one(styles.stems(F.col("name")), "joiner").unionByName(one(styles.humps(F.col("name")), "hump"))


EVIDENCE = """WITH n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), c AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1),
p AS (SELECT n.n, r, coalesce(k, 0) AS k FROM n LEFT JOIN c USING (n))"""


def _evidence(spark, d) -> DataFrame:
    """A rule per nation, `.n .absent` below its region's class; customers of even nations write the class, odd regions only their context."""
    n, c = read_table(spark, d, "nation"), read_table(spark, d, "customer")
    line = F.when(F.col("n_nationkey") % 5 == 4, _said("@media x% { }", "n_nationkey")).otherwise(_said(".ctx% .away% .own% { }", F.col("n_nationkey") % 2, "n_nationkey", "n_nationkey"))
    sheet = n.select(F.lit("a.css").alias("file"), (F.col("n_nationkey") + 1).alias("line_no"), line.alias("line"))
    code = c.where("c_nationkey % 4 = 0").select(_said("c%.ts", "c_custkey").alias("file"), F.lit(1).alias("line_no"), _said("use own%", "c_nationkey").alias("line"))
    code = code.unionByName(spark.range(1).select(F.lit("z.ts").alias("file"), F.lit(1).alias("line_no"), F.lit("ctx1").alias("line")))
    targets = n.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("a.css").alias("file"), (F.col("n_nationkey") + 1).alias("first_line"), (F.col("n_nationkey") + 1).alias("last_line"))
    none = spark.createDataFrame([], "statement_id long, ordinal int, selector string, line int")
    return styles.evidence(targets, none, sheet.unionByName(code))


@query(
    f"""{EVIDENCE} SELECT n::BIGINT AS statement, 'away' || n AS searched, 'context' AS role, 'context-missing' AS mode, 1::BIGINT AS found FROM p WHERE n % 5 <> 4
UNION ALL SELECT n, 'ctx0', 'context', 'context-missing', 1 FROM p WHERE n % 5 <> 4 AND n % 2 = 0
UNION ALL SELECT n, 'ctx1', 'context', 'exact', 1 FROM p WHERE n % 5 <> 4 AND n % 2 = 1
UNION ALL SELECT n, 'own' || n, 'subject', 'exact', k FROM p WHERE n % 5 <> 4 AND n % 4 = 0 AND k > 0
UNION ALL SELECT n, '', '', 'none-found', 1 FROM p WHERE n % 5 = 4"""
)
def evidence_rows(spark, d):
    return _evidence(spark, d).groupBy("statement", "searched", "role", "mode").agg(F.count("*").alias("found"))


@query(f"{EVIDENCE} SELECT count(*) FILTER (n % 5 <> 4 AND n % 4 = 0 AND k > 0) AS with_subject, count(*) FILTER (n % 5 <> 4 AND NOT (n % 4 = 0 AND k > 0)) AS only_context, count(*) FILTER (n % 5 = 4) AS without FROM p")
def evidence_counts(spark, d):
    return styles.evidence_counts(materialize(_evidence(spark, d), "evidence"))
