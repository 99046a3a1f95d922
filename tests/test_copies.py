"""Copies of files are worked out once and get the links that each would have by itself."""

from pyspark.sql import functions as F

from tracewell.operators import copies, loads, names


def project():
    """(id, file, text): groups of equal files, some of them imported, with other folders, orders and languages beside them."""
    files = {
        "lib/a.ts": ["export function f() { }", "export const g = 1;", "act();"],
        "lib/b.ts": ['export { f as h } from "./a";', 'export * from "./c";'],
        "lib/c.ts": ["export const x = f;", 'export * as deep from "./a";'],
        "pick/d.ts": ['import { f } from "../lib/a";', "const k = 1;", "go(f, k);"],
        "use/u0.ts": ['import { u1 } from "./u1";', "u1();"],
        "py/m.py": ["def late(): return 1", "LIMIT = 2"],
        "py/set.py": ["LIMIT = 3", "ALSO = settings.LIMIT"],
        "sh/lib.sh": ["greet() { echo; }"],
    }
    for i in range(1, 7):
        files[f"use/u{i}.ts"] = ['import { h, x, deep } from "../lib/b";', 'import { f } from "../lib/a";', "const k = h;", "export function u1() { return k + x; }", "run(u1, f, deep.g);"]
        files[f"door/e{i}.ts"] = ['export * from "../lib/b";', 'export { g } from "../lib/a";', "const f = 1;", "f;"]
        files[f"py/p{i}.py"] = ["def run(): from m import late as now, none return now()", "y = settings.LIMIT + run()"]
        files[f"sh/s{i}.sh"] = ['. "./lib.sh"', "greet now"]
    files["py/copy.py"] = files["py/set.py"]
    files["use/x.ts"] = [files["use/u1.ts"][k] for k in (1, 0, 2, 3, 4)]
    files["other/u.ts"] = files["use/u1.ts"]
    rows = [(f, t) for f, ts in files.items() for t in ts]
    # ids run through the files by turns, in the order of each
    rows.sort(key=lambda r: (files[r[0]].index(r[1]), r[0]))
    return [(i, *r) for i, r in enumerate(rows, 1)]


def derived(spark):
    rows = spark.createDataFrame(project(), "id long, file string, text string").repartition(3)
    entries = rows.where("file like 'door/e%' and file <> 'door/e2.ts' or file like 'use/%'").select("id")
    n = names.Names(rows)
    links = [(r["source"], r["target"]) for r in n.use_links(entries, settings="py/set.py").collect()]
    return links, sorted(map(tuple, n.published_names().collect())), sorted(map(tuple, n.defined_names().collect())), n


def test_copies_have_the_links_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(copies, "LINKS", 3)
    links, published, defined, n = derived(spark)
    # use/u1.ts is imported and x.ts has another order; copy.py is like the settings file
    assert {(r["like"], r["n"]) for r in n.copies.groupBy("like").agg(F.count("*").alias("n")).collect()} == {("use/u2.ts", 5), ("door/e1.ts", 6), ("py/p1.py", 6), ("sh/s1.sh", 6), ("py/copy.py", 2)}
    at = {(f, t): i for i, f, t in project()}
    late = [(i, at["py/m.py", "def late(): return 1"]) for (f, t), i in at.items() if f.startswith("py/p") and "late" in t]
    assert len(late) == 6 and set(late) <= set(links) and (at["use/u4.ts", "const k = h;"], at["lib/b.ts", 'export { f as h } from "./a";']) in links
    monkeypatch.setattr(copies, "MOST", 0)
    single = derived(spark)
    assert single[3].copies.count() == 0
    assert len(links) == len(set(links)) and sorted(links) == sorted(single[0])
    assert (published, defined) == single[1:3] and len(published) == len(set(published)) and len(defined) == len(set(defined))


def test_work_follows_different_texts(spark):
    """100 files with one text of 50 names: the clauses are read once, not 100 times, and links are whole."""
    every = ", ".join(f"s{i}" for i in range(50))
    lib = [(i, "lib/n.ts", f"export function s{i}() {{ }}") for i in range(50)]
    users = [x for c in range(100) for x in ((1000 + c, f"shop/c{c}.ts", f'import {{ {every} }} from "../lib/n";'), (2000 + c, f"shop/c{c}.ts", f"run({every});"))]
    n = names.Names(spark.createDataFrame(lib + users, "id long, file string, text string"))
    assert n.clauses.count() == 50 and n.tokens.count() == 100
    links = {(r["source"], r["target"]) for r in n.use_links(spark.createDataFrame([], "id long")).collect()}
    assert links == {(2000 + c, t) for c in range(100) for t in [1000 + c, *range(50)]}


def test_load_links_read_each_text_once(spark, monkeypatch):
    """40 files with one import and one call, of which every second is an entry."""
    sizes = {}
    write = loads.materialize
    monkeypatch.setattr(loads, "materialize", lambda df, name="cut": sizes.setdefault(name, write(df, name)))
    rows = [(1, "lib/n.ts", "register();"), *((i, f"a/c{i - 100}.ts", 'import { x } from "../lib/n";') for i in range(100, 140)), *((i, f"a/c{i - 200}.ts", "run(x);") for i in range(200, 240))]
    entries = spark.createDataFrame([(i,) for i in range(200, 240, 2)], "id long")
    none = spark.createDataFrame([], "statement_id long, ordinal int, selector string, line int")
    got = loads.load_graph(spark.createDataFrame(rows, "id long, file string, text string"), entries, none)
    assert {(r["source"], r["target"]) for r in got["links"].collect()} == {(i, 1) for i in range(100, 140)} | {(i, i - 100) for i in range(200, 240, 2)}
    assert sizes["written"].count() == 1 and sizes["asked"].count() == 1 and sizes["facts"].count() == 3


def test_loaded_files_need_no_links(spark, monkeypatch):
    """Of 1000 chained imports: a closure would write rounds, the list of loaded files needs none."""
    monkeypatch.setattr(loads, "closure", None)
    rows = [(i, f"a/c{i}.ts", f'import "./c{i + 1}";') for i in range(1000)] + [(5000, "a/self.ts", 'import "./self";')]
    got = loads.loaded_files(spark.createDataFrame(rows, "id long, file string, text string"))
    assert sorted(r["file"] for r in got.collect()) == sorted(f"a/c{i}.ts" for i in range(1, 1000))
