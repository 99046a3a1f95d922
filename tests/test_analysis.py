"""The chain from files to the final list, on small projects of our own."""

import dataclasses
import json
import shutil

import pytest
from pyspark.sql import functions as F

from tracewell import runtime
from tracewell import schema as S
from tracewell.operators import edges, graph, loads, names, styles
from tracewell.operators.workflow import Review, handed, log_links, queue
from tracewell.plans import analysis
from tracewell.sources import scans

FILES = {
    "web/main.tsx": 'import "./setup";\nimport css from "./card.module.css";\nimport { shown } from "../core";\nimport * as tools from "../core/tools";\nexport default function App() { return shown(tools.deep.run(css.title)); }\n',
    "web/setup.ts": "register();\nconst idle = 1;\n",
    "web/card.module.css": '@import "./base.css";\n.title { color: var(--ink); }\n.gone { }\n',
    "web/base.css": "body { margin: 0 }\n",
    "web/orphan.ts": '"use client";\nexport const lonely = 1;\n',
    "core/index.ts": 'export * from "./a";\nexport { hidden as shown } from "./b";\n',
    "core/a.ts": "function shown() { return 0; }\nexport function other() { return 1; }\n",
    "core/b.ts": "export function hidden() { return helper(); }\nfunction helper() { return 2; }\nfunction never() { return 3; }\n",
    "core/tools.ts": 'import * as inner from "./inner";\nexport { inner as deep };\n',
    "core/inner.ts": "export function run(x) { return x; }\n",
    "py/app/__init__.py": "",
    "py/app/one.py": "from app.two import used\nimport os\n\ndef start():\n    from app import three\n    return used() + three.late()\n\nstart()\n",
    "py/app/two.py": "def used():\n    return 1\n\ndef unused():\n    return 2\n",
    "py/app/three.py": "def late():\n    return 3\n\nprint('loaded')\n",
    "bin/run.sh": "#!/bin/sh\n. ./lib.sh\ngreet\n",
    "bin/lib.sh": "greet() {\n  echo hi\n}\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.sh").write_bytes(b"echo \xff\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("x()")
    lines = spark.createDataFrame([(i, n) for i, n in enumerate([*FILES, "bad.sh", "lost.py"])], "pos int, line string")
    p = analysis.take_snapshot(spark, str(root), lines)
    p.root = str(root)
    return p


def texts(project):
    return {(r["file"], r["text"]): r["id"] for r in project.statements.collect()}


def find(project, file, begins):
    return next(i for (f, t), i in texts(project).items() if f == file and t.startswith(begins))


def test_snapshot_and_ids(project):
    assert [r["path"] for r in project.missing.collect()] == ["lost.py"]
    assert [r["file"] for r in project.quarantined.collect()] == ["bad.sh"]
    rows = project.statements.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    assert list(dict.fromkeys(r["file"] for r in rows)) == sorted((f for f in FILES if FILES[f]), key=lambda f: [(i < len(f.split("/")) - 1, p) for i, p in enumerate(f.split("/"))])
    assert project.errors.count() == 0


@pytest.fixture(scope="module")
def found(spark, project):
    ids = [find(project, "web/main.tsx", "export default"), find(project, "py/app/one.py", "start()"), find(project, "bin/run.sh", "greet"), find(project, "web/orphan.ts", '"use client"')]
    entries = spark.createDataFrame([(i,) for i in ids], "id long")
    return entries, analysis.derive(project, entries)


def test_links(project, found):
    _, d = found
    links = {(r["source"], r["target"], r["kind"]) for r in d["links"].collect()}
    at = lambda f, t: find(project, f, t)
    app = at("web/main.tsx", "export default")
    assert (at("web/main.tsx", 'import "./setup"'), at("web/setup.ts", "register"), "LOADS") in links
    assert (at("web/main.tsx", "import css"), at("web/card.module.css", "@import"), "LOADS") in links
    assert (at("web/card.module.css", "@import"), at("web/base.css", "body"), "LOADS") in links
    assert not any(t == at("web/card.module.css", ".title") for _, t, _ in links)
    # the named re-export goes before the star; a local function of the starred file is not published
    assert {(app, at("core/b.ts", "export function hidden"), "USES"), (app, at("core/index.ts", "export {"), "USES"), (app, at("web/main.tsx", "import { shown"), "USES")} <= links
    assert (app, at("core/a.ts", "function shown"), "USES") not in links
    # a path through a bare export of a namespace
    assert {(app, at("core/inner.ts", "export function run"), "USES"), (app, at("core/tools.ts", "export {"), "USES"), (app, at("core/tools.ts", "import *"), "USES")} <= links
    assert (at("core/b.ts", "export function hidden"), at("core/b.ts", "function helper"), "USES") in links
    start = at("py/app/one.py", "def start")
    assert {(start, at("py/app/two.py", "def used"), "USES"), (start, at("py/app/three.py", "def late"), "USES"), (at("py/app/one.py", "start()"), start, "USES")} <= links
    assert not any(t == at("py/app/three.py", "print") for _, t, _ in links)  # an import in a body loads nothing by itself
    assert (at("bin/run.sh", "greet"), at("bin/lib.sh", "greet()"), "USES") in links
    assert [r["file"] for r in d["demoted"].collect()] == ["web/orphan.ts"]


def test_review_to_final_list(spark, project, found, tmp_path):
    entries, d = found
    review = Review(spark, str(tmp_path), project.statements, entries, d["demoted"])
    with pytest.raises(scans.Refused):
        review.walk()
    review.fill(d["links"], d["graphs"], project.manifest)
    with pytest.raises(scans.Refused):
        review.fill(d["links"])
    states = {r["id"]: r["machine_state"] for r in review.walk().collect()}
    at = lambda f, t: find(project, f, t)
    assert states[at("core/b.ts", "function helper")] == "reached"
    assert states[at("core/b.ts", "function never")] == "untouched"
    assert states[at("py/app/two.py", "def unused")] == "untouched"
    assert states[at("web/card.module.css", ".gone")] == "unsupported"
    assert review.next() is None  # every live entry is walked
    with pytest.raises(scans.Refused):
        analysis.final_list(project, review, scans.tree(spark, project.root), 10**6, d["links"])
    cases = lambda df: sorted(r["id"] for r in df.collect())
    dry = cases(review.sweep(dry=True))
    assert at("core/b.ts", "function never") in dry and review.unresolved().count() == 0
    assert cases(review.sweep()) == dry
    title = at("web/card.module.css", ".title")
    review.resolve(title, inputs=[at("web/main.tsx", "export default")])
    with pytest.raises(scans.Refused):
        review.resolve(title)
    with pytest.raises(scans.Refused):
        review.finish()
    rest = [i for i in dry if i != title]
    review._append([("reopen", i, None, "none") for i in rest])
    end = review.finish()
    assert end["done"], end["left"]
    rules = lambda p=project, n=10**6, links=d["links"]: {r["rule"] for r in analysis.violations(p, review, n, links).collect()}
    assert rules() == set()
    # each rule refuses
    other = dataclasses.replace
    assert rules(other(project, snapshot=project.snapshot.withColumn("content", F.when(F.col("path") == "web/setup.ts", F.lit(b"x\n")).otherwise(F.col("content"))))) == {"snapshot"}
    assert rules(other(project, manifest=project.manifest.where("path <> 'web/setup.ts'"))) == {"snapshot", "fill-sums"}
    assert rules(other(project, errors=spark.createDataFrame([("x.py", "odd")], "file string, reason string"))) == {"unsplit"}
    assert rules(n=3) == {"reading"}
    assert rules(links=d["links"].limit(3)) == {"fill-sums"}
    spark.createDataFrame([(10**6, title, [1], [2])], "seq long, id long, inputs array<long>, outputs array<long>").write.mode("append").parquet(f"{tmp_path}/columns")
    assert rules() == {"columns"}
    shutil.rmtree(f"{tmp_path}/columns")
    review._rebuild()
    assert rules() == set()
    rows, text = analysis.final_list(project, review, scans.tree(spark, project.root), 10**6, d["links"])
    text = "\n".join(r["value"] for r in text.orderBy("part", "key", "value").collect())
    got = {r["id"]: r for r in rows.collect()}
    assert at("py/app/two.py", "def unused") in got and title not in got
    assert got[at("core/b.ts", "function never")]["live_file"] == "same"
    assert "function never" in text and "bad.sh" in text
    with pytest.raises(scans.Refused):
        review.reset()
    review.reset(confirm=True)
    assert log_links(review.log()).where("origin = 'machine'").count() == 0
    assert review.states().where("visited_by = 'machine'").count() == 0
    # what an older fill and walk left does not count
    assert {"machine-phase", "fill-sums", "entry-unvisited"} <= rules()
    stored = {r["id"]: r["inputs"] for r in review.columns().collect()}
    assert stored[at("core/b.ts", "function helper")] is None and stored[title] == [at("web/main.tsx", "export default")]


def test_a_list_of_call_links_only_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a.py", i, i, f"f{i}()") for i in range(1, 6)], "id long, file string, first_line int, last_line int, text string")
    review = Review(spark, str(tmp_path), rows, spark.createDataFrame([(1,)], "id long"))
    links = spark.createDataFrame([(1, 2, "CALL"), (3, 4, "CALL")], "source long, target long, kind string")
    content = spark.createDataFrame([("a.py", b"1\n2\n3\n4\n5\n")], "path string, content binary").withColumn("sha256", F.sha2("content", 256))
    none = spark.createDataFrame([], "file string, reason string")
    project = analysis.Project(content, content.select("path", "sha256"), none, none, rows, none, none, content)
    rules = lambda: sorted((r["rule"], r["detail"]) for r in analysis.violations(project, review, 5, links).collect())
    review.fill(links, manifest=project.manifest)
    assert ("machine-phase", "walk") in rules()
    review.walk()
    assert [x for x in rules() if x[0] == "graph-absent"] == [("graph-absent", "3"), ("graph-absent", "4")]
    for i in (3, 4, 5):
        review._append([("unsure", i, None, "")])
    assert [x for x in rules() if x[0] == "graph-absent"] == []
    review.reset(True)
    review.fill(links, ["LOADS", "USES"], project.manifest)
    review.walk()
    assert not {"graph-absent", "machine-phase", "fill-sums", "columns"} & {r for r, _ in rules()}


def test_an_open_round_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a.py") for i in (1, 2)], "id long, file string")
    review = Review(spark, str(tmp_path), rows, spark.createDataFrame([(1,), (2,)], "id long"))
    open_ = lambda: [r["id"] for r in handed(review.log(), review.states()).collect()]
    assert open_() == [] and review.next() == 1 and open_() == [1]
    review.record(1)
    assert open_() == []


def test_saved_tables_are_guarded(spark, project, tmp_path):
    meta = lambda *rows: spark.createDataFrame(list(rows), "created_by string, schema_version int")
    rules = lambda df: sorted(r["rule"] for r in scans.guard(df).collect())
    assert rules(meta(("tracewell", S.VERSION))) == [] and rules(meta()) == ["meta-rows"]
    assert rules(meta(("other", 1))) == ["created-by", "schema-version"]
    analysis.save(project, str(tmp_path), entries=project.statements.select("id").limit(1))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        analysis.save(project, str(tmp_path))
    twice = dataclasses.replace(project, statements=project.statements.unionByName(project.statements))
    with pytest.raises(scans.Refused):
        analysis.save(twice, str(tmp_path / "b"))
    with pytest.raises(scans.Refused):
        analysis.save(project, str(tmp_path / "c"), entries=spark.createDataFrame([(10**9,)], "id long"))



def test_traversal(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a.py") for i in range(1, 7)], "id long, file string")
    review = Review(spark, str(tmp_path), rows, spark.createDataFrame([(3, 0)], "id long, pos int"))
    with pytest.raises(scans.Refused):
        review.record(3)
    assert review.next() == 3
    assert review.record(3, inputs=[6], outputs=[5, 4]) == 4
    assert review.next() == 4
    assert review.record(4, unresolved=True, outputs=[2]) is None
    assert [r["id"] for r in queue(review.states(), review.log()).orderBy("id").collect()] == [2, 5]
    assert review.next() == 2
    review.record(2)
    assert review.next() == 5
    review.record(5)
    assert review.next() is None
    review.resolve(4, outputs=[1])
    assert review.next() == 1
    review.record(1)
    io = {r["id"]: (r["inputs"], r["outputs"], r["is_source"], r["is_sink"]) for r in graph.io_columns(log_links(review.log())).collect()}
    assert io[3] == ([6], [4, 5], False, False) and io[6] == ([], [3], True, False) and io[5] == ([3], [], False, True)


def test_commands_at_once_get_their_own_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.py")], "id long, file string")
    one, two = (Review(spark, str(tmp_path), rows, rows.select("id")) for _ in range(2))
    assert [one._step(), two._step(), one._step()] == [1, 2, 3]
    two._append([("hand", 1, None, None)])
    assert [r["seq"] for r in one.log().collect()] == [4] and one._step() == 5


def test_manifest_lines(spark, project):
    lines = [json.loads(r["value"]) for r in scans.manifest_lines(project.snapshot, project.quarantined, project.missing).collect()]
    assert {(x["is"], x["path"]) for x in lines} == {("copied", f) for f in FILES} | {("quarantined", "bad.sh"), ("missing", "lost.py")}


def test_floor_join_knows_one_predecessor(spark):
    spans = spark.createDataFrame([(1, "f", 1, 10), (2, "f", 3, 4), (3, "f", 3, 3), (4, "g", 2, 2)], "id long, file string, first int, last int")
    asked = spark.createDataFrame([("f", 2), ("f", 3), ("f", 4), ("f", 6), ("g", 1), ("g", 2), ("h", 1), (None, 1), ("f", None)], "file string, line int")
    got = {(r["file"], r["line"]): r["found"] for r in edges.floor_join(asked, spans, "file", "line", "first", "last", "id").collect()}
    assert got == {("f", 2): 1, ("f", 3): 2, ("f", 4): 2, ("f", 6): None, ("g", 1): None, ("g", 2): 4, ("h", 1): None, (None, 1): None, ("f", None): None}


def test_closure_of_cycle_and_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(24)] + [(24, 0), (50, 51), (7, None)], "source long, target long")
    got = {r["id"]: r["round"] for r in graph.closure(spark.createDataFrame([(2,)], "id long"), links).collect()}
    assert got == {i: (i - 2) % 25 for i in range(25)}
    assert graph.closure(links.select(F.col("source").alias("id")).where("false"), links).count() == 0


def test_import_cycles_and_precedence(spark):
    rows = [
        (1, "a.ts", 'export * from "./b";'),
        (2, "b.ts", 'export * from "./a";'),
        (3, "b.ts", 'export * from "./c";'),
        (4, "c.ts", "export const x = 1;"),
        (5, "u.ts", 'import { x, y } from "./a";'),
        (6, "u.ts", "go(x, y);"),
    ]
    n = names.Names(spark.createDataFrame(rows, "id long, file string, text string"))
    links = {(r["source"], r["target"]) for r in n.use_links(spark.createDataFrame([(1,)], "id long")).collect()}
    assert {(6, 5), (6, 4), (6, 1), (6, 3), (1, 4)} <= links and (6, 2) not in links


def test_settings_names(spark):
    rows = [(1, "backend/config/settings.py", "LIMIT = 3"), (2, "x.py", "y = settings.LIMIT"), (3, "x.py", 'z = get("LIMIT")'), (4, "x.py", "LIMITED = 1")]
    n = names.Names(spark.createDataFrame(rows, "id long, file string, text string"))
    got = {(r["source"], r["target"]) for r in n.use_links(spark.createDataFrame([], "id long"), settings="backend/config/settings.py").collect()}
    assert got == {(2, 1), (3, 1)}


def test_guessed_folders(spark):
    files = spark.createDataFrame([("web/lib/a.ts",), ("app/lib/a.tsx",), ("app/lib/b/index.js",), ("lib/c.ts",)], "file string")
    asked = spark.createDataFrame([(1, "web/x.ts", "@/lib/a"), (2, "web/x.ts", "~/lib/b"), (3, "web/x.ts", "lib/a"), (4, "web/x.ts", "#s/lib/a.js"), (5, "web/x.ts", "@/lib/c"), (1, "web/x.ts", "@/lib/a")], "id long, file string, written string")
    got = sorted((r["id"], r["verdict"], r["target"]) for r in loads.resolved(asked, files).collect())
    a = [(1, "resolved", "app/lib/a.tsx"), (1, "resolved", "web/lib/a.ts")]
    assert got == sorted([*a, *a, (2, "resolved", "app/lib/b/index.js"), (3, "outside", None), (4, "resolved", "app/lib/a.tsx"), (4, "resolved", "web/lib/a.ts"), (5, "outside", None)])
    first = loads.resolved(asked, files).groupBy("id").agg(F.min_by("target", "priority").alias("t")).collect()
    assert {r["id"]: r["t"] for r in first}[1] == "app/lib/a.tsx"
    stated = loads.resolved(asked, files, [("@/", "web/")]).where("id in (1, 5)").distinct()
    assert sorted((r["id"], r["target"]) for r in stated.collect() if r["target"]) == [(1, "web/lib/a.ts")]


def test_ambiguous_module(spark):
    files = spark.createDataFrame([("a/m.py",), ("b/m.py",), ("c/n.py",)], "file string")
    asked = spark.createDataFrame([(1, "x.py", "m"), (2, "x.py", "a.m"), (3, "c/y.py", ".n"), (4, "x.py", "os")], "id long, file string, written string")
    got = {r["id"]: (r["verdict"], r["target"]) for r in loads.resolved(asked, files).collect()}
    assert got == {1: ("ambiguous", None), 2: ("resolved", "a/m.py"), 3: ("resolved", "c/n.py"), 4: ("outside", None)}


def test_evidence(spark):
    lines = [("s.css", 1, ".card .title-big { }"), ("s.css", 2, ".feedStatus { }"), ("s.css", 3, ".absent p { }"), ("a.tsx", 1, "<p className='card'>"), ("a.tsx", 2, "`title-${size}` card-x"), ("a.tsx", 3, "`feed${state}`")]
    df = spark.createDataFrame(lines, "file string, line_no int, line string")
    targets = spark.createDataFrame([(1, "s.css", 1, 1), (2, "s.css", 2, 2), (3, "s.css", 3, 3)], "id long, file string, first_line int, last_line int")
    none = spark.createDataFrame([], "statement_id long, ordinal int, selector string, line int")
    got = {(r["statement"], r["searched"], r["role"], r["mode"], r["line"]) for r in styles.evidence(targets, none, df).collect()}
    assert got == {(1, "card", "context", "exact", 1), (1, "title-big", "subject", "stem", 2), (1, "card", "context", "prefix", 2), (2, "feedStatus", "subject", "stem", 3), (3, "", "", "none-found", 0)}
    capped = styles.evidence(targets, none, df, most=1).where("statement = 1").orderBy("rank").collect()
    assert [r["mode"] for r in capped] == ["capped", "stem"]


def test_scans(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, line string")
    rows, bad = scans.source_list(lines("a.py", "# no", "", "../x", "/abs", "C:\\y", "b\\c.py"))
    assert [r["path"] for r in rows.orderBy("pos").collect()] == ["a.py", "../x", "/abs", "C:/y", "b/c.py"] and bad.count() == 3
    rows, bad = scans.entry_list(lines("3", " 5", "x", "3"))
    assert sorted(r["id"] for r in rows.collect()) == [3, 5] and bad.count() == 1
    assert scans.entry_list(lines(""))[1].count() == 1
    rows, bad = scans.statement_list(lines("1 | a.py | 1-2 | x | y", "2 | b.py | 3-3", "z"))
    assert [(r["id"], r["text"]) for r in rows.orderBy("id").collect()] == [(1, "x | y"), (2, "")] and bad.count() == 1
    got = {r["id"]: r["body"] for r in scans.sections(lines("## Statement 4", "why", "## Statement 5 - x", "", "## Statement 41x", "n", "## Other", "m")).collect()}
    assert got == {4: "why"}
    raw = spark.createDataFrame([("CALL\ta.py\t1\tb.py\t2", "g"), ("x\ty\tz", "g"), ("CALL\ta.py\tq\tb.py\t", "g"), ("REF\ta.py\t\t\t", "g")], "value string, graph string")
    raw = raw.unionByName(spark.createDataFrame([(b"CALL\t\xff\t1\tb\t2", "g")], "v binary, graph string").selectExpr("cast(v as string) as value", "graph"))
    rows, bad = scans.edge_rows(raw)
    assert sorted((r["kind"], r["from_line"]) for r in rows.collect()) == [("CALL", 1), ("REF", None)]
    assert sorted(r["rule"] for r in bad.collect()) == ["edge-columns", "edge-line", "edge-utf8"]
    assert [r["detail"] for r in edges.refs_without_record(rows, None).collect()] == ["g"] and edges.refs_without_record(rows, rows).count() == 0
    assert scans.contained("/tmp", "a/../b") and not scans.contained("/tmp", "../etc")


def test_a_cluster_has_to_name_the_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = spark.conf
        sparkContext = Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Session())
    assert runtime.shared_dir(spark)


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "k int, K_ int")
    assert runtime.free_names(df, "k", "k_", "x") == ["k__", "k___", "x"]
