"""The whole analysis of a source tree: snapshot, statements, links, states, review, final list.

    python -m tracewell.plans.analysis run FOLDER PROJECT   (lists in FOLDER: source-files.txt, entry-points.txt, ...)
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.operators import checks, edges, graph, loads, names, report, statements, styles
from tracewell.operators.workflow import Review, handed, log_links, queue, since_reset, stored_sums
from tracewell.runtime import local_session, materialize, ship
from tracewell.sources import scans


@dataclass
class Project:
    """Everything known about one snapshot; all members are DataFrames or None."""

    listed: DataFrame
    manifest: DataFrame
    missing: DataFrame
    quarantined: DataFrame
    statements: DataFrame
    selectors: DataFrame
    errors: DataFrame
    snapshot: DataFrame
    register: DataFrame | None = None


def take_snapshot(spark: SparkSession, root: str, listed_lines: DataFrame, register_lines: DataFrame | None = None, spans: DataFrame | None = None) -> Project:
    """Copy, hash and split the listed files of the tree at root."""
    ship(spark)
    listed, broken = scans.source_list(listed_lines)
    scans.refuse(broken)
    register = None
    if register_lines is not None:
        register, broken = scans.scope_register(register_lines)
        scans.refuse(broken)
        scans.refuse(scans.registered_roles(listed, register))
    parts = scans.snapshot(listed, scans.tree(spark, root))
    copied = materialize(parts["copied"], "snapshot")
    split = statements.split_files(copied, spans)
    rows = materialize(split["statements"], "statements")
    manifest = materialize(copied.select("path", "sha256"), "manifest")
    return Project(listed, manifest, parts["missing"], parts["quarantined"], rows, split["selectors"], split["errors"], copied, register)


def derive(project: Project, entries: DataFrame, aliases: list[tuple[str, str]] = (), exports: DataFrame | None = None, settings: str | None = None) -> dict:
    """Load, use and exported links (source, target, kind), with demoted entries, loaded files and the names of the graphs."""
    load = loads.load_graph(project.statements, entries, project.selectors, aliases)
    table = names.Names(project.statements, aliases)
    links = load["links"].unionByName(table.use_links(entries, settings))
    graphs = ["LOADS", "USES"]
    if exports is not None:
        scans.refuse(edges.refs_without_record(exports, table.defined_names()))
        graphs += [r["kind"] for r in exports.where(F.col("kind").isin(*S.MACHINE_KINDS)).select("kind").distinct().collect()]  # a few
        links = links.unionByName(edges.links_of(edges.merge(exports, project.statements, table.defined_names())))
    return {"links": materialize(links.distinct(), "links"), "demoted": load["demoted"], "loaded": load["loaded"], "imports": load["imports"], "defined": table.defined_names(), "graphs": graphs}


def evidence(project: Project, states: DataFrame, most: int = 0) -> DataFrame:
    """Evidence for the style statements that are not visited; `.css` in any case."""
    open_ = states.where("not visited").where(F.ilike("file", F.lit("%.css"))).select("id", "file", "first_line", "last_line")
    return styles.evidence(open_, project.selectors, scans.snapshot_lines(project.snapshot), most)


def violations(project: Project, review: Review, progress: int, links: DataFrame) -> DataFrame:
    """V1-V10 for the final list, from the stored tables and the log. links: the derived links as they are now."""
    states, log = review.states(), review.log()
    none = states.where("false").select("id")
    now = project.snapshot.select("path", F.sha2("content", 256).alias("sha256"))
    lines = project.snapshot.select(F.col("path").alias("file"), F.size(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n")).alias("lines"))
    sums = checks.link_sums(links).unionByName(checks.manifest_sum(project.manifest))
    return checks.all_of(
        checks.snapshot_intact(project.manifest, now),
        checks.all_split(project.errors),
        checks.all_read(project.statements, progress),
        checks.entries_walked(review.live_entries(), review.demoted if review.demoted is not None else none, states),
        checks.nothing_open(queue(states, log), handed(log, states)),
        checks.machine_done(states, since_reset(log)),
        checks.sums_equal(stored_sums(log), sums),
        checks.all_classified(states),
        checks.columns_agree(review.columns(), log_links(log)),
        checks.lines_inside(states.where("not visited"), lines),
    )


def final_list(project: Project, review: Review, live: DataFrame, progress: int, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refused while a check fails; else the candidates and the list as lines of Markdown. live(path, content)."""
    scans.refuse(violations(project, review, progress, links))
    hashed = live.select("path", F.sha2("content", 256).alias("sha256"))
    rows = report.candidates(review.states(), log_links(review.log()), project.manifest, hashed)
    unseen = report.never_seen(hashed, project.manifest.unionByName(project.quarantined.select(F.col("file").alias("path"), F.lit("").alias("sha256"))), project.register)
    demoted = review.demoted if review.demoted is not None else project.statements.where("false").select("id", "file")
    return rows, report.markdown(rows, project.statements, project.errors, project.quarantined, unseen, demoted)


TABLES = ("listed", "manifest", "missing", "quarantined", "statements", "selectors", "errors", "snapshot")


def save(project: Project, folder: str, **more: DataFrame) -> None:
    """Keep a project's tables, and more by name, under folder/tables; a later command loads them.

    Refused where there are tables already, or where statements, entries or selectors do
    not fit together; meta is written last, so what broke off cannot be loaded.
    """
    scans.refuse(checks.consistent(project.statements, project.selectors, more.get("entries")))
    for name, df in [*((n, getattr(project, n)) for n in TABLES), *more.items()]:
        df.write.mode("errorifexists").parquet(f"{folder}/tables/{name}")
    spark = project.statements.sparkSession
    spark.range(1).select(F.lit(S.CREATOR).alias("created_by"), F.lit(S.VERSION).alias("schema_version")).write.mode("errorifexists").parquet(f"{folder}/tables/meta")


def load(spark: SparkSession, folder: str) -> tuple[Project, Review]:
    """A saved project and its review, with the entry list and notes (review.md) of the folder."""
    table = lambda n: spark.read.parquet(f"{folder}/tables/{n}")
    scans.refuse(scans.guard(table("meta")))
    project = Project(*[table(n) for n in TABLES])
    entries, broken = scans.entry_list(scans.text_lines(spark, f"{folder}/entry-points.txt"))
    scans.refuse(broken)
    notes = scans.review_sections(spark, f"{folder}/review.md")
    return project, Review(spark, folder, project.statements, entries, table("demoted"), notes)


def _prefixes(spark: SparkSession, folder: str) -> DataFrame:
    rows, broken = scans.name_map(scans.text_lines(spark, f"{folder}/machine/prefixes.txt"))
    scans.refuse(broken)
    return rows


def run(spark: SparkSession, root: str, folder: str, settings: str | None = None) -> None:
    """Snapshot, split, derive, fill and walk; lists are read from the folder, exported edges from folder/machine."""
    read = lambda name: scans.text_lines(spark, f"{folder}/{name}")
    register = read("source-scope.tsv")
    project = take_snapshot(spark, root, read("source-files.txt"), None if register.isEmpty() else register)
    entries, broken = scans.entry_list(read("entry-points.txt"))
    scans.refuse(broken)
    aliases, broken = scans.name_map(read("machine/aliases.txt"), slash=True)
    scans.refuse(broken)
    exports = None
    if scans.some_match(spark, f"{folder}/machine/edges-*.tsv"):
        exports, broken = scans.edge_exports(spark, f"{folder}/machine", _prefixes(spark, folder))
        scans.refuse(broken)
    found = derive(project, entries, [(r["name"], r["target"]) for r in aliases.orderBy("pos").collect()], exports, settings)
    save(project, folder, entries=entries.select("id"), demoted=found["demoted"], links=found["links"], loaded=found["loaded"], imports=found["imports"])
    scans.manifest_lines(project.snapshot, project.quarantined, project.missing).write.mode("overwrite").text(f"{folder}/manifest.jsonl")
    review = Review(spark, folder, project.statements, entries, found["demoted"])
    review.fill(found["links"], found["graphs"], project.manifest)
    review.walk()


def main(argv: list[str] | None = None) -> None:
    """One command a call; all of them keep their state in FOLDER."""
    parser = argparse.ArgumentParser(prog="tracewell")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *more: str, flags: tuple[str, ...] = ()) -> None:
        p = sub.add_parser(name)
        for m in ("folder", *more):
            p.add_argument(m)
        for f in flags:
            p.add_argument(f, **({"action": "store_true"} if f in ("--dry", "--unreached", "--unresolved", "--confirm") else {"default": ""}))

    command("run", "project", flags=("--settings",))
    command("walk")
    command("reset", flags=("--confirm",))
    command("next")
    command("record", "id", flags=("--inputs", "--outputs", "--place", "--unresolved"))
    command("list")
    command("sweep", flags=("--dry", "--unreached"))
    command("resolve", "id", flags=("--inputs", "--outputs"))
    command("reopen", "id", "how")
    command("finish")
    command("report")
    command("styles", flags=("--most",))
    command("build", "project", "progress")
    a = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    if a.command == "run":
        run(spark, a.project, a.folder, a.settings or None)
    project, review = load(spark, a.folder)
    ids = lambda text: sorted({int(x) for x in text.replace(";", ",").split(",") if x.strip()})
    if a.command in ("run", "walk"):
        if a.command == "walk":
            review.walk()
        states = review.states()
        graph.state_counts(states).orderBy("machine_state").show()
        table = lambda n: spark.read.parquet(f"{a.folder}/tables/{n}")
        outside = table("imports").where("verdict = 'outside'").select("written").distinct()
        print("imports of no file:", *[r["name"] for r in report.named(outside, "written", report.NAMED_IMPORTS).collect()])
        idle = graph.coverage(states, table("loaded"), review.live_entries()).where("not walked")
        print("live files without a reached statement:", *[r["name"] for r in report.named(idle, "file", report.NAMED_FILES).collect()])
    elif a.command == "reset":
        review.reset(a.confirm)
    elif a.command == "next":
        number = review.next()
        print("the traversal stops" if number is None else scans.statement(project.statements, number).first().asDict())
    elif a.command == "record":
        print(review.record(int(a.id), ids(a.inputs), ids(a.outputs), a.place, a.unresolved))
    elif a.command == "list":
        review.unresolved().show(1000, truncate=100)
    elif a.command == "sweep":
        review.sweep(a.dry, a.unreached).orderBy("id").show(1000)
    elif a.command == "resolve":
        review.resolve(int(a.id), ids(a.inputs), ids(a.outputs))
    elif a.command == "reopen":
        review.reopen(int(a.id), a.how)
    elif a.command == "finish":
        end = review.finish()
        rows = project.statements.join(end.pop("suspected").select("id"), "id", "left_semi")
        scans.write_tsv(rows, f"{a.folder}/suspected", ["id"])
        print(end)
    elif a.command == "report":
        review.report().show(vertical=True)
    elif a.command == "styles":
        rows = evidence(project, review.states(), int(a.most or 0))
        scans.write_tsv(rows, f"{a.folder}/style-candidates", ["statement", "rank"])
        styles.evidence_counts(rows).show()
    elif a.command == "build":
        rows, text = final_list(project, review, scans.tree(spark, a.project), int(a.progress), spark.read.parquet(f"{a.folder}/tables/links"))
        scans.write_tsv(rows, f"{a.folder}/final-list", ["id"])
        report.write_markdown(text, f"{a.folder}/final-list.md")


if __name__ == "__main__":
    main()
