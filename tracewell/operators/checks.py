"""Integrity rules, each a DataFrame of (rule, detail) violations; `all_of` unions them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.sources.scans import violation


def all_of(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """J14, J15, T7 (path, change): same, changed, missing or extra, of before(path, sha256) and now(path, sha256)."""
    b, n = before.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("is"))
    change = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    return b.join(n, "path", "full").select("path", change.alias("change"))


def snapshot_intact(manifest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """V1."""
    return violation(file_changes(manifest, snapshot).where("change <> 'same'"), "snapshot", F.concat_ws(" ", "change", "path"))


def all_split(errors: DataFrame) -> DataFrame:
    """V2."""
    return violation(errors, "unsplit", F.col("file"))


def all_read(statements: DataFrame, progress: int) -> DataFrame:
    """V3."""
    return violation(statements.agg(F.max("id").alias("last")).where(F.col("last") > progress), "reading", F.col("last"))


def entries_walked(entries: DataFrame, demoted: DataFrame, states: DataFrame) -> DataFrame:
    """V4."""
    live = entries.select("id").join(demoted.select("id"), "id", "left_anti")
    unknown = violation(live.join(states.select("id"), "id", "left_anti"), "entry-unknown", F.col("id"))
    none = violation(entries.agg(F.count("*").alias("n")).where("n = 0"), "entry-none", F.lit("no entry"))
    return all_of(unknown, none, violation(live.join(states.where("not visited"), "id", "left_semi"), "entry-unvisited", F.col("id")))


def nothing_open(queued: DataFrame, handed: DataFrame) -> DataFrame:
    """V5."""
    return all_of(violation(queued, "queued", F.col("id")), violation(handed, "open-round", F.col("id")))


def machine_done(states: DataFrame, events: DataFrame) -> DataFrame:
    """V6: filled and walked since the last reset, by events(type, text); where the load or the name
    graph was absent at the fill nothing unvisited may be `unreached`."""
    there = events.agg(F.count_if(F.col("type") == "fill").alias("fill"), F.count_if(F.col("type") == "state").alias("walk"), F.countDistinct(F.when((F.col("type") == "graph") & F.col("text").isin("LOADS", "USES"), F.col("text"))).alias("graphs"))
    phases = there.select(F.explode(F.array(*[F.when(F.col(p) == 0, F.lit(p)) for p in ("fill", "walk")])).alias("phase")).where("phase is not null")
    stranded = states.where("not visited and machine_state = 'unreached'").join(F.broadcast(there.where("graphs < 2").select("graphs")))  # one row or none
    return violation(phases, "machine-phase", F.col("phase")).unionByName(violation(stranded, "graph-absent", F.col("id")))


def link_sums(links: DataFrame) -> DataFrame:
    """(path, sha256): for each kind of links(source, target, kind) a sum of its distinct links, whatever their order."""
    each = links.select("source", "target", "kind").distinct()
    parts = [F.count("*"), F.bit_xor(F.xxhash64("source", "target")), F.bit_xor(F.xxhash64("target", "source"))]
    said = F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")
    return each.groupBy("kind").agg(F.sha2(said, 256).alias("sha256")).select(F.concat(F.lit("links/"), "kind").alias("path"), "sha256")


def manifest_sum(manifest: DataFrame) -> DataFrame:
    """(path, sha256): one sum of all of manifest(path, sha256)."""
    parts = [F.count("*"), F.bit_xor(F.xxhash64("path", "sha256")), F.bit_xor(F.xxhash64("sha256", "path"))]
    return manifest.agg(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256).alias("sha256")).select(F.lit("manifest").alias("path"), "sha256")


def sums_equal(stored: DataFrame, now: DataFrame) -> DataFrame:
    """V7."""
    return violation(file_changes(stored, now).where("change <> 'same'"), "fill-sums", F.concat_ws(" ", "change", "path"))


def all_classified(states: DataFrame) -> DataFrame:
    """V8."""
    from tracewell.operators.workflow import never_examined

    return all_of(violation(states.where("unresolved"), "unresolved", F.col("id")), violation(never_examined(states), "never-examined", F.col("id")))


def columns_agree(stored: DataFrame, links: DataFrame) -> DataFrame:
    """stored(id, inputs, outputs), where not both null, equal what links give."""
    now = graph.io_columns(links).select("id", F.col("inputs").alias("i"), F.col("outputs").alias("o"))
    rows = stored.where("inputs is not null or outputs is not null").join(now, "id", "left")
    empty = F.array().cast("array<long>")
    same = (F.coalesce("inputs", empty) == F.coalesce("i", empty)) & (F.coalesce("outputs", empty) == F.coalesce("o", empty))
    return violation(rows.where(~same), "columns", F.col("id"))


def lines_inside(candidates: DataFrame, line_counts: DataFrame) -> DataFrame:
    """candidates' lines exist in the snapshot's files."""
    rows = candidates.join(line_counts.select("file", "lines"), "file", "left")
    return violation(rows.where("lines is null or first_line < 1 or last_line > lines or first_line > last_line"), "address", F.col("id"))


def consistent(statements: DataFrame, selectors: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Statement ids are there once, and entries and selectors name statements."""
    parts = [violation(statements.groupBy("id").count().where("count > 1"), "statement-twice", F.col("id"))]
    own = selectors.select(F.col("statement_id").alias("id")).distinct()
    parts.append(violation(own.join(statements, "id", "left_anti"), "selector-unknown", F.col("id")))
    if entries is not None:
        parts.append(violation(entries.join(statements, "id", "left_anti"), "entry-unknown", F.col("id")))
    return all_of(*parts)
