"""The final list: unvisited statements, with drift of the live files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.operators.checks import file_changes
from tracewell.sources.scans import supported

#: How many files never seen, unresolved imports and live files without a reached statement are named.
NAMED, NAMED_IMPORTS, NAMED_FILES = 200, 20, 10


def named(df: DataFrame, by: str, most: int) -> DataFrame:
    """O4 (name): the first `most` values of a column in order, and a line that counts the others if there are any."""
    first = df.select(F.col(by).cast("string").alias("name")).orderBy("name").limit(most)
    more = df.agg((F.count("*") - most).alias("n")).where("n > 0").select(F.concat(F.lit("and "), "n", F.lit(" more")).alias("name"))
    return first.unionByName(more)


def candidates(states: DataFrame, links: DataFrame, manifest: DataFrame, live: DataFrame) -> DataFrame:
    """Unvisited statements by id, with line counts, neighbours and the live file's change."""
    drift = file_changes(manifest, live).select(F.col("path").alias("file"), F.col("change").alias("live_file"))
    io = graph.io_columns(links).select("id", graph.joined_ids(F.col("inputs")).alias("inputs"), graph.joined_ids(F.col("outputs")).alias("outputs"))
    rows = states.where("not visited").join(io, "id", "left").join(drift, "file", "left")
    return rows.select("id", "file", "first_line", "last_line", (F.col("last_line") - F.col("first_line") + 1).alias("lines"), F.coalesce("inputs", F.lit("")).alias("inputs"), F.coalesce("outputs", F.lit("")).alias("outputs"), "machine_state", "reviewed", F.coalesce("live_file", F.lit("missing")).alias("live_file")).orderBy("id")


def never_seen(live: DataFrame, manifest: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """J16 (path): supported live files that neither the manifest nor the register knows."""
    known = manifest.select("path")
    if register is not None:
        known = known.unionByName(register.select("path"))
    return supported(live.select("path")).join(known.distinct(), "path", "left_anti")


def markdown(rows: DataFrame, texts: DataFrame, unsplit: DataFrame, quarantined: DataFrame, unseen: DataFrame, demoted: DataFrame) -> DataFrame:
    """W14 (part, key, value): the list for people as lines of text, a block per candidate, to be written in the order of part and key."""
    parts = [rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("key"), F.lit("# Statements that nothing reaches\n").alias("value"))]
    seen = named(unseen, "path", NAMED)
    for i, (title, df, of) in enumerate((("Unsplit files", unsplit, "file"), ("Quarantined files", quarantined, "file"), ("Demoted directives", demoted, "file"), ("Live files never seen", seen, "name")), 1):
        head = df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(2 * i).alias("part"), F.lit(0).cast("long").alias("key"), F.lit(f"## {title}\n").alias("value"))
        parts += [head, df.select(F.lit(2 * i + 1).alias("part"), F.lit(0).cast("long").alias("key"), F.concat(F.lit("- "), of).alias("value"))]
    each = rows.join(texts.select("id", "text"), "id")
    dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    block = F.concat(
        F.lit("\n## "), "id", F.lit(": "), "file", F.lit(" "), "first_line", F.lit("-"), "last_line", F.lit("\n\nmachine: "), F.coalesce("machine_state", F.lit("-")),
        F.lit("; live file: "), "live_file", F.lit("; in: "), dash("inputs"), F.lit("; out: "), dash("outputs"), F.lit("\n\n    "), "text", F.lit("\n"),
    )
    parts.append(each.select(F.lit(100).alias("part"), F.col("id").alias("key"), block.alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_markdown(text: DataFrame, path: str) -> None:
    """Files whose names' order is the text's order."""
    text.orderBy("part", "key", "value").select("value").write.mode("overwrite").text(path)
