"""Textual evidence for style statements: token joins of their names with the snapshot's lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.functions import columns as C
from tracewell.functions.style_names import style_names
from tracewell.runtime import materialize

MODES = ("exact", "prefix", "stem")
#: What names look for, in rows up to which it is sent to all executors.
SMALL = 100_000


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r["id"], *x) for r in b.to_pylist() for x in style_names(r["text"], r["selectors"] or [])]
        yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], names=["id", "kind", "name", "role"])


def names_of(statements: DataFrame, selectors: DataFrame) -> DataFrame:
    """X7 (id, kind, name, role) of statements(id, text)."""
    own = selectors.groupBy(F.col("statement_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "selector"))), lambda s: s["selector"]).alias("selectors"))
    return statements.select("id", "text").join(own, "id", "left").mapInArrow(_named, "id long, kind string, name string, role string")


def prefixes(token: Column) -> Column:
    """Names that the token continues with `-`, `--` or `__` and at least one more character."""
    n = F.length(token)
    at = F.filter(
        F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda p: (F.substring(token, p + 1, F.lit(1)) == "-") | ((F.substring(token, p + 1, F.lit(2)) == "__") & (n > p + 2)),
    )
    return F.transform(at, lambda p: F.substring(token, F.lit(1), p))


def stems(name: Column) -> Column:
    """Beginnings of the name that end in `-`, `--` or `__` and are more than that joiner."""
    n = F.length(name)
    at = F.filter(F.sequence(F.lit(1), n), lambda p: (p > 1) & ((F.substring(name, p, F.lit(1)) == "-") | ((F.substring(name, p - 1, F.lit(2)) == "__") & (p > 2))))
    return F.transform(at, lambda p: F.substring(name, F.lit(1), p))


def humps(name: Column) -> Column:
    """Beginnings of the name before a capital letter that follows none; the code must go on with `${`."""
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda p: (p > 1) & F.substring(name, p, F.lit(1)).rlike(r"^\p{Lu}$") & ~F.substring(name, p - 1, F.lit(1)).rlike(r"^\p{Lu}$"))
    return F.transform(at, lambda p: F.substring(name, F.lit(1), p - 1))


def occurrences(lines: DataFrame, ways: tuple[str, ...] = ("token", "prefix", "hole", "var")) -> DataFrame:
    """lines(file, line_no, line) as (file, line_no, way, key): what each line holds for these ways of writing a name."""
    tokens = C.style_tokens(F.col("line"))
    held = {
        "token": tokens,
        "prefix": F.flatten(F.transform(tokens, prefixes)),
        "hole": F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_-]+)\$\{"), F.lit(1)),
        "var": F.regexp_extract_all("line", F.lit(r"var\(\s*([A-Za-z0-9_-]+)"), F.lit(1)),
    }
    out = lines.where("false").select("file", "line_no", F.lit("").alias("way"), F.lit("").alias("key"))
    for way in ways:
        out = out.unionByName(lines.select("file", "line_no", F.lit(way).alias("way"), F.explode(F.array_distinct(held[way])).alias("key")))
    return out


def searches(names: DataFrame) -> DataFrame:
    """names(id, kind, name, role) as (id, kind, name, role, mode, way, key): what to look for."""
    one = lambda cond, mode, way, keys: names.where(cond).select("id", "kind", "name", "role", F.lit(mode).alias("mode"), F.lit(way).alias("way"), F.explode(keys).alias("key"))
    own = F.array("name")
    return (
        one("kind in ('class', 'animation')", 0, "token", own)
        .unionByName(one("kind = 'variable'", 0, "var", own))
        .unionByName(one("kind = 'class'", 1, "prefix", own))
        .unionByName(one("kind = 'class'", 2, "token", stems(F.col("name"))))
        .unionByName(one("kind = 'class'", 2, "hole", humps(F.col("name"))))
    )


def matches(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, kind, name, role, mode, file, line_no): the first matching mode per name and line.

    Lines are searched in the ways that the names ask for, and only what some name
    looks for leaves a line's task where the names are few.
    """
    sought = materialize(searches(names), "sought")
    ways = tuple(sorted(r["way"] for r in sought.select("way").distinct().collect()))  # four at most
    if sought.count() <= SMALL:
        sought = F.broadcast(sought)
    met = occurrences(lines, ways).join(sought, ["way", "key"])
    best = met.groupBy("id", "kind", "name", "role", "file", "line_no").agg(F.min("mode").alias("mode"))
    return best.withColumn("mode", F.element_at(F.array(*[F.lit(m) for m in MODES]), F.col("mode") + 1))


def evidence(targets: DataFrame, selectors: DataFrame, lines: DataFrame, most: int = 0) -> DataFrame:
    """D22 rows of targets(id, file, first_line, last_line), in order of `rank` per statement.

    Class names look in code files only; a statement's own lines never count;
    context classes that are written nowhere, and statements without any row,
    get a row that says so. With `most`, a statement's rows beyond it are
    replaced by one row that counts them.
    """
    spans = targets.select("id", F.col("file").alias("own_file"), "first_line", "last_line")
    body = spans.join(lines, (F.col("own_file") == F.col("file")) & F.col("line_no").between(F.col("first_line"), F.col("last_line")))
    text = body.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    names = materialize(names_of(text, selectors), "names")
    found = matches(names, lines).where(~((F.col("kind") == "class") & C.has_ext(F.col("file"), S.STYLE, any_case=True)))
    found = found.join(spans, "id").where(~((F.col("file") == F.col("own_file")) & F.col("line_no").between(F.col("first_line"), F.col("last_line"))))
    found = found.join(lines, ["file", "line_no"])
    rows = found.select(F.col("id").alias("statement"), F.col("name").alias("searched"), "kind", "role", "mode", "file", F.col("line_no").alias("line"), F.substring(C.strip(F.col("line")), 1, 80).alias("excerpt"))
    rows = materialize(rows, "evidence")
    absent = names.where("kind = 'class' and role = 'context'").select(F.col("id").alias("statement"), F.col("name").alias("searched"), "kind", "role").join(rows.select("statement", "searched", "kind", "role").distinct(), ["statement", "searched", "kind", "role"], "left_anti")
    rows = rows.unionByName(absent.withColumns({"mode": F.lit("context-missing"), "file": F.lit(""), "line": F.lit(0), "excerpt": F.lit("the context class is written nowhere in the code")}))
    order = Window.partitionBy("statement").orderBy(F.col("role") != "subject", F.col("mode") != "exact", "file", "line", "searched")
    rows = rows.withColumn("rank", F.row_number().over(order))
    blank = {"searched": F.lit(""), "kind": F.lit(""), "role": F.lit(""), "file": F.lit(""), "line": F.lit(0)}
    none = targets.select(F.col("id").alias("statement")).join(rows.select("statement").distinct(), "statement", "left_anti").withColumns({**blank, "mode": F.lit("none-found"), "excerpt": F.lit("no evidence found: a reason to look closer, no verdict"), "rank": F.lit(0)})
    if most:
        cut = rows.groupBy("statement").agg(F.count("*").alias("n")).where(F.col("n") > most)
        cut = cut.withColumns({**blank, "mode": F.lit("capped"), "excerpt": F.concat((F.col("n") - most).cast("string"), F.lit(" findings were left out; this evidence is not complete")), "rank": F.lit(0)}).drop("n")
        rows = rows.where(F.col("rank") <= most).unionByName(cut)
    return rows.unionByName(none)


def evidence_counts(rows: DataFrame) -> DataFrame:
    """One row of statements with their own name found, only surroundings, nothing."""
    per = rows.groupBy("statement").agg(F.bool_or(F.col("role") == "subject").alias("own"), F.bool_or(F.col("mode") == "none-found").alias("none"))
    return per.agg(F.count_if("own").alias("with_subject"), F.count_if(~F.col("own") & ~F.col("none")).alias("only_context"), F.count_if("none").alias("without"))
