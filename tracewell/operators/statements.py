"""Splitting of snapshot files into numbered statements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions.splitting import Unsplit, units
from tracewell.runtime import materialize

_UNITS = "file string, ordinal int, first_line int, last_line int, text string, selectors array<struct<ordinal:int,selector:string,line:int>>, reason string"
_ARROW = pa.schema(
    [("file", pa.string()), ("ordinal", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("text", pa.string())]
    + [("selectors", pa.list_(pa.struct([("ordinal", pa.int32()), ("selector", pa.string()), ("line", pa.int32())]))), ("reason", pa.string())]
)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            spans = [(s["first_line"], s["last_line"]) for s in r["spans"]] if r["spans"] is not None else None
            own = []
            try:
                for i, (first, last, text, names) in enumerate(units(r["path"], r["text"], spans)):
                    own.append({"file": r["path"], "ordinal": i, "first_line": first, "last_line": last, "text": text, "selectors": [{"ordinal": o, "selector": s, "line": n} for o, s, n in names], "reason": None})
            except (Unsplit, RecursionError, MemoryError) as e:
                own = [{"file": r["path"], "ordinal": None, "first_line": None, "last_line": None, "text": None, "selectors": None, "reason": str(e) or type(e).__name__}]
            rows += own
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def split_files(files: DataFrame, spans: DataFrame | None = None) -> dict[str, DataFrame]:
    """Statements, selectors and errors of files(path, content).

    Ids count over files as a folder walk lists them (a folder's files before
    its subfolders), then over each file's units. A file that cannot be split
    is one row of errors and has no statements. spans(path, first_line,
    last_line) replaces the splitter for the files that it has.
    """
    rows = files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if spans is not None:
        given = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("first_line", "last_line"))).alias("spans"))
        rows = rows.join(given, "path", "left")
    else:
        rows = rows.withColumn("spans", F.lit(None).cast("array<struct<first_line:int,last_line:int>>"))
    found = materialize(rows.select("path", "text", "spans").mapInArrow(_split, _UNITS), "units")
    good = found.where("reason is null")
    numbered = good.join(file_offsets(good), "file").withColumn("id", F.col("offset") + F.col("ordinal") + 1)
    return {
        "statements": numbered.select("id", "file", "first_line", "last_line", "text"),
        "selectors": numbered.select(F.col("id").alias("statement_id"), F.explode("selectors").alias("s")).select("statement_id", "s.*"),
        "errors": found.where("reason is not null").select("file", "reason"),
    }


def file_offsets(units_: DataFrame) -> DataFrame:
    """(file, offset): units before each file in walk order, by a two-level prefix sum over ranges of files."""
    per = units_.groupBy("file").agg(F.count("*").alias("n")).withColumn("key", C.walk_key(F.col("file")))
    dealt = materialize(per.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row per range
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("key")) - F.col("n")
    return dealt.withColumn("inside", inside).join(before, "part").select("file", (F.col("base") + F.col("inside")).alias("offset"))


def by_extension(statements: DataFrame) -> DataFrame:
    """A4 (ext, statements)."""
    return statements.groupBy(C.extension(F.col("file")).alias("ext")).agg(F.count("*").alias("statements"))
