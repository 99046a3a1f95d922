"""Scans of the analysis's files, each as a DataFrame with its violations.

A scan with a format contract returns (rows, violations): violations(rule,
detail) is empty where the input keeps the contract; `refuse` raises the first.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.functions import columns as C


class Refused(ValueError):
    """An input or a state breaks its contract."""


def violation(df: DataFrame, rule: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def refuse(violations: DataFrame) -> None:
    """Raise with the first violation, by rule and detail, if there is one."""
    first = violations.orderBy("rule", "detail").first()
    if first:
        raise Refused(f"{first['rule']}: {first['detail']}")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): a small list file's lines in order. An absent file has none."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "pos int, line string")
    return raw.select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def source_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1 (pos, path): blanks and # comments skipped, backslashes turned; absolute, drive-letter and climbing paths break the contract."""
    rows = lines.select("pos", F.replace(C.strip(F.col("line")), F.lit("\\"), F.lit("/")).alias("path")).where("path <> '' and not startswith(path, '#')")
    bad = F.col("path").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    return rows, violation(rows.where(bad), "source-list", F.col("path"))


def scope_register(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 (path, role, evidence): three tab-separated columns, a known role, evidence, each path once."""
    parts = lines.where("trim(line) <> '' and not startswith(ltrim(line), '#')").select("pos", F.split("line", "\t").alias("c"))
    rows = parts.where(F.size("c") == 3).select(C.strip(F.col("c")[0]).alias("path"), C.strip(F.col("c")[1]).alias("role"), C.strip(F.col("c")[2]).alias("evidence"))
    broken = violation(parts.where(F.size("c") != 3), "scope-columns", F.col("pos") + 1)
    broken = broken.unionByName(violation(rows.where(~F.col("role").isin(*S.ROLES)), "scope-role", F.col("path")))
    broken = broken.unionByName(violation(rows.where("evidence = ''"), "scope-evidence", F.col("path")))
    return rows, broken.unionByName(violation(rows.groupBy("path").count().where("count > 1"), "scope-twice", F.col("path")))


def registered_roles(listed: DataFrame, register: DataFrame) -> DataFrame:
    """Listed files that are not registered, or not as application."""
    missing = violation(listed.join(register, "path", "left_anti"), "scope-missing", F.col("path"))
    return missing.unionByName(violation(listed.join(register.where("role <> 'application'"), "path"), "scope-not-application", F.col("path")))


def contained(root: str, path: str) -> bool:
    """Whether the real path lies within the real root."""
    root, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return real == root or real.startswith(root.rstrip(os.sep) + os.sep)


def tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """S17 (path, content): all files below root but those in `.git` and `node_modules`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^(file:)/+", "$1/")
    rows = raw.select(F.substring(path, F.lit(len(prefix) + 1), F.length(path)).alias("path"), *(["content"] if content else []))
    # a scan leaves out empty files and names that begin with `_` or `.`, so these are read by their paths
    listed = spark.createDataFrame([(f,) for f in _left_out(spark, root)], "full string")
    named = F.regexp_replace("full", "^(file:)/+", "$1/")
    rest = listed.select("full", F.substring(named, F.lit(len(prefix) + 1), F.length(named)).alias("path")).join(rows.select("path"), "path", "left_anti")
    rest = rest.where(~F.col("path").rlike(r"(^|/)(\.git|node_modules)/"))
    rest = rest.mapInArrow(_read_files, "path string, content binary") if content else rest.select("path")
    return rows.where(~F.col("path").rlike(r"(^|/)(\.git|node_modules)/")).unionByName(rest)


def _left_out(spark: SparkSession, root: str) -> list[str]:
    """Paths, as the file system names them, of the files below root that a scan leaves out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString()
        below = path.split(root.rstrip("/") + "/", 1)[-1]
        if f.getLen() == 0 or any(p.startswith(("_", ".")) for p in below.split("/")):
            out.append(path)
    return out


def some_match(spark: SparkSession, pattern: str) -> bool:
    """Whether a path matches the glob pattern."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pydict()
        for path, full in zip(rows["path"], rows["full"]):
            if full.startswith("file:"):
                fs, at = pa_fs.LocalFileSystem(), "/" + full.removeprefix("file:").lstrip("/")
            else:
                fs, at = pa_fs.FileSystem.from_uri(full)
            with fs.open_input_stream(at) as f:
                yield pa.record_batch([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])


def supported(files: DataFrame) -> DataFrame:
    return files.where(C.has_ext(F.col("path"), S.SUPPORTED, any_case=True))


def snapshot(listed: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """S3: listed files as copied (path, content, sha256), missing (path), quarantined (file, reason) for bytes that are no UTF-8."""
    found = listed.select("path").distinct().join(files, "path", "left")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return {
        "copied": found.where(F.col("content").isNotNull() & good).select("path", "content", F.sha2("content", 256).alias("sha256")),
        "missing": found.where("content is null").select("path"),
        "quarantined": found.where(F.col("content").isNotNull() & ~good).select(F.col("path").alias("file"), F.lit("the bytes are no UTF-8").alias("reason")),
    }


def manifest_lines(copied: DataFrame, quarantined: DataFrame, missing: DataFrame) -> DataFrame:
    """D4 (value): a line of JSON for each file: a sink for people; the engine keeps the tables."""
    files = copied.select(F.lit("copied").alias("is"), "path", "sha256", F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    files = files.unionByName(quarantined.select(F.lit("quarantined").alias("is"), F.col("file").alias("path"), none.alias("sha256"), "reason"))
    files = files.unionByName(missing.select(F.lit("missing").alias("is"), "path", none.alias("sha256"), none.alias("reason")))
    return files.orderBy("is", "path").select(F.to_json(F.struct("is", "path", "sha256", "reason")).alias("value"))


def snapshot_lines(copied: DataFrame, exts: tuple[str, ...] = S.SCRIPT + S.STYLE) -> DataFrame:
    """S5 (file, line_no, line) of code and style files; undecodable bytes are replaced."""
    rows = copied.where(C.has_ext(F.col("path"), exts, any_case=True))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_no"), "line")


def statement_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`id | file | first-last | text`; the text may hold the separator."""
    parts = lines.where("trim(line) <> ''").select("pos", F.split("line", r" [|] ", 4).alias("c"))
    address = F.split(C.strip(F.col("c")[2]), "-")
    good = (F.size("c") >= 3) & C.strip(F.col("c")[0]).rlike("^[0-9]+$") & C.strip(F.get("c", F.lit(2))).rlike("^[0-9]+-[0-9]+$")
    good = F.coalesce(good, F.lit(False))
    rows = parts.where(good).select(
        C.strip(F.col("c")[0]).cast("long").alias("id"),
        C.strip(F.col("c")[1]).alias("file"),
        address[0].cast("int").alias("first_line"),
        address[1].cast("int").alias("last_line"),
        F.coalesce(F.get("c", F.lit(3)), F.lit("")).alias("text"),
    )
    broken = violation(parts.where(~good), "statement-list", F.col("pos") + 1)
    return rows, broken.unionByName(violation(rows.groupBy("id").count().where("count > 1"), "statement-twice", F.col("id")))


def entry_list(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """S7 (id): strict scans refuse what is no id and an empty list, lenient ones skip it."""
    said = lines.select("pos", C.strip(F.col("line")).alias("line")).where("line <> ''")
    rows = said.where(F.col("line").rlike("^[0-9]+$")).groupBy(F.col("line").cast("long").alias("id")).agg(F.min("pos").alias("pos"))
    broken = violation(said.where(~F.col("line").rlike("^[0-9]+$")), "entry-not-id", F.col("line"))
    empty = violation(rows.agg(F.count("*").alias("n")).where("n = 0"), "entry-none", F.lit("no entry"))
    both = broken.unionByName(empty)
    return rows, both if strict else both.where("false")


def demoted_list(lines: DataFrame) -> DataFrame:
    """S8 (id): first tab column where it is digits; an absent file is empty."""
    return lines.select(F.split("line", "\t")[0].alias("c")).where(F.col("c").rlike("^[0-9]+$")).select(F.col("c").cast("long").alias("id")).distinct()


def name_map(lines: DataFrame, slash: bool = False) -> tuple[DataFrame, DataFrame]:
    """S9 (pos, name, target): two tab columns; directories end with `/`."""
    parts = lines.where("trim(line) <> '' and not startswith(ltrim(line), '#')").select("pos", F.split("line", "\t").alias("c"))
    target = C.strip(F.col("c")[1])
    rows = parts.where(F.size("c") == 2).select("pos", C.strip(F.col("c")[0]).alias("name"), (F.concat(F.rtrim(target, F.lit("/")), F.lit("/")) if slash else target).alias("target"))
    return rows, violation(parts.where(F.size("c") != 2), "map-columns", F.col("pos") + 1)


def edge_exports(spark: SparkSession, folder: str, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of all `edges-NAME.tsv`, 5 or 12 columns; the graph is NAME, and non-empty file ends get its prefix."""
    raw = spark.read.text(f"{folder.rstrip('/')}/edges-*.tsv").select("value", F.regexp_extract("_metadata.file_name", r"^edges-(.*)\.tsv$", 1).alias("graph"))
    return edge_rows(raw, prefixes)


def edge_rows(raw: DataFrame, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """raw(value, graph) as EDGES. Rows of another width, of bytes that are no UTF-8, or with a line
    number that is neither empty nor a number are violations, and no rows."""
    said = raw.where("trim(value) <> ''")
    valid = F.is_valid_utf8(F.col("value"))
    broken = violation(said.where(~valid), "edge-utf8", F.concat(F.col("graph"), F.lit(": "), F.make_valid_utf8("value")))
    parts = said.where(valid).select("graph", "value", F.split("value", "\t").alias("c"))
    broken = broken.unionByName(violation(parts.where(~F.size("c").isin(5, 12)), "edge-columns", F.col("value")))
    wide = F.size("c") == 12
    pick = lambda five, twelve: F.when(wide, F.get("c", F.lit(twelve))).otherwise(F.get("c", F.lit(five)) if five is not None else F.lit(""))
    number = lambda c: (c == "") | c.rlike("^[0-9]{1,9}$")
    good = parts.where(F.size("c").isin(5, 12)).withColumn("numbered", number(pick(2, 2)) & number(pick(4, 7)))
    broken = broken.unionByName(violation(good.where("not numbered"), "edge-line", F.col("value")))
    ends = good.where("numbered").select(
        "graph",
        F.col("c")[0].alias("kind"),
        F.replace(pick(1, 1), F.lit("\\"), F.lit("/")).alias("from_file"),
        pick(2, 2).alias("from_line"),
        pick(None, 3).alias("from_method"),
        pick(None, 4).alias("from_label"),
        pick(None, 5).alias("from_code"),
        F.replace(pick(3, 6), F.lit("\\"), F.lit("/")).alias("to_file"),
        pick(4, 7).alias("to_line"),
        pick(None, 8).alias("to_method"),
        pick(None, 9).alias("to_label"),
        pick(None, 10).alias("to_code"),
    )
    if prefixes is not None:
        ends = ends.join(prefixes.select(F.col("name").alias("graph"), F.col("target").alias("prefix")), "graph", "left")
        for c in ("from_file", "to_file"):
            ends = ends.withColumn(c, F.when((F.col(c) != "") & F.col("prefix").isNotNull(), F.concat("prefix", c)).otherwise(F.col(c)))
        ends = ends.drop("prefix")
    for c in ("from_line", "to_line"):
        ends = ends.withColumn(c, F.when(F.col(c) != "", F.col(c)).cast("int"))
    return ends, broken


def guard(meta: DataFrame, schema_version: int = S.VERSION) -> DataFrame:
    """meta(created_by, schema_version) of saved tables: one row, of this package and version."""
    odd = violation(meta.where(F.col("created_by") != S.CREATOR), "created-by", F.col("created_by"))
    odd = odd.unionByName(violation(meta.where(F.col("schema_version") != schema_version), "schema-version", F.col("schema_version")))
    return odd.unionByName(violation(meta.agg(F.count("*").alias("n")).where("n <> 1"), "meta-rows", F.col("n")))


def review_sections(spark: SparkSession, path: str) -> DataFrame:
    """S16 (id, body): `## Statement N` sections with a line that is not blank before the next `## `."""
    return sections(text_lines(spark, path))


def sections(lines: DataFrame) -> DataFrame:
    w = Window.orderBy("pos")  # one person's notes: a small file by its nature
    head = F.regexp_extract("line", r"^## Statement ([0-9]+)(?: .*)?$", 1)
    marked = lines.withColumn("h", F.when(F.col("line").startswith("## "), F.struct("pos", head.alias("id"))))
    marked = marked.withColumn("at", F.last("h", ignorenulls=True).over(w)).where("h is null and at.id <> ''")
    body = marked.groupBy(F.col("at.pos").alias("pos"), F.col("at.id").cast("long").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.where("trim(replace(body, '\n', '')) <> ''").groupBy("id").agg(F.min_by("body", "pos").alias("body"))


def statement(statements: DataFrame, number: int) -> DataFrame:
    """One statement by its id."""
    return statements.where(F.col("id") == number)


def write_tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """Tab-separated rows in total order, empty strings as nothing, no quotes."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)
