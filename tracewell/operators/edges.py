"""Exported edges to links between statements, with counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.sources.scans import violation


def floor_join(lookups: DataFrame, spans: DataFrame, key: str, at: str, first: str, last: str, number: str) -> DataFrame:
    """lookups(key, at) with found: the id of the span with the greatest (first, last, id) among those
    that begin at or before `at`, if it also ends there or later; null otherwise.

    Only that one predecessor counts: an enclosing earlier span is not found.
    One running maximum per key over spans and distinct lookups, so a place
    that is looked up often is searched once.
    """
    places = lookups.select(F.col(key).alias("k"), F.col(at).alias("p")).where("k is not null and p is not null").distinct()
    span = F.struct(F.col(first).alias("f"), F.col(last).alias("l"), F.col(number).alias("i"))
    rows = spans.select(F.col(key).alias("k"), F.col(first).alias("p"), F.lit(0).alias("what"), span.alias("s"))
    rows = rows.unionByName(places.select("k", "p", F.lit(1).alias("what"), F.lit(None).cast(rows.schema["s"].dataType).alias("s")))
    w = Window.partitionBy("k").orderBy("p", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = rows.withColumn("m", F.max("s").over(w)).where("what = 1")
    hit = hit.select(F.col("k").alias("__k"), F.col("p").alias("__p"), F.when(F.col("m.l") >= F.col("p"), F.col("m.i")).alias("found"))
    return lookups.join(hit, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__p")), "left").drop("__k", "__p")


def with_ends(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """Edges with source and target statement ids, null where an end lies in none."""
    out = edges
    for side, name in (("from", "source"), ("to", "target")):
        spans = statements.select(F.col("file").alias(f"{side}_file"), "first_line", "last_line", "id")
        out = floor_join(out, spans, f"{side}_file", f"{side}_line", "first_line", "last_line", "id").withColumnRenamed("found", name)
    return out


def outcome(defined: bool = True) -> Column:
    """F2-F5, in this order: missing address, outside, same statement, structural, REF that ends inside, link."""
    missing = F.coalesce(F.col("from_file") == "", F.lit(True)) | F.coalesce(F.col("to_file") == "", F.lit(True)) | F.col("from_line").isNull() | F.col("to_line").isNull()
    return (
        F.when(missing, "no address")
        .when(F.col("source").isNull() | F.col("target").isNull(), "outside the statements")
        .when(F.col("source") == F.col("target"), "inside one statement")
        .when(~F.col("kind").isin(*S.MACHINE_KINDS), "structural")
        .when((F.col("kind") == "REF") & (F.col("to_label").isin(*S.LOCAL_LABELS) | F.col("defining").isNull()), "reference to a local")
        .otherwise("between two")
    )


def merge(edges: DataFrame, statements: DataFrame, defined: DataFrame) -> DataFrame:
    """Edges with source, target and outcome. A REF counts only if its target is in defined(id)."""
    names = defined.select(F.col("id").alias("defining")).distinct()
    ended = with_ends(edges, statements)
    return ended.join(names, F.col("target") == F.col("defining"), "left").withColumn("outcome", outcome()).drop("defining")


def links_of(merged: DataFrame) -> DataFrame:
    """T3 (source, target, kind): distinct links."""
    return merged.where("outcome = 'between two'").select("source", "target", "kind").distinct()


def counters(merged: DataFrame) -> DataFrame:
    """A2 (kind, outcome, edges); `between two` also counts repeats."""
    return merged.groupBy("kind", "outcome").agg(F.count("*").alias("edges"))


def repeats(merged: DataFrame) -> DataFrame:
    """T3 (kind, links, repeats): distinct links of each kind, and the edges beyond the first of each."""
    found = merged.where("outcome = 'between two'").groupBy("kind", "source", "target").agg(F.count("*").alias("n"))
    return found.groupBy("kind").agg(F.count("*").alias("links"), (F.sum("n") - F.count("*")).alias("repeats"))


def per_producer(**producers: DataFrame) -> DataFrame:
    """A6 (producer, rows, links): rows and distinct links of each producer's (source, target, kind)."""
    out = None
    for name, links in producers.items():
        one = links.select(F.lit(name).alias("producer"), "source", "target", "kind")
        out = one if out is None else out.unionByName(one)
    each = out.groupBy("producer", "source", "target", "kind").agg(F.count("*").alias("n"))
    return each.groupBy("producer").agg(F.sum("n").alias("rows"), F.count("*").alias("links"))


def refs_without_record(edges: DataFrame, defined: DataFrame | None) -> DataFrame:
    """REF edges need a record of defined names; without one, each graph that has them is a violation."""
    graphs = edges.where("kind = 'REF'").select("graph").distinct()
    return violation(graphs if defined is None else graphs.where("false"), "names-absent", F.col("graph"))


def kind_table(merged: DataFrame) -> DataFrame:
    """Per kind: edges by outcome, the most links first."""
    wide = merged.groupBy("kind").agg(*[F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in ("no address", "outside the statements", "inside one statement", "structural", "reference to a local", "between two")])
    return wide.orderBy(F.desc("between_two"), "kind")


def rows_per_graph(edges: DataFrame) -> DataFrame:
    """A3, A15."""
    return edges.groupBy("graph").agg(F.count("*").alias("edges"))


def normalised(edges: DataFrame) -> DataFrame:
    """Code excerpts cut to 80 characters, no variable."""
    return edges.select("kind", "from_file", "from_line", "to_file", "to_line", "from_method", "from_label", "to_method", "to_label", F.substring("from_code", 1, 80).alias("from_code"), F.substring("to_code", 1, 80).alias("to_code"))
