"""Connected components of a link table, as DataFrame rounds.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every round is two partial aggregations and two
equi-joins, so a hub with any number of links never meets in one task beyond
what a skew-split join reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import free_names, materialize, release


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links(a, b): long ids, any direction, repeats and self links allowed.

    Returns (node, root): every node that has a link to another node, with the
    smallest id of its component. Null ends are left out. No links: no rows.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(), "links")
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        release(edges, large)
        edges, now = after, _mark(after)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def text_key(text: Column) -> Column:
    """128 bits of a text, null as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: groups(k, root) names that of every text's text_key.

    It is the row of the smallest id; null ids come last, then the text's hash decides.
    """
    hashed, gone_id, gone_key = free_names(docs, "k", "gone_id", "gone_key")
    k = text_key(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), k.alias("k")).groupBy("id", "k").agg(F.count("*").alias("n"))
    rows = materialize(rows.join(groups, "k"), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("x")).select("root", F.col("x.id").alias("first_id"), F.col("x.k").alias("first_k"))
    # written, so that the join's exchange can be split where a group is large
    judged = rows.join(materialize(first, "first"), "root").select("id", "k", "n", (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("k") == F.col("first_k"))).alias("kept"))
    judged = materialize(judged, "judged")
    gone = judged.where("not kept").select(F.col("id").alias(gone_id), F.col("k").alias(gone_key))
    marked = docs.withColumn(hashed, k)
    kept = marked.join(gone, (F.col(hashed) == F.col(gone_key)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left_anti")
    if judged.where("kept and n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, hashed])
    return kept.drop(hashed)
