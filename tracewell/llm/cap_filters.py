"""Embedding near-dedup by spherical-cap filters of structured random product codes.

A vector is normalised, padded to LEAST dimensions, turned by a random rotation
and cut in two blocks. Each block has its own random code; a
filter is a pair of codewords, one per block, and a vector's product with it is
the sum of the two blocks' products. List decoding finds the filters that exceed
a vector's threshold from the two lists of products alone, without going through
all pairs of codewords: the threshold is the vector's own best products' last one,
and its best pairs lie among the best words of each list. (One threshold
for all leaves some vectors with hardly any filter, as products with structured
codes vary more than with independent ones.) The code grows with the vectors of a label, so
that a filter keeps few vectors that only chance brings there. With 1024 words and 64 filters two
vectors of cosine 0.93 share 25 filters on average and at least 5 in all but one of a
thousand pairs; vectors at right angles share one in 0.2 % of pairs.

Equal vectors are one class, and classes that lie around another are one group: a class
joins the least class of its filters if that is within half the threshold's angle, so
all members of a group are linked by the triangle inequality and no pair of them is made.
Groups meet by (label, length, filter) in an equi-join. The angle of their centres and
their radii tell for most that all or none of their members are linked; the rest goes
on member by member, and cosines are computed in double precision. So links are
counted without a row for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.runtime import materialize

#: Words of each block's code and filters of a vector, for labels of up to so many classes.
CODES = ((2_000, 1024, 64), (8_000, 2048, 72), (32_000, 4096, 84), (500_000, 8192, 100), (8_000_000, 16384, 120), (2**62, 65536, 180))
LEAST = 32
SEED = 11
#: Angles are told apart beyond this.
CLOSE = 1e-7
#: Filters that a class has to share with whom it joins, at least, and the share of the
#: classes whose choice leads no group yet from which another round is made.
VOTES, ROUND = 8, 0.01


def code_of(classes: int) -> tuple[int, int]:
    """(words, filters) for labels of so many classes."""
    return next((words, caps) for most, words, caps in CODES if classes <= most)


@lru_cache(8)
def _code(d: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two blocks' codewords for length d."""
    rng = np.random.default_rng([SEED, d])
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))

    def words(k: int) -> np.ndarray:
        c = rng.standard_normal((k, size))
        return c / np.linalg.norm(c, axis=0) * np.sqrt(k / d)

    return turn, words(d // 2), words(d - d // 2)


def caps(unit: np.ndarray, words: int = CODES[0][1], n_caps: int = CODES[0][2]) -> np.ndarray:
    """Numbers of the filters that each unit vector (row) lies in."""
    n, d = unit.shape
    if d < LEAST:
        unit, d = np.concatenate([unit, np.zeros((n, LEAST - d))], 1), LEAST
    turn, one, two = _code(d, words)
    x = unit @ turn
    a, b = x[:, : d // 2] @ one, x[:, d // 2 :] @ two
    first = np.argpartition(-a, n_caps, axis=1)[:, :n_caps]
    second = np.argpartition(-b, n_caps, axis=1)[:, :n_caps]
    sums = np.take_along_axis(a, first, 1)[:, :, None] + np.take_along_axis(b, second, 1)[:, None, :]
    best = np.argpartition(-sums.reshape(n, -1), n_caps, axis=1)[:, :n_caps]
    return np.take_along_axis(first, best // n_caps, 1) * words + np.take_along_axis(second, best % n_caps, 1)


def _decode(words: int, n_caps: int):
    """(key, cap, cls): one row for each cap of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(0), b.column(1)
            lengths = np.asarray(pc.list_value_length(b.column(2)))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for s in range(0, len(at), 256):
                    part = at[s : s + 256]
                    x = np.asarray(b.column(2).take(pa.array(part)).flatten(), np.float64).reshape(len(part), d)
                    x = x / np.abs(x).max(1, keepdims=True)
                    found = caps(x / np.linalg.norm(x, axis=1, keepdims=True), words, n_caps)
                    rows = pa.array(np.repeat(part, found.shape[1]))
                    yield pa.record_batch([keys.take(rows), pa.array(found.ravel().astype(np.int64)), ids.take(rows)], names=["key", "cap", "cls"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lengths = np.asarray(pc.list_value_length(b.column(2)))
        for d in np.unique(lengths):  # both sides of a pair have the same length
            at = pa.array(np.flatnonzero(lengths == d))
            x, y = (np.asarray(b.column(i).take(at).flatten(), np.float64).reshape(-1, d) for i in (2, 3))
            xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            if not (np.isfinite(xx + yy) & (xx * yy > 1e-300)).all():  # very large or small components
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            cos = np.einsum("ij,ij->i", x, y) / np.sqrt(xx * yy)
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(cos)], names=["a", "b", "cosine"])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    x = vector.cast("array<double>")
    return F.coalesce(
        (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(x, lambda v: v != 0),
        F.lit(False),
    )


def _cosine(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, cosine) of pairs of classes of the same key, by vectors(cls, key, v)."""
    one = vectors.select(F.col("cls").alias("a"), F.col("key").alias("ka"), F.col("v").alias("va"))
    two = vectors.select(F.col("cls").alias("b"), F.col("key").alias("kb"), F.col("v").alias("vb"))
    full = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).join(one, "a").join(two, "b").where("ka = kb")
    return full.select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, cosine double")


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def grouped(rows: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(cls, lead, turn): each class's group and its angle to it, by the filters of rows(k, cls).

    A class proposes the least class that most of its filters name, VOTES at least. It joins
    that one if it leads itself and is within half of least's angle. Rounds go on while many
    propose a class that does not lead itself. Who joins none is a group of its own.
    """
    half = math.cos(math.acos(least) / 2 - CLOSE)
    total = max(1, vectors.count())
    led = vectors.where("false").select("cls", F.col("cls").alias("lead"), F.lit(0.0).alias("turn"))
    free = rows
    while True:
        mins = free.groupBy("k").agg(F.min("cls").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
        votes = free.join(mins, "k").groupBy("cls", "lead").agg(F.count("*").alias("n")).where(F.col("n") >= VOTES)
        said = materialize(votes.groupBy("cls").agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead")).where("cls <> lead"), "said")
        follow = said.select(F.col("cls").alias("lead")).distinct()
        asked = said.join(follow, "lead", "left_anti")
        new = _cosine(asked, vectors, "cls", "lead").where(F.col("cosine") >= half)
        new = materialize(new.select(F.col("a").alias("cls"), F.col("b").alias("lead"), _angle(F.col("cosine")).alias("turn")), "led")
        led = led.unionByName(new)
        if said.join(follow, "lead", "left_semi").count() <= ROUND * total:
            break
        # members ask no more
        free = materialize(free.join(new.select("cls"), "cls", "left_anti"), "free")
    alone = vectors.select("cls").join(led.select("cls"), "cls", "left_anti")
    return led.unionByName(alone.select("cls", F.col("cls").alias("lead"), F.lit(0.0).alias("turn")))


def linked(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(cls, lead, others) and (a, b) of classes(cls, label, v, size) with a label.

    others: rows of other classes within the angle of least; (a, b): leads whose groups have a linked pair.
    """
    vectors = classes.select(F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")).alias("key"), "cls", "v", "size")
    most = vectors.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = vectors.select("key", "cls", "v").mapInArrow(_decode(*code_of(most)), "key string, cap long, cls long")
    rows = materialize(rows.select(F.xxhash64("key", "cap").alias("k"), "cls"), "caps")
    members = materialize(grouped(rows, vectors, least).join(vectors.select("cls", "size"), "cls"), "members")
    groups = materialize(members.groupBy("lead").agg(F.max("turn").alias("r"), F.sum("size").alias("n")), "groups")
    held = materialize(rows.join(members.select("cls", "lead"), "cls").select("k", "lead").distinct(), "held")
    pairs = held.select("k", F.col("lead").alias("a")).join(held.select("k", F.col("lead").alias("b")), "k").where("a < b").select("a", "b").distinct()
    reach = math.acos(least)

    def verdict(angle: Column, radius: Column) -> Column:
        """Whether all, none, or some of what lies within the radius is within reach."""
        exact = F.when(F.col("cosine") >= least, "all").otherwise("none")
        return F.when(radius == 0, exact).when(angle + radius <= reach - CLOSE, "all").when(angle - radius > reach + CLOSE, "none").otherwise("some")

    side = lambda x: groups.select(F.col("lead").alias(x), F.col("r").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    met = _cosine(pairs, vectors, "a", "b").where(F.col("cosine") >= math.cos(min(math.pi, 2 * reach + 2 * CLOSE)))  # beyond, radii cannot help
    met = met.join(side("a"), "a").join(side("b"), "b").withColumn("verdict", verdict(_angle(F.col("cosine")), F.col("ra") + F.col("rb")))
    met = materialize(met.where("verdict <> 'none'"), "met")
    # members of a against the centre of b, then member against member
    whole, some, last = met.where("verdict = 'all'"), None, None
    inside = met.where("verdict = 'some'")
    if not inside.isEmpty():
        inside = inside.join(members.select(F.col("lead").alias("a"), F.col("cls").alias("x"), F.col("size").alias("nx")), "a")
        each = _cosine(inside, vectors, "x", "b").select(F.col("a").alias("x"), "b", "cosine")
        each = inside.select("x", "a", "b", "nx", "nb", "rb").join(each, ["x", "b"]).withColumn("verdict", verdict(_angle(F.col("cosine")), F.col("rb")))
        each = materialize(each.where("verdict <> 'none'"), "each")
        some = each.where("verdict = 'all'")
        both = each.where("verdict = 'some'").join(members.select(F.col("lead").alias("b"), F.col("cls").alias("y"), F.col("size").alias("ny")), "b").select("x", "y", "a", "b", "nx", "ny")
        exact = _cosine(both, vectors, "x", "y").where(F.col("cosine") >= least).select(F.col("a").alias("x"), F.col("b").alias("y"))
        last = materialize(both.join(exact, ["x", "y"]), "last")
    # what each member of a group, or each class, gets
    add = lambda df, to, n: df.select(F.col(to).alias("to"), F.col(n).alias("n"))
    to_groups, ends = add(whole, "a", "nb").unionByName(add(whole, "b", "na")), whole.select("a", "b")
    counted = members.join(groups.select("lead", "n"), "lead").withColumn("own", F.lit(0).cast("long"))
    if some is not None:
        to_groups, ends = to_groups.unionByName(add(some, "b", "nx")), ends.unionByName(some.select("a", "b")).unionByName(last.select("a", "b"))
        to_classes = add(some, "x", "nb").unionByName(add(last, "x", "ny")).unionByName(add(last, "y", "nx")).groupBy("to").agg(F.sum("n").alias("own"))
        counted = counted.drop("own").join(to_classes.withColumnRenamed("to", "cls"), "cls", "left")
    shared = to_groups.groupBy("to").agg(F.sum("n").alias("shared")).withColumnRenamed("to", "lead")
    others = F.col("n") - F.col("size") + F.coalesce("shared", F.lit(0)) + F.coalesce("own", F.lit(0))
    return counted.join(shared, "lead", "left").select("cls", "lead", others.alias("others")), ends.distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other rows with the same label, the same length and a
    cosine of at least `least`; copies of a vector count. Vectors that are null,
    empty, zero, hold null or non-finite components, or have no label link with
    nothing, nor do null ids. component_id is the smallest id reachable. Rows that repeat an id
    count as rows of their own. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # a vector's class is named by a row of its own, as an id may stand at several vectors
    rows = rows.select("vec_id", "label", "ok", "v", F.when(F.col("ok"), F.xxhash64("label", "v")).alias("h"), F.monotonically_increasing_id().alias("row"))
    marked = materialize(rows, "vectors")
    classes = marked.where("ok").groupBy("h", "label", "v").agg(F.min("row").alias("cls"), F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = materialize(classes, "classes")
    counted, links = linked(classes, least)
    counted = materialize(counted, "counted")
    roots = components(links).withColumnRenamed("node", "lead")
    named = classes.join(counted, "cls").join(roots, "lead", "left").withColumn("root", F.coalesce("root", "lead"))
    named = materialize(named.select("h", F.col("label").alias("nl"), F.col("v").alias("nv"), "root", "least", (F.col("size") - 1 + F.col("others")).alias("n_links")), "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(smallest, "root")
    out = marked.where("ok").join(named, "h").where("label = nl and v = nv").select("vec_id", "n_links", "component_id")
    out = out.unionByName(marked.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
