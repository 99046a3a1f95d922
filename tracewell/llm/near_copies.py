"""Near copies by the Jaccard similarity of word shingles, for SimHash near-dedup beyond its ball.

Candidates are of two kinds. Texts whose SimHash fingerprints lie within 3 bits meet by
ball hashing (see simhash.py). At similarity 0.8 two fingerprints differ in some 10 of 64
bits, and a ball that wide has more variants than can be emitted, so bands of minima
give the rest: a text has BANDS keys, each of ROWS minima of its shingles' hashes, so a
pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8,
0.016 at 0.3. Texts that share keys or balls are
grouped by connected components, which keeps the links linear in the texts. The
shingle sets of a group of up to BIG texts then meet in one task, where a search over the graph of
pairs with exact similarity of at least LEAST splits the group: a text that is
reached is not compared again, so a group of near copies costs about one
comparison a text, and pairs that share no key are still found inside a group.

A larger group stays dealt: a round compares all its texts with a few pivots, texts that no
pivot has reached yet, those near an earlier pivot first. As 1 - similarity is a distance, a pair
of texts that two pivots have reached can only be linked if each lies within twice the
distance of the other's pivot. So when no text that is left lies so near a pivot, what
remains is to compare the texts that are near several pivots, and those that are left, by themselves.

Texts of equal shingle sets are one text here; all comparisons are of different
sets. Texts of fewer words than a shingle have one shingle of all their words,
and texts without a word are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.components import components, text_key
from tracewell.llm.simhash import fingerprint_links, fingerprint_of
from tracewell.runtime import materialize

SEED = 42
WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 6
#: Texts of a group that one task compares, and pivots that a round takes from a larger one.
BIG, PIVOTS = 20_000, 8
#: Shingles whose minima are taken at once.
CHUNK = 512
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64), rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FLIP, TIMES = _mixers()


def bands(grams: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles that is not empty."""
    least = np.full(len(FLIP), np.uint64(2**64 - 1))
    for at in range(0, len(grams), CHUNK):
        part = grams[at : at + CHUNK]
        # an odd factor permutes
        least = np.minimum(least, ((part[None, :] ^ FLIP[:, None]) * TIMES[:, None]).min(1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(29)
    return key


def _identity(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        ids = np.array([_identity(g) for g in sets], np.uint64).view(np.int64)
        keys = [bands(g).view(np.int64).tolist() if len(g) else [] for g in sets]
        fps = np.array([fingerprint_of(g) for g in sets], np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(ids), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["k", "set", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([shingles(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["root", "set", "grams"])


def split(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set, the number of the first one that is reached over pairs of Jaccard similarity of at least `least`."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in order]])
    size = size[order]
    starts = np.concatenate([[0], np.cumsum(size)])
    root = np.full(len(sets), -1)
    open_ = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        part, queue = [first], [first]
        while queue:
            x = queue.pop()
            own = flat[starts[x] : starts[x + 1]]
            # sizes of sets that are similar enough differ by no more than that
            lo, hi = np.searchsorted(size, [least * size[x] - 1e-9, size[x] / least + 1e-9])
            rest = lo + np.flatnonzero(open_[lo:hi])
            for some in np.array_split(rest, max(1, int(size[rest].sum() // 2_000_000))):
                if not len(some):
                    continue
                which = np.repeat(np.arange(len(some)), size[some])
                at = np.arange(len(which)) + np.repeat(starts[some] - np.concatenate([[0], np.cumsum(size[some])[:-1]]), size[some])
                values = flat[at]
                place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                both = np.bincount(which, own[place] == values, len(some))
                near = some[both >= least * (size[some] + size[x] - both) - 1e-9]
                open_[near] = False
                part += near.tolist()
                queue += near.tolist()
        root[order[part]] = min(order[part])
    return root


def _grouped(table: pa.Table) -> pa.Table:
    table = table.sort_by("set")
    names = table.column("set").to_numpy()
    root = split([np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()])
    return pa.table({"set": pa.array(names), "root": pa.array(names[root])})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, pivot, linked): each set's pivots within twice the distance of LEAST."""
    for b in batches:
        rows = []
        for one, grams, pivots in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            own = np.frombuffer(grams.as_py(), np.uint64)
            for p in pivots:
                other = np.frombuffer(p["grams"], np.uint64)
                both = len(np.intersect1d(own, other, assume_unique=True))
                union = len(own) + len(other) - both
                if both >= (2 * LEAST - 1) * union - 1e-9:
                    rows.append((one, p["set"], bool(both >= LEAST * union - 1e-9)))
        one, pivot, linked = zip(*rows) if rows else ((),) * 3
        yield pa.record_batch([pa.array(one, pa.int64()), pa.array(pivot, pa.int64()), pa.array(linked, pa.bool_())], names=["set", "pivot", "linked"])


def _by_pivots(sets: DataFrame) -> DataFrame:
    """(set, root) of the sets (root, set, grams) of large groups, split as `split` does."""
    left = materialize(sets.select("root", "set"), "left")
    near = left.select("set", F.col("set").alias("pivot"), F.lit(True).alias("linked")).where("false")
    while True:
        marked = left.join(near.select("set").distinct().withColumn("near", F.lit(True)), "set", "left").withColumn("near", F.coalesce("near", F.lit(False)))
        open_ = marked.groupBy("root").agg(F.count_if("near").alias("near"), F.count("*").alias("n")).where((F.col("near") > 0) | (F.col("n") > BIG)).select("root")
        ranked = marked.join(open_, "root", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("near"), "set")))
        pivots = materialize(ranked.where(F.col("place") <= PIVOTS).select("set"), "pivots")
        if pivots.isEmpty():
            break
        chosen = sets.join(pivots, "set").groupBy("root").agg(F.collect_list(F.struct("set", "grams")).alias("pivots"))  # PIVOTS a group
        found = sets.join(materialize(chosen, "chosen"), "root").select("set", "grams", "pivots").mapInArrow(_near, "set long, pivot long, linked boolean")
        found = materialize(found, "near")
        near = near.unionByName(found)
        left = materialize(left.join(found.where("linked").select("set").distinct(), "set", "left_anti"), "left")
    several = near.groupBy("set").agg(F.countDistinct("pivot").alias("n")).where("n > 1").select("set")
    links = near.where("linked").select(F.col("set").alias("a"), F.col("pivot").alias("b"))
    for some in (several, left.select("set")):
        apart = sets.join(some, "set", "left_semi").groupBy("root").applyInArrow(_grouped, "set long, root long")
        links = links.unionByName(apart.select(F.col("set").alias("a"), F.col("root").alias("b")))
    found = components(links).withColumnRenamed("node", "set")
    return sets.select("set").join(found, "set", "left").select("set", F.coalesce("root", "set").alias("root"))


def grouped(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k, root): each different text by text_key, and its group of near copies. Null texts count as empty."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text_key(F.col(text_col)).alias("k"), t.cast("binary").alias("t"))
    found = materialize(texts.mapInArrow(_keys, "k string, set long, fp long, keys array<long>"), "bands")
    each = found.groupBy("set").agg(F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.min("k").alias("one"))
    each = materialize(each, "sets")
    balls = materialize(each.groupBy("fp").agg(F.min("set").alias("rep")), "balls")
    same = each.join(balls, "fp").where("set <> rep").select(F.col("set").alias("a"), F.col("rep").alias("b"))
    near = fingerprint_links(balls, balls.count())
    near = near.join(balls.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(balls.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    rows = each.select("set", F.explode("keys").alias("key"))
    least = rows.groupBy("key").agg(F.min("set").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    links = rows.join(least, "key").where("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b")).distinct()
    near = components(links.unionByName(same).unionByName(near)).withColumnRenamed("node", "set")
    one = materialize(each.join(near, "set").select("root", "set", F.col("one").alias("k")), "candidates")
    # one text of each set
    sought = texts.join(one, "k").select("root", "set", "t")
    sets = sought.mapInArrow(_sets, "root long, set long, grams binary").dropDuplicates(["set"])
    large = materialize(one.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BIG).select("root"), "large")
    if large.isEmpty():
        apart = sets.groupBy("root").applyInArrow(_grouped, "set long, root long")
    else:
        sets = materialize(sets, "grams")
        apart = sets.join(large, "root", "left_anti").groupBy("root").applyInArrow(_grouped, "set long, root long")
        apart = apart.unionByName(_by_pivots(materialize(sets.join(large, "root", "left_semi"), "large_sets")))
    apart = materialize(apart, "apart")
    return found.select("k", "set").distinct().join(apart, "set", "left").select("k", F.coalesce("root", "set").alias("root"))
