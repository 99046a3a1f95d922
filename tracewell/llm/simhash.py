"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints at Hamming distance d <= 3 meet at a variant that is at most 2
flips from one of them and at most 1 from the other. Fingerprints of even
parity therefore emit themselves, every single flip, and every double flip
within one 32-bit half; those of odd parity emit themselves and every single
flip. This finds every pair: at distance 3 the parities differ, and two of the
three differing bits lie in one half, so the even one reaches the odd one's
single flip of the third bit; at distances 0 to 2 single flips suffice.

Variants are shuffled in packed blocks of 10 bytes each (variant, number of the
flip), so that the exchange stays small, and are hashed over all blocks: equal
fingerprints are collapsed first, so no variant is hot. In a block, a variant
hit by several fingerprints gives a star around its smallest member within one
flip: all others are within two flips of the variant and so within three of the
centre. Members that all are two flips away differ by an even number of bits
and meet again at a nearer variant if they are linked. So links stay linear in
the number of collisions and no pair of a group is lost from its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components, keep_one
from tracewell.runtime import materialize

SEED = 42
CHUNK = 65536
#: Variants that one packed block holds on average.
BLOCK = 1_500_000
LEAST_BLOCKS = 96
#: Fingerprints whose variants one task emits, about.
DEAL, MOST_DEALS = 10_000, 20_000


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(g, SEED) for g in grams), np.dtype("<u8"), len(grams)))


def fingerprint_of(h: np.ndarray) -> int:
    """The SimHash of shingles by their hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = np.ascontiguousarray(h[at : at + CHUNK], np.dtype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _flips() -> np.ndarray:
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return np.array([0, *one, *two], np.uint64)


FLIPS = _flips()
#: Flips up to this number change one bit at most.
NEAR = 64


def _emit(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(fps: np.ndarray, flips: np.ndarray) -> pa.RecordBatch:
            v = (fps[:, None] ^ flips[None, :]).ravel()
            c = np.tile(np.arange(len(flips), dtype=np.uint16), len(fps))
            to = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(blocks)
            to = to.astype(np.uint16 if blocks <= 65536 else np.uint32)
            order = np.argsort(to, kind="stable")
            v, c, cuts = v[order], c[order], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=blocks))])
            full = np.flatnonzero(np.diff(cuts))
            return pa.record_batch(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([c[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                names=["block", "v", "c"],
            )

        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            odd = (np.bitwise_count(fps) & 1).astype(bool)
            for part, flips, step in ((fps[~odd], FLIPS, 1000), (fps[odd], FLIPS[: NEAR + 1], 16000)):
                for at in range(0, len(part), step):
                    yield packed(part[at : at + step], flips)

    return run


def _meet(table: pa.Table) -> pa.Table:
    v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(table.column("c").to_pylist()), np.uint16)
    s = np.sort(v)
    hit = np.unique(s[1:][s[1:] == s[:-1]])
    out = np.zeros((0, 2), np.int64)
    if len(hit):
        at = np.minimum(np.searchsorted(hit, v), len(hit) - 1)
        m = hit[at] == v
        v, c = v[m], c[m]
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        fp, near = v ^ FLIPS[c], c <= NEAR
        starts = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        size = np.diff(np.concatenate([starts, [len(v)]]))
        centre = np.repeat(np.minimum.reduceat(np.where(near, fp, np.uint64(2**64 - 1)), starts), size)
        some = np.repeat(np.add.reduceat(near.astype(np.int64), starts) > 0, size)
        keep = some & (fp != centre)
        keep &= np.bitwise_count(fp ^ centre) <= 3
        if keep.any():
            out = np.unique(np.stack([fp[keep], centre[keep]], 1).view(np.int64), axis=0)
    return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})


def fingerprint_links(distinct: DataFrame, rows: int) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within 3 bits. distinct(fp): each one once."""
    blocks = max(LEAST_BLOCKS, rows * 561 // BLOCK)
    # tasks of about DEAL fingerprints while they are few; large inputs get larger tasks, as variants are emitted in steps
    dealt = distinct.select("fp").repartition(max(1, min(-(-rows // DEAL), MOST_DEALS)))
    packed = dealt.mapInArrow(_emit(blocks), "block int, v binary, c binary")
    return packed.groupBy("block").applyInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id.

    component_id is the smallest doc_id reachable over links of fingerprints
    that differ in at most 3 bits. Null and empty texts have fingerprint zero
    and are linked like any other; rows that repeat a doc_id each get a row;
    null ids are carried but never name a component unless all ids of it are
    null. An empty table gives no rows; other columns are not read.
    """
    fps = materialize(with_fingerprints(docs, id_col, text_col, words), "fps")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    found = components(fingerprint_links(groups, groups.count()))
    rooted = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: texts of five-word shingles with a
    Jaccard similarity of at least 0.8, and what is reached over such pairs.

    Fingerprints of five words within 3 bits give candidates by ball hashing, bands of
    minima those that the ball cannot reach, and all are compared exactly (near_copies.py).
    The row of the smallest id stays. Columns stay, whatever their names. Rows are told apart by
    id and text, so each group keeps exactly one row whatever the ids: null ids come
    last, then the text's hash decides; of rows that repeat one stays. Null texts count
    as empty ones, which are one group; an empty table gives no rows.
    """
    from tracewell.llm.near_copies import grouped

    return keep_one(docs, grouped(docs, text_col), id_col, text_col)
