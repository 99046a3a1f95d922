"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are packed in blocks; each block of queries meets each block of
candidates. Both are turned to the block's principal axes, which keeps products
and puts the variance first, and cut in segments: at level s the first s axes are
a segment each and the rest are two. Means m and deviations d of the segments
bound the product from above,

    q . x <= sum over segments of length * (m_q m_x + d_q d_x),

which is the lower bound |q|^2 + |x|^2 - 2 q . x of the squared distance. A first
meeting computes one level's bounds for all candidates and the exact scores of each
block's k best bounded rows; the k-th best of those over all blocks is a score that
each query reaches. The second meeting leaves out what is bounded below it, coarse
to fine, and computes exact integer scores for the survivors. Each pair of blocks
returns at most k rows a query, and these merge by partial top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import materialize

#: Axes with a segment of their own, per level; the first meeting uses SCOUT.
LEVELS = (12, 32, 48)
SCOUT = 32
#: Vectors in a block, about, and queries whose bounds are held at once.
QUERY_BLOCK, ROW_BLOCK, SLICE = 4096, 8192, 512
#: Bounds are floating-point sums; what lies this much below is not discarded.
SLACK = 1e-6
#: Share of rows left from which all are computed at once.
DENSE = 0.2


def axes(x: np.ndarray) -> np.ndarray:
    """The principal axes of the rows, those of most variance first."""
    _, v = np.linalg.eigh(x.T @ x)
    return v[:, ::-1]


def statistics(x: np.ndarray, level: int) -> np.ndarray:
    """Per segment, the mean and the deviation, both times the root of its length."""
    d = x.shape[1]
    cuts = np.unique([*range(min(level, d)), min(level, d - 1), (min(level, d - 1) + d) // 2])
    n = np.diff(np.append(cuts, d))
    mean = np.add.reduceat(x, cuts, axis=1) / n
    square = np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, cuts, axis=1)
    return np.concatenate([mean * np.sqrt(n), np.sqrt(square[:, n > 1])], 1)


def _slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return SLACK * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0.0))


def scout(qrow: np.ndarray, q: np.ndarray, row: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query's row, score): exact scores of the k rows with the best bounds, for each query."""
    turn = axes(x)
    qs, xs = statistics(q @ turn, SCOUT), statistics(x @ turn, SCOUT)
    of, out = [], []
    for at in range(0, len(q), SLICE):
        bound = qs[at : at + SLICE] @ xs.T
        bound[qrow[at : at + SLICE, None] == row[None, :]] = -np.inf
        some = np.argpartition(-bound, min(k, len(row)) - 1, axis=1)[:, :k]
        score = np.einsum("ijk,ik->ij", x[some], q[at : at + SLICE])
        good = np.isfinite(np.take_along_axis(bound, some, 1))
        of.append(np.repeat(qrow[at : at + SLICE], good.sum(1)))
        out.append(score[good])
    return np.concatenate(of), np.concatenate(out)


def search(qrow: np.ndarray, q: np.ndarray, reach: np.ndarray, row: np.ndarray, rid: np.ndarray, x: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """[query's place, row's id, score] of each query's k best rows other than itself that
    score `reach` at least; and how many pairs each level and the exact scores were computed for."""
    turn = axes(x)
    tq, tx = q @ turn, x @ turn
    levels = [(statistics(tq, s), statistics(tx, s)) for s in LEVELS if s < q.shape[1]]
    least, counted = reach - _slack(q, x), np.zeros(len(levels) + 1, np.int64)
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(q), SLICE):
        part = slice(at, at + SLICE)
        left = qrow[part, None] != row[None, :]
        for i, (qs, xs) in enumerate([*levels, (q, x)]):
            counted[i] += left.sum()
            score = None
            if left.mean() > DENSE:
                score = qs[part] @ xs.T
                left &= score >= least[part, None]
                continue
            for j in np.flatnonzero(left.any(1)):
                some = np.flatnonzero(left[j])
                left[j, some] = xs[some] @ qs[at + j] >= least[at + j]
        for j in np.flatnonzero(left.any(1)):
            some = np.flatnonzero(left[j])
            own = score[j, some] if score is not None else x[some] @ q[at + j]
            order = np.lexsort((rid[some], -own))[:k]
            for o, values in zip(out, (np.full(len(order), at + j), rid[some][order], own[order].astype(np.int64))):
                o.append(values)
    return [np.concatenate([np.zeros(0, np.int64), *o]) for o in out], counted


_PACKED = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("reach", pa.binary()), ("data", pa.binary())])


def _pack(table: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(table.column("row")), kind="stable")
    pick = lambda c, kind: [np.asarray(table.column(c), kind)[order].tobytes()]
    data = np.array(table.column("x").to_pylist(), np.float64)[order]
    return pa.table({"d": table.column("d")[:1], "block": table.column("block")[:1], "rows": pick("row", np.int64), "ids": pick("id", np.int64), "reach": pick("reach", np.float64), "data": [data.tobytes()]}, schema=_PACKED)


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(d, block, rows, ids, reach, data): rows(row, id, reach, x) of length d, packed per block."""
    keyed = rows.select(F.size("x").alias("d"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "id", "reach", "x")
    return keyed.groupBy("d", "block").applyInArrow(_pack, "d int, block int, rows binary, ids binary, reach binary, data binary")


def _pairs(queries: DataFrame, rows: DataFrame, q_blocks: int, r_blocks: int) -> DataFrame:
    """Each block of queries with each block of rows of its length."""
    q = _packed(queries, q_blocks).select("d", F.col("block").alias("qb"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), "reach", F.col("data").alias("q_data"))
    r = _packed(rows, r_blocks).select("d", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), "rows", "ids", "data")
    tasks = min(q_blocks * r_blocks, 16 * queries.sparkSession.sparkContext.defaultParallelism)
    return r.join(q.hint("shuffle_hash"), ["d", "qb"]).select("q_rows", "q_ids", "reach", "q_data", "rows", "ids", "data").repartition(tasks)


def _arrays(row: dict) -> dict[str, np.ndarray]:
    kinds = {"q_rows": np.int64, "q_ids": np.int64, "rows": np.int64, "ids": np.int64}
    out = {k: np.frombuffer(v, kinds.get(k, np.float64)) for k, v in row.items()}
    return out | {"q_data": out["q_data"].reshape(len(out["q_rows"]), -1), "data": out["data"].reshape(len(out["rows"]), -1)}


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest integer inner product.

    Components become floor(scale * component). is_query: a condition on id_col.
    Candidates are all rows of the query's length but the query's own row; ties go
    to the smaller id; fewer than k rows if there are fewer candidates. Rows that
    repeat an id are candidates, and queries, of their own. Vectors that are null,
    empty, or hold null or non-finite components take no part, nor do null ids. An
    empty table gives no rows; other columns are not read. Scores are exact while
    they are below 2**53.
    """
    x = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    rows = vectors.where(good & F.col(id_col).isNotNull()).select(F.coalesce(F.expr(is_query) if isinstance(is_query, str) else is_query, F.lit(False)).alias("asks"), F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))
    # a written row keeps its number
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = max(1, rows.count())
    rows = rows.withColumn("reach", F.lit(float("-inf")))
    queries = rows.where("asks")
    q_blocks, r_blocks = -(-n // (20 * QUERY_BLOCK)), max(-(-n // ROW_BLOCK), min(12, -(-n // 512)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.to_pylist():
                a = _arrays(one)
                yield pa.record_batch([pa.array(f) for f in scout(a["q_rows"], a["q_data"], a["rows"], a["data"], k)], names=["row", "reach"])

    known = _pairs(queries, rows, q_blocks, r_blocks).mapInArrow(first, "row long, reach double")
    known = known.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("reach")))).where(F.col("rank") == k)
    able = queries.drop("reach").join(known.select("row", "reach"), "row", "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.to_pylist():
                a = _arrays(one)
                (at, ids, score), _ = search(a["q_rows"], a["q_data"], a["reach"], a["rows"], a["ids"], a["data"], k)
                yield pa.record_batch([pa.array(f) for f in (a["q_rows"][at], a["q_ids"][at], ids, score)], names=["row", "query_id", "vec_id", "score"])

    part = _pairs(able, rows, q_blocks, r_blocks).mapInArrow(second, "row long, query_id long, vec_id long, score long")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
