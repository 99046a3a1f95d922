"""Quality by votes of nearest labelled neighbours in a latent-semantic space.

A text becomes counts of hashed byte pairs and of word-repetition terms; log
counts weighted by inverse document frequency are projected on the leading
singular vectors of a bounded sample of labelled texts. How much the repetition
terms weigh beside the pairs is learned too: of WEIGHTS, the one whose votes come closest
to the sample's own labels, each text left out of its vote. The sample's vectors
and labels (at most SAMPLE rows of DIMENSIONS floats) are broadcast, and every
document's cosines with all of them are exact, in blocks; the nearest ones vote
with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.language_id import held_out

#: Labelled texts that are learned from, about; the bound of what is broadcast.
SAMPLE = 3000
PAIRS, REPEATS = 2048, 24
DIMENSIONS = 48
NEIGHBOURS = 31
#: Rows whose cosines are computed at once.
BLOCK = 256
#: What a repetition term may weigh, as much as so many units of a pair's log count.
WEIGHTS = (0.0, 1.0, 2.0, 4.0, 8.0)
CHUNK = 1 << 20


def counts(text: bytes | None) -> np.ndarray:
    """Counts of byte pairs over the whole text, and how repetitive its words are."""
    text = text or b""
    out = np.zeros(PAIRS + REPEATS, np.float32)
    x = np.frombuffer(text, np.uint8)
    for at in range(0, len(x) - 1, CHUNK):
        p = x[at : at + CHUNK + 1].astype(np.uint32)
        code = ((p[:-1] * 256 + p[1:]) * np.uint32(2654435761)) >> np.uint32(21)
        out[:PAIRS] += np.bincount(code, minlength=PAIRS)
    w = text.split()
    if len(w) > 1:
        same = sum(map(bytes.__eq__, w, w[1:])) / (len(w) - 1)
        few = 1 - min(1.0, len(set(w)) / min(len(w), 50 + len(w) ** 0.8))
        marks = sum(len(x) == 1 and not x.isalnum() for x in w) / len(w)
        for k, v in enumerate((same, few, marks)):
            out[PAIRS + 8 * k : PAIRS + 8 * k + min(8, int(v**0.5 * 10))] = 1
    return out


def packed(text: bytes | None) -> bytes:
    """The counts that are not zero, with their places."""
    x = counts(text)
    at = np.flatnonzero(x)
    return at.astype(np.float32).tobytes() + x[at].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    both = np.frombuffer(data, np.float32).reshape(2, -1)
    x = np.zeros(PAIRS + REPEATS, np.float32)
    x[both[0].astype(np.int64)] = both[1]
    return x


class Space:
    """Inverse document frequencies and the leading singular vectors of labelled texts' counts."""

    def __init__(self, x: np.ndarray, labels: list[float], dimensions: int = DIMENSIONS, weights: tuple = WEIGHTS):
        x = np.asarray(x, np.float32).reshape(-1, PAIRS + REPEATS)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        self.labels = np.asarray(labels, np.float32)
        self.base = float(self.labels.mean()) if len(x) else 0.5
        best = None
        for weight in weights:
            self._project(x, weight, dimensions)
            cos = self.vectors @ self.vectors.T
            np.fill_diagonal(cos, -1)
            loss = float(((self._votes(cos, min(NEIGHBOURS, max(1, len(x) - 1))) - self.labels) ** 2).mean()) if len(x) > 1 else 0.0
            if best is None or loss < best[0]:
                best = (loss, weight, self.axes, self.vectors)
        self.loss, self.weight, self.axes, self.vectors = best

    def _project(self, x: np.ndarray, weight: float, dimensions: int, seed: int = 7) -> None:
        self.weight = weight
        x = self.weighted(x)
        rng = np.random.default_rng(seed)
        k = min(dimensions, *x.shape) if len(x) else 0
        basis = x.T @ rng.standard_normal((len(x), k + 16 if k else 0)).astype(np.float32)
        for _ in range(3):
            basis, _ = np.linalg.qr(basis) if k else (basis, None)
            basis = x.T @ (x @ basis)
        q, _ = np.linalg.qr(basis) if k else (basis, None)
        if k:
            _, _, v = np.linalg.svd(x @ q, full_matrices=False)
            q = q @ v[:k].T
        self.axes = q.astype(np.float32)
        self.vectors = self.unit(x @ self.axes)

    def weighted(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(np.arange(PAIRS + REPEATS) < PAIRS, 1, self.weight).astype(np.float32)
        return self.unit(np.log1p(x) * self.idf * scale)

    def _votes(self, cos: np.ndarray, k: int) -> np.ndarray:
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0) ** 4
        total = weight.sum(1)
        votes = (weight * self.labels[near]).sum(1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.base)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1)

    def scores(self, texts: list[bytes | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the neighbours' weighted votes, from 0 to 1."""
        out = np.full(len(texts), self.base)
        k = min(neighbours, len(self.vectors))
        for at in range(0, len(texts), BLOCK) if k else []:
            part = texts[at : at + BLOCK]
            out[at : at + BLOCK] = self._votes(self.unit(self.weighted(np.stack([counts(t) for t in part])) @ self.axes) @ self.vectors.T, k)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Space:
    """The space of about `sample` labelled texts, none of them held out.

    Labels are chosen first, by a hash of their id, so that documents are read
    once and joined with that bounded table; what comes to the driver is a row of counts
    for each chosen id, however long its text. A document labelled several times
    counts by its least label, an id of several texts by one of them; null texts count as empty
    ones, null ids and labels for nothing. Without labels the space is empty.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("double").alias("__label"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.col("__id"), F.lit(5)), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([packed(t.as_py()) for t in b.column(3)], pa.binary())], names=["id", "label", "h", "x"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t")).join(F.broadcast(chosen), "__id")  # `sample` rows, about
    rows = rows.select("__id", "__label", "h", "t").mapInArrow(run, "id long, label double, h long, x binary")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("label", "x"), "h").alias("r")).select("id", "r.*").collect()
    rows = sorted(rows, key=lambda r: r["id"])
    return Space(np.stack([unpacked(bytes(r["x"])) for r in rows]) if rows else np.zeros((0, PAIRS + REPEATS)), [r["label"] for r in rows])


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; labels and ids are no inputs.

    Null and empty texts, and all texts where nothing was learned, score the
    share of label 1 among the labelled ones. Repeated rows are scored each;
    an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)  # SAMPLE x DIMENSIONS floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double")
