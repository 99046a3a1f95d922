"""Masked pseudo-likelihood: every token predicted from the words on both sides.

Tokens are lower-cased words. The corpus is tokenised once: a chunk of about
CHUNK tokens keeps the 64-bit hashes of its different words and each token's place
among them, so that all later steps work on different words and arrays. Words are
known by these hashes. The WORDS most frequent words of the corpus, and BUCKETS
classes of all others by hash, are what a network predicts: it sums one embedding per place
of the window (two words on each side), applies tanh, and predicts the token in
two softmax steps, its group and its place in the group; biases begin at the
corpus's log counts. It is trained in numpy by rounds of averaging: documents are
dealt by hash to copies of about COPY tokens, every copy is fitted on every place
of its documents in the order of their hashes, and the copies are averaged in a
tree of partial sums by pieces of the parameters. So a round takes each token of
the corpus once, and its steps do not depend on how the rows are partitioned.
Scoring takes every token; a document's score is the sum of its tokens'
conditional log probabilities.

The network predicts a class, and a word of a class has its share of the class:
log p(word | class) comes from the full table of word counts, met by the hashes, with
DISCOUNT of a count taken from each word for those the corpus does not hold. So
the model's words grow with the corpus; the network's size stays.

What is gathered from the corpus, word counts and the copies' fits, grows
with the corpus; what reaches the driver is the vocabulary and one model.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import materialize, release

GROUPS, PLACES = 64, 64
BUCKETS = 256
WORDS = GROUPS * PLACES - BUCKETS
#: Of each rare word's count, what its class keeps for unseen words; and how many of these there are for each seen one.
DISCOUNT, UNSEEN = 0.5, 10
WINDOW = (-2, -1, 1, 2)
HIDDEN = 16
RATE = 0.4
BATCH = 16384
#: Tokens of a chunk, about, and characters of a text that are split at once.
CHUNK, CUT = 1_000_000, 1 << 20
#: Tokens of a copy of the network, about, and tokens of a document dealt at once.
COPY, PIECE = 2_000_000, 16384
#: Tokens scored at once.
SLICE = 32768
EDGE = GROUPS * PLACES
#: Parameters are averaged in so many pieces, so many copies at a time.
PIECES, FAN = 16, 32
#: Different words of chunks that one task counts, about, and the fewest of such tasks.
PARCEL, LEAST_PARCELS = 1_500_000, 96
SEED = 42
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def words_of(text: str | None, cut: int = CUT) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, by pieces of about `cut` characters that end with a word."""
    low, at = (text or "").lower(), 0
    while at < len(low):
        m = _BLANK.search(low, at + cut)
        end = m.start() if m else len(low)
        yield low[at:end].encode("utf-8", "replace").split()
        at = end


def hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))


_TOKENS = pa.schema([("ids", pa.list_(pa.int64())), ("at", pa.binary()), ("n", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    def packed() -> pa.RecordBatch:
        place = np.concatenate([np.zeros(0, np.uint32), *parts])
        seen = np.bincount(place, minlength=len(index)).astype(np.uint32)
        own = [hashes(index).tobytes(), seen.tobytes(), place.astype(np.uint16).tobytes(), (place >> 16).astype(np.uint16).tobytes()]
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (np.array(at, np.int64).tobytes(), np.array(n, np.int64).tobytes(), *own)]], schema=_TOKENS)

    ids, at, n, parts, index, held = [], [], [], [], defaultdict(count().__next__), 0
    for b in batches:
        for number, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            own = [np.fromiter(map(index.__getitem__, w), np.uint32, len(w)) for w in words_of(text.as_py())]
            size = sum(map(len, own))
            ids.append(number)
            at.append(mark)
            n.append(size)
            parts += own
            held += size
            if held >= chunk:
                yield packed()
                ids, at, n, parts, index, held = [], [], [], [], defaultdict(count().__next__), 0
    if ids:
        yield packed()


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens of whole texts in chunks, as a written table; null texts have none.

    chunk; of each row its id, its mark (a hash of id and text) and its number of tokens
    (ids, at, n); the chunk's different words by hash, with counts (words, counts); and
    the place among them of each token, in order (low and high 16 bits).
    """
    t = F.col(text_col).cast("string")
    number = F.col(id_col).cast("long") if id_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(number.alias("id"), F.xxhash64(number, t).alias("at"), t.alias("t"))
    chunk = CHUNK
    out = rows.mapInArrow(lambda batches: _chunks(batches, chunk), "ids array<long>, at binary, n binary, words binary, counts binary, low binary, high binary")
    # a written row keeps its number
    return materialize(out.withColumn("chunk", F.monotonically_increasing_id()), "tokens")


def _places(row: dict) -> np.ndarray:
    return np.frombuffer(row["low"], np.uint16) | np.frombuffer(row["high"], np.uint16).astype(np.uint32) << 16


def _parcels(tokens: DataFrame, parcels: int, known: np.ndarray | None = None) -> DataFrame:
    """(parcel, chunk, words, counts, at): each chunk's different words but the known ones, dealt by hash; at: their places in the chunk."""
    shared = None if known is None else tokens.sparkSession.sparkContext.broadcast(known)  # WORDS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, c = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.uint32)
                at = np.arange(len(h), dtype=np.uint32)
                if shared is not None:
                    at = at[~np.isin(h, shared.value)]
                to = (h[at] >> np.uint64(32)) % np.uint64(parcels)
                order = np.argsort(to, kind="stable")
                at, to = at[order], to[order]
                starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
                ends = np.append(starts[1:], len(to))
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())
                yield pa.record_batch([pa.array(to[starts].astype(np.int32)), pa.array([r["chunk"]] * len(starts), pa.int64()), cut(h[at]), cut(c[at]), cut(at)], names=["parcel", "chunk", "words", "counts", "at"])

    return tokens.select("chunk", "words", "counts").mapInArrow(run, "parcel int, chunk long, words binary, counts binary, at binary")


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _summed(table: pa.Table) -> pa.Table:
    h, at = np.unique(_joined(table, "words", np.uint64), return_inverse=True)
    n = np.bincount(at, _joined(table, "counts", np.uint32), len(h)).astype(np.int64)
    return pa.table({"parcel": table.column("parcel")[:1], "words": pa.array([h.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})


def _entries(counts: DataFrame, body, schema: str, names: list[str]) -> DataFrame:
    """body(hashes, counts) of each parcel, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.record_batch([pa.array(x) for x in body(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["n"], np.int64))], names=names)

    return counts.select("words", "n").mapInArrow(run, schema)


def _size(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * 8).astype(np.int64)


class Vocabulary:
    """The most frequent words, the counts of all classes, and the counts of all words as a table."""

    #: (parcel, words, n): all words of the corpus by hash, packed; the number of parcels.
    table: DataFrame | None = None

    def __init__(self, words: np.ndarray, n: np.ndarray, kinds: np.ndarray, parcels: int = 1):
        self.parcels, self.n, self.kinds = parcels, n, kinds
        self.order = np.argsort(words).astype(np.uint16)
        self.sorted = words[self.order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def classes(self, h: np.ndarray) -> np.ndarray:
        out = (WORDS + (h >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.uint16)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == h, self.order[at], out)
        return out

    def within(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log p(word | class) of words that are no class of their own, seen n times in the corpus."""
        b = ((h >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.int64)
        size = self.n[WORDS:]
        new = np.log(np.where(size > 0, DISCOUNT * self.kinds / np.maximum(size, 1), 1.0) / (UNSEEN * (self.kinds + 1)))
        return np.where(n > 0, np.log(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(size, 1)[b]), new[b])


def vocabulary(tokens: DataFrame) -> Vocabulary:
    """The WORDS most frequent words of tokenised documents (ties by hash), with the counts of all."""
    words = tokens.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parcels = max(LEAST_PARCELS, words // (8 * PARCEL))
    table = materialize(_parcels(tokens, parcels).select("parcel", "words", "counts").groupBy("parcel").applyInArrow(_summed, "parcel int, words binary, n binary"), "words")
    # sizes of counts first, so that few words are sorted
    left, least = WORDS, 0
    sizes = _entries(table, lambda h, n: np.unique(_size(n), return_counts=True), "size long, words long", ["size", "words"])
    for r in sorted(sizes.groupBy("size").agg(F.sum("words").alias("words")).collect(), key=lambda r: -r["size"]):
        if left <= 0:
            break
        left, least = left - r["words"], r["size"]

    def largest(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(_size(n) >= least)
        at = at[np.lexsort((h[at].view(np.int64), -n[at]))[:WORDS]]
        return h[at].view(np.int64), n[at]

    top = _entries(table, largest, "h long, n long", ["h", "n"]).orderBy(F.desc("n"), "h").limit(WORDS).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    n, kinds = np.zeros(EDGE), np.zeros(BUCKETS)
    n[: len(top)] = [r["n"] for r in top]
    out = Vocabulary(h, n, kinds, parcels)

    def rest(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        c = out.classes(h).astype(np.int64) - WORDS
        n, c = n[c >= 0], c[c >= 0]
        return np.arange(BUCKETS), np.bincount(c, n, BUCKETS).astype(np.int64), np.bincount(c, minlength=BUCKETS)

    for r in _entries(table, rest, "b long, n long, kinds long", ["b", "n", "kinds"]).groupBy("b").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[WORDS + r["b"]], kinds[r["b"]] = r["n"], r["kinds"]
    out.table = table
    return out


class Network:
    def __init__(self, vocabulary: Vocabulary, seed: int = 3):
        self.vocabulary = vocabulary
        counts = vocabulary.n
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((len(WINDOW), EDGE + 1, HIDDEN)) * 0.1).astype(np.float32)
        self.group = (rng.standard_normal((GROUPS, HIDDEN)) * 0.1).astype(np.float32)
        self.place = (rng.standard_normal((GROUPS, PLACES, HIDDEN)) * 0.1).astype(np.float32)
        c = counts.reshape(GROUPS, PLACES) + 0.5
        self.group_bias = np.log(c.sum(1) / c.sum()).astype(np.float32)
        self.place_bias = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.group, self.place, self.group_bias, self.place_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def tokens(self, text: str | None) -> np.ndarray:
        """The classes of a text's words."""
        return self.vocabulary.classes(hashes([w for part in words_of(text) for w in part]))

    def _forward(self, context: np.ndarray) -> np.ndarray:
        z = self.embed[0][context[:, 0]]
        for j in range(1, len(WINDOW)):
            z = z + self.embed[j][context[:, j]]
        return np.tanh(z)

    def _bounded(self) -> bool:
        """Whether no logit can leave the range of float32's exp, as |h| <= 1."""
        return all(np.abs(w).sum(-1).max() + np.abs(b).max() < 60 for w, b in ((self.group, self.group_bias), (self.place, self.place_bias)))

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self._forward(context)
        g, p = (target // PLACES).astype(np.uint8), target % PLACES
        small = self._bounded()
        x = h @ self.group.T + self.group_bias
        if not small:
            x -= x.max(1, keepdims=True)
        out = x[np.arange(len(target)), g]
        out -= np.log(np.exp(x, out=x).sum(1))
        order = np.argsort(g, kind="stable")
        cuts = np.searchsorted(g[order], np.arange(GROUPS + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[k] : cuts[k + 1]]
            x = h[at] @ self.place[k].T + self.place_bias[k]
            if not small:
                x -= x.max(1, keepdims=True)
            own = x[np.arange(len(at)), p[at]]
            out[at] += own - np.log(np.exp(x, out=x).sum(1))
        return out

    def _descend(self, parameter: int, rows, total: np.ndarray, count, rate: float) -> None:
        """Adaptive step: each weight by its summed gradient over the root of all it had so far."""
        if not hasattr(self, "seen"):
            self.seen = [np.ones_like(p) for p in self.parameters()]
        g = (total / np.sqrt(count)).astype(np.float32)
        seen = self.seen[parameter]
        now = seen[rows] + g * g
        seen[rows] = now
        g *= np.float32(-rate)
        g /= np.sqrt(now, out=now)
        self.parameters()[parameter][rows] += g

    @staticmethod
    def _shares(x: np.ndarray, small: bool) -> np.ndarray:
        """Softmax in place; small: no logit can leave the range of exp."""
        if not small:
            x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One descent step on the mean loss of these places, per embedding row by its own share."""
        n, small = len(target), self._bounded()
        order = np.argsort(target.astype(np.uint16), kind="stable")
        context, target = context[order], target[order]
        h = self._forward(context)
        g, p = target // PLACES, target % PLACES
        q = self._shares(h @ self.group.T + self.group_bias, small)
        q[np.arange(n), g] -= 1
        back = q @ self.group
        group_step, group_bias_step = q.T @ h, q.sum(0)
        cuts = np.searchsorted(g, np.arange(GROUPS + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[k], cuts[k + 1])
            q = self._shares(h[own] @ self.place[k].T + self.place_bias[k], small)
            q[np.arange(len(q)), p[own]] -= 1
            back[own] += q @ self.place[k]
            self._descend(2, k, q.T @ h[own], len(q), rate)
            self._descend(4, k, q.sum(0), len(q), rate)
        self._descend(1, slice(None), group_step, n, rate)
        self._descend(3, slice(None), group_bias_step, n, rate)
        back *= 1 - h * h
        for j in range(len(WINDOW)):
            order = np.argsort(context[:, j].astype(np.uint16), kind="stable")
            ids = context[order, j]
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            size = np.diff(np.append(starts, n))[:, None]
            self._descend(0, (j, ids[starts]), np.add.reduceat(back[order], starts, axis=0), size, rate)

    def train(self, pieces: list[bytes], rate: float = RATE) -> int:
        """Fits every place of these pieces: tokens with two of their surroundings before and after."""
        each = [np.frombuffer(p, np.uint16) for p in pieces]
        n = np.fromiter(map(len, each), np.int64, len(each))
        y = np.concatenate([np.zeros(0, np.uint16), *each]).astype(np.int64)
        at = np.arange(int((n - 4).sum())) + np.repeat(4 * np.arange(len(each)) + 2, n - 4)
        for s in range(0, len(at), BATCH):
            part = at[s : s + BATCH]
            self.step(np.stack([y[part + j] for j in WINDOW], 1), y[part], rate)
        return len(at)

    def scores(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Summed conditional log probabilities of texts of n tokens each, of these classes."""
        # two edges before each text and after the last
        of = np.repeat(np.arange(len(n)), n)
        y = np.full(len(classes) + 2 * len(n) + 2, EDGE)
        at = np.arange(len(of)) + 2 * (of + 1)
        y[at] = classes
        total = np.zeros(len(n))
        for s in range(0, len(at), SLICE):
            part = at[s : s + SLICE]
            lp = self.log_probability(np.stack([y[part + j] for j in WINDOW], 1), y[part])
            total += np.bincount(of[s : s + SLICE], lp.astype(np.float64), len(n))
        return total


def _average(table: pa.Table) -> pa.Table:
    n = np.asarray(table.column("n"), np.float64)
    flat = sum(w * np.frombuffer(b, np.float32).astype(np.float64) for w, b in zip(n, table.column("data").to_pylist())) / max(n.sum(), 1.0)
    return pa.table({"piece": table.column("piece")[:1], "copy": pa.array([table.column("copy")[0].as_py() // FAN]), "n": pa.array([float(n.sum())]), "data": pa.array([flat.astype(np.float32).tobytes()], pa.binary())})


def dealt(tokens: DataFrame, words: Vocabulary, copies: int) -> DataFrame:
    """(copy, at, part, ids): all documents' classes by PIECE, with two more on each side; at, part: their order."""
    shared = tokens.sparkSession.sparkContext.broadcast(words)  # fixed size: see WORDS, BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.full(2, EDGE, np.uint16)
        for b in batches:
            for r in b.to_pylist():
                y = shared.value.classes(np.frombuffer(r["words"], np.uint64))[_places(r)]
                n = np.frombuffer(r["n"], np.int64)
                rows = []
                for at, own in zip(np.frombuffer(r["at"], np.int64).tolist(), np.split(y, np.cumsum(n)[:-1])):
                    own = np.concatenate([edge, own, edge])
                    for part in range(-(-(len(own) - 4) // PIECE)):
                        rows.append(((at + part) % copies, at, part, own[part * PIECE : (part + 1) * PIECE + 4].tobytes()))
                copy, at, part, data = zip(*rows) if rows else ((),) * 4
                yield pa.record_batch([pa.array(copy, pa.int64()), pa.array(at, pa.int64()), pa.array(part, pa.int64()), pa.array(data, pa.binary())], names=["copy", "at", "part", "ids"])

    return tokens.select("at", "n", "words", "low", "high").mapInArrow(run, "copy long, at long, part long, ids binary")


def learn(tokens: DataFrame, rounds: int = 1) -> Network:
    """The network of tokenised documents: every token is counted, and fitted once a round.

    No documents, or none with a word, give a network without words. Rows that
    repeat are counted and fitted each.
    """
    spark = tokens.sparkSession
    model = Network(vocabulary(tokens))
    parts = max(1, round(model.vocabulary.n.sum() / COPY))
    pieces = dealt(tokens, model.vocabulary, parts)
    pieces = materialize(pieces, "pieces") if rounds > 1 else pieces
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # fixed size: see GROUPS, PLACES, HIDDEN

        def fit(table: pa.Table) -> pa.Table:
            own = Network.__new__(Network)
            own.__dict__.update({k: v.copy() for k, v in shared.value.__dict__.items() if k not in ("seen", "vocabulary")})
            n = own.train(table.sort_by([("at", "ascending"), ("part", "ascending")]).column("ids").to_pylist())
            flat = np.array_split(own.flat(), PIECES)
            copy = table.column("copy")[0].as_py()
            return pa.table({"piece": pa.array(range(PIECES), pa.int32()), "copy": pa.array([copy] * PIECES, pa.int64()), "n": pa.array([float(n)] * PIECES), "data": pa.array([p.tobytes() for p in flat], pa.binary())})

        copies = pieces.repartition(parts, "copy").groupBy("copy").applyInArrow(fit, "piece int, copy long, n double, data binary")
        left = parts
        while True:
            copies = copies.withColumn("to", F.floor(F.col("copy") / FAN)).groupBy("piece", "to").applyInArrow(_average, "piece int, copy long, n double, data binary")
            left = -(-left // FAN)
            if left <= 1:
                break
        got = sorted(copies.collect(), key=lambda r: r["piece"])
        if got:
            model.load(np.concatenate([np.frombuffer(r["data"], np.float32) for r in got]))
    release(pieces)
    return model


def _within(words: Vocabulary):
    """Of a parcel's words that chunks ask for, log p(word | class)."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        h = _joined(asked, "words", np.uint64)
        kinds, n = _joined(known, "words", np.uint64), _joined(known, "n", np.int64)
        seen = np.zeros(len(h), np.int64)
        if len(kinds):
            at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
            seen = np.where(kinds[at] == h, n[at], 0)
        lp = words.within(h, seen).astype(np.float32)
        ends = np.cumsum([len(x) // 8 for x in asked.column("words").to_pylist()])
        cut = lambda x: pa.array([y.tobytes() for y in np.split(x, ends[:-1])] if len(ends) else [], pa.binary())
        return pa.table({"chunk": asked.column("chunk"), "at": asked.column("at"), "lp": cut(lp), "once": cut((seen == 1).astype(np.uint8))})

    return run


def _scored(chunk: pa.Table, rare: pa.Table) -> pa.Table:
    out: dict[str, list] = {"doc_id": [], "n_tokens": [], "pll": [], "perplexity": [], "n_once": []}
    for r in chunk.to_pylist():
        n, total = np.frombuffer(r["n"], np.int64), np.frombuffer(r["total"], np.float64)
        lp, once, at = np.zeros(r["words"]), np.zeros(r["words"]), _joined(rare, "at", np.uint32)
        lp[at], once[at] = _joined(rare, "lp", np.float32), _joined(rare, "once", np.uint8)
        of, place = np.repeat(np.arange(len(n)), np.frombuffer(r["others"], np.int64)), _places(r)
        total = total + np.bincount(of, lp[place], len(n))
        out["n_once"] += np.bincount(of, once[place], len(n)).astype(np.int64).tolist()
        out["doc_id"] += r["ids"]
        out["n_tokens"] += n.tolist()
        out["pll"] += total.tolist()
        out["perplexity"] += [float(np.exp(min(-t / k, 700.0))) if k else None for t, k in zip(total, n)]
    return pa.table({k: pa.array(v, pa.int64() if k in ("doc_id", "n_tokens", "n_once") else pa.float64()) for k, v in out.items()})


def score(tokens: DataFrame, model: Network) -> DataFrame:
    """(doc_id, n_tokens, pll, perplexity, n_once): pll is the summed log probability (nats) of
    every token of the whole text given its window, words outside the network's
    vocabulary by class and share of the class; perplexity is exp(-pll / n_tokens);
    n_once counts the tokens whose word the corpus holds once: few of them are evidence.

    tokens: tokenised documents, of the corpus or others. Null and empty texts have
    no tokens, pll 0 and a null perplexity. Repeated rows are scored each; an empty
    table gives no rows; other columns are not read.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)  # fixed size: see GROUPS, PLACES, HIDDEN
    words = model.vocabulary
    names = ["chunk", "ids", "n", "total", "words", "others", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                place, n = _places(r), np.frombuffer(r["n"], np.int64)
                c = shared.value.vocabulary.classes(np.frombuffer(r["words"], np.uint64))
                own = c[place]
                total, rare = shared.value.scores(own, n), own >= WORDS
                others = np.bincount(np.repeat(np.arange(len(n)), n)[rare], minlength=len(n)).astype(np.int64)
                some = place[rare]
                data = [total.tobytes(), others.tobytes(), some.astype(np.uint16).tobytes(), (some >> 16).astype(np.uint16).tobytes()]
                total, others, low, high = (pa.array([x], pa.binary()) for x in data)
                yield pa.record_batch([pa.array([r["chunk"]]), pa.array([r["ids"]], pa.list_(pa.int64())), pa.array([r["n"]], pa.binary()), total, pa.array([len(c)]), others, low, high], names=names)

    classes = tokens.select("chunk", "ids", "n", "words", "low", "high").mapInArrow(run, "chunk long, ids array<long>, n binary, total binary, words long, others binary, low binary, high binary")
    known = words.table if words.table is not None else tokens.select(F.lit(0).alias("parcel"), "words", F.col("counts").alias("n")).where("false")
    asked = _parcels(tokens, words.parcels, words.sorted).select("parcel", "chunk", "words", "at")
    rare = asked.groupBy("parcel").cogroup(known.groupBy("parcel")).applyInArrow(_within(words), "chunk long, at binary, lp binary, once binary")
    return classes.groupBy("chunk").cogroup(rare.groupBy("chunk")).applyInArrow(_scored, "doc_id long, n_tokens long, pll double, perplexity double, n_once long")
