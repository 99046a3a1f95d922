"""Language identification by interpolated Kneser-Ney character models.

One model of character n-grams up to ORDER per language, learned from a bounded
sample of labelled texts, kept as one sorted array of 64-bit n-gram hashes with
a row of log probabilities (and of back-off weights) per hash and a column per
language. Every n-gram that any language knows has its interpolated value under
all of them, so a text costs one binary search per character, and lower orders
are looked up only where no language knows the n-gram. The language of least
cross-entropy per character wins; a text is rejected if that entropy is above
what labelled texts of its length reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import free_names

ORDER = 4
DISCOUNT = 0.75
#: Characters that an unseen character is taken to be one of.
ALPHABET = 4096
UNDETERMINED = "und"
#: Characters of a language's labelled texts that the model is learned from, about.
SAMPLE_CHARS = 1_500_000
#: Parts of the range of texts' hashes.
CELLS = 1_000_003
#: Characters scored at once.
SLICE = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of each text, runs of all else as one space, behind
    ORDER spaces each; and the text's number per character, -1 for those spaces."""
    low = [(t or "").lower() for t in texts]
    x = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    is_letter = letters()[x]
    start = np.ones(len(x), bool)
    start[1:] = doc[1:] != doc[:-1]
    after_letter = np.zeros(len(x), bool)
    after_letter[1:] = is_letter[:-1]
    keep = is_letter | (after_letter & ~start)
    x, doc = np.where(is_letter, x, SPACE)[keep], doc[keep]
    y = np.full(len(x) + ORDER * len(low), SPACE, np.uint64)
    of = np.full(len(y), -1, np.int64)
    at = np.arange(len(x)) + ORDER * (doc + 1)
    y[at], of[at] = x, doc
    return y, of


def hashes(y: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each character; valid from position order - 1 on."""
    h = np.full(len(y), order, np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.empty_like(y)
        shifted[:back], shifted[back:] = 0, y[: len(y) - back]
        h = (h ^ shifted) * MIX
        h ^= h >> np.uint64(29)
    return h


class Estimate:
    """One language's Kneser-Ney estimates: per order, sorted hashes, log p, and log back-off of contexts."""

    def __init__(self, texts: list[str]):
        y, of = normalised(texts)
        at = np.flatnonzero(of >= 0)
        h = {n: hashes(y, n) for n in range(1, ORDER + 1)}
        self.keys, self.logp, self.ctx, self.back = {}, {}, {}, {}
        counts, where = {}, {}
        top, first, c = np.unique(h[ORDER][at], return_index=True, return_counts=True)
        counts[ORDER], where[ORDER] = c.astype(float), at[first]
        self.keys[ORDER] = top
        for n in range(ORDER - 1, 0, -1):  # how many different characters come before
            suffix = h[n][where[n + 1]]
            self.keys[n], first, c = np.unique(suffix, return_index=True, return_counts=True)
            counts[n], where[n] = c.astype(float), where[n + 1][first]
        lower = None
        for n in range(1, ORDER + 1):
            c = counts[n]
            if n == 1:
                total, kinds = c.sum(), len(c)
                self.unseen = np.log(max(DISCOUNT * kinds, 1.0) / max(total, 1.0) / ALPHABET)
                p = np.maximum(c - DISCOUNT, 0) / max(total, 1.0) + np.exp(self.unseen)
            else:
                context = h[n - 1][where[n] - 1]
                self.ctx[n], inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
                total = np.bincount(inverse, c, len(kinds))
                gamma = DISCOUNT * kinds / np.maximum(total, 1.0)
                self.back[n] = np.log(gamma)
                below = lower[np.searchsorted(self.keys[n - 1], h[n - 1][where[n]])]
                p = np.maximum(c - DISCOUNT, 0) / total[inverse] + gamma[inverse] * below
            self.logp[n], lower = np.log(p), p

    def at(self, n: int, keys: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log p of n-grams by their hashes; below: that of their suffixes."""
        out = below.copy()
        if n > 1 and len(self.ctx[n]):
            i = np.minimum(np.searchsorted(self.ctx[n], context), len(self.ctx[n]) - 1)
            out += np.where(self.ctx[n][i] == context, self.back[n][i], 0.0)
        if len(self.keys[n]):
            i = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
            out = np.where(self.keys[n][i] == keys, self.logp[n][i], out)
        return out


class Model:
    """All languages' models in sorted hash arrays."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        parts = {k: Estimate(texts[k]) for k in self.languages}
        self.keys, self.logp, self.ctx, self.back = {}, {}, {}, {}
        grams = {n: [] for n in range(1, ORDER + 1)}
        for k in self.languages:
            y, of = normalised(texts[k])
            at = np.flatnonzero(of >= 0)
            seen = at[np.unique(hashes(y, ORDER)[at], return_index=True)[1]]
            grams[ORDER].append(np.stack([y[seen - back] for back in range(ORDER - 1, -1, -1)], 1))
        # every known n-gram, as characters, so that its suffixes can be hashed
        full = np.concatenate(grams[ORDER]) if self.languages else np.zeros((0, ORDER), np.uint64)
        below_of: dict[int, np.ndarray] = {}
        self.unseen = np.array([parts[k].unseen for k in self.languages])
        for n in range(1, ORDER + 1):
            tail = np.unique(full[:, ORDER - n :], axis=0)
            flat = np.concatenate([np.zeros((len(tail), ORDER), np.uint64), tail], 1)
            h = [hashes(flat.ravel(), m).reshape(flat.shape) for m in (n, max(n - 1, 1))]
            keys, context, suffix = h[0][:, -1], h[1][:, -2], h[1][:, -1]
            values = np.empty((len(tail), len(self.languages)))
            for j, k in enumerate(self.languages):
                low = np.full(len(tail), parts[k].unseen) if n == 1 else below_of[n - 1][np.searchsorted(self.keys[n - 1], suffix), j]
                values[:, j] = parts[k].at(n, keys, context, low)
            order = np.argsort(keys)
            self.keys[n], below_of[n] = keys[order], values[order]
            self.logp[n] = values[order].astype(np.float32)
            if n > 1:
                self.ctx[n] = np.unique(np.concatenate([np.zeros(0, np.uint64), *[parts[k].ctx[n] for k in self.languages]]))
                self.back[n] = np.zeros((len(self.ctx[n]), len(self.languages)), np.float32)
                for j, k in enumerate(self.languages):
                    self.back[n][np.searchsorted(self.ctx[n], parts[k].ctx[n]), j] = parts[k].back[n]
        self.limits: dict[str, tuple[float, float]] = {}

    def _lookup(self, y: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """log p of the character at each of these positions from n-grams of order n down, per language."""
        if n == 0:
            return np.tile(self.unseen.astype(np.float32), (len(at), 1))
        reach = np.stack([y[at - back] for back in range(ORDER - 1, -1, -1)], 1) if n < ORDER else None
        h = hashes(y, n)[at] if reach is None else hashes(np.ascontiguousarray(reach).ravel(), n).reshape(reach.shape)[:, -1]
        keys = self.keys[n]
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[i] == h
        out = self.logp[n][i]
        miss = np.flatnonzero(~known)
        if len(miss):
            low = self._lookup(y, at[miss], n - 1)
            if n > 1:
                window = np.stack([y[at[miss] - back] for back in range(ORDER - 1, 0, -1)], 1)
                c = hashes(np.ascontiguousarray(window).ravel(), n - 1).reshape(window.shape)[:, -1]
                j = np.minimum(np.searchsorted(self.ctx[n], c), len(self.ctx[n]) - 1)
                low = low + np.where((self.ctx[n][j] == c)[:, None], self.back[n][j], 0.0)
            out[miss] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character, per text and language; and each text's letters."""
        if not self.languages:
            return np.zeros((len(texts), 0)), np.zeros(len(texts), np.int64)
        size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        total, chars, alpha = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        first = 0
        while first < len(texts):
            last, n = first + 1, size[first]
            while last < len(texts) and n + size[last] <= SLICE:
                n += size[last]
                last += 1
            y, of = normalised(texts[first:last])
            at = np.flatnonzero(of >= 0)
            for part in np.array_split(at, max(1, len(at) // SLICE)) if len(at) else []:
                lo = part[0] - ORDER
                values = self._lookup(y[lo : part[-1] + 1], part - lo, ORDER)
                d = of[part]
                starts = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1])
                total[first + d[starts]] -= np.add.reduceat(values.astype(np.float64), starts, axis=0)
                chars[first : last] += np.bincount(d, minlength=last - first)
                alpha[first : last] += np.bincount(d, y[part] != SPACE, last - first).astype(np.int64)
            first = last
        return total / np.maximum(chars, 1)[:, None], alpha

    def calibrate(self, texts: dict[str, list[str]], tail: float = 0.001, margin: float = 1.5) -> None:
        """Limits of rejection: mean entropy plus a length-dependent allowance that
        all but a share `tail` of labelled texts keep to, with a margin."""
        for j, k in enumerate(self.languages):
            h, n = self.entropies(texts[k])
            h, n = h[n > 0, j], n[n > 0]
            mean = float(np.average(h, weights=n)) if len(h) else float("inf")
            over = np.sort((h - mean) * np.sqrt(n)) if len(h) else np.zeros(1)
            flat = np.sort(h - mean) if len(h) else np.zeros(1)
            at = min(len(over) - 1, int(np.ceil((1 - tail) * len(over))))
            self.limits[k] = mean + margin * max(0.25, float(flat[at]) / 2), margin * max(4.0, float(over[at]))

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool], np.ndarray]:
        """Language, score from 0 to 1, whether rejected, least entropy."""
        h, n = self.entropies(texts)
        best = h.argmin(1) if len(self.languages) else np.zeros(len(texts), int)
        least = h.min(1) if len(self.languages) else np.zeros(len(texts))
        weight = np.exp(-(h - least[:, None]) * np.minimum(n, 60)[:, None])
        named = (n > 0) & (len(self.languages) > 0)
        language = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named)]
        limit = np.array([self.limits[self.languages[b]] if ok else (0, 0) for b, ok in zip(best, named)]).reshape(-1, 2)
        rejected = ~named | (least > limit[:, 0] + limit[:, 1] / np.sqrt(np.maximum(n, 1)))
        return language, np.where(named, 1 / np.maximum(weight.sum(1), 1e-300), 0.0), list(rejected), least


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text is a multiple of 5. Null ids are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Different labelled texts for learning: of each label those of the least hashes until they
    have `chars` characters, one text at least. Of a longer text its first `chars` count."""
    rows = docs.select(F.substring(F.col(text_col), 1, chars).alias("t"), F.col(label_col).cast("string").alias("l")).where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.withColumn("h", F.xxhash64("t"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.sum(F.length("t")).alias("n")).collect() if r["n"]}
    if not sizes:
        return {}
    cell = F.pmod("h", F.lit(CELLS))

    def below(limits: dict[str, int]) -> DataFrame:
        table = F.create_map(*[x for k, n in limits.items() for x in (F.lit(k), F.lit(n))])
        return rows.where(cell < table[F.col("l")])

    limits = {k: CELLS for k in sizes}
    tried = {k: int(2 * CELLS * chars / n) + 1 for k, n in sizes.items() if n > chars}
    while tried:  # about twice as many as needed at first
        each = below(tried).groupBy("l", "h").agg(F.max(F.length("t")).alias("n"))
        found = each.groupBy("l", cell.alias("cell")).agg(F.sum("n").alias("n")).collect()
        total = dict.fromkeys(tried, 0)
        for r in sorted(found, key=lambda r: r["cell"]):
            k = r["l"]
            if total[k] < chars:
                total[k] += r["n"]
                limits[k] = r["cell"] + 1
        tried = {k: min(4 * n, CELLS) for k, n in tried.items() if total[k] < chars and n < CELLS}
    taken = below(limits).select("l", "t").distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(taken, key=lambda r: (r["l"], r["t"])):
        out.setdefault(r["l"], []).append(r["t"])
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = SAMPLE_CHARS) -> Model:
    """The models of all languages that labelled rows which are not held out have texts with letters of.

    Null texts, labels and ids teach nothing, and copies of a text teach once. No such
    rows: a model of no language.
    """
    texts = {k: v for k, v in sample(docs, id_col, text_col, lang_col, chars).items() if any(map(str.isalpha, "".join(v)))}
    halves = {k: (v[::2], v[1::2] or v) for k, v in texts.items()}
    probe = Model({k: a for k, (a, _) in halves.items()})
    probe.calibrate({k: b for k, (_, b) in halves.items()})
    model = Model(texts)
    model.limits = probe.limits
    return model


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; where docs has a column of
    such a name, the new one's gets an underscore behind (see runtime.free_names).

    Learns from docs' own labels unless a model is given. Null texts and texts
    without a letter are `und`, score 0, rejected; so is everything where no
    label can be learned. Repeated rows are judged each; very long texts are judged
    in slices; an empty table gives no rows; columns stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(docs, id_col, text_col, lang_col))  # one row of floats per n-gram of a bounded sample
    new = free_names(docs, "lang_pred", "lang_score", "lang_rejected")
    names = [*docs.columns, *new]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            language, score, rejected, _ = m.judge(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    schema = docs.withColumns(dict(zip(new, (F.lit(""), F.lit(0.0), F.lit(True))))).schema
    return docs.mapInArrow(run, schema)
