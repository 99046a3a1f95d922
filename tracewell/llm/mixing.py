"""Mixing sources to target weights through a splitting tree of block quotas.

Every source's documents are put in a permuted order by a hash of their id and
cut in blocks along it. A source's target is met by whole passes over its
blocks and one part of a pass: the blocks, and in the last one the documents,
that come first in the permuted order while they fit; what is then left of the
quota is filled with the largest documents that fit. While more documents fit, the
rest is gone through again in the permuted order, without those that are too
large, and the largest one that fits is added: each such round halves what is left. The exact block quotas are
divided among the output shards by a tree: each node splits its shards in two
and draws the left half's blocks from the sources by a multivariate
hypergeometric distribution. A shard's blocks of a source are the next ones in
the permuted order, so shards are disjoint. The leaves become a table of blocks with
their shards; a document is taken for each draw of its block, and in the part of a
pass if it is among the documents that fit. Each shard is shuffled by itself.

Only per-source totals and cut points (a row a source) come to the driver, and from
there the tree's leaves (a row a source and shard); everything else is a table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.runtime import free_names, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
SHARDS = 64
#: Words of a shard's part that one task sorts, about, and the most parts of a shard.
PART, MOST_PARTS = 2_000_000, 1024
#: Rows up to which the plan's tables are sent to all executors.
SMALL = 200_000
#: Documents in a block, about, and the most blocks of a source.
BLOCK, MOST_BLOCKS = 256, 65536
SPAN = 1 << 60
FILLS = 3


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Words to take from each source: sources by code point, null last, get the
    repeating weights' parts of share * all words, no more than cap * their size;
    what is above is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest, out = share * sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: cap * sizes[s] / weight[s]):
        full = cap * sizes[s]
        if left / rest * weight[s] <= full:
            break
        out[s] = float(full)
        left, rest = left - full, rest - weight[s]
    each = left / rest if rest else 0.0
    return {s: out.get(s, weight[s] * each) for s in order}


def splitting_tree(blocks: list[int], shards: int, seed: int = 17) -> np.ndarray:
    """(shards, sources): how many of each source's blocks go to each shard."""
    rng = np.random.default_rng(seed)

    def split(counts: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [counts]
        left = n // 2
        drawn = rng.multivariate_hypergeometric(counts, int(counts.sum()) * left // n, method="marginals") if len(counts) else counts
        return split(drawn, left) + split(counts - drawn, n - left)

    return np.stack(split(np.asarray(blocks, np.int64), shards))


def _row_key(c):
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


_MORE = "array<struct<most:double,upto:bigint>>"
#: A source's part of the plan.
_SOURCE = f"s string, source_size bigint, target double, passes int, blocks bigint, cut bigint, extra array<bigint>, more {_MORE}"


def _table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small table from the driver, made by the engine itself from text."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([{n: [dict(zip(("most", "upto"), x)) for x in r[n]] if n == "more" else r[n] for n in names} for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ", "))))


def _block(h: Column, blocks: Column) -> Column:
    return F.floor(h / F.ceil(F.lit(SPAN) / blocks))


def _go_on(rows: DataFrame, info: list[dict]) -> None:
    """Fills what is left of the sources' quotas until no remaining document fits.

    A round appends to `more` (most, upto): documents of at most so many words and
    up to that place of the permuted order are taken; and one document to `extra`.
    """
    spark, by = rows.sparkSession, {r["s"]: r for r in info}
    whole = rows.groupBy("s", "h").agg(F.sum("size").alias("w"))

    def able() -> DataFrame:
        need = _table(spark, info, f"s string, left double, cut bigint, extra array<bigint>, more {_MORE}, blocks bigint").toDF("q", "left", "qc", "qx", "qm", "blocks")
        rest = whole.join(need, F.col("s").eqNullSafe(F.col("q"))).where("w > 0 and w <= left and h > qc and not array_contains(qx, h)")
        rest = rest.where(~F.exists("qm", lambda x: (F.col("w") <= x["most"]) & (F.col("h") <= x["upto"])))
        return rest.withColumn("b", _block(F.col("h"), F.col("blocks")))

    if not able().limit(1).count():
        return
    whole = materialize(whole, "whole")
    while True:
        rest = materialize(able(), "rest")
        per = rest.groupBy("s", "b").agg(F.sum("w").alias("w"), F.first("left").alias("left"))
        per = materialize(per.withColumn("end", F.sum("w").over(Window.partitionBy("s").orderBy("b"))), "per")
        ends = {r["s"]: r["end"] for r in per.groupBy("s").agg(F.max("end").alias("end")).collect()}
        if not ends:
            return
        part = per.where("end > left").groupBy("s").agg(F.min_by(F.struct("b", (F.col("end") - F.col("w")).alias("before")), "b").alias("x")).select(F.col("s").alias("q2"), F.col("x.b").alias("qb"), "x.before")
        first = {r["q2"]: r for r in part.collect()}
        inside = rest.join(part, F.col("s").eqNullSafe(F.col("q2")) & (F.col("b") == F.col("qb")))
        inside = inside.withColumn("end", F.col("before") + F.sum("w").over(Window.partitionBy("s").orderBy("h")))
        cuts = {r["s"]: r for r in inside.where("end <= left").groupBy("s").agg(F.max("h").alias("h"), F.max("end").alias("end")).collect()}
        for s, end in ends.items():
            upto, taken = SPAN - 1, end
            if s in cuts:
                upto, taken = cuts[s]["h"], cuts[s]["end"]
            elif s in first:
                upto, taken = -(-SPAN // by[s]["blocks"]) * int(first[s]["b"]) - 1, first[s]["before"]
            by[s]["more"].append((float(by[s]["left"]), int(upto)))
            by[s]["left"] -= taken
        for r in able().groupBy("s").agg(F.max(F.struct("w", (-F.col("h")).alias("h"))).alias("x")).collect():
            by[r["s"]]["extra"].append(-r["x"]["h"])
            by[r["s"]]["left"] -= r["x"]["w"]


@dataclass
class Plan:
    """Which documents of which sources go to which shards.

    sources(s, source_size, target, passes, blocks, cut, extra, more): a row a source.
    blocks(s, b, drawn): each block's draws as (pass, shard), from the tree's leaves.
    whole(s, h, w): words of the ids of several rows, where documents' sizes matter.
    """

    sources: DataFrame
    blocks: DataFrame
    whole: DataFrame | None
    shards: int
    words: float

    def shards_of(self, rows: DataFrame, s: str, size: str, h: str, out: str) -> DataFrame:
        """rows with out, the list of shards of each time that a row is taken, by its columns s, size and h."""
        names = free_names(rows, out, "s", "passes", "blocks", "cut", "extra", "more", "b", "drawn", "w", "own_b", "own_h")
        out, source, passes, blocks, cut, extra, more, b, drawn, w, own_b, own_h = names
        per = self.sources.select(*[F.col(x).alias(y) for x, y in zip(("s", "passes", "blocks", "cut", "extra", "more"), names[1:7])])
        joined = rows.join(_small(per), F.col(s).eqNullSafe(F.col(source))).drop(source).withColumn(b, _block(F.col(h), F.col(blocks)))
        own = self.blocks.select(F.col("s").alias(source), F.col("b").alias(own_b), F.col("drawn").alias(drawn))
        joined = joined.join(_small(own), F.col(s).eqNullSafe(F.col(source)) & (F.col(b) == F.col(own_b)), "left").drop(source, own_b)
        words = F.col(size)
        if self.whole is not None:
            own = self.whole.select(F.col("s").alias(source), F.col("h").alias(own_h), F.col("w").alias(w))
            joined = joined.join(own, F.col(s).eqNullSafe(F.col(source)) & (F.col(h) == F.col(own_h)), "left").drop(source, own_h)
            words = F.coalesce(F.col(w), words)
        chosen = (F.col(h) <= F.col(cut)) | F.array_contains(extra, F.col(h)) | F.exists(more, lambda x: (words <= x["most"]) & (F.col(h) <= x["upto"]))
        taken = F.transform(F.filter(drawn, lambda d: (d["pass"] < F.col(passes)) | chosen), lambda d: d["shard"])
        taken = F.when((F.col(size) > 0) & F.col(drawn).isNotNull(), taken).otherwise(F.array().cast("array<int>"))
        return joined.withColumn(out, taken).select(*[F.col(f"`{c}`") for c in rows.columns], out)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL else table


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int = SHARDS) -> tuple[Plan, DataFrame]:
    """The plan for docs, and (doc_id, s, size, h) of its rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("s"), _size(F.col(text_col)).alias("size"), _row_key(F.col(id_col)).alias("h"))
    rows = materialize(rows, "sizes")
    totals = {r["s"]: (r["n"], r["words"]) for r in rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()}
    goal = targets({s: w for s, (_, w) in totals.items()}, weights, share, cap)
    info = []
    for s, (n, words) in sorted(totals.items(), key=lambda x: (x[0] is None, x[0] or "")):
        passes = min(cap, int(goal[s] // words)) if words else 0
        blocks = max(1, min(MOST_BLOCKS, -(-n // BLOCK)))
        info.append({"s": s, "source_size": words, "target": goal[s], "passes": passes, "blocks": blocks, "cut": -1, "extra": [], "more": [], "quota": goal[s] - passes * words})
    by = {r["s"]: r for r in info}

    # words per block, then the last block that begins within the quota, then its documents
    quota = _table(spark, info, "s string, quota double, blocks bigint").toDF("q", "quota", "blocks")
    keyed = rows.join(quota, F.col("s").eqNullSafe(F.col("q"))).drop("q").withColumn("b", _block(F.col("h"), F.col("blocks")))
    per = keyed.groupBy("s", "b").agg(F.sum("size").alias("w"), F.first("quota").alias("quota"))
    per = per.withColumn("end", F.sum("w").over(Window.partitionBy("s").orderBy("b")))
    part = per.where("end > quota").groupBy("s").agg(F.min_by(F.struct("b", (F.col("end") - F.col("w")).alias("before")), "b").alias("x")).select("s", "x.*")
    part = materialize(part, "cuts")
    inside = keyed.join(part.select(F.col("s").alias("q"), F.col("b").alias("qb"), "before"), F.col("s").eqNullSafe(F.col("q")) & (F.col("b") == F.col("qb")))
    inside = inside.withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("h")))
    cuts = {r["s"]: r for r in inside.where("end <= quota").groupBy("s").agg(F.max("h").alias("h"), F.max("end").alias("end")).collect()}
    begins = {r["s"]: r for r in part.collect()}
    for r in info:
        if r["s"] not in begins:  # the quota takes all
            r["cut"], r["left"] = SPAN, 0.0
        else:
            first = begins[r["s"]]
            r["cut"] = max(-1, -(-SPAN // r["blocks"]) * int(first["b"]) - 1)
            r["left"] = r["quota"] - float(first["before"])
            if r["s"] in cuts:
                r["cut"], r["left"] = cuts[r["s"]]["h"], r["quota"] - float(cuts[r["s"]]["end"])
    for _ in range(FILLS):
        need = _table(spark, info, "s string, left double, cut bigint, extra array<bigint>").toDF("q", "left", "qc", "qx")
        able = rows.join(need, F.col("s").eqNullSafe(F.col("q")) & (F.col("size") <= F.col("left"))).where("size > 0 and h > qc and not array_contains(qx, h)")
        for r in able.groupBy("s").agg(F.max(F.struct("size", (-F.col("h")).alias("h"))).alias("x")).collect():
            by[r["s"]]["extra"].append(-r["x"]["h"])
            by[r["s"]]["left"] -= r["x"]["size"]
    _go_on(rows, info)
    for r in info:  # the quota in blocks: all of each whole pass, and those that the part of a pass reaches
        reach = max(r["cut"], 0, *r["extra"], *[upto for _, upto in r["more"]])
        last = 0 if r["passes"] >= cap or r["cut"] < 0 and not r["extra"] and not r["more"] else min(r["blocks"], reach // -(-SPAN // r["blocks"]) + 1)
        r["draws"] = r["passes"] * r["blocks"] + last
    ends = np.cumsum(splitting_tree([r["draws"] for r in info], shards), axis=0)
    leaves = [{"s": r["s"], "blocks": r["blocks"], "shard": k, "lo": int(ends[k - 1, i]) if k else 0, "hi": int(ends[k, i])} for i, r in enumerate(info) for k in range(shards)]
    leaves = _table(spark, [x for x in leaves if x["lo"] < x["hi"]], "s string, blocks bigint, shard int, lo bigint, hi bigint")
    at = leaves.select("s", "blocks", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at"))
    drawn = at.groupBy("s", (F.col("at") % F.col("blocks")).alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.floor(F.col("at") / F.col("blocks")).cast("int").alias("pass"), "shard"))).alias("drawn"))
    whole = None
    if any(r["more"] for r in info):
        whole = materialize(rows.groupBy("s", "h").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where("n > 1").drop("n"), "whole")
    return Plan(_table(spark, info, _SOURCE), materialize(drawn, "blocks"), whole, shards, sum(goal.values())), rows


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """One row per row of docs: doc_id, s (source), size, source_size, target, shards.

    shards lists the output shard of each time that the document is taken, so
    its size is how often: 0 to `cap` times. Null texts have size 0, null
    sources are a source, rows that repeat an id within a source are taken together,
    an id in several sources is one of each, an empty table gives no rows, other
    columns are not read, and the same input gives the same result. A source's
    taken words stay below its target by less than the smallest of the
    documents that the last pass leaves out.
    """
    p, rows = plan(docs, id_col, text_col, source_col, **settings)
    out = p.shards_of(rows, "s", "size", "h", "shards")
    per = p.sources.select(F.col("s").alias("q"), "source_size", "target")
    return out.join(_small(per), F.col("s").eqNullSafe(F.col("q"))).select("doc_id", "s", "size", "source_size", "target", "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed rows of docs, one for each time that a document is taken, with
    the columns shard and position (its place in the shard's shuffled order).

    Each row of docs is taken as its own id and source say, so rows that share an
    id keep their own counts. Where docs has a column shard or position, the new one's
    name gets an underscore behind. Rows are dealt by shard, and large shards by parts of their
    order, and sorted by position. Documents without a word have nothing to take
    and stay out; an empty table gives no rows.
    """
    p, _ = plan(docs, id_col, text_col, source_col, **settings)
    shard, position, s, size, h, taken, copy, part = free_names(docs, "shard", "position", "s", "size", "h", "taken", "copy", "part")
    rows = docs.withColumns({s: F.col(source_col).cast("string"), size: _size(F.col(text_col)), h: _row_key(F.col(id_col))})
    out = p.shards_of(rows, s, size, h, taken)
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode(taken).alias(copy, shard))
    parts = int(max(1, min(MOST_PARTS, -(-p.words // (p.shards * PART)))))
    out = out.withColumn(position, F.xxhash64(F.col(id_col), copy, shard))
    # a part is a range of positions
    cell = F.floor((F.shiftrightunsigned(position, 32) * parts) / F.lit(1 << 32)).cast("int")
    out = out.withColumn(part, F.col(shard) * parts + cell).repartitionById(p.shards * parts, F.col(part))
    return out.sortWithinPartitions(part, F.shiftrightunsigned(position, 1), position).drop(copy, part)
