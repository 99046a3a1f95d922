"""URL verdicts: a block list's longest rule, else gradient-boosted trees.

Features are lexical: length, depth, digit ratio, entropy, parameter counts and
statistics of suffixes: how often labelled urls of the same top-level domain, the same
last two host labels and the same first part of the path are blocked, mixed with PRIOR
rows that tell nothing. Trees are grown level by level from histograms
of gradients, each of them one aggregation over the binned training rows, so
that only node x feature x bin sums come to the driver; a tree is then a nest of
CASE expressions. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled rows that the trees learn from, about.
SAMPLE = 50_000
BINS, TREES, DEPTH, RATE, RIDGE = 16, 8, 3, 0.4, 1.0
#: Prior rows that a suffix's statistics are mixed with.
PRIOR = 20.0
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "mark_ratio", "entropy", "parameters", "fragment", "longest_part")
#: What labelled rows are counted by.
STATISTICS = ("suffix", "domain", "part")
ALL = (*FEATURES, *[f"{s}_{x}" for s in STATISTICS for x in ("share", "rows")])
#: Values of a statistic up to which its table is sent to all executors.
SMALL = 100_000
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first `://`; both empty without one or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. Rules are (host + path, verdict)."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    out = {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(parts),
        "host_labels": F.size(F.split(host, r"\.")),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
        "mark_ratio": F.length(F.regexp_replace(u, "[A-Za-z0-9]", "")) / n,
        "entropy": _entropy(u),
        "parameters": F.length(F.regexp_replace(F.regexp_extract(u, r"\?([^#]*)", 1), "[^=]", "")),
        "fragment": F.when(u.contains("#"), 1).otherwise(0),
        "longest_part": F.coalesce(F.array_max(F.transform(F.split(host, r"[.-]"), lambda p: F.length(p))), F.lit(0)),
    }
    return {k: v.cast("double") for k, v in out.items()}


def _tree_sum(trees: list, value) -> Column:
    """Sum of the trees' leaves; value(feature, edge) tells whether a row goes left."""

    def walk(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        feature, edge, left, right = node
        return F.when(value(feature, edge), walk(left)).otherwise(walk(right))

    total = F.lit(0.0)
    for t in trees:
        total = total + walk(t)
    return total


class Boosted:
    """Trees as nests of (feature, bin, left, right), with the bins' upper edges per feature."""

    def __init__(self, edges: list[list[float]], base: float, trees: list):
        self.edges, self.base, self.trees = edges, base, trees

    def probability(self, features: list[Column]) -> Column:
        z = F.lit(self.base) + _tree_sum(self.trees, lambda f, b: features[f] <= F.lit(self.edges[f][b]))
        return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, names: list[str], label: str, trees: int = TREES) -> Boosted:
    """Trees for rows' 0/1 column label from its double columns names.

    Rows of one label only give no tree but that label's prior.
    """
    quantiles = rows.agg(*[F.percentile_approx(n, [i / BINS for i in range(BINS + 1)], 1000).alias(n) for n in names], F.sum(label).alias("__ones"), F.count("*").alias("__n")).first()
    n, ones = quantiles["__n"], quantiles["__ones"] or 0
    edges = [_between(sorted(set(quantiles[k] or []))) for k in names]
    if not n or ones in (0, n):
        return Boosted(edges, math.log((ones + 1) / (n - ones + 1)), [])
    base, heavy = 0.0, {1: n / (2 * ones), 0: n / (2 * (n - ones))}  # both labels weigh alike
    bins = [F.size(F.filter(F.array(*[F.lit(x) for x in e]), _below(F.col(k)))).cast("int") if e else F.lit(0) for k, e in zip(names, edges)]
    table = rows.select(F.array(*bins).alias("x"), F.col(label).cast("double").alias("y")).groupBy("x", "y").agg((F.count("*") * F.when(F.col("y") == 1, heavy[1]).otherwise(heavy[0])).alias("w"))
    table = materialize(table, "binned")
    grown: list = []
    for _ in range(trees):
        z = F.lit(base) + _tree_sum(grown, lambda f, b: F.get("x", F.lit(f)) <= b)
        p = 1 / (1 + F.exp(-z))
        scored = table.select("x", (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
        grown.append(_grow(scored, edges))
    return Boosted(edges, base, grown)


def _between(values: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _below(value: Column):
    return lambda edge: edge < value


def _grow(scored: DataFrame, edges: list[list[float]]):
    """One tree: a level is one aggregation of g and h by node, feature and bin. The last
    level's sums are those of the two sides of the splits before."""
    splits: dict[str, tuple[int, int]] = {}
    sides: dict[str, tuple[float, float]] = {}
    leaves: dict[str, float] = {}
    for depth in range(DEPTH):
        open_nodes = [s for s in ([""] if depth == 0 else [p + c for p in splits if len(p) == depth - 1 for c in "lr"])]
        if not open_nodes:
            break

        def path(prefix: str) -> Column:
            if prefix not in splits:
                return F.lit(prefix)
            f, b = splits[prefix]
            return F.when(F.get("x", F.lit(f)) <= b, path(prefix + "l")).otherwise(path(prefix + "r"))

        node = scored.withColumn("node", path("")).where(F.col("node").isin(open_nodes))
        sums = node.select("node", "g", "h", F.posexplode("x").alias("f", "b")).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        for s in open_nodes:
            own = [r for r in sums if r["node"] == s]
            g, h = sum(r["g"] for r in own if r["f"] == 0), sum(r["h"] for r in own if r["f"] == 0)
            best = (1e-6, -1, -1)
            for f in range(len(edges)):
                gl = hl = 0.0
                for r in sorted((r for r in own if r["f"] == f and r["b"] < len(edges[f])), key=lambda r: r["b"]):
                    gl, hl = gl + r["g"], hl + r["h"]
                    if hl > 1e-9 and h - hl > 1e-9:
                        gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                        if gain > best[0]:
                            best = (gain, f, r["b"])
                            sides[s + "l"], sides[s + "r"] = (gl, hl), (g - gl, h - hl)
            if best[1] >= 0:
                splits[s] = best[1:]
            else:
                leaves[s] = -RATE * g / (h + RIDGE)
    for s, (g, h) in sides.items():
        if len(s) == DEPTH:
            leaves[s] = -RATE * g / (h + RIDGE)

    def build(prefix: str):
        if prefix in splits:
            f, b = splits[prefix]
            return (f, b, build(prefix + "l"), build(prefix + "r"))
        return leaves.get(prefix, 0.0)

    return build("")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, risk.

    risk is the trees' probability of `block`, which decides (from 0.5 on) where
    no rule fits. The trees learn from labelled(url, blocked 0/1), or else from
    the pages that a rule fits, with its verdict as label; without any they tell nothing
    and allow as much as they block. Null urls and urls
    without `://` have empty host and path and are judged by the trees; repeated
    rows are judged each; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))

    def prepared(df: DataFrame) -> DataFrame:
        parts = df.withColumn("host", host).withColumn("path", path)
        parts = parts.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2), "part": F.regexp_extract("path", "^/([^/]*)", 1)})
        return parts.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))

    rows = prepared(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    rows = materialize(rows.drop("url"), "urls")
    known = rows.where("says is not null").withColumn("y", F.when(F.col("says") == "block", 1.0).otherwise(0.0))
    if labelled is not None:
        known = materialize(prepared(labelled.select("url", F.col("blocked").cast("double").alias("y")).where("y is not null")), "labelled")
    total = known.agg(F.sum("y").alias("ones"), F.count("*").alias("n")).first()
    ones, zeros = max(total["ones"] or 0.0, 1.0), max((total["n"] or 0) - (total["ones"] or 0.0), 1.0)
    blocked, allowed = F.col("ones") / ones + PRIOR / (ones + zeros), (F.col("n") - F.col("ones")) / zeros + PRIOR / (ones + zeros)
    tables = {}
    for k in STATISTICS:
        per = known.groupBy(k).agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
        per = materialize(per.select(F.col(k).alias("__s"), (blocked / (blocked + allowed)).alias(f"{k}_share"), F.log1p("n").alias(f"{k}_rows")), k)
        tables[k] = F.broadcast(per) if per.count() <= SMALL else per

    def with_statistics(df: DataFrame) -> DataFrame:
        for k, per in tables.items():
            df = df.join(per, F.col(k) == F.col("__s"), "left").drop("__s").fillna({f"{k}_share": 0.5, f"{k}_rows": 0.0})
        return df

    train = with_statistics(known)
    if (total["n"] or 0) > sample:
        train = train.where(F.pmod(F.xxhash64("host", "path", *FEATURES[:2]), F.lit(1_000_003)) < 1_000_003 * sample / total["n"])
    # learned with the host's statistics hidden too, so that hosts of a new suffix are told by the rest
    hidden = train.withColumns({f"{k}_{x}": F.lit(0.5 if x == "share" else 0.0) for k in ("suffix", "domain") for x in ("share", "rows")})
    model = fit(train.unionByName(hidden), list(ALL), "y")
    out = with_statistics(rows).withColumn("risk", model.probability([F.col(k) for k in ALL]))
    verdict = F.coalesce("says", F.when(F.col("risk") >= 0.5, F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "risk")
