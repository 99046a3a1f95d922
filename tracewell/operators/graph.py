"""Reachability, states and derived columns of the statement graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.functions import columns as C
from tracewell.runtime import materialize, release

#: Hops that one round takes.
STEPS = 4
#: Rounds whose tables are kept apart before they are merged.
MERGE = 8


def closure(entries: DataFrame, links: DataFrame, node: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """R1 (node, round): everything reached over links from entries, entries in round 0. Cycles are allowed.

    round is the number of links on the shortest way. A written round takes
    STEPS hops from the nodes that the round before reached last: each hop is one
    equi-join with the links, dealt once for all hops of a round, and one distinct; then
    one anti join leaves the nodes that are new. Rounds are written to the shared folder, which
    cuts the lineage. A round scans all links, so their number of rounds is what
    long chains cost.
    """
    hop = links.select(F.col(source).alias("__s"), F.col(target).alias("__t")).where("__s is not null and __t is not null").distinct()
    hop = materialize(hop, "hops")
    start = entries.select(F.col(node).alias("n")).where("n is not null").distinct().withColumn("round", F.lit(0))
    tables, depth = [materialize(start, "reached")], 0
    front = tables[0]
    while True:
        known = tables[0]
        for t in tables[1:]:
            known = known.unionByName(t)
        at, steps = front.select("n"), []
        for _ in range(STEPS):
            depth += 1
            at = at.join(hop, F.col("n") == F.col("__s")).select(F.col("__t").alias("n")).distinct()
            steps.append(at.withColumn("round", F.lit(depth)))
        new = steps[0]
        for t in steps[1:]:
            new = new.unionByName(t)
        new = new.groupBy("n").agg(F.min("round").alias("round"))
        new = materialize(new.join(known.select("n"), "n", "left_anti"), "reached")
        last = new.agg(F.max("round")).first()[0]
        if last is None:
            release(new)
            break
        tables.append(new)
        if last < depth:  # no node is that far
            break
        front = new.where(F.col("round") == depth)
        if len(tables) > MERGE:
            tables = [materialize(known.unionByName(new), "reached")]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumnRenamed("n", node)


def nearest_ancestor(parents: DataFrame, stops: DataFrame) -> DataFrame:
    """R2 (node, ancestor): each node's nearest ancestor, itself first, that is in stops(node); by pointer jumping."""
    stop = stops.select(F.col("node").alias("__n"), F.lit(True).alias("__stop"))
    at = parents.select("node", F.col("parent").alias("up")).join(stop, F.col("node") == F.col("__n"), "left")
    at = materialize(at.select("node", F.when(F.col("__stop"), F.col("node")).otherwise(F.col("up")).alias("up")), "jumps")
    while True:
        over = at.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
        new = materialize(at.join(over, F.col("up") == F.col("__n"), "left").select("node", "up", F.when(F.col("__n").isNotNull(), F.col("__u")).otherwise(F.col("up")).alias("next")), "jumps")
        moved = new.where("not (up <=> next)").limit(1).count()
        at = new.select("node", F.col("next").alias("up"))
        if not moved:
            return at.join(stops.select(F.col("node").alias("up")), "up", "left_semi").select("node", F.col("up").alias("ancestor"))


def sent_links(links: DataFrame) -> DataFrame:
    """Links with the end that sends: for kinds whose sender is the needed statement, the needed one feeds the needing one."""
    sender = F.create_map(*[F.lit(x) for kv in S.SENDER.items() for x in kv])[F.col("kind")]
    return links.where(sender.isNotNull()).select(F.when(sender == "source", F.col("source")).otherwise(F.col("target")).alias("sender"), F.when(sender == "source", F.col("target")).otherwise(F.col("source")).alias("receiver"))


def io_columns(links: DataFrame) -> DataFrame:
    """A1 (id, inputs, outputs, is_source, is_sink): distinct neighbours sorted by number, for ids that a link touches.

    outputs are the receivers of what the id sends, inputs the senders to it.
    """
    sent = sent_links(links)
    sides = sent.select(F.col("sender").alias("id"), F.col("receiver").alias("out"), F.lit(None).cast("long").alias("in"))
    sides = sides.unionByName(sent.select(F.col("receiver").alias("id"), F.lit(None).cast("long").alias("out"), F.col("sender").alias("in")))
    both = sides.distinct().groupBy("id").agg(F.array_sort(F.collect_set("in")).alias("inputs"), F.array_sort(F.collect_set("out")).alias("outputs"))
    return both.withColumns({"is_source": (F.size("outputs") > 0) & (F.size("inputs") == 0), "is_sink": F.size("outputs") == 0})


def joined_ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def machine_states(statements: DataFrame, links: DataFrame, reached: DataFrame, readable: Column | None = None) -> DataFrame:
    """Statements with machine_state. Reached goes before unsupported, that before unreached (some link) and untouched (none)."""
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    can = C.has_ext(F.col("file"), S.MACHINE_READABLE) if readable is None else readable
    state = F.when(F.col("__reached"), "reached").when(~can, "unsupported").when(F.col("__linked"), "unreached").otherwise("untouched")
    rows = statements.join(reached.select("id").distinct().withColumn("__reached", F.lit(True)), "id", "left")
    rows = rows.join(ends.withColumn("__linked", F.lit(True)), "id", "left")
    return rows.withColumn("machine_state", state).drop("__reached", "__linked")


def state_counts(states: DataFrame) -> DataFrame:
    """A5 (machine_state, statements)."""
    return states.groupBy("machine_state").agg(F.count("*").alias("statements"))


def coverage(states: DataFrame, loaded: DataFrame, entries: DataFrame) -> DataFrame:
    """A5, T4, T6 (file, walked): files that loading or an entry proves live, and whether any of their statements is reached."""
    live = loaded.select("file").unionByName(states.join(entries.select("id"), "id", "left_semi").select("file")).distinct()
    walked = states.where("machine_state = 'reached'").select("file").distinct().withColumn("walked", F.lit(True))
    return live.join(walked, "file", "left").fillna({"walked": False})


def united(*producers: DataFrame) -> DataFrame:
    """Distinct links (source, target, kind, origin) of all producers."""
    if not producers:
        raise ValueError("no link file")
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p)
    return out.distinct()


def unknown_ids(links: DataFrame, statements: DataFrame) -> DataFrame:
    """J17 (id): link ends that are no statement."""
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    return ends.join(statements.select("id"), "id", "left_anti")
