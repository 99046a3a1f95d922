"""The review of what machines leave open: an append-only event log and its fold.

Every command appends rows to one table of events; flags, queue and links are
derived from the log, so a command is one atomic append. `reset` is an event
after which earlier machine events no longer count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema as S
from tracewell.operators import checks, graph
from tracewell.runtime import materialize
from tracewell.sources.scans import Refused

LOG = "seq long, type string, id long, other long, text string"
COLUMNS = "seq long, id long, inputs array<long>, outputs array<long>"


def flags(statements: DataFrame, events: DataFrame) -> DataFrame:
    """D10 flags per statement: visited, visited_by, unresolved, reviewed, review, machine_state.

    The last event of a statement decides; machine events before the last
    reset do not count.
    """
    reset = events.where("type = 'reset'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("reset"))
    live = events.crossJoin(F.broadcast(reset)).where("seq > reset or type not in ('walk', 'state', 'sweep', 'fill')")  # one row
    moves = live.where("type in ('walk', 'record', 'unsure', 'sweep', 'resolve', 'reopen')")
    # a walk never changes who visited first
    own = moves.groupBy("id").agg(
        F.max_by("type", "seq").alias("last"),
        F.bool_or(F.col("type").isin("resolve", "reopen")).alias("reviewed"),
        F.bool_or(F.col("type").isin("record", "unsure", "resolve")).alias("by_hand"),
        F.max_by(F.when(F.col("type") == "resolve", "resolved").when(F.col("type") == "reopen", "reopened"), F.when(F.col("type").isin("resolve", "reopen"), F.col("seq")).otherwise(-1)).alias("review"),
    )
    state = live.where("type = 'state'").groupBy("id").agg(F.max_by("text", "seq").alias("machine_state"))
    seen = F.coalesce(F.col("last").isin("walk", "record", "unsure", "resolve"), F.lit(False))
    rows = statements.join(own, "id", "left").join(state, "id", "left")
    return rows.withColumns(
        {
            "visited": seen,
            "visited_by": F.when(seen, F.when(F.col("by_hand"), "intelligence").otherwise("machine")),
            "unresolved": F.coalesce(F.col("last").isin("unsure", "sweep"), F.lit(False)),
            "reviewed": F.coalesce("reviewed", F.lit(False)),
        }
    ).drop("last", "by_hand")


def log_links(events: DataFrame) -> DataFrame:
    """Links that the log holds: machine ones since the last reset, stated ones always."""
    reset = events.where("type = 'reset'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("reset"))
    live = events.where("type = 'link'").crossJoin(F.broadcast(reset)).where("seq > reset or text = 'STATED'")  # one row
    return live.select(F.col("id").alias("source"), F.col("other").alias("target"), F.col("text").alias("kind"), F.when(F.col("text") == "STATED", "intelligence").otherwise("machine").alias("origin")).distinct()


def queue(states: DataFrame, events: DataFrame) -> DataFrame:
    """D12 (id): queued and not visited since."""
    return events.where("type = 'queue'").select("id").distinct().join(states.where("not visited").select("id"), "id", "left_semi")


def since_reset(events: DataFrame) -> DataFrame:
    """What machines said since the last reset: (type, id, other, text)."""
    reset = events.where("type = 'reset'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("reset"))
    return events.crossJoin(F.broadcast(reset)).where("seq > reset").drop("reset")  # one row


def stored_sums(events: DataFrame) -> DataFrame:
    """(path, sha256): the sums that the last fill stored."""
    parts = F.split("text", "\t")
    return since_reset(events).where("type = 'sum'").select(parts[0].alias("path"), parts[1].alias("sha256"))


def handed(events: DataFrame, states: DataFrame) -> DataFrame:
    """D12 (id): handed out, not answered, and still unvisited."""
    last = events.where("type in ('hand', 'record', 'unsure')").agg(F.max_by(F.struct("type", "id"), "seq").alias("x")).where("x.type = 'hand'").select(F.col("x.id").alias("id"))
    return last.join(states.where("not visited").select("id"), "id", "left_semi")


def latest_columns(stored: DataFrame) -> DataFrame:
    """(id, inputs, outputs) of the last step that wrote each id's columns(seq, id, inputs, outputs)."""
    return stored.groupBy("id").agg(F.max_by(F.struct("inputs", "outputs"), "seq").alias("x")).select("id", "x.inputs", "x.outputs")


def fold(events: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The latest event per key by a total order, with its values."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(v, at).alias(v) for v in values])


@dataclass
class Review:
    """W2-W13 over statements, entry ids and a log in `folder`, which the driver and executors share."""

    spark: SparkSession
    folder: str
    statements: DataFrame
    entries: DataFrame
    demoted: DataFrame | None = None
    sections: DataFrame | None = None

    # --- the log

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def columns(self) -> DataFrame:
        """(id, inputs, outputs) as W15 wrote them last."""
        return latest_columns(self._read("columns", COLUMNS))

    def _rebuild(self, ids: list[int] | None = None) -> None:
        """Write the columns of these statements, or of all that have or had links, from all links."""
        log = self.log()
        seq = F.lit(log.agg(F.max("seq")).first()[0] or 0).cast("long")
        now = graph.io_columns(log_links(log)).select("id", "inputs", "outputs")
        if ids is None:
            now = now.select("id").unionByName(self.columns().select("id")).distinct().join(now, "id", "left")
        else:
            now = now.where(F.col("id").isin(ids))
        now.select(seq.alias("seq"), "id", "inputs", "outputs").write.mode("append").parquet(f"{self.folder}/columns")

    def _append(self, rows: list[tuple] | DataFrame) -> None:
        """rows of (type, id, other, text): all get the next sequence number, so one append is one step."""
        seq = self._step()
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, "type string, id long, other long, text string")
        df.select(F.lit(seq).cast("long").alias("seq"), "type", "id", "other", "text").write.mode("append").parquet(f"{self.folder}/log")

    def _step(self) -> int:
        """A sequence number of this command's own: the first whose mark it makes itself, as commands may run at once."""
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        jvm = self.spark.sparkContext._jvm
        mark = lambda: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/steps/{seq}")
        fs = mark().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        while not fs.createNewFile(mark()):
            seq += 1
        return seq

    def states(self) -> DataFrame:
        return flags(self.statements, self.log())

    def _row(self, number: int) -> dict:
        row = self.states().where(F.col("id") == number).first()
        if row is None:
            raise Refused(f"no statement {number}")
        return row.asDict()

    def _known(self, ids: list[int]) -> None:
        there = {r["id"] for r in self.statements.where(F.col("id").isin(ids)).select("id").collect()} if ids else set()
        if lost := sorted(set(ids) - there):
            raise Refused(f"no statement {lost[0]}")

    def _unvisited(self, ids: list[int]) -> list[int]:
        return sorted(r["id"] for r in self.states().where(F.col("id").isin(ids) & ~F.col("visited")).select("id").collect()) if ids else []

    # --- machine commands

    def fill(self, links: DataFrame, graphs: list[str] | None = None, manifest: DataFrame | None = None) -> None:
        """Admit links(source, target, kind); none is marked visited.

        The log keeps sums of the links and of the manifest, and the graphs that producers
        gave, which may be without links; by default those of the links' kinds.
        """
        if log_links(self.log()).where("origin = 'machine'").limit(1).count():
            raise Refused("the machine's links are there already")
        if odd := links.where(~F.col("kind").isin(*S.MACHINE_KINDS)).select("kind").first():
            raise Refused(f"no link kind {odd['kind']}")
        if lost := graph.unknown_ids(links, self.statements).first():
            raise Refused(f"no statement {lost['id']}")
        rows = links.select("source", "target", "kind").distinct()
        kinds = [r["kind"] for r in rows.select("kind").distinct().collect()]  # a few: see MACHINE_KINDS
        marks = self.spark.createDataFrame([("fill", None, None, None), *[("graph", None, None, g) for g in sorted({*kinds, *(graphs or ())})]], "type string, id long, other long, text string")
        sums = checks.link_sums(rows)
        if manifest is not None:
            sums = sums.unionByName(checks.manifest_sum(manifest))
        none = F.lit(None).cast("long")
        sums = sums.select(F.lit("sum").alias("type"), none.alias("id"), none.alias("other"), F.concat_ws("\t", "path", "sha256").alias("text"))
        self._append(rows.select(F.lit("link").alias("type"), F.col("source").alias("id"), F.col("target").alias("other"), F.col("kind").alias("text")).unionByName(marks).unionByName(sums))
        self._rebuild()

    def walk(self) -> DataFrame:
        """Mark what machine links reach from the entries that are not demoted; returns the states."""
        reset = self.log().where("type = 'reset'").agg(F.max("seq")).first()[0] or 0
        if not self.log().where(f"type = 'fill' and seq > {reset}").limit(1).count():
            raise Refused("nothing is filled")
        links = log_links(self.log()).where("origin = 'machine'")
        states = graph.machine_states(self.statements, links, graph.closure(self.live_entries(), links))
        marks = states.select(F.lit("state").alias("type"), "id", F.lit(None).cast("long").alias("other"), F.col("machine_state").alias("text"))
        walked = states.where("machine_state = 'reached'").join(self.states().where("not visited").select("id"), "id", "left_semi")
        self._append(marks.unionByName(walked.select(F.lit("walk").alias("type"), "id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("string").alias("text"))))
        return states

    def reset(self, confirm: bool = False) -> None:
        """What machines said no longer counts."""
        if not confirm:
            raise Refused("a reset has to be confirmed")
        self._append([("reset", None, None, None)])
        self._rebuild()

    # --- traversal

    def live_entries(self) -> DataFrame:
        added = self.log().where("type = 'entry'").select("id")
        all_ids = self.entries.select("id").unionByName(added).distinct()
        return all_ids.join(self.demoted.select("id"), "id", "left_anti") if self.demoted is not None else all_ids

    def next(self) -> int | None:
        """The planned statement, else the least queued one, else the first entry, all unvisited; None where the traversal stops."""
        log, states = self.log(), self.states()
        last = log.where("type in ('plan', 'record', 'unsure', 'hand')").orderBy(F.desc("seq")).first()
        open_ids = states.where("not visited")
        planned = log.where(F.col("type").isin("plan", "hand") & (F.col("seq") == F.lit(last["seq"] if last else -1))).select("id")
        if self.demoted is not None:
            planned = planned.join(self.demoted.select("id"), "id", "left_anti")
        entries = self.live_entries().join(self.entries.select("id", *[c for c in self.entries.columns if c == "pos"]), "id", "left")
        for ids, order in ((planned, "id"), (queue(states, log), "id"), (entries, "pos" if "pos" in entries.columns else "id")):
            if row := ids.join(open_ids.select("id"), "id", "left_semi").orderBy(F.col(order).asc_nulls_last(), "id").first():
                self._append([("hand", row["id"], None, None)])
                return row["id"]
        return None

    def record(self, number: int, inputs: list[int] = (), outputs: list[int] = (), place: str = "", unresolved: bool = False) -> int | None:
        """The answer for the handed statement, in one step; returns the planned next one."""
        handed = self.log().where("type in ('hand', 'record', 'unsure')").orderBy(F.desc("seq")).first()
        if not handed or handed["type"] != "hand" or handed["id"] != number:
            raise Refused(f"statement {number} is not the one handed out")
        if self._row(number)["visited"]:
            raise Refused(f"statement {number} is visited")
        self._known([*inputs, *outputs])
        rows = [("unsure" if unresolved else "record", number, None, place)]
        rows += [("link", number, o, "STATED") for o in outputs] + [("link", i, number, "STATED") for i in inputs]
        ahead = [i for i in self._unvisited(list(outputs)) if i != number]
        planned = None
        if ahead and not unresolved:
            planned, *ahead = ahead
            rows.append(("plan", planned, None, None))
        self._append(rows + [("queue", i, None, None) for i in ahead])
        self._rebuild([number, *inputs, *outputs])
        return planned

    # --- review

    def unresolved(self) -> DataFrame:
        """Undecided statements by id."""
        return self.states().where("unresolved and not reviewed").orderBy("id")

    def sweep(self, dry: bool = False, unreached: bool = False) -> DataFrame:
        """Open a case for what no one examined; returns the cases (id)."""
        states = self.states()
        if not states.where("machine_state is not null").limit(1).count():
            raise Refused("nothing is walked")
        cases = materialize(sweep_cases(states, unreached), "cases")
        if not dry and not cases.isEmpty():
            none = F.lit(None).cast("string")
            self._append(cases.select(F.lit("sweep").alias("type"), "id", F.lit(None).cast("long").alias("other"), none.alias("text")))
        return cases

    def _guard(self, number: int) -> None:
        row = self._row(number)
        if not row["unresolved"]:
            raise Refused(f"statement {number} is not unresolved")
        if row["review"] == "resolved":
            raise Refused(f"statement {number} is resolved already")
        if self.sections is not None and not self.sections.where(F.col("id") == number).limit(1).count():
            raise Refused(f"statement {number} has no review section")

    def resolve(self, number: int, inputs: list[int] = (), outputs: list[int] = ()) -> None:
        """Decided as used, with its links; only its unvisited outputs are queued."""
        self._guard(number)
        self._known([*inputs, *outputs])
        rows = [("resolve", number, None, None)] + [("link", number, o, "STATED") for o in outputs] + [("link", i, number, "STATED") for i in inputs]
        self._append(rows + [("queue", i, None, None) for i in self._unvisited(list(outputs)) if i != number])
        self._rebuild([number, *inputs, *outputs])

    def reopen(self, number: int, how: str) -> None:
        """Back to unvisited, as an entry, queued, or (`none`) as no longer used, which no real entry can be."""
        self._guard(number)
        if how not in ("entry", "queue", "none"):
            raise Refused(f"no way {how}")
        if how == "none" and self.live_entries().where(F.col("id") == number).limit(1).count():
            raise Refused(f"statement {number} is an entry")
        self._append([("reopen", number, None, how)] + ([(how, number, None, None)] if how != "none" else []))

    def finish(self) -> dict:
        """Suspected statements, and whether all is done."""
        states = self.states()
        if states.where("unresolved and not reviewed").limit(1).count():
            raise Refused("there are undecided statements")
        left = {
            "unresolved": states.where("unresolved").count(),
            "queued": queue(states, self.log()).count(),
            "entries": self.live_entries().join(states.where("not visited and not reviewed").select("id"), "id", "left_semi").count(),
            "never examined": never_examined(states).count(),
        }
        suspected = states.where("review = 'reopened' and not visited").orderBy("id")
        return {"left": left, "done": not any(left.values()), "suspected": suspected}

    def report(self) -> DataFrame:
        return report_counts(self.states(), log_links(self.log()))


def sweep_cases(states: DataFrame, unreached: bool = False) -> DataFrame:
    """F9 (id)."""
    kinds = ["untouched", "unsupported"] + ["unreached"] * unreached
    return states.where(~F.col("visited") & ~F.col("unresolved") & ~F.col("reviewed") & F.col("machine_state").isin(*kinds)).select("id")


def never_examined(states: DataFrame) -> DataFrame:
    """F10 (id)."""
    return states.where(~F.col("visited") & ~F.col("reviewed") & F.col("machine_state").isin("untouched", "unsupported")).select("id")


def report_counts(states: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    io = states.select("id", "visited", "visited_by", "unresolved", "reviewed", "review").join(graph.io_columns(links), "id", "left")
    return io.agg(
        F.count("*").alias("statements"),
        n("visited", "visited"),
        n("visited_by = 'machine'", "by_machine"),
        n("visited_by = 'intelligence'", "by_intelligence"),
        n("unresolved", "unresolved"),
        n("reviewed", "reviewed"),
        n("review = 'resolved'", "resolved"),
        n("review = 'reopened'", "reopened"),
        n("is_source", "sources"),
        n("is_sink", "sinks"),
        n("not visited", "unvisited"),
    )
