"""Queries for list scans, merge refusals, integrity rules and the commands of the review, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import checks, edges, report, workflow
from tracewell.plans.registry import query
from tracewell.runtime import materialize, read_table, shared_dir
from tracewell.sources import scans

# --- lists ---------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 > 0")
def demoted_scan(spark, d):
    o = read_table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_custkey", F.lit("\twhy"))).otherwise(F.concat("o_custkey", F.lit("\ta.ts\twhy")))
    return scans.demoted_list(o.select(F.col("o_orderkey").alias("pos"), line.alias("line")))


@query("SELECT n_nationkey AS pos, n_name AS name, 'src/n' || n_nationkey || '/' AS target FROM nation WHERE n_nationkey % 4 < 2")
def alias_map(spark, d):
    k = F.col("n_nationkey")
    line = F.when(k % 4 == 0, F.concat("n_name", F.lit("\tsrc/n"), k)).when(k % 4 == 1, F.concat(F.lit(" "), "n_name", F.lit(" \tsrc/n"), k, F.lit("// "))).when(k % 4 == 2, F.lit("# note\tx")).otherwise(F.lit("one column"))
    return scans.name_map(read_table(spark, d, "nation").select(k.alias("pos"), line.alias("line")), slash=True)[0]


@query("SELECT 'map-columns' AS rule, (n_nationkey + 1)::VARCHAR AS detail FROM nation WHERE n_nationkey % 4 = 3")
def alias_map_violations(spark, d):
    k = F.col("n_nationkey")
    line = F.when(k % 4 == 3, F.lit("a\tb\tc")).when(k % 4 == 2, F.lit("# note")).otherwise(F.concat("n_name", F.lit("\tx")))
    return scans.name_map(read_table(spark, d, "nation").select(k.alias("pos"), line.alias("line")))[1]


@query("SELECT doc_id AS id, 'why ' || doc_id || chr(10) AS body FROM labels WHERE quality = 1")
def review_sections(spark, d):
    rows = read_table(spark, d, "labels").where("quality is not null").dropDuplicates(["doc_id"])
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## Statement "), "doc_id")).otherwise(F.concat(F.lit("## Statement "), "doc_id", F.lit(" - a note")))
    body = F.when(F.col("quality") == 1, F.concat(F.lit("why "), "doc_id")).otherwise(F.lit("  "))
    other = F.when(F.col("quality") == 1, "").otherwise(F.concat(F.lit("## Statement "), "doc_id", F.lit("x")))
    lines = rows.select("doc_id", F.posexplode(F.array(head, body, other)).alias("i", "line"))
    return scans.sections(lines.select((F.col("doc_id") * 3 + F.col("i")).alias("pos"), "line"))


@query("SELECT o_orderkey AS id, o_orderpriority AS text FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def statement_lookup(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    return scans.statement(rows, rows.agg(F.max("id")).first()[0])


@query(
    """SELECT 'edge-line' AS rule, 'CALL' || chr(9) || 'a.py' || chr(9) || l_returnflag || chr(9) || 'b.py' || chr(9) || l_linenumber AS detail FROM lineitem WHERE l_quantity < 3 AND l_linenumber < 6
UNION ALL SELECT 'edge-columns', 'CALL' || chr(9) || l_orderkey FROM lineitem WHERE l_linenumber = 7
UNION ALL SELECT 'edge-utf8', 'y: CALL' || chr(9) || chr(65533) || chr(9) || l_orderkey || chr(9) || 'b' || chr(9) FROM lineitem WHERE l_linenumber = 6"""
)
def edge_violations(spark, d):
    line = read_table(spark, d, "lineitem")
    n, few = F.col("l_linenumber"), F.col("l_quantity") < 3
    good = F.concat_ws("\t", F.lit("CALL"), F.lit("a.py"), F.when(few, F.col("l_returnflag")).otherwise(F.col("l_orderkey").cast("string")), F.lit("b.py"), n.cast("string"))
    odd = F.concat(F.lit("CALL\t").cast("binary"), F.lit(bytes([0xFF])), F.concat(F.lit("\t"), "l_orderkey", F.lit("\tb\t")).cast("binary")).cast("string")
    value = F.when(n == 7, F.concat(F.lit("CALL\t"), "l_orderkey")).when(n == 6, odd).otherwise(good)
    return scans.edge_rows(line.select(F.lit("y").alias("graph"), value.alias("value")))[1]


@query("SELECT 'names-absent' AS rule, o_orderstatus AS detail FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus")
def refs_without_record(spark, d):
    o = read_table(spark, d, "orders")
    return edges.refs_without_record(o.select(F.col("o_orderstatus").alias("graph"), F.when(F.col("o_orderpriority") == "1-URGENT", "REF").otherwise("CALL").alias("kind")), None)


@query("SELECT 'scope-missing' AS rule, c_name AS detail FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'scope-not-application', c_name FROM customer WHERE c_custkey % 5 = 1")
def registered_roles(spark, d):
    c = read_table(spark, d, "customer")
    register = c.where("c_custkey % 5 > 0").select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 5 == 1, "test").otherwise("application").alias("role"), F.lit("why").alias("evidence"))
    return scans.registered_roles(c.select(F.col("c_name").alias("path")), register)


# --- counts -------------------------------------------------------------------


@query("SELECT o_orderstatus AS graph, count(*) AS edges FROM orders GROUP BY 1")
def edges_per_graph(spark, d):
    return edges.rows_per_graph(read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("graph")))


@query(
    """SELECT 'lines' AS producer, count(*) AS "rows", (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem)) AS links FROM lineitem
UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) FROM orders"""
)
def links_per_producer(spark, d):
    line = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"))
    order = read_table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.lit(0).cast("long").alias("target"), F.col("o_orderstatus").alias("kind"))
    return edges.per_producer(lines=line, orders=order)


@query(
    """WITH g AS (SELECT l_returnflag AS kind, l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL)
SELECT kind, count(*) AS links, (sum(n) - count(*))::BIGINT AS repeats FROM g GROUP BY kind"""
)
def repeated_links(spark, d):
    line = read_table(spark, d, "lineitem")
    outcome = F.when(F.col("l_linenumber") < 5, "between two").otherwise("structural")
    return edges.repeats(line.select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), outcome.alias("outcome")))


@query("(SELECT c_name AS name FROM customer ORDER BY c_name LIMIT 20) UNION ALL SELECT 'and ' || (count(*) - 20) || ' more' FROM customer HAVING count(*) > 20")
def first_names(spark, d):
    return report.named(read_table(spark, d, "customer"), "c_name", report.NAMED_IMPORTS)


# --- integrity rules ----------------------------------------------------------------


@query("SELECT 'unsplit' AS rule, c_name AS detail FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'unresolved', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'never-examined', o_orderkey::VARCHAR FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O'")
def classified_violations(spark, d):
    """V2, V8."""
    o = read_table(spark, d, "orders")
    states = o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").alias("visited"),
        (F.col("o_orderstatus") == "P").alias("unresolved"),
        (F.col("o_orderstatus") == "P").alias("reviewed"),
        F.when(F.col("o_orderpriority") == "5-LOW", "untouched").otherwise("unreached").alias("machine_state"),
    )
    return checks.all_of(checks.all_split(read_table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("file"))), checks.all_classified(states))


@query(
    """SELECT 'queued' AS rule, l_orderkey::VARCHAR AS detail FROM lineitem WHERE l_linenumber = 7
UNION ALL SELECT 'open-round', user_id::VARCHAR FROM (SELECT arg_max(user_id, event_id) AS user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id % 2 = 1) WHERE user_id % 10 <> 0"""
)
def open_round_violations(spark, d):
    """V5: hands and answers by event; every second event is one, the last of them a hand."""
    e = read_table(spark, d, "events").where("event_id % 2 = 1")
    last = e.agg(F.max("event_id")).first()[0]
    kind = F.when((F.col("event_id") == last) | (F.col("event_type") == "view"), "hand").otherwise("record")
    log = e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("id"))
    states = e.select(F.col("user_id").alias("id"), (F.col("user_id") % 10 == 0).alias("visited")).distinct()
    queued = read_table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("id"))
    return checks.nothing_open(queued, workflow.handed(log, states))


@query("SELECT 'machine-phase' AS rule, 'walk' AS detail UNION ALL SELECT 'graph-absent', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '2-HIGH'")
def phase_violations(spark, d):
    """V6: since the last reset there were a fill and the load graph, but no walk and no name graph."""
    o = read_table(spark, d, "orders")
    states = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("visited"), F.when(F.col("o_orderpriority") == "2-HIGH", "unreached").otherwise("reached").alias("machine_state"))
    rows = [(1, "fill", None), (1, "graph", "LOADS"), (1, "graph", "USES"), (2, "state", "reached"), (3, "reset", None), (4, "fill", None), (4, "graph", "LOADS"), (5, "record", None)]
    log = spark.createDataFrame(rows, "seq long, type string, text string")
    return checks.machine_done(states, workflow.since_reset(log))


@query("SELECT 'fill-sums' AS rule, unnest(['missing links/N', 'changed links/A', 'extra links/X', 'changed manifest']) AS detail")
def sums_violations(spark, d):
    """V7: of the stored links, kind N is gone, A lost some, R is the same in another order, X is new."""
    line = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"))
    lost = line.where("kind = 'A'").agg(F.min("source")).first()[0]
    now = line.where(~((F.col("kind") == "A") & (F.col("source") == lost)) & (F.col("kind") != "N")).repartition(3)
    now = now.unionByName(line.where("kind = 'R'")).unionByName(line.limit(1).withColumn("kind", F.lit("X")))
    files = read_table(spark, d, "customer").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("sha256"))
    old, new = checks.manifest_sum(files), checks.manifest_sum(files.withColumn("sha256", F.concat("sha256", F.lit("x"))))
    return checks.sums_equal(checks.link_sums(line).unionByName(old), checks.link_sums(now).unionByName(new))


CHAIN = """WITH ch AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prv FROM orders)"""


def _columns(spark, d) -> tuple[DataFrame, DataFrame]:
    """Chains of orders as links, and stored columns: two steps for each id, of which the first is wrong and every fifth id's last."""
    from pyspark.sql import Window

    o, w = read_table(spark, d, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ch = materialize(o.select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("nxt"), F.lag("o_orderkey").over(w).alias("prv")), "chain")
    links = ch.where("nxt is not null").select(F.col("id").alias("source"), F.col("nxt").alias("target"), F.lit("LOADS").alias("kind"))
    some = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<long>")).otherwise(F.array(c))
    touched = ch.where("nxt is not null or prv is not null")
    wrong = touched.select(F.lit(1).cast("long").alias("seq"), "id", F.array("id").alias("inputs"), F.array().cast("array<long>").alias("outputs"))
    last = touched.select(F.lit(2).cast("long").alias("seq"), "id", some("prv").alias("inputs"), F.when(F.col("id") % 5 == 0, F.array("id")).otherwise(some("nxt")).alias("outputs"))
    untouched = ch.where("nxt is null and prv is null").select(F.lit(1).cast("long").alias("seq"), "id", F.lit(None).cast("array<long>").alias("inputs"), F.lit(None).cast("array<long>").alias("outputs"))
    return links, wrong.unionByName(last).unionByName(untouched)


@query(f"{CHAIN} SELECT 'columns' AS rule, id::VARCHAR AS detail FROM ch WHERE id % 5 = 0 AND (nxt IS NOT NULL OR prv IS NOT NULL)")
def columns_violations(spark, d):
    """V9, J19, W15."""
    links, stored = _columns(spark, d)
    return checks.columns_agree(workflow.latest_columns(stored), links)


@query("SELECT 'created-by' AS rule, c_mktsegment AS detail FROM customer WHERE c_custkey <= 3 AND c_mktsegment <> 'tracewell' UNION ALL SELECT 'schema-version', c_custkey::VARCHAR FROM customer WHERE c_custkey <= 3 AND c_custkey <> 2 UNION ALL SELECT 'meta-rows', count(*)::VARCHAR FROM customer WHERE c_custkey <= 3")
def guard_violations(spark, d):
    """S14."""
    c = read_table(spark, d, "customer").where("c_custkey <= 3")
    return scans.guard(c.select(F.col("c_mktsegment").alias("created_by"), F.col("c_custkey").cast("int").alias("schema_version")), 2)


@query(
    """SELECT 'statement-twice' AS rule, l_orderkey::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
UNION ALL SELECT 'selector-unknown', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'entry-unknown', n_nationkey::VARCHAR FROM nation WHERE n_nationkey NOT IN (SELECT l_orderkey FROM lineitem)"""
)
def init_violations(spark, d):
    """W2."""
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    selectors = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("statement_id"))
    return checks.consistent(rows, selectors, read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


# --- commands of the review ----------------------------------------------------------


def _nations(spark, d) -> workflow.Review:
    """Nations as statements, linked within their region in order; nation 0 is the entry, that of region 1's first is demoted."""
    from pyspark.sql import Window

    n = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("r"), "n_regionkey", F.lit(".py")).alias("file"), F.col("n_regionkey").alias("r"))
    n = materialize(n, "nations")
    after = F.lead("id").over(Window.partitionBy("r").orderBy("id"))
    links = n.select(F.col("id").alias("source"), after.alias("target"), F.lit("LOADS").alias("kind")).where("target is not null")
    first = n.where("r = 1").agg(F.min("id").alias("id"))
    entries = n.agg(F.min("id").alias("id")).unionByName(first)
    review = workflow.Review(spark, f"{shared_dir(spark)}/review-{uuid.uuid4().hex}", n.select("id", "file"), entries, first)
    review.fill(links)
    review.walk()
    return review


NATIONS = """WITH n AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation),
z AS (SELECT r FROM n ORDER BY id LIMIT 1), s AS (SELECT *, r = (SELECT r FROM z) AND id >= (SELECT min(id) FROM n) AS reached FROM n)"""


@query(f"{NATIONS} SELECT id, reached AS visited, CASE WHEN reached THEN 'machine' END AS visited_by, NOT reached AND k > 1 AS unresolved, CASE WHEN reached THEN 'reached' WHEN k > 1 THEN 'unreached' ELSE 'untouched' END AS machine_state FROM s")
def walk_and_sweep(spark, d):
    """Fill, walk, and a sweep that takes the unreached too."""
    review = _nations(spark, d)
    review.sweep(unreached=True)
    return review.states().select("id", "visited", "visited_by", "unresolved", "machine_state")


@query(
    f"""{NATIONS}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS j FROM s WHERE NOT reached AND k > 1)
SELECT s.id, reached OR coalesce(j = 1, false) AS visited, CASE WHEN reached THEN 'machine' WHEN j = 1 THEN 'intelligence' END AS visited_by, coalesce(j > 3, false) AS unresolved, coalesce(j <= 3, false) AS reviewed,
  CASE WHEN j = 1 THEN 'resolved' WHEN j <= 3 THEN 'reopened' END AS review, coalesce(j = 2 OR j = 4, false) AS queued FROM s LEFT JOIN o ON o.id = s.id"""
)
def review_commands(spark, d):
    """Of the swept cases the first is resolved with the fourth as an output, the second reopened and queued, the third reopened for nothing."""
    review = _nations(spark, d)
    a, b, c, e = [r["id"] for r in review.sweep(unreached=True).orderBy("id").limit(4).collect()]
    review.resolve(a, outputs=[e])
    review.reopen(b, "queue")
    review.reopen(c, "none")
    states, log = review.states(), review.log()
    queued = workflow.queue(states, log).withColumn("queued", F.lit(True))
    return states.join(queued, "id", "left").select("id", "visited", "visited_by", "unresolved", "reviewed", "review", F.coalesce("queued", F.lit(False)).alias("queued"))


@query(
    f"""{NATIONS}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS j FROM s WHERE NOT reached AND k > 1), c AS (SELECT count(*) AS n FROM o)
SELECT 0::BIGINT AS unresolved, 1::BIGINT AS queued, 0::BIGINT AS entries, (SELECT count(*) FROM s WHERE NOT reached AND k = 1) AS never_examined, false AS done, (SELECT n - 1 FROM c) AS suspected"""
)
def finish_counts(spark, d):
    """The first case resolved, the second queued, all others reopened for nothing."""
    review = _nations(spark, d)
    ids = [r["id"] for r in review.sweep(unreached=True).orderBy("id").collect()]  # the nations
    review.resolve(ids[0])
    review.reopen(ids[1], "queue")
    review._append([("reopen", i, None, "none") for i in ids[2:]])
    end = review.finish()
    left = end["left"]
    return end["suspected"].agg(F.count("*").alias("suspected")).select(*[F.lit(left[k]).cast("long").alias(k.replace(" ", "_")) for k in ("unresolved", "queued", "entries", "never examined")], F.lit(end["done"]).alias("done"), "suspected")


@query(f"{NATIONS} SELECT id, false AS visited, NULL::VARCHAR AS machine_state, 0::BIGINT AS machine_links, CASE WHEN k > 1 THEN true ELSE false END AS emptied FROM s")
def reset_flags(spark, d):
    """After a reset no machine mark, link, state or column counts."""
    review = _nations(spark, d)
    review.reset(confirm=True)
    links = workflow.log_links(review.log()).where("origin = 'machine'").count()
    gone = review.columns().where("inputs is null and outputs is null").select("id", F.lit(True).alias("emptied"))
    rows = review.states().join(gone, "id", "left")
    return rows.select("id", "visited", "machine_state", F.lit(links).cast("long").alias("machine_links"), F.coalesce("emptied", F.lit(False)).alias("emptied"))


@query(f"{NATIONS} SELECT i AS place, id FROM (SELECT id, row_number() OVER (ORDER BY id) AS i FROM s WHERE NOT reached AND k > 1)")
def unresolved_queue(spark, d):
    """W13, O6."""
    review = _nations(spark, d)
    review.sweep(unreached=True)
    rows = [(i + 1, r["id"]) for i, r in enumerate(review.unresolved().select("id").collect())]  # the nations, in the queue's order
    return spark.createDataFrame(rows, "place long, id long")


@query(
    """WITH l AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem)
SELECT row_number() OVER (ORDER BY source, target) AS place, source || chr(9) || target AS line FROM l"""
)
def sorted_sink(spark, d):
    """O1: links written as text, sorted by both ends; read back in the order of the files."""
    links = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    path = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}.tsv"
    scans.write_tsv(links, path, ["source", "target"])
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    per = materialize(rows, "lines")
    before = per.groupBy("f").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    files = sorted(before.collect(), key=lambda r: r["f"])  # a row per written file
    base, table = 0, []
    for r in files:
        table.append((r["f"], base, r["least"]))
        base += r["n"]
    known = spark.createDataFrame(table, "f string, base long, least long")
    return per.join(F.broadcast(known), "f").select((F.col("base") + F.col("i") - F.col("least") + 1).alias("place"), F.col("value").alias("line"))


# --- whole projects, written to the shared folder -------------------------------------


def _write(spark, files: dict[str, bytes]) -> str:
    """A folder of these small files; returns its path."""
    root = f"{shared_dir(spark)}/project-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(content), 0, len(content))
        out.close()
    return root


def _nation_rows(spark, d) -> list:
    return read_table(spark, d, "nation").orderBy("n_nationkey").collect()  # the nations


TREE = """WITH k AS (SELECT n_nationkey AS k, n_nationkey % 5 AS m FROM nation),
t AS (SELECT k, m, CASE m WHEN 0 THEN 'a/n' || k || '.py' WHEN 1 THEN 'a/_n' || k || '.ts' WHEN 2 THEN '.n' || k || '/x.css' WHEN 3 THEN 'node_modules/n' || k || '.js' ELSE 'b/n' || k || '.sh' END AS path FROM k)"""


def _tree(spark, d) -> tuple[str, list[str]]:
    """Files of five kinds: plain, with an underscore, in a folder with a dot, in node_modules, and, empty or of odd bytes, scripts."""
    files = {}
    for r in _nation_rows(spark, d):
        k = r["n_nationkey"]
        path = (f"a/n{k}.py", f"a/_n{k}.ts", f".n{k}/x.css", f"node_modules/n{k}.js", f"b/n{k}.sh")[k % 5]
        files[path] = f"x{k}\n".encode() if k % 5 < 4 else b"" if k % 2 else b"\xff\n"
    return _write(spark, files), sorted(files)


@query(f"{TREE} SELECT path FROM t WHERE m <> 3")
def live_tree(spark, d):
    """S17."""
    return scans.tree(spark, _tree(spark, d)[0], content=False)


@query(
    f"""{TREE} SELECT path, CASE WHEN m = 4 AND k % 2 = 0 THEN 'quarantined' WHEN m = 3 THEN 'missing' ELSE 'copied' END AS state FROM t WHERE m > 0
UNION ALL SELECT 'gone/n' || k || '.py', 'missing' FROM t WHERE m = 0"""
)
def snapshot_states(spark, d):
    """A list that names all but the plain files, and some that are not there."""
    from tracewell.plans import analysis

    root, paths = _tree(spark, d)
    listed = [p for p in paths if not p.startswith("a/n")] + [p.replace("a/", "gone/") for p in paths if p.startswith("a/n")]
    project = analysis.take_snapshot(spark, root, spark.createDataFrame(list(enumerate(listed)), "pos int, line string"))
    copied = project.manifest.select("path", F.lit("copied").alias("state"))
    return copied.unionByName(project.missing.select("path", F.lit("missing").alias("state"))).unionByName(project.quarantined.select(F.col("file").alias("path"), F.lit("quarantined").alias("state")))


@query("SELECT 'r' || n_regionkey AS graph, 'CALL' AS kind, 'src/n' || n_nationkey || '.py' AS from_file, n_nationkey::INTEGER AS from_line, CASE WHEN n_nationkey % 2 = 0 THEN 'src/lib/x.py' ELSE '' END AS to_file, CASE WHEN n_nationkey % 2 = 0 THEN 7 END::INTEGER AS to_line, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE '' END AS to_code FROM nation")
def edge_export_files(spark, d):
    """A file per region, of five and of twelve columns, with prefixes."""
    files: dict[str, str] = {}
    for r in _nation_rows(spark, d):
        k = r["n_nationkey"]
        to, line = ("lib\\x.py", "7") if k % 2 == 0 else ("", "")
        row = ["CALL", f"n{k}.py", str(k), "m", "l", "c", to, line, "m", "l", r["n_name"], "v"] if k % 3 == 0 else ["CALL", f"n{k}.py", str(k), to, line]
        name = f"edges-r{r['n_regionkey']}.tsv"
        files[name] = files.get(name, "") + "\t".join(row) + "\n"
    root = _write(spark, {k: v.encode() for k, v in files.items()} | {"other.tsv": b"no\n"})
    prefixes, broken = scans.name_map(spark.createDataFrame([(i, f"r{i}\tsrc/") for i in range(5)], "pos int, line string"))
    scans.refuse(broken)
    rows, broken = scans.edge_exports(spark, root, prefixes)
    scans.refuse(broken)
    return rows.select("graph", "kind", "from_file", "from_line", "to_file", "to_line", "to_code")


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS c, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS prv FROM nation)
SELECT 'lib/r' || r || '.py' AS file, i::INTEGER AS first_line, i::INTEGER AS last_line, CASE WHEN c > 1 THEN 'unreached' ELSE 'untouched' END AS machine_state, nxt IS NOT NULL AS has_input, prv IS NOT NULL AS has_output, CASE WHEN r = 2 THEN 'changed' ELSE 'same' END AS live_file
FROM n WHERE r <> (SELECT arg_min(n_regionkey, n_nationkey) FROM nation)"""
)
def final_list_of_a_project(spark, d):
    """From files to the list; a function per nation calls the next of its
    region's file, which so is its input, and main calls the first."""
    from tracewell.plans import analysis

    rows = _nation_rows(spark, d)
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["n_regionkey"], []).append(r["n_nationkey"])
    first = rows[0]
    text = lambda keys: "".join(f"def f{k}(): return {f'f{after}()' if after is not None else 1}\n" for k, after in zip(keys, [*keys[1:], None]))
    files = {f"lib/r{r}.py": text(keys) for r, keys in by.items()}
    files["main.py"] = f"from lib.r{first['n_regionkey']} import f{first['n_nationkey']}\n\nf{first['n_nationkey']}()\n"
    root = _write(spark, {k: v.encode() for k, v in files.items()})
    project = analysis.take_snapshot(spark, root, spark.createDataFrame(list(enumerate(files)), "pos int, line string"))
    entries = project.statements.where("file = 'main.py' and first_line = 3").select("id")
    found = analysis.derive(project, entries)
    review = workflow.Review(spark, f"{shared_dir(spark)}/review-{uuid.uuid4().hex}", project.statements, entries, found["demoted"])
    review.fill(found["links"], found["graphs"], project.manifest)
    review.walk()
    cases = review.sweep()
    none = F.lit(None).cast("long").alias("other")
    review._append(cases.select(F.lit("reopen").alias("type"), "id", none, F.lit("none").alias("text")))
    live = scans.tree(spark, root).withColumn("content", F.when(F.col("path") == "lib/r2.py", F.concat("content", F.lit(b"#"))).otherwise(F.col("content")))
    listed, _ = analysis.final_list(project, review, live, 10**6, found["links"])
    return listed.select("file", "first_line", "last_line", "machine_state", (F.col("inputs") != "").alias("has_input"), (F.col("outputs") != "").alias("has_output"), "live_file")
