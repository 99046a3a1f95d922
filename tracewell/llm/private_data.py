"""Personal data: patterns, and terms that disclose what the patterns found.

Patterns find e-mail and IP addresses, card and phone numbers, and secrets (long runs
of letters and digits, as keys and tokens are): the protected entities. Corpus co-occurrence then estimates how strongly each term of the texts
that hold an entity reveals it. Counts are of whole documents: n(t), n(e), n(t,e)
of N. With p(e) = n(e) / N and SUPPORT documents that tell nothing added to the
term's, p(e|t) = (n(t,e) + SUPPORT p(e)) / (n(t) + SUPPORT). A term discloses an
entity if it makes it likely, p(e|t) >= LIKELY, and tells enough about it,
log2(p(e|t) / p(e)) >= BITS; so a term of one document discloses what only that
document holds, and an address that stands in every copy of a licence has too
little information to be disclosed. Terms that disclose are spans of kind `term`
wherever they occur, in texts without an entity too, and are removed; patterns'
spans are generalised to their kind. As p(e|t) is likely, such texts without the
entity are the lesser part of a term's texts.

Entities that stand in the same documents are counted once, and so are terms; a
text of many addresses and words gives a few pairs of such classes, not a pair for
each address and word.

Everything is made of built-in expressions. A match's place is the summed
length of the pieces that `split` leaves before it and of earlier matches. Sums
run over arrays in two levels, so that n matches cost n ** 1.5 steps within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import free_names, materialize

# Possessive forms of the patterns: what follows a repeated class never begins
# with a member of it, so giving back cannot help; a match cannot begin inside
# a run of its first class except where the last one ended. Both keep long runs linear.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that the method adds to those.
ADDED = {"secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{32,}+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[...]"}
#: What a term has to make of an entity's probability, and how many bits it has to tell about it.
LIKELY, BITS = 2 / 3, 6.0
#: Documents that tell nothing, added to those of each term.
SUPPORT = 0.5
#: Terms or keys, and bytes of them, up to which their table is sent to all executors.
SMALL, SMALL_BYTES = 200_000, 8_000_000
TERM = r"\p{L}{3,}+"
SPAN = "array<struct<kind:string,s:int,e:int,m:string>>"
#: Code points of a text that are cut out at once.
BLOCK = 1024


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, step, zero: int) -> Column:
    """The running step(a, b), an associative one, of an array of integers."""

    def run(part: Column) -> Column:
        none = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            return F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out"))

        return F.aggregate(part, none, add, lambda acc: acc["out"])

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / width).cast("int")), lambda i: F.slice(v, i * width + 1, width))

    def join(parts: Column) -> Column:
        ends = run(F.transform(parts, lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(zero))))
        before = F.slice(F.concat(F.array(F.lit(zero)), ends), 1, F.size(parts))
        return F.flatten(F.zip_with(before, parts, lambda b, a: F.transform(a, lambda x: step(b, x))))

    return _let(values, lambda v: _let(F.transform(cut(v), run), join))


def _sums(values: Column) -> Column:
    return _running(values, lambda a, b: a + b, 0)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches, as an array of (kind, start, end, text); code points, end exclusive."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(b: Column) -> Column:
        ends = _sums(F.transform(b, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        each = F.zip_with(b, ends, lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m")))
        return F.filter(each, lambda x: x["m"].isNotNull())

    return _let(both, placed)


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: F.coalesce(_passes(kind, x["m"]), F.lit(False))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def entity_spans(text: Column) -> Column:
    """All patterns' spans by kind as in KINDS and ADDED, then by start. text must not be null."""
    need = {"secret": text.rlike("[A-Za-z0-9]{32}"), "email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]")}
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(need[k], F.filter(matches(text, p, k), _check(k))).otherwise(none) for k, p in (KINDS | ADDED).items()])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: 128 bits of the id and the text, the same for equal rows."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), _key(F.col(id_col), t).alias("key"))


def _key(number: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("null")), F.lit("\0"), text).cast("binary"))


def _words(text: Column) -> Column:
    """The different terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _small(keys: DataFrame) -> DataFrame:
    """A column of strings, to be broadcast where its size allows it."""
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length(keys.columns[0])).alias("bytes")).first()
    return F.broadcast(keys) if size["n"] <= SMALL and (size["bytes"] or 0) <= SMALL_BYTES else keys


def _same_documents() -> list[Column]:
    """128 bits of the set of documents of a group of rows of different keys."""
    return [F.bit_xor(F.xxhash64("key")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("x2")]


def disclosing(found: DataFrame, rows: DataFrame, total: int, likely: float = LIKELY, bits: float = BITS, support: float = SUPPORT) -> DataFrame:
    """(word): the terms that disclose an entity of found(key, text, spans), by their documents in rows(text)."""

    def p(both: Column, own: Column, n: Column) -> Column:
        return (both + support * own / total) / (n + support)

    def discloses(both: Column, own: Column, n: Column) -> Column:
        return (p(both, own, n) >= likely - 1e-9) & (F.log2(p(both, own, n) * total / own) >= bits - 1e-9)

    name = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], F.lower(x["m"])))
    held = found.select("key", F.explode(F.array_distinct(name)).alias("entity"))
    # whatever the term, it tells no more than log2(1 / p(e))
    own = held.groupBy("entity").agg(F.count("*").alias("own"), *_same_documents()).where(F.col("own") * 2.0**bits <= total)
    classes = own.groupBy("own", "x1", "x2").agg(F.min("entity").alias("entity")).select("entity", "own")
    held = materialize(held.join(classes, "entity"), "held")
    most = held.groupBy("key").agg(F.max("own").alias("most"))
    words = materialize(found.select("key", F.explode(_words(F.col("text"))).alias("word")).join(most, "key"), "words")
    # n(t) is `seen` at least, and n(t, e) the largest n(e) at most
    able = words.groupBy("word").agg(F.count("*").alias("seen"), F.max("most").alias("most"), *_same_documents())
    able = materialize(able.where(p(F.col("most"), F.col("most"), F.col("seen")) >= likely - 1e-9), "able")
    terms = able.groupBy("seen", "x1", "x2").agg(F.min("word").alias("term"))
    pairs = words.select("key", F.col("word").alias("term")).join(terms.select("term", "seen"), "term").join(held, "key")
    pairs = pairs.groupBy("term", "entity").agg(F.count("*").alias("both"), F.first("own").alias("own"), F.first("seen").alias("seen"))
    pairs = pairs.where(discloses(F.col("both"), F.col("own"), F.col("seen"))).select("term", "both", "own").distinct()
    asked = able.join(terms, ["seen", "x1", "x2"]).select("word", "term").join(pairs, "term")
    asked = materialize(asked.select("word", "both", "own"), "asked")
    n = rows.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return n.join(asked, "word").where(discloses(F.col("both"), F.col("own"), F.col("n"))).select("word").distinct()


def _free(spans: Column, terms: Column) -> Column:
    """The terms that no span touches. Both lists get in order; the last end before and the next start after tell."""
    order = F.concat(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("t"), x["e"].alias("e"), x["m"].alias("m"))), F.transform(terms, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("t"), x["e"].alias("e"), x["m"].alias("m"))))
    far = 2**31 - 1

    def keep(o: Column) -> Column:
        ends = _running(F.transform(o, lambda x: F.when(x["t"] == 0, x["e"]).otherwise(0)), F.greatest, 0)
        starts = F.reverse(_running(F.reverse(F.transform(o, lambda x: F.when(x["t"] == 0, x["s"]).otherwise(far))), F.least, far))
        each = F.arrays_zip(o.alias("o"), ends.alias("end"), starts.alias("start"))
        kept = F.filter(each, lambda x: (x["o"]["t"] == 1) & (x["end"] <= x["o"]["s"]) & (x["start"] >= x["o"]["e"]))
        return F.transform(kept, lambda x: F.struct(F.lit("term").alias("kind"), x["o"]["s"].alias("s"), x["o"]["e"].alias("e"), x["o"]["m"].alias("m")))

    return F.when(F.size(spans) == 0, F.array_sort(terms, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))).otherwise(_let(F.array_sort(order), keep))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likely: float = LIKELY, bits: float = BITS, support: float = SUPPORT) -> DataFrame:
    """(key, spans): the spans of each row that has any.

    spans: array of (kind, s, e, m) by kind (patterns as in KINDS and ADDED, then
    terms that do not touch those), then start. Counts are over all documents; null
    texts count as empty; equal rows have equal keys and spans, and the same key
    appears once. An empty table gives no rows; other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    found = rows.withColumn("spans", entity_spans(F.col("text"))).where(F.size("spans") > 0).dropDuplicates(["key"])
    found = materialize(found, "found")
    named = materialize(disclosing(found, rows, max(1, docs.count()), likely, bits, support), "named")
    out = found.select("key", "spans")
    if not named.limit(1).count():
        return out
    known = _small(named)
    marked = rows.select("key", F.explode(_words(F.col("text"))).alias("word")).join(known, "word", "left_semi").select("key").distinct()
    texts = rows.join(_small(materialize(marked, "marked")), "key", "left_semi")
    each = texts.select("key", F.explode(matches(F.col("text"), TERM, "term")).alias("x")).select("key", F.lower("x.m").alias("word"), "x.s", "x.e")
    each = each.join(known, "word", "left_semi")
    # equal rows give equal spans
    terms = each.groupBy("key").agg(F.collect_set(F.struct(F.lit("term").alias("kind"), "s", "e", F.col("word").alias("m"))).alias("terms"))
    none = F.array().cast(SPAN)
    both = out.join(terms, "key", "full").select("key", F.coalesce("spans", none).alias("spans"), F.coalesce(F.col("terms").cast(SPAN), none).alias("terms"))
    both = both.select("key", F.concat("spans", F.when(F.size("terms") > 0, _free(F.col("spans"), F.col("terms"))).otherwise(none)).alias("spans"))
    return both.where(F.size("spans") > 0)


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as text), n_spans.

    Null and empty texts have no spans; rows that repeat each get a row; an empty
    table gives no rows; other columns are not read.
    """
    found = find(docs, id_col, text_col, **settings)
    rows = _rows(docs, id_col, text_col).select("doc_id", "key").join(found, "key", "left")
    spans = F.coalesce("spans", F.array().cast(SPAN))

    def text_of(x: Column) -> Column:
        return F.concat_ws(",", F.transform(x, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))))

    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter(spans, lambda x: x["kind"].isin(*KINDS))
    return rows.select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def _between(spans: Column, length: Column) -> Column:
    """(s, e, kind): the pieces of a text before each span, overlapping ones as one, and after the last."""
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))

    def cut(o: Column) -> Column:
        reach = _running(F.transform(o, lambda x: -x["e"]), F.greatest, 0)

        def pieces(r: Column) -> Column:
            before = F.slice(F.concat(F.array(F.lit(0)), r), 1, F.size(o))
            each = F.zip_with(before, o, lambda b, x: F.struct(b.alias("s"), x["s"].alias("e"), x["kind"].alias("kind")))
            last = F.struct(F.coalesce(F.get(r, F.size(r) - 1), F.lit(0)).alias("s"), length.alias("e"), F.lit(None).cast("string").alias("kind"))
            return F.concat(F.filter(each, lambda x: x["s"] <= x["e"]), F.array(last))

        return _let(reach, pieces)

    return _let(by_start, cut)


def _part(blocks: Column, s: Column, e: Column) -> Column:
    """The code points from s up to e of a text in blocks of BLOCK code points."""
    first = F.floor(s / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((e - 1) / BLOCK).cast("int") - first + 1)

    def own(block: Column, i: Column) -> Column:
        at = (first + i) * BLOCK
        skip = F.greatest(s - at, F.lit(0))
        return F.substring(block, skip + 1, F.least(e - at, F.lit(BLOCK)) - skip)

    return F.when(s < e, F.array_join(F.transform(some, own), "")).otherwise("")


def replaced(text: Column, spans: Column) -> Column:
    """text with the spans generalised (patterns) or removed (terms)."""
    general = F.create_map(*[F.lit(x) for kv in GENERAL.items() for x in kv])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    put = lambda b: F.array_join(F.transform(_between(spans, F.length(text)), lambda x: F.concat(_part(b, x["s"], x["e"]), F.coalesce(general[x["kind"]], F.lit("")))), "")
    return _let(blocks, put)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with spans generalised (patterns) or removed (terms) in the text; columns stay.

    Overlapping spans become one, named by the first. Texts without spans,
    null ones included, stay as they are; rows that repeat all stay; an empty
    table gives no rows; docs may have columns of any names.
    """
    key, found_key, spans = free_names(docs, "key", "found_key", "spans")
    found = find(docs, id_col, text_col, **settings).select(F.col("key").alias(found_key), F.col("spans").alias(spans))
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.withColumn(key, _key(F.col(id_col), t)).join(found, F.col(key) == F.col(found_key), "left")
    clean = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(replaced(t, F.col(spans)))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
