import base64
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import byte_bpe, language_id, masked_lm, mixing, private_data, quality, url_filter
from tracewell.runtime import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codecs():
    with open(VOCABULARY, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}
    return byte_bpe.Codec(data, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(codecs, text):
    own, library = codecs
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = library.encode_ordinary(text)
    assert own.encode(text) == ids and own.decode(ids) == text.encode()


def test_bpe_rows(spark, codecs):
    texts = [None, "", "<|endoftext|> ⁇unknown ▁x", "a" * 5000, " \n\t  x", "naïve 日本 😀", "long words of all kinds " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as n_tokens")
    odd = spark.createDataFrame([(None, "x y"), (3, "z"), (3, "z")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in byte_bpe.encode_documents(odd, VOCABULARY, public_tokenizers.PATTERN).collect()) == [("3", 1), ("3", 1), ("None", 2)]
    for f in (byte_bpe.digest_documents, byte_bpe.encode_documents):
        assert f(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    for r in byte_bpe.digest_documents(docs, VOCABULARY, public_tokenizers.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        ids = codecs[1].encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = byte_bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(encoded, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} and encoded.where("not round_trip").count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def entity_spans(text):
    secrets = [m.span() for m in re.finditer("(?<![A-Za-z0-9])[A-Za-z0-9]{32,}", text or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return ",".join(filter(None, [base_spans(text), *[f"secret:{s}:{e}" for s, e in secrets]]))


def test_base_spans(spark):
    rng = np.random.default_rng(1)
    pieces = ["a", ".", "@", "b-c", " ", "+", "4111111111111111", "1", "255.", "300", "-", "é", "😀", "(", ")", "x.y@z.w", "12 34", "_"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 30))) for _ in range(400)] + ["", None, "9" * 30000, "a." * 20000 + "@b.c", "1 " * 20000, "+1 " * 9000, "4111 1111 1111 1111", "0001.002.3.255", "key=" + "0a" * 20 + "!", "a" * 40, "1" * 40 + " " + "f" * 31 + "7", "x" * 20000 + "1", "é" + "a1" * 16 + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = private_data.spans_of(docs, support=10**6).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want, every = base_spans(texts[r["doc_id"]]), entity_spans(texts[r["doc_id"]])
        assert r["spans"] == every and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [want.count(k + ":") for k in BASE] and r["n_spans"] == every.count(":") // 2


def plain_spans(rows, likely, bits, support):
    """Spans by counting every pair of a term and an entity."""
    texts = {i: t or "" for i, t in rows}
    words = {i: {w.lower() for w in regex.findall(r"\p{L}{3,}", t)} for i, t in texts.items()}
    entities = {}
    for i, t in texts.items():
        for x in filter(None, entity_spans(t).split(",")):
            kind, s, e = x.split(":")
            entities.setdefault((kind, t[int(s) : int(e)].lower()), set()).add(i)
    total, named = len(rows), set()
    for t in set().union(*words.values()):
        n = {i for i, w in words.items() if t in w}
        for own in entities.values():
            p = (len(n & own) + support * len(own) / total) / (len(n) + support)
            if n & own and p >= likely and np.log2(p * total / len(own)) >= bits:
                named.add(t)
    out = {}
    for i, t in texts.items():
        base = list(filter(None, entity_spans(t).split(",")))
        taken = [tuple(map(int, x.split(":")[1:])) for x in base]
        found = [m.span() for m in regex.finditer(r"\p{L}{3,}", t) if m[0].lower() in named]
        out[i] = ",".join(base + [f"term:{s}:{e}" for s, e in found if not any(a < e and s < b for a, b in taken)])
    return out


def test_disclosing_terms_by_brute_force(spark):
    rng = np.random.default_rng(11)
    contacts = [f"{a}.{b}@site{k}.org" for k, (a, b) in enumerate(zip(["ana", "zoltan", "mira", "oleg"], ["quill", "x", "stone", "berg"]))] + ["10.0.0.7", "0123456789abcdef0123456789abcdef01"]
    owners = [["velvet", "Harbour"], ["cobalt"], ["velvet", "ember"], ["Tundra", "ember", "maple"], ["quartz"], ["saffron"]]
    common = [f"plain{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(160):
        w = list(rng.choice(common, 12))
        for k in rng.choice(6, int(rng.integers(0, 3)), replace=False) if i % 4 == 0 else ():
            w += [contacts[k], *rng.choice(owners[k], 1), contacts[int(rng.integers(0, 6))] if i % 12 == 0 else "tail"]
        if i % 37 == 0:
            w.append(str(rng.choice([x for o in owners for x in o])))
        rows.append((i, " ".join(rng.permutation(w))))
    rows += [(500, None), (501, ""), (502, "xQuartz@y.zz+490001234567quartz")]
    got = private_data.spans_of(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).where("doc_id = 0").collect()
    assert len(got) == 2 and len(set(got)) == 1
    alone = spark.createDataFrame(rows, "doc_id long, text string")
    for likely, bits, support in ((0.5, 2.0, 0.5), (2 / 3, 3.0, 0.5), (0.4, 4.0, 1.0)):
        assert {r["doc_id"]: r["spans"] for r in private_data.spans_of(alone, likely=likely, bits=bits, support=support).collect()} == plain_spans(rows, likely, bits, support)


def test_sanitised_texts(spark):
    rows = [(i, f"intro {w} words about quartz owner reach me a.b@c.de zephyrine tail common", "k") for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    rows += [(100 + i, f"common words about nothing tail owner intro {w} reach plain", "k") for i, w in enumerate(["alpha"] * 60)] + [(7, None, "n"), (8, "", "e"), (9, None, None), (None, "x a.b@c.de y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "key as spans", "1 as found_key")
    clean = private_data.sanitise(docs, bits=3.0)
    assert clean.columns == docs.columns
    clean = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean[0] == "intro alpha words about [...] owner reach me [EMAIL] [...] tail common"
    assert clean[7] is None and clean[8] == "" and clean[100] == rows[4][1] and clean[None] == "x [EMAIL] y"
    assert private_data.sanitise(docs.limit(0)).count() == private_data.spans_of(docs.limit(0)).count() == 0


def test_an_entity_seen_once_is_disclosed(spark):
    rows = [(i, f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(600)] + [(900, "plain words of Quibble by q.r@st.uv")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in private_data.spans_of(docs).collect()}
    assert got[900] == "email:26:35,term:15:22" and set(got.values()) == {"", got[900]}
    # a term that tells the entity is removed from other texts too; an entity of every third text has too few bits
    rows += [(901, "words of quibble by q.r@st.uv"), (902, "words of quibble by q.r@st.uv"), (903, "Quibble, quibble! words"), *((2000 + i, "licence of acme by ask@acme.org") for i in range(300))]
    clean = {r["doc_id"]: r["text"] for r in private_data.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[903] == "[...], [...]! words" and clean[901] == "words of [...] by [EMAIL]" and clean[2000] == "licence of acme by [EMAIL]"


def test_many_spans_in_one_text_take_seconds(spark):
    mails = [f"u{i}@h{i % 7}.org" for i in range(20_000)]
    text = "é " + " ".join(f"{m} wort" for m in mails)
    docs = spark.createDataFrame([(1, text), (2, "wort")], "doc_id long, text string")
    began = time.time()
    row = private_data.spans_of(docs).where("doc_id = 1").first()
    clean = private_data.sanitise(docs).where("doc_id = 1").first()["text"]
    assert time.time() - began < 60
    assert row["n_email"] == 20_000 and row["spans"] == base_spans(text) and clean == "é " + " ".join(["[EMAIL] wort"] * 20_000)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from(["email", "ip", "term"])), max_size=8))
def test_spans_are_replaced_as_by_hand(spark, spans):
    text = "".join(chr(0x1F600 + i % 40) if i % 5 == 0 else chr(97 + i % 26) for i in range(60))
    given_spans = [(k, s, s + n, "") for s, n, k in spans]
    out, at = "", 0
    for kind, s, e, _ in sorted(given_spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += text[at:s] + private_data.GENERAL[kind]
        at = max(at, e)
    df = spark.createDataFrame([(text, given_spans)], f"t string, s {private_data.SPAN}")
    import unittest.mock

    with unittest.mock.patch.object(private_data, "BLOCK", 7):
        got = df.select(private_data.replaced(df["t"], df["s"]).alias("x")).first()["x"]
    assert got == (out + text[at:] if spans else text)


def test_language_models_are_distributions():
    m = language_id.Model({"a": ["abcabcabdabc ab"] * 3, "b": ["ababab cdcd"] * 2})
    chars = [*"abcd", " "]
    for context in ("abc", "zzz", "  a", "cdc"):
        y = np.array([[ord(c) for c in context] + [ord(n)] for n in chars], np.uint64)
        p = np.exp(m._lookup(y.ravel(), np.arange(len(chars)) * 4 + 3, 4)).sum(0)
        assert (p <= 1.001).all() and (p > 0.4).all()


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney by dictionaries: p(last character | those before) of a string."""
    counts = {language_id.ORDER: Counter()}
    for t in texts:
        said = " " * language_id.ORDER + re.sub(r"[\W\d_]+", " ", t.lower()).lstrip(" ")
        counts[language_id.ORDER].update(said[i - language_id.ORDER + 1 : i + 1] for i in range(language_id.ORDER, len(said)))
    for n in range(language_id.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(g):
        c, d = counts[len(g)], language_id.DISCOUNT
        if len(g) == 1:
            total = sum(c.values())
            return max(c[g] - d, 0) / total + d * len(c) / total / language_id.ALPHABET
        low, inside = p(g[1:]), {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        if not inside:
            return low
        total = sum(inside.values())
        return max(inside.get(g, 0) - d, 0) / total + d * len(inside) / total * low

    return p


def test_kneser_ney_by_dictionaries():
    rng = np.random.default_rng(15)
    letters = [*"abcdé", " ", "ß", ". "]
    texts = {k: ["".join(rng.choice(letters, 60, p=w)) for _ in range(6)] for k, w in (("a", [0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]), ("b", [0.05, 0.1, 0.3, 0.2, 0.1, 0.1, 0.1, 0.05]))}
    texts["c"] = ["zyx abc"]
    m = language_id.Model(texts)
    plain = {k: plain_kneser_ney(v) for k, v in texts.items()}
    grams = ["".join(rng.choice([*"abcdéßzq "], 4)) for _ in range(300)]
    y = np.array([[ord(c) for c in g] for g in grams], np.uint64)
    got = np.exp(m._lookup(y.ravel(), np.arange(len(grams)) * 4 + 3, 4))
    for i, g in enumerate(grams):
        assert got[i] == pytest.approx([plain[k](g) for k in m.languages], rel=1e-4), g
    # and of a whole text, per character
    text = "Abc, dé 77 bca!"
    said = "    " + "abc dé bca "
    want = [-np.mean([np.log(plain[k](said[i - 3 : i + 1])) for i in range(4, len(said))]) for k in m.languages]
    h, n = m.entropies([text])
    assert h[0] == pytest.approx(want, rel=1e-4) and n[0] == 8
    m.calibrate(texts)
    assert m.languages[int(h[0].argmin())] == m.judge([text, "ab"])[0][0]


def test_language_id(spark):
    words = {"en": "the of and to in that is was for it with as his on be at by this", "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein", "fr": "le la les des est dans que une pour qui au pas sur plus par avec"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[l].split(), 30)), l, "s") for i, l in enumerate(["en", "de", "fr"] * 80)]
    rows += [(1000, None, "en", "s"), (1001, "12 34 !", "de", "s"), (1002, "", None, "s"), (1003, "привет мир " * 30, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_x string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[i]["lang_pred"] == l and not got[i]["lang_rejected"] for i, _, l, _ in rows[:240])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_rejected"]
    none = language_id.identify(docs.where("doc_id >= 1000 and lang is null"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0
    clash = language_id.identify(docs.selectExpr("doc_id", "text", "lang", "1 as lang_pred", "'x' as LANG_REJECTED"))
    assert clash.columns == ["doc_id", "text", "lang", "lang_pred", "LANG_REJECTED", "lang_pred_", "lang_score", "lang_rejected_"]
    assert {r["doc_id"]: r["lang_pred_"] for r in clash.collect()} == {i: r["lang_pred"] for i, r in got.items()}


def test_copies_of_a_text_are_sampled_once(spark):
    docs = spark.createDataFrame([(1 + 5 * i, "the same words again and again", "en") for i in range(2000)] + [(7 + 5 * i, f"other words {i}", "de") for i in range(40)], "doc_id long, text string, lang string")
    got = language_id.sample(docs, "doc_id", "text", "lang", chars=200)
    assert got["en"] == ["the same words again and again"] and 200 <= sum(map(len, got["de"])) < 240 and len(set(got["de"])) == len(got["de"])


def test_every_label_gets_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{l}{rng.integers(0, 50)}" for _ in range(4000)), l) for l in "abcdefgh" for i in range(1, 3)] + [(i, f"short text {i}", "z") for i in range(2000)]
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows) if zlib.crc32(str(n).encode()) % 5], "doc_id long, text string, lang string")
    got = language_id.sample(docs, "doc_id", "text", "lang", chars=3000)
    assert set(got) == {r["lang"] for r in docs.select("lang").distinct().collect()}
    assert all(3000 <= sum(map(len, v)) < 6000 for v in got.values()) and all(len(v) == 1 for k, v in got.items() if k != "z")


def test_quality_votes(spark):
    rng = np.random.default_rng(3)
    words = [f"wort{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = " ".join(rng.choice(words, 80)) if good else " ".join(f"{w}$$$" for w in rng.choice(words, 80))
        rows.append((i, t, 9))
        labels.append((i, int(good)))
    rows += [(900, "", 1), (901, None, 1), (None, rows[0][1], 1), (1, rows[1][1], 1), (902, "wort1 " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").selectExpr("*", "1 as h", "2 as score")
    space = quality.learn(docs, spark.createDataFrame(labels + [(5, None), (7777, 1), (None, 1), (1, 1)], "doc_id long, quality int"))
    scored = quality.score(docs, space).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    got = {r["doc_id"]: r["score"] for r in scored}
    assert all((got[i] >= 0.3) == bool(q) for i, q in labels)
    assert got[900] == got[901] == pytest.approx(space.base) and got[None] == pytest.approx(got[0])
    learned = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    assert len(space.labels) == len(learned)
    # brute force over all labelled vectors
    v = space.unit(space.weighted(np.stack([quality.counts(rows[0][1].encode())])) @ space.axes)[0]
    cos = space.vectors @ v
    top = np.argsort(-cos)[: quality.NEIGHBOURS]
    w = np.maximum(cos[top], 0) ** 4
    assert got[0] == pytest.approx((w * space.labels[top]).sum() / w.sum(), abs=1e-5)
    empty = quality.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), space).count() == 0


def test_counts_survive_packing():
    for t in (None, b"", b"a a a , ; a b " * 50, "é\u4e2d ß".encode() * 30):
        assert (quality.unpacked(quality.packed(t)) == quality.counts(t)).all()


def test_the_weight_of_repetition_is_learned():
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(300)]
    plain = [" ".join(rng.choice(words, 60)).encode() for _ in range(100)]
    same = [" ".join(sum(([w, w] for w in rng.choice(words, 30)), [])).encode() for _ in range(100)]
    x = np.stack([quality.counts(t) for t in plain + same])
    assert quality.Space(x, [1.0] * 100 + [0.0] * 100).weight > 0


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, None: 10, "c": 0})
    assert t == {"a": 200.0, "b": pytest.approx(95.0), "c": 0.0, None: 20.0}
    assert sum(t.values()) == pytest.approx(1.5 * 210)
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_splitting_tree_is_exact():
    tree = mixing.splitting_tree([5, 0, 1000, 33], 7)
    assert tree.sum(0).tolist() == [5, 0, 1000, 33] and tree.sum(1).max() - tree.sum(1).min() <= 7
    assert (tree == mixing.splitting_tree([5, 0, 1000, 33], 7)).all()


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{i % 4}" if i % 9 else None, "x") for i in range(600)] + [(601, None, "s0", "x"), (602, "", "s9", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = {r["doc_id"]: r for r in mixing.draws(docs).collect()}
    again = {r["doc_id"]: r for r in mixing.draws(docs.repartition(3)).collect()}
    assert got == again and len(got) == len(rows)
    sums = {}
    for r in got.values():
        assert len(r["shards"]) <= 2
        sums.setdefault((r["s"], r["target"], r["source_size"]), []).append(r["size"] * len(r["shards"]))
    for (_, target, size), taken in sums.items():
        assert abs(sum(taken) - target) <= max(1, 0.002 * size)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "shard", "position"]
    rows = mixed.collect()
    assert sorted((r["doc_id"], r["shard"]) for r in rows) == sorted((i, k) for i, r in got.items() for k in r["shards"])
    assert mixing.draws(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0
    # a shard's rows stand together, in the order of their positions as unsigned numbers
    per = {}
    for part in mixed.rdd.glom().collect():
        for r in part:
            per.setdefault(r["shard"], []).append(r["position"] % 2**64)
    assert all(v == sorted(v) for v in per.values()) and len(per) > 5


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 20), f"s{i % 3}") for i in range(2000)], "doc_id long, text string, source string")
    whole = {r["doc_id"]: r["shards"] for r in mixing.draws(docs).collect()}
    tree = mixing.splitting_tree
    seen = []

    def fewer(blocks, shards, seed=17):
        out = tree(blocks, shards, seed)
        seen.append(out.copy())
        out[5:] = 0
        return out

    monkeypatch.setattr(mixing, "splitting_tree", fewer)
    part = {r["doc_id"]: r["shards"] for r in mixing.draws(docs).collect()}
    assert all(p == [k for k in whole[i] if k < 5] for i, p in part.items()) and any(whole[i] != p for i, p in part.items())
    # by hand: a document has the shards in whose leaves its block's draws lie
    p, rows = mixing.plan(docs)
    info = {r["s"]: r for r in p.sources.collect()}
    ends = np.cumsum(seen[-1], axis=0)
    for r in rows.collect():
        x = info[r["s"]]
        b = r["h"] // -(-mixing.SPAN // x["blocks"])
        i = sorted(info).index(r["s"])
        chosen = r["h"] <= x["cut"] or r["h"] in x["extra"] or any(r["size"] <= m["most"] and r["h"] <= m["upto"] for m in x["more"])
        times = x["passes"] + (chosen and x["passes"] < mixing.CAP)
        assert whole[r["doc_id"]] == ([int(np.searchsorted(ends[:, i], k * x["blocks"] + b, side="right")) for k in range(times)] if r["size"] else [])


def test_mixing_rows_that_share_ids_and_clashing_names(spark):
    rng = np.random.default_rng(12)
    rows = [(i % 200 if i % 3 else None, "w " * int(rng.integers(0, 60)), f"s{i // 200}", "a", 1, "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, copy int, position string")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "shard_", "position_"]
    again = mixing.mix(docs.repartition(5))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    count = lambda rows: {k: sum((r["doc_id"], r["text"], r["source"]) == k for r in rows) for k in {(r["doc_id"], r["text"], r["source"]) for r in rows}}
    want = {}
    taken = mixing.draws(docs.withColumn("source", docs["source"])).collect()
    for r in taken:
        want[(r["doc_id"], r["size"], r["s"])] = want.get((r["doc_id"], r["size"], r["s"]), 0) + len(r["shards"])
    got = {}
    for (i, t, s), n in count(mixed.collect()).items():
        k = (i, len(t.split()), s)
        got[k] = got.get(k, 0) + n
    assert got == {k: n for k, n in want.items() if n}
    for s in ("s0", "s1", "s2"):
        own = [r for r in taken if r["s"] == s]
        assert 0 <= own[0]["target"] - sum(r["size"] * len(r["shards"]) for r in own) < 0.5 * own[0]["source_size"]


def test_mixing_goes_on_after_a_document_that_does_not_fit(spark):
    rows = [(i, "w " * 20, "a") for i in range(1500)] + [(9000, "w " * 60_000, "a"), (9001, "w " * 20, "b"), (700, "w " * 20, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((5, 2, 1), (1, 5)):
        for share in (0.2, 0.4, 0.9, 1.4):
            got = [r for r in mixing.draws(docs, weights=weights, share=share).collect() if r["s"] == "a"]
            target, size = got[0]["target"], got[0]["source_size"]
            left = target - sum(r["size"] * len(r["shards"]) for r in got)
            passes = int(target // size)
            out = [r["size"] for r in got if len(r["shards"]) == passes]
            assert left >= 0 and all(s > left or left < 40 for s in out), (weights, share, left)


def test_urls(spark):
    urls = ["http://a.com/x", "http://A.COM", "h://www.example.com/en/1", "h://example.com/en/1?q", "h://notexample.com/en/1", "h://x.net/es/1", "h://net/fr/", "h://net/de/#a", "x.net/es/1", None, "", "h://x.net/es", "a://b://c.com/x", "h://é.com/" + "y" * 50000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'z' as host")

    def plain(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r, _ in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fit, key=len, default=None)

    for r in url_filter.judge(df).collect():
        host, path, rule = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (dict(url_filter.RULES)[rule] if rule else "block" if r["risk"] >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def plain_tree(rows, edges, depth=0):
    """The best split of all by trying each, level by level."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-6, -1, -1)
    for f in range(len(edges)) if depth < url_filter.DEPTH else ():
        for b in range(len(edges[f])):
            gl, hl = sum(r[1] for r in rows if r[0][f] <= b), sum(r[2] for r in rows if r[0][f] <= b)
            if 1e-9 < hl < h - 1e-9:
                gain = gl**2 / (hl + url_filter.RIDGE) + (g - gl) ** 2 / (h - hl + url_filter.RIDGE) - g**2 / (h + url_filter.RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, f, b)
    if best[1] < 0:
        return -url_filter.RATE * g / (h + url_filter.RIDGE)
    _, f, b = best
    return f, b, plain_tree([r for r in rows if r[0][f] <= b], edges, depth + 1), plain_tree([r for r in rows if r[0][f] > b], edges, depth + 1)


def same_tree(a, b, rows):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return a == pytest.approx(b, abs=1e-9)
    # bins that no row has may cut the same rows
    cut = lambda t: [r[0][t[0]] <= t[1] for r in rows]
    part = lambda keep: [r for r, k in zip(rows, cut(a)) if k is keep]
    return cut(a) == cut(b) and same_tree(a[2], b[2], part(True)) and same_tree(a[3], b[3], part(False))


def test_a_tree_by_exhaustive_splits(spark):
    rng = np.random.default_rng(16)
    edges = [[0.0] * 3, [0.0] * 5, [], [0.0]]
    rows = [([int(rng.integers(0, len(e) + 1)) for e in edges], float(rng.standard_normal()), float(rng.uniform(0.1, 1))) for _ in range(120)]
    scored = spark.createDataFrame(rows, "x array<int>, g double, h double")
    tree = url_filter._grow(scored, edges)
    assert same_tree(tree, plain_tree(rows, edges), rows) and isinstance(tree[2], tuple)


def test_boosted_trees_learn(spark):
    rows = [(f"http://{'pills' * (i % 2)}site{i}.org/a/{'9' * (i % 2 * 8)}?a=1", float(i % 2)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, blocked double")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labelled).collect()}
    assert sum(got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows)) >= 392


def test_masked_model(spark):
    rng = np.random.default_rng(5)
    pairs = [("red", "Apple"), ("blue", "sky"), ("green", "leaf")]
    texts = [" ".join(" ".join(pairs[k]) for k in rng.integers(0, 3, 60)) for _ in range(200)]
    rows = [*enumerate(texts), (500, None), (501, " \n"), (502, "red sky blue leaf green apple " * 10), (None, texts[0]), (0, texts[0])]
    tokens = masked_lm.tokenised(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as at", "'x' as ids"))
    model = masked_lm.learn(tokens, rounds=6)
    found = masked_lm.score(tokens, model).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and got[None]["pll"] == pytest.approx(got[0]["pll"])
    assert got[0]["n_tokens"] == 120 and got[0]["perplexity"] < got[502]["perplexity"]
    assert (got[500]["n_tokens"], got[500]["pll"], got[500]["perplexity"]) == (0, 0.0, None) == (got[501]["n_tokens"], got[501]["pll"], got[501]["perplexity"])
    # brute force: the probabilities of all tokens in a window sum to one
    context = np.repeat(np.array([[masked_lm.EDGE, 0, 1, 2]]), masked_lm.EDGE, 0)
    assert np.exp(model.log_probability(context, np.arange(masked_lm.EDGE))).sum() == pytest.approx(1, abs=1e-3)
    ids = np.concatenate([[masked_lm.EDGE] * 2, model.tokens(texts[0]), [masked_lm.EDGE] * 2]).astype(int)
    by_hand = sum(model.log_probability(np.array([[ids[i + j] for j in masked_lm.WINDOW]]), ids[i : i + 1])[0] for i in range(2, len(ids) - 2))
    assert got[0]["pll"] == pytest.approx(by_hand, rel=1e-4)
    none = masked_lm.tokenised(spark.createDataFrame([], "doc_id long, text string"))
    assert masked_lm.score(none, masked_lm.learn(none)).count() == 0
    assert {r["n_tokens"] for r in masked_lm.score(tokens, masked_lm.learn(none)).collect()} == {0, 60, 120}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB\u00e9\u0130 \n\x0b\x1f\u00a0\u2003", max_size=60), st.integers(1, 9))
def test_words_are_cut_at_blanks_only(text, cut):
    assert [w for part in masked_lm.words_of(text, cut) for w in part] == text.lower().encode().split()


def test_step_descends_as_by_hand():
    """The gradient of a step's loss by differences, through the first, still plain step of Adagrad."""
    rng = np.random.default_rng(3)
    words = masked_lm.Vocabulary(np.arange(1, masked_lm.WORDS + 1, dtype=np.uint64), rng.integers(1, 50, masked_lm.EDGE).astype(float), np.ones(masked_lm.BUCKETS))
    context, target = rng.integers(0, 60, (200, 4)), rng.integers(0, 200, 200)
    loss = lambda m: -m.log_probability(context, target).astype(np.float64).sum()
    model, moved = masked_lm.Network(words), masked_lm.Network(words)
    moved.step(context, target, 0.1)
    for parameter in range(5):
        a, b = model.parameters()[parameter], moved.parameters()[parameter]
        at = np.unravel_index(np.argmax(np.abs(a - b)), a.shape)
        slopes = []
        for e in (1e-2, -1e-2):
            other = masked_lm.Network(words)
            other.parameters()[parameter][at] += e
            slopes.append(loss(other))
        assert np.sign(slopes[0] - slopes[1]) == np.sign(a[at] - b[at])
    assert loss(moved) < loss(model)


def test_masked_model_fits_every_token_whatever_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d"], rng.integers(0, 9)))) for i in range(300)] + [(900, " ".join(["long", "text"] * 700)), (901, None)]
    for name, value in (("PIECE", 64), ("COPY", 500), ("CHUNK", 100)):
        monkeypatch.setattr(masked_lm, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = masked_lm.tokenised(docs)
    assert tokens.count() > 8
    words = masked_lm.vocabulary(tokens)
    total = sum(len((t or "").split()) for _, t in rows)
    assert words.n.sum() == total
    model = masked_lm.Network(words)
    pieces = [r["ids"] for r in masked_lm.dealt(tokens, words, 5).collect()]
    assert model.train(pieces) == total == sum(len(p) // 2 - 4 for p in pieces)
    one, many = (masked_lm.learn(masked_lm.tokenised(docs.repartition(n))).flat() for n in (1, 40))
    assert np.abs(one - many).max() < 1e-5


def test_rare_words_have_their_share_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "LEAST_PARCELS", 5)
    common = " ".join(f"v{i}" for i in range(masked_lm.WORDS))
    texts = [common, common, common + " often often", " ".join(f"w{i}" for i in range(2000)), None]
    tokens = masked_lm.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = masked_lm.learn(tokens)
    words = model.vocabulary
    seen = {f"w{i}": 1 for i in range(2000)} | {"often": 2}
    assert (words.classes(masked_lm.hashes([w.encode() for w in seen])) >= masked_lm.WORDS).all() and words.kinds.sum() == 2001
    table = {}
    for r in words.table.collect():
        table |= zip(np.frombuffer(r["words"], np.uint64).tolist(), np.frombuffer(r["n"], np.int64).tolist())
    assert len(table) == masked_lm.WORDS + 2001 and all(table[int(masked_lm.hashes([w.encode()])[0])] == n for w, n in seen.items())
    share, new = {}, {}
    for w, n in seen.items():
        h = masked_lm.hashes([w.encode()])
        c = int(words.classes(h)[0])
        share.setdefault(c, {})[w] = float(np.exp(words.within(h, np.array([n]))[0]))
        new[c] = float(np.exp(words.within(h, np.array([0]))[0]))
    for c, own in share.items():
        assert sum(own.values()) + masked_lm.UNSEEN * (len(own) + 1) * new[c] == pytest.approx(1)
    c = int(words.classes(masked_lm.hashes([b"often"]))[0])
    assert share[c]["often"] > 2 * max(v for w, v in share[c].items() if w != "often")
    strange = next(w for w in (f"zz{i}" for i in range(10**6)) if int(words.classes(masked_lm.hashes([w.encode()]))[0]) == c)
    asked = spark.createDataFrame([(1, "v1 often v2"), (1, "v1 often v2"), (2, f"v1 {strange} v2")], "doc_id long, text string")
    own = {r["doc_id"]: (r["n_tokens"], r["n_once"]) for r in masked_lm.score(tokens, model).collect()}
    assert own == {0: (masked_lm.WORDS, 0), 1: (masked_lm.WORDS, 0), 2: (masked_lm.WORDS + 2, 0), 3: (2000, 2000), 4: (0, 0)}
    got = sorted((r["doc_id"], r["pll"]) for r in masked_lm.score(masked_lm.tokenised(asked), model).collect())
    classes = model.scores(model.tokens("v1 often v2"), np.array([3]))[0]
    assert [p for _, p in got] == pytest.approx([classes + np.log(share[c]["often"])] * 2 + [classes + np.log(new[c])], rel=1e-5)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(6)
    words = "the of and to in that is was for it with as his on be at by this".split()
    rows = [(i, " ".join(rng.choice(words, 60)) + f" me{i % 3}@ex.com", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, None, None, None, None), (102, "123", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = p.identified(spark, docs, "")
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == {*range(60), 100}
    b = p.deduplicated(spark, a, "")
    assert {r["doc_id"] for r in b.collect()} == set(range(60))
    c = p.sanitised(spark, b, "")
    assert c.columns == docs.columns and c.where("text like '%@ex.com%' or n_chars <> length(text)").count() == 0
    d = p.mixed(spark, c, "")
    assert d.columns == docs.columns and {r["doc_id"] for r in d.collect()} <= set(range(60))
    e = p.encoded(spark, d, "")
    assert e.count() == d.count() and e.where("not round_trip").count() == 0


def test_pipeline_on_odd_tables(spark):
    """Nulls anywhere, repeated rows, a very long text, clashing names, and no rows at all."""
    import corpus_pipeline as p

    rng = np.random.default_rng(18)
    words = "the of and to in that is was for it with as his on be at by this".split()
    rows = [(i if i % 7 else None, " ".join(rng.choice(words, 40)) + f" n{i}", "en" if i % 5 else None, f"s{i % 2}" if i % 3 else None, 1) for i in range(60)]
    rows += [rows[1], rows[1], (500, None, None, None, None), (501, "", "en", "s0", 0), (502, " \n", "en", "s0", 2), (503, " ".join(rng.choice(words, 120_000)) + " a.b@c.de", "en", "s1", 5), (504, rows[3][1], "en", "s1", 9)]
    clash = "k key keys spans found_key lang_pred lang_rejected shard position copy taken size h s part gone_id".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"doc_id as {c}" for c in clash])
    kept = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        docs = materialize(after, name)
        kept.append(docs.count())
        assert docs.where("doc_id is not null and not (k <=> doc_id and position <=> doc_id)").count() == 0
    assert kept[1] == kept[0] - 3 and kept[2] == kept[1] - 3 and kept[3] == kept[2]
    assert docs.where("text like '%@%'").count() == 0
    out = p.encoded(spark, docs, "")
    assert out.count() == docs.count() > 0 and out.where("not round_trip").count() == 0
    docs = docs.limit(0)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
