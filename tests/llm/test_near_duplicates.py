import math

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import cap_filters, near_copies, simhash, topk
from tracewell.llm.components import components


def smallest(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (5, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    text = "The  quick\tBrown fox\x0bjumps é É".encode()
    words = [b"the", b"quick", b"brown", b"fox", b"jumps", "é".encode(), "É".encode()]
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(5)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 5)
    assert simhash.fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_all_pairs_within_three_bits_meet():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    fps = set(base.tolist())
    for f in base.tolist():
        for n in (1, 2, 3, 4, 5):
            fps.add(f ^ int(sum(1 << int(b) for b in rng.choice(64, n, replace=False))))
    import pyarrow as pa

    fps = sorted(fps)
    batch = pa.record_batch([pa.array(np.array(fps, np.uint64).view(np.int64))], names=["fp"])
    parts = list(simhash._emit(4)(iter([batch])))
    links = []
    for k in range(4):
        t = pa.Table.from_batches([p.filter(pa.compute.equal(p.column("block"), k)) for p in parts])
        m = simhash._meet(t)
        links += zip(*(np.asarray(m.column(c)).view(np.uint64).tolist() for c in ("a", "b")))
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    assert smallest(fps, links) == smallest(fps, near)


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "x"), (3, text, "y"), (9, text.upper(), "z"), (4, None, "q"), (6, "", None), (7, " \n ", None), (8, "lone words here today", None), (3, text, "y"), (2, "z" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    by = {i: c for i, _, c in got}
    assert len(got) == 9 and by == {2: 2, 3: 3, 5: 3, 9: 3, 4: 4, 6: 4, 7: 4, 8: 8}
    kept = simhash.keep_first(docs.selectExpr("*", "1 as k", "2 as gone_id"))
    assert kept.columns == [*docs.columns, "k", "gone_id"] and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_caps_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    rows, n = [], 0
    for k, v in enumerate(base):
        for noise in (0, 0.1, 0.25, 0.35, 0.45):
            rows.append((n, (v + noise * rng.standard_normal(24)).tolist(), k % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], None), (n + 2, None, 1), (n + 3, [0.0] * 24, 1), (n + 4, [1.0, None] + [0.0] * 22, 1), (n + 5, [float("nan")] * 24, 1), (n + 6, [], 1), (n + 7, [2.0 * x for x in rows[0][1]], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_duplicates(df).collect()}
    good = {i: (np.array(v), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a in good for b in good if a != b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.93]
    root = smallest([r[0] for r in rows], linked)
    assert len(linked) > 200
    assert got == {i: (sum(a == i for a, _ in linked), root[i], root[i] == i) for i in root}


def test_groups_of_near_copies_by_brute_force(spark):
    """Tight and loose groups, chains and border cases, with copies and ids that repeat."""
    rng = np.random.default_rng(13)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((12, 32)))
    rows, n = [], 0
    for k, v in enumerate(base):
        for spread in rng.choice([0.02, 0.1, 0.2, 0.3, 0.37, 0.5], 30):
            rows.append((n, unit(v + spread * unit(rng.standard_normal(32))), k % 2))
            n += 1
    for k in range(4):  # two tight groups whose angle is that of the threshold, about
        z = unit(rng.standard_normal(32) - 0)
        z = unit(z - (z @ base[k]) * base[k])
        for turn in (0.0, math.acos(0.93)):
            for _ in range(25):
                rows.append((n, unit(math.cos(turn) * base[k] + math.sin(turn) * z + 0.03 * unit(rng.standard_normal(32))), k % 2))
                n += 1
    rows += [(n, rows[0][1], 0), (0, rows[0][1], 0), (0, rows[5][1], 0), (1, unit(rng.standard_normal(32)), 0)]
    df = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in rows], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as cls", "2 as lead", "3 as h")
    x, label = np.stack([v for _, v, _ in rows]), np.array([label for _, _, label in rows])
    near = (x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :]) >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    least = smallest([(i, at) for at, (i, _, _) in enumerate(rows)], [((rows[a][0], a), (rows[b][0], b)) for a, b in zip(*np.nonzero(near))])
    want = sorted((i, int(near[at].sum()), least[(i, at)][0], least[(i, at)][0] == i) for at, (i, _, _) in enumerate(rows))
    assert sorted(tuple(r) for r in cap_filters.near_duplicates(df).collect()) == want
    assert near.sum() > 8000
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_make_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = rng.standard_normal(48) + 0.03 * rng.standard_normal((1500, 48))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    made = []
    cosine = cap_filters._cosine

    def counting(pairs, vectors, a, b):
        made.append(pairs.count())
        return cosine(pairs, vectors, a, b)

    monkeypatch.setattr(cap_filters, "_cosine", counting)
    got = cap_filters.near_duplicates(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(1499, 0)} and sum(made) < 4 * 1500


@pytest.mark.parametrize("words,n_caps", [c[1:] for c in cap_filters.CODES[:2]])
def test_caps_recall_at_the_threshold(words, n_caps):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    shared = [len(np.intersect1d(a, b)) for a, b in zip(cap_filters.caps(x, words, n_caps), cap_filters.caps(y, words, n_caps))]
    assert np.mean(np.array(shared) > 0) >= 0.999


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.integers(-3, 4, 16) / 8).tolist()) for i in range(150)]
    rows += [(i, rows[i][1]) for i in (7, 20, 40)] + [(20, rows[3][1]), (500, None), (520, [float("inf")] * 16), (540, [0.1] * 3), (560, [0.2] * 3), (561, [0.3] * 3), (None, rows[0][1]), (580, []), (600, [0.5, None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "2 as x", "3 as id")
    z = [(n, i, np.floor(64 * np.array(v)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for n, i, q in z:
        if i % 20 == 0:
            best = sorted((-int(q @ x), c) for m, c, x in z if m != n and len(x) == len(q))[:7]
            want += [(i, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    for slice_ in (512, 3):
        monkeypatch.setattr(topk, "SLICE", slice_)
        assert sorted(tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", k=7).collect()) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id % 20 = 0").count() == 0


@pytest.mark.parametrize("level", [0, 1, 2, 5, 15, 16, 40])
def test_bounds_hold(level):
    rng = np.random.default_rng(5)
    q, x = rng.standard_normal((20, 16)), rng.standard_normal((30, 16))
    turn = topk.axes(x)
    assert (topk.statistics(q @ turn, level) @ topk.statistics(x @ turn, level).T >= q @ x.T - 1e-9).all()


@pytest.mark.parametrize("dense", [0.0, 0.2, 1.0])
def test_bounds_leave_few_rows_to_score(monkeypatch, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(6)
    centres = 40 * rng.standard_normal((40, 64))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + 6 * rng.standard_normal((4000, 64)))
    q, row = x[::20], np.arange(4000)
    known = topk.scout(row[::20], q, row, x, 20)
    reach = np.array([np.sort(known[1][known[0] == r])[-20] for r in row[::20]])
    (at, ids, score), counted = topk.search(row[::20], q, reach, row, row, x, 20)
    assert counted[0] == 200 * 3999 and counted[-1] < 0.05 * counted[0] and (np.diff(counted) <= 0).all()
    exact = q @ x.T
    for i in range(200):
        order = sorted((-exact[i, j], j) for j in range(4000) if j != 20 * i)[:20]
        assert [(int(c), int(s)) for c, s in zip(ids[at == i], score[at == i])] == [(j, int(-s)) for s, j in order]


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def near_copy_rows():
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        w = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        rows.append((10 * i, " ".join(w)))
        for j in range(1, 1 + int(rng.integers(0, 4))):
            w = list(w)
            for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
                w[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((10 * i + j, " ".join(w)))
    return rows


def test_near_copies_are_those_of_five_words_and_four_fifths(spark):
    rows = near_copy_rows()
    linked = [(a, b) for a, s in rows for b, t in rows if a < b < a + 10 and jaccard(s, t) >= 0.8]
    far = sum(bin(simhash.fingerprint(dict(rows)[a].encode()) ^ simhash.fingerprint(dict(rows)[b].encode())).count("1") > 3 for a, b in linked)
    assert far > len(linked) / 3  # what 3 bits of three words leave
    root = smallest([i for i, _ in rows], linked)
    assert len(set(root.values())) < len(rows) - 50
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))


def test_large_groups_are_split_alike(spark, monkeypatch):
    """Chains, tight groups and far texts in one group of candidates: by pivots as in one task."""
    rng = np.random.default_rng(19)
    sets = []
    for _ in range(2):
        base = rng.integers(0, 2**62, 60, dtype=np.uint64)
        for _ in range(14):  # chains that drift away, and texts around them
            base = base.copy()
            base[rng.choice(60, int(rng.integers(1, 5)), replace=False)] = rng.integers(0, 2**62, 1, dtype=np.uint64)
            sets.append(np.unique(base))
            more = base.copy()
            at = rng.choice(60, int(rng.integers(3, 12)), replace=False)
            more[at] = rng.integers(0, 2**62, len(at), dtype=np.uint64)
            sets.append(np.unique(more))
    sets += [np.unique(rng.integers(0, 2**62, 40, dtype=np.uint64)) for _ in range(8)]
    names = list(range(100, 100 + len(sets)))
    df = spark.createDataFrame([(7, n, bytearray(x.tobytes())) for n, x in zip(names, sets)], "root long, set long, grams binary")
    want = near_copies.split(sets)
    assert 10 < len(set(want.tolist())) < len(sets) - 20
    parts = lambda pairs: {frozenset(n for n, r in pairs if r == root) for _, root in pairs}
    monkeypatch.setattr(near_copies, "BIG", 9)
    monkeypatch.setattr(near_copies, "PIVOTS", 6)
    got = [(r["set"], r["root"]) for r in near_copies._by_pivots(df).collect()]
    assert sorted(n for n, _ in got) == names
    assert parts(got) == parts(list(zip(names, want.tolist())))


def test_near_copies_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BIG", 2)
    monkeypatch.setattr(near_copies, "PIVOTS", 3)
    rows = near_copy_rows()[:60]
    linked = [(a, b) for a, s in rows for b, t in rows if a < b < a + 10 and jaccard(s, t) >= 0.8]
    root = smallest([i for i, _ in rows], linked)
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))


def test_split_is_exact():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(300)]
    linked = [(i, j) for i in range(300) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert near_copies.split(sets).tolist() == list(smallest(range(300), linked).values())


def test_ball_links_are_candidates_too(spark, monkeypatch):
    """Without any band, texts within 3 bits are still grouped, and compared exactly."""
    monkeypatch.setattr(near_copies, "bands", lambda grams: np.zeros(0, np.uint64))
    base = [f"w{i}" for i in range(2000)]
    near, far = [*base[:-1], "end"], [f"v{i}" for i in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    batch = pa.record_batch([pa.array(["1", "2", "3"]), pa.array([t.encode() for _, t in rows])], names=["k", "t"])
    out = next(near_copies._keys(iter([batch]))).to_pydict()
    assert (out["fp"][0] ^ out["fp"][1]).bit_count() <= 3 and (out["fp"][0] ^ out["fp"][2]).bit_count() > 3
    got = near_copies.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["root"] for r in got}) == 2


def test_each_group_keeps_one_row_whatever_the_ids(spark):
    keep = simhash.keep_first
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(None, a, "p"), (None, b, "p"), (None, a.upper(), "p"), (1, c, "p"), (1, d, "p"), (0, c, "p"), (5, "", "p"), (6, None, "p"), (0, c, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    got = keep(docs)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(got) == 5 and {(None, b), (1, d), (0, c), (5, "")} < set(got) and len({(None, a), (None, a.upper())} & set(got)) == 1
    assert keep(docs.limit(0)).count() == 0
