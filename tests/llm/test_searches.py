"""Near-duplicates by signatures, whitening and ranked search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shieldline.llm import minhash, ranked, whitening
from shieldline.llm.textarrays import U64


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts(seed=3, n=150):
    """Random texts with copies, near copies of many degrees, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mé", "TU", "x", "9"]) for _ in range(rng.randint(1, 4)))
    out = ["", None, " \t ", "One", "one", "one one one", "a b", "A  b", "zz " * 300, "a b c d e", "a b c d"]
    while len(out) < n:
        full = [t for t in out if t and len(t) > 60]
        if full and rng.random() < 0.6:
            w = rng.choice(full[:12]).split(" ")
            for _ in range(rng.randint(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(2, 150))))
    return out


def frame(spark, rows):
    cols = "doc_id bigint, text string, node string, component_id string, n string, m string, score string"
    return spark.createDataFrame([(i, t, "p", "q", "r", "s", "t") for i, t in rows], cols).repartition(3)


# 11 near-duplicates


def word_pairs(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text)) if x]
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [word_pairs(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()), key=str)


def test_near_duplicates_equal_brute_force(spark):
    rows = list(enumerate(texts(), 10))
    rows += [(7, rows[30][1]), (7, rows[30][1]), (9, rows[30][1] + " tail"), (11, "another text of the id eleven")]
    assert found(frame(spark, rows)) == brute_components(rows)


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text + " more"), (None, "alone with no id"), (None, None), (3, None), (4, "")]
    assert found(frame(spark, rows)) == brute_components(rows)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(300)]
    got = found(frame(spark, rows))
    assert got == brute_components(rows)


def test_no_rows(spark):
    assert found(frame(spark, [(1, "x y z")]).where("doc_id < 0")) == []


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << minhash.BITS, (1000, minhash.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.POSITIONS, minhash.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 1 << minhash.BITS, len(at)).astype(np.uint16)
    (ka, ma), (kb, mb) = minhash.chunk_keys(a), minhash.chunk_keys(b)
    assert (ka == kb).any(axis=1).all()
    meet = (ka == kb) & ((ma & 1 == 1) | (ma != mb))  # once for each chunk that has one difference at most
    errors = np.stack([(a[:, c] != b[:, c]).sum(axis=1) for c in minhash._CHUNKS], axis=1)
    assert (meet.sum(axis=1) == (errors <= 1).sum(axis=1)).all()
    # the chunks that are a long each are the first ones, in order
    la, lb = minhash.lanes(a), minhash.lanes(b)
    for j in range(len(minhash._ALONE)):
        assert ((la[:, j] == lb[:, j]) == (errors[:, j] == 0)).all()
    assert (minhash.positions(minhash.lanes(a)) == a).all()


def test_distance_counts_positions(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 4, (50, minhash.POSITIONS)).astype(np.uint16) * 127 for _ in "ab")
    cols = [f"{x}_{s}" for x in "ab" for s in minhash._SIG]
    df = spark.createDataFrame(np.hstack([minhash.lanes(a), minhash.lanes(b)]).tolist(), cols)
    assert sorted(r.d for r in df.select(minhash.distance("a", "b").alias("d")).collect()) == sorted((a != b).sum(axis=1).tolist())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 2**63, 3000).astype(U64)
    x, y = np.sort(tokens[:2400]), np.sort(tokens[600:])  # 1800 of 3000 in common
    sig = minhash.signatures(np.concatenate([x, y]), np.array([0, 2400, 4800]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.17


def test_kept_documents(spark):
    got = {r.doc_id: r for r in minhash.op11_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert all(r.kept == (r.doc_id == r.component_id) and r.component_id <= r.doc_id for r in got.values())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.values()), key=str) == brute_components(docs)


# 12 whitening


def vectors(spark, rows):
    cols = "vec_id bigint, embedding array<float>, n string, component string, x string"
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], cols).repartition(3)


def brute_whitening(rows, dim):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in fine]
    fit = sorted({tuple(v) for _, v in x})
    n = len(fit)
    sums = [sum(v[j] for v in fit) for j in range(dim)]
    z = np.array(fit, dtype=float) - np.array(sums) / n
    values, comps = np.linalg.eigh(z.T @ z / n)
    return x, n, sums, values[::-1], comps[:, ::-1]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(7)
    mix = rng.standard_normal((24, 24)) * np.linspace(0.05, 3, 24)
    rows = [(i, (rng.standard_normal(24) @ mix).tolist()) for i in range(400)]
    rows += [(1, rows[5][1])] * 300  # one vector and id, very often
    rows += [(None, rows[6][1]), (900, None), (901, [None] * 24), (902, [1.0] * 23 + [float("nan")]),
             (903, [float("inf")] + [0.0] * 23), (904, []), (905, [1.0, 2.0])]
    x, n, sums, values, comps = brute_whitening(rows, 24)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 16 * len(x)
    assert {r.n for r in got} == {n}
    expected = Counter((i, sum((n * e - s) ** 2 for e, s in zip(v, sums))) for i, v in x)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == expected
    for k in range(16):
        w = {(i, tuple(v)): float((np.array(v) - np.array(sums) / n) @ comps[:, k] / math.sqrt(values[k])) for i, v in x}
        own = sorted(r.whitened for r in got if r.component == k + 1)
        want = sorted(w[i, tuple(v)] for i, v in x)
        assert min(np.abs(np.array(own) - want).max(), np.abs(np.array(own) + want[::-1]).max()) < 1e-8
        assert {r.explained for r in got if r.component == k + 1}.pop() == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])] * 5)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])]).where("vec_id < 0")).count() == 0
    two = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [1e30, 1.0])][:2])).collect()
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and all(math.isfinite(r.whitened) for r in huge)


@pytest.mark.parametrize("values", [
    [1.0] * 9, [5, 5, 5, 2, 2, 1, 1, 1, 0], [0.0] * 6, [3.0], list(np.geomspace(1, 1e-14, 40)), [1, 1 + 1e-13, 1 - 1e-13, 2, 0.5]])
def test_spectral_division(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values, dtype=float)) @ q.T * 1000
    w, u = whitening.spectral(v)
    assert np.allclose(w, 1000 * np.sort(values)[::-1], atol=1e-10)
    assert np.abs(v @ u - u * w).max() < 1e-10 and np.abs(u.T @ u - np.eye(len(values))).max() < 1e-13


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    w, u = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), (u * np.sign(w)) @ u.T, atol=1e-11)


# 13 ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute_search(docs, items, top=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def searched(docs, items, **kw):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(docs, items, **kw).collect()), key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(2)
    docs = list(enumerate(texts(8, 220))) + [(5, "ka lo ka"), (5, "ka lo ka"), (None, "ka ka ka"), (999, "ka-LO_mé?9")]
    docs += [(2000 + i, "same words in many documents") for i in range(90)]
    items = [(i, " ".join(rng.choice(docs)[1] or "none" for _ in range(2))[:200]) for i in range(12)] + [
        (50, "ka ka lo Mé"), (50, "same words"), (51, None), (52, ""), (53, "notaword"), (None, "ka lo")]
    own = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, score string")
    assert searched(frame(spark, docs), own) == brute_search(docs, items)
    assert searched(frame(spark, docs), own, top=3) == brute_search(docs, items, 3)


def test_search_in_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS", 3)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 7)
    docs = list(enumerate(texts(9, 120)))
    items = [(i, docs[20 + i][1]) for i in range(8)]
    own = spark.createDataFrame(items, "item_id bigint, text string")
    assert searched(frame(spark, docs), own) == brute_search(docs, items)


def test_search_of_nothing(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    own = spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    assert searched(none, own) == []
    assert searched(frame(spark, [(1, "x")]), own.where("item_id < 0")) == []
    assert searched(frame(spark, [(1, "x"), (2, None)]), own) == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]


def test_bounds_are_never_exceeded():
    queries = ranked.Queries([1, 2], ["a b b c", "c d"])
    queries.weigh({int(t): 2 for t in queries.terms.view(np.int64)}, 50)
    import pyarrow as pa

    raw, offsets = ranked.buffers(pa.array(["a b c c d", "c", "d d d a", "zz"]))
    h, tf, at, _ = ranked.term_counts(raw, offsets)
    rows = [(h[a:b].tobytes(), tf[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
    block = dict(zip(ranked._BLOCK_NAMES, ranked._block(90, [1, 2, 3, 4], [r[0] for r in rows], [r[1] for r in rows])))
    visit = ranked._Visit(block, queries)
    scores = visit.scores(np.array([0, 1]))
    assert (scores.max(axis=1) <= visit.bound).all() and scores[:, 3].tolist() == [0, 0] and scores[0, 0] > scores[1, 0] > 0
    assert visit.scores(np.array([1])).tolist() == [scores[1].tolist()]


def test_queries_have_their_columns(spark):
    got = ranked.op13_ranked(spark, "/root/testdata/sf0.001")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert got.groupBy("item_id").agg(F.countDistinct("rank").alias("n"), F.max("rank").alias("m")).where("n <> m").count() == 0
    assert whitening.op12_whitening(spark, "/root/testdata/sf0.001").columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
