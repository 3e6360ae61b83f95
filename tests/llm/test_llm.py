"""The ten operators against brute force, and on nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shieldline.llm import brown, chat, components, decontaminate, fingerprints, jaccard, language, packed, packing, pii, repeats, suffixes, tables, tokens, toxicity

BLANKS = "[\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def shared(spark):
    return spark


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return [w for w in re.split(BLANKS, lower(text)) if w]


def texts(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "an", "ön", "é", "in", "st"]) for _ in range(rng.randint(1, 4)))
    line = " ".join(word() for _ in range(25))
    out = ["", None, "one", "One  two", " \t\n", "a b c d", "zz " * 400]
    while len(out) < n:
        kind = rng.random()
        full = [t for t in out if t and len(t) > 60]
        if kind < 0.15 and full:
            out.append(rng.choice(full))
        elif kind < 0.45 and full:
            w = rng.choice(full).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            w = [word() for _ in range(rng.randint(3, 120))]
            out.append(" ".join(w) + (" " + line if kind > 0.8 else ""))
    return out


def frame(spark, rows, more=()):
    """documents with clashing extra columns."""
    cols = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, items string, same string, piece string"
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", "y", "z", "p") for i, t in rows], cols).repartition(3)


def empty(spark):
    return frame(spark, [(0, "x")]).where("doc_id < 0")


# 1 chat formatting


def linked(spark, calls, results, schemas=(("t", "{}"),)):
    c = spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint, name string, arguments string, depends array<string>")
    r = spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string")
    s = spark.createDataFrame(list(schemas), "name string, schema string")
    return {(x.conv_id, x.call_id): x for x in chat.link_tool_calls(c, r, s).collect()}


def test_calls_are_linked_ordered_and_validated(shared):
    schema = json.dumps({"type": "object", "required": ["q"], "properties": {"q": {"type": "integer", "maximum": 5}}, "additionalProperties": False})
    got = linked(shared, [
        (1, "a", 5, "t", '{"q": 3}', []), (1, "b", 1, "t", '{"z": 1, "q": 9}', ["a"]), (1, "c", 2, "t", "{", ["b", "gone"]),
        (1, "d", 0, "u", "{}", None), (1, "x", 3, "t", '{"q":1}', ["y"]), (1, "y", 4, "t", '{"q":1}', ["x"]),
        (1, "a", 7, "t", '{"q": 4}', []), (2, None, 1, None, None, None)],
        [(1, "a", 6, "ok"), (1, "d", 1, None), (1, "o", 9, "lost"), (2, None, 2, "n")], [("t", schema)])
    order = [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k].position)]
    assert order.index("a") < order.index("b") < order.index("c") and order[-1] == "o" and sorted(order) == list("abcdoxy")
    assert {k[1]: v.status for k, v in got.items() if k[0] == 1} == {
        "a": "repeated", "b": "invalid", "c": "invalid", "d": "unknown", "o": "orphan", "x": "cycle", "y": "cycle"}
    assert got[1, "b"].faults == ["$.q: bounds", "$.z: unexpected"] and got[1, "c"].faults == ["$: not JSON"]
    assert json.loads(got[1, "a"].message)["arguments"] == {"q": 3} and got[2, None].status == "invalid"


def test_calls_without_rows(shared):
    assert linked(shared, [], []) == {}
    assert linked(shared, [(1, "a", 0, "t", "{}", [])], [])[1, "a"].status == "pending"


def test_canonical_json():
    value = json.loads('{"b":[1.0,1e21,1e-7,0.1,-0.0,100,123456.789,1E30],"a":"\\u00e9\\n\\"","\\ud83d\\ude00":null,"\\uffee":true}')
    assert chat.canonical(value) == '{"a":"é\\n\\"","b":[1,1e+21,1e-7,0.1,0,100,123456.789,1e+30],"😀":null,"￮":true}'


def test_query_links_every_conversation_turn(shared):
    turns = shared.createDataFrame([(1, 0, "system", "be"), (1, 1, "user", "hi you"), (1, 2, "assistant", "yo"), (1, 3, "user", None), (2, 0, "assistant", "x")],
                                   "conv_id bigint, turn bigint, role string, text string")
    calls, results = chat.calls_of(turns)
    got = {(r.conv_id, r.call_id): r.status for r in chat.link_tool_calls(calls, results, shared.createDataFrame([(n, json.dumps(s)) for n, s in chat.TOOLS], "name string, schema string")).collect()}
    assert got == {(1, "call-0"): "pending", (1, "call-1"): "linked", (1, "call-3"): "invalid", (2, "call--1"): "orphan"}


# 2 Brown classes


def test_class_model_scores_and_base(shared):
    rows = list(enumerate(texts(2, 50)))
    docs = frame(shared, rows).withColumn("train", F.col("doc_id") % 4 != 1)
    got = {r.doc_id: r for r in brown.score_texts(docs, "train", classes=8, rounds=2).collect()}
    count = Counter()
    for i, t in rows:
        if i % 4 != 1:
            count.update([*blank_words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        line = [*blank_words(t), None]
        assert got[i].n_tokens == len(line) and got[i].n_known == sum(count[w] > 0 for w in line) and got[i].train_tokens == n
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in line), rel_tol=1e-9)
        assert got[i].score < 0
    held = [i for i, _ in rows if i % 4 == 1]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert brown.score_texts(empty(shared).withColumn("train", F.lit(True)), "train", classes=4, rounds=1).count() == 0


def test_exchange_gain_is_the_likelihood_gained():
    rng = np.random.default_rng(0)
    n, k = 12, 4
    pairs = rng.integers(0, 6, (n, n)).astype(float)
    of = rng.integers(0, k, n)
    table = lambda of: np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(k)] for a in range(k)])
    for u in range(n):
        before = np.bincount(np.delete(of, u), np.delete(pairs[:, u], u), k)
        behind = np.bincount(np.delete(of, u), np.delete(pairs[u], u), k)
        best, gain = brown.best_class(int(of[u]), before, behind, pairs[u, u], table(of))
        every = [brown._likelihood(table(np.where(np.arange(n) == u, c, of))) for c in range(k)]
        assert math.isclose(every[best], max(every), rel_tol=1e-9) and math.isclose(gain, max(every) - every[of[u]], abs_tol=1e-6)


def test_moves_of_several_units_are_those_of_each():
    rng = np.random.default_rng(1)
    n, k = 14, 5
    pairs = rng.integers(0, 6, (n, n)).astype(float) * (rng.random((n, n)) < 0.5)
    of = np.concatenate([[0], rng.integers(1, k, n - 1)])
    table = np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(k)] for a in range(k)])
    sums = [(np.bincount(np.delete(of, u), np.delete(pairs[:, u], u), k), np.bincount(np.delete(of, u), np.delete(pairs[u], u), k)) for u in range(1, n)]
    before, behind = (np.array(x) for x in zip(*sums))
    best, gain = brown.best_classes(of[1:], before, behind, np.diag(pairs)[1:], table)
    for u in range(1, n):
        every = [brown._likelihood(np.array([[pairs[np.ix_(w == a, w == b)].sum() for b in range(k)] for a in range(k)])) for c in range(1, k) for w in [np.where(np.arange(n) == u, c, of)]]
        assert math.isclose(every[best[u - 1] - 1], max(every), rel_tol=1e-9) and math.isclose(gain[u - 1], max(every) - every[of[u] - 1], abs_tol=1e-6)


def test_rare_words_of_one_spelling_are_classed_by_their_neighbours(shared):
    # words in "a" and in "c" are spelled alike and rare (under 1/4096 of all tokens), but stand in different places
    rng = random.Random(5)
    letters = "bdfghklmnprs"
    kinds = [[f"{a}{x}{y}{z}e" for x in letters for y in letters for z in letters] for a in "ac"]
    rows = [(i, " ".join(f"{first} {rng.choice(kinds[k])} {last}" for first, k, last in rng.choices([("the", 0, "runs"), ("you", 1, "it")], k=12))) for i in range(1200)]
    count = Counter(w for _, t in rows for w in t.split())
    a, c = (next(w for w in kind if count[w] == 4) for kind in kinds)
    held = [(2000, f"the {a} runs"), (2001, f"the {c} runs"), (2002, f"you {c} it"), (2003, f"you {a} it")]
    docs = shared.createDataFrame(rows + held, "doc_id bigint, text string").withColumn("train", F.col("doc_id") < 2000)
    got = {r.doc_id: r.score for r in brown.score_texts(docs, "train", classes=8, rounds=4).collect()}
    assert got[2000] > got[2001] + 0.5 and got[2002] > got[2003] + 0.5


# 3 decontamination


def test_windows_are_found_and_mapped_back(shared):
    rng = random.Random(4)
    words = [f"w{k}é" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([30, 12, 10, 3, 1, 0])] + [(7, None), (11, "Solo!")]
    docs = [(i, " , ".join(rng.choice(words).upper() for _ in range(60))) for i in range(20)]
    docs += [(30, "x " + items[0][1].upper().replace(" ", "--") + " y"), (31, items[3][1]), (32, None), (33, ""), (34, "SOLO"), (35, items[1][1][: len(items[1][1]) // 2])]
    item = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: item.findall(lower(t))
    for part_bytes in (1 << 20, 150):
        found = decontaminate.find_contamination(frame(shared, docs), shared.createDataFrame(items, "item_id bigint, text string"), part_bytes=part_bytes)
        for r in found.collect():
            w, hit, own = split(r.text), set(), set()
            for k, t in items:
                own_words = split(t)
                size = min(10, len(own_words))
                for a in range(len(own_words) - size + 1) if size else ():
                    for b in range(len(w) - size + 1):
                        if w[b : b + size] == own_words[a : a + size]:
                            hit.update(range(b, b + size))
                            own.add(str(k))
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(own))
            told = [r.text[int(a) : int(b)] for a, b in (s.split(":") for s in r.spans)]
            assert sum(len(split(t)) for t in told) == len(hit)


@pytest.mark.parametrize("part_bytes", [1 << 20, 8])
def test_items_without_an_id_are_found(shared, part_bytes):
    bench = shared.createDataFrame([(None, "red green blue"), (None, "one two"), (5, "red green blue"), (6, None)], "item_id bigint, text string")
    docs = shared.createDataFrame([(1, "a red green blue b"), (2, "one two three"), (3, "none")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, bench, part_bytes=part_bytes).collect()}
    assert got == {1: (3, ["5", None]), 2: (2, [None]), 3: (0, [])}


# 4 Jaccard join


def sets_of(text):
    w = blank_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(rows):
    sets = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(shared, seed, monkeypatch):
    rng = random.Random(seed)
    rows = list(enumerate(texts(seed, 70)))
    for group in range(3):  # chains of edits: many frequent tokens, links that are not transitive
        w = [f"g{group}w{k}" for k in range(rng.choice([12, 60, 150]))]
        for _ in range(20):
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(frame(shared, rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_nothing_and_of_repeated_rows(shared):
    assert jaccard.similarity_components(empty(shared)).count() == 0
    same = "a b c d e f g"
    got = jaccard.similarity_components(frame(shared, [(5, same), (5, same), (None, same), (3, same), (9, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 3, 3), (3, 3, 3), (5, 3, 3), (5, 3, 3), (9, 0, 9)]


def test_index_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 5, 7, 9, 12, 20, 31, 60, 200, 900]:
        for _ in range(20):
            base = rng.integers(1, 1 << 62, n).astype(np.uint64)
            cut = rng.integers(0, max(1, n // 5) + 1)
            other = np.concatenate([base[cut:], rng.integers(1, 1 << 62, rng.integers(0, max(1, n // 10) + 1)).astype(np.uint64)])
            k = len(np.intersect1d(base, other))
            if not k or 100 * k < 80 * (len(base) + len(other) - k):
                continue
            everywhere = {int(t): int(f) for t, f in zip(np.union1d(base, other), rng.choice([2, 3, 50, 1000], 2 * n + 5))}
            keys = []
            for s in (base, other):
                f = np.array([everywhere[int(t)] for t in s])
                order = np.lexsort((s, f))
                keys.append(jaccard.index_keys(s[order], f[order]))
            assert len(np.intersect1d(*keys)), n


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    for n in (1, 5, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 6 :], rng.integers(0, 1 << 48, n // 5 + 1).astype(np.uint64)]))
        apart = sum(int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) + (1 << 64)).bit_count() for x, y in zip(jaccard.parity(a).tolist(), jaccard.parity(b).tolist()))
        assert apart <= len(np.setxor1d(a, b)) and (jaccard.parity(a) == jaccard.parity(a[::-1])).all()


def test_components_of_a_long_chain(shared):
    edges = shared.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (7, 7)], "a bigint, b bigint")
    assert {r.id: r.component for r in components.components(edges).collect()} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


# 5 fingerprints


def test_sketches_estimate_sets_and_merge(shared):
    w = [f"t{k}" for k in range(900)]
    rows = [(0, " ".join(w[:600])), (1, " ".join(w[200:800])), (2, None), (3, " "), (4, "a b"), (5, " ".join(w[:600]))]
    s = shared.createDataFrame(rows, "doc_id bigint, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    pair = s.alias("x").crossJoin(s.alias("y")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), fingerprints.resemblance(F.col("x.s"), F.col("y.s")).alias("r"),
                                                      fingerprints.containment(F.col("x.s"), F.col("y.s")).alias("c"), fingerprints.distinct_shingles(F.col("x.s")).alias("n"))
    got = {(r.a, r.b): r for r in pair.collect()}
    assert got[0, 5].r == got[2, 3].r == got[4, 4].r == 1 and got[0, 2].r == 0
    assert abs(got[0, 1].r - 396 / 796) < 0.15 and abs(got[0, 1].c - 396 / 596) < 0.2 and abs(got[0, 1].n - 596) < 150
    assert got[4, 4].n == 1 and got[2, 2].n == 0
    whole = {r.g: r.s for r in fingerprints.merge_groups(s.withColumn("g", F.col("doc_id") % 2), ["g"], "s").collect()}
    both = s.alias("x").crossJoin(s.alias("y")).where("x.doc_id = 1 and y.doc_id = 5").select(fingerprints.merged(F.col("x.s"), F.col("y.s")).alias("m")).first().m
    assert whole[1] == both
    back = s.select("s", fingerprints.from_text(fingerprints.as_text(F.col("s"))).alias("t")).collect()
    assert all(r.s == r.t for r in back)


@pytest.mark.parametrize("tasks", [1, 2, 7])
def test_next_row_by_id(shared, tasks):
    rows = [(i, f"t{i}") for i in [5, 1, 9, 40, 41, 42, 43, 44, 100, 7]]
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(shared.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "doc_id", ["text"], tasks).collect()}
    ids = sorted(i for i, _ in rows)
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_next_row_with_null_and_repeated_ids(shared):
    df = shared.createDataFrame([(None, "a"), (1, "b"), (1, "c"), (2, "d")], "doc_id bigint, text string")
    got = fingerprints.with_next(df, "doc_id", ["text"], 3).collect()
    assert len(got) == 4 and sorted(r.next_text for r in got) == list("abcd")
    assert fingerprints.with_next(df.where("doc_id > 5"), "doc_id", ["text"], 3).count() == 0


# 6 toxicity


def test_toxic_words_are_learned(shared):
    rng = random.Random(7)
    plain = [f"word{chr(97 + k)}" for k in range(20)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        w = [rng.choice(plain) for _ in range(30)] + (["you", "grumph"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (4, 0), (9999, 1)]
    docs = frame(shared, rows + [(500, None), (501, ""), (502, "you grumph you grumph"), (503, "GRUMPH " * 3000)])
    sample = toxicity.training_sample(docs, shared.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert sample.count() == 299 or sample.count() == 300
    model = toxicity.Model(sample, trees=4, depth=2)
    got = {r.doc_id: r.score for r in model.score(docs.select("doc_id", "text"), ["doc_id"]).collect()}
    assert got[502] >= 0.5 and got[503] >= 0.5 and got[500] == got[501] < 0.5 and all(0 <= x <= 1 for x in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(300)]) > 0.97
    nothing = toxicity.Model(sample.where("toxic = 0"))
    assert {r.score for r in nothing.score(docs, ["doc_id"]).collect()} == {0.0}


# 7 packing


def test_ids_are_those_of_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.public_vocabulary()
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    odd = ["", None, "a", " a", "  a b", "\n\n a", "a \n b", "x\t y  ", "don't we'll 's", "é è ñ  ß1 2½ ²", "中文 текст", "a b c", "   ", "\u0085 a", "end<|endoftext|>x",
           "\x1c a \x1d\x1eb", "!!! ??  !a1b2", "_under_ __", "\x00 \x00", "ab" * 3000]
    column = pa.array([x for x in texts(3, 80)] + odd)
    got = tokens.Bpe(tokens.vocabulary(path)).encode(column)
    want = [[*e.ids, 0] for e in t.encode_batch([x or "" for x in column.to_pylist()], add_special_tokens=False)]
    assert [x.tolist() for x in got] == want


@pytest.mark.parametrize("cap", [packing.Capacity(64, 64, 64 * 64), packing.Capacity(64, 3, 64 * 64, rule="dot"), packing.Capacity(64, 64, 64 * 64, (1, 0.5, 2))])
def test_packing_keeps_every_capacity(shared, cap):
    rows = [(i, t) for i, t in enumerate(texts(5, 80))]
    packed_ = packing.pack_documents(frame(shared, rows), cap=cap).collect()
    path = packing.public_vocabulary()
    ids = dict(zip([i for i, _ in rows], tokens.Bpe(tokens.vocabulary(path)).encode(pa.array([t for _, t in rows]))))
    bins = {}
    for r in packed_:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.astype("<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= cap.tokens and len(own) <= cap.documents and sum(n * n for _, n in own) <= cap.attention
    for i in ids:
        own = sorted((r.piece, r.start, r.length) for r in packed_ if r.doc_id == i)
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids[i]) and all(n == cap.tokens for _, _, n in own[1:])
    left = []  # what plain best fit, longest first, leaves in each of its bins
    for n in sorted((r.length for r in packed_), reverse=True):
        fit = min((x for x in left if x[0] >= n and x[1] >= 1 and x[2] >= n * n), default=None)
        if fit:
            left.remove(fit)
        t, d, a = fit or (cap.tokens, cap.documents, cap.attention)
        left.append((t - n, d - 1, a - n * n))
    assert len(bins) <= len(left)
    assert packing.pack_documents(empty(shared)).count() == 0


# 8 personal data


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    parts = ["a.b@c-d.org", "x@y", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+12", "é", " ", "..", "9" * 25, "word", "\n", "a@b.c@d.e", "0.0.0.0"]
    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(8))
        want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
                want.append((2, *m.span()))
        want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.find(t) == want


@pytest.mark.parametrize("text, kind, part", [
    ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"), ("so jane at mail dot example dot org!", "email", "jane at mail dot example dot org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"), ("x a​b@ex​ample.com", "email", "a​b@ex​ample.com"), ("john @ example.com", "email", "john @ example.com"),
    ("ip 192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"), ("ip 192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10"), ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("call +one four one five five five five two six seven one", "phone", "+one four one five five five five two six seven one"), ("＋１ （415） 555-2671", "phone", "＋１ （415） 555-2671")])
def test_disguises_are_mapped_back(text, kind, part):
    base, added = pii.find_all(text)
    assert not base and [(pii.KINDS[k], text[s:e]) for k, s, e in added] == [(kind, part)]


@pytest.mark.parametrize(("text", "part"), [
    ("write to john@example dot com today", "john@example dot com"), ("write to john@example dot co dot uk, please", "john@example dot co dot uk"),
    ("write to john at example.com today", "john at example.com"), ("JOHN.B AT mail.example dot ORG", "JOHN.B AT mail.example dot ORG")])
def test_half_disguised_addresses(text, part):
    base, added = pii.find_all(text)
    assert not base and [(k, text[s:e]) for k, s, e in added] == [(0, part)]


def test_whole_addresses_and_plain_sentences_stay():
    assert pii.find_all("john@example.com dot the i")[0] == [(0, 0, 16)]
    for text in ("we met at noon. Then we left", "at 5.30 at 10.15", "john@example.com is it"):
        assert pii.find_all(text)[1] == []


def test_gates_hide_no_identifier(monkeypatch):
    signs = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and pii._char(chr(c)) != chr(c)]
    tamil, khmer = ("".join(chr(zero + int(d)) if d.isdigit() else d for d in "+1 202 555 0143") for zero in (0x0BE6, 0x17E0))
    circled = "+" + "".join("\u24ea\u2460\u2461\u2462\u2463\u2464"[int(d)] if d.isdigit() else d for d in "1 202 555 0143")
    rng = random.Random(8)
    parts = ["five", "Five", "FIVE", "f\u0131ve", "f\u0130ve", "one", "null", "un", "4", "16", ",", "-", " ", "(", "call:", "/", ".", " at ", "@", " dot ", "host", "com", "+", "[at]", "\u0967", "\u0be8", "\u24b6"]
    rows = [tamil, khmer, circled, "(two zero two five five five zero one four three)", "+1/two zero two, five five five zero one four three."]
    rows += [f"mail a{c}b@host{c}.com or +{c} 202 555 01{c}{c}" for c in signs]
    rows += ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(2, 25))) for _ in range(3000)]
    gated = [pii.find_all(t) for t in rows]
    assert [[k for k, _, _ in pii.find_all(t)[1]] for t in (tamil, khmer)] == [[3], [3]]
    monkeypatch.setattr(pii, "_cue", lambda text: True)
    monkeypatch.setattr(pii, "_foreign", lambda text: True)
    assert gated == [pii.find_all(t) for t in rows]


def test_personal_data_frame(shared):
    rows = [(1, None), (2, ""), (3, "A a@b.co B 1.2.3.4 and bob (at) site (dot) de"), (4, "clean text at noon, one or two dots. " * 2000), (5, "un deux trois")]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(shared, rows), mask=True).collect()}
    assert got[3].base_spans == "email:2:8,ip:11:18" and got[3].spans == "email:2:8,email:23:45,ip:11:18"
    assert got[3].masked == "A [EMAIL] B [IP] and [EMAIL]" and (got[3].n_email, got[3].n_ip, got[3].n_card, got[3].n_phone) == (1, 1, 0, 0)
    assert got[1].masked is None and got[1].spans == got[2].spans == got[4].spans == got[5].spans == "" and got[4].masked == rows[3][1]
    assert pii.find_personal_data(empty(shared)).count() == 0


# 9 language ID


def test_profiles_and_distance_by_hand(shared):
    train = [("en", "the cat and the dog and the hat"), ("en", "that is the thing then"), ("de", "der hund und die katze und der hut"), ("de", "das ist nicht schön"), (None, "zz"), ("fr", None)]
    got = language.learn_profiles(shared.createDataFrame(train, "lang string, text string"), top=60)
    count = {}
    for lang, t in train[:4]:
        t = f" {''.join(c if c.isalpha() else ' ' for c in t.lower())} "
        c = count.setdefault(lang, Counter())
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if g.strip() and g[1:-1].strip() == g[1:-1]:
                    c[g] += 1
    want = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:60]] for lang, c in sorted(count.items())}
    assert got == want
    rows = [(1, "the dog"), (2, "die katze"), (3, None), (4, "12 !?"), (5, ""), (6, "THE DOG " * 4000), (7, "язык")]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(frame(shared, rows), got, top=60).collect()}
    assert [out[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"] and out[3][1] == out[7][1] == 0 and all(0 <= s <= 1 for _, s in out.values())
    c = Counter()
    for n in (1, 2, 3):
        for i in range(len(" the dog ") - n + 1):
            g = " the dog "[i : i + n]
            if g.strip() and g[1:-1].strip() == g[1:-1]:
                c[g] += 1
    own = [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))]
    away = sum(min(60, abs(k - want["en"].index(g))) if g in want["en"] else 60 for k, g in enumerate(own))
    assert math.isclose(out[1][1], 1 - away / (60 * len(own)))
    assert {r.lang_pred for r in language.predict_language(frame(shared, rows), {}).collect()} == {"und"}
    assert language.learn_profiles(shared.createDataFrame(train, "lang string, text string").where("lang = 'xx'")) == {}


# 10 repeats


def brute_repeats(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        own = [b[k : k + length] for k in range(len(b) - length + 1)]
        lost = [False] * len(b)
        for k, s in enumerate(own):
            if s in seen:
                lost[k : k + length] = [True] * length
        seen.update(own)
        out[i] = (len(b), sum(lost), sum(lost[k] and not (k and lost[k - 1]) for k in range(len(b))), hashlib.sha256(bytes(c for c, x in zip(b, lost) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_all_strings(shared, seed):
    rng = random.Random(seed)
    rows = list(enumerate(texts(seed, 60)))
    base = "".join(rng.choice("ab \x00é") for _ in range(300))
    for _ in range(25):
        a = rng.randrange(250)
        rows.append((len(rows), "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) + base[a : a + rng.randint(20, 90)] + "q" * rng.randint(0, 80)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(shared, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_nothing_and_of_repeated_rows(shared):
    assert repeats.remove_repeats(empty(shared)).count() == 0
    t = "".join(chr(97 + k * k % 23) for k in range(70))
    got = repeats.remove_repeats(frame(shared, [(4, t), (4, t), (None, t), (6, t), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (2, 0), (4, 0), (4, 0), (6, 70)]


def test_suffixes_are_sorted_and_induced():
    rng = random.Random(9)
    for _ in range(40):
        parts = [bytes(rng.choice(b"abcab") for _ in range(rng.randint(1, 40))) for _ in range(30)]
        line = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        size = np.array([len(p) for p in parts])
        stop = np.repeat(np.cumsum(size + 1) - 1, size + 1)
        order = suffixes.two_stage(line, stop, line > 0, 64)
        suffix = [line[p : stop[p]].tobytes() for p in order]
        assert suffix == sorted(suffix) and len(suffix) == size.sum()
        shared_ = suffixes.common_prefixes(line, stop, order, 64)
        assert all(k == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b, k in zip(suffix, suffix[1:], shared_))


# helpers


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (packed.unpack_keys(packed.pack_keys(keys)) == keys).all()
        assert (packed.unpack_values(packed.pack_values(keys)) == keys).all()
        at = packed.cuts(keys, 7)
        assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()


def test_rows_are_numbered_within_groups(shared):
    rows = [(g, k) for g, n in (("a", 500), ("b", 3), (None, 4)) for k in range(n)]
    random.Random(1).shuffle(rows)
    got = tables.numbered(shared.createDataFrame(rows, "g string, k int"), ["g"], ["k"], "at").collect()
    assert len(got) == len(rows) and all(r.k == r["at"] for r in got)


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app-1"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(Session)
