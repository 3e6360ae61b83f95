"""Scores of the class model: by hand, as probabilities, and on held-out texts."""

from __future__ import annotations

import math

import numpy as np

from shieldline.llm import brown


def model():
    """Two word classes and the end mark; seven words of three types, four unseen types."""
    m = brown.Model.of_plain({"ends": 2, "tokens": 9, "types": 4, "d": 0.5, "unseen": 4.0})
    m.size, m.class_types = np.array([2.0, 4.0, 3.0]), np.array([1.0, 2.0, 1.0])
    m.log_next = np.log10(np.array([[0.2, 0.5, 0.3], [0.3, 0.3, 0.4], [0.6, 0.2, 0.2]]))
    return m


def test_scores_by_hand():
    m = model()
    base, score, known = m.score(np.array([1, 2, 1]), np.array([0, 2, 2, 3]), np.array([3, 0, 0]))
    # first text: a word seen three times, an unseen one of class 2, the end; second: the end; third: an unseen one of class 1
    unseen = lambda cls: 0.5 * m.class_types[cls] / m.size[cls] / max(1.0, 4.0 * m.class_types[cls] / 4)
    want = [math.log10(0.5 * 2.5 / 4) + math.log10(0.4 * unseen(2)) + math.log10(0.6), math.log10(0.2), math.log10(0.5 * unseen(1)) + math.log10(0.3)]
    assert np.allclose(score, want) and known.tolist() == [2, 1, 1]
    assert np.allclose(base, [math.log10(4 / 14) + math.log10(1 / 14) + math.log10(3 / 14), math.log10(3 / 14), math.log10(1 / 14) + math.log10(3 / 14)])


def test_a_class_gives_no_more_than_one():
    m = model()
    counts = {1: [3, 1], 2: [3]}
    for cls, seen in counts.items():
        n = len(seen)
        _, one, _ = m.score(np.full(n + 1, cls), np.arange(n + 2), np.array([*seen, 0]))
        emitted = 10 ** (one - m.log_next[0, cls] - m.log_next[cls, 0])
        unseen_types = max(1.0, 4.0 * m.class_types[cls] / 4)
        assert emitted[:-1].sum() + unseen_types * emitted[-1] <= 1 + 1e-9


def test_held_out_texts_are_foreseen_and_unseen_words_do_not_help(spark):
    rows = brown.op2_brown(spark, "/root/testdata/sf0.01").toPandas()
    held = rows[rows.held_out & (rows.n_tokens > 20)]
    per = lambda x, c: x[c].sum() / x.n_tokens.sum()
    assert per(held, "score") > per(held, "base_score")
    unseen = 1 - held.n_known / held.n_tokens
    assert np.corrcoef(unseen, held.score / held.n_tokens)[0, 1] < 0
    few, many = held[unseen <= unseen.quantile(0.25)], held[unseen >= unseen.quantile(0.75)]
    assert per(few, "score") > per(many, "score")
    for part in (few, many):
        assert per(part, "score") > per(part, "base_score")


def test_distinct_words_keep_their_spelling():
    import pyarrow as pa

    from shieldline.llm.textarrays import buffers, fold, hash_spans, words

    texts = ["Ab ab a1, été ÉTÉ naïve x", "", "zz zz !! été 12 a.b -", "日本 ñ"]
    raw, offsets = buffers(pa.array(texts))
    h, g, place, first = brown._tokens(raw, offsets)
    low = fold(raw)
    starts, ends, want_first = words(low, offsets)
    assert (h[place] == hash_spans(low, starts, ends)).all() and (first == want_first).all()
    assert (g[place] == brown.spelling(low, starts, ends)).all()


def test_more_shuffle_partitions_make_no_more_blocks(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(50)], "doc_id bigint, text string")
    before, told = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            told.append(brown._blocks(docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told == [4 * spark.sparkContext.defaultParallelism] * 2


def test_bigrams_come_from_the_written_lines(spark):
    """They were counted over the texts, which were cut into words once more."""
    import pyarrow as pa

    from shieldline.llm.packed import pack_values

    texts = ["the cat the dog the cat", "", "Xylophone the", "the zebra", None]
    train = [True, True, False, True, True]
    h, _, place, _ = brown._tokens(*_raw(texts))
    _, at = np.unique(h, return_index=True)
    counts = np.bincount(place, np.repeat(train, [6, 0, 2, 2, 0]), len(h)).astype(np.uint64)[at]
    told = pa.table({"_range": [0], "counts": pa.array([pack_values(counts)], pa.binary())})
    block = pa.table({"_block": pa.array([0] * 5, pa.int32()), "text": [t or "" for t in texts], "train": train})
    row = brown._lines(block, told).to_pylist()[0]
    lines = spark.createDataFrame([tuple(row.values())], brown._LINES)
    the, group = _hash("the"), {w: int(brown._tokens(*_raw([w]))[1][0]) for w in ("cat", "dog", "zebra")}
    got = {(r.a, r.b): r.n for r in brown._bigrams(lines, brown._Units(np.array([the], dtype=np.uint64))).collect()}
    t, end = brown.SPELLED + 1, brown.END
    want = [(end, t), (t, group["cat"]), (group["cat"], t), (t, group["dog"]), (group["dog"], t), (t, group["cat"]), (group["cat"], end),
            (end, end), (end, t), (t, group["zebra"]), (group["zebra"], end), (end, end)]
    assert got == {p: want.count(p) for p in want}


def _raw(texts):
    import pyarrow as pa

    from shieldline.llm.textarrays import buffers

    return buffers(pa.array([t or "" for t in texts]))


def _hash(word):
    return brown._tokens(*_raw([word]))[0][0]


def test_only_units_whose_turn_it_is_are_moved():
    """Types of all units are told, whosever turn it is."""
    import pyarrow as pa

    from shieldline.llm.packed import pack_keys, pack_values

    rng = np.random.default_rng(3)
    classes, units = 4, 40
    width = 2 * classes + 1
    keys = np.unique(rng.integers(1, 1 << 60, units).astype(np.uint64))
    of = rng.integers(1, classes, units)
    code = np.unique(rng.integers(0, units * width, 300))
    n = rng.integers(1, 9, len(code))
    table = rng.integers(50, 99, (classes, classes)) * 100.0
    rows = pa.table({"_range": pa.array([0], pa.int32()), "_block": pa.array([7], pa.int32()), "keys": [pack_keys(keys)], "classes": [pack_values(of)],
                     "codes": [pack_keys(code.astype(np.uint64))], "counts": [pack_values(n)]})
    moved = []
    for turn in (0, 1):
        shared = type("Sent", (), {"value": (table, 2, turn)})()
        told = brown._moved(classes, shared)((pa.scalar(0, pa.int32()),), rows).to_pylist()
        new = brown.unpack_values(told[0]["classes"]).astype(int)
        mine = brown.splitmix(keys) % np.uint64(2) == np.uint64(turn)
        sums = np.zeros((units, width))
        sums[code // width, code % width] = n
        best, gain = brown.best_classes(of, sums[:, :classes], sums[:, classes:-1], sums[:, -1], table)
        some = sums.sum(axis=1) > 0
        assert (new == np.where(mine & some & (gain > 1e-9), best, of)).all()
        assert told[1]["types"] == np.bincount(new[some], minlength=classes).tolist()
        moved.append((new != of).sum())
    assert sum(moved) > 0


def test_counted_in_four_bytes_or_eight():
    for top in (1 << 31, (1 << 31) + 5, 1 << 40):
        codes = np.array([top - 1, 0, top - 1, 7], dtype=np.int64)
        u, n = brown._counted(codes, top)
        assert u.tolist() == [0, 7, top - 1] and n.tolist() == [1, 1, 2] and u.dtype == np.int64
