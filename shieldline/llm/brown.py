"""Brown class-based n-gram scoring.

log10 P(text) is the sum over its tokens of log10 P(class | class before) and
log10 P(word | class).  Tokens are lower-case words between blanks, then one
end mark; a text begins in the state behind an end mark.

Counts cover every training row.  Texts are dealt into blocks; blocks and key
ranges exchange packed counts (see ``packed``), so each block learns the corpus
count of each of its distinct words, rare ones included.

Classes.  Every word of ``OWN`` or more training tokens is a unit of its own;
the words seen less often, unseen ones too, share a unit with those spelled
alike (``SPELLED`` groups: signs, length, ending, accents).  Exchange clustering
moves each unit to the class that raises the corpus likelihood most, given the
classes of its neighbours.  It has two parts:

1. The start: the words that make up ``HEAVY`` of all tokens or more (1 / HEAVY
   at most) and the groups, as units of all other words, are clustered over
   their bigram table.  A word begins in the class of its group.
2. Rounds over all units: texts are written once as the numbers of their units
   within the block.  In each round a block sums how often each of its units follows and
   precedes each class; ranges of units add the sums up, try the moves of half
   of their units and tell each block the classes of its units by position.
   Rounds go on until one gains less than ``GAIN`` nats a token.  If the moves
   of a round hinder each other, it is undone and fewer units move at a time.

Smoothing.  Class transitions are mixed with class frequencies (a Dirichlet
prior of weight ``PRIOR``).  Of each word count ``d`` is taken away (absolute
discounting) and given, per class, to its unseen words: the number of unseen
types is estimated from the types seen once and twice, and a class has the share
in them that it has in the types seen.  So a word gains nothing by being unseen.

Repeated rows count and are scored each; other columns are not looked at,
whatever their names; very long texts are read whole, an empty table gives no rows.
Null texts count as empty: they are one end mark.  Without training rows all
classes are equally likely and every word is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.packed import block_of, blocks_for, cuts, pack_keys, pack_values, unpack_keys, unpack_values
from shieldline.llm.tables import documents, remainder, written
from shieldline.llm.textarrays import BLANK_WORD, buffers, fold, hash_spans, pieces, splitmix, words

OWN = 2
GAIN = 0.005
HEAVY = 1 / 4096
SPELLED = 512
CLASSES = 96
ROUNDS = 8
PRIOR = 50.0

#: Text bytes of a block at most, on average.
BLOCK_BYTES = 8 << 20
#: Tokens that are counted at once.
STEP = 1 << 19

END = 0  # the unit of the end mark; spelled groups follow, then heavy words

#: What stands for a spelled group among the hashes of words: spread over all ranges.
_GROUP_KEYS = np.arange(SPELLED + 1, dtype=np.uint64) * np.uint64((1 << 64) // (SPELLED + 1))


def spelling(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group (1 to SPELLED) of each word by how it is spelled."""
    letter = np.zeros(256, dtype=bool)
    letter[97:123] = True
    wide = raw >= 128
    digit = (raw >= 48) & (raw <= 57)
    sign = ~letter[raw] & ~wide & ~digit
    within = lambda mask: (lambda t: t[ends] - t[starts])(np.concatenate([[0], np.cumsum(mask)]))
    n_wide, n_digit, n_sign = within(wide), within(digit), within(sign)
    long = np.minimum((ends - starts + 2) // 4, 3)
    last, first = raw[ends - 1], raw[starts]
    tail = np.where(letter[last], 0, np.where((last == 44) | (last == 46), 1, 2))
    at = np.flatnonzero(wide)
    accent = np.zeros(len(starts), dtype=np.int64)
    if len(at):
        k = np.minimum(np.searchsorted(at, starts), len(at) - 1)
        second = np.minimum(at[k] + 1, len(raw) - 1)
        accent = np.where(n_wide > 0, raw[second].astype(np.int64) & 63, 0)
    bare = raw[np.maximum(ends - 1 - (tail > 0), starts)]
    plain = (bare.astype(np.int64) - 97).clip(0, 25) * 12 + long * 3 + tail  # 312
    accented = 312 + accent * 3 + tail  # 192, up to 504
    other = 504 + np.where(n_digit > 0, 0, 4) + long
    group = np.where((n_digit > 0) | (n_sign >= ends - starts) | (n_sign > 1), other, np.where(n_wide > 0, accented, plain))
    return 1 + group % SPELLED


def _tokens(raw: np.ndarray, offsets: np.ndarray):
    """(distinct word hashes, their spelled groups, word numbers, first): the
    words of texts, in order, as numbers of the distinct ones."""
    raw = fold(raw)
    starts, ends, first = words(raw, offsets, BLANK_WORD)
    place, h = pd.factorize(hash_spans(raw, starts, ends))
    where = np.zeros(len(h), dtype=np.int64)
    where[place] = np.arange(len(place))  # any place of a word tells how it is spelled
    size = (ends - starts)[where]
    stop = np.cumsum(size)
    own = raw[np.repeat(starts[where] - (stop - size), size) + np.arange(int(size.sum()))]  # each word once
    return h, spelling(own, stop - size, stop) if len(h) else np.zeros(0, np.int64), place, first


def _block_tokens(texts):
    raw, offsets = buffers(texts)
    for i, j in pieces(offsets):
        yield i, j, *_tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _requests(ranges: int):
    def send(key, table):
        """Distinct words of a block: their training counts and spelled groups."""
        hs, gs, cs = [], [], []
        train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, h, g, place, first in _block_tokens(table.column("text")):
            learned = np.repeat(train[i:j], np.diff(first))
            hs.append(h)
            gs.append(g)
            cs.append(np.bincount(place, learned, len(h)).astype(np.uint64))
        h, g, c = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hs, gs, cs))
        u, where, place = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(place, c, len(u)).astype(np.uint64)
        at = cuts(u, ranges)
        parts = [(u[a:b], c[a:b], g[where[a:b]]) for a, b in zip(at, at[1:])]
        return pa.table({
            "_range": pa.array(range(ranges), pa.int32()), "_block": pa.array([key[0].as_py()] * ranges, pa.int32()),
            "keys": [pack_keys(k) for k, _, _ in parts], "counts": [pack_values(n) for _, n, _ in parts],
            "groups": [pack_values(s) for _, _, s in parts]},
            schema=pa.schema([("_range", pa.int32()), ("_block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("groups", pa.binary())]))

    return send


_ANSWER = "_block int, _range int, keys binary, counts binary, groups binary, rare array<bigint>, types bigint, words bigint, once bigint, twice bigint"
_ANSWER_ARROW = pa.schema([("_block", pa.int32()), ("_range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("groups", pa.binary()),
                           ("rare", pa.list_(pa.int64())), ("types", pa.int64()), ("words", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])


def _merge(key, table):
    """The corpus count of each word of a range: one answer per block, and one
    row (block null) with the heavy words, their groups, the types seen less than
    OWN times per group and the number of all types."""
    blocks = table.column("_block").to_pylist()
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_values(x) for x in table.column("counts").to_pylist()]
    groups = [unpack_values(x) for x in table.column("groups").to_pylist()]
    u, where, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(np.float64), len(u)).astype(np.uint64)
    group = np.concatenate(groups)[where].astype(np.int64)
    stops = np.cumsum([len(k) for k in keys])
    r = key[0].as_py()
    rows = [(b, r, None, pack_values(total[place[s - len(k) : s]]), None, None, None, None, None, None) for b, k, s in zip(blocks, keys, stops)]
    seen = total > 0
    rare = np.bincount(group[seen & (total < OWN)], minlength=SPELLED + 1)
    many = total >= max(2, int(total.sum() * HEAVY))  # a range's share is less than the corpus's: none is missed
    rows.append((None, r, pack_keys(u[many]), pack_values(total[many]), pack_values(group[many]), rare.tolist(), int(seen.sum()), int(total.sum()), int((total == 1).sum()), int((total == 2).sum())))
    return pa.Table.from_pylist([dict(zip(_ANSWER_ARROW.names, x)) for x in rows], schema=_ANSWER_ARROW)


class _Units:
    """Heavy words with their units; every other word's unit is its group."""

    def __init__(self, heavy: np.ndarray):
        self.heavy = np.sort(heavy)

    def of(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        unit = group.astype(np.int64)
        if len(self.heavy):
            k = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
            unit = np.where(self.heavy[k] == h, SPELLED + 1 + k, unit)
        return unit


def _with_ends(unit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Units of texts with the end mark behind each."""
    return np.insert(unit, first[1:], END)


def _bigrams(lines: DataFrame, units: _Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a, over all training rows."""
    shared = lines.sparkSession.sparkContext.broadcast(units.heavy)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Units(shared.value)
        total = SPELLED + 1 + len(own.heavy)
        kept, counts, held = [], [], 0
        for batch in batches:
            for line, keys, groups in zip(*batch.columns):
                line = unpack_values(line.as_py()).astype(np.int32)
                unit = np.append(own.of(unpack_keys(keys.as_py()), unpack_values(groups.as_py())), END)  # the number behind the last is the end mark
                before = END
                for x in range(0, len(line), STEP):
                    here = unit[line[x : x + STEP]]
                    k, n = _counted(np.concatenate([[before], here[:-1]]) * total + here, total * total)
                    before = here[-1]
                    kept.append(k)
                    counts.append(n)
                    held += len(k)
                    if held > 1 << 23:
                        kept, counts = _added(kept, counts)
                        held = len(kept[0])
                        if held > 1 << 22:
                            yield _pairs(kept[0], counts[0], total)
                            kept, counts, held = [], [], 0
        if kept:
            kept, counts = _added(kept, counts)
            yield _pairs(kept[0], counts[0], total)

    return lines.select("line", "keys", "groups").mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _counted(codes: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of ``codes``, which are below ``stop``, and how often each
    occurs: four bytes are sorted in half the time of eight."""
    u, n = np.unique(codes.astype(np.int32) if stop <= 1 << 31 else codes, return_counts=True)
    return u.astype(np.int64), n


def _added(keys: list, counts: list):
    u, place = np.unique(np.concatenate(keys), return_inverse=True)
    return [u], [np.bincount(place, np.concatenate(counts), len(u)).astype(np.int64)]


def _pairs(k: np.ndarray, n: np.ndarray, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k // total, pa.int32()), pa.array(k % total, pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def best_class(own: int, before: np.ndarray, behind: np.ndarray, self_n: float, table: np.ndarray) -> tuple[int, float]:
    """The class that gives a unit the greatest likelihood, and what is gained.

    ``before``/``behind``: how often the unit follows / precedes each class,
    other units only; ``self_n``: how often it follows itself; ``table``:
    transitions between classes with the unit in class ``own``."""
    n = before.sum() + behind.sum()
    if n + self_n == 0:
        return own, 0.0
    t = table.astype(np.float64).copy()
    t[:, own] -= before
    t[own, :] -= behind
    t[own, own] -= self_n
    rows, cols = t.sum(axis=1) + before, t.sum(axis=0) + behind
    w_row, w_col = behind.sum() + self_n, before.sum() + self_n
    k = len(t)
    diag = np.arange(k)
    # likelihood terms that change if the unit goes to class c: column c, row c and their crossing
    col = (_xlogx(t + before[:, None]) - _xlogx(t)).sum(axis=0)
    row = (_xlogx(t + behind[None, :]) - _xlogx(t)).sum(axis=1)
    cross = t[diag, diag]
    gain = col + row - (_xlogx(cross + before) - _xlogx(cross)) - (_xlogx(cross + behind) - _xlogx(cross))
    gain += _xlogx(cross + before + behind + self_n) - _xlogx(cross)
    gain -= _xlogx(rows + w_row) - _xlogx(rows) + _xlogx(cols + w_col) - _xlogx(cols)
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def exchange(bigrams: DataFrame, count: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts of class pairs.  The end mark
    keeps class 0 for itself; the others start in classes dealt by frequency."""
    order = [u for u in np.argsort(-count, kind="stable") if u != END]
    of = np.zeros(len(count), dtype=np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    table = _transitions(bigrams, of, classes)
    ahead = bigrams.select(F.col("a").alias("u"), F.col("b").alias("v"), "n", F.lit(True).alias("ahead"))
    behind = bigrams.select(F.col("b").alias("u"), F.col("a").alias("v"), "n", F.lit(False).alias("ahead"))
    sides = ahead.unionByName(behind).where(F.col("u") != END)
    for k in range(rounds):
        moves = sorted(_moves(sides.where(F.pmod(F.col("u") + k, F.lit(2)) == 0), of, table), key=lambda m: -m[2])
        # moves of one round may hinder each other: then only the better part is made
        for part in (len(moves), len(moves) // 4):
            new = of.copy()
            for u, c, _ in moves[:part]:
                new[u] = c
            after = _transitions(bigrams, new, classes) if part else table
            if _likelihood(after) > _likelihood(table):
                of, table = new, after
                break
    return of, table


def _moves(sides: DataFrame, of: np.ndarray, table: np.ndarray) -> list[tuple[int, int, float]]:
    """(unit, class, gain) of the units that another class suits better.  Counts
    are summed per unit and class before units are tried, side by side."""
    shared = sides.sparkSession.sparkContext.broadcast((of, table))
    sums = sides.join(F.broadcast(_class_table(sides.sparkSession, of, "v", "c")), "v").groupBy(
        "u", "ahead", "c", (F.col("u") == F.col("v")).alias("self")).agg(F.sum("n").alias("n"))

    def attempt(rows):
        classes_of, t = shared.value
        out = []
        for unit, own in rows.groupby("u"):
            c, n, ahead, alike = (own[x].to_numpy() for x in ("c", "n", "ahead", "self"))
            side = lambda which: np.bincount(c[which], n[which], len(t))  # noqa: B023, E731
            best, gain = best_class(int(classes_of[unit]), side(~ahead & ~alike), side(ahead & ~alike), float(n[ahead & alike].sum()), t)
            if best and gain > 0:
                out.append((int(unit), best, gain))
        return pd.DataFrame(out, columns=["u", "c", "gain"])

    found = sums.groupBy((F.col("u") % 24).alias("_part")).applyInPandas(attempt, "u int, c int, gain double")
    return [(r.u, r.c, r.gain) for r in found.collect()]  # one row per unit at most


def _class_table(spark: SparkSession, of: np.ndarray, unit: str, cls: str) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({unit: np.arange(len(of), dtype=np.int32), cls: of.astype(np.int32)}))


def _transitions(bigrams: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class pairs: classes squared rows at most."""
    spark = bigrams.sparkSession
    a, b = (F.broadcast(_class_table(spark, of, x, f"c{x}")) for x in "ab")
    rows = bigrams.join(a, "a").join(b, "b").groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((classes, classes))
    for r in rows:
        table[r.ca, r.cb] = r.n
    return table


def _likelihood(table: np.ndarray) -> float:
    return _xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum()


def best_classes(own: np.ndarray, before: np.ndarray, behind: np.ndarray, self_n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_class`` of several units at once (a row each), class 0 left out:
    only classes that a unit meets are looked at."""
    m, k = before.shape
    unit, diag = np.arange(m), np.arange(k)
    w_row, w_col = behind.sum(axis=1) + self_n, before.sum(axis=1) + self_n

    def side(met: np.ndarray, other: np.ndarray, t: np.ndarray) -> np.ndarray:
        i, r = np.nonzero(met)
        left = t[r].astype(np.float64)  # what each class has left with the class that is met
        left[np.arange(len(i)), own[i]] -= met[i, r]
        at_home = np.flatnonzero(r == own[i])
        left[at_home] -= other[i[at_home]]
        left[at_home, r[at_home]] -= self_n[i[at_home]]
        gain = _xlogx(left + met[i, r][:, None]) - _xlogx(left)
        out = np.zeros((m, k))
        starts = np.searchsorted(i, unit)
        some = np.flatnonzero(np.diff(np.append(starts, len(i))))
        if len(some):
            out[some] = np.add.reduceat(gain, starts[some], axis=0)
        return out

    gain = side(before, behind, table) + side(behind, before, table.T)
    cross = np.tile(table[diag, diag].astype(np.float64), (m, 1))
    cross[unit, own] -= before[unit, own] + behind[unit, own] + self_n
    rows, cols = np.tile(table.sum(axis=1), (m, 1)), np.tile(table.sum(axis=0), (m, 1))
    rows[unit, own] -= w_row
    cols[unit, own] -= w_col
    gain -= _xlogx(cross + before) + _xlogx(cross + behind) - _xlogx(cross) - _xlogx(cross + before + behind + self_n[:, None])
    gain -= _xlogx(rows + w_row[:, None]) - _xlogx(rows) + _xlogx(cols + w_col[:, None]) - _xlogx(cols)
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    return best, gain[unit, best] - gain[unit, own]


def _told(told: pa.Table, name: str) -> np.ndarray:
    """What the ranges told a block, in the order of its ascending keys."""
    rows = sorted((r, v) for r, v in zip(told.column("_range").to_pylist(), told.column(name).to_pylist()) if v is not None)
    return np.concatenate([unpack_values(v) for _, v in rows]) if rows else np.zeros(0, np.uint64)


class _Block:
    """The words of a block's texts and the units they belong to."""

    def __init__(self, texts, known: np.ndarray):
        self.parts = [(i, j, h, g, place.astype(np.int32), first) for i, j, h, g, place, first in _block_tokens(texts)]
        h, g = (np.concatenate([p[x] for p in self.parts] or [np.zeros(0, t)]) for x, t in ((2, np.uint64), (3, np.int64)))
        self.words, where = np.unique(h, return_index=True)
        self.group, self.known = g[where].astype(np.int64), known
        self.keys, self.unit = np.unique(np.where(known >= OWN, self.words, _GROUP_KEYS[self.group]), return_inverse=True)

    def lines(self):
        """(first text, text behind the last, word numbers, first) of the pieces."""
        for i, j, h, _, place, first in self.parts:
            yield i, j, np.searchsorted(self.words, h)[place], first


_LINES = "_block int, line binary, keys binary, groups binary"
_SUMS = "_range int, _block int, keys binary, classes binary, codes binary, counts binary"
_PLACED = "_block int, _range int, classes binary, keys binary, types array<bigint>"
_PLACED_ARROW = pa.schema([("_block", pa.int32()), ("_range", pa.int32()), ("classes", pa.binary()), ("keys", pa.binary()), ("types", pa.list_(pa.int64()))])


def _lines(texts, told):
    """The training texts of a block as numbers of its units (the number behind
    the last is the end mark), with the spelled groups of the units."""
    block = _Block(texts.column("text"), _told(told, "counts"))
    group = np.zeros(len(block.keys), dtype=np.int64)
    group[block.unit] = block.group
    train = texts.column("train").to_numpy(zero_copy_only=False).astype(bool)
    line = [np.insert(block.unit[word], first[1:], len(block.keys))[np.repeat(train[i:j], np.diff(first) + 1)].astype(np.int32)
            for i, j, word, first in block.lines()]
    line = np.concatenate(line) if line else np.zeros(0, np.int32)
    own = texts.column("_block").slice(0, 1) if len(texts) else pa.array([], pa.int32())
    n = len(own)
    packed = (pa.array([x][:n], pa.binary()) for x in (pack_values(line), pack_keys(block.keys), pack_values(group)))
    return pa.table([own, *packed], names=["_block", "line", "keys", "groups"])


def _sums(ranges: int, classes: int, shared):
    """Sums of a block: per range, its units, their classes and how often each
    follows (code < classes), precedes (< 2 classes) a class or follows itself;
    and one row (range null) with the counts of class pairs.  ``shared``: the
    heavy words and the classes that units start from."""
    width, step = 2 * classes + 1, STEP

    def send(lines, told):
        rows = []
        for block_id, line, keys, groups in zip(*(lines.column(c).to_pylist() for c in ("_block", "line", "keys", "groups"))):
            line, keys = unpack_values(line).astype(np.int32), unpack_keys(keys)
            end, found, table = len(keys), [], np.zeros(classes * classes, dtype=np.int64)
            of = np.zeros(end + 1, dtype=np.int64)
            if len(told):
                of[:-1] = _told(told, "classes")
            else:
                heavy, first_of = shared.value
                of[:-1] = first_of[_Units(heavy).of(keys, unpack_values(groups))]
            for x in range(0, len(line), step):
                here = line[x : x + step].astype(np.int64)
                last = np.concatenate([[line[x - 1] if x else end], here[:-1]])
                table += np.bincount(of[last] * classes + of[here], minlength=len(table))
                alike = last == here
                after, ahead = (here != end) & ~alike, (last != end) & ~alike
                codes = [here[after] * width + of[last[after]], last[ahead] * width + classes + of[here[ahead]], here[alike & (here != end)] * width + 2 * classes]
                found.append(_counted(np.concatenate(codes), end * width))
            code, n = (np.concatenate([f[x] for f in found] or [np.zeros(0, np.int64)]) for x in (0, 1))
            if len(found) > 1:
                [code], [n] = _added([code], [n])
            at = cuts(keys, ranges)
            edges = np.searchsorted(code, at * width)
            for r, (a, b, x, y) in enumerate(zip(at, at[1:], edges, edges[1:])):
                if b > a:
                    rows.append((r, block_id, pack_keys(keys[a:b]), pack_values(of[a:b]), pack_keys((code[x:y] - a * width).astype(np.uint64)), pack_values(n[x:y])))
            cells = np.flatnonzero(table)
            rows.append((None, block_id, None, None, pack_keys(cells.astype(np.uint64)), pack_values(table[cells])))
        names = ["_range", "_block", "keys", "classes", "codes", "counts"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return send


def _moved(classes: int, shared):
    """The new class of each unit of a range: one answer per block, and one row
    (block null) with the groups, their classes and the types of own words per class."""
    width = 2 * classes + 1

    def move(key, rows):
        t, share, turn = shared.value
        blocks = rows.column("_block").to_pylist()
        keys = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
        stops = np.cumsum([len(k) for k in keys])
        u, where, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        of = np.concatenate([unpack_values(x) for x in rows.column("classes").to_pylist()])[where].astype(np.int64)
        turns = splitmix(u) % np.uint64(share) == np.uint64(turn % share) if share else np.zeros(len(u), dtype=bool)
        seen, codes, counts = np.zeros(len(u), dtype=bool), [np.zeros(0, np.int64)], [np.zeros(0)]
        for x, y, s, k in zip(rows.column("codes").to_pylist(), rows.column("counts").to_pylist(), stops, keys):
            c = unpack_keys(x).astype(np.int64)
            unit = c // width
            c -= unit * width
            unit = place[s - len(k) + unit]
            seen[unit] = True
            mine = np.flatnonzero(turns[unit])  # only units whose turn it is are added up
            codes.append(unit[mine] * width + c[mine])
            counts.append(unpack_values(y)[mine].astype(np.float64))
        code, again = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(again, np.concatenate(counts), len(code))
        own, new = code // width, of.copy()
        tried = np.unique(own)
        for some in (tried[k : k + 512] for k in range(0, len(tried), 512)):
            lo, hi = np.searchsorted(own, some[0]), np.searchsorted(own, some[-1], side="right")
            mine = lo + np.flatnonzero(np.isin(own[lo:hi], some))
            sums = np.zeros((len(some), width))
            sums[np.searchsorted(some, own[mine]), code[mine] % width] = n[mine]
            best, gain = best_classes(of[some], sums[:, :classes], sums[:, classes:-1], sums[:, -1], t)
            new[some] = np.where(gain > 1e-9, best, of[some])
        group = np.isin(u, _GROUP_KEYS)
        types = np.bincount(new[seen & ~group], minlength=classes)
        r = key[0].as_py()
        out = [(b, r, pack_values(new[place[s - len(k) : s]]), None, None) for b, k, s in zip(blocks, keys, stops)]
        out.append((None, r, pack_values(new[group]), pack_keys(u[group]), types.tolist()))
        return pa.Table.from_pylist([dict(zip(_PLACED_ARROW.names, x)) for x in out], schema=_PLACED_ARROW)

    return move


def _pair_table(sums: DataFrame, classes: int) -> np.ndarray:
    """Counts of class pairs over all blocks: classes squared rows at most."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, n in zip(f["codes"], f["counts"]):
                yield pd.DataFrame({"cell": unpack_keys(k).astype(np.int32), "n": unpack_values(n).astype(np.int64)})

    rows = sums.where("_range is null").select("codes", "counts").mapInPandas(cells, "cell int, n bigint")
    table = np.zeros(classes * classes)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    return table.reshape(classes, classes)


def _removed(df: DataFrame) -> None:
    """Takes away a written table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(lines: DataFrame, heavy: np.ndarray, of: np.ndarray, ranges: int, classes: int) -> tuple[DataFrame, np.ndarray]:
    """The classes of all units (rows of ``_PLACED``) and the counts of class
    pairs.  ``lines``: rows of ``_LINES``, taken away at the end; ``heavy``,
    ``of``: what the units start from."""
    spark = lines.sparkSession
    sc = spark.sparkContext
    # a step's shuffle files go when its result is written: rounds do not pile them up
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        start = sc.broadcast((heavy, of))
        none = spark.createDataFrame([], _PLACED)
        placed, kept, share, turn = None, None, 2, 0

        def moved(sums: DataFrame, table: np.ndarray, share: int) -> DataFrame:
            asked = sums.where("_range is not null").groupBy("_range").applyInArrow(_moved(classes, sc.broadcast((table, share, turn))), _PLACED)
            return written(asked, "word-classes")

        while True:
            own = (none if placed is None else placed).where("_block is not null").select("_block", "_range", "classes")
            sums = written(lines.groupBy("_block").cogroup(own.groupBy("_block")).applyInArrow(_sums(ranges, classes, start), _SUMS), "class-sums")
            table = _pair_table(sums, classes)
            likelihood = _likelihood(table)
            gain = likelihood - kept[3] if kept else np.inf
            if kept:
                _removed(kept[1] if gain > 0 else sums)
            if gain > 0:
                kept = (placed, sums, table, likelihood)
            if gain < 0 and share < 16:
                share *= 2
            elif gain < GAIN * max(table.sum(), 1):
                break
            placed = moved(kept[1], kept[2], share)
            turn += 1
        placed = kept[0] if kept[0] is not None else moved(kept[1], kept[2], 0)
        for used in (lines, kept[1]):
            _removed(used)
        return placed, kept[2]
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


class Model:
    """Class transitions, class sizes and what a word's emission needs; the
    classes of units stay a DataFrame, ``placed``."""

    def __init__(self, answers: DataFrame, dealt: DataFrame, ranges: int, classes: int = CLASSES, rounds: int = ROUNDS):
        totals = answers.where("_block is null")
        sums = totals.agg(F.sum("words").alias("words"), F.sum("types").alias("types"), F.sum("once").alias("once"), F.sum("twice").alias("twice"), *[
            F.sum(F.get("rare", F.lit(g))).alias(f"t{g}") for g in range(SPELLED + 1)]).first()
        self.ends = ends = dealt.where("train").count()
        words_n = sums.words or 0
        self.tokens = words_n + ends
        self.types = (sums.types or 0) + (ends > 0)
        heavy = _Units(np.array([h for h, _ in _heavy(totals, max(2, int(np.ceil(words_n * HEAVY))))], dtype=np.uint64))
        told = answers.where("_block is not null").select("_block", "_range", "counts")
        lines = written(dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(_lines, _LINES), "unit-lines")
        bigrams = written(_bigrams(lines, heavy), "bigrams")
        count = np.zeros(SPELLED + 1 + len(heavy.heavy))
        for r in bigrams.groupBy("b").agg(F.sum("n").alias("n")).collect():  # one row per unit
            count[r.b] = r.n
        of, _ = exchange(bigrams, count, classes, rounds)
        self.placed, table = settle(lines, heavy.heavy, of, ranges, classes)
        types = np.zeros(classes)
        for r in self.placed.where("_block is null").select("classes", "keys", "types").toLocalIterator():  # one row per range
            types += r.types
            for key, c in zip(unpack_keys(r["keys"]), unpack_values(r["classes"])):
                types[int(c)] += sums[f"t{int(np.searchsorted(_GROUP_KEYS, key))}"] or 0
        types[of[END]] += ends > 0
        once, twice = sums.once or 0, sums.twice or 0
        self.d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.unseen = max(1.0, once * once / (2 * twice) if twice else float(once))  # how many types were not seen, by those seen once and twice
        self.size, self.class_types = table.sum(axis=0), types
        share = (self.size + 1) / (self.size.sum() + classes)
        self.log_next = np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))

    def plain(self) -> dict:
        """The model as plain values, for a broadcast."""
        return {k: v for k, v in vars(self).items() if k != "placed"}

    @classmethod
    def of_plain(cls, values: dict) -> Model:
        model = cls.__new__(cls)
        vars(model).update(values)
        return model

    def score(self, of: np.ndarray, first: np.ndarray, count: np.ndarray):
        """(base score, score, known tokens) of texts, given the class and the
        training count of each of their words."""
        n = len(first) - 1
        of = _with_ends(of, first)  # the end mark's class is its unit
        step = self.log_next[np.concatenate([[END], of[:-1]]), of]
        own = np.insert(count.astype(np.float64), first[1:], -1.0)
        size, types = self.size[of], self.class_types[of]
        # what discounting leaves for the unseen words of a class, dealt over as many unseen types as it has a share in all types
        share = np.maximum(types, 1) / max(1.0, self.class_types.sum())
        unseen = np.where(size > 0, self.d * np.maximum(types, 1) / np.maximum(size, 1), 1.0) / np.maximum(1.0, self.unseen * share)
        emit = np.where(own < 0, 1.0, np.where(own > 0, np.maximum(own - self.d, 0) / np.maximum(size, 1), np.minimum(unseen, 1.0)))
        text = np.repeat(np.arange(n), np.diff(first) + 1)
        seen = np.where(own < 0, self.ends, own)
        base = np.log10((seen + 1) / (self.tokens + self.types + 1))
        return np.bincount(text, base, n), np.bincount(text, step + np.log10(emit), n), np.bincount(text, seen > 0, n)


def _heavy(totals: DataFrame, least: int) -> list[tuple[int, int]]:
    """(hash, group) of the words with ``least`` or more tokens: 1 / HEAVY at most."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, n, g in zip(f["keys"], f["counts"], f["groups"]):
                k, n, g = unpack_keys(k), unpack_values(n), unpack_values(g)
                keep = n >= least
                yield pd.DataFrame({"h": k[keep].view(np.int64), "g": g[keep].astype(np.int32)})

    rows = totals.select("keys", "counts", "groups").mapInPandas(choose, "h bigint, g int").collect()
    return [(r.h % (1 << 64), r.g) for r in rows]


def _blocks(docs: DataFrame) -> int:
    """Blocks by the size of the texts, four for each core at least.  Every round
    sends a row from each block to each range and back, so their number must not
    follow the number of shuffle partitions."""
    return blocks_for(docs, block_bytes=BLOCK_BYTES, least=4 * docs.sparkSession.sparkContext.defaultParallelism)


def score_texts(docs: DataFrame, train_col: str, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity
    of all texts; the model learns from the rows whose ``train_col`` is true."""
    spark = docs.sparkSession
    blocks = _blocks(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train_col, F.lit(True)).alias("train"))
    dealt = docs.withColumn("_block", block_of("doc_id", blocks))
    asked = dealt.groupBy("_block").applyInArrow(_requests(blocks), "_range int, _block int, keys binary, counts binary, groups binary")
    answers = written(asked.groupBy("_range").applyInArrow(_merge, _ANSWER), "word-counts")
    model = Model(answers, dealt, blocks, classes, rounds)
    shared = spark.sparkContext.broadcast(model.plain())
    kind = docs.schema["doc_id"].dataType

    def score(texts, told):
        m = Model.of_plain(shared.value)
        block = _Block(texts.column("text"), _told(told, "counts"))
        of = _told(told, "classes").astype(np.int64)[block.unit]
        base, own, seen, size = [], [], [], []
        for _, _, word, first in block.lines():
            b, s, k = m.score(of[word], first, block.known[word])
            base.append(b)
            own.append(s)
            seen.append(k)
            size.append(np.diff(first) + 1)
        base, own, seen, size = (np.concatenate(x) if x else np.zeros(0) for x in (base, own, seen, size))
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": size.astype(np.int64), "n_known": seen.astype(np.int64),
                         "train_tokens": np.full(len(size), m.tokens, dtype=np.int64), "base_score": base, "score": own,
                         "perplexity": 10 ** (-own / np.maximum(size, 1))})

    mine = answers.where("_block is not null").select("_block", "_range", "counts", F.lit(None).cast("binary").alias("classes")).unionByName(
        model.placed.where("_block is not null").select("_block", "_range", F.lit(None).cast("binary").alias("counts"), "classes"))
    return dealt.select("_block", "doc_id", "text").groupBy("_block").cogroup(mine.groupBy("_block")).applyInArrow(
        score, f"doc_id {kind.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("train", remainder("doc_id", 7) != 2)
    return score_texts(docs, "train").select(
        "doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
