"""Many literals and many rules in one pass over each text.

Spark has no operator that looks for thousands of literals at once: a chain of
``contains`` reads the text once for each, and the plan grows with the list.
Here a list becomes an Aho-Corasick automaton in the Python worker, and an
Arrow UDF scans each text once, whatever the length of the list.

* ``literal_ids``: which literals of a list a text contains.
* ``rule_hits``: which rules match.  A rule is a candidate where one of its
  anchors occurs (rules without anchors always are); candidates alone are
  matched, all texts of a batch at once, by RE2.  RE2 runs in linear time, so
  no text makes a rule with open gaps run long.  A pattern that RE2 has not
  (look-arounds, back-references) is matched by Python's ``re``.

Lists reach the tasks as broadcasts of ``PART_BYTES`` each.  A list of several
parts is several UDF columns whose results are concatenated in order, so there
is no bound on its length but a worker's memory; ``operators.rule_tables``
matches rules as a table where even that is too little.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of literals and patterns of one broadcast.
PART_BYTES = 16 << 20
#: Bytes of texts that are matched at once.
SLICE_BYTES = 4 << 20
#: Automata that a worker keeps.
KEPT = 8

_built: OrderedDict[object, object] = OrderedDict()


def built(sent, make: Callable):
    """``make`` of a broadcast's value, once per worker."""
    key = (sent._path if hasattr(sent, "_path") and sent._path else id(sent), make.__name__)
    if key not in _built:
        _built[key] = make(sent.value)
        while len(_built) > KEPT:
            _built.popitem(last=False)
    _built.move_to_end(key)
    return _built[key]


def folded(text: str) -> str:
    """Lower case, with the two letters that a case-insensitive pattern takes
    for ASCII ones."""
    low = text.lower()
    return low if low.isascii() else low.replace("ſ", "s").replace("K", "k")


class Literals:
    """An automaton over literals; ``owners[k]`` are the owners of literal k."""

    def __init__(self, owned: Iterable[tuple[str, int]]):
        place: dict[str, list[int]] = {}
        for literal, owner in owned:
            place.setdefault(literal, []).append(owner)
        self.everywhere = place.pop("", [])  # the empty literal is in every text
        self.owners = [sorted(set(v)) for v in place.values()]
        self.automaton = ahocorasick.Automaton()
        for k, literal in enumerate(place):
            self.automaton.add_word(literal, k)
        if place:
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        """The owners of the literals that occur in a text."""
        out = set(self.everywhere)
        if self.owners:
            for k in {k for _, k in self.automaton.iter(text)}:
                out.update(self.owners[k])
        return out


def parts_of(rows: list, size: Callable[[object], int]) -> list[list]:
    """``rows`` in order, cut into parts of about ``PART_BYTES``."""
    out, used = [[]], 0
    for row in rows:
        used += size(row)
        if used > PART_BYTES and out[-1]:
            out.append([])
            used = size(row)
        out[-1].append(row)
    return out


def _lists(per_row: list[list[int]], values: pa.Array) -> pa.ListArray:
    """A list column of ``values`` by place."""
    ends = np.cumsum([0, *map(len, per_row)])
    flat = np.array([k for row in per_row for k in row], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(flat)))


def slices(texts: pa.Array) -> Iterable[pa.Array]:
    """A batch in pieces of about ``SLICE_BYTES``, however long its texts."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)] if len(texts) else []
    for a, b in zip(starts, starts[1:]):
        yield texts.slice(a, b - a)


def _automaton(owned: list[tuple[str, int]]) -> Literals:
    return Literals(owned)


def literal_ids(spark: SparkSession, text: Column, literals: list[str]) -> Column:
    """The places (from 0, ascending) in ``literals`` of those that ``text``
    contains, as array<int>; equal literals are all told.  A null text contains
    none."""
    numbered = [(s, k) for k, s in enumerate(literals)]
    return F.concat(*[_ids_udf(spark.sparkContext.broadcast(p))(text) for p in parts_of(numbered, lambda x: len(x[0].encode()) + 16)])


def _ids_udf(sent):
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        own = built(sent, _automaton)
        return pa.array([[] if t is None else sorted(own.found(t)) for s in slices(texts) for t in s.to_pylist()], pa.list_(pa.int32()))

    return ids


class Rules:
    """The rules of one part, ready to match whole batches."""

    def __init__(self, rules: list):
        self.rules = rules
        self.always = [k for k, r in enumerate(rules) if not r.anchors]
        self.anchors = Literals((folded(a), k) for k, r in enumerate(rules) for a in r.anchors)
        self.values = pa.StructArray.from_arrays(
            [pa.array([getattr(r, f) for r in rules], pa.string()) for f in ("rule_id", "pattern", "category", "grp")],
            names=["rule_id", "pattern", "category", "grp"])
        self.layers = [r.layer for r in rules]

    def matches(self, texts: pa.Array) -> list[list[int]]:
        """For every text the rules that match, in order."""
        candidates: dict[int, list[int]] = {}
        rows = texts.to_pylist()
        for i, text in enumerate(rows):
            if text is not None:
                for k in self.anchors.found(folded(text)):
                    candidates.setdefault(k, []).append(i)
        some = [i for i, text in enumerate(rows) if text is not None]
        candidates |= {k: some for k in self.always}
        out: list[list[int]] = [[] for _ in rows]
        for k in sorted(candidates):
            for i in self._matching(k, texts, rows, candidates[k]):
                out[i].append(k)
        return out

    def _matching(self, k: int, texts: pa.Array, rows: list, at: list[int]) -> list[int]:
        return matching_rows(self.rules[k].pattern, self.rules[k].engine_pattern, texts, rows, at)


def matching_rows(pattern: str, engine_pattern: str, texts: pa.Array, rows: list, at: list[int]) -> list[int]:
    """Those of the places ``at`` whose texts (``rows``: the same as a list)
    a rule's pattern matches."""
    if not at:
        return []
    try:
        hit = pc.match_substring_regex(texts.take(pa.array(at)), pattern=engine_pattern)
        return [i for i, h in zip(at, hit.to_pylist()) if h]
    except pa.ArrowInvalid:
        own = re.compile(pattern, re.I | re.S)
        return [i for i in at if own.search(rows[i])]


def _rules(rules: list) -> Rules:
    return Rules(rules)


HIT_TYPE = "struct<rule_id:string,pattern:string,category:string,grp:string>"


def _rules_udf(sent, layers: tuple[str, ...]):
    @F.arrow_udf(f"struct<{','.join(f'`{x}`:array<{HIT_TYPE}>' for x in layers)}>")
    def hits(texts: pa.Array) -> pa.Array:
        own = built(sent, _rules)
        found = [row for s in slices(texts) for row in own.matches(s)]
        cols = [_lists([[k for k in row if own.layers[k] == x] for row in found], own.values) for x in layers]
        return pa.StructArray.from_arrays(cols, names=list(layers))

    return hits


_sent: OrderedDict[tuple, list] = OrderedDict()


def _parts_sent(spark: SparkSession, rules: tuple) -> list:
    """Broadcasts of the parts of a pack, the same for every use of it."""
    key = (spark.sparkContext.applicationId, hash(rules), rules)
    if key not in _sent:
        _sent[key] = [spark.sparkContext.broadcast(p) for p in parts_of(list(rules), lambda r: len(r.pattern.encode()) + sum(len(a.encode()) for a in r.anchors) + 64)]
        while len(_sent) > KEPT:
            _sent.popitem(last=False)
    _sent.move_to_end(key)
    return _sent[key]


def rule_hits(spark: SparkSession, text: Column, rules: Iterable, layers: tuple[str, ...]) -> list[Column]:
    """For every part of the rules (in their order), a struct with one array of
    hits for each layer."""
    return [_rules_udf(p, layers)(text) for p in _parts_sent(spark, tuple(rules))]
