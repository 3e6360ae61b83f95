"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

From at most ``SAMPLE`` labelled training rows (those of least hash of the id;
the documented bound of the classifier's sample) a lexicon of words and word
beginnings is learned: those much more frequent in toxic texts.  Every text
becomes a few numbers: densities of the lexicon's words and beginnings, their
nearness to words of address, capitals, punctuation, and rates of obfuscation
(signs inside words, stretched letters, hits that show only after undoing
both).  Trees are boosted over three quarters of the sample; on the last
quarter an isotonic regression turns their margins into probabilities.

A training text's lexicon hits are counted without that text's own share, so
the trees see them as they will see new texts.  Scores depend on the text only.

Very long texts are read whole, in time in proportion to their length.  Other
columns are not looked at, whatever their names; repeated rows are scored each.
Null and empty texts are scored like any other (no words).  Rows without a
label, and repeated labels of one document beyond the greatest, are not learned
from.  Where the sample has no or only one kind of label, every score is its
share of toxic rows (0 for an empty sample).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.tables import documents, extended, remainder, written

SAMPLE = 40_000
#: Terms of the lexicon at most, and the toxic rows and log odds each has at least.
TERMS, LEAST_ROWS, LEAST_ODDS = 4_000, 3, 1.0
STEM = 5
NEAR = 4

ADDRESS = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestra vuestro".split())
_UNDO = str.maketrans("0134579@$!|*", "oleastqasiix")
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$!|*._-]+[^\W\d_]+)+")
_LONG = re.compile(r"([^\W\d_])\1\1+")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]")
_CAPS = re.compile(r"\b[A-ZÄÖÜÉÈÊÇÑÁÍÓÚ]{2,}\b")
_UPPER = re.compile(r"[A-ZÄÖÜÉÈÊÇÑÁÍÓÚ]")


class Lexicon:
    """Terms with the toxic and clean rows that have them ("~" marks a beginning)."""

    def __init__(self, terms: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.terms, self.toxic, self.clean = terms, toxic, clean
        self.odds = {t: self._odds(a, b, toxic, clean) for t, (a, b) in terms.items()}

    @staticmethod
    def _odds(a: int, b: int, toxic: int, clean: int) -> float:
        return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))

    def odds_of(self, term: str, label: int | None) -> float:
        """Log odds of a term; with a label, without one row of that label."""
        if label is None:
            return self.odds.get(term, 0.0)
        if (own := self.terms.get(term)) is None:
            return 0.0
        a, b = own[0] - label, own[1] - (1 - label)
        odds = self._odds(a, b, self.toxic - label, self.clean - (1 - label))
        return odds if a >= LEAST_ROWS - 1 and odds >= LEAST_ODDS else 0.0


def features(text: str | None, lexicon: Lexicon, label: int | None = None) -> list[float]:
    """The dense features of a text."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    terms = lexicon.terms
    hits, best, total = [], 0.0, 0.0
    stems, best_stem = 0, 0.0
    address = []
    for i, w in enumerate(words):
        if w in terms and (o := lexicon.odds_of(w, label)) > 0:
            hits.append(i)
            total += o
            best = max(best, o)
        if len(w) > STEM and (s := "~" + w[:STEM]) in terms and (o := lexicon.odds_of(s, label)) > 0:
            stems += 1
            best_stem = max(best_stem, o)
        if w in ADDRESS:
            address.append(i)
    near, k = 0, 0
    for i in hits:
        while k < len(address) and address[k] < i - NEAR:
            k += 1
        near += k < len(address) and address[k] <= i + NEAR
    odd = _ODD.findall(low)
    stretched = _LONG.findall(low)
    undone = 0
    for w in odd:
        w = re.sub(r"[._-]+", "", w.translate(_UNDO))
        undone += lexicon.odds_of(w, label) > 0
    for w in words if stretched else ():  # each word once, however many stretches it has
        if n_stretched := len(_LONG.findall(w)):
            undone += n_stretched * any(lexicon.odds_of(_LONG.sub(r, w), label) > 0 for r in (r"\1", r"\1\1"))
    return [
        len(hits) / n, math.log1p(len(hits)), best, total / n, stems / n, math.log1p(stems), best_stem,
        len(address) / n, near / n, len(_UPPER.findall(text)) / chars, len(_CAPS.findall(text)) / n,
        text.count("!") / chars, text.count("?") / chars, len(_PUNCT.findall(text)) / chars,
        len(odd) / n, len(stretched) / n, math.log1p(undone), math.log1p(len(words))]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """From (text, toxic): the terms much more frequent in toxic rows."""
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), ""))
    long = F.filter(words, lambda w: F.length(w) > STEM)
    terms = F.concat(words, F.array_distinct(F.transform(long, lambda w: F.concat(F.lit("~"), F.substring(w, 1, STEM)))))
    count = sample.select("toxic", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    odds = F.log((a + 0.5) / (totals.a + 1)) - F.log((b + 0.5) / (totals.n - totals.a + 1))
    best = count.where((a >= LEAST_ROWS) & (odds >= LEAST_ODDS)).orderBy(F.desc(a * odds), "term").limit(TERMS)
    return Lexicon({r.term: (r.a, r.n - r.a) for r in best.collect()}, totals.a, totals.n - totals.a)


def with_features(df: DataFrame, lexicon: Lexicon, kept: list[str], label_col: str | None = None) -> DataFrame:
    """The ``kept`` columns and ``features``; reads ``text`` and the label if given."""
    shared = df.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.toxic, lexicon.clean))
    out = df.select("text", *kept)
    schema = extended(df.select(*kept), "features array<double>")
    label_at = None if label_col is None else out.columns.index(label_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*shared.value)
        for batch in batches:
            labels = [None] * batch.num_rows if label_at is None else batch.column(label_at).to_pylist()
            rows = [features(t, own, y) for t, y in zip(batch.column(0).to_pylist(), labels)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], names=[*kept, "features"])

    return out.mapInArrow(compute, schema)


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows, ``most`` of least hash.  The
    ids are that many at most, so they are broadcast to the documents."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Model:
    """Lexicon, trees and calibration; or one share for all texts."""

    def __init__(self, sample: DataFrame, trees: int = 30, depth: int = 4):
        self.lexicon = learn_lexicon(sample)
        self.share = self.lexicon.toxic / max(1, self.lexicon.toxic + self.lexicon.clean)
        self.trees = None
        if not 0 < self.share < 1:
            return
        rows = with_features(sample, self.lexicon, ["doc_id", "toxic"], "toxic").select(
            array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"),
            (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0).alias("calibrate"))
        rows = written(rows.repartition(6), "toxic-features")
        fit, rest = rows.where("not calibrate"), rows.where("calibrate")
        if fit.agg(F.countDistinct("label")).first()[0] < 2 or rest.agg(F.countDistinct("label")).first()[0] < 2:
            fit = rest = rows
        self.trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=5, seed=11).fit(fit)
        self.isotonic = IsotonicRegression(featuresCol="margin", labelCol="label").fit(self._margin(rest))

    def _margin(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame, kept: list[str]) -> DataFrame:
        """The ``kept`` columns of ``docs`` and ``score``; reads ``text``."""
        if self.trees is None:
            return docs.select(*kept, F.lit(self.share).alias("score"))
        rows = with_features(docs, self.lexicon, kept).withColumn("features", array_to_vector("features"))
        found = self.isotonic.setPredictionCol("score").transform(self._margin(rows))
        return found.select(*kept, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = remainder("doc_id", 5) == 0
    model = Model(written(training_sample(docs.where(~held), labels.where(~held)), "toxic-sample"))
    return (model.score(docs.select("doc_id", "text"), ["doc_id"])
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
