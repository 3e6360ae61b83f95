"""A classifier for the model layer, learned from what reviewers decided.

``training_set`` labels log entries by their latest review, ``fit_text_model``
fits a Spark ML pipeline (word and word-pair hashes, inverse document
frequencies, class-weighted logistic regression) and ``model_quality`` measures
it on entries it was not fitted to.  The fitted pipeline is saved and loaded
with ``save_model`` / ``load_model``; it is broadcast by Spark ML and scores
inside the JVM, so it is loaded once per executor.

``score_with_pipeline`` scores gated rows only.  A model that cannot be applied
stops the job: verdicts without it would look like those of the whole job.
"""

from __future__ import annotations

import warnings

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regex import WORD
from ..session import scratch_path, written
from .review import latest_reviews

#: Hashed features of words, and as many of word pairs.
FEATURES = 1 << 16
#: One in so many examples is held out, by a hash of its id.
HELD_OUT = 5
TEXT = "_model_text"
_MADE = [TEXT, "_m_words", "_m_pairs", "_m_tf", "_m_tf2", "_m_all", "_m_features", "_m_raw", "_m_probability", "_m_prediction"]


def training_set(log: DataFrame, reviews: DataFrame) -> DataFrame:
    """(id, text, label, held_out): log entries with a review, 1.0 where the
    latest one blocks the entry or sends it to training, 0.0 where it approves."""
    latest = latest_reviews(reviews).select(F.col("item_id").alias("id"), F.when(F.col("action") == "approve", 0.0).otherwise(1.0).alias("label"))
    return log.join(latest, "id").select(
        "id", F.coalesce("normalized_text", F.lit("")).alias("text"), "label", (F.crc32(F.col("id")) % HELD_OUT == 0).alias("held_out"))


def fit_text_model(examples: DataFrame, features: int = FEATURES, reg: float = 0.002) -> PipelineModel:
    """A pipeline from (text, label); both classes weigh the same, however
    unequal their numbers.  Rows without a label are left out."""
    rows = examples.where("label is not null").select(F.coalesce("text", F.lit("")).alias(TEXT), F.col("label").cast("double").alias("_m_label"))
    count = rows.agg(F.count("*").alias("n"), F.count_if(F.col("_m_label") == 1).alias("one")).first()
    if not 0 < count.one < count.n:
        raise ValueError(f"{count.n} examples, {count.one} of them positive: both classes are needed")
    weight = F.when(F.col("_m_label") == 1, count.n / (2 * count.one)).otherwise(count.n / (2 * (count.n - count.one)))
    # Texts are cut and hashed once, and the tables written: what the regression reads
    # some sixty times has neither the texts nor the frequencies in its lineage.
    hashing = PipelineModel(stages=[
        RegexTokenizer(inputCol=TEXT, outputCol="_m_words", pattern=f"{WORD}+", gaps=False),
        NGram(n=2, inputCol="_m_words", outputCol="_m_pairs"),
        HashingTF(numFeatures=features, binary=True, inputCol="_m_words", outputCol="_m_tf"),
        HashingTF(numFeatures=features, binary=True, inputCol="_m_pairs", outputCol="_m_tf2"),
        VectorAssembler(inputCols=["_m_tf", "_m_tf2"], outputCol="_m_all")])
    hashed = written(hashing.transform(rows.withColumn("_m_weight", weight)).select("_m_all", "_m_label", "_m_weight"), "hashed")
    idf = IDF(minDocFreq=2, inputCol="_m_all", outputCol="_m_features").fit(hashed)
    weighed = written(idf.transform(hashed).drop("_m_all"), "weighed")
    regression = LogisticRegression(featuresCol="_m_features", labelCol="_m_label", weightCol="_m_weight", regParam=reg, maxIter=60, standardization=False,
                                    rawPredictionCol="_m_raw", probabilityCol="_m_probability", predictionCol="_m_prediction").fit(weighed)
    return PipelineModel(stages=[*hashing.stages, idf, regression])


def save_model(model: PipelineModel, path: str | None = None, spark=None) -> str:
    """Writes the pipeline, into the shared folder if no path is given."""
    path = path or scratch_path(spark, "text-model")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(df: DataFrame, model: PipelineModel, text: F.Column | str) -> DataFrame:
    """``df`` with ai_prediction and ai_confidence (of the predicted class, four
    digits) for every row whose ``text`` is not null.  A model that does not fit
    these rows raises what it raises: no row of the job would be scored."""
    text = F.col(text) if isinstance(text, str) else text
    given = df.withColumns({"_m_given": text.isNotNull(), TEXT: F.coalesce(text, F.lit(""))})
    one = model.transform(given).withColumn("_m_one", vector_to_array("_m_probability")[1])
    pred = (F.col("_m_one") >= 0.5).cast("int")
    conf = F.round(F.greatest("_m_one", 1 - F.col("_m_one")), 4)
    return one.withColumns({"ai_prediction": F.when(F.col("_m_given"), pred), "ai_confidence": F.when(F.col("_m_given"), conf)}).drop(*_MADE, "_m_one", "_m_given")


def predicted(df: DataFrame, model: PipelineModel, text: F.Column | str) -> DataFrame:
    """``scored``, and ``ai_failure``: null, or why the model cannot be applied.
    Then every row with a text has (0, 0.0) and the reason beside it, and a
    warning tells so.  Screening and ``model_quality`` stop instead."""
    try:
        return scored(df, model, text).withColumn("ai_failure", F.lit(None).cast("string"))
    except Exception as failure:  # noqa: BLE001 - whatever the model raises
        why = f"{type(failure).__name__}: {failure}"
        warnings.warn(f"the model cannot be applied: {why}", RuntimeWarning, stacklevel=2)
        given = (F.col(text) if isinstance(text, str) else text).isNotNull()
        return df.withColumns({"ai_prediction": F.when(given, 0), "ai_confidence": F.when(given, 0.0), "ai_failure": F.when(given, F.lit(why))})


def score_with_pipeline(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``ai_prediction`` and ``ai_confidence`` of the gated rows."""
    return scored(df, model, F.when(F.col("ai_activated"), F.coalesce("normalized_text", F.lit(""))))


def model_quality(model: PipelineModel, examples: DataFrame) -> DataFrame:
    """One row: n, tp, fp, tn, fn, precision, recall, f1 and accuracy."""
    rows = scored(examples.where("label is not null"), model, F.coalesce("text", F.lit("")))
    p, y = F.col("ai_prediction") == 1, F.col("label") == 1
    c = rows.agg(F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                 F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n"))})
