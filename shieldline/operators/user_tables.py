"""Screening by the user's own tables: a lexicon for ROT13, phrases, keywords.

The built-in lists are literals of a projection.  A user's table may have any
number of rows, so it stays a table:

* ``with_flips``: the distinct words of all texts are joined to the lexicon
  once, as read and as ROT13 reads them; what is left are the few words to turn.
  Texts meet these over their own distinct words (AQE broadcasts the words where
  they are few), and take them along as an array.
* ``with_phrase_score``: one automaton over all phrases scans each text once.
* ``with_keyword_score``: counts of distinct (text, word) meet the keywords.

Texts are named by a hash of the text, not by an id: rows without an id, or
that repeat one, are screened like any other, and equal texts are read once.
Which words turn depends on the word alone, so a hash that two texts share
changes nothing there; for keyword counts the text's length is added to it.
Null words and phrases are left out; empty ones too, but an empty phrase.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import matching as mt
from ..functions import normalize as nz
from ..functions import scoring as sc
from ..session import written

_NAME = ["_h", "_len"]
#: Bytes of a written table's files whose words a task counts.
PART_BYTES = 16 << 20


def _named(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumns({"_h": F.xxhash64(text_col), "_len": F.length(text_col)})


def with_flips(df: DataFrame, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``df`` (written on the way, so that it is computed once) with ``_flips``:
    the words of ``text_col`` that ROT13 turns into words of ``lexicon`` (word)
    and that are none themselves; null if there are none."""
    df = written(_named(df, text_col), "before-lexicon")
    lex = lexicon.select(F.lower("word").alias("word")).where("word is not null and word <> ''").distinct()
    words = df.select(*_NAME, F.explode(F.array_distinct(nz.tokens(F.col(text_col)))).alias("tok")).where(F.col("tok").rlike("[A-Za-z]"))
    read = words.select("tok").distinct().withColumns({"low": F.lower("tok"), "rot": F.lower(nz.rot13(F.col("tok")))})
    flips = (read.join(lex.withColumnRenamed("word", "rot"), "rot", "left_semi")
             .join(lex.withColumnRenamed("word", "low"), "low", "left_anti").select("tok"))
    own = words.join(flips, "tok").groupBy(*_NAME).agg(F.collect_set("tok").alias("_flips"))
    return df.join(own, _NAME, "left").drop(*_NAME)


def with_phrase_score(df: DataFrame, text_col: str, phrases: DataFrame, weight: int = fv.W_ARABIC_PHRASE) -> DataFrame:
    """``df`` with ``arabic_kw_score``: ``weight`` for each row of ``phrases``
    (phrase) that the folded text contains; equal phrases score each."""
    listed = [r.phrase for r in phrases.select("phrase").where("phrase is not null").toLocalIterator()]
    found = mt.literal_ids(df.sparkSession, nz.arabic_fold(F.col(text_col)), [nz.arabic_fold_py(p) for p in listed])
    return df.withColumn("arabic_kw_score", (F.size(found) * weight).cast("int"))


def _in_parts(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a written table by ``names`` in parts of about ``PART_BYTES`` of its
    files, at least one a core: a task counts the words of as many texts whatever
    the table's size."""
    spark = df.sparkSession
    size = sum(spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration())
               .getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f)).getLen() for f in df.inputFiles())
    return df.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES)), *names)


def with_keyword_score(df: DataFrame, text_col: str, keywords: DataFrame, weight: int = fv.W_KEYWORD) -> DataFrame:
    """``df`` with ``keyword_score``: ``weight`` for every word of ``text_col``
    that ``keywords`` (word) holds, repeats included."""
    df = written(_named(df, text_col), "before-keywords")
    known = keywords.select(F.lower("word").alias("w")).where("w is not null and w <> ''").distinct()
    texts = _in_parts(df.select(*_NAME, text_col), _NAME).dropDuplicates(_NAME)
    counts = texts.select(*_NAME, F.explode(sc.words(F.col(text_col))).alias("w")).groupBy(*_NAME, "w").agg(F.count("*").alias("n"))
    own = counts.join(known, "w", "left_semi").groupBy(*_NAME).agg((F.sum("n") * weight).cast("int").alias("keyword_score"))
    return df.join(own, _NAME, "left").drop(*_NAME).withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0)))
