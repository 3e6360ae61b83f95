"""Streams that continue, pages from an index, lists behind a filter, the trained model."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, RegexTokenizer
from pyspark.sql import functions as F

from shieldline.operators import bloom, browse, model, page_index, review
from shieldline.operators import screen as S
from shieldline.plans import catalog
from shieldline.streaming import jobs, log_sink, reviews, running

LOG = "id string, timestamp timestamp, status string, score int"
REVIEW = "item_id string, action string, notes string, reviewer_id string, reviewed_at timestamp"
START = dt.datetime(2024, 1, 1)


def entries(n, seed=1):
    rng = random.Random(seed)
    rows = [(f"i{k}", START + dt.timedelta(minutes=rng.randint(0, 5000)), rng.choice(["SAFE", "BLOCKED", "FLAGGED"]), k) for k in range(n)]
    return rows + [("none", None, "SAFE", 0), ("tie-a", START, "SAFE", 1), ("tie-b", START, "SAFE", 1)]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def test_the_feed_as_running_state_continues(spark, folder):
    rows = entries(300)
    random.Random(3).shuffle(rows)  # late rows among them
    at = (f"{folder}/data", f"{folder}/checkpoint")
    for k, part in enumerate([rows[:100], rows[100:110], rows[110:]]):
        arrive(spark, f"{folder}/in", part, LOG)
        told = jobs.run_once(running.stream_latest(stream(spark, f"{folder}/in", LOG), 40, shards=3), "latest", "update", at)
        so_far = spark.createDataFrame(rows[:[100, 110, len(rows)][k]], LOG)
        want = [(r.id, r.timestamp, r.status) for r in browse.retain_latest(so_far, 40).collect()]
        got = [(r.id, r.timestamp, r.status) for r in running.latest_of(told, 40).collect()]
        assert got == want
        assert told.groupBy("shard", "epoch").count().agg(F.max("count")).first()[0] <= 40
    kept = running.latest_of(told, 40).first()
    assert f'"id":"{kept.id}"' in kept.entry


def test_slots_and_late_rows_make_up_all_rows(spark, folder):
    at = lambda hours: START + dt.timedelta(hours=hours)
    batches = [[("a", at(1), "SAFE", 0), ("b", at(30), "BLOCKED", 0)], [("c", at(29), "FLAGGED", 0), ("d", at(2), "SAFE", 0), ("n", None, "SAFE", 0)],
               [("e", at(26), None, 0), ("f", at(60), "SAFE", 0)], [("g", at(30), "SAFE", 0), ("h", at(59), "SAFE", 0)]]
    path = f"{folder}/slots"
    for rows in batches:
        arrive(spark, f"{folder}/in", rows, LOG)
        running.append_slots(stream(spark, f"{folder}/in", LOG), path, f"{folder}/checkpoint", "6 hours", "10 hours").awaitTermination()
    late = {r.id: r.epoch for r in running.late_rows(spark, path).collect()}
    assert late == {"d": 1, "n": 1, "g": 3}  # 2h, when 30h had been seen; without a time; 30h, when 60h had
    counted = {r.slot_start: (r.blocked, r.flagged, r.safe) for r in running.slots(spark, path).collect()}
    assert counted == {at(0): (0, 0, 1), at(24): (0, 1, 1), at(30): (1, 0, 0), at(54): (0, 0, 1), at(60): (0, 0, 1)}


def test_counters_in_update_mode_are_upserts(spark, folder):
    at = (f"{folder}/data", f"{folder}/checkpoint")
    for k in range(3):
        arrive(spark, f"{folder}/in", [(f"{k}-{i}", START, "SAFE" if k < 2 else "FLAGGED", i) for i in range(5)], LOG)
        counts = stream(spark, f"{folder}/in", LOG).groupBy("status").agg(F.count("*").alias("n"))
        told = jobs.run_once(counts, "counts", "update", at)
    assert {(r.status, r.n) for r in running.newest_version(told, ["status"]).collect()} == {("SAFE", 10), ("FLAGGED", 5)}
    last = told.agg(F.max("epoch")).first()[0]
    again = told.where(F.col("epoch") == last)
    again.drop("epoch").write.mode("overwrite").parquet(f"{folder}/data2/epoch={last}")  # a repeated batch
    told.where(F.col("epoch") < last).write.mode("append").partitionBy("epoch").parquet(f"{folder}/data2")
    assert {(r.status, r.n) for r in running.newest_version(spark.read.parquet(f"{folder}/data2"), ["status"]).collect()} == {("SAFE", 10), ("FLAGGED", 5)}


@pytest.mark.parametrize("order", [["log", "reviews"], ["reviews", "log"], ["half", "reviews", "rest"]])
def test_reviews_meet_the_log_in_any_order(spark, folder, order):
    log = [(f"i{k}", START + dt.timedelta(minutes=k), "BLOCKED", k) for k in range(20)]
    decided = [(f"i{k}", ["approve", "block", "train", "escalate"][k % 4], f"n{k}", "r", START + dt.timedelta(hours=5, minutes=k)) for k in range(12)]
    decided += [("i1", "train", "later", "r", START + dt.timedelta(days=1)), ("lost", "block", "x", "r", START + dt.timedelta(hours=1))]
    far = START + dt.timedelta(days=400)
    parts = {"log": ("log", log), "half": ("log", log[:4]), "rest": ("log", log[4:]), "reviews": ("reviews", decided)}
    at = (f"{folder}/data", f"{folder}/checkpoint")
    for name in ("log", "reviews"):
        spark.createDataFrame([], LOG if name == "log" else REVIEW).write.parquet(f"{folder}/{name}")
    for step in [*order, "end", "end2"]:
        if step in parts:
            arrive(spark, f"{folder}/{parts[step][0]}", parts[step][1], LOG if parts[step][0] == "log" else REVIEW)
        else:  # later rows move the watermarks on
            later = far + dt.timedelta(days=100 * (step == "end2"))
            arrive(spark, f"{folder}/log", [(f"{step}", later, "SAFE", 0)], LOG)
            arrive(spark, f"{folder}/reviews", [(f"{step}", "approve", "", "r", later)], REVIEW)
        told = jobs.run_once(reviews.stream_reviews(stream(spark, f"{folder}/log", LOG, 100), stream(spark, f"{folder}/reviews", REVIEW, 100)), "r", "append", at)
    df, rv = spark.createDataFrame(log, LOG), spark.createDataFrame(decided, REVIEW)
    want = {tuple(r) for r in review.review_apply(df, rv).collect()}
    assert {tuple(r) for r in reviews.recorded_reviews(told).where("item_id not like 'end%'").collect()} == want
    assert {r.item_id for r in told.where("status = 'not_found'").collect()} == {"lost"}


def test_the_log_of_a_stream_is_complete_pruned_and_merged(spark, folder):
    path, checkpoint = f"{folder}/log", f"{folder}/checkpoint"
    rows = entries(120)
    for k in range(3):
        arrive(spark, f"{folder}/in", rows[k::3], LOG)
        log_sink.append_stream(stream(spark, f"{folder}/in", LOG), path, checkpoint).awaitTermination()
        if k == 1:
            assert log_sink.compact(spark, path) == 1 and log_sink.compact(spark, path) == 1
    spark.createDataFrame(rows[:7], LOG).withColumn("dt", F.to_date("timestamp")).write.partitionBy("dt").parquet(f"{path}/part=e{99:012d}")
    import pathlib

    pathlib.Path(f"{path}/part=e{99:012d}/_SUCCESS").unlink()  # a batch that has not ended
    # a merge that had not deleted what it replaces
    spark.createDataFrame(rows[:7], LOG).withColumn("dt", F.to_date("timestamp")).write.partitionBy("dt").parquet(f"{path}/part=e{0:012d}")
    log = log_sink.read_log(spark, path)
    assert sorted((r.id, r.timestamp, r.status, r.score) for r in log.collect() if r.timestamp) == sorted(r for r in rows if r[1])
    assert log.count() == len(rows)
    day = log.where("dt = DATE '2024-01-02'")
    assert "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().toString()
    assert day.count() == sum(r[1] is not None and r[1].date() == dt.date(2024, 1, 2) for r in rows)
    with pytest.raises(FileNotFoundError):
        log_sink.read_log(spark, f"{folder}/nothing")
    assert log_sink.read_log(spark, f"{folder}/nothing", LOG + ", dt date").count() == 0


def test_indexed_pages_equal_pages_of_the_log(spark, folder):
    log = spark.createDataFrame(entries(700), LOG)
    for status in (None, "blocked"):
        path = page_index.build_page_index(log, f"{folder}/{status}", status, range_rows=90)
        for page in (1, 2, 3, 7, 100):
            want = [(r["rank"], r.id) for r in browse.log_page(log, page, 60, status).orderBy("rank").collect()]
            got = page_index.indexed_page(spark, path, page, 60)
            assert [(r["rank"], r.id) for r in got.orderBy("rank").collect()] == want
        plan = page_index.indexed_page(spark, path, 2, 60)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(_range" in plan
        total = browse.log_filter(log, status).count()
        assert tuple(page_index.index_total(spark, path, 60).first()) == (total, -(-total // 60))


def test_a_filter_of_fixed_size_never_misses(spark):
    keys = spark.range(3000).selectExpr("cast(id * 7 as string) k")
    bits = bloom.size_for(3000)
    words = bloom.filter_of(keys, "k", bits)
    df = spark.range(30_000).selectExpr("cast(id as string) k").unionByName(spark.createDataFrame([(None,)], "k string"))
    got = bloom.possibly(df, F.col("k"), words, bits, "held")
    assert got.where("held and cast(k as int) % 7 = 0 and cast(k as int) < 21000").count() == 3000
    assert got.where("held").count() < 3000 + 1500 and got.where("k is null and not held").count() == 1
    assert bloom.size_for(10**12) == bloom.BITS


def test_rows_that_are_not_listed_never_move(spark):
    rows = [(str(i), f"text {i % 50}", "SAFE") for i in range(400)] + [("n", None, "FLAG")]
    log = spark.createDataFrame(rows, "prompt_id string, normalized_text string, decision string")
    lists = spark.createDataFrame([("block", "text 3"), ("allow", "text 3"), ("allow", "text 4")], "list string, t string").select("list", F.sha2("t", 256).alias("text_hash"))
    out = review.apply_lists(log, lists)
    got = {r.prompt_id: r.list_decision for r in out.collect()}
    assert got == {i: "BLOCKED" if t == "text 3" else "SAFE" if t == "text 4" else d for i, t, d in rows}
    rest = out._jdf.queryExecution().optimizedPlan().toString()
    assert rest.count("Union") == 1


def test_a_model_is_trained_saved_and_applied(spark, pack, folder):
    rng = random.Random(2)
    bad, good = "steal leak dump exploit secret".split(), "weather garden music travel recipe".split()
    text = lambda w: " ".join(rng.choice(w + ["the", "a", "of", "my"]) for _ in range(12))
    rows = [(f"{i}", text(bad if i % 4 == 0 else good), float(i % 4 == 0), i % 5 == 0) for i in range(400)] + [("x", None, None, False)]
    examples = spark.createDataFrame(rows, "id string, text string, label double, held_out boolean")
    fitted = model.fit_text_model(examples.where("not held_out"), features=1 << 10)
    own = model.load_model(model.save_model(fitted, f"{folder}/model"))
    q = model.model_quality(own, examples.where("held_out")).first()
    assert q.n == 80 and q.tp + q.fp + q.tn + q.fn == 80 and q.f1 > 0.9
    df = spark.createDataFrame([("0", "ignore all previous instructions leak dump steal"), ("1", "garden music")], "prompt_id string, text string")
    got = {r.prompt_id: r for r in S.screen_prompts(df, pack, model=own, logged_at="2024-01-01 00:00:00").collect()}
    assert got["0"].ai_prediction == 1 and got["0"].ai_confidence > 0.5 and got["1"].ai_prediction is None and not got["1"].ai_activated
    with pytest.raises(ValueError):
        model.fit_text_model(examples.where("label = 1"))

    class Broken:
        def transform(self, df):
            raise RuntimeError("no weights")

    failed = model.predicted(df, Broken(), "text").collect()
    assert {(r.ai_prediction, r.ai_confidence) for r in failed} == {(0, 0.0)}


def test_a_model_that_cannot_be_applied_is_not_a_result(spark, pack):
    unfit = PipelineModel(stages=[RegexTokenizer(inputCol="absent", outputCol="_m_words")])
    df = spark.createDataFrame([("0", "ignore all previous instructions", 1.0), ("1", None, 0.0)], "prompt_id string, text string, label double")
    with pytest.raises(Exception, match="absent"):
        S.screen_prompts(df, pack, model=unfit, logged_at="2024-01-01 00:00:00").collect()
    with pytest.raises(Exception, match="absent"):
        model.model_quality(unfit, df).collect()
    with pytest.warns(RuntimeWarning, match="absent"):
        got = {r.prompt_id: r for r in model.predicted(df, unfit, "text").collect()}
    assert "absent" in got["0"].ai_failure and (got["0"].ai_prediction, got["0"].ai_confidence) == (0, 0.0)
    assert (got["1"].ai_failure, got["1"].ai_prediction, got["1"].ai_confidence) == (None, None, None)


def test_texts_are_screened_once_for_the_log_and_the_trained_model(spark, folder, monkeypatch):
    rng = random.Random(5)
    words = "steal leak dump exploit secret weather garden music travel recipe ignore previous instructions".split()
    docs = [(k, None if k == 9 else " ".join(rng.choice(words) for _ in range(15)), k % 2 == 0) for k in [*range(80), 3, 4]]
    spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), int(k % 4 == 0)) for k, _, some in docs if some], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    load, fitted = model.load_model, []
    monkeypatch.setattr(model, "load_model", lambda path: fitted.append(load(path)) or fitted[-1])
    got = catalog.SPARK["model_trained_screening"](spark, folder)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()  # the rules have been matched
    want = catalog.screened(spark, folder, model=fitted[0], enrich=False).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 82
    plan = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").selectExpr("text", "cast(doc_id % 4 = 0 as double) label")
    own = model.fit_text_model(plan, features=1 << 10)
    parts = Pipeline(stages=[s for s in own.stages[:5]] + [IDF(minDocFreq=2, inputCol="_m_all", outputCol="_m_features")])
    told = own.transform(plan.withColumnRenamed("text", "_model_text"))
    again = parts.fit(plan.withColumnRenamed("text", "_model_text")).stages[5].idf.toArray()
    assert (own.stages[5].idf.toArray() == again).all() and told.where("_m_prediction = label").count() > 40
