"""Threat-log reader fixtures, analytics semantics, browsing and review."""

import json

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def log_path(tmp_path_factory):
    rows = [
        {"id": "g0", "timestamp": "2024-01-30T10:00:00+00:00", "raw": "x", "status": "BLOCKED", "score": 150,
         "vector": "Ignore Instructions", "pipeline_steps": {"intent_score": 120, "keyword_score": 25}},
        {"id": "g2", "timestamp": "2024-01-30T11:00:00", "raw": "y", "status": "flagged", "score": 90,
         "vector": "Prompt Leak", "lang_dist": {"english": 55.0},
         "pipeline_steps": {"ai_raw_score": 210, "dialect": "egyptian", "intent_goal": "leak"}},
        {"id": "g3", "timestamp": "2024-01-30T12:00:00+00:00", "raw": "z", "score": 10,
         "pipeline_steps": {"phase_1_normalization": {"base_score": 10}, "final_score": 10}},
        {"id": "bad-ts", "timestamp": "yesterday", "raw": "w", "status": "SAFE", "score": 0},
        {"id": "g0", "timestamp": "2024-01-30T10:00:00+00:00", "raw": "x", "status": "BLOCKED", "score": 150,
         "vector": "Ignore Instructions"},
    ]
    p = tmp_path_factory.mktemp("log") / "threat_log.jsonl"
    lines = [json.dumps(rows[0], ensure_ascii=False), "", "{broken json", *map(json.dumps, rows[1:])]
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def test_reader_accepts_all_generations(spark, log_path):
    from shieldline.sources.threat_log import read_threat_log
    df = read_threat_log(spark, log_path)
    rows = {r.id: r for r in df.collect()}
    assert df.count() == 5                            # blank and broken lines dropped, duplicate kept
    assert rows["g2"].ai_raw_score == 210 and rows["g2"].dialect == "egyptian"
    assert rows["g3"].base_score == 10 and rows["g3"].status is None
    assert rows["bad-ts"].timestamp is None and rows["g2"].timestamp is not None
    q = read_threat_log(spark, log_path, quarantine=True)
    bad = [r for r in q.select("id", "_corrupt_record").collect() if r._corrupt_record is not None]
    assert len(bad) == 1


def test_status_counts_and_rate(spark, log_path):
    from shieldline.operators import analytics as A
    from shieldline.sources.threat_log import read_threat_log
    log = read_threat_log(spark, log_path)
    c = A.status_counts(log).collect()[0]
    assert (c.total, c.blocked, c.flagged, c.safe) == (5, 2, 1, 1)   # missing status counts nowhere
    assert A.threat_rate(log).collect()[0].threat_rate == 60.0
    assert A.top_vector(log).collect()[0].top_vector == "Ignore Instructions"
    d = A.dashboard_summary(log).collect()[0]
    assert (d.total_requests, d.total_blocked, d.threat_rate, d.top_vector) == (5, 2, 60.0, "Ignore Instructions")
    dist = {r.subject: r.value for r in A.language_distribution(log).collect()}
    assert dist["English"] == 11.0 and dist["MSA"] == 0.0


def test_timeline_spine(spark, log_path):
    from shieldline.operators import analytics as A
    from shieldline.sources.threat_log import read_threat_log
    tl = A.timeline(spark, read_threat_log(spark, log_path), "2024-01-30T12:30:00", 5).orderBy("slot").collect()
    assert len(tl) == 10 and tl[0].time == "07:30"
    assert sum(r.blocked for r in tl) == 2 and sum(r.flagged for r in tl) == 1 and sum(r.safe for r in tl) == 1


def test_empty_log(spark):
    from shieldline.operators import analytics as A
    empty = spark.createDataFrame([], "id string, timestamp timestamp, status string, vector string, "
                                      "lang_dist struct<msa:double,egyptian:double,franco:double,"
                                      "english:double,unicode:double,encoded:double>")
    assert A.threat_rate(empty).collect()[0].threat_rate == 0.0
    assert A.top_vector(empty).collect()[0].top_vector == "None"
    assert [r.value for r in A.language_distribution(empty).collect()] == [0.0] * 6


def test_paging_and_filters(spark):
    from shieldline.operators import browse as B
    rows = [(f"id{i:03d}", f"2024-01-01 00:{i % 60:02d}:00", "FLAGGED" if i % 3 else "SAFE") for i in range(120)]
    log = spark.createDataFrame(rows, "id string, ts string, status string").select(
        "id", F.col("ts").cast("timestamp").alias("timestamp"), "status")
    page = B.log_page(log, page=2, page_size=25, status="flagged").orderBy("rank").collect()
    assert [r.rank for r in page] == list(range(26, 51))
    meta = B.log_page_meta(log, page_size=25, status="flagged").collect()[0]
    assert meta.total == 80 and meta.pages == 4
    assert B.log_filter(log, "unknown").count() == 0
    assert B.queue_page(log, "unknown", 1, 10).collect()[0].filter_applied == "ALL"
    assert B.retain_latest(log, 7).count() == 7


def test_reviews(spark):
    from shieldline.operators import review as R
    log = spark.createDataFrame(
        [("a", "t1", "n1", 130, 1, 0.9, "Prompt Leak"), ("b", "t2", "n2", 90, 0, 0.2, "None")],
        "id string, raw string, normalized_text string, score int, ai_prediction int, ai_confidence double, "
        "vector string")
    rv = spark.createDataFrame([
        ("a", "approve", "first", "r1", "2024-01-01 00:00:00"),
        ("a", "train", "second", "r2", "2024-01-02 00:00:00"),
        ("b", "nonsense", "", "r1", "2024-01-01 00:00:00"),
        ("zz", "block", "", "r1", "2024-01-01 00:00:00"),
    ], "item_id string, action string, notes string, reviewer_id string, reviewed_at string").withColumn(
        "reviewed_at", F.col("reviewed_at").cast("timestamp"))
    applied = R.review_apply(log, rv).collect()
    assert [(r.item_id, r.action) for r in applied] == [("a", "train")]
    rej = {(r.item_id, r.reject_reason) for r in R.rejected_reviews(log, rv).collect()}
    assert rej == {("b", "invalid_action"), ("zz", "not_found")}
    assert [r.id for r in R.queue_open(log, rv).collect()] == ["b"]
    rec = R.build_retraining(log, rv, "2024-02-01T00:00:00+00:00").collect()[0]
    assert (rec.label, rec.ai_score, rec.notes, rec.dialect) == (1, 270, "second", "unknown")
