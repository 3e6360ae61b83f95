"""Model joins, storage times, rule packs as CSV, paging, lists and streams."""

import random

import pytest
from pyspark.sql import functions as F

from shieldline import session
from shieldline.operators import browse, review
from shieldline.operators.quality import mask_pii
from shieldline.sources.rules_source import default_rule_rows, read_rules
from shieldline.sources.threat_log import append_threat_log, read_threat_log
from shieldline.streaming import jobs


def test_missing_repeated_and_failed_predictions(spark, pack):
    from shieldline.operators.screen import screen_prompts, to_log
    text = "a secret key via hidden system developer"   # score 125 without rules is FLAG or BLOCKED: gated
    flag = "hidden admin delete grandma"                 # score 100: FLAG, no rule
    df = spark.createDataFrame([("miss", flag), ("twice", flag), ("failed", flag), ("sure", flag), ("gated", text)], "prompt_id string, text string")
    preds = spark.createDataFrame([("twice", 0, 0.9), ("twice", 1, 0.6), ("failed", None, None), ("sure", 1, 0.9)],
                                  "prompt_id string, ai_prediction int, ai_confidence double")
    out = screen_prompts(df, pack, model=preds, logged_at="2024-01-01 00:00:00")
    rows = {r.prompt_id: r for r in out.collect()}
    assert len(rows) == 5 and out.count() == 5
    assert rows["miss"].decision == "FLAG" and rows["miss"].ai_activated and rows["miss"].ai_prediction is None
    assert rows["miss"].ai_reason == "no prediction" and rows["miss"].decision_source == "Pipeline"
    assert rows["twice"].ai_prediction == 1 and rows["twice"].decision == "FLAG"
    assert (rows["failed"].ai_prediction, rows["failed"].ai_confidence, rows["failed"].decision) == (0, 0.0, "SAFE")
    assert rows["sure"].decision == "BLOCKED" and rows["sure"].pipeline_steps.phase_3_ai.label == "MALICIOUS"
    path = session.scratch_path(spark, "steps-log")
    append_threat_log(to_log(out), path)
    back = {r.raw: r for r in read_threat_log(spark, path).collect()}
    assert back[flag].base_score == 100 and len(back) == 2


def test_times_without_offset_are_utc(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id":"a","timestamp":"2024-01-01T10:00:00"}\n{"id":"b","timestamp":"2024-01-01T10:00:00+02:00"}\n'
                                        '{"id":"c","timestamp":"2024-01-01T10:00:00Z"}\n{"id":"d","timestamp":"soon"}\n')
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Africa/Cairo")
    try:
        got = {r.id: r.s for r in read_threat_log(spark, str(tmp_path)).select("id", F.unix_seconds("timestamp").alias("s")).collect()}
        kept = browse.log_date_range(read_threat_log(spark, str(tmp_path)), "2024-01-01 10:00:00").count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    ten = 1704103200
    assert got == {"a": ten, "b": ten - 7200, "c": ten, "d": None} and kept == 2


def test_rules_from_csv(spark, tmp_path):
    rows = default_rule_rows()
    flat = [(*r[:5], "|".join(r[5]), *r[6:]) for r in rows]
    spark.createDataFrame(flat, "rule_id string, layer string, grp string, category string, ord int, anchors string, pattern string, enabled boolean") \
         .write.option("header", True).option("escape", '"').csv(f"{tmp_path}/pack")
    got = {r.rule_id: r for r in read_rules(spark, f"{tmp_path}/pack", "csv").collect()}
    assert {k: (v.pattern, list(v.anchors)) for k, v in got.items()} == {r[0]: (r[6], r[5]) for r in rows}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "yarn", "app-1"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Session)


def test_pages_by_number_and_behind_an_entry(spark):
    rng = random.Random(1)
    rows = [(f"i{k:05}", None if k % 97 == 0 else 1_700_000_000 + rng.randrange(500)) for k in range(3000)]
    log = spark.createDataFrame(rows, "id string, s bigint").select("id", F.timestamp_seconds("s").alias("timestamp"))
    order = [i for i, s in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for page in (1, 5, 20, 30, 31):
        got = browse.page_of(log, page, 100).orderBy("rank").collect()
        assert [r.id for r in got] == order[(page - 1) * 100 : page * 100] and [r["rank"] for r in got] == list(range((page - 1) * 100 + 1, (page - 1) * 100 + len(got) + 1))
    last = log.where(F.col("id") == order[249]).first()
    behind = browse.page_after(log, last.timestamp, last.id, 50)
    assert [r.id for r in behind.orderBy(*browse.newest_first()).collect()] == order[250:300]


def test_lists_override_a_hot_text(spark):
    prompts = spark.range(200).select(F.concat(F.lit("p"), "id").alias("prompt_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("normalized_text"),
                                      F.lit("FLAG").alias("decision"))
    lists = spark.createDataFrame([("allow", "hot"), ("block", "hot"), ("allow", "t1")], "list string, t string").select("list", F.sha2("t", 256).alias("text_hash"))
    got = {r.prompt_id: r.list_decision for r in review.apply_lists(prompts, lists).collect()}
    assert len(got) == 200 and got["p0"] == "BLOCKED" and got["p1"] == "SAFE" and got["p2"] == "FLAG"


def test_numbers_within_numbers_are_no_ids(spark):
    texts = ["4222233334444555", "id 22222333344445.", "901012345678", "call 01012345678", "my password is hunter2 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(mask_pii(F.col("t"))[0].alias("m")).collect()]
    assert got == [texts[0], "id [REDACTED:NATIONAL_ID].", texts[2], "call [REDACTED:PHONE]", "my password is [REDACTED:PASSWORD] ok"]
    assert df.select(mask_pii(F.col("t"), national_id=False)[0].alias("m")).collect()[1].m == texts[1]


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = ev.count()
    (tmp_path / "in").mkdir()
    for k in range(3):
        ev.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    files = [next((tmp_path / f"part{k}").glob("*.parquet")) for k in range(3)]
    import shutil
    for k in (0, 1):
        shutil.copy(files[k], tmp_path / "in" / f"{k}.parquet")

    def run():
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = jobs.stream_dedupe(stream, ["event_id"], watermark="60 days").select("event_id")
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).format("parquet").outputMode("append").start(str(tmp_path / "out"))
        q.awaitTermination()
        return q

    first = run()
    assert len([p for p in first.recentProgress if p["numInputRows"]]) == 2  # two files, two batches
    shutil.copy(files[2], tmp_path / "in" / "2.parquet")
    shutil.copy(files[0], tmp_path / "in" / "again.parquet")  # a replay
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == rows
