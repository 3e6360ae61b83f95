"""Benchmark the headline jobs.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query is forced to full evaluation through the ``noop`` sink (all
columns computed, nothing collected to the driver).  A warm-up pass on the
smallest scale compiles the generated code first so the timings measure
execution, not JVM start-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from shieldline.session import local_session
    from shieldline.plans import catalog as C
    from shieldline.operators import analytics as A
    from shieldline.operators import review as R
    from shieldline.sources.threat_log import materialize

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="shieldline-bench")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # warm-up (code generation, Python workers)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        run(C.screened(spark, warm, "conversations"))

    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        timings[name] = round(time.time() - t0, 3)

    n_docs = C.read_table(spark, sf_dir, "documents").count()
    n_conv = C.read_prompts(spark, sf_dir, "conversations").count()

    timed("screen_documents", lambda: run(C.screened(spark, sf_dir, "documents")))
    timed("screen_conversations", lambda: run(C.screened(spark, sf_dir, "conversations")))
    timed("screen_documents_model", lambda: run(C.screened_model(spark, sf_dir)))
    timed("normalize_documents", lambda: run(C.q_normalize(spark, sf_dir)))
    timed("rule_group_stats", lambda: run(C.q_rule_group_stats(spark, sf_dir)))
    timed("keyword_frequency", lambda: run(C.q_keyword_frequency(spark, sf_dir)))

    holder = {}
    timed("materialize_docs_log", lambda: holder.setdefault("log", C.docs_log(spark, sf_dir)))
    log = holder["log"].unionByName(C.events_log(spark, sf_dir), allowMissingColumns=True)
    timed("dashboard_summary", lambda: run(A.dashboard_summary(log)))
    timed("timeline", lambda: run(A.timeline(spark, log, "2024-01-31 00:00:00", 720)))
    timed("language_distribution", lambda: run(A.language_distribution(log)))
    timed("review_apply", lambda: run(R.review_apply(holder["log"], C.reviews(spark, sf_dir))))
    timed("log_page", lambda: run(C.q_log_page(spark, sf_dir)))
    timed("detection_quality", lambda: run(C.q_quality(spark, sf_dir)))
    timed("stream_screen", lambda: run(C.q_stream_screen(spark, sf_dir)))

    total = round(sum(timings.values()), 3)
    out = {
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "cpus": int(cpus),
        "texts_screened_per_sec": round((n_docs) / timings["screen_documents"], 1),
        "conversation_prompts_per_sec": round(n_conv / timings["screen_conversations"], 1),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
