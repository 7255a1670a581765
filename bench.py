"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores (default 8). Each query writes
its whole result to the noop sink; the time includes building the plan. The first run warms up the
JVM, the second counts. What a query takes from a translator is staged before, and the translator is timed
by itself.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stringloom.operators import translate  # noqa: E402
from stringloom.plans.queries import QUERIES  # noqa: E402
from stringloom.plans.staging import stage  # noqa: E402
from stringloom.session import build_session  # noqa: E402

HEADLINE = [
    "unique_strings", "extract_clean", "occurrences", "smart_merge", "last_value_per_key", "missing_by_key",
    "generation_stats", "duplicate_rows", "match_keys", "apply_by_line", "apply_by_content", "render_bundle", "render_catalog_csv",
    "translate_tm", "translate_fn", "quota_running", "unpivot_sheet", "load_bundles", "make_key", "read_catalog", "write_back",
    "missing_report", "admit_texts", "sheet_records_scan", "catalog_version", "rescan_changed", "stream_extract",
]
# Queries whose input comes from another one, which is not part of their time.
STAGED = {"quota_running": ("translate_fn", lambda rows: translate.quota_running(rows, 500, block=64))}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run = QUERIES[name]
        if name in STAGED:
            source, work = STAGED[name]
            rows = stage(QUERIES[source](spark, folder), "bench")
            run = lambda spark, folder, rows=rows, work=work: work(rows)
        for _ in range(2):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
