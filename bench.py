"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then three times; its figure is the median. Results are written to Spark's noop
sink, so every row is made. `value` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import functions as F  # noqa: E402

from rivulet import queries as core  # noqa: E402
from rivulet.plans.engine import Engine  # noqa: E402
from rivulet.session import checkpoint_dir, session  # noqa: E402

QUERIES = [
    "scan_full", "scan_limit", "scan_offsets", "filter_json_limit", "json_group_revenue", "agg_all", "agg_distinct", "topn_value", "reverse_tail", "tumbling_by_key", "emit_changes_changelog",
    "within_join", "inner_join", "external_lookup_join", "latest_by_key", "publish_offsets", "publish_dedup", "emit_final_stream", "stream_stream_join", "materialized_view",
]


#: The scans of the published baseline, over a stored stream of 500,000 records of about 160 bytes.
STORED = {
    "stored_star_limit_5": "SELECT * FROM stored LIMIT 5", "stored_offset_limit_1000": "SELECT offset FROM stored LIMIT 1000",
    "stored_filter_limit_100": "SELECT payload->>'status' AS status FROM stored WHERE payload->>'type' = 'A' LIMIT 100",
    "stored_full_scan": "SELECT * FROM stored", "stored_json_group": "SELECT payload->>'status' AS status, COUNT(*) AS n FROM stored GROUP BY payload->>'status'",
}


def median_of(run, times: int = 3) -> float:
    runs = []
    for _ in range(times + 1):
        began = time.perf_counter()
        run()
        runs.append(time.perf_counter() - began)
    return round(statistics.median(runs[1:]), 4)


def stored(spark) -> tuple[dict[str, float], dict[str, float]]:
    """Seconds of the scans, and records a second of publishing 200,000 records of 1,024 bytes."""
    e = Engine(spark, f"{checkpoint_dir(spark)}/bench-{time.time_ns()}")
    i = F.col("id")
    fields = F.struct(i.alias("i"), F.when(i % 3 == 0, "active").otherwise("inactive").alias("status"), F.concat(F.lit("c"), i % 100).alias("customer_id"), F.when(i % 2 == 0, "A").otherwise("B").alias("type"), F.repeat(F.lit("x"), 90).alias("note"))
    rows = spark.range(500_000).select(F.timestamp_seconds(i + 1_700_000_000).alias("timestamp"), F.lit("bench.s").alias("subject"), F.concat(F.lit("k"), i).alias("key"), F.to_json(fields).alias("payload"))
    e.publish("stored", rows)
    took = {}
    for name, sql in STORED.items():
        took[name] = median_of((lambda sql=sql: e.sql(sql).collect()) if "LIMIT" in sql else (lambda sql=sql: e.sql(sql).write.format("noop").mode("overwrite").save()))
    body = spark.range(200_000).select(F.timestamp_seconds(i).alias("timestamp"), F.lit("p").alias("subject"), F.concat(F.lit("k"), i).alias("key"), F.concat(F.lit('{"b":"'), F.repeat(F.sha2(i.cast("string"), 256), 16), F.lit('"}')).alias("payload"))
    return took, {"publish_1kb_records_per_sec": round(200_000 / median_of(lambda: e.publish("p", body)))}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false", "spark__driver__memory": "16g", "spark__ui__showConsoleProgress": "false"}
    spark = session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}
    for name in QUERIES:
        took[name] = median_of(lambda name=name: core.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    scans, rates = stored(spark)
    took |= scans
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None,
        "cpus": int(cpus), "events": rows, "scan_rows_per_sec": round(rows / took["scan_full"]),
        "stored_scan_rows_per_sec": round(500_000 / took["stored_full_scan"]), **rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
