"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logweir.catalog import load
from logweir.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "n3_normalize",
    "n5_render_record",
    "s8_split_text_units",
    "c3_build_chunks",
    "c1_segment_rows",
    "m3_dry_summary",
    "m6_group_by_token_budget",
    "m14_finalize",
    "e1_job_current",
    "e2_node_current",
    "e11_job_lifecycle",
    "e14_stage_progress",
    "e17_dispatch_backlog",
    "e19_llm_telemetry",
    "e22_node_links",
    "e23_job_snapshot",
    "p1_latest_runs",
    "p7_tick_report",
    "p8_next_fire",
    "p11_run_history",
]


def timed(query, spark) -> float:
    started = time.perf_counter()
    query.run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


HOT_ROWS = 3_000_000


def hot_key_seconds(spark) -> float:
    """Packing rows of which a third has one key."""
    from pyspark.sql import functions as F

    from logweir.operators.packing import pack_rows

    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    rows = spark.range(HOT_ROWS).select(key.alias("k"), F.col("id").alias("pos"), (F.pmod(F.hash("id"), F.lit(50)) + 1).alias("tokens"))
    started = time.perf_counter()
    packed = pack_rows(rows, "k", ["pos"], F.col("tokens"), 6000, partitions=32)
    packed.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session("logweir-bench", cores=CPUS, **{"spark.sql.shuffle.partitions": CPUS})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    # One small run starts the JVM's code paths and the Python workers.
    timed(registry["m6_group_by_token_budget"], spark)
    timings = {name: timed(registry[name], spark) for name in HEADLINES}
    hot = hot_key_seconds(spark)
    rows = {name: spark.read.parquet(f"{FOLDER}/{name}.parquet").count() for name in ("events", "documents", "orders")}
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(FOLDER).name.removeprefix("sf"),
        "input_rows": rows,
        "rows_per_sec": {
            "normalised and rendered": round(rows["events"] / timings["n5_render_record"]),
            "packed into segments": round(rows["events"] / timings["c1_segment_rows"]),
            "documents chunked": round(rows["documents"] / timings["c3_build_chunks"]),
            "packed, one key with a third of all rows": round(HOT_ROWS / hot),
        },
    }
    print(json.dumps(report), flush=True)


if __name__ == "__main__":
    main()
