"""Time the headline queries; prints one JSON line.

Every query runs to the end of its plan (``noop`` sink). The first run of each warms up, the best
of the following runs counts; a warm-up above ``ONCE_ABOVE_S`` counts itself. The ingest rates are
timed first, and after each query the figures so far go to stderr. ``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_RUNS`` and ``BENCH_QUERIES``
(comma-separated) change what runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterloom.plans.queries import QUERIES, ingest_cases  # noqa: E402
from meterloom.scratch import scratch_folder  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = (
    "series_flagship,csv_ingest_typed,csv_ingest_rejects,graphite_ingest,graphite_samples,samples_unit_extra_labels,"
    "metric_types,annotate_asof,annotate_asof_merge,annotate_delete_over_set,annotate_many_names,series_assembled,series_hot_parts,"
    "latency_summary_10s,latency_summary_day,conform_schema,json_records_roundtrip,parquet_roundtrip,"
    "remote_write_payload"
)


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("meterloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ingest_rates(spark: SparkSession) -> dict[str, int]:
    """Lines a second and core of the two ingests, over many text files that are written beforehand."""
    rates = {}
    for name, (lines, read) in ingest_cases(spark, SF_DIR).items():
        folder = scratch_folder(spark, "bench")
        lines.select("value").repartition(8 * int(CPUS)).write.text(folder)
        n, best = lines.count(), float("inf")
        for _ in range(3):
            start = time.perf_counter()
            read(spark.read.text(folder)).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        rates[name] = round(n / best / int(CPUS))
        print(f"{name} {rates[name]} lines/s/core", file=sys.stderr, flush=True)
    return rates


#: A query whose warm-up run takes longer than this is not run again; the warm-up counts.
ONCE_ABOVE_S = 30.0


def result(seconds: dict[str, float], rates: dict[str, int]) -> str:
    return json.dumps(
        {
            "metric": "total_query_time",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            "cpus": int(CPUS),
            "lines_per_sec_core": rates,
        }
    )


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    # Rows per file split are few at this scale; smaller splits keep all cores busy.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    names = [n for n in os.environ.get("BENCH_QUERIES", HEADLINE).split(",") if n]
    spark.range(1000).selectExpr("sum(id)").collect()
    rates = ingest_rates(spark) if "BENCH_QUERIES" not in os.environ or "ingest" in names else {}
    seconds: dict[str, float] = {}
    for name in names:
        if name == "ingest":
            continue
        best = float("inf")
        for run in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run or RUNS == 0 or took > ONCE_ABOVE_S:
                best = min(best, took)
            if took > ONCE_ABOVE_S:
                break
        seconds[name] = round(best, 3)
        # what is done so far, should the run be cut off
        print(f"{name} {best:.2f} so far: {result(seconds, rates)}", file=sys.stderr, flush=True)
    print(result(seconds, rates))
    spark.stop()


if __name__ == "__main__":
    main()
