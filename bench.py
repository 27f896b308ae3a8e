"""Headline timings. Prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local cores.
"""

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtarn.catalog.derive import http_requests, log_input, syslog_lines
from logtarn.catalog.lake_queries import lake_logs, two_tier_lake
from logtarn.operators.cloudevents import normalize_events
from logtarn.operators.compact import compact_raw
from logtarn.operators.logs import normalize_logs
from logtarn.operators.relay import allow_listed
from logtarn.plans.query import between_dates, json_rows
from logtarn.plans.reports import run_report
from logtarn.session import configure, work_area
from logtarn.sources.lake import Lake, read_compacted, read_raw, sources
from logtarn.sources.landing import syslog_records
from logtarn.sources.sinks import write_raw

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action, runs: int) -> float:
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    spark = session()
    records, requests = work_area(spark, "records"), work_area(spark, "requests")
    lines = work_area(spark, "lines")
    log_input(spark, SF_DIR).repartition(int(CPUS)).write.parquet(records)
    http_requests(spark, SF_DIR).repartition(int(CPUS)).write.parquet(requests)
    syslog_lines(spark, SF_DIR).select("value").repartition(int(CPUS)).write.text(lines)
    rows = spark.read.parquet(records).count()

    # The round trip through both tiers, step by step: raw objects of an hour each, compaction.
    # The better of two, each through a lake of its own; the first warms up.
    trips = [Lake(work_area(spark, "bench")) for _ in range(2)]
    steps = {
        "roundtrip_write_raw": lambda trip: write_raw(lake_logs(spark, SF_DIR), trip.raw("logs"), "all"),
        "roundtrip_compact": lambda trip: compact_raw(spark, trip, "logs"),
        "roundtrip_read": lambda trip: run(read_compacted(spark, trip, "logs")),
    }
    times: dict[str, float] = {
        name: min(timed(lambda step=step, trip=trip: step(trip), 1) for trip in trips)
        for name, step in steps.items()
    }
    times["compacted_roundtrip"] = round(sum(times.values()), 3)
    lake = two_tier_lake(spark, SF_DIR)
    logs, events = sources(spark, lake, "logs"), sources(spark, lake, "events")
    compacted, raw = read_compacted(spark, lake, "logs"), read_raw(spark, lake, "logs")
    queries = {
        "normalize_logs": lambda: normalize_logs(allow_listed(spark.read.parquet(records))),
        "normalize_events": lambda: normalize_events(spark.read.parquet(requests)),
        "syslog_to_logs": lambda: normalize_logs(
            allow_listed(syslog_records(spark.read.text(lines)))
        ),
        "service_errors_compacted": lambda: run_report("find-all-service-errors", compacted),
        "service_errors_raw": lambda: run_report("find-all-service-errors", raw),
        "errors_by_service": lambda: run_report("errors-by-service", logs),
        "trace_walk": lambda: run_report("trace-walk", logs, events=events),
        "xname_groups": lambda: run_report("xname-groups", logs),
        "date_filter_pruned": lambda: between_dates(compacted, "2024-01-04", "2024-01-05"),
        "date_filter_unpruned": lambda: compacted.where(
            F.substring("ts", 1, 10).between("2024-01-04", "2024-01-05")
        ),
        "dump_all": lambda: logs,
        "row_json": lambda: json_rows(logs, None),
        "row_json_nested": lambda: json_rows(logs, "logs"),
    }
    for name, frame in queries.items():
        times[name] = timed(lambda frame=frame: run(frame()), RUNS)

    print(json.dumps({
        "metric": "log lake headline queries, total",
        "value": round(sum(t for n, t in times.items() if not n.startswith("roundtrip_")), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "rows": rows,
        "cpus": int(CPUS),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
