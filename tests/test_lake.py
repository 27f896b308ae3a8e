import gzip
import json
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logtarn import Lake, available_dates, dataset_schema, query, run_report
from logtarn.operators import compact, merge
from logtarn.operators.compact import compact_lines, compact_raw, read_quarantine, retry_quarantine
from logtarn.operators.merge import merge_small
from logtarn.plans.query import between_dates, dump, json_rows
from logtarn.plans.reports import REPORTS, report_schema
from logtarn.schemas import EVENT_FIELDS, LOG_FIELDS
from logtarn.sources import sinks
from logtarn.sources.lake import (
    CATALOGUED,
    catalogue_fields,
    catalogued_fields,
    read_compacted,
    read_raw,
    read_raw_lines,
    read_status,
    sources,
)
from logtarn.sources.marks import drop_mark, marks, put_mark, read_mark
from logtarn.sources.ndjson_zstd import ObjectWriter
from logtarn.sources.objects import open_store, store_settings
from logtarn.sources.sinks import write_raw, write_result
from logtarn.streaming.compaction import compact_stream, run_compaction
from logtarn.streaming.ingest import ingest_stream

GOOD = '{"ts":"2024-01-01T03:00:00Z","service":"smd","level":"err","data":"{\\"a\\":1}","x":5}'


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


def put(lake, name, text, stream="logs", day="2024-01-01", hour="03", opener=None):
    folder = Path(lake.raw(stream)) / f"date={day}" / f"hour={hour}"
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    if name.endswith(".zst"):
        with pa.CompressedOutputStream(str(path), "zstd") as out:
            out.write(text.encode())
    elif name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return path


def names(frame):
    return sorted(Path(row.source_file).name for row in frame.select("source_file").distinct().collect())


def test_raw_objects_of_any_codec(spark, lake):
    put(lake, "a.ndjson.zst", GOOD + "\n")
    put(lake, "b.ndjson.gz", GOOD + "\n" + GOOD)
    put(lake, "c.ndjson", GOOD + "\n{broken\n")
    records = read_raw(spark, lake, "logs", extra_fields=("x",))
    assert records.count() == 5
    assert records.select("x").distinct().collect()[0].x in ("5", None)
    row = records.where("parse_error IS NOT NULL").first()
    assert row.payload_json == "{broken"
    assert {r.hour for r in records.collect()} == {"03"}


@pytest.mark.parametrize("line", [
    '{"node_id":7}', "{oops", "", "   ", "[1]", "5", "null", '{"data":{"a":1}}', '{"ts":"1"} junk',
    '{"ts":"1"},{"ts":"2"}', '{"ts":true}', '{"msg":["x"]}', "{'ts':'x'}", '{"n":NaN}', "[]",
])
def test_a_bad_line_rejects_its_object(spark, lake, line):
    put(lake, "good", GOOD)
    put(lake, "bad", GOOD + "\n" + line + "\n")
    compact_raw(spark, lake, "logs")
    assert names(read_compacted(spark, lake, "logs", ("source_file",))) == ["good"]
    rejected = read_quarantine(spark, lake, "logs").collect()
    assert sorted(r.line for r in rejected) == sorted([GOOD, line])
    assert [r.reason is None for r in sorted(rejected, key=lambda r: r.line != GOOD)] == [True, False]


@pytest.mark.parametrize("line", [
    '{"ts":"9"}', "{}", ' {"ts":"9"} ', '{"ts":null,"extra":{"ts":1}}', '{"ts":"1","ts":"2"}',
    '{"extra":[{"a":1}],"ts":"\\u0041"}',
])
def test_lines_that_are_stored(spark, lake, line):
    frame = spark.createDataFrame([(line, "f/date=2024-05-06/x")], "value string, source_file string")
    compact_lines(frame, lake, "logs", "b")
    row = read_compacted(spark, lake, "logs").first()
    assert row.payload_json == line and str(row.date) == "2024-05-06"
    assert row.ts in ("9", None, "2", "A")


def test_sources_starts_no_job(spark, lake):
    put(lake, "a.ndjson", GOOD)
    compact_raw(spark, lake, "logs")
    put(lake, "b.ndjson", GOOD)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    frame = sources(spark, lake, "logs", "all")
    run_report("find-all-service-errors", frame, since="2024-01-01T00:00:00Z")
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert frame.count() == 2 and len(tracker.getJobIdsForGroup(None)) > before


def test_compacted_files_are_few_and_sorted_by_time(spark, lake):
    import pyarrow.parquet as pq

    for n in range(12):
        put(lake, f"{n}.ndjson", "\n".join(
            json.dumps({"ts": f"2024-01-0{1 + m % 2}T00:{(n * 7 + m * 13) % 60:02d}:00Z"}) for m in range(40)
        ))
    compact_raw(spark, lake, "logs")
    files = list(Path(lake.compacted("logs")).rglob("*.parquet"))
    assert len(files) == 2
    for path in files:
        times = pq.read_table(path, columns=["ts"])["ts"].to_pylist()
        assert times == sorted(times) and len(times) == 240


def test_last_line_without_line_end_is_kept(spark, lake):
    put(lake, "a.ndjson", '{"ts":"1"}\n{"ts":"9"}')
    compact_raw(spark, lake, "logs")
    assert {r.ts for r in read_compacted(spark, lake, "logs").collect()} == {"1", "9"}


def test_compaction_takes_new_objects_once(spark, lake):
    put(lake, "a.ndjson", GOOD)
    put(lake, "bad.ndjson", "{")
    compact_raw(spark, lake, "logs", "one")
    with pytest.raises(ValueError, match="complete"):
        compact_raw(spark, lake, "logs", "one")
    compact_raw(spark, lake, "logs", "two")
    put(lake, "c.ndjson", GOOD)
    assert sources(spark, lake, "logs", "all").count() == 1 + 1 + 1  # the bad line is still raw
    compact_raw(spark, lake, "logs", "three")
    assert read_compacted(spark, lake, "logs").count() == 2
    assert sources(spark, lake, "logs", "recent").count() == 1
    # The rejected object was looked at by each run.
    seen = [Path(r.source_file).name for r in read_status(spark, lake, "logs").collect()]
    assert sorted(seen) == ["a.ndjson", "bad.ndjson", "bad.ndjson", "bad.ndjson", "c.ndjson"]


def test_day_filters_skip_raw_objects(spark, lake):
    for day in range(1, 8):
        put(lake, "a.ndjson", GOOD, day=f"2024-01-0{day}")
    found = between_dates(read_raw(spark, lake, "logs"), "2024-01-02", "2024-01-03")
    assert found.count() == 2
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in plan or "file_path" in plan


def test_quarantine_retry(spark, lake):
    path = put(lake, "bad.ndjson", GOOD + '\n{"ts":5}')
    compact_raw(spark, lake, "logs", "one")
    retry_quarantine(spark, lake, "logs", "two")
    retry_quarantine(spark, lake, "logs")
    assert read_quarantine(spark, lake, "logs").count() == 2
    assert read_compacted(spark, lake, "logs").count() == 0
    path.write_text(GOOD + '\n{"ts":"5"}')
    retry_quarantine(spark, lake, "logs", "three")
    retry_quarantine(spark, lake, "logs", "four")
    assert read_quarantine(spark, lake, "logs").count() == 0
    assert read_compacted(spark, lake, "logs").count() == sources(spark, lake, "logs").count() == 2


def test_salvaged_lines_are_retried_once(spark, lake, monkeypatch):
    put(lake, "bad.ndjson", GOOD + '\n{"ts":5}\n{')
    compact_raw(spark, lake, "logs", "one", salvage=True)
    retry_quarantine(spark, lake, "logs")
    assert read_quarantine(spark, lake, "logs").count() == 2
    monkeypatch.setattr(compact, "is_text_or_null", lambda value: F.lit(True))
    retry_quarantine(spark, lake, "logs")
    retry_quarantine(spark, lake, "logs")
    assert [r.line for r in read_quarantine(spark, lake, "logs").collect()] == ["{"]
    assert read_compacted(spark, lake, "logs").count() == 2


class Died(BaseException):
    pass


def dies_at(monkeypatch, step, modules):
    """Let the step with this number fail, of all that writes, marks or deletes; whether it came."""
    reached, real = [0], {}

    def counted(function):
        def run(*args, **options):
            reached[0] += 1
            if reached[0] == step:
                raise Died
            return function(*args, **options)

        return run

    for module, names in modules.items():
        for name in names:
            real[module, name] = getattr(module, name)
            monkeypatch.setattr(module, name, counted(real[module, name]))
    return reached


@pytest.fixture
def one_part(spark):
    """Many small runs; a shuffle in one part each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


STEPS = {compact: ("put_mark", "drop_mark", "drop", "write_compacted", "_replace_batch", "object_status")}


def seen(spark, lake):
    """Every line of the stream and how often it is there, in tiers and quarantine together."""
    lines = sources(spark, lake, "logs").select("payload_json").union(
        read_quarantine(spark, lake, "logs").join(
            read_raw(spark, lake, "logs").select(F.col("payload_json").alias("line")), "line", "left_anti"
        ).select("line")
    )
    return sorted(r.payload_json for r in lines.collect())


@pytest.mark.parametrize("salvage", [False, True])
def test_a_run_that_dies_at_any_step_loses_and_doubles_nothing(spark, tmp_path, one_part, salvage):
    lines = [GOOD, GOOD.replace("smd", "bss"), '{"ts":5}', '{"ts":"7"}']
    # Every other step for each kind of run.
    step, finished = int(salvage), False
    while not finished:
        step += 2
        lake = Lake(str(tmp_path / f"lake-{step}"))
        put(lake, "a.ndjson", "\n".join(lines[:1]))
        put(lake, "b.ndjson", "\n".join(lines[1:3]))
        with pytest.MonkeyPatch.context() as patch:
            reached = dies_at(patch, step, STEPS)
            try:
                compact_raw(spark, lake, "logs", salvage=salvage)
            except Died:
                pass
            finished = reached[0] < step
        assert seen(spark, lake) == sorted(lines[:3])
        put(lake, "c.ndjson", lines[3])
        # The next run may be of the other kind.
        compact_raw(spark, lake, "logs", salvage=not salvage)
        assert seen(spark, lake) == sorted(lines)
    assert step > 6


def test_a_retry_that_dies_at_any_step_loses_and_doubles_nothing(spark, tmp_path, one_part):
    lines = [GOOD, '{"ts":5}', "{"]
    step, finished = 0, False
    while not finished:
        step += 2
        lake = Lake(str(tmp_path / f"lake-{step}"))
        put(lake, "a.ndjson", "\n".join(lines))
        compact_raw(spark, lake, "logs", "one", salvage=True)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(compact, "is_text_or_null", lambda value: F.lit(True))
            reached = dies_at(patch, step, STEPS)
            try:
                retry_quarantine(spark, lake, "logs")
            except Died:
                pass
            finished = reached[0] < step
        put(lake, "late.ndjson", '{"ts":"8"}\n{"ts":8}')
        with pytest.MonkeyPatch.context() as patch:
            compact_raw(spark, lake, "logs", "two", salvage=True)
            patch.setattr(compact, "is_text_or_null", lambda value: F.lit(True))
            retry_quarantine(spark, lake, "logs")
            retry_quarantine(spark, lake, "logs")
        assert seen(spark, lake) == sorted([*lines, '{"ts":"8"}', '{"ts":8}'])
        assert [r.line for r in read_quarantine(spark, lake, "logs").collect()] == ["{"]
    assert step > 6


def test_an_ingested_batch_that_dies_at_any_step_is_stored_once(spark, tmp_path, one_part):
    records = spark.createDataFrame([("2024-01-01T05:00:00Z", "a")], "ts string, msg string")
    step, finished = 0, False
    while not finished:
        step += 1
        lake = Lake(str(tmp_path / f"lake-{step}"))
        write_raw(records, lake.raw("logs"), "b-1")
        with pytest.MonkeyPatch.context() as patch:
            reached = dies_at(patch, step, {sinks: ("put_mark", "drop_mark", "with_raw_partition")})
            try:
                write_raw(records, lake.raw("logs"), "b-2")
            except Died:
                pass
            finished = reached[0] < step
        # A batch that is not complete is neither read nor compacted.
        assert sources(spark, lake, "logs").count() in (1, 2)
        run_compaction(spark, lake)
        assert sources(spark, lake, "logs").count() in (1, 2)
        for _ in range(2):
            write_raw(records, lake.raw("logs"), "b-2")
            run_compaction(spark, lake)
        assert sources(spark, lake, "logs").count() == read_compacted(spark, lake, "logs").count() == 2
    assert step > 3


def test_marks_do_not_grow_with_the_batches(spark, lake):
    records = spark.createDataFrame([("2024-01-01T05:00:00Z", "a")], "ts string, msg string")
    raw = lake.raw("logs")
    for number in range(9, 13):
        write_raw(records, raw, f"query-{number}")
        write_raw(records, raw, f"query-{number}")
    write_raw(records, raw, "other-3")
    write_raw(records, raw, "plain")
    write_raw(records, raw, "query-9")  # long complete
    assert marks(spark, f"{raw}/_done") == ["other-3", "plain", "query-12"]
    assert marks(spark, f"{raw}/_open") == []
    assert read_raw(spark, lake, "logs").count() == 6
    for _ in range(3):
        run_compaction(spark, lake)
    assert marks(spark, lake.attempts("logs")) == marks(spark, lake.uncleared("logs")) == []


def test_marks(spark, tmp_path):
    folder = str(tmp_path / "a b" / "marks")
    assert marks(spark, folder) == []
    for name in ("x/y z", "100%", "ü"):
        put_mark(spark, folder, name, n=1)
        put_mark(spark, folder, name, n=2, of=["a"])
    assert marks(spark, folder) == sorted(["x/y z", "100%", "ü"])
    assert read_mark(spark, folder, "100%") == {"n": 2, "of": ["a"]}
    drop_mark(spark, folder, "x/y z")
    drop_mark(spark, folder, "x/y z")
    assert marks(spark, folder) == ["100%", "ü"]


def test_reads_of_a_settled_lake_join_nothing(spark, lake):
    put(lake, "a.ndjson", GOOD)
    for _ in range(2):
        run_compaction(spark, lake)
    put(lake, "b.ndjson", GOOD)
    found = sources(spark, lake, "logs")
    assert found.count() == 2
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_rejected_objects_are_never_cleared(spark, lake):
    put(lake, "good.ndjson", GOOD)
    bad = put(lake, "a b+c%20d.ndjson", GOOD + "\n{")
    for _ in range(3):
        run_compaction(spark, lake, clean="delete")
    assert bad.exists() and sources(spark, lake, "logs").count() == 3
    bad.write_text(GOOD)
    run_compaction(spark, lake, clean="delete")
    run_compaction(spark, lake, clean="delete")
    assert not bad.exists() and sources(spark, lake, "logs").count() == 2


def test_lines_end_at_newlines_only(spark, lake):
    put(lake, "a.ndjson", '{"ts":"1",\r"msg":"x"}\r\n{"ts":"2"}')
    compact_raw(spark, lake, "logs")
    assert {r.ts for r in read_compacted(spark, lake, "logs").collect()} == {"1", "2"}


def test_salvage(spark, lake):
    put(lake, "mixed.ndjson", GOOD + '\n{"ts":5}\n' + GOOD)
    compact_raw(spark, lake, "logs", salvage=True)
    assert read_compacted(spark, lake, "logs").count() == 2
    assert [r.reason for r in read_quarantine(spark, lake, "logs").collect()] == ["field ts is not text"]
    assert sources(spark, lake, "logs", "recent").count() == 0


def test_streaming_compaction_repeats_nothing_and_archives(spark, lake):
    put(lake, "a.ndjson", GOOD)
    put(lake, "e.ndjson", '{"ts":"2024-01-01T00:00:00Z","cloudevent":"{}"}', stream="events")
    run_compaction(spark, lake)
    run_compaction(spark, lake)
    assert read_compacted(spark, lake, "logs").count() == 1
    assert read_compacted(spark, lake, "events").columns == [*EVENT_FIELDS, "date", "event_ts"]
    put(lake, "b.ndjson", GOOD)
    run_compaction(spark, lake)
    put(lake, "c.ndjson", GOOD)
    run_compaction(spark, lake)
    assert read_compacted(spark, lake, "logs").count() == 3
    assert sources(spark, lake, "logs").count() == 3
    assert list(Path(lake.archive("logs")).rglob("a.ndjson"))
    with pytest.raises(ValueError):
        compact_stream(spark, lake, "logs", clean="shred")


def test_ingest_stream_equals_batch_and_resumes(spark, lake, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "one.log").write_text("<27>1 2024-01-01T05:00:00Z h smd - - - nid=1\n<27>1 - h sshd - - - x\n")
    ingest_stream(spark, lake, "logs", str(landing), available_now=True).awaitTermination()
    (landing / "two.log").write_text("<27>1 - h smd - - - nid=2\n")
    ingest_stream(spark, lake, "logs", str(landing), available_now=True).awaitTermination()
    ingest_stream(spark, lake, "logs", str(landing), available_now=True).awaitTermination()
    rows = {r.node_id: r for r in read_raw(spark, lake, "logs").collect()}
    assert set(rows) == {"1", "2"}
    assert (str(rows["1"].date), rows["1"].hour) == ("2024-01-01", "05")
    assert rows["2"].ts is None and rows["2"].date is not None
    line = json.loads(read_raw_lines(spark, lake, "logs").first().value)
    assert "xname" in line and line["xname"] is None


def test_rewriting_a_raw_batch_replaces_it(spark, lake):
    records = spark.createDataFrame([("2024-01-01T05:00:00Z", "a")], "ts string, msg string")
    write_raw(records, lake.raw("logs"), "b1")
    write_raw(records, lake.raw("logs"), "b1")
    write_raw(records, lake.raw("logs"), "b2")
    assert read_raw(spark, lake, "logs").count() == 2


def test_empty_lake_and_wrong_names(spark, lake):
    for stream, fields in (("logs", LOG_FIELDS), ("events", EVENT_FIELDS)):
        frame = sources(spark, lake, stream)
        assert frame.columns == [*fields, "date", "hour", "event_ts"] and frame.count() == 0
    with pytest.raises(ValueError, match="stream"):
        sources(spark, lake, "metrics")
    with pytest.raises(ValueError, match="scope"):
        sources(spark, lake, "logs", "old")
    with pytest.raises(ValueError, match="unknown report"):
        run_report("nope", sources(spark, lake, "logs"))
    with pytest.raises(ValueError, match="format"):
        write_result(frame, "/nowhere", "xml")


def test_files_lacking_columns_are_read_by_name(spark, lake):
    old = spark.createDataFrame([("2024-01-01T00:00:00Z", "x")], "ts string, retired string")
    old.write.parquet(f"{lake.compacted('logs')}/date=2024-01-01")
    row = read_compacted(spark, lake, "logs", ("retired",)).first()
    assert (row.ts, row.service, row.retired) == ("2024-01-01T00:00:00Z", None, "x")


def test_queries(spark, lake):
    put(lake, "a.ndjson", GOOD + "\n" + GOOD.replace("smd", "bss").replace("{\\\"a\\\":1}", "oops"))
    put(lake, "b.ndjson", GOOD, day="2024-01-02", hour="00")
    assert query(spark, lake, "select count(*) as n from SOURCES a join SOURCES b on a.ts = b.ts;").first().n == 9
    found = query(spark, lake, "select * from SOURCES where json_extract_string(data, '$.a') = '1'")
    assert found.count() == 2
    rows = [json.loads(r.json) for r in json_rows(dump(spark, lake), "logs").collect()]
    assert sorted(map(str, (r["data"] for r in rows))) == ["oops", "{'a': 1}", "{'a': 1}"]
    assert all("xname" in r for r in rows)
    one_day = between_dates(sources(spark, lake, "logs"), "2024-01-02", None)
    assert one_day.count() == 1
    days = available_dates(sources(spark, lake, "logs"), from_folders=False).collect()
    assert [str(r.date) for r in days] == ["2024-01-01"]
    folders = available_dates(sources(spark, lake, "logs")).collect()
    assert [str(r.date) for r in folders] == ["2024-01-01", "2024-01-02"]
    schema = dataset_schema(sources(spark, lake, "logs")).collect()
    assert (schema[0].column_name, schema[0].column_type) == ("ts", "string")


def test_filters_reach_the_scans(spark, lake):
    put(lake, "a.ndjson", GOOD)
    compact_raw(spark, lake, "logs")
    put(lake, "b.ndjson", GOOD, day="2024-01-02")
    found = between_dates(sources(spark, lake, "logs"), "2024-01-02", "2024-01-03")
    assert found.count() == 1
    compacted = sources(spark, lake, "logs", "compacted")
    late = run_report("find-all-service-errors", compacted, since="2024-01-02T00:00:00Z").select("msg")
    plan = late._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.splitlines() if "FileScan parquet [level" in line]
    assert "PartitionFilters: [isnotnull(date" in scan
    assert "GreaterThanOrEqual(event_ts,2024-01-02 00:00:00.0)" in scan and "In(level" in scan
    assert "ReadSchema: struct<level:string,msg:string,event_ts:timestamp>" in scan
    assert late.count() == 0


def test_trace_walk_scans_the_compacted_tier_once(spark, lake):
    put(lake, "a.ndjson", GOOD.replace('"x":5', '"trace_id":"t"'))
    compact_raw(spark, lake, "logs")
    walked = run_report("trace-walk", sources(spark, lake, "logs", "compacted"))
    walked.collect()
    plan = walked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "trace_id" in line]
    assert len(scans) == 1 and "ReusedExchange" in plan


def test_since_implies_days_in_utc(spark, lake):
    record = {"ts": "2024-01-01T23:30:00-05:00", "level": "err", "service": "smd"}
    put(lake, "a.ndjson", json.dumps(record))
    compact_raw(spark, lake, "logs")
    found = run_report(
        "find-all-service-errors", sources(spark, lake, "logs"),
        since="2024-01-02T00:00:00Z", from_date="2024-01-02",
    )
    assert [str(r.date) for r in found.collect()] == ["2024-01-02"]


def test_since_and_until_reach_raw_records_of_any_folder(spark, lake):
    record = {"ts": "2024-01-01T03:00:00Z", "level": "err", "service": "smd"}
    put(lake, "late.ndjson", json.dumps(record), day="2024-01-09")
    (Path(lake.raw("logs")) / "bare.ndjson").write_text(json.dumps(record))
    folder = Path(lake.raw("logs")) / "date=2023-12-01"
    folder.mkdir()
    (folder / "early.ndjson").write_text(json.dumps(record))

    def found():
        records = sources(spark, lake, "logs")
        assert "_compacted" not in records.columns
        ranged = run_report(
            "find-all-service-errors", records, since="2024-01-01T00:00:00Z", until="2024-01-02T00:00:00Z"
        )
        assert ranged.columns == records.columns
        return ranged

    assert found().count() == 3
    compact_raw(spark, lake, "logs")
    put(lake, "next.ndjson", json.dumps(record), day="2024-02-01")
    assert found().count() == 4
    # The compacted tier is skipped by day, beside the raw one too.
    plan = found()._jdf.queryExecution().executedPlan().toString()
    (scan,) = [line for line in plan.splitlines() if "FileScan parquet [ts" in line]
    assert "date#" in (days := scan.split("PartitionFilters: [")[1].split("]")[0]) and ">= 2023-12-31" in days


def test_lakes_of_another_program(spark, tmp_path):
    lake = Lake(str(tmp_path / "other"), typed_times=False)
    old = spark.createDataFrame([("2024-01-01T00:00:00Z", "err")], "ts string, level string")
    old.write.parquet(f"{lake.compacted('logs')}/date=2024-01-01")
    found = run_report("find-all-service-errors", sources(spark, lake, "logs"), since="2024-01-01T00:00:00Z")
    assert found.count() == 1


def test_compaction_without_raw_tier_does_nothing(spark, lake):
    compact_raw(spark, lake, "events")
    run_compaction(spark, lake)
    assert read_compacted(spark, lake, "events").count() == 0


def test_reports_check_their_parameters(spark, lake):
    logs, events = sources(spark, lake, "logs"), sources(spark, lake, "events")
    with pytest.raises(ValueError, match="no parameter"):
        run_report("errors-by-service", logs, sevrice="x")
    with pytest.raises(AnalysisException):
        run_report("find-all-service-errors", events)
    for name in REPORTS:
        assert report_schema(name, logs).count() > 0


@pytest.mark.parametrize("fmt", ["csv", "ndjson", "text"])
def test_results_survive_awkward_text(spark, tmp_path, fmt):
    rows = [(1, 'say "hi", ok\nnext\tcol', None), (2, "", "\\back"), (3, "plain", "x")]
    frame = spark.createDataFrame(rows, "n int, a string, b string").coalesce(1)
    path = str(tmp_path / fmt)
    write_result(frame, path, fmt)
    if fmt == "ndjson":
        assert spark.read.schema(frame.schema).json(path).collect() == frame.collect()
    elif fmt == "csv":
        back = spark.read.schema(frame.schema).options(
            header="true", quote='"', escape='"', multiLine="true").csv(path)
        assert [r.a or "" for r in back.orderBy("n").collect()] == [r[1] for r in rows]
    else:
        lines = [r.value for r in spark.read.text(path).collect()]
        assert sorted(lines)[0] == '1\tsay "hi", ok\\nnext\\tcol\t'


def test_trace_walk_equals_an_undivided_window(spark):
    from pyspark.sql import Window

    from logtarn.plans.reports import trace_walk

    n = F.col("id")
    seconds = F.when(n % 3 == 0, n * 7 % 400).otherwise(n * 13 % 5000)
    records = spark.range(4000).select(
        # One trace holds a third of all rows, some of them at the same time or without one.
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), n % 40)).alias("trace_id"),
        F.when(n % 97 == 0, None).otherwise(
            F.date_format(F.timestamp_seconds(seconds + F.lit(1_700_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("ts"),
        F.lit("smd").alias("service"), F.format_string("%05d", n).alias("payload_json"),
    )
    walked = trace_walk(records).orderBy("trace_id", "hop").collect()
    untimed = F.when(F.col("event_ts").isNull(), F.pmod(F.xxhash64("payload_json"), F.lit(1024)))
    whole = Window.partitionBy("trace_id").orderBy("event_ts", untimed, "payload_json")
    event_ts = F.col("ts").try_cast("timestamp")
    gap = F.unix_micros("event_ts") - F.unix_micros(F.lag("event_ts").over(whole))
    expected = records.withColumn("event_ts", event_ts).select(
        "trace_id", F.row_number().over(whole).alias("hop"), "ts", (gap / 1_000_000).alias("gap"),
    ).orderBy("trace_id", "hop").collect()
    assert [(r.trace_id, r.hop, r.ts, r.gap_seconds) for r in walked] == [tuple(r) for r in expected]


def test_batches_compacted_whole_are_left_out_by_name(spark, lake, monkeypatch):
    def records(*times):
        return spark.createDataFrame([(t, "a") for t in times], "ts string, msg string")

    write_raw(records("2024-01-01T05:00:00Z", "2024-01-01T06:00:00Z"), lake.raw("logs"), "b-1")
    write_raw(records("2024-01-01T05:30:00Z"), lake.raw("logs"), "b-2")
    flawed = next(Path(lake.raw("logs")).rglob("batch=b-2-*"))
    with pa.CompressedOutputStream(str(flawed), "zstd") as out:
        out.write(b'{"ts":5}\n')
    compact_raw(spark, lake, "logs", "one")
    assert read_mark(spark, lake.uncleared("logs"), "one") == {"batches": ["b-1"], "others": False}
    found = read_raw(spark, lake, "logs")
    assert [r.ts for r in found.collect()] == ["5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert found.inputFiles() and sources(spark, lake, "logs").count() == 3
    # Beyond the listed names, and for other writers, objects are looked up.
    monkeypatch.setattr(compact, "LISTED_BATCHES", 0)
    write_raw(records("2024-01-02T05:30:00Z"), lake.raw("logs"), "b-3")
    put(lake, "foreign.ndjson", GOOD)
    compact_raw(spark, lake, "logs", "two")
    assert read_mark(spark, lake.uncleared("logs"), "two") == {"batches": [], "others": True}
    assert sources(spark, lake, "logs").count() == 5 and read_raw(spark, lake, "logs").count() == 1
    assert compact.clear_compacted(spark, lake, "logs") == 4
    assert sources(spark, lake, "logs").count() == 5


def test_raw_objects_are_zstd_that_other_engines_read(spark, lake):
    rows = [(f"2024-01-0{1 + k % 3}T0{k % 4}:00:00Z", f"é\n{k}", None) for k in range(200)]
    records = spark.createDataFrame(rows, "ts string, msg string, xname string").repartition(5)
    write_raw(records, lake.raw("logs"), "b-7")
    objects = [p for p in Path(lake.raw("logs")).rglob("*") if p.is_file() and "_done" not in str(p)]
    assert objects and all(p.name.endswith(".ndjson.zst") and p.name.startswith("batch=b-7-") for p in objects)
    found = duckdb.sql(
        f"SELECT ts, msg, xname, date, hour FROM read_json('{lake.raw('logs')}/**/*.ndjson.zst', "
        "columns={ts: 'VARCHAR', msg: 'VARCHAR', xname: 'VARCHAR'}, hive_partitioning=true)"
    ).fetchall()
    assert sorted(r[:3] for r in found) == sorted(rows)
    assert all(f"{r[3]}T{r[4]:0>2}" == r[0][:13] for r in found)
    assert sorted((r.ts, r.msg, r.xname) for r in read_raw(spark, lake, "logs").collect()) == sorted(rows)


def test_a_failed_write_leaves_nothing_behind(spark, lake):
    records = spark.range(100).selectExpr(
        "format_string('2024-01-01T%02d:00:00Z', id % 20) AS ts", "if(id = 77, raise_error('x'), 'a') AS msg"
    ).repartition(4)
    with pytest.raises(Exception, match="x"):
        write_raw(records, lake.raw("logs"), "b")
    left = [p for p in Path(lake.raw("logs")).rglob("*") if p.is_file() and "/_open/" not in str(p)]
    assert left == [] and read_raw(spark, lake, "logs").count() == 0
    write_raw(records.withColumn("msg", F.lit("a")), lake.raw("logs"), "b")
    assert read_raw(spark, lake, "logs").count() == 100


def test_objects_of_attempts_that_were_not_committed_vanish(tmp_path):
    writer = ObjectWriter(str(tmp_path), "b", {})
    rows = pa.RecordBatch.from_pydict({"date": ["d", "d"], "hour": ["01", "02"], "value": ["{}", "[1]"]})
    writer.write(iter([rows]))  # an attempt that was killed
    twice = writer.write(iter([rows, rows.slice(1)]))
    writer.commit([twice, None, writer.write(iter([]))])
    files = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    assert sorted(str(p.relative_to(tmp_path)) for p in files) == sorted(twice.names)
    with pa.input_stream(str(files[1]), compression="zstd") as text:
        assert text.read() == b"[1]\n[1]\n"
    assert [p.name for p in tmp_path.iterdir() if p.name != "date=d"] == ["_staging"]


def test_store_settings_follow_the_session(spark, monkeypatch):
    conf = {"spark.hadoop.fs.s3a.endpoint": "http://store:9000", "spark.hadoop.fs.s3a.access.key": "k",
            "spark.hadoop.fs.s3a.secret.key": "s"}
    for key, value in conf.items():
        spark.conf.set(key.removeprefix("spark.hadoop."), value)
    try:
        found = store_settings(spark)
        assert found["endpoint_override"] == "http://store:9000" and found["access_key"] == "k"
        store, path = open_store("s3a://bucket/a%20b/c", found)
        assert store.type_name == "s3" and path == "bucket/a b/c"
    finally:
        for key in conf:
            spark.conf.unset(key.removeprefix("spark.hadoop."))


def runs_of_days(lake, runs):
    """Small runs over the same three days, each line its own, some without a time."""
    frames, n = [], 0
    for run in range(runs):
        rows = []
        for day in range(1, 4):
            n += 1
            rows.append((json.dumps({"ts": f"2024-01-0{day}T0{run}:00:00Z", "trace_id": f"t{n}"}), f"f/date=2024-01-0{day}/{run}"))
        rows.append((json.dumps({"msg": f"no time {run}"}), f"g/{run}"))
        frames.append(rows)
    return frames


def store_runs(spark, lake, runs):
    for k, rows in enumerate(runs_of_days(lake, runs)):
        compact_lines(spark.createDataFrame(rows, "value string, source_file string"), lake, "logs", f"run{k}")


def lines_of(frame):
    return sorted(r.payload_json for r in frame.collect())


def test_small_files_of_several_runs_are_merged(spark, lake, one_part):
    store_runs(spark, lake, 5)
    before = lines_of(read_compacted(spark, lake, "logs"))
    running = read_compacted(spark, lake, "logs")  # a query that began earlier
    assert merge_small(spark, lake, "logs") == 20
    assert lines_of(read_compacted(spark, lake, "logs")) == before == lines_of(running)
    assert merge_small(spark, lake, "logs") == 0  # deletes what was replaced
    files = [p for p in Path(lake.compacted("logs")).rglob("*.parquet")]
    assert len(files) == 4 and {p.parent.parent.name[:12] for p in files} == {"batch=merge-"}
    assert lines_of(read_compacted(spark, lake, "logs")) == before
    assert marks(spark, lake.replaced("logs")) == []
    one = read_compacted(spark, lake, "logs").where("date = DATE'2024-01-02'").orderBy("event_ts").collect()
    assert [r.trace_id for r in one] == ["t2", "t5", "t8", "t11", "t14"]
    # Large parts stay; what is small is laid out in files of the size.
    store_runs(spark, lake, 2)
    largest = max(p.stat().st_size for p in files)
    assert merge_small(spark, lake, "logs", size=largest // 4) == 0
    assert len(lines_of(read_compacted(spark, lake, "logs"))) == 20 + 8


def test_merging_in_several_runs(spark, lake, one_part, monkeypatch):
    store_runs(spark, lake, 3)
    before = lines_of(read_compacted(spark, lake, "logs"))
    monkeypatch.setattr(merge, "PARTS", 5)
    assert merge_small(spark, lake, "logs") == 12
    assert len(marks(spark, lake.replaced("logs"))) == 4
    assert lines_of(read_compacted(spark, lake, "logs")) == before


def test_merging_that_dies_at_any_step_loses_and_doubles_nothing(spark, tmp_path, one_part):
    step, finished = 0, False
    while not finished:
        step += 1
        lake = Lake(str(tmp_path / f"lake-{step}"))
        store_runs(spark, lake, 2)
        before = lines_of(read_compacted(spark, lake, "logs"))
        with pytest.MonkeyPatch.context() as patch:
            reached = dies_at(patch, step, {merge: ("put_mark", "drop_mark", "write_parquet")})
            try:
                merge_small(spark, lake, "logs")
            except Died:
                pass
            finished = reached[0] < step
        assert lines_of(read_compacted(spark, lake, "logs")) == before
        merge_small(spark, lake, "logs")
        assert lines_of(read_compacted(spark, lake, "logs")) == before
    assert step > 3


def test_all_fields_of_all_writers_are_columns(spark, lake):
    ours = spark.createDataFrame([("2024-01-01T05:00:00Z", "a", 7)], "ts string, msg string, `odd name` int")
    write_raw(ours, lake.raw("logs"), "b-1")
    put(lake, "one.ndjson", '{"ts":"1","Rack":"r1","ODD NAME":"x","date":"mine"}\n{oops\n[1]\n')
    put(lake, "two.ndjson.zst", '{"ts":"2","rack":"r2","deep":{"a":1}}\n')
    catalogue_fields(spark, lake, "logs")
    assert catalogued_fields(spark, lake, "logs") == ("Rack", "deep", "odd name")
    for _ in range(2):  # raw, and then compacted but for the flawed object
        found = sources(spark, lake, "logs", extra_fields=CATALOGUED)
        assert found.columns == [*LOG_FIELDS, "Rack", "deep", "odd name", "date", "hour", "event_ts"]
        rows = {r.ts: r for r in found.collect()}
        assert (rows["1"].Rack, rows["2"].Rack, rows["2"].deep) == ("r1", None, '{"a":1}')
        assert rows["2024-01-01T05:00:00Z"]["odd name"] == "7"
        wide = query(spark, lake, "select * from SOURCES where deep is not null", extra_fields=CATALOGUED)
        assert wide.count() == 1
        compact_raw(spark, lake, "logs")


def test_lookups_skip_row_groups(spark, lake):
    lines = [json.dumps({"ts": f"2024-01-01T00:{k // 60 % 60:02d}:{k % 60:02d}Z", "trace_id": f"t{k * 7919 % 5000:05d}"})
             for k in range(5000)]
    put(lake, "a.ndjson", "\n".join(lines))
    spark.conf.set("parquet.block.size", 20_000)
    try:
        compact_raw(spark, lake, "logs")
    finally:
        spark.conf.unset("parquet.block.size")

    def read(trace):
        found = run_report("trace-walk", sources(spark, lake, "logs", "compacted"), trace_id=trace)
        rows = found.collect()
        plan, scanned = [found._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            if "AdaptiveSparkPlan" in node.nodeName():
                plan.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                plan.append(node.plan())
            elif node.nodeName().startswith("Scan"):
                scanned = max(scanned, node.metrics().get("numOutputRows").get().value())
            children = node.children()
            plan += [children.apply(k) for k in range(children.size())]
        return len(rows), scanned

    assert read("t02500") == (1, read("t02500")[1]) and 0 < read("t02500")[1] < 2500
    assert read("t02500x") == (0, 0)


def test_trace_walk_by_blocks_of_any_size(spark, monkeypatch):
    from logtarn.plans import reports

    seconds = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 37 % 3000)
    records = spark.range(1500).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 9)).alias("trace_id"),
        F.date_format(F.timestamp_seconds(seconds + F.lit(1_700_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.lit("smd").alias("service"), F.format_string("%05d", "id").alias("payload_json"),
    )
    found = []
    for bits in (62, 12, 3, 0):  # a block for all, some, and one for each slot
        monkeypatch.setattr(reports, "TRACE_BLOCK_BITS", bits)
        found.append(sorted(map(tuple, reports.trace_walk(records).collect()), key=str))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 1500


def listed(path, **programs):
    table = [{"index": name.replace("_", "-"), "value": value} for name, value in programs.items()]
    path.write_text(json.dumps({"version": 1, "nomatch": "0", "type": "string", "table": table}))


def test_a_changed_allow_list_takes_effect_in_the_next_batch(spark, lake, tmp_path):
    landing, table = tmp_path / "landing", tmp_path / "lookup.json"
    landing.mkdir()
    listed(table, smd="1", my_app="0")
    line = "<27>1 2024-01-01T05:00:00Z h {} - - - nid=1\n"

    def ingest(name):
        (landing / name).write_text(line.format("smd") + line.format("my-app") + line.format("other"))
        ingest_stream(spark, lake, "logs", str(landing), available_now=True, allow_list=str(table)).awaitTermination()
        return sorted(r.service for r in read_raw(spark, lake, "logs").collect())

    assert ingest("one.log") == ["smd"]
    listed(table, my_app="1")
    assert ingest("two.log") == ["my-app", "smd"]
    table.write_text('{"table":[{"index":"smd","value":"1"},{"index":"smd","value":"0"}]}')
    assert ingest("three.log") == ["my-app", "smd", "smd"]


def test_a_backlog_is_taken_in_batches_of_bounded_bytes(spark, lake, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    line = "<27>1 2024-01-01T05:00:00Z h smd - - - nid=1\n"
    for k in range(6):
        (landing / f"{k}.log").write_text(line * 100)
    size = len(line) * 100
    running = ingest_stream(
        spark, lake, "logs", str(landing), available_now=True, max_bytes_per_trigger=2 * size
    )
    running.awaitTermination()
    taken = [p["numInputRows"] for p in running.recentProgress if p["numInputRows"]]
    assert taken == [200, 200, 200] and read_raw(spark, lake, "logs").count() == 600


def parses(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("from_json")


def test_a_checked_line_is_parsed_once_whatever_is_asked_of_it(spark):
    checked = compact.check_lines(spark.createDataFrame([(GOOD, "f")], "value string, source_file string"), "logs")
    for reason in (F.col("reason").isNull(), F.col("reason").isNotNull()):
        assert parses(checked.where(reason)) == 1
    assert checked.collect() == [(GOOD, "f", None)]


def test_salvaging_checks_lines_of_flawed_objects_only(spark, lake, monkeypatch):
    """The judging pass sees all lines, the passes after it those of flawed objects."""
    put(lake, "a.ndjson", "\n".join([GOOD] * 3))
    put(lake, "b.ndjson", "\n".join([GOOD, "{oops", GOOD]))
    seen_by, check = [], compact.check_lines

    def checking(lines, stream):
        seen_by.append(lines.count())
        return check(lines, stream)

    monkeypatch.setattr(compact, "check_lines", checking)
    compact_raw(spark, lake, "logs", salvage=True)
    monkeypatch.undo()
    assert seen_by == [6, 3]
    assert read_compacted(spark, lake, "logs").count() == 5
    assert [r.line for r in read_quarantine(spark, lake, "logs").collect()] == ["{oops"]


def test_objects_without_a_name_are_salvaged_too(spark, lake):
    lines = spark.createDataFrame([(GOOD, None), ("{oops", None)], "value string, source_file string")
    compact_lines(lines, lake, "logs", "b", salvage=True)
    assert lines_of(read_compacted(spark, lake, "logs")) == [GOOD]


def test_compaction_parses_in_all_tasks_of_the_scan(spark, tmp_path):
    rows = [(json.dumps({"ts": f"2024-01-0{1 + n % 2}T00:00:{n % 60:02d}Z"}), "f") for n in range(400)]
    lines = spark.createDataFrame(rows, "value string, source_file string").repartition(8)
    records = compact.project_records(lines, "logs").withColumn("xname", F.spark_partition_id().cast("string"))
    sinks.write_compacted(records, str(tmp_path / "t"), "b")
    assert spark.read.parquet(str(tmp_path / "t")).select("xname").distinct().count() == 8
    assert len(list(tmp_path.rglob("*.parquet"))) == 2


def test_merging_shares_days_among_tasks(spark, lake, monkeypatch):
    store_runs(spark, lake, 4)
    before = lines_of(read_compacted(spark, lake, "logs"))
    monkeypatch.setattr(merge, "LAID_BYTES", 1)
    assert merge_small(spark, lake, "logs") == 16
    assert lines_of(read_compacted(spark, lake, "logs")) == before
    merge_small(spark, lake, "logs")  # deletes what was replaced
    parts = [p.name[:10] for p in Path(lake.compacted("logs")).rglob("*.parquet")]
    assert len(parts) == len(set(parts)) == 4


def test_merging_lays_large_days_in_ranges_beside_small_ones(spark, lake):
    store_runs(spark, lake, 2)
    days = merge.small_parts(spark, lake, "logs", 1 << 20).collect()
    size = min(d.bytes for d in days)
    stored = read_compacted(spark, lake, "logs")
    laid = merge._laid(stored, days, size)
    assert lines_of(laid) == lines_of(stored) and laid.rdd.getNumPartitions() > 1
    assert {len(d) for d in laid.withColumn("p", F.spark_partition_id()).groupBy("p").agg(
        F.collect_set("date").alias("d")).toPandas()["d"]} <= {0, 1}
