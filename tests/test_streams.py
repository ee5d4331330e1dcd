"""Streams over several files: late rows, counters by change, reruns of a micro-batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sitefold.operators import requests as R
from sitefold.sources import jobtables as T
from sitefold.streaming import streams as X

SF = "/root/testdata/sf0.001"


def _files(spark, tmp_path, name, frames):
    """One parquet file per frame, to be read in this order, one micro-batch each."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}-{i}")
    return f"{tmp_path}/{name}-*/*.parquet"


def test_late_requests_come_out_flagged(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema

    def events(*rows):
        return spark.createDataFrame([(i, day.replace(hour=h), 7, "view", 1.0, "{}") for i, h in rows], schema)

    source = _files(spark, tmp_path, "events", [events((14, 10)), events((15, 11)), events((17, 9), (18, 12))])
    rows = X.stream_request_dedup(spark, SF, lateness_seconds=60, source=source).orderBy("request_id").collect()
    assert [r["request_id"] for r in rows] == [14, 15, 17, 18]
    assert {r["request_id"]: r["late"] for r in rows} == {14: False, 15: False, 17: True, 18: False}
    # 10:00:01 + one hour: 11:00 is still served by the first job, 12:00 is not
    assert {r["request_id"]: r["job_request_id"] for r in rows} == {14: 14, 15: 14, 17: 14, 18: 18}


def test_dedup_does_not_depend_on_arrow_batches(spark, tmp_path):
    """A url's requests in no order of time, more of them than fit an Arrow batch, over two files."""
    rng = random.Random(5)
    day = dt.datetime(2024, 1, 1)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    rows = [(4 + 3 * i, day + dt.timedelta(minutes=20 * i), 7, "error" if i % 5 == 0 else "view", float(i % 7) * 300, "{}") for i in range(150)]
    files = [rows[:90], rows[90:]]
    for f in files:
        rng.shuffle(f)
    source = _files(spark, tmp_path, "events", [spark.createDataFrame(f, schema) for f in files])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = X.stream_request_dedup(spark, SF, lateness_seconds=86_400, source=source).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = R.request_dedup(T.requests_from_events(spark.createDataFrame(rows, schema))).collect()
    assert len(want) > 50 and sum(r["kept"] for r in want) > 5
    assert {(r["request_id"], r["kept"], r["job_request_id"]) for r in got} == {(r["request_id"], r["kept"], r["job_request_id"]) for r in want}
    assert len(got) == len(want) and not any(r["late"] for r in got)


def test_a_repeated_request_and_its_running_job(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 10)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    files = [[(14, day, 7, "view", 1.0, "{}")] * 2, [(14, day, 7, "view", 1.0, "{}"), (15, day + dt.timedelta(hours=2), 7, "view", 1.0, "{}")]]
    source = _files(spark, tmp_path, "events", [spark.createDataFrame(f, schema) for f in files])
    got = X.stream_request_dedup(spark, SF, lateness_seconds=60, source=source).collect()
    assert sorted((r["request_id"], r["job_request_id"]) for r in got) == [(14, 14), (14, 14), (14, 14), (15, 15)]


def test_counters_over_several_files(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linenumber")
    source = _files(spark, tmp_path, "lines", [lines.where(F.col("l_linenumber") % 3 == i) for i in range(3)])
    got = {tuple(r) for r in X.stream_job_progress(spark, SF, source).collect()}
    want = lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R"), F.count_if(F.col("l_returnflag") == "R"))
    assert got == {tuple(r) for r in want.collect()}


def test_results_once_even_if_an_epoch_runs_again(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    source = _files(spark, tmp_path, "orders", [orders.where(F.col("o_orderkey") % 2 == i) for i in range(2)])
    rows = X.stream_terminal_results(spark, SF, source)
    n = rows.count()
    assert n == rows.select("job_id").distinct().count() > 0
    folder = rows.inputFiles()[0].split("/epoch=")[0]
    first = spark.read.parquet(f"{folder}/epoch=0").checkpoint()
    first.write.mode("overwrite").parquet(f"{folder}/epoch=0")  # what the sink does on a rerun
    assert spark.read.parquet(folder).count() == n


def test_no_input_is_an_empty_table(spark, tmp_path):
    source = _files(spark, tmp_path, "none", [spark.read.parquet(f"{SF}/orders.parquet").limit(0)])
    assert X.stream_terminal_results(spark, SF, source).count() == 0


def _folders(path):
    return {p.name for p in path.iterdir() if p.is_dir()}


def test_state_log_against_a_dictionary(spark, tmp_path):
    """Random changes over many epochs, some run twice, with compaction and rows that die."""
    from sitefold.streaming.statelog import StateLog

    rng = random.Random(6)
    log, state = StateLog(str(tmp_path / "log"), "k string, v long", "k", every=3), {}
    for epoch in range(11):
        high = epoch * 10
        for _ in range(rng.choice([1, 2])):  # a rerun sees what the first run saw
            log.compact(spark, epoch, F.col("v") >= high - 40)
            if epoch % 3 == 0:
                state = {k: v for k, v in state.items() if v >= high - 40}
            assert {r["k"]: r["v"] for r in log.before(spark, epoch).collect()} == state
            keys = rng.sample(range(12), 3)
            some = spark.createDataFrame([(f"k{i}",) for i in keys], "k string")
            assert {r["k"]: r["v"] for r in log.before(spark, epoch, some).collect()} == {k: v for k, v in state.items() if k in {f"k{i}" for i in keys}}
            log.write(spark.createDataFrame([(f"k{i}", high + i) for i in keys], "k string, v long"), epoch)
        state = state | {f"k{i}": high + i for i in keys}
    assert _folders(tmp_path / "log") == {"base=6", "base=9", "changes"}
    assert _folders(tmp_path / "log/changes") == {f"epoch={n}" for n in range(6, 11)}


def test_dedup_writes_the_urls_it_saw(spark, tmp_path, monkeypatch):
    """A micro-batch of two urls writes two rows of state, however many urls are live."""
    day = dt.datetime(2024, 1, 1, 10)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    files = [[(i, day + dt.timedelta(seconds=i), i, "view", 1.0, "{}") for i in range(200)],
             [(i, day + dt.timedelta(minutes=30, seconds=i), i, "view", 1.0, "{}") for i in (204, 205)]]
    monkeypatch.setattr(X, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    got = X.stream_request_dedup(spark, SF, 60, source=_files(spark, tmp_path, "events", [spark.createDataFrame(f, schema) for f in files]))
    assert got.count() > 100
    sizes = [spark.read.parquet(f"{tmp_path}/stream_dedup-state/changes/epoch={n}").count() for n in (0, 1)]
    assert sizes[0] > 100 and sizes[1] == 2


def test_metrics_of_two_streams_in_any_order(spark, tmp_path):
    """Page results before, with and after their jobs; some whose job never comes."""
    from sitefold.operators.jobs import job_metrics

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    came = orders.where("o_orderkey % 4 <> 3")
    o = _files(spark, tmp_path, "o", [came.where("o_orderkey % 4 = 2"), came.where("o_orderkey % 4 < 2").limit(0), came.where("o_orderkey % 4 < 2")])
    x = _files(spark, tmp_path, "l", [lines.where(F.col("l_linenumber") % 3 == i) for i in range(3)])
    got = X.stream_job_metrics(spark, SF, o, x).collect()
    want = job_metrics(T.jobs_from_orders(spark, SF, came)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    none = _files(spark, tmp_path, "z", [orders.limit(0)])
    nothing = _files(spark, tmp_path, "y", [lines.limit(0)])
    assert tuple(X.stream_job_metrics(spark, SF, none, nothing).first()) == (0,) * 7
