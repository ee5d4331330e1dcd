"""Jobs, batches, seed lists (J1, J3-J15, S1-S3), sinks and the driver contract."""

import datetime as dt

from sitefold.operators import batches as B
from sitefold.operators import jobs as J
from sitefold.operators.requests import validate_requests
from sitefold.sources import sinks as K

JOBS_SCHEMA = ("job_id long, url string, status string, pages_crawled long, pages_skipped long, parent_batch_id long, "
               "max_pages int, max_depth int, submitted_at timestamp_ntz, started_at timestamp_ntz, "
               "completed_at timestamp_ntz, error string")
T0 = dt.datetime(2024, 1, 1)


def _job(i, url, status, submitted, started=None, completed=None, parent=None, crawled=1, skipped=0):
    return (i, url, status, crawled, skipped, parent, 50, 3, submitted, started, completed, None)


def test_validation(spark):
    rows = [("https://example.com", 50, 3), ("https://example.com", 999, 3), ("not-a-url", 50, 3), ("ftp://x.com/", 50, 3),
            ("https://example.com/p?q", 0, 3), ("https://example.com", 50, 11), ("HTTPS://Example.com?x=1", 200, 10)]
    df = spark.createDataFrame(rows, "url string, max_pages int, max_depth int")
    got = [(r["reject_reason"], r["accepted_url"]) for r in validate_requests(df).collect()]
    assert got == [(None, "https://example.com/"), ("max_pages out of range", None), ("invalid url", None), ("invalid url", None),
                   ("max_pages out of range", None), ("max_depth out of range", None), (None, "HTTPS://Example.com/?x=1")]


def test_metrics_listing_topk_and_durations(spark):
    rows = [_job(i, f"https://h{i}.com", "done", T0 + dt.timedelta(seconds=i // 2), T0, T0 + dt.timedelta(seconds=59.96 if i == 0 else 119.7))
            for i in range(11)]
    rows.append(_job(11, "https://p.com", "pending", T0, crawled=0))
    rows.append(_job(12, "https://e.com", "error", T0, T0, T0 + dt.timedelta(seconds=1), crawled=0, skipped=2))
    rows.append(_job(13, "https://kid.com", "running", T0, T0, parent=7))
    jobs = spark.createDataFrame(rows, JOBS_SCHEMA)
    m = J.job_metrics(jobs).collect()[0].asDict()
    assert m == {"active_jobs": 2, "total_jobs": 14, "completed_jobs": 11, "failed_jobs": 1, "cancelled_jobs": 0,
                 "total_pages_crawled": 12, "total_pages_skipped": 2}
    top = [r["job_id"] for r in J.recent_jobs(jobs, 10).collect()]
    assert top == [10, 9, 8, 7, 6, 5, 4, 3, 2, 13]            # equal submission times: higher id first
    batches = spark.createDataFrame([], "batch_id long, batch_urls array<string>, max_pages int, max_depth int, "
                                        "submitted_at timestamp_ntz, cancel_requested boolean")
    listing = J.job_listing(jobs, batches, B.batch_rollup(batches, jobs), "2024-01-02 00:00:00").collect()
    assert len(listing) == 13 and all(r["total"] == 13 for r in listing)
    texts = {r["job_id"]: r["duration_text"] for r in listing}
    assert texts[0] == "1m 0s" and texts[1] == "2m 0s" and texts[11] is None
    assert {r["job_id"]: r["elapsed_seconds"] for r in listing}[11] is None
    states = {r["job_id"]: (r["state"], r["cancellable"]) for r in J.job_states(jobs, "2024-01-01 00:00:30").collect()}
    assert states[11] == ("pending", True) and states[12] == ("error", False) and states[0] == ("running", True)


def test_batch_expand_reuse_drop_spawn(spark):
    jobs = spark.createDataFrame([
        _job(1, "https://done.com/", "done", T0, T0, T0 + dt.timedelta(seconds=10)),
        _job(2, "https://run.com", "running", T0, T0),
        _job(3, "https://old.com", "done", T0, T0, T0 + dt.timedelta(seconds=1)),
        _job(4, "https://err.com", "error", T0, T0, T0 + dt.timedelta(seconds=1)),
    ], JOBS_SCHEMA)
    batches = spark.createDataFrame([(
        9, ["https://DONE.com", "https://run.com/", "https://old.com", "https://err.com", "https://new.com", "https://NEW.com/"],
        50, 3, T0 + dt.timedelta(seconds=1800), False)],
        "batch_id long, batch_urls array<string>, max_pages int, max_depth int, submitted_at timestamp_ntz, cancel_requested boolean")
    got = [r["action"] for r in B.batch_expand(batches, jobs).orderBy("pos").collect()]
    assert got == ["reuse", "drop", "reuse", "spawn", "spawn", "drop"]
    late = batches.withColumn("submitted_at", batches.submitted_at + dt.timedelta(hours=2))
    assert [r["action"] for r in B.batch_expand(late, jobs).orderBy("pos").collect()][:3] == ["spawn", "drop", "spawn"]


def test_seed_list(spark):
    lines = spark.createDataFrame([(0, 0, "https://a.com, http://b.com\n\nnot-a-url,HTTPS://c.com"), (1, 0, " https://a.com ,https://d.com")],
                                  "source_no int, line_no long, line string")
    got = sorted((r["url"], r["source_no"], r["pos"]) for r in B.ordered_distinct(B.parse_seed_lines(lines)).collect())
    assert got == [("http://b.com", 0, 1), ("https://a.com", 0, 0), ("https://d.com", 1, 1)]


def test_seed_sources_file_then_form(spark, tmp_path):
    f = tmp_path / "seeds.txt"
    f.write_bytes(b"https://a.com\nhttps://b.com,\xff\nnot-a-url\n")
    lines = B.read_seed_sources(spark, str(f), "https://b.com\nhttps://c.com")
    got = sorted((r["url"], r["source_no"]) for r in B.ordered_distinct(B.parse_seed_lines(lines)).collect())
    assert got == [("https://a.com", 0), ("https://b.com", 0), ("https://c.com", 1)]
    assert B.read_seed_sources(spark, None, "  ").count() == 0


def test_site_files_roundtrip(spark):
    parts = [("a.com", "https://User@A.com:8443/", i, t) for i, t in enumerate(["# A\n\n", "## S\n\n- one\n", "- two\n"])]
    parts += [("007", "https://007/", 0, "# B\n"), ("b.com", "https://b.com/", 0, "first\n"), ("b.com:81", "https://b.com:81/", 0, "last\n")]
    df = spark.createDataFrame(parts, "site string, root_url string, part_no long, text string").repartition(5)
    path = K.scratch_path(spark, "test_files")
    K.write_site_files(df, path)
    back = {r["hostname"]: r["llms_txt"] for r in K.read_site_files(spark, path).collect()}
    assert back == {"a.com": "# A\n\n## S\n\n- one\n- two\n", "007": "# B\n", "b.com": "last\n"}


def test_archive_keeps_last_per_hostname(spark):
    rows = spark.createDataFrame([(1, 0, "https://A.com/", "first"), (1, 1, "http://a.com:80/x", "second"), (1, 2, "https://b.com", ""),
                                  (2, 0, "https://a.com", "other batch")], "batch_id long, pos int, url string, llms_txt string")
    got = sorted((r["batch_id"], r["entry"], r["llms_txt"], r["replaced"]) for r in K.archive_entries(rows).collect())
    assert got == [(1, "a.com-llms.txt", "second", 1), (2, "a.com-llms.txt", "other batch", 0)]


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["site", "root_url", "page_count", "llms_txt"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_chunked_row_number_matches_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sitefold.functions.plan import chunked_row_number

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", o) for o in rng.sample(range(100000), 3000)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r["k"], r["o"]): r["rn"] for r in chunked_row_number(df, ["k"], "o", "rn", chunk_width=997).collect()}
    want = {(r["k"], r["o"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o"))).collect()}
    assert got == want


def test_chunked_running_sum_matches_window(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sitefold.functions.plan import chunked_running_sum

    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else "k", o, rng.randrange(3)) for o in rng.sample(range(50000), 2000)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    got = {(r["k"], r["o"]): r["cs"] for r in chunked_running_sum(df, ["k"], "o", "v", "cs", chunk_width=331, inclusive=False).collect()}
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r["k"], r["o"]): r["cs"] for r in df.withColumn("cs", F.coalesce(F.sum("v").over(w), F.lit(0))).collect()}
    assert got == want


def test_batch_results_and_rollup_cases(spark):
    T1 = T0 + dt.timedelta(seconds=30)                   # the children are submitted when the batch starts
    jobs = spark.createDataFrame([
        _job(10, "https://k1.com", "done", T1, T1, T1 + dt.timedelta(seconds=5), parent=1, crawled=3, skipped=1),
        _job(11, "https://k2.com", "error", T1, T1, T1 + dt.timedelta(seconds=7), parent=1, crawled=0, skipped=2),
        _job(20, "https://k3.com", "running", T1, T1, parent=2, crawled=4),
        _job(30, "https://k4.com", "done", T1, T1, T1 + dt.timedelta(seconds=9), parent=3, crawled=1),
    ], JOBS_SCHEMA)
    batches = spark.createDataFrame([
        (1, ["https://k1.com", "https://k2.com"], 50, 3, T1, False),
        (2, ["https://k3.com"], 50, 3, T1, False),
        (3, ["https://k4.com"], 50, 3, T1, True),        # cancel requested: children are not cancelled
        (4, [], 50, 3, T1, False),                       # no urls
    ], "batch_id long, batch_urls array<string>, max_pages int, max_depth int, submitted_at timestamp_ntz, cancel_requested boolean")
    res = {r["batch_id"]: (r["url_count"], r["completed_count"], r["done_count"], r["in_progress_count"])
           for r in B.batch_results(batches, jobs).collect()}
    assert res == {1: (2, 2, 1, 0), 2: (1, 0, 0, 1), 3: (1, 1, 1, 0), 4: (0, 0, 0, 0)}   # errors count as completed
    roll = {r["batch_id"]: (r["status"], r["pages_crawled"], r["pages_skipped"]) for r in B.batch_rollup(batches, jobs).collect()}
    assert roll == {1: ("done", 3, 3), 2: ("running", 4, 0), 3: ("cancelled", 1, 0), 4: ("done", 0, 0)}


BATCHES = "batch_id long, batch_urls array<string>, max_pages int, max_depth int, submitted_at timestamp_ntz, cancel_requested boolean"


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_children_are_matched_by_url(spark):
    """Reused and dropped urls before a spawned one don't shift its child."""
    jobs = spark.createDataFrame([
        _job(1, "https://a.com", "done", _at(0), _at(0), _at(10), crawled=2), _job(2, "https://later.com", "running", _at(50), _at(50)),
        _job(3, "https://b.com", "done", _at(100), _at(100), _at(120), parent=9, crawled=7),
    ], JOBS_SCHEMA)
    batches = spark.createDataFrame([(9, ["https://a.com/", "https://later.com", "https://b.com"], 50, 3, _at(60), False)], BATCHES)
    rows = [(r["pos"], r["job_id"], r["status"], r["page_count"], r["finished"]) for r in B.batch_result_rows(batches, jobs).orderBy("pos").collect()]
    assert rows == [(0, 1, "done", 2, True), (2, 3, "done", 7, True)]
    roll = B.batch_rollup(batches, jobs).collect()[0]
    assert (roll["status"], roll["children"], roll["pages_crawled"], roll["duration_seconds"]) == ("done", 1, 7, 60.0)


def test_cache_is_seen_as_of_the_batch_start(spark):
    jobs = spark.createDataFrame([
        _job(1, "https://a.com", "done", _at(0), _at(0), _at(4950)), _job(2, "https://b.com", "error", _at(0), _at(0), _at(900)),
        _job(3, "https://c.com", "done", _at(0), _at(0), _at(100)), _job(4, "https://d.com", "done", _at(0), _at(0), _at(20), parent=8),
    ], JOBS_SCHEMA)

    def actions(seconds):
        batches = spark.createDataFrame([(9, [f"https://{x}.com" for x in "abcd"], 50, 3, _at(seconds), False)], BATCHES)
        return [r["action"] for r in B.batch_expand(batches, jobs).orderBy("pos").collect()]

    assert actions(50) == ["drop", "drop", "drop", "reuse"]        # a, b, c still ran; another batch's child counts
    assert actions(1000) == ["drop", "spawn", "reuse", "reuse"]    # b had failed
    assert actions(100 + 3600) == ["drop", "spawn", "spawn", "spawn"]  # the age reaches the ttl


def test_job_states_list_every_job_and_lookup_by_id(spark):
    jobs = spark.createDataFrame([_job(1, "https://a.com", "done", _at(0), _at(1), _at(5)), _job(2, "https://b.com", "pending", _at(3))], JOBS_SCHEMA)
    assert [(r["job_id"], r["state"]) for r in J.job_states(jobs, "2024-01-01 00:00:04").orderBy("job_id").collect()] == [(1, "running"), (2, "pending")]
    found = J.job_lookup(jobs, spark.createDataFrame([(1,), (77,)], "job_id long"), "2024-01-02 00:00:00").orderBy("job_id").collect()
    assert [(r["job_id"], r["found"], r["progress_pct"]) for r in found] == [(1, True, 100.0), (77, False, None)]
