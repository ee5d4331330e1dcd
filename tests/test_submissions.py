"""Batch submissions: byte files, forms, ordered distinct urls, limits and outcomes, against plain Python."""

import datetime as dt
import random
import re

from sitefold.operators import batches as B
from sitefold.plans import job_queries as Q
from sitefold.sources import jobtables as T

PARTS = [b"\xff", b"\xc3", b"\xc3\xa9", b"\xc0\xaf", b"\xed\xa0\x80", b"\xe2\x82", b"\xe2\x82\xac", b"\xf0\x9f\x98", b"\xf0\x9f\x98\x80",
         b"\xf4\x90\x80\x80", b"\x80", b"\xe0\x80\xaf", b"\xf8\x88", b"\x00", b"\r", b"\xef\xbb\xbf", b"\n", b",", b" ", b"http://a.com", b"https://b.com/"]


def urls_of(text):
    return [u for u in map(str.strip, re.split(r"[\n,]+", text)) if u.startswith(("http://", "https://"))]


def _file(rng):
    return b"".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))


def test_broken_utf8_reads_as_python_reads_it(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for i in range(300):
        raw = _file(rng) if i % 2 else bytes(rng.randrange(256) for _ in range(rng.randint(0, 12)))
        (tmp_path / f"f{i}.txt").write_bytes(raw)
        want[f"f{i}.txt"] = raw.decode("utf-8", errors="replace")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in B.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {k: t for k, t in want.items() if t}  # an empty file has no row


def test_file_before_form(spark, tmp_path):
    (tmp_path / "seeds.txt").write_bytes(b"https://a.com\xff\nhttps://b.com,https://a.com\xff")
    lines = B.read_seed_sources(spark, str(tmp_path / "seeds.txt"), "https://b.com\nhttps://c.com")
    got = [(r["source_no"], r["url"]) for r in B.ordered_distinct(B.parse_seed_lines(lines)).orderBy("source_no", "line_no", "pos").collect()]
    assert got == [(0, "https://a.com�"), (0, "https://b.com"), (1, "https://c.com")]


def test_urls_and_outcomes_of_random_submissions(spark):
    rng = random.Random(2)
    rows, uploads, forms, want = [], [], [], {}
    for s in range(80):
        pages, depth = rng.choice([None, -3, 0, 1, 50, 200, 201, 999]), rng.choice([None, 0, 1, 3, 10, 11])
        rows.append((s, pages, depth, dt.datetime(2024, 1, 1)))
        texts = []
        for to in (uploads, forms):
            if rng.random() < 0.7:
                texts.append(_file(rng).decode("utf-8", errors="replace"))
                to.append((s, texts[-1]))
        urls = list(dict.fromkeys(u for t in texts for u in urls_of(t)))
        reason = ("max_pages out of range" if pages is None or pages < 1 else "max_depth out of range" if depth is None or not 1 <= depth <= 10
                  else None if urls else "no valid urls")
        want[s] = (urls, ("rejected" if reason else "accepted", reason, len(urls), urls[0] if urls else None, min(pages, 200) if pages is not None else None, depth))
    table = spark.createDataFrame(rows, "submission long, max_pages int, max_depth int, submitted_at timestamp_ntz")
    urls = B.submitted_urls(*(spark.createDataFrame(t, "submission long, text string") for t in (uploads, forms)))
    got = {s: [] for s in want}
    for r in urls.orderBy("submission", "pos").collect():
        assert r["pos"] == len(got[r["submission"]])
        got[r["submission"]].append(r["url"])
    assert got == {s: w[0] for s, w in want.items()}
    outcomes = {r["submission"]: tuple(r)[1:] for r in B.batch_submissions(table, urls).collect()}
    assert outcomes == {s: w[1] for s, w in want.items()}
    jobs = spark.createDataFrame([], "job_id long, url string, status string, submitted_at timestamp_ntz, completed_at timestamp_ntz, parent_batch_id long")
    spawned = B.expand_submissions(table, urls, jobs).collect()
    assert {r["batch_id"] for r in spawned} == {s for s, w in want.items() if w[1][0] == "accepted"}
    assert all(r["action"] in ("spawn", "drop") for r in spawned) and len(spawned) == sum(len(w[0]) for w in want.values() if w[1][0] == "accepted")


def test_no_submissions(spark):
    texts = spark.createDataFrame([], "submission long, text string")
    urls = B.submitted_urls(texts, texts)
    table = spark.createDataFrame([(1, 5, 3, dt.datetime(2024, 1, 1))], "submission long, max_pages int, max_depth int, submitted_at timestamp_ntz")
    assert urls.collect() == [] == B.batch_submissions(table.limit(0), urls).collect()
    assert [(r["reject_reason"], r["url"]) for r in B.batch_submissions(table, urls).collect()] == [("no valid urls", None)]


def test_packed_uploads_read_like_files(spark, tmp_path):
    rng = random.Random(4)
    raw = {f"submission={i}/seeds.txt": _file(rng) for i in range(200)} | {"empty": b""}
    spark.createDataFrame([(p, bytearray(b)) for p, b in raw.items()], "path string, content binary").write.parquet(str(tmp_path / "packed"))
    got = {r["path"]: r["text"] for r in B.read_uploads(spark, str(tmp_path / "packed"), packed=True).collect()}
    assert got == {p: b.decode("utf-8", errors="replace") for p, b in raw.items() if b}


def _tables(spark, tmp_path, n):
    """Orders of ``n`` submissions, one even key (in the file) and one odd key each, with a line item."""
    t0 = dt.datetime(1999, 1, 1)
    orders = [(10 * i + at, 25 * i, "F", t0 + dt.timedelta(days=i)) for i in range(n) for at in (2, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(o[0], 1, "N") for o in orders], "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    return [o[0] for o in orders]


def _files_of(monkeypatch, tmp_path):
    monkeypatch.setattr(T, "scratch_path", lambda spark, name: str(tmp_path / name))
    return lambda: [p for p in (tmp_path / "uploads").rglob("part-*") if p.is_file()]


def test_uploads_of_many_submissions_share_files(spark, tmp_path, monkeypatch):
    """a file for every submission made the query wait for its commits and listings."""
    n, files = 120, _files_of(monkeypatch, tmp_path)
    keys = _tables(spark, tmp_path, n)
    _, uploads, _ = T.submissions_table(spark, str(tmp_path))
    texts = {r["submission"]: r["text"] for r in uploads.collect()}
    assert len(files()) < n / 2 and texts.keys() == set(range(n))
    for key in (k for k in keys if k % 2 == 0):
        bad = [bytes.fromhex(x).decode("utf-8", errors="replace") for x in T.BAD_BYTES][key % 4]
        url = f"https://www.c{key // 4 % 500}.example.com/"
        line = (f"HTTPS://{key}" if key // 10 % 9 == 0 else f"no url {key}" if key % 7 == 0 else f"  {url} ,, {url}#x " if key % 11 == 0
                else f"{url}/{bad}" if key % 13 == 0 else url)
        assert texts[key // 10] == line + "\n"
    out = Q.QUERIES["batch_submissions"]
    monkeypatch.setattr(T, "scratch_path", lambda spark, name: str(tmp_path / "again" / name))
    assert {r["submission"] for r in out(spark, str(tmp_path)).collect()} == set(range(n))


def test_expanded_submissions_share_upload_files(spark, tmp_path, monkeypatch):
    """the same step under submission_expand."""
    n, files = 60, _files_of(monkeypatch, tmp_path)
    _tables(spark, tmp_path, n)
    rows = Q.QUERIES["submission_expand"](spark, str(tmp_path)).collect()
    accepted = {s for s in range(n) if s % 9 and 1 <= s * 37 % 230 - 10 and 1 <= s % 12 <= 10}
    assert len(files()) < n / 2 and {r["batch_id"] for r in rows} <= accepted and len({r["batch_id"] for r in rows}) > len(accepted) / 2


def test_items_are_normalized_once_and_looked_up_in_one_sort(spark, monkeypatch):
    """the items' urls were split for each of their three uses, and the jobs sorted twice for the as-of lookup."""
    from sitefold.operators import requests as R

    written, write = [], B.materialize
    monkeypatch.setattr(B, "materialize", lambda df: written.append(df.columns) or write(df))
    t0 = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, t0, 0, "https://A.com"), (1, t0, 1, "https://a.com/"), (2, t0, 0, "https://b.com")],
                                  "batch_id long, submitted_at timestamp_ntz, pos int, url string")
    jobs = spark.createDataFrame([(7, "https://a.com", "done", t0 - dt.timedelta(minutes=9), t0 - dt.timedelta(minutes=8), None)],
                                 "job_id long, url string, status string, submitted_at timestamp_ntz, completed_at timestamp_ntz, parent_batch_id long")
    got = sorted((r["batch_id"], r["pos"], r["action"], r["reused_job_id"]) for r in B.expand_items(items, jobs).collect())
    assert got == [(1, 0, "reuse", 7), (1, 1, "reuse", 7), (2, 0, "spawn", None)]
    assert written == [["batch_id", "submitted_at", "pos", "url", "norm_url"]]

    rng = random.Random(8)
    rows = [(f"https://www.same.example.com/{rng.randrange(3)}", rng.randrange(60) * 500_000, i, i, rng.random() < 0.3) for i in range(300)]
    out = R.asof_predecessor(spark.createDataFrame(rows, "key string, t long, s long, rid long, mark boolean"), 5)
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {i: max(((u, z, j) for k, u, z, j, m in rows if m and k == key and (u, z) <= (t, s)), default=(None,))[-1] for key, t, s, i, _ in rows}
    assert {r["rid"]: r["prev"] for r in out.collect()} == want
