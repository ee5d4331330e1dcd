"""Child rows, manifests and documents of jobs."""

import random

from sitefold.operators import jobdetail as D


def test_child_pages_and_manifest(spark, monkeypatch):
    monkeypatch.setattr(D, "PAGE_ROWS", 7)
    rng = random.Random(3)
    sizes = {("a", "skipped"): 40, ("a", "crawled"): 7, ("b", "crawled"): 1}
    rows = [(j, k, i * 3 + 1, f"{j}{k}{i}") for (j, k), n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    children = D.child_pages(spark.createDataFrame(rows, "job string, kind string, at long, url string"), "job", "kind", "at")
    got = sorted(tuple(r) for r in children.select("job", "kind", "page_no", "slot", "url").collect())
    assert got == sorted((j, k, i // 7, i % 7, f"{j}{k}{i}") for (j, k), n in sizes.items() for i in range(n))
    jobs = spark.createDataFrame([("a", "done"), ("b", "error"), ("c", "done")], "job string, status string")
    parts = spark.createDataFrame([("a", "# t\n"), ("a", "x"), ("b", "never shown")], "job string, text string")
    out = {r["job"]: tuple(r)[2:] for r in D.manifest(jobs, children, parts, "job", ("skipped", "crawled")).collect()}
    assert out == {"a": (40, 6, 7, 1, 2, 5), "b": (0, 0, 1, 1, None, None), "c": (0, 0, 0, 0, None, None)}


def test_documents_of_results(spark):
    parts = spark.createDataFrame([(1, 0, "# one\n", "u1", 2), (1, 1, "body\n", "u1", 2), (2, 0, "# two\n", "u2", 1), (9, 0, "# unasked\n", "u9", 1)],
                                  "job_id long, part_no long, text string, root_url string, page_count long")
    rows = spark.createDataFrame([(7, 0, 1, "done"), (8, 0, 1, "done"), (8, 1, 2, "error"), (8, 2, 3, "running"), (8, 3, None, "done")],
                                 "batch_id long, pos int, job_id long, status string")
    out = {(r["batch_id"], r["pos"]): r["llms_txt"] for r in D.with_documents(rows, parts).collect()}
    assert out == {(7, 0): "# one\nbody\n", (8, 0): "# one\nbody\n", (8, 1): None, (8, 2): None, (8, 3): None}


def test_no_text_in_the_shuffles_of_the_rows(spark):
    """The plan of the whole query reads texts only where parts become documents and meet the finished rows."""
    rows = spark.range(3).selectExpr("id as batch_id", "id as job_id", "'done' as status")
    parts = spark.createDataFrame([], "job_id long, part_no long, text string, root_url string, page_count long")
    plan = D.with_documents(rows, parts)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("\n")[:3]
    assert any("Join LeftOuter" in line for line in top) and plan.count("llms_txt") >= 1
    assert not any("text#" in line for line in plan.split("\n") if "Range" in line)
