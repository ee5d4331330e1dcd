"""Laws from SURVEY section 5 on real and skewed inputs."""

from pyspark.sql import functions as F

from sitefold.operators.documents import site_documents, site_sections
from sitefold.operators.pages import page_meta
from sitefold.plans import crawl_queries as Q


def _page(i, title):
    return f"<html><head><title>{title} | Big</title></head><body><h1>{title}</h1><p>text {i}</p></body></html>"


def test_a_large_site_lists_every_page_but_the_root(spark):
    rows = [(0, "https://big.com/", _page(0, "Root"))]
    rows += [(i, f"https://big.com/s{i % 7}/p{i}", _page(i, f"P{i:04d}")) for i in range(1, 1000)]
    rows += [(5000 + i, f"https://small{i}.com/x", _page(i, f"S{i}")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    docs = {r["site"]: r for r in site_documents(page_meta(pages)).collect()}
    big = docs["big.com"]
    assert big["page_count"] == 1000
    listed = [line.split("](")[1].split(")")[0] for line in big["llms_txt"].split("\n") if line.startswith("- [")]
    assert sorted(listed) == sorted(f"https://big.com/s{i % 7}/p{i}" for i in range(1, 1000))
    assert big["llms_txt"].startswith("# Root\n") and "| Big" not in big["llms_txt"]
    assert all(docs[f"small{i}.com"]["page_count"] == 1 for i in range(20))
    assert sum(r["page_count"] for r in docs.values()) == len(rows)


def test_every_listed_page_is_in_exactly_one_section(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = site_sections(page_meta(pages)).collect()
    keys = [(r["site"], r["page_ord"]) for r in rows]
    assert len(keys) == len(set(keys))


def test_crawl_laws(spark):
    jobs, seeds, result, levels = Q.run_crawl(spark, "/root/testdata/sf0.01", max_pages=5, max_depth=2)
    rows = result.collect()
    per_site = {}
    for r in rows:
        per_site.setdefault(r["site"], []).append(r)
    for site, rs in per_site.items():
        norms = [r["norm_url"] for r in rs]
        assert len(norms) == len(set(norms)), site                    # visited once
        assert sum(r["outcome"] == "ok" for r in rs) <= 5, site       # cap
        assert all(r["depth"] <= 2 for r in rs), site                 # depth limit
    assert result.filter(F.col("outcome").isNull()).count() == 0
