"""Link crawl by url numbers and bitmaps against one worker's queue, many random sites in one job."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from sitefold.operators.linkcrawl import bitmaps, has_bit, link_reach, url_numbers
from sitefold.operators.robots import robots_rules

SEEDS = "site string, pos int, url string, sitemap_seeded boolean"
LINKS = "site string, src_norm string, pos int, url string"
OUTCOMES = "norm_url string, ok boolean, error string"
ROBOTS = "User-agent: *\nDisallow: /p7/\n"


def _norm(url):
    return url[:-1] if url.endswith("/") and url.count("/") > 3 else url


def _walk(site, seeds, links, outcomes, max_depth):
    """url -> (depth, outcome, reason) as one worker meets them."""
    queue = collections.deque((u, 0) for u in seeds)
    out, visited = {}, set()
    while queue:
        url, depth = queue.popleft()
        page = _norm(url)
        if page in visited:
            continue
        visited.add(page)
        if not url.startswith(f"https://{site}/") or url.endswith(".pdf"):
            continue
        if url.startswith(f"https://{site}/p7/"):
            out[page] = depth, "skipped", "disallowed by robots.txt"
        elif not outcomes.get(page, (False, None))[0]:
            out[page] = depth, "skipped", outcomes.get(page, (False, None))[1] or "HTTP 404"
        else:
            out[page] = depth, "ok", None
            if depth < max_depth:
                queue.extend((u, depth + 1) for u in links.get(page, []))
    return out


def _site(k):
    """A random site: ``/p7`` may be read and ``/p7/`` may not, so the spelling met first decides."""
    rng, site = random.Random(k), f"s{k}.com"
    pages = [f"https://{site}/p{i}" for i in range(12)]
    names = [*pages, *[p + "/" for p in pages], f"https://{site}/f.pdf", "https://elsewhere.com/p1", f"https://{site}/none"]
    links = {p: [rng.choice(names) for _ in range(rng.randint(0, 4))] for p in pages}
    outcomes = {p: (True, None) if rng.random() < 0.8 else (False, rng.choice(["HTTP 500", None])) for p in pages}
    return site, rng.sample(names, 2), links, outcomes


@pytest.mark.parametrize("max_depth", [0, 4])
def test_random_sites_match_one_worker(spark, max_depth):
    sites = [_site(k) for k in range(25)]
    seeds = [(s, i, u, False) for s, us, _, _ in sites for i, u in enumerate(us)] + [("s0.com", 9, None, False)]
    seeds += [("listed.com", 0, "https://listed.com/a", True)]
    links = [(s, p, i, u) for s, _, ls, _ in sites for p, us in ls.items() for i, u in enumerate(us)]
    links += [("listed.com", "https://listed.com/a", 0, "https://listed.com/b"), ("unseeded.com", "https://unseeded.com/a", 0, "https://unseeded.com/b"),
              ("s0.com", "https://s0.com/p0", 8, None), links[0], links[1]]
    outcomes = [(p, *o) for _, _, _, os in sites for p, o in os.items()] + [(f"https://{h}.com/{p}", True, None) for h in ("listed", "unseeded") for p in "ab"]
    rules = robots_rules(spark.createDataFrame([(s, 200, ROBOTS) for s, *_ in sites], "site string, status int, text string"))
    extra = spark.createDataFrame(links, LINKS).withColumns({"dst": F.lit("x"), "code": F.lit(0), "bits": F.lit(1)})
    got = link_reach(spark.createDataFrame(seeds, SEEDS), extra, spark.createDataFrame(outcomes, OUTCOMES), rules, "agent", max_depth).collect()
    want = {(s, u): v for s, us, ls, os in sites for u, v in _walk(s, us, ls, os, max_depth).items()} | {("listed.com", "https://listed.com/a"): (0, "ok", None)}
    assert {(r["site"], r["norm_url"]): (r["depth"], r["outcome"], r["reason"]) for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    seeds, links, outcomes = (spark.createDataFrame([], t) for t in (SEEDS, LINKS, OUTCOMES))
    assert link_reach(seeds, links, outcomes, None, "agent").collect() == []
    one = spark.createDataFrame([("a.com", 0, "https://a.com/", False)], SEEDS)
    assert [tuple(r) for r in link_reach(one, links, outcomes, None, "agent").collect()] == [("a.com", "https://a.com/", 0, "skipped", "HTTP 404")]


def test_numbers_are_dense_and_bits_are_exact(spark):
    rows = [(f"s{i % 7}", f"u{i}") for i in range(500)]
    got = [tuple(r) for r in url_numbers(spark.createDataFrame(rows + rows, "site string, norm_url string")).orderBy("uid").collect()]
    assert got == [(*r, i) for i, r in enumerate(sorted(rows), 1)]
    ids = spark.range(1, 100_000)
    marked = bitmaps(ids.filter("id % 3 = 1 or id in (32768, 32769, 65536)"), "id")
    found = ids.withColumn("bucket", F.bitmap_bucket_number("id")).join(marked, "bucket", "left").filter(has_bit("bits", "id"))
    assert {r[0] for r in found.select("id").collect()} == {i for i in range(1, 100_000) if i % 3 == 1 or i in (32768, 32769, 65536)}
    assert marked.count() == 4
