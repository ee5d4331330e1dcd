"""The live queue's counters (C12, C13) against one worker that takes an item at a time."""

import collections
import random

import pytest

from sitefold.operators.crawl import crawl_run, crawl_summary, live_counters, queue_timeline

OUTSIDE = "https://other.com/x"


def work(seeds, graph, bad, max_pages, max_depth, seeded):
    """(per crawled page: page, crawled, put, queue length, known or None), last queue length, known."""
    queue = collections.deque((u, 0) for u in seeds)
    visited, crawled, size, known, steps = set(), 0, 0, len(seeds), []
    while queue:
        url, depth = queue.popleft()
        if url in visited or crawled >= max_pages:
            continue
        visited.add(url)
        if url.endswith(".pdf") or url in bad or url not in graph:
            continue
        crawled, put, now = crawled + 1, 0, None
        if not seeded and depth < max_depth:
            for link in graph[url]:
                if link not in visited and link != OUTSIDE:
                    queue.append((link, depth + 1))
                    put, now = put + 1, crawled + len(queue)
        size, known = len(queue), now or known
        steps.append((url, crawled, put, size, now))
    return steps, size, known


def random_site(rng, site):
    n = rng.randint(1, 25)
    urls = [f"https://{site}/" if i == 0 else f"https://{site}/p{i}" for i in range(n)]
    more = [*urls, OUTSIDE, f"https://{site}/f.pdf", f"https://{site}/gone"]
    graph = {u: [rng.choice(more) for _ in range(rng.randint(0, 6))] for u in urls}
    bad = {u for u in urls[1:] if rng.random() < 0.15}
    if rng.random() < 0.1:
        bad.add(urls[0])
    seeded = rng.random() < 0.25
    return urls[:1] + rng.sample(urls[1:], rng.randint(0, n - 1)) if seeded else urls[:1], graph, bad, seeded


@pytest.mark.parametrize(("max_pages", "max_depth"), [(50, 4), (6, 5)])
def test_counters_of_random_graphs(spark, max_pages, max_depth):
    rng = random.Random(max_pages)
    sites = {f"s{i}.com": random_site(rng, f"s{i}.com") for i in range(30)}
    jobs = spark.createDataFrame([(s, f"https://{s}/", max_pages, max_depth) for s in sites], "site string, root_url string, max_pages int, max_depth int")
    seeds = spark.createDataFrame([(s, i, u, 0, x[3]) for s, x in sites.items() for i, u in enumerate(x[0])],
                                  "site string, pos int, url string, depth int, sitemap_seeded boolean")
    edges = spark.createDataFrame([(s, u, i, d) for s, x in sites.items() for u, dsts in x[1].items() for i, d in enumerate(dsts)],
                                  "site string, src_norm string, pos int, dst_url string")
    outcomes = spark.createDataFrame([(u, u not in x[2], "HTTP 500" if u in x[2] else None) for x in sites.values() for u in x[1]],
                                     "norm_url string, ok boolean, error string")
    run = crawl_run(jobs, seeds, edges, outcomes, None, "agent")
    want = {s: work(x[0], x[1], x[2], max_pages, max_depth, x[3]) for s, x in sites.items()}
    urls = {(r["site"], r["page_ord"]): r["url"] for r in run.result.collect()}
    steps = collections.defaultdict(list)
    for r in sorted(queue_timeline(run, seeds).collect(), key=lambda r: (r["site"], r["page_ord"])):
        steps[r["site"]].append((urls[r["site"], r["page_ord"]], *tuple(r)[2:]))
    assert {s: steps[s] for s in sites} == {s: w[0] for s, w in want.items()}
    counters = live_counters(run, seeds)
    assert {r["site"]: (r["queue_size"], r["total_known"]) for r in counters.collect()} == {s: w[1:] for s, w in want.items()}
    summary = crawl_summary(jobs, seeds, run.result, run.levels, counters=counters).collect()
    assert {r["site"]: (r["queue_size"], r["total_known"]) for r in summary} == {s: w[1:] for s, w in want.items()}
