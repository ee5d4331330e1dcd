"""Robots (R1-R3) against the stdlib robots parser, sitemaps (R4-R7) and the fetch log."""

import urllib.robotparser

from sitefold.operators.fetchlog import fetch_outcomes
from sitefold.operators.robots import robots_decisions, robots_rules, robots_sitemaps
from sitefold.operators.sitemaps import sitemap_urls, site_seeds

AGENT = "sitefold/1.0"

TEXTS = {
    "own-after": "User-agent: *\nDisallow: /\n\nUser-agent: sitefold\nDisallow: /private/\n",
    "own-before": "User-agent: sitefold\nDisallow: /a/\n\nUser-agent: *\nDisallow: /\n",
    "two-stars": "User-agent: *\nDisallow: /x/\n\nUser-agent: *\nDisallow: /\n",
    "allow-first": "User-agent: *\nAllow: /en/\nDisallow: /en\nDisallow: /es/\n",
    "empty-disallow": "User-agent: *\nDisallow:\n",
    "star-path": "User-agent: *\nDisallow: *\n",
    "comment": "# hello\nUser-agent: * # all\nDisallow: /c/ # secret\n",
    "blank-after-agent": "User-agent: sitefold\n\nUser-agent: *\nDisallow: /b/\n",
    "substring-agent": "User-agent: fold\nDisallow: /s/\n",
    "encoded": "User-agent: *\nDisallow: /%7Euser/\nDisallow: /a%20b\n",
    "crawl-delay": "User-agent: sitefold\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n",
    "no-group": "Disallow: /x\nSitemap: https://h/s1.xml\n",
}
PATHS = ["/", "/private/x", "/a/1", "/x/1", "/en/1", "/en", "/es/1", "/c/d", "/b/1", "/s/1", "/~user/p", "/a b",
         "/%2A", "/q?x=1", "/fr/"]


def test_decisions_match_stdlib(spark):
    robots = spark.createDataFrame([(site, 200, text) for site, text in TEXTS.items()], "site string, status int, text string")
    rules = robots_rules(robots)
    urls = spark.createDataFrame([(site, "https://h" + p) for site in TEXTS for p in PATHS], "site string, url string")
    got = {(r["site"], r["url"]): r["allowed"] for r in robots_decisions(urls, rules, AGENT).collect()}
    for site, text in TEXTS.items():
        rp = urllib.robotparser.RobotFileParser()
        rp.parse(text.splitlines())
        for p in PATHS:
            assert got[(site, "https://h" + p)] == rp.can_fetch(AGENT, "https://h" + p), (site, p)


def test_no_robots_allows_everything(spark):
    robots = spark.createDataFrame([("h", 404, None)], "site string, status int, text string")
    urls = spark.createDataFrame([("h", "https://h/x")], "site string, url string")
    assert robots_decisions(urls, robots_rules(robots), AGENT).collect()[0]["allowed"] is True


def test_sitemap_directives(spark):
    text = "User-agent: *\n  SITEMAP: https://h/a.xml \nsitemap:\nDisallow: /\nSitemap: https://h/b.xml\n"
    robots = spark.createDataFrame([("h", 200, text)], "site string, status int, text string")
    got = [r["sitemap_url"] for r in robots_sitemaps(robots).orderBy("pos").collect()]
    assert got == ["https://h/a.xml", "https://h/b.xml"]


def _doc(kind, locs):
    inner = "".join(f"<{'sitemap' if kind == 'index' else 'url'}><loc>{u}</loc></{'sitemap' if kind == 'index' else 'url'}>" for u in locs)
    root = "sitemapindex" if kind == "index" else "urlset"
    return f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{inner}</{root}>'


def test_sitemap_expansion_depth_first(spark):
    docs = [
        ("https://h/i0.xml", 200, _doc("index", ["https://h/i1.xml", "https://h/u1.xml"])),
        ("https://h/i1.xml", 200, _doc("index", ["https://h/i2.xml"])),
        ("https://h/i2.xml", 200, _doc("index", ["https://h/i3.xml", "https://h/u3.xml"])),
        ("https://h/i3.xml", 200, _doc("index", ["https://h/i4.xml"])),
        ("https://h/i4.xml", 200, _doc("urlset", ["https://h/too-deep"])),  # nesting level 4: ignored
        ("https://h/u3.xml", 200, _doc("urlset", ["https://h/deep"])),
        ("https://h/u1.xml", 200, _doc("urlset", ["https://h/a", " https://h/b ", "https://h/c"])),
        ("https://h/bad.xml", 200, "<urlset><url><loc>https://h/x</loc>"),
        ("https://h/gone.xml", 404, _doc("urlset", ["https://h/y"])),
        ("https://h/pre.xml", 200, '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://h/p</s:loc></s:url></s:urlset>'),
    ]
    docs_df = spark.createDataFrame(docs, "sitemap_url string, status int, xml string")
    directives = spark.createDataFrame([("h", 0, "https://h/bad.xml"), ("h", 1, "https://h/i0.xml"), ("h", 2, "https://h/gone.xml"),
                                        ("h", 3, "https://h/pre.xml")], "site string, pos int, sitemap_url string")
    def limit(n):
        return spark.createDataFrame([("h", n)], "site string, max_pages int")

    got = [r["url"] for r in sitemap_urls(directives, docs_df, limit(None)).orderBy("seq").collect()]
    assert got == ["https://h/deep", "https://h/a", "https://h/b", "https://h/c", "https://h/p"]
    limited = [r["url"] for r in sitemap_urls(directives, docs_df, limit(3)).orderBy("seq").collect()]
    assert limited == ["https://h/deep", "https://h/a", "https://h/b"]

    jobs = spark.createDataFrame([("h", "https://h/b/", 3), ("h2", "https://h2/Start/", 5)], "site string, root_url string, max_pages int")
    seeds = {(r["site"], r["pos"]): (r["url"], r["sitemap_seeded"]) for r in site_seeds(jobs, directives, docs_df).collect()}
    # the root normalizes like a seed ('/b/' ~ ' https://h/b ' trimmed) so it is not prepended
    assert [seeds[("h", i)][0] for i in range(3)] == ["https://h/deep", "https://h/a", "https://h/b"]
    assert seeds[("h2", 0)] == ("https://h2/Start", False)
    # no limit, and a root that no sitemap lists goes first
    jobs = spark.createDataFrame([("h", "https://h/Root", None)], "site string, root_url string, max_pages int")
    rows = site_seeds(jobs, directives, docs_df).orderBy("pos").collect()
    assert [(r["pos"], r["url"]) for r in rows] == list(enumerate(["https://h/Root", *got]))


ATTEMPTS = [
    # url, attempt, status, content_type, retry_after, error_kind, error_text, body
    ("ok", 0, 200, "text/html; charset=utf-8", None, None, None, "<p>"),
    ("pdf", 0, 200, "application/pdf", None, None, None, None),
    ("noct", 0, 200, None, None, None, None, None),
    ("404", 0, 404, None, None, None, None, None),
    ("429n", 0, 429, None, "2", None, None, None), ("429n", 1, 429, None, "3", None, None, None), ("429n", 2, 429, None, "1", None, None, None),
    ("429d", 0, 429, None, None, None, None, None), ("429d", 1, 200, "text/html", None, None, None, "x"),
    ("429x", 0, 429, None, "Wed, 21 Oct 2015 07:28:00 GMT", None, None, None),
    ("503ok", 0, 503, None, None, None, None, None), ("503ok", 1, 200, "text/html", None, None, None, "y"),
    ("to", 0, None, None, None, "timeout", "t", None), ("to", 1, None, None, None, "timeout", "t", None), ("to", 2, None, None, None, "timeout", "t", None),
    ("204", 0, 204, None, None, None, None, None), ("204", 1, 204, None, None, None, None, None), ("204", 2, 204, None, None, None, None, None),
    ("exc", 0, None, None, None, "other", "boom", None),
]


def test_fetch_outcomes(spark):
    df = spark.createDataFrame(ATTEMPTS, "norm_url string, attempt int, status int, content_type string, retry_after string, "
                                         "error_kind string, error_text string, body string")
    got = {r["norm_url"]: (r["ok"], r["error"], r["attempts_used"], r["body"])
           for r in fetch_outcomes(df).collect()}
    assert got["ok"] == (True, None, 1, "<p>")
    assert got["pdf"] == (False, "non-HTML content-type: application/pdf", 1, None)
    assert got["noct"] == (False, "non-HTML content-type: ", 1, None)
    assert got["404"] == (False, "HTTP 404", 1, None)
    assert got["429n"] == (False, "HTTP 429 (rate limited)", 3, None)
    assert got["429d"] == (True, None, 2, "x")
    assert got["429x"] == (False, "could not convert string to float: 'Wed, 21 Oct 2015 07:28:00 GMT'", 1, None)
    assert got["503ok"] == (True, None, 2, "y")
    assert got["to"] == (False, "timeout after 3 attempt(s)", 3, None)
    assert got["204"] == (False, "HTTP 204", 3, None)
    assert got["exc"] == (False, "boom", 1, None)


def test_random_robots_match_stdlib(spark):
    import random

    rng = random.Random(21)
    lines = ["User-agent: *", "User-agent: sitefold", "User-agent: other", "User-agent: FOLD", "user-agent:", "",
             "Disallow: /a", "Disallow: /a/", "Disallow:", "Allow: /a/b", "Allow: /", "Disallow: /%61x", "Disallow: /b?x",
             "Crawl-delay: 3", "Request-rate: 1/5", "# comment", "Disallow: /c # tail", "Sitemap: https://h/s.xml", "junk line",
             "DISALLOW: /d", "Disallow: *"]
    paths = ["/", "/a", "/a/", "/a/b", "/ax", "/b?x=1", "/b", "/c", "/d/e", "/%2A", "/q"]
    texts = {f"s{i}": "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for i in range(60)}
    robots = spark.createDataFrame([(s, 200, t) for s, t in texts.items()], "site string, status int, text string")
    urls = spark.createDataFrame([(s, "https://h" + p) for s in texts for p in paths], "site string, url string")
    got = {(r["site"], r["url"]): r["allowed"] for r in robots_decisions(urls, robots_rules(robots), AGENT).collect()}
    for s, text in texts.items():
        rp = urllib.robotparser.RobotFileParser()
        rp.parse(text.splitlines())
        for p in paths:
            assert got[(s, "https://h" + p)] == rp.can_fetch(AGENT, "https://h" + p), (text, p)
