"""URL functions (U1-U7, K3): URLs composed from known parts, so the result is known too, and the
stdlib's split and join on random URLs."""

import random
from urllib.parse import urljoin, urlparse

from sitefold.functions import urls as U


def _parts(spark, urls):
    return U.add_url_parts(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), "url", "u")


def _column(df, column):
    return [r[0] for r in df.withColumn("out", column).orderBy("i").select("out").collect()]


def _normal(spark, urls):
    return [r["out"] for r in U.add_normalized(_parts(spark, urls), "u", "out").orderBy("i").select("out").collect()]


# (as written, normal form): case of scheme and host, trailing slashes, fragment, empty query, params
WRITTEN = [
    ("HTTP://Tea.Test/Leaf/", "http://tea.test/Leaf"), ("https://tea.test", "https://tea.test/"), ("https://tea.test///", "https://tea.test/"),
    ("https://tea.test/a/b//#top", "https://tea.test/a/b"), ("https://tea.test?x=Y#z", "https://tea.test/?x=Y"), ("https://tea.test/cup?", "https://tea.test/cup"),
    ("https://tea.test/a/;v=1", "https://tea.test/a;v=1"), ("https://Me@TEA.test:81/q/", "https://me@tea.test:81/q"), ("https://tea.test/é ü/", "https://tea.test/é ü"),
    ("//Tea.test/x/", "//tea.test/x"), ("plain-word", "plain-word"), ("MAILTO:a@b.c", "mailto:a@b.c"),
]


def test_normal_forms(spark):
    got = _normal(spark, [w for w, _ in WRITTEN])
    assert got == [n for _, n in WRITTEN]
    assert _normal(spark, got) == got


def _composed(rng):
    """(url, normal form, first path segment, crawlable, site) from drawn parts."""
    scheme, spelt = rng.choice([("http", "http"), ("https", "HttpS"), ("https", "https"), ("ftp", "ftp")])
    host, spelt_host = rng.choice([("tea.test", "tea.test"), ("tea.test:8080", "Tea.TEST:8080"), ("www.tea.test", "WWW.tea.test")])
    segments = [rng.choice(["green", "Black", "pu-erh", "oo_long", "é", "1.0"]) for _ in range(rng.randrange(4))]
    leaf, fine = rng.choice([("", True), ("page.html", True), ("scan.PDF", False), ("cup.jpeg", False), ("list.tar.gz", False), ("a.pdf.html", True)])
    if leaf:
        segments.append(leaf)
    path = "".join("/" + x for x in segments)
    slashes = rng.choice(["", "", "/", "//"])
    query = rng.choice(["", "?a=1", "?next=/x.pdf"])
    url = f"{spelt}://{spelt_host}{path}{slashes}{query}{rng.choice(['', '#', '#part/2'])}"
    crawlable = scheme != "ftp" and (fine or bool(slashes))
    return url, f"{scheme}://{host}{path or '/'}{query}", segments[0] if segments else "", crawlable, host


def test_composed_urls(spark):
    rng = random.Random(3)
    made = [_composed(rng) for _ in range(600)]
    df = U.add_normalized(_parts(spark, [m[0] for m in made]), "u", "norm")
    rows = df.orderBy("i").select("url", "norm", U.path_prefix_of("u"), U.crawlable("u"), U.site_of("u")).collect()
    for m, r in zip(made, rows, strict=True):
        assert tuple(r) == m


def test_extensions_end_the_path(spark):
    urls = [f"https://tea.test/x{e.upper()}" for e in U.SKIP_EXTENSIONS] + [f"https://tea.test/x{e}/more" for e in U.SKIP_EXTENSIONS]
    assert _column(_parts(spark, urls), U.crawlable("u")) == [False] * len(U.SKIP_EXTENSIONS) + [True] * len(U.SKIP_EXTENSIONS)


def test_same_domain_is_the_whole_host(spark):
    rows = [("https://Leaf.test/a", "http://leaf.test", True), ("https://shop.leaf.test", "https://leaf.test", False),
            ("https://leaf.test:444/", "https://leaf.test/", False), ("https://notleaf.test/", "https://leaf.test/", False)]
    df = spark.createDataFrame(rows, "url string, base string, want boolean")
    df = U.add_url_parts(U.add_url_parts(df, "url", "a"), "base", "b")
    assert all(r["got"] == r["want"] for r in df.select("want", (U.site_of("a") == U.site_of("b")).alias("got")).collect())


RESOLVE = [
    ("https://a.com/x/y", "../z"), ("https://a.com/x/y", "?q=1"), ("https://a.com/x/y?p=1", ""), ("https://a.com", "../../z"),
    ("https://a.com/x/", "//b.com/q"), ("https://a.com/x/y", "tel:12"), ("https://a.com/x/y", "https:foo"),
    ("https://a.com/x/y", "./"), ("https://a.com/x/y", "a/./b/../c"), ("https://a.com/x/y", "/abs/p?q#f"),
    ("https://a.com/x/y", "#frag"), ("https://a.com/x/y;p", "z"), ("http://a.com/", "https://c.com/z/"),
    ("https://a.com/x/y/", ".."), ("https://a.com/x/y/", "../.."), ("https://a.com/a/b/c", "../../../../g"),
]


def test_resolve_matches_stdlib(spark):
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(RESOLVE)], "i int, base string, href string")
    got = [r[0] for r in U.add_resolved(df, "base", "href", "out").orderBy("i").select("out").collect()]
    assert got == [urljoin(b, h) for b, h in RESOLVE]


def test_hostname(spark):
    urls = ["https://User@WWW.Ex.com:8443/x", "http://[::1]:80/", "https://a.com"]
    assert _column(_parts(spark, urls), U.hostname_of("u")) == ["www.ex.com", "::1", "a.com"]


def _random_urls(n, seed):
    rng = random.Random(seed)
    schemes = ["http", "https", "HTTP", "ftp", "", "mailto", "Https"]
    hosts = ["a.com", "A.Com", "b.org:8080", "user@c.net", "[::1]:80", "", "x"]
    segs = ["", "a", "B", ".", "..", "x.pdf", "y.HTML", "é", "a b", "p;q", "%2F", "docs", "api-ref"]
    out = []
    for _ in range(n):
        scheme, host = rng.choice(schemes), rng.choice(hosts)
        path = "/".join(rng.choice(segs) for _ in range(rng.randrange(0, 4)))
        if rng.random() < 0.7:
            path = "/" + path
        if rng.random() < 0.3:
            path += "/" * rng.randrange(1, 3)
        query = rng.choice(["", "?", "?q=1", "?a=1&b=2", "?x#"])
        frag = rng.choice(["", "#", "#top", "#a/b"])
        pre = f"{scheme}:" if scheme else ""
        auth = f"//{host}" if host or rng.random() < 0.2 else ""
        out.append(pre + auth + path + query + frag)
    return out


def test_random_urls_split_like_the_stdlib(spark):
    urls = _random_urls(2000, 11)
    rows = _parts(spark, urls).orderBy("i").select("u_scheme", "u_netloc", "u_path", "u_params", "u_query", "u_fragment").collect()
    for url, r in zip(urls, rows, strict=True):
        p = urlparse(url)
        assert tuple(r) == (p.scheme, p.netloc, p.path, p.params, p.query, p.fragment), url


def test_random_resolve_matches_stdlib(spark):
    bases = [u for u in _random_urls(600, 12) if u.lower().startswith("http")]
    hrefs = _random_urls(len(bases), 13) + ["", "../x", "./", "?z", "//h.com/p", "tel:1", "https:rel"]
    pairs = [(b, hrefs[i % len(hrefs)]) for i, b in enumerate(bases)]
    df = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, base string, href string")
    got = [r[0] for r in U.add_resolved(df, "base", "href", "out").orderBy("i").select("out").collect()]
    for (b, h), g in zip(pairs, got):
        assert g == urljoin(b, h), (b, h)
