"""HTML extraction (E0-E7): documents written from the rules, and random and real pages whose single
facts (first title, first h1, metas, hrefs) are read off a stdlib tree (tests/reference_html.py)."""

import random

import pytest
from pyspark.sql import functions as F

from sitefold.functions.html import anchor_hrefs, clean_html
from sitefold.operators.pages import page_links, page_meta
from tests.reference_html import build, first, text_of


def _meta(spark, docs):
    df = spark.createDataFrame([(i, "https://tea.test/start", d) for i, d in enumerate(docs)], "page_id long, url string, html string")
    return page_meta(df).orderBy("page_ord").collect()


def _hrefs(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, html string")
    return [r[0] for r in df.orderBy("i").select(anchor_hrefs(clean_html(F.col("html")))).collect()]


# (page, title, h1, description)
RULES = [
    ("<title>Sencha &ndash; tea</title><meta name=description content=' steamed  '><h1>Green</h1><p>unused</p>", "Sencha – tea", "Green", "steamed"),
    ("<h1>Green</h1><div><p> first &amp; <i>only</i> </p></div><p>second</p>", None, "Green", "first &only"),
    ("<title></title><h1>x</h1><div>no paragraph</div>", "", "x", None), ("<p>before</p><h1>late</h1>", None, "late", None),
    ("<p>no heading, no fallback</p>", None, None, None), ("<h1>a</h1><p></p><p>b</p>", None, "a", None),
    ("<META CONTENT='upside down' NAME='Description'>", None, None, "upside down"),
    ("<meta name=description content=''><meta name=description content=late><h1>h</h1><p>para</p>", None, "h", "para"),
    ('<meta content="a > b" name="description">', None, None, "a > b"), ('<meta name="description" content="1 < 2">', None, None, "1 < 2"),
    ('<meta content="set name=description here" name="keywords"><meta name="description" content="right">', None, None, "right"),
    ("<meta name=keywords name=description content=twice>", None, None, "twice"),
    ("<h1>&#0000000065;&#x00000042;&#99999999;</h1>", None, "AB�", None), ("<h1>one <!-- <p>x</p> -->two</h1>", None, "onetwo", None),
    ('<script data-x="a>b">var p="<p>no</p>"</script><h1>t</h1><p class="x>y">yes</p>', None, "t", "yes"),
    ("<h1 title=it's>quote</h1><p>don't</p>", None, "quote", "don't"), ("<h1>3 < 4 <5</h1>", None, "3 < 4 <5", None),
    ("<title>a</title><title>b</title><h1>c</h1><h1>d</h1>", "a", "c", None),
]


def test_rules(spark):
    for (doc, *want), r in zip(RULES, _meta(spark, [x[0] for x in RULES]), strict=True):
        assert [r["title"], r["h1"], r["description"]] == want, doc
        assert r["has_description"] == (want[2] is not None)


@pytest.mark.parametrize("pad", [198, 199, 200, 205])
def test_paragraph_fallback_is_200_code_points(spark, pad):
    text = "t" * pad + "\U0001f375tail"
    assert _meta(spark, [f"<h1>h</h1><p>{text}</p>"])[0]["description"] == text[:200]


HREFS = [
    ('<a title="x>y" href="/z">', ["/z"]), ('<a data-x="go href=/bad" href="/good">', ["/good"]), ("<a HREF = '/q'>", ["/q"]), ("<a href>", [""]),
    ("<a href=/u/>", ["/u/"]), ("<a name=n>", []), ("<abbr href=/no><area href=/no>", []), ('<a href="a&amp;b&copy=1">', ["a&b©=1"]),
    ("<a href=/1 href=/2>", ["/2"]), ("<!-- <a href=/c> --><a\nhref='/d'\n>", ["/d"]), ('<b title="<a href=/in>">', []), ('<a x="1"href="/tight">', ["/tight"]),
    ('<a href="/unclosed>text<a href=/next>', ['"/unclosed', "/next"]), ("<a " + "x='=' " * 3000 + "href=/far>", ["/far"]),
    ("<a title='" + "y" * 200_000 + "' href=/long>", ["/long"]),
]


def test_hrefs(spark):
    for (doc, want), got in zip(HREFS, _hrefs(spark, [d for d, _ in HREFS]), strict=True):
        assert got == want, doc[:80]


def test_links_are_filtered_resolved_and_cut(spark):
    kept = {"/leaf": "https://tea.test/leaf", "cup?a=1&amp;b=2#x": "https://tea.test/cup?a=1&b=2", "//pot.test/p": "https://pot.test/p",
            " ../up ": "https://tea.test/up", "https://Pot.test/Q#f": "https://Pot.test/Q"}
    dropped = ["", "#top", "mailto:a@b.c", "javascript:void(0)", "/scan.PDF", "ftp://tea.test/x", "tel:1"]
    hrefs = [x for pair in zip(kept, dropped, strict=False) for x in pair] + dropped[len(kept):]
    doc = "".join(f'<p><a href="{h}">l</a></p>' for h in hrefs)
    df = spark.createDataFrame([(1, "https://tea.test/start", doc)], "page_id long, url string, html string")
    assert [r["url"] for r in page_links(df).orderBy("pos").collect()] == list(kept.values())


def _facts(doc):
    """First title, first h1, the first meta named description and the hrefs, off the stdlib tree."""
    tree = build(doc)
    title, h1 = first(tree, "title"), first(tree, "h1")
    meta = next((e for e in tree if e.name == "meta" and e.attrs.get("name", "").lower() == "description"), None)
    return (None if title is None else text_of(title), None if h1 is None else text_of(h1), meta,
            [e.attrs["href"] for e in tree if e.name == "a" and "href" in e.attrs])


def _check(spark, docs):
    for doc, r, hrefs in zip(docs, _meta(spark, docs), _hrefs(spark, docs), strict=True):
        title, h1, meta, want = _facts(doc)
        assert (r["title"], r["h1"], hrefs) == (title, h1, want), doc
        if meta is not None and meta.attrs.get("content", "").strip():
            assert r["description"] == meta.attrs["content"].strip(), doc
        elif h1 is None:
            assert r["description"] is None, doc


def test_random_documents(spark):
    rng = random.Random(5)
    tags = ["p", "b", "div", "h1", "title", "article", "span", "a", "H1"]
    values = ['"plain"', "'a > b'", '"name=description"', "bare", '"x href=/bad"', "'&quot;&amp;'", '"<b>"', "''"]
    texts = [" text ", "Fish &amp; chips", "&copy;", "&#0065;", "a < b", "\n", "&nbsp;", "é", "<!-- c </p> -->", "<script>var t='</p>';</script>", "<br>", "<br/>"]

    def piece():
        kind = rng.random()
        if kind < 0.35:
            return rng.choice(texts)
        if kind < 0.6:
            return f"</{rng.choice(tags)}>"
        if kind < 0.7:
            return f"<meta name={rng.choice(['description', 'Description', 'keywords'])} content={rng.choice(values)}>"
        attributes = "".join(f" {rng.choice(['href', 'title', 'data-x', 'class'])}={rng.choice(values)}" for _ in range(rng.randrange(3)))
        return f"<{rng.choice(tags)}{attributes}>"

    _check(spark, ["".join(piece() for _ in range(rng.randrange(3, 40))) for _ in range(300)])


def test_real_pages(spark):
    _check(spark, [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()])
