import random
import time

import pytest

from sitefold.llm import html_extract as H
from tests.llm.cases import prose

FRAME = ('<!DOCTYPE html><html><head><title>T &amp; T</title><style>p{{}}</style><script>var t="</p><article>x";</script></head><body>'
         '<header class="top">Site name</header><nav><ul><li><a href="/a">{nav}</a></li><li>B</li></ul></nav><!-- <article>no</article> -->'
         '<div class="ad">{ad}</div><div id="cookie-notice">We use cookies</div><main>{main}</main><aside>side</aside>'
         '<form><label>Mail</label><input name=q></form><div class="comments"><p>first!</p></div><footer>&copy; us</footer></body></html>')


def _article(title, paragraphs):
    return f"<article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"


def test_article_without_furniture():
    page = FRAME.format(nav="Home", ad="Buy!", main=_article("A &lt; B", ["One\n  two<br>three", "<b>Bold</b>word &eacute;", " "]))
    assert H.extract([page]) == ["A < B\n\nOne two three\n\nBoldword é"]


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("<p>", ""), ("plain &amp; text", "plain & text"), ("<article><p><b>a<br><p>b<div>c</div>d</article>e", "a\n\nb\n\nc\n\nd"),
    ('<article><p title="x > y">a</p><p data-x=\'"\'>b</p></article>', "a\n\nb"), ("<article><ul><li>a<li>b</ul></article>", "a\n\nb"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"), ("<article>a<script>x</script>b<style>y</article>", "ab"),
    ("<article><p>a</article></p></div><p>x", "a"), ("<article><header><h1>t</h1></header><p>a</p><footer>f</footer></article>", "t\n\na"),
    ('<article><p>a</p><div class="share-buttons">s</div><section class="comment-list"><p>c</p></section></article>', "a"),
    ('<article><p class="download">kept</p><p>a <a href="x">b</a> c</p></article>', "kept\n\na b c"), ("<article><p>a < b & c &am;</p></article>", "a < b & c &am;"),
    ('<article>a <unclosed "quote>b</article>', "a b"),
])
def test_small_pages(html, text):
    assert H.extract([html]) == [text]


@pytest.mark.parametrize("page", [
    '<body><div class="layout has-sidebar"><article>{t}</article></div></body>', '<body><div id="page-with-menu"><p>{t}</p></div></body>',
    '<body><div class="social-policy"><main>{t}</main></div></body>', '<form id="f"><div>{t}</div></form>',
    '<div data-class="ad" title="class=ad" data-id="menu">{t}</div>', "<html><head><title>x</title><meta charset=a><body><p>{t}</p>",
    "<head><link rel=a><p>{t}", "<head><title>x</title>{t}", '<article class="post comments-open">{t}</article>',
    '<div><ul><li><a href="/a">{t}</a></li><li><a href="/b">{t}</a></li></ul><p>{t}</p></div>',
])
def test_wrappers_are_not_furniture(page):
    assert H.extract([page.format(t=prose(1, 30))]) == [prose(1, 30)]


def test_groups_of_links():
    page = ('<div>{0}<div><ul><li><a>One</a><ul><li><a>Two</a></ul></ul></div><div><p><a>Three</a></p></div>'
            '<div><a>Four, a long line of linked text</a><p>kept</p></div></div>')
    assert H.extract([page.format("top")]) == ["top\n\nFour, a long line of linked text\n\nkept"]


def test_furniture_beside_an_article_stays_out():
    page = f'<div class="related"><article>{prose(2, 9)}</article></div><article>{prose(1, 30)}<div class="comments">{prose(3, 90)}</div></article>'
    assert H.extract([page]) == [prose(1, 30)]


def test_slots_without_article():
    """No article element: what changes from page to page is content, what stays is template."""
    pages = [f'<body><div><b>Fixed slogan</b></div><div><p>{prose(i, 30)}</p><p>{prose(i + 50, 20)}</p></div><div>All rights reserved</div></body>' for i in range(6)]
    for i, text in enumerate(H.extract(pages)):
        assert text == f"{prose(i, 30)}\n\n{prose(i + 50, 20)}"


def test_copies_of_an_article_stay():
    page = FRAME.format(nav="Home", ad="Buy!", main=_article("Same", ["text"]))
    assert H.extract([page] * 5) == ["Same\n\ntext"] * 5


def _plain(i, extra=""):
    return f"<body><div>Fixed slogan</div><div><p>{prose(i, 30)}</p></div><div>All rights reserved</div>{extra}</body>"


def test_copies_without_article():
    assert H.extract([_plain(1)] * 4) == [f"Fixed slogan\n\n{prose(1, 30)}\n\nAll rights reserved"] * 4
    pages = ["", *[_plain(1)] * 40, *[_plain(i) for i in range(2, 5)]]
    assert H.extract(pages) == ["", *[prose(1, 30)] * 40, *[prose(i, 30) for i in range(2, 5)]]


def test_a_real_text_where_others_have_template_stays():
    pages = [_plain(i) for i in range(9)] + [_plain(9).replace("Fixed slogan", "Something else")]
    assert H.extract(pages)[9] == f"Something else\n\n{prose(9, 30)}"


def test_long_lists_align(monkeypatch):
    monkeypatch.setattr(H, "CELLS", 40)

    def rows(texts):
        return H.Page("<body>" + "".join(f"<p>{t}</p>" for t in texts)).tree
    a, b = [f"x{i}" for i in range(30)], [f"x{i}" for i in range(30) if i % 7]
    pairs = [(x.children[0], y.children[0]) for x, y in H.align(rows(a), rows(b)) if x.tag == "p"]
    assert len(pairs) == len(b) and all(x == y for x, y in pairs)
    H.extract(["<div><b>" * 3000 + "x", "<div><b>" * 2999 + "<i>y"])


def test_spark_wrapper_is_one_per_host(spark):
    """Null, empty and repeated pages are no reference and no evidence, wherever they lie."""
    rows = [(None, "https://h.com/n", None), (0, "https://h.com/0", "")]
    rows += [(i, f"https://h.com/{i}", _plain(i if i > 60 else 1)) for i in range(1, 70)]
    rows += [(i, f"https://c.com/{i}", _plain(1)) for i in range(100, 103)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    assert got[None] == got[0] == ""
    assert all(got[i] == prose(i if i > 60 else 1, 30) for i in range(1, 70))
    assert {got[i] for i in range(100, 103)} == {f"Fixed slogan\n\n{prose(1, 30)}\n\nAll rights reserved"}


def _noticed(i, texts=1, notice="Read our terms before you <b>copy</b> this."):
    article = "".join(f"<p>{prose(100 * i + k, 25)}</p>" for k in range(texts))
    page = f"<body><div>Slogan</div><article><h1>T{i}</h1><div>{notice}</div>{article}<p>Written by <a>us</a></p></article></body>"
    return page, "\n\n".join([f"T{i}", *(prose(100 * i + k, 25) for k in range(texts))])


def test_template_inside_articles_goes(spark):
    cases = [_noticed(i, 1 + i % 4) for i in range(12)]
    assert H.extract([p for p, _ in cases]) == [t for _, t in cases]
    rows = [(i, f"https://h.com/{i}", p) for i, (p, _) in enumerate(cases)] + [(99, "https://other.com/", cases[0][0])]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [t for _, t in cases]
    assert got[99].startswith("T0\n\nRead our terms before you copy this.")


def test_copies_of_an_article_with_small_changes_stay():
    paragraphs = [prose(k, 25) for k in range(5)]
    pages = [_article("Same", [*paragraphs, f"edit {i}"]) for i in range(6)]
    assert H.extract(pages) == ["\n\n".join(["Same", *paragraphs, f"edit {i}"]) for i in range(6)]
    two = [_article(f"T{i}", [prose(i, 30), "a quoted line"]) for i in range(2)]
    assert all(t.endswith("a quoted line") for t in H.extract(two))


@pytest.mark.parametrize("element", ['p class="share-price"', 'section class="social-history"', 'div id="notice-of-meeting"',
                                     'p class="post comment-policy-text"', 'div class="has-ads"'])
def test_names_with_other_words_keep_their_text(element):
    page = f"<article><p>{prose(1, 9)}</p><{element}>real words</{element.split()[0]}></article>"
    assert H.extract([page]) == [f"{prose(1, 9)}\n\nreal words"]


@pytest.mark.parametrize("element", ['p class="big share-buttons"', 'section class="related_posts"', 'div id="cookie-notice-2"', 'div class="ad ad-slot"',
                                     'div id="comments-area"', 'div role="alert"'])
def test_names_of_furniture_only_go(element):
    page = f"<article><p>{prose(1, 9)}</p><{element}>other words</{element.split()[0]}></article>"
    assert H.extract([page]) == [prose(1, 9)]


def _in_spark(spark, pages):
    rows = [(i, f"https://h.com/{i}", p) for i, p in enumerate(pages)]
    return [r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_lines_that_vary_by_number_go_but_headings_and_reports_stay(spark):
    pages = [_article(f"This is the story number {i}", ["Please accept our policy 3%d." % i, prose(i, 30)]) for i in range(5)]
    texts = [f"This is the story number {i}\n\n{prose(i, 30)}" for i in range(5)]
    assert H.extract(pages) == texts and _in_spark(spark, pages) == texts
    reports = [_article(f"Day {i}", [f"The highest temperature of the day was {i} degrees.", f"It was dry for {i} of the hours."]) for i in range(5)]
    assert all("highest temperature of the day was" in t and "dry for" in t for t in H.extract(reports))


def test_copies_are_no_evidence_but_lose_template(spark):
    """One host with copies of an article with small changes and with other articles, a notice in each."""
    notice = "Read our terms before you copy this."
    paragraphs = [prose(k, 25) for k in range(5)]
    pages = [_article("Same", [notice, *paragraphs, f"edit {'abcdefghijklmnopqrst'[i]}"]) for i in range(20)]
    pages += [_article(f"T{i}", [notice, prose(50 + i, 60)]) for i in range(4)]
    texts = ["\n\n".join(["Same", *paragraphs, f"edit {'abcdefghijklmnopqrst'[i]}"]) for i in range(20)]
    texts += [f"T{i}\n\n{prose(50 + i, 60)}" for i in range(4)]
    assert H.extract(pages) == texts and _in_spark(spark, pages) == texts


def test_deep_pages_take_linear_time():
    for page in ("<div>" * 20_000 + "a", "<p><table>" + "<div>" * 20_000 + "a", '<form><div class="ad">' + "<div>" * 20_000 + "<article>a", "<ul>" + "<li>a<ul>" * 10_000):
        start = time.process_time()
        H.parse(page)
        assert time.process_time() - start < 2
    start = time.process_time()
    assert H.extract(["<div>" * 20_000 + "a", "<div>" * 20_000 + "b"]) == ["a", "b"]
    assert time.process_time() - start < 4


def _tree(rng, depth):
    n = H.Node(rng.choice("abc"))
    if depth:
        n.children = [_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return n


def _best(a, b):
    """Largest top-down matching by trying all ordered pairings."""
    if a.tag != b.tag:
        return 0

    def pair(x, y):
        if not x or not y:
            return 0
        return max(pair(x[1:], y), pair(x, y[1:]), _best(x[0], y[0]) + pair(x[1:], y[1:]) if x[0].tag == y[0].tag else 0)

    return 1 + pair(a.children, b.children)


@pytest.mark.parametrize("seed", range(8))
def test_alignment_is_a_largest_matching(seed):
    rng = random.Random(seed)
    a, b = _tree(rng, 3), _tree(rng, 3)
    a.tag = b.tag = "a"
    H._frame(a, set())
    H._frame(b, set())
    pairs = list(H.align(a, b))
    assert len(pairs) == _best(a, b) and all(x.tag == y.tag for x, y in pairs)


def test_spark_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 4)
    rows = [(i, f"https://h{0 if i % 3 else i}.com/{i}", FRAME.format(nav=str(i), ad=str(i), main=_article(f"T{i}", [prose(i, 20)]))) for i in range(40)]
    rows += [(100, None, "<article>x</article>"), (101, "https://h0.com/e", None), (102, "no url", ""), (None, "https://h0.com/n", "<article>n</article>"), rows[1]]
    pages = spark.createDataFrame([(*r, "extra", 3) for r in rows], "page_id long, url string, html string, text string, part int")
    out = H.main_text(pages).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    for i in range(40):
        assert got[i]["text"] == f"T{i}\n\n{prose(i, 20)}" and got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (100, 101, 102, None)] == ["x", "", "", "n"]
    assert H.main_text(pages.limit(0)).count() == 0
