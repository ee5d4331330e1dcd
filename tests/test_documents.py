"""Titles and site documents (T1-T6, G0-G9) on sites built forwards: sections, titles and suffix are
drawn first and the pages derived from them, so the expected document is known by construction."""

import random

import pytest

from sitefold.operators import documents as D
from sitefold.operators.titles import site_suffixes

META = ("site string, page_ord long, url string, norm_url string, path_prefix string, title string, "
        "description string, h1 string, depth int, has_description boolean")


def _meta(spark, pages):
    """``pages``: (site, url, norm_url, path_prefix, title, description, h1) in crawl order."""
    rows = [(s, i, u, n, p, t, d, h, 1, d is not None) for i, (s, u, n, p, t, d, h) in enumerate(pages)]
    return spark.createDataFrame(rows, META)


def _texts(spark, pages, sites):
    docs = D.site_documents(_meta(spark, pages), spark.createDataFrame(sites, "site string, root_url string")).collect()
    return {r["site"]: r["llms_txt"] for r in docs}


def _page(path, prefix, title, desc=None, h1=None, site="tea.test"):
    return site, f"https://{site}{path}", f"https://{site}{path}", prefix, title, desc, h1


def _tea(spark, pages):
    return _texts(spark, pages, [("tea.test", "https://tea.test/")])["tea.test"]


def test_whole_document(spark):
    doc = _tea(spark, [
        _page("/", "", "Leaves ~ · Tea House", "All about leaves."),
        _page("/green/sencha", "green", "Sencha · Tea House", "Steamed."),
        _page("/green/gyokuro", "green", "Gyokuro · Tea House", "Shaded."),
        _page("/black/assam", "black", "Assam · Tea House"),
    ])
    assert doc == ("# Leaves ~\n\n> All about leaves.\n\n## Green\n\n- [Gyokuro](https://tea.test/green/gyokuro): Shaded.\n"
                   "- [Sencha](https://tea.test/green/sencha): Steamed.\n\n## Optional\n\n- [Assam](https://tea.test/black/assam)\n")


def test_site_without_pages(spark):
    assert _texts(spark, [], [("none.test", "https://none.test/")]) == {"none.test": "# none.test\n\n> No pages were successfully crawled.\n"}


def test_first_page_stands_in_for_a_missing_root(spark):
    doc = _tea(spark, [_page("/m/1", "m", "Matcha", "powder"), _page("/n/1", "n", "Nilgiri", "hill")])
    assert doc == "# Matcha\n\n> powder\n\n## M\n\n- [Matcha](https://tea.test/m/1): powder\n\n## N\n\n- [Nilgiri](https://tea.test/n/1): hill\n"


def test_section_headings_and_their_order(spark):
    sections = {"": "Pages", "loose-leaf": "Loose Leaf", "loose_leaf": "Loose Leaf", "TINS": "Tins", "öl": "Öl", "optional": "Optional", "z--z": "Z Z"}
    pages = [_page("/", "", "Top")]
    pages += [_page(f"/{p}/{i}?q" if p else f"/?{i}", p, f"t{i}", "d") for i, p in enumerate(sections)]
    pages.append(_page("/u", "u", "undescribed"))
    heads = [line[3:] for line in _tea(spark, pages).split("\n") if line.startswith("## ")]
    assert heads == ["Pages", "Loose Leaf", "Optional", "Tins", "Z Z", "Öl", "Optional"]


def test_every_spelling_of_the_root_is_left_out(spark):
    root = "https://tea.test/"
    pages = [("tea.test", u, root, "", t, d, None) for u, t, d in (("https://tea.test", "One", "first"), ("https://TEA.test/", "Two", "second"))]
    pages.append(_page("/x", "x", "X", "dx"))
    assert _tea(spark, pages) == "# One\n\n> first\n\n## X\n\n- [X](https://tea.test/x): dx\n"


@pytest.mark.parametrize(("titles", "suffix"), [
    (["Oolong – Tips", "White – Tips", "Yellow – Tips"], " – Tips"), (["Oolong", "White – Tips", "Yellow"], ""), (["Alone — Tips"], ""),
    (["a — S", "b — S", "c", "d"], ""), (["a • S", "b • S", "c • S", "d • T", "e"], " • S"),
    (["a - M | N", "b - M | N", "c"], " | N"), (["a | M - N", "b | M - N", "c"], " | M - N"), ([" | S", " | S"], ""),
])
def test_shared_suffix(spark, titles, suffix):
    rows = site_suffixes(_meta(spark, [_page(f"/{i}", str(i), t) for i, t in enumerate(titles)])).collect()
    assert [r["suffix"] for r in rows] == [suffix]


def test_title_that_is_only_the_suffix(spark):
    doc = _tea(spark, [_page("/", "", "x | S", None, "Heading"), _page("/a", "a", "  | S", "d", "h"), _page("/b", "b", "B | S", "d")])
    assert "# x\n" in doc and "- [https://tea.test/a](https://tea.test/a): d" in doc


def _forward_site(rng, site):
    """(pages in random order, expected document) of a random site."""
    suffix = rng.choice(["", " | " + site, " - Notes"])
    sections = rng.sample([("", "Pages"), ("how-to", "How To"), ("api", "Api"), ("big_cats", "Big Cats"), ("zoo", "Zoo")], rng.randint(1, 5))
    title, desc = f"Start {site}", rng.choice([None, "About it"])
    pages = [(site, f"https://{site}/", f"https://{site}/", "", title + suffix, desc, None)]
    out = f"# {title}\n\n" + (f"> {desc}\n\n" if desc else "")
    body, undescribed = [], []
    for prefix, name in sorted(sections, key=lambda x: (x[1] != "Pages", x[1])):
        lines = []
        for i in sorted(rng.sample(range(100, 1000), rng.randint(1, 6))):
            url = f"https://{site}/{prefix}/{i}" if prefix else f"https://{site}/?p={i}"
            if rng.random() < 0.2:
                undescribed.append((f"T{i}", f"- [T{i}]({url})"))
                pages.append((site, url, url, prefix, f"T{i}{suffix}", None, None))
            else:
                lines.append(f"- [T{i}]({url}): words {i}")
                pages.append((site, url, url, prefix, f"T{i}{suffix}", f"words {i}", "unused"))
        if lines:
            body.append(f"## {name}\n\n" + "\n".join(lines) + "\n")
    order = pages[1:]
    rng.shuffle(order)
    if undescribed:
        place = {f"- [{p[4].removesuffix(suffix)}]({p[1]})": i for i, p in enumerate(order)}
        body.append("## Optional\n\n" + "\n".join(x[1] for x in sorted(undescribed, key=lambda x: (x[0], place[x[1]]))) + "\n")
    return [pages[0], *order], (out + "\n".join(body)).rstrip() + "\n"


def test_random_sites(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_LINES", 3)
    rng = random.Random(31)
    built = {f"s{k}.test": _forward_site(rng, f"s{k}.test") for k in range(30)}
    pages = [p for own, _ in built.values() for p in own]
    got = _texts(spark, pages, [(s, f"https://{s}/") for s in built])
    for site, (_, want) in built.items():
        assert got[site] == want
    meta = _meta(spark, pages)
    parts = D.document_parts(meta, spark.createDataFrame([(s, f"https://{s}/") for s in built], "site string, root_url string")).collect()
    assert all(sum(line.startswith("- [") for line in r["text"].split("\n")) <= 3 for r in parts)
    sections = D.site_sections(meta).collect()
    assert len({(r["site"], r["page_ord"]) for r in sections}) == len(sections) == len(pages) - len(built)
