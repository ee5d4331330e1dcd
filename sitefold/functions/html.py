"""HTML extraction as native column expressions.

The page is cleaned (comments, script and style removed), cut into tag and text tokens with one
regex, and folded once with ``aggregate`` while keeping the open-element stack the way a
non-validating tree builder does: a start tag pushes, an end tag pops back to the most recent open
element of that name (an end tag with no open element is ignored), void and self-closed elements
never stay open.  In the same pass the fold gathers the text of the first ``<title>``, the first
``<h1>`` and the first ``<p>`` that starts after that ``<h1>``; each text node is entity-decoded,
stripped, and empty nodes dropped, nodes joined with no separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.text import decode_attr, decode_text, py_strip

# --- fixed values -----------------------------------------------------------------------------
# Elements that never hold content (the tree builder closes them at once).
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
]
# Description fallback length (characters).
PARAGRAPH_CHARS = 200
# ----------------------------------------------------------------------------------------------

# The inside of a tag up to its '>': a quoted value may hold '>'; quotes count only after '='.
# Possessive, so that the engine neither backtracks nor recurses per character.
INSIDE = "(?:[^>=]++|=\\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
# comments, and script / style elements with their raw content; replaced by a marker token so
# the text on both sides stays two nodes
CLEAN_RE = (f"(?is)<!--.*?(?:-->|$)|<script\\b{INSIDE}>.*?(?:</script[^>]*>|$)|<style\\b{INSIDE}>.*?(?:</style[^>]*>|$)")
MARKER = "<!>"
# a '<' that cannot open a tag is text; it is swapped for LT_HOLD before tokenizing so that text
# runs are one flat character class (a repeated alternation recurses per character in Java)
LONE_LT_RE = "<([^A-Za-z!/?]|$)"
LT_HOLD = "\u0001"
TOKEN_RE = f"<[A-Za-z!/?]{INSIDE}>|[^<]+"
TAG_NAME_RE = "^</?([A-Za-z][^\\t\\n\\r\\f />]*)"
# one attribute of a start tag: its name, and its value if it has one
ATTRIBUTE_RE = "[^\\s/>=][^\\s/>=]*+(?:\\s*+=\\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\\s>]*+))?+"


def attr_value(tag: Column, name: str) -> Column:
    """Value of attribute ``name`` of a start tag, entities decoded: '' without a value, null when
    absent, the last one when repeated.  The tag is split into its attributes in order, so a name
    inside another attribute's value is never met."""
    attributes = F.regexp_extract_all(F.regexp_replace(tag, "^<[A-Za-z][^\\s/>]*", ""), F.lit(ATTRIBUTE_RE), 0)
    mine = F.try_element_at(F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, "^([^\\s=]+)", 1)) == name), F.lit(-1))
    raw = F.regexp_extract(mine, "(?s)=\\s*(.*)$", 1)
    quoted = (F.length(raw) > 1) & ((raw.startswith('"') & raw.endswith('"')) | (raw.startswith("'") & raw.endswith("'")))
    value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(mine.isNotNull(), decode_attr(F.translate(value, LT_HOLD, "<")))


def clean_html(html: Column) -> Column:
    cleaned = F.regexp_replace(html, CLEAN_RE, MARKER)
    # twice: '<<<' has overlapping matches
    return F.regexp_replace(F.regexp_replace(cleaned, LONE_LT_RE, LT_HOLD + "$1"), LONE_LT_RE, LT_HOLD + "$1")


def raw_tokens(clean: Column) -> Column:
    """Tags and text runs of a cleaned page, in order."""
    return F.regexp_extract_all(clean, F.lit(TOKEN_RE), 0)


def tokens(raw: Column) -> Column:
    """array<struct<k:string, n:string, x:string>>: k = S (start), E (end) or T (text, as written)."""
    named = F.transform(raw, lambda t: F.struct(t.alias("t"), F.lower(F.regexp_extract(t, TAG_NAME_RE, 1)).alias("n")))

    def classify(tn: Column) -> Column:
        t, name = tn["t"], tn["n"]
        is_end = t.startswith("</")
        is_tag = t.rlike("^</?[A-Za-z]")
        is_start = is_tag & ~is_end
        kind = (
            F.when(is_end & is_tag, F.lit("E"))
            .when(is_start & (t.endswith("/>") | name.isin(VOID_ELEMENTS)), F.lit("V"))
            .when(is_start, F.lit("S"))
            .when(t.startswith("<!") | t.startswith("<?") | t.startswith("</"), F.lit("I"))
            .otherwise(F.lit("T"))
        )
        return F.struct(kind.alias("k"), name.alias("n"), F.when(kind == "T", t).otherwise(F.lit("")).alias("x"))

    return F.filter(F.transform(named, classify), lambda t: t["k"].isin("S", "E", "T"))


def _init_state() -> Column:
    zero = F.lit(0)
    return F.struct(
        F.array().cast("array<string>").alias("stk"),
        zero.alias("ts"), zero.alias("tl"), F.lit("").alias("tt"),
        zero.alias("hs"), zero.alias("hl"), F.lit("").alias("ht"),
        zero.alias("ps"), zero.alias("pl"), F.lit("").alias("pt"),
    )


def _step(a: Column, t: Column) -> Column:
    stk, n0 = a["stk"], F.size(a["stk"])
    k, name = t["k"], t["n"]
    # only the text of the three elements is decoded
    text = py_strip(decode_text(F.translate(t["x"], LT_HOLD, "<")))
    finished = (a["ts"] == 2) & (a["hs"] == 2) & (a["ps"] == 2)

    # start tag
    n_start = n0 + 1
    open_t = (a["ts"] == 0) & (name == "title")
    open_h = (a["hs"] == 0) & (name == "h1")
    open_p = (a["ps"] == 0) & (name == "p") & (a["hs"] > 0)
    on_start = F.struct(
        F.concat(F.array(name), stk).alias("stk"),
        F.when(open_t, 1).otherwise(a["ts"]).alias("ts"), F.when(open_t, n_start).otherwise(a["tl"]).alias("tl"), a["tt"].alias("tt"),
        F.when(open_h, 1).otherwise(a["hs"]).alias("hs"), F.when(open_h, n_start).otherwise(a["hl"]).alias("hl"), a["ht"].alias("ht"),
        F.when(open_p, 1).otherwise(a["ps"]).alias("ps"), F.when(open_p, n_start).otherwise(a["pl"]).alias("pl"), a["pt"].alias("pt"),
    )

    # end tag: pop back to the most recent open element of that name (stack top is element 1)
    pos = F.array_position(stk, name)
    n_end = n0 - pos

    def closes(state: Column, level: Column) -> Column:
        return F.when((state == 1) & (n_end < level), 2).otherwise(state)

    on_end = F.struct(
        F.slice(stk, (pos + 1).cast("int"), n_end.cast("int")).alias("stk"),
        closes(a["ts"], a["tl"]).alias("ts"), a["tl"].alias("tl"), a["tt"].alias("tt"),
        closes(a["hs"], a["hl"]).alias("hs"), a["hl"].alias("hl"), a["ht"].alias("ht"),
        closes(a["ps"], a["pl"]).alias("ps"), a["pl"].alias("pl"), a["pt"].alias("pt"),
    )

    # text node
    on_text = F.struct(
        stk.alias("stk"),
        a["ts"].alias("ts"), a["tl"].alias("tl"),
        F.when(a["ts"] == 1, F.concat(a["tt"], text)).otherwise(a["tt"]).alias("tt"),
        a["hs"].alias("hs"), a["hl"].alias("hl"),
        F.when(a["hs"] == 1, F.concat(a["ht"], text)).otherwise(a["ht"]).alias("ht"),
        a["ps"].alias("ps"), a["pl"].alias("pl"),
        F.when((a["ps"] == 1) & (F.length(a["pt"]) < PARAGRAPH_CHARS), F.concat(a["pt"], text)).otherwise(a["pt"]).alias("pt"),
    )
    return F.when(finished, a).when(k == "S", on_start).when((k == "E") & (pos > 0), on_end).when(k == "T", on_text).otherwise(a)


def add_html_fields(df: DataFrame, html: str = "html", links: bool = False) -> DataFrame:
    """E1-E4 (+ E6 raw hrefs when ``links``): add ``title``, ``h1``, ``para`` (first paragraph
    after the h1, cut to 200 characters), ``meta_description`` and optionally ``hrefs``.

    ``title``/``h1``/``para`` are null when the element does not occur and '' when it has no
    text.  The cleaned page and the fold state are separate projections so each is computed
    once per row.
    """
    df = df.withColumn("_raw", raw_tokens(clean_html(F.col(html))))
    raw = F.col("_raw")
    cols = {
        "_st": F.aggregate(tokens(raw), _init_state(), _step),
        "meta_description": meta_description(raw),
    }
    if links:
        cols["hrefs"] = token_hrefs(raw)
    df = df.withColumns(cols)
    st = F.col("_st")
    df = df.withColumns({
        "title": F.when(st["ts"] > 0, st["tt"]),
        "h1": F.when(st["hs"] > 0, st["ht"]),
        "para": F.when(st["ps"] > 0, F.substring(st["pt"], 1, PARAGRAPH_CHARS)),
    })
    return df.drop("_raw", "_st")


def meta_description(raw: Column) -> Column:
    """Content of the first <meta> whose name is 'description' (any case), stripped; null
    when missing or empty.  A later meta is never tried.  ``raw``: the page's tokens."""
    metas = F.filter(raw, lambda t: t.rlike("(?i)^<meta[\\s/>]"))
    named = F.filter(metas, lambda m: F.lower(F.coalesce(attr_value(m, "name"), F.lit(""))) == "description")
    content = F.transform(F.slice(named, 1, 1), lambda m: py_strip(F.coalesce(attr_value(m, "content"), F.lit(""))))
    return F.try_element_at(F.filter(content, lambda c: c != ""), F.lit(1))


def token_hrefs(raw: Column) -> Column:
    """Href values of every <a> with an href attribute, in document order (entities decoded)."""
    anchors = F.filter(raw, lambda t: t.rlike("(?i)^<a[\\s/>]"))
    return F.filter(F.transform(anchors, lambda a: attr_value(a, "href")), lambda h: h.isNotNull())


def anchor_hrefs(clean: Column) -> Column:
    """``token_hrefs`` of a cleaned page."""
    return token_hrefs(raw_tokens(clean))
