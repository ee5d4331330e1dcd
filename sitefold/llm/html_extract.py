"""Main text of web pages by wrapper induction.

Pages of one host come from one template.  Three passes over the table as it lies, whole html never
shuffled as long as the wrappers can be broadcast (else it is, once for each join by host):

1. every host with two distinct pages gets a reference frame, the DOM tree of one page that has any
   element;
2. every page is aligned with its host's reference by simple tree matching (the largest matching of
   two ordered trees that keeps parents and order; among largest ones, nodes of equal content are
   preferred), which gives each reference node the block texts it has on the host's pages.  Pages of
   equal text count once, so copies are no evidence;
3. a text that a node has on most of the distinct pages aligned there is template; a page loses the
   blocks that have just that text at that node.  Texts that differ in their numbers only are one text
   there, if they have ``LEAST_WORDS`` words besides and are no heading.

An explicit article (``article``, else ``main``) says where the main text is, not what it is: template
in it goes too.  Since copies with small changes look like template, a page whose article would be
template by more than ``COPIES`` of its length is no evidence about texts in articles: these are
counted again over the other pages, and need ``LEAST_INSIDE`` of them.

The main text is the article less template; on pages without one it is the body less template and
groups of links.  Page furniture by element or role (menus, page headers, footers, sidebars, forms,
scripts, styles) never counts.  A class or id marks furniture (notices, adverts, reader comments,
...) only if all words of that one name say so: ``share-buttons`` does, ``share-price`` doesn't.

Defined cases: null or empty html gives an empty text; a page without url belongs to the host ``''``;
a host of one page has no template but its furniture; repeated rows are extracted alike; unclosed
or stray tags are closed or ignored as their parent ends; a tag's quotes may hold ``>``.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import map_rows, stored

#: Rows of a result batch.
CHUNK = 512
#: A text is template if this share of at least two distinct pages aligned at a node has it there.
SAME = 0.8
LEAST = 2
LEAST_INSIDE = 3
COPIES = 0.5
LEAST_WORDS = 4
#: Cells of an alignment table; larger ones are split.
CELLS = 1 << 20
_BIG = 1 << 20
MOST_LINKS = 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_CONTAINERS = frozenset("ul ol div table".split())
_ELEMENT = re.compile("<[a-zA-Z]")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_IN_HEAD = frozenset("base basefont bgsound link meta".split())  # besides raw text elements
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
_CLOSES_P = _BLOCK - frozenset("body caption head html legend tbody td tfoot th thead tr summary".split())
#: A start tag ends these open elements, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"})}
_FURNITURE = frozenset("nav footer aside form button select datalist dialog menu svg canvas object audio video head".split())
_FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_FURNITURE_WORDS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies
disqus menu nav navbar navigation newsletter notice notices pagination popup promo promoted related replies share sharing sidebar
signup social sponsor sponsored subscribe toolbar widget""".split())
#: Words that leave a name of furniture what it is.
_LAYOUT_WORDS = frozenset("""area articles bar block bottom box btn button buttons center col container content count float footer form
global group head header icon icons id inline inner item items js label left link links list main media module outer page panel post
posts primary right row secondary section site slot small sticky text thread title top unit wrap wrapper""".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NUMBER = re.compile(r"\d+")
_LETTERS = re.compile(r"(?<![^\s])[^\W\d_]+")

#: Furniture by these tags, or by role, class or id, may turn out to be a wrapper of the page.
_WRAPPERS = frozenset("form menu".split())


class Node:
    __slots__ = ("children", "full", "furniture", "kids", "length", "sign", "size", "tag")

    def __init__(self, tag: str, furniture: bool = False):
        self.tag, self.furniture, self.children = tag, furniture, []  # children: Node or str


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True
    if attributes and tag not in ("html", "body", "article", "main") or tag in ("article", "main") and "comment" in attributes.lower():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(a or b or c).lower()
            if name == "role" and value in _FURNITURE_ROLE or name in ("class", "id") and any(map(_names_furniture, value.split())):
                return True
    return False


def _names_furniture(name: str) -> bool:
    """One class or id: a word of furniture, and no word of anything else beside it."""
    words = set(_WORDS.findall(name))
    return not words.isdisjoint(_FURNITURE_WORDS) and words <= _FURNITURE_WORDS | _LAYOUT_WORDS


def parse(page: str) -> Node:
    """The DOM tree; raw text elements (scripts, styles, ...) and comments are left out."""
    root = Node("html")
    stack, at = [root], 0
    places: defaultdict[str, list[int]] = defaultdict(list, html=[0])  # where the open elements of a tag are in the stack

    def close(cut: int) -> None:
        while len(stack) > cut:
            places[stack.pop().tag].pop()

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            between = page[at:m.start()]
            if stack[-1].tag == "head" and not between.isspace():
                close(len(stack) - 1)
            stack[-1].children.append(between)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in places and places[tag] and places[tag][-1]:
                close(places[tag][-1])
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)  # an open head ends at the first element that can't be in it
        if tag in ("html", "body") and places[tag]:
            continue
        ends, until = ({"p"}, {"table", "td", "th", "button"}) if tag in _CLOSES_P else _ENDS.get(tag, ((), ()))
        if any(places[t] for t in ends):
            bound = max((places[t][-1] for t in until if places[t]), default=0)
            above = [places[t][i] for t in ends if (i := bisect_right(places[t], bound)) < len(places[t])]
            if above:
                close(min(above))
        attributes = m[3] or ""
        node = Node(tag, _is_furniture(tag, attributes, bool(places["article"])))
        stack[-1].children.append(node)
        if tag not in _VOID and not attributes.endswith("/"):
            places[tag].append(len(stack))
            stack.append(node)
    if at < len(page):
        if stack[-1].tag == "head" and not page[at:].isspace():
            close(len(stack) - 1)
        stack[-1].children.append(page[at:])
    _unmark(root)
    return root


def _unmark(root: Node) -> None:
    """Clear the furniture mark of elements that wrap the page: a form or an element named by role,
    class or id that holds most of the page's text; and, if every article (else main) lies in
    furniture, what is around the longest one."""
    def certain(n: Node) -> bool:
        return n.furniture and n.tag not in _WRAPPERS and (n.tag in _FURNITURE or n.tag == "header")

    order, stack, marked = [], [root], False
    while stack:
        n = stack.pop()
        order.append(n)
        marked = marked or n.furniture
        stack += [c for c in n.children if isinstance(c, Node)]
    if not marked:
        return
    for n in reversed(order):
        n.length = sum(len(c.strip()) if isinstance(c, str) else 0 if certain(c) else c.length for c in n.children)
    stack = [root]
    while stack:  # outside articles only: a long list of comments in one stays furniture
        n = stack.pop()
        if 2 * n.length > root.length and not certain(n):
            n.furniture = False
            if n.tag not in ("article", "main"):
                stack += [c for c in n.children if isinstance(c, Node)]
    for tag in ("article", "main"):
        if _find(root, tag):
            return
    for tag in ("article", "main"):
        best, stack = None, [(root, None, False)]
        while stack:
            n, above, inside = stack.pop()
            path, inside = (n, above), inside or certain(n)
            if n.tag == tag and n.length and (best is None or n.length > best[0].length) and (2 * n.length > root.length or not inside):
                best = path
            stack += [(c, path, inside) for c in reversed(n.children) if isinstance(c, Node)]
        if best:
            while best:
                n, best = best
                n.furniture = False
            return


def _find(node: Node, tag: str, skip: set[int] = frozenset()) -> list[Node]:
    """Topmost elements ``tag`` outside furniture and nodes in ``skip``."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.furniture or id(n) in skip:
            continue
        if n.tag == tag:
            out.append(n)
        else:
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def units(node: Node, skip: set[int] = frozenset()) -> list[tuple[Node, str]]:
    """Blocks under ``node`` in page order, without furniture and nodes in ``skip``: the innermost
    block element around and the text."""
    out, now, owners = [], [], [node]

    def end() -> None:
        if now and (text := " ".join(html.unescape("".join(now)).split())):
            out.append((owners[-1], text))
        now.clear()

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            end()
            owners.pop()
        elif isinstance(n, str):
            now.append(n)
        elif n.tag == "br":
            now.append(" ")
        elif not n.furniture and id(n) not in skip:
            if n.tag in _BLOCK:
                end()
                owners.append(n)
                stack.append(None)
            stack += reversed(n.children)
    end()
    return out


def blocks(node: Node, skip: set[int] = frozenset()) -> list[str]:
    return [text for _, text in units(node, skip)]


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def unit_key(owner: Node, text: str) -> int:
    """What a block is compared by at a node: its text, without the numbers in a longer line."""
    if owner.tag not in _HEADINGS and _NUMBER.search(text) and len(_LETTERS.findall(text)) >= LEAST_WORDS:
        text = _NUMBER.sub("0", text)
    return digest(text)


def _sign(n: Node) -> None:
    n.size = 1 + sum(k.size for k in n.kids)
    n.sign = hash((n.tag, *(k.sign for k in n.kids)))


def _frame(node: Node, folded: set[int]) -> None:
    """Set what alignment needs: element children, signatures of shape and content, and size.
    Furniture and nodes in ``folded`` have no element children."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        n.kids = [] if n.furniture or id(n) in folded else [c for c in n.children if isinstance(c, Node)]
        stack += n.kids
    for n in reversed(order):
        _sign(n)
        own = " ".join("".join(c for c in n.children if isinstance(c, str)).split())
        n.full = digest(f"{n.tag} {' '.join(str(k.full) for k in n.kids)} {own}")


def frame_to_text(node: Node) -> str:
    """A frame as lines of depth, content signature and tag, in page order."""
    out, stack = [], [(0, node)]
    while stack:
        depth, n = stack.pop()
        out.append(f"{depth} {n.full} {n.tag}")
        stack += [(depth + 1, k) for k in reversed(n.kids)]
    return "\n".join(out)


def frame_from_text(text: str) -> list[Node]:
    """The nodes of a frame in page order; the first is the root."""
    order, path = [], []
    for line in text.split("\n"):
        depth, full, tag = line.split(" ", 2)
        n = Node(tag)
        n.kids, n.full = [], int(full)
        del path[int(depth):]
        if path:
            path[-1].kids.append(n)
        path.append(n)
        order.append(n)
    for n in reversed(order):
        _sign(n)
    return order


def _matching(a: Node, b: Node, known: dict) -> int:
    """Size of the largest matching of two trees whose roots match, by simple tree matching."""
    if a.tag != b.tag:
        return 0
    if a.sign == b.sign:
        return a.size
    key = a.sign, b.sign
    if (got := known.get(key)) is None:
        got = known[key] = 1 + int(_last_row(a.kids, b.kids, known)[-1]) // _BIG
    return got


def _weights(xs: list[Node], ys: list[Node], known: dict) -> Iterator[np.ndarray]:
    """Per node of ``xs`` what matching it with each of ``ys`` is worth: nodes first, then equal content."""
    kinds: dict[int, int] = {}
    kind = np.array([kinds.setdefault(y.sign, len(kinds)) for y in ys])
    first = {y.sign: y for y in reversed(ys)}
    full = np.array([y.full for y in ys])
    rows: dict[int, np.ndarray] = {}
    for x in xs:
        if (row := rows.get(x.sign)) is None:
            row = rows[x.sign] = np.array([_matching(x, first[s], known) for s in kinds], np.int64)[kind] * _BIG
        yield row + ((full == x.full) & (row > 0))


def _rows(xs: list[Node], ys: list[Node], known: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the alignment table of two lists, with the weights they are made from."""
    row = np.zeros(len(ys) + 1, np.int64)
    for w in _weights(xs, ys, known):
        last, row = row, np.zeros(len(ys) + 1, np.int64)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + w), out=row[1:])
        yield row, w


def _last_row(xs: list[Node], ys: list[Node], known: dict) -> np.ndarray:
    row = np.zeros(len(ys) + 1, np.int64)
    if xs and ys:
        for row, _ in _rows(xs, ys, known):  # noqa: B007
            pass
    return row


def _pairs(xs: list[Node], ys: list[Node], known: dict) -> list[tuple[Node, Node]]:
    """The best pairing of two lists of children in order."""
    out = []
    lo, n, m = 0, len(xs), len(ys)
    # nodes of equal content at the ends are always paired in some best pairing
    while lo < min(n, m) and xs[lo].full == ys[lo].full and xs[lo].sign == ys[lo].sign:
        lo += 1
    while min(n, m) > lo and xs[n - 1].full == ys[m - 1].full and xs[n - 1].sign == ys[m - 1].sign:
        n, m = n - 1, m - 1
    out += zip([*xs[:lo], *xs[n:]], [*ys[:lo], *ys[m:]], strict=True)
    xs, ys = xs[lo:n], ys[lo:m]
    if not xs or not ys:
        return out
    if len(xs) > 1 and len(xs) * len(ys) > CELLS:
        half = len(xs) // 2
        ahead = _last_row(xs[:half], ys, known)
        behind = _last_row(xs[half:][::-1], ys[::-1], known)[::-1]
        at = int((ahead + behind).argmax())
        return out + _pairs(xs[:half], ys[:at], known) + _pairs(xs[half:], ys[at:], known)
    best, weight = [np.zeros(len(ys) + 1, np.int64)], []
    for row, w in _rows(xs, ys, known):
        best.append(row)
        weight.append(w)
    n, m = len(xs), len(ys)
    while n and m:
        w = weight[n - 1][m - 1]
        if w and best[n][m] == best[n - 1][m - 1] + w:
            n, m = n - 1, m - 1
            out.append((xs[n], ys[m]))
        elif best[n][m] == best[n - 1][m]:
            n -= 1
        else:
            m -= 1
    return out


def align(a: Node, b: Node, known: dict | None = None) -> Iterator[tuple[Node, Node]]:
    """Aligned pairs of two frames."""
    if known is None:
        known = {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # pages nest as deep as they like
    stack = [(a, b)] if a.tag == b.tag else []
    while stack:
        a, b = stack.pop()
        yield a, b
        # the same shape: nodes align one by one
        stack += zip(a.kids, b.kids, strict=True) if a.sign == b.sign else _pairs(a.kids, b.kids, known)


def _link_groups(root: Node) -> set[int]:
    """Containers that are mostly links.  One around others is judged by what it holds besides
    them, and only if they all are; a paragraph that is not mostly links keeps what is around it."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.furniture:
            order.append(n)
            stack += [c for c in n.children if isinstance(c, Node)]
    groups: set[int] = set()
    inner: dict[int, set[int]] = {}  # topmost containers and text paragraphs under a node
    for n in reversed(order):
        under = set().union(*[inner.get(id(c), ()) for c in n.children if isinstance(c, Node)])
        if n.tag in _CONTAINERS or n.tag == "p":
            size = len("".join(blocks(n, under)))
            linked = sum(len("".join(blocks(a, under))) for a in _find(n, "a", under))
            mostly = linked > MOST_LINKS * size or not size and bool(under)
            if n.tag == "p":
                under = under if mostly or not size else {id(n)}
            else:
                if mostly and under <= groups:
                    groups.add(id(n))
                under = {id(n)}
        inner[id(n)] = under
    return groups


class Page:
    """A parsed page: its blocks, and which of them are its main text if they are no template."""

    def __init__(self, page: str):
        self.tree = parse(page)
        found = _find(self.tree, "article") or _find(self.tree, "main")
        _frame(self.tree, set())
        inside = [u for n in found for u in units(n)]
        self.inside = {id(o) for o, _ in inside}
        self.main = inside if found else units(self.tree, _link_groups(self.tree))
        self.all = inside + units(self.tree, {id(n) for n in found}) if found else self.main

    def seen(self, reference: list[Node], known: dict) -> dict[int, int]:
        """Numbers of the reference nodes that nodes of the page are aligned with, by id."""
        number = {id(n): i for i, n in enumerate(reference)}
        return {id(b): number[id(a)] for a, b in align(reference[0], self.tree, known)}

    def observe(self, reference: list[Node], known: dict) -> tuple[int, int, list[int], list[int], list[int], list[int]]:
        """Digest of the page's text, length of its article, the reference nodes it has, and node,
        digest and length in an article of its blocks."""
        at = self.seen(reference, known)
        have = sorted({at[id(o)] for o, _ in self.all if id(o) in at} | {i for i in at.values() if reference[i].tag in _BLOCK})
        own = {(at[id(o)], unit_key(o, t)): len(t) if id(o) in self.inside else 0 for o, t in self.all if id(o) in at}
        text = digest("\n\n".join(t for _, t in self.main))
        long = sum(len(t) for o, t in self.main if id(o) in self.inside)
        return text, long, have, [i for i, _ in own], [d for _, d in own], list(own.values())

    def text(self, reference: list[Node], template: set[tuple[int, int]], known: dict) -> str:
        at = self.seen(reference, known) if template else {}
        return "\n\n".join(t for o, t in self.main if id(o) not in at or (at[id(o)], unit_key(o, t)) not in template)


def _usual(rows: Iterable[tuple], least: int) -> tuple[set, set]:
    """Of observed pages the (node, text) that most pages with the node have, and those in articles."""
    have, count, inside = Counter(), Counter(), set()
    for _, nodes, *own in rows:
        have.update(nodes)
        for i, d, n in zip(*own, strict=True):
            count[i, d] += 1
            if n:
                inside.add((i, d))
    return {u for u, n in count.items() if n >= least and n >= SAME * have[u[0]]}, inside


def extract(pages: list[str]) -> list[str]:
    """Main texts of same-host pages."""
    parsed = [Page(p) for p in pages]
    reference, template, known = [], set(), {}
    chosen = next((i for i, p in enumerate(pages) if _ELEMENT.search(p)), None)
    if chosen is not None:
        reference = frame_from_text(frame_to_text(parsed[chosen].tree))
        distinct: dict[int, tuple] = {}
        for p in parsed:
            text, *rest = p.observe(reference, known)
            distinct[text] = min(distinct.get(text, rest), rest)
        usual, inside = _usual(distinct.values(), LEAST)
        among = usual & inside
        others = [r for r in distinct.values() if sum(n for *u, n in zip(*r[2:], strict=True) if tuple(u) in among) <= COPIES * r[0]]
        template = usual - inside | _usual(others, LEAST_INSIDE)[0] & among
    return [p.text(reference, template, known) for p in parsed]


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _frames(text: str | None, cache: dict) -> tuple[list[Node], dict]:
    """A reference frame and what is known of alignments with it; a task keeps the last few."""
    if text not in cache:
        if len(cache) >= 64:
            del cache[next(iter(cache))]
        cache[text] = frame_from_text(text) if text else [], {}
    reference, known = cache[text]
    if len(known) > 100_000:
        known.clear()
    return reference, known


def wrappers(pages: DataFrame) -> DataFrame:
    """host, frame, nodes, texts of every host with two distinct pages: the reference frame and the
    template texts of its nodes.  ``pages`` is (host, html, ...)."""
    # the reference is the page of smallest hash, one with an element if there is any
    hashed = pages.select("host", F.struct(~F.col("html").rlike("<[a-zA-Z]"), F.xxhash64("html")).alias("h"))
    hosts = hashed.groupBy("host").agg(F.min("h").alias("h"), F.max("h").alias("_last")).where("h != _last and not h.col1")
    hosts = stored(hosts.select("host", F.col("h.col2").alias("h")), "html-hosts")

    def make_frames():
        def work(cols: dict) -> Iterator[tuple]:
            for host, page in zip(cols["host"], cols["html"], strict=True):
                yield host, frame_to_text(Page(page).tree)

        return work

    chosen = pages.withColumn("_h", F.xxhash64("html")).join(hosts.withColumnRenamed("h", "_h"), ["host", "_h"])
    frames = map_rows(chosen.select("host", "html"), make_frames, "host string, frame string", CHUNK)
    frames = stored(frames.groupBy("host").agg(F.min("frame").alias("frame")), "html-frames")  # copies of the page

    def make_rows():
        cache: dict = {}

        def work(cols: dict) -> Iterator[tuple]:
            for host, page, frame in zip(cols["host"], cols["html"], cols["frame"], strict=True):
                yield host, *Page(page).observe(*_frames(frame, cache))

        return work

    rows = map_rows(pages.join(frames, "host").select("host", "html", "frame"), make_rows,
                    "host string, text long, long long, have array<int>, nodes array<int>, texts array<long>, sizes array<int>", CHUNK)
    distinct = rows.groupBy("host", F.col("text").alias("page")).agg(F.min(F.struct("long", "have", "nodes", "texts", "sizes")).alias("r"))
    distinct = stored(distinct.select("host", "page", "r.*"), "html-observed")

    have = F.transform("have", lambda i: F.struct(i.alias("node"), F.lit(None).cast("long").alias("text"), F.lit(0).alias("size")))
    own = F.transform(F.arrays_zip("nodes", "texts", "sizes"),
                      lambda u: F.struct(u["nodes"].alias("node"), u["texts"].alias("text"), u["sizes"].alias("size")))

    def usual(observed: DataFrame, least: int) -> DataFrame:
        """(host, node, text, inside) that most pages with the node have."""
        seen = observed.select("host", F.explode(F.concat(have, own)).alias("u"))
        counts = seen.groupBy("host", "u.node", "u.text").agg(F.count(F.lit(1)).alias("n"), (F.max("u.size") > 0).alias("inside"))
        counts = stored(counts.where((F.col("n") >= least) | F.col("text").isNull()), "html-counts")
        total = counts.where(F.col("text").isNull()).select("host", "node", F.col("n").alias("total"))
        return counts.where("text is not null").join(total, ["host", "node"]).where(F.col("n") >= SAME * F.col("total")).drop("n", "total")

    found = stored(usual(distinct, LEAST), "html-usual")
    among = found.where("inside").drop("inside")
    # pages that are copies by these texts are no evidence about texts in articles
    held = distinct.join(among.select("host").distinct(), "host", "left_semi")
    shares = held.select("host", "page", "long", F.explode(own).alias("u")).select("host", "page", "long", "u.*")
    shares = shares.join(among, ["host", "node", "text"]).groupBy("host", "page").agg(F.sum("size").alias("size"), F.first("long").alias("long"))
    copies = shares.where(F.col("size") > COPIES * F.col("long")).select("host", "page")
    others = usual(held.join(copies, ["host", "page"], "left_anti"), LEAST_INSIDE).drop("inside")
    template = found.where("not inside").drop("inside").unionByName(others.join(among, ["host", "node", "text"], "left_semi"))
    template = template.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("t"))
    # as many entries as a frame has blocks, over SAME at most
    template = template.select("host", F.col("t.node").alias("nodes"), F.col("t.text").alias("texts"))
    return stored(frames.join(template, "host"), "html-wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def make():
        cache: dict = {}
        names = "page_id", "url", "html", "frame", "nodes", "texts"

        def work(cols: dict) -> Iterator[tuple]:
            for page_id, url, page, frame, nodes, texts in zip(*map(cols.get, names), strict=True):
                reference, known = _frames(frame, cache)
                text = Page(page).text(reference, set(zip(nodes or (), texts or (), strict=True)), known)
                yield page_id, url, text, len(text)

        return work

    both = pages.join(wrappers(pages), "host", "left").select("page_id", "url", "html", "frame", "nodes", "texts")
    return map_rows(both, make, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long", CHUNK)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
