"""N-gram Jaccard join with signature trees, and the components of its links.

1. A document becomes the set of its distinct word shingles, as 64-bit hashes.  Documents with equal
   sets form a class; only one of each class goes on, under the class's smallest id.
2. Candidate groups: classes that agree in a band of ``ROWS`` min-hashes.  There are as many bands
   as make a linked pair miss all of them with a probability under ``MISS`` (10^-12, for a pair
   just at the threshold; below that of a collision of the hashes themselves).
3. In a group, a *signature tree* is built over the classes in order of size: nodes hold the OR of
   their members' token bitmaps and their size range.  A traversal of node pairs prunes every pair
   whose largest possible overlap is too small; at the leaves whole sets are compared, so every
   link is exact.  Classes already known to be connected are not compared, and what leaves a task
   is a forest of links, not all pairs.
4. Passes, each over the groups that still hold more than one component:
   a. groups of the first ``FIRST_BANDS`` bands, large ones in random chunks;
   b. groups of all bands; of large ones two members of each component, in random chunks;
   c. large groups that are still open, completely: members in blocks of one size range, each pair
      of blocks whose ranges allow a link as a group of its own.
   Large is beyond ``CHUNK`` members or ``CHUNK_TOKENS`` tokens, so a task's group is bounded.
   After (b) and (c) every candidate pair has been compared or found connected.  A group of copies
   that holds a third of all rows is merged by (a) and (b) in chunks of bounded size.

Defined cases: null and empty texts have an empty set, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle; rows repeated under one id are one
document, and so are different texts under one id (their links are joined); a row without an id
has no component (null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import BASE, map_rows, mixed, powers, stored, text_of, word_spans, wrapped
from sitefold.llm.components import connected_components

ROWS = 3
MISS = 1e-12
FIRST_BANDS = 2
#: A group beyond this many members or tokens is split.
CHUNK, CHUNK_TOKENS = 2048, 2 << 20
LEAF, FANOUT = 64, 8
BITS_PER_TOKEN, MOST_BITS = 16, 1 << 16
STEP = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, made of its words' hashes,
    which are found a segment of the text at a time."""
    own = [h for _, _, h in word_spans(raw.translate(_LOWER))]
    if not own:
        return np.empty(0, np.uint64)
    own = np.concatenate(own)
    n = max(1, len(own) - words + 1)
    weight = powers(BASE, words)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, STEP):
        hi = min(lo + STEP, n)
        h = np.zeros(hi - lo, np.uint64)
        for k in range(min(words, len(own))):
            h += own[lo + k:hi + k] * weight[k]
        out[lo:hi] = mixed(h)
    del own
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def band_keys(tokens: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of min-hashes."""
    rng = np.random.default_rng(20)
    n = bands * ROWS
    xor, mul = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 4096):
        least = np.minimum(least, ((tokens[i:i + 4096, None] ^ xor) * mul).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, ROWS).T:
        key = (key ^ row) * _MIX
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


class Node:
    """Members lo..hi of a group in order of size, with what bounds their overlaps."""

    __slots__ = ("bits", "children", "hi", "hidden", "largest", "lo", "smallest")

    def __init__(self, lo: int, hi: int, smallest: int, largest: int, hidden: int, bits: np.ndarray, children: list):
        self.lo, self.hi, self.smallest, self.largest = lo, hi, smallest, largest
        self.hidden, self.bits, self.children = hidden, bits, children


class SignatureTree:
    """Links of one group of sets, sorted by size; ``percent``: 100 * intersection >= percent * union.

    A shared token sets a bit in both bitmaps, so an overlap is at most the number of common bits
    plus the tokens that hide behind another token's bit in the smaller count of the two."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.n = np.array(list(map(len, sets)), np.int64)
        width = 64
        while width < min(BITS_PER_TOKEN * int(self.n[-1]), MOST_BITS):
            width *= 2
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for i, s in enumerate(sets):
            on = np.zeros(width, bool)
            on[(s & np.uint64(width - 1)).astype(np.int64)] = True
            self.bits[i] = np.packbits(on).view(np.uint64)
        self.hidden = self.n - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        nodes = [Node(lo, min(lo + LEAF, len(sets)), int(self.n[lo]), int(self.n[lo:lo + LEAF].max()), int(self.hidden[lo:lo + LEAF].max()),
                      np.bitwise_or.reduce(self.bits[lo:lo + LEAF]), []) for lo in range(0, len(sets), LEAF)]
        while len(nodes) > 1:
            nodes = [self._over(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        self.root = nodes[0]

    @staticmethod
    def _over(part: list[Node]) -> Node:
        return Node(part[0].lo, part[-1].hi, part[0].smallest, part[-1].largest, max(n.hidden for n in part),
                    np.bitwise_or.reduce([n.bits for n in part]), part)

    def _apart(self, x: Node, y: Node) -> bool:
        """No member of x can reach the threshold with one of y."""
        low, high = (x, y) if x.smallest <= y.smallest else (y, x)
        if low.largest < high.smallest and 100 * low.largest < self.percent * high.smallest:
            return True
        most = min(x.largest, y.largest, int(np.bitwise_count(x.bits & y.bits).sum(dtype=np.int64)) + min(x.hidden, y.hidden))
        return (100 + self.percent) * most < self.percent * (x.smallest + y.smallest)

    def _partners(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Members of lo..hi that may reach the threshold with member i."""
        n = self.n[lo:hi]
        most = np.bitwise_count(self.bits[i] & self.bits[lo:hi]).sum(axis=1, dtype=np.int64) + np.minimum(self.hidden[i], self.hidden[lo:hi])
        most = np.minimum(most, np.minimum(n, self.n[i]))
        return np.flatnonzero((100 + self.percent) * most >= self.percent * (n + self.n[i])) + lo

    def links(self, component: list, side: list[int] | None = None) -> Iterator[tuple[int, int]]:
        """A forest of links between members of different ``component``; with ``side``, links of
        members of side 0 with members of side 1."""
        parent: dict = {}

        def find(c):
            while (p := parent.get(c, c)) != c:
                parent[c] = c = parent.get(p, p)
            return c

        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            if x is not y and self._apart(x, y):
                continue
            if x.children or y.children:
                if x is y:
                    kids = x.children
                    stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
                elif x.children and (not y.children or x.hi - x.lo >= y.hi - y.lo):
                    stack += [(k, y) for k in x.children]
                else:
                    stack += [(x, k) for k in y.children]
                continue
            if len({find(c) for c in component[x.lo:x.hi]} | {find(c) for c in component[y.lo:y.hi]}) == 1:
                continue
            for i in range(x.lo, x.hi):
                for j in self._partners(i, i + 1 if x is y else y.lo, y.hi).tolist():
                    if side and side[i] == side[j]:
                        continue
                    a, b = find(component[i]), find(component[j])
                    if a == b:
                        continue
                    shared = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                    if 100 * shared >= self.percent * (self.n[i] + self.n[j] - shared):
                        parent[a] = b
                        yield i, j


def _group_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside the groups of ``rows`` (gid, side, vertex, component, tokens).  Rows come
    sorted by group; a task holds one group at a time."""
    id_type = rows.schema["vertex"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def solve(group: list[tuple]) -> pa.RecordBatch | None:
            if len(group) < 2:
                return None
            sets = [np.frombuffer(g[3], np.uint64) for g in group]
            order = sorted(range(len(group)), key=lambda i: len(sets[i]))
            group, sets = [group[i] for i in order], [sets[i] for i in order]
            two = [g[0] for g in group]
            found = list(SignatureTree(sets, percent).links([g[2] for g in group], two if len(set(two)) > 1 else None))
            ends = [pa.array([group[p[k]][1] for p in found], kind) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"]) if found else None

        now, group = None, []
        for batch in batches:
            kind = batch.schema.field("vertex").type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols = [part.column(c).to_pylist() for c in ("gid", "side", "vertex", "component", "tokens")]
                for gid, *row in zip(*cols, strict=True):
                    if gid != now:
                        if (out := solve(group)) is not None:
                            yield out
                        now, group = gid, []
                    group.append(tuple(row))
        if (out := solve(group)) is not None:
            yield out

    dealt = rows.repartition("gid").sortWithinPartitions("gid").select("gid", "side", "vertex", "component", "tokens")
    return dealt.mapInArrow(run, f"a {id_type}, b {id_type}")


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """``members`` with the component of each vertex so far (itself if it has no link yet)."""
    named = components.select(F.col("a").alias("vertex"), F.col("b").alias("_c"))
    return members.join(named, "vertex", "left").withColumn("component", F.coalesce("_c", "vertex")).drop("_c")


def _weight() -> Column:
    """A member's share of a chunk: its tokens, at least what CHUNK members may have on average."""
    return F.greatest(F.col("n"), F.lit(CHUNK_TOKENS // CHUNK)).cast("long")


def _open_groups(members: DataFrame) -> DataFrame:
    """(key, size, chunks) of the groups with more than one component; of groups with the same
    members, one."""
    sums = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(_weight()).alias("w"),
                                      F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.sum(F.xxhash64("vertex").cast("decimal(38,0)")).alias("s1"),
                                      F.sum(F.xxhash64("vertex", F.lit(1)).cast("decimal(38,0)")).alias("s2"))
    one = sums.where("lo < hi").groupBy("size", "s1", "s2").agg(F.min("key").alias("key"), F.min("w").alias("w"))
    return one.select("key", F.ceil(F.col("w") / CHUNK_TOKENS).alias("chunks"))


def components_of_links(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable)."""
    bands = band_count(percent)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().cast("binary").alias("text"))

    def describe():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, raw in zip(cols["doc_id"], cols["text"], strict=True):
                s = shingles(raw, words)
                yield doc_id, len(s), blake2b(s.tobytes(), digest_size=16).digest(), band_keys(s, bands).tolist() if len(s) else None

        return work

    table = stored(map_rows(texts, describe, f"doc_id {id_type}, n long, class binary, bands array<long>"), "jaccard-documents")
    full = table.where("n > 0 and doc_id is not null")
    classes = full.groupBy("class", "n").agg(F.min("doc_id").alias("vertex"), F.first("bands").alias("bands"))
    members = classes.select("vertex", "n", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    members = stored(members.join(shared, "key", "left_semi"), "jaccard-members")

    def tokens():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, raw in zip(cols["doc_id"], cols["text"], strict=True):
                yield doc_id, shingles(raw, words).tobytes()

        return work

    wanted = members.select(F.col("vertex").alias("_v")).distinct()
    chosen = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_v"), "left_semi")
    sets = stored(map_rows(chosen, tokens, f"vertex {id_type}, tokens binary", batch=256).where("length(tokens) > 0"), "jaccard-sets")

    def solve(rows: DataFrame, known: DataFrame) -> DataFrame:
        links = _group_links(rows.join(sets, "vertex"), percent)
        return connected_components(known.unionByName(links))

    # rows repeated under one id may give a class twice: members are distinct by vertex
    members = members.select("vertex", "n", "band", "key").distinct()
    known = docs.sparkSession.createDataFrame([], f"a {id_type}, b {id_type}")

    # (a) the first bands, in random chunks
    mine = members.where(F.col("band") < FIRST_BANDS).withColumn("component", F.col("vertex"))
    rows = mine.join(_open_groups(mine), "key").withColumn("part", F.pmod(F.xxhash64("vertex"), F.col("chunks")))
    known = solve(rows.withColumn("gid", F.xxhash64("key", "part")).withColumn("side", F.lit(0)), known)

    # (b) all bands; of large groups some members of each component, in chunks
    mine = stored(_labelled(members, known), "jaccard-open")
    groups = stored(_open_groups(mine), "jaccard-groups")
    grouped = mine.join(groups, "key")
    some = (grouped.where("chunks > 1").groupBy("key", "chunks", "component").agg(F.array_distinct(F.array(F.min("vertex"), F.max("vertex"))).alias("v"))
            .select("key", "component", F.explode("v").alias("vertex"), F.pmod(F.xxhash64("component"), F.col("chunks")).alias("part")))
    rows = grouped.where("chunks = 1").select("key", "component", "vertex", F.lit(0).cast("long").alias("part")).unionByName(some)
    known = solve(rows.withColumn("gid", F.xxhash64("key", "part")).withColumn("side", F.lit(0)), known)

    # (c) what is still open beyond a chunk, completely, by pairs of size blocks
    large = groups.where("chunks > 1")
    if not large.isEmpty():
        mine = _labelled(members.join(large.select("key"), "key", "left_semi"), known)
        mine = mine.join(_open_groups(mine).where("chunks > 1").select("key"), "key").withColumn("w", _weight())
        # sizes in order share a block until it is full; a size that fills blocks alone is dealt to parts
        upto = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        sizes = mine.groupBy("key", "n").agg(F.sum("w").alias("w")).withColumn("b", F.floor(F.coalesce(F.sum("w").over(upto), F.lit(0)) / CHUNK_TOKENS))
        sizes = sizes.withColumn("parts", F.ceil(F.col("w") / CHUNK_TOKENS))
        block = F.struct("b", "p")
        blocks = (sizes.select("key", "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
                  .groupBy("key", block.alias("block")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
        x, y = (blocks.select(F.col("key").alias(f"{t}key"), F.col("block").alias(f"{t}block"), F.col("lo").alias(f"{t}lo"), F.col("hi").alias(f"{t}hi")) for t in "xy")
        pairs = x.join(y, F.col("xkey") == F.col("ykey")).where((F.col("xblock") <= F.col("yblock")) & (100 * F.col("xhi") >= percent * F.col("ylo")))
        pairs = pairs.withColumn("gid", F.xxhash64("xkey", "xblock", "yblock"))
        ends = pairs.select(F.col("xkey").alias("key"), F.col("xblock").alias("block"), F.lit(0).alias("side"), "gid").unionByName(
            pairs.where("xblock < yblock").select(F.col("ykey").alias("key"), F.col("yblock").alias("block"), F.lit(1).alias("side"), "gid"))
        own = mine.join(sizes.select("key", "n", "b", "parts"), ["key", "n"]).withColumn("p", F.pmod(F.xxhash64("vertex", F.lit(2)), F.col("parts")))
        rows = own.withColumn("block", block).join(ends, ["key", "block"])
        known = solve(rows.select("gid", "side", "vertex", "component"), known)

    # back to the documents: their class, its vertex, the vertex's component
    named = classes.select(F.col("class").alias("_class"), F.col("n").alias("_n"), F.col("vertex").alias("_vertex"))
    out = table.select("doc_id", "n", "class").join(
        named, (F.col("class") == F.col("_class")) & (F.col("n") == F.col("_n")) & F.col("doc_id").isNotNull(), "left")
    own = known.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    out = out.join(own, F.col("_vertex") == F.col("_a"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_b", "_vertex", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one whose id
    names the component.  Rows without an id or without words stay."""
    kept = components_of_links(docs, words, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_d")).distinct()
    rows = wrapped(docs).select("row", "doc_id")
    stay = rows.join(kept, F.col("doc_id") == F.col("_d"), "left_semi").select("row.*")
    return stay.unionByName(rows.where("doc_id is null").select("row.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of_links(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT list(doc_id) AS ids FROM s GROUP BY s HAVING count(*) > 1),
c AS (SELECT x AS a, y AS b, count(*) AS i
      FROM (SELECT x, unnest(ids) AS y FROM (SELECT ids, unnest(ids) AS x FROM g)) WHERE x <> y GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) AS m USING (doc_id)
"""
