"""Benchmark decontamination: a positional inverted index of the training tokens.

1. Test items are cut into windows of ``width`` consecutive words (a shorter item is one window).
   Windows are dealt into blocks of at most ``block_windows``; each block passes over the corpus
   by itself, so what a task holds of the test set is bounded.
2. The corpus frequency of every test term is counted over all documents.  A window with a term
   that occurs nowhere is done; the others have their terms in order of frequency, rarest first.
3. The index stores, document by document, the postings (term, position) that can be part of a match:
   those of the windows' rarest terms; of a window's second rarest term where the document has its
   rarest one; and of all other test terms only where the rarest two lie within a window's width.
4. Lists are intersected with their positions less the term's offset in the window, so equal numbers
   are one start: the rarest two lists first, then, for the starts that are left, the lists of all
   other terms.  A start that is in the lists of all terms is an exact match; starts of the rarest two
   that lie within ``slop`` words are a proximity match.

A list is of positions alone.  A common term that is a window's rarest one (an item of common words
only) costs a posting for each of its occurrences.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and non-ASCII characters.

Defined cases: null or empty texts have no words (no hit, no window); a null item id counts as the
empty string; equal rows are one document with one decision on each row; equal items under two ids
are two items; of terms equally frequent the one earlier in the window is rarer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import map_rows, stored, text_of, words_of, wrapped

WIDTH = 10
SLOP = 4
BLOCK_WINDOWS = 500_000


def _binary(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, text_of().cast("binary").alias("text"))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, terms): distinct windows of the test items, in words."""

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            for item, raw in zip(cols["item_id"], cols["text"], strict=True):
                w = [x.decode() for x in words_of(raw)]
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    yield item, w[i:i + width]

        return work

    ids = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    return map_rows(_binary(ids, "item_id"), make, "item_id string, terms array<string>").distinct()


def term_counts(docs: DataFrame, terms: set[bytes]) -> DataFrame:
    """(term, n) over all documents, for the given terms."""

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            seen: Counter = Counter()
            for raw in cols["text"]:
                seen.update(terms.intersection(w := words_of(raw)) and [x for x in w if x in terms])
            for term, n in seen.items():
                yield term.decode(), n

        return work

    return map_rows(_binary(docs), make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, second: dict[bytes, set[bytes]], beside: dict[bytes, set[bytes]], terms: set[bytes], width: int = WIDTH) -> DataFrame:
    """Per document its word count and postings, on shared files: of the terms that ``second`` has as
    keys; of the terms it holds for those keys that the document has; and of all ``terms`` within
    ``width`` words of a key's posting, if one of the terms that ``beside`` holds for the key is there too."""
    first = set(second)

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, key, raw in zip(cols["doc_id"], cols["key"], cols["text"], strict=True):
                w = words_of(raw)
                here = first.intersection(w)
                if not here:
                    yield doc_id, key, len(w), []
                    continue
                wanted = here.union(*[second[t] for t in here])
                at = {i for i, x in enumerate(w) if x in wanted}
                for i in [i for i in at if w[i] in beside]:
                    lo, hi, other = max(0, i - width + 1), min(len(w), i + width), beside[w[i]]
                    if not other.isdisjoint(w[lo:i]) or not other.isdisjoint(w[i + 1:hi]):
                        at.update(k for k in range(lo, hi) if w[k] in terms)
                yield doc_id, key, len(w), [{"term": w[i].decode(), "pos": i} for i in sorted(at)]

        return work

    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("key"), text_of().cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = map_rows(keyed, make, f"doc_id {id_type}, key long, n_words long, postings array<struct<term:string,pos:long>>")
    return stored(rows, "decontamination-index")


def _blocks(wins: DataFrame, block_windows: int) -> Iterator[DataFrame]:
    n = max(1, -(-wins.count() // block_windows))
    for i in range(n):
        yield wins.where(F.pmod(F.xxhash64("terms"), F.lit(n)) == i)


def _ranked(block: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, item_id, length, terms) of the windows whose terms all occur, terms as struct(n, at, term)
    from the rarest on."""
    own = block.select("wid", "item_id", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    ranked = own.groupBy("wid", "item_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("terms"))
    return ranked.where(F.col("terms")[0]["n"] > 0).select("wid", "item_id", F.size("terms").alias("length"), "terms")


def _list(postings: DataFrame, keys: DataFrame, rank: int) -> DataFrame:
    """(rid, wid, start): the list of each window's term of that rank (the last one's, if it has fewer),
    less the term's offset."""
    term = F.element_at("terms", F.least(F.lit(rank), F.size("terms")))
    own = keys.select("wid", term["term"].alias("term"), term["at"].alias("at"))
    return postings.join(own, "term").select("rid", "wid", (F.col("pos") - F.col("at")).alias("start"))


def _near(postings: DataFrame, keys: DataFrame, slop: int) -> DataFrame:
    """(rid, wid, start, gap): starts of a window's rarest two terms at most ``slop`` words apart.  Starts
    are cut into cells of ``slop`` + 1 words; a start meets its own cell and both neighbours."""
    cell = slop + 1
    a = _list(postings, keys, 1).withColumn("cell", F.floor(F.col("start") / cell))
    b = _list(postings, keys, 2).withColumnRenamed("start", "_s")
    b = b.withColumn("cell", F.explode(F.expr(f"transform(array(-1, 0, 1), x -> floor(_s / {cell}) + x)")))
    near = a.join(b, ["rid", "wid", "cell"]).withColumn("gap", F.col("_s") - F.col("start"))
    return near.where(F.abs("gap") <= slop).select("rid", "wid", "start", "gap")


def _matches(docs: DataFrame, items: DataFrame, width: int, block_windows: int, slop: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """For each block of windows: the documents (doc_id, key, n_words); exact matches (doc_id, key,
    item_id, start, length); proximity matches (doc_id, key, item_id, start, gap)."""
    wins = stored(windows(items, width).withColumn("wid", F.monotonically_increasing_id()), "decontamination-windows")
    for block in _blocks(wins, block_windows):
        terms = {r["t"].encode() for r in block.select(F.explode("terms").alias("t")).distinct().toLocalIterator()}
        keys = stored(_ranked(block, term_counts(docs, terms)), "decontamination-keys")
        second: dict[bytes, set[bytes]] = {}
        beside: dict[bytes, set[bytes]] = {}
        rare = keys.select(F.col("terms")[0]["term"].alias("a"), F.element_at("terms", F.least(F.lit(2), F.size("terms")))["term"].alias("b"),
                           (F.col("length") > 2).alias("longer"))
        for r in rare.distinct().toLocalIterator():
            for lists in (second, beside) if r["longer"] else (second,):
                lists.setdefault(r["a"].encode(), set()).add(r["b"].encode())
        rows = index(docs, second, beside, terms, width)
        # equal rows are one document from here on, under a number of its own
        some = rows.where(F.size("postings") > 0).dropDuplicates(["doc_id", "key"]).withColumn("rid", F.monotonically_increasing_id())
        some = stored(some.select("rid", F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "postings"), "decontamination-lists")
        postings = some.select("rid", F.inline("postings"))
        near = stored(_near(postings, keys, slop), "decontamination-near")
        starts = near.where("gap = 0").select("rid", "wid", "start").distinct().join(keys, "wid")
        # the other lists: a window is there if all its terms have its start
        others = starts.where("length > 2").select("rid", "wid", "start", "length", F.explode(F.slice("terms", 3, width)).alias("t"))
        others = others.select("rid", "wid", "start", "length", F.col("t.term").alias("term"), (F.col("start") + F.col("t.at")).alias("pos"))
        agreed = others.join(postings, ["rid", "pos", "term"]).groupBy("rid", "wid", "start").agg(
            F.count(F.lit(1)).alias("n"), F.first("length").alias("length")).where("n = length - 2")
        exact = starts.where("length <= 2").select("rid", "wid", "start", "length").unionByName(agreed.drop("n"))
        named, items_of = some.select("rid", F.col("_d").alias("doc_id"), F.col("_k").alias("key")), keys.select("wid", "item_id")

        def told(found: DataFrame, *more: str, named: DataFrame = named, items_of: DataFrame = items_of) -> DataFrame:
            return found.join(items_of, "wid").join(named, "rid").select("doc_id", "key", "item_id", "start", *more)

        yield (rows.select("doc_id", "key", "n_words"), told(exact, F.col("length").cast("long").alias("length")).distinct(), told(near, "gap").distinct())


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, slop: int = SLOP) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items (sorted ids), spans, and n_near,
    the number of items with a proximity match."""
    base, found, close = None, None, None
    for rows, exact, near in _matches(docs, items, width, block_windows, slop):
        near = near.select("doc_id", "key", "item_id")
        base = base if base is not None else rows
        found, close = (exact, near) if found is None else (found.unionByName(exact), close.unionByName(near))
    found = stored(found, "decontamination-hits")
    spans = found.groupBy("doc_id", "key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    reach = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("seen", F.coalesce(F.max("end").over(reach), F.lit(0)))
    covered = spans.groupBy("doc_id", "key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias("n_hit"),
                                                 F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    per_doc = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    n_near = close.distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_near"))
    for tag, more in enumerate((covered, per_doc, n_near)):
        more = more.withColumnRenamed("doc_id", f"_d{tag}").withColumnRenamed("key", f"_k{tag}")
        base = base.join(more, F.col("doc_id").eqNullSafe(F.col(f"_d{tag}")) & (F.col("key") == F.col(f"_k{tag}")), "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return base.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"),
                       F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
                       F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = SLOP,
                      block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, start, gap): the two rarest terms of a window within ``slop`` words of
    their distance in the item."""
    found = None
    for _, _, near in _matches(docs, items, width, block_windows, slop):
        near = near.select("doc_id", "item_id", "start", "gap")
        found = near if found is None else found.unionByName(near)
    return found.distinct()


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any exact window of a test item."""
    bad = contamination(docs, items, width).where("n_hit > 0").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    rows = wrapped(docs).withColumn("_key", F.xxhash64(text_of()))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS len, array_to_string(w[p:p + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
gram AS (SELECT doc_id, len, p, array_to_string(w[p:p + len - 1], ' ') AS g
       FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS p FROM d, lens WHERE len(w) >= len)),
hit AS (SELECT doc_id, p, len, item_id FROM gram JOIN win USING (len, g)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + len)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
-- proximity: the starts that a window's rarest two terms give lie at most {SLOP} words apart
words AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
cnt AS (SELECT term, count(*) AS n FROM words GROUP BY term),
wt AS (SELECT item_id, g, unnest(range(len)) AS at_, unnest(string_split(g, ' ')) AS term FROM win),
rk AS (SELECT item_id, g, list_sort(list({{'n': coalesce(n, 0), 'at': at_, 'term': wt.term}})) AS k FROM wt LEFT JOIN cnt USING (term) GROUP BY item_id, g),
two AS (SELECT item_id, g, k[1] AS a, k[least(2, len(k))] AS b FROM rk WHERE k[1].n > 0),
near AS (SELECT DISTINCT x.doc_id, two.item_id FROM two JOIN words AS x ON x.term = two.a.term JOIN words AS y ON y.term = two.b.term AND y.doc_id = x.doc_id
         WHERE abs((y.pos - two.b.at) - (x.pos - two.a.at)) <= {SLOP}),
nn AS (SELECT doc_id, count(*) AS n_near FROM near GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
