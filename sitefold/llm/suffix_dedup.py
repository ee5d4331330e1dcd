"""Suffix-array dedup of repeated byte strings, by a distributed merge of sorted suffixes.

A byte is removed when a string of ``SPAN`` bytes that covers it also starts anywhere else.

*Which suffixes.*  Sorting a suffix for every byte would ship ``SPAN`` times the corpus.  A window of
``SPAN`` bytes is instead represented by its *anchor*: the place of its least hashed ``GRAM``-gram.
The anchor depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets; neighbouring windows share theirs, and about one suffix in ``SPAN`` / 2 is left.

1. Anchors of all documents are counted by the hash of their gram (partial aggregation on the map
   side).  Only documents with a gram that occurs twice go on, with those grams.
2. Their tasks cut at each such anchor the *right* context (the suffix, to the end of the anchor's
   last window) and the *left* context (back to the start of its first window).  Equal contexts are
   folded into one with a list of places, so copies and repetitive texts cross the shuffle once per
   run.  Contexts are sorted and front-coded: a run holds, for each suffix, the length of the prefix
   it shares with the one before and the bytes after that.
3. Runs are exchanged by gram hash.  A loser tree merges the runs of a part; each player carries
   the prefix it is known to share with the last suffix that came out, so known prefixes are never
   compared again, and the merged order comes with its prefix lengths (the LCP array).
4. Suffixes that share a gram are neighbours now.  For two of them the shared right prefix R and
   the shared left suffix L settle which windows are equal: offsets from SPAN - R to L.  Groups of
   many different contexts look their windows up by bytes, offset by offset.
5. The ends of a passage that a third of all documents share would make one group of as many contexts.
   So suffixes whose gram occurs more than ``HOT_GRAM`` times are dealt by their next bytes as well: two
   of them can only share a window at an offset from a to b if they agree in SPAN - b bytes to the
   right and a bytes to the left.  Groups that are still larger than ``HOT_GRAM`` are halved, offsets a to
   m and m + 1 to b, until they are small or hold one window, which all of them share then.  Small ones
   are sorted by Spark and compared as in 4.
6. Removed ranges return to their documents by row id, where their union is cut out.

Every comparison that decides a removal is of bytes; hashes only pick and deal anchors.

Defined cases: a null text is empty; texts under ``SPAN`` bytes lose nothing; repeated rows are
copies and lose everything from ``SPAN`` bytes on, each of them; a text may match itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import map_rows, stored, text_of

SPAN = 200
GRAM = 32
REACH = SPAN - GRAM + 1  # grams of a window
SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)  # bits for a place in a segment
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A run is written when its contexts reach this size or this number of places.
RUN_BYTES, RUN_PLACES = 24 << 20, 400_000
HOT_GRAM = 20_000
#: Groups of at most so many contexts are compared pair by pair.
PAIRS = 12

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1 << 14, 2 * n), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have, dtype=np.uint64)
    return have[:n]


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of the anchors of a text."""
    data, parts = np.frombuffer(raw, np.uint8), []
    for s in range(0, len(data) - SPAN + 1, SEGMENT):
        windows = min(SEGMENT, len(data) - SPAN + 1 - s)
        seg = data[s:s + windows - 1 + SPAN].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * _powers(_MULTIPLIER, len(seg)), out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * _powers(_INVERSE, len(seg) - GRAM + 1)
        h = (h ^ (h >> np.uint64(31))) * _MIX
        least, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= REACH:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:windows], least[REACH - width:REACH - width + windows])
        place = (least & _PLACE).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate((np.zeros(1, np.int64), change))
        last = np.concatenate((change - 1, np.array([windows - 1])))
        at = place[first]
        parts.append((at + s, first + s, last + s, h[at].view(np.int64)))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shared(a: bytes, b: bytes, order: str) -> int:
    """Length of the common prefix (order 'big') or suffix ('little') of two byte strings."""
    n = min(len(a), len(b))
    if order == "big":
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    else:
        x = int.from_bytes(a[len(a) - n:], "little") ^ int.from_bytes(b[len(b) - n:], "little")
    return n - (x.bit_length() + 7) // 8


# ---- runs -------------------------------------------------------------------------------------

RUN_SCHEMA = "part int, shared binary, lengths binary, tails binary, lefts binary, left_bytes binary, counts binary, rows binary, places binary"


def encode_run(contexts: list[tuple[bytes, bytes]], places: list[list[tuple[int, int]]]) -> tuple:
    """A front-coded run of sorted (right, left) contexts."""
    shared, tails, last = bytearray(), [], b""
    for right, _ in contexts:
        n = _shared(last, right, "big")
        shared.append(n)
        tails.append(right[n:])
        last = right
    flat = np.array([p for own in places for p in own], np.int64).reshape(-1, 2)
    return (bytes(shared), bytes(len(t) for t in tails), b"".join(tails), bytes(len(x) for _, x in contexts),
            b"".join(x for _, x in contexts), np.array([len(p) for p in places], np.int32).tobytes(),
            flat[:, 0].tobytes(), flat[:, 1].tobytes())


def decode_run(shared, lengths, tails, lefts, left_bytes, counts, rows, places) -> Iterator[tuple]:
    """(prefix shared with the one before, right, left, rows, places) in order."""
    rows, places = np.frombuffer(rows, np.int64), np.frombuffer(places, np.int64)
    right, t, lo, p = b"", 0, 0, 0
    for s, n, m, c in zip(shared, lengths, lefts, np.frombuffer(counts, np.int32).tolist(), strict=True):
        right = right[:s] + tails[t:t + n]
        yield s, right, left_bytes[lo:lo + m], rows[p:p + c], places[p:p + c]
        t, lo, p = t + n, lo + m, p + c


class LoserTree:
    """Merge of sorted runs.  A player is (known prefix, run): the prefix its head shares with the
    last output.  Of two players the one with the longer known prefix is smaller, without a look
    at its bytes; with equal ones the comparison starts behind the prefix."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        n = 1
        while n < len(runs):
            n *= 2
        self.heads += [None] * (n - len(runs))
        self.size, self.nodes = n, [None] * n
        level = [(0, i) for i in range(n)]
        at = n // 2
        while len(level) > 1:
            nxt = []
            for i in range(0, len(level), 2):
                winner, loser = self._play(level[i], level[i + 1])
                self.nodes[at + i // 2] = loser
                nxt.append(winner)
            level, at = nxt, at // 2
        self.winner = level[0]

    def _play(self, x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        hx, hy = self.heads[x[1]], self.heads[y[1]]
        if hx is None or hy is None:
            return (x, y) if hy is None else (y, x)
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        a, b, k = hx[1], hy[1], x[0]
        n = k + _shared(a[k:], b[k:], "big")
        if n == len(a) or n < len(b) and a[n] < b[n]:
            return x, (n, y[1])
        return y, (n, x[1])

    def __iter__(self) -> Iterator[tuple]:
        """Heads in order, their first field the prefix shared with the head before."""
        while (head := self.heads[self.winner[1]]) is not None:
            known, run = self.winner
            yield known, *head[1:]
            head = self.heads[run] = next(self.runs[run], None)
            player, node = (head[0] if head else 0, run), (run + self.size) // 2
            while node:
                player, self.nodes[node] = self._play(player, self.nodes[node])
                node //= 2
            self.winner = player


# ---- equal windows of one group ---------------------------------------------------------------

def equal_windows(group: list[tuple], least: int = 0, most: int = SPAN) -> Iterator[tuple]:
    """(rows, starts, ends) of the windows that occur twice among suffixes sharing their gram, at offsets
    ``least`` to ``most``.  ``group``: merged (prefix shared with the one before, right, left, rows, places)."""
    contexts: dict[tuple[bytes, bytes], list] = {}
    prefix: list[int] = []  # of a context with the one before it
    running = SPAN
    for shared, right, left, rows, places in group:
        running = min(running, shared)
        own = contexts.get((right, left))
        if own is None:
            contexts[right, left] = own = [[], []]
            prefix.append(running)
            running = SPAN
        own[0].append(rows)
        own[1].append(places)
    keys = list(contexts)
    low, high = [max(least, SPAN - len(r)) for r, _ in keys], [min(most, len(x)) for _, x in keys]  # offsets of their windows
    found: list[list[tuple[int, int]]] = [[(low[i], high[i])] if sum(map(len, own[0])) > 1 else [] for i, own in enumerate(contexts.values())]
    if 1 < len(keys) <= PAIRS:
        for i in range(len(keys)):
            r = SPAN
            for j in range(i + 1, len(keys)):
                r = min(r, prefix[j])
                a = max(low[i], low[j], SPAN - r)
                b = min(high[i], high[j], _shared(keys[i][1], keys[j][1], "little"))
                if a <= b:
                    found[i].append((a, b))
                    found[j].append((a, b))
    elif len(keys) > PAIRS:
        for o in range(min(low), max(high) + 1):
            seen: dict[bytes, int] = {}
            for i, (right, left) in enumerate(keys):
                if low[i] <= o <= high[i]:
                    first = seen.setdefault(left[len(left) - o:] + right[:SPAN - o], i)
                    if first != i:
                        for k in (first, i):
                            if found[k] and found[k][-1][0] <= o <= found[k][-1][1] + 1:
                                found[k][-1] = found[k][-1][0], max(o, found[k][-1][1])
                            else:
                                found[k].append((o, o))
    for (rows, places), offsets in zip(contexts.values(), found, strict=True):
        if offsets:
            rows, places = np.concatenate(rows), np.concatenate(places)
            for a, b in offsets:
                yield rows, places - b, places - a + SPAN


# ---- Spark ------------------------------------------------------------------------------------

def _candidates(docs: DataFrame) -> DataFrame:
    """Documents with a gram that occurs twice: rid, doc_id, key, raw, grams, hot (grams); on shared files."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, key, raw in zip(cols["doc_id"], cols["key"], cols["raw"], strict=True):
                if len(raw) >= SPAN:
                    h, n = np.unique(anchors(raw)[3], return_counts=True)
                    yield doc_id, key, h.tolist(), n.astype(np.int32).tolist()

        return work

    table = stored(map_rows(docs.select("doc_id", "key", "raw"), make, f"doc_id {id_type}, key long, grams array<long>, times array<int>"), "suffix-anchors")
    grams = table.select("doc_id", "key", F.inline(F.arrays_zip(F.col("grams").alias("gram"), "times")))
    twice = grams.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram", (F.col("n") > HOT_GRAM).alias("_hot"))
    chosen = grams.join(twice, "gram").groupBy("doc_id", "key").agg(
        F.collect_set(F.when(~F.col("_hot"), F.col("gram"))).alias("grams"), F.collect_set(F.when(F.col("_hot"), F.col("gram"))).alias("hot"))
    chosen = chosen.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "grams", "hot").hint("shuffle_hash")
    rows = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["key"] == F.col("_k")))
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "key", "raw", "grams", "hot"), "suffix-documents")


def _runs(rows: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs of the candidates' contexts, by part."""

    def make():
        def flush(held: dict) -> Iterator[tuple]:
            for part, contexts in held.items():
                order = sorted(contexts)
                yield part, *encode_run(order, [contexts[c] for c in order])

        def work(cols: dict) -> Iterator[tuple]:
            held: dict[int, dict] = {}
            size = places = 0
            for rid, raw, grams in zip(cols["rid"], cols["raw"], cols["grams"], strict=True):
                at, first, last, h = anchors(raw)
                mine = np.isin(h, np.array(grams, np.int64))
                for a, f, e, g in zip(at[mine].tolist(), first[mine].tolist(), last[mine].tolist(), h[mine].tolist(), strict=True):
                    own = held.setdefault(g % parts, {})
                    context = raw[a:e + SPAN], raw[f:a]
                    there = own.get(context)
                    if there is None:
                        own[context] = [(rid, a)]
                        size += len(context[0]) + len(context[1])
                    else:
                        there.append((rid, a))
                    places += 1
                if size >= RUN_BYTES or places >= RUN_PLACES:
                    yield from flush(held)
                    held, size, places = {}, 0, 0
            yield from flush(held)

        return work

    return map_rows(rows.select("rid", "raw", "grams"), make, RUN_SCHEMA, batch=16)


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    """(rid, start, end): ranges to remove, from the merge of each part's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rid", "start", "end"])

            group: list[tuple] = []
            for head in LoserTree([decode_run(*r) for r in rows]):
                if head[0] < GRAM and group:
                    if len(group) > 1 or len(group[0][3]) > 1:
                        out += equal_windows(group)
                    group = []
                    if len(out) >= 20_000:
                        yield flush()
                group.append(head)
            out += equal_windows(group)
            if out:
                yield flush()

        now, rows = None, []
        for batch in batches:
            for part, *fields in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != now:
                    yield from solve(rows)
                    now, rows = part, []
                rows.append(tuple(fields))
        yield from solve(rows)

    return runs.repartition(max(1, parts // 4), "part").sortWithinPartitions("part").mapInArrow(run, "rid long, `start` long, `end` long")


def _hot_contexts(rows: DataFrame) -> DataFrame:
    """(right, left, rids, places): the contexts of hot grams, equal ones of a stretch of a task's rows folded."""

    def make():
        def flush(held: dict) -> Iterator[tuple]:
            for (right, left), own in held.items():
                yield right, left, [r for r, _ in own], [p for _, p in own]

        def work(cols: dict) -> Iterator[tuple]:
            held: dict[tuple[bytes, bytes], list] = {}
            size = 0
            for rid, raw, hot in zip(cols["rid"], cols["raw"], cols["hot"], strict=True):
                at, first, last, h = anchors(raw)
                mine = np.isin(h, np.array(hot, np.int64))
                for a, f, e in zip(at[mine].tolist(), first[mine].tolist(), last[mine].tolist(), strict=True):
                    held.setdefault((raw[a:e + SPAN], raw[f:a]), []).append((rid, a))
                    size += 1
                if size >= RUN_PLACES // 10:
                    yield from flush(held)
                    held, size = {}, 0
            yield from flush(held)

        return work

    chosen = rows.where(F.size("hot") > 0).select("rid", "raw", "hot")
    return map_rows(chosen, make, "`right` binary, `left` binary, rids array<long>, places array<long>", batch=1024)


def _hot_ranges(rows: DataFrame) -> DataFrame:
    """(rid, start, end): ranges to remove, among the suffixes of hot grams."""
    key = ["a", "b", "head", "tail"]

    def keyed(df: DataFrame) -> DataFrame:
        right, left = F.col("`right`"), F.col("`left`")
        return df.withColumns({"head": F.substring(right, F.lit(1), F.lit(SPAN) - F.col("b")),
                               "tail": F.substring(left, F.length(left) - F.col("a") + 1, F.col("a"))})

    open_ = stored(_hot_contexts(rows).withColumns({"a": F.lit(0), "b": F.lit(REACH - 1)}), "suffix-hot")
    small, found = [], []
    while True:
        now = keyed(open_)
        large = stored(now.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_GRAM).select(*key), "suffix-large")
        if large.isEmpty():
            small.append(now)
            break
        small.append(now.join(large, key, "left_anti"))
        split = now.join(large, key, "left_semi")
        # one window, which all contexts of the group hold
        one = split.where("a = b").select(F.inline(F.arrays_zip(F.col("rids").alias("rid"), F.col("places").alias("place"))), "a")
        found.append(one.select("rid", (F.col("place") - F.col("a")).alias("start"), (F.col("place") - F.col("a") + SPAN).alias("end")))
        middle = F.expr("(a + b) div 2").cast("int")
        halves = split.where("a < b").withColumn("h", F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b")))))
        halves = halves.select("`right`", "`left`", "rids", "places", "h.a", "h.b")
        open_ = stored(halves.where((F.lit(SPAN) - F.length("`right`") <= F.col("b")) & (F.length("`left`") >= F.col("a"))), "suffix-hot")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(group: list[dict]) -> pa.RecordBatch | None:
            merged, last = [], b""
            for g in group:
                merged.append((_shared(last, g["right"], "big"), g["right"], g["left"], np.array(g["rids"], np.int64), np.array(g["places"], np.int64)))
                last = g["right"]
            out = list(equal_windows(merged, group[0]["a"], group[0]["b"]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rid", "start", "end"]) if out else None

        now, group = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for row in batch.slice(lo, 512).to_pylist():
                    if (at := tuple(row[k] for k in key)) != now:
                        if group and (out := ranges(group)) is not None:
                            yield out
                        now, group = at, []
                    group.append(row)
        if group and (out := ranges(group)) is not None:
            yield out

    columns = [*key, "`right`", "`left`", "rids", "places"]
    todo = small[0].select(*columns)
    for more in small[1:]:
        todo = todo.unionByName(more.select(*columns))
    out = todo.repartition(*key).sortWithinPartitions(*key, "`right`", "`left`").mapInArrow(solve, "rid long, `start` long, `end` long")
    for more in found:
        out = out.unionByName(more)
    return out


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), spans, n_removed and the SHA-256 of the bytes that stay, of the documents that lose bytes.
    ``docs``: (doc_id, key, raw)."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # several to a task evens them out
    rows = _candidates(docs)
    ranges = stored(_merged(_runs(rows, parts), parts).unionByName(_hot_ranges(rows)), "suffix-ranges")
    per_row = ranges.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, key, raw, own in zip(cols["doc_id"], cols["key"], cols["raw"], cols["ranges"], strict=True):
                spans = union([(r["start"], r["end"]) for r in own])
                digest, at = sha256(), 0
                for s, e in spans:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                yield doc_id, key, [{"start": s, "end": e} for s, e in spans], sum(e - s for s, e in spans), digest.hexdigest()

        return work

    joined = rows.select("rid", "doc_id", "key", "raw").join(per_row.hint("shuffle_hash"), "rid").select("doc_id", "key", "raw", "ranges")
    return map_rows(joined, make, f"doc_id {id_type}, key long, spans array<struct<start:long,end:long>>, n_removed long, kept_sha256 string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    lost = repeated_spans(keyed.select("doc_id", "key", F.col("text").cast("binary").alias("raw")))
    lost = lost.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans", "n_removed", "kept_sha256")
    base = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_sha"))
    out = base.join(lost, base["doc_id"].eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.size(spans).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), spans.alias("spans"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")
