"""Periodic runs of words, by online dyadic square catching.

A run of period q is a maximal stretch of words in which words q apart agree; it starts with a
square (two equal halves of q words).  The words of a text are appended a batch at a time:

* *Catchers.*  Whenever a block of 2^k words is complete it gets a catcher, which waits for the
  block to come again ``2^(k+1) - 1`` to ``2^(k+2) - 2`` words later: the first half of every square
  with such a period holds a whole block.  (Blocks of four words, one at every second word, wait
  for all periods up to 14, since the shortest run has 12 words.)
* *Suffix comparisons.*  Each appended word completes one suffix of 2^k words for each k; its
  fingerprint is compared with those of the two blocks whose catchers wait for it at that moment.
  A batch compares the suffixes of all its words at once, so an appended word costs
  O(log n) comparisons of fingerprints and no more memory than two longs.
* *Merging.*  A catch is a square's period and a place in it.  Word hashes are compared to the left
  and to the right of it, as far as they agree; what reaches the end of the text so far stays open
  and goes on with the next batch.  Catches inside a stretch that is known, or whose period is a
  multiple of the one of a known run around them, are part of that and skipped.

A fingerprint only proposes places; stretches are found by comparing 64-bit word hashes, and the
words of each run are compared byte by byte in the end (another hash is tried if two differ).

Defined cases: a null or empty text has no word and no run; a null id counts as the empty text in
the checksum; repeated rows give equal results.  A task holds one text, the places and hashes of
its words (32 bytes a word, 52 if it is made periodic) and the comparisons of one batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import SQL_CRC, map_rows, powers, sql_crc32, text_of, word_spans

LEAST_WORDS = 12
BATCH = 1 << 14
#: An odd multiplier for the fingerprints of suffixes.
POINT = 0xD6E8FEB86659FD93
_LOW = 10  # POINT^x is looked up by the low and the high bits of x


def _point_power(x: np.ndarray) -> np.ndarray:
    high = powers(pow(POINT, 1 << _LOW, 1 << 64), (int(x.max()) >> _LOW) + 1)
    return high[x >> _LOW] * powers(POINT, 1 << _LOW)[x & ((1 << _LOW) - 1)]


class SquareCatcher:
    """The runs of a growing sequence of 64-bit word hashes."""

    def __init__(self, capacity: int, least: int = LEAST_WORDS):
        self.least, self.n = least, 0
        self.words = np.empty(capacity, np.uint64)
        self.prefix = np.zeros(capacity + 1, np.uint64)  # fingerprint of words[:i], relative to word 0
        self.stretches: dict[int, list[int]] = {}  # period -> latest stretch [start, end, 1 if a run] of words that agree with the one a period on
        self.open: set[int] = set()  # periods whose stretch reaches the end
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> least period

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        self.words[old:self.n] = words
        np.cumsum(words * _point_power(np.arange(old, self.n)), out=self.prefix[old + 1:self.n + 1])
        self.prefix[old + 1:self.n + 1] += self.prefix[old]
        for p in sorted(self.open):
            s = self.stretches[p]
            s[1] = self._right(s[1], p)
            self._settle(p)
        lag, at, size = self._catches(old)
        while len(lag):
            p = int(lag[0])
            mine = int(np.searchsorted(lag, p, side="right"))
            self._merge(p, at[:mine], size[:mine])
            lag, at, size = lag[mine:], at[mine:], size[mine:]
            if len(lag) and p in self.stretches and self.stretches[p][2]:
                # what a run holds again at multiples of its period is nothing new
                a, b, _ = self.stretches[p]
                new = (lag % p != 0) | (at < a) | (at + lag + size > b + p)
                lag, at, size = lag[new], at[new], size[new]

    def _catches(self, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(period, block start, block size) of what the suffixes of the new words catch, by period."""
        size, out = 4, []
        while True:
            step = 2 if size == 4 else size
            near, far = (1, 15) if size == 4 else (2 * size - 1, 4 * size - 1)
            t = np.arange(max(near, old - size + 1), self.n - size + 1)  # starts of the new suffixes
            if not len(t):
                if near + size > self.n:
                    break
                size *= 2
                continue
            # the fingerprint of words s .. s + size is that difference times POINT^-s; compared as
            # difference(s) * POINT^(t - s) == difference(t)
            d = self.prefix[t + size] - self.prefix[t]
            for j in range(-(-(far - near) // step)):
                s = ((t - near) // step - j) * step
                ok = (s >= 0) & (t - s < far)
                lag = np.where(ok, t - s, 0)
                s = np.where(ok, s, 0)
                same = np.flatnonzero(ok & ((self.prefix[s + size] - self.prefix[s]) * _point_power(lag) == d))
                if len(same):
                    out.append((lag[same], s[same], np.full(len(same), size)))
            size *= 2
        if not out:
            return (np.empty(0, np.int64),) * 3
        lag, at, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
        # known runs that reach into the batch
        for p in [p for p, s in self.stretches.items() if s[2] and s[1] + p > old]:
            a, b, _ = self.stretches[p]
            new = (lag % p != 0) | (at < a) | (at + lag + sizes > b + p)
            lag, at, sizes = lag[new], at[new], sizes[new]
        order = np.lexsort((at, lag))
        return lag[order], at[order], sizes[order]

    def _merge(self, p: int, at: np.ndarray, size: np.ndarray) -> None:
        """The catches of one period, in order, as stretches."""
        i = 0
        while i < len(at):
            last = self.stretches.get(p)
            if last and last[0] <= at[i] < last[1]:
                i = max(i + 1, int(np.searchsorted(at, last[1])))
                continue
            s = int(at[i])
            if not np.array_equal(self.words[s:s + size[i]], self.words[s + p:s + p + size[i]]):
                i += 1  # equal fingerprints of different words
                continue
            self.stretches[p] = [self._left(s, p), self._right(s + int(size[i]), p), 0]
            self._settle(p)
            i += 1

    def _settle(self, p: int) -> None:
        """The latest stretch of a period is as long as it can be so far: a run, if long enough."""
        s = self.stretches[p]
        start, end = s[0], s[1] + p
        if end == self.n:
            self.open.add(p)
        else:
            self.open.discard(p)
        if end - start >= max(self.least, 2 * p):
            s[2] = 1
            if end < self.n:
                self._report(start, end, p)

    def _report(self, start: int, end: int, p: int) -> None:
        self.found[start, end] = min(p, self.found.get((start, end), p))

    def _right(self, x: int, p: int) -> int:
        step = 16
        while x < self.n - p:
            stop = min(x + step, self.n - p)
            differ = self.words[x:stop] != self.words[x + p:stop + p]
            if differ.any():
                return x + int(differ.argmax())
            x, step = stop, min(2 * step, BATCH)
        return x

    def _left(self, x: int, p: int) -> int:
        step = 16
        while x > 0:
            stop = max(x - step, 0)
            differ = self.words[stop:x] != self.words[stop + p:x + p]
            if differ.any():
                return x - int(differ[::-1].argmax())
            x, step = stop, min(2 * step, BATCH)
        return x

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start, then period.  Of periods with one stretch
        the least is the run's: the others are its multiples."""
        for p in self.open:
            s = self.stretches[p]
            if s[2]:
                self._report(s[0], s[1] + p, p)
        return sorted((a, b - a, p) for (a, b), p in self.found.items())


class Words:
    """The words of a text: places in its bytes and hashes, in the order of ``order`` if given."""

    def __init__(self, raw: bytes, seed: int = 0):
        parts = list(word_spans(raw))
        self.raw = raw
        self.starts, self.ends = (np.concatenate([p[k].astype(np.uint32) for p in parts]) if parts else np.empty(0, np.uint32) for k in (0, 1))
        self.hashes = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.uint64)
        if seed:  # hashes of other bytes-to-numbers: used if two words of a run share one
            self.hashes = np.array([int.from_bytes(hashlib.blake2b(self[i], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
                                    for i in range(len(self.starts))], np.uint64)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.starts[i]:self.ends[i]]

    def joined(self, chosen: np.ndarray) -> Iterator[bytes]:
        """The text of the chosen words with one space between two, some words at a time."""
        for lo in range(0, len(chosen), 4096):
            at = chosen[lo:lo + 4096]
            ends = zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)
            yield (b" " if lo else b"") + b" ".join([self.raw[a:b] for a, b in ends])

    def take(self, order: np.ndarray) -> Words:
        out = object.__new__(Words)
        out.raw, out.starts, out.ends, out.hashes = self.raw, self.starts[order], self.ends[order], self.hashes[order]
        return out


def periodic_order(n: int, checksum: int) -> np.ndarray:
    """The order of words that makes a text of ``n`` words periodic from some word on."""
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def find_runs(words: Words, least: int = LEAST_WORDS, batch: int = BATCH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words."""
    catcher = SquareCatcher(len(words), least)
    for lo in range(0, len(words), batch):
        catcher.append(words.hashes[lo:lo + batch])
    return catcher.runs()


def _true(words: Words, runs: list[tuple[int, int, int]]) -> bool:
    return all(words[i] == words[i + q] for start, length, q in runs for i in range(start, start + length - q))


def describe(raw: bytes, checksum: int | None = None, least: int = LEAST_WORDS) -> tuple[list[tuple[int, int, int]], Iterator[bytes]]:
    """The runs of a text, and in pieces the text that stays when every run is cut to its first period.
    ``checksum``: make the text periodic first (see ``periodic_order``)."""
    words, seed = Words(raw), 0
    order = periodic_order(len(words), checksum) if checksum is not None and len(words) else None
    while True:
        mine = words if order is None else words.take(order)
        runs = find_runs(mine, least)
        if _true(mine, runs):
            break
        seed += 1
        words = Words(raw, seed)
    keep = np.ones(len(mine), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return runs, mine.joined(np.flatnonzero(keep))


def collapsed(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Per document of ``docs``: doc_id, its runs (start, length, period) and its text with every
    run cut to its first period, words joined by one space."""

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, raw in zip(cols["doc_id"], cols["text"], strict=True):
                runs, kept = describe(raw, least=least)
                yield doc_id, [{"start": s, "length": n, "period": q} for s, n, q in runs], b"".join(kept).decode()

        return work

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    return map_rows(rows, make, f"doc_id {id_type}, runs array<struct<start: long, length: long, period: long>>, text string", batch=64)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def make():
        def work(cols: dict) -> Iterator[tuple]:
            for doc_id, raw in zip(cols["doc_id"], cols["text"], strict=True):
                h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
                runs, kept = describe(raw, h if h % 10 == 0 else None)
                listed, rest = hashlib.sha256(), hashlib.sha256()
                for run in runs:
                    listed.update(b"%d,%d,%d\n" % run)
                for piece in kept:
                    rest.update(piece)
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                yield doc_id, len(runs), *best, listed.hexdigest(), rest.hexdigest()

        return work

    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                "runs_sha256 string, collapsed_sha256 string")


OP13_SQL = f"""
WITH {SQL_CRC},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {sql_crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents, crc),
m AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM d),
o AS (SELECT doc_id, n, CASE WHEN g IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i
        ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) END AS w FROM m),
t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM o),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t AS x JOIN t AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                  arg_max({{'start': start, 'length': length, 'period': period}}, {{'l': length, 's': -start, 'p': -period}}) AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
