import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from sitefold.llm import decontaminate, packing
from tests.llm.cases import SCHEMA, edge_rows, frame, prose, random_rows


def test_packing_round_trip(spark):
    rows = edge_rows() + [(200 + i, t) for i, t in random_rows(1, 60)] + [(400, "a <|endoftext|> b")]
    out = packing.pack(frame(spark, rows)).collect()
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s:s + 2048]
            want[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_white_space(spark):
    """Two million characters of white space, beyond what the fast encoder takes."""
    rows = [(1, "\n" * 2_000_000), (2, "a" + " " * 2_000_000 + "b"), (3, "plain")]
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert sorted((r["doc_id"], r["sum(length)"]) for r in out) == want == sorted((r["doc_id"], r["max(doc_tokens)"]) for r in out)


@pytest.mark.parametrize("seed", range(4))
def test_pack_histogram(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 30), rng.integers(1, 200, 30), strict=True)}
    fill = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, first, offset in packing.pack_histogram(counts, 100):
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            fill[s].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    used = sum(k * n for k, n in counts.items())
    assert len(fill) <= -(-used // 100) * 11 // 9 + 1


# ---- decontamination

def _brute(rows, items, width=10):
    wins = defaultdict(set)
    for item, text in items:
        w = decontaminate.words_of((text or "").encode())
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[i:i + width])].add("" if item is None else str(item))
    out = []
    for i, t in rows:
        w = decontaminate.words_of((t or "").encode())
        hit, own = set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[p:p + n]))):
                    hit |= set(range(p, p + n))
                    own |= found
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()))
    return sorted(out, key=str)


ITEMS = [(1, prose(50, 30)), (2, prose(51, 4)), (10, None), (11, ""), (12, "!!"), (13, prose(50, 30)), (None, prose(52, 12)), (20, "ala " * 12)]


def _documents():
    return edge_rows() + [(300, prose(60, 30) + ", " + prose(50, 30).upper() + " " + prose(61, 9)), (301, prose(51, 4)),
                          (302, prose(50, 30)[40:]), (303, prose(52, 12) * 2), (304, "ala-" * 15), (305, "ala " * 9),
                          (306, " ".join(prose(50, 30).split()[:9]))]


@pytest.mark.parametrize("block", [500_000, 7])
def test_contamination_against_brute_force(spark, block):
    rows = _documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.contamination(frame(spark, rows), items, block_windows=block).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in out), key=str)
    assert got == _brute(rows, ITEMS)


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(frame(spark), none).collect())
    assert decontaminate.contamination(spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_clean_and_proximity(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = _documents()
    docs = frame(spark, rows)
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((r[0] for r in _brute(rows, ITEMS) if not r[2]), key=str)
    w = prose(50, 30).split()
    near = frame(spark, [(1, " ".join(w[:5] + ["filler"] + w[5:])), (2, prose(99, 30))])
    found = {r["doc_id"] for r in decontaminate.proximity_matches(near, items.where("item_id = 1")).collect()}
    assert 1 in found


def _brute_near(rows, items, slop):
    """(doc, item, start, gap) over all windows: rarest two terms by count, offset and name."""
    words = [(i, [x.decode() for x in decontaminate.words_of((t or "").encode())]) for i, t in rows]
    count = defaultdict(int)
    for _, w in words:
        for x in w:
            count[x] += 1
    out = set()
    for item, t in items:
        own = [x.decode() for x in decontaminate.words_of((t or "").encode())]
        for p in range(max(1, len(own) - 9) if own else 0):
            ranked = sorted((count[x], k, x) for k, x in enumerate(own[p:p + 10]))
            (n, a, first), (_, b, second) = ranked[0], ranked[min(1, len(ranked) - 1)]
            for doc, w in words if n else ():
                starts = [i - b for i, x in enumerate(w) if x == second]
                out |= {(doc, "" if item is None else str(item), i - a, s - i + a) for i, x in enumerate(w) if x == first for s in starts if abs(s - i + a) <= slop}
    return out


@pytest.mark.parametrize("block", [500_000, 7])
def test_proximity_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [r for r in _documents() if len(r[1] or "") < 10_000]
    for i in range(25):  # passages with words put in and taken out
        w = prose(50, 30).split()
        at = int(rng.integers(2, 28))
        rows.append((400 + i, " ".join(w[:at] + ["filler"] * int(rng.integers(0, 7)) + w[at + int(rng.integers(0, 2)):])))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.proximity_matches(frame(spark, rows), items, block_windows=block).collect()
    want = _brute_near(rows, ITEMS, decontaminate.SLOP)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    near = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(frame(spark, rows), items, block_windows=block).collect() if r["doc_id"] not in (9, None)}
    assert near == {i: len({m[1] for m in want if m[0] == i}) for i in near}
