import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sitefold.llm import suffix_dedup as S
from tests.llm.cases import SCHEMA, edge_rows, frame, prose, random_rows


def _brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + S.SPAN] for _, b in raws for p in range(len(b) - S.SPAN + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - S.SPAN + 1):
            if seen[b[p:p + S.SPAN]] > 1:
                gone[p:p + S.SPAN] = b"\1" * S.SPAN
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _corpus(seed):
    """Copies, near copies, passages around the span's length, periodic and multi-byte texts."""
    rng = random.Random(seed)
    passage = prose(seed, 60)
    rows = random_rows(seed, 40)
    rows += [(1000 + i, prose(rng.randrange(1 << 30), 10) + passage[:n] + prose(rng.randrange(1 << 30), 10)) for i, n in enumerate([198, 199, 200, 201, 202, 260, 400] * 2)]
    rows += [(1100, "ab" * 300), (1101, "xab" * 200), (1102, "é\U0001f600ñ" * 60), (1103, "q" * 199), (1104, "q" * 199), (1105, "z" * 200), (1106, "z" * 201)]
    rows += [(1200 + i, f"{i:04d} " + passage + f" {i:04d}" * 20) for i in range(40)]  # a group beyond PAIRS
    return rows


@pytest.mark.parametrize("rows", [edge_rows(), _corpus(1), _corpus(2)])
def test_removed_bytes_against_brute_force(spark, rows):
    out = S.suffix_dedup(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str) == _brute(rows)


def test_many_small_runs_and_segments(spark, monkeypatch):
    """Runs of a few places and segments shorter than a text change nothing.  The functions go to
    the tasks by value, with these settings."""
    monkeypatch.setattr(S, "RUN_PLACES", 5)
    monkeypatch.setattr(S, "SEGMENT", 300)
    rows = _corpus(3)
    out = S.suffix_dedup(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str) == _brute(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_hot_grams(spark, monkeypatch, most):
    """Grams beyond the bound go by windows: all of them, and a mixture."""
    monkeypatch.setattr(S, "HOT_GRAM", most)
    rows = _corpus(4)
    out = S.suffix_dedup(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str) == _brute(rows)


def test_a_gram_in_a_third_of_all_documents(spark, monkeypatch):
    """The ends of a common passage: contexts that differ after some bytes on either side, in groups that
    are halved again and again, some down to one window."""
    monkeypatch.setattr(S, "HOT_GRAM", 8)
    rng = random.Random(8)
    passage = prose(30, 80)
    rows = [(i, prose(i, 30)) for i in range(60)]
    rows += [(100 + i, prose(200 + i, rng.randint(1, 12)) + " " + passage[rng.choice([0, 0, 3, 40]):rng.choice([300, 420, 900])] + " " + prose(300 + i, 12)) for i in range(40)]
    rows += [(200 + i, f"{i} " + (passage + " ") * 3) for i in range(12)]  # a gram that recurs in its documents
    out = S.suffix_dedup(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str) == _brute(rows)


def test_empty_table(spark):
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_loser_tree_merges_with_prefixes(seed):
    rng = random.Random(seed)
    runs, every = [], []
    for _ in range(rng.randint(1, 9)):
        own = sorted({"".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(rng.randint(0, 30))})
        every += own
        fields = S.encode_run([(x, b"l" + x) for x in own], [[(7, len(x))] for x in own])
        assert [h[1] for h in S.decode_run(*fields)] == own
        runs.append(S.decode_run(*fields))
    out = list(S.LoserTree(runs)) if runs else []
    assert [h[1] for h in out] == sorted(every)
    for a, b in zip(out, out[1:], strict=False):
        shared = next((i for i, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
        assert b[0] == shared and b[2] == b"l" + b[1]


def test_anchors_follow_content():
    a, b = prose(1, 200).encode(), (prose(9, 37) + prose(1, 200)).encode()
    shift = len(b) - len(a)
    own = {(p, h) for p, _, _, h in zip(*S.anchors(a), strict=True)}
    there = {(p - shift, h) for p, _, _, h in zip(*S.anchors(b), strict=True)}
    assert len(own - there) <= 1  # but for the first windows, that b's prefix shares
    place, first, last, _ = S.anchors(a)
    assert first[0] == 0 and last[-1] == len(a) - S.SPAN and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place <= first + S.SPAN - S.GRAM).all()
    assert len(place) < len(a) / 40
    assert np.all(np.diff(place) > 0)
