import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitefold.llm import periodic
from sitefold.llm.common import word_spans
from tests.llm.cases import edge_rows, frame, prose


def brute(words, least=12):
    """All stretches of each period, by comparing words; of equal stretches the least period."""
    runs = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - a + q >= max(least, 2 * q):
                runs[a, i + q] = min(q, runs.get((a, i + q), q))
    return sorted((a, b - a, q) for (a, b), q in runs.items())


def random_words(rng):
    n, k = rng.randint(0, 150), rng.choice([1, 2, 2, 3, 5, 30])
    w = [b"w%d" % rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = b"x"
    return w + w[:n // 2] + w if n and rng.random() < 0.2 else w


@pytest.mark.parametrize("batch", [1, 7, 1 << 14])
def test_runs_of_random_words(batch):
    rng = random.Random(batch)
    for _ in range(250):
        w = random_words(rng)
        assert periodic.find_runs(periodic.Words(b" ".join(w)), batch=batch) == brute(w)


def test_runs_of_special_words():
    x, y = [b"a"], [b"a", b"b"]
    while len(y) < 700:
        x, y = y, y + x
    square = [b"%d" % i for i in range(300)]
    for w in (y, [b"a"] * 500, square * 2, square * 2 + [b"x"] + square * 3, [b"%d" % (i // 13) for i in range(400)],
              [b"a", b"b"] * 6, [b"a"] * 11, ([b"a"] * 5 + [b"b"]) * 40):
        for batch in (5, 64, 1 << 14):
            assert periodic.find_runs(periodic.Words(b" ".join(w)), batch=batch) == brute(w)


def test_long_periodic_text():
    """A million equal words, and a period of a thousand: linear, not by pairs."""
    assert periodic.find_runs(periodic.Words(b"na " * 1_000_000)) == [(0, 1_000_000, 1)]
    rng = random.Random(1)
    block = [b"%d" % rng.randrange(5000) for _ in range(1000)]
    assert periodic.find_runs(periodic.Words(b" ".join(block * 100))) == [(0, 100_000, 1000)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \t\n\x0bé ", max_size=40), st.integers(1, 9))
def test_words_by_segments(text, segment):
    raw = text.encode()
    parts = [[(int(a), int(b), int(h)) for s in word_spans(raw, n) for a, b, h in zip(*s, strict=True)] for n in (segment, 1 << 18)]
    assert parts[0] == parts[1]
    assert [raw[a:b] for a, b, _ in parts[0]] == raw.split()
    hashes = {}
    assert all(hashes.setdefault(raw[a:b], h) == h for a, b, h in parts[0]) and len(set(hashes.values())) == len(hashes)


def test_equal_hashes_of_different_words(monkeypatch):
    """If two words share a hash, the runs are found again with another one."""
    plain = periodic.word_spans
    monkeypatch.setattr(periodic, "word_spans", lambda raw: ((s, e, np.zeros_like(h)) for s, e, h in plain(raw)))
    words = [b"%d" % i for i in range(40)] + [b"a"] * 20
    assert periodic.describe(b" ".join(words))[0] == [(40, 20, 1)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for r in edge_rows() if len(r[1] or "") < 10_000] + [(100 + i, b" ".join(random_words(rng)).decode()) for i in range(80)]
    rows += [(300 + i, prose(i, 200)) for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert any(r["n_runs"] > 1 for r in out)


def test_collapsed_texts(spark):
    docs = frame(spark, [(1, "go  on " + "la di " * 30 + "end"), (2, None), (3, "plain words")])
    got = {r["doc_id"]: (r["text"], [tuple(x) for x in r["runs"]]) for r in periodic.collapsed(docs).collect()}
    assert got == {1: ("go on la di end", [(2, 60, 2)]), 2: ("", []), 3: ("plain words", [])}
    assert periodic.collapsed(docs.limit(0)).collect() == []
