import random
from collections import defaultdict

import numpy as np
import pytest

from sitefold.llm import components, jaccard_join
from tests.llm.cases import SCHEMA, edge_rows, frame, prose, random_rows


def _set(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _brute(rows, k, percent):
    """Components of documents, by id; ids join what they hold."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, _set(t, k)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(_set(t, k)), None if i is None else find(i)) for i, t in rows), key=str)


@pytest.mark.parametrize(("k", "percent", "chunk"), [(3, 90, 256), (5, 80, 256), (3, 60, 4)])
def test_components_against_brute_force(spark, monkeypatch, k, percent, chunk):
    """Also with tiny chunks, so that every pass runs."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", chunk * 50)
    rows = edge_rows() + [(500 + i, t) for i, t in random_rows(9, 120)]
    out = jaccard_join.components_of_links(frame(spark, rows), k, percent).collect()
    assert sorted(map(tuple, out), key=str) == _brute(rows, k, percent)


def test_large_group_of_near_copies(spark, monkeypatch):
    """A group of near copies well beyond a chunk, with one chain of links that only a complete comparison finds."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "CHUNK_TOKENS", 8 * 198)
    base = prose(1, 200).split()
    rng = random.Random(2)
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(200)] = prose(rng.randrange(1 << 30), 1)
        rows.append((i, " ".join(w)))
    out = jaccard_join.components_of_links(frame(spark, rows), 3, 90).collect()
    assert sorted(map(tuple, out), key=str) == _brute(rows, 3, 90)


def test_empty_table(spark):
    assert jaccard_join.components_of_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each(spark):
    docs = frame(spark)
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 6 in ids and not {7, 8, 11} & set(ids) and {1, 2, 3} <= set(ids) and None in ids


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("leaf", [3, 64])
def test_signature_tree_finds_every_link(seed, leaf, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "FANOUT", 3)
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 62, 400, np.uint64)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.6:
            s = sets[rng.integers(len(sets))]
            s = np.unique(np.concatenate((s[rng.random(len(s)) < 0.95], rng.choice(pool, rng.integers(0, 4)))))
        else:
            s = np.unique(rng.choice(pool, rng.integers(5, 120)))
        sets.append(s)
    sets.sort(key=len)
    want = {(i, j) for j in range(60) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    tree = jaccard_join.SignatureTree(sets, 80)
    got = list(tree.links(list(range(60))))
    assert {(min(p), max(p)) for p in got} <= want

    def classes(pairs):
        label = list(range(60))
        for _ in range(60):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    assert classes(got) == classes(want) and len(got) <= 59


def test_shingles_equal_plain_sets():
    for _, text in edge_rows():
        for k in (3, 5):
            assert len(jaccard_join.shingles((text or "").encode(), k)) == len(_set(text, k))
    a, b = (set(jaccard_join.shingles(t.encode(), 3).tolist()) for t in ("x one two three y", "zz one two  three"))
    assert len(a & b) == 1


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    label = defaultdict(lambda: None)
    for v in {x for e in edges for x in e}:
        label[v] = v
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["a"]: r["b"] for r in out} == {v: c for v, c in label.items() if v != c}
