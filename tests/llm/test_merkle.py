import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitefold.llm import merkle
from tests.llm.cases import edge_rows, prose

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, at string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def tree(nodes):
    """(top, siblings of each node from the bottom up, with its place in the run)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            paths[k].append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
            at[k] = i // 3
        nodes = [h(*r) for r in runs]
    return nodes[0] if nodes else None, paths


def brute(rows, altered):
    """The contract's columns of ``rows`` (doc_id, source, lang, n_chars, text), plainly."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), leaf_of(r, altered(r)), r[0]))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, paths = {}, {}
    for s in sources:
        groups[s].sort(key=lambda g: g[:4])
        tops[s], paths[s] = tree([g[2] for g in groups[s]])
    root, above = tree([tops[s] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for g, path in zip(groups[s], paths[s], strict=True):
            folded = g[3]
            for place, siblings in (whole := path + above[i]):
                folded = h(*siblings[:place], folded, *siblings[place:])
            out.append((g[4], g[2], tops[s], root, h(*[x for _, run in whole for x in run]), folded, folded == root))
    return sorted(out, key=str)


def without_newlines(r):
    crc = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
    return r[4].replace("\n", "") if r[4] is not None and crc % 2 == 0 else r[4]


def tables():
    edges = [(i, [None, "", "b", "Z", "é", "\U0001f600", "￿"][k % 7], None if k % 5 == 0 else "xx", None if k % 4 == 0 else k, t)
             for k, (i, t) in enumerate(edge_rows())]
    hot = [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"text {i}\nmore") for i in range(3100)]
    return {"edges": edges + edges[5:9], "hot": hot, "one": hot[:1], "few": hot[:2], "many sources": [(i, f"s{i}", None, 0, "x") for i in range(1500)]}


@pytest.mark.parametrize("name", ["edges", "hot", "one", "few", "many sources"])
def test_against_brute_force(spark, tmp_path, name):
    rows = tables()[name]
    spark.createDataFrame([(*r, "l", 3, "a") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, without_newlines)


def test_proofs_fold_to_the_root(spark):
    rows = [(i, f"s{i % 4}", "en", 1, prose(i, 5)) for i in range(60)]
    docs = spark.createDataFrame([(*r, "l", 3, "a") for r in rows], SCHEMA)
    for r in merkle.manifest(docs).collect():
        folded = r["leaf"]
        for place, siblings in r["proof"]:
            folded = h(*siblings[:place], folded, *siblings[place:])
        assert folded == r["root"] == r["folded_root"] and r["verified"]
    changed = merkle.manifest(docs, F.concat("text", F.lit("!")), proofs=False)
    assert not any(r["verified"] for r in changed.collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(docs).collect() == []
    assert merkle.manifest(docs).columns[-1] == "proof"


def test_sweeps_of_one_block():
    nodes = [bytes([i]) * 32 for i in range(20)]
    top, paths = tree([n.hex() for n in nodes])
    levels = merkle._sweep_up(nodes, True)
    assert [len(levels[k]) for k in sorted(levels)] == [20, 7, 3, 1] and levels[3][0].hex() == top
    for suffix, path in zip(merkle._sweep_down(levels, b""), paths, strict=True):
        assert [(p, [s.hex() for s in run]) for p, run in merkle.steps(suffix)] == path
    assert len(merkle._sweep_up(nodes[:1], False)) == merkle.LEVELS + 1  # the tree goes on beyond its last block
