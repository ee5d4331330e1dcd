"""Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf.  The leaves of a source, by id, are the bottom of a tree in which each run of
three neighbours has their digest above it; the trees' tops, by source, are the leaves of one more
tree with the same rule.  A leaf's proof is the siblings on its way up.

A node's label is (tree, level, position).  The *upward sweep* goes through the labels in
order: a priority queue ordered by label delivers the children's digests to their parent, which
sends its own digest on.  The *reversed sweep* goes from the root down: a node receives the
proof suffix that all leaves under it share, puts the siblings of each child in front of it and
sends that on to the child, until a suffix at a leaf is its whole proof.

The queue is larger than any memory, so it has two parts.  The near part is a heap in a task, for
the ``LEVELS`` levels of a block of 3^LEVELS neighbouring nodes.  The far part lies on shared files:
what leaves a block, one digest upwards or one suffix downwards, waits there for the round that
handles its label, and arrives sorted by label.  So the leaves cross the network once per sweep,
log(n) / LEVELS rounds follow with 3^LEVELS times fewer messages each, and a source with a third
of all rows is as many blocks as its rows make.

Leaves are numbered by one range partition of (source, id) and the counts of its tasks.  Texts
never move: they are hashed where they are scanned.

Defined cases: nulls of any column hash as "-"; ids ascend with null first, rows with equal ids of one
source by their leaf's digest; repeated rows are leaves of their own; an empty table has no root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import SQL_CRC, fold, numbered, sql_crc32, stored

ARITY = 3
LEVELS = 6
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """A row's leaf as 32 bytes; ``text`` in place of the row's own."""
    parts = [_field(text if text is not None and name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digest(children: list[bytes]) -> bytes:
    """H of digests, which are joined as lowercase hex."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _sweep_up(nodes: list[bytes], single: bool) -> dict[int, list[bytes]]:
    """The digests of a block by level, from its bottom ``nodes``: as many levels as the block has,
    or, if its tree ends in it (``single``), until one node remains."""
    levels = {0: nodes}
    queue = [(1, i // ARITY, i % ARITY, d) for i, d in enumerate(nodes)]  # sorted, so a heap
    while queue:
        level, at = queue[0][:2]
        if level > LEVELS or (single and len(levels[level - 1]) == 1):
            break
        children = []
        while queue and queue[0][:2] == (level, at):
            children.append(heapq.heappop(queue)[3])
        own = digest(children)
        levels.setdefault(level, []).append(own)
        heapq.heappush(queue, (level + 1, at // ARITY, at % ARITY, own))
    return levels


def _sweep_down(levels: dict[int, list[bytes]], suffix: bytes) -> list[bytes]:
    """The proof suffixes of a block's bottom nodes, from the one of its top."""
    queue, out = [(-max(levels), 0, suffix)], [b""] * len(levels[0])
    while queue:
        level, at, own = heapq.heappop(queue)
        if not level:
            out[at] = own
            continue
        run = levels[-level - 1][at * ARITY:(at + 1) * ARITY]
        for i in range(len(run)):
            siblings = run[:i] + run[i + 1:]
            heapq.heappush(queue, (level + 1, at * ARITY + i, bytes([i, len(siblings)]) + b"".join(siblings) + own))
    return out


def steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings) of a proof, level by level; a suffix holds them as one byte
    each for the place and the number of siblings, and 32 bytes for each sibling."""
    at = 0
    while at < len(proof):
        end = at + 2 + 32 * proof[at + 1]
        yield proof[at], [proof[i:i + 32] for i in range(at + 2, end, 32)]
        at = end


def fold_proof(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings make."""
    for place, siblings in steps(proof):
        leaf = digest([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def _by_block(rows: DataFrame, solve: Callable[[list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``solve`` over the rows of each (tree, block), in order of ``at``; a task holds one block."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)

        def solved(group: list[dict]) -> pa.RecordBatch:
            cols = list(zip(*solve(group), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        now, group = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for row in batch.slice(lo, 512).to_pylist():
                    if (row["tree"], row["block"]) != now:
                        if group:
                            yield solved(group)
                        now, group = (row["tree"], row["block"]), []
                    group.append(row)
        if group:
            yield solved(group)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(run, kind)


def _blocks() -> tuple[Column, Column]:
    return F.expr(f"at div {BLOCK}").alias("block"), F.expr(f"at % {BLOCK}").alias("at")


def _climb(nodes: DataFrame, rounds: int) -> list[DataFrame]:
    """The upward sweep: the nodes (tree, at, n, digest) at the bottom of each round, ``n`` being the
    number of a tree's nodes there; in the last one every tree has one node."""
    out = [nodes]

    def solve(group: list[dict]) -> Iterator[tuple]:
        n = group[0]["n"]
        top = _sweep_up([g["digest"] for g in group], n <= BLOCK)
        yield group[0]["tree"], group[0]["block"], -(-n // BLOCK), top[max(top)][0]

    for _ in range(rounds):
        rows = out[-1].select("tree", *_blocks(), "n", "digest")
        out.append(stored(_by_block(rows, solve, "tree long, at long, n long, digest binary"), "merkle-up"))
    return out


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, more: list[str]) -> DataFrame:
    """Rows of a round's blocks, behind one row (at -1) with what the block's top has received:
    ``suffixes`` (tree, at, suffix, subroot), where ``at`` is the block."""
    kind = nodes.schema
    given = suffixes.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"),
                            F.lit(None).cast("binary").alias("digest"), *[F.lit(None).cast(kind[m].dataType).alias(m) for m in more],
                            "suffix", "subroot")
    own = nodes.select("tree", *_blocks(), "n", "digest", *more, F.lit(None).cast("binary").alias("suffix"), F.lit(None).cast("binary").alias("subroot"))
    return own.unionByName(given)


def _descend(levels: list[DataFrame], suffixes: DataFrame, down_to: int) -> DataFrame:
    """The reversed sweep, to the bottom nodes of round ``down_to``: (tree, at, suffix, subroot)."""

    def solve(group: list[dict]) -> Iterator[tuple]:
        top, nodes = group[0], group[1:]
        downs = _sweep_down(_sweep_up([g["digest"] for g in nodes], nodes[0]["n"] <= BLOCK), top["suffix"])
        for g, suffix in zip(nodes, downs, strict=True):
            yield top["tree"], top["block"] * BLOCK + g["at"], suffix, top["subroot"]

    for nodes in reversed(levels[down_to:-1]):
        rows = _with_suffixes(nodes, suffixes, [])
        suffixes = stored(_by_block(rows, solve, "tree long, at long, suffix binary, subroot binary"), "merkle-down")
    return suffixes


def _rounds(most: int) -> int:
    n = 0
    while most > 1:
        most, n = -(-most // BLOCK), n + 1
    return n


def manifest(docs: DataFrame, altered: Column | None = None, proofs: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified,
    digests as hex, and with ``proofs`` the proof itself, an array of (place, siblings) from the
    leaf up.  ``altered`` is a text to check against the manifest in place of the row's own:
    folded_root is what it gives with the original siblings."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    checked = F.lit(None).cast("binary") if altered is None else F.when(~altered.eqNullSafe(F.col("text")), leaf_digest(altered))
    leaves = docs.select("doc_id", "source", leaf_digest().alias("digest"), checked.alias("checked"))
    leaves = numbered(leaves, [F.col(c) for c in ("source", "doc_id", "digest", "checked")], "_rank", "merkle-leaves")

    # the trees, numbered by source; a source's leaves are looked up by (task that wrote them, source)
    trees = leaves.groupBy("source").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n"))
    trees = stored(numbered(trees, [F.col("_first")], "tree", "merkle-trees").drop("_part"), "merkle-trees")
    size = trees.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("trees")).first()
    if not size["trees"]:
        return spark.createDataFrame([], _schema(id_type, proofs))
    spans = leaves.select("_part", F.col("source").alias("_source")).distinct()
    spans = spans.join(trees, F.col("_source").eqNullSafe(F.col("source"))).select(F.col("_part").alias("_p"), "_source", "_first", "n", "tree")
    placed = leaves.join(spans, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    bottom = placed.select("tree", (F.col("_rank") - F.col("_first")).alias("at"), "n", "digest", "doc_id", "checked")

    ups = _climb(bottom, _rounds(size["n"]))
    tops = ups[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(size["trees"]).cast("long").alias("n"), "digest")
    over = _climb(tops, _rounds(size["trees"]))
    root = bytes(over[-1].select("digest").first()[0])
    down = spark.createDataFrame([(0, 0, bytearray(), None)], "tree long, at long, suffix binary, subroot binary")
    down = _descend(over, down, 0)
    # a tree's top knows its own digest from here on
    down = down.join(ups[-1].select(F.col("tree").alias("_t"), F.col("digest").alias("_d")), F.col("at") == F.col("_t")).select(
        F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "suffix", F.col("_d").alias("subroot"))
    down = _descend(ups, down, 1)

    def solve(group: list[dict]) -> Iterator[tuple]:
        top, nodes = group[0], group[1:]
        levels = _sweep_up([g["digest"] for g in nodes], nodes[0]["n"] <= BLOCK)
        for g, proof in zip(nodes, _sweep_down(levels, top["suffix"]), strict=True):
            folded = fold_proof(g["checked"] or g["digest"], proof)
            siblings = "".join(s.hex() for _, run in steps(proof) for s in run)
            out = (g["doc_id"], g["digest"].hex(), top["subroot"].hex(), root.hex(), hashlib.sha256(siblings.encode()).hexdigest(),
                   folded.hex(), folded == root)
            yield (*out, [{"place": p, "siblings": [s.hex() for s in run]} for p, run in steps(proof)]) if proofs else out

    # without a round, every tree is one leaf, whose suffix has come down already
    return _by_block(_with_suffixes(bottom, down, ["doc_id", "checked"]), solve, _schema(id_type, proofs))


def _schema(id_type: str, proofs: bool) -> str:
    return (f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
            + (", proof array<struct<place: int, siblings: array<string>>>" if proofs else ""))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.when(fold("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, tampered, proofs=False)


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if f == "text" else f) for f in FIELDS) + ")"


OP11_SQL = f"""
WITH RECURSIVE {SQL_CRC},
d AS (SELECT *, CASE WHEN {sql_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents, crc),
l AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf('altered')} AS checked FROM d),
r AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM r
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, pos // 3
), tops AS (SELECT tree, level, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3
), top AS (SELECT level AS height, digest AS root FROM high WHERE n = 1),
-- the runs a leaf passes, numbered from the leaf up
low_runs AS (SELECT tree, level, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS nodes FROM high WHERE n > 1 GROUP BY ALL),
path AS (
  SELECT r.tree, r.pos, level AS step, (r.pos // CAST(3 ** level AS BIGINT)) % 3 + 1 AS place, nodes
  FROM r JOIN low_runs USING (tree) WHERE run = r.pos // CAST(3 ** (level + 1) AS BIGINT)
  UNION ALL
  SELECT r.tree, r.pos, t.level + h.level, (r.tree // CAST(3 ** h.level AS BIGINT)) % 3 + 1, nodes
  FROM r JOIN tops AS t USING (tree) JOIN high_runs AS h ON run = r.tree // CAST(3 ** (h.level + 1) AS BIGINT)
), proofs AS (
  SELECT tree, pos, sha256(string_agg(array_to_string(nodes[:place - 1] || nodes[place + 1:], ''), '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY tree, pos
), folds AS (
  SELECT tree, pos, 0 AS step, checked AS digest FROM r
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(array_to_string(nodes[:place - 1] || [f.digest] || nodes[place + 1:], ''))
  FROM folds AS f JOIN path AS p ON p.tree = f.tree AND p.pos = f.pos AND p.step = f.step
)
SELECT r.doc_id, r.leaf, t.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM r JOIN tops AS t ON t.tree = r.tree CROSS JOIN top JOIN folds AS f ON f.tree = r.tree AND f.pos = r.pos AND f.step = t.level + height
LEFT JOIN proofs AS p ON p.tree = r.tree AND p.pos = r.pos
"""
