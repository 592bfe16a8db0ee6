r"""Merkle manifest of a dataset, written as postorder append logs.

A leaf is the hash of a document's fields. The leaves of a source, in ascending order, form a tree in which every
``FAN`` consecutive nodes become one; the sources' roots form a tree of the same kind, whose root stands for the dataset.

Aligned builders (each has ``FAN ** HEIGHT`` consecutive leaves of one tree) append nodes in the order in which they are
complete: a leaf at once, an inner node right after its last child. So a builder's nodes are one piece of the tree's postorder
log, and a node's place in it follows from the sizes of the subtrees before it alone (``place``). A proof is read off the log by
these places: no node holds pointers, nothing is searched. The builders' last nodes are the leaves of the next round's builders,
until each tree has one root; proofs are extracted from the top down, and a builder hands each of its leaves the siblings
from there to the root.

Texts are hashed where they are read (Spark's own sha2) and never move; what moves is a digest or two a document. A large source
spans many builders; a builder holds ``FAN ** HEIGHT`` digests at most. Rounds are written, so that a lost executor costs tasks.

Nulls: a null field is hashed as ``-``; a null source is a tree of its own, first in order; null ids come first in their tree. Rows that
share id and source are ordered by their leaf's hash; equal rows are leaves of their own with equal hashes. Empty and very long
texts are hashed like others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import LOWER, UPPER, checkpoint, numbered, small_batches

#: Nodes that become one, levels of a builder.
FAN, HEIGHT = 16, 3


def _up(n: int, level: int, fan: int) -> int:
    """Nodes at a level over n leaves."""
    return -(-n // fan**level)


def height_of(n: int, fan: int = FAN) -> int:
    """Levels over n leaves until one node remains."""
    return next(h for h in range(64) if fan**h >= n)


def place(level: int, j: int, n: int, height: int, fan: int = FAN) -> int:
    """Where node j of a level stands in the postorder log of a tree with n leaves: the number of nodes complete before it.

    These are, at lower levels, all nodes up to its last leaf; at its own, those before it; at higher ones, those that end before its first leaf.
    """
    first, end = j * fan**level, min((j + 1) * fan**level, n)
    return sum(_up(end, k, fan) for k in range(level)) + j + sum(first // fan**k for k in range(level + 1, height + 1))


def parent(children: list[bytes]) -> bytes:
    """The hash of the children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def append_log(leaves: list[bytes], height: int, fan: int = FAN) -> list[bytes]:
    """All nodes in the order in which they are complete."""
    log, waiting = [], [[] for _ in range(height + 1)]
    for i, leaf in enumerate(leaves, 1):
        log.append(leaf)
        waiting[0].append(leaf)
        for level in range(height):
            if len(waiting[level]) < fan and i < len(leaves):
                break
            node = parent(waiting[level])
            waiting[level].clear()
            log.append(node)
            waiting[level + 1].append(node)
    return log


def siblings(log: list[bytes], n: int, height: int, above: list[tuple[str, str]], fan: int = FAN) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a builder's log, level by level up to the root: hex digests of its run to its left and to its right."""
    shared: dict[tuple[int, int], tuple[str, str]] = {}
    for i in range(n):
        path = []
        for level in range(height):
            j = i // fan**level
            if (level, j) not in shared:
                start, end = j - j % fan, min(j - j % fan + fan, _up(n, level, fan))
                run = [log[place(level, k, n, height, fan)].hex() for k in range(start, end)]
                shared.update({(level, start + k): ("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))})
            path.append(shared[level, j])
        yield path + above


def fold(leaf: bytes, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings, as hex text."""
    node = leaf.hex()
    for left, right in path:
        node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


#: A builder's piece of the log. ``level_n``: nodes of the tree at the builder's lowest level; ``ids`` and ``claims``: what the first round's leaves carry.
_PIECE = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level_n", pa.int64()), ("log", pa.list_(pa.binary())), ("leaves", pa.int32()), ("ids", pa.list_(pa.int64())), ("claims", pa.list_(pa.binary()))])
_PIECE_DDL = "tree string, block long, level_n long, log array<binary>, leaves int, ids array<long>, claims array<binary>"


def _levels(level_n: int, fan: int, height: int) -> int:
    """Levels that a builder adds: up to the root where it is the tree's only one."""
    return height_of(level_n, fan) if level_n <= fan**height else height


def _build(fan: int, height: int):
    """Rows (tree, block, idx, level_n, digest, id, claim), sorted; a builder's rows come one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held = None, 0, ([], [], [])

        def piece() -> pa.RecordBatch:
            log = append_log(held[0], _levels(n, fan, height), fan)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, n, log, len(held[0]), held[1], held[2]), _PIECE)], schema=_PIECE)

        for batch in batches:
            for tree, block, level_n, digest, id_, claim in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "level_n", "digest", "id", "claim"))):
                if (tree, block) != key:
                    if key:
                        yield piece()
                    key, n, held = (tree, block), level_n, ([], [], [])
                for to, x in zip(held, (digest, id_, claim)):
                    to.append(x)
        if key:
            yield piece()

    return run


def build(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> list[DataFrame]:
    """The log of each tree as written pieces, round by round.

    ``leaves``: tree (not null), idx (from 0), n (the tree's leaves), digest, id, claim (a digest to be held against the tree, or null).
    """
    wide, rounds = fan**height, []
    nodes = leaves.withColumnRenamed("n", "level_n")
    while True:
        dealt = nodes.withColumn("block", F.expr(f"idx div {wide}L")).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        pieces = checkpoint(dealt.select("tree", "block", "level_n", "digest", "id", "claim").mapInArrow(_build(fan, height), _PIECE_DDL))
        rounds.append(pieces)
        open_trees = pieces.filter(F.col("level_n") > wide)
        if not open_trees.take(1):
            return rounds
        nodes = open_trees.select(
            "tree", F.col("block").alias("idx"), F.expr(f"(level_n + {wide - 1}) div {wide}L").alias("level_n"), F.element_at("log", -1).alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim")
        )


def roots(rounds: list[DataFrame], fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """(tree, digest): the last node of each tree's log."""
    last = [r.filter(F.col("level_n") <= fan**height).select("tree", F.element_at("log", -1).alias("digest")) for r in rounds]
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


_PATH_DDL = "lefts array<string>, rights array<string>"


def _hand_down(fan: int, height: int):
    """From pieces with the path above them: the path of each leaf, which is a piece of the round before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, above = row["leaves"], list(zip(row["lefts"], row["rights"]))
                log, first = row["log"], row["block"] * fan**height
                paths = list(siblings(log, n, _levels(row["level_n"], fan, height), above, fan))
                yield pa.RecordBatch.from_pydict(
                    {"tree": pa.array([row["tree"]] * n), "block": pa.array(range(first, first + n), pa.int64()), "lefts": pa.array([[x for x, _ in p] for p in paths], pa.list_(pa.string())), "rights": pa.array([[x for _, x in p] for p in paths], pa.list_(pa.string()))}
                )

    return run


def pieces_with_paths(rounds: list[DataFrame], outer: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The first round's pieces with lefts and rights, the siblings from the piece's last node up; ``outer`` (tree, lefts, rights) has those of the trees' roots."""
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        alone = F.col("level_n") <= fan**height
        known = rounds[i].filter(alone).join(outer, "tree")
        if above is not None:
            known = known.unionByName(rounds[i].filter(~alone).join(above, ["tree", "block"]))
        if i:
            above = known.mapInArrow(_hand_down(fan, height), f"tree string, block long, {_PATH_DDL}")
    return known


_PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("tree", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _prove(fan: int, height: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, log = row["leaves"], row["log"]
                levels = _levels(row["level_n"], fan, height)
                out = ([], [], [])
                for i, path in enumerate(siblings(log, n, levels, list(zip(row["lefts"], row["rights"])), fan)):
                    leaf = log[place(0, i, n, levels, fan)]
                    out[0].append(leaf.hex())
                    out[1].append(hashlib.sha256("".join([x for pair in path for x in pair]).encode()).hexdigest())
                    out[2].append(fold(row["claims"][i] or leaf, path))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(out[0]), pa.array([row["tree"]] * n), pa.array(out[1]), pa.array(out[2])], schema=_PROOF)

    return run


def field(c: Column) -> Column:
    """A field as it enters a leaf: ``-`` if null, else the number of its bytes, ``:`` and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in fields)).cast("binary"), 256))


def manifest(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256 (its siblings up to the root), folded_root, verified.

    ``leaves``: doc_id, source, digest, claim. What is folded along the siblings is the claim, or the leaf where that is null.
    """
    rows = checkpoint(small_batches(leaves).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), "digest", "claim"))
    trees = build(numbered(rows, ["tree"], ["id", "digest"]).select("tree", "idx", "n", "digest", "id", "claim"), fan, height)
    subroots = roots(trees, fan, height)
    over = numbered(subroots.select(F.lit("sources").alias("top"), F.col("tree").alias("name"), "digest"), ["top"], ["name"])
    names = checkpoint(over.select("name", "idx", F.hex("digest").alias("subroot")))
    top = build(over.select(F.col("top").alias("tree"), "idx", "n", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim")), fan, height)
    free = rows.sparkSession.range(1).select(F.lit("sources").alias("tree"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    paths = pieces_with_paths(top, free, fan, height).mapInArrow(_hand_down(fan, height), f"tree string, block long, {_PATH_DDL}")
    root = roots(top, fan, height).select(F.hex("digest").alias("root"))  # one row
    outer = names.join(paths, names.idx == paths.block).crossJoin(F.broadcast(root)).select(names.name.alias("tree"), "lefts", "rights", F.lower("subroot").alias("subroot"), F.lower("root").alias("root"))
    outer = checkpoint(outer)
    proofs = pieces_with_paths(trees, outer.drop("subroot", "root"), fan, height).select("tree", "level_n", "log", "leaves", "ids", "claims", "lefts", "rights").mapInArrow(_prove(fan, height), "doc_id long, leaf string, tree string, proof_sha256 string, folded_root string")
    return proofs.join(outer.select("tree", "subroot", "root"), "tree").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = leaf_hash(*held, F.translate("text", UPPER, LOWER))
    return manifest(docs.select("doc_id", "source", leaf_hash(*held, F.col("text")).alias("digest"), F.when(tampered, lowered).alias("claim")))


#: CRC-32 of the text in {0}, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, (d & 1) * 3988292384))), 4294967295)"""

_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "{0}"))

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_FIELDS.format("text")}) AS h,
    CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_FIELDS.format(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS claim
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), low(tree, level, idx, n, h) AS (
  SELECT tree, 0, idx, n, h FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 16, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), high(level, idx, n, h) AS (
  SELECT 100, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 16, n
), nodes AS (
  SELECT tree, level, idx, h FROM low WHERE n > 1
  UNION ALL
  SELECT s.tree, high.level, high.idx, high.h FROM high, subroots s WHERE high.n > 1
), heights AS (
  SELECT tree, max(level) + 1 AS height FROM nodes WHERE level < 100 GROUP BY tree
), steps AS (
  SELECT p.doc_id, p.tree, p.idx AS leaf, l.level,
    row_number() OVER (PARTITION BY p.tree, p.idx ORDER BY l.level) AS step,
    CASE WHEN l.level < 100 THEN p.idx // CAST(pow(16, l.level) AS BIGINT) ELSE s.idx // CAST(pow(16, l.level - 100) AS BIGINT) END AS at
  FROM placed p JOIN subroots s USING (tree) JOIN (SELECT DISTINCT tree, level FROM nodes) l USING (tree)
), runs AS (
  SELECT s.tree, s.leaf, s.step,
    coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < s.at), '') AS lefts, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > s.at), '') AS rights
  FROM steps s JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.idx // 16 = s.at // 16
  GROUP BY s.tree, s.leaf, s.step
), folded(tree, leaf, step, h) AS (
  SELECT tree, idx, 0, coalesce(claim, h) FROM placed
  UNION ALL
  SELECT f.tree, f.leaf, f.step + 1, sha256(r.lefts || f.h || r.rights) FROM folded f JOIN runs r ON r.tree = f.tree AND r.leaf = f.leaf AND r.step = f.step + 1
), proofs AS (
  SELECT tree, leaf, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM runs GROUP BY tree, leaf
), ends AS (
  SELECT tree, leaf, arg_max(h, step) AS h FROM folded GROUP BY tree, leaf
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN ends e ON e.tree = p.tree AND e.leaf = p.idx
  LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf = p.idx, (SELECT h FROM high WHERE n = 1) t
"""
