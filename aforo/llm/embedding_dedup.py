r"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of a label are laid out along a space-filling curve through their ``CURVE`` leading principal components and cut into tiles of
``TILE`` consecutive vectors. Two tiles are compared only if their boxes allow it: the product over the leading components is
bounded by the corners of the boxes, the rest by the product of the largest suffix norms (Cauchy and Schwarz). Within a pair of tiles the
leading components are multiplied first; where what is accumulated plus the product of the two suffix norms cannot reach
the threshold, the pair of vectors is given up, and only the others see the next components. The bounds are
exact, so no link is lost whatever the data; on vectors without structure all tiles are compared, most pairs after their first
``STEPS`` components.

No pair of vectors is ever emitted: a pair of tiles gives each vector's number of links in it, and a forest that unites the linked ones.
Forests are united by joins (``graph.components``). Tiles have a fixed number of vectors, so a large label or a large
group of copies becomes more pairs of tiles, not larger ones. What is broadcast is the matrix of components.

The principal components come from all usable vectors (MLlib sums the covariance in a tree). They only order and rotate: products
are those of the vectors, and pairs within 1e-9 of the threshold are decided by the cosine of the values as given, in double precision.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, are linked with nothing; so are
vectors of different lengths with each other. A null id is carried and never the smallest; rows that repeat an id are vectors of their own. Equal vectors of a label
are linked. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, numbered, small_batches
from aforo.llm.graph import components

#: Least cosine of a link, vectors of a tile, components that order the tiles, rows of a tile multiplied at a time.
THRESHOLD, TILE, CURVE, STRIP = 0.93, 2048, 4, 256
#: Components multiplied first, then up to these, then all.
STEPS = (8, 16, 32)
#: What rounding may take from a bound.
SLACK = 1e-9


def usable(vector: str) -> Column:
    """Vectors with a direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def principal(vectors: DataFrame, size: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal components of the vectors of this length; the identity for fewer than two."""
    rows = vectors.filter(F.size("v") == size).select("v")
    if len(rows.take(2)) < 2:
        return np.eye(size)
    units = rows.mapInArrow(_units, "u array<double>").select(array_to_vector("u").alias("u"))
    found = PCA(k=size, inputCol="u", outputCol="p").fit(units).pc.toArray()
    q, _ = np.linalg.qr(found)  # to the last bit, and a basis even if some directions have no variance
    return q if np.isfinite(q).all() else np.eye(size)


def _scaled(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            units = _scaled(_matrix(b.column("v"), len(b.column("v")[0])))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(units) + 1, dtype=np.int32) * units.shape[1], pa.array(units.ravel()))], names=["u"])


def curve(lead: np.ndarray) -> np.ndarray:
    """Places on a Z-shaped curve: the bits of the coordinates, which are between -1 and 1, in turn."""
    n = lead.shape[1]
    bits = min(15, 62 // max(1, n))
    cells = np.clip((lead + 1) / 2 * 2**bits, 0, 2**bits - 1).astype(np.int64)
    out = np.zeros(len(lead), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            out = out << 1 | cells[:, d] >> bit & 1
    return out


def _keys(axes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.zeros(b.num_rows, np.int64)
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                keys[mine] = curve(_scaled(_matrix(b.column("v").take(pa.array(mine)), size)) @ axes.value[size][:, :CURVE])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "label", "size", "v")), pa.array(keys)], names=["node", "label", "size", "v", "key"])

    return run


_TILE = pa.schema([("label", pa.string()), ("size", pa.int32()), ("tile", pa.int64()), ("tiles", pa.int64()), ("nodes", pa.list_(pa.int64())), ("raw", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("rest", pa.float64())])
_TILE_DDL = "label string, size int, tile long, tiles long, nodes array<long>, raw binary, low array<double>, high array<double>, rest double"


def _pack(axes, most: int, kind: str):
    """Rows (label, size, tile, n, node, v), sorted: a tile's rows to one, with the box of its leading components and the largest norm of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, nodes, vectors = None, 0, [], []

        def packed() -> pa.RecordBatch:
            raw = np.concatenate(vectors).astype(kind)
            turned = _scaled(raw) @ axes.value[key[1]]
            lead, rest = turned[:, :CURVE], float(np.sqrt((turned[:, CURVE:] ** 2).sum(axis=1)).max())
            row = (*key, -(-n // most), np.concatenate(nodes), raw.tobytes(), lead.min(axis=0), lead.max(axis=0), rest)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TILE)], schema=_TILE)

        for b in batches:
            labels, sizes, tiles = (b.column(c).to_pylist() for c in ("label", "size", "tile"))
            start = 0
            while start < b.num_rows:
                now, end = (labels[start], sizes[start], tiles[start]), start
                while end < b.num_rows and tiles[end] == now[2] and sizes[end] == now[1] and labels[end] == now[0]:
                    end += 1
                if now != key:
                    if key:
                        yield packed()
                    key, nodes, vectors = now, [], []
                part = b.slice(start, end - start)
                n = part.column("n")[0].as_py()
                nodes.append(part.column("node").to_numpy())
                vectors.append(_matrix(part.column("v"), now[1]))
                start = end
        if key:
            yield packed()

    return run


def unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite u with v, pair by pair, in ``root``, which has each node's smallest known partner."""
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root[:] = further


class Side:
    """A tile, rotated: suffix norms after each step."""

    def __init__(self, raw: bytes, kind: str, axes: np.ndarray):
        self.raw = np.frombuffer(raw, kind).reshape(-1, len(axes))
        self.turned = _scaled(self.raw) @ axes
        self.ends = [*(s for s in STEPS if s < len(axes)), len(axes)]
        tails = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = {e: np.sqrt(tails[:, e]) if e < len(axes) else np.zeros(len(tails)) for e in self.ends}


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a with rows of b, of the values as given."""
    a, b = (x.astype(np.float64) for x in (a, b))
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def linked(a: Side, b: Side, start: int, stop: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a from start to stop, row of b) that reach the threshold."""
    first = a.ends[0]
    sums = a.turned[start:stop, :first] @ b.turned[:, :first].T
    i, j = np.nonzero(sums + np.outer(a.rest[first][start:stop], b.rest[first]) >= threshold - SLACK)
    sums, i = sums[i, j], i + start
    for begin, end in zip(a.ends, a.ends[1:]):
        for at in range(0, len(i), 1 << 16):  # gathered rows are wide
            part = slice(at, at + (1 << 16))
            sums[part] += np.einsum("ij,ij->i", a.turned[i[part], begin:end], b.turned[j[part], begin:end])
        open_ = sums + a.rest[end][i] * b.rest[end][j] >= threshold - SLACK
        i, j, sums = i[open_], j[open_], sums[open_]
    close = np.flatnonzero(np.abs(sums - threshold) <= SLACK)
    keep = np.ones(len(i), bool)
    keep[close] = cosines(a.raw[i[close]], b.raw[j[close]]) >= threshold
    return i[keep], j[keep]


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _compare(axes, kind: str, threshold: float):
    """Of each pair of tiles (or a tile with itself): the linked nodes, the node that each is united with, and their links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                size, raw, other = (batch.column(c)[at].as_py() for c in ("size", "raw", "other_raw"))
                a = Side(raw, kind, axes.value[size])
                b = a if other is None else Side(other, kind, axes.value[size])
                nodes = [batch.column(c)[at].values.to_numpy() for c in ("nodes", "other_nodes") if batch.column(c)[at].is_valid]
                nodes, shift = np.concatenate(nodes), 0 if other is None else len(a.raw)
                root, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
                for start in range(0, len(a.raw), STRIP):
                    i, j = linked(a, b, start, start + STRIP, threshold)
                    if other is None:
                        i, j = i[i < j], j[i < j]
                    links += np.bincount(i, minlength=len(nodes)) + np.bincount(j + shift, minlength=len(nodes))
                    unite(root, i, j + shift)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(links[some])], schema=_LINKS)

    return run


def tile_bound(a: str, b: str) -> Column:
    """No product of a vector of tile a and one of tile b is greater."""
    corners = F.zip_with(
        F.arrays_zip(F.col(f"{a}.low").alias("l"), F.col(f"{a}.high").alias("h")),
        F.arrays_zip(F.col(f"{b}.low").alias("l"), F.col(f"{b}.high").alias("h")),
        lambda x, y: F.greatest(x.l * y.l, x.l * y.h, x.h * y.l, x.h * y.h),
    )
    return F.aggregate(corners, F.col(f"{a}.rest") * F.col(f"{b}.rest"), lambda s, x: s + x)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Linked are rows of one label whose cosine is ``threshold`` or more.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = small_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = checkpoint(rows.withColumn("node", F.monotonically_increasing_id()))
    some = rows.filter(usable("v") & F.col("label").isNotNull()).select("node", "label", F.size("v").alias("size"), "v")
    axes = {r["size"]: principal(some, r["size"]) for r in some.select("size").distinct().collect()}  # one or a few lengths
    axes = vectors.sparkSession.sparkContext.broadcast(axes)
    value = "float" if kind == "<f4" else "double"
    keyed = some.select("node", "label", "size", F.col("v").cast(f"array<{value}>").alias("v")).mapInArrow(_keys(axes), f"node long, label string, size int, v array<{value}>, key long")
    placed = numbered(keyed, ["label", "size"], ["key", "node"]).withColumn("tile", F.expr(f"idx div {tile}L"))
    dealt = placed.select("label", "size", "tile", "idx", "n", "node", "v").repartition("label", "size", "tile").sortWithinPartitions("label", "size", "tile", "idx")
    tiles = checkpoint(dealt.mapInArrow(_pack(axes, tile, kind), _TILE_DDL))
    boxes = tiles.select("label", "size", "tile", "tiles", "low", "high", "rest")
    later = boxes.filter("tile + 1 < tiles").withColumn("other", F.explode(F.expr("sequence(tile + 1, tiles - 1)")))
    pairs = later.alias("a").join(boxes.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.other") == F.col("b.tile"))).filter(tile_bound("a", "b") >= threshold - SLACK)
    pairs = pairs.select("a.label", "a.size", "a.tile", "a.other")
    full = tiles.select("label", "size", "tile", "nodes", "raw")
    none = full.select("label", "size", "nodes", "raw", F.lit(None).cast("array<long>").alias("other_nodes"), F.lit(None).cast("binary").alias("other_raw"))
    both = pairs.join(full, ["label", "size", "tile"]).drop("tile").join(full.select("label", "size", F.col("tile").alias("other"), F.col("nodes").alias("other_nodes"), F.col("raw").alias("other_raw")), ["label", "size", "other"])
    compared = none.unionByName(both.drop("other")).repartition(F.xxhash64("nodes", "other_nodes"))
    found = checkpoint(compared.mapInArrow(_compare(axes, kind, threshold), "u long, v long, links long"))
    degrees = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
    united = components(found.select("u", "v")).join(rows.select("node", "vec_id"), "node")
    least = united.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = united.join(least, "root").select("node", "component_id")
    out = rows.select("node", "vec_id").join(degrees, "node", "left").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


OP12_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, v) AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, least(e.vec_id, coalesce(r.v, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.v, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least r ON r.u = e.vec_id
"""
