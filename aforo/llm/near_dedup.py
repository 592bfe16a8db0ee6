"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

Texts with the same set of word shingles form one node. A node's signature is its SuperMinHash: the
j-th of an element's pseudo-random values falls on the j-th place of a random permutation of the
signature, raised by j, so that levels are worked off in turn and a signature is done (early stopping)
once every place holds a value below the next level. Bands of the signature put nodes in buckets.

In place of a bucket's pairs, each node is paired with the bucket's centre (of its nodes the one with
the most company over all bands), and all nodes ever paired with one centre are its group; so
two nodes that share a bucket share a group. Verification computes exact intersections of full sets
in two rounds. First every node of a group with the centre: work and rows are linear. Then the nodes
that turned out not to be linked to their centre with the rest of the group, block by block within
memory, of which only confirmed links leave the task. Groups of any size are split (salted) by the bytes
they hold in both rounds. Components of the confirmed links give the classes. What is counted by a key is written before it
is joined to the rows of that key, so that such joins are plain shuffle joins, which Spark splits where a key is hot.

The chance that a pair at the threshold shares no band is (1 - 0.8^6)^42, 3 in a million.

Nulls and texts without words have an empty set and are linked with nothing. A null id takes part,
but names a component only if there is no other. Rows that repeat are members of one node. An empty
table gives an empty result. Very long texts are split into words in one piece, others in slices. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, distinct_pairs, hash_words, mix64, raw_hash, shingles, slices, small_batches, smallest, split_words
from aforo.llm.graph import components

#: Rows in a band, bands; similarity as a fraction.
ROWS, BANDS, NUMERATOR, DENOMINATOR = 6, 42, 80, 100
#: Shingles of a group that go to one task, nodes that go there with their centre, nodes that are broadcast at most.
HELD_SHINGLES, HELD_NODES, BROADCAST_NODES = 2_000_000, 500, 2_000_000
#: Bytes of text signed at a time: levels are worked off once for all of a slice's sets.
SIGNED_BYTES = 2 << 20


def super_minhash(values: np.ndarray, owners: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n rows of m) of the sets given as (owner, value) pairs.

    An entry is the level in its upper and a random number in its lower 32 bits.
    """
    h = np.full((n, m), np.iinfo(np.int64).max, np.int64)
    flat, placed, stored = h.reshape(-1), [], []  # where each level's swap went and what it left there
    for level in range(m):
        if not len(values):
            break
        u = mix64(values + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64) + level
        mine, other = np.full(len(k), level, np.int64), k.copy()
        for p, s in zip(placed, stored):
            np.copyto(mine, s, where=p == level)
            np.copyto(other, s, where=p == k)
        np.minimum.at(flat, owners * m + other, (u >> np.uint64(32)).astype(np.int64) | (level << 32))
        placed.append(k)
        stored.append(mine)
        open_sets = np.zeros(n, bool)
        some = np.unique(owners)
        open_sets[some] = h[some].max(1) >= (level + 1) << 32
        on = open_sets[owners]
        if not on.all():
            values, owners = values[on], owners[on]
            placed, stored = [p[on] for p in placed], [s[on] for s in stored]
    return h


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(signatures), b + 1, np.uint64)
        for r in range(ROWS):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + signatures[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = x
    return out.view(np.int64)


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (values, owners) and where each text's begin."""
    words, offsets = split_words(texts)
    values, owners = distinct_pairs(*shingles(hash_words(words), offsets, k))
    return values, owners, np.searchsorted(owners, np.arange(len(texts) + 1))


def _sign(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SIGNED_BYTES):
            values, owners, at = _sets(piece.column("text"), k)
            bands = band_hashes(super_minhash(values, owners, piece.num_rows, ROWS * BANDS))
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(at, at[1:])), np.int64).reshape(-1, 2)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), pa.array(np.diff(at)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), listed], schema=schema)

    return run


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str], k: int) -> Iterator[tuple[tuple, dict, np.ndarray]]:
    """Rows of sorted batches in order: the group's key, the row's other columns, its set."""
    for piece in slices(batches, "text"):
        values, _, at = _sets(piece.column("text"), k)
        cols = {c: piece.column(c).to_pylist() for c in piece.schema.names if c != "text"}
        for i in range(piece.num_rows):
            yield tuple(cols[c][i] for c in keys), {c: v[i] for c, v in cols.items()}, values[at[i] : at[i + 1]]


def _linked(inter, a, b):
    return DENOMINATOR * inter >= NUMERATOR * (a + b - inter)


def _with_centre(k: int):
    """Rows sorted by (c, salt, other): the centre first; (c, y, n, linked) of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre, out = None, None, []
        for key, row, own in _grouped(batches, ["c", "salt"], k):
            if key != group:
                group, centre = key, own
                continue
            if row["y"] != row["c"]:
                inter = int(np.isin(own, centre, assume_unique=True, kind="sort").sum()) if min(len(own), len(centre)) else 0
                out.append((row["c"], row["y"], len(own), bool(_linked(inter, len(own), len(centre)))))
            if len(out) >= 10_000:
                yield _columns(out)
                out = []
        if out:
            yield _columns(out)

    def _columns(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)], names=["c", "y", "n", "linked"])

    return run


class _Block:
    """Sets held in memory, as one sorted list of (shingle, set)."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def links(self, probe: np.ndarray) -> np.ndarray:
        """Which of the held sets are similar enough to ``probe``."""
        lo, hi = np.searchsorted(self.values, probe, "left"), np.searchsorted(self.values, probe, "right")
        n = hi - lo
        some = n > 0
        lo, n = lo[some], n[some]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        inter = np.bincount(self.owners[at], minlength=len(self.ids))
        return np.flatnonzero((inter > 0) & _linked(inter, self.sizes, len(probe)))


def _with_block(k: int):
    """Rows sorted by (c, block, salt, probe): held ones first (compared with each other in salt 0), then probes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, block, out = None, [], [], None, []

        def build() -> _Block | None:
            made = _Block(ids, sets) if ids else None
            if made and group[2] == 0:
                for i, (x, s) in enumerate(zip(ids, sets)):
                    out.extend((x, ids[j]) for j in made.links(s) if j > i)
            return made

        for key, row, own in _grouped(batches, ["c", "block", "salt"], k):
            if key != group:
                if ids and block is None:
                    build()
                group, ids, sets, block = key, [], [], None
            if not row["probe"]:
                ids.append(row["y"])
                sets.append(own)
                continue
            block = block or build()
            if block:
                out.extend((row["y"], ids[j]) for j in block.links(own))
            if len(out) >= 10_000:
                yield _columns(out)
                out.clear()
        if ids and block is None:
            build()
        if out:
            yield _columns(out)

    def _columns(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["u", "v"])

    return run


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(y, text) of the wanted nodes, read again from the documents."""
    of = checkpoint(nodes.join(wanted, nodes.id == wanted.y, "left_semi").select(F.col("id").alias("y"), F.col("rep.v0").alias("rep_id"), F.col("rep.v1").alias("rep_hash")))
    small = F.broadcast(of) if of.count() <= BROADCAST_NODES else of
    return docs.join(small, docs.doc_id.eqNullSafe(small.rep_id) & (docs.text_hash == small.rep_hash)).select("y", "text")


def near_dedup(docs: DataFrame, shingle: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash, stays.

    ``kept`` says that the row's id names its component; ``stays`` is true for one row of each
    component (and for each row without words), told by id and text hash.
    """
    read = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = read.withColumn("text_hash", raw_hash(F.col("text")))
    signed = checkpoint(read.mapInArrow(_sign(shingle), "doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>"))
    nodes = signed.filter("n > 0").groupBy("k1", "k2").agg(smallest("doc_id", "text_hash").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("n").alias("n"))
    nodes = checkpoint(nodes.withColumn("id", F.monotonically_increasing_id()))

    bands = nodes.select(F.explode("bands").alias("h"), F.col("id").alias("y"))
    sizes = checkpoint(bands.groupBy("h").count().filter("count > 1"))
    members = checkpoint(bands.join(sizes, "h"))
    company = checkpoint(members.groupBy("y").agg(F.sum("count").alias("company")))
    centres = checkpoint(members.join(company, "y").groupBy("h").agg(F.max(F.struct("company", "y")).alias("best")))
    groups = members.join(centres, "h").select(F.col("best.y").alias("c"), "y").distinct()
    groups = checkpoint(groups.join(nodes.select(F.col("id").alias("y"), "n"), "y"))

    texts = _texts(read, nodes, groups.select("y").distinct())
    held = F.lit(HELD_SHINGLES)
    salts = checkpoint(groups.groupBy("c").agg(F.greatest(F.ceil(F.sum("n") / held), F.ceil(F.count("*") / HELD_NODES)).cast("int").alias("salts")))
    first = groups.join(salts, "c").select("c", "y", F.explode(F.when(F.col("y") == F.col("c"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.hash("y"), F.col("salts"))))).alias("salt"))
    first = first.join(texts, "y").withColumn("other", F.col("y") != F.col("c")).select("c", "salt", "other", "y", "text")
    star = checkpoint(first.repartition("c", "salt").sortWithinPartitions("c", "salt", "other", "y").mapInArrow(_with_centre(shingle), "c long, y long, n long, linked boolean"))

    # rest: nodes not linked to their centre, with all others of its group
    rest = checkpoint(star.groupBy("c").agg(
        F.count("*").alias("m"),
        F.ceil(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("n"))), F.lit(0)) / held).cast("int").alias("blocks"),
        F.ceil(F.sum("n") / (held * 4)).cast("int").alias("salts"),
    ).filter("m > 1 AND blocks > 0"))
    of = star.join(rest, "c").withColumn("own", F.when(~F.col("linked"), F.pmod(F.hash("y"), F.col("blocks"))))
    all_blocks, all_salts = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("salts") - 1)
    kept = of.filter("own IS NOT NULL").select("c", "y", F.col("own").alias("block"), F.explode(all_salts).alias("salt"), F.lit(False).alias("probe"))
    probes = of.withColumn("block", F.explode(all_blocks)).filter("own IS NULL OR own <> block").select("c", "y", "block", F.pmod(F.hash("y", F.lit(1)), F.col("salts")).alias("salt"), F.lit(True).alias("probe"))
    second = kept.unionByName(probes).join(texts, "y").select("c", "block", "salt", "probe", "y", "text")
    more = second.repartition("c", "block", "salt").sortWithinPartitions("c", "block", "salt", "probe", "y").mapInArrow(_with_block(shingle), "u long, v long")

    links = star.filter("linked").select(F.col("c").alias("u"), F.col("y").alias("v")).unionByName(more)
    roots = components(links)
    named = nodes.select("id", "k1", "k2", "rep").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    least = checkpoint(named.groupBy("root").agg(F.min("rep").alias("first")))
    named = named.select("k1", "k2", "root").join(least, "root").select("k1", "k2", "first")
    out = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    linked = F.col("n_shingles") > 0
    component = F.when(linked, F.col("first.v0")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    stays = kept & (~linked | (F.col("text_hash") == F.col("first.v1")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", stays.alias("stays"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "stays")
