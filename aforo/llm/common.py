"""What the training-data operators share: word splitting, hashing, bounded slices, checkpoints."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at a time (a longer text comes alone), and bytes of a batch that Spark sends it.
SLICE_BYTES, BATCH_BYTES = 512 << 10, 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests, a
    single machine) is one made beside the warehouse.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isEmpty():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, for tables an operator writes."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Python workers batches of ``BATCH_BYTES``, where it has Spark's own default (64 MB) so far.

    Whole texts are wide rows: a batch stands in the executor's memory, in the pipe and in the worker at the same time.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m").lower() in ("67108864b", "67108864", "64m", "64mb"):
        conf.set(key, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: What a Python worker keeps from task to task: of one operator at a time.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this worker keeps for later tasks of ``operator``; what it kept for others goes.

    Workers live on between stages, an executor has more of them than cores, and each would else hold the tables of every stage so far.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[operator] = {}
    return _KEPT[operator]


def _give_back() -> None:
    """Free memory to the system, Arrow's and, where the C library can do so (glibc), that of other arrays and strings."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, operator: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose ``column`` has about ``limit`` bytes at most (or one row).

    ``operator`` names the one whose tables the worker keeps meanwhile; without it none stay.
    """
    kept(operator)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop
    _give_back()  # workers live on between tasks


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and where each text's words begin (n + 1 offsets).

    A word is a run of characters other than space and U+0009 to U+000D. ``lower`` lower-cases A to Z
    and nothing else. Null counts as empty.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)  # leading and trailing white space leave empty strings
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=before[1:])
    return words.filter(full), before[offsets]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once a slice."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    of = xxhash.xxh3_64_intdigest
    table = np.fromiter((of(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of ``k`` words, repeats kept, and the text each belongs to.

    A text of fewer than ``k`` words has one shingle, its whole sequence; one without words none.
    """
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes))
    whole = at + k <= offsets[owner + 1]
    out = np.zeros(int(whole.sum()), np.uint64)
    start = at[whole]
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[start + j] + np.uint64(j + 1))
    owners = owner[whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for m, i in enumerate(short):
            h = np.zeros(1, np.uint64)
            for j, x in enumerate(hashes[offsets[i] : offsets[i + 1]]):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(j + 1))
            extra[m] = h[0] ^ np.uint64(n[i])
        out, owners = np.concatenate([out, extra]), np.concatenate([owners, short])
    return out, owners


def distinct_pairs(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner and value."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if not len(values):
        return values, owners
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[first], owners[first]


def raw_hash(text: Column) -> Column:
    """The hash by which decisions on rows find their rows again, beside the id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text hash are in ``kept`` (doc_id, text_hash); of equal ones one."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), raw_hash(F.col(text_col)).alias("h"))
    keys = kept.select(F.coalesce("doc_id", F.lit(-1)).alias("i0"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("h"))
    rows = rows.withColumns({"i0": F.coalesce("i", F.lit(-1)), "none": F.col("i").isNull()}).join(keys, ["i0", "none", "h"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("i0", "none", "h").orderBy("i0"))
    return rows.withColumn("nth", nth).filter("nth = 1").select("row.*")


def drop_rows(docs: DataFrame, dropped: DataFrame, most: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text hash are not in ``dropped``, which is broadcast up to ``most`` rows."""
    bad = checkpoint(dropped.select("doc_id", "text_hash").distinct())
    few = F.broadcast(bad) if bad.count() <= most else bad
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), raw_hash(F.col(text_col)).alias("h"))
    return rows.join(few, rows.i.eqNullSafe(few.doc_id) & (rows.h == few.text_hash), "left_anti").select("row.*")


def smallest(*cols: str):
    """min() of rows by these columns, nulls last: a struct whose fields v0, v1, ... hold them."""
    parts = []
    for i, c in enumerate(cols):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.min(F.struct(*parts))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` written in the order of ``group`` and ``order`` (nulls first), with idx (from 0 in its group), n (the group's rows), part and row.

    Rows are dealt by ranges, so that a large group spans as many tasks as it needs; ``part`` is the number of a range and ``row`` rises with
    the whole order. ``group`` columns hold no nulls. Only counts of each range's groups are summed up, never rows of a group.
    """
    keys = [*group, *order]
    ranged = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys))  # ranges stay partitions
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    counts = ranged.groupBy("part", *group).agg(F.count("*").alias("in_part"), F.min("row").alias("first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("in_part").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", *group, (before - F.col("first")).alias("shift"), F.sum("in_part").over(whole).alias("n"))
    return ranged.join(starts, ["part", *group]).withColumn("idx", F.col("row") + F.col("shift")).drop("shift")
