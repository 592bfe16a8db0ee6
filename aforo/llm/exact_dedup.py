"""Exact deduplication by content-defined chunk recipes.

Each text is normalised (every run of space and U+0009 to U+000D becomes one space), cut where a
gear hash of its last 32 bytes says so, and replaced by its recipe: the ordered list of its chunks'
64-bit identifiers. From then on only recipes move: a long text crosses no shuffle. Identifiers are
verified first: if one of them stands for two different chunks anywhere in the table (told apart by
128 bits of SHA-256), the run goes over to the 128-bit identifiers throughout.

Nulls: a null text is empty. A null id sorts after all others. Rows that repeat both id and text
count as copies; one of them stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import checkpoint, mix64, raw_hash, slices, small_batches, smallest

#: Chunk sizes in bytes: least, about the mean beyond the least, most.
LEAST, MEAN, MOST = 512, 2048, 16384

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def normalise(text: bytes) -> bytes:
    """UTF-8 text with each run of white space made one space."""
    text = text.translate(_SPACES)
    return re.sub(b"  +", b" ", text) if b"  " in text else text


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash (shift and add) of the 32 bytes that end there."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    return h


def cuts(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text at start:end, given all places where its hash allows a cut."""
    out, last = [], start
    for c in candidates:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            last = int(c)
            out.append(last)
    while end - last > MOST:
        last += MOST
        out.append(last)
    return [*out, end] if end > last else out


def _recipes(key_bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.int64())), ("p1", pa.list_(pa.int64())), ("p2", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop, signed = 64 - key_bits, np.int64
        for piece in slices(batches, "text"):
            texts = [normalise(t or b"") for t in piece.column("text").to_pylist()]
            whole = np.frombuffer(b"".join(texts), np.uint8)
            places = np.flatnonzero((gear(whole) & np.uint32((MEAN - 1) << 20)) == 0) + 1
            shas, recipe, p1, p2, start = [], [], [], [], 0
            for text in texts:
                end = start + len(text)
                lo, hi = np.searchsorted(places, (start + LEAST, end))
                keys, proofs, last = [], [], 0
                for cut in cuts(places[lo:hi], start, end):
                    chunk = text[last : cut - start]
                    keys.append(xxhash.xxh3_64_intdigest(chunk) >> drop)
                    proofs.append(hashlib.sha256(chunk).digest()[:16])
                    last = cut - start
                proof = np.frombuffer(b"".join(proofs), signed).reshape(-1, 2)
                shas.append(hashlib.sha256(text).hexdigest())
                recipe.append(np.array(keys, np.uint64).view(signed))
                p1.append(proof[:, 0])
                p2.append(proof[:, 1])
                start = end
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), pa.array(shas), *(pa.array(x, pa.list_(pa.int64())) for x in (recipe, p1, p2))], schema=schema)

    return run


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """doc_id, text_hash of the raw text, text_sha256 of the normalised one, recipe (verified identifiers), row_id.

    ``key_bits`` under 64 makes identifiers collide, for tests of the verification.
    """
    text = F.col(text_col)
    made = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), raw_hash(text).alias("text_hash"), text.cast("binary").alias("text")).mapInArrow(
        _recipes(key_bits), "doc_id long, text_hash long, text_sha256 string, recipe array<long>, p1 array<long>, p2 array<long>"
    )
    made = checkpoint(made.withColumn("row_id", F.monotonically_increasing_id()))
    chunks = made.select(F.explode(F.arrays_zip("recipe", "p1", "p2")).alias("c")).select("c.*")
    clash = chunks.groupBy("recipe").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("p1", "p2") for f in (F.min, F.max))).filter("min_p1 <> max_p1 OR min_p2 <> max_p2")
    verified = F.concat("p1", "p2") if clash.take(1) else F.col("recipe")
    return made.select("doc_id", "row_id", "text_hash", "text_sha256", verified.alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Equal recipes are equal texts; of each group the row with the smallest id stays. Groups are
    counted with map-side aggregation; those of one row need no join. The others are written first, so that their
    rows meet them in a plain shuffle join, which Spark splits where a recipe is in very many rows.
    """
    rows = chunk_recipes(docs, id_col, text_col, key_bits)
    groups = rows.groupBy("recipe").agg(smallest("doc_id", "row_id").alias("first"), F.count("*").alias("group_size"))
    groups = checkpoint(groups.filter("group_size > 1"))
    alone = F.col("group_size").isNull()
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.v0")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_id") == F.col("first.v1"))).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("text_hash")


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
