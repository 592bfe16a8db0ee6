"""Sharding by a two-pass external shuffle.

Pass one scatters the rows over buckets by a seeded hash; there are as many buckets as it takes for
each to fit a worker's memory (``BUCKET_BYTES``). Pass two orders each bucket by a key of its rows alone, shuffles
it with a seeded Fisher-Yates shuffle and writes it. Bucket after bucket, the rows form one random order
of the table; shard i gets its i-th part, so that no two shards' counts differ by more than one
(the law is ``rows``). Rows move once.

A range of buckets goes to one partition, whose number is the range's, so that there are at most
``MOST_PARTITIONS`` of them however large the table; a partition sorts by bucket (Spark's external sort) and holds
one bucket at a time. All that is known before the rows move is the count of each partition: a table of at most
``MOST_PARTITIONS`` rows, which is summed up and broadcast.

The order depends on seed and rows alone, not on input files or partitions. Copies of a text scatter
by their ids; only rows equal in both id and text share a bucket.

Nulls: a null text has no bytes (its CRC is that of no bytes); null ids hash by their text. Very long
texts count into the size of buckets. An empty table gives an empty result. Other columns travel with
the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import free_name, shared_folder, small_batches

#: Bytes of text that a bucket is made for, buckets at least, partitions at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_PARTITIONS = 16 << 20, 12, 20_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): for i from the end, swap with a random place up to i."""
    random, out = np.random.Generator(np.random.PCG64([seed, bucket])), list(range(n))
    picks = random.integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, 0, -1), picks):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _shuffle(seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, done = [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            whole = pa.Table.from_batches(held)
            order = fisher_yates(len(whole), seed, bucket)
            for at in range(0, len(order), 512):
                part = whole.take(pa.array(order[at : at + 512])).combine_chunks()
                part = part.append_column("place", pa.array(np.arange(done + at, done + at + len(part), dtype=np.int64)))
                yield from part.to_batches()
            done += len(order)

        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            ends = [*(np.flatnonzero(np.diff(ids)) + 1), len(ids)] if len(ids) else []
            start = 0
            for end in ends:
                if ids[start] != bucket:
                    if held:
                        yield from flush()
                    held, bucket = [], int(ids[start])
                held.append(batch.slice(start, end - start))
                start = int(end)
        if held:
            yield from flush()

    return run


def shard_documents(docs: DataFrame, n_shards: int, path: str, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most: int = MOST_PARTITIONS) -> DataFrame:
    """Write the rows in random order as Parquet under ``path``, in folders shard=0, 1, ...; return the table.

    Every column of ``docs`` is kept; added are slot (from 0 in each shard) and shard, with underscores
    before them where the name is taken.
    """
    spark = small_batches(docs).sparkSession
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    parts = min(buckets, most)
    marked = docs.select(
        F.struct("*").alias("row"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), crc), F.lit(buckets)).cast("long").alias("bucket"),
        F.xxhash64(F.lit(seed + 1), F.col(id_col), crc).alias("order_key"),
        F.col(id_col).alias("tie"),
    ).withColumn("part", F.expr(f"cast(bucket * {parts} div {buckets} as int)"))
    # a row a partition: its count and where its rows start in the whole order
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("start"), F.sum("count").over(Window.partitionBy()).alias("n"))
    dealt = marked.repartitionById(int(parts), F.col("part")).sortWithinPartitions("bucket", "order_key", "tie").select("row", "bucket", "part")
    shuffled = dealt.mapInArrow(_shuffle(seed), dealt.withColumn("place", F.lit(0).cast("long")).schema)
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    placed = (
        shuffled.join(F.broadcast(starts), "part")  # at most ``most`` rows
        .withColumn("position", F.col("start") + F.col("place"))
        .withColumn("to", F.expr(f"position * {n_shards} div n"))
        .select("row.*", F.expr(f"position - (to * n + {n_shards - 1}) div {n_shards}").alias(slot), F.col("to").cast("int").alias(shard))
    )
    placed.write.mode("overwrite").partitionBy(shard).parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = shard_documents(docs, 24, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
