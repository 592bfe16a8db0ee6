"""Streaming forms of the flow operators. The reference works in batches only; these are additions.

Each takes a streaming (or static) frame of events (ts, key, value) and returns the aggregate; run()
drives it over what there is and returns the table it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def events(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream, with its own schema; ts in the session's zone, as watermarks need it."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "6 hours").alias("w"), "event_type")
    return g.agg(F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "mean")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Activity between silences of ``gap``."""
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def adjusted(threshold: float, share_false: float) -> float:
    """A detector's threshold after feedback: lower where over half of the alarms were false, higher where under a fifth were."""
    if share_false > 0.5:
        return max(threshold - 0.05 * (share_false - 0.3), -0.5)
    if share_false < 0.2:
        return min(threshold + 0.02 * (0.3 - share_false), -0.02)
    return threshold


def threshold_feedback(labels: DataFrame, start: float = -0.1, least: int = 10, every: int = 5) -> DataFrame:
    """Per meter (user_id) the labels so far, the share of false alarms and the threshold, adjusted after each ``every`` labels
    from the ``least``-th on. A stream of user_id, ts, event_id, is_false; the state of a meter is three numbers.

    Labels of a micro-batch are taken in the order of ts and event_id.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, false, threshold = state.get if state.exists else (0, 0, start)
        for is_false in pd.concat(list(frames)).sort_values(["ts", "event_id"])["is_false"]:
            n, false = n + 1, false + int(is_false)
            if n >= least and n % every == 0:
                threshold = adjusted(threshold, false / n)
        state.update((n, false, threshold))
        yield pd.DataFrame({"user_id": [key[0]], "n_labels": [n], "share_false": [false / n], "threshold": [threshold]})

    return labels.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n_labels long, share_false double, threshold double", "n long, n_false long, threshold double", "update", "NoTimeout"
    )


def routes(alerts: DataFrame, level: str = "level") -> DataFrame:
    """Channels an alert goes to; nothing is sent."""
    return alerts.withColumn("route", F.when(F.col(level) == "CRITICO", "message+voice+emergency").when(F.col(level) == "ALTO", "message+voice").when(F.col(level) == "VIGILANCIA", "message"))


def run(spark: SparkSession, aggregate: DataFrame) -> DataFrame:
    """Run a streaming aggregate over all that is available; each batch's rows replace those of the same key before.

    Update mode: the last batch that names a key has its final value. Table and progress stand in the folder
    the cluster shares.
    """
    top = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    keys = [c for c in aggregate.columns if c in ("start", "event_type", "user_id")]
    if "end" in aggregate.columns:  # session windows know no update mode
        query = aggregate.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{top}/table/batch={i}"))
    else:
        query = aggregate.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{top}/table/batch={i}"))
    query.option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{top}/table")
    if "end" in aggregate.columns:
        last = rows.agg(F.max("batch").alias("_last"))
        return rows.join(F.broadcast(last), rows.batch == last._last).drop("batch", "_last")  # one row
    rest = [c for c in aggregate.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
