"""Resampling in one pass: every replicate's draws are hashes, so that Spark and SQL draw alike and nothing is sorted or collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ranges import spread

#: Buckets of places in which draws and labels meet.
BUCKETS = 64


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 by the MD5 of the parts, joined by dashes."""
    text = F.concat_ws("-", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _extremes(means: DataFrame, top: int, *by: str) -> DataFrame:
    """Mean of the ``top`` highest means, and that less the mean of the ``top`` lowest. means: _label, _mean; a row a label."""
    w = Window.partitionBy(*by)
    ranked = means.withColumns({"_hi": F.row_number().over(w.orderBy(F.desc("_mean"), "_label")), "_lo": F.row_number().over(w.orderBy("_mean", "_label"))})
    high, low = F.avg(F.when(F.col("_hi") <= top, F.col("_mean"))), F.avg(F.when(F.col("_lo") <= top, F.col("_mean")))
    return ranked.groupBy(*by).agg(high.alias("top"), (high - low).alias("spread"))


def null_label_test(df: DataFrame, row: list[str], label: str, score: str, rounds: int = 1000, top: int = 5, seed: str = "null") -> DataFrame:
    """One row: is the mean score of the ``top`` highest labels greater than where labels mean nothing?

    In each round every row draws a label anew, by hash, with the labels' own frequencies; rounds times rows are hashed where
    they are read, and what is shuffled is a sum a round and label. observed_top, observed_spread, null_mean, null_std,
    p_value, p_spread, z_score; no row for fewer than ``top`` labels. df: a row a unit and month; row: its key.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    rows = spread(rows.select(*row, label, score), *row)  # each becomes ``rounds`` rows
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_c"), F.avg(score).alias("_mean"))
    w = Window.orderBy("_label")  # a row a label
    spans = counts.select("_label", (F.sum("_c").over(w) - F.col("_c")).alias("_low"), F.sum("_c").over(w).alias("_high"))
    size = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k")).filter(F.col("_k") >= top).select("_n", F.ceil(F.col("_n") / BUCKETS).alias("_w"))
    spans = spans.crossJoin(F.broadcast(size)).withColumn("_bucket", F.explode(F.expr("sequence(_low div _w, (_high - 1) div _w)")))  # one row; a label's places by buckets
    drawn = rows.select(*row, F.col(score).alias("_s")).crossJoin(F.broadcast(size)).withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = drawn.withColumn("_place", draw(F.lit(seed), "_round", *row) % F.col("_n")).select("_round", "_s", "_place", F.expr("_place div _w").alias("_bucket"))
    drawn = drawn.join(spans.select("_label", "_low", "_high", "_bucket"), "_bucket").filter("_place >= _low AND _place < _high")
    null = _extremes(drawn.groupBy("_round", "_label").agg(F.avg("_s").alias("_mean")), top, "_round")
    real = _extremes(counts.withColumn("_one", F.lit(1)), top, "_one").select(F.col("top").alias("observed_top"), F.col("spread").alias("observed_spread"))
    both = null.crossJoin(F.broadcast(real))  # one row
    out = both.groupBy("observed_top", "observed_spread").agg(
        F.avg("top").alias("null_mean"), F.stddev_pop("top").alias("null_std"), ((F.count_if(F.round("top", 9) >= F.round("observed_top", 9)) + 1) / (F.count("*") + 1)).alias("p_value"),
        ((F.count_if(F.round("spread", 9) >= F.round("observed_spread", 9)) + 1) / (F.count("*") + 1)).alias("p_spread"),
    )
    return out.withColumn("z_score", F.when(F.col("null_std") > 0, (F.col("observed_top") - F.col("null_mean")) / F.col("null_std")).otherwise(0.0))


def month_weights(months: DataFrame, rounds: int, seed: str) -> DataFrame:
    """(round, month, w): how often each month is drawn when as many as there are are drawn with replacement. months: month, a row each."""
    table = months.agg(F.array_sort(F.collect_list("month")).alias("_m"))
    slots = table.select("_m", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("_slot", F.explode(F.expr("sequence(1, size(_m))")))
    picked = slots.withColumn("month", F.get("_m", (draw(F.lit(seed), "round", "_slot") % F.size("_m")).cast("int")))
    return picked.groupBy("round", "month").agg(F.count("*").alias("w"))


def bootstrap_core(df: DataFrame, unit: str, t: str, ensemble: str, stacking: str, p: str, models: str, least_models: float, rounds: int = 500, seed: str = "boot", stable: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """How often each unit is in the stable core when months are drawn with replacement: (unit, frequency, ultra_stable), and one row of
    core sizes (median, least, greatest, rounds).

    Rows are summed up to a row a unit and month first, once; rounds work on those sums and on weights of months.
    """
    per = df.groupBy(F.col(unit).alias("unit"), F.col(t).alias("month")).agg(
        F.count("*").alias("n"), F.sum(ensemble).alias("e"), F.count(ensemble).alias("ne"), F.sum(stacking).alias("s"), F.count(stacking).alias("ns"), F.count_if(F.col(p) < 0.05).alias("sig"), F.sum(models).alias("m"), F.count(models).alias("nm")
    )
    weights = month_weights(per.select("month").distinct(), rounds, seed)
    mean = lambda x, n: F.sum(F.col("w") * F.col(x)) / F.sum(F.col("w") * F.col(n))
    g = per.join(weights, "month").groupBy("round", "unit").agg(F.round(mean("e", "ne"), 9).alias("e"), F.round(mean("s", "ns"), 9).alias("s"), F.sum("sig").alias("sig"), mean("m", "nm").alias("m"))
    limits = g.groupBy("round").agg(F.percentile("e", F.lit(0.75)).alias("e75"), F.percentile("s", F.lit(0.75)).alias("s75"))
    core = g.join(limits, "round").filter((F.col("e") >= F.round("e75", 9)) & (F.col("s") >= F.round("s75", 9)) & (F.col("sig") > 0) & (F.round("m", 9) >= least_models))
    frequency = core.groupBy("unit").agg((F.count("*") / rounds).alias("frequency")).withColumn("ultra_stable", F.col("frequency") >= stable)
    sizes = limits.select("round").join(core.groupBy("round").agg(F.count("*").alias("size")), "round", "left").fillna({"size": 0})
    return frequency, sizes.agg(F.median("size").alias("core_size_median"), F.min("size").alias("core_size_least"), F.max("size").alias("core_size_greatest"), F.count("*").alias("rounds"))
