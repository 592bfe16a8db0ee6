"""Meter readings: reading anomalies, monthly statistics, distribution features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ranges import running_sums, written


def reading_flags(df: DataFrame, multiplier: float = 3.0, zero_days: int = 30) -> DataFrame:
    """Stopped, extreme (fence of the month's positive values), negative and late readings."""
    positive = F.when(F.col("m3_per_day") > 0, F.col("m3_per_day"))
    fences = df.groupBy("mes").agg(F.coalesce(F.percentile(positive, F.lit(0.25)), F.lit(0.0)).alias("q1"), F.coalesce(F.percentile(positive, F.lit(0.75)), F.lit(1.0)).alias("q3"))
    df = df.join(fences, "mes")
    df = df.withColumns(
        {
            "is_zero": (F.col("m3") == 0) & (F.col("dias") > zero_days),
            "is_extreme_high": (F.col("m3_per_day") > F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))) & (F.col("m3_per_day") > 0),
            "is_extreme_low": F.col("m3") < 0,
            "is_delayed": F.abs("delay") > 30,
        }
    )
    return df.withColumn("is_anomaly_reading", F.col("is_zero") | F.col("is_extreme_high") | F.col("is_extreme_low") | F.col("is_delayed"))


def monthly_reading_stats(flags: DataFrame) -> DataFrame:
    """Counts and rates per month, z-score of the anomaly rate among months, flag z > 1 or rate > 15 %."""
    rate = lambda c: (F.avg(F.col(c).cast("int")) * 100).alias(c.replace("is_", "pct_"))
    out = flags.groupBy("mes").agg(
        F.count("*").alias("n"), *(rate(c) for c in ("is_zero", "is_extreme_high", "is_extreme_low", "is_delayed", "is_anomaly_reading")),
        F.avg("m3").alias("m3_mean"), F.median("m3").alias("m3_median"), F.stddev_samp("m3").alias("m3_std"), F.max("m3").alias("m3_max"),
    )
    w = Window.partitionBy()  # a row a month
    std = F.stddev_samp("pct_anomaly_reading").over(w)
    out = out.withColumn("z", F.when(std > 0, (F.col("pct_anomaly_reading") - F.avg("pct_anomaly_reading").over(w)) / std).otherwise(0.0))
    return out.withColumns({"above_2sigma": F.col("z") > 2, "is_anomaly": (F.col("z") > 1) | (F.col("pct_anomaly_reading") > 15)})


def by_periodicity(flags: DataFrame) -> DataFrame:
    return flags.groupBy("trimestral").agg(F.count("*").alias("n"), (F.avg(F.col("is_anomaly_reading").cast("int")) * 100).alias("pct_anomaly"), F.avg("m3").alias("m3_mean"), F.median("m3").alias("m3_median"))


def meter_health(df: DataFrame) -> DataFrame:
    """Per month: shares of stopped, nearly unused, very high and oddly long readings, of suspicious ones, median use a day."""
    x, days, a_day = F.col("m3"), F.col("dias"), F.col("m3_per_day")
    share = lambda c, n: F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n)
    return df.groupBy("mes").agg(
        F.count("*").alias("n"),
        share(x == 0, "pct_zero"),
        share((a_day > 0) & (a_day < 0.005), "pct_very_low"),
        share(a_day > 3, "pct_high_consumption"),
        share((days < 15) | (days > 100), "pct_abnormal_days"),
        F.median("m3_per_day").alias("median_m3_dia"),
        share((x == 0) | (x < 0) | (days < 15) | (days > 45), "pct_suspicious"),
    )


def gini(df: DataFrame, key: str, x: str) -> DataFrame:
    """Gini coefficient of the positive values per key, from counts per distinct value; no key is sorted in one task."""
    return gini_of(df.filter(F.col(x) > 0).groupBy(key, F.col(x).alias("x")).count(), key)


def gini_of(counts: DataFrame, key: str) -> DataFrame:
    """The same from counts (key, x, count) of positive values."""
    ranks = running_sums(counts, "x", {"count": "upto"}, [key])
    places = F.col("count") * (2 * F.col("upto") - F.col("count") + 1) / 2  # sum of the ranks of equal values
    out = ranks.groupBy(key).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("x")).alias("s"), F.sum(places * F.col("x")).alias("t"))
    return out.select(key, (2 * F.col("t") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def binned_entropy(df: DataFrame, key: str, x: str, bins: int = 50) -> DataFrame:
    """Entropy (bits) of the positive values over equal-width bins of each key's range."""
    return entropy_of_bins(df.filter(F.col(x) > 0).groupBy(key, F.col(x).alias("x")).count(), key, bins)


def entropy_of_bins(counts: DataFrame, key: str, bins: int = 50) -> DataFrame:
    """The same from counts (key, x, count) of positive values."""
    pos = counts
    pos = pos.join(pos.groupBy(key).agg(F.min("x").alias("lo"), F.max("x").alias("hi")), key)
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = pos.groupBy(key, b.alias("b")).agg(F.sum("count").alias("count"))
    p = F.col("count") / F.sum("count").over(Window.partitionBy(key))  # at most ``bins`` rows a key
    return counts.withColumn("p", p).groupBy(key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def ks_before(df: DataFrame, key: str, x: str, months: int = 6) -> DataFrame:
    """KS statistic of each month's values against those of the ``months`` before it (of those there are); 0 for the first.

    From counts per distinct value, each carried to the months it is compared in. ``key`` orders the months.
    """
    return ks_of(df.groupBy(key, F.col(x).alias("x")).count(), key, months)


def ks_of(counts: DataFrame, key: str, months: int = 6) -> DataFrame:
    """The same from counts (key, x, count)."""
    nth = counts.select(key).distinct().withColumn("_m", F.row_number().over(Window.orderBy(key)))  # a row a month
    counts = counts.filter("x IS NOT NULL").join(F.broadcast(nth), key)
    rows = counts.select("x", "count", F.explode(F.sequence(F.lit(0), F.lit(months))).alias("_d"), "_m")
    now = (F.col("_d") == 0).cast("long")
    g = rows.groupBy((F.col("_m") + F.col("_d")).alias("_m"), "x").agg(F.sum(F.col("count") * now).alias("a"), F.sum(F.col("count") * (1 - now)).alias("b"))
    all_ = g.groupBy("_m").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    g = running_sums(g, "x", {"a": "ua", "b": "ub"}, ["_m"]).join(F.broadcast(all_), "_m")  # a row a month
    gap = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.abs(F.col("ua") / F.col("na") - F.col("ub") / F.col("nb"))).otherwise(0.0)
    return g.groupBy("_m").agg(F.max(gap).alias("ks")).join(nth, "_m").drop("_m")


def distribution_features(df: DataFrame) -> DataFrame:
    """Per month: shares, skewness and kurtosis (population), delay, Gini, entropy, distance from the months before."""
    p99 = df.filter("m3_per_day > 0").agg(F.percentile("m3_per_day", F.lit(0.99)).alias("p99"))
    pct = lambda c, n: (F.avg(c.cast("int")) * 100).alias(n)
    out = df.crossJoin(F.broadcast(p99)).groupBy("mes").agg(  # p99 is one row
        F.count("*").alias("n_readings"), pct(F.col("m3") == 0, "pct_zero"), pct(F.col("m3") < 0, "pct_negative"), pct(F.col("m3_per_day") > F.col("p99"), "pct_extreme"),
        F.avg("delay").alias("mean_delay"), pct(F.col("delay") > 5, "pct_late"), F.skewness("m3_per_day").alias("skewness"), F.kurtosis("m3_per_day").alias("kurtosis"),
    )
    counts = written(df.groupBy("mes", F.col("m3_per_day").alias("x")).count())  # what all three need of the readings
    positive = counts.filter("x > 0")
    for more in (gini_of(positive, "mes"), entropy_of_bins(positive, "mes"), ks_of(counts, "mes")):
        out = out.join(more, "mes", "left")
    return out


def distribution_flags(f: DataFrame, features: list[str], least: int = 3, z: float = 2.0) -> DataFrame:
    """A month is anomalous if ``least`` features are over ``z`` deviations off; score: their mean |z|."""
    w = Window.partitionBy()  # a row a month
    zs = [F.abs(F.when(F.stddev_samp(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)).otherwise(0.0)) for c in features]
    f = f.withColumn("_z", F.filter(F.array(*zs), lambda x: x > z))
    score = F.when(F.size("_z") > 0, F.aggregate("_z", F.lit(0.0), lambda a, b: a + b) / F.size("_z")).otherwise(0.0)
    return f.withColumns({"n_anomalous": F.size("_z"), "score": score}).withColumn("is_anomaly", F.col("n_anomalous") >= least).drop("_z")
