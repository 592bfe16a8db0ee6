"""Features of a monthly panel (barrio_key, uso, fecha, consumo, contratos, cpc), one function each.

Everything is a window or an equi-join on the panel's own keys; frames of rows are by fecha inside a
barrio_key. Neutral values where a feature is undefined are part of the definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key():
    return Window.partitionBy("barrio_key")


def _series():
    return _key().orderBy("fecha")


def _peers():
    return Window.partitionBy("uso", "fecha")


def trailing(n: int) -> Window:
    """This row and the n - 1 before it."""
    return _series().rowsBetween(-(n - 1), 0)


def safe(num: Column, den: Column, other: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(other))


def yoy_ratio(df: DataFrame) -> DataFrame:
    """Against the same month a year before (calendar, not rows); 1 without one."""
    prev = df.select("barrio_key", F.add_months("fecha", 12).alias("fecha"), F.col("consumo").alias("prev"))
    return df.join(prev, ["barrio_key", "fecha"], "left").withColumn("yoy_ratio", safe(F.col("consumo"), F.col("prev"), 1.0)).drop("prev")


def seasonal_zscore(df: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Against all values of the calendar month (before ``cutoff``, if given); 0 without spread."""
    w = Window.partitionBy("barrio_key", F.month("fecha"))
    x = F.when(F.col("fecha") < F.lit(cutoff).cast("date"), F.col("consumo")) if cutoff else F.col("consumo")
    mean, std = F.avg(x).over(w), F.stddev_samp(x).over(w)
    return df.withColumn("seasonal_zscore", safe(F.col("consumo") - mean, std, 0.0))


def cross_sectional_zscore(df: DataFrame) -> DataFrame:
    mean, std = F.avg("cpc").over(_peers()), F.stddev_samp("cpc").over(_peers())
    return df.withColumn("cross_sectional_zscore", safe(F.col("cpc") - mean, std, 0.0))


def type_percentile(df: DataFrame) -> DataFrame:
    return df.withColumn("type_percentile", F.cume_dist().over(_peers().orderBy("cpc")))


def trend_3m(df: DataFrame) -> DataFrame:
    """Slope of up to three values over their mean."""
    w = trailing(3)
    df = df.withColumn("_i", F.row_number().over(_series()).cast("double"))
    slope, mean = F.regr_slope("cpc", "_i").over(w), F.avg("cpc").over(w)
    flat = (F.count("cpc").over(w) < 2) | (F.coalesce(F.stddev_pop("cpc").over(w), F.lit(0.0)) == 0) | (mean == 0)
    return df.withColumn("trend_3m", F.when(flat, 0.0).otherwise(slope / mean)).drop("_i")


def months_above_mean(df: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Length of the run of months above the mean (of months before ``cutoff``) that ends here."""
    x = F.when(F.col("fecha") < F.lit(cutoff).cast("date"), F.col("consumo")) if cutoff else F.col("consumo")
    df = df.withColumn("_a", (F.col("consumo") > F.avg(x).over(_key())).cast("int"))
    df = df.withColumn("_g", F.sum(1 - F.coalesce("_a", F.lit(0))).over(_series()))
    streak = F.sum("_a").over(Window.partitionBy("barrio_key", "_g").orderBy("fecha"))
    return df.withColumn("months_above_mean", F.coalesce(streak, F.lit(0)).cast("int")).drop("_a", "_g")


def group_trend_deviation(df: DataFrame) -> DataFrame:
    """yoy_ratio less its median among the peers of the month."""
    df = df if "yoy_ratio" in df.columns else yoy_ratio(df)
    df = df.withColumn("group_yoy_median", F.median("yoy_ratio").over(_peers()))
    return df.withColumn("deviation_from_group_trend", F.col("yoy_ratio") - F.coalesce("group_yoy_median", F.lit(1.0)))


def relative_consumption(df: DataFrame) -> DataFrame:
    return df.withColumn("relative_consumption", safe(F.col("cpc"), F.median("cpc").over(_peers()), 1.0))


def persistence(df: DataFrame) -> DataFrame:
    """Mean z-score of 3 months, sum of run lengths over 6, second difference of cpc."""
    if "seasonal_zscore" not in df.columns:
        df = seasonal_zscore(df)
    if "months_above_mean" not in df.columns:
        df = months_above_mean(df)
    second = F.col("cpc") - 2 * F.lag("cpc", 1).over(_series()) + F.lag("cpc", 2).over(_series())
    return df.withColumns(
        {
            "zscore_rolling_3m": F.avg("seasonal_zscore").over(trailing(3)),
            "above_mean_streak": F.sum("months_above_mean").over(trailing(6)).cast("double"),
            "trend_accel": F.coalesce(second, F.lit(0.0)),
        }
    )


def lags(df: DataFrame) -> DataFrame:
    """Lags by row, rolling statistics, volatility, momentum, change of the year-on-year ratio."""
    df = df if "yoy_ratio" in df.columns else yoy_ratio(df)
    lag1 = F.lag("cpc", 1).over(_series())
    mean3, std3 = F.avg("cpc").over(trailing(3)), F.stddev_samp("cpc").over(trailing(3))
    out = {f"lag_{n}": F.coalesce(F.lag("cpc", n).over(_series()), F.col("cpc")) for n in (1, 2, 12)}
    out |= {
        "log_consumption": F.log1p(F.greatest("cpc", F.lit(0.0))),
        "rolling_mean_3": mean3,
        "rolling_std_3": F.coalesce(std3, F.lit(0.0)),
        "rolling_mean_6": F.avg("cpc").over(trailing(6)),
        "consumption_volatility": F.coalesce(safe(std3, mean3, 0.0), F.lit(0.0)),
        "momentum": safe(F.col("cpc") - lag1, lag1, 0.0),
        "yoy_acceleration": F.coalesce(F.col("yoy_ratio") - F.lag("yoy_ratio", 1).over(_series()), F.lit(0.0)),
    }
    return df.withColumns(out)


def fourier(df: DataFrame) -> DataFrame:
    """Annual and half-year waves, scale and (if there) volatility by trend."""
    angle = F.month("fecha") * (2 * 3.141592653589793)
    scale = F.log1p(F.greatest("cpc", F.lit(0.0))) * F.log1p(F.greatest("contratos", F.lit(1.0)))
    out = {"sin_month": F.sin(angle / 12), "cos_month": F.cos(angle / 12), "sin_quarter": F.sin(angle / 6), "cos_quarter": F.cos(angle / 6), "consumption_x_contracts": scale}
    if {"consumption_volatility", "trend_3m"} <= set(df.columns):
        out["volatility_x_trend"] = F.col("consumption_volatility") * F.col("trend_3m")
    return df.withColumns(out)


def external_adjusted(df: DataFrame, alpha: float = 0.03, base: float = 18.0, beta: float = 0.002, least: float = 0.5) -> DataFrame:
    """Consumption per contract at reference weather and without visitors; drought index.

    From columns avg_temp, tourist_occupancy_pct and spei_index, null where unknown (then the factor is 1, the index 0).
    """
    warm = F.greatest(1 + alpha * (F.coalesce("avg_temp", F.lit(base)) - base), F.lit(least))
    visitors = 1 + beta * F.coalesce("tourist_occupancy_pct", F.lit(0.0))
    return df.withColumns({"temp_adjusted_consumption": F.col("cpc") / warm, "tourism_adjusted_consumption": F.col("cpc") / visitors, "spei_index": F.coalesce("spei_index", F.lit(0.0))})


def consumption_drops(df: DataFrame) -> DataFrame:
    """Changes against last month, the mean of up to 12 before and 12 rows back; run of declines; severity."""
    n, i = F.count("*").over(_key()), F.row_number().over(_series()) - 1
    df = df.withColumns({"_n": n, "_i": i}).filter("_n >= 3")
    body = F.when(F.col("_i") < F.col("_n") - 1, F.col("cpc"))
    past = F.when(F.col("_i") >= 3, F.avg("cpc").over(_series().rowsBetween(-12, -1))).otherwise(F.avg(body).over(_key()))
    prev, year = F.lag("cpc", 1).over(_series()), F.lag("cpc", 12).over(_series())
    df = df.withColumns({"_p": past, "_s": F.stddev_pop(body).over(_key())})
    streak = F.lit(0)
    for k in range(5, -1, -1):  # six rows back at most: 1 + (2 + ...) while each is lower than the one before
        falls = F.coalesce(F.lag("cpc", k).over(_series()) < F.lag("cpc", k + 1).over(_series()), F.lit(False))
        streak = F.when(falls, 1 + streak).otherwise(0)
    df = df.withColumns(
        {
            "mom_change": safe(F.col("cpc") - prev, prev, 0.0),
            "hist_change": safe(F.col("cpc") - F.col("_p"), F.col("_p"), 0.0),
            "seasonal_change": safe(F.col("cpc") - year, year, 0.0),
            "zscore_historical": F.when((F.col("_s") > 0) & (F.col("_i") >= 3), (F.col("cpc") - F.col("_p")) / F.col("_s")).otherwise(0.0),
            "consecutive_decline": streak.cast("int"),
        }
    )
    parts = [F.when(F.col(c) < 0, F.least(F.abs(c), F.lit(1.0))) for c in ("mom_change", "hist_change", "seasonal_change")]
    parts.append(F.when(F.col("zscore_historical") < -1.5, F.least(F.abs("zscore_historical") / 4, F.lit(1.0))))
    some = F.filter(F.array(*parts), lambda x: x.isNotNull())
    severity = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, b: a + b) / F.size(some)).otherwise(0.0)
    return df.withColumn("drop_severity", severity).drop("_n", "_i", "_p", "_s")


def split_train(df: DataFrame, most: int = 24, share: float = 0.7) -> DataFrame:
    """Column train: in the first min(most, floor(share * months)) distinct months."""
    nth = F.row_number().over(Window.orderBy("fecha"))
    months = df.select("fecha").distinct().withColumn("_nth", nth).withColumn("_n", F.count("*").over(Window.partitionBy()))
    months = months.select("fecha", (F.col("_nth") <= F.least(F.lit(most), F.floor(F.col("_n") * share))).alias("train"))
    return df.join(F.broadcast(months), "fecha")  # a row a month


def deviation_flags(df: DataFrame, multiplier: float = 1.5, least_rows: int = 6, least_deviation: float = 0.10) -> DataFrame:
    """Three sigma and fences of the training months, by series, on the deviation from the group's trend.

    Only rows after training, of series with enough training rows. Columns is_3sigma, is_iqr and
    is_anomaly (either, and far enough from 0).
    """
    df = split_train(group_trend_deviation(df))
    x = "deviation_from_group_trend"
    own = df.filter("train").groupBy("barrio_key").agg(
        F.count(x).alias("_n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.percentile(x, F.lit(0.25)).alias("_q1"), F.percentile(x, F.lit(0.75)).alias("_q3")
    )
    test = df.filter("NOT train").join(own.filter(F.col("_n") >= least_rows), "barrio_key")
    iqr = F.col("_q3") - F.col("_q1")
    sigma = F.coalesce((F.col("_s") > 0) & (F.abs(F.col(x) - F.col("_m")) > 3 * F.col("_s")), F.lit(False))
    fence = (iqr > 0) & ((F.col(x) < F.col("_q1") - multiplier * iqr) | (F.col(x) > F.col("_q3") + multiplier * iqr))
    test = test.withColumns({"is_3sigma": sigma, "is_iqr": fence})
    return test.withColumn("is_anomaly", (F.col("is_3sigma") | F.col("is_iqr")) & (F.abs(x) >= least_deviation)).drop("_n", "_m", "_s", "_q1", "_q3", "train")
