"""Hourly flows: day features, night/day ratios, night silence, rolling and embedded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between_hours(lo: int, hi: int, x: str) -> Column:
    return F.when(F.hour("ts").between(lo, hi), F.col(x))


def daily_features(df: DataFrame, key: str, x: str) -> DataFrame:
    """A day's total, night minimum and mean (2 to 5 h), day mean (8 to 22 h), ratio (0 if no day use), active hours."""
    night, day = between_hours(2, 5, x), between_hours(8, 22, x)
    out = df.groupBy(key, F.col("ts").cast("date").alias("dia")).agg(
        F.sum(x).alias("total"), F.coalesce(F.min(night), F.lit(0.0)).alias("night_min"), F.coalesce(F.avg(night), F.lit(0.0)).alias("night_mean"),
        F.coalesce(F.avg(day), F.lit(0.0)).alias("day_mean"), F.count_if(F.col(x) > 0).alias("active_hours"),
    )
    return out.withColumn("night_day_ratio", F.when(F.col("day_mean") > 0.001, F.col("night_mean") / F.col("day_mean")).otherwise(0.0))


def rolling_week(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Mean, deviation and z-score of the last 7 days' totals, null below ``least`` days."""
    w = Window.partitionBy(key).orderBy("dia").rowsBetween(-6, 0)
    enough = F.count("total").over(w) >= least
    df = df.withColumns({"roll_mean": F.when(enough, F.avg("total").over(w)), "roll_std": F.when(enough, F.stddev_samp("total").over(w))})
    return df.withColumn("roll_z", F.when(F.col("roll_std") > 0, (F.col("total") - F.col("roll_mean")) / F.col("roll_std")).otherwise(0.0))


def night_day_ratios(df: DataFrame) -> DataFrame:
    """Per sector and day: mean of hours 2 to 4 over mean of hours 10 to 17; null without day flow."""
    out = df.groupBy("sector", F.col("ts").cast("date").alias("dia")).agg(F.avg(between_hours(2, 4, "caudal")).alias("night"), F.avg(between_hours(10, 17, "caudal")).alias("day"))
    return out.withColumn("ratio", F.when(F.col("day") > 0, F.col("night") / F.col("day")))


def spike_nights(ratios: DataFrame) -> DataFrame:
    w = Window.partitionBy("sector")
    high = (F.col("ratio") > F.avg("ratio").over(w) + 3 * F.stddev_samp("ratio").over(w)) & (F.col("ratio") > 0.8)
    return ratios.withColumn("is_spike", F.coalesce(high, F.lit(False)))


def night_flow_flags(ratios: DataFrame, profile: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Sector score: z of its mean ratio among sectors, plus bonuses for non-domestic and reclaimed use."""
    mean = ratios.groupBy("sector").agg(F.avg("ratio").alias("mean_ratio"))
    all_ = Window.partitionBy()
    std = F.stddev_samp("mean_ratio").over(all_)
    z = F.when(std > 0, (F.col("mean_ratio") - F.avg("mean_ratio").over(all_)) / std).otherwise(0.0)
    df = mean.withColumn("z", z).join(profile, "sector", "left")
    uso = F.when(F.col("non_domestic") > 0.5, 2.0).when(F.col("non_domestic") > 0.3, 1.0).otherwise(0.0)
    regen = F.when(F.col("reclaimed") > 3, 1.5).when(F.col("reclaimed") > 1.5, 0.5).otherwise(0.0)
    return df.withColumn("score", F.col("z") + uso + regen).withColumn("is_anomaly", F.col("score") > threshold)


#: Night over day flow below the limit, and the score of silence.
SILENCE = ((0.01, 1.0), (0.03, 0.85), (0.05, 0.6), (0.10, 0.3))


def night_silence(df: DataFrame, key: str = "sector", x: str = "caudal") -> DataFrame:
    """Per series and day: mean flow of the night (1 to 5 h) and the day (8 to 21 h), their ratio, a score of silence.

    Days without night hours, day hours or day flow are left out.
    """
    out = df.groupBy(key, F.col("ts").cast("date").alias("dia")).agg(F.avg(between_hours(1, 5, x)).alias("night"), F.avg(between_hours(8, 21, x)).alias("day"))
    out = out.filter("night IS NOT NULL AND day > 0").withColumn("ratio", F.col("night") / F.col("day"))
    score = F.lit(0.0)
    for limit, worth in reversed(SILENCE):
        score = F.when(F.col("ratio") < limit, worth).otherwise(score)
    return out.withColumn("silence", score)


def silent_months(days: DataFrame, key: str = "sector") -> DataFrame:
    """Per series and month, over the days with some silence: mean and greatest score, silent days (over 0.5) and their share."""
    some = days.filter("silence > 0").groupBy(key, F.trunc("dia", "month").alias("mes"))
    out = some.agg(F.avg("silence").alias("avg_silence"), F.max("silence").alias("max_silence"), F.count_if(F.col("silence") > 0.5).alias("days_silent"), F.count("*").alias("total_days"))
    return out.withColumn("pct_days_silent", F.col("days_silent") / F.col("total_days"))


def rolling_day(df: DataFrame, key: str, x: str) -> DataFrame:
    """Mean of the last 24 hours, the hour 24 back excluded, by time and not by rows."""
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-86399, 0)
    return df.withColumn("_s", sec).withColumn("mean_24h", F.avg(x).over(w)).drop("_s")


def takens(df: DataFrame, key: str, x: str, dim: int = 3) -> DataFrame:
    """Delay embedding: each row with the next values of its series; incomplete rows go."""
    w = Window.partitionBy(key).orderBy("ts")
    out = df.select(key, "ts", F.col(x).alias("x0"), *(F.lead(x, i).over(w).alias(f"x{i}") for i in range(1, dim)))
    return out.filter(F.col(f"x{dim - 1}").isNotNull())


def blocks(df: DataFrame, key: str, x: str, size: int = 4) -> DataFrame:
    """Means of ``size`` rows in a row."""
    b = F.floor((F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1) / size)
    return df.withColumn("block", b).groupBy(key, "block").agg(F.avg(x).alias("mean"), F.count("*").alias("n"))


def household_features(df: DataFrame) -> DataFrame:
    """Per contract: night ratio, deep-night baseline, variation, slope of daily totals, empty days, daily mean."""
    hourly = df.groupBy("contrato").agg(
        (F.avg(between_hours(0, 5, "litros")) / (F.avg(between_hours(8, 22, "litros")) + 1e-9)).alias("night_flow_ratio"),
        F.coalesce(F.percentile(between_hours(2, 4, "litros"), F.lit(0.1)), F.lit(0.0)).alias("nocturnal_baseline"),
        (F.stddev_samp("litros") / (F.avg("litros") + 1e-9)).alias("consumption_cv"),
    )
    daily = df.groupBy("contrato", F.col("ts").cast("date").alias("dia")).agg(F.sum("litros").alias("total"))
    daily = daily.withColumn("i", F.row_number().over(Window.partitionBy("contrato").orderBy("dia")).cast("double"))
    daily = daily.groupBy("contrato").agg(
        F.when(F.count("*") >= 5, F.regr_slope("total", "i")).otherwise(0.0).alias("daily_trend_slope"), F.count_if(F.col("total") < 5).alias("zero_consumption_days"), F.avg("total").alias("mean_daily_L")
    )
    return hourly.join(daily, "contrato")


def classify_households(f: DataFrame, night: float = 0.5, cv: float = 0.8, slope: float = 2.0, zero_days: int = 3) -> DataFrame:
    """The suspicion with the highest score (ties: the first of leak, silent leak, broken meter, fraud); alert above 0.3."""
    one = F.lit(1.0)
    leak = F.when(
        (F.col("night_flow_ratio") > night) & (F.col("consumption_cv") < cv),
        F.least((F.col("night_flow_ratio") - night) / 0.5, one) * 0.5 + F.least((cv - F.col("consumption_cv")) / cv, one) * 0.3 + F.least(F.col("nocturnal_baseline") / 3, one) * 0.2,
    )
    silent = F.when(F.col("daily_trend_slope") > slope, F.least(F.col("daily_trend_slope") / (slope * 6), one) * 0.7 + F.when(F.col("night_flow_ratio") > 0.3, 0.2).otherwise(0.0))
    broken = F.when(F.col("zero_consumption_days") > zero_days, F.least(F.col("zero_consumption_days") / 10, one))
    fraud = F.when((F.col("mean_daily_L") < 40) & (F.col("nocturnal_baseline") > 0.5) & (F.col("consumption_cv") < 0.5), F.greatest(0.4 + F.least(0.5 - F.col("mean_daily_L") / 100, F.lit(0.5)), F.lit(0.0)))
    kinds = [("fuga_fisica", leak), ("fuga_silenciosa", silent), ("contador_roto", broken), ("fraude_contador", fraud)]
    some = F.filter(F.array(*(F.when(s.isNotNull(), F.struct(s.alias("score"), F.lit(-i).alias("first"), F.lit(k).alias("kind"))) for i, (k, s) in enumerate(kinds))), lambda x: x.isNotNull())
    best = F.array_max(some)
    out = f.withColumns({"tipo_sospecha": F.coalesce(best["kind"], F.lit("normal")), "anomaly_score": F.coalesce(best["score"], F.lit(0.0))})
    return out.withColumn("alerta", F.col("anomaly_score") > 0.3)


def band_power(df: DataFrame, key: str, x: str, periods: tuple[int, ...] = (24, 12)) -> DataFrame:
    """Share of a series' variance at fixed periods (hours), by sums of products with sine and cosine."""
    w = Window.partitionBy(key)
    df = df.withColumns({"_i": F.row_number().over(w.orderBy("ts")).cast("double"), "_x": F.col(x) - F.avg(x).over(w)})
    aggs = [F.count("*").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("energy")]
    for p in periods:
        angle = F.col("_i") * (2 * 3.141592653589793 / p)
        aggs += [F.sum(F.col("_x") * F.cos(angle)).alias(f"c{p}"), F.sum(F.col("_x") * F.sin(angle)).alias(f"s{p}")]
    out = df.groupBy(key).agg(*aggs)
    power = {f"power_{p}h": F.when(F.col("energy") > 0, 2 * (F.col(f"c{p}") * F.col(f"c{p}") + F.col(f"s{p}") * F.col(f"s{p}")) / (F.col("n") * F.col("energy"))).otherwise(0.0) for p in periods}
    return out.select(key, "n", *(v.alias(k) for k, v in power.items()))


# Litres an hour at night, deviations over the mean of a day, litres a day, from which (below which) a day is the first suspect one.
NIGHT_LITRES, DAY_DEVIATIONS, BROKEN_LITRES = 1.0, 0.5, 5


def leak_start(hourly: DataFrame, suspects: DataFrame, key: str = "contrato", t: str = "ts", x: str = "litros") -> DataFrame:
    """(key, tipo_sospecha, leak_start): the first day of a contract that shows what it is suspected of, or its first day where none does or for another kind.

    fuga_fisica: a mean of the hours 0 to 5 over NIGHT_LITRES; fuga_silenciosa: a total over the mean by DAY_DEVIATIONS deviations;
    contador_roto: a total under BROKEN_LITRES. suspects: key, tipo_sospecha.
    """
    night = F.hour(t) <= 5
    days = hourly.groupBy(key, F.col(t).cast("date").alias("_day")).agg(F.sum(x).alias("_total"), F.avg(F.when(night, F.col(x))).alias("_night"))
    g = days.groupBy(key).agg(F.avg("_total").alias("_m"), F.stddev_samp("_total").alias("_s"))
    rows = days.join(g, key).join(suspects.select(key, "tipo_sospecha"), key, "right")
    kind = F.col("tipo_sospecha")
    shows = ((kind == "fuga_fisica") & (F.col("_night") > NIGHT_LITRES)) | ((kind == "fuga_silenciosa") & (F.col("_total") > F.col("_m") + F.col("_s") * DAY_DEVIATIONS)) | ((kind == "contador_roto") & (F.col("_total") < BROKEN_LITRES))
    return rows.groupBy(key, "tipo_sospecha").agg(F.coalesce(F.min(F.when(shows, F.col("_day"))), F.min("_day")).alias("leak_start"))
