"""Queries of the detectors that learn from earlier months. Their results are random or iterative: tests, not SQL, say what
they return.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import learned as le
from aforo.operators import monthly as m
from aforo.operators.ranges import written
from aforo.plans.ensemble import FLAGS, KEYS, pseudo
from aforo.sources.adapters import census, panel

# The monthly features; those of them that are relative; advanced ones; waves and products; demographic ones; how many M2 keeps.
MONTHLY = [
    "consumption_per_contract", "yoy_ratio", "seasonal_zscore", "cross_sectional_zscore", "type_percentile", "trend_3m", "months_above_mean", "deviation_from_group_trend",
    "relative_consumption", "group_yoy_median", "zscore_rolling_3m", "above_mean_streak", "trend_accel",
]
RELATIVE = [
    "deviation_from_group_trend", "relative_consumption", "seasonal_zscore", "cross_sectional_zscore", "type_percentile", "trend_3m", "months_above_mean", "zscore_rolling_3m",
    "above_mean_streak", "trend_accel",
]
ADVANCED = ["log_consumption", "consumption_volatility", "momentum", "yoy_acceleration"]
WAVES = ["sin_month", "cos_month", "sin_quarter", "cos_quarter", "consumption_x_contracts", "volatility_x_trend"]
DEMOGRAPHIC = ["pct_65plus", "pct_65plus_solos"]
KEPT = 20
FEATURES = RELATIVE


def monthly_features(spark, sf_dir, grain="nation"):
    df = m.trend_3m(m.type_percentile(m.cross_sectional_zscore(m.seasonal_zscore(m.yoy_ratio(panel(spark, sf_dir, grain))))))
    df = m.persistence(m.relative_consumption(m.group_trend_deviation(m.months_above_mean(df))))
    return m.split_train(m.fourier(m.lags(df))).withColumn("consumption_per_contract", F.col("cpc"))


def m2(spark, sf_dir):
    """Households against households of other barrios."""
    df = monthly_features(spark, sf_dir).filter("trim(uso) = 'HOUSEHOLD'").join(census(spark, sf_dir), "barrio", "left")
    df = written(df)  # read for the choice of features, the training sample and the scores
    chosen = le.informative(df.filter("train"), [*RELATIVE, *ADVANCED, *WAVES, *DEMOGRAPHIC], "deviation_from_group_trend", KEPT)
    return le.cross_sectional_forest(df, KEYS, chosen, "cpc", "barrio_key")


def m1m(spark, sf_dir):
    return le.series_forests(monthly_features(spark, sf_dir, "region"), "barrio_key", "fecha", MONTHLY)


def m7(spark, sf_dir):
    return le.interval_forecast(m.split_train(panel(spark, sf_dir)), "barrio_key", "fecha", "cpc")


def e5(spark, sf_dir):
    df = pseudo(spark, sf_dir).withColumns({"_families": sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in FLAGS), F.lit(0)), "_cross_season": (F.col(FLAGS[0]) & F.col(FLAGS[1])).cast("int")})
    return le.stacking(df, KEYS, [*FLAGS, "abs_dev", "seasonal_zscore", "_families", "_cross_season"], "pseudo_label")


def e10(spark, sf_dir):
    return le.ablation(pseudo(spark, sf_dir), FLAGS, "pseudo_label")


QUERIES = {"m2_cross_sectional_forest": m2, "m1m_series_forests": m1m, "m7_interval_forecast": m7, "e5_stacking": e5, "e10_ablation": e10}
ORACLE_SQL: dict[str, str] = {}
