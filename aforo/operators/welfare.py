"""Welfare of people behind meters: meter leak risk, vulnerability, alerts on falling consumption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ensemble import average_rank

# Fixed values.
#: Weights of a barrio's vulnerability and of its consumption risk, and of the two in the risk of silent leaks.
LEAK_VULNERABILITY = {"pct_old": 0.35, "pct_elderly_alone": 0.35, "pct_elderly": 0.20, "size": 0.10}
LEAK_CONSUMPTION = {"drop_freq_norm": 0.40, "cv_norm": 0.30, "pct_old": 0.30}
LEAK_RISK = {"vulnerability_score": 0.6, "consumption_risk_score": 0.4}
#: Weights of the scores of elderly vulnerability.
ELDERLY = {"census": 0.40, "low_consumption": 0.15, "stability": 0.10, "size": 0.20, "decline": 0.15}
#: Score by number of contracts: below the limit the score, 0.1 beyond all.
SIZES = ((50, 1.0), (200, 0.7), (500, 0.3))
#: Alert levels in order: worst change below, vulnerability above, level, factor of the confidence.
ALERTS = (
    (-0.50, 0.55, "CRITICO", 2.5),
    (-0.40, 0.70, "CRITICO", 2.0),
    (-0.30, 0.40, "ALTO", 1.8),
    (-0.25, 0.60, "ALTO", 1.5),
    (-0.20, 0.45, "VIGILANCIA", 1.2),
)


def weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(c) * w for c, w in weights.items()))


def between_0_and_1(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def meter_ages(meters: DataFrame, as_of: str, old_years: float = 10.0) -> DataFrame:
    """Per barrio: residential meters, those older than ``old_years``, mean age, share of old ones. meters: barrio, installed."""
    age = F.datediff(F.lit(as_of).cast("date"), "installed") / 365.25
    old = F.col("age") > old_years
    return meters.withColumn("age", age).groupBy("barrio").agg(
        F.count("*").alias("n_meters"), F.count_if(old).alias("n_old_meters"), F.avg("age").alias("mean_age"), F.avg(F.coalesce(old, F.lit(False)).cast("double")).alias("pct_old")
    )


def consumption_behaviour(monthly: DataFrame) -> DataFrame:
    """Per barrio: share of months more than 20 % under the one before, deviation over mean. monthly: barrio, fecha, consumo."""
    prev = F.lag("consumo").over(Window.partitionBy("barrio").orderBy("fecha"))
    fell = F.coalesce((F.col("consumo") - prev) / prev < -0.20, F.lit(False))
    return monthly.withColumn("fell", fell).groupBy("barrio").agg(
        F.avg(F.col("fell").cast("double")).alias("drop_freq"),
        F.when(F.avg("consumo") > 0, F.stddev_samp("consumo") / F.avg("consumo")).otherwise(0.0).alias("consumption_cv"),
    )


def leak_risk(ages: DataFrame, census: DataFrame, behaviour: DataFrame, least_meters: int = 100) -> DataFrame:
    """Risk of silent leaks per barrio: vulnerability of its people and meters, and its consumption.

    Behaviour counts in barrios of ``least_meters`` meters or more, as its rank among the values over 0. census: barrio,
    pct_65plus, pct_65plus_solos in per cent. The windows hold a row a barrio.
    """
    df = ages.join(census, "barrio", "left").join(behaviour, "barrio", "left")
    df = df.withColumns({"pct_elderly_alone": F.coalesce("pct_65plus_solos", F.lit(0.0)) / 100, "pct_elderly": F.coalesce("pct_65plus", F.lit(0.0)) / 100})
    df = df.withColumn("size", F.col("n_meters") / F.max("n_meters").over(Window.partitionBy()))
    for source, name in (("drop_freq", "drop_freq_norm"), ("consumption_cv", "cv_norm")):
        df = df.withColumn(name, F.when(F.col("n_meters") >= least_meters, F.coalesce(source, F.lit(0.0))).otherwise(0.0))
        df = df.withColumn("_on", F.col(name) > 0)
        n = F.count("*").over(Window.partitionBy("_on"))
        df = df.withColumn(name, F.when(F.col("_on") & (n > 1), average_rank(name, "_on") / n).otherwise(F.col(name))).drop("_on")
    df = df.withColumns({"vulnerability_score": weighted(LEAK_VULNERABILITY), "consumption_risk_score": weighted(LEAK_CONSUMPTION)})
    return df.withColumns({"silent_leak_risk": weighted(LEAK_RISK), "estimated_at_risk": F.bround(F.col("n_old_meters") * F.col("pct_elderly_alone")).cast("int")})


def elderly_vulnerability(panel: DataFrame, census: DataFrame, unknown: float = 0.15) -> DataFrame:
    """Per barrio_key: five scores (census, low use per contract, stable use, few contracts, decline) and their weighted mean.

    panel: barrio_key, barrio, fecha, cpc, contratos; census: barrio, pct_65plus. A barrio without census has the score
    ``unknown``. Halves of a history are by rows.
    """
    key = Window.partitionBy("barrio_key")
    rows = panel.withColumns({"_i": F.row_number().over(key.orderBy("fecha")), "_n": F.count("*").over(key)})
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    g = rows.groupBy("barrio_key", "barrio").agg(
        F.count("*").alias("n"),
        F.coalesce(F.median(F.when(F.col("cpc") > 0, F.col("cpc"))), F.lit(0.0)).alias("median_cpc"),
        F.avg("cpc").alias("mean"),
        F.stddev_pop("cpc").alias("std"),
        F.median("contratos").alias("contracts"),
        F.avg(F.when(first, F.col("cpc"))).alias("before"),
        F.avg(F.when(~first, F.col("cpc"))).alias("after"),
    )
    size = F.lit(0.1)
    for limit, score in reversed(SIZES):
        size = F.when(F.col("contracts") < limit, score).otherwise(size)
    trend = (F.col("after") - F.col("before")) / F.col("before")
    declines = (F.col("n") >= 12) & (F.col("before") > 0) & (trend < 0)
    g = g.join(census.select("barrio", "pct_65plus"), "barrio", "left").withColumns(
        {
            "low_consumption": F.when(F.col("median_cpc") > 0, between_0_and_1(1 - F.col("median_cpc") / 15000)).otherwise(0.0),
            "stability": F.when((F.col("n") > 6) & (F.col("mean") > 0), between_0_and_1(1 - F.col("std") / F.col("mean") / 0.40)).otherwise(0.3),
            "size": F.when(F.col("contracts") > 0, size).otherwise(0.3),
            "decline": F.when(declines, F.least(F.abs(trend) * 3, F.lit(1.0))).otherwise(0.0),
            "census": F.when(F.col("pct_65plus") > 0, F.least(F.col("pct_65plus") / 35, F.lit(1.0))).otherwise(unknown),
        }
    )
    return g.withColumn("elderly_vulnerability", F.round(weighted(ELDERLY), 3))


def welfare_alerts(drops: DataFrame, vulnerability: DataFrame, unknown: float = 0.2) -> DataFrame:
    """Rows of ``drops`` that call for an alert: level, confidence, worst change.

    drops: barrio_key, fecha, mom_change, hist_change, drop_severity, consecutive_decline; vulnerability: barrio_key,
    elderly_vulnerability (``unknown`` where missing). The first rule that holds decides.
    """
    df = drops.join(vulnerability.select("barrio_key", "elderly_vulnerability"), "barrio_key", "left")
    df = df.withColumns({"elderly_vulnerability": F.coalesce("elderly_vulnerability", F.lit(unknown)), "worst_drop": F.least("mom_change", "hist_change")})
    drop, v, severity = F.col("worst_drop"), F.col("elderly_vulnerability"), F.col("drop_severity")
    rules = [((drop < below) & (v > above), level, severity * v * factor) for below, above, level, factor in ALERTS]
    rules.append(((F.col("consecutive_decline") >= 3) & (v > 0.50), "VIGILANCIA", 0.3 + v * 0.4))
    rules.append(((severity > 0.3) & (v > 0.55), "VIGILANCIA", severity * v))
    level, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for holds, name, worth in reversed(rules):
        level, confidence = F.when(holds, name).otherwise(level), F.when(holds, F.least(worth, F.lit(1.0))).otherwise(confidence)
    return df.withColumns({"nivel": level, "confidence": confidence}).filter("nivel IS NOT NULL")


def raise_levels(alerts: DataFrame, risk: DataFrame, confirming: DataFrame) -> DataFrame:
    """ALTO becomes CRITICO where silent leaks are likely (over 0.3); then, by models that fire in the month, ALTO (3 or more)
    becomes CRITICO and VIGILANCIA (2 or more) ALTO. risk: barrio, silent_leak_risk; confirming: barrio_key, fecha, n_confirming.
    """
    df = alerts.withColumn("barrio", F.split("barrio_key", "__")[0]).join(risk.select("barrio", "silent_leak_risk"), "barrio", "left")
    df = df.join(confirming.select("barrio_key", "fecha", "n_confirming"), ["barrio_key", "fecha"], "left")
    df = df.withColumns({"silent_leak_risk": F.coalesce("silent_leak_risk", F.lit(0.0)), "other_models_confirming": F.coalesce("n_confirming", F.lit(0)).cast("int")}).drop("n_confirming")
    df = df.withColumn("nivel", F.when((F.col("nivel") == "ALTO") & (F.col("silent_leak_risk") > 0.3), "CRITICO").otherwise(F.col("nivel")))
    n, level = F.col("other_models_confirming"), F.col("nivel")
    return df.withColumn("nivel", F.when((n >= 3) & (level == "ALTO"), "CRITICO").when((n >= 2) & (level == "VIGILANCIA"), "ALTO").otherwise(level))
