"""Social alerts: persistent anomalies of a barrio, with a confidence from factors that verify or explain them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
#: Points by the first limit that a factor exceeds, from the highest down.
POINTS = {
    "reclaimed": ((10.0, -35), (5.0, -25), (2.0, -15)),
    "summer_winter": ((2.5, -30), (2.0, -20), (1.5, -10)),
    "cluster_share": ((0.5, -10),),
    "anr": ((5.0, 20), (2.0, 15)),
    "vulnerability": ((0.7, 10),),
    "cpc_slope": ((100.0, 15), (50.0, 10)),
}
START, LEAST, MOST = 50, 5, 100


def reclaimed_ratio(df: DataFrame, key: str, x: str) -> DataFrame:
    """Each key's total over the median total; the window holds a row a key."""
    total = df.groupBy(key).agg(F.sum(x).alias("total"))
    median = F.median("total").over(Window.partitionBy())
    return total.withColumn("reclaimed", F.when(median > 0, F.col("total") / median))


def verification_factors(results: DataFrame, reclaimed: DataFrame, anr: DataFrame, vulnerability: DataFrame) -> DataFrame:
    """Per barrio_key: reclaimed water over the median, summer over winter use, mean water-balance ratio, share of months in a
    cluster, vulnerability, slope of use per contract (over more than 3 months), mean and deviation of the deviation from peers.

    results: barrio_key, barrio, fecha, consumo, cpc, deviation_from_group_trend, spatial_class; the others by barrio.
    """
    month = F.month("fecha")
    rows = results.withColumn("_i", F.row_number().over(Window.partitionBy("barrio_key").orderBy("fecha")).cast("double"))
    dev = F.coalesce("deviation_from_group_trend", F.lit(0.0))
    g = rows.groupBy("barrio_key", "barrio").agg(
        F.avg(F.when(month.isin(6, 7, 8), F.col("consumo"))).alias("summer"),
        F.avg(F.when(month.isin(12, 1, 2), F.col("consumo"))).alias("winter"),
        F.avg((F.col("spatial_class") == "CLUSTER").cast("double")).alias("cluster_share"),
        F.when(F.count("*") > 3, F.regr_slope("cpc", "_i")).otherwise(0.0).alias("cpc_slope"),
        F.avg(dev).alias("dev_mean"),
        F.stddev_pop(dev).alias("dev_std"),
    )
    ratio = F.when((F.col("winter") > 0) & F.col("summer").isNotNull(), F.col("summer") / F.col("winter")).otherwise(1.0)
    g = g.withColumn("summer_winter", ratio)
    for other, name, missing in ((reclaimed, "reclaimed", 0.0), (anr, "anr", 0.0), (vulnerability, "vulnerability", 0.5)):
        g = g.join(other.select("barrio", name), "barrio", "left").withColumn(name, F.coalesce(name, F.lit(missing)))
    return g


def confidence() -> Column:
    """From 50, raised and lowered by the factors, between 5 and 100."""
    parts = []
    for name, steps in POINTS.items():
        points = F.lit(0)
        for limit, worth in reversed(steps):
            points = F.when(F.col(name) > limit, worth).otherwise(points)
        parts.append(points)
    mean, std = F.abs("dev_mean"), F.col("dev_std")
    parts.append(F.when((mean > 0.15) & (std < mean), 15).when(mean > 0.10, 5).otherwise(0))
    return F.least(F.greatest(reduce(lambda a, b: a + b, parts, F.lit(START)), F.lit(LEAST)), F.lit(MOST))


def longest_run(flags: DataFrame) -> DataFrame:
    """Per barrio_key: rows, longest run of months in a row, and whether any two rows are months in a row."""
    m = F.year("fecha") * 12 + F.month("fecha")
    rows = flags.withColumn("_m", m).withColumn("_g", F.col("_m") - F.row_number().over(Window.partitionBy("barrio_key").orderBy("_m")))
    runs = rows.groupBy("barrio_key", "_g").agg(F.count("*").alias("length"), F.sum("consumo").alias("consumo"))
    return runs.groupBy("barrio_key").agg(F.sum("length").alias("months"), F.max("length").alias("longest"), F.sum("consumo").alias("consumo"))


def social_alerts(results: DataFrame, factors: DataFrame) -> DataFrame:
    """Alerts of three kinds per barrio_key, with months, water concerned, priority and confidence.

    EMERGENCIA_POSIBLE: two months in a row over 1.5 times the year before. FUGA_OCULTA: two or more models fire in three
    months in a row. CONSUMO_VULNERABLE: a vulnerable barrio where two models fire once and two months are far off its peers.
    """
    spikes = longest_run(results.filter(F.coalesce("yoy_ratio", F.lit(1.0)) > 1.5)).filter("months >= 2 AND longest >= 2")
    many = longest_run(results.filter("n_models_detecting >= 2")).filter("longest >= 3")
    mean = results.groupBy("barrio_key").agg(F.avg("consumo").alias("mean_consumo"), F.max("n_models_detecting").alias("most_models"))
    far = results.filter(F.abs("deviation_from_group_trend") > 0.3).groupBy("barrio_key").agg(F.count("*").alias("months"), F.sum("consumo").alias("consumo"))
    far = far.join(mean, "barrio_key").join(factors.select("barrio_key", "vulnerability"), "barrio_key").filter("vulnerability > 0.6 AND most_models >= 2 AND months >= 2")

    def alert(df: DataFrame, kind: str, priority: int, water: Column, months: str) -> DataFrame:
        return df.select("barrio_key", F.lit(kind).alias("tipo"), F.lit(priority).alias("prioridad"), F.col(months).cast("long").alias("meses"), water.alias("litros_extra"))

    alerts = alert(spikes, "EMERGENCIA_POSIBLE", 1, F.col("consumo") * 0.3, "months")
    alerts = alerts.unionByName(alert(many.join(mean, "barrio_key"), "FUGA_OCULTA", 2, F.col("mean_consumo") * 0.2 * F.col("longest"), "longest"))
    alerts = alerts.unionByName(alert(far, "CONSUMO_VULNERABLE", 3, F.col("consumo") * 0.15, "months"))
    alerts = alerts.join(factors.withColumn("confianza", confidence()), "barrio_key")
    return alerts.withColumn("verificada", F.col("confianza") >= 60)
