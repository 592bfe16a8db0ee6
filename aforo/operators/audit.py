"""Infrastructure per area, decay of detectors over time, cores and sweeps over their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.geometry import point_in_polygon
from aforo.operators.statistics import correlation

# Fixed values.
#: Factors of infrastructure risk that grow with the value, and that grow as it falls.
RISK_HIGH = ("elevation_mean", "pct_sewer_unitaria")
RISK_LOW = ("pipe_density", "avg_pipe_diameter_mm", "hydrant_density", "imbornal_density", "colector_coverage_pct")
#: Vulnerability from the limit up, estimated share of elderly people.
ELDERLY_SHARE = ((0.8, 0.40), (0.6, 0.30), (0.45, 0.22), (0.3, 0.18))
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")


def assets_per_area(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Per area: hydrants, other outlets, all of both, mean diameter of those that have one, pumps, capacity of deposits.

    points: pid, x, y, kind (HIDRANTE, BOCA, BOMBEO, DEPOSITO), size; areas: poly, ordinal, ring. A point at 0, 0 has no place; one
    in several areas belongs to the first.
    """
    at = point_in_polygon(points.filter("x <> 0 OR y <> 0").select("pid", "x", "y"), areas, cell).filter("poly IS NOT NULL")
    rows = points.join(at.select("pid", "poly"), "pid")
    outlet, is_ = F.col("kind").isin("HIDRANTE", "BOCA"), lambda k: F.col("kind") == k
    return rows.groupBy("poly").agg(
        F.count_if(is_("HIDRANTE")).alias("n_hydrants"),
        F.count_if(is_("BOCA")).alias("n_bocas_riego"),
        F.count_if(outlet).alias("n_total_riego"),
        F.coalesce(F.avg(F.when(outlet & (F.col("size") > 0), F.col("size"))), F.lit(0.0)).alias("avg_hydrant_diameter"),
        F.count_if(is_("BOMBEO")).alias("n_pumping_stations"),
        F.coalesce(F.sum(F.when(is_("DEPOSITO"), F.col("size"))), F.lit(0.0)).alias("deposit_capacity_m3"),
    )


def areas_to_barrios(areas: DataFrame, barrio: str = "barrio") -> DataFrame:
    """Sums, means and densities of a barrio's areas: barrio, area_m2, elevation, pipe_length_m, pipe_diameter, n_total_riego, ..."""
    g = areas.groupBy(barrio).agg(
        (F.sum("area_m2") / 1e6).alias("area_km2"),
        F.avg("elevation").alias("elevation_mean"),
        (F.max("elevation") - F.min("elevation")).alias("elevation_range"),
        F.sum("n_total_riego").alias("n_total_riego"),
        F.sum("pipe_length_m").alias("pipe_length_m"),
        F.avg("pipe_diameter").alias("avg_pipe_diameter_mm"),
        F.count("*").alias("n_sectors"),
    )
    per = lambda x: F.when(F.col("area_km2") > 0, x / F.col("area_km2")).otherwise(0.0)
    return g.withColumns({"pipe_density": per(F.col("pipe_length_m") / 1000), "hydrant_density": per(F.col("n_total_riego"))})


def infrastructure_risk(df: DataFrame, high: tuple[str, ...] = RISK_HIGH, low: tuple[str, ...] = RISK_LOW) -> DataFrame:
    """Sum of the factors scaled to 0..1 over all barrios (``low``: small is risky), 0.5 for one that is the same everywhere."""
    ends = df.agg(*(g(c).alias(f"_{g.__name__}_{c}") for c in dict.fromkeys((*high, *low)) for g in (F.min, F.max)))
    df = df.crossJoin(F.broadcast(ends))  # one row

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    return df.withColumn("infrastructure_risk_score", reduce(lambda a, b: a + b, [scaled(c) for c in high] + [1 - scaled(c) for c in low])).drop(*ends.columns)


def elderly_share(vulnerability: Column) -> Column:
    share = F.lit(0.12)
    for limit, worth in reversed(ELDERLY_SHARE):
        share = F.when(vulnerability >= limit, worth).otherwise(share)
    return share


def model_decay(df: DataFrame, flags: list[str], t: str = "fecha") -> DataFrame:
    """Per detector over the quarters: mean rate in per cent, variation, correlation with time, status. The windows hold a row a quarter."""
    rates = df.groupBy(F.trunc(t, "quarter").alias("quarter")).agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in flags))
    i = F.row_number().over(Window.orderBy("quarter")).cast("double")
    rows = rates.withColumn("_i", i).select("_i", F.inline(F.array(*(F.struct(F.lit(f.removeprefix("is_anomaly_")).alias("model"), F.col(f).alias("rate")) for f in flags))))
    g = rows.filter("rate IS NOT NULL").groupBy("model").agg(
        (F.avg("rate") * 100).alias("mean_rate"), (F.stddev_pop("rate") / (F.avg("rate") + 1e-10)).alias("cv"), F.when(F.stddev_pop("rate") > 0, correlation("_i", "rate")).otherwise(0.0).alias("trend_corr"), F.count("*").alias("quarters")
    ).filter("quarters >= 2")
    status = F.when(F.abs("trend_corr") > 0.7, F.when(F.col("trend_corr") > 0, "DECAY").otherwise("MEJORA")).when(F.col("cv") > 0.5, "INESTABLE").otherwise("ESTABLE")
    return g.withColumn("status", status)


def stable_core(df: DataFrame, ensemble: str, stacking: str, p: str, models: str, least_models: float = 3.0) -> DataFrame:
    """Barrios in the upper quarter by mean ensemble and by mean stacking score, with a month of p under 0.05 and ``least_models``
    models on average; the limits are one row.
    """
    g = df.groupBy("barrio").agg(F.avg(ensemble).alias("ens_mean"), F.max(ensemble).alias("ens_max"), F.avg(stacking).alias("stack_mean"), F.min(p).alias("conf_p_min"), F.count_if(F.col(p) < 0.05).alias("conf_sig"), F.avg(models).alias("n_models_mean"))
    limits = g.agg(F.percentile("ens_mean", F.lit(0.75)).alias("_e"), F.percentile("stack_mean", F.lit(0.75)).alias("_s"))
    core = (F.col("ens_mean") >= F.col("_e")) & (F.col("stack_mean") >= F.col("_s")) & (F.col("conf_sig") > 0) & (F.col("n_models_mean") >= least_models)
    return g.crossJoin(F.broadcast(limits)).withColumn("core", core).drop("_e", "_s")


def multiplier_sweep(own: DataFrame, test: DataFrame, key: str, x: str, y: str, multipliers: tuple[float, ...]) -> DataFrame:
    """Detections by fences of several widths against a label, from training quartiles computed once. own: key, q1, q3; test: key, x, y."""
    rows = test.join(own, key).withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers))))
    width = F.col("multiplier") * (F.col("q3") - F.col("q1"))
    hit = (F.col("q3") > F.col("q1")) & ((F.col(x) < F.col("q1") - width) | (F.col(x) > F.col("q3") + width))
    g = rows.withColumn("_hit", hit).groupBy("multiplier").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("tp", f"_hit AND {y}"), ("fp", f"_hit AND NOT {y}"), ("fn", f"NOT _hit AND {y}"))))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_setting(per: DataFrame, floors: tuple[float, ...] = (0.80, 0.70, 0.0)) -> DataFrame:
    """The setting with the greatest F1 among those of the highest precision floor that any reaches. per: multiplier, precision, f1."""
    tier = F.lit(len(floors))
    for i, floor in reversed(list(enumerate(floors))):
        tier = F.when(F.col("precision") >= floor, i).otherwise(tier)
    best = per.withColumn("_t", tier).agg(F.max(F.struct((-F.col("_t")).alias("t"), "f1", (-F.col("multiplier")).alias("m"), "precision")).alias("b"))
    return best.select((-F.col("b.m")).alias("multiplier"), F.col("b.precision").alias("precision"), F.col("b.f1").alias("f1"), (-F.col("b.t")).cast("int").alias("tier"))


def sigmoid(x: Column, steep: float = 0.8, centre: float = 2.0) -> Column:
    return 1 / (1 + F.exp(-steep * (x - centre)))


def one_hot(df: DataFrame, x: str, values: list) -> DataFrame:
    """A column of 0 and 1 for each of the given values."""
    return df.withColumns({f"{x}_{v}": (F.col(x) == F.lit(v)).cast("int") for v in values})


def plain_name(x: Column) -> Column:
    """Upper case without a leading number and dash, letters and digits only, single blanks."""
    bare = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"^\d+\s*-\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^A-Z0-9 ]", " "), r"\s+", " "))


def spanish_month(year: Column, name: Column) -> Column:
    """The first day of a month given by its Spanish name; null for any other word."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.trim(name))
    return F.when(at > 0, F.make_date(year.cast("int"), at.cast("int"), F.lit(1)))
