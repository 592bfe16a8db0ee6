"""Detections against outside evidence: meter changes and ages, ranks of barrios, tests between detectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ranges import running_sums, spread, written
from aforo.operators.resampling import draw

# Rounds of permutation and of bootstrap, units and rounds at least, ranks compared, limits of stability and their names.
PERMUTATIONS, BOOTSTRAPS, LEAST_UNITS, LEAST_ROUNDS, TOP = 10_000, 1_000, 5, 10, 10
STABILITY = ((0.5, "ESTABLE"), (1.0, "VARIABLE"))


def problematic_rate(changes: DataFrame, month: str, reason: str, problematic: tuple[str, ...]) -> DataFrame:
    """Per month: total changes, those for one of the problematic reasons, their share, nth (months with changes, from 0)."""
    g = changes.filter(F.col(month).isNotNull()).groupBy(F.col(month).alias("month")).agg(F.count("*").alias("total"), F.count_if(F.col(reason).isin(*problematic)).alias("problematic"))
    return g.select("month", "total", "problematic", (F.col("problematic") / F.col("total")).alias("rate"), (F.row_number().over(Window.orderBy("month")) - 1).alias("nth"))  # a row a month


def rate_trend(rates: DataFrame) -> DataFrame:
    """One row: the slope of the rate by month (0 for fewer than two)."""
    return rates.agg(F.coalesce(F.regr_slope("rate", F.col("nth").cast("double")), F.lit(0.0)).alias("trend_slope"), F.count("*").alias("months"))


def _mean_rank(c: str) -> Column:
    """Rank from 1, the highest first, ties share their mean; over a row a barrio."""
    w = Window.orderBy(F.desc(c))
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0


def meter_risk(meters: DataFrame, at: str) -> DataFrame:
    """Per barrio: total_counters, smart_pct, manual_pct, mean, median and greatest age in years, the mean of the ranks by mean age and by manual share.

    meters: barrio, installed (null: unknown), smart. A barrio without known ages has no rank.
    """
    age = F.datediff(F.lit(at).cast("date"), "installed") / 365.25
    g = meters.groupBy("barrio").agg(F.count("*").alias("total_counters"), F.count_if("smart").alias("smart_count"), F.avg(age).alias("mean_age_years"), F.median(age).alias("median_age_years"), F.max(age).alias("max_age_years"))
    g = g.withColumn("smart_pct", 100 * F.col("smart_count") / F.col("total_counters")).withColumn("manual_pct", 100 - F.col("smart_pct"))
    ranked = g.withColumns({"age_rank": F.when(F.col("mean_age_years").isNotNull(), _mean_rank("mean_age_years")), "manual_rank": _mean_rank("manual_pct")})
    return ranked.withColumn("risk_score", (F.col("age_rank") + F.col("manual_rank")) / 2)


def ground_truth(detections: DataFrame, risk: DataFrame) -> DataFrame:
    """Per barrio: mean and greatest score, mean detectors, months with a detection, months, their share, red and yellow months, and the meters' figures.

    detections: barrio, score, n_models, alert; risk: of meter_risk.
    """
    g = detections.groupBy("barrio").agg(
        F.avg("score").alias("mean_anomaly_score"), F.max("score").alias("max_anomaly_score"), F.avg("n_models").alias("mean_n_models"), F.count_if(F.col("n_models") > 0).alias("total_detections"), F.count("score").alias("n_observations"),
        F.count_if(F.col("alert") == "ROJO").alias("n_red"), F.count_if(F.col("alert") == "AMARILLO").alias("n_yellow"),
    )
    return g.withColumn("detection_rate", F.col("total_detections") / F.col("n_observations")).join(risk, "barrio", "left")


def ground_truth_overlap(validation: DataFrame, detections: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: correlation by month of mean score and of detection rate with the problematic rate, common months, barrios in the upper quarter by
    mean score, those of them whose risk rank is in the lower half, their share in per cent. detections: with month.
    """
    monthly = detections.groupBy("month").agg(F.avg("score").alias("s"), F.avg((F.col("n_models") > 0).cast("int")).alias("d")).join(rates.select("month", "rate"), "month")
    months = monthly.agg(F.when(F.count("*") > 2, F.corr("s", "rate")).alias("temporal_corr_score"), F.when(F.count("*") > 2, F.corr("d", "rate")).alias("temporal_corr_detection_rate"), F.count("*").alias("n_common_months"))
    limits = validation.agg(F.percentile("mean_anomaly_score", F.lit(0.75)).alias("_t"), F.median("risk_score").alias("_m"))  # a row a barrio goes in
    top = validation.crossJoin(F.broadcast(limits)).filter(F.col("mean_anomaly_score") >= F.col("_t"))  # one row
    overlap = top.agg(F.count("*").alias("n_top"), F.count_if(F.col("risk_score") <= F.col("_m")).alias("n_overlap")).withColumn("overlap_pct", F.when(F.col("n_top") > 0, 100 * F.col("n_overlap") / F.col("n_top")).otherwise(0.0))
    return months.crossJoin(F.broadcast(overlap))  # one row each


def _ranks(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean ranks of the columns within each group, as r_<column>; groups are of a row a unit."""
    w = Window.partitionBy(*by)
    return df.withColumns({f"r_{c}": F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0 for c in cols})


def external_validation(df: DataFrame, permutations: int = PERMUTATIONS, bootstraps: int = BOOTSTRAPS, seed: str = "ext") -> DataFrame:
    """Per evidence: rho (Spearman's, of detections and evidence over units), p_value (permutations with a rho as far from 0), ci_low and ci_high (2.5 and
    97.5 per cent of resampled rhos), hit_rate (the k highest by evidence that are among the k highest by detections), k, n.

    df: evidence, unit (a string), x (detections), y (evidence); a row an evidence and unit, units without either are left out, and evidences of
    fewer than LEAST_UNITS units. Every permutation and draw is a hash; work is rounds times units, sorted within a round.
    """
    rows = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("evidence"))).filter(F.col("n") >= LEAST_UNITS)
    w = Window.partitionBy("evidence")
    rows = _ranks(rows, ["evidence"], ["x", "y"]).withColumns({"i": F.row_number().over(w.orderBy("unit")), "k": F.least(F.lit(TOP), F.floor(F.col("n") / 2))})
    rows = rows.withColumns({"hx": F.row_number().over(w.orderBy(F.desc("x"), "unit")), "hy": F.row_number().over(w.orderBy(F.desc("y"), "unit"))})
    rows = written(rows.select("evidence", "unit", "x", "y", "r_x", "r_y", "i", "n", "k", "hx", "hy"))
    real = rows.groupBy("evidence").agg(F.corr("r_x", "r_y").alias("rho"), F.max("n").alias("n"), F.max("k").alias("k"), (F.count_if((F.col("hx") <= F.col("k")) & (F.col("hy") <= F.col("k"))) / F.max("k")).alias("hit_rate"))
    dealt = spread(rows, "evidence", "unit")  # each row becomes ``permutations`` rows
    mixed = dealt.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    mixed = mixed.withColumn("j", F.row_number().over(Window.partitionBy("evidence", "round").orderBy(draw(F.lit(seed), "evidence", "round", "unit"), "unit")))
    pairs = mixed.select("evidence", "round", "i", "r_x").join(mixed.select("evidence", "round", F.col("j").alias("i"), "r_y"), ["evidence", "round", "i"])
    null = pairs.groupBy("evidence", "round").agg(F.corr("r_x", "r_y").alias("c")).join(real.select("evidence", "rho"), "evidence")
    p = null.groupBy("evidence").agg(((F.count_if(F.round(F.abs("c"), 9) >= F.round(F.abs("rho"), 9)) + 1) / (F.count("*") + 1)).alias("p_value"))
    slots = dealt.select("evidence", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(bootstraps))).alias("round"))
    slots = slots.select("evidence", "round", F.col("i").alias("slot"), (draw(F.lit(seed), "evidence", "round", "i") % F.col("n") + 1).cast("int").alias("i"))
    drawn = _ranks(slots.join(rows.select("evidence", "i", "x", "y"), ["evidence", "i"]), ["evidence", "round"], ["x", "y"])
    rhos = drawn.groupBy("evidence", "round").agg(F.corr("r_x", "r_y").alias("c")).filter("c IS NOT NULL AND NOT isnan(c)")
    ci = rhos.groupBy("evidence").agg(*(F.when(F.count("*") >= LEAST_ROUNDS, F.percentile("c", F.lit(q))).alias(name) for q, name in ((0.025, "ci_low"), (0.975, "ci_high"))))
    return real.join(p, "evidence", "left").join(ci, "evidence", "left").select("evidence", "rho", "p_value", "ci_low", "ci_high", "hit_rate", "k", "n")


#: Logarithms of 1, 1 * 3, 1 * 3 * 5, ...
_LOG_ODD = [math.lgamma(n + 1.5) + (n + 1) * math.log(2) - 0.5 * math.log(math.pi) for n in range(250)]


def normal_tails(z: Column) -> Column:
    """The chance that a normal number is at least as far from 0 as z, by the series of its density times odd powers; 0 beyond 9."""
    a = F.abs(z)
    terms = F.transform(F.array(*map(F.lit, _LOG_ODD)), lambda c, n: F.exp((2 * n + 1) * F.log(a) - a * a / 2 - c))
    inside = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / math.sqrt(2 * math.pi)
    return F.when(a == 0, 1.0).when(a > 9, 0.0).otherwise(F.greatest(1 - 2 * inside, F.lit(0.0)))


def chi_squared_tail(x: Column, dof: int) -> Column:
    """The chance of a chi squared of at least x: a finite sum, and for odd degrees a normal tail."""
    half, start = x / 2, dof % 2
    out = normal_tails(F.sqrt(x)) if start else F.lit(0.0)
    for i in range(start, dof, 2):  # half ** (i / 2) / gamma(i / 2 + 1)
        out = out + F.exp(-half) * F.pow(half, F.lit(i / 2)) / math.gamma(i / 2 + 1)
    return out


def friedman(df: DataFrame, unit: str, models: list[str]) -> DataFrame:
    """One row: Friedman's statistic over units (complete rows) of the models' scores, corrected for ties, its p-value, units; no row for fewer than three models or units."""
    k = len(models)
    rows = df.dropna(subset=models)
    scores = F.array(*(F.col(m).cast("double") for m in models))
    rank = lambda v: F.size(F.filter(scores, lambda x: x < v)) + (F.size(F.filter(scores, lambda x: x == v)) + 1) / 2.0
    rows = rows.select(*(rank(F.col(m).cast("double")).alias(f"r{i}") for i, m in enumerate(models)), F.aggregate(F.transform(scores, lambda v: F.size(F.filter(scores, lambda x: x == v)).cast("double")), F.lit(0.0), lambda a, n: a + n * n - 1).alias("ties"))
    n = F.count("*")
    total = sum((F.sum(f"r{i}") * F.sum(f"r{i}") for i in range(k)), F.lit(0.0))
    g = rows.agg(n.alias("n"), ((12 * total / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - F.sum("ties") / (n * k * (k * k - 1)))).alias("statistic"))
    return g.filter((F.col("n") >= 3) & F.lit(k >= 3)).select("statistic", chi_squared_tail(F.col("statistic"), k - 1).alias("p_value"), "n")


def wilcoxon(df: DataFrame, unit: str, models: list[str]) -> DataFrame:
    """Per pair of models: signed-rank statistic of their scores' differences over units (equal ones left out), p_value by the normal limit, corrected
    for ties, n, and better: the model that varies less, where p is under 0.05. Ranks are summed range by range (``ranges``).
    """
    rows = written(df.select(unit, *(F.col(m).cast("double").alias(m) for m in models)))
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    diffs = rows.select(F.explode(F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.round(F.col(a) - F.col(b), 12).alias("d")) for a, b in pairs))).alias("p")).select("p.*").filter("d IS NOT NULL AND d <> 0")
    diffs = written(diffs.groupBy("model_a", "model_b", F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up")))
    ranks = counted_ranks(diffs, "size", "c", ["model_a", "model_b"])
    g = ranks.groupBy("model_a", "model_b").agg(F.sum(F.col("_rank") * F.col("up")).alias("w"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    n = F.col("n")
    statistic = F.least(F.col("w"), n * (n + 1) / 2 - F.col("w"))
    z = (statistic - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    out = g.select("model_a", "model_b", statistic.alias("statistic"), normal_tails(z).alias("p_value"), "n")
    sd = rows.agg(*(F.stddev_pop(m).alias(f"_{m}") for m in models))
    a, b = (F.create_map(*(v for m in models for v in (F.lit(m), F.col(f"_{m}"))))[F.col(c)] for c in ("model_a", "model_b"))
    return out.crossJoin(F.broadcast(sd)).select(*out.columns, F.when(F.col("p_value") < 0.05, F.when(a < b, F.col("model_a")).otherwise(F.col("model_b"))).alias("better"))  # one row


def counted_ranks(df: DataFrame, x: str, count: str, within: list[str]) -> DataFrame:
    """Rows of distinct (within, x) that stand for ``count`` values each, with _rank, their mean rank."""
    return running_sums(df, x, {count: "_upto"}, within).withColumn("_rank", F.col("_upto") - (F.col(count) - 1) / 2.0)


def model_stability(df: DataFrame, models: list[str]) -> DataFrame:
    """Per model: mean and deviation of its scores over units, their ratio cv (null for a mean of 0), a verdict."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("s")) for m in models))).alias("p")).select("p.*")
    g = rows.groupBy("model").agg(F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("std_score"))
    g = g.withColumn("cv", F.when(F.col("mean_score") > 0, F.col("std_score") / F.col("mean_score")))
    verdict = F.lit("INESTABLE")
    for limit, name in reversed(STABILITY):
        verdict = F.when(F.col("cv") < limit, name).otherwise(verdict)
    return g.withColumn("verdict", verdict)
