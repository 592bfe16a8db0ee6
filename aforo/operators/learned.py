"""Detectors that learn from months before and judge months after: cross-sectional and per-series forests, interval
forecasts, stacking with calibration, ablation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.detectors import fit_forest, forest_scores, isolation_forest
from aforo.operators.ranges import written

# Contamination of the two forests; penalty by how many times the median variation a barrio varies.
CROSS_SECTIONAL, PER_SERIES = 0.05, 0.10
PENALTIES = ((3.0, 0.05), (2.0, 0.02))


def standardised(df: DataFrame, features: list[str], train: str) -> DataFrame:
    """Features less their mean over their deviation (both of the training rows); not finite counts as 0."""
    clean = df.withColumns({f: F.when(F.isnan(f) | (F.abs(f) == float("inf")), 0.0).otherwise(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features})
    stats = clean.filter(train).agg(*(g(f).alias(f"{g.__name__}_{f}") for f in features for g in (F.avg, F.stddev_pop)))
    clean = clean.crossJoin(F.broadcast(stats))  # one row
    out = clean.withColumns({f: (F.col(f) - F.col(f"avg_{f}")) / F.when(F.col(f"stddev_pop_{f}") > 0, F.col(f"stddev_pop_{f}")).otherwise(1.0) for f in features})
    return out.drop(*stats.columns)


def robust(df: DataFrame, features: list[str], on: str) -> DataFrame:
    """Features less their median over their interquartile range, both of the rows where ``on`` holds (approximate percentiles, a sketch of
    bounded size); a range of 0 counts as 1, values that are not finite as 0.
    """
    clean = df.withColumns({f: F.when(F.isnan(F.col(f).cast("double")) | (F.abs(f) == float("inf")), 0.0).otherwise(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features})
    parts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    cuts = clean.filter(on).agg(*(F.percentile_approx(f, parts, F.lit(10_000)).alias(f"_q{i}") for i, f in enumerate(features)))
    clean = clean.crossJoin(F.broadcast(cuts))  # one row
    width = lambda i: F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]
    return clean.withColumns({f: (F.col(f) - F.col(f"_q{i}")[1]) / F.when(width(i) > 0, width(i)).otherwise(1.0) for i, f in enumerate(features)}).drop(*cuts.columns)


def informative(df: DataFrame, features: list[str], target: str, most: int, bins: int = 10) -> list[str]:
    """The ``most`` features that say most about the target, in their given order; all if there are no more.

    Mutual information of both in ``bins`` parts of about equal count (approximate percentiles), nulls in a part of their own: one
    count by feature and parts, summed up where rows are read.
    """
    if len(features) <= most:
        return list(features)
    cols = list(dict.fromkeys([*features, target]))
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    cuts = df.agg(*(F.array_distinct(F.percentile_approx(c, shares, F.lit(10_000))).alias(f"_c{i}") for i, c in enumerate(cols)))
    part = lambda i, c: F.when(F.col(c).isNull(), -1).otherwise(F.size(F.filter(f"_c{i}", lambda x: x < F.col(c))))
    at = df.select(*cols).crossJoin(F.broadcast(cuts)).select(*(part(i, c).alias(f"_p{i}") for i, c in enumerate(cols)))  # one row
    y = F.col(f"_p{cols.index(target)}").alias("y")
    pairs = at.select(y, F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"_p{i}").alias("x")) for i in range(len(features))))).alias("v"))
    counts = pairs.groupBy("v.f", "v.x", "y").count()
    own, other, all_ = Window.partitionBy("f", "x"), Window.partitionBy("f", "y"), Window.partitionBy("f")  # bins squared rows a feature
    n = F.sum("count").over(all_)
    share = F.col("count") / n * F.log(F.col("count") * n / (F.sum("count").over(own) * F.sum("count").over(other)))
    told = counts.withColumn("s", share).groupBy("f").agg(F.round(F.sum("s"), 9).alias("mi")).orderBy(F.desc("mi"), "f").limit(most)
    return [features[i] for i in sorted(r["f"] for r in told.collect())]  # a row a feature


def cross_sectional_forest(df: DataFrame, key: list[str], features: list[str], x: str, series: str, contamination: float = CROSS_SECTIONAL) -> DataFrame:
    """Isolation forest over all series: fitted on the training rows (column train), judges the others.

    A row is anomalous if its score is under the training rows' share ``contamination``; of series that vary more than the
    median the score is raised first (PENALTIES). Columns of ``key``, score_m2, is_anomaly_m2.
    """
    rows = written(standardised(df.withColumn("_x", F.col(x)), features, "train"))
    scored = written(isolation_forest(rows, [*key, "train"], features, fitted_on="train"))
    offset = scored.filter("train").agg(F.percentile("score", F.lit(contamination)).alias("offset"))
    vary = rows.filter("train").groupBy(series).agg(F.when(F.avg("_x") > 0, F.stddev_samp("_x") / F.avg("_x")).otherwise(0.0).alias("cv"))
    median = vary.agg(F.median("cv").alias("median_cv"))
    out = scored.filter("NOT train").join(vary, series, "left")  # ``series`` is one of the key's columns
    out = out.crossJoin(F.broadcast(offset)).crossJoin(F.broadcast(median))  # one row each
    return out.select(*key, F.col("score").alias("score_m2"), penalised(F.col("score"), F.col("offset"), F.coalesce("cv", "median_cv"), F.col("median_cv")).alias("is_anomaly_m2"))


# The latent part's weight in the score, share of the training rows that are anomalous.
LATENT_WEIGHT, PPCA_SHARE = 2.0, 0.05


def ppca_figures(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, values: np.ndarray, noise: float) -> tuple[np.ndarray, ...]:
    """Under a probabilistic principal component model: mean squared error of rebuilding, divergence of the latent posterior from its
    prior, log-likelihood, distance of the latent mean from 0. axes: features by components; values: their variances; noise: that of each other direction.
    """
    c = x - mean
    z = c @ axes
    rest = np.maximum((c**2).sum(1) - (z**2).sum(1), 0.0)
    d, k = axes.shape
    left = np.maximum(values - noise, 0.0)
    latent = z * (np.sqrt(left) / values)
    spread = noise / values
    divergence = 0.5 * (latent**2).sum(1) + 0.5 * (spread - 1 - np.log(spread)).sum()
    likelihood = -0.5 * (d * np.log(2 * np.pi) + np.log(values).sum() + (d - k) * np.log(noise) + (z**2 / values).sum(1) + rest / noise)
    error = (rest + ((z * (noise / values)) ** 2).sum(1)) / d
    return error, divergence, likelihood, np.sqrt((latent**2).sum(1))


def probabilistic_pca(df: DataFrame, key: list[str], features: list[str], k: int, share: float = PPCA_SHARE, beta: float = LATENT_WEIGHT) -> DataFrame:
    """Per row after training: key, vae_score (error + beta times divergence), vae_log_likelihood, vae_latent_distance, is_anomaly_vae (the
    score is over the training rows' 1 - ``share`` quantile).

    The closed form of a linear variational autoencoder: principal components of the training rows (column train), scaled by median and
    interquartile range, the mean of the other variances as noise. Scoring is Arrow-batched over the few numbers of the model.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    x = VectorAssembler(inputCols=features, outputCol="_s").transform(robust(df.select(*key, "train", *features), features, "train"))
    x = written(x.select(*key, "train", "_s"))
    train = x.filter("train")
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(train)
    got = train.select(Summarizer.metrics("mean", "variance").summary(F.col("_s")).alias("m")).select("m.mean", "m.variance").first()
    total = float(np.sum(got["variance"].toArray()))
    values = np.maximum(model.explainedVariance.toArray() * total, 1e-12)
    noise = max((total - values.sum()) / max(len(features) - k, 1), 1e-12)
    mean, axes = got["mean"].toArray(), model.pc.toArray()
    plain = x.select(*key, "train", vector_to_array("_s").alias("_a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                error, divergence, likelihood, distance = ppca_figures(np.stack(b["_a"].to_list()).astype(float), mean, axes, values, noise)
                yield b[[*key, "train"]].assign(vae_score=error + beta * divergence, vae_log_likelihood=likelihood, vae_latent_distance=distance)

    scored = written(plain.mapInPandas(run, plain.drop("_a").withColumns({c: F.lit(0.0) for c in ("vae_score", "vae_log_likelihood", "vae_latent_distance")}).schema))
    limit = scored.filter("train").agg(F.percentile("vae_score", F.lit(1 - share)).alias("_q"))
    return scored.filter("NOT train").crossJoin(F.broadcast(limit)).withColumn("is_anomaly_vae", F.col("vae_score") > F.col("_q")).drop("_q", "train")  # one row


def penalised(score: Column, offset: Column, cv: Column, median: Column) -> Column:
    """Whether a score is under the offset, after what is added for a series that varies much."""
    raised = F.lit(0.0)
    for limit, by in reversed(PENALTIES):
        raised = F.when((median > 0) & (cv / median > limit), by).otherwise(raised)
    return score + raised < offset


def series_forests(df: DataFrame, key: str, t: str, features: list[str], contamination: float = PER_SERIES, least: int = 10, seed: int = 42) -> DataFrame:
    """An isolation forest for each series: key, t, score, is_anomaly (the share ``contamination`` with the lowest scores).

    Series of fewer than ``least`` rows are left out. A series is a monthly history, one Arrow group.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = g[[key, t]]
        if len(g) < least:
            return out.iloc[:0].assign(score=0.0, is_anomaly=False)
        g = g.sort_values(t)
        x = np.nan_to_num(g[features].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
        spread = x.std(0)
        x = (x - x.mean(0)) / np.where(spread > 0, spread, 1.0)
        forest, norm = fit_forest(x, 100, 256, seed)
        score = forest_scores(forest, norm, x)
        return g[[key, t]].assign(score=score, is_anomaly=score < np.percentile(score, 100 * contamination))

    schema = df.select(key, t).withColumns({"score": F.lit(0.0), "is_anomaly": F.lit(False)}).schema
    return df.select(key, t, *features).groupBy(key).applyInPandas(run, schema)


_WAVES = 2


def _terms(i: Column, month: Column) -> list[Column]:
    """Constant, trend, yearly waves."""
    angle = month * (2 * 3.141592653589793 / 12)
    return [F.lit(1.0), i / 12, *(g(angle * k) for k in range(1, _WAVES + 1) for g in (F.sin, F.cos))]


def interval_forecast(df: DataFrame, key: str, t: str, x: str, width: float = 0.95, ridge: float = 0.1, least: int = 12) -> DataFrame:
    """Trend and yearly waves fitted to each series' training months (ridge on all but the constant), an interval from the
    quantiles of the training residuals, and for later months: forecast, bounds, is_anomaly (outside), residual over width.

    An approximation by name of decomposable forecasts. Spark sums the normal equations; 6 unknowns are solved a series.
    """
    names = [f"_f{i}" for i in range(2 + 2 * _WAVES)]
    i = (F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1).cast("double")
    rows = df.select(key, t, F.col(x).alias("_y"), "train").withColumn("_i", i)
    rows = written(rows.withColumns(dict(zip(names, _terms(F.col("_i"), F.month(t))))))
    fit = rows.filter("train")
    grams = fit.groupBy(key).agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).alias("g"),
        F.array(*(F.sum(F.col(a) * F.col("_y")) for a in names)).alias("b"),
    ).filter(F.col("n") >= least)
    k = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        penalty = np.diag([0.0] + [ridge] * (k - 1))
        for b in batches:
            w = [np.linalg.solve(np.array(g, float).reshape(k, k) + penalty, np.array(v, float)).tolist() for g, v in zip(b["g"], b["b"])]
            yield b[[key]].assign(w=pd.Series(w, index=b.index, dtype=object))

    weights = grams.mapInPandas(solve, f"{key} string, w array<double>")
    fitted = reduce(lambda a, b: a + b, (F.col("w")[j] * F.col(n) for j, n in enumerate(names)))
    rows = rows.join(weights, key).withColumn("forecast", fitted)
    tail = (1 - width) / 2
    bounds = rows.filter("train").groupBy(key).agg(F.percentile(F.col("_y") - F.col("forecast"), F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    out = rows.filter("NOT train").join(bounds, key).withColumns({"low": F.col("forecast") + F.col("q")[0], "high": F.col("forecast") + F.col("q")[1]})
    size = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return out.select(key, t, "forecast", "low", "high", ((F.col("_y") < F.col("low")) | (F.col("_y") > F.col("high"))).alias("is_anomaly"), ((F.col("_y") - F.col("forecast")) / size).alias("residual"))


#: Trees, depth, step, share of rows a tree sees, least rows of a leaf.
STACKING = {"maxIter": 50, "maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 5}


def stacking(df: DataFrame, key: list[str], features: list[str], y: str, t: str = "fecha", least_months: int = 6, step: int = 12, seed: int = 42, trees: dict = STACKING) -> DataFrame:
    """Boosted trees on detectors' flags and scores, walked forward: rows of ``step`` months are scored by a model of all months
    before them, in which positive rows weigh as much as negative ones. An isotonic function fitted on the first 60 per cent of the scored months
    calibrates the others (those it was fitted on keep their scores); the threshold (0.10 to 0.90) with the best F1 on these others
    decides. Columns of ``key``, stacking_score, stacking_score_calibrated, stacking_anomaly.

    Refitting every ``step`` months instead of each month keeps the number of models small.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    nth = F.row_number().over(Window.orderBy(t)) - 1
    months = df.select(t).distinct().withColumn("_m", nth)  # a row a month
    n_months = months.count()
    rows = written(df.select(*key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features), F.col(y).cast("double").alias("_y")).join(F.broadcast(months), t))
    x = VectorAssembler(inputCols=features, outputCol="_v").transform(rows)
    gbt = GBTClassifier(featuresCol="_v", labelCol="_y", weightCol="_weight", seed=seed, **trees)
    scored = None
    for first in range(least_months, n_months, step):
        past, now = x.filter(F.col("_m") < first), x.filter((F.col("_m") >= first) & (F.col("_m") < first + step))
        n, positive = past.agg(F.count("*"), F.sum("_y")).first()
        if not n or positive in (None, 0, n):
            continue
        one = gbt.fit(past.withColumn("_weight", F.when(F.col("_y") > 0, (n - positive) / positive).otherwise(1.0))).transform(now).select(*key, "_m", "_y", vector_to_array("probability")[1].alias("stacking_score"))
        scored = one if scored is None else scored.unionByName(one)
    if scored is None:
        return rows.limit(0).select(*key, F.lit(0.0).alias("stacking_score"), F.lit(0.0).alias("stacking_score_calibrated"), F.lit(False).alias("stacking_anomaly"))
    scored = written(scored)
    early = scored.select("_m").distinct().agg(F.percentile("_m", F.lit(0.6)).alias("p")).first()["p"]
    iso = IsotonicRegression(featuresCol="stacking_score", labelCol="_y", predictionCol="stacking_score_calibrated").fit(scored.filter(F.col("_m") <= early))
    calibrated = iso.transform(scored)
    scored = written(calibrated.withColumn("stacking_score_calibrated", F.when(F.col("_m") <= early, F.col("stacking_score")).otherwise(F.col("stacking_score_calibrated"))))
    return scored.crossJoin(F.broadcast(best_threshold(scored.filter(F.col("_m") > early), "stacking_score_calibrated", "_y"))).select(
        *key, "stacking_score", "stacking_score_calibrated", (F.col("stacking_score_calibrated") >= F.col("threshold")).alias("stacking_anomaly")
    )


def best_threshold(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row: of 0.10, 0.15, ... 0.90 the threshold with the best F1 (ties: the least); 0.5 without rows."""
    grid = F.array(*(F.lit(round(0.10 + 0.05 * i, 2)) for i in range(17)))
    at = df.select(F.col(score).alias("s"), (F.col(y) > 0.5).alias("y"), F.explode(grid).alias("threshold")).groupBy("threshold")
    at = at.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("tp", "s >= threshold AND y"), ("fp", "s >= threshold AND NOT y"), ("fn", "s < threshold AND y"))))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return at.agg(F.coalesce(F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t")))["t"] * -1, F.lit(0.5)).alias("threshold"))


def _weighted_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last the intercept) of a balanced, ridge-penalised logistic regression on counted rows."""
    mean = (x * n[:, None]).sum(0) / n.sum()
    scale = np.sqrt(((x - mean) ** 2 * n[:, None]).sum(0) / n.sum())
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = n * np.where(y == 1, n.sum() / (2 * n[y == 1].sum()), n.sum() / (2 * n[y == 0].sum()))
    w, penalty = np.zeros(z.shape[1]), np.diag([1 / c] * (z.shape[1] - 1) + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + penalty + 1e-12 * np.eye(len(w)), z.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return mean, scale, w


def walk_forward_precision(counts: pd.DataFrame, flags: list[str], least_months: int = 6) -> float:
    """Average precision of logistic models, each of the months before the one it scores. counts: month, flags, y, n."""
    months, parts = np.sort(counts["month"].unique()), []
    for m in months[least_months:]:
        past, now = counts[counts["month"] < m], counts[counts["month"] == m]
        if past["y"].nunique() < 2:
            continue
        mean, scale, w = _weighted_logistic(past[flags].to_numpy(float), past["y"].to_numpy(float), past["n"].to_numpy(float))
        z = (now[flags].to_numpy(float) - mean) / scale @ w[:-1] + w[-1]
        parts.append(now[["y", "n"]].assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))).round(12)))
    if not parts or sum(p["n"].sum() for p in parts) < 20:
        return float("nan")
    all_ = pd.concat(parts)
    g = all_.assign(hit=all_["y"] * all_["n"]).groupby("score")[["hit", "n"]].sum().sort_index(ascending=False)
    return float((g["hit"] * g["hit"].cumsum() / g["n"].cumsum()).sum() / g["hit"].sum()) if g["hit"].sum() else float("nan")


#: Verdicts by what is lost without a detector.
VERDICTS = ((0.03, "ESSENTIAL"), (0.01, "USEFUL"), (0.005, "MARGINAL"))


def ablation(df: DataFrame, flags: list[str], y: str, t: str = "fecha") -> DataFrame:
    """For each flag: average precision with all, without it, the difference, a verdict.

    Logistic models see flags only, so that rows with the same month, flags and label are one counted row: Spark counts them,
    and what comes to the driver is bounded by months times patterns of flags, whatever the number of rows.
    """
    flat = df.select(F.col(t).alias("month"), *(F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in flags), F.col(y).cast("int").alias("y"))
    counts = flat.groupBy("month", *flags, "y").agg(F.count("*").alias("n")).toPandas()
    full, rows = walk_forward_precision(counts, flags), []
    for flag in flags:
        without = walk_forward_precision(counts, [f for f in flags if f != flag])
        delta = full - without
        verdict = "N/A" if np.isnan(delta) else next((name for limit, name in VERDICTS if delta >= limit), "REDUNDANT")
        rows.append((flag.removeprefix("is_anomaly_"), full, without, delta, verdict))
    return df.sparkSession.createDataFrame(rows, "model string, auc_full double, auc_without double, delta double, verdict string")
