"""Conformal p-values by Mahalanobis distances, month after month, each month judged by all months before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.operators.learned import standardised
from aforo.operators.ranges import running_sums, written

# Months before the first that is judged, rows before it, features at least; levels and their marks.
LEAST_MONTHS, LEAST_ROWS, LEAST_FEATURES = 6, 20, 5
LEVELS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))


def moment_sums(df: DataFrame, t: str, features: list[str]) -> DataFrame:
    """Per t and pair of features (0 stands for the constant 1): sums of x y, x² y, x² y².

    Each batch sums its own rows; what is shuffled is a row a task, month and pair.
    """
    names = [*((i, j) for i in range(len(features) + 1) for j in range(len(features) + 1))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for month, g in b.groupby(t):
                x = np.column_stack([np.ones(len(g)), g[features].to_numpy(float)])
                sums = [(a.T @ c).ravel() for a, c in ((x, x), (x**2, x), (x**2, x**2))]
                yield pd.DataFrame({t: [month] * len(names), "i": [i for i, _ in names], "j": [j for _, j in names], "s11": sums[0], "s21": sums[1], "s22": sums[2]})

    kind = dict(df.dtypes)[t]
    parts = df.select(t, *features).mapInPandas(run, f"{t} {kind}, i int, j int, s11 double, s21 double, s22 double")
    return parts.groupBy(t, "i", "j").agg(*(F.sum(c).alias(c) for c in ("s11", "s21", "s22")))


def ledoit_wolf(s11: np.ndarray, s21: np.ndarray, s22: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, inverse covariance of the standardised features after shrinking towards a multiple of the identity, and the shrinkage.

    From the moment sums alone: fourth moments of the standardised features follow from those of the raw ones.
    """
    n, one, two = s11[0, 0], s11[0, 1:], s21[1:, 0]
    mean = one / n
    p = len(mean)
    cov = s11[1:, 1:] / n - np.outer(mean, mean)
    var = np.where(np.diag(cov) > 1e-12, np.diag(cov), 0.0)
    scale = np.where(var > 0, np.sqrt(var), 1.0)
    cov = cov / np.outer(scale, scale)
    if n <= p + 1:
        return mean, scale, np.eye(p), 0.0
    m = mean[:, None]
    low = s21[1:, 1:] * mean[None, :]  # sums of x_i² x_j, times the mean of j
    fourth = s22[1:, 1:] - 2 * low - 2 * low.T + two[:, None] * mean[None, :] ** 2 + m**2 * two[None, :]
    fourth = fourth + 4 * np.outer(mean, mean) * s11[1:, 1:]
    fourth = fourth - 2 * (one * mean)[:, None] * mean[None, :] ** 2 - 2 * m**2 * (one * mean)[None, :] + n * np.outer(mean**2, mean**2)
    fourth = fourth / np.outer(scale**2, scale**2)
    mu, spread = np.trace(cov) / p, (cov**2).sum()
    delta = (spread - p * mu**2) / p
    beta = min(max((fourth.sum() / n - spread) / (p * n), 0.0), delta)
    shrink = beta / delta if beta > 0 else 0.0
    return mean, scale, np.linalg.pinv((1 - shrink) * cov + shrink * mu * np.eye(p), hermitian=True), shrink


def distances(x: np.ndarray, model: tuple) -> np.ndarray:
    """Mahalanobis distances, to nine decimals, so that equal rows have equal ones."""
    mean, scale, inverse = model[:3]
    z = (x - mean) / scale
    return np.round(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, inverse, z), 0.0)), 9)


def expanding_conformal(df: DataFrame, key: list[str], t: str, features: list[str], alpha: float = 0.05, least_months: int = LEAST_MONTHS) -> DataFrame:
    """Per row of ``key`` (with t in it): conformal_pvalue, conformal_anomaly, conformal_significance.

    A row's p is (rows of all months before it at least as far from their mean as it is + 1) / (their number + 1), in the metric of
    those rows' shrunk covariance; 1 in the first ``least_months`` months and where fewer than LEAST_ROWS rows stand before. Rows without t have 1.

    One aggregate gives moment sums per month; running sums over months give every month's mean and inverse (months times features squared on
    the driver), and no month is fitted on raw rows. Each row is measured once in the metric of every later month, which the definition asks
    for; equal distances are counted before they are shuffled, and summed range by range.
    """
    rows = written(standardised(df.select(*key, *features).withColumn("_all", F.lit(True)), features, "_all").drop("_all"))
    default = rows.select(*key)
    models: dict = {}
    if len(features) >= LEAST_FEATURES:
        d = len(features) + 1
        sums = moment_sums(rows.filter(F.col(t).isNotNull()), t, features).toPandas()  # months times pairs of features
        months = sorted(sums[t].unique())
        cube = np.zeros((3, len(months), d, d))
        at = np.array([months.index(m) for m in sums[t]], int)
        for k, c in enumerate(("s11", "s21", "s22")):
            cube[k, at, sums["i"], sums["j"]] = sums[c]
        before = np.cumsum(cube, axis=1)
        models = {months[k]: (*ledoit_wolf(*before[:, k - 1]), before[0, k - 1, 0, 0]) for k in range(least_months, len(months)) if before[0, k - 1, 0, 0] >= LEAST_ROWS}
    if not models:
        out = default.withColumn("p", F.lit(1.0))
    else:
        shared = df.sparkSession.sparkContext.broadcast(models)

        def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b[features].to_numpy(float)
                for month, model in shared.value.items():
                    past = (b[t] < month).to_numpy()
                    if past.any():
                        s, n = np.unique(distances(x[past], model), return_counts=True)
                        yield pd.DataFrame({"month": [month] * len(s), "s": s, "c": n})

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for month, g in b.groupby(t):
                    if month in shared.value:
                        yield g[key].assign(s=distances(g[features].to_numpy(float), shared.value[month]), n=shared.value[month][-1])

        kind = dict(df.dtypes)[t]
        dated = rows.filter(F.col(t).isNotNull())
        counts = dated.mapInPandas(later, f"month {kind}, s double, c long")
        tested = written(dated.mapInPandas(own, default.withColumns({"s": F.lit(0.0), "n": F.lit(0.0)}).schema))
        points = tested.select(F.col(t).alias("month"), "s", F.lit(0).cast("long").alias("c"))
        upto = running_sums(counts.unionByName(points).groupBy("month", "s").agg(F.sum("c").alias("c")), "s", {"c": "k"}, ("month",), descending=True)
        judged = tested.join(upto.withColumnRenamed("month", t).select(t, "s", "k"), [t, "s"]).select(*key, ((F.col("k") + 1) / (F.col("n") + 1)).alias("p"))
        first = F.coalesce(F.col("p"), F.lit(1.0)).alias("p")
        out = judged.unionByName(default.join(judged.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct(), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti").withColumn("p", F.lit(1.0))).select(*key, first)
    stars = F.lit("")
    for limit, mark in reversed(LEVELS):
        stars = F.when(F.col("p") < limit, mark).otherwise(stars)
    return out.select(*key, F.col("p").alias("conformal_pvalue"), (F.col("p") < alpha).alias("conformal_anomaly"), stars.alias("conformal_significance"))
