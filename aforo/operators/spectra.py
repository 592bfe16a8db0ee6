"""Spectra of contracts' hourly series and shapes of their days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.operators.learned import robust
from aforo.operators.ranges import written

# Hours of a series at least, bins to either side of a peak, days and overlap of a window, parts of the score, the share that is anomalous.
LEAST_HOURS, AROUND, DAYS, OVERLAP = 48, 2, 7, 0.5
PARTS, SHARE = (("spectral_entropy", 1, 0.5), ("diurnal_power_ratio", -1, 0.3), ("harmonic_12h_ratio", -1, 0.2)), 0.90


def power(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x - x.mean())) ** 2


def spectrum_figures(x: np.ndarray) -> tuple[float, float, float]:
    """Entropy of the power spectrum in bits, shares of the power around 24 and around 12 hours."""
    psd = power(x)
    total, freqs = psd.sum() + 1e-15, np.fft.rfftfreq(len(x))
    share = psd[psd > 0] / total
    around = []
    for hours in (24, 12):
        at = int(np.argmin(np.abs(freqs - 1 / hours)))
        around.append(psd[max(0, at - AROUND) : at + AROUND + 1].sum() / total)
    return float(-(share * np.log2(share + 1e-15)).sum()), float(around[0]), float(around[1])


def spectral_scores(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """Per contract: spectral_entropy, diurnal_power_ratio, harmonic_12h_ratio (rounded as reported), spectral_anomaly_score, is_anomaly_spectral.

    The score weighs how far entropy is above the mean and both ratios below it, in deviations up to 3; the highest tenth is anomalous.
    A series is one Arrow group (a contract's hours); shorter ones than LEAST_HOURS are left out.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < LEAST_HOURS:
            return pd.DataFrame({key: g[key].iloc[:0], **{n: pd.Series(dtype=float) for n, _, _ in PARTS}})
        a, b, c = spectrum_figures(g.sort_values(t)[x].to_numpy(float))
        return pd.DataFrame({key: [g[key].iloc[0]], "spectral_entropy": [round(a, 4)], "diurnal_power_ratio": [round(b, 6)], "harmonic_12h_ratio": [round(c, 6)]})

    kind = dict(df.dtypes)[key]
    rows = written(df.select(key, t, x).groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n, _, _ in PARTS)))
    stats = rows.agg(*(f(n).alias(f"_{k}_{n}") for n, _, _ in PARTS for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    score: Column = F.lit(0.0)
    for n, sign, weight in PARTS:
        z = sign * (F.col(n) - F.col(f"_m_{n}")) / (F.coalesce(F.col(f"_s_{n}"), F.lit(0.0)) + 1e-10)
        score = score + weight * F.least(F.greatest(z, F.lit(0.0)), F.lit(3.0)) / 3.0
    scored = rows.crossJoin(F.broadcast(stats)).select(*rows.columns, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("spectral_anomaly_score"))  # one row
    limit = scored.agg(F.percentile("spectral_anomaly_score", F.lit(SHARE)).alias("_q"))
    return scored.crossJoin(F.broadcast(limit)).withColumn("is_anomaly_spectral", F.col("spectral_anomaly_score") > F.col("_q")).drop("_q")  # one row


def spectrogram(df: DataFrame, key: str, t: str, x: str, days: int = DAYS, overlap: float = OVERLAP) -> DataFrame:
    """Per contract and window of ``days`` days: key, nth, starts, power (an array by frequency, 0 to half a cycle an hour)."""
    size = days * 24
    step = int(size * (1 - overlap))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(t)
        v, at = g[x].to_numpy(float), range(0, len(g) - size + 1, step)
        return pd.DataFrame({key: g[key].to_numpy()[: len(at)], "nth": np.arange(len(at)), "starts": g[t].to_numpy()[np.array(at, int)], "power": pd.Series([power(v[i : i + size]) for i in at], dtype=object)})

    kinds = dict(df.dtypes)
    return df.select(key, t, x).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, nth int, starts {kinds[t]}, power array<double>")


def day_shapes(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """key, date, h0 to h23: each hour's share of its day (0 for hours without a value), in one pass."""
    by_hour = [F.coalesce(F.sum(F.when(F.hour(t) == h, F.col(x))), F.lit(0.0)).alias(f"h{h}") for h in range(24)]
    days = df.groupBy(key, F.col(t).cast("date").alias("date")).agg(*by_hour)
    total = sum((F.col(f"h{h}") for h in range(24)), F.lit(1e-10))
    return days.select(key, "date", *((F.col(f"h{h}") / total).alias(f"h{h}") for h in range(24)))


def profile_errors(shapes: DataFrame, key: str, normal: str, k: int = 4, share: float = 0.90) -> DataFrame:
    """key, date, reconstruction_error, is_anomaly_ae_day: the mean squared error of rebuilding a day's shape from ``k`` principal
    components of the days where ``normal`` holds, and whether it is over their ``share`` quantile.

    Hours are scaled by median and interquartile range of the normal days. Errors are of deviations from the medians, as is the fit. A linear stand-in for an autoencoder, as in M13.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    hours = [f"h{h}" for h in range(24)]
    x = VectorAssembler(inputCols=hours, outputCol="_s").transform(robust(shapes, hours, normal))
    x = written(x.select(key, "date", normal, "_s"))
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(x.filter(normal))
    pc = model.pc.toArray()
    s, p = vector_to_array("_s"), vector_to_array("_p")
    x = model.transform(x).select(key, "date", normal, s.alias("s"), p.alias("p"))
    back = [sum((F.col("p")[j] * float(pc[i, j]) for j in range(k)), F.lit(0.0)) for i in range(24)]
    error = sum(((F.col("s")[i] - back[i]) * (F.col("s")[i] - back[i]) for i in range(24)), F.lit(0.0)) / 24
    x = written(x.select(key, "date", normal, error.alias("reconstruction_error")))
    limit = x.filter(normal).agg(F.percentile("reconstruction_error", F.lit(share)).alias("_q"))
    return x.crossJoin(F.broadcast(limit)).select(key, "date", "reconstruction_error", (F.col("reconstruction_error") > F.col("_q")).alias("is_anomaly_ae_day"))  # one row


def roll_up(days: DataFrame, key: str, error: str = "reconstruction_error", anomalous: str = "is_anomaly_ae_day") -> DataFrame:
    """Per contract: median and greatest error, anomalous days, days, their ratio, score (median over the greatest median), is_anomaly_ae (the score is over its 90th percentile)."""
    g = days.groupBy(key).agg(F.median(error).alias("ae_median_error"), F.max(error).alias("ae_max_error"), F.count_if(anomalous).alias("ae_anomaly_days"), F.count("*").alias("n_days"))
    g = g.withColumn("ae_anomaly_ratio", F.col("ae_anomaly_days") / F.col("n_days"))
    top = g.agg((F.max("ae_median_error") + 1e-10).alias("_top"))
    g = g.crossJoin(F.broadcast(top)).withColumn("ae_anomaly_score", F.least(F.greatest(F.col("ae_median_error") / F.col("_top"), F.lit(0.0)), F.lit(1.0))).drop("_top")  # one row
    limit = g.agg(F.percentile("ae_anomaly_score", F.lit(0.90)).alias("_q"))
    return g.crossJoin(F.broadcast(limit)).withColumn("is_anomaly_ae", F.col("ae_anomaly_score") > F.col("_q")).drop("_q")  # one row


def mean_shapes(shapes: DataFrame, key: str) -> DataFrame:
    """Per contract the mean of its days' shapes, made to sum to 1."""
    hours = [f"h{h}" for h in range(24)]
    g = shapes.groupBy(key).agg(*(F.avg(h).alias(h) for h in hours))
    total = sum((F.col(h) for h in hours), F.lit(1e-10))
    return g.select(key, *((F.col(h) / total).alias(h) for h in hours))


def clusters(shapes: DataFrame, key: str, most: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Contracts by shape: (key, cluster_id, x, y: the first two principal components), and (cluster_id, n, centre, by size).

    Of 2 to ``most`` clusters the number with the best silhouette is taken (k-means, seeded); numbers are given by size. Fewer than three contracts are one cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = written(VectorAssembler(inputCols=[f"h{h}" for h in range(24)], outputCol="features").transform(shapes).select(key, "features"))
    n = x.count()
    if n < 3:
        alone = x.select(key, F.lit(0).alias("cluster_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return alone, x.agg(F.count("*").alias("n"), F.avg(vector_to_array("features")[0]).alias("_")).filter("n > 0").select(F.lit(0).alias("cluster_id"), "n", F.array().cast("array<double>").alias("centre"))
    tried = []
    for k in range(2, min(most, n - 1) + 1):
        model = KMeans(k=k, seed=seed, initSteps=5, maxIter=50).fit(x)
        made = model.transform(x)
        parts = made.select("prediction").distinct().count()
        tried.append((ClusteringEvaluator().evaluate(made) if parts > 1 else -1.0, -k, model))
    model = max(tried, key=lambda v: v[:2])[2]
    out = PCA(k=2, inputCol="features", outputCol="_p").fit(x).transform(model.transform(x))
    sizes = sorted(((r["count"], -r["prediction"]) for r in out.groupBy("prediction").count().collect()), reverse=True)  # a row a cluster
    rank = {-p: i for i, (_, p) in enumerate(sizes)}
    number = F.create_map(*(F.lit(v) for kv in rank.items() for v in kv))[F.col("prediction")]
    p = vector_to_array("_p")
    centres = [(rank[i], c, [float(v) for v in model.clusterCenters()[i]]) for c, i in ((c, -p_) for c, p_ in sizes)]
    return out.select(key, number.alias("cluster_id"), p[0].alias("x"), p[1].alias("y")), x.sparkSession.createDataFrame(centres, "cluster_id int, n long, centre array<double>")
