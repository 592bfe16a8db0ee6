"""Reports over results: counts, impact, overlaps, order rules, peaks, sinks, a learned meta-score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ranges import written


def consensus_counts(df: DataFrame, most: int) -> DataFrame:
    """How many rows have at least 1, 2, ... detectors."""
    counts = df.agg(*(F.count_if(F.col("n_models_detecting") >= k).alias(f"k{k}") for k in range(1, most + 1)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("at_least"), F.col(f"k{k}").alias("n")) for k in range(1, most + 1)))))


def economic_impact(df: DataFrame, x: str = "consumo", tariff: float = 1.5, inspection: float = 200.0) -> DataFrame:
    """One row: barrios with an alert (1 model or more in a month) and with a sure one (3), the use of months where 2 models
    fire, the excess in it (15 per cent), what that is worth, the cost of inspections and the return. ``x`` in litres.
    """
    per = df.groupBy("barrio_key").agg(F.max("n_models_detecting").alias("most"), F.sum(F.when(F.col("n_models_detecting") >= 2, F.col(x))).alias("anomalous"))
    out = per.agg(
        F.count("*").alias("total_barrios"),
        F.count_if(F.col("most") >= 1).alias("barrios_alerta"),
        F.count_if(F.col("most") >= 3).alias("barrios_alta_confianza"),
        (F.coalesce(F.sum("anomalous"), F.lit(0.0)) / 1000).alias("consumo_anomalo_m3"),
    )
    out = out.withColumn("exceso_estimado_m3", F.col("consumo_anomalo_m3") * 0.15)
    out = out.withColumns({"ahorro_eur": F.col("exceso_estimado_m3") * tariff, "coste_inspecciones": F.col("barrios_alta_confianza") * inspection})
    return out.withColumn("roi", F.when(F.col("coste_inspecciones") > 0, F.col("ahorro_eur") / F.col("coste_inspecciones")).otherwise(0.0))


def fraud_rate(df: DataFrame, at: str, motive: str, weights: dict[str, float]) -> DataFrame:
    """Per month: suspicious changes (motives with a weight), all changes, their rate, its mean over 3 months, sum of weights.

    The window holds a row a month.
    """
    weight = F.lit(0.0)
    for name, worth in weights.items():
        weight = F.when(F.col(motive) == name, worth).otherwise(weight)
    out = df.groupBy(F.trunc(F.col(at).cast("date"), "month").alias("mes")).agg(
        F.count_if(F.col(motive).isin(*weights)).alias("n_fraud"), F.count("*").alias("n_total_changes"), F.sum(weight).alias("fraud_weighted")
    )
    out = out.withColumn("fraud_rate", F.col("n_fraud") / F.col("n_total_changes"))
    return out.withColumn("fraud_rate_3m", F.avg("fraud_rate").over(Window.orderBy("mes").rowsBetween(-2, 0)))


def vote_evaluation(df: DataFrame, first: str, second: str, y: str) -> DataFrame:
    """Hits, precision, recall and F1 of two models together, in the modes ``or`` and ``and``."""
    a, b, t = (F.coalesce(F.col(c), F.lit(False)) for c in (first, second, y))
    modes = F.array(F.struct(F.lit("or").alias("mode"), (a | b).alias("on")), F.struct(F.lit("and").alias("mode"), (a & b).alias("on")))
    rows = df.select(t.alias("t"), F.inline(modes)).groupBy("mode")
    rows = rows.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("tp", "on AND t"), ("fp", "on AND NOT t"), ("fn", "NOT on AND t"))))
    ratio = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mean_score(flags: list[Column], extra: list[Column]) -> Column:
    """Mean of the flags that ran and the extra terms that are there."""
    parts = F.filter(F.array(*(f.cast("double") for f in flags), *extra), lambda v: v.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts)).otherwise(0.0)


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """Jaccard similarity of the k highest keys by each of two measures (a top-k report)."""
    one = df.orderBy(F.desc(a), key).limit(k).select(key).withColumn("a", F.lit(1))
    two = df.orderBy(F.desc(b), key).limit(k).select(key).withColumn("b", F.lit(1))
    both = one.join(two, key, "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), (F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("jaccard"))


def thin_peaks(df: DataFrame, key: str, t: str, x: str, least: float, gap: int) -> DataFrame:
    """Peaks over ``least``, highest first, none within ``gap`` rows of one kept; one ordered array per series."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(t))
    high = df.withColumn("i", i).filter(F.col(x) > least).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(x)).alias("o"), "i"))).alias("p"))
    kept = F.expr(f"aggregate(p, cast(array() as array<int>), (a, v) -> IF(exists(a, j -> abs(j - v.i) < {gap}), a, array_append(a, v.i)))")
    return high.select(key, F.explode(kept).alias("i"))


def bucket_sample(df: DataFrame, key: Column, share: float, seed: str = "42") -> DataFrame:
    """A sample (a sampling operator by intent) that any engine with md5 repeats: by the hash of seed and key."""
    return df.filter(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), key.cast("string"))), 1, 6), 16, 10).cast("long") < int(share * (1 << 24)))


def write_results(df: DataFrame, path: str) -> DataFrame:
    """Results as CSV, arrays joined by semicolons; read back with the same column names."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    flat = df.select(*(F.concat_ws(";", c).alias(c) if c in arrays else F.col(c) for c in df.columns))
    flat.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(flat.schema).option("header", True).csv(path)


# The meta model's trees; weights by how many detectors fired; the fallback's weights by detector, that of any other.
META = {"maxIter": 150, "maxDepth": 4, "stepSize": 0.08, "subsamplingRate": 0.8}
CONFIDENCE = ((3, 2.0), (2, 1.0), (1, 0.5), (0, 0.3))
MODEL_WEIGHTS = {"m2": 0.15, "3sigma": 0.10, "iqr": 0.10, "chronos": 0.15, "prophet": 0.15, "anr": 0.20, "nmf": 0.15, "readings": 0.05, "autoencoder": 0.15}
OTHER_MODEL, VULNERABILITY, FEWEST_POSITIVES = 0.1, 0.3, 10


def heuristic_score(flags: dict[str, Column], vulnerability: Column | None = None) -> Column:
    """Weighted share of the detectors that fired (null: not), raised by vulnerability (null: 0.5), from 0 to 1. flags: by detector."""
    weights = {d: MODEL_WEIGHTS.get(d, OTHER_MODEL) for d in flags}
    score = F.lit(0.0)
    for d, flag in flags.items():
        score = score + F.coalesce(flag.cast("double"), F.lit(0.0)) * (weights[d] / sum(weights.values()))
    if vulnerability is not None:
        score = score * (1 + VULNERABILITY * F.coalesce(vulnerability, F.lit(0.5)))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def meta_score(df: DataFrame, key: list[str], features: list[str], flags: dict[str, str], fired: str, folds: int = 5, seed: int = 42, trees: dict = META, vulnerability: str | None = None) -> DataFrame:
    """Columns of ``key`` and fraud_score: the out-of-fold probability of boosted trees that two detectors or more fire.

    Rows weigh by how many fired (CONFIDENCE), and positive ones as much as all others together. Folds are stratified: rows of each class are dealt out
    by the hash of their key. With fewer than FEWEST_POSITIVES positive rows, or more than half, the heuristic score stands in. The folds'
    models are fitted side by side; ``key`` identifies a row. flags: column by detector; fired: how many fired.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("_y", (F.col(fired) >= 2).cast("double"))
    n, positive = rows.agg(F.count("*"), F.sum("_y")).first()
    if not n or positive < FEWEST_POSITIVES or positive > n * 0.5:
        return df.select(*key, heuristic_score({d: F.col(c) for d, c in flags.items()}, F.col(vulnerability) if vulnerability else None).alias("fraud_score"))
    weight = F.lit(1.0)
    for least, w in reversed(CONFIDENCE):
        weight = F.when(F.col(fired) >= least, w).otherwise(weight)
    clean = rows.select(*key, "_y", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate([*features, *flags.values()])), (weight * F.when(F.col("_y") > 0, (n - positive) / positive).otherwise(1.0)).alias("_w"))
    clean = written(clean.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds))))
    x = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features) + len(flags))], outputCol="_v").transform(clean)

    def one(fold: int) -> DataFrame:
        model = GBTClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", seed=seed, **trees).fit(x.filter(F.col("_fold") != fold))
        return model.transform(x.filter(F.col("_fold") == fold)).select(*key, vector_to_array("probability")[1].alias("fraud_score"))

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(one, range(folds)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
