"""Checks of results against outside measures, nearest rows, names and messages, a factor model of households."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ensemble import average_rank
from aforo.operators.ranges import written

# Short forms of words in names.
SHORT = {"SAN": "S.", "SANTA": "STA.", "POLIGONO": "POL.", "PLAYA": "PL.", "VIRGEN": "V."}


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: correlation of the ranks of x and y, and of what is left of them after a line through 0 on the ranks of z.

    For frames of a row a barrio or month; ties share their mean rank.
    """
    r = df.select(*(average_rank(c).alias(f"r{i}") for i, c in enumerate((x, y, z))))
    slopes = r.agg(*((F.sum(F.col(f"r{i}") * F.col("r2")) / F.sum(F.col("r2") * F.col("r2"))).alias(f"b{i}") for i in (0, 1)))
    rest = r.crossJoin(F.broadcast(slopes))  # one row
    return rest.agg(F.corr("r0", "r1").alias("rho"), F.corr(F.col("r0") - F.col("b0") * F.col("r2"), F.col("r1") - F.col("b1") * F.col("r2")).alias("partial_rho"), F.count("*").alias("n"))


def hit_rate(df: DataFrame, key: str, x: str, y: str, k: int = 10) -> DataFrame:
    """One row: share of the k highest keys by x that are among the k highest by y (a top-k report; ties by key)."""
    top = lambda c: df.orderBy(F.desc(c), key).limit(k).select(key)
    both = top(x).join(top(y), key)
    return both.agg(F.count("*").alias("hits")).crossJoin(top(x).agg(F.count("*").alias("k"))).withColumn("hit_rate", F.col("hits") / F.col("k"))  # one row each


def moran_permutation(values: DataFrame, edges: DataFrame, rounds: int = 99, seed: str = "moran") -> DataFrame:
    """Moran's I of (id, x) over edges (src, dst) and its p-value over permutations of x, each in the order of md5(seed-round-id).

    values: a row an area; the work is ``rounds`` times the edges.
    """
    w = Window.partitionBy()
    z = values.withColumn("z", F.col("x") - F.avg("x").over(w)).select("id", "z")
    r = z.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    i = F.row_number().over(Window.partitionBy("round").orderBy("id"))
    mixed = F.when(F.col("round") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("-", F.lit(seed), F.col("round").cast("string"), F.col("id").cast("string"))))
    j = F.row_number().over(Window.partitionBy("round").orderBy(mixed, "id"))
    r = r.withColumns({"i": i, "j": j})
    r = written(r.select("round", "id", "i").join(r.select("round", F.col("j").alias("i"), "z"), ["round", "i"]).select("round", "id", "z"))
    total = z.agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    a, b = r.select("round", F.col("id").alias("src"), F.col("z").alias("za")), r.select("round", F.col("id").alias("dst"), F.col("z").alias("zb"))
    each = edges.join(a, "src").join(b, ["round", "dst"]).groupBy("round").agg(F.sum(F.col("za") * F.col("zb")).alias("s"), F.count("*").alias("m"))
    each = each.crossJoin(F.broadcast(total)).withColumn("moran", F.round(F.col("n") / F.col("m") * F.col("s") / F.col("zz"), 12))  # one row
    real = each.filter("round = 0").select(F.col("moran").alias("moran_i"))
    return each.filter("round > 0").crossJoin(F.broadcast(real)).agg(F.max("moran_i").alias("moran_i"), ((F.count_if(F.abs("moran") >= F.abs("moran_i")) + 1) / (F.count("*") + 1)).alias("p_value"))


def nearest_normal(anomalies: DataFrame, normals: DataFrame, key: str, features: list[str], most: int = 10) -> DataFrame:
    """For each anomaly (a stated query set, at most ``most`` rows by key) the nearest normal row: features are scaled by the
    normal rows' mean and deviation; ties go to the least key. All normal rows are compared.
    """
    stats = normals.agg(*(g(f).alias(f"{g.__name__}_{f}") for f in features for g in (F.avg, F.stddev_pop)))
    asked = anomalies.orderBy(key).limit(most).select(F.col(key).alias("anomaly"), *(F.col(f).alias(f"q_{f}") for f in features))
    pairs = normals.crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(stats))  # at most ``most`` rows, one row
    gap = lambda f: (F.col(f) - F.col(f"q_{f}")) / F.when(F.col(f"stddev_pop_{f}") > 0, F.col(f"stddev_pop_{f}")).otherwise(1.0)
    distance = F.sqrt(reduce(lambda a, b: a + b, (gap(f) * gap(f) for f in features)))
    best = pairs.groupBy("anomaly").agg(F.min(F.struct(F.round(distance, 9).alias("d"), F.col(key).alias("k"))).alias("b"))
    return best.select("anomaly", F.col("b.k").alias("nearest"), F.col("b.d").alias("distance"))


def _shortened(x: Column) -> Column:
    for word, short in SHORT.items():
        x = F.replace(x, F.lit(word), F.lit(short))
    return x


def match_names(sectors: DataFrame, barrios: DataFrame) -> DataFrame:
    """For each sector the first barrio (by name) that is equal, holds it, is held by it, or is equal with words shortened.

    sectors: sector; barrios: barrio (a leading number and dash are ignored). Names meet on what they share,
    not on all pairs: a name held in another shares every three letters in a row with it, and names equal when shortened share
    that form. Names of one or two letters meet equal ones only.
    """
    bare = lambda c: F.upper(F.trim(F.regexp_replace(c, r"^[^-]*-", "")))
    s = sectors.select("sector", F.upper(F.trim("sector")).alias("a")).distinct()
    b = barrios.select("barrio", F.when(F.col("barrio").contains("-"), bare(F.col("barrio"))).otherwise(F.upper(F.trim("barrio"))).alias("b")).distinct()

    def grams(c: str) -> Column:  # every three letters in a row; shorter names as they are
        return F.array_distinct(F.when(F.length(c) < 3, F.array(F.col(c))).otherwise(F.regexp_extract_all(c, F.lit("(?=(...))"), F.lit(1))))

    short = lambda c: F.array_distinct(F.concat(grams(c), F.array(F.concat(F.lit("="), _shortened(F.col(c))))))
    pairs = s.withColumn("g", F.explode(short("a"))).join(b.withColumn("g", F.explode(short("b"))), "g").drop("g").distinct()
    fits = F.col("b").contains(F.col("a")) | F.col("a").contains(F.col("b")) | (_shortened(F.col("a")) == _shortened(F.col("b")))
    return pairs.filter(fits).groupBy("sector").agg(F.min("barrio").alias("barrio"))


def alert_message(level: Column, barrio: Column, drop: Column, vulnerability: Column, streak: Column) -> Column:
    """One sentence on an alert, and one more where consumption has been falling for months."""
    text = F.format_string("%s: %s, consumo -%.0f %%, vulnerabilidad %.0f %%.", level, barrio, F.abs(drop) * 100, vulnerability * 100)
    action = F.when(level == "CRITICO", " Verificar en persona.").when(level == "ALTO", " Llamar a servicios sociales.").otherwise(" Observar.")
    return F.concat(text, action, F.when(streak >= 2, F.format_string(" Baja desde hace %d meses.", streak)).otherwise(""))


def household_factors(df: DataFrame, key: str, x: str, categories: dict[str, list], numbers: list[str], known_leak: str, alpha: float = 1.0) -> DataFrame:
    """Ridge regression of use on one-hot categories and numbers, fitted without known leaks; per contract the residuals' mean,
    deviation, mean size and greatest, their place among peers, a score and whether it is in the highest tenth.

    df: key, barrio, uso, x, columns of categories and numbers, known_leak.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    hot = F.array(*((F.col(c) == F.lit(v)).cast("double") for c, vs in categories.items() for v in vs), *(F.col(c).cast("double") for c in numbers))
    rows = df.select(key, "barrio", "uso", F.col(x).cast("double").alias("_y"), F.col(known_leak).alias("_leak"), array_to_vector(hot).alias("_v"))
    train = rows.filter("NOT _leak")
    size = train.agg(F.count("*").alias("n"), F.stddev_pop("_y").alias("s")).first()
    ridge = alpha / max(size["n"], 1) * (size["s"] or 1.0)  # MLlib divides by the label's deviation
    model = LinearRegression(featuresCol="_v", labelCol="_y", elasticNetParam=0.0, regParam=ridge, standardization=False, solver="normal").fit(train)
    scored = model.transform(rows).withColumn("r", F.col("_y") - F.col("prediction"))
    g = written(scored.groupBy(key, "barrio", "uso").agg(F.avg("r").alias("mean_residual"), F.stddev_samp("r").alias("std_residual"), F.avg(F.abs("r")).alias("mean_abs_residual"), F.max("r").alias("max_residual")))
    ends = g.agg(F.avg("mean_residual").alias("_m"), F.stddev_samp("mean_residual").alias("_s"), F.max("mean_abs_residual").alias("_a"))
    peers = average_rank("mean_residual", "barrio", "uso") / F.count("*").over(Window.partitionBy("barrio", "uso"))
    g = g.withColumn("peer_rank_pct", peers).crossJoin(F.broadcast(ends))  # one row
    z = (F.col("mean_residual") - F.col("_m")) / (F.col("_s") + 1e-10)
    score = 0.5 * F.least(F.col("mean_abs_residual") / (F.col("_a") + 1e-10), F.lit(1.0)) + 0.3 * F.least(F.abs(z), F.lit(3.0)) / 3 + 0.2 * (1 - F.col("peer_rank_pct"))
    g = written(g.withColumns({"residual_zscore": z, "score": score}).drop("_m", "_s", "_a"))
    limit = g.agg(F.percentile("score", F.lit(0.90)).alias("_q"))
    return g.crossJoin(F.broadcast(limit)).withColumn("is_anomaly", F.col("score") > F.col("_q")).drop("_q")  # one row
