"""Distances between samples, drift, information, rank tests, changes, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.ranges import running_sums, written

_ALL = Window.unboundedPreceding


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r of the rows that have both: NaN where one of them does not vary, for which Spark's own ``corr`` divides by zero; null without rows."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / spread)


def ecdf_gap(df: DataFrame, key: str, x: str, side: str) -> DataFrame:
    """Per key: Wasserstein distance (area between the two samples' distributions) and KS statistic.

    ``side`` is true for one sample and false for the other. Counts per distinct value come first, so that
    windows run over distinct values.
    """
    t = F.col(side).cast("int")
    g = df.groupBy(key, F.col(x).alias("x")).agg(F.sum(t).alias("a"), F.sum(1 - t).alias("b"))
    w, all_ = Window.partitionBy(key).orderBy("x"), Window.partitionBy(key)
    g = g.withColumns({"na": F.sum("a").over(all_), "nb": F.sum("b").over(all_)}).filter("na > 0 AND nb > 0")
    run = w.rowsBetween(_ALL, Window.currentRow)
    g = g.withColumns({"gap": F.abs(F.sum("a").over(run) / F.col("na") - F.sum("b").over(run) / F.col("nb")), "dx": F.coalesce(F.lead("x").over(w) - F.col("x"), F.lit(0.0))})
    return g.groupBy(key).agg(F.sum(F.col("gap") * F.col("dx")).alias("wasserstein"), F.max("gap").alias("ks"))


def psi(df: DataFrame, x: str, reference: str, bins: int = 10) -> DataFrame:
    """Population stability index of one feature, its status and both means, in one row."""
    cuts = df.filter(F.col(reference)).agg(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("cuts")).select(F.array_distinct("cuts").alias("cuts"))
    at = df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col(x))))  # cuts is one row
    ref = F.col(reference).cast("int")
    counts = at.groupBy("bin").agg(F.sum(ref).alias("r"), F.sum(1 - ref).alias("c"), F.sum(F.col(x) * ref).alias("sr"), F.sum(F.col(x) * (1 - ref)).alias("sc"), F.max(F.size("cuts")).alias("k"))
    w = Window.partitionBy()
    k = F.col("k") + 1
    pr, pc = (F.col("r") + 1) / (F.sum("r").over(w) + k), (F.col("c") + 1) / (F.sum("c").over(w) + k)
    out = counts.withColumns({"pr": pr, "pc": pc})
    out = out.agg(F.sum((F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr"))).alias("psi"), (F.sum("sr") / F.sum("r")).alias("ref_mean"), (F.sum("sc") / F.sum("c")).alias("cur_mean"))
    return out.withColumn("status", F.when(F.col("psi") < 0.1, "ESTABLE").when(F.col("psi") < 0.2, "DRIFT MODERADO").otherwise("DRIFT ALTO"))


def entropy_of(counts: DataFrame, *by: str) -> DataFrame:
    """Entropy (nats) of the column ``count`` per group."""
    w = Window.partitionBy(*by)
    p = F.col("count") / F.sum("count").over(w)
    return counts.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("h"))


def transfer_entropy(df: DataFrame, key: str, t: str, x: str, edges: DataFrame, bins: int = 10) -> DataFrame:
    """TE over one lag along the given edges (src, dst), from counts of binned values.

    Series are binned over their range; an edge's two series meet on time, so that the work is edges times times, not all pairs.
    Entropies come from grouped counts.
    """
    w = Window.partitionBy(key)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    b = F.when(hi > lo, F.least(F.floor((F.col(x) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    s = df.select(F.col(key).alias("k"), F.col(t).alias("t"), b.alias("b"))
    s = s.withColumn("p", F.lag("b").over(Window.partitionBy("k").orderBy("t"))).filter("p IS NOT NULL")
    pairs = s.select(F.col("k").alias("dst"), "t", F.col("b").alias("y"), F.col("p").alias("yp")).join(edges.select("src", "dst"), "dst").join(s.select(F.col("k").alias("src"), "t", F.col("p").alias("xp")), ["src", "t"])
    full = pairs.groupBy("src", "dst", "y", "yp", "xp").count()
    parts = None
    for name, cols in (("h1", ("y", "yp")), ("h2", ("yp",)), ("h3", ("y", "yp", "xp")), ("h4", ("yp", "xp"))):
        h = entropy_of(full.groupBy("src", "dst", *cols).agg(F.sum("count").alias("count")), "src", "dst").withColumnRenamed("h", name)
        parts = h if parts is None else parts.join(h, ["src", "dst"])
    return parts.select("src", "dst", F.greatest(F.col("h1") - F.col("h2") - F.col("h3") + F.col("h4"), F.lit(0.0)).alias("te"))


def moran(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Moran's I of (id, x) over edges (src, dst), both directions listed."""
    w = Window.partitionBy()
    z = values.withColumns({"z": F.col("x") - F.avg("x").over(w), "n": F.count("*").over(w)})
    z = z.withColumn("zz", F.sum(F.col("z") * F.col("z")).over(w))
    a, b = z.select(F.col("id").alias("src"), F.col("z").alias("za"), "n", "zz"), z.select(F.col("id").alias("dst"), F.col("z").alias("zb"))
    return edges.join(a, "src").join(b, "dst").agg((F.max("n") / F.count("*") * F.sum(F.col("za") * F.col("zb")) / F.max("zz")).alias("moran_i"), F.count("*").alias("n_edges"))


def runs(df: DataFrame, key: str, month: str, flag: str) -> DataFrame:
    """Runs of consecutive flagged months per key: first, last, length."""
    on = df.filter(F.col(flag)).withColumn("_m", F.year(month) * 12 + F.month(month))
    on = on.withColumn("_g", F.col("_m") - F.row_number().over(Window.partitionBy(key).orderBy("_m")))
    return on.groupBy(key, "_g").agg(F.min(month).alias("first"), F.max(month).alias("last"), F.count("*").alias("length")).drop("_g")


def cusum(df: DataFrame, key: str, t: str, x: str, k: float = 0.5, h: float = 2.0) -> DataFrame:
    """Points where a two-sided CUSUM of the standardised series passes h; both sums restart there.

    One ordered array per key, folded in the JVM.
    """
    w = Window.partitionBy(key)
    std = F.stddev_pop(x).over(w)
    z = df.select(key, t, F.when(std > 0, (F.col(x) - F.avg(x).over(w)) / std).otherwise(0.0).alias("z"))
    rows = z.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col("z").alias("z")))).alias("s"))
    fold = f"""aggregate(s, named_struct('u', 0D, 'd', 0D, 'out', filter(transform(s, v -> v.t), v -> false)),
      (a, v) -> CASE WHEN greatest(0D, a.u + v.z - {k}) > {h} OR greatest(0D, a.d - v.z - {k}) > {h} THEN named_struct('u', 0D, 'd', 0D, 'out', array_append(a.out, v.t))
                ELSE named_struct('u', greatest(0D, a.u + v.z - {k}D), 'd', greatest(0D, a.d - v.z - {k}D), 'out', a.out) END, a -> a.out)"""
    return rows.select(key, F.explode(F.expr(fold)).alias(t))


def change_context(df: DataFrame, key: str, t: str, x: str) -> DataFrame:
    """Means of three before and of this and two after, the change between them, its direction."""
    w = Window.partitionBy(key).orderBy(t)
    before, after = F.avg(x).over(w.rowsBetween(-3, -1)), F.avg(x).over(w.rowsBetween(0, 2))
    df = df.withColumns({"mean_before": before, "mean_after": after})
    pct = F.when(F.col("mean_before") > 0, (F.col("mean_after") - F.col("mean_before")) / F.col("mean_before") * 100).otherwise(0.0)
    return df.withColumn("magnitude_pct", pct).withColumn("direction", F.when(F.col("magnitude_pct") > 0, "UP").when(F.col("magnitude_pct") < 0, "DOWN").otherwise("FLAT"))


def projection(df: DataFrame, key: str, t: str, x: str, total: str, detections: str, ahead: int = 6, least: int = 6) -> DataFrame:
    """Lines through a series' use per contract and use, carried on by ``ahead`` rows: change against the mean of the last three,
    sum of the use to come, mean detections of the last three, risk. Series of fewer than ``least`` rows are left out.
    """
    w = Window.partitionBy(key)
    rows = df.withColumns({"_i": (F.row_number().over(w.orderBy(t)) - 1).cast("double"), "_n": F.count("*").over(w)}).filter(F.col("_n") >= least)
    last = F.col("_i") >= F.col("_n") - 3
    g = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.regr_slope(x, "_i").alias("trend"), F.regr_intercept(x, "_i").alias("_a"), F.regr_slope(total, "_i").alias("_s"), F.regr_intercept(total, "_i").alias("_b"),
        F.avg(F.when(last, F.col(x))).alias("current"), F.avg(F.when(last, F.col(detections))).alias("recent_rate"),
    )
    g = g.withColumn("future", F.col("_a") + F.col("trend") * (F.col("n") + ahead - 1))
    g = g.withColumn("future_total", ahead * F.col("_b") + F.col("_s") * (ahead * F.col("n") + ahead * (ahead - 1) / 2))
    g = g.withColumn("pct_change", F.when(F.col("current") > 0, (F.col("future") - F.col("current")) / F.col("current") * 100).otherwise(0.0))
    high, some = (F.col("pct_change") > 10) & (F.col("recent_rate") >= 2), (F.col("pct_change") > 5) | (F.col("recent_rate") >= 1.5)
    return g.withColumn("risk", F.when(high, "ALTO").when(some, "MEDIO").otherwise("BAJO")).drop("_a", "_b", "_s")


def min_max(x: str, *by: str) -> Column:
    """(x - least) / (greatest - least), 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(0.5)


def equal_width_bins(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Bin 0 to n - 1 of the whole range, right edges closed, the least value in the first."""
    df = df.crossJoin(F.broadcast(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))))  # one row
    lo, hi = F.col("_lo"), F.col("_hi")
    b = F.when(hi > lo, F.least(F.greatest(F.ceil((F.col(x) - lo) / (hi - lo) * n) - 1, F.lit(0)), F.lit(n - 1))).otherwise(0)
    return df.withColumn(name, b.cast("int")).drop("_lo", "_hi")


def diff_in_diff(df: DataFrame, treated: str, after: str, x: str) -> DataFrame:
    """Four means and the difference of their differences."""
    mean = lambda a, b: F.avg(F.when((F.col(treated) == a) & (F.col(after) == b), F.col(x)))
    out = df.agg(mean(True, False).alias("treated_before"), mean(True, True).alias("treated_after"), mean(False, False).alias("control_before"), mean(False, True).alias("control_after"))
    return out.withColumn("effect", F.col("treated_after") - F.col("treated_before") - F.col("control_after") + F.col("control_before"))


def inject(df: DataFrame, key: str, t: str, x: str, changes: dict[int, float], train: int) -> DataFrame:
    """Multiply the values ``train`` + offset rows into each series; column injected."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1 - train
    m = F.lit(1.0)
    for offset, by in changes.items():
        m = F.when(F.col("_i") == offset, by).otherwise(m)
    return df.withColumn("_i", i).withColumns({x: F.col(x) * m, "injected": F.col("_i").isin(*changes), "train": F.col("_i") < 0}).drop("_i")


# Share of a series that is reference, rows of a window, rows of a series at least; weights of the z-scores; slope, middle and limit of the score.
REFERENCE, WINDOW, LEAST_SERIES, LEAST_SERIES_COUNT = 0.6, 6, 6, 3
WD_WEIGHTS = {"wd_temporal_zscore": 0.40, "shift_zscore": 0.25, "cross_barrio_zscore": 0.20, "wd_multivariate_zscore": 0.15}
WD_SLOPE, WD_MIDDLE, WD_LIMIT = 0.8, 2.0, 0.55


def gap_of(a: Column, b: Column, na: int, nb: int) -> Column:
    """Wasserstein distance of two arrays of na and nb values: the mean gap of their order statistics, each repeated to a common number."""
    n = na * nb
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.abs(F.get(F.array_sort(a), F.floor(k / nb).cast("int")) - F.get(F.array_sort(b), F.floor(k / na).cast("int"))))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / n


def pooled_gap(df: DataFrame, key: str, x: str) -> DataFrame:
    """(key, distance): Wasserstein distance of each key's values from the values of all keys together.

    The pooled distribution G and its integral A(x) = x G(x) - (mean of values up to x, times their share) are running sums over distinct values, range by
    range. Between two of a key's values its own distribution is a constant c, and G crosses c once, at its quantile: so a key needs A at its own
    values, which are pooled values, and at as many quantiles, and no key meets all values. Quantiles are looked up by buckets of the share.
    """
    buckets = 1000
    rows = written(df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x")).filter("x IS NOT NULL"))
    pooled = rows.groupBy("x").agg(F.count("*").alias("c")).withColumn("cx", F.col("c") * F.col("x"))
    total = pooled.agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    pooled = running_sums(pooled, "x", {"c": "upto", "cx": "sum"}).crossJoin(F.broadcast(total))  # one row
    pooled = pooled.select("x", (F.col("upto") / F.col("n")).alias("g"), ((F.col("upto") - F.col("c")) / F.col("n")).alias("g0"), ((F.col("x") * F.col("upto") - F.col("sum")) / F.col("n")).alias("a"), "hi")
    pooled = written(pooled)
    own = rows.groupBy("k", "x").agg(F.count("*").alias("c")).join(pooled.select("x", "a", "hi"), "x")
    w = Window.partitionBy("k").orderBy("x")
    own = own.withColumns({"f": F.sum("c").over(w) / F.sum("c").over(Window.partitionBy("k")), "x2": F.lead("x").over(w), "a2": F.lead("a").over(w), "first": F.row_number().over(w) == 1})
    own = written(own.withColumn("f", F.round("f", 12)))
    shares = own.select("f").distinct().withColumn("bucket", F.floor(F.col("f") * buckets))  # as many as series have different lengths and places
    spans = pooled.select("x", "a", "g", "g0", F.explode(F.expr(f"sequence(floor(g0 * {buckets}), floor(g * {buckets}))")).alias("bucket"))
    at = shares.join(spans, "bucket").filter((F.round("g0", 12) < F.col("f")) & (F.col("f") <= F.round("g", 12))).select("f", F.col("x").alias("q"), F.col("a").alias("aq"))
    own = own.join(at, "f")
    inside = F.col("x2").isNotNull()
    q = F.when(F.col("q") <= F.col("x"), F.col("x")).when(F.col("q") >= F.col("x2"), F.col("x2")).otherwise(F.col("q"))
    aq = F.when(F.col("q") <= F.col("x"), F.col("a")).when(F.col("q") >= F.col("x2"), F.col("a2")).otherwise(F.col("aq"))
    below, above = F.col("f") * (q - F.col("x")) - (aq - F.col("a")), (F.col("a2") - aq) - F.col("f") * (F.col("x2") - q)
    last = written(pooled.filter("x = hi")).select(F.col("a").alias("top"))  # one row
    parts = own.crossJoin(F.broadcast(last)).withColumn("part", F.when(inside, below + above).otherwise((F.col("hi") - F.col("x")) - (F.col("top") - F.col("a"))) + F.when(F.col("first"), F.col("a")).otherwise(0.0))
    return parts.groupBy(F.col("k").alias(key)).agg(F.sum("part").alias("distance"))


def _z(x: str, mean: Column, spread: Column, floor: float | None) -> Column:
    """z-score: over a small addition, or 0 for hardly any spread."""
    return (F.col(x) - mean) / (F.coalesce(spread, F.lit(0.0)) + 1e-10) if floor is None else F.when(spread > floor, (F.col(x) - mean) / spread).otherwise(0.0)


def wasserstein_detection(df: DataFrame, key: str, t: str, x: str, others: list[str]) -> DataFrame:
    """Per key and t: wd_train_test (the first 60 per cent of a series against the rest), wd_cross_barrio (a series over its mean against all series'),
    wd_temporal (the window up to here against the six rows before it), wd_multivariate (the same for several measures, over their spread), distribution_shift_pct, wasserstein_score, is_anomaly_wasserstein.

    The score is a sigmoid of weighted sizes of z-scores: of keys for the first two, of a key's months for the others. Missing distances are 0.
    """
    w, whole = Window.partitionBy(key).orderBy(t), Window.partitionBy(key)
    cols = list(dict.fromkeys([x, *others]))
    i, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    rows = written(df.select(key, t, *cols).withColumns({"_i": i, "_n": n, "_mean": F.avg(x).over(whole)}))
    side = rows.filter(F.col("_n") >= LEAST_SERIES).withColumn("_ref", F.col("_i") < F.greatest(F.lit(3), F.floor(F.col("_n") * REFERENCE)))
    shift = ecdf_gap(side, key, x, "_ref").select(key, F.col("wasserstein").alias("wd_train_test"))
    few = rows.filter(F.col("_n") >= LEAST_SERIES).select(key).distinct().count() < LEAST_SERIES_COUNT
    cross = pooled_gap(rows.filter((F.col("_n") >= LEAST_SERIES) & F.lit(not few)).withColumn("_r", F.col(x) / (F.col("_mean") + 1e-10)), key, "_r").withColumnRenamed("distance", "wd_cross_barrio")
    full = (F.col("_n") >= 2 * WINDOW + 1) & (F.col("_i") >= 2 * WINDOW)
    before, now = w.rowsBetween(-2 * WINDOW, -WINDOW - 1), w.rowsBetween(-WINDOW, 0)
    parts = rows.withColumns({f"_b_{c}": F.collect_list(c).over(before) for c in cols} | {f"_a_{c}": F.collect_list(c).over(now) for c in cols} | {f"_s_{c}": F.stddev_pop(c).over(before) + 1e-10 for c in cols})
    gap = {c: gap_of(F.col(f"_b_{c}"), F.col(f"_a_{c}"), WINDOW, WINDOW + 1) for c in cols}
    multi = sum((gap[c] / F.col(f"_s_{c}") for c in others), F.lit(0.0)) / len(others)
    base = parts.select(key, t, "_mean", F.when(full, gap[x]).otherwise(0.0).alias("wd_temporal"), F.when(full, multi).otherwise(0.0).alias("wd_multivariate"))
    base = base.withColumns({f"{c}_zscore": _z(c, F.avg(c).over(whole), F.stddev_samp(c).over(whole), 1e-10) for c in ("wd_temporal", "wd_multivariate")})
    for frame, c, z in ((shift, "wd_train_test", "shift_zscore"), (cross, "wd_cross_barrio", "cross_barrio_zscore")):
        frame = written(frame)
        stats = frame.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_d"))
        scored = frame.crossJoin(F.broadcast(stats)).select(key, c, _z(c, F.col("_m"), F.col("_d"), None).alias(z))  # one row
        base = base.join(scored, key, "left").fillna({c: 0.0, z: 0.0})
    raw = sum((weight * F.abs(F.col(c)) for c, weight in WD_WEIGHTS.items()), F.lit(0.0))
    base = base.withColumn("wasserstein_score", 1 / (1 + F.exp(-WD_SLOPE * (raw - WD_MIDDLE))))
    pct = F.when(F.abs("_mean") > 1e-10, F.col("wd_train_test") / F.col("_mean") * 100).otherwise(0.0)
    return base.select(key, t, "wasserstein_score", (F.col("wasserstein_score") > WD_LIMIT).alias("is_anomaly_wasserstein"), pct.alias("distribution_shift_pct"), "wd_temporal", "wd_cross_barrio", "wd_multivariate", "wd_train_test")
