"""What isolation forests look at: Shapley values of a row's depth, and what mixing up a feature changes."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.detectors import fit_forest, forest_pool, forest_scores
from aforo.operators.learned import robust
from aforo.operators.ranges import spread, written


def covered(tree, x: np.ndarray):
    """The tree with the number of rows of x in each node: (feature, cut, low, high, rows), or (depth, rows)."""
    if not isinstance(tree, tuple):
        return tree, len(x)
    f, cut, low, high = tree
    left = x[:, f] < cut
    return f, cut, covered(low, x[left]), covered(high, x[~left]), len(x)


def leaf_shares(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 by feature, for each row of ``ones``.

    The game: with a set of known features the leaf is reached with the product of ``ones`` (0 or 1: whether the row's own
    value leads there) over the known ones and of ``zeros`` (the share of rows that go there) over the others. Subsets are summed up by size,
    as coefficients of a polynomial.
    """
    n, k = ones.shape
    weights = np.array([factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])
    out = np.zeros((n, k))
    for f in range(k):
        by_size = np.zeros((n, k))
        by_size[:, 0] = 1.0
        for g in range(k):
            if g != f:
                by_size[:, 1:] = by_size[:, 1:] * zeros[g] + by_size[:, :-1] * ones[:, g : g + 1]
                by_size[:, 0] *= zeros[g]
        out[:, f] = (ones[:, f] - zeros[f]) * (by_size @ weights)
    return out


def depth_shares(trees: list, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of each row and feature the mean share of the depth over the trees, the mean depth of the rows that cover them, each row's depth."""
    total, depth, base = np.zeros(x.shape), np.zeros(len(x)), 0.0

    def walk(node, feats: list[int], zeros: list[float], ones: list[np.ndarray], here: np.ndarray) -> None:
        nonlocal base
        if len(node) == 2:
            base += node[0] * float(np.prod(zeros))
            depth[here] += node[0]
            if feats:
                code = np.zeros(len(x), np.int64)
                for o in ones:
                    code = code * 2 + o
                patterns, back = np.unique(code, return_inverse=True)
                bits = (patterns[:, None] >> np.arange(len(feats))[::-1] & 1).astype(float)
                total[:, feats] += node[0] * leaf_shares(bits, np.array(zeros))[back]
            return
        f, cut, low, high, rows = node
        left = x[:, f] < cut
        for child, goes in ((low, left), (high, ~left)):
            share = child[-1] / rows if rows else 0.0
            if f in feats:
                at = feats.index(f)
                z, o = [*zeros], [*ones]
                z[at], o[at] = z[at] * share, o[at] & goes
                walk(child, feats, z, o, here & goes)
            else:
                walk(child, [*feats, f], [*zeros, share], [*ones, goes], here & goes)

    for tree in trees:
        walk(tree, [], [], [], np.ones(len(x), bool))
    n = max(len(trees), 1)
    return total / n, base / n, depth / n


def explain_forest(df: DataFrame, key: list[str], features: list[str], trees: int = 100, sample: int = 256, seed: int = 42, top: int = 3) -> DataFrame:
    """Per row: depth (mean over an isolation forest's trees), base (that of the rows it was fitted on), shares (by feature; their sum is
    depth less base), top_features (the ``top`` of largest share by size, ties in the order of ``features``), directions ("sube" adds depth).

    The forest is that of ``isolation_forest`` with the same seed; nodes are weighted by the bounded sample it was fitted on. Scoring is
    Arrow-batched over the broadcast trees; rows are dealt out evenly, as each takes long. Nulls count as 0, as in the detector's input.
    """
    clean = df.select(*key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    pool = forest_pool(clean, key, features, trees, sample, seed)
    forest, _ = fit_forest(pool, trees, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast([covered(t, pool) for t in forest])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                shares, base, depth = depth_shares(shared.value, part[features].to_numpy(float))
                best = np.argsort(-np.abs(shares), axis=1, kind="stable")[:, :top]
                yield part[key].assign(
                    depth=depth,
                    base=base,
                    shares=list(shares),
                    top_features=[[features[f] for f in row] for row in best],
                    directions=[["sube" if s[f] > 0 else "baja" for f in row] for s, row in zip(shares, best)],
                )

    schema = clean.select(*key, F.lit(0.0).alias("depth"), F.lit(0.0).alias("base"), F.array(F.lit(0.0)).alias("shares"), F.array(F.lit("")).alias("top_features"), F.array(F.lit("")).alias("directions")).schema
    return spread(clean, *key).mapInPandas(run, schema)


# Repeats, share of rows that are top, quartiles between the categories.
REPEATS, TOP_SHARE, CATEGORIES = 10, 0.05, ((0.75, "CRITICAL"), (0.25, "LOW"))


def _shuffled(h: np.ndarray, variant: int, n: int) -> np.ndarray:
    """A row of the pool for each row and variant, by a hash of both."""
    x = h.astype(np.uint64) + np.uint64(variant + 1) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def permutation_importance(df: DataFrame, key: list[str], features: list[str], repeats: int = REPEATS, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Per feature: importance (mean Jaccard distance between the strangest rows and those when its values are mixed up), std, rank, category.

    The strangest are the TOP_SHARE with the lowest isolation forest scores. A mixed-up value is one of the bounded sample the forest is fitted on,
    drawn by a hash of row, feature and repeat, so that no column is sorted: each row is scored in all variants where it is read, and what is
    shuffled are sketches of scores and counts a variant. The upper quarter by importance is CRITICAL, the lower one LOW.
    """
    clean = robust(df.select(*key, *features).withColumn("_all", F.lit(True)), features, "_all").drop("_all")
    pool = forest_pool(clean, key, features, trees, sample, seed)
    if not len(pool):
        return df.sparkSession.createDataFrame([], "feature string, importance double, std double, rank int, category string")
    forest, norm = fit_forest(pool, trees, sample, seed)
    shared = df.sparkSession.sparkContext.broadcast((forest, norm, pool))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, norm, pool = shared.value
        for b in batches:
            x, h = b[features].to_numpy(float), b["_h"].to_numpy()
            scores = [forest_scores(forest, norm, x)]
            for j in range(len(features)):
                for r in range(repeats):
                    mixed = x.copy()
                    mixed[:, j] = pool[_shuffled(h, j * repeats + r, len(pool)), j]
                    scores.append(forest_scores(forest, norm, mixed))
            yield pd.DataFrame({"base": np.round(scores[0], 12), "scores": list(np.round(np.stack(scores[1:], 1), 12))})

    hashed = clean.withColumn("_h", F.xxhash64(F.lit(seed), *key)).select("_h", *features)
    rows = written(spread(hashed, "_h").mapInPandas(run, "base double, scores array<double>"))
    cut = lambda c: F.percentile_approx(c, F.lit(TOP_SHARE), F.lit(10_000))
    each = rows.select("base", F.posexplode("scores").alias("v", "s"))
    cuts = each.groupBy("v").agg(cut("s").alias("_s")).crossJoin(F.broadcast(rows.agg(cut("base").alias("_b"))))  # one row
    each = each.join(F.broadcast(cuts), "v")  # a row a variant
    top, now = F.col("base") <= F.col("_b"), F.col("s") <= F.col("_s")
    g = each.groupBy("v").agg((1 - F.count_if(top & now) / (F.count_if(top | now) + 1e-10)).alias("d"))
    per = g.groupBy((F.floor(F.col("v") / repeats)).cast("int").alias("j")).agg(F.avg("d").alias("importance"), F.stddev_pop("d").alias("std"))
    cats = per.agg(*(F.percentile("importance", F.lit(q)).alias(f"_{name}") for q, name in CATEGORIES))  # a row a feature goes in
    category = F.when(F.col("importance") <= F.col("_LOW"), "LOW").when(F.col("importance") >= F.col("_CRITICAL"), "CRITICAL").otherwise("MEDIUM")
    out = per.crossJoin(F.broadcast(cats)).withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("importance"), "j")), "category": category, "feature": F.array(*map(F.lit, features))[F.col("j")]})  # a row a feature
    return out.select("feature", "importance", "std", "rank", "category")
