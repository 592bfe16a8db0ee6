"""Conformal distances, attribution, causal structure and resampling against plain loops."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.functions import tails
from aforo.operators import attribution, causal, conformal, detectors, learned, resampling
from aforo.plans import learned as plans


def test_tails():
    assert tails.student_two_sided(12.7062047, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.student_two_sided(-2.2281389, 10) == pytest.approx(0.05, abs=1e-8) and tails.student_two_sided(0, 7) == 1
    assert tails.normal_upper(1.959963985) == pytest.approx(0.025, abs=1e-9)


# E4


def plain_conformal(rows, months):
    """rows of (key, month, values): p of each."""
    x = np.array([r[2] for r in rows], float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    at = np.array([months.index(r[1]) for r in rows])
    out = np.ones(len(rows))
    for k in range(6, len(months)):
        past, now = x[at < k], x[at == k]
        if len(past) < 20:
            continue
        mean, sd = past.mean(0), np.where(past.std(0) > 1e-6, past.std(0), 1)
        z, t = (past - mean) / sd, (now - mean) / sd
        n, p = z.shape
        cov = z.T @ z / n
        mu = np.trace(cov) / p
        d2 = ((cov - mu * np.eye(p)) ** 2).sum() / p
        b2 = min(d2, sum(((np.outer(v, v) - cov) ** 2).sum() for v in z) / p / n**2)
        inverse = np.linalg.inv((1 - b2 / d2) * cov + b2 / d2 * mu * np.eye(p)) if n > p + 1 else np.eye(p)
        cal, own = (np.round(np.sqrt(np.einsum("ij,jk,ik->i", v, inverse, v)), 9) for v in (z, t))
        out[at == k] = [((cal >= s).sum() + 1) / (n + 1) for s in own]
    return out


def test_expanding_conformal_equals_a_refit_each_month(spark):
    rnd = np.random.default_rng(0)
    mix = rnd.normal(size=(5, 5))
    rows = [(f"k{i}", f"2020-{m + 1:02d}-01", (rnd.normal(size=5) @ mix * (30 if i == m == 9 else 1) + 100).tolist()) for m in range(11) for i in range(12)]
    rows += [("k0", "2020-11-01", rows[0][2])]  # a repeated key
    df = spark.createDataFrame([(k, m, *v) for k, m, v in rows], "key string, month string, a double, b double, c double, d double, e double").withColumn("month", F.to_date("month"))
    got = conformal.expanding_conformal(df, ["key", "month"], "month", list("abcde")).collect()
    want = plain_conformal(rows, sorted({r[1] for r in rows}))
    assert sorted((r.key, str(r.month), round(r.conformal_pvalue, 9)) for r in got) == sorted((k, m, round(p, 9)) for (k, m, _), p in zip(rows, want))
    by = {(r.key, str(r.month)): r for r in got}
    assert by["k9", "2020-10-01"].conformal_anomaly and by["k9", "2020-10-01"].conformal_significance in ("**", "***") and by["k1", "2020-03-01"].conformal_pvalue == 1
    nulls = df.withColumns({"month": F.when(F.col("key") != "k1", F.col("month")), "a": F.when(F.col("key") != "k2", F.col("a"))})
    odd = conformal.expanding_conformal(nulls, ["key", "month"], "month", list("abcde"))
    assert odd.count() == len(rows) and all(r.conformal_pvalue == 1 for r in odd.filter("month IS NULL").collect())
    assert {r.conformal_pvalue for r in conformal.expanding_conformal(df, ["key", "month"], "month", ["a"]).collect()} == {1.0}
    assert conformal.expanding_conformal(df.limit(0), ["key", "month"], "month", list("abcde")).count() == 0


# E8


def tree_value(node, x, known):
    """Mean depth of a covered tree when only the features in ``known`` are known."""
    if len(node) == 2:
        return node[0]
    f, cut, low, high, n = node
    if f in known:
        return tree_value(low if x[f] < cut else high, x, known)
    return sum(c[-1] / n * tree_value(c, x, known) for c in (low, high)) if n else 0.0


def test_shares_are_shapley_values(spark):
    rnd = np.random.default_rng(2)
    pool = rnd.normal(size=(90, 4))
    forest, _ = detectors.fit_forest(pool, 4, 32, 1)
    trees = [attribution.covered(t, pool) for t in forest]
    x = rnd.normal(size=(6, 4)) * 2
    shares, base, depth = attribution.depth_shares(trees, x)
    assert np.allclose(shares.sum(1), depth - base)
    for i, row in enumerate(x):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += w * np.mean([tree_value(t, row, {*s, f}) - tree_value(t, row, s) for t in trees])
            assert shares[i, f] == pytest.approx(want, abs=1e-9)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.vstack([pool, [[0, 9, 0, 0]]]))], "i int, a double, b double, c double, d double").withColumn("c", F.when(F.col("i") != 3, F.col("c")))
    got = {r.i: r for r in attribution.explain_forest(df, ["i"], list("abcd"), 30).collect()}
    assert got[90].top_features[0] == "b" and got[90].directions[0] == "baja" and len(got) == 91
    assert all(sum(r.shares) == pytest.approx(r.depth - r.base) for r in got.values())
    assert attribution.explain_forest(df.limit(0), ["i"], list("abcd"), 3).count() == 0


def test_permutation_importance(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(400, 3))
    x[:20, 0] *= 12  # strange by the first feature only
    df = spark.createDataFrame([(i, *map(float, v), 1.0) for i, v in enumerate(x)], "i int, a double, b double, c double, k double")
    got = {r.feature: r for r in attribution.permutation_importance(df, ["i"], ["a", "b", "c", "k"], repeats=4, trees=40).collect()}
    assert got["a"].rank == 1 and got["a"].category == "CRITICAL" and got["k"].importance < 1e-9 and got["k"].category == "LOW" and 0.3 < got["a"].importance <= 1
    assert sorted(r.rank for r in got.values()) == [1, 2, 3, 4] and got["a"].importance > got["b"].importance + 0.2
    assert attribution.permutation_importance(df.limit(0), ["i"], ["a", "b"]).count() == 0


def test_changepoints_are_a_union(spark):
    values = [1.0, 1.1, 0.9, 1.0, 1.05, 5.0, 5.1, 4.9, 5.0, 5.05, 5.0, 4.95]
    df = spark.createDataFrame([(k, i, v + 0.01 * i) for k in ("a", "b") for i, v in enumerate(values if k == "a" else [1.0] * 12)], "k string, t int, x double")
    got = {(r.k, r.t): r for r in detectors.changepoints(df, "k", "t", "x").collect()}
    p = {(r.k, r.t): r.p_change for r in detectors.bocpd(df, "k", "t", "x").collect()}
    from aforo.operators.statistics import cusum

    passed = {(r.k, r.t) for r in cusum(df, "k", "t", "x").collect()}
    assert set(got) == passed | {at for at, v in p.items() if v > 0.3} and passed and all(r.p_change == p[at] and r.by_cusum == (at in passed) for at, r in got.items())


# C1 to C3


def plain_partial(x, i, j, given):
    z = x[:, list(given)]
    a, b = (x[:, k] - z @ np.linalg.pinv(z) @ x[:, k] if given else x[:, k] for k in (i, j))
    if min(a.std(), b.std()) < 1e-10 or len(x) < len(given) + 5:
        return 0.0, 1.0
    r, dof = np.corrcoef(a, b)[0, 1], len(x) - len(given) - 2
    return r, tails.student_two_sided(r * math.sqrt(dof / (1 - r * r + 1e-15)), dof)


def causal_rows(n=400, seed=4):
    rnd = np.random.default_rng(seed)
    old, density = rnd.normal(size=n), rnd.normal(size=n)
    anr = 0.8 * old + 0.9 * density + rnd.normal(size=n) * 0.5
    cpc = 0.7 * anr + rnd.normal(size=n) * 0.6
    dev = rnd.normal(size=n)
    score = 0.6 * cpc + 0.6 * dev + rnd.normal(size=n) * 0.5
    return np.column_stack([old * 5 + 20, density * 100 + 900, anr * 0.2 + 1.2, cpc * 9 + 50, dev, score * 0.1 + 0.3, score + rnd.normal(size=n) * 0.6])


@pytest.mark.parametrize("seed", [4, 5])
def test_structure_and_effects_equal_residual_regressions(spark, seed):
    names, x = list(causal.ORDER), causal_rows(seed=seed)
    df = spark.createDataFrame([(f"k{i}", *map(float, r)) for i, r in enumerate(x)], "barrio_key string, " + ", ".join(f"{v} double" for v in names))
    df = df.unionByName(df.limit(5).withColumn("anr_ratio", F.lit(None).cast("double")))  # incomplete rows are left out
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    c = causal.correlations(df, names)
    assert c.n == len(x)
    for size in range(4):
        for i, j, *given in itertools.islice(itertools.permutations(range(7), 2 + size), 40):
            assert c.partial(i, j, tuple(given)) == pytest.approx(plain_partial(z, i, j, given), abs=1e-9)

    class Plain(causal.Correlations):
        def partial(self, i, j, given=()):
            return plain_partial(z, i, j, given)

    plain = Plain(names, c.r, len(x))
    edges, apart = causal.skeleton(plain)
    assert (edges, apart) == causal.skeleton(c)
    arrows = causal.orient(plain, edges, apart)
    effects = causal.causal_effects(df, names)
    got = {(r.cause, r.effect): r for r in effects.collect()}
    assert set(got) == {(names[a], names[b]) for a, b in arrows}
    assert {("pct_elderly_65plus", "anr_ratio"), ("population_density", "anr_ratio"), ("anr_ratio", "consumption_per_contract"), ("consumption_per_contract", "anomaly_score"), ("deviation_from_group_trend", "anomaly_score")} <= set(got)
    for (a, b), r in got.items():
        i, j = names.index(a), names.index(b)
        others = [p for p, q in sorted(arrows) if q == j and p != i]
        design = np.column_stack([np.ones(len(z)), z[:, [i, *others]]])
        beta, left, *_ = np.linalg.lstsq(design, z[:, j], rcond=None)
        error = math.sqrt(left[0] / (len(z) - design.shape[1]) * np.linalg.inv(design.T @ design)[1, 1])
        assert r.direct_beta == pytest.approx(beta[1]) and r.p_value == pytest.approx(tails.student_two_sided(beta[1] / error, len(z) - design.shape[1]), abs=1e-12)
    assert got["anr_ratio", "consumption_per_contract"].total_effect == pytest.approx(got["anr_ratio", "consumption_per_contract"].direct_beta * got["consumption_per_contract", "anomaly_score"].direct_beta)
    total = {r.cause: r.total_effect for r in got.values()}
    impact = causal.intervention_impact(df.dropna(), "barrio_key", effects).collect()
    sd, median = x.std(0, ddof=1), np.median(x, axis=0)
    assert {r.barrio_key for r in impact} == {f"k{i}" for i, s in enumerate(x[:, 5]) if s > 0.3}
    for r in impact[:40]:
        v = names.index(r.variable)
        goal = {"anr_ratio": 1.0, "deviation_from_group_trend": 0.0}.get(r.variable, median[v])
        assert r.counterfactual_value == pytest.approx(goal) and r.delta_anomaly_score == pytest.approx((goal - r.current_value) / sd[v] * total[r.variable] * sd[5])
    sums = {}
    for r in impact:
        sums[r.barrio_key] = sums.get(r.barrio_key, 0) + r.fraction_explained
    assert max(sums.values()) <= 1 + 1e-9
    assert causal.causal_effects(df, names[:2]).count() == 0 == causal.intervention_impact(df, "barrio_key", causal.causal_effects(df, names[:2])).count()
    calm = causal.intervention_impact(df.dropna().withColumn("anomaly_score", F.col("anomaly_score") / 100), "barrio_key", effects)
    assert calm.select("barrio_key").distinct().count() == causal.AT_LEAST


# C7


def plain_draw(*parts):
    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_null_labels_equal_plain_loops(spark):
    rnd = random.Random(6)
    rows = [(i, f"b{rnd.randrange(9)}", rnd.random()) for i in range(300)] + [(i, "b3", 0.9) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "i int, b string, s double")
    got = resampling.null_label_test(df, ["i"], "b", "s", rounds=40, top=2).collect()[0]

    def extremes(pairs):
        groups = {}
        for b, s in pairs:
            groups.setdefault(b, []).append(s)
        means = sorted((np.mean(v) for v in groups.values()), reverse=True)
        return np.mean(means[:2]), np.mean(means[:2]) - np.mean(means[-2:])

    labels = sorted(b for _, b, _ in rows)
    null = [extremes((labels[plain_draw("null", k, i) % len(rows)], s) for i, _, s in rows) for k in range(1, 41)]
    real = extremes((b, s) for _, b, s in rows)
    assert got.observed_top == pytest.approx(real[0]) and got.null_mean == pytest.approx(np.mean([t for t, _ in null])) and got.null_std == pytest.approx(np.std([t for t, _ in null]))
    assert got.p_value == pytest.approx((sum(t >= real[0] for t, _ in null) + 1) / 41) and got.p_spread == pytest.approx((sum(d >= real[1] for _, d in null) + 1) / 41)
    assert resampling.null_label_test(df, ["i"], "b", "s", rounds=3, top=20).count() == 0


def test_month_weights(spark):
    months = spark.createDataFrame([(f"m{i}",) for i in range(7)], "month string")
    got = {(r["round"], r.month): r.w for r in resampling.month_weights(months, 5, "x").collect()}
    want = {}
    for k in range(1, 6):
        for slot in range(1, 8):
            at = k, f"m{plain_draw('x', k, slot) % 7}"
            want[at] = want.get(at, 0) + 1
    assert got == want


# M2's features


def test_informative_features(spark):
    rnd = np.random.default_rng(8)
    y = rnd.normal(size=600)
    cols = {"same": y, "near": y + rnd.normal(size=600) * 0.3, "square": y**2, "noise": rnd.normal(size=600), "constant": np.ones(600)}
    df = spark.createDataFrame([(*map(float, v), float(t)) for *v, t in zip(*cols.values(), y)], ", ".join(f"{c} double" for c in [*cols, "y"])).withColumn("noise", F.when(F.col("noise") > -1, F.col("noise")))
    assert learned.informative(df, list(cols), "y", 3) == ["same", "near", "square"] and learned.informative(df, list(cols), "y", 9) == list(cols)
    assert len(plans.MONTHLY) == 13 and len(plans.RELATIVE) == 10 and not {"consumption_per_contract", "rolling_mean_3"} & set(plans.RELATIVE)
