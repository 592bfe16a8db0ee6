"""Rank tests and outside evidence against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.functions import tails
from aforo.operators import evidence


def mean_ranks(v):
    return np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])


def test_tails_of_columns(spark):
    z = [0.0, 0.3, -1.0, 1.959963985, 4.5, 8.0, 12.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", evidence.normal_tails(F.col("z")).alias("p"), *(evidence.chi_squared_tail(F.abs("z"), d).alias(f"c{d}") for d in (1, 2, 3, 6))).collect()
    for r in got:
        a = abs(r.z)
        assert r.p == pytest.approx(2 * tails.normal_upper(a), abs=1e-12)
        assert r.c1 == pytest.approx(2 * tails.normal_upper(math.sqrt(a)), abs=1e-12) and r.c2 == pytest.approx(math.exp(-a / 2))
        assert r.c3 == pytest.approx(r.c1 + math.exp(-a / 2) * math.sqrt(a / 2) / math.gamma(1.5)) and r.c6 == pytest.approx(math.exp(-a / 2) * (1 + a / 2 + a * a / 8))


def score_rows(n=60):
    rnd = random.Random(2)
    return [(f"u{i}", rnd.choice([0.1, 0.2, 0.3]), rnd.choice([0.1, 0.2, 0.5]), rnd.random(), 0.2) for i in range(n)]


def test_rank_tests_equal_plain_loops(spark):
    rows, models = score_rows(), ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "unit string, a double, b double, c double, d double").repartition(3)
    x = np.array([r[1:] for r in rows])
    n, k = x.shape
    ranks = np.array([mean_ranks(v) for v in x])
    ties = sum(c**3 - c for v in x for c in np.unique(v, return_counts=True)[1])
    want = (12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    got = evidence.friedman(df, "unit", models).collect()[0]
    assert got.statistic == pytest.approx(want) and got.n == 60 and 0 <= got.p_value <= 1
    assert evidence.friedman(df, "unit", models[:2]).count() == 0 == evidence.friedman(df.limit(2), "unit", models).count()
    pairs = {(r.model_a, r.model_b): r for r in evidence.wilcoxon(df, "unit", models).collect()}
    assert len(pairs) == 6
    for i, j in itertools.combinations(range(4), 2):
        d = np.round(x[:, i] - x[:, j], 12)
        d = d[d != 0]
        r, m = mean_ranks(np.abs(d)), len(d)
        w = min(r[d > 0].sum(), r[d < 0].sum())
        t = sum(c**3 - c for c in np.unique(np.abs(d), return_counts=True)[1])
        z = (w - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - t / 48)
        one = pairs[models[i], models[j]]
        p = 2 * tails.normal_upper(abs(z))
        assert (one.statistic, one.n) == (pytest.approx(w), m) and one.p_value == pytest.approx(p, abs=1e-9)
        assert one.better == ((models[i] if x[:, i].std() < x[:, j].std() else models[j]) if p < 0.05 else None)
    stable = {r.model: r for r in evidence.model_stability(df, models).collect()}
    assert stable["d"].cv == pytest.approx(0) and stable["d"].verdict == "ESTABLE" and stable["c"].std_score == pytest.approx(x[:, 2].std())
    assert evidence.model_stability(df.withColumn("a", F.lit(0.0)), ["a"]).collect()[0].verdict == "INESTABLE"


def test_meters_and_changes(spark):
    meters = spark.createDataFrame([("a", "2000-01-01", True), ("a", None, False), ("b", "2010-01-01", False), ("b", "2010-01-01", False), ("c", None, True)], "barrio string, installed string, smart boolean").withColumn("installed", F.to_date("installed"))
    got = {r.barrio: r for r in evidence.meter_risk(meters, "2020-01-01").collect()}
    assert got["a"].smart_pct == 50 and got["a"].mean_age_years == pytest.approx(7305 / 365.25) and got["c"].risk_score is None
    assert (got["a"].age_rank, got["b"].age_rank, got["b"].manual_rank, got["a"].manual_rank, got["b"].risk_score) == (1, 2, 1, 2, 1.5)
    changes = spark.createDataFrame([("2020-01-01", "PA"), ("2020-01-01", "x"), ("2020-03-01", "PA"), ("2020-03-01", None), ("2020-03-01", "MR"), (None, "PA")], "m string, r string")
    rates = evidence.problematic_rate(changes, "m", "r", ("PA", "MR"))
    assert [tuple(r) for r in rates.orderBy("month").collect()] == [("2020-01-01", 2, 1, 0.5, 0), ("2020-03-01", 3, 2, pytest.approx(2 / 3), 1)]
    assert evidence.rate_trend(rates).collect()[0].trend_slope == pytest.approx(2 / 3 - 0.5) and evidence.rate_trend(rates.limit(0)).collect()[0].trend_slope == 0


def test_external_validation(spark):
    rnd = random.Random(5)
    rows = [(e, f"u{i:02d}", x, (x if e == "near" else 0) + rnd.random() * 0.2) for e in ("near", "none") for i in range(24) for x in [rnd.random()]]
    rows += [("few", "u1", 1.0, 1.0), ("near", "u99", None, 1.0)]
    got = {r.evidence: r for r in evidence.external_validation(spark.createDataFrame(rows, "evidence string, unit string, x double, y double"), 200, 100).collect()}
    assert set(got) == {"near", "none"}
    for e in got:
        x, y = (np.array([r[k] for r in rows if r[0] == e and r[2] is not None]) for k in (2, 3))
        assert got[e].rho == pytest.approx(np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1]) and got[e].n == 24 and got[e].k == 10
        assert got[e].hit_rate == len(set(np.argsort(-x)[:10]) & set(np.argsort(-y)[:10])) / 10 and got[e].ci_low < got[e].rho < got[e].ci_high
    assert got["near"].p_value == pytest.approx(1 / 201) and got["none"].p_value > 0.05
