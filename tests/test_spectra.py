"""Survival, betweenness, probabilistic components, spectra and shapes of days against plain loops."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.operators import learned, networks, spectra, survival

# H3


def plain_cox(t, e, x, penalty=0.1):
    """Newton on the penalised Efron likelihood, loops over event times."""
    n, p = x.shape
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    beta = np.zeros(p)
    for _ in range(60):
        w = np.exp(z @ beta)
        g, h = -n * penalty * beta, n * penalty * np.eye(p)
        for at in np.unique(t[e]):
            risk, dead = t >= at, (t == at) & e
            d = dead.sum()
            g = g + z[dead].sum(0)
            for k in range(d):
                ww = np.where(dead, w * (1 - k / d), w) * risk
                m = (ww[:, None] * z).sum(0) / ww.sum()
                g = g - m
                h = h + (ww[:, None, None] * z[:, :, None] * z[:, None, :]).sum(0) / ww.sum() - np.outer(m, m)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    raw = beta / x.std(0, ddof=1)
    centred = np.exp((x - x.mean(0)) @ raw)
    times = np.unique(t)
    near = times[np.argmin(np.abs(times - 60))]
    hazard = sum(((t == at) & e).sum() / centred[t >= at].sum() for at in np.unique(t[e]) if at <= near)
    return raw, hazard, centred


@pytest.mark.parametrize("seed", [0, 1])
def test_cox_equals_plain_newton(spark, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(220, 3)) * [1, 5, 0.2] + [0, 40, 3]
    t = np.ceil(rnd.exponential(60, 220) * np.exp(-0.8 * x[:, 0]) / 5) * 5  # many ties
    e = rnd.random(220) < 0.7
    df = spark.createDataFrame([(i, float(a), bool(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(t, e, x))], "i int, t double, e boolean, a double, b double, c double").repartition(3)
    gaps = df.unionByName(df.limit(4).withColumns({"i": F.lit(-1), "a": F.lit(None).cast("double")}))
    raw, hazard, centred = plain_cox(t, e, x)
    model = survival.fit_cox(gaps, "t", "e", ["a", "b", "c"])
    assert model.n == 220 and model.events == e.sum() and np.allclose(model.beta, raw, atol=1e-7) and model.hazard == pytest.approx(hazard, rel=1e-7) and (model.error > 0).all()
    got = {r.i: r for r in survival.cox_risk(gaps, "i", "t", "e", ["a", "b", "c"]).collect()}
    assert len(got) == 221 and all(got[i].hazard_ratio == pytest.approx(c, rel=1e-6) for i, c in enumerate(centred))
    risk = np.array([r.predicted_risk_60d for r in got.values()])
    assert risk == pytest.approx(1 - np.exp(-hazard * np.array([r.hazard_ratio for r in got.values()])), rel=1e-6)
    groups = [sum(r.risk_group == g for r in got.values()) for g in ("ALTO", "MEDIO", "BAJO")]
    assert groups[0] <= 24 and groups[1] > 30 and groups[2] > 140
    assert survival.fit_cox(df.withColumn("e", F.lit(False)), "t", "e", ["a"]) is None
    assert survival.cox_risk(df.limit(0), "i", "t", "e", ["a", "b"]).count() == 0


# M17


@pytest.mark.parametrize("seed", range(3))
def test_betweenness_equals_all_paths(spark, seed):
    rnd = np.random.default_rng(seed)
    n = 11
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.3 and b != 10]
    edges = [(a, b, float(rnd.integers(1, 4)) if seed else 1.0) for a, b in pairs]
    near = {(a, b): w for a, b, w in edges} | {(b, a): w for a, b, w in edges}
    want = np.zeros(n)

    def paths(v, goal, seen, length):
        if v == goal:
            yield length, seen
            return
        for w in range(n):
            if (v, w) in near and w not in seen:
                yield from paths(w, goal, (*seen, w), length + near[v, w])

    for s, t in itertools.permutations(range(n), 2):
        found = list(paths(s, t, (s,), 0.0))
        least = min((x for x, _ in found), default=None)
        best = [p for x, p in found if x == least]
        for p in best:
            for v in p[1:-1]:
                want[v] += 1 / len(best)
    rows = [*edges, (3, 3, 1.0), *([(b, a, w) for a, b, w in edges[:2]])]
    got = networks.betweenness(spark.range(n).select(F.col("id").cast("int").alias("id")), spark.createDataFrame(rows, "a int, b int, w double"))
    assert {r.id: round(r.betweenness, 9) for r in got.collect()} == {i: round(v / ((n - 1) * (n - 2)), 9) for i, v in enumerate(want)}
    with pytest.raises(ValueError):
        networks.betweenness(spark.range(3), spark.createDataFrame(edges, "a int, b int, w double"), most=2)


# M13p


def test_probabilistic_components(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(240, 2)) @ rnd.normal(size=(2, 6)) * 2 + rnd.normal(size=(240, 6)) * 0.3
    x[230] += 6
    df = spark.createDataFrame([(i, i < 200, *map(float, v)) for i, v in enumerate(x)], "i int, train boolean, a double, b double, c double, d double, e double, f double")
    got = {r.i: r for r in learned.probabilistic_pca(df, ["i"], list("abcdef"), 2).collect()}
    low, mid, high = (np.sort(x[:200], axis=0)[int(np.ceil(200 * q)) - 1] for q in (0.25, 0.5, 0.75))
    z = (x - mid) / (high - low)
    mean, cov = z[:200].mean(0), np.cov(z[:200].T)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    noise = values[2:].mean()
    model = axes[:, :2] * values[:2] @ axes[:, :2].T + noise * (np.eye(6) - axes[:, :2] @ axes[:, :2].T)
    w = axes[:, :2] * np.sqrt(values[:2] - noise)
    for i in range(200, 240):
        c = z[i] - mean
        likelihood = -0.5 * (6 * np.log(2 * np.pi) + np.linalg.slogdet(model)[1] + c @ np.linalg.inv(model) @ c)
        m = np.linalg.inv(w.T @ w + noise * np.eye(2))
        latent, post = m @ w.T @ c, noise * m
        divergence = 0.5 * (np.trace(post) + latent @ latent - 2 - np.linalg.slogdet(post)[1])
        score = ((c - w @ latent) ** 2).mean() + 2 * divergence
        assert got[i].vae_log_likelihood == pytest.approx(likelihood) and got[i].vae_latent_distance == pytest.approx(np.linalg.norm(latent)) and got[i].vae_score == pytest.approx(score)
    assert len(got) == 40 and got[230].is_anomaly_vae and got[230].vae_log_likelihood == min(r.vae_log_likelihood for r in got.values())


# H1


def hours(n):
    return [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i) for i in range(n)]


def test_spectra_equal_plain_transforms(spark):
    rnd = np.random.default_rng(5)
    series = {k: 10 + 5 * np.sin(2 * np.pi * np.arange(400) / 24) + rnd.normal(size=400) * (1 if k else 9) for k in range(12)}
    series[20], series[21] = np.full(100, 3.0), np.ones(20)
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in zip(hours(len(s)), s)], "k int, t timestamp, x double").repartition(3)
    got = {r.k: r for r in spectra.spectral_scores(df, "k", "t", "x").collect()}
    assert set(got) == set(series) - {21}
    figures = {}
    for k in got:
        s = series[k] - series[k].mean()
        n = len(s)
        psd = np.array([abs(sum(s * np.exp(-2j * np.pi * f * np.arange(n) / n))) ** 2 for f in range(n // 2 + 1)])
        share = psd / (psd.sum() + 1e-15)
        entropy = -(share[share > 0] * np.log2(share[share > 0] + 1e-15)).sum()
        ratio = [share[max(0, (a := int(np.argmin(abs(np.arange(n // 2 + 1) / n - 1 / h)))) - 2) : a + 3].sum() for h in (24, 12)]
        figures[k] = (entropy, *ratio)
        if k != 20:  # a constant series has nothing but rounding in its spectrum
            assert (got[k].spectral_entropy, got[k].diurnal_power_ratio, got[k].harmonic_12h_ratio) == pytest.approx(figures[k], abs=1e-4)
    table = np.array([(r.spectral_entropy, r.diurnal_power_ratio, r.harmonic_12h_ratio) for r in got.values()])
    z = (table - table.mean(0)) / (table.std(0, ddof=1) + 1e-10) * [1, -1, -1]
    want = (np.clip(z, 0, 3) / 3 * [0.5, 0.3, 0.2]).sum(1)
    assert [r.spectral_anomaly_score for r in got.values()] == pytest.approx(want.tolist(), abs=1e-9)
    assert [r.is_anomaly_spectral for r in got.values()] == (want > np.quantile(want, 0.9)).tolist() and got[0].spectral_anomaly_score > got[1].spectral_anomaly_score
    windows = spectra.spectrogram(df.filter("k IN (1, 21)"), "k", "t", "x").orderBy("nth").collect()
    assert [w.starts for w in windows] == hours(400)[0:233:84] and all(np.allclose(w.power, np.abs(np.fft.rfft(v - v.mean())) ** 2) for i, w in enumerate(windows) for v in [series[1][84 * i : 84 * i + 168]])
    assert spectra.spectral_scores(df.limit(0), "k", "t", "x").count() == 0


# H2


def test_shapes_errors_and_clusters(spark):
    rnd = np.random.default_rng(6)
    kinds = [np.exp(-0.5 * ((np.arange(24) - peak) / 2) ** 2) for peak in (7, 13, 20)]
    rows = []
    for k in range(31):
        shape = kinds[0 if k < 15 else 1 if k < 25 else 2]
        for d in range(6):
            day = shape * rnd.uniform(50, 90) + rnd.random(24) + (30 * (np.arange(24) < 6) if k == 30 else 0)
            rows += [(k, t, float(v)) for t, v in zip(hours(24 * 6)[24 * d : 24 * d + 24], day)]
    df = spark.createDataFrame([*rows, (40, hours(1)[0], 0.0)], "k int, t timestamp, x double").repartition(3)
    shapes = spectra.day_shapes(df, "k", "t", "x")
    one = {(r.k, r.date.day): r for r in shapes.collect()}
    assert len(one) == 31 * 6 + 1 and all(v == 0 for v in one[40, 1][2:])
    day = [v for k, t, v in rows if k == 3 and t.day == 2]
    assert list(one[3, 2][2:]) == pytest.approx([v / sum(day) for v in day])
    days = spectra.profile_errors(shapes.filter("k < 40").withColumn("normal", F.col("k") != 30), "k", "normal", 3)
    up = {r.k: r for r in spectra.roll_up(days, "k").collect()}
    assert len(up) == 31 and up[30].is_anomaly_ae and up[30].ae_anomaly_days == 6 == up[30].n_days and up[30].ae_anomaly_score == pytest.approx(1) and up[3].ae_anomaly_ratio <= 0.5
    who, centres = spectra.clusters(spectra.mean_shapes(shapes.filter("k < 30"), "k"), "k")
    of = {r.k: r.cluster_id for r in who.collect()}
    assert [of[k] for k in range(30)] == [0] * 15 + [1] * 10 + [2] * 5  # numbered by size
    assert [(r.cluster_id, r.n, int(np.argmax(r.centre))) for r in centres.orderBy("cluster_id").collect()] == [(0, 15, 7), (1, 10, 13), (2, 5, 20)]
    assert [c.count() for c in spectra.clusters(spectra.mean_shapes(shapes.filter("k < 2"), "k"), "k")] == [2, 1]
    assert [c.count() for c in spectra.clusters(spectra.mean_shapes(shapes.limit(0), "k"), "k")] == [0, 0]


# M15


def plain_gap(a, b):
    grid = np.sort(np.concatenate([a, b]))
    f, g = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    return float((np.abs(f - g)[:-1] * np.diff(grid)).sum())


def test_wasserstein_equals_plain_distances(spark):
    rnd = np.random.default_rng(9)
    series = {f"k{k}": (rnd.random(n) * 10 + k + 5, rnd.random(n) + 1) for k, n in enumerate([30, 30, 14, 9, 6, 3])}
    series["k0"][0][20:] += 15
    series["k1"][0][:4] = series["k1"][0][4]  # ties
    rows = [(k, i, float(x), float(y)) for k, (a, b) in series.items() for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double").repartition(3)
    norm = {k: a / (a.mean() + 1e-10) for k, (a, _) in series.items() if len(a) >= 6}
    pool = np.concatenate(list(norm.values()))
    from aforo.operators import statistics as st

    flat = spark.createDataFrame([(k, float(v)) for k, vs in norm.items() for v in vs], "k string, v double")
    assert {r.k: round(r.distance, 9) for r in st.pooled_gap(flat, "k", "v").collect()} == {k: round(plain_gap(v, pool), 9) for k, v in norm.items()}
    got = {(r.k, r.t): r for r in st.wasserstein_detection(df, "k", "t", "x", ["x", "y"]).collect()}
    assert len(got) == len(rows)
    shift = {k: plain_gap(a[: max(3, int(len(a) * 0.6))], a[max(3, int(len(a) * 0.6)) :]) for k, (a, _) in series.items() if len(a) >= 6}
    cross = {k: plain_gap(v, pool) for k, v in norm.items()}
    sz, cz = ({k: (v - np.mean(list(d.values()))) / (np.std(list(d.values()), ddof=1) + 1e-10) for k, v in d.items()} for d in (shift, cross))
    for k, (a, b) in series.items():
        temporal = [plain_gap(a[i - 12 : i - 6], a[i - 6 : i + 1]) if len(a) >= 13 and i >= 12 else 0.0 for i in range(len(a))]
        multi = [np.mean([plain_gap(v[i - 12 : i - 6], v[i - 6 : i + 1]) / (v[i - 12 : i - 6].std() + 1e-10) for v in (a, b)]) if len(a) >= 13 and i >= 12 else 0.0 for i in range(len(a))]
        z = [(np.array(v) - np.mean(v)) / np.std(v, ddof=1) if np.std(v, ddof=1) > 1e-10 else np.zeros(len(v)) for v in (temporal, multi)]
        for i in range(len(a)):
            r = got[k, i]
            raw = 0.4 * abs(z[0][i]) + 0.25 * abs(sz.get(k, 0)) + 0.2 * abs(cz.get(k, 0)) + 0.15 * abs(z[1][i])
            want = 1 / (1 + np.exp(-0.8 * (raw - 2)))
            assert (r.wd_temporal, r.wd_multivariate, r.wasserstein_score) == pytest.approx((temporal[i], multi[i], want)) and r.is_anomaly_wasserstein == (want > 0.55)
            assert (r.wd_train_test, r.wd_cross_barrio) == pytest.approx((shift.get(k, 0), cross.get(k, 0)), abs=1e-12)
