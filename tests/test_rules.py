"""Levels and ladders on hand-made rows: each expected value follows from the rule's text."""

import datetime
import math

import pytest
from aforo.functions import ladders
from aforo.operators import audit, detectors, ensemble, flows, monthly, networks, ranges, readings, reports, social, statistics, welfare
from pyspark.sql import functions as F


def day(y, m, d=1):
    return datetime.date(y, m, d)


def test_two_model_vote(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, False, False), (5, None, True)], "i int, a boolean, b boolean")
    got = {r.i: r.v for r in df.select("i", ladders.two_model_vote(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM", 4: "NORMAL", 5: "MEDIUM"}
    df = spark.createDataFrame([(True, True, True), (True, False, False), (False, True, True), (False, False, True)], "a boolean, b boolean, y boolean")
    got = {r.mode: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in reports.vote_evaluation(df, "a", "b", "y").collect()}
    assert got == {"or": (2, 1, 1, 2 / 3, 2 / 3), "and": (1, 0, 2, 1.0, 1 / 3)}


def test_care_and_benchmark_levels(spark):
    df = spark.createDataFrame([(0.71, 75, True), (0.71, 74, True), (0.51, 70, False), (0.31, 65, False), (0.3, 90, True), (0.9, 60, True)], "s double, a int, o boolean")
    assert [r.v for r in df.select(ladders.care_level(F.col("s"), F.col("a"), F.col("o")).alias("v")).collect()] == ["CRITICO", "ALTO", "VIGILANCIA", "VIGILANCIA", "BAJO", "BAJO"]
    df = spark.createDataFrame([(x,) for x in (2.1, 2.0, 1.5, 0.6, 0.59, 0.49, 0.39)], "r double")
    rows = df.select(ladders.benchmark_type(F.col("r")).alias("t"), ladders.benchmark_flag(F.col("r")).alias("f")).collect()
    assert [(r.t, r.f) for r in rows] == [("fuga_grave", True), ("fuga_probable", True), ("normal", False), ("normal", False), ("subregistro", False), ("subregistro", True), ("fraude_probable", True)]
    df = spark.createDataFrame([(8999.0, 61), (9000.0, 60), (13999.0, 41), (17999.0, 26), (18000.0, 25)], "i double, a int")
    rows = df.select(ladders.income_tier(F.col("i")).alias("t"), ladders.building_risk(F.col("a")).alias("r")).collect()
    assert [(r.t, r.r) for r in rows] == [("muy_baja", "critico"), ("baja", "alto"), ("media", "alto"), ("media_alta", "medio"), ("alta", "bajo")]


def test_night_silence(spark):
    rows = []
    for d, night, by_day in ((1, 0.0, 10.0), (2, 0.2, 10.0), (3, 0.4, 10.0), (4, 0.9, 10.0), (5, 1.0, 10.0), (6, 1.0, 0.0), (7, None, 10.0), (8, 1.0, None)):
        rows += [("s", datetime.datetime(2024, 1, d, h), v) for h, v in ((3, night), (12, by_day), (0, 99.0), (6, 99.0), (22, 99.0)) if v is not None]
    days = flows.night_silence(spark.createDataFrame(rows, "sector string, ts timestamp_ntz, caudal double"))
    assert {r.dia.day: r.silence for r in days.collect()} == {1: 1.0, 2: 0.85, 3: 0.6, 4: 0.3, 5: 0.0}
    month = flows.silent_months(days).collect()
    assert len(month) == 1 and (month[0].max_silence, month[0].days_silent, month[0].total_days, month[0].pct_days_silent) == (1.0, 3, 4, 0.75)
    assert month[0].avg_silence == pytest.approx((1 + 0.85 + 0.6 + 0.3) / 4)


def test_meter_health(spark):
    rows = [(0.0, 30), (-1.0, 30), (5.0, 14), (5.0, 46), (5.0, 101), (0.1, 30), (120.0, 30), (None, 30)]
    df = spark.createDataFrame([(day(2024, 1), m3, d, None if m3 is None else m3 / d) for m3, d in rows], "mes date, m3 double, dias int, m3_per_day double")
    r = readings.meter_health(df).collect()[0]
    assert (r.n, r.pct_zero, r.pct_very_low, r.pct_high_consumption, r.pct_abnormal_days, r.pct_suspicious) == (8, 1 / 8, 1 / 8, 1 / 8, 2 / 8, 5 / 8)


def test_ks_against_the_months_before(spark):
    values = {1: [1, 2, 3], 2: [1, 2, 3], 3: [4, 5], 4: [4, 4, None]}
    df = spark.createDataFrame([(day(2024, m), None if v is None else float(v)) for m, vs in values.items() for v in vs], "mes date, x double")
    got = {r.mes.month: r.ks for r in readings.ks_before(df, "mes", "x", months=2).collect()}

    def ks(a, b):
        return max(abs(sum(x <= c for x in a) / len(a) - sum(x <= c for x in b) / len(b)) for c in a + b)

    assert got == pytest.approx({1: 0.0, 2: 0.0, 3: ks([4, 5], [1, 2, 3, 1, 2, 3]), 4: ks([4, 4], [1, 2, 3, 4, 5])})


def test_economic_impact(spark):
    df = spark.createDataFrame([("a", 3, 10_000.0), ("a", 2, 30_000.0), ("b", 1, 99_000.0), ("c", 0, 5_000.0)], "barrio_key string, n_models_detecting int, consumo double")
    r = reports.economic_impact(df).collect()[0]
    assert (r.total_barrios, r.barrios_alerta, r.barrios_alta_confianza, r.consumo_anomalo_m3, r.exceso_estimado_m3, r.ahorro_eur, r.coste_inspecciones, r.roi) == pytest.approx((3, 2, 1, 40.0, 6.0, 9.0, 200.0, 0.045))


def test_fraud_rate(spark):
    rows = [(day(2024, 1, 3), "FP"), (day(2024, 1, 9), "XX"), (day(2024, 2, 1), "RB"), (day(2024, 3, 1), "XX"), (day(2024, 4, 1), "XX")]
    got = reports.fraud_rate(spark.createDataFrame(rows, "at date, m string"), "at", "m", {"FP": 1.0, "RB": 1.5, "MR": 0.8}).orderBy("mes").collect()
    assert [(r.n_fraud, r.n_total_changes, r.fraud_weighted, r.fraud_rate) for r in got] == [(1, 2, 1.0, 0.5), (1, 1, 1.5, 1.0), (0, 1, 0.0, 0.0), (0, 1, 0.0, 0.0)]
    assert [r.fraud_rate_3m for r in got] == pytest.approx([0.5, 0.75, 0.5, 1 / 3])


def test_external_adjustment(spark):
    df = spark.createDataFrame([(100.0, 28.0, 80.0, None), (100.0, -30.0, None, 1.5), (100.0, None, 0.0, -1.0)], "cpc double, avg_temp double, tourist_occupancy_pct double, spei_index double")
    rows = monthly.external_adjusted(df).collect()
    assert [r.temp_adjusted_consumption for r in rows] == pytest.approx([100 / 1.3, 200.0, 100.0])
    assert [r.tourism_adjusted_consumption for r in rows] == pytest.approx([100 / 1.16, 100.0, 100.0]) and [r.spei_index for r in rows] == [0.0, 1.5, -1.0]


def test_projection(spark):
    rows = [("up", i, 100.0 + 10 * i, 1000.0, 2) for i in range(12)] + [("flat", i, 100.0, 500.0, 2 * (i > 8)) for i in range(12)] + [("calm", i, 100.0, 500.0, 0) for i in range(6)] + [("short", i, 1.0, 1.0, 3) for i in range(5)]
    got = {r.k: r for r in statistics.projection(spark.createDataFrame(rows, "k string, t int, x double, total double, n int"), "k", "t", "x", "total", "n").collect()}
    assert set(got) == {"up", "flat", "calm"}
    assert got["up"].current == pytest.approx(200) and got["up"].future == pytest.approx(270) and got["up"].pct_change == pytest.approx(35) and got["up"].risk == "ALTO"
    assert got["flat"].risk == "MEDIO" and got["calm"].risk == "BAJO" and got["up"].future_total == pytest.approx(6000)


def test_network_classes(spark):
    nodes = [(0, 10.0, 50.0, 4.0), (1, 9.0, 90.0, 0.0), (2, 0.0, 50.0, 0.0), (3, 9.5, 0.0, 5.0), (4, 0.1, 10.0, 0.0), (5, 0.0, 5.0, 0.0), (6, 0.2, 5.0, 0.0), (7, 0.0, 7.0, 0.0)]
    pipes = [(0, 1, 2.0), (2, 0, 1.0), (3, 4, 1.0), (3, 5, 3.0), (6, 7, 1.0)]
    df = networks.graph_features(spark.createDataFrame(nodes, "id int, score double, elevation double, n_models double"), spark.createDataFrame(pipes, "a int, b int, w double"))
    f = {r.id: r for r in df.collect()}
    assert (f[0].degree, f[0].weighted_degree, f[0].elevation_diff, f[0].neighbour_score, f[0].upstream_score, f[0].downstream_count) == (2, 3.0, 40.0, 4.5, 9.0, 0)
    assert f[0].propagation == pytest.approx(6.0) and f[3].downstream_count == 0 and f[3].upstream_score == pytest.approx(0.05)
    got = {r.id: (r.network_class, r.confidence) for r in networks.network_class(df).collect()}
    t = 9.125  # third quartile of the scores
    assert got[0] == ("PROPAGATION", pytest.approx(min(1, 9 / t * 0.5 + 6 / t * 0.3 + 10 / t * 0.2))) and got[1] == ("NORMAL", 0.0)
    assert got[3][0] == "ISOLATED" and got[3][1] == pytest.approx(min(1, 9.5 / t * 0.5 + (1 - 0.05 / 9.5) * 0.3 + 0.1))
    far = df.filter("id = 3").withColumns({"neighbour_score": F.lit(5.0), "upstream_score": F.lit(0.0), "elevation_diff": F.lit(31.0)}).unionByName(df.filter("id <> 3"))
    assert {r.id: r.network_class for r in networks.network_class(far).collect()}[3] == "PRESSURE"


def test_pseudo_labels(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0), ("d", None)], "barrio string, dev double")
    out = ensemble.pseudo_labels(df, spark.createDataFrame([("a", 4), ("b", 1)], "barrio string, risk_rank int"), spark.createDataFrame([("b", 0.5)], "barrio string, replaced double"), "dev")
    got = {r.barrio: r.pseudo_score for r in out.collect()}
    # risk: 0, .75, .5, .5; deviation ranks 1.5, 3, 4, 1.5 of 4; replacement ranks 2, 4, 2, 2
    assert got == pytest.approx({"a": 0.35 * 0.5 / 3 + 0.3 / 3, "b": 0.35 * 0.75 + 0.35 * 2 / 3 + 0.3, "c": 0.35 * 0.5 + 0.35 + 0.3 / 3, "d": 0.35 * 0.5 + 0.35 * 0.5 / 3 + 0.3 / 3}, abs=1e-8)
    assert [r.barrio for r in out.filter("pseudo_label").collect()] == ["b"]


def test_welfare_alerts(spark):
    rows = [("k1", -0.6, 0.0, 0.5, 0, 0.6), ("k2", -0.45, -0.1, 0.4, 0, 0.75), ("k3", -0.31, 0.0, 0.9, 0, 0.5), ("k4", 0.0, -0.26, 0.2, 0, 0.65), ("k5", -0.21, 0.0, 0.3, 0, 0.46), ("k6", 0.0, 0.0, 0.0, 3, 0.51), ("k7", -0.1, 0.0, 0.31, 0, 0.56), ("k8", -0.9, -0.9, 1.0, 9, 0.2), ("k9", -0.9, 0.0, 1.0, 9, None)]
    drops = spark.createDataFrame([(k, day(2024, 1), m, h, s, c) for k, m, h, s, c, _ in rows], "barrio_key string, fecha date, mom_change double, hist_change double, drop_severity double, consecutive_decline int")
    out = welfare.welfare_alerts(drops, spark.createDataFrame([(r[0], r[5]) for r in rows], "barrio_key string, elderly_vulnerability double"))
    got = {r.barrio_key: (r.nivel, round(r.confidence, 6)) for r in out.collect()}
    assert got == {"k1": ("CRITICO", 0.75), "k2": ("CRITICO", 0.6), "k3": ("ALTO", 0.81), "k4": ("ALTO", 0.195), "k5": ("VIGILANCIA", 0.1656), "k6": ("VIGILANCIA", 0.504), "k7": ("VIGILANCIA", 0.1736)}
    risk = spark.createDataFrame([("k3", 0.31), ("k4", 0.3)], "barrio string, silent_leak_risk double")
    confirm = spark.createDataFrame([("k4", day(2024, 1), 3), ("k5", day(2024, 1), 2), ("k6", day(2024, 2), 9), ("k7", day(2024, 1), 1)], "barrio_key string, fecha date, n_confirming int")
    levels = {r.barrio_key: r.nivel for r in welfare.raise_levels(out, risk, confirm).collect()}
    assert levels == {"k1": "CRITICO", "k2": "CRITICO", "k3": "CRITICO", "k4": "CRITICO", "k5": "ALTO", "k6": "VIGILANCIA", "k7": "VIGILANCIA"}


def test_social_confidence_and_alerts(spark):
    names = "barrio_key string, reclaimed double, summer_winter double, cluster_share double, anr double, vulnerability double, cpc_slope double, dev_mean double, dev_std double"
    rows = [("none", 0.0, 1.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0), ("up", 0.0, 1.0, 0.0, 5.1, 0.71, 101.0, -0.2, 0.1), ("down", 10.1, 2.6, 0.51, 0.0, 0.5, 0.0, 0.0, 0.0), ("mid", 2.1, 1.6, 0.0, 2.1, 0.5, 51.0, 0.11, 0.2)]
    df = spark.createDataFrame(rows, names)
    assert {r.barrio_key: r.c for r in df.select("barrio_key", social.confidence().alias("c")).collect()} == {"none": 50, "up": 100, "down": 5, "mid": 50 - 15 - 10 + 15 + 10 + 5}
    months = [("none", day(2024, m), 100.0, 1.6 if m in (1, 2) else 1.0, 2 if m in (4, 5, 6, 8) else 0, 0.0) for m in range(1, 13)] + [("up", day(2024, m), 10.0, 1.6 if m in (1, 3) else None, 2 if m == 1 else 0, 0.31 if m < 3 else 0.0) for m in range(1, 13)]
    results = spark.createDataFrame(months, "barrio_key string, fecha date, consumo double, yoy_ratio double, n_models_detecting int, deviation_from_group_trend double")
    got = {(r.barrio_key, r.tipo): (r.meses, round(r.litros_extra, 6), r.verificada) for r in social.social_alerts(results, df).collect()}
    assert got == {("none", "EMERGENCIA_POSIBLE"): (2, 60.0, False), ("none", "FUGA_OCULTA"): (3, 60.0, False), ("up", "CONSUMO_VULNERABLE"): (2, 3.0, True)}


def test_infrastructure_risk_of_a_constant_factor(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 2.0), ("b", 3.0, 5.0, 4.0)], "barrio string, h double, c double, l double")
    got = {r.barrio: r.infrastructure_risk_score for r in audit.infrastructure_risk(df, ("h", "c"), ("l", "c")).collect()}
    assert got == {"a": 0 + 0.5 + 1 + 0.5, "b": 1 + 0.5 + 0 + 0.5}


@pytest.mark.parametrize("few", [0, ranges.FEW])
def test_running_sums_over_many_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(ranges, "FEW", few)
    values = [((i * 37) % 101 / 7, i % 5, "ab"[i % 2]) for i in range(101)]
    df = spark.createDataFrame([*values, (None, 3, "a"), (None, 4, "b")], "x double, n int, k string").repartition(5)
    key = lambda v: (v is None, v)
    rows = [*values, (None, 3, "a"), (None, 4, "b")]
    for r in ranges.running_sums(df.filter("x IS NOT NULL OR k = 'a'"), "x", {"n": "s"}, parts=7).collect():
        assert r.s == sum(n for x, n, k in rows if (x is not None or k == "a") and key(x) <= key(r.x))
    for r in ranges.running_sums(df, "x", {"n": "s"}, ["k"], descending=True, parts=5).filter("x IS NOT NULL").collect():
        assert r.s == sum(n for x, n, k in rows if k == r.k and (x is None or x >= r.x))
    for r in ranges.least_from_here(df.filter("x IS NOT NULL"), "x", "n", "m", parts=6).collect():
        assert r.m == min(n for x, n, _ in values if x >= r.x)


def test_lift_curve_breaks_ties_by_key(spark):
    rows = [(i, [5, 5, 5, 3, 3, 3, 3, 1, 1, 0][i] / 10, i in (1, 3, 9)) for i in range(10)]
    got = {r.share: (r.k, r.precision, r.recall) for r in ensemble.lift_curve(spark.createDataFrame(rows, "i int, s double, y boolean"), "y", "s", ["i"], (0.1, 0.2, 0.4, 1.0)).collect()}
    want = {0.1: (1, 0.0, 0.0), 0.2: (2, 0.5, 1 / 3), 0.4: (4, 0.5, 2 / 3), 1.0: (10, 0.3, 1.0)}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_fisher_and_ks(spark):
    r = ensemble.fisher_combined(spark.createDataFrame([(0.05,), (0.05,)], "p double"), "p").collect()[0]
    x = -4 * math.log(0.05)
    assert r.statistic == pytest.approx(x) and r.p_value == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
    ps = [0.001 * (i + 1) for i in range(40)] + [1.0]
    r = ensemble.ks_uniform(spark.createDataFrame([(p,) for p in ps], "p double"), "p").collect()[0]
    assert r.ks_n == 40 and r.ks_stat == pytest.approx(0.96) and r.verdict == "MISCALIBRADO" and r.ks_pvalue < 1e-6
    r = ensemble.ks_uniform(spark.createDataFrame([((i + 0.5) / 40,) for i in range(40)], "p double"), "p").collect()[0]
    assert r.ks_stat == pytest.approx(1 / 80) and r.ks_pvalue == pytest.approx(1.0) and r.verdict == "BIEN CALIBRADO"


def test_small_parsers(spark):
    df = spark.createDataFrame([(" 13 - San Blás (norte) ", 2024, " Marzo "), (None, 2024, "Total")], "n string, y int, m string")
    rows = df.select(audit.plain_name(F.col("n")).alias("n"), audit.spanish_month(F.col("y"), F.col("m")).alias("d")).collect()
    assert [(r.n, r.d) for r in rows] == [("SAN BL S NORTE", day(2024, 3)), ("", None)]
    per = spark.createDataFrame([(1.0, 0.79, 0.9), (1.5, 0.8, 0.5), (2.0, 0.9, 0.5)], "multiplier double, precision double, f1 double")
    assert audit.best_setting(per).collect()[0].multiplier == 1.5 and audit.best_setting(per.filter("precision < 0.8")).collect()[0].tier == 1


def test_assets_and_vulnerability(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    areas = spark.createDataFrame([("p", 0, square)], "poly string, ordinal int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0, "HIDRANTE", 80.0), (2, 2.0, 2.0, "BOCA", 0.0), (3, 3.0, 3.0, "BOMBEO", 1.0), (4, 4.0, 4.0, "DEPOSITO", 500.0), (5, 0.0, 0.0, "BOCA", 9.0), (6, 50.0, 5.0, "BOCA", 9.0)], "pid long, x double, y double, kind string, size double")
    r = audit.assets_per_area(points, areas, 5.0).collect()[0]
    assert (r.n_hydrants, r.n_bocas_riego, r.n_total_riego, r.avg_hydrant_diameter, r.n_pumping_stations, r.deposit_capacity_m3) == (1, 1, 2, 80.0, 1, 500.0)
    panel = spark.createDataFrame([("b__d", "b", day(2023 + i // 12, i % 12 + 1), 6000.0 - 500 * (i >= 6), 40.0) for i in range(12)], "barrio_key string, barrio string, fecha date, cpc double, contratos double")
    r = welfare.elderly_vulnerability(panel, spark.createDataFrame([("b", 17.5)], "barrio string, pct_65plus double")).collect()[0]
    assert (r.census, r.size, r.low_consumption) == (0.5, 1.0, pytest.approx(1 - 5750 / 15000)) and r.decline == pytest.approx(0.25) and r.stability == pytest.approx(1 - 250 / 5750 / 0.4)
    assert r.elderly_vulnerability == round(0.4 * 0.5 + 0.15 * r.low_consumption + 0.1 * r.stability + 0.2 + 0.15 * 0.25, 3)
