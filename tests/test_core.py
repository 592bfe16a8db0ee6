"""Core queries against their SQL at the smallest size, and hand-made cases for the neutral branches."""

import datetime
import math

import duckdb
import pytest

from aforo.operators import ensemble, flows, geometry, monthly, networks, statistics
from aforo.plans import registry
from aforo.sources import parsing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())


#: Queries without SQL and the columns that tell their rows apart; what they compute is tested against plain loops elsewhere.
KEYS = {
    "m14_bocpd": ["barrio_key", "fecha"],
    "m14_changepoints": ["barrio_key", "fecha"],
    "e4_mahalanobis_conformal": ["barrio_key", "fecha"],
    "e7_permutation_importance": ["feature"],
    "e8_forest_attribution": ["barrio_key", "fecha"],
    "c1_causal_structure": ["cause", "effect"],
    "c2_causal_effects": ["cause", "effect"],
    "c3_intervention_impact": ["barrio_key", "variable"],
    "h1_spectral_scores": ["contrato"],
    "h1_spectrogram": ["contrato", "nth"],
    "h2_clusters": ["contrato"],
    "h2_profile_errors": ["contrato"],
    "h3_cox_risk": ["contrato"],
    "m13p_probabilistic_pca": ["barrio_key", "fecha"],
    "m17_betweenness": ["id"],
    "m1_isolation_forest": ["contrato", "dia"],
    "m13_pca_autoencoder": ["barrio_key", "fecha"],
    "m16_persistence": ["barrio_key"],
    "h4_bocpd": ["contrato"],
    "h4_peak_thinning": ["sector", "i"],
    "m2_cross_sectional_forest": ["barrio_key", "fecha"],
    "m1m_series_forests": ["barrio_key", "fecha"],
    "m7_interval_forecast": ["barrio_key", "fecha"],
    "e10_ablation": ["model"],
    "h5_household_factors": ["contrato"],
    "st4_threshold_feedback": ["user_id"],
}


#: These grow hundreds of trees; their operators are tested with fewer in test_learned.
SLOW = {"e5_stacking", "m12_meta_score"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_query_without_sql_has_one_row_a_key(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.select(*KEYS[name], *(c for c in df.columns if c not in KEYS[name])).collect()
    assert (rows or name in ("c1_causal_structure", "c2_causal_effects", "c3_intervention_impact")) and len({tuple(r)[: len(KEYS[name])] for r in rows}) == len(rows)


def series(spark, values, key="a__x", start=(2020, 1)):
    rows = []
    for i, v in enumerate(values):
        m = start[1] - 1 + i
        if v is not None:
            rows.append((key, "a", "x", datetime.date(start[0] + m // 12, m % 12 + 1, 1), float(v), 1.0, float(v)))
    return spark.createDataFrame(rows, "barrio_key string, barrio string, uso string, fecha date, consumo double, contratos double, cpc double")


def test_neutral_values_of_a_constant_series(spark):
    df = monthly.persistence(monthly.lags(monthly.trend_3m(monthly.cross_sectional_zscore(monthly.seasonal_zscore(series(spark, [5] * 14))))))
    for r in df.collect():
        assert (r.seasonal_zscore, r.cross_sectional_zscore, r.trend_3m, r.momentum, r.consumption_volatility, r.trend_accel) == (0, 0, 0, 0, 0, 0)


def test_calendar_year_and_row_lags_differ_over_a_gap(spark):
    values = [10, 11, 12, None, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23]
    rows = {r.fecha: r for r in monthly.lags(monthly.yoy_ratio(series(spark, values))).collect()}
    assert rows[datetime.date(2021, 1, 1)].yoy_ratio == 2.2 and rows[datetime.date(2021, 2, 1)].lag_12 == 10


def test_streaks_and_declines(spark):
    rows = sorted(monthly.months_above_mean(series(spark, [1, 9, 9, 1, 9])).collect(), key=lambda r: r.fecha)
    assert [r.months_above_mean for r in rows] == [0, 1, 2, 0, 1]
    rows = sorted(monthly.consumption_drops(series(spark, [9, 8, 7, 6, 5, 4, 3, 2, 5])).collect(), key=lambda r: r.fecha)
    assert [r.consecutive_decline for r in rows] == [0, 1, 2, 3, 4, 5, 6, 6, 0]
    assert monthly.consumption_drops(series(spark, [1, 2])).count() == 0


def test_three_valued_flags(spark):
    df = spark.createDataFrame([(True, None, False), (None, None, None), (True, True, True)], "is_anomaly_a boolean, is_anomaly_b boolean, is_anomaly_c boolean")
    rows = ensemble.consensus(df, df.columns).collect()
    assert [(r.models_detecting, r.n_models_run, r.confidence) for r in rows] == [("a", 2, "HIGH"), ("", 0, "NONE"), ("a;b;c", 3, "HIGH")]


def test_ranks_and_q_values_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (4, None)], "i int, x double")
    r = {x.i: x.r for x in ensemble.rank_normalise(df, "x", "r").collect()}
    assert r == {3: 0.0, 1: 0.5, 2: 0.5, 4: 1.0}
    q = {x.i: round(x.q_value, 6) for x in ensemble.benjamini_hochberg(df.filter("x is not null"), "x").collect()}
    assert q == {3: 0.3, 1: 0.5, 2: 0.5}


def test_distances(spark):
    df = spark.createDataFrame([("k", float(v), s) for v, s in [(0, True), (1, True), (2, False), (3, False)]] + [("one", 1.0, True)], "k string, x double, s boolean")
    got = {r.k: (r.wasserstein, r.ks) for r in statistics.ecdf_gap(df, "k", "x", "s").collect()}
    assert got == {"k": (2.0, 1.0)}


def test_geometry_edges(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(square,), (square + square[:1],), ([(1.0, 1.0)],)], "ring array<struct<x: double, y: double>>")
    rows = df.select(geometry.area(F.col("ring")).alias("a"), geometry.contains(F.col("ring"), F.lit(1.0), F.lit(1.5)).alias("c"), geometry.length(F.col("ring")).alias("l")).collect()
    assert [(r.a, r.c, r.l) for r in rows] == [(16.0, True, 12.0), (16.0, True, 16.0), (0.0, False, 0.0)]


def test_fuzzy_match(spark):
    left = spark.createDataFrame([("San Blas Norte",), ("Unknown",), ("Centro",)], "a string")
    right = spark.createDataFrame([("SAN BLAS",), ("Norte",), ("Centro",)], "b string")
    got = {r.a: r.b for r in networks.fuzzy_match(left, right).collect()}
    assert got["Centro"] == "Centro" and got["Unknown"] is None and got["San Blas Norte"] == "SAN BLAS"


def test_parsers(spark, tmp_path):
    df = spark.createDataFrame([('"29,205,005"', "1111,40", "2.020", "1/12/2024 0:00", "2024 -  01", "12-San Blas "), ("x", "y", None, "32/1/2024 0:00", "", None)], "a string, b string, c string, d string, e string, f string")
    p = parsing
    rows = df.select(p.thousands_comma(F.col("a")), p.decimal_comma(F.col("b")), p.year_with_dot(F.col("c")), p.day_first(F.col("d")), p.period_month(F.col("e")), p.clean_name(F.col("f"))).collect()
    assert tuple(rows[0]) == (29205005.0, 1111.40, 2020, datetime.datetime(2024, 12, 1), datetime.date(2024, 1, 1), "SAN BLAS")
    assert tuple(rows[1]) == (0.0, None, None, None, None, None)
    (tmp_path / "m.csv").write_text('Barrio,Uso,Fecha (aaaa/mm/dd),Consumo (litros),Nº Contratos\n1-A ,DOM,2022/01/31,"29,205,005","4,665"\nB,DOM,bad,x,\n')
    got = p.monthly_csv(spark, f"{tmp_path}/m.csv").collect()
    assert tuple(got[0]) == ("1-A", "DOM", datetime.date(2022, 1, 31), 29205005.0, 4665.0) and got[1].fecha is None and got[1].consumo == 0
    for y in (2023, 2024):
        (tmp_path / f"r_{y}.csv").write_text("periodo,M3 a facturar\n2024 -  01,3\n")
    assert {r.year for r in p.readings_csv(spark, f"{tmp_path}/r_*.csv").collect()} == {2023, 2024} and p.readings_csv(spark, f"{tmp_path}/r_*.csv", 2024).columns == ["PERIODO", "M3 A FACTURAR", "year"]
    (tmp_path / "g.json").write_text('{"features": [{"attributes": {"FID": 1}, "geometry": {"rings": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert p.esri_features(spark, f"{tmp_path}/g.json", "FID: int").collect()[0].FID == 1


def test_household_rules(spark):
    f = spark.createDataFrame([(1, 0.9, 2.0, 0.2, 0.0, 0, 300.0), (2, 0.1, 0.0, 2.0, 0.0, 9, 50.0), (3, 0.1, 0.0, 2.0, 0.0, 0, 50.0)], "contrato int, night_flow_ratio double, nocturnal_baseline double, consumption_cv double, daily_trend_slope double, zero_consumption_days int, mean_daily_L double")
    got = {r.contrato: (r.tipo_sospecha, r.alerta) for r in flows.classify_households(f).collect()}
    assert got == {1: ("fuga_fisica", True), 2: ("contador_roto", True), 3: ("normal", False)}
