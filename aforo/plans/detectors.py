"""Queries of the further detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.functions import ladders
from aforo.operators import detectors as d
from aforo.operators import monthly as m
from aforo.operators.flows import daily_features
from aforo.plans.ensemble import RESULTS, results
from aforo.plans.flows import rounded, rounded_sql
from aforo.sources.adapters import PANEL, SPARSE, household_hourly, panel, table

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql.replace("SELECT , ", "SELECT ")


def _balance(s, sf):
    l, p, n, r = (table(s, sf, t) for t in ("lineitem", "supplier", "nation", "region"))
    inj = l.join(p, l.l_suppkey == p.s_suppkey).join(n, p.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    inj = inj.groupBy(F.col("r_name").alias("barrio"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("fecha")).agg((F.sum("l_quantity") * 20000).alias("injected"))
    billed = panel(s, sf).groupBy("barrio", "fecha").agg(F.sum("consumo").alias("billed"))
    return rounded(d.water_balance(inj, billed), ["barrio"], {"n": 0, "avg_ratio": 6, "std_ratio": 6, "total_anr_pct": 6, "is_anomaly": 0})


_q("m8_water_balance", _balance, rounded_sql(f"{PANEL}, inj AS (SELECT r_name AS barrio, CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha, sum(l_quantity) * 20000 AS injected FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), bil AS (SELECT barrio, fecha, sum(consumo) AS billed FROM panel GROUP BY 1, 2)",
   "SELECT *, (i - b) / i * 100 AS total_anr_pct, avg_ratio > 2 AS is_anomaly FROM (SELECT barrio, count(*) AS n, avg(injected / billed) AS avg_ratio, stddev_samp(injected / billed) AS std_ratio, sum(injected) AS i, sum(billed) AS b FROM inj JOIN bil USING (barrio, fecha) GROUP BY 1)", ["barrio"], {"n": 0, "avg_ratio": 6, "std_ratio": 6, "total_anr_pct": 6, "is_anomaly": 0}))


def _care(s, sf):
    """Households of people of 65 and more that need care."""
    c = table(s, sf, "customer")
    c = c.withColumns({"score": (F.col("c_acctbal") + 1000) / 11000, "age": 60 + F.pmod("c_custkey", F.lit(35)), "alone": F.pmod("c_custkey", F.lit(3)) == 0})
    levels = c.filter("age >= 65").withColumn("nivel", ladders.care_level(F.col("score"), F.col("age"), F.col("alone"))).filter("nivel <> 'BAJO'")
    return levels.select("c_custkey", "nivel", ladders.severity(-F.col("score")).alias("severity"))


_q("m22_care_level", _care,
   """SELECT * FROM (SELECT c_custkey, CASE WHEN s > 0.7 AND age >= 75 AND al THEN 'CRITICO' WHEN s > 0.5 AND age >= 70 AND al THEN 'ALTO' WHEN s > 0.3 AND age >= 65 THEN 'VIGILANCIA' END AS nivel,
        CASE WHEN -s < -0.5 THEN 'CRITICAL' WHEN -s < -0.3 THEN 'HIGH' WHEN -s < -0.1 THEN 'MEDIUM' ELSE 'NORMAL' END AS severity
      FROM (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS s, 60 + c_custkey % 35 AS age, c_custkey % 3 = 0 AS al FROM customer) WHERE age >= 65) WHERE nivel IS NOT NULL""")


def _benchmark(s, sf):
    ratio, income, age = F.col("c_acctbal") / 4500, 6000 + F.col("c_acctbal") * 1.5, 2025 - (1940 + F.pmod("c_custkey", F.lit(80)))
    return table(s, sf, "customer").select("c_custkey", ladders.benchmark_flag(ratio).alias("anomaly_flag"), ladders.benchmark_type(ratio).alias("anomaly_type"), ladders.income_tier(income).alias("renta_nivel"), ladders.building_risk(age).alias("riesgo"))


_q("m23_benchmark", _benchmark,
   """SELECT c_custkey, r > 1.5 OR r < 0.5 AS anomaly_flag, CASE WHEN r > 2 THEN 'fuga_grave' WHEN r > 1.5 THEN 'fuga_probable' WHEN r < 0.4 THEN 'fraude_probable' WHEN r < 0.6 THEN 'subregistro' ELSE 'normal' END AS anomaly_type,
        CASE WHEN i < 9000 THEN 'muy_baja' WHEN i < 11000 THEN 'baja' WHEN i < 14000 THEN 'media' WHEN i < 18000 THEN 'media_alta' ELSE 'alta' END AS renta_nivel, CASE WHEN a > 60 THEN 'critico' WHEN a > 40 THEN 'alto' WHEN a > 25 THEN 'medio' ELSE 'bajo' END AS riesgo
      FROM (SELECT c_custkey, c_acctbal / 4500 AS r, 6000 + c_acctbal * 1.5::DOUBLE AS i, 2025 - (1940 + c_custkey % 80) AS a FROM customer)""")


def _risk(s, sf):
    g = table(s, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("bal"), F.min("c_acctbal").alias("least"))
    return rounded(d.risk_sum(g, ["n", "bal"], ["least"]), ["c_nationkey"], {"risk": 6})


_q("a14_risk_sum", _risk, rounded_sql("g AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS bal, min(c_acctbal) AS least_ FROM customer GROUP BY 1)", "SELECT *, (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) + (bal - min(bal) OVER ()) / (max(bal) OVER () - min(bal) OVER ()) + 1 - (least_ - min(least_) OVER ()) / (max(least_) OVER () - min(least_) OVER ()) AS risk FROM g", ["c_nationkey"], {"risk": 6}))
_FE = ["cpc", "consumo", "contratos"]
_zc = {c: f"CASE WHEN stddev_samp({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w ELSE 0 END" for c in _FE}
_q("e9_explain", lambda s, sf: d.explain_z(panel(s, sf), _FE, "barrio_key").select("barrio_key", "fecha", "why"),
   f"WITH {PANEL} SELECT barrio_key, fecha, array_to_string(list_transform(list_sort(list_filter([{', '.join(f'''{{'o': -abs(z_{c}), 'f': '{c}', 's': CASE WHEN z_{c} > 0 THEN '+' ELSE '-' END}}''' for c in _FE)}], lambda x: x.o < -1.5))[1:3], lambda x: x.f || x.s), ';') AS why FROM (SELECT *, {', '.join(f'{v} AS z_{c}' for c, v in _zc.items())} FROM panel WINDOW w AS (PARTITION BY barrio_key))")


def _counter(s, sf):
    df = results(s, sf).withColumn("ok", ~(F.col("is_anomaly_cross") | F.col("is_anomaly_yoy"))).select("barrio_key", "fecha", "cpc", "yoy_ratio", "ok")
    return rounded(d.counterfactual(df, ["cpc", "yoy_ratio"], "ok"), ["barrio_key", "fecha", "confidence"], {"change_cpc": 4, "change_yoy_ratio": 6, "n_changes": 0})


_chg = lambda c: f"CASE WHEN {c} < lo_{c} THEN lo_{c} - {c} WHEN {c} > hi_{c} THEN hi_{c} - {c} ELSE 0 END"
_q("e14_counterfactual", _counter, rounded_sql(f"{RESULTS}, b AS (SELECT quantile_cont(cpc, 0.05) AS lo_cpc, quantile_cont(cpc, 0.95) AS hi_cpc, quantile_cont(yoy_ratio, 0.05) AS lo_yoy_ratio, quantile_cont(yoy_ratio, 0.95) AS hi_yoy_ratio FROM results WHERE NOT (is_anomaly_cross OR is_anomaly_yoy))",
   f"SELECT *, CASE n_changes WHEN 0 THEN 'NONE' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM (SELECT *, (change_cpc <> 0)::INT + (change_yoy_ratio <> 0)::INT AS n_changes FROM (SELECT *, {_chg('cpc')} AS change_cpc, {_chg('yoy_ratio')} AS change_yoy_ratio FROM results, b WHERE is_anomaly_cross OR is_anomaly_yoy))", ["barrio_key", "fecha", "confidence"], {"change_cpc": 4, "change_yoy_ratio": 6, "n_changes": 0}))
_q("e15_threshold_feedback", lambda s, sf: rounded(d.adjust_threshold(table(s, sf, "orders").select(F.col("o_custkey").alias("meter"), F.when(F.col("o_orderstatus") == "F", "FALSE_POSITIVE").otherwise("CONFIRMED").alias("label")), "meter"), ["meter"], {"n": 0, "fp": 6, "threshold": 6}),
   rounded_sql("g AS (SELECT o_custkey AS meter, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS fp FROM orders GROUP BY 1)", "SELECT *, CASE WHEN n < 10 THEN -0.1 WHEN fp > 0.5 THEN greatest(-0.1 - 0.05 * (fp - 0.3), -0.5) WHEN fp < 0.2 THEN least(-0.1 + 0.02 * (0.3 - fp), -0.02) ELSE -0.1 END AS threshold FROM g", ["meter"], {"n": 0, "fp": 6, "threshold": 6}))
_q("h3_kaplan_meier", lambda s, sf: rounded(d.kaplan_meier(table(s, sf, "lineitem").join(table(s, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", "o_orderdate", "l_returnflag", "l_linestatus").withColumns({"days": F.datediff("l_shipdate", "o_orderdate"), "e": F.col("l_returnflag") == "R"}), "l_linestatus", "days", "e"), ["l_linestatus", "t"], {"at_risk": 0, "d": 0, "survival": 6}),
   rounded_sql("x AS (SELECT l_linestatus, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS t, l_returnflag = 'R' AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT *, sum(c) OVER (PARTITION BY l_linestatus ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM (SELECT l_linestatus, t, count(*) FILTER (e) AS d, count(*) AS c FROM x GROUP BY 1, 2))",
   "SELECT *, CASE WHEN max((d = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS survival FROM g WINDOW w AS (PARTITION BY l_linestatus ORDER BY t ROWS UNBOUNDED PRECEDING)", ["l_linestatus", "t"], {"at_risk": 0, "d": 0, "survival": 6}))
_q("h6_combined_score", lambda s, sf: rounded(d.combine_scores(results(s, sf).withColumns({"a": F.when(F.col("is_anomaly_dev").isNotNull(), F.least("abs_dev", F.lit(1.0))), "b": F.col("is_anomaly_cross").cast("double"), "c": F.when(F.col("yoy_ratio") != 1, F.least(F.col("yoy_ratio") / 3, F.lit(1.0)))}), {"a": 0.25, "b": 0.2, "c": 0.15}), ["barrio_key", "fecha"], {"combined": 6, "n_techniques": 0}),
   rounded_sql(RESULTS, "SELECT *, (coalesce(a * 0.25, 0) + b * 0.2 + coalesce(c * 0.15, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + 0.2 + CASE WHEN c IS NULL THEN 0 ELSE 0.15 END) AS combined, (a IS NOT NULL)::INT + 1 + (c IS NOT NULL)::INT AS n_techniques FROM (SELECT barrio_key, fecha, CASE WHEN is_anomaly_dev IS NOT NULL THEN least(abs_dev, 1) END AS a, is_anomaly_cross::INT AS b, CASE WHEN yoy_ratio <> 1 THEN least(yoy_ratio / 3, 1) END AS c FROM results)", ["barrio_key", "fecha"], {"combined": 6, "n_techniques": 0}))
_q("c17_purged_folds", lambda s, sf: d.purged_folds(panel(s, sf).select("fecha"), 24, 6, 2, 6),
   f"WITH {PANEL}, mm AS (SELECT fecha, row_number() OVER (ORDER BY fecha) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT fecha FROM panel)) SELECT CAST(f AS INTEGER) AS fold, fecha, CASE WHEN i - f * 6 < 24 THEN 'train' WHEN i - f * 6 < 26 THEN 'gap' ELSE 'test' END AS role FROM mm, (SELECT unnest(generate_series(0, (SELECT (max(n) - 32) // 6 FROM mm))) AS f) WHERE i - f * 6 BETWEEN 0 AND 31")
_CURVE = [0.5] * 6 + [1.5] * 6 + [1.0] * 12
_WEEK = [1.0, 1.0, 1.0, 1.0, 1.1, 1.3, 1.2]
_q("n1_disaggregate", lambda s, sf: rounded(d.disaggregate(panel(s, sf).groupBy(F.col("barrio").alias("key"), "fecha").agg(F.sum("consumo").alias("total")), _CURVE, _WEEK), ["key", "ts"], {"litros": 4}, ties=True),
   rounded_sql(f"{PANEL}, t AS (SELECT barrio AS key, fecha, sum(consumo) AS total FROM panel GROUP BY 1, 2), h AS (SELECT key, fecha, total, unnest(generate_series(fecha::TIMESTAMP, fecha::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM t)", "SELECT key, ts, total * w / sum(w) OVER (PARTITION BY key, fecha) AS litros FROM (SELECT *, CASE WHEN hour(ts) < 6 THEN 0.5::DOUBLE WHEN hour(ts) < 12 THEN 1.5 ELSE 1 END * [1.0::DOUBLE, 1.0, 1.0, 1.0, 1.1, 1.3, 1.2][CAST(isodow(ts) AS INTEGER)] AS w FROM h)", ["key", "ts"], {"litros": 4}, ties=True))
_q("w20_rolling_wasserstein", lambda s, sf: rounded(d.rolling_wasserstein(panel(s, sf), "barrio_key", "fecha", "cpc"), ["barrio_key", "fecha"], {"distance": 4}, ties=True),
   rounded_sql(PANEL, "SELECT barrio_key, fecha, list_sum(list_transform(list_zip(list_sort(a), list_sort(b)), lambda z: abs(z[1] - z[2]))) / 6 AS distance FROM (SELECT *, list(cpc) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS 5 PRECEDING) AS a, list(cpc) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING) AS b FROM panel) WHERE len(b) = 6", ["barrio_key", "fecha"], {"distance": 4}, ties=True))
_q("m6_seasonal_naive", lambda s, sf: rounded(d.seasonal_naive(panel(s, sf)), ["barrio_key", "fecha"], {"forecast": 4, "spread": 4, "is_anomaly": 0}, ties=True),
   rounded_sql(PANEL, "SELECT *, CASE WHEN nb >= 2 THEN spread > 0 AND abs(cpc - forecast) > 2 * spread END AS is_anomaly FROM (SELECT *, quantile_cont(cpc, 0.5) OVER w AS forecast, stddev_pop(cpc) OVER w AS spread, count(cpc) OVER w AS nb FROM panel WINDOW w AS (PARTITION BY barrio_key, month(fecha) ORDER BY fecha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", ["barrio_key", "fecha"], {"forecast": 4, "spread": 4, "is_anomaly": 0}, ties=True))
_q("c8_permutation_p", lambda s, sf: rounded(d.permutation_p(panel(s, sf).groupBy("fecha").agg(F.sum("consumo").alias("a"), F.avg("cpc").alias("b")), "a", "b", "fecha"), [], {"r": 6, "p_value": 6}),
   f"WITH {PANEL}, x AS (SELECT fecha, sum(consumo) AS a, avg(cpc) AS b FROM panel GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fecha) AS i, row_number() OVER (PARTITION BY k ORDER BY md5('s-' || k || '-' || fecha), fecha) AS j FROM x, (SELECT unnest(generate_series(1, 99)) AS k)), c AS (SELECT p.k, corr(p.a, q.b) AS c FROM r p JOIN r q ON p.k = q.k AND p.i = q.j GROUP BY 1) SELECT round((SELECT corr(a, b) FROM x), 6) AS r, round((count(*) FILTER (abs(c) >= abs((SELECT corr(a, b) FROM x))) + 1) / (count(*) + 1), 6) AS p_value FROM c")
_q("m1_isolation_forest", lambda s, sf: d.isolation_forest(daily_features(household_hourly(s, sf), "contrato", "litros"), ["contrato", "dia"], ["total", "night_min", "night_mean", "day_mean", "night_day_ratio", "active_hours"]))
_q("m13_pca_autoencoder", lambda s, sf: d.pca_errors(m.fourier(m.lags(panel(s, sf))), ["barrio_key", "fecha"], ["cpc", "lag_1", "lag_2", "rolling_mean_3", "rolling_std_3", "momentum"], 3))
_q("m16_persistence", lambda s, sf: d.persistence_h0(panel(s, sf), "barrio_key", "fecha", "cpc"))
_q("h4_bocpd", lambda s, sf: d.household_changes(household_hourly(s, sf), "contrato", "ts", "litros"))
_q("m14_changepoints", lambda s, sf: d.changepoints(panel(s, sf), "barrio_key", "fecha", "cpc"))
_q("m14_bocpd", lambda s, sf: d.bocpd(panel(s, sf), "barrio_key", "fecha", "cpc"))
