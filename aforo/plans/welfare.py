"""Queries on welfare and social alerts. Nations are barrios, customers their meters, account balances stand for age."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import detectors as d
from aforo.operators import ensemble as e
from aforo.operators import monthly as m
from aforo.operators import social as so
from aforo.operators import statistics as st
from aforo.operators import welfare as w
from aforo.operators.audit import elderly_share
from aforo.plans.ensemble import _CONS, EDGES, FLAGS, RESULTS, region_edges, results
from aforo.plans.flows import rounded, rounded_sql
from aforo.plans.monthly import _DROPS
from aforo.sources.adapters import CENSUS, METERS, SPARSE, census, meters, panel, table

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, keys, cols, ctes, body):
    QUERIES[name] = lambda s, sf: rounded(build(s, sf), keys, cols)
    ORACLE_SQL[name] = rounded_sql(ctes, body, keys, cols)


def _behaviour(s, sf):
    house = panel(s, sf, "nation").filter(F.col("uso").ilike("%house%"))
    return w.consumption_behaviour(house.groupBy("barrio", "fecha").agg(F.round(F.sum("consumo"), 2).alias("consumo")))


def _leaks(s, sf):
    return w.leak_risk(w.meter_ages(meters(s, sf), "2008-12-31"), census(s, sf), _behaviour(s, sf), least_meters=10)


_BEHAVIOUR = f"""{SPARSE},
behaviour AS (
  SELECT barrio, avg(coalesce((consumo - prev) / prev < -0.20, false)::INT) AS drop_freq,
    CASE WHEN avg(consumo) > 0 AND count(*) > 1 THEN stddev_samp(consumo) / avg(consumo) END AS consumption_cv
  FROM (SELECT *, lag(consumo) OVER (PARTITION BY barrio ORDER BY fecha) AS prev
        FROM (SELECT barrio, fecha, round(sum(consumo), 2) AS consumo FROM sparse WHERE uso ILIKE '%house%' GROUP BY 1, 2))
  GROUP BY 1)"""
_LEAKS = f"""{_BEHAVIOUR}, {CENSUS}, {METERS},
ages AS (
  SELECT barrio, count(*) AS n_meters, count(*) FILTER (age > 10) AS n_old_meters, avg(age) AS mean_age, avg(coalesce(age > 10, false)::INT) AS pct_old
  FROM (SELECT barrio, date_diff('day', installed, DATE '2008-12-31') / 365.25 AS age FROM meters) GROUP BY 1),
dyn AS (
  SELECT *, CASE WHEN n_meters >= 10 THEN coalesce(drop_freq, 0) ELSE 0 END AS dr, CASE WHEN n_meters >= 10 THEN coalesce(consumption_cv, 0) ELSE 0 END AS cv,
    coalesce(pct_65plus_solos, 0) / 100 AS alone, coalesce(pct_65plus, 0) / 100 AS elderly, n_meters / max(n_meters) OVER () AS size
  FROM ages LEFT JOIN census USING (barrio) LEFT JOIN behaviour USING (barrio)),
ranked AS (
  SELECT *, CASE WHEN dr > 0 AND count(*) OVER rd > 1 THEN (rank() OVER (rd ORDER BY dr) + (count(*) OVER (PARTITION BY dr) - 1) / 2) / count(*) OVER rd ELSE dr END AS drop_freq_norm,
    CASE WHEN cv > 0 AND count(*) OVER rc > 1 THEN (rank() OVER (rc ORDER BY cv) + (count(*) OVER (PARTITION BY cv) - 1) / 2) / count(*) OVER rc ELSE cv END AS cv_norm
  FROM dyn WINDOW rd AS (PARTITION BY dr > 0), rc AS (PARTITION BY cv > 0)),
leaks AS (
  SELECT *, 0.6 * vulnerability_score + 0.4 * consumption_risk_score AS silent_leak_risk, round_even(n_old_meters * alone, 0) AS estimated_at_risk
  FROM (SELECT *, 0.35 * pct_old + 0.35 * alone + 0.2 * elderly + 0.1 * size AS vulnerability_score, 0.4 * drop_freq_norm + 0.3 * cv_norm + 0.3 * pct_old AS consumption_risk_score FROM ranked))"""
_LEAK_COLS = {"n_meters": 0, "n_old_meters": 0, "mean_age": 6, "pct_old": 6, "drop_freq_norm": 6, "cv_norm": 6, "vulnerability_score": 6, "consumption_risk_score": 6, "silent_leak_risk": 6, "estimated_at_risk": 0}
_q("a16_leak_risk", _leaks, ["barrio"], _LEAK_COLS, _LEAKS, "SELECT * FROM leaks")


def _litres(s, sf):
    return panel(s, sf, "nation").withColumn("cpc", F.col("cpc") / 25)


def _elderly(s, sf):
    return w.elderly_vulnerability(_litres(s, sf), census(s, sf).filter("barrio <> 'NATION_0'"))


_ELDERLY = f"""
el0 AS (
  SELECT barrio_key, barrio, count(*) AS n, coalesce(median(c) FILTER (c > 0), 0) AS med, avg(c) AS mu, stddev_pop(c) AS sd, median(contratos) AS k,
    avg(c) FILTER (i <= floor(nn / 2)) AS bf, avg(c) FILTER (i > floor(nn / 2)) AS af
  FROM (SELECT *, cpc / 25 AS c, row_number() OVER (PARTITION BY barrio_key ORDER BY fecha) AS i, count(*) OVER (PARTITION BY barrio_key) AS nn FROM sparse)
  GROUP BY 1, 2),
elderly AS (
  SELECT *, round(0.40 * census + 0.15 * low_consumption + 0.10 * stability + 0.20 * size + 0.15 * decline, 3) AS elderly_vulnerability
  FROM (
    SELECT barrio_key, CASE WHEN pct_65plus > 0 THEN least(pct_65plus / 35, 1) ELSE 0.15 END AS census,
      CASE WHEN med > 0 THEN greatest(least(1 - med / 15000, 1), 0) ELSE 0 END AS low_consumption,
      CASE WHEN n > 6 AND mu > 0 THEN greatest(least(1 - sd / mu / 0.4, 1), 0) ELSE 0.3 END AS stability,
      CASE WHEN k < 50 THEN 1.0 WHEN k < 200 THEN 0.7 WHEN k < 500 THEN 0.3 ELSE 0.1 END AS size,
      CASE WHEN n >= 12 AND bf > 0 AND af < bf THEN least((bf - af) / bf * 3, 1) ELSE 0 END AS decline
    FROM el0 LEFT JOIN (SELECT * FROM census WHERE barrio <> 'NATION_0') USING (barrio)))"""
_ELDERLY_COLS = {"census": 6, "low_consumption": 6, "stability": 6, "size": 6, "decline": 6, "elderly_vulnerability": 3}
_q("a18_elderly_vulnerability", _elderly, ["barrio_key"], _ELDERLY_COLS, f"{SPARSE}, {CENSUS}, {_ELDERLY}", "SELECT * FROM elderly")

_q("a19_elderly_share", lambda s, sf: _elderly(s, sf).withColumn("pct_elderly_estimated", elderly_share(F.col("elderly_vulnerability"))), ["barrio_key"], {"pct_elderly_estimated": 2}, f"{SPARSE}, {CENSUS}, {_ELDERLY}",
   "SELECT *, CASE WHEN elderly_vulnerability >= 0.8 THEN 0.40 WHEN elderly_vulnerability >= 0.6 THEN 0.30 WHEN elderly_vulnerability >= 0.45 THEN 0.22 WHEN elderly_vulnerability >= 0.3 THEN 0.18 ELSE 0.12 END AS pct_elderly_estimated FROM elderly")


def _alerts(s, sf):
    drops = m.consumption_drops(panel(s, sf, "nation"))
    confirming = e.consensus(results(s, sf), FLAGS).select("barrio_key", "fecha", F.col("n_models_detecting").alias("n_confirming"))
    return w.raise_levels(w.welfare_alerts(drops, _elderly(s, sf)), _leaks(s, sf), confirming)


_RULES = (
    ("worst < -0.50 AND v > 0.55", "CRITICO", "severity * v * 2.5"),
    ("worst < -0.40 AND v > 0.70", "CRITICO", "severity * v * 2.0"),
    ("worst < -0.30 AND v > 0.40", "ALTO", "severity * v * 1.8"),
    ("worst < -0.25 AND v > 0.60", "ALTO", "severity * v * 1.5"),
    ("worst < -0.20 AND v > 0.45", "VIGILANCIA", "severity * v * 1.2"),
    ("streak >= 3 AND v > 0.50", "VIGILANCIA", "0.3 + v * 0.4"),
    ("severity > 0.3 AND v > 0.55", "VIGILANCIA", "severity * v"),
)
_ALERTS = f"""{RESULTS}, {_LEAKS[len(SPARSE) + 1 :]}, {_ELDERLY},
dr0 AS ({_DROPS.replace("$p", "sparse")}),
al0 AS (
  SELECT q.*, least(mom_change, hist_change) AS worst, drop_severity AS severity, consecutive_decline AS streak, coalesce(elderly_vulnerability, 0.2) AS v
  FROM dr0 q LEFT JOIN elderly USING (barrio_key)),
al1 AS (
  SELECT *, CASE {" ".join(f"WHEN {c} THEN '{level}'" for c, level, _ in _RULES)} END AS l1, least(CASE {" ".join(f"WHEN {c} THEN {x}" for c, _, x in _RULES)} END, 1) AS confidence
  FROM al0),
al2 AS (
  SELECT a.*, coalesce(silent_leak_risk, 0) AS leak, coalesce(n_models_detecting, 0) AS k, CASE WHEN l1 = 'ALTO' AND silent_leak_risk > 0.3 THEN 'CRITICO' ELSE l1 END AS l2
  FROM al1 a LEFT JOIN leaks ON leaks.barrio = split_part(a.barrio_key, '__', 1) LEFT JOIN (SELECT barrio_key AS bk, fecha AS ff, n_models_detecting FROM ({_CONS})) c ON c.bk = a.barrio_key AND c.ff = a.fecha
  WHERE l1 IS NOT NULL)"""
_ALERT_COLS = {"confidence": 6, "worst": 6, "k": 0}
QUERIES["m19_welfare_alerts"] = lambda s, sf: rounded(
    _alerts(s, sf).withColumnsRenamed({"worst_drop": "worst", "other_models_confirming": "k"}), ["barrio_key", "fecha", "nivel"], _ALERT_COLS
)
ORACLE_SQL["m19_welfare_alerts"] = rounded_sql(
    _ALERTS, "SELECT *, CASE WHEN k >= 3 AND l2 = 'ALTO' THEN 'CRITICO' WHEN k >= 2 AND l2 = 'VIGILANCIA' THEN 'ALTO' ELSE l2 END AS nivel FROM al2", ["barrio_key", "fecha", "nivel"], _ALERT_COLS
)


def _social_results(s, sf):
    return e.spatial_class(e.consensus(results(s, sf), FLAGS), region_edges(s, sf), 2)


def _reclaimed(s, sf):
    p, n = table(s, sf, "supplier"), table(s, sf, "nation")
    return so.reclaimed_ratio(p.join(n, p.s_nationkey == n.n_nationkey).withColumn("x", F.abs("s_acctbal")), "n_name", "x").withColumnRenamed("n_name", "barrio")


def _anr(s, sf):
    l, p, n = (table(s, sf, t) for t in ("lineitem", "supplier", "nation"))
    inj = l.join(p, l.l_suppkey == p.s_suppkey).join(n, p.s_nationkey == n.n_nationkey)
    inj = inj.groupBy(F.col("n_name").alias("barrio"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("fecha")).agg((F.sum("l_quantity") * 20000).alias("injected"))
    billed = panel(s, sf, "nation").groupBy("barrio", "fecha").agg(F.round(F.sum("consumo"), 2).alias("billed"))
    return d.water_balance(inj, billed).select("barrio", F.col("avg_ratio").alias("anr"))


def _vulnerable(s, sf):
    c, n = table(s, sf, "customer"), table(s, sf, "nation")
    g = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("barrio")).agg(F.avg("c_acctbal").alias("bal"))
    return g.select("barrio", st.min_max("bal").alias("vulnerability"))  # a row a barrio


def _factors(s, sf):
    return so.verification_factors(_social_results(s, sf), _reclaimed(s, sf), _anr(s, sf), _vulnerable(s, sf))


_SOCIAL = f"""{RESULTS}, {EDGES}, cons AS ({_CONS}),
cls AS (
  SELECT c.*, CASE WHEN n_models_detecting >= 2 AND coalesce(k, 0) > 0 THEN 'CLUSTER' WHEN n_models_detecting >= 2 THEN 'ISOLATED' ELSE 'NORMAL' END AS spatial_class
  FROM cons c LEFT JOIN (
    SELECT e.barrio AS b2, fecha AS f2, count(*) AS k FROM edges e JOIN (SELECT DISTINCT barrio, fecha FROM cons WHERE n_models_detecting >= 2) x ON x.barrio = neighbour GROUP BY 1, 2
  ) ON b2 = c.barrio AND f2 = c.fecha),
rec AS (SELECT barrio, total / median(total) OVER () AS reclaimed FROM (SELECT n_name AS barrio, sum(abs(s_acctbal)) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)),
inj AS (
  SELECT n_name AS barrio, CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha, sum(l_quantity) * 20000 AS injected
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
an AS (
  SELECT barrio, avg(injected / billed) AS anr FROM inj JOIN (SELECT barrio, fecha, round(sum(consumo), 2) AS billed FROM sparse GROUP BY 1, 2) USING (barrio, fecha) WHERE billed > 0 GROUP BY 1),
vu AS (
  SELECT barrio, (bal - min(bal) OVER ()) / (max(bal) OVER () - min(bal) OVER ()) AS vulnerability
  FROM (SELECT n_name AS barrio, avg(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)),
fa AS (
  SELECT f.*, coalesce(reclaimed, 0) AS reclaimed, coalesce(anr, 0) AS anr, coalesce(vulnerability, 0.5) AS vulnerability FROM (
    SELECT barrio_key, barrio, CASE WHEN winter > 0 AND summer IS NOT NULL THEN summer / winter ELSE 1 END AS summer_winter, cluster_share, cpc_slope, dev_mean, dev_std FROM (
      SELECT barrio_key, barrio, avg(consumo) FILTER (month(fecha) IN (6, 7, 8)) AS summer, avg(consumo) FILTER (month(fecha) IN (12, 1, 2)) AS winter,
        avg((spatial_class = 'CLUSTER')::INT) AS cluster_share, CASE WHEN count(*) > 3 THEN regr_slope(cpc, i) ELSE 0 END AS cpc_slope,
        avg(coalesce(deviation_from_group_trend, 0)) AS dev_mean, stddev_pop(coalesce(deviation_from_group_trend, 0)) AS dev_std
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY barrio_key ORDER BY fecha) AS DOUBLE) AS i FROM cls) GROUP BY 1, 2)) f
  LEFT JOIN rec USING (barrio) LEFT JOIN an USING (barrio) LEFT JOIN vu USING (barrio))"""
_FACTOR_COLS = {"summer_winter": 6, "cluster_share": 6, "cpc_slope": 4, "dev_mean": 6, "dev_std": 6, "reclaimed": 6, "anr": 6, "vulnerability": 6}
_q("a21_verification_factors", _factors, ["barrio_key"], _FACTOR_COLS, _SOCIAL, "SELECT * FROM fa")
_q("a3_reclaimed_ratio", _reclaimed, ["barrio"], {"reclaimed": 6}, _SOCIAL[_SOCIAL.index("rec AS") : _SOCIAL.index(",\ninj AS")], "SELECT * FROM rec")


_ISLAND = "(SELECT barrio_key, g, count(*) AS length, sum(consumo) AS consumo FROM (SELECT *, mm - row_number() OVER (PARTITION BY barrio_key ORDER BY mm) AS g FROM (SELECT *, year(fecha) * 12 + month(fecha) AS mm FROM cls WHERE $w)) GROUP BY 1, 2)"
_SOCIAL_ALERTS = f"""{_SOCIAL},
conf AS (
  SELECT *, greatest(least(50 + CASE WHEN reclaimed > 10 THEN -35 WHEN reclaimed > 5 THEN -25 WHEN reclaimed > 2 THEN -15 ELSE 0 END
    + CASE WHEN summer_winter > 2.5 THEN -30 WHEN summer_winter > 2 THEN -20 WHEN summer_winter > 1.5 THEN -10 ELSE 0 END + CASE WHEN cluster_share > 0.5 THEN -10 ELSE 0 END
    + CASE WHEN anr > 5 THEN 20 WHEN anr > 2 THEN 15 ELSE 0 END + CASE WHEN vulnerability > 0.7 THEN 10 ELSE 0 END + CASE WHEN cpc_slope > 100 THEN 15 WHEN cpc_slope > 50 THEN 10 ELSE 0 END
    + CASE WHEN abs(dev_mean) > 0.15 AND dev_std < abs(dev_mean) THEN 15 WHEN abs(dev_mean) > 0.1 THEN 5 ELSE 0 END, 100), 5) AS confianza FROM fa),
me AS (SELECT barrio_key, avg(consumo) AS mean_consumo, max(n_models_detecting) AS most FROM cls GROUP BY 1),
sp AS (SELECT barrio_key, sum(length) AS months, max(length) AS longest, sum(consumo) AS consumo FROM {_ISLAND.replace("$w", "yoy_ratio > 1.5")} GROUP BY 1),
mm AS (SELECT barrio_key, max(length) AS longest FROM {_ISLAND.replace("$w", "n_models_detecting >= 2")} GROUP BY 1),
fr AS (SELECT barrio_key, count(*) AS months, sum(consumo) AS consumo FROM cls WHERE abs(deviation_from_group_trend) > 0.3 GROUP BY 1)"""
_SOCIAL_BODY = """
SELECT a.*, confianza, confianza >= 60 AS verificada FROM (
  SELECT barrio_key, 'EMERGENCIA_POSIBLE' AS tipo, 1 AS prioridad, months AS meses, consumo * 0.3 AS litros_extra FROM sp WHERE months >= 2 AND longest >= 2
  UNION ALL SELECT barrio_key, 'FUGA_OCULTA', 2, longest, mean_consumo * 0.2 * longest FROM mm JOIN me USING (barrio_key) WHERE longest >= 3
  UNION ALL SELECT barrio_key, 'CONSUMO_VULNERABLE', 3, months, consumo * 0.15 FROM fr JOIN me USING (barrio_key) JOIN fa USING (barrio_key) WHERE vulnerability > 0.6 AND most >= 2 AND months >= 2
) a JOIN conf USING (barrio_key)"""
_SOCIAL_COLS = {"prioridad": 0, "meses": 0, "litros_extra": 4, "confianza": 0, "verificada": 0}
_q("m21_social_alerts", lambda s, sf: so.social_alerts(_social_results(s, sf), _factors(s, sf)), ["barrio_key", "tipo"], _SOCIAL_COLS, _SOCIAL_ALERTS, _SOCIAL_BODY)
