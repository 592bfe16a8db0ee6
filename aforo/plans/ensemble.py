"""Queries on the frame of detector results."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import ensemble as e
from aforo.operators import monthly as m
from aforo.operators import statistics as st
from aforo.plans.flows import rounded, rounded_sql
from aforo.plans.monthly import _MED, _SEAS
from aforo.sources.adapters import CENSUS, METERS, PANEL, READINGS, SECTOR, SPARSE, census, meters, panel, readings, sector_hourly, table

QUERIES, ORACLE_SQL = {}, {}
FLAGS = ["is_anomaly_cross", "is_anomaly_season", "is_anomaly_dev", "is_anomaly_yoy"]
KEYS = ["barrio_key", "fecha"]


def results(spark, sf_dir):
    """Four detectors on the sparse panel; the deviation detector runs after the training months only."""
    df = m.group_trend_deviation(m.cross_sectional_zscore(m.seasonal_zscore(panel(spark, sf_dir, "nation"))))
    df = m.split_train(df)
    dev, x = F.abs("deviation_from_group_trend"), F.round("yoy_ratio", 6)
    return df.withColumns(
        {
            "is_anomaly_cross": F.abs("cross_sectional_zscore") > 1.5,
            "is_anomaly_season": F.abs("seasonal_zscore") > 1.2,
            "is_anomaly_dev": F.when(~F.col("train"), F.round(dev, 6) > 1),
            "is_anomaly_yoy": (x > 2.5) | (x < 0.4),
            "abs_dev": F.round(dev, 6),
        }
    )


RESULTS = f"""{SPARSE},
season AS ({_SEAS.replace('$p', 'sparse')}),
results AS (
  SELECT d.*, s.seasonal_zscore, coalesce(abs(cz) > 1.5, false) AS is_anomaly_cross, abs(s.seasonal_zscore) > 1.2 AS is_anomaly_season, CASE WHEN NOT train THEN round(abs(deviation_from_group_trend), 6) > 1 END AS is_anomaly_dev,
    round(yoy_ratio, 6) > 2.5 OR round(yoy_ratio, 6) < 0.4 AS is_anomaly_yoy, round(abs(deviation_from_group_trend), 6) AS abs_dev
  FROM (SELECT *, dense_rank() OVER (ORDER BY fecha) <= least(24, floor((SELECT count(DISTINCT fecha) FROM sparse) * 0.7)) AS train,
      CASE WHEN count(*) OVER w > 1 AND stddev_samp(cpc) OVER w > 0 THEN (cpc - avg(cpc) OVER w) / stddev_samp(cpc) OVER w ELSE 0 END AS cz FROM ({_MED.replace('$p', 'sparse')}) WINDOW w AS (PARTITION BY uso, fecha)) d
  JOIN season s ON s.barrio_key = d.barrio_key AND s.fecha = d.fecha)"""
_FIRED = " + ".join(f"coalesce({f}::INT, 0)" for f in FLAGS)
_CONS = f"""SELECT *, CASE WHEN s > 0.30 THEN 'HIGH' WHEN s > 0.10 THEN 'MEDIUM' WHEN s > 0 THEN 'LOW' ELSE 'NONE' END AS confidence, CASE WHEN s >= 0.40 THEN 'ROJO' WHEN s >= 0.25 THEN 'NARANJA' WHEN s >= 0.10 THEN 'AMARILLO' ELSE 'VERDE' END AS alert
  FROM (SELECT *, n_models_detecting / n_models_run AS s FROM (SELECT *, {_FIRED} AS n_models_detecting, 3 + (is_anomaly_dev IS NOT NULL)::INT AS n_models_run, array_to_string(list_filter([{', '.join(f"CASE WHEN {f} THEN '{f.removeprefix('is_anomaly_')}' END" for f in FLAGS)}], lambda x: x IS NOT NULL), ';') AS models_detecting FROM results))"""


def _q(name, build, sql):
    QUERIES[name] = build
    ORACLE_SQL[name] = sql


_q("e2_consensus", lambda s, d: e.consensus(results(s, d), FLAGS).select(*KEYS, "models_detecting", F.col("n_models_detecting").cast("long").alias("n_models_detecting"), "confidence", "alert"),
   f"WITH {RESULTS} SELECT barrio_key, fecha, models_detecting, CAST(n_models_detecting AS BIGINT) AS n_models_detecting, confidence, alert FROM ({_CONS})")
WEIGHTS = {"is_anomaly_cross": 0.10, "is_anomaly_season": 0.05, "is_anomaly_dev": 0.08, "is_anomaly_yoy": -0.01}
_VOTE = "SELECT *, CASE WHEN round(ensemble_score, 9) >= 0.5 THEN 'HIGH' WHEN round(ensemble_score, 9) >= 0.25 THEN 'MEDIUM' WHEN ensemble_score > 0 THEN 'LOW' ELSE 'NONE' END AS ensemble_confidence FROM (SELECT *, coalesce(is_anomaly_cross::INT, 0) * (0.10::DOUBLE / 0.23) + coalesce(is_anomaly_season::INT, 0) * (0.05::DOUBLE / 0.23) + coalesce(is_anomaly_dev::INT, 0) * (0.08::DOUBLE / 0.23) AS ensemble_score FROM results)"
_q("e3_weighted_voting", lambda s, d: rounded(e.weighted_voting(results(s, d), WEIGHTS), [*KEYS, "ensemble_confidence"], {"ensemble_score": 6}), rounded_sql(RESULTS, _VOTE, [*KEYS, "ensemble_confidence"], {"ensemble_score": 6}))
_pairs = [(a, b) for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :]]
_q("e11_flag_jaccard", lambda s, d: rounded(e.flag_jaccard(results(s, d), FLAGS), ["model_a", "model_b"], {"jaccard": 6}),
   f"WITH {RESULTS} " + " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(count(*) FILTER ({a} AND {b}) / count(*) FILTER ({a} OR {b}), 6) AS jaccard FROM results" for a, b in _pairs))
_PSEUDO = """SELECT *, pseudo_score >= (SELECT quantile_cont(pseudo_score, 0.85) FROM p0) AS pseudo_label FROM p0"""
_P0 = f"""{CENSUS}, {METERS},
rr AS (SELECT barrio AS b2, sum(rank_) AS infra FROM (SELECT barrio, pct_65plus, rank() OVER (ORDER BY pct_65plus DESC) AS rank_ FROM census) GROUP BY 1),
rp AS (SELECT barrio AS b3, avg(coalesce(installed >= DATE '1995-07-01', false)::INT) AS replaced FROM meters GROUP BY 1),
ps AS (
  SELECT results.*, coalesce(1 - infra / max(infra) OVER (), 0.5) AS infra_signal, coalesce(abs_dev, 0) AS dv, coalesce(round(replaced, 9), 0) AS rv
  FROM results LEFT JOIN rr ON b2 = barrio LEFT JOIN rp ON b3 = barrio),
p0 AS (
  SELECT *, round(0.35 * infra_signal + 0.35 * (rk - 1) / greatest(max(rk) OVER () - 1, 1) + 0.30 * (rz - 1) / greatest(max(rz) OVER () - 1, 1), 9) AS pseudo_score
  FROM (SELECT *, rank() OVER (ORDER BY dv) + (count(*) OVER (PARTITION BY dv) - 1) / 2 AS rk, rank() OVER (ORDER BY rv) + (count(*) OVER (PARTITION BY rv) - 1) / 2 AS rz FROM ps))"""


def pseudo(s, d):
    """Labels from three signals: a barrio's risk rank (by its elderly), deviation from peers, share of recent meters."""
    ranks = census(s, d).select("barrio", F.rank().over(e.Window.orderBy(F.desc("pct_65plus"))).alias("risk_rank"))  # a row a barrio
    replaced = meters(s, d).groupBy("barrio").agg(F.round(F.avg(F.coalesce(F.col("installed") >= F.lit("1995-07-01").cast("date"), F.lit(False)).cast("int")), 9).alias("replaced"))
    return e.pseudo_labels(results(s, d), ranks, replaced, "abs_dev")


_q("e12_pseudo_labels", lambda s, d: rounded(pseudo(s, d), KEYS, {"pseudo_score": 6, "pseudo_label": 0}), rounded_sql(f"{RESULTS}, {_P0}", _PSEUDO, KEYS, {"pseudo_score": 6, "pseudo_label": 0}))
_q("w19_rank_normalise", lambda s, d: rounded(e.rank_normalise(results(s, d), "abs_dev", "r"), KEYS, {"r": 6}), rounded_sql(RESULTS, "SELECT *, (rk - 1) / greatest(max(rk) OVER () - 1, 1) AS r FROM (SELECT *, rank() OVER (ORDER BY abs_dev) + (count(*) OVER (PARTITION BY abs_dev) - 1) / 2 AS rk FROM results)", KEYS, {"r": 6}))
_q("w18_average_rank", lambda s, d: rounded(e.percent_rank_average(results(s, d), "abs_dev", "uso", "pct_rank"), KEYS, {"pct_rank": 6}),
   rounded_sql(RESULTS, "SELECT *, (rank() OVER (PARTITION BY uso ORDER BY abs_dev) + (count(*) OVER (PARTITION BY uso, abs_dev) - 1) / 2) / count(*) OVER (PARTITION BY uso) AS pct_rank FROM results", KEYS, {"pct_rank": 6}))
_BM = "SELECT *, 2 * precision * recall / (precision + recall) AS f1, (po - pe) / (1 - pe) AS kappa FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM (SELECT count(*)::DOUBLE AS n, (count(*) FILTER (y AND p))::DOUBLE AS tp, (count(*) FILTER (NOT y AND p))::DOUBLE AS fp, (count(*) FILTER (y AND NOT p))::DOUBLE AS fn, (count(*) FILTER (NOT y AND NOT p))::DOUBLE AS tn FROM $s))"
_BMC = {"tp": 0, "fp": 0, "fn": 0, "tn": 0, "precision": 6, "recall": 6, "f1": 6, "kappa": 6}
_q("e13_binary_metrics", lambda s, d: rounded(e.binary_metrics(pseudo(s, d), "pseudo_label", "is_anomaly_yoy"), [], _BMC),
   rounded_sql(f"{RESULTS}, {_P0}, yy AS (SELECT pseudo_label AS y, is_anomaly_yoy AS p FROM ({_PSEUDO}))", _BM.replace("$s", "yy"), [], _BMC).replace("SELECT , ", "SELECT "))
_q("e13_ranking_metrics", lambda s, d: rounded(e.ranking_metrics(pseudo(s, d), "is_anomaly_cross", "pseudo_score"), [], {"auc_roc": 6, "average_precision": 6}),
   f"WITH {RESULTS}, {_P0}, g AS (SELECT pseudo_score AS s, (count(*) FILTER (is_anomaly_cross))::DOUBLE AS p, (count(*) FILTER (NOT is_anomaly_cross))::DOUBLE AS n FROM p0 GROUP BY 1) SELECT round(sum(p * (coalesce(below, 0) + n / 2)) / (sum(p) * sum(n)), 6) AS auc_roc, round(sum(p * tp / al) / sum(p), 6) AS average_precision FROM (SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(p + n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS al FROM g)")
_q("e6_reliability", lambda s, d: rounded(e.reliability(pseudo(s, d), "is_anomaly_cross", "pseudo_score"), ["bin"], {"n": 0, "mean_predicted": 6, "observed": 6, "brier": 6, "ece_part": 6}),
   rounded_sql(f"{RESULTS}, {_P0}", "SELECT *, abs(mean_predicted - observed) * n / sum(n) OVER () AS ece_part FROM (SELECT CAST(least(floor(pseudo_score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(pseudo_score) AS mean_predicted, avg(is_anomaly_cross::INT) AS observed, avg((pseudo_score - is_anomaly_cross::INT) ** 2) AS brier FROM p0 GROUP BY 1)", ["bin"], {"n": 0, "mean_predicted": 6, "observed": 6, "brier": 6, "ece_part": 6}))
_CAL = {"n": 0, "brier": 6, "brier_baseline": 6, "ece": 6, "mce": 6}
_q("e6_calibration", lambda s, d: rounded(e.calibration_summary(e.reliability(pseudo(s, d), "is_anomaly_cross", "pseudo_score")), [], _CAL),
   rounded_sql(f"{RESULTS}, {_P0}", """SELECT sum(n) AS n, sum(b) / sum(n) AS brier, sum(o) / sum(n) * (1 - sum(o) / sum(n)) AS brier_baseline, sum(abs(mp - o / n) * n) / sum(n) AS ece, max(abs(mp - o / n)) AS mce FROM (
      SELECT least(floor(pseudo_score * 10), 9) AS bin, count(*) AS n, avg(pseudo_score) AS mp, sum(is_anomaly_cross::INT) AS o, sum((pseudo_score - is_anomaly_cross::INT) ** 2) AS b FROM p0 GROUP BY 1)""", [], _CAL).replace("SELECT , ", "SELECT "))
_CONF = "SELECT a.*, (SELECT 1) AS one, (k + 1) / (n + 1) AS p_value FROM results a JOIN (SELECT abs_dev AS s, sum(c) OVER (ORDER BY abs_dev DESC ROWS UNBOUNDED PRECEDING) AS k, sum(c) OVER () AS n FROM (SELECT abs_dev, count(*) FILTER (train) AS c FROM results GROUP BY 1)) ON s = abs_dev"
_q("e4_conformal_p", lambda s, d: rounded(e.conformal_p(results(s, d), "abs_dev", "train"), [*KEYS, "stars"], {"p_value": 6}),
   rounded_sql(RESULTS, f"SELECT *, CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END AS stars FROM ({_CONF})", [*KEYS, "stars"], {"p_value": 6}))
_q("c11_benjamini_hochberg", lambda s, d: rounded(e.benjamini_hochberg(e.conformal_p(results(s, d), "abs_dev", "train").groupBy("barrio_key").agg(F.min("p_value").alias("p_value")), "p_value"), ["barrio_key"], {"p_value": 6, "q_value": 6}),
   rounded_sql(RESULTS, f"SELECT *, min(q) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING) AS q_value FROM (SELECT *, least(p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value), 1) AS q FROM (SELECT barrio_key, min(p_value) AS p_value FROM ({_CONF}) GROUP BY 1))", ["barrio_key"], {"p_value": 6, "q_value": 6}))
_KS = {"ks_n": 0, "ks_stat": 6, "ks_pvalue": 6}
_q("e6_ks_uniform", lambda s, d: rounded(e.ks_uniform(e.conformal_p(results(s, d).filter("fecha < '1996-01-01'"), "abs_dev", "is_anomaly_season"), "p_value"), ["verdict"], _KS),
   rounded_sql(RESULTS + ", rs AS (SELECT * FROM results WHERE fecha < DATE '1996-01-01'), k0 AS (SELECT (k + 1) / (n + 1) AS p_value FROM rs JOIN (SELECT abs_dev AS s, sum(c) OVER (ORDER BY abs_dev DESC ROWS UNBOUNDED PRECEDING) AS k, sum(c) OVER () AS n FROM (SELECT abs_dev, count(*) FILTER (is_anomaly_season) AS c FROM rs GROUP BY 1)) ON s = abs_dev), k1 AS (SELECT p_value, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM k0 WHERE p_value < 1), k2 AS (SELECT max(n) AS ks_n, max(greatest(i / n - p_value, p_value - (i - 1) / n)) AS ks_stat FROM k1)",
     "SELECT *, CASE WHEN ks_pvalue >= 0.05 THEN 'BIEN CALIBRADO' WHEN ks_pvalue < 0.05 THEN 'MISCALIBRADO' END AS verdict FROM (SELECT *, CASE WHEN ks_n > 0 THEN least(1, list_sum([2 * (-1) ** (k - 1) * exp(-2 * k * k * ks_n * ks_stat ** 2) for k in range(1, 101)])) END AS ks_pvalue FROM k2)", ["verdict"], _KS))
_q("c11_fisher", lambda s, d: rounded(e.fisher_combined(e.conformal_p(results(s, d), "abs_dev", "train").groupBy("barrio").agg(F.min("p_value").alias("p_value")).filter("p_value > 0.001"), "p_value"), [], {"statistic": 6, "n": 0, "p_value": 9}),
   rounded_sql(f"{RESULTS}, f0 AS (SELECT -2 * sum(ln(p)) AS statistic, count(*) AS n FROM (SELECT barrio, min(p_value) AS p FROM ({_CONF}) GROUP BY 1) WHERE p > 0.001)",
     "SELECT statistic, n, exp(-statistic / 2) * list_sum([(statistic / 2) ** k / factorial(k::INTEGER) for k in range(0, n)]) AS p_value FROM f0", [], {"statistic": 6, "n": 0, "p_value": 9}).replace("SELECT , ", "SELECT "))
_LC = {"share": 2, "k": 0, "precision": 6, "recall": 6, "lift": 6}
_q("a24_lift_curve", lambda s, d: rounded(e.lift_curve(pseudo(s, d), "is_anomaly_yoy", "pseudo_score", KEYS), [], _LC),
   f"WITH {RESULTS}, {_P0}, r AS (SELECT *, row_number() OVER (ORDER BY pseudo_score DESC, barrio_key, fecha) AS rn, count(*) OVER () AS n FROM p0) SELECT round(s, 2) AS share, k::DOUBLE AS k, round(h / k, 6) AS precision, round(h / pos, 6) AS recall, round(h / k / base, 6) AS lift FROM (SELECT s, count(*) FILTER (rn <= greatest(1, floor(n * s))) AS k, count(*) FILTER (rn <= greatest(1, floor(n * s)) AND is_anomaly_yoy) AS h, count(*) FILTER (is_anomaly_yoy) AS pos, avg(is_anomaly_yoy::INT) AS base FROM r, (SELECT unnest([0.01::DOUBLE, 0.05, 0.10, 0.20, 0.50]) AS s) GROUP BY 1)")


def region_edges(spark, sf_dir):
    """Nations of one region are neighbours."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("barrio"), "n_regionkey"), n.select(F.col("n_name").alias("neighbour"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("barrio <> neighbour").select("barrio", "neighbour")


EDGES = "edges AS (SELECT a.n_name AS barrio, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name <> b.n_name)"
_q("m11_spatial_class", lambda s, d: rounded(e.spatial_class(e.consensus(results(s, d), FLAGS), region_edges(s, d), 2), [*KEYS, "spatial_class"], {"n_anomalous_neighbors": 0, "cluster_size": 0}),
   rounded_sql(f"{RESULTS}, {EDGES}, c AS ({_CONS})", "SELECT c.*, CASE WHEN n_models_detecting >= 2 AND coalesce(k, 0) > 0 THEN 'CLUSTER' WHEN n_models_detecting >= 2 THEN 'ISOLATED' ELSE 'NORMAL' END AS spatial_class, CASE WHEN n_models_detecting >= 2 THEN coalesce(k, 0) ELSE 0 END AS n_anomalous_neighbors, CASE WHEN n_models_detecting >= 2 THEN coalesce(k, 0) + 1 ELSE 0 END AS cluster_size FROM c LEFT JOIN (SELECT e.barrio AS b2, fecha AS f2, count(*) AS k FROM edges e JOIN (SELECT DISTINCT barrio, fecha FROM c WHERE n_models_detecting >= 2) x ON x.barrio = neighbour GROUP BY 1, 2) ON b2 = barrio AND f2 = fecha", [*KEYS, "spatial_class"], {"n_anomalous_neighbors": 0, "cluster_size": 0}))
_q("a20_detections_per_model", lambda s, d: results(s, d).select(F.inline(F.array(*(F.struct(F.lit(f).alias("model"), F.col(f).alias("on")) for f in FLAGS)))).groupBy("model").agg(F.count("on").alias("n_run"), F.count_if("on").alias("n_detected"), F.round(F.count_if("on") / F.count("on"), 6).alias("rate")),
   f"WITH {RESULTS} " + " UNION ALL ".join(f"SELECT '{f}' AS model, count({f}) AS n_run, count(*) FILTER ({f}) AS n_detected, round(count(*) FILTER ({f}) / count({f}), 6) AS rate FROM results" for f in FLAGS))
_q("q2_monthly_timeline", lambda s, d: e.consensus(results(s, d), FLAGS).groupBy("fecha").agg(F.count_if(F.col("n_models_detecting") > 0).alias("n_any"), F.count_if(F.col("alert") == "ROJO").alias("n_red")),
   f"WITH {RESULTS} SELECT fecha, count(*) FILTER (n_models_detecting > 0) AS n_any, count(*) FILTER (alert = 'ROJO') AS n_red FROM ({_CONS}) GROUP BY 1")
_q("q1_alert_distribution", lambda s, d: e.consensus(results(s, d), FLAGS).groupBy("alert", "confidence").agg(F.count("*").alias("n")), f"WITH {RESULTS} SELECT alert, confidence, count(*) AS n FROM ({_CONS}) GROUP BY 1, 2")
_q("q3_flag_correlation", lambda s, d: results(s, d).agg(*(F.round(st.correlation(F.coalesce(F.col(a).cast("double"), F.lit(0.0)), F.coalesce(F.col(b).cast("double"), F.lit(0.0))), 6).alias(f"{a[11:]}_{b[11:]}") for a, b in _pairs)),
   f"WITH {RESULTS} SELECT " + ", ".join(f"round(corr(coalesce({a}::INT, 0), coalesce({b}::INT, 0)), 6) AS {a[11:]}_{b[11:]}" for a, b in _pairs) + " FROM results")
_q("q4_top_barrios", lambda s, d: e.consensus(results(s, d), FLAGS).groupBy("barrio").agg(F.sum("n_models_detecting").cast("long").alias("detections"), F.count("*").alias("n")).orderBy(F.desc("detections"), "barrio").limit(10),
   f"WITH {RESULTS} SELECT barrio, CAST(sum(n_models_detecting) AS BIGINT) AS detections, count(*) AS n FROM ({_CONS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_q("w17_alert_runs", lambda s, d: st.runs(e.consensus(results(s, d), FLAGS).withColumn("on", F.col("n_models_detecting") > 0), "barrio_key", "fecha", "on"),
   f"WITH {RESULTS} SELECT barrio_key, min(fecha) AS first, max(fecha) AS last, count(*) AS length FROM (SELECT barrio_key, fecha, m - row_number() OVER (PARTITION BY barrio_key ORDER BY m) AS g FROM (SELECT *, year(fecha) * 12 + month(fecha) AS m FROM ({_CONS}) WHERE n_models_detecting > 0)) GROUP BY barrio_key, g")
_q("c14_model_decay", lambda s, d: results(s, d).groupBy(F.trunc("fecha", "quarter").alias("quarter")).agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))), 6).alias(f"rate_{f[11:]}") for f in FLAGS)),
   f"WITH {RESULTS} SELECT CAST(date_trunc('quarter', fecha) AS DATE) AS quarter, count(*) AS n, {', '.join(f'round(avg(coalesce({f}::INT, 0)), 6) AS rate_{f[11:]}' for f in FLAGS)} FROM results GROUP BY 1")
_DD = {"treated_before": 4, "treated_after": 4, "control_before": 4, "control_after": 4, "effect": 4}
_q("c15_diff_in_diff", lambda s, d: rounded(st.diff_in_diff(panel(s, d, "nation").withColumns({"t": F.col("uso") == "BUILDING", "a": F.col("fecha") >= F.lit("1999-01-01").cast("date")}), "t", "a", "cpc"), [], _DD),
   rounded_sql(SPARSE, "SELECT *, treated_after - treated_before - control_after + control_before AS effect FROM (SELECT avg(cpc) FILTER (uso = 'BUILDING' AND fecha < DATE '1999-01-01') AS treated_before, avg(cpc) FILTER (uso = 'BUILDING' AND fecha >= DATE '1999-01-01') AS treated_after, avg(cpc) FILTER (uso <> 'BUILDING' AND fecha < DATE '1999-01-01') AS control_before, avg(cpc) FILTER (uso <> 'BUILDING' AND fecha >= DATE '1999-01-01') AS control_after FROM sparse)", [], _DD).replace("SELECT , ", "SELECT "))
_q("c13_psi_drift", lambda s, d: rounded(st.psi(panel(s, d, "nation").withColumn("ref", F.col("fecha") < F.lit("1999-01-01").cast("date")), "cpc", "ref"), ["status"], {"psi": 6, "ref_mean": 4, "cur_mean": 4}),
   rounded_sql(f"{SPARSE}, cuts AS (SELECT list_distinct(quantile_cont(cpc, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS cuts FROM sparse WHERE fecha < DATE '1999-01-01')", "SELECT *, CASE WHEN psi < 0.1 THEN 'ESTABLE' WHEN psi < 0.2 THEN 'DRIFT MODERADO' ELSE 'DRIFT ALTO' END AS status FROM (SELECT sum((pc - pr) * ln(pc / pr)) AS psi, sum(sr) / sum(r) AS ref_mean, sum(sc) / sum(c) AS cur_mean FROM (SELECT *, (r + 1) / (sum(r) OVER () + k + 1) AS pr, (c + 1) / (sum(c) OVER () + k + 1) AS pc FROM (SELECT len(list_filter(cuts, lambda x: x <= cpc)) AS bin, count(*) FILTER (fecha < DATE '1999-01-01') AS r, count(*) FILTER (fecha >= DATE '1999-01-01') AS c, coalesce(sum(cpc) FILTER (fecha < DATE '1999-01-01'), 0) AS sr, coalesce(sum(cpc) FILTER (fecha >= DATE '1999-01-01'), 0) AS sc, max(len(cuts)) AS k FROM sparse, cuts GROUP BY 1)))", ["status"], {"psi": 6, "ref_mean": 4, "cur_mean": 4}))
_GAP = "SELECT $k, sum(gap * dx) AS wasserstein, max(gap) AS ks FROM (SELECT *, abs(sum(a) OVER w / na - sum(b) OVER w / nb) AS gap, coalesce(lead(x) OVER o - x, 0) AS dx FROM (SELECT *, sum(a) OVER (PARTITION BY $k) AS na, sum(b) OVER (PARTITION BY $k) AS nb FROM (SELECT $k, $x AS x, count(*) FILTER ($s) AS a, count(*) FILTER (NOT $s) AS b FROM $f GROUP BY 1, 2)) WHERE na > 0 AND nb > 0 WINDOW o AS (PARTITION BY $k ORDER BY x), w AS (PARTITION BY $k ORDER BY x ROWS UNBOUNDED PRECEDING)) GROUP BY 1"


def _gap_sql(k, x, s, f):
    return _GAP.replace("$k", k).replace("$x", x).replace("$s", s).replace("$f", f)


_q("m15_wasserstein_split", lambda s, d: rounded(st.ecdf_gap(m.split_train(panel(s, d, "nation")), "barrio_key", "cpc", "train"), ["barrio_key"], {"wasserstein": 4, "ks": 6}),
   rounded_sql(f"{SPARSE}, tt AS (SELECT *, dense_rank() OVER (ORDER BY fecha) <= least(24, floor((SELECT count(DISTINCT fecha) FROM sparse) * 0.7)) AS train FROM sparse)", _gap_sql("barrio_key", "cpc", "train", "tt"), ["barrio_key"], {"wasserstein": 4, "ks": 6}))
_q("a7_ks_by_periodicity", lambda s, d: rounded(st.ecdf_gap(readings(s, d), "mes", "m3", "trimestral"), ["mes"], {"wasserstein": 6, "ks": 6}), rounded_sql(READINGS, _gap_sql("mes", "m3", "trimestral", "readings"), ["mes"], {"wasserstein": 6, "ks": 6}))
_TE = "WITH $c, b0 AS (SELECT sector AS k, ts AS t, CAST(CASE WHEN hi > lo THEN least(floor((caudal - lo) / (hi - lo) * 10), 9) ELSE 0 END AS INTEGER) AS b FROM (SELECT *, min(caudal) OVER (PARTITION BY sector) AS lo, max(caudal) OVER (PARTITION BY sector) AS hi FROM sector)), s AS (SELECT * FROM (SELECT *, lag(b) OVER (PARTITION BY k ORDER BY t) AS p FROM b0) WHERE p IS NOT NULL), pr AS (SELECT y.k AS dst, x.k AS src, y.b AS y, y.p AS yp, x.p AS xp FROM s y JOIN s x ON x.t = y.t AND x.k <> y.k)" + "".join(f", h{i} AS (SELECT src, dst, -sum(q * ln(q)) AS h{i} FROM (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src, dst) AS q FROM pr GROUP BY src, dst, {c}) GROUP BY 1, 2)" for i, c in ((1, "y, yp"), (2, "yp"), (3, "y, yp, xp"), (4, "yp, xp"))) + " SELECT src, dst, round(greatest(h1 - h2 - h3 + h4, 0), 6) + 0.0 AS te FROM h1 JOIN h2 USING (src, dst) JOIN h3 USING (src, dst) JOIN h4 USING (src, dst)"


def _sector_edges(s, d):
    """Both directions between any two event types (five)."""
    kinds = table(s, d, "events").select("event_type").distinct()
    return kinds.toDF("src").join(kinds.toDF("dst"), F.col("src") != F.col("dst"))


_q("c5_transfer_entropy", lambda s, d: rounded(st.transfer_entropy(sector_hourly(s, d), "sector", "ts", "caudal", _sector_edges(s, d)), ["src", "dst"], {"te": 6}), _TE.replace("$c", SECTOR))


def _moran(s, d):
    n = panel(s, d, "nation").groupBy(F.col("barrio").alias("id")).agg(F.avg("cpc").alias("x"))
    return rounded(st.moran(n, region_edges(s, d).toDF("src", "dst")), [], {"moran_i": 6, "n_edges": 0})


_q("c6_moran", _moran, rounded_sql(f"{SPARSE}, {EDGES}, z AS (SELECT *, sum(z * z) OVER () AS zz FROM (SELECT id, x - avg(x) OVER () AS z, count(*) OVER () AS n FROM (SELECT barrio AS id, avg(cpc) AS x FROM sparse GROUP BY 1)))", "SELECT max(a.n) / count(*) * sum(a.z * b.z) / max(a.zz) AS moran_i, count(*) AS n_edges FROM edges JOIN z a ON a.id = barrio JOIN z b ON b.id = neighbour", [], {"moran_i": 6, "n_edges": 0}).replace("SELECT , ", "SELECT "))


def _spearman(s, d):
    p = panel(s, d).groupBy("fecha").agg(F.round(F.sum("consumo"), 4).alias("a"), F.sum("contratos").alias("b"))
    return p.select(e.average_rank("a").alias("ra"), e.average_rank("b").alias("rb")).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"), F.count("*").alias("n"))


from aforo.sources.adapters import PANEL  # noqa: E402

_q("c8_spearman", _spearman, f"WITH {PANEL}, p AS (SELECT fecha, round(sum(consumo), 4) AS a, sum(contratos) AS b FROM panel GROUP BY 1) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM p)")
_q("w25_change_context", lambda s, d: rounded(st.change_context(panel(s, d), "barrio_key", "fecha", "cpc"), [*KEYS, "direction"], {"mean_before": 4, "mean_after": 4, "magnitude_pct": 4}),
   rounded_sql(PANEL, "SELECT *, CASE WHEN magnitude_pct > 0 THEN 'UP' WHEN magnitude_pct < 0 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM (SELECT *, CASE WHEN mean_before > 0 THEN (mean_after - mean_before) / mean_before * 100 ELSE 0 END AS magnitude_pct FROM (SELECT *, avg(cpc) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_before, avg(cpc) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS mean_after FROM panel))", [*KEYS, "direction"], {"mean_before": 4, "mean_after": 4, "magnitude_pct": 4}))
_PJ = {"n": 0, "trend": 4, "current": 4, "future": 4, "future_total": 2, "recent_rate": 6, "pct_change": 4}
_q("w24_projection", lambda s, d: rounded(st.projection(e.consensus(results(s, d), FLAGS), "barrio_key", "fecha", "cpc", "consumo", "n_models_detecting"), ["barrio_key", "risk"], _PJ),
   rounded_sql(f"{RESULTS}, c AS ({_CONS})", """SELECT *, CASE WHEN pct_change > 10 AND recent_rate >= 2 THEN 'ALTO' WHEN pct_change > 5 OR recent_rate >= 1.5 THEN 'MEDIO' ELSE 'BAJO' END AS risk FROM (
      SELECT *, CASE WHEN current > 0 THEN (future - current) / current * 100 ELSE 0 END AS pct_change FROM (SELECT *, ic + trend * (n + 5) AS future, 6 * jc + sc * (6 * n + 15) AS future_total FROM (
        SELECT barrio_key, count(*) AS n, regr_slope(cpc, i) AS trend, regr_intercept(cpc, i) AS ic, regr_slope(consumo, i) AS sc, regr_intercept(consumo, i) AS jc, avg(cpc) FILTER (i >= nn - 3) AS current, avg(n_models_detecting) FILTER (i >= nn - 3) AS recent_rate
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY barrio_key ORDER BY fecha) - 1 AS DOUBLE) AS i, count(*) OVER (PARTITION BY barrio_key) AS nn FROM c) WHERE nn >= 6 GROUP BY 1)))""", ["barrio_key", "risk"], _PJ))
_q("m14_cusum", lambda s, d: st.cusum(panel(s, d), "barrio_key", "fecha", "cpc"),
   f"""WITH RECURSIVE {PANEL}, z AS (
  SELECT barrio_key, fecha, row_number() OVER (PARTITION BY barrio_key ORDER BY fecha) AS i,
    CASE WHEN stddev_pop(cpc) OVER k > 0 THEN (cpc - avg(cpc) OVER k) / stddev_pop(cpc) OVER k ELSE 0 END AS z FROM panel WINDOW k AS (PARTITION BY barrio_key)
), c(barrio_key, fecha, i, u, d, hit) AS (
  SELECT barrio_key, min(fecha), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false FROM z GROUP BY 1
  UNION ALL
  SELECT barrio_key, fecha, i, CASE WHEN hit THEN 0 ELSE nu END, CASE WHEN hit THEN 0 ELSE nd END, hit FROM (
    SELECT *, nu > 2.0 OR nd > 2.0 AS hit FROM (SELECT z.*, greatest(0, c.u + z.z - 0.5) AS nu, greatest(0, c.d - z.z - 0.5) AS nd FROM c JOIN z ON z.barrio_key = c.barrio_key AND z.i = c.i + 1))
)
SELECT barrio_key, fecha FROM c WHERE hit""")
_q("w13_equal_width_bins", lambda s, d: st.equal_width_bins(table(s, d, "customer"), "c_acctbal", 3, "bin").groupBy("bin").agg(F.count("*").alias("n")),
   "SELECT bin, count(*) AS n FROM (SELECT CAST(least(greatest(ceil((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 3) - 1, 0), 2) AS INTEGER) AS bin FROM customer) GROUP BY 1")
_q("a10_vulnerability", lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") < 0).cast("int")).alias("m"), F.count("*").alias("n"), F.avg((F.col("c_mktsegment") != "HOUSEHOLD").cast("int")).alias("h")).select("c_nationkey", F.round(0.5 * st.min_max("m") + 0.3 * st.min_max("n") + 0.2 * st.min_max("h"), 6).alias("vulnerability")),
   "SELECT c_nationkey, round(0.5 * (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) + 0.3 * (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) + 0.2 * (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS vulnerability FROM (SELECT c_nationkey, avg((c_acctbal < 0)::INT) AS m, count(*) AS n, avg((c_mktsegment <> 'HOUSEHOLD')::INT) AS h FROM customer GROUP BY 1)")


def _inject(s, d):
    x = st.inject(panel(s, d), "barrio_key", "fecha", "cpc", {0: 4.0, 2: 0.0, 4: 0.05, 6: 5.0, 8: 3.0}, 25)
    w = e.Window.partitionBy("barrio_key")
    tr = F.when(F.col("train"), F.col("cpc"))
    x = x.withColumn("flag", F.abs(F.col("cpc") - F.avg(tr).over(w)) > 2 * F.stddev_pop(tr).over(w))
    return rounded(e.binary_metrics(x.filter("NOT train"), "injected", "flag"), [], _BMC)


_q("c18_injection_metrics", _inject, rounded_sql(f"{PANEL}, inj AS (SELECT i < 0 AS train, i IN (0, 2, 4, 6, 8) AS y, barrio_key, cpc * CASE i WHEN 0 THEN 4.0 WHEN 2 THEN 0 WHEN 4 THEN 0.05 WHEN 6 THEN 5 WHEN 8 THEN 3 ELSE 1 END AS cpc FROM (SELECT *, row_number() OVER (PARTITION BY barrio_key ORDER BY fecha) - 26 AS i FROM panel)), yy AS (SELECT y, abs(cpc - mu) > 2 * sg AS p FROM (SELECT *, avg(cpc) FILTER (train) OVER (PARTITION BY barrio_key) AS mu, stddev_pop(cpc) FILTER (train) OVER (PARTITION BY barrio_key) AS sg FROM inj) WHERE NOT train)", _BM.replace("$s", "yy"), [], _BMC).replace("SELECT , ", "SELECT "))
