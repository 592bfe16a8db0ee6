"""Queries of validation by inference: conformal distances, attribution, causal structure, resampling, rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import attribution, causal, conformal, evidence, flows, learned, networks, resampling, spectra, survival
from aforo.operators import ensemble as e
from aforo.operators import monthly as m
from aforo.operators import statistics as st
from aforo.operators.ranges import written
from aforo.plans.ensemble import _CONF, _CONS, _P0, _VOTE, FLAGS, KEYS, RESULTS, WEIGHTS, pseudo, results
from aforo.plans.flows import _DAILY, rounded, rounded_sql
from aforo.plans.learned import FEATURES, monthly_features
from aforo.plans.monthly import _YOY
from aforo.plans.spatial import _edges
from aforo.sources.adapters import CENSUS, HOUSEHOLD, METERS, PANEL, census, household_hourly, meters, panel, table

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def scored(s, sf):
    """Detector results with votes, pseudo score and p-value."""
    df = e.weighted_voting(e.consensus(pseudo(s, sf), FLAGS), WEIGHTS)
    return e.conformal_p(df, "abs_dev", "train")


_q("e4_mahalanobis_conformal", lambda s, sf: conformal.expanding_conformal(monthly_features(s, sf), KEYS, "fecha", FEATURES))
_q("e8_forest_attribution", lambda s, sf: attribution.explain_forest(monthly_features(s, sf), KEYS, FEATURES))
_q("e7_permutation_importance", lambda s, sf: attribution.permutation_importance(monthly_features(s, sf), KEYS, FEATURES))


def causal_units(s, sf):
    """A row a barrio and use: the seven variables of the causal graph."""
    df = e.weighted_voting(e.consensus(results(s, sf), FLAGS), WEIGHTS)
    o, c, n, l = (table(s, sf, t) for t in ("orders", "customer", "nation", "lineitem"))
    homes = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("barrio"))
    density = homes.groupBy("barrio").agg(F.count("*").cast("double").alias("population_density"))
    sold = l.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("supplied"))
    balance = o.join(sold, o.o_orderkey == sold.l_orderkey).join(homes, o.o_custkey == homes.c_custkey).groupBy("barrio").agg((F.sum("supplied") / F.sum("o_totalprice")).alias("anr_ratio"))
    old = census(s, sf).select("barrio", F.col("pct_65plus").alias("pct_elderly_65plus"))
    own = df.groupBy("barrio", "barrio_key").agg(
        F.avg("cpc").alias("consumption_per_contract"), F.avg("deviation_from_group_trend").alias("deviation_from_group_trend"), F.avg("ensemble_score").alias("anomaly_score"), F.avg("n_models_detecting").alias("n_models_detecting")
    )
    return own.join(old, "barrio", "left").join(density, "barrio", "left").join(balance, "barrio", "left")


def causes(s, sf):
    return causal.causal_effects(written(causal_units(s, sf)), list(causal.ORDER))


def impact(s, sf):
    units = written(causal_units(s, sf))
    return causal.intervention_impact(units, "barrio_key", causal.causal_effects(units, list(causal.ORDER)))


_q("c1_causal_structure", lambda s, sf: causes(s, sf).select("cause", "effect", "correlation", "edge_p_value"))
_q("c2_causal_effects", causes)
_q("c3_intervention_impact", impact)

_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_NULL = {"observed_top": 6, "observed_spread": 6, "null_mean": 6, "null_std": 6, "p_value": 6, "p_spread": 6, "z_score": 4}
_q("c7_null_labels", lambda s, sf: rounded(resampling.null_label_test(e.weighted_voting(results(s, sf), WEIGHTS).withColumn("fecha", F.col("fecha").cast("string")), KEYS, "barrio", "ensemble_score"), [], _NULL),
   rounded_sql(f"""{RESULTS}, rows AS (SELECT barrio, barrio_key || '-' || CAST(fecha AS VARCHAR) AS k, ensemble_score AS s FROM ({_VOTE})),
counts AS (SELECT barrio, count(*) AS c, avg(s) AS m FROM rows GROUP BY 1), upto AS (SELECT barrio, sum(c) OVER (ORDER BY barrio) - c AS low, sum(c) OVER (ORDER BY barrio) AS high FROM counts),
places AS (SELECT r AS round, s, {_DRAW.format("'null-' || r || '-' || k")} % (SELECT count(*) FROM rows) AS place FROM rows, range(1, 1001) t(r)),
drawn AS (SELECT round, barrio, avg(s) AS m FROM places JOIN upto ON place >= low AND place < high GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY m DESC, barrio) AS hi, row_number() OVER (PARTITION BY round ORDER BY m, barrio) AS lo FROM drawn),
sims AS (SELECT round, avg(m) FILTER (hi <= 5) AS t, avg(m) FILTER (hi <= 5) - avg(m) FILTER (lo <= 5) AS d FROM ranked GROUP BY 1),
real AS (SELECT avg(m) FILTER (hi <= 5) AS observed_top, avg(m) FILTER (hi <= 5) - avg(m) FILTER (lo <= 5) AS observed_spread FROM (
  SELECT m, row_number() OVER (ORDER BY m DESC, barrio) AS hi, row_number() OVER (ORDER BY m, barrio) AS lo FROM counts)),
test AS (SELECT any_value(observed_top) AS observed_top, any_value(observed_spread) AS observed_spread, avg(t) AS null_mean, stddev_pop(t) AS null_std,
  (count(*) FILTER (round(t, 9) >= round(observed_top, 9)) + 1) / (count(*) + 1) AS p_value, (count(*) FILTER (round(d, 9) >= round(observed_spread, 9)) + 1) / (count(*) + 1) AS p_spread FROM sims, real)""",
     "SELECT *, CASE WHEN null_std > 0 THEN (observed_top - null_mean) / null_std ELSE 0 END AS z_score FROM test", [], _NULL).replace("SELECT , ", "SELECT "))

_MONTHLY = f"""{RESULTS}, {_P0},
per AS (SELECT v.barrio AS unit, CAST(v.fecha AS VARCHAR) AS month, count(*) AS n, sum(v.ensemble_score) AS e, sum(q.pseudo_score) AS s, count(*) FILTER (f.p_value < 0.05) AS sig, sum(c.n_models_detecting) AS m
  FROM ({_VOTE}) v JOIN p0 q USING (barrio_key, fecha) JOIN ({_CONF}) f USING (barrio_key, fecha) JOIN ({_CONS}) c USING (barrio_key, fecha) GROUP BY 1, 2),
months AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM per)),
slots AS (SELECT r AS round, {_DRAW.format("'boot-' || r || '-' || k")} % n AS i FROM range(1, 501) t(r), (SELECT i + 1 AS k, n FROM months)),
weights AS (SELECT round, month, count(*) AS w FROM slots JOIN months USING (i) GROUP BY 1, 2),
g AS (SELECT round, unit, round(sum(w * e) / sum(w * n), 9) AS e, round(sum(w * s) / sum(w * n), 9) AS s, sum(sig) AS sig, round(sum(w * m) / sum(w * n), 9) AS m FROM per JOIN weights USING (month) GROUP BY 1, 2),
limits AS (SELECT round, round(quantile_cont(e, 0.75), 9) AS e75, round(quantile_cont(s, 0.75), 9) AS s75 FROM g GROUP BY 1),
core AS (SELECT round, unit FROM g JOIN limits USING (round) WHERE e >= e75 AND s >= s75 AND sig > 0 AND m >= 0.5)"""


def boot(s, sf):
    df = scored(s, sf).withColumn("month", F.col("fecha").cast("string"))
    return resampling.bootstrap_core(df, "barrio", "month", "ensemble_score", "pseudo_score", "p_value", "n_models_detecting", 0.5)


_q("c7_bootstrap_core", lambda s, sf: rounded(boot(s, sf)[0], ["unit", "ultra_stable"], {"frequency": 6}),
   rounded_sql(_MONTHLY, "SELECT unit, count(*) / 500 AS frequency, count(*) / 500 >= 0.8 AS ultra_stable FROM core GROUP BY 1", ["unit", "ultra_stable"], {"frequency": 6}))
_SIZES = {"core_size_median": 2, "core_size_least": 0, "core_size_greatest": 0, "rounds": 0}
_q("c7_core_sizes", lambda s, sf: rounded(boot(s, sf)[1], [], _SIZES),
   rounded_sql(_MONTHLY + ", sizes AS (SELECT round, count(c.unit) AS size FROM limits LEFT JOIN core c USING (round) GROUP BY 1)",
     "SELECT median(size) AS core_size_median, min(size) AS core_size_least, max(size) AS core_size_greatest, count(*) AS rounds FROM sizes", [], _SIZES).replace("SELECT , ", "SELECT "))


def contracts(s, sf):
    """A row a customer: days from the first order of all to the customer's first large returned line (else to the end), whether there is one, covariates."""
    o, c, l = (table(s, sf, t) for t in ("orders", "customer", "lineitem"))
    ends = o.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    bad = l.filter("l_returnflag = 'R' AND l_quantity >= 48 AND l_discount >= 0.08").join(o, l.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.min("l_shipdate").alias("leak"))
    own = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("building_m2"), (F.avg("o_totalprice") / 10000).alias("pipe_risk_score"))
    rows = c.join(bad, c.c_custkey == bad.o_custkey, "left").join(own, c.c_custkey == own.k, "left").crossJoin(F.broadcast(ends))  # one row
    days = F.datediff(F.coalesce("leak", "last"), "first").cast("double")
    return rows.select(
        F.col("c_custkey").alias("contrato"), F.greatest(days, F.lit(0.5)).alias("duration_days"), F.col("leak").isNotNull().alias("event"), (F.col("c_acctbal") / 1000).alias("building_age_decades"), "building_m2", "pipe_risk_score",
        (F.pmod("c_custkey", F.lit(60)) + 25).cast("double").alias("edad_titular"),
    )


COVARIATES = ["building_age_decades", "building_m2", "pipe_risk_score", "edad_titular"]
_q("h3_cox_risk", lambda s, sf: survival.cox_risk(contracts(s, sf), "contrato", "duration_days", "event", COVARIATES))


def network(s, sf):
    pipes = _edges(s, sf).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w")).filter("(a * 7 + b * 3) % 5 = 0")
    return table(s, sf, "nation").select(F.col("n_nationkey").alias("id")), pipes


_q("m17_betweenness", lambda s, sf: networks.betweenness(*network(s, sf)))
_q("m13p_probabilistic_pca", lambda s, sf: learned.probabilistic_pca(monthly_features(s, sf), KEYS, FEATURES, 4))
_q("h1_spectral_scores", lambda s, sf: spectra.spectral_scores(household_hourly(s, sf), "contrato", "ts", "litros"))
_q("h1_spectrogram", lambda s, sf: spectra.spectrogram(household_hourly(s, sf), "contrato", "ts", "litros"))


def days(s, sf):
    """Day shapes of households; every twenty-fifth contract has a known leak."""
    return spectra.day_shapes(household_hourly(s, sf), "contrato", "ts", "litros").withColumn("normal", F.col("contrato") % 25 != 0)


_q("h2_day_shapes", lambda s, sf: rounded(spectra.mean_shapes(days(s, sf), "contrato"), ["contrato"], {f"h{h}": 6 for h in range(24)}),
   rounded_sql(f"""{HOUSEHOLD}, sums AS (SELECT contrato, CAST(ts AS DATE) AS d, {', '.join(f"coalesce(sum(litros) FILTER (hour(ts) = {h}), 0) AS s{h}" for h in range(24))}, sum(litros) + 1e-10 AS total FROM household GROUP BY 1, 2),
m AS (SELECT contrato, {', '.join(f'avg(s{h} / total) AS m{h}' for h in range(24))}, {' + '.join(f'avg(s{h} / total)' for h in range(24))} + 1e-10 AS total FROM sums GROUP BY 1)""",
     f"SELECT contrato, {', '.join(f'm{h} / total AS h{h}' for h in range(24))} FROM m", ["contrato"], {f"h{h}": 6 for h in range(24)}))
_q("h2_profile_errors", lambda s, sf: spectra.roll_up(spectra.profile_errors(days(s, sf), "contrato", "normal"), "contrato"))
_q("h2_clusters", lambda s, sf: spectra.clusters(spectra.mean_shapes(days(s, sf), "contrato"), "contrato")[0])
_ROLL = {"ae_median_error": 6, "ae_max_error": 6, "ae_anomaly_days": 0, "n_days": 0, "ae_anomaly_ratio": 6, "ae_anomaly_score": 6, "is_anomaly_ae": 0}
_q("a28_profile_roll_up",
   lambda s, sf: rounded(spectra.roll_up(flows.daily_features(household_hourly(s, sf), "contrato", "litros").withColumns({"err": F.abs(F.round(F.col("night_day_ratio") - 1, 6)), "odd": F.col("night_day_ratio") > 1.5}), "contrato", "err", "odd"), ["contrato"], _ROLL),
   rounded_sql(f"""{HOUSEHOLD}, dd AS ({_DAILY}), g AS (SELECT contrato, median(abs(round(night_day_ratio - 1, 6))) AS ae_median_error, max(abs(round(night_day_ratio - 1, 6))) AS ae_max_error,
  count(*) FILTER (night_day_ratio > 1.5) AS ae_anomaly_days, count(*) AS n_days FROM dd GROUP BY 1), sc AS (SELECT *, ae_median_error / (max(ae_median_error) OVER () + 1e-10) AS ae_anomaly_score FROM g)""",
     "SELECT *, ae_anomaly_days / n_days AS ae_anomaly_ratio, ae_anomaly_score > quantile_cont(ae_anomaly_score, 0.90) OVER () AS is_anomaly_ae FROM sc", ["contrato"], _ROLL))

RATES = ["m_cross", "m_season", "m_dev", "m_yoy"]


def rates(s, sf):
    """Share of months in which each detector fires, a row a barrio and use."""
    return results(s, sf).groupBy("barrio_key").agg(*(F.avg(F.coalesce(F.col(f"is_anomaly_{m[2:]}").cast("int"), F.lit(0))).alias(m) for m in RATES))


_RATES = f"{RESULTS}, rates AS (SELECT barrio_key, {', '.join(f'avg(coalesce(is_anomaly_{m[2:]}::INT, 0)) AS {m}' for m in RATES)} FROM results GROUP BY 1)"
_TAIL = """CASE WHEN {z} = 0 THEN 1 WHEN abs({z}) > 9 THEN 0 ELSE greatest(0, 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 250),
  lambda n: exp((2 * n + 1) * ln(abs({z})) - {z} * {z} / 2 - (lgamma(n + 1.5) + (n + 1) * ln(2) - 0.5 * ln(pi())))))) END"""
_FR = {"statistic": 6, "p_value": 6, "n": 0}
_CHI = f"({_TAIL.format(z='sqrt(statistic)')} + exp(-statistic / 2) * sqrt(statistic / 2) / gamma(1.5))"
_q("c17_friedman", lambda s, sf: rounded(evidence.friedman(rates(s, sf), "barrio_key", RATES), [], _FR),
   rounded_sql(f"""{_RATES}, long AS (UNPIVOT rates ON {', '.join(RATES)} INTO NAME model VALUE v),
ranked AS (SELECT *, rank() OVER (PARTITION BY barrio_key ORDER BY v) + (count(*) OVER (PARTITION BY barrio_key, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY barrio_key, v) AS same FROM long),
sums AS (SELECT model, sum(r) AS r, sum(same * same - 1) AS ties, count(*) AS n FROM ranked GROUP BY 1),
fr AS (SELECT any_value(n) AS n, (12 * sum(r * r) / (any_value(n) * 4 * 5) - 3 * any_value(n) * 5) / (1 - sum(ties) / (any_value(n) * 4 * 15)) AS statistic FROM sums)""",
     f"SELECT *, {_CHI} AS p_value FROM fr", [], _FR).replace("SELECT , ", "SELECT "))
_PAIRS = [(a, b) for i, a in enumerate(RATES) for b in RATES[i + 1 :]]
_WX = {"statistic": 6, "p_value": 6, "n": 0}
_q("c17_wilcoxon", lambda s, sf: rounded(evidence.wilcoxon(rates(s, sf), "barrio_key", RATES), ["model_a", "model_b", "better"], _WX),
   rounded_sql(f"""{_RATES}, d AS ({' UNION ALL '.join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, round({a} - {b}, 12) AS d FROM rates" for a, b in _PAIRS)}),
rk AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY model_a, model_b, abs(d)) AS same FROM d WHERE d <> 0),
ws AS (SELECT model_a, model_b, coalesce(sum(r) FILTER (d > 0), 0) AS w, count(*) AS n, sum(same * same - 1) AS t FROM rk GROUP BY 1, 2),
wz AS (SELECT *, least(w, n * (n + 1) / 2 - w) AS statistic FROM ws), wt AS (SELECT *, (statistic - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM wz),
sd AS (SELECT model, stddev_pop(v) AS s FROM (UNPIVOT rates ON {', '.join(RATES)} INTO NAME model VALUE v) GROUP BY 1),
wp AS (SELECT *, {_TAIL.format(z='z')} AS p_value FROM wt)""",
     "SELECT wp.*, CASE WHEN p_value < 0.05 THEN CASE WHEN a.s < b.s THEN model_a ELSE model_b END END AS better FROM wp JOIN sd a ON a.model = model_a JOIN sd b ON b.model = model_b", ["model_a", "model_b", "better"], _WX))
_ST = {"mean_score": 6, "std_score": 6, "cv": 6}
_q("q11_model_stability", lambda s, sf: rounded(evidence.model_stability(rates(s, sf), RATES), ["model", "verdict"], _ST),
   rounded_sql(f"{_RATES}, st AS (SELECT model, avg(v) AS mean_score, stddev_pop(v) AS std_score FROM (UNPIVOT rates ON {', '.join(RATES)} INTO NAME model VALUE v) GROUP BY 1)",
     "SELECT *, CASE WHEN cv < 0.5 THEN 'ESTABLE' WHEN cv < 1.0 THEN 'VARIABLE' ELSE 'INESTABLE' END AS verdict FROM (SELECT *, CASE WHEN mean_score > 0 THEN std_score / mean_score END AS cv FROM st)", ["model", "verdict"], _ST))

PROBLEMATIC = ("R",)  # return flags stand for reasons of a change


def changes(s, sf):
    """Meter changes: a row a line item, its month and reason."""
    return table(s, sf, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.col("l_returnflag").alias("reason"))


def truth(s, sf):
    return evidence.meter_risk(meters(s, sf).withColumn("smart", F.col("uso").isin("BUILDING", "MACHINERY")), "2008-12-31")


def detections(s, sf):
    df = e.weighted_voting(e.consensus(results(s, sf), FLAGS), WEIGHTS)
    return df.select("barrio", F.col("fecha").alias("month"), F.col("ensemble_score").alias("score"), F.col("n_models_detecting").alias("n_models"), "alert")


_CH = "changes AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS problematic FROM lineitem GROUP BY 1)"
_q("src16_problematic_rate", lambda s, sf: rounded(evidence.problematic_rate(changes(s, sf), "month", "reason", PROBLEMATIC), ["month"], {"total": 0, "problematic": 0, "rate": 6, "nth": 0}),
   rounded_sql(_CH, "SELECT *, problematic / total AS rate, row_number() OVER (ORDER BY month) - 1 AS nth FROM changes", ["month"], {"total": 0, "problematic": 0, "rate": 6, "nth": 0}))
_q("src16_rate_trend", lambda s, sf: rounded(evidence.rate_trend(evidence.problematic_rate(changes(s, sf), "month", "reason", PROBLEMATIC)), [], {"trend_slope": 9, "months": 0}),
   rounded_sql(_CH, "SELECT regr_slope(problematic / total, nth) AS trend_slope, count(*) AS months FROM (SELECT *, row_number() OVER (ORDER BY month) - 1 AS nth FROM changes)", [], {"trend_slope": 9, "months": 0}).replace("SELECT , ", "SELECT "))
_RISK = f"""{METERS}, ages AS (SELECT barrio, date_diff('day', installed, DATE '2008-12-31') / 365.25 AS age, uso IN ('BUILDING', 'MACHINERY') AS smart FROM meters),
stats AS (SELECT barrio, count(*) AS total_counters, 100 * count(*) FILTER (smart) / count(*) AS smart_pct, avg(age) AS mean_age_years, median(age) AS median_age_years, max(age) AS max_age_years FROM ages GROUP BY 1),
risk AS (SELECT *, 100 - smart_pct AS manual_pct, (rank() OVER (ORDER BY mean_age_years DESC) + (count(*) OVER (PARTITION BY mean_age_years) - 1) / 2
  + rank() OVER (ORDER BY 100 - smart_pct DESC) + (count(*) OVER (PARTITION BY smart_pct) - 1) / 2) / 2 AS risk_score FROM stats)"""
_MR = {"total_counters": 0, "smart_pct": 6, "manual_pct": 6, "mean_age_years": 6, "median_age_years": 6, "max_age_years": 6, "risk_score": 6}
_q("src16_meter_risk", lambda s, sf: rounded(truth(s, sf), ["barrio"], _MR), rounded_sql(_RISK, "SELECT * FROM risk", ["barrio"], _MR))
_DET = f"{RESULTS}, det AS (SELECT v.barrio, v.fecha AS month, v.ensemble_score AS score, c.n_models_detecting AS n_models, c.alert FROM ({_VOTE}) v JOIN ({_CONS}) c USING (barrio_key, fecha))"
_VAL = f"""{_DET}, {_RISK}, val AS (SELECT barrio, avg(score) AS mean_anomaly_score, max(score) AS max_anomaly_score, avg(n_models) AS mean_n_models, count(*) FILTER (n_models > 0) AS total_detections,
  count(score) AS n_observations, count(*) FILTER (alert = 'ROJO') AS n_red, count(*) FILTER (alert = 'AMARILLO') AS n_yellow FROM det GROUP BY 1)"""
_GT = {"mean_anomaly_score": 6, "max_anomaly_score": 6, "mean_n_models": 6, "total_detections": 0, "n_observations": 0, "n_red": 0, "n_yellow": 0, "detection_rate": 6, "risk_score": 6, "smart_pct": 6}
_q("a26_ground_truth", lambda s, sf: rounded(evidence.ground_truth(detections(s, sf), truth(s, sf)), ["barrio"], _GT),
   rounded_sql(_VAL, "SELECT *, total_detections / n_observations AS detection_rate FROM val LEFT JOIN risk USING (barrio)", ["barrio"], _GT))
_OV = {"temporal_corr_score": 6, "temporal_corr_detection_rate": 6, "n_common_months": 0, "n_top": 0, "n_overlap": 0, "overlap_pct": 4}


def overlap(s, sf):
    det = written(detections(s, sf))
    return evidence.ground_truth_overlap(evidence.ground_truth(det, truth(s, sf)), det, evidence.problematic_rate(changes(s, sf), "month", "reason", PROBLEMATIC))


_q("a26_overlap", lambda s, sf: rounded(overlap(s, sf), [], _OV),
   rounded_sql(f"""{_VAL}, {_CH}, mo AS (SELECT month, avg(score) AS s, avg((n_models > 0)::INT) AS d FROM det GROUP BY 1), cm AS (SELECT mo.*, problematic / total AS rate FROM mo JOIN changes USING (month)),
lim AS (SELECT quantile_cont(mean_anomaly_score, 0.75) AS t, median(risk_score) AS m FROM val LEFT JOIN risk USING (barrio)),
ov AS (SELECT count(*) AS n_top, count(*) FILTER (risk_score <= m) AS n_overlap FROM val LEFT JOIN risk USING (barrio), lim WHERE mean_anomaly_score >= t)""",
     "SELECT *, 100 * n_overlap / n_top AS overlap_pct FROM ov, (SELECT corr(s, rate) AS temporal_corr_score, corr(d, rate) AS temporal_corr_detection_rate, count(*) AS n_common_months FROM cm)", [], _OV).replace("SELECT , ", "SELECT "))


def evidences(s, sf):
    """Mean score of barrios beside four kinds of evidence: meters' risk, their manual share, elderly people, what is supplied for what is sold."""
    own = detections(s, sf).groupBy(F.col("barrio").alias("unit")).agg(F.round(F.avg("score"), 9).alias("x"))
    risk, old = truth(s, sf).select("barrio", "risk_score", "manual_pct"), census(s, sf).select(F.col("barrio").alias("b2"), "pct_65plus")
    g = own.join(risk, F.col("unit") == F.col("barrio")).join(old, F.col("unit") == F.col("b2"))
    kinds = {"infrastructure": "risk_score", "smart_coverage": "manual_pct", "demography": "pct_65plus"}
    return g.select("unit", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("evidence"), F.round(F.col(c).cast("double"), 9).alias("y")) for k, c in kinds.items()))).alias("e")).select("e.evidence", "unit", "x", "e.y")


_EV = {"rho": 6, "p_value": 6, "ci_low": 6, "ci_high": 6, "hit_rate": 6, "k": 0, "n": 0}
_KINDS = {"infrastructure": "risk_score", "smart_coverage": "manual_pct", "demography": "pct_65plus"}
_q("c9_external_validation", lambda s, sf: rounded(evidence.external_validation(evidences(s, sf)), ["evidence"], _EV),
   rounded_sql(f"""{_VAL}, {CENSUS}, own AS (SELECT barrio AS unit, round(mean_anomaly_score, 9) AS x, risk_score, manual_pct, pct_65plus FROM val JOIN risk USING (barrio) JOIN census USING (barrio)),
ev AS ({' UNION ALL '.join(f"SELECT '{k}' AS evidence, unit, x, round(CAST({c} AS DOUBLE), 9) AS y FROM own" for k, c in _KINDS.items())}),
rr AS (SELECT *, rank() OVER (PARTITION BY evidence ORDER BY x) + (count(*) OVER (PARTITION BY evidence, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY evidence ORDER BY y) + (count(*) OVER (PARTITION BY evidence, y) - 1) / 2 AS ry,
  row_number() OVER (PARTITION BY evidence ORDER BY unit) AS i, count(*) OVER (PARTITION BY evidence) AS n, row_number() OVER (PARTITION BY evidence ORDER BY x DESC, unit) AS hx, row_number() OVER (PARTITION BY evidence ORDER BY y DESC, unit) AS hy FROM ev),
real AS (SELECT evidence, corr(rx, ry) AS rho, any_value(n) AS n, least(10, any_value(n) // 2) AS k, count(*) FILTER (hx <= least(10, n // 2) AND hy <= least(10, n // 2)) / least(10, any_value(n) // 2) AS hit_rate FROM rr GROUP BY 1),
mixed AS (SELECT evidence, r AS round, i, rx, ry, row_number() OVER (PARTITION BY evidence, r ORDER BY {_DRAW.format("'ext-' || evidence || '-' || r || '-' || unit")}, unit) AS j FROM rr, range(1, 10001) t(r)),
null_ AS (SELECT a.evidence, a.round, corr(a.rx, b.ry) AS c FROM mixed a JOIN mixed b ON a.evidence = b.evidence AND a.round = b.round AND a.i = b.j GROUP BY 1, 2),
pv AS (SELECT evidence, (count(*) FILTER (round(abs(c), 9) >= round(abs(rho), 9)) + 1) / (count(*) + 1) AS p_value FROM null_ JOIN real USING (evidence) GROUP BY 1),
slots AS (SELECT evidence, r AS round, {_DRAW.format("'ext-' || evidence || '-' || r || '-' || i")} % n + 1 AS i FROM rr, range(1, 1001) t(r)),
drawn AS (SELECT s.evidence, s.round, rank() OVER (PARTITION BY s.evidence, s.round ORDER BY x) + (count(*) OVER (PARTITION BY s.evidence, s.round, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY s.evidence, s.round ORDER BY y) + (count(*) OVER (PARTITION BY s.evidence, s.round, y) - 1) / 2 AS ry
  FROM slots s JOIN rr ON rr.evidence = s.evidence AND rr.i = s.i),
ci AS (SELECT evidence, quantile_cont(c, 0.025) AS ci_low, quantile_cont(c, 0.975) AS ci_high FROM (SELECT evidence, round, corr(rx, ry) AS c FROM drawn GROUP BY 1, 2) WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY 1)""",
     "SELECT * FROM real JOIN pv USING (evidence) JOIN ci USING (evidence)", ["evidence"], _EV))

_WD = {"wasserstein_score": 5, "is_anomaly_wasserstein": 0, "distribution_shift_pct": 4, "wd_temporal": 3, "wd_cross_barrio": 6, "wd_multivariate": 1, "wd_train_test": 3}


def distances(s, sf):
    return st.wasserstein_detection(m.yoy_ratio(panel(s, sf)), "barrio_key", "fecha", "consumo", ["consumo", "cpc", "yoy_ratio"])


def _gap_sql(c: str) -> str:
    return f"list_sum(list_transform(range(0, 42), lambda k: abs(list_sort(b_{c})[k // 7 + 1] - list_sort(a_{c})[k // 6 + 1]))) / 42"


_q("m15_wasserstein_detection", lambda s, sf: rounded(distances(s, sf), KEYS, _WD),
   rounded_sql(f"""{PANEL}, yoy AS (SELECT * FROM ({_YOY.replace('$p', 'panel')})),
rows AS (SELECT barrio_key, fecha, consumo, cpc, yoy_ratio, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY barrio_key) AS n, avg(consumo) OVER (PARTITION BY barrio_key) AS mean,
  {', '.join(f"list({c}) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN 12 PRECEDING AND 7 PRECEDING) AS b_{c}, list({c}) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS a_{c}, stddev_pop({c}) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN 12 PRECEDING AND 7 PRECEDING) + 1e-10 AS s_{c}" for c in ("consumo", "cpc", "yoy_ratio"))}
  FROM yoy WINDOW w AS (PARTITION BY barrio_key ORDER BY fecha)),
sides AS (SELECT barrio_key, consumo AS x, (count(*) FILTER (i < greatest(3, floor(n * 0.6))))::DOUBLE AS a, (count(*) FILTER (i >= greatest(3, floor(n * 0.6))))::DOUBLE AS b FROM rows WHERE n >= 6 GROUP BY 1, 2),
gaps AS (SELECT barrio_key, abs(sum(a) OVER u / sum(a) OVER (PARTITION BY barrio_key) - sum(b) OVER u / sum(b) OVER (PARTITION BY barrio_key)) * (lead(x) OVER (PARTITION BY barrio_key ORDER BY x) - x) AS g
  FROM sides WINDOW u AS (PARTITION BY barrio_key ORDER BY x ROWS UNBOUNDED PRECEDING)),
shift AS (SELECT barrio_key, sum(g) AS wd FROM gaps GROUP BY 1),
norm AS (SELECT barrio_key, consumo / (mean + 1e-10) AS x FROM rows WHERE n >= 6),
pool AS (SELECT x, count(*)::DOUBLE AS c FROM norm GROUP BY 1), keys AS (SELECT DISTINCT barrio_key FROM norm), mine AS (SELECT barrio_key, x, count(*)::DOUBLE AS c FROM norm GROUP BY 1, 2),
grid AS (SELECT k.barrio_key, p.x, p.c AS c, coalesce(o.c, 0) AS o FROM keys k CROSS JOIN pool p LEFT JOIN mine o ON o.barrio_key = k.barrio_key AND o.x = p.x),
steps AS (SELECT barrio_key, abs(sum(o) OVER u / sum(o) OVER (PARTITION BY barrio_key) - sum(c) OVER u / sum(c) OVER (PARTITION BY barrio_key)) * (lead(x) OVER (PARTITION BY barrio_key ORDER BY x) - x) AS g
  FROM grid WINDOW u AS (PARTITION BY barrio_key ORDER BY x ROWS UNBOUNDED PRECEDING)),
crossed AS (SELECT barrio_key, sum(g) AS wd FROM steps GROUP BY 1),
base AS (SELECT barrio_key, fecha, mean, CASE WHEN n >= 13 AND i >= 12 THEN {_gap_sql("consumo")} ELSE 0 END AS wd_temporal,
  CASE WHEN n >= 13 AND i >= 12 THEN ({' + '.join(f"{_gap_sql(c)} / s_{c}" for c in ("consumo", "cpc", "yoy_ratio"))}) / 3 ELSE 0 END AS wd_multivariate FROM rows),
zs AS (SELECT *, {', '.join(f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY barrio_key) > 1e-10 THEN ({c} - avg({c}) OVER (PARTITION BY barrio_key)) / stddev_samp({c}) OVER (PARTITION BY barrio_key) ELSE 0 END AS {c}_z" for c in ("wd_temporal", "wd_multivariate"))} FROM base),
sz AS (SELECT barrio_key, wd AS wd_train_test, (wd - avg(wd) OVER ()) / (coalesce(stddev_samp(wd) OVER (), 0) + 1e-10) AS shift_z FROM shift),
cz AS (SELECT barrio_key, wd AS wd_cross_barrio, (wd - avg(wd) OVER ()) / (coalesce(stddev_samp(wd) OVER (), 0) + 1e-10) AS cross_z FROM crossed),
al AS (SELECT zs.*, coalesce(wd_train_test, 0) AS wd_train_test, coalesce(shift_z, 0) AS shift_z, coalesce(wd_cross_barrio, 0) AS wd_cross_barrio, coalesce(cross_z, 0) AS cross_z FROM zs LEFT JOIN sz USING (barrio_key) LEFT JOIN cz USING (barrio_key)),
sc AS (SELECT *, 1 / (1 + exp(-0.8 * (0.40 * abs(wd_temporal_z) + 0.25 * abs(shift_z) + 0.20 * abs(cross_z) + 0.15 * abs(wd_multivariate_z) - 2.0))) AS wasserstein_score FROM al)""",
     "SELECT *, wasserstein_score > 0.55 AS is_anomaly_wasserstein, CASE WHEN abs(mean) > 1e-10 THEN wd_train_test / mean * 100 ELSE 0 END AS distribution_shift_pct FROM sc", KEYS, _WD))
