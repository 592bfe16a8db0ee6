"""Queries of the reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aforo.functions import ladders
from aforo.operators import ensemble as e
from aforo.operators import monthly as m
from aforo.operators import reports as r
from aforo.plans.ensemble import _CONF, _CONS, FLAGS, KEYS, RESULTS, results
from aforo.plans.flows import rounded, rounded_sql
from aforo.sources.adapters import SECTOR, sector_hourly, table

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql.replace("SELECT , ", "SELECT ")


_q("a22_consensus_counts", lambda s, d: r.consensus_counts(e.consensus(results(s, d), FLAGS), 4), f"WITH {RESULTS}, c AS ({_CONS}) SELECT k::INT AS at_least, count(*) FILTER (n_models_detecting >= k) AS n FROM c, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY 1")
_q("e1_two_model_vote", lambda s, d: results(s, d).select(*KEYS, ladders.two_model_vote(F.col("is_anomaly_cross"), F.col("is_anomaly_season")).alias("severity"), (F.col("is_anomaly_cross") | F.col("is_anomaly_season")).alias("is_anomaly")),
   f"WITH {RESULTS} SELECT barrio_key, fecha, CASE WHEN is_anomaly_cross AND is_anomaly_season THEN 'CRITICAL' WHEN is_anomaly_cross THEN 'HIGH' WHEN is_anomaly_season THEN 'MEDIUM' ELSE 'NORMAL' END AS severity, is_anomaly_cross OR is_anomaly_season AS is_anomaly FROM results")
_VE = {"tp": 0, "fp": 0, "fn": 0, "precision": 6, "recall": 6, "f1": 6}
_q("e1_vote_evaluation", lambda s, d: rounded(r.vote_evaluation(results(s, d), "is_anomaly_cross", "is_anomaly_season", "is_anomaly_yoy"), ["mode"], _VE),
   rounded_sql(f"{RESULTS}, v AS (SELECT mode, CASE mode WHEN 'or' THEN is_anomaly_cross OR is_anomaly_season ELSE is_anomaly_cross AND is_anomaly_season END AS p, is_anomaly_yoy AS y FROM results, (SELECT unnest(['or', 'and']) AS mode))",
     "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM (SELECT mode, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM v GROUP BY 1))", ["mode"], _VE))
_EI = {"total_barrios": 0, "barrios_alerta": 0, "barrios_alta_confianza": 0, "consumo_anomalo_m3": 4, "exceso_estimado_m3": 4, "ahorro_eur": 4, "coste_inspecciones": 2, "roi": 4}
_q("a23_economic_impact", lambda s, d: rounded(r.economic_impact(e.consensus(results(s, d), FLAGS)), [], _EI),
   rounded_sql(f"{RESULTS}, c AS ({_CONS})", "SELECT *, CASE WHEN coste_inspecciones > 0 THEN ahorro_eur / coste_inspecciones ELSE 0 END AS roi FROM (SELECT *, exceso_estimado_m3 * 1.5 AS ahorro_eur, barrios_alta_confianza * 200.0 AS coste_inspecciones FROM (SELECT *, consumo_anomalo_m3 * 0.15 AS exceso_estimado_m3 FROM (SELECT count(*) AS total_barrios, count(*) FILTER (most >= 1) AS barrios_alerta, count(*) FILTER (most >= 3) AS barrios_alta_confianza, coalesce(sum(anomalous), 0) / 1000 AS consumo_anomalo_m3 FROM (SELECT barrio_key, max(n_models_detecting) AS most, sum(consumo) FILTER (n_models_detecting >= 2) AS anomalous FROM c GROUP BY 1))))", [], _EI))
_q("p14_mean_score", lambda s, d: rounded(results(s, d).withColumn("score", r.mean_score([F.col(f) for f in FLAGS], [F.when(F.col("abs_dev") > 0.1, F.least(F.col("abs_dev") / 0.5, F.lit(1.0)))])), KEYS, {"score": 9}),
   rounded_sql(RESULTS, f"SELECT *, coalesce(list_avg(list_filter([{', '.join(f'{f}::INT::DOUBLE' for f in FLAGS)}, CASE WHEN abs_dev > 0.1 THEN least(abs_dev / 0.5, 1) END], lambda x: x IS NOT NULL)), 0) AS score FROM results", KEYS, {"score": 9}))
_TO = "g AS (SELECT barrio_key, round(avg(abs_dev), 6) AS a, round(avg(abs(seasonal_zscore)), 6) AS b FROM results GROUP BY 1), o AS (SELECT barrio_key FROM g ORDER BY a DESC, 1 LIMIT 25), t AS (SELECT barrio_key FROM g ORDER BY b DESC, 1 LIMIT 25)"
_q("c21_top_overlap", lambda s, d: rounded(r.top_overlap(results(s, d).groupBy("barrio_key").agg(F.round(F.avg("abs_dev"), 6).alias("a"), F.round(F.avg(F.abs("seasonal_zscore")), 6).alias("b")), "barrio_key", "a", "b", 25), [], {"shared": 0, "jaccard": 6}),
   f"WITH {RESULTS}, {_TO} SELECT count(*) FILTER (o.barrio_key IS NOT NULL AND t.barrio_key IS NOT NULL)::DOUBLE AS shared, round(count(*) FILTER (o.barrio_key IS NOT NULL AND t.barrio_key IS NOT NULL) / count(*), 6) AS jaccard FROM o FULL OUTER JOIN t USING (barrio_key)")
_q("q7_p_value_histogram", lambda s, d: e.conformal_p(results(s, d), "abs_dev", "train").groupBy(F.least(F.floor(F.col("p_value") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n")), f"WITH {RESULTS} SELECT CAST(least(floor(p_value * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM ({_CONF}) GROUP BY 1")
_q("c24_monthly_correlation", lambda s, d: table(s, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("fecha")).agg(F.avg(F.col("o_orderpriority").startswith("1").cast("double")).alias("fraud")).join(results(s, d).groupBy("fecha").agg(F.avg(F.col("is_anomaly_cross").cast("double")).alias("det")), "fecha").agg(F.round(F.corr("fraud", "det"), 6).alias("r"), F.count("*").alias("n")),
   f"WITH {RESULTS} SELECT round(corr(fraud, det), 6) AS r, count(*) AS n FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, avg((o_orderpriority LIKE '1%')::INT) AS fraud FROM orders GROUP BY 1) JOIN (SELECT fecha, avg(is_anomaly_cross::INT) AS det FROM results GROUP BY 1) USING (fecha)")
_q("h4_peak_thinning", lambda s, d: r.thin_peaks(sector_hourly(s, d).withColumn("c", F.round("caudal", 4)), "sector", "ts", "c", 50.0, 12))
_q("src8_bucket_sample", lambda s, d: r.bucket_sample(table(s, d, "orders"), F.col("o_orderkey"), 0.3).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5('42-' || o_orderkey), 1, 6))::BIGINT < 5033164")
_q("s27_level_order", lambda s, d: table(s, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ["VIGILANCIA", "CRITICO", "ALTO"])), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int")).alias("nivel"), "c_acctbal").withColumn("o", ladders.level_order("nivel")).orderBy("o", F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "nivel", "o"),
   "SELECT c_custkey, nivel, CAST(o AS INTEGER) AS o FROM (SELECT *, CASE nivel WHEN 'CRITICO' THEN 0 WHEN 'ALTO' THEN 1 ELSE 2 END AS o FROM (SELECT c_custkey, c_acctbal, ['VIGILANCIA', 'CRITICO', 'ALTO'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS nivel FROM customer)) ORDER BY o, c_acctbal DESC, c_custkey LIMIT 50")
_q("g8_json_fields", lambda s, d: table(s, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.countDistinct("k").alias("different")), "SELECT event_type, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS different FROM (SELECT event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events) GROUP BY 1")


def _sink(s, d):
    top = (s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    df = e.consensus(results(s, d), FLAGS).select(*KEYS, F.split("models_detecting", ";").alias("models"), F.col("n_models_detecting").cast("int").alias("n"))
    back = r.write_results(df, f"{top}/results-{uuid.uuid4().hex}")
    return back.select(*KEYS, F.coalesce("models", F.lit("")).alias("models"), "n")


_q("snk1_results_csv", _sink, f"WITH {RESULTS} SELECT barrio_key, fecha, models_detecting AS models, CAST(n_models_detecting AS INTEGER) AS n FROM ({_CONS})")
M12_FEATURES = ["deviation_from_group_trend", "relative_consumption", "consumption_volatility", "momentum"]


def m12(s, d):
    df = e.consensus(m.lags(m.relative_consumption(results(s, d))), FLAGS)
    return r.meta_score(df, KEYS, M12_FEATURES, {f.removeprefix("is_anomaly_"): f for f in FLAGS}, "n_models_detecting")


_q("m12_meta_score", m12)
