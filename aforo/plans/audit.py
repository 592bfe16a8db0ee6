"""Queries on infrastructure, decay, cores, sweeps and small parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import audit as a
from aforo.operators import ensemble as e
from aforo.operators import monthly as m
from aforo.operators import readings as r
from aforo.operators import statistics as st
from aforo.plans.ensemble import _CONF, _CONS, _P0, _VOTE, FLAGS, RESULTS, WEIGHTS, pseudo, results
from aforo.plans.flows import _DIST, _Z, _zs, rounded, rounded_sql
from aforo.plans.spatial import _PTS, _points, _squares
from aforo.sources.adapters import METERS, PANEL, READINGS, SPARSE, meters, panel, readings, table

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, keys, cols, ctes, body):
    QUERIES[name] = lambda s, sf: rounded(build(s, sf), keys, cols)
    ORACLE_SQL[name] = rounded_sql(ctes, body, keys, cols).replace("SELECT , ", "SELECT ")


_KINDS = ("HIDRANTE", "BOCA", "BOMBEO", "DEPOSITO")


def _assets(s, sf):
    """Customers as outlets, pumps and deposits, squares of nations as areas."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    size = F.when(F.pmod("c_custkey", F.lit(3)) == 0, 0.0).otherwise(F.pmod("c_custkey", F.lit(90)).cast("double"))
    points = _points(s, sf).join(table(s, sf, "customer").select(F.col("c_custkey").alias("pid"), kind.alias("kind"), size.alias("size")), "pid")
    return a.assets_per_area(points, _squares(s, sf), 100.0)


_ASSETS = f"""{_PTS}, sq AS (SELECT n_name AS poly, n_nationkey AS ordinal, (n_nationkey % 5) * 200.0 AS ax, (n_nationkey // 5) * 200.0 AS ay FROM nation),
pp AS (SELECT pid, min_by(poly, ordinal) AS poly FROM pts JOIN sq ON x >= ax AND x < ax + 220 AND y >= ay AND y < ay + 220 GROUP BY 1),
assets AS (
  SELECT poly, count(*) FILTER (k = 0) AS n_hydrants, count(*) FILTER (k = 1) AS n_bocas_riego, count(*) FILTER (k < 2) AS n_total_riego, coalesce(avg(size) FILTER (k < 2 AND size > 0), 0) AS avg_hydrant_diameter,
    count(*) FILTER (k = 2) AS n_pumping_stations, coalesce(sum(size) FILTER (k = 3), 0) AS deposit_capacity_m3
  FROM (SELECT poly, pid % 4 AS k, CASE WHEN pid % 3 = 0 THEN 0 ELSE (pid % 90)::DOUBLE END AS size FROM pp) GROUP BY 1)"""
_ASSET_COLS = {"n_hydrants": 0, "n_bocas_riego": 0, "n_total_riego": 0, "avg_hydrant_diameter": 6, "n_pumping_stations": 0, "deposit_capacity_m3": 2}
_q("a12_assets_per_area", _assets, ["poly"], _ASSET_COLS, _ASSETS, "SELECT * FROM assets")


def _barrios(s, sf):
    n = table(s, sf, "nation").select(F.col("n_name").alias("poly"), F.col("n_regionkey").alias("barrio"), ((F.col("n_nationkey") % 7) * 10.0).alias("elevation"), (F.col("n_nationkey") * 25.0 + 80).alias("pipe_diameter"))
    areas = n.join(_assets(s, sf), "poly", "left").fillna(0).withColumns({"area_m2": F.lit(48400.0), "pipe_length_m": F.col("deposit_capacity_m3") * 10})
    return a.areas_to_barrios(areas)


_BARRIOS = f"""{_ASSETS},
ar AS (
  SELECT n_regionkey AS barrio, (n_nationkey % 7) * 10.0::DOUBLE AS elevation, n_nationkey * 25.0::DOUBLE + 80 AS pipe_diameter, coalesce(n_total_riego, 0) AS n_total_riego, coalesce(deposit_capacity_m3, 0) * 10 AS pipe_length_m
  FROM nation LEFT JOIN assets ON poly = n_name),
ba AS (
  SELECT *, pipe_length_m / 1000 / area_km2 AS pipe_density, n_total_riego / area_km2 AS hydrant_density
  FROM (SELECT barrio, count(*) * 48400.0::DOUBLE / 1e6 AS area_km2, avg(elevation) AS elevation_mean, max(elevation) - min(elevation) AS elevation_range, sum(n_total_riego) AS n_total_riego, sum(pipe_length_m) AS pipe_length_m, avg(pipe_diameter) AS avg_pipe_diameter_mm, count(*) AS n_sectors FROM ar GROUP BY 1))"""
_BARRIO_COLS = {"area_km2": 6, "elevation_mean": 6, "elevation_range": 2, "n_total_riego": 0, "pipe_length_m": 2, "avg_pipe_diameter_mm": 4, "n_sectors": 0, "pipe_density": 6, "hydrant_density": 6}
_q("a13_barrio_infrastructure", _barrios, ["barrio"], _BARRIO_COLS, _BARRIOS, "SELECT * FROM ba")


def _risk(s, sf):
    more = {"pct_sewer_unitaria": F.col("elevation_range") / 100, "imbornal_density": F.lit(3.0), "colector_coverage_pct": F.col("n_total_riego") % 7}
    return a.infrastructure_risk(_barrios(s, sf).withColumns(more))


_HI, _LO = ("elevation_mean", "elevation_range / 100"), ("pipe_density", "avg_pipe_diameter_mm", "hydrant_density", "3.0", "n_total_riego % 7")
_SC = "CASE WHEN max($) OVER () > min($) OVER () THEN ($ - min($) OVER ()) / (max($) OVER () - min($) OVER ()) ELSE 0.5 END"
_q("a14_infrastructure_risk", _risk, ["barrio"], {"infrastructure_risk_score": 6}, _BARRIOS,
   "SELECT barrio, " + " + ".join([_SC.replace("$", f"({c})") for c in _HI] + ["1 - " + _SC.replace("$", f"({c})") for c in _LO]) + " AS infrastructure_risk_score FROM ba")

_q("c14_decay_status", lambda s, sf: a.model_decay(results(s, sf), FLAGS), ["model", "status"], {"mean_rate": 6, "cv": 6, "trend_corr": 6, "quarters": 0},
   RESULTS + ", qr AS (" + " UNION ALL ".join(f"SELECT '{f[11:]}' AS model, date_trunc('quarter', fecha) AS q, avg({f}::INT) AS rate FROM results GROUP BY 2" for f in FLAGS) + ")",
   """SELECT *, CASE WHEN abs(trend_corr) > 0.7 AND trend_corr > 0 THEN 'DECAY' WHEN abs(trend_corr) > 0.7 THEN 'MEJORA' WHEN cv > 0.5 THEN 'INESTABLE' ELSE 'ESTABLE' END AS status FROM (
        SELECT model, avg(rate) * 100 AS mean_rate, stddev_pop(rate) / (avg(rate) + 1e-10) AS cv, CASE WHEN stddev_pop(rate) > 0 THEN corr(i, rate) ELSE 0 END AS trend_corr, count(*) AS quarters
        FROM (SELECT *, dense_rank() OVER (ORDER BY q) AS i FROM qr) WHERE rate IS NOT NULL GROUP BY 1) WHERE quarters >= 2""")


def _core(s, sf):
    df = e.weighted_voting(e.consensus(pseudo(s, sf), FLAGS), WEIGHTS)
    return a.stable_core(e.conformal_p(df, "abs_dev", "train"), "ensemble_score", "pseudo_score", "p_value", "n_models_detecting", 0.5)


_CORE = f"""{RESULTS}, {_P0},
st AS (SELECT barrio AS b1, avg(pseudo_score) AS stack_mean FROM p0 GROUP BY 1), vo AS (SELECT barrio AS b2, avg(ensemble_score) AS ens_mean, max(ensemble_score) AS ens_max FROM ({_VOTE}) GROUP BY 1),
cf AS (SELECT barrio AS b3, min(p_value) AS conf_p_min, count(*) FILTER (p_value < 0.05) AS conf_sig FROM ({_CONF}) GROUP BY 1), nm AS (SELECT barrio, avg(n_models_detecting) AS n_models_mean FROM ({_CONS}) GROUP BY 1),
co AS (SELECT * FROM nm JOIN st ON b1 = barrio JOIN vo ON b2 = barrio JOIN cf ON b3 = barrio)"""
_CORE_COLS = {"ens_mean": 6, "ens_max": 6, "stack_mean": 6, "conf_p_min": 6, "conf_sig": 0, "n_models_mean": 6, "core": 0}
_q("a25_stable_core", _core, ["barrio"], _CORE_COLS, _CORE,
   "SELECT *, ens_mean >= quantile_cont(ens_mean, 0.75) OVER () AND stack_mean >= quantile_cont(stack_mean, 0.75) OVER () AND conf_sig > 0 AND n_models_mean >= 0.5 AS core FROM co")

_q("a22_top_consensus", lambda s, sf: e.consensus(results(s, sf), FLAGS).orderBy(F.desc("n_models_detecting"), F.desc("consumo"), "barrio_key", "fecha").limit(10), ["barrio_key", "fecha"], {"n_models_detecting": 0},
   f"{RESULTS}, c AS ({_CONS})", "SELECT * FROM c ORDER BY n_models_detecting DESC, consumo DESC, barrio_key, fecha LIMIT 10")


def _reading_correlation(s, sf):
    dist = r.distribution_flags(r.distribution_features(readings(s, sf)), _Z).select(F.col("mes").alias("fecha"), "score")
    monthly = results(s, sf).groupBy("fecha").agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in FLAGS))
    both = dist.join(monthly, "fecha")
    return both.agg(*(st.correlation("score", f).alias(f"r_{f[11:]}") for f in FLAGS), F.count("*").alias("n"))


_q("c23_reading_correlation", _reading_correlation, [], {**{f"r_{f[11:]}": 4 for f in FLAGS}, "n": 0},
   f"{RESULTS}, {READINGS}, ds AS (SELECT mes AS fecha, coalesce(list_avg(z), 0) AS score FROM (SELECT mes, list_filter([{', '.join(_zs.values())}], lambda x: x > 2) AS z FROM ({_DIST})))",
   "SELECT " + ", ".join(f"corr(score, m_{f[11:]}) AS r_{f[11:]}" for f in FLAGS) + ", count(*) AS n FROM ds JOIN (SELECT fecha AS f2, " + ", ".join(f"avg({f}::INT) AS m_{f[11:]}" for f in FLAGS) + " FROM results GROUP BY 1) ON f2 = fecha")

_q("a11_registry", lambda s, sf: meters(s, sf).withColumn("smart", F.coalesce(F.col("installed") >= F.lit("1996-01-01").cast("date"), F.lit(False))).groupBy("barrio", "uso").agg(F.avg(F.col("smart").cast("int")).alias("smart_ratio"), F.avg((F.col("meter") % 3 * 5 + 13).cast("double")).alias("calibre"), F.count("*").alias("n")),
   ["barrio", "uso"], {"smart_ratio": 6, "calibre": 6, "n": 0}, METERS, "SELECT barrio, uso, avg(coalesce(installed >= DATE '1996-01-01', false)::INT) AS smart_ratio, avg(meter % 3 * 5 + 13) AS calibre, count(*) AS n FROM meters GROUP BY 1, 2")


def _fences(s, sf):
    df = m.split_train(m.group_trend_deviation(panel(s, sf, "nation"))).withColumns({"x": F.col("deviation_from_group_trend"), "y": F.abs("deviation_from_group_trend") >= 0.5})
    own = df.filter("train").groupBy("barrio_key").agg(F.count("x").alias("n"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3")).filter("n >= 6")
    return a.multiplier_sweep(own, df.filter("NOT train").select("barrio_key", "x", "y"), "barrio_key", "x", "y", (1.0, 1.5, 2.0, 3.0))


_FENCES = f"""{RESULTS},
ow AS (SELECT barrio_key, quantile_cont(deviation_from_group_trend, 0.25) AS q1, quantile_cont(deviation_from_group_trend, 0.75) AS q3 FROM results WHERE train GROUP BY 1 HAVING count(deviation_from_group_trend) >= 6),
hh AS (
  SELECT multiplier, q3 > q1 AND (x < q1 - multiplier * (q3 - q1) OR x > q3 + multiplier * (q3 - q1)) AS hit, abs(x) >= 0.5 AS y
  FROM (SELECT barrio_key, deviation_from_group_trend AS x FROM results WHERE NOT train) JOIN ow USING (barrio_key), (SELECT unnest([1.0::DOUBLE, 1.5, 2, 3]) AS multiplier)),
sw AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
        FROM (SELECT multiplier, count(*) FILTER (hit AND y) AS tp, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn FROM hh GROUP BY 1)))"""
_SWEEP = {"tp": 0, "fp": 0, "fn": 0, "precision": 6, "recall": 6, "f1": 6}
_q("c19_multiplier_sweep", _fences, ["multiplier"], _SWEEP, _FENCES, "SELECT * FROM sw")
_q("c20_best_setting", lambda s, sf: a.best_setting(_fences(s, sf)), ["multiplier"], {"precision": 6, "f1": 6, "tier": 0}, _FENCES,
   "SELECT multiplier, precision, f1, tier FROM (SELECT *, CASE WHEN precision >= 0.8 THEN 0 WHEN precision >= 0.7 THEN 1 ELSE 2 END AS tier FROM sw) ORDER BY tier, f1 DESC, multiplier LIMIT 1")

_q("p12_sigmoid", lambda s, sf: panel(s, sf).withColumn("y", a.sigmoid(F.col("contratos") / 10)), ["barrio_key", "fecha"], {"y": 6}, PANEL, "SELECT *, 1 / (1 + exp(-0.8 * (contratos / 10 - 2))) AS y FROM panel")
_q("p4_plain_name", lambda s, sf: table(s, sf, "part").select("p_partkey", a.plain_name(F.concat(F.lit(" 13 - "), F.col("p_type"), F.lit(" (n.º 2)"))).alias("name")), ["p_partkey", "name"], {}, "n0 AS (SELECT p_partkey, upper(trim(' 13 - ' || p_type || ' (n.º 2)')) AS t FROM part)",
   "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '^\\d+\\s*-\\s*', ''), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM n0")
for _name in ("p4_plain_name",):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("SELECT p_partkey, name,  FROM q", "SELECT p_partkey, name FROM q")
_USES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_q("p19_one_hot", lambda s, sf: a.one_hot(panel(s, sf), "uso", _USES), ["barrio_key", "fecha"], {f"uso_{u}": 0 for u in _USES}, PANEL, "SELECT *, " + ", ".join(f"(uso = '{u}')::INT AS uso_{u}" for u in _USES) + " FROM panel")
_q("p16_contains", lambda s, sf: panel(s, sf, "nation").filter(F.lower("uso").contains("house")).groupBy("barrio").agg(F.count("*").alias("n")), ["barrio"], {"n": 0}, SPARSE, "SELECT barrio, count(*) AS n FROM sparse WHERE contains(lower(uso), 'house') GROUP BY 1")
_q("src13_network_coverage", lambda s, sf: table(s, sf, "part").select("p_partkey", F.when(F.col("p_retailprice") > 0, F.least(F.col("p_size") * 50 / F.col("p_retailprice") * 100, F.lit(200.0))).otherwise(0.0).alias("coverage")), ["p_partkey"], {"coverage": 6},
   "p AS (SELECT * FROM part)", "SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN least(p_size * 50 / p_retailprice * 100, 200) ELSE 0 END AS coverage FROM p")


def _plant(s, sf):
    o = table(s, sf, "orders")
    name = F.element_at(F.array(*(F.lit(f" {x}") for x in (*a.MONTHS, "Mes"))), F.when(F.col("o_orderkey") % 50 == 0, 13).otherwise(F.month("o_orderdate")))
    df = o.select(a.spanish_month(F.year("o_orderdate"), name).alias("fecha"), F.col("o_totalprice").alias("treated"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("reused"))
    g = df.filter("fecha IS NOT NULL").groupBy("fecha").agg(F.round(F.sum("treated"), 2).alias("treated_m3"), F.round(F.sum("reused"), 2).alias("reused_m3"))
    return g.withColumn("reuse_ratio", F.when(F.col("treated_m3") > 0, F.col("reused_m3") / F.col("treated_m3")).otherwise(0.0))


_q("src14_treatment_plant", _plant, ["fecha"], {"treated_m3": 2, "reused_m3": 2, "reuse_ratio": 6},
   "o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, round(sum(o_totalprice), 2) AS treated_m3, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS reused_m3 FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1)", "SELECT *, reused_m3 / treated_m3 AS reuse_ratio FROM o")


def _timeline(s, sf):
    o = table(s, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    g = o.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("mes")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).count().fillna(0).toDF("mes", "fp", "rb", "mr")
    return g.withColumn("total_suspicious", F.col("fp") + F.col("rb") + F.col("mr"))


_q("src15_fraud_timeline", _timeline, ["mes"], {"fp": 0, "rb": 0, "mr": 0, "total_suspicious": 0}, "o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, left(o_orderpriority, 1) AS p FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2', '3'))",
   "SELECT mes, count(*) FILTER (p = '1') AS fp, count(*) FILTER (p = '2') AS rb, count(*) FILTER (p = '3') AS mr, count(*) AS total_suspicious FROM o GROUP BY 1")
_q("src22_diurnal_curve", lambda s, sf: table(s, sf, "events").groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean")).withColumn("curve", 24 * F.col("mean") / F.sum("mean").over(e.Window.partitionBy())), ["hour"], {"curve": 6},  # 24 rows
   "g AS (SELECT hour(ts)::INTEGER AS hour, avg(value) AS mean FROM events GROUP BY 1)", "SELECT hour, 24 * mean / sum(mean) OVER () AS curve FROM g")
_q("src23_flag_sums", lambda s, sf: results(s, sf).groupBy("fecha").agg(*(F.count_if(f).alias(f) for f in FLAGS)), ["fecha"], {f: 0 for f in FLAGS}, RESULTS, "SELECT fecha, " + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in FLAGS) + " FROM results GROUP BY 1")
