"""Queries of checks against outside measures, nearest rows, names, messages and the household factor model."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import ensemble as e
from aforo.operators import monthly as m
from aforo.operators import validation as v
from aforo.plans.ensemble import _CONS, EDGES, FLAGS, RESULTS, region_edges, results
from aforo.plans.flows import rounded, rounded_sql
from aforo.plans.monthly import _DROPS
from aforo.sources.adapters import CENSUS, PANEL, SPARSE, census, household_hourly, panel, table

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, keys, cols, ctes, body):
    QUERIES[name] = lambda s, sf: rounded(build(s, sf), keys, cols)
    ORACLE_SQL[name] = rounded_sql(ctes, body, keys, cols).replace("SELECT , ", "SELECT ").replace(",  FROM q", " FROM q")


def _outside(s, sf):
    """A row a barrio: detections, elderly share, use."""
    g = e.consensus(results(s, sf), FLAGS).groupBy("barrio").agg(F.round(F.avg("n_models_detecting"), 9).alias("detections"), F.round(F.sum("consumo"), 2).alias("used"))
    return g.join(census(s, sf), "barrio").withColumn("pct_65plus", F.round("pct_65plus", 9))


_OUT = f"""{RESULTS}, {CENSUS}, ou AS (SELECT barrio, detections, used, round(pct_65plus, 9) AS pct_65plus FROM (SELECT barrio, round(avg(n_models_detecting), 9) AS detections, round(sum(consumo), 2) AS used FROM ({_CONS}) GROUP BY 1) JOIN census USING (barrio))"""
_RANKS = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{i}" for i, c in enumerate(("detections", "pct_65plus", "used"))) + " FROM ou"
_q("c10_partial_spearman", lambda s, sf: v.partial_spearman(_outside(s, sf), "detections", "pct_65plus", "used"), [], {"rho": 6, "partial_rho": 6, "n": 0}, f"{_OUT}, rk AS ({_RANKS}), sl AS (SELECT sum(r0 * r2) / sum(r2 * r2) AS b0, sum(r1 * r2) / sum(r2 * r2) AS b1 FROM rk)",
   "SELECT corr(r0, r1) AS rho, corr(r0 - b0 * r2, r1 - b1 * r2) AS partial_rho, count(*) AS n FROM rk, sl")
_q("c8_hit_rate", lambda s, sf: v.hit_rate(_outside(s, sf), "barrio", "detections", "pct_65plus"), [], {"hits": 0, "k": 0, "hit_rate": 6}, _OUT,
   "SELECT count(*) AS hits, 10 AS k, count(*) / 10 AS hit_rate FROM (SELECT barrio FROM ou ORDER BY detections DESC, barrio LIMIT 10) JOIN (SELECT barrio FROM ou ORDER BY pct_65plus DESC, barrio LIMIT 10) USING (barrio)")


def _moran(s, sf):
    n = panel(s, sf, "nation").groupBy(F.col("barrio").alias("id")).agg(F.round(F.avg("cpc"), 6).alias("x"))
    return v.moran_permutation(n, region_edges(s, sf).toDF("src", "dst"))


_q("c6_moran_permutation", _moran, [], {"moran_i": 6, "p_value": 6},
   f"""{SPARSE}, {EDGES}, z AS (SELECT id, x - avg(x) OVER () AS z FROM (SELECT barrio AS id, round(avg(cpc), 6) AS x FROM sparse GROUP BY 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY id) AS i, row_number() OVER (PARTITION BY round ORDER BY CASE WHEN round = 0 THEN '' ELSE md5('moran-' || round || '-' || id) END, id) AS j FROM z, (SELECT unnest(range(0, 100)) AS round)),
mx AS (SELECT a.round, a.id, b.z FROM r a JOIN r b ON a.round = b.round AND a.i = b.j),
mo AS (SELECT a.round, round((SELECT count(*) FROM z) / count(*) * sum(a.z * b.z) / (SELECT sum(z * z) FROM z), 12) AS moran FROM edges JOIN mx a ON a.id = barrio JOIN mx b ON b.id = neighbour AND b.round = a.round GROUP BY 1)""",
   "SELECT max(r0) AS moran_i, (count(*) FILTER (round > 0 AND abs(moran) >= abs(r0)) + 1) / (count(*) FILTER (round > 0) + 1) AS p_value FROM mo, (SELECT moran AS r0 FROM mo WHERE round = 0)")


def _nearest(s, sf):
    c = e.consensus(results(s, sf), FLAGS).withColumn("key", F.concat_ws("|", "barrio_key", F.col("fecha").cast("string")))
    fs = ["cpc", "contratos", "seasonal_zscore"]
    return v.nearest_normal(c.filter("n_models_detecting >= 3").select("key", *fs), c.filter("n_models_detecting = 0").select("key", *fs), "key", fs)


_q("j15_nearest_normal", _nearest, ["anomaly", "nearest"], {"distance": 6},
   f"""{RESULTS}, c AS (SELECT *, barrio_key || '|' || fecha AS key FROM ({_CONS})), no AS (SELECT * FROM c WHERE n_models_detecting = 0), an AS (SELECT * FROM c WHERE n_models_detecting >= 3 ORDER BY key LIMIT 10),
st AS (SELECT stddev_pop(cpc) AS a, stddev_pop(contratos) AS b, stddev_pop(seasonal_zscore) AS d FROM no)""",
   """SELECT anomaly, m.k AS nearest, m.d AS distance FROM (SELECT an.key AS anomaly, min({'d': round(sqrt(((no.cpc - an.cpc) / a) ** 2 + ((no.contratos - an.contratos) / b) ** 2 + ((no.seasonal_zscore - an.seasonal_zscore) / d) ** 2), 9), 'k': no.key}) AS m FROM an, no, st GROUP BY 1)""")


def _names(s, sf):
    p = table(s, sf, "part")
    sectors = p.select(F.regexp_replace("p_type", "^ECONOMY", "SAN BLAS").alias("sector")).distinct()
    barrios = p.select(F.concat(F.lit("7-"), F.regexp_replace("p_type", "^ECONOMY", "S. BLAS")).alias("barrio")).distinct()
    return v.match_names(sectors, barrios.unionByName(p.select(F.concat(F.split("p_type", " ")[0], F.lit(" ")).alias("barrio")).distinct()))


_SH = "replace(replace(replace(replace(replace($, 'SAN', 'S.'), 'SANTA', 'STA.'), 'POLIGONO', 'POL.'), 'PLAYA', 'PL.'), 'VIRGEN', 'V.')"
_q("j14_name_match", _names, ["sector", "barrio"], {},
   """se AS (SELECT DISTINCT regexp_replace(p_type, '^ECONOMY', 'SAN BLAS') AS sector FROM part), br AS (SELECT DISTINCT '7-' || regexp_replace(p_type, '^ECONOMY', 'S. BLAS') AS barrio FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) || ' ' FROM part),
nm AS (SELECT sector, barrio, upper(trim(sector)) AS a, CASE WHEN contains(barrio, '-') THEN upper(trim(regexp_replace(barrio, '^[^-]*-', ''))) ELSE upper(trim(barrio)) END AS b FROM se, br)""",
   f"SELECT sector, min(barrio) AS barrio FROM nm WHERE contains(a, b) OR contains(b, a) OR {_SH.replace('$', 'a')} = {_SH.replace('$', 'b')} GROUP BY 1")


def _messages(s, sf):
    d = m.consumption_drops(panel(s, sf)).filter("mom_change < -0.1")
    level = F.when(F.col("mom_change") < -0.3, "CRITICO").when(F.col("mom_change") < -0.2, "ALTO").otherwise("VIGILANCIA")
    return d.withColumn("mensaje", v.alert_message(level, F.col("barrio_key"), F.round("mom_change", 2), F.lit(0.5), F.col("consecutive_decline")))


_q("p17_messages", _messages, ["barrio_key", "fecha", "mensaje"], {}, f"{PANEL}, dd AS ({_DROPS.replace('$p', 'panel')})",
   """SELECT barrio_key, fecha, l || ': ' || barrio_key || ', consumo -' || CAST(round(abs(round(mom_change, 2)) * 100) AS INTEGER) || ' %, vulnerabilidad 50 %.' || CASE l WHEN 'CRITICO' THEN ' Verificar en persona.' WHEN 'ALTO' THEN ' Llamar a servicios sociales.' ELSE ' Observar.' END
        || CASE WHEN consecutive_decline >= 2 THEN ' Baja desde hace ' || consecutive_decline || ' meses.' ELSE '' END AS mensaje
      FROM (SELECT *, CASE WHEN mom_change < -0.3 THEN 'CRITICO' WHEN mom_change < -0.2 THEN 'ALTO' ELSE 'VIGILANCIA' END AS l FROM dd WHERE mom_change < -0.1)""")


def factors(s, sf):
    h = household_hourly(s, sf).withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts"), "barrio": F.pmod("contrato", F.lit(5)).cast("string"), "uso": F.when(F.col("contrato") % 3 == 0, "COMERCIAL").otherwise("DOMESTICO")})
    h = h.withColumns({"m2": 60 + F.col("contrato") % 50, "personas": 1 + F.col("contrato") % 4, "leak": F.col("contrato") % 25 == 0})
    return v.household_factors(h, "contrato", "litros", {"hour": list(range(24)), "dow": list(range(7)), "uso": ["COMERCIAL", "DOMESTICO"]}, ["m2", "personas"], "leak")


QUERIES["h5_household_factors"] = factors
