"""Queries on hourly flows and meter readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import flows as f
from aforo.operators import readings as r
from aforo.sources.adapters import HOUSEHOLD, READINGS, SECTOR, household_hourly, readings, sector_hourly

QUERIES, ORACLE_SQL = {}, {}


def nudge(d: int) -> float:
    """What is added before rounding to ``d`` places, here and in SQL, for columns with ties: a mean of amounts in cents may fall on the very border,
    where engines that add in another order would round apart.
    """
    return 10.0 ** -(d + 3)


def rounded(df, keys: list[str], cols: dict[str, int], ties: bool = False):
    return df.select(*keys, *((F.round(F.col(c).cast("double") + nudge(d) * ties, d) + 0.0).alias(c) for c, d in cols.items()))


def rounded_sql(ctes: str, body: str, keys: list[str], cols: dict[str, int], ties: bool = False) -> str:
    return f"WITH {ctes}, q AS ({body}) SELECT {', '.join(keys)}, {', '.join(f'round(CAST({c} AS DOUBLE) + {nudge(d) * ties!r}, {d}) + 0.0 AS {c}' for c, d in cols.items())} FROM q"


def _add(name, source, cte, build, keys, cols, body):
    QUERIES[name] = lambda spark, sf_dir: rounded(build(source(spark, sf_dir)), keys, cols, ties=True)
    ORACLE_SQL[name] = rounded_sql(cte, body, keys, cols, ties=True)


_DAILY = """SELECT *, CASE WHEN day_mean > 0.001 THEN night_mean / day_mean ELSE 0.0 END AS night_day_ratio FROM (
  SELECT contrato, CAST(ts AS DATE) AS dia, sum(litros) AS total, coalesce(min(litros) FILTER (hour(ts) BETWEEN 2 AND 5), 0) AS night_min, coalesce(avg(litros) FILTER (hour(ts) BETWEEN 2 AND 5), 0) AS night_mean,
    coalesce(avg(litros) FILTER (hour(ts) BETWEEN 8 AND 22), 0) AS day_mean, count(*) FILTER (litros > 0) AS active_hours FROM household GROUP BY 1, 2)"""
_add("a1_daily_features", household_hourly, HOUSEHOLD, lambda d: f.daily_features(d, "contrato", "litros"), ["contrato", "dia"],
     {"total": 6, "night_min": 6, "night_mean": 6, "day_mean": 6, "active_hours": 0, "night_day_ratio": 6}, _DAILY)
_add("w14_rolling_week", household_hourly, HOUSEHOLD, lambda d: f.rolling_week(f.daily_features(d, "contrato", "litros"), "contrato"), ["contrato", "dia"], {"roll_mean": 4, "roll_std": 4, "roll_z": 4},
     f"SELECT *, CASE WHEN roll_std > 0 THEN (total - roll_mean) / roll_std ELSE 0.0 END AS roll_z FROM (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN avg(total) OVER w END AS roll_mean, CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(total) OVER w END AS roll_std FROM ({_DAILY}) WINDOW w AS (PARTITION BY contrato ORDER BY dia ROWS 6 PRECEDING))")
_RATIO = "SELECT *, CASE WHEN day > 0 THEN night / day END AS ratio FROM (SELECT sector, CAST(ts AS DATE) AS dia, avg(caudal) FILTER (hour(ts) BETWEEN 2 AND 4) AS night, avg(caudal) FILTER (hour(ts) BETWEEN 10 AND 17) AS day FROM sector GROUP BY 1, 2)"
_add("a2_night_day_ratio", sector_hourly, SECTOR, f.night_day_ratios, ["sector", "dia"], {"night": 6, "day": 6, "ratio": 6}, _RATIO)
_add("w16_spike_nights", sector_hourly, SECTOR, lambda d: f.spike_nights(f.night_day_ratios(d)), ["sector", "dia"], {"ratio": 4, "is_spike": 0},
     f"SELECT *, coalesce(ratio > avg(ratio) OVER w + 3 * stddev_samp(ratio) OVER w AND ratio > 0.8, false) AS is_spike FROM ({_RATIO}) WINDOW w AS (PARTITION BY sector)")


def _night_flow(d):
    profile = d.groupBy("sector").agg((F.length("sector") / 20).alias("non_domestic"), (F.max("caudal") / F.avg("caudal")).alias("reclaimed"))
    return f.night_flow_flags(f.night_day_ratios(d), profile)


_add("m9_night_flow", sector_hourly, SECTOR, _night_flow, ["sector"], {"mean_ratio": 4, "z": 4, "score": 4, "is_anomaly": 0},
     f"""SELECT *, score > 2 AS is_anomaly FROM (SELECT sector, mean_ratio, z, z + CASE WHEN nd > 0.5 THEN 2 WHEN nd > 0.3 THEN 1 ELSE 0 END + CASE WHEN re > 3 THEN 1.5 WHEN re > 1.5 THEN 0.5 ELSE 0 END AS score FROM (
       SELECT *, CASE WHEN stddev_samp(mean_ratio) OVER () > 0 THEN (mean_ratio - avg(mean_ratio) OVER ()) / stddev_samp(mean_ratio) OVER () ELSE 0 END AS z FROM (SELECT sector, avg(ratio) AS mean_ratio FROM ({_RATIO}) GROUP BY 1))
       JOIN (SELECT sector AS s2, length(sector) / 20.0 AS nd, max(caudal) / avg(caudal) AS re FROM sector GROUP BY 1) ON s2 = sector)""")
_SILENT = """SELECT *, CASE WHEN ratio < 0.01 THEN 1.0 WHEN ratio < 0.03 THEN 0.85 WHEN ratio < 0.05 THEN 0.6 WHEN ratio < 0.10 THEN 0.3 ELSE 0.0 END AS silence FROM (SELECT *, night / day AS ratio FROM (
  SELECT contrato, CAST(ts AS DATE) AS dia, avg(litros) FILTER (hour(ts) BETWEEN 1 AND 5) AS night, avg(litros) FILTER (hour(ts) BETWEEN 8 AND 21) AS day FROM household GROUP BY 1, 2) WHERE night IS NOT NULL AND day > 0)"""
_add("a17_night_silence", household_hourly, HOUSEHOLD, lambda d: f.night_silence(d, "contrato", "litros"), ["contrato", "dia"], {"night": 6, "day": 6, "ratio": 6, "silence": 2}, _SILENT)
_add("a17_silent_months", household_hourly, HOUSEHOLD, lambda d: f.silent_months(f.night_silence(d, "contrato", "litros"), "contrato"), ["contrato", "mes"],
     {"avg_silence": 6, "max_silence": 2, "days_silent": 0, "total_days": 0, "pct_days_silent": 6},
     f"SELECT *, days_silent / total_days AS pct_days_silent FROM (SELECT contrato, CAST(date_trunc('month', dia) AS DATE) AS mes, avg(silence) AS avg_silence, max(silence) AS max_silence, count(*) FILTER (silence > 0.5) AS days_silent, count(*) AS total_days FROM ({_SILENT}) WHERE silence > 0 GROUP BY 1, 2)")
_add("w21_rolling_day", sector_hourly, SECTOR, lambda d: f.rolling_day(d, "sector", "caudal"), ["sector", "ts"], {"mean_24h": 4}, "SELECT *, avg(caudal) OVER (PARTITION BY sector ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW) AS mean_24h FROM sector")
_add("w22_takens_embedding", sector_hourly, SECTOR, lambda d: f.takens(d, "sector", "caudal"), ["sector", "ts"], {"x0": 4, "x1": 4, "x2": 4}, "SELECT * FROM (SELECT sector, ts, caudal AS x0, lead(caudal, 1) OVER w AS x1, lead(caudal, 2) OVER w AS x2 FROM sector WINDOW w AS (PARTITION BY sector ORDER BY ts)) WHERE x2 IS NOT NULL")
_add("w23_block_means", household_hourly, HOUSEHOLD, lambda d: f.blocks(d, "contrato", "litros"), ["contrato"], {"block": 0, "mean": 4, "n": 0}, "SELECT contrato, block, avg(litros) AS mean, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY contrato ORDER BY ts) - 1) // 4 AS block FROM household) GROUP BY 1, 2")
_HF = """SELECT * FROM (SELECT contrato, avg(litros) FILTER (hour(ts) BETWEEN 0 AND 5) / (avg(litros) FILTER (hour(ts) BETWEEN 8 AND 22) + 1e-9) AS night_flow_ratio, coalesce(quantile_cont(litros, 0.1) FILTER (hour(ts) BETWEEN 2 AND 4), 0) AS nocturnal_baseline, stddev_samp(litros) / (avg(litros) + 1e-9) AS consumption_cv FROM household GROUP BY 1)
  JOIN (SELECT contrato, CASE WHEN count(*) >= 5 THEN regr_slope(total, i) ELSE 0.0 END AS daily_trend_slope, count(*) FILTER (total < 5) AS zero_consumption_days, avg(total) AS "mean_daily_L" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY contrato ORDER BY dia) AS DOUBLE) AS i FROM (SELECT contrato, CAST(ts AS DATE) AS dia, sum(litros) AS total FROM household GROUP BY 1, 2)) GROUP BY 1) USING (contrato)"""
_HF_COLS = {"night_flow_ratio": 4, "nocturnal_baseline": 4, "consumption_cv": 4, "daily_trend_slope": 4, "zero_consumption_days": 0, "mean_daily_L": 4}
_add("a8_household_features", household_hourly, HOUSEHOLD, f.household_features, ["contrato"], _HF_COLS, _HF)
_add("m20_household_rules", household_hourly, HOUSEHOLD, lambda d: f.classify_households(f.household_features(d)), ["contrato", "tipo_sospecha"], {"anomaly_score": 4, "alerta": 0},
     f"""SELECT contrato, CASE WHEN best IS NULL THEN 'normal' WHEN a = best THEN 'fuga_fisica' WHEN b = best THEN 'fuga_silenciosa' WHEN c = best THEN 'contador_roto' ELSE 'fraude_contador' END AS tipo_sospecha, coalesce(best, 0) AS anomaly_score, coalesce(best, 0) > 0.3 AS alerta FROM (SELECT *, greatest(a, b, c, d) AS best FROM (SELECT *,
      CASE WHEN night_flow_ratio > 0.5 AND consumption_cv < 0.8 THEN least((night_flow_ratio - 0.5) / 0.5, 1) * 0.5 + least((0.8 - consumption_cv) / 0.8, 1) * 0.3 + least(nocturnal_baseline / 3, 1) * 0.2 END AS a,
      CASE WHEN daily_trend_slope > 2 THEN least(daily_trend_slope / 12, 1) * 0.7 + CASE WHEN night_flow_ratio > 0.3 THEN 0.2 ELSE 0 END END AS b, CASE WHEN zero_consumption_days > 3 THEN least(zero_consumption_days / 10, 1) END AS c,
      CASE WHEN "mean_daily_L" < 40 AND nocturnal_baseline > 0.5 AND consumption_cv < 0.5 THEN greatest(0.4 + least(0.5 - "mean_daily_L" / 100, 0.5), 0) END AS d FROM ({_HF})))""")
_M20 = ORACLE_SQL["m20_household_rules"]
QUERIES["m20_leak_start"] = lambda spark, sf_dir: f.leak_start(household_hourly(spark, sf_dir), f.classify_households(f.household_features(household_hourly(spark, sf_dir))))
ORACLE_SQL["m20_leak_start"] = f"""WITH {HOUSEHOLD}, su AS (SELECT contrato, tipo_sospecha FROM ({_M20})),
dd AS (SELECT contrato, CAST(ts AS DATE) AS d, sum(litros) AS total, avg(litros) FILTER (hour(ts) <= 5) AS night FROM household GROUP BY 1, 2),
dm AS (SELECT *, avg(total) OVER k AS m, stddev_samp(total) OVER k AS s FROM dd WINDOW k AS (PARTITION BY contrato))
SELECT contrato, tipo_sospecha, coalesce(min(d) FILTER ((tipo_sospecha = 'fuga_fisica' AND night > 1) OR (tipo_sospecha = 'fuga_silenciosa' AND total > m + s * 0.5) OR (tipo_sospecha = 'contador_roto' AND total < 5)), min(d)) AS leak_start
FROM dm JOIN su USING (contrato) GROUP BY 1, 2"""
_add("h1_band_power", household_hourly, HOUSEHOLD, lambda d: f.band_power(d, "contrato", "litros"), ["contrato"], {"n": 0, "power_24h": 6, "power_12h": 6},
     "SELECT contrato, n, CASE WHEN e > 0 THEN 2 * (c24 * c24 + s24 * s24) / (n * e) ELSE 0 END AS power_24h, CASE WHEN e > 0 THEN 2 * (c12 * c12 + s12 * s12) / (n * e) ELSE 0 END AS power_12h FROM (SELECT contrato, count(*) AS n, sum(x * x) AS e, sum(x * cos(i * 2 * pi() / 24)) AS c24, sum(x * sin(i * 2 * pi() / 24)) AS s24, sum(x * cos(i * 2 * pi() / 12)) AS c12, sum(x * sin(i * 2 * pi() / 12)) AS s12 FROM (SELECT contrato, litros - avg(litros) OVER (PARTITION BY contrato) AS x, row_number() OVER (PARTITION BY contrato ORDER BY ts) AS i FROM household) GROUP BY 1)")


def _profile(d):
    rows = d.withColumn("h", F.hour("ts")).groupBy("contrato").pivot("h", list(range(24))).agg(F.sum("litros"))
    total = sum((F.coalesce(F.col(str(h)), F.lit(0.0)) for h in range(24)), F.lit(0.0))
    return rows.withColumn("t", total).select("contrato", *(F.when(F.col("t") > 0, F.coalesce(F.col(str(h)), F.lit(0.0)) / F.col("t")).otherwise(0.0).alias(f"h{h}") for h in range(24)))


_add("a29_hour_profile", household_hourly, HOUSEHOLD, _profile, ["contrato"], {f"h{h}": 6 for h in range(24)},
     "SELECT contrato, " + ", ".join(f"CASE WHEN t > 0 THEN h{h} / t ELSE 0 END AS h{h}" for h in range(24)) + " FROM (SELECT contrato, sum(litros) AS t, " + ", ".join(f"coalesce(sum(litros) FILTER (hour(ts) = {h}), 0) AS h{h}" for h in range(24)) + " FROM household GROUP BY 1)")

_FLAGS = """SELECT *, is_zero OR is_extreme_high OR is_extreme_low OR is_delayed AS is_anomaly_reading FROM (SELECT r.*, m3 = 0 AND dias > 30 AS is_zero, m3_per_day > q3 + 3 * (q3 - q1) AND m3_per_day > 0 AS is_extreme_high, m3 < 0 AS is_extreme_low, abs(delay) > 30 AS is_delayed
  FROM readings r JOIN (SELECT mes AS m2, coalesce(quantile_cont(m3_per_day, 0.25) FILTER (m3_per_day > 0), 0) AS q1, coalesce(quantile_cont(m3_per_day, 0.75) FILTER (m3_per_day > 0), 1) AS q3 FROM readings GROUP BY 1) ON m2 = mes)"""
_add("m10_reading_flags", readings, READINGS, r.reading_flags, ["l_orderkey", "l_linenumber"], {"m3_per_day": 6, "is_zero": 0, "is_extreme_high": 0, "is_extreme_low": 0, "is_delayed": 0, "is_anomaly_reading": 0}, _FLAGS)
_PCT = ", ".join(f"avg({c}::INT) * 100 AS {c.replace('is_', 'pct_')}" for c in ("is_zero", "is_extreme_high", "is_extreme_low", "is_delayed", "is_anomaly_reading"))
_add("a5_monthly_reading_stats", readings, READINGS, lambda d: r.monthly_reading_stats(r.reading_flags(d)), ["mes"],
     {"n": 0, "pct_zero": 4, "pct_extreme_high": 4, "pct_extreme_low": 4, "pct_delayed": 4, "pct_anomaly_reading": 4, "m3_mean": 4, "m3_median": 4, "m3_std": 4, "m3_max": 4, "z": 4, "above_2sigma": 0, "is_anomaly": 0},
     f"SELECT *, z > 2 AS above_2sigma, z > 1 OR pct_anomaly_reading > 15 AS is_anomaly FROM (SELECT *, CASE WHEN stddev_samp(pct_anomaly_reading) OVER () > 0 THEN (pct_anomaly_reading - avg(pct_anomaly_reading) OVER ()) / stddev_samp(pct_anomaly_reading) OVER () ELSE 0 END AS z FROM (SELECT mes, count(*) AS n, {_PCT}, avg(m3) AS m3_mean, median(m3) AS m3_median, CASE WHEN count(*) > 1 THEN stddev_samp(m3) END AS m3_std, max(m3) AS m3_max FROM ({_FLAGS}) GROUP BY 1))")
_add("a6_by_periodicity", readings, READINGS, lambda d: r.by_periodicity(r.reading_flags(d)), ["trimestral"], {"n": 0, "pct_anomaly": 4, "m3_mean": 4, "m3_median": 4}, f"SELECT trimestral, count(*) AS n, avg(is_anomaly_reading::INT) * 100 AS pct_anomaly, avg(m3) AS m3_mean, median(m3) AS m3_median FROM ({_FLAGS}) GROUP BY 1")
_add("a15_meter_health", readings, READINGS, r.meter_health, ["mes"], {"n": 0, "pct_zero": 6, "pct_very_low": 6, "pct_high_consumption": 6, "pct_abnormal_days": 6, "median_m3_dia": 6, "pct_suspicious": 6},
     """SELECT mes, count(*) AS n, avg((m3 = 0)::INT) AS pct_zero, avg((m3_per_day > 0 AND m3_per_day < 0.005)::INT) AS pct_very_low, avg((m3_per_day > 3)::INT) AS pct_high_consumption, avg((dias < 15 OR dias > 100)::INT) AS pct_abnormal_days,
       median(m3_per_day) AS median_m3_dia, avg((m3 <= 0 OR dias < 15 OR dias > 45)::INT) AS pct_suspicious FROM readings GROUP BY 1""")
_DIST = """SELECT a.*, gini, entropy, ks FROM (SELECT *, dense_rank() OVER (ORDER BY mes) AS dense FROM (SELECT mes, count(*) AS n_readings, avg((m3 = 0)::INT) * 100 AS pct_zero, avg((m3 < 0)::INT) * 100 AS pct_negative, avg((m3_per_day > (SELECT quantile_cont(m3_per_day, 0.99) FROM readings WHERE m3_per_day > 0))::INT) * 100 AS pct_extreme, avg(delay) AS mean_delay, avg((delay > 5)::INT) * 100 AS pct_late,
   CASE WHEN var_pop(m3_per_day) > 0 THEN (avg(m3_per_day ** 3) - 3 * avg(m3_per_day) * avg(m3_per_day ** 2) + 2 * avg(m3_per_day) ** 3) / var_pop(m3_per_day) ** 1.5 END AS skewness, CASE WHEN var_pop(m3_per_day) > 0 THEN kurtosis_pop(m3_per_day) END AS kurtosis FROM readings GROUP BY 1)) a
 LEFT JOIN (SELECT mes, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT mes, m3_per_day AS x, row_number() OVER (PARTITION BY mes ORDER BY m3_per_day) AS i FROM readings WHERE m3_per_day > 0) GROUP BY 1) g USING (mes)
 LEFT JOIN (SELECT mes, -sum(p * log2(p)) AS entropy FROM (SELECT mes, n / sum(n) OVER (PARTITION BY mes) AS p FROM (SELECT mes, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 50), 49) ELSE 0 END AS b, count(*) AS n FROM (SELECT mes, m3_per_day AS x, min(m3_per_day) OVER (PARTITION BY mes) AS lo, max(m3_per_day) OVER (PARTITION BY mes) AS hi FROM readings WHERE m3_per_day > 0) GROUP BY 1, 2)) GROUP BY 1) e USING (mes)
 LEFT JOIN (SELECT m AS mi, max(gap) AS ks FROM (SELECT m, CASE WHEN na > 0 AND nb > 0 THEN abs(sum(a) OVER w / na - sum(b) OVER w / nb) ELSE 0 END AS gap FROM (
     SELECT *, sum(a) OVER (PARTITION BY m) AS na, sum(b) OVER (PARTITION BY m) AS nb FROM (SELECT k.m, x, count(*) FILTER (d = 0) AS a, count(*) FILTER (d > 0) AS b FROM (
       SELECT m3_per_day AS x, dense_rank() OVER (ORDER BY mes) AS m0 FROM readings), (SELECT unnest(range(0, 7)) AS d), (SELECT unnest(range(1, 5000)) AS m) k WHERE k.m = m0 + d GROUP BY 1, 2)) WINDOW w AS (PARTITION BY m ORDER BY x ROWS UNBOUNDED PRECEDING)) GROUP BY 1) k
   ON mi = dense"""
_DIST_COLS = {"n_readings": 0, "pct_zero": 4, "pct_negative": 4, "pct_extreme": 4, "mean_delay": 4, "pct_late": 4, "skewness": 4, "kurtosis": 4, "gini": 6, "entropy": 6, "ks": 6}
_add("a7_distribution_features", readings, READINGS, r.distribution_features, ["mes"], _DIST_COLS, _DIST)
_Z = ["pct_zero", "pct_negative", "pct_extreme", "gini", "entropy", "mean_delay", "pct_late", "ks", "skewness", "kurtosis"]
_zs = {c: f"abs(CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0 END)" for c in _Z}
_add("m10d_distribution_flags", readings, READINGS, lambda d: r.distribution_flags(r.distribution_features(d), _Z), ["mes"], {"n_anomalous": 0, "score": 4, "is_anomaly": 0},
     f"SELECT mes, len(z) AS n_anomalous, coalesce(list_avg(z), 0) AS score, len(z) >= 3 AS is_anomaly FROM (SELECT mes, list_filter([{', '.join(_zs.values())}], lambda x: x > 2) AS z FROM ({_DIST}))")
