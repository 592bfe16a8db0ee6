"""Queries on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from aforo.operators import monthly as m
from aforo.plans.flows import nudge
from aforo.sources.adapters import PANEL, SPARSE, panel

_KEYS = ["barrio_key", "fecha"]


def _q(build, cols: dict[str, int], grain: str = "region"):
    """A query: the operator on the panel, its keys and the named columns rounded."""

    def run(spark, sf_dir):
        df = build(panel(spark, sf_dir, grain))
        return df.select(*_KEYS, *((F.round(F.col(c).cast("double") + nudge(d), d) + 0.0).alias(c) for c, d in cols.items()))

    return run


def _sql(cte: str, body: str, cols: dict[str, int], source: str) -> str:
    return f"WITH {cte}, q AS ({body}) SELECT barrio_key, fecha, {', '.join(f'round(CAST({c} AS DOUBLE) + {nudge(d)!r}, {d}) + 0.0 AS {c}' for c, d in cols.items())} FROM {source}"


QUERIES, ORACLE_SQL = {}, {}


def _add(name, build, cols, body, grain="region"):
    cte, src = (PANEL, "panel") if grain == "region" else (SPARSE, "sparse")
    QUERIES[name] = _q(build, cols, grain)
    ORACLE_SQL[name] = _sql(cte, body.replace("$p", src), cols, "q")


_YOY = "SELECT a.*, CASE WHEN b.consumo > 0 THEN a.consumo / b.consumo ELSE 1.0 END AS yoy_ratio FROM $p a LEFT JOIN $p b ON a.barrio_key = b.barrio_key AND b.fecha = CAST(a.fecha - INTERVAL 1 YEAR AS DATE)"
_SEAS = "SELECT *, CASE WHEN s > 0 THEN (consumo - mu) / s ELSE 0.0 END AS seasonal_zscore FROM (SELECT *, avg(consumo) OVER w AS mu, CASE WHEN count(*) OVER w > 1 THEN stddev_samp(consumo) OVER w END AS s FROM $p WINDOW w AS (PARTITION BY barrio_key, month(fecha)))"
_ABOVE = "SELECT *, sum(a) OVER (PARTITION BY barrio_key, g ORDER BY fecha) AS months_above_mean FROM (SELECT *, sum(1 - a) OVER (PARTITION BY barrio_key ORDER BY fecha) AS g FROM (SELECT *, CAST(consumo > avg(consumo) OVER (PARTITION BY barrio_key) AS INTEGER) AS a FROM $p))"
_TREND = "SELECT *, CASE WHEN n < 2 OR sp = 0 OR mu = 0 THEN 0.0 ELSE sl / mu END AS trend_3m FROM (SELECT *, count(*) OVER w AS n, stddev_pop(cpc) OVER w AS sp, avg(cpc) OVER w AS mu, regr_slope(cpc, i) OVER w AS sl FROM (SELECT *, CAST(row_number() OVER (PARTITION BY barrio_key ORDER BY fecha) AS DOUBLE) AS i FROM $p) WINDOW w AS (PARTITION BY barrio_key ORDER BY fecha ROWS 2 PRECEDING))"
_MED = f"SELECT *, yoy_ratio - group_yoy_median AS deviation_from_group_trend FROM (SELECT *, median(yoy_ratio) OVER (PARTITION BY uso, fecha) AS group_yoy_median FROM ({_YOY}))"
_LAGS = f"""SELECT *, coalesce(lag(cpc, 1) OVER s, cpc) AS lag_1, coalesce(lag(cpc, 2) OVER s, cpc) AS lag_2, coalesce(lag(cpc, 12) OVER s, cpc) AS lag_12,
  ln(1 + greatest(cpc, 0)) AS log_consumption, avg(cpc) OVER w3 AS rolling_mean_3, avg(cpc) OVER w6 AS rolling_mean_6,
  CASE WHEN count(*) OVER w3 > 1 THEN stddev_samp(cpc) OVER w3 ELSE 0.0 END AS rolling_std_3,
  CASE WHEN count(*) OVER w3 > 1 AND avg(cpc) OVER w3 > 0 THEN stddev_samp(cpc) OVER w3 / avg(cpc) OVER w3 ELSE 0.0 END AS consumption_volatility,
  CASE WHEN lag(cpc) OVER s > 0 THEN (cpc - lag(cpc) OVER s) / lag(cpc) OVER s ELSE 0.0 END AS momentum,
  coalesce(yoy_ratio - lag(yoy_ratio) OVER s, 0.0) AS yoy_acceleration
  FROM ({_YOY}) WINDOW s AS (PARTITION BY barrio_key ORDER BY fecha), w3 AS (PARTITION BY barrio_key ORDER BY fecha ROWS 2 PRECEDING), w6 AS (PARTITION BY barrio_key ORDER BY fecha ROWS 5 PRECEDING)"""

_add("p1_consumption_per_contract", lambda df: df, {"consumo": 4, "cpc": 4}, "SELECT * FROM $p")
_add("w1_yoy_ratio", m.yoy_ratio, {"yoy_ratio": 6}, _YOY)
_add("j1_yoy_ratio_sparse", m.yoy_ratio, {"yoy_ratio": 6}, _YOY, "nation")
_add("w2_seasonal_zscore", m.seasonal_zscore, {"seasonal_zscore": 6}, _SEAS)
_add(
    "w2_seasonal_zscore_cutoff", lambda df: m.seasonal_zscore(df, "1999-01-01"), {"seasonal_zscore": 6},
    "SELECT *, CASE WHEN s > 0 THEN (consumo - mu) / s ELSE 0.0 END AS seasonal_zscore FROM (SELECT *, avg(x) OVER w AS mu, CASE WHEN count(x) OVER w > 1 THEN stddev_samp(x) OVER w END AS s FROM (SELECT *, CASE WHEN fecha < DATE '1999-01-01' THEN consumo END AS x FROM $p) WINDOW w AS (PARTITION BY barrio_key, month(fecha)))",
)
_add("w3_cross_sectional_zscore", m.cross_sectional_zscore, {"cross_sectional_zscore": 6},
     "SELECT *, CASE WHEN s > 0 THEN (cpc - mu) / s ELSE 0.0 END AS cross_sectional_zscore FROM (SELECT *, avg(cpc) OVER w AS mu, CASE WHEN count(*) OVER w > 1 THEN stddev_samp(cpc) OVER w END AS s FROM $p WINDOW w AS (PARTITION BY uso, fecha))", "nation")
_add("w4_type_percentile", m.type_percentile, {"type_percentile": 6}, "SELECT *, cume_dist() OVER (PARTITION BY uso, fecha ORDER BY cpc) AS type_percentile FROM $p", "nation")
_add("w5_trend_3m", m.trend_3m, {"trend_3m": 6}, _TREND)
_add("w6_months_above_mean", m.months_above_mean, {"months_above_mean": 0}, _ABOVE)
_add("w7_group_trend_deviation", m.group_trend_deviation, {"group_yoy_median": 6, "deviation_from_group_trend": 6}, _MED, "nation")
_add("w8_relative_consumption", m.relative_consumption, {"relative_consumption": 6}, "SELECT *, CASE WHEN g > 0 THEN cpc / g ELSE 1.0 END AS relative_consumption FROM (SELECT *, median(cpc) OVER (PARTITION BY uso, fecha) AS g FROM $p)", "nation")
_add("w9_persistence", m.persistence, {"zscore_rolling_3m": 6, "above_mean_streak": 0, "trend_accel": 4},
     f"SELECT z.*, avg(z.seasonal_zscore) OVER w3 AS zscore_rolling_3m, sum(b.months_above_mean) OVER w6 AS above_mean_streak, coalesce(z.cpc - 2 * lag(z.cpc, 1) OVER s + lag(z.cpc, 2) OVER s, 0.0) AS trend_accel FROM ({_SEAS}) z JOIN ({_ABOVE}) b ON z.barrio_key = b.barrio_key AND z.fecha = b.fecha WINDOW s AS (PARTITION BY z.barrio_key ORDER BY z.fecha), w3 AS (PARTITION BY z.barrio_key ORDER BY z.fecha ROWS 2 PRECEDING), w6 AS (PARTITION BY z.barrio_key ORDER BY z.fecha ROWS 5 PRECEDING)")
_LAG_COLS = {"lag_1": 4, "lag_2": 4, "lag_12": 4, "log_consumption": 6, "rolling_mean_3": 4, "rolling_mean_6": 4, "rolling_std_3": 4, "consumption_volatility": 6, "momentum": 6, "yoy_acceleration": 6}
_add("w10_lags", m.lags, _LAG_COLS, _LAGS)
_add("w10_lags_sparse", m.lags, _LAG_COLS, _LAGS, "nation")
_add("w11_fourier", m.fourier, {"sin_month": 6, "cos_month": 6, "sin_quarter": 6, "cos_quarter": 6, "consumption_x_contracts": 6},
     "SELECT *, sin(2 * pi() * month(fecha) / 12) AS sin_month, cos(2 * pi() * month(fecha) / 12) AS cos_month, sin(2 * pi() * month(fecha) / 6) AS sin_quarter, cos(2 * pi() * month(fecha) / 6) AS cos_quarter, ln(1 + greatest(cpc, 0)) * ln(1 + greatest(contratos, 1)) AS consumption_x_contracts FROM $p")


def _external(df):
    """A made climate: a yearly wave, occupancy by month, an index known in even months only."""
    month = F.month("fecha")
    return m.external_adjusted(
        df.withColumns(
            {
                "avg_temp": F.when(month != 5, 18 + 20 * F.cos((month - 7) * 3.141592653589793 / 6)),
                "tourist_occupancy_pct": F.when(month != 2, 7.0 * month),
                "spei_index": F.when(month % 2 == 0, (month - 6) / 4),
            }
        )
    )


_add("w12_external_adjusted", _external, {"temp_adjusted_consumption": 7, "tourism_adjusted_consumption": 7, "spei_index": 4},
     """SELECT *, cpc / CASE WHEN month(fecha) = 5 THEN 1 ELSE greatest(1 + 0.03 * (20 * cos((month(fecha) - 7) * pi() / 6)), 0.5) END AS temp_adjusted_consumption,
       cpc / CASE WHEN month(fecha) = 2 THEN 1 ELSE 1 + 0.002 * 7.0 * month(fecha) END AS tourism_adjusted_consumption, CASE WHEN month(fecha) % 2 = 0 THEN (month(fecha) - 6) / 4 ELSE 0 END AS spei_index FROM $p""")
_DROPS = """SELECT *, CASE WHEN n > 0 THEN t / n ELSE 0.0 END AS drop_severity FROM (SELECT *,
  (mom_change < 0)::INT + (hist_change < 0)::INT + (seasonal_change < 0)::INT + (zscore_historical < -1.5)::INT AS n,
  CASE WHEN mom_change < 0 THEN least(-mom_change, 1.0) ELSE 0 END + CASE WHEN hist_change < 0 THEN least(-hist_change, 1.0) ELSE 0 END + CASE WHEN seasonal_change < 0 THEN least(-seasonal_change, 1.0) ELSE 0 END + CASE WHEN zscore_historical < -1.5 THEN least(-zscore_historical / 4, 1.0) ELSE 0 END AS t
  FROM (SELECT *, CASE WHEN pv > 0 THEN (cpc - pv) / pv ELSE 0.0 END AS mom_change, CASE WHEN past > 0 THEN (cpc - past) / past ELSE 0.0 END AS hist_change,
    CASE WHEN py > 0 THEN (cpc - py) / py ELSE 0.0 END AS seasonal_change, CASE WHEN sd > 0 AND i >= 3 THEN (cpc - past) / sd ELSE 0.0 END AS zscore_historical,
    CASE WHEN NOT coalesce(cpc < p1, false) THEN 0 WHEN NOT coalesce(p1 < p2, false) THEN 1 WHEN NOT coalesce(p2 < p3, false) THEN 2 WHEN NOT coalesce(p3 < p4, false) THEN 3 WHEN NOT coalesce(p4 < p5, false) THEN 4 WHEN NOT coalesce(p5 < p6, false) THEN 5 ELSE 6 END AS consecutive_decline
    FROM (SELECT *, CASE WHEN i >= 3 THEN avg(cpc) OVER (PARTITION BY barrio_key ORDER BY fecha ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) ELSE avg(body) OVER (PARTITION BY barrio_key) END AS past, stddev_pop(body) OVER (PARTITION BY barrio_key) AS sd
      FROM (SELECT *, CASE WHEN i < cnt - 1 THEN cpc END AS body FROM (SELECT *, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY barrio_key) AS cnt, lag(cpc, 1) OVER s AS pv, lag(cpc, 12) OVER s AS py,
        lag(cpc, 1) OVER s AS p1, lag(cpc, 2) OVER s AS p2, lag(cpc, 3) OVER s AS p3, lag(cpc, 4) OVER s AS p4, lag(cpc, 5) OVER s AS p5, lag(cpc, 6) OVER s AS p6 FROM $p WINDOW s AS (PARTITION BY barrio_key ORDER BY fecha)) WHERE cnt >= 3))))"""
_add("w15_consumption_drops", m.consumption_drops, {"mom_change": 6, "hist_change": 6, "seasonal_change": 6, "zscore_historical": 6, "consecutive_decline": 0, "drop_severity": 6}, _DROPS)
_M5 = f"""SELECT *, (is_3sigma OR is_iqr) AND abs(deviation_from_group_trend) >= 0.10 AS is_anomaly FROM (
  SELECT d.*, sg > 0 AND abs(deviation_from_group_trend - mu) > 3 * sg AS is_3sigma, q3 > q1 AND (deviation_from_group_trend < q1 - 1.5 * (q3 - q1) OR deviation_from_group_trend > q3 + 1.5 * (q3 - q1)) AS is_iqr
  FROM (SELECT *, dense_rank() OVER (ORDER BY fecha) AS nth, (SELECT count(DISTINCT fecha) FROM $p) AS months FROM ({_MED})) d
  JOIN (SELECT barrio_key AS bk, count(*) AS n, avg(deviation_from_group_trend) AS mu, stddev_pop(deviation_from_group_trend) AS sg, quantile_cont(deviation_from_group_trend, 0.25) AS q1, quantile_cont(deviation_from_group_trend, 0.75) AS q3
    FROM (SELECT *, dense_rank() OVER (ORDER BY fecha) AS nth, (SELECT count(DISTINCT fecha) FROM $p) AS months FROM ({_MED})) WHERE nth <= least(24, floor(months * 0.7)) GROUP BY 1) s ON bk = barrio_key
  WHERE nth > least(24, floor(months * 0.7)) AND n >= 6)"""
_add("m5_statistical_flags", m.deviation_flags, {"deviation_from_group_trend": 6, "is_3sigma": 0, "is_iqr": 0, "is_anomaly": 0}, _M5, "nation")
