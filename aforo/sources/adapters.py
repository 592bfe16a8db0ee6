"""Roles of the metered-consumption model, taken from the star schema.

Each adapter returns a frame with fixed role columns; each has a SQL twin, a common table expression
of the same name, for the oracles. Joined dimensions are broadcast by Spark where their size allows. Sums of amounts are
rounded to the cents they are made of, so that they do not depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_key(panel: DataFrame) -> DataFrame:
    """barrio_key, and consumption per contract (cpc), which is consumption where there is no contract."""
    return panel.withColumns(
        {
            "barrio_key": F.concat_ws("__", F.trim("barrio"), F.trim("uso")),
            "cpc": F.when(F.col("contratos") > 0, F.col("consumo") / F.col("contratos")).otherwise(F.col("consumo")),
        }
    )


def panel(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """Monthly panel: barrio (region or nation), uso (segment), fecha (month), consumo, contratos."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    barrio = "n_name"
    if grain == "region":
        rows, barrio = rows.join(r, n.n_regionkey == r.r_regionkey), "r_name"
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("fecha")
    grouped = rows.groupBy(F.col(barrio).alias("barrio"), F.col("c_mktsegment").alias("uso"), month)
    return with_key(grouped.agg(F.round(F.sum("o_totalprice"), 2).alias("consumo"), F.countDistinct("o_custkey").cast("double").alias("contratos")))


def _panel_sql(name: str, barrio: str) -> str:
    return f"""
{name} AS (
  SELECT *, barrio || '__' || uso AS barrio_key, CASE WHEN contratos > 0 THEN consumo / contratos ELSE consumo END AS cpc FROM (
    SELECT {barrio} AS barrio, c_mktsegment AS uso, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha,
           round(sum(o_totalprice), 2) AS consumo, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS contratos
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2, 3))"""


PANEL = _panel_sql("panel", "r_name")
SPARSE = _panel_sql("sparse", "n_name")


def sector_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sector flow: sector (event type), ts (hour), caudal."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("sector"), F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.sum("value"), 2).alias("caudal"))


SECTOR = """
sector AS (SELECT event_type AS sector, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS caudal FROM events GROUP BY 1, 2)"""


def household_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly household series on a dense grid (hours without events are 0): contrato, ts, litros.

    The grid spans each contract's own first to last hour, so that it grows with the data, not with the
    product of contracts and hours.
    """
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("contrato"), F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.sum("value"), 2).alias("litros"))
    spans = e.groupBy("contrato").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = spans.select("contrato", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
    return grid.join(e, ["contrato", "ts"], "left").withColumn("litros", F.coalesce("litros", F.lit(0.0)))


HOUSEHOLD = """
hh0 AS (SELECT user_id AS contrato, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS litros FROM events GROUP BY 1, 2),
household AS (
  SELECT g.contrato, g.ts, coalesce(h.litros, 0.0) AS litros
  FROM (SELECT contrato, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hh0 GROUP BY contrato) g
  LEFT JOIN hh0 h ON g.contrato = h.contrato AND g.ts = h.ts)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter readings: mes, m3 (with zero and negative ones), dias, m3_per_day, delay, trimestral."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = l.join(o, l.l_orderkey == o.o_orderkey)
    dias = F.datediff("l_shipdate", "o_orderdate")
    m3 = F.col("l_quantity") - 5
    return rows.select(
        "l_orderkey", "l_linenumber", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("mes"), m3.alias("m3"), dias.alias("dias"),
        (m3 / F.greatest(dias, F.lit(1))).alias("m3_per_day"), (dias - 30).alias("delay"), (F.col("l_returnflag") == "R").alias("trimestral"),
    )


READINGS = """
readings AS (
  SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, l_quantity - 5 AS m3, dias,
         (l_quantity - 5) / greatest(dias, 1) AS m3_per_day, dias - 30 AS delay, l_returnflag = 'R' AS trimestral
  FROM (SELECT *, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS dias
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per barrio (nation): per cent of elderly people (by account balance), and of these who live alone."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    old, alone = F.count_if(F.col("c_acctbal") > 7000), F.count_if(F.col("c_acctbal") > 9000)
    g = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("barrio"))
    return g.agg((100 * old / F.count("*")).alias("pct_65plus"), F.when(old > 0, 100 * alone / old).alias("pct_65plus_solos"))


CENSUS = """
census AS (
  SELECT n_name AS barrio, 100 * count(*) FILTER (c_acctbal > 7000) / count(*) AS pct_65plus,
    CASE WHEN count(*) FILTER (c_acctbal > 7000) > 0 THEN 100 * count(*) FILTER (c_acctbal > 9000) / count(*) FILTER (c_acctbal > 7000) END AS pct_65plus_solos
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"""


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meter per customer: barrio (nation), installed (date of the first order, null without one), uso (segment)."""
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    first = o.groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("installed"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(first, c.c_custkey == first.o_custkey, "left")
    return rows.select(F.col("c_custkey").alias("meter"), F.col("n_name").alias("barrio"), "installed", F.col("c_mktsegment").alias("uso"))


METERS = """
meters AS (
  SELECT c_custkey AS meter, n_name AS barrio, installed, c_mktsegment AS uso
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS installed FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
