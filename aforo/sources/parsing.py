"""Numbers, dates and files as the raw inputs write them; one parser for each convention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def thousands_comma(x: Column) -> Column:
    """``"29,205,005"`` as a number; what is none becomes 0."""
    return F.coalesce(F.regexp_replace(x, '[",]', "").try_cast("double"), F.lit(0.0))


def decimal_comma(x: Column) -> Column:
    """``1111,40`` as a number, null if it is none."""
    return F.regexp_replace(x, ",", ".").try_cast("double")


def year_with_dot(x: Column) -> Column:
    """``2.020`` as a year."""
    return F.round(x.try_cast("double") * 1000).cast("int")


def day_first(x: Column) -> Column:
    """``1/12/2024 0:00`` as a timestamp without zone."""
    return F.try_to_timestamp(x, F.lit("d/M/yyyy H:mm")).cast("timestamp_ntz")


def period_month(x: Column) -> Column:
    """``2024 -  01`` as the first of the month."""
    return F.make_date(F.regexp_extract(x, r"(\d{4})", 1).try_cast("int"), F.regexp_extract(x, r"-\s*(\d{1,2})", 1).try_cast("int"), F.lit(1))


def clean_name(x: Column) -> Column:
    """Without a leading number and dash, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(x, r"^\d+-", "")))


def finite(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """``df`` with the column, constant if it was not there."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def monthly_csv(spark: SparkSession, path: str) -> DataFrame:
    """The monthly panel file: columns found by parts of their names, thousands commas, dates yyyy/MM/dd."""
    raw = spark.read.option("header", True).csv(path)
    roles = {}
    for c in raw.columns:
        low = c.strip().lower()
        for role, parts in (("barrio", ("barrio", "zona")), ("uso", ("uso",)), ("fecha", ("fecha",)), ("consumo", ("consumo",)), ("contratos", ("contrato", "nº"))):
            if role not in roles and any(p in low for p in parts):
                roles[role] = F.col(f"`{c}`")
                break
    return raw.select(
        F.trim(roles["barrio"]).alias("barrio"), F.trim(roles["uso"]).alias("uso"), F.try_to_timestamp(roles["fecha"], F.lit("yyyy/MM/dd")).cast("date").alias("fecha"),
        thousands_comma(roles["consumo"]).alias("consumo"), thousands_comma(roles["contratos"]).alias("contratos"),
    )


def sector_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sector flow file: day-first times, decimal commas; sector, ts, caudal."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.trim("SECTOR").alias("sector"), day_first(F.col("FECHA_HORA")).alias("ts"), decimal_comma(F.col("`CAUDAL MEDIO(M3)`")).alias("caudal"))


def semicolon_hourly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon file of hourly use, dates yyyy/MM/dd and hours 1 to 24: ts (the hour's beginning), consumption."""
    raw = spark.read.option("header", True).option("sep", ";").option("ignoreLeadingWhiteSpace", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    day = F.try_to_timestamp("Fecha", F.lit("yyyy/MM/dd"))
    hour = F.col("Hora").try_cast("int") - 1
    return raw.select((day.cast("timestamp_ntz") + F.make_dt_interval(hours=hour)).alias("ts"), F.col("Consumo_KWh").try_cast("double").alias("consumption"))


def smart_meter_csv(spark: SparkSession, path: str) -> DataFrame:
    """Half-hourly smart meter file: ts, consumption (0 where it is no number)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.to_timestamp_ntz("tstp").alias("ts"), F.coalesce(F.col("`energy(kWh/hh)`").try_cast("double"), F.lit(0.0)).alias("consumption"))


def readings_csv(spark: SparkSession, pattern: str, year: int | None = None) -> DataFrame:
    """All yearly reading files of a glob, header names made upper case, the year taken from the file's name.

    A wanted year prunes by file name before rows are parsed.
    """
    raw = spark.read.option("header", True).csv(pattern).withColumn("year", F.regexp_extract("_metadata.file_name", r"(20\d{2})", 1).try_cast("int"))
    if year is not None:
        raw = raw.filter(F.col("year") == year)
    return raw.toDF(*(c if c == "year" else c.strip().upper() for c in raw.columns))


def esri_features(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    """Features of an ESRI JSON file: the attributes (a DDL of their fields) and the geometry."""
    schema = f"features array<struct<attributes: struct<{attributes}>, geometry: struct<x: double, y: double, rings: array<array<array<double>>>, paths: array<array<array<double>>>>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.attributes.*", "f.geometry")


def month_spine(start: Column, end: Column) -> Column:
    """Array of month starts from one date to another."""
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
