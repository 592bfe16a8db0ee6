"""Readers of the other input files: each gives typed columns, malformed values become null or what the description says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.functions import ladders
from aforo.operators import geometry
from aforo.operators.audit import spanish_month
from aforo.sources.parsing import clean_name, esri_features


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.toDF(*(c.strip() for c in raw.columns))


def _dotted(x: Column) -> Column:
    """``1.111,40`` as a number: dots part thousands, the comma decimals."""
    return F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".").try_cast("double")


def sector_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Sector layer: name, barrio, elevation (least, mean, greatest), area and centroid of the first ring."""
    f = esri_features(spark, path, "DCONS_PO_2: string, AMAEMID: string, COTA_MINIM: double, COTA_MEDIA: double, COTA_MAXIM: double")
    ring = F.transform(F.col("geometry.rings")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    f = f.withColumn("ring", ring).filter(F.size("ring") > 0)
    return f.select(
        F.col("AMAEMID").alias("name"), clean_name(F.col("DCONS_PO_2")).alias("barrio"), F.col("COTA_MINIM").alias("elevation_min"), F.col("COTA_MEDIA").alias("elevation_mean"), F.col("COTA_MAXIM").alias("elevation_max"),
        geometry.area(F.col("ring")).alias("area_m2"), geometry.centroid(F.col("ring")).alias("centroid"), "ring",
    )


def network_stats(spark: SparkSession, path: str) -> DataFrame:
    """Network length and inspected length a year (columns by place), coverage in per cent, 200 at most."""
    raw = _csv(spark, path)
    year, length, seen = (F.col(f"`{raw.columns[i]}`") for i in (0, 2, 3))
    out = raw.select(year.try_cast("int").alias("year"), _dotted(length).alias("network_length_km"), _dotted(seen).alias("inspected_km"))
    share = F.when(F.col("network_length_km") > 0, F.least(F.col("inspected_km") / F.col("network_length_km") * 100, F.lit(200.0))).otherwise(0.0)
    return out.withColumn("inspection_coverage_pct", share)


def treatment_plant(spark: SparkSession, path: str) -> DataFrame:
    """Treated and reused water a month (columns by place, Spanish month names), and their ratio; other rows are left out."""
    raw = _csv(spark, path)
    year, month, treated, reused = (F.col(f"`{c}`") for c in raw.columns[:4])
    out = raw.select(spanish_month(year.try_cast("int"), month).alias("fecha"), treated.try_cast("double").alias("treated_m3"), reused.try_cast("double").alias("reused_m3")).filter("fecha IS NOT NULL")
    return out.withColumn("reuse_ratio", F.when(F.col("treated_m3") > 0, F.col("reused_m3") / F.col("treated_m3")).otherwise(0.0))


def counter_changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes of meters: fecha, motive, place, calibre; header rows inside the file and rows without a date are left out."""
    raw = _csv(spark, path)
    out = raw.filter("FECHA <> 'FECHA'").select(F.expr("try_to_date(FECHA)").alias("fecha"), F.col("MOTIVO_CAMBIO").alias("motivo"), F.col("EMPLAZAMIENTO").alias("emplazamiento"), F.col("CALIBRE").try_cast("int").alias("calibre"))
    return out.filter("fecha IS NOT NULL")


def meter_registry(spark: SparkSession, path: str) -> DataFrame:
    """Meters: barrio, street, calibre, installed (dd/MM/yyyy), whether it is read remotely, use, activity."""
    raw = _csv(spark, path).filter("BARRIO <> 'BARRIO'")
    return raw.select(
        F.col("BARRIO").alias("barrio"), F.col("CALLE").alias("calle"), F.col("CALIBRE").try_cast("int").alias("calibre"), F.expr("try_to_date(`FECHA INSTALACION`, 'dd/MM/yyyy')").alias("installed"),
        (F.col("SISTEMA") == "Leer por telelectura").alias("smart"), F.col("USO").alias("uso"), F.col("ACTIVIDAD").alias("actividad"),
    )


def ndvi(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).select("barrio", *(F.col(c).try_cast("double").alias(n) for n, c in (("ndvi_summer", "ndvi_summer_2024"), ("ndvi_winter", "ndvi_winter_2024"), ("ndvi_anomaly", "ndvi_anomaly_2024"))))


def tourist_dwellings(spark: SparkSession, path: str) -> DataFrame:
    """Per postal code (five digits): dwellings, places, dwellings over the greatest number."""
    raw = _csv(spark, path, ";")
    code = F.lpad(F.split(F.col("cp"), r"\.")[0], 5, "0")
    g = raw.groupBy(code.alias("barrio_cp")).agg(F.count("signatura").alias("n_viviendas"), F.sum(F.col("plazas_totales").try_cast("double")).alias("plazas_totales"))
    most = g.agg(F.max("n_viviendas").alias("_m"))
    return g.crossJoin(F.broadcast(most)).withColumn("vt_pressure", F.when(F.col("_m") > 0, F.col("n_viviendas") / F.col("_m")).otherwise(0.0)).drop("_m")  # one row


def income(spark: SparkSession, path: str) -> DataFrame:
    """Mean income per district, its z-score among districts, its tier; rows without a district are left out."""
    raw = _csv(spark, path).filter("distrito IS NOT NULL AND distrito <> ''")
    g = raw.groupBy(F.col("distrito").alias("barrio")).agg(F.avg(F.col("renta_media").try_cast("double")).alias("renta_media"))
    stats = g.agg(F.avg("renta_media").alias("_m"), F.stddev_samp("renta_media").alias("_s"))
    g = g.crossJoin(F.broadcast(stats))  # one row
    return g.select("barrio", "renta_media", F.when(F.col("_s") > 0, (F.col("renta_media") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("renta_zscore"), ladders.income_tier(F.col("renta_media")).alias("renta_nivel"))


def household_buildings(spark: SparkSession, path: str) -> DataFrame:
    numbers = ("building_m2", "construction_year", "age_factor", "occupancy_estimate", "expected_monthly_L", "actual_monthly_L", "consumption_efficiency_ratio", "pipe_risk_score")
    return _csv(spark, path).select("contrato_id", "barrio", "uso", *(F.col(c).try_cast("double").alias(c) for c in numbers))


def household_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Age of the holder, whether they live alone, people in the household; names, phones and addresses are never read."""
    return _csv(spark, path).select("contrato_id", "barrio", F.col("edad_titular").try_cast("int").alias("edad_titular"), F.lower("vive_solo").try_cast("boolean").alias("vive_solo"), F.col("n_personas_hogar").try_cast("int").alias("n_personas_hogar"))


def elderly_census(spark: SparkSession, path: str) -> DataFrame:
    """Per barrio: people, per cent of 65 and 80 and more, per cent of these who live alone."""
    raw = _csv(spark, path)
    return raw.select(F.upper(F.trim("barrio_padron")).alias("barrio"), *(F.col(c).try_cast("double").alias(c) for c in ("poblacion_total", "pct_65plus", "pct_80plus", "pct_65plus_solos", "pct_80plus_solos")))
