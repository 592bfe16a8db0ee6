"""Readers on small files as the raw inputs write them; geometry, feedback and household factors on small frames."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from aforo.operators import geometry, validation
from aforo.sources import files, parsing
from aforo.streaming import flows as stream
from pyspark.sql import functions as F


def put(path, text):
    path.write_text(text)
    return str(path)


def test_hourly_files(spark, tmp_path):
    p = put(tmp_path / "d.csv", "CUPS;Fecha;Hora;Consumo_KWh;Metodo_obtencion\nx;2024/03/01;1;0.5;R\nx;2024/03/01;24;1.25;R\nx;bad;2;y;R\n")
    rows = parsing.semicolon_hourly_csv(spark, p).collect()
    assert [tuple(r) for r in rows] == [(datetime.datetime(2024, 3, 1, 0), 0.5), (datetime.datetime(2024, 3, 1, 23), 1.25), (None, None)]
    p = put(tmp_path / "s.csv", "LCLid,tstp,energy(kWh/hh)\nM,2012-10-12 00:30:00,0.25\nM,2012-10-12 01:00:00,Null\n")
    assert [tuple(r) for r in parsing.smart_meter_csv(spark, p).collect()] == [(datetime.datetime(2012, 10, 12, 0, 30), 0.25), (datetime.datetime(2012, 10, 12, 1), 0.0)]


def test_city_files(spark, tmp_path):
    p = put(tmp_path / "n.csv", '"AÑO",EXPLOTACION,A,B\n2023,X,"1.111,40","2.500,10"\n2024,X,"0","5"\n')
    rows = files.network_stats(spark, p).orderBy("year").collect()
    assert (rows[0].network_length_km, rows[0].inspected_km, rows[0].inspection_coverage_pct, rows[1].inspection_coverage_pct) == (1111.40, 2500.10, 200.0, 0.0)
    p = put(tmp_path / "t.csv", "AÑO,MES,T,R\n2024,Marzo ,200,50\n2024,Total,1,1\n2024,Abril,0,0\n")
    assert [tuple(r) for r in files.treatment_plant(spark, p).orderBy("fecha").collect()] == [(datetime.date(2024, 3, 1), 200.0, 50.0, 0.25), (datetime.date(2024, 4, 1), 0.0, 0.0, 0.0)]
    p = put(tmp_path / "c.csv", "EXPLOTACION,FECHA,MOTIVO_CAMBIO,EMPLAZAMIENTO,CALIBRE\nX,2024-01-05,FP-FRAUDE POSIBLE,A,13\nEXPLOTACION,FECHA,MOTIVO_CAMBIO,EMPLAZAMIENTO,CALIBRE\nX,bad,RB-ROBO,B,x\n")
    assert [tuple(r) for r in files.counter_changes(spark, p).collect()] == [(datetime.date(2024, 1, 5), "FP-FRAUDE POSIBLE", "A", 13)]
    p = put(tmp_path / "r.csv", "EXPLOTACION,LOCALIDAD,BARRIO,CALLE,CALIBRE,FECHA INSTALACION,SISTEMA,USO,ACTIVIDAD\nX,L,5-A,C,13,31/12/2014,Leer por telelectura,U,VIVIENDA\nX,L,BARRIO,C,13,1,2,3,4\nX,L,5-B,C,13,,Manual,U,VIVIENDA\n")
    assert [(r.barrio, r.installed, r.smart) for r in files.meter_registry(spark, p).collect()] == [("5-A", datetime.date(2014, 12, 31), True), ("5-B", None, False)]


def test_external_files(spark, tmp_path):
    p = put(tmp_path / "v.csv", "signatura;cp;plazas_totales\na;3001.0;4\nb;3001;x\nc;03002;2\n")
    assert {r.barrio_cp: (r.n_viviendas, r.plazas_totales, r.vt_pressure) for r in files.tourist_dwellings(spark, p).collect()} == {"03001": (2, 4.0, 1.0), "03002": (1, 2.0, 0.5)}
    p = put(tmp_path / "i.csv", "municipio,distrito,seccion,renta_media,anyo\nA,1,,8000,2023\nA,1,2,9000,2023\nA,2,,20000,2023\nA,,,1,2023\n")
    got = {r.barrio: (r.renta_media, r.renta_nivel, round(r.renta_zscore, 6)) for r in files.income(spark, p).collect()}
    assert got == {"1": (8500.0, "muy_baja", round(-1 / math.sqrt(2), 6)), "2": (20000.0, "alta", round(1 / math.sqrt(2), 6))}
    p = put(tmp_path / "b.csv", "barrio,ndvi_summer_2024,ndvi_winter_2024,ndvi_anomaly_2024\nA,0.1,x,0.3\n")
    assert tuple(files.ndvi(spark, p).collect()[0]) == ("A", 0.1, None, 0.3)
    p = put(tmp_path / "h.csv", "contrato_id,nombre,telefono,barrio,edad_titular,vive_solo,n_personas_hogar\nC1,secret,1,A,81,True,1\n")
    df = files.household_profiles(spark, p)
    assert df.columns == ["contrato_id", "barrio", "edad_titular", "vive_solo", "n_personas_hogar"] and tuple(df.collect()[0]) == ("C1", "A", 81, True, 1)
    p = put(tmp_path / "e.csv", "barrio_padron,poblacion_total,pct_65plus,pct_80plus,pct_65plus_solos,pct_80plus_solos\n San Blas,100,20.5,5,30,\n")
    assert tuple(files.elderly_census(spark, p).collect()[0]) == ("SAN BLAS", 100.0, 20.5, 5.0, 30.0, None)
    names = "contrato_id,barrio,uso,building_m2,construction_year,age_factor,occupancy_estimate,expected_monthly_L,actual_monthly_L,consumption_efficiency_ratio,pipe_risk_score"
    p = put(tmp_path / "k.csv", names + "\nC1,A,D,80,1970,1,2,100,200,2.0,0.5\n")
    assert files.household_buildings(spark, p).collect()[0].consumption_efficiency_ratio == 2.0


def test_sector_layer(spark, tmp_path):
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    p = put(tmp_path / "s.json", json.dumps({"features": [{"attributes": {"DCONS_PO_2": "5-Centro", "AMAEMID": "S1", "COTA_MINIM": 1, "COTA_MEDIA": 2.5, "COTA_MAXIM": 4}, "geometry": {"rings": [ring]}}, {"attributes": {"AMAEMID": "S2"}, "geometry": {}}]}))
    rows = files.sector_polygons(spark, p).collect()
    assert len(rows) == 1 and (rows[0].name, rows[0].barrio, rows[0].elevation_mean, rows[0].area_m2) == ("S1", "CENTRO", 2.5, 100.0)


def forward(lon, lat, central=-3.0):
    """Transverse Mercator by Krueger's forward series."""
    n = geometry._F / (2 - geometry._F)
    a = geometry._A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = math.radians(lat), math.radians(lon - central)
    c = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    e = eta + sum(al * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, al in enumerate(alpha, 1))
    north = xi + sum(al * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, al in enumerate(alpha, 1))
    return 500000 + 0.9996 * a * e, 0.9996 * a * north


def test_degrees_and_geojson(spark):
    places = [(-0.48, 38.35), (-3.0, 0.0), (-5.9, 43.0), (0.0, 60.0)]
    df = spark.createDataFrame([(i, *forward(*p)) for i, p in enumerate(places)], "i int, x double, y double")
    got = {r.i: (r.p.lon, r.p.lat) for r in df.select("i", geometry.utm_to_degrees(F.col("x"), F.col("y")).alias("p")).collect()}
    assert all(got[i] == pytest.approx(p, abs=1e-7) for i, p in enumerate(places))
    ring = [forward(*p) for p in places[:3]]
    df = spark.createDataFrame([(ring,)], "ring array<struct<x: double, y: double>>").select(geometry.to_geojson(F.col("ring")).alias("j"), geometry.midpoint(F.col("ring")).alias("m"), geometry.endpoints(F.col("ring")).alias("e"))
    r = df.select("*", geometry.geojson_centroid(F.col("j")).alias("c")).collect()[0]
    assert json.loads(r.j)["type"] == "Polygon" and (r.c.x, r.c.y) == pytest.approx((np.mean([p[0] for p in places[:3]]), np.mean([p[1] for p in places[:3]])), abs=1e-6)
    assert (r.m.x, r.e.first.y, r.e.last.x) == pytest.approx((ring[1][0], ring[0][1], ring[2][0]))


def test_threshold_feedback_over_batches(spark, tmp_path):
    rng = random.Random(1)
    start, labels = datetime.datetime(2024, 1, 1), []
    for i in range(120):
        user = rng.randrange(4)
        labels.append((user, start + datetime.timedelta(minutes=i), i, rng.random() < (0.9, 0.0, 0.4, 0.1)[user]))
    schema = "user_id long, ts timestamp, event_id long, is_false boolean"
    for part in (labels[:50], labels[50:]):  # two micro-batches
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.user_id: (r.n_labels, r.share_false, r.threshold) for r in stream.run(spark, stream.threshold_feedback(frame)).collect()}
    for user in range(4):
        n = false = 0
        threshold = -0.1
        for _, _, _, bad in (x for x in labels if x[0] == user):
            n, false = n + 1, false + bad
            if n >= 10 and n % 5 == 0:
                threshold = stream.adjusted(threshold, false / n)
        assert got[user] == pytest.approx((n, false / n, threshold))
    assert stream.adjusted(-0.49, 1.0) == -0.5 and stream.adjusted(-0.021, 0.0) == -0.02 and stream.adjusted(-0.1, 0.3) == -0.1


def test_household_factors_equal_ridge(spark):
    rng = np.random.default_rng(2)
    rows = [(c, "ab"[c % 2], "xy"[c % 3 == 0], h, 50.0 + c, float(5 + 2 * (h == 1) + 0.1 * c + rng.normal() + 3 * (c == 7)), c == 7) for c in range(12) for h in list(range(3)) * 4]
    df = spark.createDataFrame(rows, "c int, barrio string, uso string, hour int, m2 double, y double, leak boolean")
    got = {r.c: r for r in validation.household_factors(df, "c", "y", {"hour": [0, 1, 2], "uso": ["x", "y"]}, ["m2"], "leak").collect()}
    x = np.array([[*(float(h == k) for k in range(3)), float(u == "x"), float(u == "y"), m] for _, _, u, h, m, _, _ in rows])
    y, c, leak = np.array([r[5] for r in rows]), np.array([r[0] for r in rows]), np.array([r[6] for r in rows])
    xt, yt = x[~leak], y[~leak]
    mx, my = xt.mean(0), yt.mean()
    w = np.linalg.solve((xt - mx).T @ (xt - mx) + np.eye(6), (xt - mx).T @ (yt - my))
    res = y - ((x - mx) @ w + my)
    for k in range(12):
        r = res[c == k]
        assert (got[k].mean_residual, got[k].std_residual, got[k].mean_abs_residual, got[k].max_residual) == pytest.approx((r.mean(), r.std(ddof=1), abs(r).mean(), r.max()), abs=1e-5)
    means = np.array([res[c == k].mean() for k in range(12)])
    assert got[7].residual_zscore == pytest.approx((means[7] - means.mean()) / means.std(ddof=1), abs=1e-4) and sum(r.is_anomaly for r in got.values()) in (1, 2)


def test_name_matching(spark):
    sectors = spark.createDataFrame([("San Blas",), ("PLAYA NORTE",), ("Nowhere",), ("AB",)], "sector string")
    barrios = spark.createDataFrame([("12-S. BLAS",), ("7-Playa Norte Alta",), ("AB",), ("9-PL. NORTE",)], "barrio string")
    assert {r.sector: r.barrio for r in validation.match_names(sectors, barrios).collect()} == {"San Blas": "12-S. BLAS", "PLAYA NORTE": "7-Playa Norte Alta", "AB": "AB"}


def test_nearest_normal_and_hits(spark):
    normals = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 100.0), ("c", 10.0, 100.0), ("d", 20.0, 50.0)], "k string, x double, y double")
    asked = spark.createDataFrame([("q", 9.0, 90.0), ("r", 1.0, 1.0)], "k string, x double, y double")
    assert {r.anomaly: r.nearest for r in validation.nearest_normal(asked, normals, "k", ["x", "y"]).collect()} == {"q": "b", "r": "a"}
    df = spark.createDataFrame([("a", 3, 1), ("b", 2, 3), ("c", 1, 2)], "k string, x int, y int")
    assert validation.hit_rate(df, "k", "x", "y", 2).collect()[0].hit_rate == 0.5
