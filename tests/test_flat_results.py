"""Detectors that never fire: their flags do not vary, and measures of them are what the queries' SQL says."""

import datetime
import math
import shutil

import duckdb
import pytest

from aforo.operators import audit, ensemble, statistics
from aforo.plans import registry

SF = "/root/testdata/sf0.001"
FLAT = ["c14_decay_status", "c23_reading_correlation", "q3_flag_correlation", "e13_binary_metrics"]


@pytest.fixture(scope="module")
def quiet(tmp_path_factory):
    """Customers of all nations with one order and one line a month; one customer pays by the month, so that all but the deviation and year flags vary."""
    d = tmp_path_factory.mktemp("quiet")
    for t in ("nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", d)
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'c' || i AS c_name, (i % 25)::INTEGER AS c_nationkey, (i * 397 % 10000)::DOUBLE AS c_acctbal, CASE WHEN i < 25 THEN 'BUILDING' ELSE 'HOUSEHOLD' END AS c_mktsegment FROM range(50) t(i)")
    con.execute("CREATE TABLE orders AS SELECT c_custkey * 36 + m AS o_orderkey, c_custkey AS o_custkey, 'O' AS o_orderstatus, CASE WHEN c_custkey = 0 AND m % 12 < 6 THEN 900.0::DOUBLE + m ELSE 100 END AS o_totalprice, TIMESTAMP '1995-01-05' + to_months(m::INTEGER) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM customer, range(36) t(m)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, 0 AS l_partkey, 0 AS l_suppkey, 1 AS l_linenumber, (o_orderkey % 50 + 1)::DOUBLE AS l_quantity, 1000.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, CASE WHEN o_orderkey % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, 'O' AS l_linestatus, o_orderdate + to_days((o_orderkey % 40)::INTEGER) AS l_shipdate FROM orders")
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    for t in ("nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return str(d), con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    return str(v)


@pytest.mark.parametrize("name", FLAT)
def test_flat_flags_equal_sql(spark, quiet, name):
    d, con = quiet
    df = registry.QUERIES[name](spark, d)
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, names)) == sorted(df.columns)
    got, expected = sorted(tuple(map(text, r)) for r in df.select(*names).collect()), sorted(tuple(map(text, r)) for r in cur.fetchall())
    assert got == expected and got


def test_decay_of_a_detector_that_never_fires(spark):
    rows = [(datetime.date(2020, 1 + 3 * q, 1), False, i < q) for q in range(4) for i in range(4)]
    got = {r.model: (r.mean_rate, r.trend_corr, r.status) for r in audit.model_decay(spark.createDataFrame(rows, "fecha date, is_anomaly_a boolean, is_anomaly_b boolean"), ["is_anomaly_a", "is_anomaly_b"]).collect()}
    assert got["a"] == (0.0, 0.0, "ESTABLE")
    assert got["b"][0] == 37.5 and abs(got["b"][1] - 1) < 1e-12 and got["b"][2] == "DECAY"


def test_correlation_without_spread_or_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0, None), (2.0, 5.0, 4.0, None), (3.0, 5.0, 5.0, None), (None, 7.0, 0.0, None)], "x double, flat double, y double, none double")
    flat, r, none = df.select("x", "flat", "y", "none").agg(statistics.correlation("x", "flat"), statistics.correlation("x", "y"), statistics.correlation("x", "none")).collect()[0]
    assert math.isnan(flat) and abs(r - 0.9819805) < 1e-7 and none is None


def test_measures_without_a_denominator(spark):
    def measures(rows):
        r = ensemble.binary_metrics(spark.createDataFrame(rows, "y boolean, p boolean"), "y", "p").collect()[0]
        return [text(float(r[c])) for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "kappa")]

    assert measures([(True, False), (False, True), (False, False)]) == ["0", "1", "1", "1", "0", "0", "nan", "-0.5"]
    assert measures([(True, False), (False, False)]) == ["0", "0", "1", "1", "nan", "0", "nan", "0"]
    assert measures([(False, False)]) == ["0", "0", "0", "1", "nan", "nan", "nan", "nan"]
    assert measures([]) == ["0", "0", "0", "0", "nan", "nan", "nan", "nan"]
    assert measures([(True, True), (False, False), (True, None), (None, None)]) == ["1", "0", "0", "1", "1", "1", "1", text((0.5 - 0.125) / 0.875)]
