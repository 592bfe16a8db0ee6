"""Queries on geometry, networks, parsing and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aforo.operators import geometry as g
from aforo.operators import networks as n
from aforo.operators import reports as rp
from aforo.plans.flows import rounded, rounded_sql
from aforo.sources import parsing as ps
from aforo.sources.adapters import table
from aforo.streaming import flows as stream

QUERIES, ORACLE_SQL = {}, {}


def _q(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def _lines(s, d):
    """The lines of an order as vertices."""
    p = F.struct("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).alias("v"))
    return rows.select("l_orderkey", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def _shapes(s, d):
    df = _lines(s, d).withColumns({"area": g.area(F.col("ring")), "length": g.length(F.col("ring")), "c": g.centroid(F.col("ring"))})
    df = df.withColumn("inside", g.contains(F.col("ring"), F.lit(25.05), F.lit(30.05)).cast("int"))
    return rounded(df.select("*", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")), ["l_orderkey"], {"area": 7, "length": 4, "cx": 9, "cy": 9, "inside": 0})


_q("g1_polygon_measures", _shapes, """
WITH v AS (SELECT l_orderkey, l_linenumber AS i, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, lead(x) OVER w AS lx, lead(y) OVER w AS ly, count(*) OVER (PARTITION BY l_orderkey) AS k FROM v WINDOW w AS (PARTITION BY l_orderkey ORDER BY i, x, y))
SELECT l_orderkey, round(CASE WHEN max(k) >= 3 THEN abs(sum(x * ny - nx * y)) / 2 ELSE 0 END, 7) + 0.0 AS area, round(coalesce(sum(sqrt((x - lx) ** 2 + (y - ly) ** 2)), 0), 4) + 0.0 AS length, round(avg(x), 9) + 0.0 AS cx, round(avg(y), 9) + 0.0 AS cy,
  (count(*) FILTER ((y > 30.05) <> (ny > 30.05) AND 25.05 < (nx - x) * (30.05 - y) / nullif(ny - y, 0) + x) % 2)::DOUBLE AS inside FROM e GROUP BY 1""")


def _squares(s, d):
    x, y = (F.col("n_nationkey") % 5) * 200.0, F.floor(F.col("n_nationkey") / 5) * 200.0
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(s, d, "nation").select(F.col("n_name").alias("poly"), F.col("n_nationkey").alias("ordinal"), F.array(p(x, y), p(x + 220, y), p(x + 220, y + 220), p(x, y + 220)).alias("ring"))


def _points(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) + 0.25).alias("x"), (F.pmod(F.col("c_custkey") * 104729, F.lit(997)) + 0.25).alias("y"))


_PTS = "pts AS (SELECT c_custkey AS pid, (c_custkey * 7919) % 1000 + 0.25::DOUBLE AS x, (c_custkey * 104729) % 997 + 0.25::DOUBLE AS y FROM customer)"
_q("j11_point_in_polygon", lambda s, d: g.point_in_polygon(_points(s, d), _squares(s, d), 100.0).select("pid", "poly"),
   f"WITH {_PTS}, sq AS (SELECT n_name AS poly, n_nationkey AS ordinal, (n_nationkey % 5) * 200.0 AS ax, (n_nationkey // 5) * 200.0 AS ay FROM nation) SELECT pid, min_by(poly, ordinal) AS poly FROM pts LEFT JOIN sq ON x >= ax AND x < ax + 220 AND y >= ay AND y < ay + 220 GROUP BY 1")


def _targets(s, d):
    t = table(s, d, "supplier")
    return t.select(F.col("s_suppkey").alias("tid"), (F.pmod(F.col("s_suppkey") * 6101, F.lit(1000)) + 0.5).alias("tx"), (F.pmod(F.col("s_suppkey") * 7001, F.lit(997)) + 0.5).alias("ty"))


_TG = "tg AS (SELECT s_suppkey AS tid, (s_suppkey * 6101) % 1000 + 0.5::DOUBLE AS tx, (s_suppkey * 7001) % 997 + 0.5::DOUBLE AS ty, s_nationkey AS grp FROM supplier)"
_q("j12_nearest", lambda s, d: rounded(g.nearest(_points(s, d), _targets(s, d), 60.0), ["pid", "tid"], {"distance": 6}),
   f"WITH {_PTS}, {_TG}, b AS (SELECT pid, min({{'d': sqrt((x - tx) ** 2 + (y - ty) ** 2), 'tid': tid}}) AS m FROM pts JOIN tg ON abs(x - tx) <= 60 AND abs(y - ty) <= 60 AND sqrt((x - tx) ** 2 + (y - ty) ** 2) <= 60 GROUP BY 1) SELECT pid, m.tid AS tid, round(m.d, 6) + 0.0 AS distance FROM pts LEFT JOIN b USING (pid)")
_q("j10_adjacency", lambda s, d: rounded(g.within_distance(_targets(s, d).join(table(s, d, "supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_nationkey").alias("grp")), "tid").select("grp", F.col("tx").alias("x"), F.col("ty").alias("y")), 80.0), ["group_a", "group_b"], {"distance": 6}),
   f"WITH {_TG} SELECT a.grp AS group_a, b.grp AS group_b, round(min(sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2)), 6) + 0.0 AS distance FROM tg a JOIN tg b ON a.grp < b.grp AND sqrt((a.tx - b.tx) ** 2 + (a.ty - b.ty) ** 2) < 80 GROUP BY 1, 2")
_q("g7_pipe_capacity", lambda s, d: rounded(table(s, d, "part").select("p_partkey", g.pipe_capacity(F.col("p_size") / 100, (F.col("p_retailprice") - 1000) / 10000).alias("capacity")), ["p_partkey"], {"capacity": 6}),
   "SELECT p_partkey, round(0.2785 * 120 * (p_size / 100) ** 2.63 * greatest((p_retailprice - 1000) / 10000, 1e-4) ** 0.54, 6) + 0.0 AS capacity FROM part")


def _edges(s, d):
    l, o, c, p = (table(s, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, l.l_suppkey == p.s_suppkey)
    return rows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w")).filter("src <> dst")


_ED = "ed AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"
_ND = "nd AS (SELECT c_nationkey AS id, avg(c_acctbal) AS score, count(*)::DOUBLE AS demand FROM customer GROUP BY 1)"


def _nodes(s, d):
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("score"), F.count("*").cast("double").alias("demand"))


def _net(s, d):
    """Nations as nodes (score: share of negative balances), a sparse part of the trade between them as pipes."""
    nodes = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.avg((F.col("c_acctbal") < 0).cast("int")).alias("score"))
    nodes = nodes.withColumns({"elevation": F.pmod(F.col("id") * 37, F.lit(100)).cast("double"), "n_models": F.pmod("id", F.lit(4)).cast("double")})
    pipes = _edges(s, d).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    return n.network_class(n.graph_features(nodes, pipes.filter("(a * 7 + b * 3) % 5 = 0")))


_NET = f"""{_ED},
nd AS (SELECT c_nationkey AS id, avg((c_acctbal < 0)::INT) AS score, ((c_nationkey * 37) % 100)::DOUBLE AS elevation, (c_nationkey % 4)::DOUBLE AS n_models FROM customer GROUP BY 1),
pp AS (SELECT * FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(w) AS w FROM ed GROUP BY 1, 2) WHERE (a * 7 + b * 3) % 5 = 0),
near AS (
  SELECT x.id, count(*) AS degree, sum(w) AS weighted_degree, max(o.elevation) - min(o.elevation) AS elevation_diff, avg(o.score) AS neighbour_score, sum(o.score * w) / sum(w) AS propagation,
    coalesce(avg(o.score) FILTER (o.elevation > me.elevation + 1), 0) AS upstream_score, count(*) FILTER (o.elevation < me.elevation - 1) AS downstream_count
  FROM (SELECT a AS id, b AS other, w FROM pp UNION ALL SELECT b, a, w FROM pp) x JOIN nd o ON o.id = other JOIN nd me ON me.id = x.id GROUP BY 1),
gf AS (
  SELECT nd.*, coalesce(degree, 0) AS degree, coalesce(weighted_degree, 0) AS weighted_degree, coalesce(elevation_diff, 0) AS elevation_diff, coalesce(neighbour_score, 0) AS neighbour_score,
    coalesce(propagation, 0) AS propagation, coalesce(upstream_score, 0) AS upstream_score, coalesce(downstream_count, 0) AS downstream_count FROM nd LEFT JOIN near USING (id)),
lim AS (SELECT quantile_cont(score, 0.75) AS t, quantile_cont(elevation, 0.9) AS q, greatest(max(elevation), 1) AS top FROM gf)"""
_NET_BODY = """
SELECT *, CASE kind WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'PROPAGATION' WHEN 2 THEN 'ISOLATED' WHEN 3 THEN 'PRESSURE' ELSE CASE WHEN propagation > neighbour_score THEN 'PROPAGATION' ELSE 'ISOLATED' END END AS network_class,
  least(1, CASE kind WHEN 0 THEN 0 WHEN 1 THEN upstream_score / u * 0.5 + propagation / u * 0.3 + score / u * 0.2 WHEN 2 THEN score / u * 0.5 + (1 - neighbour_score / greatest(score, 1e-6)) * 0.3 + n_models / 10 * 0.2
    WHEN 3 THEN elevation_diff / 100 * 0.4 + score / u * 0.4 + elevation / top * 0.2 ELSE score / u * 0.3 END) AS confidence
FROM (SELECT *, greatest(t, 1e-6) AS u, CASE WHEN NOT score > t THEN 0 WHEN upstream_score > t * 0.8 THEN 1 WHEN neighbour_score < t * 0.3 THEN 2 WHEN elevation_diff > 30 OR elevation > q THEN 3 ELSE 4 END AS kind FROM gf, lim)"""
_NET_COLS = {"degree": 0, "weighted_degree": 0, "elevation_diff": 2, "neighbour_score": 6, "propagation": 6, "upstream_score": 6, "downstream_count": 0, "confidence": 4}
_q("m17_graph_features", lambda s, d: rounded(_net(s, d), ["id", "network_class"], _NET_COLS), rounded_sql(_NET, _NET_BODY, ["id", "network_class"], _NET_COLS))
_q("m18_steady_state", lambda s, d: rounded(n.steady_state(_nodes(s, d).withColumns({"elevation": F.col("id") * 3.0, "has_pump": F.col("score") > 4500}), _edges(s, d).withColumnRenamed("w", "capacity")), ["id", "zone"], {"head": 4, "supply": 4, "pressure": 4, "bottleneck": 0}),
   rounded_sql(f"{_ED}, {_ND}", "SELECT *, CASE WHEN pressure < 15 THEN 'LOW' WHEN pressure < 40 THEN 'MEDIUM' ELSE 'HIGH' END AS zone, supply < demand AS bottleneck FROM (SELECT id, demand, coalesce(head, 0) AS head, coalesce(supply, 0) AS supply, coalesce(head, 0) + CASE WHEN score > 4500 THEN 20 ELSE 0 END + CASE WHEN coalesce(np, 0) > 0 THEN 10 ELSE 0 END AS pressure FROM nd LEFT JOIN (SELECT dst AS id, max(src * 3.0 - dst * 3.0) AS head, sum(w) AS supply, max((score > 4500)::INT) AS np FROM ed JOIN nd n2 ON n2.id = src WHERE src > dst GROUP BY 1) f USING (id))", ["id", "zone"], {"head": 4, "supply": 4, "pressure": 4, "bottleneck": 0}))
_q("c5_chains", lambda s, d: n.chains(_edges(s, d).withColumn("w", F.col("w") / F.max("w").over(Window.partitionBy())), 0.6).select(F.array_join("path", ">").alias("path"), F.round("strength", 6).alias("strength")),
   f"WITH {_ED}, e AS (SELECT * FROM (SELECT src, dst, w / max(w) OVER () AS w FROM ed) WHERE w >= 0.6) SELECT concat_ws('>', a.src, a.dst, b.dst) AS path, round(a.w * b.w, 6) AS strength FROM e a JOIN e b ON a.dst = b.src AND b.dst <> a.src UNION ALL SELECT concat_ws('>', a.src, a.dst, b.dst, c.dst), round(a.w * b.w * c.w, 6) FROM e a JOIN e b ON a.dst = b.src AND b.dst <> a.src JOIN e c ON b.dst = c.src AND c.dst <> a.src AND c.dst <> a.dst")
_q("j13_fuzzy_match", lambda s, d: rounded(n.fuzzy_match(table(s, d, "part").select(F.col("p_type").alias("a")).distinct(), table(s, d, "part").select(F.col("p_brand").alias("b")).distinct().unionByName(table(s, d, "part").select(F.regexp_replace("p_type", " .*", " TYPE").alias("b")).distinct()), 0.2), ["a", "b"], {"score": 6}),
   rounded_sql("""na AS (SELECT DISTINCT p_type AS a FROM part), nb AS (SELECT p_brand AS b FROM part UNION SELECT regexp_replace(p_type, ' .*', ' TYPE') FROM part),
wa AS (SELECT a, list_distinct(string_split(trim(regexp_replace(upper(a), '[^A-Z0-9]+', ' ', 'g')), ' ')) AS wa FROM na), wb AS (SELECT b, list_distinct(string_split(trim(regexp_replace(upper(b), '[^A-Z0-9]+', ' ', 'g')), ' ')) AS wb FROM nb),
sc AS (SELECT a, b, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.3 ELSE 0 END AS score FROM wa JOIN wb ON len(list_intersect(wa, wb)) > 0),
be AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS nth FROM sc WHERE score >= 0.2)""",
     "SELECT na.a, be.b, be.score FROM na LEFT JOIN be ON be.a = na.a AND nth = 1", ["a", "b"], {"score": 6}))
_q("src1_thousands", lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(ps.thousands_comma(F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"'))), 2).alias("v")), "SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders")
_q("src4_decimal_comma_day_first", lambda s, d: table(s, d, "orders").select("o_orderkey", ps.decimal_comma(F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.", ",")).alias("v"), ps.day_first(F.date_format("o_orderdate", "d/M/yyyy H:mm")).alias("ts")), "SELECT o_orderkey, round(o_totalprice, 2) AS v, date_trunc('minute', o_orderdate) AS ts FROM orders")
_q("src9_period", lambda s, d: table(s, d, "orders").select("o_orderkey", ps.period_month(F.date_format("o_orderdate", "yyyy '-  ' MM")).alias("mes"), ps.clean_name(F.concat(F.lit("12-"), F.lower("o_orderpriority"))).alias("name")), "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, upper(trim(regexp_replace('12-' || lower(o_orderpriority), '^\\d+-', ''))) AS name FROM orders")
_q("src12_contract_growth", lambda s, d: table(s, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("mes")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("altas"), F.count_if(F.col("o_orderstatus") == "F").alias("bajas")).withColumn("neto", F.col("altas") - F.col("bajas")).select("*", F.round(F.avg("neto").over(Window.orderBy("mes").rowsBetween(-2, 0)), 6).alias("neto_3m")),
   "SELECT *, round(avg(neto) OVER (ORDER BY mes ROWS 2 PRECEDING), 6) AS neto_3m FROM (SELECT *, altas - bajas AS neto FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, count(*) FILTER (o_orderstatus <> 'F') AS altas, count(*) FILTER (o_orderstatus = 'F') AS bajas FROM orders GROUP BY 1))")
_q("src19_month_spine", lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b")).select("o_orderpriority", F.explode(ps.month_spine(F.col("a"), F.col("b"))).alias("mes")),
   "SELECT o_orderpriority, CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS mes FROM orders GROUP BY 1")
_q("a30_motive_pivot", lambda s, d: table(s, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("mes")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0), "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
_FRAUD = {"1-URGENT": 1.0, "2-HIGH": 1.5, "3-MEDIUM": 0.8}
_q("a9_fraud_rate", lambda s, d: rounded(rp.fraud_rate(table(s, d, "orders"), "o_orderdate", "o_orderpriority", _FRAUD), ["mes"], {"n_fraud": 0, "n_total_changes": 0, "fraud_rate": 6, "fraud_rate_3m": 6, "fraud_weighted": 4}),
   rounded_sql("g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS n_fraud, count(*) AS n_total_changes, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 1.5 WHEN '3-MEDIUM' THEN 0.8 ELSE 0 END) AS fraud_weighted FROM orders GROUP BY 1)",
     "SELECT *, n_fraud / n_total_changes AS fraud_rate, avg(n_fraud / n_total_changes) OVER (ORDER BY mes ROWS 2 PRECEDING) AS fraud_rate_3m FROM g", ["mes"], {"n_fraud": 0, "n_total_changes": 0, "fraud_rate": 6, "fraud_rate_3m": 6, "fraud_weighted": 4}))
_q("j16_interval_membership", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.percentile(F.unix_seconds(F.col("ts").cast("timestamp")), F.array(F.lit(0.25), F.lit(0.5))).alias("q")).join(table(s, d, "events"), "user_id").filter(F.unix_seconds(F.col("ts").cast("timestamp")).between(F.col("q")[0], F.col("q")[1])).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")),
   "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN (SELECT user_id AS u, quantile_cont(floor(epoch(ts)), 0.25) AS a, quantile_cont(floor(epoch(ts)), 0.5) AS b FROM events GROUP BY 1) ON u = user_id WHERE floor(epoch(ts)) BETWEEN a AND b GROUP BY 1")
_q("j8_semi_anti", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1")
_q("st1_tumbling_day", lambda s, d: stream.run(s, stream.tumbling_day(stream.events(s, f"{d}/events.parquet"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
_q("st2_sliding_day", lambda s, d: stream.run(s, stream.sliding_day(stream.events(s, f"{d}/events.parquet"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("mean", 6).alias("mean")), "SELECT start, event_type, round(avg(value), 6) AS mean FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOUR * k AS start, event_type, value FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY 1, 2")
_q("st3_sessions", lambda s, d: stream.run(s, stream.sessions(stream.events(s, f"{d}/events.parquet"))).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n"), """SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s""")


def _feedback(s, d):
    stream_ = stream.events(s, f"{d}/events.parquet").select("user_id", "ts", "event_id", (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(10)) < F.pmod("user_id", F.lit(10))).alias("is_false"))
    return stream.run(s, stream.threshold_feedback(stream_)).select("user_id", "n_labels", F.round("share_false", 6).alias("share_false"), F.round("threshold", 6).alias("threshold"))


_q("st4_threshold_feedback", _feedback)
_q("g4_line_points", lambda s, d: rounded(_lines(s, d).select("l_orderkey", g.midpoint(F.col("ring")).alias("m"), g.endpoints(F.col("ring")).alias("e")).select("l_orderkey", F.col("m.x").alias("mx"), F.col("e.first.x").alias("fx"), F.col("e.last.y").alias("ly")), ["l_orderkey"], {"mx": 4, "fx": 4, "ly": 6}),
   "WITH v AS (SELECT l_orderkey, list({'i': l_linenumber, 'x': l_quantity, 'y': l_extendedprice / 1000} ORDER BY l_linenumber, l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, round(r[len(r) // 2 + 1].x, 4) + 0.0 AS mx, round(r[1].x, 4) + 0.0 AS fx, round(r[len(r)].y, 6) + 0.0 AS ly FROM v")


def _degrees(s, d):
    c = table(s, d, "customer").select("c_custkey", g.utm_to_degrees(720000 + F.pmod("c_custkey", F.lit(997)) * 10.0, 4240000 + F.pmod("c_custkey", F.lit(991)) * 10.0).alias("p"))
    return rounded(c.select("c_custkey", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")), ["c_custkey"], {"lon": 7, "lat": 7})


def _degrees_sql() -> str:
    """The textbook series in SQL, with its terms written out by number."""
    n = g._F / (2 - g._F)
    a = g._A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b1, b2, b3 = n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480
    d1, d2, d3 = 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15
    return f"""WITH p AS (SELECT c_custkey, (4240000 + (c_custkey % 991) * 10.0::DOUBLE) / {0.9996 * a!r} AS xi, (720000 + (c_custkey % 997) * 10.0::DOUBLE - 500000) / {0.9996 * a!r} AS eta FROM customer),
q AS (SELECT c_custkey, xi - {b1!r} * sin(2 * xi) * cosh(2 * eta) - {b2!r} * sin(4 * xi) * cosh(4 * eta) - {b3!r} * sin(6 * xi) * cosh(6 * eta) AS xi, eta - {b1!r} * cos(2 * xi) * sinh(2 * eta) - {b2!r} * cos(4 * xi) * sinh(4 * eta) - {b3!r} * cos(6 * xi) * sinh(6 * eta) AS eta FROM p),
r AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM q)
SELECT c_custkey, round(degrees(atan2(sinh(eta), cos(xi))) - 3, 7) + 0.0 AS lon, round(degrees(chi + {d1!r} * sin(2 * chi) + {d2!r} * sin(4 * chi) + {d3!r} * sin(6 * chi)), 7) + 0.0 AS lat FROM r"""


_q("g5_utm_to_degrees", _degrees, _degrees_sql())
