"""Networks of nodes and directed edges as two frames: degrees, neighbour scores, supply, zones."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.operators.ranges import spread


def graph_features(nodes: DataFrame, pipes: DataFrame) -> DataFrame:
    """Of each node, over its neighbours: number, weights, range of elevations, mean score, mean score by weight, mean score of
    those more than 1 m above, number of those more than 1 m below. nodes: id, score, elevation; pipes: a, b, w (one row a pair).
    """
    other = nodes.select(F.col("id").alias("other"), F.col("score").alias("s"), F.col("elevation").alias("up"))
    ends = pipes.select(F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(pipes.select(F.col("b").alias("id"), F.col("a").alias("other"), "w"))
    rows = ends.join(other, "other").join(nodes.select("id", "elevation"), "id")
    near = rows.groupBy("id").agg(
        F.count("*").alias("degree"),
        F.sum("w").alias("weighted_degree"),
        (F.max("up") - F.min("up")).alias("elevation_diff"),
        F.avg("s").alias("neighbour_score"),
        F.when(F.sum("w") > 0, F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("propagation"),
        F.avg(F.when(F.col("up") > F.col("elevation") + 1, F.col("s"))).alias("upstream_score"),
        F.count_if(F.col("up") < F.col("elevation") - 1).alias("downstream_count"),
    )
    return nodes.join(near, "id", "left").fillna({c: 0 for c in near.columns if c != "id"})


def network_class(features: DataFrame) -> DataFrame:
    """What the network says of an anomalous node (score over the third quartile), and how sure that is.

    PROPAGATION: nodes above it are anomalous. ISOLATED: its neighbours are not. PRESSURE: extreme elevation or a great range of
    elevations around it. The limits are one row, broadcast. features: of graph_features, and n_models.
    """
    limits = features.agg(F.percentile("score", F.lit(0.75)).alias("t"), F.percentile("elevation", F.lit(0.9)).alias("q"), F.greatest(F.max("elevation"), F.lit(1.0)).alias("top"))
    df = features.crossJoin(F.broadcast(limits)).withColumn("u", F.greatest("t", F.lit(1e-6)))
    score, near, spread, u = F.col("score"), F.col("neighbour_score"), F.col("propagation"), F.col("u")
    high, diff = F.col("elevation"), F.col("elevation_diff")
    # fixed values: the rules' limits and weights
    cases = [
        (~(score > F.col("t")), "NORMAL", F.lit(0.0)),
        (F.col("upstream_score") > F.col("t") * 0.8, "PROPAGATION", F.col("upstream_score") / u * 0.5 + spread / u * 0.3 + score / u * 0.2),
        (near < F.col("t") * 0.3, "ISOLATED", score / u * 0.5 + (1 - near / F.greatest(score, F.lit(1e-6))) * 0.3 + F.col("n_models") / 10 * 0.2),
        ((diff > 30) | (high > F.col("q")), "PRESSURE", diff / 100 * 0.4 + score / u * 0.4 + high / F.col("top") * 0.2),
        (spread > near, "PROPAGATION", score / u * 0.3),
        (F.lit(True), "ISOLATED", score / u * 0.3),
    ]
    kind, sure = F.lit("NORMAL"), F.lit(0.0)
    for holds, name, worth in reversed(cases):
        kind, sure = F.when(holds, name).otherwise(kind), F.when(holds, F.least(worth, F.lit(1.0))).otherwise(sure)
    return df.withColumns({"network_class": kind, "confidence": sure}).drop("t", "q", "top", "u")


def steady_state(nodes: DataFrame, edges: DataFrame, pump: float = 20.0, neighbour: float = 10.0) -> DataFrame:
    """One-hop supply: pressure head from the highest supplier, bonuses, zones. nodes: id, elevation, demand, has_pump; edges: src, dst, capacity."""
    high = nodes.select(F.col("id").alias("src"), F.col("elevation").alias("up"), F.col("has_pump").alias("up_pump"))
    low = nodes.select(F.col("id").alias("dst"), F.col("elevation").alias("down"))
    feeds = edges.join(high, "src").join(low, "dst").filter("up > down").groupBy(F.col("dst").alias("id")).agg(
        F.max(F.col("up") - F.col("down")).alias("head"), F.sum("capacity").alias("supply"), F.max(F.col("up_pump").cast("int")).alias("near_pump")
    )
    out = nodes.join(feeds, "id", "left").fillna({"head": 0.0, "supply": 0.0, "near_pump": 0})
    pressure = F.col("head") + F.when(F.col("has_pump"), pump).otherwise(0.0) + F.when(F.col("near_pump") > 0, neighbour).otherwise(0.0)
    out = out.withColumn("pressure", pressure)
    return out.withColumns(
        {"zone": F.when(F.col("pressure") < 15, "LOW").when(F.col("pressure") < 40, "MEDIUM").otherwise("HIGH"), "bottleneck": F.col("supply") < F.col("demand")}
    )


def chains(edges: DataFrame, least: float) -> DataFrame:
    """Paths of three or four different nodes over edges of at least ``least``, by self-joins; strength is the product."""
    e = edges.filter(F.col("w") >= least).select("src", "dst", "w")
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w2")), "b").filter("a <> c")
    three = two.join(e.select(F.col("src").alias("c"), F.col("dst").alias("d"), F.col("w").alias("w3")), "c").filter("d <> a AND d <> b")
    return two.select(F.array("a", "b", "c").alias("path"), (F.col("w1") * F.col("w2")).alias("strength")).unionByName(three.select(F.array("a", "b", "c", "d").alias("path"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("strength")))


def fuzzy_match(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """Best partner of each name: Jaccard of word sets, 0.3 more if one name holds the other; ties: least name.

    Names meet on a shared word, not on all pairs. left: a; right: b.
    """
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")), " "))
    l, r = left.select("a", words(F.col("a")).alias("wa")), right.select("b", words(F.col("b")).alias("wb"))
    pairs = l.withColumn("w", F.explode("wa")).join(r.withColumn("w", F.explode("wb")), "w").drop("w").distinct()
    score = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")) + F.when(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")), 0.3).otherwise(0.0)
    best = pairs.withColumn("score", score).filter(F.col("score") >= least).groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m"))
    return left.join(best, "a", "left").select("a", F.col("m.b").alias("b"), (-F.col("m.s")).alias("score"))


#: Edges that are broadcast at most.
MOST_EDGES = 2_000_000


def _dependencies(near: dict, source) -> dict:
    """Brandes' dependencies of all nodes on a source: how many of its shortest paths to others pass through each. near: node to {neighbour: length}."""
    done, ways, best, before = [], {source: 1.0}, {source: 0.0}, {source: []}
    heap, n, final = [(0.0, 0, source)], 0, set()
    while heap:
        far, _, v = heappop(heap)
        if v in final:
            continue
        final.add(v)
        done.append(v)
        for w, length in near.get(v, {}).items():
            d = far + length
            if w not in best or d < best[w] - 1e-12 * max(1.0, d):
                best[w], ways[w], before[w], n = d, ways[v], [v], n + 1
                heappush(heap, (d, n, w))
            elif w not in final and abs(d - best[w]) <= 1e-12 * max(1.0, d):
                ways[w] += ways[v]
                before[w].append(v)
    share = dict.fromkeys(done, 0.0)
    for w in reversed(done):
        for v in before[w]:
            share[v] += ways[v] / ways[w] * (1.0 + share[w])
    share[source] = 0.0
    return share


def betweenness(nodes: DataFrame, edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(id, betweenness): of each node the share of shortest paths between two others that pass through it, over all pairs.

    nodes: id; edges: a, b, w (a row a pair, w its length, over 0, undirected). Sources are dealt to tasks, and each source's dependencies
    are worked out on the graph, which every task holds: its edges are counted first, and more than ``most`` are an error, as no task could hold
    them (exact betweenness of such a graph takes nodes times edges anyway). Sums by node are made where they arise.
    """
    edges = edges.filter("a <> b AND w > 0").groupBy("a", "b").agg(F.min("w").alias("w"))
    if (n_edges := edges.count()) > most:
        raise ValueError(f"{n_edges} edges; {most} are held by a task at most")
    near: dict = {}
    for a, b, w in edges.collect():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = min(w, near.get(a, {}).get(b, w))
    shared = nodes.sparkSession.sparkContext.broadcast(near)
    kind = dict(nodes.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for source in b["id"].tolist():
                for v, share in _dependencies(shared.value, source).items():
                    if share:
                        total[v] = total.get(v, 0.0) + share
        yield pd.DataFrame({"id": list(total), "s": list(total.values())})

    ids = nodes.select("id").distinct()
    n = ids.count()
    sums = spread(ids, "id").mapInPandas(run, f"id {kind}, s double").groupBy("id").agg(F.sum("s").alias("s"))
    scale = (n - 1) * (n - 2) if n > 2 else 1
    return ids.join(sums, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) / scale).alias("betweenness"))
