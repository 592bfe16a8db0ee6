"""Causal structure from one correlation matrix: constraint-based search, effects along directed paths, what an intervention would change."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.functions.tails import student_two_sided

# The variables in their causal order, those nothing acts on, those that act on nothing before them; level, conditioning variables at most.
ORDER = {
    "pct_elderly_65plus": 0, "population_density": 0, "anr_ratio": 1, "consumption_per_contract": 2, "deviation_from_group_trend": 3, "anomaly_score": 4, "n_models_detecting": 5,
}
EXOGENOUS, OUTPUTS = ("pct_elderly_65plus", "population_density"), ("anomaly_score", "n_models_detecting")
ALPHA, MOST_CONDITIONS, SCORE = 0.05, 4, "anomaly_score"
#: Interventions: the value a variable would be set to (None: its median), and what kind of cause it is.
INTERVENTIONS = {
    "pct_elderly_65plus": (None, "ESTRUCTURAL"), "anr_ratio": (1.0, "ACCIONABLE"), "deviation_from_group_trend": (0.0, "ACCIONABLE"),
    "population_density": (None, "ESTRUCTURAL"), "consumption_per_contract": (None, "ACCIONABLE"),
}
ANOMALOUS, AT_LEAST = 0.3, 10


class Correlations:
    """Correlations of n complete rows."""

    def __init__(self, names: list[str], r: np.ndarray, n: int):
        self.names, self.r, self.n = names, r, n

    def partial(self, i: int, j: int, given: tuple[int, ...] = ()) -> tuple[float, float]:
        """The correlation of i and j given others, and its two-sided p-value."""
        if self.n < len(given) + 5 or self.r[i, i] == 0 or self.r[j, j] == 0:
            return 0.0, 1.0
        if given:
            at = [i, j, *given]
            own, others = self.r[np.ix_([i, j], [i, j])], self.r[np.ix_(list(given), list(given))]
            rest = own - self.r[np.ix_([i, j], list(given))] @ np.linalg.pinv(others, hermitian=True) @ self.r[np.ix_(at[2:], [i, j])]
            if min(rest[0, 0], rest[1, 1]) < 1e-12:
                return 0.0, 1.0
            value = rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1])
        else:
            value = self.r[i, j]
        value, dof = float(np.clip(value, -1.0, 1.0)), self.n - len(given) - 2
        return value, student_two_sided(value * np.sqrt(dof / (1 - value**2 + 1e-15)), dof) if dof >= 1 + bool(given) else 1.0


def correlations(df: DataFrame, names: list[str]) -> Correlations:
    """One aggregate over the rows that hold all variables; a constant variable correlates with nothing."""
    rows = df.dropna(subset=names)
    pairs = list(combinations(range(len(names)), 2))
    got = rows.agg(F.count("*").alias("n"), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.corr(names[i], names[j]).alias(f"r{i}_{j}") for i, j in pairs)).first()
    r = np.diag([1.0 if (got[f"s{i}"] or 0.0) > 1e-10 else 0.0 for i in range(len(names))])
    for i, j in pairs:
        value = got[f"r{i}_{j}"]
        r[i, j] = r[j, i] = value if r[i, i] and r[j, j] and value is not None and np.isfinite(value) else 0.0
    return Correlations(names, r, got["n"])


def skeleton(c: Correlations, alpha: float = ALPHA) -> tuple[set[frozenset[int]], dict[frozenset[int], set[int]]]:
    """Pairs that no set of their neighbours makes independent, and the separating set of each other pair.

    Sets grow from 0 to MOST_CONDITIONS; those around the first variable come before those around the second.
    """
    k = len(c.names)
    edges = {frozenset(p) for p in combinations(range(k), 2)}
    apart: dict[frozenset[int], set[int]] = {}
    for size in range(min(k - 2, MOST_CONDITIONS) + 1):
        for i, j in sorted(tuple(sorted(e)) for e in edges):
            for a in (i, j):
                near = [x for x in range(k) if x not in (i, j) and frozenset((a, x)) in edges]
                if len(near) < size:
                    break
                given = next((s for s in combinations(near, size) if c.partial(i, j, s)[1] > alpha), None)
                if given is not None:
                    edges.discard(frozenset((i, j)))
                    apart[frozenset((i, j))] = set(given)
                    break
    return edges, apart


def orient(c: Correlations, edges: set[frozenset[int]], apart: dict[frozenset[int], set[int]]) -> set[tuple[int, int]]:
    """Directed edges (cause, effect): colliders first, then what the domain rules out, then the causal order."""
    names, k = c.names, len(c.names)
    arrows, fixed = set(), set()
    for pair in sorted(tuple(sorted(p)) for p in map(frozenset, combinations(range(k), 2)) if p not in edges):
        for mid in range(k):
            if all(frozenset((x, mid)) in edges for x in pair) and mid not in pair and mid not in apart.get(frozenset(pair), set()):
                arrows |= {(x, mid) for x in pair}
    fixed |= arrows

    def turn(a: int, b: int) -> None:
        """a may not act on b."""
        arrows.discard((a, b))
        if frozenset((a, b)) in edges:
            arrows.add((b, a))
            fixed.add((b, a))

    for a, b in ((a, b) for a in range(k) for b in range(k) if a != b and (frozenset((a, b)) in edges or (a, b) in arrows)):
        if names[b] in EXOGENOUS and (b, a) not in fixed:
            if (a, b) in fixed:
                arrows.discard((a, b))
            else:
                turn(a, b)
        if names[a] in OUTPUTS and names[b] not in OUTPUTS:
            if (b, a) in fixed:
                arrows.discard((a, b))
            else:
                turn(a, b)
    score = names.index(SCORE) if SCORE in names else None
    for a, b in sorted(tuple(sorted(e)) for e in edges):
        rank = [ORDER.get(names[x], 3) for x in (a, b)]
        if (a, b) in arrows and (b, a) in arrows:
            arrows.discard((b, a) if rank[0] <= rank[1] else (a, b))
        elif (a, b) not in arrows and (b, a) not in arrows:
            weak = rank[0] == rank[1] and score is not None and abs(c.partial(a, score)[0]) >= abs(c.partial(b, score)[0])
            arrows.add((b, a) if rank[0] > rank[1] or weak else (a, b))
    return arrows


def regression(c: Correlations, target: int, predictors: list[int]) -> tuple[float, float]:
    """The first predictor's standardised coefficient and its p-value, beside the others."""
    dof = c.n - len(predictors) - 1
    if c.n < len(predictors) + 3:
        return 0.0, 1.0
    own, with_target = c.r[np.ix_(predictors, predictors)], c.r[predictors, target]
    inverse = np.linalg.pinv(own, hermitian=True)
    beta = inverse @ with_target
    left = max(c.r[target, target] - float(beta @ with_target), 0.0) / dof  # residual sum over n - 1
    error = np.sqrt(abs(left * inverse[0, 0]))
    return float(beta[0]), student_two_sided(beta[0] / error, dof) if error > 1e-15 else 0.0


def total_effect(arrows: set[tuple[int, int]], betas: dict[tuple[int, int], float], source: int, target: int, seen: tuple[int, ...] = ()) -> float:
    """The sum over directed paths of the products of their coefficients."""
    return sum(
        beta * (1.0 if b == target else total_effect(arrows, betas, b, target, (*seen, source)))
        for (a, b), beta in betas.items()
        if a == source and b not in seen and b != source
    )


def causal_effects(df: DataFrame, names: list[str]) -> DataFrame:
    """A row per directed edge: cause, effect, correlation, edge_p_value, direct_beta (beside the effect's other causes), p_value, significant,
    total_effect (of the cause on the anomaly score). df: a row a unit.

    Spark sums one correlation matrix; the search runs on its few numbers. Fewer than three variables give no edges.
    """
    schema = "cause string, effect string, correlation double, edge_p_value double, direct_beta double, p_value double, significant boolean, total_effect double"
    names = [x for x in names if x in df.columns]
    if len(names) < 3:
        return df.sparkSession.createDataFrame([], schema)
    c = correlations(df, names)
    arrows = orient(c, *skeleton(c))
    found = {(a, b): regression(c, b, [a, *(x for x, y in sorted(arrows) if y == b and x != a)]) for a, b in sorted(arrows)}
    betas, score = {e: v[0] for e, v in found.items()}, names.index(SCORE) if SCORE in names else -1
    rows = []
    for (a, b), (beta, p) in found.items():
        total = total_effect(arrows, betas, a, score) if a != score and score >= 0 else 0.0
        rows.append((names[a], names[b], *map(float, c.partial(a, b)), float(beta), float(p), bool(p < ALPHA), float(total)))
    return df.sparkSession.createDataFrame(rows, schema)


def intervention_impact(df: DataFrame, key: str, effects: DataFrame) -> DataFrame:
    """Per anomalous unit (score over ANOMALOUS; if none is, the AT_LEAST highest) and variable with an effect: what setting it to its
    intervention's value would change the score by, and the share of the score explained, shares of a unit made to sum to 1 at most.

    df: a row a unit. Means, deviations and medians are one row, broadcast; effects are a row a variable at most.
    """
    names = [v for v in INTERVENTIONS if v in df.columns]
    per = effects.filter((F.col("total_effect") != 0) & (F.col("cause") != SCORE)).groupBy("cause").agg(F.max_by("total_effect", F.abs("total_effect")).alias("effect"))
    known = dict(per.collect())  # a row a variable
    names = [v for v in names if v in known]
    schema = "variable string, category string, current_value double, counterfactual_value double, delta_anomaly_score double"
    stats = df.agg(F.stddev_samp(SCORE).alias("_score_sd"), F.count_if(F.col(SCORE) > ANOMALOUS).alias("_n"), *(g(v).alias(f"_{n}_{v}") for v in names for n, g in (("sd", F.stddev_samp), ("median", F.median))))
    units = df.crossJoin(F.broadcast(stats))  # one row
    chosen = units.filter((F.col("_n") > 0) & (F.col(SCORE) > ANOMALOUS)).unionByName(units.filter("_n = 0").orderBy(F.desc(SCORE), key).limit(AT_LEAST))
    parts = []
    for v in names:
        to, kind = INTERVENTIONS[v]
        goal = F.lit(to) if to is not None else F.col(f"_median_{v}")
        change = (goal - F.col(v)) / F.col(f"_sd_{v}") * known[v] * F.col("_score_sd")
        parts.append(F.when(F.col(f"_sd_{v}") >= 1e-10, F.struct(F.lit(v).alias("variable"), F.lit(kind).alias("category"), F.col(v).alias("current_value"), goal.alias("counterfactual_value"), change.alias("delta_anomaly_score"))))
    what = F.filter(F.array(*parts), lambda p: p.isNotNull()) if parts else F.array().cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    rows = chosen.select(key, SCORE, what.alias("w"))
    all_ = F.aggregate("w", F.lit(0.0), lambda a, p: a + F.abs(p["delta_anomaly_score"]))
    rows = rows.withColumn("_all", all_).withColumn("p", F.explode("w"))
    fraction = F.when(F.col(SCORE) > 1e-6, F.abs("p.delta_anomaly_score") / F.col(SCORE)).otherwise(0.0)
    scale = F.when(F.col("_all") > 0, F.least(F.lit(1.0), F.col(SCORE) / F.col("_all"))).otherwise(0.0)
    return rows.select(key, SCORE, "p.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction * scale)).alias("fraction_explained"))
