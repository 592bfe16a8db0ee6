"""Proportional hazards (Cox) with Efron's treatment of ties, by Newton steps on risk-set sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.operators.ranges import written

# Ridge penalty a row, days ahead, cuts between the groups of risk.
PENALTY, AHEAD, GROUPS = 0.1, 60.0, ((0.67, "BAJO"), (0.90, "MEDIO"), (1.0, "ALTO"))


@dataclass
class Cox:
    """Coefficients of the raw covariates, their standard errors, the covariates' means, rows and events, the time next to the days ahead, its cumulative baseline hazard."""

    beta: np.ndarray
    error: np.ndarray
    mean: np.ndarray
    n: int
    events: int
    at: float
    hazard: float


def time_sums(g: pd.DataFrame, z: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per distinct time, latest first: the time, sums of w, w z, w z z' of all rows and of events, sum of z and number of events."""
    w = np.exp(z @ beta)
    times, back = np.unique(-g["_t"].to_numpy(float), return_inverse=True)
    k, p = len(times), z.shape[1]
    wide = np.column_stack([w, w[:, None] * z, (w[:, None, None] * z[:, :, None] * z[:, None, :]).reshape(len(w), p * p)])
    dead = g["_e"].to_numpy(bool)
    every, own, raw = np.zeros((k, wide.shape[1])), np.zeros((k, wide.shape[1])), np.zeros((k, p + 1))
    np.add.at(every, back, wide)
    np.add.at(own, back[dead], wide[dead])
    np.add.at(raw, back[dead], np.column_stack([np.ones(dead.sum()), z[dead]]))
    return -times, every, own, raw


def efron(every: np.ndarray, own: np.ndarray, raw: np.ndarray, before: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, negative Hessian and log-likelihood that these times add, where ``before`` sums up all later times. Latest first."""
    risk = before + np.cumsum(every, axis=0)
    d = raw[:, 0].astype(int)
    which = np.repeat(np.arange(len(d)), d)
    share = (np.arange(len(which)) - np.repeat(np.cumsum(d) - d, d)) / np.repeat(d, d)
    s = risk[which] - share[:, None] * own[which]
    one, two = s[:, 1 : p + 1] / s[:, :1], s[:, p + 1 :] / s[:, :1]
    hessian = two.sum(0).reshape(p, p) - one.T @ one
    return raw[:, 1:].sum(0) - one.sum(0), hessian, -float(np.log(s[:, 0]).sum())


def fit_cox(df: DataFrame, time: str, event: str, covariates: list[str], penalty: float = PENALTY, ahead: float = AHEAD, most: int = 50) -> Cox | None:
    """The penalised partial likelihood's maximum over the rows that hold time, event and all covariates; None without events.

    Rows are dealt by ranges of their time and written once. A Newton step reads them twice: each range's sums (a row a range comes to
    the driver), then each range's part of gradient and Hessian, given the sums of all later ranges. A range holds sums by its own distinct times only.
    """
    p = len(covariates)
    rows = df.select(F.col(time).cast("double").alias("_t"), F.col(event).cast("boolean").alias("_e"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates))).dropna()
    stats = rows.agg(F.count("*").alias("n"), F.count_if("_e").alias("events"), *(F.avg(f"_x{i}").alias(f"m{i}") for i in range(p)), *(F.stddev_samp(f"_x{i}").alias(f"s{i}") for i in range(p))).first()
    n, events = stats["n"], stats["events"]
    if not events:
        return None
    mean, scale = (np.array([stats[f"{k}{i}"] or 0.0 for i in range(p)]) for k in "ms")
    scale = np.where(scale > 0, scale, 1.0)
    ranged = written(rows.repartitionByRange(F.desc("_t"))).withColumn("_part", F.spark_partition_id())  # equal times share a range; ranges stay partitions

    def each(beta: np.ndarray, use):
        """``use`` of each range's time sums, as rows (part, values)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: tuple | None = None
            for b in batches:
                if not len(b):
                    continue
                made = time_sums(b, (b[[f"_x{i}" for i in range(p)]].to_numpy(float) - mean) / scale, beta)
                part, held = int(b["_part"].iloc[0]), made if held is None else merged(held, made)
            if held is not None:
                yield pd.DataFrame({"part": [part], "v": [np.asarray(use(part, *held), float)]})

        got = ranged.mapInPandas(run, "part int, v array<double>").collect()  # a row a range
        return {r["part"]: np.array(r["v"]) for r in got}

    beta, ll = np.zeros(p), -np.inf
    for _ in range(most):
        totals = each(beta, lambda part, t, every, own, raw: every.sum(0))
        later = {part: sum((totals[q] for q in totals if q < part), np.zeros(1 + p + p * p)) for part in totals}
        parts = each(beta, lambda part, t, every, own, raw, later=later, beta=beta: np.concatenate([(x := efron(every, own, raw, later[part], p))[0], x[1].ravel(), [x[2] + raw[:, 1:].sum(0) @ beta]]))
        sums = sum(parts.values())
        gradient, hessian = sums[:p] - n * penalty * beta, sums[p:-1].reshape(p, p) + n * penalty * np.eye(p)
        now = sums[-1] - n * penalty * (beta @ beta) / 2
        step = np.linalg.solve(hessian, gradient)
        if now < ll - 1e-9 * abs(ll):
            beta, step = beta - last / 2, last / 2  # too far: half of the last step
            last = step
            continue
        if np.abs(step).max() < 1e-9:
            break
        beta, ll, last = beta + step, now, step
    least = ranged.agg(F.min_by("_t", F.struct(F.abs(F.col("_t") - ahead), "_t")).alias("at")).first()["at"]
    totals = each(beta, lambda part, t, every, own, raw: every.sum(0))
    later = {part: sum((totals[q][0] for q in totals if q < part), 0.0) for part in totals}
    hazard = each(beta, lambda part, t, every, own, raw: [float((raw[:, 0] / (later[part] + np.cumsum(every[:, 0])))[t <= least].sum())])
    return Cox(beta / scale, np.sqrt(np.diag(np.linalg.inv(hessian))) / scale, mean, n, events, least, float(sum(v[0] for v in hazard.values())))


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Time sums of two batches."""
    times, back = np.unique(-np.concatenate([a[0], b[0]]), return_inverse=True)
    out = []
    for x, y in zip(a[1:], b[1:]):
        sums = np.zeros((len(times), x.shape[1]))
        np.add.at(sums, back, np.concatenate([x, y]))
        out.append(sums)
    return -times, *out


def cox_risk(df: DataFrame, key: str, time: str, event: str, covariates: list[str], penalty: float = PENALTY, ahead: float = AHEAD) -> DataFrame:
    """Per row: key, hazard_ratio (against the mean row), survival and predicted_risk at the time next to ``ahead``, risk_group (BAJO up to the 67th percentile, MEDIO up to the 90th, ALTO).

    Missing covariates count as their median. Without events there are no rows.
    """
    model = fit_cox(df, time, event, covariates, penalty, ahead)
    schema = "hazard_ratio double, survival_60d double, predicted_risk_60d double, risk_group string"
    if model is None:
        return df.select(key).limit(0).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in schema.split(", ")})
    medians = df.agg(*(F.median(c).alias(f"_m{i}") for i, c in enumerate(covariates)))
    rows = df.crossJoin(F.broadcast(medians))  # one row
    score = F.lit(0.0)
    for i, c in enumerate(covariates):
        score = score + (F.coalesce(F.col(c).cast("double"), F.col(f"_m{i}")) - float(model.mean[i])) * float(model.beta[i])
    rows = rows.select(key, F.exp(score).alias("hazard_ratio"))
    rows = rows.withColumn("survival_60d", F.exp(-F.col("hazard_ratio") * model.hazard)).withColumn("predicted_risk_60d", 1 - F.col("survival_60d"))
    cuts = rows.agg(F.percentile("predicted_risk_60d", F.array(*(F.lit(q) for q, _ in GROUPS[:-1]))).alias("_q"))
    group = F.lit(GROUPS[-1][1])
    for i, (_, name) in reversed(list(enumerate(GROUPS[:-1]))):
        group = F.when(F.col("predicted_risk_60d") <= F.col("_q")[i], name).otherwise(group)
    return rows.crossJoin(F.broadcast(cuts)).withColumn("risk_group", group).drop("_q")  # one row
