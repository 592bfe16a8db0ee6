"""Ladders of levels: CASE expressions that batch queries, reports and streams share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels and their limits.
#: Alert levels by urgency.
LEVELS = {"CRITICO": 0, "ALTO": 1, "VIGILANCIA": 2}
#: A level by the first limit that a value is over (or under); the last level has none.
INCOME = ((9000, "muy_baja"), (11000, "baja"), (14000, "media"), (18000, "media_alta"))
BUILDING_AGE = ((60, "critico"), (40, "alto"), (25, "medio"))


def care_level(score: Column, age: Column, alone: Column) -> Column:
    return F.when((score > 0.7) & (age >= 75) & alone, "CRITICO").when((score > 0.5) & (age >= 70) & alone, "ALTO").when((score > 0.3) & (age >= 65), "VIGILANCIA").otherwise("BAJO")


def benchmark_type(ratio: Column) -> Column:
    """Of actual over expected use of a household."""
    return F.when(ratio > 2.0, "fuga_grave").when(ratio > 1.5, "fuga_probable").when(ratio < 0.4, "fraude_probable").when(ratio < 0.6, "subregistro").otherwise("normal")


def benchmark_flag(ratio: Column) -> Column:
    return (ratio > 1.5) | (ratio < 0.5)


def income_tier(income: Column) -> Column:
    tier = F.lit("alta")
    for limit, name in reversed(INCOME):
        tier = F.when(income < limit, name).otherwise(tier)
    return tier


def building_risk(age: Column) -> Column:
    risk = F.lit("bajo")
    for limit, name in reversed(BUILDING_AGE):
        risk = F.when(age > limit, name).otherwise(risk)
    return risk


def severity(score: Column) -> Column:
    """Of an isolation forest's score, which is negative."""
    return F.when(score < -0.5, "CRITICAL").when(score < -0.3, "HIGH").when(score < -0.1, "MEDIUM").otherwise("NORMAL")


def two_model_vote(first: Column, second: Column) -> Column:
    """The first model has few false alarms and weighs more; a null flag counts as silent."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return F.when(a & b, "CRITICAL").when(a, "HIGH").when(b, "MEDIUM").otherwise("NORMAL")


def level_order(level: str) -> Column:
    return F.coalesce(*(F.when(F.col(level) == k, v) for k, v in LEVELS.items()), F.lit(len(LEVELS)))
