"""Running sums and minima over a whole frame without a window that holds all of it in one task.

Few rows are summed in one window. Beyond them the order column is cut into ranges of about equal size (approximate percentiles, a bounded array of numbers that travels in
the plan), sums per range are a small table, and a window runs inside each range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a frame is cut into; rows, as counted, that one sorted window may hold instead.
PARTS, FEW = 48, 300_000


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read from there; on a single machine without one, to a folder beside the warehouse."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt over as many partitions as the session shuffles to, also if it is small: for rows that take long each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def _cut(df: DataFrame, by: str, within: Sequence[str], parts: int) -> DataFrame:
    """With a column _range: how many of the cuts are below the value; nulls come after all."""
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = df.groupBy(*within).agg(F.array_distinct(F.percentile_approx(by, shares, F.lit(10_000))).alias("_cuts"))
    df = df.join(cuts, list(within)) if within else df.crossJoin(F.broadcast(cuts))  # one row
    at = F.when(F.col(by).isNull(), parts).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(by))))
    return df.withColumn("_range", F.coalesce(at, F.lit(0))).drop("_cuts")


def running_sums(df: DataFrame, by: str, cols: dict[str, str], within: Sequence[str] = (), descending: bool = False, parts: int = PARTS) -> DataFrame:
    """For each column ``c: name`` its sum up to and with this row's value, in the order of ``by`` (nulls last), as ``name``.

    Rows are expected to differ in (within, by): group equal values first. They are written once, as they are read three times. Up to ``FEW``
    rows need no ranges.
    """
    rows = written(df)
    value = F.desc_nulls_first(by) if descending else F.asc_nulls_last(by)
    if rows.count() <= FEW:
        run = Window.partitionBy(*within).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({name: F.sum(c).over(run) for c, name in cols.items()})
    cut = _cut(rows, by, within, parts)
    per = cut.groupBy(*within, "_range").agg(*(F.sum(c).alias(f"_p_{c}") for c in cols))
    order = F.desc("_range") if descending else F.col("_range")
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # at most parts + 1 rows
    per = per.select(*within, "_range", *(F.coalesce(F.sum(f"_p_{c}").over(before), F.lit(0)).alias(f"_p_{c}") for c in cols))
    cut = cut.join(per, [*within, "_range"]) if within else cut.join(F.broadcast(per), "_range")
    own = Window.partitionBy(*within, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumns({name: F.col(f"_p_{c}") + F.sum(c).over(own) for c, name in cols.items()})
    return cut.drop("_range", *(f"_p_{c}" for c in cols))


def least_from_here(df: DataFrame, by: str, x: str, name: str, parts: int = PARTS) -> DataFrame:
    """The least ``x`` of this row and all with a greater ``by``."""
    rows = written(df)
    if rows.count() <= FEW:
        return rows.withColumn(name, F.min(x).over(Window.orderBy(F.desc(by)).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = _cut(rows, by, (), parts)
    per = cut.groupBy("_range").agg(F.min(x).alias("_p"))
    after = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most parts + 1 rows
    per = per.select("_range", F.min("_p").over(after).alias("_p"))
    own = Window.partitionBy("_range").orderBy(F.desc(by)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(F.broadcast(per), "_range").withColumn(name, F.least(F.min(x).over(own), F.col("_p"))).drop("_range", "_p")


def average_ranks(df: DataFrame, x: str, within: Sequence[str] = ()) -> DataFrame:
    """Columns of ``within``, x, _rank (from 1, ties share their mean rank, nulls last), count: one row a distinct value."""
    counts = df.groupBy(*within, x).count()
    ranks = running_sums(counts, x, {"count": "_upto"}, within)
    return written(ranks.withColumn("_rank", F.col("_upto") - (F.col("count") - 1) / 2.0).drop("_upto"))


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    renamed = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, on, "left").drop(*(f"_k_{k}" for k in keys))
