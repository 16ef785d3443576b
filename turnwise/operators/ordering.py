"""Ordered computations over a stream, without ever putting the stream into one task.

A rank, a running sum or a rolling mean over all rows is found in two steps: small sums for ranges of the order, which a window
over the table of ranges adds up, and windows within the ranges.  A range is a bin of the order (an hour, or ``SPAN`` positions), so
its size doesn't grow with the length of the stream.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a range.
SPAN = 65_536


def position(rows: DataFrame, bins: list[Column], order: list, name: str = "position") -> DataFrame:
    """``rows`` with their rank from 1 in the order of (bins, order); bins must be a coarser form of the order's first keys."""
    keys = [f"__b{i}" for i in range(len(bins))]
    keyed = rows.select("*", *(b.alias(k) for b, k in zip(bins, keys, strict=True)))
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias("__s" + k) for k in keys), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    on = [F.col(k).eqNullSafe(F.col("__s" + k)) for k in keys]
    joined = keyed.withColumn("__i", inside)
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return joined.join(starts, cond).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__i") + F.col("__before")).cast("long").alias(name))


def _range(order: str) -> Column:
    return F.floor((F.col(order) - 1) / SPAN)


def rolling(rows: DataFrame, value: Column, width: int, into: str, least: int = 1, order: str = "position") -> DataFrame:
    """``rows`` with the mean of the last ``width`` values by a dense position; null while there are fewer than ``least`` rows.

    Each range also gets the ``width`` - 1 rows before it, which only its windows see.
    """
    ends = F.col(order) > (_range(order) + 1) * SPAN - (width - 1)
    spread = rows.withColumn("__v", value).withColumn("__r", F.explode(F.when(ends, F.array(_range(order), _range(order) + 1)).otherwise(F.array(_range(order)))))
    w = Window.partitionBy("__r").orderBy(order).rowsBetween(1 - width, 0)
    mean = F.when(F.col(order) >= least, F.avg("__v").over(w))
    return spread.withColumn(into, mean).filter(F.col("__r") == _range(order)).drop("__v", "__r")


def running(rows: DataFrame, sums: dict[str, Column], last: dict[str, Column] | None = None, order: str = "position") -> DataFrame:
    """``rows`` with running sums, and running last non-null values, by a dense position."""
    last = last or {}
    keyed = rows.withColumn("__r", _range(order))
    for k, c in {**sums, **last}.items():
        keyed = keyed.withColumn(f"__x_{k}", c)
    ends = keyed.groupBy("__r").agg(*(F.sum(f"__x_{k}").alias(f"__t_{k}") for k in sums), *(F.max_by(f"__x_{k}", F.when(F.col(f"__x_{k}").isNotNull(), F.col(order))).alias(f"__t_{k}") for k in last), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__r").alias("__q"), *(F.coalesce(F.sum(f"__t_{k}").over(w), F.lit(0)).alias(f"__c_{k}") for k in sums), *(F.last(f"__t_{k}", ignorenulls=True).over(w).alias(f"__c_{k}") for k in last))
    inside = Window.partitionBy("__r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(carried, F.col("__r") == F.col("__q"))
    for k in sums:
        out = out.withColumn(k, F.coalesce(F.sum(f"__x_{k}").over(inside), F.lit(0)) + F.col(f"__c_{k}"))
    for k in last:
        out = out.withColumn(k, F.coalesce(F.last(f"__x_{k}", ignorenulls=True).over(inside), F.col(f"__c_{k}")))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *sums, *last)


def interleave(first: DataFrame, second: DataFrame, order: str = "position") -> DataFrame:
    """Both frames' columns with ``place``: row k of the second goes after row max(1, floor((k + 1) T / (A + 1))) of the first."""
    t, a = first.count(), second.count()
    rank = lambda df: position(df, [_range(order)], [order], "__trial")
    one = rank(first).withColumn("__sub", F.lit(0)).withColumn("__k", F.lit(0).cast("long"))
    two = rank(second).withColumn("__k", F.col("__trial") - 1).withColumn("__trial", F.greatest(F.lit(1).cast("long"), F.floor(F.col("__trial") * t / (a + 1)).cast("long"))).withColumn("__sub", F.lit(1))
    both = one.unionByName(two)
    return position(both, [F.floor(F.col("__trial") / SPAN)], ["__trial", "__sub", "__k"], "place").drop("__trial", "__sub", "__k")


def round_robin(rows: DataFrame, stratum: str, bins: list[Column], order: list, name: str = "place") -> DataFrame:
    """``rows`` with their place when strata take turns, each in its order: the first of every stratum, then the second of those that have one, and so on.

    bins: a coarser form of the order's first keys, so that a large stratum is ranked in ranges too.
    """
    ranked = position(rows, [F.col(stratum), *bins], order, "__p")
    starts = ranked.groupBy(F.col(stratum).alias("__of")).agg((F.min("__p") - 1).alias("__from"))
    own = ranked.join(starts, F.col(stratum).eqNullSafe(F.col("__of"))).withColumn("__n", F.col("__p") - F.col("__from"))
    return position(own, [_range("__n")], ["__n", stratum], name).select(*(F.col(f"`{c}`") for c in rows.columns), name)
