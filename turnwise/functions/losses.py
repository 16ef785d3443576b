"""Log-sum-exp and the losses built on it, for logits in arrays and for logits in rows; finite for logits of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the classes of values whose exponentials are added up relative to the class: sums stay within doubles up to 1e90 rows.
_WIDTH = 500.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(logits: Column) -> Column:
    """Of an array: maximum plus the logarithm of the rescaled sum.  Null for empty arrays; nulls in it are left out."""
    x = F.transform(F.filter(logits, lambda v: v.isNotNull()), lambda v: v.cast("double"))
    m = F.array_max(x)
    return F.when(F.abs(m) == float("inf"), m).otherwise(m + F.log(_sum(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return F.transform(logits, lambda v: v.cast("double") - z)


def preference_loss(logits: Column, chosen: Column) -> Column:
    """How much of the probability isn't on the chosen places (from 0; any of them is as good), as a loss; a row without chosen places is an error."""
    places = F.array_distinct(chosen)
    of = log_sum_exp(F.transform(places, lambda i: F.get(logits, i)))
    missing = F.coalesce(F.size(places), F.lit(0)) < 1
    return F.when(missing, F.raise_error(F.lit("a missing preference is no target"))).otherwise(log_sum_exp(logits) - of)


def kl_divergence(reference: Column, logits: Column) -> Column:
    """Of the model's distribution from the reference's, both as logits."""
    return _sum(F.zip_with(log_softmax(reference), log_softmax(logits), lambda q, p: F.when(q == float("-inf"), 0.0).otherwise(F.exp(q) * (q - p))))


def recovery_loss(logits: Column, chosen: Column, reference: Column, anchor: float = 0.2) -> Column:
    """Preference loss, anchored to a reference."""
    if anchor < 0:
        raise ValueError("the anchor's weight can't be negative")
    return preference_loss(logits, chosen) + anchor * kl_divergence(reference, logits)


def log_sum_exp_by(rows: DataFrame, keys: list[str], value: Column, into: str = "log_sum_exp") -> DataFrame:
    """Log-sum-exp of a value by key, in aggregates that combine before the shuffle, also for one hot key.

    The state of a class of values (of width ``_WIDTH``) is the sum of exponentials relative to the class; states of a class add up, and
    the few classes of a key are rescaled to the largest one.
    """
    x = value.cast("double")
    fine = rows.withColumn("__x", x).filter("__x IS NOT NULL")
    klass = F.when(F.abs("__x") == float("inf"), F.col("__x")).otherwise(F.floor(F.col("__x") / _WIDTH).cast("double"))
    parts = fine.withColumn("__c", klass).groupBy(*keys, "__c").agg(F.sum(F.when(F.abs("__c") == float("inf"), 1.0).otherwise(F.exp(F.col("__x") - F.col("__c") * _WIDTH))).alias("__s"))
    states = parts.groupBy(*keys).agg(F.collect_list(F.struct("__c", "__s")).alias("__l"))
    top = F.array_max(F.transform("__l", lambda p: p["__c"]))
    total = _sum(F.transform("__l", lambda p: F.when(p["__c"] == float("-inf"), 0.0).otherwise(p["__s"] * F.exp((p["__c"] - top) * _WIDTH))))
    return states.select(*keys, F.when(F.abs(top) == float("inf"), top).otherwise(top * _WIDTH + F.log(total)).alias(into))
