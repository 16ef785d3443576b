"""Rates, agreement and reliability as column expressions and small DataFrame functions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keeper
from .ordering import position


def rate(flag, where: Column | None = None) -> Column:
    """Share of true among non-null flags; null if there are none."""
    x = F.col(flag).cast("int")
    return F.avg(x if where is None else F.when(where, x))


def beta(k: Column, n: Column) -> Column:
    return (k + 1) / (n + 2)


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def label_scores(pairs: DataFrame, digits: int | None = 6) -> DataFrame:
    """(gold, pred) -> for each gold label support, predicted, tp, precision, recall, f1; division by zero gives 0."""
    c = pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    gold = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("tp"))
    pred = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = gold.join(pred, "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    r = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    return j.select(
        "label",
        "support",
        "predicted",
        "tp",
        r(F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))).alias("precision"),
        r(F.col("tp") / F.col("support")).alias("recall"),
        r(2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f1"),
    )


#: Draws of a task of the bootstrap, at most about.
TASK_DRAWS = 1_000_000


def clustered_bootstrap(rows: DataFrame, *, resamples: int = 1000, bin_of: Column | None = None, largest: int = 1_000_000) -> DataFrame:
    """(u, correct) -> low, high, resamples: percentiles of the mean over resampled clusters ``u``.

    Rows are summed by cluster first, so a resample touches clusters, not rows; draws come from a hash of resample and place, so reruns agree.
    Clusters are numbered in order through ranges of them: bin_of is a coarser form of ``u`` (the default: thousands of an integer).
    There are ``resamples`` times as many draws as clusters; each task makes an equal range of them, and up to ``largest`` clusters the sums are sent to
    the draws, which aren't shuffled then.  Over that, draws are shuffled to the sums.
    """
    c = rows.groupBy("u").agg(F.sum(F.col("correct").cast("int")).cast("double").alias("s"), F.count("correct").alias("n"))
    numbered = position(c, [F.floor(F.col("u") / 1000) if bin_of is None else bin_of], ["u"], "place").select("place", "s", "n")
    spark, total = rows.sparkSession, c.count()
    of = F.lit(max(1, total))
    few = resamples * total * 40 // TASK_DRAWS  # tasks beyond these cost more than their draws
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), few), -(-resamples * total // TASK_DRAWS))
    k = F.col("id") % of
    draws = spark.range(0, resamples * total, 1, tasks).select(((F.col("id") - k) / of + 1).cast("long").alias("r"), k.alias("k"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("r").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long") % of + 1
    sums = numbered.hint("broadcast" if total <= largest else "shuffle_hash")
    m = draws.select("r", drawn.alias("place")).join(sums, "place").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("m"))
    return m.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.count(F.lit(1)).alias("resamples"))


#: Bins of a narrowing round, and values of a range that are sorted at once.
BINS = 1024
LEAF = 4096


def exact_percentiles(rows: DataFrame, group: str, value: Column, shares: list[float]) -> DataFrame:
    """(group, share, percentile) with linear interpolation between the neighbouring ranks, as exact as a sort, without one buffer for a group.

    Each wanted rank starts with its group's range of values.  A round counts the values of each range in ``BINS`` bins of equal width, combined before the shuffle, and
    goes on in the bin that holds the rank, between the smallest and the largest value that it has; ranges of equal values, or of at most ``LEAF``
    values, which are sorted, end it.  Values and ranges are written to the shared folder, so no round repeats another.  Nulls don't count; NaN and infinities aren't supported.
    """
    keep = keeper(rows.sparkSession, "percentiles")
    base = keep(rows.select(F.col(group).alias("g"), value.cast("double").alias("v")).filter("v IS NOT NULL"), "values")
    own = base.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = [F.lit(float(q)) * (F.col("c") - 1) for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in at))))
    todo = keep(own.withColumn("rank", F.explode(ranks)).withColumn("before", F.lit(0).cast("long")).select("g", "rank", "before", "c", "lo", "hi"), "ranges-0")
    open_, turn = (F.col("c") > LEAF) & (F.col("lo") < F.col("hi")), 0
    while not todo.filter(open_).isEmpty():
        turn += 1
        t = todo.filter(open_).select(F.col("g").alias("og"), "rank", "before", "lo", "hi")
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)).alias("bin")
        seen = base.join(t, F.col("g").eqNullSafe(F.col("og")) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "rank", "before", bin_).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy("g", "rank").orderBy("bin")
        placed = seen.withColumn("before", F.col("before") + F.sum("c").over(upto) - F.col("c"))
        found = placed.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))).select(*todo.columns)
        todo = keep(todo.filter(~open_).unionByName(found), f"ranges-{turn}")
    some = todo.select(F.col("g").alias("og"), "rank", "before", "lo", "hi")
    one = some.filter("lo = hi").select("og", "rank", F.col("lo").alias("x"))
    near = base.join(some.filter("lo < hi"), F.col("g").eqNullSafe(F.col("og")) & F.col("v").between(F.col("lo"), F.col("hi")))
    sorted_ = near.groupBy("og", "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("l")).select("og", "rank", F.get("l", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
    known = one.unionByName(sorted_).groupBy("og").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    of = own.join(known, F.col("g").eqNullSafe(F.col("og")))
    wanted = of.select("g", "c", "at", F.explode(F.array(*(F.lit(float(q)) for q in shares))).alias("share")).withColumn("r", F.col("share") * (F.col("c") - 1))
    low, high = F.col("at")[F.floor("r")], F.col("at")[F.ceil("r")]
    return wanted.select(F.col("g").alias(group), "share", (low + (high - low) * (F.col("r") - F.floor("r"))).alias("percentile"))


def sum_digest(text: Column) -> Column:
    """Sum of the first 48 bits of each row's SHA-256: partial sums combine before any shuffle."""
    return F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")).cast("string")
