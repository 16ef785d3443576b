"""Splits by hash and group, and folds that keep connected participants together."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .ordering import position


def hash_split(ids: DataFrame, key: str, *, salt: str, cuts: tuple[float, float]) -> DataFrame:
    """(key, split): ids in the order of a salted hash, the first share to train, the next to validation, the rest to test.

    The order needs a rank over all ids.  It is found in two steps, so no task sees them all: counts of 4096 hash ranges give the
    ranks before each range, and a window within a range the rest.
    """
    h = ids.select(key, F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256).alias("h")).withColumn("range", F.substring("h", 1, 3))
    counts = h.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    everything = Window.partitionBy(F.lit(0))
    before = counts.select("range", F.coalesce(F.sum("c").over(everything.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(everything).alias("n"))
    r = h.withColumn("i", F.row_number().over(Window.partitionBy("range").orderBy("h", key)) - 1).join(before, "range").withColumn("r", F.col("i") + F.col("before"))
    a, b = cuts
    return r.select(key, F.when(F.col("r") < F.floor(F.lit(a) * F.col("n")), "train").when(F.col("r") < F.floor(F.lit(b) * F.col("n")), "validation").otherwise("test").alias("split"))


def grouped_split(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``split``: 15 per cent of the groups test, 15 validation, by a hash of the group; groups are ranked through ranges of the hash."""
    h = F.md5(F.concat(F.lit("g:"), F.col(group).cast("string")))
    g = rows.select(group).distinct().withColumn("__h", h)
    ranked = position(g, [F.substring("__h", 1, 3)], ["__h", group], "__r")
    n = ranked.count()
    split = F.when(F.col("__r") <= n * 15 // 100, "test").when(F.col("__r") <= n * 30 // 100, "validation").otherwise("train")
    return rows.join(ranked.select(group, split.alias("split")), group)


def group_folds(edges: DataFrame, folds: int) -> DataFrame:
    """(a, fold): participants ``a`` that share any ``b`` get the same fold; groups, largest first, are dealt back and forth."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
    found = components(edges.select(key("a", "a").alias("a"), key("b", "b").alias("b")))
    # the group is named by its smallest participant
    mine = edges.select("a").distinct().withColumn("node", key("a", "a")).join(found, "node").select("a", "root")
    groups = mine.groupBy("root").agg(F.min("a").alias("first"), F.count(F.lit(1)).alias("n"))
    # many groups have one size, so they are ranked in ranges of size and first participant
    coarse = F.substring("first", 1, 4) if dict(groups.dtypes)["first"] == "string" else F.floor(F.col("first") / 10_000)
    ranked = position(groups.withColumn("less", -F.col("n")), [F.col("less"), coarse], ["less", "first"], "k")
    k = F.col("k") - 1
    dealt = ranked.withColumn("fold", F.when(F.floor(k / folds) % 2 == 0, k % folds).otherwise(folds - 1 - k % folds))
    return mine.join(dealt.select("root", "fold"), "root").select("a", F.col("fold").cast("int").alias("fold"))
