"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source gets a share of the token budget by its weight.  Its documents, shuffled by a hash, queue up;
a copy's virtual finish time is the cumulative tokens of its source (itself included) divided by the source's
target.  Copies are served in the order of virtual finish times until the budget is used up, so at any moment
all sources have come equally far.  When a source's queue ends it starts again, up to ``epochs`` times.

Scale: texts never move unless the caller keeps them in the frame.  The prefix sums of a source run in two steps (sums of
``BUCKETS`` hash ranges, then rows within a range), so a source with a third of all rows is spread over many tasks.
The global order is only needed where the budget runs out: every copy with a finish time of at most 1 fits, the
others are summed by ranges of virtual time, and the range in which the budget ends is cut into finer ones until it holds at most ``SORTED`` copies
(or copies of one time only), which are sorted row by row.

Defined results: null text has size 0, null source is a source of its own (last), documents of size 0 take 0; rows that
agree in everything keep their number; an empty table gives no rows; other columns pass through, but for names that begin with ``__tw_``, which are ours.
"""

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges of a source: three hex digits.  A range of the largest source stays near 1/4096 of its rows.
RANGE_DIGITS = 3
EPOCHS = 3
#: Copies that are sorted in one task at the end of the budget, and pieces that a longer range of virtual time is cut into.
SORTED = 200_000
PIECES = 4096
SEED = "mix-1"
_IN = "__tw_"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _water_fill(sources: DataFrame, epochs: int) -> DataFrame:
    """(skey, total) per source -> its target; weights 1, 2, 3 by code point of the source, null last.

    One row per source goes through one-partition windows: that is a table of sources, not of documents.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy("skey"))
    ranked = sources.select("skey", "total", ((rank - 1) % 3 + 1).cast("long").alias("w"), (F.col("total") * epochs).alias("cap"))
    order = everything.orderBy((F.col("cap") / F.col("w")), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        F.row_number().over(order).alias("k"),
        (F.sum("total").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("num"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("den"),
    )
    # the first source, by cap per weight, that its share doesn't fill: from there on nobody is capped
    open_ = F.col("cap").cast("decimal(19,0)") * F.col("den").cast("decimal(18,0)") >= F.col("w").cast("decimal(18,0)") * F.col("num").cast("decimal(19,0)")
    first = F.min(F.when(open_, F.struct("k", "num", "den"))).over(everything)
    return level.withColumn("first", first).select(
        "skey",
        F.col("total").alias("source_total"),
        F.when(F.col("k") < F.col("first.k"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("first.num")).cast("double") / F.col("first.den").cast("double")).alias("target"),
    )


def _range_of(h: Column, size: Column, nameless: str) -> Column:
    """The hash range of a document.  Those without an id share one hash, so within it sizes make ranges: the order stays (hash, size)."""
    part = F.when(h < nameless, "0").when(h == nameless, F.concat(F.lit("1"), F.lpad(size.cast("string"), 19, "0"))).otherwise("2")
    return F.concat(F.substring(h, 1, RANGE_DIGITS), F.when(h.startswith(nameless[:RANGE_DIGITS]), part).otherwise(""))


def _narrow(there: DataFrame, upto: int, budget: int) -> tuple[DataFrame, int]:
    """The part of virtual time in which the budget ends, of at most ``SORTED`` copies, and the size served before it.

    The interval is cut into ``PIECES`` and summed up again as long as it holds more and its times differ.
    """
    while True:
        n, low, high = there.agg(F.count(F.lit(1)), F.min("finish"), F.max("finish")).first()
        if n <= SORTED or not low < high:
            return there, upto
        piece = F.least(F.floor((F.col("finish") - low) / ((high - low) / PIECES)), F.lit(PIECES - 1))
        upto_piece = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p"))
        sums = there.groupBy(piece.alias("p")).agg(F.sum("size").alias("n")).select("p", "n", upto_piece.alias("upto"))
        end = sums.filter(F.col("upto") + upto > budget).orderBy("p").first()
        if end is None:
            return there, upto
        there, upto = there.filter(piece == end["p"]), upto + end["upto"] - end["n"]


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """All rows and columns of ``docs``, with ``__tw_size``, ``__tw_source_size``, ``__tw_target`` and ``__tw_copies`` (times the mix takes the document, 0 to ``epochs``)."""
    c = lambda name: F.col(_IN + name)
    keyed = docs.select(
        *(F.col(f"`{x}`") for x in docs.columns),
        (word_count() if size is None else size).cast("long").alias(_IN + "size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~")).alias(_IN + "skey"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias(_IN + "h"),
    ).withColumn(_IN + "range", _range_of(c("h"), c("size"), hashlib.md5(f"{seed}:".encode()).hexdigest()))
    ranges = cut(keyed.groupBy(c("skey").alias("skey"), c("range").alias("range")).agg(F.sum(c("size")).alias("n")), "mix-ranges")
    targets = _water_fill(ranges.groupBy("skey").agg(F.sum("n").alias("total")), epochs)
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("skey", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(targets, "skey")
    bases = bases.select(*(F.col(x).alias(f"{_IN}b_{x}") for x in bases.columns))  # no clash with the input's columns
    inside = Window.partitionBy(c("skey"), c("range")).orderBy(c("h"), c("size")).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        keyed.withColumn(_IN + "cum", F.sum(c("size")).over(inside))
        .join(bases, (c("skey") == c("b_skey")) & (c("range") == c("b_range")))
        .select(
            *(F.col(f"`{x}`") for x in docs.columns),
            *(c(x) for x in ("size", "skey", "h")),
            (c("cum") + c("b_base")).alias(_IN + "cum"),
            c("b_source_total").alias(_IN + "source_size"),
            c("b_target").alias(_IN + "target"),
        )
    )
    placed = cut(placed, "mix-placed")
    copies = placed.filter(c("size") > 0).select(
        *(c(x).alias(x) for x in ("size", "skey", "h", "target")),
        F.explode(F.array(*(F.struct(F.lit(e).alias("e"), (c("cum") + c("source_size") * e).alias("cum")) for e in range(epochs)))).alias("x"),
    ).select("size", "skey", "h", F.col("x.e").alias("e"), (F.col("x.cum") / F.col("target")).alias("finish"), (F.col("x.cum") <= F.col("target")).alias("fits"))
    budget = ranges.agg(F.sum("n")).first()[0] or 0
    late = F.col("finish") - 1
    by_range = (
        copies.groupBy(F.when(F.col("fits"), F.lit(-(10**6))).when(late <= 0, F.lit(-(10**6) + 1)).otherwise(F.floor(F.log(late) * 16)).alias("t"))
        .agg(F.sum("size").alias("n"))
        .select("t", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("t")).alias("upto"), "n")
        .filter(F.col("upto") > budget)
        .orderBy("t")
        .first()
    )
    order = [F.col("finish"), F.col("skey"), F.col("h"), F.col("size"), F.col("e")]
    edge = None
    if by_range:  # the range of virtual time in which the budget ends
        there = copies.filter(~F.col("fits") & F.when(late <= 0, F.lit(-(10**6) + 1)).otherwise(F.floor(F.log(late) * 16)).eqNullSafe(F.lit(by_range["t"])))
        there, before_it = _narrow(there, by_range["upto"] - by_range["n"], budget)
        upto = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + before_it
        edge = there.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy(*order).first()
    taken = F.lit(0)
    for e in range(epochs):
        cum = c("cum") + c("source_size") * e
        served = cum <= c("target")
        if edge:
            mine = F.struct((cum / c("target")).alias("finish"), c("skey").alias("skey"), c("h").alias("h"), c("size").alias("size"), F.lit(e).alias("e"))
            served |= mine < F.struct(*(F.lit(edge[x]).cast(t).alias(x) for x, t in (("finish", "double"), ("skey", "string"), ("h", "string"), ("size", "long"), ("e", "int"))))
        elif not by_range:
            served = F.lit(True)
        taken = taken + F.when((c("size") > 0) & served, 1).otherwise(0)
    return placed.select(*(F.col(f"`{x}`") for x in docs.columns), c("size"), c("source_size"), c("target"), taken.alias(_IN + "copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken."""
    mixed = mix_sources(docs, **options).filter(F.col(_IN + "copies") > 0)
    return mixed.withColumn(_IN + "copy", F.explode(F.sequence(F.lit(1), F.col(_IN + "copies")))).select(*(F.col(f"`{x}`") for x in docs.columns))


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("words"))
    out = lambda x: F.col(_IN + x)
    return mix_sources(docs, size=F.col("words")).select(
        "doc_id", out("size").alias("size"), out("source_size").alias("source_size"), out("target").alias("target"), (out("size") * out("copies")).alias("taken")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce('=' || source, '~') AS skey, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY skey),
w AS (SELECT skey, total, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS w, 3 * total AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS k,
         sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, skey)),
f AS (SELECT k, num, den FROM l WHERE CAST(cap AS HUGEINT) * den >= CAST(w AS HUGEINT) * num ORDER BY k LIMIT 1),
t AS (
  SELECT l.skey, l.total AS source_size,
         CASE WHEN l.k < f.k THEN CAST(l.cap AS DOUBLE) ELSE CAST(l.w * f.num AS DOUBLE) / CAST(f.den AS DOUBLE) END AS target
  FROM l, f),
p AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.skey ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS cum,
         row_number() OVER (ORDER BY d.skey, h, size) AS r
  FROM d JOIN t USING (skey)),
c AS (
  SELECT p.*, e, cum + e * source_size AS upto, CAST(cum + e * source_size AS DOUBLE) / target AS finish
  FROM p, (SELECT unnest([0, 1, 2]) AS e) x WHERE size > 0),
g AS (
  SELECT r, e, size,
         CAST(upto AS DOUBLE) <= target
         OR sum(size) OVER (ORDER BY CAST(upto AS DOUBLE) > target, finish, skey, h, size, e ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM d) AS served
  FROM c),
n AS (SELECT r, sum(size) AS taken FROM g WHERE served GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN n USING (r)
"""
