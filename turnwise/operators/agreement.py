"""Samples that don't depend on how rows are stored, and asking a sample again."""

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.canonical import try_canonical


def rank_of(key: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def bottom_k(rows: DataFrame, key: str, k: int, *, seed: int = 7, group: str | None = None) -> DataFrame:
    """(group, key, rank) of the ``k`` distinct keys with the smallest keyed hashes, overall or in each group.

    Mergeable: a task keeps its ``k`` smallest of each group, and the smallest of those are the smallest of all, so no more than tasks x groups x k rows
    move, nothing is sorted as a whole, and the sample is the same for any partitioning, order or repetition of rows.
    """
    asked = rows.select((F.col(group).cast("string") if group else F.lit("")).alias("group"), F.col(key).cast("string").alias("key"), rank_of(F.col(key), seed).alias("rank")).filter("key IS NOT NULL")

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}  # group -> rank -> key
        for b in batches:
            for g, i, r in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True):
                own = kept.setdefault(g, {})
                own[r] = i
                if len(own) > 4 * k + 64:
                    kept[g] = {x: own[x] for x in heapq.nsmallest(k, own)}
        out = [(g, own[r], r) for g, own in kept.items() for r in heapq.nsmallest(k, own)]
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], pa.string()) for n in range(3)], names=["group", "key", "rank"])

    parts = asked.mapInArrow(smallest, "group string, key string, rank string").distinct()
    w = Window.partitionBy("group").orderBy("rank")
    return parts.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def self_consistency(answered: DataFrame, ask: Callable[[str], str], *, sample: int = 30, seed: int = 7, valid: Callable[[Column], Column] = lambda answer: F.lit(True)) -> DataFrame:
    """(agreement, asked): a sample of answered payloads asked again, past any cache.

    answered: (key, payload, answer), JSON texts; equal keys are one payload.  Two answers agree if both are valid JSON, pass ``valid``, and are equal as values,
    whatever their key order; an ``ask`` that raises doesn't agree.  Without payloads the agreement is null.
    """

    @pandas_udf(T.StringType())
    def again(payloads: pd.Series) -> pd.Series:
        out = []
        for p in payloads:
            try:
                out.append(ask(p))
            except Exception:  # noqa: BLE001  whatever goes wrong with a teacher is no agreement
                out.append(None)
        return pd.Series(out, dtype=object)

    chosen = bottom_k(answered, "key", sample, seed=seed).select("key")
    known = answered.select(F.col("key").cast("string").alias("key"), "payload", "answer").join(F.broadcast(chosen), "key").groupBy("key").agg(F.min(F.struct("payload", "answer")).alias("x"))
    both = known.select(try_canonical(F.col("x.answer"))["json"].alias("first"), try_canonical(again("x.payload"))["json"].alias("second"))
    agree = F.coalesce((F.col("first") == F.col("second")) & valid(F.col("first")) & valid(F.col("second")), F.lit(False))
    return both.agg(F.avg(agree.cast("int")).alias("agreement"), F.count(F.lit(1)).alias("asked"))
