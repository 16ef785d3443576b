"""Recognition results, each once among the last accepted ones: an id is refused while it is one of the last ``last`` accepted ids.

Whether a row is accepted depends on what was accepted before it, so this is a fold along the order.  In a stream the ids live in a ring of Spark's
state, two rows written for each accepted id.  ``dedupe_recent`` computes the same for a table in ranges of the order: every range is
folded at once from the ring that the range before it ended with as far as known, and those whose start turned out otherwise are folded again,
until none does.  That is the fold itself, by induction along the ranges, and usually takes two or three rounds, since a ring forgets all but its last ids.
"""

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..session import workspace
from .replay import use_state_store

LAST = 1000
SPAN = 65_536


def is_result(final: Column, text: Column) -> Column:
    """Final results with a text; others are dropped before they count."""
    return F.coalesce(final, F.lit(False)) & (F.trim(F.coalesce(text, F.lit(""))) != "")


class Ring:
    """The last accepted ids, oldest first."""

    def __init__(self, last: int, ids=()):
        self.last, self.ids = last, deque(ids)
        self.held = set(self.ids)

    def accept(self, i) -> bool:
        if i in self.held:
            return False
        self.ids.append(i)
        self.held.add(i)
        if len(self.ids) > self.last:
            self.held.discard(self.ids.popleft())
        return True


class _Processor(StatefulProcessor):
    def __init__(self, last: int, names: list[str], id_col: str, order: str):
        self.last, self.names, self.id_col, self.order = last, names, id_col, order

    def init(self, handle) -> None:
        self.places = handle.getMapState("places", "id string", "number long")
        self.slots = handle.getMapState("slots", "slot int", "id string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        (n,), kept = self.count.get() or (0,), []
        for i in frame[self.id_col].astype(str):
            new = not self.places.containsKey((i,))
            kept.append(new)
            if new:
                slot = (n % self.last,)
                if self.slots.containsKey(slot):
                    self.places.removeKey(self.slots.getValue(slot))
                self.slots.updateValue(slot, (i,))
                self.places.updateValue((i,), (n,))
                n += 1
        self.count.update((n,))
        yield frame[kept][self.names]

    def close(self) -> None:
        pass


def stream_recent(results: DataFrame, *, id_col: str = "utterance_id", key: str = "session_id", order: str = "position", last: int = LAST) -> DataFrame:
    """The accepted rows of a streaming frame of results, each key with a ring of its own."""
    use_state_store(results.sparkSession)
    return results.groupBy(key).transformWithStateInPandas(_Processor(last, results.columns, id_col, order), results.schema, "append", "none")


_RINGS = "key string, r long, ring array<string>"


def _fold(last: int, ends: bool):
    """A function from (rows of a range, the ring that it starts with) to its last ring, or to its accepted rows."""
    names = [c.split()[0] for c in (_RINGS if ends else "key string, r long, position long").split(", ")]

    def fold(rows: pa.Table, start: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "r": pa.array([], pa.int64()), names[2]: pa.array([], pa.list_(pa.string()) if ends else pa.int64())})
        rows = rows.sort_by("position")
        ring = Ring(last, start.column("ring")[0].as_py() or () if start.num_rows else ())
        key, r = rows.column("key")[0].as_py(), rows.column("r")[0].as_py()
        at = [p for p, i in zip(rows.column("position").to_pylist(), rows.column("id").to_pylist(), strict=True) if ring.accept(i)]
        if ends:
            return pa.table({"key": pa.array([key], pa.string()), "r": pa.array([r], pa.int64()), "ring": pa.array([list(ring.ids)], pa.list_(pa.string()))})
        return pa.table({"key": pa.array([key] * len(at), pa.string()), "r": pa.array([r] * len(at), pa.int64()), "position": pa.array(at, pa.int64())})

    return fold


def dedupe_recent(results: DataFrame, *, id_col: str = "utterance_id", key: str | None = None, order: str = "position", last: int = LAST, span: int = SPAN) -> DataFrame:
    """The accepted rows of a table of results, by a unique integer order; with a key, each key has a ring of its own.

    A range is ``span`` of the order, and one task folds it; rounds go over the ranges alone whose start changed.
    """
    spark, path = results.sparkSession, workspace(results.sparkSession, "dedupe")
    k = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    plain = results.select(k.alias("key"), F.floor(F.col(order) / span).alias("r"), F.col(order).cast("long").alias("position"), F.col(id_col).cast("string").alias("id"))
    plain.write.parquet(f"{path}/rows")
    rows = spark.read.schema(plain.schema).parquet(f"{path}/rows")
    no_ring = F.array().cast("array<string>")
    before = Window.partitionBy("key").orderBy("r")
    schema = StructType.fromDDL(_RINGS)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    starts = kept(rows.select("key", "r").distinct().withColumn("ring", no_ring), "starts")
    todo, ends, turn = starts, None, 0
    while True:
        some = rows.join(todo.select("key", "r"), ["key", "r"], "left_semi")
        new = some.groupBy("key", "r").cogroup(todo.groupBy("key", "r")).applyInArrow(_fold(last, True), _RINGS)
        if ends is not None:
            new = new.unionByName(ends.join(todo.select("key", "r"), ["key", "r"], "left_anti"))
        ends = kept(new, f"ends-{turn}")
        then = ends.select("key", "r", F.coalesce(F.lag("ring").over(before), no_ring).alias("ring"))
        changed = then.join(starts.select("key", "r", F.col("ring").alias("old")), ["key", "r"]).filter(F.col("ring") != F.col("old")).drop("old")
        starts = kept(then, f"starts-{turn}")
        todo = kept(changed, f"todo-{turn}")
        turn += 1
        if todo.isEmpty():
            break
    accepted = rows.groupBy("key", "r").cogroup(starts.groupBy("key", "r")).applyInArrow(_fold(last, False), "key string, r long, position long").select(F.col("position").alias("__at"))
    return results.join(accepted, F.col(order) == F.col("__at"), "left_semi")
