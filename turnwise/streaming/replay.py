"""Running the caches over ordered turns: as a batch replay, and in Structured Streaming."""

import dataclasses
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def arrow_schema(schema: StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])


def use_state_store(spark: SparkSession) -> None:
    """State by variables needs the RocksDB store; streams that run already keep theirs."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(turns: DataFrame, make: Callable, output: str, *, key: str = "cache_id", order: str = "position") -> DataFrame:
    """Each cache's turns in order through its own machine.  output: DDL of the key and the machine's result.

    Caches are dealt by key and sorted within partitions; a task streams through its rows and holds one machine at a time, so
    a cache with very many turns takes memory for its patterns, not for its turns.  Learning in order can't be split within one cache.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType.fromDDL(output)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, machine = None, False, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if not begun or row[key] != now:
                    now, begun, machine = row[key], True, make()
                out.append({key: now, **machine.turn(row)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return turns.repartition(n, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def stream(turns: DataFrame, make: Callable, output: str, *, key: str = "cache_id", order: str = "position") -> DataFrame:
    """The same on a streaming frame: the machine's state is kept by Spark for each key, as JSON; rows of a micro-batch go in order."""
    names = StructType.fromDDL(output).names

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = make()
        if state.exists:
            for name, v in json.loads(state.get[0]).items():
                setattr(machine, name, v)
        frame = pd.concat(list(frames)).sort_values(order).astype(object)
        rows = frame.where(frame.notna(), None).to_dict("records")  # nulls as in a batch
        out = [{key: k[0], **machine.turn(r)} for r in rows]
        state.update((json.dumps(snapshot(machine)),))
        yield pd.DataFrame(out, columns=names)

    return turns.groupBy(key).applyInPandasWithState(step, output, "state string", "append", GroupStateTimeout.NoTimeout)


def snapshot(machine) -> dict:
    """All fields of a machine, for saving and for Spark's state."""
    return {f.name: getattr(machine, f.name) for f in dataclasses.fields(machine)}


def restore(make: Callable, saved: dict):
    """A machine from a snapshot; one of another kind is refused."""
    machine = make()
    names = {f.name for f in dataclasses.fields(machine)}
    if set(saved) != names:
        raise ValueError(f"a snapshot with {sorted(saved)} isn't one of {type(machine).__name__}")
    for name, v in saved.items():
        setattr(machine, name, v)
    return machine
