"""The semantic cache in a stream, with Spark's state for each pattern, and its snapshots.

``stream_patterns`` runs the cache by ``transformWithState``.  State of a cache: a map with a row for each pattern, a map with its
centroids packed by state signature in matrices of ``CHUNK`` rows, and two counts.  A micro-batch reads the patterns of the state signatures that its turns
have, and writes the patterns that changed, the matrices in which a centroid moved, and the counts; what was learnt before and isn't met costs nothing.

A snapshot is a table of patterns (``SNAPSHOT``) with the embedder and the thresholds that it was learnt with beside it: from a batch
(``patterns_after``), or from a stream's checkpoint through Spark's state reader (``checkpointed_patterns``).  ``load_patterns`` refuses one of another embedder or
other thresholds.  A snapshot starts a stream as its initial state, or a batch replay (``resume``), and never passes through the driver.
"""

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from .caches import Group, SemanticCache
from .replay import arrow_schema, use_state_store

#: Centroids of a packed matrix.
CHUNK = 64
FORMAT = "semantic-cache-1"
_FIELDS = "state string, successor string, template string, n int, k int, evidence array<string>, seed boolean, failed_audits int, served int, active boolean"
_NAMES = [c.split()[0] for c in _FIELDS.split(", ")]
SNAPSHOT = f"number int, {_FIELDS}, centroid array<double>"


class StoredCache(SemanticCache):
    """A semantic cache over maps of Spark's state: patterns come in with their state signature, and changes go out with ``flush``."""

    @classmethod
    def over(cls, machine: SemanticCache, patterns, centroids, counts) -> "StoredCache":
        own = cls(**{f.name: getattr(machine, f.name) for f in dataclasses.fields(SemanticCache) if f.name != "patterns"})
        own._maps, own._held, own._dirty, own._moved = (patterns, centroids, counts), {}, set(), set()
        own._count, own._active = counts.get() or (0, 0)
        return own

    def _pattern(self, number: int) -> dict:
        return self._held[number]

    def _size(self) -> int:
        return self._count

    def _group(self, state: str) -> Group | None:
        if state not in self._groups:
            patterns, centroids, _ = self._maps
            group, chunk = None, 0
            while packed := centroids.getValue((state, chunk)):
                numbers, rows = packed[0], np.frombuffer(packed[1]).reshape(len(packed[0]), -1)
                group = group or Group(rows.shape[1])
                for number, row in zip(numbers, rows, strict=True):
                    self._hold(group, int(number), dict(zip(_NAMES, patterns.getValue((int(number),)), strict=True)) | {"centroid": row.tolist()})
                chunk += 1
            self._groups[state] = group
        return self._groups[state]

    def _hold(self, group: Group, number: int, p: dict) -> None:
        p["evidence"] = list(p["evidence"])
        self._held[number] = p
        group.add(number, p["centroid"], p["active"])

    def put(self, number: int, p: dict) -> None:
        """A pattern under its number, as a snapshot has it."""
        if self._group(p["state"]) is None:
            self._groups[p["state"]] = Group(len(p["centroid"]))
        self._hold(self._groups[p["state"]], number, p)
        self._dirty.add(number)
        self._moved.add(number)

    def _add(self, p: dict) -> int:
        self._count += 1
        self.put(self._count - 1, p)
        return self._count - 1

    def _changed(self, number: int, moved: bool) -> None:
        self._dirty.add(number)
        if moved:
            self._moved.add(number)

    def flush(self) -> tuple[int, int]:
        """Write what changed; returns how many patterns and matrices that was."""
        patterns, centroids, counts = self._maps
        for i in sorted(self._dirty):
            patterns.updateValue((i,), tuple(self._held[i][c] for c in _NAMES))
        chunks = sorted({(p["state"], self._groups[p["state"]].slot[i] // CHUNK) for i in self._moved for p in [self._held[i]]})
        for state, c in chunks:
            group, part = self._groups[state], slice(c * CHUNK, (c + 1) * CHUNK)
            centroids.updateValue((state, c), (group.numbers[part], group.rows[part].tobytes()))
        counts.update((self._count, self._active))
        written = len(self._dirty), len(chunks)
        self._dirty, self._moved = set(), set()
        return written


class _Processor(StatefulProcessor):
    def __init__(self, make: Callable[[], SemanticCache], names: list[str], key: str, order: str):
        self.make, self.names, self.key, self.order = make, names, key, order

    def init(self, handle) -> None:
        self.maps = (
            handle.getMapState("patterns", "number int", _FIELDS),
            handle.getMapState("centroids", "state string, chunk int", "numbers array<int>, matrix binary"),
            handle.getValueState("counts", "patterns int, active int"),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine = StoredCache.over(self.make(), *self.maps)
        turns = pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records")
        out = [{self.key: key[0], **machine.turn(r)} for r in turns]
        machine.flush()
        yield pd.DataFrame(out, columns=self.names)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        machine = StoredCache.over(self.make(), *self.maps)
        for p in initialState.sort_values("number").to_dict("records"):
            machine.put(int(p["number"]), {c: p[c] if c != "evidence" else list(p[c]) for c in _NAMES} | {"centroid": list(p["centroid"])})
            machine._count = max(machine._count, int(p["number"]) + 1)
            machine._active += bool(p["active"])
        machine.flush()

    def close(self) -> None:
        pass


def stream_patterns(turns: DataFrame, make: Callable[[], SemanticCache], output: str, *, initial: DataFrame | None = None, key: str = "cache_id", order: str = "position") -> DataFrame:
    """The turns of a streaming frame through semantic caches by key; rows of a micro-batch go in order.

    initial: a snapshot with the key, from which caches start; it counts in a checkpoint's first run only.
    """
    use_state_store(turns.sparkSession)
    own = _Processor(make, StructType.fromDDL(output).names, key, order)
    start = initial.groupBy(key) if initial is not None else None
    return turns.groupBy(key).transformWithStateInPandas(own, output, "append", "none", initialState=start)


def _pattern_rows(machine: SemanticCache, key: str, k) -> list[dict]:
    return [{key: k, "number": i, **{c: p[c] for c in _NAMES}, "centroid": p["centroid"]} for i, p in enumerate(machine.patterns)]


def patterns_after(turns: DataFrame, make: Callable[[], SemanticCache], *, key: str = "cache_id", order: str = "position") -> DataFrame:
    """The snapshot of each cache after all its turns, in one pass over sorted partitions."""
    schema = StructType.fromDDL(f"{key} {turns.schema[key].dataType.simpleString()}, {SNAPSHOT}")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = None, None
        for b in batches:
            for row in b.to_pylist():
                if machine is None or row[key] != now:
                    if machine:
                        yield pa.RecordBatch.from_pylist(_pattern_rows(machine, key, now), schema=arrow)
                    now, machine = row[key], make()
                machine.turn(row)
        if machine:
            yield pa.RecordBatch.from_pylist(_pattern_rows(machine, key, now), schema=arrow)

    return turns.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def resume(turns: DataFrame, snapshot: DataFrame, make: Callable[[], SemanticCache], output: str, *, key: str = "cache_id", order: str = "position") -> DataFrame:
    """Each cache's turns in order, from its patterns in a snapshot; caches that it doesn't have start empty."""
    schema = StructType.fromDDL(output)
    arrow = arrow_schema(schema)
    kept = snapshot.select(F.col(key), F.lit(0).alias("__kind"), F.col("number").cast("long").alias("__at"), F.struct(*(c for c in snapshot.columns if c != key)).alias("__pattern"), F.lit(None).alias("__turn"))
    asked = turns.select(F.col(key), F.lit(1).alias("__kind"), F.col(order).cast("long").alias("__at"), F.lit(None).alias("__pattern"), F.struct(*turns.columns).alias("__turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, machine, patterns = None, False, None, []
        for b in batches:
            out = []
            for row in b.to_pylist():
                if not begun or row[key] != now:
                    now, begun, machine, patterns = row[key], True, None, []
                if row["__pattern"]:
                    patterns.append({c: row["__pattern"][c] for c in (*_NAMES, "centroid")})
                    continue
                if machine is None:
                    machine = make()
                    machine.patterns = patterns
                    machine._group("")
                out.append({key: now, **machine.turn(row["__turn"])})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return kept.unionByName(asked).repartition(key).sortWithinPartitions(key, "__kind", "__at").mapInArrow(run, schema)


def checkpointed_patterns(spark: SparkSession, checkpoint: str, *, key: str = "cache_id") -> DataFrame:
    """The snapshot that a stream's checkpoint holds, after its last micro-batch."""
    use_state_store(spark)
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    rows = state("patterns").select(F.col(f"key.{key}").alias(key), F.col("user_map_key.number").alias("number"), "user_map_value.*")
    packed = state("centroids").select(F.col(f"key.{key}").alias(key), F.col("user_map_value.numbers").alias("numbers"), F.col("user_map_value.matrix").alias("matrix"))
    kind = packed.schema[key].dataType.simpleString()
    arrow = arrow_schema(StructType.fromDDL(f"{key} {kind}, number int, centroid array<double>"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{key: r[key], "number": n, "centroid": row.tolist()} for r in b.to_pylist() for n, row in zip(r["numbers"], np.frombuffer(r["matrix"]).reshape(len(r["numbers"]), -1), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    centroids = packed.mapInArrow(unpack, f"{key} {kind}, number int, centroid array<double>")
    return rows.join(centroids, [key, "number"]).select(key, *(c.split()[0] for c in SNAPSHOT.split(", ")))


def _thresholds(make: Callable[[], SemanticCache]) -> str:
    m = make()
    return ", ".join(f"{f.name}={getattr(m, f.name)}" for f in dataclasses.fields(SemanticCache) if f.name not in ("patterns", "learn"))


def save_patterns(snapshot: DataFrame, path: str, make: Callable[[], SemanticCache], *, embedder: str) -> None:
    """Write a snapshot; what it was learnt with goes last, so a snapshot without it is no whole one."""
    snapshot.write.mode("error").parquet(f"{path}/patterns")
    about = snapshot.sparkSession.range(1).select(F.lit(FORMAT).alias("format"), F.lit(embedder).alias("embedder"), F.lit(_thresholds(make)).alias("thresholds"))
    about.coalesce(1).write.mode("error").parquet(f"{path}/about")


def load_patterns(spark: SparkSession, path: str, make: Callable[[], SemanticCache], *, embedder: str) -> DataFrame:
    """A snapshot as a table; refused unless format, embedder and thresholds agree."""
    got = tuple(spark.read.parquet(f"{path}/about").select("format", "embedder", "thresholds").first())
    want = (FORMAT, embedder, _thresholds(make))
    if got != want:
        raise ValueError(f"the snapshot is of {got}, not of {want}")
    return spark.read.parquet(f"{path}/patterns")
