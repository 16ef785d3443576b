"""Caches of keyed entries in a stream: Spark's state has a row for each entry, and a micro-batch reads and writes those that its turns name.

For machines whose learnt state is one dictionary of entries (``Lifecycle.entries``, ``HeatCache.patterns``) and a few counts, which are kept beside it.
"""

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from .caches import HeatCache, Lifecycle
from .replay import use_state_store


class Entries(dict):
    """A dictionary over a map of Spark's state: entries come in when they are asked for, and go out if they changed."""

    def __init__(self, state):
        super().__init__()
        self.state, self.before = state, {}

    def __missing__(self, key):
        stored = self.state.getValue((key,))
        if stored is None:
            raise KeyError(key)
        self.before[key] = stored[0]
        self[key] = json.loads(stored[0])
        return self[key]

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def flush(self) -> int:
        new = {k: json.dumps(v, sort_keys=True) for k, v in self.items()}
        changed = {k: v for k, v in new.items() if self.before.get(k) != v}
        for k, v in changed.items():
            self.state.updateValue((k,), (v,))
        self.before = new
        return len(changed)


def attach(machine, state, counts) -> Entries:
    """Let a new machine work on stored entries and counts."""
    entries, stored = Entries(state), json.loads((counts.get() or ("{}",))[0])
    machine._known = entries
    if isinstance(machine, Lifecycle):
        machine.entries = entries
        machine._counts.update(stored)
    elif isinstance(machine, HeatCache):
        machine.patterns, machine._promoted = entries, stored.get("promoted", 0)
    else:
        raise TypeError(f"{type(machine).__name__} has no entries")
    return entries


def detach(machine, entries: Entries, counts) -> int:
    """Write what changed; returns how many entries that was."""
    own = dict(machine._counts) if isinstance(machine, Lifecycle) else {"promoted": machine._promoted}
    counts.update((json.dumps(own, sort_keys=True),))
    return entries.flush()


class _Processor(StatefulProcessor):
    def __init__(self, make: Callable, names: list[str], key: str, order: str):
        self.make, self.names, self.key, self.order = make, names, key, order

    def init(self, handle) -> None:
        self.entries = handle.getMapState("entries", "key string", "entry string")
        self.counts = handle.getValueState("counts", "counts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine = self.make()
        entries = attach(machine, self.entries, self.counts)
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").astype(object)
        out = [{self.key: key[0], **machine.turn(r)} for r in frame.where(frame.notna(), None).to_dict("records")]
        detach(machine, entries, self.counts)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_entries(turns: DataFrame, make: Callable, output: str, *, key: str = "cache_id", order: str = "position") -> DataFrame:
    """The turns of a streaming frame through ``Lifecycle`` or ``HeatCache`` machines by key; rows of a micro-batch go in order."""
    use_state_store(turns.sparkSession)
    return turns.groupBy(key).transformWithStateInPandas(_Processor(make, StructType.fromDDL(output).names, key, order), output, "append", "none")
