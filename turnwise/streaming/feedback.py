"""Outcomes that reach remembered traces late: accepted once, within a time to live, with a reason for each that is refused.

Three forms of one rule.  ``Ledger`` is the machine of one cache: traces in order of arrival, at most ``capacity`` of them.  ``stream_feedback`` keeps
its traces in Spark's state, a row for each, with an event-time timer for the oldest one; ``replay.replay`` runs it over a table.  ``feedback_outcomes`` states
the rule for whole tables without a capacity, in aggregates and joins only.

The rule for an outcome at time t of a trace made at time c (the newest one of its id that isn't later): without such a trace, or after
c + ttl + grace, when it is forgotten: ``unknown``; an outcome was accepted before: ``repeated``; after c + ttl: ``expired``; else it is accepted.  Discarding
forgets a trace at once.  Over its capacity, a cache forgets its oldest trace with an outcome, or else its oldest; that one is reported as evicted.

Times are microseconds.  At equal times traces go before outcomes; then the order of the ``order`` column holds.
"""

import heapq
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .replay import use_state_store

DAY = 86_400_000_000
OUTPUT = "trace_id string, outcome_id long, kind string, accepted boolean, reason string, success boolean"


@dataclass
class Ledger:
    """Traces of one cache.  Rows: kind (trace, feedback, discard), trace_id, outcome_id, at, success; each gives a row, and the evicted trace another."""

    ttl: int = DAY
    grace: int = DAY
    capacity: int = 10_000
    traces: dict[str, dict] = field(default_factory=dict)  # id -> number, at, verified
    next: int = 0

    def __post_init__(self):
        self._known = None

    def _order(self) -> None:
        """By number: all traces, and those with an outcome (numbers that are no longer right are passed over)."""
        if self._known is not self.traces:
            self._known = self.traces
            rows = sorted((x["number"], i) for i, x in self.traces.items())
            self._oldest = OrderedDict(rows)
            self._verified = [(n, i) for n, i in rows if self.traces[i]["verified"]]
            heapq.heapify(self._verified)

    def _drop(self, trace_id: str) -> None:
        self._oldest.pop(self.traces.pop(trace_id)["number"])

    def _evict(self) -> str:
        while self._verified:
            number, i = heapq.heappop(self._verified)
            if self.traces.get(i, {}).get("number") == number:
                return i
        return next(iter(self._oldest.values()))

    def forget(self, now: int) -> None:
        """Traces that no outcome at ``now`` or later can reach."""
        self._order()
        while self._oldest and now > self.traces[i := next(iter(self._oldest.values()))]["at"] + self.ttl + self.grace:
            self._drop(i)

    def turn(self, row: dict) -> list[dict]:
        self._order()
        i, at = row["trace_id"], row["at"]
        told = lambda i, kind, accepted, reason=None, success=None: {"trace_id": i, "outcome_id": row.get("outcome_id"), "kind": kind, "accepted": accepted, "reason": reason, "success": success}
        found = self.traces.get(i)
        if found and at > found["at"] + self.ttl + self.grace:
            self._drop(i)
            found = None
        if row["kind"] == "trace":
            self.forget(at)
            if found:
                self._drop(i)
            out = []
            while len(self.traces) >= max(1, self.capacity):
                gone = self._evict()
                out.append(told(gone, "evicted", False, "verified" if self.traces[gone]["verified"] else "capacity"))
                self._drop(gone)
            self.traces[i] = {"number": self.next, "at": at, "verified": False}
            self._oldest[self.next] = i
            self.next += 1
            return [told(i, "trace", True), *out]
        if row["kind"] == "discard":
            if found:
                self._drop(i)
            return [told(i, "discard", found is not None, None if found else "unknown")]
        reason = "unknown" if not found else "repeated" if found["verified"] else "expired" if at > found["at"] + self.ttl else None
        if reason is None:
            found["verified"] = True
            heapq.heappush(self._verified, (found["number"], i))
        return [told(i, "feedback", reason is None, reason, row.get("success"))]


class _Traces(dict):
    """Traces over a map of Spark's state; all come in at the first use, at most ``capacity`` of them, and only changes go out."""

    def __init__(self, state):
        super().__init__()
        self.state, self.stored = state, {}
        for (i,), (number, at, verified) in state.iterator():
            self[i] = {"number": number, "at": at, "verified": verified}
            self.stored[i] = (number, at, verified)

    def flush(self) -> int:
        now = {i: (x["number"], x["at"], x["verified"]) for i, x in self.items()}
        gone, new = self.stored.keys() - now.keys(), {i: v for i, v in now.items() if self.stored.get(i) != v}
        for i in gone:
            self.state.removeKey((i,))
        for i, v in new.items():
            self.state.updateValue((i,), v)
        self.stored = now
        return len(gone) + len(new)


class _Processor(StatefulProcessor):
    def __init__(self, ledger: dict, key: str, order: str):
        self.ledger, self.key, self.order = ledger, key, order

    def init(self, handle) -> None:
        self.handle = handle
        self.traces = handle.getMapState("traces", "trace_id string", "number long, at long, verified boolean")
        self.next = handle.getValueState("next", "number long, timer long")

    def _machine(self) -> Ledger:
        m = Ledger(**self.ledger)
        m.traces = _Traces(self.traces)
        m.next, self.timer = self.next.get() or (0, -1)
        return m

    def _keep(self, m: Ledger) -> None:
        m.traces.flush()
        oldest = next(iter(m._oldest.values()), None)
        due = -1 if oldest is None else (m.traces[oldest]["at"] + m.ttl + m.grace) // 1000 + 1
        if due != self.timer:
            if self.timer >= 0:
                self.handle.deleteTimer(self.timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.next.update((m.next, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m, out = self._machine(), []
        m._order()
        for r in pd.concat(list(rows)).sort_values(["at", "trace_first", self.order], kind="stable").to_dict("records"):
            out += [{self.key: key[0], **x} for x in m.turn(r)]
        self._keep(m)
        yield pd.DataFrame(out, columns=[self.key, *(c.split()[0] for c in OUTPUT.split(", "))]).astype({"outcome_id": "Int64", "success": "boolean", "accepted": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m = self._machine()
        self.timer = -1  # this one is used up
        m.forget(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._keep(m)
        return iter([])

    def close(self) -> None:
        pass


def ranked(events: DataFrame) -> DataFrame:
    """Traces before outcomes, for sorting at equal times."""
    return events.withColumn("trace_first", F.when(F.col("kind") == "trace", 0).otherwise(1))


def stream_feedback(events: DataFrame, *, ttl: int = DAY, grace: int = DAY, capacity: int = 10_000, key: str = "cache_id", order: str = "outcome_id", late: str = "0 seconds") -> DataFrame:
    """The rule over a streaming frame (key, kind, trace_id, outcome_id, ts timestamp, success) that comes in order of time, ``late`` at most."""
    use_state_store(events.sparkSession)
    own = _Processor({"ttl": ttl, "grace": grace, "capacity": capacity}, key, order)
    rows = ranked(events.withColumn("at", F.unix_micros("ts"))).withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(own, f"{key} {events.schema[key].dataType.simpleString()}, {OUTPUT}", "append", "eventTime")


class LedgerRows(Ledger):
    """A ledger for ``replay.replay``, whose machines give one row each turn: without the rows of evicted traces."""

    def turn(self, row: dict) -> dict:
        return super().turn(row)[0]


def feedback_outcomes(traces: DataFrame, feedback: DataFrame, *, ttl: int = DAY, grace: int = DAY) -> DataFrame:
    """``feedback`` (trace_id, outcome_id, at, ...) with accepted and reason, by all ``traces`` (trace_id, at); no capacity.

    Outcomes go to the newest trace of their id by one aggregate; the first one within the time to live is found by another, so a trace with very many
    outcomes is combined before the shuffle, and no window holds them.
    """
    made = traces.select(F.col("trace_id").alias("__trace"), F.col("at").alias("__made"))
    near = feedback.select("outcome_id", "trace_id", "at").join(made, (F.col("trace_id") == F.col("__trace")) & (F.col("__made") <= F.col("at")))
    newest = near.groupBy("outcome_id", "trace_id", "at").agg(F.max("__made").alias("__made"))
    first = newest.filter(F.col("at") <= F.col("__made") + ttl).groupBy("trace_id", "__made").agg(F.min(F.struct("at", "outcome_id")).alias("__first"))
    joined = newest.join(first, ["trace_id", "__made"], "left")
    here = F.struct("at", "outcome_id")
    reason = F.when(F.col("at") > F.col("__made") + ttl + grace, "unknown").when(here > F.col("__first"), "repeated").when(F.col("at") > F.col("__made") + ttl, "expired")
    decided = joined.select(F.col("outcome_id").alias("__id"), reason.alias("reason"), F.lit(True).alias("__known"))
    out = feedback.join(decided, F.col("outcome_id") == F.col("__id"), "left")
    why = F.when(F.col("__known"), F.col("reason")).otherwise("unknown")
    return out.withColumn("reason", why).withColumn("accepted", F.col("reason").isNull()).drop("__id", "__known")
