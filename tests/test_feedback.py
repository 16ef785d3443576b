"""Late outcomes and recognition results: streams, tables and plain loops give the same rows."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnwise.plans import catalog, serving_queries
from turnwise.streaming import dedupe, feedback, replay

SF = "/root/testdata/sf0.001"
MINUTE = 60_000_000
START = datetime(2024, 1, 1, tzinfo=UTC)
EVENTS = "cache_id long, kind string, trace_id string, outcome_id long, ts timestamp, success boolean"


def outcomes(rows, ttl, grace, capacity):
    """By the rule alone, over rows (kind, trace, outcome, minute, success) in order; with the traces that went."""
    traces, out = [], []  # [id, minute, verified], in order of arrival
    for kind, i, outcome, at, success in rows:
        traces = [t for t in traces if at <= t[1] + ttl + grace]
        mine = next((t for t in traces if t[0] == i), None)
        if kind == "trace":
            traces = [t for t in traces if t is not mine]
            while len(traces) >= capacity:
                gone = next((t for t in traces if t[2]), traces[0])
                out.append((gone[0], outcome, "evicted", False, "verified" if gone[2] else "capacity", None))
                traces.remove(gone)
            traces.append([i, at, False])
            out.append((i, outcome, kind, True, None, None))
        elif kind == "discard":
            traces = [t for t in traces if t is not mine]
            out.append((i, outcome, kind, mine is not None, None if mine else "unknown", None))
        else:
            reason = "unknown" if not mine else "repeated" if mine[2] else "expired" if at > mine[1] + ttl else None
            if reason is None:
                mine[2] = True
            out.append((i, outcome, kind, reason is None, reason, success))
    return out


def some_events(n=400, seed=1):
    rng, rows, at, made = random.Random(seed), [], 0, []
    for i in range(n):
        at += rng.choice([0, 1, 1, 2, 7])
        kind = rng.choices(["trace", "feedback", "discard"], [5, 7, 1])[0]
        if kind == "trace":
            made.append(f"t{i}" if rng.random() < 0.9 or not made else rng.choice(made))  # some are made again
            rows.append((kind, made[-1], i, at, None))
        else:
            rows.append((kind, rng.choice(made[-15:] or ["none"]) if rng.random() < 0.9 else "none", i, at, rng.random() < 0.7))
    return sorted(rows, key=lambda r: (r[3], r[0] != "trace", r[2]))


def machine_rows(rows):
    return [{"kind": k, "trace_id": i, "outcome_id": o, "at": at * MINUTE, "success": s} for k, i, o, at, s in rows]


@pytest.mark.parametrize("capacity", [1, 3, 8, 1000])
def test_ledger_equals_the_rule(capacity):
    rows = some_events()
    m = feedback.Ledger(ttl=20 * MINUTE, grace=15 * MINUTE, capacity=capacity)
    got = [tuple(x[c] for c in ("trace_id", "outcome_id", "kind", "accepted", "reason", "success")) for r in machine_rows(rows) for x in m.turn(r)]
    want = outcomes(rows, 20, 15, capacity)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {g[4] for g in got} >= {None, "unknown", "repeated"} and len(m.traces) <= capacity
    again = replay.restore(lambda: feedback.Ledger(ttl=20 * MINUTE, grace=15 * MINUTE, capacity=capacity), json.loads(json.dumps(replay.snapshot(m))))
    more = machine_rows([(k, i, o, at + 500, s) for k, i, o, at, s in some_events(60, 2)])
    assert [again.turn(r) for r in more] == [m.turn(r) for r in more]


@pytest.mark.parametrize("capacity", [4, 1000])
def test_stream_equals_the_rule(spark, tmp_path, capacity):
    rows = some_events(240)
    stamped = [(k, i, o, START + timedelta(minutes=at), s) for k, i, o, at, s in rows]
    for part in range(4):
        some = [(c, k, i, o, ts, s) for c in (1, 2) for k, i, o, ts, s in stamped[part * 60 : part * 60 + 60]]
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # at equal times a trace of a later file can't come before an outcome of an earlier one
    assert all(stamped[k * 60 - 1][3] < stamped[k * 60][3] or stamped[k * 60][0] != "trace" for k in (1, 2, 3))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = feedback.stream_feedback(source, ttl=20 * MINUTE, grace=15 * MINUTE, capacity=capacity)
    name = f"ledger_{capacity}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    want = sorted(map(repr, outcomes(rows, 20, 15, capacity)))
    for cache in (1, 2):
        got = [tuple(r) for r in spark.table(name).filter(F.col("cache_id") == cache).drop("cache_id").collect()]
        assert sorted(map(repr, got)) == want
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "traces").load()
    held = [r.user_map_value["at"] for r in state.collect()]
    last = int(stamped[-1][3].timestamp() * 1e6)
    assert len(held) <= 2 * capacity and all(at + 35 * MINUTE >= last - 300 * MINUTE for at in held)  # timers took the old ones


def test_table_equals_the_rule(spark):
    rows = [r for r in some_events(600, 5) if r[0] != "discard"]
    df = spark.createDataFrame([(k, i, o, at * MINUTE, s) for k, i, o, at, s in rows], "kind string, trace_id string, outcome_id long, at long, success boolean")
    got = feedback.feedback_outcomes(df.filter("kind = 'trace'"), df.filter("kind = 'feedback'"), ttl=20 * MINUTE, grace=15 * MINUTE)
    want = [w for w in outcomes(rows, 20, 15, 10**9) if w[2] == "feedback"]
    assert {w[4] for w in want} == {None, "unknown", "repeated", "expired"}
    assert sorted(map(repr, (tuple(r) for r in got.select("trace_id", "outcome_id", "kind", "accepted", "reason", "success").collect()))) == sorted(map(repr, want))
    assert feedback.feedback_outcomes(df.limit(0), df.filter("kind = 'feedback'")).filter("reason <> 'unknown'").count() == 0


def test_ledger_query_equals_the_rule(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    by_cache = {}
    for r in serving_queries.ledger_rows(read).orderBy("at", "trace_first", "outcome_id", "trace_id").collect():
        by_cache.setdefault(r.cache_id, []).append((r.kind, r.trace_id, r.outcome_id, r["at"], r.success))
    want = [(c, *w[:2], *w[3:]) for c, rows in by_cache.items() for w in outcomes(rows, serving_queries.HOUR, serving_queries.HOUR, 3) if w[2] == "feedback"]
    got = catalog.QUERIES["trace_ledger"](spark, SF).select("cache_id", "trace_id", "outcome_id", "accepted", "reason", "success").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# -- recognition results ---------------------------------------------------------------------------------------------
def accepted(ids, last):
    """A plain list of the accepted ids."""
    kept, at = [], []
    for p, i in enumerate(ids):
        if i not in kept[-last:]:
            kept.append(i)
            at.append(p)
    return at


def far_apart(last):
    """Ids that come again after last - 1, last and last + 1 others, among ids that repeat at random."""
    rng, ids = random.Random(last), []
    for d in (last - 1, last, last + 1):
        ids += [f"x{d}", *(f"a{d}-{k}" for k in range(d)), f"x{d}"]
    return ids + [f"r{rng.randint(0, 2 * last)}" for _ in range(4 * last)]


@pytest.mark.parametrize("last, span", [(1000, 65_536), (1000, 700), (50, 17), (3, 2)])
def test_table_keeps_what_a_loop_keeps(spark, last, span):
    ids = far_apart(last) if last > 3 else [random.Random(9).choice("abcdef") for _ in range(60)]
    want = accepted(ids, last)
    if last == 1000:
        at = {d: [p for p, i in enumerate(ids) if i == f"x{d}"][1] for d in (999, 1000, 1001)}
        assert [at[d] in want for d in (999, 1000, 1001)] == [False, True, True]
    df = spark.createDataFrame(list(enumerate(ids)), "position long, utterance_id string").repartition(5, "utterance_id")
    got = dedupe.dedupe_recent(df, last=last, span=span).collect()
    assert sorted(r.position for r in got) == want


def test_keys_have_rings_of_their_own(spark):
    rng = random.Random(3)
    rows = [(p, rng.choice(["a", "b", None]), rng.choice("uvwxyz")) for p in range(300)]
    want = sorted(own[p] for k in ("a", "b", None) for own in [[p for p, s, _ in rows if s == k]] for p in accepted([i for _, s, i in rows if s == k], 4))
    df = spark.createDataFrame(rows, "position long, session_id string, utterance_id string")
    assert sorted(r.position for r in dedupe.dedupe_recent(df, key="session_id", last=4, span=25).collect()) == want
    assert dedupe.dedupe_recent(df.limit(0), last=4).count() == 0


def test_stream_keeps_what_a_loop_keeps(spark, tmp_path):
    ids = far_apart(50)
    want = accepted(ids, 50)
    schema = "session_id string, position long, utterance_id string"
    for part in range(3):
        rows = [(s, p, i) for s in ("one", "two") for p, i in enumerate(ids) if p % len(ids) // (len(ids) // 3 + 1) == part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = dedupe.stream_recent(source, last=50).writeStream.format("memory").queryName("heard").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    for s in ("one", "two"):
        assert sorted(r.position for r in spark.table("heard").filter(F.col("session_id") == s).collect()) == want
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "places").load()
    assert held.count() == 100


def test_results_query_equals_a_loop(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = sorted((r.position, r.utterance_id) for r in serving_queries.recognition_results(read).collect() if r.is_final and r.text.strip())
    want = [rows[k] for k in accepted([i for _, i in rows], 1000)]
    assert sorted(map(tuple, catalog.QUERIES["recent_results"](spark, SF).collect())) == want and len(want) < len(rows)
