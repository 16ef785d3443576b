"""The semantic cache in a stream and from snapshots, against a plain machine that compares each turn with every pattern."""

import functools
import random

import numpy as np
import pytest

from turnwise.plans import catalog, stream_queries
from turnwise.streaming import caches, pattern_state, replay

SF = "/root/testdata/sf0.001"
TURNS = "cache_id long, position long, state string, successor string, template string, valid array<string>, vector array<double>, evidence string, seed boolean"
OUT = "cache_id long, position long, source string, pattern int, similarity double, active int, candidates int"
make = functools.partial(caches.SemanticCache, admit=0.7, merge=0.8, route=0.7)


def plain(rows, c):
    """(position, source, pattern, active, candidates) turn by turn, by the definition alone."""
    patterns, out = [], []
    cos = lambda p, v: sum(a * b for a, b in zip(p["c"], v, strict=True))
    reliability = lambda p: (p["k"] + 1) / (p["n"] + 2)

    def active(p):
        return p["seed"] or (p["n"] >= c.least and len(p["e"]) >= c.least and reliability(p) >= c.admit)

    for r in sorted(rows, key=lambda r: r["position"]):
        v, served = r["vector"], None
        if not r["seed"]:
            ranked = sorted(((cos(p, v), reliability(p), -i) for i, p in enumerate(patterns) if active(p) and p["state"] == r["state"]), reverse=True)
            served = next((-i for s, _, i in ranked if s >= c.route and patterns[-i]["template"] in r["valid"]), None)
        source, number = ("fsm", served) if served is not None else ("slm", None)
        if number is None:
            same = [(cos(p, v), -i) for i, p in enumerate(patterns) if (p["state"], p["successor"], p["template"]) == (r["state"], r["successor"], r["template"])]
            best = max(same, default=(-2, 0))
            number = -best[1] if best[0] >= c.merge else len(patterns)
            if number == len(patterns):
                patterns.append({"state": r["state"], "successor": r["successor"], "template": r["template"], "c": v, "n": 0, "k": 0, "e": set(), "seed": r["seed"]})
            p = patterns[number]
            if r["template"] in r["valid"]:
                moved = np.array(p["c"]) * max(1, p["n"]) + np.array(v)
                p["c"] = (moved / np.sqrt((moved**2).sum())).tolist()
                p["k"] += 1
            p["n"] += 1
            p["e"].add(r["evidence"])
        n = sum(map(active, patterns))
        out.append((r["position"], source, number, n, len(patterns) - n))
    return out


def some_turns(n=240, dim=5):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = np.array(rng.choice(centres)) + np.array([rng.gauss(0, 0.25) for _ in range(dim)])
        t = f"t{rng.randint(0, 2)}"
        valid = rng.sample(["t0", "t1", "t2"], rng.randint(0, 3))
        rows.append((i % 3, i, f"s{rng.randint(0, 1)}", "n", t, valid, (v / np.linalg.norm(v)).tolist(), f"e{rng.randint(0, 90)}", rng.random() < 0.05))
    return rows


def short(rows):
    return sorted((r.cache_id, r.position, r.source, r.pattern, r.active, r.candidates) for r in rows)


def wanted(rows, c):
    names = [x.split()[0] for x in TURNS.split(", ")]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    return sorted((k, *x) for k in {r[0] for r in rows} for x in plain([d for d in dicts if d["cache_id"] == k], c))


def run_stream(spark, folder, checkpoint, name, *, initial=None):
    source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = pattern_state.stream_patterns(source, make, OUT, initial=initial)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def test_batch_equals_a_plain_loop(spark):
    rows = some_turns()
    df = spark.createDataFrame(rows, TURNS)
    want = wanted(rows, make())
    assert {w[2] for w in want} == {"fsm", "slm"}
    assert short(replay.replay(df, make, OUT).collect()) == want


def test_query_equals_a_plain_loop(spark):
    turns = stream_queries.embedding_turns(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    rows = [tuple(r[c.split()[0]] for c in TURNS.split(", ")) for r in turns.collect()]
    assert short(catalog.QUERIES["replay_v3"](spark, SF).collect()) == wanted(rows, stream_queries.make_semantic())


def test_stop_anywhere_and_go_on_from_a_snapshot(spark, tmp_path):
    rows = some_turns()
    want = wanted(rows, make())
    df = spark.createDataFrame(rows, TURNS)
    for part in range(4):  # one file, and so one micro-batch, for each quarter
        df.filter(f"position between {part * 60} and {part * 60 + 59}").coalesce(1).write.mode("append").parquet(str(tmp_path / ("first" if part < 2 else "second")))
    q = run_stream(spark, str(tmp_path / "first"), str(tmp_path / "cp1"), "first_half")
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 2
    snapshot = pattern_state.checkpointed_patterns(spark, str(tmp_path / "cp1"))
    pattern_state.save_patterns(snapshot, str(tmp_path / "snapshot"), make, embedder="five numbers")
    with pytest.raises(ValueError, match="other"):
        pattern_state.load_patterns(spark, str(tmp_path / "snapshot"), make, embedder="other")
    with pytest.raises(ValueError, match="admit=0.9"):
        pattern_state.load_patterns(spark, str(tmp_path / "snapshot"), functools.partial(make, admit=0.9), embedder="five numbers")
    again = pattern_state.load_patterns(spark, str(tmp_path / "snapshot"), make, embedder="five numbers")
    # the snapshot of the stream is that of a batch over the same turns
    half = df.filter("position < 120")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, pattern_state.patterns_after(half, make).collect()))
    run_stream(spark, str(tmp_path / "second"), str(tmp_path / "cp2"), "second_half", initial=again)
    assert short(spark.table("first_half").unionByName(spark.table("second_half")).collect()) == want
    assert short(pattern_state.resume(df.filter("position >= 120"), again, make, OUT).collect()) == [w for w in want if w[1] >= 120]


class Map(dict):
    """A map state that counts what is written."""

    written = 0

    def getValue(self, k):  # noqa: N802
        return self.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v
        self.written += sum(len(x) if isinstance(x, bytes) else 1 for x in v)


class Value:
    now = None

    def get(self):
        return self.now

    def update(self, v):
        self.now = v


def test_what_a_batch_writes_follows_the_patterns_it_touches():
    rng, maps = np.random.default_rng(0), (Map(), Map(), Value())
    row = lambda i, v, state: {"position": i, "state": state, "successor": "n", "template": "t", "valid": ["t"], "vector": (v / np.linalg.norm(v)).tolist(), "evidence": str(i), "seed": False}
    vectors = rng.standard_normal((1500, 64))
    machine = pattern_state.StoredCache.over(make(), *maps)
    for i, v in enumerate(vectors):
        machine.turn(row(i, v, f"s{i % 3}"))
    patterns, chunks = machine.flush()
    assert patterns == len(maps[0]) > 1400 and chunks == len(maps[1]) == 3 * 8
    before = maps[1].written
    machine = pattern_state.StoredCache.over(make(), *maps)  # another micro-batch: one turn
    assert machine.turn(row(2000, vectors[7], "s1"))["pattern"] == 7
    assert machine.flush() == (1, 1)
    assert maps[1].written - before <= pattern_state.CHUNK * (64 * 8 + 1) + 1
    assert len(machine._held) == 500  # patterns of other states weren't read
    machine = pattern_state.StoredCache.over(make(), *maps)
    assert machine.turn(row(2001, vectors[7], "s1"))["source"] == "fsm"
    assert machine.flush() == (1, 0)  # served: no centroid moved


def test_cost_of_a_turn_doesnt_grow_with_history():
    """Counters and sealed evidence: a cache holds what its patterns need, however many turns there were."""
    heat = caches.HeatCache()
    for i in range(5000):
        heat.turn({"position": i, "key": "k", "surface": "s", "example": str(i), "variant": str(i % 7), "decision": "d", "ok": True})
    assert len(heat.patterns["k"]["examples"]) == heat.examples and heat.promoted() == 1
    life = caches.Lifecycle()
    for i in range(3000):
        life.turn({"position": i, "exact": f"k{i % 40}", "typed": "t", "decision": "d", "risky": False, "evidence": i, "success": None})
    counted = {s: sum(e["status"] == s for e in life.entries.values()) for s in ("candidate", "shadow", "active", "quarantined")}
    assert {s: life.counts()[s] for s in counted} == counted and max(len(e["evidence"]) for e in life.entries.values()) <= 8
    restored = replay.restore(caches.Lifecycle, replay.snapshot(life))
    assert restored.counts() == life.counts()


def test_queries_go_on_where_the_whole_replay_is(spark):
    whole = {(r.cache_id, r.position): tuple(r) for r in catalog.QUERIES["replay_v3"](spark, SF).collect()}
    half = max(p for _, p in whole) // 2
    want = sorted(map(repr, (v for (_, p), v in whole.items() if p > half)))
    for name in ("resumed_replay", "streamed_replay"):
        assert sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, SF).collect()))) == want, name
