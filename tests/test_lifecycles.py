"""The lifecycle and the heat cache against plain loops that count everything anew each turn, over tables and in streams; components and splits."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import graph, splits
from turnwise.plans import catalog, stream_queries
from turnwise.plans.base import turn_log
from turnwise.streaming import caches, entry_state, replay

SF = "/root/testdata/sf0.001"


def lifecycle(rows, policy="imitation", siblings=True):
    """By the rules alone: entries with whole lists of what was seen."""
    routine, risky, verified = caches.POLICIES[policy]
    entries, out = {}, []
    limit = lambda e: risky if e["risky"] else routine

    def ready(e):
        t, good, bad = limit(e), e["good"], e["bad"]
        seen = e["agree"] >= t.agreements and e["shadow"] >= t.shadow and not e["missed"] and len(set(e["evidence"])) >= t.evidence and not bad
        return seen and (not verified or (good >= t.successes and caches.wilson(good, good + bad) >= t.wilson))

    def promote(e, activate):
        if e["status"] == "candidate" and e["agree"] >= limit(e).agreements:
            e["status"] = "shadow"
        if activate and e["status"] in ("candidate", "shadow") and ready(e):
            e["status"] = "active"

    for r in rows:
        keys = [("exact", r["exact"]), ("typed", r["typed"])]
        active = [k for k in keys if k in entries and entries[k]["status"] == "active"]
        source, decision, behind = "slm", r["decision"], []
        if active:
            first = entries[active[0]]
            same = [k for k in active if entries[k]["decision"] == first["decision"]]
            drawn = int.from_bytes(hashlib.sha256(f"audit:{r['position']}:{r['evidence']}".encode()).digest()[:4], "big") / 2**32
            audited = drawn < limit(first).audit
            if audited and first["decision"] != r["decision"]:
                source = "slm_audit_fallback"
                for k in same:
                    entries[k]["status"] = "quarantined"
            else:
                source, decision, behind = f"fsm_{active[0][0]}" + ("_audited" if audited else ""), first["decision"], same if siblings else active[:1]
        else:
            behind = keys
            for k in keys:
                e = entries.get(k)
                if e is None or e["status"] == "quarantined":
                    entries[k] = e = {"status": "candidate", "decision": r["decision"], "risky": bool(r["risky"]), "agree": 1, "shadow": 0, "missed": 0, "good": 0, "bad": 0, "evidence": []}
                elif e["decision"] == r["decision"]:
                    e["agree"] += 1
                    e["shadow"] += e["status"] == "shadow"
                else:
                    e["missed"] += e["status"] == "shadow"
                    e["status"] = "quarantined"
                e["evidence"].append(r["evidence"])
                if e["status"] != "quarantined":
                    promote(e, not verified)
        if r["success"] is not None:
            for k in behind:
                e = entries[k]
                e["good" if r["success"] else "bad"] += 1
                if not r["success"]:
                    e["status"] = "quarantined"
                elif e["status"] != "quarantined":
                    promote(e, True)
        n = [sum(e["status"] == s for e in entries.values()) for s in ("active", "shadow", "quarantined")]
        out.append((r["position"], source, decision, *n))
    return out


def heat(rows, c):
    """(position, source, promoted, heat) with whole lists of examples."""
    patterns, out = {}, []

    def cool(p, step):
        p["heat"], p["last"] = p["heat"] * c.decay ** (step - p["last"]), step

    def promote(p, step):
        cool(p, step)
        n = p["right"] + p["wrong"]
        if p["confirmed"] >= c.confirmed and n >= c.shadow and len(set(p["examples"])) >= c.examples and len(set(p["variants"])) >= c.variants and p["right"] >= c.accuracy * n and p["heat"] >= c.heat:
            p["on"] = True

    for r in rows:
        step, p = r["position"], patterns.get(r["key"])
        served = bool(p and p["on"])
        if served and p["decision"] != r["decision"]:
            p["on"], p["heat"], p["last"] = False, p["heat"] * 0.5, step
        elif p and not served:
            p["right" if p["decision"] == r["decision"] else "wrong"] += 1
            promote(p, step)
        if r["ok"]:
            p = patterns.setdefault(r["key"], {"decision": r["decision"], "on": False, "confirmed": 0, "right": 0, "wrong": 0, "heat": 0.0, "last": step, "examples": [], "variants": []})
            cool(p, step)
            p["examples"].append(r["example"])
            p["variants"].append(r["variant"])
            p["confirmed"] += 1
            p["heat"] += 1
            if not p["on"]:
                promote(p, step)
        out.append((step, "fsm" if served else "slm", sum(x["on"] for x in patterns.values()), round(p["heat"], 6) if p else 0.0))
    return out


def by_cache(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        found.setdefault(r["cache_id"], []).append(r)
    return found


def some_turns(n=900):
    rng = random.Random(5)
    return [{"cache_id": i % 2, "position": i, "exact": f"k{rng.randint(0, 12)}", "typed": f"t{rng.randint(0, 2)}", "decision": rng.choices(["d", "e"], [60, 1])[0], "risky": rng.random() < 0.2, "evidence": str(rng.randint(0, n)), "success": rng.choices([None, True, False], [50, 48, 1])[0]} for i in range(n)]


@pytest.mark.parametrize("policy", ["imitation", "development", "calibrated"])
@pytest.mark.parametrize("siblings", [True, False])
def test_lifecycle_equals_the_rules(policy, siblings):
    sources = set()
    for own in by_cache(some_turns()).values():
        m = caches.Lifecycle(policy=policy, siblings=siblings)
        got = [tuple(m.turn(r).values()) for r in own]
        assert got == lifecycle(own, policy, siblings)
        sources |= {g[1] for g in got}
    assert {"slm", "fsm_typed"} <= sources


def test_lifecycle_query_equals_the_rules(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = by_cache([r.asDict() for r in stream_queries.event_turns(read).collect()])
    want = sorted((k, *x) for k, own in rows.items() for x in lifecycle(own))
    assert sorted(map(tuple, catalog.QUERIES["lifecycle_v2"](spark, SF).collect())) == want


def test_heat_query_equals_the_rules(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    t = turn_log(read).select((F.col("user_id") % 16).alias("cache_id"), "position", F.col("category").alias("key"), F.col("event_id").cast("string").alias("example"), (F.col("event_id") % 5).cast("string").alias("variant"), F.when(F.col("event_id") % 97 == 0, "odd").otherwise(F.col("category")).alias("decision"), F.coalesce("correct", F.lit(False)).alias("ok"))
    want = sorted((k, *x) for k, own in by_cache([r.asDict() for r in t.collect()]).items() for x in heat(own, caches.HeatCache()))
    got = sorted((r.cache_id, r.position, r.source, r.promoted, r.heat) for r in catalog.QUERIES["heat_cache_v1"](spark, SF).collect())
    assert got == [(*w[:4], pytest.approx(w[4], abs=2e-6)) for w in want] and {"fsm", "slm"} == {g[2] for g in got}


TURNS = "cache_id long, position long, exact string, typed string, decision string, risky boolean, evidence string, success boolean"


def test_stream_by_entry_equals_the_rules(spark, tmp_path):
    rows = some_turns(300)
    names = [c.split()[0] for c in TURNS.split(", ")]
    for part in range(3):
        some = [tuple(r[n] for n in names) for r in rows if r["position"] // 100 == part]
        spark.createDataFrame(some, TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    make = functools.partial(caches.Lifecycle, policy="development", siblings=True)
    out = entry_state.stream_entries(source, make, "cache_id long, position long, source string, decision string, active int, shadow int, quarantined int")
    q = out.writeStream.format("memory").queryName("lifecycles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    want = sorted((k, *x) for k, own in by_cache(rows).items() for x in lifecycle(own, "development"))
    assert sorted(map(tuple, spark.table("lifecycles").collect())) == want


class Store(dict):
    written = 0

    def getValue(self, k):  # noqa: N802
        return self.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v
        self.written += 1


class Value:
    now = None

    def get(self):
        return self.now

    def update(self, v):
        self.now = v


@pytest.mark.parametrize("make", [caches.Lifecycle, caches.HeatCache])
def test_a_batch_touches_the_entries_it_names(make):
    store, counts = Store(), Value()
    row = lambda i, k: {"position": i, "exact": f"k{k}", "typed": f"k{k}", "decision": "d", "risky": False, "evidence": str(i), "success": None, "key": f"k{k}", "example": str(i), "variant": str(i), "ok": True}
    whole = make()
    for at in range(0, 600, 50):
        m = make()
        entries = entry_state.attach(m, store, counts)
        assert [m.turn(row(i, i % 100)) for i in range(at, at + 50)] == [whole.turn(row(i, i % 100)) for i in range(at, at + 50)]
        before = store.written
        named = len(entries)
        assert entry_state.detach(m, entries, counts) <= named == store.written - before
        assert named == 50 * (2 if make is caches.Lifecycle else 1)
    with pytest.raises(TypeError):
        entry_state.attach(caches.SemanticCache(), store, counts)
    assert replay.snapshot(whole)


# -- components and splits -------------------------------------------------------------------------------------------
def roots(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "backwards"])
def test_components(spark, kind):
    rng = random.Random(kind)
    edges = {
        "chain": [(i, i + 1) for i in range(300)],
        "backwards": [(i, i + 1) for i in rng.sample(range(300), 299)] + [(500, 500)],
        "star": [(1000, i) for i in range(200)] + [(5000, 4000)],
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(350)],
    }[kind]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == roots(edges)


def test_folds_keep_groups_together(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randint(0, 80)}", f"s{rng.randint(0, 90)}") for _ in range(110)]
    got = {r.a: r.fold for r in splits.group_folds(spark.createDataFrame(rows, "a string, b string"), 3).collect()}
    assert got.keys() == {a for a, _ in rows} and all(got[a] == got[x] for a, b in rows for x, y in rows if b == y)
    root = roots([(("a", a), ("b", b)) for a, b in rows])
    groups = {}
    for a in got:
        groups.setdefault(root["a", a], []).append(a)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    for k, g in enumerate(order):
        assert got[g[0]] == (k % 3 if k // 3 % 2 == 0 else 2 - k % 3)
    assert splits.group_folds(spark.createDataFrame([], "a long, b long"), 3).count() == 0
