"""What used to be cut, capped or refused: whole results, or a status that says what is left out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import alignment, matching, metrics, ordering
from turnwise.operators import dialogue as D
from turnwise.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["spread", "equal", "steps", "far"])
def test_percentiles_equal_numpy(spark, kind, monkeypatch):
    monkeypatch.setattr(metrics, "LEAF", 50)
    monkeypatch.setattr(metrics, "BINS", 32)
    rng = random.Random(kind)
    draw = {"spread": lambda: rng.gauss(0, 5), "equal": lambda: 3.0, "steps": lambda: float(rng.randint(0, 3)), "far": lambda: rng.choice([1e-300, 1.0, 1e308, -1e308]) * rng.random()}[kind]
    rows = [(g, draw()) for g, n in (("a", 3000), ("b", 1), ("c", 2), (None, 700)) for _ in range(n)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    got = {(r.g, r.share): r.percentile for r in metrics.exact_percentiles(df, "g", F.col("v"), shares).collect()}
    for g in ("a", "b", "c", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for q in shares:
            at = q * (len(values) - 1)
            lo, hi = values[int(np.floor(at))], values[int(np.ceil(at))]
            assert got[g, q] == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-12, abs=0)
    assert len(got) == 4 * len(shares)


def test_percentiles_hold_no_group_in_one_buffer(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    got = metrics.exact_percentiles(df, "g", F.col("v"), [0.5])
    values = np.arange(100_000) * 7919 % 100_003
    assert got.first().percentile == np.percentile(values, 50)


def test_round_robin_takes_all(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in rng.sample(range(1000), 200)]
    got = ordering.round_robin(spark.createDataFrame(rows, "s string, i long"), "s", [F.floor(F.col("i") / 50)], ["i"]).orderBy("place").collect()
    own = {s: sorted(i for k, i in rows if k == s) for s in ("a", "b", None)}
    want = [(s, own[s][n]) for n in range(200) for s in (None, "a", "b") if n < len(own[s])]
    assert [(r.s, r.i) for r in got] == want and [r.place for r in got] == list(range(1, 201))


def test_alignment_reaches_any_distance():
    turn = ["one two three four five"]
    for others in (4, 40, 400):
        got = alignment.align(turn, ["one two", " ".join(f"x{i}" for i in range(others)), "three four five"])
        assert got == [(0, 2, 1.0, "")]
    assert alignment.align(turn, ["one two", " ".join(["x"] * 40), "three four five"], reach=30) == [(-1, -1, 0.6, "")]
    assert alignment.align(turn, ["one two", "x", "three four five", "one two three four five"]) == [(3, 3, 1.0, "")]


def test_status_tells_what_wasnt_matched(spark):
    texts = ["where is the old drill", "who is the drill", "where is the " + "long " * 200 + "drill", ""]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id int, w array<string>")
    assert [r.status for r in matching.match_status(df).orderBy("id").collect()] == ["matched", "no match", "too long", "no match"]
    edges = [(0, "S:x", 1), (1, "S:y", 2), (2, "S:z", 3)]
    many = spark.createDataFrame([(0, ["a"] * 40), (1, ["a"] * 5)], "id int, w array<string>")
    assert [r.status for r in matching.match_status(many, edges, {3: "i"}, limit=100).orderBy("id").collect()] == ["cut", "matched"]


def test_typing_by_join_equals_typing_by_table(spark):
    a, b = (sorted(map(repr, map(tuple, catalog.QUERIES[n](spark, SF).collect()))) for n in ("longest_match_scan", "typed_by_join"))
    assert a == b


def test_the_guards_own_decision_is_checked():
    inv = D.Inventory([{"id": "1", "name": "saw", "family": "tool", "attributes": {}, "drawer": None}, {"id": "2", "name": "drill", "family": "tool", "attributes": {}, "drawer": "drawer 2"}])
    for text, broken in (("where is the saw", "no_drawer_on_record"), ("where is the drill", None), ("which tool", None)):
        q = D.Request([("user", text)], {}, None)
        d, reason = D.checked("no json", q, inv)
        assert reason == "no_json_object" and D.guard_error(d, q, inv) == broken


def test_prompts_tell_how_many_candidates_they_leave_out(spark):
    items = spark.createDataFrame([("lab", str(i), f"thing {i}", "tool", {"size": str(i)}, f"drawer {i}") for i in range(30)], "setting string, id string, name string, family string, attributes map<string,string>, drawer string")
    asked = spark.createDataFrame([(0, "lab", "which tool is here", "{}"), (1, "lab", "where is the thing 7", "{}")], "id long, setting string, text string, raw string")
    for largest in (1000, 5):
        assert {r.id: r.left_out for r in D.judge(asked, items, largest=largest).collect()} == {0: 18, 1: 0}


def test_written_tables_go_with_their_scratch(spark):
    import os

    from turnwise.session import keeper, scratch, workspace

    kept = workspace(spark, "kept")
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            n = keeper(spark, "inner")(spark.range(5), "t").count()
            assert n == 5 and len(inner) == 1 and os.path.isdir(inner[0].removeprefix("file://"))
        assert not os.path.exists(inner[0].removeprefix("file://"))
        rows = metrics.exact_percentiles(spark.range(9).select(F.lit("a").alias("g"), F.col("id").alias("v")), "g", F.col("v"), [0.5]).collect()
        assert rows[0].percentile == 4.0 and os.path.isdir(outer[-1].removeprefix("file://"))
    assert not any(os.path.exists(p.removeprefix("file://")) for p in outer) and kept not in outer


def test_subset_join_takes_phrases_of_any_length(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    keys = [(i, rng.sample(words, rng.randint(0, 8)) + ["every"]) for i in range(60)] + [(100, []), (101, ["every", "every"])]
    phrases = [(f"p{i}", rng.choices([*words, "every"], k=rng.randint(0, 4))) for i in range(80)] + [("hot", ["every"])]
    got = matching.subset_join(spark.createDataFrame(keys, "key int, words array<string>"), spark.createDataFrame(phrases, "phrase string, words array<string>")).collect()
    want = sorted((k, p) for k, w in keys for p, v in phrases if v and set(v) <= set(w))
    assert sorted(map(tuple, got)) == want and len(want) > 100
