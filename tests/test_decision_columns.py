"""Decisions in columns against the rules in Python, on the cases of the queries and on random decisions."""

import json
import random

from pyspark.sql import functions as F

from turnwise.operators import decision_columns, dialogue
from turnwise.plans import rule_queries

SF = "/root/testdata/sf0.001"


def compare(spark, requests, items, **more):
    want = {r.id: r for r in dialogue.judge(requests, items, **more).collect()}
    got = {r.id: r for r in decision_columns.decide(requests, items, **more).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g.error, g.action, g.reply, g.signature, g.next_signature) == (w.error, w.action, w.reply, w.signature, w.next_signature), i
        assert g.memory.asDict() == json.loads(w.memory) and g.guard_used == (w.error is not None)
    return want


def test_all_cases(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    want = compare(spark, rule_queries.cases(read), rule_queries.items(read))
    assert len({w.error for w in want.values()}) > 8
    compare(spark, rule_queries.cases(read), rule_queries.items(read), largest=5)


ITEMS = [("lab", "saw", "saw", "tool", {}, "drawer 1"), ("lab", "r", "red tape", "tape", {"color": "red", "size": "small"}, "drawer 2"), ("lab", "b", "blue tape", "tape", {"color": "blue"}, "drawer 3"), ("lab", "lost", "lost hammer", "hammer", {}, None)]
ITEMS += [("lab", f"w{i}", f"wire {i}", "wire", {"gauge": str(i % 3)}, f"drawer {i}") for i in range(7)] + [("ward", "saw", "saw", "tool", {"color": "red"}, "drawer 9")]


def some_decision(rng):
    d = {
        "action": rng.choice([*dialogue.ACTIONS, "jump", 5]) if rng.random() < 0.1 else rng.choice(dialogue.ACTIONS),
        "item_family": rng.choice([None, None, "tape", "wire", "tool", "hammer", "nothing"]),
        "resolved_item_id": rng.choice([None, None, "r", "saw", "lost", "zzz", 7]),
        "attributes": rng.choice([{}, {}, {"color": "red"}, {"color": "red", "size": "small"}, {"gauge": "1"}, {"gauge": "9"}, {"a": 1}, []]),
        "missing_attributes": rng.choice([[], [], ["color"], ["color", "color"], ["gauge"], [1], "x"]),
        "failure_detected": rng.choice([False, True, "no"]) if rng.random() < 0.2 else False,
        "failure_type": rng.choice([*dialogue.FAILURES, "odd"]) if rng.random() < 0.3 else "none",
        "recovery_strategy": "none",
    }
    if rng.random() < 0.6:  # nearer to valid ones
        item = rng.choice(ITEMS)
        if d["action"] == "recover":
            d |= {"failure_detected": True, "failure_type": rng.choice(dialogue.FAILURES[1:]), "recovery_strategy": rng.choice(dialogue.STRATEGIES[1:])}
        if d["action"] in ("locate", "recover") and rng.random() < 0.8:
            d |= {"item_family": item[3], "resolved_item_id": item[1], "attributes": item[4], "missing_attributes": []}
        elif d["action"] != "locate":
            d |= {"resolved_item_id": None}
        if d["action"] in ("redirect", "cancel", "not_found"):
            d |= {"item_family": None, "attributes": {}, "missing_attributes": []}
    if rng.random() < 0.05:
        d.pop(rng.choice(list(d)))
    if rng.random() < 0.05:
        d["more"] = 1
    raw = json.dumps(d)
    return rng.choice(["", "[]", "null", raw[:-1], raw[:-1] + ',"action":"locate"}', None]) if rng.random() < 0.08 else raw


def test_random_decisions(spark):
    rng = random.Random(12)
    texts = ["where is the saw", "where is the red tape", "which tape", "is there any zorp here", "hello friend", "never mind", "no i said the blue tape", "where is the lost hammer", "which wire is it", "the red one", "where is it", None, "saw and blue tape", "stop the request"]
    rows = []
    for i in range(900):
        memory = rng.choice([None, None, "{}", '{"resolved_item_id":"r","last_robot_action":"locate","recovery_count":2}', '{"pending_item_family":"tape","known_attributes":{"color":"red"},"missing_attributes":["size"],"last_robot_action":"clarify"}'])
        proposal = rng.choice([None, None, None, "The saw is listed in drawer 1.", "The red tape is in drawer 7.", "It is there.", "The blue tape is in drawer 3."])
        rows.append((i, rng.choice(["lab", "lab", "lab", "ward", "nowhere"]), rng.choice(texts), some_decision(rng), memory, proposal))
    requests = spark.createDataFrame(rows, "id long, setting string, text string, raw string, memory string, proposal string")
    items = spark.createDataFrame(ITEMS, "setting string, id string, name string, family string, attributes map<string,string>, drawer string")
    want = compare(spark, requests, items)
    assert len({w.error for w in want.values()}) > 22 and sum(w.error is None for w in want.values()) > 30
    assert {w.action for w in want.values()} == set(dialogue.ACTIONS)


def test_rules_run_in_columns(spark):
    """Python understands texts, and nothing else."""
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    plan = decision_columns.decide(rule_queries.cases(read), rule_queries.items(read)).filter(F.col("id") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
