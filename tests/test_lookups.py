"""Rules on inventories that are too large to be sent: requests meet by joins what they speak of, with the results of a whole inventory."""

import random

import pytest

from pyspark.sql import functions as F

from turnwise.operators import decision_columns
from turnwise.operators import dialogue as D

ITEMS = "setting string, id string, name string, family string, attributes map<string,string>, drawer string, aliases array<string>"
SAID = ["Which SMALL is here", "where is the red ring", "red ring and blue bolt", "the thing and the gadget", "the LARGE 2", "hello", "never mind", "No, I said the blue bolt 4", "i meant the red ring x y", "where is it", "is there any thing here", "the gadget in drawer two", "own 3 x y", "brand 2", None, ""]
RAW = [None, "no", D.compact(D.decision("cancel"))] + [D.compact(D.decision("clarify", item_family=f, attributes=a, missing_attributes=m)) for f, a, m in (("SMALL", {}, []), ("LARGE", {"size": "2"}, ["brand"]), ("LARGE", {"size": "2", "brand": "1"}, []), ("none", {}, []), (None, {}, []))] + [D.compact(D.decision("locate", resolved_item_id=i, item_family="SMALL")) for i in ("4", "zz")]
MEMORY = [None, '{"pending_item_family":"SMALL","missing_attributes":["size"]}', '{"resolved_item_id":"4","last_robot_action":"locate"}']
HISTORY = [None, [("user", "where is the red ring 4"), ("robot", "The red ring 4 is in drawer 1.")], [("user", "blue bolts 8"), ("robot", "i am not sure")]]
PROPOSALS = [None, None, "The red ring 4 is in drawer 1.", "The blue bolt 8 is in drawer 99", "red ring and thing"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    item = lambda s, i: (s, str(i), f"{rng.choice(['red', 'blue'])} {rng.choice(['ring', 'bolt'])}" + (f" {i}" if i % 4 == 0 else ""), rng.choice(["SMALL", "LARGE", f"own {i % 9}"]), {k: rng.choice(["1", "2", "x y"]) for k in ("brand", "size") if rng.random() < 0.8} or None, rng.choice([None, "drawer 1", "Drawer 12", " "]), rng.choice([[], ["thing"], [f"alias {i}", "gadget"]]))
    items = spark.createDataFrame([item(s, i) for s in ("lab", "hospital") for i in range(150)], ITEMS)  # shared names have more items than are told
    asked = [(i, rng.choice(["lab", "hospital", "none"]), *map(rng.choice, (SAID, RAW, MEMORY, PROPOSALS, HISTORY)), rng.choice([None, 900.0])) for i in range(500)]
    return items, spark.createDataFrame(asked, "id long, setting string, text string, raw string, memory string, proposal string, history array<struct<role:string,text:string>>, latency_ms double")


@pytest.mark.parametrize("rule", ["judge", "understood", "bundles"])
def test_joined_requests_are_judged_as_by_a_whole_inventory(tables, rule):
    items, asked = tables
    asked = asked.drop("raw", "memory") if rule == "bundles" else asked
    joined = getattr(D, rule)(asked, items, largest=1)
    assert "CoGroup" not in joined._jdf.queryExecution().optimizedPlan().toString()  # nobody meets all of a setting's items
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = rows(getattr(D, rule)(asked, items))
    assert rows(joined) == want and len(want) == 500


def test_sessions_of_inventories_of_any_size(spark, tables):
    items, _ = tables
    rng = random.Random(9)
    turns = spark.createDataFrame([(k, ("lab", "hospital", "none")[k % 3], t, rng.choice(SAID)) for k in range(90) for t in range(4)], "session long, setting string, turn int, text string")
    rows = lambda n: sorted(map(repr, map(tuple, D.sessions(turns, items, largest=n).collect())))
    assert rows(1) == rows(1000) and len(rows(1)) > 100


def test_items_that_repeat_an_id_are_refused(spark, tables):
    items, asked = tables
    with pytest.raises(ValueError, match="repeats an id"):
        D.judge(asked, items.unionByName(items.limit(1)), largest=1)


def test_only_open_decisions_ask_for_matching_items(spark):
    items = [("lab", f"{i:02}", f"thing {i}", "tool", {"brand": str(i % 3), "size": str(i % 5)}) for i in range(40)]
    told = [(0, "clarify", None, {"brand": "1"}), (1, "clarify", None, {"brand": "1", "size": "2"}), (2, "recover", None, {"size": "2", "brand": "1"}), (3, "locate", "07", {"brand": "1", "size": "2"}), (4, "clarify", None, {"brand": "9"}), (5, "clarify", None, {}), (6, "clarify", None, {"zz": "1", "size": "2"})]
    rows = spark.createDataFrame(told, "id int, action string, item string, attributes map<string,string>").select("id", F.lit("lab").alias("setting"), F.struct("action", F.lit("tool").alias("item_family"), F.col("item").alias("resolved_item_id"), "attributes").alias("d"))
    things = spark.createDataFrame(items, "setting string, id string, name string, family string, attributes map<string,string>")
    got = {r.id: (r.matching, r.matching_names) for r in decision_columns._matching(rows, things).collect()}
    both = ["thing 7", "thing 22", "thing 37"]
    assert got == {0: (13, None), 1: (3, both), 2: (3, both)}  # an item that is bound is never looked for among its family's
