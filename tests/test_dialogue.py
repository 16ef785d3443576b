"""Golden dialogues: typing, resolution, validity, guard, templates, replies, memory."""

import json

import pytest

from turnwise.operators import dialogue as D

ITEMS = [
    {"id": "circuit_board", "name": "circuit board", "family": "board", "attributes": {}, "drawer": "drawer 2"},
    {"id": "gloves", "name": "gloves", "family": "glove", "attributes": {}, "drawer": "drawer 4"},
    {"id": "blue_tape", "name": "blue tape", "family": "tape", "attributes": {"color": "blue"}, "drawer": "drawer 1"},
    {"id": "red_tape", "name": "red tape", "family": "tape", "attributes": {"color": "red"}, "drawer": "drawer 2"},
    {"id": "wires", "name": "wires", "family": "wire", "attributes": {}, "drawer": "drawer 3"},
    {"id": "scissors", "name": "scissors", "family": "scissor", "attributes": {}, "aliases": ["shears"], "location": "drawer 5"},
    {"id": "lost", "name": "lost thing", "family": "thing", "attributes": {}, "drawer": " "},
]


@pytest.fixture
def inv():
    return D.Inventory(ITEMS)


def ask(text, proposal=None, memory=None, before=()):
    return D.Request([*before, ("user", text)], memory or {}, proposal)


@pytest.mark.parametrize("text, surface, items", [("Where's the circuit board?", "where s the <item>", ["circuit_board"]), ("any tape", "any <family>", []), ("the red one", "the <attribute:color> one", []), ("what is in drawer two", "what is in <drawer>", []), ("shears", "<item>", ["scissors"]), ("", "<empty>", []), (None, "<empty>", [])])
def test_typing(inv, text, surface, items):
    f = D.extract(text, inv)
    assert (f.surface, f.items) == (surface, items)


def test_styles_differ(inv):
    assert D.extract("please give me the blue tape", inv, "v1").surface == "<item>"
    assert D.extract("a blue pen in drawer 2", inv, "v2").surface == "a <attr:color> pen in drawer 2"
    assert D.extract("blue or red tape", inv, "v1").ambiguous and not D.extract("blue tape", inv, "v1").ambiguous


@pytest.mark.parametrize(
    "proposal, surface, action",
    [
        ("The blue tape is in drawer 1", "<request:item> || the <item:other> is in <drawer:mismatch>", "recover"),
        ("It is in drawer four", "<request:item> || it is in <drawer:match>", "locate"),
        ("It is in drawer too", "<request:item> || it is in <drawer:mismatch>", "recover"),
        ("It is in drawer 99", "<request:item> || it is in <drawer:mismatch>", "recover"),
        ("The gloves are over there", "<request:item> || the <item:same> are over there", "recover"),
    ],
)
def test_reviews(inv, proposal, surface, action):
    q = ask("Where are the gloves?", proposal)
    d = D.guard(q, inv)
    assert D.review(q, inv).surface == surface and (d["action"], d["resolved_item_id"]) == (action, "gloves")
    assert D.error(d, q, inv) is None
    assert "drawer 4" in D.reply(d, inv) or d["recovery_strategy"] == "confidence_check"


def test_never_approves_a_wrong_drawer_or_item(inv):
    q = ask("Where are the gloves?", "The gloves are in drawer 1")
    assert D.error(D.decision("locate", inv.items["gloves"]), q, inv) == "approves_wrong_drawer"
    q = ask("Where are the gloves?", "The wires are in drawer 4")
    assert D.error(D.decision("locate", inv.items["gloves"]), q, inv) == "approves_other_item"
    q = ask("Where are the gloves?", "The gloves are in drawer 4")
    assert D.error(D.decision("recover", inv.items["gloves"], failure_type="search_failure", recovery_strategy="self_correction"), q, inv) == "right_drawer_is_no_failure"


@pytest.mark.parametrize(
    "text, memory, before, item",
    [
        ("the blue tape", {}, (), "blue_tape"),
        ("the tape", {}, (), None),
        ("the red one", {"pending_item_family": "tape"}, (), "red_tape"),
        ("where is it again", {"resolved_item_id": "wires"}, (), "wires"),
        ("gloves or wires", {}, (), None),
        ("No, I said the wires", {}, [("user", "gloves")], "wires"),
        ("No, I did not mean tape", {}, [("user", "where are the scissors"), ("robot", "Blue tape?")], "scissors"),
        ("where are the sizzlers", {}, (), None),
    ],
)
def test_resolution(inv, text, memory, before, item):
    q = ask(text, memory=memory, before=before)
    assert D.resolve(D.review(q, inv), q, inv) == item


@pytest.mark.parametrize(
    "text, action",
    [("where are the wires", "locate"), ("where is the tape", "clarify"), ("where are the sizzlers", "not_found"), ("nice weather", "redirect"), ("never mind", "cancel"), ("how do I get to the exit", "redirect"), ("no, i meant the wires", "recover")],
)
def test_guard(inv, text, action):
    q = ask(text, memory={"last_robot_action": "locate"})
    d = D.guard(q, inv)
    assert d["action"] == action and D.error(d, q, inv) is None and D.reply(d, inv)


def broken(**more):
    return D.decision("locate", ITEMS[4] | {"attributes": {}}) | more


@pytest.mark.parametrize(
    "d, name",
    [
        ("{", "no_json_object"),
        ('{"action": "locate", "action": "cancel"}', "no_json_object"),
        ("```json {} ```", "no_json_object"),
        ({"action": "locate"}, "keys"),
        (broken(action="dance"), "action"),
        (broken(failure_type="odd"), "failure_type"),
        (broken(recovery_strategy="odd"), "strategy"),
        (broken(attributes={"a": 1}), "attributes"),
        (broken(missing_attributes="x"), "missing_attributes"),
        (broken(failure_detected=0), "failure_flag"),
        (broken(failure_type="search_failure"), "flag_and_type_disagree"),
        (broken(failure_detected=True, failure_type="search_failure"), "only_recovery_is_failure"),
        (broken(recovery_strategy="self_correction"), "strategy_disagrees"),
        (broken(resolved_item_id=None), "locate_without_item"),
        (broken(action="clarify"), "item_not_allowed"),
        (broken(missing_attributes=["color"]), "resolved_but_missing"),
        (D.decision("clarify", missing_attributes=["a", "a"]), "missing_repeats"),
        (D.decision("clarify", item_family="tape", attributes={"color": "red"}, missing_attributes=["color"]), "known_and_missing"),
        (broken(resolved_item_id="nothing"), "unknown_item"),
        (broken(item_family="tape"), "item_disagrees"),
        (D.decision("clarify", item_family="none of these"), "unknown_family"),
        (D.decision("clarify", item_family="tape", attributes={"color": "green"}), "unknown_attributes"),
        (D.decision("clarify", item_family="tape", missing_attributes=["size"]), "unknown_missing"),
        (D.decision("cancel", item_family="tape"), "context_injected"),
        (broken(), None),
    ],
)
def test_first_error(inv, d, name):
    assert D.error(d if isinstance(d, str) else json.dumps(d), ask("where are the wires"), inv) == name


def test_allowed_actions(inv):
    q = D.Request([("user", "where are the wires")], allowed=["recover"])
    assert D.error(broken(), q, inv) == "action_not_allowed"


def test_bad_teacher_is_repaired(inv):
    d, reason = D.checked(D.decision("locate", inv.items["gloves"]), ask("where are the wires"), inv)
    assert d["resolved_item_id"] == "wires" and reason == "item_not_asked_for"


def test_templates_bind_other_items(inv):
    q, other = ask("where are the scissors"), ask("where are the wires")
    t = D.compile_template(D.guard(q, inv), q, inv)
    assert t["item"] == "current_resolution" and D.instantiate(t, other, inv)["resolved_item_id"] == "wires"
    assert D.instantiate(t, ask("where are the sizzlers"), inv) is None
    assert D.compile_template(D.decision("locate", inv.items["gloves"]), other, inv) is None


def test_memory(inv):
    m = D.remember({}, D.decision("clarify", item_family="tape", missing_attributes=["color"]))
    assert m["pending_item_family"] == "tape" and D.Request([("user", "x")], m).state == "awaiting_clarification"
    assert D.remember(m, D.decision("redirect")) == m | {"last_robot_action": "redirect"} and D.remember(m, D.decision("redirect"), record_redirect=False) == m
    r = D.remember(m, D.decision("recover", inv.items["wires"], failure_type="search_failure", recovery_strategy="guided_reset"))
    assert r["recovery_count"] == 1 and r["resolved_item_id"] is None and D.remember(r, D.decision("cancel")) == D.EMPTY


def test_session_closes_after_recovery(inv):
    out = D.session(["where is the tape", "the red one", "no, i said the wires", "gloves"], inv)
    assert [t["decision"]["action"] for t in out] == ["clarify", "locate", "recover"]
    assert out[0]["reply"] == "Do you want blue tape or red tape?" and "drawer 2" in out[1]["reply"] and "drawer 3" in out[2]["reply"]


def test_signature_and_payload(inv):
    q = ask("x", memory={"missing_attributes": ["color"], "last_robot_action": "clarify"}, before=[("user", str(i)) for i in range(20)])
    assert json.loads(q.signature())["has_missing_attributes"] and len(q.payload(inv)["conversation"]) == 8


def test_inventory_rules():
    for bad in ([{"id": "a", "name": "", "family": "f"}], [ITEMS[0], ITEMS[0]]):
        with pytest.raises(ValueError):
            D.Inventory(bad)
    assert D.Inventory(ITEMS).disagreeing("tape") == ["color"] and D.Inventory([]).longest == 0
    with pytest.raises(ValueError):
        D.reply(D.decision("locate", D.Inventory(ITEMS).items["lost"]), D.Inventory(ITEMS))


def test_judge(spark):
    items = spark.createDataFrame([("lab", x["id"], x["name"], x["family"], x["attributes"], x.get("drawer") or x.get("location")) for x in ITEMS], "setting string, id string, name string, family string, attributes map<string,string>, drawer string")
    req = spark.createDataFrame([(1, "lab", "where are the wires", None), (2, "lab", None, "{}"), (3, "other", "wires", None), (4, None, "where is the lost thing", None)], "id int, setting string, text string, raw string")
    out = {r.id: r for r in D.judge(req, items).collect()}
    assert (out[1].item, out[1].action, out[1].reply) == ("wires", "locate", "The wires is listed in drawer 3.")
    assert out[2].action == "redirect" and out[3].v3 == "wires" and out[4].item is None
    by_setting = {r.id: r for r in D.judge(req, items, largest=2).collect()}  # an inventory that counts as too large to be sent to every task
    assert by_setting == out


def test_bundles_relate_replies_to_the_item_asked_for(inv):
    def told(reply, text="Where are the wires?"):
        return D.feature_bundle(D.Request([("user", text), ("robot", reply), ("user", "hm")], {}, reply), inv, 2999.0)

    place = inv.items["wires"]["drawer"]
    assert told(f"The wires is listed in {place}.")["prior_relation"] == "correct"
    assert told("The wires is in drawer 77.")["proposal_relation"] == "wrong_drawer"
    assert told("The wires is here.")["prior_relation"] == "same_item_no_drawer"
    assert told("The gloves is here.")["prior_relation"] == "wrong_item"
    assert told("Good question.")["prior_relation"] == "missing_item" and told("The wires is here.", "hello")["prior_relation"] == "unverifiable"
    b = told("The wires is here.")
    assert b["timing"] == "1000-3000ms" and b["history"] == ["user:where are the <item>", "robot:the <item> is here", "user:hm"]
    assert [D.timing_class(x) for x in (None, float("nan"), 0, 1000, 15000, 15001)] == ["missing", "missing", "0-1000ms", "0-1000ms", "7000-15000ms", ">15000ms"]
    none = D.feature_bundle(D.Request([("user", "")]), inv, None)
    assert (none["proposal_relation"], none["prior_relation"], none["current"]) == ("none", "none", "<empty>")


def test_inventories_are_read_by_setting(spark, tmp_path):
    from turnwise.sources import files

    items = spark.createDataFrame([(s, f"{s}{i}", "n", "f", {"a": "b"}, ["x"], f"drawer {i}") for s in ("lab", "ward") for i in range(5)], "setting string, id string, name string, family string, attributes map<string,string>, aliases array<string>, drawer string")
    files.write_items(items.repartition(3), str(tmp_path / "i"))
    got = files.read_setting(spark, str(tmp_path / "i"), "ward")
    assert sorted(r.id for r in got.collect()) == [f"ward{i}" for i in range(5)]
    assert "PartitionFilters: [isnotnull(setting" in got._jdf.queryExecution().executedPlan().toString()
