"""Decisions as columns: strict parsing, validity, the guard, replies, memory and state signatures, in joins and expressions that Catalyst plans.

Only what a text names (``dialogue.understood``) runs in Python.  A decision is parsed as a variant; the items and families that it and the request speak of are
joined by (setting, id) and (setting, family); rules are named conditions in the order in which errors are told.  ``decide`` gives the same as ``dialogue.judge``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dialogue
from .decisions import ACTIONS, FAILURES, STRATEGIES, next_state
from .dialogue import KEYS, REPLIES

MEMORY = "pending_item_family string, known_attributes map<string,string>, missing_attributes array<string>, resolved_item_id string, last_robot_action string, recovery_count int"
_FIELDS = ["action", "item_family", "resolved_item_id", "attributes", "missing_attributes", "failure_detected", "failure_type", "recovery_strategy"]
_DECISION = "struct<action:string,item_family:string,resolved_item_id:string,attributes:map<string,string>,missing_attributes:array<string>,failure_detected:boolean,failure_type:string,recovery_strategy:string>"


def _texts() -> Column:
    return F.array().cast("array<string>")


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def parse(raw: Column) -> tuple[Column, dict[str, Column]]:
    """(name of the first fault of form or null, fields) of a decision in JSON: one object with just the keys of a decision, each once."""
    v = F.try_parse_json(raw)
    at = lambda k, kind: F.try_variant_get(v, f"$.{k}", kind)
    kind = lambda k: F.schema_of_variant(at(k, "variant"))
    # what is no text where one belongs is a text that names nothing
    text = lambda k: F.when(kind(k) == "STRING", at(k, "string")).when(at(k, "variant").isNotNull() & (kind(k) != "VOID"), F.concat(F.lit("\u0001"), F.to_json(at(k, "variant"))))
    all_texts = lambda a: F.forall(a, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == "STRING")
    d = {k: text(k) for k in ("action", "item_family", "resolved_item_id", "failure_type", "recovery_strategy")}
    d |= {"attributes": at("attributes", "map<string,string>"), "missing_attributes": at("missing_attributes", "array<string>"), "failure_detected": at("failure_detected", "boolean")}
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    checks = [
        ("no_json_object", bad(F.schema_of_variant(v).startswith("OBJECT"))),
        ("keys", bad(F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(KEYS))))),
        ("action", bad(d["action"].isin(*ACTIONS))),
        ("failure_type", bad(d["failure_type"].isin(*FAILURES))),
        ("strategy", bad(d["recovery_strategy"].isin(*STRATEGIES))),
        ("attributes", bad(kind("attributes").startswith("OBJECT") & all_texts(F.map_values(at("attributes", "map<string,variant>"))))),
        ("missing_attributes", bad(kind("missing_attributes").startswith("ARRAY") & all_texts(at("missing_attributes", "array<variant>")))),
        ("failure_flag", bad(kind("failure_detected") == "BOOLEAN")),
    ]
    return first_of(checks), d


def first_of(checks: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in checks))


def _same_map(a: Column, b: Column) -> Column:
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(m, _no_map())))
    return entries(a) == entries(b)


def family_table(items: DataFrame) -> DataFrame:
    """(setting, family, members, names of up to five, all_keys, differs): what a family's items have, lacking an attribute counting as a value."""
    by = ["setting", "family"]
    # the names of a family are wanted only if it has up to five items, so larger ones collect none
    n = items.groupBy(*by).agg(F.count(F.lit(1)).alias("members"))
    few = items.join(n.filter("members <= 5"), by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("names"))
    keyed = items.select(*by, F.explode("attributes").alias("k", "v")).groupBy(*by, "k").agg(F.count(F.lit(1)).alias("having"), F.count_distinct("v").alias("values"))
    keys = keyed.join(n, by).groupBy(*by).agg(F.array_sort(F.collect_list("k")).alias("all_keys"), F.array_sort(F.collect_list(F.when((F.col("values") > 1) | (F.col("having") < F.col("members")), F.col("k")))).alias("differs"))
    return n.join(few, by, "left").join(keys, by, "left").select(*by, "members", "names", F.coalesce("all_keys", _texts()).alias("all_keys"), F.coalesce("differs", _texts()).alias("differs"))


def _matching(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, matching, matching_names): items of the decision's family with all of its attributes, where rules ask for them: the decision has any and binds no item.

    Each distinct question is answered once, from the items with its rarest attribute; names are told of up to five.
    """
    by, has = ["setting", "family", "wanted"], ["setting", "family", "k", "v"]
    open_ = F.col("d.item_family").isNotNull() & (F.size("d.attributes") > 0) & F.col("d.resolved_item_id").isNull() & F.col("d.action").isin("clarify", "recover")
    asked = rows.filter(open_).select("id", "setting", F.col("d.item_family").alias("family"), F.array_sort(F.map_entries("d.attributes")).alias("wanted"))
    index = items.select("setting", "family", F.col("id").alias("item"), "name", "attributes", F.explode("attributes").alias("k", "v"))
    pairs = asked.select(*by).distinct().withColumn("w", F.explode("wanted")).select(*by, F.col("w.key").alias("k"), F.col("w.value").alias("v"))
    counted = pairs.join(index.groupBy(*has).agg(F.count(F.lit(1)).alias("n")), has, "left")
    rarest = counted.groupBy(*by).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "v")).alias("x")).filter("x.n > 0").select(*by, "x.k", "x.v")
    fits = F.forall("wanted", lambda w: F.coalesce(F.try_element_at("attributes", w["key"]) == w["value"], F.lit(False)))
    met = rarest.join(index, has).filter(fits).select(*by, "item", "name")
    n = met.groupBy(*by).agg(F.count(F.lit(1)).alias("matching"))
    few = met.join(n.filter("matching <= 5"), by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "name"))), lambda x: x["name"]).alias("matching_names"))
    return asked.join(n.join(few, by, "left"), by).select("id", "matching", "matching_names")


def _joined(rows: DataFrame, table: DataFrame, key: str, value: Column, prefix: str) -> DataFrame:
    own = table.select(F.col("setting").alias("__s"), F.col(key).alias("__k"), F.struct(*(c for c in table.columns if c != "setting")).alias(prefix))
    return rows.withColumn("__v", value).join(own, (F.col("setting") == F.col("__s")) & (F.col("__v") == F.col("__k")), "left").drop("__s", "__k", "__v")


def _rules(d: Column, fits: Column) -> list[tuple[str, Column]]:
    """What a decision may say by itself and by the inventory."""
    item, fam = F.col("named"), F.col("fam")
    recover, bound = d["action"] == "recover", d["resolved_item_id"].isNotNull()
    family_only = ~bound & d["action"].isin("clarify", "recover") & d["item_family"].isNotNull()
    fails = d["failure_detected"]
    missing = d["missing_attributes"]
    return [
        ("flag_and_type_disagree", fails != (d["failure_type"] != "none")),
        ("only_recovery_is_failure", fails != recover),
        ("strategy_disagrees", recover != (d["recovery_strategy"] != "none")),
        ("locate_without_item", (d["action"] == "locate") & ~bound),
        ("item_not_allowed", ~d["action"].isin("locate", "recover") & bound),
        ("resolved_but_missing", bound & (F.size(missing) > 0)),
        ("missing_repeats", F.size(F.array_distinct(missing)) < F.size(missing)),
        ("known_and_missing", F.arrays_overlap(F.map_keys(d["attributes"]), missing)),
        ("unknown_item", bound & item["id"].isNull()),
        ("item_disagrees", bound & (~d["item_family"].eqNullSafe(item["family"]) | ~_same_map(d["attributes"], item["attributes"]))),
        ("unknown_family", family_only & fam["members"].isNull()),
        ("unknown_attributes", family_only & (fits == 0)),
        ("unknown_missing", family_only & (F.size(F.array_except(missing, F.coalesce(fam["all_keys"], _texts()))) > 0)),
        ("context_injected", d["action"].isin("redirect", "cancel") & _says(d)),
    ]


def _says(d: Column) -> Column:
    return (F.coalesce(d["item_family"], F.lit("")) != "") | (F.size(d["attributes"]) > 0) | (F.size(d["missing_attributes"]) > 0)


def _task(d: Column) -> list[tuple[str, Column]]:
    """What a decision may claim given the user's own words."""
    f, asked, proposal = F.col("f"), F.col("f.asked"), F.col("proposal").isNotNull()
    binds = d["action"].isin("locate", "recover") & d["resolved_item_id"].isNotNull()
    locate, clarify, lost = d["action"] == "locate", d["action"] == "clarify", d["action"] == "not_found"
    named = (F.size(f["items"]) > 0) | (F.size(f["families"]) > 0)
    other = F.exists(f["proposed_items"], lambda p: ~p.eqNullSafe(asked))
    return [
        ("no_drawer_on_record", binds & F.col("named.drawer").isNull()),
        ("item_not_asked_for", binds & ~d["resolved_item_id"].eqNullSafe(asked)),
        ("approves_other_item", locate & proposal & other),
        ("approves_wrong_drawer", locate & proposal & asked.isNotNull() & F.exists(f["proposed_drawers"], lambda p: p != F.coalesce(f["asked_drawer"], F.lit("")))),
        ("right_drawer_is_no_failure", (d["action"] == "recover") & proposal & (d["failure_type"] == "search_failure") & F.coalesce(f["proposal_right"], F.lit(False))),
        ("clarifies_one_item", clarify & asked.isNotNull()),
        ("one_candidate", clarify & d["item_family"].isNotNull() & (F.coalesce(F.col("fam.members"), F.lit(0)) < 2) & (F.size(d["missing_attributes"]) == 0)),
        ("clear_request", clarify & d["item_family"].isNull() & ~f["ambiguous"] & (F.size(f["items"]) == 1)),
        ("match_reported_missing", lost & named),
        ("unrelated_reported_missing", lost & ~f["request_like"]),
        ("missing_with_fields", lost & _says(d)),
        ("request_redirected", (d["action"] == "redirect") & (named | f["request_like"])),
        ("recovery_without_reason", (d["action"] == "recover") & ~(f["correction"] | proposal | (F.coalesce(F.col("m.last_robot_action"), F.lit("")) != ""))),
    ]


def _guard() -> Column:
    """The decision that follows from the inventory and the dialogue alone."""
    f, item = F.col("f"), F.col("own")
    has = item["id"].isNotNull()

    def decision(action: str, bind: bool = False, kind: str = "none", strategy: str = "none", family: Column | None = None, missing: Column | None = None) -> Column:
        text = lambda c: c if c is not None else F.lit(None).cast("string")
        return F.struct(
            F.lit(action).alias("action"),
            (item["family"] if bind else text(family)).alias("item_family"),
            (item["id"] if bind else text(None)).alias("resolved_item_id"),
            (F.coalesce(item["attributes"], _no_map()) if bind else _no_map()).alias("attributes"),
            (missing if missing is not None else _texts()).alias("missing_attributes"),
            F.lit(action == "recover").alias("failure_detected"),
            F.lit(kind).alias("failure_type"),
            F.lit(strategy).alias("recovery_strategy"),
        ).cast(_DECISION)

    failed = lambda kind, strategy: decision("recover", True, kind, strategy)
    other = F.exists(f["proposed_items"], lambda p: p != item["id"])
    reviewed = (
        F.when(~has, failed("comprehension_failure", "clarifying_prompt"))
        .when(other, failed("comprehension_failure", "self_correction"))
        .when(f["proposal_right"], decision("locate", True))
        .when(f["proposal_right"].isNull(), failed("comprehension_failure", "confidence_check"))
        .otherwise(failed("search_failure", "specific_redirection"))
    )
    line = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")
    cancels = line.contains("cancel") | line.contains("never mind") | line.contains("stop the request")
    return (
        F.when(F.col("proposal").isNotNull(), reviewed)
        .when(has & f["correction"], failed("comprehension_failure", "self_correction"))
        .when(has, decision("locate", True))
        .when(f["family"].isNotNull() | f["ambiguous"] | (F.size(f["items"]) > 1), decision("clarify", family=f["family"], missing=F.coalesce(F.col("own_fam.differs"), _texts())))
        .when(f["request_like"], decision("not_found"))
        .when(cancels, decision("cancel"))
        .otherwise(decision("redirect"))
    )


def reply(d: Column, item: Column, members: Column, names: Column) -> Column:
    """What to say; the drawer is always read from the inventory."""
    has = item["id"].isNotNull()
    place = F.when(has, F.concat(F.lit("The "), item["name"], F.lit(" is listed in "), item["drawer"], F.lit("."))).otherwise("Please repeat the full item name.")
    name = F.when(has, F.concat(F.lit("that you requested the "), item["name"])).otherwise("the full item name")
    known = F.when(F.coalesce(d["item_family"], F.lit("")) != "", F.concat(F.lit("the "), d["item_family"])).otherwise("part of the request")
    asks = F.when(members.between(2, 5), F.concat(F.lit("Do you want "), F.array_join(names, " or "), F.lit("?"))).when(members > 5, "Which type do you need? Please give its color, size, or exact name.").otherwise("Which item do you mean? Please say its full name and any color or size.")
    late = (d["recovery_strategy"] == "transparency_cue") & (d["failure_type"] == "timing_failure")
    key = F.when(d["action"] != "recover", d["action"]).when(late, "late").otherwise(d["recovery_strategy"])
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{place}"), place), F.lit("{name}"), name), F.lit("{known}"), known)
    said = F.coalesce(*(F.when(key == k, fill(t)) for k, t in REPLIES.items()))
    return F.when(has & item["drawer"].isNull(), "I have no place on record for that item.").when(d["action"] == "locate", place).when(d["action"] == "clarify", asks).otherwise(said)


def remember(m: Column, d: Column) -> Column:
    """Memory after a decision: cancelling empties it, redirecting keeps it, a guided reset forgets what was known, recoveries count."""
    none, zero = F.lit(None).cast("string"), F.lit(0)
    kind = "struct<pending_item_family:string,known_attributes:map<string,string>,missing_attributes:array<string>,resolved_item_id:string,last_robot_action:string,recovery_count:int>"
    memory = lambda family, known, missing, item, action, n: F.struct(family.alias("pending_item_family"), known.alias("known_attributes"), missing.alias("missing_attributes"), item.alias("resolved_item_id"), action.alias("last_robot_action"), n.alias("recovery_count")).cast(kind)
    count = F.coalesce(m["recovery_count"], zero)
    after = count + (d["action"] == "recover").cast("int")
    return (
        F.when(d["action"] == "cancel", memory(none, _no_map(), _texts(), none, none, zero))
        .when(d["action"] == "redirect", memory(m["pending_item_family"], F.coalesce(m["known_attributes"], _no_map()), F.coalesce(m["missing_attributes"], _texts()), m["resolved_item_id"], F.lit("redirect"), count))
        .when(d["recovery_strategy"] == "guided_reset", memory(none, _no_map(), _texts(), none, d["action"], after))
        .otherwise(memory(d["item_family"], d["attributes"], d["missing_attributes"], d["resolved_item_id"], d["action"], after))
    )


def signature(m: Column, proposal: Column) -> Column:
    """What two requests must share to use one pattern, as canonical JSON."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    missing = F.coalesce(F.size(m["missing_attributes"]), F.lit(0)) > 0
    review = proposal.isNotNull()
    parts = {
        "has_missing_attributes": missing,
        "has_pending_family": there(m["pending_item_family"]),
        "has_proposal": review,
        "has_resolved_item": there(m["resolved_item_id"]),
        "last_action": m["last_robot_action"],
        "mode": F.when(review, "pre_send_review").otherwise("dialogue_decision"),
        "state": F.when(review, "reviewing_proposed_answer").when(missing, "awaiting_clarification").otherwise("awaiting_request"),
    }
    return F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"})


def decide(requests: DataFrame, items: DataFrame, *, largest: int = 200_000, keep=lambda df, name: df) -> DataFrame:
    """Requests as for ``dialogue.judge``, ids distinct -> (id, error, guard_used, action, decision, reply, memory, signature, next_signature, next_state, risk, well_formed, told, unsupported_id).

    keep(frame, name): writes a table that is read more than once.
    """
    place = F.trim(F.coalesce("drawer", F.lit("")))
    things = items.select("setting", "id", "name", "family", F.coalesce("attributes", _no_map()).alias("attributes"), F.when(place != "", place).alias("drawer"))
    families = family_table(things)
    said = dialogue.understood(requests, items, largest=largest)
    given = lambda name: (F.col(name) if name in requests.columns else F.lit(None)).cast("string").alias(name)
    asked = requests.select("id", "setting", F.col("text").cast("string").alias("text"), given("raw"), given("memory"), given("proposal"))
    fault, d = parse(F.col("raw"))
    rows = asked.select("*", fault.alias("fault"), F.struct(*(d[k].alias(k) for k in _FIELDS)).cast(_DECISION).alias("d"), F.from_json(F.coalesce("memory", F.lit("{}")), MEMORY).alias("m"))
    rows = keep(rows.join(said.select("id", F.struct(*(c for c in said.columns if c != "id")).alias("f")), "id"), "understood")
    whole = _joined(rows, things, "id", F.col("d.resolved_item_id"), "named")
    whole = _joined(whole, things, "id", F.col("f.asked"), "own")
    whole = _joined(whole, families, "family", F.col("d.item_family"), "fam")
    whole = _joined(whole, families, "family", F.col("f.family"), "own_fam").join(_matching(rows, things), "id", "left")
    with_attributes = F.size("d.attributes") > 0
    fits = F.when(with_attributes, F.coalesce("matching", F.lit(0))).otherwise(F.coalesce("fam.members", F.lit(0)))
    names = F.when(with_attributes, F.col("matching_names")).otherwise(F.col("fam.names"))
    decided = whole.withColumn("error", F.coalesce("fault", first_of([*_rules(F.col("d"), fits), *_task(F.col("d"))])))
    ok = F.col("error").isNull()
    final = decided.select(
        "id",
        "error",
        "m",
        "proposal",
        "fault",
        F.col("d").alias("told"),
        (F.col("d.resolved_item_id").isNotNull() & F.col("named.id").isNull()).alias("unsupported_id"),
        F.when(ok, F.col("d")).otherwise(_guard()).alias("decision"),
        F.when(ok, F.col("named")).otherwise(F.when(_guard()["resolved_item_id"].isNotNull(), F.col("own"))).alias("item"),
        F.when(ok, fits).otherwise(F.coalesce("own_fam.members", F.lit(0))).alias("members"),
        F.when(ok, names).otherwise(F.col("own_fam.names")).alias("names"),
    )
    x = F.col("decision")
    out = final.select("id", "error", "m", "proposal", "decision", "fault", "told", "unsupported_id", reply(x, F.col("item"), F.col("members"), F.col("names")).alias("reply"), remember(F.col("m"), x).alias("after"))
    risky = x["action"].isin("locate", "recover") | (x["failure_type"] != "none")
    return out.select(
        "id",
        "error",
        F.col("error").isNotNull().alias("guard_used"),
        x["action"].alias("action"),
        "decision",
        "reply",
        F.col("after").alias("memory"),
        signature(F.col("m"), F.col("proposal")).alias("signature"),
        signature(F.col("after"), F.lit(None)).alias("next_signature"),
        next_state(x["action"]).alias("next_state"),
        F.when(risky, "risky").otherwise("routine").alias("risk"),
        F.col("fault").isNull().alias("well_formed"),
        "told",
        "unsupported_id",
    )


def scores(decided: DataFrame, by: Column, name: str) -> DataFrame:
    """How what was told compares with what was decided, by a column: shares of well-formed, valid, right-action and wholly right decisions, counts of
    unknown items, and of alarms without a failure."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    told, d, ok = F.col("told"), F.col("decision"), F.col("well_formed")
    action = ok & (told["action"] == d["action"])
    item = told["resolved_item_id"].eqNullSafe(d["resolved_item_id"]) & told["item_family"].eqNullSafe(d["item_family"])
    return decided.groupBy(by.alias(name)).agg(
        F.count(F.lit(1)).alias("n"),
        share(ok).alias("well_formed"),
        share(F.col("error").isNull()).alias("valid"),
        share(action).alias("right_action"),
        share(action & item & (told["failure_type"] == d["failure_type"])).alias("right_in_all"),
        F.count_if(ok & F.col("unsupported_id")).alias("unknown_items"),
        F.count_if(ok & told["failure_detected"] & (d["action"] != "recover")).alias("false_alarms"),
        F.count_if(ok & ~told["failure_detected"] & (d["action"] == "recover")).alias("missed_failures"),
    )
