"""The dialogue rules on requests whose outcome is known: each case is made from an item of the inventory, and its SQL states what has to follow."""

from pyspark.sql import functions as F

from ..operators import datasets, dialogue
from .base import I, inventory, query

#: Kinds of cases, by the item's key modulo their number: what is said, and what the teacher answers.
KINDS = 14
_ATTRIBUTES = """'{"brand":"' || brand || '","size":"' || size || '"}'"""
_RAW = (
    "'{{\"action\":\"{action}\",\"item_family\":' || {family} || ',\"resolved_item_id\":' || {item} || ',\"attributes\":' || {attributes} || ',\"missing_attributes\":[],\"failure_detected\":{failed},\"failure_type\":\"{kind}\",\"recovery_strategy\":\"{strategy}\"}}'"
)


def _raw(action, family="'null'", item="'null'", attributes="'{}'", failed="false", kind="none", strategy="none") -> str:
    """SQL (both dialects) for a decision as JSON."""
    return _RAW.format(action=action, family=family, item=item, attributes=attributes, failed=failed, kind=kind, strategy=strategy)


_RIGHT = _raw("locate", "'\"' || family || '\"'", "'\"' || item_id || '\"'", _ATTRIBUTES)
_RECOVER = _raw("recover", "'\"' || family || '\"'", "'\"' || item_id || '\"'", _ATTRIBUTES, "true", "comprehension_failure", "self_correction")
_RETRY = _raw("recover", "'\"' || family || '\"'", "'\"' || item_id || '\"'", _ATTRIBUTES, "true", "search_failure", "specific_redirection")
#: (text, raw decision, memory, proposal) of each kind, in SQL that Spark and DuckDB both read; ``name`` is unique.
CASES = [
    ("'Where is the ' || name || '?'", _RIGHT, "NULL", "NULL"),
    ("'Where is the ' || name || '?'", _raw("locate", "'\"' || family || '\"'", "'\"zzz\"'", _ATTRIBUTES), "NULL", "NULL"),
    ("'Please find ' || name", "'locate please'", "NULL", "NULL"),
    ("'Please find ' || name", f"replace({_RIGHT}, '\"action\":\"locate\",', '\"action\":\"locate\",\"action\":\"locate\",')", "NULL", "NULL"),
    ("'Please find ' || name", f"replace({_RIGHT}, '\"action\"', '\"mood\":\"fine\",\"action\"')", "NULL", "NULL"),
    ("'Where is the ' || name || '?'", f"replace({_RIGHT}, '\"failure_detected\":false', '\"failure_detected\":true')", "NULL", "NULL"),
    ("'Which ' || family || ' is here'", _raw("clarify", "'\"' || family || '\"'"), "NULL", "NULL"),
    ("'hello friend'", _raw("not_found"), "NULL", "NULL"),
    ("'never mind'", _raw("cancel"), "'{\"resolved_item_id\":\"' || item_id || '\",\"recovery_count\":3}'", "NULL"),
    ("'No, I said the ' || name", _RECOVER, "'{\"last_robot_action\":\"locate\",\"recovery_count\":2}'", "NULL"),
    ("'where is it'", _raw("redirect"), "'{\"resolved_item_id\":\"' || item_id || '\",\"last_robot_action\":\"locate\"}'", "NULL"),
    ("'Is there any zorp here'", _raw("locate"), "NULL", "NULL"),
    ("'Where is the ' || name || '?'", _RETRY, "NULL", "'The ' || name || ' is in ' || coalesce(drawer, 'drawer 7') || '.'"),
    ("'Where is the ' || name || '?'", _RIGHT, "NULL", "'The ' || name || ' is in drawer 99.'"),
]
UNIQUE_SQL = "n AS (SELECT item_id, setting, family, brand, size, drawer, name || ' ' || item_id AS name FROM i)"


def _of(column: int) -> str:
    return "CASE item_id % 14 " + " ".join(f"WHEN {k} THEN {c[column]}" for k, c in enumerate(CASES)) + " END"


CASES_SQL = f"{UNIQUE_SQL}, c AS (SELECT *, item_id % 14 AS k, {_of(0)} AS text, {_of(1)} AS raw, {_of(2)} AS memory, {_of(3)} AS proposal FROM n)"


def named_inventory(read):
    """The inventory with a name of its own for each item."""
    return inventory(read).withColumn("name", F.concat_ws(" ", "name", F.col("item_id").cast("string")))


def items(read):
    return named_inventory(read).select("setting", F.col("item_id").cast("string").alias("id"), "name", "family", F.create_map(F.lit("brand"), "brand", F.lit("size"), "size").alias("attributes"), "drawer")


def cases(read):
    """(id, setting, text, raw, memory, proposal): one request for each item."""
    return named_inventory(read).select(F.col("item_id").alias("id"), "setting", *(F.expr(_of(i)).alias(n) for i, n in enumerate(("text", "raw", "memory", "proposal"))))


V3_SQL = "CASE WHEN k IN (0, 1, 5) THEN 'where is the <item>' WHEN k IN (2, 3, 4) THEN 'please find <item>' WHEN k = 6 THEN 'which <family> is here' WHEN k = 7 THEN 'hello friend' WHEN k = 8 THEN 'never mind' WHEN k = 9 THEN 'no i said the <item>' WHEN k = 10 THEN 'where is it' WHEN k = 11 THEN 'is there any zorp here' ELSE '<request:item> || the <item:same> is in ' || CASE WHEN drawer IS NULL THEN '<drawer>' WHEN k = 12 THEN '<drawer:match>' ELSE '<drawer:mismatch>' END END"
_ERROR = (
    "CASE WHEN k IN (0, 5) AND drawer IS NULL AND k = 0 THEN 'no_drawer_on_record' WHEN k = 1 THEN 'unknown_item' WHEN k IN (2, 3) THEN 'no_json_object' WHEN k = 4 THEN 'keys' WHEN k = 5 THEN 'flag_and_type_disagree' "
    "WHEN k = 7 THEN 'unrelated_reported_missing' WHEN k = 9 AND drawer IS NULL THEN 'no_drawer_on_record' WHEN k = 10 THEN 'request_redirected' WHEN k = 11 THEN 'locate_without_item' "
    "WHEN k = 12 AND drawer IS NULL THEN 'no_drawer_on_record' WHEN k = 12 THEN 'right_drawer_is_no_failure' WHEN k = 13 AND drawer IS NULL THEN 'no_drawer_on_record' WHEN k = 13 THEN 'approves_wrong_drawer' END"
)
ACTION_SQL = "CASE WHEN k = 6 THEN 'clarify' WHEN k = 7 THEN 'redirect' WHEN k = 8 THEN 'cancel' WHEN k IN (9, 13) OR k = 12 AND drawer IS NULL THEN 'recover' WHEN k = 11 THEN 'not_found' ELSE 'locate' END"


@query(
    f"WITH {I}, {CASES_SQL} SELECT item_id AS id, {V3_SQL} AS v3, "
    f"CASE WHEN k NOT IN (6, 7, 8, 11) THEN CAST(item_id AS VARCHAR) END AS item, {ACTION_SQL} AS action, {_ERROR} AS error, "
    "CASE WHEN k IN (12, 13) THEN 'reviewing_proposed_answer' ELSE 'awaiting_request' END AS state FROM c"
)
def judged_cases(read):
    """Typed wording, item, checked action and the name of the first broken rule of every case."""
    j = dialogue.judge(cases(read), items(read), wanted=["v3", "item", "action", "error", "signature"])
    return j.select("id", "v3", "item", "action", "error", F.get_json_object("signature", "$.state").alias("state"))


@query(
    f"WITH {I}, {CASES_SQL} SELECT item_id AS id, {_ERROR} AS error, CASE WHEN ({_ERROR}) IS NOT NULL AND drawer IS NULL AND k NOT IN (6, 7, 8, 11) THEN 'no_drawer_on_record' END AS guard_error FROM c"
)
def guarded_cases(read):
    """The rule that each raw decision breaks, and the rule that the guard's decision in its place breaks too: an item without a drawer can't be served."""
    return dialogue.judge(cases(read), items(read), wanted=["error", "guard_error"])


@query(f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action FROM c) SELECT item_id AS id, action FROM a")
def judged_by_setting(read):
    """The checked actions when the inventory counts as too large to be sent to every task, and requests go to their setting's items."""
    return dialogue.judge(cases(read), items(read), wanted=["action"], largest=10)


@query()
def typed_by_join(read):
    """Typed requests when the phrases count as too many to be sent to every task."""
    from ..operators import matching as M
    from ..session import keeper
    from .base import utterances

    table = M.phrase_table(inventory(read)).select("setting", "phrase", "kind", F.when(F.col("kind") == "item", F.col("item_id").cast("string")).otherwise(F.col("phrase")).alias("value"))
    asked = utterances(read)
    return M.typed_features(asked, table, largest=10, keep=keeper(asked.sparkSession, "typed-by-join"))


_MISSING = (
    "m AS (SELECT setting, family, CASE WHEN count(DISTINCT brand) > 1 AND count(DISTINCT size) > 1 THEN '[\"brand\",\"size\"]' WHEN count(DISTINCT brand) > 1 THEN '[\"brand\"]' WHEN count(DISTINCT size) > 1 THEN '[\"size\"]' ELSE '[]' END AS missing, count(*) AS members FROM n GROUP BY ALL)"
)
_PLACE = "CASE WHEN drawer IS NULL THEN NULL ELSE 'The ' || name || ' is listed in ' || drawer || '.' END"
_SORRY = "CASE WHEN drawer IS NULL THEN NULL ELSE {text} || 'The ' || name || ' is listed in ' || drawer || '.' END"


REPLY_SQL = "CASE WHEN drawer IS NULL AND k NOT IN (6, 7, 8, 11) THEN 'I have no place on record for that item.' WHEN k = 6 THEN 'Which type do you need? Please give its color, size, or exact name.' WHEN k = 7 THEN 'I can help you locate items in the inventory. Which item do you need?' WHEN k = 8 THEN 'Okay, I have cancelled this request.' WHEN k = 11 THEN 'I could not match that request to the inventory. Please check the name or ask a staff member.' ELSE CASE k WHEN 9 THEN 'Sorry, I misunderstood. ' WHEN 13 THEN 'Sorry, let me give the inventory location more clearly. ' ELSE '' END || 'The ' || name || ' is listed in ' || drawer || '.' END"


@query(
    f"WITH {I}, {CASES_SQL} SELECT item_id AS id, {REPLY_SQL} AS reply FROM c"
)
def rendered_replies(read):
    """What is said after each case; drawers come from the inventory, whatever the teacher said."""
    return dialogue.judge(cases(read), items(read), wanted=["reply"])


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action FROM c) SELECT item_id AS id, CASE WHEN k = 10 THEN 'memory_item' WHEN k IN (6, 7, 8, 11) THEN 'none' ELSE 'current_resolution' END AS item_source, "
    "CASE WHEN k = 6 THEN 'current_family' WHEN k IN (7, 8, 11) THEN 'none' ELSE 'resolved_item' END AS family_source, action, true AS rebinds FROM a"
)
def template_sources(read):
    """M5-M6: each checked decision as a template of sources, which gives an equal decision back when it is bound to the same request."""
    j = dialogue.judge(cases(read), items(read), wanted=["template", "rebinds"])
    of = lambda k: F.get_json_object("template", f"$.{k}")
    return j.select("id", of("item").alias("item_source"), of("family").alias("family_source"), of("action").alias("action"), "rebinds")


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action FROM c) SELECT item_id AS id, CASE WHEN k = 6 OR k NOT IN (7, 8, 11) THEN family END AS pending_item_family, CASE WHEN k NOT IN (6, 7, 8, 11) THEN CAST(item_id AS VARCHAR) END AS resolved_item_id, "
    "CASE WHEN k = 8 THEN NULL ELSE action END AS last_robot_action, CAST(CASE WHEN k = 9 THEN 3 WHEN action = 'recover' THEN 1 ELSE 0 END AS INT) AS recovery_count, "
    f"CASE WHEN k NOT IN (6, 7, 8, 11) THEN {_ATTRIBUTES} ELSE '{{}}' END AS known_attributes, "
    "CASE WHEN k IN (8, 7) THEN 'awaiting_request' ELSE 'awaiting_request' END AS next_state, k NOT IN (6, 7, 8, 11) AS has_resolved_item FROM a"
)
def memory_after(read):
    """Memory after each decision, and the signature of the state that follows."""
    j = dialogue.judge(cases(read), items(read), wanted=["memory", "next_signature"])
    of = lambda k: F.get_json_object("memory", f"$.{k}")
    return j.select(
        "id",
        of("pending_item_family").alias("pending_item_family"),
        of("resolved_item_id").alias("resolved_item_id"),
        of("last_robot_action").alias("last_robot_action"),
        of("recovery_count").cast("int").alias("recovery_count"),
        of("known_attributes").alias("known_attributes"),
        F.get_json_object("next_signature", "$.state").alias("next_state"),
        (F.get_json_object("next_signature", "$.has_resolved_item") == "true").alias("has_resolved_item"),
    )


@query(
    f"WITH {I}, {CASES_SQL}, f AS (SELECT setting, family, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids, list(CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS l FROM n GROUP BY ALL) "
    "SELECT item_id AS id, CASE WHEN k IN (12, 13) THEN 'pre_send_review' ELSE 'dialogue_decision' END AS mode, "
    "CASE WHEN k = 6 THEN array_to_string(l[1:12], ',') WHEN k IN (7, 8, 10, 11) THEN '' ELSE CAST(item_id AS VARCHAR) END AS candidates, "
    "CASE WHEN k IN (7, 8, 10, 11) THEN 'No item matches.' WHEN k = 6 THEN NULL ELSE 'A. ' || name || ' (' || coalesce(drawer, 'no drawer on record') || ')' END AS first_choice, text FROM c JOIN f USING (setting, family)"
)
def teacher_prompts(read):
    """The prompt of each case: instruction, lettered choices, and the payload as compact JSON, read back from it."""
    j = dialogue.judge(cases(read), items(read), wanted=["prompt"])
    lines = F.split("prompt", "\n")
    payload = F.element_at(lines, -1)
    of = lambda k: F.get_json_object(payload, f"$.{k}")
    ids = F.array_join(F.from_json(of("inventory_candidates"), "array<string>"), ",")
    several = F.size(lines) > 4
    return j.select("id", of("decision_mode").alias("mode"), ids.alias("candidates"), F.when(~several, lines[1]).alias("first_choice"), of("conversation[0].text").alias("text"))


_FAILURE = "CASE WHEN k = 9 THEN 'comprehension_failure strategy=self_correction' ELSE 'search_failure strategy=specific_redirection' END"


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action, {_ERROR} AS error, {REPLY_SQL} AS reply FROM c) SELECT item_id AS id, 'You:   ' || text || chr(10) || '       [' || CASE WHEN k IN (12, 13) THEN 'pre_send_review' ELSE 'dialogue_decision' END || ': source=' || CASE WHEN error IS NULL THEN 'slm' ELSE 'guard' END || ' action=' || action "
    f"|| CASE WHEN k NOT IN (6, 7, 8, 11) THEN ' item=' || item_id ELSE '' END || CASE WHEN action = 'recover' THEN ' failure=' || {_FAILURE} ELSE '' END || coalesce(' note=' || error, '') || ']' || chr(10) || 'Robot: ' || reply AS line FROM a"
)
def reply_format(read):
    """Each case as people read it: what was said, how it was decided, and the reply."""
    c = cases(read)
    j = dialogue.judge(c, items(read), wanted=["item", "action", "error", "reply", "signature", "template"]).join(c.select("id", "text"), "id")
    of = lambda k: F.get_json_object("template", f"$.{k}")
    stage, source = F.get_json_object("signature", "$.mode"), F.when(F.col("error").isNull(), "slm").otherwise("guard")
    item = F.when(of("item") != "none", F.col("item"))
    return j.select("id", dialogue.record_text(F.col("text"), stage, source, F.col("action"), item, of("failure_type"), of("recovery_strategy"), F.col("error"), F.col("reply")).alias("line"))


# -- derived families ------------------------------------------------------------------------------------------------
#: Nouns of the parts, and the words of a workshop and a ward that stand in for them.
_SWAPS = [("ring", "pencil"), ("widget", "syringe"), ("bolt", "marker"), ("gear", "multimeter"), ("plate", "gloves")]
_SWAPPED = "name"
for _a, _b in _SWAPS:
    _SWAPPED = f"replace({_SWAPPED}, '{_a}', '{_b}')"


@query(
    f"WITH {I}, s AS (SELECT item_id, {_SWAPPED} AS name FROM i), x AS (SELECT *, string_split(name, ' ')[1] AS w, replace(name, ' ', '_') AS id FROM s) "
    "SELECT item_id, CASE WHEN contains(name, 'pencil') THEN 'pencil' WHEN id IN ('blue_tape', 'white_tape', 'medical_tape') THEN 'tape' WHEN contains(name, 'syringe') THEN 'syringe' WHEN contains(name, 'marker') THEN 'marker' WHEN contains(name, 'multimeter') THEN 'multimeter' "
    "WHEN contains(name, 'glove') THEN 'gloves' WHEN contains(name, 'mask') THEN 'mask' ELSE name END AS family, "
    "CASE WHEN contains(name, 'pencil') THEN CASE WHEN w IN ('blue', 'orange', 'red', 'yellow') THEN w END WHEN contains(name, 'syringe') THEN NULL WHEN contains(name, 'marker') THEN CASE WHEN w = 'blue' THEN w END WHEN contains(name, 'multimeter') THEN CASE WHEN w = 'orange' THEN w END END AS color FROM x"
)
def family_ladder(read):
    """Families and attributes derived from ids and names, step by step; the first step that applies decides."""
    name = F.expr(_SWAPPED)
    return datasets.with_family(inventory(read).select("item_id", name.alias("name"), F.replace(name, F.lit(" "), F.lit("_")).alias("key")), "key", "name").select("item_id", "family", F.col("attributes")["color"].alias("color"))


# -- sessions --------------------------------------------------------------------------------------------------------
#: What the user says turn by turn, by the item's key modulo 4.
_SAID = [
    ["'Which ' || family || ' is here'", "'The ' || name || ' please'", "'never mind'"],
    ["'hello friend'", "'never mind'", "'Where is the ' || name || '?'"],
    ["'Where is the ' || name || '?'", "'No, I said the ' || name", "'thanks'"],
    ["'Where is the ' || name || '?'", "'where is it'", "'Is there any zorp here'"],
]
_LISTED = "CASE WHEN drawer IS NULL THEN 'I have no place on record for that item.' ELSE 'The ' || name || ' is listed in ' || drawer || '.' END"
_STEPS = [
    [("clarify", "NULL", "'Which type do you need? Please give its color, size, or exact name.'"), ("locate", "item_id", _LISTED), ("clarify", "NULL", "'Which type do you need? Please give its color, size, or exact name.'")],  # the family is still pending
    [("redirect", "NULL", "'I can help you locate items in the inventory. Which item do you need?'"), ("cancel", "NULL", "'Okay, I have cancelled this request.'")],
    [("locate", "item_id", _LISTED), ("recover", "item_id", "CASE WHEN drawer IS NULL THEN '' ELSE 'Sorry, I misunderstood. ' END || " + _LISTED)],
    [("locate", "item_id", _LISTED), ("locate", "item_id", _LISTED), ("clarify", "NULL", "'Which type do you need? Please give its color, size, or exact name.'")],
]


@query(
    f"WITH {I}, {UNIQUE_SQL} "
    + " UNION ALL ".join(
        f"SELECT item_id AS session, {t} AS turn, {_SAID[k][t]} AS text, '{a}' AS action, CAST({i} AS VARCHAR) AS item, {r} AS reply, {'true' if a in ('cancel', 'recover') else 'false'} AS closes FROM n WHERE item_id % 4 = {k}" for k, steps in enumerate(_STEPS) for t, (a, i, r) in enumerate(steps)
    )
)
def sessions(read):
    """Sessions replayed turn by turn against a teacher of fixed rules, with review before sending, memory, and the rule that closes them."""
    i = named_inventory(read)
    said = F.array(*map(F.expr, _SAID[0]))
    for k in (1, 2, 3):
        said = F.when(F.col("item_id") % 4 == k, F.array(*map(F.expr, _SAID[k]))).otherwise(said)
    turns = i.select(F.col("item_id").alias("session"), "setting", F.posexplode(said).alias("turn", "text"))
    return dialogue.sessions(turns, items(read)).select("session", "turn", "text", "action", "item", "reply", "closes")


_FAILED = "CASE WHEN action = 'recover' THEN CASE WHEN k = 9 THEN 'comprehension_failure' ELSE 'search_failure' END ELSE 'none' END"


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action, {_ERROR} AS error FROM c), f AS (SELECT *, {_FAILED} AS failure FROM a) SELECT item_id AS id, "
    "CASE WHEN action = 'cancel' THEN 'ended' WHEN action = 'clarify' THEN 'awaiting_clarification' WHEN action IN ('locate', 'recover') THEN 'located' WHEN action = 'not_found' THEN 'awaiting_request' ELSE 'unchanged' END AS next_state, "
    "CASE WHEN action IN ('locate', 'recover') OR failure <> 'none' THEN 'risky' ELSE 'routine' END AS risk, CASE WHEN failure <> 'none' THEN 'failure:' || failure ELSE 'success:' || action END AS scenario, "
    "error IS NULL AND action IN ('locate', 'recover') AND drawer IS NOT NULL AS cacheable FROM f"
)
def judged_labels(read):
    """Next state, risk class, scenario and cacheability of the checked decisions of all cases."""
    from ..operators import decisions

    j = dialogue.judge(cases(read), items(read), wanted=["action", "error", "template"])
    failure = F.coalesce(F.get_json_object("template", "$.failure_type"), F.lit("none"))
    labelled = j.withColumn("failure", F.when(F.col("action") == "recover", failure).otherwise("none"))
    risky = F.col("action").isin("locate", "recover") | (F.col("failure") != "none")
    # a decision becomes a pattern if it broke no rule, binds an item, and has a source in the request or memory for all that it says
    cacheable = F.col("error").isNull() & F.col("action").isin("locate", "recover") & F.col("template").isNotNull()
    return labelled.select(
        "id",
        decisions.next_state(F.col("action")).alias("next_state"),
        F.when(risky, "risky").otherwise("routine").alias("risk"),
        F.when(F.col("failure") != "none", F.concat(F.lit("failure:"), "failure")).otherwise(F.concat(F.lit("success:"), "action")).alias("scenario"),
        cacheable.alias("cacheable"),
    )
