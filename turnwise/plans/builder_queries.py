"""Data set builders on trials that are made from the inventory, so that what they have to give is known in SQL."""

from pyspark.sql import functions as F

from ..operators import datasets as B
from ..operators import decisions as D
from ..operators import dialogue
from .base import I, query
from .rule_queries import ACTION_SQL, CASES_SQL, UNIQUE_SQL, V3_SQL, cases, items, named_inventory

#: Trials by the item's key modulo 7; SQL for the turns of each kind.
_ASK, _VAGUE = "'Where is the ' || name || '?'", "'Which ' || family || ' is here'"
_SAY = "'The ' || name || ' is in ' || coalesce(drawer, 'drawer 7') || '.'"
_SHRUG = "'It is over there.'"
_TRIALS = [
    [("participant", "'hello friend'"), ("participant", _ASK), ("robot", _SAY)],
    [("participant", _ASK), ("robot", _SHRUG)],
    [("participant", _VAGUE), ("robot", _SAY)],
    [("participant", _ASK), ("robot", _SAY)],
    [("participant", _VAGUE), ("robot", _SAY)],
    [("participant", _ASK), ("robot", _SAY)],
    [("operator", "'Please go on.'"), ("participant", _ASK), ("operator", "'Please go on.'"), ("robot", _SHRUG), ("robot", _SAY)],
]
_T = f"{UNIQUE_SQL}, t AS (SELECT item_id AS trial, item_id % 37 AS participant, item_id % 7 AS k, setting, name, family, drawer FROM n)"


def trials(read):
    """(trial, participant, setting, turns, reviewed_item, item): item is what the user's last words name."""
    i = named_inventory(read)
    turns = F.lit(None).cast(B.TURNS)
    for k, said in enumerate(_TRIALS):
        turns = F.when(F.col("item_id") % 7 == k, F.array(*(F.struct(F.lit(r).alias("role"), F.expr(t).alias("text")) for r, t in said))).otherwise(turns)
    k, key = F.col("item_id") % 7, F.col("item_id").cast("string")
    return i.select(
        F.col("item_id").alias("trial"),
        (F.col("item_id") % 37).alias("participant"),
        F.when(k == 5, "ship").otherwise(F.col("setting")).alias("setting"),
        turns.alias("turns"),
        F.when(k == 3, "zzz").when(k.isin(4, 6), key).alias("reviewed_item"),
        F.when(k.isin(0, 1, 3, 5), key).alias("item"),
    )


def _seeds(read):
    known = items(read)
    return B.seeds(trials(read), known, lambda r: dialogue.judge(r.withColumn("raw", F.lit("")), known, wanted=["item"]))


@query(
    f"WITH {I}, {_T} SELECT trial, 'seed:' || trial || ':' || kind AS id, kind, CAST(trial AS VARCHAR) AS item, {_ASK} AS request, CASE WHEN kind = 'review' THEN {_SAY} END AS proposal, NULL AS reason FROM t, (VALUES ('request'), ('review')) v(kind) WHERE k IN (0, 6) "
    f"UNION ALL SELECT trial, NULL, NULL, NULL, CASE WHEN k IN (2, 4) THEN {_VAGUE} WHEN k IN (3, 5) THEN {_ASK} END, NULL, CASE WHEN k = 5 THEN 'unknown_setting' WHEN k = 4 THEN 'request_does_not_resolve_target' ELSE 'no_resolved_request' END FROM t WHERE k NOT IN (0, 6)"
)
def seed_rows(read):
    """Requests and reviews of trials whose wording resolves to their item; the other trials with their reason."""
    return _seeds(read)


@query(
    f"WITH {I}, {_T} SELECT CASE WHEN k IN (0, 6) THEN 'kept' WHEN k = 5 THEN 'unknown_setting' WHEN k = 4 THEN 'request_does_not_resolve_target' ELSE 'no_resolved_request' END AS reason, count(*) AS n FROM t GROUP BY 1"
)
def seed_audit(read):
    """Trials kept or excluded, counted by reason."""
    one = _seeds(read).filter("kind IS NULL OR kind = 'request'")
    return one.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_TEST, _VALIDATION = [0, 9, 18], [4, 30]
_SPLIT = "CASE WHEN participant IN (0, 9, 18) THEN 'test' WHEN participant IN (4, 30) THEN 'validation' ELSE 'train' END"


def _folds(read):
    return read("part").sparkSession.createDataFrame([(_TEST, _VALIDATION)], "test_participants array<long>, validation_participants array<long>")


@query(
    f"WITH {I}, {_T}, u AS (SELECT *, row_number() OVER (ORDER BY participant, trial) AS i, count(*) OVER () AS nt FROM t WHERE k <> 6), a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS j, count(*) OVER () AS na FROM n WHERE item_id % 25 = 0), "
    f"r AS (SELECT i AS p, 0 AS sub, 0 AS j, kn, trial || ':' || kind AS id, kind, {_SPLIT} AS split, CASE WHEN k IN (0, 1, 3, 5) THEN CAST(trial AS VARCHAR) END AS reference_item, CASE WHEN kind = 'review' THEN 'recover' WHEN k IN (0, 1, 3, 5) THEN 'locate' END AS reference_action, CASE WHEN kind = 'review' THEN CASE WHEN k = 1 THEN {_SHRUG} ELSE {_SAY} END END AS proposal "
    "FROM u, (VALUES (0, 'request'), (1, 'review')) v(kn, kind) UNION ALL SELECT greatest(1, j * (SELECT max(nt) FROM u) // (na + 1)), 1, j, 0, 'a' || item_id || ':request', 'request', 'augmented', NULL, 'not_found', NULL FROM a) "
    "SELECT row_number() OVER (ORDER BY p, sub, j, kn) AS position, id, kind, split, reference_item, reference_action, proposal FROM r"
)
def stream_rows(read):
    """Requests and reviews of trials in order, split by folds, with other requests spread evenly among them."""
    augmented = named_inventory(read).filter("item_id % 25 = 0").select(F.col("item_id").alias("id"), F.lit("not_found").alias("action"))
    return B.stream(trials(read), augmented, _folds(read))


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (0, 9, 18) THEN 'test' WHEN c_nationkey IN (4, 30) THEN 'validation' ELSE 'train' END AS split FROM customer")
def fold_assignment(read):
    """Participants to the split of the fold that names them; train where none does."""
    return B.fold_of(read("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("participant")), _folds(read), "participant").select("c_custkey", "split")


_FAIL = "CASE trial % 4 WHEN 0 THEN ['speech_failure'] WHEN 1 THEN ['search_failure'] WHEN 2 THEN ['timing_failure', 'speech_failure'] ELSE ['comprehension_failure'] END"
_PREF = "CASE trial % 3 WHEN 0 THEN ['guided_reset', 'self_correction'] WHEN 1 THEN ['confidence_check', 'humming'] ELSE ['humming'] END"
_PRIORITY = "CASE failures[1] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.PRIORITIES.items()) + " END"
_CONVERTED = (
    f"f AS (SELECT *, {_FAIL} AS failures, {_PREF} AS prefs, CASE WHEN trial % 10 = 9 THEN 'other' WHEN trial % 2 = 0 THEN 'retrieval' ELSE 'recovery' END AS task, {_SPLIT} AS split FROM t), "
    f"s AS (SELECT *, list_filter({_PRIORITY}, lambda x: list_contains(prefs, x))[1] AS strategy FROM f), "
    "e AS (SELECT *, CASE WHEN participant >= 33 THEN 'participant_not_in_fold' WHEN k = 6 THEN 'no_user_decision_boundary' WHEN task = 'retrieval' AND trial % 11 = 0 THEN 'retrieval_item_missing' WHEN task = 'recovery' AND len(failures) <> 1 THEN 'multi_failure' WHEN task = 'recovery' AND strategy IS NULL THEN 'no_voice_recovery_preference' WHEN task = 'other' THEN 'unknown_task' END AS reason FROM s)"
)


def _cases_of(read):
    t = trials(read).join(named_inventory(read).select(F.col("item_id").alias("trial"), F.col("setting").alias("own")), "trial")
    k = F.col("trial")
    lists = lambda *xs: F.array(*map(F.lit, xs))
    return t.select(
        F.col("trial").alias("case"),
        "participant",
        F.col("own").alias("setting"),
        F.when(k % 10 == 9, "other").when(k % 2 == 0, "retrieval").otherwise("recovery").alias("task"),
        "turns",
        F.when(k % 11 == 0, "zzz").otherwise(k.cast("string")).alias("target_item"),
        F.col("item").alias("said_item"),
        F.when(k % 4 == 0, lists("speech_failure")).when(k % 4 == 1, lists("search_failure")).when(k % 4 == 2, lists("timing_failure", "speech_failure")).otherwise(lists("comprehension_failure")).alias("failures"),
        F.when(k % 3 == 0, lists("guided_reset", "self_correction")).when(k % 3 == 1, lists("confidence_check", "humming")).otherwise(lists("humming")).alias("preferences"),
    )


def _converted(read):
    c = _cases_of(read)
    members = B.fold_of(c.select("participant").distinct().filter("participant < 33"), _folds(read), "participant")
    return B.convert(c, items(read), members)


@query(
    f"WITH {I}, {_T}, {_CONVERTED}, r AS (SELECT * FROM (VALUES (0), (1), (2), (3)) v(c)) SELECT trial AS case, trial || CASE WHEN c > 0 THEN ':derived_correct_review_' || c ELSE '' END AS id, split, CASE WHEN c > 0 THEN 'derived_control' ELSE 'reviewed' END AS source, CASE WHEN c > 0 THEN 'derived_correct_review' WHEN task = 'retrieval' THEN 'success_retrieval' ELSE failures[1] END AS scenario, "
    "CASE WHEN task = 'retrieval' THEN 'locate' ELSE 'recover' END AS action, CASE WHEN task = 'retrieval' THEN CAST(trial AS VARCHAR) WHEN k IN (0, 1, 3, 5) THEN CAST(trial AS VARCHAR) END AS item, CASE WHEN task = 'retrieval' THEN 'none' ELSE strategy END AS strategy, "
    f"CASE c WHEN 1 THEN 'The ' || name || ' is listed in ' || coalesce(drawer, '') || '.' WHEN 2 THEN 'You can find the ' || name || ' in ' || coalesce(drawer, '') || '.' WHEN 3 THEN 'Please open ' || coalesce(drawer, '') || ' for the ' || name || '.' ELSE CASE WHEN k = 1 THEN {_SHRUG} ELSE {_SAY} END END AS proposal, reason "
    "FROM e JOIN r ON c = 0 OR task = 'retrieval' WHERE reason IS NULL UNION ALL SELECT trial, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM e WHERE reason IS NOT NULL"
)
def converted_cases(read):
    """Reviewed cases as records, with three controls for each retrieval; the others with their reason."""
    return _converted(read)


@query(f"WITH {I}, {_T}, f AS (SELECT trial, {_FAIL} AS failures, {_PREF} AS prefs FROM t) SELECT trial, list_filter({_PRIORITY}, lambda x: list_contains(prefs, x))[1] AS strategy FROM f")
def primary_strategy(read):
    """The first preferred strategy in the order of the kind of failure."""
    return _cases_of(read).select(F.col("case").alias("trial"), B.primary_strategy(F.get("failures", F.lit(0)), F.col("preferences")).alias("strategy"))


_DRAW = "('0x' || left(md5(world || ':' || scenario || ':' || item_id), 4))::BIGINT"


@query(
    f"WITH {I}, {UNIQUE_SQL}, w AS (SELECT range AS world FROM range(3)), s AS (SELECT * FROM (VALUES ('locate'), ('clarify'), ('recover'), ('cancel')) t(scenario)), "
    f"d AS (SELECT world, scenario, item_id, name, family, {_DRAW} AS x FROM w, s, n) SELECT world, scenario, item_id, 'drawer ' || (1 + x % 40) AS drawer, CASE scenario WHEN 'locate' THEN 'Where is the ' || name || '?' WHEN 'clarify' THEN 'Which ' || family || ' is here' WHEN 'recover' THEN 'No, I said the ' || name ELSE 'never mind' END AS text, scenario AS action FROM d WHERE x % 10 < 3"
)
def world_generator(read):
    """Requests of made-up worlds: items get drawers, and scenarios their items, by hash draws instead of a seeded generator."""
    texts = {"locate": _ASK, "clarify": _VAGUE, "recover": "'No, I said the ' || name", "cancel": "'never mind'"}
    x = named_inventory(read).withColumn("world", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("scenario", F.explode(F.array(*map(F.lit, texts))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("world").cast("string"), "scenario", F.col("item_id").cast("string"))), 1, 4), 16, 10).cast("long")
    text = F.lit(None).cast("string")
    for s, t in texts.items():
        text = F.when(F.col("scenario") == s, F.expr(t)).otherwise(text)
    drawn = x.withColumn("x", draw).filter("x % 10 < 3")
    return drawn.select("world", "scenario", "item_id", F.concat(F.lit("drawer "), (1 + F.col("x") % 40).cast("string")).alias("drawer"), text.alias("text"), F.col("scenario").alias("action"))


@query(
    f"WITH {I}, {UNIQUE_SQL}, v AS (SELECT item_id AS trial, item_id % 6 AS k, item_id % 4 < 2 AS spare, name FROM n) SELECT trial, CASE WHEN k NOT IN (0, 2) AND spare THEN 'x1' ELSE 'x2' END AS sample, CASE WHEN k IN (0, 2) OR spare THEN 1 END AS turns, "
    "CASE WHEN k = 2 THEN 'Where is the ' || name || '? Please.' WHEN k = 0 OR spare THEN 'Where is the ' || name || '?' END AS first, CASE WHEN k IN (0, 2) OR spare THEN NULL WHEN k = 1 THEN 'unresolved_role_or_source_span' WHEN k = 3 THEN 'no_participant_request' WHEN k = 4 THEN 'empty_source_turn' ELSE 'crosses_next_trial' END AS reason FROM v"
)
def case_preparation(read):
    """Of each trial the first usable version, reviewed ones first, cut clean at the decision; else why not."""
    i = named_inventory(read)

    def turn(role, text, flags=()):
        role = F.lit(role) if role else F.lit(None).cast("string")
        return F.struct(role.alias("role"), F.expr(text).alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.array(*map(F.lit, flags)).cast("array<string>").alias("flags"))

    kinds = [[turn("participant", _ASK)], [turn("participant", _ASK, ["noise"])], [turn("participant", _ASK), turn("participant", "'Please.'")], [turn("robot", _SHRUG)], [turn("participant", "'  '")], [turn("participant", _ASK, ["next_trial"])]]
    reviewed = F.array(*kinds[0])
    for k, ts in enumerate(kinds):
        reviewed = F.when(F.col("item_id") % 6 == k, F.array(*ts)).otherwise(reviewed)
    spare = F.when(F.col("item_id") % 4 < 2, F.array(turn("operator", "'Please go on.'"), turn("participant", _ASK))).otherwise(F.array(turn(None, _ASK), turn("participant", _ASK)))
    version = lambda sample, ok, turns: i.select(F.col("item_id").alias("trial"), F.lit(sample).alias("sample"), F.lit(ok).alias("reviewed"), turns.alias("turns"), (F.size(turns) - 1).alias("cut"))
    best = B.best_version(version("x1", False, spare).unionByName(version("x2", True, reviewed)))
    return best.select("trial", "sample", F.when(F.col("turns").isNotNull(), F.size("turns")).alias("turns"), F.get("turns", F.lit(0))["text"].alias("first"), "reason")


@query(
    "WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'participant' WHEN 'assistant' THEN 'robot' ELSE 'operator' END AS role, len(text) < 60 AS short FROM conversations), b AS (SELECT conv_id, bool_or(short AND role <> 'operator') AS bad, bool_or(role = 'participant') AS asked FROM c GROUP BY conv_id), "
    "r AS (SELECT conv_id, role, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM c WHERE role <> 'operator'), g AS (SELECT conv_id, CAST(count(*) FILTER (new) AS INT) AS n FROM r GROUP BY conv_id) "
    "SELECT conv_id, CASE WHEN NOT bad AND asked THEN n END AS kept, CASE WHEN bad THEN 'unresolved_role_or_source_span' WHEN NOT asked THEN 'no_participant_request' END AS reason FROM b LEFT JOIN g USING (conv_id)"
)
def clean_prefix(read):
    """Dialogues without operators' turns, turns of one speaker joined; refused where a turn is flagged (here: short) or nobody asks."""
    role = F.when(F.col("role") == "user", "participant").when(F.col("role") == "assistant", "robot").otherwise("operator")
    flags = F.when(F.length("text") < 60, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    turn = F.struct("turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), flags.alias("flags"))
    c = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    prefix, reason = B.clean_prefix(F.col("turns"), F.size("turns") - 1)
    return c.select("conv_id", F.when(prefix.isNotNull(), F.size(prefix)).alias("kept"), reason.alias("reason"))


@query(
    "WITH c AS (SELECT o_custkey AS trial, CAST(o_orderkey AS VARCHAR) AS source, o_orderstatus = 'F' AS archive, CAST(o_orderkey % 10 AS INT) AS turn, NOT (o_orderpriority LIKE '5%') AS phrase, (o_orderkey % 100) / 100.0 AS support, (o_orderkey % 7) / 7.0 AS item_support FROM orders), "
    "f AS (SELECT *, phrase AND support >= 0.7 AND item_support >= 0.5 AS fine FROM c), b AS (SELECT * FROM f WHERE fine QUALIFY row_number() OVER (PARTITION BY trial ORDER BY archive DESC, support DESC, item_support DESC, turn, source) = 1), "
    "a AS (SELECT trial, count(*) FILTER (NOT fine) AS attempts FROM f GROUP BY trial) SELECT trial, CASE WHEN b.source IS NULL THEN 'excluded' ELSE 'accepted' END AS status, b.source, b.turn, attempts FROM a LEFT JOIN b USING (trial)"
)
def example_extraction(read):
    """The best supported candidate of each trial by four keys, and how many were refused."""
    o = read("orders")
    c = o.select(
        F.col("o_custkey").alias("trial"),
        F.col("o_orderkey").cast("string").alias("source"),
        (F.col("o_orderstatus") == "F").alias("archive"),
        (F.col("o_orderkey") % 10).cast("int").alias("turn"),
        F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("phrase"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("support"),
        ((F.col("o_orderkey") % 7) / 7.0).alias("item_support"),
    )
    return B.best_examples(c)


@query(
    "WITH r AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_nationkey END AS grp, CASE WHEN c_nationkey % 5 = 0 AND c_custkey % 400 = 7 THEN 'test' WHEN c_nationkey < 20 THEN 'train' ELSE 'test' END AS split, md5(CAST(c_custkey // 2 AS VARCHAR)) AS input, "
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'none' WHEN 'MACHINERY' THEN 'guided_reset' ELSE 'self_correction' END AS strategy, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['self_correction'] END AS acceptable FROM customer) "
    "SELECT 'missing field' AS check, count(*) FILTER (grp IS NULL) AS failures FROM r UNION ALL SELECT 'repeated id', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY id) UNION ALL SELECT 'group in several splits', count(*) FROM (SELECT grp FROM r WHERE grp IS NOT NULL GROUP BY grp HAVING count(DISTINCT split) > 1) "
    "UNION ALL SELECT 'input in several splits', count(*) FROM (SELECT input FROM r GROUP BY input HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'strategy not acceptable', count(*) FILTER (strategy <> 'none' AND len(acceptable) > 0 AND NOT list_contains(acceptable, strategy)) FROM r"
)
def records_audit(read):
    """Checks over all records of a data set; each is one aggregate, and nothing comes to the driver."""
    c, k, nation = read("customer"), F.col("c_custkey"), F.col("c_nationkey")
    r = c.select(
        F.when(k % 50 == 0, k - 1).otherwise(k).alias("id"),
        F.when(k % 31 != 0, nation).alias("group"),
        F.when((nation % 5 == 0) & (k % 400 == 7), "test").when(nation < 20, "train").otherwise("test").alias("split"),
        F.md5(F.floor(k / 2).cast("string")).alias("input"),
        F.when(F.col("c_mktsegment") == "BUILDING", "none").when(F.col("c_mktsegment") == "MACHINERY", "guided_reset").otherwise("self_correction").alias("strategy"),
        F.when(k % 3 != 0, F.array(F.lit("self_correction"))).otherwise(F.array().cast("array<string>")).alias("acceptable"),
    )
    return B.audit(r, ["id", "group", "split", "input"])


_NEXT = "CASE action WHEN 'cancel' THEN 'ended' WHEN 'clarify' THEN 'awaiting_clarification' WHEN 'locate' THEN 'located' WHEN 'recover' THEN 'located' WHEN 'not_found' THEN 'awaiting_request' ELSE 'unchanged' END"


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT {V3_SQL} AS surface, {ACTION_SQL} AS action, CASE WHEN k IN (12, 13) THEN 'reviewing_proposed_answer' ELSE 'awaiting_request' END AS state FROM c) "
    f"SELECT 'query' AS type, surface AS text, NULL AS state, action, NULL AS next_state, count(*) AS support FROM a GROUP BY ALL UNION ALL SELECT 'transition', NULL, state, action, {_NEXT}, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'config', NULL, 'awaiting_request', NULL, NULL, 1"
)
def compiler_split(read):
    """What a compiler of state machines reads: configuration, typed wordings with their actions, and observed transitions, with support."""
    j = dialogue.judge(cases(read), items(read), wanted=["v3", "action", "signature"]).select("v3", "action", F.get_json_object("signature", "$.state").alias("state"))
    none = F.lit(None).cast("string")
    q = j.groupBy(F.col("v3").alias("text"), "action").agg(F.count(F.lit(1)).alias("support")).select(F.lit("query").alias("type"), "text", none.alias("state"), "action", none.alias("next_state"), "support")
    t = j.groupBy("state", "action").agg(F.count(F.lit(1)).alias("support")).select(F.lit("transition").alias("type"), none.alias("text"), "state", "action", D.next_state(F.col("action")).alias("next_state"), "support")
    c = j.sparkSession.createDataFrame([("config", None, "awaiting_request", None, None, 1)], "type string, text string, state string, action string, next_state string, support long")
    return q.unionByName(t).unionByName(c)


@query(
    f"WITH {I}, {CASES_SQL} SELECT item_id AS id, CASE WHEN k IN (2, 3) THEN NULL WHEN k = 6 THEN 'clarify' WHEN k = 7 THEN 'not_found' WHEN k = 8 THEN 'cancel' WHEN k IN (9, 12) THEN 'recover' WHEN k = 10 THEN 'redirect' ELSE 'locate' END AS teacher, {ACTION_SQL} AS checked FROM c"
)
def condition_pivot(read):
    """Every case under every condition, the answers side by side."""
    c = cases(read)
    checked = dialogue.judge(c, items(read), wanted=["action"]).select("id", F.lit("checked").alias("condition"), "action")
    alone = c.select("id", F.lit("teacher").alias("condition"), F.when(F.col("raw").startswith("{") & ~F.col("raw").rlike('"action":"locate","action"'), F.get_json_object("raw", "$.action")).alias("action"))
    return checked.unionByName(alone).groupBy("id").pivot("condition", ["teacher", "checked"]).agg(F.first("action"))
