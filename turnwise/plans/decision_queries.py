"""The decisions of all cases by rules in columns (``operators/decision_columns``); Python only finds what the texts name."""

from pyspark.sql import functions as F

from ..operators import decision_columns as D
from ..operators import dialogue
from ..session import keeper
from .base import I, query
from .rule_queries import _ATTRIBUTES, _ERROR, _FAILED, ACTION_SQL, CASES_SQL, REPLY_SQL, UNIQUE_SQL, cases, items, named_inventory


def decided(read):
    requests = cases(read)
    return D.decide(requests, items(read), keep=keeper(requests.sparkSession, "decisions"))


@query(f"WITH {I}, {CASES_SQL} SELECT item_id AS id, {_ERROR} AS error, ({_ERROR}) IS NOT NULL AS guard_used, {ACTION_SQL} AS action FROM c")
def decided_cases(read):
    """Strict form, validity by inventory and by the user's words, and the guard's decision in place of a broken one."""
    return decided(read).select("id", "error", "guard_used", "action")


@query(f"WITH {I}, {CASES_SQL} SELECT item_id AS id, {REPLY_SQL} AS reply FROM c")
def decided_replies(read):
    """Replies rendered from the decision, the item's place and the family's members."""
    return decided(read).select("id", "reply")


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action FROM c), f AS (SELECT *, {_FAILED} AS failure FROM a) SELECT item_id AS id, CASE WHEN k NOT IN (7, 8, 11) THEN family END AS pending_item_family, CASE WHEN k NOT IN (6, 7, 8, 11) THEN CAST(item_id AS VARCHAR) END AS resolved_item_id, "
    "CASE WHEN k = 8 THEN NULL ELSE action END AS last_robot_action, CAST(CASE WHEN k = 9 THEN 3 WHEN action = 'recover' THEN 1 ELSE 0 END AS INT) AS recovery_count, "
    f"CASE WHEN k NOT IN (6, 7, 8, 11) THEN {_ATTRIBUTES} ELSE '{{}}' END AS known_attributes, "
    "'{\"has_missing_attributes\":false,\"has_pending_family\":false,\"has_proposal\":' || CASE WHEN k IN (12, 13) THEN 'true' ELSE 'false' END || ',\"has_resolved_item\":' || CASE WHEN k IN (8, 10) THEN 'true' ELSE 'false' END || ',\"last_action\":' || CASE WHEN k IN (9, 10) THEN '\"locate\"' ELSE 'null' END || "
    "CASE WHEN k IN (12, 13) THEN ',\"mode\":\"pre_send_review\",\"state\":\"reviewing_proposed_answer\"}' ELSE ',\"mode\":\"dialogue_decision\",\"state\":\"awaiting_request\"}' END AS signature, "
    "CASE WHEN action = 'cancel' THEN 'ended' WHEN action = 'clarify' THEN 'awaiting_clarification' WHEN action IN ('locate', 'recover') THEN 'located' WHEN action = 'not_found' THEN 'awaiting_request' ELSE 'unchanged' END AS next_state, "
    "CASE WHEN action IN ('locate', 'recover') OR failure <> 'none' THEN 'risky' ELSE 'routine' END AS risk FROM f"
)
def decided_states(read):
    """The state signature before, memory after, what follows and how risky it is."""
    known = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("memory.known_attributes"))))
    return decided(read).select("id", "memory.pending_item_family", "memory.resolved_item_id", "memory.last_robot_action", "memory.recovery_count", known.alias("known_attributes"), "signature", "next_state", "risk")


@query(
    f"WITH {I}, {CASES_SQL} SELECT item_id AS id, CASE WHEN k IN (0, 1, 5, 12, 13) THEN 'where is the <item>' WHEN k IN (2, 3, 4) THEN 'please find <item>' WHEN k = 6 THEN 'which <family> is here' WHEN k = 7 THEN 'hello friend' WHEN k = 8 THEN 'never mind' WHEN k = 9 THEN 'no i said the <item>' WHEN k = 10 THEN 'where is it' ELSE 'is there any zorp here' END AS v2, "
    "CASE WHEN k IN (0, 1, 2, 3, 4, 5, 12, 13) THEN '<item>' WHEN k = 6 THEN 'which <family> here' WHEN k = 7 THEN 'hello friend' WHEN k = 8 THEN 'never mind' WHEN k = 9 THEN 'no said <item>' WHEN k = 10 THEN 'it' ELSE 'there any zorp here' END AS v1 FROM c"
)
def typed_styles(read):
    """The wording of every case with slots, as the second and the first extractor have it."""
    return dialogue.judge(cases(read), items(read), wanted=["v2", "v1"])


def conversations_about_items(read):
    """(id, setting, text, history, proposal, latency_ms): an item is asked for and answered in one of four ways, and the user goes on."""
    n, name = F.col("item_id"), F.col("name")
    asked, place = F.concat(F.lit("Where is the "), name, F.lit("?")), F.coalesce("drawer", F.lit("the back"))
    told = F.when(n % 4 == 0, F.concat(F.lit("The "), name, F.lit(" is listed in "), place, F.lit("."))).when(n % 4 == 1, F.concat(F.lit("The "), name, F.lit(" is in drawer 99."))).when(n % 4 == 2, F.concat(F.lit("The "), name, F.lit(" is here."))).otherwise("I am not sure.")
    turn = lambda r, t: F.struct(F.lit(r).alias("role"), t.alias("text"))
    return named_inventory(read).select(
        n.alias("id"),
        "setting",
        F.when(n % 2 == 1, F.concat(F.lit("thanks, the "), name)).otherwise("thanks").alias("text"),
        F.array(turn("user", asked), turn("robot", told)).alias("history"),
        F.when(n % 5 == 0, F.concat(F.lit("The "), name, F.lit(" is in drawer 98."))).alias("proposal"),
        F.when(n % 7 != 0, n * 10 % 20_000).cast("double").alias("latency_ms"),
    )


# a drawer's number is the item's size here, and the second extractor knows attributes but no drawers
_NOW = "CASE WHEN item_id % 2 = 1 THEN 'thanks the <item>' ELSE 'thanks' END"
_TOLD = "CASE item_id % 4 WHEN 0 THEN 'the <item> is listed in ' || CASE WHEN drawer IS NULL THEN 'the back' ELSE 'drawer <attr:size>' END WHEN 1 THEN 'the <item> is in drawer 99' WHEN 2 THEN 'the <item> is here' ELSE 'i am not sure' END"


@query(
    f"WITH {I}, {UNIQUE_SQL} SELECT item_id AS id, {_NOW} AS current, 'where is the <item> ' || {_NOW} AS all_user, {_TOLD} AS previous_robot, CASE WHEN item_id % 5 = 0 THEN 'the <item> is in drawer 98' ELSE '<empty>' END AS proposal, "
    f"'user:where is the <item>|robot:' || {_TOLD} || '|user:' || {_NOW} AS history, CASE WHEN item_id % 5 = 0 THEN 'wrong_drawer' ELSE 'none' END AS proposal_relation, "
    "CASE WHEN item_id % 4 = 3 THEN 'missing_item' WHEN item_id % 4 = 2 OR (item_id % 4 = 0 AND drawer IS NULL) THEN 'same_item_no_drawer' WHEN item_id % 4 = 1 THEN 'wrong_drawer' ELSE 'correct' END AS prior_relation, "
    "CASE WHEN item_id % 7 = 0 THEN 'missing' WHEN item_id * 10 % 20000 <= 1000 THEN '0-1000ms' WHEN item_id * 10 % 20000 <= 3000 THEN '1000-3000ms' WHEN item_id * 10 % 20000 <= 7000 THEN '3000-7000ms' WHEN item_id * 10 % 20000 <= 15000 THEN '7000-15000ms' ELSE '>15000ms' END AS timing FROM n"
)
def typed_bundles(read):
    """The whole feature bundle of each conversation: typed turns, relations of the replies to the item asked for, timing class."""
    return dialogue.bundles(conversations_about_items(read), items(read)).withColumn("history", F.array_join("history", "|"))


_TOLD_ACTION = "CASE k WHEN 6 THEN 'clarify' WHEN 7 THEN 'not_found' WHEN 8 THEN 'cancel' WHEN 9 THEN 'recover' WHEN 10 THEN 'redirect' WHEN 12 THEN 'recover' ELSE 'locate' END"
_R = "round(avg(CAST({} AS INT)), 6)"


@query(
    f"WITH {I}, {CASES_SQL}, a AS (SELECT *, {ACTION_SQL} AS action, {_ERROR} AS error, {_TOLD_ACTION} AS told, k NOT IN (2, 3, 4) AS formed FROM c) SELECT k AS kind, count(*) AS n, {_R.format('formed')} AS well_formed, {_R.format('error IS NULL')} AS valid, {_R.format('formed AND told = action')} AS right_action, "
    f"{_R.format('formed AND told = action AND k <> 1')} AS right_in_all, count(*) FILTER (formed AND k = 1) AS unknown_items, count(*) FILTER (formed AND k IN (5, 9, 12) AND action <> 'recover') AS false_alarms, count(*) FILTER (formed AND k NOT IN (5, 9, 12) AND action = 'recover') AS missed_failures FROM a GROUP BY k"
)
def decision_scores(read):
    """What the teacher told, scored against the checked decisions, by kind of case."""
    return D.scores(decided(read), F.col("id") % 14, "kind")
