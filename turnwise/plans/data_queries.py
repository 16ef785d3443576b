"""Validators, decision rules, dataset builders, splits and audits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import ordering as O
from ..operators import splits as P
from .base import I, U, inventory, query, utterances

#: Decisions about parts, derived from their keys: valid ones and each kind of broken one.
_DEC = (
    "d AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'locate' WHEN 1 THEN 'clarify' WHEN 2 THEN 'recover' WHEN 3 THEN 'redirect' WHEN 4 THEN 'not_found' ELSE 'dance' END AS action, "
    "CASE WHEN item_id % 6 IN (0, 2) AND item_id % 4 <> 0 THEN item_id END AS resolved, CASE WHEN item_id % 5 = 0 THEN 'OTHER' ELSE family END AS family, "
    "CASE WHEN item_id % 6 = 2 AND item_id % 7 <> 0 THEN 'search_failure' ELSE 'none' END AS failure, CASE WHEN item_id % 6 = 2 THEN 'self_correction' WHEN item_id % 11 = 0 THEN 'guided_reset' ELSE 'none' END AS strategy, family AS true_family FROM i)"
)


def _decisions(read):
    k = F.col("item_id")
    action = F.when(k % 6 == 0, "locate").when(k % 6 == 1, "clarify").when(k % 6 == 2, "recover").when(k % 6 == 3, "redirect").when(k % 6 == 4, "not_found").otherwise("dance")
    return inventory(read).select(
        "item_id",
        action.alias("action"),
        F.when((k % 6).isin(0, 2) & (k % 4 != 0), k).alias("resolved"),
        F.when(k % 5 == 0, "OTHER").otherwise(F.col("family")).alias("family"),
        F.when((k % 6 == 2) & (k % 7 != 0), "search_failure").otherwise("none").alias("failure"),
        F.when(k % 6 == 2, "self_correction").when(k % 11 == 0, "guided_reset").otherwise("none").alias("strategy"),
        F.col("family").alias("true_family"),
    )


_ERROR = (
    "CASE WHEN action NOT IN ('locate', 'clarify', 'recover', 'redirect', 'not_found', 'cancel') THEN 'unknown_action' WHEN (failure <> 'none') <> (action = 'recover') THEN 'failure_without_recovery' "
    "WHEN action = 'recover' AND strategy = 'none' THEN 'recovery_without_strategy' WHEN action <> 'recover' AND strategy <> 'none' THEN 'strategy_without_recovery' WHEN action = 'locate' AND resolved IS NULL THEN 'locate_without_item' "
    "WHEN action NOT IN ('locate', 'recover') AND resolved IS NOT NULL THEN 'item_not_allowed' WHEN resolved IS NOT NULL AND family <> true_family THEN 'item_family_disagree' WHEN action IN ('redirect', 'cancel') AND family IS NOT NULL AND item_id % 2 = 1 THEN 'context_not_allowed' END"
)


@query(f"WITH {I}, {_DEC} SELECT item_id, {_ERROR} AS first_error FROM d")
def validator_rules(read):
    """Decision rules as columns; the first one that fails names the error."""
    return _decisions(read).select("item_id", D.first_error().alias("first_error"))


@query(f"WITH {I}, {_DEC}, e AS (SELECT *, {_ERROR} AS err FROM d) SELECT item_id, CASE WHEN err IS NULL THEN action WHEN resolved IS NOT NULL THEN 'locate' WHEN family <> 'OTHER' THEN 'clarify' ELSE 'not_found' END AS action, err IS NOT NULL AS repaired FROM e")
def guard_decision(read):
    """A deterministic decision where the teacher's breaks a rule."""
    return _decisions(read).withColumn("err", D.first_error()).select("item_id", D.guarded().alias("action"), F.col("err").isNotNull().alias("repaired"))


@query(f"WITH {I}, {_DEC} SELECT item_id, CASE action WHEN 'cancel' THEN 'ended' WHEN 'clarify' THEN 'awaiting_clarification' WHEN 'locate' THEN 'located' WHEN 'recover' THEN 'located' WHEN 'not_found' THEN 'awaiting_request' ELSE 'unchanged' END AS next_state, CASE WHEN action IN ('locate', 'recover') OR failure <> 'none' THEN 'risky' ELSE 'routine' END AS risk, CASE WHEN failure <> 'none' THEN 'failure:' || failure ELSE 'success:' || action END AS scenario FROM d")
def decision_labels(read):
    """Next state, risk class and scenario."""
    return _decisions(read).select("item_id", D.next_state(F.col("action")).alias("next_state"), F.when(F.col("action").isin("locate", "recover") | (F.col("failure") != "none"), "risky").otherwise("routine").alias("risk"), F.when(F.col("failure") != "none", F.concat(F.lit("failure:"), "failure")).otherwise(F.concat(F.lit("success:"), "action")).alias("scenario"))


@query("""SELECT doc_id, '{"has_toxic_label":' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || ',"mode":"' || lang || '","state":"' || CASE WHEN quality = 1 THEN 'located' ELSE 'awaiting_request' END || '"}' AS signature FROM labels JOIN documents USING (doc_id)""")
def state_signature(read):
    """P25: compact JSON of a state with sorted keys."""
    d = read("labels").join(read("documents").select("doc_id", "lang"), "doc_id")
    return d.select("doc_id", F.to_json(F.struct((F.col("toxic") == 1).alias("has_toxic_label"), F.col("lang").alias("mode"), F.when(F.col("quality") == 1, "located").otherwise("awaiting_request").alias("state"))).alias("signature"))


@query(f"WITH {I} SELECT item_id, trim(name) AS name, nullif(trim(coalesce(drawer, '')), '') AS location, count(*) OVER (PARTITION BY setting, name) AS same_name, name <> '' AND family <> '' AS valid FROM i")
def inv_normalize(read):
    """Trimmed inventory rows, places with fallback, duplicate names, validity."""
    return D.normalize_inventory(inventory(read))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_valid(props) AS valid FROM events")
def strict_json(read):
    """Documents parsed by a schema, malformed ones told apart."""
    x = F.from_json("props", "k int")
    return read("events").select("event_id", x["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(
    "WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'locate' WHEN 1 THEN 'recover' WHEN 2 THEN 'redirect' ELSE 'cancel' END AS action FROM conversations), c AS (SELECT conv_id, max(turn) FILTER (action = 'cancel') AS cancelled FROM m GROUP BY conv_id) "
    "SELECT conv_id, arg_max(action, turn) AS last_action, count(*) FILTER (action = 'recover' AND (cancelled IS NULL OR turn > cancelled)) AS recoveries FROM m JOIN c USING (conv_id) GROUP BY conv_id"
)
def memory_transition(read):
    """Memory folded over a dialogue's decisions; cancelling empties it."""
    t = read("conversations")
    action = F.when(F.col("turn") % 4 == 0, "locate").when(F.col("turn") % 4 == 1, "recover").when(F.col("turn") % 4 == 2, "redirect").otherwise("cancel")
    seq = F.transform(F.array_sort(F.collect_list(F.struct("turn", action.alias("action")))), lambda x: x["action"])
    m = t.groupBy("conv_id").agg(D.fold_memory(seq).alias("m"))
    return m.select("conv_id", "m.last_action", F.col("m.recoveries").cast("long").alias("recoveries"))


@query(f"WITH {I} SELECT family, CAST(sum(CAST(a = b AS INT)) AS BIGINT) AS equal_decisions FROM (SELECT family, name || '|' || brand AS a, lag(name || '|' || brand) OVER (PARTITION BY family ORDER BY item_id) AS b FROM i) GROUP BY family")
def decision_equality(read):
    """M6: deep equality of neighbouring decisions through sorted entries."""
    i = inventory(read).select("family", "item_id", F.array_sort(F.map_entries(F.create_map(F.lit("name"), "name", F.lit("brand"), "brand"))).alias("a"))
    i = O.position(i, [F.col("family"), F.floor(F.col("item_id") / O.SPAN)], ["item_id"])
    before = i.select("family", (F.col("position") + 1).alias("position"), F.col("a").alias("b"))
    return i.join(before, ["family", "position"], "left").groupBy("family").agg(F.sum((F.col("a") == F.col("b")).cast("int")).alias("equal_decisions"))


@query("WITH h AS (SELECT c_custkey, sha256('split-v2:' || c_custkey) AS h FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY h, c_custkey) - 1 AS r, count(*) OVER () AS n FROM h) SELECT c_custkey, CASE WHEN r < floor(CAST(0.65 AS DOUBLE) * n) THEN 'train' WHEN r < floor(CAST(0.82 AS DOUBLE) * n) THEN 'validation' ELSE 'test' END AS split FROM r")
def hash_split(read):
    """Participants in the order of a hash, cut at 65 and 82 per cent."""
    return P.hash_split(read("customer").select("c_custkey"), "c_custkey", salt="split-v2:", cuts=(0.65, 0.82))


@query("WITH g AS (SELECT DISTINCT o_custkey % 97 AS g FROM orders), r AS (SELECT g, row_number() OVER (ORDER BY md5('g:' || g), g) - 1 AS r, count(*) OVER () AS n FROM g), s AS (SELECT g, CASE WHEN r < n * 15 // 100 THEN 'test' WHEN r < n * 30 // 100 THEN 'validation' ELSE 'train' END AS split FROM r) SELECT split, count(*) AS orders, count(DISTINCT o_custkey % 97) AS groups FROM orders JOIN s ON g = o_custkey % 97 GROUP BY split")
def grouped_split(read):
    """Whole groups go to one split."""
    o = read("orders").withColumn("g", F.col("o_custkey") % 97)
    return P.grouped_split(o, "g").groupBy("split").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("g").alias("groups"))


@query(
    "WITH m AS (SELECT c_custkey AS a, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS root FROM customer), s AS (SELECT root, count(*) AS n FROM m GROUP BY root), "
    "k AS (SELECT root, row_number() OVER (ORDER BY n DESC, root) - 1 AS k FROM s) SELECT a, CAST(CASE WHEN k // 3 % 2 = 0 THEN k % 3 ELSE 2 - k % 3 END AS INT) AS fold FROM m JOIN k USING (root)"
)
def group_folds(read):
    """Participants that share anything stay together (connected components); groups are dealt to folds back and forth by size."""
    return P.group_folds(read("customer").select(F.col("c_custkey").alias("a"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("b")), folds=3)


@query("SELECT 'null text' AS check, count(*) FILTER (text IS NULL) AS failures FROM documents UNION ALL SELECT 'repeated id', CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) FROM documents UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'bad label', count(*) FILTER (toxic NOT IN (0, 1)) FROM labels UNION ALL SELECT 'length differs', count(*) FILTER (n_chars <> len(text)) FROM documents")
def split_audit(read):
    """One row for each check with its number of failures."""
    d, lab = read("documents"), read("labels")
    one = d.agg(F.count_if(F.col("text").isNull()).alias("null text"), (F.count("doc_id") - F.count_distinct("doc_id")).alias("repeated id"), F.count_if(F.col("n_chars") != F.length("text")).alias("length differs")).unpivot([], ["null text", "repeated id", "length differs"], "check", "failures")
    two = lab.join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("label without document").alias("check"), "failures")
    three = lab.agg(F.count_if(~F.col("toxic").isin(0, 1)).alias("failures")).select(F.lit("bad label").alias("check"), "failures")
    return one.unionByName(two).unionByName(three)


@query(f"WITH {I}, o AS (SELECT item_id, 'drawer' AS field, CASE WHEN item_id % 200 = 0 THEN NULL ELSE 'drawer 99' END AS value FROM i WHERE item_id % 100 = 0) SELECT i.item_id, CASE WHEN o.field IS NOT NULL THEN o.value ELSE i.drawer END AS drawer, o.field IS NOT NULL AS overridden FROM i LEFT JOIN o USING (item_id)")
def inventory_overrides(read):
    """Counterfactual edits of rows, null being a value too."""
    i = inventory(read)
    o = i.filter("item_id % 100 = 0").select("item_id", F.lit("drawer").alias("field"), F.when(F.col("item_id") % 200 != 0, "drawer 99").alias("value"))
    j = i.join(o, "item_id", "left")
    return j.select("item_id", F.when(F.col("field").isNotNull(), F.col("value")).otherwise(F.col("drawer")).alias("drawer"), F.col("field").isNotNull().alias("overridden"))


@query(f"WITH {I} SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'The ' || name || ' is in drawer ' || (1 + CAST(size AS INT) % 40) || '.' WHEN 1 THEN 'The ' || lead(name, 1, 'nothing') OVER (ORDER BY item_id) || ' is in ' || coalesce(drawer, 'no drawer') || '.' ELSE 'It is over there.' END AS reply FROM i")
def error_examples(read):
    """Replies with a wrong drawer, a wrong item, or nothing said."""
    i = inventory(read)
    i = O.position(i, [F.floor(F.col("item_id") / O.SPAN)], ["item_id"])
    after = i.select((F.col("position") - 1).alias("position"), F.col("name").alias("next"))
    nxt, k = F.coalesce("next", F.lit("nothing")), F.col("item_id") % 3
    wrong = F.concat(F.lit("The "), "name", F.lit(" is in drawer "), (1 + F.col("size").cast("int") % 40).cast("string"), F.lit("."))
    other = F.concat(F.lit("The "), nxt, F.lit(" is in "), F.coalesce("drawer", F.lit("no drawer")), F.lit("."))
    return i.join(after, "position", "left").select("item_id", F.when(k == 0, wrong).when(k == 1, other).otherwise("It is over there.").alias("reply"))
