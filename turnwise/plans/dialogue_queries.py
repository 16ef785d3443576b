"""The dialogue rules over all requests, and the agent's gates as columns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialogue
from .base import I, L, U, inventory, query, turn_log, utterances


@query()
def dialogue_judge(read):
    """Each request typed three ways, resolved, its raw decision checked or repaired, and answered."""
    i = inventory(read)
    raw = F.to_json(F.struct(F.lit("locate").alias("action"), F.lit("SMALL").alias("item_family"), F.col("id").cast("string").alias("resolved_item_id"), F.create_map().cast("map<string,string>").alias("attributes"), F.array().cast("array<string>").alias("missing_attributes"), F.lit(False).alias("failure_detected"), F.lit("none").alias("failure_type"), F.lit("none").alias("recovery_strategy")))
    items = i.select("setting", F.col("item_id").cast("string").alias("id"), "name", "family", F.create_map(F.lit("brand"), "brand", F.lit("size"), "size").alias("attributes"), "drawer")
    return dialogue.judge(utterances(read).withColumn("raw", raw), items)


@query(f"WITH {L} SELECT position, CASE WHEN p >= 0.98 AND margin >= 0.8 AND NOT conflict THEN 'locate' WHEN p >= 0.98 AND margin >= 0.8 THEN 'unknown' ELSE 'clarify' END AS action FROM (SELECT position, least(1.0, value / 60) AS p, value / 100 AS margin, coalesce(correct, false) AS conflict FROM log)")
def threshold_gate(read):
    """A model's item only with enough probability and margin and no conflict."""
    sure = (F.least(F.lit(1.0), F.col("value") / 60) >= 0.98) & (F.col("value") / 100 >= 0.8)
    conflict = F.coalesce("correct", F.lit(False))
    return turn_log(read).select("position", F.when(sure & ~conflict, "locate").when(sure, "unknown").otherwise("clarify").alias("action"))


@query(
    r"WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) SELECT conv_id, (role = 'user' AND regexp_matches(lower(text), '\b(not there|wrong|can''t find|cannot find|couldn''t find|isn''t there|not in)\b')) "
    r"OR (role = 'assistant' AND (regexp_matches(lower(text), 'not understand|am delayed|repeat your request') OR (contains(lower(text), 'open the drawer') AND NOT regexp_matches(lower(text), 'drawer [0-9]')))) AS failure FROM l"
)
def failure_evidence(read):
    """Signs of failure in the last turn."""
    last = read("conversations").groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("x")).select("conv_id", "x.*")
    t = F.lower("text")
    vague = t.rlike("not understand|am delayed|repeat your request") | (t.contains("open the drawer") & ~t.rlike("drawer [0-9]"))
    return last.select("conv_id", (((F.col("role") == "user") & T.rejected("text")) | ((F.col("role") == "assistant") & vague)).alias("failure"))


@query(f"WITH {L} SELECT position FROM log WHERE category IN ('view', 'click', 'purchase') AND coalesce(correct, false) AND value < 200")
def cacheable(read):
    """Decisions that may become patterns."""
    return turn_log(read).filter(F.col("category").isin("view", "click", "purchase") & F.coalesce("correct", F.lit(False)) & (F.col("value") < 200)).select("position")


@query("SELECT count(*) FILTER (source IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es')) AS foreign_rows, count(DISTINCT lang) AS suites, count(*) FILTER (len(regexp_extract_all(text, '\\S+')) <= 1) AS slot_only FROM documents")
def purity_guards(read):
    """Rows that don't belong, suites that would be pooled, patterns that would take everything."""
    return read("documents").agg(F.count_if(F.col("source").isNull() | ~F.col("lang").isin("en", "de", "fr", "es")).alias("foreign_rows"), F.count_distinct("lang").alias("suites"), F.count_if(F.regexp_count("text", F.lit(r"\S+")) <= 1).alias("slot_only"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS history, CASE WHEN role = 'assistant' THEN 'pre_send_review' ELSE 'dialogue_decision' END AS mode, CASE WHEN role = 'assistant' THEN 'reviewing_proposed_answer' WHEN turn > 0 THEN 'awaiting_clarification' ELSE 'awaiting_request' END AS state FROM conversations")
def payload_projection(read):
    """Mode, state and the length of the history of each turn's payload."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-7, 0)
    r = F.col("role") == "assistant"
    return read("conversations").select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("history"), F.when(r, "pre_send_review").otherwise("dialogue_decision").alias("mode"), F.when(r, "reviewing_proposed_answer").when(F.col("turn") > 0, "awaiting_clarification").otherwise("awaiting_request").alias("state"))


@query(f"WITH {I} SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN name || ' (' || setting || ', ' || item_id || ')' ELSE name END AS label FROM i")
def choice_labels(read):
    """Names, qualified where several items share one; counts join back by name."""
    i = inventory(read)
    n = i.groupBy(F.lower("name").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return i.join(n, F.lower("name") == F.col("k")).select("item_id", F.when(F.col("n") > 1, F.concat("name", F.lit(" ("), "setting", F.lit(", "), F.col("item_id").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("label"))


@query(f"WITH {I} SELECT item_id, array_to_string(list_distinct_ordered, '|') AS aliases, 'drawer ' || size AS drawer FROM (SELECT item_id, size, [name, string_split(name, ' ')[2], lower(family)] AS list_distinct_ordered FROM i)")
def raw_inventory(read):
    """Raw rows with aliases and drawer texts."""
    return inventory(read).select("item_id", F.array_join(F.array_distinct(F.array(F.col("name"), F.split("name", " ")[1], F.lower("family"))), "|").alias("aliases"), F.concat(F.lit("drawer "), "size").alias("drawer"))


@query(
    f"WITH {U}, {I}, h AS (SELECT id, name, instr(lower(text), name) AS a, instr(lower(text), name) + len(name) AS b FROM u JOIN i ON id = item_id WHERE contains(lower(text), name) UNION ALL SELECT id, string_split(name, ' ')[2], instr(lower(text), string_split(name, ' ')[2]), instr(lower(text), string_split(name, ' ')[2]) + len(string_split(name, ' ')[2]) FROM u JOIN i ON id = item_id WHERE contains(lower(text), string_split(name, ' ')[2])) "
    "SELECT h.id, h.name AS phrase FROM h WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.id = h.id AND k.a <= h.a AND k.b >= h.b AND k.b - k.a > h.b - h.a)"
)
def alias_spans(read):
    """Spans of names and aliases, those within longer ones dropped."""
    j = utterances(read).join(inventory(read).select("item_id", "name"), F.col("id") == F.col("item_id"))
    names = F.explode(F.array(F.col("name"), F.split("name", " ")[1])).alias("phrase")
    h = j.select("id", F.lower("text").alias("t"), names).withColumn("a", F.expr("instr(t, phrase)")).filter("a > 0").withColumn("b", F.col("a") + F.length("phrase"))
    spans = F.collect_list(F.struct("a", "b")).over(Window.partitionBy("id"))
    inside = F.exists("s", lambda k: (k["a"] <= F.col("a")) & (k["b"] >= F.col("b")) & (k["b"] - k["a"] > F.col("b") - F.col("a")))
    return h.withColumn("s", spans).filter(~inside).select("id", "phrase")


_FEATS = "list_concat(list_concat(list_transform(w, lambda x: 'w:' || x), list_transform(w, lambda x: 'w:' || x)), list_concat(list_transform(range(1, len(c) - 1), lambda k: '3:' || substr(c, k, 3)), list_transform(range(1, len(c) - 2), lambda k: '4:' || substr(c, k, 4))))"


@query(
    f"WITH {I}, e AS (SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN name ELSE left(name, len(name) - 2) || right(name, 1) END AS entity FROM i), s AS (SELECT DISTINCT name AS selector FROM i), "
    f"sf AS (SELECT selector, unnest({_FEATS}) AS f FROM (SELECT selector, string_split(selector, ' ') AS w, ' ' || selector || ' ' AS c FROM s)), n AS (SELECT count(*) AS n FROM s), idf AS (SELECT f, ln((1.0 + max(n)) / (1.0 + count(DISTINCT selector))) + 1 AS idf FROM sf, n GROUP BY f), "
    f"sv AS (SELECT selector, f, x / sqrt(sum(x * x) OVER (PARTITION BY selector)) AS x FROM (SELECT selector, f, (1 + ln(count(*))) * max(idf) AS x FROM sf JOIN idf USING (f) GROUP BY ALL)), d AS (SELECT DISTINCT entity FROM e WHERE entity NOT IN (SELECT selector FROM s)), "
    f"ef AS (SELECT entity, unnest({_FEATS}) AS f FROM (SELECT entity, string_split(entity, ' ') AS w, ' ' || entity || ' ' AS c FROM d)), ev AS (SELECT entity, f, x / sqrt(sum(x * x) OVER (PARTITION BY entity)) AS x FROM (SELECT entity, f, (1 + ln(count(*))) * max(idf) AS x FROM ef JOIN idf USING (f) GROUP BY ALL)), "
    "c AS (SELECT entity, selector, round(sum(ev.x * sv.x), 6) AS cosine FROM ev JOIN sv USING (f) GROUP BY ALL), k AS (SELECT entity, count(*) AS n, min(selector) AS first, max(cosine) AS best FROM (SELECT *, max(cosine) OVER (PARTITION BY entity) AS m FROM c) WHERE cosine >= 0.55 AND m - cosine <= 0.04 GROUP BY entity) "
    "SELECT id, CASE WHEN entity IN (SELECT selector FROM s) THEN 'exact' WHEN n IS NOT NULL THEN 'cosine_similarity' ELSE 'none' END AS method, CASE WHEN entity IN (SELECT selector FROM s) THEN entity ELSE first END AS selector, CASE WHEN entity IN (SELECT selector FROM s) THEN 1 ELSE coalesce(n, 0) END AS selectors FROM e LEFT JOIN k USING (entity)"
)
def selector_lookup(read):
    """Equal selectors first, else the most similar ones over 0.55 and within 0.04 of the best, by TF-IDF of words and character n-grams."""
    from ..operators import matching as M

    name = F.col("name")
    e = inventory(read).select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 3 == 0, name).otherwise(F.concat(F.substring(name, F.lit(1), F.length(name) - 2), F.substring(name, -1, 1))).alias("entity"))
    s = inventory(read).select(name.alias("selector")).distinct()
    return M.selector_lookup(e, s).select("id", "method", "selector", F.col("selectors").cast("long").alias("selectors"))


@query(
    "WITH w AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'assistant' THEN turn END) OVER p AS robot_turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS recent_users, lag(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before "
    "FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, robot_turn, recent_users, CASE WHEN before IS NULL THEN 'missing' WHEN before * 10 <= 1000 THEN '<=1000' WHEN before * 10 <= 3000 THEN '<=3000' WHEN before * 10 <= 7000 THEN '<=7000' WHEN before * 10 <= 15000 THEN '<=15000' ELSE '>15000' END AS timing FROM w"
)
def feature_bundle(read):
    """Previous reply, recent turns of the user, timing class of each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read("conversations").withColumn("before", F.lag(F.length("text")).over(w))
    robot = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    users = F.count(F.when(F.col("role") == "user", 1)).over(w.rowsBetween(-7, 0))
    return c.select("conv_id", "turn", robot.alias("robot_turn"), users.alias("recent_users"), T.timing_bucket(F.col("before") * 10).alias("timing"))


@query(f"""WITH {I} SELECT item_id, sha256('{{"family":"' || family || '","name":"' || name || '"}}') AS typed_key, sha256('{{"brand":"' || brand || '","drawer":' || CASE WHEN drawer IS NULL THEN 'null' ELSE '"' || drawer || '"' END || ',"family":"' || family || '","name":"' || name || '","size":"' || size || '"}}') AS exact_key FROM i""")
def cache_keys(read):
    """A typed and an exact key of each item's state."""
    j = lambda *c: F.sha2(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}), 256)
    return inventory(read).select("item_id", j("family", "name").alias("typed_key"), j("brand", "drawer", "family", "name", "size").alias("exact_key"))


@query()
def evidence_support(read):
    """Of several transcripts of each request's setting and template, the one that supports it best."""
    from ..operators import alignment

    u = utterances(read).withColumn("key", F.concat_ws("/", "setting", (F.col("id") % 8).cast("string")))
    transcripts = u.filter(F.pmod(F.xxhash64("id"), F.lit(40)) == 0).select("key", F.col("id").alias("transcript"), "text")
    return alignment.evidence(u.select(F.col("id").alias("claim"), "key", "text"), transcripts.select("key", "transcript", "text"))


@query()
def source_alignment(read):
    """Turns aligned with the sentences that they were reviewed from."""
    from ..operators import alignment

    c = read("conversations")
    segments = c.select(F.col("conv_id").alias("version"), "turn", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("p", "text")).select("version", (F.col("turn") * 1_000_000_000 + F.col("p")).alias("segment"), "text")
    return alignment.align_versions(c.select(F.col("conv_id").alias("version"), "turn", "text"), segments)
