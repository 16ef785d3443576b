"""Resolution of requests, joins by key, similarity and interval, controller and automaton joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import matching as M
from ..operators import ordering as O
from ..session import keeper
from .base import I, TEMPLATES, U, inventory, query, spread_utterances, turn_log, utterances

_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
#: Phrases of the inventory with their kinds, and the hits of requests: shared by several queries.
_HITS = f"{U}, {I}, n AS (SELECT DISTINCT setting, item_id, name FROM i), h AS (SELECT u.id, n.item_id FROM u JOIN n ON u.setting = n.setting AND contains(' ' || array_to_string({_W}, ' ') || ' ', ' ' || name || ' '))"


@query(
    f"WITH {_HITS}, c AS (SELECT u.id, u.setting, u.text, count(h.item_id) AS n, min(h.item_id) AS item_id FROM u LEFT JOIN h USING (id) GROUP BY ALL) "
    "SELECT c.id, n AS candidates, CASE WHEN n = 0 THEN 'OBJECT_MISSING' WHEN n > 1 THEN 'ASK_WHICH_ONE' WHEN drawer IS NULL THEN 'LOCATION_MISSING' ELSE 'RETURN_LOCATION' END AS action, "
    "CASE WHEN n = 0 THEN 'I could not match that request to the inventory.' WHEN n > 1 THEN 'Which one do you mean? I know ' || n || ' of them.' WHEN drawer IS NULL THEN 'I have no place on record for the ' || name || '.' ELSE 'The ' || name || ' is listed in ' || drawer || '.' END AS reply "
    "FROM c LEFT JOIN i ON n = 1 AND i.item_id = c.item_id"
)
def lookup_outcome(read):
    """Requests to items by phrase, the outcome by the number of hits, and the rendered reply."""
    items = inventory(read)
    asked = spread_utterances(read)
    hits = M.phrase_counts(asked, items.select("setting", "item_id", "name"))
    per = asked.join(hits.withColumnRenamed("first", "item_id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = per.join(items, (F.col("n") == 1) & (per["item_id"] == items["item_id"]), "left")
    return one.select("id", F.col("n").cast("long").alias("candidates"), *M.outcome(F.col("n"), F.col("name"), F.col("drawer")))


@query(
    f"WITH {I}, p AS (SELECT setting, item_id, 'item' AS kind, name AS phrase FROM i UNION ALL SELECT setting, item_id, 'item', name || 's' FROM i UNION ALL SELECT setting, item_id, 'family', lower(family) FROM i "
    "UNION ALL SELECT setting, item_id, 'attribute', lower(replace(brand, '#', ' ')) FROM i UNION ALL SELECT setting, item_id, 'drawer', drawer FROM i WHERE drawer IS NOT NULL) "
    "SELECT setting, phrase, kind, count(DISTINCT item_id) AS items, min(item_id) AS first_item FROM p GROUP BY ALL"
)
def phrase_table(read):
    """G1: phrases of names, their other numbers, families, attribute values and drawers."""
    return M.phrase_table(inventory(read)).groupBy("setting", "phrase", "kind").agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first_item"))


@query()
def longest_match_scan(read):
    """Greedy longest matches, typed surface, items, ambiguity."""
    table = M.phrase_table(inventory(read)).select("setting", "phrase", "kind", F.when(F.col("kind") == "item", F.col("item_id").cast("string")).otherwise(F.col("phrase")).alias("value"))
    asked = spread_utterances(read)
    return M.typed_features(asked, table, keep=keeper(asked.sparkSession, "longest-match"))


@query(f"WITH {_HITS} SELECT id, count(*) AS hits, array_to_string(list_slice(list_sort(list(item_id)), 1, 3), ',') AS items FROM h GROUP BY id")
def exact_item_hits(read):
    """How many items a request names, and the first three."""
    hits = M.phrase_hits(utterances(read), inventory(read).select("setting", "item_id", "name"))
    return hits.select("id", F.col("n").alias("hits"), F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("items"))


@query(f"WITH {I} SELECT l_orderkey, l_linenumber, name, drawer FROM lineitem LEFT JOIN i ON item_id = l_partkey AND setting = 'lab'")
def lookup_id(read):
    """Lookup by composite key, missing as null."""
    return read("lineitem").join(inventory(read), (F.col("item_id") == F.col("l_partkey")) & (F.col("setting") == "lab"), "left").select("l_orderkey", "l_linenumber", "name", "drawer")


@query(f"WITH {I} SELECT item_id AS q, count(*) OVER w AS matches, CASE WHEN count(*) OVER w = 1 THEN item_id END AS resolved FROM i WINDOW w AS (PARTITION BY family, brand)")
def family_attr_theta(read):
    """How many items have a request's family and known attributes; resolved when it is one.  Counts join back, not items to items."""
    i = inventory(read)
    g = i.groupBy("family", "brand").agg(F.count(F.lit(1)).alias("matches"), F.min("item_id").alias("m"))
    return i.join(g, ["family", "brand"]).select(F.col("item_id").alias("q"), "matches", F.when(F.col("matches") == 1, F.col("m")).alias("resolved"))


@query(
    f"WITH {_HITS}, one AS (SELECT id, min(item_id) AS item_id FROM h GROUP BY id HAVING count(*) = 1), r AS (SELECT u.id, u.setting, u.text, one.item_id, lag(one.item_id) OVER (PARTITION BY u.setting ORDER BY u.id) AS before FROM u LEFT JOIN one USING (id)) "
    "SELECT id, CASE WHEN item_id IS NOT NULL THEN item_id WHEN contains(lower(text), 'please') THEN before END AS item_id, CASE WHEN item_id IS NOT NULL THEN 'current' WHEN contains(lower(text), 'please') AND before IS NOT NULL THEN 'memory' ELSE 'none' END AS source FROM r"
)
def item_resolution(read):
    """The item of this request, else that of the one before it when the request refers back."""
    u = utterances(read)
    hits = M.phrase_hits(u, inventory(read).select("setting", "item_id", "name"))
    one = hits.filter("n = 1").select("id", F.get("first", F.lit(0)).alias("item_id"))
    r = O.position(u.join(one, "id", "left"), [F.col("setting"), F.floor(F.col("id") / O.SPAN)], ["id"])
    r = r.join(r.select("setting", (F.col("position") + 1).alias("position"), F.col("item_id").alias("before")), ["setting", "position"], "left")
    back = F.lower("text").contains("please")
    return r.select("id", F.coalesce("item_id", F.when(back, F.col("before"))).alias("item_id"), F.when(F.col("item_id").isNotNull(), "current").when(back & F.col("before").isNotNull(), "memory").otherwise("none").alias("source"))


@query(f"WITH {I}, w AS (SELECT item_id, setting, unnest(string_split(name, ' ')) AS alias FROM i), b AS (SELECT alias, min(item_id) AS first_id, count(*) AS n FROM w WHERE setting = 'hospital' GROUP BY alias) SELECT item_id, min(first_id) AS first_match, sum(n)::BIGINT AS hits FROM w JOIN b USING (alias) WHERE setting = 'lab' GROUP BY item_id")
def alias_overlap(read):
    """Items whose aliases intersect: the first match and the number of hits, from one row for each alias."""
    w = inventory(read).select("item_id", "setting", F.explode(F.split("name", " ")).alias("alias"))
    b = w.filter("setting = 'hospital'").groupBy("alias").agg(F.min("item_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return w.filter("setting = 'lab'").join(b, "alias").groupBy("item_id").agg(F.min("first_id").alias("first_match"), F.sum("n").alias("hits"))


@query(
    "WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(value * 60000000 AS BIGINT) AS b FROM events WHERE event_type = 'view'), f AS (SELECT event_id AS failure, user_id, epoch_us(ts) AS c, epoch_us(ts) + 3600000000 AS d FROM events WHERE event_type = 'error') "
    "SELECT event_id, count(*) AS overlaps, min(failure) AS first_failure FROM t JOIN f ON t.user_id = f.user_id AND b > c AND a < d GROUP BY event_id"
)
def interval_overlap(read):
    """Turns that overlap failure intervals of the same user."""
    e = read("events").withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")))
    t = e.filter("event_type = 'view'").select("event_id", "user_id", "a", (F.col("a") + (F.col("value") * 60000000).cast("long")).alias("b"))
    f = e.filter("event_type = 'error'").select(F.col("event_id").alias("failure"), "user_id", F.col("a").alias("c"), (F.col("a") + 3600000000).alias("d"))
    return M.interval_join(t, f, "user_id", "a", "b", "c", "d", 3600000000).groupBy("event_id").agg(F.count(F.lit(1)).alias("overlaps"), F.min("failure").alias("first_failure"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_cache(read):
    """Rows without a cached decision."""
    return read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("WITH k AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS key, quality FROM labels) SELECT doc_id, quality AS cached FROM documents LEFT JOIN k ON key = sha256(CAST(doc_id AS VARCHAR))")
def teacher_cache_lookup(read):
    """Cached answers by payload digest."""
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    k = read("labels").select(key.alias("key"), F.col("quality").alias("cached"))
    return read("documents").withColumn("key", key).join(k, "key", "left").select("doc_id", "cached")


_P = (
    "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, vec_id % 16 AS g, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), "
    "m AS (SELECT label, g, k, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY ALL), p AS (SELECT label, g, list(m ORDER BY k) AS c FROM m GROUP BY ALL)"
)


def _patterns(read):
    """Mean vectors of (state, group): a bounded number of patterns for each state, whatever the number of turns."""
    x = read("embeddings").select("label", (F.col("vec_id") % 16).alias("g"), F.posexplode("embedding").alias("k", "x"))
    m = x.groupBy("label", "g", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda y: y["m"]).alias("c"))


def _scored(read):
    e = read("embeddings").select("vec_id", "label", "embedding")
    return e.join(_patterns(read), "label").select("vec_id", "label", "g", F.round(S.dot(F.col("embedding"), F.col("c")), 6).alias("cosine"))


@query(f"WITH {_P}, s AS (SELECT vec_id, g, round(list_dot_product(v, c), 6) AS cosine FROM v JOIN p USING (label)) SELECT vec_id AS turn, g AS pattern, cosine FROM s WHERE cosine >= 0.1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, g) = 1")
def dense_cosine_top1(read):
    """The nearest pattern of the same state over a threshold, ties to the older one."""
    e = read("embeddings").select(F.col("vec_id").alias("turn"), F.col("label").alias("state"), "embedding")
    return M.nearest_pattern(e, _patterns(read).select(F.col("label").alias("state"), F.col("g").alias("pattern"), F.col("c").alias("embedding")), threshold=0.1)


@query(f"WITH {_P} SELECT vec_id AS turn, max(round(list_dot_product(v, c), 6)) AS best, count(*) AS patterns FROM v JOIN p USING (label) GROUP BY vec_id")
def best_similarity(read):
    """The largest cosine to any pattern of the state."""
    return _scored(read).groupBy(F.col("vec_id").alias("turn")).agg(F.max("cosine").alias("best"), F.count(F.lit(1)).alias("patterns"))


@query(f"WITH {_P}, s AS (SELECT vec_id, g, round(list_dot_product(v, c), 6) AS x FROM v JOIN p ON v.label = p.label AND vec_id % 4 = g % 4) SELECT vec_id AS observation, CASE WHEN max(x) >= 0.2 THEN arg_min(g, struct_pack(k := -x, p := g)) END AS merged_into FROM s GROUP BY vec_id")
def merge_candidate(read):
    """The pattern of equal state and template that an observation merges into, if near enough."""
    s = _scored(read).filter(F.col("vec_id") % 4 == F.col("g") % 4)
    best = s.groupBy(F.col("vec_id").alias("observation")).agg(F.min(F.struct((-F.col("cosine")).alias("k"), "g")).alias("m"))
    return best.select("observation", F.when(-F.col("m.k") >= 0.2, F.col("m.g")).alias("merged_into"))


@query(f"WITH {_P}, s AS (SELECT vec_id AS turn, list_dot_product(v, c) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, c), 6) DESC, g) AS r FROM v JOIN p USING (label)) SELECT turn, round(max(CASE WHEN r = 1 THEN round(x, 6) END) - max(CASE WHEN r = 2 THEN round(x, 6) END), 6) AS margin FROM s GROUP BY turn")
def top2_margin(read):
    """Best minus second best."""
    top = F.slice(F.sort_array(F.collect_list("cosine"), asc=False), 1, 2)
    return _scored(read).groupBy(F.col("vec_id").alias("turn")).agg(top.alias("t")).select("turn", F.round(F.get("t", F.lit(0)) - F.get("t", F.lit(1)), 6).alias("margin"))


@query("WITH x AS (SELECT vec_id % 13 AS a, label, min(vec_id) AS x FROM embeddings GROUP BY ALL HAVING count(*) >= 4), t AS (SELECT label, min(vec_id) AS y FROM embeddings GROUP BY label HAVING avg(vec_id) > median(vec_id)) SELECT vec_id, coalesce(x, y) AS entry, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'typed' ELSE 'none' END AS level FROM embeddings e LEFT JOIN x ON x.a = vec_id % 13 AND x.label = e.label LEFT JOIN t ON t.label = e.label")
def exact_then_typed(read):
    """An exact key first, then a typed one."""
    e = read("embeddings").withColumn("a", F.col("vec_id") % 13)
    exact = e.groupBy("a", "label").agg(F.min("vec_id").alias("x"), F.count(F.lit(1)).alias("n")).filter("n >= 4").drop("n")
    typed = e.groupBy("label").agg(F.min("vec_id").alias("y"), (F.avg("vec_id") > F.percentile("vec_id", 0.5)).alias("late")).filter("late").drop("late")
    j = e.join(exact, ["a", "label"], "left").join(typed, "label", "left")
    return j.select("vec_id", F.coalesce("x", "y").alias("entry"), F.when(F.col("x").isNotNull(), "exact").when(F.col("y").isNotNull(), "typed").otherwise("none").alias("level"))


@query(f"WITH {I}, r AS (SELECT name, count(*) AS refs FROM i WHERE setting = 'lab' AND family = 'SMALL' AND brand < 'Brand#2' GROUP BY name) SELECT item_id, coalesce(refs, 0) AS refs, CASE coalesce(refs, 0) WHEN 0 THEN 'unmapped' WHEN 1 THEN 'mapped' ELSE 'ambiguous' END AS status FROM i LEFT JOIN r USING (name)")
def reference_comparison(read):
    """Learned names against a reference list: none, one or many."""
    i = inventory(read)
    r = i.filter("setting = 'lab' AND family = 'SMALL' AND brand < 'Brand#2'").groupBy("name").agg(F.count(F.lit(1)).alias("refs"))
    refs = F.coalesce("refs", F.lit(0))
    return i.join(r, "name", "left").select("item_id", refs.alias("refs"), F.when(refs == 0, "unmapped").when(refs == 1, "mapped").otherwise("ambiguous").alias("status"))


@query(f"WITH {I}, f AS (SELECT DISTINCT string_split(name, ' ')[2] AS w FROM i) SELECT item_id, w FROM i JOIN f ON list_contains(string_split(name, ' '), w)")
def token_subset(read):
    """Families whose words all occur in a name."""
    i = inventory(read)
    f = i.select(F.split("name", " ")[1].alias("w")).distinct()
    return i.select("item_id", F.explode(F.split("name", " ")).alias("w")).distinct().join(f, "w").select("item_id", "w")


@query(
    f"WITH {I}, k AS (SELECT item_id, string_split(lower(name || ' ' || family || ' ' || replace(brand, '#', ' ')), ' ') AS w FROM i), p AS (SELECT DISTINCT name AS p FROM i UNION SELECT lower(family) FROM i UNION SELECT DISTINCT lower(family) || ' ' || string_split(name, ' ')[2] FROM i UNION SELECT DISTINCT lower(replace(brand, '#', ' ')) FROM i) "
    "SELECT item_id AS key, p AS phrase FROM k JOIN p ON len(list_filter(string_split(p, ' '), lambda x: NOT list_contains(w, x))) = 0"
)
def word_subset(read):
    """Phrases of one or more words that an item's words contain, in any order."""
    i = inventory(read)
    brand, family = F.lower(F.replace("brand", F.lit("#"), F.lit(" "))), F.lower("family")
    keys = i.select(F.col("item_id").alias("key"), F.split(F.lower(F.concat_ws(" ", "name", family, brand)), " ").alias("words"))
    named = i.select(F.explode(F.array("name", family, F.concat_ws(" ", family, F.split("name", " ")[1]), brand)).alias("phrase")).distinct()
    return M.subset_join(keys, named.withColumn("words", F.split("phrase", " ")))


@query(
    f"WITH {_P}, s AS (SELECT vec_id AS turn, g, round(list_dot_product(v, c), 6) AS x FROM v JOIN p USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY x DESC, g) AS r FROM s), t AS (SELECT turn, max(CASE WHEN r = 1 THEN x END) AS best, max(CASE WHEN r = 1 THEN g END) AS g, max(CASE WHEN r = 2 THEN x END) AS second FROM r GROUP BY turn) "
    "SELECT turn, CASE WHEN best >= 0.2 AND round(best - coalesce(second, 0), 6) >= 0.02 AND (turn + g) % 5 <> 0 THEN 'locate' WHEN best >= 0.2 AND round(best - coalesce(second, 0), 6) >= 0.02 THEN 'unknown' ELSE 'clarify' END AS action FROM t"
)
def margin_gate(read):
    """A turn's nearest pattern counts only with enough similarity, enough lead over the next one, and no conflict (one pattern in five disagrees with a turn)."""
    two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("k"), "g"))), 1, 2)  # a state has a bounded number of patterns
    t = _scored(read).groupBy(F.col("vec_id").alias("turn")).agg(two.alias("t")).select("turn", (-F.get("t", F.lit(0))["k"]).alias("best"), F.get("t", F.lit(0))["g"].alias("g"), F.coalesce(-F.get("t", F.lit(1))["k"], F.lit(0.0)).alias("second"))
    sure = (F.col("best") >= 0.2) & (F.round(F.col("best") - F.col("second"), 6) >= 0.02)
    return t.select("turn", F.when(sure & ((F.col("turn") + F.col("g")) % 5 != 0), "locate").when(sure, "unknown").otherwise("clarify").alias("action"))


_EDGES = "e AS (SELECT * FROM (VALUES (0, 'L:where', 1), (1, 'L:is', 2), (2, 'L:the', 3), (3, 'S:item', 4), (0, 'L:which', 5), (5, 'L:drawer', 6), (6, 'L:has', 2), (3, 'S:item', 7), (7, 'S:item', 4)) t(src, symbol, dst))"


@query(
    f"WITH RECURSIVE {U}, {_EDGES}, w AS (SELECT id, {_W} AS w FROM u), p(id, pos, state, slots) AS (SELECT id, 1, 0, 0 FROM w UNION ALL "
    "SELECT p.id, p.pos + 1, e.dst, p.slots + CAST(e.symbol LIKE 'S:%' AS INT) FROM p JOIN w USING (id) JOIN e ON e.src = p.state AND p.pos <= len(w) AND (e.symbol = 'L:' || w[p.pos] OR e.symbol LIKE 'S:%')) "
    "SELECT p.id, count(*) AS paths, min(slots) AS slots FROM p JOIN w USING (id) WHERE state = 4 AND pos = len(w) + 1 GROUP BY p.id"
)
def fst_paths(read):
    """Counts of accepting paths of a transducer over requests' words, each slot edge taking one word (J18 itself: ``fst_matches``)."""
    return M.automaton_paths(utterances(read).select("id", T.words("text").alias("w")))


_SLOT_EDGES = "e AS (SELECT * FROM (VALUES (0, 'L:where', 1), (1, 'L:is', 2), (2, 'L:the', 3), (3, 'S:item', 4), (0, 'L:which', 5), (5, 'L:drawer', 6), (6, 'L:has', 2)) t(src, symbol, dst))"


@query(
    f"WITH RECURSIVE {U}, {_SLOT_EDGES}, w AS (SELECT id, {_W} AS w FROM u), k AS (SELECT unnest(range(1, 129)) AS n), "
    "p(id, pos, state, item, literals, slots) AS (SELECT id, 1, 0, CAST(NULL AS VARCHAR), 0, 0 FROM w WHERE len(w) <= 128 UNION ALL "
    "SELECT p.id, p.pos + CAST(k.n AS INT), e.dst, CASE WHEN e.symbol LIKE 'S:%' THEN array_to_string(w[p.pos:p.pos + k.n - 1], ' ') ELSE p.item END, p.literals + CAST(e.symbol LIKE 'L:%' AS INT), p.slots + CAST(e.symbol LIKE 'S:%' AS INT) "
    "FROM p JOIN w USING (id) JOIN e ON e.src = p.state JOIN k ON p.pos + k.n <= len(w) + 1 "
    "WHERE (e.symbol = 'L:' || w[p.pos] AND k.n = 1) OR (e.symbol LIKE 'S:%' AND coalesce(p.item, array_to_string(w[p.pos:p.pos + k.n - 1], ' ')) = array_to_string(w[p.pos:p.pos + k.n - 1], ' '))) "
    "SELECT p.id, 'locate' AS intent, item, max(literals) AS literals, min(slots) AS slots FROM p JOIN w USING (id) WHERE state = 4 AND pos = len(w) + 1 GROUP BY p.id, item"
)
def fst_matches(read):
    """Interpretations of requests by a transducer whose slots capture phrases of one or more words."""
    m = M.automaton_matches(utterances(read).select("id", T.words("text").alias("w")))
    return m.select("id", "intent", F.col("captures")["item"].alias("item"), "literals", "slots")


@query(f"WITH {U}, w AS (SELECT id, {_W} AS w FROM u) SELECT id, CASE WHEN id % 50 = 0 THEN 'too long' WHEN w[1:3] = ['where', 'is', 'the'] AND len(w) > 3 OR w[1:4] = ['which', 'drawer', 'has', 'the'] AND len(w) > 4 THEN 'matched' ELSE 'no match' END AS status FROM w")
def fst_status(read):
    """Whether a request was matched, wasn't, or was too long to be walked (one in fifty is said forty times over)."""
    w = T.words("text")
    return M.match_status(utterances(read).select("id", F.when(F.col("id") % 50 == 0, F.flatten(F.array_repeat(w, 40))).otherwise(w).alias("w")), longest=64)


@query(f"WITH {U}, w AS (SELECT id, {_W} AS w FROM u) SELECT id, CASE WHEN w[1] = 'where' AND w[2] = 'is' THEN 2 WHEN w[1] = 'where' THEN 1 ELSE 0 END AS state FROM w")
def acceptor_traversal(read):
    """A deterministic walk as a fold over all words, by a table of edges; the state where it ends or stops."""
    walk = M.traverse(T.words("text"), [(0, "where", 1), (1, "is", 2)], {2})
    return utterances(read).select("id", F.element_at(walk["path"], -1).alias("state"))


@query("WITH c AS (SELECT * FROM (VALUES ('view', 'fsm', 'serve', 'located'), ('click', 'fsm', 'serve', 'located'), ('error', 'slm', 'repair', 'awaiting_request')) t(event, state, action, next_state)), log AS (SELECT event_id, event_type, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'fsm' ELSE 'slm' END AS route FROM events) SELECT event_id, coalesce(action, 'unsupported') AS action, coalesce(next_state, route) AS next_state FROM log LEFT JOIN c ON c.event = event_type AND c.state = route")
def controller_step(read):
    """(state, event) to action and next state."""
    rows = [("view", "fsm", "serve", "located"), ("click", "fsm", "serve", "located"), ("error", "slm", "repair", "awaiting_request")]
    log = turn_log(read).select("event_id", "category", "route")
    c = log.sparkSession.createDataFrame(rows, "category string, route string, action string, next_state string")
    return log.join(F.broadcast(c), ["category", "route"], "left").select("event_id", F.coalesce("action", F.lit("unsupported")).alias("action"), F.coalesce("next_state", "route").alias("next_state"))


@query("SELECT a.doc_id, CAST(a.quality = 1 AND n_chars > 100 AS BOOLEAN) AS fsm, a.toxic = 0 AS slm, (a.quality = 1 AND n_chars > 100) IS NOT DISTINCT FROM (a.toxic = 0) AS agree FROM labels a JOIN documents USING (doc_id)")
def teacher_vs_fsm(read):
    """Both decisions on the same turn, compared with nulls equal."""
    d = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")
    fsm, slm = (F.col("quality") == 1) & (F.col("n_chars") > 100), F.col("toxic") == 0
    return d.select("doc_id", fsm.alias("fsm"), slm.alias("slm"), fsm.eqNullSafe(slm).alias("agree"))


@query(f"WITH {I}, p AS (SELECT family, lower(string_split(name, ' ')[1]) AS word, count(DISTINCT item_id) AS n FROM i GROUP BY ALL) SELECT family, word, n, n = 1 AS resolves FROM p")
def short_attribute_answer(read):
    """Whether one attribute word alone picks a pending item."""
    p = inventory(read).groupBy("family", F.lower(F.split("name", " ")[0]).alias("word")).agg(F.count_distinct("item_id").alias("n"))
    return p.select("family", "word", "n", (F.col("n") == 1).alias("resolves"))


@query(
    f"WITH {I}, n AS (SELECT DISTINCT name FROM i), g AS (SELECT name, unnest(list_transform(range(1, len(name) - 1), lambda k: substr(name, k, 3))) AS g FROM n), t AS (SELECT name, g, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT name, sqrt(sum(n * n)) AS norm FROM t GROUP BY name) "
    "SELECT a.name AS a, b.name AS b, round(sum(a.n * b.n) / max(x.norm * y.norm), 6) AS cosine FROM t a JOIN t b ON a.g = b.g AND a.name < b.name JOIN s x ON x.name = a.name JOIN s y ON y.name = b.name GROUP BY ALL"
)
def trigram_cosine(read):
    """Cosines of distinct names' trigram counts, joined by trigram."""
    names = inventory(read).select("name").distinct()
    t = names.select("name", F.explode(S.char_ngrams(F.col("name"), 3)).alias("g")).groupBy("name", "g").agg(F.count(F.lit(1)).alias("n"))
    return M.sparse_cosine(t, "name", "g", "n").select("a", "b", F.round("cosine", 6).alias("cosine"))


_PROTOTYPES = ", ".join(f"({i}, '{t.replace('{n}', '').replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(TEMPLATES))
_TF = f"{U}, f AS (SELECT id, unnest({_W}) AS w FROM u), n AS (SELECT count(*) AS n FROM u), df AS (SELECT w, count(DISTINCT id) AS df FROM f GROUP BY w), idf AS (SELECT w, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM df, n)"


@query(f"WITH {_TF} SELECT w, round(idf, 6) AS idf FROM idf")
def tfidf_idf(read):
    """Smoothed inverse document frequencies."""
    return M.idf(spread_utterances(read).select("id", F.explode(T.words("text")).alias("w")), utterances(read).count()).select("w", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TF}, t AS (SELECT id, w, (1 + ln(count(*))) * max(idf) AS x FROM f JOIN idf USING (w) GROUP BY id, w) SELECT id, w, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM t")
def tfidf_norm(read):
    """Unit TF-IDF vectors as a long table."""
    f = spread_utterances(read).select("id", F.explode(T.words("text")).alias("w"))
    return M.tfidf(f, M.idf(f, utterances(read).count())).select("id", "w", F.round("weight", 6).alias("weight"))


@query(
    f"WITH {_TF}, t AS (SELECT id, w, (1 + ln(count(*))) * max(idf) AS x FROM f JOIN idf USING (w) GROUP BY id, w), z AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM t), "
    f"pf AS (SELECT prototype, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM (VALUES {_PROTOTYPES}) q(prototype, text)), pt AS (SELECT prototype AS id, w, (1 + ln(count(*))) * max(idf) AS x FROM pf JOIN idf USING (w) GROUP BY ALL), p AS (SELECT id AS prototype, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM pt), "
    "s AS (SELECT z.id, prototype, round(sum(z.x * p.x), 6) AS cosine FROM z JOIN p USING (w) GROUP BY ALL) SELECT id, prototype, cosine FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, prototype) = 1"
)
def prototype_match(read):
    """Each request's nearest prototype by TF-IDF cosine; prototypes are the templates without their items."""
    f = spread_utterances(read).select("id", F.explode(T.words("text")).alias("w"))
    weights = M.idf(f, utterances(read).count())
    rows = f.sparkSession.createDataFrame([(i, t.replace("{n}", "")) for i, t in enumerate(TEMPLATES)], "id int, text string")
    p = M.tfidf(rows.select("id", F.explode(T.words("text")).alias("w")), weights).select(F.col("id").alias("prototype"), "w", F.col("weight").alias("y"))
    s = M.tfidf(f, weights).join(p, "w").groupBy("id", "prototype").agg(F.round(F.sum(F.col("weight") * F.col("y")), 6).alias("cosine"))
    best = s.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("k"), "prototype")).alias("m"))
    return best.select("id", "m.prototype", (-F.col("m.k")).alias("cosine"))


@query(
    "WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL) SELECT label, k, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS v FROM m"
)
def mean_unit_vector(read):
    """Unit mean vectors by state."""
    x = read("embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    m = x.groupBy("label", (F.col("p") + 1).cast("long").alias("k")).agg(F.avg(F.col("v").cast("double")).alias("m"))
    return m.select("label", "k", F.round(F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))), 6).alias("v"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings)")
def l2_normalize(read):
    """M1: norms, and unit vectors with a guard for zero."""
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return read("embeddings").select("vec_id", F.round(S.norm(v), 6).alias("norm"), F.round(S.unit(v)[0], 6).alias("first"))


#: Clarifications, as their words.
_CLARIFY = ["red widget", "the small one in the lab", "brand 3 please", "hospital", "large blue bolt", "steel ring 7", "that gear"]
_SAYS = "CASE item_id % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_CLARIFY)) + " END"
_LINE = lambda x: f"' ' || array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ') || ' '"
_HAS = lambda x: f"contains(line, {_LINE(x)})"
_WORDS = lambda x: f"len(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


@query(
    f"WITH {I}, a AS (SELECT *, item_id % 7 AS ask, {_LINE(_SAYS)} AS line FROM i), s AS (SELECT ask, item_id, CASE WHEN line = {_LINE('name')} THEN 1000 + {_WORDS('name')} WHEN {_HAS('name')} THEN 100 + {_WORDS('name')} ELSE 0 END + CASE WHEN {_HAS('family')} THEN 10 ELSE 0 END + CASE WHEN {_HAS('setting')} THEN 30 ELSE 0 END "
    f"+ CASE WHEN {_HAS('brand')} THEN 20 + {_WORDS('brand')} ELSE 0 END + CASE WHEN {_HAS('size')} THEN 20 + {_WORDS('size')} ELSE 0 END AS score FROM a) SELECT ask, item_id, CAST(score AS INT) AS score FROM s WHERE score > 0 QUALIFY rank() OVER (PARTITION BY ask ORDER BY score DESC) = 1"
)
def narrow_scored(read):
    """Candidates scored by what a clarification names: the whole name 1000, a name within it 100, each by its words, family 10, setting 30, attributes 20; all best ones stay."""
    i = inventory(read).withColumn("ask", F.col("item_id") % 7)
    says = F.element_at(F.array(*map(F.lit, _CLARIFY)), (F.col("ask") + 1).cast("int"))
    return M.narrow(i.withColumn("says", says), "ask", "says", name="name", family="family", setting="setting", attributes=["brand", "size"]).select("ask", "item_id", "score")


@query(
    "WITH h AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0), r AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT item_id, text FROM benchmark) "
    "SELECT 'id' AS check, count(*) AS leaks FROM h WHERE doc_id IN (SELECT doc_id FROM r) UNION ALL SELECT 'utterance', count(*) FROM h WHERE text IN (SELECT text FROM r) UNION ALL SELECT 'fingerprint', count(*) FROM h WHERE sha256(trim(lower(text))) IN (SELECT sha256(trim(lower(text))) FROM r WHERE text IS NOT NULL)"
)
def leakage_semi(read):
    """Held-out rows whose id, wording or fingerprint occurs in the rest."""
    d = read("documents").select("doc_id", "text")
    held = d.filter("doc_id % 10 = 0")
    rest = d.filter("doc_id % 10 <> 0").unionByName(read("benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    keys = {"id": F.col("doc_id"), "utterance": F.col("text"), "fingerprint": F.sha2(F.trim(F.lower("text")), 256)}
    out = None
    for name, key in keys.items():
        row = held.select(key.alias("k")).join(rest.select(key.alias("k")), "k", "left_semi").agg(F.count(F.lit(1)).alias("leaks")).select(F.lit(name).alias("check"), "leaks")
        out = row if out is None else out.unionByName(row)
    return out
