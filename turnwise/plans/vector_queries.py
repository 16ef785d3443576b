"""Feature vectors in full, decisions from a cache with two levels of keys, and the library's functions in SQL."""

from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import similarity as S
from ..functions import sql
from ..functions import text as T
from ..operators import dialogue
from .base import I, inventory, query
from .rule_queries import ACTION_SQL, CASES_SQL, V3_SQL, cases, items

_GRAMS = " UNION ALL ".join(f"SELECT name, 'c{n}:' || unnest(list_transform(range(1, len(c) - {n - 2}), lambda k: substr(c, k, {n}))) AS f, 1 AS x FROM l" for n in (3, 4, 5))


@query(
    f"WITH {I}, l AS (SELECT DISTINCT name, string_split(name, ' ') AS w, ' ' || name || ' ' AS c FROM i), f AS (SELECT name, 'w:' || unnest(w) AS f, 2 AS x FROM l UNION ALL SELECT name, 'b:' || unnest(list_transform(range(1, len(w)), lambda k: w[k] || '_' || w[k + 1])), 2 FROM l UNION ALL {_GRAMS}), "
    "t AS (SELECT name, f, sum(x) AS x FROM f GROUP BY ALL) SELECT name, f AS feature, round(x / sqrt(sum(x * x) OVER (PARTITION BY name)), 6) AS weight FROM t"
)
def ngram_vectors(read):
    """Unit vectors of names by words and neighbouring words (twice) and character 3- to 5-grams (once)."""
    n = inventory(read).select("name").distinct().withColumn("w", F.split("name", " "))
    line = F.concat(F.lit(" "), F.col("name"), F.lit(" "))
    tagged = lambda a, p, x: F.transform(a, lambda f: F.struct(F.concat(F.lit(p), f).alias("f"), F.lit(x).alias("x")))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat_ws("_", F.get("w", k - 1), F.get("w", k)))).otherwise(F.array().cast("array<string>"))
    every = F.concat(tagged(F.col("w"), "w:", 2), tagged(pairs, "b:", 2), *(tagged(S.char_ngrams(line, k), f"c{k}:", 1) for k in (3, 4, 5)))
    t = n.select("name", F.explode(every).alias("e")).groupBy("name", F.col("e.f").alias("feature")).agg(F.sum("e.x").alias("x"))
    size = t.groupBy("name").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return t.join(size, "name").select("name", "feature", F.round(F.col("x") / F.col("size"), 6).alias("weight"))


@query()
def hash_vectors(read):
    """Signed hash vectors of names, the places that aren't zero."""
    v = inventory(read).select("name").distinct().select("name", F.posexplode(S.hash_embed("name")).alias("place", "value"))
    return v.filter("value <> 0").select("name", "place", F.round("value", 6).alias("value"))


_STATE = "CASE WHEN k IN (12, 13) THEN 'reviewing_proposed_answer' ELSE 'awaiting_request' END"


@query(
    f"WITH {I}, {CASES_SQL}, d AS (SELECT item_id AS id, setting || '|' || text || '|' || coalesce(memory, '') || '|' || coalesce(proposal, '') AS exact, setting || '|' || {V3_SQL} || '|' || {_STATE} AS typed, {ACTION_SQL} AS action FROM c), "
    "e AS (SELECT exact, min(action) AS action FROM d WHERE id % 3 = 0 GROUP BY exact HAVING count(DISTINCT action) = 1), t AS (SELECT typed, min(action) AS action FROM d WHERE id % 3 = 0 GROUP BY typed HAVING count(DISTINCT action) = 1) "
    "SELECT id, CASE WHEN e.action IS NOT NULL THEN 'exact' WHEN t.action IS NOT NULL THEN 'typed' ELSE 'none' END AS level, coalesce(e.action, t.action) AS served, d.action AS teacher, coalesce(e.action, t.action) IS NOT DISTINCT FROM d.action AS agree FROM d LEFT JOIN e USING (exact) LEFT JOIN t USING (typed)"
)
def cached_decisions(read):
    """A third of the checked decisions as a cache, by the digest of the whole payload and by typed wording and state; what it serves to all cases, and whether the teacher agrees."""
    asked = cases(read).withColumn("text", F.col("text"))
    payload = asked.select("id", "setting", F.struct("setting", "text", "memory", "proposal").alias("p")).select("id", "setting", C.digest(F.col("p")).alias("exact"))
    j = dialogue.judge(asked, items(read), wanted=["v3", "action", "signature"]).select("id", "v3", "action", F.get_json_object("signature", "$.state").alias("state"))
    d = payload.join(j, "id").withColumn("typed", F.concat_ws("|", "setting", "v3", "state"))
    stored = d.filter("id % 3 = 0")
    only = lambda k: stored.groupBy(F.col(k).alias(f"{k}_key")).agg(F.min("action").alias(f"{k}_action"), F.count_distinct("action").alias("n")).filter("n = 1").drop("n")
    found = d.join(only("exact"), F.col("exact") == F.col("exact_key"), "left").join(only("typed"), F.col("typed") == F.col("typed_key"), "left")
    served = F.coalesce("exact_action", "typed_action")
    level = F.when(F.col("exact_action").isNotNull(), "exact").when(F.col("typed_action").isNotNull(), "typed").otherwise("none")
    return found.select("id", level.alias("level"), served.alias("served"), F.col("action").alias("teacher"), served.eqNullSafe(F.col("action")).alias("agree"))


@query(
    f"WITH {I}, w AS (SELECT item_id, name, size, regexp_extract_all(lower(name), '[a-z0-9]+') AS w, regexp_extract_all(lower('Red ' || family), '[a-z0-9]+') AS v FROM i) SELECT item_id, '{{\"a\":{{\"n\":' || to_json(name) || '}},\"z\":' || size || '}}' AS json, round((CAST(size AS INT) + 1) / (CAST(size AS INT) + 10 + 2), 6) AS beta, "
    "round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 6) AS jaccard, CAST(2 AS BIGINT) AS turns, upper(name) AS last_said FROM w"
)
def sql_functions(read):
    """The library's functions by name in SQL, a table function among them."""
    raw = F.concat(F.lit('{ "z": '), "size", F.lit(', "a" : '), F.to_json(F.struct(F.col("name").alias("n"))), F.lit("}"))
    said = F.concat(F.lit("Participant: hello\nyou\nROBOT:"), F.upper("name"))
    i = inventory(read).select("item_id", "name", "family", F.col("size").cast("double").alias("size"), raw.alias("raw"), said.alias("dialogue"))
    spark = i.sparkSession
    sql.register(spark)
    shown = spark.sql("SELECT item_id, dialogue, tw_canonical_json(raw) AS json, round(tw_beta(size, size + 10), 6) AS beta, round(tw_jaccard(tw_words(name), tw_words(concat('Red ', family))), 6) AS jaccard FROM {items}", items=i)
    turns = spark.sql("SELECT item_id, count(*) AS turns, max_by(said, turn) AS last_said FROM {items} s, LATERAL tw_turns(s.dialogue) GROUP BY item_id", items=i)
    return shown.drop("dialogue").join(turns, "item_id")
