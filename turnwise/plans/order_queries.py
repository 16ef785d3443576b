"""Windows, ordered computations, top-k with ties, set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering as O
from .base import I, L, U, inventory, query, turn_log, utterances


@query(f"WITH {L} SELECT position, round(avg(CAST(hit AS INT)) OVER (ORDER BY position ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS share FROM log")
def rolling_share(read):
    """Share over the last 25 rows."""
    return O.rolling(turn_log(read).select("position", "hit"), F.col("hit").cast("int"), 25, "share").select("position", F.round("share", 6).alias("share"))


@query(f"WITH {L} SELECT position, CASE WHEN position >= 10 THEN round(avg(value) OVER (ORDER BY position ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) END AS mean FROM log")
def rolling_min_periods(read):
    """Rolling mean, null until enough rows."""
    return O.rolling(turn_log(read).select("position", "value"), F.col("value"), 25, "mean", least=10).select("position", F.round("mean", 6).alias("mean"))


@query(f"WITH {L} SELECT position, round(sum(CAST(correct AS INT)) OVER w / nullif(count(correct) OVER w, 0), 6) AS rate FROM log WINDOW w AS (ORDER BY position)")
def cumulative_rate(read):
    """Running rate that skips nulls."""
    known = F.col("correct").cast("int")
    r = O.running(turn_log(read).select("position", "correct"), {"k": known, "n": F.when(known.isNotNull(), 1)})
    return r.select("position", F.round(F.try_divide("k", "n"), 6).alias("rate"))


@query(f"WITH {L} SELECT position, event_id FROM log")
def row_position(read):
    """Positions from 1 in stream order."""
    return turn_log(read).select("position", "event_id")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS user_text, max(turn) FILTER (role = 'user') AS user_turn FROM conversations GROUP BY conv_id")
def latest_user_text(read):
    """The last text of the user."""
    user = F.col("role") == "user"
    return read("conversations").groupBy("conv_id").agg(F.max_by("text", F.when(user, F.col("turn"))).alias("t"), F.max(F.when(user, F.col("turn"))).alias("user_turn")).select("conv_id", F.when(F.col("user_turn").isNotNull(), F.col("t")).alias("user_text"), "user_turn")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_history(read):
    """The last three turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read("conversations").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("conv_id", "turn", "role")


@query(f"WITH {L}, c AS (SELECT user_id, position, sum(CAST(coalesce(correct, false) AS INT)) OVER (PARTITION BY user_id ORDER BY position) AS k FROM log) SELECT user_id, min(position) FILTER (k >= 5) AS promoted_at, count(*) FILTER (k < 5) AS before FROM c GROUP BY user_id")
def first_reach(read):
    """Where a pattern first has five successes, and the rows before."""
    k = F.sum(F.coalesce("correct", F.lit(False)).cast("int")).over(Window.partitionBy("user_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    c = turn_log(read).withColumn("k", k)
    return c.groupBy("user_id").agg(F.min(F.when(F.col("k") >= 5, F.col("position"))).alias("promoted_at"), F.count_if(F.col("k") < 5).alias("before"))


@query(f"WITH {L} SELECT position, last_value(CASE WHEN category = 'signup' THEN event_id END IGNORE NULLS) OVER w AS last_signup, count(*) FILTER (category = 'signup') OVER w AS active FROM log WINDOW w AS (ORDER BY position ROWS UNBOUNDED PRECEDING)")
def asof_flags(read):
    """The state as of each turn."""
    signup = F.when(F.col("category") == "signup", F.col("event_id"))
    return O.running(turn_log(read).select("position", "category", "event_id"), {"active": signup.isNotNull().cast("int")}, {"last_signup": signup}).select("position", "last_signup", "active")


@query(f"WITH {L} SELECT (position - 1) // 500 AS batch, max(position) AS last_position, count(*) AS n FROM log GROUP BY 1")
def batch_ends(read):
    """The last step of each batch."""
    return turn_log(read).groupBy(F.floor((F.col("position") - 1) / 500).alias("batch")).agg(F.max("position").alias("last_position"), F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'user'), -1) AS last_user FROM conversations GROUP BY conv_id) SELECT conv_id, count(turn) AS trailing, string_agg(text, ' ' ORDER BY turn) AS proposal FROM u LEFT JOIN conversations c USING (conv_id) WHERE c.turn > last_user GROUP BY conv_id")
def trailing_turn_collapse(read):
    """Turns after the user's last one as one proposal."""
    c = read("conversations")
    last = F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id")), F.lit(-1))
    tail = c.withColumn("last", last).filter(F.col("turn") > F.col("last"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return tail.groupBy("conv_id").agg(F.count(F.lit(1)).alias("trailing"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("proposal"))


@query(
    f"WITH {L}, t AS (SELECT position, event_id FROM log WHERE category <> 'signup'), s AS (SELECT row_number() OVER (ORDER BY position) - 1 AS k, event_id FROM log WHERE category = 'signup'), n AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM s) AS a), "
    "r AS (SELECT row_number() OVER (ORDER BY position) AS trial, 0 AS sub, 0 AS k, event_id FROM t UNION ALL SELECT greatest(1, (k + 1) * n.t // (n.a + 1)), 1, k, event_id FROM s, n) SELECT row_number() OVER (ORDER BY trial, sub, k) AS place, event_id FROM r"
)
def interleave(read):
    """A second stream spread evenly over the first."""
    log = turn_log(read)
    return O.interleave(log.filter("category <> 'signup'").select("position", "event_id"), log.filter("category = 'signup'").select("position", "event_id")).select("place", "event_id")


@query(f"WITH {L}, r AS (SELECT category, event_id, row_number() OVER (PARTITION BY category ORDER BY event_id) AS rn FROM log) SELECT row_number() OVER (ORDER BY rn, category) AS place, event_id FROM r")
def round_robin(read):
    """One of each stratum in turn, until all are used up."""
    return O.round_robin(turn_log(read).select("category", "event_id"), "category", [F.floor(F.col("event_id") / O.SPAN)], ["event_id"], "place").select("place", "event_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT)) AS place FROM customer")
def participant_order(read):
    """O1: by participant, then trial number."""
    return O.position(read("customer"), [F.col("c_nationkey")], [F.regexp_extract("c_name", "[0-9]+", 0).cast("long")], "place").select("c_custkey", "place")


@query("""SELECT n_nationkey, row_number() OVER (ORDER BY '{"name":"' || n_name || '","region":' || n_regionkey || '}') AS place FROM nation""")
def canonical_sort(read):
    """O2: by canonical JSON, through ranges of its first letters."""
    n = read("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("json"))
    return O.position(n, [F.substring("json", 1, 12)], ["json"], "place").select("n_nationkey", "place")


@query(f"WITH {I} SELECT family, item_id AS first_best, size FROM i QUALIFY row_number() OVER (PARTITION BY family ORDER BY CAST(size AS INT) DESC, item_id) = 1")
def top1_ties(read):
    """O3: the largest, the first inserted of equals."""
    m = F.min(F.struct((-F.col("size").cast("int")).alias("k"), F.col("item_id").alias("first_best"), "size")).alias("m")
    return inventory(read).groupBy("family").agg(m).select("family", "m.first_best", "m.size")


@query(f"WITH {I} SELECT name, item_id, row_number() OVER (PARTITION BY name ORDER BY CAST(size AS INT) DESC, brand, family DESC, setting, item_id) AS place FROM i")
def match_ranking(read):
    """Five keys, mixed directions."""
    w = Window.partitionBy("name").orderBy(F.col("size").cast("int").desc(), "brand", F.desc("family"), "setting", "item_id")
    return inventory(read).select("name", "item_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {L} SELECT position, event_id FROM log ORDER BY position DESC LIMIT 256")
def bounded_log(read):
    """The last 256 entries of a log."""
    return turn_log(read).orderBy(F.desc("position")).limit(256).select("position", "event_id")


@query("SELECT vec_id, CAST(list_position(list_transform(range(1, len(embedding) + 1), lambda k: CASE WHEN k IN (2, 5) THEN -9 ELSE round(CAST(embedding[k] AS DOUBLE), 6) END), list_max(list_transform(range(1, len(embedding) + 1), lambda k: CASE WHEN k IN (2, 5) THEN -9 ELSE round(CAST(embedding[k] AS DOUBLE), 6) END))) AS INT) AS choice FROM embeddings")
def constrained_argmax(read):
    """The best allowed choice, earlier ones first among equals."""
    scores = F.transform("embedding", lambda x, k: F.when(k.isin(1, 4), -9.0).otherwise(F.round(x.cast("double"), 6)))
    return read("embeddings").select("vec_id", F.array_position(scores, F.array_max(scores)).cast("int").alias("choice"))


@query(f"WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY position) AS rn FROM log) SELECT category, count(*) AS timed, round(avg(value), 6) AS mean FROM r WHERE rn > 1 GROUP BY category")
def warmup_exclusion(read):
    """Timing without each task's first call."""
    r = turn_log(read).withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("position"))).filter("rn > 1")
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("timed"), F.round(F.avg("value"), 6).alias("mean"))


_SPLIT = "CASE WHEN h < 'b' THEN 'train' WHEN h < 'd' THEN 'validation' ELSE 'test' END"


@query(f"WITH s AS (SELECT c_custkey, {_SPLIT} AS split FROM (SELECT c_custkey, sha256('s:' || c_custkey) AS h FROM customer)) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM s a JOIN s b ON a.c_custkey = b.c_custkey GROUP BY ALL")
def split_disjoint(read):
    """Splits share no participant: only the diagonal has rows."""
    h = F.sha2(F.concat(F.lit("s:"), F.col("c_custkey").cast("string")), 256)
    s = read("customer").select("c_custkey", F.when(h < "b", "train").when(h < "d", "validation").otherwise("test").alias("split"))
    return s.withColumnRenamed("split", "a").join(s.withColumnRenamed("split", "b"), "c_custkey").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(read):
    """Positives without negatives."""
    o = read("orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")).subtract(o.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_sources(read):
    """Sources under one schema."""
    c = read("customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(read("supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query(f"WITH {U}, w AS (SELECT id, regexp_extract_all(lower(text || ' ' || text || ' again the'), '[a-z0-9]+') AS w FROM u) SELECT id, array_to_string(list_filter(w, lambda x, k: list_position(w, x) = k), ' ') AS distinct_words FROM w")
def distinct_ordered(read):
    """U4: distinct values in order of first occurrence."""
    w = F.regexp_extract_all(F.lower(F.concat("text", F.lit(" "), "text", F.lit(" again the"))), F.lit("[a-z0-9]+"), F.lit(0))
    return utterances(read).select("id", F.array_join(F.array_distinct(w), " ").alias("distinct_words"))


@query("WITH k AS (SELECT sha256(text) AS fingerprint, doc_id FROM documents) SELECT fingerprint, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY fingerprint HAVING count(*) > 1")
def dup_inputs(read):
    """Inputs that occur more than once."""
    k = read("documents").select(F.sha2("text", 256).alias("fingerprint"), "doc_id")
    return k.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'A' AND l_quantity > 49)")
def missing_reference(read):
    """Reference rows without a match."""
    return read("supplier").join(read("lineitem").filter("l_returnflag = 'A' AND l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("s_suppkey")


@query(f"WITH {L} SELECT category, count(*) AS observations, count(DISTINCT user_id) AS evidence, count(DISTINCT user_id) >= 2 AS enough FROM log GROUP BY category")
def evidence_distinct(read):
    """Distinct evidence, exact."""
    return turn_log(read).groupBy("category").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("user_id").alias("evidence"), (F.count_distinct("user_id") >= 2).alias("enough"))
