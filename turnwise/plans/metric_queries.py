"""Counts, rates, agreement, reliability and report tables over turn logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .base import I, L, inventory, query, turn_log, turns


@query(f"WITH {L} SELECT route, category, count(*) AS n FROM log GROUP BY ALL")
def count_by_key(read):
    """A1: counts by keys."""
    return turn_log(read).groupBy("route", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {L} SELECT route, round(avg(CAST(correct AS INT)), 6) AS rate, count(correct) AS judged, count(*) AS n FROM log GROUP BY route")
def rate_nullskip(read):
    """A2: rates over judged rows only."""
    return turn_log(read).groupBy("route").agg(F.round(M.rate("correct"), 6).alias("rate"), F.count("correct").alias("judged"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {L} SELECT CASE WHEN category = 'signup' THEN 'augmented' ELSE 'request' END AS kind, round(avg(CAST(hit AS INT)), 6) AS fsm_share, round(avg(CAST(correct AS INT)) FILTER (hit), 6) AS agreement FROM log GROUP BY ALL")
def rate_by_kind(read):
    """A3-A4: shares by kind, and a rate over a filtered subset."""
    kind = F.when(F.col("category") == "signup", "augmented").otherwise("request").alias("kind")
    return turn_log(read).groupBy(kind).agg(F.round(M.rate("hit"), 6).alias("fsm_share"), F.round(M.rate("correct", F.col("hit")), 6).alias("agreement"))


@query(f"WITH {L}, n AS (SELECT count(*) AS n FROM log) SELECT CASE WHEN position <= n // 3 THEN 1 WHEN position <= 2 * n // 3 THEN 2 ELSE 3 END AS third, count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS share FROM log, (SELECT n AS n FROM n) x GROUP BY 1")
def thirds(read):
    """A5: shares by thirds of the stream with floored bounds."""
    log = turn_log(read)
    t = log.select("hit", "position", F.lit(log.count()).alias("n")).withColumn("third", F.when(F.col("position") <= F.floor(F.col("n") / 3), 1).when(F.col("position") <= F.floor(2 * F.col("n") / 3), 2).otherwise(3))
    return t.groupBy("third").agg(F.count(F.lit(1)).alias("n"), F.round(M.rate("hit"), 6).alias("share"))


@query(f"WITH {L}, b AS (SELECT *, (position - 1) // 1000 AS batch FROM log), m AS (SELECT max(batch) AS last FROM b) SELECT category, round(avg(CAST(hit AS INT)), 6) AS last_share, round(quantile_cont(value, 0.5), 6) AS median_value FROM b, m WHERE batch = last GROUP BY category")
def final_batch(read):
    """The last batch alone."""
    b = turn_log(read).withColumn("batch", F.floor((F.col("position") - 1) / 1000))
    newest = b.agg(F.max("batch").alias("batch"))
    return b.join(F.broadcast(newest), "batch").groupBy("category").agg(F.round(M.rate("hit"), 6).alias("last_share"), F.round(F.percentile("value", 0.5), 6).alias("median_value"))


@query(f"WITH {L}, p AS (SELECT *, CASE WHEN position <= 5000 THEN 'warm-up' ELSE 'steady' END AS phase FROM log) SELECT phase, route, count(*) AS rows, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.95), 6) AS p95 FROM p GROUP BY GROUPING SETS ((phase, route), (phase), (route))")
def group_report(read):
    """One report by phase, route and both."""
    p = turn_log(read).withColumn("phase", F.when(F.col("position") <= 5000, "warm-up").otherwise("steady"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.round(M.rate("correct"), 6).alias("accuracy"), F.round(F.percentile("value", 0.5), 6).alias("median_value"), F.round(F.percentile("value", 0.95), 6).alias("p95")]
    return p.groupingSets([[F.col("phase"), F.col("route")], [F.col("phase")], [F.col("route")]], F.col("phase"), F.col("route")).agg(*aggs)


@query(f"WITH {L} SELECT category, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM log GROUP BY category")
def percentile_p50_p95(read):
    """Exact percentiles with linear interpolation, by narrowing the range of each wanted rank."""
    p = M.exact_percentiles(turn_log(read), "category", F.col("value"), [0.5, 0.95])
    of = lambda q: F.round(F.max(F.when(F.col("share") == q, F.col("percentile"))), 6).alias(f"p{int(q * 100)}")
    return p.groupBy("category").agg(of(0.5), of(0.95))


@query(f"WITH {L}, h AS (SELECT category, user_id % 8 AS strategy, count(*) AS n FROM log WHERE NOT hit GROUP BY ALL) SELECT category, sum(n)::BIGINT AS total, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share, count(*) AS strategies FROM h GROUP BY category")
def strategy_histogram(read):
    """Histograms of strategies and the largest share."""
    h = turn_log(read).filter(~F.col("hit")).groupBy("category", (F.col("user_id") % 8).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("category").agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.count(F.lit(1)).alias("strategies"))


_DRAW = "CAST('0x' || left(md5(r || ':' || k), 8) AS BIGINT) % n"


@query(
    f"WITH {L}, c AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u, sum(CAST(correct AS INT))::DOUBLE AS s, count(correct) AS m FROM log GROUP BY user_id), t AS (SELECT count(*) AS n FROM c), d AS (SELECT r, {_DRAW} AS u FROM range(1, 1001) a(r), (SELECT u AS k FROM c), t), "
    "m AS (SELECT r, sum(s) / sum(m) AS m FROM d JOIN c USING (u) GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS resamples FROM m"
)
def clustered_bootstrap(read):
    """A10: confidence limits from 1,000 resamples of all participants; draws come from a hash, so reruns agree."""
    return M.clustered_bootstrap(turns(read).select(F.col("user_id").alias("u"), "correct"))


_CM = "c AS (SELECT toxic AS gold, CAST(n_chars % 5 = 0 OR quality = 0 AS INT) AS pred FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_CM}, k AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (gold = pred) AS tp FROM c GROUP BY gold), p AS (SELECT pred AS label, count(*) AS predicted FROM c GROUP BY pred) SELECT label, support, coalesce(predicted, 0) AS predicted, tp, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (support + coalesce(predicted, 0)), 6) AS f1 FROM k LEFT JOIN p USING (label)")
def confusion_f1(read):
    """Precision, recall and F1 by label."""
    d = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")
    return M.label_scores(d.select(F.col("toxic").alias("gold"), ((F.col("n_chars") % 5 == 0) | (F.col("quality") == 0)).cast("int").alias("pred")))


@query(f"WITH {_CM}, k AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (gold = pred) AS tp FROM c GROUP BY gold), p AS (SELECT pred AS label, count(*) AS predicted FROM c GROUP BY pred) SELECT round(avg(2 * tp / (support + coalesce(predicted, 0))), 6) AS macro_f1, count(*) AS labels FROM k LEFT JOIN p USING (label)")
def macro_f1(read):
    """Mean F1 over observed gold labels only."""
    d = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")
    s = M.label_scores(d.select(F.col("toxic").alias("gold"), ((F.col("n_chars") % 5 == 0) | (F.col("quality") == 0)).cast("int").alias("pred")), digits=None)
    return s.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


@query(f"WITH {L} SELECT category, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM log GROUP BY category")
def distinct_counts(read):
    """Exact distinct counts."""
    return turn_log(read).groupBy("category").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query(f"WITH {I} SELECT name, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, array_to_string(list_sort(list(DISTINCT brand)), ',') AS brands FROM i GROUP BY name")
def sorted_sets(read):
    """Sorted sets of values."""
    s = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return inventory(read).groupBy("name").agg(s("family").alias("families"), s("brand").alias("brands"))


@query(f"WITH {I}, c AS (SELECT family, brand, count(*) AS n FROM i GROUP BY ALL) SELECT family, brand AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, len(brand), brand DESC) = 1")
def mode_tiebreak(read):
    """The most common value; ties go to the shorter, then the larger one."""
    c = inventory(read).groupBy("family", "brand").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("family").orderBy(F.desc("n"), F.length("brand"), F.desc("brand"))
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").select("family", F.col("brand").alias("mode"), "n")


@query(f"WITH {I} SELECT setting, name, count(*) AS rows, count(DISTINCT drawer) AS drawers, CASE WHEN count(DISTINCT drawer) = 1 THEN min(drawer) END AS drawer, CASE count(DISTINCT drawer) WHEN 0 THEN 'unknown' WHEN 1 THEN 'consistent' ELSE 'conflict' END AS status FROM i GROUP BY ALL")
def table_induction_conflict(read):
    """A place for each item where all evidence agrees."""
    g = inventory(read).groupBy("setting", "name").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("drawer").alias("drawers"), F.min("drawer").alias("d"))
    return g.select("setting", "name", "rows", "drawers", F.when(F.col("drawers") == 1, F.col("d")).alias("drawer"), F.when(F.col("drawers") == 0, "unknown").when(F.col("drawers") == 1, "consistent").otherwise("conflict").alias("status"))


@query(f"WITH {I} SELECT name AS pattern, count(*) AS support, count(DISTINCT family) AS intents, count(DISTINCT family) > 1 AS contradictory FROM i GROUP BY name")
def support_contradiction(read):
    """Support of patterns, and those with more than one intent."""
    return inventory(read).groupBy(F.col("name").alias("pattern")).agg(F.count(F.lit(1)).alias("support"), F.count_distinct("family").alias("intents"), (F.count_distinct("family") > 1).alias("contradictory"))


@query(f"WITH {I}, a AS (SELECT family, 'brand' AS key, brand AS value FROM i UNION ALL SELECT family, 'drawer', coalesce(drawer, '?') FROM i) SELECT family, key, count(DISTINCT value) AS values FROM a GROUP BY ALL HAVING count(DISTINCT value) > 1")
def family_disagreement(read):
    """Attributes whose values differ within a family, a missing one counting as a value."""
    i = inventory(read)
    a = i.select("family", F.explode(F.array(F.struct(F.lit("brand").alias("key"), F.col("brand").alias("value")), F.struct(F.lit("drawer").alias("key"), F.coalesce("drawer", F.lit("?")).alias("value")))).alias("x"))
    return a.groupBy("family", F.col("x.key").alias("key")).agg(F.count_distinct("x.value").alias("values")).filter("values > 1")


@query(f"WITH {I} SELECT item_id, count(*) OVER (PARTITION BY family) AS family_size FROM i")
def family_sizes(read):
    """Items of the same family."""
    i = inventory(read)
    return i.select("item_id", "family").join(i.groupBy("family").agg(F.count(F.lit(1)).alias("family_size")), "family").select("item_id", "family_size")


@query(f"WITH {L} SELECT user_id, count(correct) AS n, round((coalesce(sum(CAST(correct AS INT)), 0) + 1) / (count(correct) + 2), 6) AS reliability FROM log GROUP BY user_id")
def beta_reliability(read):
    """(k + 1) / (n + 2)."""
    return turn_log(read).groupBy("user_id").agg(F.count("correct").alias("n"), F.round(M.beta(F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)), F.count("correct")), 6).alias("reliability"))


@query(
    f"WITH {L}, c AS (SELECT category, count(correct)::DOUBLE AS n, sum(CAST(correct AS INT))::DOUBLE AS k FROM log WHERE correct IS NOT NULL GROUP BY category) "
    "SELECT category, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6) AS lower FROM c"
)
def wilson_bound(read):
    """Wilson's lower bound."""
    c = turn_log(read).filter("correct IS NOT NULL").groupBy("category").agg(F.count("correct").cast("double").alias("n"), F.sum(F.col("correct").cast("int")).cast("double").alias("k"))
    return c.select("category", F.round(M.wilson(F.col("k"), F.col("n")), 6).alias("lower"))


@query(f"WITH {L}, c AS (SELECT category, user_id % 8 AS s, count(*) AS n FROM log GROUP BY ALL), a AS (SELECT user_id % 8 AS s, count(*) AS n FROM log GROUP BY 1) SELECT category, s AS choice, n FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, s) = 1 UNION ALL SELECT * FROM (SELECT 'overall', s, n FROM a QUALIFY row_number() OVER (ORDER BY n DESC, s) = 1)")
def prior_baseline(read):
    """The most frequent strategy by type and overall, ties in fixed order."""
    c = turn_log(read).select("category", (F.col("user_id") % 8).alias("s"))
    both = c.unionByName(c.withColumn("category", F.lit("overall"))).groupBy("category", "s").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "s")
    return both.withColumn("r", F.row_number().over(w)).filter("r = 1").select("category", F.col("s").alias("choice"), "n")


@query(f"WITH {L}, g AS (SELECT t FROM range(0, 200, 20) r(t)), s AS (SELECT t, count(*) FILTER (value >= t) AS served, count(*) FILTER (value >= t AND correct) - 3 * count(*) FILTER (value >= t AND NOT correct) AS gain FROM log, g WHERE correct IS NOT NULL GROUP BY t) SELECT t AS threshold, served, gain, row_number() OVER (ORDER BY gain DESC, t) = 1 AS chosen FROM s")
def grid_search(read):
    """A threshold grid, the best gain chosen: rows are counted once by the highest threshold that they reach, and thresholds add up the counts above them."""
    x = turn_log(read).filter("correct IS NOT NULL").select(F.least(F.floor(F.col("value") / 20) * 20, F.lit(180)).alias("t"), "correct")
    by_class = x.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    grid = by_class.sparkSession.range(0, 200, 20).select(F.col("id").alias("threshold"))
    above = grid.join(F.broadcast(by_class), F.col("t") >= F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("served"), F.coalesce(F.sum("right"), F.lit(0)).alias("right"))
    s = above.select("threshold", "served", (F.col("right") - 3 * (F.col("served") - F.col("right"))).alias("gain"))
    return s.select("threshold", "served", "gain", (F.row_number().over(Window.orderBy(F.desc("gain"), "threshold")) == 1).alias("chosen"))


@query(f"WITH {L} SELECT route, round(avg(CAST(hit AND correct AS INT)), 6) AS joint, round(avg(CAST(correct AS INT)), 6) AS item_ok, count(*) FILTER (hit AND NOT correct) AS wrong_drawer FROM log GROUP BY route")
def retrieval_scoring(read):
    """Joint and single correctness."""
    return turn_log(read).groupBy("route").agg(F.round(F.avg((F.col("hit") & F.col("correct")).cast("int")), 6).alias("joint"), F.round(M.rate("correct"), 6).alias("item_ok"), F.count_if(F.col("hit") & ~F.col("correct")).alias("wrong_drawer"))


@query(f"WITH {L} SELECT position, CASE WHEN hit THEN correct END AS served_item_ok, CASE WHEN category = 'error' THEN NULL ELSE value < 100 END AS failure_type_ok FROM log")
def tri_state_checks(read):
    """True, false, or null where a check doesn't apply."""
    return turn_log(read).select("position", F.when(F.col("hit"), F.col("correct")).alias("served_item_ok"), F.when(F.col("category") != "error", F.col("value") < 100).alias("failure_type_ok"))


@query(f"WITH {L}, m AS (SELECT route, avg(CAST(correct AS INT)) AS a FROM log GROUP BY route) SELECT round(max(a) FILTER (route = 'slm'), 6) AS base, round(max(a) FILTER (route = 'fsm'), 6) AS adapted, CASE WHEN max(a) FILTER (route = 'fsm') > max(a) FILTER (route = 'slm') THEN 'adapted' ELSE 'base' END AS chosen FROM m")
def checkpoint_choice(read):
    """The adapted model only if strictly better."""
    m = turn_log(read).groupBy("route").agg(M.rate("correct").alias("a"))
    base, adapted = F.max(F.when(F.col("route") == "slm", F.col("a"))), F.max(F.when(F.col("route") == "fsm", F.col("a")))
    return m.agg(F.round(base, 6).alias("base"), F.round(adapted, 6).alias("adapted"), F.when(adapted > base, "adapted").otherwise("base").alias("chosen"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (len(text) < 100) AS errors, bool_and(len(text) >= 100) AS passed FROM conversations GROUP BY conv_id")
def suite_report(read):
    """A case passes when all its turns do."""
    ok = F.length("text") >= 100
    return read("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(~ok).alias("errors"), F.bool_and(ok).alias("passed"))


@query(f"WITH {L}, m AS (SELECT route, round(avg(CAST(correct AS INT)) * 100, 4) AS accuracy, round(avg(value), 4) AS latency FROM log GROUP BY route), t AS (SELECT route, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT route, 'latency', latency FROM m) SELECT metric, max(v) FILTER (route = 'slm') AS base, max(v) FILTER (route = 'fsm') AS tuned, round(max(v) FILTER (route = 'fsm') - max(v) FILTER (route = 'slm'), 4) AS change FROM t GROUP BY metric")
def metric_pivot(read):
    """Metrics of two models side by side."""
    m = turn_log(read).groupBy("route").agg(F.round(M.rate("correct") * 100, 4).alias("accuracy"), F.round(F.avg("value"), 4).alias("latency"))
    t = m.unpivot("route", ["accuracy", "latency"], "metric", "v").groupBy("metric").pivot("route", ["slm", "fsm"]).agg(F.max("v"))
    return t.select("metric", F.col("slm").alias("base"), F.col("fsm").alias("tuned"), F.round(F.col("fsm") - F.col("slm"), 4).alias("change"))


@query(f"WITH {L} SELECT event_id, round(value * 1000, 3) AS ms FROM log")
def ms_rounding(read):
    """M2: seconds to milliseconds."""
    return turn_log(read).select("event_id", F.round(F.col("value") * 1000, 3).alias("ms"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS z, round(exp(CAST(embedding[1] AS DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS p_first FROM embeddings")
def softmax(read):
    """M4: choice probabilities from logits."""
    logits = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x)
    return read("embeddings").select("vec_id", F.round(z, 6).alias("z"), F.round(logits[0] / z, 6).alias("p_first"))


@query(f"WITH {I} SELECT item_id, (name LIKE 'red%') AND family IN ('SMALL', 'LARGE') AS known_match, array_to_string(list_sort(['brand', 'size', CASE WHEN drawer IS NULL THEN 'no-drawer' ELSE 'drawer' END]), ',') AS keys FROM i")
def map_lookup(read):
    """M3: key sets and all-match over attribute maps."""
    i = inventory(read)
    attrs = F.create_map(F.lit("brand"), "brand", F.lit("size"), "size", F.when(F.col("drawer").isNull(), "no-drawer").otherwise("drawer"), F.coalesce("drawer", F.lit("")))
    match = F.col("name").startswith("red") & F.exists(F.array(F.lit("SMALL"), F.lit("LARGE")), lambda x: x == F.col("family"))
    return i.select("item_id", match.alias("known_match"), F.array_join(F.array_sort(F.map_keys(attrs)), ",").alias("keys"))


@query(f"WITH {I} SELECT family, CAST(sum(CAST(('0x' || left(sha256(item_id || '|' || name || '|' || brand), 12)) AS BIGINT)) AS VARCHAR) AS fingerprint, count(*) AS rows FROM i GROUP BY family")
def fingerprint(read):
    """M7: a digest of a table that any change to a row changes, summed from row digests."""
    return inventory(read).groupBy("family").agg(M.sum_digest(F.concat_ws("|", F.col("item_id").cast("string"), "name", "brand")).alias("fingerprint"), F.count(F.lit(1)).alias("rows"))
