"""Serving by learnt patterns: the first pattern that holds, similar texts, caches from snapshots and in streams, late outcomes, recognition results."""

import functools

from pyspark.sql import functions as F

from ..operators import similarity_join as J
from ..session import keeper, workspace
from ..streaming import dedupe, feedback, pattern_state, replay
from .base import query, turn_log
from .match_queries import _P, _patterns
from .stream_queries import SEMANTIC_OUT, embedding_turns, make_semantic

_UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


@query(
    f"WITH {_P}, t AS (SELECT vec_id AS turn, label, {_UNIT.format(v='v')} AS v FROM v), c AS (SELECT label, g, {_UNIT.format(v='c')} AS c, 1.0 / (1 + g % 4) AS reliability FROM p), "
    "s AS (SELECT turn, g, list_dot_product(v, c) AS x, reliability FROM t JOIN c USING (label) WHERE (turn + g) % 5 = 0), b AS (SELECT turn, g, x FROM s WHERE x >= 0.1 QUALIFY row_number() OVER (PARTITION BY turn ORDER BY x DESC, reliability DESC, g) = 1), "
    "n AS (SELECT label, count(*) AS n FROM c GROUP BY label) SELECT turn, g AS pattern, round(x, 6) AS cosine, true AS compared_some, coalesce(n, 0) AS in_state FROM t LEFT JOIN b USING (turn) LEFT JOIN n USING (label)"
)
def first_valid_pattern(read):
    """Each turn's best active pattern of its state by (cosine, reliability, age) whose template holds for the turn; one template in five does."""
    from ..functions.similarity import unit

    e = read("embeddings").select(F.col("vec_id").alias("turn"), F.col("label").alias("state"), unit(F.col("embedding")).alias("vector"))
    valid = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda g: (F.col("turn") + g) % 5 == 0)
    turns = e.withColumn("payload", F.transform(valid, lambda g: F.concat(F.lit("t"), g.cast("string"))))
    g = F.col("g")
    patterns = _patterns(read).select((F.col("label") * 16 + g).alias("pattern"), F.col("label").alias("state"), unit(F.col("c")).alias("centroid"), F.concat(F.lit("t"), g.cast("string")).alias("template"), (1.0 / (1 + g % 4)).alias("reliability"))
    keep = keeper(e.sparkSession, "first-valid")
    found = J.first_valid(turns, keep(patterns, "patterns"), route=0.1, keep=keep)
    return found.select("turn", (F.col("pattern") % 16).alias("pattern"), F.round("cosine", 6).alias("cosine"), ((F.col("compared") > 0) | F.col("pattern").isNull()).alias("compared_some"), "in_state")


_DOCS = "f AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT w, ln((1.0 + n) / (1.0 + count(DISTINCT id))) + 1 AS idf FROM f, n GROUP BY w, n)"


@query(
    f"WITH {_DOCS}, t AS (SELECT id, w, (1 + ln(count(*))) * max(idf) AS x FROM f JOIN idf USING (w) GROUP BY id, w), z AS (SELECT id, w, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM t) "
    "SELECT a.id AS a, b.id AS b, round(sum(a.x * b.x), 6) AS cosine FROM z a JOIN z b ON a.w = b.w AND a.id < b.id GROUP BY ALL HAVING round(sum(a.x * b.x), 6) >= 0.7"
)
def similar_texts(read):
    """Pairs of documents with a TF-IDF cosine of 0.7 or more, by a prefix-filtered join."""
    docs = read("documents")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    pairs = J.similar_texts(texts, docs.count(), 0.7 - 1e-6, keep=keeper(docs.sparkSession, "similar-texts"))
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine")).filter("cosine >= 0.7")


def _halves(read):
    turns = embedding_turns(read)
    middle = turns.agg(F.floor(F.max("position") / 2)).first()[0] or 0
    return turns.filter(F.col("position") <= middle), turns.filter(F.col("position") > middle)


def _shown(out):
    return out.select("cache_id", "position", "source", "pattern", F.round("similarity", 6).alias("similarity"), "active", "candidates")


@query()
def resumed_replay(read):
    """The semantic cache learns half of the turns, is saved as a table of patterns, and goes on from it with the other half."""
    first, second = _halves(read)
    path = workspace(first.sparkSession, "patterns")
    pattern_state.save_patterns(pattern_state.patterns_after(first, make_semantic), path, make_semantic, embedder="table")
    saved = pattern_state.load_patterns(first.sparkSession, path, make_semantic, embedder="table")
    return _shown(pattern_state.resume(second, saved, make_semantic, SEMANTIC_OUT))


@query()
def streamed_replay(read):
    """The other half as a stream, state by pattern, that starts from the saved patterns of the first."""
    first, second = _halves(read)
    spark, path = first.sparkSession, workspace(first.sparkSession, "streamed")
    pattern_state.save_patterns(pattern_state.patterns_after(first, make_semantic), f"{path}/patterns", make_semantic, embedder="table")
    second.repartitionByRange(3, "position").write.parquet(f"{path}/turns")
    # a session of its own: the stream needs another state store, and no more state partitions than there are caches
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "8")
    source = other.readStream.schema(second.schema).parquet(f"{path}/turns")
    saved = pattern_state.load_patterns(other, f"{path}/patterns", make_semantic, embedder="table")
    out = pattern_state.stream_patterns(source, make_semantic, SEMANTIC_OUT, initial=saved)
    out.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return _shown(spark.read.schema(out.schema).parquet(f"{path}/out"))


HOUR = 3_600_000_000


def traces_and_outcomes(read):
    """Clicks as traces, purchases and errors as outcomes of an event a little earlier, which may be no trace, or have an outcome already."""
    e = read("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    traces = e.filter("event_type = 'click'").select(F.col("event_id").cast("string").alias("trace_id"), "at")
    target = (F.col("event_id") - (F.col("event_id") * 7) % 50).cast("string")
    outcomes = e.filter("event_type IN ('purchase', 'error')").select(F.col("event_id").alias("outcome_id"), target.alias("trace_id"), "at", (F.col("event_type") == "purchase").alias("success"))
    return traces, outcomes


@query(
    f"WITH t AS (SELECT event_id AS trace_id, epoch_us(ts) AS made FROM events WHERE event_type = 'click'), f AS (SELECT event_id AS outcome_id, event_id - (event_id * 7) % 50 AS trace_id, epoch_us(ts) AS happened, event_type = 'purchase' AS success FROM events WHERE event_type IN ('purchase', 'error')), "
    f"j AS (SELECT f.*, made, coalesce(sum(CAST(happened <= made + {HOUR} AS INT)) OVER (PARTITION BY f.trace_id ORDER BY happened, outcome_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f LEFT JOIN t ON t.trace_id = f.trace_id AND made <= happened), "
    f"r AS (SELECT *, CASE WHEN made IS NULL OR happened > made + 2 * {HOUR} THEN 'unknown' WHEN before > 0 THEN 'repeated' WHEN happened > made + {HOUR} THEN 'expired' END AS reason FROM j) SELECT outcome_id, CAST(trace_id AS VARCHAR) AS trace_id, success, reason, reason IS NULL AS accepted FROM r"
)
def trace_feedback(read):
    """Outcomes of remembered traces, accepted once within an hour, with the reason of each that isn't."""
    traces, outcomes = traces_and_outcomes(read)
    return feedback.feedback_outcomes(traces, outcomes, ttl=HOUR, grace=HOUR).select("outcome_id", "trace_id", "success", "reason", "accepted")


def ledger_rows(read):
    traces, outcomes = traces_and_outcomes(read)
    none = F.lit(None)
    rows = traces.select("trace_id", "at", F.lit("trace").alias("kind"), none.cast("long").alias("outcome_id"), none.cast("boolean").alias("success")).unionByName(outcomes.withColumn("kind", F.lit("feedback")))
    # ten caches; a trace and its outcomes are of one
    keyed = feedback.ranked(rows).withColumn("cache_id", F.pmod(F.xxhash64("trace_id"), F.lit(10)))
    return keyed.withColumn("place", F.struct("at", "trace_first", F.coalesce("outcome_id", F.lit(-1).cast("long")).alias("o"), "trace_id"))


make_ledger = functools.partial(feedback.LedgerRows, ttl=HOUR, grace=HOUR, capacity=3)


@query()
def trace_ledger(read):
    """The same by the machine of each cache, which remembers three traces at most."""
    out = replay.replay(ledger_rows(read), make_ledger, f"cache_id long, {feedback.OUTPUT}", order="place")
    return out.filter("kind = 'feedback'").drop("kind")


def recognition_results(read):
    """(position, utterance_id, is_final, text): events as results; an id is heard again within thousands of results."""
    log = turn_log(read)
    said = F.concat_ws("/", F.pmod(F.col("user_id"), F.lit(40)).cast("string"), "category", F.rint("value").cast("int").cast("string"))
    return log.select("position", said.alias("utterance_id"), (F.col("category") != "error").alias("is_final"), F.when(F.col("value") > 1, "x").otherwise(" ").alias("text"))


@query()
def recent_results(read):
    """Final results with a text, each id once among the last 1000 accepted ones."""
    results = recognition_results(read).filter(dedupe.is_result(F.col("is_final"), F.col("text")))
    return dedupe.dedupe_recent(results).select("position", "utterance_id")
