"""Stateful replays, lifecycle, heat, feedback and session rules."""

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import automata as A
from ..operators import matching as M
from ..streaming import caches, events, replay
from .base import I, L, U, inventory, query, turn_log, utterances


def embedding_turns(read):
    """Vectors as turns of ten caches: the label is the state, the id modulo 3 the template; one turn in eleven supports no template."""
    e = read("embeddings").filter("embedding IS NOT NULL")
    t = F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string"))
    valid = F.when(F.col("vec_id") % 11 != 0, F.array(t)).otherwise(F.array().cast("array<string>"))
    return e.select((F.col("vec_id") % 10).alias("cache_id"), F.col("vec_id").alias("position"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("state"), F.lit("located").alias("successor"), t.alias("template"), valid.alias("valid"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("vec_id").cast("string").alias("evidence"), (F.col("vec_id") < 20).alias("seed"))


SEMANTIC_OUT = "cache_id long, position long, source string, pattern int, similarity double, active int, candidates int"


def make_semantic() -> caches.SemanticCache:
    return caches.SemanticCache(merge=0.35, route=0.30, admit=0.70)


@query()
def replay_v3(read):
    """The semantic cache over ordered turns."""
    out = replay.replay(embedding_turns(read), make_semantic, SEMANTIC_OUT)
    return out.select("cache_id", "position", "source", "pattern", F.round("similarity", 6).alias("similarity"), "active", "candidates")


def event_turns(read):
    """Events as turns of a lifecycle: exact key by user and value class, typed key by type."""
    return turn_log(read).select(
        (F.col("user_id") % 16).alias("cache_id"),
        "position",
        F.concat_ws("/", F.col("user_id").cast("string"), "category").alias("exact"),
        F.col("category").alias("typed"),
        F.when(F.col("event_id") % 97 == 0, "odd").otherwise(F.col("category")).alias("decision"),
        (F.col("category") == "purchase").alias("risky"),
        F.col("event_id").cast("string").alias("evidence"),
        F.when(F.col("event_id") % 89 == 0, False).alias("success"),
    )


LIFECYCLE_OUT = "cache_id long, position long, source string, decision string, active int, shadow int, quarantined int"


@query()
def lifecycle_v2(read):
    """Candidate, shadow, active, quarantined over the event log, with audits; outcomes reach siblings too."""
    return replay.replay(event_turns(read), functools.partial(caches.Lifecycle, siblings=True), LIFECYCLE_OUT)


@query()
def heat_cache_v1(read):
    """Predict, score, shadow-test, learn, demote."""
    t = turn_log(read).select((F.col("user_id") % 16).alias("cache_id"), "position", F.col("category").alias("key"), F.col("category").alias("surface"), F.col("event_id").cast("string").alias("example"), (F.col("event_id") % 5).cast("string").alias("variant"), F.when(F.col("event_id") % 97 == 0, "odd").otherwise(F.col("category")).alias("decision"), F.coalesce("correct", F.lit(False)).alias("ok"))
    out = replay.replay(t, caches.HeatCache, "cache_id long, position long, source string, promoted int, heat double")
    return out.withColumn("heat", F.round("heat", 6))


@query(f"WITH {L}, s AS (SELECT user_id, position, position - lag(position, 1, position) OVER (PARTITION BY user_id ORDER BY position) AS gap FROM log) SELECT a.user_id, round(sum(pow(0.995, m.last - a.position)), 6) AS heat, count(*) AS hits FROM log a JOIN (SELECT user_id, max(position) AS last FROM log GROUP BY user_id) m ON m.user_id = a.user_id GROUP BY a.user_id")
def heat_decay(read):
    """Decayed heat in closed form, without a state."""
    last = F.max("position").over(Window.partitionBy("user_id"))
    return turn_log(read).withColumn("last", last).groupBy("user_id").agg(F.round(F.sum(F.pow(F.lit(0.995), F.col("last") - F.col("position"))), 6).alias("heat"), F.count(F.lit(1)).alias("hits"))


@query(f"WITH {U}, {I} SELECT id, text = 'Where is the ' || name || '?' AS seeded FROM u JOIN i ON item_id = id")
def exact_seed_rule(read):
    """X11: a lone item in the seeded wording."""
    u = utterances(read).join(inventory(read), F.col("id") == F.col("item_id"))
    return u.select("id", (F.col("text") == F.concat(F.lit("Where is the "), "name", F.lit("?"))).alias("seeded"))


@query("SELECT doc_id FROM documents ORDER BY sha256('sample:' || doc_id), doc_id LIMIT 50")
def consistency_sample(read):
    """A sample to ask again, by the order of a hash."""
    return read("documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@query("WITH e AS (SELECT event_id AS trace_id, user_id, ts, event_type FROM events), f AS (SELECT event_id AS fid, user_id, ts AS fts FROM events WHERE event_type = 'purchase') SELECT trace_id, count(fid) AS outcomes, CAST(epoch_us(min(fts)) AS BIGINT) AS first_outcome FROM e JOIN f ON e.user_id = f.user_id AND fts >= ts AND fts <= ts + INTERVAL 1 DAY AND e.event_type = 'click' GROUP BY trace_id")
def late_feedback(read):
    """Outcomes that arrive within a day of their trace, joined by user and day bins."""
    from ..operators.matching import interval_join

    day = 86_400_000_000
    e = read("events").withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")))
    t = e.filter("event_type = 'click'").select(F.col("event_id").alias("trace_id"), "user_id", F.col("a"), (F.col("a") + day + 1).alias("b"))
    f = e.filter("event_type = 'purchase'").select("user_id", F.col("a").alias("c"), (F.col("a") + 1).alias("d"))
    return interval_join(t, f, "user_id", "a", "b", "c", "d", day).groupBy("trace_id").agg(F.count(F.lit(1)).alias("outcomes"), F.min("c").alias("first_outcome"))


@query("WITH c AS (SELECT *, coalesce(max(CAST(len(text) < 80 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM conversations) SELECT conv_id, turn FROM c WHERE closed = 0")
def session_close_rule(read):
    """No turns after the one that closes a session."""
    return events.open_turns(read("conversations"), key="conv_id", order="turn", closes=F.length("text") < 80).select("conv_id", "turn")


@query("SELECT count(*) AS kept, count(DISTINCT user_id) AS users FROM (SELECT user_id, value FROM events WHERE event_type <> 'error' AND value > 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(value AS INT) ORDER BY event_id) = 1)")
def final_result_dedupe(read):
    """Final results only, each utterance once."""
    e = read("events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.rint("value").cast("int").cast("string")).alias("utterance_id"), "user_id", (F.col("event_type") != "error").alias("is_final"), F.when(F.col("value") > 1, "x").otherwise(" ").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return events.final_results(e).agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("user_id").alias("users"))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(read):
    """Tumbling windows by event time (an extra over the event stream)."""
    w = events.windowed_counts(read("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.unix_seconds("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def fst_compile(read):
    """A minimal automaton of all masked requests: edges with their labels."""
    from .text_queries import masking_frame

    frames = masking_frame(read).groupBy("frame").agg(F.count(F.lit(1)).alias("support"))
    return A.compile_frames(frames)


@query()
def fst_accept(read):
    """The graph of the minimal automaton, line by line."""
    from .text_queries import masking_frame

    frames = masking_frame(read).groupBy("frame").agg(F.count(F.lit(1)).alias("support"))
    return A.dot(A.compile_frames(frames))


@query(f"WITH {U} SELECT id, p AS part, p = 0 AS accepted FROM u, (SELECT unnest([0, 1, 2]) AS p)")
def learned_acceptor(read):
    """A machine learnt by state merging accepts every frame, and neither the frame without its last word nor without its slot."""
    u = utterances(read).select("id", F.concat_ws(" ", F.lit("please"), F.transform(T.words("text"), lambda w: w)).alias("t"), T.words("text").alias("w"))
    frame = F.concat(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), F.array(F.lit("<item>"), F.lit("there")))
    frames = u.select("id", frame.alias("f"))
    edges, accept = A.learn_frames(frames.select(F.array_join("f", " ").alias("frame")))
    forms = F.array(F.col("f"), F.slice("f", F.lit(1), F.size("f") - 1), F.filter("f", lambda w: w != "<item>"))
    walked = frames.select("id", F.posexplode(forms).alias("part", "f"))
    return walked.select("id", "part", M.traverse(F.col("f"), edges, accept)["accepted"].alias("accepted"))


@query(
    "WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), b AS (SELECT conv_id, min(i) FILTER (role <> CASE i % 2 WHEN 0 THEN 'user' ELSE 'assistant' END) AS broken, count(*) AS n FROM c GROUP BY conv_id) "
    "SELECT conv_id, CAST(coalesce(broken, n) AS INT) AS legal_turns, broken IS NULL AND n > 0 AND n % 2 = 0 AS answered FROM b"
)
def dialogue_phases(read):
    """Dialogues walked through the table of legal transitions: how many turns are legal, and whether they end answered."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    c = read("conversations").groupBy("conv_id").agg(roles.alias("roles"))
    walk = M.traverse(F.col("roles"), [(0, "user", 1), (1, "assistant", 2), (2, "user", 1)], {2})
    return c.select("conv_id", (F.size(walk["path"]) - 1).alias("legal_turns"), walk["accepted"].alias("answered"))
