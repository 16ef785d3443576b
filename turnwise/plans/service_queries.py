"""Keys of payloads, losses, asking again, committed appends and session commands."""

import json

from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import losses
from ..operators import agreement
from ..session import workspace
from ..sources.commits import Commits
from ..streaming import commands, replay
from .base import I, inventory, query

_PAYLOADS = (
    "p AS (SELECT conv_id, '{\"memory\":{\"last\":null,\"n\":' || count(*) || '},\"setting\":\"' || CASE WHEN conv_id % 2 = 0 THEN 'lab' ELSE 'hospital' END || '\",\"turns\":[' || "
    "string_agg('{\"role\":' || to_json(role) || ',\"text\":' || coalesce(to_json(text), 'null') || ',\"turn\":' || turn || '}', ',' ORDER BY turn, role, text) || ']}' AS payload, max(turn) AS last FROM conversations GROUP BY conv_id)"
)


def _payloads(read, turn_fields, fields):
    """(conv_id, last, payload) with the payload's keys in a given order: what a key must not depend on."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(*(x[f].alias(f) for f in turn_fields)))
    c = read("conversations").groupBy("conv_id").agg(turns.alias("turns"), F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    parts = {"turns": F.col("turns"), "setting": F.when(F.col("conv_id") % 2 == 0, "lab").otherwise("hospital"), "memory": F.struct("n", F.lit(None).cast("string").alias("last"))}
    return c.select("conv_id", "last", F.struct(*(parts[f].alias(f) for f in fields)).alias("payload"))


@query(f"WITH {_PAYLOADS} SELECT conv_id, payload, sha256(payload) AS key FROM p")
def canonical_payloads(read):
    """Canonical JSON of nested payloads, and its digest as a strict key."""
    p = _payloads(read, ["turn", "text", "role"], ["turns", "setting", "memory"])
    return p.select("conv_id", C.canonical(F.col("payload")).alias("payload")).withColumn("key", F.sha2("payload", 256))


@query(f"WITH {_PAYLOADS}, k AS (SELECT payload, max(last) AS cached FROM p WHERE conv_id % 3 = 0 GROUP BY payload) SELECT conv_id, cached FROM p LEFT JOIN k USING (payload)")
def payload_lookup(read):
    """Cached answers by the digest of the whole payload, which was written with its keys in another order."""
    asked = _payloads(read, ["turn", "text", "role"], ["turns", "setting", "memory"]).select("conv_id", C.digest(F.col("payload")).alias("key"))
    stored = _payloads(read, ["role", "turn", "text"], ["memory", "turns", "setting"]).filter("conv_id % 3 = 0")
    cache = stored.select(C.digest(F.col("payload")).alias("key"), "last").groupBy("key").agg(F.max("last").alias("cached"))
    return asked.join(cache, "key", "left").select("conv_id", "cached")


@query("""SELECT n_nationkey, sha256('{"adapter_sha256":null,"model":{"id":' || to_json(n_name) || ',"revision":"r' || n_regionkey || '"},"policy":{"audit":0.05,"name":"imitation","thresholds":[8,3,0]},"schema":1e-07}') AS namespace FROM nation""")
def runtime_namespace(read):
    """One digest of a nested description of the model, adapter, policy and schema that a cache belongs to."""
    policy = F.struct(F.array(F.lit(8), F.lit(3), F.lit(0)).alias("thresholds"), F.lit("imitation").alias("name"), F.lit(0.05).alias("audit"))
    model = F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("revision"), F.col("n_name").alias("id"))
    whole = F.struct(policy.alias("policy"), F.lit(1e-7).alias("schema"), model.alias("model"), F.lit(None).cast("string").alias("adapter_sha256"))
    return read("nation").select("n_nationkey", whole.alias("runtime")).select("n_nationkey", C.digest(F.col("runtime")).alias("namespace"))


def _lse(x: str) -> str:
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))))"


@query(
    "WITH l AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: 2000 * CAST(x AS DOUBLE)) AS l, list_distinct([vec_id % 12, (vec_id * 5) % 12]) AS c FROM embeddings), r AS (SELECT *, list_reverse(l) AS r, list_transform(c, lambda i: l[i + 1]) AS o FROM l), "
    f"z AS (SELECT vec_id, l, r, {_lse('l')} AS zl, {_lse('r')} AS zr, {_lse('o')} AS zo FROM r), "
    "k AS (SELECT vec_id, zl, zl - zo AS preference, list_sum(list_transform(list_zip(l, r), lambda p: exp(p[2] - zr) * ((p[2] - zr) - (p[1] - zl)))) AS kl FROM z) "
    "SELECT vec_id, round(zl, 6) AS log_sum_exp, round(preference, 6) AS preference, round(kl, 6) AS kl, round(preference + 0.2 * kl, 6) AS loss FROM k"
)
def recovery_losses(read):
    """M4: log-sum-exp, preference loss, divergence from a reference, and their sum, for logits of any size."""
    logits = F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double") * 2000)
    e = read("embeddings").select("vec_id", logits.alias("l"), F.array(F.col("vec_id") % 12, (F.col("vec_id") * 5) % 12).cast("array<int>").alias("c")).withColumn("r", F.reverse("l"))
    shown = {"log_sum_exp": losses.log_sum_exp(F.col("l")), "preference": losses.preference_loss(F.col("l"), F.col("c")), "kl": losses.kl_divergence(F.col("r"), F.col("l")), "loss": losses.recovery_loss(F.col("l"), F.col("c"), F.col("r"))}
    return e.select("vec_id", *(F.round(c, 6).alias(n) for n, c in shown.items()))


@query("WITH x AS (SELECT label, 5000 * CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, max(x) AS m FROM x GROUP BY label) SELECT x.label AS label, round(max(m) + ln(sum(exp(x - m))), 6) AS log_sum_exp FROM x JOIN m ON m.label = x.label GROUP BY x.label")
def label_log_sum_exp(read):
    """M4: log-sum-exp over the rows of each label, by mergeable states."""
    x = read("embeddings").select("label", F.explode("embedding").alias("x"))
    return losses.log_sum_exp_by(x, ["label"], F.col("x").cast("double") * 5000).select("label", F.round("log_sum_exp", 6).alias("log_sum_exp"))


def ask_again(payload: str) -> str:
    """A teacher that changed its mind on one item in seven, fails on one in eleven, and spells its answers otherwise."""
    item = json.loads(payload)["item"]
    if item["id"] % 11 == 0:
        raise TimeoutError
    return json.dumps({"item": {"name": item["name"], "id": item["id"]}, "action": "recover" if item["id"] % 7 == 0 else "locate"}, indent=1)


def answered(read):
    i = inventory(read)
    payload = F.struct(F.struct("name", F.col("item_id").alias("id")).alias("item"), "setting")
    answer = F.struct(F.lit("locate").alias("action"), F.struct(F.col("item_id").alias("id"), "name").alias("item"))
    return i.select(payload.alias("p"), F.to_json(answer).alias("answer")).select(C.digest(F.col("p")).alias("key"), F.to_json("p").alias("payload"), "answer")


@query(
    f"WITH {I}, k AS (SELECT item_id, sha256('{{\"item\":{{\"id\":' || item_id || ',\"name\":' || to_json(name) || '}},\"setting\":\"' || setting || '\"}}') AS key FROM i), s AS (SELECT item_id FROM k ORDER BY sha256('7:' || key) LIMIT 40) "
    "SELECT round(avg(CASE WHEN item_id % 7 = 0 OR item_id % 11 = 0 THEN 0 ELSE 1 END), 6) AS agreement, count(*) AS asked FROM s"
)
def asked_again(read):
    """A sample of answered payloads asked again: how often the teacher agrees with itself."""
    return agreement.self_consistency(answered(read), ask_again, sample=40).select(F.round("agreement", 6).alias("agreement"), "asked")


@query("WITH r AS (SELECT route, doc_id, row_number() OVER (PARTITION BY route ORDER BY sha256('7:' || doc_id)) AS n FROM (SELECT source AS route, doc_id FROM documents)) SELECT coalesce(route, '') AS route, CAST(doc_id AS VARCHAR) AS doc_id FROM r WHERE n <= 10")
def stratified_sample(read):
    """Ten documents of each source by keyed hash, kept task by task."""
    s = agreement.bottom_k(read("documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id"), "doc_id", 10, group="source")
    return s.select(F.col("group").alias("route"), F.col("key").alias("doc_id"))


@query(f"WITH {I} SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 0 THEN 'first' WHEN item_id % 3 = 0 THEN 'rival' ELSE 'second' END AS run FROM i")
def committed_append(read):
    """A run that dies before its commit leaves nothing; of two writers with common keys each key comes once."""
    i = inventory(read).select(F.col("item_id").cast("string").alias("id"))
    spark = i.sparkSession
    table = Commits(spark, workspace(spark, "committed"), "id string, run string")
    run = lambda name, keep=F.lit(True): i.filter(keep).withColumn("run", F.lit(name))
    n = F.col("id").cast("long")
    table.stage(run("dead"))  # and no commit
    table.append(run("first", n % 2 == 0), "id")
    rival = lambda: table.append(run("rival", n % 3 == 0), "id")
    table.append(run("second"), "id", before_commit=rival)
    return table.read()


def command_lines(read):
    """(session, seq, line): each conversation as the commands of a session, with ratings, resets, replays, recoveries and broken lines among them."""
    c = read("conversations").select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 4).alias("seq"), "role", F.substring("text", 1, 60).alias("text"), F.col("conv_id").alias("c"), "turn")
    cart = F.when(F.col("c") % 5 == 0, F.lit("attic")).when(F.col("c") % 2 == 0, "lab").otherwise("hospital").alias("cart")
    condition = F.element_at(F.array(*map(F.lit, (*commands.CONDITIONS, "none"))), (F.col("turn") % 3 + 1).cast("int")).alias("condition")
    said = F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("message").alias("op"), cart, "text"))).otherwise(F.to_json(F.struct(F.lit("continue").alias("op"), condition)))
    pick = F.pmod(F.xxhash64("session", "seq"), F.lit(9))
    extra = (
        F.when(pick == 0, F.to_json(F.struct(F.lit("rate").alias("op"), condition, F.lit("appropriate").alias("rating"))))
        .when(pick == 1, F.lit('{"op":"reset"}'))
        .when(pick == 2, F.to_json(F.struct(F.lit("replay").alias("op"), F.pmod("c", F.lit(60)).cast("string").alias("case_id"))))
        .when(pick == 3, F.to_json(F.struct(F.lit("recover").alias("op"), cart, F.concat(F.lit("participant: hello\nrobot: hm\nparticipant: "), "text").alias("dialogue"), (F.col("turn") * 1500.0).alias("observed_wait_seconds"))))
        .when(pick == 4, F.lit('{"op":"message"'))
        .when(pick == 5, F.lit('{"op":"dance"}'))
    )
    return c.select("session", "seq", said.alias("line")).unionByName(c.select("session", (F.col("seq") + 1).alias("seq"), extra.alias("line")).filter("line IS NOT NULL"))


def answers_of(rows):
    """What two systems answer: one knows how long the request is, the other repeats it."""
    words = F.size(F.split(F.trim("asked"), r"\s+")).cast("string")
    return rows.withColumn("answers", F.when(F.col("asked").isNotNull(), F.array(F.concat(words, F.lit(" words")), F.upper("asked"))))


def cases_of(read):
    return read("conversations").filter("turn = 0 AND conv_id < 40").select(F.col("conv_id").cast("string").alias("case_id"), F.lit("lab").alias("cart"), F.substring("text", 1, 30).alias("text"))


@query()
def command_log(read):
    """The commands of all sessions, folded in order: what each one did, and why some were refused."""
    rows = commands.parsed(command_lines(read), answers_of, cases_of(read))
    return replay.replay(rows, commands.Session, commands.OUTPUT, key="session", order="seq")
