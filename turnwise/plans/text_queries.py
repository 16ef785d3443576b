"""Text functions over requests, conversations and items."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import matching as M
from ..operators.ordering import position
from .base import I, U, inventory, query, spread_utterances, task_count, utterances

_NUM = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.NUMBER_WORDS.items()) + "}"
_CARD = "map {" + ", ".join(f"'{k}': {v}" for k, v in T.CARDINALS.items()) + "}"
_ORD = "map {" + ", ".join(f"'{k}': {v}" for k, v in T.ORDINALS.items()) + "}"
_TOK3 = f"list_transform(raw, lambda w, n: CASE WHEN n > 1 AND raw[n - 1] IN ('drawer', 'door', 'draw') AND map_contains({_NUM}, w) THEN {_NUM}[w] ELSE w END)"
_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def _turns(read):
    return read("conversations").select("conv_id", "turn", "text")


@query(f"SELECT conv_id, turn, {_NORMAL} AS normal FROM conversations")
def normal_text(read):
    """Lower case and collapsed white space."""
    return _turns(read).select("conv_id", "turn", T.normal_text("text").alias("normal"))


@query(f"WITH {U}, r AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS raw FROM u) SELECT id, array_to_string({_TOK3}, ' ') AS tokens, len(raw) AS n FROM r")
def tokens_v3(read):
    """Words with number words as digits after a word for drawer."""
    return utterances(read).select("id", F.array_join(T.drawer_tokens("text"), " ").alias("tokens"), F.size(T.words("text")).cast("long").alias("n"))


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM conversations")
def tokens_v1(read):
    """ASCII words."""
    return _turns(read).select("conv_id", "turn", F.array_join(T.words("text"), " ").alias("tokens"))


@query(r"SELECT conv_id, turn, len(w) AS n, array_to_string(w, '|') AS tokens FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') AS w FROM conversations)")
def tokens_unicode(read):
    """T4: words of letters and digits of any script, with inner apostrophes and hyphens."""
    w = T.unicode_tokens("text")
    return _turns(read).select("conv_id", "turn", F.size(w).cast("long").alias("n"), F.array_join(w, "|").alias("tokens"))


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM conversations")
def norm_alnum(read):
    """T5: letters and digits only."""
    return _turns(read).select("conv_id", "turn", T.norm_alnum("text").alias("norm"))


@query(
    f"WITH {U}, r AS (SELECT id, regexp_extract_all(regexp_replace(regexp_replace(lower('[noise] ' || text), '\\[[^\\]]*\\]', ' ', 'g'), '\\bdoor\\b', 'drawer', 'g'), '<item>|[a-z0-9]+') AS raw FROM u) "
    "SELECT id, array_to_string(list_transform(raw, lambda w: CASE w WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5' WHEN 'six' THEN '6' WHEN 'too' THEN '2' WHEN 'to' THEN '2' ELSE w END), ' ') AS tokens FROM r"
)
def source_words(read):
    """Tags dropped, door as drawer, number words and homophones as digits."""
    return utterances(read).select("id", F.array_join(T.source_words(F.concat(F.lit("[noise] "), "text")), " ").alias("tokens"))


@query(
    "WITH p AS (SELECT p_partkey AS item_id, p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN ' assembly' ELSE ' supplies' END AS phrase FROM part), "
    "l AS (SELECT *, string_split(phrase, ' ')[-1] AS w FROM p), v AS (SELECT *, left(phrase, len(phrase) - len(w)) || CASE WHEN w LIKE '%ies' AND len(w) > 3 THEN left(w, len(w) - 3) || 'y' "
    "WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND len(w) > 1 THEN left(w, len(w) - 1) WHEN w LIKE '%y' AND len(w) > 1 AND w[-2] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(w, len(w) - 1) || 'ies' ELSE w || 's' END AS other FROM l) "
    "SELECT item_id, phrase, other FROM v"
)
def number_variants(read):
    """The other number of a phrase."""
    k = F.col("p_partkey") % 4
    phrase = F.concat("p_name", F.when(k == 0, "").when(k == 1, "s").when(k == 2, " assembly").otherwise(" supplies"))
    return read("part").select(F.col("p_partkey").alias("item_id"), phrase.alias("phrase"), F.element_at(T.number_variants(phrase), 2).alias("other"))


@query(f"WITH {U} SELECT id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' ' || 'drawer two' || ' ') AS has_drawer_two, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' red ') AS has_red FROM u")
def phrase_contains(read):
    """A phrase's words next to each other."""
    w = T.words("text")
    return utterances(read).select("id", T.contains_phrase(w, F.lit("drawer two")).alias("has_drawer_two"), T.contains_phrase(w, F.lit("red")).alias("has_red"))


@query(
    f"WITH {U}, n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part), "
    "h AS (SELECT id, name FROM u JOIN n ON contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' ' || name || ' ')) "
    "SELECT id, name AS candidate FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(name) DESC, name) = 1"
)
def longest_candidate(read):
    """The longest name in a text, found by joining its grams of as many words as some name has with the names."""
    part = read("part")
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.split("p_name", " ")[1])).distinct()
    grams = utterances(read).select("id", F.explode(F.array_distinct(M.grams(T.words("text"), M.word_counts(names)))).alias("name"))
    best = Window.partitionBy("id").orderBy(F.desc(F.length("name")), "name")
    # the grams look as small as the table that they are made from, so the optimizer would send them to all tasks
    return grams.hint("merge").join(names, "name").withColumn("r", F.row_number().over(best)).filter("r = 1").select("id", F.col("name").alias("candidate"))


@query(
    f"WITH {U}, s AS (SELECT id, unnest(regexp_extract_all(text || ' {{item}} <slot>', '\\S+')) AS token FROM u) "
    "SELECT id, token, CASE WHEN regexp_matches(token, '^[{<][a-z_]+[}>]$') THEN 'S:' || regexp_extract(token, '[a-z_]+') ELSE 'L:' || lower(token) END AS symbol, count(*) AS n FROM s GROUP BY ALL"
)
def slot_symbols(read):
    """Slots and literals of a pattern."""
    t = spread_utterances(read).select("id", F.explode(F.regexp_extract_all(F.concat("text", F.lit(" {item} <slot>")), F.lit(r"\S+"), F.lit(0))).alias("token"))
    symbol = F.when(F.col("token").rlike("^[{<][a-z_]+[}>]$"), F.concat(F.lit("S:"), F.regexp_extract("token", "[a-z_]+", 0))).otherwise(F.concat(F.lit("L:"), F.lower("token")))
    return t.groupBy("id", "token", symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {U}, x AS (SELECT id, regexp_extract_all(lower(text || ' second drawer, drawer 7'), '\\bdrawer\\s+(one|two|three|four|five|six|[0-9]+)\\b', 1) AS a, regexp_extract_all(lower(text || ' second drawer, drawer 7'), '\\b(first|second|third|fourth|fifth|sixth)\\s+drawer\\b', 1) AS b FROM u) "
    f"SELECT id, array_to_string(list_concat(list_transform(a, lambda w: coalesce({_CARD}[w], TRY_CAST(w AS INT))), list_transform(b, lambda w: {_ORD}[w])), ',') AS drawers FROM x"
)
def drawer_mentions(read):
    """Drawer numbers in a text."""
    m = T.drawer_mentions(F.concat("text", F.lit(" second drawer, drawer 7")))
    return utterances(read).select("id", F.array_join(F.transform(m, lambda x: x.cast("string")), ",").alias("drawers"))


@query(
    f"WITH {I}, {U}, d AS (SELECT i.*, u.text, TRY_CAST(regexp_extract(drawer, '[0-9]+') AS INT) AS want, CASE WHEN contains(lower(text), 'drawer two') THEN 2 WHEN contains(lower(text), 'drawer four') THEN 4 END AS said, contains(lower(text), name) AS same FROM i JOIN u ON u.id = item_id) "
    "SELECT item_id, CASE WHEN drawer IS NULL THEN 'unverifiable' WHEN NOT same AND said IS NULL THEN 'missing_item' WHEN NOT same THEN 'wrong_item' WHEN said IS NULL THEN 'same_item_no_drawer' WHEN said = want THEN 'correct' ELSE 'wrong_drawer' END AS relation FROM d"
)
def drawer_relation(read):
    """What a reply says about the requested item's place."""
    d = inventory(read).join(utterances(read).withColumnRenamed("id", "item_id").drop("setting"), "item_id")
    t = F.lower("text")
    said = F.when(t.contains("drawer two"), 2).when(t.contains("drawer four"), 4)
    same, want = t.contains(F.col("name")), F.regexp_extract("drawer", "[0-9]+", 0).try_cast("int")
    relation = F.when(F.col("drawer").isNull(), "unverifiable").when(~same & said.isNull(), "missing_item").when(~same, "wrong_item").when(said.isNull(), "same_item_no_drawer").when(said == want, "correct").otherwise("wrong_drawer")
    return d.select("item_id", relation.alias("relation"))


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'missing' WHEN v <= 1000 THEN '<=1000' WHEN v <= 3000 THEN '<=3000' WHEN v <= 7000 THEN '<=7000' WHEN v <= 15000 THEN '<=15000' ELSE '>15000' END AS bucket FROM (SELECT event_id, value * 100 AS v FROM events)")
def timing_bucket(read):
    """Latency classes with closed upper edges."""
    ms = F.when(F.col("event_id") % 50 != 0, F.col("value") * 100)
    return read("events").select("event_id", T.timing_bucket(ms).alias("bucket"))


@query(
    """SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS digest FROM conversations"""
)
def canonical_hash(read):
    """SHA-256 of compact JSON with sorted keys and nulls kept."""
    return read("conversations").select("conv_id", "turn", F.sha2(F.to_json(F.struct("conv_id", "role", "turn"), {"ignoreNullFields": "false"}), 256).alias("digest"))


_KEY = b"turnwise-key"
_OUTER, _INNER = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x5C, 0x36))


@query(
    f"SELECT conv_id, turn, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(text)))) AS key FROM conversations"
)
def hmac_key(read):
    """Keyed digests from built-in SHA-256."""
    return _turns(read).select("conv_id", "turn", T.hmac_sha256(_KEY, F.col("text")).alias("key"))


@query("""SELECT n_nationkey, sha256('{"adapter":null,"model":"' || n_name || '","schema":"' || n_regionkey || '"}') AS namespace FROM nation""")
def namespace_digest(read):
    """One digest for everything that makes cached decisions incomparable."""
    s = F.struct(F.lit(None).cast("string").alias("adapter"), F.col("n_name").alias("model"), F.col("n_regionkey").cast("string").alias("schema"))
    return read("nation").select("n_nationkey", F.sha2(F.to_json(s, {"ignoreNullFields": "false"}), 256).alias("namespace"))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(r, '^[a-z][a-z0-9_:.-]{0,63}$') THEN r ELSE 'external_failure:' || left(sha256(r), 12) END AS code FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END AS r FROM part)")
def reason_code(read):
    """Safe reason codes; others become a digest."""
    r = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return read("part").select(F.col("p_partkey").alias("id"), F.when(r.rlike("^[a-z][a-z0-9_:.-]{0,63}$"), r).otherwise(F.concat(F.lit("external_failure:"), F.substring(F.sha2(r, 256), 1, 12))).alias("code"))


@query(
    "WITH w AS (SELECT p_partkey AS id, p_name AS text, list_filter(string_split(p_name, ' '), lambda x: len(x) >= 5)[-1] AS w FROM part), o AS (SELECT *, 2 + id % (len(w) - 3) AS k FROM w) "
    "SELECT id, CASE WHEN w IS NULL THEN text ELSE replace(text, w, left(w, k - 1) || w[k + 1] || w[k] || substr(w, k + 2)) END AS noisy FROM o"
)
def text_noise(read):
    """Two inner letters of the last long word swapped, at a place that the id gives."""
    d = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.try_element_at(F.filter(F.split("p_name", " "), lambda x: F.length(x) >= 5), F.lit(-1)).alias("w"))
    k = (2 + F.col("id") % (F.length("w") - 3)).cast("int")
    at = lambda i, n: F.substring("w", i, n)
    swapped = F.concat(at(F.lit(1), k - 1), at(k + 1, F.lit(1)), at(k, F.lit(1)), at(k + 2, F.length("w")))
    return d.select("id", F.when(F.col("w").isNull(), F.col("text")).otherwise(F.replace("text", F.col("w"), swapped)).alias("noisy"))


@query(f"WITH {U}, {I} SELECT id, replace(lower(text), name, '<item>') AS frame FROM u JOIN i ON id = item_id")
def masking_frame(read):
    """A request with its item masked."""
    return utterances(read).join(inventory(read), F.col("id") == F.col("item_id")).select("id", F.replace(F.lower("text"), F.col("name"), F.lit("<item>")).alias("frame"))


@query()
def sequence_ratio(read):
    """The sequence ratio of each request and its item's name."""
    return utterances(read).join(inventory(read), F.col("id") == F.col("item_id")).select("id", F.round(S.sequence_ratio("name", F.lower("text")), 9).alias("ratio"))


def _placed(read):
    return position(inventory(read), [F.floor(F.col("item_id") / 10_000)], ["item_id"], "place")


@query()
def surface_similarity(read):
    """Sequence ratio and word overlap of items next to each other in the order of their ids, gaps or not."""
    a, b = _placed(read).alias("a"), _placed(read).alias("b")
    return a.join(b, F.col("a.place") + 1 == F.col("b.place")).select(F.col("a.item_id").alias("item_id"), F.round(S.surface_similarity(F.col("a.name"), F.col("b.name")), 9).alias("similarity"))


@query(
    f"WITH {I}, j AS (SELECT item_id, string_split(name, ' ') AS x, string_split(lead(name) OVER (ORDER BY item_id), ' ') AS y FROM i QUALIFY lead(item_id) OVER (ORDER BY item_id) IS NOT NULL) "
    "SELECT item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM j"
)
def jaccard_tokens(read):
    """The word part of T21."""
    a, b = _placed(read).alias("a"), _placed(read).alias("b")
    return a.join(b, F.col("a.place") + 1 == F.col("b.place")).select(F.col("a.item_id").alias("item_id"), F.round(S.jaccard(F.split("a.name", " "), F.split("b.name", " ")), 6).alias("jaccard"))


@query(
    f"WITH {U} SELECT id, 'choose one action for: ' || text || chr(10) || array_to_string(list_transform(['locate', 'clarify', 'not_found'], lambda a, n: chr(64 + CAST(n AS INT)) || ') ' || a), chr(10)) AS prompt FROM u"
)
def prompt_construction(read):
    """A prompt with lettered choices."""
    letters = F.array_join(F.transform(F.array(*map(F.lit, ("locate", "clarify", "not_found"))), lambda a, n: F.concat(F.chr(n + 65), F.lit(") "), a)), "\n")
    return utterances(read).select("id", F.concat(F.lit("choose one action for: "), "text", F.lit("\n"), letters).alias("prompt"))


_CUES = " OR ".join(f"contains(n, '{c.replace(chr(39), chr(39) * 2)}')" for c in T.CORRECTION_CUES)


@query(f"WITH {U}, t AS (SELECT id, {_NORMAL} AS n FROM u) SELECT id, {_CUES} AS correction FROM t")
def correction_cue(read):
    """Phrases that correct a reply."""
    return utterances(read).select("id", T.is_correction("text").alias("correction"))


@query(rf"WITH {U} SELECT id, regexp_matches(lower(text), '\b(not there|wrong|can''t find|cannot find|couldn''t find|isn''t there|not in)\b') AS rejected, regexp_matches(trim(lower(text)), '^(thanks( a lot)?|ok(ay)?|yes|no)$') AS followup, list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['no', 'not', 'never']) AS negated FROM u")
def reply_predicates(read):
    """Rejection, follow-up and negation predicates."""
    return utterances(read).select("id", T.rejected("text").alias("rejected"), F.trim(F.lower("text")).rlike("^(thanks( a lot)?|ok(ay)?|yes|no)$").alias("followup"), F.arrays_overlap(T.words("text"), F.array(*map(F.lit, ("no", "not", "never")))).alias("negated"))


@query(f"WITH {U}, t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM u) SELECT id, (list_has_any(w, ['where', 'which', 'find', 'need', 'get']) OR contains(' ' || array_to_string(w, ' ') || ' ', ' is there any ')) AND NOT contains(' ' || array_to_string(w, ' ') || ' ', ' get to ') AS request FROM t")
def inventory_request_pred(read):
    """P10: whether a text looks like a request for an item."""
    w = T.words("text")
    asks = F.arrays_overlap(w, F.array(*map(F.lit, ("where", "which", "find", "need", "get")))) | T.contains_phrase(w, F.lit("is there any"))
    return utterances(read).select("id", (asks & ~T.contains_phrase(w, F.lit("get to"))).alias("request"))


@query(r"WITH n AS (SELECT conv_id, turn, text, regexp_extract_all(text || CASE WHEN conv_id % 3 = 0 THEN ' it is in drawer 4' ELSE '' END, 'drawer ([0-9]+)', 1) AS d FROM conversations) SELECT conv_id, turn, len(d) = 1 AND NOT contains(text, '?') AS states, CASE WHEN len(d) = 1 AND NOT contains(text, '?') THEN CAST(d[1] AS INT) END AS drawer FROM n")
def drawer_statement(read):
    """Statements with exactly one drawer number, not questions."""
    t = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " it is in drawer 4").otherwise(""))
    d = F.regexp_extract_all(t, F.lit("drawer ([0-9]+)"), F.lit(1))
    states = (F.size(d) == 1) & ~F.col("text").contains("?")
    return read("conversations").select("conv_id", "turn", states.alias("states"), F.when(states, F.get(d, F.lit(0)).cast("int")).alias("drawer"))


@query()
def unicode_fold(read):
    """T1 in full: compatibility forms and case folding in Arrow batches."""
    return _turns(read).select("conv_id", "turn", S.nfkc("text").alias("folded"))


@query()
def hash_embedding(read):
    """Signed hash vectors; equal texts are embedded once."""
    u = spread_utterances(read)
    said = u.select(F.col("text").alias("said")).distinct().repartition(task_count(read), "said")
    x = said.select("said", S.hash_embed("said").alias("v"))
    e = x.select("said", F.size("v").alias("dimensions"), F.size(F.filter("v", lambda y: y != 0)).alias("filled"), F.round(S.norm(F.col("v")), 6).alias("norm"))
    return u.join(e, F.col("text").eqNullSafe(F.col("said"))).select("id", "dimensions", "filled", "norm")


@query(
    f"WITH {U}, w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM u), b AS (SELECT id, w, list_transform(range(1, len(w)), lambda k: w[k] || '_' || w[k + 1]) AS b, ' ' || array_to_string(w, ' ') || ' ' AS c FROM w) "
    "SELECT id, len(w) AS n_words, len(b) AS n_bigrams, len(list_distinct(list_transform(range(1, len(c) - 1), lambda k: substr(c, k, 3)))) AS n_trigrams, len(list_distinct(list_transform(range(1, len(c) - 2), lambda k: substr(c, k, 4)))) AS n_fourgrams, len(list_distinct(list_transform(range(1, len(c) - 3), lambda k: substr(c, k, 5)))) AS n_fivegrams, "
    "2 * len(w) + 2 * len(b) + greatest(len(c) - 2, 0) + greatest(len(c) - 3, 0) + greatest(len(c) - 4, 0) AS weight FROM b"
)
def ngram_features(read):
    """Words, neighbouring words (each twice) and character 3- to 5-grams (once): distinct ones, and their weight in all."""
    d = spread_utterances(read).select("id", T.words("text").alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws("_", a, b))
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    n_pairs = F.greatest(F.size(pairs) - 1, F.lit(0))
    grams = {name: F.size(F.array_distinct(S.char_ngrams(line, n))).cast("long").alias(name) for name, n in (("n_trigrams", 3), ("n_fourgrams", 4), ("n_fivegrams", 5))}
    places = sum((F.greatest(F.length(line) - n + 1, F.lit(0)) for n in (3, 4, 5)), F.lit(0))
    weight = (2 * F.size("w") + 2 * n_pairs + places).cast("long").alias("weight")
    return d.select("id", F.size("w").cast("long").alias("n_words"), n_pairs.cast("long").alias("n_bigrams"), *grams.values(), weight)
