"""Joins of dialogue data: phrases, similarity, intervals, automata."""

from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import similarity as S
from ..functions.text import drawer_tokens, is_correction, words


def phrase_hits(requests: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, n, first) of requests that name items of their setting: how many items, and the three smallest ids.

    An equi-join of the text's n-grams with one row for each phrase, so a name that a third of all items share costs one row.
    """
    named = _named(phrases)
    asked = requests.select("id", "setting", F.explode(F.array_distinct(grams(words("text"), word_counts(phrases)))).alias("name"))
    return asked.join(named, ["setting", "name"]).groupBy("id").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 3).alias("first"))


def phrase_counts(requests: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, n, first) of requests that name items: how many, and the smallest id; one aggregate over the items, which combines before the shuffle."""
    named = phrases.groupBy("setting", "name").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))
    asked = requests.select("id", "setting", F.explode(F.array_distinct(grams(words("text"), word_counts(phrases)))).alias("name"))
    return asked.join(named, ["setting", "name"]).groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _named(phrases: DataFrame) -> DataFrame:
    """(setting, name, n, first): how many items have a name, and the three smallest ids (each task keeps its own three before the shuffle)."""
    w = Window.partitionBy("setting", "name").orderBy("item_id")
    first = phrases.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("setting", "name").agg(F.array_sort(F.collect_list("item_id")).alias("first"))
    return phrases.groupBy("setting", "name").agg(F.count(F.lit(1)).alias("n")).join(first, ["setting", "name"])


def word_counts(phrases: DataFrame) -> list[int]:
    """The numbers of words that the phrases' names have (one aggregate)."""
    return sorted(phrases.agg(F.collect_set(F.size(F.split("name", " ")))).first()[0])


def grams(w: Column, counts: list[int]) -> Column:
    """Runs of as many words as some name has."""

    def of(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(F.array().cast("array<string>"), *(of(n) for n in counts if n > 0))


def outcome(n: Column, name: Column, drawer: Column) -> tuple[Column, Column]:
    """Action and reply by the number of candidates and whether a drawer is on record."""
    action = F.when(n == 0, "OBJECT_MISSING").when(n > 1, "ASK_WHICH_ONE").when(drawer.isNull(), "LOCATION_MISSING").otherwise("RETURN_LOCATION")
    reply = (
        F.when(n == 0, "I could not match that request to the inventory.")
        .when(n > 1, F.concat(F.lit("Which one do you mean? I know "), n.cast("string"), F.lit(" of them.")))
        .when(drawer.isNull(), F.concat(F.lit("I have no place on record for the "), name, F.lit(".")))
        .otherwise(F.concat(F.lit("The "), name, F.lit(" is listed in "), drawer, F.lit(".")))
    )
    return action.alias("action"), reply.alias("reply")


def phrase_table(items: DataFrame) -> DataFrame:
    """(setting, item_id, kind, phrase): names in both numbers, families, attribute values, drawers."""
    part = lambda kind, phrase: items.select("setting", "item_id", F.lit(kind).alias("kind"), phrase.alias("phrase"))
    return (
        part("item", F.col("name"))
        .unionByName(part("item", F.concat("name", F.lit("s"))))
        .unionByName(part("family", F.lower("family")))
        .unionByName(part("attribute", F.lower(F.replace("brand", F.lit("#"), F.lit(" ")))))
        .unionByName(part("drawer", F.col("drawer")).filter(F.col("phrase").isNotNull()))
    )


#: Which kind wins among phrases of the same length.
PRIORITY = ["item", "drawer", "attribute", "family"]


def scan(tokens: list[str], table: dict[tuple, dict[str, list[str]]], longest: int) -> list[tuple[str, list[str]]]:
    """From left to right the longest phrase at each place, then its best kind with all its values; other tokens as words."""
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 0, -1):
            if kinds := table.get(tuple(tokens[i : i + n])):
                kind = next(k for k in PRIORITY if k in kinds)
                out.append((kind, kinds[kind]))
                i += n
                break
        else:
            out.append(("word", [tokens[i]]))
            i += 1
    return out


#: Characters of lists of items that one task of their requests puts together, and writes for all of its requests, at most about.
LIST_CHARS = 1 << 18
TOLD_CHARS = 1 << 31


def typed_features(requests: DataFrame, table: DataFrame, *, largest: int = 1_000_000, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(id, typed, items, ambiguous, correction) of requests: one phrase table for each setting, sent to the tasks with how many values a phrase has, not with the values.

    table: (setting, phrase, kind, value).  It has a few rows for each item of an inventory; over ``largest`` phrases, the runs of words of the requests are joined
    with the phrases instead, and each request is scanned with the phrases that it has.  keep(frame, name): writes a table that is read more than once.

    The items of a name, which may be many, are put together once for all requests that name the same.  Requests come out by what they name: ``items`` grows
    with the square where names are shared, but a task has few of its values, each in a run, so a writer with dictionaries (Parquet) stores each once.
    """
    values = table.select("setting", "phrase", "kind", "value").distinct()
    known = keep(values.groupBy("setting", "phrase", "kind").agg(F.count("value").alias("n")), "known")
    asked = requests.select("id", "setting", drawer_tokens("text").alias("ws"), is_correction("text").alias("correction"))
    many = known.limit(largest + 1).count() > largest
    told = keep(_typed_by_join(asked, known) if many else _typed_by_table(asked, known.collect()), "told")
    return _with_items(told, values.filter((F.col("kind") == "item") & F.col("value").isNotNull()), keep)


_TOLD = T.StructType([T.StructField("typed", T.StringType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("named", T.ArrayType(T.StringType()))])


def _told(ws: list[str], table: dict, longest: int) -> tuple[str, bool, list[str]]:
    surface, named, unsure = [], [], False
    for k, values in scan(ws, table, longest):
        if k == "word":
            surface += values
            continue
        surface.append(f"<{k}>" if len(values) == 1 or k != "item" else "<ambiguous-item>")
        unsure |= len(values) > 1
        named += values[:1] if k == "item" else []
    return " ".join(surface) or "<empty>", unsure, list(dict.fromkeys(named))


def _stands(phrase: str, n: int) -> list[str]:
    """A phrase stands for its values: itself, and a second time if there are several."""
    return [phrase, ""][:n]


def _typed_by_table(asked: DataFrame, known: list) -> DataFrame:
    """(id, setting, typed, ambiguous, named, correction): requests are scanned with the phrases of their setting where they are."""
    rows: dict = defaultdict(lambda: defaultdict(dict))
    for r in known:
        rows[r.setting][tuple(r.phrase.split(" "))][r.kind] = _stands(r.phrase, r.n)
    plain = {s: dict(t) for s, t in rows.items()}
    shared = asked.sparkSession.sparkContext.broadcast((plain, {s: max(map(len, t), default=1) for s, t in plain.items()}))

    @pandas_udf(_TOLD)
    def features(settings: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        tables, longest = shared.value
        return pd.DataFrame([_told(list(ws), tables.get(s, {}), longest.get(s, 1)) for s, ws in zip(settings, tokens, strict=True)], columns=_TOLD.names)

    return asked.select("id", "setting", features("setting", "ws").alias("f"), "correction").select("id", "setting", "f.*", "correction")


def _typed_by_join(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``_typed_by_table`` for any number of phrases: an equi-join by setting and run of words.

    Neither side is sent to all tasks: runs of words look as small as the table that they are made from.
    """
    counts = sorted(known.agg(F.collect_set(F.size(F.split("phrase", " ")))).first()[0])
    met = asked.select("id", "setting", F.explode(F.array_distinct(grams(F.col("ws"), counts))).alias("phrase")).hint("merge").join(known, ["setting", "phrase"])
    own = met.groupBy("id").agg(F.collect_list(F.struct("phrase", "kind", "n")).alias("known"))

    @pandas_udf(_TOLD)
    def features(tokens: pd.Series, known: pd.Series) -> pd.DataFrame:
        out = []
        for ws, found in zip(tokens, known, strict=True):
            table: dict = defaultdict(dict)
            for r in found if found is not None else ():
                table[tuple(r["phrase"].split(" "))][r["kind"]] = _stands(r["phrase"], r["n"])
            out.append(_told(list(ws), table, max(map(len, table), default=1)))
        return pd.DataFrame(out, columns=_TOLD.names)

    return asked.hint("merge").join(own, "id", "left").select("id", "setting", features("ws", "known").alias("f"), "correction").select("id", "setting", "f.*", "correction")


def _with_items(told: DataFrame, items: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The items of what requests name, made once for all that name the same; those requests are brought together, in more tasks if they are very many."""
    per = told.filter(F.size("named") > 0).groupBy("setting", "named").agg(F.count(F.lit(1)).alias("requests"))
    lists = per.select("setting", "named", "requests", F.posexplode("named").alias("at", "phrase")).withColumn("key", F.struct("setting", "phrase"))
    of = items.groupBy(F.struct("setting", "phrase").alias("key")).agg(F.array_sort(F.collect_list("value")).alias("values"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "values")))
    line = F.array_join(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["values"]))), ",")
    whole = keep(lists.hint("merge").join(of, "key").groupBy("setting", "named", "requests").agg(line.alias("items")), "lists")
    chars = F.length("items").cast("long")
    size = whole.agg(F.sum(chars).alias("all"), F.max(chars * F.col("requests")).alias("most")).first()
    salts = -(-(size["most"] or 1) // TOLD_CHARS)
    tasks = max(int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")), salts, min(-(-(size["all"] or 1) // LIST_CHARS) * salts, 10_000))
    key = lambda salt: F.struct("setting", "named", salt.cast("int").alias("salt")).alias("key")
    asked = told.select("*", key(F.pmod(F.xxhash64("id"), F.lit(salts)))).repartition(tasks, "key")
    held = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(key(F.col("salt")), "items")
    return asked.hint("merge").join(held, "key", "left").select("id", "typed", F.coalesce("items", F.lit("")).alias("items"), "ambiguous", "correction")


def narrow(candidates: DataFrame, group: str, says: str, *, name: str, family: str, setting: str, attributes: list[str]) -> DataFrame:
    """``candidates`` with ``score``: all best ones of each group by what its clarification ``says``; those that it names in no way are out."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))
    line = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    said = line(F.col(says))
    worth = lambda c, w: F.when(said.contains(line(c)) & (F.size(words(c)) > 0), w).otherwise(0)
    identity = F.when(said == line(F.col(name)), 1000 + F.size(words(F.col(name)))).otherwise(worth(F.col(name), 100 + F.size(words(F.col(name)))))
    score = identity + worth(F.col(family), 10) + worth(F.col(setting), 30)
    for a in attributes:
        score = score + worth(F.col(a), 20 + F.size(words(F.col(a))))
    scored = candidates.withColumn("score", score).filter("score > 0")
    best = scored.groupBy(group).agg(F.max("score").alias("score"))
    return scored.join(best, [group, "score"])


def interval_join(left: DataFrame, right: DataFrame, key: str, a: str, b: str, c: str, d: str, width: int) -> DataFrame:
    """Pairs with equal key and b > c and a < d, by bins of ``width``: each interval goes to the bins it touches, and a pair is
    kept in the first bin that both touch, so it comes once and a busy key is spread over its bins."""
    bins = lambda x, y: F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))
    lb = left.withColumn("__bin", F.explode(bins(a, b)))
    rb = right.withColumn("__bin", F.explode(bins(c, d)))
    first = F.greatest(F.floor(F.col(a) / width), F.floor(F.col(c) / width))
    return lb.join(rb, [key, "__bin"]).filter((F.col(b) > F.col(c)) & (F.col(a) < F.col(d)) & (F.col("__bin") == first)).drop("__bin")


def subset_join(keys: DataFrame, phrases: DataFrame, *, largest: int = 4_000_000) -> DataFrame:
    """(key, phrase): phrases all of whose words are among a key's words.  keys: (key, words), phrases: (phrase, words), arrays of any length; a phrase without words has none.

    Each phrase is looked for by the rarest of its words among the phrases' own, so a pair is met once, and common words meet nothing.  Phrases of up to ``largest``
    characters in all are sent to the tasks of the keys; more meet them by sorting.  Keys are never sent: their words look as small as the table that they are made from.
    """
    own = phrases.select("phrase", F.array_distinct("words").alias("wanted")).filter(F.size("wanted") > 0)
    often = own.select(F.explode("wanted").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.select("phrase", "wanted", F.explode("wanted").alias("word")).hint("merge").join(often, "word").groupBy("phrase", "wanted").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    asked = keys.select("key", "words", F.explode(F.array_distinct("words")).alias("word"))
    few = (own.agg(F.sum(F.length(F.array_join("wanted", " ")))).first()[0] or 0) <= largest
    met = asked.join(rarest.hint("broadcast"), "word") if few else asked.hint("merge").join(rarest, "word")
    return met.filter(F.size(F.array_except("wanted", "words")) == 0).select("key", "phrase")


def nearest_pattern(turns: DataFrame, patterns: DataFrame, *, threshold: float) -> DataFrame:
    """(turn, pattern, cosine): the best pattern of the turn's state, ties to the smaller id."""
    s = turns.withColumnRenamed("embedding", "x").join(patterns.withColumnRenamed("embedding", "y"), "state")
    s = s.select("turn", "pattern", F.round(S.dot(F.col("x"), F.col("y")), 6).alias("cosine")).filter(F.col("cosine") >= threshold)
    best = s.groupBy("turn").agg(F.min(F.struct((-F.col("cosine")).alias("k"), "pattern")).alias("m"))
    return best.select("turn", F.col("m.pattern").alias("pattern"), (-F.col("m.k")).alias("cosine"))


def sparse_cosine(t: DataFrame, key: str, feature: str, weight: str) -> DataFrame:
    """(a, b, cosine) of all pairs a < b that share a feature."""
    n = t.withColumn("w", F.col(weight) / F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key))))
    a, b = n.select(F.col(key).alias("a"), feature, F.col("w").alias("x")), n.select(F.col(key).alias("b"), feature, F.col("w").alias("y"))
    return a.join(b, feature).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def idf(features: DataFrame, n: int) -> DataFrame:
    return features.groupBy("w").agg((F.log((1.0 + F.lit(n)) / (1.0 + F.count_distinct("id"))) + 1).alias("idf"))


def tfidf(features: DataFrame, weights: DataFrame) -> DataFrame:
    x = features.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n")).join(weights, "w").select("id", "w", ((1 + F.log("n")) * F.col("idf")).alias("x"))
    return x.select("id", "w", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).alias("weight"))


#: A small transducer for requests: (state, symbol, next state); S: symbols take any one word.  State 4 accepts.
EDGES = [(0, "L:where", 1), (1, "L:is", 2), (2, "L:the", 3), (3, "S:item", 4), (0, "L:which", 5), (5, "L:drawer", 6), (6, "L:has", 2), (3, "S:item", 7), (7, "S:item", 4)]


def automaton_paths(tokens: DataFrame, edges=EDGES, accept: int = 4, limit: int = 128) -> DataFrame:
    """(id, paths, slots) for token arrays that the automaton accepts.

    The set of (state, slots) -> number of paths is folded along the array, so nothing is joined and a text of any length (up to
    ``limit`` tokens are matched) takes memory for the states only.
    """
    by_symbol = defaultdict(list)
    for src, symbol, dst in edges:
        by_symbol[symbol].append((src, dst))
    states = sorted({s for e in edges for s in (e[0], e[2])})

    @pandas_udf(T.StructType([T.StructField("paths", T.LongType()), T.StructField("slots", T.IntegerType())]))
    def walk(arrays: pd.Series) -> pd.DataFrame:
        out = []
        for ws in arrays:
            now = {(states[0], 0): 1}
            for w in ws if len(ws) <= limit else []:
                new: dict = defaultdict(int)
                for (s, slots), n in now.items():
                    for symbol, found in by_symbol.items():
                        if symbol == "L:" + w or symbol.startswith("S:"):
                            for src, dst in found:
                                if src == s:
                                    new[dst, slots + symbol.startswith("S:")] += n
                now = new
            ends = {k: n for (s, k), n in now.items() if s == accept}
            out.append((sum(ends.values()), min(ends, default=0)))
        return pd.DataFrame(out, columns=["paths", "slots"])

    return tokens.select("id", walk("w").alias("x")).filter("x.paths > 0").select("id", "x.paths", "x.slots")


#: A transducer whose slots take one or more words: (state, symbol, next state), and the intent of each accepting state.
SLOT_EDGES = [(0, "L:where", 1), (1, "L:is", 2), (2, "L:the", 3), (3, "S:item", 4), (0, "L:which", 5), (5, "L:drawer", 6), (6, "L:has", 2)]
INTENTS = {4: "locate"}


def match_all(ws: list[str], edges: list[tuple], intents: dict[int, str], *, limit: int = 256, longest: int = 128) -> list[tuple[str, dict[str, str], int, int]]:
    """(intent, captures, literals, slots) of the accepting paths, best first: most literals, then fewest slots.

    A slot takes one or more words, and a repeated slot the same phrase each time.  Literals are tried before slots, and shorter phrases before
    longer ones; the first ``limit`` paths count, and texts over ``longest`` words have none.
    """
    if len(ws) > longest:
        return []
    found = _paths(ws, edges, intents, limit)
    found.sort(key=lambda m: (-m[2], m[3], m[0], sorted(m[1].items())))
    best: dict = {}
    for m in found:
        best.setdefault((m[0], *sorted(m[1].items())), m)
    return list(best.values())


def _paths(ws: list[str], edges: list[tuple], intents: dict[int, str], limit: int) -> list[tuple[str, dict[str, str], int, int]]:
    """(intent, captures, literals, slots) of the first ``limit`` accepting paths."""
    if not ws:
        return []
    by_state = defaultdict(list)
    for src, symbol, dst in sorted(edges, key=lambda e: (not e[1].startswith("L:"), e[1], e[2])):
        by_state[src].append((symbol[0] == "S", symbol[2:], dst))
    # states from which the words from a place on may be accepted, captures aside: no path is walked that can't end
    ends: list[set] = [set() for _ in ws] + [set(intents)]
    later = set(ends[-1])
    for at in range(len(ws) - 1, -1, -1):
        ends[at] = {s for s, out in by_state.items() for slot, name, dst in out if (dst in later if slot else name == ws[at] and dst in ends[at + 1])}
        later |= ends[at]
    found: list[tuple] = []
    stack = [(0, 0, {}, 0, 0)]
    while stack and len(found) < limit:
        state, at, captures, literals, slots = stack.pop()
        if at == len(ws):
            if state in intents:
                found.append((intents[state], captures, literals, slots))
            continue
        steps = []
        for slot, name, dst in by_state[state]:
            if not slot:
                if name == ws[at] and dst in ends[at + 1]:
                    steps.append((dst, at + 1, captures, literals + 1, slots))
                continue
            for to in range(at + 1, len(ws) + 1):
                phrase = " ".join(ws[at:to])
                if dst in ends[to] and captures.get(name, phrase) == phrase:
                    steps.append((dst, to, {**captures, name: phrase}, literals, slots + 1))
        stack += reversed(steps)
    return found


def match_status(tokens: DataFrame, edges=SLOT_EDGES, intents=INTENTS, limit: int = 256, longest: int = 128) -> DataFrame:
    """(id, status) of token arrays: ``matched``, ``no match``, ``too long`` (not walked) or ``cut`` (there are more paths than the first ``limit``)."""

    @pandas_udf(T.StringType())
    def status(arrays: pd.Series) -> pd.Series:
        out = []
        for ws in map(list, arrays):
            if len(ws) > longest:
                out.append("too long")
                continue
            n = len(_paths(ws, edges, intents, limit + 1))
            out.append("cut" if n > limit else "matched" if n else "no match")
        return pd.Series(out, dtype=object)

    return tokens.select("id", status("w").alias("status"))


def automaton_matches(tokens: DataFrame, edges=SLOT_EDGES, intents=INTENTS, limit: int = 256) -> DataFrame:
    """(id, rank, intent, captures, literals, slots): each interpretation of token arrays by ``match_all``, the best with rank 0.

    Texts without a row may have no match or be too long, and some have more paths than count: ``match_status`` tells which.
    """
    fields = [("intent", T.StringType()), ("captures", T.MapType(T.StringType(), T.StringType())), ("literals", T.IntegerType()), ("slots", T.IntegerType())]

    @pandas_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields])))
    def matches(arrays: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("intent", "captures", "literals", "slots"), m, strict=True)) for m in match_all(list(ws), edges, intents, limit=limit)] for ws in arrays], dtype=object)

    return tokens.select("id", F.posexplode(matches("w")).alias("rank", "m")).select("id", "rank", "m.intent", "m.captures", "m.literals", "m.slots")


def traverse(tokens: Column, edges: list[tuple[int, str, int]], accept: set[int]) -> Column:
    """(accepted, path): the states of a deterministic walk from 0 over all words; it stops at a word without an edge, which rejects."""
    table = F.create_map(*(F.lit(x) for s, w, t in edges for x in (f"{s} {w}", t)))
    path = lambda a: a["path"]
    to = lambda a, w: table[F.concat_ws(" ", F.element_at(path(a), -1).cast("string"), w)]
    step = lambda a, w: F.when(a["going"] & to(a, w).isNotNull(), F.struct(F.lit(True).alias("going"), F.concat(path(a), F.array(to(a, w))).alias("path"))).otherwise(F.struct(F.lit(False).alias("going"), path(a).alias("path")))
    end = lambda a: F.struct((a["going"] & F.element_at(path(a), -1).isin(sorted(accept))).alias("accepted"), path(a).alias("path"))
    return F.aggregate(tokens, F.struct(F.lit(True).alias("going"), F.array(F.lit(0)).alias("path")), step, end)


def selector_features(c: str) -> Column:
    """Words, twice, and character 3- and 4-grams with the ends marked."""
    w, line = F.split(c, " "), F.concat(F.lit(" "), c, F.lit(" "))
    named = lambda a, p: F.transform(a, lambda x: F.concat(F.lit(p), x))
    return F.concat(named(w, "w:"), named(w, "w:"), named(S.char_ngrams(line, 3), "3:"), named(S.char_ngrams(line, 4), "4:"))


def selector_lookup(entities: DataFrame, selectors: DataFrame, *, least: float = 0.55, margin: float = 0.04) -> DataFrame:
    """(id, method, selector, selectors) of (id, entity): an equal selector, else the similar ones within ``margin`` of the best.

    Only distinct entities without an equal selector are compared, through features that they share with a selector.
    """
    known = selectors.select("selector").distinct()
    exact = entities.join(known, F.col("entity") == F.col("selector"), "left_semi").select("id", F.lit("exact").alias("method"), F.col("entity").alias("selector"), F.lit(1).alias("selectors"))
    rest = entities.join(known, F.col("entity") == F.col("selector"), "left_anti")
    f = known.select(F.col("selector").alias("id"), F.explode(selector_features("selector")).alias("w"))
    weights = idf(f, known.count())
    s = tfidf(f, weights).select(F.col("id").alias("selector"), "w", F.col("weight").alias("y"))
    asked = rest.select("entity").distinct().select(F.col("entity").alias("id"), F.explode(selector_features("entity")).alias("w"))
    cos = tfidf(asked, weights).join(s, "w").groupBy(F.col("id").alias("entity"), "selector").agg(F.round(F.sum(F.col("weight") * F.col("y")), 6).alias("cosine"))
    top = cos.groupBy("entity").agg(F.max("cosine").alias("best"))
    near = cos.join(top, "entity").filter((F.col("cosine") >= least) & (F.col("best") - F.col("cosine") <= margin)).groupBy("entity").agg(F.min("selector").alias("selector"), F.count(F.lit(1)).cast("int").alias("selectors"))
    found = rest.join(near, "entity", "left").select("id", F.when(F.col("selector").isNotNull(), "cosine_similarity").otherwise("none").alias("method"), "selector", F.coalesce("selectors", F.lit(0)).alias("selectors"))
    return exact.unionByName(found)
