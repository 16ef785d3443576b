"""Noun phrases of requests, with a tagger that learns from the inventory's names."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrases
from .base import I, U, inventory, query, utterances

#: Tags of the words around items in the requests' wordings.
WORD_TAGS = {"where": "ADV", "is": "VERB", "the": "DET", "which": "DET", "drawer": "NOUN", "has": "VERB", "no": "OTHER", "i": "PRON", "said": "VERB", "there": "OTHER", "any": "DET", "here": "ADV", "not": "ADV", "in": "OTHER", "two": "NUM", "too": "ADV", "please": "OTHER", "can": "VERB", "t": "ADV", "find": "VERB", "wrong": "ADJ", "four": "NUM", "thanks": "OTHER", "a": "DET", "lot": "ADV", "and": "OTHER", "or": "OTHER"}


def tagged_words(read):
    """(id, position, word, tag): half of the requests; an item's last word is a noun, its other words are adjectives."""
    u = utterances(read).join(inventory(read), F.col("id") == F.col("item_id")).filter("id % 16 < 8").select("id", T.words("text").alias("w"), F.split("name", " ").alias("name"))
    known = F.create_map(*(F.lit(x) for kv in WORD_TAGS.items() for x in kv))
    one = u.select("id", "name", F.posexplode("w").alias("position", "word"))
    last = F.element_at("name", -1)
    tag = F.when((F.col("word") == last) | (F.col("word") == F.concat(last, F.lit("s"))), "NOUN").when(F.array_contains("name", F.col("word")), "ADJ").otherwise(known[F.col("word")])
    both = one.select("id", "position", "word", tag.alias("tag"))
    # what joins two items in one request
    joined = u.select((-F.col("id") - 1).alias("id"), F.explode(F.array(*(F.struct(F.lit(p).alias("position"), F.lit(w).alias("word"), F.lit(t).alias("tag")) for p, (w, t) in enumerate((("ring", "NOUN"), ("and", "OTHER"), ("the", "DET")))))).alias("x")).select("id", "x.*")
    return both.unionByName(joined)


def asked(read):
    """(id, text, context): the requests; one in nine names a second item, and half of those were told of the first one before."""
    u, i = utterances(read), inventory(read)
    two = F.concat(F.lit("where is the "), "name", F.lit(" and the purple anvil"))
    pair = u.join(i, F.col("id") == F.col("item_id")).select("id", F.when(F.col("id") % 9 == 0, two).otherwise(F.col("text")).alias("text"), F.when(F.col("id") % 18 == 0, F.concat(F.lit("Do you need the "), "name", F.lit("?"))).alias("context"))
    return pair


@query(
    f"WITH {U}, {I} SELECT id, CASE WHEN id % 18 = 0 THEN name WHEN id % 9 = 0 THEN NULL WHEN id % 8 IN (5, 7) THEN NULL ELSE name END AS key, "
    "CASE WHEN id % 18 = 0 THEN NULL WHEN id % 9 = 0 THEN 'ambiguous_noun_phrases' WHEN id % 8 IN (5, 7) THEN 'no_noun_phrase' END AS reason FROM u JOIN i ON item_id = id"
)
def noun_phrase_choice(read):
    """The noun phrase that each request is about, or why there is none."""
    tagger = phrases.learn(tagged_words(read))
    return phrases.noun_phrases(asked(read), tagger).select("id", "key", "reason")
