"""Noun phrases of requests: a tagger learnt from counts, a chunker, and the choice of the one phrase that a request is about.

``learn`` counts words, word ends and neighbouring tags of tagged words in Spark, and makes a hidden Markov model of them, bounded by ``most`` words; ``tag``
finds the likeliest tags of a text (Viterbi).  A noun phrase is a run of determiner, adjectives, numbers and nouns that ends with a noun.  ``noun_phrases``
gives each text its candidates, without determiners and without those whose head says nothing, and the chosen one: a phrase that the conversation had before counts
most, then longer ones and those that aren't the whole sentence; if the best two are closer than ``MARGIN``, none is chosen.
"""

import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

TAGS = ["ADJ", "ADV", "DET", "NOUN", "NUM", "OTHER", "PRON", "VERB"]
#: Heads that say nothing about the item.
GENERIC = {"drawer", "item", "object", "request", "robot", "cart", "trial", "interaction", "part", "study", "one", "something", "anything", "thing", "number", "end", "time", "pair"}
#: What a phrase scores for having been said before, for each word, and for not being the whole sentence; the least lead of a choice; words of a phrase at most.
BEFORE, WORD, INSIDE = 3.0, 0.25, 0.4
MARGIN = 0.2
LONGEST = 10
#: Counts that everything unseen has, and letters of a word's end.
SMOOTH = 0.01
ENDING = 3
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def split_words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].casefold(), m.start(), m.end()) for m in _WORD.finditer(text)]


def lemma(word: str) -> str:
    """A noun's singular by its ending."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ches", "shes", "xes", "sses")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us")) and len(word) > 3 else word


class Tagger:
    """words and endings: (form, tag) -> count; pairs: (tag before or '', tag) -> count."""

    def __init__(self, words: dict, endings: dict, pairs: dict):
        self.words, self.endings, self.pairs = words, endings, pairs
        totals: dict = defaultdict(float)
        for (_, t), n in pairs.items():
            totals[t] += n
        self.known, self.known_ends = {w for w, _ in words}, {e for e, _ in endings}
        self._total = totals
        before: dict = defaultdict(float)
        for (a, _), n in pairs.items():
            before[a] += n
        self.step = {a: [math.log((pairs.get((a, t), 0) + SMOOTH) / (before[a] + SMOOTH * len(TAGS))) for t in TAGS] for a in ["", *TAGS]}

    def __reduce__(self):
        return Tagger, (self.words, self.endings, self.pairs)

    def says(self, word: str) -> list[float]:
        """Log likelihood of a word under each tag: by its own counts, else by its ending's, else the same for all."""
        counts, form = (self.words, word) if word in self.known else (self.endings, word[-ENDING:])
        if form not in (self.known if counts is self.words else self.known_ends):
            return [0.0] * len(TAGS)
        size = len(self.known if counts is self.words else self.known_ends)
        return [math.log((counts.get((form, t), 0) + SMOOTH) / (self._total[t] + SMOOTH * size)) for t in TAGS]

    def tag(self, words: list[str]) -> list[str]:
        """The likeliest tags of a whole text; equal ones go to the earlier tag of ``TAGS``, from the end on."""
        if not words:
            return []
        score = [a + b for a, b in zip(self.step[""], self.says(words[0]), strict=True)]
        back = []
        for w in words[1:]:
            said, new, came = self.says(w), [], []
            for t in range(len(TAGS)):
                best = max(range(len(TAGS)), key=lambda s: (score[s] + self.step[TAGS[s]][t], -s))
                came.append(best)
                new.append(score[best] + self.step[TAGS[best]][t] + said[t])
            score = new
            back.append(came)
        at = max(range(len(TAGS)), key=lambda s: (score[s], -s))
        path = [at]
        for came in reversed(back):
            path.append(at := came[at])
        return [TAGS[t] for t in reversed(path)]


def learn(tagged: DataFrame, *, most: int = 100_000) -> Tagger:
    """A tagger from (id, position, word, tag).  The model keeps the ``most`` most frequent words and endings; other words go by their endings."""
    rows = tagged.select("id", "position", F.lower("word").alias("w"), "tag").filter(F.col("tag").isin(TAGS))

    def counts(form) -> dict:
        c = rows.groupBy(form.alias("form"), "tag").agg(F.count(F.lit(1)).alias("n"))
        top = c.groupBy("form").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "form").limit(most)
        return {(r.form, r.tag): r.n for r in c.join(top, "form").select("form", "tag", "n").collect()}

    before = F.coalesce(F.lag("tag").over(Window.partitionBy("id").orderBy("position")), F.lit(""))  # a text's words
    pairs = rows.withColumn("before", before).groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n")).collect()
    ending = F.when(F.length("w") > ENDING, F.substring("w", -ENDING, ENDING)).otherwise(F.col("w"))
    return Tagger(counts(F.col("w")), counts(ending), {(r.before, r.tag): r.n for r in pairs})


def candidates(text: str, tagger: Tagger) -> list[dict]:
    """text, key, start, end, head and whether the phrase stands inside a sentence (a verb is there), of each noun phrase that may name an item."""
    words = split_words(text)
    tags = tagger.tag([w for w, _, _ in words])
    inside, out, i = "VERB" in tags, [], 0
    while i < len(words):
        j = i
        while j < len(words) and tags[j] in ("ADJ", "NUM", "NOUN") or (j == i and j < len(words) and tags[j] in ("DET", "PRON")):
            if j > i and re.search(r"[.,;:!?]", text[words[j - 1][2] : words[j][1]]):
                break
            j += 1
        end = next((k for k in range(j, i, -1) if tags[k - 1] == "NOUN"), i)
        kept = [k for k in range(i, end) if tags[k] not in ("DET", "PRON")]
        if kept:
            head = lemma(words[end - 1][0])
            if head not in GENERIC and len(kept) <= LONGEST:
                start, stop = words[kept[0]][1], words[kept[-1]][2]
                out.append({"text": text[start:stop], "key": " ".join(lemma(words[k][0]) for k in kept), "start": start, "end": stop, "head": head, "inside": inside})
        i = max(j, i + 1)
    return out


def choose(found: list[dict], context: str) -> tuple[dict | None, str | None]:
    """The phrase that a request is about, or the reason why there is none."""
    last: dict = {}
    for c in found:
        last[c["key"]] = c
    said = " " + " ".join(lemma(w) for w, _, _ in split_words(context)) + " "
    worth = lambda c: BEFORE * (f" {c['key']} " in said) + WORD * len(split_words(c["text"])) + INSIDE * c["inside"]
    ranked = sorted(last.values(), key=lambda c: (worth(c), c["start"]), reverse=True)
    if not ranked:
        return None, "no_noun_phrase"
    if len(ranked) > 1 and worth(ranked[0]) - worth(ranked[1]) < MARGIN - 1e-9:
        return None, "ambiguous_noun_phrases"
    return ranked[0], None


_FOUND = T.StructType([T.StructField("candidates", T.ArrayType(T.StringType())), *(T.StructField(n, T.StringType()) for n in ("phrase", "key", "reason"))])


def noun_phrases(texts: DataFrame, tagger: Tagger) -> DataFrame:
    """(id, candidates, phrase, key, reason) of (id, text, context): keys of all candidates in order, the chosen phrase, or why none was."""
    shared = texts.sparkSession.sparkContext.broadcast(tagger)

    @pandas_udf(_FOUND)
    def find(said: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        out = []
        for text, context in zip(said, contexts, strict=True):
            found = candidates(text or "", shared.value)
            best, reason = choose(found, context or "")
            out.append(([c["key"] for c in found], best and best["text"], best and best["key"], reason))
        return pd.DataFrame(out, columns=_FOUND.names)

    return texts.select("id", find("text", "context").alias("f")).select("id", "f.*")
