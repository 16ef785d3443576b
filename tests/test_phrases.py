"""Noun phrases: the tagger against trying all tag sequences, the choice against its rule."""

import itertools
import random

import pytest

from turnwise.operators import phrases
from turnwise.plans import phrase_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tagger(spark):
    return phrases.learn(phrase_queries.tagged_words(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")))


def test_counts_are_those_of_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, p, rng.choice(["a", "drill", "Drill", "drills", "runs", "x"]), rng.choice([*phrases.TAGS, "??"])) for i in range(60) for p in range(rng.randint(1, 6))]
    got = phrases.learn(spark.createDataFrame(rows, "id int, position int, word string, tag string").repartition(3))
    words, endings, pairs = {}, {}, {}
    for i in range(60):
        before = ""
        for _, _, w, t in sorted(r for r in rows if r[0] == i and r[3] != "??"):
            for table, k in ((words, (w.lower(), t)), (endings, (w.lower()[-3:], t)), (pairs, (before, t))):
                table[k] = table.get(k, 0) + 1
            before = t
    assert (got.words, got.endings, got.pairs) == (words, endings, pairs)
    assert {w for w, _ in phrases.learn(spark.createDataFrame(rows, "id int, position int, word string, tag string"), most=2).words} < {w for w, _ in words}


def test_tags_are_the_likeliest(tagger):
    rng = random.Random(3)
    vocabulary = ["where", "is", "the", "red", "ring", "rings", "drawer", "two", "zorp", "blue", "not", "", "said"]
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(1, 4))

        def likelihood(tags):
            steps = zip(["", *tags], tags, strict=False)
            return sum(tagger.step[a][phrases.TAGS.index(b)] for a, b in steps) + sum(tagger.says(w)[phrases.TAGS.index(t)] for w, t in zip(words, tags, strict=True))

        best = max(likelihood(t) for t in itertools.product(phrases.TAGS, repeat=len(words)))
        assert likelihood(tagger.tag(words)) == pytest.approx(best, abs=1e-9)
    assert tagger.tag([]) == []


def test_candidates_and_choices(tagger):
    keys = lambda t: [c["key"] for c in phrases.candidates(t, tagger)]
    assert keys("Where is the red ring?") == ["red ring"] and keys("is there any red rings here") == ["red ring"]
    assert keys("drawer too please") == [] and keys("") == []
    c = phrases.candidates("I can't find the blue bolt, wrong drawer four", tagger)
    assert [(x["text"], x["head"], x["inside"]) for x in c] == [("blue bolt", "bolt", True)]
    two = phrases.candidates("where is the red ring and the blue bolt", tagger)
    assert [x["key"] for x in two] == ["red ring", "blue bolt"]
    assert phrases.choose(two, "") == (None, "ambiguous_noun_phrases")
    assert phrases.choose(two, "Do you need the red rings?")[0]["key"] == "red ring"
    assert phrases.choose([], "") == (None, "no_noun_phrase")


@pytest.mark.parametrize("seed", range(3))
def test_choice_follows_the_scores(seed):
    rng = random.Random(seed)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(1, 4)):
            text = " ".join(rng.choices(["red", "old", "ring", "bolt"], k=rng.randint(1, 4)))
            found.append({"text": text, "key": text, "start": rng.randint(0, 50), "inside": rng.random() < 0.5})
        context = " ".join(rng.choices(["red", "old", "ring", "bolt", "x"], k=5))
        last = {c["key"]: c for c in found}.values()
        score = {c["key"]: 3 * (f" {c['key']} " in f" {context} ") + 0.25 * len(c["text"].split()) + 0.4 * c["inside"] for c in last}
        top = sorted(score.values(), reverse=True)
        best, reason = phrases.choose(found, context)
        if len(top) > 1 and top[0] - top[1] < 0.2 - 1e-9:
            assert best is None and reason == "ambiguous_noun_phrases"
        else:
            assert score[best["key"]] == top[0]
