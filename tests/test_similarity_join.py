"""Similarity joins against comparing everything with everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from turnwise.operators import similarity_join as J
from turnwise.session import keeper


def unit(v):
    return (np.array(v) / np.linalg.norm(v)).tolist()


def by_all(turns, patterns, route, holds=J.one_of):
    out = {}
    for t, state, v, payload in turns:
        ranked = sorted((-float(np.einsum("ij,ij->i", np.array([v]), np.array([c]))[0]), -r, p, tpl) for p, s, c, tpl, r in patterns if s == state)
        out[t] = next((p for x, _, p, tpl in ranked if -x >= route and holds(payload, tpl)), None)
    return out


def clustered(rng, n, dim, centres):
    return [unit(rng.choice(centres) + rng.gauss(0, 1) * 0.05 + np.array([rng.gauss(0, 0.15) for _ in range(dim)])) for _ in range(n)]


@pytest.mark.parametrize("hot", [False, True])
def test_first_valid_equals_comparing_all(spark, hot, monkeypatch):
    monkeypatch.setattr(J, "ROWS", 64)  # salts and parts come into play
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(hot)
    centres = [np.array([rng.gauss(0, 1) for _ in range(12)]) for _ in range(25)]
    state = lambda: "s0" if hot and rng.random() < 0.8 else f"s{rng.randint(0, 3)}"
    vectors = clustered(rng, 500, 12, centres)
    vectors[100:140] = [vectors[100]] * 40  # one point: ties go by reliability, then age
    patterns = [(i, state(), v, f"t{rng.randint(0, 9)}", rng.choice([0.5, 0.9])) for i, v in enumerate(vectors)]
    turns = []
    for i, v in enumerate(clustered(rng, 300, 12, centres)):
        s, v = state() if i else "nowhere", vectors[100] if i % 10 == 1 else v
        best = sorted(((-np.dot(c, v), t) for _, x, c, t, _ in patterns if x == s))[:3]
        turns.append((i, s, v, sorted({f"t{k}" for k in range(10)} - {t for _, t in best})))  # the best three never hold
    want = by_all(turns, patterns, 0.8)
    own = spark.createDataFrame(patterns, "pattern long, state string, centroid array<double>, template string, reliability double")
    got = J.first_valid(spark.createDataFrame(turns, "turn long, state string, vector array<double>, payload array<string>"), own, route=0.8).collect()
    assert {r.turn: r.pattern for r in got} == want and len(got) == 300
    assert sum(p is not None for p in want.values()) > 100
    pairs, compared = sum(r.in_state for r in got), sum(r.compared for r in got)
    assert compared < 0.75 * pairs, (compared, pairs)  # the share of pairs that were compared
    assert next(r for r in got if r.turn == 0).in_state == 0


def test_first_valid_with_a_rule_of_its_own(spark):
    patterns = spark.createDataFrame([(i, "s", unit([1, i / 10]), str(i), 0.5) for i in range(6)], "pattern long, state string, centroid array<double>, template string, reliability double")
    turns = spark.createDataFrame([(0, "s", unit([1, 0]), 3), (1, "s", unit([1, 0]), 9), (2, None, unit([1, 0]), 0)], "turn long, state string, vector array<double>, payload int")
    got = J.first_valid(turns, patterns, route=0.5, holds=lambda least, template: int(template) >= least).collect()
    assert {r.turn: r.pattern for r in got} == {0: 3, 1: None, 2: None}
    assert J.first_valid(turns, patterns.limit(0), route=0.5).filter("pattern IS NOT NULL").count() == 0
    assert J.first_valid(turns.limit(0), patterns, route=0.5).count() == 0


def all_pairs(rows, threshold):
    vectors = {}
    for i, t, w in rows:
        vectors.setdefault(i, {})[t] = w
    size = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vectors.items()}
    ids = sorted(i for i in vectors if size[i] > 0)
    cos = {(a, b): sum(vectors[a][t] * vectors[b].get(t, 0) for t in vectors[a]) / size[a] / size[b] for a in ids for b in ids if a < b}
    return {k: v for k, v in cos.items() if v >= threshold}


ROWS = "id long, term string, weight double"


@pytest.mark.parametrize("threshold", [0.21, 0.61, 0.91])
def test_similar_pairs_equal_all_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(J, "ROWS", 20)  # common terms are cut into cells
    rng = random.Random(threshold)
    rows = []
    for i in range(150):
        terms = set(rng.choices([f"w{k}" for k in range(80)], [1 / (k + 1) for k in range(80)], k=rng.randint(1, 12))) | {"every"}
        rows += [(i, t, rng.choice([0.5, 1.0, 3.0]) if t != "every" else 1.0) for t in terms]
    rows += [(1000, t, w) for i, t, w in rows if i == 7] + [(1001, "zero", 0.0)]  # a copy, and a vector without length
    want = all_pairs(rows, threshold)
    got = {(r.a, r.b): r.cosine for r in J.similar_pairs(spark.createDataFrame(rows, ROWS), threshold).collect()}
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got[7, 1000] == pytest.approx(1.0)


def test_rows_stay_linear_with_a_term_in_every_vector(spark):
    """The common term is in few prefixes, so what meets grows with the vectors and not with their pairs."""
    counts = []
    for n in (400, 1600):
        rows = [(i, t, 1.0) for i in range(n) for t in ("every", f"a{i // 2}", f"b{i // 2}", f"c{i}")]
        vectors = J.unit_vectors(spark.createDataFrame(rows, ROWS))
        prefixes = J.prefix_rows(vectors, 0.7).cache()
        assert prefixes.filter("term = 'every'").count() == 0
        counts.append((prefixes.count(), J.candidate_pairs(prefixes, 0.7).count()))
        prefixes.unpersist()
    assert counts[0][1] == 200 and counts[1] == (4 * counts[0][0], 800)


def test_pairs_that_only_share_a_rare_term_are_no_candidates(spark):
    rng = random.Random(12)
    base = [rng.sample(range(900), 60) for _ in range(200)]
    texts = [*base, *([*b[:-k], *rng.sample(range(900), k)] for b, k in zip(base[:60], [2, 8, 16] * 20, strict=True))]
    rows = [(i, f"t{w}", 1.0 + w / 900) for i, ws in enumerate(texts) for w in dict.fromkeys(ws)]
    vectors = J.unit_vectors(spark.createDataFrame(rows, ROWS)).cache()
    own = {r.id: dict(zip(r.terms, r.ws, strict=True)) for r in vectors.collect()}
    true = {(a, b) for a in own for b in own if a < b and sum(w * own[b].get(t, 0.0) for t, w in own[a].items()) >= 0.7}
    got = {tuple(r) for r in J.candidate_pairs(J.prefix_rows(vectors, 0.7), 0.7).collect()}
    assert true <= got and len(true) > 30 and len(got) < 2000  # of 33,670; the bound of one term alone leaves 20,184


def test_similar_texts_equal_all_pairs(spark, monkeypatch):
    """Blocks, chunks and buckets of few texts; copies, a clique over a bucket's size, texts without words, one id twice, null ids."""
    monkeypatch.setattr(J, "ENTRIES", 300)
    monkeypatch.setattr(J, "BUCKET", 4)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(3, 40)) for _ in range(120)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, *rng.choices(words, k=k)]) for b in base[:40] for k in (1, 4)] + [" ".join(base[0][:-1] + [f"x{i}"]) for i in range(20)] + ["", "!!", "solo"]
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(0, "again w1"), (5000, None), (None, "w1 w2 w3"), (5001, " ".join(base[3]))]
    merged = {}
    for i, t in rows:
        if i is not None and t is not None:
            merged.setdefault(i, []).extend(t.replace("!", " ").split())
    df = Counter(w for ws in merged.values() for w in set(ws))
    weights = [(i, w, (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1)) for i, ws in merged.items() for w, c in Counter(ws).items()]
    want = all_pairs(weights, 0.7)
    frame = spark.createDataFrame(rows, "id long, text string").repartition(5)
    kept = keeper(spark, "similar-texts-test")
    got = {(r.a, r.b): r.cosine for r in J.similar_texts(frame, len(rows), 0.7, keep=kept).collect()}
    assert got.keys() == want.keys() and len(want) > 200 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_meetings_of_terms_are_not_shipped(spark):
    """Prefixes are shipped for each block; before, each pair of rows of a term was a row of a join, whose number grows with the square."""
    rows = [(i, t, w) for (i, t), w in {(i, f"t{i * j % 40}"): 1.0 + j / 50 for i in range(80) for j in range(1, 8)}.items()]
    pairs = J.candidate_pairs(J.prefix_rows(J.unit_vectors(spark.createDataFrame(rows, ROWS)), 0.7).localCheckpoint(), 0.7)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
