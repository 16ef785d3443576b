"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fitting.  Up to ``EXAMPLES`` labelled documents (those with the smallest hashes of their ids) are examples: most go into the index, one in
``CALIBRATE`` only calibrates.  All terms of the indexed examples make the vocabulary.  A term's weight is its TF-IDF, with document
frequencies counted over all documents, times a label weight: how far a G-test of its presence against the labels of the indexed examples goes
towards a bar that rises with the number of terms tried, 1 beyond it (supervised term weighting), so that chance words count little.
Examples become unit vectors.

Searching.  An inverted index holds the examples' weights by term, in blocks of ``BLOCK`` examples with the largest weight of
each frequent term in each block.  Postings of the other terms are added up first; that, plus the query's frequent terms times the block
maxima, bounds a block's cosines.  The blocks with the largest bounds are scored whole, then all others whose bound reaches the k-th best
cosine by then; the rest can't enter.  So the k nearest are exact, ties go to the smaller example.  Queries go through a block together, as a matrix product.

Scoring.  Neighbours vote with their cosines; the vote is smoothed by the share of toxic examples without any evidence, and a logistic
curve, fitted on the votes of the calibration examples, turns it into a probability.  The neighbours are the evidence.

Scores depend on the text alone; equal texts get equal scores.  Null and empty texts, and texts without terms of the
vocabulary, have no neighbours and get the score of no evidence.  Without labelled documents every score is 0.  Repeated rows stay; an empty
table gives no rows; very long texts take memory in proportion to one text; a column of the input named as the new one is an error.  The index
is bounded by EXAMPLES x terms in a text, and is broadcast; documents never move.
"""

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import new_column, prepare, table, text_or_empty

#: Labelled rows that a model is fitted on, at most.
EXAMPLES = 6000
#: One example in so many is kept out of terms' weights and index, and calibrates.
CALIBRATE = 5
NEIGHBOURS = 15
BLOCK = 64
#: How firmly the calibration curve keeps to the votes themselves: few examples can't bend it far.
RIDGE = 1.0
#: Rounding errors of the first, coarse sums are smaller.
CLOSE = 1e-4
#: Blocks of a text that are visited first, and texts that are searched together.
FIRST = 4
TOGETHER = 256
#: A term is frequent if more than one example in so many has it.
OFTEN = 16
#: Votes without evidence: weight of the prior share among neighbours' cosines.
PRIOR_WEIGHT = 0.1

#: Texts whose results a worker remembers.
REMEMBER = 10_000
#: Letters that stand for a longer word's other forms.
PREFIX = 5

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of_word(word: str) -> list[str]:
    """A word and its first letters, so that inflected forms meet."""
    return [word, word[:PREFIX] + "*"] if len(word) > PREFIX else [word]


class Columns:
    """Columns of terms: one dictionary for whole words, one for first letters."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.word = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.first = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}

    def __reduce__(self):
        return Columns, (self.terms,)

    def of_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns of a text's distinct terms, and their numbers: of a word its places, of first letters the words that begin so."""
        words = Counter(words_of(text))
        columns, numbers = [], []
        for known, counts in ((self.word, words), (self.first, Counter([w[:PREFIX] for w in words if len(w) > PREFIX]))):
            columns.append(np.fromiter(map(known.get, counts, repeat(-1)), np.int64, len(counts)))
            numbers.append(np.fromiter(counts.values(), np.int64, len(counts)))
        columns, numbers = np.concatenate(columns), np.concatenate(numbers)
        known = columns >= 0
        return columns[known], numbers[known]

    def add_to(self, counts: np.ndarray, text: str) -> None:
        """Count a text for each of its terms; the last count, one beyond the columns, takes unknown ones."""
        words = set(words_of(text))
        for known, some in ((self.word, words), (self.first, {w[:PREFIX] for w in words if len(w) > PREFIX})):
            counts[np.fromiter(map(known.get, some, repeat(-1)), np.int64, len(some))] += 1


def label_weights(texts: list[str], labels: list[int]) -> dict[str, float]:
    """All terms of the texts, in order, and how surely their presence goes with a label: (G + 1) / (bar + 1), at most 1, with a bar of 2 ln(terms tried) + 10."""
    with_term = [Counter(), Counter()]
    totals = [labels.count(0), labels.count(1)]
    for t, y in zip(texts, labels, strict=True):
        with_term[y].update({x for w in set(words_of(t)) for x in terms_of_word(w)})
    every, n = sorted(set(with_term[0]) | set(with_term[1])), sum(totals)
    bar = 2 * math.log(max(2, len(every))) + 10
    found = {}
    for w in every:
        g, there = 0.0, with_term[0][w] + with_term[1][w]
        for y in (0, 1):
            for seen, share in ((with_term[y][w], there / n), (totals[y] - with_term[y][w], 1 - there / n)):
                if seen:
                    g += 2 * seen * math.log(seen / (totals[y] * share))
        found[w] = min(1.0, (max(g, 0.0) + 1) / (bar + 1))
    return found


class Model:
    """examples, held: (texts, labels, ids) of the index and of the calibration.  df: documents with each term, in the order of ``weights``."""

    def __init__(self, weights: dict[str, float], df: list[int], n_docs: int, examples: tuple[list[str], list[int], list[int]], held: tuple[list[str], list[int], list[int]] = ([], [], [])):
        texts, labels, ids = examples
        self.columns = Columns(list(weights))
        self.idf = np.array([(math.log((1 + n_docs) / (1 + d)) + 1) * w for d, w in zip(df, weights.values(), strict=True)])
        self.labels, self.ids = np.array(labels, np.int64), list(ids)
        n, m = len(texts), len(weights)
        self.share = float(self.labels.mean()) if n else 0.0
        vectors = [(c.astype(np.int32), w.astype(np.float32)) for c, w in map(self.vector, texts)]
        bare = [y for (c, _), y in zip(vectors, labels, strict=True) if not len(c)]
        self.prior = (sum(bare) + self.share) / (len(bare) + 1) if n else 0.0
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        # examples with the same heaviest frequent term stand together, so that the maxima of a block say something; numbers stay those of the input
        frequency = np.zeros(m, np.int64)
        for c, _ in vectors:
            frequency[c] += 1
        heaviest = [int(c[f][w[f].argmax()]) if f.any() else -1 for c, w in vectors for f in [frequency[c] > n / OFTEN]]
        self.number = np.argsort(np.array(heaviest, np.int64), kind="stable")
        self.labels, self.ids = self.labels[self.number], [self.ids[i] for i in self.number]
        vectors = [vectors[i] for i in self.number]
        sizes = [len(c) for c, _ in vectors]
        terms_at = np.concatenate([np.empty(0, np.int32), *(c for c, _ in vectors)])
        weight = np.concatenate([np.empty(0, np.float32), *(w for _, w in vectors)])
        del vectors
        order = np.argsort(terms_at, kind="stable")  # owners ascend within a term
        self.owner, self.weight = np.repeat(np.arange(n, dtype=np.int32), sizes)[order], weight[order]
        self.ends = np.r_[0, np.cumsum(np.bincount(terms_at, minlength=m))]
        del order, terms_at, weight
        # frequent terms, those of more than n / OFTEN examples, as a matrix, and their largest weights in each block
        often = np.flatnonzero(np.diff(self.ends) > n / OFTEN)
        self.place = np.full(m, -1, np.int32)
        self.place[often] = np.arange(len(often))
        self.often = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        for k, c in enumerate(often.tolist()):
            i, j = self.ends[c], self.ends[c + 1]
            self.often[self.owner[i:j], k] = self.weight[i:j]
        self.most = self.often.reshape(self.blocks, BLOCK, len(often)).max(1).T.copy()
        self.curve = (1.0, 0.0)
        self.steps = np.arange(1 << 16)
        self.known: dict[bytes, tuple] = {}  # results by text
        self.visited = 0  # blocks whose examples were scored whole
        if held[0] and n:
            self._calibrate([v for v, _, _ in self.votes(held[0])], np.array(held[1], np.int64))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights of a text's unit vector over the vocabulary."""
        columns, numbers = self.columns.of_text(text)
        if not len(columns):
            return np.empty(0, np.int64), np.empty(0)
        weights = (1 + np.log(numbers)) * self.idf[columns]
        return columns, weights / np.sqrt((weights**2).sum())

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples with the largest positive cosines, exact, ties to the smaller example."""
        if not self.n:
            return [(np.empty(0, np.int64), np.empty(0)) for _ in vectors]
        m, wide = len(vectors), self.blocks * BLOCK
        score, frequent = np.zeros((m, wide)), np.zeros((m, len(self.most)), np.float32)
        for q, (columns, weights) in enumerate(vectors):  # postings of all terms but the frequent ones
            place = self.place[columns]
            rare = place < 0
            frequent[q, place[~rare]] = weights[~rare]
            start = self.ends[columns[rare]]
            length = self.ends[columns[rare] + 1] - start
            upto = np.cumsum(length)
            at = np.repeat(start - (upto - length), length)
            at += self.steps[: len(at)] if len(at) <= len(self.steps) else np.arange(len(at))
            product = np.repeat(weights[rare], length)
            product *= self.weight[at]
            score[q] = np.bincount(self.owner[at], product, minlength=wide)
        bounds = score.reshape(m, self.blocks, BLOCK).max(2) + frequent @ self.most
        left, least = bounds > 0, np.zeros(m)
        best = np.full((m, self.blocks, BLOCK), -1.0, np.float32)  # cosines, where a block was visited, to within CLOSE
        # first each vector's most promising blocks, then all whose bound reaches the k-th best cosine by then: no other can enter
        visit = left & (bounds >= np.partition(bounds, -min(FIRST, self.blocks), axis=1)[:, [-min(FIRST, self.blocks)]])
        for _ in range(2):
            for b in np.flatnonzero(visit.any(0)).tolist():
                q = np.flatnonzero(visit[:, b])
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                best[q, b] = score[q, part].astype(np.float32) + frequent[q] @ self.often[part].T
                self.visited += len(q)
            left &= ~visit
            if wide >= k:
                least = np.partition(best.reshape(m, wide), wide - k, axis=1)[:, wide - k]
            visit = left & (bounds >= np.maximum(least, 0)[:, None] - CLOSE)
        out = []
        for q, (columns, weights) in enumerate(vectors):
            i = np.flatnonzero((best[q].ravel() > -1) & (best[q].ravel() >= least[q] - 2 * CLOSE))
            i = i[i < self.n]
            place = self.place[columns]
            s = score[q, i] + self.often[np.ix_(i, place[place >= 0])] @ weights[place >= 0]
            i, s = i[s > 0], s[s > 0]
            top = np.lexsort((self.number[i], -np.round(s, 12)))[:k]
            out.append((i[top], s[top]))
        return out

    def votes(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each text's vote, its nearest examples and their cosines."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            for i, s in self.nearest([self.vector(t) for t in texts[at : at + TOGETHER]]):
                out.append((float(((s * self.labels[i]).sum() + PRIOR_WEIGHT * self.prior) / (s.sum() + PRIOR_WEIGHT)), i, s))
        return out

    def _calibrate(self, votes: list[float], y: np.ndarray) -> None:
        """A logistic curve over the log odds of the votes that calibration examples get; it never falls."""
        v = np.array(votes)
        x = np.log(np.clip(v, 1e-6, 1 - 1e-6) / np.clip(1 - v, 1e-6, 1))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + RIDGE * (a - 1), (p - y).sum() + RIDGE * b])
            r = p * (1 - p)
            h = np.array([[(r * x * x).sum() + RIDGE, (r * x).sum()], [(r * x).sum(), r.sum() + RIDGE]])
            step = np.linalg.solve(h, g)
            step *= min(1, 2 / max(1e-9, np.abs(step).max()))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (max(0.0, float(a)), float(b))

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[float]]]:
        """Each text's score, the ids of its nearest examples and their cosines; of equal texts one is searched."""
        if not self.n:
            return [(0.0, [], []) for _ in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.known}
        self.known.update(zip(new, self._scores(list(new.values())), strict=True))
        return [self.known[k] for k in keys]

    def _scores(self, texts: list[str]) -> list[tuple[float, list[int], list[float]]]:
        a, b = self.curve
        out = []
        for v, i, s in self.votes(texts):
            z = a * math.log(max(v, 1e-6) / max(1 - v, 1e-6)) + b
            out.append((1 / (1 + math.exp(-max(-30, min(30, z)))), [self.ids[x] for x in i.tolist()], s.tolist()))
        return out

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        return self.scores([text])[0]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Model:
    """A model from the labelled rows of ``docs``: ``labels`` has id and label.  Repeated rows are taken once."""
    prepare(docs.sparkSession)
    text = text_or_empty(text_col)
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1)).groupBy("i").agg(F.max("y").alias("y"))
    n = known.count()
    rank = F.conv(F.substring(F.md5(F.concat(F.lit("example:"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    chosen = known.filter(rank < int(2**32 * min(1.0, examples / max(1, n)))).orderBy("i").limit(examples)
    own = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).join(F.broadcast(chosen), "i").dropDuplicates(["i"])
    rows = sorted(own.toArrow().to_pylist(), key=lambda r: r["i"])
    # which examples calibrate follows from the id alone, by another hash than the choice of examples
    held_back = lambda r: zlib.crc32(f"calibrate:{r['i']}".encode()) % CALIBRATE == 0
    parts = [[r for r in rows if held_back(r) == x] for x in (False, True)]
    if not parts[0]:  # too few to keep any out
        parts = [rows, []]
    own, held = (([r["t"] for r in p], [r["y"] for r in p], [r["i"] for r in p]) for p in parts)
    del rows, parts
    weights = label_weights(*own[:2])
    columns = Columns(list(weights))
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(weights) + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                columns.add_to(counts, t)
                n += 1
        at = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[counts[at], n])], schema=schema)

    found = docs.select(text.alias("t")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(weights) + 1, np.int64)  # the last one counts all documents
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return Model(weights, df[:-1].tolist(), int(df[-1]), own, held)


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "__tw_tox") -> DataFrame:
    """All rows and columns of ``docs`` with (score, example ids, cosines)."""
    new_column(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("examples", T.ArrayType(T.LongType())), T.StructField("cosines", T.ArrayType(T.DoubleType()))]))
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.scores(list(texts)), columns=["score", "examples", "cosines"])

    return docs.withColumn(into, score(text_or_empty(text_col)))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_toxicity_knn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    out = score_documents(docs, model)
    score = F.col("__tw_tox.score")
    return out.select("doc_id", held_out().alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), F.array_join(F.transform("__tw_tox.examples", lambda x: x.cast("string")), ",").alias("evidence"))
