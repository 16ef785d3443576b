"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans: for each kind the leftmost non-overlapping matches that pass its check.  The field then looks for
further mentions.  Its nodes are the tokens of a document that may be one: those with a digit, ``@`` or ``+``, and those that are similar to
a base span.  Labels are the kinds and "none".  Potentials:

* a token's shape with its label (digits, dots, signs, letters, in coarse classes);
* labels of neighbours in the text (the chain);
* labels of equal or similar tokens anywhere in the document (the skips).  Tokens are equal if their letters and digits are.  A token is
  similar to a base span if its letters and digits, ``SIMILAR`` at least, are contained in the span's, or contain the span's or those of a part of it
  (what ``@`` and white space separate).  Containment is looked up by n-grams within the document.  Equal tokens form one group, which one node for
  the group stands for, so a token repeated a thousand times has a thousand edges, not a million.

Tokens of base spans are observed.  Loopy sum-product passing, damped, gives every other token its marginals; a token whose
most likely label is a kind with more than ``CONFIDENT`` becomes a span.  Tokens that are no nodes can only be "none", so leaving them out
changes nothing.

Training.  All potentials are learnt piecewise, as smoothed counts over all documents with base spans as labels.  Tokens that are similar to a base
span, or equal to one that is observed, without lying in one have no known label: they and their edges don't count, so the field isn't taught that repeats are "none".  In
documents with base spans, tokens that are no nodes count as "none" by their shapes.  Skips learn from tokens that stand in a document more than once, all of them of known
labels.  What comes to the driver is one count for each shape and label.

Defined results: null text counts as empty and has no spans; equal texts get equal spans; base spans always stay; offsets count
code points, ends are exclusive; repeated rows stay; an empty table gives no rows; very long texts take memory in proportion to one text; a column of the
input that is named ``__tw_pii`` is an error.
"""

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import new_column, prepare, table, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
CONFIDENT = 0.5
ROUNDS = 20
DAMP = 0.3
#: A part of a base span that another token may repeat has at least so many letters and digits.
SIMILAR = 5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that begins within a run of digits would end where the one from its start does, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MAYBE = re.compile(r"[0-9@+]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of the whole pattern, found from their ``@``: long runs without one are never tried."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(token: str) -> str:
    """A coarse class of a token's looks."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    bucket = lambda n, edges: sum(n >= e for e in edges)
    number = re.sub(r"[^0-9]", "", token) if not letters else ""
    sound = "L" if 16 <= digits <= 19 and number and _luhn(number) else "V" if number and _IP.fullmatch(token.rstrip(".,;:!?")) and "ip" in {k for k, _, _ in base_spans(token)} else ""
    return f"{sound}d{bucket(digits, (1, 4, 8, 13, 16, 20))}l{bucket(letters, (1, 4, 12))}p{min(token.count('.'), 4)}{'@' if '@' in token else ''}{'+' if token[0] == '+' else ''}{'(' if '(' in token else ''}{'-' if '-' in token else ''}{'=' if '=' in token else ''}"


def core(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


class Similar:
    """Letters and digits of a document's base spans and of their parts, to be looked up by what contains them or is contained in them."""

    def __init__(self):
        self.owner: dict[str, int] = {}  # core -> the token that it comes from
        self.within: dict[str, list[str]] = defaultdict(list)  # n-gram -> cores that it is in
        self.first: dict[str, list[str]] = defaultdict(list)  # n-gram -> cores that begin with it

    def add(self, span: str, owner: int) -> None:
        for p in (span, *re.split(r"[@\s]", span)):
            c = core(p)
            if len(c) >= SIMILAR and c not in self.owner:
                self.owner[c] = owner
                self.first[c[:SIMILAR]].append(c)
                for g in {c[i : i + SIMILAR] for i in range(len(c) - SIMILAR + 1)}:
                    self.within[g].append(c)

    def of(self, c: str) -> set[int]:
        """Tokens of the base spans that a core is similar to."""
        if len(c) < SIMILAR:
            return set()
        found = {self.owner[x] for x in self.within.get(c[:SIMILAR], ()) if c in x}
        for i in range(len(c) - SIMILAR + 1):
            found.update(self.owner[x] for x in self.first.get(c[i : i + SIMILAR], ()) if c.startswith(x, i))
        return found


class Nodes:
    """The candidate tokens of a document with their observed labels, chain neighbours and skip edges."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.tokens = tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        label: dict[int, int] = {}
        starts = [a for a, _ in tokens]
        alike = Similar()
        for kind, a, b in spans:
            i = owner = max(0, bisect_right(starts, a) - 1)
            while i < len(tokens) and tokens[i][0] < b:
                if tokens[i][1] > a:
                    label.setdefault(i, LABELS.index(kind))
                i += 1
            alike.add(text[a:b], owner)
        names, links, remembered = [], {}, {}
        for i, (a, b) in enumerate(tokens):
            name = core(text[a:b]) if spans or _MAYBE.search(text, a, b) else ""
            names.append(name)
            if spans and name:
                if name not in remembered:
                    remembered[name] = alike.of(name)
                if found := remembered[name]:
                    links[i] = found
        self.at = [i for i, (a, b) in enumerate(tokens) if i in label or i in links or _MAYBE.search(text, a, b)]
        self.spans = [tokens[i] for i in self.at]
        self.shapes = [shape(text[a:b]) for a, b in self.spans]
        self.labels = [label.get(i, 0) for i in self.at]
        self.observed = [i in label for i in self.at]
        self.chain = [(n, n + 1) for n in range(len(self.at) - 1) if self.at[n + 1] == self.at[n] + 1]
        groups: dict[str, list[int]] = defaultdict(list)
        for n, i in enumerate(self.at):
            if len(names[i]) >= SIMILAR:
                groups[names[i]].append(n)
        self.equal = [g for g in groups.values() if len(g) > 1]
        place = {i: n for n, i in enumerate(self.at)}
        # each token has an edge to one base span, its group to all: the group's own node carries them on
        self.similar = []
        for g in groups.values():
            free = [n for n in g if not self.observed[n]]
            if free:
                bases = [place[o] for o in sorted(links.get(self.at[free[0]], ())) if place[o] not in g]
                self.similar += [(n, bases[0]) for n in free if bases] + [(free[0], o) for o in bases[1:]]
        seen = {n for g in self.equal if any(self.observed[n] for n in g) for n in g}
        #: Tokens whose label training knows: in a base span, or like none.
        self.known = [o or not (i in links or n in seen) for n, (i, o) in enumerate(zip(self.at, self.observed, strict=True))]


class Field:
    """Log potentials and inference."""

    def __init__(self, counts: Counter, smooth: float = 1.0):
        k = len(LABELS)
        shapes = {s for kind, s, _ in counts if kind == "shape"}
        self.unary = {}
        prior = np.array([sum(counts["shape", s, y] for s in shapes) for y in range(k)], float) + smooth
        for s in shapes:
            c = np.array([counts["shape", s, y] for y in range(k)], float)
            self.unary[s] = np.log((c + smooth * prior / prior.sum()) / (c.sum() + smooth))
        share = prior / prior.sum()
        self.unknown = np.log(share)

        def pair(kind: str) -> np.ndarray:
            """How much more often labels meet than by chance: log P(b | a) / P(b), smoothed towards chance, the mean of both directions."""
            m = np.array([[counts[kind, str(a), b] + counts[kind, str(b), a] for b in range(k)] for a in range(k)], float)
            ratio = np.log((m + smooth * share) / (m.sum(1, keepdims=True) + smooth) / share)
            return (ratio + ratio.T) / 2

        self.chain, self.skip = pair("chain"), pair("skip")

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Beliefs of all nodes by damped sum-product passing; groups of equal tokens meet in a node of their own."""
        n, k = len(nodes.at), len(LABELS)
        logs = np.array([self.unary.get(s, self.unknown) for s in nodes.shapes]).reshape(n, k)
        for i, (y, seen) in enumerate(zip(nodes.labels, nodes.observed, strict=True)):
            if seen:
                logs[i] = np.where(np.arange(k) == y, 0, -1e9)  # beyond what any number of messages adds up to
        edges = [(a, b, self.chain) for a, b in nodes.chain] + [(a, b, self.skip) for a, b in nodes.similar]
        hubs = 0
        for g in nodes.equal:
            if all(nodes.observed[i] for i in g):
                continue  # nothing to pass on but to each other, and all are known
            edges += [(i, n + hubs, self.skip) for i in g]
            hubs += 1
        if not edges:
            return _soft(logs)
        logs = np.vstack([logs, np.zeros((hubs, k))])
        a = np.array([e[0] for e in edges])
        b = np.array([e[1] for e in edges])
        weight = np.array([e[2] for e in edges])
        to_b, to_a = np.zeros((len(edges), k)), np.zeros((len(edges), k))
        for _ in range(ROUNDS):
            total = logs.copy()
            np.add.at(total, b, to_b)
            np.add.at(total, a, to_a)
            new_b = _lse((total[a] - to_a)[:, :, None] + weight, 1)
            new_a = _lse((total[b] - to_b)[:, None, :] + weight, 2)
            new_b -= _lse(new_b, 1)[:, None]
            new_a -= _lse(new_a, 1)[:, None]
            change = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max())
            to_b, to_a = (1 - DAMP) * new_b + DAMP * to_b, (1 - DAMP) * new_a + DAMP * to_a
            if change < 1e-4:
                break
        total = logs.copy()
        np.add.at(total, b, to_b)
        np.add.at(total, a, to_a)
        return _soft(total[:n])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def count_features(text: str, counts: Counter) -> None:
    """Add a document's counts of shapes, chain pairs and skip pairs of tokens with known labels."""
    if not _MAYBE.search(text):
        return
    spans = base_spans(text)
    nodes = Nodes(text, spans)
    y, known = nodes.labels, nodes.known
    counts.update(("shape", s, y[i]) for i, s in enumerate(nodes.shapes) if known[i])
    counts.update(("chain", str(y[a]), y[b]) for a, b in nodes.chain if known[a] and known[b])
    beside = set(nodes.at)
    for n, i in enumerate(nodes.at):  # neighbours that are no nodes are none
        if known[n]:
            counts["chain", "0", y[n]] += (i > 0 and i - 1 not in beside) + (i + 1 < len(nodes.tokens) and i + 1 not in beside)
    for g in nodes.equal:
        if all(known[i] for i in g):
            counts.update(("skip", str(y[g[0]]), y[i]) for i in g[1:])
    if spans:
        words = Counter(text[a:b] for i, (a, b) in enumerate(nodes.tokens) if i not in beside)
        for w, n in words.items():
            counts["shape", shape(w), 0] += n


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and all spans with those that the field adds, by kind, then start."""
    base = base_spans(text)
    if not _MAYBE.search(text):
        return base, base
    nodes = Nodes(text, base)
    if all(nodes.observed):
        return base, base
    beliefs = field.marginals(nodes)
    more: list[tuple[str, int, int]] = []
    before = -2  # the token that the last added span ends with
    for i in np.flatnonzero((beliefs.argmax(1) > 0) & (beliefs.max(1) > CONFIDENT) & ~np.array(nodes.observed, bool)):
        a, b = nodes.spans[i]
        kind = LABELS[beliefs[i].argmax()]
        b -= len(text[a:b]) - len(text[a:b].rstrip(".,;:!?"))
        if more and more[-1][0] == kind and nodes.at[i] == before + 1:
            more[-1] = (kind, more[-1][1], b)  # tokens of one mention
        elif a < b:
            more.append((kind, a, b))
        before = nodes.at[i]
    return base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def train(docs: DataFrame, *, text_col: str = "text") -> Field:
    """A field from all documents: counts add up within tasks, then by feature; the driver gets one row for each feature."""
    schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                count_features(t, counts)
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    text = text_or_empty(text_col)
    got = docs.select(text.alias("t")).filter(F.col("t").rlike("[0-9@+]")).mapInArrow(count, "kind string, a string, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Field(Counter({(r.kind, r.a, r.b): r.n for r in got}))


def find_pii(docs: DataFrame, field: Field, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``__tw_pii``: arrays base and spans of kind:start:end."""
    new_column(docs, "__tw_pii")
    span = T.ArrayType(T.StringType())

    @pandas_udf(T.StructType([T.StructField("base", span), T.StructField("spans", span)]))
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = [all_spans(t, field) for t in texts]
        as_rows = lambda found: [f"{k}:{a}:{b}" for k, a, b in found]
        return pd.DataFrame({"base": [as_rows(b) for b, _ in rows], "spans": [as_rows(s) for _, s in rows]})

    return docs.withColumn("__tw_pii", find(text_or_empty(text_col)))


def op8_pii_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prepare(spark)
    found = find_pii(docs, train(docs))
    base, spans = F.col("__tw_pii.base"), F.col("__tw_pii.spans")
    of_kind = lambda k: F.size(F.filter(base, lambda s: s.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    counts = list(map(of_kind, KINDS))
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))
