"""Deleting repeated runs of lines, found by winnowing over line hashes.

Lines are compared without outer white space; blank lines are transparent.  A run is worth deleting if it has at least
``min_words`` words.  Windows over a document's lines are the shortest spans with so many words, one beginning and one
ending at each line.  The smallest line hash of a window is its fingerprint, so two places with the same run share
a window and, for certain, its fingerprint: nothing of that length is missed, however it is aligned.

1. Neighbouring windows mostly have their minimum at the same line.  Only these distinct lines go on, each with its surroundings:
   the hashes of all lines of the windows whose minimum it is (so the surroundings are bounded by two windows).
2. Positions of equal fingerprints are joined to the first of them, by (doc_id, text hash, line).  No pairs of places are
   made: a passage in a third of all documents costs one row for each place.
3. Each match is extended both ways, line by line, as long as hashes agree.  Of what is found, spans of at least ``min_words`` words
   are repeats.  Matches longer than the surroundings go on at the next fingerprint, so their spans overlap and add up.
4. A line may also stand first in other company.  Windows of a later place that don't lie in what matched the first one can only
   stand at other later places; they meet at their own first place, by the hash of their lines.

Together these are exactly the lines that lie in some run of at least ``min_words`` words which also stands earlier.

Defined results: null text counts as empty; null doc_ids come first; rows that agree in doc_id and text are one
document and get the same result; the first place of a run always stays; very long texts and lines take memory in proportion to one
Arrow batch; an empty table gives no rows; other columns pass through (but for names that begin with ``__tw_``, which are ours).
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import cut, prepare, table, text_or_empty

MIN_WORDS = 50

_PRINTS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("fp", pa.int64()), ("mid", pa.int32()), ("numbers", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
_PRINTS_DDL = "doc_id long, th long, at int, fp long, mid int, numbers array<int>, words array<int>, hashes array<long>"
_SPANS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("win", pa.binary())])
_SPANS_DDL = "doc_id long, th long, start int, stop int, win binary"


def windows(words: list[int], hashes: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, minimum) of all windows over lines with so many words and such hashes; of equal hashes the last is the minimum."""
    n = len(words)
    before = [0]  # words before each line
    for w in words:
        before.append(before[-1] + w)
    spans, j = [], 0
    for i in range(n):  # shortest span from line i
        j = max(j, i)
        while j < n and before[j + 1] - before[i] < min_words:
            j += 1
        if j == n:
            break
        spans.append((i, j))
    i, forward = 0, set(spans)
    backward = []
    for j in range(n):  # shortest span up to line j
        while before[j + 1] - before[i + 1] >= min_words and i < j:
            i += 1
        if before[j + 1] - before[i] >= min_words and (i, j) not in forward:
            backward.append((i, j))
    for group in (spans, backward):  # in both, starts and ends ascend, so a queue of minima does
        queue: deque[int] = deque()
        to = 0
        for i, j in group:
            while to <= j:
                while queue and hashes[queue[-1]] >= hashes[to]:
                    queue.pop()
                queue.append(to)
                to += 1
            while queue[0] < i:
                queue.popleft()
            yield i, j, queue[0]


def fingerprints(text: str, min_words: int) -> Iterator[tuple[int, int, int, list[int], list[int], list[int]]]:
    """(line, hash, its place in the surroundings, and line numbers, words and hashes of the surroundings) of the distinct window minima."""
    lines = [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip())]
    words = [len(s.split()) for _, s in lines]
    if sum(words) < min_words:
        return
    hashes = [xxhash.xxh3_64_intdigest(s) - (1 << 63) for _, s in lines]
    reach: dict[int, tuple[int, int]] = {}
    for i, j, m in windows(words, hashes, min_words):
        lo, hi = reach.get(m, (i, j))
        reach[m] = min(i, lo), max(j, hi)
    for m, (lo, hi) in reach.items():
        part = slice(lo, hi + 1)
        yield lines[m][0], hashes[m], m - lo, [i for i, _ in lines[part]], words[part], hashes[part]


def extend(mine: list[int], mid: int, first: list[int], first_mid: int) -> tuple[int, int]:
    """The first and last of my lines around ``mid`` that agree with those around ``first_mid``."""
    a, b = mid, mid
    while a and first_mid + a - mid and mine[a - 1] == first[first_mid + a - mid - 1]:
        a -= 1
    while b + 1 < len(mine) and first_mid + b - mid + 1 < len(first) and mine[b + 1] == first[first_mid + b - mid + 1]:
        b += 1
    return a, b


def _extend_matches(later: DataFrame, min_words: int) -> DataFrame:
    """later: a later place and the surroundings of the first one -> spans that stand there, and with ``win`` windows that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, th, mid, numbers, words, hashes, first_mid, first in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                x, y = extend(hashes, mid, first, first_mid)
                if sum(words[x : y + 1]) >= min_words:
                    out.append((doc_id, th, numbers[x], numbers[y], None))
                if x or y + 1 < len(hashes):
                    for i, j, m in windows(words, hashes, min_words):
                        if m == mid and (i < x or j > y):
                            out.append((doc_id, th, numbers[i], numbers[j], xxhash.xxh3_128_digest(np.array(hashes[i : j + 1]).tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _SPANS.types, strict=True)], schema=_SPANS)

    return later.mapInArrow(run, _SPANS_DDL)


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, spans): for each document with later repeats, the first and last lines of repeated spans."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows += [(doc_id, th, *f) for f in fingerprints(text, min_words)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _PRINTS.types, strict=True)], schema=_PRINTS)

    text = text_or_empty(text_col)
    found = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(find, _PRINTS_DDL), "line-fingerprints")
    place = F.struct("doc_id", "th", "at")
    # each join's small side is a table of its own, so both sides are shuffled for the join and a hot key's rows can be split
    shared = cut(found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter(F.col("a") != F.col("b")).select("fp", "a"), "line-shared")
    placed = cut(found.join(shared, "fp").withColumn("is_first", place == F.col("a")).drop("a"), "line-places")
    first = cut(placed.filter("is_first").dropDuplicates(["fp"]).select("fp", F.col("mid").alias("first_mid"), F.col("hashes").alias("first")), "line-first")
    later = placed.filter("not is_first").join(first, "fp").select("doc_id", "th", "mid", "numbers", "words", "hashes", "first_mid", "first")
    spans = cut(_extend_matches(later, min_words), "line-spans")
    place = F.struct("doc_id", "th", "start")
    others = spans.filter("win is not null")
    first_other = cut(others.groupBy("win").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter(F.col("a") != F.col("b")).select("win", "a"), "line-other-first")
    repeated = spans.filter("win is null").unionByName(others.join(first_other, "win").filter(place != F.col("a")).select(*spans.columns))
    return repeated.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


_RESULT = T.StructType([T.StructField(n, t()) for n, t in (("kept", T.StringType), ("n_lines", T.LongType), ("n_deleted", T.LongType), ("deleted", T.StringType))])


@pandas_udf(_RESULT)
def _delete(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        lines = text.split("\n")
        if found is None or not len(found):
            rows.append((text, len(lines), 0, ""))
            continue
        runs: list[list[int]] = []
        for a, b in sorted((x["start"], x["stop"]) for x in found):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        gone = {i for a, b in runs for i in range(a, b + 1)}
        rows.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone), ",".join(f"{a}-{b}" for a, b in runs)))
    return pd.DataFrame(rows, columns=["kept", "n_lines", "n_deleted", "deleted"])


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and a column ``__tw_lines`` of (kept text, n_lines, n_deleted, deleted runs)."""
    prepare(docs.sparkSession)
    spans = repeated_spans(docs, min_words=min_words, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__tw_id"), F.col("th").alias("__tw_th"), F.col("spans").alias("__tw_spans"))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__tw_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__tw_th")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), _delete(text_or_empty(text_col), F.col("__tw_spans")).alias("__tw_lines"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = lambda n: F.col("__tw_lines." + n)
    return out.select("doc_id", x("n_lines"), x("n_deleted"), x("deleted"), F.length(x("kept")).cast("long").alias("kept_chars"), F.sha2(x("kept"), 256).alias("kept_sha256"))


#: The lines in some run of at least 50 words that also stands earlier, straight from the definition.
OP3_SQL = r"""
WITH a AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS pos FROM a),
n AS (SELECT doc_id, text, pos, regexp_replace(raw, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g') AS line, len(regexp_extract_all(raw, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+')) AS w FROM l),
m AS (SELECT *, row_number() OVER d AS k, sum(w) OVER d AS cum FROM n WHERE line <> '' WINDOW d AS (PARTITION BY doc_id, text ORDER BY pos)),
s AS (
  SELECT x.doc_id, x.text, x.k AS i, min(y.k) AS j FROM m x JOIN m y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.text = y.text AND y.k >= x.k AND y.cum - x.cum + x.w >= 50 GROUP BY ALL
  UNION
  SELECT y.doc_id, y.text, max(x.k) AS i, y.k AS j FROM m x JOIN m y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.text = y.text AND y.k >= x.k AND y.cum - x.cum + x.w >= 50 GROUP BY ALL),
q AS (SELECT doc_id, text, list(line ORDER BY k) AS lines, list(pos ORDER BY k) AS ps FROM m GROUP BY ALL),
r AS (
  SELECT s.doc_id, s.text, ps[i] AS start, ps[j] AS stop, row_number() OVER (PARTITION BY lines[i:j] ORDER BY s.doc_id NULLS FIRST, s.text, ps[i]) AS nth
  FROM s JOIN q ON s.doc_id IS NOT DISTINCT FROM q.doc_id AND s.text = q.text),
g AS (SELECT DISTINCT l.doc_id, l.text, l.pos FROM l JOIN r ON nth > 1 AND l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.text = r.text AND pos BETWEEN start AND stop),
i AS (SELECT doc_id, text, min(pos) AS x, max(pos) AS y FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS island FROM g) GROUP BY doc_id, text, island),
d AS (SELECT doc_id, text, string_agg(x || '-' || y, ',' ORDER BY x) AS deleted, CAST(sum(y - x + 1) AS BIGINT) AS n_deleted FROM i GROUP BY ALL),
k AS (SELECT l.doc_id, l.text, string_agg(raw, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY ALL)
SELECT o.doc_id, len(string_split(coalesce(o.text, ''), chr(10))) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted, len(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(o.text, '') = d.text LEFT JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND coalesce(o.text, '') = k.text
"""
