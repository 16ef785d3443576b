"""Evidence of one text in others, and alignment of reviewed turns with source segments."""

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Share of a turn's words that its segments must cover.
COVERED = 0.8
#: Words that negate.
NEGATIONS = {"no", "not", "never", "none", "nothing", "isnt", "cant"}


def _words(text) -> list[str]:
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def coverage(wanted: list[str], given: list[str]) -> float:
    """Share of the wanted words in matching blocks of both sequences."""
    if not wanted:
        return 0.0
    return sum(m.size for m in difflib.SequenceMatcher(None, wanted, given, autojunk=False).get_matching_blocks()) / len(wanted)


@pandas_udf(T.DoubleType())
def covered(wanted: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([coverage(_words(a), _words(b)) for a, b in zip(wanted, given, strict=True)])


def evidence(claims: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(claim, best, support): of a claim's own transcripts (joined by key) the one that covers most of its words, ties to the smaller.

    claims: (claim, key, text); transcripts: (key, transcript, text).  Equal texts of a key are compared once, and stand for all that say the same.
    """
    claims = claims.select("claim", "key", F.coalesce("text", F.lit("")).alias("said"))
    said = claims.select("key", "said").distinct()
    told = transcripts.groupBy("key", "text").agg(F.min("transcript").alias("transcript"))
    pairs = said.join(told, "key").repartition(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), "said", "text")
    j = pairs.select("key", "said", "transcript", F.round(covered("said", "text"), 6).alias("support"))
    best = j.groupBy("key", "said").agg(F.min(F.struct((-F.col("support")).alias("k"), "transcript")).alias("m"))
    whole = claims.join(best, ["key", "said"]).groupBy("claim").agg(F.min("m").alias("m"))
    return whole.select("claim", F.col("m.transcript").alias("best"), (-F.col("m.k")).alias("support"))


def align(turns: list[str], segments: list[str], reach: int | None = None) -> list[tuple[int, int, float, str]]:
    """(first segment, last segment, coverage, flags) of each turn; -1 where nothing covers enough of it.

    A turn takes the fewest consecutive segments from the best start; flags: "order" if it begins before the turn before it,
    "polarity" if one side negates and the other doesn't.  reach: words that the segments of a turn have at most (default: any number).
    """
    parts, out, last = [_words(s) for s in segments], [], 0
    for t in turns:
        words, found = _words(t), (-1, -1, 0.0)
        need = Counter(words)
        for a in range(len(parts)):
            given: list[str] = []
            left, shared = need.copy(), 0
            for b in range(a, len(parts)):
                before = shared
                for w in parts[b]:
                    if left[w] > 0:
                        left[w] -= 1
                        shared += 1
                given += parts[b]
                if not shared:
                    break  # a turn doesn't begin with a segment that shares no word with it
                size = lambda x: x[1] - x[0]
                if shared > before and (shared / len(words), -(b - a)) > (found[2], -size(found)):  # matching blocks cover at most the shared words
                    c = coverage(words, given)
                    found = max(found, (a, b, c), key=lambda x: (x[2], -size(x)))
                if shared == len(words) or (found[2] >= 1 and b - a >= size(found)) or (reach is not None and len(given) > reach):
                    break
        a, b, c = found
        flags = []
        if c < COVERED:
            a = b = -1
        else:
            flags += ["order"] * (a < last)
            flags += ["polarity"] * (bool(NEGATIONS & set(words)) != bool(NEGATIONS & {w for p in parts[a : b + 1] for w in p}))
            last = a
        out.append((a, b, round(c, 6), ",".join(flags)))
    return out


def align_versions(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """(version, turn, first, last, coverage, flags).  turns: (version, turn, text); segments: (version, segment, text).

    A version is one dialogue, so its turns and segments fit a task.  Versions go to as many tasks as a shuffle has: their texts are small, but aligning them takes long.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns, segments = turns.repartition(parts, "version"), segments.repartition(parts, "version")

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("turn"), right.sort_values("segment")
        rows = align(left["text"].tolist(), right["text"].tolist())
        return pd.DataFrame([(k[0], t, *r) for t, r in zip(left["turn"], rows, strict=True)], columns=["version", "turn", "first", "last", "coverage", "flags"])

    return turns.groupBy("version").cogroup(segments.groupBy("version")).applyInPandas(run, "version long, turn long, first int, last int, coverage double, flags string")
