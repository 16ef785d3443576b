"""Similarities and n-gram features; what has no built-in runs in Arrow-batched pandas functions."""

import difflib
import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def char_ngrams(c: Column, n: int) -> Column:
    """All substrings of n characters; shorter texts have none."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


@pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of characters in matching blocks (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])


def surface_similarity(a: Column, b: Column) -> Column:
    """0.55 parts of the sequence ratio and 0.45 of the words' Jaccard similarity."""
    return 0.55 * sequence_ratio(a, b) + 0.45 * jaccard(F.split(a, " "), F.split(b, " "))


@pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms and case folded, white space collapsed: what ``lower`` can't do (ß, ligatures, wide letters)."""
    return pd.Series([" ".join(unicodedata.normalize("NFKC", t).casefold().split()) if t is not None else None for t in texts], dtype=object)


DIMENSIONS = 2048
_WORDS = re.compile("[a-z0-9]+")


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of signed hashes of words, neighbouring words and character 3- to 5-grams."""
    ws = _WORDS.findall(" ".join(unicodedata.normalize("NFKC", text).casefold().split()))
    line = f" {' '.join(ws)} "
    grams = [f"c{n}:{line[i : i + n]}" for n in (3, 4, 5) for i in range(len(line) - n + 1)]
    found = [*(f"w:{w}" for w in ws), *(f"b:{a}_{b}" for a, b in zip(ws, ws[1:], strict=False)), *grams] or ["<empty>"]
    out = np.zeros(dimensions)
    for f in found:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        out[h % dimensions] += -1.0 if h >> 63 else 1.0
    n = np.sqrt((out**2).sum())
    return out / n if n else out


@pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embed(texts: pd.Series) -> pd.Series:
    """One vector for each distinct text of a batch."""
    known = {t: hash_vector(t or "") for t in texts.unique()}
    return texts.map(known)
