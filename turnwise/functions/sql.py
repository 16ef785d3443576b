"""The library's functions for SQL: scalar functions, Arrow functions and a table function under names that begin with ``tw_``.

``register(spark)`` makes them temporary functions of a session.  Those that SQL can say are SQL functions, which Catalyst inlines into the plan; the others run in
Arrow batches.
"""

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from .canonical import canonical_text
from .similarity import hash_embed, nfkc, sequence_ratio

#: name(parameters) RETURNS type: expression.
SQL_FUNCTIONS = [
    ("tw_beta(k DOUBLE, n DOUBLE) RETURNS DOUBLE", "(k + 1) / (n + 2)"),
    ("tw_wilson(k DOUBLE, n DOUBLE) RETURNS DOUBLE", "CASE WHEN n > 0 THEN greatest(0D, (k / n + 1.96D * 1.96D / (2 * n) - 1.96D * sqrt((k / n * (1 - k / n) + 1.96D * 1.96D / (4 * n)) / n)) / (1 + 1.96D * 1.96D / n)) ELSE 0D END"),
    ("tw_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("tw_log_sum_exp(a ARRAY<DOUBLE>) RETURNS DOUBLE", "array_max(a) + ln(aggregate(transform(a, x -> exp(x - array_max(a))), 0D, (s, x) -> s + x))"),
    ("tw_words(t STRING) RETURNS ARRAY<STRING>", "regexp_extract_all(lower(t), '([a-z0-9]+)', 1)"),
    ("tw_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE", "coalesce(try_divide(CAST(size(array_intersect(a, b)) AS DOUBLE), CAST(size(array_union(a, b)) AS DOUBLE)), 0D)"),
]


@pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for what has none."""
    out = []
    for t in texts:
        try:
            out.append(None if t is None else canonical_text(t))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


@udtf(returnType="turn int, role string, said string")
class Turns:
    """The turns of a dialogue with ``participant:`` and ``robot:`` lines; other lines go on with the turn before."""

    def eval(self, text: str):
        turns: list = []
        for line in (text or "").splitlines():
            if m := re.match(r"\s*(participant|robot)\s*:(.*)", line, re.IGNORECASE):
                turns.append((m[1].lower(), [m[2].strip()]))
            elif line.strip() and turns:
                turns[-1][1].append(line.strip())
        for n, (role, said) in enumerate(turns):
            yield n, role, " ".join(said).strip()


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    for head, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    arrow = {"tw_canonical_json": canonical_json, "tw_sequence_ratio": sequence_ratio, "tw_nfkc": nfkc, "tw_hash_embed": hash_embed}
    for name, f in arrow.items():
        spark.udf.register(name, f)
    spark.udtf.register("tw_turns", Turns)
    return [h.split("(")[0] for h, _ in SQL_FUNCTIONS] + [*arrow, "tw_turns"]
