"""Canonical JSON: one spelling for each value, whatever its nesting and key order, so that digests of it can serve as keys.

Keys are sorted at every depth by code points, separators are compact, numbers have their shortest form that reads back the same (whole numbers stay whole),
text is as it is but for quotes, backslashes and control characters.  Objects with a repeated key, NaN, infinities and halves of surrogate pairs have no
canonical form.
"""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        keys = [k for k, _ in pairs]
        raise ValueError(f"key {next(k for k in keys if keys.count(k) > 1)!r} is repeated")
    return found


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON number")


def canonical_text(text: str) -> str:
    """The canonical form of a JSON text; ValueError if it has none."""
    try:
        value = json.loads(text, object_pairs_hook=_object, parse_constant=_no_number)
        out = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        out.encode()
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return out


@pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _canonical(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        try:
            out.append((None if t is None else canonical_text(t), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["json", "error"])


def try_canonical(text: Column) -> Column:
    """(json, error) of JSON texts; null stays null without an error."""
    return _canonical(text)


def canonical(value: Column) -> Column:
    """The canonical JSON of a column of any kind that ``to_json`` takes (structs, maps, arrays, variants), nulls kept; an error if it has none."""
    x = _canonical(F.to_json(value, {"ignoreNullFields": "false"}))
    return F.when(x["error"].isNull(), x["json"]).otherwise(F.raise_error(x["error"]))


def digest(value: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(value), 256)
