"""A session service by JSON lines: commands folded into sessions, in a stream or over a log of them.

A line is one object with ``op``: ``message`` (cart, text), ``continue`` (condition), ``reset``, ``replay`` (case_id), ``rate`` (condition, rating, reason), ``recover``
(cart, dialogue, observed_wait_seconds).  ``parsed`` takes lines apart natively and joins what the session needs from tables: the answers of each condition to a
message, and the request of a held-out case.  ``Session`` keeps the rules: what may follow what, and what a command changes.  It gives a row for each
command, with an error where the command is refused; a refused command changes nothing.  ``replay.replay`` runs it over a log, ``replay.stream`` over a
stream, with equal rows.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONDITIONS = ("reference", "learned")
RATINGS = ("appropriate", "inappropriate", "uncertain")
CARTS = ("lab", "hospital")
#: Seconds that a participant may have waited, at most.
LONGEST_WAIT = 3600.0
OUTPUT = "session string, seq long, op string, ok boolean, message string, turns int, pending string"
_LINE = "op string, cart string, text string, condition string, rating string, reason string, case_id string, dialogue string, observed_wait_seconds double"


@dataclass
class Session:
    """cart and history of the request that is open, and what waits for a choice: None, 'message', 'replay' or 'recover'."""

    cart: str | None = None
    history: list = field(default_factory=list)
    pending: str | None = None
    answers: list = field(default_factory=list)
    reviews: int = 0

    def turn(self, row: dict) -> dict:
        before = (self.cart, list(self.history), self.pending, list(self.answers), self.reviews)
        try:
            if row["bad"]:
                raise ValueError("A line must be one JSON object.")
            do = _OPERATIONS.get(row["op"])
            if do is None:
                raise ValueError(f"Unknown operation {row['op']}.")
            ok, message = True, do(self, row)
        except ValueError as e:
            ok, message = False, str(e)
            self.cart, self.history, self.pending, self.answers, self.reviews = before
        return {"seq": row["seq"], "op": row["op"], "ok": ok, "message": message, "turns": len(self.history), "pending": self.pending}


def _texts(row: dict) -> list[str]:
    return [] if row["answers"] is None else list(row["answers"])


def _reset(s: Session, row: dict) -> str:
    s.cart, s.history, s.pending, s.answers = None, [], None, []
    return "New interaction."


def _message(s: Session, row: dict) -> str:
    if s.pending == "message":
        raise ValueError("Choose a reply to go on, or reset.")
    if s.pending:
        _reset(s, row)
    text = (row["text"] or "").strip()
    if not text:
        raise ValueError("A message needs a text.")
    if row["cart"] not in CARTS:
        raise ValueError("A message needs a cart.")
    if s.cart is not None and row["cart"] != s.cart:
        raise ValueError("Reset before changing carts.")
    s.cart, s.pending, s.answers = row["cart"], "message", _texts(row)
    s.history = [*s.history, f"participant: {text}"]
    return " | ".join(s.answers)


def _continue(s: Session, row: dict) -> str:
    if s.pending != "message":
        raise ValueError("Send a message first.")
    s.history = [*s.history, f"robot: {s.answers[_condition(row)]}"]
    s.pending, s.answers = None, []
    return "Reply added."


def _condition(row: dict) -> int:
    if row["condition"] not in CONDITIONS:
        raise ValueError("Unknown condition.")
    return CONDITIONS.index(row["condition"])


def _replay(s: Session, row: dict) -> str:
    if row["case_text"] is None:
        raise ValueError(f"Unknown case {row['case_id']}.")
    _reset(s, row)
    s.pending, s.answers = "replay", _texts(row)
    return f"Replayed: {row['case_text']}"


def _rate(s: Session, row: dict) -> str:
    if not s.pending:
        raise ValueError("Nothing to rate.")
    _condition(row)
    if row["rating"] not in RATINGS:
        raise ValueError("Unknown rating.")
    s.reviews += 1
    return f"Review {s.reviews} of {row['condition']}: {row['rating']}."


def _recover(s: Session, row: dict) -> str:
    turns = [t.strip() for t in (row["dialogue"] or "").splitlines() if t.strip()]
    if not turns or not turns[-1].lower().startswith("participant:"):
        raise ValueError("A dialogue must end with the participant.")
    if row["cart"] not in CARTS:
        raise ValueError("Choose a cart.")
    wait = row["observed_wait_seconds"] or 0.0
    if not math.isfinite(wait) or not 0 <= wait <= LONGEST_WAIT:
        raise ValueError("Waiting time is out of range.")
    _reset(s, row)
    s.pending, s.answers = "recover", _texts(row)
    return f"Recovering after {len(turns)} turns" + (f" and {wait:g} s." if wait else ".")


_OPERATIONS: dict[str, Callable[[Session, dict], str]] = {"message": _message, "continue": _continue, "reset": _reset, "replay": _replay, "rate": _rate, "recover": _recover}


def parsed(lines: DataFrame, answer: Callable[[DataFrame], DataFrame], cases: DataFrame) -> DataFrame:
    """Rows for ``Session`` from (session, seq, line).

    answer: adds ``answers`` (one text for each condition) to rows with session, seq, cart and asked (the last thing that the participant said).
    cases: (case_id, cart, text) of the cases that may be replayed.
    """
    kind = F.schema_of_variant(F.try_parse_json("line"))
    fine = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    read = lines.select("session", "seq", (~fine).alias("bad"), F.from_json(F.when(fine, F.col("line")), _LINE).alias("x")).select("session", "seq", "bad", "x.*")
    known = cases.select("case_id", F.col("text").alias("case_text"), F.col("cart").alias("case_cart"))
    with_case = read.join(known, "case_id", "left")
    said = F.trim(F.regexp_replace(F.element_at(F.split(F.trim("dialogue"), "\n"), -1), "(?i)^ *participant:", ""))
    asked = F.when(F.col("op") == "message", F.col("text")).when(F.col("op") == "replay", F.col("case_text")).when(F.col("op") == "recover", said)
    return answer(with_case.withColumn("asked", asked).withColumn("cart", F.coalesce("cart", "case_cart")).drop("case_cart"))
