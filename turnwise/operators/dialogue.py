"""The rules of an item-finding dialogue: typed requests, resolution, validity, guard, templates, replies, memory.

A request is a row with a setting's inventory beside it; what these rules need of an inventory is bounded by its items, so it is
sent to the tasks once, while requests stay where they are.  ``judge`` applies everything to a DataFrame of requests in Arrow batches.

Rules are lists of named checks.  Adding one is adding a line; the first that fails names the error.
"""

import gc
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, partial
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import CORRECTION_CUES, DRAWER_WORDS, NUMBER_WORDS
from .decisions import ACTIONS, FAILURES, STRATEGIES

#: Words around a direct request, words of a request for an item, words that point back, words that negate.
FILLERS = {"a", "an", "the", "some", "please", "pls", "i", "me", "my", "want", "need", "would", "like", "can", "could", "you", "do", "have", "get", "give", "show", "find", "locate", "where", "is", "are", "tell"}
ASKING = {"where", "find", "locate", "need", "have", "get", "grab", "drawer", "inventory", "looking", "show", "give", "retrieve", "bring", "fetch"}
POINTING = {"it", "one", "that", "again"}
NEGATING = {"no", "not", "dont", "didnt", "isnt", "without", "except", "instead", "wrong"}
#: Cues after which the meant item follows, and cues that only reject.
MEANT = ("i meant", "no i said", "i said")
REJECTS = ("did not mean", "didn t mean", "not that one")
#: Which kinds of phrases each extractor knows, the best first.
STYLES = {"v3": ["item", "drawer", "attribute", "family"], "v2": ["item", "attribute", "family"], "v1": ["item", "family", "attribute"]}
KEYS = ["action", "item_family", "resolved_item_id", "attributes", "missing_attributes", "failure_detected", "failure_type", "recovery_strategy"]


_WORD = re.compile("[a-z0-9]+")
_DRAWERS = frozenset(DRAWER_WORDS)


def normal(text) -> str:
    text = str(text or "")
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return " ".join(folded.split())


def _raw(text) -> list[str]:
    """The words of a text; white space between them doesn't matter."""
    return _WORD.findall(text.lower() if isinstance(text, str) and text.isascii() else normal(text))


def tokens(text) -> list[str]:
    return _numbered(_raw(text))


def _numbered(raw: list[str]) -> list[str]:
    if _DRAWERS.isdisjoint(raw):
        return raw
    return [NUMBER_WORDS.get(w, w) if before in DRAWER_WORDS else w for before, w in zip(["", *raw], raw, strict=False)]


def other_number(phrase: tuple[str, ...]) -> tuple[str, ...]:
    *head, w = phrase
    if w.endswith("ies") and len(w) > 3:
        w = w[:-3] + "y"
    elif w.endswith("s"):
        w = w + "s" if w.endswith("ss") or len(w) == 1 else w[:-1]
    elif w.endswith("y") and len(w) > 1 and w[-2] not in "aeiou":
        w = w[:-1] + "ies"
    else:
        w += "s"
    return (*head, w)


def _forms(phrase: str, both: bool) -> tuple[tuple[str, ...], ...]:
    """A phrase's words, in both numbers if asked."""
    words = tuple(tokens(phrase))
    return () if not words else (words, other_number(words)) if both else (words,)


def only(values: Iterable):
    """The single distinct value, or None; what follows a second one isn't looked at."""
    found: dict = {}
    for v in values:
        found[v] = None
        if len(found) > 1:
            return None
    return next(iter(found), None)


class Members(NamedTuple):
    """How many items of a family have certain attributes, and the first ``CANDIDATES`` of them."""

    count: int
    head: list[dict]


class Inventory:
    """Items of one setting, by id, family and phrase.  Items: id, name, family, attributes, aliases, drawer."""

    def __init__(self, items: list[dict]):
        self.items = {}
        for x in items:
            x = {"aliases": [], "attributes": {}, **x, "drawer": (x.get("drawer") or x.get("location") or "").strip() or None}
            for k in ("id", "name", "family"):
                x[k] = str(x.get(k) or "").strip()
            if not (x["id"] and x["name"] and x["family"]) or x["id"] in self.items:
                raise ValueError(f"item {x['id']!r} lacks an id, name or family, or repeats an id")
            self.items[x["id"]] = x
        self.phrases: dict[tuple, dict[str, list]] = {}
        self._families: dict[str, list] = {}
        self._having: dict[tuple, list] = {}
        told = set()  # families, attributes and drawers bring the same phrases with each of their items
        for x in self.items.values():
            family = x["family"]
            for p in (x["name"], *x["aliases"]):
                self._add(p, "item", x["id"], both=True)
            if family not in self._families:
                self._families[family] = []
                self._add(family.replace("_", " "), "family", family, both=True)
            self._families[family].append(x)
            for kv in x["attributes"].items():
                if kv not in told:
                    told.add(kv)
                    self._add(kv[1], "attribute", kv)
                self._having.setdefault((family, *kv), []).append(x)
            if x["drawer"] not in told:
                told.add(x["drawer"])
                self._add(x["drawer"], "drawer", x["drawer"])
        # what was asked before: no answer is as long as an inventory, and requests share them
        self._members: dict[tuple, Members] = {}
        self._differing: dict[str, list[str]] = {}
        self._named: dict[int, list[str]] = {}
        self.longest = max(map(len, self.phrases), default=0)

    def _add(self, phrase, kind: str, value, both: bool = False) -> None:
        for p in _forms(str(phrase or ""), both):
            kinds = self.phrases.get(p)
            if kinds is None:
                self.phrases[p] = {kind: [value]}
            elif kind not in kinds:
                kinds[kind] = [value]
            elif kinds[kind][-1] != value:  # the names of an item come one after another
                kinds[kind].append(value)

    def family(self, name: str | None, attributes: dict | None = None) -> list[dict]:
        wanted = list((attributes or {}).items())
        own = min((self._having.get((name, *kv), []) for kv in wanted), key=len) if wanted else self._families.get(name, [])
        return [x for x in own if all(x["attributes"].get(k) == v for k, v in wanted)] if len(wanted) > 1 else own

    def members(self, name: str | None, attributes: dict | None = None) -> Members:
        if not isinstance(name, str):
            return Members(0, [])
        key = (name, *sorted((attributes or {}).items()))
        if key not in self._members:
            found = self.family(name, attributes)
            self._members[key] = Members(len(found), found[:CANDIDATES])
        return self._members[key]

    def keys(self, family: str) -> set[str]:
        """Attributes that some item of a family has."""
        return {k for k, _ in self._told(family)}

    def disagreeing(self, family: str) -> list[str]:
        """Attributes by which a family's items differ; lacking one counts as a value."""
        return [k for k, differs in self._told(family) if differs]

    def _told(self, family: str) -> list[tuple[str, bool]]:
        if family not in self._differing:
            members = self._families.get(family, [])
            values: dict[str, set] = {}
            having: Counter = Counter()
            for x in members:
                having.update(x["attributes"].keys())
                for k, v in x["attributes"].items():
                    values.setdefault(k, set()).add(v)
            self._differing[family] = [(k, len(values[k] | ({None} if having[k] < len(members) else set())) > 1) for k in sorted(values)]
        return self._differing[family]

    def families_of(self, values: list[str]) -> list[str]:
        """The families of a phrase's items; values: a list of ``phrases``."""
        if id(values) not in self._named:
            self._named[id(values)] = sorted({self.items[v]["family"] for v in values})
        return self._named[id(values)]

    def union(self, one: list[str], other: list[str]) -> list[str]:
        return list(dict.fromkeys([*one, *other]))

    def spans(self, words: list[str], kinds: list[str]) -> Iterable[tuple[str, list]]:
        """From left to right the longest phrase of the known kinds, or a word."""
        i = 0
        while i < len(words):
            for n in range(min(self.longest, len(words) - i), 0, -1):
                found = self.phrases.get(tuple(words[i : i + n]))
                if found and (kind := next((k for k in kinds if k in found), None)):
                    yield kind, found[kind]
                    break
            else:
                n = 1
                yield "word", [words[i]]
            i += n


@dataclass
class Features:
    surface: str = "<empty>"
    items: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str]] = field(default_factory=list)
    ambiguous: bool = False
    correction: bool = False
    proposed_items: list[str] = field(default_factory=list)
    proposed_drawers: list[str] = field(default_factory=list)


def _symbol(style: str, kind: str, values: list, inv: Inventory) -> str:
    one = len(values) == 1
    if style == "v3":
        if kind == "item" and not one:
            return "<family>" if len(inv.families_of(values)) == 1 else "<ambiguous-item>"
        if kind == "attribute":
            key = only(k for k, _ in values)
            return f"<attribute:{key}>" if key else "<attribute>"
        return f"<{kind}>"
    if not one:
        return f"<ambiguous{':' if style == 'v2' else '-'}{kind}>"
    return f"<attr:{values[0][0]}>" if kind == "attribute" else f"<{kind}>"


def _both(one: list, other: list, inv: Inventory) -> list:
    """Distinct items of two lists, in order; where one is empty it is the other, which phrases share and nobody changes."""
    return inv.union(one, other) if one and other else one or other


def extract(text, inv: Inventory, style: str = "v3") -> Features:
    """What a text names, and its wording with slots in place of what it names."""
    line = normal(text)
    raw = _raw(text)
    out, surface = Features(correction=any(c in line for c in CORRECTION_CUES)), []
    for kind, values in inv.spans(_numbered(raw) if style == "v3" else raw, STYLES[style]):
        if kind == "word":
            surface += [w for w in values if style != "v1" or w not in FILLERS]
            continue
        surface.append(_symbol(style, kind, values, inv))
        unsure = len(values) > 1
        if kind == "item":
            out.items = _both(out.items, values, inv) if style == "v3" or not unsure else out.items
            if unsure and style == "v3":
                out.families += inv.families_of(values)
        elif kind == "family":
            out.families += values if style == "v3" or not unsure else []
            unsure |= style == "v3" and any(inv.members(v).count > 1 for v in values)
        elif kind == "attribute":
            out.attributes += values if style == "v3" or not unsure else []
        out.ambiguous |= unsure
    out.families, out.attributes = (list(dict.fromkeys(x)) for x in (out.families, out.attributes))
    out.ambiguous |= len(out.items) > 1 and not (style == "v3" and out.correction)
    if style == "v2":
        out.ambiguous |= len(out.families) > 1
    if style == "v1":  # one slot each: an item brings its family and attributes, and whatever disagrees is ambiguous
        named = [inv.items[i] for i in out.items]
        values: dict[str, set] = {}
        for k, v in [*out.attributes, *(kv for x in named for kv in x["attributes"].items())]:
            values.setdefault(k, set()).add(v)
        out.ambiguous |= len({*out.families, *(x["family"] for x in named)}) > 1 or any(len(v) > 1 for v in values.values())
        out.correction = bool(NEGATING & set(raw))
    out.surface = " ".join(surface) or "<empty>"
    return out


_SIGNATURE = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


@dataclass
class Request:
    """conversation: (role, text) turns up to the user's last; memory; proposal: the reply under review, if any."""

    conversation: list[tuple[str, str]]
    memory: dict = field(default_factory=dict)
    proposal: str | None = None
    allowed: list[str] = field(default_factory=lambda: list(ACTIONS))

    @property
    def said(self) -> str:
        return next((t for r, t in reversed(self.conversation) if r == "user"), "")

    @property
    def state(self) -> str:
        return "reviewing_proposed_answer" if self.proposal is not None else "awaiting_clarification" if self.memory.get("missing_attributes") else "awaiting_request"

    def signature(self) -> str:
        """What two requests must share to use one pattern."""
        m = self.memory
        value = {"state": self.state, "mode": "pre_send_review" if self.proposal is not None else "dialogue_decision", "last_action": m.get("last_robot_action"), "has_proposal": self.proposal is not None}
        value |= {f"has_{k}": bool(m.get(v)) for k, v in (("pending_family", "pending_item_family"), ("resolved_item", "resolved_item_id"), ("missing_attributes", "missing_attributes"))}
        return _SIGNATURE.encode(value)

    def payload(self, inv: Inventory, candidates: list | None = None) -> dict:
        """All that a teacher sees: the last eight turns, memory, candidates (default: all items)."""
        return {"decision_mode": "pre_send_review" if self.proposal is not None else "dialogue_decision", "state": self.state, "allowed_actions": self.allowed, "conversation": [{"role": r, "text": t} for r, t in self.conversation[-8:]], "memory": self.memory, "inventory_candidates": list(inv.items.values()) if candidates is None else candidates, "proposed_robot_answer": self.proposal}


def looks_like_request(text: str) -> bool:
    line = f" {' '.join(tokens(text))} "
    return " get to " not in line and (" is there any " in line or bool(ASKING & set(line.split())))


def _by_words(f: Features, inv: Inventory, pending: str | None = None) -> str | None:
    """One named item, or the one item of the named family with the named attributes."""
    if f.items:
        return only(f.items)
    family = only(f.families) or (pending if f.attributes and not f.families else None)
    found = inv.members(family, dict(f.attributes)) if family else Members(0, [])
    return found.head[0]["id"] if found.count == 1 else None


def resolve(f: Features, q: Request, inv: Inventory, memory: bool = True) -> str | None:
    """The one item that a request is about, from its own words first; never a guess."""
    if f.correction:
        line = " ".join(tokens(q.said))
        meant = next((line[line.rfind(c) + len(c) :] for c in MEANT if c in line), None)
        if meant is not None and (found := _by_words(extract(meant, inv), inv)):
            return found
        rejects_only = any(c in line for c in REJECTS)
        if len(f.items) == 1 and not rejects_only:
            return f.items[0]
        for _, text in [t for t in reversed(q.conversation[:-1]) if t[0] == "user"]:  # what was asked before the rejected reply
            before = extract(text, inv)
            if found := _by_words(before, inv):
                return found
            if before.items or before.families or before.attributes:
                break
    if f.items:
        return only(f.items)
    if found := _by_words(f, inv, q.memory.get("pending_item_family")):
        return found
    if memory and not f.attributes and not f.families and POINTING & set(tokens(q.said)) and q.memory.get("resolved_item_id") in inv.items:
        return q.memory["resolved_item_id"]
    return None


def resolve_family(f: Features, q: Request, inv: Inventory) -> str | None:
    if len(f.families) == 1:
        return f.families[0]
    item = resolve(f, q, inv)
    return inv.items[item]["family"] if item else q.memory.get("pending_item_family")


def review(q: Request, inv: Inventory) -> Features:
    """Features of the user's words, with the proposal typed against what they resolve to."""
    f = extract(q.said, inv)
    if q.proposal is None:
        return f
    item = inv.items.get(resolve(f, q, inv) or "")
    spans, surface = list(inv.spans(tokens(q.proposal), STYLES["v3"])), []
    i = 0
    while i < len(spans):
        kind, values = spans[i]
        if (kind, values) == ("word", ["drawer"]) and i + 1 < len(spans) and spans[i + 1][0] == "word" and spans[i + 1][1][0].isdigit():
            i += 1
            kind, values = "drawer", [f"drawer {spans[i][1][0]}"]  # a number that no item has is still a drawer
        i += 1
        if kind == "word":
            surface += values
        elif kind == "item":
            f.proposed_items = [*f.proposed_items, *values] if f.proposed_items else values
            surface.append("<item>" if item is None else "<item:same>" if values == [item["id"]] else "<item:other>")
        elif kind == "family":
            surface.append("<family:same>" if item and item["family"] in values else "<family>")
        elif kind == "drawer":
            f.proposed_drawers += [normal(v) for v in values]
            right = item and item["drawer"] and normal(item["drawer"])
            surface.append("<drawer>" if not right else "<drawer:match>" if [normal(v) for v in values] == [right] else "<drawer:mismatch>")
        else:
            surface.append(_symbol("v3", kind, values, inv))
    marker = "<request:item>" if item else "<request:family>" if f.families or f.ambiguous else "<request:none>"
    f.surface = f"{marker}{' <request:correction>' if f.correction else ''} || {' '.join(surface) or '<empty>'}"
    return f


# -- validity --------------------------------------------------------------------------------------------------------
def _strings(x) -> bool:
    return isinstance(x, (list, tuple)) and all(isinstance(v, str) for v in x)


SHAPE: list[tuple[str, Callable]] = [
    ("keys", lambda d: list(sorted(d)) != sorted(KEYS)),
    ("action", lambda d: d["action"] not in ACTIONS),
    ("failure_type", lambda d: d["failure_type"] not in FAILURES),
    ("strategy", lambda d: d["recovery_strategy"] not in STRATEGIES),
    ("attributes", lambda d: not isinstance(d["attributes"], dict) or not _strings([*d["attributes"], *d["attributes"].values()])),
    ("missing_attributes", lambda d: not _strings(d["missing_attributes"])),
    ("failure_flag", lambda d: not isinstance(d["failure_detected"], bool)),
]

#: (name, fails): d decision, q request, i inventory.
RULES: list[tuple[str, Callable]] = [
    ("action_not_allowed", lambda d, q, i: d["action"] not in q.allowed),
    ("flag_and_type_disagree", lambda d, q, i: d["failure_detected"] != (d["failure_type"] != "none")),
    ("only_recovery_is_failure", lambda d, q, i: d["failure_detected"] != (d["action"] == "recover")),
    ("strategy_disagrees", lambda d, q, i: (d["action"] == "recover") != (d["recovery_strategy"] != "none")),
    ("locate_without_item", lambda d, q, i: d["action"] == "locate" and d["resolved_item_id"] is None),
    ("item_not_allowed", lambda d, q, i: d["action"] not in ("locate", "recover") and d["resolved_item_id"] is not None),
    ("resolved_but_missing", lambda d, q, i: d["resolved_item_id"] is not None and bool(d["missing_attributes"])),
    ("missing_repeats", lambda d, q, i: len(set(d["missing_attributes"])) < len(d["missing_attributes"])),
    ("known_and_missing", lambda d, q, i: bool(set(d["attributes"]) & set(d["missing_attributes"]))),
    ("unknown_item", lambda d, q, i: d["resolved_item_id"] is not None and d["resolved_item_id"] not in i.items),
    ("item_disagrees", lambda d, q, i: d["resolved_item_id"] is not None and (d["item_family"], d["attributes"]) != (i.items[d["resolved_item_id"]]["family"], i.items[d["resolved_item_id"]]["attributes"])),
    ("unknown_family", lambda d, q, i: _family_only(d) and not i.members(d["item_family"]).count),
    ("unknown_attributes", lambda d, q, i: _family_only(d) and not i.members(d["item_family"], d["attributes"]).count),
    ("unknown_missing", lambda d, q, i: _family_only(d) and not set(d["missing_attributes"]) <= i.keys(d["item_family"])),
    ("context_injected", lambda d, q, i: d["action"] in ("redirect", "cancel") and bool(d["item_family"] or d["attributes"] or d["missing_attributes"])),
]


def _family_only(d: dict) -> bool:
    return d["resolved_item_id"] is None and d["action"] in ("clarify", "recover") and d["item_family"] is not None


def _proposal_is_right(f: Features, item: dict | None) -> bool | None:
    """Whether a proposal names this item's drawer and nothing else; None if it names no drawer."""
    if item is None or any(p != item["id"] for p in f.proposed_items):
        return False
    return all(p == normal(item["drawer"]) for p in f.proposed_drawers) if f.proposed_drawers else None


#: (name, fails): what a decision may claim given the user's own words; a: the item that they resolve to.
TASK: list[tuple[str, Callable]] = [
    ("no_drawer_on_record", lambda d, f, q, i, a: _binds(d) and not i.items[d["resolved_item_id"]]["drawer"]),
    ("item_not_asked_for", lambda d, f, q, i, a: _binds(d) and d["resolved_item_id"] != a),
    ("approves_other_item", lambda d, f, q, i, a: d["action"] == "locate" and q.proposal is not None and any(p != a for p in f.proposed_items)),
    ("approves_wrong_drawer", lambda d, f, q, i, a: d["action"] == "locate" and q.proposal is not None and a is not None and any(p != normal(i.items[a]["drawer"]) for p in f.proposed_drawers)),
    ("right_drawer_is_no_failure", lambda d, f, q, i, a: d["action"] == "recover" and q.proposal is not None and d["failure_type"] == "search_failure" and _proposal_is_right(f, i.items.get(a or "")) is True),
    ("clarifies_one_item", lambda d, f, q, i, a: d["action"] == "clarify" and a is not None),
    ("one_candidate", lambda d, f, q, i, a: d["action"] == "clarify" and d["item_family"] is not None and i.members(d["item_family"]).count < 2 and not d["missing_attributes"]),
    ("clear_request", lambda d, f, q, i, a: d["action"] == "clarify" and d["item_family"] is None and not f.ambiguous and len(f.items) == 1),
    ("match_reported_missing", lambda d, f, q, i, a: d["action"] == "not_found" and bool(f.items or f.families)),
    ("unrelated_reported_missing", lambda d, f, q, i, a: d["action"] == "not_found" and not looks_like_request(q.said)),
    ("missing_with_fields", lambda d, f, q, i, a: d["action"] == "not_found" and bool(d["item_family"] or d["attributes"] or d["missing_attributes"])),
    ("request_redirected", lambda d, f, q, i, a: d["action"] == "redirect" and bool(f.items or f.families or looks_like_request(q.said))),
    ("recovery_without_reason", lambda d, f, q, i, a: d["action"] == "recover" and not (f.correction or q.proposal is not None or q.memory.get("last_robot_action"))),
]


def _binds(d: dict) -> bool:
    return d["action"] in ("locate", "recover") and d["resolved_item_id"] is not None


def parse(raw) -> dict | None:
    """A decision from JSON or a mapping; None for anything else, repeated keys, or text around it."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    try:
        d = json.loads(raw, object_pairs_hook=once) if isinstance(raw, str) else raw
    except ValueError:
        return None
    return d if isinstance(d, dict) else None


def error(raw, q: Request, inv: Inventory, f: Features | None = None, task: bool = True) -> str | None:
    """The name of the first rule that a decision breaks, or None."""
    d = parse(raw)
    if d is None:
        return "no_json_object"
    f = f or review(q, inv)
    if broken := next((n for n, fails in SHAPE if fails(d)), None) or next((n for n, fails in RULES if fails(d, q, inv)), None):
        return broken
    if not task:
        return None
    asked = resolve(f, q, inv)
    return next((n for n, fails in TASK if fails(d, f, q, inv, asked)), None)


def decision(action: str, item: dict | None = None, **more) -> dict:
    own = {"item_family": item["family"], "resolved_item_id": item["id"], "attributes": dict(item["attributes"])} if item else {}
    return {"action": action, "item_family": None, "resolved_item_id": None, "attributes": {}, "missing_attributes": [], "failure_detected": action == "recover", "failure_type": "none", "recovery_strategy": "none"} | own | more


def guard(q: Request, inv: Inventory, f: Features | None = None) -> dict:
    """What follows from the inventory and the dialogue alone."""
    f = f or review(q, inv)
    item = inv.items.get(resolve(f, q, inv) or "")
    failed = lambda kind, strategy: decision("recover", item, failure_type=kind, recovery_strategy=strategy)
    if q.proposal is not None:
        if item is None:
            return failed("comprehension_failure", "clarifying_prompt")
        if any(p != item["id"] for p in f.proposed_items):
            return failed("comprehension_failure", "self_correction")
        right = _proposal_is_right(f, item)
        return decision("locate", item) if right else failed("comprehension_failure", "confidence_check") if right is None else failed("search_failure", "specific_redirection")
    if item:
        return failed("comprehension_failure", "self_correction") if f.correction else decision("locate", item)
    family = resolve_family(f, q, inv)
    if family or f.ambiguous or len(f.items) > 1:
        return decision("clarify", item_family=family, missing_attributes=inv.disagreeing(family) if family else [])
    if looks_like_request(q.said):
        return decision("not_found")
    return decision("cancel" if any(w in normal(q.said) for w in ("cancel", "never mind", "stop the request")) else "redirect")


def guard_error(d: dict, q: Request, inv: Inventory, f: Features | None = None) -> str | None:
    """The rule that the guard's own decision breaks, such as an item without a drawer on record: then nothing valid can be decided."""
    return error(d, q, inv, f)


def checked(raw, q: Request, inv: Inventory, f: Features | None = None) -> tuple[dict, str | None]:
    """The teacher's decision if it breaks no rule, else the guard's and the reason."""
    f = f or review(q, inv)
    reason = error(raw, q, inv, f)
    return (parse(raw), None) if reason is None else (guard(q, inv, f), reason)


# -- templates -------------------------------------------------------------------------------------------------------
def compile_template(d: dict, q: Request, inv: Inventory, f: Features | None = None) -> dict | None:
    """A decision with sources in place of values; None if a value has no source in the request or memory."""
    f, m, out = f or review(q, inv), q.memory, {k: d[k] for k in ("action", "missing_attributes", "failure_detected", "failure_type", "recovery_strategy")}
    item = d["resolved_item_id"]
    sources = {"current_resolution": resolve(f, q, inv, memory=False), "memory_item": m.get("resolved_item_id")}
    out["item"] = "none" if item is None else next((k for k, v in sources.items() if v == item), None)
    family = d["item_family"]
    out["family"] = "resolved_item" if item else "none" if family is None else "current_family" if family in f.families else "memory_family" if family == m.get("pending_item_family") else None
    here, there = dict(f.attributes), m.get("known_attributes") or {}
    out["attributes"] = {} if item else {k: "current" if here.get(k) == v else "memory" if there.get(k) == v else None for k, v in d["attributes"].items()}
    return None if None in (out["item"], out["family"], *out["attributes"].values()) else out


def instantiate(t: dict, q: Request, inv: Inventory, f: Features | None = None) -> dict | None:
    """A decision from a template for another request; None where something doesn't bind."""
    f, m = f or review(q, inv), q.memory
    item = None
    if t["item"] != "none":
        item = inv.items.get((resolve(f, q, inv, memory=False) if t["item"] == "current_resolution" else m.get("resolved_item_id")) or "")
        if item is None:
            return None
    fixed = {k: t[k] for k in ("missing_attributes", "failure_detected", "failure_type", "recovery_strategy")}
    if item:
        return decision(t["action"], item, **fixed)
    family = {"none": None, "resolved_item": None, "current_family": resolve_family(f, q, inv), "memory_family": m.get("pending_item_family")}[t["family"]]
    here, there = dict(f.attributes), m.get("known_attributes") or {}
    values = {k: (here if s == "current" else there).get(k) for k, s in t["attributes"].items()}
    return None if None in values.values() else decision(t["action"], item_family=family, attributes=values, **fixed)


#: What a teacher is told before a payload.
INSTRUCTIONS = {
    "dialogue_decision": "You decide the next step of a robot that tells people where items are. Answer with one JSON object with the keys of a decision, and nothing else.",
    "pre_send_review": "You review the robot's proposed answer before it is sent. Answer with one JSON object with the keys of a decision, and nothing else.",
}
#: Items that a prompt names, at most; ``left_out`` tells how many more there are.
CANDIDATES = 12
#: Ids that are told of the items of a shared name; rules ask for the first ``CANDIDATES`` of two names together.
HEAD = 2 * CANDIDATES


def _near(f: Features, q: Request, inv: Inventory) -> Members:
    """The items that a request may mean."""
    if f.items:
        return Members(len(f.items), [inv.items[i] for i in f.items[:CANDIDATES]])
    families = set(f.families) or ({q.memory["pending_item_family"]} if q.memory.get("pending_item_family") else set())
    found = [inv.members(name, dict(f.attributes)) for name in sorted(families)]
    return Members(sum(m.count for m in found), [x for m in found for x in m.head][:CANDIDATES])


def left_out(f: Features, q: Request, inv: Inventory) -> int:
    return max(0, _near(f, q, inv).count - CANDIDATES)


def prompt(q: Request, f: Features, inv: Inventory) -> str:
    """What a teacher reads: the instruction for the mode, lettered choices among the items that the request may mean, and the payload as compact JSON."""
    near = _near(f, q, inv).head
    choices = [f"{chr(65 + n)}. {x['name']} ({x['drawer'] or 'no drawer on record'})" for n, x in enumerate(near)]
    payload = q.payload(inv, [x["id"] for x in near])
    mode = payload["decision_mode"]
    return "\n".join([INSTRUCTIONS[mode], *(choices or ["No item matches."]), "CONTEXT_JSON:", compact(payload)])


# -- replies and memory ----------------------------------------------------------------------------------------------
#: Replies (fixed texts): {place} is the place of the item, or a request to repeat its name; {name} its name; {known} what was understood.
REPLIES = {
    "redirect": "I can help you locate items in the inventory. Which item do you need?",
    "not_found": "I could not match that request to the inventory. Please check the name or ask a staff member.",
    "cancel": "Okay, I have cancelled this request.",
    "self_correction": "Sorry, I misunderstood. {place}",
    "specific_redirection": "Sorry, let me give the inventory location more clearly. {place}",
    "transparency_cue": "I could not reliably interpret the earlier request. {place}",
    "late": "Sorry for the delay. {place}",
    "confidence_check": "I may have misunderstood. Please confirm {name}.",
    "partial_understanding_repair": "I understood {known}, but I missed a detail. Please repeat the full item name.",
    "clarifying_prompt": "Sorry, I need to clarify. Please repeat the full item name, including any color or size.",
    "guided_reset": "Let's start this request again. Please say the full item name.",
}


def reply(d: dict, inv: Inventory) -> str:
    """What to say; the drawer is always read from the inventory."""
    item = inv.items.get(d["resolved_item_id"] or "")
    if item and not item["drawer"]:
        raise ValueError(f"no drawer on record for {item['id']}")
    place = f"The {item['name']} is listed in {item['drawer']}." if item else "Please repeat the full item name."
    if d["action"] == "locate":
        return place
    if d["action"] == "clarify":
        n, head = inv.members(d["item_family"], d["attributes"])
        if 2 <= n <= 5:
            return f"Do you want {' or '.join(x['name'] for x in head)}?"
        return "Which type do you need? Please give its color, size, or exact name." if n > 5 else "Which item do you mean? Please say its full name and any color or size."
    key = d["action"] if d["action"] != "recover" else "late" if (d["recovery_strategy"], d["failure_type"]) == ("transparency_cue", "timing_failure") else d["recovery_strategy"]
    name = f"that you requested the {item['name']}" if item else "the full item name"
    return REPLIES[key].format(place=place, name=name, known=f"the {d['item_family']}" if d["item_family"] else "part of the request")


EMPTY = {"pending_item_family": None, "known_attributes": {}, "missing_attributes": [], "resolved_item_id": None, "last_robot_action": None, "recovery_count": 0}


def remember(memory: dict, d: dict, *, record_redirect: bool = True) -> dict:
    """Memory after a decision."""
    if d["action"] == "cancel":
        return dict(EMPTY)
    new = {**EMPTY, **memory}
    if d["action"] == "redirect":
        return new | ({"last_robot_action": "redirect"} if record_redirect else {})
    new |= {"last_robot_action": d["action"], "recovery_count": new["recovery_count"] + (d["action"] == "recover")}
    if d["recovery_strategy"] == "guided_reset":
        return new | {k: EMPTY[k] for k in ("pending_item_family", "known_attributes", "missing_attributes", "resolved_item_id")}
    return new | {"pending_item_family": d["item_family"], "known_attributes": dict(d["attributes"]), "missing_attributes": list(d["missing_attributes"]), "resolved_item_id": d["resolved_item_id"]}


def oracle_teacher(inv: Inventory) -> Callable[[Request], str]:
    """A teacher of fixed rules, for tests and dry runs: what follows from the inventory and the dialogue, as JSON."""
    return lambda q: compact(guard(q, inv))


def _said(d: dict, inv: Inventory) -> str:
    item = inv.items.get(d["resolved_item_id"] or "")
    return reply(d, inv) if item is None or item["drawer"] else "I have no place on record for that item."


def session(turns: Iterable[str], inv: Inventory, teacher: Callable[[Request], object] = None) -> list[dict]:
    """A dialogue turn by turn: decide, check, review what would be said, reply, remember; it closes after cancelling or a first recovery."""
    said, memory, out = [], dict(EMPTY), []
    for text in turns:
        said.append(("user", text))
        q = Request(list(said), memory)
        d, reason = checked(teacher(q) if teacher else guard(q, inv), q, inv)
        answer = _said(d, inv)
        if d["action"] == "locate":  # reviewed before it is sent
            d2, _ = checked(guard(Request(list(said), memory, answer), inv), Request(list(said), memory, answer), inv)
            d, answer = (d2, _said(d2, inv)) if d2["action"] == "recover" and inv.items[d["resolved_item_id"]]["drawer"] else (d, answer)
        memory = remember(memory, d)
        said.append(("robot", answer))
        out.append({"text": text, "decision": d, "reply": answer, "reason": reason, "memory": memory})
        if d["action"] in ("cancel", "recover"):
            break
    return out


_JUDGED = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("v3", "v2", "v1", "item", "action", "error", "reply", "signature", "prompt", "template")),
        T.StructField("rebinds", T.BooleanType()),
        *(T.StructField(n, T.StringType()) for n in ("memory", "next_signature", "guard_error")),
        T.StructField("left_out", T.IntegerType()),
    ]
)


_COMPACT = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def compact(x) -> str:
    return _COMPACT.encode(x)


def _values(column: pa.Array) -> list:
    """A column as Python values, its maps as dicts (null: empty)."""
    if pa.types.is_map(column.type):
        at, keys, values = column.offsets.to_pylist(), _values(column.keys), _values(column.items)
        return [dict(zip(keys[a:b], values[a:b], strict=True)) for a, b in zip(at, at[1:], strict=False)]
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def _inventories(items: DataFrame, largest: int) -> dict[str, list] | None:
    """Items by setting, in order, for the tasks; None if there are more than ``largest``."""
    if items.limit(largest + 1).count() > largest:
        return None
    by: dict[str, list] = {}
    table = items.toArrow().sort_by([("setting", "ascending"), ("id", "ascending")])
    for row in zip(*(_values(c.combine_chunks()) for c in table.columns), strict=True):
        x = dict(zip(table.column_names, row, strict=True))
        by.setdefault(x["setting"], []).append(x)
    return by


def judge(requests: DataFrame, items: DataFrame, *, wanted: Iterable[str] | None = None, largest: int = 200_000) -> DataFrame:
    """Requests (id, setting, text, raw; history, an array of (role, text) before the text, memory as JSON, proposal: where given) under all rules.

    items: (setting, id, name, family, attributes map, drawer).  Settings are sent to the tasks with their inventories; over ``largest`` items, requests meet by joins what they speak of (``lookups``).
    Result: id; typed surfaces v3, v2, v1; item; checked action; error of the raw decision; reply; signature; prompt for a teacher; template of the
    decision as JSON (null: a value has no source); whether the template gives the decision back for the same request; memory after it; the signature of what follows; the rule that
    the guard's decision breaks where the guard decided (the action is then no valid one); how many candidates its prompt leaves out.
    wanted: the columns of the result beside id (default: all); what only other columns need isn't worked out.
    """
    names = list(_JUDGED.names if wanted is None else wanted)
    return _with_inventories(requests, items, T.StructType([_JUDGED[n] for n in names]), partial(_judge, wanted=names), largest)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has: a small file is one task, and its rows take long each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Tasks for each core where every row is answered by its setting's inventory: they end together, and few of them start and write for little.
ROUNDS = 4


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``spread`` over fewer tasks, as they share inventories of at most ``largest`` items: some rounds of all cores."""
    spark = rows.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(most, max(32, ROUNDS * spark.sparkContext.defaultParallelism)), key)


#: The inventories of a Python worker, by (broadcast, setting): its tasks build each once.
_made: dict[tuple, Inventory] = {}


def _built(name: str, setting: str, items: Callable[[], dict[str, list]]) -> Inventory:
    """Of this module's own memory, so the function has to be one that tasks import."""
    if _made and next(iter(_made))[0] != name:
        _made.clear()
    if (name, setting) not in _made:
        on = gc.isenabled()
        gc.disable()  # nothing is garbage while an inventory grows
        try:
            _made[name, setting] = Inventory(items().get(setting, []))
        finally:
            if on:
                gc.enable()
        gc.freeze()  # a worker collects garbage after each task, and would walk the whole inventory again
    return _made[name, setting]


def _shared(spark, items: dict[str, list]) -> Callable[[str], Inventory]:
    """A function for tasks, setting -> inventory; the items are sent to the executors once."""
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    return lambda setting: _built(name, setting, lambda: shared.value)


#: What a row tells a rule, in this order.
GIVEN = ["setting", "text", "raw", "history", "memory", "proposal"]


def _texts(row: Iterable, view) -> list[str]:
    """What a rule reads of a row: the user's words, all of them together too, the turns, and the proposal."""
    _, text, _, history, _, proposal = row
    said = [(t["role"], t["text"]) for t in history] if history is not None else []
    return [text, *(t for _, t in said), proposal] + ([" \n ".join([t for r, t in said if r == "user"] + [text or ""])] if said else [])


def _with_inventories(requests: DataFrame, items: DataFrame, schema: T.StructType, rule: Callable, largest: int) -> DataFrame:
    """id and ``schema`` by rule(values of ``GIVEN``, inventory of the setting) -> tuple."""
    given = lambda name, kind: (F.col(name) if name in requests.columns else F.lit(None)).cast(kind).alias(name)
    asked = requests.select("id", "setting", "text", given("raw", "string"), given("history", "array<struct<role:string,text:string>>"), given("memory", "string"), given("proposal", "string"))
    found = _inventories(items, largest)
    if found is None:
        from .lookups import by_lookup

        return by_lookup(asked, ["id"], GIVEN, items, schema, rule, _texts)
    inventory = _shared(requests.sparkSession, found)

    @pandas_udf(schema)
    def run(*given: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(row, inventory(row[0])) for row in zip(*given, strict=True)], columns=schema.names, dtype=object)

    return _dealt(asked, "id").select("id", run(*GIVEN).alias("j")).select("id", "j.*")


def _request(row: Iterable) -> Request:
    _, text, _, history, memory, proposal = row
    said = [(t["role"], t["text"]) for t in history] if history is not None else []
    return Request([*said, ("user", text or "")], json.loads(memory) if memory else {}, proposal)


_UNDERSTOOD = T.StructType(
    [
        T.StructField("surface", T.StringType()),
        *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("items", "families", "proposed_items", "proposed_drawers")),
        *(T.StructField(n, T.BooleanType()) for n in ("ambiguous", "correction", "request_like", "proposal_right")),
        *(T.StructField(n, T.StringType()) for n in ("asked", "asked_drawer", "family")),
    ]
)


def _understand(row: tuple, inv: Inventory) -> tuple:
    q = _request(row)
    f = review(q, inv)
    asked = resolve(f, q, inv)
    item = inv.items.get(asked or "")
    return (f.surface, f.items[:HEAD], f.families, f.proposed_items[:HEAD], f.proposed_drawers, f.ambiguous, f.correction, looks_like_request(q.said), _proposal_is_right(f, item), asked, normal(item["drawer"]) if item else None, resolve_family(f, q, inv))


def understood(requests: DataFrame, items: DataFrame, *, largest: int = 200_000) -> DataFrame:
    """What requests name and resolve to, for rules in columns (``decision_columns``): id and ``_UNDERSTOOD``.  Of a shared name's items the first ``HEAD`` are told:
    rules ask whether there is none, one or another than the one asked for."""
    return _with_inventories(requests, items, _UNDERSTOOD, _understand, largest)


class _Case:
    """A request under all rules; each part is worked out when it is first asked for."""

    def __init__(self, row: tuple, inv: Inventory):
        self.q, self.text, self.raw, self.inv = _request(row), row[1], row[2], inv

    @cached_property
    def f(self) -> Features:
        return review(self.q, self.inv)

    @cached_property
    def checked(self) -> tuple[dict, str | None]:
        return checked(self.raw, self.q, self.inv, self.f)

    @cached_property
    def answer(self) -> str:
        return _said(self.checked[0], self.inv)

    @cached_property
    def template(self) -> dict | None:
        return compile_template(self.checked[0], self.q, self.inv, self.f)

    @cached_property
    def after(self) -> dict:
        return remember(self.q.memory, self.checked[0])

    def again(self) -> dict | None:
        return instantiate(self.template, self.q, self.inv, self.f) if self.template else None

    def guard_error(self) -> str | None:
        return guard_error(self.checked[0], self.q, self.inv, self.f) if self.checked[1] else None


#: The columns of ``_JUDGED``.
_PARTS: dict[str, Callable[[_Case], object]] = {
    "v3": lambda c: c.f.surface,
    "v2": lambda c: extract(c.text, c.inv, "v2").surface,
    "v1": lambda c: extract(c.text, c.inv, "v1").surface,
    "item": lambda c: resolve(c.f, c.q, c.inv),
    "action": lambda c: c.checked[0]["action"],
    "error": lambda c: c.checked[1],
    "reply": lambda c: c.answer,
    "signature": lambda c: c.q.signature(),
    "prompt": lambda c: prompt(c.q, c.f, c.inv),
    "template": lambda c: compact(c.template) if c.template else None,
    "rebinds": lambda c: c.again() == c.checked[0],
    "memory": lambda c: compact(c.after),
    "next_signature": lambda c: Request([*c.q.conversation, ("robot", c.answer)], c.after).signature(),
    "guard_error": lambda c: c.guard_error(),
    "left_out": lambda c: left_out(c.f, c.q, c.inv),
}


def _judge(row: tuple, inv: Inventory, wanted: Iterable[str] = tuple(_PARTS)) -> tuple:
    case = _Case(row, inv)
    return tuple(_PARTS[n](case) for n in wanted)


def _judged(rows: Iterable[tuple], inventory: Callable[[str], Inventory]) -> pd.DataFrame:
    """``_JUDGED`` of (setting, text, raw, history, memory, proposal)."""
    return pd.DataFrame([_judge(row, inventory(row[0])) for row in rows], columns=_JUDGED.names)


#: Upper ends of the classes of waiting times, in milliseconds.
TIMING_EDGES = (1000, 3000, 7000, 15000)


def relation(asked: Features, answer: Features, text: str, inv: Inventory) -> str:
    """What an answer says about the place of the item that was asked for last."""
    wanted, told = (f.items[-1] if f.items else None for f in (asked, answer))
    if wanted is None:
        return "unverifiable"
    if told is None:
        return "missing_item"
    if wanted != told:
        return "wrong_item"
    words = tokens(text)
    place = next((f"drawer {n}" for d, n in zip(words, words[1:], strict=False) if d == "drawer" and n.isdigit()), None)
    return "same_item_no_drawer" if place is None else "correct" if place == normal(inv.items[wanted]["drawer"]) else "wrong_drawer"


def timing_class(ms: float | None) -> str:
    if ms is None or ms != ms or ms in (float("inf"), float("-inf")):
        return "missing"
    low = 0
    for edge in TIMING_EDGES:
        if ms <= edge:
            return f"{low}-{edge}ms"
        low = edge
    return f">{low}ms"


def feature_bundle(q: Request, inv: Inventory, ms: float | None) -> dict:
    """All that a typed key of the second cache is made from: the user's last words, all of them, the reply before and the one proposed, typed; the last eight
    turns typed; what the replies say about the item asked for; and how long the last reply took."""
    typed = lambda text: extract(text, inv, "v2")
    before = next((t for r, t in reversed(q.conversation[:-1]) if r == "robot"), "")
    every = typed(" \n ".join(t for r, t in q.conversation if r == "user"))
    proposed = q.proposal or ""
    return {
        "current": typed(q.said).surface,
        "all_user": every.surface,
        "previous_robot": typed(before).surface,
        "proposal": typed(proposed).surface,
        "history": [f"{r}:{typed(t).surface}" for r, t in q.conversation[-8:]],
        "proposal_relation": relation(every, typed(proposed), proposed, inv) if q.proposal is not None else "none",
        "prior_relation": relation(every, typed(before), before, inv) if before else "none",
        "timing": timing_class(ms),
    }


_BUNDLE = T.StructType([*(T.StructField(n, T.StringType()) for n in ("current", "all_user", "previous_robot", "proposal")), T.StructField("history", T.ArrayType(T.StringType())), *(T.StructField(n, T.StringType()) for n in ("proposal_relation", "prior_relation", "timing"))])


def _bundle(row: tuple, inv: Inventory) -> tuple:
    q, raw = _request(row), row[2]
    return tuple(feature_bundle(Request(q.conversation, {}, q.proposal), inv, float(raw) if raw else None).values())


def bundles(requests: DataFrame, items: DataFrame, *, largest: int = 200_000) -> DataFrame:
    """id and ``_BUNDLE`` of requests (id, setting, text; history, proposal, latency_ms: where given)."""
    ms = (F.col("latency_ms") if "latency_ms" in requests.columns else F.lit(None)).cast("string").alias("raw")
    return _with_inventories(requests.select(*(c for c in requests.columns if c not in ("raw", "latency_ms")), ms), items, _BUNDLE, _bundle, largest)


_TURN = T.StructType([T.StructField("turn", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("text", "action", "item", "reply", "memory")), T.StructField("closes", T.BooleanType())])


def sessions(turns: DataFrame, items: DataFrame, *, teacher: Callable[[Inventory], Callable[[Request], object]] = oracle_teacher, largest: int = 200_000) -> DataFrame:
    """(session, turn, text, action, item, reply, memory, closes) of interactive sessions, replayed: turns has (session, setting, turn, text), the user's side.

    A session is decided in order, so its turns come together; sessions are independent and spread over the tasks.  Turns after one that closes aren't answered.
    """
    by = turns.groupBy("session", "setting").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("said"))
    kind = T.StructType([T.StructField("t", T.ArrayType(_TURN))])

    def rule(row: tuple, inv: Inventory) -> tuple:
        steps = session(list(row[1]), inv, teacher(inv))
        return ([(n, x["text"], x["decision"]["action"], x["decision"]["resolved_item_id"], x["reply"], compact(x["memory"]), x["decision"]["action"] in ("cancel", "recover")) for n, x in enumerate(steps)],)

    found = _inventories(items, largest)
    if found is None:
        from .lookups import by_lookup

        # replies are reviewed, so those on the items that are known by now are read ahead
        texts = lambda row, view: [*row[1], *(_said(decision("locate", x), view) for x in view.items.own.values())]
        done = by_lookup(by, ["session"], ["setting", "said"], items, kind, rule, texts)
    else:
        inventory = _shared(turns.sparkSession, found)

        @pandas_udf(kind)
        def run(settings: pd.Series, said: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rule(row, inventory(row[0])) for row in zip(settings, said, strict=True)], columns=["t"], dtype=object)

        done = spread(by, "session").select("session", run("setting", "said")["t"].alias("t"))
    return done.select("session", F.explode("t").alias("t")).select("session", "t.*")


def record_text(said: Column, stage: Column, source: Column, action: Column, item: Column, failure: Column, strategy: Column, note: Column, answer: Column) -> Column:
    """A turn for people to read: what the user said, how it was decided, and the reply; parts that don't apply are left out."""
    part = lambda name, c: F.when(c.isNotNull() & (c != "none"), F.concat(F.lit(f" {name}="), c)).otherwise("")
    tag = F.concat(F.lit("       ["), stage, F.lit(":"), part("source", source), part("action", action), part("item", item), part("failure", failure), part("strategy", F.when(failure != "none", strategy)), part("note", note), F.lit("]"))
    return F.concat_ws("\n", F.concat(F.lit("You:   "), said), tag, F.concat(F.lit("Robot: "), answer))
