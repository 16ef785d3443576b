"""State machines that learn reusable request patterns from an ordered stream of turns.

Each is a plain object with ``turn(row) -> row`` and a state that fits JSON, so the same step runs in a batch replay
(``replay``) and in Structured Streaming (``stream``).
"""

import hashlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np


class Group:
    """The patterns of one state signature: their numbers, their centroids as one matrix, and which are active."""

    def __init__(self, dim: int):
        self.numbers: list[int] = []
        self.slot: dict[int, int] = {}
        self._rows, self._active = np.empty((4, dim)), np.zeros(4, bool)

    def __len__(self) -> int:
        return len(self.numbers)

    @property
    def rows(self) -> np.ndarray:
        return self._rows[: len(self.numbers)]

    @property
    def active(self) -> np.ndarray:
        return self._active[: len(self.numbers)]

    def add(self, number: int, centroid, active: bool) -> None:
        n = len(self.numbers)
        if n == len(self._rows):
            self._rows, self._active = np.concatenate([self._rows, np.empty_like(self._rows)]), np.concatenate([self._active, np.zeros(n, bool)])
        self._rows[n], self._active[n] = centroid, active
        self.slot[number] = n
        self.numbers.append(number)

    def cosines(self, vector: np.ndarray) -> np.ndarray:
        """Each row on its own, so that the result doesn't depend on what else is in the matrix."""
        return np.einsum("ij,j->i", self.rows, vector)


@dataclass
class SemanticCache:
    """Patterns of (state, successor, template) around a centroid; served above ``route``, merged above ``merge``.

    A pattern is active when it has ``least`` observations from as many distinct pieces of evidence and a smoothed reliability
    of ``admit``; one that comes from a seed is active until an audit fails.  Turn columns: state, successor, template,
    valid (templates that bind and validate for this turn), vector, evidence, seed.

    A turn looks at the patterns of its state alone, through one matrix; counts are kept, not counted; of evidence no more is kept than
    ``least`` distinct pieces, after which more can't matter.
    """

    merge: float = 0.85
    route: float = 0.78
    admit: float = 0.85
    least: int = 2
    learn: bool = True
    patterns: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self._known, self._groups, self._active = None, {}, 0

    # how patterns are found and kept; a stream keeps them in Spark's state (``pattern_state``)
    def _pattern(self, number: int) -> dict:
        return self.patterns[number]

    def _size(self) -> int:
        return len(self.patterns)

    def _group(self, state: str) -> Group | None:
        if self._known is not self.patterns:  # restored from a snapshot
            self._known, self._groups, self._active = self.patterns, {}, sum(p["active"] for p in self.patterns)
            for i, p in enumerate(self.patterns):
                self._groups.setdefault(p["state"], Group(len(p["centroid"]))).add(i, p["centroid"], p["active"])
        return self._groups.get(state)

    def _add(self, p: dict) -> int:
        number = self._size()
        self.patterns.append(p)
        self._groups.setdefault(p["state"], Group(len(p["centroid"]))).add(number, p["centroid"], p["active"])
        return number

    def _changed(self, number: int, moved: bool) -> None:
        """Called after each change of a pattern; moved: its centroid too."""

    @staticmethod
    def reliability(p: dict) -> float:
        return (p["k"] + 1) / (p["n"] + 2)

    def _status(self, p: dict) -> bool:
        ready = p["n"] >= self.least and len(p["evidence"]) >= self.least and self.reliability(p) >= self.admit
        return (p["seed"] and not p["failed_audits"]) or ready

    def _observe(self, number: int, vector: np.ndarray, success: bool, evidence: str) -> None:
        p = self._pattern(number)
        group = self._group(p["state"])
        if success:  # the first observation weighs its vector twice, which leaves its direction
            moved = np.array(p["centroid"]) * max(1, p["n"]) + vector
            size = float(np.sqrt((moved**2).sum())) or 1.0
            p["centroid"] = (moved / size).tolist()
            group._rows[group.slot[number]] = p["centroid"]
        p["n"] += 1
        p["k"] += int(success)
        if len(p["evidence"]) < self.least and evidence not in p["evidence"]:
            p["evidence"].append(evidence)
        active = self._status(p)
        self._active += active - p["active"]
        p["active"] = group._active[group.slot[number]] = active
        self._changed(number, success)

    def feedback(self, number: int, success: bool, evidence: str) -> None:
        p = self._pattern(number)
        p["failed_audits"] += not success
        self._observe(number, np.array(p["centroid"]), success, evidence)

    def _first_that_holds(self, group: Group, cosines: np.ndarray, valid) -> tuple[int, float] | None:
        """The best active pattern over ``route``, by (cosine, reliability, age), whose template holds for the turn."""
        over = np.flatnonzero((cosines >= self.route) & group.active)
        for cos, _, i in sorted(((float(cosines[s]), self.reliability(self._pattern(group.numbers[s])), -group.numbers[s]) for s in over), reverse=True):
            if self._pattern(-i)["template"] in valid:
                return -i, cos
        return None

    def turn(self, row: dict) -> dict:
        vector, source, best, served = np.asarray(row["vector"], float), "slm", None, None
        group = self._group(row["state"])
        cosines = group.cosines(vector) if group else None
        found = self._first_that_holds(group, cosines, row["valid"]) if group and not row.get("seed") else None
        if found:
            source, (served, best) = "fsm", found
            self._pattern(served)["served"] += 1
            self._changed(served, False)
        elif self.learn:
            served = self._learn(row, vector, group, cosines)
            group = self._group(row["state"])  # as logged: after learning
            best = max(group.cosines(vector)[group.active].tolist(), default=None)
        return {"position": row["position"], "source": source, "pattern": served, "similarity": best, "active": self._active, "candidates": self._size() - self._active}

    def _learn(self, row: dict, vector: np.ndarray, group: Group | None, cosines: np.ndarray | None) -> int:
        key, number = (row["successor"], row["template"]), None
        for cos, i in sorted(((float(cosines[s]), -group.numbers[s]) for s in np.flatnonzero(cosines >= self.merge)), reverse=True) if group else ():
            p = self._pattern(-i)
            if (p["successor"], p["template"]) == key:
                number = -i
                break
        if number is None:
            number = self._add({"state": row["state"], "successor": row["successor"], "template": row["template"], "centroid": vector.tolist(), "n": 0, "k": 0, "evidence": [], "seed": bool(row.get("seed")), "failed_audits": 0, "served": 0, "active": False})
        self._observe(number, vector, row["template"] in row["valid"], str(row["evidence"]))
        return number


@dataclass(frozen=True)
class Thresholds:
    agreements: int
    shadow: int
    successes: int
    evidence: int
    wilson: float
    audit: float


#: Presets (fixed values): routine and risky thresholds (the last one is the share of served turns that are audited), and whether promotion needs verified outcomes.
POLICIES = {
    "research": (Thresholds(20, 20, 35, 35, 0.90, 0.05), Thresholds(40, 40, 189, 189, 0.98, 0.10), True),
    "development": (Thresholds(2, 1, 2, 2, 0.34, 0.05), Thresholds(3, 2, 3, 3, 0.43, 0.10), True),
    "calibrated": (Thresholds(5, 2, 5, 5, 0.55, 0.05), Thresholds(10, 3, 10, 10, 0.72, 0.10), True),
    "imitation": (Thresholds(8, 3, 0, 8, 0.0, 0.05), Thresholds(15, 5, 0, 15, 0.0, 0.10), False),
}


def wilson(k: int, n: int, z: float = 1.96) -> float:
    if not n:
        return 0.0
    p = k / n
    return max(0.0, (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n))


@dataclass
class Lifecycle:
    """Entries by (level, key): candidate, shadow, active, quarantined; a quarantined key starts a new generation.

    Turn columns: exact, typed (keys), decision, risky, evidence, success (null: no outcome reported).  Exact entries go before typed ones.

    With ``audit``, a share of the turns that an entry would serve, drawn by a hash of the turn, asks the teacher too; if it disagrees,
    its decision is returned and every active entry of the turn's keys with the cached decision is quarantined.  With ``siblings``, the
    outcome of a served turn likewise belongs to all of those entries; without, to the served one alone.
    """

    policy: str = "imitation"
    learn: bool = True
    audit: bool = True
    siblings: bool = False
    entries: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        self._known, self._counts = None, Counter()

    def counts(self) -> Counter:
        """Entries by status: kept up to date, and counted once after a snapshot was put in."""
        if self._known is not self.entries:
            self._known, self._counts = self.entries, Counter(e["status"] for e in self.entries.values())
        return self._counts

    def _set(self, e: dict, status: str) -> None:
        counts = self.counts()
        counts[e["status"]] -= 1
        counts[status] += 1
        e["status"] = status

    def _ready(self, e: dict) -> bool:
        routine, risky, verified = POLICIES[self.policy]
        t = risky if e["risky"] else routine
        ok = e["agree"] >= t.agreements and e["shadow"] >= t.shadow and not e["missed"] and len(e["evidence"]) >= t.evidence and not e["failures"]
        return ok and (not verified or (e["successes"] >= t.successes and wilson(e["successes"], e["successes"] + e["failures"]) >= t.wilson))

    def _promote(self, e: dict, activate: bool) -> None:
        if e["status"] == "quarantined":
            return
        routine, risky, _ = POLICIES[self.policy]
        if e["status"] == "candidate" and e["agree"] >= (risky if e["risky"] else routine).agreements:
            self._set(e, "shadow")
        if activate and e["status"] in ("candidate", "shadow") and self._ready(e):
            self._set(e, "active")

    def _observe(self, key: str, row: dict) -> None:
        e = self.entries.get(key)
        if e is None or e["status"] == "quarantined":
            generation = e["generation"] + 1 if e else 0
            counts = self.counts()
            counts["quarantined"] -= e is not None
            counts["candidate"] += 1
            e = self.entries[key] = {"status": "candidate", "decision": row["decision"], "risky": bool(row["risky"]), "agree": 1, "shadow": 0, "missed": 0, "successes": 0, "failures": 0, "audit_matches": 0, "audit_misses": 0, "evidence": [], "generation": generation}
        elif e["decision"] == row["decision"]:
            e["agree"] += 1
            e["shadow"] += e["status"] == "shadow"  # only what is seen after the shadow stage began
        else:
            e["missed"] += e["status"] == "shadow"
            self._set(e, "quarantined")
        routine, risky, _ = POLICIES[self.policy]
        if len(e["evidence"]) < (risky if e["risky"] else routine).evidence and str(row["evidence"]) not in e["evidence"]:  # more can't matter
            e["evidence"].append(str(row["evidence"]))
        self._promote(e, activate=not POLICIES[self.policy][2])

    def freeze(self, audits: bool = False) -> None:
        self.learn, self.audit = False, audits

    def unfreeze(self, audits: bool = True) -> None:
        self.learn, self.audit = True, audits

    def _audited(self, e: dict, row: dict) -> bool:
        routine, risky, _ = POLICIES[self.policy]
        drawn = hashlib.sha256(f"audit:{row['position']}:{row['evidence']}".encode()).digest()[:4]
        return self.audit and int.from_bytes(drawn, "big") < (risky if e["risky"] else routine).audit * 2**32

    def turn(self, row: dict) -> dict:
        keys = [f"exact:{row['exact']}", f"typed:{row['typed']}"]
        active = [k for k in keys if (e := self.entries.get(k)) and e["status"] == "active"]
        source, decision, behind = "slm", row["decision"], []  # behind: the entries that an outcome belongs to
        if active:
            served, cached = active[0], self.entries[active[0]]["decision"]
            same = [k for k in active if self.entries[k]["decision"] == cached]
            audited = self._audited(self.entries[served], row)
            if audited and cached != row["decision"]:
                source = "slm_audit_fallback"
                for k in same:
                    self.entries[k]["audit_misses"] += 1
                    self._set(self.entries[k], "quarantined")
            else:
                self.entries[served]["audit_matches"] += audited
                source, decision = f"fsm_{served.split(':')[0]}" + "_audited" * audited, cached
                behind = same if self.siblings else [served]
        elif self.learn:
            behind = keys
            for k in keys:
                self._observe(k, row)
        if row.get("success") is not None:
            for k in behind:
                e = self.entries[k]
                if row["success"]:
                    e["successes"] += 1
                    self._promote(e, activate=True)
                else:
                    e["failures"] += 1
                    self._set(e, "quarantined")
        counts = self.counts()
        return {"position": row["position"], "source": source, "decision": decision, "active": counts["active"], "shadow": counts["shadow"], "quarantined": counts["quarantined"]}


@dataclass
class HeatCache:
    """Candidates with decaying heat, a shadow test before promotion, and demotion when a served answer is wrong.

    A turn is predicted, then scored, then shadow-tested, then learnt from.  Turn columns: key (state and template), surface, example, variant, decision, ok.
    """

    decay: float = 0.995
    confirmed: int = 2
    shadow: int = 1
    examples: int = 2
    variants: int = 2
    accuracy: float = 1.0
    heat: float = 1.5
    patterns: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        self._known, self._promoted = None, 0

    def promoted(self) -> int:
        if self._known is not self.patterns:  # restored from a snapshot
            self._known, self._promoted = self.patterns, sum(p["status"] == "promoted" for p in self.patterns.values())
        return self._promoted

    def _cool(self, p: dict, step: int) -> None:
        p["heat"] *= self.decay ** max(0, step - p["last"])
        p["last"] = step

    def _promote(self, p: dict, step: int) -> None:
        self._cool(p, step)
        trials = p["right"] + p["wrong"]
        if p["status"] == "candidate" and p["confirmed"] >= self.confirmed and trials >= self.shadow and len(p["examples"]) >= self.examples and len(p["variants"]) >= self.variants and p["right"] >= self.accuracy * trials and p["heat"] >= self.heat:
            self.promoted()
            p["status"] = "promoted"
            self._promoted += 1

    def turn(self, row: dict) -> dict:
        step, p = int(row["position"]), self.patterns.get(row["key"])
        source = "fsm" if p and p["status"] == "promoted" else "slm"
        if source == "fsm":
            if p["decision"] != row["decision"]:
                self.promoted()
                self._promoted -= 1
                p.update(status="candidate", heat=p["heat"] * 0.5, last=step)
        elif p:
            same = p["decision"] == row["decision"]
            p["right"] += same
            p["wrong"] += not same
            self._promote(p, step)
        if row["ok"]:
            if p is None:
                p = self.patterns[row["key"]] = {"decision": row["decision"], "status": "candidate", "confirmed": 0, "right": 0, "wrong": 0, "heat": 0.0, "last": step, "examples": [], "variants": []}
            self._cool(p, step)
            for name, v, enough in (("examples", row["example"], self.examples), ("variants", row["variant"], self.variants)):
                if len(p[name]) < enough and v not in p[name]:  # more can't matter
                    p[name].append(v)
            p["confirmed"] += 1
            p["heat"] += 1.0
            self._promote(p, step)
        return {"position": step, "source": source, "promoted": self.promoted(), "heat": p["heat"] if p else 0.0}
