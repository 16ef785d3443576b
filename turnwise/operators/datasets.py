"""Builders of data sets: derived families, seeds and streams of requests, cases, and audits."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import SPAN, interleave, position

#: For each step of the ladder its family, what it applies to (a word in the name, or ids), and attributes by what the name or id shows.
COLORS = {"pencil": ["blue", "orange", "red", "yellow"], "tape": ["blue", "white"], "marker": ["blue"], "multimeter": ["orange"]}
TAPES = ["blue_tape", "white_tape", "medical_tape"]
SYRINGES = {"6_ml_syringe": {"size": "6 ml"}, "1_ml_tuberculin_syringe": {"size": "1 ml", "type": "tuberculin"}, "line_draw_arterial_blood_sample_syringe": {"type": "blood sample"}}


def with_family(items: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``items`` with ``family`` and ``attributes`` (a map), derived from id and name; a name that no step knows is a family of its own."""
    item, name = F.col(id_col), F.lower(name_col)
    first = F.split(name, " ")[0]
    pair = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(v))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    color = lambda family: F.when(first.isin(*COLORS[family]), pair("color", first))
    known = F.lit(None).cast("map<string,string>")
    for key, values in SYRINGES.items():
        known = F.when(item == key, F.create_map(*(F.lit(x) for kv in values.items() for x in kv))).otherwise(known)
    steps: list[tuple[str, Column, Column | None]] = [
        ("pencil", name.contains("pencil"), color("pencil")),
        ("tape", item.isin(*TAPES), F.coalesce(color("tape"), F.when(name.contains("medical"), pair("type", F.lit("medical"))))),
        ("syringe", name.contains("syringe"), known),
        ("marker", name.contains("marker"), color("marker")),
        ("multimeter", name.contains("multimeter"), color("multimeter")),
        ("gloves", name.contains("glove"), F.when(name.contains("surgical"), pair("type", F.lit("surgical")))),
        ("mask", name.contains("mask"), None),
    ]
    family, attributes = F.replace(item, F.lit("_"), F.lit(" ")), none
    for label, applies, values in reversed(steps):
        family = F.when(applies, F.lit(label)).otherwise(family)
        attributes = F.when(applies, F.coalesce(values, none) if values is not None else none).otherwise(attributes)
    return items.select("*", family.alias("family"), attributes.alias("attributes"))


# -- dialogues -------------------------------------------------------------------------------------------------------
#: A robot's turn that names a drawer.
DRAWER = r"(?i)\bdrawers? (number )?(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b"
TURNS = "array<struct<role:string,text:string>>"


def _places(turns: Column, test: Callable[[Column], Column]) -> Column:
    """Places, from 0, of the turns for which a test holds."""
    marked = F.transform(turns, lambda t, i: F.struct(i.alias("i"), test(t).alias("x")))
    return F.transform(F.filter(marked, lambda m: m["x"]), lambda m: m["i"])


def _first(turns: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_min(_places(turns, test))


def _user(t: Column) -> Column:
    return t["role"].isin("participant", "user")


def request_and_proposal(turns: Column) -> tuple[Column, Column]:
    """The user's last turn before the robot first names a drawer, and that robot's turn; both null where there is none."""
    at = _first(turns, lambda t: (t["role"] == "robot") & t["text"].rlike(DRAWER))
    before = F.filter(F.slice(turns, F.lit(1), F.coalesce(at, F.lit(0))), _user)
    request = F.when(F.size(before) > 0, F.element_at(before, -1)["text"])
    return request, F.when(request.isNotNull(), F.get(turns, at)["text"])


def decision_boundary(turns: Column) -> tuple[Column, Column, Column]:
    """History up to the last turn that isn't the robot's, the robot's turns after it as one text, and whether that last turn is a user's."""
    last = F.coalesce(F.array_max(_places(turns, lambda t: t["role"] != "robot")), F.lit(-1))
    history, after = F.slice(turns, F.lit(1), last + 1), F.slice(turns, last + 2, F.greatest(F.size(turns) - last - 1, F.lit(0)))
    proposal = F.nullif(F.trim(F.array_join(F.transform(after, lambda t: t["text"]), " ")), F.lit(""))
    return history, proposal, F.coalesce(_user(F.get(turns, last)), F.lit(False))


def clean_prefix(turns: Column, end: Column) -> tuple[Column, Column]:
    """Turns (role, text, start, end, flags) up to place ``end``, and the reason why they can't be used; one of the two is null.

    Operators' turns go; turns of one speaker from one span are joined; the first turn that breaks a rule names the reason.
    """
    some = F.slice(turns, F.lit(1), end + 1)
    flags = lambda t: F.coalesce(t["flags"], F.array().cast("array<string>"))
    broken = lambda t: (
        F.when(F.array_contains(flags(t), "next_trial"), "crosses_next_trial")
        .when(t["role"] == "operator", F.lit(None))
        .when(t["role"].isNull() | (F.size(flags(t)) > 0), "unresolved_role_or_source_span")
        .when(~t["role"].isin("participant", "robot"), "invalid_speaker")
        .when(F.trim(t["text"]) == "", "empty_source_turn")
    )
    reason = F.get(F.filter(F.transform(some, broken), lambda r: r.isNotNull()), F.lit(0))
    own = F.transform(F.filter(some, lambda t: ~(t["role"] == "operator")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end")))
    last = lambda a: F.element_at(a, -1)
    same = lambda a, t: F.coalesce((F.size(a) > 0) & last(a)["role"].eqNullSafe(t["role"]) & last(a)["start"].eqNullSafe(t["start"]) & last(a)["end"].eqNullSafe(t["end"]), F.lit(False))
    longer = lambda a, t: F.struct(t["role"].alias("role"), F.concat(last(a)["text"], F.lit(" "), t["text"]).alias("text"), t["start"].alias("start"), t["end"].alias("end"))
    joined = F.aggregate(own, F.slice(own, F.lit(1), F.lit(0)), lambda a, t: F.when(same(a, t), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(longer(a, t)))).otherwise(F.concat(a, F.array(t))))
    reason = F.coalesce(reason, F.when(~F.exists(joined, _user), "no_participant_request"))
    return F.when(reason.isNull(), joined), reason


# -- seeds and streams -----------------------------------------------------------------------------------------------
def seeds(trials: DataFrame, items: DataFrame, resolved: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row for each seed, and one with a reason for each trial without any: (trial, id, kind, item, request, proposal, reason).

    trials: (trial, setting, turns, reviewed_item).  ``resolved`` gives (id, item) of requests (id, setting, text).  A trial counts if its wording alone resolves
    to the item that it was reviewed with, or, without a review, to any; it gives a request, and a review where the robot proposed a drawer.
    """
    request, proposal = request_and_proposal(F.col("turns"))
    t = trials.select("trial", "setting", "reviewed_item", request.alias("request"), proposal.alias("proposal"))
    found = resolved(t.filter("request IS NOT NULL").select(F.col("trial").alias("id"), "setting", F.col("request").alias("text"))).select(F.col("id").alias("trial"), F.col("item").alias("wording"))
    settings = items.select("setting").distinct().withColumn("known_setting", F.lit(True))
    known = items.select("setting", F.col("id").alias("item"), F.lit(True).alias("known_item"))
    t = t.join(found, "trial", "left").withColumn("item", F.coalesce("reviewed_item", "wording")).join(settings, "setting", "left").join(known, ["setting", "item"], "left")
    reason = F.when(F.col("known_setting").isNull(), "unknown_setting").when(F.col("request").isNull() | F.col("known_item").isNull(), "no_resolved_request").when(~F.col("wording").eqNullSafe(F.col("item")), "request_does_not_resolve_target")
    kinds = F.when(reason.isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.when(F.col("proposal").isNotNull(), F.array(F.lit("request"), F.lit("review"))).otherwise(F.array(F.lit("request"))))
    rows = t.withColumn("reason", reason).withColumn("kind", F.explode(kinds))
    return rows.select("trial", F.when(F.col("kind").isNotNull(), F.concat_ws(":", F.lit("seed"), F.col("trial").cast("string"), "kind")).alias("id"), "kind", F.when(F.col("kind").isNotNull(), F.col("item")).alias("item"), "request", F.when(F.col("kind") == "review", F.col("proposal")).alias("proposal"), "reason")


def fold_of(participants: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """``participants`` with ``split`` by the fold that names them (test_participants, validation_participants: arrays); train where none does."""
    listed = lambda c, s: folds.select(F.explode(c).alias(key), F.lit(s).alias("split"))
    named = listed("test_participants", "test").unionByName(listed("validation_participants", "validation"))
    return participants.join(named, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def stream(trials: DataFrame, augmented: DataFrame, folds: DataFrame) -> DataFrame:
    """(position, id, kind, split, reference_item, reference_action, proposal): a request and a review for each trial that ends with the robot, in the order of
    participants and trials, with the augmented rows spread evenly among them.

    trials: (trial, participant, turns, item), item being what the wording resolves to; augmented: (id, action).
    """
    _, proposal, user = decision_boundary(F.col("turns"))
    usable = trials.withColumn("proposal", proposal).filter(user & F.col("proposal").isNotNull())
    own = position(usable, [F.col("participant"), F.floor(F.col("trial") / SPAN)], ["trial"])
    own = fold_of(own, folds, "participant").select("position", F.col("trial").cast("string").alias("name"), "split", "item", "proposal", F.lit(None).cast("string").alias("action"))
    other = position(augmented, [F.floor(F.col("id") / SPAN)], ["id"]).select("position", F.concat(F.lit("a"), F.col("id").cast("string")).alias("name"), F.lit("augmented").alias("split"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("proposal"), "action")
    both = interleave(own, other)
    kinds = F.when(F.col("split") == "augmented", F.array(F.lit("request"))).otherwise(F.array(F.lit("request"), F.lit("review")))
    rows = both.select("place", "name", "split", "item", "proposal", "action", F.posexplode(kinds).alias("n", "kind"))
    rows = position(rows.drop("position"), [F.floor(F.col("place") / SPAN)], ["place", "n"])
    action = F.when(F.col("split") == "augmented", F.col("action")).when(F.col("kind") == "review", "recover").when(F.col("item").isNotNull(), "locate")
    return rows.select("position", F.concat_ws(":", "name", "kind").alias("id"), "kind", "split", F.col("item").alias("reference_item"), action.alias("reference_action"), F.when(F.col("kind") == "review", F.col("proposal")).alias("proposal"))


# -- cases -----------------------------------------------------------------------------------------------------------
#: Strategies by kind of failure, the most suitable first.
PRIORITIES = {
    "speech_failure": ["specific_redirection", "self_correction", "clarifying_prompt", "partial_understanding_repair", "confidence_check", "transparency_cue", "guided_reset"],
    "timing_failure": ["transparency_cue", "clarifying_prompt", "self_correction", "confidence_check", "specific_redirection", "guided_reset", "partial_understanding_repair"],
    "comprehension_failure": ["clarifying_prompt", "partial_understanding_repair", "confidence_check", "self_correction", "specific_redirection", "guided_reset", "transparency_cue"],
    "search_failure": ["self_correction", "specific_redirection", "guided_reset", "confidence_check", "clarifying_prompt", "partial_understanding_repair", "transparency_cue"],
}
#: Wordings of a right answer.
RIGHT = ["The {name} is listed in {drawer}.", "You can find the {name} in {drawer}.", "Please open {drawer} for the {name}."]


def primary_strategy(failure: Column, preferences: Column) -> Column:
    """The first strategy of the failure's list that is preferred; null where none is."""
    choice = F.lit(None).cast("string")
    for kind, order in PRIORITIES.items():
        choice = F.when(failure == kind, F.get(F.filter(F.array(*map(F.lit, order)), lambda s: F.array_contains(preferences, s)), F.lit(0))).otherwise(choice)
    return choice


def convert(cases: DataFrame, items: DataFrame, participants: DataFrame) -> DataFrame:
    """Cases as records: (case, id, split, source, scenario, action, item, strategy, proposal, reason), excluded ones with their reason.

    cases: (case, participant, setting, task, turns, target_item, said_item, failures, preferences), said_item being what the user's words name; participants: (participant, split).
    A retrieval also gives three controls, in which a right answer is reviewed.
    """
    _, proposal, user = decision_boundary(F.col("turns"))
    failure = F.get("failures", F.lit(0))
    c = cases.withColumn("proposal", proposal).withColumn("user", user).withColumn("strategy", primary_strategy(failure, F.col("preferences")))
    known = items.select("setting", F.col("id").alias("target_item"), "name", "drawer")
    c = c.join(participants, "participant", "left").join(known, ["setting", "target_item"], "left")
    reason = (
        F.when(F.col("split").isNull(), "participant_not_in_fold")
        .when(~F.col("user"), "no_user_decision_boundary")
        .when((F.col("task") == "retrieval") & F.col("name").isNull(), "retrieval_item_missing")
        .when((F.col("task") == "recovery") & (F.size("failures") != 1), "multi_failure")
        .when((F.col("task") == "recovery") & F.col("strategy").isNull(), "no_voice_recovery_preference")
        .when(~F.col("task").isin("retrieval", "recovery"), "unknown_task")
    )
    found = F.col("task") == "retrieval"
    record = lambda source, scenario, proposal, n: F.struct(F.lit(source).alias("source"), scenario.alias("scenario"), proposal.alias("proposal"), F.lit(n).alias("n"))
    own = record("reviewed", F.when(found, "success_retrieval").otherwise(failure), F.col("proposal"), 0)
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{name}"), F.col("name")), F.lit("{drawer}"), F.coalesce("drawer", F.lit("")))
    controls = [record("derived_control", F.lit("derived_correct_review"), fill(t), n + 1) for n, t in enumerate(RIGHT)]
    rows = c.withColumn("reason", reason).withColumn("r", F.explode(F.when(F.col("reason").isNull() & found, F.array(own, *controls)).otherwise(F.array(own))))
    kept = lambda x: F.when(F.col("reason").isNull(), x)
    return rows.select(
        "case",
        kept(F.concat(F.col("case").cast("string"), F.when(F.col("r.n") > 0, F.concat(F.lit(":derived_correct_review_"), F.col("r.n").cast("string"))).otherwise(F.lit("")))).alias("id"),
        kept(F.col("split")).alias("split"),
        kept(F.col("r.source")).alias("source"),
        kept(F.col("r.scenario")).alias("scenario"),
        kept(F.when(found, "locate").otherwise("recover")).alias("action"),
        kept(F.when(found, F.col("target_item")).otherwise(F.col("said_item"))).alias("item"),
        kept(F.when(found, "none").otherwise(F.col("strategy"))).alias("strategy"),
        kept(F.col("r.proposal")).alias("proposal"),
        "reason",
    )


def best_version(versions: DataFrame) -> DataFrame:
    """(trial, sample, turns, reason): of each trial the first usable version, reviewed ones first, then by sample; where none is usable, the first one's reason.

    versions: (trial, sample, reviewed, turns, cut): turns up to the place ``cut`` are wanted.
    """
    prefix, reason = clean_prefix(F.col("turns"), F.col("cut"))
    v = versions.select("trial", "sample", "reviewed", prefix.alias("prefix"), reason.alias("reason"))
    best = Window.partitionBy("trial").orderBy(F.col("prefix").isNull(), F.desc("reviewed"), "sample")
    return v.withColumn("r", F.row_number().over(best)).filter("r = 1").select("trial", "sample", F.col("prefix").alias("turns"), "reason")


def best_examples(candidates: DataFrame, *, support: float = 0.7, item_support: float = 0.5) -> DataFrame:
    """(trial, status, source, turn, attempts): of each trial the best supported pair of a request and a reply, or why there is none.

    candidates: (trial, source, archive, turn, phrase, support, item_support); the archive's own first, then the strongest support, then the earliest turn.
    """
    fine = F.col("phrase").isNotNull() & (F.col("support") >= support) & (F.col("item_support") >= item_support)
    order = F.struct((~F.col("archive")).alias("a"), (-F.col("support")).alias("b"), (-F.col("item_support")).alias("c"), F.col("turn").alias("d"), F.col("source").alias("e"))
    g = candidates.groupBy("trial").agg(F.min(F.when(fine, order)).alias("best"), F.count_if(~fine).alias("attempts"))
    return g.select("trial", F.when(F.col("best").isNull(), "excluded").otherwise("accepted").alias("status"), F.col("best.e").alias("source"), F.col("best.d").alias("turn"), "attempts")


def audit(records: DataFrame, fields: list[str]) -> DataFrame:
    """(check, failures): missing fields, repeated ids, groups and inputs in several splits, strategies that aren't acceptable.  records: (id, group, split, input, strategy, acceptable, ...)."""
    spread = lambda key: records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("failures"))
    missing = records.agg(F.count_if(F.greatest(*(F.col(f).isNull().cast("int") for f in fields)) == 1).alias("failures"))
    repeated = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures"))
    strategy = records.agg(F.count_if((F.col("strategy") != "none") & (F.size("acceptable") > 0) & ~F.array_contains("acceptable", F.col("strategy"))).alias("failures"))
    checks = {"missing field": missing, "repeated id": repeated, "group in several splits": spread("group"), "input in several splits": spread("input"), "strategy not acceptable": strategy}
    out = None
    for name, failures in checks.items():
        row = failures.select(F.lit(name).alias("check"), "failures")
        out = row if out is None else out.unionByName(row)
    return out
