"""Structured decisions: rules, repair, successor states, memory."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the decision schema.
ACTIONS = ["locate", "clarify", "recover", "redirect", "not_found", "cancel"]
FAILURES = ["none", "comprehension_failure", "context_failure", "speech_failure", "timing_failure", "search_failure"]
STRATEGIES = ["none", "clarifying_prompt", "self_correction", "specific_redirection", "confidence_check", "guided_reset", "transparency_cue", "partial_understanding_repair"]


def rules() -> list[tuple[str, Column]]:
    """(error, whether it applies), in the order in which errors are named.  Columns: action, resolved, family, true_family, failure, strategy."""
    c = F.col
    recover = c("action") == "recover"
    return [
        ("unknown_action", ~c("action").isin(*ACTIONS)),
        ("failure_without_recovery", (c("failure") != "none") != recover),
        ("recovery_without_strategy", recover & (c("strategy") == "none")),
        ("strategy_without_recovery", ~recover & (c("strategy") != "none")),
        ("locate_without_item", (c("action") == "locate") & c("resolved").isNull()),
        ("item_not_allowed", ~c("action").isin("locate", "recover") & c("resolved").isNotNull()),
        ("item_family_disagree", c("resolved").isNotNull() & (c("family") != c("true_family"))),
        ("context_not_allowed", c("action").isin("redirect", "cancel") & c("family").isNotNull() & (c("item_id") % 2 == 1)),
    ]


def first_error() -> Column:
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in rules()))


def guarded() -> Column:
    """The decision's action if no rule fails, else what the resolved item or family supports."""
    return F.when(F.col("err").isNull(), F.col("action")).when(F.col("resolved").isNotNull(), "locate").when(F.col("family") != "OTHER", "clarify").otherwise("not_found")


def next_state(action: Column) -> Column:
    return F.when(action == "cancel", "ended").when(action == "clarify", "awaiting_clarification").when(action.isin("locate", "recover"), "located").when(action == "not_found", "awaiting_request").otherwise("unchanged")


def fold_memory(actions: Column) -> Column:
    """(last_action, recoveries) after a sequence of actions: recovering counts, cancelling empties, redirecting keeps."""
    empty = F.struct(F.lit(None).cast("string").alias("last_action"), F.lit(0).alias("recoveries"))
    step = lambda m, a: F.struct(a.alias("last_action"), F.when(a == "cancel", 0).when(a == "recover", m["recoveries"] + 1).otherwise(m["recoveries"]).alias("recoveries"))
    return F.aggregate(actions, empty, step)


def normalize_inventory(items: DataFrame) -> DataFrame:
    """Trimmed names, blank places as null, how many items of a setting share the name, and whether a row is valid."""
    same = F.count(F.lit(1)).over(Window.partitionBy("setting", "name"))
    place = F.trim(F.coalesce("drawer", F.lit("")))
    return items.select("item_id", F.trim("name").alias("name"), F.when(place != "", place).alias("location"), same.alias("same_name"), ((F.col("name") != "") & (F.col("family") != "")).alias("valid"))
