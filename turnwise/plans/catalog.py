"""All queries over the driver's tables, by name, with the SQL that gives the same rows."""

from . import builder_queries, data_queries, decision_queries, dialogue_queries, file_queries, match_queries, metric_queries, order_queries, phrase_queries, rule_queries, service_queries, serving_queries, source_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from .base import QUERIES, SQL


def entry(spark, sf_dir):
    """The flagship query: requests resolved against the inventory, with outcome and reply."""
    return QUERIES["lookup_outcome"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "entry"]
