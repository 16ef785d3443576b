"""Streaming forms of filters, dedupe, late feedback and windows over events."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def final_results(asr: DataFrame, *, id_col: str = "utterance_id", time_col: str = "ts", within: str = "1 hour") -> DataFrame:
    """Final, non-blank recognition results, each utterance once within the watermark (bounded by time, not by number)."""
    final = asr.filter(F.col("is_final") & (F.trim("text") != ""))
    return final.withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col]) if asr.isStreaming else final.dropDuplicates([id_col])


def late_feedback(traces: DataFrame, feedback: DataFrame, *, ttl_seconds: int = 86_400) -> DataFrame:
    """Each trace with the first feedback within the time to live; columns trace_id, ts, feedback_ts, success.

    On streams both sides carry watermarks and the condition bounds the state.
    """
    if traces.isStreaming:
        traces, feedback = traces.withWatermark("ts", f"{ttl_seconds} seconds"), feedback.withWatermark("feedback_ts", f"{ttl_seconds} seconds")
    f = feedback.withColumnRenamed("trace_id", "fid")
    inside = (F.col("feedback_ts") >= F.col("ts")) & (F.col("feedback_ts") <= F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return traces.join(f, (F.col("trace_id") == F.col("fid")) & inside).drop("fid")


def open_turns(turns: DataFrame, *, key: str, order: str, closes) -> DataFrame:
    """Turns before a session's first closing turn, and that turn."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("__closed", F.coalesce(F.max(closes.cast("int")).over(w), F.lit(0))).filter("__closed = 0").drop("__closed")


def windowed_counts(events: DataFrame, *, time_col: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows."""
    e = events.withWatermark(time_col, late) if events.isStreaming else events
    return e.groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
