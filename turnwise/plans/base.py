"""The register of queries and the relations that stand for dialogue data on the driver's tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import position
from ..session import prepare_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (read) -> DataFrame, where read(name) gives a table; sql gives the same rows on DuckDB."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_workers(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: What users say about item {n}; the number of the template is the item's key modulo 8.
TEMPLATES = ["Where is the {n}?", "Which drawer has the {n}", "No, I said the {n}", "is there any {n}s here", "the {n} is not in drawer two", "drawer too please", "I can't find the {n}, wrong drawer four", "thanks a lot"]


def utterances(read) -> DataFrame:
    """(id, setting, text): one request for each part."""
    text: Column = F.lit(None)
    for i, t in reversed(list(enumerate(TEMPLATES))):
        text = F.when(F.col("p_partkey") % 8 == i, F.replace(F.lit(t), F.lit("{n}"), F.col("p_name"))).otherwise(text)
    return read("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "lab").otherwise("hospital").alias("setting"), text.alias("text"))


#: Rows of a task, at most about: what a task holds of its rows doesn't grow with the table.
TASK_ROWS = 100_000


def task_count(read) -> int:
    """How many tasks the requests are worth: as many as a shuffle has, and more for more than ``TASK_ROWS`` each."""
    part = read("part")
    return max(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-part.count() // TASK_ROWS))


def spread_utterances(read) -> DataFrame:
    """``utterances`` over ``task_count`` tasks, each id in one: a small file is one task, whatever is made of its rows."""
    return utterances(read).repartition(task_count(read), "id")


_CASES = " ".join(f"WHEN {i} THEN replace('{t.replace(chr(39), chr(39) * 2)}', '{{n}}', p_name)" for i, t in enumerate(TEMPLATES))
U = f"u AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'lab' ELSE 'hospital' END AS setting, CASE p_partkey % 8 {_CASES} END AS text FROM part)"


def inventory(read) -> DataFrame:
    """(item_id, name, family, brand, size, drawer, setting): parts as items; sizes over 40 have no drawer on record."""
    return read("part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("family"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("string").alias("size"),
        F.when(F.col("p_size") <= 40, F.concat(F.lit("drawer "), F.col("p_size").cast("string"))).alias("drawer"),
        F.when(F.col("p_partkey") % 2 == 0, "lab").otherwise("hospital").alias("setting"),
    )


I = (  # noqa: E741
    "i AS (SELECT p_partkey AS item_id, p_name AS name, p_type AS family, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, "
    "CASE WHEN p_size <= 40 THEN 'drawer ' || p_size END AS drawer, CASE WHEN p_partkey % 2 = 0 THEN 'lab' ELSE 'hospital' END AS setting FROM part)"
)


def turns(read) -> DataFrame:
    """(event_id, ts, user_id, route, category, value, hit, correct): ``turn_log`` for what doesn't ask for an order."""
    route = F.when(F.col("event_type").isin("view", "click", "purchase"), "fsm").otherwise("slm")
    return read("events").select(
        "event_id",
        "ts",
        "user_id",
        route.alias("route"),
        F.col("event_type").alias("category"),
        "value",
        (route == "fsm").alias("hit"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 7 != 0).alias("correct"),
    )


def turn_log(read) -> DataFrame:
    """(position, event_id, ts, user_id, route, category, value, hit, correct): events in order as the log of a replay; correct is null for errors."""
    t = turns(read)
    return position(t, [F.date_trunc("HOUR", "ts")], ["ts", "event_id"]).select("position", *t.columns)


L = (
    "log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS position, event_id, ts, user_id, "
    "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'fsm' ELSE 'slm' END AS route, event_type AS category, value, "
    "event_type IN ('view', 'click', 'purchase') AS hit, CASE WHEN event_type <> 'error' THEN event_id % 7 <> 0 END AS correct FROM events)"
)
