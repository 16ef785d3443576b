"""Sources and sinks that the driver's tables can stand for."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import files
from .base import I, inventory, query


@query(
    "WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Participant' ELSE 'robot' END || ': ' || regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY turn) AS text, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, n AS turns, users AS participant_turns, CASE WHEN users = 0 THEN 'no participant' END AS error FROM t"
)
def parse_dialogue(read):
    """Dialogue text to turns."""
    line = F.concat(F.when(F.col("role") == "user", "Participant").otherwise("robot"), F.lit(": "), F.regexp_replace("text", r"\s+", " "))
    texts = read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    turns = files.parse_dialogue(texts, id_col="conv_id")
    return turns.groupBy(F.col("id").alias("conv_id")).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "participant").alias("participant_turns"), F.max("error").alias("error"))


@query(
    f"WITH {I}, b AS (SELECT setting, item_id, name, CAST(size AS INT) AS drawer FROM i WHERE family <> 'SMALL'), r AS (SELECT setting, lower(trim(name || ' ' || brand)) AS k, min(CAST(size AS INT)) AS drawer FROM i WHERE family = 'SMALL' AND CAST(size AS INT) BETWEEN 1 AND 40 GROUP BY ALL) "
    "SELECT setting, count(*) AS items, count(DISTINCT name) AS names, CAST(max(added) AS BIGINT) AS added FROM (SELECT setting, name, 0 AS a FROM b UNION ALL SELECT setting, k, 1 FROM r) JOIN (SELECT setting, count(*) AS added FROM r GROUP BY setting) USING (setting) GROUP BY setting"
)
def user_reports(read):
    """Reported items added where valid and not known."""
    i = inventory(read).withColumn("drawer", F.col("size").cast("int"))
    items = i.filter("family <> 'SMALL'").select("setting", F.col("item_id").cast("string").alias("item_id"), "name", "drawer")
    reports = i.filter("family = 'SMALL'").select("setting", F.lower(F.concat_ws(" ", "name", "brand")).alias("name"), "drawer", F.lit(True).alias("enabled"))
    out = files.add_reports(items, reports, drawers=40)
    return out.groupBy("setting").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("name").alias("names"), F.count_if(F.col("item_id").startswith("user_")).alias("added"))


@query("SELECT lang AS file, count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(sum(CAST(('0x' || left(sha256(text), 12)) AS BIGINT)) AS VARCHAR) AS digest FROM documents GROUP BY lang")
def manifest(read):
    """Records, sizes and a digest by part; row digests add up in any order, so no part is gathered."""
    return read("documents").groupBy(F.col("lang").alias("file")).agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("characters"), M.sum_digest(F.col("text")).alias("digest"))
