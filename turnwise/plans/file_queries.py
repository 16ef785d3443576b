"""Sources and sinks on the driver's tables: rows are written, read back through the readers, and compared with what was there."""

from pyspark.sql import functions as F

from ..operators import automata
from ..session import workspace
from ..sources import files
from .base import I, inventory, query, turn_log
from .base import L as LOG


def _items(read):
    return inventory(read).select(F.col("item_id").cast("string").alias("id"), "name", "family", F.create_map(F.lit("brand"), "brand").alias("attributes"), F.array("brand").alias("aliases"), "drawer", "setting")


@query(f"WITH {I} SELECT CAST(item_id AS VARCHAR) AS id, name, drawer, true AS has_place FROM i")
def jsonl_roundtrip(read):
    """JSON lines in order, read back with file, line and digest of each record."""
    i = _items(read)
    path = workspace(i.sparkSession, "lines")
    files.write_jsonl(i, path, ["id"])
    back = files.read_records(i.sparkSession, [path], "id string, name string, drawer string")
    return back.select("id", "name", "drawer", (F.col("_source").rlike(r"\.json:[0-9]+$") & (F.length("_sha256") == 64)).alias("has_place"))


@query(f"WITH {I} SELECT setting, CAST(item_id AS VARCHAR) AS id, name, brand, coalesce(drawer, 'none') AS drawer FROM i WHERE setting = 'lab'")
def item_documents(read):
    """An inventory as one document by setting, read for one setting only."""
    i = _items(read)
    path = workspace(i.sparkSession, "items")
    # an inventory document is one object by its format; it holds items, not requests
    doc = i.groupBy("setting").agg(F.collect_list(F.struct("id", "name", "family", "attributes", "aliases", "drawer")).alias("l")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("setting", "l")))).alias("value"))
    doc.write.text(path)
    back = files.read_items(i.sparkSession, path, "Lab")
    return back.select("setting", "id", "name", F.col("attributes")["brand"].alias("brand"), F.coalesce("drawer", F.lit("none")).alias("drawer"))


@query(f"WITH {I} SELECT setting, CAST(item_id AS VARCHAR) AS id, name, brand, coalesce(drawer, 'none') AS drawer FROM i WHERE setting = 'lab'")
def partitioned_items(read):
    """An inventory of any size in a folder for each setting, of which one is read."""
    i = _items(read)
    path = workspace(i.sparkSession, "inventory")
    files.write_items(i, path)
    back = files.read_setting(i.sparkSession, path, "lab")
    return back.select("setting", "id", "name", F.col("attributes")["brand"].alias("brand"), F.coalesce("drawer", F.lit("none")).alias("drawer"))


@query(f"WITH {I} SELECT CAST(item_id AS VARCHAR) AS id, name, family FROM i")
def csv_roundtrip(read):
    """A table as CSV with a head."""
    i = _items(read).select("id", "name", "family")
    path = workspace(i.sparkSession, "csv")
    files.write_csv(i, path)
    return i.sparkSession.read.option("header", True).csv(path).select("id", "name", "family")


@query(f"WITH {I} SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM i")
def resumed_append(read):
    """A table that goes on where it stopped: a second run appends what the first one hadn't."""
    i = _items(read).select("id")
    path = workspace(i.sparkSession, "cache")
    files.append_new(i.filter("CAST(id AS LONG) % 2 = 0").withColumn("run", F.lit("first")), path, "id")
    files.append_new(i.withColumn("run", F.lit("second")), path, "id")
    return i.sparkSession.read.parquet(path)


@query(f"WITH {LOG} SELECT route AS state, category AS event, CASE WHEN route = 'fsm' THEN 'serve' ELSE 'ask' END AS action, CASE WHEN category = 'error' THEN 'awaiting_request' ELSE 'located' END AS next_state, count(*) AS support FROM log GROUP BY ALL")
def compiled_controller(read):
    """A model compiled from observed transitions and wordings, dumped as tables and loaded again."""
    none = F.lit(None).cast("string")
    log = turn_log(read)
    place = F.concat(F.lit("log:"), F.col("position").cast("string"))
    moves = log.select(F.lit("transition").alias("type"), none.alias("text"), F.col("route").alias("state"), F.col("category").alias("event"), F.when(F.col("route") == "fsm", "serve").otherwise("ask").alias("action"), F.when(F.col("category") == "error", "awaiting_request").otherwise("located").alias("next_state"), place.alias("_source"))
    other = log.sparkSession.createDataFrame([("config", None, "fsm"), ("query", "where is <item>", None), ("query", "find <item>", None)], "type string, text string, state string")
    records = moves.unionByName(other.select("type", "text", "state", none.alias("event"), none.alias("action"), none.alias("next_state"), F.lit("own:1").alias("_source")))
    path = workspace(log.sparkSession, "model")
    automata.dump_model(automata.compile_records(records), path)
    return automata.load_model(log.sparkSession, path)["controller"]


@query("SELECT vec_id, label, len(embedding) AS dimensions, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings JOIN documents ON doc_id = vec_id")
def embedded_texts(read):
    """Sentence vectors by text id from a table of precomputed ones, each made once."""
    vectors = read("embeddings").select("vec_id", "label", "embedding")
    j = read("documents").select(F.col("doc_id").alias("vec_id")).join(vectors, "vec_id")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return j.select("vec_id", "label", F.size("embedding").cast("long").alias("dimensions"), F.round(F.sqrt(square), 5).alias("norm"))
