"""Reading and writing dialogue data: JSON lines and documents, embedded archives, dialogue text, verified and sealed files.

Everything reads through Spark's readers, so paths may be in any store that Spark knows.
"""

import base64
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "id string, name string, family string, attributes map<string,string>, aliases array<string>, drawer string, location string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object for each non-blank line, with ``_source`` (file); a line that is no object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_source", F.col("_metadata.file_path"))


def read_records(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Objects of several files of JSON lines with ``_source`` (file:line) and ``_sha256`` of their file; a line that is no object fails with its place.

    Lines are read apart, in as many tasks as the reader makes of a file, and numbered in order; for its digest a file streams through one task line by line.
    """
    at = ["f", "start", "n"]
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"))
    digests = raw.select(*at, "size", F.col("line").cast("binary").alias("line")).repartition("f").sortWithinPartitions(*at).mapInArrow(_digests, "f string, _sha256 string")
    # lines are numbered within the blocks of a file, and blocks by the lines before them
    blocks = raw.groupBy("f", "start").agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("first"))
    before = blocks.select("f", "start", "first", (F.sum("lines").over(Window.partitionBy("f").orderBy("start")) - F.col("lines")).alias("before"))
    lines = raw.join(F.broadcast(before), ["f", "start"]).select("f", F.regexp_replace("line", r"\r\z", "").alias("line"), (F.col("before") + F.col("n") - F.col("first") + 1).alias("n")).filter(F.trim("line") != "")
    place = F.concat("f", F.lit(":"), F.col("n").cast("string"))
    kind = F.schema_of_variant(F.try_parse_json("line"))
    fine = F.when(kind.startswith("OBJECT"), F.col("line")).otherwise(F.raise_error(F.concat(place, F.lit(": no JSON object"))))
    return lines.join(F.broadcast(digests), "f").select(F.from_json(fine, schema).alias("x"), place.alias("_source"), "_sha256").select("x.*", "_source", "_sha256")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, SHA-256 of the file's bytes) from its lines (f, size, line) in order.

    The reader leaves out a byte order mark and whether the last line ends with a line feed; both follow from the size.
    """
    name, whole, plain, marked, seen = None, 0, None, None, 0

    def row() -> pa.RecordBatch:
        if whole - seen not in (0, -1, 2, 3):
            raise ValueError(f"{name} has {whole} bytes, but {seen} in its lines: compressed files have no digest by lines")
        digest = marked if whole - seen > 0 else plain
        if whole - seen in (0, 3):
            digest.update(b"\n")
        return pa.RecordBatch.from_pydict({"f": [name], "_sha256": [digest.hexdigest()]})

    for batch in batches:
        for f, size, line in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("f", "size", "line")), strict=True):
            if f != name:
                if name is not None:
                    yield row()
                name, whole, plain, marked, seen = f, size, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf"), 0
            else:
                line = b"\n" + line
            plain.update(line)
            marked.update(line)
            seen += len(line) + (seen == 0)
    if name is not None:
        yield row()


def read_items(spark: SparkSession, path: str, setting: str | None = None) -> DataFrame:
    """Items from a JSON array, {"items": [...]}, {setting: [...]} or JSON lines: (setting, item fields)."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    item = T.StructType.fromDDL(ITEM)
    items = T.ArrayType(item)
    whole = F.when(F.col("t").startswith("["), F.create_map(F.lit(""), F.from_json("t", items))).otherwise(F.from_json("t", T.MapType(T.StringType(), items)))
    lines = F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, item))
    one_each = F.col("t").startswith("{") & F.get_json_object("t", "$.id").isNotNull()
    found = text.select(F.explode(F.when(one_each, F.create_map(F.lit(""), lines)).otherwise(whole)).alias("setting", "items")).select("setting", F.explode("items").alias("i"))
    rows = found.select(F.when(~F.col("setting").isin("", "items"), F.col("setting")).alias("setting"), "i.*").withColumn("drawer", F.coalesce("drawer", "location")).drop("location")
    return rows if setting is None else rows.filter(F.lower(F.trim("setting")) == setting.strip().lower())


def write_items(items: DataFrame, path: str) -> None:
    """An inventory as JSON lines, in a folder for each setting, by as many tasks as it has parts."""
    items.write.mode("error").partitionBy("setting").json(path)


def read_setting(spark: SparkSession, path: str, setting: str) -> DataFrame:
    """The items of one setting of such an inventory: other settings' files aren't opened."""
    rows = spark.read.schema(f"setting string, {ITEM}").json(path)
    return rows.filter(F.col("setting") == setting).withColumn("drawer", F.coalesce("drawer", "location")).drop("location")


def read_snapshot(spark: SparkSession, path: str, name: str, sha256: str | None = None) -> str:
    """The text that a source file embeds as base64 of zlib under ``name``; refused unless one assignment has it and the digest agrees."""
    lines = spark.read.text(path).filter(F.col("value").rlike(rf"^\s*{name}\s*=")).select(F.regexp_extract("value", r"""=\s*['"]([A-Za-z0-9+/=]+)['"]""", 1).alias("b")).limit(2).collect()
    if len(lines) != 1 or not lines[0].b:
        raise ValueError(f"{path} has {len(lines)} assignments of {name}")
    data = zlib.decompress(base64.b64decode(lines[0].b))
    if sha256 and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{name} has another SHA-256")
    return data.decode()


def read_snapshots(spark: SparkSession, path: str, pinned: dict[str, str]) -> dict[str, str]:
    """All texts that a file embeds under the given names; refused as a whole unless each agrees with its pinned SHA-256."""
    return {name: read_snapshot(spark, path, name, sha) for name, sha in pinned.items()}


def parse_dialogue(frame: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, error) of texts with ``participant:`` and ``robot:`` lines; other lines go on with the turn before.

    error, on each row of a broken text: "empty", "starts without a speaker", "empty turn" or "no participant".
    """
    lines = frame.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    head = F.lower(F.regexp_extract("line", r"(?i)^\s*(participant|robot)\s*:", 1))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("role", head).withColumn("turn", F.sum((F.col("role") != "").cast("int")).over(w))
    part = F.when(F.col("role") != "", F.trim(F.regexp_replace("line", r"(?i)^\s*(participant|robot)\s*:", ""))).otherwise(F.trim("line"))
    turns = marked.groupBy("id", "turn").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), " ").alias("text"))
    per = Window.partitionBy("id")
    error = F.when(F.min("turn").over(per) == 0, "starts without a speaker").when(F.min(F.length(F.trim("text"))).over(per) == 0, "empty turn").when(F.max((F.col("role") == "participant").cast("int")).over(per) == 0, "no participant")
    parsed = turns.select("id", F.col("turn").cast("int").alias("turn"), "role", F.trim("text").alias("text"), error.alias("error"))
    none = frame.select(F.col(id_col).alias("id")).join(turns.select("id").distinct(), "id", "left_anti")
    return parsed.unionByName(none.select("id", F.lit(None).cast("int").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit("empty").alias("error")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, records): one row for each file of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: F.trim(x) != "")).cast("long").alias("records"))


def read_verified(spark: SparkSession, path: str, schema: str, *, sha256: str, rows: int) -> DataFrame:
    """JSON lines, accepted only with the given digest and number of records."""
    got = manifest(spark, path).first()
    if got.sha256 != sha256 or got.records != rows:
        raise ValueError(f"{path}: {got.records} records with SHA-256 {got.sha256}, expected {rows} with {sha256}")
    return read_jsonl(spark, path, schema)


def write_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order: files are numbered by range, so reading them by name gives the order; a failed job leaves none."""
    rows.orderBy(*order).write.mode("error").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").option("header", True).csv(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key a table doesn't have yet; a restart goes on where it stopped.  Returns the number of new rows."""
    spark = rows.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    new = rows.dropDuplicates([key])
    if known:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    n = new.count()
    new.write.mode("append").parquet(path)
    return n


def add_reports(items: DataFrame, reports: DataFrame, *, drawers: int) -> DataFrame:
    """``items`` (setting, item_id, name, drawer int) and the valid reports whose names aren't known in their setting, ids by digest."""
    valid = reports.filter(F.col("enabled") & F.col("drawer").between(1, drawers) & (F.trim("name") != ""))
    key = F.lower(F.trim("name"))
    new = valid.withColumn("__k", key).join(items.select("setting", key.alias("__k")), ["setting", "__k"], "left_anti").dropDuplicates(["setting", "__k"])
    digest = F.substring(F.sha2(F.concat_ws("|", "setting", "__k", F.col("drawer").cast("string")), 256), 1, 12)
    return items.unionByName(new.select("setting", F.concat(F.lit("user_"), digest).alias("item_id"), F.trim("name").alias("name"), "drawer"))


def save_state(spark: SparkSession, machines: list[tuple[str, dict]], path: str, kind: str) -> None:
    """Snapshots of state machines by key, as a table.  kind: what must agree to read them back, as the embedder and the namespace."""
    spark.createDataFrame([(k, kind, json.dumps(v, sort_keys=True)) for k, v in machines], "key string, kind string, state string").write.mode("error").parquet(path)


def load_state(spark: SparkSession, path: str, kind: str) -> dict[str, dict]:
    rows = spark.read.parquet(path).collect()
    if {r.kind for r in rows} - {kind}:
        raise ValueError(f"{path} holds another kind of state than {kind}")
    return {r.key: json.loads(r.state) for r in rows}
