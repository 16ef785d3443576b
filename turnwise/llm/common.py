"""What the operators share: reading tables, cutting lineage, Arrow helpers."""

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker, at most (a row over the limit is a batch of its own).
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

ROOT = str(Path(__file__).resolve().parents[2])
_PACKAGE = __name__.split(".")[0]
_ARCHIVE = _PACKAGE + "-workers"


def prepare(spark: SparkSession) -> None:
    """Send this package to Python workers, and keep Arrow batches small (texts may be long)."""
    sc = spark.sparkContext
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # a task has one core
        sc.environment.setdefault(name, "1")
    if not any(f.startswith(_ARCHIVE) for f in sc._python_includes):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(Path(ROOT, _PACKAGE).rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        path = new_path(spark, _ARCHIVE) + ".zip"
        with open_uri(path, write=True) as out:
            out.write(packed.getvalue())
        sc.addPyFile(path)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def open_uri(uri: str, *, write: bool = False):
    fs, path = filesystem(uri)
    if not write:
        return fs.open_input_stream(path, buffer_size=1 << 20)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Tables that this process wrote, for ``sweep``.
_written: list[str] = []


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads survive lost executors and nothing is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, what)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and that nothing reads any more."""
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        _delete(spark, f)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` wrote: for callers whose results are written."""
    while _written:
        _delete(spark, _written.pop())


def new_column(df: DataFrame, name: str) -> None:
    """Refuse to write over a column of the input."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {name!r} already: name the new one otherwise")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
