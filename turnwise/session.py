"""What a session needs to run the operators."""

import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package: from where the driver has it if all run on one machine, else as an archive in the shared folder."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
        return
    name = __name__.split(".")[0]
    if any(f.startswith(f"{name}-package") for f in sc._python_includes):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(Path(ROOT, name).rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    uri = workspace(spark, f"{name}-package") + ".zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(uri)


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one only where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnwise-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _scratch.get():
        paths.append(path)
    return path


#: The folders made inside each open ``scratch`` of this thread, the outermost first.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Delete the folders that operators make inside a with-block when it ends: for callers whose results are written by then.

    Only folders of the block's own thread go, so other callers' tables stay.
    """
    own: list[str] = []
    token = _scratch.set((*_scratch.get(), own))
    try:
        yield own
    finally:
        _scratch.reset(token)
        for folder in own:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keeper(spark: SparkSession, what: str):
    """A function (frame, name) that writes a table to a new folder of the shared place and reads it back, for what is read more than once."""
    path = workspace(spark, what)

    def keep(df, name: str):
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    return keep
