"""Tables that several writers append to, each key once, whatever crashes: files are staged first, and one commit entry makes them visible.

A table is a folder with ``data/<name>`` (one folder of Parquet files for each attempt) and ``_commits/<epoch>`` (a line with such a name).  A commit entry comes
into being under its final name by a rename that doesn't replace, so of two writers that want one epoch the file system lets one win; the other drops
from its files the keys that were committed meanwhile and tries the next epoch.  Readers read what commit entries name: files of an attempt that died, or that lost,
are never seen.  ``vacuum`` deletes them once no writer can be at work on them.

The driver handles one short line for each commit; keys are compared by joins.
"""

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Commits:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(self.path)
        self._fs = root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no option: an existing file isn't replaced

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read_line(self, at: str) -> str:
        f = self._fs.open(self._path(at))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def entries(self, after: int = -1) -> list[tuple[int, str]]:
        """(epoch, name of its files) of all commits after an epoch, in order."""
        found = [int(n) for n in self._names("_commits") if n.isdigit()]
        return [(e, self._read_line(f"{self.path}/_commits/{e:020d}")) for e in sorted(found) if e > after]

    def _files(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{n}" for n in names))

    def read(self, until: int | None = None) -> DataFrame:
        """The committed rows, as of an epoch."""
        return self._files([n for e, n in self.entries() if until is None or e <= until])

    def stage(self, rows: DataFrame) -> str:
        """Write rows that nobody sees yet."""
        name = uuid.uuid4().hex
        rows.write.mode("error").parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, epoch: int, name: str) -> bool:
        """Make staged rows the commit of an epoch; False if the epoch has one already."""
        own, final = self._path(f"{self.path}/_commits/_{uuid.uuid4().hex}"), self._path(f"{self.path}/_commits/{epoch:020d}")
        out = self._fs.create(own, True)
        out.write(bytearray(name.encode()))
        out.close()
        try:
            self._context.rename(own, final, self._keep)
            return True
        except Exception as e:  # noqa: BLE001  Py4J wraps the Java exception
            if "FileAlreadyExists" not in str(e) and not self._fs.exists(final):
                raise
            self._fs.delete(own, False)
            return False

    def append(self, rows: DataFrame, key: str, *, before_commit: Callable[[], None] = lambda: None) -> int:
        """Append the rows whose key isn't there yet, one for each key; returns the epoch of the commit, or -1 if there was none to add.

        before_commit: called between files and commit (tests).
        """
        seen, staged = -1, rows.dropDuplicates([key])
        while True:
            rivals = self.entries(seen)
            if rivals:
                staged = staged.join(self._files([n for _, n in rivals]).select(key), key, "left_anti")
                seen = rivals[-1][0]
            name = self.stage(staged.select(*self.spark.createDataFrame([], self.schema).columns))
            staged = self._files([name])
            if staged.isEmpty():
                return -1
            before_commit()
            if self.commit(seen + 1, name):
                return seen + 1

    def vacuum(self, older_than_seconds: float = 86_400) -> int:
        """Delete files of attempts that no commit names and that are old enough to be dead; returns how many attempts that were."""
        named, gone = {n for _, n in self.entries()}, 0
        limit = (time.time() - older_than_seconds) * 1000
        for n in self._names("data"):
            at = self._path(f"{self.path}/data/{n}")
            if n not in named and self._fs.getFileStatus(at).getModificationTime() <= limit:
                self._fs.delete(at, True)
                gone += 1
        return gone
