"""Versioned tables: each write makes a new folder, and a pointer moves to it at once.

Readers see the old table or the new one, never a part. One writer at a time:
the lock is a file that only one can create. Its owner renews it while it writes; one that
has not been renewed for `STALE` seconds belongs to a writer that is gone, and is taken away. All
paths go through Hadoop's file systems, so a table can lie wherever Spark reads.

A log is a folder of appends. Each gets the next free numbers, which its folder's
name tells, so nothing is read or written again to append.
"""

from __future__ import annotations

import contextlib
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.sources.work import numbered

BASELINES = "program string, baseline_iso string, last_seen_iso string, tools_count int, aggregate_hash string, hash_backend string, jcs_canonical boolean, tools array<struct<name:string,description_hash:string,param_names:array<string>,required_set_hash:string>>"
PINS = "server_name string, key_fingerprint string, public_key_b64 string, pinned_at_iso string"
AUDIT = "seq long, ts_iso string, direction string, matched_patterns array<string>, cve_refs array<string>"
VERSION = 1
STALE = 120.0


class Table:
    """A table of a fixed schema under `path`; empty until it is written."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def current(self) -> str | None:
        """The folder the pointer names."""
        if not self._fs.exists(self._at("_current")):
            return None
        stream = self._fs.open(self._at("_current"))
        try:
            version, folder = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().split()
        finally:
            stream.close()
        if int(version) > VERSION:
            raise ValueError(f"{self.path}: schema version {version} is newer than {VERSION}")
        return f"{self.path}/{folder}"

    def read(self) -> DataFrame:
        now = self.current()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(now)

    def _create_lock(self) -> bool:
        """Whether the lock file was made by this call; Hadoop's local file system cannot tell, the operating system can."""
        if self._fs.getUri().getScheme() == "file":
            folder = self._path(self.path).toUri().getPath()
            os.makedirs(folder, exist_ok=True)
            try:
                os.close(os.open(f"{folder}/_lock", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(self._at("_lock"), False).close()
        except Exception as e:  # the file is there
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            return False
        return True

    def _break_stale(self, stale: float) -> None:
        """Take a lock away that nobody renews; of several that try, the one whose rename succeeds does."""
        try:
            age = time.time() - self._fs.getFileStatus(self._at("_lock")).getModificationTime() / 1000
        except Exception:  # it is gone by now
            return
        if age > stale and self._fs.rename(self._at("_lock"), gone := self._at(f"_stale-{uuid.uuid4().hex}")):
            self._fs.delete(gone, False)

    @contextlib.contextmanager
    def lock(self, wait: float = 60.0, stale: float = STALE) -> Iterator[None]:
        """Held by one writer; others wait."""
        end = time.monotonic() + wait
        while not self._create_lock():
            if time.monotonic() > end:
                raise TimeoutError(f"{self.path} is locked")
            self._break_stale(stale)
            time.sleep(0.05)
        done = threading.Event()

        def renew() -> None:
            while not done.wait(stale / 4):
                with contextlib.suppress(Exception):
                    self._fs.setTimes(self._at("_lock"), int(time.time() * 1000), -1)

        threading.Thread(target=renew, daemon=True).start()
        try:
            yield
        finally:
            done.set()
            self._fs.delete(self._at("_lock"), False)

    def write(self, df: DataFrame) -> None:
        """Replace the table; the folder before the last is removed."""
        folder, old = f"v-{uuid.uuid4().hex}", self.current()
        want = self.spark.createDataFrame([], self.schema).schema
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want]).write.parquet(f"{self.path}/{folder}")
        out = self._fs.create(self._at("_next"), True)
        out.write(bytearray(f"{VERSION} {folder}".encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(self._at("_next"), self._at("_current"), options)
        keep = {folder, old.rsplit("/", 1)[-1] if old else folder}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                self._fs.delete(status.getPath(), True)

    def update(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Read, change and write under the lock; concurrent updates all take effect."""
        with self.lock():
            self.write(change(self.read()))
        return self.read()

    def append(self, df: DataFrame) -> None:
        self.update(lambda old: old.unionByName(df.select(*old.columns)))


class Log(Table):
    """An append-only table whose column seq numbers the rows in the order of their appends."""

    def _appends(self) -> list[tuple[int, int, str]]:
        """(first number, rows, name) of each append, in order."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted((int(n[:20]), int(n[21:41]), n[42:]) for n in names if n[:1].isdigit())

    def read(self) -> DataFrame:
        folders = [f"{self.path}/{first:020d}-{rows:020d}-{name}" for first, rows, name in self._appends()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame, name: str | None = None, order: str | None = None) -> None:
        """Add the rows of df; seq is given here, by `order` or as they come. A name that was appended before is replaced and keeps its first number, if it has as many rows."""
        name = name or uuid.uuid4().hex
        want = [f for f in self.spark.createDataFrame([], self.schema).schema if f.name != "seq"]
        rows = df.orderBy(order) if order else df
        made = numbered(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want]))
        count = made.count()
        with self.lock():
            held = self._appends()
            old = [a for a in held if a[2] == name]
            first = old[0][0] if old and old[0][1] == count else max((f + n for f, n, _ in held), default=1)
            for f, n, _ in old:
                self._fs.delete(self._at(f"{f:020d}-{n:020d}-{name}"), True)
            if count:
                made.withColumn("seq", F.col("seq") + first).write.mode("overwrite").parquet(f"{self.path}/_new-{name}")
                self._fs.rename(self._at(f"_new-{name}"), self._at(f"{first:020d}-{count:020d}-{name}"))
