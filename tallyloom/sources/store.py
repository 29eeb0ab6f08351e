"""Tables as parquet parts under one manifest: a change writes new parts and then the next manifest, by an atomic rename.

The latest manifest names the parts of every table, so several tables change at once, and a reader sees all of a change
or none of it. A manifest is never overwritten: of two writers that start from one manifest the second fails. Parts and
manifests that are out of date stay until ``expire``, for readers that still run. All file access goes through Spark's
file systems.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.schemas import TABLES


def identifier(name: str) -> str:
    """``name`` if it is a plain identifier, dots allowed; else an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def literal(text: str) -> str:
    """``text`` for a place in SQL where no parameter can stand: without statement ends and comments, quotes doubled."""
    if any(x in text for x in (";", "--", "/*")):
        raise ValueError(f"not a literal: {text!r}")
    return text.replace("'", "''")


def number(value: object) -> float:
    """A finite number, or an error."""
    out = float(value)
    if not math.isfinite(out):
        raise ValueError(f"not a number: {value!r}")
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str | None:
        """Contents of a small file, read through the file system; nothing if it isn't there."""
        at, fs = self._path(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """Write a small file beside its place and rename it there; fails if there is one."""
        jvm, new = self.spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}.new"
        at, fs = self._path(new)
        # a local file system keeps checksums in files of their own, which a rename would move second
        plain = fs
        if at.toUri().getScheme() in (None, "file"):
            plain = jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            plain.initialize(jvm.java.net.URI.create("file:///"), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain.mkdirs(at.getParent())
        out = plain.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        mode = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(mode, 1)
        how[0] = mode.NONE
        try:
            files.rename(at, self._path(path)[0], how)
        except Exception:
            fs.delete(at, False)
            raise

    def _manifests(self) -> list[int]:
        at, fs = self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _latest(self) -> tuple[int, dict[str, list[str]]]:
        """(number, parts by table) of the latest manifest."""
        found = self._manifests()
        return (found[-1], json.loads(self._text(f"{self.root}/manifests/{found[-1]}"))) if found else (0, {})

    def parts(self) -> dict[str, list[str]]:
        """The parts of every table."""
        return self._latest()[1]

    def _publish(self, changed: dict[str, list[str]], seen: tuple[int, dict[str, list[str]]]) -> None:
        self._put(f"{self.root}/manifests/{seen[0] + 1}", json.dumps(seen[1] | changed, sort_keys=True))

    def read(self, table: str) -> DataFrame:
        """The current rows; an empty frame of the known schema if nothing was written."""
        parts = self.parts().get(identifier(table))
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        paths = [f"{self.root}/{table}/{p}" for p in parts]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if table in TABLES else self.spark.read.parquet(*paths)

    def write(self, table: str, df: DataFrame) -> str:
        """Write a part without making it current."""
        part = f"v-{uuid.uuid4().hex}"
        schema = TABLES.get(identifier(table))
        if schema is not None:
            from pyspark.sql import functions as F

            df = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
        df.write.parquet(f"{self.root}/{table}/{part}")
        return part

    def replace(self, table: str, df: DataFrame) -> None:
        self.replace_all({table: df})

    def replace_all(self, tables: dict[str, DataFrame]) -> None:
        """Write all new parts first, then publish them together: plans may read what is replaced."""
        seen = self._latest()
        self._publish({name: [self.write(name, df)] for name, df in tables.items()}, seen)

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows as one more part. What another writer publishes meanwhile stays: an append goes after it."""
        part = self.write(table, df)
        while True:
            seen = self._latest()
            try:
                return self._publish({table: [*seen[1].get(table, []), part]}, seen)
            except Exception:
                if self._latest()[0] == seen[0]:  # nobody was faster: the fault is another one
                    raise

    def expire(self, older_than: float = 86_400.0) -> int:
        """Delete parts that the manifest doesn't name and that are older than so many seconds; how many went."""
        root, fs = self._path(self.root)
        current, gone, before = self.parts(), 0, (time.time() - older_than) * 1000
        for number in self._manifests()[:-1]:
            at, _ = self._path(f"{self.root}/manifests/{number}")
            if fs.getFileStatus(at).getModificationTime() < before:
                fs.delete(at, False)
        for folder in fs.listStatus(root) if fs.exists(root) else []:
            name = folder.getPath().getName()
            for part in fs.listStatus(folder.getPath()) if folder.isDirectory() and name not in ("locks", "manifests") else []:
                if part.getPath().getName() not in current.get(name, []) and part.getModificationTime() < before:
                    gone += fs.delete(part.getPath(), True)
        return gone

    # ---------------------------------------------------------------- lock

    def acquire(self, name: str, owner: str, ttl: float = 7200.0) -> bool:
        """Create the lock; an expired one is taken over. A rename that must not overwrite decides between two at once."""
        path = f"{self.root}/locks/{identifier(name)}"
        held = self._text(path)
        if held is not None:
            if float(held.split("\t")[1]) > time.time():
                return held.split("\t")[0] == owner
            # of two that find it expired, only one can move this very lock away
            try:
                at, fs = self._path(path)
                if self._text(path) != held or not fs.rename(at, self._path(f"{path}.expired-{uuid.uuid5(uuid.NAMESPACE_OID, held).hex}")[0]):
                    return False
            except Exception:
                return False
        try:
            self._put(path, f"{owner}\t{time.time() + ttl}")
        except Exception:  # another owner was quicker
            return False
        return True

    def release(self, name: str, owner: str) -> None:
        path = f"{self.root}/locks/{identifier(name)}"
        held = self._text(path)
        if held is not None and held.split("\t")[0] == owner:
            at, fs = self._path(path)
            fs.delete(at, False)
