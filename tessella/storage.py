"""Files and tables in whatever store Spark is set up for."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tessella.errors import Conflict, EngineError


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves
    sessions whose executors are threads of the driver (tests); others are refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def arrow_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system, and the path in it, by which tasks open files of a folder (a path, or an
    address that Arrow knows)."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


_written: list[str] = []


def remember(path: str) -> str:
    """A path that ``release`` deletes with the stored tables."""
    _written.append(path)
    return path


def mark() -> int:
    """How far tables were stored by now, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the tables that ``stored`` wrote in this process from ``since`` (a ``mark``) on, but
    for the last ``but``, once no result needs them; how many."""
    gone = _written[since : len(_written) - but]
    del _written[since : len(_written) - but]
    return sum(Store(spark).delete(path) for path in gone)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what stands before, and
    later stages read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Files by Hadoop path: any scheme that Spark can open."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def delete(self, path: str) -> bool:
        """Delete a file or folder; false if there is none."""
        system, where = self._at(path)
        return system.delete(where, True)

    def size(self, path: str) -> int:
        system, where = self._at(path)
        return system.getFileStatus(where).getLen()

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it doesn't exist."""
        system, where = self._at(folder)
        return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []

    def read(self, path: str) -> str:
        system, where = self._at(path)
        stream = system.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file, whole or not at all; ``FileExistsError`` if the name is taken.

        The text is written beside the target and then published under its name in one step that
        fails if the name exists: a rename without overwriting, or a hard link on local disks.
        """
        system, where = self._at(path)
        beside_path = f"{path}.{uuid.uuid4().hex}.tmp"
        _, beside = self._at(beside_path)
        stream = system.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if system.getScheme() == "file":
                os_path = self._jvm.java.io.File
                link, whole = (os_path(system.makeQualified(x).toUri().getPath()).toPath() for x in (where, beside))
                self._jvm.java.nio.file.Files.createLink(link, whole)
            else:
                qualified = [system.makeQualified(x) for x in (beside, where)]
                rename = self._jvm.org.apache.hadoop.fs.Options.Rename
                no_options = self._gateway.new_array(rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[1].toUri(), self._conf).rename(*qualified, no_options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise FileExistsError(path) from None
            raise
        finally:
            system.delete(beside, False)

    def concatenate(self, parts: list[str], target: str) -> None:
        """One file of the parts' bytes, copied by the JVM, in place of the target once it is whole."""
        system, where = self._at(target)
        _, beside = self._at(f"{target}.{uuid.uuid4().hex}.tmp")
        out = system.create(beside, False)
        try:
            for part in parts:
                source, at = self._at(part)
                stream = source.open(at)
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 4 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
        if system.exists(where):
            system.delete(where, False)
        if not system.rename(beside, where):
            raise OSError(f"could not replace {target}")


class Versions:
    """Numbered texts of a folder, ``<name>-<number>.json``: the highest is the present one. A
    number is taken by one writer only, and a crash leaves the version before."""

    #: Old versions that stay for readers that still hold them.
    KEPT = 20

    def __init__(self, store: Store, folder: str, name: str):
        self.store, self.folder, self._name = store, folder, re.compile(rf"{re.escape(name)}-([0-9]{{12}})\.json")
        self.name = name

    def numbers(self) -> list[int]:
        return [int(m[1]) for x in self.store.names(self.folder) if (m := self._name.fullmatch(x))]

    def path(self, number: int) -> str:
        return f"{self.folder}/{self.name}-{number:012d}.json"

    def latest(self) -> tuple[int, str | None]:
        """Number and text of the present version; 0 and None if there is none."""
        number = max(self.numbers(), default=0)
        return number, self.store.read(self.path(number)) if number else None

    def publish(self, number: int, text: str) -> None:
        """Make the text version ``number``; ``Conflict`` if another writer has."""
        try:
            self.store.create(self.path(number), text)
        except FileExistsError:
            raise Conflict(f"{self.path(number)} was written by another writer") from None
        for old in self.numbers():
            if old <= number - self.KEPT:
                self.store.delete(self.path(old))
