"""Objects under a base path, through Hadoop's file systems: any store that Spark reads is one."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import AbstractContextManager, nullcontext

from pyspark.sql import DataFrame, SparkSession


class ObjectNotFound(FileNotFoundError):
    """The object, or a needed part of it, is not there."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share; in local mode, where that is unset, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerline-"))
    return sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class ObjectStore:
    """List, read, write and delete objects by path relative to ``base``.

    Stores whose rename copies and deletes (plain object stores) can't create a name exclusively; for them ``lock`` makes
    a context that one writer at a time is in, given the object's path: a lease in a table or a lock service.
    """

    def __init__(self, spark: SparkSession, base: str, lock: Callable[[str], AbstractContextManager] | None = None):
        self.spark, self.base, self.lock = spark, base.rstrip("/"), lock or (lambda path: nullcontext())

    def path(self, name: str = "") -> str:
        return f"{self.base}/{name}" if name else self.base

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def list(self, folder: str = "", each: Callable[[str, int], bool] | None = None) -> list[tuple[str, int]]:
        """(name, bytes) of the files right in ``folder``, sorted; none if it is missing. ``each`` may return False to stop."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.isFile())
        if each is None:
            return found
        out = []
        for item in found:
            out.append(item)
            if each(*item) is False:
                break
        return out

    def folders(self, folder: str = "") -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def size(self, name: str) -> int:
        fs, p = self._at(name)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Up to ``length`` bytes from ``offset`` on; fewer at the object's end."""
        fs, p = self._at(name)
        if not fs.exists(p):
            raise ObjectNotFound(self.path(name))
        left = max(0, fs.getFileStatus(p).getLen() - offset)
        n = left if length is None else min(left, length)
        if n <= 0:
            return b""
        stream = fs.open(p)
        try:
            stream.seek(offset)
            data = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(self.spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n))
            return bytes(data)
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """The whole object or nothing: the bytes go to a hidden name first, which then becomes the object in one step.

        Without ``overwrite`` an existing object is an error (FileExistsError), so of two writers that race for a name one
        wins. On local disks the step is a hard link or a replacing rename, elsewhere Hadoop's rename that refuses, or
        replaces, an existing name; HDFS does that atomically, other stores need a ``lock``.
        """
        fs, p = self._at(name)
        parent = p.getParent()
        fs.mkdirs(parent)
        hidden = self.spark._jvm.org.apache.hadoop.fs.Path(parent, f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(hidden, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        try:
            with self.lock(self.path(name)):
                if fs.getUri().getScheme() == "file":
                    source, target = (x.toUri().getPath() for x in (hidden, p))
                    os.replace(source, target) if overwrite else os.link(source, target)
                else:
                    self._rename(fs, hidden, p, overwrite)
        except FileExistsError:
            raise FileExistsError(self.path(name)) from None
        finally:
            fs.delete(hidden, False)

    def _rename(self, fs, source, target, overwrite: bool) -> None:
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.valueOf("OVERWRITE" if overwrite else "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(str(target)) from None
            raise

    def age(self, name: str) -> float:
        """Seconds since the object was last written."""
        fs, p = self._at(name)
        return self.spark._jvm.java.lang.System.currentTimeMillis() / 1000 - fs.getFileStatus(p).getModificationTime() / 1000

    def delete(self, name: str) -> bool:
        """Removes an object or folder; whether there was one."""
        fs, p = self._at(name)
        return fs.exists(p) and fs.delete(p, True)
