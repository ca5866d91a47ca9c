"""Files by Hadoop's file systems: a database may lie wherever Spark can write."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *parts: str) -> str:
        for p in parts:
            if ".." in p.split("/") or p.startswith("/"):
                raise ValueError(f"a path leads out of {self.root}: {p}")
        return "/".join((self.root, *parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(self.at(*parts)))

    def names(self, *parts: str) -> list[str]:
        path = self._path(self.at(*parts))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def files(self, *parts: str) -> list[tuple[str, int]]:
        """(path below the root, bytes) of all files below."""
        path, out = self._path(self.at(*parts)), []
        if self.fs.exists(path):
            every = self.fs.listFiles(path, True)
            base = self.fs.makeQualified(self._path(self.root)).toString().rstrip("/") + "/"
            while every.hasNext():
                s = every.next()
                name = s.getPath().toString().removeprefix(base)
                if not name.rsplit("/", 1)[-1].startswith("."):
                    out.append((name, s.getLen()))
        return sorted(out)

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._path(self.at(*parts)))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Writes a new file whole or not at all; False if it is there already. Of two that try at once one gets it.

        On a local disk the name is given by a hard link, which fails where it exists. Hadoop's own file system renames atomically and refuses an existing target. Stores of objects write conditionally, where their client can.
        """
        path = self._path(self.at(*parts))
        self.fs.mkdirs(path.getParent())
        if self.fs.exists(path):
            return False
        scheme = self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "webhdfs", "viewfs"):
            try:
                self._write(self.fs.createFile(path).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build(), text)
                return True
            except Py4JJavaError:
                if self.fs.exists(path):
                    return False
                raise
        part = self._path(f"{path.getParent().toString()}/.{path.getName()}.{uuid.uuid4().hex}")
        self._write(self.fs.create(part, False), text)
        try:
            if scheme == "file":
                nio = [self.jvm.java.io.File(self.fs.makeQualified(x).toUri().getPath()).toPath() for x in (path, part)]
                self.jvm.java.nio.file.Files.createLink(*nio)
                return True
            return bool(self.fs.rename(part, path))
        except Py4JJavaError:
            if self.fs.exists(path):
                return False
            raise
        finally:
            self.fs.delete(part, False)

    @staticmethod
    def _write(stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, text: str, *parts: str) -> None:
        """Writes a file in place of any; a reader finds the old one or the new one where the file system can rename over a file, and on a local disk always."""
        path = self._path(self.at(*parts))
        self.fs.mkdirs(path.getParent())
        part = self._path(f"{path.getParent().toString()}/.{path.getName()}.{uuid.uuid4().hex}")
        self._write(self.fs.create(part, True), text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        over[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(part), self.fs.makeQualified(path), over)

    def age(self, *parts: str) -> float:
        """Seconds since a file was written or touched."""
        return max(0.0, time.time() - self.fs.getFileStatus(self._path(self.at(*parts))).getModificationTime() / 1000)

    def touch(self, *parts: str) -> None:
        self.fs.setTimes(self._path(self.at(*parts)), int(time.time() * 1000), -1)

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._path(self.at(*parts)), True)

    def copy_to(self, other: Files, name: str) -> None:
        target = self._path(other.at(name))
        other.fs.mkdirs(target.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(self.at(name)), other.fs, target, False, True, self.fs.getConf())

    def checksum(self, name: str) -> str:
        """SHA-256 of a file, read in pieces on the JVM."""
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def json(self, *parts: str) -> dict:
        return json.loads(self.read(*parts))


def scratch(spark: SparkSession, what: str) -> str:
    """A new name in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a folder of our own; a cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df evaluated once, as a table in the shared folder; it goes when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, "settled")
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
