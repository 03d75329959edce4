"""Small files, folders and scratch tables on whatever file system the cluster shares."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StoreError


class Files:
    """Small files and folders by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def of(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def put(self, path: str, text: str) -> bool:
        """The whole text under a name that is still free; False, and nothing written, if it is taken. Of several writers one succeeds.

        The text is written beside it first. Local folders get it by a hard link, others by a rename, which HDFS refuses where the name is taken.
        """
        fs, p = self.of(path)
        fs.mkdirs(p.getParent())
        parent = fs.resolvePath(p.getParent())
        tmp = self.jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}")
        goal = self.jvm.org.apache.hadoop.fs.Path(parent, p.getName())
        fs = parent.getFileSystem(self.conf)
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if parent.toUri().getScheme() != "file":
                return not fs.exists(goal) and fs.rename(tmp, goal)
            at = lambda q: self.jvm.java.io.File(q.toUri().getPath()).toPath()
            try:
                self.jvm.java.nio.file.Files.createLink(at(goal), at(tmp))
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise StoreError(f"{path} could not be written: {e}") from e
            return True
        finally:
            fs.delete(tmp, False)

    def read(self, path: str) -> str | None:
        fs, p = self.of(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> dict[str, float]:
        """The names in a folder and the seconds since they changed; those that begin with a dot are left out."""
        fs, p = self.of(path)
        if not fs.exists(p):
            return {}
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")}

    def delete(self, path: str) -> None:
        fs, p = self.of(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self.of(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only where that is unset in local mode (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = path or shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
