"""What the operators share: scratch tables in the cluster's shared folder, and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir; only where that is unset in local mode (tests), below a temporary folder. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once in a session, so that jobs don't need it installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "lodestone.zip")  # stays: executors fetch it when they start
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(p := os.path.join(folder, name), os.path.relpath(p, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._lodestone_shipped = True


def staged(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_by_key(rows: DataFrame, small: DataFrame, keys: list[str], count_col: str, total: int, share: int = 512) -> DataFrame:
    """rows joined with small, a staged table with a row per key and, in count_col, the number of that key's rows among all `total`.

    At most `share` keys can hold more than total / share rows each; those meet their rows by broadcast, so no task gets all rows of a hot key.
    """
    cut = max(total // share, 1000)
    hot = small.where(F.col(count_col) > cut)
    if hot.isEmpty():
        return rows.join(small.drop(count_col), keys)
    plain = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(count_col) <= cut).drop(count_col), keys)
    return rows.join(F.broadcast(hot.drop(count_col)), keys).unionByName(plain)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of df."""
    out = []
    for n in names:
        while n in df.columns:
            n += "_"
        out.append(n)
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
