"""Small helpers around the session: table reads and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a private one in local mode (tests); on a cluster, whose
    executors would not share it, an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of a scanned frame; one of fewer parts than there are cores is dealt out over all of them, for work that takes long on
    little data. A larger one is left where it is, so what is shuffled is bounded by the cores, not by the data."""
    df, cores = df.select(*columns), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the highest version; ties fall to the row with the larger remaining columns.

    An aggregate with map-side combine instead of a window, so a hot key never gathers in one task. Rows with text are sorted by
    it on both sides of the shuffle: hand it only the columns that are needed, best as numbers and flags made from the text before."""
    rest = [c for c in df.columns if c not in keys and c != version]
    picked = df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in df.columns if c not in keys]).select(*df.columns)


def ordered(*cols):
    """Window over one notebook in cell order."""
    return Window.partitionBy(cols[0]).orderBy(*cols[1:])


_folders: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to and read from the shared folder: cuts the lineage and survives the loss of executors. ``release`` removes it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that ``written`` left in this session, once the results that read them are no longer needed; how many."""
    n = len(_folders)
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
