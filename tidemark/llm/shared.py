"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, one of our own on a single machine (tests), else an
    error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, one folder for each value of ``partition_by``."""
    return written_at(df, *partition_by)[0]


def written_at(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path, by which ``remove`` takes it away."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a table of ``written_at`` that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose keys have the smallest hashes, all if there are fewer.

    Of large tables only rows below a bound of the hash are sorted, about four times as many as wanted, so that what
    the partitions hand on doesn't grow with their number.
    """
    code = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    total = rows.count()
    if total > 8 * n:
        below = rows.filter(code < int((1 << 40) * (4 * n + 200) / total))
        if below.limit(n).count() == n:  # else few keys are repeated often, and none may lie below the bound
            rows = below
    return rows.orderBy(code, key).limit(n)
