"""What several operators share: cutting lineage and plain text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of the white space that separates words.
SPACES = r"[\x20\x09-\x0D]+"


def _scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local temporary one only where Spark itself is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder that the cluster names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_scratch(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows by way of a compressed Parquet table in that folder, for wider rows."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def set_apart(names: list[str]) -> list[Column]:
    """These columns under names of their own, so that helper columns clash with none."""
    return [col(c).alias(f"_k{i}") for i, c in enumerate(names)]


def put_back(names: list[str]) -> list[Column]:
    """The columns of set_apart under their names."""
    return [F.col(f"_k{i}").alias(c) for i, c in enumerate(names)]
