"""Session settings and durable intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Rows one task may hold of one group before the chunked plans take over.
GROUP_ROWS = 2_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on: adaptive execution with skew splitting, UTC.

    The package's functions travel to the Python workers by value, so executors need no copy of it.
    """
    cloudpickle.register_pickle_by_value(sys.modules["tallyframe"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="tallyframe-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` once to the shared folder and read it back.

    Used where a partition id must mean the same rows in every later stage, also after a lost
    executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table in fewer input splits than this is small enough to be dealt out anew.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Deal out a small table that arrives in a handful of input splits, as one local file does.

    Only for row-wise work that costs much more than moving the rows (regular expressions over long
    texts, vector products). A table of FEW_SPLITS splits or more is returned as it is, however many
    cores there are; there `spark.sql.files.maxPartitionBytes` sets the grain.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df
