"""Reading tables so that all cores have work, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(rows: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt anew among the cores; any other stays as it is.

    A file of one row group is one task's work however many cores there are.  Rules over the table read it through the one
    shuffle: the filter, which always holds, keeps their own filters from being pushed below it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores).filter(F.rand(0) >= 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (empty for null) of the table of documents."""
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, written to the folder that spark.checkpoint.dir names; to a temporary one only where that is unset, as in tests."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="scalarium-"))
    return rows.checkpoint()
