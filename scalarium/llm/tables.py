"""Reading, and tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch, at most (or one row), unless the session says otherwise: a worker and its executor hold several.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, whose Arrow batches are bounded by bytes from now on; a setting of its own stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        told = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="scalarium-")
        shared_dir.own = told
    return told.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "zstd", level: int = 3, onto: DataFrame | None = None) -> DataFrame:
    """df written as a table in the shared folder and read from there: its lineage is cut, and lost executors lose nothing.

    With onto, a table that stored() made, df's rows are added to that; what is returned has the rows of both.
    """
    spark = bounded(df.sparkSession)
    path = onto.stored_at if onto is not None else fresh_path(spark, label)
    df.write.mode("append").option("compression", compression).option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() made and that nothing is read from any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
