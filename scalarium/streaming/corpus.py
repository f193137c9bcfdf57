"""The corpus audit as a stream: new files are audited as they come, and a summary is written last."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarium.operators import detectors
from scalarium.plans import corpus

TEXTS = "doc_id long, text string"


def source(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Texts of Parquet files that appear in a folder."""
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Audits what is in the folder and not yet audited; entries lie under `out`/entries by batch, the summary beside.

    A batch that is done again after a failure replaces its own entries, so each source counts once.  The summary is
    the mark of completion: it is gone while a run is under way.
    """
    marker = f"{out}/summary"
    _remove(spark, marker)

    def batch(texts: DataFrame, number: int) -> None:
        parsed = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("failure_code"))
        rows = corpus.entries(parsed, detectors.all_findings(parsed.select("doc_id", "text")))
        rows.write.mode("overwrite").parquet(f"{out}/entries/batch={number}")

    stream = source(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.parquet(f"{out}/entries")
    corpus.summary(rows).write.mode("overwrite").json(marker)
    return rows


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def completed(spark: SparkSession, out: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/summary/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


__all__ = ["completed", "run", "source"]
