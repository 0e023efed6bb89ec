"""Incremental indexing: new revision files become segments, exactly once, through checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators import segments
from palimpsest.session import shared_dir

COLUMNS = ["id", "memory_id", "searchable_text"]


def index_available(spark: SparkSession, source: str, pattern: str, schema, name: str, files_per_batch: int = 16) -> DataFrame:
    """Segments of all revisions that are there now. Run again with the same ``name`` it only reads
    new files: the checkpoint holds what was done, and a batch that is tried again replaces its own
    output folder."""
    base = f"{shared_dir(spark)}/ingest-{name}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(source).select(*COLUMNS)

    def index(batch: DataFrame, epoch: int) -> None:
        once = batch.dropDuplicates(["id"])
        segments.build(once, "id", "searchable_text").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/segments/epoch={epoch:08d}")

    query = stream.writeStream.foreachBatch(index).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("basePath", f"{base}/segments").parquet(f"{base}/segments/epoch=*")
    # A revision delivered in two batches is the same revision.
    return found.drop("epoch").dropDuplicates(["segment_id"])
