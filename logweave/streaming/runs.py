"""Starting a query over everything available and reading its output table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def to_table(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append to parquet exactly once: the sink's own log names the files of every committed batch."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.option("path", path).trigger(availableNow=True).start()


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    """Run ``write`` on every micro-batch. A batch that is run again must replace what it wrote before."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def put(df: DataFrame, path: str, batch_id: int, partition_by: str | None = None) -> DataFrame:
    """Write a batch's own folder, replacing it, and read it back: what follows is not computed again."""
    folder = f"{path}/batch={batch_id}"
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def until(spark: SparkSession, path: str, batch_id: int, like: DataFrame) -> DataFrame:
    """What batches before this one have written, with the number of the batch; no rows before the first.

    Folders are named one by one, so that a batch that has failed and is run again sees the same.
    """
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.IntegerType())])
    fs, where = versions.file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    old = [n for n in names if n.startswith("batch=") and int(n[6:]) < batch_id]
    if not old:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{n}" for n in old])
