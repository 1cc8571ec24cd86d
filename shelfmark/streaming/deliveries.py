"""Deliveries as a stream: each row once, late ones within a bound, applied batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.operators import snapshot


def deliveries(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def once(stream: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key that arrives; a repetition within the delay is dropped, and the state with it.

    Times without zone are read in the session's.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def into_table(stream: DataFrame, out: str, checkpoints: str, partition: list[str] = ()) -> StreamingQuery:
    """Append a stream to a Parquet table, all that is there now; exactly once thanks to the sink's log."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoints).trigger(availableNow=True)
    return (writer.partitionBy(*partition) if partition else writer).start()


def differences(stream: DataFrame, state: str, out: str, checkpoints: str) -> StreamingQuery:
    """For each batch of SNAPSHOT rows, how it differs from the state before, appended to `out`; the batch is the new state.

    States and results are written under the number of the batch, so that a batch which is run again gives the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        try:
            before = spark.read.parquet(f"{state}/{number - 1}") if number else batch.limit(0)
            snapshot.diff(before, batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
            batch.write.mode("overwrite").parquet(f"{state}/{number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
