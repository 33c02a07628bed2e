"""Draining a streaming query into files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slicelens.operators.joins import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available in micro-batches; return what the sink holds.

    State checkpoints and output live in the shared folder, so a lost executor
    or a restarted driver resumes without losing or repeating rows.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, name)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        running = (
            stream.writeStream.format("parquet")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    return spark.read.schema(schema).parquet(f"{folder}/rows")
