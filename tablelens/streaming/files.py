"""Apply a batch operator to each micro-batch of newly arrived files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_on_new_files(spark: SparkSession, source_dir: str, schema, op: Callable[[DataFrame], DataFrame],
                     sink_dir: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True,
                     max_files_per_trigger: int | None = None):
    """Read ``source_dir`` as a file stream, run ``op`` on every micro-batch and
    write its result to the folder ``batch_id=N`` of ``sink_dir`` as Parquet.

    ``checkpoint`` must be shared storage on a cluster; it records which files
    were processed.  A batch that is repeated after a failure replaces its own
    folder, so the sink holds every batch once.  With ``available_now`` the query processes everything present and stops."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)

    def batch(df: DataFrame, batch_id: int) -> None:
        op(df).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
