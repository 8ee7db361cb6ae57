"""CSV files landing in a folder -> checked, typed Parquet, incrementally.

The file source picks up new files only; each micro-batch goes through the same rules as the
batch loader (:func:`mercato.operators.quality.conform`) and the same error-rate gate. Output is
written per batch to ``<out>/batch_id=<n>`` with mode ``overwrite``, so a batch re-run after a
failure replaces its own output instead of appending twice (the file source and the checkpoint
give the same files to the re-run).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mercato.operators.quality import check_error_rate, conform
from mercato.schema import SURPLUS, TABLES
from mercato.sources.csv import NULL_TOKENS, file_columns, text_schema


def _batch_writer(out_path: str, max_fraction: float):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # re-computable from the same files if lost
        try:
            check_error_rate(batch, max_fraction)
            batch.filter(F.size("errors") == 0).drop("errors", "raw").write.mode("overwrite").parquet(
                f"{out_path.rstrip('/')}/batch_id={batch_id}"
            )
            batch.filter(F.size("errors") > 0).write.mode("overwrite").parquet(
                f"{out_path.rstrip('/')}_rejects/batch_id={batch_id}"
            )
        finally:
            batch.unpersist()

    return write


def start_csv_ingest(
    spark: SparkSession,
    source_dir: str,
    table: str,
    out_path: str,
    checkpoint_location: str | None = None,
    level: str = "conform",
    max_fraction: float = 0.1,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start loading the CSV files of ``table`` that appear in ``source_dir``.

    ``available_now`` processes what is there and stops (scheduled loads); otherwise the query keeps
    running. The streaming checkpoint defaults to
    ``<out_path>_checkpoint``, so a restart in another application goes on where the last one ended.
    """
    t = TABLES[table]
    if checkpoint_location is None:
        checkpoint_location = f"{out_path.rstrip('/')}_checkpoint"
    reader = (
        spark.readStream.schema(text_schema((*file_columns(t), SURPLUS)))
        .option("header", True)
        .option("sep", ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("columnPruning", False)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(source_dir)
    text = raw.select(*[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in (*t.column_names, SURPLUS)])
    flagged = conform(text, table, level)
    writer = flagged.writeStream.foreachBatch(_batch_writer(out_path, max_fraction)).option(
        "checkpointLocation", checkpoint_location
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
