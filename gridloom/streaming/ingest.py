"""Structured Streaming forms of the chain: new grids as they arrive, recheck by run (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import model as M
from gridloom.plans import pipeline as P

GRID = "doc_id long, table_id long, page int, caption string, row_idx int, cells array<string>"


def grid_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Grid rows of new Parquet files; a file holds whole documents."""
    return spark.readStream.schema(GRID).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str, options: P.Options = P.Options()):
    """Each micro-batch goes through the chain; tables and quarantine land under the batch's number, so a repeated batch overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        made = P.run(M.pack(batch, "page", "caption"), options)
        for name in ("tables", "quarantine"):
            made[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stream: DataFrame, time_col: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Tables per document and time window, late rows up to the watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "doc_id").agg(F.count("*").alias("n"))
