"""Streaming front ends over arriving tables of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from massloom.operators.fdr import q_values
from massloom.session import released


def arriving(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of matches as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts_by_window(matches: DataFrame, time: str = "loaded_at", key: str = "full_file_path", lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Matches and good targets of each file and time window; rows later than `lateness` behind the newest are left to the batch run."""
    good = (F.col("q_value") <= 0.01) & ~F.isnan("q_value") & (F.col("decoy") == "N")
    timed = matches.withColumn("at__", F.col(time).cast("timestamp")).withWatermark("at__", lateness)
    return timed.groupBy(F.window("at__", window), key).agg(F.count(F.lit(1)).alias("n_psms"), F.sum(F.when(good, 1).otherwise(0)).alias("n_good")).select(key, F.col("window.start").alias("window_start"), "n_psms", "n_good")


def refreshed_q_values(matches: DataFrame, store: str, on_result: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Append each batch to `store` under its number and hand the q-values over all stored matches to `on_result`, which writes them.

    A batch that is run again overwrites its own part, so each match counts once. Every q-value depends on all matches, so all are read; only
    the three columns needed are. What the batch wrote on the way is deleted at its end.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        rows = spark.read.parquet(store).filter("score IS NOT NULL AND NOT isnan(score) AND decoy IS NOT NULL").select("psm_id", "score", (F.col("decoy") == "Y").alias("is_decoy"))
        with released(spark):
            on_result(q_values(rows, [-F.col("score"), F.col("psm_id")], F.col("is_decoy")), number)

    return matches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
