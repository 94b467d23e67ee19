"""The detector on streams. It is stateless: each micro-batch is a narrow map, and only running counts are kept."""

from __future__ import annotations

import threading

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Repetition
from ..operators.repetition import with_repetition


def detect_files(spark: SparkSession, path: str, schema: T.StructType | str, text_col: str = "text", r: Repetition = Repetition(), files_at_once: int = 100) -> DataFrame:
    """A stream over new Parquet files with the hit of each text."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return with_repetition(stream, text_col, r)


def windowed_rates(stream: DataFrame, time_col: str, width: str = "10 minutes", late: str = "30 minutes", hit: str = "hit") -> DataFrame:
    """Loop rates in tumbling windows. Written whole (complete mode) all windows are kept, and late rows counted; to drop
    closed windows and keep late rows aside, see ``late``."""
    counts = stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("window")).agg(F.count("*").alias("n_texts"), F.count_if(F.col(hit).isNotNull()).alias("n_loops"))
    return counts.withColumn("loop_rate", F.lit(100.0) * F.col("n_loops") / F.greatest("n_texts", F.lit(1)))


def write_whole(result: DataFrame, out: str, checkpoint: str):
    """Writes the whole result of an aggregated stream after each micro-batch, as <out>/batch=<number>; for results whose
    groups are few at any length of the stream, as all of them are state."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return result.writeStream.foreachBatch(sink).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_target(stream: DataFrame, out: str, checkpoint: str, target: int, hit: str = "hit"):
    """Writes hits as Parquet, a folder a micro-batch, and stops after the micro-batch that reaches ``target``; surplus
    hits of it are cut. What earlier runs wrote is counted first, so a restart goes on where it was."""
    spark, state, started = stream.sparkSession, {"n": None}, threading.Event()

    def written(before: int) -> int:
        try:
            return spark.read.parquet(out).filter(F.col("batch") < before).count()
        except AnalysisException:  # nothing is written yet
            return 0

    def sink(batch: DataFrame, number: int) -> None:
        if state["n"] is None:
            state["n"] = written(number)
        left = target - state["n"]
        if left > 0:
            path = f"{out}/batch={number}"
            batch.filter(F.col(hit).isNotNull()).limit(left).write.mode("overwrite").parquet(path)
            state["n"] += spark.read.schema(batch.schema).parquet(path).count()
        if state["n"] >= target:
            started.wait()
            threading.Thread(target=query.stop, daemon=True).start()  # the query ends when this call has returned

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.set()
    return query
