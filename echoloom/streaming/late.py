"""Streams with rows out of order: late rows aside, and windows whose state goes when they are closed.

``split_late`` is a first stage: it writes the rows of each micro-batch, marked late if they are not newer than the
watermark, which is the newest time of all batches before less the delay. Nothing is lost: late rows are a table of their
own. The second stage reads the rows that came in time as a stream, whose watermark is never ahead of the first one's,
so none of its rows is dropped. Windows and sessions are written once, when the watermark has passed their end, and their
state is dropped then. A restart goes on where the last batch ended; a batch that is run again writes the same folder.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATE = "late"


def split_late(stream: DataFrame, time_col: str, delay: timedelta, out: str, checkpoint: str):
    """Writes <out>/rows/batch=<number>/late=<true or false> and <out>/newest/batch=<number> (one row: the newest time of
    rows in time so far); returns the query. Rows without a time are late."""
    spark = stream.sparkSession

    def newest_before(number: int):
        try:
            marks = spark.read.schema("newest timestamp, batch int").parquet(f"{out}/newest")
        except AnalysisException:  # no batch yet
            return None
        return marks.filter(F.col("batch") < number).agg(F.max("newest")).first()[0]

    def sink(batch: DataFrame, number: int) -> None:
        newest = newest_before(number)
        late = F.col(time_col).isNull() if newest is None else F.col(time_col).isNull() | (F.col(time_col) <= F.lit(newest) - F.lit(delay))
        path = f"{out}/rows/batch={number}"
        batch.withColumn(_LATE, late).write.mode("overwrite").partitionBy(_LATE).parquet(path)
        written = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField(_LATE, T.BooleanType())])).parquet(path)
        top = written.filter(~F.col(_LATE)).agg(F.greatest(F.max(time_col), F.lit(newest).cast("timestamp")).alias("newest"))
        top.coalesce(1).write.mode("overwrite").parquet(f"{out}/newest/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows that came late, with their batch."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField(_LATE, T.BooleanType())])
    return spark.read.schema(whole).option("basePath", f"{out}/rows").parquet(f"{out}/rows").filter(_LATE).drop(_LATE)


def rows_in_time(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The stream of the rows that came in time. It takes all files that are there: a batch of the first stage may have
    many, and if some were left for later, the watermark could pass their rows."""
    return spark.readStream.schema(schema).parquet(f"{out}/rows/batch=*/{_LATE}=false")


def window_counts(stream: DataFrame, time_col: str, delay: timedelta, hit: Column, width: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Texts, hits and their rate in windows of a width, sliding if ``slide`` is given."""
    return _rates(stream.withWatermark(time_col, _text(delay)), F.window(time_col, width, slide) if slide else F.window(time_col, width), hit, by)


def session_counts(stream: DataFrame, time_col: str, delay: timedelta, hit: Column, gap: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Texts, hits and their rate in sessions: runs of rows with at most ``gap`` between neighbours."""
    return _rates(stream.withWatermark(time_col, _text(delay)), F.session_window(time_col, gap), hit, by)


def _text(delay: timedelta) -> str:
    return f"{delay // timedelta(microseconds=1)} microseconds"


def _rates(stream: DataFrame, window: Column, hit: Column, by: tuple[str, ...]) -> DataFrame:
    counts = stream.groupBy(window.alias("window"), *by).agg(F.count("*").alias("n_texts"), F.count_if(hit).alias("n_loops"))
    rate = F.lit(100.0) * F.col("n_loops") / F.greatest("n_texts", F.lit(1))
    return counts.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_texts", "n_loops", rate.alias("loop_rate"))


def append_closed(result: DataFrame, out: str, checkpoint: str):
    """Appends windows to the table <out> when they are closed, each once; returns the query."""
    return result.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
