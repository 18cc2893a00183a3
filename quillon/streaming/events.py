"""Event-time windows over ``events``: beyond the blueprint's scope, for batch and stream alike.

Each function takes a static or a streaming DataFrame; for streams give a
watermark, after which late rows are dropped and state is let go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    """The watermark of a stream; times without zone become those of the session's, as it asks for."""
    if not watermark or not df.isStreaming:
        return df
    if dict(df.dtypes)[time] == "timestamp_ntz":
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, watermark)


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    rows = _marked(df, time, watermark).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, size: str, slide: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    rows = _marked(df, time, watermark).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    rows = _marked(df, time, watermark).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), *keys, "n")


def debounce(df: DataFrame, time: str, quiet: str, keys: list[str], value: str, watermark: str | None = None) -> DataFrame:
    """The newest value of each burst: events of a key less than ``quiet`` apart."""
    rows = _marked(df, time, watermark).groupBy(F.session_window(time, quiet), *keys).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))
    return rows.select(*keys, time, value)


def read_folder(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_sink(path: str, keys: list[str], time: str):
    """A foreachBatch function that writes the newest row of each key of a batch under the batch's number.

    A repeated batch replaces itself. A key may be in several batches; ``read_upserted``
    gives its newest row over all of them.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), time).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_upserted(spark, path: str, keys: list[str], time: str) -> DataFrame:
    """The newest row of each key of a table that ``upsert_sink`` writes; of equal times the later batch's."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(time, "batch")).alias("r")).select("r.*")
