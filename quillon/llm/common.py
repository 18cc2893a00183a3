"""What the operators share: the shared scratch folder, word rules and ordered prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of bytes other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch: what a worker holds at once follows from it, whatever the length of rows.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``.

    Only in a local session without that setting, as in tests, a temporary folder
    takes its place, and goes when the process ends. On a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def _home(spark: SparkSession):
    """The application's own folder for saved tables, with its file system; it goes when the application ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path, files


def save(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage for good.

    What is saved stays as long as the application, or until ``release``.
    """
    spark = df.sparkSession
    home, files = _home(spark)
    if not files.exists(home):
        files.mkdirs(home)
        files.deleteOnExit(home)
    path = f"{home.toString()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that this application has saved; results that weren't written yet can't be read after that."""
    home, files = _home(spark)
    files.delete(home, True)


def pin(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: the rows keep their partitions and their order."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, rows, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for a generator of record batches over an iterator of them.

    Unless the session sets another size, its batches are cut to ``BATCH_BYTES``,
    from then on for the whole session: Spark reads the setting when a plan runs.
    Workers live on between stages, so each task gives back what it no longer uses.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return the free memory of Arrow's and the C library's allocators to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(text: str | None) -> list[bytes]:
    """The words of a whole text with A-Z lower-cased; bytes.lower and split keep to ASCII."""
    return (text or "").encode().lower().split()


def texts(column: pa.Array) -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def prefix_sums(df: DataFrame, order: list[str], size: str) -> tuple[DataFrame, int, int]:
    """Number the rows in a global order and sum what lies before each.

    Rows are dealt out by ranges of ``order`` and sorted inside each partition;
    the driver sees one pair of totals for each partition. Returns the rows with
    ``row_index`` and ``size_before``, the number of rows and the sum of sizes.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = pin(rows.withColumn("part", F.spark_partition_id()))
    totals = sorted(rows.groupBy("part").agg(F.count("*"), F.sum(size)).collect())
    before, n, total = {}, 0, 0
    for part, count, held in totals:
        before[part] = (n, total)
        n, total = n + count, total + held
    schema = T.StructType([f for f in rows.schema if f.name != "part"] + [T.StructField("row_index", T.LongType()), T.StructField("size_before", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = at or before[batch.column("part")[0].as_py()]
            sizes = batch.column(size).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            columns = [batch.column(f.name) for f in schema[:-2]]
            columns += [pa.array(np.arange(len(sizes)) + at[0], pa.int64()), pa.array(ends - sizes + at[1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            at = (at[0] + len(sizes), at[1] + int(ends[-1]))

    return map_arrow(rows, number, schema), n, total
