"""Contiguous shards of nearly equal bytes, from global prefix sums.

Method: each document's size is its UTF-8 bytes plus one. Rows are dealt out by
ranges of the order key, each partition reports its total, and the totals give
every row the bytes that lie before it in the whole table. Shard k of n takes
the rows whose middle byte lies in the k-th of n equal stretches, so a shard is
a contiguous run of the order and its bytes miss the mean by less than one
document on each side.

Cases. A null or empty text has size 1 and CRC 0. Rows with equal keys are
ordered by the text's CRC and size, so equal rows may change places without a
visible difference. A null key sorts first. An empty table gives no rows. Extra columns are
ignored, or kept together in one struct ``row``, so clashing names do no harm. The law has no groups of its own: equal texts are the only
groups, and a boundary may fall between two copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import prefix_sums


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Assign every row a shard and its place there.

    Returns ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard`` (null: this law moves rows when the count changes) and, with
    ``keep``, the struct ``row`` of all columns.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        *([F.struct("*").alias("row")] if keep else []),
    )
    rows, _, total = prefix_sums(rows, ["doc_id", "text_crc32", "size"], "size")
    middle = F.col("size_before") * 2 + F.col("size")
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(total, 1))).cast("int")))
    first = dict(rows.groupBy("shard").agg(F.min("row_index")).collect())
    starts = F.create_map(*(F.lit(x) for pair in (first or {0: 0}).items() for x in pair))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_index") - starts[F.col("shard")]).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if keep else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text") -> str:
    """Write the table, all its columns, as Parquet with one folder for each shard.

    Returns the name of the folders' column: ``shard``, with underscores after it
    if the table has a column of that name.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    shard(docs, shards, key, text, keep=True).select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
