"""Foreign tables: files of other formats under a server's options."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.sources.copy import foreign


class Server:
    """Options that its tables share: ``format``, ``root`` and whatever the reader knows; a table's own go over them."""

    def __init__(self, spark: SparkSession, options: Mapping[str, str]) -> None:
        self.spark, self.options = spark, dict(options)

    def table(self, path: str, schema: T.StructType | str | None = None, **own: str) -> DataFrame:
        options = self.options | own
        root, form = options.pop("root", ""), options.pop("format", "parquet")
        return foreign(self.spark, f"{root}/{path}" if root else path, form, schema, **options)
