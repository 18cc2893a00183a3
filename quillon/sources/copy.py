"""COPY in text, CSV and a binary substitute (Parquet), and tables that are written and refreshed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.recursive import pin


def _options(form: str, delimiter: str | None, null: str | None, header: bool, quote: str, escape: str | None) -> dict[str, str]:
    for name, x in (("delimiter", delimiter), ("quote", quote), ("escape", escape)):
        if x is not None and len(x.encode()) != 1:
            raise ValueError(f"COPY {name} must be a single one-byte character")
    if form == "text":
        return {"sep": delimiter or "\t", "nullValue": "\\N" if null is None else null, "emptyValue": "", "quote": "", "header": str(header).lower(), "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
    return {"sep": delimiter or ",", "nullValue": "" if null is None else null, "emptyValue": '""' if null is None else "", "quote": quote, "escape": escape or quote, "header": str(header).lower(), "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}


_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def copy_to(df: DataFrame, path: str, form: str = "csv", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None, force_quote: Sequence[str] | bool = (), mode: str = "error") -> None:
    """COPY ... TO a folder, one file for each partition.

    ``force_quote`` True quotes every value; with names only those columns are quoted.
    """
    if form == "binary":
        df.write.mode(mode).parquet(path)
        return
    options = _options(form, delimiter, null, header, quote, escape)
    if form == "text":
        marked = [F.col(c).cast("string") for c in df.columns]
        for raw, safe in (*_ESCAPES, *([] if options["sep"] in "\t\n\r\\" else [(options["sep"], "\\" + options["sep"])])):
            marked = [F.replace(c, F.lit(raw), F.lit(safe)) for c in marked]
        line = F.concat_ws(options["sep"], *(F.coalesce(c, F.lit(options["nullValue"])) for c in marked))
        df.select(line.alias("value")).write.mode(mode).text(path)
        return
    if force_quote and force_quote is not True:
        parts = [_quoted(F.col(c), c in force_quote, quote, escape or quote, options) for c in df.columns]
        df.select(F.concat_ws(options["sep"], *parts).alias("value")).write.mode(mode).text(path)
        return
    df.write.mode(mode).options(**options, quoteAll=str(bool(force_quote)).lower()).csv(path)


def _quoted(c: Column, always: bool, quote: str, escape: str, options: dict) -> Column:
    text = c.cast("string")
    needs = F.lit(True) if always else F.contains(text, F.lit(options["sep"])) | F.contains(text, F.lit(quote)) | text.rlike("[\r\n]") | (text == options["nullValue"])
    shown = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(escape + quote)), F.lit(quote))
    return F.coalesce(F.when(needs, shown).otherwise(text), F.lit(options["nullValue"]))


def copy_from(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "csv", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None, on_error: str = "stop", where: Column | None = None) -> DataFrame:
    """COPY ... FROM with a declared schema; malformed rows stop the read or are left out."""
    if form == "binary":
        df = spark.read.schema(schema).parquet(path)
    elif form == "text":
        target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        options = _options(form, delimiter, null, header, quote, escape)
        mark = f"\\x{ord(options['sep']):02x}"  # fields are told apart before escapes are undone, so an escaped delimiter is part of one
        parts = F.regexp_extract_all(F.concat("value", F.lit(options["sep"])), F.lit(f"((?:\\\\.|[^\\\\{mark}])*){mark}"), F.lit(1))
        cells = []
        for i, f in enumerate(target.fields):
            cell = F.get(parts, F.lit(i))
            plain = F.when(cell != options["nullValue"], _unescape(cell))
            cells.append((plain.cast(f.dataType) if on_error == "stop" else plain.try_cast(f.dataType)).alias(f.name))
        lines = spark.read.text(path)
        if on_error == "ignore":
            good = F.size(parts) == len(target.fields)
            for c, f in zip(cells, target.fields, strict=True):
                good = good & (c.isNotNull() | (F.get(parts, F.lit(target.fieldNames().index(f.name))) == options["nullValue"]))
            lines = lines.filter(good)
        df = lines.select(*cells)
    else:
        mode = {"stop": "FAILFAST", "ignore": "DROPMALFORMED"}[on_error]
        df = spark.read.schema(schema).options(**_options(form, delimiter, null, header, quote, escape), mode=mode).csv(path)
    return df if where is None else df.filter(where)


def _unescape(c: Column) -> Column:
    parts = F.regexp_extract_all(c, F.lit(r"\\.|[^\\]+"), F.lit(0))
    back = F.create_map(*(F.lit(x) for raw, safe in _ESCAPES for x in (safe, raw)))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(back, p), F.regexp_replace(p, r"^\\(.)", "$1"))), "")


def create_as(df: DataFrame, path: str, with_data: bool = True) -> DataFrame:
    """CREATE TABLE AS [WITH NO DATA]; a materialized view is the same table."""
    (df if with_data else df.limit(0)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """REFRESH MATERIALIZED VIEW: computed beside the old table, which is then renamed away.

    Between the two renames a reader may find no table; what a failure there leaves
    is put right by the next refresh.
    """
    spark = df.sparkSession
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    live, fresh, old = of(path), of(path + ".new"), of(path + ".old")
    files = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old) and not files.exists(live):
        files.rename(old, live)
    files.delete(old, True)
    df.write.mode("overwrite").parquet(path + ".new")
    if files.exists(live):
        files.rename(live, old)
    files.rename(fresh, live)
    files.delete(old, True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def foreign(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A foreign table: files of any format that Spark has a reader for, with its options; filters and columns reach it."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def folder_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a snapshot with the hash of each row; ``stale`` tells whether it still is what the table holds."""
    hashed = df.withColumn("row_hash", F.xxhash64(*df.columns))
    hashed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(hashed.schema).parquet(path)


def stale(df: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: whether rows were added to or taken from the table since the snapshot, and how many."""
    now = df.select(F.xxhash64(*df.columns).alias("h")).groupBy("h").agg(F.count("*").alias("now"))
    was = snapshot.select(F.col("row_hash").alias("h")).groupBy("h").agg(F.count("*").alias("was"))
    both = now.join(was, "h", "full").select(F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("was", F.lit(0)).alias("was"))
    sums = both.agg(F.coalesce(F.sum(F.greatest(F.col("now") - F.col("was"), F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.greatest(F.col("was") - F.col("now"), F.lit(0))), F.lit(0)).alias("removed"))
    return sums.select("added", "removed", ((F.col("added") > 0) | (F.col("removed") > 0)).alias("stale"))


def sample(df: DataFrame, percent: float, seed: int | None = None, system: bool = False) -> DataFrame:
    """TABLESAMPLE BERNOULLI, or SYSTEM: whole partitions, chosen by their number."""
    if not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    if not system:
        return df.sample(percent / 100, seed)
    draw = F.pmod(F.xxhash64(F.spark_partition_id(), F.lit(seed or 0)), F.lit(1_000_000))
    return df.filter(draw < percent * 10_000)


def next_ids(df: DataFrame, column: str, existing: DataFrame | None = None, start: int = 1, increment: int = 1) -> DataFrame:
    """Identity values from the largest id that exists; gaps may occur between partitions, as with a sequence."""
    top = existing.agg(F.max(column)).first()[0] if existing is not None else None
    base = start if top is None else top + increment
    return df.withColumn(column, F.lit(base) + F.monotonically_increasing_id() * increment)


def nextval(df: DataFrame, column: str, order: Sequence[str], start: int = 1, increment: int = 1) -> DataFrame:
    """The rows with the next values of a sequence in the order of keys, without gaps.

    Rows are dealt out by ranges of the keys; only a count for each partition comes
    to the driver. The dealt rows are checkpointed, so that both readings see the same.
    """
    placed = pin(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted(placed.groupBy("__part").count().collect())
    before, n = {}, 0
    for part, count in counts:
        before[part] = n
        n += count
    firsts = F.create_map(*(F.lit(x) for pair in (before or {0: 0}).items() for x in pair))
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return placed.withColumn(column, F.lit(start) + (firsts[F.col("__part")] + inside) * increment).drop("__part")


def package_hashes(df: DataFrame) -> DataFrame:
    """Files (path, content) with the SHA-256 of their content."""
    return df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def verify_package(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (path, hash): only those that are missing, extra or changed."""
    both = package_hashes(files).join(manifest.select("path", F.col("hash").alias("listed")), "path", "full")
    state = F.when(F.col("hash").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("hash") != F.col("listed"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")
