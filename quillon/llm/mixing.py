"""Mix sources to target weights by capped water-filling.

Method: every source asks for its share of the mix by weight. A source whose
share passes its cap (its size times the largest number of epochs) is clamped
there and what is left is shared again by weight among the others until no
share passes a cap. Ordering the sources by cap over weight makes the clamped
ones a prefix, so one pass of running sums finds the level at which it stops.
A source then repeats each document floor(target / size) times; for the
fraction that is left, documents follow in the order of a seeded hash as long as
their words fit, each at most once more, and of the rest of the last bin the one
document whose size is nearest to what is still missing, if that comes nearer.

The order of a source is never brought together in one task: hashes fall into
bins, the sums of the bins say which bin the fraction ends in, and only that
bin is sorted. The number of bins follows the number of rows. The last bin is
gone through ``PASSES`` times for documents that still fit; more passes would
only bring a source nearer to its target than one document of that bin. The
water level is found in one task from one row for each source: a mix names its
sources, and a million of them take some 100 MB there.

Cases. A null or empty text has size 0, takes nothing and isn't repeated. A null
source is a source of its own and comes last in the order of weights. The hash is
of id and text, so neither null nor repeated ids fall together; rows that agree
in id, source and text are told apart by nothing, share a bin, and may change
places: together they are repeated as often as the mix takes them. An empty table
gives no rows. Only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quillon.llm.common import WORD, save

WEIGHTS = (5.0, 2.0, 1.0)
#: How often the last bin is gone through for documents that still fit.
PASSES = 3


def seeded_hash(key, text, seed: int):
    """52 bits of the MD5 of the id, the seed and the MD5 of the text, which SQL engines compute alike."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """The water-filling: one row for each source with its ``target`` in words.

    ``sources`` has ``source`` and ``source_size``; both windows run over one row
    for each source, in one task.
    """
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    every = W.Window.partitionBy()
    fill = W.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "asked": F.sum("source_size").over(every) * F.lit(float(share)),
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(fill.rowsBetween(0, W.Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("level", (F.col("asked") - F.col("clamped")) / F.col("open"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words and the seeded ``draw`` of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), seeded_hash(F.col("doc_id"), F.col("text"), seed).alias("draw"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: int = 17, rows_per_bin: int = 5_000) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``repeats`` (whole repetitions, the sampled one included), ``taken`` (its
    words times that) and ``draw``. Deterministic for given rows and ``seed``.
    """
    sized = measured(docs, seed)
    sized = save(sized)
    rows = sized.count()
    bits = min(52, (rows // rows_per_bin).bit_length())
    sized = sized.withColumn("bin", F.shiftright("draw", 52 - bits))
    held = save(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    goal = targets(held.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # Where the fraction ends: one row for each source and bin, at most `bins` of them in a window.
    order = W.Window.partitionBy("source").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)
    cut = held.withColumn("bin_before", F.coalesce(F.sum("bin_size").over(order), F.lit(0)))
    cut = cut.join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    state = F.when(F.col("bin_before") + F.col("bin_size") <= F.col("rest"), 1).when(F.col("bin_before") >= F.col("rest"), 0).otherwise(2)
    cut = cut.select(F.col("source").alias("cut_source"), F.col("bin").alias("cut_bin"), "bin_before", "source_size", "target", "whole", "rest", state.alias("state"))
    # One row for each source and bin: the bins are bounded by rows / rows_per_bin, which may pass a broadcast.
    placed = sized.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bin") == F.col("cut_bin")))
    columns = ["doc_id", "source", "size", "source_size", "target", "draw"]
    some = (F.col("size") > 0).cast("long")
    whole = placed.filter("state < 2").select(*columns, (some * (F.col("whole") + F.col("state"))).alias("repeats"))
    bin_of = W.Window.partitionBy("source", "bin")
    drawn = bin_of.orderBy("draw", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, 0)
    ends = placed.filter("state = 2").withColumns({"fits": F.lit(False), "short": F.col("rest") - F.col("bin_before")})
    for _ in range(PASSES):  # a document too long for what is missing doesn't keep the shorter ones after it out
        small = ~F.col("fits") & (F.col("size") <= F.col("short"))
        ends = ends.withColumn("words_up_to", F.when(small, F.sum(F.when(small, F.col("size"))).over(drawn)))
        ends = ends.withColumn("fits", F.col("fits") | F.coalesce(F.col("words_up_to") <= F.col("short"), F.lit(False)))
        ends = ends.withColumn("short", F.col("short") - F.coalesce(F.max(F.when(F.col("words_up_to") <= F.col("short"), F.col("words_up_to"))).over(bin_of), F.lit(0)))
    nearest = bin_of.orderBy("fits", F.abs(F.col("size") - F.col("short")), "draw", "doc_id", "size")
    topped = ~F.col("fits") & (F.row_number().over(nearest) == 1) & (F.abs(F.col("size") - F.col("short")) < F.col("short"))
    edge = ends.select(*columns, (some * (F.col("whole") + (F.col("fits") | topped).cast("long"))).alias("repeats"))
    return whole.unionByName(edge).withColumn("taken", F.col("repeats") * F.col("size"))


def repeat(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: int = 17, rows_per_bin: int = 5_000) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all columns kept, as often as ``mix`` takes it."""
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  keys without nulls, so that window and join are dealt alike
    keys = lambda side, draw: [marked("doc_id").alias(f"{side} id"), marked("source").alias(f"{side} source"), draw.alias(f"{side} draw")]
    counts = mix(docs, weights, share, epochs, seed, rows_per_bin).select("repeats", *keys("mixed", F.col("draw")))
    names = [f"{{}} {k}" for k in ("id", "source", "draw")]
    counts = counts.groupBy(*(n.format("mixed") for n in names)).agg(F.sum("repeats").alias("mixed total"), F.count("*").alias("mixed rows")).filter("`mixed total` > 0")
    of = docs.select(F.struct("*").alias("row"), *keys("own", seeded_hash(F.col("doc_id"), F.col("text"), seed)))
    nth = F.row_number().over(W.Window.partitionBy(*(n.format("own") for n in names)).orderBy("own draw"))
    joined = of.withColumn("own nth", nth).join(counts, [F.col(n.format("own")) == F.col(n.format("mixed")) for n in names])
    times = F.floor(F.col("mixed total") / F.col("mixed rows")) + (F.col("own nth") <= F.col("mixed total") % F.col("mixed rows")).cast("long")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")).select("row.*")
