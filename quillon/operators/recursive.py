"""Recursion: fixpoints without repeats, search order and cycle marks.

A round joins only what the last round found. Results are written to the shared
checkpoint folder each round, so the lineage doesn't grow. In a fixpoint and along
paths only a small round is broadcast, never the edges or what is known: these would
pass through the driver again in each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import shared_folder


def pin(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Rounds that are kept apart before they are written together.
APART = 16

#: Rows of a round that are broadcast to the edges at most; a larger round is shuffled with them.
SMALL = 65_536


def _to_join(fresh: DataFrame, n: int) -> DataFrame:
    """A round of ``n`` rows, marked with how it joins; without a mark Spark takes the edges' files for the smaller side."""
    return fresh.hint("broadcast" if n <= SMALL else "merge")


def _union(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """WITH RECURSIVE ... UNION: what is new in each round, until nothing is.

    A round is written once; what is there is written again only every ``APART``
    rounds. What a step makes is set against what is known by grouping, which can't
    be broadcast or pushed down to the edges. Raises RuntimeError beyond ``limit``
    rounds; UNION ends by itself on finite data.
    """
    fresh = pin(seed.distinct())
    names, rounds, n = fresh.columns, [fresh], fresh.count()
    for _ in range(limit):
        made = step(_to_join(fresh, n)).select(*names, F.lit(False).alias("__known"))
        both = made.unionByName(_union(rounds).withColumn("__known", F.lit(True)))
        fresh = pin(both.groupBy(*names).agg(F.max("__known").alias("__known")).filter("not __known").select(*names))
        n = fresh.count()
        if not n:
            return _union(rounds)
        rounds.append(fresh)
        if len(rounds) > APART:
            rounds = [pin(_union(rounds))]
    raise RuntimeError(f"no fixpoint after {limit} rounds")


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more; the pairs are the result, so their number is its size.

    In each round only pairs that the last round found are lengthened, by all
    pairs known, on both sides: about log2(longest) rounds.
    """
    fresh = pin(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    every = fresh
    while not fresh.isEmpty():
        ahead = fresh.join(every.toDF("a", "b"), F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst"))
        behind = every.join(fresh.toDF("a", "b"), F.col("dst") == F.col("a")).select("src", F.col("b").alias("dst"))
        made = ahead.unionByName(behind).distinct()
        fresh = pin(made.join(every.toDF("a", "b"), F.col("src").eqNullSafe(F.col("a")) & F.col("dst").eqNullSafe(F.col("b")), "left_anti"))
        every = pin(every.unionByName(fresh))
    return every


def reachable(edges: DataFrame, start: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that a path from a start node leads to, starts left out unless a path returns."""
    def step(fresh):
        return fresh.join(edges, F.col(node) == F.col("src")).select(F.col("dst").alias(node))

    begun = pin(start.select(node))
    return fixpoint(step(_to_join(begun, begun.count())), step)


def paths(edges: DataFrame, start: DataFrame, node: str = "node", limit: int = 1000) -> DataFrame:
    """CYCLE: every path from the start nodes, ended where a node comes again.

    ``node``, ``path`` (with the node), ``depth`` from 0 and ``is_cycle``. Order by
    ``path`` for SEARCH DEPTH FIRST, by ``depth`` and ``node`` for BREADTH FIRST.
    """
    fresh = pin(start.select(node, F.array(node).alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("is_cycle")))
    every, n = fresh, fresh.count()
    for _ in range(limit):
        fresh = pin(
            _to_join(fresh, n).filter(~F.col("is_cycle")).join(edges, F.col(node) == F.col("src"))
            .select(F.col("dst").alias(node), F.array_append("path", F.col("dst")).alias("path"), (F.col("depth") + 1).alias("depth"), F.array_contains("path", F.col("dst")).alias("is_cycle"))
        )
        n = fresh.count()
        if not n:
            return every
        every = pin(every.unionByName(fresh))
    raise RuntimeError(f"paths are longer than {limit}")

