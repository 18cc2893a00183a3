"""Dependency graphs: edges, closures, cycles, ordered plans and incremental work.

``edges`` are (src, dst, kind): src depends on dst; kind is hard, soft or runtime.
Closures and components are joins. The plan of changes needs a priority at each
step, so it runs on the driver, whose memory it takes in proportion to a catalog's changes.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.recursive import closure, fixpoint, pin, reachable


#: Order of kinds in a plan; destructive steps come last.
PHASES = {"schema": 10, "extension": 12, "type": 15, "sequence": 20, "table": 40, "column": 45, "primary_key": 55, "unique": 57, "check": 60, "index": 65, "foreign_key": 70, "view": 75, "function": 80, "trigger": 85, "drop_constraint": 5, "drop_column": 90, "drop_table": 95}


def build(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes (key) from references (src, dst, kind), case-insensitive, no loops or repeats."""
    known = nodes.select(F.lower("key").alias("low"), F.col("key").alias("name"))
    made = references.select(F.lower("src").alias("ls"), F.lower("dst").alias("ld"), "kind")
    made = made.join(known.withColumnRenamed("low", "ls").withColumnRenamed("name", "src"), "ls").join(known.withColumnRenamed("low", "ld").withColumnRenamed("name", "dst"), "ld")
    return made.filter(F.col("ls") != F.col("ld")).select("src", "dst", "kind").dropDuplicates()


def dependencies(edges: DataFrame, runtime: bool = False) -> DataFrame:
    """All pairs (src, dst) where src depends on dst, directly or not."""
    some = edges if runtime else edges.filter("kind <> 'runtime'")
    return closure(some).filter("src <> dst")


def dependents_of(edges: DataFrame, starts: DataFrame, runtime: bool = False) -> DataFrame:
    """Nodes (node) that depend on a start node, directly or not; the starts themselves left out."""
    some = edges if runtime else edges.filter("kind <> 'runtime'")
    back = some.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, starts).join(starts.select("node"), "node", "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) without nodes that nothing leads to or that lead nowhere, which are on no cycle."""
    n = edges.count()
    while n:
        inner = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        edges = pin(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """For each node the smallest node that leads to it (``colour``), itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = pin(nodes.withColumn("colour", F.col("node")))
    while True:
        told = edges.join(colours, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("colour").alias("told"))
        grown = pin(colours.join(told, F.col("node") == F.col("to"), "left").select("node", F.least("colour", F.coalesce("told", "colour")).alias("colour"), (F.coalesce("told", "colour") < F.col("colour")).alias("new")))
        colours = grown.select("node", "colour")
        if not grown.filter("new").limit(1).count():
            return colours


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components (node, component) of at least two nodes over edges (src, dst).

    In rounds: what is on no cycle is trimmed away; every node takes the smallest
    node that leads to it as its colour; what leads back to a colour's own node
    inside the colour is that node's component, which leaves. No round holds more
    than the edges and one row for each node.
    """
    left = _trimmed(pin(edges.filter("src <> dst").select("src", "dst").distinct()))
    found = None
    while not left.isEmpty():
        colours = _colours(left)
        ends = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst")
        inside = pin(ends.filter("c1 = c2").select("src", "dst", F.col("c1").alias("colour")))
        roots = inside.select(F.col("colour").alias("node"), "colour").distinct()
        back = fixpoint(roots, lambda f, e=inside: f.join(e.withColumnRenamed("colour", "c"), (F.col("node") == F.col("dst")) & (F.col("colour") == F.col("c"))).select(F.col("src").alias("node"), "colour"))
        sizes = back.groupBy("colour").agg(F.count("*").alias("n"))
        now = back.join(sizes.filter("n > 1"), "colour").select("node", F.col("colour").alias("component"))
        found = now if found is None else found.unionByName(now)
        gone = back.select(F.col("node").alias("gone"))
        left = _trimmed(pin(left.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")))
    return found if found is not None else edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of at least two nodes over hard and soft edges.

    ``component`` is the smallest member; ``severity`` is error if a hard edge lies
    inside, else warning.
    """
    solid = edges.filter("kind <> 'runtime'")
    members = components(solid)
    inside = solid.join(members.select(F.col("node").alias("src"), F.col("component").alias("c1")), "src").join(members.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst").filter("c1 = c2")
    hard = inside.groupBy(F.col("c1").alias("component")).agg(F.max(F.when(F.col("kind") == "hard", 1).otherwise(0)).alias("hard"))
    return members.join(hard, "component").select("node", "component", F.when(F.col("hard") == 1, "error").otherwise("warning").alias("severity"))


def loop(members: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """A closed path through a component from its smallest member, by depth first in name order."""
    inside = set(members)
    out = defaultdict(list)
    for a, b in edges:
        if a in inside and b in inside:
            out[a].append(b)
    start = min(inside)
    stack, seen = [(start, iter(sorted(set(out[start]))))], {start}
    while stack:
        for nxt in stack[-1][1]:
            if nxt == start:
                return [n for n, _ in stack] + [start]
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(set(out[nxt])))))
                break
        else:
            stack.pop()
    return []


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest distance of each node (key) of an acyclic graph from one that depends on nothing; cycles are an error."""
    solid = edges.filter("kind <> 'runtime'").select("src", "dst")
    if not _trimmed(pin(solid.distinct())).isEmpty():
        raise ValueError("the graph has cycles")
    placed = nodes.select(F.col("key").alias("node"), F.lit(0).alias("level"))
    grown = fixpoint(placed, lambda f: f.join(solid, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), (F.col("level") + 1).alias("level")))
    return grown.groupBy("node").agg(F.max("level").alias("level"))


def plan(changes: Sequence[Mapping], edges: Sequence[tuple[str, str, str]]) -> list[str]:
    """Ids of changes (id, key, phase, destructive, stub) in an order that respects hard and soft edges.

    Of those that are ready the lowest (phase, input place) goes next; destructive
    changes ignore edges. In each hard cycle the smallest key whose change can be
    stubbed goes first; what a soft cycle leaves follows in phase order.
    """
    place = {c["key"]: i for i, c in enumerate(changes) if not c.get("destructive")}
    waits: dict[int, set[int]] = {i: set() for i in range(len(changes))}
    frees = defaultdict(set)
    hard = defaultdict(set)
    for src, dst, kind in edges:
        if kind != "runtime" and src in place and dst in place and src != dst:
            waits[place[src]].add(place[dst])
            frees[place[dst]].add(place[src])
            if kind == "hard":
                hard[src].add(dst)
    order, done = [], set()

    def emit(i: int) -> None:
        done.add(i)
        order.append(changes[i]["id"])
        for j in frees[i]:
            waits[j].discard(i)
            if not waits[j] and j not in done:
                heapq.heappush(ready, (changes[j]["phase"], j))

    ready = [(c["phase"], i) for i, c in enumerate(changes) if not waits[i]]
    heapq.heapify(ready)
    while len(done) < len(changes):
        while ready:
            _, i = heapq.heappop(ready)
            if i not in done:
                emit(i)
        left = [i for i in range(len(changes)) if i not in done]
        if not left:
            break
        keys = {changes[i]["key"]: i for i in left}
        stubs = sorted(k for k, i in keys.items() if changes[i].get("stub") and _on_cycle(k, hard, keys))
        i = keys[stubs[0]] if stubs else min(left, key=lambda i: (changes[i]["phase"], i))
        waits[i].clear()
        emit(i)
    return order


def _on_cycle(key: str, out: Mapping[str, set], inside: Mapping) -> bool:
    stack, seen = [k for k in out[key] if k in inside], set()
    while stack:
        k = stack.pop()
        if k == key:
            return True
        if k not in seen:
            seen.add(k)
            stack.extend(x for x in out[k] if x in inside)
    return False


def stale(now: DataFrame, before: DataFrame, edges_now: DataFrame, edges_before: DataFrame) -> DataFrame:
    """Incremental analysis over (key, hash): ``key`` and ``state`` dirty or reused.

    New and changed keys, whatever depends on them now, and whatever depended on a
    removed key before are dirty.
    """
    joined = now.select("key", "hash").join(before.select(F.col("key").alias("old_key"), F.col("hash").alias("old")), F.col("key") == F.col("old_key"), "full")
    seeds = joined.filter("key is not null and (old_key is null or not (hash <=> old))").select(F.col("key").alias("node"))
    removed = joined.filter("key is null").select(F.col("old_key").alias("node"))
    dirty = seeds.unionByName(dependents_of(edges_now, seeds)).unionByName(dependents_of(edges_before, removed)).distinct()
    return now.select("key").join(dirty.select(F.col("node").alias("key"), F.lit("dirty").alias("state")), "key", "left").select("key", F.coalesce("state", F.lit("reused")).alias("state"))


def duplicates(definitions: DataFrame) -> DataFrame:
    """Definitions (name, file, ordinal) whose name came before, with the first one."""
    w = Window.partitionBy(F.lower("name")).orderBy("ordinal")
    ranked = definitions.withColumns({"nth": F.row_number().over(w), "first_file": F.first("file").over(w)})
    return ranked.filter("nth > 1").select("name", "file", "first_file")
