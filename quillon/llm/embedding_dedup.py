"""Near-duplicate vectors by products of int8 tiles with rigorous error bounds.

Method: equal vectors of a label become one with a count. Unit vectors are
quantised to int8, each with its own scale and the exact norm of what the
rounding left; the codes are stored once. Vectors are sorted along a
space-filling curve and cut into tiles of one label; a tile pair whose boxes of
projections lie further apart than any link can reach is skipped. Of the others
only the int8 tiles meet. Their product and the norms of the remainders bound
every cosine from both sides: a pair whose upper bound stays below the threshold
is no link, one whose lower bound reaches it is a link, and the pairs between
are computed again in double precision from the full vectors, of which only the
rows in such pairs are sent. A pair's cosine is one sum along the vector, the
same in whichever tiles it lies. A tile pair passes on link counts and a
spanning forest of its links, never the pairs, so a dense group costs no more
than its rows.

Tile pairs of one label are quadratic in its tiles where the boxes, over
``BOX`` fixed directions, don't keep them apart.

Cases. Labels of any type are compared as text, components in their own
precision. Vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing and are kept.
Vectors of different lengths don't link. Repeated rows are vectors of their own
and link with each other. An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import map_arrow, save
from quillon.llm.components import components, forest
from quillon.llm.packing import hilbert

#: Directions for the curve and for the boxes, and bits of the curve's grid.
TILE, AXES, BOX, GRID_BITS = 1024, 3, 16, 12
#: Room for rounding in the bounds, far above double precision's error and far below int8's.
SLACK = 1e-6
CODES = "block long, label string, dim int, ids binary, counts binary, codes binary, scales binary, rests binary, box array<double>"
FOUND = "a long, b long, links long, doubt binary"
#: Pairs computed again at once.
AGAIN = 1 << 14


def axes(dim: int, seed: int = 11) -> np.ndarray:
    """Fixed orthonormal directions, the first of them for ordering, all for the boxes."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(BOX, dim))))
    return q


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and the norms of what is left."""
    scale = np.abs(u).max(1, keepdims=True) / 127
    q = np.rint(u / scale)
    rest = u - q * scale
    return q.astype(np.int8), scale[:, 0], np.sqrt((rest * rest).sum(1))


def bounds(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The int8 estimate of every cosine of two tiles of (codes, scales, rests), and how far off it can be."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products without rounding
    estimate = (qa.astype(exact) @ qb.astype(exact).T).astype(np.float64)
    estimate *= sa[:, None]
    estimate *= sb[None, :]
    return estimate, ra[:, None] * (1 + rb)[None, :] + rb[None, :] * (1 + ra)[:, None] + ra[:, None] * rb[None, :] + SLACK


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows of unit vectors, each one sum along its row."""
    return (x * y).sum(1)


def _valid(vector):
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _encode(kind: np.dtype):
    """Vectors as bytes, with minus zero as zero, their length and curve key."""

    def rows(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
            ends = np.cumsum(sizes)
            raw = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            keys = np.zeros(len(raw), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = np.stack([flat[ends[i] - dim : ends[i]] for i in at])
                p = unit(x) @ axes(int(dim))[:, :AXES]
                grid = np.clip((p * 2 + 1) / 2, 0, 1) * ((1 << GRID_BITS) - 1)
                keys[at] = hilbert(grid.astype(np.int64), GRID_BITS)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "dim", "curve"])

    return rows


def _tiles(tile: int, kind: np.dtype):
    """Runs of up to ``tile`` rows of one label and length, each as one row; equal keys need no care."""
    names = [f.split()[0] for f in CODES.split(", ")] + ["low", "vectors"]

    def cut(batches):
        block = TaskContext.get().partitionId() << 32

        def out(label, dim, rows):
            nonlocal block
            x = np.frombuffer(b"".join(r[2] for r in rows), kind).reshape(len(rows), dim)
            u = unit(x)
            p = u @ axes(dim)
            q, scale, rest = quantise(u)
            ids = block * tile + np.arange(len(rows), dtype=np.int64)
            of = lambda k: np.array([r[k] for r in rows], np.int64).tobytes()
            made = [block, label, dim, ids.tobytes(), of(1), q.tobytes(), scale.tobytes(), rest.tobytes(), [*p.min(0).tolist(), *p.max(0).tolist()], of(0), x.tobytes()]
            block += 1
            kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.float64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], names)

        held, now = [], None
        for batch in batches:
            for label, dim, low, n, x in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "low", "n", "vector")), strict=True):
                if held and ((label, dim) != now or len(held) == tile):
                    yield out(*now, held)
                    held = []
                now = (label, dim)
                held.append((low, n, x))
        if held:
            yield out(*now, held)

    return cut


def near_tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles (block <= other) of one label and length whose boxes may hold a link."""
    # Unit vectors with a cosine of t lie sqrt(2 - 2t) apart, and so do their projections at most.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    half = (F.size("box") / 2).cast("int")
    cell = lambda v: F.floor(v / F.lit(max(reach, 0.05))).cast("int")
    cells = F.explode(F.sequence(cell(F.col("least")[0]), cell(F.col("most")[0] + F.lit(reach))))
    left = blocks.select("block", "label", "dim", F.slice("box", F.lit(1), half).alias("least"), F.slice("box", half + 1, half).alias("most")).withColumn("cell", cells)
    right = left.select(F.col("block").alias("other"), F.col("label").alias("label2"), F.col("dim").alias("dim2"), F.col("least").alias("least2"), F.col("most").alias("most2"), F.col("cell").alias("cell2"))
    gap = lambda z: F.greatest(z["least"] - z["most2"], z["least2"] - z["most"], F.lit(0.0))
    apart = F.aggregate(F.arrays_zip("least", "most", "least2", "most2"), F.lit(0.0), lambda total, z: total + gap(z) * gap(z))
    pairs = left.join(right, (F.col("label") == F.col("label2")) & (F.col("dim") == F.col("dim2")) & (F.col("cell") == F.col("cell2")) & (F.col("block") <= F.col("other")))
    return pairs.filter(apart <= F.lit(reach * reach)).select("block", "other").distinct()


def _sides(batches, names: list[str]):
    """Rows (one, other, side, ...) sorted by the first three as pairs of sides; a tile with itself comes once."""
    first = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            r = dict(zip(names, row, strict=True))
            if r["one"] == r["other"]:
                yield r, r
            elif r["side"] == 0:
                first = r
            else:
                yield first, r


def _links(found: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], same: bool, doubt: bytes | None) -> pa.RecordBatch:
    """Rows of link counts (a, links), forest edges (a, b) and pairs in doubt."""
    n = np.concatenate([found @ counts[1], [] if same else found.T @ counts[0]]).astype(np.int64)
    who = ids[0] if same else np.concatenate(ids)
    some = n > 0
    i, j = np.nonzero(found)
    a, b = ids[0][i], ids[1][j]
    a, b = forest(np.minimum(a, b), np.maximum(a, b)) if len(i) else (a, b)
    columns = [who[some].tolist() + a.tolist(), [None] * int(some.sum()) + b.tolist(), n[some].tolist() + [None] * len(a), [None] * (int(some.sum()) + len(a))]
    if doubt is not None:
        for c, v in zip(columns, (None, None, None, doubt), strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["a", "b", "links", "doubt"])


def settle(a: tuple, b: tuple, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the int8 tiles prove to be links, and which pairs they leave in doubt."""
    estimate, off = bounds(a, b)
    found = estimate - off >= threshold
    doubt = (estimate + off >= threshold) & ~found
    if same:
        np.fill_diagonal(found, False)
        doubt = np.triu(doubt, 1)
    return found, doubt


def link(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row of vec_id, label, embedding."""
    double = isinstance(vectors.schema["embedding"].dataType.elementType, (T.DoubleType, T.DecimalType, T.LongType, T.IntegerType))
    kind = np.dtype(np.float64 if double else np.float32)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    usable = _valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    coded = save(map_arrow(rows.filter(usable), _encode(kind), "vec_id long, label string, vector binary, dim int, curve long"))
    different = coded.groupBy("label", "dim", "curve", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    laid = different.repartitionByRange("label", "dim", "curve", "low").sortWithinPartitions("label", "dim", "curve", "low", "vector")
    blocks = save(map_arrow(laid, _tiles(tile, kind), f"{CODES}, low binary, vectors binary"))
    pairs = near_tiles(blocks, threshold)

    # Every tile goes once to each of its pairs, as int8 codes.
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("of")), F.struct(F.lit(1).alias("side"), F.col("other").alias("of")))
    ends = pairs.select(F.col("block").alias("one"), "other", F.explode(F.when(F.col("block") == F.col("other"), F.slice(ends, 1, 1)).otherwise(ends)).alias("end")).select("one", "other", "end.side", "end.of")
    light = ["dim", "ids", "counts", "codes", "scales", "rests"]
    work = ends.join(blocks.select("block", *light), F.col("of") == F.col("block")).select("one", "other", "side", *light)
    work = work.repartition("one", "other").sortWithinPartitions("one", "other", "side")

    def products(batches):
        for sides in _sides(batches, ["one", "other", "side", *light]):
            same = sides[0] is sides[1]
            ids, counts = ([np.frombuffer(r[c], np.int64) for r in sides] for c in ("ids", "counts"))
            a, b = ((np.frombuffer(r["codes"], np.int8).reshape(-1, r["dim"]), np.frombuffer(r["scales"]), np.frombuffer(r["rests"])) for r in sides)
            found, doubt = settle(a, b, threshold, same)
            i, j = np.nonzero(doubt)
            if len(i) or found.any():
                # The pairs in doubt: both tiles, and each pair's places as one number.
                where = np.concatenate([[sides[0]["one"], sides[0]["other"]], i * np.int64(tile) + j]).astype(np.int64).tobytes() if len(i) else None
                yield _links(found, ids, counts, same, where)

    found = save(map_arrow(work, products, FOUND))

    # Full vectors of the rows in doubt, and of no others.
    def doubted(batches):
        for batch in batches:
            for raw in batch.column("doubt").to_pylist():
                where = np.frombuffer(raw, np.int64)
                one, other, at = int(where[0]), int(where[1]), where[2:]
                same = one == other
                rows = [np.unique(at // tile), np.unique(at % tile)]
                rows = [np.union1d(*rows)] if same else rows
                for side, (of, some) in enumerate(zip((one, other), rows, strict=False)):
                    yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([other]), pa.array([side], pa.int32()), pa.array([of]), pa.array([some.tobytes()], pa.binary()), pa.array([at.tobytes() if side == 0 else None], pa.binary())], ["one", "other", "side", "of", "some", "at"])

    asked = map_arrow(found.filter("doubt is not null").select("doubt"), doubted, "one long, other long, side int, of long, some binary, at binary")
    full = asked.join(blocks.select("block", "dim", "ids", "counts", "vectors"), F.col("of") == F.col("block")).drop("of", "block")

    def pick(batches):
        for batch in batches:
            for r in batch.to_pylist():
                some = np.frombuffer(r["some"], np.int64)
                ids, counts = (np.frombuffer(r[c], np.int64)[some].tobytes() for c in ("ids", "counts"))
                x = np.frombuffer(r["vectors"], kind).reshape(-1, r["dim"])[some].tobytes()
                made = [r["one"], r["other"], r["side"], r["dim"], r["some"], r["at"], ids, counts, x]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], heavy)

    heavy = ["one", "other", "side", "dim", "some", "at", "ids", "counts", "vectors"]
    picked = map_arrow(full, pick, "one long, other long, side int, dim int, some binary, at binary, ids binary, counts binary, vectors binary")
    picked = picked.repartition("one", "other").sortWithinPartitions("one", "other", "side")

    def exact(batches):
        for sides in _sides(batches, heavy):
            same = sides[0] is sides[1]
            some, ids, counts = ([np.frombuffer(r[c], np.int64) for r in sides] for c in ("some", "ids", "counts"))
            x, y = (unit(np.frombuffer(r["vectors"], kind).reshape(-1, r["dim"])) for r in sides)
            at = np.frombuffer(sides[0]["at"], np.int64)
            i, j = np.searchsorted(some[0], at // tile), np.searchsorted(some[1], at % tile)
            linked = np.zeros((len(x), len(y)), bool)
            for k in range(0, len(i), AGAIN):
                p, q = i[k : k + AGAIN], j[k : k + AGAIN]
                linked[p, q] = cosines(x[p], y[q]) >= threshold
            if same:
                linked |= linked.T
            if linked.any():
                yield _links(linked, ids, counts, same, None)

    sure = found.filter("doubt is null").select("a", "b", "links")
    found = save(sure.unionByName(map_arrow(picked, exact, FOUND).select("a", "b", "links")))
    groups = components(found.filter("b is not null").select("a", "b"))
    linked = found.filter("links is not null").select(F.col("a").alias("node"), "links", F.lit(None).cast("long").alias("component"))
    known = linked.unionByName(groups.select("node", F.lit(None).cast("long").alias("links"), "component")).groupBy("node").agg(F.sum("links").alias("links"), F.max("component").alias("component"))

    def nodes(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, width = len(r["ids"]) // 8, kind.itemsize * r["dim"]
                columns = [np.frombuffer(r[c], np.int64) for c in ("ids", "low", "counts")]
                raw = [r["vectors"][i * width : (i + 1) * width] for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([r["label"]] * n, pa.string()), pa.array(raw, pa.binary())], ["node", "low", "n", "label", "vector"])

    every = map_arrow(blocks.select("ids", "low", "counts", "label", "dim", "vectors"), nodes, "node long, low long, n long, label string, vector binary")
    every = every.join(known, "node", "left")
    every = save(every.select("low", "label", "vector", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    names = save(every.groupBy("component").agg(F.min("low").alias("component_id")))
    every = every.join(names, "component").select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "n_links", "component_id")
    members = coded.join(every, (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")))
    members = members.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return members.unionByName(alone)
