"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

Method: a signature holds the minima of ``COORDINATES`` hash functions over a
document's word shingles. Documents are posted under their coordinate-value
pairs. Two documents with the asked similarity agree in at least ``matches``
coordinates (all but ``MISSED`` of the pairs at the threshold itself), so

* a pair that no other document has is never posted, and a document with fewer
  than ``matches`` shared pairs has no partner (skipping);
* with pairs ordered from rare to common, two partners share one of the first
  ``COORDINATES - matches + 1`` (prefix); only those are posted, so lists of
  pairs that very many documents share are left out where rarer ones suffice.

A posting list is merged by counting agreeing coordinates: from one document
after another, what agrees in enough of them joins its cluster and isn't looked
at again, so a list of near copies costs about its length. A list longer than
``LIST`` is split into tiles by a hash of document and pair, each merged by
itself; as a document's neighbours differ from list to list, near copies come
together without any two tiles meeting. Only for lists that still hold more than
one cluster, whatever isn't of a list's largest cluster is compared with all
that the list holds of other clusters, tile by tile. Clusters of candidates, not
pairs, are what a list passes on.

Inside a cluster links are confirmed on full shingle sets by exact counts of
common shingles. Large clusters are split in the same way: two independent
tilings first, then the rest against documents of other components. Documents
with the same words in the same order are one from the start and are never
expanded into pairs. No list, cluster or link is capped or sampled.

Cases. Null, empty and blank texts have no shingles, link with nothing and are
kept; fewer words than a shingle's are one shingle. A percentage so low that
signatures can't find its pairs (below 22) is refused. Repeated rows link with each
other through their equal ids. A null id links with nothing and is kept. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, save
from quillon.llm.components import EDGE, components, contracted, forest
from quillon.llm.shingles import distinct, mix, sequence_hashes, shingle_hashes, word_hashes

#: Coordinates of a signature, and how many pairs at the threshold may agree in fewer than are asked for.
COORDINATES, MISSED = 64, 2e-7
LIST, TILE_DOCUMENTS, TILE_SHINGLES = 512, 128, 50_000
#: Rows of each of two tiles of a list that are compared because several clusters are left: a part of ``LIST``.
CROSS = 4
_A, _B = (np.random.default_rng(77).integers(0, 1 << 63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
SIGNED = "doc_id long, n_shingles long, sequence binary, tokens array<long>"


def matches_of(percent: int, missed: float = MISSED) -> int:
    """How many coordinates a pair of that similarity agrees in, but for ``missed`` of such pairs."""
    p, total = percent / 100, 0.0
    for m in range(COORDINATES + 1):
        total += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if total > missed:
            break
    if not m:
        raise ValueError(f"{COORDINATES} coordinates can't find pairs of {percent} percent")
    return m


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(text, coordinate): the pair of coordinate and minimum as one number; every text has shingles."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), COORDINATES), np.int64)
    for k in range(COORDINATES):
        low = np.minimum.reduceat(shingles * _A[k] + _B[k], starts) >> np.uint64(32)
        out[:, k] = low.astype(np.int64) | k << 32
    return out


def sign(docs: DataFrame, size: int) -> DataFrame:
    """Set size, hash of the word sequence and signature of each text."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            for at, hashes, counts in word_hashes(raw):
                whole = sequence_hashes(hashes, counts)
                sets, n = distinct(*shingle_hashes(hashes, counts, size))
                some = n > 0
                tokens = signatures(sets, n[some]) if some.any() else np.empty((0, COORDINATES), np.int64)
                offsets = np.concatenate([[0], np.cumsum(some) * COORDINATES]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in whole], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.ravel()))], ["doc_id", "n_shingles", "sequence", "tokens"])

    return map_arrow(docs.select("doc_id", "text"), rows, SIGNED)


def groups(batches, keys: tuple[str, ...]):
    """Runs of rows with equal keys from batches sorted by them, as (key, table)."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = np.concatenate([[0], change])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield tuple(int(c[a]) for c in columns), table.slice(a, b - a)
        held = table.slice(int(edges[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield tuple(int(table.column(k)[0].as_py()) for k in keys), table


def agreeing(sketches: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) that join whatever agrees in ``least`` coordinates, by merging with skips."""
    a, b = [], []
    left = np.arange(len(sketches))
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        if not len(left):
            break
        near = (sketches[left] == sketches[at]).sum(1) >= least
        if near.any():
            found = left[near]
            left = left[~near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def across(sketches: np.ndarray, label: np.ndarray, first: int | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between different labels: of one of the first so many with one of the rest, or of any two."""
    label, a, b = label.copy(), [], []
    low = first or 0
    for i in range(len(sketches) if first is None else first):
        j = low + np.flatnonzero(label[low:] != label[i])
        j = j[(sketches[j] == sketches[i]).sum(1) >= least]
        if len(j):
            a.append(np.full(len(j), i))
            b.append(j)
            label[np.isin(label, label[j])] = label[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _edges(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch | None:
    """The ends of edges as one batch of stars."""
    x, y = np.concatenate(x), np.concatenate(y)
    x, y = np.minimum(x, y), np.maximum(x, y)
    keep = x < y
    if not keep.any():
        return None
    x, y = forest(x[keep], y[keep])
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def candidate_edges(postings: DataFrame, least: int) -> DataFrame:
    """Edges of candidate clusters inside the tiles of posting lists, from rows (token, tile, node, sketch) sorted by both."""

    def rows(batches):
        for table in _whole(batches, ("token", "tile")):
            token, node, sketch = np.stack([table.column(k).to_numpy() for k in ("token", "tile")], 1), table.column("node").to_numpy(), _sketches(table)
            n = len(node)
            # Short lists all at once: every document with those a few places on.
            same = np.flatnonzero(np.r_[True, np.any(token[1:] != token[:-1], axis=1)])
            sizes = np.diff(np.append(same, n))
            where = np.repeat(sizes, sizes)
            a, b = [], []
            for step in range(1, 8):
                i = np.flatnonzero((where[:-step] <= 8) & (token[:-step] == token[step:]).all(1)) if n > step else np.empty(0, np.int64)
                i = i[(sketch[i] == sketch[i + step]).sum(1) >= least]
                a.append(node[i])
                b.append(node[i + step])
            for at, size in zip(same[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                i, j = agreeing(sketch[at : at + size], least)
                a.append(node[at + i])
                b.append(node[at + j])
            if (found := _edges(a, b)) is not None:
                yield found

    return map_arrow(postings, contracted(rows), EDGE)


def cross_edges(pairs: DataFrame, least: int) -> DataFrame:
    """Edges between clusters from the pairs of tiles that ``rest_pairs`` made of posting lists."""

    def rows(batches):
        for (_, tile_a, tile_b), table in groups(batches, ("token", "tile_a", "tile_b")):
            tile = table.column("tile").to_numpy()
            order = np.argsort(tile, kind="stable")
            node, label = (table.column(k).to_numpy()[order] for k in ("node", "label"))
            i, j = across(_sketches(table)[order], label, None if tile_a == tile_b else int((tile == tile_a).sum()), least)
            if len(i) and (found := _edges([node[i]], [node[j]])) is not None:
                yield found

    return map_arrow(pairs, contracted(rows), EDGE)


def _whole(batches, keys: tuple[str, ...]):
    """Tables cut so that no run of equal keys is in two of them."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def exact_links(sets: list[np.ndarray], percent: int, first: int | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of links with 100 * common >= percent * union, enough to join their components.

    ``sets`` are sorted and without repeats. With ``first`` only pairs of one of
    the first so many with one of the rest count. Sets with the same label are
    joined already.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    lists, bounds = owner[order], np.append(0, np.cumsum(np.bincount(ids, minlength=len(values))))
    begins = np.append(0, np.cumsum(sizes))
    label = np.arange(n) if label is None else label.copy()
    a, b = [], []
    if first is not None:  # only the lists of the second tile are counted
        keep = lists >= first
        kept = np.append(0, np.cumsum(keep))
        lists, bounds = lists[keep], kept[bounds]
    for i in range(n if first is None else first):
        if first is None and (label == label[0]).all():
            break
        mine = ids[begins[i] : begins[i + 1]]
        lo, hi = bounds[mine], bounds[mine + 1]
        spans = hi - lo
        total = int(spans.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(spans) - spans), spans) + np.arange(total)
        common = np.bincount(lists[at], minlength=n)
        j = np.flatnonzero((100 + percent) * common >= percent * (sizes[i] + sizes))
        j = j[(label[j] != label[i]) & (common[j] > 0)]
        if len(j):
            a.append(np.full(len(j), i))
            b.append(j)
            label[np.isin(label, label[j])] = label[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def confirm(tiles: DataFrame, percent: int) -> DataFrame:
    """Confirmed edges from rows (cluster, tile_a, tile_b, tile, node, label, shingles) sorted by the first three."""

    def rows(batches):
        for (_, tile_a, tile_b), table in groups(batches, ("cluster", "tile_a", "tile_b")):
            tile, node, label = (table.column(k).to_numpy() for k in ("tile", "node", "label"))
            order = np.lexsort((node, tile))
            raw = table.column("shingles").to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in order]
            i, j = exact_links(sets, percent, None if tile_a == tile_b else int((tile == tile_a).sum()), label[order])
            if len(i) and (found := _edges([node[order][i]], [node[order][j]])) is not None:
                yield found

    return map_arrow(tiles, contracted(rows), EDGE)


def rest_pairs(rows: DataFrame, key: str, tiles) -> DataFrame:
    """The rows of keys with several labels, once for each pair of tiles in which two labels may meet.

    What isn't of a key's commonest label goes into tiles numbered from 0, the
    rest into tiles after those. A pair tile_a <= tile_b always has one of the
    former as tile_a, so rows of the commonest label never meet each other.
    ``tiles`` gives the number of tiles for a count of rows and their ``weight``.
    """
    counts = rows.groupBy(F.col(key).alias("of"), "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    tops = counts.groupBy("of").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter(F.col("n") > F.col("top.n"))
    tops = save(tops.select("of", F.col("top.label").alias("most"), tiles(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("minor"), tiles(F.col("top.n"), F.col("top.w")).alias("major")))
    met = rows.join(tops, F.col(key) == F.col("of"))
    common = F.col("label") == F.col("most")
    draw = F.xxhash64("node", key)
    met = met.withColumn("tile", F.when(common, F.col("minor") + F.pmod(draw, F.col("major"))).otherwise(F.pmod(draw, F.col("minor"))).cast("int"))
    last = F.when(common, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return met.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}).drop("of", "most", "minor", "major", "other")


def labelled(rows: DataFrame, groups_: DataFrame, name: str = "label") -> DataFrame:
    """The rows with the component of their node, or the node itself, as ``name``."""
    known = groups_.select(F.col("node").alias("known"), F.col("component").alias("found"))
    return rows.join(known, F.col("node") == F.col("known"), "left").withColumn(name, F.coalesce("found", "node")).drop("known", "found")


def link(docs: DataFrame, percent: int = 85, size: int = 5, least: int | None = None, longest: int = LIST, tile_documents: int = TILE_DOCUMENTS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of doc_id and text."""
    least = least or matches_of(percent)
    signed = save(sign(docs, size))
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    alone = signed.filter(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    signed = signed.filter(usable)
    one = signed.groupBy("sequence").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    one = save(one.withColumn("node", F.monotonically_increasing_id()))

    # Posting lists: shared pairs only, from rare to common, the prefix of each document.
    tokens = one.select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy(F.col("token").alias("shared_token")).agg(F.count("*").alias("n")).filter("n > 1")
    held = tokens.join(shared, F.col("token") == F.col("shared_token")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("pairs"))
    held = held.filter(F.size("pairs") >= least)
    prefix = COORDINATES - least + 1

    def post(batches):
        for batch in batches:
            lists, node = batch.column("pairs"), batch.column("node").to_numpy()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = lists.flatten()
            n, token = pairs.field("n").to_numpy(zero_copy_only=False), pairs.field("token").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(node)), sizes)
            # A coordinate that nobody shares gets a value of its node's own.
            own = mix(node.astype(np.uint64)[:, None] * np.uint64(COORDINATES) + np.arange(COORDINATES, dtype=np.uint64))
            sketch = (own & np.uint64(255)).astype(np.uint8)
            sketch[owner, token >> 32] = (token & 255).astype(np.uint8)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = inside < (prefix - COORDINATES + sizes)[owner]
            sketches = pa.array([x.tobytes() for x in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(token[keep], pa.int64()), pa.array(n[keep], pa.int64()), pa.array(node[owner[keep]], pa.int64()), sketches.take(pa.array(owner[keep]))], ["token", "n", "node", "sketch"])

    postings = map_arrow(held, post, "token long, n long, node long, sketch binary")
    tile = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("n") / F.lit(longest))).cast("int")
    postings = save(postings.withColumn("tile", tile))
    lists = postings.select("token", "tile", "node", "sketch").repartition("token", "tile").sortWithinPartitions("token", "tile")
    clusters = save(components(candidate_edges(lists, least), stars=True))
    some = labelled(postings.filter(F.col("n") > longest).select("token", "node", "sketch"), clusters).withColumn("weight", F.lit(1))
    pairs = rest_pairs(some, "token", lambda n, _: F.ceil(n * CROSS / F.lit(longest))).select("token", "tile_a", "tile_b", "tile", "node", "label", "sketch")
    pairs = pairs.repartition("token", "tile_a", "tile_b").sortWithinPartitions("token", "tile_a", "tile_b")
    more = save(cross_edges(pairs, least))
    if not more.isEmpty():
        clusters = save(components(more.unionByName(clusters.select(F.col("component").alias("a"), F.col("node").alias("b")))))
    clusters = clusters.withColumnRenamed("component", "cluster")

    # Exact links inside clusters; the shingles are made anew from whole texts, of one document for each sequence.
    members = one.select("node", "low", "n_shingles", "sequence").join(clusters, "node")
    extent = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    tiles = lambda n, w: F.greatest(F.ceil(n / F.lit(tile_documents)), F.ceil(w / F.lit(tile_shingles))).cast("int")
    members = members.join(save(extent.select("cluster", tiles(F.col("n"), F.col("shingles")).alias("tiles_of"))), "cluster")
    texts = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(members, "low")

    def reshingle(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            wanted = batch.column("sequence").to_pylist()
            for at, hashes, counts in word_hashes(raw):
                whole = sequence_hashes(hashes, counts)
                sets, n = distinct(*shingle_hashes(hashes, counts, size))
                pieces = [s.tobytes() for s in np.split(sets, np.cumsum(n)[:-1])]
                right = pa.array([x.tobytes() == y for x, y in zip(whole, wanted[at : at + len(n)], strict=True)])
                cut = [batch.column(c).slice(at, len(n)) for c in ("cluster", "node", "tiles_of")]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(pieces, pa.binary())], ["cluster", "node", "tiles_of", "shingles"]).filter(right)

    sets = map_arrow(texts.select("cluster", "node", "tiles_of", "sequence", "text"), reshingle, "cluster long, node long, tiles_of int, shingles binary")
    sets = save(sets)
    columns = ("cluster", "tile_a", "tile_b", "tile", "node", "label", "shingles")
    keys = ("cluster", "tile_a", "tile_b")
    # Two tilings of a large cluster, numbered apart; a document is in one tile of each.
    count, draw = F.col("tiles_of"), lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col("tiles_of")).cast("int")
    twice = sets.withColumn("label", F.col("node")).withColumn("tile", F.explode(F.when(count == 1, F.array(F.lit(0))).otherwise(F.array(draw(1), count + draw(2)))))
    twice = twice.withColumns({"tile_a": F.col("tile"), "tile_b": F.col("tile")}).select(*columns)
    linked = save(components(confirm(twice.repartition(*keys).sortWithinPartitions(*keys), percent), stars=True))
    large = labelled(sets.filter("tiles_of > 1"), linked).withColumn("weight", F.length("shingles") / 8)
    met = rest_pairs(large, "cluster", tiles).select(*columns)
    more = save(confirm(met.repartition(*keys).sortWithinPartitions(*keys), percent))
    if not more.isEmpty():
        linked = components(more.unionByName(linked.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    every = save(one.select("node", "low", "sequence").join(linked, "node", "left").select("low", "sequence", F.coalesce("component", "node").alias("component")))
    names = save(every.groupBy("component").agg(F.min("low").alias("component_id")))
    named = every.join(names, "component").select(F.col("sequence").alias("of"), "component_id")
    found = signed.select("doc_id", "n_shingles", "sequence").join(named, F.col("sequence") == F.col("of"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows, with all their columns, that stand for their group: the one with the smallest id.

    Ids are taken to be unique; where one id has several rows, all of them stay if one stands for its group.
    """
    gone = link(docs, percent, size).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select("gone_id")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
