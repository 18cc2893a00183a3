import random

import numpy as np
import pytest

from quillon.llm import minhash_dedup as M
from quillon.llm import shingles as S


def sets_of(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, percent=85):
    """(id, set size, component, kept) of all rows by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in inverted[x] if j < i}:
            common = len(s & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted((str(k), len(sets[i]), low.get(find(i)), k is None or k == low[find(i)]) for i, (k, _) in enumerate(rows))


def test_hashes_follow_the_words():
    rng = random.Random(2)
    texts = ["", " \t\n", "A b", "a  B", "éa\x0bb c d e F", "x" * 400] + [" ".join(rng.choice(["a", "B", "cc", "é", "d\tE"]) for _ in range(rng.randrange(14))) for _ in range(300)]
    seen, sequences = {}, {}
    for step in (1, 1 << 21):
        for at, hashes, counts in S.word_hashes([t.encode() for t in texts], step):
            assert counts.tolist() == [len(t.encode().split()) for t in texts[at : at + len(counts)]]
            sets, n = S.distinct(*S.shingle_hashes(hashes, counts))
            for t, part, whole in zip(texts[at:], np.split(sets, np.cumsum(n)[:-1]), S.sequence_hashes(hashes, counts), strict=False):
                key = frozenset(sets_of(t))
                assert seen.setdefault(key, part.tolist()) == part.tolist() and len(part) == len(key)
                key = tuple(t.encode().lower().split())
                assert sequences.setdefault(key, whole.tolist()) == whole.tolist()
    assert len({tuple(x) for x in seen.values()}) == len(seen) and len({tuple(x) for x in sequences.values()}) == len(sequences)


def corpus(seed, groups=12, alike=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(alike):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words += passage
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.1 else "  ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (None, None), (1003, "two words"), (1004, "Two\tWORDS"), (2000, "long " * 30_000), (2001, "long " * 40_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("longest,documents", [(4096, 2048), (6, 5)])
def test_components_equal_brute_force(spark, longest, documents):
    rows = corpus(longest)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, cluster int").repartition(5)
    got = M.link(docs, longest=longest, tile_documents=documents).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


@pytest.mark.parametrize("percent", [30, 60, 95])
def test_other_thresholds_equal_brute_force(spark, percent):
    rows = corpus(percent, 8, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = M.link(docs, percent=percent, longest=10, tile_documents=7).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, percent)


def test_matches_follow_the_threshold():
    assert M.matches_of(85) == 38 and M.matches_of(100) == M.COORDINATES and M.matches_of(30) > 0
    with pytest.raises(ValueError):
        M.matches_of(10)


def test_recall_at_the_threshold():
    """Pairs of sets of exactly 85 percent: all of 20,000 agree in as many coordinates as are asked for."""
    rng = np.random.default_rng(8)
    pairs, common, apart = 20_000, 17, 3
    values = rng.integers(0, 1 << 63, (pairs, common + apart), dtype=np.uint64)
    first = M.signatures(np.sort(values[:, : common + 1], 1).ravel(), np.full(pairs, common + 1))
    second = M.signatures(np.sort(np.delete(values, common, 1), 1).ravel(), np.full(pairs, common + apart - 1))
    agree = (first == second).sum(1)
    assert abs(agree.mean() / M.COORDINATES - 0.85) < 0.01 and (agree >= M.matches_of(85)).all()


def test_large_clusters_need_no_pairs_of_all_tiles(spark):
    """What isn't of the commonest label meets all others, the commonest never itself."""
    rows = [(7, i, 0 if i < 50 else i, 1) for i in range(53)] + [(8, 100 + i, 1, 1) for i in range(20)]
    tiles = lambda n, _: M.F.ceil(n / M.F.lit(10))
    met = M.rest_pairs(spark.createDataFrame(rows, "key long, node long, label long, weight long"), "key", tiles).collect()
    pairs = {}
    for r in met:
        pairs.setdefault((r.key, r.tile_a, r.tile_b), {0: [], 1: []})[int(r.tile != r.tile_a)].append(r)
    assert {k[0] for k in pairs} == {7} and len(met) == 50 + 3 * 6
    meet = {frozenset((a.node, b.node)) for (_, x, y), p in pairs.items() for a in p[0] for b in (p[0] if x == y else p[1]) if a.label != b.label}
    assert meet == {frozenset((i, j)) for i in range(50, 53) for j in range(53) if i != j}


def test_empty_table_and_keeping_one(spark):
    rows = corpus(3, 4, 6)[: 4 * 6]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, gone_id string")
    assert M.link(docs.limit(0)).count() == 0
    kept = M.keep_one(docs, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(int(k) for k, _, _, keep in brute(rows) if keep)


def test_query_equals_brute_force(spark, sf_dir):
    from quillon.llm.queries import op10_minhash_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op10_minhash_dedup(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)
