import numpy as np
import pytest

from quillon.llm import embedding_dedup as E


def brute(rows, threshold=0.98):
    """Links by double-precision cosines of all pairs of usable rows."""
    n = len(rows)
    usable = [r[0] is not None and r[1] is not None and r[2] is not None and len(r[2]) and None not in r[2] and bool(np.isfinite(np.array(r[2], np.float32)).all() and np.any(np.array(r[2], np.float32))) for r in rows]
    x = [np.array(r[2], np.float32).astype(np.float64) if u else None for r, u in zip(rows, usable, strict=True)]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][1] == rows[j][1] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), links[i], low.get(find(i)), rows[i][0] is None or rows[i][0] == low[find(i)]) for i in range(n))


@pytest.mark.parametrize("shape", [(300, 280, 64), (50, 700, 8), (5, 5, 2)])
def test_tile_links_equal_double_precision(shape):
    n, m, d = shape
    rng = np.random.default_rng(n)
    x, y = rng.standard_normal((n, d)).astype(np.float32), rng.standard_normal((m, d)).astype(np.float32)
    k = min(n, m) // 2
    y[:k] = x[:k] * 3 + rng.standard_normal((k, d)).astype(np.float32) * rng.uniform(0, 0.8, (k, 1)).astype(np.float32)
    u, v = E.unit(x), E.unit(y)
    cosines = u @ v.T
    a, b = E.quantise(u), E.quantise(v)
    estimate, off = E.bounds(a, b)
    assert a[0].dtype == np.int8 and (np.abs(cosines - estimate) <= off).all()
    found, doubt = E.settle(a, b, 0.98, False)
    assert not (found & (cosines < 0.98)).any() and ((cosines >= 0.98) <= (found | doubt)).all() and (cosines >= 0.98).any()
    i, j = np.nonzero(doubt)
    found[i, j] = E.cosines(u[i], v[j]) >= 0.98
    assert (found == (cosines >= 0.98)).all()


def test_pair_has_the_same_cosine_in_any_tile():
    rng = np.random.default_rng(3)
    u = E.unit(rng.standard_normal((40, 37)))
    whole = E.cosines(u, u[::-1])
    assert all(E.cosines(u[i : i + 1], u[::-1][i : i + 1])[0] == whole[i] for i in range(40))


def test_labels_of_text_and_doubles_link(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], (rng.standard_normal(6) * 1e-200 + (1e-200 if i % 4 < 2 else 9e-200)).tolist()) for i in range(60)]
    found = {r.vec_id: r for r in E.link(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"), tile=8).collect()}
    x = E.unit(np.array([r[2] for r in rows]))
    same = np.array([[a[1] == b[1] for b in rows] for a in rows])
    links = (x @ x.T >= 0.98) & same
    assert [found[i].n_links for i in range(60)] == (links.sum(1) - 1).tolist() and links.sum() > 60


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(i, i % 3, (base[i % 40] + rng.normal(0, 0.07, 16)).astype(np.float32).tolist()) for i in range(230)]
    rows += [(1000 + i, 1, [1.0, 2.0] + [0.0] * 14) for i in range(9)] + [(2000, 1, [2.0, 4.0] + [-0.0] * 14), (2001, 1, [1.0, 2.0])]
    rows += [(3000, 1, None), (3001, 1, []), (3002, 1, [0.0] * 16), (3003, None, [1.0] * 16), (3004, 1, [float("nan")] * 16), (3005, 1, [1.0, None]), (3006, 1, [float("inf")] * 16), (None, 2, [1.0] * 16)]
    rows += rows[:4]
    docs = spark.createDataFrame([(*r, r[0]) for r in rows], "vec_id long, label int, embedding array<float>, component_id long").repartition(5)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.link(docs, tile=16).collect())
    assert got == brute(rows)
    assert E.link(docs.limit(0)).count() == 0
