from collections import Counter

import numpy as np
import pytest

from quillon.llm import masked_lm as L
from quillon.llm.shingles import word_hashes, word_runs


def brute(net, ids):
    """Log probability of every word by plain loops."""
    w, out = {k: x.astype(float) for k, x in net.weights.items()}, []
    for t, target in enumerate(ids):
        h = w["b"].copy()
        for p, step in enumerate(L.AROUND):
            h += w["e"][p][ids[t + step] if 0 <= t + step < len(ids) else L.VOCABULARY]
        h = np.tanh(h)
        y = w["cw"] @ h + w["cb"]
        z = w["ww"][target % L.CLASSES] @ h + w["wb"][target % L.CLASSES]
        out.append(y[target % L.CLASSES] - np.log(np.exp(y).sum()) + z[target // L.CLASSES] - np.log(np.exp(z).sum()))
    return out


def fresh():
    return L.Network.fresh(np.random.default_rng(0).integers(0, 50, L.VOCABULARY).astype(float))


def test_probabilities_sum_to_one_and_equal_brute_force():
    net, ids = fresh(), np.random.default_rng(1).integers(0, L.VOCABULARY, 37)
    around = L.contexts(ids, np.array([37]))
    assert np.allclose(net.log_probabilities(ids, around), brute(net, ids.tolist()), atol=1e-4)
    every = net.log_probabilities(np.arange(L.VOCABULARY), np.repeat(around[:1], L.VOCABULARY, 0))
    assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_agree_with_differences():
    net = fresh()
    net.weights = {k: x.astype(float) for k, x in net.weights.items()}
    rng = np.random.default_rng(2)
    ids = rng.integers(0, L.VOCABULARY, 20)
    around = L.contexts(ids, np.array([12, 8]))
    grad, _ = net.gradients(ids, around)
    for k, x in net.weights.items():
        big = np.argsort(-np.abs(grad[k]).ravel())[:4]
        for at in (np.unravel_index(i, x.shape) for i in big):
            was, e = x[at], 1e-5
            x[at] = was + e
            up = net.gradients(ids, around)[1]
            x[at] = was - e
            down = net.gradients(ids, around)[1]
            x[at] = was
            assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-4), k


def texts_of(docs):
    return {r.doc_id: (r.text or "").encode().lower().split() for r in docs.select("doc_id", "text").collect()}


def chain(model, word):
    """The log probability of a spelled word by plain loops."""
    step = model.step.reshape(256, 257)
    return model.first[word[0]] + sum(step[a, b] for a, b in zip(word, [*word[1:], 256], strict=True))


def rare_log(model, word, n):
    """The log probability of a word outside the vocabulary that occurs n times, among those of its number."""
    g = word[0] % L.GROUPS
    every, kinds = model.words.rare[g], model.words.kinds[g]
    return np.log(max(n - L.DISCOUNT, 0) / every + L.DISCOUNT * kinds / every * np.exp(chain(model, word))) if every else chain(model, word)


def test_vocabulary_counts_every_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = [w for t in texts_of(docs).values() for w in t]
    n = Counter(words)
    v, rare = L.vocabulary(docs, 6000)
    known = len(v.hashes)
    assert known == max(sum(k >= least for k in n.values()) for least in range(1, 99) if sum(k >= least for k in n.values()) <= 6000) > L.OWN
    assert v.counts.sum() == len(words) and (np.diff(v.hashes.astype(object)) > 0).all()
    hashes = {w: next(word_hashes([w]))[1][0] for w in n}
    common = sorted(n.values(), reverse=True)[: L.OWN]
    assert sorted(v.counts[: L.OWN].tolist(), reverse=True) == common
    ranked = sorted(n, key=lambda w: (-n[w], hashes[w].astype(np.int64)))
    rest = Counter()
    for w in ranked[L.OWN :]:
        rest[w[0] % L.GROUPS] += n[w]
    number, share, spelled = v.read(np.array([hashes[w] for w in ranked]), np.array([w[0] for w in ranked], np.uint8))
    assert number[: L.OWN].tolist() == list(range(L.OWN)) and not share[: L.OWN].any() and spelled.tolist() == [False] * known + [True] * (len(n) - known)
    for i in (L.OWN, (L.OWN + known) // 2, known - 1):
        g = ranked[i][0] % L.GROUPS
        assert number[i] == L.OWN + g and share[i] == pytest.approx(np.log(n[ranked[i]] / (rest[g] + 0.5)))
    assert {r.hash: r.n for r in rare.collect()} == {int(hashes[w].astype(np.int64)): n[w] for w in ranked[known:]}
    assert v.rare.sum() == sum(n[w] for w in ranked[known:]) and v.kinds.sum() == len(n) - known
    for g in set(number[L.OWN :].tolist()):  # the shares of a number and what is left for other words
        mine = np.flatnonzero((number == g) & ~spelled)
        assert np.exp(share[mine]).sum() + np.exp(v.escape[g - L.OWN]) == pytest.approx(1, abs=1e-9)


def test_the_network_beats_frequencies_and_scores_every_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = texts_of(docs)
    words = sum(map(len, texts.values()))
    n = Counter(w for t in texts.values() for w in t)
    model, rare = L.fit(docs, known=8000)
    got = {r.doc_id: r for r in L.score(docs, model, rare).collect()}
    assert sum(r.n_words for r in got.values()) == words
    start = L.Model(model.words, L.Network.fresh(model.words.counts), model.first, model.step)
    assert sum(r.log_likelihood for r in got.values()) > sum(r.log_likelihood for r in L.score(docs, start, rare).collect()) + 0.1 * words
    unseen = 0
    for k in sorted(texts, key=lambda k: len(texts[k]))[100:106]:
        hashes = np.array([next(word_hashes([w]))[1][0] for w in texts[k]])
        number, share, spelled = model.words.read(hashes, np.array([w[0] for w in texts[k]], np.uint8))
        own = [a + b + (rare_log(model, w, n[w]) if c else 0) for a, b, c, w in zip(brute(model.network, number.tolist()), share, spelled, texts[k], strict=True)]
        unseen += spelled.sum()
        assert got[k].log_likelihood == pytest.approx(sum(own), abs=0.02)
        assert got[k].mean == pytest.approx(got[k].log_likelihood / got[k].n_words)
    assert unseen
    for k, t in texts.items():
        assert got[k].n_once == sum(n[w] == 1 for w in t)


def test_spelled_words_sum_to_one():
    rng = np.random.default_rng(4)
    counts = np.zeros(L.SPELLED, np.int64)
    letters = [97, 98, 161]  # two of one group
    for _ in range(200):
        w = rng.choice(letters, rng.integers(1, 5))
        data = np.append(w, 32).astype(np.uint8)
        step, _, first = L.spelling(data, np.array([0]), np.array([len(w)]))
        counts[:256] += np.bincount(first, minlength=256)
        counts[256:] += np.bincount(step, minlength=256 * 257)
    first, step = L.spelling_logs(counts)
    assert np.exp(first[np.arange(256) % L.GROUPS == 97 % L.GROUPS]).sum() == pytest.approx(1)
    assert np.allclose(np.exp(step).reshape(256, 257).sum(1), 1)


def test_every_position_is_a_target(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c{i} d") for i in range(50)] + [(99, "x y " * 30_000)], "doc_id long, text string").repartition(3)
    copies = []
    monkeypatch.setattr(L, "_average", lambda rows: copies.extend(rows.collect()))
    L.fit(docs)
    assert sum(r.weight for r in copies) == 50 * 4 + 60_000


def test_words_of_one_number_have_their_own_probabilities(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(9000)) + " w3 w3 zebra"), (2, "w8000"), (3, "wzzqx"), (4, "w8999"), (5, "w\x00\x07")], "doc_id long, text string")
    model, rare = L.fit(docs.filter("doc_id = 1"), known=8990)
    got = {r.doc_id: r.log_likelihood for r in L.score(docs, model, rare).collect()}
    assert len({got[k] for k in (2, 3, 5)}) == 3 and max(got[3], got[5]) < min(got[2], got[4])


def test_rare_words_count(spark):
    """A word that occurs more often is likelier, and all words of a number sum to one with those that never occur."""
    docs = spark.createDataFrame([(1, "w1 " * 5 + "w2 w2 w3 x")], "doc_id long, text string")
    model, rare = L.fit(docs, known=0)
    assert len(model.words.hashes) == 0 and rare.count() == 4
    probe = spark.createDataFrame([(1, "w1"), (2, "w2"), (3, "w3"), (4, "w4"), (5, "www"), (6, "zz")], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in L.score(probe, model, rare).collect()}
    assert got[1] > got[2] > got[3] > got[4] > got[5] and np.isfinite(got[6])
    logs = [rare_log(model, w, k) for w, k in ((b"w1", 5), (b"w2", 2), (b"w3", 1))]
    assert got[1] - got[3] == pytest.approx(logs[0] - logs[2], abs=1e-6)
    given = sum((k - L.DISCOUNT) / 8 for k in (5, 2, 1)) + L.DISCOUNT * 3 / 8
    assert given == pytest.approx(1)


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "one", 4), (5, "a b " * 60_000, 5), (6, "one", 6), (None, "one", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mean int")
    model, rare = L.fit(docs)
    got = {r.doc_id: r for r in L.score(docs, model, rare).collect()}
    assert [got[k].n_words for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 120_000] and got[1].mean is None and got[2].log_likelihood == 0
    assert got[4].log_likelihood == got[6].log_likelihood == got[None].log_likelihood < 0
    empty = docs.limit(0)
    assert L.score(empty, *L.fit(empty)).count() == 0
    assert all(np.isfinite(r.log_likelihood) for r in L.score(docs, *L.fit(empty)).collect())


def test_runs_give_the_bytes_of_words():
    for step in (1, 20, 1 << 20):
        found = []
        for _, hashes, counts, data, starts, ends in word_runs([b"Ab  c", b"", b"one two three  four " * 3, b" "], step):
            assert len(hashes) == counts.sum() == len(starts)
            found += [bytes(L.lower(data[a:b])) for a, b in zip(starts, ends, strict=True)]
        assert found == [b"ab", b"c"] + [b"one", b"two", b"three", b"four"] * 3


def test_query_scores_words(spark, sf_dir):
    from quillon.llm.queries import op9_masked_scores

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in op9_masked_scores(spark, sf_dir).collect()}
    assert {k: r.n_words for k, r in got.items()} == {k: len(t) for k, t in texts_of(docs).items()}
    assert all(r.log_likelihood < 0 for r in got.values() if r.n_words)
