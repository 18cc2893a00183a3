import zlib

import numpy as np
import pytest

from quillon.llm import language_id as L


def test_gradients_agree_with_differences():
    net = L.Network.fresh(["a", "b", "c"], 4)
    net.weights = {k: x.astype(np.float64) for k, x in net.weights.items()}
    rng = np.random.default_rng(0)
    data, labels = rng.integers(97, 103, (7, 6)), np.array([0, 1, 1, 0, 2, 1])
    exact, _ = net.gradients(data, labels)
    for name, x in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            if name[0] == "x":
                at = (at[0], int(rng.integers(97, 103)))
            was, e = x[at], 1e-6
            x[at] = was + e
            up = net.gradients(data, labels)[1]
            x[at] = was - e
            down = net.gradients(data, labels)[1]
            x[at] = was
            assert exact[name][at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=3e-7), name


def test_windows_and_batches_do_not_change_what_is_read():
    net = L.Network.fresh(["a", "b"], 5)
    rng = np.random.default_rng(1)
    raw = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 5, 64, 65, 128, 200)]
    all_at_once, in_batches = net.predict(raw), net.predict(raw, batch=2)
    assert np.allclose(all_at_once, in_batches, atol=1e-6) and np.allclose(all_at_once.sum(1), 1, atol=1e-5)
    for x, p in zip(raw, all_at_once, strict=True):
        pieces = [x[i : i + 64] for i in range(0, len(x), 64)]
        sums = sum(net.run(np.frombuffer(w, np.uint8)[:, None])[:, 0] for w in pieces)
        assert np.allclose(sums / len(x), p, atol=1e-5)


def test_held_out_accuracy_and_contract(spark):
    from quillon.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(right) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def plain(net, raw):
    """Mean probabilities over a text's bytes by a loop over one byte after the other."""
    w, n, total = {k: x.astype(float) for k, x in net.weights.items()}, net.hidden, 0.0

    def step(d, byte, h):
        x, g = w[f"x{d}"][:, byte], w[f"u{d}"] @ h
        gates = np.clip((x[: 2 * n] + g[: 2 * n]) / 4 + 0.5, 0, 1)
        new = np.clip(x[2 * n :] + gates[n:] * g[2 * n :], -1, 1)
        return gates[:n] * h + (1 - gates[:n]) * new

    for at in range(0, len(raw), L.WINDOW):
        piece, left, right = raw[at : at + L.WINDOW], [np.zeros(n)], [np.zeros(n)]
        for byte in piece:
            left.append(step("f", byte, left[-1]))
        for byte in reversed(piece):
            right.append(step("b", byte, right[-1]))
        for i in range(len(piece)):
            y = np.exp(w["v"] @ np.concatenate([left[i + 1], right[len(piece) - i]]) + w["c"][:, 0])
            total = total + y / y.sum()
    return total / len(raw)


def test_query_equals_a_loop_over_bytes(spark, sf_dir):
    from quillon.llm.queries import op6_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = L.learn(docs)
    got = {r.doc_id: r for r in op6_language_id(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:150:3]:
        if not any(map(str.isalpha, texts[k] or "")):
            assert (got[k].lang_pred, got[k].score) == ("und", 0)
            continue
        p = plain(net, texts[k].encode())
        assert got[k].lang_pred == net.languages[int(p.argmax())] and got[k].score == pytest.approx(p.max(), abs=1e-4)


def test_all_windows_of_a_text_are_learned_from():
    raw = bytes(range(200))
    windows = L.windows_of(raw, 64)
    assert [w[0] for w in windows] == [0, 64, 128, 136] and set(b"".join(windows)) == set(raw) and L.windows_of(raw[:128], 64) == [raw[:64], raw[64:128]]
    assert L.windows_of(b"ab", 5) == [b"ababa"]


def test_many_languages_are_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 600}") for i in range(3000)], "doc_id long, text string, lang string")
    net = L.learn(docs, steps=2)
    assert len(net.languages) == 600 and L.classify(docs.limit(5), net).count() == 5


def test_edge_rows(spark):
    words = {"xx": "abba cabba dabba ", "yy": "ziv wox zup vizz "}
    rows = [(i, words[k] * 30, k, "s") for i in range(60) for k in [("xx", "yy")[i % 2]]]
    rows += [(None, "1234 !!", None, "s"), (1000, None, "xx", "s"), (1001, "", "yy", "s"), (1002, words["xx"] * 3000, None, "s"), (1003, "á", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = L.learn(docs, steps=80)
    got = {r.doc_id: r for r in L.classify(docs, net).collect()}
    assert [got[k].lang_pred for k in (None, 1000, 1001, 1002)] == ["und", "und", "und", "xx"] and got[1003].lang_pred in words
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] for i in range(60))
    kept = L.keep_known(docs, net)
    assert kept.columns == docs.columns and kept.count() == 62
    nothing = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.classify(docs, nothing).collect()} == {"und"} and L.classify(docs.limit(0), net).count() == 0


def test_without_languages_texts_with_a_letter_stay(spark):
    from quillon.llm import language_id

    docs = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "\u00e9", None), (5, "", None)], "doc_id long, text string, lang string")
    kept = language_id.keep_known(docs, language_id.learn(docs)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4]
