import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from quillon.llm import mixing
from tests.llm.test_minhash_dedup import brute
from tests.llm.test_packing import check
from tests.llm.test_pii import base


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's input and output, written and read again as Parquet."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    extra = [(5000, None, "en", "src0", 0), (5001, "", None, "src0", 0), (5002, "1234 5678", "en", None, 9), (5003, "only letters here", None, None, 17)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for i, (_, stage) in enumerate(C.STAGES):
        made = stage(spark, docs, sf)
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        made.write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_all_but_the_last_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_language_drops_texts_without_letters(steps):
    before, after = (d.collect() for d in steps[0])
    assert sorted(after) == sorted(r for r in before if r.text and any(map(str.isalpha, r.text)))


def test_texts_whose_language_cannot_be_told_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    longest = {r.lang: r.text for r in sorted(docs.collect(), key=lambda r: len(r.text or ""))}
    assert len(longest) == 4
    odd = {
        6000: "".join(longest[k][i : i + 400] for i in range(0, 1200, 400) for k in sorted(longest)),  # a quarter in each language
        6001: "Ελληνικό κείμενο που δεν έχει μάθει κανείς εδώ",
        6002: "這是一個沒有人學過的中文文本",
        6003: "Это русский текст (in part)",
    }
    more = spark.createDataFrame([(k, text, None, "src0", len(text)) for k, text in odd.items()], docs.schema)
    after = C.identify_language(spark, docs.unionByName(more), "").collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text)))


def test_one_of_each_group_stays(steps):
    before, after = (d.collect() for d in steps[1])
    assert sorted(str(r.doc_id) for r in after) == sorted(k for k, _, _, keep in brute([(r.doc_id, r.text) for r in before], 80) if keep)


def test_private_spans_are_gone_and_clean_texts_are_not_touched(steps):
    before, after = ({r.doc_id: r for r in d.collect()} for d in steps[2])
    assert set(before) == set(after)
    for k, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        spans = base(before[k].text)
        if not spans and not re.search(r"[0-9]{3,}|\[", before[k].text):
            assert r == before[k]


def test_the_mix_meets_its_targets(steps):
    before, after = (d.collect() for d in steps[3])
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(r.text.encode().split())
    for r in after:
        taken[r.source] += len(r.text.encode().split())
    from tests.llm.test_mixing import fill

    for s, goal in fill(sizes).items():
        assert abs(taken[s] - goal) <= max(300, 0.3 * goal)
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and mixing.WEIGHTS == (5.0, 2.0, 1.0)


def test_packing_covers_what_was_kept(steps):
    before, after = (d.collect() for d in steps[4])
    counts = Counter(r.doc_id for r in before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    once = {k for k, n in counts.items() if n == 1}
    texts = {r.doc_id: r.text for r in before}
    tokens = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    assert sum(r.length for r in after) == sum(tokens[k] * n for k, n in counts.items())
    for r in after:
        assert r.doc_tokens == tokens[r.doc_id]
    assert once or check


def test_run_is_the_stages_in_order(spark, steps):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
