import zlib
from collections import defaultdict

from quillon.llm import sharding as S


def check(got, rows, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    held, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        held[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else -1))
    ordered = [k for s in sorted(slots) for _, k in sorted(slots[s])]
    assert ordered == sorted(ordered)
    for s in slots.values():
        assert sorted(x for x, _ in s) == list(range(len(s)))
    mean, largest = sum(held.values()) / shards, max(r.size for r in got)
    assert all(abs(held[s] - mean) <= largest + 1 for s in range(shards))


def test_query_balances_bytes(spark, sf_dir):
    from quillon.llm.queries import op5_shard_documents

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op5_shard_documents(spark, sf_dir).collect(), rows, 16)


def test_edge_rows(spark, tmp_path):
    rows = [(i, "é" * (i % 40)) for i in range(300)] + [(None, "x"), (900, None), (901, ""), (902, "long " * 20_000)] + [(7, "é" * 7)] * 50
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, size int").repartition(6)
    check(S.shard(docs, 4).collect(), rows, 4)
    assert S.shard(docs.limit(0), 4).count() == 0
    clashing = docs.selectExpr("*", "doc_id as shard", "'a' as law", "1 as slot", "2 as row_index", "3 as size_before", "4 as text_crc32", "5 as row")
    for df, name in ((docs, "shard"), (clashing, "shard_")):
        out = str(tmp_path / name)
        assert S.write_shards(df, out, 4) == name
        back = spark.read.parquet(out)
        assert sorted(back.columns) == sorted([*df.columns, name])
        assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
        assert {r[0] for r in back.select(name).distinct().collect()} <= set(range(4))
