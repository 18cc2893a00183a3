import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import media as M


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=4000))
def test_round_trip(raw):
    payload = M.padded(raw.decode("latin-1"))
    data = M.write_media(payload)
    (track,) = M.read_tracks(data)
    assert M.payload(data, track) == payload and track.duration == len(payload) and track.codec == "raw "
    assert [payload[64 * 16 * i : 64 * 16 * i + 64] for i in range(len(track.keyframes))] == [data[a:b] for a, b in track.key_ranges()]
    paths = [p for p, _, _ in M.walk(data)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths and paths[-1] == (b"mdat",)


def test_other_layouts_are_read():
    """Uneven samples and chunks, 64-bit offsets and sizes, unknown boxes, no sync table."""
    pieces = [b"aa", b"bbbb", b"c", b"dddddd", b"ee"]
    head = M.box(b"free", b"x" * 5)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 3 + sum(map(len, pieces)))
    at = len(head) + len(mdat)
    body = b"".join(pieces[:2]) + b"..." + b"".join(pieces[2:])
    stbl = M.box(b"stbl", M.full(b"stsd", struct.pack(">I", 1), M.box(b"mp4a", bytes(28))), M.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 20)), M.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 3, 1)), M.full(b"stsz", struct.pack(">II5I", 0, 5, *map(len, pieces))), M.full(b"co64", struct.pack(">IQQ", 2, at, at + 9)))
    mdhd = M.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 100, 80, 0, 0), version=1)
    data = head + mdat + body + M.box(b"moov", M.box(b"trak", M.box(b"mdia", mdhd, M.full(b"hdlr", bytes(4), b"soun", bytes(13)), M.box(b"minf", stbl))), M.box(b"zzzz", b"?"))
    (track,) = M.read_tracks(data)
    assert M.payload(data, track) == b"".join(pieces) and track.seconds == 0.8 and track.codec == "mp4a" and len(track.keyframes) == 5


@pytest.mark.parametrize("damage", [lambda d: d[:-1], lambda d: d.replace(b"stsz\0\0\0\0\0\0\0\x40\0\0\0\x01", b"stsz\0\0\0\0\0\0\0\x40\0\0\0\x02")])
def test_damage_is_an_error(damage):
    with pytest.raises(ValueError):
        M.read_tracks(damage(M.write_media(bytes(64))))


def test_query_round_trips_every_text(spark, sf_dir):
    from quillon.llm.queries import op8_media_columns

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_media_columns(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(rows)
    for r in got:
        raw = rows[r.doc_id].encode()
        back = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100_000), (4, "same"), (5, "same"), (None, "x" * 64)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in M.describe(M.store(docs)).collect()}
    assert got[1][1:] == got[2][1:] and got[1].payload_bytes == 64 and got[4][1:] == got[5][1:] and got[None].payload_bytes == 64 and got[3].n_bytes == 200_000
    assert M.describe(M.store(docs.limit(0))).count() == 0 and np.all([r.media_bytes > r.payload_bytes for r in got.values()])
