"""Media columns: ISO media containers written and read by their boxes.

Method: a payload is stored as 8-bit unsigned PCM in an ISO base media file
(``ftyp``, ``moov`` with one audio track, ``mdat``). The reader walks nested
boxes by their headers, decodes the sample tables (``stts``, ``stsc``, ``stsz``,
``stco`` or ``co64``, ``stss``) and reports codec, duration and the byte ranges
of keyframes from the tables alone; the payload's bytes are neither decoded nor
visited until ``payload`` gathers them.

Cases. A null or empty text stores one block of 64 zero bytes. Equal texts give
equal files. Boxes of unknown type are stepped over; sizes 0 (to the end) and 1
(64-bit) are read; a box that passes its parent's end, or a table that doesn't
add up, raises ``ValueError``. Empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import map_arrow

RATE, BLOCK, KEY_EVERY = 8000, 64, 16
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes and zeros up to a positive multiple of the block."""
    raw = (text or "").encode()
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def write_media(payload: bytes) -> bytes:
    """One audio track of 8-bit samples: a sample of the tables is a block of 64 bytes.

    Chunks hold ``KEY_EVERY`` blocks, and the first block of each is a sync sample.
    """
    blocks = len(payload) // BLOCK
    if not blocks or len(payload) % BLOCK:
        raise ValueError("a payload is a positive number of whole blocks")
    chunks = -(-blocks // KEY_EVERY)
    last = blocks - (chunks - 1) * KEY_EVERY
    runs = [(1, KEY_EVERY if chunks > 1 or last == KEY_EVERY else last)] + [(chunks, last)] * (chunks > 1 and last != KEY_EVERY)
    ticks = len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    big = ticks + 4096 >= 1 << 32

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (BLOCK * KEY_EVERY)
        where = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if big else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, blocks, BLOCK)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            full(b"stsz", struct.pack(">II", BLOCK, blocks)),
            where,
            full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * KEY_EVERY + 1).astype(">u4").tobytes()),
        )
        wide = int(ticks >= 1 << 32)
        span = struct.pack(">QQIQ" if wide else ">IIII", 0, 0, RATE, ticks)
        track = struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, ticks)
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", span, struct.pack(">HH", 0x55C4, 0), version=wide), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        trak = box(b"trak", full(b"tkhd", track, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=wide, flags=7), mdia)
        return box(b"moov", full(b"mvhd", span, struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=wide), trak)

    head = struct.pack(">I4sQ", 1, b"mdat", ticks + 16) if big else struct.pack(">I4s", ticks + 8, b"mdat")
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + len(head)), head, payload))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box as (path, start of body, end), parents first, by headers only."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError("a box passes its parent's end")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


@dataclass
class Track:
    """What the tables say of a track; offsets and sizes are of its samples, in bytes."""

    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        at = self.keyframes
        return list(zip(self.offsets[at].tolist(), (self.offsets[at] + self.sizes[at]).tolist(), strict=True))


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes and sample tables."""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        elif tracks and path[:2] == (b"moov", b"trak"):
            tracks[-1][kind] = (at, end)
    return [_track(data, boxes) for boxes in tracks]


def _ints(data: bytes, at: int, n: int, width: int, end: int) -> np.ndarray:
    if at + n * width > end:
        raise ValueError("a table passes its box")
    return np.frombuffer(data, f">u{width}", n, at).astype(np.int64)


def _track(data: bytes, boxes: dict) -> Track:
    at, end = boxes[b"mdhd"]
    wide = data[at] == 1
    timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    handler = data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12].decode("latin-1")
    codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1")
    at, end = boxes[b"stsz"]
    one, n = struct.unpack_from(">II", data, at + 4)
    sizes = np.full(n, one, np.int64) if one else _ints(data, at + 12, n, 4, end)
    at, end = boxes[b"stts"]
    times = _ints(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0], 4, end).reshape(-1, 2)
    if int(times[:, 0].sum()) != n:
        raise ValueError("stts and stsz disagree")
    width, (at, end) = (8, boxes[b"co64"]) if b"co64" in boxes else (4, boxes[b"stco"])
    chunks = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], width, end)
    at, end = boxes[b"stsc"]
    runs = _ints(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0], 4, end).reshape(-1, 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    per_chunk = np.repeat(runs[:, 1], spans)
    if len(per_chunk) != len(chunks) or int(per_chunk.sum()) != n:
        raise ValueError("stsc, stco and stsz disagree")
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    offsets = chunks[chunk] + before - (before[first] if n else before)[chunk]
    if b"stss" in boxes:
        at, end = boxes[b"stss"]
        keys = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], 4, end) - 1
    else:
        keys = np.arange(n)
    if n and (int((offsets + sizes).max()) > len(data) or (len(keys) and not 0 <= int(keys.min()) <= int(keys.max()) < n)):
        raise ValueError("a sample lies outside the file")
    return Track(codec, handler, timescale, duration, offsets, sizes, keys)


def payload(data: bytes, track: Track) -> bytes:
    """The samples' bytes in order; neighbouring samples are read as one stretch."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[np.r_[0, cuts]].tolist(), ends[np.r_[cuts - 1, len(ends) - 1]].tolist(), strict=True))


def feature(track: Track) -> str:
    """Codec, duration, samples and the keyframes' byte ranges as text.

    The ranges are all there, as a first range, a stride and a count for each run
    of evenly spaced ones, so that the text stays short for long tracks.
    """
    ranges, runs = np.array(track.key_ranges(), np.int64).reshape(-1, 2), []
    i = 0
    while i < len(ranges):
        step, n = (int(ranges[i + 1, 0] - ranges[i, 0]) if i + 1 < len(ranges) else 0), 1
        even = np.flatnonzero((np.diff(ranges[i:, 0]) != step) | (np.diff(ranges[i:, 1]) != step))
        n = int(even[0]) + 1 if len(even) else len(ranges) - i
        runs.append(f"{ranges[i, 0]}-{ranges[i, 1]}" + (f"+{step}x{n}" if n > 1 else ""))
        i += n
    return f"codec={track.codec.strip()};handler={track.handler};seconds={track.seconds:.6f};samples={len(track.sizes)};keyframes={len(track.keyframes)};ranges={','.join(runs)}"


STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """The media column: each text's file, with its id and the bytes before padding."""

    def rows(batches):
        for batch in batches:
            raw = batch.column("text").to_pylist()
            for at in range(0, len(raw), 256):
                some = raw[at : at + 256]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256).cast(pa.int64()), pa.array([len((x or "").encode()) for x in some], pa.int64()), pa.array([write_media(padded(x)) for x in some], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), rows, STORED)


def describe(stored: DataFrame) -> DataFrame:
    """Read every stored file back and compute its digests and features."""

    def one(data: bytes) -> tuple:
        track = read_tracks(data)[0]
        back = payload(data, track)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)

    def rows(batches):
        for batch in batches:
            made = [one(x) for x in batch.column("media").to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))], [f.split()[0] for f in FEATURES.split(", ")])

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), rows, FEATURES)
