"""Pack documents into fixed-length sequences along a space-filling curve.

Method: a document's token ids are counted into a hashed vector of ``HASHED``
signed coordinates, which a fixed random matrix projects to a few dimensions
(both at once: an id has the matrix's row of its coordinate, times its sign).
The projection is laid on a grid and numbered by its place on a Hilbert curve,
so documents with like vocabulary get near keys. Rows are dealt out by ranges of
(key, id) and sorted; each partition is one stretch of the curve, whose ids are
laid end to end and cut every ``length`` ids. What is left at the end of a
stretch is cut into powers of two, which need no padding: every sequence is
full, or its length is a power of two.

The ids are made once and kept in the shared folder; the sort moves them once.
Equal documents have equal keys and are told apart by their id, so a range can
end inside a group of copies and no task gets a whole hot group.

Cases. A null or empty text is the single end id. Null document ids sort first.
Rows with the same id and key follow in the order of their ids' CRC, so only
equal rows can change places. Texts of any length are encoded whole. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import json
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import map_arrow, save
from quillon.llm.shingles import mix

DIMENSIONS, BITS, HASHED = 4, 15, 1 << 14


class Encoder:
    """Token ids as little-endian bytes (of numpy type ``kind``), the same as the tokenizer's own.

    Texts are encoded whole, those that may hold a special token by the tokenizer
    itself. A text that follows an equal one, as a mix's repetitions do, takes its ids.
    """

    def __init__(self, vocabulary: str, ranks: str, kind: str = "<u4") -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._ordinary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        with open(vocabulary, encoding="utf-8") as described:
            self._special = tuple(t["content"] for t in json.load(described)["added_tokens"])
        self._vocabulary, self._kind = vocabulary, kind
        self._last: tuple[str, bytes] = ("", b"")

    @cached_property
    def _tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._vocabulary)

    def _ids(self, text: str) -> list[int]:
        if any(s in text for s in self._special):
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        return self._ordinary(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text != self._last[0]:
            self._last = (text, np.array(self._ids(text), self._kind).tobytes())
        return self._last[1]


@lru_cache(1)
def encoder(vocabulary: str, ranks: str, kind: str = "<u4") -> Encoder:
    return Encoder(vocabulary, ranks, kind)


def narrow(id_count: int) -> str:
    """The numpy type in which ids are kept between the steps."""
    return "<u2" if id_count <= 1 << 16 else "<u4"


@lru_cache(2)
def projection(ids: int, dimensions: int, seed: int = 5) -> np.ndarray:
    """A row for each id: where its hashed coordinate and sign go under the random matrix."""
    matrix = np.random.default_rng(seed).standard_normal((HASHED, dimensions)).astype(np.float32)
    drawn = mix(np.arange(1, ids + 1, dtype=np.uint64))
    sign = np.where(drawn >> np.uint64(63), np.float32(-1), np.float32(1))
    return matrix[(drawn % np.uint64(HASHED)).astype(np.int64)] * sign[:, None]


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates below 2**bits."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def curve_keys(ids: np.ndarray, starts: np.ndarray, vocabulary: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Curve keys of documents that lie end to end in ``ids``; none is empty."""
    table = projection(vocabulary, dimensions)
    lengths = np.diff(np.append(starts, len(ids)))
    grid = np.empty((len(starts), dimensions), np.int64)
    for d in range(dimensions):
        mean = np.add.reduceat(table[:, d][ids], starts, dtype=np.float64) / lengths
        grid[:, d] = (0.5 + np.arctan(mean * 4) / np.pi) * ((1 << bits) - 1)
    return hilbert(grid, bits)


def pieces_of(ids: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut stretches at documents' starts and at ``cuts``: each piece's begin, end and document."""
    end = cuts[-1]
    edges = np.union1d(starts[starts < end], cuts)
    return edges[:-1], edges[1:], np.searchsorted(starts, edges[:-1], "right") - 1


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode(docs: DataFrame, vocabulary: str, ranks: str, end_id: int = 0, id_count: int = 50_257) -> DataFrame:
    """``doc_id``, ``curve`` and ``ids`` of each text: bytes of the narrow type, the end id last."""
    kind = narrow(id_count)

    def rows(batches):
        make = encoder(vocabulary, ranks, kind).encode
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            made = [make(x) + end for x in batch.column("text").to_pylist()]
            if not made:
                continue
            sizes = np.array([len(x) // len(end) for x in made])
            keys = curve_keys(np.frombuffer(b"".join(made), kind), np.cumsum(sizes) - sizes, id_count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "curve", "ids"])

    return map_arrow(docs.select("doc_id", "text"), rows, "doc_id long, curve long, ids binary")


def pack(docs: DataFrame, length: int = 1024, vocabulary: str | None = None, ranks: str | None = None, end_id: int = 0, id_count: int = 50_257) -> DataFrame:
    """The pieces of all documents and their places in sequences, with their ids (unsigned 32-bit).

    ``start`` is the number of the document's ids before the piece, ``doc_tokens``
    all its ids, ``offset`` the piece's place in ``sequence_id``. Packed sequences
    are the pieces of a ``sequence_id`` in the order of ``offset``.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = narrow(id_count)
    width = np.dtype(kind).itemsize
    made = save(encode(docs, vocabulary, ranks, end_id, id_count))
    order = ["curve", "doc_id", F.crc32("ids")]
    laid = made.repartitionByRange("curve", "doc_id").sortWithinPartitions(*order)

    def rows(batches):
        sequence = TaskContext.get().partitionId() << 32
        # What doesn't fill a sequence yet: its ids, and each document's id, tokens and ids before it.
        held, held_rows = np.empty(0, kind), []

        def emit(ids, starts, documents, cuts):
            nonlocal sequence
            begins, ends, which = pieces_of(ids, starts, cuts)
            at = np.searchsorted(cuts, begins, "right") - 1
            doc_id, tokens, before = (np.array(c) for c in zip(*documents, strict=True))
            raw = memoryview(ids.astype("<u4").tobytes())
            numbers = [[documents[i][0] for i in which], before[which].astype(np.int64) + begins - starts[which], ends - begins, tokens[which].astype(np.int64), sequence + at, begins - cuts[at]]
            arrays = [pa.array(x, pa.int64()) for x in numbers]
            arrays.append(pa.array([raw[4 * a : 4 * b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()))
            sequence += len(cuts) - 1
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            if not blobs:
                continue
            sizes = [len(x) // width for x in blobs]
            documents = held_rows + [(d, n, 0) for d, n in zip(batch.column("doc_id").to_pylist(), sizes, strict=True)]
            ids = np.concatenate([held, np.frombuffer(b"".join(blobs), kind)])
            spans = np.array([n - b for _, n, b in held_rows] + sizes)
            starts = np.cumsum(spans) - spans
            full = len(ids) // length * length
            if full:
                yield emit(ids, starts, documents, np.arange(0, full + 1, length))
            first = int(np.searchsorted(starts, full, "right")) - 1
            last = [(d, n, b) for d, n, b in documents[first:]] if full < len(ids) else []
            if last:
                d, n, b = last[0]
                last[0] = (d, n, b + full - int(starts[first]))
            held, held_rows = ids[full:].copy(), last
        if len(held):
            powers = [1 << b for b in range(len(held).bit_length() - 1, -1, -1) if len(held) >> b & 1]
            spans = np.array([n - b for _, n, b in held_rows])
            yield emit(held, np.cumsum(spans) - spans, held_rows, np.cumsum([0, *powers]))

    return map_arrow(laid.select("doc_id", "ids"), rows, PIECES)
