"""Secret scans: simple patterns, and encoded candidates confirmed by their structure.

Method: base patterns (an assignment to a telling name, an access key id, a long
hex run) report by shape alone. Beyond them, every base64 or hex run is only a
candidate: it is decoded and has to parse before it is reported. A run ends at its
padding, so that a name and '=' before it aren't part of it. Of one that doesn't
parse, the pieces between '-' and '_' and the hex between any marks are tried, and
every place after a mark where a key's header stands: the header's own length says
where the key ends, so a path before or after a key doesn't hide it. A key must be
DER whose nested lengths fill their parents exactly and whose fields are those
of a private key (PKCS#1, PKCS#8 plain or encrypted, SEC 1), or the length-
prefixed fields of an OpenSSH private key; a PEM block under an encryption header
must decode to whole cipher blocks. A signed token must have a JSON
header with a known algorithm, a JSON payload and a signature of the length
which that algorithm makes. A decoded run that is text with a candidate in it
is opened again, up to ``DEPTH`` times.

Cases. A null or empty text has no spans. Runs under 40 characters are no
candidates: 30 bytes are too few for any of these keys (a P-256 key alone takes 39).
A token header nested too deeply to parse is no header. Positions are code points, the end
exclusive. Per kind, spans don't overlap; spans of different kinds may. Texts
of any length are scanned whole. Equal rows give equal results, an empty table
gives no rows, and columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import map_arrow

KINDS = ("assign", "access", "hex", "pem", "key", "token")
DEPTH = 2
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
DIGITS = re.compile(r"[0-9a-fA-F]{40,}")
#: Where a key may begin inside a run: DER's first byte is 0x30; the magic word of OpenSSH.
HEAD = re.compile(r"(?<![A-Za-z0-9])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,32}\s)?((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
SIGNATURE_BYTES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)} | {f"{p}{n}": (128, 1024) for p in ("RS", "PS") for n in (256, 384, 512)}


def decode64(run: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it isn't."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or "=" in body or len(run) - len(body) > 2:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, bytes]] | None:
    """The (tag, body) pairs that fill data[at:end] exactly, or None."""
    end = len(data) if end is None else end
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or size >> 8 * (n - 1) == 0:
                return None
        if at + size > end:
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def der_key(data: bytes) -> str | None:
    """What private key the DER holds, by its fields."""
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = der_items(data)
    if not top or len(top) != 1 or not (fields := der_items(top[0][1])):
        return None
    tags = [tag for tag, _ in fields]
    if tags[:9] == [2] * 9 and fields[0][1] in (b"\0", b"\1") and len(fields[1][1]) >= 32:
        return "pkcs1"
    if tags[:2] == [2, 4] and fields[0][1] == b"\1" and 16 <= len(fields[1][1]) <= 80 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "sec1"
    if tags[:3] == [2, 0x30, 4] and fields[0][1] in (b"\0", b"\1"):
        algorithm = der_items(fields[1][1])
        if algorithm and algorithm[0][0] == 6 and len(fields[2][1]) >= 16:
            return "pkcs8"
    if tags == [0x30, 4] and len(fields[1][1]) >= 16 and (algorithm := der_items(fields[0][1])) and algorithm[0][0] == 6 and algorithm[0][1].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01"):
        return "pkcs8-encrypted"
    return None


def openssh_key(data: bytes) -> str | None:
    """Whether the bytes are an OpenSSH private key: its lengths must lead to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []

    def field(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):
        if (end := field(at)) is None:
            return None
        fields.append(data[at + 4 : end])
        at = end
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(min(keys, 16) + 1):
        if (end := field(at)) is None:
            return None
        at = end
    return "openssh" if keys and fields[0].isascii() and not data[at:].strip(b"\0") else None


def signed_token(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token whose three parts hold together."""
    parts = [decode64(x) for x in (header, payload, signature)]
    if None in parts:
        return None
    try:
        head, body = (json.loads(x) for x in parts[:2])
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(body, dict):
        return None
    low, high = SIGNATURE_BYTES.get(str(head.get("alg")), (1, 0))
    return str(head["alg"]) if low <= len(parts[2]) <= high else None


def confirm(data: bytes, depth: int = DEPTH) -> str | None:
    """What the decoded bytes prove to be, or None."""
    if found := der_key(data) or openssh_key(data):
        return found
    if depth and data.isascii() and len(data) >= 40:
        for kind, _, _, what in encoded_spans(data.decode("ascii"), depth - 1):
            return f"{kind}:{what}"
    return None


def coded(run: str, depth: int) -> str | None:
    """What a run of hex or base64 proves to be, or None."""
    digits = run.rstrip("=")
    if not len(digits) % 2 and re.fullmatch(r"[0-9a-fA-F]+", digits) and (what := confirm(bytes.fromhex(digits), depth)):
        return what
    data = decode64(run)
    return confirm(data, depth) if data else None


def der_end(text: str, at: int) -> int | None:
    """Where the base64 of a DER key that begins at ``at`` ends, by its header; its first field must be a version or an algorithm."""
    head = decode64(text[at : at + 12])
    if not head or len(head) < 9:
        return None
    wide = head[1] - 0x80 if head[1] >= 0x80 else 0
    if wide > 2 or head[2 + wide] not in (0x02, 0x30):  # no key takes more than 64 KiB
        return None
    size = 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
    return at - (-4 * size // 3)


def openssh_end(text: str, at: int, end: int) -> int | None:
    """Where the base64 of an OpenSSH key that begins at ``at`` ends, by the lengths of its fields."""

    def number(place: int) -> int | None:
        first = at + place // 3 * 4
        data = decode64(text[first : first + 8]) if first + 8 <= end else None
        return int.from_bytes(data[place % 3 : place % 3 + 4], "big") if data and len(data) == 6 else None

    place, left, keys = 15, 3, False
    while left:
        if (size := number(place)) is None:
            return None
        place, left = place + 4 + size, left - 1
        if at + place // 3 * 4 > end:
            return None
        if not left and not keys:
            if not (n := number(place)):
                return None
            place, left, keys = place + 4, min(n, 16) + 1, True
    return at - (-4 * place // 3)


def inner_spans(text: str, at: int, end: int, depth: int) -> list[tuple[str, int, int, str]]:
    """Keys inside a run of text[at:end] that isn't one as a whole, from left to right without overlaps."""
    tried = [(p.start(), p.end(), what) for p in PIECE.finditer(text, at, end) if p.end() - p.start() < end - at and (what := coded(p[0], depth))]
    tried += [(p.start(), p.end(), what) for p in DIGITS.finditer(text, at, end) if p.end() - p.start() < end - at and (what := coded(p[0], depth))]
    last = at
    for p in HEAD.finditer(text, at, end):
        begin = p.start()
        if begin < last or end - begin < 40:
            continue
        stop = der_end(text, begin) if text[begin] == "M" else openssh_end(text, begin, end)
        if stop is None or stop > end or stop - begin < 40 or text[stop : stop + 1].isalnum():
            continue
        data = decode64(text[begin:stop])
        if data and (what := der_key(data) or openssh_key(data)):
            last = min(stop + len(re.match("={0,2}", text[stop:end])[0]), end)
            tried.append((begin, last, what))
    found, last = [], at
    for start, stop, what in sorted(tried):
        if start >= last:
            found.append(("key", start, stop, what))
            last = stop
    return found


def encoded_spans(text: str, depth: int = DEPTH) -> list[tuple[str, int, int, str]]:
    """Spans of encoded secrets that their structure confirms, by kind and start."""
    found = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decode64(re.sub(r"\s|\\[nr]", "", m[3]))
            if not data:
                continue
            if what := ("encrypted" if not len(data) % 8 else None) if m[2] else confirm(data, 0):
                found.append(("pem", m.start(), m.end(), what))
    for m in RUN.finditer(text):
        if what := coded(m[0], depth):
            found.append(("key", m.start(), m.end(), what))
        else:
            found += inner_spans(text, m.start(), m.end(), depth)
    if "ey" in text and "." in text:
        for m in TOKEN.finditer(text):
            if what := signed_token(*m.groups()):
                found.append(("token", m.start(), m.end(), what))
    return found


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Spans of the base patterns: shape alone."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), "") for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end(), "") for m in HEX.finditer(text)]


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """All spans as (kind, start, end, what), by start and then by kind as in ``KINDS``."""
    return sorted(base_spans(text or "") + encoded_spans(text or ""), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "kind string, start long, end long, what string"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``, an array of spans (kind, start, end, what)."""

    def rows(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("what", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "what"), s, strict=True)) for s in find(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, kind)], ["doc_id", "found"])

    return map_arrow(docs.select("doc_id", "text"), rows, f"doc_id long, found array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")

