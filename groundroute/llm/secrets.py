"""Secret scans with structural confirmation.

Base patterns report what they match. Longer base64, hex and dotted candidates are decoded and
reported only if their structure holds: nested DER lengths that add up and a key's inner
shape, length-prefixed key blobs, or a signed token whose header parses.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import slices

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the contract (letters of the names in either case, ASCII only).
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs of 24 or more; a shorter run is a match that fails.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: What may stand between two lines of one key: a line break, or one written as \n, with what closes and opens string pieces, indents or quotes lines.
_SHUT, _OPEN = r"""["'+,\x20\t\\]{0,8}+""", r"""[\x20\t>"'|#*]{0,60}+"""
BREAK = rf"(?:{_SHUT}\r?\n{_OPEN}|(?:\\r)?\\n(?:{_SHUT}\r?\n{_OPEN})?)"
#: Lines of base64, the first one of at least 32 characters; read once, whatever they hold. A letter after a backslash belongs to that.
LINES = re.compile(rf"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\n))[A-Za-z0-9+/_-]{{32,}}+={{0,2}}+(?:{BREAK}[A-Za-z0-9+/]++={{0,2}}+(?![A-Za-z0-9+/_=-]))*+")
LINE = re.compile(rf"([A-Za-z0-9+/_-]+)(={{0,2}})(?:{BREAK})?")
LEAST_RUN = 32
#: Hexadecimal in one case, in lines, or in pairs parted by colons.
HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{48,}+(?:BREAK[0-9a-f]{2,}+)*+|[0-9A-F]{48,}+(?:BREAK[0-9A-F]{2,}+)*+)(?![0-9A-Za-z])".replace("BREAK", BREAK))
HEX_LINE = re.compile(rf"([0-9A-Fa-f]+)(?:{BREAK})?")
PAIRS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:(?:\r?\n[\x20\t]{0,60}+)?){23,}+[0-9A-Fa-f]{2}(?![0-9A-Za-z:])")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Algorithm names of signed tokens, and names of length-prefixed public keys.
ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA"}
KEY_PARTS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
BOXED = b"openssh-key-v1\0"
#: Elements of a key's sequence, and public keys of a boxed key: more make no key of a known kind.
MOST_PARTS, MOST_KEYS = 16, 256

Read = Callable[[int, int], bytes]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points, by start, then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def der_items(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill at to end exactly; None if lengths don't nest or
    elements are too many. Only headers are read: from one, its length leads to the next."""
    items = []
    while at < end:
        head = read(at, 6)
        if len(head) < 2 or len(items) == MOST_PARTS:
            return None
        tag, n, at = head[0], head[1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or len(head) < 2 + k:
                return None
            n, at = int.from_bytes(head[2 : 2 + k], "big"), at + k
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def der_key(read: Read, most: int) -> tuple[str, int] | None:
    """The kind and length of the key whose DER encoding begins at 0 and has at most so many bytes, or None."""
    head = read(0, 6)
    if len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4 or head[1] == 0x80:
        return None
    start = 2 + k
    end = start + (int.from_bytes(head[2:start], "big") if k else head[1])
    if not 16 <= end <= most:
        return None
    inner = der_items(read, start, end)
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    names = lambda x: bool((p := der_items(read, x[1], x[2])) and p[0][0] == 0x06)
    kind = None
    if tags[0] == 0x02 and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        kind = "rsa-private"
    elif tags[:2] == [0x02, 0x04] and inner[0][2] - inner[0][1] == 1:
        kind = "ec-private"
    elif tags[:3] == [0x02, 0x30, 0x04] and names(inner[1]):
        kind = "pkcs8-private"
    elif tags == [0x30, 0x03] and names(inner[0]):
        kind = "public"
    elif tags == [0x02, 0x02]:
        kind = "rsa-public"
    return (kind, end) if kind else None


def prefixed_key(read: Read, most: int) -> tuple[str, int] | None:
    """The kind and length of the key blob of length-prefixed strings that begins at 0, or None."""

    def past(at: int, strings: int) -> int | None:
        for _ in range(strings):
            head = read(at, 4)
            at += 4 + int.from_bytes(head, "big")
            if len(head) < 4 or at > most:
                return None
        return at

    if read(0, len(BOXED)) == BOXED:  # cipher, key derivation and its options; then the public keys and the sealed part
        at = past(len(BOXED), 3)
        keys = int.from_bytes(read(at, 4), "big") if at else 0
        end = past(at + 4, keys + 1) if 1 <= keys <= MOST_KEYS else None
        return ("openssh-private", end) if end else None
    n = int.from_bytes(read(0, 4), "big")
    parts = KEY_PARTS.get(read(4, n)) if n <= 32 else None
    end = past(0, parts) if parts else None
    return ("ssh-public", end) if end else None


def key_of(read: Read, most: int) -> tuple[str, int] | None:
    return der_key(read, most) or prefixed_key(read, most)


def encoded(flat: str, origin: int) -> Read:
    """Reads bytes of the base64 text flat (without padding and line breaks) from a character on."""

    def read(at: int, n: int) -> bytes:
        first = origin + at // 3 * 4
        part = flat[first : first + -(-(at % 3 + n) // 3) * 4]
        part = part[: len(part) - (len(part) % 4 == 1)].replace("-", "+").replace("_", "/")
        return base64.b64decode(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]

    return read


def wrapped_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Keys among the lines of base64 in text[start:end]. A key begins where a line does, and its own
    lengths tell where it ends: on a line's end, after lines of one width and none wider. Each line costs a few header
    reads, so that work grows with the text alone."""
    found = [(m.start(), m.end(2), m.end(1) - m.start(), bool(m[2])) for m in LINE.finditer(text, start, end)]
    flat = "".join(text[a : a + n] for a, _, n, _ in found)
    ends = list(accumulate(n for _, _, n, _ in found))
    alike = [0] * len(found)  # the last of the lines from here that are as wide and unpadded
    for i in range(len(found) - 1, -1, -1):
        _, _, n, padded = found[i]
        nxt = i + 1 < len(found) and found[i + 1][2] == n and not found[i + 1][3]
        alike[i] = i - 1 if padded else alike[i + 1] if nxt else i
    i = 0
    while i < len(found):
        origin, width = ends[i] - found[i][2], found[i][2]
        key = key_of(encoded(flat, origin), (len(flat) - origin) * 3 // 4) if width >= LEAST_RUN else None
        if key:
            stop = origin - (-key[1] * 4 // 3)
            j = bisect_left(ends, stop)
            if j < len(ends) and ends[j] == stop and j - 1 <= max(alike[i], i - 1) and found[j][2] <= width:
                yield found[i][0], found[j][1], key[0]
                i = j
        i += 1


def hex_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Keys among the lines of hexadecimal in text[start:end]: a key begins where a line does and ends where one does."""
    lines = [x.span(1) for x in HEX_LINE.finditer(text, start, end)]
    flat = "".join(text[a:b] for a, b in lines)
    data = bytes.fromhex(flat[: len(flat) - len(flat) % 2])
    ends, i = list(accumulate(b - a for a, b in lines)), 0
    while i < len(lines):
        at = ends[i] - (lines[i][1] - lines[i][0])
        key = key_of(lambda k, n, at=at // 2: data[at + k : at + k + n], len(data) - at // 2) if at % 2 == 0 else None
        if key and (j := bisect_left(ends, at + 2 * key[1])) < len(ends) and ends[j] == at + 2 * key[1]:
            yield lines[i][0], lines[j][1], key[0]
            i = j
        i += 1


def _decode64(run: str) -> bytes | None:
    run = re.sub(r"\s", "", run).rstrip("=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_header(header: str, payload: str, signature: str) -> str | None:
    parsed = []
    for part in (header, payload):
        try:
            parsed.append(json.loads(_decode64(part) or b"!"))
        except (ValueError, RecursionError):
            return None
    if not all(isinstance(x, dict) for x in parsed):
        return None
    alg = parsed[0].get("alg")
    if alg == "none" and not signature:
        return "unsigned-token"
    return "signed-token" if isinstance(alg, str) and alg in ALGORITHMS and _decode64(signature) else None


def _candidates(text: str) -> Iterator[tuple[int, int, str | None]]:
    for m in SIGNED.finditer(text):
        yield m.start(), m.end(), signed_header(*m.groups())
    for m in LINES.finditer(text):
        yield from wrapped_keys(text, *m.span())
    for m in HEX_RUN.finditer(text):
        yield from hex_keys(text, *m.span())
    for m in PAIRS.finditer(text):
        data = bytes.fromhex(re.sub(r"[:\s]", "", m[0]))
        key = key_of(lambda at, n, data=data: data[at : at + n], len(data))
        yield m.start(), m.end(), key[0] if key and key[1] == len(data) else None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of decoded candidates whose structure holds."""
    return sorted({(a, b, kind) for a, b, kind in _candidates(text) if kind})


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text; others ignored): counts of the base kinds, the
    SHA-256 of their spans, all spans (base ones first at equal starts), and how many the structural check
    added. Null or empty text: no spans. Repeated rows give repeated results. No shuffle."""

    common.long_texts(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            for ids, texts in slices(batch):
                out = []
                for i, text in zip(ids, texts):
                    base = base_spans(text)
                    more = confirmed_spans(text)
                    count = [sum(k == kind for _, _, k in base) for kind in KINDS]
                    spans = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else 9, s[2], s[1]))
                    out.append((i, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(more)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCANNED)


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"))
