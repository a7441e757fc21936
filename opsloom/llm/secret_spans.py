"""Secret scans: base patterns, and encoded candidates that are reported only when their structure holds."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsloom.llm.texts import byte_table, runs, slices

# The base kinds in their order, with their patterns.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "jwt", "key", "pem")

# Candidates of the structural kinds. Each pattern reads a character a fixed number of times: no repeat holds another
# repeat, and a repeat is possessive or ends where its characters end.
DOTTED = re.compile(r"[A-Za-z0-9_.-]{13,}+")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
END = re.compile(r"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
HEADER = re.compile(r"[A-Za-z0-9-]++:\x20[\x20-\x7E]*+")
ENCODED = re.compile(r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/])(?!(?<=\\)[nrt]))[A-Za-z0-9+/]{16,}+={0,2}+")
BARE_HEX = re.compile(r"[0-9A-Fa-f]{64,}+")
# A line may end as such or escaped, as in JSON.
_ESCAPED = re.compile(r"(?<!\\)\\++[nrt]")
_BREAK = re.compile(r"(?:\r?\n|(?:\\++r)?\\++n)[\x20\t]*+")

_LONG = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"private key-----")


def _tlv(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end) of the DER element at a place; None if its length does not fit."""
    if at + 2 > len(data):
        return None
    tag, size, body = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or body + width > len(data):
            return None
        size, body = int.from_bytes(data[body : body + width]), body + width
        if size < 0x80:
            return None
    return (tag, body, body + size) if body + size <= len(data) else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements between two places, which they must fill without a gap."""
    out = []
    while start < end:
        one = _tlv(data[:end], start)
        if one is None:
            return None
        out.append(one)
        start = one[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER sequence that fills the data, begins with a small version number and holds two more elements at least,
    one of them a number or octets of a key's size; nested sequences must be filled too."""
    outer = _tlv(data, 0)
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _children(data, outer[1], outer[2])
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return False
    if any(tag == 0x30 and _children(data, a, b) is None for tag, a, b in parts):
        return False
    return any(tag in (0x02, 0x04) and b - a >= 16 for tag, a, b in parts[1:])


def is_encrypted_key(data: bytes) -> bool:
    """The encrypted PKCS#8 shape: a sequence that fills the data, of an algorithm (a sequence that begins with an
    identifier) and octets of a key's size."""
    outer = _tlv(data, 0)
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _children(data, outer[1], outer[2])
    if not parts or [t for t, _, _ in parts] != [0x30, 0x04] or parts[1][2] - parts[1][1] < 16:
        return False
    inner = _children(data, *parts[0][1:])
    return bool(inner) and inner[0][0] == 0x06


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_encrypted_key(data) or is_ssh_key(data)


def _fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill the data."""
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def is_ssh_key(data: bytes) -> bool:
    """The private format of SSH: its magic, three fields (cipher, derivation and its options), the number of keys, then
    as many public keys and one private part, without a gap; each public key is fields in turn, a key type first."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    rest, at = data[len(magic) :], 0
    for _ in range(3):
        at += 4 + int.from_bytes(rest[at : at + 4])
    count, parts = int.from_bytes(rest[at : at + 4]), _fields(rest[at + 4 :])
    if at + 4 > len(rest) or not parts or not 1 <= count == len(parts) - 1 or len(parts[-1]) < 16:
        return False
    public = [_fields(p) for p in parts[:-1]]
    return all(p and len(p) >= 2 and p[0].startswith((b"ssh-", b"ecdsa-", b"sk-")) for p in public)


def _decode64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        data = base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None
    return data


def is_signed_token(header: str, payload: str) -> bool:
    """Both parts decode to JSON objects and the header names its algorithm."""
    parts = [_decode64(header, True), _decode64(payload, True)]
    try:
        top, body = (json.loads(p.decode()) if p is not None else None for p in parts)
    except (ValueError, RecursionError):
        return False
    return isinstance(top, dict) and isinstance(body, dict) and isinstance(top.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end): leftmost matches without overlap per kind; those too short are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def _signed_tokens(text: str) -> list[tuple[int, int, int]]:
    """Header, payload and signature between dots, wherever the last three parts are a token's; a dot may end it."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            head, payload, signature = parts[i : i + 3]
            # A header begins with a brace, so its first character is told by that byte's first six bits.
            last = i + 3 == len(parts) or not parts[i + 3]
            if last and len(head) >= 8 and head[0] == "e" and len(payload) >= 2 and is_signed_token(head, payload):
                end = at + len(head) + len(payload) + len(signature) + 2
                out.append((at, 3, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(head) + 1, i + 1
    return out


def _bare_keys(text: str) -> list[tuple[int, int, int]]:
    """Keys in base64, on one line or wrapped at any width: full lines of one length, then a last one that is no longer."""
    found = list(ENCODED.finditer(text))
    joined = [
        y.start() - x.end() < 4096 and x[0][-1] != "=" and _BREAK.fullmatch(text, x.end(), y.start()) is not None
        for x, y in zip(found[:-1], found[1:], strict=True)
    ]
    # A short last line is found only here, as ENCODED wants 16 characters.
    last = re.compile(r"[A-Za-z0-9+/]++={0,2}+|={1,2}+")
    out, i = [], 0
    while i < len(found):
        j = i
        while j < len(joined) and joined[j] and len(found[j + 1][0]) == len(found[i][0]):
            j += 1
        width, parts, end = len(found[i][0]), [m[0] for m in found[i : j + 1]], found[j].end()
        gap = _BREAK.match(text, end) if parts[-1][-1] != "=" else None
        tail = last.match(text, gap.end()) if gap else None
        tries = [("".join(parts), end)] if width >= 40 or j > i else []
        if tail and len(tail[0].rstrip("=")) <= width:
            tries.insert(0, ("".join(parts) + tail[0], tail.end()))
        for value, stop in tries:
            # Padding that goes on is none.
            data = None if text[stop : stop + 1] == "=" else _decode64(value)
            if data and is_key(data):
                out.append((found[i].start(), 4, stop))
                break
        else:
            for m in found[i : j + 1] if j > i else ():
                data = _decode64(m[0]) if len(m[0]) >= 40 and text[m.end() : m.end() + 1] != "=" else None
                if data and is_key(data):
                    out.append((m.start(), 4, m.end()))
        i = j + 1
    for m in BARE_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            out.append((m.start(), 4, m.end()))
    return out


def _key_blocks(text: str) -> list[tuple[int, int, int]]:
    """Blocks between a BEGIN line and the next END line of the same name, without another BEGIN between: header lines
    (as of encrypted keys), then base64 that is a key. Ciphertext of the old form has no structure, but its headers."""
    begins, ends = list(BEGIN.finditer(text)), list(END.finditer(text))
    stops, out = [m.start() for m in ends], []
    for i, m in enumerate(begins):
        k = bisect_left(stops, m.end())
        if k == len(ends) or (i + 1 < len(begins) and begins[i + 1].start() < stops[k]) or ends[k][1] != m[1]:
            continue
        lines = _ESCAPED.sub("\n", text[m.end() : stops[k]]).splitlines()
        at, legacy = 0, set()
        while at < len(lines) and (not lines[at].strip() or HEADER.fullmatch(lines[at])):
            legacy |= {"type"} if lines[at].startswith("Proc-Type:") and "ENCRYPTED" in lines[at] else set()
            legacy |= {"info"} if lines[at].startswith("DEK-Info:") else set()
            at += 1
        data = _decode64("".join("".join(lines[at:]).split()))
        if data and (is_key(data) or len(legacy) == 2):
            out.append((m.start(), 5, ends[k].end()))
    return out


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates that decode and parse: signed tokens, bare keys in base64 or hex, private key blocks. A block is the
    key: its lines are no bare key beside it."""
    blocks = _key_blocks(text)
    starts = [a for a, _, _ in blocks]

    def inside(a: int, b: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k >= 0 and b <= blocks[k][2]

    bare = [x for x in _bare_keys(text) if not inside(x[0], x[2])]
    return sorted({*_signed_tokens(text), *bare, *blocks})


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: the carried columns, n_assign, n_access, n_hex, n_structural, base_sha256, spans.

    A text is only searched if it holds 16 characters of the encoded kinds in a row, one of the names or the end of a
    key block's first line; every match needs one of these, so the test loses nothing. Spans are in code points, the end excluded. Null is empty: no spans, and
    the digest of the empty string. Repeated rows are searched each; an empty table gives an empty one.
    """
    names = ("n_assign", "n_access", "n_hex", "n_structural", "base_sha256", "spans")
    nothing = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lo, hi, data, bounds in slices(batch.column(batch.num_columns - 1)):
                a, b = runs(_LONG[data], bounds)
                far = np.zeros(hi - lo, bool)
                far[np.searchsorted(bounds, a[b - a >= 16], "right") - 1] = True
                raw = data.tobytes()
                low = raw.lower()
                for d in range(hi - lo):
                    x, y = int(bounds[d]), int(bounds[d + 1])
                    part = low[x:y]
                    if not far[d] and not any(w in part for w in _WORDS):
                        rows.append((0, 0, 0, 0, nothing, ""))
                        continue
                    value = raw[x:y].decode("utf-8", "replace")
                    base, more = base_spans(value), structural_spans(value)
                    n = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((*n, len(more), hashlib.sha256(_told(base).encode()).hexdigest(), _told(sorted(base + more))))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            cells = zip(*rows, strict=True) if rows else ([] for _ in names)
            own = [pa.array(list(c), pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cells)]
            yield pa.RecordBatch.from_arrays([*kept, *own], names=[*carry, *names])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_assign bigint, n_access bigint, n_hex bigint, n_structural bigint, base_sha256 string, spans string"])
    return docs.select(*carry, text).mapInArrow(scan, schema)
