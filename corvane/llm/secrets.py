"""Secret scan: patterns, then structural confirmation of encoded keys and signed tokens.

Pattern spans (assign, access, hex) are reported as they are. Encoded candidates are reported
only when their decoded structure holds: nested lengths that fill each other exactly, the fields
of a private key, or a token header that names its algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import col, put_back, set_apart

#: Kinds in the order that breaks ties of start; the first three come from patterns alone.
KINDS = ["assign", "access", "hex", "pem", "key", "ssh", "jwt"]
BASE_KINDS = KINDS[:3]

#: The patterns of the base kinds.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs of 18 or more
_HEX = re.compile(r"[0-9a-f]{16,}")

_WORDS = ("passw", "secret", "token", "key")
_BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_BLOB = re.compile(r"[0-9A-Fa-f]{60,}")
_PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: Line breaks, also as JSON or source code writes them, and header lines of an armoured key.
_BREAK = re.compile(r"(?:\\r|\\n|\r|\n)+")
_HEADER = re.compile(r"[A-Za-z0-9-]+:")
#: Where encoded private keys begin inside longer runs: a sequence header, then version 0 or 1.
_BLOB_START = re.compile(r"MI[GHIJK]|MC|MH|ME")
_HEX_START = re.compile(r"(?i)30(?:81[0-9a-f]{2}|82[0-9a-f]{4}|[0-7][0-9a-f])0201(?:00|01)")
#: A block of base64 lines without armour.
_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
#: A token begins where a run of its letters does.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill data exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def is_private_key(data: bytes | None) -> bool:
    """Whether bytes are one DER sequence with the fields of a private key.

    Nine integers after each other (version first), or a version with an algorithm and an octet
    string, or a version with an octet string (elliptic curve).
    """
    if not data or data[0] != _SEQUENCE:
        return False
    outer = der_items(data)
    if outer is None or len(outer) != 1:
        return False
    fields = der_items(outer[0][1])
    if not fields or fields[0][0] != _INTEGER or fields[0][1] not in (b"\0", b"\1"):
        return False
    tags = [tag for tag, _ in fields]
    if len(tags) >= 9 and set(tags[:9]) == {_INTEGER} and all(x for _, x in fields[:9]):
        return True
    if len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        algorithm = der_items(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == _OID and len(fields[2][1]) >= 16
    return len(tags) >= 2 and fields[0][1] == b"\1" and tags[1] == _OCTETS and 16 <= len(fields[1][1]) <= 80


def is_locked_key(data: bytes | None) -> bool:
    """Whether bytes are one DER sequence of an algorithm and an octet string, as encrypted keys are."""
    outer = der_items(data) if data else None
    fields = der_items(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == _SEQUENCE else None
    if not fields or [tag for tag, _ in fields] != [_SEQUENCE, _OCTETS]:
        return False
    algorithm = der_items(fields[0][1])
    return bool(algorithm) and algorithm[0][0] == _OID and len(fields[1][1]) >= 16


def _der_length(head: bytes) -> int | None:
    """Bytes of the private key that begins with these bytes, if they can be the begin of one."""
    if len(head) < 2 or head[0] != _SEQUENCE:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if n > 2 or head[2 + n : 4 + n] != b"\x02\x01" or head[4 + n : 5 + n] not in (b"\0", b"\1"):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _keys_in_blob(blob: str) -> list[tuple[str, int, int]]:
    """Keys in a run of base64 letters: the whole run, or what begins inside it and ends by its own length."""
    data = decode_base64(blob)
    if is_private_key(data):
        return [("key", 0, len(blob))]
    if is_ssh_key(data):
        return [("ssh", 0, len(blob))]
    found = []
    for m in _BLOB_START.finditer(blob):
        at = m.start()
        size = _der_length(decode_base64(blob[at : at + 12]) or b"")
        stop = at + -(-size * 4 // 3) if size else 0
        if at < stop <= len(blob.rstrip("=")) and is_private_key(decode_base64(blob[at:stop])):
            found.append(("key", at, stop))
    return found


def _pem_spans(text: str) -> list[tuple[str, int, int]]:
    """Armoured keys whose body holds a key's structure; breaks may be escaped, header lines may come first."""
    found, begin = [], None
    for m in _PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None and begin[2] == m[2]:
            lines = [x.strip() for x in _BREAK.split(text[begin.end() : m.start()])]
            data = decode_base64("".join("".join(x.split()) for x in lines if not _HEADER.match(x)))
            if is_private_key(data) or is_ssh_key(data) or (m[2].startswith("ENCRYPTED") and is_locked_key(data)):
                found.append(("pem", begin.start(), m.end()))
            begin = None
    return found


def is_ssh_key(data: bytes | None) -> bool:
    """Whether bytes are an SSH private key: its magic, then length-prefixed fields to the end."""
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    at, n = len(magic), 0
    for field in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if field < 2 and not 1 <= n <= 64:
            return False
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def is_signed_token(text: str) -> bool:
    """Whether the first part is a JSON object that names an algorithm, and the second one too is an object."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(decode_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and (bool(signature) or header["alg"] == "none")


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in code points, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    armoured = _pem_spans(text) if "PRIVATE KEY-----" in text else []
    found += armoured
    for m in _BLOB.finditer(text):
        found += [(kind, m.start() + a, m.start() + b) for kind, a, b in _keys_in_blob(m[0])]
    for m in _LINES.finditer(text):
        if not any(a <= m.start() < b for _, a, b in armoured) and is_private_key(decode_base64("".join(m[0].split()))):
            found.append(("key", m.start(), m.end()))
    for m in _HEX_BLOB.finditer(text):
        for start in _HEX_START.finditer(m[0]):
            size = _der_length(bytes.fromhex(start[0]))
            stop = start.start() + 2 * (size or 0)
            if size and stop <= len(m[0]) and is_private_key(bytes.fromhex(m[0][start.start() : stop])):
                found.append(("key", m.start() + start.start(), m.start() + stop))
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[1], order[s[0]], s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redact(text: str | None, spans, mark: str) -> str | None:
    """The text with the union of the spans replaced by a mark each."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """Add secrets, an array of (kind, start, end), for each whole text; no shuffle.

    A null or empty text has none; repeated rows stay; the time for a text grows with its length. With
    mark, the text column is kept and each found stretch in it is replaced by the mark; otherwise only
    the keep columns (by default all but the text) stay. An input column named secrets is replaced;
    others may have any names.
    """
    with_text = mark is not None
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() != "secrets" and c != text_col]
    source = docs.select(*set_apart(kept), col(text_col).alias("_text"))
    names = [*source.columns[:-1], *(["_text"] if with_text else []), "secrets"]
    fields = source.schema.fields[:-1] + ([T.StructField("_text", T.StringType())] if with_text else [])
    schema = T.StructType([*fields, T.StructField("secrets", SPANS)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                spans = [find_secrets(t or "") for t in texts]
                arrays = list(part.columns[:-1])
                if with_text:
                    arrays.append(pa.array([redact(t, s, mark) for t, s in zip(texts, spans, strict=True)], pa.string()))
                arrays.append(pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], _ARROW_SPANS))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = source.mapInArrow(run, schema)
    return found.select(*put_back(kept), *([F.col("_text").alias(text_col)] if with_text else []), "secrets")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
