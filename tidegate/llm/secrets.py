"""Secret scans with structural confirmation.

Plain patterns find assignments, access ids and long lower-case hex strings.  Beyond them, base64
and hex candidates (hex digits of either case) are decoded and reported only if the bytes prove a
secret: nested DER lengths that close exactly around a private-key structure, the length-prefixed
fields of an OpenSSH key, or a signed token whose header and payload are JSON objects and name an
algorithm.  An encrypted key is proved by its PEM label with an algorithm and octets that close
exactly, or by PEM headers that name the cipher with a body of whole cipher blocks.

Defined cases: null text is empty and has no spans; offsets are code points, end exclusive;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored
by the scan and kept by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import identified, table
from tidegate.llm.registry import query
from tidegate.llm.spans import SPAN, digest, ordered

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}+")
HEX_KEY = re.compile(r"[0-9A-Fa-f]{24,}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
PEM = re.compile(
    r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----[ \t]*+(?:\r?\n)?((?:[A-Za-z0-9-]++:[^\r\n]*+\r?\n(?:[ \t]++[^\s][^\r\n]*+\r?\n)*+)*+)"
    r"([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----")
CIPHER = re.compile(r"^DEK-Info:[ \t]*(?:[A-Za-z0-9-]+),[ \t]*[0-9A-Fa-f]{16,}", re.M)
LONG = 24  # no candidate lies in a shorter run without white space
SSH_MAGIC = b"openssh-key-v1\0"


def decode(text: str) -> bytes | None:
    """Bytes of a base64 text of either alphabet, padded or not."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def nested(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or not data[at]:
                return None
            size, at = int.from_bytes(data[at:at + n]), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are an encoded private key and nothing else."""
    if data.startswith(SSH_MAGIC):
        return ssh_fields(data)
    outer = nested(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = nested(data, *outer[0][1:])
    if not parts or parts[0][0] != 2:
        return False
    tags, version = [t for t, _, _ in parts], data[parts[0][1]:parts[0][2]]
    if version in (b"\0", b"\1") and len(tags) >= 9 and set(tags[:9]) == {2}:  # RSA: nine integers
        return True
    if version == b"\0" and len(tags) >= 6 and set(tags) == {2}:  # DSA: six
        return True
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 4]:  # wrapped key: algorithm, octets
        algorithm = nested(data, *parts[1][1:])
        return bool(algorithm) and algorithm[0][0] == 6 and parts[2][2] - parts[2][1] >= 16
    return version == b"\1" and len(tags) >= 2 and tags[1] == 4 and parts[1][2] - parts[1][1] >= 16  # elliptic curve


def is_encrypted(data: bytes) -> bool:
    """Whether the bytes are an algorithm with its parameters and octets, and nothing else."""
    outer = nested(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = nested(data, *outer[0][1:])
    if not parts or [t for t, _, _ in parts] != [0x30, 4] or parts[1][2] - parts[1][1] < 16:
        return False
    algorithm = nested(data, *parts[0][1:])
    return bool(algorithm) and algorithm[0][0] == 6


def is_pem(label: str, headers: str, body: str) -> bool:
    """Whether the block holds a private key, plain or encrypted as its label or headers say."""
    data = decode("".join(body.split()))
    if not data:
        return False
    if label.endswith("ENCRYPTED ") and is_encrypted(data):
        return True
    if "ENCRYPTED" in headers and CIPHER.search(headers):  # the whole key is cipher blocks of 8 or 16 bytes
        return len(data) >= 32 and len(data) % 8 == 0
    return is_key(data)


def ssh_fields(data: bytes) -> bool:
    """Cipher, function, options, number of keys, and as many public parts and one private part fill the bytes."""
    at, fields = len(SSH_MAGIC), []
    for k in range(3):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at:at + 4])
        fields.append(data[at + 4:at + 4 + n])
        at += 4 + n
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at:at + 4]), at + 4
    for _ in range(min(keys, 64) + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4])
    return keys >= 1 and at == len(data) and fields[0].isascii() and bool(fields[0])


def is_token(header: str, payload: str) -> bool:
    """Whether both parts are JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(decode(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str) -> tuple[list, list]:
    """(spans of the plain patterns, confirmed spans) of one text."""
    base, more = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if is_pem(m[1], m[2], m[3]):
                more.append(("key", m.start(), m.end()))
    if max(map(len, text.split()), default=0) < LONG:
        return base, more
    for m in HEX.finditer(text):
        base.append(("hex", m.start(), m.end()))
    for m in HEX_KEY.finditer(text):
        if (m.end() - m.start()) % 2 == 0 and m[0].startswith("30") and is_key(bytes.fromhex(m[0])):
            more.append(("key", m.start(), m.end()))
    if text.count(".") >= 2:
        more += [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if m[1][0] == "e" and is_token(m[1], m[2])]
    for m in BLOB.finditer(text):
        if m[0][0] in "Mb":  # the first byte of a DER sequence or of the OpenSSH mark
            data = decode(m[0])
            if data and is_key(data):
                more.append(("key", m.start(), m.end()))
    return base, more


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            base, every = [], []
            for text in batch.column("text").to_pylist():
                plain, more = scan(text)
                base.append(ordered(plain, KINDS))
                every.append(ordered(plain + more, KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    return identified(docs).mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")


def mask(text: str, mark: str = "[SECRET]") -> str:
    """The text with every found span, overlapping ones together, replaced by the mark."""
    base, more = scan(text)
    out, at = [], 0
    for _, start, end in sorted(base + more, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets masked; ``length`` is set anew in the rows that change."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t) for t in texts], dtype=object)

    out = docs.withColumn("__masked", masked(F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("__masked"))
    columns = {"text": F.col("__masked")}
    if length in docs.columns:
        columns[length] = F.when(changed, F.char_length("__masked").cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return out.select([columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


@query("op10_secrets")
def op10_secrets(spark, sf_dir):
    """Secrets of all documents."""
    return digest(find_secrets(table(spark, sf_dir, "documents")), BASE_KINDS)
