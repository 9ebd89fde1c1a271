"""Secret scan with structural confirmation.

Plain patterns give the base findings. Beyond them, base64 and hex candidates
are decoded and reported only if what comes out is built like a secret: a DER
key whose nested lengths add up, an OpenSSH key, a PEM block around either (or
around a PGP secret key whose checksum holds, or around whole cipher blocks
with the header that names them), or a token whose signed header is JSON with
an algorithm. Base64 may be in either alphabet and wrapped over lines, and a
PEM block may have its line breaks escaped as in JSON or .env files.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_batches

#: The patterns of the base findings.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates for decoding.
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]+)*={0,2}")
BASE64_URL = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")

KINDS = ("assign", "access", "hex", "pem", "jwt", "key")
BASE = 3
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length stated at ``at`` and where the content begins."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills ``data`` and whose members, two or more with an INTEGER first or a SEQUENCE, fill it in turn."""
    if len(data) < 24 or data[0] != 0x30 or (top := der_length(data, 1)) is None or sum(top) != len(data):
        return False
    at, tags = top[1], []
    while at < len(data):
        tags.append(data[at])
        if (inner := der_length(data, at + 1)) is None or sum(inner) > len(data):
            return False
        at = sum(inner)
    return len(tags) >= 2 and tags[0] in (0x02, 0x30) and all(t in (0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0xA0, 0xA1) for t in tags)


def is_key(data: bytes) -> bool:
    return data.startswith(b"openssh-key-v1\0") or is_der_key(data)


def unbase64(text: str, alphabet: bytes | None = None) -> bytes:
    body = text.rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=alphabet)
    except (binascii.Error, ValueError):
        return b""


def pgp_checksum(data: bytes) -> int:
    """CRC-24 of the OpenPGP message format."""
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = (crc << 1) ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def is_pgp_key(lines: list[str]) -> bool:
    """Armoured lines whose checksum holds and whose first packet is a secret key."""
    sums = [line for line in lines if line.startswith("=")]
    data = unbase64("".join(line for line in lines if not line.startswith("=")))
    if not data or len(sums) > 1:
        return False
    tag = data[0] & 0x3F if data[0] & 0x40 else (data[0] & 0x3C) >> 2
    return data[0] & 0x80 > 0 and tag == 5 and (not sums or unbase64(sums[0][1:]) == pgp_checksum(data).to_bytes(3, "big"))


def is_pem_key(label: str, body: str) -> bool:
    """Whether what stands between the lines of a PEM block is a key."""
    lines = [line.strip() for line in re.split(r"\\r\\n|\\n|\\r|\s", body.replace(": ", ":")) if line.strip()]
    plain = [line for line in lines if ":" not in line]
    if any(re.search("[^A-Za-z0-9+/=]", line) for line in plain):
        return False
    if label.endswith("BLOCK"):
        return is_pgp_key(plain)
    data = unbase64("".join(plain))
    return is_key(data) or bool(data) and len(data) % 8 == 0 and CIPHER.search(body) is not None


def wrapped_key(run: str) -> int:
    """Characters of a run of base64 lines that a key at its beginning takes, 0 where there is none."""
    bare = re.sub(r"\s", "", run)
    head = unbase64(bare[:16])
    if is_key(unbase64(bare)):
        return len(run)
    if head[:1] != b"\x30" or (top := der_length(head, 1)) is None or not is_key(unbase64(bare[: -(-sum(top) * 4 // 3)])[: sum(top)]):
        return 0
    left = -(-sum(top) // 3) * 4
    ends = [i + 1 for i, c in enumerate(run) if not c.isspace()]
    return ends[min(left, len(ends)) - 1]


def is_token_header(text: str) -> bool:
    try:
        head = json.loads(unbase64(text, b"-_"))
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of the base findings."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of what decodes into the structure of a secret."""
    found = []
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text) if is_pem_key(m[1], m[2])]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if is_token_header(m[1])]
    for m in BASE64.finditer(text):
        if taken := wrapped_key(m[0]):
            found.append((m.start(), 5, m.start() + taken))
    for m in BASE64_URL.finditer(text):
        if ("-" in m[0] or "_" in m[0]) and is_key(unbase64(m[0], b"-_")):
            found.append((m.start(), 5, m.end()))
    for m in HEX_ANY.finditer(text):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            found.append((m.start(), 5, m.end()))
    return found


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: kind, start and end (code points, end exclusive), by start, then kind.

    Null counts as empty and has none; texts may be of any length; repeated
    rows get the same findings; an empty table gives an empty one; a column
    named secrets is replaced. Kinds: assign, access, hex (base), pem,
    jwt, key (confirmed by structure).
    """
    docs = docs.drop("secrets")

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(text_col).to_pylist():
                spans = sorted(base_spans(text) + confirmed_spans(text)) if text else []
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(ARROW_SPAN))], names=[*batch.schema.names, "secrets"])

    return in_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField("secrets", T.ArrayType(SPAN))]))
