"""Secret scans with structural confirmation.

Three plain patterns (assignments, access keys, long hex runs) give the base
spans. Beyond them, candidates that may hold a key or a token are decoded and
their structure is parsed before anything is reported:

- ``der``: base64 or hex of a DER private key. Base64 may begin at the start of
  any line of a run and ends where the outer length ends; hex must have that
  length. Lengths must nest, and the fields must be those of a PKCS#1, PKCS#8 or
  SEC1 key.
- ``openssh``: base64 of ``openssh-key-v1`` with nested length-prefixed fields.
- ``jwt``: three parts of base64url, of which the first decodes to a JSON header
  that names an algorithm, and the second to a JSON object.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.words import slices

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: How base64 of a private key begins: a DER sequence, or the magic word of OpenSSH. What stands between the lines of base64: they may be indented, and their ends may be escaped. Hex of either case.
_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
_LINE = re.compile(r"[A-Za-z0-9+/]+")
_BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*")
#: Fewest characters of base64, which are under those of any key.
LEAST_BASE64 = 40
_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-fA-F]{2}){32,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def _base64(text: str, urlsafe: bool = False) -> bytes | None:
    text = re.sub(r"\s|=", "", text)
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the value at a place; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        count = length & 0x7F
        if not 1 <= count <= 4 or at + count > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + count], "big"), at + count
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _der_fields(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while begin < end:
        field = _der(data, begin, end)
        if field is None:
            return None
        out.append(field)
        begin = field[2]
    return out


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key, from the first to the last."""
    outer = _der(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    fields = _der_fields(data, outer[1], outer[2])
    if not fields or fields[0][0] != 0x02 or fields[0][2] - fields[0][1] != 1:
        return False
    version, tags = data[fields[0][1]], [f[0] for f in fields]
    if version in (0, 1) and len(tags) >= 9 and set(tags[1:9]) == {0x02}:
        return True  # PKCS#1: modulus, exponents, primes, coefficients
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        inner = _der_fields(data, fields[1][1], fields[1][2])
        return bool(inner) and inner[0][0] == 0x06  # PKCS#8: an algorithm, then the key
    return version == 1 and len(tags) > 1 and tags[1] == 0x04 and fields[1][2] - fields[1][1] >= 20 and all(t in (0xA0, 0xA1) for t in tags[2:])


def openssh_key_end(data: bytes) -> int | None:
    """Where an OpenSSH private key ends that the bytes begin with: cipher, kdf, options, a count, public keys, private part. None if there is none."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(field() is None for _ in range(3)):
        return None
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return at if 1 <= count <= 16 and all(field() for _ in range(count + 1)) else None


def _gather(text: str, at: int, wanted: int) -> tuple[str, int]:
    """The next characters of base64 without what stands between lines, as many as are there, and where they end."""
    parts, end = [], at
    while wanted and (m := _LINE.match(text, at, at + wanted)):
        parts.append(m[0])
        wanted, end = wanted - len(m[0]), m.end()
        gap = _BREAK.match(text, end)
        if not gap:
            break
        at = gap.end()
    return "".join(parts), end


def _key_at(text: str, at: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of the private key whose base64 begins at a place."""
    if text[at] == "M":
        head = _base64(_gather(text, at, 16)[0]) or b""
        outer = _der(head, 0, 1 << 40) if len(head) == 12 else None
        if outer is None or head[outer[1] : outer[1] + 2] != b"\x02\x01":
            return None
        kind, size = "der", outer[2]
    else:
        kind, size, wanted = "openssh", None, 4096
        while size is None:  # its length is known only when all its fields are
            run, _ = _gather(text, at, wanted)
            size = openssh_key_end(_base64(run[: len(run) - (len(run) % 4 == 1)]) or b"")
            if size is None and len(run) < wanted:
                return None
            wanted *= 4
    count = (4 * size + 2) // 3
    run, end = _gather(text, at, count)
    if len(run) < max(count, LEAST_BASE64) or kind == "der" and not is_private_key(_base64(run) or b""):
        return None
    pad = -count % 4
    return kind, at, end + (pad if text[end : end + pad] == "=" * pad else 0)


def _base64_keys(text: str) -> Iterator[tuple[str, int, int]]:
    done = 0
    for m in _START.finditer(text):
        at = m.start()
        if at >= done and (not at or not _LINE.match(text, at - 1, at) or text[max(0, at - 2) : at] == "\\n"):
            key = _key_at(text, at)
            if key:
                yield key
                done = key[2]


def is_signed_token(text: str) -> bool:
    """Whether the text is a JWT by its header and claims."""
    parts = [_base64(x, urlsafe=True) for x in text.split(".")]
    try:
        header, claims = (json.loads(x) for x in parts[:2] if x is not None)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and parts[2] is not None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    out += _base64_keys(text)
    out += [("der", *m.span()) for m in _HEX.finditer(text) if is_private_key(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()})
    for rows in slices(batches, "text"):
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t or "")] for t in rows.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (kind, start, end; code points, end exclusive) for every row of ``docs`` (doc_id, text).

    Null is an empty text, which has no spans, and all of a long text is looked
    at; spans of one start stand in the order of ``KINDS``. Rows repeat as they
    do, an empty table gives an empty one; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op1_structural_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(*KINDS[3:]).alias("n_confirmed"))


QUERIES: dict[str, Callable] = {"op1_structural_secrets": op1_structural_secrets}
