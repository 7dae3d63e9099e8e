"""Secrets in texts, with structural confirmation of keys and signed tokens.

Base spans follow three patterns.  The method adds spans whose content has
been decoded and parsed, so that a long random-looking word is not enough:

  pem      an armoured private key whose base64 body parses as one, or a body of
           whole cipher blocks under a header that names its cipher
  key      a base64 or hex stretch that decodes to a private key: DER (PKCS#1,
           PKCS#8, encrypted PKCS#8, SEC 1) with every nested length exact, or
           the length-prefixed fields of an OpenSSH key.  Hex digits are of
           either case; base64 may be the url-safe one and wrapped in lines, of
           which those that the key's own length asks for are taken
  token    three dot-separated base64url parts whose first decodes to a JSON
           object with an "alg" text and whose second decodes to a JSON object

Spans are in code points, the end exclusive.

Cases: null and empty texts have no span; matches of one kind do not overlap,
those of different kinds may, and at one start they are listed as KINDS are;
rows that repeat are reported each; other columns, whatever their names, are
ignored.  Whole texts are searched, in one pass without a shuffle.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "pem", "key", "token")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
HEXES = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}"
PEM = r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:\s*[A-Za-z-]+:[^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----"
#: Base64 of what begins with a DER sequence or with the name of the OpenSSH format, and what may follow in further lines.
BASE64 = r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{14,}"
LINES = re.compile(r"[A-Za-z0-9+/_-]+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
MOST_CHARS = 96 << 10  #: no kind of private key takes more, wrapped and in base64
#: Base64 of what begins with a brace, twice, and a signature.
TOKEN = r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{6,})\.(e[w-z0-9_-][A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*"
ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
#: Object identifiers under which password-based encryption schemes stand (PKCS#5, PKCS#12).
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The elements (tag, content or elements) between two places, or None
    unless every nested length fits its container exactly."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def _der_key(data: bytes) -> int | None:
    """The bytes of the DER key at the beginning of data."""
    if data[:1] != b"\x30" or len(data) < 4:
        return None
    wide = data[1] & 0x7F if data[1] & 0x80 else 0
    size = 2 + wide + (int.from_bytes(data[2 : 2 + wide], "big") if wide else data[1])
    top = der(data[:size]) if wide <= 4 and 16 <= size <= len(data) else None
    if not top or len(top) != 1 or len(top[0][1]) < 2:
        return None
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        method = parts[0][1]
        known = bool(method) and method[0][0] == 0x06 and method[0][1].startswith(ENCRYPTIONS)
        return size if known and len(parts[1][1]) >= 16 else None
    if tags[0] != 0x02 or len(parts[0][1]) != 1:
        return None
    if len(parts) >= 9 and set(tags) <= {0x02, 0x30}:  # PKCS#1: version and eight numbers
        good = all(len(x) for t, x in parts if t == 0x02)
    elif len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:  # PKCS#8
        good = bool(parts[1][1]) and parts[1][1][0][0] == 0x06
    else:  # SEC 1
        good = parts[0][1] == b"\x01" and tags[1] == 0x04 and 16 <= len(parts[1][1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}
    return size if good else None


def _openssh_key(data: bytes) -> int | None:
    """The bytes of the OpenSSH key at the beginning of data."""
    if not data.startswith(b"openssh-key-v1\x00"):
        return None
    at, fields = 15, []
    for k in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return None
        fields.append(data[at - n : at])
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not fields[0] or not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def key_size(data: bytes) -> int | None:
    """How many bytes the private key takes with which data begins, if one does."""
    return _openssh_key(data) or _der_key(data)


def is_key(data: bytes) -> bool:
    return key_size(data) == len(data)


def _key_end(text: str, start: int) -> int | None:
    """Where the base64 of a key that begins at start ends, if it ends with a line or stretch."""
    found = LINES.match(text[start : start + MOST_CHARS])[0]
    places = [i for i, c in enumerate(found) if c in ALPHABET]
    body = "".join(found[i] for i in places).replace("-", "+").replace("_", "/")
    raw = _base64(body[:-1] if len(body) % 4 == 1 else body)
    size = key_size(raw) if raw else None
    if not size or -(-size * 4 // 3) > len(places):
        return None
    last = start + places[-(-size * 4 // 3) - 1] + 1
    after = text[last : last + 2]
    if after[:1] in ALPHABET:
        return None
    return last + len(after) - len(after.lstrip("="))


def _ciphered(headers: str, raw: bytes) -> bool:
    """Whether legacy headers name a cipher and its initial value, and the body is whole blocks."""
    named = re.search(r"DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s", headers)
    return bool(named) and len(named[2]) in (16, 32) and len(raw) >= 16 and len(raw) % (len(named[2]) // 2) == 0


def _base64(text: str) -> bytes | None:
    body = text.rstrip("=")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _json_object(text: str) -> dict | None:
    raw = _base64(text.replace("-", "+").replace("_", "/"))
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def is_token(head: str, body: str) -> bool:
    got = _json_object(head)
    return got is not None and isinstance(got.get("alg"), str) and _json_object(body) is not None


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    if not text:
        return []
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    for m in re.finditer(HEXES, text):
        if (m.end() - m.start()) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            found.append((m.start(), 4, m.end()))
    armoured = []
    if "PRIVATE KEY-----" in text:
        for m in re.finditer(PEM, text):
            raw = _base64("".join(m[3].split()))
            if raw and (is_key(raw) or _ciphered(m[2], raw)):
                armoured.append((m.start(), 3, m.end()))
        found += armoured
    upto, begins = 0, [a for a, _, _ in armoured]
    for m in re.finditer(BASE64, text):
        before = bisect.bisect_right(begins, m.start()) - 1
        if m.start() >= upto and (before < 0 or armoured[before][2] <= m.start()):
            end = _key_end(text, m.start())
            if end:
                found.append((m.start(), 4, end))
                upto = end
    found += [(m.start(), 5, m.end()) for m in re.finditer(TOKEN, text) if is_token(m[1], m[2])]
    return sorted(set(found))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end) rows of documents (doc_id, text) as a list per document."""

    def found(texts):
        return ([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans(t)] for t in texts],)

    added = "found array<struct<start: long, kind: string, end: long>>"
    return _shared.with_columns(docs.select(F.col("doc_id").cast("long"), "text"), "text", found, added, ["doc_id"])


def digest(texts: list[str]) -> str:
    return hashlib.sha256(",".join(texts).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_shared.table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    named = lambda spans: F.array_join(F.transform(spans, one), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:3]))
    base_sha256 = F.sha2(named(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[count(kind) for kind in KINDS[:3]], base_sha256, named(F.col("found")).alias("spans"))
