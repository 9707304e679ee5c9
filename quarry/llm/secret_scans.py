"""Secret scans: pattern candidates, reported beyond the base patterns only after
their structure is confirmed by decoding and parsing."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from quarry.llm.shared import per_text

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----", re.ASCII)
#: A key in DER starts with byte 0x30 and so with M in base64; OpenSSH's magic gives b3BlbnNzaC1rZXkt.
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/]{30,}|b3BlbnNzaC1rZXkt[A-Za-z0-9+/]+)={0,2}")
HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){23,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
SSH_MAGIC = b"openssh-key-v1\0"

SEQUENCE, INTEGER, OCTETS = 0x30, 0x02, 0x04


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def values(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[start:end] exactly."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_key_der(data: bytes) -> bool:
    """Whether data is a DER private key: a sequence that fills it, a small version
    number, then RSA's integers, a PKCS 8 algorithm and octets, or an EC octet string."""
    top = values(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    inside = values(data, top[0][1], top[0][2])
    if not inside or len(inside) < 2 or inside[0][0] != INTEGER or inside[0][2] - inside[0][1] != 1:
        return False
    tags = [t for t, _, _ in inside]
    if len(tags) >= 6 and all(t == INTEGER for t in tags[:6]):
        return True
    if len(tags) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:
        return bool(values(data, inside[1][1], inside[1][2]))
    return tags[1] == OCTETS and inside[1][2] - inside[1][1] >= 16


def is_key_ssh(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: magic, cipher, kdf and options as
    length-prefixed strings, the number of keys, and a public key that fits."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for k in range(5):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return False
        if k == 3:
            if not 1 <= n <= 16:
                return False
            at += 4
            continue
        if at + 4 + n > len(data) or (k == 4 and n < 8):
            return False
        at += 4 + n
    return True


def is_token(header: str, payload: str) -> bool:
    """Whether both parts are JSON objects and the header names an algorithm."""
    try:
        head, body = json.loads(decode64(header) or b""), json.loads(decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6],
        "access": [m.span() for m in ACCESS.finditer(text)],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def confirmed_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of keys and signed tokens whose decoded structure is right."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS if k not in BASE_KINDS}
    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            data = decode64(re.sub(r"\\[nr]|\s", "", m[2]))
            if data and (is_key_der(data) or is_key_ssh(data) or (m[1].startswith("ENCRYPTED") and values(data, 0, len(data)))):
                out["pem"].append(m.span())
    for m in BLOB.finditer(text):
        data = decode64(m[0])
        if data and is_key_ssh(data):
            out["openssh"].append(m.span())
        elif data and is_key_der(data):
            out["der"].append(m.span())
    out["der"] += [m.span() for m in HEX_BLOB.finditer(text) if is_key_der(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        out["jwt"] = [m.span() for m in JWT.finditer(text) if is_token(m[1], m[2])]
    return out


def listed(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed in KINDS."""
    found = sorted((s, KINDS.index(k), e) for k, own in spans.items() for s, e in own)
    return [(s, e, KINDS[k]) for s, k, e in found]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, *, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and found: array<struct<kind, start, end, base>> of every row,
    in code points, by start and then kind; base_sha256 of the base spans.

    A null or empty text has no spans; repeated rows each give a row; an empty
    table gives none; columns not in keep are left out, so names cannot clash.
    """

    def make():
        def run(texts: list[str]) -> dict:
            found, digest = [], []
            for t in texts:
                base = base_spans(t)
                every = listed(base | confirmed_spans(t))
                found.append([{"kind": k, "start": s, "end": e, "base": k in BASE_KINDS} for s, e, k in every])
                digest.append(hashlib.sha256(joined(listed(base)).encode()).hexdigest())
            return {"found": found, "base_sha256": digest}

        return run

    return per_text(docs, list(keep), text, make, "found array<struct<kind:string,start:long,end:long,base:boolean>>, base_sha256 string")


def redacted(text: str, mark: str) -> str:
    """text with the union of its spans replaced by mark."""
    out, at = [], 0
    for s, e, _ in listed(base_spans(text) | confirmed_spans(text)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, keep: list[str] = ("doc_id",), text: str = "text", mark: str = "[secret]") -> DataFrame:
    """keep columns and text with every secret replaced by mark, of every row; null
    texts become empty, texts without secrets stay as they are."""

    def make():
        return lambda texts: {"text": [redacted(t, mark) for t in texts]}

    return per_text(docs, list(keep), text, make, "text string")
