"""Secret scan whose encoded candidates are confirmed by decoding them.

Base kinds are patterns: ``assign`` (a named value of 8 characters or more), ``access`` (AKIA..., 16 or more) and
``hex`` (32 digits or more).  Confirmed kinds are reported only when their structure holds: a ``jwt`` has
a header that decodes to a JSON object with an algorithm, a payload that decodes to an object, and a
signature; a ``key`` is base64 (with or without PEM lines, on one line or wrapped, line breaks also as escapes) or
hexadecimal text that decodes to a private key, i.e.
nested lengths that fill their parents exactly and hold the fields of PKCS#1, SEC 1, PKCS#8 or the
OpenSSH container.  Anything else that merely looks encoded is not added.

Spans count code points, end exclusive, and cover the whole match.  Nulls: a NULL text is empty.  Every row is
scanned on its own and whole; equal rows get equal spans.  An empty table gives an empty table.
"""
from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Collection

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from seasonlens.llm.store import map_texts, set_aside

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "key", "jwe")
_FLAGS = re.IGNORECASE | re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a whole run: the match starts where the run does
#: Any three parts as long as the shortest header with an algorithm, payload and signature; what they decode to decides.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)\.([A-Za-z0-9_-]{3,}+)\.([A-Za-z0-9_-]{22,}+)(?!\.[A-Za-z0-9_-])")
#: Five parts: header, wrapped key (may be empty), vector, content, tag.
_JWE = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{14,}+)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]{16,22}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]{22,}+)(?!\.[A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?:[\s>]|\\+[nr])*+[A-Z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+)"
                  r"((?:[A-Za-z0-9+/=\s>]|\\+[nrt/])++)-----END \1-----")
_UNPEM = re.compile(r"\\+[nrt]|\\+(?=/)|[\s>]+")
_SEALED = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])")
_BASE64URL = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{56,}+={0,2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{56,}={0,2}")
_BREAK = r"[ \t]*+(?:\r\n?|\n|(?:\\+r)?\\+n)[ \t]*+"
#: Lines of base64; where a key begins and ends among them, its own lengths tell.
_WRAPPED = re.compile(rf"[A-Za-z0-9+/]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/]++)++={{0,2}}")
_LINE = re.compile(rf"([A-Za-z0-9+/]+)={{0,2}}(?:{_BREAK})?")
_HEXKEY = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{2}}(?::?+(?:{_BREAK})?+[0-9A-Fa-f]{{2}}){{47,}}+(?![0-9A-Fa-f])")
_DIGIT = re.compile(r"[0-9A-Fa-f]")
#: What every match of a pattern holds, for Arrow's linear-time matcher: one pass of it over a batch is many times faster than a search
#: by ``re``, and leaves few texts to search.
_ANY_BREAK = _BREAK.replace("*+", "*")
HINTS = {
    "assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{32}",
    "parts": r"[A-Za-z0-9_-]{14}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{16}", "pem": "PRIVATE KEY-----",
    "run": "[A-Za-z0-9+/_-]{56}",
    "hexkey": rf"(?:[0-9A-Fa-f]{{2}}:?(?:{_ANY_BREAK})?){{15}}[0-9A-Fa-f]{{2}}", "wrapped": rf"[A-Za-z0-9+/]{{16}}{_ANY_BREAK}[A-Za-z0-9+/]",
}
_SSH = b"openssh-key-v1\0"
# Object identifiers (DER) of the password-based encryption schemes of PKCS#5 and PKCS#12 begin so.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _elements(b: bytes) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill b exactly, or None."""
    out, i = [], 0
    while i < len(b):
        if i + 2 > len(b):
            return None
        tag, n = b[i], b[i + 1]
        i += 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or i + size > len(b):
                return None
            n = int.from_bytes(b[i:i + size], "big")
            i += size
        if i + n > len(b):
            return None
        out.append((tag, b[i:i + n]))
        i += n
    return out


def is_private_key(b: bytes) -> bool:
    """DER (PKCS#1, DSA, SEC 1, PKCS#8) or an OpenSSH container, by nested lengths and fields."""
    if b.startswith(_SSH):
        return _is_openssh(b[len(_SSH):])
    top = _elements(b)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    body = _elements(top[0][1])
    if not body or len(body) < 2:
        return False
    if [t for t, _ in body] == [0x30, 0x04]:  # encrypted PKCS#8: a scheme with its parameters, whole cipher blocks
        scheme = _elements(body[0][1])
        return (bool(scheme) and [t for t, _ in scheme] == [0x06, 0x30] and scheme[0][1].startswith(_PBE)
                and bool(_elements(scheme[1][1])) and len(body[1][1]) >= 32 and len(body[1][1]) % 8 == 0)
    if body[0][0] != 0x02:
        return False
    version, tags = int.from_bytes(body[0][1], "big"), [t for t, _ in body]
    if version == 0 and len(body) >= 9 and tags[:9] == [0x02] * 9:
        return True  # PKCS#1: nine integers
    if version == 0 and tags == [0x02] * 6:  # DSA: p, q, g, y, x; the exponent is below q, the others below p
        p, q, g, y, x = (int.from_bytes(v, "big") for _, v in body[1:])
        return p >> 511 > 0 and q >> 159 > 0 and 0 < x < q < p and 1 < g < p and 1 < y < p and (p - 1) % q == 0
    if version == 1 and tags[1] == 0x04 and 16 <= len(body[1][1]) <= 96 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return True  # SEC 1: the scalar, then optional parameters
    if version in (0, 1) and tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:
        algorithm = _elements(body[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and _elements(body[2][1]) is not None  # PKCS#8
    return False


def _is_openssh(b: bytes) -> bool:
    return _openssh_end(b) == len(b)


def _openssh_end(b: bytes) -> int:
    """Where the container that b begins with ends, or -1."""
    fields, i = [], 0
    for _ in range(3):  # cipher, key derivation, its options
        n = int.from_bytes(b[i:i + 4], "big")
        if i + 4 + n > len(b):
            return -1
        fields.append(b[i + 4:i + 4 + n])
        i += 4 + n
    count = int.from_bytes(b[i:i + 4], "big")
    i += 4
    if not 1 <= count <= 16 or not fields[0].isascii():
        return -1
    for _ in range(count + 1):  # public keys, then the private part
        n = int.from_bytes(b[i:i + 4], "big")
        if n == 0 or i + 4 + n > len(b):
            return -1
        i += 4 + n
    return i


def _decode64(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(s + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    raw = _decode64(part, url=True)
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _key_bytes(b: bytes) -> int:
    """How many bytes the private key that b may begin with states to have, or 0."""
    if b.startswith(_SSH):
        end = _openssh_end(b[len(_SSH):])
        return len(_SSH) + end if end > 0 else 0
    if len(b) < 6 or b[0] != 0x30:
        return 0
    size = b[1] & 0x7F if b[1] >= 0x80 else 0
    if size > 4 or b[1] == 0x80 or b[2 + size:3 + size] not in (b"\x02", b"\x30"):  # the version or a scheme follows
        return 0
    return 2 + size + (int.from_bytes(b[2:2 + size], "big") if size else b[1])


def _wrapped_keys(t: str):
    """(start, end) of private keys in base64 over several lines."""
    for m in _WRAPPED.finditer(t):
        lines = [(x.start(1), x.end(1), x.end(1) + len(x[0][len(x[1]):]) - len(x[0][len(x[1]):].lstrip("="))) for x in _LINE.finditer(t, m.start(), m.end())]
        upto = [0]
        for a, b, _ in lines:
            upto.append(upto[-1] + b - a)
        whole, i = "".join(t[a:b] for a, b, _ in lines), 0
        while i < len(lines):
            at, stop = upto[i], i
            head = _decode64(whole[at:at + 24])
            if head and (head[0] == 0x30 or head.startswith(_SSH)):
                n = _key_bytes(head if head[0] == 0x30 else _decode64(whole[at:len(whole) - ((len(whole) - at) % 4 == 1)]) or b"")
                end = at - (-4 * n // 3)
                stop = bisect.bisect_left(upto, end, i + 1) if n > 0 else i
                if stop > i and stop < len(upto) and upto[stop] == end and is_private_key(_decode64(whole[at:end]) or b""):
                    yield lines[i][0], lines[stop - 1][2]
                else:
                    stop = i
            i = max(stop, i + 1)


def _hex_keys(t: str):
    """(start, end) of private keys in hexadecimal text, from the start of a line to where their lengths end."""
    for m in _HEXKEY.finditer(t):
        at = [x.start() for x in _DIGIT.finditer(t, m.start(), m.end())]
        value = lambda a, b: bytes.fromhex("".join(t[j] for j in at[a:b]))
        # a line begins, or a key ends, where more than a colon stands between two digits
        breaks = {j for j in range(1, len(at)) if at[j] - at[j - 1] > 1 and t[at[j - 1] + 1:at[j]] != ":"} | {0, len(at)}
        done = 0
        for i in sorted(breaks):
            if i < done or i + 96 > len(at) or (t[at[i]] + t[at[i + 1]]).lower() not in ("30", "6f"):
                continue
            n = _key_bytes(value(i, i + 16) if t[at[i]] == "3" else value(i, len(at) - (len(at) - i) % 2))
            if n and i + 2 * n in breaks and is_private_key(value(i, i + 2 * n)):
                done = i + 2 * n
                yield at[i], at[done - 1] + 1


def _sealed(head: str, raw: bytes) -> bool:
    """An encrypted PEM body: its header names a vector, and it is whole blocks of the vector's length."""
    m = _SEALED.search(head)
    return bool(m) and "ENCRYPTED" in head and len(raw) >= 48 and len(raw) % (len(m[1]) // 2) == 0


def hints(texts: pa.Array) -> list[set[str]]:
    """The ``HINTS`` that each text holds; a NULL holds none."""
    held = [pc.fill_null(pc.match_substring_regex(texts, rx), False).to_pylist() for rx in HINTS.values()]
    return [{name for name, yes in zip(HINTS, row) if yes} for row in zip(*held)]


def scan_text(t: str, held: Collection[str] = tuple(HINTS)) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text, by start, then kind in the order of KINDS.  Only patterns whose hint is ``held`` are searched."""
    out = []
    if "assign" in held:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
    if "access" in held:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(t) if m.end() - m.start() >= 16]
    if "hex" in held:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(t)]
    if "parts" in held:
        out += _tokens(t)
    taken = []
    if "pem" in held:
        for m in _PEM.finditer(t):
            raw = _decode64(_UNPEM.sub("", m[3]))
            if raw and (is_private_key(raw) or _sealed(m[2], raw)):
                taken.append((m.start(), m.end()))
    for rx, url in ((_BASE64, False), (_BASE64URL, True)) if "run" in held else ():
        for m in rx.finditer(t):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            raw = _decode64(m[0], url)
            if raw and is_private_key(raw):
                taken.append((m.start(), m.end()))
    for hint, keys in (("hexkey", _hex_keys), ("wrapped", _wrapped_keys)):
        if hint in held:
            taken += [s for s in keys(t) if not any(s[0] < b and a < s[1] for a, b in taken)]
    out += [(a, b, "key") for a, b in taken]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _tokens(t: str):
    """(start, end, kind) of signed and encrypted tokens."""
    for m in _JWT.finditer(t):
        head = _object(m[1])
        if head is not None and isinstance(head.get("alg"), str) and _object(m[2]) is not None and (len(_decode64(m[3], url=True) or b"") >= 16):
            yield m.start(), m.end(), "jwt"
    for m in _JWE.finditer(t):
        head, size = _object(m[1]), [len(_decode64(m[i], url=True) or b"") for i in (3, 5)]
        if head is not None and isinstance(head.get("alg"), str) and isinstance(head.get("enc"), str) and size[0] in (12, 16) and size[1] in (16, 24, 32):
            yield m.start(), m.end(), "jwe"


ADDED = ("secrets",)
NAMES = ADDED
_SECRET = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``secrets``: kind, start and end of each span."""
    docs = set_aside(docs, NAMES)
    at = docs.columns.index(text)

    def scan(batches):
        for batch in batches:
            texts = batch.column(at)
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan_text(texts[i].as_py(), held)] if held else []
                     for i, held in enumerate(hints(texts))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "secrets"])

    return map_texts(docs, scan, T.StructType([*docs.schema.fields, T.StructField("secrets", _SECRET)]))
