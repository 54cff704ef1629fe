"""Secret scans with structural confirmation.

Plain patterns find assignments, access keys and long hex runs. The method adds
what patterns alone cannot tell: every base64 or hex run is decoded and parsed,
and is reported only if its structure holds. That is a DER private key whose
nested lengths fit to the last byte (PKCS#1, DSA, PKCS#8 plain or encrypted, SEC 1),
an OpenSSH key whose length-prefixed fields all fit, or a signed token whose
header and payload are JSON objects and whose header names an algorithm. A run is
decoded in each of its alignments, so a key may begin at any of its characters;
runs may go over lines, and a key ends where its own length says. An encrypted
PEM block is reported if its headers name a cipher and its bytes fill that
cipher's blocks. What is decoded to text is searched in the same way, however
deep: each level is shorter.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The patterns of the three base kinds, in their order in a tie.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of less than the least length can't hold a longer match, so the least length stands in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\x00-\x7f])+)-----END \1-----")
ESCAPED = re.compile(r"\\+[rnt]")  # a line end written out, as in JSON
HEADER = re.compile(r"^[ \t]*[A-Za-z][A-Za-z0-9-]*:.*(?:\n[ \t]+\S.*:.*)*$", re.MULTILINE)
CIPHER = re.compile(r"^[ \t]*DEK-Info:[ \t]*[A-Za-z0-9-]+,[ \t]*((?:[0-9A-Fa-f]{2})+)[ \t]*$", re.MULTILINE)
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
SIGN = re.compile(r"[+/_-](?=[A-Za-z0-9])")
ASCII = re.compile(rb"[\x00-\x7f]*")
HEXED = re.compile(r"[0-9a-fA-F]{48,}")
#: How a key may begin: a sequence whose first member is a small number, or a sequence that begins with an object's name; or OpenSSH's mark.
KEY = re.compile(rb"\x30(?:[\x10-\x7f]|\x81.|\x82..|\x83...)(?:\x02\x01[\x00\x01]|\x30(?:[\x08-\x7f]|\x81.)\x06)|openssh-key-v1\0", re.DOTALL)
# What the names of password-based ciphers begin with (PKCS#5 and PKCS#12).
CIPHERS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
KINDS = ("assign", "access", "hex", "signed_token", "private_key", "encoded_key", "hex_key")
MOST_VALUES = 16
MARKS = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
MAGIC = b"openssh-key-v1\0"
SCAN = "spans array<struct<kind:string,start:bigint,end:bigint>>"


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """The tag, and where the content begins and ends, of the DER value at `at`; None unless its length fits before `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill `data[at:end]` to the last byte; None if they don't, or are more than a key has."""
    out = []
    while at < end:
        if len(out) == MOST_VALUES or (one := der(data, at, end)) is None:
            return None
        out.append(one)
        at = one[2]
    return out


def is_der_key(data: bytes) -> bool:
    top = der(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = der_children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:  # encrypted: the cipher's name and parameters, and bytes that fill its blocks
        inner = der_children(data, parts[0][1], parts[0][2])
        size = parts[1][2] - parts[1][1]
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(CIPHERS) and size >= 16 and size % 8 == 0
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    if version in (0, 1) and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return True  # RSA: version, modulus, exponents, primes and their remainders
    if version == 0 and tags == [0x02] * 6:
        return True  # DSA: version, two primes, the generator, and the public and private numbers
    if version in (0, 1) and len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:
        inner = der_children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and parts[2][2] > parts[2][1]
    return version == 1 and len(parts) >= 2 and tags[1] == 0x04 and 20 <= parts[1][2] - parts[1][1] <= 66  # elliptic curve


def fields(data: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """`n` fields from `at` on, each after its length in four bytes, and where they end; None unless they fit."""
    out = []
    for _ in range(n):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out.append(data[at + 4 : end])
        at = end
    return out, at


def ssh_size(data: bytes, at: int = 0) -> int:
    """The size of the OpenSSH key at `at`; 0 unless all of its fields fit.

    A cipher, a key derivation and its options; from 1 to 99 public keys, each beginning with its kind; and the private
    part. If there is no cipher, that begins with one number twice and the first key's kind, and ends in 1, 2, 3 and so
    on up to a whole block; under a cipher it fills whole blocks.
    """
    if not data.startswith(MAGIC, at) or not (head := fields(data, at + len(MAGIC), 3)):
        return 0
    (cipher, derivation, _), end = head
    n = int.from_bytes(data[end : end + 4], "big")
    if not (cipher and derivation and cipher.isascii() and derivation.isascii()) or not 1 <= n < 100:
        return 0
    if not (keys := fields(data, end + 4, n)) or not (last := fields(data, keys[1], 1)):
        return 0
    kinds = [fields(k, 0, 1) for k in keys[0]]
    if not all(k and k[0][0] and k[0][0].isascii() for k in kinds):
        return 0
    part = last[0][0]
    if len(part) < 16 or len(part) % 8:
        return 0
    if cipher == b"none":
        kind = fields(part, 8, 1)
        pad = part[-1]
        if part[:4] != part[4:8] or not kind or kind[0] != kinds[0][0] or pad <= 16 and 0 < pad and part[-pad:] != bytes(range(1, pad + 1)):
            return 0
    return last[1] - at


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_size(data: bytes, at: int) -> int:
    """The size of the private key that begins at `at`; 0 for none."""
    if data[at : at + 1] == b"\x30" and (top := der(data, at, len(data))):
        return top[2] - at if is_der_key(data[at : top[2]]) else 0
    return ssh_size(data, at)


def holds_key(data: bytes | None) -> bool:
    """Whether decoded bytes are a private key, or are text that holds one, encoded."""
    if not data or len(data) < 24:
        return False
    return key_size(data, 0) == len(data) or data.isascii() and any(keys_in(data.decode("ascii")))


def in_armour(body: str) -> bool:
    """Whether what stands between the lines of an armour is a private key, as it is or under the cipher that its headers name."""
    body = ESCAPED.sub("\n", body).replace("\r", "")
    data = unbase64(HEADER.sub("", body))
    if holds_key(data):
        return True
    cipher = CIPHER.search(body)
    return bool(cipher and data) and len(data) >= 24 and len(data) % (len(cipher[1]) // 2) == 0


def keys_in_run(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each key that a match of ENCODED holds, without overlap.

    Each of the four ways to align the run is decoded once. A key is found wherever its first bytes stand; text is
    searched from where a line begins or a sign ends, once an alignment.
    """
    lines = [m.span() for m in LINE.finditer(run)]
    plain = "".join(run[a:b] for a, b in lines).translate(str.maketrans("-_", "+/"))
    ends, begun, starts, size = [], [], set(), 0  # where lines end and begin in `plain`; and where text may begin there
    for a, b in lines:
        begun.append(size)
        starts.update(size + x - a for x in (a, *(m.end() for m in SIGN.finditer(run, a, b))))
        size += b - a
        ends.append(size)
    decoded = []
    for shift in range(4):
        part = plain[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        decoded.append(base64.b64decode(part + "=" * (-len(part) % 4)))
    keys = {shift + m.start() // 3 * 4 for shift, data in enumerate(decoded) for m in KEY.finditer(data) if m.start() % 3 == 0}
    searched = [0] * 4
    done = 0
    for start in sorted(starts | keys):
        if start < done:
            continue
        shift = start % 4
        data, at = decoded[shift], (start - shift) // 4 * 3
        size = key_size(data, at) if start in keys else 0
        exact = size > 0
        if not size and start in starts and at >= searched[shift]:
            end = ASCII.match(data, at).end()
            searched[shift] = max(end, at + 1)
            if end - at >= 24:
                size = max((b for _, b, _ in keys_in(data[at:end].decode("ascii"))), default=0)
        if size < 24:
            continue
        need = start + -(-size * 4 // 3)
        k = bisect.bisect_left(ends, need)
        if k == len(ends):
            continue
        # a key ends where its length says; text that holds one, with its line
        done = need if exact else ends[k]
        first = bisect.bisect_right(begun, start) - 1
        yield lines[first][0] + start - begun[first], len(run) if done == len(plain) else lines[k][0] + done - begun[k]


def keys_in(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the private keys in a text, armoured ones first."""
    armoured = [m.span() for m in ARMOUR.finditer(text) if in_armour(m[2])] if "-----BEGIN" in text else []
    for a, b in armoured:
        yield a, b, 4
    for m in ENCODED.finditer(text):
        if not any(a <= m.start() < b for a, b in armoured):
            for a, b in keys_in_run(m[0]):
                yield m.start() + a, m.start() + b, 5
    for m in HEXED.finditer(text):
        yield from ((m.start() + a, m.start() + b, 6) for a, b in keys_in_hex(m[0]))


def keys_in_hex(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each key in a run of hex digits, in either alignment, without overlap; or the whole of what holds text with a key."""
    found = []
    for shift in (0, 1):
        data = bytes.fromhex(run[shift : len(run) - (len(run) - shift) % 2])
        done = 0
        for m in KEY.finditer(data):
            if m.start() >= done and (size := key_size(data, m.start())) >= 24:
                done = m.start() + size
                found.append((shift + m.start() * 2, shift + done * 2))
        if not done and data.isascii() and any(keys_in(data.decode("ascii"))):
            found.append((shift, shift + len(data) * 2))
    last = 0
    for a, b in sorted(found):
        if a >= last:
            last = b
            yield a, b


def _object(text: str) -> dict | None:
    """The JSON object that a part of a token encodes."""
    try:
        found = json.loads(unbase64(text) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def last_object(data: bytes) -> int | None:
    """Where the `{` is that the last `}` of a text closes, if the text is JSON from there on and ends with it; marks in strings don't count."""
    depth, outside = 0, True
    for m in reversed([m for m in MARKS.finditer(data.rstrip(b" \t\n\r")) if len(m[0]) == 1]):
        if m[0] == b'"':
            outside = not outside
        elif outside:
            depth += 1 if m[0] in b"}]" else -1
            if depth <= 0:
                return m.start() if m[0] == b"{" else None
    return None


def header_in(head: str) -> int | None:
    """Where the first `eyJ` is from which on a part of a token is a header that names an algorithm, however long it is.

    From each `eyJ` on the bytes are those of one of four texts, one for each place modulo 4. In each of them one object at most ends
    with the text, and only that is read, so the time is linear.
    """
    tries = []
    for first in range(4):
        data = unbase64(head[first:]) if head.find("eyJ", first) >= 0 else None
        at = last_object(data) if data else None
        if at is not None and at % 3 == 0 and head.startswith("eyJ", first + at // 3 * 4):
            tries.append(first + at // 3 * 4)
    return next((k for k in sorted(tries) if isinstance((_object(head[k:]) or {}).get("alg"), str)), None)


def signed_in(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each signed token: a header that names an algorithm, a payload, and a signature that may be empty.

    Runs are cut at their dots once and each payload is read once; only before a payload that holds are headers tried.
    """
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0] or run[0].count(".") < 2:
            continue
        parts, at, done = run[0].split("."), run.start(), 0
        for i, head in enumerate(parts[:-2]):
            if at >= done and "eyJ" in head and parts[i + 1] and _object(parts[i + 1]) is not None:
                k = header_in(head)
                if k is not None:
                    done = at + len(head) + len(parts[i + 1]) + len(parts[i + 2]) + 2
                    yield at + k, done
            at += len(head) + 1


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start, then kind as listed in KINDS; code points, end exclusive."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if "=" in text or ":" in text else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(a, 3, b) for a, b in signed_in(text)]
    out += [(a, kind, b) for a, b, kind in keys_in(text)]
    return sorted(out)


def spans_column(text: str | Column) -> Column:
    """An array of (kind, start, end); empty for a null or empty text."""
    one = lambda text: ([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(text)],)
    return common.text_udf(lambda: one, SCAN)(text)["spans"]


def masked_column(text: str | Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by `mark`; null stays null."""

    def one(text):
        if not text:
            return (text,)
        out, at = [], 0
        for a, _, b in scan(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return ("".join([*out, text[at:]]),)

    return common.text_udf(lambda: one, "text string")(text)["text"]


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with the secrets in `text` masked; rows, other columns and their order stay."""
    return docs.withColumn(text, masked_column(F.col(text), mark))



def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, counted by base kind, with digests of their spans."""
    docs = common.documents(spark, sf_dir).select("doc_id", spans_column("text").alias("spans"))
    joined = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    return docs.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
