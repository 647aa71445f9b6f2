"""Secret scans with structural confirmation.

Three base kinds are matched as written in their patterns.  On top of them, base64 and hex
candidates are *decoded* and reported only if what is inside parses as something secret: a
DER private key (PKCS#1, PKCS#8 plain or encrypted, SEC1 or DSA, with nested lengths that add
up) or PKCS#12 container, an OpenSSH private-key container whose fields fill it, a text that holds
one of these in turn (as base64 of a PEM file does, up to ``DEPTH`` encodings), or a signed token
whose header and payload are JSON with an algorithm.  Public keys and certificates parse too, but not as one of
those, and are not reported; nor are candidates that merely look random.

One pass, no shuffle; memory is one Arrow batch.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds in the order of the listing; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Every assignment holds one of these; texts without them skip the slower pattern.
_ASSIGN_HINT = re.compile(r"[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_-])")
#: Base64 candidates, of either alphabet: a line of 40 characters or more, and lines after it as in PEM bodies, indented or with breaks written as \\n.
_BASE64_LINE = 40
#: Lines may also stand behind the sign of a comment or quotation, or in quotes of their own that are joined.
_BREAK = r"""(?:(?:\\n)?["'][\x20\t]*[+.,\\]?[\x20\t]*\r?\n[\x20\t]*[+.]?[\x20\t]*["']|\r?\n[\x20\t]*(?:(?:[#*>;]+|//+|--)[\x20\t]+)?|(?:\\r)?\\n)"""
_BASE64 = re.compile(rf"[A-Za-z0-9+/]{{40,}}(?:{_BREAK}[A-Za-z0-9+/]+)*(?:{_BREAK}(?==))?={{0,2}}")
_BASE64URL = re.compile(rf"[A-Za-z0-9_-]{{40,}}(?:{_BREAK}[A-Za-z0-9_-]+)*(?:{_BREAK}(?==))?={{0,2}}")
_SEPARATOR = re.compile(_BREAK)
#: Encodings inside each other that are decoded: of a PEM file, of that file once more.
DEPTH = 3
_TEXT = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]+")
#: A key inside a line starts after a sign of paths, with the base64 of a SEQUENCE or of the OpenSSH magic.
_INNER = re.compile(r"(?<=[/_-])(?:M[A-P]|b3BlbnNzaC1r)")
_URL_SIGNS = str.maketrans("-_", "+/")
_OPENSSH = b"openssh-key-v1\x00"
_HEX_ANY = re.compile(r"[0-9a-fA-F]{48,}")
_SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
#: Fewest bytes of a public key in an OpenSSH container: lengths, and the shortest kind.
_LEAST_KEY = 15
# DER tags, and object identifiers of PKCS#7 contents and of password-based encryption (PKCS#5, PKCS#12).
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_CONTENTS = bytes.fromhex("2a864886f70d0107")
_ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _unbase64(text: str) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_ends(data: bytes, start: int, stop: int) -> int | None:
    """End of the DER element at ``start``, or None if its tag or lengths don't hold together."""
    if start + 2 > stop:
        return None
    first = data[start + 1]
    at, size = start + 2, first
    if first & 0x80:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > stop:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > stop:
        return None
    if data[start] & 0x20:  # constructed: its children must fill it
        inner = at
        while inner < at + size:
            inner = _der_ends(data, inner, at + size)
            if inner is None:
                return None
    return at + size


def _der_children(data: bytes, start: int, stop: int) -> list[tuple[int, int, int]]:
    """(tag, first byte of the content, end) of the elements in a content whose lengths hold together."""
    out = []
    while start < stop:
        first = data[start + 1]
        content = start + 2 + (first & 0x7F if first & 0x80 else 0)
        end = content + (int.from_bytes(data[start + 2 : content], "big") if first & 0x80 else first)
        out.append((data[start], content, end))
        start = end
    return out


def is_der_key(data: bytes) -> bool:
    """A DER private key that fills the data: PKCS#1, DSA, SEC1, or PKCS#8, plain or encrypted; or a PKCS#12 container.

    Public keys (of PKCS#1 or with an algorithm and a BIT STRING) and certificates are none.
    """
    try:
        if len(data) < 32 or data[0] != _SEQUENCE or _der_ends(data, 0, len(data)) != len(data):
            return False
    except (IndexError, RecursionError):
        return False
    ((_, at, stop),) = _der_children(data, 0, len(data))
    parts = _der_children(data, at, stop)
    tags = [t for t, _, _ in parts]
    numbers = [data[a:b] for _, a, b in parts]
    if tags[:1] == [_INTEGER]:
        version = int.from_bytes(numbers[0], "big")
        if all(t == _INTEGER for t in tags[:9]) and len(tags) in (9, 10):
            return version == len(tags) - 9 and (len(tags) == 9 or tags[9] == _SEQUENCE)
        if tags == [_INTEGER] * 6:
            return version == 0
        if tags[1:2] == [_OCTETS]:
            return version == 1 and all(t in (0xA0, 0xA1) for t in tags[2:])
        if tags[1:3] == [_SEQUENCE, _OCTETS]:
            inner = _der_children(data, *parts[1][1:])
            return version in (0, 1) and bool(inner) and inner[0][0] == _OID and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
        if tags[1:] in ([_SEQUENCE], [_SEQUENCE, _SEQUENCE]) and version == 3:
            inner = _der_children(data, *parts[1][1:])
            return bool(inner) and inner[0][0] == _OID and data[inner[0][1] : inner[0][2]].startswith(_CONTENTS)
        return False
    if tags == [_SEQUENCE, _OCTETS]:
        inner = _der_children(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == _OID and data[inner[0][1] : inner[0][2]].startswith(_ENCRYPTIONS)
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private-key container: cipher, key derivation, its options, public keys of known kinds and the private part fill it.

    An SSH public key is none.
    """
    if not data.startswith(_OPENSSH):
        return False

    def fields(at: int, n: int) -> tuple[int, list[bytes]]:
        out = []
        while n and at + 4 <= len(data):
            size = int.from_bytes(data[at : at + 4], "big")
            out.append(data[at + 4 : at + 4 + size])
            at, n = at + 4 + size, n - 1
        return (at if not n else len(data) + 1), out

    at, head = fields(len(_OPENSSH), 3)
    if at + 4 > len(data) or not head[0] or not head[1]:
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    at, body = fields(at + 4, n + 1)
    if at != len(data) or not n:
        return False
    private = body[-1]
    kinds = [k[4 : 4 + int.from_bytes(k[:4], "big")] for k in body[:-1]]
    # The private part starts with a number given twice, unless it is encrypted.
    return all(k in _SSH_KINDS for k in kinds) and len(private) >= 8 and (head[0] != b"none" or private[:4] == private[4:8])


def is_signed_token(token: str) -> bool:
    """header.payload.signature: JSON objects, "alg" in the header, and a signature that decodes."""
    parts = token.split(".")
    blobs = [_unbase64(p.replace("-", "+").replace("_", "/")) for p in parts]
    if len(blobs) != 3 or None in blobs:
        return False
    try:
        head, body = json.loads(blobs[0]), json.loads(blobs[1])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed; code points, end exclusive; null: none."""
    if not text:
        return []
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    if "eyJ" in text or "ey" in text and "." in text:
        out += [(m.start(), m.end(), 3) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    out += _encoded(text, DEPTH)
    for m in _HEX_ANY.finditer(text):
        kind = _key_kind(bytes.fromhex(m[0])) if (m.end() - m.start()) % 2 == 0 else None
        if kind is not None:
            out.append((m.start(), m.end(), kind))
    return [(s, e, KINDS[k]) for s, e, k in sorted(set(out), key=lambda x: (x[0], x[2], x[1]))]


def _encoded(text: str, depth: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of keys in the base64 of a text."""
    out = [k for m in _BASE64.finditer(text) for k in _base64_keys(text, m.start(), m.end(), depth)]
    return out + [k for m in _BASE64URL.finditer(text) if "-" in m[0] or "_" in m[0] for k in _base64_keys(text, m.start(), m.end(), depth)]


def _key_kind(data: bytes | None) -> int | None:
    if not data:
        return None
    return 4 if is_der_key(data) else 5 if is_ssh_key(data) else None


def _end(take: Callable[[int, int], bytes], size: int) -> int | None:
    """Where a key at the start of ``size`` bytes ends by its own lengths, or None if it can't be one."""
    head = take(0, 16)
    if head[:1] == b"\x30" and len(head) >= 6:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        return None if n > 4 else 2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]
    if not head.startswith(_OPENSSH):
        return None
    # Cipher, key derivation and its options; a number of public keys; these, and the private part.
    at, left = len(_OPENSSH), 3
    while left and at + 4 <= size:
        at, left = at + 4 + int.from_bytes(take(at, 4), "big"), left - 1
    if left or at + 4 > size:
        return None
    left, at = int.from_bytes(take(at, 4), "big"), at + 4
    while left and at + 8 <= size:
        field = int.from_bytes(take(at, 4), "big")
        # A public key names a known kind; so what is no container is left after a field or two.
        if field < _LEAST_KEY or take(at + 8, int.from_bytes(take(at + 4, 4), "big") & 63) not in _SSH_KINDS:
            return None
        at, left = at + 4 + field, left - 1
    if left or at + 4 > size:
        return None
    return at + 4 + int.from_bytes(take(at, 4), "big")


def _lines(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """Spans of a candidate's lines, without what breaks them and without padding."""
    # The letter of a written break before the first line is none of its own.
    out, at = [], start + (text[start - 1 : start] == "\\" and text[start] in "nr")
    for a, b in [*(m.span() for m in _SEPARATOR.finditer(text, start, stop)), (stop, stop)]:
        end = at + len(text[at:a].rstrip("="))
        if end > at:
            out.append((at, end))
        at = b
    return out


def _base64_keys(text: str, start: int, stop: int, depth: int = 1) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the keys in a candidate.

    A key starts a line, or stands in one after a path; it ends with a line, which one follows
    from the lengths inside it, so that words on the lines after a key, or another key, are no
    part of it.  Lines that decode to a text are searched in turn, ``depth`` encodings in all;
    they are reported up to the line in which the key inside ends.
    """
    lines = _lines(text, start, stop)
    chars = "".join(text[a:b] for a, b in lines).translate(_URL_SIGNS)
    upto = list(itertools.accumulate((b - a for a, b in lines), initial=0))
    out, i = [], 0
    while i < len(lines):
        a, b = lines[i]
        found = None
        for s in [a, *(m.start() for m in _INNER.finditer(text, a, b))] if b - a >= _BASE64_LINE else ():
            first = upto[i] + s - a

            def take(at: int, n: int, first: int = first) -> bytes:
                lo = at // 3
                part = chars[first + 4 * lo : first + 4 * -(-(at + n) // 3)]
                return (_unbase64(part[: len(part) - (len(part) % 4 == 1)]) or b"")[at - 3 * lo :][:n]

            end = _end(take, (upto[-1] - first) * 3 // 4)
            if end is None:
                continue
            n = -(-4 * end // 3)
            k = bisect.bisect_left(upto, first + n)
            if i < k < len(upto) and upto[k] == first + n and (kind := _key_kind(_unbase64(chars[first : first + n]))) is not None:
                found = k, (s, stop if k == len(lines) else lines[k - 1][1], kind)
                break
        if found is None and depth > 1 and b - a >= _BASE64_LINE:
            found = _nested(lines, chars, upto, i, stop, depth)
        i += 1
        if found:
            i = found[0]
            out.append(found[1])
    return out


def _nested(lines: list[tuple[int, int]], chars: str, upto: list[int], i: int, stop: int, depth: int) -> tuple[int, tuple[int, int, int]] | None:
    """A text with keys, encoded from line ``i`` on: the line after it, and (start, end, kind) up to the last key's last line."""
    head = _unbase64(chars[upto[i] : upto[i] + _BASE64_LINE])
    if head is None or not _TEXT.fullmatch(head):
        return None
    # A wrapped text has lines of one length, but for the last one.
    width, k = lines[i][1] - lines[i][0], i + 1
    while k < len(lines) and lines[k - 1][1] - lines[k - 1][0] == width >= lines[k][1] - lines[k][0]:
        k += 1
    some = chars[upto[i] : upto[k]]
    keys = _encoded((_unbase64(some[: len(some) - (len(some) % 4 == 1)]) or b"").decode("latin-1"), depth - 1)
    if not keys:
        return None
    _, end, kind = max(keys, key=lambda x: x[1])
    last = bisect.bisect_left(upto, upto[i] + -(-4 * end // 3))
    last = min(max(last, i + 1), k)
    return last, (lines[i][0], stop if last == len(lines) else lines[last - 1][1], kind)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of each base kind, base_sha256, spans.

    Null and empty texts have no span and the digest of the empty string.  Kinds may
    overlap; each is reported.  Repeated rows each get their row; other columns of
    ``docs``, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in batch.column("text").to_pylist()]
            base = [[x for x in f if x[2] in KINDS[:3]] for f in found]
            count = lambda k: pa.array([sum(x[2] == k for x in b) for b in base], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([_joined(f) for f in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones merged) replaced by ``mask``."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, if there, set to the new length where the text changed.

    All columns and rows stay; a null text stays null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [redacted(t, mask) for t in old]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if a is b else len(b) for k, a, b in zip(kept, old, new, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
