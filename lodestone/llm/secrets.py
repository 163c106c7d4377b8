"""Secret scan with structural confirmation.

Base spans come from three patterns. Beyond them, runs in the base64 or hex alphabets, PEM blocks and dotted tokens
are candidates, and each is decoded and parsed before it is reported:

* ``jwt``: the header decodes to a JSON object that names an algorithm, the claims to a JSON object;
* ``pem``: the block's body decodes to a private key as below or to OpenSSH's container, or the block has the headers
  of an encrypted one and whole cipher blocks;
* ``key``: the bytes are a DER private key (PKCS#1, PKCS#8, plain or encrypted, or SEC 1) whose nested lengths fill it
  exactly;
* ``ssh``: the bytes are length-prefixed fields that fill it exactly, the first an SSH key type, or OpenSSH's container
  of them;
* ``encoded``: the bytes are UTF-8 text in which a base pattern finds a secret.

A run that is nothing as a whole is tried from its start and from behind each ``/``, ``-``, ``_``, ``+`` or ``=`` in it.
What stands there says where it ends: the outer length of a DER key, the lengths of SSH's fields, the first byte that is
no UTF-8. Lengths are read from the few characters that hold them, and text is decoded once for each of the four ways
base64 can be aligned, so the time grows with the run and not with its square. Lines of 40 to 80 characters of base64
that follow each other are tried as one run.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "ssh", "encoded")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Lower-case parts of which one is in every text that ASSIGN matches.
ASSIGN_PARTS = ("passw", "secret", "token", "api")

#: No shorter run encodes a base secret: 14 bytes, ``token=`` and 8 characters.
RUN = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{40,80})(?:\r?\n[A-Za-z0-9+/]{40,80})*\r?\n[A-Za-z0-9+/]{1,80}={0,2}(?![A-Za-z0-9+/=])")
JOINTS, LEAST_RUN, PROBE = re.compile(r"[/_+=-]"), 19, 24
#: Items of a DER sequence and fields of a container that are looked at; a private key has no more. Characters of text decoded at a time.
ITEMS, PIECE = 64, 4_096
ANY_HEX = re.compile(r"[0-9a-fA-F]+")
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]+: [^\r\n]*\r?\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
CIPHER = re.compile(r"^Proc-Type: 4,ENCRYPTED\r?$.*^DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]{16,32})\r?$", re.M | re.S)
#: Key types, and the fields of a public key of each, its type among them.
SSH_TYPES = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
OPENSSH = b"openssh-key-v1\0"

Span = tuple[int, int, str]


def decoded(run: str) -> bytes | None:
    """The bytes of a run: hex where it is all hex digits in pairs, else base64 of either alphabet; None where neither fits."""
    body = run.rstrip("=")
    if ANY_HEX.fullmatch(run) and len(run) % 2 == 0:
        return bytes.fromhex(run)
    if len(body) % 4 == 1 or (set("+/") & set(body) and set("-_") & set(body)):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der(raw: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``raw`` exactly, or None."""
    items, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, length = raw[at], raw[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(raw):
                return None
            length = int.from_bytes(raw[at : at + n])
            at += n
        if at + length > len(raw):
            return None
        items.append((tag, raw[at : at + length]))
        at += length
    return items


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_private_key(raw: bytes) -> bool:
    """A DER private key: one sequence that fills ``raw``, whose own items are those of a known layout."""
    if len(raw) < 16 or raw[0] != SEQUENCE:
        return False
    outer = der(raw)
    inner = der(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    if tags == [SEQUENCE, OCTETS]:  # encrypted: the algorithm and what it made
        algorithm = der(inner[0][1])
        return bool(algorithm) and [tag for tag, _ in algorithm] == [OID, SEQUENCE] and bool(der(algorithm[1][1])) and len(inner[1][1]) >= 16
    if tags[0] != INTEGER:
        return False
    if tags in ([INTEGER] * 9, [INTEGER] * 6):  # RSA, or DSA: version, p, q, g and the two keys
        return len(tags) == 9 or (inner[0][1] == b"\0" and len(inner[1][1]) >= 64)
    if tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == OID
    return tags[1:2] == [OCTETS] and len(inner[1][1]) in (28, 32, 48, 66)


def _fields(raw: bytes, most: int | None = None) -> tuple[list[bytes], bytes] | None:
    """``most`` length-prefixed fields, or all, and what follows them; None where a length reaches beyond the end."""
    at, fields = 0, []
    while at < len(raw) and len(fields) != most:
        n = int.from_bytes(raw[at : at + 4])
        if at + 4 + n > len(raw):
            return None
        fields.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return fields, raw[at:]


def is_ssh_key(raw: bytes) -> bool:
    """Length-prefixed fields that fill ``raw`` exactly, a key type first; or OpenSSH's container."""
    found = is_openssh(raw) or _fields(raw)
    return found is True or bool(found) and len(found[0]) > 1 and found[0][0] in SSH_TYPES


def is_openssh(raw: bytes) -> bool:
    """Cipher, derivation and its options, a count, as many public keys and the private part, to the last byte."""
    if not raw.startswith(OPENSSH):
        return False
    head = _fields(raw[len(OPENSSH) :], 3)
    if not head or len(head[0]) < 3 or not head[0][0] or len(head[1]) < 4:
        return False
    n = int.from_bytes(head[1][:4])
    rest = _fields(head[1][4:])
    return bool(rest) and 0 < n == len(rest[0]) - 1 and all(is_ssh_key(public) for public in rest[0][:-1]) and len(rest[0][-1]) >= 8


def is_enciphered(headers: str, raw: bytes) -> bool:
    """The headers of an encrypted PEM block, and a body of whole cipher blocks."""
    named = CIPHER.search(headers)
    return bool(named) and len(raw) >= 16 and len(raw) % (len(named[2]) // 2) == 0


def is_signed_token(token: str) -> bool:
    header, claims, _ = token.split(".")
    try:
        parts = [json.loads(decoded(p) or b"") for p in (header, claims)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def confirmed(raw: bytes | None) -> str | None:
    """What the bytes of a run are."""
    if not raw:
        return None
    if is_private_key(raw):
        return "key"
    if is_ssh_key(raw):
        return "ssh"
    try:
        return "encoded" if base_spans(raw.decode()) else None
    except UnicodeDecodeError:
        return None


class Encoded:
    """The bytes that stand in ``text`` from ``start`` to ``stop`` as base64 or hex, decoded only where they are asked for."""

    def __init__(self, text: str, start: int, stop: int, hexadecimal: bool):
        self.text, self.start, self.stop, self.hexadecimal = text, start, stop, hexadecimal
        self.size = (stop - start) // 2 if hexadecimal else (stop - start) * 3 // 4

    def read(self, a: int, b: int) -> bytes:
        """Bytes ``a`` to ``b``, fewer at the end."""
        if self.hexadecimal:
            return bytes.fromhex(self.text[self.start + 2 * a : min(self.start + 2 * b, self.start + 2 * self.size)])
        first = self.start + a // 3 * 4
        body = self.text[first : min(first + -(-(b - a // 3 * 3) // 3) * 4, self.stop)].rstrip("=").replace("-", "+").replace("_", "/")
        body = body[:-1] if len(body) % 4 == 1 else body
        return base64.b64decode(body + "=" * (-len(body) % 4))[a % 3 :][: b - a]

    def place(self, n: int) -> int:
        """Where the first ``n`` bytes end in the text, padding included."""
        if self.hexadecimal:
            return self.start + 2 * n
        end = self.start + -(-n * 4 // 3)
        while end < self.stop and self.text[end] == "=":
            end += 1
        return end

    def item(self, at: int) -> tuple[int, int, int] | None:
        """Tag, start and end of the DER item at a byte."""
        head = self.read(at, at + 6)
        if len(head) < 2:
            return None
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        if n > 4 or (head[1] & 0x80 and not n) or len(head) < 2 + n:
            return None
        start = at + 2 + n
        return head[0], start, start + (int.from_bytes(head[2 : 2 + n]) if n else head[1])

    def word(self, at: int) -> int:
        raw = self.read(at, at + 4)
        return int.from_bytes(raw) if len(raw) == 4 else 1 << 40


def key_end(raw: Encoded) -> int | None:
    """The bytes of the DER private key that stands here, by its lengths; None where its items don't fill it."""
    outer = raw.item(0)
    if outer is None or outer[0] != SEQUENCE or not 16 <= outer[2] <= raw.size:
        return None
    at, tags = outer[1], []
    while at < outer[2] and len(tags) < ITEMS:
        item = raw.item(at)
        if item is None or item[2] > outer[2]:
            return None
        tags.append(item[0])
        at = item[2]
        if tags[0] not in (INTEGER, SEQUENCE) or tags[1:2] not in ([], [INTEGER], [SEQUENCE], [OCTETS]):
            return None
    return outer[2] if at == outer[2] else None


def ssh_end(raw: Encoded) -> int | None:
    """The bytes of the public key or of OpenSSH's container that stands here, by the lengths of its fields."""

    def after(at: int, fields: int) -> int:
        for _ in range(fields):
            at += 4 + raw.word(at)
        return at

    if raw.read(0, len(OPENSSH)) == OPENSSH:
        at = after(len(OPENSSH), 3)
        n = raw.word(at)
        end = after(at + 4, n + 1) if 0 < n < ITEMS else raw.size + 1
    else:
        n = raw.word(0)
        fields = SSH_TYPES.get(raw.read(4, 4 + n)) if n <= 19 else None
        end = after(0, fields) if fields else raw.size + 1
    return end if end <= raw.size else None


def text_from(raw: Encoded) -> tuple[str, int]:
    """The UTF-8 text that stands here up to the first byte that is none, and how many bytes it has."""
    read, parts, n = codecs.getincrementaldecoder("utf-8")(), [], 0
    for at in range(0, raw.size, PIECE):
        piece = raw.read(at, at + PIECE)
        try:
            parts.append(read.decode(piece))
            n += len(piece)
        except UnicodeDecodeError as e:
            held = len(e.object) - len(piece)  # what the piece before left over
            parts.append(e.object[: e.start].decode())
            return "".join(parts), n + e.start - held
    return "".join(parts), n - len(read.getstate()[0])


def run_spans(text: str, start: int, stop: int) -> list[Span]:
    """The run itself if it is confirmed; else what stands at its start or behind one of its joints, as far as it says it goes."""
    if kind := confirmed(decoded(text[start:stop])):
        return [(start, stop, kind)]
    found: list[Span] = []
    reached, seen = start, [start] * 4  # up to where text has been looked at, for each alignment
    hex_upto = start
    for a in [start, *(m.end() for m in JOINTS.finditer(text, start, stop))]:
        if a < reached or stop - a < LEAST_RUN:
            continue
        ways = [Encoded(text, a, stop, False)]
        if ANY_HEX.fullmatch(text, a, min(a + PROBE, stop)) and a >= hex_upto:
            hex_upto = ANY_HEX.match(text, a, stop).end()
            ways.insert(0, Encoded(text, a, hex_upto, True))
        for raw in ways:
            head = raw.read(0, 16)
            end = key_end(raw) if head[:1] == bytes([SEQUENCE]) else ssh_end(raw) if head[:2] == b"\0\0" or head[:15] == OPENSSH else None
            if end is not None and (kind := confirmed(decoded(text[a : raw.place(end)]))) in ("key", "ssh"):
                found.append((a, raw.place(end), kind))
                reached = raw.place(end)
                break
            if raw.hexadecimal or a >= seen[a % 4]:
                said, n = text_from(raw)
                b = raw.place(n)
                if not raw.hexadecimal:
                    seen[a % 4] = b
                if spans := base_spans(said):
                    ends = raw.place(len(said[: max(y for _, y, _ in spans)].encode()))
                    joint = JOINTS.search(text, max(ends - 3, a + LEAST_RUN), b)  # without padding, a tail may read on as text
                    if joint and confirmed(decoded(text[a : joint.start()])) == "encoded":
                        b = joint.start()
                    if b - a >= LEAST_RUN:
                        found.append((a, b, "encoded"))
                        reached = b
                        break
    return found


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[Span]:
    """Spans of the base patterns. Hex runs of the least length lie in ``runs`` where those are known."""
    found: list[Span] = []
    lower = text.lower()
    if any(part in lower for part in ASSIGN_PARTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for a, b in [(0, len(text))] if runs is None else runs:
        found += [(*m.span(), "hex") for m in HEX.finditer(text, a, b) if len(m[0]) >= LEAST["hex"]]
    return found


def secret_spans(text: str) -> list[Span]:
    """All spans (start, end, kind) of a text in order; code points, end exclusive."""
    runs = [m.span() for m in RUN.finditer(text)]
    found = base_spans(text, runs)
    if "eyJ" in text:
        found += [(*m.span(), "jwt") for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            raw = decoded("".join(m[3].split()))
            if raw and (is_enciphered(m[2], raw) if m[2] else is_private_key(raw) or is_openssh(raw)):
                found.append((*m.span(), "pem"))
    whole = [s for s in found if s[2] == "pem"]
    if runs and "\n" in text:
        for m in WRAPPED.finditer(text):
            if not any(x <= m.start() and m.end() <= y for x, y, _ in whole) and (kind := confirmed(decoded("".join(m[0].split())))):
                whole.append((*m.span(), kind))
                found.append(whole[-1])
    for a, b in runs:
        if not any(x <= a and b <= y for x, y, _ in whole):
            found += run_spans(text, a, b)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: counts and digest of the base spans, and all spans.

    A null text is empty and has no spans; repeated rows and null ids are scanned like others; other columns are
    ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = secret_spans(text.as_py() or "")
                base = [s for s in spans if s[2] in LEAST]
                counts = [sum(s[2] == kind for s in base) for kind in LEAST]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)
