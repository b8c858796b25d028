"""Secret scans: patterns, then structural confirmation.

Base spans are the leftmost non-overlapping matches of three patterns (assign, access, hex), each kept if long enough.
Candidates of base64 and hex are then decoded, and what they hold is parsed before it is reported: nested DER lengths of
keys and certificates, the length-prefixed strings of SSH keys, PEM bodies (whose headers may say that they are sealed: then the cipher's block
size), base64 in either alphabet over one line or several (from every line's start, feeds also as the two characters of a JSON string), hex
with colons, and the JSON headers of signed tokens. Base
spans are never taken away; each says in `confirmed` what its value decodes to.

Null texts count as empty and have no spans; texts are scanned whole; repeated rows give repeated results; equal spans of
one kind occur once; an empty table gives an empty one; columns of the input are kept, and clashing names are replaced by
those that the scan adds. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import give_back

# The base patterns (letters of the names in either case), their least lengths, and the order of the kinds.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
_CASE = lambda name: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", name)
ASSIGN = re.compile("(" + "|".join(map(_CASE, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # all of a run, so the same as the runs of 16 characters or more
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "token", "pem", "der", "ssh")

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# A PEM block is found by its marks and parsed between them: each in time linear in the text, whatever lies between.
BEGIN = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
HEADER = re.compile(r"[A-Za-z0-9-]{1,40}: [^\n]*\n")
BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
#: Lines go on after a line feed, or after one that is written as two characters, as in JSON strings.
FEED = r"(?:\r?\n|(?:\\r)?\\n)"
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{FEED}[A-Za-z0-9+/_-]+)*={{0,2}}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
COLONS = re.compile(r"(?:[0-9A-Fa-f]{2}:(?:\r?\n[ \t]{0,16})?){19,}[0-9A-Fa-f]{2}")
#: Strings of a public key by its type, the type included. A key has at most LONGEST_KEY bytes.
SSH_FIELDS = {"ssh-rsa": 3, "ssh-dss": 5, "ssh-ed25519": 2}
LONGEST_KEY = 1 << 16
HEX_ANY = re.compile(r"(?:[0-9a-f]{40,}|[0-9A-F]{40,})")
SSH_TYPES = ("ssh-rsa", "ssh-dss", "ssh-ed25519", "ecdsa-sha2-nistp256", "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521")
_SSH_NAMES = {x.encode() for x in SSH_TYPES}


def unbase64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not; None if it is none."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(raw: bytes, at: int) -> tuple[int, int] | None:
    """(start of the content, its length) of the DER value whose length octets begin at `at`."""
    if at >= len(raw):
        return None
    first = raw[at]
    if first < 0x80:
        return at + 1, first
    count = first & 0x7F
    if not 1 <= count <= 4 or at + 1 + count > len(raw) or raw[at + 1] == 0:
        return None
    size = int.from_bytes(raw[at + 1 : at + 1 + count])
    return (at + 1 + count, size) if size >= 0x80 else None


def der_nested(raw: bytes, start: int, end: int, depth: int = 0) -> int | None:
    """How many values fill raw[start:end] exactly, constructed ones all the way down; None if they do not."""
    at, values = start, 0
    while at < end:
        head = der_length(raw, at + 1)
        if head is None or head[0] + head[1] > end or depth > 16:
            return None
        tag, inner = raw[at], head[0]
        if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
            if (deeper := der_nested(raw, inner, inner + head[1], depth + 1)) is None:
                return None
            values += deeper
        values += 1
        at = inner + head[1]
    return values


def is_key_der(raw: bytes) -> bool:
    """A SEQUENCE over all the bytes, of at least two nested values, one of them an integer, an identifier or a bit string."""
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    head = der_length(raw, 1)
    if head is None or head[0] + head[1] != len(raw):
        return False
    inside = der_nested(raw, head[0], len(raw))
    return inside is not None and inside >= 2 and raw[head[0]] in (0x02, 0x30)


def ssh_strings(raw: bytes) -> list[bytes] | None:
    """The length-prefixed strings that make up the bytes, or None."""
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4])
        if at + 4 + size > len(raw) or len(raw) - at < 4:
            return None
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def is_openssh_key(raw: bytes) -> bool:
    """The private key format: cipher, derivation and its options as strings, a count, so many public keys and one private section,
    each by its length, and nothing after them. The public keys hold strings, the first a type of key."""
    at, magic = 0, b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at, parts, wanted = len(magic), [], 3
    while len(parts) < wanted:
        if len(parts) == 3 and wanted == 3 or at + 4 > len(raw):
            return False
        size = int.from_bytes(raw[at : at + 4])
        if at + 4 + size > len(raw):
            return False
        parts.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
        if len(parts) == 3:
            keys = int.from_bytes(raw[at : at + 4])
            if at + 4 > len(raw) or not 1 <= keys <= 64:
                return False
            at, wanted = at + 4, 3 + keys + 1
    public = [ssh_strings(p) for p in parts[3:-1]]
    return at == len(raw) and all(p and len(p) >= 2 and p[0] in _SSH_NAMES for p in public) and len(parts[-1]) >= 8


def peek(body: str, at: int, start: int, size: int) -> bytes:
    """Some bytes of what base64 from body[at] on decodes to; fewer at its end."""
    first, last = start // 3 * 4, -(-(start + size) // 3) * 4
    return (unbase64(body[at + first : at + last]) or b"")[start % 3 : start % 3 + size]


def ssh_length(body: str, at: int) -> int | None:
    """How many bytes a public or private key that begins there says it has."""
    if peek(body, at, 0, 15) == b"openssh-key-v1\0":
        done, strings, counted = 15, 3, False
    elif (size := int.from_bytes(peek(body, at, 0, 4))) <= 32 and (kind := peek(body, at, 4, size)) in _SSH_NAMES:
        done, strings, counted = 4 + size, SSH_FIELDS.get(kind.decode(), 3) - 1, True
    else:
        return None
    while strings:
        if len(size := peek(body, at, done, 4)) < 4:
            return None
        done, strings = done + 4 + int.from_bytes(size), strings - 1
        if not strings and not counted:
            keys = int.from_bytes(peek(body, at, done, 4))
            if not 1 <= keys <= 64:
                return None
            done, strings, counted = done + 4, keys + 1, True
        if done > LONGEST_KEY:
            return None
    return done


def unwrapped(found: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in base64 over one line or several. A key begins at a line's start and says its own length, so what
    follows it is searched further; what tells no length must fill its line."""
    lines = [(m.start(), m[0]) for m in LINE.finditer(found)]
    if "\\" in found:  # the n of a written line feed is no character of the line after it
        lines = [(at + (at > 0 and found[at - 1] == "\\"), line[at > 0 and found[at - 1] == "\\" :]) for at, line in lines]
        lines = [(at, line) for at, line in lines if line]
    body, out, k = "".join(line for _, line in lines), [], 0
    offsets = [0]
    for _, line in lines:
        offsets.append(offsets[-1] + len(line))
    while k < len(lines):
        at, size = offsets[k], None
        head = peek(body, at, 0, 6)
        if head[:1] == b"\x30" and (outer := der_length(head, 1)):
            size = outer[0] + outer[1]
        elif head[:2] == b"\0\0" or head == b"openss":
            size = ssh_length(body, at)
        chars = -(-(size or 0) * 4 // 3)
        what = structure(unbase64(body[at : at + chars])) if size and size <= LONGEST_KEY and at + chars <= len(body) else None
        if what is None and len(lines[k][1]) >= 40 and (what := structure(unbase64(lines[k][1]))):
            chars = len(lines[k][1])
        if what is None:
            k += 1
            continue
        last = k
        while offsets[last + 1] < at + chars:
            last += 1
        end = lines[last][0] + at + chars - offsets[last]
        while end < len(found) and found[end] == "=":
            end += 1
        out.append((what, lines[k][0], end))
        k = last + 1
    return out


def pem_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what) of the PEM blocks: from a BEGIN mark to the next mark, which must be the END of the same name."""
    marks, out = list(BEGIN.finditer(text)), []
    for m, n in zip(marks, marks[1:]):
        if m[1] != "BEGIN" or n[1] != "END" or m[2] != n[2]:
            continue
        inner = text[m.end() : n.start()].replace("\\r", "").replace("\\n", "\n").lstrip()
        at, heads = 0, []
        while h := HEADER.match(inner, at):
            heads.append(h[0])
            at = h.end()
        if BODY.fullmatch(inner, at):
            raw, named = unbase64("".join(inner[at:].split())), "".join(heads)
            sealed = "ENCRYPTED" in named and "DEK-Info: " in named and raw is not None and len(raw) >= 32 and len(raw) % 8 == 0
            if what := "encrypted" if sealed else structure(raw):
                out.append((m.start(), n.end(), what))
    return out


def structure(raw: bytes | None) -> str | None:
    """What decoded bytes hold: der, ssh, or None."""
    if not raw:
        return None
    if is_openssh_key(raw) or ((parts := ssh_strings(raw)) and len(parts) >= 2 and parts[0] in _SSH_NAMES):
        return "ssh"
    return "der" if is_key_der(raw) else None


def is_signed_header(part: str) -> bool:
    """Base64url of a JSON object with a signature algorithm."""
    raw = unbase64(part)
    try:
        head = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and bool(head["alg"])


def confirm(value: str) -> str | None:
    """What a value decodes to: a signed token, a key encoding, or None."""
    parts = value.split(".")
    if len(parts) == 3 and is_signed_header(parts[0]) and unbase64(parts[1]) is not None:
        return "token"
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){20,}", value) and (found := structure(bytes.fromhex(value))):
        return found
    return structure(unbase64(value)) if len(value) >= 24 else None


def scan(text: str) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, confirmed) of every secret, by start, then kind."""
    found: dict[tuple[str, int, int], str | None] = {}
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            found["assign", m.start(), m.end()] = confirm(m[2])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found["access", m.start(), m.end()] = None
    for m in HEX.finditer(text):
        found["hex", m.start(), m.end()] = structure(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])) if len(m[0]) >= 40 else None
    if "eyJ" in text:
        for m in SIGNED.finditer(text):
            if is_signed_header(m[1]) and unbase64(m[2]) is not None:
                found["token", m.start(), m.end()] = "token"
    if "-----BEGIN " in text:
        for start, end, what in pem_blocks(text):
            found["pem", start, end] = what
    for m in BASE64.finditer(text):
        for what, start, end in unwrapped(m[0]):
            found[what, m.start() + start, m.start() + end] = what
    for m in COLONS.finditer(text):
        if what := structure(bytes.fromhex("".join(m[0].replace(":", " ").split()))):
            found[what, m.start(), m.end()] = what
    for m in HEX_ANY.finditer(text):
        if len(m[0]) % 2 == 0 and (what := structure(bytes.fromhex(m[0]))):
            found[what, m.start(), m.end()] = what
    return [(*k, v) for k, v in sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confirmed", T.StringType())]))


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds secrets: array of (kind, start, end, confirmed), in order. The text column is dropped; join or redact() keep it."""
    keep = [c for c in df.columns if c not in ("secrets", text)]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("secrets", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confirmed", pa.string())]))

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(batch.num_columns - 1):
                found = scan(raw.as_py().decode("utf-8", "replace")) if raw.is_valid else []
                out.append([dict(zip(("kind", "start", "end", "confirmed"), x)) for x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*keep, "secrets"])

    return source.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", marker: str = "[secret]") -> DataFrame:
    """The rows with every secret's span replaced by the marker (overlapping spans by one); null texts stay null."""
    names = df.columns
    at = names.index(text)
    source = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names])

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, done = [], 0
        for _, start, end, _ in scan(value):
            if start >= done:
                out += [value[done:start], marker]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([clean(x) for x in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        give_back()

    return source.mapInArrow(run, source.schema)
