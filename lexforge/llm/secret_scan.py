"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned for secrets and for encoded
stretches (URL escapes, Unicode and hexadecimal escapes, HTML references, base64
in both alphabets, and gzip, zlib, bzip2 or xz data inside base64); each stretch
is decoded into a further layer and put on the worklist, until nothing new comes
out. Cycles end: below one encoded stretch a content met before is not entered
again. A stretch that stands several times in a document is decoded once, and its
findings are given at each of its places. Compressed data is read to its end,
all members of it, in overlapping pieces. Guards against compression bombs
(``LAYER_BYTES`` and the others) are wide; a stretch that isn't read to its end
has a finding ``unread_layer`` and is redacted. Every layer keeps the span of the
original text it came from: for escapes character by character, for base64 and
compressed data the encoded stretch.

Defined cases: null and empty texts have no findings and stay as they are.
Findings at one span are given once for each kind; of several ways to it the least
deep is named. An empty table has no findings. Rows with a null doc_id are
scanned; their findings have a null doc_id. Repeated rows give repeated
findings. Other columns pass through ``redact`` unchanged, but for ``n_chars``,
which follows the redacted text where it was the text's length before. Whole
texts are scanned, of any length.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textarrays as ta
from .common import table

#: Guards against compression bombs: bytes of one packed layer, its longest run of
#: base64, layers packed into one another, and decoded characters of a document.
#: What goes on beyond them has a finding of the kind ``UNREAD``.
LAYER_BYTES, LONGEST_RUN, MAX_NESTED, DOCUMENT_BYTES = 1 << 28, 1 << 25, 100, 1 << 31
UNREAD = "unread_layer"
_PIECE, _OVERLAP = 1 << 20, 1 << 16
_RUN = re.compile(r"[A-Za-z0-9+/_=\s-]*")

#: kind: pattern; the secret is group 1, or the whole match.
SECRETS = {
    "aws_access_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "github_token": r"\b(gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})\b",
    "slack_token": r"\b(xox[abeoprs]-[A-Za-z0-9-]{10,250})",
    "google_api_key": r"\b(AIza[0-9A-Za-z_-]{35})",
    "stripe_key": r"\b([sr]k_(?:live|test)_[0-9A-Za-z]{16,128})\b",
    "private_key": r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z))",
    "json_web_token": r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "url_password": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/:@]{3,128})@",
    "assigned_secret": r"(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[\"']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}[\"']([^\s\"']{8,256})[\"']",
    "bare_assigned_secret": r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[ \t]{0,4}(?:=|:)[ \t]{0,4}([A-Za-z0-9+/_=-]{20,256})(?![^\s,;.)\]}&])",
}
#: A text without any of these has no secret of that kind: found fast, as plain strings.
_ALWAYS = {
    "aws_access_key": ("AKIA", "ASIA"),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "slack_token": ("xox",),
    "google_api_key": ("AIza",),
    "stripe_key": ("k_live_", "k_test_"),
    "private_key": ("PRIVATE KEY-----",),
    "json_web_token": ("eyJ",),
    "url_password": ("://",),
}
_NAMES = ("token", "secret", "passw", "pwd", "key")
_PATTERNS = {k: re.compile(p) for k, p in SECRETS.items()}
#: Bits a character that a value of a name = value pair must carry.
MIN_ENTROPY = 2.5

_ESCAPED = re.compile(
    r"(?P<url>(?:%[0-9A-Fa-f]{2})+)|(?P<u>(?:\\u[0-9A-Fa-f]{4})+)|(?P<U>\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})|(?P<x>(?:\\x[0-9A-Fa-f]{2})+)|(?P<ref>&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,12});)"
)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?={0,2}")
#: Text of some length in other bytes, and the start of packed data.
_TEXT = re.compile(rb"(?:[\t\r\n -~]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00")
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))


def entropy(s: str) -> float:
    return -sum((c / len(s)) * math.log2(c / len(s)) for c in (s.count(x) for x in set(s))) if s else 0.0


def secrets_in(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret in one layer."""
    kinds = [k for k, marks in _ALWAYS.items() if any(m in text for m in marks)]
    low = text.lower()
    if any(n in low for n in _NAMES):
        kinds += ["assigned_secret", "bare_assigned_secret"]
    out = []
    for kind in kinds:
        for m in _PATTERNS[kind].finditer(text):
            a, b = m.span(1)
            if kind.endswith("assigned_secret") and entropy(text[a:b]) < MIN_ENTROPY:
                continue
            out.append((a, b, "assigned_secret" if kind.startswith("bare_") else kind))
    return sorted(set(out))


def _unescape(m: re.Match) -> list[tuple[str, int, int]]:
    """The characters that an escaped run stands for, each with its place in the run."""
    s = m[0]
    if m["url"] or m["x"]:
        wide = 3 if m["url"] else 4
        data = bytes.fromhex(s.replace("%", "") if m["url"] else "".join(s.split("\\x")))
        out = data.decode("utf-8", "replace")
        ends = [0]
        for c in out:
            ends.append(ends[-1] + len(c.encode()) * wide)
        if "\ufffd" in out:  # not UTF-8: the bytes can't be told apart
            return [(c, 0, len(s)) for c in out]
        return list(zip(out, ends, ends[1:]))
    if m["u"]:
        out = bytes.fromhex("".join(s.split("\\u"))).decode("utf-16-be", "replace")
        ends = [0]
        for c in out:
            ends.append(ends[-1] + (12 if ord(c) > 0xFFFF else 6))
        return list(zip(out, ends, ends[1:]))
    if m["U"]:
        n = int(s[2:].strip("{}"), 16)
        return [(chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd", 0, len(s))]
    out = html.unescape(s)
    return [] if out == s else [(c, 0, len(s)) for c in out]


class _Unread(Exception):
    """A layer that goes on beyond its account."""


def _opener(head: bytes):
    for magic, name in _MAGIC:
        if head.startswith(magic):
            return {"gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[name](), name
    if len(head) > 2 and head[0] & 0x8F == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(), "zlib"
    return None, ""


def _members(chunks: Iterator[bytes], names: list[str], level: int) -> Iterator[bytes]:
    """Compressed data opened, member after member, in pieces; other data as it is.
    ``names`` gets the compressions, the outermost first."""
    head = b""
    for more in chunks:
        head += more
        if len(head) >= 6:
            break
    machine, name = _opener(head)
    rest = chain([head] if head else [], chunks)
    if machine is None:
        yield from rest
        return
    if level >= MAX_NESTED:
        raise _Unread
    names.append(name)
    yield from _members(_inflated(rest, machine), names, level + 1)


def _inflated(chunks: Iterator[bytes], machine) -> Iterator[bytes]:
    size = 0
    for data in chunks:
        while data or machine is not None:
            if machine is None:  # between members: the next one, or data that isn't packed
                while len(data) < 6 and (more := next(chunks, b"")):
                    data += more
                machine, _ = _opener(data)
                if machine is None:
                    yield data
                    yield from chunks
                    return
            out = machine.decompress(data, _PIECE)
            data = getattr(machine, "unconsumed_tail", b"")
            size += len(out)
            if size > LAYER_BYTES:
                raise _Unread
            if out:
                yield out
            if machine.eof:
                data, machine = machine.unused_data.lstrip(b"\0"), None
                if not data:
                    break
            elif not data and (len(out) < _PIECE if hasattr(machine, "unconsumed_tail") else machine.needs_input):
                break


def _plain(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.9 * len(text)


def _pieces(data: bytes, names: list[str]) -> Iterator[str]:
    """The text in compressed data, in pieces that overlap: a stretch of base64 or
    a key that runs into a piece's end is in the next one again, from its start."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held, size = "", _PIECE
    fault = False
    try:
        for out in _members(iter([data]), names, 0):
            held += decoder.decode(out)
            if len(held) >= size:
                tail = _RUN.search(held[::-1])
                keep = min(len(held) - _OVERLAP, len(held) - tail.end() - 128)
                if keep < len(held) // 2 and len(held) < LONGEST_RUN:
                    size = 2 * len(held)  # mostly one run: more of it first
                    continue
                yield held
                if keep < len(held) // 2:
                    fault = True
                    keep = len(held) - _OVERLAP
                held, size = held[max(0, keep) :], _PIECE + len(held) - max(0, keep)
    except (ValueError, zlib.error, OSError, EOFError, lzma.LZMAError):
        if not held and not names:
            return
    except _Unread:
        fault = True
    if held:
        yield held
    if fault:
        raise _Unread


def _decoded(s: str) -> bytes | None:
    compact = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(compact) % 4 == 1:
        return None
    try:
        return base64.b64decode(compact + "=" * (-len(compact) % 4))
    except (ValueError, binascii.Error):
        return None


def _readings(s: str) -> Iterator[tuple[bytes, int, int]]:
    """The bytes that a base64 stretch may stand for, with their place in it: the
    whole, without a short last line, its lines; then, if none of these is text,
    what looks like text or packed data at the four alignments."""
    lines = [m.span() for m in re.finditer(r"[^\r\n]+", s)]
    whole = [(0, len(s))]
    if len(lines) > 1:
        whole += [(0, lines[-2][1]), *lines]
    some = False
    for a, b in whole:
        data = _decoded(s[a:b])
        if data is not None and _told(data):
            some = True
            yield data, a, b
    if some:
        return
    at = [i for i, c in enumerate(s) if c not in "\r\n="]
    compact = "".join(s[i] for i in at).replace("-", "+").replace("_", "/")
    after = [i + 1 for i, c in enumerate(compact) if c in "+/"]
    for k in range(4):
        body = compact[k:]
        body = body[: len(body) - 1] if len(body) % 4 == 1 else body
        if not body:
            continue
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        starts = {(p - k) // 4 * 3 for p in after if p >= k and (p - k) % 4 == 0}
        for m in _TEXT.finditer(data):
            for i in sorted({m.start(), *(j for j in range(m.start() + 1, min(m.start() + 9, m.end())) if j in starts)}):
                yield data[i : m.end()], at[min(i // 3 * 4 + k, len(at) - 1)], at[min(-(-m.end() // 3) * 4 + k, len(at)) - 1] + 1
        packed = {m.start() for m in _PACKED.finditer(data)} | {i for i in starts if _opener(data[i : i + 6])[0] is not None}
        for i in sorted(packed):
            yield data[i:], at[min(i // 3 * 4 + k, len(at) - 1)], len(s)


def _told(data: bytes) -> bool:
    try:
        return _plain(data.decode("utf-8"))
    except ValueError:
        return _opener(data)[0] is not None


def _layers(data: bytes) -> Iterator[tuple[str, tuple[str, ...]]]:
    """(text, encodings) of what the bytes hold; raises _Unread at what is left."""
    try:
        text = data.decode("utf-8")
    except ValueError:
        text = ""
    if _plain(text):
        yield text, ("base64",)
    if _opener(data)[0] is not None:
        names: list[str] = []
        for text in _pieces(data, names):
            yield text, ("base64", *names)


class _Document:
    """What was decoded so far of one document: bytes, and each stretch's findings."""

    def __init__(self):
        self.size = 0
        self.known: dict[str, list[tuple[int, int, str, tuple[str, ...]]]] = {}

    def stretch(self, s: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """(start, end, kind, encodings) of each secret inside an encoded stretch, the
        least deep of a kind. Decoded once: a copy has the findings of the first."""
        if s not in self.known:
            found: dict[tuple[int, int, str], tuple[str, ...]] = {}
            for data, a, b in _readings(s):
                for kind, path in self._inside(data).items():
                    if not any(x <= a and b <= y and k == kind for x, y, k in found):
                        found[a, b, kind] = path
            self.known[s] = [(*key, path) for key, path in found.items()]
        return self.known[s]

    def _inside(self, data: bytes) -> dict[str, tuple[str, ...]]:
        found: dict[str, tuple[str, ...]] = {}
        seen: set[bytes] = set()
        # stretches still to be decoded: nothing of what is inside is held meanwhile
        work: list[tuple[bytes | str, tuple[str, ...]]] = [(data, ())]
        while work:
            inner, path = work.pop(0)
            for part in [inner] if isinstance(inner, bytes) else (data for data, _, _ in _readings(inner)):
                try:
                    for layer, names in _layers(part):
                        at = (*path, *names)
                        while (key := hashlib.sha256(layer.encode("utf-8", "replace")).digest()) not in seen:
                            seen.add(key)
                            self.size += len(layer)
                            if self.size > DOCUMENT_BYTES:
                                raise _Unread
                            for _, _, kind in secrets_in(layer):
                                if len(found.get(kind, at)) >= len(at):
                                    found[kind] = at
                            work += [(m[0], at) for m in _BASE64.finditer(layer)]
                            layer, kinds, _, _ = _unescaped(layer, None, None, False)
                            if not kinds:
                                break
                            at = (*at, kinds)
                except _Unread:
                    found.setdefault(UNREAD, (*path, "base64"))
        return found


def _unescaped(layer: str, starts: list[int] | None, ends: list[int] | None, mapped: bool) -> tuple[str, str, list[int] | None, list[int] | None]:
    """The layer with its escapes read, their names ("" if it has none), and, if
    ``mapped``, the original start and end of each character."""
    if not ("%" in layer or "\\" in layer or "&" in layer):
        return layer, "", starts, ends
    parts, s2, e2, kinds, at = [], [], [], set(), 0
    for m in _ESCAPED.finditer(layer):
        new = _unescape(m)
        if not new:
            continue
        kinds.add("url" if m["url"] else "html" if m["ref"] else "unicode")
        if mapped:
            s2 += range(at, m.start()) if starts is None else starts[at : m.start()]
            e2 += range(at + 1, m.start() + 1) if ends is None else ends[at : m.start()]
            spans = [_span(m.start() + a, m.start() + b, starts, ends) for _, a, b in new]
            s2 += [a for a, _ in spans]
            e2 += [b for _, b in spans]
        parts += [layer[at : m.start()], "".join(c for c, _, _ in new)]
        at = m.end()
    if not parts:
        return layer, "", starts, ends
    if mapped:
        s2 += range(at, len(layer)) if starts is None else starts[at:]
        e2 += range(at + 1, len(layer) + 1) if ends is None else ends[at:]
    return "".join([*parts, layer[at:]]), "+".join(sorted(kinds)), s2, e2


def _span(a: int, b: int, starts: list[int] | None, ends: list[int] | None) -> tuple[int, int]:
    return (a, b) if starts is None or ends is None else (starts[a], max(ends[a:b]))


def scan(text: str | None) -> list[tuple[int, int, str, str, int]]:
    """(start, end, kind, encodings from the outside, depth), by place in the text."""
    if not text:
        return []
    document = _Document()
    found: dict[tuple[int, int, str], tuple[str, ...]] = {}
    placed: set[tuple[int, str]] = set()

    def add(span: tuple[int, int], kind: str, path: tuple[str, ...]) -> None:
        if len(found.get((*span, kind), path)) >= len(path):
            found[*span, kind] = path

    # the text, then the same with its escapes read, as long as there are any:
    # each reading is shorter; starts and ends are its characters' places in the text
    layer, starts, ends, path = text, None, None, ()
    while True:
        for a, b, kind in secrets_in(layer):
            add(_span(a, b, starts, ends), kind, path)
        for m in _BASE64.finditer(layer):
            a = _span(*m.span(), starts, ends)[0]
            # a later reading may only add padding, which was escaped
            if (a, m[0].rstrip("=")) not in placed:
                placed.add((a, m[0].rstrip("=")))
                for i, j, kind, inner in document.stretch(m[0]):
                    add(_span(m.start() + i, m.start() + j, starts, ends), kind, (*path, *inner))
        layer, kinds, starts, ends = _unescaped(layer, starts, ends, True)
        if not kinds:
            break
        document.size += len(layer)
        if document.size > DOCUMENT_BYTES:
            add(_span(0, len(layer), starts, ends) if starts is None else (min(starts), max(ends)), UNREAD, path)
            break
        path = (*path, kinds)
    return [(a, b, kind, ">".join(path), len(path)) for (a, b, kind), path in sorted(found.items())]


def redacted(text: str | None) -> str | None:
    """The text with each secret's span replaced by its kind; overlapping spans as one."""
    spans = scan(text)
    if not spans or text is None:
        return text
    out, at = [], 0
    while spans:
        a, b, kind, *_ = spans.pop(0)
        while spans and spans[0][0] < b:
            b = max(b, spans.pop(0)[1])
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for f in scan(t)]
        names = ["doc_id", "start", "stop", "kind", "encodings", "depth"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, start and stop (characters of the text), kind, encodings, depth."""
    from pyspark.sql import functions as F

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_find, "doc_id long, start long, stop long, kind string, encodings string, depth int")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each secret in ``text`` replaced by ``[KIND]``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k = names.index("text")
            text = batch.column(k)
            before = text.to_pylist()
            after = [redacted(t) for t in before]
            if after != before:
                batch = batch.set_column(k, batch.schema.field(k), pa.array(after, text.type))
                if "n_chars" in names:
                    n = names.index("n_chars")
                    counts = [len(b) if t is not None and c == len(t) and b is not None else c for t, b, c in zip(before, after, batch.column(n).to_pylist())]
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(counts, batch.column(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
