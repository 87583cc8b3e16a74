"""Secret scans with a recursive decoding worklist.

Every text is a first layer.  A layer is scanned for the three kinds of secrets, then
unwrapped: percent escapes, backslash and character-reference Unicode escapes, base64 runs
(also wrapped over lines, and glued to letters in front), and compressed bytes (gzip, zlib,
bzip2, xz, any member, any depth) inside base64.  Each result that was not seen at its place
goes on the worklist and is scanned in turn, until none is left; the set of seen layers with their
places ends cycles, and equal blobs at several places are all found.  Decoded bytes are read as UTF-8,
else as Latin-1, and as UTF-16 where a quarter of them is zero; nothing is thrown away for
characters that cannot be printed.

Spans of a deeper layer are mapped back: escapes character by character, base64 runs as a
whole.  A layer of escapes holds only the words around them: a secret spans three words at most
(name, sign, value), so three on either side are enough, and a long text is not copied per layer.

Work is bounded: a layer above ``most_bytes``, and layers past ``most_total`` bytes of one document
together, are not unpacked; their number is ``oversize``, and ``redacted`` covers their whole run, so that
nothing unread stays in the text.

Defined results: null and empty texts have no spans; each row is scanned by itself, so
repeated rows and null ids change nothing.  Columns of any names are carried unchanged; ``scan`` refuses ``keep``
columns named like its own results.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cellview.llm.common import text_batches

KINDS = ("assign", "access", "hex")
# fixed values: the patterns of the three kinds
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAP = re.compile(r"\r?\n[\x20\t]*")
# a further line of a wrapped run stands alone on its line
_LINE = re.compile(r"""[A-Za-z0-9+/_-]{2,}={0,2}(?=[\x20\t\r]*(?:\n|$|["'<,;)]))""")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
# what any further span, escape or layer begins with
_PROMISING = re.compile(rb"(?i:passw|secret|token|api)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uxU]|&[#A-Za-z]|\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ")
CONTEXT_WORDS = 3


@dataclass(frozen=True)
class Unwrapping:
    most_bytes: int = 1 << 26  # of one unpacked layer
    most_total: int = 1 << 28  # of all unpacked layers of a document


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of one layer, by start, then kind as listed."""
    found = []
    low = text.lower() if any(c.isupper() for c in text) else text
    if any(hint in low for hint in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


class _Layer:
    """A text and the spans of the document that its characters stand for: one each, or one for all."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[start], self.ends[end - 1]

    def place(self) -> tuple[bytes, int, int]:
        """Digest of the text, and the region of the document that it stands for."""
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *self.span(0, len(self.text)))

    def part(self, start: int, end: int) -> _Layer:
        if isinstance(self.starts, int):
            return _Layer(self.text[start:end], self.starts, self.ends)
        return _Layer(self.text[start:end], self.starts[start:end], self.ends[start:end])

    def around(self, pattern: re.Pattern) -> list[_Layer]:
        """Parts with the escapes of ``pattern`` and ``CONTEXT_WORDS`` words on either side; near ones together."""
        regions: list[list[int]] = []
        for m in pattern.finditer(self.text):
            if regions and m.start() < regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], _words_after(self.text, m.end()))
                continue
            begin = _words_before(self.text, m.start(), regions[-1][1] if regions else 0)
            if regions and begin <= regions[-1][1]:
                regions[-1][1] = _words_after(self.text, m.end())
            else:
                regions.append([begin, _words_after(self.text, m.end())])
        return [self.part(s, e) for s, e in regions]

    def rewritten(self, pattern: re.Pattern, decode) -> _Layer | None:
        out, starts, ends, at, changed, flat = [], [], [], 0, False, isinstance(self.starts, int)
        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is None or new == m[0]:
                continue
            changed = True
            out += [self.text[at : m.start()], new]
            if not flat:
                starts += [*self.starts[at : m.start()], *[self.starts[m.start()]] * len(new)]
                ends += [*self.ends[at : m.start()], *[self.ends[m.end() - 1]] * len(new)]
            at = m.end()
        text = "".join([*out, self.text[at:]])
        if not changed or not text:
            return None
        if flat:
            return _Layer(text, self.starts, self.ends)
        return _Layer(text, [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])


def _words_before(text: str, at: int, least: int) -> int:
    """Where the context in front of ``at`` begins, not before ``least``."""
    words, inside = 0, True
    while at > least:
        blank = text[at - 1].isspace()
        if inside and blank:
            words, inside = words + 1, False
            if words > CONTEXT_WORDS:
                break
        elif not blank:
            inside = True
        at -= 1
    return at


def _words_after(text: str, at: int) -> int:
    words, inside, n = 0, True, len(text)
    while at < n:
        blank = text[at].isspace()
        if inside and blank:
            words, inside = words + 1, False
            if words > CONTEXT_WORDS:
                break
        elif not blank:
            inside = True
        at += 1
    return at


def _percent(escape: str) -> str | None:
    try:
        return unquote_to_bytes(escape).decode("utf-8")
    except UnicodeDecodeError:
        return unquote_to_bytes(escape).decode("latin-1")


def _unicode(escape: str) -> str | None:
    if escape[0] == "&":
        return html.unescape(escape)
    codes = [int(x, 16) for x in re.findall(r"[0-9A-Fa-f]+", escape.replace("\\u", " ").replace("\\x", " ").replace("\\U", " "))]
    if escape[1] == "u":  # surrogate pairs
        return b"".join(c.to_bytes(2, "big") for c in codes).decode("utf-16-be", "replace")
    return "".join(chr(c) for c in codes if c < 0x110000)


class _Budget:
    """What may still be unpacked for one document."""

    def __init__(self, plan: Unwrapping):
        self.most, self.left = plan.most_bytes, plan.most_total

    def unpacked(self, data: bytes) -> tuple[bytes, bytes] | None:
        """The first compressed member of ``data`` and what follows it; None if there is none.

        A damaged end keeps what came before it.  Raises OverflowError beyond the bounds.
        """
        if data[:3] == b"\x1f\x8b\x08":
            machine = zlib.decompressobj(31)
        elif data[:3] == b"BZh":
            machine = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            machine = lzma.LZMADecompressor()
        elif data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
            machine = zlib.decompressobj()
        else:
            return None
        limit, pieces, size = min(self.most, self.left), [], 0
        for at in range(0, len(data), 1 << 16):
            try:
                pieces.append(machine.decompress(data[at : at + (1 << 16)], limit + 1 - size))
                size += len(pieces[-1])
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                break
            if size > limit:
                raise OverflowError
            if machine.eof:
                break
        self.left -= size
        rest = machine.unused_data + data[at + (1 << 16) :] if machine.eof else b""
        return (b"".join(pieces), rest) if size else None


def _byte_layers(data: bytes, budget: _Budget):
    """``data`` and everything unpacked from it, to any depth; equal bytes once."""
    todo, seen = [data], set()
    while todo:
        data = todo.pop()
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        yield data
        at = {0} | {m.start() for m in _MAGIC.finditer(data)}
        for start in sorted(at):
            found = budget.unpacked(data[start:] if start else data)
            if found:
                todo += [d for d in found if d]


def _texts(data: bytes) -> list[str]:
    """Readings of bytes that may hold a span or a further layer."""
    zeros = data.count(0) * 4 >= len(data)
    if not zeros and not _PROMISING.search(data):
        return []
    try:
        out = [data.decode("utf-8")]
    except UnicodeDecodeError:
        out = [data.decode("latin-1")]
    if zeros or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        out += [data.decode(code, "ignore") for code in ("utf-16-le", "utf-16-be")]
    return [t for t in out if t]


def _base64_bytes(run: str, skip: int) -> bytes:
    body = run[skip:].rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _base64_runs(text: str):
    """(start, end, run) of base64 runs, and of runs that go on over line breaks."""
    done = 0
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
        if m.start() < done:
            continue
        lines, end = [m[0]], m.end()
        while not lines[-1].endswith("=") and (gap := _WRAP.match(text, end)) and (more := _LINE.match(text, gap.end())):
            lines.append(more[0])
            end = more.end()
        done = end
        if len(lines) > 1:
            yield m.start(), end, "".join(lines)


def _decoded(run: str, budget: _Budget) -> list[str]:
    """Texts inside a base64 run.  Letters glued to its front shift the groups of four, so every shift is tried
    unless the run reads well as it is."""
    out = []
    for skip in range(4):
        data = _base64_bytes(run, skip)
        if not data:
            continue
        for layer in _byte_layers(data, budget):
            out += _texts(layer)
        if not skip and data.isascii() and data.decode("ascii").isprintable():
            break
    return out


def all_spans(text: str, plan: Unwrapping = Unwrapping()) -> tuple[list[tuple[int, int, str]], int]:
    """Spans of all layers in the coordinates of the text, and the number of runs too large to unpack."""
    spans, opaque = unwrapped(text, plan)
    return spans, len(opaque)


def unwrapped(text: str, plan: Unwrapping = Unwrapping()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans of all layers in the coordinates of the text, and the runs with layers too large to unpack."""
    spans, opaque, budget = set(base_spans(text)), [], _Budget(plan)
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    if not text or ("%" not in text and "\\" not in text and "&" not in text and not _BASE64.search(text)):
        return sorted(spans, key=order), []
    first = _Layer(text, range(len(text)), range(1, len(text) + 1))
    seen, work = set(), [first]
    while work:
        layer = work.pop()
        if layer is not first:
            spans |= {(*layer.span(s, e), kind) for s, e, kind in base_spans(layer.text)}
        following = []
        for marks, pattern, decode in (("%", _PERCENT, _percent), ("\\&", _UNICODE, _unicode)):
            if any(m in layer.text for m in marks):
                following += [part.rewritten(pattern, decode) for part in layer.around(pattern)]
        for start, end, run in _base64_runs(layer.text):
            place = layer.span(start, end)
            try:
                following += [_Layer(inner, *place) for inner in _decoded(run, budget)]
            except OverflowError:
                opaque.append(place)
        for new in following:
            if new is not None and (key := new.place()) not in seen:
                seen.add(key)
                work.append(new)
    return sorted(spans, key=order), opaque


def _listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans, opaque=()) -> str:
    """Text with each run of overlapping spans, and of unread runs, replaced by a mark."""
    out, at = [], 0
    for start, end in sorted([(s, e) for s, e, _ in spans] + list(opaque)):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("oversize", "long"), ("redacted", "string"))


def _scanned(docs: DataFrame, keep: list[str], plan: Unwrapping) -> DataFrame:
    """``row`` with the columns to keep, and ``found`` with the results."""
    schema = StructType([StructField("row", docs.select(*keep).schema, False), StructField("found", StructType.fromDDL(", ".join(f"{n} {t}" for n, t in FOUND)), False)])
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                spans, opaque = unwrapped(text, plan)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                clean = redacted(text, spans, opaque) if spans or opaque else text
                rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), len(opaque), clean))
            if rows:
                made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                found = pa.StructArray.from_arrays(made, names=[n for n, _ in FOUND])
                yield pa.RecordBatch.from_arrays([batch.column("row"), found], names=["row", "found"])

    return text_batches(docs).select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def scan(docs: DataFrame, keep: list[str] | None = None, plan: Unwrapping = Unwrapping()) -> DataFrame:
    """``keep`` columns with counts and digest of base spans, all spans, oversize layers and the redacted text."""
    keep = keep or ["doc_id"]
    clash = {n for n, _ in FOUND} & set(keep)
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    return _scanned(docs, keep, plan).select("row.*", "found.*")


def without_secrets(docs: DataFrame, plan: Unwrapping = Unwrapping()) -> DataFrame:
    """``docs`` with secrets, and runs too large to read, replaced in the text, and n_chars set anew where it changed."""
    clean = F.when(F.col("row.text").isNull(), None).otherwise(F.col("found.redacted"))
    same = F.coalesce(F.col("row.text").cast("string"), F.lit("")) == F.col("found.redacted")
    new = {"text": clean.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return _scanned(docs, docs.columns, plan).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
