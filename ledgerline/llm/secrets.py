"""Secret scans with a recursive decoding worklist.

A text is scanned, then its URL escapes, Unicode escapes, base64 tokens and compressed payloads are unwrapped into
further layers, which are scanned and unwrapped in turn until no new layer appears. A layer that was seen before is not
worked again, which ends cycles. Findings of a layer carry the span of the original text that they came from.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _small
from .common import table

#: The patterns of the base scan, in the order in which equal starts are listed, and the least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
NAMES = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
#: The shortest finding, ``token=`` and eight characters, has 19 characters of base64 without its padding.
LEAST_BODY = 19
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
#: Tokens that go on over line breaks, indented or quoted; each quantifier is possessive, so that matching is linear.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n|\n|\r)[ \t>]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Read backwards from a window's end: whatever a token, an escape or a match could still be open in, joined over line
#: breaks and over the blanks that an assignment may have; before it, the rest of a character.
OPEN = re.compile(rb"[\x80-\xff]{0,3}+(?:[A-Za-z0-9+/_.=%\\{}\"':-]|[ \t>]*+[\r\n]++[ \t]*+)*+(?:\x20++[A-Za-z0-9+/_.=%\\{}\"':-]*+){0,2}+")
JOINT = re.compile(r"[+/_-]")
WIDE = re.compile(r"[\t\n\r\x20-\x7e](?:\x00[\t\n\r\x20-\x7e]){7,}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
URL_SAFE = str.maketrans("-_", "+/")


class Layer(NamedTuple):
    """A text and, for each of its characters, where it starts and ends in the original; ints mean one span for all, None the original itself."""

    text: str
    starts: np.ndarray | int | None = None
    ends: np.ndarray | int | None = None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[a]), int(self.ends[b - 1])

    def mark(self) -> tuple[int | None, str | bytes]:
        """What tells a layer from others: its text, or a digest of a long one, and where it starts."""
        text = self.text if len(self.text) < 128 else hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        first = self.starts if self.starts is None or isinstance(self.starts, int) else int(self.starts[0])
        return first, text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base scan, sorted; kinds by number in ``KINDS``."""
    found = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")


def _escape(run: str) -> str:
    points = [int(next(filter(None, groups)), 16) for groups in ESCAPED.findall(run)]
    units = (p.to_bytes(2, "little") if p < 0x10000 else chr(min(p, 0x10FFFF)).encode("utf-16-le") for p in points)
    return b"".join(units).decode("utf-16-le", "surrogatepass")


def _spliced(layer: Layer, pattern: re.Pattern, decoded) -> Iterator[Layer]:
    """The layer with every run replaced by what it stands for, bad bytes by marks; other characters keep their own spans."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    if layer.starts is None:
        own = ends_of = None
    elif isinstance(layer.starts, int):
        own, ends_of = np.full(len(text), layer.starts), np.full(len(text), layer.ends)
    else:
        own, ends_of = layer.starts, layer.ends
    if own is None:
        own, ends_of = np.arange(len(text)), np.arange(1, len(text) + 1)
    for m in pattern.finditer(text):
        new = decoded(m[0])
        a, b = m.span()
        parts += [text[at:a], new]
        starts += [own[at:a], np.full(len(new), own[a])]
        ends += [ends_of[at:a], np.full(len(new), ends_of[b - 1])]
        at = b
    if parts:
        yield Layer("".join([*parts, text[at:]]), np.concatenate([*starts, own[at:]]), np.concatenate([*ends, ends_of[at:]]))


def _inflated(data: bytes | memoryview, window: int) -> Iterator[str]:
    """Text of gzip or zlib data, all members in turn, in windows that end where no token or match is open.

    What is open at a window's end is kept back to its start, so memory follows the window and the longest such run.
    """
    kept: list[bytes] = []
    for made in _unpacked(data, window):
        open_at = len(made) - OPEN.match(made[::-1]).end()
        if open_at:
            yield b"".join([*kept, made[:open_at]]).decode("utf-8", "surrogateescape")
            kept = []
        kept.append(made[open_at:])
    if any(kept):
        yield b"".join(kept).decode("utf-8", "surrogateescape")


def _unpacked(data: bytes | memoryview, window: int) -> Iterator[bytes]:
    """What the members of compressed data unpack to, as far as they can be unpacked."""
    view, at = memoryview(data), 0
    try:
        while at < len(view) and (at == 0 or _compressed(view[at : at + 2])):
            unpack = zlib.decompressobj(47)
            while not unpack.eof:
                rest = unpack.unconsumed_tail
                if not rest and at < len(view):
                    rest = bytes(view[at : at + (1 << 16)])
                    at += len(rest)
                made = unpack.decompress(rest, window)
                if made:
                    yield made
                elif not rest:
                    return
            at -= len(unpack.unused_data)
            while at < len(view) and view[at] == 0:
                at += 1
    except zlib.error:
        return


def _compressed(data: bytes | memoryview) -> bool:
    head = bytes(data[:2])
    return head == b"\x1f\x8b" or len(head) == 2 and head[0] & 15 == 8 and head[0] < 0x80 and int.from_bytes(head, "big") % 31 == 0


def _bytes(body: str) -> bytes:
    """What base64 without padding stands for; a single last character is none."""
    body = body[: len(body) - (len(body) % 4 == 1)].translate(URL_SAFE)
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _base64(layer: Layer, window: int) -> Iterator[Layer]:
    """Every token decoded, whatever its bytes are, and what it unpacks to where it looks compressed.

    A token may have something else before it that is spelled with the same signs (``blob/...``, ``k-...``). So it is read
    from its start and from behind each sign that is no letter or digit, once for each of the four alignments.
    """
    for m in TOKEN.finditer(layer.text):
        body = m[0].rstrip("=")
        begins = np.array([0, *(x.end() for x in JOINT.finditer(body))])
        for turn in range(4):
            own = begins[begins % 4 == turn]
            if not len(own) or len(body) - own[0] < LEAST_BODY:
                continue
            first = int(own[0])
            data = _bytes(body[first:])
            view = memoryview(data)
            end = layer.origin(*m.span())[1]
            for k in own.tolist():
                packed = view[(k - first) // 4 * 3 :]
                if _compressed(packed[:2]):
                    start = layer.origin(m.start() + k, m.end())[0]
                    for text in _inflated(packed, window):
                        yield Layer(text, start, end)
            yield Layer(data.decode("utf-8", "surrogateescape"), layer.origin(m.start() + first, m.end())[0], end)


def _wide(layer: Layer) -> Iterator[Layer]:
    """Stretches of characters with a zero between each two, as UTF-16 has them, without the zeros."""
    for m in WIDE.finditer(layer.text):
        if layer.starts is None:
            at = np.arange(m.start(), m.end(), 2)
            yield Layer(m[0][::2], at, at + 1)
        elif isinstance(layer.starts, int):
            yield Layer(m[0][::2], layer.starts, layer.ends)
        else:
            yield Layer(m[0][::2], layer.starts[m.start() : m.end() : 2], layer.ends[m.start() : m.end() : 2])


def _wrapped(layer: Layer, window: int) -> Iterator[Layer]:
    """Tokens joined over line breaks, read from the first piece of each of the four alignments.

    Findings map to the lines that they come from. Compressed data may begin with any piece.
    """
    for m in WRAPPED.finditer(layer.text):
        spans = [p.span() for p in PIECE.finditer(layer.text, *m.span())]
        spans_to = [*(b for _, b in spans[:-1]), m.end()]
        at = np.concatenate([[0], np.cumsum([b - a for a, b in spans])])
        if at[-1] < LEAST_BODY:
            continue
        body, at = "".join(layer.text[a:b] for a, b in spans), at[:-1]
        origins = [layer.origin(a, b) for (a, _), b in zip(spans, spans_to, strict=True)]
        starts, ends = np.array([a for a, _ in origins]), np.array([b for _, b in origins])
        for turn in range(4):
            own = np.flatnonzero(at % 4 == turn)
            if not len(own):
                continue
            first = int(at[own[0]])
            data = _bytes(body[first:])
            view = memoryview(data)
            for k in own.tolist():
                begin = (int(at[k]) - first) // 4 * 3
                if _compressed(view[begin : begin + 2]):
                    used = _packed_length(view[begin:], window)
                    if used:
                        last = int(np.searchsorted(at, first + (8 * (begin + used) - 1) // 6, "right")) - 1
                        for text in _inflated(view[begin:], window):
                            yield Layer(text, int(starts[k]), int(ends[last]))
            text = data.decode("utf-8", "surrogateescape")
            if isinstance(layer.starts, int):
                yield Layer(text, layer.starts, layer.ends)
            elif text:
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
                width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
                to = np.cumsum(width, dtype=np.int64)
                head = np.searchsorted(at, first + 8 * (to - width) // 6, "right") - 1
                tail = np.searchsorted(at, first + (8 * to - 1) // 6, "right") - 1
                yield Layer(text, starts[head], ends[tail])


def _packed_length(data: memoryview, window: int) -> int:
    """How many bytes compressed data takes up, all members together; 0 if nothing can be unpacked."""
    at, made = 0, False
    try:
        while at < len(data) and (at == 0 or _compressed(data[at : at + 2])):
            unpack = zlib.decompressobj(47)
            while at < len(data) and not unpack.eof:
                rest = bytes(data[at : at + (1 << 16)])
                at += len(rest)
                while rest and not unpack.eof:
                    made = bool(unpack.decompress(rest, window)) or made
                    rest = unpack.unconsumed_tail
            at -= len(unpack.unused_data)
            while at < len(data) and data[at] == 0:
                at += 1
    except zlib.error:
        return len(data) if made else 0
    return at if made else 0


def _inner(layer: Layer, window: int) -> Iterator[Layer]:
    """What a layer unwraps to, one step deep."""
    if "%" in layer.text:
        yield from _spliced(layer, PERCENT, _percent)
    if "\\" in layer.text:
        yield from _spliced(layer, ESCAPE, _escape)
    if "\0" in layer.text:
        yield from _wide(layer)
    yield from _base64(layer, window)
    if "\n" in layer.text or "\r" in layer.text:
        yield from _wrapped(layer, window)


def scan_text(text: str | None, window: int = 16 << 20) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, whether the base scan has it) of all findings, sorted; a null text has none.

    The worklist holds one unfinished layer for each depth: a layer's windows and tokens are unwrapped and worked one after
    another, so what is held at once does not grow with what a layer unpacks to.
    """
    if not text:
        return []
    base = base_spans(text)
    found, kept = {s: True for s in base}, set(base)
    work, seen = [iter((Layer(text),))], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = layer.mark()
        if mark in seen:
            continue
        seen.add(mark)
        if layer.starts is not None:
            for a, kind, b in base_spans(layer.text):
                start, end = layer.origin(a, b)
                found.setdefault((start, kind, end), False)
        work.append(_inner(layer, window))
    return sorted((a, kind, b, (a, kind, b) in kept) for a, kind, b in found)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``findings``, an array of (kind, start, end, base), ends exclusive, in code points of the original text.

    Null and empty texts have empty arrays; repeated rows are scanned each; other columns stay behind.
    """
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("findings array<struct<kind: string, start: long, end: long, base: boolean>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for whole in batches:
            for batch in _small(whole):
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in scan_text(t)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every finding, merged where they overlap, replaced by ``mark``."""
    found = scan_text(text)
    if not found:
        return text
    parts, at = [], 0
    for a, b in _merged([(a, b) for a, _, b, _ in found]):
        parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, ``text`` without its secrets. Rows are neither dropped nor added; null texts stay null."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                made = [redact_text(t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents: counts and digest of the base scan, and all spans. Null: empty."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


QUERIES = {"op8_secrets": op8_secrets}
ORACLE_SQL: dict[str, str] = {}
