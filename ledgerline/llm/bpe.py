"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regex: every code point gets a class, classes act on the eight states of a small automaton,
and the automaton's state before each character comes from a scan over the monoid that these transition functions
generate. Composition is associative, so the scan runs in blocks: within all blocks at once, then over the blocks by
doubling. The state and the class say whether a slice starts there. Slices feed pair merging behind a bounded cache.
The split is that of ``public_tokenizers.PATTERN``; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

FRESH, LETTER, NUMBER, OTHER, SPACE, BLANK, ONE_MORE, TWO_MORE = range(8)
#: Classes beyond the states' own: a space or other white space that stands right before a visible character, an
#: apostrophe that one or two letters make a contraction, and the end of a text.
SPACE_LAST, BLANK_LAST, SHORT_FORM, LONG_FORM, END = 6, 7, 8, 9, 10
N_STATES, N_CLASSES = 8, 11
#: White space as Unicode's White_Space property has it, and the contractions of the pattern.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_FORMS, LONG_FORMS = ("s", "t", "m", "d"), ("re", "ve", "ll")
SEPARATOR = 0x110000


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """Class of each code point; the last entry is the end of a text."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(SEPARATOR)), np.uint8, SEPARATOR)
    classes[WHITE_SPACE] = BLANK
    classes[0x20] = SPACE
    return np.append(classes, np.uint8(END))


def _step(state: int, c: int) -> tuple[int, int]:
    """(whether a slice starts at a character of class ``c``, the state after it)."""
    if c == END:
        return 1, FRESH
    if state == TWO_MORE:
        return 0, ONE_MORE
    if state == ONE_MORE:
        return 0, FRESH
    if c in (SPACE, BLANK, SPACE_LAST, BLANK_LAST):
        after = SPACE if c in (SPACE, SPACE_LAST) else BLANK
        return int(state not in (SPACE, BLANK) or c in (SPACE_LAST, BLANK_LAST)), after
    if c in (SHORT_FORM, LONG_FORM):
        if state in (OTHER, SPACE):
            return 0, OTHER
        return 1, ONE_MORE if c == SHORT_FORM else TWO_MORE
    return int(state != c and state != SPACE), c


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions' monoid: (element of each class, composition of two elements, image of FRESH, starts by state and class)."""
    functions = [tuple(_step(s, c)[1] for s in range(N_STATES)) for c in range(N_CLASSES)]
    elements: dict[tuple[int, ...], int] = {tuple(range(N_STATES)): 0}
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    known = list(elements)
    compose = np.array([[elements[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint16)
    of_class = np.array([elements[f] for f in functions], dtype=np.uint16)
    image = np.array([f[FRESH] for f in known], dtype=np.uint8)
    starts = np.array([[_step(s, c)[0] for c in range(N_CLASSES)] for s in range(N_STATES)], dtype=bool)
    return of_class, compose, image, starts


def _scan(elements: np.ndarray, compose: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix compositions."""
    n, size = len(elements), len(compose)
    flat = compose.ravel()
    rows = -(-n // block)
    grid = np.zeros((block, rows), dtype=np.uint16)
    padded = np.zeros(rows * block, dtype=np.uint16)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, block).T
    for j in range(1, block):
        grid[j] = flat[grid[j - 1].astype(np.int32) * size + grid[j]]
    before, step = grid[-1].copy(), 1
    while step < rows:
        before[step:] = flat[before[:-step].astype(np.int32) * size + before[step:]]
        step *= 2
    entry = np.concatenate([np.zeros(1, np.uint16), before[:-1]]).astype(np.int32) * size
    return flat[entry[None, :] + grid].T.ravel()[:n]


def starts_of(codepoints: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point; ``SEPARATOR`` ends a text."""
    of_class, compose, image, starts = automaton()
    cls = codepoint_classes()[codepoints]
    end = np.uint8(END)
    after = np.append(cls[1:], end)
    last = (after != SPACE) & (after != BLANK) & (after != END)
    apostrophes = np.flatnonzero(codepoints == ord("'"))
    padded = np.append(codepoints, [SEPARATOR, SEPARATOR])
    one, two = padded[apostrophes + 1], padded[apostrophes + 2]
    short = np.isin(one, [ord(c) for c in SHORT_FORMS])
    long = np.zeros(len(apostrophes), dtype=bool)
    for a, b in LONG_FORMS:
        long |= (one == ord(a)) & (two == ord(b))
    cls[last & (cls == SPACE)] = SPACE_LAST
    cls[last & (cls == BLANK)] = BLANK_LAST
    cls[apostrophes[short]] = SHORT_FORM
    cls[apostrophes[long]] = LONG_FORM
    prefix = _scan(of_class[cls], compose)
    state = np.concatenate([np.array([FRESH], np.uint8), image[prefix[:-1]]])
    return starts[state, cls]


def slices(text: str) -> list[str]:
    """The slices of one text."""
    if not text:
        return []
    at = np.flatnonzero(starts_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of the lowest rank merges first, the leftmost of equals; a heap over a linked list."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def pair(i: int) -> int | None:
        j = ends[i]
        return ranks.get(piece[i : ends[j]]) if j < n else None

    heap = [(r, i, ends[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := ends[i]) >= n or ends[j] != end:
            continue
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[ends[k]]))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class PairMerger:
    """Pair merging of many short slices at once, those of one length as rows of a matrix: each round merges every row's pair of the lowest rank, the leftmost of equals."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([*(pairs[k] for k in self.keys.tolist()), self.NONE], dtype=np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.first = self.rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What two neighbours merge into, which is its rank too; NONE if they don't."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = -1
        return np.where(self.keys[at] == wanted, self.values[at], self.NONE) if len(self.keys) else np.full(len(wanted), self.NONE, np.int32)

    def merged(self, slices: list[bytes]) -> list[bytes]:
        """Ids of slices of equal length, as little-endian bytes."""
        n, width = len(slices), len(slices[0])
        data = np.frombuffer(b"".join(slices), np.uint8).reshape(n, width)
        symbols, sizes = self.bytes[data], np.full(n, width)
        ranks = np.concatenate([self.first[data[:, :-1], data[:, 1:]], np.full((n, 1), self.NONE, np.int32)], axis=1)
        columns, rows = np.arange(width), np.arange(n)
        while len(rows):
            own = ranks[rows]
            j = own.argmin(axis=1)
            rank = own[np.arange(len(rows)), j]
            go = rank < self.NONE
            rows, own, j, rank = rows[go], own[go], j[go], rank[go]
            if not len(rows):
                break
            shift = np.minimum(columns + (columns > j[:, None]), width - 1)
            left, at = np.take_along_axis(symbols[rows], shift, 1), np.arange(len(rows))
            own = np.take_along_axis(own, shift, 1)
            left[at, j] = rank
            sizes[rows] -= 1
            own[at, sizes[rows] - 1] = self.NONE
            more = np.flatnonzero(j < sizes[rows] - 1)
            own[more, j[more]] = self.rank(rank[more], left[more, j[more] + 1])
            more = np.flatnonzero(j > 0)
            own[more, j[more] - 1] = self.rank(left[more, j[more] - 1], rank[more])
            symbols[rows], ranks[rows] = left, own
        flat = symbols[columns < sizes[:, None]].astype("<i4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]


class Cache(dict):
    """Slice to its ids as little-endian bytes; cleared when ``most`` slices are held, long slices are not held."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000, longest: int = 32):
        super().__init__()
        self.ranks, self.most, self.longest, self.pairs = ranks, most, longest, PairMerger(ranks)

    def __missing__(self, piece: str) -> bytes:
        return np.array(merge_pairs(piece.encode(), self.ranks), dtype="<i4").tobytes()

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the distinct ``pieces``; short ones that are not held are merged together."""
        if len(self) > self.most:
            self.clear()
        by_length = defaultdict(list)
        for p in pieces:
            if p not in self:
                data = p.encode()
                if (rank := self.ranks.get(data)) is not None:
                    self[p] = rank.to_bytes(4, "little")
                elif len(data) <= self.longest:
                    by_length[len(data)].append((p, data))
        for group in by_length.values():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                self.update(zip((p for p, _ in part), self.pairs.merged([d for _, d in part]), strict=True))
        return list(map(self.__getitem__, pieces))


@lru_cache(4)
def _cache(path: str) -> Cache:
    return Cache(load_ranks(path))


@lru_cache(4)
def _bytes_of(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    found = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def encode_texts(texts: list[str], path: str, chars: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, how many each text has); the texts are scanned together, about ``chars`` characters at a time.

    Slices stay views into the texts' bytes. Arrow numbers the distinct ones, each of which is merged once.
    """
    cache, found, counts, at = _cache(path), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < chars):
            size += len(texts[upto]) + 1
            upto += 1
        group = texts[at:upto]
        joined = "\n".join([*group, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in group]) - 1
        to = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
        points[ends] = SEPARATOR
        where = np.flatnonzero(starts_of(points))
        offsets = np.append(0, to)[np.append(where, len(points))]
        slices = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
        distinct = slices.dictionary_encode()
        merged = cache.ids(distinct.dictionary.to_pylist())
        code = distinct.indices.to_numpy()
        code = code[points[where] != SEPARATOR]
        own = where[points[where] != SEPARATOR]
        sizes = np.array([len(x) >> 2 for x in merged], dtype=np.int64)
        flat, starts, n = np.frombuffer(b"".join(merged), "<i4"), np.cumsum(sizes) - sizes, sizes[code]
        upto_ids = np.append(0, np.cumsum(n))
        found.append(flat[np.repeat(starts[code] - upto_ids[:-1], n) + np.arange(upto_ids[-1])])
        bounds = upto_ids[np.searchsorted(own, np.concatenate([[0], ends]))]
        counts.append(np.diff(bounds))
        at = upto
    return np.concatenate(found), np.concatenate(counts)


def encode(df: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), offsets: bool = True) -> DataFrame:
    """``carry`` columns, ``ids`` array<int>, and with ``offsets`` the byte where each id starts in the UTF-8 text.

    A null or empty text has no ids. Repeated rows and texts of any length are encoded whole; other columns stay behind.
    """
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("offsets", T.ArrayType(T.LongType(), False))] if offsets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            _cache(path).clear()  # the worker lives on, and what it runs next needs the memory

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(b) for b in _bytes_of(path)], dtype=np.int64)
        for whole in batches:
            for batch in _small(whole, 4 << 20):
                flat, counts = encode_texts(batch.column(batch.num_columns - 1).fill_null("").to_pylist(), path)
                bounds = np.append(0, np.cumsum(counts)).astype(np.int32)
                columns = [*(batch.column(i) for i in range(len(carry))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))]
                if offsets:
                    upto = np.concatenate([[0], np.cumsum(sizes[flat])])
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(upto[:-1] - np.repeat(upto[bounds[:-1]], np.diff(bounds)))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*carry, text).mapInArrow(run, schema)


def _small(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes each."""
    rows = max(1, int(batch.num_rows * min(1.0, most / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(df: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",), hashed: Callable[[bytes], str] | None = None) -> DataFrame:
    """``carry`` columns and ``decoded``, the bytes of the ids; with ``hashed``, what that makes of them. Null ids decode to no bytes."""
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("decoded", T.StringType() if hashed else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _bytes_of(path)
        for whole in batches:
            for batch in _small(whole):
                made = [b"".join([known[i] for i in x.tolist()]) for x in _rows(batch.column(batch.num_columns - 1))]
                columns = [*(batch.column(i) for i in range(len(carry))), pa.array([hashed(x) for x in made] if hashed else made, pa.string() if hashed else pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*carry, ids).mapInArrow(run, schema)


def _rows(lists: pa.ListArray) -> Iterator[np.ndarray]:
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield flat[a:b]


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text of documents, decodes the ids again and returns counts and digests. Null: empty."""
    import public_tokenizers

    def digest(data: bytes) -> str:
        from hashlib import sha256

        return sha256(data).hexdigest()

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), path, offsets=False)
    told = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"))
    return decode(told, path, carry=("doc_id", "n_tokens", "ids_sha256"), hashed=digest).withColumnRenamed("decoded", "decoded_sha256")


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
