"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups.

Token ids come from a word-level BPE behind a bounded cache of chunks between white space; every id ends up in exactly
one piece of at most ``capacity`` ids. Full pieces are sequences of their own. The others are dealt at random into
groups of about ``group_rows``, and each group is packed alone, so that no task grows with the corpus.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _small
from .common import checkpoint, table

CAPACITY = 2048
END_ID = 1
#: Marks that the tokenizer keeps apart from a word before them, and where the Latin letters end that NFC leaves alone.
MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"
#: Letters that NFC and lower-casing treat alone: Latin up to U+024F, but for the dotted capital I.
PLAIN = "^[\x01-\u012f\u0131-\u024f]*$"


class ChunkCache(dict):
    """Chunk to its ids as little-endian bytes, in two generations of ``most`` chunks: what is used moves to the newer one, the older one is let go.

    Lower-case words, which go through the merges alone, are held in ``words`` in the same way.
    """

    def __init__(self, path: str, most: int = 150_000, longest: int = 64):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        with open(path) as f:
            bare = json.load(f)
        pieces = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "pre_tokenizer": pieces, "added_tokens": []}))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def forget(self) -> None:
        for held in (self, self.older, self.words, self.older_words):
            held.clear()

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of the distinct ``chunks``, by the whole tokenizer."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        return self._ids(self, self.older, self.tokenizer, chunks)

    def lower_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of the distinct ``words``, by the merges alone."""
        if len(self.words) >= self.most:
            self.older_words, self.words = self.words, {}
        return self._ids(self.words, self.older_words, self.bare, words)

    def _ids(self, held: dict[str, bytes], older: dict[str, bytes], tokenizer, texts: list[str], step: int = 20_000) -> list[bytes]:
        out = [held.get(t) or older.get(t) for t in texts]
        missing = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(missing), step):
            part = missing[at : at + step]
            made = tokenizer.encode([texts[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(made.word_ids, dtype=np.int64), minlength=len(part))
            ends = (4 * np.cumsum(counts)).tolist()
            data = np.array(made.ids, dtype="<u4").tobytes()
            for i, x, y in zip(part, [0, *ends], ends, strict=False):
                out[i] = data[x:y]
        held.update((t, x) for t, x in zip(texts, out, strict=True) if len(t) <= self.longest)
        return out


@lru_cache(4)
def _cache(path: str) -> ChunkCache:
    return ChunkCache(path)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _parts(chunks: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, pa.StringArray]:
    """(which chunks are a Latin word and marks behind it, these words in lower case, the marks)."""
    word = pc.utf8_rtrim(chunks, MARKS)
    lower = pc.utf8_lower(word)
    plain = pc.and_(pc.utf8_is_alpha(lower), pc.or_(pc.string_is_ascii(chunks), pc.and_(pc.utf8_is_alpha(word), pc.match_substring_regex(chunks, PLAIN)))).to_numpy(zero_copy_only=False)
    of = np.flatnonzero(plain)
    own = pc.binary_length(word).to_numpy(zero_copy_only=False)[of]
    whole = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
    rest = np.diff(whole)[of] - own
    bytes_of = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[_ranges(whole[:-1][of] + own, rest)]
    marks = pa.StringArray.from_buffers(len(of), pa.py_buffer(np.append(0, np.cumsum(rest)).astype(np.int32)), pa.py_buffer(bytes_of.tobytes()))
    return plain, lower.take(pa.array(of)), marks


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, where each list of them starts, how many it has)."""
    sizes = np.array([len(x) >> 2 for x in ids], dtype=np.int64)
    return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, how many each text has). The tokenizer drops white space and never looks across a space or a line's end, so chunks between these encode alone.

    Arrow cuts and numbers the chunks. A Latin word and the marks behind it are pieces of their own to the tokenizer, so
    a word is lower-cased here and goes through the merges alone, once for all its spellings; whatever else a chunk is,
    the whole tokenizer takes.
    """
    cache = _cache(path)
    split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
    chunks = split.flatten().dictionary_encode()
    distinct, code = chunks.dictionary, chunks.indices.to_numpy()
    plain, lower, marks = _parts(distinct)
    lower, marks = lower.dictionary_encode(), marks.dictionary_encode()
    # three lists of ids, one after another: of words, of marks, of other chunks
    made = [cache.lower_words(lower.dictionary.to_pylist()), cache.chunks(marks.dictionary.to_pylist()), cache.chunks(distinct.filter(pa.array(~plain)).to_pylist())]
    flat, starts, sizes = _joined([x for part in made for x in part])
    first, second = np.full(len(distinct), -1), np.full(len(distinct), -1)
    first[plain], second[plain] = lower.indices.to_numpy(), marks.indices.to_numpy() + len(made[0])
    first[~plain] = np.arange(len(made[2])) + len(made[0]) + len(made[1])
    own = np.stack([first[code], second[code]], axis=1).ravel()
    n = np.where(own >= 0, sizes[own], 0) if len(sizes) else np.zeros(len(own), dtype=np.int64)
    ids = flat[_ranges(starts[own], n)] if len(sizes) else flat
    upto = np.append(0, np.cumsum(n))[::2]
    ends = np.append(0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
    return ids, np.diff(upto[ends])


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Each text's ids, ``END_ID`` last, cut into pieces of at most ``capacity``: key, start, length, ids_crc32, doc_tokens, and with ``ids`` the ids.

    A null or empty text is one piece of one id. Columns besides key and text stay behind.
    """
    fields = [df.schema[key], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")), *([T.StructField("ids", T.ArrayType(T.LongType(), False))] if ids else [])]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the millions of strings here hold no cycles, and walking them costs more than making them
        try:
            yield from cut(batches)
        finally:
            _cache(path).forget()  # the worker lives on, and what it runs next needs the memory
            gc.enable()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole, 4 << 20):
                at, start, length, crc, total, own = [], [], [], [], [], []
                found, counts = token_ids(batch.column(1), path)
                bounds = np.append(0, np.cumsum(counts)).tolist()
                found = memoryview(found.tobytes())
                for i, (first, last) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    data = bytes(found[4 * first : 4 * last]) + end
                    n = last - first + 1
                    for a in range(0, n, capacity):
                        b = min(n, a + capacity)
                        at.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(data[4 * a : 4 * b]))
                        total.append(n)
                        if ids:
                            own.append(np.frombuffer(data[4 * a : 4 * b], "<u4").astype(np.int64))
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *longs, *([pa.array(own, pa.list_(pa.int64()))] if ids else [])], names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(run, T.StructType(fields))


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item, none longer than ``capacity``. Items go largest first into the first bin with room.

    The tree's leaves are the bins' free room and its inner nodes the larger of their two children, so the first bin
    with room is one walk from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= need
        node >>= 1
        while node:
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
            node >>= 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset.

    Groups are dealt by a hash of the row's place, so equal or repeated keys spread like any others. The place must be
    the same when a task runs again, hence the checkpoint of these narrow rows. Empty input gives no rows.
    """
    placed = checkpoint(cut).withColumn("__place", F.monotonically_increasing_id())
    groups = max(1, -(-placed.where(F.col("length") < capacity).count() // group_rows))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    full = placed.where(F.col("length") >= capacity).select(*cut.columns, (-F.col("__place") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    carried = list(cut.columns)

    def one_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("__place")
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        ids = group.column("__group").to_numpy().astype(np.int64) * (1 << 32) + bins
        return pa.Table.from_arrays([*(group.column(c) for c in carried), pa.array(ids), pa.array(offsets)], names=schema.names)

    dealt = placed.where(F.col("length") < capacity).withColumn("__group", F.pmod(F.xxhash64("__place"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(one_group, schema).unionByName(full)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; a null text counts as empty and is the end id alone."""
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
