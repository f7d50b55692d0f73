"""SimHash near-duplicates by anchor points.

Fingerprints of 64 bits link at 2 (or, as a parameter, 3) or fewer differing bits. Of two linked ones, one half differs
in at most one bit. The anchors of a half are the codewords of the perfect Hamming code over 31 of its bits, whose
covering radius is 1: each fingerprint has one home anchor within that radius, and is replicated to every anchor within
radius plus threshold, 2, of which there are at most 16. So each linked pair meets at the home of either, and comparing per anchor is exact.
Equal fingerprints are one node throughout; components come from star contraction over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _small
from .common import checkpoint, fresh, quoted, table

SEED = 42
CODE_BITS = 31


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; a text without words has fingerprint 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        digest = xxhash.xxh64_intdigest
        first = [0, *ends[:-words].tolist()]
        hashes = [digest(joined[a:b], seed) for a, b in zip(first, (ends[words - 1 :] - 1).tolist(), strict=True)]
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(packed[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def text_hash(text: str = "text") -> Column:
    """Tells texts apart; null has a hash of its own."""
    return F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """key and ``fp``, the fingerprint as a signed long; null and empty texts have 0, other columns stay behind.

    With ``hashed`` a third column, ``text_hash``, tells rows apart that share a key.
    """
    more = [T.StructField("text_hash", T.StringType())] if hashed else []
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=schema.names)

    return df.select(key, text, *([text_hash(text).alias("text_hash")] if hashed else [])).mapInArrow(run, schema)


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Exclusive or of the positions (from 1) of the set bits of 31-bit words: 0 for codewords, else the bit to flip."""
    found = np.zeros(len(word), dtype=np.int64)
    for i in range(CODE_BITS):
        found ^= ((word >> i) & 1) * (i + 1)
    return found


def _flips() -> np.ndarray:
    """By syndrome: the bits to flip for each codeword within 2; the home first, -1 where there are fewer."""
    out = np.full((CODE_BITS + 1, 16), -1, dtype=np.int64)
    out[0, 0] = 0
    for s in range(1, CODE_BITS + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODE_BITS + 1) if i != s and i < i ^ s]
        out[s, : 1 + len(pairs)] = [1 << (s - 1), *pairs]
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, whether the anchor is its home) for both halves; an anchor carries its half's number."""
    flips, keys, owners, homes = _flips(), [], [], []
    for half in (0, 1):
        word = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & ((1 << CODE_BITS) - 1)
        own = flips[_syndrome(word)]
        at, column = np.nonzero(own >= 0)
        keys.append((word[at] ^ own[at, column]) | (half << 32))
        owners.append(fps[at])
        homes.append(column == 0)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(homes)


def links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``fp`` values of ``nodes`` that differ in at most ``bits`` (3 or fewer) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("these anchors cover 3 or fewer differing bits")
    schema = "anchor long, fp long, home boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                key, own, home = anchors(batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(home)], names=["anchor", "fp", "home"])

    near = nodes.select("fp").mapInArrow(run, schema)
    a, b = near.where("home").select("anchor", F.col("fp").alias("a")), near.select("anchor", F.col("fp").alias("b"))
    met = a.join(b, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
    return met.select("a", "b").distinct()


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; the root is the smallest node of its component.

    Large stars and small stars alternate (Kiveris et al., 2014) until nothing changes. Each round is written to the
    shared folder; only its row count and a checksum reach the driver. So are the least neighbours, or the join with
    them could not be split where a hub has most of the edges.
    """

    def around(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())

    now = checkpoint(edges)
    seen = state(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        all_ = around(now)
        least = checkpoint(all_.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = all_.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = checkpoint(large)
        least = checkpoint(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = checkpoint(small)
        was, seen = seen, state(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def components(fps: DataFrame, bits: int = 2, key: str = "doc_id") -> DataFrame:
    """key, fp and component_id (smallest key reachable over links, itself included) of every row of ``fps``.

    Copies share a fingerprint and so a node: no pairs of copies are made. Null keys take part but never name a
    component that has another key.
    """
    nodes = checkpoint(fps.groupBy("fp").agg(F.min(key).alias("least")))
    joined = stars(links(nodes, bits))
    members = checkpoint(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = checkpoint(members.groupBy("root").agg(F.min("least").alias("component_id")))
    named = members.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, "fp", "component_id")


def representatives(docs: DataFrame, fps: DataFrame, bits: int = 2, key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest (key, text hash), null keys last; of equal such rows any one.

    ``fps`` are the rows of ``fingerprints(docs, hashed=True)``; without hashes they are made again. Rows that share a key
    but not a text are documents of their own. Texts are shuffled once, by key and hash. Names of other columns don't matter.
    """
    if "text_hash" not in fps.columns:
        fps = fingerprints(docs, key=key, hashed=True)
    no_key, told = F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit(""))
    row = F.struct(no_key.alias("no_key"), F.col(key).alias("key"), F.concat_ws(":", no_key.cast("string"), told, "text_hash").alias("row"))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min(row).alias("least")))
    joined = stars(links(nodes, bits))
    members = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    own, copy, mark = (fresh(docs, n) for n in ("__row", "__copy", "__kept"))
    keep = members.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(mark))
    rows = docs.withColumn(own, F.concat_ws(":", no_key.cast("string"), told, text_hash()))
    one = rows.withColumn(copy, F.row_number().over(Window.partitionBy(own).orderBy(own))).where(F.col(copy) == 1)  # a row for each map task goes on, however many copies there are
    kept = one.join(keep.hint("shuffle_hash"), F.col(own) == F.col(mark), "left_semi")
    return kept.select(*(quoted(c) for c in docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and link components of all documents; null and wordless texts have fingerprint 0 and are linked like any other."""
    fps = checkpoint(fingerprints(table(spark, sf_dir, "documents")))
    return components(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
