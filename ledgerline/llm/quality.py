"""Quality rules: gradient-boosted trees over document statistics.

The statistics are counted over whole texts. A boosted ensemble of shallow trees, fitted on a bounded sample of labelled
rows under monotonic constraints on chosen features, is flattened into node arrays, and all trees of a batch are walked
together, one level a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _small
from .common import table, teaching

#: White space between words, and the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, DIGITS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees; with -1 more of it never raises the verdict.
FEATURES = {"log_words": 0, "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": 0, "digit_share": 0, "stop_share": 0, "word_length": 0, "distinct_share": 0}


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 3:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    v = len(known)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """(``COUNTS``, ``FEATURES``) of a whole text; null and empty texts have zeros."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip(BLANKS):
                seen.add(line)
    repeat = repeated_words(words)
    m = max(1, len(data))
    share = [(len(data) - len(data.translate(None, drop))) / m for drop in (UPPER, DIGITS, STOPS)]
    features = [float(np.log1p(n)), symbols / max(1, chars), repeat / max(1, n), dup / len(lines), *share, chars / max(1, n), len(set(words)) / max(1, n)]
    return (n, chars, symbols, dup, repeat), features


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in arrays; a leaf points at itself. ``roots`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotonic: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1 under logistic loss, split by histogram.

    With a constraint of 1 (-1) on a feature, a split's right side is never valued below (above) its left side, and the
    middle between them bounds all values further down, so the whole ensemble is monotonic in it. Without rows, or with
    one label only, there are no splits.
    """
    rate_of_ones = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), dtype=int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(y), base)

    def node() -> int:
        i = len(feature)
        for column, first in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, 0.0)):
            column.append(first)
        return i

    def grow(i: int, rows: np.ndarray, low: float, high: float, level: int) -> None:
        g, h = gradient[rows], hessian[rows]
        own = float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], weights=w, minlength=width)) for w in (g, h, None))
                for k in range(width - 1):
                    if min(ns[k], ns[-1] - ns[k]) < least:
                        continue
                    a = float(np.clip(-gs[k] / (hs[k] + ridge), low, high))
                    b = float(np.clip(-(gs[-1] - gs[k]) / (hs[-1] - hs[k] + ridge), low, high))
                    if (b - a) * monotonic[j] < 0:
                        continue
                    gain = -(gs[k] * a + 0.5 * (hs[k] + ridge) * a * a) - ((gs[-1] - gs[k]) * b + 0.5 * (hs[-1] - hs[k] + ridge) * b * b)
                    if best is None or gain > best[0]:
                        best = (gain, j, k, a, b)
        if best is None or best[0] <= -(g.sum() * own + 0.5 * (h.sum() + ridge) * own * own) + 1e-9:
            value[i] = own * rate
            margin[rows] += own * rate
            return
        _, j, k, a, b = best
        feature[i], threshold[i] = j, float(cuts[j][k])
        middle = (a + b) / 2
        spans = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotonic[j]]
        goes = binned[rows, j] <= k
        for side, part, span in ((left, rows[goes], spans[0]), (right, rows[~goes], spans[1])):
            side[i] = child = node()
            grow(child, part, *span, level + 1)

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        roots.append(root := node())
        grow(root, np.arange(len(y)), -4.0, 4.0, 0)
    if not roots:
        roots.append(node())
    ints = [np.array(c, dtype=np.int64) for c in (feature, left, right, roots)]
    return Forest(ints[0], np.array(threshold), ints[1], ints[2], np.array(value), ints[3], depth, base)


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """key, ``extra`` columns, ``COUNTS`` and ``features`` of every text; other columns stay behind."""
    schema = T.StructType([df.schema[key], *(df.schema[c] for c in extra), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("features", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                found = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                counts = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
                own = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *counts, pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=schema.names)

    return df.select(key, *extra, text).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", sample_rows: int = 20_000) -> Forest:
    """Fits on at most ``sample_rows`` labelled rows (``common.teaching``): one row of features for each reaches the driver."""
    rows = measured(teaching(docs, labels, label, sample_rows, key), "__label")
    got = rows.select("__label", "features").toPandas()
    x, y = np.array(got["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)), got["__label"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return fit(x[order], y[order], tuple(FEATURES.values()))


def judged(counted: DataFrame, forest: Forest, at_least: float = 0.5) -> DataFrame:
    """``counted`` (from ``measured``) with quality, base_failed and kept in place of ``features``."""
    schema = T.StructType([*(f for f in counted.schema.fields if f.name != "features"), T.StructField("quality", T.DoubleType())])
    at = counted.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            parts = [forest.score(x[a : a + 4096]) for a in range(0, len(x), 4096)] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(np.concatenate(parts))], names=schema.names)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= at_least))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the trees' verdict of all documents."""
    docs = table(spark, sf_dir, "documents")
    forest = train(docs, table(spark, sf_dir, "labels"))
    return judged(measured(docs), forest)


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL: dict[str, str] = {}
