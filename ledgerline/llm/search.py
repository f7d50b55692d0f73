"""Exact BM25 top-k search by block-max WAND, run per shard and merged exactly.

A shard is a run of documents of an input split: an inverted index in numpy arrays, its documents ordered so that like
ones stand together and cut into blocks. Terms that many documents near each other have are dense columns there, with
their largest weight by block; these and what all other terms add bound what a document of the block can score, and
blocks whose bound is under a query's threshold are not opened. Shards are searched in levels, few first; thresholds start
from what the levels before have found, and rise with the k-th best score. Blocks are opened for many queries
together, so their work is array sums and products; queries stand in like order too. Document counts, lengths and frequencies are those of the whole
corpus, so scores of different shards compare, and the merge of the shards' top k is the exact top k. Queries come in
blocks of bounded size, several against each shard while it is open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _small
from .common import checkpoint, table

K1, B = 1.2, 0.75
BLOCK, PART, TILE = 32, 256, 1024
#: So many documents of a tile make a term a dense column there, and so much memory may a shard's dense columns take.
DENSE, DENSE_BYTES = 64, 160 << 20
#: Scores are compared after rounding to so many digits; bounds give way by more than that.
DIGITS, SLACK = 6, 2e-6
#: So many queries are scored together in a shard.
QUERIES_AT_ONCE = 256
#: Rare postings are kept in lanes of so many.
LANE = 4
#: So many rare postings are unfolded at once, few enough for a core's cache.
POSTS_AT_ONCE = 1 << 17
#: Blocks that a query without a threshold opens in each round, those with the best bounds; 0 means all that its threshold leaves.
ROUNDS = (8, 0)
#: So many blocks of queries are searched while a shard is open.
BLOCKS_AT_ONCE = 8
#: Shards are searched in levels, each with those before it so many times what was searched before.
GROWTH = 4


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, term's number) of every word, and the terms: A to Z in lower case, cut at ASCII white space, and hashed with XXH64 into a signed long."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = split.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)).view(np.int64)
    code = words.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), split.value_lengths().to_numpy(zero_copy_only=False))
    if "" in distinct:
        there = code != distinct.index("")
        code, owner = code[there], owner[there]
    return owner, code, hashed


INDEX = "docs binary, lengths binary, terms binary, pointers binary, posts binary, counts binary, n long, words long"


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", most_docs: int = 8192, most_posts: int = 2_000_000) -> DataFrame:
    """Shards of at most ``most_docs`` documents and about ``most_posts`` postings; every document is in one.

    Null and empty texts have no terms but count as documents. Keys must be longs; a null key is kept as the least long.
    """

    names = [x.split(" ")[0] for x in INDEX.split(", ")]

    def built(keys: np.ndarray, owner: np.ndarray, number: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        lengths = np.bincount(owner, minlength=n).astype(np.int64)
        pairs, counts = np.unique(number.astype(np.int64) * n + owner, return_counts=True)
        term, doc = pairs // n, pairs % n
        common = np.zeros(n, dtype=np.int64)  # a document's most frequent term, the first of equals, stands for what it is like
        np.maximum.at(common, doc, counts * (len(terms) + 1) + len(terms) - term)
        order = np.lexsort((lengths, -(common % (len(terms) + 1))))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        most = int(counts.max(initial=0)) + 1
        packed = np.sort((term * n + place[doc]) * most + counts)
        posts = packed // most
        used, pointers = np.unique(term, return_index=True)
        arrays = [keys[order], lengths[order], terms[used], np.append(pointers, len(term)).astype(np.int64), (posts % n).astype(np.int32), (packed % most).astype(np.int32)]
        return pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([n], pa.int64()), pa.array([len(number)], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        docs = size = 0

        def shard() -> pa.RecordBatch:
            nonlocal docs, size
            terms = np.sort(np.concatenate([h[3] for h in held]))
            terms = terms[np.append(True, terms[1:] != terms[:-1])] if len(terms) else terms
            starts = np.cumsum([0, *(len(h[0]) for h in held)])
            made = built(np.concatenate([h[0] for h in held]), np.concatenate([h[1] + np.int32(a) for h, a in zip(held, starts, strict=False)]), np.concatenate([np.searchsorted(terms, h[3]).astype(np.int32)[h[2]] for h in held]), terms)
            held.clear()
            docs = size = 0
            return made

        for whole in batches:
            for batch in _small(whole):
                for at in range(0, batch.num_rows, most_docs):
                    part = batch.slice(at, most_docs)
                    if held and docs + part.num_rows > most_docs:
                        yield shard()
                    words = terms_of(part.column(1))
                    held.append((part.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), *words))
                    docs, size = docs + part.num_rows, size + len(words[0])
                    if size >= 2 * most_posts:
                        yield shard()
        if held:
            yield shard()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, INDEX)


class Shard:
    """One shard's arrays, with each posting's weight under the corpus's mean length.

    Documents stand in blocks of ``BLOCK``, and blocks in tiles of ``TILE`` documents. Terms that ``DENSE`` documents of a
    tile have are dense columns of that tile, for products; of all other postings, the rare ones, lists are kept by term.
    Dense columns take ``DENSE_BYTES`` at most; where they would take more, they need more documents. ``scored`` and
    ``passed`` count the pairs of query and block that were opened and all that share a term.
    """

    def __init__(self, row: dict, mean_length: float):
        as_ = lambda name, kind: np.frombuffer(row[name], kind)
        self.keys, self.terms, self.pointers, self.posts = as_("docs", np.int64), as_("terms", np.int64), as_("pointers", np.int64), as_("posts", np.int32)
        lengths, counts = as_("lengths", np.int64), as_("counts", np.int32)
        self.weights = counts * (K1 + 1) / (counts + (K1 * (1 - B + B * lengths / mean_length))[self.posts])
        self.n_tiles = -(-len(self.keys) // TILE)
        self.n_blocks = self.n_tiles * (TILE // BLOCK)
        tile = self.posts // TILE
        new = np.ones(len(tile), dtype=bool)
        new[1:] = tile[1:] != tile[:-1]
        new[self.pointers[:-1]] = True
        first = np.flatnonzero(new)  # of a term's postings in a tile
        sizes = np.diff(np.append(first, len(tile)))
        least = DENSE
        while int((sizes >= least).sum()) * TILE * 12 > DENSE_BYTES:
            least *= 2
        dense = sizes >= least
        rare = np.repeat(~dense, sizes)
        pointers = np.append(0, np.cumsum(rare))[self.pointers]
        lanes = -(-np.diff(pointers) // LANE)
        self.lanes = np.append(0, np.cumsum(lanes))  # a term's first lane
        place = np.repeat(self.lanes[:-1] * LANE - pointers[:-1], np.diff(pointers)) + np.arange(pointers[-1])
        self.lane_posts, self.lane_weights = np.zeros(self.lanes[-1] * LANE, dtype=np.int32), np.zeros(self.lanes[-1] * LANE)
        self.lane_posts[place] = self.posts[rare] % BLOCK * self.n_blocks + self.posts[rare] // BLOCK
        self.lane_weights[place] = self.weights[rare]
        self.lane_posts, self.lane_weights = self.lane_posts.reshape(-1, LANE), self.lane_weights.reshape(-1, LANE)
        term = np.searchsorted(self.pointers, first[dense], "right") - 1
        often, column = np.unique(term, return_inverse=True)
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[often] = np.arange(len(often))
        self.spot = np.full((len(often), self.n_tiles), -1, dtype=np.int32)  # a term's column in each tile
        self.columns, self.near, self.maxima = [], [], []
        by_tile = np.argsort(tile[first[dense]], kind="stable")
        cuts = np.searchsorted(tile[first[dense]][by_tile], np.arange(self.n_tiles + 1))
        self.first_of = cuts * TILE  # of a tile's dense columns in ``flat``
        self.flat = np.zeros(int(cuts[-1]) * TILE)
        for t in range(self.n_tiles):
            mine = by_tile[cuts[t] : cuts[t + 1]]
            n = sizes[dense][mine]
            p = _ranges(first[dense][mine], n)
            held = self.flat[self.first_of[t] : self.first_of[t + 1]].reshape(TILE, len(mine))
            held[_row(self.posts[p]), np.repeat(np.arange(len(mine)), n)] = self.weights[p]
            self.columns.append(column[mine])
            by_part = held.reshape(BLOCK, TILE // PART, PART // BLOCK, len(mine)).transpose(1, 0, 2, 3)
            self.near.append(by_part.astype(np.float32, order="C").reshape(TILE // PART, PART, len(mine)))
            self.spot[column[mine], t] = np.arange(len(mine))
            self.maxima.append(held.reshape(BLOCK, TILE // BLOCK, len(mine)).max(axis=0).T.astype(np.float32))
        self.scored = self.passed = 0

    def top(self, starts: np.ndarray, at: np.ndarray, idf: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, rounded score) of each query's k best documents, equal scores by key; query i has ``at[starts[i]:starts[i + 1]]`` of ``terms``.

        Block-max WAND, a tile for all queries at a time. A block's bound for a query is the sum of its dense terms'
        block maxima and the most that its rare terms add to one document. Blocks whose bound is under the query's
        threshold are never opened. The threshold is ``floor`` (what other shards' k-th best are known to reach), and
        then the k-th best score so far. A query without a threshold opens the blocks with the best bounds first.
        """
        n = len(starts) - 1
        owner = np.repeat(np.arange(n), np.diff(starts))
        row = self.row_of[at]
        frequent = np.zeros((len(self.spot), n), dtype=np.float32)
        frequent[row[row >= 0], owner[row >= 0]] = idf[row >= 0]
        asked = [np.ascontiguousarray(frequent[c].T) for c in self.columns]
        sums = self._rare(starts, at, idf)
        bounds = np.concatenate([a @ m for a, m in zip(asked, self.maxima, strict=True)], axis=1)
        bounds += sums.max(axis=1)
        part = (max(map(len, self.columns)) + 4) * 2.0**-23  # by how much of a bound single precision may be off
        off = part * bounds.max(axis=1).astype(np.float64)
        closed = bounds > 0
        self.passed += int(closed.sum())

        threshold = np.zeros(n) if floor is None else floor.copy()
        queries, docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for width in ROUNDS:
            opened = closed & (bounds >= (threshold - SLACK - 2 * off)[:, None])
            if 0 < width < self.n_blocks:
                opened &= (threshold <= 0)[:, None]
                ranked = np.where(opened, bounds, np.float32(-1))
                opened &= bounds >= -np.partition(-ranked, width - 1, axis=1)[:, width - 1 : width]
            if not opened.any():
                continue
            closed &= ~opened
            self.scored += int(opened.sum())
            q, d, about = self._scores(opened, asked, sums, np.maximum(threshold - SLACK - 2 * off, 1e-7))
            order = np.lexsort((-about, q))
            place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            last = order[place == k - 1]
            least = np.full(n, -np.inf)
            least[q[last]] = about[last] - SLACK - 4 * off[q[last]]
            q, d = (x[about >= least[q]] for x in (q, d))
            exact = np.round(self._exact(q, d, starts, row, idf) + sums[q, d % BLOCK, d // BLOCK], DIGITS)
            good = exact >= np.maximum(threshold[q], 1e-6)
            queries, docs, scores = np.concatenate([queries, q[good]]), np.concatenate([docs, d[good]]), np.concatenate([scores, exact[good]])
            order = np.lexsort((self.keys[docs], -scores, queries))
            place = np.arange(len(order)) - np.searchsorted(queries[order], queries[order])
            queries, docs, scores = (x[order[place < k]] for x in (queries, docs, scores))
            last = place[place < k] == k - 1
            threshold[queries[last]] = np.maximum(threshold[queries[last]], scores[last])
        return queries, self.keys[docs], scores

    def _rare(self, starts: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What rare postings add for each query to each place of each block; ``POSTS_AT_ONCE`` of them, or one query's, are unfolded together."""
        n, width = len(starts) - 1, self.n_blocks * BLOCK
        out = np.empty((n, width))
        sizes = self.lanes[at + 1] - self.lanes[at]
        upto = np.append(0, np.cumsum(sizes))[starts]
        posts, place, gain = (np.empty((POSTS_AT_ONCE // LANE, LANE), kind) for kind in (np.int32, np.int64, np.float64))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + POSTS_AT_ONCE // LANE, "right")) - 1)
            entry = slice(starts[a], starts[b])
            many = sizes[entry]
            each = np.repeat(np.arange(len(many)), many)
            lane = (self.lanes[at[entry]] - np.cumsum(many) + many)[each] + np.arange(len(each))
            if len(lane) > len(posts):
                posts, place, gain = (np.empty((len(lane), LANE), kind) for kind in (np.int32, np.int64, np.float64))
            m = len(lane)
            np.take(self.lane_posts, lane, axis=0, out=posts[:m], mode="clip")
            np.add(posts[:m], np.repeat(np.arange(b - a) * width, np.diff(upto[a : b + 1]))[:, None], out=place[:m])
            np.take(self.lane_weights, lane, axis=0, out=gain[:m], mode="clip")
            gain[:m] *= idf[entry][each][:, None]
            out[a:b] = np.bincount(place[:m].ravel(), weights=gain[:m].ravel(), minlength=(b - a) * width).reshape(b - a, width)
            a = b
        return out.reshape(n, BLOCK, self.n_blocks)

    def _scores(self, opened: np.ndarray, asked: list[np.ndarray], sums: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) in opened blocks where the score is ``least`` or more. Products are taken in single precision here; the rare terms' sums are exact."""
        found = []
        n = PART // BLOCK
        parts = opened.reshape(len(opened), -1, n).any(axis=2)
        for part in np.flatnonzero(parts.any(axis=0)).tolist():
            t, i = divmod(part, TILE // PART)
            who = np.flatnonzero(parts[:, part])
            got = asked[t][who] @ self.near[t][i].T
            got += sums[who, :, part * n : (part + 1) * n].reshape(got.shape)
            i, j = np.divmod(np.flatnonzero(got >= least[who].astype(np.float32)[:, None]), PART)
            block = part * n + j % n
            there = opened[who[i], block]
            i, j, block = i[there], j[there], block[there]
            found.append((who[i], block * BLOCK + j // n, got[i, j]))
        return tuple(np.concatenate(z) for z in zip(*found, strict=True))

    def _exact(self, query: np.ndarray, doc: np.ndarray, starts: np.ndarray, row: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What dense terms add to each of these pairs."""
        out = np.zeros(len(query))
        tile = doc // TILE
        upto = np.append(0, np.cumsum(np.diff(starts)[query]))
        a = 0
        while a < len(query):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + POSTS_AT_ONCE, "right")) - 1)
            sizes = np.diff(upto[a : b + 1])
            each = np.repeat(np.arange(a, b), sizes)
            entry = _ranges(starts[query[a:b]], sizes)
            there = row[entry] >= 0
            each, entry = each[there], entry[there]
            spot = self.spot[row[entry], tile[each]]
            there = spot >= 0
            each, entry, spot = each[there], entry[there], spot[there]
            at = (self.first_of[tile] + _row(doc) * (np.diff(self.first_of) // TILE)[tile])[each] + spot
            out[a:b] = np.bincount(each - a, weights=idf[entry] * self.flat[at], minlength=b - a)
            a = b
        return out


def _row(doc: np.ndarray) -> np.ndarray:
    """A document's row in its tile: the first of each block, then the second of each, and so on."""
    return doc % BLOCK * (TILE // BLOCK) + doc % TILE // BLOCK


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + sizes, sizes) + np.arange(total)


def query_terms(queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id and term, one row for each distinct word of each query's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                owner, number, terms = terms_of(batch.column(1))
                pairs = np.unique(owner.astype(np.int64) * max(1, len(terms)) + number)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs // max(1, len(terms)))), pa.array(terms[pairs % max(1, len(terms))])], names=["query_id", "term"])

    return queries.select(F.col(key).cast("long").alias("query_id"), text).mapInArrow(run, "query_id long, term long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", block_terms: int = 1_000_000) -> DataFrame:
    """query_id, rank (from 1), doc_id and score: each query's k best documents by BM25 over its distinct words.

    Equal scores go by key. Documents without a word of the query are never returned, so a query without words has no
    rows; neither has one with a null key. Rows that repeat a query's key are one query of all their words; repeated
    documents are documents. Queries are dealt into blocks of about ``block_terms`` terms by a hash of their key; a
    block is what is collected and broadcast at once (and has about ``block_terms`` results at most), and
    ``BLOCKS_AT_ONCE`` of them are searched together. Shards are searched in levels, as ``GROWTH`` says: the k-th best
    hit that a query has in the levels before, by score and key, is the threshold that it starts with in the next. So a
    level finds about ``GROWTH`` - 1 times k new hits for a query, and all levels together that times the logarithm of
    the number of shards; where like documents share shards it may be more, but a task never returns more than k.
    Shards and query weights are written to the shared folder,
    so a lost executor costs only the shards that it was searching. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    shards = checkpoint(index(docs, key, text).withColumn("shard", F.xxhash64(F.monotonically_increasing_id())))
    known = shards.select("shard", "n", "words").toArrow()
    n, words = (pc.sum(known.column(c)).as_py() for c in ("n", "words"))
    if not words:
        return spark.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, doc_id long, score double"))
    levels = _levels(known.column("shard").to_numpy())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, pointers in zip(batch.column(0), batch.column(1), strict=True):
                t = np.frombuffer(terms.as_buffer(), np.int64)
                c = np.diff(np.frombuffer(pointers.as_buffer(), np.int64))
                for at in range(0, len(t), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(t[at : at + 100_000]), pa.array(c[at : at + 100_000])], names=["term", "df"])

    df = shards.select("terms", "pointers").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = query_terms(queries.where(F.col(key).isNotNull()), key, text).distinct()
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = checkpoint(asked.join(df, "term").select("query_id", "term", weight.alias("idf")))
    entries, n_queries = weighted.agg(F.count("term"), F.approx_count_distinct("query_id")).first()
    blocks = max(1, math.ceil(entries / block_terms), math.ceil(n_queries * k / block_terms))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found = []
    for a in range(0, blocks, BLOCKS_AT_ONCE):
        names, shared = [], []
        for block in range(a, min(a + BLOCKS_AT_ONCE, blocks)):
            mine = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
            if len(mine):
                held = _held(*(mine.column(c).to_numpy() for c in ("query_id", "term", "idf")))
                names.append(held[0])
                shared.append(spark.sparkContext.broadcast(held))
        if not names:
            continue
        every = np.concatenate(names)
        sorter, cuts = np.argsort(every), np.cumsum([len(x) for x in names])[:-1]
        floor, last = np.zeros(len(every)), np.zeros(len(every), dtype=np.int64)
        held, done = None, F.lit(False)
        for level in levels:
            these = F.col("shard") <= level
            hits = _searched(shards.where(these & ~done), shared, np.split(floor, cuts), np.split(last, cuts), words / n, k)
            hits = hits if held is None else held.drop("rank").unionByName(hits)
            held, done = checkpoint(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)), these
            if level != levels[-1]:
                reached = held.where(F.col("rank") == k).select("query_id", "score", "doc_id").toArrow()  # a row for each query of these blocks at most
                at = sorter[np.searchsorted(every, reached.column("query_id").to_numpy(), sorter=sorter)]
                floor[at], last[at] = reached.column("score").to_numpy(), reached.column("doc_id").to_numpy()
        found.append(held)
    if not found:
        return spark.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, doc_id long, score double"))
    doc = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", doc.alias("doc_id"), "score")


def _held(ids: np.ndarray, terms: np.ndarray, idfs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Queries, where each one's terms start, the terms as numbers of distinct ones, these, and their weights.

    Queries stand by their commonest term and then by how many they have, so that those searched together open like blocks.
    """
    distinct, first, number = np.unique(terms, return_index=True, return_inverse=True)
    number = number.astype(np.int32)
    order = np.lexsort((number, idfs, ids))  # a query's commonest term comes first
    names, starts, sizes = np.unique(ids[order], return_index=True, return_counts=True)
    like = np.lexsort((sizes, number[order[starts]]))
    return names[like], np.append(0, np.cumsum(sizes[like])), number[order[_ranges(starts[like], sizes[like])]], distinct, idfs[first]


def _levels(shards: np.ndarray) -> list[int]:
    """Up to which of the shards' numbers each level goes: with those before, ``GROWTH`` times as many as the level before, and the last to all."""
    numbers, size, ends = np.sort(shards), len(shards), []
    while size:
        ends.append(int(numbers[size - 1]))
        size //= GROWTH
    return ends[::-1]


def _searched(shards: DataFrame, shared: list[Broadcast], floors: list[np.ndarray], lasts: list[np.ndarray], mean: float, k: int) -> DataFrame:
    """query_id, doc_id and score of what may be among the k best for each query of ``shared`` (results of ``_held``): the k best of each task's ``shards``.

    Only what comes before a query's floor and its key in ``lasts`` is returned. A shard is opened once for all queries.
    """
    least = shards.sparkSession.sparkContext.broadcast((floors, lasts))
    schema = T.StructType.fromDDL("query_id long, doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(j)[i].as_buffer() for j, c in enumerate(batch.schema.names)}, mean)
                if not len(shard.terms):
                    continue
                asked = asked or [(*s.value, Best(k, *x)) for s, *x in zip(shared, *least.value, strict=True)]
                for names, starts, number, terms, idf, best in asked:
                    known = np.minimum(np.searchsorted(shard.terms, terms), len(shard.terms) - 1)
                    known[shard.terms[known] != terms] = -1
                    for q in range(0, len(names), QUERIES_AT_ONCE):
                        upto = min(q + QUERIES_AT_ONCE, len(names))
                        a, b = starts[q], starts[upto]
                        at = known[number[a:b]]
                        there = at >= 0
                        own = np.concatenate([[0], np.cumsum(there)])[starts[q : upto + 1] - a]
                        best.add(q, *shard.top(own, at[there], idf[number[a:b][there]], k, best.floor[q:upto]))
        for names, *_, best in asked:
            query, keys, scores = best.hits()
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(keys), pa.array(scores)], names=schema.names)

    return shards.select("docs", "lengths", "terms", "pointers", "posts", "counts").mapInArrow(run, schema)


class Best:
    """The k best hits of a block's queries so far, by score and then key; hits not before a query's ``floor`` and ``last`` are not taken."""

    def __init__(self, k: int, floor: np.ndarray, last: np.ndarray):
        self.k, self.floor, self.last = k, floor.copy(), last.copy()
        self.held: dict[int, tuple[np.ndarray, ...]] = {}  # by the first query of those that are searched together

    def add(self, first: int, query: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Takes hits of queries from ``first`` on, where ``query`` 0 is that."""
        query = query + first
        good = (scores > self.floor[query]) | (scores == self.floor[query]) & (keys < self.last[query])
        if not good.any():
            return
        hits = (query[good], keys[good], scores[good])
        if first in self.held:
            hits = tuple(map(np.concatenate, zip(self.held[first], hits, strict=True)))
        query, keys, scores = hits
        order = np.lexsort((keys, -scores, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        full = order[place == self.k - 1]
        self.floor[query[full]], self.last[query[full]] = scores[full], keys[full]
        self.held[first] = tuple(x[order[place < self.k]] for x in hits)

    def hits(self) -> tuple[np.ndarray, ...]:
        """(query, key, score) of all that is held."""
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return tuple(map(np.concatenate, zip(none, *self.held.values(), strict=True)))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose doc_id is divisible by 50, taken whole as a query."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % 50 == 0))


QUERIES = {"op4_topk_search": op4_topk_search}
ORACLE_SQL = {
    "op4_topk_search": """
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
        dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
        stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
        idf AS (SELECT term, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY ALL),
        s AS (SELECT q.doc_id AS query_id, d.doc_id AS doc_id,
                     round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM stats)))), 6) AS score
              FROM tf q JOIN idf USING (term) JOIN tf d ON d.term = q.term JOIN dl ON dl.doc_id = d.doc_id
              WHERE q.doc_id % 50 = 0 GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
