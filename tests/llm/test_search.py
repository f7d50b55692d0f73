import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerline.llm import search

from .helpers import ODD, SCHEMA, prose, table


def slow(texts, ids, asked, k):
    docs = [Counter(w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    n, lengths = len(docs), [sum(d.values()) for d in docs]
    mean = sum(lengths) / n
    df = Counter(w for d in docs for w in d)
    out = []
    for q in asked:
        found = []
        for i, d in enumerate(docs):
            both = set(docs[q]) & set(d)
            if both:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for w in both)
                found.append((-round(s, 6), ids[i]))
        out += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [*ODD, *(prose(rng, rng.choice([1, 5, 30, 200])) for _ in range(240))]
    texts[50] = texts[100] = texts[40]
    table(spark, texts, 5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, search.op4_topk_search(spark, str(tmp_path)).collect()))
    want = sorted(slow(texts, range(len(texts)), range(0, len(texts), 50), 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([3, 20, 60])) for _ in range(150)]
    docs = table(spark, texts)
    queries = docs.where("doc_id % 7 = 0")
    whole = sorted(map(tuple, search.search(docs, queries, k=4).collect()))
    assert [w[:3] for w in whole] == [s[:3] for s in sorted(slow(texts, range(150), range(0, 150, 7), 4))]
    assert sorted(map(tuple, search.search(docs, queries, k=4, block_terms=50).collect())) == whole
    shards = search.index(docs, most_docs=9)
    assert shards.agg({"n": "sum"}).first()[0] == 150 and shards.where("n > 9").isEmpty()


def _shard(texts):
    rows = {}

    class Sink:
        def mapInArrow(self, f, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["k", "t"])
            (out,) = list(f(iter([batch])))
            rows.update({n: out.column(i)[0].as_py() for i, n in enumerate(out.schema.names)})

        def select(self, *a):
            return self

    search.index(Sink())
    return search.Shard(rows, len(search.terms_of(pa.array(texts))[0]) / len(texts))


def test_bounds_skip_blocks_but_never_a_result():
    rng = np.random.default_rng(5)
    rare = [f"r{i}" for i in range(40)]
    texts = [" ".join([*rng.choice(rare, 3), *(["common"] * int(rng.integers(1, 5)))]) for _ in range(2000)]
    shard = _shard(texts)
    terms = np.unique(search.terms_of(pa.array(["r1 r2 common"]))[2])
    at, idf = np.searchsorted(shard.terms, terms), np.array([0.3, 2.0, 2.5])
    all_scores = np.zeros(len(texts))
    for a, w in zip(at, idf, strict=True):
        p = slice(shard.pointers[a], shard.pointers[a + 1])
        all_scores[shard.posts[p]] += w * shard.weights[p]
    query, keys, scores = shard.top(np.array([0, len(at), len(at)]), at, idf, 5)
    order = np.lexsort((shard.keys, -np.round(all_scores, 6)))[:5]
    assert keys.tolist() == shard.keys[order].tolist() and np.allclose(scores, all_scores[order], atol=1e-6) and set(query.tolist()) == {0}
    assert 0 < shard.scored < shard.passed
    before, high = shard.scored, np.array([scores[-1], 0.0])
    again = shard.top(np.array([0, len(at), len(at)]), at, idf, 5, high)
    assert again[1].tolist() == keys.tolist() and shard.scored - before <= before
    assert shard.top(np.array([0, len(at)]), at, idf, 5, np.array([99.0]))[1].tolist() == []


def test_random_shards_equal_all_scores(monkeypatch):
    rng = np.random.default_rng(8)
    for size, rounds in ((5, (4, 24, 0)), (70, (1, 2, 0)), (900, (2, 0)), (900, (0,))):
        monkeypatch.setattr(search, "ROUNDS", rounds)
        vocabulary = [f"w{i}" for i in range(60)]
        texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 12)), p=np.arange(60, 0, -1) / 1830)) for _ in range(size)]
        shard = _shard(texts)
        for _ in range(6):
            picks = [np.sort(rng.choice(len(shard.terms), min(len(shard.terms), int(rng.integers(0, 9))), replace=False)) for _ in range(4)]
            at, starts = np.concatenate(picks).astype(np.int64), np.cumsum([0, *map(len, picks)])
            idf = np.round(rng.random(len(at)) * 3, 2)
            query, keys, scores = shard.top(starts, at, idf, 4)
            for q in range(4):
                total = np.zeros(size)
                for a, w in zip(at[starts[q] : starts[q + 1]], idf[starts[q] : starts[q + 1]], strict=True):
                    p = slice(shard.pointers[a], shard.pointers[a + 1])
                    total[shard.posts[p]] += w * shard.weights[p]
                total = np.round(total, 6)
                order = [i for i in np.lexsort((shard.keys, -total))[:4] if total[i] > 0]
                assert keys[query == q].tolist() == shard.keys[order].tolist() and np.allclose(scores[query == q], total[order], atol=2e-6)


def test_shards_are_read_once_for_several_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(6)
    docs = table(spark, [prose(rng, 30) for _ in range(120)])
    searched, passes = search._searched, []
    monkeypatch.setattr(search, "_searched", lambda *a: passes.append(1) or searched(*a))
    whole = sorted(map(tuple, search.search(docs, docs.where("doc_id % 6 = 0"), k=3).collect()))
    one = len(passes)
    assert sorted(map(tuple, search.search(docs, docs.where("doc_id % 6 = 0"), k=3, block_terms=150).collect())) == whole
    assert len(passes) == 2 * one  # four blocks and more would have been as many readings


def test_rows_made_grow_with_the_queries_not_with_the_shards(spark, monkeypatch):
    rng = random.Random(11)
    made, plain = spark.sparkContext.accumulator(0), type(spark.range(0)).mapInArrow

    def counted(df, run, schema):
        def counting(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(df, counting if "_searched" in run.__qualname__ else run, schema)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    index = search.index
    few = [prose(rng, 12) for _ in range(8)]
    for partitions, most_docs, texts in ((32, 8192, [prose(rng, 12) for _ in range(320)]), (32, 8192, [rng.choice(few) for _ in range(320)]), (1, 10, [prose(rng, 12) for _ in range(320)]), (1, 10, [rng.choice(few) for _ in range(320)])):
        monkeypatch.setattr(search, "index", lambda *a, most=most_docs: index(*a, most_docs=most))
        docs = table(spark, texts, partitions)
        before = made.value
        got = sorted(map(tuple, search.search(docs, docs.where("doc_id % 20 = 0"), k=3).collect()))
        assert [g[:3] for g in got] == [s[:3] for s in sorted(slow(texts, range(320), range(0, 320, 20), 3))]
        # 32 shards: levels of 2, 6 and 24, each expected to find three times k at most; one task never makes more than k in each
        assert made.value - before <= 16 * 3 * (12 if partitions > 1 else 3)


def test_columns_are_those_of_like_documents():
    rng = np.random.default_rng(9)
    words = [[f"{c}{i}" for i in range(300)] for c in "abc"]
    shard = _shard([" ".join([c, c, c, c, *rng.choice(words["abc".index(c)], 60)]) for c in "abc" for _ in range(2048)])
    assert len(shard.spot) >= 903 and max(map(len, shard.columns)) <= 301  # no tile has columns for words of others


def test_small_tiles_lanes_and_memory_equal_all_scores(monkeypatch):
    rng = np.random.default_rng(10)
    for name, value in {"BLOCK": 4, "PART": 8, "TILE": 32, "DENSE": 3, "LANE": 2, "POSTS_AT_ONCE": 16}.items():
        monkeypatch.setattr(search, name, value)
    for room in (1 << 20, 32 * 12 * 5, 0):
        monkeypatch.setattr(search, "DENSE_BYTES", room)
        texts = [" ".join(rng.choice([f"w{i}" for i in range(90)], int(rng.integers(0, 25)), p=np.arange(90, 0, -1) / 4095)) for _ in range(333)]
        shard = _shard(texts)
        assert sum(map(len, shard.columns)) * 32 * 12 <= room
        picks = [np.sort(rng.choice(len(shard.terms), int(n), replace=False)) for n in (0, 1, 7, 60, 30)]
        at, starts = np.concatenate(picks).astype(np.int64), np.cumsum([0, *map(len, picks)])
        idf = np.round(rng.random(len(at)) * 3, 2) + 0.01
        for floor in (None, np.array([0.0, 1.0, 2.0, 30.0, 0.0])):
            query, keys, scores = shard.top(starts, at, idf, 6, floor)
            for q in range(5):
                total = np.zeros(len(texts))
                for a, w in zip(at[starts[q] : starts[q + 1]], idf[starts[q] : starts[q + 1]], strict=True):
                    p = slice(shard.pointers[a], shard.pointers[a + 1])
                    total[shard.posts[p]] += w * shard.weights[p]
                total = np.round(total, 6)
                order = [i for i in np.lexsort((shard.keys, -total))[:6] if total[i] > 0 and (floor is None or total[i] >= floor[q])]
                assert keys[query == q].tolist() == shard.keys[order].tolist() and np.allclose(scores[query == q], total[order], atol=2e-6)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert search.search(none, none).count() == 0
    docs = table(spark, ["", None, "one word"])
    assert search.search(docs, docs.where("doc_id < 2")).count() == 0
    nulls = spark.createDataFrame([(None, "one", None, None, 3), (4, "one two", None, None, 3), (4, "one two", None, None, 3)], SCHEMA)
    got = search.search(nulls, nulls.where("doc_id = 4")).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(1, 4), (2, 4), (3, None)]
