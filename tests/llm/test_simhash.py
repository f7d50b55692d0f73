import random
import re

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash

from .helpers import ODD, SCHEMA, prose, table


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(fps, ids, bits=2):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(fps))]


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    for t in [*ODD, *(prose(rng, n) for n in (1, 2, 3, 4, 50))]:
        assert simhash.fingerprint(t) == slow(t)


def test_anchors_cover_every_close_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    for flips in ((), (3,), (0, 63), (31, 32), (5, 6), (30, 31), (62, 63), (31, 63)):
        y = x.copy().view(np.uint64)
        for b in flips:
            y ^= np.uint64(1 << b)
        key, own, home = simhash.anchors(x)
        homes = set(zip(key[home].tolist(), own[home].tolist(), strict=True))
        k2, o2, _ = simhash.anchors(y.view(np.int64))
        reached = {}
        for k, o in zip(k2.tolist(), o2.tolist(), strict=True):
            reached.setdefault(o, set()).add(k)
        by_x = {}
        for k, o in homes:
            by_x.setdefault(o, set()).add(k)
        assert all(by_x[a] & reached[b] for a, b in zip(x.tolist(), y.view(np.int64).tolist(), strict=True))
    key, _, _ = simhash.anchors(x)
    assert len(key) <= 32 * len(x)


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            f = b
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert {tuple(r) for r in simhash.links(nodes).collect()} == want
    three = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert len(three) > len(want) and {tuple(r) for r in simhash.links(nodes, 3).collect()} == three
    with pytest.raises(ValueError):
        simhash.links(nodes, 4)
    docs = spark.createDataFrame([(100 + i, f) for i, f in enumerate(fps)] + [(7, fps[-1]), (None, fps[0])], "doc_id long, fp long")
    ids = [100 + i for i in range(len(fps))]
    want = dict(zip(fps, roots([f & ((1 << 64) - 1) for f in fps], ids), strict=True))
    got = simhash.components(docs).collect()
    assert len(got) == len(fps) + 2
    whole = {f for f in fps if want[f] == want[fps[-1]]}
    assert all(r.component_id == (7 if r.fp in whole else want[r.fp]) for r in got)


def test_stars_on_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in simhash.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}
    assert simhash.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(11)
    long = prose(rng, 900)
    texts = [*ODD, long, long, long + " end", "w1 " + long, *(prose(rng, 60) for _ in range(5))]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    fps = [slow(t) for t in texts]
    want = roots(fps, list(range(len(texts))))
    got = sorted(simhash.op9_simhash(spark, str(tmp_path)).collect())
    assert [(r.fingerprint, r.component_id) for r in got] == [(f"{f:016x}", c) for f, c in zip(fps, want, strict=True)]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = simhash.representatives(docs, simhash.fingerprints(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "same", None, None, 4)] * 2, SCHEMA))
    kept = simhash.representatives(twice, simhash.fingerprints(twice))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want)) and kept.where("doc_id is null").count() == 1
    assert simhash.components(simhash.fingerprints(docs.limit(0))).count() == 0


def test_rows_that_share_a_key_are_told_by_text(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 80) for _ in range(3))
    texts = [(5, a), (5, b), (5, a), (5, c), (2, c), (None, b), (None, None), (7, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], SCHEMA).repartition(3)
    for fps in (simhash.fingerprints(docs), simhash.fingerprints(docs, hashed=True)):
        kept = [(r.doc_id, r.text) for r in simhash.representatives(docs, fps).collect()]
        assert sorted(kept, key=str) == sorted([(5, a), (5, b), (2, c), (7, None)], key=str)


def test_own_names_as_columns_and_a_group_of_copies(spark):
    rng = random.Random(17)
    a, b = prose(rng, 80), prose(rng, 80)
    names = ["__row", "__copy", "__kept", "__key", "__own", "fp", "least", "a.b"]
    docs = spark.createDataFrame([(k, t, *names) for k, t in [(1, a)] * 30 + [(2, a), (3, b)]], "doc_id long, text string" + "".join(f", `{c}` string" for c in names))
    kept = simhash.representatives(docs, simhash.fingerprints(docs, hashed=True))
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__copy"], r["a.b"]) for r in kept.collect()) == [(1, "__copy", "a.b"), (3, "__copy", "a.b")]
