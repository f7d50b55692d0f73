import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import bpe

from .helpers import ODD, table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
ALPHABET = "ab sté1٣2'  \n\t\r'drvelm'!?*_  😀ñ.　​́"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_slices_equal_the_pattern(text):
    assert bpe.slices(text) == PATTERN.findall(text)


def test_scan_across_blocks():
    rng = random.Random(4)
    text = "".join(rng.choice(ALPHABET) for _ in range(5000))
    assert bpe.slices(text) == PATTERN.findall(text)


def test_encoding_equals_the_library(library):
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(300))) for _ in range(200)] + ["ab" * 4000, "<|endoftext|>", "zzz" + "xy" * 700]
    for chars in (500, 2_000_000):
        ids, counts = bpe.encode_texts(texts, PATH, chars=chars)
        for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == library.encode_ordinary(t)
    assert [x.tolist() for x in bpe.encode_texts([], PATH)] == [[], []]


def test_merges_with_heap_equal_the_loop():
    ranks = bpe.load_ranks(PATH)

    def slow(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(9)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeing\xc3\xa9 ") for _ in range(rng.randrange(1, 40)))
        assert bpe.merge_pairs(piece, ranks) == slow(piece)
    merger = bpe.PairMerger(ranks)
    for width in (2, 3, 5, 8, 32):
        pieces = [bytes(rng.choice(b"abcdeing\xc3\xa9 ") for _ in range(width)) for _ in range(200)] + [b"a" * width]
        assert [np.frombuffer(x, "<i4").tolist() for x in merger.merged(pieces)] == [bpe.merge_pairs(p, ranks) if p in ranks or width > 1 else [ranks[p]] for p in pieces]


def test_few_held_slices_change_nothing(library):
    cache = bpe.Cache(bpe.load_ranks(PATH), most=3, longest=5)
    words = [" garden", "qzx", "x" * 40, "éé", " unlikelywordhere", "qzx"]
    for _ in range(3):
        assert [np.frombuffer(x, "<i4").tolist() for x in cache.ids(words[:5])] == [library.encode_ordinary(w) for w in words[:5]]


def test_query_and_offsets(spark, tmp_path, library):
    texts = ODD * 2
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256((t or "").encode()).hexdigest()
    for r in bpe.encode(docs, PATH).collect():
        data, ids = (texts[r.doc_id] or "").encode(), r.ids
        assert len(ids) == len(r.offsets)
        known = bpe._bytes_of(PATH)
        assert all(data[o : o + len(known[i])] == known[i] for i, o in zip(ids, r.offsets, strict=True))
    assert bpe.encode(docs.limit(0), PATH).count() == 0
