import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from ledgerline.llm import packing

from .helpers import ODD, prose, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow_first_fit(lengths, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        for b, used in enumerate(bins):
            if used + lengths[i] <= capacity:
                out[i] = (b, used)
                bins[b] += lengths[i]
                break
        else:
            out[i] = (len(bins), 0)
            bins.append(lengths[i])
    return out


def test_tournament_tree_equals_first_fit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        lengths = rng.integers(1, 60, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == slow_first_fit(lengths.tolist(), 64)


def test_ids_equal_the_library():
    import random

    rng = random.Random(6)
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = "ab <|endoftext|>é1٣2'  \n\t\r'drvelm'!?*_ 😀ñÅÅ.　ΣςİKſŉßŁ,́"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(500)] + ["Word!!! WORD*** word, word. 'word' don't <|endoftext|> x<|startoftext|>"]
    texts += [chr(c) * 3 + "!" + chr(c) for c in range(1, 0x260)]
    for _ in range(2):
        ids, counts = packing.token_ids(pa.array(texts), PATH)
        for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    for few in ([None, "", " \n "], ["Word!!"], []):
        ids, counts = packing.token_ids(pa.array(few, pa.string()), PATH)
        assert ids.tolist() == [i for t in few for i in tokenizer.encode(t or "", add_special_tokens=False).ids] and len(counts) == len(few)
    sliced = pa.array(["x", "One two!", "é, 2", "y"]).slice(1, 2)
    assert packing.token_ids(sliced, PATH)[0].tolist() == [i for t in ("One two!", "é, 2") for i in tokenizer.encode(t, add_special_tokens=False).ids]


def test_query(spark, tmp_path):
    import random

    rng = random.Random(8)
    texts = ODD + [prose(rng, rng.choice([3, 40, 300, 1500])) for _ in range(60)]
    table(spark, texts).unionByName(table(spark, texts).where("doc_id = 20")).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op7_packing(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values())) + len(ids[20])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(s)) and s[-1].offset + s[-1].length <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) * 1.3 + 1


def test_groups_and_ids(spark):
    docs = table(spark, ["word " * n for n in range(1, 80)])
    cut = packing.pieces(docs, PATH, capacity=32, ids=True)
    packed = packing.pack(cut, 32, group_rows=10).collect()
    assert len({r.sequence_id >> 32 for r in packed if r.sequence_id >= 0}) > 3
    full = {}
    for r in packed:
        full.setdefault(r.sequence_id, 0)
        full[r.sequence_id] += r.length
        assert len(r.ids) == r.length
    assert max(full.values()) <= 32
    assert packing.pack(packing.pieces(docs.limit(0), PATH)).count() == 0
