import random
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.llm import toxicity
from ledgerline.llm.common import teaching

from .helpers import ODD, SCHEMA, WORDS, prose, table

BAD = ["idiot", "moron", "stupid", "loser", "scum"]


@pytest.fixture(scope="module")
def cost():
    counts = np.zeros(toxicity.SIZE**3, dtype=np.int64)
    of = toxicity._numbers()
    text = "  " + "  ".join((WORDS + BAD * 2 + ["a"] * 9) * 50) + "  "
    x = of[[ord(c) for c in text]]
    np.add.at(counts, (x[:-2] * toxicity.SIZE + x[1:-1]) * toxicity.SIZE + x[2:], 1)
    return toxicity.language_model(counts)


def _spaced(r, text):
    """Words that the text's runs of fragments spell, each run decoded whole."""
    return [w for run in toxicity.RUN.findall(text) for w in r.joined(" ".join(run.split()))]


def test_viterbi_equals_all_paths(cost):
    def paths(options):
        out = [("", 0.0)]
        for o in options:
            out = [(s + c, p + price) for s, p in out for c, price in o]
        return out

    def total(word, paid):
        a = b = 0
        for c in word:
            n = toxicity.NUMBER.get(c, 0)
            paid, a, b = paid + cost[a, b, n], b, n
        return paid + cost[a, b, 0]

    for token in ("1d10t", "l0s3r", "sc.um", "moooron", "st-up1d", "8ad|y"):
        want = min((total(w, p), w) for w, p in paths(toxicity.lattice(token)))
        assert abs(total(toxicity.decode(token, cost), 0) - total(want[1], 0)) < 1e-9 or toxicity.decode(token, cost) == want[1]


def test_disguises_are_undone(cost):
    r = toxicity.Restorer(cost)
    for token, word in {"1d10t": "idiot", "IDIOT!!": "idiot", "l0s3r": "loser", "idiiiiot": "idiot", "s.t.u.p.i.d": "stupid", "m0r0n,": "moron", "$tup1d": "stupid", "sc​um": "scum"}.items():
        assert r.word(token) == word
    assert _spaced(r, "you m o r o n go") == ["moron"] and _spaced(r, "a b") == []
    assert r.word("garden") == "garden" and r.word("2024") == "2024" and r.word("***") == ""
    assert r.text("such a l o s e r here") == "such a loser here"


def test_disguises_of_any_length_are_undone(cost):
    r = toxicity.Restorer(cost)
    gaps = (" " * 30).join("moron")
    assert _spaced(r, gaps) == ["moron"] and r.text(gaps) == "moron"
    assert "".join(_spaced(r, " ".join("idiot" * 30))).replace(" ", "") == "idiot" * 30
    assert r.word("id" + "i" * 100_000 + "ot") == "idiot"
    assert r.word(".".join("stupid") + "." + ".".join("garden" * 8)).startswith("stupid")
    assert all(len(k) <= toxicity.KEPT_LENGTH for k in r.known)


def test_every_disguise_of_the_lattice_reaches_it(cost):
    r, tokens = toxicity.Restorer(cost), toxicity.Tokens(cost)
    for token, word in {"iddiott": "idiot", "stuupid": "stupid", "mor0n!": "moron", "(l0ser)": "loser", "$tup!d!": "stupid"}.items():
        assert r.word(token) == word
    assert "loser" in r.readings("10$3|2") or "los" in r.readings("10$")[1]
    assert r.readings("2024")[0] == "2024" and r.readings("5(")[0] == "5" and set(r.readings("5(")[1]) <= set("sc")
    for text in ("1 d ! o t", "i. d. i. o. t", "i\td\ni\to\tt", "idi ot", "i di ot"):
        assert "idiot" in tokens.distinct(text), text
    assert "stupid" in tokens.distinct("such stu pid things")
    assert "moron" in tokens.distinct("m o r o n") and r.word("длинный") == "длинный"


LETTER = st.sampled_from("abcdeilmnorstu")


@given(st.lists(LETTER, min_size=1, max_size=9), st.lists(st.booleans(), min_size=9, max_size=9))
@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
def test_doubled_letters_are_decided_as_viterbi_does(cost, letters, doubled):
    plain = [c for c, b in zip(letters, [None, *letters], strict=False) if c != b]
    word = "".join(c * (1 + d) for c, d in zip(plain, doubled, strict=False))
    assert toxicity.Restorer(cost)._collapsed(word) == toxicity.decode(word, cost)


FRAGMENTS = st.sampled_from(["a", "i", "o", "de", "la", "en", "id", "ot", "io", "mo", "ron", "st", "up", "sc", "um", "lo", "ser", "los", "er", "de,", "l0", "$t", "ll", "a.", "!", "so", "riv", "the"])


@given(st.lists(FRAGMENTS, min_size=1, max_size=9), st.lists(FRAGMENTS, max_size=9))
@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
def test_runs_cut_where_spaces_stay_spell_what_whole_runs_spell(cost, one, two):
    tokens, r = toxicity.Tokens(cost), toxicity.Restorer(cost)
    texts = [" ".join(one), "between " + " ".join(two) + " others " + " ".join(one)]
    owner, word, names = tokens.words(texts)
    for k, text in enumerate(texts):
        want = {w for t in text.split() for w in r.readings(t)} | set(_spaced(r, text))
        assert {names[w] for w in word[owner == k]} == want - {""}


def test_model_and_sample(spark):
    """Repeated keys, copies and conflicting labels teach once each; the sample's bound holds."""
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "a b"), (2, None), (2, None), (None, "x"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = sorted((r["__label"], r.text) for r in teaching(docs, labels, "toxic", 100).collect())
    assert [x for x, _ in got] == [0.0, 1.0, 1.0] and sum(t == "" for _, t in got) == 2
    assert teaching(docs, labels, "toxic", 2).count() == 2


def test_names_long_texts_and_repeated_rows(spark, cost):
    model = toxicity.Model(cost, {"moron": 9.0, "^idi": 7.0}, 0.0, -4.0)
    long = "a b c d e f " * 40_000 + "m o r o n"
    rows = [(1, "you 1d10t", 5.0, "x"), (1, "you 1d10t", 5.0, "x"), (2, None, None, None), (3, long, 1.0, "y"), (4, "", 0.0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE double, __label string")
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "text", "__label", "score"]
    assert sorted((r.doc_id, r.score > 0.7) for r in got.collect()) == [(1, True), (1, True), (2, False), (3, True), (4, False)]
    kept = toxicity.score(df, model, into="__s").collect()
    assert {r.SCORE for r in kept} == {5.0, None, 1.0, 0.0}
    assert sorted(r.restored or "" for r in toxicity.restored(df.where("doc_id < 3"), model).collect()) == ["", "you idiot", "you idiot"]


def test_trigrams_count_all_texts(spark):
    got = toxicity.trigrams(table(spark, ["ab", "AB ab", None, ""]).select("text"))
    a, b = toxicity.NUMBER["a"], toxicity.NUMBER["b"]
    assert got[(a * toxicity.SIZE + b) * toxicity.SIZE] == 3


def test_query(spark, tmp_path):
    rng = random.Random(7)
    texts, toxic = list(ODD), [0] * len(ODD)
    for i in range(400):
        words = prose(rng, 40).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(BAD)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, y in enumerate(toxic)] + [(None, 1, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) / len(held) > 0.95
    assert all(got[i].predicted == 0 for i in range(len(ODD)))


def test_without_labels_or_documents(spark, tmp_path):
    table(spark, ["one", "two"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r.predicted for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()] == [0, 0]
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert toxicity.op3_toxicity(spark, str(empty)).count() == 0
