import random

import corpus_pipeline
import __spark_entry__ as entry

from ledgerline.llm.simhash import fingerprint

from .helpers import ODD, SCHEMA, WORDS, prose, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    passage = "\n".join(prose(rng, 20) for _ in range(3))
    long = prose(rng, 700)
    texts = [*ODD, *(prose(rng, 60) for _ in range(40))]
    near = next(x for w in WORDS if bin(fingerprint(x := f"{long} {w}") ^ fingerprint(long)).count("1") <= 2)
    texts += [f"{passage}\n{prose(rng, 30)}", f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}", long, near, "key password=hunter2hunter2 " + prose(rng, 50)]
    n = len(texts)
    toxic = [" ".join([*prose(rng, 30).split(), "moron", "scum", "idiot"]) for _ in range(40)]
    table(spark, texts + toxic).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= n)) for i in range(n + 40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == COLUMNS
            seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["toxicity"]) == set(range(n))
    first, second = n - 5, n - 4
    assert passage in seen["line_dedup"][first].text and passage not in seen["line_dedup"][second].text
    assert seen["line_dedup"][second].n_chars == len(seen["line_dedup"][second].text)
    assert n - 3 in seen["simhash"] and n - 2 not in seen["simhash"]
    assert "hunter2" not in seen["secrets"][n - 1].text and set(seen["secrets"]) == set(seen["simhash"])
    clean = set(range(len(ODD), len(ODD) + 40))
    assert clean <= set(seen["secrets"]) and all(seen["secrets"][i].text == texts[i] for i in clean)
    assert {r.doc_id for r in docs.collect()} == set(seen["secrets"])
    whole = {tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32")) for r in docs.collect()}


def test_stages_keep_columns_that_clash_and_take_odd_rows(spark, tmp_path):
    rng = random.Random(19)
    long = prose(rng, 30_000)
    own = prose(rng, 70)
    texts = [None, "", own, own, long, "\n" * 50, prose(rng, 60)]
    names = ["score", "removed_lines", "__key", "__row", "__label", "words", "spans", "fp"]
    rows = [(None if i == 6 else 1 if i in (2, 3) else i, t, None, "s", None, *names) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"odd{k}"))
        after = spark.read.parquet(str(tmp_path / f"odd{k}"))
        if k < 4:
            assert after.columns == docs.columns and all(r[c] == c for r in after.collect() for c in names)
        docs = after
    assert {r.doc_id for r in docs.collect()} >= {4, None}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
