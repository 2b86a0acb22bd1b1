"""The pipeline's stages and whole runs on a small corpus."""

import corpus_pipeline
from test_operators import SCHEMA, brute_groups, many_copies, prose, words

from tidemill.llm import packing, quality


def test_pipeline(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x") for i, t in many_copies(60)]
    rows += [(100 + i, prose(60) + ".", "en", "s1", 300, "x") for i in range(40)]
    rows += [(200, "password=abcdefghijklmn " + prose(40) + ".", "en", "s2", 300, "x"), (201, None, "en", None, 0, "x"), (202, "### $$$ &&& *** " * 40, "en", "s2", 1, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert 202 not in ids and {100 + i for i in range(40)} <= ids
    one = corpus_pipeline.near_duplicate_stage(spark, kept, str(tmp_path))
    want = brute_groups([(r.doc_id, r.text) for r in kept.collect()], 5)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in want.items() if i == c}
    safe = corpus_pipeline.secret_stage(spark, one, str(tmp_path))
    assert "abcdefghijklmn" not in {r.doc_id: r.text for r in safe.collect()}[200]
    mixed = corpus_pipeline.mixing_stage(spark, safe, str(tmp_path))
    total, got = sum(len(words(r.text)) for r in safe.collect()), sum(len(words(r.text)) for r in mixed.collect())
    assert abs(got - total) < 0.2 * total
    for s in (kept, one, safe, mixed):
        assert s.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in mixed.collect()}
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    encode = packing.Encoder(packing.default_tokenizer())
    assert tokens == {r.doc_id: times[r.doc_id] * len(encode.ids([r.text or ""], 1)[0]) for r in mixed.collect()}


def test_quality_stage_keeps_what_op3_keeps(spark, tmp_path):
    """Short, blank and repeated texts that the votes alone would keep go in the stage as in the operator."""
    rows = [(i, prose(60) + ".", "en", "s1", 300, "x") for i in range(60)]
    rows += [(100, None, "en", "s", 0, "x"), (101, " ", "en", "s", 0, "x"), (102, "A short clean text of some words.", "en", "s", 0, "x"), (103, prose(100) + " " + "a phrase of eight words that comes again " * 8 + "x.", "en", "s", 0, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    op3 = quality.op3_quality_rules(spark, str(tmp_path)).collect()
    assert got == {r.doc_id for r in op3 if r.kept} == set(range(60))
    assert {r.doc_id for r in op3 if r.p_good >= 0.5} >= {100, 101, 102, 103}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
