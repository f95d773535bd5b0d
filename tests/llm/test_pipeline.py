import collections

import corpus_pipeline
from loomtext.llm.secrets import scanner

from .test_simhash import brute_components, brute_fingerprint


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(9001, "12 34 | 56", "en", "src0", 10), (9002, None, "en", "src0", None)], docs.schema)
    docs = docs.union(junk)
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").persist()
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == docs.columns and set(after) <= set(before)
        if name == "language_id":
            assert set(before) - set(after) == {9001, 9002} and all(before[i] == t for i, t in after.items())
        if name == "line_dedup":
            lines = collections.Counter(x.strip().lower() for t in after.values() for x in t.split("\n") if x.strip())
            assert set(after) == set(before) and max(lines.values()) == 1
            assert all(set(t.split("\n")) <= {*before[i].split("\n"), ""} for i, t in after.items())
        if name == "simhash_near_dedup":
            parts = brute_components({i: brute_fingerprint(t) for i, t in before.items()})
            assert set(after) == set(parts.values()) and all(before[i] == t for i, t in after.items())
        if name == "secret_scan":
            assert set(after) == set(before) and not any(scanner().spans(t.encode()) for t in after.values())
            assert all(r.n_chars == len(r.text) for r in out.collect())
        docs, before = out, after
    bins = corpus_pipeline.packing(spark, docs, "").collect()
    assert {i for b in bins for i in b.doc_ids} == {i for i, t in before.items() if t}
    assert sum(b.n_chars for b in bins) == sum(len(t) for t in before.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_null_and_repeated_ids_reach_the_bins(spark):
    rows = [(None, "A text without an id."), (None, "Another one, also without."), (7, "Text of a repeated id."), (7, "Its second text is quite another."), (7, "Text of a repeated id.")]
    docs = spark.createDataFrame([(i, t, "en", f"src{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    bins = corpus_pipeline.packing(spark, docs, "").collect()
    parts = collections.Counter(p for b in bins for p in b.text.split("\n\n"))
    assert parts == collections.Counter(t for _, t in rows) and sum(b.n_chars for b in bins) == sum(len(t) for _, t in rows)


def test_near_dedup_keeps_other_texts_of_an_id_and_clashing_columns(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(7, "Text of a repeated id that says one thing."), (7, "Its second text is quite another one."), (7, "Text of a repeated id that says one thing."), (3, words), (9, words.upper()), (None, words)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, score_ string")
    out = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.row) for r in out.collect()) == sorted((i, t, "x") for i, t in [(7, rows[0][1]), (7, rows[1][1]), (3, words), (0, words)])
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0
