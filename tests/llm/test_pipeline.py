"""The pipeline against a plain version of its filtering stages, and on odd rows."""

import corpus_pipeline


def test_stages_on_a_small_corpus(spark):
    own = [" ".join(f"d{i}w{j}" for j in range(300)) for i in range(12)]
    passage = " ".join(f"p{j}" for j in range(70))
    texts = own[:4] + [f"{t} {passage}" for t in own[4:8]] + [own[0], own[1] + " end", None, "", "short text"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, note string"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "n") for i, t in enumerate(texts)], kind)
    stage = dict(corpus_pipeline.STAGES)
    ruled = stage["quality_rules"](spark, docs, "")
    assert sorted(r["doc_id"] for r in ruled.collect()) == list(range(10))
    single = stage["near_copies"](spark, ruled, "")
    assert sorted(r["doc_id"] for r in single.collect()) == list(range(8))
    cleaned = stage["repeated_strings"](spark, single, "")
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert cleaned.columns == docs.columns
    assert [got[i]["text"] for i in range(4)] == texts[:4]
    # with the passage goes what stands before it in all four texts alike
    assert [got[i]["text"] for i in range(4, 8)] == [t[: -len("w299")] for t in own[4:8]]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    mixed = stage["mixed_sources"](spark, cleaned, "")
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert set(r["text"].split()) <= set(got[r["doc_id"]]["text"].split())
    packed = stage["packed"](spark, mixed, "")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)


def test_columns_with_the_names_of_working_columns_stay_as_they_are(spark):
    names = ["_row", "_common", "_kept", "_pass", "_doc", "doc", "row", "common", "kept", "n_words", "_text", "key"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{n} string" for n in names
    )
    texts = [" ".join(f"d{i}w{j}" for j in range(300)) for i in range(6)] + ["too short"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} == set(range(6))
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_empty_table_passes_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "empty")
    assert docs.count() == 0
