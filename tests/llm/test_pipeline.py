"""The pipeline on the smallest tables: every stage acts, and clean documents stay."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_stages_act_in_order(spark):
    import corpus_pipeline
    from brute import base_spans, components, contamination, windows  # noqa: F401
    from paneltide.sources.io import stage_via_parquet

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage_via_parquet(stage(spark, docs, DATA))
        if name != "packing":
            assert docs.columns == before.columns
        rows = {r.doc_id: r for r in before.collect()}
        if name == "near_duplicates":
            found = components([(i, r.text) for i, r in rows.items()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in found.items() if i == c}
        if name == "decontamination":
            bad = {c[0] for c in contamination([(i, r.text) for i, r in rows.items()], items) if c[5]}
            assert bad and {r.doc_id for r in docs.collect()} == set(rows) - bad
        if name == "pii":
            after = {r.doc_id: r for r in docs.collect()}
            assert set(after) == set(rows)
            for i, r in after.items():
                assert not base_spans(r.text) and r.n_chars == len(r.text)
                assert base_spans(rows[i].text) or r.text == rows[i].text
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(rows)
    empty = before.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars")
                     if "text" in empty.columns else empty, DATA).count() == 0
