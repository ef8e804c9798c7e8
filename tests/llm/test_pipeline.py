"""The stages against their operators, and the guard of the entry point."""

import corpus_pipeline
from marginalia.llm import pii, simhash
from marginalia.llm.common import materialize, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = materialize(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        sizes.append(len(rows))
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            continue
        assert docs.columns == names
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "near_duplicates":
            low = {(r.component_id) for r in simhash.components(table(spark, sf_dir, "documents").where(f"doc_id in ({','.join(map(str, before))})")).collect()}
            assert set(after) == low
        if name == "personal_data":
            assert set(after) == set(before) and not any(pii.base_spans(t) for t in after.values() if "@" in t)
            assert all(r.n_chars == len(r.text) for r in rows)
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]


def test_stages_on_awkward_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "hello there my friend", "en", "s", 9), (3, "hello there my friend", "en", "s", 9), (4, "hello there my friend", "en", "s", 9), (None, "no id here", None, None, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "rows")
    kept = {name: materialize(stage(spark, docs, sf_dir), name).collect() for name, stage in corpus_pipeline.STAGES}
    assert sorted(str(r.doc_id) for r in kept["near_duplicates"]) == ["1", "3", "None"]
    assert len(kept["decontamination"]) == len(kept["personal_data"]) == 6
    assert len(kept["packing"]) == 6
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
