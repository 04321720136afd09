import corpus_pipeline as P
from auxoline.llm.registry import table
from plain import item_words, links_of, roots


def test_each_stage_on_its_own_input(spark, sf):
    docs = table(spark, sf, "documents")
    columns, quality = docs.columns, {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    grams = set()
    for r in table(spark, sf, "benchmark").collect():
        w = item_words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, min(1, len(w))))}
    before = docs.collect()
    for name, stage in P.STAGES:
        out = stage(spark, spark.createDataFrame(before, docs.schema), sf)
        after = out.collect()
        ids = {r.doc_id for r in after}
        assert ids <= {r.doc_id for r in before} and len(ids) == len(after)
        if name != "mixture":
            assert out.columns == columns
        if name == "quality":
            assert not any(quality.get(i) == 0 for i in ids)
            assert all(r.doc_id in ids for r in before if quality.get(r.doc_id) == 1)
        if name == "exact_dedup":
            assert ids == {max(r.doc_id for r in before if r.text == t) for t in {r.text for r in before}}
        if name == "near_dedup":
            root = roots([r.doc_id for r in before], links_of([(r.doc_id, r.text) for r in before], 5, 80))
            assert ids == set(root.values())
        if name == "decontamination":
            def hit(text):
                w = item_words(text)
                return any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))
            assert ids == {r.doc_id for r in before if not hit(r.text)}
        if name == "mixture":
            assert 0.3 < len(after) / len(before) < 0.95
        before = after if name == "mixture" else [r for r in after]


def test_run_and_contract(spark, sf):
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixture"]
    assert P.ORACLE_SQL is None
    out = P.run(spark, sf)
    assert 0 < out.count() < table(spark, sf, "documents").count()
