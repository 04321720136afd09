import hashlib
from collections import defaultdict

from auxoline.llm.exact_dedup import copies, deduplicate, heavy_winners
from plain import ODD, odd_rows, python_free

TEXTS = ["same"] * 60 + [f"text {i % 40}" for i in range(80)] + ["", " same", "x" * 200_000]


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


def test_report_matches_grouping(spark):
    rows = odd_rows(TEXTS)
    docs = spark.createDataFrame(rows, ODD).repartition(5)
    for share in (1 / 1000, 1 / 5, 2.0):
        got = copies(docs, share=share).collect()
        assert len(got) == len(rows)
        groups = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in expected(rows).items()}
        for r in got:
            ids = groups[r.text_sha256]
            assert r.group_size == len(ids)
            assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept = [r.text_sha256 for r in got if r.kept]
        assert sorted(kept) == sorted(groups)


def test_documents_that_stay(spark):
    rows = odd_rows(TEXTS)
    docs = spark.createDataFrame(rows, ODD).repartition(5)
    for share in (1 / 1000, 1 / 5, 2.0):
        out = deduplicate(docs, share=share)
        assert out.schema == docs.schema
        best = {t: max((i for i in ids if i is not None), default=None) for t, ids in expected(rows).items()}
        got = [(r.text or "", r.doc_id) for r in out.collect()]
        assert sorted(got, key=str) == sorted(best.items(), key=str)


def test_heavy_digests_are_verified(spark):
    rows = spark.createDataFrame([("a" if i % 3 == 0 else f"d{i}", i, i) for i in range(3000)], "digest string, doc_id long, row long")
    (only,) = heavy_winners(rows, 1 / 10).collect()
    assert (only.digest, only.keep_id, only.group_size) == ("a", 2997, 1000)


def test_empty(spark):
    docs = spark.createDataFrame([], ODD)
    assert copies(docs).count() == 0 and deduplicate(docs).count() == 0


def test_built_in_functions_only(spark):
    docs = spark.range(5).selectExpr("id doc_id", "string(id) text")
    assert python_free(copies(docs)) and python_free(deduplicate(docs))
