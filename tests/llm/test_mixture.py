import numpy as np
import pytest
from pyspark.sql import functions as F

from auxoline.llm import mixture as M
from plain import ODD, odd_rows


def cells(spark, seed=1, drop=0.2):
    rng = np.random.default_rng(seed)
    rows = [(f"s{a}" if a else None, f"l{b}", c, float(rng.integers(1, 500)), 3) for a in range(5) for b in range(3) for c in range(4) if rng.random() > drop]
    return rows, spark.createDataFrame(rows, "source string, lang string, topic int, tokens double, n_docs long").cache()


def targets(spark, rows):
    rng = np.random.default_rng(9)
    out = {}
    for k, name in enumerate(M.DIMENSIONS):
        levels = sorted({r[k] for r in rows}, key=str)
        kind = "int" if name == "topic" else "string"
        out[name] = spark.createDataFrame([(v, float(rng.random() + 0.3)) for v in levels] + [(99 if kind == "int" else "none", 5.0)], f"level {kind}, share double")
    return out


@pytest.mark.parametrize("local_cells", [10_000, 0])
def test_margins_reach_their_targets(spark, local_cells):
    rows, frame = cells(spark)
    wanted = targets(spark, rows)
    raked, deviation, rounds = M.rake(frame, wanted, rounds=40 if local_cells else 12, tolerance=1e-3, local_cells=local_cells)
    assert deviation <= 1e-3 and rounds > 1
    got = raked.collect()
    total = sum(r[3] for r in rows)
    for k, name in enumerate(M.DIMENSIONS):
        share = {r.level: r.share for r in wanted[name].collect() if r.level not in ("none", 99)}
        for level, s in share.items():
            assert sum(r.raked for r in got if r[k] == level) == pytest.approx(total * s / sum(share.values()), abs=total * 2e-3)
    # Raking scales margins only: odds ratios inside the table stay.
    w = {(r.source, r.lang, r.topic): r.raked / r.tokens for r in got}
    for (a, b, c), x in w.items():
        if (a, "l0", c) in w and ("s1", b, c) in w and ("s1", "l0", c) in w:
            assert x * w["s1", "l0", c] == pytest.approx(w[a, "l0", c] * w["s1", b, c], rel=1e-6)


def test_both_ways_agree(spark):
    rows, frame = cells(spark, 4)
    wanted = targets(spark, rows)
    a, b = ({(r.source, r.lang, r.topic): r.raked for r in M.rake(frame, wanted, rounds=3, tolerance=0, local_cells=n)[0].collect()} for n in (10_000, 0))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_contradicting_targets_are_told(spark):
    frame = spark.createDataFrame([("a", "x", 0, 1.0, 1), ("b", "y", 0, 1.0, 1)], "source string, lang string, topic int, tokens double, n_docs long")
    wanted = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "level string, share double"), "lang": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "level string, share double")}
    assert M.rake(frame, wanted, rounds=20)[1] > 0.1


def test_probabilities_keep_the_budget(spark):
    rows, frame = cells(spark)
    raked, _, _ = M.rake(frame, targets(spark, rows))
    got = M.probabilities(raked, 0.5).collect()
    assert all(0 <= r.probability <= 1 for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.5 * sum(r.tokens for r in got), rel=1e-3)
    free = [r for r in got if r.probability < 1]
    scale = [r.probability * r.tokens / r.raked for r in free]
    assert max(scale) == pytest.approx(min(scale))


def test_salted_join_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, names = M.mix_sources(docs)
    want = sorted(map(tuple, out.drop("text").collect()))
    monkeypatch.setattr(M, "BROADCAST_CELLS", 0)
    assert sorted(map(tuple, M.mix_sources(docs)[0].drop("text").collect())) == want
    kept = out.groupBy("source").agg(F.sum(F.when(F.col(names[3]), F.col(names[1])).otherwise(0)).alias("k")).collect()
    assert len(kept) == 20


def test_odd_documents(spark):
    docs = spark.createDataFrame(odd_rows(["a b c", "", "longer words here", "x" * 100_000]), ODD).withColumn("source", F.when(F.col("rank") < 2, "s")).withColumn("lang", F.lit(None).cast("string")).withColumn("Topic", F.lit("theirs"))
    out, names = M.mix_sources(docs)
    got = out.collect()
    assert len(got) == docs.count() and out.columns == [*docs.columns, *names] and names[0] == "topic_"
    assert {r[names[1]] for r in got if r.text == "a b c"} == {3}
    assert M.mix_sources(docs.limit(0))[0].count() == 0
    alike = {}
    for r in got:
        assert alike.setdefault((r.doc_id, r[names[2]]), r[names[3]]) == r[names[3]]
