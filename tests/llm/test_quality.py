import random

import numpy as np
from pyspark.sql import functions as F

from auxoline.llm.quality import gumbel, keep_good, kth_largest, label_sample, score
from plain import ODD, odd_rows


def test_kth_largest_is_exact(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(30_000)] + [0.25] * 5000 + [1e9, -1e9]
    keys = spark.createDataFrame([(v,) for v in values], "key double").cache()
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 500, 12_000, 17_000, len(values) - 1, len(values), len(values) + 5):
        assert kth_largest(keys, k) == ordered[min(k, len(values)) - 1]


def test_gumbel_draw_follows_the_weights(spark):
    keys = spark.range(200_000).select((F.col("id") % 4).alias("w"), (F.log(1.0 + F.col("id") % 4) + gumbel(3, "id")).alias("key")).cache()
    least = kth_largest(keys, 2000)
    counts = {r.w: r["count"] for r in keys.filter(F.col("key") >= least).groupBy("w").count().collect()}
    assert sum(counts.values()) == 2000
    assert all(abs(counts[w] / 2000 - (1 + w) / 10) < 0.04 for w in range(4))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    scores, least, _ = score(docs, learned)
    wrong = held.join(scores, "doc_id").groupBy("quality").agg(F.avg((F.col("key") >= least).cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in wrong}
    assert kept[1] > 0.995 and kept[0] < 0.02


def test_odd_documents(spark):
    prose = [" ".join(np.random.default_rng(i).choice(["the", "cat", "sat", "on", "a", "mat."], 40)) for i in range(60)]
    junk = ["$$$ ### BUY!! " * 20] * 6
    docs = spark.createDataFrame(odd_rows([*prose, *junk, "", "a", "x" * 100_000]), ODD)
    labels = spark.createDataFrame([*[(i, 1, 0) for i in range(0, 60, 2)], *[(i, 0, 0) for i in (60, 61)], (None, 1, 0), (900, 1, 0), (5, None, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    out = keep_good(docs, labels)
    assert out.schema == docs.schema
    texts = [r.text for r in out.collect()]
    assert not any(t and "$$$" in t for t in texts) and set(prose) <= set(texts)
    assert label_sample(labels, most=5).count() == 5


def test_without_labels_or_documents(spark):
    docs, labels = spark.createDataFrame(odd_rows(["a b c d e", "f"]), ODD), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert keep_good(docs, labels.limit(0)).count() == docs.count()
    assert keep_good(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels.withColumn("quality", F.lit(0))).count() == docs.count()
