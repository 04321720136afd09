"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: one of target text (labelled as good) and one of raw text (all
documents). A document's log weight is the log ratio of the two, per n-gram, so that long documents are not
favoured; :func:`resample` draws k documents without replacement with probabilities proportional to the weights (Gumbel
top-k: the k largest of log weight plus Gumbel noise). Documents that are not drawn are rejected.

N-grams: byte 4-grams of the text, and 3-grams of token shapes (case, letters, digits, symbols, trailing punctuation, and whether a token
has just occurred), both hashed into BUCKETS.

The raw model counts every n-gram of every document; tasks sum BUCKETS counters before they send them. The target model and the
cut use at most SAMPLE labelled documents, those with the smallest hash of their id. k is the number of documents whose weight
reaches that of the SPARED quantile of good sample documents (or, if larger, the weight that best splits the sample), and the
k-th largest key is found by counting keys in ever finer ranges, so nothing is sorted or gathered.

Rules: null text counts as empty; a document without n-grams has the weight of a model that knows nothing (0). Labels without
a document, null labels and null ids are ignored; of several labels of an id the smallest counts. Without good labels all documents
stay. Equal keys at the cut all stay. Other columns are carried by :func:`keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxoline.llm.flat import chunks, flat_bytes, mix, span_hashes, word_table, words
from auxoline.llm.frames import fresh, stored
from auxoline.llm.registry import query, table
from auxoline.session import durable

BUCKETS = 1 << 16
#: Most labelled documents that the target model and the cut are fitted on.
SAMPLE = 20_000
#: Share of good sample documents that the cut may lose.
SPARED = 0.001
#: Additive smoothing of the bucket counts.
SMOOTH = 0.5
#: Log weights are per n-gram; the noise of the draw is scaled down so that its scale is this many log units per n-gram.
NOISE = 0.001
SEED = 17
#: Keys that may be left in a range when the cut is read off exactly.
LAST_KEYS = 10_000

_IS_WORD = word_table(b" \t\n\r\x0b\x0c")
_KIND = np.zeros(256, np.uint64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 5
_KIND[_KIND == 0] = 6
#: Tokens in which a repetition is looked for.
BACK = 3


def _shapes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number for the shape of each token, and token counts before each text."""
    starts, ends, counts = words(buf, offsets, _IS_WORD)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    kind = _KIND[buf]
    hashes = span_hashes(buf, starts, ends)
    last, second = kind[ends - 1], kind[np.maximum(ends - 2, starts)]
    shape = kind[starts] + 8 * last + 64 * second + 512 * kind[starts + (ends - starts) // 2] + 4096 * np.minimum(ends - starts, 3).astype(np.uint64)
    again = np.zeros(len(hashes), bool)
    for back in range(1, BACK + 1):
        again[back:] |= hashes[back:] == hashes[:-back]
    return shape + np.uint64(1 << 16) * again.astype(np.uint64), counts


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of a chunk of texts, and the text it belongs to."""
    n = len(offsets) - 1
    b = buf.astype(np.uint64)
    four = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24) if len(b) > 3 else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    whole = text[: len(four)] == text[3:] if len(four) else np.zeros(0, bool)
    shape, counts = _shapes(buf, offsets)
    three = shape[:-2] | shape[1:-1] << np.uint64(20) | shape[2:] << np.uint64(40) if len(shape) > 2 else np.zeros(0, np.uint64)
    token_text = np.repeat(np.arange(n), np.diff(counts))
    both = token_text[: len(three)] == token_text[2:] if len(three) else np.zeros(0, bool)
    keys = np.concatenate([four[whole], three[both] | np.uint64(1 << 63)])
    return (mix(keys) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([text[: len(four)][whole], token_text[: len(three)][both]])


def label_sample(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled ids: sample_id, good. A top-k by hash, so its size is bounded."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("sample_id")).agg(F.min(label).alias("good"))
    return known.orderBy(F.xxhash64("sample_id"), "sample_id").limit(most)


def fit_weights(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray | None:
    """Log ratio of the target and the raw model for every bucket; None without good documents."""
    given = docs.select(F.col(doc_id).alias("sample_id"), F.col(text).alias("text")).join(F.broadcast(sample), "sample_id", "left").select("text", (F.col("good") > 0).alias("good"))
    schema = "bucket int, raw long, target long"

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            buf, offsets = flat_bytes(batch.column(0))
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in chunks(offsets):
                bucket, doc = grams(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[a:b][doc]], minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "raw", "target"])

    counts = np.zeros((2, BUCKETS))
    for row in given.mapInArrow(count, schema).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS rows
        counts[:, row.bucket] = row.raw, row.target
    if not counts[1].any():
        return None
    logs = np.log(counts + SMOOTH) - np.log(counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return logs[1] - logs[0]


def weigh(docs: DataFrame, weights: np.ndarray, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the mean log ratio of their n-grams in column ``name``."""
    known, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            buf, offsets = flat_bytes(batch.column(at))
            out = np.zeros(len(offsets) - 1)
            for a, b in chunks(offsets):
                bucket, doc = grams(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(doc, minlength=b - a)
                out[a:b] = np.bincount(doc, known.value[bucket], b - a) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel(seed: int, *keys: str) -> Column:
    """Standard Gumbel noise fixed by the keys."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int, column: str = "key") -> float:
    """The k-th largest value of a column (NaN and null free), by counting in ever finer ranges."""
    low, high, n = keys.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n")).first()
    if k >= n:
        return low
    above, value = 0, F.col(column)
    while n > LAST_KEYS and low < high:
        width = (high - low) / 1024
        # Empty steps cannot split a range of neighbouring floats any further.
        if low + width <= low:
            break
        slot = F.least(F.floor((value - low) / width), F.lit(1023)).alias("slot")
        found = keys.filter((value >= low) & (value <= high)).groupBy(slot).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(found, key=lambda r: -r.slot):
            if above + r.n >= k:
                low, high, n = r.a, r.b, r.n
                break
            above += r.n
    counts = {r[0]: r[1] for r in keys.filter((value >= low) & (value <= high)).groupBy(column).agg(F.count("*").alias("n")).collect()}
    for v in sorted(counts, reverse=True):
        above += counts[v]
        if above >= k:
            return v
    return low


def cut_of(scores: DataFrame, sample: DataFrame, spared: float = SPARED) -> float:
    """The weight from which documents count as drawn candidates, read off the labelled sample."""
    known = scores.join(F.broadcast(sample), scores["doc_id"] == sample["sample_id"]).select("good", "weight").collect()  # at most SAMPLE ids
    good = np.sort([r.weight for r in known if r.good > 0])
    bad = np.sort([r.weight for r in known if r.good <= 0])
    least = good[int(spared * len(good))]
    # The weight between the two groups where fewest of the sample are on the wrong side, if that spares more good ones.
    tries = np.unique(np.concatenate([bad + 1e-9, good]))
    wrong = np.searchsorted(good, tries) + len(bad) - np.searchsorted(bad, tries)
    best = tries[wrong == wrong.min()]
    return float(min(least, (best[0] + best[-1]) / 2))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, float | None, np.ndarray | None]:
    """Written scores (doc_id, weight, key), the key from which documents are drawn, and the bucket weights."""
    sample = durable(label_sample(labels))
    weights = fit_weights(docs, sample, doc_id, text)
    if weights is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("key")), None, None
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scores = stored(weigh(given, weights, "weight", "text").select("doc_id", "weight", (F.col("weight") + NOISE * gumbel(SEED, "doc_id")).alias("key")))
    cut = cut_of(scores, sample)
    k = scores.filter(F.col("weight") >= cut).count()
    return scores, (kth_largest(scores, k) if k else float("inf")), weights


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents, with all their columns."""
    _, least, weights = score(docs, labels, doc_id, text)
    if weights is None:
        return docs
    (name,) = fresh(docs, "weight")
    return weigh(docs, weights, name, text).filter(F.col(name) + NOISE * gumbel(SEED, doc_id) >= least).select(*docs.columns)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, least, _ = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("kept", F.lit(True) if least is None else F.col("key") >= least)
