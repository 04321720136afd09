"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked: one margin after the other is scaled to its target until all
three agree. A document is then kept with the probability of its cell (raked tokens over tokens there are, scaled to the
token budget and at most one), decided by a hash of its id, so the draw does not depend on partitions and can be repeated.

Documents are reduced to cells by one aggregation. Raking runs over the cells: in the driver if there are at most LOCAL_CELLS (a few
MB of sums, counted first), else as frames of which every round is written to the shared folder. The probabilities return to the documents by a broadcast if there are at most BROADCAST_CELLS cells, else by a
join in which every document's cell is salted, so a cell with a third of all rows is spread.

Topic: the hash class of most of the document's longer words, unless ``topic`` names a column. Tokens: white-space
words.

Rules: null text is empty; null source, language and topic are levels of their own. Documents without tokens weigh nothing and are
kept with the probability of their cell, cells without tokens with probability 0. Targets are shares of tokens: levels that have
tokens but no target get 0, levels with a target but no tokens are left out, and the rest is scaled to 1. Repeated rows share their
id's decision. Empty tables give empty results. Other columns are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auxoline.llm.flat import LOWER, chunks, flat_bytes, span_hashes, word_table, words
from auxoline.llm.frames import fresh
from auxoline.llm.registry import query, table
from auxoline.session import durable

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
#: Words of at least so many characters speak for a topic.
TOPIC_WORD = 5
#: Exponent by which the shares of sources and languages are flattened, and the share of all tokens to keep at most.
FLATTEN, BUDGET = 0.7, 0.6
ROUNDS, TOLERANCE = 50, 1e-6
LOCAL_CELLS, BROADCAST_CELLS, SALTS = 100_000, 100_000, 64
SEED = 23
_IS_WORD = word_table(b" \t\n\r\x0b\x0c")


def mark(docs: DataFrame, text: str, topic_name: str, tokens_name: str, topics: int = TOPICS) -> DataFrame:
    """``docs`` with a topic (the hash class most of the text's longer words belong to, the smaller one on ties; of a text without
    such words, the class of its first word, or 0) and its white-space words."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(topic_name, T.IntegerType()), T.StructField(tokens_name, T.LongType())])

    def run(batches):
        for batch in batches:
            buf, offsets = flat_bytes(batch.column(at))
            n = len(offsets) - 1
            topic, tokens = np.zeros(n, np.int32), np.zeros(n, np.int64)
            for a, b in chunks(offsets):
                low = LOWER[buf[offsets[a] : offsets[b]]]
                starts, ends, counts = words(low, offsets[a : b + 1] - offsets[a], _IS_WORD)
                tokens[a:b] = np.diff(counts)
                doc = np.repeat(np.arange(b - a), tokens[a:b])
                weight = np.where(ends - starts >= TOPIC_WORD, float(len(buf) + 1), 0.0)
                weight[counts[:-1][tokens[a:b] > 0]] += 0.5
                cls = (span_hashes(low, starts, ends) % np.uint64(topics)).astype(np.int64)
                topic[a:b] = np.bincount(doc * topics + cls, weight, (b - a) * topics).reshape(b - a, topics).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topic), pa.array(tokens)], names=schema.names)

    return docs.mapInArrow(run, schema)


def cells_of(docs: DataFrame) -> DataFrame:
    """source, lang, topic, tokens, n_docs of documents with columns source, lang, topic, tokens."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("n_docs"))


def flattened(cells: DataFrame, dimension: str, power: float = FLATTEN) -> DataFrame:
    """Targets (level, share): the dimension's token shares raised to a power, so that small levels gain."""
    sums = cells.groupBy(F.col(dimension).alias("level")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    return sums.select("level", F.pow("n", F.lit(power)).alias("share"))


def even(cells: DataFrame, dimension: str) -> DataFrame:
    return cells.groupBy(F.col(dimension).alias("level")).agg(F.sum("tokens").alias("n")).filter("n > 0").select("level", F.lit(1.0).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, local_cells: int = LOCAL_CELLS) -> tuple[DataFrame, float, int]:
    """``cells`` with column raked (its margins have the target shares, its total is the tokens' total), the largest deviation
    left of any margin, and the rounds taken. A deviation above the tolerance means that the targets contradict each other."""
    if cells.count() <= local_cells:
        return _rake_here(cells, targets, rounds, tolerance)
    return _rake_frames(cells, targets, rounds, tolerance)


def _rake_here(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> tuple[DataFrame, float, int]:
    rows = sorted(cells.collect(), key=repr)
    raked = np.array([r.tokens for r in rows], float)
    total, margins, deviation, taken = raked.sum(), [], 0.0, 0
    for dimension, given in targets.items():
        share = {r.level: r.share for r in given.collect()}
        levels = {v: k for k, v in enumerate(dict.fromkeys(getattr(r, dimension) for r in rows))}
        code = np.array([levels[getattr(r, dimension)] for r in rows], np.int64)
        there = np.bincount(code, raked, len(levels)) > 0 if len(rows) else np.zeros(0, bool)
        aim = np.array([share.get(v, 0.0) for v in levels], float) * there
        margins.append((code, aim / aim.sum() * total if aim.sum() else aim))
    for taken in range(1, rounds + 1 if total else 1):
        for code, aim in margins:
            now = np.bincount(code, raked, len(aim))
            raked = raked * np.divide(aim, now, out=np.zeros(len(aim)), where=now > 0)[code]
        deviation = max(float(np.abs(np.bincount(code, raked, len(aim)) - aim).max()) for code, aim in margins) / total
        if deviation <= tolerance:
            break
    schema = T.StructType([*cells.schema.fields, T.StructField("raked", T.DoubleType())])
    return cells.sparkSession.createDataFrame([(*r, float(x)) for r, x in zip(rows, raked, strict=True)], schema), deviation, taken


def _rake_frames(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> tuple[DataFrame, float, int]:
    total = cells.agg(F.sum("tokens").alias("n")).first().n or 0.0
    state, deviation, taken = durable(cells.withColumn("raked", F.col("tokens"))), 0.0, 0
    if not total:
        return state, 0.0, 0
    wanted = {}
    for dimension, given in targets.items():
        found = state.filter("raked > 0").select(F.col(dimension).alias("found")).distinct()
        there = given.join(found, F.col("level").eqNullSafe(F.col("found")), "left_semi")
        whole = there.agg(F.sum("share").alias("n")).first().n
        wanted[dimension] = durable(there.select("level", (F.col("share") / F.lit(whole) * F.lit(total)).alias("aim")))
    for taken in range(1, rounds + 1):
        for dimension, aim in wanted.items():
            sums = state.groupBy(F.col(dimension).alias("found")).agg(F.sum("raked").alias("now"))
            factor = sums.join(aim, F.col("found").eqNullSafe(F.col("level")), "left").select("found", F.when(F.col("now") > 0, F.coalesce("aim", F.lit(0.0)) / F.col("now")).otherwise(F.lit(0.0)).alias("factor"))
            state = state.join(factor, state[dimension].eqNullSafe(F.col("found"))).withColumn("raked", F.col("raked") * F.col("factor")).drop("found", "factor")
        state = durable(state)
        deviation = max(_deviation(state, dimension, aim, total) for dimension, aim in wanted.items())
        if deviation <= tolerance:
            break
    return state, deviation, taken


def _deviation(state: DataFrame, dimension: str, aim: DataFrame, total: float) -> float:
    sums = state.groupBy(F.col(dimension).alias("found")).agg(F.sum("raked").alias("now"))
    both = sums.join(aim, F.col("found").eqNullSafe(F.col("level")), "full")
    return both.agg(F.max(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("aim", F.lit(0.0)))).alias("off")).first().off / total


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with column probability: raked tokens over tokens there are, times one scale for all cells, at most 1.

    The scale is the one that keeps ``budget`` of all tokens; cells that are too small for their share are kept whole and the others
    make up for them."""
    tokens, wanted = F.col("tokens"), F.col("raked")
    total, most = raked.agg(F.sum("tokens").alias("n"), F.max(F.when(wanted > 0, tokens / wanted)).alias("m")).first()
    low, high = 0.0, float(most or 0.0)
    for _ in range(4 if total else 0):
        tries = [low + (high - low) * k / 32 for k in range(33)]
        sums = raked.agg(*[F.sum(F.least(tokens, F.lit(x) * wanted)).alias(f"s{k}") for k, x in enumerate(tries)]).first()
        under = max((k for k in range(33) if sums[k] <= budget * total), default=0)
        low, high = tries[under], tries[min(32, under + 1)]
    return raked.withColumn("probability", F.when(tokens > 0, F.least(F.lit(1.0), F.lit(low) * wanted / tokens)).otherwise(F.lit(0.0)))


def unit_hash(*keys: str, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def with_probability(docs: DataFrame, cells: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Join each document's cell probability: ``columns`` are the documents' source, lang and topic."""
    salted = cells.count() > BROADCAST_CELLS
    key, salt, theirs, value = fresh(docs, "cell", "salt", "cell_key", name)
    same = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns])
    right = cells.select(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in DIMENSIONS]).alias(theirs), F.col("probability").alias(value))
    left = docs.withColumn(key, same)
    if not salted:
        return left.join(F.broadcast(right), F.col(key) == F.col(theirs), "left").drop(key, theirs)
    right = right.withColumn(f"{salt}_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return left.join(right, (F.col(key) == F.col(theirs)) & (F.col(salt) == F.col(f"{salt}_r")), "left").drop(key, theirs, salt, f"{salt}_r")


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with topic, tokens, probability and kept (their names are returned).

    ``targets`` maps source, lang and topic to frames (level, share); by default shares are flattened for sources and languages
    and even over topics.
    """
    names = fresh(docs, "topic", "tokens", "probability", "kept")
    marked = mark(docs, text, names[0], names[1])
    marked = marked.withColumn(names[0], F.col(topic)) if topic else marked
    cells = durable(cells_of(marked.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(names[0]).alias("topic"), F.col(names[1]).alias("tokens"))))
    wanted = {"source": flattened(cells, "source"), "lang": flattened(cells, "lang"), "topic": even(cells, "topic")} | (targets or {})
    raked, _, _ = rake(cells, wanted)
    chances = durable(probabilities(raked, budget))
    out = with_probability(marked, chances, [source, lang, names[0]], names[2])
    return out.withColumn(names[3], unit_hash(doc_id) < F.col(names[2])), names


@query("op2_mixture")
def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix_sources(docs)[0].drop("text")
