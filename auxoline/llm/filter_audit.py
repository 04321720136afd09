"""How much each of several filters removes, alone, in every order, and as a fair share: Hart and Mas-Colell's potential.

Every document fails some set of filters. A coalition of filters removes the documents that fail any of them, whatever the order,
so the numbers of documents by set of failures give the removal game ``v`` of all coalitions of a part. The potential is recursive,

    P() = 0,    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,

and the Shapley value of filter i is P(all) - P(all without i). With R(S) = |S|! P(S) everything stays whole:
R(S) = (|S| - 1)! v(S) + sum of R(S without i). What a filter removes at a step of an order is v(before and it) - v(before).

Counting is one aggregation by (part, failures, labels) with few groups; a duplicate's failure comes from the smallest doc_id of each
digest, joined back by (doc_id, digest), so that no group of copies is gathered anywhere.

Rules: null text counts as empty, null part values as ''. A text is a duplicate if some row of a smaller doc_id has the same text;
a null doc_id is neither smaller nor greater than another. Repeated rows are documents of their own. A document is good or toxic if any of its labels
says so; null labels and labels of null doc_ids say nothing. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.frames import stored
from auxoline.llm.registry import query, table

#: Fixed by the contract: characters that part words, and those of filter D.
SPACE, MARKS = "\t\n\x0b\x0c\r ", "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions under which filters A to D remove a text that is not null."""
    words = F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct.cast("bigint") < LEAST_DISTINCT * n.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > MOST_CAPITALS * F.char_length(text).cast("bigint"),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and mask of every document; bit k of mask is set if the text fails the k-th filter of ABCDE."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(text_failures(F.col("text")).values())]
    rows = stored(given.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(lambda a, b: a + b, bits).alias("mask")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.filter("doc_id is not null").join(firsts, ["doc_id", "digest"], "left")
    copied = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << len(bits)))
    return known.select("doc_id", "part", (F.col("mask") + copied).alias("mask")).unionByName(rows.filter("doc_id is null").select("doc_id", "part", "mask"))


def failure_counts(marked: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail exactly the filters of ``mask``, and those with a label among them."""
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    known = known.agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    labelled = marked.filter("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "good", "toxic")
    rest = marked.filter("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return labelled.unionByName(rest).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def coalition_game(counts: DataFrame, filters: int) -> DataFrame:
    """part, documents, and arrays over all coalitions: removed ``v``, ``good`` and ``toxic``, and ``fails``, documents that fail exactly those filters.

    ``counts`` has one row per part and mask, so no more than 2 ** filters rows of a part are brought together.
    """
    found = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    game = counts.groupBy("part").agg(F.sum("n").cast("bigint").alias("documents"), found.alias("found"))
    coalitions = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    zero = F.lit(0).cast("bigint")
    exactly = lambda c: F.transform(coalitions, lambda m: F.coalesce(F.col("found")[m][c], zero))
    game = game.select("part", "documents", *[exactly(c).alias(f"{c}_exactly") for c in ("n", "good", "toxic")])

    def removed(c: str) -> Column:
        some = lambda s: F.transform(F.col(f"{c}_exactly"), lambda n, m: F.when(m.bitwiseAND(s) != 0, n).otherwise(zero))
        return F.transform(coalitions, lambda s: F.aggregate(some(s), zero, lambda total, n: total + n))

    return game.select("part", "documents", F.col("n_exactly").alias("fails"), removed("n").alias("v"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def potentials(game: DataFrame, filters: int, v: str = "v", out: str = "potential") -> DataFrame:
    """``game`` with the array ``out`` of |S|! P(S) for every coalition S, each from the coalitions with one filter less."""
    bits = F.array(*[F.lit(1 << i) for i in range(filters)])
    weights = F.array(*[F.lit(factorial(k)).cast("bigint") for k in range(filters)])

    def and_next(found: Column, s: Column) -> Column:
        # Without one of its bits a number is smaller: those values are there.
        below = F.aggregate(F.filter(bits, lambda b: s.bitwiseAND(b) != 0), F.lit(0).cast("bigint"), lambda total, b: total + found[s.bitwiseXOR(b)])
        return F.concat(found, F.array(weights[F.bit_count(s) - 1] * F.col(v)[s] + below))

    return game.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("bigint")), and_next))


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`failure_counts`; ``letters`` name the bits of masks, lowest first."""
    n = len(letters)
    orders = ",".join("".join(order) for order in permutations(letters))
    # The arrays of a part are worked out once; orders and steps only look them up.
    rows = potentials(coalition_game(counts, n), n).withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    earlier = F.filter(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), lambda letter: letter != "")
    rows = rows.withColumn("before", F.aggregate(earlier, F.lit(0), lambda mask, letter: mask.bitwiseOR(bit(letter))))
    rows = rows.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
    rows = rows.withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    here = lambda c, k: F.element_at(c, F.col(k) + 1)
    removed = here("v", "after") - here("v", "before")
    # n! times the Shapley value: n! P(all) - n! P(all without it).
    whole = (1 << n) - 1
    shapley = F.col("potential")[whole] - n * F.element_at("potential", F.lit(whole) - F.col("own") + 1)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("documents") - here("v", "after")).alias("kept"), removed.alias("removed"), (here("v", "own") - removed).alias("redundant"), here("fails", "own").alias("unique_fails"),
        (here("good", "after") - here("good", "before")).alias("good_lost"), (here("toxic", "after") - here("toxic", "before")).alias("toxic_lost"), shapley.alias("shapley"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own,
    list_transform(range(1, step), lambda k: ascii(filter_order[k]) - 64) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
p AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit,
    list_bool_or(list_concat([false], list_transform(earlier, lambda k: fails[k]))) AS gone,
    len(list_filter(fails, lambda y: y)) AS many FROM c, s),
t AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM p GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""


@query("op12_filter_audit", ORACLE)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(failure_counts(failures(docs), labels), "ABCDE")
