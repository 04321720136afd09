"""Exact duplicates by a heavy-hitter split.

A Misra-Gries style summary (the frequent-items sketch behind ``approx_top_k``) names the digests that may be frequent.
Their exact counts are then taken; those that hold at least ``share`` of all rows are at most ``1 / share`` digests, so
the table of their winners has a proven size and is broadcast: their rows are decided where they are read. All other
digests have fewer than ``share`` of the rows each and go through an ordinary shuffle.

Rules: null text counts as empty. Of equal texts the row with the largest doc_id stays; null doc_ids come last; of rows that
repeat one doc_id and text exactly one stays, and all of them count in group_size. An empty table gives an empty result. Other
columns are carried by :func:`deduplicate` and ignored by :func:`copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auxoline.llm.frames import fresh
from auxoline.llm.registry import query, table
from auxoline.session import durable

#: Share of all rows from which a digest counts as heavy; 1 / SHARE bounds the broadcast winners.
SHARE = 1 / 1000
#: Digests that the summary returns and tracks; its error is below SHARE with this many.
TOP, TRACKED = 2000, 16384


def text_digest(text: str):
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def heavy_winners(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """digest, keep_id, keep_row, group_size of every digest with at least ``share`` of ``rows`` (digest, doc_id, row)."""
    summary = rows.select(F.xxhash64("digest").alias("h")).selectExpr("count(*) n", f"approx_top_k(h, {TOP}, {TRACKED}) items").first()
    least = max(2, int(summary.n * share))
    frequent = [i["item"] for i in summary["items"] or [] if i["count"] >= least]
    found = rows.filter(F.xxhash64("digest").isin(frequent)) if frequent else rows.limit(0)
    winners = found.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    return winners.filter(F.col("group_size") >= least).select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = durable(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(text_digest(text)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    heavy = durable(heavy_winners(rows, share))
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    decided = marked.filter("group_size is not null")
    same = Window.partitionBy("digest")
    top = F.max(F.struct("doc_id", "row")).over(same)
    rest = (
        rows.join(F.broadcast(heavy), "digest", "left_anti")
        .select("doc_id", "digest", "row", top.alias("top"), F.count("*").over(same).alias("group_size"))
        .select("digest", "doc_id", "row", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")
    )
    return decided.unionByName(rest).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The documents that stay, with all their columns. Texts of heavy groups never leave their task but for the winner's."""
    digest, rank, heavy_id = fresh(docs, "digest", "rank", "keep_id")
    hashed = docs.withColumn(digest, F.unhex(text_digest(text)))
    keys = durable(hashed.select(F.col(doc_id).alias("doc_id"), F.col(digest).alias("digest"), F.lit(0).alias("row")))
    winners = durable(heavy_winners(keys, share)).select(F.col("digest").alias(digest), F.struct("keep_id").alias(heavy_id))
    ours = hashed.join(F.broadcast(winners), digest, "left").filter(F.col(heavy_id).isNull() | F.col(doc_id).eqNullSafe(F.col(f"{heavy_id}.keep_id")))
    best = Window.partitionBy(digest).orderBy(F.col(doc_id).desc_nulls_last())
    return ours.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) == 1).select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op3_exact_dedup", ORACLE)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))
