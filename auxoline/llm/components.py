"""Connected components by alternating large and small stars over edges that tasks contract first.

No node's neighbours are gathered. Only once no more than WHOLE edges are left, a bound that does not grow with the input, one task contracts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auxoline.session import durable

#: A node with at least this share of all rows of a round, and this many, is a hub; 1 / HUB_SHARE bounds the table of hubs that is broadcast.
HUB_SHARE, HUB_LEAST = 1 / 1000, 1000
#: Edges that a task contracts at a time, and so many that one task may finish (16 bytes each).
CHUNK = WHOLE = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component in these edges, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        # The roots of both ends learn of the smaller one, then paths are halved.
        np.minimum.at(now, label[x], least)
        np.minimum.at(now, label[y], least)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components, fewer: every task replaces its own by stars."""

    def run(batches):
        held, n = [], 0

        def star():
            a, b = local_roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += len(batch)
            if n >= CHUNK:
                yield star()
                held, n = [], 0
        if n:
            yield star()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _beside_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows`` with the value that ``least`` (a, m, n) has for ``a``; rows of hubs stay where they are."""
    limit = max(HUB_LEAST, int(total * HUB_SHARE))
    hubs = F.broadcast(least.filter(F.col("n") >= limit).select("a", "m"))
    rest = least.filter(F.col("n") < limit).select("a", "m")
    return rows.join(hubs, "a").unionByName(rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(rest, "a"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) of every node of ``edges`` (a, b) but the roots.

    Every round replaces each node's neighbours by links to the smallest of them; only minima by node are aggregated and
    joined back, those of hubs by broadcast. Rounds are written to the shared folder. Ends when a round changes nothing.
    """
    # Edges are a few bytes a node: an eighth of the partitions that shuffles of whole rows need is enough for them.
    parts = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    given = edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).filter("a > b")
    now = durable(contracted(given.coalesce(parts)).distinct().coalesce(parts))
    mark = _mark(now)
    if mark[0] <= WHOLE:
        now = durable(contracted(now.coalesce(1)))
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")))
        large = _beside_least(both.filter("b > a"), least, 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(contracted(small.unionByName(least.select("a", F.col("m").alias("b")))).distinct().coalesce(parts))
        then, mark = mark, _mark(now)
        if mark == then:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``roots`` (node, root) after more ``links`` (a, b): only edges between components are gone through."""

    def root(column: str) -> DataFrame:
        return roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))

    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    between = components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b"))
    up = roots.join(between.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return durable(up.select("node", F.coalesce("top", "root").alias("root")).unionByName(between))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
