"""Small frame helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auxoline.session import checkpoint_dir


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the written table.

    Cuts lineage like a checkpoint, but compressed, with column pruning, and with a known size for the optimiser.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ids(docs: DataFrame, doc_id: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its rows without repeats, and that column's name.

    It is the id itself if ids are whole numbers without repeats and nulls; else rows are numbered and written, so that the numbers hold.
    """
    (name,) = fresh(docs, "row_id")
    if docs.schema[doc_id].dataType.typeName() in ("integer", "long", "short", "byte"):
        repeats = docs.groupBy(F.col(doc_id)).agg(F.count("*").alias("n")).filter(F.col("n") > 1).unionByName(docs.filter(F.col(doc_id).isNull()).select(F.col(doc_id), F.lit(1).cast("bigint").alias("n")))
        if not repeats.limit(1).count():
            return docs.withColumn(name, F.col(doc_id).cast("bigint")), name
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name
