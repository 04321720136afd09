"""Imputed data sets that are drawn once: a manifest names what is finished and from which parameters it was drawn.

Draws are keyed by imputation, so any of them can be drawn without the others. A run asks the manifest which imputations of a variable exist
for its parameters and draws the rest into a folder of its own; only when that is written does one more manifest file name it. A folder that no manifest
names, left by a lost run, is never read; neither are imputations whose parameters have changed since.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "var string, imp long, token string, folder string, n long, at timestamp"


def token_of(*parts) -> str:
    """Name of a set of parameters: equal for equal values, arrays and nested containers included."""

    def flat(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(sorted(f"{flat(k)}:{flat(v)}" for k, v in x.items())) + "}"
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(flat, x)) + "]"
        if hasattr(x, "__dataclass_fields__"):
            return flat({k: getattr(x, k) for k in x.__dataclass_fields__})
        return repr(x)

    return hashlib.sha256(flat(parts).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest finished entry of every (var, imp); empty where nothing was ever finished."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        rows.limit(1).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    best = F.max_by(F.struct("token", "folder", "n", "at"), F.struct("at", "folder"))
    return rows.groupBy("var", "imp").agg(best.alias("b")).select("var", "imp", "b.*")


def missing(spark: SparkSession, path: str, var: str, n_imp: int, token: str) -> list[int]:
    """Imputations of a variable that are not finished for these parameters."""
    known = {r.imp for r in manifest(spark, path).where((F.col("var") == var) & (F.col("token") == token)).select("imp").collect()}  # at most n_imp rows
    return [i for i in range(n_imp) if i not in known]


def draw_into(spark: SparkSession, path: str, var: str, n_imp: int, token: str, draw: Callable[[list[int]], DataFrame]) -> list[int]:
    """Draw what is missing (``draw`` gets the imputations asked for, its rows have ``imp``); returns what was drawn.

    The manifest is written last and as one file, which appears whole or not at all.
    """
    wanted = missing(spark, path, var, n_imp, token)
    if not wanted:
        return []
    folder = f"{path}/data/{var}-{uuid.uuid4().hex}"
    draw(wanted).where(F.col("imp").isin(wanted)).hint("rebalance", "imp").write.partitionBy("imp").parquet(folder)
    counts = spark.read.parquet(folder).groupBy(F.col("imp").cast("bigint").alias("imp")).agg(F.count("*").alias("n"))
    imps = F.explode(F.array(*[F.lit(i).cast("bigint") for i in wanted])).alias("imp")
    named = spark.range(1).select(imps).join(counts, "imp", "left").fillna(0, ["n"])
    rows = named.select(F.lit(var).alias("var"), "imp", F.lit(token).alias("token"), F.lit(folder).alias("folder"), "n", F.current_timestamp().alias("at"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return wanted


def read_drawn(spark: SparkSession, path: str, var: str, token: str | None = None) -> DataFrame:
    """The finished imputations of a variable, of certain parameters if ``token`` is given; other folders are not opened."""
    rows = manifest(spark, path).where(F.col("var") == var)
    if token is not None:
        rows = rows.where(F.col("token") == token)
    folders: dict[str, list[int]] = {}
    for r in rows.where("n > 0").select("folder", "imp").collect():  # one row per imputation
        folders.setdefault(r.folder, []).append(r.imp)
    if not folders:
        raise ValueError(f"{path} holds no finished imputation of {var}" + (f" for {token}" if token else ""))
    out = None
    for folder, imps in sorted(folders.items()):
        part = spark.read.parquet(folder).withColumn("imp", F.col("imp").cast("bigint")).where(F.col("imp").isin(imps))
        out = part if out is None else out.unionByName(part)
    return out
