"""Per-subject visit rules: ends, baseline values, nearest-in-time fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pick_visit(df: DataFrame, last: bool = False, order: tuple[str, ...] = ("datecomb", "visit_id")) -> DataFrame:
    """The first (or last) row of each subject.

    An aggregation with map-side combine: a subject with very many visits is
    reduced on every task before the shuffle, where a window would sort it in one.
    """
    rest = [c for c in df.columns if c != "ID"]
    pick = F.max_by if last else F.min_by
    picked = df.groupBy("ID").agg(pick(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select("ID", "r.*").select(df.columns)


def baseline_carry(df: DataFrame, columns: list[str], order: tuple[str, ...] = ("datecomb", "visit_id")) -> DataFrame:
    """Replace each column by the subject's first non-missing value."""
    key = F.struct(*order)
    base = df.groupBy("ID").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_{c}") for c in columns]
    )
    joined = df.join(base, "ID")
    return joined.withColumns({c: F.col(f"_{c}") for c in columns}).select(df.columns)


def nearest_fill(df: DataFrame, value: str, limit_days: int = 90) -> DataFrame:
    """Fill a missing value with the subject's nearest observed one, strictly closer than the limit.

    Either direction; the earlier date wins ties, and on one date the first visit
    wins. Fills never feed other fills. Adds ``<value>_filled`` and ``gap_days``.

    Visits are first reduced to one row per (subject, date), and each subject's dates are
    cut into blocks as wide as the limit: whatever is close enough lies in the same
    block or a neighbouring one. No sort ever holds more than one block of dates.
    """
    if limit_days < 1:
        raise ValueError("limit_days must be at least 1")
    day = F.unix_date("datecomb")
    seen = F.col(value).isNotNull()
    dates = df.groupBy("ID", "datecomb").agg(
        F.min_by(value, F.when(seen, F.col("visit_id"))).alias("v"),
        F.max(~seen).alias("wanted"),
    )
    dates = dates.where("datecomb IS NOT NULL").withColumns(
        {"day": day, "block": F.floor(day / F.lit(float(limit_days)))}
    )
    point = F.when(F.col("v").isNotNull(), F.struct("day", "v"))
    per_block = dates.where("v IS NOT NULL").groupBy("ID", "block").agg(
        F.min_by(F.struct("day", "v"), "day").alias("head"), F.max_by(F.struct("day", "v"), "day").alias("tail")
    )
    in_order = Window.partitionBy("ID", "block").orderBy("day")
    inside = dates.select(
        "ID",
        "datecomb",
        "day",
        "block",
        "wanted",
        F.last(point, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.first(point, ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    ).where("wanted")
    earlier = per_block.select("ID", (F.col("block") + 1).alias("block"), "tail")
    later = per_block.select("ID", (F.col("block") - 1).alias("block"), "head")
    near = (
        inside.join(earlier, ["ID", "block"], "left")
        .join(later, ["ID", "block"], "left")
        .withColumns({"before": F.coalesce("before", "tail"), "after": F.coalesce("after", "head")})
        .withColumns({"back": F.col("day") - F.col("before.day"), "ahead": F.col("after.day") - F.col("day")})
    )
    use_before = F.col("back").isNotNull() & (F.col("ahead").isNull() | (F.col("back") <= F.col("ahead")))
    near = near.select(
        "ID",
        "datecomb",
        F.when(use_before, F.col("before.v")).otherwise(F.col("after.v")).alias("near_v"),
        F.when(use_before, F.col("back")).otherwise(F.col("ahead")).alias("near_gap"),
    ).where(F.col("near_gap") < limit_days)
    joined = df.join(near, ["ID", "datecomb"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.coalesce(F.col(value), F.col("near_v")).alias(f"{value}_filled"),
        F.when(~seen, F.col("near_gap")).alias("gap_days"),
    )


def first_subjects(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """The ``n`` smallest subject ids of each stratum."""
    w = Window.partitionBy(stratum).orderBy("ID")
    ids = df.select(stratum, "ID").distinct()
    return ids.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).drop("pos")
