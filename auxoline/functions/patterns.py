"""Growth patterns: seven shapes over the age grid, in units of the age SDs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, short label, and z at the first and the last age (linear in between).
PATTERNS = (
    ("Always above mean (Z=1 throughout)", "1→1", 1.0, 1.0),
    ("High catch up (Z goes from 0 to 1)", "0→1", 0.0, 1.0),
    ("High catch down (Z goes from 1 to 0)", "1→0", 1.0, 0.0),
    ("Always at mean (Z=0 throughout)", "0→0", 0.0, 0.0),
    ("Catch up (Z goes from -1 to 0)", "-1→0", -1.0, 0.0),
    ("Catch down (Z goes from 0 to -1)", "0→-1", 0.0, -1.0),
    ("Always below mean (Z=-1 throughout)", "-1→-1", -1.0, -1.0),
)
REFERENCE_PATTERN = 3


def patterns(sd: Column) -> Column:
    """Array of (pat, label, short, values) built on an array of age SDs."""
    steps = F.size(sd) - 1

    def shape(start: float, end: float) -> Column:
        return F.transform(sd, lambda s, i: (F.lit(start) + F.lit(end - start) * i / steps) * s)

    return F.array(
        *[
            F.struct(F.lit(i).alias("pat"), F.lit(label).alias("label"), F.lit(short).alias("short"), shape(a, b).alias("values"))
            for i, (label, short, a, b) in enumerate(PATTERNS)
        ]
    )


def growth_patterns(basis: DataFrame, by: list[str]) -> DataFrame:
    """The patterns of every stratum, with their scores on each loading vector."""
    from auxoline.functions.scalar import matvec
    from auxoline.operators.growth import age_variance

    sd = F.transform(age_variance(), lambda v: F.sqrt(v))
    rows = basis.select(*by, "ages", "loadings", F.inline(patterns(sd)))
    return rows.withColumn("scores", matvec(F.col("loadings"), F.col("values")))
