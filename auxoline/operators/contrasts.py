"""Questions asked of fitted models: pattern contrasts, coefficient trajectories, effect curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.functions.normal import Z_975, two_sided_p
from auxoline.functions.patterns import REFERENCE_PATTERN
from auxoline.functions.scalar import dot, quad

# Order of the exposure terms of a one-component model.
EXPOSURE_TERMS = ("HT_cen", "BMI_cen", "pc0", "HT_cen:pc0", "BMI_cen:pc0")

# Adult size, unit, and the shift in units, female SDs and male SDs.
ADULT_SIZES = {
    "Ht": {"unit": "cm", "none": 5.0, "zf": 5.5, "zm": 7.1},
    "BMI": {"unit": "kg/m^2", "none": 3.0, "zf": 2.5, "zm": 1.8},
}
SHIFT_LABELS = {"zf": "1SD(F)", "zm": "1SD(M)"}


def shift_label(size: str, scale: str) -> str:
    step = ADULT_SIZES[size]
    return SHIFT_LABELS.get(scale) or f"{step[scale]:g}{step['unit']}"


def _vector(size: str, hx: Column, s: Column, s_ref: Column) -> Column:
    zero = F.lit(0.0)
    if size == "Ht":
        return F.array(hx, zero, s - s_ref, hx * s, zero)
    return F.array(zero, hx, s - s_ref, zero, hx * s)


def pattern_contrasts(fits: DataFrame, by: list[str], scale: str = "none", reference: int = REFERENCE_PATTERN) -> DataFrame:
    """Every adult size x shift x pattern against the reference pattern at shift zero.

    ``fits`` holds one row per model with ``est`` and ``cov`` in the order of EXPOSURE_TERMS and
    ``pats``, an array of (pat, label, short, scores) with one score each. Shifts and patterns
    are unpacked from arrays in the row, so nothing is joined.
    """
    if scale not in ("none", "zf", "zm"):
        raise ValueError(f"unknown scale {scale}")
    cells = []
    for size, step in ADULT_SIZES.items():
        text = shift_label(size, scale)
        for sign, mark in ((-1.0, f"{size}:-{text}"), (0.0, f"{size}:0"), (1.0, f"{size}:+{text}")):
            cells.append(
                F.struct(F.lit(size).alias("size"), F.lit(sign * step[scale]).alias("shift"), F.lit(mark).alias("mark"))
            )
    one_component = F.assert_true(F.forall("pats", lambda p: F.size(p["scores"]) == 1), "contrasts need one component")
    ref = F.element_at(F.filter("pats", lambda p: p["pat"] == reference), 1)["scores"][0]
    rows = (
        fits.where(one_component.isNull())
        .withColumn("s_ref", ref)
        .select(*by, "est", "cov", "s_ref", "pats", F.inline(F.array(*cells)))
        .select(*by, "est", "cov", "s_ref", "size", "shift", "mark", F.inline("pats"))
    )
    s = F.col("scores")[0]
    u = F.when(F.col("size") == "Ht", _vector("Ht", F.col("shift"), s, F.col("s_ref"))).otherwise(
        _vector("BMI", F.col("shift"), s, F.col("s_ref"))
    )
    out = rows.withColumn("u", u).select(
        *by, "size", "shift", "mark", "pat", "label", "short",
        dot("u", "est").alias("est"), F.sqrt(quad(F.col("u"), F.col("cov"))).alias("se"),
    )
    out = out.withColumn("z", F.try_divide("est", "se"))
    return out.withColumn("p", two_sided_p(F.col("z")))


def with_interval(df: DataFrame, width: float = Z_975) -> DataFrame:
    half = width * F.col("se")
    return df.withColumns({"lower": F.col("est") - half, "upper": F.col("est") + half})


def coefficient_trajectory(fits: DataFrame, by: list[str], ndim: int) -> DataFrame:
    """Effect of the growth variable at each age, with a band of two standard errors.

    ``fits`` holds ``est`` and ``cov`` of the score terms, ``loadings`` (ndim x ages) and ``ages``.
    """
    if ndim not in (1, 2):
        raise ValueError("one or two components")
    weights = F.transform("ages", lambda a, i: F.array(*[F.col("loadings")[k][i] for k in range(ndim)]))
    rows = fits.withColumn("w", weights).select(*by, "est", "cov", F.inline(F.arrays_zip("ages", "w")))
    out = rows.select(*by, F.col("ages").alias("age"), dot("w", "est").alias("est"), F.sqrt(quad(F.col("w"), F.col("cov"))).alias("se"))
    return with_interval(out, 2.0)


def quadratic_form(df: DataFrame, columns: list[str], matrix: DataFrame) -> Column:
    """u' M u of each row, where u is spread over columns; one scalar subquery holds the matrix."""
    m = F.col("_m")
    total = F.lit(0.0)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            total = total + F.col(a) * F.col(b) * m[i][j]
    return df.withColumn("_m", matrix.scalar()).withColumn("q", total).drop("_m")


# Evaluation grids of the effect curves (first, last, points).
GRIDS = {
    "age": (10.0, 20.0, 20),
    "nummeas": (1.0, 9.0, 9),
    "pregmo": (0.0, 8.0, 9),
    "lactmo": (0.0, 23.0, 24),
    "bmi": (12.0, 24.0, 13),
    "height": (120.0, 182.0, 63),
}


def effect_curves(models: DataFrame, by: list[str], current_size: bool = True) -> DataFrame:
    """Fitted effect curves (by..., curve, sex, x, y), each centred to mean zero.

    ``models`` holds one row per model: map ``b`` from term to coefficient and map ``c`` from
    variable to centring constant. Age and number of measures are centred jointly over the sexes.
    """

    def b(term: str) -> Column:
        return F.col("b")[term]

    def cubic(v: Column, prefix: str = "") -> Column:
        return b(f"{prefix}age_x") * v + b(f"{prefix}age_x^2") * v * v + b(f"{prefix}age_x^3") * v * v * v

    x = F.col("x")
    t, lg = (x - 10) / 10.0, F.log10(x)
    preg, lact = x - F.col("c")["PregMo"], x - F.col("c")["lactMo"]
    male_age, male_lg = cubic(t), b("lognummeas") * lg
    curves = [
        ("age", "male", male_age),
        ("age", "female", male_age + cubic(t, "Female:") + b("Female")),
        ("nummeas", "male", male_lg),
        ("nummeas", "female", male_lg + b("Female:lognummeas") * lg),
        ("pregmo", "female", b("PregMo_Use_cen") * preg + b("PregMo_Use_cen^2") * preg * preg),
        ("lactmo", "female", b("lactMo_Use_cen") * lact),
    ]
    if current_size:
        curves += [
            ("bmi", "both", b("BMI_cen") * (x - F.col("c")["BMI"])),
            ("height", "both", b("HT_cen") * (x - F.col("c")["HT"])),
        ]
    grids = [
        F.struct(
            F.lit(curve).alias("curve"),
            F.lit(sex).alias("sex"),
            F.expr(f"transform(sequence(0, {GRIDS[curve][2] - 1}), i -> {GRIDS[curve][0]}D + i * "
                   f"{(GRIDS[curve][1] - GRIDS[curve][0])}D / {GRIDS[curve][2] - 1}.0D)").alias("xs"),
        )
        for curve, sex, _ in curves
    ]
    rows = models.select(*by, "b", "c", F.inline(F.array(*grids)))
    rows = rows.select(*by, "b", "c", "curve", "sex", F.explode("xs").alias("x"))
    value = F.lit(None).cast("double")
    for curve, sex, expr in reversed(curves):
        value = F.when((F.col("curve") == curve) & (F.col("sex") == sex), expr).otherwise(value)
    raw = rows.select(*by, "curve", "sex", "x", value.alias("y"))
    level = raw.groupBy(*by, "curve").agg(F.avg("y").alias("level"))
    return raw.join(level, [*by, "curve"]).select(*by, "curve", "sex", "x", (F.col("y") - F.col("level")).alias("y"))
