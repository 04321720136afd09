"""Design rows: named terms as column expressions, factors with fixed levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that enter the blood-pressure model where a study has them.
OPTIONAL = ("Wealth_Z_2", "Mom_BMI", "Dad_BMI")


@dataclass(frozen=True)
class Factor:
    """A categorical column with its levels and reference level, the same for all replicates."""

    column: str
    levels: tuple
    reference: object

    def terms(self) -> dict[str, Column]:
        return {
            f"{self.column}[{v}]": F.when(F.col(self.column) == v, 1.0).otherwise(0.0)
            for v in self.levels
            if v != self.reference
        }


def factor(df: DataFrame, column: str, reference=None) -> Factor:
    """Levels found in the data, sorted; the reference defaults to the first."""
    levels = tuple(df.agg(F.sort_array(F.collect_set(column)).alias("levels")).first().levels)
    return Factor(column, levels, (levels[0] if levels else None) if reference is None else reference)


def linear(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("double") for n in names}


def power(name: str, k: int) -> dict[str, Column]:
    out = F.col(name)
    for _ in range(k - 1):
        out = out * F.col(name)
    return {f"{name}^{k}": out.cast("double")}


def interact(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}:{y}": p * q for x, p in a.items() for y, q in b.items()}


def intercept() -> dict[str, Column]:
    return {"Intercept": F.lit(1.0)}


def outcome_terms(pcs: list[str], current_size: bool, father: bool, village: Factor | None = None, columns: list[str] = ()) -> dict[str, Column]:
    """Terms of the blood-pressure model; factors that a fit takes as cells (village, year) are left to it.

    Of the optional covariates those among ``columns`` enter (the father's only with ``father``).
    """
    age = linear("age_x") | power("age_x", 2) | power("age_x", 3) | linear("lognummeas")
    terms = intercept() | linear("Female") | age | interact(linear("Female"), age)
    terms |= linear("temp_cen", "School", "Wealth_Z")
    terms |= interact(linear("Female"), linear("Breast_Stage_Use_Z")) | interact(linear("Male"), linear("log2T_use_Z"))
    terms |= linear("PregMo_Use_cen") | power("PregMo_Use_cen", 2) | linear("lactMo_Use_cen")
    terms |= village.terms() if village else {}
    terms |= linear("Mom_Ht_Ave", "Mom_SBP_Z_Res_USE")
    terms |= linear("Dad_Ht_Ave", "Dad_SBP_Z_Res_USE") if father else {}
    terms |= linear(*[c for c in OPTIONAL if c in columns and (father or not c.startswith("Dad"))])
    scores = linear(*pcs)
    if current_size:
        size = linear("HT_cen", "BMI_cen")
        terms |= size | scores | interact(size, scores)
    else:
        terms |= scores
    return terms


def mediator_terms(mediator: str, sex: str, adj: int, pcs: list[str]) -> dict[str, Column]:
    """Numeric terms of a mediator model at adjustment level 0..3 (village enters as a factor)."""
    terms = intercept() | linear("age_x") | power("age_x", 2) | power("age_x", 3) | linear(*pcs)
    if adj >= 1:
        terms |= linear("Wealth_Z")
        if sex == "female" and mediator == "BMI_cen":
            terms |= linear("PregMo_Use_cen") | power("PregMo_Use_cen", 2) | linear("lactMo_Use_cen")
        if sex == "male":
            terms |= linear("stimulant")
    if adj >= 2:
        terms |= linear("Mom_Ht_Ave")
    if adj >= 3:
        terms |= linear("Dad_Ht_Ave")
    return terms
