"""Grids of model specifications over shared sums: which rows each one keeps, and all its fits in one pass.

A row's nulls are a bitmap over the covariates that may be missing. A specification needs some of them, so it keeps the rows whose
bitmap and need share no bit: counts are additive, are taken once per bitmap, and every specification adds up
those of the bitmaps it keeps. For fits a bit stands for a different set of needs, so bitmaps are few whatever the columns' null patterns. However many specifications there are, the visits are read once.

A model's terms are visit columns, or visit columns times a score of the subject (early growth). Scores differ by variable, stratum and
imputation but not by visit, so a visit is shuffled once as its columns, and all keys together are one matrix product of the
subjects' scores with the products of a block of visits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.operators.linear import FIT_FIELDS, least_squares

#: The constant visit column.
ONE = "1"
#: Specifications that one 64-bit mask of a row holds.
WORD = 62


def null_bitmap(columns: list[str]) -> Column:
    """Bit k is set if the k-th column is null."""
    if len(columns) > WORD:
        raise ValueError(f"{len(columns)} columns that may be null; a bitmap holds {WORD}")
    total = F.lit(0).cast("bigint")
    for k, c in enumerate(columns):
        total = total + F.when(F.col(c).isNull(), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return total


def need_mask(columns: list[str], needs) -> int:
    return sum(1 << columns.index(c) for c in set(needs))


def lattice(df: DataFrame, sets: dict[tuple, list[str]], names: list[str], subject: str = "ID", by: list[str] = ()) -> DataFrame:
    """(by..., names..., n_columns, n_complete, n_subjects) of every column set: rows and subjects that are complete in it.

    Rows are counted once per (subject, bitmap). A subject has a set if any of its bitmaps allows it: those are or-ed as bits, and
    subjects of equal bits are counted together. ``sets``: column names by the values of ``names``.
    """
    columns = sorted({c for s in sets.values() for c in s})
    masks = [need_mask(columns, s) for s in sets.values()]
    words = [masks[k : k + WORD] for k in range(0, len(masks), WORD)]
    seen = df.groupBy(*by, subject, null_bitmap(columns).alias("bitmap")).agg(F.count("*").alias("n"))

    def allowed(word: list[int]) -> Column:
        total = F.lit(0).cast("bigint")
        for k, mask in enumerate(word):
            total = total + F.when(F.col("bitmap").bitwiseAND(F.lit(mask).cast("bigint")) == 0, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return total

    marked = seen.select(*by, subject, "n", *[allowed(w).alias(f"w{i}") for i, w in enumerate(words)])
    bits = [f"w{i}" for i in range(len(words))]
    # A few different masks: the rows of each, and the subjects of each union.
    rows = marked.groupBy(*by, *bits).agg(F.sum("n").alias("rows"), F.lit(0).cast("bigint").alias("subjects"))
    unions = marked.groupBy(*by, subject).agg(*[F.bit_or(b).alias(b) for b in bits]).groupBy(*by, *bits).agg(F.lit(0).cast("bigint").alias("rows"), F.count("*").alias("subjects"))
    cells = F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(names, key, strict=True)], F.lit(len(sets[key])).alias("n_columns"), F.lit(i // WORD).alias("word"), F.lit(1 << i % WORD).cast("bigint").alias("bit"))
        for i, key in enumerate(sets)
    ])
    every = rows.unionByName(unions).select(*by, "rows", "subjects", F.array(*bits).alias("words"), F.inline(cells))
    has = F.col("words")[F.col("word")].bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.sum(F.when(has, F.col(c)).otherwise(F.lit(0).cast("bigint")))
    return every.groupBy(*by, *names, "n_columns").agg(count("rows").alias("n_complete"), count("subjects").alias("n_subjects"))


@dataclass(frozen=True)
class Spec:
    """One model: its values on the axes of the grid, the outcome and terms, and the columns its rows must have.

    ``terms``: name -> (visit column, number of the score it is multiplied with, or None). ``where``: values of the sums' stratum columns
    that the model is for (all if empty).
    """

    axes: tuple
    outcome: str
    terms: dict[str, tuple[str, int | None]]
    needs: tuple[str, ...] = ()
    where: dict = field(default_factory=dict)

    def needed(self) -> set[str]:
        return {c for c, _ in self.terms.values() if c != ONE} | {self.outcome} | set(self.needs)


def score_terms(columns: list[str], scores: int, with_scores: list[str] = ()) -> dict[str, tuple[str, int | None]]:
    """Intercept, columns, scores, and products of ``with_scores`` with every score."""
    out = {"Intercept": (ONE, None)} | {c: (c, None) for c in columns} | {f"pc{k}": (ONE, k) for k in range(scores)}
    return out | {f"{c}:pc{k}": (c, k) for c in with_scores for k in range(scores)}


def visit_columns(specs: list[Spec]) -> list[str]:
    return [ONE, *sorted({c for s in specs for c in s.needed()})]


def unmet(specs: list[Spec]) -> tuple[Column, list[int], int | None]:
    """A row's bitmap, the mask of every specification (it keeps the rows that share no bit with it), and the bitmap of rows that none keeps.

    Bit k is set if the row lacks something that the k-th different set of needs asks for: the bitmaps are as many as the sets allow, not as
    the null patterns of all columns. Only if there are more sets than a word has bits, a bit stands for a column.
    """
    needs = list(dict.fromkeys(frozenset(s.needed()) for s in specs))
    columns = visit_columns(specs)[1:]
    if len(needs) > WORD:
        return null_bitmap(columns), [need_mask(columns, s.needed()) for s in specs], None
    total = F.lit(0).cast("bigint")
    for k, need in enumerate(needs):
        lacks = F.greatest(*[F.col(c).isNull() for c in sorted(need)], F.lit(False))
        total = total + F.when(lacks, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return total, [1 << needs.index(frozenset(s.needed())) for s in specs], (1 << len(needs)) - 1


def visit_rows(visits: DataFrame, specs: list[Spec], strata: list[str], subject: str = "ID") -> DataFrame:
    """(subject, strata..., bitmap, x): the visit columns as one array, null counting as 0 under its bitmap; visits that no specification keeps drop out."""
    columns = visit_columns(specs)
    bitmap, _, none = unmet(specs)
    values = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns[1:]])
    rows = visits.select(F.col(subject).alias("ID"), *strata, bitmap.alias("bitmap"), values.alias("x"))
    return rows if none is None else rows.where(F.col("bitmap") != none)


def packed_scores(scores: DataFrame, keys: list[str], ndim: int) -> tuple[DataFrame, list[tuple]]:
    """Scores of all keys of a subject as arrays beside each other, (ID, at, s), and the keys that ``at`` numbers.

    Keys are variables, strata and imputations: a bounded number, whatever the number of subjects.
    """
    known = sorted(tuple(r) for r in scores.select(*keys).distinct().collect())
    types = dict(scores.dtypes)
    literal = lambda k: F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(keys, k, strict=True)])
    place = F.try_element_at(F.create_map(*[c for i, k in enumerate(known) for c in (literal(k), F.lit(i))]), F.struct(*keys)) if known else F.lit(0)
    entry = F.struct(place.alias("at"), F.array(*[F.col(f"pc{k}") for k in range(ndim)]).alias("s"))
    packed = scores.groupBy("ID").agg(F.collect_list(entry).alias("e"))
    return packed.select("ID", F.col("e.at").alias("at"), F.flatten("e.s").alias("s")), known


def monomials(ndim: int) -> list[tuple[int, ...]]:
    """Scores that a product of two terms may carry: none, one, or two."""
    return [(), *[(k,) for k in range(ndim)], *[(j, k) for j in range(ndim) for k in range(j, ndim)]]


def product_cells(p: int) -> np.ndarray:
    """Where the product of two visit columns lies in the upper triangle by rows."""
    cell = np.zeros((p, p), int)
    cell[np.triu_indices(p)] = np.arange(p * (p + 1) // 2)
    return np.maximum(cell, cell.T)


def places(spec: Spec, columns: list[str], ndim: int) -> np.ndarray:
    """Where the products of a specification's terms and outcome lie among all monomials times all products of columns."""
    cell, width = product_cells(len(columns)), len(columns) * (len(columns) + 1) // 2
    slot = {power: k for k, power in enumerate(monomials(ndim))}
    at = [(columns.index(c), () if k is None else (k,)) for c, k in [*spec.terms.values(), (spec.outcome, None)]]
    return np.array([[slot[tuple(sorted(a + b))] * width + cell[i, j] for j, b in at] for i, a in at])


def wanted_places(specs: list[Spec], ndim: int) -> np.ndarray:
    """All places that some specification reads, in order, the count first."""
    columns = visit_columns(specs)
    return np.unique(np.concatenate([[0], *[places(s, columns, ndim).ravel() for s in specs]]))


def key_sums(rows: DataFrame, scores: DataFrame, keys: list[str], strata: list[str], ndim: int, p: int, wanted: np.ndarray) -> DataFrame:
    """(keys..., strata..., bitmap, v): for every key the products of visit columns times monomials of the subject's scores, added up at the ``wanted`` places.

    ``rows`` comes from :func:`visit_rows`. Products are formed a block of visits at a time where visits and scores meet, so what is shuffled is a
    visit's p columns; a task keeps one sum per key and bitmap.
    """
    packed, known = packed_scores(scores, keys, ndim)
    types, key_types = dict(rows.dtypes), dict(scores.dtypes)
    first, second = np.triu_indices(p)
    width = len(first)
    parts_of = [(power, np.flatnonzero(wanted // width == j)) for j, power in enumerate(monomials(ndim))]
    parts_of = [(power, to, wanted[to] % width) for power, to in parts_of if len(to)]
    joined = rows.join(packed, "ID").select(*strata, "bitmap", "x", "at", "s")

    def weigh(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                n = len(part)
                cells = list(zip(*[part.column(k).to_pylist() for k in range(len(strata) + 1)], strict=True))
                names = {c: i for i, c in enumerate(dict.fromkeys(cells))}
                of = np.array([names[c] for c in cells], dtype=int)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
                at = part.column("at")
                who = np.repeat(np.arange(n), np.diff(at.offsets.to_numpy()))
                key = at.flatten().to_numpy(zero_copy_only=False)
                s = part.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, ndim)
                for power, to, cols in parts_of:
                    w = np.zeros((len(known), n))
                    np.add.at(w, (key, who), np.prod(s[:, list(power)], axis=1) if power else 1.0)
                    m = x[:, first[cols]] * x[:, second[cols]]
                    for cell, i in names.items():
                        mine = of == i
                        total.setdefault(cell, np.zeros((len(known), len(wanted))))[:, to] += w[:, mine] @ m[mine]
        for cell, v in total.items():
            used = np.flatnonzero(v[:, 0] > 0)
            if len(used):
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"at": used.astype(np.int32), **dict(zip([*strata, "bitmap"], cell, strict=True)), "v": list(v[used])}), preserve_index=False
                )

    head = ", ".join(f"{c} {types[c]}" for c in (*strata, "bitmap"))
    parts = joined.mapInArrow(weigh, f"at int, {head}, v array<double>")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"].to_numpy()), axis=0)])

    added = parts.groupBy("at", *strata, "bitmap").applyInPandas(add, f"at int, {head}, v array<double>")
    named = F.array(*[F.struct(*[F.lit(v).cast(key_types[c]).alias(c) for c, v in zip(keys, k, strict=True)]) for k in known]) if known else None
    if named is None:
        return added.limit(0).select(*[F.lit(None).cast(key_types[k]).alias(k) for k in keys], *strata, "bitmap", "v")
    return added.select(named[F.col("at")].alias("k"), *strata, "bitmap", "v").select("k.*", *strata, "bitmap", "v")


def solve_specs(
    sums: DataFrame, keys: list[str], strata: list[str], axes: list[str], specs: list[Spec], ndim: int, estimator: Callable[..., dict] = least_squares
) -> DataFrame:
    """One row per key and specification with rows: (keys..., strata..., axes..., fit fields), all solved in one grouped pass.

    ``estimator`` gets term names, X'X, X'y, y'y and n. Axes are strings or whole numbers.
    """
    columns, wanted = visit_columns(specs), wanted_places(specs, ndim)
    plans = [(s, mask, np.searchsorted(wanted, places(s, columns, ndim))) for s, mask in zip(specs, unmet(specs)[1], strict=True)]
    types = dict(sums.dtypes)
    axis_types = ["int" if isinstance(v, int) else "string" for v in specs[0].axes]
    schema = ", ".join([f"{k} {types[k]}" for k in (*keys, *strata)] + [f"{a} {t}" for a, t in zip(axes, axis_types, strict=True)] + [FIT_FIELDS])

    def solve(key, pdf):
        given, out = dict(zip([*keys, *strata], key)), []
        bitmaps, v = pdf["bitmap"].to_numpy(), np.stack(pdf["v"].to_numpy())
        for s, mask, at in plans:
            if any(given[k] != w for k, w in s.where.items()):
                continue
            z = v[(bitmaps & mask) == 0].sum(0)[at]
            n = int(round(z[0, 0]))
            if not n:
                continue
            r = estimator(list(s.terms), z[:-1, :-1], z[:-1, -1], z[-1, -1], n)
            row = given | dict(zip(axes, s.axes)) | {k: r[k] for k in ("terms", "scale", "n", "llf")}
            out.append(row | {"est": [float(e) for e in r["est"]], "cov": [[float(c) for c in line] for line in r["cov"]]})
        names = [c.split()[0] for c in schema.replace("array<array<double>>", "a").split(", ")]
        return pd.DataFrame(out, columns=names)

    return sums.groupBy(*keys, *strata).applyInPandas(solve, schema)


def fit_specs(visits: DataFrame, scores: DataFrame, keys: list[str], strata: list[str], axes: list[str], specs: list[Spec], ndim: int, estimator: Callable[..., dict] = least_squares) -> DataFrame:
    """All models of the grid for every key of ``scores`` (keys..., ID, pc0, ...): four steps, whatever the number of specifications."""
    sums = key_sums(visit_rows(visits, specs, strata), scores, keys, strata, ndim, len(visit_columns(specs)), wanted_places(specs, ndim))
    return solve_specs(sums, keys, strata, axes, specs, ndim, estimator)
