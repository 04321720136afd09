"""Linear mixed models by maximum likelihood, for every replicate at once.

Model per mother: random intercept of the mother, intercept of each subject, and a
subject-by-age component. The visits are reduced once to per-subject sums, which are placed
by range of (replicate, mother, subject) and stay there; each optimiser step then streams over them
without a shuffle of subjects or mothers.

With U_i = [1, age] of subject i and D_i the variances of its own effects, the
subject's effects are integrated out in closed form (2 x 2 algebra), the results are
summed per mother, and the mother's effects are integrated out the same way. A mother whose subjects lie in
several partitions, be it one that holds a large share of the rows, leaves one partial sum in each of them.

A subject without a known mother is the only one of a mother of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auxoline.operators.design import Factor
from auxoline.operators.linear import FIT_FIELDS, assemble, cross_products
from auxoline.session import durable

FLOOR, CEILING = -14.0, 8.0
STENCIL = 0.05


def subject_stats(df: DataFrame, by: list[str], terms: dict[str, Column], y: Column) -> DataFrame:
    """Per (key, mother, subject): n, sums of age and age^2, and of each design column and the
    outcome (``u``) and of their products with age (``w``)."""
    z = [*terms.values(), y]
    mom = F.coalesce(F.col("mom"), -1 - F.col("ID")).alias("mom")
    x = df.select(*by, mom, "ID", F.col("age_cen").alias("t"), *[c.cast("double").alias(f"z{i}") for i, c in enumerate(z)])
    q = len(z)
    return x.groupBy(*by, "mom", "ID").agg(
        F.count("*").alias("n"),
        F.sum("t").alias("a"),
        F.sum(F.col("t") * F.col("t")).alias("aa"),
        F.array(*[F.sum(f"z{i}") for i in range(q)]).alias("u"),
        F.array(*[F.sum(F.col("t") * F.col(f"z{i}")) for i in range(q)]).alias("w"),
    )


def totals(df: DataFrame, by: list[str], terms: dict[str, Column], y: Column, factors: list[Factor] = ()) -> dict[tuple, np.ndarray]:
    """Z'Z of each key (design columns and outcome), from cross-products in which factors are cells."""
    cells = cross_products(df, by, terms, y, list(factors)).toPandas()  # one row per key and factor cell
    out = {}
    for key, part in _key_groups(cells, by):
        _, xx, xy, yy, _ = assemble(part, list(terms), list(factors))
        out[key] = np.block([[xx, xy[:, None]], [xy[None, :], np.array([[yy]])]])
    return out


def _two_by_two(p00, p01, p11, d0, d1):
    """log det(I + P D) and its inverse (by entries) for stacks of symmetric P and diagonal D."""
    det = (1 + p00 * d0) * (1 + p11 * d1) - p01 * p01 * d0 * d1
    return np.log(det), ((1 + p11 * d1) / det, -p01 * d1 / det, -p01 * d0 / det, (1 + p00 * d0) / det)


def _key_groups(pdf: pd.DataFrame, by: list[str]):
    for key, part in pdf.groupby(by, sort=False):
        yield key if isinstance(key, tuple) else (key,), part


def _applied(t, v0, v1):
    """T V of a stack, from the entries of T and the two rows of V."""
    t00, t01, t10, t11 = (e[:, None] for e in t)
    return t00 * v0 + t01 * v1, t10 * v0 + t11 * v1


def _removed(v0, v1, d0, d1, tv0, tv1):
    """sum over the stack of V' D T V, upper triangle by rows."""
    c = v0.T @ (np.reshape(d0, (-1, 1)) * tv0) + v1.T @ (np.reshape(d1, (-1, 1)) * tv1)
    return c[np.triu_indices(c.shape[0])]


def _mothers(m, theta, treatment: bool, q: int):
    """log determinant and removed products of whole mothers, from their sums (rows)."""
    d0, d1 = np.exp(theta[0]), np.exp(theta[2]) if treatment else 0.0
    logdet, t = _two_by_two(m[:, 0], m[:, 1], m[:, 2], d0, d1)
    v0, v1 = m[:, 3 : 3 + q], m[:, 3 + q :]
    return np.append(logdet.sum(), _removed(v0, v1, d0, d1, *_applied(t, v0, v1)))


def placed(stats: DataFrame, by: list[str]) -> DataFrame:
    """Subject sums by range of (key, mother, subject), in order within partitions, written so that steps find them in place."""
    # Joined by subject, not by mother: a hot mother's subjects meet nowhere.
    firsts = stats.groupBy(*by, "mom").agg(F.min("ID").alias("ID")).withColumn("is_first", F.lit(True))
    marked = stats.join(firsts, [*by, "mom", "ID"], "left").fillna(False, ["is_first"])
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(marked.repartitionByRange(parts, *by, "mom", "ID").sortWithinPartitions(*by, "mom", "ID"))


def likelihood_parts(stats: DataFrame, by: list[str], q: int, candidates: dict[tuple, np.ndarray], treatment: bool):
    """log|V| - n log(sigma^2) and Z'Z - Z'V^-1 Z of every key and candidate, collected (a few numbers each).

    ``stats`` comes from :func:`placed`; ``candidates[key]`` holds rows of log variance ratios (mother, subject, slope). Partitions
    send sums over their whole mothers and the partial sums of their first and last mother, which may go on elsewhere.
    """
    size, width = q * (q + 1) // 2, 3 + 2 * q
    types = dict(stats.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in by)

    def arrays(part):
        """What all candidates read of the subjects: n and ages, sums, and who has an own slope."""
        n, a, aa = (part[c].to_numpy(dtype=float) for c in ("n", "a", "aa"))
        own_slope = (~part["is_first"].to_numpy(dtype=bool)) if treatment else np.ones(len(n), dtype=bool)
        return n, a, aa, np.stack(part["u"].to_numpy()), np.stack(part["w"].to_numpy()), own_slope

    def subjects(n, a, aa, u, w, own_slope, theta):
        """Sums of each subject after its own effects are integrated out, and what that adds to the totals."""
        _, subj, slope = np.exp(theta)
        d0 = np.full(len(n), subj + (slope if treatment else 0.0))
        d1 = np.where(own_slope, slope, 0.0)
        logdet, t = _two_by_two(n, a, aa, d0, d1)
        t00, t01, t10, t11 = t
        tu, tw = _applied(t, u, w)
        return np.column_stack([t00 * n + t01 * a, t00 * a + t01 * aa, t10 * a + t11 * aa, tu, tw]), np.append(logdet.sum(), _removed(u, w, d0, d1, tu, tw))

    def run(batches):
        """One frame a partition: a frame per key and candidate would cost more than the algebra."""
        found = list(sent(batches))
        if found:
            sizes = [len(v) for *_, v in found]
            heads = {k: np.repeat(np.array([key[i] for key, *_ in found], dtype=object), sizes) for i, k in enumerate(by)}
            mom = pd.array([m for _, _, m, _ in found], dtype="Int64").repeat(sizes)
            yield pd.DataFrame({**heads, "cand": np.repeat([c for _, c, *_ in found], sizes), "mom": mom, "pos": np.concatenate([np.arange(n) for n in sizes]), "v": np.concatenate([v for *_, v in found])})

    def sent(batches):
        sums: dict[tuple, list] = {}
        first, open_ = None, None  # the partition's first mother; the mother that may go on in the next batch, with its sums

        def emit(key, c, mom, values):
            return key, c, mom, values

        def close(key, mothers):
            for c, m in enumerate(mothers):
                sums[key][c] = sums[key][c] + _mothers(m, candidates[key][c], treatment, q)

        for pdf in batches:
            for key, part in _key_groups(pdf, by):
                if key not in candidates:
                    continue
                thetas = candidates[key]
                sums.setdefault(key, [np.zeros(1 + size) for _ in thetas])
                moms = part["mom"].to_numpy()
                cut = np.flatnonzero(np.append(True, moms[1:] != moms[:-1]))
                per, given = [], arrays(part)
                for c, theta in enumerate(thetas):
                    rows, extra = subjects(*given, theta)
                    sums[key][c] = sums[key][c] + extra
                    per.append(np.add.reduceat(rows, cut, axis=0))
                names = [(key, m) for m in moms[cut]]
                if open_ is not None and open_[0] == names[0]:
                    for c in range(len(thetas)):
                        per[c][0] += open_[1][c]
                elif open_ is not None:
                    if open_[0] == first:
                        yield from (emit(first[0], c, first[1], v) for c, v in enumerate(open_[1]))
                    else:
                        close(open_[0][0], [v[None, :] for v in open_[1]])
                first = first or names[0]
                begin = 0
                if len(names) > 1 and names[0] == first:
                    yield from (emit(key, c, first[1], per[c][0]) for c in range(len(thetas)))
                    begin = 1
                if len(names) - 1 > begin:
                    close(key, [m[begin:-1] for m in per])
                open_ = (names[-1], [m[-1] for m in per])
        if open_ is not None:
            yield from (emit(open_[0][0], c, open_[0][1], v) for c, v in enumerate(open_[1]))
        for key, parts in sums.items():
            yield from (emit(key, c, None, v) for c, v in enumerate(parts))

    found = stats.mapInPandas(run, f"{head}, cand int, mom bigint, pos int, v double").groupBy(*by, "cand", "mom", "pos").agg(F.sum("v").alias("v")).toPandas()
    out, ends = {}, {}
    for key, part in _key_groups(found.sort_values("pos"), [*by, "cand"]):
        whole = part["mom"].isna()
        name = (key[:-1], int(key[-1]))
        out[name] = part.loc[whole, "v"].to_numpy()
        ends[name] = part.loc[~whole].sort_values(["mom", "pos"])["v"].to_numpy().reshape(-1, width)
    return {name: v + _mothers(ends[name], candidates[name[0]][name[1]], treatment, q) for name, v in out.items()}


def _unpack(upper, q):
    m = np.zeros((q, q))
    m[np.triu_indices(q)] = upper
    return m + np.triu(m, 1).T


def profiles(zz: np.ndarray, n: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients and maximised log-likelihoods given the variance ratios, of a stack: ``zz`` (m, q, q), ``n`` and rows of ``parts``."""
    q = zz.shape[1]
    removed = np.zeros_like(zz)
    i, j = np.triu_indices(q)
    removed[:, i, j] = removed[:, j, i] = parts[:, 1:]
    s = zz - removed
    xx, xy, yy = s[:, :-1, :-1], s[:, :-1, -1], s[:, -1, -1]
    inv = np.linalg.pinv(xx, hermitian=True)
    est = (inv @ xy[:, :, None])[:, :, 0]
    scale = np.maximum(yy - (est * xy).sum(1), 1e-300) / n
    llf = -0.5 * (n * (np.log(2 * np.pi * scale) + 1.0) + parts[:, 0])
    return {"est": est, "cov": scale[:, None, None] * inv, "scale": scale, "llf": llf}


def _stencil(center: np.ndarray) -> np.ndarray:
    d = len(center)
    rows = [center]
    rows += [center + s * STENCIL * np.eye(d)[i] for i in range(d) for s in (1, -1)]
    rows += [center + STENCIL * (np.eye(d)[i] + np.eye(d)[j]) for i in range(d) for j in range(i + 1, d)]
    return np.array(rows)


def _slopes(f: np.ndarray, d: int):
    """Gradient and Hessian from the values on the stencil."""
    plus, minus = f[1 : 1 + 2 * d : 2], f[2 : 2 + 2 * d : 2]
    grad = (plus - minus) / (2 * STENCIL)
    hess = np.diag((plus + minus - 2 * f[0]) / STENCIL**2)
    k = 1 + 2 * d
    for i in range(d):
        for j in range(i + 1, d):
            hess[i, j] = hess[j, i] = (f[k] - plus[i] - plus[j] + f[0]) / STENCIL**2
            k += 1
    return grad, hess


def _step(grad, hess, radius):
    """Newton step for a maximum, kept within the radius."""
    values, vectors = np.linalg.eigh(-hess)
    damp = max(1e-8, 1e-6 - values.min())
    g = vectors.T @ grad
    for _ in range(60):
        step = vectors @ (g / (values + damp))
        if np.linalg.norm(step) <= radius:
            break
        damp *= 2
    return step


class _Search:
    """Trust-region search of one key: where it is, what is known there, where to look next."""

    def __init__(self, start, fixed):
        self.at, self.free = np.array(start, dtype=float), [i for i in range(3) if i not in fixed]
        self.radius, self.best, self.result, self.done, self.converged, self.steps = 3.0, -np.inf, None, False, False, 0
        self.trial = self.at

    def candidates(self):
        full = np.repeat(self.trial[None, :], len(_stencil(self.trial[self.free])), axis=0)
        full[:, self.free] = _stencil(self.trial[self.free])
        return full

    def update(self, fits, tolerance):
        self.steps += 1
        f = np.array([r["llf"] for r in fits])
        if not self.free:
            self.best, self.result, self.converged, self.done = f[0], fits[0], True, True
            return
        if f[0] > self.best:
            self.best, self.at, self.result = f[0], self.trial, fits[0]
            self.grad, self.hess = _slopes(f, len(self.free))
            self.radius = min(self.radius * 2, 6.0)
        else:
            self.radius = self.radius / 4
        step = _step(self.grad, self.hess, self.radius)
        nxt = self.at.copy()
        nxt[self.free] = np.clip(self.at[self.free] + step, FLOOR, CEILING)
        moved = nxt[self.free] - self.at[self.free]
        expected = self.grad @ moved + 0.5 * moved @ self.hess @ moved
        self.converged = bool(expected < tolerance)
        self.done = self.converged or self.radius < 1e-4
        self.trial = nxt

    def boundary(self):
        """Whether an estimated ratio lies at the end of its range: no variance, or nothing but this one."""
        return bool(np.any(self.at[self.free] <= FLOOR + 1e-6) or np.any(self.at[self.free] >= CEILING - 1e-6))

    def ratios(self):
        """The variance ratios; one at the lower end is zero."""
        return [0.0 if i in self.free and v <= FLOOR + 1e-6 else float(np.exp(v)) for i, v in enumerate(self.at)]


def fit_mixed(
    df: DataFrame,
    by: list[str],
    terms: dict[str, Column],
    y: Column,
    slope_coding: str = "treatment",
    max_steps: int = 40,
    tolerance: float = 1e-5,
    start=(-2.0, -2.0, -4.0),
    fixed: dict[int, float] | None = None,
    factors: list[Factor] = (),
) -> DataFrame:
    """One row per key: terms, est, cov, scale, n, llf, variance ratios, steps, converged, boundary.

    ``slope_coding="treatment"`` gives all subjects of a mother one shared slope and all but the
    first an own one; ``"symmetric"`` gives each subject its own. ``fixed`` holds log variance
    ratios that are not estimated, by position (mother, subject, slope). ``factors`` add a column for each level but the
    reference; the first of ``terms`` must then be the intercept. ``converged`` is false if the steps ran out or no step improved;
    ``boundary`` is true if a ratio ended at the end of its range (a ratio at the lower end is reported as zero).
    """
    if slope_coding not in ("treatment", "symmetric"):
        raise ValueError(slope_coding)
    every = dict(terms) | {k: c for f in factors for k, c in f.terms().items()}
    zz = totals(df, by, terms, y, factors)
    stats = placed(subject_stats(df, by, every, y), by)
    fits = fit_placed(stats, zz, by, list(every), {"": list(every)}, slope_coding, max_steps, tolerance, start, fixed)
    return fits.drop("spec")


def fit_placed(
    stats: DataFrame,
    zz: dict[tuple, np.ndarray],
    by: list[str],
    names: list[str],
    specs: dict[str, list[str]],
    slope_coding: str = "treatment",
    max_steps: int = 40,
    tolerance: float = 1e-5,
    start=(-2.0, -2.0, -4.0),
    fixed: dict[int, float] | None = None,
) -> DataFrame:
    """Mixed models on several subsets of the columns ``names`` of the same subject sums: one row per key and ``spec``.

    ``stats`` comes from :func:`placed`, ``zz`` holds Z'Z of each key (columns and outcome). What a candidate removes from Z'Z does not depend
    on the columns a model takes, so a step of all keys and specifications is one job, and candidates that several of them ask for are worked out once.
    """
    if slope_coding not in ("treatment", "symmetric"):
        raise ValueError(slope_coding)
    treatment, q = slope_coding == "treatment", len(names) + 1
    counts = stats.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("n_subj"), F.count_if("is_first").alias("n_mothers"))
    known = {tuple(r[k] for k in by): (r["n"], r["n_subj"], r["n_mothers"]) for r in counts.collect()}
    rows = _search(lambda asked: likelihood_parts(stats, by, q, asked, treatment), known, zz, names, specs, max_steps, tolerance, start, fixed)
    return _fit_rows(stats.sparkSession, rows, by, dict(stats.dtypes))


def _search(parts_of, known: dict[tuple, tuple], zz: dict[tuple, np.ndarray], names: list[str], specs: dict[str, list[str]], max_steps: int, tolerance: float, start, fixed) -> list[tuple]:
    """Rows of the fits of every key of ``known`` (its visits, subjects and mothers) and specification.

    ``parts_of`` gives what every key's candidates remove from its ``zz`` (see :func:`likelihood_parts`). The small systems of all
    keys and candidates are solved as stacks, one a specification: thousands a step would cost the driver more than the sums cost the tasks.
    """
    fixed = fixed or {}
    first = [fixed.get(i, v) for i, v in enumerate(start)]
    columns = {spec: np.array([*[names.index(t) for t in terms], len(names)]) for spec, terms in specs.items()}
    searches = {(k, spec): _Search(first, fixed) for k in known for spec in specs}
    for _ in range(max_steps):
        active = {at: s.candidates() for at, s in searches.items() if not s.done}
        if not active:
            break
        asked: dict[tuple, dict[tuple, int]] = {}
        for (k, _), cands in active.items():
            rows = asked.setdefault(k, {})
            for c in cands:
                rows.setdefault(tuple(c), len(rows))
        parts = parts_of({k: np.array(list(rows)) for k, rows in asked.items()})
        for spec, at in columns.items():
            keys = [k for k, s in active if s == spec]
            if not keys:
                continue
            of = [[parts[(k, asked[k][tuple(c)])] for c in active[k, spec]] for k in keys]
            found = _profiles_of(zz, {k: known[k][0] for k in keys}, of, at)
            for k, fits in zip(keys, found):
                searches[(k, spec)].update(fits, tolerance)
    rows = []
    for (k, spec), s in searches.items():
        r, (n, n_subj, n_mothers) = s.result, known[k]
        rows.append(
            (*k, spec, list(specs[spec]), [float(v) for v in r["est"]], [[float(v) for v in line] for line in r["cov"]], float(r["scale"]))
            + (int(n), float(r["llf"]), *s.ratios(), int(n_subj), int(n_mothers), s.steps, s.converged, s.boundary())
        )
    return rows


def _fit_rows(spark, rows: list[tuple], by: list[str], types: dict[str, str]) -> DataFrame:
    head = ", ".join(f"{c} {types[c]}" for c in by)
    schema = f"{head}, spec string, {FIT_FIELDS}, psi_mother double, psi_subject double, psi_slope double, n_subj bigint, n_groups bigint, steps int, converged boolean, boundary boolean"
    return spark.createDataFrame(rows, schema)


def _profiles_of(zz: dict[tuple, np.ndarray], n: dict[tuple, int], parts: list[list[np.ndarray]], at: np.ndarray) -> list[list[dict]]:
    """:func:`profiles` with the columns ``at`` (the outcome last) of every key of ``n``, whose candidates have ``parts``, as one list of fits a key."""
    q = next(iter(zz.values())).shape[0]
    place = np.zeros((q, q), dtype=int)
    place[np.triu_indices(q)] = np.arange(1, 1 + q * (q + 1) // 2)
    place += np.triu(place, 1).T
    i, j = np.triu_indices(len(at))
    taken = np.concatenate([[0], place[np.ix_(at, at)][i, j]])
    reps = [len(p) for p in parts]
    whole = np.stack([zz[k][np.ix_(at, at)] for k in n]).repeat(reps, axis=0)
    f = profiles(whole, np.array(list(n.values()), dtype=float).repeat(reps), np.concatenate(parts)[:, taken])
    fits = [{name: v[r] for name, v in f.items()} for r in range(len(whole))]
    ends = np.cumsum([0, *reps])
    return [fits[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]


# Early growth as columns of the design ----------------------------------------------------------------


def _visit_sums(visits: DataFrame, z: list[Column]) -> DataFrame:
    """Per (mother, subject): n, sums of age and age^2, of the columns ``z`` (``u``), of their products with age (``w``) and with each other (``m``, upper triangle)."""
    x = visits.select(F.coalesce(F.col("mom"), -1 - F.col("ID")).alias("mom"), "ID", F.col("age_cen").alias("t"), *[c.cast("double").alias(f"z{i}") for i, c in enumerate(z)])
    q = len(z)
    return x.groupBy("mom", "ID").agg(
        F.count("*").alias("n"), F.sum("t").alias("a"), F.sum(F.col("t") * F.col("t")).alias("aa"),
        F.array(*[F.sum(f"z{i}") for i in range(q)]).alias("u"), F.array(*[F.sum(F.col("t") * F.col(f"z{i}")) for i in range(q)]).alias("w"),
        F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(q) for j in range(i, q)]).alias("m"),
    )


def scored_stats(visits: DataFrame, scores: DataFrame, by: list[str], terms: dict[str, Column], y: Column, score_names: list[str]) -> DataFrame:
    """Subject sums of designs ``terms`` + scores for every key of ``scores`` (by..., ID, scores).

    Scores do not vary between a subject's visits: visits are summed once, and the sums of score columns are multiples of the subject's
    n and ages. ``zz`` holds the upper triangle of the subject's Z'Z, outcome last.
    """
    q, k = len(terms) + 1, len(score_names)
    rows = _visit_sums(visits, [*terms.values(), y]).join(scores.select(*by, "ID", *score_names), "ID")
    cell = {}
    for i in range(q):
        for j in range(i, q):
            cell[i, j] = len(cell)
    order = [*range(q - 1), *[q + s for s in range(k)], q - 1]

    def product(a: int, b: int) -> Column:
        """Sum over the subject's visits of two design columns; columns from q on are scores."""
        sa, sb = (F.col(score_names[v - q]) if v >= q else None for v in (a, b))
        if sa is None and sb is None:
            return F.col("m")[cell[min(a, b), max(a, b)]]
        if sa is not None and sb is not None:
            return sa * sb * F.col("n")
        return F.col("u")[b] * sa if sb is None else F.col("u")[a] * sb

    spread = lambda of, n: F.array(*[F.col(score_names[v - q]) * F.col(n) if v >= q else F.col(of)[v] for v in order])
    zz = F.array(*[product(order[i], order[j]) for i in range(len(order)) for j in range(i, len(order))])
    return rows.select(*by, "mom", "ID", "n", "a", "aa", spread("u", "n").alias("u"), spread("w", "a").alias("w"), zz.alias("zz"))


#: Subjects, and mothers, whose sums are handled at once: what all candidates make of them stays near a core.
BLOCK, MOTHERS = 512, 128


def packed_sums(visits: DataFrame, scores: DataFrame, by: list[str], terms: dict[str, Column], y: Column, score_names: list[str]) -> DataFrame:
    """One row per (mother, subject) with its visit sums and the scores of all keys (``keys``), by range of (mother, subject) and in order.

    Visit sums are the same for every key, so neither they nor the subjects are repeated once a key. Written, so that steps find them in place.
    """
    packed = scores.groupBy("ID").agg(F.collect_list(F.struct(*by, *score_names)).alias("keys"))
    rows = _visit_sums(visits, [*terms.values(), y]).join(packed, "ID")
    parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(rows.repartitionByRange(parts, "mom", "ID").sortWithinPartitions("mom", "ID"))


class _Batch:
    """A batch of :func:`packed_sums`: the sums of its subjects, and for each key the subjects that have it with their scores."""

    def __init__(self, batch: pa.RecordBatch, by: list[str], score_names: list[str]):
        plain = lambda c: c.to_numpy(zero_copy_only=False)
        wide = lambda c: plain(batch.column(c).flatten()).reshape(batch.num_rows, -1)
        self.mom, self.ids = plain(batch.column("mom")), plain(batch.column("ID"))
        self.n, self.a, self.aa = (plain(batch.column(c)).astype(float) for c in ("n", "a", "aa"))
        self.u, self.w, self.m = wide("u"), wide("w"), wide("m")
        lists = batch.column("keys")
        entries = lists.flatten()
        fields = dict(zip([f.name for f in entries.type], entries.flatten(), strict=True))
        coded = [fields[k].dictionary_encode() for k in by]
        code, cells = np.zeros(len(entries), dtype=np.int64), 1
        for c in coded:
            code = code * len(c.dictionary) + plain(c.indices)
            cells *= len(c.dictionary)
        order = np.argsort(code.astype(np.int16) if cells < 2**15 else code, kind="stable")
        subject = np.repeat(np.arange(batch.num_rows), np.diff(plain(lists.offsets)))[order]
        values = np.column_stack([plain(fields[c]) for c in score_names])[order]
        begins = np.flatnonzero(np.diff(code[order], prepend=-1))
        self.keys = {}  # subjects and scores of each key
        for lo, hi in zip(begins, np.append(begins[1:], len(order))):
            key = tuple(c.dictionary[c.indices[int(order[lo])].as_py()].as_py() for c in coded)
            self.keys[key] = subject[lo:hi], values[lo:hi]

    def firsts(self, at: np.ndarray, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the mothers of the subjects ``at`` begin, their ids, and each one's first subject: here, or as ``known`` of mothers that lie in several partitions."""
        mom = self.mom[at]
        cut = np.flatnonzero(np.append(True, mom[1:] != mom[:-1]))
        first = self.ids[at][cut]
        for i in (0, -1):
            first[i] = known.get(int(mom[cut[i]]), first[i])
        return cut, mom[cut], first

    def sums(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """(subjects, 2, q + 2): sums of the design, scores and outcome (and their products with age), then n and ages: U'[Z U]."""
        n, a, aa = self.n[at], self.a[at], self.aa[at]
        p, k = self.u.shape[1] - 1, scores.shape[1]
        out = np.empty((len(at), 2, p + k + 3))
        for row, (z, times) in enumerate(((self.u, n), (self.w, a))):
            taken = z[at]
            out[:, row, :p], out[:, row, p : p + k], out[:, row, p + k] = taken[:, :p], scores * times[:, None], taken[:, p]
        out[:, 0, -2], out[:, 0, -1], out[:, 1, -2], out[:, 1, -1] = n, a, a, aa
        return out


def survey(packed: DataFrame, by: list[str], score_names: list[str], p: int) -> tuple[dict[tuple, tuple], dict[tuple, np.ndarray], dict[tuple, dict[int, int]]]:
    """Per key: visits, subjects and mothers; Z'Z; and the first subject of mothers that lie in several partitions.

    ``p`` is the number of design columns before the scores.
    """
    fields = packed.schema["keys"].dataType.elementType
    head = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in by)
    kinds = [*[to_arrow_type(fields[c].dataType) for c in by], pa.int64(), pa.int64(), pa.list_(pa.float64())]
    k = len(score_names)
    q = p + k + 1
    place = np.array([*range(p), q - 1])  # of the visits' columns

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        ends: dict[tuple, list] = {}  # of (key, mother) at an end of a batch: its first subject and how many rows have it
        begin = last = None
        for arrow in batches:
            if not arrow.num_rows:
                continue
            b = _Batch(arrow, by, score_names)
            begin = b.mom[0] if begin is None else begin
            last = b.mom[-1]
            i, j = np.triu_indices(p + 1)
            for key, (at, s) in b.keys.items():
                zz = np.zeros((q, q))
                zz[place[i], place[j]] = b.m[at].sum(0)
                across = b.u[at].T @ s
                zz[:p, p : p + k], zz[p : p + k, q - 1] = across[:p], across[p]
                zz[p : p + k, p : p + k] = s.T @ (s * b.n[at][:, None])
                cut, moms, first = b.firsts(at, {})
                heads = np.add.reduceat((b.ids[at] == np.repeat(first, np.diff(np.append(cut, len(at))))).astype(int), cut)
                inner = np.ones(len(moms), dtype=bool)
                for e in {0, len(moms) - 1}:
                    inner[e] = False
                    name = (key, int(moms[e]))
                    old = ends.get(name)
                    if old is None or first[e] < old[0]:
                        ends[name] = [int(first[e]), int(heads[e])]
                    elif first[e] == old[0]:
                        old[1] += int(heads[e])
                v = np.concatenate([[b.n[at].sum(), len(at), heads[inner].sum()], zz[np.triu_indices(q)]])
                total[key] = total[key] + v if key in total else v
        rows = [(*key, None, None, v.tolist()) for key, v in total.items()]
        for (key, mom), (first, heads) in ends.items():
            rows.append((*key, mom if mom in (begin, last) else None, first, [0.0, 0.0, float(heads), *[0.0] * (q * (q + 1) // 2)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=[*by, "mom", "ID", "v"])

    known: dict[tuple, np.ndarray] = {}
    shared: dict[tuple, dict[int, list]] = {}
    for r in packed.mapInArrow(run, f"{head}, mom bigint, ID bigint, v array<double>").collect():
        key, v = tuple(r[c] for c in by), np.array(r["v"])
        if r["mom"] is None:
            known[key] = known[key] + v if key in known else v
        else:
            shared.setdefault(key, {}).setdefault(r["mom"], []).append((r["ID"], v))
    opened: dict[tuple, dict[int, int]] = {}
    for key, moms in shared.items():
        for mom, found in moms.items():
            first = min(i for i, _ in found)
            for i, v in found:
                known.setdefault(key, np.zeros_like(v))
                known[key] = known[key] + (v if i == first else 0.0)
            if len(found) > 1:
                opened.setdefault(key, {})[mom] = first
    return {key: tuple(v[:3]) for key, v in known.items()}, {key: _unpack(v[3:], q) for key, v in known.items()}, opened


def _block_sums(v: np.ndarray, own: np.ndarray, cut: np.ndarray, thetas: np.ndarray, treatment: bool):
    """What a block of subjects adds for each candidate, and the sums of each mother once its subjects' effects are integrated out.

    ``v``: sums of the subjects (:meth:`_Batch.sums`), ``own``: who has an own slope, ``cut``: where mothers begin, ``thetas``: rows of log ratios of
    subject and slope. Per candidate the log determinants and U'Z products (upper triangle), (candidates, 1 + size); mothers as (mothers, candidates, 2, q + 2).
    """
    q = v.shape[2] - 2
    i, j = np.triu_indices(q)
    n, a, aa = (v[:, r, c][:, None] for r, c in ((0, q), (0, q + 1), (1, q + 1)))
    subj, slope = np.exp(thetas).T
    d0, d1 = subj + (slope if treatment else 0.0), own[:, None] * slope
    x0, x1, off = 1 + n * d0, 1 + aa * d1, a * d0
    det = x0 * x1 - off * a * d1
    inv = 1 / det
    t00, t01, t10, t11 = x1 * inv, -a * d1 * inv, -off * inv, x0 * inv
    u, w = v[:, 0, :q], v[:, 1, :q]
    ui, uj, wi, wj = u[:, i], u[:, j], w[:, i], w[:, j]
    own_parts = (d0 * t00).T @ (ui * uj) + (d0 * t01).T @ (ui * wj + wi * uj) + (d1 * t11).T @ (wi * wj)
    sizes = np.diff(np.append(cut, len(v)))
    mothers = np.empty((len(cut), len(thetas) * 2, q + 2))
    for k in np.unique(sizes):  # mothers with equally many subjects: one product of their matrices side by side
        which = np.flatnonzero(sizes == k)
        rows = cut[which][:, None] + np.arange(k)
        left = np.empty((len(which), len(thetas), 2, k, 2))
        for r, e, part in ((0, 0, t00), (0, 1, t01), (1, 0, t10), (1, 1, t11)):
            left[:, :, r, :, e] = part[rows].transpose(0, 2, 1)
        mothers[which] = left.reshape(len(which), len(thetas) * 2, 2 * k) @ v[rows].reshape(len(which), 2 * k, q + 2)
    return np.column_stack([np.log(det).sum(0), own_parts]), mothers.reshape(len(cut), len(thetas), 2, q + 2)


def _whole_mothers(m: np.ndarray, of: np.ndarray, thetas: np.ndarray, treatment: bool) -> np.ndarray:
    """:func:`_mothers` of all candidates: ``m`` (mothers, subject candidates, 2, q + 2); candidate c has the ratios ``thetas[c]`` and reads ``of[c]``."""
    q = m.shape[3] - 2
    i, j = np.triu_indices(q)
    d0, d1 = np.exp(thetas[:, :1]), np.exp(thetas[:, 2:]) if treatment else np.zeros((len(thetas), 1))
    total = np.zeros((len(thetas), 1 + len(i)))
    for lo in range(0, len(m), MOTHERS):
        x = np.ascontiguousarray(m[lo : lo + MOTHERS].transpose(1, 3, 2, 0))[of]  # candidates, q + 2, 2, mothers
        p00, p01, p11, v0, v1 = x[:, q, 0], x[:, q + 1, 0], x[:, q + 1, 1], x[:, :q, 0], x[:, :q, 1]
        x0, x1 = 1 + p00 * d0, 1 + p11 * d1
        det = x0 * x1 - p01 * p01 * d0 * d1
        inv = 1 / det
        s00, s01, s11 = (s[:, None] for s in (d0 * x1 * inv, -d0 * d1 * p01 * inv, d1 * x0 * inv))
        b0, b1 = s00 * v0, s11 * v1
        b0 += s01 * v1
        b1 += s01 * v0
        z = v0 @ b0.transpose(0, 2, 1) + v1 @ b1.transpose(0, 2, 1)
        total[:, 0] += np.log(det).sum(1)
        total[:, 1:] += z[:, i, j]
    return total


def packed_parts(packed: DataFrame, by: list[str], score_names: list[str], opened: dict[tuple, dict[int, int]], q: int, candidates: dict[tuple, np.ndarray], treatment: bool):
    """:func:`likelihood_parts` from :func:`packed_sums`.

    A subject's own effects do not depend on the mother's ratio, so candidates that differ in it alone share their subjects' matrices. Partitions
    send one array a key for their whole mothers and one for each mother at their ends; the arrays of a key are added up in one place.
    """
    names = list(candidates)
    number = {key: i for i, key in enumerate(names)}
    plans = {}
    for key, thetas in candidates.items():
        inner, of = np.unique(thetas[:, 1:], axis=0, return_inverse=True)
        plans[key] = thetas, inner, of.ravel()
    size = q * (q + 1) // 2

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        held: dict[tuple, np.ndarray] = {}  # of mothers that may go on: in the next batch, or in another partition
        carried: dict[tuple, dict[int, int]] = {}  # per key: the first subject of the mother that the batch before ended with
        begin = last = None

        def close(moms):
            for name in [x for x in held if x[1] not in moms]:
                thetas, _, of = plans[name[0]]
                sums[name[0]] += _whole_mothers(held.pop(name)[None], of, thetas, treatment)

        for arrow in batches:
            if not arrow.num_rows:
                continue
            b = _Batch(arrow, by, score_names)
            begin = int(b.mom[0]) if begin is None else begin
            last = int(b.mom[-1])
            ends = {int(b.mom[0]), last}
            for key, (at, s) in b.keys.items():
                if key not in plans:
                    continue
                thetas, inner, of = plans[key]
                total = sums.setdefault(key, np.zeros((len(thetas), 1 + size)))
                cut, moms, first = b.firsts(at, {**carried.get(key, {}), **opened.get(key, {})})
                carried[key] = {int(moms[-1]): int(first[-1])}
                counts = np.diff(np.append(cut, len(at)))
                own = (b.ids[at] != np.repeat(first, counts)) if treatment else np.ones(len(at), dtype=bool)
                v = b.sums(at, s)
                block = np.flatnonzero(np.append(True, np.diff(cut // BLOCK) > 0))  # mothers that begin a block
                for lo, hi in zip(block, np.append(block[1:], len(cut))):
                    begins, stops = cut[lo], cut[hi] if hi < len(cut) else len(at)
                    parts, m = _block_sums(v[begins:stops], own[begins:stops], cut[lo:hi] - begins, inner, treatment)
                    total += parts[of]
                    whole = np.ones(hi - lo, dtype=bool)
                    for e in {0, hi - lo - 1}:
                        mom = int(moms[lo + e])
                        if mom in ends:
                            whole[e] = False
                            held[key, mom] = held[key, mom] + m[e] if (key, mom) in held else m[e].copy()
                    if whole.any():
                        total += _whole_mothers(m if whole.all() else m[whole], of, thetas, treatment)
            close((begin, last))
        rows = [(number[key], None, v.tobytes()) for key, v in sums.items()] + [(number[key], mom, m.tobytes()) for (key, mom), m in held.items()]
        if rows:
            k, mom, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(mom, pa.int64()), pa.array(v, pa.binary())], names=["k", "mom", "v"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        split: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, mom, v in zip(*(batch.column(c).to_pylist() for c in ("k", "mom", "v"))):
                to, name = (sums, k) if mom is None else (split, (k, mom))
                to[name] = to[name] + np.frombuffer(v) if name in to else np.frombuffer(v)
        for (k, _), m in split.items():
            thetas, inner, of = plans[names[k]]
            sums[k] = sums[k] + _whole_mothers(m.reshape(1, len(inner), 2, q + 2), of, thetas, treatment).ravel()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["k", "v"])

    tasks = min(len(names), int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = packed.mapInArrow(run, "k int, mom bigint, v binary").repartition(tasks, "k").mapInArrow(add, "k int, v binary").collect()
    out = {}
    for r in rows:
        for c, v in enumerate(np.frombuffer(r["v"]).reshape(-1, 1 + size)):
            out[names[r["k"]], c] = v
    return out


def fit_scored(
    visits: DataFrame,
    scores: DataFrame,
    by: list[str],
    terms: dict[str, Column],
    y: Column,
    score_names: list[str],
    specs: dict[str, list[str]],
    slope_coding: str = "treatment",
    max_steps: int = 40,
    tolerance: float = 1e-5,
    start=(-2.0, -2.0, -4.0),
    fixed: dict[int, float] | None = None,
) -> DataFrame:
    """Mixed models of every key of ``scores`` and every specification (term names), from visits that are summed once; options as in :func:`fit_placed`."""
    if slope_coding not in ("treatment", "symmetric"):
        raise ValueError(slope_coding)
    treatment, names = slope_coding == "treatment", [*terms, *score_names]
    packed = packed_sums(visits, scores, by, terms, y, score_names)
    known, zz, opened = survey(packed, by, score_names, len(terms))
    rows = _search(lambda asked: packed_parts(packed, by, score_names, opened, len(names) + 1, asked, treatment), known, zz, names, specs, max_steps, tolerance, start, fixed)
    return _fit_rows(visits.sparkSession, rows, by, dict(scores.dtypes))


# Intercepts only, without Python ------------------------------------------------------------------------


def intercept_likelihood(stats: DataFrame, by: list[str], ratios: DataFrame, q: int) -> DataFrame:
    """by..., psi_mother, psi_subject, n, est, scale and llf of the model with intercepts of mothers and subjects at given variance ratios.

    ``stats``: subject sums with ``zz`` (see :func:`scored_stats`), ``ratios``: psi_mother, psi_subject (a short table, read as one array). With
    V_i = I + psi_s 11' of a subject and a mother's intercept on top, Woodbury's identity leaves per subject
    Z'Z - psi_s/(1 + n psi_s) s s' with s = Z'1, and per mother psi_m/(1 + psi_m A) b b' more, where A and b add up n and s over 1 + n psi_s.
    All of it are sums of column expressions; the normal equations are eliminated in an array column too.
    """
    size = q * (q + 1) // 2
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    grid = ratios.agg(F.collect_list(F.struct("psi_mother", "psi_subject"))).scalar()
    rows = stats.withColumn("r", grid).select("*", F.inline("r")).drop("r")
    d = 1 + F.col("n") * F.col("psi_subject")
    keys = [*by, "psi_mother", "psi_subject"]
    own = rows.select(
        *keys, "mom", "n", (F.col("n") / d).alias("a_"), F.log(d).alias("l"), F.transform("u", lambda v: v / d).alias("b"),
        F.array(*[F.col("zz")[k] - F.col("psi_subject") / d * F.col("u")[i] * F.col("u")[j] for k, (i, j) in enumerate(pairs)]).alias("z"),
    )
    add = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
    mothers = own.groupBy(*keys, "mom").agg(F.sum("n").alias("n"), F.sum("a_").alias("a_"), F.sum("l").alias("l"), add("b", q), add("z", size))
    e = 1 + F.col("psi_mother") * F.col("a_")
    left = F.array(*[F.col("z")[k] - F.col("psi_mother") / e * F.col("b")[i] * F.col("b")[j] for k, (i, j) in enumerate(pairs)])
    total = mothers.select(*keys, "n", (F.col("l") + F.log(e)).alias("l"), left.alias("z")).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("l").alias("l"), add("z", size))
    at = {p: k for k, p in enumerate(pairs)}
    cell = lambda i, j: F.col("z")[at[min(i, j), max(i, j)]]
    p = q - 1
    system = F.array(*[F.array(*[cell(i, j) for j in range(p)], cell(i, p)) for i in range(p)])
    out = total.withColumn("est", F.transform(eliminated(system, p), lambda row: row[p]))
    fitted = F.aggregate(F.zip_with("est", F.array(*[cell(i, p) for i in range(p)]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = out.withColumn("scale", (cell(p, p) - fitted) / F.col("n"))
    return out.select(*keys, "n", "est", "scale", (-0.5 * (F.col("n") * (F.log(2 * np.pi * F.col("scale")) + 1) + F.col("l"))).alias("llf"))


def eliminated(system: Column, p: int) -> Column:
    """Gauss-Jordan elimination of an array of p rows (matrix and right-hand sides) whose leading minors are positive."""

    def step(rows: Column, k: Column) -> Column:
        lead = F.transform(rows[k], lambda v: v / rows[k][k])
        return F.transform(rows, lambda row, i: F.when(i == k, lead).otherwise(F.zip_with(row, lead, lambda v, w: v - row[k] * w)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), system, step)
