"""Gaussian process models of irregular series: maximum likelihood fits and conditional draws.

Kernel (non-stationary Gaussian, Paciorek and Schervish 2006): with scale s(t) = exp(scale design),
squared length u(t) = exp(smooth design) and m = (u_i + u_j) / 2,

    K_ij = s_i s_j (u_i u_j)^(1/4) / m^(1/2) exp(-(t_i - t_j)^2 / (2 m))

plus a noise variance per observation where one is fitted. Subjects are independent, so the
likelihood, its gradient and its expected information are sums over subjects: Spark sums
them, and the driver holds only the parameters of each stratum.

Observations of one subject at one age are first reduced to count, mean and within-age
covariance, which is exact with noise; without noise they are averaged. Ages are rounded to
three decimals, so a subject has at most a thousand distinct ages per year however many rows it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.functions.normal import keyed_normal
from auxoline.functions.scalar import by_stratum, dot
from auxoline.session import durable, spread

JITTER = 1e-8
CELLS = 10_000  # cells of each matrix handled at once: the dozen matrices of a stack stay in a core's cache
FLAT = 1e-6  # smallest eigenvalue of the scaled information from which parameters count as identified
GIVE_UP = 1e8  # damping beyond which no step improves the fit


@dataclass(frozen=True)
class ProcessModel:
    """Names of the design columns; an intercept is added to each design."""

    mean: tuple[str, ...]
    scale: tuple[str, ...]
    smooth: tuple[str, ...]
    noise: bool = False

    @property
    def sizes(self) -> tuple[int, int, int]:
        return len(self.mean) + 1, len(self.scale) + 1, len(self.smooth) + 1

    @property
    def n_cov(self) -> int:
        return self.sizes[1] + self.sizes[2] + int(self.noise)


@dataclass
class ProcessFit:
    """Parameters of one stratum."""

    beta: np.ndarray
    theta: np.ndarray
    llf: float = -np.inf
    steps: int = 0
    converged: bool = False
    identified: bool = False
    trace: list = field(default_factory=list)

    def split(self, model: ProcessModel):
        _, a, b = model.sizes
        noise = float(np.exp(2 * self.theta[-1])) if model.noise else 0.0
        return self.theta[:a], self.theta[a : a + b], noise


def _design(names) -> Column:
    return F.array(F.lit(1.0), *[F.col(n).cast("double") for n in names])


def subject_series(obs: DataFrame, by: list[str], model: ProcessModel, value: str, age: str = "Age") -> DataFrame:
    """One row per subject: its distinct ages in order, each with count, mean value and designs."""
    grouped = obs.where(F.col(value).isNotNull()).groupBy(*by, "ID", F.bround(age, 3).alias("t")).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("y"),
        *[F.avg(c).alias(c) for c in dict.fromkeys(model.mean + model.scale + model.smooth)],
    )
    point = F.struct(
        "t", F.col("n").cast("double").alias("n"), "y",
        _design(model.mean).alias("x"), _design(model.scale).alias("s"), _design(model.smooth).alias("u"),
    )
    return grouped.groupBy(*by, "ID").agg(F.array_sort(F.collect_list(point)).alias("points"))


def within_age(obs: DataFrame, by: list[str], model: ProcessModel, value: str, age: str = "Age") -> dict[tuple, dict]:
    """Pooled within-age cross-products per stratum: what replicates at one age say about the noise."""
    z = [*model.mean, value]
    cells = obs.where(F.col(value).isNotNull()).groupBy(*by, "ID", F.bround(age, 3).alias("t")).agg(
        F.count("*").alias("n"),
        *[(F.covar_pop(a, b) * F.count("*")).alias(f"c{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z) if i <= j],
    )
    p = len(z)
    rows = cells.groupBy(*by).agg(
        F.sum(F.col("n") - 1).alias("extra"),
        F.sum(F.log("n")).alias("logn"),
        *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)],
    )
    out = {}
    for r in rows.collect():
        m = np.zeros((p + 1, p + 1))  # first row and column belong to the intercept and stay zero
        for i in range(p):
            for j in range(i, p):
                m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"c{i}_{j}"]
        out[tuple(r[k] for k in by)] = {"extra": float(r["extra"]), "logn": float(r["logn"]), "m": m}
    return out


def kernel(t1, t2, s1, s2, u1, u2):
    """Covariance between two stacks of points: arrays (..., n1) and (..., n2)."""
    mid = (u1[..., :, None] + u2[..., None, :]) / 2
    d = t1[..., :, None] - t2[..., None, :]
    size = s1[..., :, None] * s2[..., None, :]
    return size * (u1[..., :, None] * u2[..., None, :]) ** 0.25 / np.sqrt(mid) * np.exp(-d * d / (2 * mid))


def kernel_column(t1: Column, t2: Column, s1: Column, s2: Column, u1: Column, u2: Column) -> Column:
    """The same kernel as a column expression."""
    mid = (u1 + u2) / 2.0
    d = t1 - t2
    return s1 * s2 * F.pow(u1 * u2, F.lit(0.25)) / F.sqrt(mid) * F.exp(-d * d / (2.0 * mid))


def _likelihood(t, n, y, x, sd, ud, fit: ProcessFit, model: ProcessModel):
    """Sums over a stack of subjects with equally many ages: value, gradients, information.

    Parameters whose covariances cannot be used (overflow, not positive definite) have the value -inf.
    """
    with np.errstate(all="ignore"):
        try:
            sums = _sums(t, n, y, x, sd, ud, fit, model)
        except np.linalg.LinAlgError:
            sums = np.full(1, np.nan)
    p, q = model.sizes[0], model.n_cov
    return sums if np.isfinite(sums).all() else np.append(-np.inf, np.zeros(p + p * p + q + q * q))


def _sums(t, n, y, x, sd, ud, fit: ProcessFit, model: ProcessModel):
    """With K the covariance, every derivative of it is D M + (D M)' with D = diag(a design column) and M one of two matrices: the scaled
    kernel for the scale, and for the smooth the kernel times its derivative by the first point's log length. So tr(K^-1 dK_i K^-1 dK_j) / 2
    is d_i' [N_i o N_j' + (M_i K^-1 M_j') o K^-1] d_j with N = M K^-1: two matrix products a subject, however many parameters there are.
    """
    gamma, delta, noise = fit.split(model)
    s, u = np.exp(sd @ gamma), np.exp(ud @ delta)
    mid = (u[:, :, None] + u[:, None, :]) / 2
    d2 = np.square(t[:, :, None] - t[:, None, :]) / mid
    size = s * u**0.25
    k0 = size[:, :, None] * size[:, None, :] / np.sqrt(mid) * np.exp(-d2 / 2)
    smooth = k0 * (0.25 - u[:, :, None] / (4 * mid) * (1 - d2))
    nugget = noise / n if model.noise else JITTER * s * s
    k = k0.copy()
    at = np.arange(t.shape[1])
    k[:, at, at] += nugget
    inv = np.linalg.inv(k)
    sign, logdet = np.linalg.slogdet(k)
    logdet = np.where(sign > 0, logdet, np.nan)  # not positive definite: the step is refused
    r = y - x @ fit.beta
    alpha = _times(inv, r)
    value = -0.5 * (np.sum(r * alpha) + logdet.sum() + t.size * np.log(2 * np.pi))
    info_beta = _gram(x, inv @ x)
    grad_beta = x.reshape(-1, x.shape[2]).T @ alpha.ravel()

    n_smooth = smooth @ inv
    across = smooth.transpose(0, 2, 1)
    if model.noise:
        scaled = k0
        n_scale = -nugget[:, :, None] * inv
        n_scale[:, at, at] += 1
        q_scale = k0 + nugget[:, :, None] * inv * nugget[:, None, :]
        q_scale[:, at, at] -= nugget
        q_cross = across - nugget[:, :, None] * n_smooth.transpose(0, 2, 1)
        h_scale = n_scale * n_scale.transpose(0, 2, 1) + q_scale * inv
        h_cross = n_scale * n_smooth.transpose(0, 2, 1) + q_cross * inv
    else:  # the jitter follows the scale: N is the identity
        scaled, n_scale = k, np.broadcast_to(np.eye(t.shape[1]), k.shape)
        h_scale, h_cross = k * inv, across * inv
        h_scale[:, at, at] += 1
        h_cross[:, at, at] += n_smooth[:, at, at]
    h_smooth = n_smooth * n_smooth.transpose(0, 2, 1) + (n_smooth @ across) * inv
    grad = [_slope(sd, alpha, scaled, n_scale), _slope(ud, alpha, smooth, n_smooth)]
    cross = _gram(sd, h_cross @ ud)
    info = np.block([[_gram(sd, h_scale @ sd), cross], [cross.T, _gram(ud, h_smooth @ ud)]])
    if model.noise:
        grad.append([np.sum(nugget * (alpha * alpha - inv[:, at, at]))])
        ni = nugget[:, :, None] * inv
        mixed = 2 * np.concatenate([_gram(d, np.einsum("sij,sji->si", m, ni)[:, :, None]) for d, m in ((sd, n_scale), (ud, n_smooth))])
        info = np.block([[info, mixed], [mixed.T, 2 * np.einsum("sij,sji->", ni, ni)]])
    return np.concatenate([[value], grad_beta, info_beta.ravel(), *grad, info.ravel()])


def _value(t, n, y, x, sd, ud, fit: ProcessFit, model: ProcessModel) -> np.ndarray:
    """The first of :func:`_likelihood`, from one triangular factor a subject.

    The residuals are a last row of the matrix, so that the factor's last row holds them solved for.
    """
    with np.errstate(all="ignore"):
        gamma, delta, noise = fit.split(model)
        s, u = np.exp(sd @ gamma), np.exp(ud @ delta)
        m, at = t.shape[1], np.arange(t.shape[1])
        size = s * u**0.25
        mid, d = u[:, :, None] + u[:, None, :], t[:, :, None] - t[:, None, :]
        mid /= 2
        d *= d
        d /= mid
        d /= -2
        np.exp(d, out=d)
        d /= np.sqrt(mid, out=mid)
        d *= size[:, :, None]
        d *= size[:, None, :]
        k = np.empty((len(t), m + 1, m + 1))
        k[:, :m, :m] = d
        k[:, at, at] += noise / n if model.noise else JITTER * s * s
        k[:, m, :m] = y - x @ fit.beta
        k[:, m, m] = np.finfo(float).max / 4  # beyond what the residuals take from it; nothing else reads it
        try:
            root = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return np.full(1, -np.inf)
        value = -0.5 * (np.square(root[:, m, :m]).sum() + 2 * np.log(root[:, at, at]).sum() + t.size * np.log(2 * np.pi))
    return np.full(1, value if np.isfinite(value) else -np.inf)


def _times(m, v):
    """Product of each matrix of a stack with its vector."""
    return (m @ v[:, :, None])[:, :, 0]


def _gram(a, b):
    """Sum over the stack of A' B."""
    return a.reshape(-1, a.shape[2]).T @ b.reshape(-1, b.shape[2])


def _slope(design, alpha, m, n):
    """Derivatives of the value by the coefficients of a design, whose matrix is ``m`` and m K^-1 is ``n``."""
    return design.reshape(-1, design.shape[2]).T @ (alpha * _times(m, alpha) - np.einsum("sii->si", n)).ravel()


def _columns(model: ProcessModel) -> list[str]:
    """Different design columns, each of which is kept once."""
    return list(dict.fromkeys(model.mean + model.scale + model.smooth))


def flat_series(series: DataFrame, by: list[str], model: ProcessModel, *more: str) -> DataFrame:
    """(by..., more..., flat): the points of a subject as one array of numbers, each with age, count, value and the different design columns.

    Steps read subjects again and again; arrays of numbers reach Python without an object per point.
    """
    place = {}
    for part, names in (("x", model.mean), ("s", model.scale), ("u", model.smooth)):
        for i, c in enumerate(names):
            place.setdefault(c, (part, i + 1))
    point = lambda q: F.array(q["t"], q["n"], q["y"], *[q[part][i] for part, i in (place[c] for c in _columns(model))])
    return series.select(*by, *more, F.flatten(F.transform("points", point)).alias("flat"))


def _unflat(points: np.ndarray, model: ProcessModel) -> dict[str, np.ndarray]:
    """Age, count, value and designs of points (..., numbers of a point)."""
    names = _columns(model)
    one = np.ones((*points.shape[:-1], 1))
    design = lambda of: np.concatenate([one, points[..., [3 + names.index(c) for c in of]]], axis=-1)
    return {"t": points[..., 0], "n": points[..., 1], "y": points[..., 2], "x": design(model.mean), "s": design(model.scale), "u": design(model.smooth)}


def _stacks(offsets: np.ndarray, numbers: np.ndarray, model: ProcessModel):
    """Subjects with equally many ages, cut so that a stack stays small; subject i has the numbers from offsets[i] to offsets[i + 1]."""
    wide = 3 + len(_columns(model))
    sizes = np.diff(offsets) // wide
    for m in np.unique(sizes):
        rows = np.flatnonzero(sizes == m)
        step = max(1, int(CELLS // (m * m)))
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            yield _unflat(numbers[offsets[at][:, None] + np.arange(m * wide)].reshape(len(at), m, wide), model)


def likelihood_sums(
    series: DataFrame, by: list[str], model: ProcessModel, fits: dict[tuple, list[ProcessFit]], whole: dict[tuple, bool] | None = None
) -> dict[tuple, np.ndarray]:
    """Likelihood, gradients and information of every stratum's candidate parameters, in one job: by (*stratum, candidate).

    ``series`` comes from :func:`subject_series`, or from :func:`flat_series` where it is read more than once. Strata
    that ``whole`` says no to have values alone; their gradients and information are zero.
    """
    types = dict(series.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in by)
    flat = series if "flat" in series.columns else flat_series(series, by, model)

    def run(batches):
        totals: dict[tuple, list] = {}
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True))
            which = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            of = np.array([which[k] for k in keys], dtype=int)
            points = batch.column(len(by))
            numbers, offsets = points.values.to_numpy(zero_copy_only=False), points.offsets.to_numpy()
            for key, i in which.items():
                if not fits.get(key):
                    continue
                sums = totals.setdefault(key, [0.0] * len(fits[key]))
                mine = np.flatnonzero(of == i)
                lengths = offsets[mine + 1] - offsets[mine]
                ends = np.append(0, np.cumsum(lengths))
                own = numbers[np.repeat(offsets[mine] - ends[:-1], lengths) + np.arange(ends[-1])] if len(which) > 1 else numbers[offsets[0] : offsets[-1]]
                for z in _stacks(ends, own, model):
                    for c, fit in enumerate(fits[key]):
                        found = _likelihood if whole is None or whole[key] else _value
                        sums[c] = sums[c] + found(z["t"], z["n"], z["y"], z["x"], z["s"], z["u"], fit, model)
        out = [pd.DataFrame({**dict(zip(by, key)), "cand": c, "pos": np.arange(len(v)), "v": v}) for key, sums in totals.items() for c, v in enumerate(sums)]
        if out:
            yield pa.RecordBatch.from_pandas(pd.concat(out, ignore_index=True).astype({**{k: np.int32 for k in by if types[k] == "int"}, "cand": np.int32, "pos": np.int32}), preserve_index=False)

    rows = flat.mapInArrow(run, f"{head}, cand int, pos int, v double").groupBy(*by, "cand", "pos").agg(F.sum("v").alias("v")).collect()
    sums: dict[tuple, np.ndarray] = {}
    p, q = model.sizes[0], model.n_cov
    for r in rows:
        sums.setdefault((*(r[k] for k in by), r["cand"]), np.zeros(1 + p + p * p + q + q * q))[r["pos"]] = r["v"]
    return sums


def _unpack(v, model: ProcessModel, fit: ProcessFit, extra: dict | None):
    """Split the sums and add what replicates at one age contribute."""
    p, q = model.sizes[0], model.n_cov
    cut = np.cumsum([1, p, p * p, q])
    value, gb, ib, gt, it = v[0], v[1 : cut[1]], v[cut[1] : cut[2]].reshape(p, p), v[cut[2] : cut[3]].copy(), v[cut[3] :].reshape(q, q).copy()
    if model.noise and extra and extra["extra"] > 0:
        noise = fit.split(model)[2]
        c = np.append(-fit.beta, 1.0)
        wss = c @ extra["m"] @ c
        value = value - 0.5 * (extra["extra"] * np.log(2 * np.pi * noise) + extra["logn"] + wss / noise)
        gb = gb + (extra["m"][:-1] @ c) / noise
        ib = ib + extra["m"][:-1, :-1] / noise
        gt[-1] += wss / noise - extra["extra"]
        it[-1, -1] += 2 * extra["extra"]
    return value, gb, ib, gt, it


def _starts(series: DataFrame, by: list[str], model: ProcessModel) -> dict[tuple, ProcessFit]:
    """First guesses: least-squares mean, log of the residual spread, and a quarter of the usual
    distance between neighbouring ages as length, which keeps the first covariance matrices well conditioned."""
    p = model.sizes[0]
    x = [F.col("x")[i] for i in range(p)] + [F.col("y")]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    rows = (
        series.select(*by, F.size("points").alias("k"), F.inline("points"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.avg("k").alias("k"),
            (F.max("t") - F.min("t")).alias("span"),
            *[F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    fits = {}
    for r in rows:
        c = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        beta = np.linalg.pinv(c[:p, :p], hermitian=True) @ c[:p, p]
        sd = np.sqrt(max((c[p, p] - beta @ c[:p, p]) / r["n"], 1e-6))
        theta = np.zeros(model.n_cov)
        theta[0] = np.log(sd)
        theta[model.sizes[1]] = 2 * np.log(max(r["span"], 1e-3) / max(4 * r["k"], 16.0))
        if model.noise:
            theta[-1] = np.log(sd / 2)
        fits[tuple(r[k] for k in by)] = ProcessFit(beta, theta)
    return fits


#: Damping and reach of the candidates that one job tries, relative to the stratum's own.
TRIALS = ((0.1, 2.0), (1.0, 1.0), (100.0, 0.125))


def _trials(fit: ProcessFit, s: dict, tolerance: float) -> list[ProcessFit]:
    """Candidate steps of one stratum; none once the predicted gain is below the tolerance."""
    gb, ib, gt, it = s["at"]
    diag = np.maximum(np.diag(it), 1e-8 * max(np.diag(it).max(), 1e-8))
    newton_b = np.linalg.pinv(ib, hermitian=True) @ gb
    out = []
    for damp, reach in TRIALS:
        damp, reach = s["damp"] * damp, s["reach"] * reach
        move = np.linalg.solve(it + np.diag(damp * diag) + 1e-10 * np.eye(len(gt)), gt)
        move *= min(1.0, reach / max(np.abs(move).max(), 1e-12))
        step_b = newton_b / (1.0 + damp)
        # The gain is judged on the least damped step: a short step promises little wherever it is taken.
        if not out and gt @ move + gb @ step_b < tolerance:
            fit.converged = True
            return []
        out.append(ProcessFit(fit.beta + step_b, fit.theta + move))
    return out


def _identified(it: np.ndarray) -> bool:
    """Whether the likelihood is curved in every direction of the covariance parameters."""
    size = np.sqrt(np.maximum(np.diag(it), 0.0))
    if not size.all():
        return False
    return bool(np.linalg.eigvalsh(it / np.outer(size, size)).min() > FLAT and size.min() > FLAT * size.max())


def _best(series: DataFrame, by: list[str], model: ProcessModel, trials: dict[tuple, list[ProcessFit]], least: dict[tuple, float], extra: dict[tuple, dict]) -> dict[tuple, tuple]:
    """The best of each stratum's trials, with its sums (see :func:`_unpack`), itself and its number.

    Gradients and information cost several times what a value does, and only a trial that is taken needs them: one job finds the values of all
    trials, a second the rest for the best of each stratum, if it is better than ``least``. One trial alone is worked out at once.
    """
    found: dict[tuple, list] = {k: [None] * len(t) for k, t in trials.items()}
    done: set[tuple] = set()  # (stratum, trial) with gradients and information

    def take(asked: dict[tuple, list[int]]):
        whole = {k: len(numbers) == 1 for k, numbers in asked.items()}
        sums = likelihood_sums(series, by, model, {k: [trials[k][c] for c in numbers] for k, numbers in asked.items()}, whole)
        for k, numbers in asked.items():
            for place, c in enumerate(numbers):
                found[k][c] = (*_unpack(sums[(*k, place)], model, trials[k][c], extra.get(k)), trials[k][c], c)
                if whole[k]:
                    done.add((k, c))

    take({k: list(range(len(t))) for k, t in trials.items()})
    while True:
        best = {k: max(f, key=lambda r: r[0] if np.isfinite(r[0]) else -np.inf) for k, f in found.items()}
        missing = {k: [r[-1]] for k, r in best.items() if (k, r[-1]) not in done and np.isfinite(r[0]) and r[0] > least[k]}
        if not missing:
            return best
        take(missing)


def fit_process(
    series: DataFrame,
    by: list[str],
    model: ProcessModel,
    extra: dict[tuple, dict] | None = None,
    max_steps: int = 100,
    tolerance: float = 1e-3,
) -> dict[tuple, ProcessFit]:
    """Damped Fisher scoring; all strata advance together, and one job tries several steps of each (see :func:`_best`).

    ``converged`` means that no further gain is predicted; a fit that ran out of steps, or that no step improves although one
    should, is returned with ``converged`` false. ``identified`` is false where the likelihood is flat in some direction.
    """
    fits = _starts(series, by, model)
    series = flat_series(spread(series, "ID"), by, model).persist()
    state = {k: {"damp": 1e-3, "reach": 2.0, "trials": [f], "at": None} for k, f in fits.items()}
    extra = extra or {}
    try:
        for _ in range(max_steps):
            active = {k: s["trials"] for k, s in state.items() if s["trials"]}
            if not active:
                break
            best_of = _best(series, by, model, active, {k: fits[k].llf for k in active}, extra)
            for key in active:
                s, old = state[key], fits[key]
                value, gb, ib, gt, it, best, c = best_of[key]
                first = s["at"] is None
                if np.isfinite(value) and value > old.llf:
                    best.llf, best.trace, best.steps = value, [*old.trace, float(value)], old.steps + 1
                    fits[key], s["at"] = best, (gb, ib, gt, it)
                    if not first:
                        s["damp"], s["reach"] = min(max(s["damp"] * TRIALS[c][0], 1e-9), GIVE_UP), min(s["reach"] * TRIALS[c][1], 32.0)
                else:
                    old.steps += 1
                    s["damp"], s["reach"] = s["damp"] * 1000, s["reach"] / 16
                if s["at"] is None:
                    raise ValueError(f"the starting values of {key} give no likelihood")
                s["trials"] = _trials(fits[key], s, tolerance) if s["damp"] <= GIVE_UP else []
                fits[key].identified = _identified(s["at"][3])
    finally:
        series.unpersist()
    return fits


def usable(fits: dict[tuple, ProcessFit]) -> dict[tuple, ProcessFit]:
    """The fits, if all converged; draws from others would be draws from an arbitrary model."""
    if late := [k for k, f in fits.items() if not f.converged]:
        raise ValueError(f"the fits of {late} did not converge")
    return fits


def fit_rows(spark, fits: dict[tuple, ProcessFit], by: list[str], types: dict[str, str], model: ProcessModel) -> DataFrame:
    """Fitted parameters as rows (by..., part, term, est, llf, steps, converged, identified)."""
    rows = []
    labels = [(part, t) for part, names in (("mean", model.mean), ("scale", model.scale), ("smooth", model.smooth)) for t in ("Intercept", *names)]
    labels += [("noise", "log sd")] if model.noise else []
    for key, f in fits.items():
        for (part, term), est in zip(labels, np.concatenate([f.beta, f.theta])):
            rows.append((*key, part, term, float(est), float(f.llf), f.steps, f.converged, f.identified))
    head = ", ".join(f"{k} {types[k]}" for k in by)
    return spark.createDataFrame(rows, f"{head}, part string, term string, est double, llf double, steps int, converged boolean, identified boolean")


def _root(v: np.ndarray) -> np.ndarray:
    """Symmetric square root with negative eigenvalues set to zero."""
    values, vectors = np.linalg.eigh(v)
    return (vectors * np.sqrt(np.clip(values, 0.0, None))) @ vectors.T


def conditional(points: dict, at: dict, fit: ProcessFit, model: ProcessModel, noise: float):
    """Mean shift and covariance root of the process at new points given one subject's observations."""
    gamma, delta, _ = fit.split(model)
    s0, u0 = np.exp(at["s"] @ gamma), np.exp(at["u"] @ delta)
    k00 = kernel(at["t"], at["t"], s0, s0, u0, u0)
    if len(points["t"]) == 0:
        return np.zeros(len(at["t"])), _root(k00)
    s1, u1 = np.exp(points["s"] @ gamma), np.exp(points["u"] @ delta)
    nugget = noise / points["n"] if model.noise else JITTER * s1 * s1
    k11 = kernel(points["t"], points["t"], s1, s1, u1, u1) + np.diag(nugget)
    k01 = kernel(at["t"], points["t"], s0, s1, u0, u1)
    w = np.linalg.solve(k11, k01.T)
    resid = points["y"] - points["x"] @ fit.beta
    return w.T @ resid, _root(k00 - k01 @ w)


def normals(tag: str, imps: list[int], count: Column) -> Column:
    """An array of ``count`` normals for each imputation, keyed by (tag, imputation, subject, position): they do not depend on partitions, nor on the others asked for."""
    each = F.array(*[F.lit(i).cast("bigint") for i in imps])
    return F.transform(each, lambda i: F.transform(F.sequence(F.lit(1), count), lambda k: keyed_normal(tag, i, F.col("ID"), k)))


def conditional_series(series: DataFrame, by: list[str], model: ProcessModel, fits: dict[tuple, ProcessFit], nugget_shrink: float = 1.0) -> DataFrame:
    """Per subject: conditional mean shift ``z``, standard deviation ``sd`` and the draws ``f`` at its target points.

    ``series`` holds ``points`` (may be empty), ``targets`` (age and designs) and ``e`` (arrays of normals, one per draw) per
    subject. ``z`` and ``f`` exclude the mean function. Each subject is handled alone, so any number of them spreads over the
    cluster, and the covariance root stays where it is computed.
    """
    types = dict(series.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in (*by, "ID"))
    wide, n_scale, n_smooth = 3 + len(_columns(model)), model.sizes[1], model.sizes[2]
    target = F.transform("targets", lambda q: F.concat(F.array(q["t"]), q["s"], q["u"]))
    asked = series.withColumns({"targets": F.flatten(target), "draws": F.size("e"), "e": F.flatten("e")})

    def run(batches):
        for pdf in batches:
            keys = list(zip(*(pdf[k] for k in (*by, "ID")), strict=True))
            rows = []
            for key, points, targets, n, e in zip(keys, pdf["flat"], pdf["targets"], pdf["draws"], pdf["e"], strict=True):
                fit = fits[key[:-1]]
                noise = fit.split(model)[2] / nugget_shrink
                new = np.asarray(targets, dtype=float).reshape(-1, 1 + n_scale + n_smooth)
                at = {"t": new[:, 0], "s": new[:, 1 : 1 + n_scale], "u": new[:, 1 + n_scale :]}
                z, root = conditional(_unflat(np.asarray(points, dtype=float).reshape(-1, wide), model), at, fit, model, noise)
                draws = z + np.asarray(e, dtype=float).reshape(n, -1) @ root if n else np.zeros((0, len(z)))
                rows.append((*key, at["t"].tolist(), z.tolist(), np.sqrt(np.square(root).sum(0)).tolist(), draws.tolist()))
            yield pd.DataFrame(rows, columns=[*by, "ID", "t", "z", "sd", "f"])

    flat = flat_series(spread(asked, "ID"), by, model, "ID", "targets", "draws", "e")
    return flat.mapInPandas(run, f"{head}, t array<double>, z array<double>, sd array<double>, f array<array<double>>")


def draw(cond: DataFrame, by: list[str], imps: list[int]) -> DataFrame:
    """The draws as rows: (by..., imp, ID, t, z, f); ``imps`` are the imputations the draws stand for, in order."""
    named = F.array(*[F.lit(i).cast("bigint") for i in imps])
    per_imp = cond.select(*by, "ID", "t", "z", F.posexplode("f").alias("imp", "f"))
    points = F.inline(F.arrays_zip(F.col("t").alias("t"), F.col("z").alias("z"), F.col("f").alias("f")))
    return per_imp.select(*by, named[F.col("imp")].alias("imp"), "ID", points)


def mean_value(fit_beta: Column, names: tuple[str, ...]) -> Column:
    """Mean function of a row, from an array of coefficients."""
    total = fit_beta[0]
    for i, n in enumerate(names):
        total = total + fit_beta[i + 1] * F.col(n)
    return total


def beta_column(fits: dict[tuple, ProcessFit], by: list[str]) -> Column:
    """Coefficients of the row's stratum as an array (one literal entry per stratum)."""
    out = None
    for key, f in fits.items():
        hit = F.lit(True)
        for k, v in zip(by, key):
            hit = hit & (F.col(k) == v)
        b = F.array(*[F.lit(float(v)) for v in f.beta])
        out = F.when(hit, b) if out is None else out.when(hit, b)
    return out


def impute_grid(series: DataFrame, grid: DataFrame, by: list[str], model: ProcessModel, fits, n_imp: int, tag: str, imps: list[int] | None = None) -> DataFrame:
    """Completed trajectories on a common grid: (by..., imp, ID, age, value, mean), three decimals.

    ``grid`` holds per stratum the target points: one short row per stratum. ``imps`` asks for some of the imputations only.
    """
    imps = list(range(n_imp)) if imps is None else imps
    targets = F.transform("points", lambda p: F.struct(p["t"].alias("t"), p["s"].alias("s"), p["u"].alias("u"), dot(p["x"], F.col("beta")).alias("m")))
    known = durable(grid.withColumn("beta", beta_column(fits, by)).select(*by, targets.alias("targets")))
    joined = series.withColumn("targets", by_stratum(known, by, F.col("targets"))).withColumn("e", normals(tag, imps, F.size("targets")))
    drawn = draw(conditional_series(joined, by, model, fits), by, imps)
    means = F.map_from_entries(F.transform("targets", lambda p: F.struct(p["t"], p["m"])))
    mean = F.try_element_at(by_stratum(known, by, means), F.col("t"))
    return drawn.withColumn("mean", mean).select(
        *by, "imp", "ID", F.col("t").cast("int").alias("age"),
        F.round(F.col("mean") + F.col("f"), 3).alias("value"), F.round("mean", 3).alias("mean"),
    )


def impute_missing(
    visits: DataFrame, by: list[str], model: ProcessModel, value: str, fits, n_imp: int, tag: str, nugget_shrink: float = 10.0, age: str = "Age"
) -> DataFrame:
    """Draws at the visits where ``value`` is missing: (by..., imp, ID, visit_id, Age, value).

    The process is drawn jointly at a subject's distinct missing ages, and each visit adds its own mean
    and noise: the same distribution as a joint draw of all visits, without a matrix over visits. Subjects
    with nothing missing emit nothing; subjects with nothing observed get unconditional draws.
    """
    t = F.bround(age, 3)
    missing = visits.where(F.col(value).isNull()).withColumn("t", t)
    at = missing.groupBy(*by, "ID", "t").agg(*[F.avg(c).alias(c) for c in dict.fromkeys(model.scale + model.smooth)])
    point = F.struct("t", _design(model.scale).alias("s"), _design(model.smooth).alias("u"))
    targets = at.groupBy(*by, "ID").agg(F.array_sort(F.collect_list(point)).alias("targets"))
    series = subject_series(visits, by, model, value, age)
    empty = F.coalesce("points", F.expr("filter(array(struct(0D AS t, 0D AS n, 0D AS y, array(0D) AS x, array(0D) AS s, array(0D) AS u)), p -> false)"))
    joined = targets.join(series, [*by, "ID"], "left").withColumn("points", empty).withColumn("e", normals(tag, list(range(n_imp)), F.size("targets")))
    drawn = draw(conditional_series(joined, by, model, fits, nugget_shrink), by, list(range(n_imp)))
    out = missing.join(drawn, [*by, "ID", "t"])
    mean = mean_value(beta_column(fits, by), model.mean)
    sd = None
    for key, f in fits.items():
        hit = F.lit(True)
        for k, v in zip(by, key):
            hit = hit & (F.col(k) == v)
        size = F.lit(float(np.sqrt(f.split(model)[2] / nugget_shrink)))
        sd = F.when(hit, size) if sd is None else sd.when(hit, size)
    own = keyed_normal(tag + " noise", F.col("imp"), F.col("ID"), F.col("visit_id"))
    return out.select(*by, "imp", "ID", "visit_id", F.col(age).alias("Age"), (mean + F.col("f") + sd * own).alias("value"))
