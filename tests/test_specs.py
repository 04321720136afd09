"""Keyed components, specification grids and null patterns against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auxoline.operators import growth as G
from auxoline.operators import specs as S

VARS = ("HT", "WT")


def trajectories(rng, subjects=40, imps=3):
    """(var, imp, ID, age, value) with noise that grows by age; one trajectory is incomplete."""
    rows = []
    for v, var in enumerate(VARS):
        for i in range(subjects):
            level, slope = rng.normal(size=2)
            for k in range(imps):
                for a in G.AGES:
                    if (i, k, a) != (3, 1, 7):
                        rows.append((var, k, i, a, float(50 + (6 + v) * a + 2 * level + slope * a * (1 + v) + rng.normal())))
    return rows


def dense_basis(values, ndim):
    """values: one matrix (subjects x ages) per imputation."""
    mean, cov = np.mean([x.mean(0) for x in values], 0), np.mean([np.cov(x.T) for x in values], 0)
    sd = np.sqrt(np.diag(cov))
    d = np.diff(np.eye(10), n=2, axis=0)
    w, e = np.linalg.eigh(cov / np.outer(sd, sd) - 0.2 * d.T @ d)
    e = e[:, ::-1][:, :ndim]
    lean = np.where((e > 0).sum(0) != (e < 0).sum(0), (e > 0).sum(0) - (e < 0).sum(0), e.sum(0))
    return mean, cov, np.where(lean < 0, -e, e) / sd[:, None]


def test_keyed_basis_and_scores_match_each_key_alone(spark):
    rng = np.random.default_rng(1)
    rows = trajectories(rng)
    growth = spark.createDataFrame(rows, "var string, imp long, ID long, age int, value double")
    strata = spark.createDataFrame([(i, "female" if i % 3 else "male") for i in range(39)], "ID long, stratum string")
    wide = G.keyed_trajectories(growth, strata)
    basis = G.keyed_basis(wide, 2)
    got = {(r["var"], r.stratum): r for r in basis.collect()}
    assert set(got) == {(v, s) for v in VARS for s in ("female", "male", "both")}
    scores = {(r["var"], r.stratum, r.imp, r.ID): (r.pc0, r.pc1) for r in G.keyed_scores(wide, basis, 2).collect()}
    count = 0
    for (var, stratum), r in got.items():
        values, ids = [], []
        for k in range(3):
            by_id = {}
            for v, kk, i, a, x in rows:
                if v == var and kk == k and i < 39 and (stratum == "both" or stratum == ("female" if i % 3 else "male")):
                    by_id.setdefault(i, {})[a] = x
            full = {i: [x[a] for a in G.AGES] for i, x in by_id.items() if len(x) == 10}
            ids.append(list(full))
            values.append(np.array(list(full.values())))
        mean, cov, load = dense_basis(values, 2)
        assert np.allclose(r["mean"], mean) and np.allclose(np.array(r["cov"]), cov) and np.allclose(np.array(r["loadings"]).T, load)
        for k in range(3):
            for i, x in zip(ids[k], values[k]):
                assert scores[var, stratum, k, i] == pytest.approx(tuple((x - mean) @ load), abs=1e-8)
                count += 1
    assert count == len(scores)
    alone = G.fpca(G.pooled_moments(growth.join(strata, "ID").where("var = 'HT'"), []), [], 2).first()
    assert np.allclose(np.array(alone["loadings"]), np.array(got["HT", "both"]["loadings"]))


def visits(rng, subjects=30):
    rows = []
    for i in range(subjects):
        for _ in range(rng.integers(1, 6)):
            a, b, c, y, z = rng.normal(size=5)
            gap = rng.random(5) < (0.0, 0.2, 0.3, 0.1, 0.4)
            rows.append((i, "female" if i % 2 else "male", *[None if g else float(v) for g, v in zip(gap, (a, b, c, y + a, z - a), strict=True)]))
    return rows


COLUMNS = ("a", "b", "c", "y", "z")
SCHEMA = "ID long, stratum string, a double, b double, c double, y double, z double"


def test_every_specification_is_the_least_squares_of_its_complete_rows(spark):
    rng = np.random.default_rng(2)
    rows = visits(rng)
    # One subject has no score in one imputation, one has none at all.
    scores = [(v, k, i, float(rng.normal()), float(rng.normal())) for v in VARS for k in range(2) for i in range(29) if (k, i) != (1, 5)]
    grid = [
        S.Spec(("p", 1, "y"), "y", S.score_terms(["a"], 1)),
        S.Spec(("q", 2, "y"), "y", S.score_terms(["a", "b"], 2, ["a"]), ("c",)),
        S.Spec(("r", 2, "z"), "z", S.score_terms(["c"], 2, ["c"])),
        S.Spec(("s", 1, "z"), "z", S.score_terms(["a", "b", "c"], 1), (), {"stratum": "male"}),
    ]
    fits = S.fit_specs(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(scores, "var string, imp long, ID long, pc0 double, pc1 double"), ["var", "imp"], ["stratum"], ["name", "ndim", "outcome"], grid, 2)
    got = {(r["var"], r.imp, r.stratum, r.name): r for r in fits.collect()}
    assert len(got) == 2 * 2 * (3 * 2 + 1)
    for (var, imp, stratum, name), r in got.items():
        spec = next(s for s in grid if s.axes[0] == name)
        pcs = {i: (p, q) for v, k, i, p, q in scores if (v, k) == (var, imp)}
        x, y = [], []
        for i, s, *values in rows:
            at = dict(zip(COLUMNS, values, strict=True)) | {S.ONE: 1.0}
            if s == stratum and i in pcs and all(at[c] is not None for c in spec.needed()):
                x.append([at[c] * (1 if k is None else pcs[i][k]) for c, k in spec.terms.values()])
                y.append(at[spec.outcome])
        x, y = np.array(x), np.array(y)
        b, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
        assert r.terms == list(spec.terms) and r.n == len(y)
        assert r.est == pytest.approx(list(b), abs=1e-8)
        assert np.array(r["cov"]) == pytest.approx(((y - x @ b) ** 2).sum() / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x), abs=1e-8)


def test_more_specifications_take_no_more_jobs(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(visits(rng), SCHEMA)
    scores = spark.createDataFrame([("HT", 0, i, float(rng.normal())) for i in range(30)], "var string, imp long, ID long, pc0 double")
    one = [S.Spec((n, 1), y, S.score_terms(["a", "b", "c"], 1), ("y", "z")) for n, y in (("p", "y"),)]
    many = [S.Spec((f"{y}{k}", 1), y, S.score_terms(["a", "b", "c"][:k], 1), ("y", "z", "a", "b", "c")) for y in ("y", "z") for k in range(4)]
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n, grid in enumerate((one, many)):
        spark.sparkContext.setJobGroup(f"specs-{n}", "fits")
        assert S.fit_specs(df, scores, ["var", "imp"], ["stratum"], ["name", "ndim"], grid, 1).count() == 2 * len(grid)
        jobs.append(len(tracker.getJobIdsForGroup(f"specs-{n}")))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[0] == jobs[1]


def test_lattice_counts_rows_and_subjects(spark):
    rng = np.random.default_rng(4)
    rows = visits(rng, 60)
    # More sets than one word of bits holds.
    sets = {(f"s{m}", m % 3): [c for k, c in enumerate(COLUMNS) if m >> k & 1] for m in range(1, 32)}
    sets |= {(f"t{m}", 9): v for m, v in enumerate(list(sets.values()) * 2)}
    got = {(r.stratum, r.name, r.level): (r.n_columns, r.n_complete, r.n_subjects) for r in S.lattice(spark.createDataFrame(rows, SCHEMA), sets, ["name", "level"], by=["stratum"]).collect()}
    assert len(got) == 2 * len(sets)
    for (stratum, name, level), (width, complete, subjects) in got.items():
        want = sets[name, level]
        kept = [r[0] for r in rows if r[1] == stratum and all(r[2 + COLUMNS.index(c)] is not None for c in want)]
        assert (width, complete, subjects) == (len(want), len(kept), len(set(kept)))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.lattice(none, {("s", 1): ["a"]}, ["name", "level"]).count() == 0
    grid = [S.Spec(("p", 1), "y", S.score_terms(["a"], 1))]
    scores = spark.createDataFrame([], "var string, imp long, ID long, pc0 double")
    assert S.fit_specs(none, scores, ["var", "imp"], ["stratum"], ["name", "ndim"], grid, 1).count() == 0
    some = spark.createDataFrame([("HT", 0, 1, 0.5)], "var string, imp long, ID long, pc0 double")
    assert S.fit_specs(none, some, ["var", "imp"], ["stratum"], ["name", "ndim"], grid, 1).count() == 0
    with pytest.raises(ValueError):
        S.null_bitmap([f"c{i}" for i in range(70)])
    assert spark.createDataFrame([(None, 1.0)], "a double, b double").select(S.null_bitmap(["a", "b"]).alias("m"), F.lit(1)).first().m == 1


def test_bitmaps_are_as_few_as_the_needs(spark):
    """Null patterns of ten columns are hundreds; two sets of needs leave three kinds of rows that a model keeps, and what is shuffled is a visit's columns."""
    rng = np.random.default_rng(6)
    names = [f"c{i}" for i in range(10)]
    rows = [(i % 50, *[None if rng.random() < 0.2 else float(rng.normal()) for _ in names]) for i in range(2000)]
    df = spark.createDataFrame(rows, "ID long, " + ", ".join(f"{c} double" for c in names))
    grid = [S.Spec((f"p{k}", k), "c9", S.score_terms(names[lo:hi], 1)) for k, (lo, hi) in enumerate(((0, 3), (2, 5), (2, 5)))]
    kept = S.visit_rows(df, grid, []).collect()
    full = [[all(dict(zip(["ID", *names], r, strict=True))[c] is not None for c in s.needed()) for s in grid] for r in rows]
    assert len({r.bitmap for r in kept}) == 3
    assert len(kept) == sum(any(f) for f in full)
    for s, mask, k in zip(grid, S.unmet(grid)[1], range(3), strict=True):
        assert sum(r.bitmap & mask == 0 for r in kept) == sum(f[k] for f in full)
    assert {len(r.x) for r in kept} == {len(S.visit_columns(grid))}


def test_trajectories_of_rows_that_lie_by_subject_are_not_shuffled(spark):
    rows = trajectories(np.random.default_rng(7), subjects=6)
    growth = spark.createDataFrame(rows, "var string, imp long, ID long, age int, value double")
    placed = growth.repartition(3, "ID")
    wide = G.trajectories(placed, ["var"])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert wide.count() == 2 * (6 * 3 - 1) and wide.columns == ["var", "imp", "ID", *[f"a{a}" for a in G.AGES]]
