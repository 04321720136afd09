"""The registered queries: contract, and a cross-section against SQL on the smallest scale."""

import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

CROSS_SECTION = [
    "cohort_view", "cohort_funnel", "modal_sex", "zscores", "table_one", "age_sex_stats", "asof_nearest_fill_3_days",
    "covariate_levels", "fpca_loadings", "analysis_frame", "bspline_basis", "rubin_pool", "growth_contrast", "effect_grid",
    "coef_trajectory_fitted", "complete_case_lattice", "fpca_keyed", "pc_scores_fpca", "imputation_funnels", "gp_llf_puberty",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = {q for q in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline$", q)}
    assert rows_only == {
        "gp_fit", "gp_fit_visits", "gp_impute_grid", "gp_impute_missing", "mediator_simulation", "mixed_fit",
        "growth_contrast_fitted", "mediation_effects_fitted", "mediation_grid", "mixed_fit_full", "mixed_pool", "fpca_from_draws", "select_dim_fitted",
        "gp_fit_puberty", "puberty_frame",
    }


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and len(e.oracle_sql()) > 60"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=str(__import__("pathlib").Path(entry.__file__).parent))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = rows_of([tuple(r) for r in df.select(cols).collect()], cols)
    want = rows_of(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall(), cols)
    assert got == want
