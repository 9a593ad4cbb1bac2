"""Scenario rows unfold after they are dealt by subject; what they meet is small and written."""

import numpy as np
import pytest

from cohortroll import session
from cohortroll.operators import review
from cohortroll.operators.stats import clustered_age_effect

GRID = review.scenario_grid({"adjust": False, "drop_sparse": True, "min_cells": 2}, {"adjust": [True], "drop_sparse": [False], "min_cells": [1]})


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(f"u{k % 300}", f"p{k % 300 // 3}", "ab"[k // 300], "xy"[k % 2], float(rng.integers(20, 60)), int(rng.integers(1, 4)), float(rng.normal())) for k in range(600)]
    return spark.createDataFrame(data, "sample_unit_id string, subject_id string, cell_type string, sex string, age double, n_cells int, score double")


def test_subjects_meet_once_before_scenarios_unfold(spark, rows, monkeypatch):
    args = (rows, GRID, (20, 30, 40, 60), "sex", 20, ["cell_type"], "score", "n_cells")
    known = lambda df: {(r.scenario, r.cell_type): (r.n_observations, r.n_subjects, r.effect_per_10y, r.standard_error) for r in df.collect()}
    want = known(review.scenario_clustered_effects(*args))
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    out = review.scenario_clustered_effects(*args)
    got = known(out)
    assert got.keys() == want.keys() and len(got) == 2 * len(GRID)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    # The subjects' exchange is below the unfolding; the one above it is of partial sums per test.
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_NUM" in line and "subject_id" in line for line in shuffles) == 1
    assert not any("age_bin" in line or "sex" in line for line in shuffles) and len(shuffles) == 2
    assert plan.index("Generate inline") < plan.index("REPARTITION_BY_NUM")


def test_age_effect_of_a_test_without_spread_has_no_numbers(spark):
    flat = spark.createDataFrame([("a", f"s{k}", 30.0, float(k)) for k in range(4)], "cell_type string, subject_id string, age double, y double")
    row = clustered_age_effect(flat, ["cell_type"], "subject_id", "y").first()
    assert (row.n_subjects, row.n_observations, row.effect_per_10y, row.standard_error, row.z_value) == (4, 4, None, None, None)
