import math

import numpy as np
import pytest

from cohortroll.functions import resolve
from cohortroll.functions.tails import f_upper_np, normal_two_sided_np, t_two_sided_np
from cohortroll.operators.review import scenario_grid


def test_tail_probabilities_match_closed_forms():
    # t with one degree of freedom is Cauchy, with two it has a closed form; F(1, d) is t squared.
    for t in (0.1, 1.0, 3.0, 30.0):
        assert t_two_sided_np(t, 1.0) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-10)
        assert t_two_sided_np(t, 2.0) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-10)
        assert f_upper_np(t * t, 1.0, 7.0) == pytest.approx(float(t_two_sided_np(t, 7.0)), abs=1e-10)
    assert t_two_sided_np(1.96, 1e6) == pytest.approx(float(normal_two_sided_np(1.96)), abs=1e-5)
    assert np.isnan(t_two_sided_np(np.nan, 3.0))


def test_column_resolution_order_and_errors():
    assert resolve.resolve_column(["Tube_id", "x"], "tube_id") == "Tube_id"
    assert resolve.resolve_column(["Donor.ID"], "subject_id", resolve.ALIASES) == "Donor.ID"
    assert resolve.resolve_column(["a"], "b") is None
    with pytest.raises(KeyError):
        resolve.explicit_or_fallback(["age"], "donor", ["age"], "subject")
    assert resolve.present_covariates(["site", "smoker"], None, ["smoker", "bmi", "site"]) == ["smoker", "site"]
    assert resolve.present_covariates(["site", "smoker"], [], ["site"]) == []
    with pytest.raises(KeyError, match="bmi"):
        resolve.present_covariates(["site"], ["site", "bmi"])
    for configured, defaults in ((["site", "site"], ()), (None, ["site", "site"])):
        with pytest.raises(ValueError):
            resolve.present_covariates(["site"], configured, defaults)
    with pytest.raises(ValueError):
        resolve.require_disjoint_lists(["A"], ["A"])


def test_scenario_grid_is_one_at_a_time_and_unique():
    grid = scenario_grid({"a": 1, "b": True}, {"a": [1, 2], "b": [True, False]})
    assert grid == [{"a": 1, "b": True}, {"a": 2, "b": True}, {"a": 1, "b": False}]
