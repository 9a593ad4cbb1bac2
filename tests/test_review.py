"""Report filters, ordered matrices, id lists and matrices that are read back."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortroll.operators import review
from cohortroll.session import scratch_path
from cohortroll.sources import sinks


def test_matrix_that_was_read_back(spark):
    sums = spark.createDataFrame([(p, g, k + 1) for k, (p, g) in enumerate((p, g) for p in "abc" for g in "xyz")], "profile string, gene string, count bigint")
    entries, rows, cols = sinks.coordinate_matrix(sums, "profile", "gene")
    library = sums.groupBy("profile").agg(F.sum("count").alias("library_size"))
    path = scratch_path(spark, "matrix")
    sinks.write_coordinate(entries, path)
    checks = lambda e, r=rows, c=cols, lib=library: {x.name: (x.n, x.passed) for x in sinks.matrix_source_checks(e, r, c, lib).collect()}
    assert set(checks(sinks.read_coordinate(spark, path)).values()) == {(0, True)}
    bad = checks(entries.where("row <> 2").unionByName(entries.where("row = 3 and col = 1")), c=cols.where("col <> 3"), lib=library.where("profile <> 'a'"))
    assert bad == {"rows_outside": (0, True), "columns_outside": (2, False), "rows_without_entry": (1, False), "columns_without_entry": (0, True),
                   "repeated_entries": (1, False), "row_sums_off": (3, False)}
    none = checks(entries.limit(0), rows.limit(0), cols.limit(0))
    assert set(none.values()) == {(0, True)}
    spark.createDataFrame([("1 one 2",)], "value string").write.text(f"{path}-broken")
    with pytest.raises(Exception, match="(?i)malformed|one"):
        sinks.read_coordinate(spark, f"{path}-broken").collect()


def test_lines_are_ordered_by_their_number_of_significant_levels(spark):
    rows = [("a", "x", 0.1, 0.01, False), ("a", "y", 0.2, 0.5, True), ("b", "x", 0.3, 0.02, False), ("b", "y", 0.1, 0.03, False),
            ("b", "y", 0.3, 0.9, None), ("c", "x", None, None, None), ("d", "x", 0.2, 0.04, True)]
    df = spark.createDataFrame(rows, "t string, s string, rho double, fdr double, fallback boolean")
    got = review.association_matrix(df, "t", "s", ["x", "y"], "rho", "fdr", "fallback").orderBy("place").collect()
    assert [(r.t, r.n_significant, r.place) for r in got] == [("b", 2, 1), ("a", 1, 2), ("d", 1, 3), ("c", 0, 4)]
    assert got[0].y_value == pytest.approx(0.2) and got[0].y_fdr == 0.03 and got[1].y_fallback and got[3].x_value is None


def test_rows_of_a_report(spark):
    df = spark.createDataFrame([(1, 9, True), (2, 3, True), (3, 9, False), (4, 9, None), (5, None, True)], "id int, n_subjects int, fdr_significant boolean")
    shown = lambda **how: [r.id for r in review.presentation_rows(df, **how).orderBy("id").collect()]
    assert shown() == [1, 2, 3, 4, 5] and shown(significant_only=True) == [1, 2, 5]
    assert shown(min_support=5) == [1, 3, 4] and shown(significant_only=True, min_support=5) == [1]


def test_ids_of_each_status_in_lists(spark):
    df = spark.createDataFrame([("kept", f"s{k:03d}") for k in range(25)] + [("open", "t1"), ("open", "t0")], "automated_screen_status string, signal_id string")
    got = {(r.automated_screen_status, r.list_no): r for r in review.evidence_id_lists(df.repartition(4), 10).collect()}
    assert {k: r.n_ids for k, r in got.items()} == {("kept", 0): 10, ("kept", 1): 10, ("kept", 2): 5, ("open", 0): 2}
    assert got["kept", 1].signal_ids == [f"s{k:03d}" for k in range(10, 20)] and got["open", 0].signal_ids == ["t0", "t1"]


def test_each_scenario_equals_a_fit_of_its_own(spark):
    rng = np.random.default_rng(8)
    grid = review.scenario_grid({"adjust": False, "drop_sparse": True, "min_cells": 2},
                            {"adjust": [True, False], "drop_sparse": [True, False], "min_cells": [1, 2, 4]})
    rows = [(f"u{k}", f"p{k // 2}", "ab"[k % 2], "xy"[int(rng.integers(2))], float(rng.integers(20, 60)), int(rng.integers(1, 7)),
             float(rng.normal())) for k in range(90)]
    df = spark.createDataFrame(rows, "sample_unit_id string, subject_id string, cell_type string, sex string, age double, n_cells int, score double")
    args = (df, grid, (20, 30, 40, 60), "sex", 20, ["cell_type"], "score", "n_cells")
    slopes = {(r.scenario_order, r.cell_type): (r.n, r.effect_per_10y) for r in review.scenario_trends(*args[:-3], value="score", size="n_cells").collect()}
    errors = {(r.scenario_order, r.cell_type): r for r in review.scenario_clustered_effects(*args).collect()}
    sparse = 0
    for order, s in enumerate(grid):
        kept = [r for r in rows if r[5] >= s["min_cells"]]
        bin_of = lambda r: np.searchsorted([30, 40], r[4], "right")
        size = Counter(bin_of(r) for r in kept)
        sparse += any(n < 20 for n in size.values()) and s["drop_sparse"]
        kept = [r for r in kept if not s["drop_sparse"] or size[bin_of(r)] >= 20]
        for kind in "ab":
            own = [r for r in kept if r[2] == kind]
            x, y = np.array([r[4] for r in own]), np.array([r[6] for r in own])
            if s["adjust"]:
                for sex in "xy":
                    of = np.array([r[3] == sex for r in own])
                    x[of] -= x[of].mean()
                    y[of] -= y[of].mean()
            slope, start = np.polyfit(x, y, 1)
            assert slopes[order, kind][0] == len(own) and np.isclose(slopes[order, kind][1], 10 * slope)
            u = (y - start - slope * x) * (x - x.mean()) / ((x - x.mean()) ** 2).sum()
            sums = Counter()
            for r, part in zip(own, u):
                sums[r[1]] += part
            assert np.isclose(errors[order, kind].standard_error, 10 * np.sqrt(sum(v * v for v in sums.values())))
            assert errors[order, kind].n_subjects == len(sums)
    assert sparse and len(slopes) == len(errors) == 2 * len(grid)


def test_matrix_parts_are_worked_out_once(spark):
    """Sums reach entries and both dimension tables, and entries all checks, through one evaluation each."""
    seen, read = (spark.sparkContext.accumulator(0) for _ in range(2))

    def counted(df, which):
        def run(batches):
            for batch in batches:
                which.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    sums = counted(spark.createDataFrame([("p", "g", 3), ("p", "h", 2), ("q", "g", 1)], "profile string, gene string, count long").coalesce(1), seen)
    entries, rows, cols = sinks.coordinate_matrix(sums, "profile", "gene")
    assert sorted(tuple(r) for r in entries.collect()) == [(1, 1, 3), (1, 2, 2), (2, 1, 1)] and seen.value == 3
    library = spark.createDataFrame([("p", 5), ("q", 1)], "profile string, library_size long")
    for checks in (sinks.matrix_checks, sinks.matrix_source_checks):
        read.value = 0
        assert all(r.passed for r in checks(counted(entries, read), rows, cols, library).collect()) and read.value == 3
