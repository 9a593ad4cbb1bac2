"""Associations send and write little: rows go by subject once, replicates get numbers of values, results are the direct ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortroll import session
from cohortroll.operators import association as at
from cohortroll.operators import glm
from cohortroll.operators import resampling as rs
from cohortroll.operators.rollup import signature_scores
from cohortroll.operators.stats import folded_spearman, spearman
from cohortroll.plans import bindings as b
from cohortroll.plans import q_models
from cohortroll.plans.q_rollups import gene_sets

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "sample_unit_id string, subject_id string, cell_type string, signature string, age double, sex string, score double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = [(f"s{k}-{v}", f"s{k}", t, g, 30.0 + k % 40 + v, "FM"[k % 2], float(round(rng.normal(), 1))) for k in range(60) for v in range(2) for t in "PQ" for g in "ab"]
    data += [("s0-0", "s0", "R", "a", 30.0, "F", 1.0), ("s1-x", "s1", "R", "a", 1.0, "M", 1.0)]  # too few subjects, and s1's earliest sample
    return spark.createDataFrame(data, SCHEMA)


def plan_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan


def test_large_test_is_sent_as_numbers_and_ranked_in_its_task():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 500).astype(float), np.round(rng.normal(size=500), 1)
    batch = pa.RecordBatch.from_pydict({"__t": np.zeros(500, int), "__bucket": np.arange(500) // 120, "__h": np.arange(500), "__id": [""] * 500, "__x": x, "__y": y})
    part = next(rs.coded_parts(iter([batch]))).to_pylist()
    assert all(len(p["x"]) == len(p["y"]) == 2 * p["n"] for p in part)
    coded, plain = rs.RankedTest.of_parts([(p["xs"], p["ys"], p["x"], p["y"], p["n"]) for p in part]), rs.RankedTest(x, y)
    assert coded.pair_of_row.dtype == np.uint16 and (coded.pair_of_row == plain.pair_of_row).all()
    assert [coded.trend(5, b) for b in range(1, 9)] == [plain.trend(5, b) for b in range(1, 9)]
    assert rs.ROWS > 360 * 40_000  # rows of the largest test of 360 x sf0.1, which were shuffled by replicate


def test_rows_of_one_hash_go_by_id():
    batch = pa.RecordBatch.from_pydict({"__t": [0] * 4, "__bucket": [0] * 4, "__h": [7, 5, 7, 7], "__id": ["c", "z", "a", "b"], "__x": [1.0, 2.0, 3.0, 4.0], "__y": [0.0] * 4})
    (p,) = next(rs.coded_parts(iter([batch]))).to_pylist()
    assert np.frombuffer(p["xs"])[rs.codes(p["x"], p["n"])].tolist() == [2.0, 3.0, 4.0, 1.0]


def test_clusters_are_summed_where_they_lie(spark, rows, monkeypatch):
    keys, means = ["cell_type", "signature"], {(t, g): 51.0 for t in "PQ" for g in "ab"}
    d, x, _ = glm.indicator_columns(rows.where("cell_type <> 'R'").coalesce(1).sortWithinPartitions("subject_id"), ["sex"])
    direct = glm._cluster_sums(d.select(*keys, "subject_id", *x, ((F.col("age") - 51) / 10).alias("age_decade"), F.lit(1.0).alias("__a"), F.lit(1.0).alias("__f"),
                                        F.col("score").alias("__r")), keys, ["subject_id"], [*x, "age_decade"])
    flat = lambda df: sorted([r.cell_type, r.signature, r.n, round(r.rho, 6), round(r.q, 6), *np.round([*r.xx, *r.xs, *r.xr], 6).tolist()] for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # subjects have 8 rows
    try:
        out = glm.cluster_sums_in_place(d, keys, "subject_id", "score", x, "age", means)
        assert flat(out) == flat(direct) and len(flat(out)) == 240
        assert "Exchange hashpartitioning" not in plan_of(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_support_and_earliest_rows_need_no_shuffle_of_rows(spark, rows):
    packed = at.by_subject(rows, ["cell_type", "signature"], None, "score")
    assert packed.count() == 60
    support = at.support_table(packed.select("subject_id", F.inline("__rows")), ["cell_type", "signature"], None, "score")
    got = {(r.cell_type, r.signature): (r.n_donors, r.n_donors_detected, r.n_subjects, r.n_subjects_detected) for r in support.collect()}
    assert got == {**{(t, g): (120, 120, 60, 60) for t in "PQ" for g in "ab"}, ("R", "a"): (2, 2, 2, 2)}
    plan = plan_of(support)
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
    single = at.earliest_rows(packed, ["cell_type", "signature"], support.where("n_donors > 2").select("cell_type", "signature"))
    assert "Exchange" not in plan_of(single)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("array_min")  # once a subject, not once a row
    known = rows.where("cell_type <> 'R'")
    want = known.join(at.earliest_samples(known, "subject_id", "sample_unit_id", "age"), "sample_unit_id", "left_semi")
    flat = lambda df: sorted((r.sample_unit_id, r.cell_type, r.signature) for r in df.collect())
    assert flat(single) == flat(want) and len(flat(single)) == 240


def test_rows_go_by_subject_and_are_written_once(spark, rows, monkeypatch):
    written = []
    plain = at.keep
    monkeypatch.setattr(at, "keep", lambda df, label: written.append(label) or plain(df, label))
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    out = {(r.cell_type, r.signature): r for r in at.associations(rows, ["cell_type", "signature"], "score", family="gaussian", covariates=["sex"], n_boot=50).collect()}
    assert set(out) == {(t, g) for t in "PQ" for g in "ab"}
    assert not {"tested", "residuals"} & set(written) and written.count("rows") == 1
    known = rows.where("cell_type <> 'R'")
    gee = {(r.cell_type, r.signature): r for r in at.subject_gee(known, ["cell_type", "signature"], "score", ["sex"], family="gaussian", weight=None).collect()}
    for key, r in out.items():
        assert r.association_effect_per_10y == pytest.approx(gee[key].effect_per_10y, rel=1e-8)
        assert r.association_standard_error == pytest.approx(gee[key].standard_error, rel=1e-8)
        assert (r.n_donors, r.n_subjects, r.sensitivity_n_subjects, r.sensitivity_status) == (120, 60, 60, "completed")


def test_folded_ranks_correlate_as_rows_do(spark, rows):
    keys = ["cell_type", "signature"]
    folded = rows.groupBy(*keys, "age", "score").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.cell_type, r.signature): r.rho for r in folded_spearman(folded, keys, "age", "score", "n", "rho").collect()}
    want = {(r.cell_type, r.signature): r.rho for r in spearman(rows, keys, "age", "score", "rho").collect()}
    assert got == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()} and got["R", "a"] is None


def test_set_means_are_those_of_the_scores_and_unfold_last(spark):
    cells, counts, genes, sets = b.cells_b(spark, FOLDER), b.counts_b(spark, FOLDER), b.genes_b(spark, FOLDER), gene_sets(spark, FOLDER)
    keys = ["subject_id", "sample_unit_id", "cell_type"]
    got = q_models.signature_rows(spark, FOLDER)
    want = cells.join(signature_scores(cells.select("cell_id"), counts, genes, sets), "cell_id").groupBy(*keys, "signature").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("score").alias("score"), F.min("age").alias("age"), F.min("sex").alias("sex"), F.min("batch").alias("batch"))
    flat = lambda df: {(r.sample_unit_id, r.cell_type, r.signature): r for r in df.collect()}
    a, z = flat(got), flat(want)
    assert a.keys() == z.keys() and len(a) > 100
    for key, r in z.items():
        assert (a[key].n_cells, a[key].age, a[key].sex, a[key].batch, a[key].subject_id) == (r.n_cells, r.age, r.sex, r.batch, r.subject_id)
        assert a[key].score == pytest.approx(r.score, rel=1e-12, abs=1e-15)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = [line for line in plan[:next(k for k, line in enumerate(plan) if "Generate inline" in line)]]
    assert not any("Join" in line or "Aggregate" in line for line in top)
