"""Refits work on counts folded by design: the same numbers as from every profile and gene, without making that grid."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortroll.operators import expression as ex
from cohortroll.operators.glm import FOLDED, fit_folded_counts, fit_grouped, indicator_columns
from cohortroll.operators.stats import age_terms


def same(got, want, rel=1e-7):
    assert got.keys() == want.keys()
    for name, value in want.items():
        if isinstance(value, (float, list)):
            assert got[name] == pytest.approx(value, rel=rel, abs=1e-10), name
        else:
            assert got[name] == value, name


@pytest.mark.parametrize("holed", [False, True])
def test_folded_fit_is_that_of_its_rows(spark, holed):
    rng = np.random.default_rng(4)
    n = 2000
    pdf = pd.DataFrame({"t": np.arange(n) % 2, "id": np.arange(n), "x0": 1.0, "a": (np.arange(n) % 3 == 0) * 1.0, "x": rng.integers(0, 9, n) / 4.0, "e": rng.uniform(0.5, 2, n)})
    pdf["y"] = rng.poisson(pdf.e * np.exp(0.3 + 0.4 * pdf.a + 0.5 * pdf.x)).astype(float)
    rows = spark.createDataFrame(pdf).withColumn("o", F.log("e"))
    if holed:
        rows = rows.withColumn("a", F.when(F.col("id") != 2, F.col("a")))
    sums = dict(zip(FOLDED, ("1.0", "e", "e * e", "y", "y * y", "y * e", "y * y / e")))
    folded = rows.groupBy("t", "x0", "a", "x").agg(*[F.expr(f"sum({v})").alias(k) for k, v in sums.items()])
    got = [r.asDict() for r in fit_folded_counts(folded, ["t"], ["x0", "a", "x"], [[1]]).orderBy("t").collect()]
    want = [r.asDict() for r in fit_grouped(rows, ["t"], "y", ["x0", "a", "x"], ["id"], family="poisson", offset="o", groups=[[1]], single=True).orderBy("t").collect()]
    assert [r["status"] == "completed" for r in got] == [not holed, True]
    for g, w in zip(got, want):
        if w["status"] == "completed":
            same(g, w)
        else:
            assert g["status"] == w["status"]


def inputs(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{i}", "PQ"[i % 2], f"S{i // 2}", 30.0 + i % 11, "FM"[i % 4 // 2], f"b{i % 3}", 2 + i % 3, 100.0 + i, 1.0 + i % 5 / 10) for i in range(120)]
    d = spark.createDataFrame(rows, "profile_id string, cell_type string, subject_id string, age double, sex string, batch string, n_cells long, library_size double, norm_factor double")
    counts = [(f"p{i}", g, int(v)) for i in range(120) for g in range(6) if (v := rng.poisson(3 + g + (i % 11) * (g == 0) / 3)) and (i + g) % 5]
    sums = spark.createDataFrame(counts, "profile_id string, gene_id long, count long")
    genes = spark.createDataFrame([("PQ"[k], g) for k in range(2) for g in range(5 + k)], "cell_type string, gene_id long")
    typed = sums.join(d.select("profile_id", "cell_type"), "profile_id").join(genes, ["cell_type", "gene_id"], "left_semi").select(*sums.columns)
    d, x, groups = indicator_columns(age_terms(d, ["cell_type"]), ["sex", "batch"])
    return d, typed, genes, [*x, "age_decade"], groups


def test_refits_are_those_of_the_whole_grid(spark):
    d, sums, genes, x, groups = inputs(spark)
    keys, cols = ["cell_type", "gene_id"], [[x[i] for i in g] for g in groups]
    dense = ex.log_cpm(ex.dense_counts(d, sums, genes)).cache()
    folded = ex.folded_counts(d, sums, genes, x, 3)
    known = lambda df, by: {tuple(r[k] for k in by): {c: v for c, v in r.asDict().items() if c != "p_value"} for r in df.collect()}
    got, want = (known(f, keys) for f in (ex.folded_quasi_poisson(folded, keys, x, groups), ex.quasi_poisson(dense, keys, x, groups)))
    assert got.keys() == want.keys() and len(got) == 11
    for key in want:
        same(got[key], want[key], 1e-6)
    some = genes.where("gene_id < 3")
    rows = ex.robustness_scenarios(dense.join(some, keys, "left_semi"), 3, d)
    for use, names in (("use_sex", cols[0]), ("use_batch", cols[1])):
        rows = rows.withColumns({c: F.when(F.col(use), F.col(c)).otherwise(0.0) for c in names})
    by = [*keys, "scenario_id"]
    got = known(ex.scenario_models(folded, d, 3, some, x, groups, *cols), by)
    want = known(ex.quasi_poisson(age_terms(rows.drop("age_decade"), by), by, x, groups), by)
    assert got.keys() == want.keys() and len(got) == 6 * 6
    for key in want:
        same(got[key], want[key], 1e-6)


def test_profiles_fold_before_genes_unfold(spark):
    d, sums, genes, x, _ = inputs(spark)
    many = d.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("profile_id", F.concat_ws("-", "profile_id", "copy")).drop("copy")
    counts = sums.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("profile_id", F.concat_ws("-", "profile_id", "copy")).drop("copy")
    one, all_ = ex.folded_counts(d, sums, genes, x, 3), ex.folded_counts(many, counts, genes, x, 3)
    assert one.count() == all_.count() <= 120 * 6  # the rows are designs, however many profiles have them
    total = lambda df: df.agg(*[F.sum(c) for c in FOLDED]).first()
    assert list(total(all_)) == pytest.approx([40 * v for v in total(one)], rel=1e-9)
    empty = ex.folded_counts(d.withColumn("n_cells", F.lit(None).cast("long")), sums.limit(0), genes, x, 3)
    assert empty.where("n_cells is not null or y > 0").count() == 0 and total(empty)[0] == total(one)[0]


def test_profiles_and_counts_do_not_gather_by_type(spark, monkeypatch):
    d, sums, genes, x, _ = inputs(spark)
    written = []
    plain = ex.keep
    monkeypatch.setattr(ex, "keep", lambda df, label: written.append(label) or plain(df, label))
    least = ex.design_sample_size(d, x)
    ex.expressed_genes(d, sums, plain(least, "least")).collect()
    ex.tmm_factors(d, sums).collect()
    assert {"inverses", "cutoffs", "references", "reference-counts"} <= set(written)
    least.collect()
    plan = least._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
