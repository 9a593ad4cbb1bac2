import pytest
from pyspark.sql import functions as F

from cohortroll.operators import contracts as c
from cohortroll.operators import joins as j
from cohortroll.operators.ordering import average_rank, bh_fdr, earliest_per_group, order_bucket, running_counts, sorted_position
from cohortroll.operators.rollup import sample_fractions
from cohortroll.plans.q_gates import METHODS


def test_structural_zeros_and_fractions(spark):
    cells = spark.createDataFrame(
        [("u7", "p", 41, "K")] * 3 + [("u8", "q", 63, "K"), ("u9", "q", 64, "L")] + [("u9", "q", 64, "M")] * 4,
        "sample_unit_id string, subject_id string, age int, cell_type string")
    rows = {(r.sample_unit_id, r.cell_type): r for r in sample_fractions(cells, min_cells=1).collect()}
    assert len(rows) == 9  # three samples by three types
    assert {k for k, r in rows.items() if r.n_cells == 0} == {("u7", "L"), ("u7", "M"), ("u8", "L"), ("u8", "M"), ("u9", "K")}
    assert rows["u8", "L"].fraction == 0 and rows["u9", "M"].fraction == pytest.approx(0.8) and rows["u7", "K"].fraction == 1


def test_denominator_keeps_nonprimary_cells(spark):
    cells = spark.createDataFrame([("CD4 T cells", "primary"), ("x", "exploratory"), (None, "unresolved")],
                                  "analysis_label string, disposition string")
    got = sorted(r.cell_type for r in c.denominator_label(cells, "analysis_label", "disposition").collect())
    assert got == ["CD4 T cells", "Other/unresolved", "Other/unresolved"]


def test_bh_matches_known_values_and_skips_missing(spark):
    # Four p values and their adjusted values.
    bad = [None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.002), *enumerate(bad, 4)], "i int, p double")
    got = {r.i: r.fdr for r in bh_fdr(df, "p").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.008])
    assert [got[i] for i in range(4, 8)] == [None] * 4


def test_ranks_and_quantiles_take_any_number(spark):
    values = [float("-inf"), -2.5, 0.0, 0.0, 7.0, float("inf"), float("nan"), float("nan"), None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("g", F.lit("all"))
    got = {r.i: r.k for r in average_rank(df, "v", ["g"], "k").collect()}
    assert [got[i] for i in range(9)] == [1, 2, 3.5, 3.5, 5, 6, 7.5, 7.5, None]
    counts = {r.n_total for r in running_counts(df, "v", ["g"]).collect()}
    assert counts == {8}


def test_order_bucket_is_monotone(spark):
    values = sorted([0.0, -3.5, -1.0, 1e-300, 0.25, 0.49999999999999994, 0.5, 0.5000000001, 1.0, 3.0, 7.999999999999999, 8.0, 1e12])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    b = [r.b for r in df.select("v", order_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert b == sorted(b)


def test_earliest_sample_rule(spark):
    rows = [("x", "w3", 44.5), ("x", "w1", 44.5), ("x", "w2", 47.0), ("y", "w9", None), ("y", "w8", 29.0), ("y", "w7", float("nan")),
            ("z", "w5", None), ("z", "w4", None), ("v", None, 18.0), ("v", "w6", 18.0)]
    df = spark.createDataFrame(rows, "subject_id string, sample_unit_id string, age double")
    got = {r.subject_id: (r.sample_unit_id, r.age) for r in earliest_per_group(df, ["subject_id"], ["age", "sample_unit_id"]).collect()}
    assert got == {"x": ("w1", 44.5), "y": ("w8", 29.0), "z": ("w4", None), "v": ("w6", 18.0)}


def test_sorted_position_is_dense(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("v"))
    rows = sorted_position(df, ["v"]).collect()
    assert all(r.position == r.v + 1 for r in rows)


def test_metadata_join_contract(spark):
    left = spark.createDataFrame([("k3",), ("k1",), ("k2",), ("k1",)], "cell_id string")
    right = spark.createDataFrame([("k2", 19)] * 3 + [("k1", 77), ("k3", 51), ("k9", 60)], "cell_id string, age int")
    clean = j.collapse_exact_duplicates(right)
    got = sorted((r.cell_id, r.age, r.metadata_matched) for r in j.many_to_one_left(left, clean, "cell_id").collect())
    assert got == [("k1", 77, True), ("k1", 77, True), ("k2", 19, True), ("k3", 51, True)]
    clash = spark.createDataFrame([("k2", 19), ("k2", 20), ("k1", 77), ("k3", 51)], "cell_id string, age int")
    assert j.conflicting_keys(clash, "cell_id").count() == 1
    with pytest.raises(c.ContractError):
        j.many_to_one_left(left, clash, "cell_id")
    with pytest.raises(c.ContractError):
        j.many_to_one_left(left, clean.where("age > 50"), "cell_id")


def test_unit_mapping_reports_missing_rows(spark):
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    units = spark.createDataFrame([("c1", "s", "t")], "cell_id string, subject_id string, sample_unit_id string")
    with pytest.raises(c.ContractError):
        j.attach_units(cells, units, ["subject_id", "sample_unit_id"])


def test_covariate_and_metadata_contracts(spark):
    df = spark.createDataFrame([("t1", "d", 30, "F", "b1"), ("t1", "d", 31, "F", None), ("t2", "d", 40, "M", "b1")],
                               "sample_unit_id string, subject_id string, age int, sex string, batch string")
    bad = {(r.problem, r.attribute) for r in c.replicate_covariate_violations(df, "sample_unit_id", ["age", "batch"]).collect()}
    assert bad == {("missing", "batch"), ("inconsistent", "age"), ("inconsistent", "batch")}
    meta = {(r.problem, r.attribute) for r in c.sample_metadata_violations(df).collect()}
    assert ("inconsistent_in_sample", "age") in meta and ("inconsistent_in_subject", "sex") in meta
    with pytest.raises(c.ContractError):
        c.enforce(c.sample_metadata_violations(df), "samples")


def test_count_validity(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (-1.0,), (float("nan"),)], "count double")
    r = c.count_violations(df).first()
    assert (r.n_non_finite, r.n_negative, r.n_fractional) == (1, 1, 1)


def test_mapping_attaches_only_primary(spark):
    m = spark.createDataFrame([("A", "primary", "T cells"), ("B", "exploratory", "x")], "raw_label string, disposition string, analysis_label string")
    cells = spark.createDataFrame([("A",), ("B",), ("C",)], "raw_label string")
    got = {r.raw_label: r.analysis_label for r in j.attach_analysis_labels(cells, m).collect()}
    assert got == {"A": "T cells", "B": None, "C": None}


def test_method_list_is_unique():
    assert len({m for m, _, _ in METHODS}) == len(METHODS)


def test_fingerprint_folds_until_one_block_is_left(spark):
    from hashlib import sha256

    from cohortroll.operators.gates import identity_fingerprint

    def by_hand(values):
        while True:
            values = [sha256("\n".join(values[k:k + 4096]).encode()).hexdigest() for k in range(0, max(len(values), 1), 4096)]
            if len(values) == 1:
                return values[0]

    for n in (0, 1, 4096, 4097, 9000):
        ids = spark.range(1, n + 1).select(F.col("id").alias("p"), F.concat(F.lit("c"), "id").alias("v"))
        assert identity_fingerprint(ids, "p", "v").first()[0] == by_hand([f"c{k}" for k in range(1, n + 1)])


def test_kept_tables_are_released_by_their_owner(spark):
    import os

    from cohortroll.session import KEPT, keep, release_kept

    table = keep(spark.range(5), "mine")
    path = KEPT[-1].removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    assert release_kept(spark) >= 1 and not os.path.exists(path) and not KEPT


def test_sample_rule_contract(spark):
    rows = [("s", "u1", 40.0), ("s", "u1", 40.0), (" ", "u2", 41.0), (None, "u3", None), ("t", "", float("nan")), ("s", "u4", 50.0), ("t", "u4", 51.0)]
    df = spark.createDataFrame(rows, "subject_id string, sample_unit_id string, age double")
    got = {r.problem: r.n for r in c.sample_rule_violations(df).collect()}
    assert got == {"missing_subject": 2, "missing_sample": 1, "missing_age": 2, "conflicting_subject": 1, "conflicting_age": 1}
    assert c.sample_rule_violations(df.limit(0)).count() == 0


def test_fractions_read_the_cells_once(spark, tmp_path):
    cells = spark.createDataFrame([(f"u{k % 7}", "p", 41, "KLM"[k % 3]) for k in range(40)], "sample_unit_id string, subject_id string, age int, cell_type string")
    cells.write.parquet(str(tmp_path / "given-cells"))
    out = sample_fractions(spark.read.parquet(str(tmp_path / "given-cells")), min_cells=1)
    assert out.count() == 21
    assert "given-cells" not in out._jdf.queryExecution().toString()  # all that follows reads the written counts
