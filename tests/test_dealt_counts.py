"""Counts of large tables are dealt to tasks of bounded size, and a layer is chosen without working out the others."""

import pytest

from cohortroll import session
from cohortroll.operators.qc import qc_metrics
from cohortroll.operators.rollup import pseudobulk_sums
from cohortroll.plans import bindings as b
from cohortroll.sources.readers import choose_layer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 200)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_tasks_grow_in_number_with_the_lines_not_in_size(spark, monkeypatch):
    want = rows_of(b.counts_b(spark, FOLDER))
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    counts = b.counts_b(spark, FOLDER)
    lines = b.table(spark, FOLDER, "lineitem").count()
    assert counts.rdd.getNumPartitions() == -(-lines // 200) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows_of(counts) == want
    assert max(counts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 400


def test_roll_ups_by_cell_shuffle_the_dealt_lines_once(spark, small_tasks):
    counts, cells = b.counts_b(spark, FOLDER), b.cells_b(spark, FOLDER)
    for out in (qc_metrics(counts, b.genes_b(spark, FOLDER)), pseudobulk_sums(counts, cells, ["sample_unit_id", "cell_type"])):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        assert plan.count("REPARTITION_BY_NUM") == 1
        assert "hashpartitioning(cell_id" not in plan


@pytest.mark.parametrize("layers, want", [(["X", "counts"], "counts"), (["X", "raw"], "X"), (["raw"], None)])
def test_automatic_layer_leaves_the_others_out(spark, layers, want):
    one = spark.range(3).selectExpr("id AS cell_id", "id + 1 AS count")
    all_ = None
    for name in layers:
        part = one.selectExpr("cell_id", f"count + {len(name)} AS count", f"'{name}' AS layer")
        all_ = part if all_ is None else all_.unionByName(part)
    out = choose_layer(all_, "auto")
    assert out.columns == ["cell_id", "count"]
    assert rows_of(out) == ([] if want is None else [(i, i + 1 + len(want)) for i in range(3)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "scalar-subquery" not in plan


def test_components_read_the_given_counts_once(spark):
    from cohortroll.operators.represent import pca_representation

    reads = spark.sparkContext.accumulator(0)
    counts = [(c, g, 1 + (c * 7 + g * 3) % 11) for c in range(60) for g in range(8) if (c + g * g) % 3]

    def told(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    given = spark.createDataFrame(counts, "cell_id long, gene_id long, count long").coalesce(1).mapInArrow(told, "cell_id long, gene_id long, count long")
    out = pca_representation(given, spark.range(61).selectExpr("id AS cell_id"), 4, 2)
    rows = {r.cell_id: r.vec for r in out.collect()}
    assert reads.value == len(counts) and len(rows) == 61 and len(rows[0]) == 2
    assert rows[60] == [0.0, 0.0]  # a cell without counts
