"""Data-quality gates: one aggregate per table, unfolded into check rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import is_present
from cohortroll.operators.contracts import checks_from
from cohortroll.operators.ordering import bh_fdr
from cohortroll.operators.rollup import reasons


def checkpoint_checks(cells: DataFrame, vectors: DataFrame, required: Sequence[str], *, id_col: str = "cell_id",
                      width: int = 64, expected_cells: int | None = None) -> DataFrame:
    """Columns complete and non-blank, ages numeric, ids unique, vectors finite and of one width."""
    blank = [F.count_if(~is_present(c)).alias(f"blank_{c}") for c in required if c in cells.columns]
    one = cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("age").try_cast("double").isNull()).alias("bad_age"),
                    *blank)
    repeats = cells.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).agg(
        F.count_if(F.col("k") > 1).alias("r")).scalar()
    # Size and finiteness in one fold; NaN or infinity makes the sum of x - x non-zero.
    bad_vec = vectors.agg(F.count_if((F.size("vec") != width) | ~vector_is_finite("vec")).alias("b")).scalar()
    uncovered = cells.select(id_col).join(vectors.select(id_col), id_col, "left_anti").agg(
        F.count(F.lit(1)).alias("u")).scalar()
    one = one.withColumn("repeats", repeats).withColumn("bad_vec", bad_vec).withColumn("uncovered", uncovered)
    have = [c for c in required if c in cells.columns]
    checks = {"required_columns_present": (F.lit(len(have) == len(required)), F.lit(str(len(have))), "error")}
    checks |= {f"complete_{c}": (F.col(f"blank_{c}") == 0, F.col(f"blank_{c}"), "error") for c in have}
    checks |= {
        "age_numeric": (F.col("bad_age") == 0, F.col("bad_age"), "error"),
        "ids_unique": (F.col("repeats") == 0, F.col("repeats"), "error"),
        "vectors_valid": (F.col("bad_vec") == 0, F.col("bad_vec"), "error"),
        "vectors_cover_cells": (F.col("uncovered") == 0, F.col("uncovered"), "warning"),
    }
    if expected_cells is not None:
        checks["cell_count"] = (F.col("n") == expected_cells, F.col("n"), "error")
    return checks_from(one, checks)


def vector_is_finite(vec: str) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def provenance_checks(actual: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per expected field: present, and equal to the expected value. ``actual`` has a map ``m``."""
    items = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("expected")) for k, v in sorted(expected.items())])
    value = F.try_element_at("m", F.col("field"))
    return actual.select("*", F.inline(items)).select(
        *[c for c in actual.columns if c != "m"], "field", "expected", value.alias("actual"),
        value.isNotNull().alias("present"), F.coalesce(value == F.col("expected"), F.lit(False)).alias("equal"))


def identity_gate(before: DataFrame, after: DataFrame, width: int) -> DataFrame:
    """Same ids at the same positions, vectors valid, labels complete. Inputs: position, cell_id, vec, label."""
    j = before.select("position", F.col("cell_id").alias("a")).join(
        after.select("position", F.col("cell_id").alias("b"), "vec", "label"), "position", "full")
    one = j.agg(
        F.count("a").alias("n_before"), F.count("b").alias("n_after"),
        F.count_if(~F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("moved"),
        F.count_if(F.col("vec").isNotNull() & ((F.size("vec") != width) | ~vector_is_finite("vec"))).alias("bad_vec"),
        F.count_if(F.col("b").isNotNull() & F.col("label").isNull()).alias("no_label"))
    return checks_from(one, {
        "same_shape": (F.col("n_before") == F.col("n_after"), F.col("n_after"), "error"),
        "same_ids_same_order": (F.col("moved") == 0, F.col("moved"), "error"),
        "vectors_finite": (F.col("bad_vec") == 0, F.col("bad_vec"), "error"),
        "labels_complete": (F.col("no_label") == 0, F.col("no_label"), "error")})


def identity_fingerprint(ids: DataFrame, position: str, id_col: str) -> DataFrame:
    """SHA-256 over ids in order. Positions are cut into fixed blocks that hash on their own; the
    block hashes are folded in blocks again until one is left, so no list grows with the table.
    Positions run from 1 without gaps. An empty table has the hash of the empty text."""
    block = 4096
    left = ids.agg(F.max(position).alias("n")).first()["n"] or 0
    level = ids.select(F.col(position).cast("bigint").alias("p"), F.col(id_col).cast("string").alias("v"))
    folded = False
    while left > 1 or not folded:
        folded, left = True, -(-left // block)
        packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]), "\n")
        level = level.groupBy(F.floor((F.col("p") - 1) / block).alias("g")).agg(F.sha2(packed, 256).alias("v")).select(
            (F.col("g") + 1).alias("p"), "v")
    return level.agg(F.coalesce(F.max("v"), F.sha2(F.lit("").cast("binary"), 256)).alias("fingerprint"))  # one row at most


def result_checks(results: DataFrame, manifest: DataFrame, eligible: DataFrame, keys: Sequence[str], *,
                  p: str = "p_value", within: str = "fdr_within", overall: str = "fdr_global",
                  tolerance: float = 1e-9) -> DataFrame:
    """Expression results: unique keys, eligible types, finite values, probabilities, recomputed BH, row counts."""
    n = F.count(F.lit(1))

    def bad(c):
        return F.col(c).isNull() | F.isnan(c)

    redo = bh_fdr(results, p, {"__within": ["cell_type"], "__global": []})
    one = redo.agg(
        n.alias("n"), F.count_if(bad(p) | bad("effect")).alias("non_finite"),
        F.count_if((F.col(p) < 0) | (F.col(p) > 1)).alias("outside"),
        F.count_if(F.abs(F.col(within) - F.col("__within")) > tolerance).alias("off_within"),
        F.count_if(F.abs(F.col(overall) - F.col("__global")) > tolerance).alias("off_global"))
    repeats = results.groupBy(*keys).agg(n.alias("k")).agg(F.count_if(F.col("k") > 1).alias("r")).scalar()
    stray = results.join(eligible, "cell_type", "left_anti").agg(n.alias("s")).scalar()
    counts = results.groupBy("cell_type").agg(n.alias("n_rows")).join(
        manifest.select("cell_type", F.col("n_rows").alias("listed")), "cell_type", "full")
    off = counts.agg(F.count_if(~F.coalesce(F.col("n_rows") == F.col("listed"), F.lit(False))).alias("o")).scalar()
    one = one.withColumn("repeats", repeats).withColumn("stray", stray).withColumn("off", off)
    return checks_from(one, {
        "keys_unique": (F.col("repeats") == 0, F.col("repeats"), "error"),
        "types_eligible": (F.col("stray") == 0, F.col("stray"), "error"),
        "values_finite": (F.col("non_finite") == 0, F.col("non_finite"), "error"),
        "probabilities_in_range": (F.col("outside") == 0, F.col("outside"), "error"),
        "fdr_within_recomputed": (F.col("off_within") == 0, F.col("off_within"), "error"),
        "fdr_global_recomputed": (F.col("off_global") == 0, F.col("off_global"), "error"),
        "manifest_row_counts": (F.col("off") == 0, F.col("off"), "error")})


def result_set_checks(fractions: DataFrame, folds: DataFrame, *, sample: str = "sample_unit_id",
                      expected_cells: int | Column, expected_samples: int | Column) -> DataFrame:
    """Grid complete, fractions sum to one, counts reconcile, no subject in two folds."""
    per = fractions.groupBy(sample).agg(
        F.count(F.lit(1)).alias("types"), F.sum("fraction").alias("f"), F.sum("n_cells").alias("c"),
        F.max("total_cells").alias("t"))
    kinds = fractions.select("cell_type").distinct().agg(F.count(F.lit(1)).alias("k")).scalar()
    one = per.withColumn("k", kinds).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("types") != F.col("k")).alias("gaps"),
        F.count_if(F.abs(F.col("f") - 1) > 1e-9).alias("off_sum"), F.count_if(F.col("c") != F.col("t")).alias("off_count"),
        F.sum("c").alias("n_cells"))
    leaks = folds.groupBy("subject_id").agg(F.count_distinct("fold").alias("k")).agg(
        F.count_if(F.col("k") > 1).alias("l")).scalar()
    one = one.withColumn("leaks", leaks)
    return checks_from(one, {
        "grid_complete": (F.col("gaps") == 0, F.col("gaps"), "error"),
        "fractions_sum_to_one": (F.col("off_sum") == 0, F.col("off_sum"), "error"),
        "counts_reconcile": (F.col("off_count") == 0, F.col("off_count"), "error"),
        "expected_cells": (F.col("n_cells") == expected_cells, F.col("n_cells"), "warning"),
        "expected_samples": (F.col("n_samples") == expected_samples, F.col("n_samples"), "warning"),
        "no_subject_in_two_folds": (F.col("leaks") == 0, F.col("leaks"), "error")})


def feasibility(scan: DataFrame, design: DataFrame) -> DataFrame:
    """Blockers from the matrix scan and the design summary, and the size of a dense copy in GiB."""
    one = scan.select(F.struct("*").alias("m")).withColumn(
        "d", design.select(F.struct("*").alias("d")).scalar())
    m, d = F.col("m"), F.col("d")
    return one.select(
        m["n_entries"].alias("n_entries"), m["total_count"].alias("total_count"),
        reasons((m["n_negative"] > 0, "negative_counts"), (m["n_fractional"] > 0, "fractional_counts"),
                (m["n_non_finite"] > 0, "non_finite_counts"), (m["n_unknown_gene"] > 0, "unknown_genes"),
                (m["n_zero_library_cells"] > 0, "zero_library_cells"), (d["n_subjects"] < 12, "too_few_subjects"),
                (d["n_repeated"] < 1, "no_repeated_subjects")).alias("blockers"),
        (d["n_cells"] * d["n_genes"] * 8 / float(1 << 30)).alias("dense_gib"))


def review_order(mapping: DataFrame, evidence: DataFrame) -> DataFrame:
    """Labels in the order a reviewer should see them: disposition, then size, then name.

    The mapping is a dimension with one row per label.
    """
    # Fixed value: reading order of the dispositions.
    order = F.array(*[F.lit(v) for v in ("primary", "exploratory", "unresolved", "exclude")])
    rows = mapping.join(evidence, "raw_label", "left").withColumn("d", F.array_position(order, F.col("disposition")))
    slot = F.struct(F.col("d"), -F.coalesce("n_cells", F.lit(0)), F.col("raw_label"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(slot.alias("o"), F.struct(*[
        F.col(c) for c in ("raw_label", "disposition", "n_cells")]).alias("r")))).alias("a"))
    return listed.select(F.posexplode("a").alias("i", "x")).select(
        (F.col("i") + 1).alias("review_order"), "x.r.*")
