"""Data-quality gates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.operators import gates as g
from cohortroll.operators import qc
from cohortroll.operators.eligibility import method_eligibility_table, pseudobulk_eligibility_table
from cohortroll.operators.contracts import overall
from cohortroll.operators.ordering import bh_fdr, sorted_position
from cohortroll.operators.rollup import label_evidence, marker_summary, reasons
from cohortroll.operators.sampling import grouped_folds
from cohortroll.plans import bindings as b
from cohortroll.plans.q_contracts_joins import MAPPING_SQL, mapping, spoiled, SPOILED_SQL
from cohortroll.plans.q_models import FRACTIONS_SQL, fractions
from cohortroll.plans.q_review import SENS_SQL, evidence_inputs
from cohortroll.plans.registry import query
from cohortroll.session import keep

REQUIRED = ["cell_type", "sample_unit_id", "sex", "batch"]

VEC_CHECK_SQL = """(SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS bad_vec, (SELECT count(*) FROM events ANTI JOIN
 embeddings ON vec_id = event_id) AS uncovered"""


@query("checkpoint_audit", f"""WITH {SPOILED_SQL}, o AS (SELECT count(*) FILTER (batch IS NULL) AS nb, {VEC_CHECK_SQL} FROM spoiled)
 SELECT 'required_columns_present' AS name, true AS passed, 'error' AS severity, '4' AS detail UNION ALL
 SELECT 'complete_cell_type', true, 'error', '0' UNION ALL SELECT 'complete_sample_unit_id', true, 'error', '0' UNION ALL
 SELECT 'complete_sex', true, 'error', '0' UNION ALL SELECT 'complete_batch', nb = 0, 'error', nb::VARCHAR FROM o UNION ALL
 SELECT 'age_numeric', true, 'error', '0' UNION ALL SELECT 'ids_unique', true, 'error', '0' UNION ALL
 SELECT 'vectors_valid', bad_vec = 0, 'error', bad_vec::VARCHAR FROM o UNION ALL
 SELECT 'vectors_cover_cells', uncovered = 0, 'warning', uncovered::VARCHAR FROM o""")
def checkpoint_audit(spark, folder):
    vecs = b.vectors(spark, folder).select("cell_id", "vec")
    return g.checkpoint_checks(spoiled(spark, folder), vecs, REQUIRED)


@query("checkpoint_audit_verdict", f"""WITH {SPOILED_SQL} SELECT count(*) FILTER (batch IS NULL) = 0 AS passed,
 (count(*) FILTER (batch IS NULL) > 0)::BIGINT AS n_failed_errors, 9::BIGINT AS n_checks FROM spoiled""")
def checkpoint_audit_verdict(spark, folder):
    return overall(checkpoint_audit(spark, folder))


@query("provenance_check", """SELECT event_id, f.field, f.expected, CASE f.field WHEN 'kind' THEN event_type WHEN 'user' THEN
 user_id::VARCHAR END AS actual, f.field <> 'missing' AS present, coalesce(CASE f.field WHEN 'kind' THEN event_type WHEN 'user' THEN
 user_id::VARCHAR END = f.expected, false) AS equal FROM events, (VALUES ('kind', 'click'), ('user', '7'), ('missing', 'x')) f(field, expected)""")
def provenance_check(spark, folder):
    e = b.table(spark, folder, "events").select("event_id", F.create_map(
        F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("m"))
    return g.provenance_checks(e, {"kind": "click", "user": "7", "missing": "x"})


@query("identity_gate", """WITH o AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 100 = 99) AS moved, count(*) FILTER (vec_id % 50 = 0)
 AS no_label FROM embeddings) SELECT 'same_shape' AS name, true AS passed, 'error' AS severity, n::VARCHAR AS detail FROM o UNION ALL
 SELECT 'same_ids_same_order', moved = 0, 'error', moved::VARCHAR FROM o UNION ALL SELECT 'vectors_finite', true, 'error', '0' UNION ALL
 SELECT 'labels_complete', no_label = 0, 'error', no_label::VARCHAR FROM o""")
def identity_gate(spark, folder):
    v = b.table(spark, folder, "embeddings")
    numbered = sorted_position(v.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("vec"), "label"), ["cell_id"])
    i = F.col("cell_id")
    after = numbered.withColumn("label", F.when(i % 50 != 0, F.col("label"))).withColumn(
        "cell_id", F.when(i % 100 == 99, -i).otherwise(i))
    return g.identity_gate(numbered, after, 64)


@query("identity_fingerprint", """WITH b1 AS (SELECT (pos - 1) // 4096 AS blk, sha256(string_agg(event_id::VARCHAR, chr(10) ORDER BY pos))
 AS h FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) GROUP BY 1), b2 AS (SELECT blk // 4096 AS blk,
 sha256(string_agg(h, chr(10) ORDER BY blk)) AS h FROM b1 GROUP BY 1), b3 AS (SELECT blk // 4096 AS blk, sha256(string_agg(h, chr(10)
 ORDER BY blk)) AS h FROM b2 GROUP BY 1), n AS (SELECT (SELECT count(*) FROM b1) AS n1, (SELECT count(*) FROM b2) AS n2) SELECT CASE WHEN n1 = 0 THEN
 sha256('') WHEN n1 = 1 THEN (SELECT max(h) FROM b1) WHEN n2 = 1 THEN (SELECT max(h) FROM b2) ELSE (SELECT max(h) FROM b3) END AS fingerprint FROM n""")
def identity_fingerprint(spark, folder):
    ids = sorted_position(b.table(spark, folder, "events").select("event_id"), ["event_id"])
    return g.identity_fingerprint(ids, "position", "event_id")


def expression_results(spark, folder):
    primary, _ = evidence_inputs(spark, folder)
    # The fdr column doubles as a p value here, held inside [0, 1].
    res = primary.select("gene_id", "cell_type", "effect", F.col("fdr").alias("p_value"))
    return keep(bh_fdr(res, "p_value", {"fdr_within": ["cell_type"], "fdr_global": []}), "results")


@query("expression_result_checks", f"""WITH {SENS_SQL}, o AS (SELECT count(*) FILTER (cell_type = 'R') AS stray FROM prim) SELECT
 'keys_unique' AS name, true AS passed, 'error' AS severity, '0' AS detail UNION ALL SELECT 'types_eligible', stray = 0, 'error',
 stray::VARCHAR FROM o UNION ALL SELECT unnest(['values_finite', 'probabilities_in_range', 'fdr_within_recomputed',
 'fdr_global_recomputed']), true, 'error', '0' UNION ALL SELECT 'manifest_row_counts', false, 'error', '1'""")
def expression_result_checks(spark, folder):
    res = expression_results(spark, folder)
    manifest = res.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_rows", F.when(F.col("cell_type") == "A", F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    eligible = res.select("cell_type").distinct().where("cell_type <> 'R'")
    return g.result_checks(res, manifest, eligible, ["gene_id", "cell_type"])


@query("result_set_checks", f"""WITH {FRACTIONS_SQL}, sp AS (SELECT * FROM fractions WHERE NOT (cell_type = 'purchase' AND subject_id LIKE '%7')), per AS (SELECT
 sample_unit_id, count(*) AS types, sum(fraction) AS f, sum(n_cells) AS c, max(total_cells) AS t FROM sp GROUP BY 1), o AS (SELECT count(*) AS ns, sum(c)::BIGINT AS
 nc, count(*) FILTER (types <> (SELECT count(DISTINCT cell_type) FROM sp)) AS gaps, count(*) FILTER (abs(f - 1) > 1e-9) AS off_sum, count(*) FILTER (c <> t) AS
 off_count FROM per), e AS (SELECT (SELECT count(*) FROM cells) AS nc, (SELECT count(*) FROM totals) AS ns, (SELECT count(DISTINCT subject_id) FROM fractions WHERE
 subject_id LIKE '%3') AS leaks) SELECT 'grid_complete' AS name, gaps = 0 AS passed, 'error' AS severity, gaps::VARCHAR AS detail FROM o UNION ALL SELECT
 'fractions_sum_to_one', off_sum = 0, 'error', off_sum::VARCHAR FROM o UNION ALL SELECT 'counts_reconcile', off_count = 0, 'error', off_count::VARCHAR FROM o UNION
 ALL SELECT 'no_subject_in_two_folds', leaks = 0, 'error', leaks::VARCHAR FROM e UNION ALL SELECT 'expected_cells', o.nc = e.nc, 'warning', o.nc::VARCHAR FROM o, e
 UNION ALL SELECT 'expected_samples', o.ns = e.ns, 'warning', o.ns::VARCHAR FROM o, e""")
def result_set_checks(spark, folder):
    """Planted: types missing from some samples, and some subjects in a second fold."""
    f = fractions(spark, folder)
    folds = grouped_folds(f, "subject_id", 5).select("subject_id", "fold")
    leaked = folds.where("subject_id like '%3'").withColumn("fold", F.lit(99))
    cells = b.cells_a(spark, folder).agg(F.count(F.lit(1)).alias("n")).scalar()
    samples = f.agg(F.count_distinct("sample_unit_id").alias("n")).scalar()
    gappy = f.where("not (cell_type = 'purchase' and subject_id like '%7')")
    return g.result_set_checks(gappy, folds.unionByName(leaked), expected_cells=cells, expected_samples=samples)


@query("feasibility_summary", f"""WITH {b.COUNTS_B}, z AS (SELECT count(*) AS z FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT count(*) AS n_entries, sum(count)::BIGINT AS total_count, CASE WHEN (SELECT z FROM z) > 0 THEN 'zero_library_cells' ELSE '' END AS
 blockers, round((SELECT count(*) FROM orders)::DOUBLE * (SELECT count(*) FROM part) * 8 / (1 << 30), 8) AS dense_gib FROM counts""")
def feasibility_summary(spark, folder):
    cells = b.cells_b(spark, folder)
    genes = b.genes_b(spark, folder).select("gene_id")
    scan = qc.scan_counts(b.counts_b(spark, folder), cells.select("cell_id"), genes)
    per = cells.groupBy("subject_id", "sample_unit_id").agg(F.count(F.lit(1)).alias("n")).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    design = per.agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if(F.col("k") > 1).alias("n_repeated"),
                     F.sum("n").alias("n_cells")).withColumn("n_genes", genes.agg(F.count(F.lit(1)).alias("g")).scalar())
    return b.rounded(g.feasibility(scan, design), 8)


@query("annotation_review_order", f"""WITH {MAPPING_SQL}, n AS (SELECT event_type AS raw_label, count(*) AS n_cells FROM events GROUP BY 1)
 SELECT (row_number() OVER (ORDER BY CASE disposition WHEN 'primary' THEN 1 WHEN 'exploratory' THEN 2 ELSE 3 END, n_cells DESC, raw_label))
 ::INTEGER AS review_order, raw_label, disposition, n_cells FROM mapping JOIN n USING (raw_label)""")
def annotation_review_order(spark, folder):
    n = b.table(spark, folder, "events").groupBy(F.col("event_type").alias("raw_label")).agg(F.count(F.lit(1)).alias("n_cells"))
    return g.review_order(mapping(spark, folder), n)


# Which samples a method uses and the support it asks for.
METHODS = (("composition", True, 8), ("signature", False, 8), ("prediction", False, 5), ("pseudobulk", False, 12))


def qualifying(spark, folder):
    cells = b.cells_b(spark, folder)
    return keep(cells.groupBy("sample_unit_id", "cell_type").agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.min(c).alias(c) for c in ("subject_id", "age", "sex", "batch")]), "profiles")


@query("method_eligibility", f"""WITH {b.CELLS_B}, p AS (SELECT sample_unit_id, cell_type, count(*) AS n_cells, min(subject_id) AS
 subject_id, min(age) AS age, min(sex) AS sex FROM cells GROUP BY ALL), m AS (SELECT * FROM (VALUES ('composition', true, 8),
 ('signature', false, 8), ('prediction', false, 5), ('pseudobulk', false, 12)) t(method, every, need)), j AS (SELECT * FROM p CROSS JOIN m
 WHERE every OR n_cells >= 2) SELECT method, cell_type, count(*) AS n_sample_units, count(DISTINCT subject_id) AS n_subjects,
 round(max(age) - min(age), 6) AS age_span, CASE WHEN count(DISTINCT subject_id) < any_value(need) THEN 'insufficient_subjects' ELSE '' END
 AS exclusion_reasons, count(DISTINCT subject_id) >= any_value(need) AS eligible, (count(DISTINCT sex) + 1)::INTEGER AS design_rank
 FROM j GROUP BY ALL""")
def method_eligibility(spark, folder):
    """Each method contract against each label; composition keeps all samples (structural zeros)."""
    return b.rounded(method_eligibility_table(qualifying(spark, folder), METHODS, min_cells=2))


@query("pseudobulk_eligibility", f"""WITH {b.CELLS_B}, p AS (SELECT sample_unit_id, cell_type, count(*) AS n_cells, min(subject_id) AS
 subject_id, min(age) AS age, min(sex) AS sex, min(batch) AS batch FROM cells GROUP BY ALL), q AS (SELECT * FROM p WHERE n_cells >= 2), t AS (SELECT
 cell_type, count(*) AS n_sample_units_observed, count(DISTINCT subject_id) AS n_subjects_observed FROM p GROUP BY 1), u AS (SELECT
 cell_type, count(*) AS n_sample_units_qualifying, count(DISTINCT subject_id) AS n_subjects_qualifying, max(age) - min(age) AS
 age_span_years, (count(DISTINCT sex) + count(DISTINCT batch))::INTEGER AS design_columns, (count(*) - count(DISTINCT sex) - count(DISTINCT
 batch))::INTEGER AS residual_df FROM q GROUP BY 1), r AS (SELECT cell_type, count(*) AS n_repeated_subjects FROM (SELECT cell_type,
 subject_id FROM q GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
 SELECT cell_type, CASE cell_type WHEN 'F' THEN 'primary' WHEN 'O' THEN 'exploratory' ELSE 'not_approved' END AS analysis_tier,
 n_sample_units_observed, n_subjects_observed, n_sample_units_qualifying, n_subjects_qualifying, age_span_years, design_columns, design_columns AS design_rank,
 residual_df, n_repeated_subjects, CASE cell_type WHEN 'P' THEN 'not_approved_by_analysis_contract' ELSE '' END AS exclusion_reasons, CASE cell_type
 WHEN 'P' THEN 'excluded' ELSE 'included' END AS aggregation_status FROM t JOIN u USING (cell_type) JOIN r USING (cell_type)
 UNION ALL SELECT 'Z', 'primary', 0, 0, 0, 0, NULL, 0, 0, 0, 0, 'configured_cell_type_not_observed', 'excluded'""")
def pseudobulk_eligibility(spark, folder):
    out = pseudobulk_eligibility_table(qualifying(spark, folder), ["F", "Z"], ["O"], min_cells=2, min_samples=12, min_subjects=12)
    return out.drop("estimable")


@query("qualification_bundle", f"""WITH {b.CELLS_B}, {b.COUNTS_B}, {b.GENES_B}, ev AS (SELECT raw_label, count(*) AS n_cells,
 count(DISTINCT subject_id) AS n_subjects, round(median(confidence), 7) AS confidence_median FROM cells GROUP BY 1), x AS (SELECT raw_label,
 max(n / t) AS top_cluster_share FROM (SELECT raw_label, cluster, count(*) AS n, sum(count(*)) OVER (PARTITION BY raw_label) AS t FROM cells GROUP BY raw_label,
 cluster) GROUP BY 1), mk AS (SELECT raw_label, count(*) FILTER (c > 0) AS n_markers_seen FROM (SELECT l.raw_label, g.gene_id, (SELECT count(*) FROM counts JOIN
 cells USING (cell_id) WHERE raw_label = l.raw_label AND gene_id = g.gene_id) AS c FROM (SELECT DISTINCT raw_label FROM cells) l, (SELECT gene_id
 FROM genes WHERE brand = 'Brand#7') g) GROUP BY 1)
 SELECT raw_label, n_cells, n_subjects, confidence_median, round(top_cluster_share, 7) AS top_cluster_share, n_markers_seen, 'pending' AS
 review_status FROM ev JOIN x USING (raw_label) JOIN mk USING (raw_label)""")
def qualification_bundle(spark, folder):
    """Evidence, dominant cluster and marker support joined per label for review."""
    cells = b.cells_b(spark, folder)
    genes = b.genes_b(spark, folder)
    panel = genes.where("brand = 'Brand#7'").select("gene_name", F.lit("LOW").alias("expected_label"))
    ev = label_evidence(cells, "raw_label").select("raw_label", "n_cells", "n_subjects", "confidence_median", F.round(
        "dominant_cluster_share", 7).alias("top_cluster_share"))
    marks = marker_summary(cells, b.counts_b(spark, folder), genes, panel, "raw_label").groupBy("raw_label").agg(
        F.count_if(F.col("detection_fraction") > 0).alias("n_markers_seen"))
    return b.rounded(ev.join(marks, "raw_label").withColumn("review_status", F.lit("pending")), 7)


@query("mapping_review_table", f"""WITH {b.CELLS_A}, {MAPPING_SQL}, ev AS (SELECT cell_type AS raw_label, count(*) AS n_cells, count(DISTINCT
 subject_id) AS n_subjects FROM cells GROUP BY 1), p AS (SELECT cell_type AS raw_label, sample_unit_id, count(*) AS n FROM cells GROUP BY ALL)
 SELECT raw_label, disposition, analysis_label, review_status, n_cells, n_subjects, (SELECT count(*) FROM p WHERE p.raw_label =
 mapping.raw_label) AS n_units_composition, (SELECT count(*) FROM p WHERE p.raw_label = mapping.raw_label AND n >= 3) AS n_units_pseudobulk
 FROM mapping JOIN ev USING (raw_label)""")
def mapping_review_table(spark, folder):
    """Mapping joined one to one with evidence and with one column per method design."""
    cells = b.cells_a(spark, folder).withColumnRenamed("cell_type", "raw_label")
    per = cells.groupBy("raw_label", "sample_unit_id", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    ev = per.groupBy("raw_label").agg(F.sum("n").alias("n_cells"), F.count_distinct("subject_id").alias("n_subjects"))
    items = F.array(F.struct(F.lit("composition").alias("method"), F.lit(1).alias("need")),
                    F.struct(F.lit("pseudobulk").alias("method"), F.lit(3).alias("need")))
    design = per.select("raw_label", "n", F.inline(items)).where(F.col("n") >= F.col("need")).groupBy("raw_label").pivot(
        "method", ["composition", "pseudobulk"]).agg(F.count(F.lit(1))).withColumnsRenamed(
        {"composition": "n_units_composition", "pseudobulk": "n_units_pseudobulk"})
    m = mapping(spark, folder).select("raw_label", "disposition", "analysis_label", "review_status")
    return m.join(ev, "raw_label").join(design, "raw_label", "left")


@query("result_range_validation", """WITH r AS (SELECT l_partkey, CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE avg(l_tax) END AS p FROM lineitem
 GROUP BY 1) SELECT count(*) AS n_rows, count(*) FILTER (p IS NULL) AS n_non_finite, count(*) FILTER (p < 0 OR p > 1) AS n_outside,
 count(*) FILTER (p IS NULL OR p < 0 OR p > 1) = 0 AS passed FROM r""")
def result_range_validation(spark, folder):
    r = b.table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.avg("l_tax").alias("m")).select(
        F.when(F.col("l_partkey") % 97 != 0, F.col("m")).alias("p"))
    bad, outside = F.col("p").isNull() | F.isnan("p"), (F.col("p") < 0) | (F.col("p") > 1)
    return r.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_non_finite"),
                 F.count_if(outside).alias("n_outside"),
                 (F.count_if(bad | F.coalesce(outside, F.lit(False))) == 0).alias("passed"))


@query("run_status", f"""WITH {b.CELLS_B}, p AS (SELECT raw_label, sample_unit_id, min(subject_id) AS subject_id FROM cells GROUP BY ALL), s AS
 (SELECT raw_label, count(*) AS n_units, count(DISTINCT subject_id) AS n_subjects FROM p GROUP BY 1) SELECT raw_label, n_units, n_subjects,
 CASE WHEN n_subjects >= 1320 THEN 'completed' ELSE 'excluded' END AS status, CASE WHEN n_subjects >= 1320 THEN '' ELSE
 'insufficient_subjects' END AS reason FROM s""")
def run_status(spark, folder):
    s = b.cells_b(spark, folder).groupBy("raw_label").agg(
        F.count_distinct("sample_unit_id").alias("n_units"), F.count_distinct("subject_id").alias("n_subjects"))
    why = reasons((F.col("n_subjects") < 1320, "insufficient_subjects"))
    return s.withColumn("reason", why).withColumn(
        "status", F.when(F.col("reason") == "", "completed").otherwise("excluded"))
