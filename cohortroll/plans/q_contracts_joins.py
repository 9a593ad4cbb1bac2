"""Contracts and joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.operators import contracts as c
from cohortroll.operators import joins as j
from cohortroll.operators.ordering import sorted_position
from cohortroll.operators.rollup import group_means, profile_table
from cohortroll.plans import bindings as b
from cohortroll.plans.registry import query

# Every seventh user gets a second sex and batch, so the contracts have something to find.
SPOILED_SQL = f"""{b.CELLS_A}, spoiled AS (SELECT * REPLACE (
  CASE WHEN cell_id % 7 = 0 AND substring(subject_id, 2)::INTEGER % 7 = 0 THEN 'X' ELSE sex END AS sex,
  CASE WHEN cell_id % 50 = 0 THEN NULL ELSE batch END AS batch) FROM cells)"""


def spoiled(spark, folder):
    cells = b.cells_a(spark, folder)
    seventh = (F.col("cell_id") % 7 == 0) & (F.substring("subject_id", 2, 20).cast("int") % 7 == 0)
    return cells.withColumn("sex", F.when(seventh, "X").otherwise(F.col("sex"))).withColumn(
        "batch", F.when(F.col("cell_id") % 50 != 0, F.col("batch")))


@query("replicate_covariate_contract", f"""WITH {SPOILED_SQL},
 lv AS (SELECT sample_unit_id, count(DISTINCT coalesce(sex, '~')) AS sex,
  count(DISTINCT coalesce(batch, '~')) AS batch FROM spoiled GROUP BY 1)
 SELECT 'missing' AS problem, 'batch' AS attribute, '' AS example,
  count(*) FILTER (batch IS NULL) AS n FROM spoiled
 UNION ALL SELECT 'inconsistent', 'sex', min(sample_unit_id), count(*) FROM lv WHERE sex > 1
 UNION ALL SELECT 'inconsistent', 'batch', min(sample_unit_id), count(*) FROM lv WHERE batch > 1""")
def replicate_covariate_contract(spark, folder):
    return c.replicate_covariate_violations(spoiled(spark, folder), "sample_unit_id", ["sex", "batch"])


@query("sample_maps_to_one_subject", f"""WITH {b.CELLS_A} SELECT 'B' || substring(sample_unit_id,
 instr(sample_unit_id, 'W')) AS week_key, 'subject_id' AS attribute, count(DISTINCT subject_id) AS n_levels
 FROM cells GROUP BY 1 HAVING count(DISTINCT subject_id) > 1""")
def sample_maps_to_one_subject(spark, folder):
    cells = b.cells_a(spark, folder).withColumn("week_key", F.concat(
        F.lit("B"), F.regexp_extract("sample_unit_id", "(W.*)$", 1)))
    return c.inconsistent_attributes(cells, "week_key", ["subject_id"])


@query("sample_rule_contract", f"""WITH {b.CELLS_A}, s AS (SELECT CASE WHEN cell_id % 401 = 0 THEN '  ' WHEN cell_id % 307 = 0 THEN NULL ELSE subject_id END AS
 subject_id, CASE WHEN cell_id % 503 = 0 THEN '' ELSE sample_unit_id END AS sample_unit_id, CASE WHEN cell_id % 211 = 0 THEN 'nan'::DOUBLE WHEN cell_id % 199 = 0
 THEN NULL WHEN cell_id % 97 = 0 THEN age + 1 ELSE age END AS age FROM cells), k AS (SELECT sample_unit_id, count(DISTINCT subject_id) > 1 AS cs, count(DISTINCT
 age) > 1 AS ca FROM s WHERE trim(sample_unit_id) <> '' GROUP BY 1), p AS (SELECT 'missing_subject' AS problem, count(*) FILTER (subject_id IS NULL OR
 trim(subject_id) = '') AS n FROM s UNION ALL SELECT 'missing_sample', count(*) FILTER (sample_unit_id IS NULL OR trim(sample_unit_id) = '') FROM s UNION ALL
 SELECT 'missing_age', count(*) FILTER (age IS NULL OR isnan(age)) FROM s UNION ALL SELECT 'conflicting_subject', count(*) FILTER (cs) FROM k UNION ALL SELECT
 'conflicting_age', count(*) FILTER (ca) FROM k) SELECT * FROM p WHERE n > 0""")
def sample_rule_contract(spark, folder):
    """Blank and missing subjects and samples, unknown ages and clashing values, planted into the cells."""
    i = F.col("cell_id")
    spoiled = b.cells_a(spark, folder).select(
        F.when(i % 401 == 0, "  ").when(i % 307 == 0, F.lit(None)).otherwise(F.col("subject_id")).alias("subject_id"),
        F.when(i % 503 == 0, "").otherwise(F.col("sample_unit_id")).alias("sample_unit_id"),
        F.when(i % 211 == 0, float("nan")).when(i % 199 == 0, F.lit(None)).when(i % 97 == 0, F.col("age") + 1).otherwise(F.col("age")).alias("age"))
    return c.sample_rule_violations(spoiled)


@query("sample_metadata_contract", f"""WITH {SPOILED_SQL},
 lv AS (SELECT sample_unit_id AS unit, count(DISTINCT sex) AS sex,
  count(DISTINCT coalesce(batch, '~')) AS batch FROM spoiled GROUP BY 1),
 md AS (SELECT sample_unit_id, min(subject_id) AS subject_id, min(sex) AS sex, min(batch) AS batch
  FROM spoiled GROUP BY 1)
 SELECT 'inconsistent_in_sample' AS problem, unit, 'sex' AS attribute FROM lv WHERE sex > 1
 UNION ALL SELECT 'inconsistent_in_sample', unit, 'batch' FROM lv WHERE batch > 1
 UNION ALL SELECT 'missing', sample_unit_id, 'batch' FROM md WHERE batch IS NULL
 UNION ALL SELECT 'inconsistent_in_subject', subject_id, 'sex' FROM md GROUP BY subject_id
  HAVING count(DISTINCT sex) > 1""")
def sample_metadata_contract(spark, folder):
    return c.sample_metadata_violations(spoiled(spark, folder))


@query("sample_metadata", f"""WITH {b.CELLS_B} SELECT sample_unit_id, min(subject_id) AS subject_id,
 min(age) AS age, min(sex) AS sex, min(batch) AS batch, round(min(age) / 10, 6) AS age_decade
 FROM cells GROUP BY 1""")
def sample_metadata(spark, folder):
    return b.rounded(c.sample_metadata(b.cells_b(spark, folder)))


@query("label_metadata_completeness", f"""WITH {SPOILED_SQL}, l AS (SELECT *, CASE WHEN cell_id % 3 > 0
  THEN cell_type END AS lab FROM spoiled) SELECT count(*) AS n_cells,
 count(*) FILTER (lab IS NOT NULL AND batch IS NOT NULL AND sex IS NOT NULL) AS n_eligible,
 count(*) FILTER (lab IS NULL) AS n_excluded_null_label,
 count(*) FILTER (sex IS NULL) AS n_missing_sex, count(*) FILTER (batch IS NULL) AS n_missing_batch FROM l""")
def label_metadata_completeness(spark, folder):
    cells = spoiled(spark, folder).withColumn("lab", F.when(F.col("cell_id") % 3 > 0, F.col("cell_type")))
    return c.label_metadata_completeness(cells, ["sex", "batch"], "lab")


@query("count_validity", """SELECT count(*) AS n_entries,
 count(*) FILTER (v IS NULL) AS n_non_finite, count(*) FILTER (v < 0) AS n_negative,
 count(*) FILTER (abs(v - round(v)) > 1e-6) AS n_fractional FROM (SELECT CASE
  WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 101 = 1 THEN -l_quantity
  WHEN l_orderkey % 101 = 2 THEN l_quantity + 0.25 ELSE l_quantity END AS v FROM lineitem)""")
def count_validity(spark, folder):
    k, q = F.col("l_orderkey") % 101, F.col("l_quantity")
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, -q).when(k == 2, q + 0.25).otherwise(q)
    lines = b.table(spark, folder, "lineitem").select(v.alias("count"))
    return c.count_violations(lines)


MAPPING_SQL = """mapping AS (SELECT DISTINCT event_type AS raw_label, CASE event_type WHEN 'error' THEN
  'unresolved' WHEN 'signup' THEN 'exploratory' ELSE 'primary' END AS disposition, CASE WHEN event_type
  NOT IN ('error', 'signup') THEN upper(event_type) || ' cells' END AS analysis_label, 'by rule' AS
  rationale, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'approved' END AS review_status,
  'v1' AS mapping_version FROM events)"""


def mapping(spark, folder):
    """Label mapping derived from the labels seen in the events."""
    raw = F.col("raw_label")
    return b.table(spark, folder, "events").select(F.col("event_type").alias("raw_label")).distinct().select(
        raw, F.when(raw == "error", "unresolved").when(raw == "signup", "exploratory")
        .otherwise("primary").alias("disposition"),
        F.when(~raw.isin("error", "signup"), F.concat(F.upper(raw), F.lit(" cells"))).alias("analysis_label"),
        F.lit("by rule").alias("rationale"),
        F.when(raw == "view", "pending").otherwise("approved").alias("review_status"),
        F.lit("v1").alias("mapping_version"))


def raw_cells(spark, folder):
    return b.cells_a(spark, folder).withColumnRenamed("cell_type", "raw_label")


@query("label_mapping_contract", f"""WITH {MAPPING_SQL}, m AS (SELECT * REPLACE (
  CASE WHEN raw_label = 'click' THEN NULL ELSE analysis_label END AS analysis_label,
  CASE WHEN raw_label = 'view' THEN ' ' ELSE rationale END AS rationale,
  CASE WHEN raw_label = 'error' THEN 'v2' ELSE mapping_version END AS mapping_version) FROM mapping
  WHERE raw_label <> 'signup')
 SELECT 'missing_rationale' AS problem, raw_label AS label FROM m WHERE trim(rationale) = ''
 UNION ALL SELECT 'primary_without_analysis_label', raw_label FROM m WHERE disposition = 'primary'
  AND analysis_label IS NULL
 UNION ALL SELECT DISTINCT 'observed_but_unmapped', event_type FROM events WHERE event_type NOT IN
  (SELECT raw_label FROM m)
 UNION ALL SELECT 'several_versions', count(DISTINCT mapping_version)::VARCHAR FROM m""")
def label_mapping_contract(spark, folder):
    raw = F.col("raw_label")
    m = mapping(spark, folder).where(raw != "signup").withColumns({
        "analysis_label": F.when(raw != "click", F.col("analysis_label")),
        "rationale": F.when(raw == "view", " ").otherwise(F.col("rationale")),
        "mapping_version": F.when(raw == "error", "v2").otherwise(F.col("mapping_version"))})
    return c.mapping_violations(m, raw_cells(spark, folder))


@query("mapping_approval", f"""WITH {MAPPING_SQL} SELECT coalesce(bool_and(review_status = 'approved'), false)
 AS approved, count(*) AS n_rows FROM mapping""")
def mapping_approval(spark, folder):
    return c.mapping_is_approved(mapping(spark, folder))


LABELLED_SQL = f"""{b.CELLS_A}, {MAPPING_SQL}, labelled AS (SELECT cells.* EXCLUDE (cell_type),
  cells.cell_type AS raw_label, disposition, CASE WHEN disposition = 'primary' THEN analysis_label END
  AS analysis_label FROM cells LEFT JOIN mapping ON raw_label = cells.cell_type)"""


@query("analysis_labels_attached", f"""WITH {LABELLED_SQL} SELECT cell_id, raw_label, disposition,
 analysis_label FROM labelled""")
def analysis_labels_attached(spark, folder):
    out = j.attach_analysis_labels(raw_cells(spark, folder), mapping(spark, folder))
    return out.select("cell_id", "raw_label", "disposition", "analysis_label")


@query("denominator_labels", f"""WITH {LABELLED_SQL} SELECT CASE WHEN disposition = 'primary' THEN
 analysis_label ELSE 'Other/unresolved' END AS cell_type, disposition <> 'primary' AS denominator_only,
 count(*) AS n_cells FROM labelled GROUP BY ALL""")
def denominator_labels(spark, folder):
    cells = j.attach_analysis_labels(raw_cells(spark, folder), mapping(spark, folder))
    return c.denominator_label(cells, "analysis_label", "disposition").groupBy(
        "cell_type", "denominator_only").agg(F.count(F.lit(1)).alias("n_cells"))


@query("validated_metadata_join", """SELECT d.doc_id, d.lang, l.quality, l.doc_id IS NOT NULL AS
 metadata_matched FROM documents d LEFT JOIN labels l USING (doc_id)""")
def validated_metadata_join(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "lang")
    labels = b.table(spark, folder, "labels").select("doc_id", "quality")
    return j.many_to_one_left(docs, labels, "doc_id", allow_unmatched=True)


@query("metadata_duplicates_and_conflicts", """WITH m AS (SELECT DISTINCT user_id, event_type,
  user_id % 5 AS v FROM events UNION ALL SELECT user_id, event_type, user_id % 5 FROM events)
 SELECT user_id, count(*) AS n FROM (SELECT DISTINCT * FROM m) GROUP BY 1 HAVING count(*) > 1""")
def metadata_duplicates_and_conflicts(spark, folder):
    m = b.table(spark, folder, "events").select("user_id", "event_type", (F.col("user_id") % 5).alias("v"))
    return j.conflicting_keys(m.unionByName(m), "user_id")


@query("coalesced_metadata", """WITH m AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE
  d.doc_id % 2 END::VARCHAR AS base, l.quality::VARCHAR AS ext FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT doc_id, coalesce(ext, base) AS quality, CASE WHEN ext IS NOT NULL THEN 'external' WHEN base IS NOT
 NULL THEN 'original' ELSE 'missing' END AS quality_source, coalesce(ext <> base, false) AS quality_conflict
 FROM m""")
def coalesced_metadata(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", F.when(
        F.col("doc_id") % 4 != 0, F.col("doc_id") % 2).cast("string").alias("base"))
    labels = b.table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("ext"))
    out = j.coalesce_prefer_right(docs.join(labels, "doc_id", "left"), "quality", "base", "ext")
    return out.drop("base", "ext")


@query("unit_mapping_attached", f"""WITH {b.CELLS_A} SELECT cell_id, sample_unit_id, subject_id,
 true AS unit_matched FROM cells""")
def unit_mapping_attached(spark, folder):
    cells = b.cells_a(spark, folder)
    units = cells.select("cell_id", "sample_unit_id", F.concat("subject_id", F.lit(" ")).alias("subject_id"))
    return j.attach_units(cells.select("cell_id"), units, ["sample_unit_id", "subject_id"])


@query("unit_mapping_cover", """SELECT doc_id, 'left_only' AS side FROM documents ANTI JOIN labels USING (doc_id)
 UNION ALL SELECT doc_id, 'right_only' FROM labels ANTI JOIN documents USING (doc_id)""")
def unit_mapping_cover(spark, folder):
    return j.cover_differences(b.table(spark, folder, "documents"), b.table(spark, folder, "labels"), "doc_id")


@query("aligned_unit_mapping", f"""WITH {b.CELLS_B} SELECT row_number() OVER (ORDER BY cell_id) AS position,
 cell_id, sample_unit_id FROM cells""")
def aligned_unit_mapping(spark, folder):
    cells = sorted_position(b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("cell_id")), ["cell_id"])
    units = b.cells_b(spark, folder).select("cell_id", "sample_unit_id")
    return j.many_to_one_left(cells, units, "cell_id").drop("metadata_matched")


@query("external_replicate_lookup", """SELECT d.source, count(*) AS n_docs, count(l.doc_id) AS n_matched,
 count(DISTINCT l.quality) AS n_levels FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def external_replicate_lookup(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "source")
    ids = j.collapse_exact_duplicates(b.table(spark, folder, "labels").select("doc_id", "quality"))
    c.enforce(j.duplicate_keys(ids, ["doc_id"]), "external ids per document")
    return docs.join(ids, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_matched"),
        F.count_distinct("quality").alias("n_levels"))


@query("cell_metadata_one_to_one", """SELECT doc_id, source, quality, toxic FROM documents JOIN labels
 USING (doc_id)""")
def cell_metadata_one_to_one(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "source")
    labels = b.table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    c.enforce(j.duplicate_keys(docs, ["doc_id"]), "documents key")
    out = j.many_to_one_left(docs, labels, "doc_id", allow_unmatched=True)
    return out.where("metadata_matched").drop("metadata_matched")


@query("profile_attributes", f"""WITH {b.CELLS_A}, p AS (SELECT sample_unit_id, cell_type, count(*) AS n_cells,
  count(DISTINCT library) AS n_technical_libraries FROM cells GROUP BY ALL), m AS (SELECT sample_unit_id,
  min(subject_id) AS subject_id, min(age) AS age, min(sex) AS sex, min(batch) AS batch FROM cells GROUP BY 1)
 SELECT sample_unit_id, cell_type, n_cells, n_technical_libraries, subject_id, round(age, 8) AS age, sex, batch,
  round(age / 10, 8) AS age_decade FROM p LEFT JOIN m USING (sample_unit_id)""")
def profile_attributes(spark, folder):
    cells = b.cells_a(spark, folder)
    return b.rounded(j.many_to_one_left(profile_table(cells), c.sample_metadata(cells), "sample_unit_id")
                     .drop("metadata_matched"), 8)


@query("group_profiles_with_units", f"""WITH {b.CELLS_B}, g AS (SELECT sample_unit_id, cell_type, count(*) AS
  n_cells, avg(value) AS value FROM cells GROUP BY ALL HAVING count(*) >= 2) SELECT g.sample_unit_id, cell_type,
 n_cells, round(g.value, 4) AS value, sex FROM g JOIN (SELECT DISTINCT sample_unit_id, sex FROM cells) u
 ON u.sample_unit_id = g.sample_unit_id""")
def group_profiles_with_units(spark, folder):
    cells = b.cells_b(spark, folder)
    groups = group_means(cells, ["sample_unit_id", "cell_type"], ["value"], [], 2)
    units = c.sample_metadata(cells).select("sample_unit_id", "sex")
    return b.rounded(groups.select("sample_unit_id", "cell_type", "n_cells", "value")
                     .join(units, "sample_unit_id"), 4)


@query("cells_in_supported_samples", f"""WITH {b.CELLS_A} SELECT cell_id FROM cells WHERE sample_unit_id IN
 (SELECT sample_unit_id FROM cells GROUP BY 1 HAVING count(*) >= 15)""")
def cells_in_supported_samples(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "sample_unit_id")
    enough = cells.groupBy("sample_unit_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")
    return cells.join(enough, "sample_unit_id", "left_semi").select("cell_id")


@query("documents_without_labels", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def documents_without_labels(spark, folder):
    return b.table(spark, folder, "documents").select("doc_id", "lang").join(
        b.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query("profile_codes", f"""WITH {b.CELLS_A}, p AS (SELECT cell_type, sample_unit_id, row_number() OVER
  (ORDER BY cell_type, sample_unit_id) - 1 AS code FROM cells GROUP BY cell_type, sample_unit_id HAVING count(*) >= 3)
 SELECT cell_id, coalesce(code, -1)::BIGINT AS profile_code FROM cells LEFT JOIN p
 ON p.cell_type = cells.cell_type AND p.sample_unit_id = cells.sample_unit_id""")
def profile_codes(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "cell_type", "sample_unit_id")
    profiles = cells.groupBy("cell_type", "sample_unit_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    codes = sorted_position(profiles, ["cell_type", "sample_unit_id"]).select(
        "cell_type", "sample_unit_id", (F.col("position") - 1).alias("code"))
    return cells.join(codes, ["cell_type", "sample_unit_id"], "left").select(
        "cell_id", F.coalesce("code", F.lit(-1).cast("bigint")).alias("profile_code"))


def result_sets(spark, folder):
    """Two result sets per (part, return flag), rounded so that signs do not hang on the last bit."""
    lines = b.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("gene_id"), F.col("l_returnflag").alias("cell_type"),
        "l_linestatus", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    rolled = lines.groupBy("gene_id", "cell_type", "l_linestatus").agg(
        F.round(F.avg("d") - 5, 6).alias("effect"), F.round(F.avg("t") * 0.012, 6).alias("fdr"))
    return [rolled.where(F.col("l_linestatus") == v).drop("l_linestatus") for v in ("F", "O")]


RESULTS_SQL = """rolled AS (SELECT l_partkey AS gene_id, l_returnflag AS cell_type, l_linestatus,
  round(avg(l_discount * 100) - 5, 6) AS effect, round(avg(l_tax * 100) * 0.012, 6) AS fdr FROM lineitem
  GROUP BY ALL), old AS (SELECT * FROM rolled WHERE l_linestatus = 'F'),
 new AS (SELECT * FROM rolled WHERE l_linestatus = 'O')"""


@query("result_set_comparison", f"""WITH {RESULTS_SQL}, m AS (SELECT gene_id, cell_type, o.effect AS pe,
  o.fdr AS pf, n.effect AS ce, n.fdr AS cf FROM old o FULL JOIN new n USING (gene_id, cell_type))
 SELECT gene_id, cell_type, pe AS provisional_effect, pf AS provisional_fdr, ce AS corrected_effect,
 cf AS corrected_fdr, coalesce(pf < 0.05, false) AS provisional_supported, coalesce(cf < 0.05, false) AS
 corrected_supported, CASE WHEN pe IS NULL THEN 'newly_testable' WHEN ce IS NULL THEN 'no_longer_testable'
  WHEN pf < 0.05 AND cf >= 0.05 THEN 'lost_support' WHEN pf >= 0.05 AND cf < 0.05 THEN 'newly_supported'
  WHEN sign(pe) <> sign(ce) THEN 'direction_changed' ELSE 'stable_direction' END AS comparison_status,
 round(ce - pe, 6) AS effect_change FROM m""")
def result_set_comparison(spark, folder):
    old, new = result_sets(spark, folder)
    return b.rounded(j.compare_results(old, new, ["gene_id", "cell_type"]))


@query("result_status_lookup", f"""WITH {RESULTS_SQL}, c AS (SELECT gene_id, cell_type FROM old JOIN new
  USING (gene_id, cell_type) WHERE sign(old.effect) = sign(new.effect))
 SELECT p_partkey AS gene_id, count(c.cell_type) AS n_same_direction FROM part LEFT JOIN c
 ON c.gene_id = p_partkey GROUP BY 1""")
def result_status_lookup(spark, folder):
    old, new = result_sets(spark, folder)
    cmp = j.compare_results(old, new, ["gene_id", "cell_type"]).where(
        F.signum("provisional_effect") == F.signum("corrected_effect"))
    parts = b.table(spark, folder, "part").select(F.col("p_partkey").alias("gene_id"))
    return parts.join(cmp.select("gene_id", "cell_type"), "gene_id", "left").groupBy("gene_id").agg(
        F.count("cell_type").alias("n_same_direction"))


@query("result_status_by_key", """WITH k AS (SELECT l_linestatus AS analysis, l_returnflag AS cell_type, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE
 'S' || l_suppkey % 5 END AS signature, l_quantity, l_discount FROM lineitem), q AS (SELECT analysis, cell_type, signature, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT
 analysis, cell_type, trim(coalesce(signature, '')) AS sig, CASE WHEN l_quantity > 49 THEN 'reviewed' WHEN cell_type = 'N' AND l_discount > 0.09 THEN NULL ELSE
 'supported' END AS status FROM k WHERE signature IS DISTINCT FROM 'S2' AND (l_quantity > 49 OR cell_type <> 'A')), s AS (SELECT analysis, cell_type, sig, CASE
 WHEN count(DISTINCT status) = 1 AND count(status) = count(*) THEN min(status) ELSE 'conflicting' END AS status FROM r GROUP BY ALL) SELECT q.*,
 coalesce(s.status, 'absent') AS status FROM q LEFT JOIN s ON s.analysis = q.analysis AND s.cell_type = q.cell_type AND s.sig = trim(coalesce(q.signature, ''))""")
def result_status_by_key(spark, folder):
    """Statuses by analysis, type and signature; signatures are partly null and partly blank."""
    k = b.table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("analysis"), F.col("l_returnflag").alias("cell_type"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).when(F.col("l_linenumber") % 4 == 1, " ").otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 5)).alias("signature"),
        "l_quantity", "l_discount")
    keys = ["analysis", "cell_type", "signature"]
    some = k.where(~F.col("signature").eqNullSafe("S2") & ((F.col("l_quantity") > 49) | (F.col("cell_type") != "A")))
    results = some.withColumn("status", F.when(F.col("l_quantity") > 49, "reviewed").when(
        (F.col("cell_type") == "N") & (F.col("l_discount") > 0.09), F.lit(None)).otherwise("supported"))
    return j.status_by_key(k.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), results, keys)


@query("model_metric_comparison", """WITH m AS (SELECT l_shipdate < TIMESTAMP '1998-06-01' AS early,
  l_returnflag || l_linestatus || (l_suppkey % 40) AS model, round(avg(l_quantity), 6) AS mae FROM lineitem
  WHERE NOT (l_shipdate < TIMESTAMP '1998-06-01' AND l_suppkey % 40 = 3) GROUP BY ALL)
 SELECT model, a.mae AS provisional_value, b.mae AS corrected_value, CASE WHEN a.mae IS NOT NULL AND b.mae IS
 NOT NULL THEN 'comparable' ELSE 'model_set_changed' END AS comparison_status, round(b.mae - a.mae, 6) AS
 value_change FROM (SELECT * FROM m WHERE early) a FULL JOIN (SELECT * FROM m WHERE NOT early) b USING (model)""")
def model_metric_comparison(spark, folder):
    lines = b.table(spark, folder, "lineitem").withColumn(
        "early", F.col("l_shipdate") < F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))
    lines = lines.where(~(F.col("early") & (F.col("l_suppkey") % 40 == 3)))
    m = lines.groupBy("early", F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey") % 40).alias("model")
                      ).agg(F.round(F.avg("l_quantity"), 6).alias("mae"))
    return b.rounded(j.compare_metrics(m.where("early"), m.where("not early"), ["model"], "mae"))


@query("reviewed_mapping", f"""WITH {MAPPING_SQL} SELECT raw_label, CASE WHEN raw_label = 'signup' THEN
 'primary' ELSE disposition END AS disposition, CASE WHEN raw_label = 'error' THEN NULL ELSE analysis_label END
 AS analysis_label, CASE WHEN raw_label = 'click' THEN 'pending' ELSE 'approved' END AS review_status,
 CASE WHEN raw_label = 'error' THEN rationale ELSE 'reviewed' END AS rationale,
 CASE raw_label WHEN 'error' THEN 'label_not_reviewed' WHEN 'click' THEN 'not_approved' WHEN 'signup' THEN
  'primary_without_analysis_label' ELSE '' END AS problem FROM mapping""")
def reviewed_mapping(spark, folder):
    m = mapping(spark, folder)
    raw = F.col("raw_label")
    review = m.where(raw != "error").select(
        raw, F.when(raw == "signup", "primary").otherwise(F.col("disposition")).alias("disposition"),
        "analysis_label", F.when(raw == "click", "pending").otherwise("approved").alias("review_status"),
        F.lit("reviewed").alias("rationale"))
    return j.apply_review(m, review)


@query("key_set_equality", """SELECT 'documents_vs_labels' AS pair, (SELECT count(*) FROM (SELECT doc_id FROM
 documents EXCEPT SELECT doc_id FROM labels)) AS n_left_only, (SELECT count(*) FROM (SELECT doc_id FROM labels
 EXCEPT SELECT doc_id FROM documents)) AS n_right_only""")
def key_set_equality(spark, folder):
    diff = j.cover_differences(b.table(spark, folder, "documents"), b.table(spark, folder, "labels"), "doc_id")
    return diff.agg(F.count_if(F.col("side") == "left_only").alias("n_left_only"),
                    F.count_if(F.col("side") == "right_only").alias("n_right_only")).withColumn(
        "pair", F.lit("documents_vs_labels"))


@query("key_intersection", """SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT
 SELECT user_id FROM events WHERE event_type = 'error' AND value > 60""")
def key_intersection(spark, folder):
    events = b.table(spark, folder, "events").select("user_id", "event_type", "value")
    return events.where("event_type = 'signup'").select("user_id").intersect(
        events.where("event_type = 'error' and value > 60").select("user_id"))


@query("structural_zero_grid", f"""WITH {b.CELLS_B}, t AS (SELECT sample_unit_id, count(*) AS total_cells FROM
  cells GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT DISTINCT raw_label AS cell_type FROM cells), n AS (SELECT
  sample_unit_id, raw_label AS cell_type, count(*) AS n_cells FROM cells GROUP BY ALL)
 SELECT t.sample_unit_id, k.cell_type, total_cells, coalesce(n_cells, 0) AS n_cells FROM t CROSS JOIN k LEFT JOIN
 n ON n.sample_unit_id = t.sample_unit_id AND n.cell_type = k.cell_type""")
def structural_zero_grid(spark, folder):
    cells = b.cells_b(spark, folder).select("sample_unit_id", F.col("raw_label").alias("cell_type"))
    counts = cells.groupBy("sample_unit_id", "cell_type").agg(F.count(F.lit(1)).alias("n_cells"))
    totals = counts.groupBy("sample_unit_id").agg(F.sum("n_cells").alias("total_cells")).where("total_cells >= 2")
    return j.structural_zero_grid(totals, counts, "sample_unit_id", counts)
