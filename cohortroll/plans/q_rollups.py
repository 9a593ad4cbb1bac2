"""Roll-ups, audits, windows and ordered reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortroll.functions import scalar as s
from cohortroll.operators import review
from cohortroll.operators import rollup as r
from cohortroll.operators.ordering import average_rank, earliest_per_group, top_per_group
from cohortroll.operators.stats import linear_fit
from cohortroll.plans import bindings as b
from cohortroll.plans.q_contracts_joins import LABELLED_SQL, mapping, raw_cells
from cohortroll.plans.q_models import FRACTIONS_SQL, MIN_CELLS, fractions
from cohortroll.plans.registry import query
from cohortroll.operators.joins import attach_analysis_labels


def mode_sql(rel: str, key: str, col: str, out: str | None = None) -> str:
    return (f"(SELECT {key}, {col} AS {out or col} FROM (SELECT {key}, {col}, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY count(*) DESC, {col}) AS k FROM {rel} WHERE {col} IS NOT NULL GROUP BY {key}, {col}) WHERE k = 1)")


@query("sample_totals", f"""WITH {b.CELLS_A} SELECT t.*, m.cluster, l.library FROM (SELECT sample_unit_id,
  count(*) AS total_cells, round(median(age), 8) AS age, min(subject_id) AS subject_id FROM cells GROUP BY 1
  HAVING count(*) >= 10) t JOIN {mode_sql("cells", "sample_unit_id", "cluster")} m USING (sample_unit_id)
  JOIN {mode_sql("cells", "sample_unit_id", "library")} l USING (sample_unit_id)""")
def sample_totals(spark, folder):
    cells = b.cells_a(spark, folder)
    folded = r.fold(cells, ["sample_unit_id"], "age", "subject_id", "cluster", "library")
    return b.rounded(r.sample_totals(folded, ["sample_unit_id"], ["cluster", "library"], 10), 8)


@query("mode_with_smallest_tie", f"""WITH {b.CELLS_B} SELECT sample_unit_id, coalesce(m.v, 'NA') AS top_label
 FROM (SELECT DISTINCT sample_unit_id FROM cells) LEFT JOIN {mode_sql("(SELECT * FROM cells WHERE raw_label <> 'LOW')",
 "sample_unit_id", "raw_label", "v")} m USING (sample_unit_id)""")
def mode_with_smallest_tie(spark, folder):
    cells = b.cells_b(spark, folder).withColumn(
        "raw_label", F.when(F.col("raw_label") != "LOW", F.col("raw_label")))
    return r.group_mode(cells, ["sample_unit_id"], "raw_label", "top_label")


@query("sample_type_fractions", f"""WITH {FRACTIONS_SQL} SELECT sample_unit_id, cell_type, subject_id, n_cells,
 total_cells, round(age, 8) AS age, round(fraction, 8) AS fraction FROM fractions""")
def sample_type_fractions(spark, folder):
    return b.rounded(r.sample_fractions(b.cells_a(spark, folder), min_cells=MIN_CELLS), 8)


@query("fraction_sum_gate", f"""WITH {FRACTIONS_SQL}, s AS (SELECT sample_unit_id, sum(fraction) AS f FROM
 fractions GROUP BY 1) SELECT count(*) FILTER (abs(f - 1) > 1e-12) AS n_violations, count(*) AS n_samples FROM s""")
def fraction_sum_gate(spark, folder):
    f = fractions(spark, folder)
    bad = r.fraction_sum_violations(f, "sample_unit_id").agg(F.count(F.lit(1)).alias("n")).scalar()
    return f.agg(F.count_distinct("sample_unit_id").alias("n_samples")).withColumn("n_violations", bad)


@query("sample_type_scores", f"""WITH {b.CELLS_A}, g AS (SELECT sample_unit_id, cell_type, sample_unit_id || '|' ||
  cell_type AS gk, * EXCLUDE (sample_unit_id, cell_type) FROM cells)
 SELECT x.*, m.cluster FROM (SELECT sample_unit_id, cell_type, count(*) AS n_cells, round(avg(value), 6) AS value,
  round(avg(k), 6) AS k, round(median(age), 6) AS age, min(subject_id) AS subject_id FROM g GROUP BY 1, 2 HAVING
  count(*) >= 2) x JOIN {mode_sql("g", "gk", "cluster")} m ON m.gk = x.sample_unit_id || '|' || x.cell_type""")
def sample_type_scores(spark, folder):
    return b.rounded(r.group_means(b.cells_a(spark, folder), ["sample_unit_id", "cell_type"],
                                   ["value", "k"], ["cluster"], 2))


SETS_SQL = """sets AS (SELECT p_type || '_set' AS signature, CASE WHEN p_partkey % 2 = 0 THEN upper(g.gene_name)
  ELSE lower(g.gene_name) END AS gene_name FROM part JOIN genes g ON g.gene_id = p_partkey WHERE p_size <= 12
 UNION ALL SELECT p_type || '_set', 'ABSENT' || p_partkey FROM part WHERE p_size = 13)"""


def gene_sets(spark, folder):
    """Gene sets by part type, with mixed case and a few names outside the catalogue."""
    part = b.table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    genes = b.genes_b(spark, folder).select("gene_id", "gene_name")
    name = F.when(F.col("gene_id") % 2 == 0, F.upper("gene_name")).otherwise(F.lower("gene_name"))
    real = part.where("p_size <= 12").join(genes, F.col("gene_id") == F.col("p_partkey"))
    sig = F.concat("p_type", F.lit("_set")).alias("signature")
    return real.select(sig, name.alias("gene_name")).unionByName(part.where("p_size = 13").select(
        sig, F.concat(F.lit("ABSENT"), "p_partkey").alias("gene_name")))


@query("gene_set_coverage", f"""WITH {b.GENES_B}, {SETS_SQL}, j AS (SELECT s.*, EXISTS (SELECT 1 FROM genes g WHERE
  upper(g.gene_name) = upper(s.gene_name)) AS hit FROM sets s)
 SELECT signature, count(*) AS n_genes_requested, count(*) FILTER (hit) AS n_genes_present,
 coalesce(string_agg(gene_name, ';' ORDER BY gene_name) FILTER (hit), '') AS present_genes,
 coalesce(string_agg(gene_name, ';' ORDER BY gene_name) FILTER (NOT hit), '') AS missing_genes FROM j GROUP BY 1""")
def gene_set_coverage(spark, folder):
    return r.signature_coverage(gene_sets(spark, folder), b.genes_b(spark, folder))


SCORES_SQL = f"""{b.COUNTS_B}, {b.GENES_B}, {SETS_SQL}, tot AS (SELECT cell_id, sum(count) AS total FROM counts
  GROUP BY 1), mem AS (SELECT DISTINCT signature, gene_id FROM sets JOIN genes ON upper(genes.gene_name) =
  upper(sets.gene_name)), np AS (SELECT signature, count(*) AS n FROM mem GROUP BY 1 HAVING count(*) >= 3),
 sm AS (SELECT cell_id, signature, sum(ln(1 + count * 10000.0::DOUBLE / total)) AS x FROM counts JOIN mem USING
  (gene_id) JOIN tot USING (cell_id) GROUP BY ALL), scores AS (SELECT o_orderkey AS cell_id, np.signature,
  coalesce(x, 0) / n AS score FROM orders CROSS JOIN np LEFT JOIN sm ON sm.cell_id = o_orderkey AND
  sm.signature = np.signature)"""


def scores(spark, folder):
    return r.signature_scores(b.cells_b(spark, folder).select("cell_id"), b.counts_b(spark, folder),
                              b.genes_b(spark, folder), gene_sets(spark, folder))


@query("gene_set_scores", f"WITH {SCORES_SQL} SELECT cell_id, signature, round(score, 8) AS score FROM scores")
def gene_set_scores(spark, folder):
    return b.rounded(scores(spark, folder), 8)


@query("mean_latent_vectors", f"""WITH {b.VECTORS}, l AS (SELECT sample_unit_id, subject_id, cell_type, i - 1 AS dim,
  vec[i]::DOUBLE AS x FROM vecs, range(1, 65) t(i)), m AS (SELECT sample_unit_id, subject_id, cell_type, dim, avg(x) AS
  m, count(*) AS n FROM l GROUP BY ALL) SELECT sample_unit_id, subject_id, cell_type::BIGINT AS cell_type, n AS n_cells,
 count(*) AS width, round(sum(m), 5) AS vector_sum, round(sum(m * (dim + 1)), 4) AS weighted_sum FROM m GROUP BY ALL""")
def mean_latent_vectors(spark, folder):
    keys = ["sample_unit_id", "subject_id", "cell_type"]
    packed = r.pack_vectors(r.mean_vectors(b.vectors(spark, folder), keys, "vec", 1), keys)
    add = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return packed.select("sample_unit_id", "subject_id", F.col("cell_type").cast("bigint").alias("cell_type"),
                         "n_cells", F.size("vec").cast("bigint").alias("width"),
                         F.round(add, 5).alias("vector_sum"), F.round(weighted, 4).alias("weighted_sum"))


@query("label_value_counts", """SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS fraction,
 round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent, (row_number() OVER (ORDER BY count(*) DESC, source))
 ::INTEGER AS rank FROM documents GROUP BY source""")
def label_value_counts(spark, folder):
    out = r.value_counts(b.table(spark, folder, "documents").select("source"), "source")
    return out.withColumn("fraction", F.round("fraction", 8)).withColumn("percent", F.round("percent", 6))


@query("cluster_label_crosstab", f"""WITH {b.CELLS_A} SELECT cluster, {", ".join(
  f"count(*) FILTER (cell_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view"))}
 FROM cells GROUP BY 1""")
def cluster_label_crosstab(spark, folder):
    return b.cells_a(spark, folder).groupBy("cluster").pivot("cell_type").count().fillna(0)


@query("cluster_label_crosstab_long", f"""WITH {LABELLED_SQL}, x AS (SELECT 'raw' AS label_level, cluster, raw_label AS
  label FROM labelled UNION ALL SELECT 'analysis', cluster, analysis_label FROM labelled WHERE analysis_label IS NOT NULL)
 SELECT label_level, cluster, label, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (PARTITION BY label_level,
 cluster), 8) AS fraction_within_cluster FROM x GROUP BY label_level, cluster, label""")
def cluster_label_crosstab_long(spark, folder):
    cells = attach_analysis_labels(raw_cells(spark, folder), mapping(spark, folder))
    raw = r.crosstab_long(cells, "cluster", "raw_label", "raw")
    fine = r.crosstab_long(cells.where("analysis_label is not null"), "cluster", "analysis_label", "analysis")
    return b.rounded(raw.unionByName(fine), 8)


@query("pseudobulk_sums", f"""WITH {b.CELLS_B}, {b.COUNTS_B} SELECT sample_unit_id, cell_type, gene_id,
 sum(count)::BIGINT AS count FROM counts JOIN cells USING (cell_id) GROUP BY ALL""")
def pseudobulk_sums(spark, folder):
    return r.pseudobulk_sums(b.counts_b(spark, folder), b.cells_b(spark, folder), ["sample_unit_id", "cell_type"])


@query("pseudobulk_conservation", """SELECT sum(l_quantity)::BIGINT AS profile_total, sum(l_quantity)::BIGINT AS
 cell_total, true AS conserved FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def pseudobulk_conservation(spark, folder):
    counts, cells = b.counts_b(spark, folder, "brand"), b.cells_b(spark, folder)
    sums = r.pseudobulk_sums(counts, cells, ["sample_unit_id", "cell_type"])
    return r.conservation(counts, cells, sums)


@query("profile_table", f"""WITH {b.CELLS_B} SELECT sample_unit_id, cell_type, count(*) AS n_cells,
 count(DISTINCT library) AS n_technical_libraries FROM cells GROUP BY ALL""")
def profile_table(spark, folder):
    return r.profile_table(b.cells_b(spark, folder))


@query("sample_audit", f"""WITH {b.CELLS_A} SELECT sample_unit_id, count(*) AS n_cells, round(min(age), 8) AS age_min,
 round(max(age), 8) AS age_max, round(median(age), 8) AS age_median, count(DISTINCT subject_id) AS n_subjects,
 count(DISTINCT age) AS n_ages, count(DISTINCT sex) AS n_sexes, count(DISTINCT batch) AS n_batches,
 count(DISTINCT library) AS n_libraries FROM cells GROUP BY 1""")
def sample_audit(spark, folder):
    f = r.fold(b.cells_a(spark, folder), ["sample_unit_id"], "age", "subject_id", "sex", "batch", "library")
    base = f.groupBy("sample_unit_id").agg(
        F.sum("n").alias("n_cells"), F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        *[F.count_distinct(c).alias(n) for c, n in (
            ("subject_id", "n_subjects"), ("age", "n_ages"), ("sex", "n_sexes"), ("batch", "n_batches"),
            ("library", "n_libraries"))])
    med = r.group_quantiles(f, ["sample_unit_id"], "age", {"age_median": 0.5}, weight="n")
    return b.rounded(base.join(med, "sample_unit_id"), 8)


@query("subject_audit", f"""WITH {b.CELLS_A} SELECT subject_id, count(DISTINCT sample_unit_id) AS n_samples,
 count(DISTINCT age) AS n_ages, round(min(age), 8) AS age_min, round(max(age), 8) AS age_max,
 round(max(age) - min(age), 8) AS age_span, count(DISTINCT sex) > 1 AS sex_conflict,
 count(DISTINCT sample_unit_id) > 1 AS repeated FROM cells GROUP BY 1""")
def subject_audit(spark, folder):
    f = r.fold(b.cells_a(spark, folder), ["subject_id"], "sample_unit_id", "age", "sex")
    return b.rounded(f.groupBy("subject_id").agg(
        F.count_distinct("sample_unit_id").alias("n_samples"), F.count_distinct("age").alias("n_ages"),
        F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        (F.max("age") - F.min("age")).alias("age_span"), (F.count_distinct("sex") > 1).alias("sex_conflict"),
        (F.count_distinct("sample_unit_id") > 1).alias("repeated")), 8)


@query("design_summary", f"""WITH {b.CELLS_A}, s AS (SELECT subject_id, count(DISTINCT sample_unit_id) AS n FROM cells
  GROUP BY 1), l AS (SELECT sample_unit_id, count(DISTINCT library) AS n FROM cells GROUP BY 1)
 SELECT (SELECT count(*) FROM s) AS n_subjects, (SELECT count(*) FROM l) AS n_samples, (SELECT count(*) FROM s WHERE
 n > 1) AS n_repeated, (SELECT min(n) FROM s) AS min_samples, (SELECT median(n) FROM s) AS median_samples,
 (SELECT max(n) FROM s) AS max_samples, (SELECT min(n) FROM l) AS min_libraries, (SELECT median(n) FROM l) AS
 median_libraries, (SELECT max(n) FROM l) AS max_libraries""")
def design_summary(spark, folder):
    f = r.fold(b.cells_a(spark, folder), ["subject_id"], "sample_unit_id", "library")

    def spread(key, value, tag):
        per = f.groupBy(key).agg(F.count_distinct(value).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("w"))
        return per.agg(F.struct(F.sum("w").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("w"))).alias("many"),
                                F.min("k").alias("lo"), F.percentile("k", F.lit(0.5), F.col("w")).alias("mid"),
                                F.max("k").alias("hi")).alias(tag))

    both = spread("subject_id", "sample_unit_id", "s").withColumn("l", spread("sample_unit_id", "library", "l").scalar())
    return both.select(
        F.col("s.n").alias("n_subjects"), F.col("l.n").alias("n_samples"), F.col("s.many").alias("n_repeated"),
        F.col("s.lo").alias("min_samples"), F.col("s.mid").alias("median_samples"), F.col("s.hi").alias("max_samples"),
        F.col("l.lo").alias("min_libraries"), F.col("l.mid").alias("median_libraries"), F.col("l.hi").alias("max_libraries"))


@query("replicate_audit", f"""WITH {b.CELLS_A} SELECT sample_unit_id, count(*) AS n_cells,
 string_agg(DISTINCT library, '|' ORDER BY library) AS libraries, string_agg(DISTINCT batch, '|' ORDER BY batch) AS
 batches, string_agg(DISTINCT cell_type, '|' ORDER BY cell_type) AS cell_types FROM cells GROUP BY 1""")
def replicate_audit(spark, folder):
    f = r.fold(b.cells_a(spark, folder), ["sample_unit_id"], "library", "batch", "cell_type")
    return f.groupBy("sample_unit_id").agg(
        F.sum("n").alias("n_cells"), r.distinct_text("library").alias("libraries"),
        r.distinct_text("batch").alias("batches"), r.distinct_text("cell_type").alias("cell_types"))


@query("key_relationship", f"""WITH {b.CELLS_A}, p AS (SELECT DISTINCT sample_unit_id, library FROM cells)
 SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY sample_unit_id)) AS max_right_per_left,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY library)) AS max_left_per_right,
 'many-to-many' AS relationship""")
def key_relationship(spark, folder):
    return r.relationship_class(b.cells_a(spark, folder), "sample_unit_id", "library")


SUPPORT_SQL = f"""{b.CELLS_B}, {b.COUNTS_B}, lib AS (SELECT cell_id, sum(count) AS lib FROM counts GROUP BY 1),
 support AS (SELECT sample_unit_id, cell_type, count(*) AS n_cells, coalesce(sum(lib), 0)::BIGINT AS library_size,
 string_agg(DISTINCT raw_label, '|' ORDER BY raw_label) AS raw_labels, count(DISTINCT library) AS n_libraries,
 min(subject_id) AS subject_id, min(age) AS age, min(sex) AS sex, min(batch) AS batch,
 count(*) >= 2 AS passes FROM cells LEFT JOIN lib USING (cell_id) GROUP BY ALL)"""


def support(spark, folder):
    lib = b.counts_b(spark, folder).groupBy("cell_id").agg(F.sum("count").alias("lib"))
    cells = b.cells_b(spark, folder).join(lib, "cell_id", "left")
    return cells.groupBy("sample_unit_id", "cell_type").agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("lib"), F.lit(0)).alias("library_size"),
        r.distinct_text("raw_label").alias("raw_labels"), F.count_distinct("library").alias("n_libraries"),
        *[F.min(c).alias(c) for c in ("subject_id", "age", "sex", "batch")],
        (F.count(F.lit(1)) >= 2).alias("passes"))


@query("replicate_type_support", f"WITH {SUPPORT_SQL} SELECT * FROM support")
def replicate_type_support(spark, folder):
    return support(spark, folder)


@query("cell_type_support_summary", f"""WITH {SUPPORT_SQL}, t AS (SELECT cell_type, count(*) AS n_observed,
  count(*) FILTER (passes) AS n_qualifying, count(DISTINCT subject_id) FILTER (passes) AS n_subjects,
  max(age) FILTER (passes) - min(age) FILTER (passes) AS age_span FROM support GROUP BY 1)
 SELECT *, concat_ws(';', CASE WHEN n_qualifying < 360 THEN 'insufficient_qualifying_sample_units' END, CASE WHEN
 n_subjects < 100 THEN 'insufficient_subjects' END, CASE WHEN age_span < 60 THEN 'insufficient_age_span' END) AS
 exclusion_reasons FROM t""")
def cell_type_support_summary(spark, folder):
    ok = F.col("passes")
    t = support(spark, folder).groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_observed"), F.count_if(ok).alias("n_qualifying"),
        F.count_distinct(F.when(ok, F.col("subject_id"))).alias("n_subjects"),
        (F.max(F.when(ok, F.col("age"))) - F.min(F.when(ok, F.col("age")))).alias("age_span"))
    return t.withColumn("exclusion_reasons", r.reasons(
        (F.col("n_qualifying") < 360, "insufficient_qualifying_sample_units"),
        (F.col("n_subjects") < 100, "insufficient_subjects"), (F.col("age_span") < 60, "insufficient_age_span")))


@query("replicate_metadata", f"""WITH {b.CELLS_B} SELECT subject_id, count(*) AS n_cells, count(DISTINCT sample_unit_id)
 AS n_samples, string_agg(DISTINCT library, '|' ORDER BY library) AS libraries, min(sex) AS sex, count(DISTINCT sex) > 1
 AS sex_conflict FROM cells GROUP BY 1""")
def replicate_metadata(spark, folder):
    f = r.fold(b.cells_b(spark, folder), ["subject_id"], "sample_unit_id", "library", "sex")
    return f.groupBy("subject_id").agg(
        F.sum("n").alias("n_cells"), F.count_distinct("sample_unit_id").alias("n_samples"),
        r.distinct_text("library").alias("libraries"), F.min("sex").alias("sex"),
        (F.count_distinct("sex") > 1).alias("sex_conflict"))


def dominant_sql(col: str) -> str:
    return (f"(SELECT cell_type, {col} AS dominant_{col}, round(n / tot, 8) AS dominant_{col}_share FROM (SELECT cell_type, "
            f"{col}, count(*) AS n, sum(count(*)) OVER (PARTITION BY cell_type) AS tot, row_number() OVER (PARTITION BY "
            f"cell_type ORDER BY count(*) DESC, {col}) AS k FROM cells GROUP BY cell_type, {col}) WHERE k = 1)")


@query("label_evidence", f"""WITH {b.CELLS_A} SELECT x.*, c.* EXCLUDE (cell_type), d.* EXCLUDE (cell_type) FROM (SELECT
 cell_type, count(*) AS n_cells, count(DISTINCT sample_unit_id) AS n_sample_units, count(DISTINCT subject_id) AS
 n_subjects, round(min(age), 8) AS age_min, round(max(age), 8) AS age_max, round(avg((confidence < 0.1)::INTEGER), 8) AS
 low_confidence_fraction, round(quantile_cont(confidence, 0.05), 8) AS confidence_q05, round(median(confidence), 8) AS
 confidence_median, round(quantile_cont(confidence, 0.95), 8) AS confidence_q95 FROM cells GROUP BY 1) x JOIN
 {dominant_sql("cluster")} c USING (cell_type) JOIN {dominant_sql("batch")} d USING (cell_type)""")
def label_evidence(spark, folder):
    return b.rounded(r.label_evidence(b.cells_a(spark, folder), "cell_type", 0.1), 8)


@query("marker_summary", f"""WITH {b.CELLS_B}, {b.COUNTS_B}, {b.GENES_B}, panel AS (SELECT gene_name, CASE family WHEN
  'PROMO' THEN 'F' WHEN 'LARGE' THEN 'O' ELSE 'P' END AS expected FROM genes WHERE brand = 'Brand#7' UNION ALL SELECT
  DISTINCT 'MISSING-' || family, 'F' FROM genes), z AS (SELECT cell_type, count(*) AS n_cells FROM cells GROUP BY 1),
 m AS (SELECT cell_type, gene_id, sum(count) AS s, count(*) FILTER (count > 0) AS d FROM counts JOIN cells USING (cell_id)
  GROUP BY ALL)
 SELECT z.cell_type, p.gene_name, n_cells, g.gene_id IS NOT NULL AS gene_present, round(CASE WHEN g.gene_id IS NOT NULL THEN
  coalesce(d, 0) / n_cells END, 8) AS detection_fraction, round(CASE WHEN g.gene_id IS NOT NULL THEN coalesce(s, 0) / n_cells
  END, 8) AS mean_count, p.expected = z.cell_type AS expected_marker FROM z CROSS JOIN panel p LEFT JOIN genes g ON
  g.gene_name = p.gene_name LEFT JOIN m ON m.cell_type = z.cell_type AND m.gene_id = g.gene_id""")
def marker_summary(spark, folder):
    genes = b.genes_b(spark, folder)
    fam = F.col("family")
    panel = genes.where("brand = 'Brand#7'").select(
        "gene_name", F.when(fam == "PROMO", "F").when(fam == "LARGE", "O").otherwise("P").alias("expected_label"))
    gone = genes.select(F.concat(F.lit("MISSING-"), "family").alias("gene_name"), F.lit("F").alias("expected_label")).distinct()
    return b.rounded(r.marker_summary(b.cells_b(spark, folder), b.counts_b(spark, folder), genes,
                                      panel.unionByName(gone), "cell_type"), 8)


@query("label_confidence_quantiles", f"""WITH {b.CELLS_B} SELECT raw_label, round(quantile_cont(confidence, 0.05), 8) AS q05,
 round(median(confidence), 8) AS q50, round(quantile_cont(confidence, 0.95), 8) AS q95 FROM cells GROUP BY 1""")
def label_confidence_quantiles(spark, folder):
    return b.rounded(r.wide_quantiles(b.cells_b(spark, folder), ["raw_label"], "confidence",
                                       {"q05": 0.05, "q50": 0.5, "q95": 0.95}), 8)


@query("stage_retention", """WITH s AS (SELECT 0 AS stage_order, 'documents' AS stage, count(*) AS n_cells FROM documents
 UNION ALL SELECT 1, 'long', count(*) FROM documents WHERE n_chars >= 200 UNION ALL SELECT 2, 'labelled', count(*) FROM
 documents SEMI JOIN labels USING (doc_id) WHERE n_chars >= 200) SELECT *, lag(n_cells) OVER w AS previous_cells,
 round(n_cells / lag(n_cells) OVER w, 8) AS retention_fraction, coalesce(n_cells <= lag(n_cells) OVER w, true) AS
 non_increasing FROM s WINDOW w AS (ORDER BY stage_order)""")
def stage_retention(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "n_chars")
    long = docs.where("n_chars >= 200")
    labelled = long.join(b.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return b.rounded(r.stage_retention([("documents", docs), ("long", long), ("labelled", labelled)]), 8)


@query("stratum_retention", """WITH d AS (SELECT doc_id, lang, CASE WHEN source <> 'src3' THEN source END AS source FROM
 documents), a AS (SELECT 'lang' AS stratum, coalesce(lang, '__MISSING__') AS level, doc_id FROM d UNION ALL SELECT 'source',
 coalesce(source, '__MISSING__'), doc_id FROM d) SELECT stratum, level, count(*) AS input_cells, count(l.doc_id) AS
 retained_cells, round(count(l.doc_id) / count(*), 8) AS retention_fraction FROM a LEFT JOIN labels l USING (doc_id)
 GROUP BY 1, 2""")
def stratum_retention(spark, folder):
    docs = b.table(spark, folder, "documents").select(
        "doc_id", "lang", F.when(F.col("source") != "src3", F.col("source")).alias("source"))
    after = docs.join(b.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return b.rounded(r.stratum_retention(docs, after, ["lang", "source"]), 8)


@query("type_support_for_review", f"""WITH {FRACTIONS_SQL} SELECT cell_type, round(min(age), 8) AS age_min,
 round(max(age), 8) AS age_max, round(max(age) - min(age), 8) AS age_span, sum(n_cells)::BIGINT AS total_cells,
 median(n_cells) FILTER (n_cells > 0) AS median_cells_per_replicate FROM fractions GROUP BY 1""")
def type_support_for_review(spark, folder):
    f = r.fold(fractions(spark, folder), ["cell_type"], "age", "n_cells", n="w")
    seen = f.where("n_cells > 0")
    base = f.groupBy("cell_type").agg(
        F.min("age").alias("age_min"), F.max("age").alias("age_max"), (F.max("age") - F.min("age")).alias("age_span"),
        F.sum(F.col("n_cells") * F.col("w")).alias("total_cells"))
    med = r.group_quantiles(seen, ["cell_type"], "n_cells", {"median_cells_per_replicate": 0.5}, weight="w")
    return b.rounded(base.join(med, "cell_type"), 8)


EDGES = (20, 30, 40, 50, 60, 66)


@query("binned_composition", f"""WITH {FRACTIONS_SQL}, bn AS (SELECT *, CASE {" ".join(
  f"WHEN age >= {a} AND age < {z} THEN '{a}-{z}'" for a, z in zip(EDGES, EDGES[1:]))} END AS age_bin,
  CASE {" ".join(f"WHEN age >= {a} AND age < {z} THEN {i}" for i, (a, z) in enumerate(zip(EDGES, EDGES[1:])))} END AS
  bin_order FROM fractions), ok AS (SELECT * FROM bn WHERE age_bin IS NOT NULL), top AS (SELECT cell_type FROM ok GROUP BY 1
  ORDER BY avg(fraction) DESC, cell_type LIMIT 3), pt AS (SELECT age_bin, bin_order, CASE WHEN cell_type IN (FROM top) THEN
  cell_type ELSE 'Other' END AS shown, avg(fraction) AS m FROM ok GROUP BY age_bin, bin_order, cell_type),
 ps AS (SELECT age_bin, bin_order, shown, sum(m) AS m FROM pt GROUP BY ALL)
 SELECT age_bin, bin_order, shown, round(m / sum(m) OVER (PARTITION BY age_bin), 8) AS mean_fraction, n_samples,
 n_samples < 90 AS sparse_bin FROM ps JOIN (SELECT age_bin, count(DISTINCT sample_unit_id) AS n_samples FROM ok GROUP BY 1)
 USING (age_bin)""")
def binned_composition(spark, folder):
    return b.rounded(r.binned_composition(fractions(spark, folder), EDGES, 3, 90, drop_sparse=False), 8)


@query("qc_histograms", f"""WITH {b.CELLS_A}, l AS (SELECT 'value' AS metric, value AS x FROM cells UNION ALL SELECT 'k', k
  FROM cells), m AS (SELECT metric, min(x) AS lo, max(x) AS hi, median(x) AS median FROM l GROUP BY 1)
 SELECT metric, least(floor((x - lo) * 40 / (hi - lo)), 39)::INTEGER AS bin, lo, hi, round(median, 6) AS median, count(*) AS n
 FROM l JOIN m USING (metric) GROUP BY ALL""")
def qc_histograms(spark, folder):
    return b.rounded(r.histogram(b.cells_a(spark, folder), ["value", "k"], 40))


@query("observed_predicted_density", """WITH m AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1,
  min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) SELECT least(floor((l_quantity - x0) * 20 /
  (x1 - x0)), 19)::INTEGER AS x_bin, least(floor((l_extendedprice - y0) * 20 / (y1 - y0)), 19)::INTEGER AS y_bin, count(*) AS n
 FROM lineitem, m GROUP BY ALL""")
def observed_predicted_density(spark, folder):
    return r.density_grid(b.table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice"),
                          "l_quantity", "l_extendedprice", 20)


@query("observed_predicted_line", """SELECT l_returnflag, regr_count(l_extendedprice, l_quantity)::BIGINT AS n,
 round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS
 intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r_squared FROM lineitem GROUP BY 1""")
def observed_predicted_line(spark, folder):
    out = linear_fit(b.table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"),
                      F.round("r_squared", 8).alias("r_squared"))


# ---- windows ---------------------------------------------------------------------------------

@query("average_ranks", f"""WITH {b.CELLS_A} SELECT cell_id, cell_type, rank() OVER (PARTITION BY cell_type ORDER BY k) +
 (count(*) OVER (PARTITION BY cell_type, k) - 1) / 2.0::DOUBLE AS rank_k FROM cells""")
def average_ranks(spark, folder):
    return average_rank(b.cells_a(spark, folder).select("cell_id", "cell_type", "k"), "k", ["cell_type"], "rank_k").drop("k")


@query("earliest_sample_per_subject", f"""WITH {b.CELLS_A}, s AS (SELECT DISTINCT subject_id, sample_unit_id, age FROM cells)
 SELECT subject_id, sample_unit_id, round(age, 8) AS age FROM s QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY
 age, sample_unit_id) = 1""")
def earliest_sample_per_subject(spark, folder):
    samples = b.cells_a(spark, folder).select("subject_id", "sample_unit_id", "age")
    return b.rounded(earliest_per_group(samples, ["subject_id"], ["age", "sample_unit_id"]), 8)


@query("latest_row_per_sample", """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER
 (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1""")
def latest_row_per_sample(spark, folder):
    rows = b.table(spark, folder, "events").select("user_id", "event_id", "value")
    best = rows.groupBy("user_id").agg(F.max(F.struct("value", "event_id")).alias("m"))
    return best.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


@query("ranked_within_type_and_direction", """SELECT p_brand, p_type, p_partkey, p_retailprice, row_number() OVER
 (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_size, p_partkey)::INTEGER AS review_rank FROM part QUALIFY
 review_rank <= 3""")
def ranked_within_type_and_direction(spark, folder):
    part = b.table(spark, folder, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice", "p_size")
    return top_per_group(part, ["p_brand", "p_type"], [F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")],
                         3, "review_rank").drop("p_size")


@query("balanced_row_weights", """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT event_id,
 round((1.0::DOUBLE / n) / ((SELECT count(*) FROM n)::DOUBLE / (SELECT count(*) FROM events)), 8) AS weight
 FROM events JOIN n USING (user_id)""")
def balanced_row_weights(spark, folder):
    rows = b.table(spark, folder, "events").select("event_id", "user_id")
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mean = sizes.agg((F.count(F.lit(1)) / F.sum("n")).alias("m")).scalar()
    return rows.join(sizes, "user_id").select(
        "event_id", F.round(1 / F.col("n") / mean, 8).alias("weight"))


@query("centred_within_test", f"""WITH {b.CELLS_A} SELECT cell_id, round(age - avg(age) OVER (PARTITION BY cell_type), 8) AS
 centred FROM cells""")
def centred_within_test(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "cell_type", "age")
    means = cells.groupBy("cell_type").agg(F.avg("age").alias("m"))
    return cells.join(means, "cell_type").select("cell_id", F.round(F.col("age") - F.col("m"), 8).alias("centred"))


# ---- ordered reports -------------------------------------------------------------------------

@query("top_signals", """SELECT p_partkey AS signal_id, p_retailprice AS effect, p_size AS fdr FROM part ORDER BY
 (p_size < 10) DESC, p_size, abs(p_retailprice) DESC, p_partkey LIMIT 20""")
def top_signals(spark, folder):
    part = b.table(spark, folder, "part").select(
        F.col("p_partkey").alias("signal_id"), F.col("p_retailprice").alias("effect"), F.col("p_size").alias("fdr"))
    return part.orderBy((F.col("fdr") < 10).desc(), F.col("fdr").asc_nulls_last(), F.abs("effect").desc(),
                        "signal_id").limit(20)


@query("top_types_rest_other", """WITH t AS (SELECT source FROM documents GROUP BY 1 ORDER BY avg(n_chars) DESC, source LIMIT 5)
 SELECT CASE WHEN source IN (FROM t) THEN source ELSE 'Other' END AS shown, count(*) AS n FROM documents GROUP BY 1""")
def top_types_rest_other(spark, folder):
    docs = b.table(spark, folder, "documents").select("source", "n_chars")
    top = docs.groupBy("source").agg(F.avg("n_chars").alias("m")).orderBy(F.desc("m"), "source").limit(5)
    shown = F.coalesce("shown", F.lit("Other")).alias("shown")
    return docs.join(top.select("source", F.col("source").alias("shown")), "source", "left").groupBy(shown).agg(
        F.count(F.lit(1)).alias("n"))


@query("error_by_type", """WITH e AS (SELECT p_type, abs(l_extendedprice - l_quantity * p_retailprice) / 1000 AS e FROM lineitem JOIN
 part ON l_partkey = p_partkey) SELECT p_type, count(*) AS n, round(avg(e), 6) AS mean_error, round(median(e), 6) AS
 median_error, round(avg((e <= 5)::INTEGER), 8) AS within_5 FROM e GROUP BY 1 HAVING count(*) >= 50 ORDER BY mean_error
 LIMIT 4""")
def error_by_type(spark, folder):
    lines = b.table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = b.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice")
    e = lines.join(part, "l_partkey").select("p_type", (F.abs(
        F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) / 1000).alias("e"))
    base = e.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_error"),
                                   F.avg((F.col("e") <= 5).cast("int")).alias("within_5")).where("n >= 50")
    med = r.wide_quantiles(e, ["p_type"], "e", {"median_error": 0.5})
    out = base.join(med, "p_type").orderBy("mean_error").limit(4)
    return out.select("p_type", "n", F.round("mean_error", 6).alias("mean_error"),
                      F.round("median_error", 6).alias("median_error"), F.round("within_5", 8).alias("within_5"))


@query("report_order", """SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'STANDARD' THEN 0
 WHEN 'PROMO' THEN 1 ELSE 2 END, p_size DESC, p_partkey))::INTEGER AS position FROM part""")
def report_order(spark, folder):
    kind = F.col("p_type")
    order = F.when(kind == "STANDARD", 0).when(kind == "PROMO", 1).otherwise(2)
    w = Window.partitionBy("p_brand").orderBy(order, F.desc("p_size"), "p_partkey")
    return b.table(spark, folder, "part").select("p_partkey", F.row_number().over(w).alias("position"))


@query("top_labels_with_share", """SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 8) AS fraction
 FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 3""")
def top_labels_with_share(spark, folder):
    docs = b.table(spark, folder, "documents").select("lang")
    total = docs.agg(F.count(F.lit(1)).alias("t")).scalar()
    out = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(3)
    return out.withColumn("fraction", F.round(F.col("n") / total, 8))


@query("first_effect_per_signal", """SELECT 'composition::' || l_returnflag || '::' || l_suppkey AS signal_id,
 l_discount AS effect FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_shipdate,
 l_orderkey, l_partkey, l_linenumber, l_discount) = 1""")
def first_effect_per_signal(spark, folder):
    lines = b.table(spark, folder, "lineitem").select(
        "l_returnflag", "l_suppkey", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    first = earliest_per_group(lines, ["l_returnflag", "l_suppkey"],
                               ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_discount"])
    return first.select(s.join_key_text(F.lit("composition"), "l_returnflag", "l_suppkey").alias("signal_id"),
                        F.col("l_discount").alias("effect"))


@query("association_matrix", """WITH a AS (SELECT l_returnflag AS cell_type, l_linestatus AS signature, l_discount - 0.05 AS rho,
 l_tax AS fdr, l_suppkey % 13 = 0 AS fallback FROM lineitem) SELECT cell_type, round(avg(rho) FILTER (signature = 'F'), 8) AS
 F_rho, min(fdr) FILTER (signature = 'F') AS F_fdr, bool_or(fallback) FILTER (signature = 'F') AS F_fallback,
 round(avg(rho) FILTER (signature = 'O'), 8) AS O_rho, min(fdr) FILTER (signature = 'O') AS O_fdr, bool_or(fallback) FILTER
 (signature = 'O') AS O_fallback FROM a GROUP BY 1""")
def association_matrix(spark, folder):
    a = b.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("cell_type"), F.col("l_linestatus").alias("signature"),
        (F.col("l_discount") - 0.05).alias("rho"), F.col("l_tax").alias("fdr"), (F.col("l_suppkey") % 13 == 0).alias("fallback"))
    return b.rounded(a.groupBy("cell_type").pivot("signature", ["F", "O"]).agg(
        F.avg("rho").alias("rho"), F.min("fdr").alias("fdr"), F.bool_or("fallback").alias("fallback")), 8)


@query("ordered_association_matrix", f"""WITH a AS (SELECT l_suppkey AS unit, l_returnflag AS signature, {b.exact_mean_sql("l_discount")} AS rho,
 {b.exact_mean_sql("l_tax")} AS fdr, bool_or(l_orderkey % 13 = 0) AS fallback FROM lineitem GROUP BY ALL), m AS (SELECT unit, avg(rho) FILTER (signature = 'A') AS A_value, min(fdr) FILTER (signature =
 'A') AS A_fdr, bool_or(fallback) FILTER (signature = 'A') AS A_fallback, avg(rho) FILTER (signature = 'N') AS N_value, min(fdr) FILTER (signature = 'N') AS N_fdr,
 bool_or(fallback) FILTER (signature = 'N') AS N_fallback, avg(rho) FILTER (signature = 'R') AS R_value, min(fdr) FILTER (signature = 'R') AS R_fdr, bool_or(fallback)
 FILTER (signature = 'R') AS R_fallback FROM a GROUP BY 1), s AS (SELECT *, (coalesce(A_fdr < 0.04, false)::INTEGER + coalesce(N_fdr < 0.04, false)::INTEGER +
 coalesce(R_fdr < 0.04, false)::INTEGER)::INTEGER AS n_significant FROM m) SELECT unit, {", ".join(f"{b.half_up_sql(f'{v}_value', 8)}, {b.half_up_sql(f'{v}_fdr', 8)}, {v}_fallback" for v in "ANR")}, n_significant, row_number()
 OVER (ORDER BY n_significant DESC, unit) AS place FROM s""")
def ordered_association_matrix(spark, folder):
    """Units by level, with the number of levels below an adjusted p value and the units' place by it."""
    a = b.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("signature")).agg(
        b.exact_mean("l_discount").alias("rho"), b.exact_mean("l_tax").alias("fdr"), F.bool_or(F.col("l_orderkey") % 13 == 0).alias("fallback"))
    out = review.association_matrix(a, "unit", "signature", ["A", "N", "R"], "rho", "fdr", "fallback", 0.04)
    return out.withColumns({f"{v}_{c}": b.half_up(f"{v}_{c}", 8) for v in "ANR" for c in ("value", "fdr")})


@query("significant_supported_associations", f"""WITH a AS (SELECT l_suppkey AS unit, count(DISTINCT l_partkey) AS n_subjects, {b.exact_mean_sql("l_tax")} AS fdr FROM
 lineitem GROUP BY 1) SELECT unit, n_subjects, {b.half_up_sql("fdr", 8)} FROM a WHERE fdr < 0.04 AND n_subjects >= 20""")
def significant_supported_associations(spark, folder):
    a = b.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(
        F.count_distinct("l_partkey").alias("n_subjects"), b.exact_mean("l_tax").alias("fdr")).withColumn("fdr_significant", F.col("fdr") < 0.04)
    return review.presentation_rows(a, significant_only=True, min_support=20).drop("fdr_significant").withColumn("fdr", b.half_up("fdr", 8))


@query("presentation_filter", f"""WITH {FRACTIONS_SQL}, a AS (SELECT cell_type, count(*) FILTER (n_cells > 0) AS n,
 round(regr_slope(fraction, age), 8) AS slope FROM fractions GROUP BY 1) SELECT * FROM a WHERE n >= 100 AND abs(slope) > 0
 ORDER BY slope DESC""")
def presentation_filter(spark, folder):
    f = fractions(spark, folder)
    seen = f.groupBy("cell_type").agg(F.count_if(F.col("n_cells") > 0).alias("n"))
    fit = linear_fit(f, ["cell_type"], "age", "fraction").select("cell_type", F.round("slope", 8).alias("slope"))
    return seen.join(fit, "cell_type").where("n >= 100 and abs(slope) > 0").orderBy(F.desc("slope"))
