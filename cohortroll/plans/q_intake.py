"""Sources, sinks, projections and matrix quality control over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.functions import scalar as s
from cohortroll.functions.resolve import (
    pick_roles, require_columns, require_disjoint_lists, present_covariates, standardise_headers)
from cohortroll.operators import qc
from cohortroll.operators.ordering import sorted_position
from cohortroll.operators.rollup import profile_table, pseudobulk_sums
from cohortroll.operators.sampling import seeded_take
from cohortroll.plans import bindings as b
from cohortroll.plans.registry import query
from cohortroll.session import keep, scratch_path
from cohortroll.sources import readers, sinks

DIRTY_SQL = """dirty AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' nan '
  WHEN 2 THEN NULL WHEN 3 THEN ' ' || event_type || ' ' ELSE event_type END AS label,
 CASE event_id % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' END AS flag,
 CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || user_id ELSE user_id::VARCHAR || '.5' END AS num
 FROM events)"""


def dirty(spark, folder):
    """Event labels, flags and numbers with blanks, stray spaces, null texts and bad numbers."""
    e, kind = F.col("event_id"), F.col("event_type")
    user = F.col("user_id").cast("string")
    label = F.when(e % 7 == 0, "  ").when(e % 7 == 1, " nan ").when(e % 7 == 2, F.lit(None)).when(
        e % 7 == 3, F.concat(F.lit(" "), kind, F.lit(" "))).otherwise(kind)
    flag = F.when(e % 5 == 0, " Yes ").when(e % 5 == 1, "TRUE").when(e % 5 == 2, "1").when(
        e % 5 == 3, "no")
    num = F.when(e % 4 == 0, "n/a").when(e % 4 == 1, F.concat(F.lit(" "), user)).otherwise(
        F.concat(user, F.lit(".5")))
    return b.table(spark, folder, "events").select(
        "event_id", label.alias("label"), flag.alias("flag"), num.alias("num"))


@query("cell_metadata_scan",
       "SELECT event_id, user_id, event_type FROM events")
def cell_metadata_scan(spark, folder):
    return readers.read_cells(spark, f"{folder}/events.parquet", ["event_id", "user_id", "event_type"])


@query("delimited_round_trip",
       "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def delimited_round_trip(spark, folder):
    path = scratch_path(spark, "customer") + ".tsv"
    source = b.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    sinks.write_delimited(source, path, sep="\t", gzip=True)
    return b.rounded(readers.read_delimited(
        spark, path, "c_custkey bigint, c_name string, c_acctbal double"), 2)


@query("resolved_header_read",
       "SELECT c_custkey::VARCHAR AS subject_id, c_mktsegment AS sex FROM customer")
def resolved_header_read(spark, folder):
    path = scratch_path(spark, "people")
    source = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Subject ID"), F.col("c_mktsegment").alias("SEX"), "c_name")
    sinks.write_delimited(source, path)
    return readers.read_resolved(spark, path, ["subject_id", "sex"])


@query("multi_file_union_dedup", """WITH x AS (SELECT doc_id, lang, NULL AS quality FROM documents
  UNION ALL SELECT doc_id, NULL, quality FROM labels UNION ALL SELECT doc_id, lang, NULL FROM documents)
 SELECT DISTINCT doc_id, lang, quality::BIGINT AS quality FROM x""")
def multi_file_union_dedup(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "lang")
    labels = b.table(spark, folder, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return readers.union_by_name([docs, labels, docs]).distinct()


@query("seeded_cell_sample", """SELECT event_id, user_id FROM events
 ORDER BY md5('17|' || event_id), event_id LIMIT 1500""")
def seeded_cell_sample(spark, folder):
    events = b.table(spark, folder, "events").select("event_id", "user_id")
    return seeded_take(events, ["event_id"], 1500, seed=17)


@query("unique_names", """SELECT event_id, CASE WHEN k > 1 THEN name || '-' || (k - 1) ELSE name END
 AS unique_name FROM (SELECT event_id, 'U' || user_id AS name,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)""")
def unique_names(spark, folder):
    named = b.table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("U"), "user_id").alias("name"))
    return readers.unique_names(named, "name", "event_id").select("event_id", "unique_name")


@query("count_layer_choice", """SELECT l_orderkey AS cell_id, l_partkey AS gene_id,
 sum(l_quantity)::BIGINT AS count FROM lineitem GROUP BY ALL""")
def count_layer_choice(spark, folder):
    main = b.counts_b(spark, folder)
    layers = main.withColumn("layer", F.lit("counts")).unionByName(
        main.withColumn("count", F.col("count") * 2).withColumn("layer", F.lit("X")))
    return readers.choose_layer(layers, "auto")


@query("vectors_to_long", """SELECT vec_id, (i - 1)::INTEGER AS dim, round(embedding[i]::DOUBLE, 6) AS value
 FROM embeddings, range(1, 65) t(i) WHERE embedding[i] <> 0""")
def vectors_to_long(spark, folder):
    long = readers.vectors_to_long(b.table(spark, folder, "embeddings"), "vec_id", "embedding")
    return b.rounded(long.withColumn("value", F.col("value").cast("double")))


@query("grouped_output_manifest", """SELECT event_type, count(*) AS n_rows,
 'group_path=' || event_type AS relative_path FROM events GROUP BY 1""")
def grouped_output_manifest(spark, folder):
    events = b.table(spark, folder, "events").select("event_id", "event_type", "value")
    return sinks.write_groups(events, "event_type", scratch_path(spark, "groups"))


@query("grouped_output_read_back",
       "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def grouped_output_read_back(spark, folder):
    path = scratch_path(spark, "groups")
    sinks.write_groups(b.table(spark, folder, "events").select("event_id", "event_type", "value"),
                       "event_type", path)
    return b.rounded(readers.read_scenarios(spark, path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("json_report", """SELECT '{"event_type":"' || event_type || '","n":' || count(*) || '}' AS report
 FROM events GROUP BY event_type""")
def json_report(spark, folder):
    path = scratch_path(spark, "report")
    counts = b.table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_json_report(counts, path)
    back = spark.read.schema("event_type string, n bigint").json(path)
    return back.select(F.to_json(F.struct("event_type", "n")).alias("report"))


def profile_sums(spark, folder):
    cells = b.cells_b(spark, folder).withColumn(
        "profile", F.concat_ws("||", "sample_unit_id", "cell_type"))
    return cells, pseudobulk_sums(b.counts_b(spark, folder, "brand"), cells, ["profile"])


@query("coordinate_matrix", f"""WITH {b.CELLS_B}, {b.COUNTS_BRAND},
 s AS (SELECT sample_unit_id || '||' || cell_type AS profile, gene_id, sum(count)::BIGINT AS count
  FROM counts JOIN cells USING (cell_id) GROUP BY ALL)
 SELECT dense_rank() OVER (ORDER BY profile) AS row, dense_rank() OVER (ORDER BY gene_id) AS col,
  count FROM s""")
def coordinate_matrix(spark, folder):
    _, sums = profile_sums(spark, folder)
    entries, _, _ = sinks.coordinate_matrix(sums, "profile", "gene_id")
    path = scratch_path(spark, "matrix")
    sinks.write_coordinate(entries, path)
    return spark.read.option("sep", " ").schema("row bigint, col bigint, count bigint").csv(path)


@query("coordinate_matrix_checks", f"""WITH {b.COUNTS_BRAND} SELECT unnest(['rows_match_profiles',
 'columns_match_genes', 'row_sums_match_library_size']) AS name, sum(count) > 0 AS passed FROM counts""")
def coordinate_matrix_checks(spark, folder):
    cells, sums = profile_sums(spark, folder)
    entries, rows, cols = sinks.coordinate_matrix(sums, "profile", "gene_id")
    library = b.counts_b(spark, folder).join(cells.select("cell_id", "profile"), "cell_id").groupBy(
        "profile").agg(F.sum("count").alias("library_size"))
    return sinks.matrix_checks(entries, rows, cols, library)


@query("matrix_read_back", f"""WITH {b.CELLS_B}, {b.COUNTS_BRAND}, s AS (SELECT sample_unit_id || '||' || cell_type AS profile, gene_id, sum(count)::BIGINT AS count
 FROM counts JOIN cells USING (cell_id) GROUP BY ALL), e AS (SELECT dense_rank() OVER (ORDER BY profile) AS row, dense_rank() OVER (ORDER BY gene_id) AS col, count FROM
 s), k AS (SELECT count(*) FILTER (row % 90 = 0) AS r, count(*) FILTER (col = 3) + count(*) FILTER (col = 3 AND row % 50 = 7) AS c, count(*) FILTER
 (row % 50 = 7) AS twice, count(DISTINCT row) FILTER (row % 90 <> 0 AND (row % 50 = 7 OR row % 40 = 1)) AS off FROM e) SELECT unnest(['rows_outside', 'columns_outside', 'rows_without_entry', 'columns_without_entry', 'repeated_entries', 'row_sums_off']) AS name,
 unnest([r, c, 0, 0, twice, off])::BIGINT AS n, n = 0 AS passed FROM k""")
def matrix_read_back(spark, folder):
    """A written matrix read back, with rows and a column missing from the tables, repeated entries and wrong library sizes planted."""
    _, sums = profile_sums(spark, folder)
    sums = keep(sums, "sums")
    entries, rows, cols = sinks.coordinate_matrix(sums, "profile", "gene_id")
    path = scratch_path(spark, "matrix")
    sinks.write_coordinate(entries.unionByName(entries.where("row % 50 = 7")), path)
    library = sums.groupBy("profile").agg(F.sum("count").alias("library_size")).join(rows, "profile").select(
        "profile", (F.col("library_size") + (F.col("row") % 40 == 1).cast("int")).alias("library_size"))
    return sinks.matrix_source_checks(sinks.read_coordinate(spark, path), rows.where("row % 90 <> 0"), cols.where("col <> 3"), library)


@query("profile_surrogate_ids", f"""WITH {b.CELLS_A} SELECT printf('PB%05d', row_number() OVER
  (ORDER BY cell_type, sample_unit_id)) AS profile_id, cell_type, sample_unit_id,
  count(*) AS n_cells FROM cells GROUP BY cell_type, sample_unit_id HAVING count(*) >= 2""")
def profile_surrogate_ids(spark, folder):
    profiles = profile_table(b.cells_a(spark, folder)).where("n_cells >= 2")
    numbered = sorted_position(profiles, ["cell_type", "sample_unit_id"])
    return numbered.select(F.format_string("PB%05d", "position").alias("profile_id"),
                           "cell_type", "sample_unit_id", "n_cells")


@query("standard_headers", """SELECT event_id AS cell_id, user_id AS subject_id, event_type AS cell_type,
 ts::VARCHAR IS NOT NULL AS has_time FROM events""")
def standard_headers(spark, folder):
    events = b.table(spark, folder, "events").withColumnRenamed("event_id", "Cell Barcode")
    std = standardise_headers(events, renames={"User ID": "subject_id"})
    require_columns(std.columns, ["cell_id", "subject_id", "cell_type"], "events")
    return std.select("cell_id", "subject_id", "cell_type", F.col("ts").isNotNull().alias("has_time"))


@query("role_columns", f"""WITH {b.CELLS_A} SELECT sample_unit_id, sex, batch, count(*) AS n_cells,
 round(max(age), 6) AS age FROM cells GROUP BY ALL""")
def role_columns(spark, folder):
    cells = b.cells_a(spark, folder).withColumnsRenamed({"age": "donor_age", "sex": "gender"})
    cells = cells.withColumnsRenamed({"donor_age": "age_years"})
    cells = standardise_headers(cells)
    roles = pick_roles(cells.columns)
    covariates = present_covariates(cells.columns, [roles["sex"], "batch"])
    require_disjoint_lists(["click", "view"], ["error"])
    return b.rounded(cells.groupBy(roles["sample_unit_id"], *covariates).agg(
        F.count(F.lit(1)).alias("n_cells"), F.max(roles["age"]).alias("age")))


@query("clean_text_and_flags", f"""WITH {DIRTY_SQL} SELECT event_id, nullif(trim(label), '') AS label,
 coalesce(trim(label) <> '' AND lower(trim(label)) <> 'nan', false) AS present,
 try_cast(trim(num) AS DOUBLE) AS number, coalesce(lower(trim(flag)) IN ('true','1','yes'), false) AS flag
 FROM dirty""")
def clean_text_and_flags(spark, folder):
    return dirty(spark, folder).select(
        "event_id", s.clean_text("label").alias("label"), s.is_present("label").alias("present"),
        s.finite_or_null(s.to_number("num")).alias("number"), s.text_to_bool("flag").alias("flag"))


@query("rows_with_complete_keys", f"""WITH {DIRTY_SQL}, c AS (SELECT event_id,
 nullif(trim(label), '') AS label, try_cast(trim(num) AS DOUBLE) AS age FROM dirty)
 SELECT * FROM c WHERE label IS NOT NULL AND age IS NOT NULL""")
def rows_with_complete_keys(spark, folder):
    return dirty(spark, folder).select(
        "event_id", s.clean_text("label").alias("label"), s.to_number("num").alias("age")
    ).dropna(subset=["label", "age"])


@query("cell_name_split", """WITH n AS (SELECT event_id, 'U' || user_id || '-' || event_type || '.x_' ||
 event_id AS name FROM events) SELECT event_id, split_part(name, '_', 1) AS sample,
 substring(name, instr(name, '_') + 1) AS barcode, split_part(split_part(name, '_', 1), '-', 1) AS donor
 FROM n""")
def cell_name_split(spark, folder):
    name = F.concat(F.lit("U"), "user_id", F.lit("-"), "event_type", F.lit(".x_"), "event_id")
    sample, barcode = s.split_cell_name("name")
    named = b.table(spark, folder, "events").select("event_id", name.alias("name"))
    return named.select("event_id", sample.alias("sample"), barcode.alias("barcode")).withColumn(
        "donor", s.nth_token("sample", "-", 0))


# The delimiters a sample token may use, in order of preference.
DELIMITERS = ("-", ".", "|", ":")


@query("delimiter_detection", """WITH t AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'U' || user_id || '-1'
  ELSE 'U.' || user_id END AS tok FROM events), h AS (SELECT 1 AS o, '-' AS d, count(*) FILTER
  (contains(tok, '-')) AS n FROM t UNION ALL SELECT 2, '.', count(*) FILTER (contains(tok, '.')) FROM t
  UNION ALL SELECT 3, '|', count(*) FILTER (contains(tok, '|')) FROM t
  UNION ALL SELECT 4, ':', count(*) FILTER (contains(tok, ':')) FROM t)
 SELECT d AS delimiter, n AS n_hits FROM h ORDER BY n DESC, o LIMIT 1""")
def delimiter_detection(spark, folder):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    tok = F.when(e % 3 == 0, F.concat(F.lit("U"), user, F.lit("-1"))).otherwise(
        F.concat(F.lit("U."), user))
    hits = b.table(spark, folder, "events").select(tok.alias("tok")).agg(*[
        F.count_if(F.contains("tok", F.lit(d))).alias(f"h{i}") for i, d in enumerate(DELIMITERS)])
    best = F.array_max(F.array(*[
        F.struct(F.col(f"h{i}").alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d"))
        for i, d in enumerate(DELIMITERS)]))
    return hits.select(best["d"].alias("delimiter"), best["n"].alias("n_hits"))


@query("gene_prefix_flags", f"""WITH {b.GENES_B} SELECT gene_id, upper(gene_name) LIKE 'MT-%' AS is_mt,
 regexp_matches(upper(gene_name), '^RP[LS]') AS is_ribo FROM genes""")
def gene_prefix_flags(spark, folder):
    mito, ribo = s.gene_flags("gene_name")
    return b.genes_b(spark, folder).select("gene_id", mito.alias("is_mt"), ribo.alias("is_ribo"))


@query("signal_ids_and_labels", """SELECT event_id, CASE WHEN event_id % 2 = 0
  THEN 'composition::' || event_type ELSE 'signature::' || event_type || '::' || 'set_' || (user_id % 3)
  END AS signal_id, CASE event_id % 2 WHEN 0 THEN 'NFkB' ELSE 'Ifn Response' END AS pretty,
  event_type || '_' || user_id || '_x' AS safe_label, event_type LIKE '%i%' AND event_type NOT LIKE '%up%'
  AS keyword_hit FROM events""")
def signal_ids_and_labels(spark, folder):
    e = F.col("event_id")
    even = e % 2 == 0
    events = b.table(spark, folder, "events")
    return events.select(
        "event_id",
        s.join_key_text(F.when(even, "composition").otherwise("signature"), "event_type",
                        F.when(even, F.lit(" ")).otherwise(
                            F.concat(F.lit("set_"), F.col("user_id") % 3))).alias("signal_id"),
        s.pretty_label(F.when(even, "nfkb_set").otherwise("ifn_response"),
                       {"nfkb_set": "NFkB"}).alias("pretty"),
        s.path_label(F.concat("event_type", F.lit(" /"), "user_id", F.lit(" (x)"))).alias("safe_label"),
        s.matches_keywords("event_type", ["I"], ["up"]).alias("keyword_hit"))


@query("effect_direction_and_interval", """SELECT event_id, CASE WHEN e > 0 THEN 1 WHEN e < 0 THEN -1
  ELSE 0 END::INTEGER AS direction, coalesce(e - 40 > 0 OR e + 40 < 0, false) AS excludes_zero,
  CASE WHEN e > 0 THEN 'increase_with_age' ELSE 'decrease_with_age' END AS label
 FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value - 50 END AS e FROM events)""")
def effect_direction_and_interval(spark, folder):
    e = F.when(F.col("event_id") % 11 != 0, F.col("value") - 50)
    return b.table(spark, folder, "events").select("event_id", e.alias("e")).select(
        "event_id", s.effect_direction("e").alias("direction"),
        s.interval_excludes_zero(F.col("e") - 40, F.col("e") + 40).alias("excludes_zero"),
        s.direction_label("e").alias("label"))


AGE_EDGES = (25, 35, 45, 55, 62)


@query("age_bins_and_decades", f"""WITH {b.CELLS_A} SELECT cell_id,
 CASE WHEN age >= 25 AND age < 35 THEN '25-35' WHEN age >= 35 AND age < 45 THEN '35-45'
  WHEN age >= 45 AND age < 55 THEN '45-55' WHEN age >= 55 AND age < 62 THEN '55-62' END AS age_bin,
 (floor(age / 10) * 10)::INTEGER AS age_decade, round(age / 10, 8) AS age_scaled,
 round((age - (SELECT avg(age) FROM cells)) / 10, 8) AS age_centred FROM cells""")
def age_bins_and_decades(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "age")
    mean = cells.agg(F.avg("age").alias("m")).scalar()
    return b.rounded(cells.select(
        "cell_id", s.age_bin("age", AGE_EDGES).alias("age_bin"),
        s.age_decade_floor("age").alias("age_decade"), (F.col("age") / 10).alias("age_scaled"),
        ((F.col("age") - mean) / 10).alias("age_centred")), 8)


@query("log_normalised_counts", f"""WITH {b.COUNTS_B}, t AS (SELECT cell_id, sum(count) AS total
  FROM counts GROUP BY 1) SELECT cell_id, gene_id, round(ln(1 + count * 10000.0::DOUBLE / total), 8) AS x
 FROM counts JOIN t USING (cell_id)""")
def log_normalised_counts(spark, folder):
    counts = b.counts_b(spark, folder)
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    return b.rounded(counts.join(totals, "cell_id").select(
        "cell_id", "gene_id", s.log_normalise("count", "total", 1e4).alias("x")), 8)


@query("canonical_id_promotion", f"""WITH {b.CELLS_A} SELECT count(*) AS n_cells, count(DISTINCT
  sample_unit_id) AS n_sample_units, count(DISTINCT subject_id) AS n_subjects,
  count(*) FILTER (sample_unit_id IS NULL) AS n_missing FROM cells""")
def canonical_id_promotion(spark, folder):
    cells = b.cells_a(spark, folder).withColumnRenamed("sample_unit_id", "tube")
    promoted = cells.withColumn("sample_unit_id", s.clean_text("tube"))
    return promoted.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("sample_unit_id").alias("n_sample_units"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_if(F.col("sample_unit_id").isNull()).alias("n_missing"))


@query("sorted_parameter_json", """SELECT event_id, '{"alpha":"' || event_type || '","beta":"' || user_id
  || '"}' AS params FROM events""")
def sorted_parameter_json(spark, folder):
    params = F.create_map(F.lit("beta"), F.col("user_id").cast("string"), F.lit("alpha"), "event_type")
    return b.table(spark, folder, "events").select("event_id", s.sorted_json(params).alias("params"))


@query("renamed_output_columns",
       "SELECT event_id AS cell_id, user_id AS donor_id, value AS score FROM events")
def renamed_output_columns(spark, folder):
    return b.table(spark, folder, "events").withColumnsRenamed(
        {"event_id": "cell_id", "user_id": "donor_id", "value": "score"}).drop("ts", "props", "event_type")


# ---- matrix quality control -------------------------------------------------------------------

QC_SQL = f"""{b.COUNTS_B}, {b.GENES_B}, m AS (SELECT cell_id, count(*) FILTER (count > 0) AS n_genes,
  sum(count)::BIGINT AS total_counts,
  coalesce(sum(count) FILTER (upper(gene_name) LIKE 'MT-%'), 0)::BIGINT AS mt_counts,
  coalesce(sum(count) FILTER (regexp_matches(upper(gene_name), '^RP[LS]')), 0)::BIGINT AS ribo_counts
  FROM counts JOIN genes USING (gene_id) GROUP BY 1),
 metrics AS (SELECT *, mt_counts * 100.0::DOUBLE / total_counts AS pct_mt,
  ribo_counts * 100.0::DOUBLE / total_counts AS pct_ribo FROM m)"""


@query("qc_metrics", f"""WITH {QC_SQL} SELECT cell_id, n_genes, total_counts, mt_counts, ribo_counts,
 round(pct_mt, 6) AS pct_mt, round(pct_ribo, 6) AS pct_ribo FROM metrics""")
def qc_metrics(spark, folder):
    return b.rounded(qc.qc_metrics(b.counts_b(spark, folder), b.genes_b(spark, folder)))


@query("genes_detected", f"""WITH {b.COUNTS_B} SELECT gene_id, count(*) AS n_cells FROM counts
 WHERE count > 0 GROUP BY 1 HAVING count(*) >= 25""")
def genes_detected(spark, folder):
    return qc.genes_detected_in(b.counts_b(spark, folder), 25)


@query("qc_filtered_cells", f"""WITH {QC_SQL}, kept AS (SELECT gene_id FROM counts WHERE count > 0
  GROUP BY 1 HAVING count(*) >= 25), re AS (SELECT cell_id, count(*) AS n_kept_genes FROM counts
  SEMI JOIN kept USING (gene_id) WHERE count > 0 GROUP BY 1 HAVING count(*) >= 2),
 j AS (SELECT * FROM metrics JOIN re USING (cell_id))
 SELECT cell_id, n_genes, n_kept_genes, total_counts FROM j
 WHERE n_genes < (SELECT quantile_cont(n_genes, 0.98) FROM j) AND pct_mt < 60 AND pct_ribo < 80""")
def qc_filtered_cells(spark, folder):
    out = qc.filter_cells(b.counts_b(spark, folder), b.genes_b(spark, folder), min_cells=25,
                          min_genes=2, upper_quantile=0.98, max_mt=60, max_ribo=80)
    return out.select("cell_id", "n_genes", "n_kept_genes", "total_counts")


@query("qc_stage_off_passthrough", f"""WITH {QC_SQL} SELECT count(*) AS n_cells,
 sum(total_counts)::BIGINT AS total_counts FROM metrics""")
def qc_stage_off(spark, folder):
    out = qc.filter_cells(b.counts_b(spark, folder), b.genes_b(spark, folder), min_cells=25,
                          min_genes=2, enabled=False)
    return out.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("total_counts").alias("total_counts"))


@query("doublets_removed", f"""WITH {b.CELLS_A} SELECT cell_id, cell_type FROM cells
 WHERE NOT (confidence > 0.5 AND confidence - (1 - confidence) > 0.3)""")
def doublets_removed(spark, folder):
    cells = b.cells_a(spark, folder)
    scores = cells.select("cell_id", F.col("confidence").alias("doublet"),
                          (1 - F.col("confidence")).alias("singlet"),
                          (F.col("confidence") > 0.5).alias("is_doublet"))
    return qc.remove_doublets(cells.select("cell_id", "cell_type"), scores, 0.3)


@query("gene_dispersion", f"""WITH {b.COUNTS_B}, n AS (SELECT count(*) AS n FROM orders)
 SELECT gene_id, round(sum(count) / any_value(n), 8) AS mean, round((sum(count * count)::DOUBLE -
  sum(count)::DOUBLE * sum(count) / any_value(n)) / (any_value(n) - 1), 6) AS variance
 FROM counts, n GROUP BY gene_id""")
def gene_dispersion(spark, folder):
    out = qc.gene_dispersion(b.counts_b(spark, folder), b.cells_b(spark, folder).select("cell_id"))
    return out.select("gene_id", F.round("mean", 8).alias("mean"), F.round("variance", 6).alias("variance"))


@query("variable_genes", f"""WITH {b.COUNTS_B}, n AS (SELECT count(*)::DOUBLE AS n FROM orders), d AS (SELECT gene_id, sum(count) / any_value(n) AS mean,
 (sum(count * count)::DOUBLE - sum(count)::DOUBLE * sum(count) / any_value(n)) / (any_value(n) - 1) AS variance FROM counts, n GROUP BY gene_id), g AS (SELECT *,
 log10(mean) AS x, log10(variance) AS y FROM d WHERE variance > 0), c AS (SELECT *, x - avg(x) OVER () AS u FROM g), w AS (SELECT *, u * u - (sum(u * u * u)
 OVER () / sum(u * u) OVER ()) * u - avg(u * u) OVER () AS q FROM c), f AS (SELECT avg(y) AS y0, sum(u * y) / sum(u * u) AS b1, sum(q * y) / sum(q * q) AS b2
 FROM w), t AS (SELECT gene_id, mean, variance, sqrt(10 ** (y0 + b1 * u + b2 * q)) AS sd FROM w, f), z AS (SELECT gene_id, mean, variance, sd, n, sum(least((count
 - mean) / sd, sqrt(n)) ** 2) AS z2, count(*) AS k FROM counts JOIN t USING (gene_id), n GROUP BY ALL), s AS (SELECT gene_id, mean, variance, (z2 + (n - k) *
 (mean / sd) ** 2) / (n - 1) AS v FROM z) SELECT gene_id, round(mean, 8) AS mean, round(variance, 6) AS variance, round(v, 6) AS standardised_variance FROM s
 ORDER BY v DESC, gene_id LIMIT 200""")
def variable_genes(spark, folder):
    out = qc.variable_genes(b.counts_b(spark, folder), b.cells_b(spark, folder).select("cell_id"), 200)
    return out.select("gene_id", F.round("mean", 8).alias("mean"), F.round("variance", 6).alias("variance"),
                      F.round("standardised_variance", 6).alias("standardised_variance"))


@query("count_matrix_scan", f"""WITH {b.COUNTS_B} SELECT count(*) AS n_entries, 0::BIGINT AS n_non_finite,
 count(*) FILTER (count < 0) AS n_negative, 0::BIGINT AS n_fractional, min(count) AS min_count,
 max(count) AS max_count, sum(count)::BIGINT AS total_count,
 (SELECT count(*) FROM counts c ANTI JOIN (SELECT p_partkey AS gene_id FROM part WHERE p_size <> 50) g
  USING (gene_id)) AS n_unknown_gene,
 (SELECT count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey) AS n_zero_library_cells
 FROM counts""")
def count_matrix_scan(spark, folder):
    known = b.table(spark, folder, "part").where("p_size <> 50").select(F.col("p_partkey").alias("gene_id"))
    return qc.scan_counts(b.counts_b(spark, folder),
                          b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("cell_id")), known)


@query("cell_library_sizes", f"""WITH {b.COUNTS_B} SELECT o_orderkey AS cell_id,
 coalesce(sum(count), 0)::BIGINT AS library_size FROM orders LEFT JOIN counts ON cell_id = o_orderkey
 GROUP BY 1""")
def cell_library_sizes(spark, folder):
    cells = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("cell_id"))
    return qc.library_sizes(b.counts_b(spark, folder), cells)
