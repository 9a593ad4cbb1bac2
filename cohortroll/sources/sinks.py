"""Writers. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import path_label
from cohortroll.operators.ordering import sorted_position
from cohortroll.session import keep


def write_delimited(df: DataFrame, path: str, sep: str = ",", gzip: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_groups(df: DataFrame, group: str, path: str) -> DataFrame:
    """One folder per group plus the manifest (group, rows, relative path).

    Rows are spread by group and a few hash slots, so a group with most rows has several writers.
    """
    labelled = df.withColumn("group_path", path_label(group))
    slots = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    labelled.repartition(group, slots).write.mode("overwrite").partitionBy("group_path").parquet(path)
    return group_manifest(df, group)


def group_manifest(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "relative_path", F.concat(F.lit("group_path="), path_label(group)))


def coordinate_matrix(sums: DataFrame, row_key: str, col_key: str, value: str = "count"):
    """1-based (row, col, value) entries with their row and column dimension tables; the sums are worked out once for all three."""
    sums = keep(sums.select(row_key, col_key, value), "sums")
    rows = sorted_position(sums.select(row_key).distinct(), [row_key], "row")
    cols = sorted_position(sums.select(col_key).distinct(), [col_key], "col")
    entries = sums.join(rows, row_key).join(cols, col_key).select("row", "col", value)
    return entries, rows, cols


def write_coordinate(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").option("sep", " ").option("compression", "gzip").csv(path)


def read_coordinate(spark, path: str, value: str = "count") -> DataFrame:
    """The entries that ``write_coordinate`` wrote. A line that is no entry is an error."""
    return spark.read.option("sep", " ").option("mode", "FAILFAST").schema(f"row bigint, col bigint, {value} bigint").csv(path)


def matrix_source_checks(entries: DataFrame, rows: DataFrame, cols: DataFrame, library: DataFrame) -> DataFrame:
    """``name, n, passed``: what of a matrix that was read back doesn't fit its dimension tables and library sizes.

    ``n`` counts entries outside the tables, entries that stand twice, rows and columns without an entry, and profiles whose row
    doesn't sum up to their library size (a profile without a row has sum 0, one without a library size fits none).
    """
    key = rows.columns[0]
    entries = keep(entries, "entries")  # a written matrix is parsed once, not for each check
    outside = lambda table, c: entries.join(table.select(c), c, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    empty = lambda table, c: table.join(entries.select(c), c, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    twice = entries.groupBy("row", "col").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    sums = entries.groupBy("row").agg(F.sum("count").alias("total"))
    off = rows.join(sums, "row", "left").join(library, key, "left").where(~F.col("library_size").eqNullSafe(F.coalesce("total", F.lit(0))))
    found = {"rows_outside": outside(rows, "row"), "columns_outside": outside(cols, "col"), "rows_without_entry": empty(rows, "row"),
             "columns_without_entry": empty(cols, "col"), "repeated_entries": twice, "row_sums_off": off.agg(F.count(F.lit(1)).alias("n"))}
    out = None
    for name, n in found.items():
        part = n.select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n"), (F.col("n") == 0).alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out


def matrix_checks(entries: DataFrame, rows: DataFrame, cols: DataFrame, library: DataFrame):
    """Read-back checks: index ranges fit the dimension tables, row sums equal library sizes."""
    entries = keep(entries, "entries")
    span = entries.agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))
    sums = entries.groupBy("row").agg(F.sum("count").alias("total"))
    off = rows.join(sums, "row", "left").join(library, rows.columns[0], "left").where(
        F.coalesce("total", F.lit(0)) != F.coalesce("library_size", F.lit(0)))
    n = F.count(F.lit(1)).alias("n")
    return (
        span.withColumn("n_rows", rows.agg(n).scalar()).withColumn("n_cols", cols.agg(n).scalar())
        .withColumn("n_sum_mismatches", off.agg(n).scalar())
        .select(F.inline(F.array(
            F.struct(F.lit("rows_match_profiles").alias("name"),
                     (F.col("max_row") == F.col("n_rows")).alias("passed")),
            F.struct(F.lit("columns_match_genes").alias("name"),
                     (F.col("max_col") == F.col("n_cols")).alias("passed")),
            F.struct(F.lit("row_sums_match_library_size").alias("name"),
                     (F.col("n_sum_mismatches") == 0).alias("passed")))))
    )
