"""The given tables seen as the logical tables of this library, in Spark and in SQL.

A: ``events`` as cells of users sampled by week. B: the order star as cells (orders) with sparse
counts (line quantities per part or brand). V: ``embeddings`` as latent vectors. D: ``documents``
with ``labels`` as a lookup that covers only part of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortroll.session import dealt


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cells_a(spark, folder) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("cell_id"),
        F.concat(F.lit("U"), user).alias("subject_id"),
        F.concat(F.lit("U"), user, F.lit("-W"), week).alias("sample_unit_id"),
        F.col("event_type").alias("cell_type"),
        (F.col("value") / 500).alias("confidence"),
        (F.lit(20.0) + user % 45 + week / 52).alias("age"),
        F.when(user % 2 == 0, "F").otherwise("M").alias("sex"),
        F.concat(F.lit("B"), user % 4).alias("batch"),
        F.concat(F.lit("L"), F.col("event_id") % 6).alias("library"),
        F.concat(F.lit("K"), (F.col("value") * 100).cast("bigint") % 7).alias("cluster"),
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("bigint").alias("k"),
        F.col("value"))


CELLS_A = """cells AS (SELECT event_id AS cell_id, 'U' || user_id AS subject_id,
  'U' || user_id || '-W' || wk AS sample_unit_id, event_type AS cell_type,
  value / 500 AS confidence, 20.0::DOUBLE + user_id % 45 + wk / 52 AS age,
  CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex, 'B' || (user_id % 4) AS batch,
  'L' || (event_id % 6) AS library, 'K' || (trunc(value * 100)::BIGINT % 7) AS cluster,
  regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k, value
 FROM (SELECT *, (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INTEGER AS wk FROM events))"""


def genes_b(spark, folder) -> DataFrame:
    """Gene catalogue from ``part``: a mixed-case name with mitochondrial and ribosomal prefixes."""
    size = F.col("p_size") % 10
    prefix = F.when(size == 0, "MT-").when(size == 1, "rps").when(size == 2, "RPL").otherwise("G")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("gene_id"), F.concat(prefix, F.col("p_partkey")).alias("gene_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("family"))


GENES_B = """genes AS (SELECT p_partkey AS gene_id, (CASE p_size % 10 WHEN 0 THEN 'MT-' WHEN 1 THEN 'rps'
  WHEN 2 THEN 'RPL' ELSE 'G' END) || p_partkey AS gene_name, p_brand AS brand, p_type AS family
 FROM part)"""


def cells_b(spark, folder) -> DataFrame:
    """Orders as cells; customers as subjects; customer-years as sample units."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    year = F.year("o_orderdate")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("cell_id"),
            F.concat(F.lit("C"), "o_custkey").alias("subject_id"),
            F.concat(F.lit("C"), "o_custkey", F.lit("-"), year).alias("sample_unit_id"),
            F.substring("o_orderpriority", 3, 20).alias("raw_label"),
            F.col("o_orderstatus").alias("cell_type"),
            (F.lit(20.0) + F.col("o_custkey") % 45 + (year - 1995)).alias("age"),
            F.col("c_mktsegment").alias("sex"), F.col("r_name").alias("batch"),
            F.concat(F.lit("L"), F.col("o_orderkey") % 7).alias("library"),
            (F.col("o_totalprice") / 600000).alias("confidence"),
            F.concat(F.lit("K"), F.col("o_orderkey") % 9).alias("cluster"),
            F.col("o_totalprice").alias("value")))


CELLS_B = """cells AS (SELECT o_orderkey AS cell_id, 'C' || o_custkey AS subject_id,
  'C' || o_custkey || '-' || year(o_orderdate) AS sample_unit_id,
  substring(o_orderpriority, 3, 20) AS raw_label, o_orderstatus AS cell_type,
  20.0::DOUBLE + o_custkey % 45 + (year(o_orderdate) - 1995) AS age, c_mktsegment AS sex,
  r_name AS batch, 'L' || (o_orderkey % 7) AS library, o_totalprice / 600000 AS confidence,
  'K' || (o_orderkey % 9) AS cluster, o_totalprice AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey)"""


def counts_b(spark, folder, gene: str = "part") -> DataFrame:
    """Sparse counts: order x part (or brand) with summed line quantity; (cell, gene) is unique. Large ones lie by cell."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    n_lines = lines.count()  # from the files' footers
    gene_col = F.col("l_partkey")
    if gene == "brand":
        part = table(spark, folder, "part").select("p_partkey", "p_brand")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        gene_col = F.col("p_brand")
    return dealt(lines, n_lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("cell_id"), gene_col.alias("gene_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("count"))


COUNTS_B = """counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id,
  sum(l_quantity)::BIGINT AS count FROM lineitem GROUP BY ALL)"""
COUNTS_BRAND = """counts AS (SELECT l_orderkey AS cell_id, p_brand AS gene_id,
  sum(l_quantity)::BIGINT AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def vectors(spark, folder) -> DataFrame:
    """Latent vectors; 40 vectors share a subject at small scale and visits repeat per subject."""
    v = F.col("vec_id")
    subject = v % 97
    return table(spark, folder, "embeddings").select(
        v.alias("cell_id"), F.concat(F.lit("S"), subject).alias("subject_id"),
        F.concat(F.lit("S"), subject, F.lit("-"), F.floor(v / 97) % 2).alias("sample_unit_id"),
        F.col("label").alias("cell_type"),
        (F.lit(25.0) + subject % 50 + F.floor(v / 97) % 2).alias("age"),
        F.col("embedding").alias("vec"))


VECTORS = """vecs AS (SELECT vec_id AS cell_id, 'S' || (vec_id % 97) AS subject_id,
  'S' || (vec_id % 97) || '-' || ((vec_id // 97) % 2) AS sample_unit_id, label AS cell_type,
  25.0::DOUBLE + (vec_id % 97) % 50 + (vec_id // 97) % 2 AS age, embedding AS vec FROM embeddings)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; sums in another order differ in the last bits."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def exact_mean(cents: str) -> Column:
    """Mean of a column of whole hundredths from whole sums, the same in any order of rows."""
    return F.sum(F.round(F.col(cents) * 100).cast("bigint")) / (F.count(cents) * 100)


def exact_mean_sql(cents: str) -> str:
    return f"sum(round({cents} * 100)::BIGINT) / (count({cents}) * 100)"


def half_up(name: str, digits: int) -> Column:
    """Rounded by plain arithmetic: engines round a double half-way between two results differently."""
    return (F.floor(F.col(name) * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)).alias(name)


def half_up_sql(name: str, digits: int) -> str:
    return f"floor({name} * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE AS {name}"
