"""Reading cell tables, delimited metadata and count layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortroll.functions.resolve import require_columns, resolve_column


def read_cells(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Cell metadata only: the scan reads the listed columns and nothing else."""
    df = spark.read.parquet(path)
    require_columns(df.columns, columns, path)
    return df.select(*columns)


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: StructType | str,
                   sep: str | None = None) -> DataFrame:
    """Delimited metadata with a header and a declared schema; tab for .tsv and .txt names."""
    first = path if isinstance(path, str) else path[0]
    if sep is None:
        sep = "\t" if first.endswith((".tsv", ".txt", ".tsv.gz", ".txt.gz")) else ","
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def read_resolved(spark: SparkSession, path: str, wanted: Sequence[str], sep: str = ",") -> DataFrame:
    """Header first, then only the columns the wanted names resolve to, under those names."""
    header = spark.read.option("header", True).option("sep", sep).csv(path)
    found = {w: resolve_column(header.columns, w) for w in wanted}
    require_columns([w for w, c in found.items() if c], wanted, path)
    return header.select(*[F.col(f"`{c}`").alias(w) for w, c in found.items()])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def choose_layer(counts: DataFrame, layer: str | None, preferred: Sequence[str] = ("counts",)):
    """``None`` or ``X`` is the main layer, ``auto`` the first preferred one present, else by name.

    ``auto`` asks for one layer after the other and stops at the first that has a row; the others are not read again.
    """
    if layer in (None, "X"):
        return counts.where(F.col("layer") == "X").drop("layer")
    if layer != "auto":
        return counts.where(F.col("layer") == layer).drop("layer")
    for name in (*preferred, "X"):
        chosen = counts.where(F.col("layer") == name)
        if not chosen.isEmpty():
            break
    return chosen.drop("layer")


def vectors_to_long(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Dense vectors to (key, dim, value) rows; zeros are left out."""
    return df.select(key, F.posexplode(vector).alias("dim", "value")).where("value <> 0")


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """``-k`` appended to the k-th repeat of a name, in the order of a unique number."""
    from cohortroll.operators.ordering import ordered_number

    ranked = ordered_number(df.withColumn("__o", F.col(order).cast("double")), "__o", [name], "__k")
    suffix = F.concat(F.col(name), F.lit("-"), (F.col("__k") - 1).cast("string"))
    return ranked.withColumn(out, F.when(F.col("__k") > 1, suffix).otherwise(F.col(name))).drop(
        "__k", "__o")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """All scenario results as one table; the scenario is the partition column."""
    return spark.read.parquet(path)
