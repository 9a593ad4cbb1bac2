"""Ranks, running totals and false-discovery control without a one-task window.

A plain window over a whole family (all tests, all cells of a type) sorts that family in one task.
Here values are first folded to distinct values with counts, then cut into ordered buckets by a
fixed rule on the value, ranked inside a bucket, and shifted by the small table of bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortroll.functions.scalar import hash_int
from cohortroll.session import cut_lineage

ONE_FAMILY = "__all"


def order_bucket(value: Column, parts: int = 256) -> Column:
    """Bucket number that never decreases with the value: octave of the size, then ``parts`` steps.

    Depends on the value alone, so a recomputed task always gives the same buckets. Infinities have the
    first and last bucket of numbers; NaN, which Spark orders last, has one beyond.
    """
    number = value.cast("double")
    size = F.abs(number)
    octave = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * parts)
    key = (octave + 1100) * parts + step
    end = F.lit(1 << 60)
    return (F.when(F.isnan(number), end + 1).when(number == float("inf"), end).when(number == float("-inf"), -end)
            .when(size == 0, F.lit(0)).otherwise((F.signum(value) * key).cast("bigint")).cast("bigint"))


def _family(df: DataFrame, family: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if family:
        return df, list(family)
    return df.withColumn(ONE_FAMILY, F.lit(0)), [ONE_FAMILY]


def running_counts(df: DataFrame, value: str, family: Sequence[str] = (),
                   weight: Column | None = None) -> DataFrame:
    """One row per distinct value and family: ``n``, ``n_upto`` (inclusive) and ``n_total``.

    With ``weight`` the counts are sums of it.
    """
    df, fam = _family(df.where(F.col(value).isNotNull()), family)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    folded = (
        df.groupBy(*fam, value).agg(size.alias("n"))
        .withColumn("__bucket", order_bucket(F.col(value)))
    )
    before = Window.partitionBy(*fam).orderBy("__bucket")
    shifts = (
        folded.groupBy(*fam, "__bucket").agg(F.sum("n").alias("__in_bucket"))
        .select(
            *fam, "__bucket",
            (F.sum("__in_bucket").over(before) - F.col("__in_bucket")).alias("__before"),
            F.sum("__in_bucket").over(Window.partitionBy(*fam)).alias("n_total"),
        )
    )
    inside = Window.partitionBy(*fam, "__bucket").orderBy(value)
    return (
        folded.withColumn("__inside", F.sum("n").over(inside))
        .join(shifts, [*fam, "__bucket"])
        .select(*fam, value, "__bucket", "n",
                (F.col("__before") + F.col("__inside")).alias("n_upto"), "n_total")
    )


def average_rank(df: DataFrame, value: str | Sequence[str], family: Sequence[str],
                 out: str | Sequence[str]) -> DataFrame:
    """Adds the tie-averaged rank of each value inside its family (null stays null)."""
    df, fam = _family(df, family)
    result = df
    pairs = [(value, out)] if isinstance(value, str) else list(zip(value, out))
    for col, name in pairs:
        ranks = running_counts(df, col, fam).select(
            *fam, col, (F.col("n_upto") - (F.col("n") - 1) / 2.0).alias(name))
        result = result.join(ranks, [*fam, col], "left")
    return result.drop(ONE_FAMILY)


def _bh_table(df: DataFrame, fam: Sequence[str], out: str) -> DataFrame:
    """Adjusted value per family and distinct p."""
    steps = running_counts(df, "__p", fam).withColumn(
        "__raw", F.col("__p") * F.col("n_total") / F.col("n_upto"))
    after = Window.partitionBy(*fam).orderBy(F.desc("__bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    later = (
        steps.groupBy(*fam, "__bucket").agg(F.min("__raw").alias("__low"))
        .select(*fam, "__bucket", F.min("__low").over(after).alias("__later"))
    )
    inside = Window.partitionBy(*fam, "__bucket").orderBy(F.desc("__p")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        steps.withColumn("__here", F.min("__raw").over(inside))
        .join(later, [*fam, "__bucket"])
        .select(*fam, "__p", F.least(F.lit(1.0), "__here", "__later").alias(out))
    )


def bh_fdr(df: DataFrame, p: str, outputs: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Benjamini-Hochberg; ``outputs`` maps a new column to its family (none: all rows).

    Non-finite p stays null and is not counted. All families are worked out from the input
    itself, not from each other's results.
    """
    base = df.withColumn(ONE_FAMILY, F.lit(0)).withColumn(
        "__p", F.when(~F.isnan(p) & (F.abs(p) != float("inf")), F.col(p).cast("double")))
    result = base
    for out, family in (outputs or {"fdr": ()}).items():
        fam = list(family) or [ONE_FAMILY]
        result = result.join(_bh_table(base.select(*fam, "__p"), fam, out), [*fam, "__p"], "left")
    return result.drop("__p", ONE_FAMILY)


def number_with_ties(df: DataFrame, value: str, family: Sequence[str], tie: str, out: str):
    """1..n by ``value``, then by ``tie``; only rows equal in ``value`` meet in one window."""
    df, fam = _family(df, family)
    less = running_counts(df, value, fam).select(
        *fam, value, (F.col("n_upto") - F.col("n")).alias("__less"))
    w = Window.partitionBy(*fam, value).orderBy(tie)
    return df.join(less, [*fam, value]).withColumn(
        out, F.col("__less") + F.row_number().over(w)).drop("__less", ONE_FAMILY)


def hashed_number(df: DataFrame, ids: Sequence[str], family: Sequence[str], out: str) -> DataFrame:
    """1..n inside the family by (hash of ids, ids): any id type, evenly cut buckets."""
    df = df.withColumn("__h", hash_int(*ids).cast("double")).withColumn("__id", join_ids(ids))
    return number_with_ties(df, "__h", family, "__id", out).drop("__h", "__id")


def join_ids(ids: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(i).cast("string") for i in ids])


def running_position(df: DataFrame, value: str, ids: Sequence[str], out: str,
                     before: str | None = None) -> DataFrame:
    """Position by ``value`` with ties in hash order of ``ids``; null values get no position.

    ``before`` also gives the sum of ``-value`` over all earlier rows (for descending budgets).
    """
    some = df.where(F.col(value).isNotNull())
    inside = hashed_number(some.select(*ids, value), ids, [value], "__in")
    less = running_counts(some, value).select(value, (F.col("n_upto") - F.col("n")).alias("__less"))
    pos = inside.join(less, value).withColumn(out, F.col("__less") + F.col("__in"))
    keep = [*ids, out]
    if before:
        sums = running_counts(some, value, weight=-F.col(value)).select(
            value, (F.col("n_upto") - F.col("n")).alias("__sum"))
        pos = pos.join(sums, value).withColumn(
            before, F.col("__sum") - F.col(value) * (F.col("__in") - 1))
        keep.append(before)
    return df.join(pos.select(*keep), list(ids), "left")


def ordered_number(df: DataFrame, value: str, family: Sequence[str] = (), out: str = "position"):
    """1..n by a numeric column that is unique inside its family."""
    df, fam = _family(df, family)
    ranks = running_counts(df, value, fam).select(*fam, value, F.col("n_upto").alias(out))
    return df.join(ranks, [*fam, value]).drop(ONE_FAMILY)


def sorted_position(df: DataFrame, order: Sequence[str | Column], out: str = "position"):
    """1..n in a total order over any columns: one range sort, kept, then per-partition shifts.

    The sorted rows are written once to the shared folder, so both readings of the partition
    layout below see the same rows even if an executor is lost.
    """
    kept = cut_lineage(df.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    kept = kept.withColumn("__part", part)
    w = Window.orderBy("__part")
    shifts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    return (
        kept.join(F.broadcast(shifts), "__part")  # one row per partition
        .withColumn(out, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1)
        .drop("__at", "__part", "__before")
    )


def earliest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group by ``order``: a mergeable minimum, so a hot group is not one sort.

    An unknown value never wins over a known one: null comes last in each order column, NaN before it.
    """
    rest = [c for c in df.columns if c not in group and c not in order]
    keys = [k for i, c in enumerate(order) for k in (F.col(c).isNull().alias(f"__null{i}"), F.col(c))]
    best = F.min(F.struct(*keys, *rest)).alias("__best")
    return df.groupBy(*group).agg(best).select(
        *[F.col(g) if g in group else F.col(f"__best.{g}").alias(g) for g in df.columns])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int,
                  out: str = "rank") -> DataFrame:
    """Best ``limit`` rows per group; Spark keeps only ``limit`` per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= limit)
