"""Count-matrix quality control on the long (cell, gene, count) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.scalar import gene_flags
from cohortroll.session import keep


def qc_metrics(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Per cell, over all genes: detected genes, total counts, percent in the flagged sets."""
    mito, ribo = gene_flags("gene_name")
    flagged = genes.select("gene_id", mito.alias("is_mt"), ribo.alias("is_ribo"))
    c = F.col("count")
    return (
        counts.join(flagged, "gene_id", "left").groupBy("cell_id").agg(
            F.count_if(c > 0).alias("n_genes"),
            F.sum("count").alias("total_counts"),
            F.sum(F.when(F.col("is_mt"), c).otherwise(0)).alias("mt_counts"),
            F.sum(F.when(F.col("is_ribo"), c).otherwise(0)).alias("ribo_counts"),
        )
        .withColumn("pct_mt", F.try_divide(F.col("mt_counts") * 100.0, F.col("total_counts")))
        .withColumn("pct_ribo", F.try_divide(F.col("ribo_counts") * 100.0, F.col("total_counts")))
    )


def genes_detected_in(counts: DataFrame, min_cells: int) -> DataFrame:
    """Genes seen in at least ``min_cells`` cells ((cell, gene) is unique in ``counts``)."""
    return counts.where("count > 0").groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)


def filter_cells(counts: DataFrame, genes: DataFrame, *, min_cells: int, min_genes: int,
                 upper_quantile: float | None = None, max_mt: float | None = None,
                 max_ribo: float | None = None, enabled: bool = True) -> DataFrame:
    """Gene filter, then cell filter on kept genes, then the upper cut and percent caps.

    Metrics come from all genes, the detected-gene recount from kept genes, and the quantile from
    the cells that survive the recount. Order matters and is fixed.
    """
    metrics = qc_metrics(counts, genes)
    if not enabled:
        return metrics
    kept_genes = genes_detected_in(counts, min_cells).select("gene_id")
    recount = counts.where("count > 0").join(kept_genes, "gene_id", "left_semi") \
        .groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_kept_genes")) \
        .where(F.col("n_kept_genes") >= min_genes)
    out = metrics.join(recount, "cell_id")
    if upper_quantile is not None:
        # Quantile from value counts: the exact percentile over a folded table.
        cut = out.groupBy("n_genes").agg(F.count(F.lit(1)).alias("w")) \
            .agg(F.percentile("n_genes", F.lit(upper_quantile), F.col("w")).alias("cut"))
        out = out.where(F.col("n_genes") < cut.scalar())
    if max_mt is not None:
        out = out.where(F.col("pct_mt") < max_mt)
    if max_ribo is not None:
        out = out.where(F.col("pct_ribo") < max_ribo)
    return out


def scan_counts(counts: DataFrame, cells: DataFrame, genes: DataFrame,
                tolerance: float = 1e-6) -> DataFrame:
    """One row describing the whole matrix; the counts table is read once for the totals."""
    v = F.col("count").cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    totals = counts.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(~finite).alias("n_non_finite"),
        F.count_if(v < 0).alias("n_negative"),
        F.count_if(finite & (F.abs(v - F.round(v)) > tolerance)).alias("n_fractional"),
        F.min("count").alias("min_count"), F.max("count").alias("max_count"),
        F.sum("count").alias("total_count"))
    unknown = counts.join(genes.select("gene_id"), "gene_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("n"))
    empty = cells.join(counts.where("count > 0").select("cell_id"), "cell_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("n"))
    return totals.withColumn("n_unknown_gene", unknown.scalar()) \
        .withColumn("n_zero_library_cells", empty.scalar())


def library_sizes(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Per-cell total, zero for a cell without entries."""
    sums = counts.groupBy("cell_id").agg(F.sum("count").alias("library_size"))
    return cells.select("cell_id").join(sums, "cell_id", "left").fillna(0, ["library_size"])


def remove_doublets(cells: DataFrame, scores: DataFrame, threshold: float,
                    min_cells: int | None = None) -> DataFrame:
    """Drops cells called doublets whose score gap passes the threshold.

    With ``min_cells``, a set of fewer cells stays whole, as its scores had too little to learn from.
    """
    bad = scores.where(F.col("is_doublet") & (F.col("doublet") - F.col("singlet") > threshold))
    if min_cells is not None:
        bad = bad.where(cells.agg(F.count(F.lit(1)).alias("n")).scalar() >= min_cells)
    bad = bad.select("cell_id")
    return cells.join(bad, "cell_id", "left_anti")


def gene_dispersion(counts: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Mean and sample variance of raw counts per gene, zeros included."""
    n = n_cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = counts.groupBy("gene_id").agg(
        F.sum(F.col("count").cast("double")).alias("s1"),
        F.sum(F.col("count").cast("double") * F.col("count")).alias("s2"))
    return sums.withColumn("n", n).select(
        "gene_id", (F.col("s1") / F.col("n")).alias("mean"),
        ((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1)).alias("variance"))


def variable_genes(counts: DataFrame, cells: DataFrame, n_top: int) -> DataFrame:
    """Top genes by clipped standardised variance around a quadratic log-variance trend.

    The trend is least squares of log10 variance on log10 mean and its square, from five sums
    over genes; clipping at sqrt(n) bounds what one cell can add, and needs only the entries.
    """
    disp = keep(gene_dispersion(counts, cells).where("variance > 0"), "dispersion")
    logs = disp.withColumn("x", F.log10("mean")).withColumn("y", F.log10("variance"))
    sums = logs.agg(*[F.sum(F.pow("x", F.lit(k))).alias(f"x{k}") for k in range(5)],
                    *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"y{k}") for k in range(3)])

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    s = {n: F.col(n) for n in sums.columns}
    m = [s["x0"], s["x1"], s["x2"], s["x1"], s["x2"], s["x3"], s["x2"], s["x3"], s["x4"]]
    base = det(*m)

    def solved(col):
        cells_ = list(m)
        for row in range(3):
            cells_[row * 3 + col] = s[f"y{row}"]
        return F.try_divide(det(*cells_), base)

    fit = sums.select(F.struct(*[F.coalesce(solved(k), F.lit(0.0)).alias(f"b{k}") for k in range(3)])
                      .alias("fit")).scalar()
    n = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    trend = logs.withColumn("fit", fit).withColumn("n_cells", n).withColumn(
        "sd", F.sqrt(F.pow(F.lit(10.0), F.col("fit.b0") + F.col("fit.b1") * F.col("x")
                           + F.col("fit.b2") * F.col("x") * F.col("x"))))
    z = F.least((F.col("count") - F.col("mean")) / F.col("sd"), F.sqrt("n_cells"))
    zero = -F.col("mean") / F.col("sd")
    scored = counts.join(trend, "gene_id").groupBy("gene_id", "mean", "variance", "sd", "n_cells").agg(
        F.sum(z).alias("z1"), F.sum(z * z).alias("z2"), F.count(F.lit(1)).alias("k"))
    total2 = F.col("z2") + (F.col("n_cells") - F.col("k")) * zero * zero
    scored = scored.select("gene_id", "mean", "variance",
                           (total2 / (F.col("n_cells") - 1)).alias("standardised_variance"))
    return scored.orderBy(F.desc("standardised_variance"), "gene_id").limit(n_top)
