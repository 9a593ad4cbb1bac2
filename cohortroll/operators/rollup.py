"""Roll-ups of cells to sample units, types and labels.

Median, mode and quantiles are taken from folded (value, count) tables with weights, so a unit
holding a third of all cells is reduced by map-side partial counts before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortroll.functions.scalar import age_bin, age_bin_order
from cohortroll.operators.joins import structural_zero_grid
from cohortroll.operators.ordering import ONE_FAMILY, running_counts
from cohortroll.session import dealt, keep


def fold(df: DataFrame, keys: Sequence[str], *values: str, weight: str | None = None,
         n: str = "n") -> DataFrame:
    """Distinct value combinations with their counts (or summed ``weight``)."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, *values).agg(size.alias(n))


def group_mode(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None,
               empty: str | None = "NA", weight: str | None = None) -> DataFrame:
    """Most frequent non-null value, the smallest on ties; ``empty`` when there is none."""
    counts = fold(df, keys, value, weight=weight)
    has = F.col(value).isNotNull()
    best = F.min(F.when(has, F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))))
    picked = best["v"]
    if empty is not None:
        picked = F.coalesce(picked.cast("string"), F.lit(empty))
    return counts.groupBy(*keys).agg(picked.alias(out or value))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    weight: str | None = None):
    """Exact linear-interpolated quantiles per group from (value, count) rows, for values that take few
    distinct values in a group (an attribute of a sample, small counts)."""
    counts = fold(df.where(F.col(value).isNotNull()), keys, value, weight=weight)
    return counts.groupBy(*keys).agg(*[
        F.percentile(value, F.lit(p), F.col("n")).alias(name) for name, p in probs.items()])


def wide_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                   weight: str | None = None) -> DataFrame:
    """The same quantiles where a group may have very many distinct values: the values at the two
    ranks next to each quantile are read off running counts, so no group's values meet in one task."""
    size = None if weight is None else F.col(weight)
    ranks = running_counts(df.where(F.col(value).isNotNull()), value, keys, weight=size)
    fam = list(keys) or [ONE_FAMILY]
    v, first, last = F.col(value).cast("double"), F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    picks = []
    for name, p in probs.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= pos) & (pos <= last), v)).alias(f"__{side}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"__at_{name}"))
    out = ranks.groupBy(*fam).agg(*picks)
    return out.select(*keys, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__at_{n}")).alias(n) for n in probs])


def _join_all(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "left"), frames)


def sample_totals(folded: DataFrame, keys: Sequence[str], covariates: Sequence[str], min_cells: int,
                  size: str = "total_cells") -> DataFrame:
    """Size, median age, mode subject and mode covariates per group with enough cells.

    ``folded`` has one row per distinct attribute combination with its count ``n``.
    """
    base = folded.groupBy(*keys).agg(F.sum("n").alias(size)).where(F.col(size) >= min_cells)
    age = group_quantiles(folded, keys, "age", {"age": 0.5}, weight="n")
    modes = [group_mode(folded, keys, c, weight="n") for c in ("subject_id", *covariates)]
    return _join_all([base, age, *modes], keys)


def sample_fractions(cells: DataFrame, sample: str = "sample_unit_id",
                     covariates: Sequence[str] = (), min_cells: int = 200) -> DataFrame:
    """Fraction of each type in each sample over the full grid; structural zeros included.

    The cells are read once, into counts per distinct (sample, type, attributes), which are written for all that read them.
    """
    folded = keep(fold(cells, [sample], "cell_type", "age", "subject_id", *covariates), "folded")
    totals = sample_totals(folded, [sample], covariates, min_cells)
    counts = folded.groupBy(sample, "cell_type").agg(F.sum("n").alias("n_cells"))
    kept = counts.join(totals.select(sample), sample, "left_semi").select("cell_type")
    grid = structural_zero_grid(totals, counts, sample, kept)
    return grid.withColumn("fraction", F.col("n_cells") / F.col("total_cells"))


def fraction_sum_violations(fractions: DataFrame, sample: str, tolerance: float = 1e-12):
    sums = fractions.groupBy(sample).agg(F.sum("fraction").alias("fraction_sum"))
    return sums.where(F.abs(F.col("fraction_sum") - 1) > tolerance)


def group_means(cells: DataFrame, keys: Sequence[str], scores: Sequence[str],
                covariates: Sequence[str], min_cells: int) -> DataFrame:
    """Mean scores, median age, mode subject and covariates, and size per group."""
    folded = cells.groupBy(*keys, "age", "subject_id", *covariates).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"__s_{s}") for s in scores],
        *[F.count(s).alias(f"__c_{s}") for s in scores])
    means = folded.groupBy(*keys).agg(*[
        F.try_divide(F.sum(f"__s_{s}"), F.sum(f"__c_{s}")).alias(s) for s in scores])
    return sample_totals(folded, keys, covariates, min_cells, "n_cells").join(means, list(keys))


def signature_coverage(sets: DataFrame, genes: DataFrame) -> DataFrame:
    """Per gene set: requested, present, and the sorted names on either side."""
    catalogue = genes.select(F.upper("gene_name").alias("key"), F.lit(True).alias("hit")).distinct()
    joined = sets.select("signature", "gene_name", F.upper("gene_name").alias("key")) \
        .join(catalogue, "key", "left")

    def listed(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("gene_name")))), ";")

    return joined.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_genes_requested"),
        F.count_if(F.col("hit").isNotNull()).alias("n_genes_present"),
        listed(F.col("hit").isNotNull()).alias("present_genes"),
        listed(F.col("hit").isNull()).alias("missing_genes"))


def signature_scores(cells: DataFrame, counts: DataFrame, genes: DataFrame, sets: DataFrame,
                     target: float = 1e4, min_genes: int = 3) -> DataFrame:
    """Mean log-normalised expression of each set per cell.

    Totals use every gene. Only entries of requested genes are joined; absent entries count as 0
    through the division by the number of genes present. One row per cell and usable set.
    """
    totals = counts.groupBy("cell_id").agg(F.sum("count").alias("total"))
    members = sets.select("signature", F.upper("gene_name").alias("key")).distinct().join(
        genes.select("gene_id", F.upper("gene_name").alias("key")), "key").select(
        "signature", "gene_id")
    present = members.groupBy("signature").agg(F.count_distinct("gene_id").alias("n_present")) \
        .where(F.col("n_present") >= min_genes)
    sums = (
        counts.join(members, "gene_id").join(totals, "cell_id")
        .groupBy("cell_id", "signature")
        .agg(F.sum(F.log1p(F.try_divide(F.col("count") * target, F.col("total").cast("double"))))
             .alias("s"))
    )
    usable = present.agg(F.array_sort(F.collect_list(F.struct("signature", "n_present"))).alias("u"))
    grid = cells.select("cell_id", F.inline(usable.scalar()))
    return grid.join(sums, ["cell_id", "signature"], "left").select(
        "cell_id", "signature", (F.coalesce("s", F.lit(0.0)) / F.col("n_present")).alias("score"))


def signature_means(cells: DataFrame, n_cells: int, counts: DataFrame, genes: DataFrame, sets: DataFrame, keys: Sequence[str],
                    covariates: Sequence[str], target: float = 1e4, min_genes: int = 3) -> DataFrame:
    """Mean ``signature_scores`` per group and usable set, with the group's size and least covariates; dealt by the first key.

    Counts of other genes only add to their cell's total; a cell brings one row with its few counts of requested genes, and sets
    unfold once cells are in their groups.
    """
    members = sets.select("signature", F.upper("gene_name").alias("key")).distinct().join(
        genes.select("gene_id", F.upper("gene_name").alias("key")), "key").select("signature", "gene_id")
    members = keep(members, "members")
    present = members.groupBy("signature").agg(F.count_distinct("gene_id").alias("n_present")).where(F.col("n_present") >= min_genes)
    usable = [(r.signature, r.n_present) for r in present.orderBy("signature").collect()]
    names = F.array(*[F.lit(name) for name, _ in usable]) if usable else F.array().cast("array<string>")
    # Written, so Spark knows how small they are and counts don't move to meet them.
    place = (F.array_position(names, F.col("signature")) - 1).cast("int")
    hits = keep(members.withColumn("i", place).where("i >= 0").groupBy("gene_id").agg(F.collect_list("i").alias("sets")), "hits")
    per = counts.join(hits, "gene_id", "left").groupBy("cell_id").agg(
        F.sum("count").alias("total"), F.collect_list(F.when(F.col("sets").isNotNull(), F.struct("sets", "count"))).alias("hit"))
    value = lambda e: F.log1p(F.try_divide(e["count"] * F.lit(target), F.col("total").cast("double")))
    seen = F.flatten(F.transform("hit", lambda e: F.transform(e["sets"], lambda i: F.struct(i.alias("i"), value(e).alias("v")))))
    j = cells.join(per.select("cell_id", seen.alias("seen")), "cell_id", "left")
    groups = dealt(j, n_cells, keys[0]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.min(c).alias(c) for c in covariates],
        F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"))
    zero = F.array(*[F.lit(0.0)] * len(usable)) if usable else F.array().cast("array<double>")
    sums = F.transform(zero, lambda z, i: F.aggregate("seen", z, lambda a, e: a + F.when(e["i"] == i, F.coalesce(e["v"], F.lit(0.0))).otherwise(0.0)))
    scores = F.array(*[F.struct(F.lit(name).alias("signature"), (sums[i] / n / F.col("n_cells")).alias("score")) for i, (name, n) in enumerate(usable)])
    scores = scores if usable else F.array().cast("array<struct<signature:string,score:double>>")
    return groups.select(*keys, *covariates, "n_cells", F.inline(scores))


def mean_vectors(cells: DataFrame, keys: Sequence[str], vector: str, min_cells: int) -> DataFrame:
    """Mean of a fixed-width vector per group, as (keys, dim, mean, n_cells) in long form."""
    long = cells.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n_cells")) \
        .where(F.col("n_cells") >= min_cells)


def pack_vectors(long: DataFrame, keys: Sequence[str], value: str = "mean") -> DataFrame:
    """Long (keys, dim, value) back to one array per group; the width is the vector's own."""
    packed = F.array_sort(F.collect_list(F.struct("dim", value)))
    return long.groupBy(*keys, "n_cells").agg(
        F.transform(packed, lambda s: s[value]).alias("vec"))


def value_counts(df: DataFrame, label: str) -> DataFrame:
    """Count, share and rank per label; ties rank by label. Windows run over labels, not rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("fraction", F.col("n") / total).withColumn(
        "percent", F.col("fraction") * 100).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("n"), label)))


def crosstab_long(df: DataFrame, cluster: str, label: str, level: str) -> DataFrame:
    counts = df.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n_cells"))
    share = F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy("cluster"))
    return counts.select(F.lit(level).alias("label_level"), "cluster", "label", "n_cells",
                         share.alias("fraction_within_cluster"))


def profile_table(cells: DataFrame, sample: str = "sample_unit_id") -> DataFrame:
    """Cells and distinct technical libraries per sample and type."""
    return cells.groupBy(sample, "cell_type").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_distinct("library").alias("n_technical_libraries"))


def pseudobulk_sums(counts: DataFrame, cells: DataFrame, profile_keys: Sequence[str]) -> DataFrame:
    """Exact integer sums per profile and gene. Partial sums run before the shuffle."""
    mapped = counts.join(cells.select("cell_id", *profile_keys), "cell_id")
    return mapped.groupBy(*profile_keys, "gene_id").agg(F.sum("count").alias("count")) \
        .where(F.col("count") != 0)


def conservation(counts: DataFrame, cells: DataFrame, sums: DataFrame) -> DataFrame:
    """Total before and after the roll-up, which must be equal."""
    before = counts.join(cells.select("cell_id"), "cell_id", "left_semi").agg(
        F.sum("count").alias("t"))
    return sums.agg(F.sum("count").alias("profile_total")) \
        .withColumn("cell_total", before.scalar()) \
        .withColumn("conserved", F.col("profile_total") == F.col("cell_total"))


def distinct_text(col: str) -> Column:
    """Sorted distinct values joined by a bar; for attributes with few values per group."""
    return F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), "|")


def relationship_class(df: DataFrame, left: str, right: str) -> DataFrame:
    """one-to-one, one-to-many, many-to-one or many-to-many between two keys."""
    pairs = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(
        F.lit(1).alias("one"))
    per_left = pairs.groupBy(left).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"))
    per_right = pairs.groupBy(right).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"))
    return per_left.select(F.col("m").alias("max_right_per_left")).withColumn(
        "max_left_per_right", per_right.scalar()).withColumn(
        "relationship",
        F.when((F.col("max_right_per_left") == 1) & (F.col("max_left_per_right") == 1), "one-to-one")
        .when(F.col("max_left_per_right") == 1, "one-to-many")
        .when(F.col("max_right_per_left") == 1, "many-to-one").otherwise("many-to-many"))


def reasons(*pairs: tuple[Column, str], sep: str = ";") -> Column:
    """Names of the conditions that hold, in the given order."""
    items = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in pairs])
    return F.array_join(F.filter(items, lambda x: x.isNotNull()), sep)


def dominant(df: DataFrame, keys: Sequence[str], value: str, out: str,
             weight: str | None = None) -> DataFrame:
    """Most frequent value (smallest on ties) and its share of the group."""
    counts = fold(df, keys, value, weight=weight)
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(
        best["v"].alias(out), (-best["k"] / F.sum("n")).alias(f"{out}_share"))


def label_evidence(cells: DataFrame, label: str, low_confidence: float = 0.5) -> DataFrame:
    """Support, age range, confidence spread, dominant cluster and batch per label."""
    low = (F.col("confidence") < low_confidence).cast("int")
    folded = cells.groupBy(label, "sample_unit_id", "subject_id", "cluster", "batch", "age").agg(
        F.count(F.lit(1)).alias("n"), F.sum(low).alias("n_low"))
    base = folded.groupBy(label).agg(
        F.sum("n").alias("n_cells"),
        F.count_distinct("sample_unit_id").alias("n_sample_units"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        (F.sum("n_low") / F.sum("n")).alias("low_confidence_fraction"))
    quant = wide_quantiles(cells, [label], "confidence",
                            {"confidence_q05": 0.05, "confidence_median": 0.5, "confidence_q95": 0.95})
    return _join_all([base, quant, dominant(folded, [label], "cluster", "dominant_cluster", "n"),
                      dominant(folded, [label], "batch", "dominant_batch", "n")], [label])


def marker_summary(cells: DataFrame, counts: DataFrame, genes: DataFrame, panel: DataFrame,
                   label: str) -> DataFrame:
    """Detection fraction and mean raw count per label and panel gene.

    ``panel`` is (gene_name, expected_label). Genes outside the catalogue give nulls.
    """
    wanted = panel.groupBy("gene_name").agg(F.collect_set("expected_label").alias("expected"))
    known = wanted.join(genes.select("gene_name", "gene_id"), "gene_name", "left")
    sizes = cells.groupBy(label).agg(F.count(F.lit(1)).alias("n_cells"))
    sums = counts.join(known.where("gene_id is not null").select("gene_id"), "gene_id", "left_semi") \
        .join(cells.select("cell_id", label), "cell_id").groupBy(label, "gene_id").agg(
        F.sum("count").alias("s"), F.count_if(F.col("count") > 0).alias("d"))
    listed = known.agg(F.collect_list(F.struct("gene_name", "gene_id", "expected")).alias("g"))
    grid = sizes.select(label, "n_cells", F.inline(listed.scalar()))
    have = F.col("gene_id").isNotNull()
    return grid.join(sums, [label, "gene_id"], "left").select(
        label, "gene_name", "n_cells", have.alias("gene_present"),
        F.when(have, F.coalesce("d", F.lit(0)) / F.col("n_cells")).alias("detection_fraction"),
        F.when(have, F.coalesce("s", F.lit(0)) / F.col("n_cells")).alias("mean_count"),
        F.array_contains("expected", F.col(label)).alias("expected_marker"))


def stage_retention(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Cells per stage against the stage before; the check fails when a stage grows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_cells")).select(
        F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), "n_cells")
        for i, (name, df) in enumerate(stages)]
    union = reduce(DataFrame.unionByName, parts)
    prev = F.lag("n_cells").over(Window.orderBy("stage_order"))
    return union.withColumn("previous_cells", prev).withColumn(
        "retention_fraction", F.try_divide(F.col("n_cells").cast("double"), "previous_cells")).withColumn(
        "non_increasing", F.coalesce(F.col("n_cells") <= F.col("previous_cells"), F.lit(True)))


def stratum_retention(before: DataFrame, after: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Cells by stratum level in two snapshots; a missing level is ``__MISSING__``."""
    def levels(df, name):
        items = F.array(*[F.struct(F.lit(s).alias("stratum"),
                                   F.coalesce(F.col(s).cast("string"), F.lit("__MISSING__"))
                                   .alias("level")) for s in strata])
        return df.select(F.inline(items)).groupBy("stratum", "level").agg(
            F.count(F.lit(1)).alias(name))

    joined = levels(before, "input_cells").join(levels(after, "retained_cells"),
                                                ["stratum", "level"], "full")
    return joined.fillna(0, ["input_cells", "retained_cells"]).withColumn(
        "retention_fraction", F.try_divide(F.col("retained_cells").cast("double"), "input_cells"))


def binned_composition(fractions: DataFrame, edges: Sequence[float], top_n: int,
                       sparse_below: int, drop_sparse: bool, sample: str = "sample_unit_id"):
    """Mean composition per age bin: top types by mean fraction, the rest in ``Other``,
    each bin normalised to one, with the number of samples and a sparse flag."""
    binned = fractions.withColumn("age_bin", age_bin("age", edges)).withColumn(
        "bin_order", age_bin_order("age", edges)).where("age_bin is not null")
    top = binned.groupBy("cell_type").agg(F.avg("fraction").alias("m")).orderBy(
        F.desc("m"), "cell_type").limit(top_n).select("cell_type", F.col("cell_type").alias("shown"))
    shown = binned.join(top, "cell_type", "left").withColumn(
        "shown", F.coalesce("shown", F.lit("Other")))
    per_type = shown.groupBy("age_bin", "bin_order", "shown", "cell_type").agg(
        F.avg("fraction").alias("m"))
    per_shown = per_type.groupBy("age_bin", "bin_order", "shown").agg(F.sum("m").alias("m"))
    support = binned.groupBy("age_bin").agg(F.count_distinct(sample).alias("n_samples"))
    out = per_shown.withColumn(
        "mean_fraction", F.try_divide("m", F.sum("m").over(Window.partitionBy("age_bin")))) \
        .join(support, "age_bin").withColumn("sparse_bin", F.col("n_samples") < sparse_below)
    if drop_sparse:
        out = out.where(~F.col("sparse_bin"))
    return out.drop("m")


def histogram(df: DataFrame, metrics: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width counts and the median per metric; the right edge belongs to the last bin."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])))
    long = long.where("x is not null").groupBy("metric", "x").agg(F.count(F.lit(1)).alias("w"))
    span = long.groupBy("metric").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(
        wide_quantiles(long, ["metric"], "x", {"median": 0.5}, weight="w"), "metric")
    at = F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    return long.join(span, "metric").withColumn(
        "bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")) \
        .groupBy("metric", "bin", "lo", "hi", "median").agg(F.sum("w").alias("n"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Two-dimensional equal-width counts."""
    span = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"),
                           F.max(y).alias("y1")).alias("s")).scalar()

    def at(col, lo, hi):
        pos = F.floor(F.try_divide((F.col(col) - F.col(lo)) * bins, F.col(hi) - F.col(lo)))
        return F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int")

    return df.withColumn("s", span).groupBy(
        at(x, "s.x0", "s.x1").alias("x_bin"), at(y, "s.y0", "s.y1").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"))
