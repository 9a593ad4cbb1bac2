"""Deterministic sampling, budget allocation, grouped folds and bootstrap.

Randomness is md5 of (seed, ids): the same rows are drawn on any layout, and a lost task redraws
exactly what it drew before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortroll.functions.scalar import hash_int
from cohortroll.operators import resampling
from cohortroll.operators.ordering import hashed_number, join_ids, running_counts, running_position
from cohortroll.session import keep


EDGE = 200_000  # rows of the slot in which a budget runs out that are ranked together


def draw_key(seed: int | str, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def seeded_take(df: DataFrame, ids: Sequence[str], take: DataFrame | int, seed: int,
                group: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Exactly ``take`` rows (per group) with the smallest draw keys, without a full sort.

    Rows are counted by the first hex digits of the key, which shows the slot where a group's budget runs out. A slot of more
    than ``EDGE`` rows is counted again by its next digits, until it is small. Rows of lower slots are kept by filter alone; only
    the last slot is ranked. Rows of equal ids have equal keys and share a slot at any length.
    """
    grp = list(group)
    keyed = df.withColumn("__key", draw_key(seed, *ids))
    budget = take if isinstance(take, DataFrame) else df.groupBy(*grp).agg(F.lit(take).alias("take")) if grp else None

    def counted(rows: DataFrame, length: int, known: Sequence[str]) -> DataFrame:
        """Per group the slot in which its budget runs out: its prefix, the rows before it and the rows in it."""
        slots = rows.groupBy(*grp, *known, F.substring("__key", 1, length).alias("__slot")).agg(F.count(F.lit(1)).alias("__n"))
        start = F.col("__start") if "__start" in known else F.lit(0)
        upto = F.sum("__n").over(Window.partitionBy(*grp).orderBy("__slot")) + start
        slots = slots.withColumn("__upto", upto)
        if "take" not in known:
            slots = slots.join(budget, grp) if grp else slots.withColumn("take", F.lit(take))
        slots = slots.withColumn("__before", F.col("__upto") - F.col("__n"))
        return slots.where((F.col("__before") < F.col("take")) & (F.col("__upto") >= F.col("take"))).select(
            *grp, "take", F.col("__slot").alias("__prefix"), F.col("__before").alias("__start"), F.col("__n").alias("__held"))

    def joined(rows: DataFrame, edges: DataFrame, how: str) -> DataFrame:
        if grp:
            return rows.join(edges, grp, how)
        one = edges.first()  # the only row there can be
        return rows.withColumns({c: F.lit(one[c] if one else None).cast(t) for c, t in edges.dtypes})

    length = digits
    edges = keep(counted(keyed, length, ()), "edges")
    while length < 32 and not (large := edges.where(F.col("__held") > EDGE)).isEmpty():
        length += digits
        inside = joined(keyed, large, "inner").where(F.col("__key").startswith(F.col("__prefix")))
        finer = counted(inside, length, ("take", "__start"))
        edges = keep(finer.unionByName(edges.where(F.col("__held") <= EDGE)), "edges")
    # A group without an edge is kept whole, if it has a budget at all.
    told = joined(keyed, edges, "left")
    whole_groups = F.col("__prefix").isNull()
    head = F.substring(F.col("__key"), F.lit(1), F.length("__prefix"))
    lower = told.where(whole_groups | (head < F.col("__prefix")))
    if grp:
        lower = lower.drop("take").join(budget.where("take > 0").select(*grp), grp, "left_semi")
    elif take <= 0:
        lower = lower.limit(0)
    edge = told.where(head == F.col("__prefix")).withColumn("__rn", F.row_number().over(Window.partitionBy(*grp, "__prefix").orderBy("__key", *ids)))
    edge = edge.where(F.col("__rn") + F.col("__start") <= F.col("take"))
    return lower.select(*df.columns).unionByName(edge.select(*df.columns))


def capped_allocation(sizes: DataFrame, keys: Sequence[str], weight: str, cap: str, total,
                      out: str = "allocation") -> DataFrame:
    """Splits ``total`` over groups by weight under caps.

    Floor of the quota first, then one each by largest remainder, then what is left by largest
    remaining cap, ties in hash order. Each step is kept, so the next one reads a small table.
    """
    sizes = keep(sizes, "sizes")
    sums = sizes.agg(F.struct(
        F.sum(F.greatest(F.col(weight).cast("double"), F.lit(0.0))).alias("w"),
        F.sum(cap).alias("c")).alias("s")).scalar()
    base = sizes.withColumn("__s", sums)
    base = base.withColumn("__w", F.when(F.col("__s.w") > 0, F.greatest(
        F.col(weight).cast("double"), F.lit(0.0))).otherwise(F.col(cap).cast("double")))
    budget = F.least(total if isinstance(total, Column) else F.lit(total), F.col("__s.c"))
    whole = F.when(F.col("__s.w") > 0, F.col("__s.w")).otherwise(F.col("__s.c").cast("double"))
    base = base.withColumn("__budget", budget).withColumn(
        "__quota", F.coalesce(F.try_divide(F.col("__w"), whole) * F.col("__budget"), F.lit(0.0)))
    base = base.withColumn("__floor", F.least(F.floor("__quota"), F.col(cap)))
    base = keep(base.withColumn("__frac", F.col("__quota") - F.floor("__quota")), "quota")
    spare = base.agg(F.sum("__floor").alias("f")).scalar()
    base = base.withColumn("__left", F.col("__budget") - spare).withColumn(
        "__by_frac", F.when(F.col("__floor") < F.col(cap), -F.col("__frac")))
    base = running_position(base, "__by_frac", keys, "__turn")
    base = keep(base.withColumn("__second", F.col("__floor") + F.when(
        F.col("__turn") <= F.col("__left"), 1).otherwise(0)), "second")
    used = base.agg(F.sum("__second").alias("u")).scalar()
    base = base.withColumn("__rest", F.col("__budget") - used).withColumn(
        "__by_cap", -(F.col(cap) - F.col("__second")).cast("double"))
    base = running_position(base, "__by_cap", keys, "__place", before="__earlier")
    extra = F.greatest(F.lit(0.0), F.least(
        -F.col("__by_cap"), F.col("__rest") - F.coalesce("__earlier", F.lit(0.0))))
    base = base.withColumn(out, (F.col("__second") + extra).cast("bigint"))
    return base.select(*sizes.columns, out)


def allocate_budget(sizes: DataFrame, keys: Sequence[str], size: str, budget: int, minimum: int):
    """A minimum for every large group, the rest by remaining size; when the minimum alone
    exceeds the budget, only large groups share it by size."""
    minimum = max(minimum, 1)
    sizes = keep(sizes, "sizes")
    base = sizes.withColumn("__large", F.col(size) >= minimum).withColumn(
        "__must", F.when(F.col("__large"), minimum).otherwise(0))
    needed = base.agg(F.sum("__must").alias("m")).scalar()
    base = base.withColumn("__needed", needed)
    tight = F.col("__needed") >= budget
    base = base.withColumn("__base", F.when(tight, 0).otherwise(F.col("__must"))).withColumn(
        "__cap", F.when(tight, F.when(F.col("__large"), F.col(size)).otherwise(0))
        .otherwise(F.col(size) - F.col("__must")))
    total = F.when(tight, F.lit(budget)).otherwise(budget - F.col("__needed"))
    out = capped_allocation(base, keys, "__cap", "__cap", total, "__extra")
    return out.select(*sizes.columns, (F.col("__base") + F.col("__extra")).alias("allocation"))


def stratified_take(cells: DataFrame, keys: Sequence[str], ids: Sequence[str], budget: int,
                    minimum: int, seed: int) -> DataFrame:
    """Stratified sample of cells under a budget; all rows when the budget covers them."""
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    alloc = allocate_budget(sizes, keys, "size", budget, minimum).withColumn(
        "total", F.lit(None).cast("bigint"))
    total = sizes.agg(F.sum("size").alias("n")).scalar()
    take = keep(alloc.withColumn("total", total).select(
        *keys, F.when(F.col("total") <= budget, F.col("size")).otherwise(F.col("allocation"))
        .alias("take")), "take")
    return seeded_take(cells, ids, take, seed, keys, digits=2)


def grouped_folds(rows: DataFrame, subject: str, folds: int) -> DataFrame:
    """(subject, n_rows, fold): subjects by falling size, dealt forwards then backwards."""
    sizes = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("n_rows"))
    n = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = sizes.withColumn("__order", -F.col("n_rows").cast("double"))
    ranked = running_position(sizes, "__order", [subject], "__pos").withColumn(
        "__k", F.least(F.lit(folds), n)).withColumn("__pos", F.col("__pos") - 1)
    lap, step = F.floor(F.col("__pos") / F.col("__k")), F.pmod(F.col("__pos"), F.col("__k"))
    fold = F.when(F.pmod(lap, F.lit(2)) == 0, step).otherwise(F.col("__k") - 1 - step)
    return ranked.select(subject, "n_rows", fold.cast("int").alias("fold"))


def fold_leaks(rows: DataFrame, subject: str, fold: str) -> DataFrame:
    """Subjects found in more than one fold (must be empty)."""
    pairs = rows.groupBy(subject, fold).agg(F.lit(1).alias("one"))
    return pairs.groupBy(subject).agg(F.count(F.lit(1)).alias("n_folds")).where("n_folds > 1")


def numbered(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Rows numbered 0..n-1 per test in hash order of the row id, with the test size."""
    out = hashed_number(df, [row_id], keys, "__i")
    out = out.withColumn("__i", F.col("__i") - 1)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return out.join(size, list(keys)) if keys else out.withColumn("__n", size.scalar())


def _intervals(good: DataFrame, keys: Sequence[str], columns: dict[str, str], ci: float, *more: Column) -> DataFrame:
    """Percentile intervals of the replicates' columns, under the names given."""
    tail = (1 - ci) / 2
    return good.groupBy(*keys).agg(
        *more, *[F.percentile(v, F.lit(p)).alias(f"{name}_{side}") for v, name in columns.items() for side, p in (("low", tail), ("high", 1 - tail))])


def row_bootstrap(df: DataFrame, keys: Sequence[str], row_id: str, x: str, y: str, n_boot: int,
                  ci: float, seed: int) -> DataFrame:
    """Percentile intervals of the slope and the rank correlation by row resampling.

    Resampling n rows with replacement is a set of integer weights per row; the weights are the
    counts of the draws that hit the row, so replicates are weighted sums, never copied rows.
    Tests with fewer than four rows get null intervals; replicates with fewer than three distinct
    x or y are skipped; more than two good replicates are needed.

    Replicates of tests of at most ``resampling.ROWS`` rows are dealt out to tasks, which draw and rank. Ranks of a replicate
    need all its rows in order, so a larger test's weights are shuffled, with the same draws and the same result.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    tests = resampling.test_sizes(rows, keys, seed).where("__n >= 4")
    largest, total = tests.agg(F.max("__n"), F.sum("__n")).first()
    # Rows go by their place in the order of hashes; a test's row number is how many of its rows come before.
    bits = min((max(total or 0, 1) // resampling.LEAF).bit_length(), 20)
    h = hash_int(row_id)
    placed = rows.select(*keys, F.shiftright(h, 60 - bits).alias("__bucket"), h.alias("__h"), join_ids([row_id]).alias("__id"),
                         F.col(x).alias("__x"), F.col(y).alias("__y"))
    good = resampling.ranked_trends(placed, tests.where(F.col("__n") <= resampling.ROWS), keys, n_boot)
    if (largest or 0) > resampling.ROWS:
        large = keep(numbered(rows, keys, row_id).where(F.col("__n") > resampling.ROWS), "numbered")
        good = good.unionByName(shuffled_trends(large, keys, x, y, n_boot, seed))
    out = _intervals(keep(good, "replicates"), keys, {"rho": "spearman_rho_ci", "slope": "slope_per_year_ci"}, ci, F.count(F.lit(1)).alias("n_good"))
    return out.select(*keys, "n_good", *[F.when(F.col("n_good") > 2, F.col(c)).alias(c) for c in out.columns if "_ci_" in c])


def shuffled_trends(rows: DataFrame, keys: Sequence[str], x: str, y: str, n_boot: int, seed: int) -> DataFrame:
    """``keys, slope, rho`` of every usable replicate, from weights joined to the rows."""
    draws = rows.select(
        *keys, "__n", F.col("__i").alias("__slot"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("__b"))
    hit = resampling.hit_column(resampling.test_base(seed, keys), F.col("__b").cast("bigint"), F.col("__slot").cast("bigint"), F.col("__n"))
    weights = draws.groupBy(*keys, "__b", hit.alias("__i")).agg(F.count(F.lit(1)).alias("__w"))
    drawn = keep(weights.join(rows.select(*keys, "__i", x, y), [*keys, "__i"]), "drawn")
    rep = [*keys, "__b"]

    def weighted_rank(value, out):
        """Tie-averaged rank in a replicate, from weights of distinct values."""
        ranks = running_counts(drawn, value, rep, weight=F.col("__w"))
        return ranks.select(*rep, value, (F.col("n_upto") - (F.col("n") - 1) / 2.0).alias(out))

    ranked = drawn.join(weighted_rank(x, "__rx"), [*rep, x]).join(weighted_rank(y, "__ry"), [*rep, y])
    w = F.col("__w")

    def moments(a, b, tag):
        ca, cb = F.col(a).cast("double"), F.col(b).cast("double")
        return [F.sum(w * ca).alias(f"a{tag}"), F.sum(w * cb).alias(f"b{tag}"),
                F.sum(w * ca * cb).alias(f"ab{tag}"), F.sum(w * ca * ca).alias(f"aa{tag}"),
                F.sum(w * cb * cb).alias(f"bb{tag}")]

    sums = ranked.groupBy(*rep).agg(
        F.sum(w).alias("n"), F.count_distinct(x).alias("dx"), F.count_distinct(y).alias("dy"),
        *moments(x, y, "1"), *moments("__rx", "__ry", "2")).where("dx >= 3 and dy >= 3")

    def centred(p, q, pq, tag):
        return F.col(f"{pq}{tag}") - F.col(f"{p}{tag}") * F.col(f"{q}{tag}") / F.col("n")

    slope = F.try_divide(centred("a", "b", "ab", 1), centred("a", "a", "aa", 1))
    rho = F.try_divide(centred("a", "b", "ab", 2), F.sqrt(
        centred("a", "a", "aa", 2) * centred("b", "b", "bb", 2)))
    return sums.select(*keys, slope.alias("slope"), rho.alias("rho"))


def cluster_bootstrap(preds: DataFrame, subject: str, truth: str, pred: str, n_boot: int, ci: float,
                      seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Intervals of mean absolute error and R2 by resampling subjects.

    Rows are folded to sums per subject once; replicates are sums over subjects, drawn where the subjects are.
    """
    keys = list(keys)
    t, e = F.col(truth), F.col(truth) - F.col(pred)
    per_subject = preds.groupBy(*keys, subject).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"),
        F.sum(t).alias("t1"), F.sum(t * t).alias("t2"))
    rep = resampling.replicate_sums(numbered(per_subject, keys, subject), keys, ["n", "ae", "se", "t1", "t2"], n_boot, seed)
    good = rep.select(
        *keys, F.try_divide("ae", F.col("n").cast("double")).alias("mae"),
        (1 - F.try_divide(F.col("se"), F.col("t2") - F.col("t1") * F.col("t1") / F.col("n")))
        .alias("r2"))
    return _intervals(good, keys, {"mae": "mae_ci", "r2": "r2_ci"}, ci)


def mean_bootstrap(values: DataFrame, keys: Sequence[str], row_id: str, value: str, n_boot: int,
                   ci: float, seed: int) -> DataFrame:
    """Interval of a mean and the share of replicates above zero; null values have no weight."""
    rows = numbered(values, keys, row_id).withColumns({
        "__one": F.col(value).isNotNull().cast("double"), "__value": F.coalesce(F.col(value).cast("double"), F.lit(0.0))})
    rep = resampling.replicate_sums(rows, keys, ["__value", "__one"], n_boot, seed)
    good = rep.select(*keys, F.try_divide("__value", "__one").alias("m"))
    return _intervals(good, keys, {"m": "mean_ci"}, ci, F.avg((F.col("m") > 0).cast("int")).alias("share_above_zero"))
