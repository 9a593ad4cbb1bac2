"""Negative-binomial count models per (cell type, gene) with shared dispersion and a moderated quasi-likelihood F test.

Profiles of a type are dealt by hash into blocks, genes into parts. A tile is one part's counts in one block, as sparse
lists, together with the block's design; nothing is ever made dense outside a task. Every round of every fit is one pass
over the tiles: a task adds up score, information and likelihood of all models (gene, variant) of a tile with numpy, the sums
of a model's blocks meet in a shuffle, and the p x p solve runs on one row per model. So neither a gene's profiles nor a type's
genes ever meet in one task.

The dispersion comes in three steps, each from such sums: the adjusted profile likelihood of every gene on a grid of
dispersions; its mean over genes of similar abundance, from sums over narrow abundance bins; and the dispersion where a type's
mean likelihood is highest. The final fit with that trend gives deviances, whose mean per degree of freedom is moderated
across the genes of the type.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.functions.tails import f_upper
from cohortroll.operators.expression import (
    design_sample_size, expressed_genes, kept_libraries, prior_variances, tmm_factors)
from cohortroll.operators.glm import design_diagnostics, indicator_columns, pairs, square, sum_array
from cohortroll.operators.stats import age_terms
from cohortroll.session import keep

BLOCK = 256  # profiles in a block, on average
PART = 256  # genes in a part, on average
AT_ONCE = 15_000  # model x profile cells that are worked on at once: as many as stay in a core's own cache
SENT = 100_000  # models that are sent to all tasks at once, at most
TILES = 64  # tiles in a file of tiles, about: the least that one task works on

# The dispersion grid (powers of two of 0.1) and the weight of the shared likelihood, in degrees of freedom.
GRID = tuple(0.1 * 2.0 ** g for g in range(-10, 11))
PRIOR_DF = 10.0

BINS = 16  # abundance bins for each doubling
TOLERANCE = 1e-9  # a model is done when a round adds less than this share to its likelihood
MODEL = ["cell_type", "part", "gene_id", "variant"]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: shifted above 8, then Stirling's series."""
    x = np.array(x, float)
    low = x < 8
    shift = np.zeros_like(x)
    for _ in range(8):
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
        low = x < 8
    i = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680


def design_scopes(profiles: DataFrame, covariates: Sequence[str], *, min_replicates: int, min_age_span: float,
                  min_residual_df: int) -> tuple[DataFrame, DataFrame, list[str], list[list[int]]]:
    """The design of each type: all covariates if they can be estimated, else age alone, else none.

    Returns one row per type (``model_scope``, support, design size, ``status``, ``reason``), the profiles with their design
    columns (those of dropped covariates are 0, which every solver leaves out), the columns' names and the dummy groups.
    """
    d, x, groups = indicator_columns(age_terms(profiles, ["cell_type"]), covariates)
    d = keep(d, "design")
    full = design_diagnostics(d, ["cell_type"], x, groups, "age_decade", min_residual_df)
    alone = design_diagnostics(d, ["cell_type"], ["x0"], [], "age_decade", min_residual_df)
    told = ["design_columns", "design_rank", "residual_df", "estimable"]
    both = full.select("cell_type", *[F.col(c).alias(f"full_{c}") for c in told]).join(
        alone.select("cell_type", *[F.col(c).alias(f"age_{c}") for c in told]), "cell_type")
    support = d.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_replicates"), (F.max("age") - F.min("age")).alias("age_span_years"))
    reason = F.when(F.col("n_replicates") < min_replicates, "insufficient_replicates").when(
        F.coalesce(F.col("age_span_years") < min_age_span, F.lit(True)), "insufficient_age_span")
    scope = F.when(reason.isNotNull(), "not_tested").when(F.col("full_estimable"), "adjusted_primary").otherwise("age_only_sensitivity")
    pick = lambda c: F.when(F.col("model_scope") == "not_tested", None).when(
        F.col("model_scope") == "adjusted_primary", F.col(f"full_{c}")).otherwise(F.col(f"age_{c}"))
    s = support.join(both, "cell_type").withColumn("model_scope", scope).withColumn("reason", reason)
    s = s.withColumns({c: pick(c) for c in told[:3]})
    late = F.when(F.col("design_rank") < F.col("design_columns"), "rank_deficient_or_age_coefficient_absent").when(
        ~F.col("age_estimable") & (F.col("residual_df") >= min_residual_df), "rank_deficient_or_age_coefficient_absent").when(
        F.col("residual_df") < min_residual_df, "insufficient_residual_df")
    s = s.withColumn("reason", F.coalesce("reason", F.when(F.col("model_scope") == "age_only_sensitivity", late), F.lit("")))
    s = s.withColumn("status", F.when(F.col("reason") == "", "completed").otherwise("excluded"))
    scopes = keep(s.select("cell_type", "model_scope", "n_replicates", "age_span_years", *told[:3], "status", "reason"), "scopes")
    used = d.join(scopes.where("status = 'completed'").select("cell_type", "model_scope"), "cell_type")
    used = used.withColumns({c: F.when(F.col("model_scope") == "adjusted_primary", F.col(c)).otherwise(0.0) for c in x[1:]})
    return scopes, used, [*x, "age_decade"], groups


def tiles_of(profiles: DataFrame, sums: DataFrame, genes: DataFrame, x: Sequence[str]) -> DataFrame:
    """``cell_type, part, block`` with the block's design rows and offsets and its genes' counts as sparse lists.

    Every kept gene of a type is in every block of the type, with empty lists where it has no count.
    """
    sizes = profiles.groupBy("cell_type").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    parts = genes.groupBy("cell_type").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    rows = profiles.join(sizes, "cell_type").select(
        "cell_type", F.pmod(F.xxhash64("profile_id"), "blocks").alias("block"), "profile_id",
        F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.log(F.col("library_size") * F.col("norm_factor")).alias("offset"))
    listed = keep(rows.groupBy("cell_type", "block").agg(F.array_sort(F.collect_list(F.struct("profile_id", "x", "offset"))).alias("rows")), "blocks")
    slots = listed.select("cell_type", "block", F.posexplode("rows.profile_id").alias("slot", "profile_id"))
    counts = sums.where("count > 0").join(slots, "profile_id").groupBy("cell_type", "block", "gene_id").agg(
        F.collect_list("slot").alias("slots"), F.collect_list(F.col("count").cast("double")).alias("counts"))
    placed = genes.select("cell_type", "gene_id").join(parts, "cell_type").join(sizes, "cell_type").select(
        "cell_type", "gene_id", F.pmod(F.xxhash64("gene_id"), "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = placed.join(counts, ["cell_type", "block", "gene_id"], "left").select(
        "cell_type", "part", "block", "gene_id", F.coalesce("slots", F.array().cast("array<int>")).alias("slots"),
        F.coalesce("counts", F.array().cast("array<double>")).alias("counts"))
    packed = cells.groupBy("cell_type", "part", "block").agg(F.array_sort(F.collect_list(F.struct("gene_id", "slots", "counts"))).alias("g"))
    design = listed.select("cell_type", "block", F.flatten("rows.x").alias("x"), F.col("rows.offset").alias("offset"))
    tiles = packed.join(design, ["cell_type", "block"]).select(
        "cell_type", "part", "block", F.col("g.gene_id").alias("genes"), F.transform("g.slots", F.size).alias("sizes"),
        F.flatten("g.slots").alias("slots"), F.flatten("g.counts").alias("counts"), "x", "offset")
    # A tile is small but long to work on: they are dealt by number, not by bytes, and lie by part for tasks to add up. The hash
    # is one that no shuffle above has dealt them by already: such a one would stand in for this, merged by bytes into few tasks.
    n = int(sizes.join(parts, "cell_type").agg(F.coalesce(F.sum(F.col("blocks") * F.col("parts")), F.lit(0))).first()[0])
    files = min(max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TILES)), max(n, 1))
    return keep(tiles.repartition(files, F.xxhash64("cell_type", "part", "block")).sortWithinPartitions("cell_type", "part", "block"), "tiles")


def gene_totals(tiles: DataFrame) -> DataFrame:
    """Count, library and log2 counts per million of each gene over its type's profiles, pooled, with a half count to spare."""
    size = F.aggregate("offset", F.lit(0.0), lambda a, v: a + F.exp(v))
    per = tiles.select("cell_type", "part", size.alias("size"), F.posexplode("genes").alias("i", "gene_id"), "sizes", "counts").withColumn(
        "before", F.aggregate(F.slice("sizes", 1, F.col("i")), F.lit(0), lambda a, v: a + v))
    own = F.slice("counts", F.col("before") + 1, F.element_at("sizes", F.col("i") + 1))
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
    g = per.select("cell_type", "part", "gene_id", "size", total.alias("total")).groupBy("cell_type", "part", "gene_id").agg(
        F.sum("total").alias("total"), F.sum("size").alias("size"))
    return g.select("cell_type", "part", "gene_id", F.log((F.col("total") + 0.5) / F.col("size")).alias("start"),
                    F.log2((F.col("total") + 0.5) / F.col("size") * 1e6).alias("average_log_cpm"))


def _dense(row, which: np.ndarray) -> np.ndarray:
    """Counts of the tile's genes ``which``, models by profiles."""
    n = len(row.offset)
    ends = np.cumsum(row.sizes)
    starts = ends - row.sizes
    y = np.zeros((len(which), n))
    for k, g in enumerate(which.tolist()):
        y[k, row.slots[starts[g]:ends[g]]] = row.counts[starts[g]:ends[g]]
    return y


def model_sums(x: np.ndarray, offset: np.ndarray, y: np.ndarray, phi: np.ndarray, beta: np.ndarray, last: bool) -> np.ndarray:
    """Rows of sums, one per model: information (upper triangle), score, likelihood kernel; at ``last`` also the part of
    the likelihood that no coefficient changes, and the kernel of the saturated model."""
    eta = np.clip(offset + beta @ x.T, -80.0, 80.0)
    mu, phi = np.exp(eta), phi[:, None]
    grown = 1 + phi * mu
    w, r = mu / grown, (y - mu) / grown
    cross = np.stack([x[:, i] * x[:, j] for i, j in pairs(x.shape[1])], 1)
    out = [w @ cross, r @ x, (y * eta - (y + 1 / phi) * np.log(grown)).sum(1, keepdims=True)]
    if last:
        out += [part.sum(1, keepdims=True) for part in count_terms(y, phi)]
    return np.concatenate(out, 1)


def count_terms(y: np.ndarray, phi: np.ndarray) -> list[np.ndarray]:
    """The parts of the likelihood that depend on count and dispersion alone, worked out once for each pair of their values."""
    values, place = np.unique(y, return_inverse=True)
    kinds, kind = np.unique(phi, return_inverse=True)
    few = len(values) * len(kinds) < y.size
    c, d = (values[None, :], kinds[:, None]) if few else (y, phi)
    free = c * np.log(d) + log_gamma(c + 1 / d) - log_gamma(1 / d) - log_gamma(c + 1)
    whole = np.where(c > 0, c * np.log(np.where(c > 0, c, 1.0)), 0.0) - (c + 1 / d) * np.log1p(d * c)
    return [t[kind.reshape(-1, 1), place.reshape(y.shape)] for t in (free, whole)] if few else [free, whole]


def summed(tiles: DataFrame, models: DataFrame, p: int, n_models: int, last: bool = False) -> DataFrame:
    """``MODEL, s``: the sums of each model at its ``trial`` coefficients, over all blocks.

    Models go to the tiles, never the few tiles' parts to the models: as many tasks work as there are tiles for. A task adds up the
    tiles of a part that follow one another before it sends anything.
    """
    width = p * (p + 1) // 2 + p + (3 if last else 1)
    asked = models.groupBy("cell_type", "part").agg(F.array_sort(F.collect_list(F.struct("gene_id", "variant", "phi", "trial"))).alias("m")).select(
        "cell_type", "part", F.col("m.gene_id").alias("m_gene"), F.col("m.variant").alias("m_variant"), F.col("m.phi").alias("m_phi"),
        F.flatten("m.trial").alias("m_trial"))
    gene = models.schema["gene_id"].dataType.simpleString()
    kind = models.schema["cell_type"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, added = None, np.zeros(0)

        def told() -> pd.DataFrame:
            return pd.DataFrame({"cell_type": [now.cell_type] * len(added), "part": now.part, "gene_id": list(now.m_gene),
                                 "variant": list(now.m_variant), "s": list(added)})

        for frame in frames:
            for row in frame.itertuples(index=False):
                x = np.asarray(row.x, float).reshape(-1, p)
                place = {g: k for k, g in enumerate(row.genes)}
                which = np.array([place[g] for g in row.m_gene])
                phi, trial, sums = np.asarray(row.m_phi, float), np.asarray(row.m_trial, float).reshape(-1, p), []
                step = max(1, AT_ONCE // max(len(x), 1))
                for a in range(0, len(which), step):
                    own = slice(a, a + step)
                    genes, index = np.unique(which[own], return_inverse=True)
                    sums.append(model_sums(x, np.asarray(row.offset, float), _dense(row, genes)[index], phi[own], trial[own], last))
                if now is not None and (now.cell_type, now.part) == (row.cell_type, row.part):
                    added += np.concatenate(sums)
                    continue
                if now is not None:
                    yield told()
                now, added = row, np.concatenate(sums)
        if now is not None:
            yield told()

    asked = F.broadcast(asked) if n_models <= SENT else asked.hint("merge")
    partial = tiles.join(asked, ["cell_type", "part"]).mapInPandas(
        run, f"cell_type {kind}, part bigint, gene_id {gene}, variant int, s array<double>")
    return partial.groupBy(*MODEL).agg(sum_array(f"s[{i}]" for i in range(width)).alias("s"))


def fit_models(tiles: DataFrame, models: DataFrame, p: int, columns: Sequence[Sequence[int]], max_rounds: int = 40,
               tolerance: float = TOLERANCE, still: float = 0.0) -> DataFrame:
    """Fits each model ``MODEL, phi, start`` with its variant's columns, by Fisher scoring with halved steps.

    Returns ``MODEL, phi, beta, converged, s``, where ``s`` are the sums of the last pass at the solution. A model is done when a
    round adds no more than the share ``tolerance`` to its likelihood, or the next step moves no coefficient by more than
    ``still``. One that isn't done after ``max_rounds`` is not converged; its numbers are those it has got to.
    """
    k = p * (p + 1) // 2
    masks = np.zeros((len(columns), p), bool)
    for v, own in enumerate(columns):
        masks[v, list(own)] = True
    first = F.array(F.col("start"), *[F.lit(0.0)] * (p - 1))
    state = models.select(*MODEL, "phi", first.alias("beta"), first.alias("trial"), F.array(*[F.lit(0.0)] * p).alias("step"),
                          F.lit(float("-inf")).alias("ll"), F.lit(False).alias("done"))
    state = keep(state, "models")

    @F.pandas_udf("struct<beta:array<double>,trial:array<double>,step:array<double>,ll:double,done:boolean>")
    def advance(variant: pd.Series, s: pd.Series, beta: pd.Series, trial: pd.Series, step: pd.Series, ll: pd.Series) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({"beta": [], "trial": [], "step": [], "ll": [], "done": []})
        sums, beta, trial, step = (np.stack([np.asarray(v, float) for v in c]) for c in (s, beta, trial, step))
        old, new, mask = ll.to_numpy(float), sums[:, k + p], masks[variant.to_numpy(int)]
        better = new >= old - 1e-12 * np.abs(old)
        better &= np.isfinite(sums).all(1)
        info = np.zeros((len(sums), p, p))
        info[:, *np.triu_indices(p)] = np.where(better[:, None], sums[:, :k], 0.0)
        full = info + np.transpose(np.triu(info, 1), (0, 2, 1))
        full = np.where(mask[:, :, None] & mask[:, None, :], full, 0.0)
        move = (np.linalg.pinv(full, rcond=1e-12, hermitian=True) @ np.where(mask, np.where(better[:, None], sums[:, k:k + p], 0.0), 0.0)[:, :, None])[:, :, 0]
        move = np.clip(move, -10.0, 10.0)
        gain = np.where(np.isfinite(old), new - old, np.inf)
        close = better & ((gain <= tolerance * (1 + np.abs(new))) | (np.abs(move).max(1) <= still))
        stuck = ~better & (np.abs(step).max(1) < 1e-9)
        base = np.where(better[:, None], trial, beta)
        step = np.where(better[:, None], move, step / 2)
        return pd.DataFrame({"beta": list(base), "trial": list(base + step), "step": list(step), "ll": np.where(better, new, old), "done": close | stuck})

    for _ in range(max_rounds):
        active = state.where(~F.col("done"))
        n_active = active.count()
        if not n_active:
            break
        at = summed(tiles, active, p, n_active).join(active, MODEL)
        moved = at.withColumn("n", advance("variant", "s", "beta", "trial", "step", "ll")).select(*MODEL, "phi", "n.*")
        state = keep(moved.unionByName(state.where("done")), "models")
    final = summed(tiles, state.withColumn("trial", F.col("beta")), p, state.count(), last=True)
    return keep(state.select(*MODEL, "phi", "beta", F.col("done").alias("converged")).join(final, MODEL), "fits")


def log_determinant(info: np.ndarray) -> float:
    """Log determinant of a symmetric matrix over its columns that are not all zero."""
    used = np.diag(info) > 1e-12
    sign, value = np.linalg.slogdet(info[np.ix_(used, used)])
    return float(value) if sign > 0 else 0.0


def adjusted_profile(fits: DataFrame, p: int) -> DataFrame:
    """``MODEL, apl``: the likelihood at the solution, less half the log determinant of the information."""
    k = p * (p + 1) // 2

    @F.pandas_udf("double")
    def adjusted(s: pd.Series) -> pd.Series:
        return pd.Series([float(v[k + p] + v[k + p + 1] - 0.5 * log_determinant(square(np.asarray(v[:k], float), p))) for v in s], dtype=float)

    return fits.select(*MODEL, "phi", "converged", adjusted("s").alias("apl"))


def peak(values: np.ndarray) -> np.ndarray:
    """Where rows of values at 0, 1, 2 ... are highest, by the parabola through the best one and its neighbours."""
    best = values.argmax(1)
    inner = np.clip(best, 1, values.shape[1] - 2)
    rows = np.arange(len(values))
    a, b, c = (values[rows, inner + d] for d in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = np.where(bend < 0, (a - c) / np.where(bend < 0, 2 * bend, 1.0), 0.0)
    return np.where(bend < 0, inner + np.clip(shift, -1, 1), best.astype(float))


def local_means(at: np.ndarray, n: np.ndarray, sums: np.ndarray, span: float) -> np.ndarray:
    """For each bin the mean over the genes near it, with tricube weights that end where ``span`` of all genes are nearer."""
    out = np.empty_like(sums)
    for i, centre in enumerate(at):
        gap = np.abs(at - centre)
        order = np.argsort(gap, kind="stable")
        reach = gap[order][min(np.searchsorted(np.cumsum(n[order]), span * n.sum()), len(at) - 1)]
        w = np.clip(1 - (gap / max(reach * 1.001, 1e-9)) ** 3, 0, None) ** 3 if reach > 0 else (gap == 0).astype(float)
        out[i] = (w[:, None] * sums).sum(0) / (w * n).sum()
    return out


def shared_dispersion(profile: DataFrame, genes: DataFrame, residual: DataFrame, grid: Sequence[float], prior_df: float = PRIOR_DF) -> DataFrame:
    """Per gene: ``common_dispersion``, ``trended_dispersion`` and ``tagwise_dispersion``.

    The common one is where a type's summed likelihood is highest, the trend where the local mean along abundance is, the
    tagwise one where the gene's own likelihood plus ``prior_df / residual_df`` times the local mean is.
    """
    at = F.array_sort(F.collect_list(F.struct("variant", "apl")))
    own = profile.groupBy("cell_type", "part", "gene_id").agg(at.alias("a")).select("cell_type", "part", "gene_id", F.col("a.apl").alias("apl"))
    own = keep(own.join(genes, ["cell_type", "part", "gene_id"]).withColumn("bin", F.floor(F.col("average_log_cpm") * BINS)), "profiles")
    bins = own.groupBy("cell_type", "bin").agg(F.count(F.lit(1)).alias("n"), sum_array(f"apl[{i}]" for i in range(len(grid))).alias("s"))
    step = np.log(grid[1] / grid[0])

    @F.pandas_udf("array<struct<bin:bigint,common:double,trend:double,shared:array<double>>>")
    def along(rows: pd.Series) -> pd.Series:
        out = []
        for told in rows:
            n = np.array([r["n"] for r in told], float)
            sums = np.stack([np.asarray(r["s"], float) for r in told])
            centres = np.array([r["bin"] for r in told], float)
            span = (10 / n.sum()) ** 0.23 if n.sum() > 10 else 1.0
            near = local_means(centres, n, sums, span)
            common = grid[0] * np.exp(step * peak(sums.sum(0)[None, :])[0])
            trend = grid[0] * np.exp(step * peak(near))
            out.append([{"bin": int(b), "common": float(common), "trend": float(t), "shared": s.tolist()} for b, t, s in zip(centres, trend, near)])
        return pd.Series(out)

    # One row per type: its bins, at most 16 for each doubling of abundance.
    table = bins.groupBy("cell_type").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "s"))).alias("rows")).select(
        "cell_type", F.inline(along("rows")))

    @F.pandas_udf("double")
    def tagwise(apl: pd.Series, shared: pd.Series, df: pd.Series) -> pd.Series:
        if not len(apl):
            return pd.Series([], dtype=float)
        both = np.stack([np.asarray(a, float) for a in apl]) + np.stack([np.asarray(s, float) for s in shared]) * (prior_df / df.to_numpy(float))[:, None]
        return pd.Series(grid[0] * np.exp(step * peak(both)))

    return own.join(table, ["cell_type", "bin"]).join(residual, "cell_type").select(
        "cell_type", "part", "gene_id", "start", "average_log_cpm", F.col("common").alias("common_dispersion"),
        F.col("trend").alias("trended_dispersion"), tagwise("apl", "shared", "residual_df").alias("tagwise_dispersion"))


def quasi_likelihood_test(fits: DataFrame, dispersions: DataFrame, residual: DataFrame, p: int) -> DataFrame:
    """F test of the last column from the deviances with (variant 0) and without it (variant 1).

    Deviances over residual degrees of freedom are moderated across the genes of a type; their prior is that of the log
    variances' moments. A gene of whose two fits one did not converge has no test.
    """
    k = p * (p + 1) // 2
    deviance = 2 * (F.col("s")[k + p + 2] - F.col("s")[k + p])
    d = fits.withColumn("deviance", F.greatest(deviance, F.lit(0.0)))
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    both = d.groupBy("cell_type", "part", "gene_id").agg(
        pick(0, "deviance").alias("deviance"), pick(1, "deviance").alias("null_deviance"), F.every("converged").alias("converged"),
        F.max(F.when(F.col("variant") == 0, F.element_at("beta", -1))).alias("beta"))
    j = both.join(dispersions, ["cell_type", "part", "gene_id"]).join(residual, "cell_type").withColumn(
        "sigma2", F.when(F.col("converged"), F.col("deviance") / F.col("residual_df"))).withColumn("df", F.col("residual_df"))
    j = keep(j, "deviances")
    j = j.join(prior_variances(j), "cell_type", "left")
    post = (F.col("prior_df") * F.col("prior_var") + F.col("df") * F.col("sigma2")) / (F.col("prior_df") + F.col("df"))
    f = F.try_divide(F.greatest(F.col("null_deviance") - F.col("deviance"), F.lit(0.0)), post)
    j = j.withColumn("ql_dispersion", post).withColumn("ql_f_statistic", f)
    return j.select(
        "cell_type", "gene_id", F.when(F.col("converged"), F.col("beta") / F.log(F.lit(2.0))).alias("log2_fc_per_10_years"), "average_log_cpm",
        "common_dispersion", "trended_dispersion", "tagwise_dispersion", "ql_dispersion", "prior_df", "deviance", "null_deviance",
        "residual_df", "converged", "ql_f_statistic",
        f_upper("ql_f_statistic", F.lit(1.0), F.least(F.col("prior_df") + F.col("df"), F.lit(1e7))).alias("p_value"))


def count_models(profiles: DataFrame, sums: DataFrame, covariates: Sequence[str], *, min_replicates: int = 12, min_age_span: float = 12,
                 min_residual_df: int = 5, grid: Sequence[float] = GRID) -> tuple[DataFrame, DataFrame]:
    """Age effect of every kept gene of every type by a negative-binomial quasi-likelihood F test, and one row per type about it.

    A type whose covariates can't be estimated, or leave too few degrees of freedom, is tested with age alone
    (``age_only_sensitivity``); one that can't be tested that way either is ``excluded`` with its reason; one of which no gene
    gets a finite p value is ``model_failed``. Genes are kept, libraries summed and scaled with the type's own design.
    """
    profiles, sums = keep(profiles, "profiles"), keep(sums, "sums")
    scopes, d, x, _ = design_scopes(
        profiles, covariates, min_replicates=min_replicates, min_age_span=min_age_span, min_residual_df=min_residual_df)
    p = len(x)
    d = keep(d, "tested")
    genes = keep(expressed_genes(d, sums, design_sample_size(d, x)), "genes")
    d, kept = kept_libraries(d, sums, genes)
    d, kept = keep(d, "tested"), keep(kept, "kept")
    d = d.join(tmm_factors(d, kept).select("profile_id", "norm_factor"), "profile_id")
    tiles = tiles_of(keep(d, "tested"), kept, genes, x)
    totals = keep(gene_totals(tiles), "totals")
    residual = scopes.where("status = 'completed'").select("cell_type", "residual_df")
    grid_models = totals.select("cell_type", "part", "gene_id", "start", F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("variant", "phi"))
    fits = fit_models(tiles, grid_models, p, [list(range(p))] * len(grid))
    dispersions = keep(shared_dispersion(adjusted_profile(fits, p), totals, residual, grid), "dispersions")
    two = dispersions.select("cell_type", "part", "gene_id", "start", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"),
                             F.col("trended_dispersion").alias("phi"))
    last = fit_models(tiles, two, p, [list(range(p)), list(range(p - 1))])
    tests = keep(quasi_likelihood_test(last, dispersions, residual, p), "tests")
    results = tests.join(scopes.select("cell_type", "model_scope", "n_replicates", "age_span_years"), "cell_type")
    seen = sums.join(profiles.select("profile_id", "cell_type"), "profile_id").groupBy("cell_type").agg(F.count_distinct("gene_id").alias("n_genes_total"))
    done = tests.groupBy("cell_type").agg(F.count("p_value").alias("n_genes_tested"))
    about = scopes.join(seen, "cell_type", "left").join(done, "cell_type", "left").fillna(0, ["n_genes_total", "n_genes_tested"])
    failed = (F.col("status") == "completed") & (F.col("n_genes_tested") == 0)
    about = about.withColumn("reason", F.when(failed, "no_gene_with_a_finite_test").otherwise(F.col("reason"))).withColumn(
        "status", F.when(failed, "model_failed").otherwise(F.col("status")))
    return results, about
