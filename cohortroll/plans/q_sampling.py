"""Sampling, allocation, folds and bootstrap over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.operators import sampling as sp
from cohortroll.plans import bindings as b
from cohortroll.plans.q_models import FRACTIONS_SQL, fractions
from cohortroll.plans.registry import query


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15))::BIGINT"


REPLICATES = 2_000


def draws_sql(source: str, keys: str, seed: int, n: str) -> str:
    """``keys, b, i``: the row that each draw of each replicate hits, for tests of one leaf; ``n`` names a test's rows."""
    def mixed(rows: str) -> str:
        for step in ("xor(h, h >> 16)", f"h * {sp.resampling.FIRST}::UBIGINT % 4294967296::UBIGINT", "xor(h, h >> 13)",
                     f"h * {sp.resampling.SECOND}::UBIGINT % 4294967296::UBIGINT", "xor(h, h >> 16)"):
            rows = f"(SELECT * REPLACE ({step} AS h) FROM {rows})"
        return rows

    names = [k.strip() for k in keys.split(",") if k.strip()]
    listed = "".join(f"{k}, " for k in names)
    tests = f"(SELECT DISTINCT {listed}{n} AS n_rows FROM {source})"
    starts = mixed(f"""(SELECT t.*, b, (({hash_sql(f"'{seed}'", *[f"{k}::VARCHAR" for k in names])} % 4294967296 + b * {sp.resampling.REPLICATE})
 % 4294967296)::UBIGINT AS h FROM {tests} t, (SELECT unnest(range(1, {REPLICATES + 1})) AS b))""")
    slots = mixed(f"""(SELECT s.* REPLACE (((h + slot * {sp.resampling.DRAW}) % 4294967296)::UBIGINT AS h) FROM (SELECT *, unnest(range(n_rows)) AS slot
 FROM {starts}) s)""")
    return f"(SELECT {listed}b, (h * n_rows::UBIGINT >> 32)::BIGINT AS i FROM {slots})"


GROUP_SQL = f"""{b.CELLS_A}, g AS (SELECT sample_unit_id, cell_type, count(*) AS size, sum(k)::BIGINT AS w FROM cells
 GROUP BY ALL), gh AS (SELECT *, {hash_sql("sample_unit_id", "cell_type")} AS h, sample_unit_id || '|' || cell_type AS id
 FROM g)"""


def allocation_sql(weight: str, cap: str, total: str, source: str = "gh") -> str:
    return f"""a1 AS (SELECT *, {weight} AS w_, {cap} AS cap_ FROM {source}), a2 AS (SELECT *, least({total}, sum(cap_)
 OVER ()) AS bud, sum(w_) OVER () AS sw FROM a1), a3 AS (SELECT *, w_::DOUBLE / sw * bud AS quota FROM a2), a4 AS (SELECT *,
 least(floor(quota), cap_) AS fl, quota - floor(quota) AS fr FROM a3), a5 AS (SELECT *, CASE WHEN fl < cap_ THEN row_number()
 OVER (PARTITION BY fl < cap_ ORDER BY fr DESC, h, id) END AS turn, bud - sum(fl) OVER () AS lft FROM a4), a6 AS (SELECT *,
 fl + coalesce(turn <= lft, false)::INTEGER AS sec FROM a5), a7 AS (SELECT *, cap_ - sec AS cl, bud - sum(sec) OVER () AS rest
 FROM a6), a8 AS (SELECT *, coalesce(sum(cl) OVER (ORDER BY cl DESC, h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 0) AS earlier FROM a7), alloc AS (SELECT *, (sec + greatest(0, least(cl, rest - earlier)))::BIGINT AS got FROM a8)"""


def group_sizes(spark, folder):
    return b.cells_a(spark, folder).groupBy("sample_unit_id", "cell_type").agg(
        F.count(F.lit(1)).alias("size"), F.sum("k").alias("w"))


@query("weighted_capped_allocation", f"""WITH {GROUP_SQL}, {allocation_sql("w", "least(size, 3)", "6000")}
 SELECT sample_unit_id, cell_type, got AS allocation FROM alloc""")
def weighted_capped_allocation(spark, folder):
    sizes = group_sizes(spark, folder).withColumn("cap", F.least("size", F.lit(3).cast("bigint")))
    out = sp.capped_allocation(sizes, ["sample_unit_id", "cell_type"], "w", "cap", 6000)
    return out.select("sample_unit_id", "cell_type", "allocation")


MUST = "CASE WHEN size >= 3 THEN 3 ELSE 0 END"


# When the minimum alone takes up the budget, only large groups share it, by size.
BUDGET_SQL = f"""gm AS (SELECT * REPLACE (CASE WHEN needed >= 7500 THEN 0 ELSE must END AS must), CASE WHEN needed < 7500 THEN size - must WHEN size >= 3 THEN
 size ELSE 0 END AS room, CASE WHEN needed < 7500 THEN 7500 - needed ELSE 7500 END AS rest_of_budget FROM (SELECT *, {MUST} AS must, sum({MUST}) OVER () AS
 needed FROM gh)), {allocation_sql("room", "room", "rest_of_budget", "gm")}"""


@query("group_budget_allocation", f"""WITH {GROUP_SQL}, {BUDGET_SQL} SELECT sample_unit_id, cell_type, size,
 must + got AS allocation FROM alloc""")
def group_budget_allocation(spark, folder):
    sizes = group_sizes(spark, folder).drop("w")
    return sp.allocate_budget(sizes, ["sample_unit_id", "cell_type"], "size", 7500, 3)


@query("tight_budget_allocation", f"""WITH {GROUP_SQL}, {allocation_sql("CASE WHEN size >= 4 THEN size ELSE 0 END",
 "CASE WHEN size >= 4 THEN size ELSE 0 END", "900")} SELECT sample_unit_id, cell_type, size, got AS allocation FROM alloc""")
def tight_budget_allocation(spark, folder):
    sizes = group_sizes(spark, folder).drop("w")
    return sp.allocate_budget(sizes, ["sample_unit_id", "cell_type"], "size", 900, 4)


@query("stratified_cell_sample", f"""WITH {GROUP_SQL}, {BUDGET_SQL}, r AS (SELECT cell_id, sample_unit_id, cell_type,
 row_number() OVER (PARTITION BY sample_unit_id, cell_type ORDER BY md5('5|' || cell_id), cell_id) AS rn FROM cells)
 SELECT cell_id FROM r JOIN alloc USING (sample_unit_id, cell_type) WHERE rn <= must + got""")
def stratified_cell_sample(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "sample_unit_id", "cell_type")
    return sp.stratified_take(cells, ["sample_unit_id", "cell_type"], ["cell_id"], 7500, 3, seed=5).select("cell_id")


FOLDS_SQL = f"""{b.CELLS_A}, sz AS (SELECT subject_id, count(*) AS n_rows FROM cells GROUP BY 1), ps AS (SELECT *,
 row_number() OVER (ORDER BY n_rows DESC, {hash_sql("subject_id")}, subject_id) - 1 AS pos, least(5, count(*) OVER ()) AS k
 FROM sz), folds AS (SELECT subject_id, n_rows, (CASE WHEN (pos // k) % 2 = 0 THEN pos % k ELSE k - 1 - pos % k END)::INTEGER
 AS fold FROM ps)"""


@query("subject_grouped_folds", f"WITH {FOLDS_SQL} SELECT * FROM folds")
def subject_grouped_folds(spark, folder):
    return sp.grouped_folds(b.cells_a(spark, folder).select("subject_id"), "subject_id", 5)


@query("fold_cover_and_leaks", f"""WITH {FOLDS_SQL} SELECT fold, count(*) AS n_subjects, sum(n_rows)::BIGINT AS n_rows,
 0::BIGINT AS n_leaks FROM folds GROUP BY 1""")
def fold_cover_and_leaks(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "subject_id")
    folds = sp.grouped_folds(cells, "subject_id", 5)
    rows = cells.join(folds.drop("n_rows"), "subject_id")
    leaks = sp.fold_leaks(rows, "subject_id", "fold").agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy("fold").agg(F.count_distinct("subject_id").alias("n_subjects"),
                                    F.count(F.lit(1)).alias("n_rows")).withColumn("n_leaks", leaks)


@query("row_bootstrap_intervals", f"""WITH {FRACTIONS_SQL}, nb AS (SELECT cell_type, age, fraction, row_number() OVER (PARTITION
 BY cell_type ORDER BY {hash_sql("sample_unit_id")}, sample_unit_id) - 1 AS i, count(*) OVER (PARTITION BY cell_type) AS n FROM
 fractions), dr AS {draws_sql("nb", "cell_type", 11, "n")}, pk AS (SELECT d.cell_type, d.b, age, fraction FROM dr d JOIN nb ON nb.cell_type = d.cell_type
 AND nb.i = d.i), rk AS (SELECT *, rank() OVER (PARTITION BY cell_type, b ORDER BY age) + (count(*) OVER (PARTITION BY
 cell_type, b, age) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY cell_type, b ORDER BY fraction) + (count(*) OVER (PARTITION BY
 cell_type, b, fraction) - 1) / 2.0 AS ry FROM pk), st AS (SELECT cell_type, b, corr(rx, ry) AS rho, regr_slope(fraction, age)
 AS slope FROM rk GROUP BY ALL)
 SELECT cell_type, count(*) AS n_good, round(quantile_cont(rho, 0.025), 7) AS spearman_rho_ci_low, round(quantile_cont(rho,
 0.975), 7) AS spearman_rho_ci_high, round(quantile_cont(slope, 0.025), 8) AS slope_per_year_ci_low,
 round(quantile_cont(slope, 0.975), 8) AS slope_per_year_ci_high FROM st GROUP BY 1""")
def row_bootstrap_intervals(spark, folder):
    out = sp.row_bootstrap(fractions(spark, folder), ["cell_type"], "sample_unit_id", "age", "fraction", REPLICATES, 0.95, 11)
    return out.select("cell_type", "n_good", *[F.round(c, 7).alias(c) for c in out.columns if c.startswith("spearman")],
                      *[F.round(c, 8).alias(c) for c in out.columns if c.startswith("slope")])


@query("subject_bootstrap_intervals", f"""WITH {b.CELLS_A}, ps AS (SELECT subject_id, count(*) AS n, sum(abs(age - 42)) AS ae,
 sum((age - 42) * (age - 42)) AS se, sum(age) AS t1, sum(age * age) AS t2 FROM cells GROUP BY 1), nb AS (SELECT *, row_number()
 OVER (ORDER BY {hash_sql("subject_id")}, subject_id) - 1 AS i, count(*) OVER () AS m FROM ps), dr AS {draws_sql("nb", "", 3, "m")}, rp AS (SELECT d.b, sum(ae) / sum(n)
 AS mae, 1 - sum(se) / (sum(t2) - sum(t1) * sum(t1) / sum(n)) AS r2 FROM dr d JOIN nb ON nb.i = d.i GROUP BY 1)
 SELECT round(quantile_cont(mae, 0.025), 6) AS mae_ci_low, round(quantile_cont(mae, 0.975), 6) AS mae_ci_high,
 round(quantile_cont(r2, 0.025), 6) AS r2_ci_low, round(quantile_cont(r2, 0.975), 6) AS r2_ci_high FROM rp""")
def subject_bootstrap_intervals(spark, folder):
    cells = b.cells_a(spark, folder).select("subject_id", "age", F.lit(42.0).alias("pred"))
    return b.rounded(sp.cluster_bootstrap(cells, "subject_id", "age", "pred", REPLICATES, 0.95, 3))


@query("mean_delta_bootstrap", f"""WITH f AS (SELECT l_returnflag AS model, l_suppkey AS fold, avg(l_discount * 100) - 5 AS d
 FROM lineitem GROUP BY ALL), nb AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {hash_sql("fold::VARCHAR")},
 fold::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM f), dr AS {draws_sql("nb", "model", 8, "n")}, rp AS (SELECT d.model, d.b, avg(nb.d) AS m FROM dr d
 JOIN nb ON nb.model = d.model AND nb.i = d.i GROUP BY ALL)
 SELECT model, round(quantile_cont(m, 0.025), 7) AS mean_ci_low, round(quantile_cont(m, 0.975), 7) AS mean_ci_high,
 round(avg((m > 0)::INTEGER), 8) AS share_above_zero FROM rp GROUP BY 1""")
def mean_delta_bootstrap(spark, folder):
    f = b.table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("fold")).agg(
        (F.avg(F.col("l_discount") * 100) - 5).alias("d"))
    return b.rounded(sp.mean_bootstrap(f, ["model"], "fold", "d", REPLICATES, 0.95, 8), 7)
