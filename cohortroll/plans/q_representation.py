"""Representation, neighbours, clusters and labels over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortroll.operators import graph_clusters as gc
from cohortroll.operators import represent as rp
from cohortroll.plans import bindings as b
from cohortroll.plans.registry import query
from cohortroll.session import keep


@query("pca_representation")
def pca_representation(spark, folder):
    return rp.pca_representation(b.counts_b(spark, folder), b.cells_b(spark, folder).select("cell_id"), 50, 10)


@query("nearest_neighbours", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS src,
 b.vec_id AS dst, round(list_distance(a.v, b.v), 9) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT src, dst, round(dist, 6) AS dist,
 (row_number() OVER (PARTITION BY src ORDER BY dist, dst))::INTEGER AS rank FROM d QUALIFY rank <= 15""")
def nearest_neighbours(spark, folder):
    return b.rounded(rp.exact_neighbours(b.vectors(spark, folder), 15))


@query("vector_clusters")
def vector_clusters(spark, folder):
    clusters = rp.cluster_vectors(b.vectors(spark, folder), 10)
    return rp.cluster_sizes(clusters, ["cluster"])


@query("shared_neighbour_edges", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS src,
 b.vec_id AS dst, round(list_distance(a.v, b.v), 9) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id), near AS (SELECT src, dst FROM d
 QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 15), l AS (SELECT src, list(dst) || [src] AS l FROM near GROUP BY src),
 p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM near) SELECT a, b, len(list_intersect(x.l, y.l))::BIGINT AS w
 FROM p JOIN l x ON x.src = a JOIN l y ON y.src = b""")
def shared_neighbour_edges(spark, folder):
    return gc.shared_neighbour_edges(keep(rp.exact_neighbours(b.vectors(spark, folder), 15).select("src", "dst"), "neighbours"))


@query("graph_clusters")
def graph_clusters(spark, folder):
    return gc.graph_clusters(b.vectors(spark, folder), shared_neighbour_edges(spark, folder))


@query("partition_agreement", f"""WITH {b.CELLS_A}, c AS (SELECT cluster AS a, CASE WHEN cell_id % 3 = 0 THEN cluster ELSE cell_type END AS b,
 count(*)::DOUBLE AS n FROM cells GROUP BY ALL), r AS (SELECT sum(n) AS n FROM c GROUP BY a), k AS (SELECT sum(n) AS n FROM c GROUP BY b), s AS
 (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM r) AS pa, (SELECT sum(n * (n - 1) / 2) FROM k) AS pb,
 (SELECT sum(n) FROM c) AS n, (SELECT sum(n * ln(n)) FROM c) AS lc, (SELECT sum(n * ln(n)) FROM r) AS la, (SELECT sum(n * ln(n)) FROM k) AS lb)
 SELECT round((pc - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 8) AS ari,
 round(((lc - la - lb) / n + ln(n)) / ((ln(n) - la / n + ln(n) - lb / n) / 2), 8) AS nmi FROM s""")
def partition_agreement(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", F.col("cluster").alias("a"), F.when(
        F.col("cell_id") % 3 == 0, F.col("cluster")).otherwise(F.col("cell_type")).alias("b"))
    return b.rounded(rp.partition_agreement(cells, "a", "b"), 8)


@query("cluster_agreement_with_labels")
def cluster_agreement_with_labels(spark, folder):
    v = b.vectors(spark, folder)
    c = rp.cluster_vectors(v, 10).join(v.select("cell_id", "cell_type"), "cell_id")
    return rp.partition_agreement(c, "cluster", "cell_type")


@query("classified_cells", f"""WITH {b.COUNTS_BRAND}, lab AS (SELECT * FROM (VALUES ('A', 0), ('B', 1), ('C', 2)) t(label, li)), w AS (SELECT p_brand
 AS gene_id, label, ((max(p_size) * 7 + count(*) * 3 + li * 13) % 11 - 5) / 50.0::DOUBLE AS coef FROM part, lab GROUP BY p_brand, label, li), t AS (SELECT cell_id,
 sum(count) AS total FROM counts GROUP BY 1), s AS (SELECT cell_id, label, sum(coef * ln(1 + count * 10000.0::DOUBLE / total)) AS s FROM counts JOIN t USING
 (cell_id) JOIN w USING (gene_id) GROUP BY ALL), z AS (SELECT o_orderkey AS cell_id, lab.label, round(1 / (1 + exp(-(li / 20 + coalesce(s, 0)))), 12)
 AS p FROM orders CROSS JOIN lab LEFT JOIN s ON s.cell_id = o_orderkey AND s.label = lab.label) SELECT cell_id, label, round(p, 8) AS confidence FROM z
 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY p DESC, label) = 1""")
def classified_cells(spark, folder):
    """A weight table derived from the parts stands in for a trained model."""
    labels = F.array(*[F.struct(F.lit(v).alias("label"), F.lit(i).alias("li")) for i, v in enumerate("ABC")])
    weights = b.table(spark, folder, "part").groupBy(F.col("p_brand").alias("gene_id")).agg(
        F.max("p_size").alias("m"), F.count(F.lit(1)).alias("c")).select("gene_id", "m", "c", F.inline(labels)).select(
        "gene_id", "label", (((F.col("m") * 7 + F.col("c") * 3 + F.col("li") * 13) % 11 - 5) / 50.0).alias("coef"))
    intercepts = b.table(spark, folder, "part").groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.inline(labels)).select(
        "label", (F.col("li") / 20).alias("intercept"))
    cells = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("cell_id"))
    return b.rounded(rp.classify_cells(cells, b.counts_b(spark, folder, "brand"), weights, intercepts), 8)


@query("label_model_fit")
def label_model_fit(spark, folder):
    return rp.train_label_model(b.vectors(spark, folder), "cell_type", max_iter=10)


@query("cluster_majority_labels", f"""WITH {b.CELLS_A}, m AS (SELECT cluster, cell_type FROM cells GROUP BY cluster, cell_type QUALIFY row_number() OVER (PARTITION BY
 cluster ORDER BY count(*) DESC, cell_type) = 1) SELECT cell_id, c.cell_type, m.cell_type AS majority_label FROM cells c JOIN m USING (cluster)""")
def cluster_majority_labels(spark, folder):
    cells = b.cells_a(spark, folder).select("cell_id", "cluster", "cell_type")
    return rp.majority_vote(cells, "cluster", "cell_type").drop("cluster")
