"""Clusters of cells on their neighbour graph, at a granularity set by a resolution.

An edge weighs as many neighbours as its ends share, so all sums are whole numbers and every run gives the same clusters.
Cells move to the neighbouring cluster of highest modularity gain in rounds over all edges; clusters that have settled
become the nodes of the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortroll.session import keep

ROUNDS = 20  # of moves on a level, at most
LEVELS = 10
SETTLED = 1000  # a level ends once two rounds together move less than one node in so many


def shared_neighbour_edges(neighbours: DataFrame) -> DataFrame:
    """``a, b, w`` (a < b) for each pair in the lists ``src, dst``: how many members their neighbourhoods share.

    A neighbourhood is a node's list and the node itself, so each weight is at least one.
    """
    lists = keep(neighbours.groupBy("src").agg(F.collect_set("dst").alias("l")).select(
        F.col("src").alias("node"), F.array_union("l", F.array("src")).alias("l")), "lists")
    pairs = neighbours.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    side = lambda name: lists.select(F.col("node").alias(name), F.col("l").alias(f"l{name}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    own = [F.coalesce(F.col(f"l{c}"), F.array(c)) for c in "ab"]
    return both.select("a", "b", F.size(F.array_intersect(*own)).cast("bigint").alias("w"))


def graph_modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of the clusters ``cell_id, cluster`` on the edges ``a, b, w``; null without edges."""
    of = lambda end, name: clusters.select(F.col("cell_id").alias(end), F.col("cluster").alias(name))
    named = edges.join(of("a", "ca"), "a").join(of("b", "cb"), "b")
    inside = F.when(F.col("ca") == F.col("cb"), 2 * F.col("w")).otherwise(0)
    ends = F.array(F.struct(F.col("ca").alias("c"), inside.alias("i"), F.col("w")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("i"), F.col("w")))
    sums = named.select(F.inline(ends)).groupBy("c").agg(F.sum("i").alias("i"), F.sum("w").alias("t"))
    one = sums.agg(F.sum("i").alias("i"), F.sum(F.pow(F.col("t").cast("double"), F.lit(2))).alias("t2"), F.sum("t").alias("all"))
    all_ = F.col("all").cast("double")
    return one.select(F.try_divide("i", all_).alias("inside"), F.try_divide("t2", all_ * all_).alias("expected")).select(
        (F.col("inside") - resolution * F.col("expected")).alias("modularity"))


def _round(both: DataFrame, state: DataFrame, number: int, scale: float) -> DataFrame:
    """The labels after the half of the nodes that this round's hash picks has moved to where its gain is highest.

    ``scale`` is the resolution over all degrees. Ties go to the smaller label.
    """
    totals = state.groupBy("label").agg(F.sum("degree").alias("total"))
    own = state.join(totals, "label").select(F.col("node").alias("src"), F.col("label").alias("own"), "degree", F.col("total").alias("own_total"))
    there = own.select(F.col("src").alias("dst"), F.col("own").alias("label"), F.col("own_total").alias("total"))
    # Edges carry their cluster's total along and meet once at their source: two shuffles of edges a round, the rest are of nodes.
    links = both.join(there, "dst").select("src", "label", "total", "w").repartition("src").groupBy("src", "label", "total").agg(F.sum("w").alias("w"))
    here = F.col("label") == F.col("own")
    gain = F.col("w") - scale * F.col("degree") * (F.col("total") - F.when(here, F.col("degree")).otherwise(0))
    best = links.join(own, "src").groupBy("src").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("label")).alias("label"))).alias("m"), F.max(F.when(here, F.col("w"))).alias("w"))
    stay = F.coalesce("w", F.lit(0)) - scale * F.col("degree") * (F.col("own_total") - F.col("degree"))
    moves = (F.xxhash64("src", F.lit(number)).bitwiseAND(F.lit(1)) == 0) & (F.col("m.gain") > stay + 1e-9)
    to = F.when(F.coalesce(moves, F.lit(False)), -F.col("m.label")).otherwise(F.col("own"))
    return own.join(best, "src", "left").select(F.col("src").alias("node"), to.alias("label"), "degree", (to != F.col("own")).alias("moved"))


def _settled(edges: DataFrame, degrees: DataFrame, scale: float) -> DataFrame:
    """``node, label`` once hardly any node of a level moves any more."""
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).select(
        F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "level-edges")
    state, before = keep(degrees.select("node", F.col("node").alias("label"), "degree"), "level"), None
    for number in range(ROUNDS):
        state = keep(_round(both, state, number, scale), "level")
        n, moved = state.agg(F.count("*"), F.count_if("moved")).first()
        if before is not None and (before + moved) * SETTLED <= n:
            break
        before = moved
    return state.select("node", "label")


def graph_clusters(cells: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``cell_id, cluster, n_cells, modularity`` for every distinct cell; a cluster's name is its smallest cell.

    ``edges`` are ``a, b, w`` with whole weights. Higher resolutions give more, smaller clusters. Cells without an edge are
    clusters of their own. A level is taken only if it raises the modularity, which is null without edges.
    """
    edges = keep(edges.select("a", "b", "w"), "graph")
    found = keep(cells.select("cell_id").where("cell_id is not null").distinct().withColumn("cluster", F.col("cell_id")), "clusters")
    doubled = 2 * (edges.agg(F.sum("w")).first()[0] or 0)
    level, best = edges, graph_modularity(edges, found, resolution).first()[0]
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), "w"), F.struct(F.col("b").alias("node"), "w"))))
    degrees = keep(ends.groupBy("node").agg(F.sum("w").alias("degree")), "degrees")
    for _ in range(LEVELS if doubled else 0):
        labels = keep(_settled(level, degrees, resolution / doubled), "labels")
        joined = found.join(labels, found["cluster"] == labels["node"], "left").select("cell_id", F.coalesce("label", "cluster").alias("cluster"))
        joined = keep(joined, "clusters")
        value = graph_modularity(edges, joined, resolution).first()[0]
        if value <= best + 1e-9:
            break
        found, best = joined, value
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        between = level.join(of("a"), "a").join(of("b"), "b").where("la <> lb")
        level = keep(between.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w")), "level-edges")
        degrees = keep(degrees.join(labels, "node").groupBy(F.col("label").alias("node")).agg(F.sum("degree").alias("degree")), "degrees")
    names = found.groupBy("cluster").agg(F.min("cell_id").alias("name"), F.count("*").alias("n_cells"))
    return found.join(names, "cluster").select("cell_id", F.col("name").alias("cluster"), "n_cells", F.lit(best).cast("double").alias("modularity"))
