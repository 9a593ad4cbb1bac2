from collections import Counter

import numpy as np

from cohortroll.operators import graph_clusters as gc
from cohortroll.operators.represent import TILE_BYTES, TILES, cluster_vectors, exact_neighbours, tile_count


def modularity_by_hand(edges, of, resolution=1.0):
    all_ = 2 * sum(w for _, _, w in edges)
    inside, total = Counter(), Counter()
    for a, b, w in edges:
        total[of[a]] += w
        total[of[b]] += w
        inside[of[a]] += 2 * w * (of[a] == of[b])
    return sum(inside[c] / all_ - resolution * (total[c] / all_) ** 2 for c in total)


def test_planted_groups_on_the_neighbour_graph(spark):
    rng = np.random.default_rng(5)
    planted = np.repeat(np.arange(6), [60, 50, 40, 30, 20, 10])
    x = np.concatenate([rng.normal(size=(len(planted), 8)) + 9 * rng.normal(size=(6, 8))[planted]])
    vectors = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "cell_id bigint, vec array<float>")
    lists = exact_neighbours(vectors, 8).select("src", "dst")
    near = {}
    for r in lists.collect():
        near.setdefault(r.src, {r.src}).add(r.dst)
    want = {(min(a, b), max(a, b), len(near[a] & near[b])) for a in near for b in near[a] if a != b}
    edges = [tuple(r) for r in gc.shared_neighbour_edges(lists).collect()]
    assert len(edges) == len(want) and set(edges) == want
    graph = spark.createDataFrame(edges, "a bigint, b bigint, w bigint")
    rows = gc.graph_clusters(vectors, graph).collect()
    of = {r.cell_id: r.cluster for r in rows}
    assert len(rows) == len(of) == len(x) and all(v <= k and of[v] == v for k, v in of.items())
    size = Counter(of.values())
    assert all(r.n_cells == size[r.cluster] for r in rows)
    assert {round(r.modularity, 9) for r in rows} == {round(modularity_by_hand(edges, of), 9)}
    assert all(len({planted[k] for k in of if of[k] == c}) == 1 for c in size)  # no cluster spans two groups
    means = {r.cell_id: r.cluster for r in cluster_vectors(vectors, 6).collect()}
    assert rows[0].modularity >= modularity_by_hand(edges, means) - 1e-9
    finer = {r.cell_id: r.cluster for r in gc.graph_clusters(vectors, graph, 8.0).collect()}
    assert len(set(finer.values())) > len(size)


def test_cells_without_edges_and_empty_tables(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,), (3,), (9,), (None,)], "cell_id bigint")
    edges = spark.createDataFrame([(1, 2, 4)], "a bigint, b bigint, w bigint")
    rows = {tuple(r) for r in gc.graph_clusters(cells, edges).collect()}
    assert rows == {(1, 1, 2, 0.0), (2, 1, 2, 0.0), (3, 3, 1, 0.0), (9, 9, 1, 0.0)}
    alone = gc.graph_clusters(cells, edges.limit(0)).collect()
    assert {(r.cell_id, r.cluster, r.modularity) for r in alone} == {(k, k, None) for k in (1, 2, 3, 9)}
    assert gc.graph_clusters(cells.limit(0), edges.limit(0)).count() == 0


def shuffled(spark, work):
    """Bytes that the stages of ``work`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_vectors_are_sent_to_a_fixed_number_of_tiles(spark):
    """Growing the table eightfold sends eight times as much, not its square; distances of near copies are those of differences."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(24_576, 8)).astype("float32")
    x[1::64] = x[::64] + np.float32(1e-3)  # near copies
    x += np.float32(100)
    assert tile_count(600_000, 64) == tile_count(100_000, 64) == TILES and tile_count(50 * TILE_BYTES // 64, 64) == 200
    sent = {}
    for n in (3_072, 24_576):
        vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:n])], "cell_id bigint, vec array<float>").cache()
        vectors.count()
        sent[n] = shuffled(spark, lambda: exact_neighbours(vectors, 3).write.format("noop").mode("overwrite").save())
    # From three tiles to all of them.
    assert sent[24_576] < 8 * TILES / 3 * 1.5 * sent[3_072]
    got = {}
    for r in exact_neighbours(vectors, 3).where("src % 640 < 2").collect():
        got.setdefault(r.src, []).append((r.dist, r.dst))
    for src, found in got.items():
        d = np.round(np.sqrt(((x.astype(float) - x[src].astype(float)) ** 2).sum(1)), 9)
        want = sorted((v, k) for k, v in enumerate(d.tolist()) if k != src)[:3]
        assert sorted(found) == want


def test_round_sends_edges_twice(spark):
    """A round's plan exchanges the edges by their end and by their source, and nothing else of their size."""
    edges = spark.range(20_000).selectExpr("id % 5000 AS src", "(id * 7 + 1) % 5000 AS dst", "1L AS w")
    state = spark.range(5_000).selectExpr("id AS node", "id AS label", "4L AS degree")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = gc._round(edges, state, 0, 0.001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    assert not any("hashpartitioning(src" in line and "label" in line.split("hashpartitioning(")[1].split("),")[0] for line in plan.splitlines())
    assert sum("hashpartitioning(src" in line and "REPARTITION" in line for line in plan.splitlines()) == 1
