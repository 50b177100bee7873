"""Hand-computed layouts: sightlines, lattices, lifted edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselle.operators import graph, moves, prep, spatial
from tesselle.operators.components import connected_components

BOX = "id long, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rects):
    """Boxes from (x, y, width, height)."""
    return spark.createDataFrame([(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rects)], BOX)


def sight(spark, rects, reach=100.0, epsilon=0.5, obstacles=None):
    b = boxes(spark, rects)
    pairs = spatial.within_distance(b, reach)
    o = b if obstacles is None else boxes(spark, obstacles)
    edges = spatial.line_of_sight(pairs, o.drop("id"), epsilon)
    return pairs.count(), {(r.src, r.dst) for r in edges.collect()}


def test_row_of_three_lots(spark):
    assert sight(spark, [(0, 0, 50, 100), (60, 0, 50, 100), (120, 0, 50, 100)]) == (3, {(0, 1), (1, 2)})


def test_clear_gap_and_canal(spark):
    homes = [(0, 0, 50, 100), (130, 0, 50, 100)]
    assert sight(spark, homes)[1] == {(0, 1)}
    assert sight(spark, homes, obstacles=[*homes, (55, -50, 70, 200)])[1] == set()


def test_four_lots_meeting(spark):
    assert len(sight(spark, [(0, 0, 100, 100), (100, 0, 100, 100), (0, 100, 100, 100), (100, 100, 100, 100)])[1]) == 6


def test_sliver_and_threshold(spark):
    assert sight(spark, [(0, 0, 50, 100), (50.01, 0, 50, 100)])[1] == {(0, 1)}
    far = [(0, 0, 50, 100), (200, 0, 50, 100)]
    assert sight(spark, far)[0] == 0
    assert sight(spark, far, 200.0)[1] == {(0, 1)}


def lattice(n, size, gap):
    return [(c * (size + gap), r * (size + gap), size, size) for r in range(n) for c in range(n)]


def test_lattice_classes(spark):
    def counts(gap, reach):
        e = spatial.edge_classes(spatial.within_distance(boxes(spark, lattice(3, 100, gap)), reach))
        return {r.edge_class: (r["count"], r.far) for r in e.groupBy("edge_class").agg(F.count("*").alias("count"), F.max("gap_ft").alias("far")).collect()}

    assert counts(0, 1.0) == {"rook": (12, 0.0), "corner": (8, 0.0)}
    assert counts(40, 50.0) == {"gap": (12, 40.0)}


def test_checkerboard_and_solid(spark):
    def label(n, odd):
        pairs = spatial.edge_classes(spatial.within_distance(boxes(spark, lattice(n, 100, 0)), 1.0))
        inside = pairs.filter((((F.floor(F.col("src") / n) + F.col("src") % n) % 2) == ((F.floor(F.col("dst") / n) + F.col("dst") % n) % 2)) | F.lit(not odd))
        tiles = spark.range(n * n).withColumnRenamed("id", "tile_id")
        parts = lambda e: graph.tile_components(e.select("src", "dst"), tiles).select("component").distinct().count()
        return parts(inside), parts(inside.filter("edge_class = 'rook'")), spatial.weak_tiles(inside).count()

    assert label(5, True) == (2, 25, 25)
    assert label(4, False) == (1, 1, 0)


def test_lift(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    tile_of = spark.createDataFrame([(0, 7), (1, 7), (2, 9)], "parcel_id long, tile_id long")
    lifted = spatial.lift_edges(edges, tile_of)
    assert [(r.src, r.dst) for r in lifted.collect()] == [(7, 9)]
    tiles = spark.createDataFrame([(7,), (9,), (11,)], "tile_id long")
    assert {r.tile_id: r.neighbours for r in spatial.adjacency_with_isolates(lifted, tiles).collect()} == {7: 1, 9: 1, 11: 0}


def test_components_against_plain(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (1000, 1000), (None, 3)]
    up = {v: v for e in edges for v in e if None not in e}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        if None not in (a, b):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    table = spark.createDataFrame(edges, "src long, dst long")
    text = table.select(F.format_string("v%04d", "src").alias("src"), F.format_string("v%04d", "dst").alias("dst")).filter("src not like '%null%'")
    for local in (0, 10_000):
        got = {r.node: r.component for r in connected_components(table, local_edges=local).collect()}
        assert got == {v: find(v) for v in up}
        named = {r.node: r.component for r in connected_components(text, local_edges=local).collect()}
        assert named == {f"v{v:04d}": f"v{find(v):04d}" for v in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_longest_first():
    weights = list(enumerate([15404, 9923, 7025, 1942, 1581, 1297, 100, 50, 10, 1]))
    for n in (1, 2, 4, 8):
        found = dict(graph.longest_first(weights, n))
        loads = [sum(w for c, w in weights if found[c] == g) for g in range(n)]
        assert len(found) == 10 and max(loads) >= 15404 and sum(loads) == sum(w for _, w in weights)
    assert graph.longest_first([(1, 0), (2, 5)], 2) == [(2, 0)]


def test_worker_count(spark):
    def workers(weights, request):
        sizes = spark.createDataFrame([(i, 1, w) for i, w in enumerate(weights)], "component long, tiles long, parcels long")
        return graph.useful_workers(sizes, request).first().workers

    assert [workers([1000, 1, 1], 0), workers([100] * 4, 0), workers([100, 100], 8), workers([100], 8)] == [1, 4, 2, 1]


def test_obstacle_modes(spark):
    everything = spark.createDataFrame([("HOUSE",), ("HOUSE",), ("RIGHT-OF-WAY",), ("WAREHOUSE",)], "land_class string")
    modeled = everything.filter("land_class = 'HOUSE'")
    clear = prep.transparent("land_class")
    assert [spatial.select_obstacles(modeled, everything, m, clear).count() for m in ("modeled", "all", "all_except")] == [2, 4, 3]
    assert spatial.select_obstacles(modeled, None, "all").count() == 2


def test_articulation(spark):
    # A path 0-1-2 with a side way 0-3-2 is safe at 1; without it, not.
    labels = spark.createDataFrame([(t, 1 if t < 4 else 2, 1, False) for t in range(6)], "tile_id long, nid long, parcels long, mixed boolean")
    for extra, splits in (([(0, 3), (2, 3)], set()), ([], {1})):
        edges = spark.createDataFrame([(0, 1), (1, 2), (1, 4), (2, 5), *extra], "src long, dst long")
        ways = moves.donations(moves.boundary(edges, labels), labels)
        got = {r.tile for r in moves.disconnecting(ways, edges, labels).collect()}
        assert got & {1} == splits


def test_footprint_queries_take_every_parcel(spark, tmp_path):
    """Parcels of high ids too: pairs, lifted tiles and the nearest box against brute force."""
    from tesselle.plans import registry

    ids = [*range(1, 400), *range(11_900, 12_300), *range(149_000, 149_400)]
    spark.createDataFrame([(i,) for i in ids], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    at = {i: (i * 7919 % 9973 + 10_000 * (i // 12_000), i * 104729 % 9967) for i in ids}
    gap = lambda p, q: max(0, abs(p - q) - 50)
    pairs = {(i, j) for i in ids for j in ids if i < j and gap(at[i][0], at[j][0]) ** 2 + gap(at[i][1], at[j][1]) ** 2 <= 100**2}
    assert any(j >= 12_000 for _, j in pairs)
    assert {(r.src, r.dst) for r in registry.QUERIES["dwithin_boxes"](spark, str(tmp_path)).collect()} == pairs
    tile = lambda i: at[i][0] // 1000 * 10 + at[i][1] // 1000
    lifted = {(min(tile(i), tile(j)), max(tile(i), tile(j))) for i, j in pairs if tile(i) != tile(j)}
    assert {(r.src, r.dst) for r in registry.QUERIES["tile_lift"](spark, str(tmp_path)).collect()} == lifted
    out = lambda p, q: max(0, abs(p - q) - 25)
    near = {k: min((out(at[i][0], x) ** 2 + out(at[i][1], y) ** 2, i) for i in ids) for k, (x, y) in enumerate([(700, 700), (5000, 5000), (9990, 10)])}
    assert {r.query: r.id for r in registry.QUERIES["nearest_tile"](spark, str(tmp_path)).collect()} == {k: i for k, (d, i) in near.items() if d <= 400**2}


def test_cells_are_never_broadcast(spark):
    """A large box is many rows that no estimate knows of: the join must not gather them on the driver."""
    tiles = boxes(spark, [(1000 * i, 0, 1000, 1000) for i in range(3)])
    met = spatial.range_join(tiles, tiles, 0.0)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    pairs = lambda df: sorted((r.a_id, r.b_id) for r in df.collect())
    assert pairs(met) == pairs(spatial.range_join(tiles, tiles, 0.0, 1000.0)) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
