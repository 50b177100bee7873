"""Noding and faces: grids, roads, holes, dangling ends."""

from __future__ import annotations

import numpy as np
import pytest

from tesselle.functions import linework, shapes

AREA = [[np.array([(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)], float)]]


def sizes(lines, area=AREA, least=100.0):
    found = linework.shatter(area, np.array(lines, float).reshape(-1, 4), least)
    return sorted(round(shapes.area([r]), 3) for r in found)


def test_grid():
    lines = [(x, -50, x, 1050) for x in range(100, 1000, 100)] + [(-50, y, 1050, y) for y in range(100, 1000, 100)]
    assert sizes(lines) == [10_000.0] * 100


def test_crossing_roads_and_dangling_ends():
    assert sizes([(0, 0, 1000, 1000), (0, 1000, 1000, 0)]) == [250_000.0] * 4
    assert sizes([(500, 0, 500, 1000), (200, 200, 300, 900), (500, 500, 700, 500)]) == [500_000.0] * 2


def test_a_lake_is_a_face_and_a_hole():
    lake = [(400, 400, 600, 400), (600, 400, 600, 600), (600, 600, 400, 600), (400, 600, 400, 400)]
    assert sizes(lake) == [40_000.0, 960_000.0]
    donut = [[AREA[0][0], np.array([(400, 400), (600, 400), (600, 600), (400, 600), (400, 400)], float)]]
    assert sizes([(0, 500, 1000, 500)], donut) == [480_000.0] * 2


def test_slivers_overlaps_and_nothing():
    assert sizes([(0, 0.05, 1000, 0.05)]) == [round(1_000_000 - 50, 3)]
    assert sizes([(500, 0, 500, 600), (500, 400, 500, 1000), (500, 0, 500, 1000)]) == [500_000.0] * 2
    assert sizes([]) == [1_000_000.0]


def test_random_roads_cover_the_area():
    rng = np.random.default_rng(11)
    lines = [(x, -10, x, 1010) for x in np.linspace(100, 900, 7)] + [(-10, y, 1010, y) for y in np.linspace(100, 900, 7)]
    lines += [tuple(v) for v in rng.uniform(0, 1000, (60, 4))]
    found = sizes(lines, least=0.0)
    assert sum(found) == pytest.approx(1_000_000.0, abs=1.0) and len(found) > 64


def test_areas_as_a_table(spark):
    ring = [tuple(p) for p in AREA[0][0]]
    areas = spark.createDataFrame([(1, bytearray(shapes.polygon_wkb([ring]))), (2, bytearray(shapes.polygon_wkb([ring])))], "area_id long, geom binary")
    lines = spark.createDataFrame([(1, 500.0, 0.0, 500.0, 1000.0)], "area_id long, x0 double, y0 double, x1 double, y1 double")
    got = linework.shatter_areas(areas, lines).withColumn("again", shapes.wkb_area("geom")).collect()
    assert sorted((r.area_id, r.tile_id, r.sqft, r.again) for r in got) == [(1, 0, 500_000.0, 500_000.0), (1, 1, 500_000.0, 500_000.0), (2, 0, 1_000_000.0, 1_000_000.0)]


def test_water_is_cut_out(spark):
    box = lambda x0, y0, x1, y1: bytearray(shapes.polygon_wkb([[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]))
    bounds = "geom binary, x0 double, y0 double, x1 double, y1 double"
    tiles = spark.createDataFrame([(i, box(i * 100, 0, i * 100 + 100, 100), i * 100.0, 0.0, i * 100 + 100.0, 100.0) for i in range(4)], "id long, " + bounds)
    water = spark.createDataFrame([(box(150, -10, 180, 110), 150.0, -10.0, 180.0, 110.0), (box(160, 20, 250, 40), 160.0, 20.0, 250.0, 40.0), (box(290, -5, 410, 105), 290.0, -5.0, 410.0, 105.0)], bounds)
    got = {}
    for r in linework.clip_out(tiles, water).collect():
        got.setdefault(r.tile_id, []).append(round(r.sqft, 3))
    assert {k: sorted(v) for k, v in got.items()} == {0: [10_000.0], 1: [400.0, 1200.0, 5000.0], 2: [8000.0]}
    assert sorted((r.tile_id, round(r.sqft, 3)) for r in linework.clip_out(tiles, water, 37.0).collect()) == sorted((k, x) for k, v in got.items() for x in v)


def test_rings_of_members():
    """Halves joined end to end, a hole inside, a hole that sticks out, and lines that don't close."""
    import numpy as np

    from tesselle.functions.shapes import area
    from tesselle.sources.features import areas_of

    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float)
    halves = [square[:3], square[2:][::-1]]
    hole = square * 0.2 + 4
    assert area(areas_of([square], [])) == area(areas_of(halves, [])) == 100
    assert area(areas_of(halves, [hole])) == 96
    assert np.isclose(area(areas_of(halves, [square * 0.2 + 9])), 99)
    assert np.isclose(area(areas_of([square, square + 20], [hole, hole + 20, hole * 0.1 + 1])), 2 * 96 - 0.04)
    assert areas_of([square[:4]], []) == [] and areas_of([], [hole]) == []
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], float)
    assert np.isclose(area(areas_of([bow], [])), 50)
