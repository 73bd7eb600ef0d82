"""WKT, point-in-zone and area-meets-zone against plain Python geometry."""

import random

import pytest
from pyspark.sql import functions as F

from tripweave.functions import geometry as geo
from tripweave.operators import zone_match
from tripweave.operators.zone_match import match_areas, match_points
from tripweave.plans.zones import with_both_zones, zone_dimension

HOLED = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1)), ((6 0, 7 0, 7 1, 6 0)))"


def wkt(points):
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in points) + "))"


def closed(points):
    return [*points, points[0]]


def star(rng, cx, cy, radius, corners):
    import math

    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return closed([
        (cx + radius * rng.uniform(0.4, 1) * math.cos(a), cy + radius * rng.uniform(0.4, 1) * math.sin(a))
        for a in angles
    ])


def contains(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            odd = not odd
    return odd


def cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def sides_cross(a, b, c, d):
    return cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0


def meet(first, second):
    return (
        contains(second, *first[0])
        or contains(first, *second[0])
        or any(
            sides_cross(a, b, c, d)
            for a, b in zip(first, first[1:])
            for c, d in zip(second, second[1:])
        )
    )


def test_wkt(spark):
    texts = [HOLED, "POLYGON((0 0,1 0,1 1.5e0,0 0))", "  multipolygon  (((-1 -2.5, 3 4, 5 6, -1 -2.5)))",
             "LINESTRING (0 0, 1 1)", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = [r[0] for r in df.select(geo.wkt_polygons(F.col("t"))).collect()]
    assert [len(rings) for rings in parsed[0]] == [2, 1]
    assert parsed[0][0][1][2] == [3.0, 3.0]
    assert parsed[1] == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.5], [0.0, 0.0]]]]
    assert parsed[2][0][0][0] == [-1.0, -2.5]
    assert parsed[3] is None and parsed[4] is None
    texts = ["POINT (-73.9 40.7)", "point(1 2)", "  Point\t( 1e-3 \n  -2.5 )  ", "x", "POINT Z (1 2 3)",
             "POINT (1 2 3)", "MULTIPOINT (1 2)", "POINT EMPTY", "POINT (a b)", "POINT (1)"]
    points = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in points.select(geo.wkt_point(F.col("t"))).collect()]
    assert found[:3] == [["-73.9", "40.7"], ["1", "2"], ["1e-3", "-2.5"]]
    assert all(pair == [""] for pair in found[3:])


def test_holes_and_borders(spark):
    cases = {(0.5, 0.5): True, (2.0, 2.0): False, (6.9, 0.5): True, (5.0, 0.5): False,
             (0.0, 2.0): False, (4.0, 2.0): False, (2.0, 0.0): False, (2.0, 1.0): False,
             (0.0, 0.0): False, (3.5, 3.5): True}
    zones = spark.createDataFrame([(1, "z", "b", HOLED)],
                                  "LocationID long, zone string, borough string, the_geom string")
    points = spark.createDataFrame([(x, y, f"POINT ({x} {y})") for x, y in cases],
                                   "x double, y double, the_geom string")
    got = {(r.x, r.y): r.LocationID is not None for r in match_points(points, zones).collect()}
    assert got == cases


@pytest.fixture(scope="module")
def layout():
    rng = random.Random(11)
    return [
        (i, star(rng, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.3, 3), rng.randint(5, 12)))
        for i in range(30)
    ]


def zone_table(spark, layout):
    rows = [(i, f"zone {i}", "b", wkt(ring)) for i, ring in layout]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "LocationID long, zone string, borough string, the_geom string")


@pytest.mark.parametrize(("cell", "limit"), [(0.05, None), (0.4, None), (1.0, None), (50.0, None), (1.0, 0)])
def test_points_get_the_first_zone_in_order(spark, layout, cell, limit):
    rng = random.Random(7)
    points = [(i, rng.uniform(-8, 8), rng.uniform(-8, 8)) for i in range(400)]
    # A third of all points at one place, and one without coordinates.
    points += [(1000 + i, *points[0][1:]) for i in range(200)]
    table = spark.createDataFrame(
        [(i, f"POINT ({x!r} {y!r})") for i, x, y in points] + [(-1, None)], "id long, the_geom string"
    )
    found = match_points(table, zone_table(spark, layout), cell=cell, broadcast_bytes=limit).collect()
    got = {r.id: r.LocationID for r in found}
    assert len(found) == len(points) + 1 and got.pop(-1) is None
    for i, x, y in points:
        assert got[i] == next((z for z, ring in layout if contains(ring, x, y)), None)
    assert any(v is None for v in got.values()) and len(set(got.values())) > 5


@pytest.mark.parametrize(("cell", "limit"), [(0.05, None), (0.5, None), (0.5, 0)])
def test_areas_get_the_first_zone_they_meet(spark, layout, cell, limit):
    rng = random.Random(9)
    areas = [
        (i, star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), 10 ** rng.uniform(-2, 1.3), 6))
        for i in range(150)
    ]
    table = spark.createDataFrame([(i, wkt(ring)) for i, ring in areas], "id long, the_geom string")
    found = match_areas(table, zone_table(spark, layout), cell=cell, broadcast_bytes=limit).collect()
    assert len(found) == len(areas)
    got = {r.id: r.LocationID for r in found}
    for i, ring in areas:
        assert got[i] == next((z for z, zone in layout if meet(ring, zone)), None), i


def test_areas_that_touch_cross_or_hold_a_zone(spark):
    zones = spark.createDataFrame([(1, "z", "b", wkt(closed([(0, 0), (1, 0), (1, 1), (0, 1)])))],
                                  "LocationID long, zone string, borough string, the_geom string")
    cases = {
        "plus": (closed([(-1, 0.4), (2, 0.4), (2, 0.6), (-1, 0.6)]), True),
        "around": (closed([(-5, -5), (5, -5), (5, 5), (-5, 5)]), True),
        "within": (closed([(0.4, 0.4), (0.6, 0.4), (0.5, 0.6)]), True),
        "corner": (closed([(1, 1), (2, 1), (2, 2)]), True),
        "edge": (closed([(1, 0.2), (2, 0.2), (2, 0.8), (1, 0.8)]), True),
        "apart": (closed([(1.001, 0), (2, 0), (2, 1)]), False),
    }
    table = spark.createDataFrame([(k, wkt(ring)) for k, (ring, _) in cases.items()],
                                  "id string, the_geom string")
    got = {r.id: r.LocationID == 1 for r in match_areas(table, zones, cell=0.3).collect()}
    assert got == {k: expected for k, (_, expected) in cases.items()}


def test_repeated_zone_ids_do_not_multiply_trips(spark):
    zones = spark.createDataFrame(
        [(56, "a", "Q", wkt(closed([(0, 0), (1, 0), (1, 1)]))),
         (56, "a", "Q", wkt(closed([(3, 3), (4, 3), (4, 5)]))),
         (7, "c", "B", wkt(closed([(0, 0), (2, 0), (2, 2)])))],
        "LocationID long, zone string, borough string, the_geom string")
    dim = zone_dimension(zones)
    assert {(r.LocationID, r.longitude, r.latitude) for r in dim.collect()} == {(56, 2.0, 2.5), (7, 1.0, 1.0)}
    trips = spark.createDataFrame([(56, 7), (56, 56)], "PULocationID long, DOLocationID long")
    assert with_both_zones(trips, dim, "borough").count() == 2


@pytest.mark.parametrize("unit", [1.0, 0.0001, 250_000.0])
def test_cells_are_measured_in_any_map_unit(spark, unit):
    def square(x, y, side):
        c = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
        return "POLYGON ((" + ", ".join(f"{a * unit} {b * unit}" for a, b in c) + "))"

    zones = spark.createDataFrame(
        [(i, f"z{i}", "b", square(i % 4, i // 4, 1)) for i in range(16)],
        "LocationID long, zone string, borough string, the_geom string",
    )
    points = spark.createDataFrame(
        [(i, f"POINT ({(i % 4 + 0.3) * unit} {(i // 4 + 0.6) * unit})") for i in range(16)],
        "n long, the_geom string",
    )
    assert all(r.n == r.LocationID for r in zone_match.match_points(points, zones).collect())
    lots = spark.createDataFrame(
        [(i, square(i % 4 + 0.4, i // 4 + 0.4, 0.001)) for i in range(16)], "n long, the_geom string"
    )
    assert all(r.n == r.LocationID for r in zone_match.match_areas(lots, zones).collect())
    index = zone_match.ZoneIndex(zones)
    assert index.cells([0], zone_match.PADDING).count() < 16 * 200


@pytest.fixture(scope="module")
def ragged(spark):
    """One zone of 4,000 sides with a hole of 400, one of two parts, one tiny, one far away and huge."""
    rng = random.Random(23)
    outer = star(rng, 0, 0, 50, 4000)
    hole = star(rng, 0, 0, 15, 400)
    rings = [outer, hole]
    zones = [
        (1, "MULTIPOLYGON ((" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + "))"),
        (2, "MULTIPOLYGON (((60 0, 70 0, 70 10, 60 0)), ((60 20, 70 20, 70 30, 60 20)))"),
        (3, wkt(closed([(20.0, 20.0), (20.01, 20.0), (20.0, 20.01)]))),
        (4, wkt(closed([(1000, 1000), (1400, 1000), (1400, 1500), (1000, 1500)]))),
    ]
    rows = [(i, f"z{i}", "b", text) for i, text in zones]
    return spark.createDataFrame(rows, "LocationID long, zone string, borough string, the_geom string")


@pytest.mark.parametrize("padding", [zone_match.ROUNDING, zone_match.PADDING])
def test_cells_keep_only_their_own_sides(ragged, padding):
    levels = [0, 2, 5]
    index = zone_match.ZoneIndex(ragged)
    found = index.cells(levels, padding).collect()
    assert {r.level for r in found} == set(levels)
    sides = {r.names.order: r.sides for r in index.shaped.collect()}
    stored, crossed = 0, 0
    for row in found:
        size = index.cell * 2**row.level
        left, low = row.corner
        far = size * (1 + 2 * padding)
        stored += len(row.sides)
        # No cell has a side that passes it by: of a side clipped to the cell something is left.
        for e in row.sides:
            assert min(e.ax, e.bx) <= left + far and max(e.ax, e.bx) >= left
            assert min(e.ay, e.by) <= low + far and max(e.ay, e.by) >= low
            crossed += _clipped(e, left, low, far)
    total = sum(map(len, sides.values()))
    # A side that crosses more than one cell costs one entry for each, in each size class.
    assert stored <= len(levels) * total + crossed and crossed >= 0.98 * stored
    # Whole cells have no sides at all, and many of the large zone's cells are whole.
    assert sum(r.corner_inside and not r.sides for r in found) > 10


def _clipped(e, left, low, far):
    """Whether a side crosses a square."""
    t0, t1 = 0.0, 1.0
    for start, end, least, most in ((e.ax, e.bx, left, left + far), (e.ay, e.by, low, low + far)):
        run = end - start
        if run == 0:
            if not least <= start <= most:
                return False
            continue
        a, b = sorted(((least - start) / run, (most - start) / run))
        t0, t1 = max(t0, a), min(t1, b)
    return t0 <= t1


def test_corners_tell_inside_from_outside(ragged):
    index = zone_match.ZoneIndex(ragged)
    sides = {r.names.order: r.sides for r in index.shaped.collect()}
    for row in index.cells([0, 1], zone_match.PADDING).collect():
        x, y = row.corner
        odd = sum((e.ay > y) != (e.by > y) and x < e.ax + (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay)
                  for e in sides[row.names.order]) % 2 == 1
        assert row.corner_inside == odd


@pytest.mark.parametrize("cell", [None, 0.25, 1.0, 2.0])
def test_points_on_cell_borders_and_corners(spark, cell):
    """Zones whose sides lie on the borders of cells, and places on, beside and between them."""
    layout = [(n, closed([(n % 3, n // 3), (n % 3 + 1, n // 3), (n % 3 + 1, n // 3 + 1), (n % 3, n // 3 + 1)]))
              for n in range(9)]
    layout += [(9, closed([(0, 0), (3, 3), (0, 3)])), (10, closed([(4, 0), (5, 1), (4, 2), (3, 1)]))]
    steps = [k / 8 for k in range(-4, 45)]
    places = [(x, y) for x in steps for y in steps[:36]]
    points = spark.createDataFrame([(x, y, f"POINT ({x} {y})") for x, y in places], "x double, y double, the_geom string")
    zones = zone_table(spark, layout)
    got = {(r.x, r.y): r.LocationID for r in match_points(points, zones, cell=cell).collect()}

    def strictly(ring, x, y):
        on = any(cross(a, b, (x, y)) == 0 and min(a[0], b[0]) <= x <= max(a[0], b[0])
                 and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in zip(ring, ring[1:]))
        return not on and contains(ring, x, y)

    for x, y in places:
        assert got[x, y] == next((z for z, ring in layout if strictly(ring, x, y)), None), (x, y)


def test_only_size_classes_that_occur_are_laid_out(spark, ragged):
    index = zone_match.ZoneIndex(ragged)
    tiny, wide = index.cell / 10, index.cell * 900
    squares = [(1, 0.0, 30.0, tiny), (2, 1200.0, 1200.0, tiny), (3, -500.0, -500.0, wide), (4, 21.0, 21.0, tiny)]
    lots = spark.createDataFrame(
        [(n, wkt(closed([(x, y), (x + w, y), (x + w, y + w), (x, y + w)]))) for n, x, y, w in squares],
        "n long, the_geom string",
    )
    got = {r.n: r.LocationID for r in match_areas(lots, index).collect()}
    assert got == {1: 1, 2: 4, 3: 1, 4: 1}
    [(levels, _)] = index._grids
    assert levels == (0, 10)


def test_one_index_serves_many_matches(spark, ragged):
    index = zone_match.ZoneIndex(ragged)
    points = spark.createDataFrame([("POINT (0 17)",), ("POINT (1 18)",)], "the_geom string")
    assert [r.LocationID for r in match_points(points, index).collect()] == [1, 1]
    first = index.grid([0], zone_match.ROUNDING)
    match_points(points, index)
    assert index.grid([0], zone_match.ROUNDING) is first


def test_empty_tables_and_shapes(spark, ragged):
    none = spark.createDataFrame([], "n long, the_geom string")
    lots = spark.createDataFrame([(1, "POLYGON EMPTY"), (2, None), (3, "x"), (4, wkt([(0, 17)] * 4))], "n long, the_geom string")
    assert match_areas(none, ragged).count() == match_points(none, ragged).count() == 0
    assert {r.n: r.LocationID for r in match_areas(lots, ragged).collect()} == {1: None, 2: None, 3: None, 4: 1}
    no_zones = ragged.limit(0)
    assert [r.LocationID for r in match_areas(lots, no_zones).collect()] == [None] * 4
    assert match_points(lots, no_zones).where("LocationID IS NULL").count() == 4


@pytest.mark.parametrize("text", [
    "POLYGON ((0 0, 1. 0, 1 1, 0 1, 0 0))",
    "POLYGON ((0 0, +1 0, 1 1e0, 0 1, 0 0))",
    "POLYGON Z ((0 0 5, 1 0 5, 1 1 5, 0 1 5, 0 0 5))",
    "MULTIPOLYGON ZM (((.0 .0 1 2, 1 0 1 2, 1 1 1 2, 0 1 1 2, .0 .0 1 2)))",
])
def test_spellings_of_numbers_and_further_ordinates(spark, text):
    zones = spark.createDataFrame([(1, "z", "b", text)], "LocationID long, zone string, borough string, the_geom string")
    for point in ("POINT (.5 .5)", "point(0.5 5e-1)"):
        points = spark.createDataFrame([(point,)], "the_geom string")
        assert match_points(points, zones).first().LocationID == 1
