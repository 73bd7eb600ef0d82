"""Geometry as nested arrays, read from WKT and tested with higher-order functions.

A polygon column is ``array<polygon>`` of ``array<ring>`` of ``array<point>`` of ``[x, y]``; an edge
list is ``array<struct<ax, ay, bx, by>>``. Everything is a JVM expression; no row reaches Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYGONS = "array<array<array<array<double>>>>"

# Fixed patterns: a signed decimal number with an optional exponent, and the mark of further ordinates.
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
ORDINATES = r"(?:ZM|Z|M)?"


def wkt_point(text: Column) -> Column:
    """``POINT (x y)`` as an array of its two numbers' texts; an empty text for anything else.

    Callers keep the array as a column and cast its items: items of a parsed struct would be parsed
    again wherever they are used.
    """
    pattern = rf"(?i)^\s*POINT\s*\(\s*({NUMBER}\s+{NUMBER})\s*\)\s*$"
    return F.split(F.regexp_extract(text, pattern, 1), r"\s+")


def wkt_polygons(text: Column) -> Column:
    """``POLYGON`` or ``MULTIPOLYGON`` text as nested arrays of x and y; anything else is NULL."""
    body = F.regexp_replace(text, rf"(?i)^\s*(MULTI)?POLYGON\s*{ORDINATES}\s*(?=\()", "")
    # Numbers as JSON writes them: no plus sign, digits on both sides of the point.
    body = F.regexp_replace(body, r"(?<=[\s(,])\+", "")
    body = F.regexp_replace(body, r"(?<![0-9])\.(?=[0-9])", "0.")
    body = F.regexp_replace(body, r"(?<=[0-9])\.(?![0-9])", ".0")
    pairs = F.regexp_replace(body, rf"({NUMBER})\s+({NUMBER})(?:\s+{NUMBER}){{0,2}}", "[$1,$2]")
    nested = F.translate(pairs, "()", "[]")
    many = F.when(text.rlike(r"(?i)^\s*MULTIPOLYGON"), nested).when(
        text.rlike(r"(?i)^\s*POLYGON"), F.concat(F.lit("["), nested, F.lit("]"))
    )
    return F.from_json(many, POLYGONS)


def point_of(df: DataFrame, column: str) -> Column:
    """x and y of a point column: WKT text, or coordinates that were parsed before."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    return wkt_point(F.col(column))


def polygons_of(df: DataFrame, column: str) -> Column:
    """Nested arrays of a polygon column: WKT text, or arrays that were parsed before."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    return wkt_polygons(F.col(column))


def bounding_box(polygons: Column) -> Column:
    points = F.flatten(F.flatten(polygons))
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def box_centre(box: Column) -> Column:
    return F.struct(
        ((box["min_x"] + box["max_x"]) / 2).alias("x"),
        ((box["min_y"] + box["max_y"]) / 2).alias("y"),
    )


def ring_edges(polygons: Column) -> Column:
    """Every side of every ring, holes included."""

    def sides(ring: Column) -> Column:
        count = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(
            F.slice(ring, F.lit(1), count),
            F.slice(ring, F.lit(2), count),
            lambda a, b: F.struct(
                F.get(a, F.lit(0)).alias("ax"),
                F.get(a, F.lit(1)).alias("ay"),
                F.get(b, F.lit(0)).alias("bx"),
                F.get(b, F.lit(1)).alias("by"),
            ),
        )

    return F.flatten(F.transform(F.flatten(polygons), sides))


def part_starts(polygons: Column) -> Column:
    """The first outer vertex of each polygon."""
    return F.transform(
        polygons,
        lambda polygon: F.struct(
            F.get(F.get(F.get(polygon, F.lit(0)), F.lit(0)), F.lit(0)).alias("x"),
            F.get(F.get(F.get(polygon, F.lit(0)), F.lit(0)), F.lit(1)).alias("y"),
        ),
    )


def on_edge(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges,
        lambda e: (
            x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
            & ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"]))
        ),
    )


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with a ray to the right; says nothing about points on an edge."""
    crossed = F.filter(
        edges,
        lambda e: (
            ((e["ay"] > y) != (e["by"] > y))
            & (
                x
                < e["ax"]
                + (e["bx"] - e["ax"])
                * F.try_divide(y - e["ay"], e["by"] - e["ay"])
            )
        ),
    )
    return F.size(crossed) % 2 == 1


def passes_height(e: Column, y: Column) -> Column:
    """Whether a side passes from at most this height to above it."""
    return (e["ay"] > y) != (e["by"] > y)


def _turns(e: Column, x: Column, y: Column) -> Column:
    return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])


def is_right_of(e: Column, x: Column, y: Column) -> Column:
    """Whether a side that passes the height lies to the right of the place; on the side is not."""
    both = (e["ax"] > x) & (e["bx"] > x)
    either = (e["ax"] > x) | (e["bx"] > x)
    turns = _turns(e, x, y)
    return both | (either & F.when(e["by"] > e["ay"], turns > 0).otherwise(turns < 0))


def _is_above(e: Column, x: Column, y: Column) -> Column:
    """Whether a side that passes the x lies above the place.

    Where the side passes the height too, the answer follows from ``is_right_of``, so that rounding
    cannot make the two disagree: a rising side is above what it is not to the right of.
    """
    both = (e["ay"] > y) & (e["by"] > y)
    either = (e["ay"] > y) | (e["by"] > y)
    rising = (e["bx"] > e["ax"]) == (e["by"] > e["ay"])
    return both | (either & (is_right_of(e, x, y) != rising))


def passes_oddly(edges: Column, x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    """Whether an odd number of sides lies between two places, first up or down and then across.

    Places exactly on a side count as just beyond it, to the right and above, at both ends alike.
    """
    up = F.filter(
        edges,
        lambda e: ((e["ax"] > x) != (e["bx"] > x)) & (_is_above(e, x, y) != _is_above(e, x, to_y)),
    )
    across = F.filter(
        edges,
        lambda e: passes_height(e, to_y) & (is_right_of(e, x, to_y) != is_right_of(e, to_x, to_y)),
    )
    return (F.size(up) + F.size(across)) % 2 == 1


def boxes_overlap(a: Column, b: Column) -> Column:
    return (
        (a["min_x"] <= b["max_x"])
        & (b["min_x"] <= a["max_x"])
        & (a["min_y"] <= b["max_y"])
        & (b["min_y"] <= a["max_y"])
    )


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """On which side of the line a-b the point p lies: -1, 0 or 1."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def _segments_meet(e: Column, f: Column) -> Column:
    return (
        (F.least(e["ax"], e["bx"]) <= F.greatest(f["ax"], f["bx"]))
        & (F.least(f["ax"], f["bx"]) <= F.greatest(e["ax"], e["bx"]))
        & (F.least(e["ay"], e["by"]) <= F.greatest(f["ay"], f["by"]))
        & (F.least(f["ay"], f["by"]) <= F.greatest(e["ay"], e["by"]))
        & (
            _side(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
            * _side(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
            <= 0
        )
        & (
            _side(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
            * _side(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
            <= 0
        )
    )


def sides_meet(edges_a: Column, edges_b: Column) -> Column:
    """True when any side of the one shares a point with any side of the other, touching included."""
    return F.exists(edges_a, lambda e: F.exists(edges_b, lambda f: _segments_meet(e, f)))
