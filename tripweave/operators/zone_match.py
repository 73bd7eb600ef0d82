"""Which zone does a point or an area lie in? First zone in file order wins.

``ZoneIndex`` lays the zones out on a grid by their sides: a cell keeps, of every zone that reaches
into it, only the sides that cross the cell, and whether the cell's lower left corner lies in the
zone. From that corner to any place in the cell it takes one step up and one to the right; each of
the cell's own sides that is passed on the way turns inside into outside or back, so no test needs
the rest of an outline. A cell that no side crosses is wholly inside (kept without sides) or wholly
outside (not kept).

Points and areas have exactly one cell each, so a match is one equi-join in which the large side is
neither exploded nor grouped afterwards: candidates are tested within the row, and a row without a
match stays, with NULL zone columns. The grid is measured: if it is small, as zone tables are, the
join is a broadcast without any shuffle of the points; if not, it is shuffled on the cell, where
adaptive execution splits crowded cells.

Areas use one grid per size class, with cells twice as wide from class to class: an area goes to
the first class whose cells are at least as wide as itself and is filed under its centre's cell;
cells reach half a cell further on all sides, so that they hold the area. Only classes that occur
among the areas are laid out, and there is no largest class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.functions import geometry as geo
from tripweave.session import BROADCAST_BYTES, cut_and_measure

# Half a cell and a margin for rounding at cell borders.
PADDING = 0.51
# The same margin for points, which need no padding otherwise.
ROUNDING = 0.01
# Areas wider than this many doublings of a cell have no meaningful size and match nothing.
MOST_CLASSES = 64
# Generous sizes in a broadcast grid: a zone's names and box, and one side of its outline.
ZONE_BYTES, EDGE_BYTES = 512, 64


def _extent(box: Column) -> Column:
    return F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])


def _cell_of(value: Column, size: Column) -> Column:
    return F.floor(value / size)


def _size_class(extent: Column, cell: float) -> Column:
    """The first class whose cells are at least as wide; 0 for all that fit the smallest cells."""
    guess = F.greatest(F.ceil(F.log2(extent / cell)), F.lit(0)).cast("int")
    # The logarithm is rounded: an area just over a power of two goes one class up.
    level = F.when(F.lit(cell) * F.pow(F.lit(2.0), guess) < extent, guess + 1).otherwise(guess)
    # Without a width (a single place) the logarithm is null or infinitely low.
    return F.when(extent <= cell, F.lit(0)).when(level <= MOST_CLASSES, level)


class ZoneIndex:
    """Zones by the grid cells that their sides cross; made once, used for any number of matches.

    ``cell`` is the width of the smallest cells, in map units. By default it is measured: a share
    of the root mean square of the wider sides of the zones' boxes. Of squares, because cells are
    counted by area: the number of cells per zone is bounded on average, whatever the unit and
    however the sizes differ.
    """

    # Cells per typical zone, along one side.
    SHARE = 6

    def __init__(
        self,
        zones: DataFrame,
        keep: Sequence[str] = ("LocationID", "zone", "borough"),
        order: str = "LocationID",
        wkt: str = "the_geom",
        cell: float | None = None,
        broadcast_bytes: int | None = None,
    ):
        self.keep = tuple(keep)
        self.limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
        names = F.struct(F.col(order).alias("order"), *[F.col(name) for name in self.keep])
        shape = zones.select(names.alias("names"), geo.polygons_of(zones, wkt).alias("shape"))
        box = geo.bounding_box(F.col("shape"))
        shaped = shape.select(
            "names",
            box.alias("box"),
            geo.ring_edges(F.col("shape")).alias("sides"),
            geo.part_starts(F.col("shape")).alias("starts"),
        ).where("box.min_x IS NOT NULL")
        wide = _extent(F.col("box"))
        self.shaped, measured = cut_and_measure(shaped, extent=F.sqrt(F.avg(wide * wide)))
        self.cell = float(cell or (measured.get("extent") or 0.0) / self.SHARE or 1.0)
        self._grids: dict[tuple, DataFrame] = {}

    def cells(self, levels: Sequence[int], padding: float) -> DataFrame:
        """One row per zone and cell: the cell's own sides, the corner's parity, parts that start there."""
        leveled = self.shaped.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
        size = F.lit(self.cell) * F.pow(F.lit(2.0), F.col("level"))
        box = F.col("box")
        margin = F.col("margin")
        rows = leveled.withColumns({"size": size, "margin": size * padding}).withColumn(
            "cy",
            F.explode(
                F.sequence(
                    _cell_of(box["min_y"] - margin, F.col("size")),
                    _cell_of(box["max_y"] + margin, F.col("size")),
                )
            ),
        )
        low = F.col("cy") * F.col("size") - margin
        high = (F.col("cy") + 1) * F.col("size") + margin

        def at(side: Column, y: Column) -> Column:
            """Where the side is at a height, or at its nearest end."""
            run = F.try_divide(y - side["ay"], side["by"] - side["ay"])
            x = side["ax"] + (side["bx"] - side["ax"]) * run
            return F.least(
                F.greatest(x, F.least(side["ax"], side["bx"])), F.greatest(side["ax"], side["bx"])
            )

        def spanned(side: Column) -> Column:
            """The side and the columns of cells that it crosses in this row of cells."""
            flat = side["ay"] == side["by"]
            bottom, top = at(side, F.col("low")), at(side, F.col("high"))
            left = F.when(flat, F.least(side["ax"], side["bx"])).otherwise(F.least(bottom, top))
            right = F.when(flat, F.greatest(side["ax"], side["bx"])).otherwise(F.greatest(bottom, top))
            return F.struct(
                side.alias("side"),
                _cell_of(left - margin, F.col("size")).alias("first"),
                _cell_of(right + margin, F.col("size")).alias("last"),
            )

        rows = rows.withColumns({"low": low, "high": high}).withColumn(
            "sides",
            F.filter(
                F.col("sides"),
                lambda e: (F.greatest(e["ay"], e["by"]) >= F.col("low"))
                & (F.least(e["ay"], e["by"]) <= F.col("high")),
            ),
        )
        # The sides that pass the height of the corners decide on every corner of the row.
        rows = rows.withColumns(
            {
                "passing": F.filter(F.col("sides"), lambda e: geo.passes_height(e, F.col("low"))),
                "sides": F.transform(F.col("sides"), spanned),
            }
        )
        placed = rows.withColumn(
            "cx",
            F.explode(
                F.sequence(
                    _cell_of(box["min_x"] - margin, F.col("size")),
                    _cell_of(box["max_x"] + margin, F.col("size")),
                )
            ),
        ).withColumn("left", F.col("cx") * F.col("size") - margin)
        right_end = (F.col("cx") + 1) * F.col("size") + margin
        own = F.transform(
            F.filter(F.col("sides"), lambda e: F.col("cx").between(e["first"], e["last"])),
            lambda e: e["side"],
        )
        beyond = F.filter(F.col("passing"), lambda e: geo.is_right_of(e, F.col("left"), F.col("low")))
        starts = F.filter(
            F.col("starts"),
            lambda p: p["x"].between(F.col("left"), right_end) & p["y"].between(F.col("low"), F.col("high")),
        )
        return placed.select(
            "level",
            "cx",
            "cy",
            "names",
            "box",
            own.alias("sides"),
            (F.size(beyond) % 2 == 1).alias("corner_inside"),
            F.struct(F.col("left").alias("x"), F.col("low").alias("y")).alias("corner"),
            starts.alias("starts"),
        ).where("corner_inside OR size(sides) > 0")

    def grid(self, levels: Sequence[int], padding: float) -> DataFrame:
        """One row per cell with the zones that reach into it, in file order; hinted if it is small."""
        key = (tuple(levels), padding)
        if key not in self._grids:
            near = F.array_sort(
                F.collect_list(F.struct("names", "box", "sides", "corner_inside", "starts")),
                lambda a, b: F.when(a["names"]["order"] < b["names"]["order"], -1)
                .when(a["names"]["order"] > b["names"]["order"], 1)
                .otherwise(0),
            )
            gathered = self.cells(levels, padding).groupBy(
                F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy")
            )
            grid = gathered.agg(F.first("corner").alias("_corner"), near.alias("_near"))
            row_bytes = F.aggregate(
                F.col("_near"),
                F.lit(64).cast("long"),
                lambda total, zone: total + ZONE_BYTES + EDGE_BYTES * F.size(zone["sides"]),
            )
            grid, measured = cut_and_measure(grid, bytes=F.sum(row_bytes))
            small = (measured.get("bytes") or 0) <= self.limit
            self._grids[key] = F.broadcast(grid) if small else grid
        return self._grids[key]

    def first_match(self, rows: DataFrame, levels: Sequence[int], padding: float, test) -> DataFrame:
        """The first zone in the row's cell that passes the test."""
        joined = rows.join(self.grid(levels, padding), ["_level", "_cx", "_cy"], "left")
        match = F.get(F.filter(F.col("_near"), test), F.lit(0))["names"]
        own = [c for c in rows.columns if not c.startswith("_")]
        return joined.select(*own, match.alias("_match")).select(
            *own, *[F.col("_match")[name].alias(name) for name in self.keep]
        )


def _holds(zone: Column, x: Column, y: Column) -> Column:
    """Whether the zone holds a place of the cell, which may be on its outline."""
    corner = F.col("_corner")
    return zone["corner_inside"] != geo.passes_oddly(zone["sides"], corner["x"], corner["y"], x, y)


def match_points(
    points: DataFrame, zones: DataFrame | ZoneIndex, point_wkt: str = "the_geom", **options
) -> DataFrame:
    """Add the columns of the first zone that strictly contains each point.

    ``options`` are those of ``ZoneIndex``, for zones that have none yet.
    """
    index = zones if isinstance(zones, ZoneIndex) else ZoneIndex(zones, **options)
    placed = points.withColumn("_point", geo.point_of(points, point_wkt))
    placed = placed.withColumns(
        {name: F.get("_point", F.lit(i)).try_cast("double") for i, name in enumerate(("_x", "_y"))}
    )
    size = F.lit(index.cell)
    x, y = F.col("_x"), F.col("_y")
    filed = placed.withColumns(
        {"_level": F.lit(0), "_cx": _cell_of(x, size), "_cy": _cell_of(y, size)}
    )

    def contains(zone: Column) -> Column:
        own = zone["sides"]
        return F.when(F.size(own) == 0, F.lit(True)).otherwise(
            _holds(zone, x, y) & ~geo.on_edge(own, x, y)
        )

    return index.first_match(filed, [0], ROUNDING, contains)


def match_areas(
    areas: DataFrame, zones: DataFrame | ZoneIndex, area_wkt: str = "the_geom", **options
) -> DataFrame:
    """Add the columns of the first zone that shares at least a place with each area.

    The areas are parsed once and written; a first look at the copy says which size classes occur.
    """
    index = zones if isinstance(zones, ZoneIndex) else ZoneIndex(zones, **options)
    shaped = areas.withColumn("_shape", geo.polygons_of(areas, area_wkt)).select(
        *areas.columns,
        geo.bounding_box(F.col("_shape")).alias("_box"),
        geo.ring_edges(F.col("_shape")).alias("_edges"),
        geo.part_starts(F.col("_shape")).alias("_starts"),
    )
    leveled = shaped.withColumn("_level", _size_class(_extent(F.col("_box")), index.cell))
    leveled, found = cut_and_measure(leveled, levels=F.collect_set("_level"))
    levels = sorted(found.get("levels") or [0])
    centre = geo.box_centre(F.col("_box"))
    size = F.lit(index.cell) * F.pow(F.lit(2.0), F.col("_level"))
    filed = leveled.withColumns(
        {"_cx": _cell_of(centre["x"], size), "_cy": _cell_of(centre["y"], size)}
    )

    def meets(zone: Column) -> Column:
        own = zone["sides"]
        # Sides meet, or one holds a part of the other, which the part's first corner shows.
        return geo.boxes_overlap(F.col("_box"), zone["box"]) & (
            geo.sides_meet(F.col("_edges"), own)
            | F.exists(F.col("_starts"), lambda p: _holds(zone, p["x"], p["y"]))
            | F.exists(zone["starts"], lambda p: geo.inside(F.col("_edges"), p["x"], p["y"]))
        )

    return index.first_match(filed, levels, PADDING, meets)
