"""Cells, nearest-cell search, point in polygon, interior points, cell maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garoa.functions import numeric as N
from garoa.operators.sizing import broadcast_if_small, keep, spread

#: Cells a side of the smallest tiles, tiles a side of the next larger ones.
LEAF_CELLS = 8
FAN = 8
#: A level of tiles is broadcast up to so many arrays of at most 64 entries.
BROADCAST_LEAVES = 16_000
SNAP_SLACK_DEG = 1e-3
TILE_DEG = 1.0
BAND_DEG = 0.1


def grid_cells(grid: DataFrame) -> DataFrame:
    """One row per cell; a cell keeps its coordinates for all its days."""
    return grid.groupBy("iy", "ix").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def mesh_axes(lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """Two axes ``(iy, lat)`` and ``(ix, lon)`` as a full mesh of cells."""
    columns = lon_axis.agg(F.sort_array(F.collect_list(F.struct("ix", "lon")))).scalar()
    return lat_axis.select("iy", "lat", F.explode(columns).alias("c")).select(
        "iy", F.col("c.ix").alias("ix"), "lat", F.col("c.lon").alias("lon")
    )


def grid_fingerprint(cells: DataFrame) -> DataFrame:
    """Short hash of a grid's shape and rounded coordinates, in any row order.

    Each cell is hashed on its own and the hashes are combined with XOR, so no
    task ever holds the grid.
    """

    def micro(name: str) -> Column:
        return F.round(F.col(name).cast("double") * 100000).cast("bigint").cast("string")

    digest = F.md5(F.concat_ws(",", F.col("iy").cast("string"), F.col("ix").cast("string"),
                               micro("lat"), micro("lon")))
    parts = [
        F.bit_xor(F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint"))
        for start in (1, 16)
    ]
    shape = [F.max("iy") + 1, F.max("ix") + 1, F.count(F.lit(1)), *parts]
    text = F.concat_ws("x", *[s.cast("string") for s in shape])
    return cells.agg(F.substring(F.md5(text), 1, 16).alias("grid_id"))


# --- nearest cell -----------------------------------------------------------


def _tile(y: str, x: str, step: int) -> list[Column]:
    return [F.floor(F.col(y) / step).alias("ty"), F.floor(F.col(x) / step).alias("tx")]


def _extent(lat_lo: str, lat_hi: str, lon_lo: str, lon_hi: str) -> list[Column]:
    return [
        F.min(lat_lo).cast("double").alias("y0"),
        F.max(lat_hi).cast("double").alias("y1"),
        F.min(lon_lo).cast("double").alias("x0"),
        F.max(lon_hi).cast("double").alias("x1"),
    ]


def _least_distance(tile: Column, y: Column, x: Column) -> Column:
    dy = F.greatest(tile.y0 - y, y - tile.y1, F.lit(0.0))
    dx = F.greatest(tile.x0 - x, x - tile.x1, F.lit(0.0))
    return F.sqrt(dy * dy + dx * dx)


def _greatest_distance(tile: Column, y: Column, x: Column) -> Column:
    dy = F.greatest(F.abs(tile.y0 - y), F.abs(tile.y1 - y))
    dx = F.greatest(F.abs(tile.x0 - x), F.abs(tile.x1 - x))
    return F.sqrt(dy * dy + dx * dx)


_TARGET = ["lat", "lon", "py", "px", "bound"]


def _branch(targets: DataFrame, tiles: str) -> DataFrame:
    """Keep the tiles that may hold the nearest cell and tighten the bound."""
    y, x = F.col("py").cast("double"), F.col("px").cast("double")
    bound = F.aggregate(
        F.col(tiles), F.col("bound"), lambda acc, t: F.least(acc, _greatest_distance(t, y, x))
    )
    near = F.filter(
        F.col(tiles), lambda t: _least_distance(t, y, x) <= F.col("bound") + F.lit(SNAP_SLACK_DEG)
    )
    return (
        targets.withColumn("bound", bound)
        .select(*_TARGET, F.explode(near).alias("t"))
        .select(*_TARGET, F.col("t.ty").alias("ty"), F.col("t.tx").alias("tx"), _least_distance(F.col("t"), y, x).alias("least"))
    )


def _shared_bound(targets: DataFrame) -> DataFrame:
    """Let each point's best bound rule its tiles in all branches.

    A window holds the tiles of one point that its branches left, some dozens.
    """
    bound = F.min("bound").over(Window.partitionBy("lat", "lon"))
    return targets.withColumn("bound", bound).filter(F.col("least") <= F.col("bound") + F.lit(SNAP_SLACK_DEG))


def _levels(leaves: DataFrame) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Levels of larger tiles with their children, largest first, each with a bound of its rows, and the topmost tiles.

    A level has one row per tile and at most ``FAN`` * ``FAN`` children in it;
    levels are added until no more tiles than that are left.
    """
    [(low_y, high_y, low_x, high_x)] = leaves.agg(F.min("ty"), F.max("ty"), F.min("tx"), F.max("tx")).head(1)
    levels, tiles, side = [], leaves.drop("cells"), 1

    def count() -> int:
        if low_y is None:
            return 0
        return (high_y // side - low_y // side + 1) * (high_x // side - low_x // side + 1)

    while count() > FAN * FAN:
        side *= FAN
        level = tiles.groupBy(*_tile("ty", "tx", FAN)).agg(
            F.collect_list(F.struct("ty", "tx", "y0", "y1", "x0", "x1")).alias("children"),
            *_extent("y0", "y1", "x0", "x1"),
        )
        levels.insert(0, (level.select("ty", "tx", "children"), count()))
        tiles = level.drop("children")
    return levels, tiles


def snap_to_grid(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Nearest cell of every point; ties go to the smallest ``(iy, ix)``.

    Squared degrees on longitudes in [-180, 180), in the number type of the
    grid, at any distance. Cells are grouped into tiles of 8x8, those into tiles
    of 8x8 tiles and so on, until at most 64 are left; points then descend level
    by level, one equi-join each. A tile is dropped when its nearest corner is
    farther than another tile's farthest one, so at each level a point keeps
    some dozens of tiles instead of the grid. Every array has at most 64 entries, at
    any size of the grid. Points without a coordinate, and all points of a grid
    without cells, get null cells.
    """
    kind = N.column_type(cells, "lat")
    flat = cells.select(
        "iy", "ix", "lat", "lon", N.normalize_lon(F.col("lon"), kind).alias("lon_n")
    )
    leaves = keep(
        flat.groupBy(*_tile("iy", "ix", LEAF_CELLS)).agg(
            F.collect_list(F.struct("iy", "ix", "lat", "lon", "lon_n")).alias("cells"),
            *_extent("lat", "lat", "lon_n", "lon_n"),
        )
    )
    levels, topmost = _levels(leaves)
    top = topmost.agg(F.collect_list(F.struct("ty", "tx", "y0", "y1", "x0", "x1"))).scalar()

    targets = spread(points.select("lat", "lon").distinct()).select(
        "lat",
        "lon",
        F.col("lat").cast(kind).alias("py"),
        N.normalize_lon(F.col("lon").cast("double")).cast(kind).alias("px"),
        F.lit(float("inf")).alias("bound"),
        top.alias("children"),
    )
    near = _branch(targets, "children")
    for depth, (level, size) in enumerate(levels):
        inner = F.broadcast(level) if size <= BROADCAST_LEAVES else level
        near = _branch((_shared_bound(near) if depth else near).join(inner, ["ty", "tx"]), "children")
    if len(levels) > 1:
        near = _shared_bound(near)
    outer = leaves.select("ty", "tx", "cells")
    if leaves.count() <= BROADCAST_LEAVES:
        outer = F.broadcast(outer)

    def candidate(c: Column) -> Column:
        dy, dx = c.lat - F.col("py"), c.lon_n - F.col("px")
        return F.struct(
            (dy * dy + dx * dx).alias("d2"),
            c.iy.alias("iy"),
            c.ix.alias("ix"),
            c.lat.alias("lat_grid"),
            c.lon.alias("lon_grid"),
        )

    best = (
        near.join(outer, ["ty", "tx"])
        .select("lat", "lon", F.array_min(F.transform("cells", candidate)).alias("c"))
        .groupBy("lat", "lon")
        .agg(F.min("c").alias("c"))
        .select("lat", "lon", "c.iy", "c.ix", "c.lat_grid", "c.lon_grid")
    )
    return points.join(best, ["lat", "lon"], "left")


# --- point in polygon -------------------------------------------------------


def _steps(low: Column, high: Column, size: float) -> Column:
    return F.explode(
        F.sequence(F.floor(low / F.lit(size)).cast("bigint"), F.floor(high / F.lit(size)).cast("bigint"))
    )


def points_in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``(x, y, municipio_id)`` for every polygon whose interior holds a point.

    ``points`` has distinct ``x, y``. Tiles of the polygon boxes pick the
    candidates; a ray to the east is then tested only against the edges of the
    point's latitude band. Odd crossings of one part of one feature mean inside,
    which covers holes; any part or feature of a municipality may hold the point,
    also where they overlap. A point on an edge of a part is outside that part.
    """
    boxes = edges.groupBy("municipio_id").agg(
        F.least(F.min("x1"), F.min("x2")).alias("xa"),
        F.greatest(F.max("x1"), F.max("x2")).alias("xb"),
        F.least(F.min("y1"), F.min("y2")).alias("ya"),
        F.greatest(F.max("y1"), F.max("y2")).alias("yb"),
    )
    tiles = boxes.select("*", _steps(F.col("xa"), F.col("xb"), TILE_DEG).alias("tx")).select(
        "*", _steps(F.col("ya"), F.col("yb"), TILE_DEG).alias("ty")
    )
    placed = spread(points).select(
        "x",
        "y",
        F.floor(F.col("x") / F.lit(TILE_DEG)).cast("bigint").alias("tx"),
        F.floor(F.col("y") / F.lit(TILE_DEG)).cast("bigint").alias("ty"),
        F.floor(F.col("y") / F.lit(BAND_DEG)).cast("bigint").alias("band"),
    )
    inside_box = (
        (F.col("x") > F.col("xa"))
        & (F.col("x") < F.col("xb"))
        & (F.col("y") > F.col("ya"))
        & (F.col("y") < F.col("yb"))
    )
    candidates = (
        placed.join(broadcast_if_small(tiles), ["tx", "ty"]).filter(inside_box).select("x", "y", "band", "municipio_id")
    )
    part = [c for c in ("feature", "part") if c in edges.columns]
    banded = edges.select(
        "municipio_id",
        *part,
        "x1",
        "y1",
        "x2",
        "y2",
        _steps(F.least("y1", "y2"), F.greatest("y1", "y2"), BAND_DEG).alias("band"),
    )
    x, y = F.col("x"), F.col("y")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    straddles = (y1 > y) != (y2 > y)
    crosses = F.when(straddles, x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).otherwise(F.lit(False))
    on_edge = (
        ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    return (
        candidates.join(banded, ["municipio_id", "band"])
        .groupBy("x", "y", "municipio_id", *part)
        .agg(F.count_if(crosses).alias("n"), F.max(on_edge).alias("edge"))
        .filter((F.col("n") % 2 == 1) & ~F.col("edge"))
        .select("x", "y", "municipio_id")
        .distinct()
    )


def locate_points(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``municipio_id`` (smallest that holds the point) and ``encontrado``."""
    spots = points.select(F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    hits = (
        points_in_polygons(spots, edges)
        .groupBy("x", "y")
        .agg(F.min("municipio_id").alias("municipio_id"))
        .withColumnsRenamed({"x": "lon", "y": "lat"})
    )
    return points.join(hits, ["lat", "lon"], "left").withColumn(
        "encontrado", F.col("municipio_id").isNotNull()
    )


def locate_summary(located: DataFrame) -> DataFrame:
    """Totals of a location batch."""
    return located.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("encontrado")).alias("encontrados"),
        F.count_if(~F.col("encontrado")).alias("nao_encontrados"),
    )


def map_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Municipality of every cell centre that lies inside one; others are left out."""
    placed = cells.select(
        "iy",
        "ix",
        N.normalize_lon(F.col("lon"), N.column_type(cells, "lon")).cast("double").alias("x"),
        F.col("lat").cast("double").alias("y"),
    )
    hits = (
        points_in_polygons(placed.select("x", "y").distinct(), edges)
        .groupBy("x", "y")
        .agg(F.min("municipio_id").alias("municipio_id"))
    )
    return placed.join(hits, ["x", "y"]).select("iy", "ix", "municipio_id")


def enrich_with_municipality(
    results: DataFrame, cell_map: DataFrame, on: tuple[str, ...] = ("iy", "ix")
) -> DataFrame:
    """Fill ``municipio_id`` from the cell map; cells outside every polygon stay NULL."""
    ids = cell_map.select(*on, F.col("municipio_id").cast("bigint"))
    return results.drop("municipio_id").join(ids, list(on), "left")


# --- polygons ---------------------------------------------------------------


def ring_edges(rings: DataFrame) -> DataFrame:
    """``(municipio_id[, feature], part, ring, coords)`` rings as one row per edge.

    ``coords`` is an array of ``[x, y]``; an open ring is closed.
    """
    feature = ["feature"] if "feature" in rings.columns else []
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    closed = F.when(first == last, F.col("coords")).otherwise(F.concat("coords", F.array(first)))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("c") - 1),
        lambda k: F.struct(F.element_at("c", k).alias("a"), F.element_at("c", k + 1).alias("b")),
    )
    return (
        rings.filter(F.size("coords") >= 3)
        .select("municipio_id", *feature, "part", "ring", closed.alias("c"))
        .select("municipio_id", *feature, "part", "ring", F.posexplode(pairs).alias("k", "p"))
        .select(
            F.col("municipio_id").cast("bigint").alias("municipio_id"),
            *feature,
            F.col("part").cast("int").alias("part"),
            F.col("ring").cast("int").alias("ring"),
            "k",
            F.col("p.a")[0].cast("double").alias("x1"),
            F.col("p.a")[1].cast("double").alias("y1"),
            F.col("p.b")[0].cast("double").alias("x2"),
            F.col("p.b")[1].cast("double").alias("y2"),
        )
    )


def representative_point(edges: DataFrame) -> DataFrame:
    """A point strictly inside each polygon: ``(municipio_id, lat, lon)``.

    A horizontal line through the widest part, half way between two vertex
    latitudes next to its middle, is cut by the part's rings into intervals; the
    middle of the widest interior interval is taken.
    """
    if "feature" not in edges.columns:
        edges = edges.withColumn("feature", F.lit(""))
    part = ["municipio_id", "feature", "part"]
    parts = edges.groupBy(*part).agg(
        F.min(F.least("x1", "x2")).alias("xa"),
        F.max(F.greatest("x1", "x2")).alias("xb"),
        ((F.min(F.least("y1", "y2")) + F.max(F.greatest("y1", "y2"))) / 2).alias("ym"),
    )
    widest = parts.groupBy("municipio_id").agg(
        F.max(F.struct((F.col("xb") - F.col("xa")).alias("w"), (-F.col("part")).alias("p"), "feature", "ym")).alias("s")
    ).select("municipio_id", "s.feature", (-F.col("s.p")).alias("part"), "s.ym")
    own = edges.join(widest, part)
    ym, y1, y2 = F.col("ym"), F.col("y1"), F.col("y2")
    line = own.groupBy(*part).agg(
        (
            (F.max(F.when(y1 <= ym, y1)) + F.min(F.when(y1 > ym, y1))) / 2
        ).alias("y")
    )
    y = F.col("y")
    cuts = (
        edges.join(line, part)
        .filter((y1 > y) != (y2 > y))
        .select(
            "municipio_id",
            "y",
            ((F.col("x2") - F.col("x1")) * (y - y1) / (y2 - y1) + F.col("x1")).alias("x"),
        )
    )
    along = Window.partitionBy("municipio_id").orderBy("x")
    spans = cuts.select(
        "municipio_id",
        "y",
        "x",
        F.lead("x").over(along).alias("x_next"),
        F.row_number().over(along).alias("n"),
    ).filter((F.col("n") % 2 == 1) & F.col("x_next").isNotNull())
    best = spans.groupBy("municipio_id").agg(
        F.max(F.struct((F.col("x_next") - F.col("x")).alias("w"), (-F.col("x")).alias("nx"), "x_next", "y")).alias("s")
    )
    return best.select(
        "municipio_id",
        F.col("s.y").alias("lat"),
        ((F.col("s.x_next") - F.col("s.nx")) / 2).alias("lon"),
    )
