"""Points near other points or inside regions, by space-filling-curve cell ranges.

A point on the sphere becomes a cube cell of earth-centred coordinates, numbered by a Morton
(Z-order) code with 20 bits an axis. A disc is covered by aligned cubes, each a contiguous range
of codes; a point is in the cover if its code is in one of the ranges. Because the cubes are
aligned, range containment is equality of a code prefix, so the range join runs as an equi-join
on the prefix, with the range test kept in it, and the great-circle distance refines it exactly.
Cubes have no seam at the antimeridian and do not shrink at the poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.functions.skew import all_salts, hot_buckets, salt_of

EARTH_M = 6_371_000.0
AXIS_BITS = 20
LEAF_M = 2 * EARTH_M / ((1 << AXIS_BITS) - 4)


def has_position(lat: str | Column, lon: str | Column) -> Column:
    """True for coordinates on the earth that are not both 0; false for null and NaN."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def _xyz(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [F.lit(EARTH_M) * F.cos(la) * F.cos(lo), F.lit(EARTH_M) * F.cos(la) * F.sin(lo), F.lit(EARTH_M) * F.sin(la)]


_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(df: DataFrame, names: list[str]) -> DataFrame:
    """Moves bit i of 20-bit numbers to bit 3 i. Each step is a projection of its own, as it uses its input twice."""
    for shift, mask in _SPREAD:
        df = df.withColumns({n: F.col(n).bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("bigint")) for n in names})
    return df


def _leaf(m: Column) -> Column:
    return F.floor((m + F.lit(EARTH_M)) / F.lit(LEAF_M)).cast("bigint") + 1


def _interleaved(x: str, y: str, z: str) -> Column:
    return F.col(x).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def with_cell_code(df: DataFrame, lat: str, lon: str, name: str, drop: int = 0) -> DataFrame:
    """`df` with the Morton code of each point's cube: a leaf of about 12 m, or one of 2**drop leaves a side."""
    axes = ["_x", "_y", "_z"]
    df = df.withColumns(dict(zip(axes, _xyz(F.col(lat), F.col(lon))))).withColumns({a: F.shiftright(_leaf(F.col(a)), drop) for a in axes})
    return _spread(df, axes).withColumn(name, _interleaved(*axes)).drop(*axes)


def level_for(metres: float) -> int:
    """Bits an axis to drop so that a cube is at least twice `metres` wide."""
    return max(0, min(AXIS_BITS, math.ceil(math.log2(max(2 * metres / LEAF_M, 1)))))


def with_disc_ranges(df: DataFrame, lat: str, lon: str, metres: float) -> DataFrame:
    """A row (_cell, _lo, _hi) for each of at most 8 cubes that hold every point within `metres`: a range of leaf codes."""
    drop, ends = level_for(metres), [f"_{a}{k}" for a in "xyz" for k in (0, 1)]
    df = df.withColumns(dict(zip(["_x", "_y", "_z"], _xyz(F.col(lat), F.col(lon)))))
    df = df.withColumns({e: F.shiftright(_leaf(F.col(e[:2]) + F.lit(metres if e[2] == "1" else -metres)), drop) for e in ends})
    df = _spread(df, ends)
    corners = F.array_distinct(F.array(*[_interleaved(f"_x{k & 1}", f"_y{k >> 1 & 1}", f"_z{k >> 2 & 1}") for k in range(8)]))
    df = df.withColumn("_cell", F.explode(corners)).drop("_x", "_y", "_z", *ends)
    return df.withColumns({"_lo": F.shiftleft("_cell", 3 * drop), "_hi": F.shiftleft(F.col("_cell") + 1, 3 * drop) - 1})


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def points_within(left: DataFrame, right: DataFrame, metres: float, *, left_id: str, right_id: str, lat: str = "latitude", lon: str = "longitude", ordered: bool = False) -> DataFrame:
    """(left_id, right_id, metres) of every left and right point at most `metres` apart.

    Rows without a position (null, out of range, both 0) or with a null id match nothing; repeated
    (id, position) rows count once; an empty side gives no rows. Other columns are not looked at.
    `ordered` keeps pairs with the left id below the right one, for a self-join without mirror
    images. Hot cells are salted: the left side is split, the right side repeated for them alone.
    """
    pick = lambda df, i, p: df.where(has_position(lat, lon) & F.col(i).isNotNull()).select(F.col(i).alias(f"{p}id"), F.col(lat).alias(f"{p}lat"), F.col(lon).alias(f"{p}lon")).distinct()
    drop = level_for(metres)
    a, b = pick(left, left_id, "a_"), pick(right, right_id, "b_")
    a = with_disc_ranges(a, "a_lat", "a_lon", metres)
    b = with_cell_code(b, "b_lat", "b_lon", "_code").withColumn("_cell", F.shiftright("_code", 3 * drop))
    hot = hot_buckets(with_cell_code(right.where(has_position(lat, lon)).select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")), "_lat", "_lon", "_cell", drop).select("_cell"), "_cell")
    a = a.withColumn("_salt", salt_of(hot, ["_cell"], ["a_id"]))
    b = b.withColumn("_salt", F.explode(all_salts(hot, ["_cell"])))
    near = (F.col("_code") >= F.col("_lo")) & (F.col("_code") <= F.col("_hi"))
    if ordered:
        near &= F.col("a_id") < F.col("b_id")
    d = great_circle_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    out = a.join(b, ["_cell", "_salt"]).where(near).select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), d.alias("metres")).where(F.col("metres") <= metres)
    return out.groupBy("left_id", "right_id").agg(F.min("metres").alias("metres"))


def regions_of_points(points: DataFrame, regions: DataFrame, *, point_id: str, region_id: str, lat: str = "latitude", lon: str = "longitude", ring: str = "ring", max_cells: int = 64) -> DataFrame:
    """(point_id, region_id) of every point inside a region.

    `ring` is an array of structs of `lat` and `lon`, the corners of a simple polygon in plate carrée that
    does not cross the antimeridian; fewer than 3 corners or a null ring contain nothing. A region's
    bounding box is covered by Z-order cells of 2-D coordinates, at the finest level of at most
    `max_cells` cells; points are joined at each level that any region uses, then tested by ray
    casting (a point on the lower or left edge counts as inside).
    """
    bits = 30
    grid = lambda v, low, span: F.least(F.lit((1 << bits) - 1), F.floor((v - low) / span * (1 << bits))).cast("bigint")
    r = regions.where(F.col(region_id).isNotNull() & (F.size(ring) >= 3)).select(F.col(region_id).alias("region_id"), F.col(ring).alias("_ring"))
    la, lo = F.transform("_ring", lambda p: p["lat"]), F.transform("_ring", lambda p: p["lon"])
    r = r.select("*", grid(F.array_min(la), -90, 180).alias("y0"), grid(F.array_max(la), -90, 180).alias("y1"), grid(F.array_min(lo), -180, 360).alias("x0"), grid(F.array_max(lo), -180, 360).alias("x1"))
    wide = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) + 1
    side = max(1, math.isqrt(max_cells) - 1)
    r = r.withColumn("_drop", F.greatest(F.lit(0), F.ceil(F.log2(wide / F.lit(float(side))))).cast("int"))
    cells = lambda a, b: F.sequence(F.call_function("shiftright", F.col(a), F.col("_drop")), F.call_function("shiftright", F.col(b), F.col("_drop")))
    r = r.withColumn("_y", F.explode(cells("y0", "y1"))).withColumn("_x", F.explode(cells("x0", "x1")))
    r = _z_order(r, "_x", "_y").select("region_id", "_ring", "_drop", "_cell")
    levels = [x["_drop"] for x in r.select("_drop").distinct().collect()]  # at most 31
    p = points.where(has_position(lat, lon) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("point_id"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).distinct()
    p = p.withColumns({"_x": grid(F.col("_lon"), -180, 360), "_y": grid(F.col("_lat"), -90, 180)})
    p = p.withColumn("_drop", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    p = _z_order(p.withColumns({a: F.call_function("shiftright", F.col(a), F.col("_drop")) for a in ("_x", "_y")}), "_x", "_y")
    inside = F.aggregate(
        F.sequence(F.lit(0), F.size("_ring") - 1), F.lit(False),
        lambda acc, i: acc != _crosses(F.get("_ring", i), F.get("_ring", F.pmod(i + 1, F.size("_ring")))),
    )
    return p.join(r, ["_drop", "_cell"]).where(inside).select("point_id", "region_id").distinct()


def _crosses(a: Column, b: Column) -> Column:
    """True if a ray from the point towards greater longitude crosses the edge."""
    y, x = F.col("_lat"), F.col("_lon")
    at = (b["lon"] - a["lon"]) * F.coalesce(F.try_divide(y - a["lat"], b["lat"] - a["lat"]), F.lit(0.0)) + a["lon"]
    return ((a["lat"] > y) != (b["lat"] > y)) & (x < at)


def _z_order(df: DataFrame, x: str, y: str) -> DataFrame:
    """`df` with `_cell`, the interleaved bits of two 32-bit numbers, instead of them."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        df = df.withColumns({n: F.col(n).bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("bigint")) for n in (x, y)})
    return df.withColumn("_cell", F.col(x).bitwiseOR(F.shiftleft(y, 1))).drop(x, y)
