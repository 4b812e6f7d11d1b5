"""Points near other points, and regions around points, by space-filling-curve cells.

Near points: every point gets the Morton code of its cube in a 3-D grid over the
sphere, so poles and the date line need no special case. A disc is covered by the
codes of the at most eight cubes that it can touch; an equi-join on the codes gives
the candidates and the great-circle distance decides.

Regions: every ring is covered by quadtree cells of longitude and latitude, each
one a range of Morton codes. Ranges are cut at the borders of coarse cells, so the
range join is an equi-join on the coarse cell with a comparison of the sorted
codes. Cells wholly inside a ring need no further test, the others get the exact
ray test. Rings that run past 180 degrees are covered where they lie, and a point
is looked up at its longitude and at 360 degrees to either side.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .skew import blocked_join

EARTH_M = 6_371_000.0
#: Most covering ranges, and most ring corners in them, that are sent to every executor;
#: more are joined by shuffle.
RANGES_BROADCAST = 200_000
CORNERS_BROADCAST = 2_000_000


def is_fix(lat: Column, lon: Column, null_island: float = 0.001) -> Column:
    """True for a usable position: both values, in range, not at (0, 0)."""
    return (
        lat.isNotNull()
        & lon.isNotNull()
        & ~F.isnan(lat)
        & ~F.isnan(lon)
        & lat.between(-90, 90)
        & lon.between(-180, 180)
        & ~((F.abs(lat) <= null_island) & (F.abs(lon) <= null_island))
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of 6 371 km."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def _spread(value: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    for shift, mask in steps:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


#: Shifts and masks that put two zero bits after each of 21 bits, or one after each of 31.
_THREE = (
    (32, 0x1F00000000FFFF),
    (16, 0x1F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)
_TWO = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def morton3(x: Column, y: Column, z: Column) -> Column:
    """Morton code of three numbers of up to 21 bits."""
    return (
        _spread(x, _THREE)
        .bitwiseOR(F.shiftleft(_spread(y, _THREE), 1))
        .bitwiseOR(F.shiftleft(_spread(z, _THREE), 2))
    )


def morton2(x: Column, y: Column) -> Column:
    """Morton code of two numbers of up to 31 bits."""
    return _spread(x, _TWO).bitwiseOR(F.shiftleft(_spread(y, _TWO), 1))


def _axes(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return (
        F.cos(F.radians(lat)) * F.cos(F.radians(lon)) * EARTH_M + EARTH_M,
        F.cos(F.radians(lat)) * F.sin(F.radians(lon)) * EARTH_M + EARTH_M,
        F.sin(F.radians(lat)) * EARTH_M + EARTH_M,
    )


def near_sites(points: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Sites of equal coordinates, and the pairs of different sites within ``radius_m``.

    Returns (members: key, site) and (links: site_a, site_b with site_a < site_b).
    ``site`` is the smallest key at those coordinates. Points without a fix are left
    out; repeated rows count once.
    """
    if radius_m <= 0:
        raise ValueError("radius_m must be positive")
    scratch = Scratch(points.sparkSession, "near")
    fixes = points.select(F.col(key).alias("key"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).where(
        F.col("key").isNotNull() & is_fix(F.col("lat"), F.col("lon"))
    )
    fixes = scratch.keep(fixes.distinct(), "fixes")
    sites = scratch.keep(fixes.groupBy("lat", "lon").agg(F.min("key").alias("site")), "sites")
    members = scratch.keep(fixes.join(sites, ["lat", "lon"]).select("key", "site").distinct(), "members")
    side = max(8.0 * radius_m, 2 * EARTH_M / (2**21 - 2))
    x, y, z = _axes(F.col("lat"), F.col("lon"))
    placed = sites.select("site", "lat", "lon", (x / side).alias("x"), (y / side).alias("y"), (z / side).alias("z"))
    home = placed.select(
        morton3(*(F.floor(F.col(a)).cast("bigint") for a in "xyz")).alias("cell"),
        F.col("site").alias("site_b"),
        F.col("lat").alias("lat_b"),
        F.col("lon").alias("lon_b"),
    )
    reach = radius_m * (1 + 1e-9) / side + 1e-9
    probe = placed
    for a in "xyz":
        low = F.greatest(F.floor(F.col(a) - reach), F.lit(0)).cast("bigint")
        high = F.floor(F.col(a) + reach).cast("bigint")
        probe = probe.withColumn(f"c{a}", F.explode(F.sequence(low, high)))
    probe = probe.select(morton3(F.col("cx"), F.col("cy"), F.col("cz")).alias("cell"), "site", "lat", "lon")
    close = haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) <= radius_m
    links = (
        blocked_join(probe, home, ["cell"])
        .where((F.col("site") < F.col("site_b")) & close)
        .select(F.col("site").alias("site_a"), "site_b")
    )
    return members, links


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """key_a < key_b: all pairs of keys at most ``radius_m`` apart, sites expanded.

    A key with several different fixes is near another if any of its fixes is.
    """
    members, links = near_sites(points, key, lat, lon, radius_m)
    left = members.select(F.col("key").alias("one"), F.col("site").alias("site_a"))
    right = members.select(F.col("key").alias("other"), F.col("site").alias("site_b"))
    shared = members.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("site")
    same = shared.select(F.col("site").alias("site_a"), F.col("site").alias("site_b"))
    wide = blocked_join(links.unionByName(same), left, ["site_a"])
    pairs = blocked_join(wide, right, ["site_b"]).where(F.col("one") != F.col("other"))
    return pairs.select(
        F.least("one", "other").alias("key_a"), F.greatest("one", "other").alias("key_b")
    ).distinct()


# Longitudes from -540 to 540 degrees and latitudes are scaled to 24 bits.
_BITS = 24
_UNIT = 1080.0 / 2**_BITS
#: Bits of a coarse cell in the range join: 9 levels, cells of about 2 degrees.
_COARSE = 9


def _code_axes(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (
        F.floor((lon + 540.0) / _UNIT).cast("bigint"),
        F.floor((lat + 540.0) / _UNIT).cast("bigint"),
    )


def _inside(x: float, y: float, ring: list[tuple[float, float]]) -> bool:
    odd = False
    x1, y1 = ring[-1]
    for x2, y2 in ring:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
        x1, y1 = x2, y2
    return odd


def _edge_meets_box(a, b, box) -> bool:
    """True if the segment touches the box, by clipping it (Liang-Barsky)."""
    (x1, y1), (x2, y2) = a, b
    west, south, east, north = box
    enter, leave = 0.0, 1.0
    for delta, low, high in ((x2 - x1, west - x1, east - x1), (y2 - y1, south - y1, north - y1)):
        if delta == 0:
            if low > 0 or high < 0:
                return False
            continue
        first, second = low / delta, high / delta
        enter, leave = max(enter, min(first, second)), min(leave, max(first, second))
        if enter > leave:
            return False
    return True


def cover_ring(ring: list[tuple[float, float]], most_cells: int = 64) -> list[tuple[int, int, bool]]:
    """Morton ranges (low, high, whole) that cover a ring of (lon, lat).

    Cells are split, largest first, until ``most_cells`` would be passed; ``whole``
    says that the cell lies inside the ring. Every cell is at least as fine as a
    coarse cell of the join.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    edges = list(zip([ring[-1], *ring[:-1]], ring))

    def boxed(level: int, cx: int, cy: int):
        size = 1080.0 / 2**level
        return cx * size - 540, cy * size - 540, (cx + 1) * size - 540, (cy + 1) * size - 540

    def state(level: int, cx: int, cy: int, pad: float = 1e-9) -> int:
        west, south, east, north = boxed(level, cx, cy)
        box = (west - pad, south - pad, east + pad, north + pad)
        if any(_edge_meets_box(a, b, box) for a, b in edges):
            return 1
        return 2 if _inside((west + east) / 2, (south + north) / 2, ring) else 0

    size = 1080.0 / 2**_COARSE
    cells = [
        (_COARSE, cx, cy)
        for cx in range(max(0, math.floor((min(xs) + 540) / size)), min(2**_COARSE - 1, math.floor((max(xs) + 540) / size)) + 1)
        for cy in range(max(0, math.floor((min(ys) + 540) / size)), min(2**_COARSE - 1, math.floor((max(ys) + 540) / size)) + 1)
    ]
    border, whole = [], []
    for cell in cells:
        {1: border, 2: whole}.get(state(*cell), []).append(cell)
    while border and len(border) + len(whole) < most_cells and border[0][0] < _BITS:
        level, cx, cy = border.pop(0)
        for child in ((level + 1, 2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)):
            {1: border, 2: whole}.get(state(*child), []).append(child)
    out = []
    for cells, inside in ((border, False), (whole, True)):
        for level, cx, cy in cells:
            code = 0
            for bit in range(level):
                code |= ((cx >> bit) & 1) << (2 * bit) | ((cy >> bit) & 1) << (2 * bit + 1)
            span = 2 * (_BITS - level)
            out.append((code << span, ((code + 1) << span) - 1, inside))
    return sorted(out)


def cover_regions(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """region, low, high, whole, coarse, ring: the covering ranges of every region.

    Rings with fewer than three usable corners, or null, cover nothing.
    """

    def covered(batches):
        for batch in batches:
            rows = []
            for region, corners in zip(batch["region"], batch["ring"]):
                points = [(c["lon"], c["lat"]) for c in (corners if corners is not None else []) if c is not None]
                points = [p for p in points if None not in p and all(map(math.isfinite, p))]
                if len(set(points)) >= 3:
                    rows += [
                        (region, low, high, whole, [p[0] for p in points], [p[1] for p in points])
                        for low, high, whole in cover_ring(points)
                    ]
            yield pd.DataFrame(rows, columns=["region", "low", "high", "whole", "xs", "ys"])

    kind = regions.schema[key].dataType.simpleString()
    named = regions.select(F.col(key).alias("region"), F.col(ring).alias("ring")).distinct()
    ranges = named.mapInPandas(
        covered, f"region {kind}, low bigint, high bigint, whole boolean, xs array<double>, ys array<double>"
    )
    return ranges.withColumn("coarse", F.shiftright("low", 2 * (_BITS - _COARSE)))


def inside_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Ray test of (x, y) against a ring given as two arrays, edges straight in degrees."""
    last = F.size(xs) - 1

    def crosses(n: Column) -> Column:
        m = F.when(n == 0, last).otherwise(n - 1)
        x1, y1, x2, y2 = xs[m], ys[m], xs[n], ys[n]
        return F.when((y1 > y) != (y2 > y), (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).cast("int")).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda odd, n: odd.bitwiseXOR(crosses(n))) == 1


def points_in_regions(
    points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region_key: str, ring: str
) -> DataFrame:
    """key, region: every region whose ring contains the fix of a point.

    The covering is sent to every executor if it has at most RANGES_BROADCAST ranges,
    else both sides are shuffled by coarse cell, hot cells in blocks.
    """
    ranges = Scratch(points.sparkSession, "regions").keep(cover_regions(regions, region_key, ring), "ranges")
    size = ranges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.size("xs")), F.lit(0)).alias("corners"),
        F.min(F.array_min("xs")).alias("west"),
        F.max(F.array_max("xs")).alias("east"),
        F.min(F.array_min("ys")).alias("south"),
        F.max(F.array_max("ys")).alias("north"),
    ).first()
    fixes = points.select(F.col(key).alias("key"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).where(
        F.col("key").isNotNull() & is_fix(F.col("lat"), F.col("lon"))
    )
    turned = fixes.select("key", "lat", F.explode(F.array(F.col("lon"), F.col("lon") - 360, F.col("lon") + 360)).alias("lon"))
    # Outside the box of all rings nothing is coded; most turned points fall there.
    turned = turned.where(F.col("lon").between(size["west"], size["east"]) & F.col("lat").between(size["south"], size["north"]))
    cx, cy = _code_axes(F.col("lat"), F.col("lon"))
    coded = turned.withColumn("code", morton2(cx, cy)).withColumn(
        "coarse", F.shiftright("code", 2 * (_BITS - _COARSE))
    )
    if size["n"] <= RANGES_BROADCAST and size["corners"] <= CORNERS_BROADCAST:
        # Most of the globe lies in no region: the coarse cells in use are a bounded list.
        cells = sorted(row["coarse"] for row in ranges.select("coarse").distinct().collect())
        if len(cells) <= 2_000:
            coded = coded.where(F.col("coarse").isin(cells)) if cells else coded.limit(0)
        met = coded.join(F.broadcast(ranges), "coarse")
    else:
        met = blocked_join(coded, ranges, ["coarse"])
    held = (
        met.where(F.col("code").between(F.col("low"), F.col("high")))
        .where(F.col("whole") | inside_ring(F.col("lon"), F.col("lat"), F.col("xs"), F.col("ys")))
        .select("key", "region")
    )
    return held.distinct()
