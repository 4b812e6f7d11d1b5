"""Stops and trips of moving devices from noisy pings.

Pings are cut into spans at silences that are certain from coarse time buckets, so
the pings of one device spread over many tasks. Each span is read once in time
order: repeated pings and lone wild fixes go, silences split it into sessions, and
each session is simplified by time-synchronised Douglas-Peucker, in stretches of
bounded length, so that the time grows with the pings. Simplified segments of low
speed that stay within the radius are the stops: neighbouring ones join while the
points of the path lie within the radius of their common centre, and only the ends
of a stop are then moved, ping by ping, to the longest run within the radius of its
own centre. All other segments are retained movement. What lies between two stops of
a session is a trip, with the length of its simplified path.

A span is held in memory only up to CHUNK pings: beyond that it is closed at the last
step longer than the diameter of a stop, or else after the last stop that has ended,
and the open trip is carried on. Only what has neither stays whole, such as one stay of
more pings without a silence; it is judged anew only when its pings have doubled.

Defined results: pings without device or time are left out, as are void fixes; a
session with fewer than two pings, and a run shorter than the least duration, give
nothing; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Pings of a span that are held before it is closed in part.
CHUNK = 100_000
#: Pings of a stretch that is simplified in one go; its ends are points of the path.
STRETCH = 1_000


def _metres(lat1, lon1, lat2, lon2):
    half = (
        np.sin(np.radians(lat2 - lat1) / 2) ** 2
        + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, half)))


def _plane(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local metres; longitudes are taken the short way round from the first point."""
    turn = (lon - lon[0] + 180.0) % 360.0 - 180.0
    scale = np.radians(EARTH_M)
    return turn * scale * np.cos(np.radians(lat)), (lat - lat[0]) * scale


def simplify(t: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Indexes kept by Douglas-Peucker with the time-synchronised distance."""
    kept, todo = [0, len(t) - 1], [(0, len(t) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        share = (t[a + 1 : b] - t[a]) / max(t[b] - t[a], 1e-9)
        away = np.hypot(x[a + 1 : b] - x[a] - share * (x[b] - x[a]), y[a + 1 : b] - y[a] - share * (y[b] - y[a]))
        worst = int(away.argmax())
        if away[worst] > tolerance:
            middle = a + 1 + worst
            kept.append(middle)
            todo += [(a, middle), (middle, b)]
    return sorted(set(kept))


def simplified(t: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """The points of the path, stretch by stretch."""
    path = [0]
    for a in range(0, len(t) - 1, STRETCH):
        b = min(a + STRETCH, len(t) - 1) + 1
        path += [a + k for k in simplify(t[a:b], x[a:b], y[a:b], tolerance)[1:]]
    return path


def slow_groups(t, x, y, path: list[int], radius: float, slow_mps: float) -> list[tuple[int, int]]:
    """Neighbouring segments of low speed, joined while the path stays within the radius of their centre."""
    groups: list[tuple[int, int]] = []
    points: list[int] = []
    sum_x, sum_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    for a, b in zip(path, path[1:]):
        length = float(np.hypot(x[b] - x[a], y[b] - y[a]))
        if length > radius or length > slow_mps * max(t[b] - t[a], 1e-9):
            points = []
            continue
        if points:
            low = points[0]
            count = b + 1 - low
            centre = (sum_x[b + 1] - sum_x[low]) / count, (sum_y[b + 1] - sum_y[low]) / count
            joined = [*points, b]
            if np.hypot(x[joined] - centre[0], y[joined] - centre[1]).max() <= radius:
                points, groups[-1] = joined, (low, b)
                continue
        points = [a, b]
        groups.append((a, b))
    return groups


class Runs:
    """Runs of pings and their centres."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, radius: float):
        self.lat, self.lon, self.radius = lat, lon, radius
        self.sums = [np.concatenate([[0.0], np.cumsum(v - v[0])]) for v in (lat, lon)]

    def away(self, a: int, b: int, of: slice | int):
        """Distance of pings from the centre of the run a..b."""
        lat, lon = ((s[b + 1] - s[a]) / (b + 1 - a) for s in self.sums)
        return _metres(self.lat[of], self.lon[of], self.lat[0] + lat, self.lon[0] + lon)

    def fits(self, a: int, b: int) -> bool:
        return bool(self.away(a, b, slice(a, b + 1)).max() <= self.radius)

    def longest(self, a: int, b: int, floor: int) -> tuple[int, int]:
        """The longest run in a..b, not before ``floor``, with its ends moved on as far as they go.

        A run that does not lie within the radius of its centre is split at the ping that
        is furthest away. A ping joins at an end if it lies within the radius of the centre
        as it is, and the whole run still lies within the radius with it.
        """
        todo, best = [(a, b)], (a, a)
        while todo:
            a, b = todo.pop()
            distances = self.away(a, b, slice(a, b + 1))
            worst = int(distances.argmax())
            if distances[worst] <= self.radius:
                best = max(best, (a, b), key=lambda run: run[1] - run[0])
                continue
            todo += [(low, high) for low, high in ((a, a + worst - 1), (a + worst + 1, b)) if high - low > best[1] - best[0]]
        a, b = best
        grown = True
        while grown:
            grown = False
            if b + 1 < len(self.lat) and self.away(a, b, b + 1) <= self.radius and self.fits(a, b + 1):
                b, grown = b + 1, True
            if a > floor and self.away(a, b, a - 1) <= self.radius and self.fits(a - 1, b):
                a, grown = a - 1, True
        return a, b


def stops_of(t, lat, lon, radius: float, least_s: float, tolerance: float, slow_mps: float):
    """(first index, last index) of every stop, and the indexes of the simplified path."""
    x, y = _plane(lat, lon)
    lon = lon[0] + ((lon - lon[0] + 180.0) % 360.0 - 180.0)
    path = simplified(t, x, y, tolerance)
    runs = Runs(lat, lon, radius)
    stops: list[tuple[int, int]] = []
    for a, b in slow_groups(t, x, y, path, radius, slow_mps):
        floor = stops[-1][1] + 1 if stops else 0
        if b < floor:
            continue
        a, b = runs.longest(max(a, floor), b, floor)
        if t[b] - t[a] >= least_s:
            stops.append((a, b))
    return stops, path


def stops_and_trips(
    pings: DataFrame,
    radius_m: float = 150.0,
    least_s: float = 1200.0,
    silence_s: float = 4 * 3600.0,
    wild_kmh: float = 300.0,
    tolerance_m: float = 75.0,
    slow_mps: float = 0.5,
) -> DataFrame:
    """device_id, kind, start_s, end_s, duration_s, distance_m, pings.

    ``pings``: device_id, at (TIMESTAMP or seconds), lat, lon. See the module's text
    for the rules.
    """
    if min(radius_m, least_s, silence_s, wild_kmh, tolerance_m, slow_mps) <= 0:
        raise ValueError("all parameters must be positive")
    lat, lon = F.col("lat"), F.col("lon")
    valid = pings.where(
        F.col("device_id").isNotNull()
        & F.col("at").isNotNull()
        & lat.between(-90, 90)
        & lon.between(-180, 180)
        & ~((lat == 0) & (lon == 0))
    ).select("device_id", F.col("at").cast("timestamp").cast("double").alias("t"), "lat", "lon")

    # Two empty buckets in a row are a silence, whatever lies inside the others.
    width = silence_s / 2
    bucketed = valid.withColumn("bucket", F.floor(F.col("t") / width))
    edge = F.struct("t", "lat", "lon")
    used = bucketed.groupBy("device_id", "bucket").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
    in_order = Window.partitionBy("device_id").orderBy("bucket")
    spans = (
        used.withColumn("before", F.lag("bucket").over(in_order))
        .withColumn("prior", F.lag("last").over(in_order))
        .withColumn("next", F.lead("first").over(in_order))
        .withColumn("opens", F.coalesce(F.col("bucket") - F.col("before") > 2, F.lit(True)))
        .withColumn("span", F.sum(F.col("opens").cast("int")).over(in_order))
        .select(
            "device_id",
            "bucket",
            "span",
            *(F.when(F.col("opens"), F.col("prior")[c]).alias(f"prior_{c}") for c in ("t", "lat", "lon")),
            *(F.col("next")[c].alias(f"next_{c}") for c in ("t", "lat", "lon")),
        )
    )
    context = [f"{side}_{c}" for side in ("prior", "next") for c in ("t", "lat", "lon")]
    placed = (
        bucketed.join(spans, ["device_id", "bucket"])
        .select("device_id", "span", "t", "lat", "lon", *context)
        .repartition("device_id", "span")
        .sortWithinPartitions("device_id", "span", "t", "lat", "lon")
    )

    columns = ["device_id", "kind", "start_s", "end_s", "duration_s", "distance_m", "pings"]

    class Span:
        """The pings of one span that are not yet done with, and the trip under way."""

        def __init__(self, device, span):
            self.key = (device, span)
            self.parts: list[np.ndarray] = []
            self.size = 0
            self.wait = CHUNK
            self.prior: np.ndarray | None = None
            self.stop: tuple | None = None  # time of the last stop's end, metres and pings since, last point

        def add(self, block: np.ndarray) -> None:
            if self.prior is None and not self.size and not np.isnan(block[0, 3]):
                self.prior = block[0, 3:6]
            self.parts.append(block)
            self.size += len(block)

        def done(self, last: bool) -> list[tuple]:
            """Rows of the span so far; unless it is the last call, of its settled part only."""
            block = np.concatenate(self.parts)
            keep = np.ones(len(block), bool)
            keep[1:] = (np.diff(block[:, :3], axis=0) != 0).any(axis=1)
            block = block[keep]
            t, lat, lon = block[:, 0], block[:, 1], block[:, 2]
            head = [] if self.prior is None else [self.prior]
            tail = [] if not last or np.isnan(block[-1, 6]) else [block[-1, 6:9]]
            # The neighbours across the silence count when a fix is judged as wild.
            wide = np.vstack([*head, block[:, :3], *tail])
            speed = _metres(wide[:-1, 1], wide[:-1, 2], wide[1:, 1], wide[1:, 2]) * 3.6
            fast = speed > wild_kmh * np.maximum(np.diff(wide[:, 0]), 0)
            wild = np.zeros(len(wide), bool)
            wild[1:-1] = fast[:-1] & fast[1:]
            good = ~wild[len(head) : len(head) + len(t)]
            t, lat, lon, raw = t[good], lat[good], lon[good], np.flatnonzero(good)
            end = len(t)
            if not last:
                end = self.settled(t, lat, lon)
                if not end:
                    self.parts, self.size, self.wait = [block], len(block), 2 * len(block)
                    return []
            rows = self.sessions(t[:end], lat[:end], lon[:end])
            if last:
                self.parts, self.size = [], 0
            else:
                self.prior = np.array([t[end - 1], lat[end - 1], lon[end - 1]])
                rest = block[raw[end] :]
                self.parts, self.size, self.wait = [rest], len(rest), len(rest) + CHUNK
            return rows

        @staticmethod
        def settled(t, lat, lon) -> int:
            """How many pings no later ping can change: up to the last long step, which no stop
            can straddle, else up to the end of the last stop that another ping has ended."""
            far = np.flatnonzero(_metres(lat[:-3], lon[:-3], lat[1:-2], lon[1:-2]) > 2 * radius_m)
            if len(far):
                return int(far[-1]) + 1
            begun = int(np.append(np.flatnonzero(np.diff(t) > silence_s) + 1, 0).max())
            if len(t) - begun < 4:
                return begun
            stops, _ = stops_of(t[begun:], lat[begun:], lon[begun:], radius_m, least_s, tolerance_m, slow_mps)
            return max((begun + high + 1 for _, high in stops if begun + high < len(t) - 3), default=begun)

        def sessions(self, t, lat, lon) -> list[tuple]:
            device, rows = self.key[0], []
            cuts = np.flatnonzero(np.diff(t) > silence_s) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)]):
                st, sy, sx = t[a:b], lat[a:b], lon[a:b]
                if not len(st):
                    continue
                if self.stop is not None and st[0] - self.stop[3][0] > silence_s:
                    self.stop = None
                stops, path = stops_of(st, sy, sx, radius_m, least_s, tolerance_m, slow_mps) if len(st) > 1 else ([], [0])

                def along(first: int, last: int) -> float:
                    points = [first, *(k for k in path if first < k < last), last]
                    return float(_metres(sy[points[:-1]], sx[points[:-1]], sy[points[1:]], sx[points[1:]]).sum())

                begun = 0
                for low, high in stops:
                    if self.stop is not None:
                        left, metres, count, point = self.stop
                        link = 0.0 if point[0] == st[begun] else float(_metres(point[1], point[2], sy[begun], sx[begun]))
                        metres += link + along(begun, low)
                        count += low - begun + (point[0] != st[begun])
                        rows.append((device, "trip", left, st[low], st[low] - left, metres, count))
                    rows.append((device, "stop", st[low], st[high], st[high] - st[low], 0.0, high - low + 1))
                    self.stop = (st[high], 0.0, 1, (st[high], sy[high], sx[high]))
                    begun = high
                if self.stop is not None:
                    left, metres, count, point = self.stop
                    link = 0.0 if point[0] == st[begun] else float(_metres(point[1], point[2], sy[begun], sx[begun]))
                    ahead = len(st) - 1
                    self.stop = (
                        left,
                        metres + link + (along(begun, ahead) if ahead > begun else 0.0),
                        count + ahead - begun + (point[0] != st[begun]),
                        (st[ahead], sy[ahead], sx[ahead]),
                    )
            return rows

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Span | None = None
        for batch in batches:
            rows: list[tuple] = []
            if len(batch):
                changed = (batch["device_id"] != batch["device_id"].shift()) | (batch["span"] != batch["span"].shift())
                starts = [*np.flatnonzero(changed.to_numpy()), len(batch)]
                numbers = batch[["t", "lat", "lon", *context]].to_numpy("f8")
                for a, b in zip(starts, starts[1:]):
                    key = (batch["device_id"].iloc[a], batch["span"].iloc[a])
                    if held is None or held.key != key:
                        rows += held.done(True) if held is not None else []
                        held = Span(*key)
                    held.add(numbers[a:b])
                    if held.size >= held.wait:
                        rows += held.done(False)
            yield pd.DataFrame(rows, columns=columns)
        if held is not None and held.size:
            yield pd.DataFrame(held.done(True), columns=columns)

    schema = "device_id string, kind string, start_s double, end_s double, duration_s double, distance_m double, pings bigint"
    return placed.mapInPandas(read, schema)
