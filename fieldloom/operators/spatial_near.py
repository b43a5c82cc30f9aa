"""Locations near other locations, and locations in regions, on the sphere.

Locations become unit vectors; k-d cuts of a bounded sample split space into groups of work; each
location goes to its own group and, as a halo copy, to every group within the chord length; each
group answers its queries from a local k-d tree. Regions: polygon edges are swept by latitude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.crs.systems import EARTH_RADIUS, RotatedGeogCS
from fieldloom.functions.kdtree import KDTree, Splits
from fieldloom.plans.ordered import sorted_groups
from fieldloom.plans.scale import broadcast_if_small, checkpointed

#: Locations in the sample that the cuts are made from: at least so many, so many for each group, and never more than the last.
SAMPLE, PER_GROUP, SAMPLE_MOST = 60_000, 64, 2_000_000
#: Locations that one group should hold.
GROUP = 40_000
#: Locations of a block; a group of more than two blocks that can't be cut by space is cut into them.
GROUP_MOST = 200_000
#: Pairs that a task holds before it returns them.
PAIRS_AT_ONCE = 500_000
#: Distances of points from edges that are computed at once.
SWEEP_CELLS = 4_000_000


def usable_angle(lat: Column, lon: Column) -> Column:
    """Present, finite, |lat| <= 90 and |lon| <= 360."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return ok & (F.abs(lat) <= 90.0) & (F.abs(lon) <= 360.0)


def geographic(points: DataFrame, crs: DataFrame) -> DataFrame:
    """pt_id, lat, lon in degrees of all points that have a possible position.

    latitude and longitude count where both are present; otherwise the grid coordinates in the
    domain's system (rotated pole; plain latitude/longitude for a null system or an unlisted
    domain). Points without a possible position, or of a system without a formula, are left out,
    and so are points with a null pt_id. Equal rows count once; a pt_id with several positions has them all.
    """
    systems = broadcast_if_small(
        crs.select(
            "domain_id",
            F.coalesce(F.get_json_object("crs", "$.grid_mapping_name"), F.lit("latitude_longitude")).alias("__kind"),
            *[F.coalesce(F.get_json_object("crs", f"$.{k}").cast("double"), F.lit(d)).alias(a) for k, d, a in (
                ("grid_north_pole_latitude", 90.0, "__plat"), ("grid_north_pole_longitude", 0.0, "__plon"), ("north_pole_grid_longitude", 0.0, "__glon"))],
        ).dropDuplicates(["domain_id"])
    )
    rows = points.select("pt_id", "domain_id", "latitude", "longitude", "grid_latitude", "grid_longitude").where(F.col("pt_id").isNotNull())
    rows = rows.join(systems, "domain_id", "left")
    present = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    direct = present("latitude") & present("longitude")
    glat, glon = F.col("grid_latitude"), F.col("grid_longitude")
    # the inverse of the rotated pole, with the pole taken from columns
    sp, cp = F.sin(F.radians("__plat")), F.cos(F.radians("__plat"))
    s, r = F.radians(glon - F.col("__glon")), F.radians(glat)
    rlat = F.degrees(F.asin(F.least(F.greatest(F.sin(r) * sp + F.cos(r) * F.cos(s) * cp, F.lit(-1.0)), F.lit(1.0))))
    rlon = F.degrees(F.atan2(F.cos(r) * F.sin(s), F.cos(r) * F.cos(s) * sp - F.sin(r) * cp)) + F.col("__plon") + F.lit(180.0)
    rotated = F.col("__kind") == RotatedGeogCS.grid_mapping_name
    plain = F.col("__kind").isNull() | (F.col("__kind") == "latitude_longitude")
    by_grid = usable_angle(glat, glon)
    lat = F.when(direct, F.col("latitude")).when(by_grid & rotated, rlat).when(by_grid & plain, glat)
    lon = F.when(direct, F.col("longitude")).when(by_grid & rotated, F.pmod(rlon, F.lit(360.0))).when(by_grid & plain, glon)
    return rows.select("pt_id", lat.alias("lat"), lon.alias("lon")).where(usable_angle(F.col("lat"), F.col("lon")))


def unit_vectors(points: DataFrame) -> DataFrame:
    """Adds x, y, z of ``lat`` and ``lon`` in degrees."""
    la, lo = F.radians("lat"), F.radians("lon")
    return points.withColumns({"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)})


def chord(metres: float, radius: float = EARTH_RADIUS) -> float:
    """Straight distance on the unit sphere of a great-circle distance."""
    return 2.0 * math.sin(min(metres / radius, math.pi) / 2.0)


def near_locations(located: DataFrame, metres: float, sample: int = SAMPLE, group: int = GROUP, group_most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame]:
    """Pairs of different places within a distance, and who else is where.

    ``located`` has pt_id, lat, lon. Returns (pairs, others): pairs(place_a, place_b) with
    place_a < place_b, others(place, pt_id). A place is one position, named by its lowest pt_id, who
    is always there; ``others`` has a row for each further pt_id of a position. Copies of a position
    are never compared with each other.

    A task holds one group, about ``group`` places and their halo. A group of more than ``group_most``
    places that space can't cut is cut into blocks by the places' names, and each pair of blocks is a
    task that asks the one for the other, so its memory doesn't grow with the group. Pairs are
    returned as they are found.
    """
    at = located.select("pt_id", F.round("lat", 12).alias("lat"), F.pmod(F.round("lon", 12), F.lit(360.0)).alias("lon"))
    # the poles have one place whatever the longitude says
    at = checkpointed(at.withColumn("lon", F.when(F.abs("lat") == 90.0, F.lit(0.0)).otherwise(F.col("lon"))).distinct())
    positions = checkpointed(at.groupBy("lat", "lon").agg(F.min("pt_id").alias("place"), (F.min("pt_id") < F.max("pt_id")).alias("shared")))
    shared = positions.where("shared").select("lat", "lon", "place")
    others = at.join(shared, ["lat", "lon"]).where("pt_id <> place").select("place", "pt_id")
    places = unit_vectors(positions).select("place", "x", "y", "z")
    total = positions.count()
    leaves = math.ceil(total / group)
    wanted = min(SAMPLE_MOST, max(sample, PER_GROUP * leaves))
    share = min(1.0, wanted / total) if total else 1.0
    some = places.select("x", "y", "z").where(F.pmod(F.xxhash64("place"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).toPandas()
    radius = chord(metres) * (1 + 1e-12)
    splits = Splits(some[["x", "y", "z"]].to_numpy(), leaves, 4 * radius)
    scale = total / max(1, len(some))
    blocks = np.array([max(1, math.ceil(n * scale / group_most)) if n * scale > 2 * group_most else 1 for n in splits.leaf_size] or [1])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, leaf, home = splits.assign(b[["x", "y", "z"]].to_numpy(), radius)
            name, xyz = b["place"].to_numpy()[row], b[["x", "y", "z"]].to_numpy()[row]
            times = blocks[leaf]
            # who asks is in the row of its block, who may be found in the column
            again = np.repeat(np.arange(len(row)), times)
            k = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            own, many = name[again] % times[again], times[again] > 1
            parts = [(again[~many], k[~many], k[~many], home[again[~many]], np.ones((~many).sum(), bool))]
            if many.any():
                ask = many & home[again]
                parts += [(again[ask], own[ask], k[ask], np.ones(ask.sum(), bool), np.zeros(ask.sum(), bool)), (again[many], k[many], own[many], np.zeros(many.sum(), bool), np.ones(many.sum(), bool))]
            for at_, i, j, asks, found in parts:
                yield pd.DataFrame({"g": leaf[at_], "i": i, "j": j, "asks": asks, "found": found, "place": name[at_], **{c: xyz[at_, n] for n, c in enumerate("xyz")}})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sorted_groups(batches, ["g", "i", "j"]):
            xyz, name = pdf[["x", "y", "z"]].to_numpy(), pdf["place"].to_numpy()
            asks, found = np.flatnonzero(pdf["asks"]), np.flatnonzero(pdf["found"])
            held, n = [], 0
            for i, j in KDTree(xyz[asks]).pairs_with(KDTree(xyz[found]), radius):
                a, b = name[asks[i]], name[found[j]]
                keep = a < b
                held.append((a[keep], b[keep]))
                n += len(held[-1][0])
                if n >= PAIRS_AT_ONCE:
                    yield _pair_frame(held)
                    held, n = [], 0
            yield _pair_frame(held)

    grouped = places.mapInPandas(spread, "g long, i long, j long, asks boolean, found boolean, place long, x double, y double, z double")
    pairs = grouped.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(local, "place_a long, place_b long")
    return pairs, others


def _pair_frame(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate([x[k] for x in held] or [np.empty(0, np.int64)]) for k in (0, 1))
    return pd.DataFrame({"place_a": a, "place_b": b})


def near_pairs(points: DataFrame, crs: DataFrame, metres: float = 250.0) -> DataFrame:
    """pt_a, pt_b (pt_a < pt_b): different pt_id at most ``metres`` apart on the great circle.

    All pairs, also those at one position. See :func:`geographic` for points that have none.
    """
    pairs, others = near_locations(geographic(points, crs), metres)
    others = checkpointed(others)
    who = broadcast_if_small(others)
    pairs = checkpointed(pairs)

    def expanded(df: DataFrame, place: str, out: str) -> DataFrame:
        """A row for each pt_id at the place."""
        more = df.join(who, F.col(place) == F.col("place")).select(*df.columns, F.col("pt_id").alias(out))
        return df.withColumn(out, F.col(place)).unionByName(more)

    apart = expanded(expanded(pairs, "place_a", "p"), "place_b", "q").select("p", "q")
    first = others.select(F.col("place").alias("p"), F.col("pt_id").alias("q"))
    rest = others.select("place", F.col("pt_id").alias("p")).join(others.select("place", F.col("pt_id").alias("q")), "place").where("p < q").select("p", "q")
    both = apart.unionByName(first).unionByName(rest).where("p <> q")
    return both.select(F.least("p", "q").alias("pt_a"), F.greatest("p", "q").alias("pt_b")).distinct()


class Regions:
    """Polygons (closed rings of (lat, lon), even-odd over all rings of a name) as edges in latitude bands.

    Longitudes of a ring run on where it crosses the date line (170 to 190, or -190 to -170); points
    are on [-180, 180), so such a ring is swept a second time, moved by 360 degrees.
    """

    def __init__(self, rings: Sequence[tuple[str, Sequence[tuple[float, float]]]]) -> None:
        self.names = sorted({name for name, _ in rings})
        edges, pieces = [], {}
        for name in self.names:
            own = [list(ring) for n, ring in rings if n == name]
            lons = [lo for ring in own for _, lo in ring]
            for shift in [0.0] + [-360.0] * (max(lons, default=0.0) >= 180.0) + [360.0] * (min(lons, default=0.0) < -180.0):
                piece = pieces.setdefault((name, shift), len(pieces))
                for ring in own:
                    for (la0, lo0), (la1, lo1) in zip(ring, ring[1:] + ring[:1]):
                        if la0 != la1:  # edges along a parallel never cross the sweep
                            low, high = sorted(((la0, lo0 + shift), (la1, lo1 + shift)))
                            edges.append((low[0], high[0], low[1], (high[1] - low[1]) / (high[0] - low[0]), piece))
        edges.sort(key=lambda e: e[0])
        self.low, self.high, self.lon, self.slope = (np.array([e[i] for e in edges], dtype=float) for i in range(4))
        self.of = np.array([e[4] for e in edges], dtype=np.int64)
        self.region = np.array([self.names.index(name) for name, _ in pieces], dtype=np.int64)

    def sweep(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region index) of the points inside. A point on a lower or left edge is inside, on an upper or right one outside."""
        order = np.argsort(lat, kind="stable")
        rows, found, active, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.empty(0, dtype=np.int64), 0
        stops = np.unique(np.concatenate([self.low, self.high]))
        # between two stops the active edges stay the same
        first = np.searchsorted(lat[order], stops, side="left")
        for k in range(len(stops) - 1):
            entered = np.searchsorted(self.low, stops[k], side="right")
            active = np.concatenate([active[self.high[active] > stops[k]], np.arange(at, entered)])
            active, at = active[self.high[active] > stops[k]], entered
            if not len(active):
                continue
            step = max(1, SWEEP_CELLS // len(active))
            for a in range(first[k], first[k + 1], step):
                points = order[a:min(a + step, first[k + 1])]
                crossing = self.lon[active][None, :] + (lat[points][:, None] - self.low[active][None, :]) * self.slope[active][None, :]
                west = crossing <= lon[points][:, None]
                for piece in np.unique(self.of[active]):
                    odd = west[:, self.of[active] == piece].sum(axis=1) % 2 == 1
                    rows.append(points[odd]), found.append(np.full(int(odd.sum()), self.region[piece]))
        return np.concatenate(rows), np.concatenate(found)


def points_in_regions(located: DataFrame, rings: Sequence[tuple[str, Sequence[tuple[float, float]]]]) -> DataFrame:
    """pt_id, region of the points of ``located`` (pt_id, lat, lon) inside each region.

    Rings of one name are one region, inner ones its holes. Regions come from the caller; their edges
    go with the task. A point in several regions has a row for each; equal rows come once. No regions
    or no points give no rows.
    """
    regions = Regions(rings)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, region = regions.sweep(b["lat"].to_numpy(), b["lon"].to_numpy())
            yield pd.DataFrame({"pt_id": b["pt_id"].to_numpy()[row], "region": np.array(regions.names, dtype=object)[region] if len(row) else np.empty(0, object)})

    wrapped = located.select("pt_id", "lat", (F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0).alias("lon"))
    return wrapped.mapInPandas(inside, "pt_id long, region string").distinct()
