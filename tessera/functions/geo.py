"""Geospatial predicates over longitude and latitude columns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch

EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0
CELL = 0.01


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Meters on the sphere; null where a coordinate is."""
    lon1, lat1, lon2, lat2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lon1, lat1, lon2, lat2))
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.when(a.isNotNull(), F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def degrees_to_meters(d: Column) -> Column:
    return d * DEGREE_M


def meters_to_degrees(m: Column) -> Column:
    return m / DEGREE_M


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def box_center(west: float, south: float, east: float, north: float) -> tuple[float, float]:
    return (west + east) / 2, (south + north) / 2


def boxes_intersect(a: tuple, b: tuple) -> bool:
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting; a ring of under three points holds nothing."""
    if len(ring) < 3:
        return F.lit(False)
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [ring[-1], *ring[:-1]]):
        if y1 == y2:
            continue
        cross = ((F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)) & (lon < (lat - float(y1)) * float(x2 - x1) / float(y2 - y1) + float(x1))
        inside = inside + cross.cast("int")
    return inside % 2 == 1


def near_box(lon: float, lat: float, max_m: float) -> tuple[float, float, float, float]:
    """(west, south, east, north) that holds every point within ``max_m`` meters; west and east may go beyond 180, and are -inf and inf where a pole is in reach."""
    reach = math.degrees(max_m / EARTH_M) + 1e-9
    south, north = lat - reach, lat + reach
    if south <= -90 or north >= 90:
        return -math.inf, south, math.inf, north
    # the widest longitude of a circle on the sphere
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) + 1e-9
    return lon - wide, south, lon + wide, north


def _in_reach(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Points of a box that may cross the antimeridian; plain ranges, which Parquet statistics can prune."""
    west, south, east, north = box
    out = lat.between(south, north)
    if math.isinf(west) or east - west >= 360:
        return out
    ranges = [lon.between(west, east)]
    if west < -180:
        ranges.append(lon >= west + 360)
    if east > 180:
        ranges.append(lon <= east - 360)
    return out & reduce(lambda a, b: a | b, ranges)


def near(df: DataFrame, lon: float, lat: float, max_m: float, min_m: float = 0.0, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """Rows within [min_m, max_m] meters with ``distance``, nearest first.

    The box around the circle, which Parquet statistics can prune, goes before the exact distance.
    """
    box = near_box(lon, lat, max_m)
    d = df.where(_in_reach(F.col(lon_col), F.col(lat_col), box)).withColumn("distance", haversine(F.col(lon_col), F.col(lat_col), lon, lat))
    return d.where((F.col("distance") <= max_m) & (F.col("distance") >= min_m)).orderBy("distance")


def within_box(df: DataFrame, west: float, south: float, east: float, north: float, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """Rows in the box with their distance from its center."""
    c = haversine(F.col(lon_col), F.col(lat_col), *box_center(west, south, east, north))
    return df.where(in_box(F.col(lon_col), F.col(lat_col), west, south, east, north)).withColumn("distance", c)


def within_polygon(df: DataFrame, ring: list[tuple[float, float]], lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    if len(ring) >= 3:
        xs, ys = zip(*ring)
        df = df.where(in_box(F.col(lon_col), F.col(lat_col), min(xs), min(ys), max(xs), max(ys)))
    return df.where(in_polygon(F.col(lon_col), F.col(lat_col), ring)).withColumn("distance", F.lit(0.0))


def cells(lon: Column, lat: Column, size: float = CELL) -> tuple[Column, Column]:
    """Grid cell numbers, to partition a table by."""
    return F.floor(lon / size).cast("int"), F.floor(lat / size).cast("int")


#: Degrees of a tile, by which a grid index folders its cells.
TILE = 10


class GridIndex:
    """Points on disk in folders of 10-degree tiles, sorted by grid cell: a query reads the tiles of its box, and in them the cells' row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.meta = spark, path, scratch.load(spark, f"{path}/meta.json")

    @classmethod
    def build(cls, df: DataFrame, path: str, size: float = CELL, lon_col: str = "lon", lat_col: str = "lat") -> GridIndex:
        x, y = cells(F.col(lon_col), F.col(lat_col), size)
        rows = df.where(F.col(lon_col).isNotNull() & F.col(lat_col).isNotNull()).withColumns({"cell_x": x, "cell_y": y, "tile": _tile(F.col(lon_col), F.col(lat_col))})
        rows.repartition("tile", F.pmod(F.xxhash64("cell_x", "cell_y"), F.lit(16))).sortWithinPartitions("tile", "cell_y", "cell_x").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/points")
        scratch.save(df.sparkSession, f"{path}/meta.json", {"size": size, "lon": lon_col, "lat": lat_col, "schema": df.schema.json()})
        return cls(df.sparkSession, path)

    def points(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.meta["schema"])).add("cell_x", T.IntegerType()).add("cell_y", T.IntegerType()).add("tile", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/points")

    def _pruned(self, box: tuple[float, float, float, float]) -> DataFrame:
        west, south, east, north = box
        ys = range(max(0, int((south + 90) // TILE)), min(180 // TILE, int((north + 90) // TILE)) + 1)
        wide = math.isinf(west) or east - west >= 360
        xs = range(360 // TILE + 1) if wide else {int(x % 360 // TILE) for x in [west + 180, east + 180, *(west + 180 + TILE * i for i in range(int((east - west) // TILE) + 1))]} | ({360 // TILE} if east >= 180 or west <= -180 else set())
        return self.points().where(F.col("tile").isin([x * 100 + y for x in xs for y in ys])).drop("cell_x", "cell_y", "tile")

    def near(self, lon: float, lat: float, max_m: float, min_m: float = 0.0) -> DataFrame:
        return near(self._pruned(near_box(lon, lat, max_m)), lon, lat, max_m, min_m, self.meta["lon"], self.meta["lat"])

    def within_box(self, west: float, south: float, east: float, north: float) -> DataFrame:
        return within_box(self._pruned((west, south, east, north)), west, south, east, north, self.meta["lon"], self.meta["lat"])

    def within_polygon(self, ring: list[tuple[float, float]]) -> DataFrame:
        if len(ring) < 3:
            return within_polygon(self._pruned((0.0, 0.0, 0.0, 0.0)), ring, self.meta["lon"], self.meta["lat"])
        xs, ys = zip(*ring)
        return within_polygon(self._pruned((min(xs), min(ys), max(xs), max(ys))), ring, self.meta["lon"], self.meta["lat"])


def _tile(lon: Column, lat: Column) -> Column:
    return (F.floor((lon + 180) / TILE) * 100 + F.floor((lat + 90) / TILE)).cast("int")


@dataclass(frozen=True)
class Point:
    lon: float
    lat: float

    def bounds(self) -> tuple[float, float, float, float]:
        return self.lon, self.lat, self.lon, self.lat

    def holds(self, lon: Column, lat: Column) -> Column:
        return (lon == self.lon) & (lat == self.lat)


@dataclass(frozen=True)
class LineString:
    points: tuple[tuple[float, float], ...]

    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.points)
        return min(xs), min(ys), max(xs), max(ys)

    def holds(self, lon: Column, lat: Column) -> Column:
        """Points on a segment, as far as doubles tell."""
        out = F.lit(False)
        for (x1, y1), (x2, y2) in zip(self.points, self.points[1:]):
            across = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
            out = out | ((F.abs(across) < 1e-12) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
        return out


@dataclass(frozen=True)
class Polygon:
    """A ring of points and holes in it."""

    ring: tuple[tuple[float, float], ...]
    holes: tuple[tuple[tuple[float, float], ...], ...] = ()

    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.ring)
        return min(xs), min(ys), max(xs), max(ys)

    def holds(self, lon: Column, lat: Column) -> Column:
        out = in_polygon(lon, lat, list(self.ring))
        for hole in self.holes:
            out = out & ~in_polygon(lon, lat, list(hole))
        return out


@dataclass(frozen=True)
class Circle:
    lon: float
    lat: float
    radius_m: float

    def bounds(self) -> tuple[float, float, float, float]:
        return near_box(self.lon, self.lat, self.radius_m)

    def holds(self, lon: Column, lat: Column) -> Column:
        return haversine(lon, lat, self.lon, self.lat) <= self.radius_m


def within(df: DataFrame, shape: Point | LineString | Polygon | Circle, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """Rows in a shape, its bounds before the exact test."""
    lon, lat = F.col(lon_col), F.col(lat_col)
    return df.where(_in_reach(lon, lat, shape.bounds())).where(shape.holds(lon, lat))
