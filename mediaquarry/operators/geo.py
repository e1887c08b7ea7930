"""Reverse geocoding: containment in boundaries, nearest boundary, open sea; boundary look-ups by name.

A boundary: boundary_id, kind (COUNTRY, STATE, CITY), name, country_code, state_name, rings (array of rings of lon/lat
pairs), south, west, north, east.  Coordinates are rounded to four decimals and made distinct first, then meet only the
boundaries whose boxes share their grid cell; the exact geometry runs on what is left, vectorised.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("CITY", "STATE", "COUNTRY")
RANKS = {"VERY_LOW": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "VERY_HIGH": 4}
OF_KIND = {"CITY": "VERY_HIGH", "STATE": "HIGH", "COUNTRY": "MEDIUM"}
EARTH_KM, NEAREST_KM, CELL = 6371.0, 22.2, 1.0
RINGS = "array<array<array<double>>>"


def confidence_rank(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in RANKS.items() for x in p])[name]


def inside(lat: float, lon: float, rings: list) -> bool:
    """Ray casting over all rings: holes flip; points on an edge are outside."""
    hit = False
    for ring in rings:
        r = np.asarray([list(p) for p in ring], dtype=np.float64)
        x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        on = (np.abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < 1e-12) & (np.minimum(x1, x2) <= lon) & (lon <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= lat) & (lat <= np.maximum(y1, y2))
        if on.any():
            return False
        cross = (y1 > lat) != (y2 > lat)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = x1 + (lat - y1) / (y2 - y1) * (x2 - x1)
        hit ^= bool((cross & (lon < at)).sum() % 2)
    return hit


def area(rings: list) -> float:
    """Planar, the outer ring less the holes."""
    out = 0.0
    for k, ring in enumerate(rings):
        r = np.asarray([list(p) for p in ring], dtype=np.float64)
        a = abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())) / 2
        out += a if k == 0 else -a
    return out


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(h))


def distance_km(lat: float, lon: float, rings: list) -> float:
    """To the nearest point of the boundary (found in degrees, measured on the sphere); zero inside."""
    if inside(lat, lon, rings):
        return 0.0
    best, where = np.inf, (lat, lon)
    for ring in rings:
        r = np.asarray([list(p) for p in ring], dtype=np.float64)
        a, d = r[:-1], r[1:] - r[:-1]
        t = np.clip((((lon - a[:, 0]) * d[:, 0]) + ((lat - a[:, 1]) * d[:, 1])) / np.maximum((d**2).sum(1), 1e-300), 0, 1)
        q = a + t[:, None] * d
        gap = (q[:, 0] - lon) ** 2 + (q[:, 1] - lat) ** 2
        k = int(gap.argmin())
        if gap[k] < best:
            best, where = gap[k], (q[k, 1], q[k, 0])
    return float(haversine(lat, lon, *where))


@F.pandas_udf(T.BooleanType())
def contains(lat: pd.Series, lon: pd.Series, rings: pd.Series) -> pd.Series:
    return pd.Series([inside(a, o, r) for a, o, r in zip(lat, lon, rings)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def gap_km(lat: pd.Series, lon: pd.Series, rings: pd.Series) -> pd.Series:
    return pd.Series([distance_km(a, o, r) for a, o, r in zip(lat, lon, rings)], dtype=float)


@F.pandas_udf(T.DoubleType())
def ring_area(rings: pd.Series) -> pd.Series:
    return pd.Series([area(r) for r in rings], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def interior_point(rings: pd.Series) -> pd.DataFrame:
    """A point inside: the middle of the widest inner stretch of a scan line; else the centre of the box."""
    return pd.DataFrame([_interior(r) for r in rings], columns=["lat", "lon"])


def _interior(rings: list) -> tuple[float, float]:
    points = np.concatenate([np.asarray([list(p) for p in ring], dtype=np.float64) for ring in rings])
    low, high = points.min(0), points.max(0)
    for share in (0.5, 0.382, 0.618, 0.25, 0.75):
        lat = low[1] + share * (high[1] - low[1]) + 1e-9
        cuts = []
        for ring in rings:
            r = np.asarray([list(p) for p in ring], dtype=np.float64)
            x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
            k = (y1 > lat) != (y2 > lat)
            cuts += (x1[k] + (lat - y1[k]) / (y2[k] - y1[k]) * (x2[k] - x1[k])).tolist()
        cuts.sort()
        spans = [(b - a, (a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2])]
        if spans and max(spans)[0] > 0:
            return float(lat), float(max(spans)[1])
    return float((low[1] + high[1]) / 2), float((low[0] + high[0]) / 2)


def _cells(south: Column, west: Column, north: Column, east: Column) -> Column:
    """The grid cells of a box, as text keys."""
    rows = F.sequence(F.floor(south / CELL).cast("int"), F.floor(north / CELL).cast("int"))
    columns = F.sequence(F.floor(west / CELL).cast("int"), F.floor(east / CELL).cast("int"))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.concat_ws(":", r.cast("string"), c.cast("string")))))


def in_boxes(points: DataFrame, boundaries: DataFrame, margin_km: float = 0.0) -> DataFrame:
    """Points (lat, lon) with the boundaries whose boxes, widened by the margin, hold them.  A grid makes it an equi-join."""
    up = margin_km / 111.0
    side = F.lit(up) / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs("south"), F.abs("north")), F.lit(85.0)))), F.lit(0.05))
    wide = boundaries.select("*", (F.col("south") - up).alias("s"), (F.col("west") - side).alias("w"), (F.col("north") + up).alias("n"), (F.col("east") + side).alias("e"))
    spread = wide.withColumn("cell", F.explode(_cells(F.col("s"), F.col("w"), F.col("n"), F.col("e"))))
    own = F.concat_ws(":", F.floor(F.col("lat") / CELL).cast("int").cast("string"), F.floor(F.col("lon") / CELL).cast("int").cast("string"))
    joined = points.withColumn("cell", own).join(spread, "cell")
    return joined.filter(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))).drop("cell", "s", "w", "n", "e")


def containing(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(lat, lon, kind, boundary_id, name, country_code, state_name): per kind the smallest boundary around; ties: the lower id."""
    hits = in_boxes(points, boundaries).filter(contains("lat", "lon", "rings")).withColumn("size", ring_area("rings"))
    best = F.min_by(F.struct("boundary_id", "name", "country_code", "state_name"), F.struct("size", "boundary_id"))
    return hits.groupBy("lat", "lon", "kind").agg(best.alias("b")).select("lat", "lon", "kind", "b.*")


def nearest(points: DataFrame, boundaries: DataFrame, limit_km: float = NEAREST_KM) -> DataFrame:
    """Per kind the nearest boundary within the limit; ties: the higher id."""
    near = in_boxes(points, boundaries, limit_km).withColumn("km", gap_km("lat", "lon", "rings")).filter(F.col("km") <= limit_km)
    best = F.min_by(F.struct("boundary_id", "name", "country_code", "state_name", "km"), F.struct("km", -F.col("boundary_id")))
    return near.groupBy("lat", "lon", "kind").agg(best.alias("b")).select("lat", "lon", "kind", "b.*")


def geocode(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Points (lat, lon) resolved: city, state, country, kind, confidence, distance_km, open_sea.

    Containment first, from the municipality up; else the nearest municipality, then country; else open water.
    """
    keys = points.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))).select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).distinct()

    def wide(found: DataFrame, prefix: str, kinds: tuple[str, ...]) -> DataFrame:
        out = found.groupBy("lat", "lon").agg(*[F.first(F.when(F.col("kind") == k, F.struct(*[c for c in found.columns if c not in ("lat", "lon", "kind")])), ignorenulls=True).alias(f"{prefix}{k.lower()}") for k in kinds])
        return out

    inner = keys.join(wide(containing(keys, boundaries), "in_", KINDS), ["lat", "lon"], "left")
    lost = inner.filter("in_city IS NULL AND in_state IS NULL AND in_country IS NULL").select("lat", "lon")
    joined = inner.join(wide(nearest(lost, boundaries.filter("kind <> 'STATE'")), "at_", ("CITY", "COUNTRY")), ["lat", "lon"], "left")
    c = F.col
    contained = F.when(c("in_city").isNotNull(), "CITY").when(c("in_state").isNotNull(), "STATE").when(c("in_country").isNotNull(), "COUNTRY")
    close = F.when(c("at_city").isNotNull(), "CITY").when(c("at_country").isNotNull(), "COUNTRY")
    kind = F.coalesce(contained, close)
    level = F.create_map(*[F.lit(x) for p in OF_KIND.items() for x in p])
    return joined.select(
        "lat", "lon", F.coalesce("in_city.name", F.when(contained.isNull(), c("at_city.name"))).alias("city"),
        F.coalesce("in_state.name", "in_city.state_name", F.when(contained.isNull(), c("at_city.state_name"))).alias("state"),
        F.coalesce("in_city.country_code", "in_state.country_code", "in_country.country_code", "at_city.country_code", "at_country.country_code").alias("country"),
        kind.alias("kind"), F.when(contained.isNotNull(), level[contained]).when(close.isNotNull(), "LOW").otherwise("VERY_LOW").alias("confidence"),
        F.when(contained.isNull(), F.coalesce("at_city.km", "at_country.km")).alias("distance_km"), kind.isNull().alias("open_sea"),
    )


def by_names(rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``rows`` (country, state, city) with the id of the deepest boundary of these names, case ignored; ties: the lowest id."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    table = boundaries.groupBy("kind", low(F.col("country_code")).alias("k_country"), low(F.when(F.col("kind") == "CITY", F.col("state_name"))).alias("k_state"), low(F.when(F.col("kind") == "COUNTRY", F.lit("")).otherwise(F.col("name"))).alias("k_name")).agg(F.min("boundary_id").alias("found"))

    def level(kind: str, out: str) -> DataFrame:
        return table.filter(F.col("kind") == kind).select("k_country", "k_state", "k_name", F.col("found").alias(out))

    keyed = rows.withColumn("k_country", low(F.col("country")))
    for kind, out, state, name in (("CITY", "f_city", F.col("state"), F.col("city")), ("STATE", "f_state", F.lit(""), F.col("state")), ("COUNTRY", "f_country", F.lit(""), F.lit(""))):
        keyed = keyed.withColumn("k_state", low(state)).withColumn("k_name", low(name)).join(level(kind, out), ["k_country", "k_state", "k_name"], "left")
    return keyed.withColumn("boundary_id", F.coalesce("f_city", "f_state", "f_country")).drop("k_country", "k_state", "k_name", "f_city", "f_state", "f_country")


def grid_cache(points: DataFrame) -> DataFrame:
    """Distinct keys of valid coordinates."""
    from ..functions.names import coordinate_key

    return points.select(coordinate_key(F.col("lat"), F.col("lon")).alias("cache_key"), "lat", "lon").filter("cache_key IS NOT NULL").dropDuplicates(["cache_key"])
