"""Map pins: grid cells and administrative regions."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import from_url_safe, url_safe

REGION = ("country_name", "state_name", "city_name")


def cell_for_zoom(zoom: int) -> float:
    return max(0.0001, 90 / 2 ** max(0, zoom))


def cell_of(zoom: Column) -> Column:
    """``cell_for_zoom`` of each row's zoom."""
    return F.greatest(F.lit(0.0001), F.lit(90.0) / F.pow(F.lit(2.0), F.greatest(F.lit(0), zoom)))


def centre(value: Column, cell: float) -> Column:
    return (F.floor(value / F.lit(cell)) + F.lit(0.5)) * F.lit(cell)


def _counts() -> list[Column]:
    return [F.count_if(F.col("file_type") == "PHOTO").alias("photos"), F.count_if(F.col("file_type") == "VIDEO").alias("videos"), F.count(F.lit(1)).alias("total")]


def _cover() -> Column:
    return F.max_by("public_id", F.struct("capture_date", "id")).alias("cover")


def located(files: DataFrame, metadata: DataFrame, places: DataFrame) -> DataFrame:
    """Active photos and videos with their metadata and, if known, place."""
    media = files.filter((F.col("lifecycle_status") == "ACTIVE") & F.col("file_type").isin("PHOTO", "VIDEO"))
    return media.join(metadata, media["id"] == metadata["file_id"]).drop("file_id").join(places.withColumnRenamed("file_id", "__f"), F.col("id") == F.col("__f"), "left").drop("__f")


def grid_pins(rows: DataFrame, cell: float) -> DataFrame:
    """One pin a cell; labels are independent maxima, the cover is the newest file (no date counts as oldest)."""
    return rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy(centre(F.col("latitude"), cell).alias("lat"), centre(F.col("longitude"), cell).alias("lon")).agg(
        *_counts(), *[F.max(c).alias(c) for c in REGION], F.bool_or(F.coalesce("open_sea", F.lit(False))).alias("open_sea"), _cover()
    )


def grid_pins_in_box(rows: DataFrame, cell: float, south: float, west: float, north: float, east: float, top: int) -> DataFrame:
    """Pins of the files inside a closed box, the fullest first."""
    inside = rows.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return grid_pins(inside, cell).orderBy(F.desc("total"), "lat", "lon").limit(top)


def region_pins(rows: DataFrame) -> DataFrame:
    """Pins of files without coordinates, by region; null parts group together."""
    lone = rows.filter("latitude IS NULL AND country_name IS NOT NULL")
    return lone.groupBy(*REGION).agg(*_counts(), _cover())


def all_pins(rows: DataFrame, cell: float) -> DataFrame:
    grid = grid_pins(rows, cell).select("lat", "lon", *REGION, "total", "cover")
    regions = region_pins(rows).select(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), *REGION, "total", "cover")
    return grid.unionByName(regions)


def pin_id(*parts: object) -> str:
    """URL-safe id of a pin's parts."""
    return base64.urlsafe_b64encode("\n".join("" if p is None else str(p) for p in parts).encode()).decode().rstrip("=")


def pin_parts(pin: str) -> list[str | None]:
    text = base64.urlsafe_b64decode(pin + "=" * (-len(pin) % 4)).decode()
    return [p or None for p in text.split("\n")]


def pin_ids(*parts: Column) -> Column:
    """``pin_id`` for every row: null parts are empty lines."""
    return url_safe(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\n"))


def parts_of_pins(pin: Column) -> Column:
    """The parts again, empty ones null."""
    return F.transform(F.split(from_url_safe(pin), "\n", -1), lambda s: F.nullif(s, F.lit("")))


def cell_items(rows: DataFrame, lat: float, lon: float, cell: float) -> DataFrame:
    """A cell's files: half-open around its centre, newest first."""
    half = cell / 2
    inside = rows.filter((F.col("latitude") >= lat - half) & (F.col("latitude") < lat + half) & (F.col("longitude") >= lon - half) & (F.col("longitude") < lon + half))
    return _newest(inside)


def region_items(rows: DataFrame, country: str | None, state: str | None, city: str | None) -> DataFrame:
    same = [F.col(c).eqNullSafe(F.lit(v).cast("string")) for c, v in zip(REGION, (country, state, city))]
    return _newest(rows.filter(F.col("latitude").isNull() & same[0] & same[1] & same[2]))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("capture_date"), F.desc("id"))
