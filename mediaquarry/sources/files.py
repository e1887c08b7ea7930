"""File trees, GeoJSON boundaries, and versions published by a pointer."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p
from . import walk

_GEOMETRY = "struct<type: string, coordinates: string>"
_FEATURES = f"features array<struct<properties: map<string, string>, geometry: {_GEOMETRY}>>"
POLYGON, MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """Regular files below a root: path, length, modified_at.  Hidden files, links and shortcuts are left out; folder
    patterns look at the parts below the root only, and what they name is not entered."""
    found = walk.tree(spark, root, folders or [])
    inner = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    keep = processable(F.col("path")) & p.scan_allowed(inner, exclude or [], folders or [])
    if include:
        keep = keep & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in include])
    return found.filter(keep)


def processable(path: Column) -> Column:
    """No shortcut; links are not followed by the reader."""
    return path.isNotNull() & ~F.lower(path).endswith(".lnk")


def with_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 and MD5 of whole files of any size, hidden ones too, read once in chunks; null for those that can't be read."""
    return walk.hashed(walk.tree(spark, root, hidden=True).select("path", "length"), root).select("path", "length", "sha256", "md5")


def read_boundaries(spark: SparkSession, path: str, kind: str, codes: dict[str, str]) -> DataFrame:
    """GeoJSON features as boundaries: polygons and multi-polygons only, country codes of two letters, unknown ones left
    out, names cleaned, boxes clamped to the globe."""
    rows = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind_of, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind_of == "Polygon", F.from_json(coordinates, POLYGON)).when(kind_of == "MultiPolygon", F.flatten(F.from_json(coordinates, MULTI)))
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else F.create_map().cast("map<string,string>")
    props = F.col("f.properties")
    named = rows.select(rings.alias("rings"), clean_name(F.coalesce(props["shapeName"], props["name"])).alias("name"), table[F.upper(F.coalesce(props["shapeGroup"], props["country"]))].alias("country_code"), clean_name(props["state"]).alias("state_name"))
    flat = F.flatten("rings")
    low = lambda k: F.array_min(F.transform(flat, lambda q: q[k]))
    high = lambda k: F.array_max(F.transform(flat, lambda q: q[k]))
    return named.filter("rings IS NOT NULL AND country_code IS NOT NULL").select(
        F.lit(kind).alias("kind"), "name", "country_code", "state_name", "rings",
        F.greatest(low(1), F.lit(-90.0)).alias("south"), F.greatest(low(0), F.lit(-180.0)).alias("west"), F.least(high(1), F.lit(90.0)).alias("north"), F.least(high(0), F.lit(180.0)).alias("east"),
    )


def clean_name(text: Column) -> Column:
    """Text read in the wrong encoding put right, single spaces, at most 200 characters; blank is null."""
    repaired = F.when(text.rlike("[ÃÂ][\u0080-¿]"), F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)
    return F.nullif(F.substring(F.trim(F.regexp_replace(repaired, r"\s+", " ")), 1, 200), F.lit(""))


def import_boundaries(frames: list[DataFrame], path: str) -> int:
    """Replaces the whole table; an import without rows is an error and changes nothing."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    if rows.isEmpty():
        raise ValueError("no boundaries to import")
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def missing_countries(offered: DataFrame, have: DataFrame) -> DataFrame:
    return offered.join(have.select("country_code").distinct(), "country_code", "left_anti")


def described(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(name, columns): the session's tables and views of a prefix, with the number of their columns."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    return spark.createDataFrame([(n.removeprefix(prefix), len(spark.table(n).columns)) for n in sorted(names)], "name string, columns long")


class Published:
    """Versions of a table under one folder.  A version is written first; then a small pointer file makes it the active one.

    Pointers are numbered, and the highest is the active one.  A pointer is written aside and gets its number by a rename that
    fails where the number is taken: readers never meet half a pointer, and of two publishers that saw the same active
    version one is refused.  (The shared file system must rename so; HDFS does.)
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.store = self.hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, str | None]:
        """(number, version) of the highest pointer; (0, None) before the first."""
        root = self.hadoop.Path(self.folder)
        names = [s.getPath().getName() for s in self.store.listStatus(root)] if self.store.exists(root) else []
        numbers = [int(n[7:-5]) for n in names if n.startswith("ACTIVE-") and n.endswith(".json")]
        if not numbers:
            return 0, None
        stream = self.store.open(self._pointer(max(numbers)))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def _pointer(self, number: int):
        return self.hadoop.Path(f"{self.folder}/ACTIVE-{number:012d}.json")

    def active(self) -> str | None:
        return self._latest()[1]

    def _point(self, number: int, version: str) -> bool:
        """Whether the pointer of this number is now to the version; false if the number was taken."""
        aside = self.hadoop.Path(f"{self.folder}/{version}.pointer")
        stream = self.store.create(aside, True)
        try:
            stream.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            stream.close()
        context = self.hadoop.FileContext.getFileContext(self.store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 1)
        keep[0] = self.hadoop.Options.Rename.NONE
        try:
            context.rename(aside, self._pointer(number), keep)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            self.store.delete(aside, False)
            return False
        return True

    def publish(self, df: DataFrame, based_on: str | None = None, incremental: bool = False) -> str:
        """Writes a version and makes it active.  An incremental one is refused if ``based_on`` isn't the active version any more,
        also if that changes at the last moment; a whole one then takes the next number."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{version}")
        while True:
            number, active = self._latest()
            if incremental and active != based_on:
                raise RuntimeError("the version this was based on is no longer the active one")
            if self._point(number + 1, version):
                return version

    def read(self) -> DataFrame:
        version = self.active()
        if version is None:
            raise ValueError("nothing is published here")
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def sweep(self, older_than_millis: int, now_millis: int) -> list[str]:
        """Removes versions that are not active and have not changed for so long, and all pointers but the last."""
        (number, kept), gone = self._latest(), []
        for s in self.store.listStatus(self.hadoop.Path(self.folder)):
            name = s.getPath().getName()
            if s.isDirectory() and name != kept and now_millis - s.getModificationTime() > older_than_millis:
                self.store.delete(s.getPath(), True)
                gone.append(name)
            elif name.startswith("ACTIVE-") and name != self._pointer(number).getName():
                self.store.delete(s.getPath(), False)
        return gone
