"""Organisation plans: rules, targets, conflicts, guards, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import in_any_folder

LAYOUTS = ("FLAT", "YEAR", "YEAR_MONTH", "YEAR_MONTH_DAY", "CATEGORY_YEAR_MONTH")
# What a family's names look like, and the folders that tell it.
NAMES = {
    "WHATSAPP": r"(?i)^[a-z]+[-_].*[-_]WA\d+",
    "AIRBRUSH": r"(?i)^AIRBRUSH",
    "PHOTOGRID": r"(?i)^PHOTOGRID",
    "FACEBOOK": r"(?i)^FB_IMG",
    "FACEAPP": r"(?i)^FACEAPP",
    "SCREENSHOT": r"(?i)^(SCREENSHOT|SCREENRECORD|CAPTURA)",
    "DRONE": r"(?i)^DJI_",
    "GOPRO": r"(?i)^(GOPR|GH|GX|G0\d{6}(\D|$))",
    "CAMERA": r"(?i)^(\d{8}_\d{6}|\d{4}-\d{2}-\d{2}|(DSC\d{5}|DSCN\d{4}|GEDC\d{4}|IMGP\d{4}|CIMG\d{4}|[SP]\d{7}|\d{3}_\d{4})(\D|$)|IMG_|VID_|DSC_|PXL_)",
    "PEACHY": r"(?i)^PEACHY",
    "IMAGE_UUID": r"(?i)^IMAGE_",
}
FOLDERS = {"WHATSAPP": ["WHATS", "WHATSAPP"], "SCREENSHOT": ["SCREENSHOT", "CAPTURA"], "DRONE": ["DRONE", "DJI"], "GOPRO": ["GOPRO"], "CAMERA": ["CAMERA"]}
#: Subcategory rules in their order: (family, subcategory, do folders tell); the first that holds wins.
CLASSIFIERS = [
    ("WHATSAPP", "WHATSAPP", True), ("AIRBRUSH", "AIRBRUSH", False), ("PHOTOGRID", "PHOTOGRID", False), ("FACEBOOK", "OTHER", False), ("FACEAPP", "OTHER", False), ("SCREENSHOT", "SCREENSHOT", True),
    ("DRONE", "DRONE", True), ("GOPRO", "GOPRO", True), ("CAMERA", "CAMERA", False), ("PEACHY", "OTHER", False), ("IMAGE_UUID", "CAMERA", False),
]
#: Organisation rules: (priority, family, subcategories that tell it in the catalogue).
RULES = [(10, "WHATSAPP", ["WHATSAPP"]), (20, "DRONE", ["DRONE"]), (30, "GOPRO", ["GOPRO"]), (40, "SCREENSHOT", ["SCREENSHOT"]), (90, "CAMERA", ["CAMERA", "CELLPHONE"])]
DEFAULT_PRIORITY = 999
#: Folders that a subcategory is filed under; what is not listed goes to OUTROS.
FOLDER_OF = {"CAMERA": "CAMERA", "CELLPHONE": "CAMERA", "WHATSAPP": "WHATS", "AIRBRUSH": "AIRBRUSH", "PHOTOGRID": "PHOTOGRID", "DRONE": "DRONE", "GOPRO": "GOPRO", "SCREENSHOT": "SCREENSHOT"}


def _named(name: Column, family: str) -> Column:
    return F.coalesce(name.rlike(NAMES[family]), F.lit(False))


def _placed(path: Column, family: str) -> Column:
    return F.coalesce(in_any_folder(path, FOLDERS[family]), F.lit(False))


def subcategory(name: Column, path: Column) -> Column:
    """By name and path; UNKNOWN if no rule holds, or without a name."""
    out = F.when(name.isNull(), "UNKNOWN")
    for family, label, by_folder in CLASSIFIERS:
        out = out.when(_named(name, family) | _placed(path, family) if by_folder else _named(name, family), label)
    return out.otherwise("UNKNOWN")


def folder_of(label: Column) -> Column:
    return F.coalesce(*[F.when(label == k, v) for k, v in FOLDER_OF.items()], F.lit("OUTROS"))


def classified(known: Column, path: Column, name: Column) -> tuple[Column, Column, Column]:
    """(subcategory, priority, reason) by the first organisation rule that holds.

    A rule holds by what the catalogue knows (DATABASE), by a folder of the path (FOLDER) or by the name (FILE_NAME), in
    this order; without any the file is OTHER for the reason UNKNOWN.
    """
    label = priority = reason = F
    for order, family, own in RULES:
        database, folder = F.coalesce(known.isin(*own), F.lit(False)), _placed(path, family)
        holds = database | folder | _named(name, family)
        label, priority = label.when(holds, family), priority.when(holds, order)
        reason = reason.when(database, "DATABASE").when(folder, "FOLDER").when(holds, "FILE_NAME")
    return label.otherwise("OTHER"), priority.otherwise(DEFAULT_PRIORITY), reason.otherwise("UNKNOWN")


def candidate_filter(extensions: list[str] | None = None, types: list[str] | None = None, categories: list[str] | None = None, subcategories: list[str] | None = None, folder: str | None = None, recursive: bool = True) -> Column:
    from ..functions import predicates as p

    here = p.optional(folder, lambda v: (F.lower(p.plain(F.col("folder"))) == v.replace("\\", "/").rstrip("/").lower()) | (p.under(F.col("folder"), v) if recursive else F.lit(False)))
    return p.every(here, p.optional(extensions, lambda v: F.lower("extension").isin([e.lower() for e in v])), p.optional(types, lambda v: F.col("file_type").isin(v)), p.optional(categories, lambda v: F.col("category").isin(v)), p.optional(subcategories, lambda v: F.col("subcategory").isin(v)))


def target_folder(layout: str, date: Column, category: Column, label: Column, place: Column | None = None) -> Column:
    """Folder of a layout; place segments come after the date; FLAT has none of all this."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    year, month, day = F.substring(date, 1, 4), F.substring(date, 6, 2), F.substring(date, 9, 2)
    parts = {"FLAT": [], "YEAR": [year], "YEAR_MONTH": [year, month], "YEAR_MONTH_DAY": [year, month, day], "CATEGORY_YEAR_MONTH": [category, year, month]}[layout]
    if layout == "FLAT":
        return F.lit("")
    dated = F.when(date == "NO_DATE", F.concat_ws("/", category if layout.startswith("CATEGORY") else F.lit(None).cast("string"), F.lit("NO_DATE"))).otherwise(F.concat_ws("/", *parts))
    return F.concat_ws("/", dated, place if place is not None else F.lit(None).cast("string"), label)


def conflicts(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``same``, ``duplicate_target`` and ``target_exists``; items that stay where they are take part in none.

    Only what moves is counted and joined, so that a library in order costs a scan; many items of one target meet one row
    that tells so.
    """
    moves = F.coalesce(F.col("target") != F.col("path"), F.lit(False))
    rows = items.withColumn("same", F.col("target") == F.col("path"))
    moving = rows.filter(moves).withColumn("__key", F.lower("target"))
    wanted = moving.groupBy("__key").agg((F.count(F.lit(1)) > 1).alias("duplicate_target"))
    there = existing.select(F.lower("path").alias("__key")).distinct().withColumn("target_exists", F.lit(True))
    told = wanted.join(there, "__key", "left").select("__key", "duplicate_target", F.coalesce("target_exists", F.lit(False)).alias("target_exists"))
    stay = rows.filter(~moves).withColumns({"duplicate_target": F.lit(False), "target_exists": F.lit(False)})
    return moving.join(told, "__key").drop("__key").unionByName(stay)


def plan_statistics(items: DataFrame) -> DataFrame:
    """Everything counts, but conflicts only over the items that are kept."""
    kept = ~F.col("same")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return items.agg(F.count(F.lit(1)).alias("items"), count(F.col("same"))("organised"), count(kept & F.col("duplicate_target"))("duplicate_targets"), count(kept & F.col("target_exists"))("existing_targets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def move_outcome(duplicate_target: Column, physical: Column, source_there: Column, target_there: Column, owned_by_other: Column) -> Column:
    """What a move would come to; the guards' order matters."""
    return F.when(duplicate_target, "DUPLICATE_TARGET").when(~physical, "NOT_PHYSICAL").when(~source_there & target_there, "ALREADY_MOVED").when(~source_there, "SOURCE_MISSING").when(owned_by_other, "TARGET_OWNED").when(target_there, "TARGET_EXISTS").otherwise("READY")


def require_no_conflicts(items: DataFrame, allowed: bool) -> None:
    if not allowed and not items.filter(~F.col("same") & (F.col("duplicate_target") | F.col("target_exists"))).limit(1).isEmpty():
        raise ValueError("the plan has conflicts")
