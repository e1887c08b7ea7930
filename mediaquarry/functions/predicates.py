"""Filters as columns.  A filter whose parameter is None vanishes, which plans better than ``p IS NULL OR ...``."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are there."""
    there = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, there) if there else F.lit(True)


def optional(value, build) -> Column | None:
    return None if value is None else build(value)


def active(status: Column) -> Column:
    return status == "ACTIVE"


def prefix_ci(column: Column, prefix: str) -> Column:
    """Case-insensitive prefix in which % and _ are wild, as a user may type them."""
    return F.lower(column).like(prefix.lower() + "%")


def contains_ci(column: Column, part: str) -> Column:
    return F.lower(column).contains(part.lower())


def under(path: Column, folder: str | Column) -> Column:
    """Strictly below a folder, whichever separator, every character literal, case ignored."""
    root = F.lit(folder) if isinstance(folder, str) else folder
    return F.startswith(F.lower(plain(path)), F.concat(F.rtrim(F.lower(plain(root)), F.lit("/")), F.lit("/")))


def plain(path: Column) -> Column:
    """Forward slashes only."""
    return F.translate(path, "\\", "/")


def without_excluded_folders(rows: DataFrame, excluded: DataFrame, folder: str, excluded_folder: str) -> DataFrame:
    """Anti-join on equal or ancestor folders.

    Each row's folder is expanded to its own chain of ancestors (a handful), so that the test is an equality: a hashed
    anti-join instead of a nested loop.
    """
    bad = excluded.select(F.rtrim(plain(F.col(excluded_folder)), F.lit("/")).alias("__bad")).distinct()
    parts = F.split(F.rtrim(plain(F.col("__own")), F.lit("/")), "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = rows.select(F.col(folder).alias("__own")).distinct()
    hit = folders.select("__own", F.explode(chain).alias("__chain"))
    hit = hit.join(bad, F.col("__chain") == F.col("__bad"), "left_semi").select("__own").distinct()
    return rows.join(hit, F.col(folder) == F.col("__own"), "left_anti")


def null_safe(pairs: Iterable[tuple[Column, object]]) -> Column:
    """All equal, nulls included."""
    return every(*(a.eqNullSafe(F.lit(b) if not isinstance(b, Column) else b) for a, b in pairs))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float, closed: bool = True) -> Column:
    """Inclusive, or half-open."""
    if closed:
        return lat.between(south, north) & lon.between(west, east)
    return (lat >= south) & (lat < north) & (lon >= west) & (lon < east)


def longest_side(width: Column, height: Column, least: int) -> Column:
    return F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))) >= least


def presence(column: Column, mode: str | None) -> Column | None:
    """ANY (or None), WITH, WITHOUT."""
    return {None: None, "ANY": None, "WITH": column.isNotNull(), "WITHOUT": column.isNull()}[mode]


def day_window(column: Column, first: date | None, last: date | None) -> Column | None:
    """From midnight of the first day to before midnight after the last."""
    low = optional(first, lambda d: column >= F.lit(datetime(d.year, d.month, d.day)).cast("timestamp_ntz"))
    high = optional(last, lambda d: column < F.lit(datetime(d.year, d.month, d.day) + timedelta(days=1)).cast("timestamp_ntz"))
    return every(low, high) if low is not None or high is not None else None


def tri_state(column: Column, wanted: bool | None) -> Column | None:
    """None: no filter; True: must be there; False: must be missing."""
    return None if wanted is None else column.isNotNull() if wanted else column.isNull()


def stale_or_never(column: Column, cutoff: Column) -> Column:
    return column.isNull() | (column < cutoff)


def member(rows: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Set membership as a semi-join, for sets of any size."""
    return rows.join(ids.select(F.col(id_column).alias("__member")).distinct(), F.col(column) == F.col("__member"), "left_semi")


def functional_history(type_: Column, trigger: Column, status: Column, repaired: Column) -> Column:
    """Hides only timer reconciliations that finished and repaired nothing; an unknown trigger stays."""
    silent = (type_ == "RECONCILE") & (trigger == "TIMER") & (status == "FINISHED") & (F.coalesce(repaired, F.lit(0)) == 0)
    return ~F.coalesce(silent, F.lit(False))


def moved_path(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` (case ignored, every character literal) moved below ``new``; others stay."""
    below = F.lower(F.substring(path, 1, len(old))) == old.lower()
    border = (F.length(path) == len(old)) | F.substring(path, len(old) + 1, 1).isin("/", "\\")
    return F.when(below & border, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def folder_matches(name: Column, pattern: str) -> Column:
    """Literal and case-insensitive; * and ? are wild when the pattern has them."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return name.rlike(f"(?is)^{body}$")


def _matcher(pattern: str):
    return lambda part: folder_matches(part, pattern)


def scan_allowed(path: Column, extensions: Iterable[str], folders: Iterable[str]) -> Column:
    """Not of an excluded extension and in none of the excluded folders."""
    parts = F.split(plain(path), "/")
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    wrong = [F.exists(inner, _matcher(f)) for f in folders]
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return ~reduce(lambda a, b: a | b, [ext.isin([e.lower().lstrip(".") for e in extensions]), *wrong])


def settings_list(text: str | None) -> list[str]:
    """A setting's entries, split at commas, semicolons and line ends."""
    return [p.strip() for p in re.split(r"[,;\r\n]+", text or "") if p.strip()]


def lock_chain(path: Column) -> Column:
    """A path's key and those of all its ancestors."""
    parts = F.filter(F.split(F.lower(plain(path)), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
