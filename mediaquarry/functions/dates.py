"""Dates out of file names, folders and metadata.

File-name rules are a table: what a family's names look like and where their dates stand.  Rules are asked in the order of
their names, a rule's patterns in theirs, and the first plausible date wins.  Clocks are parameters.  A day that a month
does not have counts as the month's last (so the formats' usual lenient reading).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where digits of dates stand in names.
_UNDERSCORE, _SEPARATED, _RUN, _DAY = r"\d{8}_\d{6}", r"\d{8}[_-]\d{6}", r"(?<!\d)\d{14}(?!\d)", r"\d{8}"
_DASHED = r"^\d{4}-\d{2}-\d{2}[ _-]\d{2}[.-]\d{2}[.-]\d{2}"
_DOTTED = r"\d{4}\.(?:0[1-9]|1[0-2])\.(?:0[1-9]|[12]\d|3[01])"
#: Rules by name, each with what it applies to and its patterns; "epoch" patterns hold milliseconds.
RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "010_WHATSAPP": (r"(?i)^[a-z]+[-_].*[-_]WA\d+", [("first", r"(?i)[-_](\d{8})[-_]WA")]),
    "020_AIRBRUSH": (r"(?i)^AIRBRUSH", [("all", _SEPARATED), ("all", _RUN), ("all", _DAY)]),
    "022_PHOTOGRID": (r"(?i)^PHOTOGRID", [("epoch", r"(?i)PHOTOGRID[-_]([12]\d{12})"), ("all", _SEPARATED), ("all", _DAY)]),
    "024_FACEBOOK": (r"(?i)^FB_IMG", [("epoch", r"(?i)FB_IMG_([12]\d{12})")]),
    "026_FACEAPP": (r"(?i)^FACEAPP", [("epoch", r"(?i)FACEAPP[-_]([12]\d{12})")]),
    "030_SCREENSHOT": (r"(?i)^(SCREENSHOT|SCREENRECORD|CAPTURA)", [("all", _SEPARATED), ("all", _DAY)]),
    "070_PEACHY": (r"(?i)^PEACHY", [("all", _UNDERSCORE)]),
    "080_IMAGE_UUID": (r"(?i)^IMAGE_", [("all", _UNDERSCORE)]),
    "090_DASHED_DATE_TIME": (r"^\d{4}-\d{2}-\d{2}", [("all", _DASHED)]),
    "095_DOTTED_DATE": (_DOTTED, [("all", _DOTTED)]),
    "096_MONTH_FIRST_DATE_TIME": (r"^\d{12}(?!\d)", [("month first", r"^(\d{12})(?!\d)")]),
    "100_GENERIC": (r"\d{8}", [("all", _UNDERSCORE), ("all", _RUN), ("all", _DAY)]),
}
EARLIEST_YEAR = 1900
#: Digits that are a day, with or without a time.
_DATE = r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(([01]\d|2[0-3])[0-5]\d[0-5]\d)?$"


def _valid(digits: Column, newest_year: int) -> Column:
    return digits.rlike(_DATE) & F.substring(digits, 1, 4).between(str(EARLIEST_YEAR), str(newest_year))


def first_date(name: Column, regex: str, newest_year: int) -> Column:
    """The digits of the first match that are a plausible date; every match is tried."""
    joined = F.transform(F.regexp_extract_all(name, F.lit(regex), 0), lambda s: F.regexp_replace(s, r"\D", ""))
    return F.get(F.filter(joined, lambda s: _valid(s, newest_year)), F.lit(0))


def _found(name: Column, how: str, regex: str, newest_year: int) -> Column:
    """The digits that a pattern finds: 8 or 14 of a date, 13 of milliseconds, or null."""
    if how == "all":
        return first_date(name, regex, newest_year)
    digits = F.regexp_extract(name, regex, 1)
    if how == "first":
        return F.when(_valid(digits, newest_year), digits)
    if how == "epoch":
        end = int(datetime(newest_year + 1, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
        return F.when((digits != "") & (digits < str(end)), digits)
    # MMddyyHHmmss of old phones; twelve digits that read as day, month, plausible year and a counter are not it
    day_first = digits.rlike(r"^(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])") & F.substring(digits, 5, 4).between(str(EARLIEST_YEAR), str(newest_year))
    turned = F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{6})$", "20$2$1$3")
    return F.when(~day_first & _valid(turned, newest_year), turned)


def _stamp(digits: Column) -> Column:
    """A timestamp from what ``_found`` gives; the day is at most the month's last."""

    def of(d: Column) -> Column:
        part = lambda a: F.substring(d, a, 2).try_cast("int")
        year, timed = F.substring(d, 1, 4).try_cast("int"), F.length(d) == 14
        last = F.dayofmonth(F.last_day(F.try_to_date(F.substring(d, 1, 6), "yyyyMM")))
        hour, minute, second = (F.when(timed, part(a)).otherwise(0) for a in (9, 11, 13))
        at = F.try_make_timestamp_ntz(year, part(5), F.least(part(7), last), hour, minute, second.cast("decimal(8,6)"))
        return F.when(F.length(d) == 13, F.timestamp_millis(d.try_cast("long")).cast("timestamp_ntz")).otherwise(at)

    return F.get(F.transform(F.array(digits), of), F.lit(0))


def from_file_name(name: Column, now: datetime, rules: list[str] | None = None) -> Column:
    chosen = [RULES[rule] for rule in rules or sorted(RULES)]
    columns = {p: _found(name, *p, now.year + 1) for _, patterns in chosen for p in patterns}  # rules share patterns
    return _stamp(F.coalesce(*[F.when(name.rlike(applies), F.coalesce(*[columns[p] for p in patterns])) for applies, patterns in chosen]))


# The folder names of the date layout.
LAYOUT_SUBCATEGORIES = ("WHATS", "CAMERA", "DRONE", "GOPRO", "SCREENSHOT", "OUTROS")
LAYOUT_TYPES = ("IMAGENS", "VIDEOS", "AUDIOS", "PDFS", "WORD", "EXCEL", "POWERPOINT", "TEXTOS", "OUTROS")


def from_folders(path: Column, now: datetime) -> Column:
    """A date from .../yyyyMM/dd/subcategory/type/file, where the parts are such; here a day must exist."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    part = lambda n: F.try_element_at(parts, F.lit(-n))
    valid = part(5).rlike(r"^\d{6}$") & part(4).rlike(r"^\d{2}$") & F.upper(part(3)).isin(*LAYOUT_SUBCATEGORIES) & F.upper(part(2)).isin(*LAYOUT_TYPES)
    at = F.try_to_timestamp(F.concat(part(5), part(4)), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return F.when(valid & F.year(at).between(EARLIEST_YEAR, now.year + 1), at)


def capture_date(exif: Column, media_info: Column, name: Column, folder: Column, created: Column, modified: Column) -> tuple[Column, Column]:
    """(date, source) by precedence; of the file system's stamps the older, created on a tie."""
    older = modified.isNotNull() & (created.isNull() | (modified < created))
    order = [(exif, "EXIF"), (media_info, "MEDIA_INFO"), (name, "FILE_NAME"), (folder, "FOLDER_LAYOUT"), (F.when(older, modified), "FILE_MODIFIED_AT"), (created, "FILE_CREATED_AT")]
    return F.coalesce(*[c for c, _ in order]), F.coalesce(*[F.when(c.isNotNull(), s) for c, s in order], F.lit("UNKNOWN"))


def refined(name_date: Column, modified: Column, created: Column) -> tuple[Column, Column]:
    """A name's midnight takes the time of a stamp of the same day, modified before created; (date, confirmed)."""
    midnight = name_date == F.date_trunc("day", name_date).cast("timestamp_ntz")
    same = lambda stamp: stamp.isNotNull() & (F.to_date(stamp) == F.to_date(name_date))
    better = F.when(midnight & same(modified), modified).when(midnight & same(created), created)
    return F.coalesce(better, name_date), better.isNotNull()


def valid_capture(at: Column, now: datetime) -> Column:
    """Kept from 1995 to a year from now, otherwise null."""
    latest = F.lit(now.replace(year=now.year + 1)).cast("timestamp_ntz")
    return F.when((F.year(at) >= 1995) & (at <= latest), at)


# How far a date's source is trusted; a file name with a time of day counts as confirmed.
TRUST = {"EXIF": 5, "MEDIA_INFO": 5, "FILE_NAME_CONFIRMED": 4, "FILE_NAME": 3, "FOLDER_LAYOUT": 3, "FILE_MODIFIED_AT": 2, "FILE_CREATED_AT": 1}


def trust(source: Column, at: Column) -> Column:
    """Rank of a date's source, from 0 to 5."""
    timed = (source == "FILE_NAME") & (at != F.date_trunc("day", at).cast("timestamp_ntz"))
    return F.coalesce(F.when(timed, TRUST["FILE_NAME_CONFIRMED"]), *[F.when(source == k, v) for k, v in TRUST.items()], F.lit(0))


def plan_date(capture: Column, year: Column, month: Column, day: Column, year_month: Column) -> Column:
    """yyyy-MM-dd from the best of: capture date, year/month/day, year-month and day; or no date."""
    parts = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day))
    text = F.when(year_month.rlike(r"^\d{4}-\d{2}$") & day.isNotNull(), F.format_string("%s-%02d", year_month, day))
    return F.coalesce(F.date_format(capture, "yyyy-MM-dd"), parts, text, F.lit("NO_DATE"))
