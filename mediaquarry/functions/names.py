"""File names, sizes and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Each file type with its category, extensions and MIME beginnings, in the order in which they are asked.
TYPES = [
    ("PHOTO", "MEDIA", "jpg jpeg png gif bmp webp heic heif tif tiff", "image/"),
    ("VIDEO", "MEDIA", "mp4 mov avi mkv wmv flv webm mpeg mpg 3gp m4v", "video/"),
    ("AUDIO", "MEDIA", "mp3 wav flac aac ogg m4a wma opus amr", "audio/"),
    ("PDF", "DOCUMENT", "pdf", "application/pdf"),
    ("WORD", "DOCUMENT", "doc docx", "application/msword application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("EXCEL", "DOCUMENT", "xls xlsx csv", "application/vnd.ms-excel application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("POWERPOINT", "DOCUMENT", "ppt pptx", "application/vnd.ms-powerpoint application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("TEXT", "DOCUMENT", "txt md log json xml yaml yml", "text/ application/json application/xml application/yaml"),
    ("ZIP", "ARCHIVE", "zip", "application/zip"),
    ("RAR", "ARCHIVE", "rar", "application/vnd.rar application/x-rar-compressed"),
    ("SEVEN_Z", "ARCHIVE", "7z", "application/x-7z-compressed"),
]
_OF_EXTENSION = {e: t for t, _, names, _ in TYPES for e in names.split()}
MEDIA = tuple(t for t, category, _, _ in TYPES if category == "MEDIA")


def extension(name: Column) -> Column:
    """Lower-case text after the last dot of the last part; empty if there is none or nothing follows it."""
    return F.lower(F.trim(F.regexp_extract(name, r"\.([^./\\]+)$", 1)))


def base_name(name: Column) -> Column:
    """The name without its extension; a dot at the start is none."""
    return F.when(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1) != "", F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def suffix(name: Column) -> Column:
    return F.substring(name, F.length(base_name(name)) + 1, F.length(name))


def numbered(name: Column, same: list[Column], order: list[Column]) -> Column:
    """Names made distinct: of those that agree (case ignored), all but the first get " (n)" in front of the suffix."""
    at = F.row_number().over(Window.partitionBy(*same, F.lower(name)).orderBy(*order))
    return F.when(at == 1, name).otherwise(F.concat(base_name(name), F.lit(" ("), (at - 1).cast("string"), F.lit(")"), suffix(name)))


def type_of_extension(ext: Column) -> Column:
    """Null if no type has the extension; case, blanks and a leading dot don't matter."""
    table = F.create_map(*[F.lit(x) for pair in _OF_EXTENSION.items() for x in pair])
    return table[F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")]


def type_of_mime(mime: Column) -> Column:
    """Null if no type has the MIME type's beginning."""
    low = F.lower(mime)
    return F.coalesce(*[F.when(low.startswith(begin), t) for t, _, _, begins in TYPES for begin in begins.split()])


def file_type(ext: Column, mime: Column) -> Column:
    """By extension, then by MIME type; a MIME type alone makes no photo, video or audio."""
    by_mime = type_of_mime(mime)
    return F.coalesce(type_of_extension(ext), F.when(~by_mime.isin(*MEDIA), by_mime), F.lit("OTHER"))


def category_of(kind: Column) -> Column:
    """MEDIA, DOCUMENT, ARCHIVE or OTHER."""
    return F.coalesce(*[F.when(kind == t, category) for t, category, _, _ in TYPES], F.lit("OTHER"))


def archive_as_media(ext: Column, mime: Column) -> Column:
    """A media extension over an archive's content."""
    return type_of_extension(ext).isin(*MEDIA) & F.coalesce(mime.rlike("^application/(zip|x-rar|vnd.rar|x-7z|gzip|x-tar)"), F.lit(False))


def human_size(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB", "PB", "EB")) -> Column:
    """Bytes below 1024, else two decimals (rounded half up) in steps of 1024; the last unit has no upper bound."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        rounded = F.floor(size / F.lit(float(1024**k)) * 100 + 0.5) / 100
        value = F.format_string(f"%.2f {unit}", rounded)
        out = out.when(size < 1024 ** (k + 1), value) if k < len(units) else out.otherwise(value)
    return out


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def in_any_folder(path: Column, names: list[str]) -> Column:
    """Whether a part of the path is one of the names (case ignored, either separator)."""
    parts = F.transform(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda p: F.trim(p))
    return F.exists(parts, lambda p: p.isin([n.strip().lower() for n in names if n.strip()]))


def duration_label(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    whole = F.floor(seconds).cast("long")
    minutes = (F.floor(whole / 60) % 60).cast("long")
    hours = F.floor(whole / 3600).cast("long")
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, whole % 60)).when(whole >= 0, F.format_string("%d:%02d", minutes, whole % 60))


def resolution_label(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def folder_name(text: Column, most: int = 100) -> Column:
    """Fit for a folder: control and reserved characters to spaces, single spaces, no dots at the end."""
    clean = F.regexp_replace(text, r'[\x00-\x1F\x7F<>:"/\\|?*]', " ")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    clean = F.regexp_replace(F.substring(clean, 1, most), r"[. ]+$", "")
    return blank_to_null(clean)


def place_label(city: Column, state: Column, country: Column, open_sea: Column, short: bool = False) -> Column:
    """City, state, country as far as known; open water has a name of its own."""
    parts = [blank_to_null(city), blank_to_null(country)] if short else [blank_to_null(city), blank_to_null(state), blank_to_null(country)]
    return F.when(F.coalesce(open_sea, F.lit(False)), "Open sea").otherwise(blank_to_null(F.concat_ws(", ", *parts)))


def coordinate_key(lat: Column, lon: Column) -> Column:
    """Four decimals; null outside the globe and for (0, 0)."""
    valid = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(valid, F.format_string("%.4f:%.4f", lat, lon))
