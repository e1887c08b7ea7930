"""Media facts out of probe JSON, EXIF text and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STREAM = "struct<codec_type: string, codec_name: string, width: string, height: string, avg_frame_rate: string, r_frame_rate: string, color_transfer: string, color_primaries: string, color_space: string, tags: map<string, string>, side_data_list: array<map<string, string>>>"
PROBE = f"streams array<{_STREAM}>, format struct<duration: string, bit_rate: string, format_name: string, tags: map<string, string>>"
_LOCATION_TAGS = ("location", "location-eng", "com.apple.quicktime.location.ISO6709", "com.android.location")


def probe(json: Column) -> Column:
    return F.from_json(json, PROBE)


def stream(probed: Column, kind: str) -> Column:
    """The first stream of a kind."""
    return F.get(F.filter(probed["streams"], lambda s: s["codec_type"] == kind), F.lit(0))


def number(text: Column, kind: str = "double") -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast(kind)


def frame_rate(video: Column) -> Column:
    """The average rate, else the nominal; fractions without a value give null."""

    def of(text: Column) -> Column:
        parts = F.split(text, "/")
        top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
        rate = F.try_divide(top, bottom)
        return F.when(rate > 0, rate)

    return F.coalesce(of(video["avg_frame_rate"]), of(video["r_frame_rate"]))


def iso6709(text: Column) -> Column:
    """Struct of latitude and longitude; null if malformed, too long or not on the globe."""
    parts = [F.regexp_extract(text, r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)(?:[+-]\d+(?:\.\d+)?)?/?$", n).try_cast("double") for n in (1, 2)]
    valid = (F.length(text) <= 64) & parts[0].between(-90, 90) & parts[1].between(-180, 180) & ~((parts[0] == 0) & (parts[1] == 0))
    return F.when(valid, F.struct(parts[0].alias("latitude"), parts[1].alias("longitude")))


def location(probed: Column) -> Column:
    return F.coalesce(*[iso6709(probed["format"]["tags"][t]) for t in _LOCATION_TAGS])


def is_hdr(video: Column) -> Column:
    transfer = F.lower(F.coalesce(video["color_transfer"], F.lit("")))
    wide = F.lower(F.concat_ws(" ", video["color_primaries"], video["color_space"]))
    return transfer.contains("smpte2084") | transfer.contains("arib-std-b67") | wide.contains("bt2020")


def rotation(video: Column) -> Column:
    side = F.get(F.filter(F.transform(video["side_data_list"], lambda m: m["rotation"].try_cast("int")), lambda r: r.isNotNull()), F.lit(0))
    return F.coalesce(video["tags"]["rotate"].try_cast("int"), side)


def creation_time(probed: Column, zone: str) -> Column:
    """The container's time, else the video stream's, as local time of a zone."""
    text = F.coalesce(probed["format"]["tags"]["creation_time"], stream(probed, "video")["tags"]["creation_time"])
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.try_to_timestamp(text).cast("timestamp_ntz"))


def exif_date(original: Column, digitized: Column) -> Column:
    parse = lambda c: F.try_to_timestamp(F.trim(F.translate(c, "\x00", "")), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(parse(original), parse(digitized))


def exif_text(text: Column) -> Column:
    """Without NUL padding; blank is null."""
    return F.nullif(F.trim(F.translate(text, "\x00", "")), F.lit(""))


def exif_size(sub: Column, main: Column, header: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in (sub, main, header)])


def rotation_of_orientation(tag: Column) -> Column:
    """Degrees clockwise of the eight EXIF orientations."""
    return F.when(tag.isin(3, 4), 180).when(tag.isin(5, 6), 90).when(tag.isin(7, 8), 270).otherwise(0)


def shown_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column, Column]:
    """(width, height, orientation) as displayed."""
    turned = F.pmod(F.coalesce(degrees, F.lit(0)), F.lit(180)) == 90
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return w, h, F.when(w.isNull() | h.isNull(), None).when(w > h, "LANDSCAPE").when(w < h, "PORTRAIT").otherwise("SQUARE")


def frame_positions(duration: Column, frames: int) -> Column:
    """Milliseconds of evenly spread frames, each in the middle of its share."""
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.floor((i + F.lit(0.5)) * duration * 1000 / frames + 0.5).cast("long")))


def clamp_similarity(value: Column, low: int = 70, high: int = 100) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


# The reasons why a file has no fingerprint, and whether trying again is pointless.
FAILURES = {"CORRUPTED_FILE": True, "NOT_AN_IMAGE": True, "UNSUPPORTED_FORMAT": True, "DECODER_REFUSED": True, "TOOL_UNAVAILABLE": False, "UNKNOWN": False}
HEAD_BYTES = 512


def failure_of_bytes(content: Column) -> Column:
    """Why a file did not decode, from its first bytes; UNKNOWN where there are none to read (null).

    Empty and zeroed files are corrupted; an extended WebP is a format that decoders lack; images in known formats were
    refused; the rest is no image.
    """
    head = F.hex(F.substring(content, 1, HEAD_BYTES))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    image = head.rlike("^(FFD8|89504E470D0A1A0A|47494638|424D)")
    return (
        F.when(content.isNull(), "UNKNOWN").when(head.rlike("^(00)*$"), "CORRUPTED_FILE").when(webp & (F.substring(head, 25, 8) == "56503858"), "UNSUPPORTED_FORMAT")
        .when(webp | image, "DECODER_REFUSED").otherwise("NOT_AN_IMAGE")
    )


def is_terminal(reason: Column) -> Column:
    """Whether a failure uses up its attempts at once."""
    return F.coalesce(reason.isin(*[r for r, last in FAILURES.items() if last]), F.lit(False))
