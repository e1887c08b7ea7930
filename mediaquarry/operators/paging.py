"""Pages: keyset, offset, and their cursors."""

from __future__ import annotations

import base64
import json
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE, DEFAULT_LIMIT, MAX_LIMIT = 500, 50, 250
LOWEST = -(2**63)


def limited(value: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return default if value is None or value < 1 else min(value, most)


def limit_of(value: Column, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> Column:
    """``limited`` of each row's wish."""
    return F.when(value.isNull() | (value < 1), F.lit(default)).otherwise(F.least(value, F.lit(most)))


def after(date_column: Column, id_column: Column, at: datetime, last_id: int) -> Column:
    """Rows that come after (at, last_id) in descending order."""
    when = F.lit(at).cast("timestamp_ntz")
    return (date_column < when) | ((date_column == when) & (id_column < last_id))


def keyset_page(rows: DataFrame, date_column: str, id_column: str, cursor: tuple[datetime, int] | None, limit: int) -> DataFrame:
    """One row more than the limit, which tells whether there is another page; a bounded top-k, not a sort."""
    dated = rows.filter(F.col(date_column).isNotNull())
    if cursor:
        dated = dated.filter(after(F.col(date_column), F.col(id_column), *cursor))
    return dated.orderBy(F.desc(date_column), F.desc(id_column)).limit(limit + 1)


def jump_cursor(day: date) -> tuple[datetime, int]:
    """The cursor in front of a day: its next midnight, below every id."""
    return datetime(day.year, day.month, day.day) + timedelta(days=1), LOWEST


def undated_page(rows: DataFrame, date_column: str, id_column: str, last_id: int | None, limit: int) -> DataFrame:
    lone = rows.filter(F.col(date_column).isNull())
    return (lone if last_id is None else lone.filter(F.col(id_column) < last_id)).orderBy(F.desc(id_column)).limit(limit + 1)


def batch_after(rows: DataFrame, id_column: str, last_id: int | None, size: int) -> DataFrame:
    """Ascending batches by id."""
    return (rows if last_id is None else rows.filter(F.col(id_column) > last_id)).orderBy(id_column).limit(size)


def offset_page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    size = max(1, min(size, MAX_PAGE))
    return rows.orderBy(*order).offset(max(0, page) * size).limit(size)


def by_day(page: DataFrame, date_column: str, id_column: str) -> DataFrame:
    """A page's rows grouped by day, newest first inside each."""
    return page.groupBy(F.to_date(date_column).alias("day")).agg(F.sort_array(F.collect_list(F.struct(date_column, id_column)), asc=False).alias("items"))


def url_safe(text: Column) -> Column:
    """URL-safe base64 of a text, without padding."""
    return F.rtrim(F.translate(F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def from_url_safe(text: Column) -> Column:
    """The text again; null if it is none."""
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


_BODY = "k string, t string, i long"


def cursor_column(kind: str, at: Column, last_id: Column) -> Column:
    """``encode_cursor`` for every row."""
    stamp = F.replace(at.cast("string"), F.lit(" "), F.lit("T"))
    return url_safe(F.concat(F.lit(f'{{"k":"{kind}","t":'), F.coalesce(F.concat(F.lit('"'), stamp, F.lit('"')), F.lit("null")), F.lit(',"i":'), last_id.cast("string"), F.lit("}")))


def position_column(cursor: Column, kind: str) -> Column:
    """Struct of (at, id) of a cursor; null if it is malformed or of another list."""
    body = F.from_json(from_url_safe(cursor), _BODY)
    return F.when((body["k"] == kind) & body["i"].isNotNull(), F.struct(body["t"].try_cast("timestamp_ntz").alias("at"), body["i"].alias("id")))


def encode_cursor(kind: str, at: datetime | None, last_id: int) -> str:
    body = json.dumps({"k": kind, "t": at.isoformat() if at else None, "i": last_id}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(text: str, kind: str) -> tuple[datetime | None, int]:
    """The cursor's position; an error if it is malformed or of another list."""
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if body["k"] != kind or not isinstance(body["i"], int):
            raise ValueError
        return (datetime.fromisoformat(body["t"]) if body["t"] else None), body["i"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor is not valid for this list") from e


def timeline_page(rows: DataFrame, cursor: str | None, limit: int | None) -> tuple[list, str | None]:
    """At most ``limit`` rows on the driver, and the next page's cursor."""
    size = limited(limit)
    at = decode_cursor(cursor, "timeline") if cursor else None
    found = keyset_page(rows, "capture_date", "id", at, size).collect()
    page = found[:size]
    return page, encode_cursor("timeline", page[-1]["capture_date"], page[-1]["id"]) if len(found) > size else None
