"""Filters, joins, pages, look-ups and set operations over the stand-ins."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import mutations, paging, search
from .registry import query

_ROWS = """
media AS (SELECT files.*, locations.folder, locations.path, m.* EXCLUDE (file_id), v.codec, v.duration, g.* EXCLUDE (file_id) FROM files LEFT JOIN locations ON locations.file_id = files.id LEFT JOIN metadata m ON m.file_id = files.id
 LEFT JOIN videos v ON v.file_id = files.id LEFT JOIN places g ON g.file_id = files.id WHERE lifecycle_status = 'ACTIVE')"""


def _media(t):
    return search.media_rows(t.files, t.locations, t.metadata, t.videos, t.places)


def _found(name: str, where: str, f: search.Filters) -> None:
    query(name, f"WITH {_ROWS} SELECT id, file_type, folder, capture_date FROM media WHERE {where}")(lambda t: search.search(_media(t), f).select("id", "file_type", "folder", "capture_date"))


_found("q019_search_no_filter", "true", search.Filters())
_found("q019_search_all_filters", "file_type = 'PHOTO' AND lower(extension) = 'jpg' AND contains(lower(folder), 'src') AND category = 'MEDIA' AND lower(manufacturer) LIKE 'can%' AND size_bytes >= 100 AND size_bytes <= 5000", search.Filters(file_type="PHOTO", extension="Jpg", folder_part="SRC", category="MEDIA", manufacturer="Can", least_bytes=100, most_bytes=5000))
_found("q021_prefix_ci", "lower(manufacturer) LIKE 'n_k%'", search.Filters(manufacturer="N_k"))
_found("q022_contains_ci", "contains(lower(folder), 'sub_a')", search.Filters(folder_part="SUB_A"))
_found("q026_codec_filter", "upper(trim(codec)) = 'H264'", search.Filters(codec="h264 "))
_found("q027_longest_side", "greatest(coalesce(width, 0), coalesce(height, 0)) >= 3000", search.Filters(longest_side=3000))
_found("q028_geo_with", "country_name IS NOT NULL", search.Filters(geo="WITH"))
_found("q028_geo_without", "country_name IS NULL", search.Filters(geo="WITHOUT"))
_found("q029_day_window", "capture_date >= TIMESTAMP '2020-06-01' AND capture_date < TIMESTAMP '2021-03-02'", search.Filters(first_day=date(2020, 6, 1), last_day=date(2021, 3, 1)))
_found("q133_year_month", "year(capture_date) = 2020 AND month(capture_date) = 5", search.Filters(year=2020, month=5))


@query("q020_lifecycle", "SELECT id FROM files WHERE lifecycle_status = 'ACTIVE'")
def _(t):
    return t.files.filter(p.active(F.col("lifecycle_status"))).select("id")


@query("q023_descendants", "SELECT file_id, path FROM locations WHERE starts_with(lower(path), 'd:/media/src1/')")
def _(t):
    return t.locations.filter(p.under(F.col("path"), "D:\\Media\\src1")).select("file_id", "path")


@query("q026_box_closed", "SELECT file_id FROM metadata WHERE latitude BETWEEN -10 AND 10 AND longitude BETWEEN -50.5 AND 50.5")
def _(t):
    return t.metadata.filter(p.in_box(F.col("latitude"), F.col("longitude"), -10.0, -50.5, 10.0, 50.5)).select("file_id")


@query("q026_box_half_open", "SELECT file_id FROM metadata WHERE latitude >= -10 AND latitude < 10 AND longitude >= -50.5 AND longitude < 50.5")
def _(t):
    return t.metadata.filter(p.in_box(F.col("latitude"), F.col("longitude"), -10.0, -50.5, 10.0, 50.5, closed=False)).select("file_id")


_STALE = "SELECT id FROM files LEFT JOIN metadata ON id = file_id WHERE lifecycle_status = 'ACTIVE' AND (rebuilt_at IS NULL OR rebuilt_at < TIMESTAMP '2020-04-01')"


@query("q030_tri_state", _STALE + " AND capture_date IS NULL")
def _(t):
    return search.stale_metadata(t.files, t.metadata, F.lit(datetime(2020, 4, 1)).cast("timestamp_ntz"), None, False)


@query("q031_stale_or_never", _STALE)
def _(t):
    return search.stale_metadata(t.files, t.metadata, F.lit(datetime(2020, 4, 1)).cast("timestamp_ntz"), None, None)


@query("q032_membership", "SELECT id, file_name FROM files WHERE id IN (SELECT file_id FROM videos)")
def _(t):
    return p.member(t.files, t.videos, "id", "file_id").select("id", "file_name")


@query("q033_conversion_candidates", "SELECT id, codec FROM files LEFT JOIN videos ON id = file_id WHERE lifecycle_status = 'ACTIVE' AND file_type = 'VIDEO' AND (lower(extension) IS DISTINCT FROM 'mp4' OR codec IS NULL OR upper(trim(codec)) NOT IN ('HEVC', 'H265', 'AV1'))")
def _(t):
    return search.conversion_candidates(t.files, t.videos).select("id", "codec")


@query("q034_functional_history", "SELECT id FROM executions WHERE NOT coalesce(type = 'RECONCILE' AND trigger_event = 'TIMER' AND status = 'FINISHED' AND coalesce(repaired_items, 0) = 0, false)")
def _(t):
    return t.executions.filter(p.functional_history(F.col("type"), F.col("trigger_event"), F.col("status"), F.col("repaired_items"))).select("id")


@query("q036_prefix_rewrite", "SELECT file_id, CASE WHEN starts_with(lower(path), 'd:/media/src2/') THEN 'E:/New' || substr(path, 14) ELSE path END AS path FROM locations")
def _(t):
    return t.locations.select("file_id", p.moved_path(F.col("path"), "D:/media/SRC2", "E:/New").alias("path"))


@query("q037_inner_satellite", "SELECT id, capture_date FROM files JOIN metadata ON id = file_id")
def _(t):
    return t.files.join(t.metadata, F.col("id") == F.col("file_id")).select("id", "capture_date")


@query("q038_left_satellites", f"WITH {_ROWS} SELECT id, codec, country_name, path FROM media")
def _(t):
    return _media(t).select("id", "codec", "country_name", "path")


@query("q039_anti_equi", "SELECT id FROM files WHERE NOT EXISTS (SELECT 1 FROM metadata WHERE file_id = id)")
def _(t):
    m = t.metadata
    return t.files.join(m, F.col("id") == m["file_id"], "left_anti").select("id")


@query("q041_semi", "SELECT id FROM files WHERE EXISTS (SELECT 1 FROM places WHERE file_id = id)")
def _(t):
    return p.member(t.files, t.places, "id", "file_id").select("id")


@query("q042_anti_array", "SELECT unnest([1, 2, 3, 5, 8, 13, 21, 34, 999999999]) AS id EXCEPT SELECT file_id FROM metadata")
def _(t):
    ids = t.spark.sql("SELECT explode(array(1L, 2L, 3L, 5L, 8L, 13L, 21L, 34L, 999999999L)) AS id")
    m = t.metadata
    return ids.join(m, ids["id"] == m["file_id"], "left_anti").select("id")


@query("q043_lateral_latest", "SELECT id, path FROM files LEFT JOIN LATERAL (SELECT path FROM locations WHERE file_id = id ORDER BY path DESC LIMIT 1) ON true")
def _(t):
    return search.latest_location(t.files, t.locations).select("id", "path")


@query("q044_exclusion_view", "SELECT f.id, f.public_id, f.file_name FROM files f, file_exclusions x WHERE x.public_id = f.public_id")
def _(t):
    return t.files.join(t.file_exclusions, "public_id").select("id", "public_id", "file_name")


@query("q045_update_from_arrays", "SELECT o.id, coalesce(u.v, o.claim_count)::INT AS claim_count FROM executions o LEFT JOIN (SELECT unnest([1, 2, 3]) AS k, unnest([10, 20, 30]) AS v) u ON u.k = o.id")
def _(t):
    pairs = t.spark.sql("SELECT p.k, p.v FROM (SELECT explode(arrays_zip(k, v)) AS p FROM (SELECT array(1L, 2L, 3L) AS k, array(10, 20, 30) AS v))")
    return t.executions.join(F.broadcast(pairs), F.col("id") == F.col("k"), "left").select("id", F.coalesce("v", "claim_count").alias("claim_count"))


_DATED = "FROM files JOIN metadata ON id = file_id WHERE lifecycle_status = 'ACTIVE' AND file_type IN ('PHOTO', 'VIDEO')"


def _dated(t):
    return t.files.filter("lifecycle_status = 'ACTIVE' AND file_type IN ('PHOTO', 'VIDEO')").join(t.metadata, F.col("id") == F.col("file_id"))


@query("q096_keyset_page", f"SELECT id, capture_date {_DATED} AND (capture_date < TIMESTAMP '2021-06-01' OR (capture_date = TIMESTAMP '2021-06-01' AND id < 500)) ORDER BY capture_date DESC, id DESC LIMIT 31")
def _(t):
    return paging.keyset_page(_dated(t), "capture_date", "id", (datetime(2021, 6, 1), 500), 30).select("id", "capture_date")


@query("q097_jump_to_day", f"SELECT id, capture_date {_DATED} AND capture_date < TIMESTAMP '2021-02-04' ORDER BY capture_date DESC, id DESC LIMIT 11")
def _(t):
    return paging.keyset_page(_dated(t), "capture_date", "id", paging.jump_cursor(date(2021, 2, 3)), 10).select("id", "capture_date")


@query("q098_undated_page", f"SELECT id {_DATED} AND capture_date IS NULL AND id < 700 ORDER BY id DESC LIMIT 21")
def _(t):
    return paging.undated_page(_dated(t), "capture_date", "id", 700, 20).select("id")


@query("q099_batch_after", "SELECT id FROM files WHERE id > 100 ORDER BY id LIMIT 100")
def _(t):
    return paging.batch_after(t.files, "id", 100, 100).select("id")


@query("q101_offset_page", "SELECT id, size_bytes FROM files ORDER BY size_bytes DESC, id LIMIT 40 OFFSET 80")
def _(t):
    return paging.offset_page(t.files, [F.desc("size_bytes"), F.asc("id")], 2, 40).select("id", "size_bytes")


@query("q108_group_by_day", f"WITH page AS (SELECT id, capture_date {_DATED} AND capture_date IS NOT NULL ORDER BY capture_date DESC, id DESC LIMIT 61) SELECT strftime(capture_date, '%Y-%m-%d') AS day, string_agg(id, ',' ORDER BY capture_date DESC, id DESC) AS ids FROM page GROUP BY 1")
def _(t):
    days = paging.by_day(paging.keyset_page(_dated(t), "capture_date", "id", None, 60), "capture_date", "id")
    return days.select(F.col("day").cast("string").alias("day"), F.array_join(F.transform("items", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("q104_explorer_order", "SELECT row_number() OVER (ORDER BY is_folder DESC, lower(name), missing, name) AS k, name FROM (SELECT DISTINCT folder AS name, true AS is_folder, false AS missing FROM locations UNION ALL SELECT file_name, false, lifecycle_status = 'MISSING' FROM files) ORDER BY k LIMIT 50")
def _(t):
    folders = t.locations.select(F.col("folder").alias("name"), F.lit(True).alias("is_folder"), F.lit(False).alias("missing")).distinct()
    files = t.files.select(F.col("file_name").alias("name"), F.lit(False).alias("is_folder"), (F.col("lifecycle_status") == "MISSING").alias("missing"))
    page = search.explorer(folders.unionByName(files).withColumn("modified_at", F.lit(None).cast("timestamp_ntz"))).limit(50).select("name")
    return mutations.with_ids(page.withColumn("__o", F.monotonically_increasing_id()), [F.col("__o")], 1, "k").select("k", "name")


@query("q107_plan_order_nulls_last", "SELECT id, row_number() OVER (ORDER BY strftime(capture_date, '%Y-%m') NULLS LAST, day(capture_date) NULLS LAST, subcategory NULLS LAST, file_name, id) AS k FROM files JOIN metadata ON id = file_id ORDER BY k LIMIT 100")
def _(t):
    ordered = t.files.join(t.metadata, F.col("id") == F.col("file_id")).orderBy(F.asc_nulls_last(F.date_format("capture_date", "yyyy-MM")), F.asc_nulls_last(F.dayofmonth("capture_date")), F.asc_nulls_last("subcategory"), "file_name", "id").limit(100).select("id")
    return mutations.with_ids(ordered.withColumn("__o", F.monotonically_increasing_id()), [F.col("__o")], 1, "k").select("id", "k")


@query("q110_disk_minus_catalogue", "SELECT concat('D:/Media/', source, '/f', CAST(doc_id AS STRING), '.jpg') AS path FROM documents EXCEPT SELECT path FROM locations")
def _(t):
    disk = t.documents.select(F.concat(F.lit("D:/Media/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return disk.join(t.locations, "path", "left_anti").distinct()


@query("q111_newcomers", "SELECT id FROM files WHERE file_type = 'PHOTO' AND NOT EXISTS (SELECT 1 FROM metadata WHERE file_id = id)")
def _(t):
    m = t.metadata
    return t.files.filter("file_type = 'PHOTO'").join(m, F.col("id") == m["file_id"], "left_anti").select("id")


@query("q112_merged_ids", "SELECT file_id FROM metadata UNION SELECT file_id FROM places")
def _(t):
    return t.metadata.select("file_id").union(t.places.select("file_id")).distinct()


@query("q113_distinct_repaired", "SELECT count(*) AS n FROM (SELECT file_id FROM metadata UNION SELECT file_id FROM places UNION SELECT file_id FROM videos)")
def _(t):
    return t.metadata.select("file_id").union(t.places.select("file_id")).union(t.videos.select("file_id")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("q079_eligible_ids", "SELECT DISTINCT f.id FROM files f JOIN locations l ON l.file_id = f.id WHERE lifecycle_status = 'ACTIVE' AND NOT EXISTS (SELECT 1 FROM file_exclusions x WHERE x.public_id = f.public_id) AND NOT EXISTS (SELECT 1 FROM folder_exclusions x WHERE replace(l.folder, '\\', '/') = replace(x.folder, '\\', '/') OR starts_with(replace(l.folder, '\\', '/'), replace(x.folder, '\\', '/') || '/'))")
def _(t):
    from ..operators import duplicates

    return duplicates.eligible(t.files, t.locations, t.file_exclusions, t.folder_exclusions, need_folder=True).select("id").distinct()


@query("q080_fingerprinted_count", "SELECT count(DISTINCT file_id) AS n FROM prints")
def _(t):
    return t.prints.agg(F.countDistinct("file_id").alias("n"))


_FAILED = "failed AS (SELECT id AS file_id, CAST(id % 5 AS INT) AS attempts FROM files WHERE id % 3 = 0)"


def _failed(t):
    return t.files.filter("id % 3 = 0").select(F.col("id").alias("file_id"), (F.col("id") % 5).cast("int").alias("attempts"))


@query("q081_pending_photos", f"WITH {_FAILED} SELECT id FROM files WHERE lifecycle_status = 'ACTIVE' AND file_type = 'PHOTO' AND id NOT IN (SELECT file_id FROM prints) AND id NOT IN (SELECT file_id FROM failed WHERE attempts >= 3)")
def _(t):
    return search.pending(t.files, t.prints, _failed(t), "PHOTO", 3).select("id")


@query("q207_exhausted_with_path", f"WITH {_FAILED} SELECT failed.file_id, path, attempts FROM failed JOIN locations USING (file_id) WHERE attempts >= 3")
def _(t):
    return _failed(t).filter("attempts >= 3").join(t.locations, "file_id").select("file_id", "path", "attempts")


@query("q203_of_folder", "SELECT id, file_name FROM files JOIN locations ON id = file_id WHERE lifecycle_status = 'ACTIVE' AND lower(folder) = 'd:/media/src4' ORDER BY file_name, id")
def _(t):
    return search.of_folder(t.files, t.locations, "D:/MEDIA/src4").select("id", "file_name")


@query("q200_media_details", "SELECT f.id, m.capture_date, v.codec, l.path FROM files f JOIN metadata m ON m.file_id = f.id LEFT JOIN videos v ON v.file_id = f.id LEFT JOIN locations l ON l.file_id = f.id WHERE lifecycle_status IN ('ACTIVE', 'DELETED') AND file_type IN ('PHOTO', 'VIDEO')")
def _(t):
    rows = t.files.filter("lifecycle_status IN ('ACTIVE', 'DELETED') AND file_type IN ('PHOTO', 'VIDEO')")
    own = lambda d, *c: d.select(F.col("file_id").alias("id"), *c)
    return rows.join(own(t.metadata, "capture_date"), "id").join(own(t.videos, "codec"), "id", "left").join(own(t.locations, "path"), "id", "left").select("id", "capture_date", "codec", "path")


@query("q202_thumbnail_sources", "SELECT id, path FROM files JOIN locations ON id = file_id WHERE file_type = 'VIDEO'")
def _(t):
    return t.files.filter("file_type = 'VIDEO'").join(t.locations, F.col("id") == F.col("file_id")).select("id", "path")


@query("q205_by_keys", "SELECT f.id, f.public_id, l.path FROM files f LEFT JOIN locations l ON l.file_id = f.id WHERE f.public_id IN (SELECT public_id FROM file_exclusions)")
def _(t):
    rows = p.member(t.files, t.file_exclusions, "public_id", "public_id")
    return rows.join(t.locations, F.col("id") == F.col("file_id"), "left").select("id", "public_id", "path")


@query("q206_any_old_missing", "SELECT count(*) > 0 AS found FROM files WHERE lifecycle_status = 'MISSING' AND lifecycle_changed_at < TIMESTAMP '2020-03-01'")
def _(t):
    old = t.files.filter((F.col("lifecycle_status") == "MISSING") & (F.col("lifecycle_changed_at") < F.lit(datetime(2020, 3, 1)).cast("timestamp_ntz")))
    return old.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("q201_content_source", "SELECT id, max(path) AS path FROM files JOIN locations ON id = file_id GROUP BY id")
def _(t):
    return search.latest_location(t.files, t.locations).filter("path IS NOT NULL").select("id", "path")


@query("q209_composition_rows", "SELECT p.file_id, p.w0, f.size_bytes FROM prints p JOIN files f ON f.id = p.file_id WHERE f.lifecycle_status = 'ACTIVE'")
def _(t):
    return t.prints.join(t.files.filter("lifecycle_status = 'ACTIVE'"), F.col("file_id") == F.col("id")).select("file_id", "w0", "size_bytes")


@query("q210_member_files", "SELECT f.id, l.path, m.width FROM files f LEFT JOIN locations l ON l.file_id = f.id LEFT JOIN metadata m ON m.file_id = f.id WHERE f.id IN (SELECT file_id FROM prints)")
def _(t):
    rows = p.member(t.files, t.prints, "id", "file_id")
    own = lambda d, c: d.select(F.col("file_id").alias("id"), c)
    return rows.join(own(t.locations, "path"), "id", "left").join(own(t.metadata, "width"), "id", "left").select("id", "path", "width")


@query("q211_fingerprint_delete", "SELECT file_id, w0 FROM prints WHERE file_id NOT IN (SELECT id FROM files WHERE lifecycle_status = 'DELETED')")
def _(t):
    gone = t.files.filter("lifecycle_status = 'DELETED'")
    prints = t.prints
    return prints.join(gone, prints["file_id"] == gone["id"], "left_anti").select("file_id", "w0")


@query("q214_places_by_ids", "SELECT p.file_id, m.latitude, m.longitude FROM places p JOIN metadata m USING (file_id) WHERE NOT p.manual AND m.latitude IS NOT NULL")
def _(t):
    return t.places.filter("NOT manual").join(t.metadata, "file_id").filter("latitude IS NOT NULL").select("file_id", "latitude", "longitude")


@query("q228_exclusion_lists", "SELECT 'file' AS kind, public_id AS name FROM file_exclusions UNION ALL SELECT 'folder', folder FROM folder_exclusions")
def _(t):
    return t.file_exclusions.select(F.lit("file").alias("kind"), F.col("public_id").alias("name")).union(t.folder_exclusions.select(F.lit("folder"), "folder"))


@query("q224_executions_by_status", "SELECT id, row_number() OVER (ORDER BY started_at DESC, id DESC) AS k FROM executions WHERE status = 'RUNNING'")
def _(t):
    return mutations.with_ids(t.executions.filter("status = 'RUNNING'").select("id", "started_at"), [F.desc("started_at"), F.desc("id")], 1, "k").select("id", "k")


@query("q225_activity_order", "SELECT id, row_number() OVER (ORDER BY (status = 'RUNNING') DESC, priority DESC NULLS LAST, started_at NULLS LAST, id) AS k FROM executions WHERE status <> 'FINISHED'")
def _(t):
    rows = t.executions.filter("status <> 'FINISHED'").select("id", "status", "priority", "started_at")
    return mutations.with_ids(rows, [F.desc(F.col("status") == "RUNNING"), F.desc_nulls_last("priority"), F.asc_nulls_last("started_at"), F.asc("id")], 1, "k").select("id", "k")


@query("q226_live_workers", "SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) - INTERVAL 6 HOUR FROM events)")
def _(t):
    seen = t.events.groupBy("user_id").agg(F.max("ts").alias("seen"))
    last = seen.agg(F.max("seen").alias("last"))
    return seen.crossJoin(F.broadcast(last)).filter(F.col("seen") > F.col("last") - F.expr("INTERVAL 6 HOURS")).select("user_id", "seen")


@query("q227_phases_by_execution", "SELECT execution_id, phase, sum(millis)::BIGINT AS millis, sum(items)::BIGINT AS items FROM phases GROUP BY 1, 2")
def _(t):
    return t.phases.groupBy("execution_id", "phase").agg(F.sum("millis").alias("millis"), F.sum("items").alias("items"))


@query("q229_move_touches_exclusion", "SELECT folder, (starts_with('D:/Media/src1/x/', replace(folder, '\\', '/') || '/') OR starts_with(replace(folder, '\\', '/') || '/', 'D:/Media/src1/x/')) AS touched FROM folder_exclusions")
def _(t):
    own = F.concat(p.plain(F.col("folder")), F.lit("/"))
    target = F.lit("D:/Media/src1/x/")
    return t.folder_exclusions.select("folder", (F.startswith(target, own) | F.startswith(own, target)).alias("touched"))
