"""Statistics, duplicates, maps and telemetry over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates, maps, statistics
from .registry import query

_KINDS = "".join(
    f", coalesce(sum(CASE WHEN up AND {cond} THEN 1 ELSE 0 END), 0)::BIGINT AS {n}, coalesce(sum(CASE WHEN up AND {cond} THEN size_bytes ELSE 0 END), 0)::BIGINT AS {n}_bytes"
    for n, cond in (("photos", "file_type = 'PHOTO'"), ("videos", "file_type = 'VIDEO'"), ("audios", "file_type = 'AUDIO'"), ("documents", "file_type IN ('PDF','WORD','EXCEL','POWERPOINT','TEXT')"), ("others", "file_type = 'OTHER'"))
)


@query("q057_library_summary", f"SELECT sum(up::INT)::BIGINT AS total_files, sum(CASE WHEN up THEN size_bytes ELSE 0 END)::BIGINT AS total_bytes, sum((lifecycle_status = 'DELETED')::INT)::BIGINT AS deleted{_KINDS} FROM (SELECT *, lifecycle_status = 'ACTIVE' AS up FROM files)")
def _(t):
    return statistics.library_summary(t.files)


@query("q058_codec_statistics", """
SELECT codec, files, missing, bytes, round(files * 100.0::DOUBLE / sum(files) OVER (), 2) AS percent FROM (
 SELECT upper(trim(codec)) AS codec, count(*) FILTER (lifecycle_status <> 'MISSING') AS files, count(*) FILTER (lifecycle_status = 'MISSING') AS missing, coalesce(sum(size_bytes) FILTER (lifecycle_status <> 'MISSING'), 0)::BIGINT AS bytes
 FROM files JOIN videos ON files.id = videos.file_id WHERE trim(codec) <> '' GROUP BY 1)""")
def _(t):
    return statistics.codec_statistics(t.files, t.videos)


@query("q059_extension_statistics", """
SELECT * FROM (SELECT extension, file_type, files, bytes, round(files * 100.0::DOUBLE / sum(files) OVER (), 2) AS percent FROM (
 SELECT lower(extension) AS extension, file_type, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE lifecycle_status = 'ACTIVE' AND trim(extension) <> '' GROUP BY 1, 2)) ORDER BY files DESC, bytes DESC, extension, file_type LIMIT 5""")
def _(t):
    return statistics.extension_statistics(t.files, 5)


_FOLDERS = """
SELECT * FROM (SELECT folder, files, bytes, photos, videos, documents, round({by} * 100.0::DOUBLE / sum({by}) OVER (), 2) AS percent FROM (
 SELECT folder, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (file_type = 'PHOTO') AS photos, count(*) FILTER (file_type = 'VIDEO') AS videos, count(*) FILTER (file_type IN ('PDF','WORD','EXCEL','POWERPOINT','TEXT')) AS documents
 FROM files LEFT JOIN locations ON files.id = locations.file_id GROUP BY folder)) WHERE trim(folder) <> '' ORDER BY {by} DESC, {second} DESC, folder LIMIT 10"""


@query("q060_folders_by_size", _FOLDERS.format(by="bytes", second="files"))
def _(t):
    return statistics.folder_statistics(t.files, t.locations, 10, "bytes")


@query("q061_folders_by_files", _FOLDERS.format(by="files", second="bytes"))
def _(t):
    return statistics.folder_statistics(t.files, t.locations, 10, "files")


_DATED = "FROM files JOIN metadata ON files.id = metadata.file_id WHERE lifecycle_status = 'ACTIVE' AND file_type IN ('PHOTO', 'VIDEO')"


@query("q063_month_counts", f"SELECT year(capture_date)::INT AS year, month(capture_date)::INT AS month, count(*) AS files {_DATED} AND capture_date IS NOT NULL GROUP BY 1, 2")
def _(t):
    return statistics.month_counts(t.files, t.metadata)


@query("q064_year_rollup", f"SELECT year, sum(files)::BIGINT AS files, string_agg(month || ':' || files, ',' ORDER BY month DESC) AS months FROM (SELECT year(capture_date)::INT AS year, month(capture_date)::INT AS month, count(*) AS files {_DATED} AND capture_date IS NOT NULL GROUP BY 1, 2) GROUP BY year")
def _(t):
    years = statistics.year_rollup(statistics.month_counts(t.files, t.metadata))
    return years.select("year", "files", F.array_join(F.transform("months", lambda m: F.concat(m["month"].cast("string"), F.lit(":"), m["n"].cast("string"))), ",").alias("months"))


@query("q065_dated_summary", f"SELECT count(*) AS total, count(capture_date) AS dated, count(*) - count(capture_date) AS undated {_DATED}")
def _(t):
    return statistics.dated_summary(t.files, t.metadata)


_PIN_ROWS = """
pins AS (SELECT files.*, metadata.* EXCLUDE (file_id), places.* EXCLUDE (file_id) FROM files JOIN metadata ON files.id = metadata.file_id LEFT JOIN places ON places.file_id = files.id WHERE lifecycle_status = 'ACTIVE' AND file_type IN ('PHOTO', 'VIDEO'))"""
_PIN_COUNTS = "count(*) FILTER (file_type = 'PHOTO') AS photos, count(*) FILTER (file_type = 'VIDEO') AS videos, count(*) AS total"
_COVER = "(array_agg(public_id ORDER BY capture_date DESC NULLS LAST, id DESC))[1] AS cover"


def _grid(where: str) -> str:
    return f"SELECT (floor(latitude / 2.8125) + 0.5) * 2.8125 AS lat, (floor(longitude / 2.8125) + 0.5) * 2.8125 AS lon, {_PIN_COUNTS}, max(country_name) AS country_name, max(state_name) AS state_name, max(city_name) AS city_name, bool_or(coalesce(open_sea, false)) AS open_sea, {_COVER} FROM pins WHERE {where} GROUP BY 1, 2"


@query("q066_grid_pins", f"WITH {_PIN_ROWS} {_grid('latitude IS NOT NULL AND longitude IS NOT NULL')}")
def _(t):
    return maps.grid_pins(maps.located(t.files, t.metadata, t.places), maps.cell_for_zoom(5))


@query("q067_grid_pins_in_box", f"WITH {_PIN_ROWS} {_grid('latitude BETWEEN -40 AND 40 AND longitude BETWEEN -90 AND 90')} ORDER BY total DESC, lat, lon LIMIT 20")
def _(t):
    return maps.grid_pins_in_box(maps.located(t.files, t.metadata, t.places), maps.cell_for_zoom(5), -40, -90, 40, 90, 20)


@query("q068_region_pins", f"WITH {_PIN_ROWS} SELECT country_name, state_name, city_name, {_PIN_COUNTS}, {_COVER} FROM pins WHERE latitude IS NULL AND country_name IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return maps.region_pins(maps.located(t.files, t.metadata, t.places))


@query("q069_zoom_cells", "SELECT doc_id, greatest(0.0001::DOUBLE, 90.0::DOUBLE / (2 ** greatest(0, doc_id % 24 - 2))) AS cell FROM documents")
def _(t):
    return t.documents.select("doc_id", maps.cell_of(F.col("doc_id") % 24 - 2).alias("cell"))


@query("q109_all_pins", f"WITH {_PIN_ROWS}, g AS ({_grid('latitude IS NOT NULL AND longitude IS NOT NULL')}) SELECT lat, lon, country_name, state_name, city_name, total, cover FROM g UNION ALL SELECT NULL, NULL, country_name, state_name, city_name, count(*), {_COVER} FROM pins WHERE latitude IS NULL AND country_name IS NOT NULL GROUP BY 3, 4, 5")
def _(t):
    return maps.all_pins(maps.located(t.files, t.metadata, t.places), maps.cell_for_zoom(5))


@query("q103_cell_items", f"WITH {_PIN_ROWS} SELECT id, public_id, capture_date, latitude, longitude FROM pins WHERE latitude >= -45 AND latitude < 0 AND longitude >= -45 AND longitude < 0 ORDER BY capture_date DESC NULLS LAST, id DESC LIMIT 25")
def _(t):
    return maps.cell_items(maps.located(t.files, t.metadata, t.places), -22.5, -22.5, 45.0).select("id", "public_id", "capture_date", "latitude", "longitude").limit(25)


@query("q025_region_items_null_safe", f"WITH {_PIN_ROWS} SELECT id, country_name, state_name, city_name FROM pins WHERE latitude IS NULL AND country_name IS NOT DISTINCT FROM 'KENYA' AND state_name IS NULL AND city_name IS NOT NULL AND city_name IS NOT DISTINCT FROM 'C3'")
def _(t):
    return maps.region_items(maps.located(t.files, t.metadata, t.places), "KENYA", None, "C3").select("id", *maps.REGION)


_KEPT = """
kept AS (SELECT f.*, l.folder FROM files f LEFT JOIN locations l ON l.file_id = f.id WHERE lifecycle_status = 'ACTIVE' AND trim(sha256) <> '' {types}
 AND NOT EXISTS (SELECT 1 FROM file_exclusions x WHERE x.public_id = f.public_id)
 AND NOT EXISTS (SELECT 1 FROM folder_exclusions x WHERE replace(l.folder, '\\', '/') = replace(x.folder, '\\', '/') OR starts_with(replace(l.folder, '\\', '/'), replace(x.folder, '\\', '/') || '/')))"""


@query("q070_duplicate_groups", f"WITH {_KEPT.format(types='')} SELECT sha256, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, (sum(size_bytes) - min(size_bytes))::BIGINT AS wasted FROM kept GROUP BY sha256 HAVING count(*) > 1")
def _(t):
    return duplicates.groups(duplicates.eligible(t.files, t.locations, t.file_exclusions, t.folder_exclusions))


_INNER = _KEPT.format(types="AND folder IS NOT NULL")


@query("q071_duplicate_summary", f"WITH {_INNER} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(w), 0)::BIGINT AS wasted FROM (SELECT count(*) AS n, sum(size_bytes) - min(size_bytes) AS w FROM kept GROUP BY sha256 HAVING count(*) > 1)")
def _(t):
    return duplicates.summary(duplicates.eligible(t.files, t.locations, t.file_exclusions, t.folder_exclusions, need_folder=True))


@query("q161_duplicate_candidates", f"WITH {_KEPT.format(types='')}, g AS (SELECT sha256, sum(size_bytes) - min(size_bytes) AS wasted FROM kept GROUP BY sha256 HAVING count(*) > 1 ORDER BY wasted DESC, sha256 LIMIT 10) SELECT k.sha256, g.wasted::BIGINT AS wasted, k.id, k.folder FROM g JOIN kept k ON k.sha256 = g.sha256")
def _(t):
    return duplicates.candidates(duplicates.eligible(t.files, t.locations, t.file_exclusions, t.folder_exclusions), 0, 10).select("sha256", "wasted", "id", "folder")


@query("q024_folder_exclusion", r"SELECT file_id, folder FROM locations l WHERE NOT EXISTS (SELECT 1 FROM folder_exclusions x WHERE replace(l.folder, '\', '/') = replace(x.folder, '\', '/') OR starts_with(replace(l.folder, '\', '/'), replace(x.folder, '\', '/') || '/'))")
def _(t):
    from ..functions import predicates

    return predicates.without_excluded_folders(t.locations.select("file_id", "folder"), t.folder_exclusions, "folder", "folder")


@query("q072_errors_by_type", "SELECT error_type, count(*) AS n FROM errors GROUP BY error_type")
def _(t):
    return statistics.counts_by(t.errors, "error_type")


@query("q073_distinct_files_by_error", "SELECT error_type, count(DISTINCT path) AS files FROM errors GROUP BY error_type")
def _(t):
    return statistics.distinct_files_by_error(t.errors)


@query("q074_error_details", "SELECT path, error_type, count(*) AS n, min(happened_at) AS first_at, max(happened_at) AS last_at FROM errors WHERE lower(path) LIKE '%u1%' GROUP BY 1, 2 ORDER BY n DESC, path, error_type NULLS LAST LIMIT 10 OFFSET 5")
def _(t):
    return statistics.error_details(t.errors, "U1", 5, 10)


@query("q075_errors_by_execution", "SELECT execution_id, error_type, count(*) AS n FROM errors GROUP BY 1, 2")
def _(t):
    return statistics.counts_by(t.errors, "execution_id", "error_type")


@query("q076_movement_summary", "SELECT execution_id, status, reason, count(*) AS n FROM movements GROUP BY 1, 2, 3")
def _(t):
    return statistics.counts_by(t.movements, "execution_id", "status", "reason")


_BELOW = "FROM files JOIN locations ON files.id = locations.file_id WHERE lifecycle_status = 'ACTIVE' AND (lower(folder) = 'd:/media/src3' OR starts_with(lower(folder), 'd:/media/src3/'))"


@query("q077_folder_summary", f"SELECT count(*) AS files, count(DISTINCT folder) AS folders, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, greatest(count(DISTINCT folder) - 1, 0) AS subfolders {_BELOW}")
def _(t):
    return statistics.folder_summary(t.files, t.locations, "D:\\Media\\SRC3")


@query("q078_folder_signature", f"SELECT count(*) AS files, max(updated_at) AS newest {_BELOW}")
def _(t):
    return statistics.folder_signature(t.files, t.locations, "D:/Media/src3")


@query("q082_phase_pivot", "SELECT phase, coalesce(sum(millis) FILTER (execution_id = 1), 0)::BIGINT AS e1, coalesce(sum(millis) FILTER (execution_id = 2), 0)::BIGINT AS e2, coalesce(sum(millis) FILTER (execution_id = 3), 0)::BIGINT AS e3, greatest(e1, e2, e3) AS largest FROM phases WHERE execution_id IN (1, 2, 3) GROUP BY phase")
def _(t):
    return statistics.phase_pivot(t.phases, [1, 2, 3])


_METRICS = "metrics AS (SELECT execution_id, sum(millis)::BIGINT AS millis FROM phases WHERE execution_id % 5 <> 0 GROUP BY 1)"


def _metrics(t):
    return t.phases.filter("execution_id % 5 <> 0").groupBy("execution_id").agg(F.sum("millis").alias("millis"))


@query("q083_throughput", f"WITH {_METRICS} SELECT id, round(CASE WHEN millis > 0 THEN greatest(files_found, files_moved) * 1000.0::DOUBLE / millis ELSE 0 END, 6) AS files_per_second FROM executions JOIN metrics ON id = execution_id")
def _(t):
    return statistics.telemetry(t.executions, _metrics(t)).select("id", F.round(statistics.throughput(F.col("files_found"), F.col("files_moved"), F.col("millis")), 6).alias("files_per_second"))


@query("q183_telemetry_list", f"WITH {_METRICS} SELECT id, type, millis, version FROM executions LEFT JOIN metrics ON id = execution_id WHERE version = '1.3' ORDER BY started_at DESC, id DESC LIMIT 50")
def _(t):
    rows = statistics.telemetry(t.executions.filter("version = '1.3'"), _metrics(t), keep_unmeasured=True)
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(50).select("id", "type", "millis", "version")


@query("q095_latest_by_type", "SELECT type, max(id) FILTER (rk = 1) AS id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY started_at DESC, id DESC) AS rk FROM executions) GROUP BY type")
def _(t):
    return t.executions.groupBy("type").agg(F.max_by("id", F.struct("started_at", "id")).alias("id"))


@query("q094_keep_latest", "SELECT id, type FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS k FROM executions WHERE status = 'FINISHED') WHERE k > 200")
def _(t):
    from ..operators import mutations

    return mutations.beyond_latest(t.executions.filter("status = 'FINISHED'"), 200, ["started_at", "id"]).select("id", "type")


@query("q088_canonical_digest", "SELECT c_nationkey, sha256(string_agg(octet_length(encode(c_name)) || ':' || c_name || octet_length(encode(c_mktsegment)) || ':' || c_mktsegment, '' ORDER BY octet_length(encode(c_name)) || ':' || c_name || octet_length(encode(c_mktsegment)) || ':' || c_mktsegment)) AS digest FROM customer GROUP BY c_nationkey")
def _(t):
    return statistics.canonical_digest(t.customer, "c_nationkey", "c_name", "c_mktsegment").withColumnRenamed("group", "c_nationkey")


@query("q086_trimmed_mean", """
SELECT l_orderkey, CAST(floor(avg(s) + 0.5) AS INT) AS score FROM (SELECT l_orderkey, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
WHERE k > least(1, n - 1) GROUP BY l_orderkey""")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("s")).select("l_orderkey", statistics.trimmed_mean(F.col("s"), 1).alias("score"))


@query("q114_distinct_versions", "SELECT DISTINCT version FROM executions")
def _(t):
    return t.executions.select("version").distinct()


@query("q105_latest_executions", "SELECT id, started_at FROM executions ORDER BY started_at DESC, id DESC LIMIT 20")
def _(t):
    return t.executions.orderBy(F.desc("started_at"), F.desc("id")).limit(20).select("id", "started_at")
