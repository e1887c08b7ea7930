"""Similarity, geocoding, plans, reconciliation, mutations, queue, exports and change streams over the stand-ins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import names
from ..operators import duplicates, geo, mutations, planning, queue, reconcile, similarity
from ..sources import exports
from ..sources.tables import new_path, written
from ..streaming import changes, journal, state
from .registry import query

_D = "(bit_count(xor(a.w0, b.w0))::INT + bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)))"


@query("q046_radius_pairs", f"SELECT a.file_id AS a, b.file_id AS b, {_D} AS distance FROM wide_prints a JOIN wide_prints b ON a.file_id < b.file_id AND {_D} <= 96")
def _(t):
    return similarity.radius_pairs(t.wide_prints, similarity.RADIUS)


@query("q047_arrival_pairs", f"SELECT least(a.file_id, b.file_id) AS a, greatest(a.file_id, b.file_id) AS b, {_D} AS distance FROM wide_prints a JOIN wide_prints b ON a.file_id % 10 = 0 AND (b.file_id % 10 <> 0 OR a.file_id < b.file_id) AND {_D} <= 96")
def _(t):
    return similarity.arrival_pairs(t.wide_prints.filter("file_id % 10 = 0"), t.wide_prints.filter("file_id % 10 <> 0"), similarity.RADIUS)


@query("q048_band_pairs", """
SELECT a.file_id AS a, b.file_id AS b FROM videos a JOIN videos b ON a.file_id < b.file_id AND (a.duration IS NULL) = (b.duration IS NULL) AND coalesce(abs(a.duration - b.duration) <= 3, true)
 AND abs(a.width / a.height::DOUBLE - b.width / b.height::DOUBLE) / greatest(a.width / a.height::DOUBLE, b.width / b.height::DOUBLE) <= 0.12""")
def _(t):
    return similarity.band_pairs(t.videos)


_EDGES = f"edges AS (SELECT a.file_id AS a, b.file_id AS b, 100 - {_D} AS score FROM prints a JOIN prints b ON a.file_id < b.file_id AND {_D} <= 21)"


def _edges(t):
    return similarity.radius_pairs(t.prints, 21).select("a", "b", (F.lit(100) - F.col("distance")).alias("score"))


@query("q153_components", f"""
WITH RECURSIVE {_EDGES}, two AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges), reach(u, v) AS (SELECT u, u FROM two UNION SELECT r.u, b.v FROM reach r JOIN two b ON b.u = r.v)
SELECT u AS node, min(v) AS root FROM reach GROUP BY u""")
def _(t):
    return similarity.components(_edges(t))


#: The greedy rule of complete linkage, file by file, as a recursion over the list of clusters.
_GREEDY = """pairs AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), near AS (SELECT a AS i, list(b) AS ns, row_number() OVER (ORDER BY a) AS k FROM pairs GROUP BY a),
 walk(k, cs) AS (SELECT 0::BIGINT, []::BIGINT[][] UNION ALL SELECT w.k + 1, CASE WHEN p IS NULL THEN list_append(cs, [i]) ELSE list_transform(cs, lambda c, n: CASE WHEN n = p THEN list_append(c, i) ELSE c END) END
  FROM (SELECT w.k, w.cs, n.i, list_position(list_transform(w.cs, lambda c: list_has_all(n.ns, c)), true) AS p FROM walk w JOIN near n ON n.k = w.k + 1) w),
 clusters AS (SELECT c[1] AS cluster, unnest(c) AS file_id, unnest(range(len(c)))::INT AS position FROM (SELECT unnest(cs) AS c FROM (SELECT cs FROM walk ORDER BY k DESC LIMIT 1)) WHERE len(c) > 1)"""


@query("q153_greedy_clusters", f"WITH RECURSIVE {_EDGES}, {_GREEDY.format(edges='edges')} SELECT cluster, file_id, position FROM clusters")
def _(t):
    return similarity.linked_clusters(t.prints, 21)


@query("q087_worst_score", f"WITH RECURSIVE {_EDGES}, {_GREEDY.format(edges='edges')} SELECT x.cluster, least(min(score), 100)::INT AS worst FROM edges JOIN clusters x ON x.file_id = a JOIN clusters y ON y.file_id = b AND y.cluster = x.cluster GROUP BY x.cluster")
def _(t):
    members = written(similarity.linked_clusters(t.prints, 21), "members")
    inside = similarity.pairs_within(t.prints, members, "cluster").select("a", "b", (F.lit(100) - F.col("distance")).alias("score"))
    return similarity.worst_score(members, inside)


@query("q154_edges_among_eligible", f"WITH {_EDGES} SELECT a, b, score FROM edges WHERE a % 3 <> 0 AND b % 3 <> 0")
def _(t):
    return similarity.among(_edges(t), t.prints.filter("file_id % 3 <> 0"))


@query("q156_forget", f"WITH {_EDGES} SELECT a, b, score FROM edges WHERE a % 4 <> 0 AND b % 4 <> 0")
def _(t):
    return similarity.forget(_edges(t), t.prints.select("file_id"), t.prints.filter("file_id % 4 = 0"))[0]


@query("q162_covered", "SELECT file_id FROM prints WHERE file_id % 4 <> 0")
def _(t):
    empty = t.spark.createDataFrame([], "a long, b long, score int")
    return similarity.forget(empty, t.prints.select("file_id"), t.prints.filter("file_id % 4 = 0"))[1]


_POLICY = """
policy AS (SELECT sha256 AS grp, id AS file_id, coalesce(manufacturer = 'Canon', false) AS has_camera, subcategory, width, height, date_source, capture_date, size_bytes FROM files LEFT JOIN metadata m ON m.file_id = id),
policy2 AS (SELECT *, (has_camera OR coalesce(date_source IN ('EXIF', 'MEDIA_INFO'), false)) AND coalesce(subcategory NOT IN ('WHATSAPP', 'AIRBRUSH', 'PHOTOGRID', 'SCREENSHOT'), true) AS original, coalesce(subcategory IN ('WHATSAPP', 'AIRBRUSH', 'PHOTOGRID', 'SCREENSHOT'), false) AS copy,
 CASE WHEN date_source = 'EXIF' THEN 5 WHEN date_source = 'FILE_NAME' AND capture_date <> date_trunc('day', capture_date) THEN 4 WHEN date_source = 'FILE_NAME' THEN 3 WHEN date_source = 'FILE_CREATED_AT' THEN 1 ELSE 0 END AS trust FROM policy),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY original DESC, copy, coalesce(width::BIGINT * height, 0) DESC, trust DESC, capture_date NULLS LAST, file_id) AS place, sum(original::INT) OVER (PARTITION BY {g}) AS originals FROM policy2)"""


def _policy(t):
    return t.files.join(t.metadata, F.col("id") == F.col("file_id"), "left").select(F.col("sha256").alias("grp"), F.col("id").alias("file_id"), F.coalesce(F.col("manufacturer") == "Canon", F.lit(False)).alias("has_camera"), "subcategory", "width", "height", "date_source", "capture_date", "size_bytes")


@query("q090_keep_policy_exact", f"WITH {_POLICY.format(g='grp')} SELECT grp, file_id, CASE WHEN place = 1 THEN 'KEEP' ELSE 'DELETE_CANDIDATE' END AS verdict FROM ranked")
def _(t):
    return duplicates.keep_ranking(_policy(t), "grp", exact=True).select("grp", "file_id", "verdict")


@query("q160_keep_policy_similar", f"WITH {_POLICY.format(g='file_id % 100')} SELECT file_id, CASE WHEN place = 1 THEN 'KEEP' WHEN originals = 1 THEN 'DELETE_CANDIDATE' ELSE 'REVIEW' END AS verdict, CASE WHEN place = 1 AND original THEN 'ORIGINAL' WHEN originals <> 1 THEN 'REVIEW_NO_CLEAR_ORIGINAL' WHEN place = 1 THEN 'BEST_IN_GROUP' WHEN subcategory = 'WHATSAPP' THEN 'WHATSAPP_COPY' WHEN subcategory = 'AIRBRUSH' THEN 'EDITED_COPY' ELSE 'DERIVATIVE' END AS reason FROM ranked")
def _(t):
    rows = _policy(t).withColumn("grp", F.col("file_id") % 100)
    return duplicates.keep_ranking(rows, "grp", exact=False).select("file_id", "verdict", "reason")


_BY_CLUSTER = _POLICY.format(g="cluster").replace("FROM policy2)", "FROM policy2 JOIN clusters USING (file_id))")


@query("q150_ranked_groups", f"WITH RECURSIVE {_EDGES}, {_GREEDY.format(edges='edges')}, {_BY_CLUSTER} SELECT row_number() OVER (ORDER BY wasted DESC, cluster) AS place, cluster, files, wasted FROM (SELECT cluster, count(*) AS files, coalesce(sum(size_bytes) FILTER (place > 1 AND originals = 1), 0)::BIGINT AS wasted FROM ranked GROUP BY cluster)")
def _(t):
    members = written(similarity.linked_clusters(t.prints, 21), "members")
    verdicts = duplicates.keep_ranking(_policy(t).drop("grp").join(members.select("file_id", "cluster"), "file_id"), "cluster", exact=False)
    return similarity.ranked_groups(members, verdicts)


@query("q160_wasted", f"WITH {_POLICY.format(g='grp')} SELECT grp, coalesce(sum(size_bytes) FILTER (place > 1), 0)::BIGINT AS wasted FROM ranked GROUP BY grp")
def _(t):
    return duplicates.wasted_bytes(duplicates.keep_ranking(_policy(t), "grp", exact=True), "grp")


# geography ------------------------------------------------------------------------------------------------------------

_BOXES = [(1, "COUNTRY", "North", "NN", None, 0.0, -175.0, 80.0, 0.0), (2, "COUNTRY", "South", "SS", None, -80.0, 0.0, 0.0, 175.0), (3, "STATE", "Upper", "NN", None, 40.0, -100.0, 80.0, -20.0), (4, "CITY", "Mid", "NN", "Upper", 50.0, -60.0, 60.0, -40.0), (5, "CITY", "Low", "SS", "Deep", -50.0, 20.0, -30.0, 60.0), (6, "CITY", "Inner", "SS", "Deep", -45.0, 30.0, -35.0, 50.0)]
_BOUNDARIES = "boxes(boundary_id, kind, name, country_code, state_name, south, west, north, east) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT" for v in b) + ")" for b in _BOXES) + ")"


def boundaries(t):
    rings = lambda s, w, n, e: [[[w, s], [e, s], [e, n], [w, n], [w, s]]]
    return t.spark.createDataFrame([(*b, rings(*b[5:])) for b in _BOXES], f"boundary_id long, kind string, name string, country_code string, state_name string, south double, west double, north double, east double, rings {geo.RINGS}")


def _points(t):
    return t.metadata.filter("latitude IS NOT NULL").select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


_POINTS = "points AS (SELECT DISTINCT latitude AS lat, longitude AS lon FROM metadata WHERE latitude IS NOT NULL)"


@query("q050_points_in_boxes", f"WITH {_BOUNDARIES}, {_POINTS} SELECT lat, lon, boundary_id FROM points JOIN boxes ON lat BETWEEN south AND north AND lon BETWEEN west AND east")
def _(t):
    return geo.in_boxes(_points(t).distinct(), boundaries(t)).select("lat", "lon", "boundary_id")


@query("q052_smallest_containing", f"WITH {_BOUNDARIES}, {_POINTS} SELECT lat, lon, kind, (array_agg(name ORDER BY (north - south) * (east - west), boundary_id))[1] AS name FROM points JOIN boxes ON lat > south AND lat < north AND lon > west AND lon < east GROUP BY 1, 2, 3")
def _(t):
    return geo.containing(_points(t).distinct(), boundaries(t)).select("lat", "lon", "kind", "name")


#: The boundaries are boxes, so the nearest point of one is the point clamped to it.
@query("q053_geocode", f"""WITH {_BOUNDARIES}, {_POINTS}, keys AS (SELECT DISTINCT round(lat, 4) AS lat, round(lon, 4) AS lon FROM points WHERE NOT (lat = 0 AND lon = 0)),
 held AS (SELECT lat, lon, kind, (array_agg(b ORDER BY (north - south) * (east - west), boundary_id))[1] AS b FROM (SELECT k.lat, k.lon, b.*, b FROM keys k JOIN boxes b ON lat > south AND lat < north AND lon > west AND lon < east) GROUP BY 1, 2, 3),
 lost AS (SELECT * FROM keys k WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lat = k.lat AND h.lon = k.lon)),
 gaps AS (SELECT lat, lon, kind, b, boundary_id, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(least(greatest(lat, south), north) - lat) / 2), 2) + cos(radians(lat)) * cos(radians(least(greatest(lat, south), north))) * pow(sin(radians(least(greatest(lon, west), east) - lon) / 2), 2))) AS km
  FROM (SELECT k.lat, k.lon, b.*, b FROM lost k, boxes b WHERE kind <> 'STATE')),
 close AS (SELECT lat, lon, kind, (array_agg({{'b': b, 'km': km}} ORDER BY km, boundary_id DESC))[1] AS g FROM gaps WHERE km <= 22.2 GROUP BY 1, 2, 3),
 wide AS (SELECT k.lat, k.lon, c.b AS c, s.b AS s, o.b AS o, nc.g AS nc, no.g AS no FROM keys k LEFT JOIN held c ON c.lat = k.lat AND c.lon = k.lon AND c.kind = 'CITY' LEFT JOIN held s ON s.lat = k.lat AND s.lon = k.lon AND s.kind = 'STATE' LEFT JOIN held o ON o.lat = k.lat AND o.lon = k.lon AND o.kind = 'COUNTRY'
  LEFT JOIN close nc ON nc.lat = k.lat AND nc.lon = k.lon AND nc.kind = 'CITY' LEFT JOIN close no ON no.lat = k.lat AND no.lon = k.lon AND no.kind = 'COUNTRY')
 SELECT lat, lon, coalesce(c.name, nc.b.name) AS city, coalesce(s.name, c.state_name, nc.b.state_name) AS state, coalesce(c.country_code, s.country_code, o.country_code, nc.b.country_code, no.b.country_code) AS country,
  CASE WHEN c IS NOT NULL THEN 'CITY' WHEN s IS NOT NULL THEN 'STATE' WHEN o IS NOT NULL THEN 'COUNTRY' WHEN nc IS NOT NULL THEN 'CITY' WHEN no IS NOT NULL THEN 'COUNTRY' END AS kind,
  CASE WHEN c IS NOT NULL THEN 'VERY_HIGH' WHEN s IS NOT NULL THEN 'HIGH' WHEN o IS NOT NULL THEN 'MEDIUM' WHEN nc IS NOT NULL OR no IS NOT NULL THEN 'LOW' ELSE 'VERY_LOW' END AS confidence,
  round(CASE WHEN c IS NULL AND s IS NULL AND o IS NULL THEN coalesce(nc.km, no.km) END, 6) AS distance_km, c IS NULL AND s IS NULL AND o IS NULL AND nc IS NULL AND no IS NULL AS open_sea FROM wide""")
def _(t):
    return geo.geocode(_points(t), boundaries(t)).withColumn("distance_km", F.round("distance_km", 6))


@query("q017_coordinate_cache", "SELECT DISTINCT printf('%.4f:%.4f', latitude, longitude) AS cache_key FROM metadata WHERE latitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)")
def _(t):
    return geo.grid_cache(_points(t)).select("cache_key")


@query("q215_boundary_by_names", f"WITH {_BOUNDARIES}, asked(country, state, city) AS (VALUES ('nn', 'UPPER', 'mid'), ('NN', 'upper', 'nowhere'), ('ss', 'x', 'y'), ('zz', NULL, NULL)) SELECT country, state, city, coalesce((SELECT min(boundary_id) FROM boxes WHERE kind = 'CITY' AND lower(country_code) = lower(country) AND lower(state_name) = lower(state) AND lower(name) = lower(city)), (SELECT min(boundary_id) FROM boxes WHERE kind = 'STATE' AND lower(country_code) = lower(country) AND lower(name) = lower(state)), (SELECT min(boundary_id) FROM boxes WHERE kind = 'COUNTRY' AND lower(country_code) = lower(country))) AS boundary_id FROM asked")
def _(t):
    asked = t.spark.createDataFrame([("nn", "UPPER", "mid"), ("NN", "upper", "nowhere"), ("ss", "x", "y"), ("zz", None, None)], "country string, state string, city string")
    return geo.by_names(asked, boundaries(t)).select("country", "state", "city", "boundary_id")


@query("q216_representative_points", f"WITH {_BOUNDARIES} SELECT boundary_id, round((west + east) / 2, 6) AS lon, true AS inside FROM boxes")
def _(t):
    point = boundaries(t).withColumn("p", geo.interior_point("rings"))
    return point.select("boundary_id", F.round("p.lon", 6).alias("lon"), geo.contains("p.lat", "p.lon", "rings").alias("inside"))


@query("q009_missing_countries", "SELECT n_name FROM nation WHERE n_nationkey % 25 NOT IN (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey < 30)")
def _(t):
    from ..sources import files

    have = t.customer.filter("c_custkey < 30").select(F.col("c_nationkey").cast("string").alias("country_code"))
    return files.missing_countries(t.nation.withColumn("country_code", F.col("n_nationkey").cast("string")), have).select("n_name")


@query("q173_location_rebuild_scope", "SELECT f.id FROM files f JOIN metadata m ON m.file_id = f.id LEFT JOIN places g ON g.file_id = f.id WHERE lifecycle_status = 'ACTIVE' AND latitude IS NOT NULL AND NOT coalesce(g.manual, false) AND (g.file_id IS NULL OR g.confidence IN ('VERY_LOW', 'LOW'))")
def _(t):
    own = lambda d: d.withColumnRenamed("file_id", "id")
    rows = t.files.filter("lifecycle_status = 'ACTIVE'").join(own(t.metadata), "id").filter("latitude IS NOT NULL").join(own(t.places), "id", "left")
    low = F.col("confidence").isNull() | (geo.confidence_rank(F.col("confidence")) <= geo.RANKS["LOW"])
    return rows.filter(~F.coalesce("manual", F.lit(False)) & low).select("id")


# plans ----------------------------------------------------------------------------------------------------------------

_ITEMS = """
items AS (SELECT f.id, f.file_name, f.size_bytes, l.path, CASE WHEN capture_date IS NULL THEN 'D:/Out/NO_DATE/' ELSE 'D:/Out/' || strftime(capture_date, '%Y/%m/') END || coalesce(subcategory, 'UNKNOWN') || '/' || (f.id % 40) || '.jpg' AS target
 FROM files f JOIN locations l ON l.file_id = f.id LEFT JOIN metadata m ON m.file_id = f.id),
moved AS (SELECT *, target = path AS same, target <> path AND count(*) FILTER (target <> path) OVER (PARTITION BY lower(target)) > 1 AS duplicate_target, target <> path AND lower(target) IN (SELECT lower('D:/Out/NO_DATE/CAMERA/' || (file_id % 10) || '.jpg') FROM locations) AS target_exists FROM items)"""


def _items(t):
    own = lambda d: d.withColumnRenamed("file_id", "id")
    rows = t.files.join(own(t.locations), "id").join(own(t.metadata), "id", "left")
    date = F.coalesce(F.date_format("capture_date", "yyyy-MM-dd"), F.lit("NO_DATE"))
    folder = planning.target_folder("YEAR_MONTH", date, F.col("category"), F.coalesce("subcategory", F.lit("UNKNOWN")))
    items = rows.select("id", "file_name", "size_bytes", "path", F.concat(F.lit("D:/Out/"), folder, F.lit("/"), (F.col("id") % 40).cast("string"), F.lit(".jpg")).alias("target"))
    existing = t.locations.select(F.concat(F.lit("D:/Out/NO_DATE/CAMERA/"), (F.col("file_id") % 10).cast("string"), F.lit(".jpg")).alias("path"))
    return planning.conflicts(items, existing)


@query("q085_conflicts", f"WITH {_ITEMS} SELECT id, target, duplicate_target, target_exists FROM moved")
def _(t):
    return _items(t).select("id", "target", "duplicate_target", "target_exists")


@query("q084_plan_statistics", f"WITH {_ITEMS} SELECT count(*) AS items, sum(same::INT)::BIGINT AS organised, sum((NOT same AND duplicate_target)::INT)::BIGINT AS duplicate_targets, sum((NOT same AND target_exists)::INT)::BIGINT AS existing_targets, sum(size_bytes)::BIGINT AS bytes FROM moved")
def _(t):
    return planning.plan_statistics(_items(t))


@query("q221_planner_pipeline", f"WITH {_ITEMS} SELECT id, path, target FROM moved WHERE NOT same AND NOT duplicate_target AND NOT target_exists")
def _(t):
    return _items(t).filter("NOT same AND NOT duplicate_target AND NOT target_exists").select("id", "path", "target")


@query("q222_move_outcomes", f"WITH {_ITEMS} SELECT id, CASE WHEN duplicate_target THEN 'DUPLICATE_TARGET' WHEN id % 7 = 0 THEN 'NOT_PHYSICAL' WHEN id % 5 = 0 AND target_exists THEN 'ALREADY_MOVED' WHEN id % 5 = 0 THEN 'SOURCE_MISSING' WHEN id % 11 = 0 THEN 'TARGET_OWNED' WHEN target_exists THEN 'TARGET_EXISTS' ELSE 'READY' END AS outcome FROM moved")
def _(t):
    i = F.col("id")
    return _items(t).select("id", planning.move_outcome(F.col("duplicate_target"), i % 7 != 0, i % 5 != 0, F.col("target_exists"), i % 11 == 0).alias("outcome"))


@query("q035_plan_candidates", "SELECT f.id FROM files f JOIN locations l ON l.file_id = f.id LEFT JOIN metadata m ON m.file_id = f.id WHERE lower(extension) IN ('jpg', 'mp4') AND category = 'MEDIA' AND subcategory IN ('CAMERA', 'SCREENSHOT') AND (lower(folder) = 'd:/media/src1' OR starts_with(lower(folder), 'd:/media/src1/'))")
def _(t):
    own = lambda d: d.withColumnRenamed("file_id", "id")
    rows = t.files.join(own(t.locations), "id").join(own(t.metadata), "id", "left")
    return rows.filter(planning.candidate_filter(extensions=["JPG", "mp4"], categories=["MEDIA"], subcategories=["CAMERA", "SCREENSHOT"], folder="D:\\Media\\src1")).select("id")


_SAMPLES = "IMG-20240102-WA0003.jpg,holiday_x-WA12.png,AirBrush_1.jpg,photogrid_2.jpg,FB_IMG_3.jpg,faceapp-4.jpg,Screenshot_5.png,screenrecord6.mp4,Captura de tela.png,DJI_0007.jpg,DJI0008.jpg,GOPR0009.mp4,GX010010.mp4,G0123456.jpg,G01234567.jpg,20240102_030405.jpg,2024-01-02.jpg,DSC00001.jpg,DSCN0002 (1).jpg,GEDC0003,IMGP0004.jpg,CIMG0005.jpg,P1234567.jpg,S12345678.jpg,100_0001.jpg,IMG_0001.jpg,vid_2.mp4,dsc_3.jpg,PXL_4.jpg,Peachy_5.jpg,IMAGE_6.jpg,scan7.pdf,IMG8.jpg".split(",")
_FOLDERS = "D:/x|D:/WhatsApp/Sent|D:\\pics\\ whats |D:/Screenshot|E:/captura/a|D:/dji|D:/Drone shots|D:/drone|D:/GoPro|D:/Camera|D:/camera roll".split("|")
#: Fixed values, written out once more for the oracle: what each sample of the two lists is.
_FAMILY_OF_SAMPLE = "WHATSAPP WHATSAPP AIRBRUSH PHOTOGRID FACEBOOK FACEAPP SCREENSHOT SCREENSHOT SCREENSHOT DRONE - GOPRO GOPRO GOPRO - CAMERA CAMERA CAMERA CAMERA CAMERA CAMERA CAMERA CAMERA - CAMERA CAMERA CAMERA CAMERA CAMERA PEACHY IMAGE_UUID - -".split()
_FAMILY_OF_FOLDER = "- WHATSAPP WHATSAPP SCREENSHOT SCREENSHOT DRONE - DRONE GOPRO CAMERA -".split()


def _in(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAMED = f"named AS (SELECT id, ({_in(_FAMILY_OF_SAMPLE)})[id % {len(_SAMPLES)} + 1] AS n, ({_in(_FAMILY_OF_FOLDER)})[id % {len(_FOLDERS)} + 1] AS d, CASE id % 7 WHEN 0 THEN 'CELLPHONE' WHEN 1 THEN 'GOPRO' WHEN 2 THEN 'AIRBRUSH' WHEN 3 THEN 'WHATSAPP' END AS known FROM files)"


def _named(t):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))
    k = F.col("id") % 7
    known = F.when(k == 0, "CELLPHONE").when(k == 1, "GOPRO").when(k == 2, "AIRBRUSH").when(k == 3, "WHATSAPP")
    return t.files.select("id", pick(_SAMPLES).alias("name"), F.concat(pick(_FOLDERS), F.lit("/"), pick(_SAMPLES)).alias("path"), known.alias("known"))


@query("q127_subcategories", f"""WITH {_NAMED} SELECT id, CASE WHEN n = 'WHATSAPP' OR d = 'WHATSAPP' THEN 'WHATSAPP' WHEN n IN ('AIRBRUSH', 'PHOTOGRID') THEN n WHEN n IN ('FACEBOOK', 'FACEAPP') THEN 'OTHER' WHEN n = 'SCREENSHOT' OR d = 'SCREENSHOT' THEN 'SCREENSHOT' WHEN n = 'DRONE' OR d = 'DRONE' THEN 'DRONE'
 WHEN n = 'GOPRO' OR d = 'GOPRO' THEN 'GOPRO' WHEN n = 'CAMERA' THEN 'CAMERA' WHEN n = 'PEACHY' THEN 'OTHER' WHEN n = 'IMAGE_UUID' THEN 'CAMERA' ELSE 'UNKNOWN' END AS label FROM named""")
def _(t):
    return _named(t).select("id", planning.subcategory(F.col("name"), F.col("path")).alias("label"))


@query("q141_rule_engine", f"""WITH {_NAMED}, r(priority, family) AS (VALUES (10, 'WHATSAPP'), (20, 'DRONE'), (30, 'GOPRO'), (40, 'SCREENSHOT'), (90, 'CAMERA')),
 hits AS (SELECT id, priority, family, CASE WHEN known = family OR known = 'CELLPHONE' AND family = 'CAMERA' THEN 'DATABASE' WHEN d = family THEN 'FOLDER' WHEN n = family THEN 'FILE_NAME' END AS reason FROM named, r)
 SELECT f.id, coalesce(h.family, 'OTHER') AS label, coalesce(h.priority, 999) AS priority, coalesce(h.reason, 'UNKNOWN') AS reason FROM named f LEFT JOIN (SELECT DISTINCT ON (id) * FROM hits WHERE reason IS NOT NULL ORDER BY id, priority) h ON h.id = f.id""")
def _(t):
    label, priority, reason = planning.classified(F.col("known"), F.col("path"), F.col("name"))
    return _named(t).select("id", label.alias("label"), priority.alias("priority"), reason.alias("reason"))


@query("q140_layouts", "SELECT file_id, coalesce(strftime(capture_date, '%Y/%m/%d'), 'NO_DATE') || '/' || subcategory AS by_day, CASE WHEN capture_date IS NULL THEN category || '/NO_DATE' ELSE category || strftime(capture_date, '/%Y/%m') END || '/Paris/' || subcategory AS by_category, '' AS flat FROM metadata")
def _(t):
    date = F.coalesce(F.date_format("capture_date", "yyyy-MM-dd"), F.lit("NO_DATE"))
    c = F.col
    return t.metadata.select("file_id", planning.target_folder("YEAR_MONTH_DAY", date, c("category"), c("subcategory")).alias("by_day"), planning.target_folder("CATEGORY_YEAR_MONTH", date, c("category"), c("subcategory"), F.lit("Paris")).alias("by_category"), planning.target_folder("FLAT", date, c("category"), c("subcategory")).alias("flat"))


# reconciliation -------------------------------------------------------------------------------------------------------

_DISK = "disk AS (SELECT path, CASE WHEN file_id % 9 = 0 THEN 1 ELSE size_bytes END AS size_bytes FROM locations JOIN files ON id = file_id WHERE file_id % 4 <> 0 UNION ALL SELECT 'D:/New/' || id, size_bytes FROM files WHERE id % 50 = 0), known AS (SELECT path, id, size_bytes FROM locations JOIN files ON id = file_id WHERE lifecycle_status = 'ACTIVE')"


def _known(t):
    return t.locations.join(t.files, F.col("id") == F.col("file_id"))


def _issues(t):
    rows = _known(t)
    disk = rows.filter("file_id % 4 <> 0").select("path", F.when(F.col("file_id") % 9 == 0, F.lit(1).cast("long")).otherwise(F.col("size_bytes")).alias("size_bytes")).union(t.files.filter("id % 50 = 0").select(F.concat(F.lit("D:/New/"), F.col("id").cast("string")), "size_bytes"))
    return reconcile.differences(disk, rows.filter("lifecycle_status = 'ACTIVE'"))


@query("q054_reconcile", f"WITH {_DISK} SELECT coalesce(disk.path, known.path) AS path, id, CASE WHEN known.path IS NULL THEN 'UNTRACKED' WHEN disk.path IS NULL THEN 'MISSING' WHEN disk.size_bytes <> known.size_bytes THEN 'STALE' ELSE 'OK' END AS issue FROM disk FULL JOIN known ON disk.path = known.path")
def _(t):
    return _issues(t)


@query("q055_rename_pairs", """
WITH g AS (SELECT id, CASE WHEN id % 8 = 0 THEN 1 ELSE size_bytes END AS size_bytes, CASE WHEN id % 8 = 0 THEN 'shared' || (id % 40) ELSE sha256 END AS sha256, created_at FROM files WHERE id % 4 = 0),
n AS (SELECT '/new/' || id AS path, size_bytes, sha256, CASE WHEN id % 24 = 0 THEN created_at ELSE TIMESTAMP '2019-01-01' END AS created_at FROM g),
c AS (SELECT size_bytes, sha256, count(*) AS k FROM g GROUP BY ALL)
SELECT g.id, n.path AS new_path FROM g JOIN n USING (size_bytes, sha256) JOIN c USING (size_bytes, sha256) WHERE k = 1
UNION ALL SELECT min(g.id), min(n.path) FROM g JOIN n USING (size_bytes, sha256, created_at) JOIN c USING (size_bytes, sha256) WHERE k > 1 GROUP BY size_bytes, sha256, created_at HAVING count(DISTINCT n.path) = 1""")
def _(t):
    """Every eighth file shares its content with others, and a third of those are told apart by their times."""
    shared = F.col("id") % 8 == 0
    size, sha = F.when(shared, F.lit(1)).otherwise(F.col("size_bytes")), F.when(shared, F.concat(F.lit("shared"), (F.col("id") % 40).cast("string"))).otherwise(F.col("sha256"))
    gone = t.files.filter("id % 4 = 0").select("id", size.alias("size_bytes"), sha.alias("sha256"), "created_at")
    later = F.when(F.col("id") % 24 == 0, F.col("created_at")).otherwise(F.lit(datetime(2019, 1, 1)).cast("timestamp_ntz"))
    return reconcile.renames(gone, gone.select(F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("path"), "size_bytes", "sha256", later.alias("created_at")))


@query("q169_reconcile_apply", f"WITH {_DISK}, i AS (SELECT id, CASE WHEN disk.path IS NULL THEN 'MISSING' WHEN disk.size_bytes <> known.size_bytes THEN 'STALE' END AS issue FROM known LEFT JOIN disk ON disk.path = known.path) SELECT id, CASE WHEN id % 8 = 0 THEN 'RENAME' WHEN issue = 'STALE' THEN 'REFRESH' ELSE 'MARK_MISSING' END AS action FROM i WHERE issue IS NOT NULL")
def _(t):
    renamed = t.files.filter("id % 8 = 0").select("id", F.lit("x").alias("new_path"))
    return reconcile.apply_plan(_issues(t), renamed).select("id", "action")


# changes --------------------------------------------------------------------------------------------------------------


@query("q014_batch_upsert", "SELECT file_id, score, seen FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seen DESC) AS k FROM (SELECT file_id, label::BIGINT AS score, 1 AS seen FROM prints UNION ALL SELECT file_id + 400, 7, 2 FROM prints)) WHERE k = 1")
def _(t):
    old = t.prints.select("file_id", F.col("label").cast("long").alias("score"), F.lit(1).alias("seen"))
    return mutations.upsert(old, t.prints.select((F.col("file_id") + 400).alias("file_id"), F.lit(7).cast("long").alias("score"), F.lit(2).alias("seen")), ["file_id"], ["seen"])


@query("q015_replace_by_key", "SELECT execution_id, phase, 1::BIGINT AS millis FROM (SELECT DISTINCT execution_id, phase FROM phases WHERE execution_id % 2 = 0) UNION ALL SELECT execution_id, phase, sum(millis)::BIGINT FROM phases WHERE execution_id % 2 <> 0 GROUP BY 1, 2")
def _(t):
    old = t.phases.groupBy("execution_id", "phase").agg(F.sum("millis").alias("millis"))
    new = old.filter("execution_id % 2 = 0").withColumn("millis", F.lit(1).cast("long"))
    return mutations.replace_by_key(old, new, ["execution_id"])


@query("q016_reserved_ids", "SELECT 999 + row_number() OVER (ORDER BY sha256) AS group_id, sha256 FROM (SELECT sha256 FROM files GROUP BY sha256 HAVING count(*) > 1)")
def _(t):
    groups = t.files.groupBy("sha256").count().filter("count > 1").select("sha256")
    return mutations.with_ids(groups, [F.asc("sha256")], 1000, "group_id")


@query("q018_self_write_announce", "SELECT path, max(happened_at) AS at FROM errors GROUP BY path")
def _(t):
    rows = t.errors.select("path", F.col("happened_at").alias("at"))
    return mutations.upsert(rows.limit(0), rows, ["path"], ["at"])


@query("q017_insert_ignore", "SELECT file_id, 'old' AS v FROM metadata UNION ALL SELECT file_id, 'new' FROM locations WHERE file_id NOT IN (SELECT file_id FROM metadata)")
def _(t):
    return mutations.insert_ignore(t.metadata.select("file_id", F.lit("old").alias("v")), t.locations.select("file_id", F.lit("new").alias("v")), ["file_id"])


@query("q165_inventory_actions", "SELECT s.k AS id, CASE WHEN f.id IS NULL THEN 'EXTRACT' WHEN lifecycle_status = 'ACTIVE' THEN 'CACHED' ELSE 'REACTIVATE' END AS action FROM (SELECT doc_id * 2 AS k FROM documents) s LEFT JOIN files f ON f.id = s.k")
def _(t):
    seen = t.documents.select((F.col("doc_id") * 2).alias("id"), F.concat(F.lit("p"), (F.col("doc_id") * 2).cast("string")).alias("public_id"))
    return mutations.inventory(t.files, seen).select("id", "action")


_AT = datetime(2024, 1, 1)


@query("q166_mark_missing", "SELECT id, CASE WHEN lifecycle_status = 'ACTIVE' AND id % 3 = 0 THEN 'MISSING' ELSE lifecycle_status END AS lifecycle_status, CASE WHEN lifecycle_status = 'ACTIVE' AND id % 3 = 0 THEN TIMESTAMP '2024-01-01' ELSE lifecycle_changed_at END AS lifecycle_changed_at FROM files")
def _(t):
    return mutations.mark_missing(t.files, t.files.filter("id % 3 = 0"), F.lit(_AT).cast("timestamp_ntz")).select("id", "lifecycle_status", "lifecycle_changed_at")


@query("q167_retention", "SELECT id FROM files WHERE NOT coalesce(lifecycle_status = 'MISSING' AND lifecycle_changed_at < TIMESTAMP '2020-05-01', false)")
def _(t):
    return mutations.retained(t.files, F.lit(datetime(2020, 5, 1)).cast("timestamp_ntz")).select("id")


@query("q168_delete_subtree", "SELECT file_id FROM locations WHERE NOT (lower(path) = 'd:/media/src6' OR starts_with(lower(path), 'd:/media/src6/'))")
def _(t):
    from ..functions import predicates as p

    return mutations.delete_where(t.locations, p.under(F.col("path"), "D:/Media/src6")).select("file_id")


@query("q170_apply_renames", "SELECT f.id, CASE WHEN f.id % 8 = 0 THEN 'renamed.mp4' ELSE file_name END AS file_name, CASE WHEN f.id % 8 = 0 THEN 'VIDEO' ELSE file_type END AS file_type FROM files f")
def _(t):
    hit = F.col("id") % 8 == 0
    return mutations.set_where(t.files, hit, file_name=F.lit("renamed.mp4"), file_type=names.type_of_extension(names.extension(F.lit("renamed.mp4")))).select("id", "file_name", "file_type")


@query("q171_retention_by_age", "SELECT id FROM executions WHERE status = 'FINISHED' AND started_at < TIMESTAMP '1996-01-01'")
def _(t):
    return mutations.older_than(t.executions, "started_at", F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz"), F.col("status") == "FINISHED").select("id")


@query("q172_metadata_rebuild_preview", "SELECT file_id, capture_date AS old, CASE WHEN file_id % 6 = 0 THEN NULL ELSE rebuilt_at END AS new FROM metadata WHERE capture_date IS DISTINCT FROM CASE WHEN file_id % 6 = 0 THEN NULL ELSE rebuilt_at END")
def _(t):
    new = F.when(F.col("file_id") % 6 != 0, F.col("rebuilt_at"))
    return t.metadata.select("file_id", F.col("capture_date").alias("old"), new.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))


_UNDO = """
p AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'SKIPPED' WHEN k % 5 = 0 OR k % 11 = 0 THEN 'ERROR' ELSE 'UNDONE' END AS last FROM (SELECT DISTINCT doc_id // 2 AS k FROM documents WHERE doc_id % 2 = 1))
SELECT k * 2 + 1 AS id, last AS status, CASE WHEN last = 'ERROR' THEN CASE WHEN k % 5 = 0 THEN 'SOURCE_NOT_FOUND' ELSE 'TARGET_EXISTS' END END AS reason FROM p
UNION ALL SELECT doc_id, CASE WHEN NOT (coalesce(last, '') = 'UNDONE' OR k % 11 = 0) OR k % 7 = 0 THEN 'ERROR' ELSE 'UNDONE' END,
  CASE WHEN NOT (coalesce(last, '') = 'UNDONE' OR k % 11 = 0) THEN 'SOURCE_NOT_FOUND' WHEN k % 7 = 0 THEN 'TARGET_EXISTS' END FROM (SELECT doc_id, doc_id // 2 AS k FROM documents WHERE doc_id % 2 = 0) LEFT JOIN p USING (k)"""


@query("q174_undo", f"WITH {_UNDO}")
def _(t):
    """Files moved twice, a to b and b to c: the later move goes back first, and what comes of it decides about the earlier."""
    k = F.expr("doc_id DIV 2")
    name = lambda c: F.concat(F.lit(c), k.cast("string"))
    odd = F.col("doc_id") % 2 == 1
    moves = t.documents.select(F.col("doc_id").alias("id"), F.when(odd, name("b")).otherwise(name("a")).alias("source"), F.when(odd, name("c")).otherwise(name("b")).alias("target"), F.when(odd & (k % 13 == 0), "UNDONE").otherwise("MOVED").alias("status"))
    here = t.documents.select(F.explode(F.array_compact(F.array(F.when(k % 5 != 0, name("c")), F.when(k % 7 == 0, name("a")), F.when(k % 11 == 0, name("b"))))).alias("path"))
    return mutations.undo(moves, here)


@query("q165_inventory_upsert", """
WITH s AS (SELECT doc_id * 2 AS k FROM documents)
SELECT f.id, f.public_id, CASE WHEN s.k IS NOT NULL AND lifecycle_status <> 'ACTIVE' THEN -1 ELSE size_bytes END AS size_bytes, CASE WHEN s.k IS NOT NULL THEN 'ACTIVE' ELSE lifecycle_status END AS lifecycle_status FROM files f LEFT JOIN s ON s.k = f.id
UNION ALL SELECT -k, 'p' || k, -1, 'ACTIVE' FROM s WHERE k NOT IN (SELECT id FROM files)""")
def _(t):
    """Every second key is seen: unknown ones are new rows, inactive ones come back with what was extracted, active ones stay."""
    seen = t.documents.select(F.concat(F.lit("p"), (F.col("doc_id") * 2).cast("string")).alias("public_id"), (F.col("doc_id") * -2).alias("new_id"))
    files = t.files
    filled = [F.col("new_id").alias(c) if c == "id" else F.col(c) if c == "public_id" else F.lit(-1).cast(kind).alias(c) if c == "size_bytes" else F.lit(None).cast(kind).alias(c) for c, kind in files.dtypes]
    return mutations.inventory_upsert(files, seen.select("public_id"), seen.select(*filled), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).select("id", "public_id", "size_bytes", "lifecycle_status")


@query("q174_undo_order", "SELECT id, row_number() OVER (ORDER BY id DESC) AS k FROM movements WHERE status = 'MOVED'")
def _(t):
    return mutations.with_ids(t.movements.filter("status = 'MOVED'").select("id"), [F.desc("id")], 1, "k")


@query("q175_quarantine", "SELECT id, reason FROM movements WHERE status = 'MOVED' AND reason IN ('1-URGENT', '2-HIGH') AND moved_at < TIMESTAMP '1995-01-01'")
def _(t):
    return t.movements.filter((F.col("status") == "MOVED") & F.col("reason").isin("1-URGENT", "2-HIGH") & (F.col("moved_at") < F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz"))).select("id", "reason")


@query("q176_retype", "SELECT id, CASE lower(extension) WHEN 'jpg' THEN 'PHOTO' WHEN 'mp4' THEN 'VIDEO' ELSE file_type END AS file_type FROM files")
def _(t):
    return mutations.retyped(t.files, {"jpg": "PHOTO", "mp4": "VIDEO"}).select("id", "file_type")


@query("q208_failure_reset", "SELECT id, CASE WHEN id % 4 = 1 THEN 0 ELSE (id % 5) END::INT AS attempts FROM files WHERE NOT (id % 7 = 0)")
def _(t):
    rows = t.files.select("id", (F.col("id") % 5).cast("int").alias("attempts"))
    return mutations.set_where(mutations.delete_where(rows, F.col("id") % 7 == 0), F.col("id") % 4 == 1, attempts=F.lit(0))


@query("q230_changed_inputs", "SELECT file_id FROM videos WHERE file_id % 2 = 1 AND duration IS NOT NULL")
def _(t):
    after = t.videos.withColumn("duration", F.when(F.col("file_id") % 2 == 1, F.col("duration") + 1).otherwise(F.col("duration"))).select(F.col("file_id").alias("f"), F.struct("duration", "width", "height").alias("new"))
    before = t.videos.select("file_id", F.struct("duration", "width", "height").alias("old"))
    return before.join(after, F.col("file_id") == F.col("f")).filter(~F.col("old").eqNullSafe(F.col("new"))).select("file_id")


# queue ----------------------------------------------------------------------------------------------------------------

_QUEUE = "queue AS (SELECT id, type, status, priority, dedup_key, claim_count, started_at AS created_at, started_at AS available_at, CASE WHEN status = 'RUNNING' THEN started_at + INTERVAL 1 DAY END AS lease_until FROM executions)"


def _queue(t):
    at = F.col("started_at")
    return t.executions.select("id", "type", "status", "priority", "dedup_key", "claim_count", at.alias("created_at"), at.alias("available_at"), F.when(F.col("status") == "RUNNING", at + F.expr("INTERVAL 1 DAY")).alias("lease_until"))


@query("q178_claim_order", f"WITH {_QUEUE} SELECT id, (priority + least(5, greatest(0, floor(date_diff('second', created_at, TIMESTAMP '1997-01-01') / 3600.0))))::BIGINT AS rank FROM queue q WHERE status = 'PENDING' AND available_at <= TIMESTAMP '1997-01-01' AND claim_count < 3 AND type IN ('INVENTORY', 'RECONCILE') AND NOT EXISTS (SELECT 1 FROM queue r WHERE r.status = 'RUNNING' AND r.dedup_key = q.dedup_key)")
def _(t):
    return queue.claimable(_queue(t), datetime(1997, 1, 1), 3, ["INVENTORY", "RECONCILE"]).select("id", F.col("rank").cast("long").alias("rank"))


@query("q179_requeue", f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'RUNNING' AND lease_until < TIMESTAMP '1996-01-01' THEN CASE WHEN claim_count < 3 AND NOT EXISTS (SELECT 1 FROM queue w WHERE w.status = 'PENDING' AND w.dedup_key = q.dedup_key) THEN 'PENDING' ELSE 'FAILED' END ELSE status END AS status FROM queue q")
def _(t):
    return queue.requeue(_queue(t), F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz"), 3).select("id", "status")


@query("q180_expired_leases", f"WITH {_QUEUE} SELECT id FROM queue WHERE status = 'RUNNING' AND lease_until < TIMESTAMP '1996-01-01'")
def _(t):
    return queue.expired(_queue(t), F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz")).select("id")


@query("q181_key_violations", f"WITH {_QUEUE} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY dedup_key, status ORDER BY id) AS k FROM queue WHERE dedup_key IS NOT NULL AND status IN ('PENDING', 'RUNNING')) WHERE k > 1")
def _(t):
    return queue.duplicates_of_key(_queue(t)).select("id")


# exports --------------------------------------------------------------------------------------------------------------


@query("q010_csv_lines", """SELECT f.id || ',' || CASE WHEN f.id % 3 = 0 THEN '"a ""q"", ' || f.id || '"' ELSE f.file_name END || ',' || coalesce(l.path, '') AS value FROM files f LEFT JOIN locations l ON l.file_id = f.id""")
def _(t):
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit('a "q", '), F.col("id").cast("string"))).otherwise(F.col("file_name"))
    return exports.csv_lines(t.files.join(t.locations, F.col("id") == F.col("file_id"), "left").select("id", name.alias("name"), "path"), ["id", "name", "path"])


@query("q011_json_lines", """SELECT '{"public_id":"' || public_id || '","size_bytes":' || size_bytes || ',"extension":' || coalesce('"' || extension || '"', 'null') || '}' AS value FROM files""")
def _(t):
    return exports.json_lines(t.files.select("id", "public_id", "size_bytes", "extension"))


@query("q012_export_rows", "SELECT f.id, f.file_name, l.path FROM files f LEFT JOIN locations l ON l.file_id = f.id WHERE f.id > 500 ORDER BY f.id LIMIT 200")
def _(t):
    from ..operators import paging

    rows = t.files.join(t.locations, F.col("id") == F.col("file_id"), "left").select("id", "file_name", "path")
    return paging.batch_after(rows, "id", 500, 200)


# change streams (their batch form) --------------------------------------------------------------------------------------


@query("q185_debounced_bursts", "SELECT user_id, min(ts) AS started, count(*) AS changes FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst")
def _(t):
    found = changes.debounced(t.events, "ts", "user_id", "20 minutes")
    return found.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "changes")


@query("q189_foreign_changes", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = e.user_id AND (a.ts + INTERVAL 5 MINUTE >= e.ts OR a.event_id % 10 = 0))")
def _(t):
    own = t.events.filter("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("announced_at"), (F.col("event_id") % 10).alias("execution_id"))
    running = t.spark.createDataFrame([(0,)], "execution_id long")
    return changes.foreign(t.events.withColumn("p", F.col("user_id").cast("string")), own, running, "p", "ts").select("event_id")


@query("q189_foreign_stream", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = e.user_id AND a.ts + INTERVAL 5 MINUTE >= e.ts AND a.ts - INTERVAL 10 SECOND <= e.ts)")
def _(t):
    """The suppression between two streams: both halves of ``events``, in files, and a row far ahead that ends them."""
    at = F.col("ts").cast("timestamp")
    end = t.events.agg(F.max(at).alias("at")).select(F.lit("end").alias("path"), (F.col("at") + F.expr("INTERVAL 30 DAYS")).alias("at"), F.lit(None).cast("long").alias("id"))
    rows = t.events.select(F.col("user_id").cast("string").alias("path"), at.alias("at"), F.col("event_id").alias("id"))
    own = t.events.filter("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("path"), at.alias("at"), F.lit(None).cast("long").alias("id"))
    streams = [_files_of(t, [part, end], "path string, at timestamp, id long") for part in (rows, own)]
    # the end is in both; it is no change
    made = state.foreign(streams[0].withColumn("id", F.coalesce("id", F.lit(-1).cast("long"))), streams[1].select("path", "at"), late="1 day")
    return _run_through(t, made).filter("id >= 0").select(F.col("id").alias("event_id"))


def _files_of(t, parts, schema):
    """A stream of tables, one after the other."""
    folder = new_path(t.spark, "stream")
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/{k}")
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/*")


def _run_through(t, stream):
    """What a stream gives when it has read all there is."""
    state.use_state_store(t.spark)
    out = new_path(t.spark, "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(t.spark, "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


_JOURNAL = """
j AS (SELECT event_id, event_id // 2 AS k, event_id % 2 AS half FROM events),
r AS (SELECT event_id, k, half, k % 7 AS kind,
  CASE WHEN k % 7 IN (0, 4, 6) OR (k % 7 = 1 AND half = 0) OR (k % 7 = 2 AND half = 1) THEN 'D:/Media/' ELSE 'E:/' END || CASE WHEN half = 0 THEN 'old' ELSE 'new' END || k AS path FROM j WHERE NOT (k % 11 = 0 AND half = 1))
SELECT DISTINCT CASE WHEN kind IN (4, 5) THEN 'D:/Media' ELSE path END AS path, CASE WHEN kind IN (4, 5) THEN 'RECONCILE' ELSE 'CHECK' END AS action
FROM r WHERE path LIKE 'D:/Media/%' AND NOT (kind = 6 AND half = 1)"""


def _journal(t):
    """Renames within the root (0), out of it (1), into it (2), outside (3), of folders (4, 5), and creations (6); of every
    eleventh pair the new name never comes."""
    k, half = F.expr("event_id DIV 2"), F.col("event_id") % 2
    kind = k % 7
    inside = kind.isin(0, 4, 6) | ((kind == 1) & (half == 0)) | ((kind == 2) & (half == 1))
    path = F.concat(F.when(inside, "D:/Media/").otherwise("E:/"), F.when(half == 0, "old").otherwise("new"), k.cast("string"))
    flags = F.when(kind == 6, F.when(half == 0, changes.CREATED).otherwise(0x8000)).when(half == 0, changes.RENAMED_OLD).otherwise(changes.RENAMED_NEW)
    rows = t.events.filter(~((k % 11 == 0) & (half == 1)))
    return rows.select(F.col("event_id").alias("seq"), k.alias("file_ref"), path.alias("path"), flags.alias("reason_flags"), kind.isin(4, 5).alias("directory"), F.timestamp_millis(F.col("event_id") * 10 + 10**12).alias("happened_at"))


@query("q187_journal", f"WITH {_JOURNAL}")
def _(t):
    return changes.interpreted(_journal(t), "D:/Media")


@query("q187_journal_stream", f"WITH {_JOURNAL}")
def _(t):
    """The same journal from its source, cut into segments and two runs between which renames are split."""
    folder, out, cp = (new_path(t.spark, label) for label in ("journal", "out", "cp"))
    state.use_state_store(t.spark)
    journal.create(folder, "events")
    half = t.events.agg((F.expr("percentile_approx(event_id, 0.5) DIV 2") * 2).alias("n")).first()["n"] or 0
    rows = _journal(t)
    last = t.events.agg(F.max("event_id").alias("seq")).select((F.col("seq") + 1).alias("seq"), F.lit(-1).cast("long").alias("file_ref"), F.lit("E:/end").alias("path"), F.lit(changes.CREATED).alias("reason_flags"), F.lit(False).alias("directory"), F.expr("timestamp_millis(seq * 10 + 1000000000000) + INTERVAL 1 DAY").alias("happened_at"))
    # the watermark of a batch holds from the next one on, so the end comes twice
    for part in (rows.filter(F.col("seq") <= half), rows.filter(F.col("seq") > half), last, last):
        journal.append(part, folder, 1 << 18)
        made = state.interpreted(journal.stream(t.spark, folder).filter("recovery IS NULL"), "D:/Media")
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("path string, action string").parquet(out).distinct()


@query("q184_journal_backlog", "SELECT event_id - (SELECT min(event_id) FROM events) AS seq FROM events WHERE event_id > (SELECT (min(event_id) + max(event_id)) // 2 FROM events)")
def _(t):
    """What the journal recorded after a walk whose end the cursor holds (events are numbered without gaps)."""
    folder = new_path(t.spark, "journal")
    journal.create(folder, "events")
    middle = t.events.agg(F.expr("(min(event_id) + max(event_id)) DIV 2").alias("n")).first()["n"] or 0
    rows = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("file_ref"), F.lit("D:/Media/x").alias("path"), F.lit(changes.CREATED).alias("reason_flags"), F.lit(False).alias("directory"), F.col("ts").alias("happened_at"))
    journal.append(rows.filter(F.col("seq") <= middle), folder)
    journal.walked(folder, f"{folder}/cursor/at.json", lambda: journal.append(rows.filter(F.col("seq") > middle), folder) >= 0)
    return journal.offline_backlog(t.spark, folder, f"{folder}/cursor/at.json").select("seq")


@query("q_windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS changes FROM events GROUP BY 1, 2")
def _(t):
    found = changes.windowed(t.events, "ts", "event_type", "1 hour")
    return found.select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "changes")
