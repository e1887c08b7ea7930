"""The rest of the inventory: scans, samples, whole similarity runs, published pages, look-ups."""

from __future__ import annotations

from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fingerprint, names
from ..functions import predicates as p
from ..operators import duplicates, geo, mutations, paging, planning, search, similarity, statistics
from ..sources import exports, files, walk
from ..sources.tables import new_path, written
from . import pipeline_queries as pq
from .registry import query


def _tree(t) -> str:
    """A folder of files, one for each document: its text, below its source, some hidden, some in folders to skip."""
    k = F.col("doc_id") % 10
    inner = F.when(k == 0, ".hidden/").when(k == 1, F.concat("source", F.lit("/Sub_a/"))).when(k == 2, F.concat("source", F.lit("/deep/er/"))).otherwise(F.concat("source", F.lit("/")))
    name = F.when(k == 3, F.concat(F.lit(".f"), "doc_id", F.lit(".jpg"))).when(k == 4, F.concat(F.lit("f"), "doc_id", F.lit(".jpg.lnk"))).when(k == 5, F.concat(F.lit("f"), "doc_id", F.lit(".tmp"))).when(k == 6, F.concat(F.lit("f"), "doc_id")).otherwise(F.concat(F.lit("F"), "doc_id", F.lit(".JPG")))
    root = new_path(t.spark, "tree")
    walk.stored(t.documents.select(F.concat(inner, name).alias("path"), "text"), "path", "text", root).agg(F.sum("length")).collect()
    return root


def _below(root: str) -> Column:
    return F.substring("path", len(root) + 2, 1 << 20)


@query("q001_file_scan", "SELECT source || CASE WHEN doc_id % 10 = 2 THEN '/deep/er/F' ELSE '/F' END || doc_id || '.JPG' AS path, coalesce(strlen(text), 0) AS length FROM documents WHERE doc_id % 10 IN (2, 7, 8, 9) AND source <> 'src9'")
def _(t):
    root = _tree(t)
    found = files.scan(t.spark, root, include=["jpg"], exclude=["tmp"], folders=["sub_?", "src9"])
    return found.select(_below(root).alias("path"), "length")


@query("q002_scan_count", "SELECT count(*) AS n FROM locations WHERE path NOT LIKE '%/src9/%'")
def _(t):
    return t.locations.filter(p.scan_allowed(F.col("path"), ["tmp"], ["src9"])).agg(F.count(F.lit(1)).alias("n"))


@query("q005_physical_policy", "SELECT file_id FROM locations WHERE file_id % 5 <> 0")
def _(t):
    name = F.when(F.col("file_id") % 5 == 0, F.concat("path", F.lit(".LNK"))).otherwise(F.col("path"))
    return t.locations.filter(files.processable(name)).select("file_id")


@query("q006_content_hash", "SELECT doc_id, coalesce(strlen(text), 0) AS length, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5 FROM documents")
def _(t):
    hashes = files.with_hashes(t.spark, _tree(t))
    return hashes.select(F.regexp_extract("path", r"[fF](\d+)[^/]*$", 1).cast("long").alias("doc_id"), "length", "sha256", "md5")


@query("q007_boundary_rings", f"WITH {pq._BOUNDARIES} SELECT boundary_id, 5::BIGINT AS points, round((north - south) * (east - west), 6) AS area FROM boxes")
def _(t):
    return pq.boundaries(t).select("boundary_id", F.size(F.flatten("rings")).cast("long").alias("points"), F.round(geo.ring_area("rings"), 6).alias("area"))


@query("q008_boundary_boxes", f"WITH {pq._BOUNDARIES} SELECT boundary_id, greatest(south, -90) AS south, least(east, 180) AS east FROM boxes")
def _(t):
    flat = F.flatten("rings")
    return pq.boundaries(t).select("boundary_id", F.greatest(F.array_min(F.transform(flat, lambda q: q[1])), F.lit(-90.0)).alias("south"), F.least(F.array_max(F.transform(flat, lambda q: q[0])), F.lit(180.0)).alias("east"))


@query("q013_plan_export", "SELECT '{\"id\":' || id || ',\"file_name\":\"' || file_name || '\"}' AS value FROM files")
def _(t):
    return exports.json_lines(t.files.select("id", "file_name"), ())


@query("q040_anti_theta", "SELECT f.id FROM files f JOIN locations l ON l.file_id = f.id WHERE NOT EXISTS (SELECT 1 FROM folder_exclusions x WHERE replace(l.folder, '\\', '/') = replace(x.folder, '\\', '/') OR starts_with(replace(l.folder, '\\', '/'), replace(x.folder, '\\', '/') || '/'))")
def _(t):
    rows = t.files.join(t.locations, F.col("id") == F.col("file_id")).select("id", "folder")
    return p.without_excluded_folders(rows, t.folder_exclusions, "folder", "folder").select("id")


@query("q049_gates", "SELECT file_id, coalesce(abs(duration - 60) <= 3, true) AS near, abs(width / height::DOUBLE - 1.7) / greatest(width / height::DOUBLE, 1.7) <= 0.12 AS alike FROM videos")
def _(t):
    ratio = F.col("width") / F.col("height")
    return t.videos.select("file_id", F.coalesce(F.abs(F.col("duration") - 60) <= 3, F.lit(True)).alias("near"), (F.abs(ratio - 1.7) / F.greatest(ratio, F.lit(1.7)) <= 0.12).alias("alike"))


@query("q051_points_near_boxes", f"WITH {pq._BOUNDARIES}, {pq._POINTS} SELECT lat, lon, boundary_id FROM points JOIN boxes ON lat BETWEEN south - 22.2::DOUBLE / 111 AND north + 22.2::DOUBLE / 111 AND lon BETWEEN west - (22.2::DOUBLE / 111) / greatest(cos(radians(least(greatest(abs(south), abs(north)), 85))), 0.05) AND east + (22.2::DOUBLE / 111) / greatest(cos(radians(least(greatest(abs(south), abs(north)), 85))), 0.05)")
def _(t):
    return geo.in_boxes(pq._points(t).distinct(), pq.boundaries(t), geo.NEAREST_KM).select("lat", "lon", "boundary_id")


#: A pixel's place among the 64 values of an embedding: 32 x 32 luminances without symmetry, so that no two frequencies tie.
_AT = "(y * y * 3 + x * 7 + y * x) % 64 + 1"
_LEVELS = "levels AS (SELECT vec_id AS file_id, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 60 + 128), 0), 255)::DOUBLE) AS v FROM embeddings)"


def _samples(t):
    """Luminances from the embeddings."""
    level = F.transform("embedding", lambda e: F.least(F.greatest(F.floor(e.cast("double") * 60 + 128), F.lit(0)), F.lit(255)).cast("int"))
    return written(t.embeddings.select(F.col("vec_id").alias("file_id"), _pixels(level).alias("sample")), "samples")


@F.pandas_udf(T.BinaryType())
def _pixels(levels: pd.Series) -> pd.Series:
    y, x = np.divmod(np.arange(1024), 32)
    at = (y * y * 3 + x * 7 + y * x) % 64  # _AT from 0
    return pd.Series([np.asarray(v, np.uint8)[at].tobytes() for v in levels], dtype=object)


#: bits: each file's hash as 256 digits.  The cosine basis, both passes of the transform, and the 128th of 255 terms.
_BITS = f"""basis AS (SELECT k, n, CASE WHEN k = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END * cos(pi() * (2 * n + 1) * k / 64) AS c FROM range(16) AS ks(k), range(32) AS ns(n)),
 across AS (SELECT file_id, y, k AS l, sum(c * v[{_AT.replace("x", "n")}]) AS s FROM levels, range(32) AS ys(y), basis GROUP BY file_id, y, k),
 coefficients AS (SELECT file_id, b.k, l, sum(c * s) AS f FROM across JOIN basis b ON b.n = y GROUP BY file_id, b.k, l),
 middles AS (SELECT file_id, f AS m FROM (SELECT file_id, f, row_number() OVER (PARTITION BY file_id ORDER BY f) AS r FROM coefficients WHERE k + l > 0) WHERE r = 128),
 bits AS (SELECT file_id, string_agg(CASE WHEN f > m THEN '1' ELSE '0' END, '' ORDER BY k, l) AS h FROM coefficients JOIN middles USING (file_id) GROUP BY file_id)"""
#: alike: the structural similarity of the pairs (a, b) of ``wanted``.
_SSIM = f"""pixels AS (SELECT a, b, y // 8 AS wy, x // 8 AS wx, p.v[{_AT}] AS u, q.v[{_AT}] AS w FROM (SELECT DISTINCT a, b FROM wanted) JOIN levels p ON p.file_id = a JOIN levels q ON q.file_id = b, range(32) AS ys(y), range(32) AS xs(x)),
 windows AS (SELECT a, b, wy, wx, avg(u) AS mu, avg(w) AS mw, var_samp(u) AS vu, var_samp(w) AS vw, covar_samp(u, w) AS c FROM pixels GROUP BY ALL),
 alike AS (SELECT a, b, floor(least(greatest(avg((2 * mu * mw + 6.5025::DOUBLE) * (2 * c + 58.5225::DOUBLE) / ((mu * mu + mw * mw + 6.5025::DOUBLE) * (vu + vw + 58.5225::DOUBLE))), 0), 1) * 100 + 0.5)::INT AS score FROM windows GROUP BY a, b)"""
_FAR = "bit_count(xor(p.h::BIT, q.h::BIT))"
_NEAR, _LIKE, _FRAME_RADIUS = 112, 45, 130  # for noise-like samples; real photos take the defaults


@query("q142_perceptual_hash", f"WITH {_LEVELS}, {_BITS} SELECT file_id, string_agg(substr('0123456789ABCDEF', d + 1, 1), '' ORDER BY k) AS hash FROM (SELECT file_id, k, (substr(h, 4 * k + 1, 1)::INT * 8 + substr(h, 4 * k + 2, 1)::INT * 4 + substr(h, 4 * k + 3, 1)::INT * 2 + substr(h, 4 * k + 4, 1)::INT)::INT AS d FROM bits, range(64) AS r(k)) GROUP BY file_id")
def _(t):
    return _samples(t).select("file_id", F.hex(fingerprint.perceptual_hash("sample")).alias("hash"))


@query("q144_ssim_of_neighbours", f"WITH {_LEVELS}, wanted AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id, a.vec_id + 1)), {_SSIM} SELECT a, b, score FROM alike")
def _(t):
    one = _samples(t)
    other = one.select(F.col("file_id").alias("b"), F.col("sample").alias("sample_b"), F.explode(F.array(F.col("file_id"), F.col("file_id") - 1)).alias("a"))
    return one.join(other, F.col("file_id") == F.col("a")).select("a", "b", fingerprint.ssim_percent("sample", "sample_b").alias("score"))


@query("q144_ssim_self", f"WITH {_LEVELS}, wanted AS (SELECT vec_id AS a, vec_id AS b FROM embeddings), {_SSIM} SELECT a AS file_id, score FROM alike")
def _(t):
    return _samples(t).select("file_id", fingerprint.ssim_percent("sample", "sample").alias("score"))


def _hashed(samples):
    rows = samples.withColumn("h", fingerprint.perceptual_hash("sample"))
    return rows.select("file_id", *fingerprint.hash_words("h"))


_APPROVED = f"{_LEVELS}, {_BITS}, wanted AS (SELECT p.file_id AS a, q.file_id AS b FROM bits p JOIN bits q ON p.file_id < q.file_id AND {_FAR} <= {_NEAR}), {_SSIM}, approved AS (SELECT a, b, score FROM alike WHERE score >= {_LIKE})"


def _approved(t):
    samples = _samples(t)
    return similarity.approved_pairs(_hashed(samples), samples, _NEAR, _LIKE)


@query("q150_photo_rebuild", f"WITH RECURSIVE {_APPROVED}, {pq._GREEDY.format(edges='approved')} SELECT cluster, file_id, position FROM clusters")
def _(t):
    samples = _samples(t)
    return similarity.linked_clusters(_hashed(samples), _NEAR, samples, _LIKE)


@query("q151_approved_pairs", f"WITH {_APPROVED} SELECT a, b, score FROM approved")
def _(t):
    return _approved(t)


def _frames(t):
    rows = _samples(t).withColumn("h", fingerprint.perceptual_hash("sample")).select((F.floor(F.col("file_id") / 4)).cast("long").alias("file_id"), (F.col("file_id") % 4).cast("int").alias("sample_index"), "sample", *fingerprint.hash_words("h"))
    return written(rows, "frames")


_VIDEOS = "frames AS (SELECT file_id // 4 AS file_id, file_id % 4 AS k, file_id AS vec FROM levels), clips AS (SELECT file_id, count(*) AS n, file_id % 40 AS d FROM frames GROUP BY file_id), wanted AS (SELECT x.file_id AS fa, y.file_id AS fb, least(3, x.n, y.n) AS quorum, i.vec AS a, j.vec AS b FROM clips x JOIN clips y ON x.file_id < y.file_id AND abs(x.d - y.d) <= 3 JOIN frames i ON i.file_id = x.file_id JOIN frames j ON j.file_id = y.file_id AND j.k = i.k)"


@query("q152_video_rebuild", f"""WITH {_LEVELS}, {_BITS}, {_VIDEOS}, {_SSIM},
 scores AS (SELECT fa, fb, quorum, list_sort(list(CASE WHEN {_FAR} <= {_FRAME_RADIUS} THEN score ELSE 0 END)) AS s FROM wanted JOIN alike USING (a, b) JOIN bits p ON p.file_id = a JOIN bits q ON q.file_id = b GROUP BY fa, fb, quorum)
 SELECT a, b, score FROM (SELECT fa AS a, fb AS b, floor(list_avg(CASE WHEN len(s) > 1 THEN s[2:] ELSE s END) + 0.5)::INT AS score FROM scores WHERE len(s) >= quorum) WHERE score >= 20""")
def _(t):
    frames = _frames(t)
    files_ = frames.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).select("file_id", (F.col("file_id") % 40).cast("double").alias("duration"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return similarity.approved_videos(files_, frames, radius=_FRAME_RADIUS, minimum=20)


@query("q056_aligned_frames", "SELECT a.vec_id // 4 AS a, b.vec_id // 4 AS b, a.vec_id % 4 AS sample_index, a.vec_id AS vec_a, b.vec_id AS vec_b FROM embeddings a JOIN embeddings b ON a.vec_id % 4 = b.vec_id % 4 AND b.vec_id // 4 = a.vec_id // 4 + 1")
def _(t):
    frames = t.embeddings.select(F.floor(F.col("vec_id") / 4).cast("long").alias("file_id"), (F.col("vec_id") % 4).alias("sample_index"), F.col("vec_id").alias("vec"))
    pairs = frames.select(F.col("file_id").alias("a"), (F.col("file_id") + 1).alias("b")).distinct()
    return similarity.aligned_frames(pairs, frames).select("a", "b", "sample_index", "vec_a", "vec_b")


_REBUILT = f"{pq._EDGES.replace('edges AS', 'wanted AS')}, {_LEVELS}, {_SSIM} SELECT a, b, score FROM alike WHERE score >= {_LIKE}"


@query("q155_add_arrivals", f"WITH {_REBUILT}")
def _(t):
    """Few newcomers meet what is covered: with the edges over covered rows these are the edges of a rebuild."""
    prints, samples = t.prints.drop("label"), _samples(t)
    covered = prints.filter("file_id % 5 <> 0")
    edges = similarity.approved_pairs(covered, samples, 21, _LIKE)
    return similarity.add_arrivals(prints, samples, edges, covered.select("file_id"), 21, _LIKE)[0]


@query("q155_rebuild_for_many_arrivals", f"WITH {_REBUILT}")
def _(t):
    """More newcomers than covered rows: everything anew, whatever the stored edges are."""
    prints, samples = t.prints.drop("label"), _samples(t)
    stored = t.spark.createDataFrame([(0, 1, 7)], "a long, b long, score int")
    return similarity.add_arrivals(prints, samples, stored, prints.filter("file_id % 5 = 0").select("file_id"), 21, _LIKE)[0]


@query("q157_published_version", "SELECT file_id, w0 FROM prints WHERE file_id % 2 = 0")
def _(t):
    """A whole version, one based on it, and one that is refused as it is based on what is no longer active."""
    table = files.Published(t.spark, new_path(t.spark, "published"))
    first = table.publish(t.prints)
    table.publish(t.prints.filter("file_id % 2 = 0"), based_on=first, incremental=True)
    with suppress(RuntimeError):
        table.publish(t.prints.filter("file_id % 3 = 0"), based_on=first, incremental=True)
    return table.read().select("file_id", "w0")


@query("q159_published_page", f"WITH {pq._EDGES.replace('edges AS', 'base AS')} SELECT b.a AS file_id, f.id IS NOT NULL AS actionable FROM (SELECT DISTINCT a FROM base) b LEFT JOIN files f ON f.id = b.a AND f.lifecycle_status = 'ACTIVE'")
def _(t):
    members = pq._edges(t).select(F.col("a").alias("file_id")).distinct()
    up = t.files.filter("lifecycle_status = 'ACTIVE'").select(F.col("id"))
    return members.join(up, F.col("file_id") == F.col("id"), "left").select("file_id", F.col("id").isNotNull().alias("actionable"))


@query("q163_fingerprint_inputs", "SELECT DISTINCT p.file_id, p.w0, p.w1 FROM prints p JOIN files f ON f.id = p.file_id WHERE f.file_type = 'PHOTO'")
def _(t):
    return p.member(t.prints, t.files.filter("file_type = 'PHOTO'"), "file_id").select("file_id", "w0", "w1").distinct()


@query("q164_rebuild_list", "SELECT id FROM files WHERE file_type = 'PHOTO' AND id NOT IN (SELECT file_id FROM videos) AND id NOT IN (SELECT file_id FROM metadata WHERE width IS NULL)")
def _(t):
    owed = t.files.filter("file_type = 'PHOTO'").select("id")
    done, gone = t.videos.select("file_id"), t.metadata.filter("width IS NULL").select(F.col("file_id").alias("g"))
    return owed.join(done, F.col("id") == F.col("file_id"), "left_anti").join(gone, F.col("id") == F.col("g"), "left_anti")


@query("q062_percent_rounding", "SELECT o_orderkey, floor(o_totalprice * 100 + 0.5) / 100 AS v FROM (SELECT o_orderkey, o_custkey / 8.0::DOUBLE AS o_totalprice FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_custkey") / F.lit(8.0), 2).alias("v"))


@query("q089_first_of_group", "SELECT folder, (array_agg(file_id ORDER BY path, file_id))[1] AS file_id FROM locations GROUP BY folder")
def _(t):
    return search.first_of_group(t.locations, "folder", "file_id", "path", "file_id")


@query("q091_first_of_run", "SELECT path, min(id) AS id FROM errors GROUP BY path")
def _(t):
    return search.first_of_run(t.errors, "path", [F.asc("id")]).select("path", "id")


@query("q092_positions", "SELECT sha256, id, row_number() OVER (PARTITION BY sha256 ORDER BY id) - 1 AS position FROM files")
def _(t):
    from pyspark.sql import Window

    return t.files.select("sha256", "id", (F.row_number().over(Window.partitionBy("sha256").orderBy("id")) - 1).cast("long").alias("position"))


@query("q093_duplicate_targets", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1 AS duplicate_target, max((l_returnflag = 'A')::INT) OVER (PARTITION BY l_partkey, l_suppkey) = 1 AS target_exists FROM lineitem")
def _(t):
    target = F.concat_ws("/", F.lit("T"), "l_partkey", "l_suppkey")
    items = t.lineitem.select("l_orderkey", "l_linenumber", F.concat_ws("/", F.lit("S"), "l_orderkey", "l_linenumber").alias("path"), target.alias("target"))
    there = t.lineitem.filter("l_returnflag = 'A'").select(F.lower(target).alias("path"))
    return planning.conflicts(items, there).select("l_orderkey", "l_linenumber", "duplicate_target", "target_exists")


@query("q100_cursor_codec", """SELECT o_orderkey AS id, stamp, rtrim(translate(base64(encode('{"k":"timeline","t":' || coalesce('"' || strftime(stamp, '%Y-%m-%dT%H:%M:%S') || '"', 'null') || ',"i":' || o_orderkey || '}')), '+/', '-_'), '=') AS cursor, true AS refused FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::TIMESTAMP END AS stamp FROM orders)""")
def _(t):
    at = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp_ntz"))
    rows = t.orders.select(paging.cursor_column("timeline", at, F.col("o_orderkey")).alias("cursor"))
    back = rows.select("cursor", paging.position_column(F.col("cursor"), "timeline").alias("p"), paging.position_column(F.col("cursor"), "map").alias("other"))
    return back.select("p.id", F.col("p.at").alias("stamp"), "cursor", F.col("other").isNull().alias("refused"))


@query("q102_limits", "SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars - 300 < 1 THEN 50 ELSE least(n_chars - 300, 250) END::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", paging.limit_of(F.col("n_chars") - 300).cast("long").alias("n"))


@query("q106_by_size", "SELECT id, row_number() OVER (ORDER BY size_bytes DESC, id DESC) AS k FROM files LEFT JOIN videos ON id = file_id WHERE lifecycle_status = 'ACTIVE' AND file_type = 'VIDEO' AND (lower(extension) IS DISTINCT FROM 'mp4' OR codec IS NULL OR upper(trim(codec)) NOT IN ('HEVC', 'H265', 'AV1'))")
def _(t):
    return mutations.with_ids(search.conversion_candidates(t.files, t.videos).select("id", "size_bytes"), [F.desc("size_bytes"), F.desc("id")], 1, "k").select("id", "k")


@query("q158_abandoned_versions", "SELECT id FROM executions WHERE status = 'RUNNING' AND started_at < TIMESTAMP '1996-06-01' - INTERVAL 24 HOUR")
def _(t):
    return mutations.abandoned(t.executions, F.col("status") == "RUNNING", "started_at", F.expr("TIMESTAMP_NTZ'1996-06-01 00:00:00'")).select("id")


@query("q186_recovery_reasons", "SELECT event_id, event_type = 'error' AS full_pass FROM events")
def _(t):
    from ..streaming import changes

    reason = F.when(F.col("event_type") == "error", "EVENTS_LOST").otherwise("NONE")
    return t.events.select("event_id", changes.needs_full_pass(reason).alias("full_pass"))


@query("q184_offline_backlog", "SELECT event_id FROM events e LEFT JOIN (SELECT user_id, (min(event_id) + max(event_id)) // 2 AS cursor FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING count(*) > 2) c ON c.user_id = e.user_id WHERE cursor IS NULL OR event_id > cursor")
def _(t):
    from ..streaming import changes

    cursors = t.events.filter("event_type <> 'error'").groupBy("user_id").agg(F.expr("(min(event_id) + max(event_id)) DIV 2").alias("cursor"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return changes.backlog(t.events, cursors.select("user_id", "cursor"), "user_id", "event_id").select("event_id")


@query("q188_cursor_advance", "SELECT user_id, greatest(c.cursor, w.captured) AS cursor FROM (SELECT user_id, min(event_id) + 100 AS cursor FROM events WHERE event_type = 'click' GROUP BY user_id) c FULL JOIN (SELECT user_id, max(event_id) AS captured FROM events WHERE event_type <> 'error' AND value < 60 GROUP BY user_id) w USING (user_id)")
def _(t):
    from ..streaming import changes

    cursors = t.events.filter("event_type = 'click'").groupBy("user_id").agg((F.min("event_id") + 100).alias("cursor"))
    walks = t.events.select("user_id", F.col("event_id").alias("captured"), F.coalesce((F.col("event_type") != "error") & (F.col("value") < 60), F.lit(False)).alias("complete"))
    return changes.advanced(cursors, walks, "user_id")


@query("q190_reconcile_due", "SELECT key, max(started_at) AS last FROM (SELECT coalesce(dedup_key, 'none') AS key, status, started_at FROM executions) GROUP BY key HAVING count(*) FILTER (status = 'RUNNING') = 0 AND max(started_at) <= TIMESTAMP '1998-06-01' - INTERVAL 5 MINUTE")
def _(t):
    from ..streaming import changes

    runs = t.executions.select(F.coalesce("dedup_key", F.lit("none")).alias("key"), "started_at", F.when(F.col("status") != "RUNNING", F.col("started_at")).alias("finished_at"))
    return changes.due(runs, "key", "started_at", "finished_at", F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'"))


@query("q182_lock_conflicts", "SELECT f.folder AS holder, l.file_id AS wanted FROM (SELECT DISTINCT folder FROM locations) f JOIN locations l ON starts_with(lower(l.path), lower(f.folder) || '/') OR lower(l.path) = lower(f.folder)")
def _(t):
    from ..operators import queue

    held = t.locations.select(F.col("folder").alias("id"), F.col("folder").alias("path")).distinct()
    return queue.lock_conflicts(held, t.locations.select(F.col("file_id").alias("id"), "path"))


@query("q191_progress", "SELECT status, count(*) AS n, sum(files_found)::BIGINT AS files_found, sum(files_moved)::BIGINT AS files_moved FROM executions GROUP BY status")
def _(t):
    return statistics.progress(t.executions, ["files_found", "files_moved"])


@query("q204_folder_properties", "SELECT count(*) AS files, count(DISTINCT folder) AS folders, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, greatest(count(DISTINCT folder) - 1, 0) AS subfolders FROM files JOIN locations ON id = file_id WHERE lifecycle_status = 'ACTIVE' AND (lower(folder) = 'd:/media' OR starts_with(lower(folder), 'd:/media/'))")
def _(t):
    return statistics.folder_summary(t.files, t.locations, "D:/Media")


@query("q212_convertible", "SELECT f.id, v.codec, l.path FROM files f JOIN videos v ON v.file_id = f.id LEFT JOIN locations l ON l.file_id = f.id WHERE f.public_id NOT IN (SELECT public_id FROM file_exclusions) AND lifecycle_status = 'ACTIVE'")
def _(t):
    rows = t.files.filter("lifecycle_status = 'ACTIVE'").join(t.file_exclusions, "public_id", "left_anti")
    own = lambda d, c: d.select(F.col("file_id").alias("id"), c)
    return rows.join(own(t.videos, "codec"), "id").join(own(t.locations, "path"), "id", "left").select("id", "codec", "path")


@query("q217_pin_ids", "SELECT c_custkey, rtrim(translate(base64(encode('BR' || chr(10) || coalesce(seg, '') || chr(10) || c_name || '?>~é')), '+/', '-_'), '=') AS pin, seg, c_name || '?>~é' AS name FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg FROM customer)")
def _(t):
    from ..operators import maps

    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    rows = t.customer.select("c_custkey", maps.pin_ids(F.lit("BR"), segment, F.concat("c_name", F.lit("?>~é"))).alias("pin"))
    parts = maps.parts_of_pins(F.col("pin"))
    return rows.select("c_custkey", "pin", parts[1].alias("seg"), parts[2].alias("name"))


_PLANS = "SELECT id, status, o.started_at + INTERVAL 30 DAY AS expires_at FROM executions o"


@query("q218_readable_plans", f"SELECT id FROM ({_PLANS}) WHERE status = 'FINISHED' AND expires_at > TIMESTAMP '1996-01-01'")
def _(t):
    rows = t.executions.withColumn("expires_at", F.col("started_at") + F.expr("INTERVAL 30 DAYS"))
    return rows.filter("status = 'FINISHED' AND expires_at > TIMESTAMP_NTZ'1996-01-01 00:00:00'").select("id")


@query("q219_publish_plan", "SELECT id, CASE WHEN status = 'RUNNING' THEN 'READY' ELSE status END AS status FROM executions")
def _(t):
    return mutations.set_where(t.executions, F.col("status") == "RUNNING", status=F.lit("READY")).select("id", "status")


@query("q220_plan_rows", "SELECT f.id, l.path, m.category FROM files f JOIN locations l ON l.file_id = f.id LEFT JOIN metadata m ON m.file_id = f.id WHERE lifecycle_status = 'ACTIVE' AND (lower(folder) = 'd:/media/src1' OR starts_with(lower(folder), 'd:/media/src1/'))")
def _(t):
    own = lambda d: d.withColumnRenamed("file_id", "id")
    rows = t.files.filter("lifecycle_status = 'ACTIVE'").join(own(t.locations), "id").join(own(t.metadata), "id", "left")
    return rows.filter(planning.candidate_filter(folder="D:/Media/src1")).select("id", "path", "category")


@query("q223_plans_with_conflicts", f"WITH {pq._ITEMS} SELECT count(*) FILTER (NOT same AND (duplicate_target OR target_exists)) > 0 AS refused FROM moved")
def _(t):
    return pq._items(t).agg((F.count_if(~F.col("same") & (F.col("duplicate_target") | F.col("target_exists"))) > 0).alias("refused"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("q231_catalogue_tables", f"SELECT table_name AS name, count(DISTINCT column_name) AS columns FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in _TABLES)}) GROUP BY table_name")
def _(t):
    for name in _TABLES:
        getattr(t, name).createOrReplaceTempView(f"introspected_{name}")
    return files.described(t.spark, "introspected_")


@query("q231_schema_version", "SELECT (array_agg(version ORDER BY id DESC))[1] AS version FROM executions WHERE status = 'FINISHED'")
def _(t):
    return mutations.current_version(t.executions.withColumn("ok", F.col("status") == "FINISHED"), "id", "version", "ok")


@query("q160_exact_reasons", "SELECT id, coalesce(manufacturer = 'Canon' OR date_source IN ('EXIF', 'MEDIA_INFO'), false) AND coalesce(subcategory, '') NOT IN ('WHATSAPP', 'AIRBRUSH', 'PHOTOGRID', 'SCREENSHOT') AS original FROM files LEFT JOIN metadata ON id = file_id")
def _(t):
    return t.files.join(t.metadata, F.col("id") == F.col("file_id"), "left").select("id", duplicates.original_signals(F.col("manufacturer") == "Canon", F.col("date_source"), F.col("subcategory")).alias("original"))


@query("q232_search_two_columns", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'auto')")
def _(t):
    return t.customer.filter(p.contains_ci(F.col("c_name"), "12") | p.contains_ci(F.col("c_mktsegment"), "AUTO")).select("c_custkey")


@query("q192_json_document", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def _(t):
    """Counts through a JSON document a conversation: written, read back with a schema."""
    doc = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("doc"))
    return doc.select("conv_id", F.size(F.from_json("doc", "array<struct<turn: long, role: string>>")).cast("long").alias("turns"))
