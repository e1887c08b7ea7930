"""Composite operators against plain Python, and incremental against whole runs."""

from __future__ import annotations

import json
import random
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import duplicates, geo, maps, mutations, planning, reconcile, similarity, statistics
from mediaquarry.sources import exports, files, walk
from mediaquarry.streaming import changes

WORDS = "file_id long, w0 long, w1 long, w2 long, w3 long"


def _prints(seed, n, spread=40):
    draw = random.Random(seed)
    bases = [[draw.getrandbits(63) for _ in range(4)] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(draw.choice(bases))
        for _ in range(draw.randint(0, spread)):
            w[draw.randrange(4)] ^= 1 << draw.randrange(62)
        rows.append((i, *w))
    return rows


def _distance(a, b):
    return sum(bin(x ^ y).count("1") for x, y in zip(a[1:], b[1:]))


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_radius_pairs(spark, block_rows):
    rows = _prints(1, 60)
    got = {(r["a"], r["b"]): r["distance"] for r in similarity.radius_pairs(spark.createDataFrame(rows, WORDS), 30, block_rows).collect()}
    want = {(a[0], b[0]): d for a in rows for b in rows if a[0] < b[0] and (d := _distance(a, b)) <= 30}
    assert got == want


def _greedy(near):
    """The sequential rule: each file joins the earliest cluster whose every member is its neighbour."""
    found: list = []
    for i in sorted(near):
        for cluster in found:
            if all(m in near[i] for m in cluster):
                cluster.append(i)
                break
        else:
            found.append([i])
    return sorted(c for c in found if len(c) > 1)


def _near(edges):
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _members(frame):
    got: dict = {}
    for r in frame.orderBy("position").collect():
        got.setdefault(r["cluster"], []).append(r["file_id"])
        assert r["position"] == len(got[r["cluster"]]) - 1
    assert all(c == members[0] for c, members in got.items())
    return sorted(got.values())


def _edge_frame(spark, edges):
    return spark.createDataFrame([(a, b, 97) for a, b in edges], "a long, b long, score int")


@pytest.mark.parametrize(("seed", "bound"), [(0, 500_000), (1, 12), (2, 60), (3, 25)])
def test_clusters(spark, seed, bound):
    """However few edges a task is handed, the clusters are those of the sequential rule."""
    draw = random.Random(seed)
    edges = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(70 if seed % 2 else 220)} | {(50, 51), (50, 52), (51, 52), (60, 61)}
    doubled = [*edges, *[(b, a) for a, b in list(edges)[:9]]]
    assert _members(similarity.clusters(_edge_frame(spark, doubled), bound)) == _greedy(_near(edges))
    assert similarity.clusters(_edge_frame(spark, [])).count() == 0


def test_clusters_of_a_long_chain_and_a_large_clique(spark):
    """Both are one component that no task is handed whole."""
    draw = random.Random(5)
    ids = draw.sample(range(10**6), 4000)
    chain = list(zip(ids, ids[1:]))
    clique = [(2 * 10**6 + a, 2 * 10**6 + b) for b in range(150) for a in range(b)]
    got = _members(similarity.clusters(_edge_frame(spark, [*chain, *clique]), 4000))
    assert got == _greedy(_near([*chain, *clique]))


def test_regrouping_what_changed(spark, monkeypatch):
    """After random changes the stored version is the one of everything anew, and untouched components are not opened."""
    draw = random.Random(8)
    edges = {tuple(sorted(draw.sample(range(30 * c, 30 * c + 12), 2))): 97 for c in range(8) for _ in range(14)}
    kept = similarity.Relations.over(spark.createDataFrame([(*e, s) for e, s in edges.items()], "a long, b long, score int"))
    seen = []
    whole = similarity.Relations.over.__func__
    monkeypatch.setattr(similarity.Relations, "over", classmethod(lambda cls, rows, n=similarity.EDGES_AT_ONCE: (seen.append(rows.count()), whole(cls, rows, n))[1]))
    for step in range(2):
        gone = draw.sample(sorted(e for e in edges if e[0] < 90), 3)
        new = {tuple(sorted((draw.randrange(30), 30 * step + draw.randrange(12)))): 98 for _ in range(2)}
        new = {e: s for e, s in new.items() if e[0] != e[1]}
        for e in gone:
            del edges[e]
        edges |= new
        kept = kept.changed(spark.createDataFrame([(*e, s) for e, s in new.items()], "a long, b long, score int"), spark.createDataFrame(gone, "a long, b long"))
        assert {(r["a"], r["b"]): r["score"] for r in kept.edges.collect()} == edges
        assert _members(kept.members) == _greedy(_near(edges))
        roots = {r["node"]: r["root"] for r in kept.nodes.collect()}
        assert roots.keys() == _near(edges).keys() and all(roots[a] == roots[b] for a, b in edges)
    assert max(seen) < len(edges) * 0.7


def test_groups_by_wasted_bytes(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (5, 6), (7, 7), (7, 8)], "cluster long, file_id long")
    verdicts = spark.createDataFrame([(1, 9, "KEEP"), (2, 10, "DELETE_CANDIDATE"), (5, 9, "KEEP"), (6, 90, "REVIEW"), (7, 1, "KEEP"), (8, 30, "DELETE_CANDIDATE"), (9, 9, "KEEP")], "file_id long, size_bytes long, verdict string")
    assert [tuple(r) for r in similarity.ranked_groups(members, verdicts).orderBy("place").collect()] == [(1, 7, 2, 30), (2, 1, 2, 10), (3, 5, 2, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_arrivals_equal_a_rebuild(spark, seed):
    draw = random.Random(seed)
    rows = _prints(seed, 18, 20)
    base = np.random.default_rng(seed).integers(0, 256, 1024)
    samples = [(r[0], bytearray(np.clip(base + draw.choice([0, 1, 60]), 0, 255).astype(np.uint8).tobytes())) for r in rows if r[0] != 5]
    prints, marks = spark.createDataFrame(rows, WORDS), spark.createDataFrame(samples, "file_id long, sample binary")
    edges, coverage = spark.createDataFrame([], "a long, b long, score int"), spark.createDataFrame([], "file_id long")
    order = [r[0] for r in rows]
    draw.shuffle(order)
    seen: list = []
    for step in (order[:7], order[7:12], order[12:]):
        seen += step
        some = prints.filter(F.col("file_id").isin(seen))
        edges, coverage = similarity.add_arrivals(some, marks, edges, coverage, 40, 90)
        edges, coverage = edges.cache(), coverage.cache()
        whole = similarity.approve(similarity.radius_pairs(some, 40), marks, 90)
        assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, whole.collect()))
    left, covered = similarity.forget(edges, coverage, spark.createDataFrame([(order[0],)], "file_id long"))
    assert all(order[0] not in (r["a"], r["b"]) for r in left.collect()) and covered.count() == len(rows) - 1


def test_video_gates(spark):
    videos = spark.createDataFrame([(1, 10.0, 1920, 1080), (2, 12.9, 1920, 1080), (3, 13.5, 1920, 1080), (4, None, 1920, 1080), (5, None, 1080, 1920), (6, None, None, None), (7, 10.5, 1080, 1920)], "file_id long, duration double, width int, height int")
    assert {tuple(r) for r in similarity.band_pairs(videos).collect()} == {(1, 2), (2, 3), (4, 6), (5, 6)}


def test_video_scores(spark):
    flat = lambda v: bytearray([v] * 1024)
    frames = [(f, k, 0, 0, 0, 0, flat(v)) for f, values in ((1, (10, 20, 30, 40)), (2, (10, 20, 30, 250)), (3, (10, 20))) for k, v in enumerate(values)]
    table = spark.createDataFrame(frames, "file_id long, sample_index int, w0 long, w1 long, w2 long, w3 long, sample binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {tuple(r) for r in similarity.video_scores(pairs, table).collect()} == {(1, 2, 100), (1, 3, 100)}


def test_keep_policy(spark):
    fields = "grp long, file_id long, has_camera boolean, subcategory string, width int, height int, date_source string, capture_date timestamp_ntz"
    day = datetime(2020, 1, 1)
    rows = [
        (1, 1, True, "CAMERA", 100, 100, "EXIF", day), (1, 2, False, "WHATSAPP", 400, 400, "EXIF", day),  # an original before a larger copy
        (2, 3, True, None, 10, 10, "EXIF", day), (2, 4, False, None, 20, 20, "MEDIA_INFO", day),  # two originals: no clear one
        (3, 5, False, None, None, 10, "FILE_NAME", None), (3, 6, False, None, None, None, "FILE_NAME", day),  # none at all
        (4, 7, False, "PHOTOGRID", 900, 900, "FILE_NAME", day), (4, 8, False, "DRONE", 9, 9, "UNKNOWN", None),  # no copy's subcategory comes before pixels
    ]
    got = {r["file_id"]: (r["verdict"], r["reason"]) for r in duplicates.keep_ranking(spark.createDataFrame(rows, fields), "grp", exact=False).collect()}
    unclear = "REVIEW_NO_CLEAR_ORIGINAL"
    assert got == {1: ("KEEP", "ORIGINAL"), 2: ("DELETE_CANDIDATE", "WHATSAPP_COPY"), 4: ("KEEP", "ORIGINAL"), 3: ("REVIEW", unclear), 6: ("KEEP", unclear), 5: ("REVIEW", unclear), 8: ("KEEP", unclear), 7: ("REVIEW", unclear)}
    sure = {r["file_id"]: (r["verdict"], r["reason"]) for r in duplicates.keep_ranking(spark.createDataFrame(rows, fields), "grp", exact=True).collect()}
    assert sure[3] == ("DELETE_CANDIDATE", "IDENTICAL_COPY") and sure[6] == ("KEEP", "BEST_IN_GROUP") and sure[7] == ("DELETE_CANDIDATE", "EDITED_COPY")


def _square(w, s, e, n):
    return [[[w, s], [e, s], [e, n], [w, n], [w, s]]]


def _boundaries(spark):
    rows = [(1, "COUNTRY", "Brazil", "BR", None, (-74.0, -34.0, -34.0, 5.0)), (2, "STATE", "Paraná", "BR", None, (-54.0, -27.0, -48.0, -22.0)), (3, "CITY", "Curitiba", "BR", "Paraná", (-49.55, -25.6, -49.18, -25.35)), (4, "CITY", "Pinhais", "BR", "Paraná", (-49.18, -25.6, -49.10, -25.35))]
    return spark.createDataFrame([(i, k, n, c, s, b[1], b[0], b[3], b[2], _square(*b)) for i, k, n, c, s, b in rows], f"boundary_id long, kind string, name string, country_code string, state_name string, south double, west double, north double, east double, rings {geo.RINGS}")


def test_geocoding(spark):
    points = spark.createDataFrame([(-25.388262, -49.228512), (-30.0, -20.0), (-25.475, -49.055), (0.0, 0.0), (95.0, 1.0)], "lat double, lon double")
    got = {r["lat"]: r for r in geo.geocode(points, _boundaries(spark)).collect()}
    assert len(got) == 3
    r = got[-25.3883]
    assert (r["city"], r["state"], r["country"], r["confidence"]) == ("Curitiba", "Paraná", "BR", "VERY_HIGH")
    assert got[-30.0]["open_sea"] and got[-30.0]["confidence"] == "VERY_LOW"
    assert got[-25.475]["kind"] == "STATE"
    cities = _boundaries(spark).filter("kind = 'CITY'")
    r = {x["lat"]: x for x in geo.geocode(points, cities).collect()}[-25.475]
    assert (r["city"], r["state"], r["confidence"]) == ("Pinhais", "Paraná", "LOW") and 3 < r["distance_km"] < 7


def test_geometry():
    square = _square(0.0, 0.0, 10.0, 10.0)
    holed = square + _square(4.0, 4.0, 6.0, 6.0)
    assert geo.inside(5, 5, square) and not geo.inside(5, 5, holed) and not geo.inside(0, 5, square) and not geo.inside(11, 5, square)
    assert geo.area(holed) == 96.0
    assert geo.distance_km(5, 5, square) == 0.0 and abs(geo.distance_km(0, 11, square) - 111.19) < 0.1
    lat, lon = geo._interior(holed)
    assert geo.inside(lat, lon, holed)


def test_map_pins(spark):
    fields = "id long, public_id string, file_type string, lifecycle_status string, latitude double, longitude double, capture_date timestamp_ntz, country_name string, state_name string, city_name string, open_sea boolean"
    t = lambda m, d: datetime(2024, m, d)
    rows = [(1, "p1", "PHOTO", "ACTIVE", -23.55051, -46.63334, t(5, 1), None, "Paraná", "Curitiba", None), (2, "p2", "PHOTO", "ACTIVE", -23.55049, -46.63326, t(5, 2), None, None, None, None), (3, "p3", "VIDEO", "ACTIVE", -23.55052, -46.63331, t(5, 3), None, None, None, None), (4, "p4", "PHOTO", "ACTIVE", 10.0, 20.0, t(1, 1), None, None, None, None), (6, "p6", "PHOTO", "ACTIVE", None, None, t(1, 1), "BR", "Paraná", "Londrina", None), (7, "p7", "VIDEO", "ACTIVE", None, None, t(1, 2), "BR", "Paraná", "Londrina", None), (8, "p8", "PHOTO", "ACTIVE", None, None, t(1, 3), "BR", "São Paulo", None, None)]
    frame = spark.createDataFrame(rows, fields)
    pins = maps.grid_pins(frame, 0.001).orderBy(F.desc("total")).collect()
    assert len(pins) == 2 and (pins[0]["photos"], pins[0]["videos"], pins[0]["cover"], pins[0]["city_name"]) == (2, 1, "p3", "Curitiba")
    lone = {r["city_name"]: r for r in maps.region_pins(frame).collect()}
    assert lone["Londrina"]["total"] == 2 and lone["Londrina"]["cover"] == "p7"
    assert [r["id"] for r in maps.region_items(frame, "BR", "São Paulo", None).collect()] == [8]
    assert [r["id"] for r in maps.cell_items(frame, pins[0]["lat"], pins[0]["lon"], 0.001).collect()] == [3, 2, 1]
    pin = maps.pin_id("BR", None, "São Paulo")
    assert maps.pin_parts(pin) == ["BR", None, "São Paulo"]


def test_rename_ambiguity(spark):
    a, b = datetime(2020, 1, 1), datetime(2020, 1, 2)
    gone = spark.createDataFrame([(1, 5, "x", a), (2, 7, "y", a), (3, 7, "y", b), (4, 9, "z", a)], "id long, size_bytes long, sha256 string, created_at timestamp_ntz")
    new = spark.createDataFrame([("/1", 5, "x", b), ("/2", 7, "y", b), ("/3", 7, "y", a), ("/4", 9, "z", a), ("/5", 9, "z", a)], "path string, size_bytes long, sha256 string, created_at timestamp_ntz")
    assert {tuple(r) for r in reconcile.renames(gone, new).collect()} == {(1, "/1"), (2, "/3"), (3, "/2")}


def test_renames_within_a_hot_content(spark):
    """Very many empty files: times that only one new file has decide, all others stay."""
    t = lambda k: datetime(2020, 1, 1, k // 60, k % 60)
    gone = spark.createDataFrame([(k, 0, "e", t(k % 300)) for k in range(600)] + [(1000, 0, "e", None)], "id long, size_bytes long, sha256 string, created_at timestamp_ntz")
    new = spark.createDataFrame([(f"/{k}", 0, "e", t(k)) for k in range(200)] + [(f"/again{k}", 0, "e", t(k)) for k in range(50)] + [("/none", 0, "e", None)], "path string, size_bytes long, sha256 string, created_at timestamp_ntz")
    assert {tuple(r) for r in reconcile.renames(gone, new).collect()} == {(k, f"/{k}") for k in range(50, 200)}


def test_upsert_of_ties(spark):
    """Equal stamps: the new row, and of several new ones always the same, however they are dealt."""
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old"), (3, 9, "old")], "id long, at long, v string")
    new = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 5, "z"), (3, 8, "new"), (4, None, "new")], "id long, at long, v string")
    found = [sorted(map(tuple, mutations.upsert(old, n, ["id"], ["at"]).collect())) for n in (new, new.repartition(5), new.orderBy(F.desc("v")))]
    assert found[0] == found[1] == found[2]
    assert [r[0] for r in found[0]] == [1, 2, 3, 4] and found[0][0][2] in "xyz" and found[0][2][2] == "old"


def test_cursors_and_timers(spark):
    cursors = spark.createDataFrame([("a", 5), ("b", 9)], "k string, cursor long")
    rows = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1), ("c", 1)], "k string, seq long")
    assert sorted(map(tuple, changes.backlog(rows, cursors, "k", "seq").collect())) == [("a", 6), ("c", 1)]
    walks = spark.createDataFrame([("a", 7, True), ("a", 8, False), ("b", 3, True), ("c", 2, True), ("d", 1, False)], "k string, captured long, complete boolean")
    assert sorted(map(tuple, changes.advanced(cursors, walks, "k").collect())) == [("a", 7), ("b", 9), ("c", 2)]
    t = lambda m: datetime(2024, 1, 1, 0, m)
    runs = spark.createDataFrame([("x", t(0), t(1)), ("y", t(0), None), ("z", t(3), t(4))], "root string, s timestamp_ntz, f timestamp_ntz")
    assert [r["root"] for r in changes.due(runs, "root", "s", "f", F.lit(t(6)).cast("timestamp_ntz")).collect()] == ["x"]


def test_timer_runs_a_full_pass(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    run = changes.on_timer(ticks, lambda batch, n: seen.append(batch.count()), str(tmp_path / "c"), "1 second")
    run.processAllAvailable()
    run.stop()
    assert seen == [3]


def test_locks(spark):
    from mediaquarry.operators import queue

    held = spark.createDataFrame([(1, "D:/a/b"), (2, "D:/c")], "id long, path string")
    want = spark.createDataFrame([(10, "D:/a"), (11, "d:/A/B"), (12, "D:/a/b/c"), (13, "D:/a/bb"), (14, "D:/c/x"), (15, "E:/c")], "id long, path string")
    assert sorted(map(tuple, queue.lock_conflicts(held, want).collect())) == [(1, 10), (1, 11), (1, 12), (2, 14)]


def test_organisation_rules(spark):
    cases = [("CELLPHONE", "D:/x/a.jpg", "a.jpg", "CAMERA", 90, "DATABASE"), (None, "D:/DJI/a.jpg", "IMG_1.jpg", "DRONE", 20, "FOLDER"), ("AIRBRUSH", "D:/x/a", "GOPR1.mp4", "GOPRO", 30, "FILE_NAME"), ("CAMERA", "D:/x/a", "IMG-1-WA2.jpg", "WHATSAPP", 10, "FILE_NAME"), ("AIRBRUSH", "D:/x/a", "a", "OTHER", 999, "UNKNOWN"), (None, None, None, "OTHER", 999, "UNKNOWN")]
    frame = spark.createDataFrame(cases, "known string, path string, name string, label string, priority int, reason string")
    got = frame.select(*planning.classified(F.col("known"), F.col("path"), F.col("name"))).collect()
    assert [tuple(r) for r in got] == [c[3:] for c in cases]
    labels = frame.select(planning.subcategory(F.col("name"), F.col("path"))).collect()
    assert [r[0] for r in labels] == ["UNKNOWN", "DRONE", "GOPRO", "WHATSAPP", "UNKNOWN", "UNKNOWN"]


def test_conflicts_must_be_allowed(spark):
    items = spark.createDataFrame([(1, "a", "X/1", 3), (2, "b", "x/1", 3), (3, "c", "c", 3)], "id long, path string, target string, size_bytes long")
    marked = planning.conflicts(items, spark.createDataFrame([], "path string"))
    assert {r["id"]: r["duplicate_target"] for r in marked.collect()} == {1: True, 2: True, 3: False}
    with pytest.raises(ValueError):
        planning.require_no_conflicts(marked, allowed=False)
    planning.require_no_conflicts(marked, allowed=True)
    assert planning.plan_statistics(marked).first()["organised"] == 1


def test_ids_are_consecutive(spark):
    got = mutations.with_ids(spark.range(1000).repartition(7), [F.desc("id")], 5, "k").collect()
    assert {r["k"]: r["id"] for r in got} == {5 + i: 999 - i for i in range(1000)}


def test_phase_pivot(spark):
    rows = spark.createDataFrame([(1, "A", 5), (1, "A", 6), (2, "B", 3), (9, "C", 1)], "execution_id long, phase string, millis long")
    assert {tuple(r) for r in statistics.phase_pivot(rows, [1, 2]).collect()} == {("A", 11, 0, 11), ("B", 0, 3, 3)}


def test_file_scan(spark, tmp_path):
    for name in ("a.jpg", "b.TXT", "sub/c.jpg", "skip me/d.jpg", ".hidden/e.jpg", "f.lnk"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    found = files.scan(spark, str(tmp_path), exclude=["txt"], folders=["skip*"])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.jpg", "c.jpg"]
    assert files.scan(spark, str(tmp_path), include=["TXT"]).count() == 1
    import hashlib

    hashes = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.with_hashes(spark, str(tmp_path)).collect()}
    assert hashes["a.jpg"] == hashlib.sha256(b"a.jpg").hexdigest()


def test_walk_of_a_tree(spark, tmp_path):
    """The same files however many folders the driver opens; links, hidden and excluded folders are not entered."""
    import os

    want = set()
    for k in range(60):
        path = tmp_path / f"d{k % 3}" / f"Sub{k % 4}" / ("x" * (k % 2)) / f"f{k}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"z" * k)
        if k % 4 != 3:
            want.add((str(path), k))
    (tmp_path / "empty").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "hidden").write_bytes(b"")
    os.symlink(tmp_path / "d0", tmp_path / "linked")
    os.symlink(tmp_path / "d0" / "Sub0" / "f0.bin", tmp_path / "link.bin")
    for splits in (1, 4, 300):
        found = walk.tree(spark, str(tmp_path), ["SUB3"], splits=splits)
        assert {(r["path"], r["length"]) for r in found.collect()} == want
    assert walk.tree(spark, f"file://{tmp_path}", ["sub3"]).count() == len(want)
    assert walk.tree(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="absent"):
        walk.tree(spark, str(tmp_path / "absent")).count()


def test_hashes_of_large_and_lost_files(spark, tmp_path):
    """Above 2 GB, in bounded memory; tasks are planned by bytes; a file that is gone has nulls."""
    import hashlib
    import tracemalloc

    sizes = {"large": (1 << 31) + 5, "empty": 0, **{f"s{k}": 1000 * k for k in range(1, 40)}}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    zeros, sha = bytes(1 << 24), hashlib.sha256()
    for at in range(0, sizes["large"], len(zeros)):
        sha.update(zeros[: sizes["large"] - at])
    rows = walk.tree(spark, str(tmp_path)).select("path", "length").unionByName(spark.createDataFrame([(f"{tmp_path}/gone", 5), (None, None)], "path string, length long"))
    got = {r["path"] and r["path"].rsplit("/", 1)[1]: r for r in walk.hashed(rows, str(tmp_path), task_bytes=1 << 19).withColumn("part", F.spark_partition_id()).collect()}
    assert got["large"]["sha256"] == sha.hexdigest() and got["large"]["read_bytes"] == sizes["large"]
    assert got["gone"]["sha256"] is None and got[None]["md5"] is None
    assert all(got[n]["md5"] == hashlib.md5(bytes(s)).hexdigest() for n, s in sizes.items() if n != "large")
    loads: dict = {}
    for r in got.values():
        loads[r["part"]] = loads.get(r["part"], 0) + (r["length"] or 0) + walk.OPEN_BYTES
    assert len(loads) > 3 and all(n <= (1 << 19) + sizes["large"] * (got["large"]["part"] == p) + 100_000 for p, n in loads.items())
    with open(tmp_path / "s1", "wb") as f:
        f.truncate(400 << 20)
    tracemalloc.start()
    walk.digests(walk.Store(str(tmp_path)), f"{tmp_path}/s1")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * walk.CHUNK
    assert walk.hashed(rows.limit(0), str(tmp_path)).count() == 0


def test_boundaries_from_geojson(spark, tmp_path):
    square = _square(-200.0, 0.0, 10.0, 10.0)
    features = [{"type": "Feature", "properties": {"shapeName": "ParanÃ¡  x", "shapeGroup": "bra"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"shapeName": "two", "shapeGroup": "BRA"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, _square(20.0, 0.0, 30.0, 95.0)]}}, {"type": "Feature", "properties": {"shapeName": "pt", "shapeGroup": "BRA"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"shapeName": "who", "shapeGroup": "ZZZ"}, "geometry": {"type": "Polygon", "coordinates": square}}]
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {r["name"]: r for r in files.read_boundaries(spark, str(tmp_path / "b.json"), "STATE", {"BRA": "BR"}).collect()}
    assert set(rows) == {"Paraná x", "two"} and rows["two"]["north"] == 90.0 and rows["two"]["west"] == -180.0 and len(rows["two"]["rings"]) == 2
    assert files.import_boundaries([files.read_boundaries(spark, str(tmp_path / "b.json"), "STATE", {"BRA": "BR"})], str(tmp_path / "t")) == 2
    with pytest.raises(ValueError):
        files.import_boundaries([files.read_boundaries(spark, str(tmp_path / "b.json"), "STATE", {})], str(tmp_path / "t"))


def test_publishing(spark, tmp_path):
    table = files.Published(spark, str(tmp_path / "p"))
    assert table.active() is None
    first = table.publish(spark.range(3))
    second = table.publish(spark.range(5), based_on=first, incremental=True)
    assert table.read().count() == 5
    with pytest.raises(RuntimeError):
        table.publish(spark.range(7), based_on=first, incremental=True)
    assert table.active() == second
    assert first in table.sweep(0, 1 << 50) and table.read().count() == 5


def test_lost_races_of_publishers(spark, tmp_path, monkeypatch):
    """Two publishers that saw the same active version: the second is refused; of two whole versions the later one counts."""
    one, two = (files.Published(spark, str(tmp_path / "p")) for _ in range(2))
    first = one.publish(spark.range(1))
    stale = two._latest()
    won = one.publish(spark.range(2), based_on=first, incremental=True)
    calls = iter([stale])
    monkeypatch.setattr(two, "_latest", lambda: next(calls, None) or files.Published._latest(two))
    with pytest.raises(RuntimeError):
        two.publish(spark.range(3), based_on=first, incremental=True)
    assert one.active() == won and one.read().count() == 2
    calls = iter([stale])
    last = two.publish(spark.range(4))
    assert one.active() == last and one.read().count() == 4
    one.sweep(1 << 50, 0)
    assert one.active() == last and sum(p.name.startswith("ACTIVE-") and p.name.endswith(".json") for p in (tmp_path / "p").iterdir()) == 1


def test_undo_follows_chains(spark):
    """Against a walk over the movements, latest first."""
    draw = random.Random(4)
    names = [f"p{k}" for k in range(12)] + [None]
    moves = [(k, draw.choice(names[:12]) if k % 17 else None, draw.choice(names[:12]), draw.choice(["MOVED", "MOVED", "UNDONE", None])) for k in range(60)]
    here = set(draw.sample(names[:12], 6))
    frame = spark.createDataFrame(moves, "id long, source string, target string, status string")
    got = mutations.undo(frame.filter("id < 24"), spark.createDataFrame([(p,) for p in here], "path string"))
    short, disk = [], set(here)
    for i, source, target, status in sorted((m for m in moves if m[0] < 24), reverse=True):
        good = status != "UNDONE" and source is not None and target in disk and source not in disk
        disk = disk - {target} | {source} if good else disk
        short.append((i, "SKIPPED" if status == "UNDONE" else "UNDONE" if good else "ERROR"))
    assert sorted((r["id"], r["status"]) for r in got.collect()) == sorted(short)


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_band_pairs_of_popular_and_unknown_durations(spark, cell_rows):
    draw = random.Random(6)
    rows = [(k, draw.choice([None, None, 60.0, 60.0, draw.uniform(0, 90)]), draw.choice([1920, 1900, 1080, None]), 1080) for k in range(160)]
    like = lambda a, b: a is None or b is None or abs(a - b) / max(a, b) <= 0.12
    shape = lambda r: r[2] / r[3] if r[2] else None
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] is None) == (b[1] is None) and (a[1] is None or abs(a[1] - b[1]) <= 3) and like(shape(a), shape(b))}
    got = [tuple(r) for r in similarity.band_pairs(spark.createDataFrame(rows, "file_id long, duration double, width int, height int"), cell_rows=cell_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("n", "piece"), [(0, 100), (5000, 700), (5000, 1 << 20)])
def test_zip_of_many_pieces(spark, tmp_path, n, piece):
    """However it is cut into pieces, the document and its checksum are right, and items are in order."""
    rows = spark.range(n).select((n - F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("ü")).repartition(5)
    size = exports.write_zip('{"name":"é"}', rows, ["k"], f"{tmp_path}/in/plan.zip", piece_bytes=piece)
    with zipfile.ZipFile(tmp_path / "in" / "plan.zip") as z:
        assert z.testzip() is None and z.namelist() == ["plan.json"] and z.getinfo("plan.json").file_size == size
        told = json.loads(z.read("plan.json"))
    assert told["plan"] == {"name": "é"} and [x["k"] for x in told["items"]] == list(range(1, n + 1))


def test_checksums_of_texts_in_a_row():
    import zlib

    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"one", b"two" * 1000), (bytes(70000), bytes(range(256)))):
        assert exports.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"\n'), (2, None)], "id long, name string")
    assert [r["value"] for r in exports.csv_lines(rows, ["id", "name"]).collect()] == ['1,"a,""b""\n"', "2,"]
    size = exports.write_zip('{"id":9}', rows, ["id"], str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert len(z.read("plan.json")) == size
        assert json.loads(z.read("plan.json")) == {"plan": {"id": 9}, "items": [{"id": 1, "name": 'a,"b"\n'}, {"id": 2, "name": None}]}
    exports.write_csv(rows, ["id", "name"], str(tmp_path / "c"))
    exports.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


JOURNAL = "seq long, file_ref long, path string, reason_flags int, directory boolean"


def test_journal(spark):
    c = changes
    rows = [(1, 1, "D:/M/a", c.CREATED, False), (2, 2, "E:/b", c.CREATED, False), (3, 3, "D:/M/n", 0x80, False), (4, 4, "D:/M/old", c.RENAMED_OLD, False), (5, 4, "D:/M/new", c.RENAMED_NEW, False), (6, 5, "D:/M/out", c.RENAMED_OLD, False), (7, 5, "E:/out", c.RENAMED_NEW, False), (8, 6, "E:/in", c.RENAMED_OLD, False), (9, 6, "D:/M/in", c.RENAMED_NEW, False), (10, 7, "D:/M/lone", c.RENAMED_OLD, False), (11, 8, "D:/M/dir", c.CREATED, True), (12, 9, "D:/M/dir2", c.RENAMED_OLD, True), (13, 9, "D:/M/dir3", c.RENAMED_NEW, True), (14, 1, "D:/M/a", c.DELETED, False)]
    got = {tuple(r) for r in changes.interpreted(spark.createDataFrame(rows, JOURNAL), "D:/M").collect()}
    assert got == {("D:/M/a", "CHECK"), ("D:/M/old", "CHECK"), ("D:/M/new", "CHECK"), ("D:/M/out", "CHECK"), ("D:/M/in", "CHECK"), ("D:/M/lone", "CHECK"), ("D:/M", "RECONCILE")}


def test_stream_of_changes(spark, tmp_path):
    fields = "path string, ts timestamp_ntz, size long"
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([("a", t(0), 1), ("a", t(1), 2), ("b", t(1), 1), ("a", t(30), 3)], fields).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    run = stream.writeStream.foreachBatch(changes.upsert_into(str(tmp_path / "table"), ["path"], ["ts"])).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["path"], r["size"]) for r in changes.read_upserted(spark, str(tmp_path / "table")).collect()} == {("a", 3), ("b", 1)}
    # a batch again changes nothing, a later one only what it touches
    sink = changes.upsert_into(str(tmp_path / "table"), ["path"], ["ts"])
    sink(spark.read.parquet(str(tmp_path / "in")), 0)
    sink(spark.createDataFrame([("b", t(40), 9), ("c", t(2), 5), ("a", t(3), 8)], fields), 1)
    assert sorted((r["path"], r["size"]) for r in changes.read_upserted(spark, str(tmp_path / "table")).collect()) == [("a", 3), ("b", 9), ("c", 5)]
    bursts = changes.debounced(stream, "ts", "path").writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    bursts.awaitTermination(120)
    batch = changes.debounced(spark.read.parquet(str(tmp_path / "in")), "ts", "path").collect()
    assert sorted((r["path"], r["changes"]) for r in batch) == [("a", 1), ("a", 2), ("b", 1)]
