"""Streams with state against their batch form, and the journal source over restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediaquarry.streaming import changes, journal, state

START = datetime(2024, 5, 1)
ROWS = "file_ref long, seq long, path string, reason_flags int, directory boolean, happened_at timestamp"


@pytest.fixture(autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_state_store(spark)
    yield
    spark.conf.set(key, before)


def _dealt(spark, rows, schema, folder, batches):
    """Rows as files, one a micro-batch."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:04d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{folder}/*")


def _run(spark, frame, tmp_path, name):
    frame.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}.cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}")


def _collected(frame, tmp_path, name):
    """Rows of a stream; batches may be handed over twice, so they are kept by number."""
    found: dict = {}

    def keep(batch, number):
        found[number] = [tuple(r) for r in batch.collect()]

    query = frame.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return [r for rows in found.values() for r in rows]


def _journal_rows(n=240, seed=1):
    draw, rows, seq = random.Random(seed), [], 0
    names = [f"{d}/{k}" for d in ("D:/M", "d:/m/sub", "E:/x") for k in range(6)]
    while len(rows) < n:
        ref, folder = draw.randint(0, 25), draw.random() < 0.15
        flags = draw.choice([changes.CREATED, changes.DELETED, changes.TRUNCATED, 0x8000, changes.RENAMED_OLD, changes.RENAMED_OLD, changes.RENAMED_NEW])
        rows.append((ref, seq, draw.choice([*names, None]) if draw.random() < 0.05 else draw.choice(names), flags, folder, START + timedelta(seconds=seq)))
        seq += 1
        if flags == changes.RENAMED_OLD and draw.random() < 0.8:  # its other half, now or many records later
            for _ in range(draw.choice([0, 0, 3, 40])):
                rows.append((99, seq, "D:/M/between", changes.EXTENDED, False, START + timedelta(seconds=seq)))
                seq += 1
            rows.append((ref, seq, draw.choice(names), changes.RENAMED_NEW, folder, START + timedelta(seconds=seq)))
            seq += 1
    return rows


@pytest.mark.parametrize("batches", [1, 7])
def test_renames_over_batches(spark, tmp_path, batches):
    """However a journal is cut into batches, what is reported is what one batch reports."""
    rows = _journal_rows()
    want = {tuple(r) for r in changes.interpreted(spark.createDataFrame(rows, ROWS), "D:/M").collect()}
    last = (1000, 10**6, "E:/end", changes.CREATED, False, START + timedelta(days=1))
    stream = _dealt(spark, [*rows, *[last] * batches], ROWS, str(tmp_path / "in"), batches + 1)
    got = _collected(state.interpreted(stream, "D:/M", wait_ms=10_000), tmp_path, "cp")
    assert set(got) == want and ("D:/M", "RECONCILE") in want


def test_split_renames_are_paired(spark, tmp_path):
    """Old name in one batch, new one in the next: within, into and out of the root, of a folder; and one that never comes."""
    old, new = changes.RENAMED_OLD, changes.RENAMED_NEW
    at = lambda k: START + timedelta(seconds=k)
    first = [(1, 1, "D:/M/a", old, False, at(0)), (2, 2, "E:/b", old, False, at(0)), (3, 3, "D:/M/c", old, False, at(0)), (4, 4, "E:/folder", old, True, at(0)), (5, 5, "D:/M/lost", old, False, at(0))]
    second = [(1, 6, "D:/M/a2", new, False, at(2)), (2, 7, "D:/M/b2", new, False, at(2)), (3, 8, "E:/c2", new, False, at(2)), (4, 9, "D:/M/folder", new, True, at(2))]
    stream = _dealt(spark, [*first, *second, (9, 10, "E:/z", 0x8000 | changes.CREATED, False, at(900))], ROWS, str(tmp_path / "in"), 2)
    got = _collected(state.interpreted(stream, "D:/M"), tmp_path, "cp")
    assert sorted(got) == [("D:/M", "RECONCILE"), ("D:/M/a", "CHECK"), ("D:/M/a2", "CHECK"), ("D:/M/b2", "CHECK"), ("D:/M/c", "CHECK"), ("D:/M/lost", "CHECK")]


@pytest.mark.parametrize("seed", [1, 2])
def test_own_writes_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    moment = lambda: START + timedelta(milliseconds=draw.randint(0, 3_000_000))
    made = [(f"p{draw.randint(0, 12)}", moment(), k) for k in range(300)]
    own = [(f"p{draw.randint(0, 20)}", moment()) for _ in range(40)]
    told = spark.createDataFrame(made, "path string, at timestamp, id long"), spark.createDataFrame([(p, a, 1) for p, a in own], "path string, announced_at timestamp, execution_id long")
    nobody = spark.createDataFrame([], "execution_id long")
    want = {r["id"] for r in changes.foreign(*told, nobody, "path", "at", "5 minutes", "10 seconds").collect()}
    assert 20 < len(want) < 280
    draw.shuffle(made)
    draw.shuffle(own)
    end = START + timedelta(days=1)
    a = _dealt(spark, [*made, *[("end", end, 10_000 + k) for k in range(60)]], "path string, at timestamp, id long", str(tmp_path / "a"), 6)
    b = _dealt(spark, [*own, *[("end2", end)] * 8], "path string, at timestamp", str(tmp_path / "b"), 6)
    got = [r[2] for r in _collected(state.foreign(a, b, late="2 hours"), tmp_path, "cp") if r[2] < 10_000]
    assert sorted(got) == sorted(want)


def test_a_running_writer_prolongs(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    plans = spark.createDataFrame([(7, "p"), (8, "q")], "execution_id long, path string")
    beats = _dealt(spark, [(7, at(m)) for m in range(0, 20, 4)] + [(8, at(0))] + [(9, at(2000))] * 6, "execution_id long, at timestamp", str(tmp_path / "h"), 3)
    made = _dealt(spark, [("p", at(19), 1), ("q", at(19), 2), ("p", at(40), 3), ("z", at(3000), 4), ("z", at(3000), 5), ("z", at(3000), 6)], "path string, at timestamp, id long", str(tmp_path / "c"), 3)
    own = state.prolonged(beats, plans).unionByName(spark.readStream.schema("path string, at timestamp").parquet(_ended(spark, tmp_path)))
    got = {r[2] for r in _collected(state.foreign(made, own, late="1 hour"), tmp_path, "cp")}
    assert got - {4, 5, 6} == {2, 3}


def _ended(spark, tmp_path):
    spark.createDataFrame([("end", START + timedelta(days=30))], "path string, at timestamp").write.parquet(f"{tmp_path}/ended")
    return f"{tmp_path}/ended"


def _changes(spark, numbers):
    rows = [(k, k % 5, f"D:/M/{k}", changes.CREATED, False, START + timedelta(seconds=k)) for k in numbers]
    return spark.createDataFrame(rows, "seq long, file_ref long, path string, reason_flags int, directory boolean, happened_at timestamp")


def test_journal_restarts(spark, tmp_path):
    """Stop and restart loses and repeats nothing; offsets are those of the segments' names."""
    folder = str(tmp_path / "j")
    journal.create(folder, "one")
    seen = []
    for k in range(3):
        assert journal.append(_changes(spark, range(100 * k, 100 * k + 100)), folder, segment_rows=30) == 100
        _run(spark, journal.stream(spark, folder), tmp_path, "out")
        seen.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert seen == [100, 200, 300]
    _run(spark, journal.stream(spark, folder), tmp_path, "out")  # nothing new
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["seq"] for r in rows) == list(range(300)) and {r["path"] for r in rows} == {f"D:/M/{k}" for k in range(300)}
    assert len(journal.Journal(folder).segments()) == 12 and journal.Journal(folder).end() == {"journal": "one", "next": 300}


def test_journal_recovery(spark, tmp_path):
    """Truncated, replaced and holed journals say so, and ask for a full pass."""
    folder = str(tmp_path / "j")
    journal.create(folder, "one")
    for k in range(4):
        journal.append(_changes(spark, range(10 * k, 10 * k + 10)), folder)
    cursor = str(tmp_path / "cursor.json")
    journal.commit_cursor(cursor, {"journal": "one", "next": 15})
    told = lambda: [(r["seq"], r["recovery"]) for r in journal.offline_backlog(spark, folder, cursor).orderBy("seq").collect()]
    assert told() == [(k, None) for k in range(15, 40)]
    hole = journal.Journal(folder)
    middle = hole.segments()[2][2]
    kept = open(middle, "rb").read()
    hole.store.delete(middle)
    assert told() == [(None, "INCOMPLETE")] + [(k, None) for k in [*range(15, 20), *range(30, 40)]]
    open(middle, "wb").write(kept)
    journal.truncate(folder, 20)
    assert told() == [(None, "EVENTS_LOST")] + [(k, None) for k in range(20, 40)]
    journal.create(folder, "two")
    rows = journal.offline_backlog(spark, folder, cursor)
    assert [r["recovery"] for r in rows.filter(changes.needs_full_pass(F.col("recovery"))).collect()] == ["UNREPLAYABLE"]
    out = _run(spark, journal.stream(spark, folder, cursor), tmp_path, "out")
    assert out.filter("recovery = 'UNREPLAYABLE'").count() == 1 and out.count() == 21


def test_cursor_moves_with_complete_walks(spark, tmp_path):
    folder, cursor = str(tmp_path / "j"), str(tmp_path / "c" / "cursor.json")
    journal.create(folder, "one")
    journal.append(_changes(spark, range(10)), folder)
    assert not journal.walked(folder, cursor, lambda: False) and journal.read_cursor(cursor) is None

    def walk():  # changes that come meanwhile are after the cursor
        journal.append(_changes(spark, range(10, 15)), folder)
        return True

    assert journal.walked(folder, cursor, walk)
    assert sorted(r["seq"] for r in journal.offline_backlog(spark, folder, cursor).collect()) == list(range(10, 15))
    assert journal.commit_cursor(cursor, {"journal": "one", "next": 3}) == {"journal": "one", "next": 10}
    assert journal.append(_changes(spark, []), folder) == 0 and journal.Journal(folder).end()["next"] == 15


def test_own_writes_of_a_busy_path(spark, tmp_path):
    """Thousands of changes and announcements of one path: each change only meets the announcements of about its time."""
    made = [("p", START + timedelta(seconds=7 * k), k) for k in range(4000)]
    own = [("p", START + timedelta(seconds=900 * k)) for k in range(30)]
    covered = lambda at: any(a - timedelta(seconds=10) <= at <= a + timedelta(seconds=300) for _, a in own)
    end = START + timedelta(days=3)
    spark.createDataFrame([*made, ("end", end, 10_000)], "path string, at timestamp, id long").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([*own, ("end2", end)], "path string, at timestamp").write.parquet(str(tmp_path / "b"))
    streams = spark.readStream.schema("path string, at timestamp, id long").parquet(str(tmp_path / "a")), spark.readStream.schema("path string, at timestamp").parquet(str(tmp_path / "b"))
    made_foreign = state.foreign(*streams, late="2 hours")
    # no row goes through a Python worker, and a path is dealt by slots of time
    plan = made_foreign._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "slot" in plan
    got = [r[2] for r in _collected(made_foreign, tmp_path, "cp") if r[2] < 10_000]
    assert sorted(got) == [k for _, at, k in made if not covered(at)]
