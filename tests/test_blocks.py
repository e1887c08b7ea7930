"""Packed blocks against the operators that list all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from mediaquarry.functions import fingerprint
from mediaquarry.operators import grids, similarity

WORDS = "file_id long, w0 long, w1 long, w2 long, w3 long"


def _prints(seed, n, spread):
    """Hashes around some centres, so that there are pairs, cliques and chains."""
    draw = random.Random(seed)
    centres = [[draw.getrandbits(64) for _ in range(4)] for _ in range(max(1, n // 12))]
    flip = lambda w: w ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, spread)))
    signed = lambda w: (w & (2**64 - 1)) - (1 << 64 if w & (1 << 63) else 0)
    ids = draw.sample(range(10 * n), n)
    return [(i, *(signed(flip(w)) for w in draw.choice(centres))) for i in ids]


def _samples(seed, ids):
    """Noise around few pictures; the last has none."""
    draw = np.random.default_rng(seed)
    pictures = draw.integers(0, 256, (5, 1024))
    made = {i: np.clip(pictures[draw.integers(5)] + draw.normal(0, draw.integers(1, 60), 1024), 0, 255).astype(np.uint8).tobytes() for i in ids}
    return [(i, None if i == max(ids) else s) for i, s in made.items()]


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_percents(dense):
    """Products of all, and of the wanted pairs only, give what ``ssim`` gives."""
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 256, (2, 40, 1024)).astype(np.uint8)
    b[:20] = np.clip(a[:20] + draw.normal(0, 20, (20, 1024)), 0, 255)
    b[20], a[21], b[21] = a[20], 7, 7
    i, j = np.divmod(np.arange(1600), 40)
    left, right = fingerprint.Windows(a), fingerprint.Windows(b)
    got = fingerprint.percents(left, right, slice(None), slice(None), i, j, dense, 100)
    assert got.tolist() == fingerprint.ssim(a[i], b[j]).tolist() and got[20 * 40 + 20] == got[21 * 40 + 21] == 100
    rows, others = np.array([5, 9, 20]), np.array([20, 3])
    assert fingerprint.percents(left, right, rows, others, np.array([2, 0]), np.array([0, 1]), dense).tolist() == fingerprint.ssim(a[[20, 5]], b[[20, 3]]).tolist()


@pytest.mark.parametrize(("seed", "n", "block_rows"), [(1, 90, 7), (2, 90, 40), (3, 1, 5), (4, 0, 5)])
def test_approved_pairs(spark, seed, n, block_rows):
    rows = _prints(seed, n, 8)
    prints = spark.createDataFrame(rows, WORDS)
    samples = spark.createDataFrame(_samples(seed, [r[0] for r in rows]) if rows else [], "file_id long, sample binary")
    want = sorted(map(tuple, similarity.approve(similarity.radius_pairs(prints, 40), samples, 30).select("a", "b", "score").collect()))
    got = similarity.approved_pairs(prints, samples, 40, 30, block_rows)
    assert sorted(map(tuple, got.select("a", "b", "score").collect())) == want and (n < 2 or want)
    new, old = prints.filter("file_id % 3 = 0"), prints.filter("file_id % 3 <> 0")
    fresh = similarity.approve(similarity.arrival_pairs(new, old, 40), samples, 30).select("a", "b", "score").collect()
    assert sorted(map(tuple, similarity.approved_arrivals(new, old, samples, 40, 30, block_rows).select("a", "b", "score").collect())) == sorted(map(tuple, fresh))


@pytest.mark.parametrize(("seed", "at_once", "block_rows", "radius"), [(1, 25, 6, 40), (2, 30, 200, 30), (3, 1000, 9, 40), (4, 40, 3, 256)])
def test_linked_clusters(spark, seed, at_once, block_rows, radius):
    """Rounds of few files, and blocks that cut clusters; at radius 256 all is one cluster."""
    rows = _prints(seed, 100, 10)
    prints = spark.createDataFrame(rows, WORDS)
    want = sorted(map(tuple, similarity.clusters(similarity.radius_pairs(prints, radius)).collect()))
    assert sorted(map(tuple, similarity.linked_clusters(prints, radius, files_at_once=at_once, block_rows=block_rows).collect())) == want and want
    samples = spark.createDataFrame(_samples(seed, [r[0] for r in rows]), "file_id long, sample binary")
    approved = sorted(map(tuple, similarity.clusters(similarity.approve(similarity.radius_pairs(prints, radius), samples, 30)).collect()))
    assert sorted(map(tuple, similarity.linked_clusters(prints, radius, samples, 30, at_once, block_rows).collect())) == approved != want


def test_no_files(spark):
    assert similarity.linked_clusters(spark.createDataFrame([], WORDS), 40).collect() == []


def test_pairs_within(spark):
    prints = spark.createDataFrame(_prints(5, 60, 6), WORDS)
    groups = prints.selectExpr("file_id", "file_id % 4 AS g").filter("g < 3")
    want = [tuple(r) for r in similarity.radius_pairs(prints, 256).collect() if r["a"] % 4 == r["b"] % 4 < 3]
    assert sorted(map(tuple, similarity.pairs_within(prints, groups, "g").collect())) == sorted(want)


@pytest.mark.parametrize(("seed", "block_rows", "quorum", "drop"), [(1, 12, 3, 1), (2, 500, 2, 0), (3, 5, 4, 2)])
def test_approved_videos(spark, seed, block_rows, quorum, drop):
    """Popular and unknown durations, unknown shapes, indices that only one of two has, frames given twice."""
    draw = random.Random(seed)
    videos = [(i, draw.choice([None, 3.0, 3.0, 6.0, 6.5, 40.0, 42.9]), draw.choice([1920, 1920, 1900, 640, None]), 1080) for i in range(45)]
    frames = [(i, k) for i in range(47) for k in draw.sample(range(6), draw.randint(0, 5))]
    frames += draw.sample(frames, 5) + [(3, None)]
    marks = dict(_samples(seed, range(len(frames) + 1)))
    words = [r[1:] for r in sorted(_prints(seed, len(frames), 12))]
    table = spark.createDataFrame([(i, k, marks[n], *words[n]) for n, (i, k) in enumerate(frames)], "file_id long, sample_index int, sample binary, w0 long, w1 long, w2 long, w3 long")
    told = spark.createDataFrame(videos, "file_id long, duration double, width int, height int")
    want = similarity.video_scores(similarity.band_pairs(told), table, 120, quorum, drop, 10).select("a", "b", "score").collect()
    got = similarity.approved_videos(told, table, radius=120, quorum=quorum, drop=drop, minimum=10, block_rows=block_rows).select("a", "b", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_a_short_sample_is_an_error(spark):
    rows = _prints(1, 3, 2)
    samples = spark.createDataFrame([(r[0], b"short") for r in rows], "file_id long, sample binary")
    with pytest.raises(Exception, match="a sample has 5 bytes"):
        similarity.approved_pairs(spark.createDataFrame(rows, WORDS), samples, 256).collect()


def test_each_two_blocks_once(spark):
    for n in range(1, 8):
        table = spark.range(n).selectExpr("CAST(id AS int) AS l_block").crossJoin(spark.range(n).selectExpr("CAST(id AS int) AS r_block"))
        got = sorted((min(r), max(r)) for r in map(tuple, table.filter(grids.half(n)).collect()))
        assert got == [(a, b) for a in range(n) for b in range(a, n)]
