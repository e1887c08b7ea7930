"""Scalar functions, rules and fingerprints against hand-made cases and plain Python."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry.functions import dates, fingerprint, media, names
from mediaquarry.functions import predicates as p
from mediaquarry.operators import paging

NOW = datetime(2026, 12, 1)


def at(*parts):
    return datetime(*parts)


#: One or two names for each rule and for what it refuses, made up from the rules' descriptions.
NAMES = [
    ("img-20210304-wa0012.jpeg", at(2021, 3, 4)), ("VID_x-20191231-WA7.mp4", at(2019, 12, 31)), ("trip 20210304-WA0012.jpg", at(2021, 3, 4)), ("doc-nodate-WA5.pdf", None),
    ("airbrush-20180706-050403.png", at(2018, 7, 6, 5, 4, 3)), ("AirBrush20180706050403x.png", at(2018, 7, 6, 5, 4, 3)), ("AIRBRUSH 20180706.png", at(2018, 7, 6)),
    ("PhotoGrid_1500000000123.png", at(2017, 7, 14, 2, 40, 0, 123000)), ("photogrid-20170102_030405.png", at(2017, 1, 2, 3, 4, 5)), ("PhotoGrid_2999999999999.png", None),
    ("FB_IMG_1600000000000.jpg", at(2020, 9, 13, 12, 26, 40)), ("FaceApp_1600000000000.jpg", at(2020, 9, 13, 12, 26, 40)), ("fb_img_x.jpg", None),
    ("screenrecord-20220228-235959.mp4", at(2022, 2, 28, 23, 59, 59)), ("Captura 20220301.png", at(2022, 3, 1)), ("Screenshot_20220301_250000.png", at(2022, 3, 1)),
    ("peachy_20160229_111213.jpg", at(2016, 2, 29, 11, 12, 13)), ("image_20160229_111213_a.jpg", at(2016, 2, 29, 11, 12, 13)),
    ("2013-06-05 04.03.02.mp4", at(2013, 6, 5, 4, 3, 2)), ("2013-06-05_04-03-02 b.mp4", at(2013, 6, 5, 4, 3, 2)), ("2013-06-05 b.mp4", None),
    ("minutes 2012.11.10 final.odt", at(2012, 11, 10)), ("99. 2011.02.03 and 2012.02.03.txt", at(2011, 2, 3)), ("2012.00.10.txt", None), ("release 4.10.11.zip", None),
    ("051423101112 cam.avi", at(2023, 5, 14, 10, 11, 12)), ("0514231011.avi", None), ("051020201112.avi", None), ("133023101112.avi", None),
    ("a20140708b.tif", at(2014, 7, 8)), ("dsc 20140708_091011.tif", at(2014, 7, 8, 9, 10, 11)), ("20140708091011.tif", at(2014, 7, 8, 9, 10, 11)), ("x18500101.tif", None), ("x29990101.tif", None), ("x20141301.tif", None),
    ("x99999999 then 20140708.tif", at(2014, 7, 8)), ("x20150231.tif", at(2015, 2, 28)), ("x20160230.tif", at(2016, 2, 29)), ("x20140732.tif", None), ("plain.tif", None),
]


def test_file_name_dates(spark):
    rows = spark.createDataFrame([(n,) for n, _ in NAMES], "name string").select("name", dates.from_file_name(F.col("name"), NOW).alias("at")).collect()
    assert {r["name"]: r["at"] for r in rows} == dict(NAMES)


def test_folder_dates(spark):
    cases = [("D:/a/202105/09/camera/imagens/x.jpg", at(2021, 5, 9)), ("D:\\a\\202105\\09\\WHATS\\Videos\\x.mp4", at(2021, 5, 9)), ("D:/202105/31/gopro/outros/x", at(2021, 5, 31)), ("D:/202106/31/gopro/outros/x", None), ("D:/202105/9/camera/imagens/x", None), ("D:/202105/09/mine/imagens/x", None), ("D:/202105/09/camera/jpg/x", None), ("x.jpg", None), ("D:/999912/01/camera/imagens/x", None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "p string").select("p", dates.from_folders(F.col("p"), NOW).alias("at")).collect()
    assert {r["p"]: r["at"] for r in rows} == dict(cases)


def test_file_types(spark):
    cases = [("jpg", None, "PHOTO"), (" .JPEG ", "application/pdf", "PHOTO"), ("yaml", None, "TEXT"), ("amr", "", "AUDIO"), ("7z", None, "SEVEN_Z"), ("odt", None, "OTHER"), (None, "image/png", "OTHER"), ("x", "VIDEO/mp4", "OTHER"), ("", "text/html; charset=x", "TEXT"), ("", "Application/XML", "TEXT"), ("", "application/vnd.ms-excel.x", "EXCEL"), (None, None, "OTHER")]
    rows = spark.createDataFrame(cases, "e string, m string, t string").select("e", "m", "t", names.file_type(F.col("e"), F.col("m")).alias("got"), names.category_of(F.col("t")).alias("c")).collect()
    assert [r["got"] for r in rows] == [c[2] for c in cases]
    assert {r["t"]: r["c"] for r in rows} == {"PHOTO": "MEDIA", "TEXT": "DOCUMENT", "AUDIO": "MEDIA", "SEVEN_Z": "ARCHIVE", "OTHER": "OTHER", "EXCEL": "DOCUMENT"}


def test_failure_reasons(spark):
    cases = [(b"", "CORRUPTED_FILE"), (bytes(700), "CORRUPTED_FILE"), (b"\xff\xd8x", "DECODER_REFUSED"), (b"RIFF0000WEBPVP8X", "UNSUPPORTED_FORMAT"), (b"RIFF0000WEBPVP8 ", "DECODER_REFUSED"), (b"RIFF0000WAVE", "NOT_AN_IMAGE"), (b"<html>", "NOT_AN_IMAGE"), (b"BM", "DECODER_REFUSED"), (None, "UNKNOWN")]
    rows = spark.createDataFrame([(None if c is None else bytearray(c), r) for c, r in cases], "c binary, r string").select("r", media.failure_of_bytes(F.col("c")).alias("got"), media.is_terminal(F.col("r")).alias("last")).collect()
    assert [r["got"] for r in rows] == [r for _, r in cases] and all(r["last"] == (r["r"] != "UNKNOWN") for r in rows)


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_names(spark):
    cases = [("a.JPG", "jpg", "a"), ("a.tar.gz", "gz", "a.tar"), ("none", "", "none"), ("dot.", "", "dot"), (".hidden", "hidden", ".hidden")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "n string").select("n", names.extension(F.col("n")).alias("e"), names.base_name(F.col("n")).alias("b")).collect()
    assert [(r["n"], r["e"], r["b"]) for r in rows] == cases
    assert [_one(spark, names.human_size(F.lit(v))) for v in (0, 1023, 1024, 1536, 5 * 1024**3)] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 GB"]
    assert _one(spark, names.folder_name(F.lit(' a<b>\t c... '))) == "a b c"
    assert _one(spark, names.coordinate_key(F.lit(0.0), F.lit(0.0))) is None


def test_sizes_of_terabytes(spark):
    cases = [(1024**4 - 1, "1024.00 GB"), (1024**4, "1.00 TB"), (3 * 1024**5, "3.00 PB"), (2**62, "4.00 EB"), (1157, "1.13 KB")]
    assert [_one(spark, names.human_size(F.lit(v))) for v, _ in cases] == [label for _, label in cases]
    assert _one(spark, names.human_size(F.lit(2514 * 1024**3), ("KB", "MB", "GB"))) == "2514.00 GB"


def test_paths(spark):
    rows = spark.createDataFrame([(x,) for x in ("D:\\Pictures\\one.png", "D:\\Pictures\\old\\two.png", "D:\\three.png", "D:\\Pictures2\\four.png", "d:/pictures/five_5.png")], "path string")
    assert rows.filter(p.under(F.col("path"), "D:\\Pictures")).count() == 3
    assert rows.filter(p.under(F.col("path"), "D:\\")).count() == 5
    assert rows.filter(p.under(F.col("path"), "D:\\Picture_")).count() == 0


def test_excluded_folders(spark):
    rows = spark.createDataFrame([(x,) for x in ("E:/Arc/k", "E:/Arc/k/deep/er", "E:/Arc/kk", "E:/Arc/k_k/deep", "E:/Arc/k-k/deep", "E:\\Arc\\k", "E:/Arc/k%", None)], "folder string")
    gone = lambda f: {r["folder"] for r in p.without_excluded_folders(rows, spark.createDataFrame([(f,)], "f string"), "folder", "f").collect()}
    everything = {r["folder"] for r in rows.collect()}
    assert everything - gone("E:/Arc/k") == {"E:/Arc/k", "E:/Arc/k/deep/er", "E:\\Arc\\k"}
    assert everything - gone("E:\\Arc\\k_k") == {"E:/Arc/k_k/deep"}
    assert everything - gone("E:/Arc/k%") == {"E:/Arc/k%"}


def test_cursors():
    text = paging.encode_cursor("timeline", at(2024, 1, 2, 3), 7)
    assert paging.decode_cursor(text, "timeline") == (at(2024, 1, 2, 3), 7)
    for bad in ("???", text[:-3], ""):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad, "timeline")
    with pytest.raises(ValueError):
        paging.decode_cursor(text, "map")


def test_cursors_as_columns(spark):
    rows = [(at(2024, 1, 2, 3), 7), (None, -5), (at(1999, 12, 31, 23, 59, 59), 2**62)]
    frame = spark.createDataFrame(rows, "at timestamp_ntz, id long").select("*", paging.cursor_column("timeline", F.col("at"), F.col("id")).alias("c"))
    found = frame.select("*", paging.position_column(F.col("c"), "timeline").alias("p"), paging.position_column(F.col("c"), "map").alias("q")).collect()
    assert [(r["p"]["at"], r["p"]["id"], r["q"]) for r in found] == [(*r, None) for r in rows]
    assert [r["c"] for r in found] == [paging.encode_cursor("timeline", *r) for r in rows]
    assert spark.range(1).select(paging.position_column(F.lit("?!"), "map").alias("p")).first()["p"] is None


def test_probe_details(spark):
    assert _one(spark, media.iso6709(F.lit("+48.8577+002.295/")))["longitude"] == 2.295
    for bad in ("+0+0/", "91+10", "+95.0+010.0/", "x" * 80):
        assert _one(spark, media.iso6709(F.lit(bad))) is None
    assert [_one(spark, media.rotation_of_orientation(F.lit(k))) for k in range(1, 9)] == [0, 0, 180, 180, 90, 90, 270, 270]


def test_ssim():
    flat = lambda v: np.full((1, 1024), v, np.uint8)
    assert fingerprint.ssim(flat(120), flat(120))[0] == 100
    assert fingerprint.ssim(flat(0), flat(255))[0] < 10
    assert fingerprint.ssim(flat(120), flat(125))[0] >= 95
    draw = np.random.default_rng(0)
    a, b = (draw.integers(0, 256, (5, 1024)).astype(np.uint8) for _ in range(2))
    for i in range(5):
        total = []
        for y in range(0, 32, 8):
            for x in range(0, 32, 8):
                u, v = (m[i].reshape(32, 32)[y : y + 8, x : x + 8].astype(float).ravel() for m in (a, b))
                cov = ((u - u.mean()) * (v - v.mean())).sum() / 63
                total.append((2 * u.mean() * v.mean() + 6.5025) * (2 * cov + 58.5225) / ((u.mean() ** 2 + v.mean() ** 2 + 6.5025) * (u.var(ddof=1) + v.var(ddof=1) + 58.5225)))
        assert fingerprint.ssim(a, b)[i] == int(min(max(np.mean(total), 0), 1) * 100 + 0.5)


def test_perceptual_hash(spark):
    draw = np.random.default_rng(1)
    sample = draw.integers(0, 256, (3, 1024)).astype(np.uint8)
    near = np.clip(sample.astype(int) + 6, 0, 255).astype(np.uint8)
    a, b = fingerprint.hashes(sample), fingerprint.hashes(near)
    bits = np.unpackbits(a ^ b, axis=1).sum(1)
    assert (bits < 40).all() and np.unpackbits(a[0] ^ a[1]).sum() > 80
    n = np.arange(32)
    i = 2
    low = [sum(sample[i].reshape(32, 32)[y, x] * np.cos(np.pi * (2 * y + 1) * k / 64) * np.cos(np.pi * (2 * x + 1) * q / 64) for y in n for x in n) * (np.sqrt(0.5) if k == 0 else 1) * (np.sqrt(0.5) if q == 0 else 1) for k in range(16) for q in range(16)]
    middle = sorted(low[1:])[255 // 2]
    assert np.packbits(np.array(low) > middle).tobytes() == a[i].tobytes()
    frame = spark.createDataFrame([(bytearray(sample[0].tobytes()),)], "s binary")
    row = frame.select(fingerprint.perceptual_hash("s").alias("h")).select("h", *fingerprint.hash_words("h")).first()
    assert bytes(row["h"]) == a[0].tobytes() and row["w1"] & (2**64 - 1) == int.from_bytes(a[0].tobytes()[8:16])


def test_settings_list():
    assert p.settings_list(" a, b;c\r\nd ;; ") == ["a", "b", "c", "d"]


def test_frame_positions(spark):
    assert _one(spark, media.frame_positions(F.lit(10.0), 5)) == [1000, 3000, 5000, 7000, 9000]
    assert random.Random(0)
