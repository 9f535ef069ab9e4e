import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carteel.operators import imaging, labels, spatial
from carteel.plans import pipelines
from carteel.sources import files, sinks, text
from carteel.streaming import ingest


def test_control_table(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Name,New_E,New_N,Old_E,Old_N,Height\nA,630000.5,189000,1130000,140000,12.5\nB, 1 ,2,,,\nC,x,2,3,4,5\n", encoding="utf-8")
    points, skipped = text.read_control_table(spark, str(tmp_path / "p.csv"))
    got = {r.name: r for r in points.collect()}
    assert got["A"].easting_6991 == 189000 and got["A"].northing_6991 == 630000.5 and got["A"].height == "12.5"
    assert (got["B"].old_e, got["B"].old_n, got["B"].height) == (0.0, 0.0, "") and [r.name for r in skipped.collect()] == ["C"]


def test_world_files(spark, tmp_path):
    (tmp_path / "M1.tfwx").write_text("\n0.8453\n0.0012\n-0.0009\n-0.8421\n\n139250.5\n1130420.25\n")
    (tmp_path / "M2.tfwx").write_text("1\n2\nx\n")
    (tmp_path / "M3.tfwx").write_text("1\n1\n1\n1\n0\n0\n")
    got = {r.map_id: r for r in text.read_world_files(spark, str(tmp_path / "*.tfwx")).collect()}
    assert (got["M1"].b, got["M1"].c, got["M1"].f, got["M1"].reject_reason) == (0.0012, -0.0009, 1130420.25, None)
    assert got["M2"].reject_reason == "fewer than six numbers" and got["M3"].reject_reason == "singular"
    sinks.write_world_files(text.read_world_files(spark, str(tmp_path / "M1.tfwx")), str(tmp_path / "out"))
    (written,) = (tmp_path / "out").glob("map_id=M1/part-*")
    assert written.read_text() == "0.8453000000\n0.0012000000\n-0.0009000000\n-0.8421000000\n139250.500000\n1130420.250000\n"


def test_control_points(spark, tmp_path):
    (tmp_path / "M1_control_points.txt").write_text("mapX,mapY,pixelX,pixelY,enable\n1.5,2.5,0,0,0\n\n3,4,0,0,\n5,6\n")
    got = sorted((r.map_id, r.map_x, r.map_y, r.enable) for r in text.read_control_points(spark, str(tmp_path / "*.txt")).collect())
    assert got == [("M1", 1.5, 2.5, 0), ("M1", 3.0, 4.0, 1)]
    (tmp_path / "bad.csv").write_text("h\nx,2,0,0,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_control_points(spark, str(tmp_path / "bad.csv")).collect()


def test_points_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("srcX srcY mapX mapY\n1.0 2.0 189000 630000\n200000,640000,5,6,0\n3 4\n")
    got = sorted((r.map_x, r.map_y) for r in text.read_points_files(spark, str(tmp_path / "a.txt")).collect())
    assert got == [(189000.0, 630000.0), (200000.0, 640000.0)]
    assert sorted((r.map_x, r.map_y) for r in text.read_points_files(spark, str(tmp_path / "a.txt"), "old").collect())[0] == (1.0, 2.0)


def test_aux(spark, tmp_path):
    def xml(source, target):
        side = lambda name, v: f"<n:{name} xmlns:n='u'>" + "".join(f"<D>{x}</D>" for x in v) + f"</n:{name}>"
        return "<R>" + side("XSourceGCPs", source) + side("TargetGCPs", target) + "</R>"

    (tmp_path / "M1.aux.xml").write_text(xml(range(6), range(10, 16)))
    (tmp_path / "M2.aux.xml").write_text(xml(range(5), range(5)))
    (tmp_path / "M3.aux.xml").write_text(xml(range(4), range(4)))
    (tmp_path / "M4.aux.xml").write_text("<R>")
    got = sorted((r.map_id, r.i, r.source_x, r.source_y, r.target_x, r.target_y) for r in text.read_aux_gcps(spark, str(tmp_path / "*.xml")).collect())
    assert got == [("M1", 1, 0, 1, 10, 11), ("M1", 2, 2, 3, 12, 13), ("M1", 3, 4, 5, 14, 15)]


def test_json(spark, tmp_path):
    marks = {"map": "M1", "file": "f", "cnn_threshold": 0.7, "detections": [{"x": 1, "y": 2, "cnn": 0.9, "source": "t"}], "manual_marks": [{"x": 3, "y": 4, "cnn": None, "source": "m"}], "false_positives": []}
    (tmp_path / "m.json").write_text(json.dumps(marks))
    rows = text.read_marks(spark, str(tmp_path / "m.json"))
    assert sorted((r.kind, r.x, r.cnn) for r in rows.collect()) == [("detection", 1.0, 0.9), ("manual", 3.0, None)]
    again = json.loads(sinks.marks_json(rows).first().value)
    assert again["detections"] == [{"x": 1.0, "y": 2.0, "cnn": 0.9, "source": "t"}] and again["manual_marks"][0]["cnn"] is None and again["false_positives"] == []
    (tmp_path / "l.json").write_text('{"a.png": "pos"}')
    (tmp_path / "r.json").write_text('["x.png", "y.png"]')
    assert text.read_labels(spark, str(tmp_path / "none.json"), str(tmp_path / "l.json")).collect()[0][:] == ("a.png", "pos")
    assert text.read_labels(spark, str(tmp_path / "none.json")).count() == 0 and text.read_rejects(spark, str(tmp_path / "r.json")).count() == 2


def png(h, w, dpi=None):
    raw = zlib.compress(b"".join(b"\0" + bytes(w * 3) for _ in range(h)))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    phys = chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) if dpi else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + phys + chunk(b"IDAT", raw) + chunk(b"IEND", b"")


def test_listings_and_images(spark, tmp_path):
    for name in ("s1/M1/M1.png", "s1/M1/M1.tfw", "s1/M1/M1.tfwx", "s1/M1/M1_control_points.txt", "s2/M2/M2.png", "s2/M2/M2.png.aux.xml", "s2/other/x.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(png(7, 9, 300) if name.endswith("png") else b"1")
    found = files.listing(spark, str(tmp_path))
    got = {r.map_id: r for r in files.assets(found).collect()}
    assert set(got) == {"M1", "M2"} and got["M1"].tfwx.endswith("M1.tfwx") and got["M1"].points and got["M1"].aux is None and got["M2"].aux
    assert {r.folder_path.rsplit("/", 1)[1]: r.mode for r in files.inputs(found).collect()} == {"M1": "auto", "M2": "bootstrap", "other": "bootstrap"}
    assert [r.folder for r in files.map_folders(found).collect()] == ["M1", "M2"] and [r.series for r in files.series_folders(found, "s").collect()] == ["s1", "s2"]
    size = files.image_sizes(spark, str(tmp_path / "s1/M1/M1.png")).first()
    assert (size.width, size.height) == (9, 7) and size.dpi == pytest.approx(300, abs=0.1)
    image = files.read_images(spark, str(tmp_path / "s1/M1/M1.png")).first()
    assert (image.height, image.width, image.channels) == (7, 9, 3)
    assert files.crops(found, sample=2).count() == 2


def test_text_sinks(spark):
    row = spark.createDataFrame([("A", 0.98765, "edge", 1.25, 2.0, 189000.1234, 630000.0, 1.0, 2.0, "h")], ", ".join(f"{c} {'string' if c in ('name', 'method', 'height') else 'double'}" for c in sinks.DETECTION))
    got = sinks.detection_rows(row).first()
    assert (got.confidence, got.easting_6991, got.old_e) == ("0.9877", "189000.123", "1.00")
    assert spark.range(1).select(sinks.crop_name(F.lit("M1"), F.lit(2.5), F.lit(3.5), F.lit(0.756), "gt")).first()[0] == "M1_x2_y4_c0.76_gt.png"
    log = spark.createDataFrame([("t", 1.5, "INFO", "hello", {"b": "2", "a": "1"})], "timestamp string, elapsed_s double, level string, message string, extra map<string,string>")
    assert sinks.log_text(log).first()[0] == "[    1.50s] INFO   hello a=1 b=2" and json.loads(sinks.log_json(log).first()[0])["extra"] == {"a": "1", "b": "2"}


def symbol():
    t = np.full((15, 15), 230.0)
    for i in range(12):
        t[2 + i, 7 - i // 2], t[2 + i, 7 + i // 2] = 20, 20
    t[13, 1:14] = 20
    return t


def test_pixel_functions():
    img = np.zeros((4, 4, 3), np.uint8)
    img[..., 0], img[..., 1], img[..., 2] = 10, 20, 200
    assert (imaging.suppress_red(img) == 10).all() and (imaging.suppress_colours(img) == 255).all()
    half = np.r_[np.full(50, 40), np.full(50, 200)].astype(np.uint8).reshape(10, 10)
    assert 40 <= imaging.otsu(half) < 200
    peak = imaging.correlation(np.pad(symbol(), 6, constant_values=230.0), symbol())
    assert np.unravel_index(peak.argmax(), peak.shape) == (6, 6) and peak.max() == pytest.approx(1.0)
    assert imaging.local_peaks(peak, 0.9, 3).tolist() == [[6, 6]]
    dot = np.full((40, 40), 255, np.uint8)
    dot[22, 21] = 0
    assert imaging.dot_centre(dot, 20, 20)[:2] == pytest.approx((21, 22)) and imaging.dot_centre(np.full((9, 9), 255, np.uint8), 4, 4)[2] is False


def test_crop_sanity():
    img = np.full((20, 20), 200, np.uint8)
    img[8:12, 8:12] = 0  # 4 % dark, mean 192
    assert imaging.crop_sanity(img) == pytest.approx(0.3 * 0.04 / 0.15 + 0.3 * (192 - 200 * 20 / 36) / 192 + 0.4)
    side = np.full((20, 20), 200, np.uint8)
    side[:, :3] = 0  # 15 % dark, all on the left: 60 of 200 differ
    assert imaging.crop_sanity(side) == pytest.approx(0.3 + 0.4 * 0.7)
    few, many = np.full((20, 20), 200, np.uint8), np.zeros((20, 20), np.uint8)
    few[10, 5:15], many[:, :9] = 0, 200
    assert imaging.crop_sanity(few) == imaging.crop_sanity(many) == imaging.crop_sanity(img[:9]) == 0.0


def test_network_shape():
    net = imaging.Network.random()
    assert net.parameters() == 191_905
    p = net(np.random.default_rng(0).integers(0, 255, (3, 64, 64)).astype(np.uint8))
    assert p.shape == (3,) and ((p > 0) & (p < 1)).all()


def test_symbols_in_a_sheet(spark):
    sheet = np.full((300, 420), 230, np.uint8)
    places = [(60, 70), (127, 128), (300, 200)]
    for x, y in places:
        sheet[y - 7 : y + 8, x - 7 : x + 8] = symbol()
    sheet[20, :] = 0
    sheet[:, 15] = 0
    bgr = np.repeat(sheet[..., None], 3, axis=2)
    images = spark.createDataFrame([("m", 300, 420, 3, bytearray(bgr.tobytes()))], "map_id string, height int, width int, channels int, data binary")
    cut = imaging.tiles(images, 128, 64)
    assert cut.count() == 12
    templates = [(symbol(), 0.0, 0.0)]
    found = spatial.suppress(imaging.template_candidates(cut, templates, 0.8, 5, 128).withColumn("down", -F.col("score")), ["down", "px", "py"], ["px", "py"], 20.0)
    assert sorted((round(r.px - 0.5), round(r.py - 0.5)) for r in found.collect()) == places
    sizes = spark.createDataFrame([("m", 420, 300)], "map_id string, width int, height int")
    unit = spark.createDataFrame([("m", 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "map_id string, a double, b double, c double, d double, e double, f double")
    points = spark.createDataFrame([("m", i, float(x + 2), float(y - 1)) for i, (x, y) in enumerate([*places, (200, 60), (2, 2)])], "map_id string, pid long, x double, y double")
    got = {r.pid: r for r in imaging.verify_candidates(points, unit, sizes, cut, templates, "suppress_red", 32, 128).collect()}
    assert set(got) == {0, 1, 2, 3} and all(got[i].confidence > 0.9 for i in range(3)) and got[3].confidence < 0.5
    profile = imaging.dark_profile(cut, 128)
    lines = labels.cluster_lines(imaging.strong_lines(profile, sizes), 3, ("map_id", "axis"))
    assert sorted((r.axis, r.line) for r in lines.collect()) == [("h", 20), ("v", 15)]
    assert labels.neatline(lines, sizes).first()[1:] == (20, 255, 15, 399)


def test_verification_reaches_far_symbols(spark):
    sheet = np.full((200, 260), 230, np.uint8)
    big = np.repeat(np.repeat(symbol(), 2, axis=0), 2, axis=1)
    sheet[85:115, 135:165] = big
    images = spark.createDataFrame([("m", 200, 260, 3, bytearray(np.repeat(sheet[..., None], 3, axis=2).tobytes()))], "map_id string, height int, width int, channels int, data binary")
    sizes = spark.createDataFrame([("m", 260, 200)], "map_id string, width int, height int")
    unit = spark.createDataFrame([("m", 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "map_id string, a double, b double, c double, d double, e double, f double")
    points = spark.createDataFrame([("m", 0, 130.0, 100.0), ("m", 1, 36.0, 100.0)], "map_id string, pid long, x double, y double")
    got = {r.pid: r for r in imaging.verify_candidates(points, unit, sizes, imaging.tiles(images), [(big, 0.0, 0.0)], "suppress_red").collect()}
    assert set(got) == {0} and got[0].confidence > 0.9


def test_bootstrap_of_a_made_up_sheet(spark):
    px, col, row = 1183, 891, 934
    read = [("m", "top", i, float(col + i * px), 140 + i, 0.9) for i in range(11)] + [("m", "left", 100 + i, float(row + i * px), 130 - i, 0.9) for i in range(11)]
    readings = spark.createDataFrame(read, "map_id string, edge string, id long, pos double, val long, conf double")
    lines = spark.createDataFrame([("m", row, row + 10 * px, col, col + 10 * px)], "map_id string, top int, bottom int, left int, right int")
    names = spark.createDataFrame([("m", "14-12-Made-1942.jpg")], "map_id string, file_name string")
    draw = np.random.default_rng(0)
    spots = draw.uniform(1000, 9000, (30, 2)).tolist()
    points = spark.createDataFrame([(i, 140_000.0 + x + 50_000, 120_000.0 + y + 500_000, 1_120_000.0 + y, 140_000.0 + x) for i, (x, y) in enumerate(spots)], "pid long, easting double, northing double, old_e double, old_n double")
    got = pipelines.bootstrap(readings, lines, names, points, lambda c: c.withColumn("confidence", F.lit(0.9)))
    report = got.report.first()
    assert report.status == "ok" and report.rmse_radial_m < 1 and got.candidates.count() == 30


def test_stream_is_the_batch(spark, tmp_path):
    rows = [{"map_id": "m", "id": i, "px": 7.0 * i, "py": 0.0, "confidence": 0.9} for i in range(10)]
    (tmp_path / "in").mkdir()
    for k in (0, 5):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k : k + 5]))
    for again in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / f"check{again}")).awaitTermination()
    kept = sorted(r.px for r in spark.read.parquet(str(tmp_path / "store")).collect())
    assert len(kept) >= 4 and all(b - a > 10 for a, b in zip(kept, kept[1:]))


def test_world_files_come_back(spark, tmp_path):
    from carteel.sources import sinks

    rows = [("M1_a", 0.85, 0.002, -0.001, -0.84, 189000.5, 630000.25), ("M2", 1.5, 0.0, 0.0, -1.5, 1.0, 2.0)]
    sinks.write_world_files(spark.createDataFrame(rows, "map_id string, a double, b double, c double, d double, e double, f double"), str(tmp_path / "w"))
    got = text.read_world_files(spark, str(tmp_path / "w" / "*")).orderBy("map_id").collect()
    assert [(r.map_id, r.a, r.b, r.c, r.d, r.e, r.f) for r in got] == rows and all(r.reject_reason is None for r in got)
