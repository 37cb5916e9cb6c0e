import json

import duckdb
import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestrata.operators import feedback, image, regions, segment, select
from lodestrata.plans.runner import told
from lodestrata.sources import feedback as sinks
from lodestrata.sources import images
from lodestrata.sources.artefacts import RunFolder

PIXELS = "label int, y int, x int, value double"


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(1)
    points = [(int(a), int(b), int(c), float(v)) for a, b, c, v in zip(rng.integers(0, 4, 300), rng.integers(0, 30, 300), rng.integers(0, 50, 300), rng.random(300), strict=True)]
    for r in regions.region_properties(spark.createDataFrame(points, PIXELS)).collect():
        p = np.array([q[1:] for q in points if q[0] == r.label])
        small, large = np.linalg.eigvalsh(np.cov(p[:, :2].T, bias=True))
        assert r.label > 0 and r.area == len(p)
        assert np.allclose([r.centroid_y, r.centroid_x, r.mean_intensity, r.max_intensity], [*p[:, :2].mean(axis=0), p[:, 2].mean(), p[:, 2].max()])
        assert np.allclose([r.major_axis_length, r.minor_axis_length, r.eccentricity], [4 * large**0.5, 4 * small**0.5, (1 - small / large) ** 0.5])


def test_single_pixel_and_no_foreground(spark):
    one = regions.region_properties(spark.createDataFrame([(1, 3, 4, 0.5), (0, 0, 0, 9.0)], PIXELS)).collect()
    assert [(r.area, r.eccentricity, r.major_axis_length) for r in one] == [(1, 0.0, 0.0)]
    none = regions.region_properties(spark.createDataFrame([(0, 0, 0, 9.0)], PIXELS))
    assert none.count() == 0 and select.exact_percentile(none, "area", 99) is None
    assert select.percentile_threshold(none).first()[0] is None and select.select_rare(none).count() == 0
    assert select.count_labels(none).first()[0] == 0


@pytest.mark.parametrize("p", [0, 1, 37.5, 50, 95, 99, 100])
def test_exact_percentile_against_numpy(spark, p):
    rng = np.random.default_rng(int(p * 10))
    for values in (rng.random(1000), rng.integers(0, 3, 501).astype(float), np.array([7.0]), np.full(20, 2.5)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for few in (10_000, 3):  # with brackets, without them
            assert select.exact_percentile(df, "v", p, few) == pytest.approx(np.percentile(values, p), abs=1e-12)


def test_nan_is_never_selected(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0)], "label int, v double")
    assert [r.label for r in select.at_or_above(df, "v", 2.0).collect()] == [3]
    assert np.isnan(select.exact_percentile(df, "v", 50)) and select.at_or_above(df, "v", float("nan")).count() == 0
    assert select.select_rare(df, "v", 50).count() == 0


def test_all_equal_areas_are_all_selected(spark):
    df = spark.createDataFrame([(i, 4) for i in range(10)], "label int, area int")
    assert select.select_rare(df).count() == 10


def test_unknown_feature_fails_at_once(spark):
    with pytest.raises(AnalysisException):
        select.select_rare(spark.createDataFrame([(1, 4)], "label int, area int"), "absent")


def test_largest_label_counts_where_labels_have_gaps(spark):
    assert select.count_labels(spark.createDataFrame([(1,), (5,)], "label int")).first()[0] == 5


def test_solidity(spark):
    square = [(1, y, x, 1.0) for y in range(4) for x in range(4)]
    corner = [(2, y, x, 1.0) for y in range(6) for x in range(6) if y == 0 or x == 0]
    single = [(3, 9, 9, 1.0)]
    got = {r.label: r for r in regions.region_solidity(spark.createDataFrame(square + corner + single + single, PIXELS)).collect()}
    assert got[1].solidity == 1.0 and got[3].solidity == 1.0 and got[3].area == 1
    # the corner's hull: the triangle under its diagonal
    assert got[2].area == 11 and got[2].convex_area == sum(1 for y in range(6) for x in range(6) if x + y <= 5)


def test_document_and_file(spark, tmp_path):
    records = feedback.cells(spark.createDataFrame([(2, 1.0, 2.0, 5, 0.5, 0.1), (1, 3.0, 4.0, 6, 0.25, 0.2)], "label int, centroid_x double, centroid_y double, area int, mean_intensity double, eccentricity double"))
    counted = spark.createDataFrame([(9,)], "n_cells long")
    doc = feedback.document(records, counted, "a", "area", 99, 5.0, "20260101-000000")
    read = json.loads(open(sinks.write_file(doc, str(tmp_path / "new" / "dir"), "a")).read())
    assert read["n_selected"] == 2 and read["n_total"] == 9 and [c["label"] for c in read["cells"]] == [1, 2]
    assert read["selection_criteria"] == {"feature": "area", "percentile": 99.0, "threshold": 5.0}
    sinks.write_many(doc, str(tmp_path / "many"))
    assert spark.read.json(str(tmp_path / "many")).first()["label"] == "a"
    none = feedback.document(records.limit(0), counted, "b", "area", 99, None, "x").first()
    assert none["n_selected"] == 0 and none["cells"] == [] and none["selection_criteria"]["threshold"] is None


def test_report_rounds_as_printf_does(spark):
    """Exact binary values, ties to even: format_string made 11.3 of 11.25 and 0.2 of 0.15. A null gives no text."""
    centres = [k / 20 for k in range(-41, 400)] + [49.15, 1201.25, 1e15 + 0.25, 1e17, -0.0, float("nan"), float("inf"), None]
    made = [(i + 1, x, centres[-1 - i], i, 0.0, 0.0) for i, x in enumerate(centres)]
    records = feedback.cells(spark.createDataFrame(made, "label int, centroid_x double, centroid_y double, area int, mean_intensity double, eccentricity double"))
    con = duckdb.connect()
    sql = "SELECT printf('label=%3d  pos=(%.1f, %.1f)  area=%dpx', CAST(? AS INTEGER), CAST(? AS DOUBLE), CAST(? AS DOUBLE), CAST(? AS BIGINT))"
    want = {r[0]: con.execute(sql, r[:4]).fetchone()[0] for r in made}
    got = {r.label: r.line for r in feedback.report(records).collect()}
    assert got == want
    at = centres.index(11.25) + 1
    assert "pos=(11.2, " in got[at] and got[1] is None and got[len(made)] is None
    assert told({"feedback": {"cells": records}}).startswith("label=  1\nlabel=  2  pos=(-2.0, inf)  area=1px\n")


def test_no_document_of_too_many_records(spark, monkeypatch):
    monkeypatch.setattr(feedback, "MAX_RECORDS", 3)
    records = spark.range(4).selectExpr("CAST(id AS INT) AS label", "0D AS centroid_x", "0D AS centroid_y", "1L AS area", "0D AS mean_intensity", "0D AS eccentricity")
    with pytest.raises(ValueError, match="records as a table"):
        feedback.document(records, spark.range(1).selectExpr("id AS n_cells"), "a", "area", 99, 5.0, "x")
    assert feedback.document(records.limit(3), spark.range(1).selectExpr("id AS n_cells"), "a", "area", 99, 5.0, "x").first()["n_selected"] == 3


def test_hulls_against_counting_by_angles():
    """A pixel is in or on the hull unless all corner points are seen from it within less than half a turn."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        rows = np.sort(rng.choice(12, rng.integers(1, 7), replace=False))
        first = rng.integers(0, 9, len(rows))
        last = first + rng.integers(0, 5, len(rows))
        y, x = np.concatenate((rows, rows)), np.concatenate((first, last))
        p = np.concatenate([np.stack((2 * y + a, 2 * x + b), 1) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        inside = 0
        for cy in range(0, 26, 2):
            for cx in range(-2, 30, 2):
                angle = np.arctan2(p[:, 0] - cy, p[:, 1] - cx)
                gaps = np.diff(np.concatenate((np.sort(angle), [np.sort(angle)[0] + 2 * np.pi])))
                inside += gaps.max() <= np.pi + 1e-9
        assert regions.hull_area(rows, first, last) == inside


def picture(spark, arrays):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], a.ravel().tolist()) for i, a in enumerate(arrays)], "image_id long, height int, width int, pixels array<double>")


def test_both_smoothings_agree_also_for_oblong_images(spark):
    rng = np.random.default_rng(2)
    df = picture(spark, [rng.random((5, 9)), rng.random((8, 8)), rng.random((1, 3))])
    for sigma in (0.7, 1.0):
        a, b = ({r.image_id: r.pixels for r in f(df, sigma).collect()} for f in (image.smooth, image.smooth_binary))
        assert all(np.allclose(a[k], b[k]) for k in a)


def test_smoothing_keeps_a_flat_image():
    assert np.allclose(image.smooth_array(np.full((6, 4), 0.3), 1.0), 0.3)


def test_quantise_cuts_off(spark):
    got = image.quantise(picture(spark, [np.array([[0.0, 0.5, 0.999, 1.0]])])).first().pixels
    assert got == [0, 127, 254, 255]


def test_clahe_spreads_values_and_keeps_order_in_one_tile():
    rng = np.random.default_rng(3)
    a = rng.random((16, 16)) * 0.1 + 0.4
    out = image.equalise(a, clip_limit=1.0, tile=(16, 16))
    assert out.min() >= 0 and out.max() <= 1 and out.std() > a.std()
    order = np.argsort(a.ravel())
    assert (np.diff(out.ravel()[order]) >= -1e-12).all()
    assert np.allclose(image.equalise(np.full((8, 8), 0.5), tile=(4, 4)), image.equalise(np.full((8, 8), 0.5), tile=(4, 4))[0, 0])


def test_components_touching_at_corners_are_two():
    mask = np.array([[1, 0, 1], [0, 1, 1], [1, 0, 0]], bool)
    assert segment.components(mask).tolist() == [[1, 0, 2], [0, 2, 2], [3, 0, 0]]
    assert segment.components(np.zeros((2, 2), bool)).sum() == 0


def test_segmenter_can_be_given(spark):
    left = lambda: lambda a: (np.arange(a.shape[1])[None] < 1).repeat(a.shape[0], axis=0).astype(int)
    got = segment.segment(picture(spark, [np.ones((2, 3))]), left).collect()
    assert {(r.y, r.x, r.label) for r in got} == {(0, 0, 1), (1, 0, 1)}


def png(a):
    import struct
    import zlib

    depth = 8 * a.dtype.itemsize
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.astype(">u2" if depth == 16 else "u1").tobytes() for r in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_files_of_8_and_16_bits(spark, tmp_path, kind):
    a = np.random.default_rng(4).integers(0, 256 if kind == "u1" else 65536, (5, 7)).astype(kind)
    (tmp_path / "a.tif").write_bytes(images.write_tiff(a))
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n7 5\n%d\n" % (255 if kind == "u1" else 65535) + a.astype(">u2" if kind == "u2" else "u1").tobytes())
    got = images.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.pixels == a.ravel().tolist() and (r.height, r.width, r.depth) == (5, 7, 8 * a.dtype.itemsize) for r in got)


def test_png_filters():
    import struct
    import zlib

    a = np.random.default_rng(5).integers(0, 256, (5, 6)).astype(np.uint8)
    rows, above = [], np.zeros(6, int)
    for kind, line in enumerate(a.astype(int)):
        left, corner = np.concatenate(([0], line[:-1])), np.concatenate(([0], above[:-1]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows.append(bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
        above = line
    data = png(a)
    at = data.index(b"IDAT") - 4
    body = zlib.compress(b"".join(rows))
    data = data[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + png(a)[-12:]
    assert (images.read_png(data) == a).all()


def test_what_is_no_grey_picture_names_its_file(spark):
    bad = spark.createDataFrame([("x/y.gif", bytearray(b"GIF89a"))], "path string, content binary")
    with pytest.raises(Exception, match="x/y.gif"):
        images.decode_images(bad).collect()


def test_run_folder(tmp_path):
    run = RunFolder(tmp_path, "a", "flow")
    run.begin({"label": "a"})
    assert run.step(1, "load", {"n": 2}).name == "01_load" and (tmp_path / "a_flow_output" / "metadata.yaml").exists()


def test_streamed_regions_equal_the_batch(spark, tmp_path):
    from lodestrata.streaming.regions import windowed_regions

    pixels = spark.range(200).select((F.col("id") % 3 + 1).cast("int").alias("label"), (F.col("id") % 7).cast("int").alias("y"), (F.col("id") % 11).cast("int").alias("x"), F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    pixels.write.parquet(str(tmp_path / "in"))
    stream = windowed_regions(spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("regions").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = regions.region_properties(pixels.withColumn("window", F.window("ts", "1 hour")), ("window", "label"))
    key = lambda df: sorted(((r.window.start, r.label, r.area, round(r.centroid_y, 9), round(r.eccentricity, 9)) for r in df.collect()))
    assert key(spark.table("regions")) == key(batch)
