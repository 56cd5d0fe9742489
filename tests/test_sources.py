import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.sources import layers as L
from labelgrid.sources import listing as N
from labelgrid.sources import ocr as R
from labelgrid.sources import sinks as K
from labelgrid.sources import textfiles as T


def png(path, px):
    """Write a tiny grey or RGB PNG."""
    px = np.asarray(px, np.uint8)
    rgb = px.ndim == 3
    raw = b"".join(b"\0" + row.tobytes() for row in px)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 2 if rgb else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


GREY = np.array([[0, 255, 0], [51, 0, 0]])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    page = np.zeros((2, 3, 3), np.uint8)
    page[0, 0] = (255, 0, 51)
    png(d / "p1.jpg", page)  # decoded by content, not by name
    png(d / "p1_HW.png", GREY)
    png(d / "p1_HW.tif", 255 - GREY)  # later in the extension order
    png(d / "p1.jpg_MP.png", GREY.T.copy().T)
    png(d / "p2.jpg", page)
    png(d / "p2_1.png", GREY)
    png(d / "p3.jpg", page)
    bits = np.zeros((2, 3, 3), np.uint8)
    bits[0, 1] = (128, 1, 2)  # red, green, blue: bits 23, 8, 1
    png(d / "p3.png", bits)
    return d


def files(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def cells(df):
    return {(r["image_id"], r["y"], r["x"], r["class_id"]): round(r["v"], 6) for r in df.collect()}


def test_readers(spark, folder):
    classes = spark.createDataFrame([("HW", 0), ("MP", 1)], "suffix string, class_id int")
    want = {("p1", 0, 1, k): 1.0 for k in (0, 1)} | {("p1", 1, 0, k): 0.2 for k in (0, 1)}
    assert cells(L.read_layers(spark, str(folder), classes)) == want
    assert cells(L.read_numbered_layers(spark, str(folder), 2)) == {("p2", 0, 1, 1): 1.0, ("p2", 1, 0, 1): 0.2}
    bits = L.read_bit_indexed(spark, str(folder), 9, dont_care_bit=23)
    assert cells(bits) == {("p3", 0, 1, 1): 1.0, ("p3", 0, 1, 8): 1.0} and all(r["dont_care"] for r in bits.collect())
    auto = cells(L.read_labels(spark, str(folder), classes, 9))
    assert len(auto) == 4 + 2 + 2
    assert {r["image_id"]: r["height"] for r in L.page_extents(spark, str(folder), 2).collect()} == {"p1": 2, "p2": 2, "p3": 2}


def test_intensity_is_blue_green_red(spark, folder):
    px = {(r["image_id"], r["y"], r["x"], r["c"]): r["v"] for r in L.read_intensity(spark, str(folder)).collect()}
    assert len(px) == 3 * 6 * 3 and [px[("p1", 0, 0, c)] for c in range(3)] == pytest.approx([0.2, 0, 1])
    half = L.read_intensity(spark, str(folder), rate=2).where("image_id = 'p1' AND y = 0 AND x = 0 AND c = 2").first()
    assert half["v"] == pytest.approx(0.25)


def test_large_pages_travel_in_strips(spark, tmp_path):
    rng = np.random.default_rng(0)
    page = rng.integers(0, 2, (300, 500, 3)).astype(np.uint8) * 255
    png(tmp_path / "big.jpg", page)
    pieces = L.strips(L.decoded(spark, str(tmp_path)))
    assert pieces.agg(F.max(F.length("data"))).first()[0] <= L.STRIP_BYTES and pieces.count() == 15
    out = np.zeros((300, 500, 3))
    for r in L.read_intensity(spark, str(tmp_path)).toPandas().itertuples():
        out[r.y, r.x, r.c] = r.v
    assert np.array_equal(out, page[:, :, ::-1] / 255.0)


def test_custom_reader(spark, folder):
    L.register_reader("none", lambda spark, folder, classes, n: spark.createDataFrame([], "image_id string, y int, x int, class_id int, v double"))
    assert L.read_labels(spark, str(folder), None, 1, reader="none").count() == 0


def test_discover_classes(spark):
    df = files(spark, ["a.jpg", "a_HW.png", "a_MP.tif", "b.jpg", "bDL.png", "lonely.png", "x.txt"])
    assert {r["suffix"]: r["class_id"] for r in N.discover_classes(df).collect()} == {"DL": 0, "HW": 1, "MP": 2}
    assert [r["name"] for r in N.unmatched_files(df).collect()] == ["lonely"]
    # a layer of a layer: the middle stem is an image and claims nothing itself
    chain = files(spark, ["a.jpg", "a_b.png", "a_b_c.png"])
    assert [r["suffix"] for r in N.discover_classes(chain).collect()] == ["c"]
    longer = files(spark, ["a.jpg", "a_b.png", "a_b_c.png", "a_b_c_d.png"])
    assert sorted(r["suffix"] for r in N.discover_classes(longer).collect()) == ["b", "d"]


def test_listings_and_formats(spark, folder):
    names = files(spark, ["f/a.JPG", "f/a.jpg_HW.png", "f/b.jpg.x.jpg", "f/c.jpg", "f/c.png", "f/d.jpg", "f/d_0.png", "f/e.jpg"])
    assert sorted(r["path"] for r in N.training_images(names).collect()) == ["f/a.JPG", "f/c.jpg", "f/d.jpg", "f/e.jpg"]
    assert {r["stem"]: r["format"] for r in N.detect_label_format(names).collect()} == {"a": "suffix", "c": "bit_indexed", "d": "numbered", "e": "suffix"}
    listed = N.list_files(spark, str(folder))
    assert listed.count() == 8 and [r["path"][-6:] for r in N.inference_images(listed).collect()] == ["p1.jpg", "p2.jpg", "p3.jpg"]
    assert N.batch_images(listed, ["png"]).count() == 4


def test_pages_with_transcripts(spark, tmp_path):
    png(tmp_path / "a.png", GREY)
    png(tmp_path / "b.jpg", GREY)
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\n\n")
    got = [(r["image_id"], r["gt"]) for r in T.read_pages(spark, str(tmp_path)).collect()]
    assert got == [("a", "one\ntwo\nthree"), ("b", "")]


def word(conf, box, text):
    vertex = [{"x": str(box[0]), "y": box[1]}, {"x": box[2], "y": box[1]}, {"x": box[2], "y": box[3]}, {"x": box[0], "y": box[3]}]
    w = {"boundingBox": {"vertices": vertex}, "symbols": [{"text": c, "confidence": 0.01, "boundingBox": {"vertices": vertex}} for c in text]}
    return w if conf is None else {**w, "confidence": conf}


def test_ocr_response(spark, tmp_path):
    body = {"responses": [{
        "fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [word(0.9, (30, 40, 10, 20), "hi"), word(None, (0, 0, 1, 1), "no"), word("0.2", (1, 2, 3, 4), "ok")]}]}]}]},
        "textAnnotations": [{"boundingPoly": {"vertices": [{"x": 1, "y": 2}, {"x": 3, "y": 2}, {"x": 3, "y": 4}, {"x": 1, "y": 4}]}}] * 2,
    }]}
    (tmp_path / "r.json").write_text(json.dumps(body, indent=1))
    pages = R.read_ocr_json(spark, str(tmp_path / "r.json"))
    assert [(r["l"], r["t"], r["r"], r["b"], r["text"]) for r in R.words(pages).orderBy("pos").collect()] == [(10, 20, 30, 40, "hi"), (1, 2, 3, 4, "ok")]
    syms = R.symbols(pages).orderBy("pos", "n").collect()
    assert [s["text"] for s in syms] == list("hiok") and syms[0]["vertices"][0]["x"] == "30"
    assert [(r["l"], r["b"], r["rank"]) for r in R.simple_boxes(pages).orderBy("i").collect()] == [(1, 4, 0.0), (1, 4, 0.5)]


def test_tesseract_and_requests(spark):
    lines = spark.createDataFrame([("p", "a 1 2 3 10 0"), ("p", "")], "page_id string, value string")
    r = R.tesseract_boxes(lines, spark.createDataFrame([("p", 100)], "page_id string, height int")).first()
    assert (r["ch"], r["l"], r["t"], r["r"], r["b"]) == ("a", 1, 90, 3, 98)
    im = spark.createDataFrame([("a", bytearray(b"xy"), 10, 10), ("b", bytearray(b"z"), 1000, 300)], "path string, content binary, height int, width int")
    got = {r["path"]: (r["feature"], json.loads(r["body"])["requests"][0]["image"]["content"]) for r in R.ocr_request_table(im).collect()}
    assert got == {"a": ("TEXT_DETECTION", "eHk="), "b": ("DOCUMENT_TEXT_DETECTION", "eg==")}


def test_logs(spark, tmp_path):
    lines = ["-"] * 45
    lines[-2] = "overall: 0.8"
    for k in range(5):
        lines[-28 - k], lines[-34 - k] = f"{k} f 0.{k}", f"{k} acc 0.{k}5"
    (tmp_path / "validation.45.txt").write_text("\n".join(lines) + "\n")
    parsed = T.parse_validation_logs(T.read_logs(spark, str(tmp_path)))
    assert [(r["threshold"], r["value"]) for r in parsed.where("kind = 'overall_f1'").collect()] == [(0.45, 0.8)]
    got = {r["class"]: (r["f1"], r["accuracy"]) for r in T.sweep_from_logs(parsed).collect()}
    assert got["3"] == (0.3, 0.35) and len(got) == 5


def test_charset_and_coordinates(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"char_to_idx": {"a": 1}, "idx_to_char": {"1": "a", "2": "b"}}))
    assert sorted((r["ch"], r["idx"]) for r in T.read_charset(spark, str(tmp_path / "c.json")).collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "p.txt").write_text("3\t4\n5 6\n")
    got = T.read_coordinates(spark, str(tmp_path / "p.txt")).collect()
    assert [(r["image_id"], r["y"], r["x"]) for r in got] == [("p", 4, 3), ("p", 6, 5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("i", 0, 0, 0, 0.5), ("i", 0, 0, 1, 1.0), ("j", 3, 1, 1, 0.2)], "image_id string, y int, x int, class_id int, v double")
    K.write_layers(df, str(tmp_path / "layers"))
    back = spark.read.parquet(str(tmp_path / "layers"))
    assert sorted((r["image_id"], r["class_id"], r["grey"]) for r in back.collect()) == [("i", 0, 128), ("i", 1, 255), ("j", 1, 51)]
    K.write_indexed(df, str(tmp_path / "masks"))
    K.write_indexed(df, str(tmp_path / "enum"), enum=True)
    assert {r["image_id"]: r["mask"] for r in spark.read.parquet(str(tmp_path / "masks")).collect()} == {"i": 3, "j": 2}
    assert {r["image_id"]: r["class_id"] for r in spark.read.parquet(str(tmp_path / "enum")).collect()} == {"i": 1, "j": 1}
    coords = spark.createDataFrame([("i", 9, 9, 0), ("i", 0, 0, 1), ("h", 1, 1, 2)], "image_id string, y int, x int, pos int")
    K.write_predictions_txt(coords, df, str(tmp_path / "txt"))
    files = sorted((tmp_path / "txt").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["h\t1\t1\t1", "i\t9\t9\t1", "i\t0\t0\t2"]
    hist = spark.createDataFrame([("r", 2, 0.5), ("r", 1, 0.25)], "run_id string, step int, loss double")
    K.write_run_history(hist, ["loss"], str(tmp_path / "hist"))
    assert json.loads(spark.read.text(str(tmp_path / "hist")).first()["value"]) == {"loss": [0.25, 0.5]}
    parts = {r["part"]: json.loads(r["value"])["loss"] for r in K.history_json(hist, ["loss"], part_steps=2).collect()}
    assert parts == {0: [0.25], 1: [0.5]}
    K.write_transcript(spark.createDataFrame([("p", "a b")], "page_id string, text string"), str(tmp_path / "tr"))
    assert spark.read.json(str(tmp_path / "tr")).first()["text"] == "a b"
    assert K.layer_values(df).agg(F.max("grey")).first()[0] == 255
