import json

import pytest
from pyspark.sql import functions as F

from transect.operators import annotation
from transect.sources import files, shapes, sinks


def test_labels_and_confirmed_negatives(spark, tmp_path):
    for name in ("a.jpg", "b.jpg", "c.png", "c.jpg", "note.md"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "a.txt").write_text("3 0.5 0.5 0.2 0.4\n\n1 0.1\n0  1.5 0.25 0.1 0.1 0.9\n")
    (tmp_path / "b.txt").write_text("")
    labels = files.label_lines(spark, str(tmp_path))
    assert [(r.line_no, r.cx, r.h) for r in labels.orderBy("line_no").collect()] == [(0, 0.5, 0.4), (3, 1.0, 0.1)]
    listing = files.image_by_stem(files.images(spark, str(tmp_path)))
    assert {r.stem: r.path.rsplit(".")[-1] for r in listing.collect()} == {"a": "jpg", "b": "jpg", "c": "jpg"}
    assert {r.stem: r.n_boxes for r in files.labelled_frames(listing, labels).collect()} == {"a": 2, "b": 0, "c": 0}
    boxes = labels.withColumn("seq", F.col("line_no"))
    texts = {r.stem: r.label for r in sinks.label_texts(listing, boxes).collect()}
    assert texts["a"] == "0 0.500000 0.500000 0.200000 0.400000\n0 1.000000 0.250000 0.100000 0.100000"
    assert texts["b"] == ""
    sizes = spark.createDataFrame([("a", 100, 50)], "stem string, width int, height int")
    r = files.pixel_boxes(labels, sizes).orderBy("line_no").first()
    assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx((40, 15, 60, 35))


def region(name, part=None, **shape):
    return {"shape_attributes": {"name": name, **shape}, "region_attributes": {"body_part": part} if part else {}}


def test_shapes_as_list_or_object(spark, tmp_path):
    data = {
        "k1": {"filename": "a.jpg", "regions": [region("polygon", "body", all_points_x=[1, 5, 3], all_points_y=[2, 2, 8]), region("rect", "tail", x=0, y=0, width=10, height=10)]},
        "k2": {"filename": "b.jpg", "regions": {"0": region("circle", cx=5, cy=5, r=2), "1": region("polygon", all_points_x=[], all_points_y=[]), "2": region("ellipse", cx=5, cy=5, rx=1, ry=2)}},
        "k3": {"filename": "", "regions": []},
        "k4": {"filename": "c.jpg"},
    }
    (tmp_path / "via.json").write_text(json.dumps(data))
    sizes = spark.createDataFrame([(f, 10, 10, 1) for f in ("a.jpg", "b.jpg", "c.jpg")], "filename string, width int, height int, orientation int")
    entries = shapes.regions(spark, str(tmp_path))
    assert sorted(r.filename for r in entries.collect()) == ["a.jpg", "b.jpg", "c.jpg"]
    count = lambda mode: {r.filename: r["count"] for r in shapes.shape_boxes(entries, sizes, mode).groupBy("filename").count().collect()}
    assert count("body") == {"a.jpg": 1, "b.jpg": 2}
    assert count("all") == {"a.jpg": 2, "b.jpg": 2}
    assert count("union") == {"a.jpg": 1, "b.jpg": 1}
    u = shapes.shape_boxes(entries.filter("filename = 'b.jpg'"), sizes, "union").first().box
    assert tuple(u) == pytest.approx((0.5, 0.5, 0.4, 0.4))
    with pytest.raises(ValueError, match="mode"):
        shapes.shape_boxes(entries, sizes, "x")


def test_coco_lines(spark, tmp_path):
    rows = [{"image_id": "1", "file_name": "a.jpg", "annotations": [{"bbox": [0, 0, 5, 5], "bbox_mode": 1, "category_id": 0}, {"bbox": [1, 2], "category_id": 0}]}, {"image_id": "2", "file_name": "gone.jpg", "annotations": []}]
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    sizes = spark.createDataFrame([("a.jpg", 10, 10)], "file_name string, width int, height int")
    found = shapes.coco_boxes(shapes.coco_records(spark, str(tmp_path / "x.jsonl")), sizes).collect()
    assert [(r.file_name, r.seq, tuple(r.box)) for r in found] == [("a.jpg", 0, (0.25, 0.25, 0.5, 0.5))]


def test_flight_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("frame,altitude_m\nx/a.jpg,100\nb.jpg,bad\na.jpg,101.5\nc.jpg,\n")
    assert {r.frame: r.altitude_m for r in files.flight_log(spark, str(tmp_path / "log.csv")).collect()} == {"a.jpg": 101.5}


def test_cache_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), {"model": "m", "tile": 640}, build).count() == 3
    assert files.cached(spark, str(tmp_path / "cache"), {"model": "n", "tile": 640}, build).count() == 3
    files.cached(spark, str(tmp_path / "cache"), {"model": "m", "tile": 640}, build, rebuild=True)
    assert len(built) == 3


def test_tasks_take_the_last_live_annotation(spark):
    value = {"x": 10.0, "y": 20.0, "width": 30.0, "height": 40.0, "rectanglelabels": ["inferred"]}
    rect, other, flat = {"type": "rectanglelabels", "value": value}, {"type": "choices", "value": {}}, {"type": "rectanglelabels", "value": value | {"width": 0.0, "rectanglelabels": []}}
    task = {"data": {"image": "/data/local-files/?d=a%20b.jpg"}, "annotations": [{"result": [rect] * 3}, {"was_cancelled": False, "result": [rect, other, flat]}, {"was_cancelled": True, "result": [rect] * 9}]}
    tasks = spark.createDataFrame([(1, json.dumps(task)), (2, json.dumps(task | {"annotations": []}))], "task int, json string")
    found = annotation.task_boxes(tasks).collect()
    assert [(r.task, r.image, r.label) for r in found] == [(1, "a b.jpg", "inferred"), (1, "a b.jpg", "certain")]
    assert tuple(found[0].box) == pytest.approx((0.25, 0.4, 0.3, 0.4))
    assert annotation.task_boxes(tasks, clamped=True).count() == 1
    assert annotation.task_boxes(tasks, every=True).count() == 5


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "train", "pool", "g", 2, 1)], "source string, stem string, split string, role string, group string, boxes int, kept int")
    sinks.write_manifest(rows, str(tmp_path / "m"), csv=True)
    assert files.split_manifest(spark, str(tmp_path / "m")).first() == rows.first()
    assert "nc: 1" in sinks.dataset_descriptor("/d")
    frames = spark.sql("SELECT 'f' AS frame, named_struct('mode', 'sahi') AS decision, array(named_struct('score', 0.5D), named_struct('score', 0.7D)) AS detections")
    assert json.loads(sinks.frame_json(frames).first().json)["scores"] == {"n": 2, "min": 0.5, "mean": 0.6, "max": 0.7}


def test_completions_join(spark):
    c = spark.createDataFrame([(1, 10, "r", False), (2, 10, "s", True), (3, 11, "t", None), (4, 99, "u", False)], "id int, task_id int, result string, was_cancelled boolean")
    t = spark.createDataFrame([(10, 1, "d10"), (11, 1, "d11")], "id int, project_id int, data string")
    assert sorted((r.id, r.data) for r in annotation.completions(c, t).collect()) == [(1, "d10"), (3, "d11")]
