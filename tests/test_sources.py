import json

import pytest
from pyspark.sql import functions as F

from tallyline.operators import registry as R
from tallyline.sources import files as S
from tallyline.sources import sinks, snapshots


def test_registry_files(spark, tmp_path):
    path = str(tmp_path / "reg")
    with pytest.raises(FileNotFoundError):
        S.load_registry(spark, path)
    assert S.read_registry(spark, path).count() == 0
    (tmp_path / "reg.csv").write_text("license_plate,car_brand,car_color\n 30F-12345 ,Kia,RED\n,,\n51A-1,,Blue\n")
    got = S.load_registry(spark, str(tmp_path / "reg.csv"))
    assert [(r.license_plate, r.car_brand, r.car_color) for r in got.orderBy("row_ord").collect()] == [("30F-12345", "Kia", "RED"), ("51A-1", "", "Blue")]
    sinks.replace_registry(got, path)
    sinks.replace_registry(S.read_registry(spark, path).filter("car_brand <> ''"), path)
    assert S.read_registry(spark, path).count() == 1


def test_trees(spark, tmp_path):
    for name in ("d/images/a.jpg", "d/images/a.png", "d/images/b.PNG", "d/labels/a.txt", "d/labels/c.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("0 0.5 0.5 0.2 0.2\nbad\n2 1 1 1 1 9\n")
    images, labels = S.files_of(spark, str(tmp_path / "d")), S.files_of(spark, str(tmp_path / "d"), ("txt",))
    assert [r.image.rsplit("/", 1)[1] for r in S.yolo_pairs(images, labels).collect()] == ["a.jpg"]
    lines = S.yolo_lines(spark, str(tmp_path / "d/labels/a.txt"))
    assert sorted((r.cls, r.cx) for r in lines.collect()) == [(0, 0.5), (2, 1.0)]
    assert S.checksums(spark, str(tmp_path / "d")).select("sha256").distinct().count() == 1
    assert {r.label for r in S.class_tree(spark, str(tmp_path / "d"), {"images": "Img"}, 2).collect()} == {"Img"}


def test_coco_and_manifest(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}, {"id": 2, "file_name": "b", "width": 9, "height": 9}], "annotations": [{"image_id": 1, "bbox": [1, 2, 3, 4]}, {"image_id": 7, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert {r.image_id: len(r.boxes) for r in S.coco_labels(spark, str(tmp_path / "c.json")).collect()} == {1: 1, 2: 0}
    (tmp_path / "m.csv").write_text("image_path,label,source_type,group_id,split,verified,notes\na.jpg,30F12345,real,g,train,1,hi\n")
    row = S.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert row.row_number == 2 and row.metadata == {"notes": "hi"}
    sinks.write_manifest(S.read_manifest(spark, str(tmp_path / "m.csv")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == list(sinks.MANIFEST_FIELDS)
    (tmp_path / "bad.csv").write_text("image_path\na\n")
    with pytest.raises(ValueError):
        S.read_manifest(spark, str(tmp_path / "bad.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5, "x", 1.0, [1, 2]), ("a", 0.5, "y", 2.0, None)], "label string, ocr_confidence double, crop_name string, aspect_ratio double, box array<int>")
    sinks.write_candidates(df, str(tmp_path / "c"))
    got = spark.read.csv(str(tmp_path / "c"), header=True).orderBy("label").collect()
    assert got[0].ocr_confidence == "0.50000000" and got[1].box == "[1,2]"
    sinks.write_new(df, str(tmp_path / "n"))
    with pytest.raises(Exception):
        sinks.write_new(df, str(tmp_path / "n"))
    assert json.loads(sinks.report(df.select("label").orderBy("label"))) == [{"label": "a"}, {"label": "b"}]
    assert sinks.markdown(df.select(F.lit(1).alias("k")).limit(1)).endswith("| 1 |")
    with pytest.raises(ValueError):
        sinks.report(df, 1)


def test_rows_of_a_csv_of_several_splits(spark, tmp_path):
    """row_ord is the file's order, though Spark packs splits by their size: of equal keys the first row of the first file wins."""
    path = tmp_path / "registry"
    path.mkdir()
    want = []
    for name, n in (("a.csv", 30), ("b.csv", 900), ("c.csv", 300)):
        rows = [f"30F-{10000 + i % 50:05},brand {name},{name}{i}" for i in range(n)]
        (path / name).write_text("license_plate,car_brand,car_color\n" + "\n".join(rows) + "\n")
        want += [r.split(",")[2] for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = S.read_registry(spark, str(path))
        assert got.select("car_color").rdd.getNumPartitions() > 0
        assert [r.car_color for r in got.orderBy("row_ord").collect()] == want
        assert sorted(r.row_ord for r in got.collect()) == list(range(len(want)))
        first = {r.license_plate: r.car_color for r in R.first_by_key(got.select("license_plate", "car_color", "row_ord"), "license_plate", "row_ord").collect()}
        assert first["30F-10007"] == "a.csv7" and first["30F-10040"] == "b.csv40"
        manifest = tmp_path / "manifest.csv"
        manifest.write_text("image_path,label,source_type,group_id,split,verified,note\n" + "".join(f"{i}.jpg,30F12345,real,g,train,true,n{i}\n" for i in range(500)))
        rows = S.read_manifest(spark, str(manifest)).orderBy("row_number").collect()
        assert [(r.image_path, r.row_number, r.metadata) for r in rows] == [(f"{i}.jpg", i + 2, {"note": f"n{i}"}) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_photos_of_vehicles(spark):
    registry = spark.createDataFrame([("30F-123.45", "a", "RED", 0), ("51A99999", "b", "BLUE", 1), (" - ", "c", "", 2)], "license_plate string, car_brand string, car_color string, row_ord long")
    photos = spark.createDataFrame([("x/30F12345.png",), ("x/30F12345.jpg",), ("x/other.jpg",)], "path string")
    got = {r.plate_key: r.photo for r in S.list_vehicles(registry, photos).collect()}
    assert got == {"30F12345": "x/30F12345.jpg", "51A99999": None}


def test_layouts(spark, tmp_path):
    for root, names in (("flat", ["Red/1.jpg", "Blue/2.png"]), ("deep", ["train/Red/1.jpg", "valid/Red/2.jpg", "test/Blue/3.jpeg"])):
        for n in names:
            (tmp_path / root / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / root / n).write_bytes(b"x")
    assert {(r.label, r.split) for r in S.class_samples(spark, str(tmp_path / "flat")).collect()} == {("Red", None), ("Blue", None)}
    assert {(r.label, r.split) for r in S.class_samples(spark, str(tmp_path / "deep")).collect()} == {("Red", "train"), ("Red", "val"), ("Blue", "test")}


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_written", "_named", "_published"])
@pytest.mark.parametrize("after", [False, True])
def test_a_killed_commit_leaves_one_whole_version(spark, tmp_path, monkeypatch, step, after):
    path = str(tmp_path / "reg")
    rows = lambda k: spark.createDataFrame([(f"30F-{k}{i}", "Kia", "RED") for i in range(5)], S.REGISTRY)
    assert sinks.replace_registry(rows(1), path) == 1
    own = getattr(snapshots, step)

    def killed(*a):
        if after:
            own(*a)
        raise Killed

    monkeypatch.setattr(snapshots, step, killed)
    with pytest.raises(Killed):
        sinks.replace_registry(rows(2), path)
    monkeypatch.undo()
    done = after and step == "_published"
    assert {r.license_plate[4] for r in S.read_registry(spark, path).collect()} == {"2" if done else "1"} and S.read_registry(spark, path).count() == 5
    assert sinks.replace_registry(rows(3), path) == (3 if done else 2)
    assert {r.license_plate[4] for r in S.load_registry(spark, path).collect()} == {"3"}
    assert snapshots.vacuum(spark, path, 1) >= 1 and S.read_registry(spark, path).count() == 5


def test_a_lost_race_raises_and_a_change_is_made_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "reg")
    row = lambda p: spark.createDataFrame([(p, "Kia", "RED")], S.REGISTRY)
    sinks.replace_registry(row("30F-1"), path)
    base, _ = snapshots.current(spark, path)
    assert sinks.replace_registry(row("30F-2"), path, base) == 2
    with pytest.raises(snapshots.Conflict):
        sinks.replace_registry(row("30F-3"), path, base)
    assert [r.license_plate for r in S.read_registry(spark, path).collect()] == ["30F-2"]
    own, others = snapshots._written, [row("30F-4")]

    def slow(df, folder, write):
        own(df, folder, write)
        if others:
            monkeypatch.setattr(snapshots, "_written", own)
            sinks.change_registry(spark, path, lambda r: r.drop("row_ord").unionByName(others.pop()))

    monkeypatch.setattr(snapshots, "_written", slow)
    assert sinks.change_registry(spark, path, lambda r: r.drop("row_ord").unionByName(row("30F-5"))) == 4
    assert sorted(r.license_plate for r in S.read_registry(spark, path).collect()) == ["30F-2", "30F-4", "30F-5"]
    assert snapshots.current(spark, str(tmp_path / "none")) == (0, None)


def test_pairs_and_samples(spark, tmp_path):
    for name in ("clip3_new_1.jpg", "clip3_new_1.txt", "clip3_new_2.jpg", "other.jpg", "other.txt", "sub/clip3_new_3.jpg", "sub/clip3_new_3.TXT"):
        p = tmp_path / "clips" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    files = S.files_of(spark, str(tmp_path / "clips"), ("jpg", "txt"))
    assert sorted(r.image.rsplit("/", 1)[1] for r in S.sibling_pairs(files, "clip3_new_").collect()) == ["clip3_new_1.jpg", "clip3_new_3.jpg"]
    for k in range(8):
        for split in ("train", "val"):
            p = tmp_path / "cars" / split / ("WHITE" if k % 2 else "red") / f"{k}.jpg"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("x")
    names = {"white": "White", "red": "Red"}
    got = S.class_samples(spark, str(tmp_path / "cars"), names, 5).collect()
    assert sorted(r.label for r in got) == ["Red"] * 5 + ["White"] * 5 and {r.split for r in got} == {"train", "val"}
    assert S.class_samples(spark, str(tmp_path / "cars"), names).count() == 16
    with pytest.raises(ValueError, match="Blue"):
        S.class_samples(spark, str(tmp_path / "cars"), {**names, "blue": "Blue"})


def test_checksums_of_files_of_any_size(spark, tmp_path, monkeypatch):
    """Files over the bound are read in pieces, with the same result."""
    import hashlib

    want = {}
    for k, size in enumerate((1, 10, 5000, 3_000_000)):
        raw = bytes((i * 31 + k) % 251 for i in range(size))
        (tmp_path / f"{k}.jpg").write_bytes(raw)
        want[f"{k}.jpg"] = hashlib.sha256(raw).hexdigest()
    for bound in (S.WHOLE_BYTES, 4000):
        monkeypatch.setattr(S, "WHOLE_BYTES", bound)
        assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in S.checksums(spark, str(tmp_path)).collect()} == want
