import struct
import zlib

from pyspark.sql import functions as F

from moodframe.operators import images as im
from moodframe.operators import quality as q
from moodframe.plans import all_queries
from moodframe.sources import images as si
from moodframe.sources import posts as ps
from moodframe.sources import tables as tb


def test_six_sources_to_one_table(spark, tmp_path):
    files = {
        "v1": 'post_text,label,other\n"good, day",0,x\n',
        "v2": "filtered_tweet,is_depression\nfine,0\n",
        "v3": "text,class\nbad caf\xe9,suicide\n,non-suicide\n",
        "v4": "text,label\nhello,1\n",
        "v5": "index,message to examine,label (depression result)\n1,exam,1\n",
        "v6": 'clean_text,is_depression\n"two\nlines",0\n',
    }
    parts = []
    for source in ps.POST_SOURCES:
        path = tmp_path / f"{source.name}.csv"
        path.write_bytes(files[source.name].encode(source.encoding))
        parts.append(ps.read_posts(spark, str(path), source))
    rows = {(r["source"], r["filtered_tweet"], r["is_depression"]) for r in ps.union_posts(parts).collect()}
    assert rows == {
        ("v1", "good, day", 0), ("v2", "fine", 0), ("v3", "bad café", 1), ("v3", "nan", 0),
        ("v4", "hello", 1), ("v5", "exam", 1), ("v6", "two\nlines", 0),
    }
    cleaned = ps.clean_posts(ps.union_posts(parts)).filter(F.col("source") == "v1").first()
    assert cleaned["filtered_tweet"] == "good day"


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y",)], "s string")
    assert {(r["i"], r["s"]) for r in ps.union_posts([a, b]).collect()} == {(1, "x"), (None, "y")}


def test_headerless_latin1(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes('"4","1","Mon","NO_QUERY","me","tr\xe8s bien"\n"0","2","Mon","NO_QUERY","me","bad"\n'.encode("latin-1"))
    rows = {(r["sentiment"], r["text"]) for r in ps.read_sentiment140(spark, str(path)).collect()}
    assert rows == {(1, "très bien"), (0, "bad")}


def test_csv_round_trips_keep_odd_rows(spark, tmp_path):
    """Empty and missing texts stay apart, a source with a line break does not cut its row, and a
    label other than 1 is no positive one."""
    docs = [(1, None, "w"), (2, "", "w"), (3, "\u65e5", None), (4, "\xe9t\xe9 x", "a\nb"), (5, "none", "w"), (6, "two", "a,\r\nb")]
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1), (2, 1), (3, 0), (4, 1), (5, None), (6, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = all_queries()["s2_headerless_latin1_csv"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, None), (1, ""), (0, ""), (1, "\xe9t\xe9 x"), (0, "none"), (0, "two")], key=str)
    rows = all_queries()["s1_csv_round_trip"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(str(i), t) for i, t, _ in docs}


def test_validation_order_and_nulls(spark):
    rows = [("a", 1), ("a", 1), (" ", 1), (None, 0), ("b", None), ("c", 2), ("nan", 0)]
    df = spark.createDataFrame(rows, "t string, y int")
    assert {tuple(r) for r in q.clean_labelled(df, "t", "y").collect()} == {("a", 1), ("nan", 0)}
    assert {r["column_name"]: r["nulls"] for r in q.null_counts(df).collect()} == {"t": 1, "y": 1}


def test_request_and_user_reasons(spark):
    df = spark.createDataFrame([("ok",), ("",), (" \n",), ("x" * 5001,), (None,)], "text string")
    found = [r["r"] for r in df.select(q.request_errors(F.col("text")).alias("r")).collect()]
    assert found == [None, "too_short", "blank", "too_long", "missing"]


def test_users_append_unique_email(spark):
    users = spark.createDataFrame([("a", "a@x.org")], "name string, email string")
    fresh = spark.createDataFrame([("b", "a@x.org"), ("d", "c@x.org"), ("c", "c@x.org"), ("e", None), ("f", None)], users.schema)
    out = {(r["name"], r["email"]) for r in tb.new_users(fresh, users).collect()}
    assert out == {("c", "c@x.org"), ("e", None), ("f", None)}


def test_settings_become_key_paths():
    flat = tb.flatten_settings({"a": {"b": 1, "c": {"d": True}}, "e": [1, 2]})
    assert flat == [("a.b", "1"), ("a.c.d", "True"), ("e", "[1, 2]")]


def png(pixels):
    """Colour PNG from rows of (r, g, b)."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + bytes(v for p in row for v in p) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_images(folder):
    folder.mkdir()
    red, blue = (255, 0, 0), (0, 0, 255)
    (folder / "a 1.png").write_bytes(png([[red, blue], [blue, blue]]))
    (folder / "b.png").write_bytes(png([[blue, blue], [blue, blue]]))
    (folder / "nolabel.png").write_bytes(png([[red, red], [red, red]]))
    (folder / "broken.png").write_bytes(b"not an image")


def test_images_labels_and_alignment(spark, tmp_path):
    write_images(tmp_path / "img")
    (tmp_path / "labels.csv").write_text("file,label\na 1.png,1\nb.png,0\nbroken.png,1\nmissing.png,0\n")
    images = si.load_images(spark, str(tmp_path / "img"), tasks=2)
    assert {r["name"] for r in images.collect()} == {"a 1.png", "b.png", "nolabel.png"}
    assert {r["name"] for r in si.image_names(spark, str(tmp_path / "img")).collect()} >= {"broken.png"}
    labels = si.load_labels(spark, str(tmp_path / "labels.csv"))
    ready, report = im.prepare_images(images, labels)
    rows = {r["name"]: r for r in ready.collect()}
    assert set(rows) == {"a 1.png", "b.png"} and rows["a 1.png"]["label"] == 1
    # Blue first: red is (0, 0, 255) in storage.
    assert rows["a 1.png"]["features"][:6] == [0.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    assert rows["b.png"]["shape"] == [2, 2, 3]
    assert {(r["name"], r["missing"]) for r in report.collect()} == {
        ("nolabel.png", "label"), ("broken.png", "image"), ("missing.png", "image"),
    }


def test_crop_turns_to_red_first_and_skips_empty(spark, tmp_path):
    write_images(tmp_path / "img")
    images = si.load_images(spark, str(tmp_path / "img"))
    faces = [("a 1.png", [((5, 0, 2, 2), 0.95), ((0, 0, 1, 1), 0.9), ((0, 0, 1, 1), 0.89)]), ("b.png", [])]
    detections = spark.createDataFrame(faces, f"name string, faces {im.FACES}")
    kept = im.confident_faces(detections)
    assert [(r["name"], r["face_id"]) for r in kept.orderBy("face_id").collect()] == [("a 1.png", 1), ("a 1.png", 2)]
    crops = im.crop_faces(images.join(detections, "name"), size=(2, 2)).collect()
    assert [(c["face_id"], c["pixels"][:3]) for c in crops] == [(2, [1.0, 0.0, 0.0])]
    emotions = im.emotion_rows(spark.createDataFrame([("a 1.png", 2, 0.9, 0.5)], "name string, face_id int, confidence double, p1 double"))
    assert emotions.first()["dominant_emotion"] == "happy"
    out = {r["name"]: r for r in im.image_summary(detections, emotions).collect()}
    assert (out["a 1.png"]["faces_detected"], out["a 1.png"]["faces_processed"]) == (2, 1)
    assert out["b.png"]["message"] == "No faces detected" and out["b.png"]["results"] == []


def test_bilinear_resize_halves_by_means():
    import numpy as np

    image = np.arange(16, dtype=float).reshape(4, 4, 1)
    assert im.resize_bilinear(image, (2, 2))[:, :, 0].tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert im.resize_bilinear(image, (4, 4)).tolist() == image.tolist()


def test_augmentation_is_seeded(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(16)])], "id long, px array<double>")
    make = lambda: {r["variant"]: r["px"] for r in im.augment(df, "id", "px", 4, 4, 5).collect()}
    a, b = make(), make()
    assert a == b and len(a) == 5
    assert a[0] == df.first()["px"] and a[1][:4] == [3.0, 2.0, 1.0, 0.0]
    assert all(set(v) <= set(a[0]) for v in a.values())
