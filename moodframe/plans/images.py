"""Image and detection queries. Embeddings stand for 8 x 8 images and, cut up, for the
detections a face finder would report on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodframe.operators import images as im
from moodframe.plans.registry import query, table
from moodframe.plans.words import _KEPT, _POSTS, _posts
from moodframe.session import new_folder
from moodframe.sources.images import load_labels
from moodframe.sources import tables as tb
from moodframe.streaming import logstreams as ls
from moodframe.functions.lexicon import SAMPLE_POLARITY


def _pixel_images(spark, sf):
    """(name, height, width, n_channels, pixels): bytes from the embedding values."""
    hexes = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("bigint")), 2, "0"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("n_channels"), F.unhex(F.array_join(hexes, "")).alias("pixels"),
    )


_BYTES = "list_transform(embedding::DOUBLE[], lambda x: floor((x + 1) * 127.5))"


@query("i1_scaled_pixels", "SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE / 255, 9) AS value FROM embeddings, range(1, 65) t(i)")
def scaled(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(im.scaled_pixels(F.col("embedding").cast("array<double>"))).alias("pos", "value")
    )
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 9).alias("value"))


@query(
    "i1_flat_features",
    f"SELECT vec_id::VARCHAR AS name, round(list_sum({_BYTES}) / 255, 6) AS total, len(embedding)::BIGINT AS n_features FROM embeddings",
)
def flat(spark, sf):
    rows = im.flat_features(_pixel_images(spark, sf))
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return rows.select("name", F.round(total, 6).alias("total"), F.size("features").cast("bigint").alias("n_features"))


@query(
    "i2_shaped_features",
    f"SELECT vec_id::VARCHAR AS name, '8,8,1' AS shape, round(({_BYTES})[1] / 255, 9) AS first_pixel FROM embeddings",
)
def shaped(spark, sf):
    rows = im.shaped_features(_pixel_images(spark, sf))
    return rows.select(
        "name", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.round(F.col("features")[0], 9).alias("first_pixel")
    )


@query(
    "i3_prepared_images",
    f"SELECT vec_id::VARCHAR AS name, label, round(list_max({_BYTES}) / 255, 9) AS top FROM embeddings WHERE vec_id % 7 <> 0",
)
def prepared(spark, sf):
    images = _pixel_images(spark, sf)
    labels = table(spark, sf, "embeddings").filter(F.col("vec_id") % 7 != 0).select(F.col("vec_id").cast("string").alias("name"), "label")
    ready, _ = im.prepare_images(images, labels)
    return ready.select("name", "label", F.round(F.array_max("features"), 9).alias("top"))


@query(
    "j3_unmatched_names",
    """SELECT doc_id::VARCHAR AS name, 'label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id::VARCHAR, 'image' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def unmatched(spark, sf):
    name = F.col("doc_id").cast("string").alias("name")
    return im.unmatched(table(spark, sf, "documents").select(name), table(spark, sf, "labels").select(name))


@query("j3_aligned_labels", "SELECT d.doc_id::VARCHAR AS name, n_chars, quality AS label FROM documents d JOIN labels l USING (doc_id)")
def aligned(spark, sf):
    name = F.col("doc_id").cast("string").alias("name")
    images = table(spark, sf, "documents").select(name, "n_chars")
    return im.align_labels(images, table(spark, sf, "labels").select(name, F.col("quality").alias("label")))


@query("s5_label_file", "SELECT doc_id::VARCHAR AS name, quality AS label FROM labels")
def label_file(spark, sf):
    """Labels by position: the second column of a label file counts, whatever it is called."""
    path = new_folder(spark, "labels")
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("file"), "quality", "toxic")
    rows.write.option("header", True).csv(path)
    return load_labels(spark, path)


# Each image gets up to four faces; every ninth image could not be read.
_DETECTIONS = """detections AS (SELECT vec_id, vec_id::VARCHAR AS name, i, (i * 2) AS x, i AS y,
      CASE WHEN (vec_id + i) % 5 = 0 THEN 0 ELSE 4 END AS w, 4 AS h, (80 + (vec_id * 7 + i * 5) % 20) / 100.0 AS confidence,
      abs(embedding[i + 1])::DOUBLE * 2 AS p1 FROM embeddings, range(4) t(i) WHERE vec_id % 9 <> 0 AND i < vec_id % 5),
    kept AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS face_id FROM detections WHERE confidence >= 0.9)"""


def _detections(spark, sf):
    i, key = F.col("i"), F.col("vec_id")

    def face(i):
        return F.struct(
            F.struct(
                (i * 2).cast("int").alias("x"), i.cast("int").alias("y"),
                F.when((key + i) % 5 == 0, 0).otherwise(4).alias("w"), F.lit(4).alias("h"),
            ).alias("box"),
            ((80 + (key * 7 + i * 5) % 20) / F.lit(100.0)).alias("confidence"),
        )

    places = F.sequence(F.lit(0), F.lit(3))
    faces = F.filter(F.transform(places, face), lambda f: f["box"]["y"] < key % 5)
    return table(spark, sf, "embeddings").select(
        key.cast("string").alias("name"), F.when(key % 9 != 0, faces).alias("faces"), "vec_id", "embedding"
    )


@query("i4_confident_faces", f"WITH {_DETECTIONS} SELECT name, face_id, x, y, w::BIGINT AS w, h::BIGINT AS h, confidence::DOUBLE AS confidence FROM kept")
def confident(spark, sf):
    rows = im.confident_faces(_detections(spark, sf))
    return rows.select(
        "name", F.col("face_id").cast("bigint").alias("face_id"), *[F.col(f"box.{c}").cast("bigint").alias(c) for c in "xywh"], "confidence"
    )


def _crops(spark, sf, size=(2, 2)):
    rows = _pixel_images(spark, sf).join(_detections(spark, sf).select("name", "faces"), "name")
    return im.crop_faces(rows, size=size)


@query(
    "i5_cropped_faces",
    f"""WITH {_DETECTIONS}, px AS (SELECT vec_id, {_BYTES} AS b FROM embeddings),
    f AS (SELECT k.*, b FROM kept k JOIN px USING (vec_id) WHERE w > 0 AND x < 8)
    SELECT name, face_id, round(list_sum(list_transform(range(4), lambda c: CASE WHEN x + 4 <= 8 THEN floor((
        b[(y + (c // 2) * 2) * 8 + x + (c % 2) * 2 + 1] + b[(y + (c // 2) * 2) * 8 + x + (c % 2) * 2 + 2]
        + b[(y + (c // 2) * 2 + 1) * 8 + x + (c % 2) * 2 + 1] + b[(y + (c // 2) * 2 + 1) * 8 + x + (c % 2) * 2 + 2]) / 4 + 0.5)
      ELSE floor((b[(y + (c // 2) * 2) * 8 + x + (c % 2) + 1] + b[(y + (c // 2) * 2 + 1) * 8 + x + (c % 2) + 1]) / 2 + 0.5) END)) / 255, 6) AS total,
      4::BIGINT AS n_pixels FROM f""",
)
def cropped(spark, sf):
    total = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x)
    return _crops(spark, sf).select(
        "name", F.col("face_id").cast("bigint").alias("face_id"), F.round(total, 6).alias("total"), F.size("pixels").cast("bigint").alias("n_pixels")
    )


def _emotions(spark, sf):
    """Faces with a non-empty box, scored by an embedding value."""
    scores = _detections(spark, sf).select("name", "embedding")
    rows = im.confident_faces(_detections(spark, sf)).filter(F.col("box.w") > 0).join(scores, "name")
    p1 = F.abs(F.col("embedding")[F.col("box.y")]).cast("double") * 2
    return im.emotion_rows(rows.withColumn("p1", p1)).drop("embedding", "p1")


@query(
    "i6_emotion_results",
    f"""WITH {_DETECTIONS} SELECT name, face_id, round(p1, 6) AS sad_probability, round(1 - p1, 6) AS happy_probability,
      CASE WHEN p1 > 0.5 THEN 'sad' ELSE 'happy' END AS dominant_emotion FROM kept WHERE w > 0""",
)
def emotions(spark, sf):
    rows = _emotions(spark, sf)
    return rows.select(
        "name", F.col("face_id").cast("bigint").alias("face_id"), *[F.round(c, 6).alias(c) for c in ("sad_probability", "happy_probability")],
        "dominant_emotion",
    )


_SUMMARY = f"""{_DETECTIONS}, c AS (SELECT name, count(*) AS faces, count(*) FILTER (WHERE w > 0) AS done,
      string_agg(CASE WHEN p1 > 0.5 THEN 'sad' ELSE 'happy' END, ',' ORDER BY face_id) FILTER (WHERE w > 0) AS emotions FROM kept GROUP BY name),
    summary AS (SELECT vec_id::VARCHAR AS name, vec_id % 9 <> 0 AS success, coalesce(faces, 0) AS faces_detected, coalesce(emotions, '') AS emotions,
      CASE WHEN faces > 0 THEN done::VARCHAR END AS faces_processed, CASE WHEN vec_id % 9 <> 0 AND coalesce(faces, 0) = 0 THEN 'No faces detected' END AS message,
      CASE WHEN vec_id % 9 = 0 THEN 'could not load image' END AS error FROM embeddings e LEFT JOIN c ON c.name = e.vec_id::VARCHAR)"""


def _summary(spark, sf):
    return im.image_summary(_detections(spark, sf), _emotions(spark, sf))


@query("i7_image_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def summary(spark, sf):
    out = _summary(spark, sf)
    return out.select(
        "name", "success", "faces_detected", F.array_join(F.transform("results", lambda r: r["dominant_emotion"]), ",").alias("emotions"),
        F.col("faces_processed").cast("string").alias("faces_processed"), "message", "error",
    )


@query("s9_json_results", f"WITH {_SUMMARY} SELECT name, success, faces_detected, emotions FROM summary")
def json_results(spark, sf):
    out = _summary(spark, sf)
    path = new_folder(spark, "json")
    tb.write_json_results(out, path)
    back = spark.read.schema(out.schema).json(path)
    emotions = F.array_join(F.transform("results", lambda r: r["dominant_emotion"]), ",")
    return back.select("name", "success", "faces_detected", emotions.alias("emotions"))


@query(
    "i8_augmented_mirrors",
    """WITH v AS (SELECT vec_id, 0 AS variant, embedding::DOUBLE[] AS e FROM embeddings UNION ALL
      SELECT vec_id, 1, list_transform(range(64), lambda i: embedding[(i // 8) * 8 + 8 - i % 8]::DOUBLE) FROM embeddings)
    SELECT vec_id, variant, round(e[1], 6) AS first, round(e[8], 6) AS eighth, round(e[64], 6) AS last, round(list_sum(e), 6) AS total FROM v""",
)
def mirrors(spark, sf):
    out = im.augment(table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 8, 4).filter(F.col("variant") <= 1)
    at = lambda i: F.round(F.col("embedding")[i], 6)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", "variant", at(0).alias("first"), at(7).alias("eighth"), at(63).alias("last"), F.round(total, 6).alias("total"))


@query(
    "i8_augmented_counts",
    "SELECT variant, count(*) AS n, 64::BIGINT AS pixels FROM embeddings, (SELECT unnest(range(4))::INT AS variant) GROUP BY variant",
)
def augmented_counts(spark, sf):
    out = im.augment(table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 8, 4)
    return out.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("bigint").alias("pixels"))


def _post_stream(spark, sf):
    raw = table(spark, sf, "documents")
    stream = ls.read_stream(spark, f"{sf}/documents*.parquet", raw.schema).select(
        F.col("doc_id").alias("arrival"), "text", (F.col("n_chars") % 2).cast("int").alias("retweet_count")
    )
    return ls.labelled_posts_stream(stream, "text", SAMPLE_POLARITY)


@query("s6_streamed_posts", f"WITH {_POSTS} SELECT arrival, retweet_count, text, sentiment FROM posts")
def streamed_posts(spark, sf):
    path = new_folder(spark, "posts")
    run = (
        _post_stream(spark, sf).writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(_posts(spark, sf).schema).parquet(path)


@query("l2_unique_retweets_stream", f"WITH {_POSTS}, {_KEPT} SELECT arrival, retweet_count, text, sentiment FROM kept")
def unique_retweets_stream(spark, sf):
    path = new_folder(spark, "unique-posts")
    for run in ls.write_unique_posts(_post_stream(spark, sf), path, path + "-state"):
        run.awaitTermination()
    return ls.unique_posts(spark, path, _posts(spark, sf).schema)
