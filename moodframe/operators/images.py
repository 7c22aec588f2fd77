"""Image rows, face crops, emotion results and seeded augmentation.

An image row has name, height, width, n_channels and pixels (bytes, row by row, blue first
for colour). Decoding is the source's work; numpy runs inside tasks, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_CONFIDENCE = 0.9  # fixed value
FACE_SIZE = (48, 48)  # fixed value
# Augmentation ranges.
ROTATION, SHIFT, SHEAR, ZOOM = 10.0, 0.1, 0.1, 0.1

FACES = "array<struct<box:struct<x:int,y:int,w:int,h:int>,confidence:double>>"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _unit_pixels(data: pd.Series) -> pd.Series:
    return data.map(lambda b: np.frombuffer(b, np.uint8) / 255.0)


def scaled_pixels(pixels: Column) -> Column:
    """Array of numbers divided by 255, inside the JVM."""
    return F.transform(pixels, lambda x: x / F.lit(255.0))


def flat_features(images: DataFrame, out: str = "features") -> DataFrame:
    """One vector per image: all pixels in storage order, divided by 255."""
    return images.withColumn(out, _unit_pixels("pixels"))


def shaped_features(images: DataFrame, out: str = "features") -> DataFrame:
    """The same numbers with the shape kept beside them."""
    return flat_features(images, out).withColumn("shape", F.array("height", "width", "n_channels"))


def align_labels(images: DataFrame, labels: DataFrame, key: str = "name") -> DataFrame:
    """Image and label of the same name."""
    return images.join(labels, key)


def unmatched(images: DataFrame, labels: DataFrame, key: str = "name") -> DataFrame:
    """Names found on one side only, with the side that misses them."""
    no_label = images.select(key).join(labels.select(key), key, "left_anti")
    no_image = labels.select(key).join(images.select(key), key, "left_anti")
    return no_label.withColumn("missing", F.lit("label")).unionByName(
        no_image.withColumn("missing", F.lit("image"))
    )


def prepare_images(images: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flat and shaped rows with integer label, report of unmatched names)."""
    joined = align_labels(images, labels.withColumn("label", F.col("label").cast("int")))
    return shaped_features(joined), unmatched(images, labels)


def confident_faces(detections: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per kept face; face_id is its place among the kept faces of the image."""
    kept = F.filter("faces", lambda f: f["confidence"] >= min_confidence)
    rows = detections.select("name", F.posexplode(kept).alias("pos", "face"))
    return rows.select("name", (F.col("pos") + 1).alias("face_id"), "face.box", "face.confidence")


def resize_bilinear(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear resize with pixel centres aligned and edges repeated; rounds to whole
    levels for byte images."""
    height, width = size

    def axis(n_out, n_in):
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n_in - 1), at - low

    y0, y1, fy = axis(height, image.shape[0])
    x0, x1, fx = axis(width, image.shape[1])
    work = image.astype(float)
    fy, fx = fy[:, None, None], fx[None, :, None]
    top = work[y0][:, x0] * (1 - fx) + work[y0][:, x1] * fx
    low = work[y1][:, x0] * (1 - fx) + work[y1][:, x1] * fx
    out = top * (1 - fy) + low * fy
    return np.floor(out + 0.5) if image.dtype == np.uint8 else out


def crop_faces(
    images: DataFrame, min_confidence: float = MIN_CONFIDENCE, size: tuple[int, int] = FACE_SIZE, normalize: bool = True
) -> DataFrame:
    """Crops, resizes, turns blue-first to red-first and scales the kept faces of image rows
    with a ``faces`` column. Empty crops drop out, face_id counts them. An image travels to
    its task once, however many faces it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, h, w, c, data, faces in batch.itertuples(index=False, name=None):
                image = np.frombuffer(data, np.uint8).reshape(h, w, c)
                for face_id, face in enumerate(faces, 1):
                    box = face["box"]
                    x, y, bw, bh = box["x"], box["y"], box["w"], box["h"]
                    region = image[y : y + bh, x : x + bw]
                    if region.size == 0:
                        continue
                    crop = resize_bilinear(region, size)[:, :, ::-1]
                    pixels = (crop / 255.0 if normalize else crop).ravel()
                    rows.append((name, face_id, x, y, bw, bh, face["confidence"], pixels))
            yield pd.DataFrame(rows, columns=["name", "face_id", "x", "y", "w", "h", "confidence", "pixels"])

    kept = F.filter("faces", lambda f: f["confidence"] >= min_confidence)
    rows = images.select("name", "height", "width", "n_channels", "pixels", kept.alias("faces")).filter(F.size("faces") > 0)
    schema = "name string, face_id int, x int, y int, w int, h int, confidence double, pixels array<double>"
    return rows.mapInPandas(run, schema)


def emotion_rows(faces: DataFrame, probability: str = "p1", positive_name: str = "sad", negative_name: str = "happy") -> DataFrame:
    """Both probabilities and the dominant emotion; the model's output is read as the
    probability of ``positive_name``."""
    p = F.col(probability)
    return faces.withColumns(
        {
            f"{positive_name}_probability": p,
            f"{negative_name}_probability": 1.0 - p,
            "dominant_emotion": F.when(p > 0.5, positive_name).otherwise(negative_name),
        }
    )


def image_summary(detections: DataFrame, emotions: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per image: success, faces detected and processed, results, message, error.
    ``detections`` has name, faces (null when the image could not be read)."""
    listed = emotions.groupBy("name").agg(
        F.count("*").alias("_n"),
        F.sort_array(F.collect_list(F.struct("face_id", "dominant_emotion", "sad_probability", "happy_probability", "confidence"))).alias("_r"),
    )
    found = F.size(F.filter("faces", lambda f: f["confidence"] >= min_confidence))
    ok = F.col("faces").isNotNull()
    joined = detections.join(listed, "name", "left")
    detected = F.when(ok, found).otherwise(0)
    return joined.select(
        "name",
        ok.alias("success"),
        detected.cast("bigint").alias("faces_detected"),
        F.when(detected > 0, F.coalesce("_n", F.lit(0))).cast("bigint").alias("faces_processed"),
        F.coalesce("_r", F.array().cast(listed.schema["_r"].dataType)).alias("results"),
        F.when(ok & (detected == 0), "No faces detected").alias("message"),  # fixed value
        F.when(~ok, "could not load image").alias("error"),
    )


def _warp(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One random affine view with nearest fill: rotation, shear, zoom, shifts, flip."""
    h, w = image.shape[:2]
    turn = np.deg2rad(rng.uniform(-ROTATION, ROTATION))
    shear = np.deg2rad(rng.uniform(-SHEAR, SHEAR))
    zy, zx = rng.uniform(1 - ZOOM, 1 + ZOOM, 2)
    dy, dx = rng.uniform(-SHIFT, SHIFT) * h, rng.uniform(-SHIFT, SHIFT) * w
    flip = rng.random() < 0.5
    matrix = (
        np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        @ np.array([[1, -np.sin(shear)], [0, np.cos(shear)]])
        @ np.diag([zy, zx])
    )
    yy, xx = np.mgrid[0:h, 0:w].reshape(2, -1)
    centre = np.array([[(h - 1) / 2], [(w - 1) / 2]])
    src = matrix @ (np.vstack([yy, xx]) - centre) + centre + np.array([[dy], [dx]])
    y = np.clip(np.rint(src[0]), 0, h - 1).astype(int)
    x = np.clip(np.rint(src[1]), 0, w - 1).astype(int)
    out = image[y, x].reshape(image.shape)
    return out[:, ::-1] if flip else out


def augment(images: DataFrame, key: str, array_col: str, height: int, width: int, variants: int, seed: int = 42) -> DataFrame:
    """The original (variant 0), its mirror (variant 1) and ``variants - 2`` random views of
    each image, seeded by (seed, key, variant). Variants are spread over tasks first."""
    wide = images.select(
        F.col(key).cast("bigint").alias(key), F.col(array_col).cast("array<double>").alias(array_col),
        F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for k, data, v in zip(batch[key], batch[array_col], batch["variant"]):
                image = np.asarray(data).reshape(height, width, -1)
                if v == 1:
                    image = image[:, ::-1]
                elif v > 1:
                    image = _warp(image, np.random.default_rng([seed, int(k), int(v)]))
                made.append(image.ravel())
            batch[array_col] = made
            yield batch

    return wide.mapInPandas(run, f"{key} long, {array_col} array<double>, variant int")
