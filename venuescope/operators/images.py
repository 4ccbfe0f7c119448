"""Whether a place's pictures suffice for a reconstruction, and statistics of pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of shots and what sets of them allow.
UNKNOWN = "미분류"
KEY_SHOTS = ["실내 전경", "좌석 영역", "카운터/바", "창가/뷰"]


def readiness(images: DataFrame, key_shots: list[str] = KEY_SHOTS, unknown: str = UNKNOWN) -> DataFrame:
    """Per place: score 0 to 100, label, pictures, kinds of shots, mean megapixels.

    images: place, shot_type, megapixels, in_sequence (whether the place was filmed in one walk)."""
    kinds = F.collect_set(F.when((F.col("shot_type") != unknown) & (F.col("shot_type") != ""), F.col("shot_type")))
    sums = images.groupBy("place").agg(F.count(F.lit(1)).alias("images"), kinds.alias("kinds"), F.avg("megapixels").alias("megapixels"), F.max("in_sequence").alias("in_sequence"))
    score = (
        F.least(F.lit(40), F.col("images") * 4)
        + F.least(F.lit(25), F.size("kinds") * 6)
        + F.when(F.col("in_sequence"), 20).otherwise(0)
        + F.when(F.col("megapixels") >= 1.2, 10).when(F.col("megapixels") >= 0.6, 5).otherwise(0)
        + F.when(F.arrays_overlap("kinds", F.array(*map(F.lit, key_shots))), 5).otherwise(0)
    )
    told = sums.withColumn("score", F.least(F.lit(100), score).cast("int"))
    label = F.when(F.col("score") >= 75, "high").when(F.col("score") >= 45, "medium").otherwise("low")
    return told.select("place", "score", label.alias("label"), "images", F.size("kinds").alias("shot_types"), "megapixels", "kinds")


def holds_all(kinds: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), kinds)) == 0


def pixel_stats(pixels: np.ndarray) -> tuple[float, float, float, float] | None:
    """Brightness, contrast, colourfulness and megapixels of an array of height, width and at least three channels."""
    if pixels is None or pixels.ndim != 3 or pixels.shape[2] < 3:
        return None
    own = pixels.astype(np.float32)
    r, g, b = (own[:, :, i] for i in range(3))
    apart, warm = np.abs(r - g), np.abs((r + g) / 2 - b)
    colour = np.hypot(apart.std(), warm.std()) + 0.3 * np.hypot(apart.mean(), warm.mean())
    return float(own.mean()), float(own.std()), float(colour), own.shape[0] * own.shape[1] / 1e6


def image_stats(images: DataFrame, key: str = "path") -> DataFrame:
    """Statistics of raw pictures: key, pixels (binary, eight bits a channel), height, width, channels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *(pixel_stats(np.frombuffer(p, np.uint8).reshape(h, w, c)) or (None,) * 4)) for k, p, h, w, c in zip(f[key], f["pixels"], f["height"], f["width"], f["channels"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "brightness", "contrast", "colourfulness", "megapixels"])

    return images.select(key, "pixels", "height", "width", "channels").mapInPandas(run, "key string, brightness double, contrast double, colourfulness double, megapixels double").withColumnRenamed("key", key)
