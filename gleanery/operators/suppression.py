"""Suppression of overlapping boxes. A group is one image's boxes, handled as one row's array or one task's frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

BOX = "struct<score:double,id:bigint,x1:double,y1:double,x2:double,y2:double>"


def hard(df: DataFrame, group: str, iou: float = 0.4) -> DataFrame:
    """Greedy: by score (ties by smaller id) a box stays unless it overlaps a kept one by more than ``iou``.

    ``df`` has ``group``, ``id``, ``score``, ``x1``, ``y1``, ``x2``, ``y2``; the kept rows come back."""
    boxes = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("score").cast("double")).alias("minus"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]))),
        lambda b: F.struct((-b["minus"]).alias("score"), b["id"].alias("id"), *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")]),
    )

    def step(kept: Column, box: Column) -> Column:
        return F.when(F.exists(kept, lambda k: geometry.iou_corners(k, box) > iou), kept).otherwise(F.concat(kept, F.array(box)))

    kept = df.groupBy(group).agg(boxes.alias("boxes")).select(group, F.aggregate("boxes", F.array().cast(f"array<{BOX}>"), step).alias("kept"))
    return kept.select(group, F.explode("kept").alias("box")).select(group, "box.*")


def soft(df: DataFrame, group: str) -> DataFrame:
    """Decaying suppression of faces: ``df`` also has ``eye_x`` and ``eye_y``, the centre between the eyes.

    A lower box that is a likely duplicate (much overlap, or some with near eyes and a like size) loses most of its
    score, another overlapping one some; a box whose score fell below 0.1 goes. Scores come back as they were."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x1, y1, x2, y2, ex, ey = (pdf[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2", "eye_x", "eye_y"))
        size, now, keep = (x2 - x1) * (y2 - y1), pdf["score"].to_numpy(float).copy(), []
        for i in range(len(pdf)):
            if now[i] < 0.1:
                continue
            keep.append(i)
            j = np.arange(i + 1, len(pdf))
            j = j[now[j] >= 0.1]
            inter = np.maximum(np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]), 0) * np.maximum(np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]), 0)
            union = size[i] + size[j] - inter
            iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
            far = np.hypot(ex[i] - ex[j], ey[i] - ey[j])
            ratio = np.divide(np.maximum(size[i], size[j]), np.minimum(size[i], size[j]), out=np.full(len(j), np.inf), where=np.minimum(size[i], size[j]) > 0)
            twin = (iou > 0.35) | ((iou > 0.2) & (far < 25)) | ((iou > 0.15) & (far < 15) & (ratio < 1.3))
            decay = np.where(twin, np.maximum(1 - 1.8 * iou, 0.03), np.where(iou > 0.25, np.maximum(1 - 1.5 * iou, 0.05), 1.0))
            decay = np.where(twin & (far < 15), np.minimum(decay, 0.05), decay)
            now[j] *= decay
        return pdf.loc[keep]

    return df.groupBy(group).applyInPandas(run, df.schema)


def adjacent(boxes: Column, within: int = 20) -> Column:
    """Of an array of structs x, y, w, h in order: those that differ from the last kept by ``within`` or more somewhere."""

    def step(kept: Column, b: Column) -> Column:
        last = F.element_at(kept, -1)
        same = F.lit(True)
        for c in ("x", "y", "w", "h"):
            same = same & (F.abs(b[c] - last[c]) < within)
        return F.when(F.size(kept) == 0, F.array(b)).when(same, kept).otherwise(F.concat(kept, F.array(b)))

    return F.aggregate(F.slice(boxes, F.lit(2), F.greatest(F.size(boxes) - 1, F.lit(0))), F.slice(boxes, 1, 1), step)
