"""Pose- and size-free landmarks: similarity fits, neutral faces, normalized frames.

The fits are small matrix problems, solved for a whole Arrow batch at once; Spark
partitions the frames and joins each session's neutral face to them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable import anatomy
from kinetable.operators.filters import rest_frames
from kinetable.operators.vectors import median_vector


def canonical_template() -> np.ndarray:
    """The reference face: known points, completed and made symmetric; the rest at the origin."""
    face, twin = np.zeros((anatomy.LANDMARKS, 3)), np.arange(anatomy.LANDMARKS)
    face[list(anatomy.TEMPLATE_POINTS)] = list(anatomy.TEMPLATE_POINTS.values())
    pairs = np.array(anatomy.MIRROR_PAIRS)
    twin[pairs] = pairs[:, ::-1]
    known, mirrored = face.any(axis=1), face[twin] * (-1.0, 1.0, 1.0)
    # A point and its twin's mirror image count alike; where one is unknown, the other stands for both.
    weights = np.stack([known, known[twin]]).astype(float)
    weights[1, twin == np.arange(anatomy.LANDMARKS)] = 0.0
    total = np.maximum(weights.sum(axis=0), 1.0)[:, None]
    face = (face * weights[0][:, None] + mirrored * weights[1][:, None]) / total
    face[list(anatomy.MIDLINE), 0] = 0.0
    return face


@dataclass(frozen=True)
class FaceModel:
    """Which landmarks mean what, and the template they are fitted to."""

    template: np.ndarray = field(default_factory=canonical_template)
    anchors: Sequence[int] = anatomy.ANCHORS
    lips: Sequence[int] = anatomy.LIPS
    eyes: Sequence[int] = anatomy.EYES
    nose: Sequence[int] = anatomy.NOSE
    mouth_span: tuple[int, int] = anatomy.MOUTH_SPAN
    pupil_span: tuple[int, int] = anatomy.PUPIL_SPAN
    nose_span: tuple[int, int] = anatomy.NOSE_SPAN

    @property
    def size(self) -> int:
        return len(self.template)


def fit_similarity(source: np.ndarray, target: np.ndarray):
    """Scale, rotation and shift taking each (K,3) point set of a batch to ``target``.

    Least squares with a proper rotation; degenerate sets get the identity.
    """
    mean_s, mean_t = source.mean(axis=1, keepdims=True), target.mean(axis=0)
    centred, goal = source - mean_s, target - mean_t
    spread = (centred**2).sum(axis=2).mean(axis=1)
    flat = spread < 1e-12
    u, d, vt = np.linalg.svd(np.einsum("ki,nkj->nij", goal, centred) / len(target))
    sign = np.ones_like(d)
    sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) >= 0, 1.0, -1.0)
    rotation = (u * sign[:, None, :]) @ vt
    scale = (d * sign).sum(axis=1) / np.where(flat, 1.0, spread)
    shift = mean_t - scale[:, None] * np.einsum("nij,nj->ni", rotation, mean_s[:, 0])
    rotation[flat], scale[flat], shift[flat] = np.eye(3), 1.0, 0.0
    return scale, rotation, shift


def apply_similarity(points: np.ndarray, scale, rotation, shift) -> np.ndarray:
    return scale[:, None, None] * (points @ rotation.transpose(0, 2, 1)) + shift[:, None, :]


def _points(column: pd.Series) -> np.ndarray:
    flat = np.stack(column.to_numpy()).astype(float)
    return flat.reshape(len(flat), -1, 3)


def _flat(points: np.ndarray, dtype=np.float32) -> list[np.ndarray]:
    return list(points.reshape(len(points), -1).astype(dtype))


def fit_alignment(df: DataFrame, landmarks: str, model: FaceModel) -> DataFrame:
    """Add ``fit``: scale, row-major rotation and shift to the template's anchors."""
    anchors, target = list(model.anchors), model.template[list(model.anchors)]

    @F.pandas_udf("scale double, rotation array<double>, shift array<double>")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                yield pd.DataFrame({"scale": [], "rotation": [], "shift": []})
                continue
            scale, rotation, shift = fit_similarity(_points(batch)[:, anchors], target)
            yield pd.DataFrame({"scale": scale, "rotation": _flat(rotation, float), "shift": list(shift)})

    return df.withColumn("fit", fit(F.col(landmarks)))


def align(df: DataFrame, landmarks: str, model: FaceModel, name: str = "aligned") -> DataFrame:
    """Add the landmarks moved onto the template by their own fit."""
    anchors, target = list(model.anchors), model.template[list(model.anchors)]

    @F.pandas_udf("array<double>")
    def move(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
                continue
            points = _points(batch)
            yield pd.Series(_flat(apply_similarity(points, *fit_similarity(points[:, anchors], target)), float))

    return df.withColumn(name, move(F.col(landmarks)))


def neutral_faces(df: DataFrame, key: Sequence[str], landmarks: str, rest: Column, model: FaceModel) -> DataFrame:
    """One aligned resting face per session: element-wise median of its resting rows."""
    median = median_vector(rest_frames(df, rest, key=key), key, landmarks, "_median")
    single = F.transform("_median", lambda x: x.cast("float"))
    return align(median.withColumn("_median", single), "_median", model, "neutral").drop("_median")


NORMALIZED = ("canonical", "deltas", "symmetric", "asymmetric", "residual")


def normalize_batch(points: np.ndarray, neutral: np.ndarray, model: FaceModel) -> dict[str, np.ndarray]:
    """Normalize (N,P,3) points given their (N,P,3) neutral faces."""
    anchors = list(model.anchors)
    aligned = apply_similarity(points, *fit_similarity(points[:, anchors], model.template[anchors]))
    deltas = aligned - neutral
    for group, (a, b) in ((model.lips, model.mouth_span), (model.eyes, model.pupil_span), (model.nose, model.nose_span)):
        own = np.maximum(1e-4, np.linalg.norm(neutral[:, a] - neutral[:, b], axis=1))
        deltas[:, list(group)] *= (np.linalg.norm(model.template[a] - model.template[b]) / own)[:, None, None]
    residual = deltas[:, anchors].copy()
    deltas[:, anchors] = 0.0
    canonical = model.template + deltas
    mirrored = (canonical * (-1.0, 1.0, 1.0))[:, anatomy.mirror_index(model.size)]
    return {
        "canonical": canonical, "deltas": deltas, "symmetric": 0.5 * (canonical + mirrored),
        "asymmetric": 0.5 * (canonical - mirrored), "residual": residual,
    }


def normalize_frames(df: DataFrame, neutral: DataFrame, key: Sequence[str], landmarks: str, model: FaceModel) -> DataFrame:
    """Add canonical landmarks, deltas, symmetric and asymmetric parts.

    ``residual`` holds the anchor deltas before they are set to zero.
    """
    fields = [T.StructField(n, T.ArrayType(T.FloatType())) for n in NORMALIZED]

    @F.pandas_udf(T.StructType(fields))
    def normalize(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for points, faces in batches:
            if points.empty:
                yield pd.DataFrame({n: [] for n in NORMALIZED})
                continue
            parts = normalize_batch(_points(points), _points(faces), model)
            yield pd.DataFrame({n: _flat(parts[n]) for n in NORMALIZED})

    rows = df.join(neutral, list(key))
    return rows.withColumn("_n", normalize(F.col(landmarks), F.col("neutral"))).select(*df.columns, "_n.*")
