"""Moving point sets by a pose."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .filters import has


def transform_points(df: DataFrame, pose: np.ndarray | None = None) -> DataFrame:
    """df with its points, covariances and normals moved by one pose (4x4), or by each row's own in
    columns m00 to m23."""
    t = E.constant(np.asarray(pose)[:3]) if pose is not None else [[F.col(f"m{i}{j}") for j in range(4)] for i in range(3)]
    new = dict(zip(E.XYZ, E.move(t, [F.col(c) for c in E.XYZ])))
    if has(df, *E.COV):
        new |= dict(zip(E.COV, E.rotate_cov(t, [F.col(c) for c in E.COV])))
    if has(df, *E.NORMAL):
        new |= dict(zip(E.NORMAL, E.rotate(t, [F.col(c) for c in E.NORMAL])))
    return df.withColumns(new)


def transform_by_frame(df: DataFrame, poses: DataFrame) -> DataFrame:
    """df moved by its frame's pose in poses(frame_id, m00 .. m23)."""
    named = [f"m{i}{j}" for i in range(3) for j in range(4)]
    return transform_points(df.join(poses.select("frame_id", *named), "frame_id")).drop(*named)
