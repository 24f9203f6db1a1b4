"""Grouping points by voxel or polar cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from .filters import has


def _polar(distance: float, elevation: float, azimuth: float, system: str) -> tuple[list[Column], Column]:
    """Range, elevation and azimuth over their bin sizes, and where they are defined."""
    x, y, z = (F.col(c) for c in E.XYZ)
    if system.lower() == "lidar":
        flat, az, up = F.sqrt(x * x + y * y), F.atan2(y, x), z
    elif system.lower() == "camera":
        flat, az, up = F.sqrt(x * x + z * z), F.atan2(x, z), -y
    else:
        raise ValueError(f"no coordinate system {system!r}")
    r = F.sqrt(x * x + y * y + z * z)
    parts = ((r, distance), (F.atan2(up, flat), elevation), (az, azimuth))
    return [v * E.lit(1.0 / s) for v, s in parts], (flat > 0) & (r < E.lit(float("inf")))


def polar_bins(df: DataFrame, distance: float, elevation: float, azimuth: float, system: str = "lidar") -> list[Column]:
    """Range, elevation and azimuth bins; null for a point at the origin or on the vertical axis."""
    scaled, ok = _polar(distance, elevation, azimuth, system)
    return [F.when(ok, F.floor(v)) for v in scaled]


def aggregates(df: DataFrame) -> list[Column]:
    """Means of the coordinates, colours and time offset and the median intensity, of what df has."""
    mean = [c for c in (*E.XYZ, *E.RGBA, "t_offset_ms") if c in df.columns]
    out = [F.avg(c).alias(c) for c in mean]
    return out + [F.median("intensity").alias("intensity")] if has(df, "intensity") else out


def _downsample(df: DataFrame, key: Column, by: tuple[str, ...], least: int) -> DataFrame:
    grouped = df.withColumn("key", key).where(F.col("key").isNotNull()).groupBy(*by, "key")
    return grouped.agg(*aggregates(df), F.count("*").alias("n")).where(F.col("n") >= least)


def voxel_downsample(df: DataFrame, size: float, least: int = 1, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """One point for each voxel of a frame with at least `least` points: key, means, n. Normals and
    covariances are dropped. Partial sums are combined before the shuffle on (frame, key)."""
    if size <= 0:
        raise ValueError("the voxel size must be positive")
    return _downsample(df, E.voxel_key(size), by, least)


def polar_downsample(df: DataFrame, distance: float, elevation: float, azimuth: float, system: str = "lidar", least: int = 1, by: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    if min(distance, elevation, azimuth) <= 0:
        raise ValueError("bin sizes must be positive")
    return _downsample(df, E.pack_key(*_polar(distance, elevation, azimuth, system)), by, least)


def inclusive_scan(df: DataFrame, flag: Column, by: str = "frame_id") -> DataFrame:
    """df with `scan`: how many flags are set up to each point of its frame."""
    w = Window.partitionBy(by).orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("scan", F.sum(F.when(flag, 1).otherwise(0)).over(w).cast("long"))


RINGS = 256


def _terms(df: DataFrame) -> DataFrame:
    r2 = E.dot(*[[F.col(c) for c in E.XYZ]] * 2)
    return df.withColumn("_r2", r2).withColumn("_ref", F.col("intensity") * F.col("_r2")).withColumn("_amb", F.col("ambient") / F.when(F.col("_r2") >= 1e-6, F.col("_r2")))


def ring_means(df: DataFrame) -> DataFrame:
    """(frame_id, ring, m_ref, m_amb): means of intensity times squared range and of ambient light over
    it, for rings below 256 and points farther than a millimetre."""
    use = _terms(df).where((F.col("ring") >= 0) & (F.col("ring") < RINGS) & (F.col("_r2") >= 1e-6))
    return use.groupBy("frame_id", "ring").agg(F.avg("_ref").alias("m_ref"), F.avg("_amb").alias("m_amb"))


def smooth_rings(means: DataFrame, alpha: float) -> DataFrame:
    """ring_means() smoothed over frames: the first observation as it is, then alpha of the new one; a
    null mean starts anew. A fold over each ring's frames in order, linear in their number."""

    def fold(frames: pd.DataFrame) -> pd.DataFrame:
        out = frames.sort_values("frame_id").reset_index(drop=True)
        for c in ("m_ref", "m_amb"):
            values, last = out[c].to_numpy(float), np.nan
            for k, v in enumerate(values.tolist()):
                last = v if last != last else (1 - alpha) * last + alpha * v
                values[k] = last
            out[c] = pd.Series(values).astype(object).where(~np.isnan(values), None)
        return out

    return means.select("frame_id", "ring", "m_ref", "m_amb").groupBy("ring").applyInPandas(fold, "frame_id long, ring long, m_ref double, m_amb double")


def enhanced_reflectivity(df: DataFrame, means: DataFrame, clip: float = 10.0) -> DataFrame:
    """df with `reflectivity`: both terms over their ring's means, summed and clipped to [0, clip]; 0
    for rings from 256 on and points at the sensor. means holds 256 rows a frame at most."""
    joined = _terms(df).join(means, ["frame_id", "ring"], "left")
    part = lambda v, m: F.coalesce(F.col(v) / F.when(F.col(m) > 0, F.col(m)), E.lit(0))
    value = E.clamp(part("_ref", "m_ref") + part("_amb", "m_amb"), 0, clip)
    ok = (F.col("ring") >= 0) & (F.col("ring") < RINGS) & (F.col("_r2") >= 1e-6)
    return joined.withColumn("reflectivity", F.when(ok, value).otherwise(0.0)).select(*df.columns, "reflectivity")
