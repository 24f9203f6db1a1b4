"""Motion compensation of a sweep."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie
from .filters import has
from .imu import Bias, ImuParams, Preintegration
from .registration import Cloud

MARGIN_SECONDS = 0.05


class DeskewStatus(Enum):
    SUCCESS = "success"
    INSUFFICIENT_IMU_COVERAGE = "insufficient_imu_coverage"
    NO_TIMESTAMPS = "no_timestamps"
    INVALID_SCAN_DURATION = "invalid_scan_duration"
    EMPTY_CLOUD = "empty_cloud"


def deskew_points(points: DataFrame, before: np.ndarray, now: np.ndarray, seconds: float) -> DataFrame:
    """Moves each point by its share of the motion from one pose to the next, as expressions: the twist
    times the clamped time share, by Rodrigues' formula. Points without a finite time stay."""
    if not has(points, "t_offset_ms") or seconds <= 0:
        return points
    twist = lie.se3_log(lie.inverse_pose(before) @ now)
    w, v = twist[:3], twist[3:]
    angle = float(np.linalg.norm(w))
    K = lie.skew(w / angle) if angle > 1e-12 else np.zeros((3, 3))
    K2, t = K @ K, F.col("t_offset_ms")
    ok = E.finite("t_offset_ms")
    share = F.when(ok, E.clamp(F.when(ok, t) * 1e-3 / seconds, 0, 1)).otherwise(0.0)
    # the axis is the same for all points: only the share, its sine and one less its cosine vary
    timed = points.withColumn("_s", share).withColumn("_a", F.sin(F.col("_s") * angle)).withColumn("_b", 1 - F.cos(F.col("_s") * angle))
    s, a, b = F.col("_s"), F.col("_a"), F.col("_b")
    turn = [[E.lit(i == j) + a * float(K[i, j]) + b * float(K2[i, j]) for j in range(3)] for i in range(3)]
    safe = angle if angle > 1e-12 else 1.0
    shift = [s * float(v[i]) + b * float((K @ v)[i] / safe) + (s - a / safe) * float((K2 @ v)[i]) for i in range(3)]
    new = {c: x + d for c, x, d in zip(E.XYZ, E.rotate(turn, [F.col(c) for c in E.XYZ]), shift)}
    if has(points, *E.NORMAL):
        new |= dict(zip(E.NORMAL, E.rotate(turn, [F.col(c) for c in E.NORMAL])))
    if has(points, *E.COV):
        new |= dict(zip(E.COV, E.rotate_cov(turn, [F.col(c) for c in E.COV])))
    return timed.withColumns({c: F.when(ok, x).otherwise(F.col(c)) for c, x in new.items()}).select(*points.columns)


def _apply(cloud: Cloud, T: np.ndarray, ok: np.ndarray) -> Cloud:
    R = T[:, :3, :3]
    keep = lambda new, old: np.where(ok.reshape(-1, *[1] * (old.ndim - 1)), new, old)
    return Cloud(
        keep((R @ cloud.xyz[..., None])[..., 0] + T[:, :3, 3], cloud.xyz),
        None if cloud.cov is None else keep(R @ cloud.cov @ np.swapaxes(R, 1, 2), cloud.cov),
        None if cloud.normal is None else keep((R @ cloud.normal[..., None])[..., 0], cloud.normal),
        cloud.t_offset_ms, cloud.intensity,
    )


def deskew_cloud(cloud: Cloud, before: np.ndarray, now: np.ndarray, seconds: float = -1.0) -> Cloud | None:
    """deskew_points() on one frame's arrays; None if it has no times or no duration."""
    if not len(cloud) or cloud.t_offset_ms is None:
        return None
    if seconds <= 0:
        seconds = float(np.nanmax(np.where(np.isfinite(cloud.t_offset_ms), cloud.t_offset_ms, np.nan))) * 1e-3 if np.isfinite(cloud.t_offset_ms).any() else 0.0
    if seconds <= 0:
        return None
    ok = np.isfinite(cloud.t_offset_ms)
    share = np.clip(np.where(ok, cloud.t_offset_ms, 0) * 1e-3 / seconds, 0, 1)
    return _apply(cloud, lie.se3_exp(share[:, None] * lie.se3_log(lie.inverse_pose(before) @ now)), ok)


def imu_trajectory(rows: np.ndarray, start: float, seconds: float, T_imu_lidar: np.ndarray, bias: Bias, params: ImuParams, R_world: np.ndarray, velocity: np.ndarray, gyro_only: bool = False):
    """(status, times from the start, lidar poses relative to it) over a sweep, from samples (ts, gyro,
    accel) in order that cover it up to MARGIN_SECONDS at each end."""
    if seconds <= 0:
        return DeskewStatus.INVALID_SCAN_DURATION, None, None
    end = start + seconds
    use = rows[(rows[:, 0] >= start - MARGIN_SECONDS) & (rows[:, 0] <= end + MARGIN_SECONDS)]
    if len(use) < 2 or use[0, 0] > start + MARGIN_SECONDS or use[-1, 0] < end - MARGIN_SECONDS:
        return DeskewStatus.INSUFFICIENT_IMU_COVERAGE, None, None
    k = int(np.searchsorted(use[:, 0], start))
    if 0 < k < len(use):
        a, b = use[k - 1], use[k]
        first = a + (b - a) * (start - a[0]) / (b[0] - a[0])
    else:
        first = use[min(k, len(use) - 1)].copy()
    first[0] = start
    sums = Preintegration(params)
    sums.reset(bias)
    sums.extend(first[None])
    times, poses, back = [0.0], [np.eye(4)], lie.inverse_pose(T_imu_lidar)
    for r in use[k:]:
        sums.extend(r[None])
        rel = lie.pose(sums.state.R, np.zeros(3)) if gyro_only else sums.predict_relative(R_world, velocity, bias)
        times.append(r[0] - start)
        poses.append(T_imu_lidar @ rel @ back)
    if len(times) < 2 or times[-1] < seconds - MARGIN_SECONDS:
        return DeskewStatus.INSUFFICIENT_IMU_COVERAGE, None, None
    return DeskewStatus.SUCCESS, np.array(times), np.stack(poses)


def poses_at(times: np.ndarray, poses: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Poses between the two that enclose each time: rotation along the arc, translation along the line."""
    k = np.clip(np.searchsorted(times, at, side="right") - 1, 0, len(times) - 2)
    gap = times[k + 1] - times[k]
    a = np.where(gap > 0, np.clip((at - times[k]) / np.where(gap > 0, gap, 1), 0, 1), 0.0)
    q = lie.rotation_to_quaternion(poses[:, :3, :3])
    t = poses[:, :3, 3]
    return lie.pose(lie.quaternion_to_rotation(lie.slerp(q[k], q[k + 1], a)), t[k] + a[:, None] * (t[k + 1] - t[k]))


def deskew_by_imu(cloud: Cloud, rows: np.ndarray, start: float, seconds: float, T_imu_lidar: np.ndarray, bias: Bias, params: ImuParams, R_world: np.ndarray, velocity: np.ndarray, gyro_only: bool = False) -> tuple[DeskewStatus, Cloud]:
    """(status, cloud in the sensor's frame at the sweep's start); the cloud as it was unless success."""
    if not len(cloud):
        return DeskewStatus.EMPTY_CLOUD, cloud
    if cloud.t_offset_ms is None:
        return DeskewStatus.NO_TIMESTAMPS, cloud
    status, times, poses = imu_trajectory(rows, start, seconds, T_imu_lidar, bias, params, R_world, velocity, gyro_only)
    if status is not DeskewStatus.SUCCESS:
        return status, cloud
    ok = np.isfinite(cloud.t_offset_ms)
    return status, _apply(cloud, poses_at(times, poses, np.where(ok, cloud.t_offset_ms, 0) * 1e-3), ok)


POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def interpolate_poses(points: DataFrame, trajectory: DataFrame, time: str = "ts", by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """points with the pose (tx .. qw) of trajectory(by.., ts, tx .. qw) at their time: an as-of join.

    Both sides go through one window a stream that carries the last and next pose along, so there is
    one shuffle and no range join. Before the first or after the last pose the nearest one holds."""
    mark = trajectory.select(*by, F.col("ts").alias("_ts"), *(F.col(c).alias(f"_{c}") for c in POSE)).withColumn("_kind", F.lit(0))
    rows = points.withColumn("_ts", F.col(time)).withColumn("_kind", F.lit(1))
    both = rows.unionByName(mark, allowMissingColumns=True)
    pose = F.when(F.col("_kind") == 0, F.struct("_ts", *(f"_{c}" for c in POSE)))
    back = Window.partitionBy(*by).orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # the next pose is the last one of the reversed order, so both frames grow and neither is recomputed
    ahead = Window.partitionBy(*by).orderBy(F.desc("_ts"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_p", pose).withColumn("_a", F.last("_p", True).over(back)).withColumn("_b", F.last("_p", True).over(ahead)).where("_kind = 1")
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    gap = b["_ts"] - a["_ts"]
    t = F.coalesce((F.col("_ts") - a["_ts"]) / F.when(gap > 0, gap), E.lit(0))
    line = [a[f"_{c}"] + t * (b[f"_{c}"] - a[f"_{c}"]) for c in POSE[:3]]
    p, q = [a[f"_{c}"] for c in POSE[3:]], [b[f"_{c}"] for c in POSE[3:]]
    turn = E.dot(p, q)
    q = [F.when(turn < 0, -c).otherwise(c) for c in q]
    angle = F.acos(F.least(F.abs(turn), E.lit(1)))
    sin = F.sin(angle)
    near_ = sin < 1e-9
    wa = F.when(near_, 1 - t).otherwise(F.sin((1 - t) * angle) / F.when(near_, E.lit(1)).otherwise(sin))
    wb = F.when(near_, t).otherwise(F.sin(t * angle) / F.when(near_, E.lit(1)).otherwise(sin))
    arc = [wa * x + wb * y for x, y in zip(p, q)]
    return near.select(*points.columns, *(c.alias(n) for c, n in zip(line + arc, POSE)))
