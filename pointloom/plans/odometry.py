"""Frame-by-frame odometry. Poses depend on the frame before, so a stream is a fold; streams run side
by side, in batch (run_streams) or as Structured Streaming state (pointloom.streaming)."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lie
from ..operators import features, filters, lio, sampling, voxel
from ..operators import registration as reg
from ..operators.deskew import deskew_by_imu
from ..operators.imu import AXES, AlignmentGate, AlignmentParams, Bias, ImuParams, Preintegration, State, VelocityCorrector
from ..operators.maps import OccupancyParams, VoxelMapParams
from ..operators.registration import Cloud
from .local_maps import LocalOccupancy, LocalVoxelMap, voxel_keys


class Status(Enum):
    """Codes from 100 on are errors."""

    SUCCESS = 0
    FIRST_FRAME = 1
    WAITING_INITIAL_ALIGNMENT = 2
    IMU_ONLY = 3
    ERROR = 100
    OLD_TIMESTAMP = 101
    SMALL_NUMBER_OF_POINTS = 102
    NO_IMU = 103


class MotionMode(Enum):
    CONSTANT_VELOCITY = "constant_velocity"
    GYRO = "gyro"
    IMU_SE3 = "imu_se3"

    @classmethod
    def from_string(cls, text: str) -> "MotionMode":
        return cls(text.strip().lower())


class MapType(Enum):
    VOXEL = "voxel"
    OCCUPANCY = "occupancy"

    @classmethod
    def from_string(cls, text: str) -> "MapType":
        return cls(text.strip().lower())


@dataclass(frozen=True)
class Axis:
    factor_min: float = 0.2
    factor_max: float = 1.0
    low: float = 1.0
    high: float = 10.0


@dataclass(frozen=True)
class PreprocessParams:
    box_min: float = 1.0
    box_max: float = 3.4028234663852886e38
    polar: tuple[float, float, float] | None = None
    voxel: float | None = None
    sample: int | None = None
    angle: tuple[float, float] | None = None
    intensity: dict | None = None
    smooth: dict | None = None
    local_mean: dict | None = None
    seed: int = sampling.SEED


@dataclass(frozen=True)
class OdometryParams:
    preprocess: PreprocessParams = field(default_factory=PreprocessParams)
    registration: reg.Params = field(default_factory=reg.Params)
    pipeline: reg.PipelineParams = field(default_factory=lambda: reg.PipelineParams(sampling=False))
    neighbours: int = 10
    min_points: int = 100
    motion: MotionMode = MotionMode.CONSTANT_VELOCITY
    ema: float = 1.0
    rotation_axis: Axis = field(default_factory=lambda: Axis(low=5.0))
    translation_axis: Axis = field(default_factory=Axis)
    map_type: MapType = MapType.VOXEL
    voxel_map: VoxelMapParams = field(default_factory=VoxelMapParams)
    occupancy: OccupancyParams = field(default_factory=OccupancyParams)
    map_distance: float = 100.0
    map_sample: int = 1000
    map_weighted_ratio: float = 0.0
    map_inlier_ratio: float = 0.0
    keyframe_distance: float = 2.0
    keyframe_degrees: float = 20.0
    keyframe_seconds: float = 1.0
    imu: ImuParams = field(default_factory=ImuParams)
    imu_deskew: bool = False
    imu_seconds: float = 5.0
    alignment: AlignmentParams = field(default_factory=lambda: AlignmentParams(enable=False))
    T_imu_lidar: tuple = tuple(np.eye(4).ravel())
    initial_pose: tuple = tuple(np.eye(4).ravel())
    lio: lio.LioParams = field(default_factory=lio.LioParams)
    gyro_excitation: float = 0.05
    accel_excitation: float = 0.5
    covariance_floor: float = 1e-8


# Preprocessing ------------------------------------------------------------------------------------


def preprocess(points: DataFrame, p: PreprocessParams, k: int = 10) -> DataFrame:
    """The chain on DataFrames: box, polar, voxel and random sampling; then angle, intensity correction,
    smoothing and local normalisation. Neighbours are found after each filter, by point_id."""
    out = filters.box_filter(points, p.box_min, p.box_max)
    for down in ([lambda d: voxel.polar_downsample(d, *p.polar)] if p.polar else []) + ([lambda d: voxel.voxel_downsample(d, p.voxel)] if p.voxel else []):
        out = down(out).withColumnRenamed("key", "point_id").drop("n")
    if p.sample is not None:
        out = sampling.uniform_sample(out, p.sample, p.seed)
    if p.angle:
        out = filters.angle_filter(out, *p.angle)
    if p.intensity is not None:
        out = features.correct_intensity(out, **p.intensity)
    if p.smooth is not None:
        out = features.smooth_intensity(out, k, by=("frame_id",), **p.smooth)
    if p.local_mean is not None:
        out = features.normalize_by_local_mean(out, k, by=("frame_id",), **p.local_mean)
    return out


def _grouped(c: Cloud, key: np.ndarray) -> Cloud:
    keep = key >= 0
    _, at, n = np.unique(key[keep], return_inverse=True, return_counts=True)
    mean = lambda v: np.stack([np.bincount(at, weights=x) for x in np.atleast_2d(v[keep].T)], -1) / n[:, None]
    inten = None
    if c.intensity is not None:
        v = c.intensity[keep]
        order = np.lexsort((v, at))
        first = np.cumsum(n) - n
        inten = (v[order][first + (n - 1) // 2] + v[order][first + n // 2]) / 2
    return Cloud(mean(c.xyz), None, None, None if c.t_offset_ms is None else mean(c.t_offset_ms)[:, 0], inten)


def preprocess_cloud(c: Cloud, p: PreprocessParams) -> Cloud:
    reach = np.abs(c.xyz).max(1) if len(c) else np.zeros(0)
    c = c.take(np.isfinite(c.xyz).all(1) & (reach >= p.box_min) & (reach <= p.box_max))
    if p.polar and len(c):
        flat = np.hypot(c.xyz[:, 0], c.xyz[:, 1])
        bins = np.stack([np.linalg.norm(c.xyz, axis=1), np.arctan2(c.xyz[:, 2], flat), np.arctan2(c.xyz[:, 1], c.xyz[:, 0])], 1) / np.array(p.polar)
        c = _grouped(c, np.where(flat > 0, voxel_keys(bins, 1.0), -1))
    if p.voxel and len(c):
        c = _grouped(c, voxel_keys(c.xyz, p.voxel))
    if p.sample is not None and len(c) > p.sample:
        c = c.take(np.sort(np.random.default_rng(p.seed).permutation(len(c))[: p.sample]))
    return c


def cloud_covariances(c: Cloud, k: int) -> np.ndarray:
    if len(c) < features.LEAST_NEIGHBOURS:
        return np.tile(np.eye(3), (len(c), 1, 1))
    x = c.xyz[reg.nearest(c.xyz, c.xyz, k)[0]]
    d = x - x.mean(1, keepdims=True)
    return np.einsum("nki,nkj->nij", d, d) / x.shape[1]


class MotionPredictor:
    """Constant velocity, smoothed, and damped the more the last alignment was well determined."""

    def __init__(self, p: OdometryParams):
        self.p, self.linear, self.angular = p, None, None

    @staticmethod
    def _factor(block: np.ndarray, inlier: int, a: Axis) -> float:
        score = (np.linalg.eigvalsh((block + block.T) / 2)[0] / inlier - a.low) / max(a.high - a.low, 1e-6)
        score = min(max(score, 0.0), 1.0)
        return a.factor_max * (1 - score) + a.factor_min * score

    def predict(self, linear: np.ndarray, angular: np.ndarray, pose: np.ndarray, dt: float, last: reg.Result | None) -> np.ndarray:
        turn, shift = self.p.rotation_axis.factor_max, self.p.translation_axis.factor_max
        if last is not None and last.inlier:
            turn = self._factor(last.H_raw[:3, :3], last.inlier, self.p.rotation_axis)
            shift = self._factor(last.H_raw[3:, 3:], last.inlier, self.p.translation_axis)
        mix = lambda new, old: new if old is None else self.p.ema * new + (1 - self.p.ema) * old
        self.linear, self.angular = mix(linear, self.linear), mix(angular, self.angular)
        return lie.pose(pose[:3, :3] @ lie.so3_exp(self.angular * dt * turn), pose[:3, 3] + pose[:3, :3] @ (self.linear * dt * shift))


class Submap:
    """Key frames go into a map, and what the map holds around the sensor is the target."""

    def __init__(self, p: OdometryParams):
        self.p = p
        self.map = LocalOccupancy(p.occupancy) if p.map_type is MapType.OCCUPANCY else LocalVoxelMap(p.voxel_map)
        self.target: Cloud | None = None
        self.key_pose, self.key_time, self.rng = np.eye(4), -1.0, np.random.default_rng(p.preprocess.seed)

    def _sampled(self, c: Cloud, weights: np.ndarray | None) -> Cloud:
        n = self.p.map_sample
        if len(c) <= n:
            return c
        want = int(n * self.p.map_weighted_ratio) if weights is not None else 0
        first = np.zeros(0, np.int64)
        if want:
            positive = np.flatnonzero(weights > 0)
            score = np.log(self.rng.random(len(positive))) / weights[positive]
            first = positive[np.argsort(-score)[:want]]
        rest = np.setdiff1d(np.arange(len(c)), first)
        return c.take(np.sort(np.concatenate([first, self.rng.permutation(rest)[: n - len(first)]])))

    def is_keyframe(self, pose: np.ndarray, ts: float) -> bool:
        d = lie.inverse_pose(self.key_pose) @ pose
        waited = ts - self.key_time if self.key_time > 0 else math.inf
        return bool(np.linalg.norm(d[:3, 3]) >= self.p.keyframe_distance or math.degrees(np.linalg.norm(lie.so3_log(d[:3, :3]))) >= self.p.keyframe_degrees or waited >= self.p.keyframe_seconds)

    def add(self, c: Cloud, pose: np.ndarray, ts: float, first: bool, ratio: float = 1.0, weights: np.ndarray | None = None) -> bool:
        """Whether the frame went into the map: the first does, then key frames (every frame, for
        occupancy) that aligned well enough."""
        if not first:
            key = self.is_keyframe(pose, ts)
            if ratio < self.p.map_inlier_ratio or not (key or self.p.map_type is MapType.OCCUPANCY):
                return False
            if key:
                self.key_pose, self.key_time = pose, ts
        else:
            self.key_pose, self.key_time = pose, ts
        self.map.add(self._sampled(c, weights), pose)
        got = self.map.extract(pose[:3, 3], self.p.map_distance)
        if first:
            self.target = c.moved(pose)
        elif len(got) >= self.p.min_points:
            self.target = got
        self._features()
        return True

    def _features(self) -> None:
        t, kind, p = self.target, self.p.registration.reg_type, self.p
        normals = kind in (reg.RegType.POINT_TO_PLANE, reg.RegType.GENZ)
        if t.cov is None and (normals or kind is not reg.RegType.POINT_TO_POINT or p.registration.rotation_constraint):
            t.cov = cloud_covariances(t, p.neighbours)
        if normals:
            t.normal = lie.normal_of(t.cov, t.xyz)


class LidarOdometry:
    def __init__(self, p: OdometryParams | None = None):
        self.p = p = p or OdometryParams()
        self.T_imu_lidar = np.array(p.T_imu_lidar).reshape(4, 4)
        self.pose = self.last_pose = np.array(p.initial_pose).reshape(4, 4)
        self.linear = self.angular = np.zeros(3)
        self.last_time, self.result, self.submap = None, None, Submap(p)
        self.prior = reg.MapPrior(p.registration.prior)
        self.aligner = reg.frame_aligner(p.registration, p.pipeline, self.prior)
        self.predictor, self.gate = MotionPredictor(p), AlignmentGate(p.alignment, np.array(p.imu.gravity), self.T_imu_lidar)
        self.bias, self.buffer, self.corrector = Bias(), np.zeros((0, 7)), VelocityCorrector()
        self.velocity = np.zeros(3)
        self.stages: list[tuple[str, float]] = []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "aligner"} | {"stages": []}

    def __setstate__(self, kept: dict) -> None:
        self.__dict__.update(kept)
        self.aligner = reg.frame_aligner(self.p.registration, self.p.pipeline, self.prior)

    def add_imu(self, ts: float, gyro: np.ndarray, accel: np.ndarray) -> bool:
        """Buffers a sample; late, repeated and non-finite ones are refused."""
        row = np.concatenate([[ts], gyro, accel]).astype(float)
        if not np.isfinite(row).all() or (len(self.buffer) and ts <= self.buffer[-1, 0]):
            return False
        self.buffer = np.vstack([self.buffer, row])
        self.buffer = self.buffer[self.buffer[:, 0] >= ts - self.p.imu_seconds]
        return True

    def _window(self, t0: float, t1: float) -> np.ndarray:
        """Samples in (t0, t1] with interpolated ones at the bounds that samples bracket."""
        rows = self.buffer
        inside = rows[(rows[:, 0] > t0) & (rows[:, 0] <= t1)]
        edges = []
        for t in (t0, t1):
            k = int(np.searchsorted(rows[:, 0], t, side="right"))
            if 0 < k < len(rows) and (t == t0 or rows[k - 1, 0] < t):
                a, b = rows[k - 1], rows[k]
                e = a + (b - a) * (t - a[0]) / (b[0] - a[0])
                e[0] = t
                edges.append(e)
        out = np.vstack([*(e[None] for e in edges), inside]) if edges else inside
        return out[np.argsort(out[:, 0], kind="stable")]

    def _timed(self, name: str, f, *a, **k):
        begun = time.perf_counter()
        out = f(*a, **k)
        self.stages.append((name, (time.perf_counter() - begun) * 1e6))
        return out

    def _prepare(self, scan: Cloud, ts: float) -> Cloud:
        if self.p.imu_deskew and scan.t_offset_ms is not None and len(scan):
            seconds = float(np.nanmax(scan.t_offset_ms)) * 1e-3
            R = self.pose[:3, :3] @ self.T_imu_lidar[:3, :3]
            scan = deskew_by_imu(scan, self.buffer, ts, seconds, self.T_imu_lidar, self.bias, self.p.imu, R, self.velocity)[1]
        c = self._timed("preprocess", preprocess_cloud, scan, self.p.preprocess)
        if len(c) and (self.p.registration.reg_type is reg.RegType.GICP or self.p.registration.rotation_constraint or self.p.preprocess.angle):
            c.cov = self._timed("covariances", cloud_covariances, c, self.p.neighbours)
        if self.p.preprocess.angle and len(c):
            n = lie.normal_of(c.cov, c.xyz)
            cos = np.abs((n * c.xyz).sum(1)) / np.maximum(np.linalg.norm(c.xyz, axis=1), 1e-6)
            low, high = self.p.preprocess.angle
            c = c.take((cos >= math.cos(high)) & (cos <= math.cos(low)))
        return c

    def _guess(self, ts: float, dt: float) -> np.ndarray:
        guess = self.predictor.predict(self.linear, self.angular, self.pose, dt, self.result)
        if self.p.motion is not MotionMode.CONSTANT_VELOCITY:
            rows = self._window(self.last_time, ts)
            if len(rows) > 1:
                sums = Preintegration(self.p.imu)
                sums.reset(self.bias)
                sums.extend(rows)
                R = self.pose[:3, :3] @ self.T_imu_lidar[:3, :3]
                v = self.corrector.reset_velocity(sums.corrected(self.bias), self.velocity)
                rel = self.T_imu_lidar @ sums.predict_relative(R, v, self.bias) @ lie.inverse_pose(self.T_imu_lidar)
                full = self.pose @ rel
                guess = full if self.p.motion is MotionMode.IMU_SE3 else lie.pose(full[:3, :3], guess[:3, 3])
        return guess

    def _start(self, ts: float) -> bool:
        if self.gate.done:
            return True
        found, R = self.gate.attempt(ts, self.buffer, self.bias)
        if found.success:
            turn = lie.so3_exp(np.array([0, 0, lie.yaw(self.pose[:3, :3])]))
            self.pose = self.last_pose = lie.pose(turn @ R, self.pose[:3, 3])
            self.bias = Bias(found.gyro_bias, self.bias.accel)
        return found.success

    def _moved(self, pose: np.ndarray, ts: float, dt: float) -> None:
        before = self.pose
        d = lie.inverse_pose(before) @ pose
        self.linear, self.angular = d[:3, 3] / dt, lie.so3_log(d[:3, :3]) / dt
        self.velocity = (pose[:3, 3] - before[:3, 3]) / dt
        self.corrector.update(pose[:3, 3] - before[:3, 3], before[:3, :3] @ self.T_imu_lidar[:3, :3], np.array(self.p.imu.gravity))
        self.last_pose, self.pose, self.last_time = before, pose, ts

    def process(self, scan: Cloud, ts: float) -> Status:
        if not self._start(ts):
            return Status.WAITING_INITIAL_ALIGNMENT
        if self.last_time is not None and ts <= self.last_time:
            return Status.OLD_TIMESTAMP
        c = self._prepare(scan, ts)
        if len(c) < self.p.min_points:
            return Status.SMALL_NUMBER_OF_POINTS
        if self.last_time is None:
            self.submap.add(c, self.pose, ts, True)
            self.last_time = ts
            return Status.FIRST_FRAME
        dt = ts - self.last_time
        guess = self._guess(ts, dt)
        if self.result is not None:
            self.prior.update(self.result, guess)
        self.result = self._timed("registration", self.aligner, c, self.submap.target, guess, prev_pose=self.pose, dt=dt)
        weights = None
        if self.p.map_weighted_ratio > 0:
            weights = reg.FrameProblem(c, self.submap.target, self.p.registration).weights(self.result.T, self.p.registration.scale)
        self._timed("submap", self.submap.add, c, self.result.T, ts, False, reg.inlier_ratio(self.result, len(c)), weights)
        self._moved(self.result.T, ts, dt)
        return Status.SUCCESS


class LidarInertialOdometry(LidarOdometry):
    """The same with a mandatory IMU and a 15-state estimate. A frame with too few points is bridged by
    the prediction."""

    def __init__(self, p: OdometryParams | None = None):
        super().__init__(p)
        self.state, self.covariance = State(self.pose[:3, 3], self.pose[:3, :3]), np.eye(15) * 1e-4
        self.lio: lio.LioResult | None = None

    def _predict(self, ts: float) -> tuple[State, np.ndarray, np.ndarray] | None:
        rows = self._window(self.last_time, ts)
        if len(rows) < 2:
            return None
        T, s = self.T_imu_lidar, self.state
        body = s.pose() @ T
        sums = Preintegration(self.p.imu)
        bias = Bias(s.bg, s.ba)
        sums.reset(bias, lio.covariance_to_imu(self.covariance, T, s.R), body[:3, :3])
        sums.extend(rows)
        pose = sums.predict(body, s.v, bias) @ lie.inverse_pose(T)
        i = sums.corrected(bias)
        v = s.v + np.array(self.p.imu.gravity) * i.dt + body[:3, :3] @ i.v
        P = lio.covariance_to_lidar(i.covariance, T, pose[:3, :3]) + self.p.covariance_floor * np.eye(15)
        return State(pose[:3, 3], pose[:3, :3], v, s.ba, s.bg), P, rows

    def process(self, scan: Cloud, ts: float) -> Status:
        if not len(self.buffer):
            return Status.NO_IMU
        if not self._start(ts):
            return Status.WAITING_INITIAL_ALIGNMENT
        if self.last_time is not None and ts <= self.last_time:
            return Status.OLD_TIMESTAMP
        c = self._prepare(scan, ts)
        if self.last_time is None:
            if len(c) < self.p.min_points:
                return Status.SMALL_NUMBER_OF_POINTS
            self.state = State(self.pose[:3, 3], self.pose[:3, :3], self.velocity, self.bias.accel, self.bias.gyro)
            self.submap.add(c, self.pose, ts, True)
            self.last_time = ts
            return Status.FIRST_FRAME
        predicted = self._predict(ts)
        if predicted is None:
            return Status.NO_IMU
        state, P, rows = predicted
        dt = ts - self.last_time
        if len(c) < self.p.min_points:
            self.state, self.covariance = state, P
            self._moved(state.pose(), ts, dt)
            return Status.IMU_ONLY
        g, a = (np.linalg.norm(rows[:, k] - rows[:, k].mean(0), axis=1).max() for k in (slice(1, 4), slice(4, 7)))
        free = g > self.p.gyro_excitation or a > self.p.accel_excitation
        problem = reg.FrameProblem(c, self.submap.target, self.p.registration)
        self.lio = self._timed("registration", lio.align, problem, self.p.registration, self.p.lio, state, P, bool(free), self.covariance)
        self.state, self.covariance = self.lio.state, self.lio.covariance
        self.bias = Bias(self.state.bg, self.state.ba)
        ratio = self.lio.icp.inlier / len(c)
        self._timed("submap", self.submap.add, c, self.lio.T, ts, False, ratio)
        self._moved(self.lio.T, ts, dt)
        self.velocity = self.state.v
        return Status.SUCCESS


# Streams of frames --------------------------------------------------------------------------------

POSES = "frame_id bigint, ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double, status string"


def cloud_of(rows: pd.DataFrame) -> Cloud:
    get = lambda c: rows[c].to_numpy(float) if c in rows and rows[c].notna().any() else None
    return Cloud(rows[["x", "y", "z"]].to_numpy(float), None, None, get("t_offset_ms"), get("intensity"))


def pose_row(frame: int, ts: float, pose: np.ndarray, status: Status) -> dict:
    q = lie.rotation_to_quaternion(pose[:3, :3])
    return {"frame_id": frame, "ts": ts, **dict(zip(("tx", "ty", "tz"), pose[:3, 3])), **dict(zip(("qx", "qy", "qz", "qw"), q)), "status": status.name.lower()}


def fold(odometry: LidarOdometry, rows: pd.DataFrame) -> list[dict]:
    """Frames of rows(frame_id, ts, x, y, z, ..) and samples of rows with gx .. az, in order of time."""
    out = []
    imu = rows[rows["gx"].notna()].sort_values("ts") if "gx" in rows else rows.iloc[:0]
    points = rows[rows["x"].notna()]
    samples, k = imu[["ts", *AXES]].to_numpy(float) if len(imu) else np.zeros((0, 7)), 0
    for (ts, frame), part in points.sort_values("point_id").groupby(["ts", "frame_id"]):
        ahead = ts + (float(part["t_offset_ms"].max()) * 1e-3 if "t_offset_ms" in part and part["t_offset_ms"].notna().any() else 0.0) + 0.05
        while k < len(samples) and samples[k, 0] <= ahead:
            odometry.add_imu(samples[k, 0], samples[k, 1:4], samples[k, 4:7])
            k += 1
        status = odometry.process(cloud_of(part), float(ts))
        out.append(pose_row(int(frame), float(ts), odometry.pose, status))
    return out


def run_streams(points: DataFrame, imu: DataFrame | None = None, params: OdometryParams | None = None, inertial: bool = False) -> DataFrame:
    """(stream_id, frame_id, ts, pose, status) of every frame of points(stream_id, frame_id, point_id, ts,
    x, y, z ..) and imu(stream_id, ts, gx .. az): one fold for each stream, streams in parallel."""
    rows = points if imu is None else points.unionByName(imu, allowMissingColumns=True)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        made = fold((LidarInertialOdometry if inertial else LidarOdometry)(params), part)
        return pd.DataFrame([{"stream_id": key[0], **r} for r in made], columns=["stream_id", *(c.split()[0] for c in POSES.split(", "))])

    return rows.groupBy("stream_id").applyInPandas(run, "stream_id bigint, " + POSES)


def stage_times(stages: DataFrame) -> DataFrame:
    """(stage, max, mean, median) of stages(stage, us); the median is the element at n / 2, counted from 0."""
    of = Window.partitionBy("stage")
    ranked = stages.withColumn("_k", F.row_number().over(of.orderBy("us")) - 1).withColumn("_n", F.count("*").over(of))
    median = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), F.col("us")))
    return ranked.groupBy("stage").agg(F.max("us").alias("max_us"), F.avg("us").alias("mean_us"), median.alias("median_us"))
