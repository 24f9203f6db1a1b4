"""Inertial measurements: buffering, windows, preintegration, alignment, factors. Folds over ordered
samples run in numpy, one stream a group; what is relational stays in DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie

AXES = ("gx", "gy", "gz", "ax", "ay", "az")
POS, ROT, VEL, ACC, GYR = (slice(3 * k, 3 * k + 3) for k in range(5))
GRAVITY = (0.0, 0.0, -9.80665)


def ingest(samples: DataFrame, by: tuple[str, ...] = ("stream_id",), keep_seconds: float | None = None, order: str = "arrival") -> DataFrame:
    """Samples in order of arrival without non-finite ones and those not later than any before; with
    keep_seconds only the last so many seconds of each stream."""
    good = samples.where(E.finite("ts", *AXES))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept = good.withColumn("_m", F.max("ts").over(before)).where(F.col("_m").isNull() | (F.col("ts") > F.col("_m"))).drop("_m")
    if keep_seconds is None:
        return kept
    last = F.max("ts").over(Window.partitionBy(*by))
    return kept.withColumn("_l", last).where(F.col("ts") >= F.col("_l") - float(keep_seconds)).drop("_l")


def windows(samples: DataFrame, bounds: DataFrame, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """For each row of bounds(by.., window_id, t0, t1): the samples in (t0, t1], and samples linearly
    interpolated at t0 and t1 where two samples bracket them. Columns by.., window_id, ts, axes, kind."""
    ordered = Window.partitionBy(*by).orderBy("ts")
    s = samples.select(*by, "ts", *AXES, F.lead("ts").over(ordered).alias("_ts"), *(F.lead(c).over(ordered).alias(f"_{c}") for c in AXES))
    # a sample serves every window that its interval up to the next sample touches: both sides go into
    # buckets of time as wide as the longest window, and a pair meets in the first bucket they share
    wide = bounds.agg(F.max(F.col("t1") - F.col("t0"))).first()[0]
    wide = E.lit(wide if wide and wide > 0 else 1.0)
    bucket = lambda c: F.floor(c / wide)
    upto = F.coalesce("_ts", "ts")
    s = s.withColumn("_b0", bucket(F.col("ts"))).withColumn("_b", F.explode(F.sequence("_b0", F.greatest("_b0", bucket(upto)))))
    b = bounds.select(*by, "window_id", "t0", "t1").withColumn("_c0", bucket(F.col("t0"))).withColumn("_b", F.explode(F.sequence("_c0", F.greatest("_c0", bucket(F.col("t1"))))))
    touch = (F.col("ts") <= F.col("t1")) & (upto >= F.col("t0")) & (F.col("_b") == F.greatest("_b0", "_c0"))
    joined = s.join(b, [*by, "_b"]).where(touch)
    def row(kind: str, at: F.Column, values: list[F.Column]) -> F.Column:
        return F.struct(at.alias("ts"), *(v.alias(c) for c, v in zip(AXES, values)), F.lit(kind).alias("kind"))

    def edge(c: str, kind: str) -> F.Column:
        # at the end of the window only where no sample lies on it
        between = ((F.col("ts") <= F.col(c)) if c == "t0" else (F.col("ts") < F.col(c))) & (F.col(c) < F.col("_ts"))
        a = (F.col(c) - F.col("ts")) / (F.col("_ts") - F.col("ts"))
        return F.when(between, row(kind, F.col(c), [F.col(x) + a * (F.col(f"_{x}") - F.col(x)) for x in AXES]))

    inside = F.when((F.col("ts") > F.col("t0")) & (F.col("ts") <= F.col("t1")), row("sample", F.col("ts"), [F.col(x) for x in AXES]))
    made = F.array_compact(F.array(inside, edge("t0", "start"), edge("t1", "end")))
    return joined.select(*by, "window_id", F.explode(made).alias("_r")).select(*by, "window_id", "_r.*")


@dataclass(frozen=True)
class ImuParams:
    gravity: tuple[float, float, float] = GRAVITY
    accel_scale: float = 1.0
    gyro_noise: float = 0.0
    accel_noise: float = 0.0
    gyro_walk: float = 0.0
    accel_walk: float = 0.0


@dataclass
class Bias:
    gyro: np.ndarray = field(default_factory=lambda: np.zeros(3))
    accel: np.ndarray = field(default_factory=lambda: np.zeros(3))


@dataclass
class Integral:
    """What a window of samples adds up to, with derivatives by the biases."""

    R: np.ndarray = field(default_factory=lambda: np.eye(3))
    v: np.ndarray = field(default_factory=lambda: np.zeros(3))
    p: np.ndarray = field(default_factory=lambda: np.zeros(3))
    dt: float = 0.0
    R_bg: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    v_bg: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    v_ba: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    p_bg: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    p_ba: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    covariance: np.ndarray = field(default_factory=lambda: np.zeros((15, 15)))


class Preintegration:
    """Midpoint integration on SO(3) between two key frames. Samples that are not later than the last
    are dropped. The state covariance is ordered position, rotation, velocity, accelerometer bias,
    gyroscope bias; position and velocity are world quantities, so the starting attitude enters."""

    def __init__(self, params: ImuParams | None = None):
        self.params = params or ImuParams()
        self.reset()

    def reset(self, bias: Bias | None = None, covariance: np.ndarray | None = None, R_world: np.ndarray | None = None) -> None:
        self.bias, self.state, self.last, self.count, self.steps = bias or Bias(), Integral(), None, 0, 0
        self.R_world = np.eye(3) if R_world is None else R_world
        if covariance is not None:
            self.state.covariance = covariance.copy()

    def add(self, ts: float, gyro: np.ndarray, accel: np.ndarray) -> None:
        now = (float(ts), np.asarray(gyro, float), np.asarray(accel, float))
        if self.last is not None and now[0] <= self.last[0]:
            return
        if self.last is not None:
            self._step(self.last, now)
        self.last, self.count = now, self.count + 1

    def extend(self, rows: np.ndarray) -> "Preintegration":
        """rows of ts, gyro, accel."""
        for r in rows:
            self.add(r[0], r[1:4], r[4:7])
        return self

    def _step(self, a, b) -> None:
        dt = b[0] - a[0]
        if dt < 1e-9:
            return
        s, p = self.state, self.params
        w = (a[1] + b[1]) / 2 - self.bias.gyro
        f = (a[2] + b[2]) / 2 * p.accel_scale - self.bias.accel
        whole, half = lie.so3_exp(w * dt), lie.so3_exp(w * dt / 2)
        J, Jh = lie.right_jacobian(w * dt), lie.right_jacobian(w * dt / 2)
        mid = s.R @ half
        pull = mid @ lie.skew(f)  # how the specific force turns with the midpoint attitude
        turned = half.T @ s.R_bg - Jh * dt / 2
        if s.covariance.any() or max(p.gyro_noise, p.accel_noise, p.gyro_walk, p.accel_walk) > 0:
            self._spread(dt, whole, half, J, Jh, mid, f)
        s.p_bg = s.p_bg + s.v_bg * dt - 0.5 * pull @ turned * dt * dt
        s.p_ba = s.p_ba + s.v_ba * dt - 0.5 * mid * dt * dt
        s.v_bg = s.v_bg - pull @ turned * dt
        s.v_ba = s.v_ba - mid * dt
        s.R_bg = whole.T @ s.R_bg - J * dt
        force = mid @ f
        s.p = s.p + s.v * dt + 0.5 * force * dt * dt
        s.v = s.v + force * dt
        s.R = s.R @ whole
        s.dt += dt
        self.steps += 1
        if self.steps % 100 == 0:
            s.R = lie.quaternion_to_rotation(lie.rotation_to_quaternion(s.R))

    def _spread(self, dt, whole, half, J, Jh, mid, f) -> None:
        p, world = self.params, self.R_world @ mid
        pull = world @ lie.skew(f)
        A = np.eye(15)
        # by the attitude, the accelerometer bias and the gyroscope bias; position gets half a step more
        by = {ROT: -pull @ half.T, ACC: -world, GYR: pull @ Jh * dt / 2}
        for k, m in by.items():
            A[VEL, k], A[POS, k] = m * dt, m * dt * dt / 2
        A[POS, VEL], A[ROT, ROT], A[ROT, GYR] = np.eye(3) * dt, whole.T, -J * dt
        G = np.zeros((15, 12))
        G[:, 0:3], G[:, 3:6] = A[:, ACC], A[:, GYR]  # white noise acts as a bias does within a step
        G[ACC, 0:3], G[GYR, 3:6] = 0, 0
        G[ACC, 6:9], G[GYR, 9:12] = np.eye(3), np.eye(3)
        q = np.repeat([p.accel_noise**2 / dt, p.gyro_noise**2 / dt, p.accel_walk**2 * dt, p.gyro_walk**2 * dt], 3)
        P = A @ self.state.covariance @ A.T + (G * q) @ G.T
        self.state.covariance = (P + P.T) / 2

    def corrected(self, bias: Bias) -> Integral:
        """The integral at a slightly different bias, to first order."""
        s, g, a = self.state, bias.gyro - self.bias.gyro, bias.accel - self.bias.accel
        R = lie.quaternion_to_rotation(lie.rotation_to_quaternion(s.R @ lie.so3_exp(s.R_bg @ g)))
        return Integral(R, s.v + s.v_bg @ g + s.v_ba @ a, s.p + s.p_bg @ g + s.p_ba @ a, s.dt, s.R_bg, s.v_bg, s.v_ba, s.p_bg, s.p_ba, s.covariance)

    def predict(self, pose: np.ndarray, velocity: np.ndarray, bias: Bias) -> np.ndarray:
        """World pose at the end of the window."""
        c, R = self.corrected(bias), pose[:3, :3]
        return lie.pose(R @ c.R, pose[:3, 3] + velocity * c.dt + 0.5 * np.array(self.params.gravity) * c.dt**2 + R @ c.p)

    def predict_relative(self, R: np.ndarray, velocity: np.ndarray, bias: Bias) -> np.ndarray:
        """Motion over the window in the frame of its start, free of gravity."""
        c = self.corrected(bias)
        return lie.pose(c.R, c.p + R.T @ (0.5 * np.array(self.params.gravity) * c.dt**2 + velocity * c.dt))


INTEGRAL = "dt double, q array<double>, v array<double>, p array<double>, covariance array<double>"


def preintegrate(samples: DataFrame, by: tuple[str, ...] = ("stream_id", "window_id"), params: ImuParams | None = None, bias: Bias | None = None) -> DataFrame:
    """(by.., dt, q, v, p, covariance) of each window's samples in order: an ordered fold a window, many windows at a time."""
    kinds, p, bias = dict(samples.dtypes), params or ImuParams(), bias or Bias()
    schema = pa.schema([(n, t) for n, t in zip(INTEGRAL_NAMES, (pa.float64(), *[pa.list_(pa.float64())] * 4))])

    def fold(batches):
        rest = None
        for t in _tables(batches):
            t = t if rest is None else pa.concat_tables([rest, t])
            first = _firsts(t, by)
            if t.num_rows - first[-1] < t.num_rows:  # the last window may go on in the next batch
                yield from lines(t.slice(0, first[-1]), first[:-1])
            rest = t.slice(first[-1])
        if rest is not None:
            yield from lines(rest, np.zeros(1, np.int64))

    def lines(t, first):
        rows = np.stack([t[c].to_numpy() for c in ("ts", *AXES)], 1).astype(float)
        for a in range(0, len(first), FOLDED):
            some = first[a : a + FOLDED]
            end = first[a + FOLDED] if a + FOLDED < len(first) else len(rows)
            made = _together(rows[some[0] : end], some - some[0], p, bias)
            flat = [pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]).cast(pa.list_(pa.float64())) for v in made[1:]]
            yield pa.RecordBatch.from_arrays([*t.select(list(by)).take(pa.array(some)).combine_chunks().to_batches()[0].columns, pa.array(made[0]), *flat], names=[*by, *schema.names])

    ordered = samples.select(*by, "ts", *AXES).repartition(*by).sortWithinPartitions(*by, "ts", *AXES)
    return ordered.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + INTEGRAL)


#: Windows that are integrated side by side, and rows that are read at once.
FOLDED, READ = 1 << 12, 1 << 15
INTEGRAL_NAMES = ("dt", "q", "v", "p", "covariance")


def _tables(batches):
    some, n = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            n += b.num_rows
        if n >= READ:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _firsts(t, by: tuple[str, ...]) -> np.ndarray:
    """First row of each run of equal values of `by`, nulls being equal."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in by:
        code = pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _together(rows: np.ndarray, first: np.ndarray, p: ImuParams, bias: Bias) -> tuple[np.ndarray, ...]:
    """dt, quaternion, velocity, position and covariance of many windows of ordered rows: step k of
    Preintegration._step for all windows that have one at a time."""
    n = len(first)
    R, v, x, dt, P = np.tile(np.eye(3), (n, 1, 1)), np.zeros((n, 3)), np.zeros((n, 3)), np.zeros(n), np.zeros((n, 15, 15))
    window = np.repeat(np.arange(n), np.diff(np.append(first, len(rows))))
    # as add() does: what is not later than the last kept sample is dropped; rows are in order of time
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, 0] > rows[:-1, 0]) | (window[1:] != window[:-1])
    rows, window = rows[keep], window[keep]
    first = np.searchsorted(window, np.arange(n))
    size = np.diff(np.append(first, len(rows)))
    noisy = max(p.gyro_noise, p.accel_noise, p.gyro_walk, p.accel_walk) > 0
    steps = np.zeros(n, np.int64)
    for k in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        a, b = rows[first[at] + k - 1], rows[first[at] + k]
        long = b[:, 0] - a[:, 0] >= 1e-9
        at, a, b = at[long], a[long], b[long]
        if not len(at):
            continue
        d = b[:, 0] - a[:, 0]
        w = (a[:, 1:4] + b[:, 1:4]) / 2 - bias.gyro
        f = (a[:, 4:7] + b[:, 4:7]) / 2 * p.accel_scale - bias.accel
        whole, half = lie.so3_exp(w * d[:, None]), lie.so3_exp(w * d[:, None] / 2)
        mid = R[at] @ half
        if noisy:
            P[at] = _spread_many(P[at], p, d, whole, half, lie.right_jacobian(w * d[:, None]), lie.right_jacobian(w * d[:, None] / 2), mid, f)
        force = (mid @ f[:, :, None])[:, :, 0]
        x[at] += v[at] * d[:, None] + 0.5 * force * (d * d)[:, None]
        v[at] += force * d[:, None]
        R[at] = R[at] @ whole
        dt[at] += d
        steps[at] += 1
        tidy = at[steps[at] % 100 == 0]
        if len(tidy):
            R[tidy] = lie.quaternion_to_rotation(lie.rotation_to_quaternion(R[tidy]))
    return dt, lie.rotation_to_quaternion(R), v, x, P.reshape(n, 225)


def _spread_many(P, p: ImuParams, d, whole, half, J, Jh, mid, f) -> np.ndarray:
    """Preintegration._spread() from the identity attitude, for many windows."""
    t, turn = d[:, None, None], np.swapaxes
    pull, n = mid @ lie.skew(f), len(d)
    A = np.tile(np.eye(15), (n, 1, 1))
    for k, m in {ROT: -pull @ turn(half, 1, 2), ACC: -mid, GYR: pull @ Jh * t / 2}.items():
        A[:, VEL, k], A[:, POS, k] = m * t, m * t * t / 2
    A[:, POS, VEL], A[:, ROT, ROT], A[:, ROT, GYR] = np.eye(3) * t, turn(whole, 1, 2), -J * t
    G = np.zeros((n, 15, 12))
    G[:, :, 0:3], G[:, :, 3:6] = A[:, :, ACC], A[:, :, GYR]
    G[:, ACC, 0:3], G[:, GYR, 3:6] = 0, 0
    G[:, ACC, 6:9], G[:, GYR, 9:12] = np.eye(3), np.eye(3)
    q = np.stack([p.accel_noise**2 / d, p.gyro_noise**2 / d, p.accel_walk**2 * d, p.gyro_walk**2 * d], 1).repeat(3, axis=1)
    P = A @ P @ turn(A, 1, 2) + (G * q[:, None, :]) @ turn(G, 1, 2)
    return (P + turn(P, 1, 2)) / 2


# Alignment and velocity ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AlignmentParams:
    enable: bool = True
    required_seconds: float = 1.0
    max_gyro_std: float = 0.01
    max_accel_std: float = 0.2
    max_norm_error: float = 0.5
    estimate_gyro_bias: bool = True
    max_wait_seconds: float = 5.0


def stationary_stats(samples: DataFrame, seconds: float, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """(by.., n, span, mean and population deviation of each axis) over each stream's last `seconds`."""
    last = Window.partitionBy(*by)
    s = samples.withColumn("_l", F.max("ts").over(last)).withColumn("_f", F.min("ts").over(last))
    use = s.where(F.col("ts") >= F.col("_l") - float(seconds))
    return use.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.col("_l") - F.col("_f")).alias("span"), *(F.avg(c).alias(f"{c}_mean") for c in AXES), *(F.stddev_pop(c).alias(f"{c}_std") for c in AXES))


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest rotation that turns the direction of a into that of b."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    axis, cos = np.cross(a, b), float(np.clip(a @ b, -1, 1))
    sin = float(np.linalg.norm(axis))
    if sin < 1e-12:
        if cos > 0:
            return np.eye(3)
        side = np.cross(a, np.eye(3)[np.abs(a).argmin()])
        return lie.so3_exp(side / np.linalg.norm(side) * math.pi)
    return lie.so3_exp(axis / sin * math.atan2(sin, cos))


@dataclass
class Alignment:
    success: bool = False
    message: str = ""
    R_world_imu: np.ndarray = field(default_factory=lambda: np.eye(3))
    gyro_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    roll: float = 0.0
    pitch: float = 0.0
    accel_norm: float = 0.0


def initial_alignment(rows: np.ndarray, gravity: np.ndarray, p: AlignmentParams, bias: Bias, force: bool = False) -> Alignment:
    """Roll and pitch from samples (ts, gyro, accel) at rest: the mean specific force points up."""
    out, g = Alignment(), float(np.linalg.norm(gravity))
    if g < 1e-3:
        return Alignment(message="gravity is near zero")
    if len(rows) < 2 or rows[-1, 0] - rows[0, 0] + 1e-6 < p.required_seconds:
        return Alignment(message="the samples span too short a time")
    begin = rows[-1, 0] - p.required_seconds
    first = int(np.searchsorted(rows[:, 0], begin))
    if first and rows[first, 0] > begin + 1e-6:
        first -= 1
    mean, std = rows[first:, 1:7].mean(0), rows[first:, 1:7].std(0)
    out.accel_norm = float(np.linalg.norm(mean[3:]))
    if not force:
        for bad, why in (((std[:3] > p.max_gyro_std).any(), "turning"), ((std[3:] > p.max_accel_std).any(), "shaking"), (abs(out.accel_norm - g) > p.max_norm_error, "the mean force is not gravity")):
            if bad:
                return Alignment(message=f"not at rest: {why}", accel_norm=out.accel_norm)
    up = mean[3:] - bias.accel
    if np.linalg.norm(up) < 1e-3:
        return Alignment(message="the corrected force is near zero", accel_norm=out.accel_norm)
    R = rotation_between(up, -np.asarray(gravity, float))
    out.success, out.R_world_imu = True, R
    out.roll, out.pitch = math.atan2(R[2, 1], R[2, 2]), math.asin(-min(max(R[2, 0], -1.0), 1.0))
    out.gyro_bias = mean[:3] if p.estimate_gyro_bias else bias.gyro
    return out


class AlignmentGate:
    """Tries at each scan until it succeeds, by force once max_wait_seconds have passed."""

    def __init__(self, p: AlignmentParams, gravity: np.ndarray, T_imu_lidar: np.ndarray):
        self.p, self.gravity, self.T, self.begun, self.done = p, np.asarray(gravity, float), T_imu_lidar, None, not p.enable

    def attempt(self, ts: float, rows: np.ndarray, bias: Bias) -> tuple[Alignment, np.ndarray]:
        """(alignment, the lidar's levelled rotation, of yaw near 0)."""
        self.begun = ts if self.begun is None else self.begun
        out = initial_alignment(rows, self.gravity, self.p, bias)
        if not out.success and 0 < self.p.max_wait_seconds <= ts - self.begun:
            out = initial_alignment(rows, self.gravity, self.p, bias, force=True)
        self.done = out.success
        return out, out.R_world_imu @ self.T[:3, :3].T


class VelocityCorrector:
    """Velocity at a window's end from the displacement that alignment found over it."""

    def __init__(self):
        self.velocity, self.window = None, None

    def reset_velocity(self, integral: Integral, fallback: np.ndarray) -> np.ndarray:
        v, self.velocity = fallback if self.velocity is None else self.velocity, None
        self.window = integral
        return v

    def update(self, moved: np.ndarray, R: np.ndarray, gravity: np.ndarray) -> None:
        w, self.window = self.window, None
        if w is not None and w.dt > 0:
            start = (moved - 0.5 * gravity * w.dt**2 - R @ w.p) / w.dt
            self.velocity = start + gravity * w.dt + R @ w.v


# Factor -------------------------------------------------------------------------------------------


@dataclass
class State:
    p: np.ndarray = field(default_factory=lambda: np.zeros(3))
    R: np.ndarray = field(default_factory=lambda: np.eye(3))
    v: np.ndarray = field(default_factory=lambda: np.zeros(3))
    ba: np.ndarray = field(default_factory=lambda: np.zeros(3))
    bg: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def minus(self, other: "State") -> np.ndarray:
        """15-D difference; rotations by their logarithm."""
        return np.concatenate([self.p - other.p, lie.so3_log(other.R.T @ self.R), self.v - other.v, self.ba - other.ba, self.bg - other.bg])

    def plus(self, d: np.ndarray) -> "State":
        R = lie.quaternion_to_rotation(lie.rotation_to_quaternion(self.R @ lie.so3_exp(d[ROT])))
        return State(self.p + d[POS], R, self.v + d[VEL], self.ba + d[ACC], self.bg + d[GYR])

    def pose(self) -> np.ndarray:
        return lie.pose(self.R, self.p)


def imu_factor(predicted: State, at: State, covariance: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """(valid, information, gradient) of the prediction; zeros where the covariance is not positive."""
    sym = (covariance + covariance.T) / 2
    if not np.isfinite(sym).all() or np.linalg.eigvalsh(sym)[0] <= 0:
        return False, np.zeros((15, 15)), np.zeros(15)
    H = np.linalg.inv(sym)
    return True, (H + H.T) / 2, H @ at.minus(predicted)


def bias_observable(samples: DataFrame, gyro: float, accel: float, by: tuple[str, ...] = ("stream_id", "window_id")) -> DataFrame:
    """(by.., gyro_dev, accel_dev, observable): the largest deviation from the window's mean."""
    w = Window.partitionBy(*by)
    off = lambda axes: E.norm([F.col(c) - F.avg(c).over(w) for c in axes])
    d = samples.withColumn("_g", off(AXES[:3])).withColumn("_a", off(AXES[3:])).groupBy(*by).agg(F.max("_g").alias("gyro_dev"), F.max("_a").alias("accel_dev"))
    return d.withColumn("observable", (F.col("gyro_dev") > float(gyro)) | (F.col("accel_dev") > float(accel)))
