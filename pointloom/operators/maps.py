"""Keyed maps: voxel sums and occupancy. A frame is aggregated by key first, then merged into the map
by one full outer join, so what meets the map is one row a voxel."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import udfs
from .filters import has
from .transform import transform_points

SUMS = ("sx", "sy", "sz", "lxx", "lxy", "lxz", "lyy", "lyz", "lzz", "sr", "sg", "sb", "sa", "si")
VOXEL = "key bigint, n bigint, " + ", ".join(f"{c} double" for c in SUMS) + ", last_update bigint"
OCCUPANCY = "key bigint, hit_count bigint, " + ", ".join(f"{c} double" for c in SUMS) + ", log_odds double, last_updated bigint"


def empty_map(spark, occupancy: bool = False) -> DataFrame:
    return spark.createDataFrame([], OCCUPANCY if occupancy else VOXEL)


def _sums(points: DataFrame) -> tuple[DataFrame, list[Column]]:
    """points with log covariances, and the aggregates that a voxel keeps; what points lack adds 0."""
    if has(points, *E.COV):
        points = udfs.apply_matrix(points, "log_spd3")
    source = dict(zip(SUMS, (*E.XYZ, *E.COV, *E.RGBA, "intensity")))
    return points, [(F.sum(c) if c in points.columns else E.lit(0)).alias(s) for s, c in source.items()]


def _by_voxel(points: DataFrame, size: float, pose: np.ndarray | None) -> tuple[DataFrame, list[Column]]:
    moved = points if pose is None else transform_points(points, pose)
    moved, sums = _sums(moved.withColumn("key", E.voxel_key(size)).where("key is not null"))
    return moved, sums


def _merge(state: DataFrame, new: DataFrame, add: tuple[str, ...], rest: dict[str, Column], columns: list[str]) -> DataFrame:
    a, b = state.alias("a"), new.alias("b")
    plus = {c: F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0)) for c in add}
    joined = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer")
    return joined.select(F.coalesce("a.key", "b.key").alias("key"), *(v.alias(k) for k, v in (plus | rest).items())).select(*columns)


@dataclass(frozen=True)
class VoxelMapParams:
    size: float = 1.0
    stale_after: int = 100
    evict_every: int = 10


def voxel_insert(state: DataFrame, points: DataFrame, counter: int, p: VoxelMapParams, pose: np.ndarray | None = None) -> DataFrame:
    """The map with a frame's points added and stale voxels evicted when it is time. Covariances are
    summed as logarithms."""
    moved, sums = _by_voxel(points, p.size, pose)
    frame = moved.groupBy("key").agg(F.count("*").alias("n"), *sums)
    seen = F.when(F.col("b.key").isNotNull(), F.lit(counter)).otherwise(F.col("a.last_update")).cast("bigint")
    out = _merge(state, frame, ("n", *SUMS), {"last_update": seen}, state.columns)
    return evict(out, counter, p.stale_after) if counter % p.evict_every == 0 and counter > p.stale_after else out


def evict(state: DataFrame, counter: int, stale_after: int) -> DataFrame:
    return state.where(F.col("last_update") >= counter - stale_after)


def voxel_fold(points: DataFrame, size: float, order: str = "frame_id") -> DataFrame:
    """voxel_insert() of all frames at once, if none goes stale: sums do not depend on order, so a
    batch of frames is one aggregate."""
    moved, sums = _by_voxel(points, size, None)
    return moved.groupBy("key").agg(F.count("*").alias("n"), *sums, F.max(order).cast("bigint").alias("last_update"))


def means(state: DataFrame, count: str) -> dict[str, Column]:
    """Every attribute's mean over all of a voxel's points, whether or not they had it."""
    names = (*E.XYZ, *E.COV, *E.RGBA, "intensity")
    return {c: F.col(s) / F.col(count) for c, s in zip(names, SUMS)}


def _extract(rows: DataFrame, count: str, with_cov: bool) -> DataFrame:
    m = means(rows, count)
    keep = [c for c in m if with_cov or c not in E.COV]
    out = rows.select("key", F.col(count).alias("n"), *(m[c].alias(c) for c in keep))
    return udfs.apply_matrix(out, "exp_spd3") if with_cov else out


def voxel_extract(state: DataFrame, centre: tuple[float, float, float], distance: float, least: int = 1, with_cov: bool = False) -> DataFrame:
    """Centroids of voxels with at least `least` points inside the box of half edge `distance`."""
    m = means(state, "n")
    near = F.lit(True)
    for c, o in zip(E.XYZ, centre):
        near = near & (m[c] >= float(o) - distance) & (m[c] <= float(o) + distance)
    return _extract(state.where((F.col("n") >= least) & near), "n", with_cov)


def overlap(points: DataFrame, state: DataFrame, size: float, known: Column, pose: np.ndarray | None = None) -> DataFrame:
    """One row overlap: the share of all points whose voxel the map has and `known` holds for."""
    moved = points if pose is None else transform_points(points, pose)
    keyed = moved.select(E.voxel_key(size).alias("key"))
    hit = keyed.join(state.where(known).select("key", F.lit(1).alias("_hit")), "key", "left")
    return hit.agg((F.count("_hit") / F.when(F.count("*") > 0, F.count("*"))).alias("overlap")).select(F.coalesce("overlap", E.lit(0)).alias("overlap"))


def voxel_overlap(points: DataFrame, state: DataFrame, size: float, least: int = 1, pose: np.ndarray | None = None) -> DataFrame:
    return overlap(points, state, size, F.col("n") >= least, pose)


# Occupancy ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class OccupancyParams:
    size: float = 1.0
    hit: float = 0.85
    miss: float = -0.4
    low: float = -4.0
    high: float = 4.0
    probability: float = 0.5
    stale_after: int = 100
    carve: bool = True

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError("the voxel size must be positive")
        if self.low > self.high:
            raise ValueError("the limits of log odds are the wrong way round")
        if not 0 < self.probability < 1:
            raise ValueError("the occupancy threshold must lie in (0, 1)")

    @property
    def threshold(self) -> float:
        return math.log(self.probability / (1 - self.probability))

    @property
    def occupied(self) -> Column:
        return (F.col("hit_count") > 0) & (F.col("log_odds") >= self.threshold)


def hits(points: DataFrame, p: OccupancyParams) -> DataFrame:
    """(key, hit_count, sums) of points in the map's frame."""
    moved, sums = _by_voxel(points, p.size, None)
    return moved.groupBy("key").agg(F.count("*").alias("hit_count"), *sums)


def misses(points: DataFrame, sensor: tuple[float, float, float], p: OccupancyParams) -> DataFrame:
    """(key, misses): how many rays of a frame pass through each voxel before the one that they end in.
    The sensor's own voxel is missed by rays that leave it, unless a point lies in it."""
    s = [E.lit(v) for v in sensor]
    d = [F.col(c) - o for c, o in zip(E.XYZ, s)]
    rays = points.where(E.finite()).where(E.dot(d, d) > float(np.finfo(np.float32).eps))
    along = rays.select(F.explode(udfs.ray_keys_udf(p.size)(*s, *E.XYZ)).alias("key"))
    start = np.floor(np.asarray(sensor, float) / p.size).astype(np.int64)
    own = udfs.cell_keys(start[None])
    if len(own):
        home = points.where(E.voxel_key(p.size) == int(own[0])).limit(1).select(F.lit(1).alias("_h"))
        leave = rays.where(F.coalesce(E.voxel_key(p.size) != int(own[0]), F.lit(True))).select(F.lit(int(own[0])).alias("key"))
        along = along.unionByName(leave.join(F.broadcast(home), how="left").where("_h is null").select("key"))
    return along.groupBy("key").agg(F.count("*").alias("misses"))


def occupancy_insert(state: DataFrame, points: DataFrame, frame: int, p: OccupancyParams, pose: np.ndarray | None = None) -> DataFrame:
    """The map after one frame: hits, misses along the rays, log odds clamped once, stale voxels gone."""
    moved = points if pose is None else transform_points(points, pose)
    pose = np.eye(4) if pose is None else pose
    new = hits(moved, p)
    if p.carve:
        gone = misses(moved, tuple(pose[:3, 3]), p)
        new = new.join(gone, "key", "full_outer").select("key", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), *(F.coalesce(c, E.lit(0)).alias(c) for c in SUMS), F.coalesce("misses", F.lit(0)).alias("misses"))
    else:
        new = new.withColumn("misses", F.lit(0))
    new = new.withColumn("change", F.col("hit_count") * E.lit(p.hit) + F.col("misses") * E.lit(p.miss))
    old = F.coalesce("a.log_odds", E.lit(0))
    change = F.coalesce("b.change", E.lit(0))
    rest = {
        "log_odds": F.when(change == 0, old).otherwise(E.clamp(old + change, p.low, p.high)),
        "last_updated": F.when(F.col("b.key").isNotNull(), F.lit(frame)).otherwise(F.col("a.last_updated")).cast("bigint"),
    }
    out = _merge(state, new, ("hit_count", *SUMS), rest, state.columns)
    return prune(out, frame, p.stale_after)


def prune(state: DataFrame, frame: int, stale_after: int) -> DataFrame:
    return state if frame < stale_after else state.where(F.lit(frame) - F.col("last_updated") <= stale_after)


def occupied_points(state: DataFrame, sensor: tuple[float, float, float], distance: float, p: OccupancyParams, with_cov: bool = False) -> DataFrame:
    m = means(state, "hit_count")
    reach = F.greatest(*(F.abs(m[c] - float(o)) for c, o in zip(E.XYZ, sensor)))
    return _extract(state.where(p.occupied).where(reach <= float(distance)), "hit_count", with_cov)


def query_probability(state: DataFrame, positions: DataFrame, p: OccupancyParams) -> DataFrame:
    """positions with `probability`, one half where the map knows nothing."""
    keyed = positions.withColumn("key", E.voxel_key(p.size))
    return keyed.join(state.select("key", "log_odds"), "key", "left").select(*positions.columns, F.coalesce(E.probability(F.col("log_odds")), E.lit(0.5)).alias("probability"))


def visible_points(state: DataFrame, pose: np.ndarray, distance: float, horizontal: float, vertical: float, p: OccupancyParams, with_cov: bool = False) -> DataFrame:
    """Occupied voxels within range and both fields of view that no nearer occupied voxel on the ray
    hides. From a horizontal view of 180 degrees on, what lies behind counts as mirrored."""
    tiny = 1e-6
    horizontal, vertical = min(max(horizontal, tiny), math.pi - tiny), min(max(vertical, tiny), 2 * math.pi - tiny)
    both_ways = horizontal >= math.pi - tiny
    R, s = pose[:3, :3], pose[:3, 3]
    m = means(state, "hit_count")
    d = [m[c] - float(o) for c, o in zip(E.XYZ, s)]
    x, y, z = (E.dot([E.lit(v) for v in R[:, k]], d) for k in range(3))
    ahead = F.abs(x) if both_ways else x
    cosine = lambda other: F.coalesce(ahead / F.when(ahead * ahead + other * other > 0, F.sqrt(ahead * ahead + other * other)), E.lit(1))
    seen = (E.dot(d, d) <= float(distance) ** 2) & (cosine(y) >= math.cos(horizontal / 2)) & (cosine(z) >= math.cos(vertical / 2))
    if not both_ways:
        seen = seen & (x > 0)
    solid = state.where(p.occupied).withColumn("_d2", E.dot(d, d))
    candidates = solid.where(seen)
    far = candidates.where(F.sqrt("_d2") > p.size)
    rays = far.select(F.col("key").alias("_own"), F.col("_d2").alias("_far"), F.explode(udfs.ray_keys_udf(p.size)(*(E.lit(v) for v in s), *(m[c] for c in E.XYZ))).alias("key"))
    hidden = rays.join(solid.select("key", F.col("_d2").alias("_near")), "key").where((F.col("key") != F.col("_own")) & (F.col("_near") + 1e-6 < F.col("_far"))).select(F.col("_own").alias("key")).distinct()
    return _extract(candidates.drop("_d2").join(hidden, "key", "left_anti"), "hit_count", with_cov)


def occupancy_overlap(points: DataFrame, state: DataFrame, p: OccupancyParams, pose: np.ndarray | None = None) -> DataFrame:
    return overlap(points, state, p.size, p.occupied, pose)
