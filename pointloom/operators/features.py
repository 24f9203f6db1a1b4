"""Features of a point's neighbourhood: a neighbour join, then a grouped aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..functions import lie, near, udfs
from .filters import incidence_cosine, require, with_normals
from . import knn as _knn
from .knn import knn

LEAST_NEIGHBOURS = 4
#: Points whose neighbourhoods a task holds at once.
COV_CHUNK = 1 << 13


def _neighbour_points(points: DataFrame, neighbours: DataFrame, by: tuple[str, ...], *more: str) -> DataFrame:
    p = points.select(*by, F.col("point_id").alias("nbr_id"), *(F.col(c).alias(f"t{c}") for c in (*E.XYZ, *more)))
    return neighbours.join(p, [*by, "nbr_id"])


def covariances(points: DataFrame, k: int = 10, neighbours: DataFrame | None = None, by: tuple[str, ...] = (), least: int = LEAST_NEIGHBOURS) -> DataFrame:
    """points with the population covariance of each one's k nearest (itself included); the identity
    below `least` neighbours, and never from fewer than 4. Points that go to every task as a tree give theirs
    where neighbours are found, and no pairs are joined."""
    if neighbours is None and not by and k > 0 and (held := _knn.hold(points)):
        return _held_covariances(points, held, k, max(least, LEAST_NEIGHBOURS))
    near = neighbours if neighbours is not None else knn(points, points, k, None, by)
    t = {c: F.col(f"t{c}") for c in E.XYZ}
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = [F.sum(t[c]).alias(f"s{c}") for c in E.XYZ] + [F.sum(t[a] * t[b]).alias(f"s{a}{b}") for a, b in pairs]
    got = _neighbour_points(points, near, by).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.count("*").alias("_n"), *sums)
    few = F.coalesce(F.col("_n"), F.lit(0)) < max(least, LEAST_NEIGHBOURS)
    cov = {f"c{a}{b}": F.when(few, E.lit(a == b)).otherwise(F.col(f"s{a}{b}") / F.col("_n") - F.col(f"s{a}") / F.col("_n") * (F.col(f"s{b}") / F.col("_n"))) for a, b in pairs}
    joined = points.drop(*E.COV).join(got, [*by, "point_id"], "left").withColumns(cov)
    return joined.select(*[c for c in points.columns if c not in E.COV], *E.COV)


def _held_covariances(points: DataFrame, held: _knn.Held, k: int, least: int) -> DataFrame:
    sc = points.sparkSession.sparkContext
    rest = points.drop(*E.COV)
    names = [*rest.columns, *E.COV]
    sent = sc.broadcast((near.Tree(held.xyz, np.arange(len(held.xyz)), k), held.xyz))

    def estimate(batches):
        tree, xyz = sent.value
        for t in _knn.chunks(batches, COV_CHUNK):
            q = _knn.columns_xyz(t, "")
            own = np.flatnonzero(np.isfinite(q).all(1) & t["point_id"].is_valid().to_numpy())
            at, dist = tree.knn(q[own], k)
            found = np.isfinite(dist)
            n, x = found.sum(1), np.where(found[..., None], xyz[np.where(found, at, 0)] if len(xyz) else 0.0, 0.0)
            few, count = n < least, np.maximum(n, 1)
            mean = x.sum(1) / count[:, None]
            cov = np.tile(lie.packed(np.eye(3)), (len(q), 1))
            for c, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
                cov[own, c] = np.where(few, float(i == j), (x[..., i] * x[..., j]).sum(1) / count - mean[:, i] * mean[:, j])
            yield from _knn.batches_of(pa.table([*t.columns, *(pa.array(c) for c in cov.T)], names=names))

    schema = T.StructType([*rest.schema.fields, *(T.StructField(c, T.DoubleType()) for c in E.COV)])
    return rest.repartition(max(sc.defaultParallelism, 1)).mapInArrow(estimate, schema)


def _weight(r: np.ndarray, scale: np.ndarray, loss: str) -> np.ndarray:
    q2 = (r / scale[:, None]) ** 2
    w = {"huber": lambda: np.minimum(1, 1 / np.sqrt(np.maximum(q2, 1e-300))), "tukey": lambda: np.where(q2 < 1, (1 - q2) ** 2, 0), "cauchy": lambda: 1 / (1 + q2), "geman_mcclure": lambda: 1 / (1 + q2) ** 2}
    return np.where(r <= 1e-8, 1.0, w[loss]())


def robust_covariance(x: np.ndarray, loss: str, mad_scale: float, least_scale: float, rounds: int) -> np.ndarray:
    """(n, 3, 3) from neighbourhoods x (n, k, 3): weights from the loss of squared Mahalanobis distances,
    whose scale is mad_scale times their median, and not below least_scale."""

    def estimate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = w.sum(1)
        mean = (x * w[..., None]).sum(1) / np.maximum(total, 1e-300)[:, None]
        outer = np.einsum("nk,nki,nkj->nij", w, x, x) / np.maximum(total, 1e-300)[:, None, None]
        cov = outer - mean[:, :, None] * mean[:, None, :]
        return np.where((total < np.finfo(np.float32).eps)[:, None, None], np.eye(3), cov), mean

    cov, mean = estimate(np.ones(x.shape[:2]))
    if loss != "none":
        for _ in range(rounds):
            d = x - mean[:, None]
            r = np.einsum("nki,nij,nkj->nk", d, lie.inverse3(cov), d)
            cov, mean = estimate(_weight(r, np.maximum(mad_scale * np.median(r, axis=1), least_scale), loss))
    return cov


def robust_covariances(points: DataFrame, k: int = 10, loss: str = "cauchy", mad_scale: float = 1.0, least_scale: float = 5.0, rounds: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """covariances() with robust weights. A neighbourhood is one row of k points, so rows go through
    numpy in Arrow batches and no group is collected."""
    loss = loss.lower()
    near = _neighbour_points(points, knn(points, points, k, None, by), by)
    hoods = near.groupBy(*by, F.col("query_id").alias("point_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "tx", "ty", "tz"))).alias("_h"))
    hoods = hoods.select(*by, "point_id", *(F.col(f"_h.t{c}").alias(f"_{c}") for c in E.XYZ))

    @F.pandas_udf("struct<" + ",".join(f"{c}:double" for c in E.COV) + ">")
    def estimate(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        size = x.map(len).to_numpy()
        out = np.tile(np.eye(3), (len(x), 1, 1))
        for n in np.unique(size[size >= LEAST_NEIGHBOURS]):
            at = np.flatnonzero(size == n)
            out[at] = robust_covariance(np.stack([np.stack(c.iloc[at].tolist()) for c in (x, y, z)], -1), loss, mad_scale, least_scale, rounds)
        return pd.DataFrame(lie.packed(out), columns=list(E.COV))

    made = hoods.select(*by, "point_id", estimate("_x", "_y", "_z").alias("_c")).select(*by, "point_id", "_c.*")
    rest = points.drop(*E.COV)
    return rest.join(made, [*by, "point_id"], "left").select(*rest.columns, *(F.coalesce(c, E.lit(c in ("cxx", "cyy", "czz"))).alias(c) for c in E.COV))


def normals(points: DataFrame, k: int = 10, by: tuple[str, ...] = (), limit: float = 1.0) -> DataFrame:
    """points with normals of their neighbourhoods; a normal turns round where n . p > limit."""
    had = all(c in points.columns for c in E.COV)
    made = udfs.add_normals(points if had else covariances(points, k, None, by), limit)
    return made if had else made.drop(*E.COV)


def planar(points: DataFrame, threshold: float = 0.2) -> DataFrame:
    """points with `planar`: whether their covariance's smallest eigenvalue is below a share of all."""
    return udfs.add_curvature(points).withColumn("planar", F.col("curvature") < threshold)


def genz_weight(planar_: Column, alpha: Column) -> Column:
    return F.when(planar_, alpha).otherwise(1 - alpha)


# Intensity ----------------------------------------------------------------------------------------


def correct_intensity(
    points: DataFrame, distance_exponent: float = 2.0, angle_exponent: float = 0.0, reference: float = 1.0, scale: float = 1.0, low: float = 0.0, high: float = 3.4028234663852886e38
) -> DataFrame:
    """Intensity times (range / reference)^e, times |cos|^-a of the angle of incidence where a is not 0
    and normals or covariances are there, times scale, clamped."""
    require(points, "intensity")
    if distance_exponent < 0:
        raise ValueError("the distance exponent must not be negative")
    if reference <= 0:
        raise ValueError("the reference distance must be positive")
    p = [F.col(c) for c in E.XYZ]
    value = F.col("intensity") * F.pow(E.norm(p) / reference, E.lit(distance_exponent))
    made = points
    if angle_exponent and (all(c in points.columns for c in E.NORMAL) or all(c in points.columns for c in E.COV)):
        made = with_normals(points)
        cos = incidence_cosine(p, [F.col(c) for c in E.NORMAL])
        value = value * F.coalesce(F.pow(F.greatest(cos, E.lit(1e-3)), E.lit(-angle_exponent)), E.lit(1))
    return made.withColumn("intensity", E.clamp(value * float(scale), low, high)).select(*points.columns)


def _local(points: DataFrame, k: int, by: tuple[str, ...], neighbours: DataFrame | None, limit: int | None) -> DataFrame:
    near = neighbours if neighbours is not None else knn(points, points, k, None, by)
    if limit:
        near = near.where(F.col("rank") <= limit)
    own = points.select(*by, F.col("point_id").alias("query_id"), *E.XYZ, "intensity")
    return _neighbour_points(points, near, by, "intensity").join(own, [*by, "query_id"])


def gaussian_mean(points: DataFrame, k: int, azimuth: float, elevation: float, distance: float, by: tuple[str, ...] = (), neighbours: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """points with `local_mean`: the mean intensity of the neighbours, weighted by a Gaussian of their
    offsets along the ray, around the vertical axis and upwards. On that axis the x and y axes
    stand in for the last two; at the origin the intensity stands for itself."""
    require(points, "intensity")
    if min(azimuth, elevation, distance) <= 0:
        raise ValueError("widths must be positive")
    x, y, z = (F.col(c) for c in E.XYZ)
    flat = F.sqrt(x * x + y * y)
    r = F.sqrt(x * x + y * y + z * z)
    top, zero, one = flat < 1e-6, E.lit(0), E.lit(1)
    safe_r, safe_flat = F.greatest(r, E.lit(1e-6)), F.greatest(flat, E.lit(1e-6))
    ray = [x / safe_r, y / safe_r, z / safe_r]
    around = [F.when(top, one).otherwise(-y / safe_flat), F.when(top, zero).otherwise(x / safe_flat), zero]
    up = [F.when(top, zero).otherwise(-ray[2] * around[1]), F.when(top, one).otherwise(ray[2] * around[0]), F.when(top, zero).otherwise(flat / safe_r)]
    d = [F.col(f"t{c}") - F.col(c) for c in E.XYZ]
    power = sum((E.dot(d, axis) * E.dot(d, axis) / (2 * s * s) for axis, s in ((ray, distance), (around, azimuth), (up, elevation))), E.lit(0))
    w = F.exp(-power)
    got = _local(points, k, by, neighbours, limit).groupBy(*by, F.col("query_id").alias("point_id")).agg((F.sum(w * F.col("tintensity")) / F.sum(w)).alias("_mean"))
    joined = points.join(got, [*by, "point_id"], "left")
    return joined.withColumn("local_mean", F.when(r < 1e-6, F.col("intensity")).otherwise(F.coalesce("_mean", "intensity"))).select(*points.columns, "local_mean")


def smooth_intensity(points: DataFrame, k: int, azimuth: float, elevation: float, distance: float, **more) -> DataFrame:
    made = gaussian_mean(points, k, azimuth, elevation, distance, **more)
    return made.withColumn("intensity", F.col("local_mean")).select(*points.columns)


def normalize_by_local_mean(points: DataFrame, k: int, azimuth: float, elevation: float, distance: float, floor: float, **more) -> DataFrame:
    if floor <= 0:
        raise ValueError("the floor must be positive")
    made = gaussian_mean(points, k, azimuth, elevation, distance, **more)
    return made.withColumn("intensity", F.col("intensity") / F.greatest("local_mean", E.lit(floor))).select(*points.columns)


def intensity_zscore(points: DataFrame, k: int, floor: float, by: tuple[str, ...] = (), neighbours: DataFrame | None = None) -> DataFrame:
    """points with their intensity's distance from the neighbours' mean in population deviations; 0
    where the deviation is below `floor`."""
    require(points, "intensity")
    if k < 3:
        raise ValueError("k must be at least 3")
    i = F.col("tintensity")
    got = _local(points, k, by, neighbours, None).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.avg(i).alias("_m"), F.avg(i * i).alias("_q"))
    sigma = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), E.lit(0)))
    joined = points.join(got, [*by, "point_id"], "left").withColumn("_s", sigma)
    z = F.when(F.col("_s") < float(floor), E.lit(0)).otherwise((F.col("intensity") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")))
    return joined.withColumn("intensity", F.coalesce(z, E.lit(0))).select(*points.columns)
