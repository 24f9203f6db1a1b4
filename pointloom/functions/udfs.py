"""What needs eigenvectors or a traversal: Arrow-batched functions, and a table function for rays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lie
from .expr import COV, KEY_BITS, KEY_OFFSET, NORMAL, XYZ

_NAMES6 = ", ".join(f"{c} double" for c in COV)


def _matrix_udf(f: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf(f"struct<{_NAMES6.replace(' double', ':double')}>")
    def apply(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(lie.packed(f(lie.symmetric(np.stack([xx, xy, xz, yy, yz, zz], 1)))), columns=list(COV))

    return apply


def matrix_functions() -> dict:
    """Functions of the six covariance columns that return six."""
    return {"log_spd3": _matrix_udf(lie.spd_log), "exp_spd3": _matrix_udf(lie.spd_exp), "plane_reg": _matrix_udf(lie.plane_regularized), "normalize_cov": _matrix_udf(lie.normalized_covariance)}


def eigen3():
    """Ascending eigenvalues l0 to l2 and the eigenvectors v00 to v22 (v0j is the first's) of six columns."""
    names = ["l0", "l1", "l2", *(f"v{i}{j}" for i in range(3) for j in range(3))]

    @F.pandas_udf(f"struct<{','.join(f'{n}:double' for n in names)}>")
    def apply(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(lie.symmetric(np.stack([xx, xy, xz, yy, yz, zz], 1)))
        return pd.DataFrame(np.concatenate([values, np.swapaxes(vectors, 1, 2).reshape(-1, 9)], 1), columns=names)

    return apply


def apply_matrix(df: DataFrame, name: str, cols: tuple[str, ...] = COV) -> DataFrame:
    """df with its covariance columns replaced by the function's."""
    made = df.withColumn("_m", matrix_functions()[name](*cols))
    return made.withColumns({c: F.col(f"_m.{d}") for c, d in zip(cols, COV)}).drop("_m")


def add_normals(df: DataFrame, limit: float = 1.0) -> DataFrame:
    """df with nx, ny, nz from its covariances and points."""

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(lie.normal_of(lie.symmetric(np.stack([xx, xy, xz, yy, yz, zz], 1)), np.stack([x, y, z], 1), limit), columns=list(NORMAL))

    made = df.withColumn("_n", normal(*COV, *XYZ))
    return made.withColumns({c: F.col(f"_n.{c}") for c in NORMAL}).drop("_n")


def add_curvature(df: DataFrame, out: str = "curvature") -> DataFrame:
    @F.pandas_udf("double")
    def f(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        return pd.Series(lie.curvature(lie.symmetric(np.stack([xx, xy, xz, yy, yz, zz], 1))))

    return df.withColumn(out, f(*COV))


def ray_cells(origin: np.ndarray, target: np.ndarray, size: float) -> np.ndarray:
    """Integer cells (n, 3) strictly between the cells of two points along the segment.

    Each axis crosses its cell borders at known parameters; all crossings in order of parameter, x
    before y before z at ties, give the cells. The walk begins after the origin's cell and ends
    before the target's."""
    a, b = np.asarray(origin, float) / size, np.asarray(target, float) / size
    first, last = np.floor(a).astype(np.int64), np.floor(b).astype(np.int64)
    steps = last - first
    if not np.abs(steps).any():
        return np.zeros((0, 3), np.int64)
    at, axis = [], []
    for k in range(3):
        n = abs(int(steps[k]))
        if n:
            border = first[k] + (np.arange(1, n + 1) if steps[k] > 0 else -np.arange(n))
            at.append((border - a[k]) / (b[k] - a[k]))
            axis.append(np.full(n, k))
    at, axis = np.concatenate(at), np.concatenate(axis)
    order = np.lexsort((axis, at))
    moves = np.zeros((len(order), 3), np.int64)
    moves[np.arange(len(order)), axis[order]] = np.sign(steps)[axis[order]]
    return (first + np.cumsum(moves, axis=0))[:-1]


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """Packed keys of integer cells; cells outside the key's range are left out."""
    moved = cells + KEY_OFFSET
    moved = moved[((moved >= 0) & (moved < 1 << KEY_BITS)).all(axis=1)]
    return moved[:, 0] | moved[:, 1] << KEY_BITS | moved[:, 2] << (2 * KEY_BITS)


def ray_keys_udf(size: float):
    """ARRAY<BIGINT> of the voxels strictly between an origin (3 columns) and a target (3 columns)."""

    @F.pandas_udf("array<bigint>")
    def f(ox: pd.Series, oy: pd.Series, oz: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([cell_keys(ray_cells(r[:3], r[3:], size)) for r in np.stack([ox, oy, oz, x, y, z], 1)])

    return f


class RayCells:
    """Table function ray_cells(ox, oy, oz, x, y, z, size): a row (key) for each voxel between."""

    def eval(self, ox: float, oy: float, oz: float, x: float, y: float, z: float, size: float):
        for k in cell_keys(ray_cells(np.array([ox, oy, oz]), np.array([x, y, z]), size)):
            yield (int(k),)


def register(spark: SparkSession) -> None:
    """Makes the functions available in spark.sql."""
    for name, f in {**matrix_functions(), "eigen3": eigen3()}.items():
        spark.udf.register(name, f)
    spark.udtf.register("ray_cells", F.udtf(RayCells, returnType="key: bigint"))
