"""Row filters. A point set is a DataFrame with x, y, z and optional columns; frame_id and point_id
identify rows. A filter keeps every column, so compaction of attributes is Spark's own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def require(df: DataFrame, *cols: str) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def finite_filter(df: DataFrame) -> DataFrame:
    return df.where(E.finite())


def box_filter(df: DataFrame, low: float = 1.0, high: float = 3.4028234663852886e38) -> DataFrame:
    """Keeps finite points whose largest absolute coordinate lies in [low, high]."""
    reach = F.greatest(*(F.abs(F.col(c)) for c in E.XYZ))
    return df.where(E.finite() & (reach >= float(low)) & (reach <= float(high)))


def incidence_cosine(point: list[Column], normal: list[Column]) -> Column:
    """|cos| of the angle between ray and normal; null where their lengths' product is not above 1e-6."""
    denominator = E.norm(point) * E.norm(normal)
    return F.abs(E.dot(point, normal)) / F.when(denominator > E.TINY_NORM, denominator)


def with_normals(df: DataFrame) -> DataFrame:
    """df as it is, or with normals derived from its covariances."""
    if has(df, *E.NORMAL):
        return df
    if not has(df, *E.COV):
        raise ValueError("normals or covariances are needed")
    from ..functions.udfs import add_normals

    return add_normals(df)


def angle_filter(df: DataFrame, low: float, high: float) -> DataFrame:
    """Keeps points whose angle of incidence lies in [low, high], 0 <= low < high <= pi/2."""
    if not 0 <= low < high <= math.pi / 2 + 1e-7:
        raise ValueError("the range must satisfy 0 <= low < high <= pi/2")
    made = with_normals(df)
    cos = incidence_cosine([F.col(c) for c in E.XYZ], [F.col(c) for c in E.NORMAL])
    kept = made.where(F.coalesce((cos >= math.cos(high)) & (cos <= math.cos(low)), F.lit(False)))
    return kept.select(*df.columns)


def compact(df: DataFrame, flag: Column | str) -> DataFrame:
    """The rows whose flag is set."""
    return df.where(F.col(flag) if isinstance(flag, str) else flag)


def frame_times(points: DataFrame, frames: DataFrame) -> DataFrame:
    """frames with end_time_ms = start_time_ms + the largest offset of its points (start, if none)."""
    last = points.groupBy("frame_id").agg(F.max("t_offset_ms").alias("_last"))
    ended = frames.join(last, "frame_id", "left").withColumn("end_time_ms", F.col("start_time_ms") + F.coalesce("_last", F.lit(0.0)))
    return ended.drop("_last")


def index_remap(df: DataFrame, flag: Column, by: str = "frame_id") -> DataFrame:
    """(by, point_id, new_index): the place of each row among those kept in its frame, -1 for the others."""
    kept = F.sum(F.when(flag, 1).otherwise(0)).over(Window.partitionBy(by).orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0))
    return df.select(by, "point_id", F.when(flag, kept - 1).otherwise(F.lit(-1)).cast("long").alias("new_index"))


def valid_points(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(E.finite()).alias("n_valid"))


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both, with the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).unionByName(b.select(common))


def merge_scans(a: DataFrame, b: DataFrame, start_a: float, start_b: float) -> tuple[DataFrame, float]:
    """extend() with time offsets counted from the earlier start; offsets go if a non-empty side lacks them."""
    start = min(start_a, start_b)
    sides = [(d, s) for d, s in ((a, start_a), (b, start_b))]
    timed = all(has(d, "t_offset_ms") for d, _ in sides)
    moved = [d.withColumn("t_offset_ms", F.col("t_offset_ms") + F.lit(float(s - start))) if timed else d.drop("t_offset_ms") for d, s in sides]
    return extend(*moved), start


def erase(df: DataFrame, first: int, last: int) -> DataFrame:
    """Without the points numbered first <= point_id < last."""
    return df.where((F.col("point_id") < first) | (F.col("point_id") >= last))
