"""Sensor messages: packed point clouds, their times, trajectories, ordered replay, markers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie

# Fixed codes of a packed cloud's field types.
FIELD_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
MESSAGE = "frame_id bigint, ts double, point_step int, fields array<struct<name:string,offset:int,datatype:int>>, data binary"
POINTS = "frame_id bigint, point_id bigint, x double, y double, z double, r double, g double, b double, a double, intensity double, raw_time double, time_type int, ring bigint, ambient double"


def unpack_message(data: bytes, step: int, fields: list[dict], reflectivity: bool = True) -> dict[str, np.ndarray | None]:
    """Columns of a packed cloud. Colours are bytes over 255; `reflectivity` is preferred to
    `intensity` where wanted; a field that is missing is None."""
    at = {f["name"]: f for f in fields}
    n = len(data) // step if step else 0
    raw = np.frombuffer(data, np.uint8, n * step).reshape(n, step) if n else np.zeros((0, max(step, 1)), np.uint8)

    def get(name: str, kind: str | None = None) -> np.ndarray | None:
        f = at.get(name)
        if f is None:
            return None
        t = np.dtype(kind or FIELD_TYPES[f["datatype"]])
        return np.ascontiguousarray(raw[:, f["offset"] : f["offset"] + t.itemsize]).view(t)[:, 0]

    if any(c not in at for c in "xyz"):
        raise ValueError("x, y and z are needed")
    if any(at[c]["datatype"] not in (7, 8) for c in "xyz"):
        raise ValueError("x, y and z must be floating point")
    out: dict[str, np.ndarray | None] = {c: get(c).astype(float) for c in "xyz"}
    packed = get("rgb", "<u4") if "rgb" in at else get("rgba", "<u4")
    for k, c in enumerate("rgb"):
        out[c] = None if packed is None else ((packed >> (16 - 8 * k)) & 255) / 255.0
    out["a"] = None if packed is None else np.ones(n)
    name = next((c for c in (("reflectivity", "intensity") if reflectivity else ("intensity",)) if c in at), None)
    out["intensity"] = None if name is None else get(name).astype(float)
    clock = next((c for c in ("timestamp", "time", "t", "offset_time") if c in at), None)
    out["raw_time"] = None if clock is None else get(clock).astype(float)
    out["time_type"] = None if clock is None else np.full(n, at[clock]["datatype"])
    out["ring"] = None if (r := get("ring")) is None else r.astype(np.int64)
    out["ambient"] = None if (r := get("ambient")) is None and (r := get("near_ir")) is None else r.astype(float)
    return out


def decode_messages(messages: DataFrame, reflectivity: bool = True) -> DataFrame:
    """Points of packed clouds (columns as in MESSAGE)."""
    kinds = {"frame_id": pa.int64(), "point_id": pa.int64(), "time_type": pa.int32(), "ring": pa.int64()}
    names = [c.split()[0] for c in POINTS.split(", ")]

    def decode(batches):
        for b in batches:
            for m in b.to_pylist():
                cols = unpack_message(m["data"] or b"", m["point_step"], m["fields"], reflectivity)
                n = len(cols["x"])
                cols |= {"frame_id": np.full(n, m["frame_id"]), "point_id": np.arange(n)}
                yield pa.RecordBatch.from_arrays([pa.nulls(n, kinds.get(c, pa.float64())) if cols.get(c) is None else pa.array(cols[c], kinds.get(c, pa.float64())) for c in names], names=names)

    return messages.select("frame_id", "point_step", "fields", "data").mapInArrow(decode, POINTS)


def normalize_times(points: DataFrame, start_ms: Column | str = "start_time_ms") -> DataFrame:
    """points with t_offset_ms from raw_time and time_type: unsigned integers are nanoseconds; 32-bit
    floats are seconds from the start; 64-bit floats above 1e8 are epoch seconds and else seconds
    from the start. Offsets are not negative."""
    t = F.col("raw_time")
    start = F.col(start_ms) if isinstance(start_ms, str) else start_ms
    ms = F.when(F.col("time_type") == 6, t * 1e-6).when(F.col("time_type") == 7, t * 1e3).when(F.col("time_type") == 8, F.when(t > 1e8, t * 1e3 - start).otherwise(t * 1e3))
    return points.withColumn("t_offset_ms", F.when(ms.isNotNull(), F.greatest(ms, E.lit(0))))


def end_times(points: DataFrame) -> DataFrame:
    """(frame_id, end_time_ms) of timed points with start_time_ms."""
    return points.groupBy("frame_id").agg((F.max("start_time_ms") + F.coalesce(F.max("t_offset_ms"), E.lit(0))).alias("end_time_ms"))


def pack_points(cols: dict[str, np.ndarray]) -> tuple[bytes, int, list[dict]]:
    """(data, step, fields) of a packed cloud with x, y, z and, where given, rgb, intensity, timestamp."""
    kinds = [(c, "<f4", 7, cols[c]) for c in "xyz"]
    if all(cols.get(c) is not None for c in "rgb"):
        r, g, b = (np.clip(np.asarray(cols[c]) * 255, 0, 255).astype(np.uint32) for c in "rgb")
        kinds.append(("rgb", "<u4", 6, r << 16 | g << 8 | b))
    kinds += [(n, "<f4", 7, cols[c]) for c, n in (("intensity", "intensity"), ("t_offset_ms", "timestamp")) if cols.get(c) is not None]
    rows = np.empty(len(cols["x"]), [(n, k) for n, k, _, _ in kinds])
    fields, at = [], 0
    for n, k, code, v in kinds:
        rows[n] = v
        fields.append({"name": n, "offset": at, "datatype": code})
        at += np.dtype(k).itemsize
    return rows.tobytes(), at, fields


def encode_messages(points: DataFrame) -> DataFrame:
    """A packed cloud for each frame of points(frame_id, ts, point_id, x, y, z, ..); a frame is a message
    and so one row."""
    keep = [c for c in ("x", "y", "z", "r", "g", "b", "intensity", "t_offset_ms") if c in points.columns]

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point_id")
        data, step, fields = pack_points({c: part[c].to_numpy() for c in keep})
        return pd.DataFrame([{"frame_id": key[0], "ts": key[1], "point_step": step, "fields": fields, "data": data}])

    return points.select("frame_id", "ts", "point_id", *keep).groupBy("frame_id", "ts").applyInPandas(pack, MESSAGE)


def tum_lines(poses: DataFrame) -> DataFrame:
    """(value) trajectory lines `ts x y z qx qy qz qw` with nine decimals."""
    return poses.select(F.format_string(" ".join(["%.9f"] * 8), "ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw").alias("value"))


def write_tum(poses: DataFrame, path: str, first_frame: bool = True) -> None:
    """One text file of poses in order of time; frames that failed, and the first one unless wanted, are
    left out where poses has a status."""
    if "status" in poses.columns:
        poses = poses.where(F.col("status").isin("success", "imu_only", *(["first_frame"] if first_frame else [])))
    tum_lines(poses.orderBy("ts").coalesce(1)).write.mode("overwrite").text(path)


def replay(spark: SparkSession, path: str, schema: str, start_offset: float = 0.0) -> DataFrame:
    """Recorded rows in order of ts, from start_offset seconds after the first."""
    rows = spark.read.schema(schema).parquet(path)
    first = rows.agg(F.min("ts")).first()[0]
    return rows.where(F.col("ts") >= (first or 0.0) + start_offset).orderBy("ts")


def pose_covariance(H: np.ndarray) -> np.ndarray:
    """Covariance of a pose message: the inverse information with translation before rotation."""
    order = [3, 4, 5, 0, 1, 2]
    return np.linalg.pinv(H)[np.ix_(order, order)]


def publish_poses(stream: DataFrame, path: str, checkpoint: str, T_lidar_base: np.ndarray | None = None):
    """Starts a query that appends each batch's poses, seen from the base, to path."""
    T = np.eye(4) if T_lidar_base is None else T_lidar_base

    def sink(batch: DataFrame, _: int) -> None:
        q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
        p = [F.col(c) for c in ("tx", "ty", "tz")]
        w = [E.lit(v) for v in T[:3, 3]]
        u = E.cross(q[:3], w)
        moved = [a + 2 * (q[3] * b + c) for a, b, c in zip(w, u, E.cross(q[:3], u))]
        batch.withColumns({n: a + b for n, a, b in zip(("tx", "ty", "tz"), p, moved)}).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ellipsoids(points: DataFrame, factor: float = 1.0, low: float = 1e-3, high: float = math.inf) -> DataFrame:
    """points with axis lengths s0 to s2, an orientation and planarity of their covariances."""

    @F.pandas_udf("struct<s0:double,s1:double,s2:double,qx:double,qy:double,qz:double,qw:double,planarity:double>")
    def f(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        values, vectors = np.linalg.eigh(lie.symmetric(np.stack([xx, xy, xz, yy, yz, zz], 1)))
        vectors = vectors * np.where(np.linalg.det(vectors) < 0, -1, 1)[:, None, None]
        scale = np.clip(np.sqrt(np.maximum(values, 0)) * factor, low, high)
        flat = 1 - values[:, :1] / (values[:, 2:] + 1e-6)
        return pd.DataFrame(np.concatenate([scale, lie.rotation_to_quaternion(vectors), flat], 1), columns=["s0", "s1", "s2", "qx", "qy", "qz", "qw", "planarity"])

    return points.withColumn("_e", f(*E.COV)).select(*points.columns, "_e.*")
