"""Round trips through files and messages, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import maps
from pointloom.operators import registration as reg
from pointloom.plans import odometry
from pointloom.sources import points, sensors
from pointloom.streaming import odometry as streaming


def _cloud(spark, n=100, rgb=False):
    x = np.random.default_rng(42).uniform(-10, 10, (n, 3))
    rows = [(i, *map(float, p), 1.0, 0.0, 128 / 255, float(i)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double, intensity double")
    return df if rgb else df.drop("r", "g", "b", "intensity")


@pytest.mark.parametrize("ext", ["ply", "pcd"])
@pytest.mark.parametrize("ascii", [True, False])
@pytest.mark.parametrize("rgb", [True, False])
def test_round_trip(spark, tmp_path, ext, ascii, rgb):
    df = _cloud(spark, rgb=rgb)
    path = points.write_file(df, f"{tmp_path}/c.{ext}", ascii)
    back = points.read_file(spark, path).orderBy("point_id").toPandas()
    want = df.toPandas()
    assert np.allclose(back[["x", "y", "z"]], want[["x", "y", "z"]], atol=1e-5)
    if rgb:
        assert np.allclose(back[["r", "g", "b"]], want[["r", "g", "b"]], atol=1e-6)
        assert ("intensity" in back) == (ext == "ply")
        assert "r" not in points.read_file(spark, path, rgb=False).columns


def test_errors(spark, tmp_path):
    df = _cloud(spark)
    with pytest.raises(ValueError):
        points.write_file(df, f"{tmp_path}/c.xyz")
    with pytest.raises(ValueError):
        points.write_ply(df.where("false"), f"{tmp_path}/e")
    (tmp_path / "bad.ply").write_bytes(b"nothing")
    with pytest.raises(Exception):
        points.read_file(spark, f"{tmp_path}/bad.ply").count()
    (tmp_path / "big.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + bytes(12))
    with pytest.raises(Exception):
        points.read_file(spark, f"{tmp_path}/big.ply").count()
    assert points.write_ply(df.union(df.limit(1).withColumn("x", F.lit(float("nan")))), f"{tmp_path}/ok").endswith(".ply")
    assert points.read_file(spark, f"{tmp_path}/ok.ply").count() == 100


def test_messages(spark):
    df = _cloud(spark, 20, True).withColumns({"frame_id": F.lit(3).cast("long"), "ts": F.lit(1.5), "t_offset_ms": F.col("intensity")})
    back = sensors.decode_messages(sensors.encode_messages(df)).orderBy("point_id").toPandas()
    want = df.orderBy("point_id").toPandas()
    assert np.allclose(back[["x", "y", "z", "intensity"]], want[["x", "y", "z", "intensity"]], atol=1e-5)
    assert np.allclose(back["b"], 128 / 255)


def test_tum(spark, tmp_path):
    poses = spark.createDataFrame([(2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, "success"), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, "first_frame")], "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double, status string")
    sensors.write_tum(poses, f"{tmp_path}/t", first_frame=False)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/t").collect()] == ["2.000000000 1.000000000" + " 0.000000000" * 5 + " 1.000000000"]


def test_streaming(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-5, 5, (60, 3))
    for k in range(2):
        rows = [(0, 0.5 * k + 1, k, i, *map(float, p - [0.05 * k, 0, 0])) for i, p in enumerate(x)]
        spark.createDataFrame(rows, "stream_id long, ts double, frame_id long, point_id long, x double, y double, z double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    p = odometry.OdometryParams(preprocess=odometry.PreprocessParams(box_min=0.0), registration=reg.Params(reg_type=reg.RegType.POINT_TO_POINT), min_points=10)
    q = streaming.stream_odometry(src, p).writeStream.format("memory").queryName("poses").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["frame_id"]: r for r in spark.table("poses").collect()}
    assert got[0]["status"] == "first_frame" and got[1]["status"] == "success" and abs(got[1]["tx"] - 0.05) < 1e-2
    m = streaming.stream_voxel_map(src, maps.VoxelMapParams(1.0), f"{tmp_path}/map", f"{tmp_path}/cp2")
    m.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/map/v0").agg(F.sum("n")).first()[0] == 120
