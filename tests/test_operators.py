"""Small golden cases and properties of the point-set operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions import expr as E
from pointloom.functions import lie, udfs
from pointloom.operators import deskew, features, filters, imu, knn, lio, maps, sampling, voxel
from pointloom.operators import registration as reg
from pointloom.plans import local_maps, odometry


def points(spark, rows, cols=("x", "y", "z"), frame=0):
    data = [(frame, i, *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "frame_id long, point_id long, " + ", ".join(f"{c} double" for c in cols))


def cloud(spark, n, seed=1, spread=5.0):
    return points(spark, np.random.default_rng(seed).uniform(-spread, spread, (n, 3)))


def test_voxel_median(spark):
    rows = [(0.10, 0, 0, 1, 0, 10, 20, 30), (0.40, 0, 0, 3, 2, 20, 40, 60), (1.10, 0, 0, 5, 4, 30, 60, 90), (1.40, 0, 0, 7, 6, 50, 70, 90), (0.20, 0, 0, 100, 8, 70, 80, 90)]
    df = points(spark, rows, ("x", "y", "z", "intensity", "t_offset_ms", "r", "g", "b"))
    out = {round(r["x"], 4): r for r in voxel.voxel_downsample(df.withColumn("a", F.lit(1.0)), 1.0, 2).collect()}
    assert len(out) == 2
    near = out[0.2333]
    assert near["intensity"] == 3 and near["t_offset_ms"] == pytest.approx(10 / 3) and near["g"] == pytest.approx(46.666667)


def test_polar_median(spark):
    df = points(spark, [(1.1, 0, 0, 2), (1.4, 0, 0, 4), (2.1, 0, 0, 6), (2.3, 0, 0, 10), (2.4, 0, 0, 100)], ("x", "y", "z", "intensity"))
    out = sorted((r["x"], r["intensity"]) for r in voxel.polar_downsample(df, 1.0, math.pi, math.pi, least=2).collect())
    assert out == [(pytest.approx(1.25), 3.0), (pytest.approx(2.2666667), 10.0)]


def test_box_and_finite(spark):
    df = points(spark, [(1, 0, 0), (0.5, 0, 0), (5, 6, 0), (float("nan"), 1, 1), (float("inf"), 1, 1)])
    assert [r["point_id"] for r in filters.box_filter(df, 1.0, 5.5).collect()] == [0]
    assert filters.finite_filter(df).count() == 3
    assert filters.valid_points(df).first()[0] == 3


def test_angle_filter_errors(spark):
    with pytest.raises(ValueError):
        filters.angle_filter(cloud(spark, 3), 0.1, 0.5)
    with pytest.raises(ValueError):
        filters.angle_filter(cloud(spark, 3), 1.0, 0.5)


def test_samplers(spark):
    df = cloud(spark, 200).withColumn("w", F.when(F.col("point_id") < 150, 1.0).otherwise(0.0))
    a, b = ([r["point_id"] for r in sampling.uniform_sample(df, 50, s).collect()] for s in (1, 1))
    assert sorted(a) == sorted(b) and len(set(a)) == 50
    assert sampling.uniform_sample(df, 500).count() == 200
    got = {r["point_id"] for r in sampling.weighted_sample(df, 100, "w").collect()}
    assert len(got) == 100 and max(got) < 150
    assert sampling.mixed_sample(df, 180, "w", 1.0).select("point_id").distinct().count() == 180
    assert {r["point_id"] for r in sampling.mixed_sample(df, 20, "w", 0.0).collect()} == {r["point_id"] for r in sampling.uniform_sample(df, 20).collect()}
    for bad in (df.withColumn("w", F.lit(-1.0)), df.withColumn("w", F.lit(float("nan"))), df.withColumn("w", F.lit(0.0))):
        with pytest.raises(ValueError):
            sampling.weighted_sample(bad, 10, "w")
    with pytest.raises(ValueError):
        sampling.weighted_sample(df, 160, "w")
    with pytest.raises(ValueError):
        sampling.mixed_sample(df, 10, "w", 1.5)


def test_farthest(spark):
    out = sampling.farthest_points(np.array([[0.0, 0, 0], [10, 0, 0], [0.1, 0, 0], [5, 8, 0]]), 3, 0)
    assert out.tolist() == [0, 1, 3]
    assert sampling.farthest_sample(cloud(spark, 30), 5).count() == 5


@pytest.mark.parametrize("k", [1, 3, 10])
def test_grid_knn_equals_brute(spark, k):
    q, t = cloud(spark, 60, 1), cloud(spark, 300, 2)
    a, b = (sorted(tuple(r) for r in f(q, t, k).collect()) for f in (knn.grid_knn, knn.brute_knn))
    assert [x[:3] for x in a] == [x[:3] for x in b]


def test_knn_edges(spark):
    one, q = points(spark, [(0, 0, 0)]), points(spark, [(1, 1, 1)])
    assert tuple(knn.knn(q, one, 5).first()) == (0, 1, 0, 3.0)
    empty = one.where("false")
    assert knn.knn(q, empty, 3).count() == 0 and knn.knn(empty, one, 3).count() == 0
    far = points(spark, [(1000, 0, 0), (0, 0, 0), (0, 1, 0)])
    assert [r["nbr_id"] for r in knn.grid_knn(q, far, 3, size=0.5).orderBy("rank").collect()] == [2, 1, 0]


def test_radius(spark):
    c = cloud(spark, 200, 3)
    x = np.array([[r["x"], r["y"], r["z"]] for r in c.orderBy("point_id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert knn.radius_search(c, c, 1.5).count() == (d <= 2.25).sum()
    assert knn.radius_search(c, c, 1.5, 2).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 2


def test_covariance_and_robust(spark):
    c = cloud(spark, 60, 5)
    plain = {r["point_id"]: [r[k] for k in E.COV] for r in features.covariances(c, 8).collect()}
    none = {r["point_id"]: [r[k] for k in E.COV] for r in features.robust_covariances(c, 8, "none").collect()}
    assert all(np.allclose(plain[i], none[i], atol=1e-9) for i in plain)
    few = features.covariances(points(spark, [(0, 0, 0), (1, 0, 0)]), 8).first()
    assert [few[k] for k in E.COV] == [1, 0, 0, 1, 0, 1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=6, max_size=6))
def test_exp_log(v):
    t = lie.se3_exp(np.array(v))
    assert np.allclose(lie.se3_exp(lie.se3_log(t)), t, atol=1e-9)
    assert np.allclose(lie.quaternion_to_rotation(lie.rotation_to_quaternion(t[:3, :3])), t[:3, :3], atol=1e-9)


def test_spd():
    a = np.random.default_rng(0).normal(size=(20, 3, 3))
    m = a @ np.swapaxes(a, 1, 2) + np.eye(3) * 0.1
    assert np.allclose(lie.spd_exp(lie.spd_log(m)), m)
    assert np.allclose(np.linalg.eigvalsh(lie.plane_regularized(m)), [1e-3, 1, 1])


def test_intensity(spark):
    df = points(spark, [(2, 0, 0, 10)], ("x", "y", "z", "intensity"))
    assert features.correct_intensity(df, 2.0, reference=1.0).first()["intensity"] == 40
    for bad in ({"distance_exponent": -1.0}, {"reference": 0.0}):
        with pytest.raises(ValueError):
            features.correct_intensity(df, **bad)
    with pytest.raises(ValueError):
        features.correct_intensity(cloud(spark, 2))
    flat = points(spark, [(5, i * 0.1, 0, 3) for i in range(10)], ("x", "y", "z", "intensity"))
    assert all(abs(r["intensity"] - 1) < 1e-9 for r in features.normalize_by_local_mean(flat, 5, 1, 1, 1, floor=0.1).collect())


def _plane_scene(n=300, seed=7):
    rng = np.random.default_rng(seed)
    a, b, c = (rng.uniform(-5, 5, (n // 3, 3)) for _ in range(3))
    a[:, 0], b[:, 1], c[:, 2] = -5, 5, -5
    return np.concatenate([a, b, c])


@pytest.mark.parametrize("kind", list(reg.RegType))
@pytest.mark.parametrize("optimizer", list(reg.Optimizer))
def test_align_recovers(kind, optimizer):
    x, T = _plane_scene(), lie.se3_exp(np.array([0.02, -0.01, 0.03, 0.1, -0.05, 0.08]))
    def made(p):
        c = reg.Cloud(p)
        c.cov = odometry.cloud_covariances(c, 10)
        c.normal = lie.normal_of(c.cov, c.xyz, 0.0)
        return c
    back = lie.inverse_pose(T)
    out = reg.align(reg.FrameProblem(made(x @ back[:3, :3].T + back[:3, 3]), made(x), reg.Params(reg_type=kind)), reg.Params(reg_type=kind, optimizer=optimizer, max_iterations=40))
    assert np.allclose(out.T, T, atol=5e-3)


def test_spark_and_frame_agree(spark):
    x = _plane_scene(90)
    src, tgt = points(spark, x + 0.05), points(spark, x)
    p = reg.Params(reg_type=reg.RegType.POINT_TO_POINT, loss=reg.Loss.CAUCHY, scale=1.0)
    a = reg.SparkProblem(src, tgt, p).linearize(np.eye(4), 1.0, 10.0)
    b = reg.FrameProblem(reg.Cloud(x + 0.05), reg.Cloud(x), p).linearize(np.eye(4), 1.0, 10.0)
    assert np.allclose(a.H, b.H) and np.allclose(a.b, b.b) and a.error == pytest.approx(b.error) and a.inlier == b.inlier


def test_normals_come_from_covariances(spark):
    """A target without normals gets them from its covariances, on DataFrames and on arrays."""
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(60, 3))
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    tgt = features.covariances(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 8)
    p = reg.Params(reg_type=reg.RegType.POINT_TO_PLANE, max_distance=5.0)
    a = reg.SparkProblem(tgt, tgt, p).linearize(np.eye(4), 1.0, 1.0)
    got = tgt.orderBy("point_id").toPandas()
    cov = np.stack([got[c] for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")], 1)
    cloud = reg.Cloud(got[["x", "y", "z"]].to_numpy(), lie.symmetric(cov))
    b = reg.FrameProblem(cloud, cloud, p).linearize(np.eye(4), 1.0, 1.0)
    assert np.allclose(a.H, b.H) and a.inlier == b.inlier == 60 and np.abs(a.H).max() > 0


def test_schedule_and_validation():
    p = reg.PipelineParams(auto_scale=True, init_scale=8, min_scale=1, levels=4)
    assert [round(s, 6) for s, _ in reg.scale_schedule(reg.Params(loss=reg.Loss.CAUCHY), p)] == [8, 4, 2, 1]
    assert len(reg.scale_schedule(reg.Params(), p)) == 1
    with pytest.raises(ValueError):
        reg.Params(reg_type=reg.RegType.GICP).validate(["x"], ["x"])
    assert reg.RegType.from_string("gicp") is reg.RegType.GICP
    with pytest.raises(ValueError):
        reg.Loss.from_string("square")
    assert reg.align(None, reg.Params(), np.eye(4) * 1.0, empty=True).converged is False


def test_degenerate_and_prior():
    lin = reg.Linear(np.diag([100.0, 100, 100, 100, 100, 0]), np.ones(6), 1.0, 10)
    out = reg.regularize(lin, np.eye(4), np.eye(4), reg.DegeneracyParams(reg.Degeneracy.NL_REG))
    assert out.H[5, 5] == pytest.approx(10) and out.H[0, 0] == 100
    prior = reg.MapPrior(reg.PriorParams(enabled=True))
    prior.update(reg.Result(np.eye(4), inlier=10, H_raw=np.eye(6), error_raw=1.0), np.eye(4))
    assert prior.error(np.eye(4)) == 0 and np.linalg.eigvalsh(prior.omega)[0] > 0


def test_rays():
    assert udfs.ray_cells(np.array([0.5, 0.5, 0.5]), np.array([3.5, 0.5, 0.5]), 1.0).tolist() == [[1, 0, 0], [2, 0, 0]]
    assert len(udfs.ray_cells(np.array([0.1, 0, 0]), np.array([0.2, 0, 0]), 1.0)) == 0
    back = udfs.ray_cells(np.array([0.5, 0.5, 0.5]), np.array([-2.5, -1.5, 0.5]), 1.0)
    assert (np.abs(np.diff(back, axis=0)).sum(1) == 1).all() and len(back) == 4


def test_ray_table_function(spark):
    udfs.register(spark)
    assert spark.sql("SELECT count(*) FROM ray_cells(0.5D, 0.5D, 0.5D, 3.5D, 0.5D, 0.5D, 1.0D)").first()[0] == 2


def test_voxel_map(spark):
    p = maps.VoxelMapParams(1.0, stale_after=1, evict_every=1)
    state = maps.empty_map(spark)
    for k, x in enumerate((0.25, 0.75, 5.5, 9.5), 1):
        state = maps.voxel_insert(state, points(spark, [(x, 0.5, 0.5)]), k, p).persist()
    assert sorted(r["sx"] for r in state.collect()) == [5.5, 9.5]
    a = maps.voxel_insert(maps.empty_map(spark), points(spark, [(0.25, 0, 0), (0.75, 0, 0), (2.5, 0, 0)]), 1, maps.VoxelMapParams())
    assert maps.voxel_overlap(points(spark, [(0.5, 0, 0), (2.2, 0, 0), (7, 0, 0)]), a, 1.0).first()[0] == pytest.approx(2 / 3)


def test_occupancy_spark_equals_local(spark):
    x = np.random.default_rng(2).uniform(-4, 4, (40, 3))
    p = maps.OccupancyParams(size=0.5, hit=0.5, miss=-0.0625)
    state = maps.occupancy_insert(maps.empty_map(spark, True), points(spark, x), 1, p)
    got = {r["key"]: (r["hit_count"], r["log_odds"]) for r in state.collect()}
    local = local_maps.LocalOccupancy(p)
    local.add(reg.Cloud(x), np.eye(4))
    want = {int(k): (int(s[0]), o) for k, s, o in zip(local.key, local.sums, local.log_odds)}
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want) and len(got) == len(want)
    q = maps.query_probability(state, points(spark, [(100, 0, 0)]), p).first()["probability"]
    assert q == 0.5


def test_visibility(spark):
    p = maps.OccupancyParams(size=1.0, carve=False)
    state = maps.occupancy_insert(maps.empty_map(spark, True), points(spark, [(2.5, 0.5, 0.5), (5.5, 0.5, 0.5), (0.5, 4.5, 0.5), (-3.5, 0.5, 0.5)]), 1, p)
    T = lie.pose(np.eye(3), np.array([0.5, 0.5, 0.5]))
    seen = sorted(r["x"] for r in maps.visible_points(state, T, 10.0, math.radians(90), math.radians(90), p).collect())
    assert seen == [2.5]
    assert sorted(r["x"] for r in maps.visible_points(state, T, 10.0, math.pi, math.pi, p).collect()) == [-3.5, 2.5]


def test_map_config():
    for bad in ({"size": 0}, {"low": 1, "high": 0}, {"probability": 1.0}):
        with pytest.raises(ValueError):
            maps.OccupancyParams(**bad)


def test_deskew(spark):
    T = lie.pose(lie.so3_exp(np.array([0, 0, math.pi / 2])), np.array([1.0, 0, 0]))
    world, xyz = np.array([1.0, 1, 0]), []
    for s in (0, 0.5, 1):
        pose = lie.se3_exp(lie.se3_log(T) * s)
        xyz.append(lie.inverse_pose(pose)[:3, :3] @ world + lie.inverse_pose(pose)[:3, 3])
    c = reg.Cloud(np.array(xyz), t_offset_ms=np.array([0, 500.0, 1000]))
    assert np.allclose(deskew.deskew_cloud(c, np.eye(4), T, 1.0).xyz, world, atol=1e-5)
    df = points(spark, [(*p, t) for p, t in zip(xyz, (0, 500, 1000))], ("x", "y", "z", "t_offset_ms"))
    out = deskew.deskew_points(df, np.eye(4), T, 1.0)
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in out.collect()], world, atol=1e-5)
    assert deskew.deskew_cloud(reg.Cloud(np.zeros((2, 3))), np.eye(4), T, 1.0) is None


def _still(n=101, seconds=1.0, gyro=(0, 0, 0)):
    t = np.linspace(0, seconds, n)
    return np.column_stack([t, np.tile(gyro, (n, 1)), np.tile([0, 0, 9.80665], (n, 1))])


def test_imu_deskew_status():
    ident, still = np.eye(4), _still()
    c = reg.Cloud(np.ones((3, 3)), t_offset_ms=np.array([0.0, 50, 100]))
    run = lambda c_, rows, s=0.1: deskew.deskew_by_imu(c_, rows, 0.2, s, ident, imu.Bias(), imu.ImuParams(), np.eye(3), np.zeros(3))
    status, out = run(c, still)
    assert status is deskew.DeskewStatus.SUCCESS and np.allclose(out.xyz, 1, atol=1e-6)
    assert run(reg.Cloud(np.zeros((0, 3))), still)[0] is deskew.DeskewStatus.EMPTY_CLOUD
    assert run(reg.Cloud(np.ones((1, 3))), still)[0] is deskew.DeskewStatus.NO_TIMESTAMPS
    assert run(c, still, 0.0)[0] is deskew.DeskewStatus.INVALID_SCAN_DURATION
    assert run(c, still[:5])[0] is deskew.DeskewStatus.INSUFFICIENT_IMU_COVERAGE


def test_preintegration_closed_form():
    s = imu.Preintegration()
    s.extend(_still(gyro=(0, 0, 0.5)))
    assert np.allclose(s.state.R, lie.so3_exp(np.array([0, 0, 0.5])))
    rel = s.predict_relative(np.eye(3), np.zeros(3), imu.Bias())
    assert np.allclose(rel[:3, 3], 0, atol=1e-3)
    e = 1e-5
    moved = imu.Preintegration()
    moved.reset(imu.Bias(gyro=np.array([e, 0, 0])))
    moved.extend(_still(gyro=(0.1, 0.2, 0.5)))
    base = imu.Preintegration().extend(_still(gyro=(0.1, 0.2, 0.5)))
    assert np.allclose((moved.state.p - base.state.p) / e, base.state.p_bg[:, 0], atol=1e-3)


def test_imu_covariance_and_factor():
    s = imu.Preintegration(imu.ImuParams(gyro_noise=1e-3, accel_noise=1e-2, gyro_walk=1e-5, accel_walk=1e-4))
    s.reset(covariance=np.eye(15) * 1e-4)
    s.extend(_still())
    P = s.state.covariance
    assert np.allclose(P, P.T) and np.linalg.eigvalsh(P)[0] > 0
    ok, H, b = imu.imu_factor(imu.State(), imu.State(p=np.ones(3)), np.eye(15) * 2)
    assert ok and np.allclose(H, np.eye(15) / 2) and np.allclose(b[:3], 0.5)
    assert imu.imu_factor(imu.State(), imu.State(), -np.eye(15))[0] is False


def test_initial_alignment():
    tilt = lie.so3_exp(np.array([0.1, -0.05, 0]))
    rows = _still()
    rows[:, 4:7] = tilt.T @ np.array([0, 0, 9.80665])
    out = imu.initial_alignment(rows, np.array(imu.GRAVITY), imu.AlignmentParams(), imu.Bias())
    assert out.success and np.allclose(out.R_world_imu @ rows[0, 4:7], [0, 0, 9.80665], atol=1e-6)
    rows[:, 1] = np.sin(np.arange(len(rows)))
    assert not imu.initial_alignment(rows, np.array(imu.GRAVITY), imu.AlignmentParams(), imu.Bias()).success
    gate = imu.AlignmentGate(imu.AlignmentParams(max_wait_seconds=1.0), np.array(imu.GRAVITY), np.eye(4))
    assert not gate.attempt(0.0, rows, imu.Bias())[0].success and gate.attempt(2.0, rows, imu.Bias())[0].success


def test_lio_parts():
    T = lie.se3_exp(np.array([0.1, 0.2, 0.3, 1, 2, 3]))
    P = np.diag(np.arange(1.0, 16))
    assert np.allclose(lio.covariance_to_imu(lio.covariance_to_lidar(P, T, np.eye(3)), T, np.eye(3)), P)
    H, b = np.eye(15) * 100, np.ones(15)
    H[0, 0] = 1
    A, _ = lio.attenuate(H, b, 10, lio.DirectionalParams(True, 1.0, 1.0, 0.0, 0.0))
    assert A[0, 0] == pytest.approx(0.1) and A[1, 1] == pytest.approx(100)


def test_odometry_statuses():
    p = odometry.OdometryParams(preprocess=odometry.PreprocessParams(box_min=0.0), registration=reg.Params(reg_type=reg.RegType.POINT_TO_POINT), min_points=10)
    o = odometry.LidarOdometry(p)
    x = _plane_scene(90)
    assert o.process(reg.Cloud(x[:5]), 0.0) is odometry.Status.SMALL_NUMBER_OF_POINTS
    assert o.process(reg.Cloud(x), 1.0) is odometry.Status.FIRST_FRAME
    assert o.process(reg.Cloud(x), 1.0) is odometry.Status.OLD_TIMESTAMP
    assert o.process(reg.Cloud(x - [0.1, 0, 0]), 2.0) is odometry.Status.SUCCESS
    assert o.pose[0, 3] == pytest.approx(0.1, abs=1e-2)
    assert not o.add_imu(float("nan"), np.zeros(3), np.zeros(3)) and o.add_imu(1.0, np.zeros(3), np.zeros(3)) and not o.add_imu(0.5, np.zeros(3), np.zeros(3))
    i = odometry.LidarInertialOdometry(p)
    assert i.process(reg.Cloud(x), 0.0) is odometry.Status.NO_IMU
    for r in _still(301, 3.0):
        i.add_imu(r[0], r[1:4], r[4:7])
    assert i.process(reg.Cloud(x), 1.0) is odometry.Status.FIRST_FRAME
    assert i.process(reg.Cloud(x[:3]), 1.5) is odometry.Status.IMU_ONLY
    assert i.process(reg.Cloud(x), 2.0) is odometry.Status.SUCCESS
