"""Queries that compared all pairs, or went sample by sample, on tables they have to be able to do."""

import numpy as np
import pytest

from pointloom.functions import near
from pointloom.operators import knn
from pointloom.plans import catalog

SMALL = "/root/testdata/sf0.01"


def all_pairs(q, t, ids, k, limit=np.inf):
    out = []
    for r in near.squared(q, t):
        o = [j for j in np.lexsort((ids, r))[:k] if r[j] <= limit]
        out.append((ids[o].tolist(), r[o].tolist()))
    return out


@pytest.mark.parametrize("n, m, k, grid", [(300, 2000, 1, 64), (300, 2000, 5, 1), (400, 3000, 10, 4), (50, 3, 5, 8), (100, 900, 3, 0.25), (10, 0, 3, 1), (0, 10, 3, 1)])
def test_tree_equals_all_pairs(n, m, k, grid):
    """Coarse grids make many copies and ties."""
    rng = np.random.default_rng(n + m)
    t, q = (np.floor(rng.normal(size=(c, 3)) * 2 * grid) / grid for c in (m, n))
    ids = rng.permutation(m) + 5
    for limit in (np.inf, 0.25):
        found, dist = near.Tree(t, ids, k).knn(q, k, limit)
        got = [(i[np.isfinite(d)].tolist(), d[np.isfinite(d)].tolist()) for i, d in zip(found, dist)]
        assert got == all_pairs(q, t, ids, k, limit)


@pytest.fixture
def no_products(monkeypatch):
    def refuse(*a, **b):
        raise AssertionError("compares all pairs")

    monkeypatch.setattr(knn, "brute_knn", refuse)
    monkeypatch.setattr(knn, "grid_knn", refuse)


def test_delete_by_tree(spark, no_products):
    """j7: a table of this kind failed when it grew to 100000 rows."""
    got = catalog.QUERIES["j7_delete"](spark, SMALL)
    emb = catalog.views.cloud_emb(spark, SMALL).orderBy("point_id").toPandas()
    left = emb[emb.x >= 0]
    want = all_pairs(emb[list("xyz")].to_numpy(), left[list("xyz")].to_numpy(), left.point_id.to_numpy(), 3)
    rows = {(r["query_id"], r["rank"]): (r["nbr_id"], r["dist_sq"]) for r in got.collect()}
    assert rows == {(i, k + 1): x for i, w in zip(emb.point_id.tolist(), want) for k, x in enumerate(zip(*w))}


def test_many_targets_still_go_to_cells(spark, monkeypatch):
    c = catalog.views.cloud_emb(spark, SMALL)
    want = {tuple(r) for r in knn.knn(c, c, 4).collect()}
    monkeypatch.setattr(knn, "HELD_ROWS", 100)
    assert {tuple(r) for r in knn.knn(c, c, 4).collect()} == want


@pytest.mark.parametrize("name", ["r13_degenerate", "r12_align_constrained", "r14_map_prior", "r23_annealing", "r5_align_gicp", "r16_align_levenberg", "r6_align_genz", "r4_align_distribution"])
def test_alignments_by_tree(spark, no_products, name):
    """Each iteration compared all pairs up to 20000 targets, and shuffled both sides beyond; what the
    session kept for an alignment stayed."""
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    r = catalog.QUERIES[name](spark, SMALL).first()
    assert r["converged"] and r["inlier"] == 500
    got = np.array([[r[f"t{i}{j}"] for j in range(4)] for i in range(3)])
    assert np.abs(got - catalog.TRUE_POSE[:3]).max() < 1e-3
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept


@pytest.mark.parametrize("parts", [(1 << 13, 1 << 17), (100, 70)])
def test_brute_force_in_blocks(spark, monkeypatch, parts):
    """j2: a row for each pair was ranked; 100000 rows have 10^10."""
    monkeypatch.setattr(knn, "BRUTE_QUERIES", parts[0])
    monkeypatch.setattr(knn, "BRUTE_TARGETS", parts[1])
    got = catalog.QUERIES["j2_brute_force"](spark, SMALL)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    q, t = (catalog.views.cloud_emb(spark, SMALL, first).orderBy("point_id").toPandas() for first in (0, 3))
    want = all_pairs(q[list("xyz")].to_numpy(), t[list("xyz")].to_numpy(), t.point_id.to_numpy(), 5)
    rows = {(r["query_id"], r["rank"]): (r["nbr_id"], r["dist_sq"]) for r in got.collect()}
    assert rows == {(i, k + 1): x for i, w in zip(q.point_id.tolist(), want) for k, x in enumerate(zip(*w))}


def test_nearest_holds_no_table_of_pairs():
    """t15, t16: frames of an odometry, whose first target is a whole frame."""
    import tracemalloc

    from pointloom.operators import registration as reg

    t = np.random.default_rng(3).normal(size=(20000, 3))
    tracemalloc.start()
    at, dist = reg.nearest(t + 1e-3, t, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    some = np.arange(0, 20000, 997)
    want = near.squared(t[some] + 1e-3, t)
    assert (at[some] == np.argsort(want, axis=1, kind="stable")[:, :2]).all() and (dist[some] == np.sort(want, axis=1)[:, :2]).all()


def test_frame_problem_holds_no_table_of_pairs():
    """t16: the inertial alignment matches through the same problem, each iteration against one tree."""
    import tracemalloc

    from pointloom.operators import registration as reg

    t = reg.Cloud(np.random.default_rng(4).normal(size=(20000, 3)))
    problem = reg.FrameProblem(t, t, reg.Params(reg_type=reg.RegType.POINT_TO_POINT))
    tracemalloc.start()
    r = problem.linearize(np.eye(4), 1.0, 1.0)
    tree = problem.tree
    problem.linearize(np.eye(4), 1.0, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert r.inlier == 20000 and r.error == 0 and problem.tree is tree and peak < 100e6


def test_preintegration_side_by_side(spark):
    """t2: one Python fold a window took a step in Python for each sample; 6 million have to be done."""
    from pointloom.functions import lie
    from pointloom.operators import imu

    rng, params = np.random.default_rng(5), imu.ImuParams(gyro_noise=1e-3, accel_noise=1e-2)
    rows = [(s, w, float(ts), *rng.normal(size=6).tolist()) for s in range(3) for w, n in enumerate((1, 2, 150, 3000, 4)) for ts in rng.permutation(n) * 0.01]
    df = spark.createDataFrame(rows, "stream_id long, window_id long, ts double, " + ", ".join(f"{a} double" for a in imu.AXES))
    made = imu.preintegrate(df, params=params)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    got = {(r["stream_id"], r["window_id"]): r for r in made.collect()}
    assert len(got) == 15
    for key, r in got.items():
        one = imu.Preintegration(params)
        one.extend(np.array(sorted(x[2:] for x in rows if x[:2] == key)))
        for a, b in zip((r["dt"], r["q"], r["v"], r["p"], r["covariance"]), (one.state.dt, lie.rotation_to_quaternion(one.state.R), one.state.v, one.state.p, one.state.covariance.ravel())):
            assert np.allclose(a, b, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("most", [None, 4])
@pytest.mark.parametrize("other", [False, True])
def test_radius_by_regions(spark, monkeypatch, most, other):
    """j4: each query went to 27 cells on disk, and each pair was ranked; copies and groups are kept."""
    rng = np.random.default_rng(6)
    rows = [(int(g), i, *(float(v) for v in p)) for i, (g, p) in enumerate(zip(rng.integers(0, 3, 1500), np.floor(rng.normal(size=(1500, 3)) * 8) / 4))]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")
    monkeypatch.setattr(knn, "REGION_ROWS", 60)
    made = knn.radius_search(df.where("point_id < 700") if other else df, df, 0.5, most, by=("frame_id",))
    assert "Generate" not in made._jdf.queryExecution().toString()
    x, g, ids = np.array([r[2:] for r in rows]), np.array([r[0] for r in rows]), np.arange(1500)
    want = {}
    for k in range(3):
        q = ids[(g == k) & (ids < (700 if other else 1500))]
        for i, w in zip(q.tolist(), all_pairs(x[q], x[g == k], ids[g == k], most or 1500, 0.25)):
            want |= {(k, i, r + 1): pair for r, pair in enumerate(zip(*w))}
    assert {(r["frame_id"], r["query_id"], r["rank"]): (r["nbr_id"], r["dist_sq"]) for r in made.collect()} == want


@pytest.fixture
def jobs(spark):
    """Runs f and gives back the number of its jobs."""

    def run(f):
        sc, group = spark.sparkContext, f"test-{id(f)}"
        sc.setJobGroup(group, "")
        try:
            f()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    return run


def _problem(spark, kind, **more):
    from pointloom.operators import registration as reg

    return reg.SparkProblem(*catalog._scene(spark, SMALL, kind), reg.Params(reg_type=kind, **more))


def test_iteration_is_one_job(spark, jobs):
    """r12: each iteration kept its pairs, planned a shuffle for 29 sums in two jobs or more."""
    from pointloom.operators import registration as reg

    problem = _problem(spark, reg.RegType.GICP, rotation_constraint=True)
    first = problem.linearize(np.eye(4), 1.0, 1.0)
    assert jobs(lambda: problem.linearize(catalog.TRUE_POSE, 1.0, 1.0)) == 1
    problem.release()
    src, tgt = (d.orderBy("point_id").toPandas() for d in catalog._scene(spark, SMALL, reg.RegType.GICP))
    clouds = [reg.Cloud(c[list("xyz")].to_numpy(), covariances_of(c)) for c in (src, tgt)]
    want = reg.FrameProblem(*clouds, problem.params).linearize(np.eye(4), 1.0, 1.0)
    assert np.allclose(first.H, want.H) and np.allclose(first.b, want.b) and first.error == pytest.approx(want.error) and first.inlier == want.inlier


def covariances_of(c):
    from pointloom.functions import expr as E
    from pointloom.functions import lie

    return lie.symmetric(c[list(E.COV)].to_numpy())


def test_prior_aligns_one_problem(spark, monkeypatch):
    """r14: both alignments collected, cut and sent the same targets."""
    held, real = [], knn.hold
    monkeypatch.setattr(knn, "hold", lambda *a, **b: held.append(1) or real(*a, **b))
    r = catalog.QUERIES["r14_map_prior"](spark, SMALL).first()
    assert r["converged"] and r["inlier"] == 500 and len(held) == 1


def test_annealing_runs_few_jobs(spark, jobs):
    """r23: both levels go over the same blocks; each of their iterations took three jobs."""
    from pointloom.operators import registration as reg

    steps, real = [], reg.SparkProblem.linearize
    with pytest.MonkeyPatch.context() as m:
        m.setattr(reg.SparkProblem, "linearize", lambda *a: steps.append(1) or real(*a))
        n = jobs(lambda: catalog.QUERIES["r23_annealing"](spark, SMALL))
    assert len(steps) >= 2 and n <= len(steps) + 6


def test_annealing_starts_and_ends_small(spark, jobs):
    """r23 at 0.1 GB is nearly all fixed cost: rows of the source were counted in jobs of their own, an iteration went through
    two Python workers a task, each of which loaded pandas, and the one row of the result took a task a core."""
    import subprocess
    import sys

    from pointloom.operators import registration as reg

    steps, passes, real, each = [], [], reg.SparkProblem.linearize, reg._each
    with pytest.MonkeyPatch.context() as m:
        m.setattr(reg.SparkProblem, "linearize", lambda *a: steps.append(1) or real(*a))
        m.setattr(reg, "_each", lambda *a: passes.append(1) or each(*a))
        got = []
        n = jobs(lambda: got.append(catalog.QUERIES["r23_annealing"](spark, SMALL)))
    assert len(steps) >= 2 and n <= len(steps) + 4 and len(passes) == len(steps)
    assert got[0].rdd.getNumPartitions() == 1 and got[0].count() == 1
    loads = "import sys, pointloom.operators.registration; sys.exit('pandas' in sys.modules)"
    assert not subprocess.run([sys.executable, "-c", loads]).returncode


@pytest.mark.parametrize("held", [True, False])
def test_align_without_rows(spark, monkeypatch, held):
    """r23: by a tree, whether the source has rows is asked only if nothing is met; without any the guess comes back."""
    from pointloom.operators import registration as reg

    if not held:
        monkeypatch.setattr(knn, "HELD_ROWS", 100)
    asked, real = [], reg.SparkProblem.empty
    monkeypatch.setattr(reg.SparkProblem, "empty", lambda self: asked.append(1) or real(self))
    src, tgt = catalog._scene(spark, SMALL, reg.RegType.POINT_TO_POINT)
    p = reg.Params(reg_type=reg.RegType.POINT_TO_POINT, loss=reg.Loss.GEMAN_MCCLURE)
    levels = reg.PipelineParams(sampling=False, auto_scale=True, levels=2)
    none = reg.register(src.where("false"), tgt, p, catalog.TRUE_POSE, levels)
    assert not none.converged and not none.inlier and (none.T == catalog.TRUE_POSE).all() and len(asked) == 1
    if held:
        far = reg.register(src.withColumn("x", src.x + 1e6), tgt, p, None, levels)
        assert far.converged and not far.inlier and (far.T == np.eye(4)).all() and len(asked) == 2
        assert reg.register(src, tgt, p, None, levels).inlier == 500 and len(asked) == 2


def test_covariances_without_pairs(spark):
    """r5: a row for each neighbour was shuffled twice and joined for nine sums; rows without a place or an id keep the identity."""
    from pointloom.functions import expr as E
    from pointloom.operators import features

    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(300, 3)) * 4) / 4
    rows = [(int(i), *map(float, p), "r") for i, p in enumerate(x)] + [(300, float("nan"), 0.0, 0.0, "r"), (301, None, 0.0, 0.0, None), (None, 0.0, 0.0, 0.0, "r")]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, kept string")
    made = features.covariances(df, 6)
    plan = made._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan and made.columns == [*df.columns, *E.COV]
    got = {r["point_id"]: r for r in made.collect()}
    assert len(got) == 303 and all(tuple(got[i][c] for c in E.COV) == (1, 0, 0, 1, 0, 1) for i in (300, 301, None)) and got[301]["kept"] is None
    for i, (at, _) in enumerate(all_pairs(x, x, np.arange(300), 6)):
        want = np.cov(x[at].T, bias=True)
        assert np.allclose([got[i][c] for c in E.COV], want[[0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]], atol=1e-12)
    few = features.covariances(df.where("point_id < 3"), 6).first()
    assert tuple(few[c] for c in E.COV) == (1, 0, 0, 1, 0, 1)
    assert features.covariances(df.where("false"), 6).count() == 0


@pytest.mark.parametrize("name, most", [("r16_align_levenberg", 1), ("r5_align_gicp", 2)])
def test_features_that_a_type_needs(spark, monkeypatch, name, most):
    """r16: neighbours of every source point were found for covariances that only GICP reads."""
    made, real = [], catalog.features.covariances
    monkeypatch.setattr(catalog.features, "covariances", lambda *a, **b: made.append(1) or real(*a, **b))
    assert catalog.QUERIES[name](spark, SMALL).first()["converged"] and len(made) == most


@pytest.mark.parametrize("loss", ["NONE", "CAUCHY"])
def test_planar_share_in_the_same_pass(spark, jobs, loss):
    """r6: pairs were kept and gone over twice, for the share of planar partners and for the sums it weighs."""
    from pointloom.operators import registration as reg

    p = reg.Params(reg_type=reg.RegType.GENZ, loss=reg.Loss[loss], rotation_constraint=True, planarity=0.05)
    src, tgt = catalog._scene(spark, SMALL, reg.RegType.GENZ, True)
    problem, out = reg.SparkProblem(src, tgt, p), []
    problem.linearize(catalog.TRUE_POSE, 1.0, 1.0)
    assert jobs(lambda: out.append(problem.linearize(np.eye(4), 1.0, 1.0))) == 1
    problem.release()
    a, b = (d.orderBy("point_id").toPandas() for d in (src, tgt))
    clouds = [reg.Cloud(c[list("xyz")].to_numpy(), covariances_of(c)) for c in (a, b)]
    clouds[1].normal = b[["nx", "ny", "nz"]].to_numpy()
    frame = reg.FrameProblem(*clouds, p)
    want, got = frame.linearize(np.eye(4), 1.0, 1.0), out[0]
    assert 0 < frame.alpha < 1 and problem.alpha == pytest.approx(frame.alpha)
    assert np.allclose(got.H, want.H) and np.allclose(got.b, want.b) and got.error == pytest.approx(want.error) and got.inlier == want.inlier


def test_blocks_hold_what_factors_read(spark):
    """r4: source covariances went along through every iteration, though only the target's enter."""
    from pointloom.operators import registration as reg

    for kind, turned in ((reg.RegType.POINT_TO_DISTRIBUTION, False), (reg.RegType.POINT_TO_DISTRIBUTION, True), (reg.RegType.GICP, False)):
        src, tgt = catalog._scene(spark, SMALL, kind, True)
        problem = reg.SparkProblem(src, tgt, reg.Params(reg_type=kind, rotation_constraint=turned))
        r = problem.linearize(np.eye(4), 1.0, 1.0)
        packed = reg._collected(problem.blocks)
        problem.release()
        assert r.inlier > 0 and sum(len(c) for c in packed) == 500
        assert all((c.cov is not None) == (turned or kind is reg.RegType.GICP) for c in packed)
