"""Registered queries of the point-set operators, and their SQL. A query without SQL has no SQL
equivalent (eigenvectors, traversals, iterated solves, samplers by hash); tests cover it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie, udfs
from ..operators import features, filters, imu, knn, maps, sampling, transform, voxel
from ..operators import deskew as dsk
from ..operators import registration as reg
from ..session import new_path
from ..sources import points, sensors
from . import odometry, views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = "CAST(floor({x}*{inv}) AS BIGINT) + 1048576 + ((CAST(floor({y}*{inv}) AS BIGINT) + 1048576) << 21) + ((CAST(floor({z}*{inv}) AS BIGINT) + 1048576) << 42)"
D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"
#: A quarter turn about z and a shift: exact in binary.
QUARTER = np.array([[0.0, -1, 0, 0.5], [1, 0, 0, -0.25], [0, 0, 1, 2], [0, 0, 0, 1]])
FINITE = "x = x"


def key_sql(size: float, t: str = "") -> str:
    return KEY.format(inv=f"{1 / size!r}e0" if 1 / size != int(1 / size) else f"{int(1 / size)}e0", x=t + "x", y=t + "y", z=t + "z")


def query(name: str, oracle: str | None = None, use: str = ""):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = with_views(use, oracle) if use else oracle
        return f

    return keep


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Filters ------------------------------------------------------------------------------------------


@query("f1_finite", "SELECT * FROM li", "li")
def f1(s, d):
    return filters.finite_filter(views.cloud_li(s, d))


@query("f2_box_filter", "SELECT * FROM li WHERE greatest(abs(x), abs(y), abs(z)) BETWEEN 4 AND 40", "li")
def f2(s, d):
    return filters.box_filter(views.cloud_li(s, d), 4.0, 40.0)


@query(
    "f3_angle_incidence",
    "SELECT frame_id, point_id, x, y, z FROM emb WHERE sqrt(x*x+y*y+z*z) > 1e-6 AND abs(z)/sqrt(x*x+y*y+z*z) BETWEEN cos(1.2e0) AND cos(0.3e0)",
    "emb",
)
def f3(s, d):
    up = views.cloud_emb(s, d).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    return filters.angle_filter(up, 0.3, 1.2).drop(*E.NORMAL)


@query("f4_compact", "SELECT frame_id, max(intensity) AS end_time_ms, count(*) AS n FROM li WHERE z > 0.5 GROUP BY 1", "li")
def f4(s, d):
    kept = filters.compact(views.cloud_li(s, d), F.col("z") > 0.5).withColumn("t_offset_ms", F.col("intensity"))
    frames = kept.select("frame_id").distinct().withColumn("start_time_ms", F.lit(0.0))
    n = kept.groupBy("frame_id").agg(F.count("*").alias("n"))
    return filters.frame_times(kept, frames).join(n, "frame_id").select("frame_id", "end_time_ms", "n")


@query(
    "f5_index_remap",
    "SELECT frame_id, point_id, CAST(CASE WHEN z > 0.5 THEN sum(CASE WHEN z > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY point_id ROWS UNBOUNDED PRECEDING) - 1 ELSE -1 END AS BIGINT) AS new_index FROM li",
    "li",
)
def f5(s, d):
    return filters.index_remap(views.cloud_li(s, d), F.col("z") > 0.5)


_KNN = f", p AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, {D2} AS dist_sq FROM emb a CROSS JOIN emb b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, nbr_id) AS rank FROM p) "


@query(
    "f6_statistical_outliers",
    _KNN + ", m AS (SELECT query_id, avg(dist_sq) AS v FROM k WHERE rank <= 8 GROUP BY 1), t AS (SELECT avg(v) + 1.0 * stddev_pop(v) AS lim FROM m) SELECT frame_id, point_id, x, y, z FROM emb JOIN m ON query_id = point_id CROSS JOIN t WHERE v <= lim",
    "emb",
)
def f6(s, d):
    return knn.statistical_outliers(views.cloud_emb(s, d), 8, 1.0)


@query("f7_radius_outliers", _KNN + "SELECT frame_id, point_id, x, y, z FROM emb JOIN k ON query_id = point_id WHERE rank = 6 AND dist_sq <= 1.5", "emb")
def f7(s, d):
    return knn.radius_outliers(views.cloud_emb(s, d), 5, 1.5)


@query("f8_valid_points", "SELECT count(*) AS n_valid FROM li", "li")
def f8(s, d):
    return filters.valid_points(views.cloud_li(s, d))


# Samplers -----------------------------------------------------------------------------------------


@query("k1_uniform_sample")
def k1(s, d):
    return sampling.uniform_sample(views.cloud_li(s, d), 1000)


@query("k2_weighted_sample")
def k2(s, d):
    return sampling.weighted_sample(views.cloud_li(s, d), 1000, "intensity")


@query("k3_mixed_sample")
def k3(s, d):
    return sampling.mixed_sample(views.cloud_li(s, d), 1000, "intensity", 0.8)


@query("k4_farthest_points")
def k4(s, d):
    return sampling.farthest_sample(views.cloud_emb(s, d), 16)


@query("k7_registration_sample")
def k7(s, d):
    li = views.cloud_li(s, d)
    p = reg.PipelineParams(by_intensity=True)
    return sampling.mixed_sample(li, p.sample, "intensity", p.weighted_ratio)


# Grouping -----------------------------------------------------------------------------------------


@query("g1_voxel_key", f"SELECT point_id, {key_sql(0.5)} AS key FROM li", "li")
def g1(s, d):
    return views.cloud_li(s, d).select("point_id", E.voxel_key(0.5).alias("key"))


_POLAR = "floor(sqrt(x*x+y*y+z*z)*(1/{r}e0)) AS br, floor(atan2(z, sqrt(x*x+y*y))*(1/{e}e0)) AS be, floor(atan2(y, x)*(1/{e}e0)) AS ba"


@query("g2_polar_key", "SELECT point_id, CAST(br AS BIGINT) AS br, CAST(be AS BIGINT) AS be, CAST(ba AS BIGINT) AS ba FROM (SELECT point_id, " + _POLAR.format(r=2, e=0.25) + " FROM li)", "li")
def g2(s, d):
    li = views.cloud_li(s, d)
    return li.select("point_id", *(c.alias(n) for c, n in zip(voxel.polar_bins(li, 2.0, 0.25, 0.25), ("br", "be", "ba"))))


@query("g3_voxel_grid", f"SELECT frame_id, {key_sql(4)} AS key, avg(x) AS x, avg(y) AS y, avg(z) AS z, median(intensity) AS intensity, count(*) AS n FROM (SELECT * FROM li WHERE greatest(abs(x), abs(y), abs(z)) BETWEEN 4 AND 90) GROUP BY 1, 2 HAVING count(*) >= 2", "li")
def g3(s, d):
    return voxel.voxel_downsample(filters.box_filter(views.cloud_li(s, d), 4.0, 90.0), 4.0, 2)


@query(
    "g4_polar_grid",
    "SELECT frame_id, (CAST(br AS BIGINT) + 1048576) + ((CAST(be AS BIGINT) + 1048576) << 21) + ((CAST(ba AS BIGINT) + 1048576) << 42) AS key, avg(x) AS x, avg(y) AS y, avg(z) AS z, median(intensity) AS intensity, count(*) AS n FROM (SELECT *, " + _POLAR.format(r=2, e=0.25) + " FROM li) GROUP BY 1, 2",
    "li",
)
def g4(s, d):
    return voxel.polar_downsample(views.cloud_li(s, d), 2.0, 0.25, 0.25)


@query("g5_median", "SELECT frame_id, median(intensity) AS intensity FROM li GROUP BY 1", "li")
def g5(s, d):
    return views.cloud_li(s, d).groupBy("frame_id").agg(F.median("intensity").alias("intensity"))


@query("g6_prefix_sum", "SELECT frame_id, point_id, CAST(sum(CASE WHEN intensity > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM li", "li")
def g6(s, d):
    return voxel.inclusive_scan(views.cloud_li(s, d), F.col("intensity") > 1).select("frame_id", "point_id", "scan")


@query("g8_reductions", "SELECT sum(x) AS sx, max(y) AS my, count(*) FILTER (z > 0.5) AS nz FROM li", "li")
def g8(s, d):
    return views.cloud_li(s, d).agg(F.sum("x").alias("sx"), F.max("y").alias("my"), F.count_if(F.col("z") > 0.5).alias("nz"))


@query(
    "g9_reflectivity",
    ", m AS (SELECT frame_id, ring, avg(intensity*4) AS m_ref, avg(ambient/4) AS m_amb FROM ring WHERE ring < 256 GROUP BY 1, 2) SELECT point_id, round(CASE WHEN ring.ring >= 256 THEN 0e0 ELSE greatest(0e0, least(10e0, CASE WHEN m_ref > 0 THEN intensity*4/m_ref ELSE 0e0 END + CASE WHEN m_amb > 0 THEN ambient/4/m_amb ELSE 0e0 END)) END, 6) AS reflectivity FROM ring LEFT JOIN m ON ring.frame_id = m.frame_id AND ring.ring = m.ring",
    "ring",
)
def g9(s, d):
    r = views.ring_view(s, d)
    return _r6(voxel.enhanced_reflectivity(r, voxel.ring_means(r)).select("point_id", "reflectivity"), "reflectivity")


@query(
    "g9_ring_ema",
    ", m AS (SELECT frame_id, ring, avg(intensity*4) AS r, avg(ambient/4) AS a FROM ring WHERE ring >= 0 AND ring < 256 GROUP BY 1, 2), l AS (SELECT frame_id, ring, list(r) OVER w AS rs, list(a) OVER w AS xs FROM m WINDOW w AS (PARTITION BY ring ORDER BY frame_id ROWS UNBOUNDED PRECEDING)) SELECT frame_id, ring, round(list_reduce(rs, lambda o, n: 0.75e0*o + 0.25e0*n), 6) AS m_ref, round(list_reduce(xs, lambda o, n: 0.75e0*o + 0.25e0*n), 6) AS m_amb FROM l",
    "ring",
)
def g9e(s, d):
    return _r6(voxel.smooth_rings(voxel.ring_means(views.ring_view(s, d)), 0.25), "m_ref", "m_amb")


# Joins --------------------------------------------------------------------------------------------

_TOP = "SELECT query_id, CAST(rank AS INT) AS rank, nbr_id, dist_sq FROM k WHERE rank <= {k}"


@query("j1_knn", _KNN + _TOP.format(k=10), "emb")
def j1(s, d):
    e = views.cloud_emb(s, d)
    return knn.knn(e, e, 10)


@query("j2_brute_force", f", p AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, {D2} AS dist_sq FROM emb a CROSS JOIN emb2 b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, nbr_id) AS rank FROM p) " + _TOP.format(k=5), "emb emb2")
def j2(s, d):
    return knn.brute_knn(views.cloud_emb(s, d), views.cloud_emb(s, d, 3), 5)


@query("j3_grid_knn", _KNN + _TOP.format(k=5), "emb")
def j3(s, d):
    e = views.cloud_emb(s, d)
    return knn.grid_knn(e, e, 5)


@query(
    "j4_radius",
    f", p AS (SELECT a.frame_id, a.point_id AS query_id, b.point_id AS nbr_id, {D2} AS dist_sq FROM li a JOIN li b ON a.frame_id = b.frame_id AND a.x = b.x AND b.y BETWEEN a.y - 0.25 AND a.y + 0.25), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, query_id ORDER BY dist_sq, nbr_id) AS rank FROM p WHERE dist_sq <= 0.0625) SELECT frame_id, query_id, CAST(rank AS INT) AS rank, nbr_id, dist_sq FROM k WHERE rank <= 5",
    "li",
)
def j4(s, d):
    li = views.cloud_li(s, d)
    return knn.radius_search(li, li, 0.25, 5, by=("frame_id",))


@query("j7_delete", f", p AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, {D2} AS dist_sq FROM emb a CROSS JOIN (SELECT * FROM emb WHERE x >= 0) b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, nbr_id) AS rank FROM p) " + _TOP.format(k=3), "emb")
def j7(s, d):
    e = views.cloud_emb(s, d)
    return knn.knn(e, knn.without(e, e.where("x < 0")), 3)


_MOVED = "(SELECT point_id, 0.5 - y AS x, x - 0.25 AS y, z + 2 AS z, x AS px, y AS py, z AS pz FROM emb)"


@query("j8_correspondence", f", p AS (SELECT a.point_id AS query_id, b.point_id AS nbr_id, {D2} AS dist_sq FROM {_MOVED} a CROSS JOIN emb2 b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, nbr_id) AS rank FROM p) SELECT query_id, nbr_id, dist_sq FROM k WHERE rank = 1 AND dist_sq <= 4", "emb emb2")
def j8(s, d):
    return knn.correspondences(views.cloud_emb(s, d), views.cloud_emb(s, d, 3), QUARTER, 2.0)


@query("j9_voxel_probe", f"SELECT a.point_id FROM li a WHERE {key_sql(2, 'a.')} IN (SELECT {key_sql(2)} FROM li GROUP BY 1 HAVING count(*) >= 40)", "li")
def j9(s, d):
    li = views.cloud_li(s, d)
    known = maps.voxel_fold(li, 2.0).where("n >= 40").select("key")
    return li.withColumn("key", E.voxel_key(2.0)).join(known, "key", "left_semi").select("point_id")


def _occupancy(s, d) -> tuple[DataFrame, maps.OccupancyParams]:
    p = maps.OccupancyParams(size=2.0, hit=0.5, miss=-0.03125, carve=False)
    return maps.occupancy_insert(maps.empty_map(s, True), views.cloud_li(s, d), 1, p), p


@query("j10_point_query", f", m AS (SELECT {key_sql(2)} AS key, least(4e0, 0.5e0*count(*)) AS lo FROM li GROUP BY 1) SELECT point_id, round(coalesce(1/(1+exp(-lo)), 0.5e0), 6) AS probability FROM emb LEFT JOIN m ON key = {key_sql(2)}", "li emb")
def j10(s, d):
    state, p = _occupancy(s, d)
    return _r6(maps.query_probability(state, views.cloud_emb(s, d), p).select("point_id", "probability"), "probability")


@query("j11_ray_cells")
def j11(s, d):
    zero = [F.lit(0.0)] * 3
    return views.cloud_emb(s, d).select("point_id", F.explode(udfs.ray_keys_udf(0.5)(*zero, *E.XYZ)).alias("key"))


@query("j12_occlusion")
def j12(s, d):
    p = maps.OccupancyParams(size=1.0, hit=0.5, miss=-0.03125, carve=False)
    state = maps.occupancy_insert(maps.empty_map(s, True), views.cloud_emb(s, d), 1, p)
    return maps.visible_points(state, np.eye(4), 100.0, np.pi, 2 * np.pi, p)


_DAYS = "(SELECT DISTINCT stream_id, CAST(floor(ts/86400) AS BIGINT) AS window_id, floor(ts/86400)*86400 AS t0, floor(ts/86400)*86400 + 86400 AS t1 FROM imu)"


def _days(rows: DataFrame) -> DataFrame:
    day = F.floor(F.col("ts") / 86400)
    return rows.select("stream_id", day.cast("long").alias("window_id"), (day * 86400).cast("double").alias("t0"), (day * 86400 + 86400).cast("double").alias("t1")).distinct()


@query(
    "j13_imu_window",
    f""", b AS {_DAYS}, n AS (SELECT *, lead(ts) OVER w AS nt, lead(gx) OVER w AS nx FROM imu WINDOW w AS (PARTITION BY stream_id ORDER BY ts)), r AS (
    SELECT n.stream_id, window_id, ts, gx, 'sample' AS kind FROM n JOIN b ON n.stream_id = b.stream_id AND ts > t0 AND ts <= t1
    UNION ALL SELECT n.stream_id, window_id, t0, gx + (t0 - ts)/(nt - ts)*(nx - gx), 'start' FROM n JOIN b ON n.stream_id = b.stream_id AND ts <= t0 AND t0 < nt
    UNION ALL SELECT n.stream_id, window_id, t1, gx + (t1 - ts)/(nt - ts)*(nx - gx), 'end' FROM n JOIN b ON n.stream_id = b.stream_id AND ts < t1 AND t1 < nt)
    SELECT stream_id, window_id, ts, round(gx, 6) AS gx, kind FROM r""",
    "imu",
)
def j13(s, d):
    rows = views.imu_view(s, d)
    return _r6(imu.windows(rows, _days(rows)).select("stream_id", "window_id", "ts", "gx", "kind"), "gx")


@query(
    "j14_pose_asof",
    """, t AS (SELECT DISTINCT stream_id, floor(ts/3600)*3600 AS ts FROM scan), n AS (SELECT stream_id, ts, lead(ts) OVER (PARTITION BY stream_id ORDER BY ts) AS nt FROM t)
    SELECT s.stream_id, point_id, round(CASE WHEN nt IS NULL THEN n.ts/3600 ELSE n.ts/3600 + (s.ts - n.ts)/(nt - n.ts)*(nt/3600 - n.ts/3600) END, 6) AS tx FROM scan s ASOF JOIN n ON s.stream_id = n.stream_id AND s.ts >= n.ts""",
    "scan",
)
def j14(s, d):
    rows = views.scan_stream(s, d)
    hour = (F.floor(F.col("ts") / 3600) * 3600).cast("double")
    path = rows.select("stream_id", hour.alias("ts")).distinct().select("stream_id", "ts", (F.col("ts") / 3600).alias("tx"), *(F.lit(v).alias(c) for c, v in zip(dsk.POSE[1:], (0.0, 0.0, 0.0, 0.0, 0.0, 1.0))))
    return _r6(dsk.interpolate_poses(rows, path).select("stream_id", "point_id", "tx"), "tx")


# Projections --------------------------------------------------------------------------------------


@query("p1_transform", "SELECT point_id, 0.5 - y AS x, x - 0.25 AS y, z + 2 AS z FROM li", "li")
def p1(s, d):
    return transform.transform_points(views.cloud_li(s, d), QUARTER).select("point_id", *E.XYZ)


@query("p3_vector_algebra", "SELECT point_id, x*y + y*z + z*x AS d, y*x - z*z AS cx, z*y - x*x AS cy, x*z - y*y AS cz, round(CASE WHEN sqrt(x*x+y*y+z*z) < 1e-6 THEN 0e0 ELSE x/sqrt(x*x+y*y+z*z) END, 6) AS ux FROM emb", "emb")
def p3(s, d):
    a, b = [F.col(c) for c in "xyz"], [F.col(c) for c in "yzx"]
    c = E.cross(a, b)
    return _r6(views.cloud_emb(s, d).select("point_id", E.dot(a, b).alias("d"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), E.normalize(a)[0].alias("ux")), "ux")


@query(
    "p4_inverse",
    ", m AS (SELECT point_id, x*x + 1 AS a, x*y AS b, x*z AS c, y*y + 1 AS e, y*z AS f, z*z + 1 AS i FROM emb), t AS (SELECT *, a*(e*i - f*f) + b*(f*c - b*i) + c*(b*f - e*c) AS det FROM m) SELECT point_id, det, round((e*i - f*f)/det, 6) AS i00, round((c*f - b*i)/det, 6) AS i01, round((a*e - b*b)/det, 6) AS i22 FROM t",
    "emb",
)
def p4(s, d):
    v = [F.col(c) for c in E.XYZ]
    m = [[x + E.lit(i == j) for j, x in enumerate(row)] for i, row in enumerate(E.outer(v, v))]
    inv = E.inverse(m)
    return _r6(views.cloud_emb(s, d).select("point_id", E.det(m).alias("det"), inv[0][0].alias("i00"), inv[0][1].alias("i01"), inv[2][2].alias("i22")), "i00", "i01", "i22")


# Covariances of ten neighbours and, in closed form, their eigenvalues and the projector on the first axis.
_COV = _KNN + ", c AS (SELECT query_id AS point_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz FROM k JOIN emb e ON e.point_id = nbr_id WHERE rank <= 10 GROUP BY 1), v AS (SELECT point_id, xx/n - sx/n*(sx/n) AS cxx, xy/n - sx/n*(sy/n) AS cxy, xz/n - sx/n*(sz/n) AS cxz, yy/n - sy/n*(sy/n) AS cyy, yz/n - sy/n*(sz/n) AS cyz, zz/n - sz/n*(sz/n) AS czz FROM c) "
_EIG = (
    _COV
    + ", q1 AS (SELECT *, (cxx + cyy + czz)/3 AS q FROM v), q2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q) + (cyy-q)*(cyy-q) + (czz-q)*(czz-q) + 2*(cxy*cxy + cxz*cxz + cyz*cyz))/6) AS p FROM q1)"
    + ", q3 AS (SELECT *, CASE WHEN p < 1e-12 THEN 1e0 ELSE greatest(-1e0, least(1e0, ((cxx-q)*((cyy-q)*(czz-q) - cyz*cyz) - cxy*(cxy*(czz-q) - cyz*cxz) + cxz*(cxy*cyz - (cyy-q)*cxz))/(2*p*p*p))) END AS r FROM q2)"
    + ", q4 AS (SELECT *, q + 2*p*cos(acos(r)/3) AS l2, q + 2*p*cos(acos(r)/3 + 2*pi()/3) AS l0 FROM q3), g AS (SELECT *, 3*q - l0 - l2 AS l1 FROM q4)"
    + ", e AS (SELECT *, "
    + ", ".join(f"(({' + '.join(f'c{min(i, k)}{max(i, k)}*c{min(k, j)}{max(k, j)}' for k in 'xyz')}) - (l1 + l2)*c{i}{j}{' + l1*l2' if i == j else ''})/((l0 - l1)*(l0 - l2)) AS n{i}{j}" for i, j in ("xx", "xy", "xz", "yy", "yz", "zz"))
    + " FROM g) "
)
_AXIS = ", ".join(f"round(n{c}, 3) + 0e0 AS n{c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz"))


def _axis(x: F.Column, y: F.Column, z: F.Column) -> list[F.Column]:
    """The products of an axis' components, which do not depend on its sign."""
    a = dict(zip("xyz", (x, y, z)))
    return [(F.round(a[i] * a[j], 3) + F.lit(0.0)).alias(f"n{i}{j}") for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")]


def _r(n: int, *cols: str) -> list[F.Column]:
    """Rounded, off the middle between two results, and without a negative zero."""
    return [(F.round(F.col(c) + F.lit(1e-7), n) + F.lit(0.0)).alias(c) for c in cols]


def _sql_r(n: int, expr: str) -> str:
    return f"round({expr} + 1e-7, {n}) + 0e0"


@query("p5_eigen", _EIG + "SELECT point_id, " + ", ".join(f"{_sql_r(4, c)} AS {c}" for c in ("l0", "l1", "l2")) + ", " + _AXIS + " FROM e", "emb")
def p5(s, d):
    c = features.covariances(views.cloud_emb(s, d), 10)
    e = c.select("point_id", udfs.eigen3()(*E.COV).alias("e")).select("point_id", "e.*")
    return e.select("point_id", *_r(4, "l0", "l1", "l2"), *_axis(*(F.col(f"v0{j}") for j in range(3))))


@query("p7_spd_log_exp", _EIG + f"SELECT point_id, {_sql_r(3, 'ln(l0) + ln(l1) + ln(l2)')} AS log_trace, " + ", ".join(f"{_sql_r(4, c)} AS {c}" for c in E.COV) + " FROM e", "emb")
def p7(s, d):
    """The logarithm's trace, and the matrix that its exponential gives back."""
    log = udfs.apply_matrix(features.covariances(views.cloud_emb(s, d), 10), "log_spd3")
    log = log.withColumn("log_trace", F.col("cxx") + F.col("cyy") + F.col("czz"))
    return udfs.apply_matrix(log, "exp_spd3").select("point_id", *_r(3, "log_trace"), *_r(4, *E.COV))


@query("p9_so3_exp", ", r AS (SELECT point_id, x/8 AS x, y/8 AS y, z/8 AS z, sqrt(x*x+y*y+z*z)/8 AS t FROM emb) SELECT point_id, round(CASE WHEN t < 1e-8 THEN 1e0 ELSE 1 - (1-cos(t))/(t*t)*(y*y+z*z) END, 6) AS r00, round(CASE WHEN t < 1e-8 THEN 0e0 ELSE -sin(t)/t*z + (1-cos(t))/(t*t)*x*y END, 6) AS r01 FROM r", "emb")
def p9(s, d):
    r = E.so3_exp([F.col(c) / 8 for c in E.XYZ])
    return views.cloud_emb(s, d).select("point_id", F.round(r[0][0], 6).alias("r00"), F.round(r[0][1], 6).alias("r01"))


@query("p12_log_odds", "SELECT point_id, round(ln(p/(1-p)), 6) AS lo, round(1/(1+exp(-greatest(-4e0, least(4e0, y/16)))), 6) AS pr FROM (SELECT *, (x + 1)/64e0 AS p FROM li)", "li")
def p12(s, d):
    p = (F.col("x") + 1) / E.lit(64)
    return views.cloud_li(s, d).select("point_id", F.round(E.log_odds(p), 6).alias("lo"), F.round(E.probability(E.clamp(F.col("y") / 16, -4, 4)), 6).alias("pr"))


@query("p13_yaw", "SELECT point_id, round(CASE WHEN x*x + y*y < 1e-12 THEN 0e0 ELSE atan2(y, x) END, 6) AS yaw FROM emb", "emb")
def p13(s, d):
    return views.cloud_emb(s, d).select("point_id", F.round(E.yaw(F.col("x"), F.col("y")), 6).alias("yaw"))


# Neighbourhood features ---------------------------------------------------------------------------



@query("n1_covariance", _COV + "SELECT * FROM v", "emb")
def n1(s, d):
    return features.covariances(views.cloud_emb(s, d), 10).select("point_id", *E.COV)


@query("n2_robust_covariance")
def n2(s, d):
    return features.robust_covariances(views.cloud_emb(s, d), 10).select("point_id", *E.COV)


@query("n4_normals", _EIG + "SELECT point_id, " + _AXIS + ", true AS faces FROM e", "emb")
def n4(s, d):
    """Normals up to their sign, and whether each is turned as it must be: n . p is at most 1 where -n would be too."""
    n = features.normals(views.cloud_emb(s, d), 10)
    return n.select("point_id", *_axis(*(F.col(c) for c in E.NORMAL)), (E.dot([F.col(c) for c in E.NORMAL], [F.col(c) for c in E.XYZ]) <= 1).alias("faces"))


@query("n5_plane_regularization", _EIG + "SELECT point_id, " + ", ".join(f"{_sql_r(3, ('1 - ' if c[1] == c[2] else '-') + '0.999e0*n' + c[1:])} AS {c}" for c in E.COV) + " FROM e", "emb")
def n5(s, d):
    return udfs.apply_matrix(features.covariances(views.cloud_emb(s, d), 10), "plane_reg").select("point_id", *_r(3, *E.COV))


@query("n6_normalized_covariance", _EIG + "SELECT point_id, " + ", ".join(f"{_sql_r(3, f'{c}/l2 + greatest(1e-3 - l0/l2, 0e0)*n{c[1:]}')} AS {c}" for c in E.COV) + " FROM e", "emb")
def n6(s, d):
    """Only the smallest eigenvalue lies below a thousandth of the largest in these neighbourhoods, if any does."""
    return udfs.apply_matrix(features.covariances(views.cloud_emb(s, d), 10), "normalize_cov").select("point_id", *_r(3, *E.COV))


@query("n7_mahalanobis", _COV + ", t AS (SELECT v.*, x, y, z, cxx*(cyy*czz - cyz*cyz) + cxy*(cyz*cxz - cxy*czz) + cxz*(cxy*cyz - cyy*cxz) AS det FROM v JOIN emb USING (point_id)) SELECT point_id, round(CASE WHEN abs(det) < 1e-6 THEN 0e0 ELSE (x*x*(cyy*czz-cyz*cyz) + y*y*(cxx*czz-cxz*cxz) + z*z*(cxx*cyy-cxy*cxy) + 2*x*y*(cxz*cyz-cxy*czz) + 2*x*z*(cxy*cyz-cxz*cyy) + 2*y*z*(cxy*cxz-cxx*cyz))/det END, 3) AS m FROM t", "emb")
def n7(s, d):
    c = features.covariances(views.cloud_emb(s, d), 10)
    m = E.mahalanobis_sq([F.col(x) for x in E.XYZ], E.inverse(E.sym([F.col(x) for x in E.COV])))
    return c.select("point_id", F.round(m, 3).alias("m"))


@query("n8_intensity_correction", "SELECT point_id, round(greatest(0e0, least(50e0, intensity*power(sqrt(x*x+y*y+z*z)/16, 2e0)*0.5e0)), 6) AS intensity FROM li", "li")
def n8(s, d):
    return _r6(features.correct_intensity(views.cloud_li(s, d), 2.0, 0.0, 16.0, 0.5, 0.0, 50.0).select("point_id", "intensity"), "intensity")


def _lit_emb(s, d) -> DataFrame:
    return views.cloud_emb(s, d).withColumn("intensity", F.pmod(F.col("point_id"), F.lit(16)).cast("double"))


_GAUSS = """, e AS (SELECT *, CAST(point_id % 16 AS DOUBLE) AS i, sqrt(x*x+y*y+z*z) AS r, sqrt(x*x+y*y) AS f FROM emb), w AS (
SELECT q.point_id, q.i AS own, q.r, n.i, n.x-q.x AS dx, n.y-q.y AS dy, n.z-q.z AS dz, q.x/greatest(q.r,1e-6) AS rx, q.y/greatest(q.r,1e-6) AS ry, q.z/greatest(q.r,1e-6) AS rz,
CASE WHEN q.f<1e-6 THEN 1e0 ELSE -q.y/greatest(q.f,1e-6) END AS ax, CASE WHEN q.f<1e-6 THEN 0e0 ELSE q.x/greatest(q.f,1e-6) END AS ay, q.f AS f FROM k JOIN e q ON q.point_id = query_id JOIN e n ON n.point_id = nbr_id WHERE rank <= 10),
g AS (SELECT point_id, own, r, i, exp(-((dx*rx+dy*ry+dz*rz)*(dx*rx+dy*ry+dz*rz)/(2*1e0*1e0) + (dx*ax+dy*ay)*(dx*ax+dy*ay)/(2*0.5e0*0.5e0) + (CASE WHEN f<1e-6 THEN dy ELSE -dx*rz*ay + dy*rz*ax + dz*f/greatest(r,1e-6) END)*(CASE WHEN f<1e-6 THEN dy ELSE -dx*rz*ay + dy*rz*ax + dz*f/greatest(r,1e-6) END)/(2*0.25e0*0.25e0))) AS wt FROM w),
lm AS (SELECT point_id, CASE WHEN min(r) < 1e-6 THEN min(own) ELSE sum(wt*i)/sum(wt) END AS m, min(own) AS own FROM g GROUP BY 1) """


@query("n9_gaussian_smoothing", _KNN + _GAUSS + "SELECT point_id, round(m, 6) AS intensity FROM lm", "emb")
def n9(s, d):
    return _r6(features.smooth_intensity(_lit_emb(s, d), 10, 0.5, 0.25, 1.0).select("point_id", "intensity"), "intensity")


@query("n10_local_mean", _KNN + _GAUSS + "SELECT point_id, round(own/greatest(m, 0.5e0), 6) AS intensity FROM lm", "emb")
def n10(s, d):
    return _r6(features.normalize_by_local_mean(_lit_emb(s, d), 10, 0.5, 0.25, 1.0, 0.5).select("point_id", "intensity"), "intensity")


@query("n11_intensity_zscore", _KNN + ", z AS (SELECT query_id AS point_id, avg(CAST(nbr_id % 16 AS DOUBLE)) AS m, avg(CAST((nbr_id % 16)*(nbr_id % 16) AS DOUBLE)) AS q FROM k WHERE rank <= 8 GROUP BY 1) SELECT point_id, round(CASE WHEN sqrt(greatest(q - m*m, 0e0)) < 0.5 THEN 0e0 ELSE (point_id % 16 - m)/sqrt(greatest(q - m*m, 0e0)) END, 6) AS intensity FROM z", "emb")
def n11(s, d):
    return _r6(features.intensity_zscore(_lit_emb(s, d), 8, 0.5).select("point_id", "intensity"), "intensity")


@query("n12_planarity", _EIG + f"SELECT point_id, {_sql_r(4, 'l0/(l0 + l1 + l2)')} AS curvature, l0/(l0 + l1 + l2) < 0.2 AS planar, CASE WHEN l0/(l0 + l1 + l2) < 0.2 THEN 0.75e0 ELSE 0.25e0 END AS weight FROM e", "emb")
def n12(s, d):
    return features.planar(features.covariances(views.cloud_emb(s, d), 10)).select("point_id", *_r(4, "curvature"), "planar", features.genz_weight(F.col("planar"), E.lit(0.75)).alias("weight"))


# Registration -------------------------------------------------------------------------------------


def _pairs(s, d) -> DataFrame:
    """Each source point, moved by QUARTER, with its nearest target within 2."""
    src, tgt = views.cloud_emb(s, d), views.cloud_emb(s, d, 3)
    near = knn.correspondences(src, tgt, QUARTER, 2.0)
    a = src.select(F.col("point_id").alias("query_id"), *(F.col(c).alias(f"s{c}") for c in E.XYZ))
    b = tgt.select(F.col("point_id").alias("nbr_id"), *(F.col(c).alias(f"t{c}") for c in E.XYZ), F.lit(0.0).alias("tnx"), F.lit(0.6).alias("tny"), F.lit(0.8).alias("tnz"))
    return near.join(a, "query_id").join(b, "nbr_id")


_PAIRS = f", p AS (SELECT a.point_id AS query_id, a.px, a.py, a.pz, b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz, {D2} AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY {D2}, b.point_id) AS rank FROM {_MOVED} a CROSS JOIN emb2 b), c AS (SELECT * FROM p WHERE rank = 1 AND d2 <= 4) "
# R skew(p) for the quarter turn: rows (-pz, 0, px), (0, -pz, py), (-py, px, 0); -R: (0, 1, 0), (-1, 0, 0), (0, 0, -1)
_B = "sum(-pz*rx - py*rz) AS b0, sum(-pz*ry + px*rz) AS b1, sum(px*rx + py*ry) AS b2, sum(-ry) AS b3, sum(rx) AS b4, sum(-rz) AS b5"


@query("r2_point_to_point", _PAIRS + f"SELECT sum(pz*pz + py*py) AS h00, sum(pz*pz + px*px) AS h11, sum(px*px + py*py) AS h22, CAST(count(*) AS DOUBLE) AS h33, {_B}, sum(d2)/2 AS error, count(*) AS inlier FROM c", "emb emb2")
def r2(s, d):
    sums = reg.linear_sums(reg.Params(reg_type=reg.RegType.POINT_TO_POINT), QUARTER)
    return _pairs(s, d).agg(*sums).select("h00", "h11", "h22", "h33", *(f"b{i}" for i in range(6)), "error", "inlier")


@query("r3_point_to_plane", _PAIRS + ", e AS (SELECT 0.6e0*ry + 0.8e0*rz AS a FROM c) SELECT round(sum(a*a)/2, 6) AS error, count(*) AS inlier FROM e", "emb emb2")
def r3(s, d):
    sums = reg.linear_sums(reg.Params(reg_type=reg.RegType.POINT_TO_PLANE), QUARTER)
    return _r6(_pairs(s, d).agg(*sums).select("error", "inlier"), "error")


@query("r8_robust_weights", _PAIRS + "SELECT query_id, round(CASE WHEN sqrt(d2) <= 1e-8 THEN 1 ELSE least(1e0, 1/(sqrt(d2)/0.5e0)) END, 6) AS huber, round(CASE WHEN sqrt(d2)/0.5e0 >= 1 THEN 0e0 ELSE (1-d2/0.25e0)*(1-d2/0.25e0) END, 6) AS tukey, round(1/(1+d2/0.25e0), 6) AS cauchy, round(1/((1+d2/0.25e0)*(1+d2/0.25e0)), 6) AS geman_mcclure FROM c", "emb emb2")
def r8(s, d):
    r = F.sqrt("dist_sq")
    return _pairs(s, d).select("query_id", *(F.round(E.robust_weight(r, 0.5, k), 6).alias(k) for k in ("huber", "tukey", "cauchy", "geman_mcclure")))


@query("r9_robust_errors", _PAIRS + "SELECT round(sum(CASE WHEN sqrt(d2) <= 0.5 THEN d2/2 ELSE 0.5e0*(sqrt(d2)-0.25e0) END), 4) AS huber, round(sum(CASE WHEN sqrt(d2) <= 0.5 THEN 0.25e0/6*(1-power(1-d2/0.25e0,3)) ELSE 0.25e0/6 END), 4) AS tukey, round(sum(0.125e0*ln(1+d2/0.25e0)), 4) AS cauchy, round(sum(0.5e0*0.25e0*d2/(0.25e0+d2)), 4) AS geman_mcclure FROM c", "emb emb2")
def r9(s, d):
    r = F.sqrt("dist_sq")
    return _pairs(s, d).agg(*(F.round(F.sum(E.robust_error(r, 0.5, k)), 4).alias(k) for k in ("huber", "tukey", "cauchy", "geman_mcclure")))


@query("r10_linearize_robust", _PAIRS + ", w AS (SELECT *, 1/((1+d2)*(1+d2)) AS w FROM c) SELECT round(sum(w*(pz*pz+py*py)), 4) AS h00, round(sum(w*rx), 4) AS b4, round(sum(0.5e0*d2/(1+d2)), 4) AS error, count(*) AS inlier FROM w", "emb emb2")
def r10(s, d):
    sums = reg.linear_sums(reg.Params(reg_type=reg.RegType.POINT_TO_POINT, loss=reg.Loss.GEMAN_MCCLURE, scale=1.0), QUARTER)
    return _pairs(s, d).agg(*sums).select(*(F.round(c, 4).alias(c) for c in ("h00", "b4", "error")), "inlier")


#: The motion that the source of every alignment is made by, which an alignment has to find.
TRUE_POSE = lie.se3_exp(np.array([0.01, -0.02, 0.03, 0.05, -0.04, 0.02]))
_FOUND = "SELECT " + ", ".join(f"round({float(TRUE_POSE[i, j])!r}::DOUBLE, 3) AS t{i}{j}" for i in range(3) for j in range(4)) + ", true AS converged, count(*) AS inlier FROM emb"


def _scene(s, d, kind: reg.RegType, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Source and target with the features that the type needs; both: covariances of the source in any case."""
    tgt = views.cloud_emb(s, d)
    src = transform.transform_points(tgt, lie.inverse_pose(TRUE_POSE))
    if kind is not reg.RegType.POINT_TO_POINT:
        tgt = features.covariances(tgt, 10)
    if both or kind is reg.RegType.GICP:
        src = features.covariances(src, 10)
    if kind in (reg.RegType.POINT_TO_PLANE, reg.RegType.GENZ):
        tgt = udfs.add_normals(tgt)
    return src, tgt


def _result(s, r: reg.Result) -> DataFrame:
    """One row in one task, where rows of a list take a task for each core, of which all but one have none."""
    names = [f"t{i}{j}" for i in range(3) for j in range(4)]
    row = (*(round(float(v), 3) for v in r.T[:3].ravel()), bool(r.converged), int(r.inlier))
    return s.createDataFrame([row], ", ".join(f"{n} double" for n in names) + ", converged boolean, inlier long").coalesce(1)


def _align(kind: reg.RegType, **more):
    def run(s, d):
        src, tgt = _scene(s, d, kind)
        return _result(s, reg.register(src, tgt, reg.Params(reg_type=kind, **more)))

    return run


query("r15_align_gauss_newton", _FOUND, "emb")(_align(reg.RegType.POINT_TO_POINT))
query("r16_align_levenberg", _FOUND, "emb")(_align(reg.RegType.POINT_TO_PLANE, optimizer=reg.Optimizer.LEVENBERG_MARQUARDT))
query("r17_align_dogleg", _FOUND, "emb")(_align(reg.RegType.POINT_TO_POINT, optimizer=reg.Optimizer.POWELL_DOGLEG))
query("r5_align_gicp", _FOUND, "emb")(_align(reg.RegType.GICP))
query("r6_align_genz", _FOUND, "emb")(_align(reg.RegType.GENZ))
query("r4_align_distribution", _FOUND, "emb")(_align(reg.RegType.POINT_TO_DISTRIBUTION))


@query("r12_rotation_constraint")
def r12(s, d):
    """The divergence of each pair's covariances at no motion, and its slope."""
    src, tgt = _scene(s, d, reg.RegType.POINT_TO_DISTRIBUTION, True)
    pairs = src.select("point_id", *(F.col(c).alias(f"s{c}") for c in E.COV)).join(tgt.select("point_id", *(F.col(c).alias(f"t{c}") for c in E.COV)), "point_id")
    _, b, length = reg.rotation_terms(np.eye(4))
    return pairs.select("point_id", length.alias("residual"), *(b[i].alias(f"b{i}") for i in range(3)))


@query("r12_align_constrained", _FOUND, "emb")
def r12a(s, d):
    src, tgt = _scene(s, d, reg.RegType.GICP)
    return _result(s, reg.register(src, tgt, reg.Params(reg_type=reg.RegType.GICP, rotation_constraint=True)))


@query("r13_degenerate")
def r13(s, d):
    src, tgt = _scene(s, d, reg.RegType.POINT_TO_POINT)
    p = reg.Params(reg_type=reg.RegType.POINT_TO_POINT, degeneracy=reg.DegeneracyParams(reg.Degeneracy.NL_REG))
    return _result(s, reg.register(src, tgt, p))


@query("r14_map_prior", _FOUND, "emb")
def r14(s, d):
    src, tgt = _scene(s, d, reg.RegType.POINT_TO_POINT)
    p = reg.Params(reg_type=reg.RegType.POINT_TO_POINT)
    problem, prior = reg.SparkProblem(src, tgt, p), reg.MapPrior(reg.PriorParams(enabled=True))
    first = reg.register(src, tgt, p, problem=problem)
    prior.update(first, first.T)
    last = reg.register(src, tgt, p, first.T, prior=prior, problem=problem)
    problem.release()
    return _result(s, last)


def _weights_sql() -> str:
    T = lie.inverse_pose(TRUE_POSE)
    moved = [f"{float(T[i, 0])!r}::DOUBLE*x + {float(T[i, 1])!r}::DOUBLE*y + {float(T[i, 2])!r}::DOUBLE*z + {float(T[i, 3])!r}::DOUBLE AS {c}" for i, c in enumerate("xyz")]
    limit = reg.Params().max_distance
    return f""", a AS (SELECT point_id, {', '.join(moved)} FROM emb), m AS (SELECT a.point_id, min({D2}) AS d2 FROM a CROSS JOIN emb b GROUP BY 1)
SELECT point_id, round(CASE WHEN d2 > {limit * limit!r} THEN 0e0 ELSE 1/(1 + d2/0.25e0) END, 6) AS w FROM m"""


@query("r21_icp_weights", _weights_sql(), "emb")
def r21(s, d):
    src, tgt = _scene(s, d, reg.RegType.POINT_TO_POINT)
    return _r6(reg.SparkProblem(src, tgt, reg.Params(reg_type=reg.RegType.POINT_TO_POINT, loss=reg.Loss.CAUCHY)).weights(np.eye(4), 0.5), "w")


@query("r23_annealing", _FOUND, "emb")
def r23(s, d):
    src, tgt = _scene(s, d, reg.RegType.POINT_TO_POINT)
    p = reg.PipelineParams(sampling=False, auto_scale=True, levels=2)
    return _result(s, reg.register(src, tgt, reg.Params(reg_type=reg.RegType.POINT_TO_POINT, loss=reg.Loss.GEMAN_MCCLURE), None, p))


# Maps ---------------------------------------------------------------------------------------------


@query("m1_voxel_map", f"SELECT {key_sql(2)} AS key, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(intensity) AS si, max(frame_id) AS last_update FROM li GROUP BY 1", "li")
def m1(s, d):
    """All frames, one at a time would end the same: sums commute."""
    return maps.voxel_fold(views.cloud_li(s, d), 2.0).select("key", "n", "sx", "sy", "sz", "si", "last_update")


@query("m1_voxel_insert", f"SELECT {key_sql(2)} AS key, count(*) AS n, sum(x) AS sx, max(frame_id) AS last_update FROM li GROUP BY 1", "li")
def m1i(s, d):
    """Frame by frame, each merged into the map so far."""
    li, p = views.cloud_li(s, d), maps.VoxelMapParams(2.0)
    state = maps.empty_map(s)
    for k in range(1, 8):
        state = maps.voxel_insert(state, li.where(F.col("frame_id") == k), k, p)
    return state.select("key", "n", "sx", "last_update")


@query("m2_evict", f"SELECT {key_sql(2)} AS key, max(frame_id) AS last_update FROM li GROUP BY 1 HAVING max(frame_id) >= 4", "li")
def m2(s, d):
    return maps.evict(maps.voxel_fold(views.cloud_li(s, d), 2.0), 7, 3).select("key", "last_update")


@query("m4_voxel_extract", f"SELECT key, n, sx/n AS x, sy/n AS y, sz/n AS z, si/n AS intensity FROM (SELECT {key_sql(2)} AS key, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(intensity) AS si FROM li GROUP BY 1) WHERE n >= 3 AND sx/n BETWEEN 0 AND 40 AND sy/n BETWEEN 0 AND 40 AND sz/n BETWEEN -20 AND 20", "li")
def m4(s, d):
    return maps.voxel_extract(maps.voxel_fold(views.cloud_li(s, d), 2.0), (20.0, 20.0, 0.0), 20.0, 3).select("key", "n", *E.XYZ, "intensity")


@query("m5_voxel_overlap", f", m AS (SELECT {key_sql(2)} AS key, count(*) AS n FROM li GROUP BY 1) SELECT CAST(count(*) FILTER (n >= 40) AS DOUBLE)/count(*) AS overlap FROM li LEFT JOIN m ON key = {key_sql(2)}", "li")
def m5(s, d):
    li = views.cloud_li(s, d)
    return maps.voxel_overlap(li, maps.voxel_fold(li, 2.0), 2.0, 40)


@query("m6_occupancy_hits", f"SELECT {key_sql(2)} AS key, count(*) AS hit_count, sum(x) AS sx, sum(intensity) AS si FROM li GROUP BY 1", "li")
def m6(s, d):
    return maps.hits(views.cloud_li(s, d), maps.OccupancyParams(size=2.0)).select("key", "hit_count", "sx", "si")


@query("m7_free_space")
def m7(s, d):
    return maps.misses(views.cloud_emb(s, d), (0.0, 0.0, 0.0), maps.OccupancyParams(size=0.5))


@query("m8_apply_pending", f"SELECT {key_sql(2)} AS key, count(*) AS hit_count, least(4e0, 0.5e0*count(*)) AS log_odds FROM li GROUP BY 1", "li")
def m8(s, d):
    return _occupancy(s, d)[0].select("key", "hit_count", "log_odds")


@query("m9_prune", f"SELECT {key_sql(2)} AS key FROM li GROUP BY 1 HAVING 7 - max(frame_id) <= 2", "li")
def m9(s, d):
    state = maps.voxel_fold(views.cloud_li(s, d), 2.0).withColumnRenamed("last_update", "last_updated")
    return maps.prune(state, 7, 2).select("key")


@query("m10_occupied", f"SELECT key, n, sx/n AS x, sy/n AS y, sz/n AS z FROM (SELECT {key_sql(2)} AS key, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM li GROUP BY 1) WHERE greatest(abs(sx/n), abs(sy/n), abs(sz/n)) <= 50", "li")
def m10(s, d):
    state, p = _occupancy(s, d)
    return maps.occupied_points(state, (0.0, 0.0, 0.0), 50.0, p).select("key", "n", *E.XYZ)


@query("m12_occupancy_overlap", f"SELECT CAST(count(*) FILTER ({key_sql(2)} IN (SELECT {key_sql(2)} FROM li)) AS DOUBLE)/count(*) AS overlap FROM emb", "li emb")
def m12(s, d):
    state, p = _occupancy(s, d)
    return maps.occupancy_overlap(views.cloud_emb(s, d), state, p)


@query("m6_occupancy_carved")
def m6c(s, d):
    p = maps.OccupancyParams(size=0.5, hit=0.5, miss=-0.03125)
    return maps.occupancy_insert(maps.empty_map(s, True), views.cloud_emb(s, d), 1, p)


# Sensor streams -----------------------------------------------------------------------------------


@query("t1_imu_ingest", ", o AS (SELECT *, max(ts) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM imu) SELECT stream_id, arrival, ts, gx FROM o WHERE m IS NULL OR ts > m", "imu")
def t1(s, d):
    return imu.ingest(views.imu_view(s, d)).select("stream_id", "arrival", "ts", "gx")


@query("t2_preintegration")
def t2(s, d):
    rows = views.imu_view(s, d)
    return imu.preintegrate(imu.windows(rows, _days(rows)), params=imu.ImuParams(gyro_noise=1e-3, accel_noise=1e-2))


@query("t5_stationary_stats", ", l AS (SELECT *, max(ts) OVER (PARTITION BY stream_id) AS t1 FROM imu) SELECT stream_id, count(*) AS n, round(avg(gx), 6) AS gx_mean, round(stddev_pop(gx), 6) AS gx_std, round(avg(az), 6) AS az_mean FROM l WHERE ts >= t1 - 864000 GROUP BY 1", "imu")
def t5(s, d):
    return _r6(imu.stationary_stats(views.imu_view(s, d), 864000.0).select("stream_id", "n", "gx_mean", "gx_std", "az_mean"), "gx_mean", "gx_std", "az_mean")


_TWIST = np.array([0.0, 0.0, 0.5, 1.0, 0.0, 0.0])


@query(
    "t8_deskew",
    ", r AS (SELECT point_id, x, y, z, 0.5e0*least(1e0, greatest(0e0, intensity*1e-3/0.002e0)) AS t, least(1e0, greatest(0e0, intensity*1e-3/0.002e0)) AS s FROM li) SELECT point_id, round(CASE WHEN t < 1e-8 THEN x + s ELSE cos(t)*x - sin(t)*y + s*sin(t)/t END, 5) AS x, round(CASE WHEN t < 1e-8 THEN y ELSE sin(t)*x + cos(t)*y + s*(1-cos(t))/t END, 5) AS y, z FROM r",
    "li",
)
def t8(s, d):
    li = views.cloud_li(s, d).withColumn("t_offset_ms", F.col("intensity"))
    return dsk.deskew_points(li, np.eye(4), lie.se3_exp(_TWIST), 0.002).select("point_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "z")


@query("t13_bias_observable", ", w AS (SELECT stream_id, CAST(floor(ts/86400) AS BIGINT) AS window_id, gx, gy, gz, avg(gx) OVER d AS mx, avg(gy) OVER d AS my, avg(gz) OVER d AS mz FROM imu WINDOW d AS (PARTITION BY stream_id, CAST(floor(ts/86400) AS BIGINT))) SELECT stream_id, window_id, round(max(sqrt((gx-mx)*(gx-mx)+(gy-my)*(gy-my)+(gz-mz)*(gz-mz))), 6) AS gyro_dev FROM w GROUP BY 1, 2", "imu")
def t13(s, d):
    rows = views.imu_view(s, d).withColumn("window_id", F.floor(F.col("ts") / 86400).cast("long"))
    return _r6(imu.bias_observable(rows, 0.1, 0.1).select("stream_id", "window_id", "gyro_dev"), "gyro_dev")


@query("t14_preprocess", f"SELECT frame_id, key AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, round(greatest(0e0, median(intensity)*power(sqrt(avg(x)*avg(x)+avg(y)*avg(y)+avg(z)*avg(z)), 2e0)), 4) AS intensity FROM (SELECT *, {key_sql(2)} AS key FROM li WHERE greatest(abs(x), abs(y), abs(z)) BETWEEN 4 AND 90) GROUP BY 1, 2", "li")
def t14(s, d):
    p = odometry.PreprocessParams(box_min=4.0, box_max=90.0, voxel=2.0, intensity={})
    return odometry.preprocess(views.cloud_li(s, d), p).select("frame_id", "point_id", *E.XYZ, F.round("intensity", 4).alias("intensity"))


def _sweeps(s, d) -> DataFrame:
    """Each stream sees the embedding cloud from a pose that moves a little from frame to frame."""
    e = views.cloud_emb(s, d).drop("frame_id")
    frames = s.range(4).select(F.col("id").alias("frame_id"), (F.col("id") * 0.1).alias("ts"))
    streams = s.range(2).select(F.col("id").alias("stream_id"))
    at = e.join(F.broadcast(frames), how="cross").join(F.broadcast(streams), how="cross")
    return at.withColumn("x", F.col("x") * 4 - F.col("frame_id") * 0.05 * (1 + F.col("stream_id"))).withColumn("y", F.col("y") * 4).withColumn("z", F.col("z") * 4)


def _odometry_params() -> odometry.OdometryParams:
    return odometry.OdometryParams(preprocess=odometry.PreprocessParams(box_min=0.0), registration=reg.Params(reg_type=reg.RegType.POINT_TO_POINT, max_distance=1.0), min_points=50, voxel_map=maps.VoxelMapParams(0.5), map_sample=5000)


@query("t15_lidar_odometry")
def t15(s, d):
    return odometry.run_streams(_sweeps(s, d), None, _odometry_params())


@query("t16_inertial_odometry")
def t16(s, d):
    rest = s.range(0, 60).select((F.col("id") * 0.01 - 0.1).alias("ts"), *(F.lit(v).alias(c) for c, v in zip(imu.AXES, (0.0, 0.0, 0.0, 0.0, 0.0, 9.80665))))
    samples = rest.join(F.broadcast(s.range(2).select(F.col("id").alias("stream_id"))), how="cross")
    return odometry.run_streams(_sweeps(s, d), samples, _odometry_params(), inertial=True)


@query("t17_stage_times", ", o AS (SELECT z, x, row_number() OVER (PARTITION BY z ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY z) AS n FROM scan) SELECT CAST(CAST(z AS BIGINT) AS VARCHAR) AS stage, max(x) AS max_us, avg(x) AS mean_us, max(CASE WHEN k = n // 2 THEN x END) AS median_us FROM o GROUP BY 1", "scan")
def t17(s, d):
    return odometry.stage_times(views.scan_stream(s, d).select(F.col("z").cast("long").cast("string").alias("stage"), F.col("x").alias("us")))


# Sources and sinks --------------------------------------------------------------------------------


@query("s8_timestamps", "SELECT point_id, CASE point_id % 3 WHEN 0 THEN x*1e-6 WHEN 1 THEN x*1e3 ELSE greatest(0e0, CASE WHEN x > 1e8 THEN x*1e3 - 64 ELSE x*1e3 END) END AS t_offset_ms FROM scan", "scan")
def s8(s, d):
    kind = F.pmod("point_id", F.lit(3)) + 6
    rows = views.scan_stream(s, d).select("point_id", F.col("x").alias("raw_time"), kind.alias("time_type"), F.lit(64.0).alias("start_time_ms"))
    return sensors.normalize_times(rows).select("point_id", "t_offset_ms")


@query("s11_tum_lines", "SELECT printf('%.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f', CAST(point_id AS DOUBLE), x, y, z, 0e0, 0e0, 0e0, 1e0) AS value FROM emb", "emb")
def s11(s, d):
    q = {"qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0}
    rows = views.cloud_emb(s, d).select(F.col("point_id").cast("double").alias("ts"), *(F.col(c).alias(f"t{c}") for c in E.XYZ), *(F.lit(v).alias(k) for k, v in q.items()))
    return sensors.tum_lines(rows)


@query("s7_pointcloud2", "SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS point_id, x, y, z FROM emb", "emb")
def s7(s, d):
    """Packed into messages and decoded again; coordinates survive as 32-bit floats."""
    packed = sensors.encode_messages(views.cloud_emb(s, d).withColumn("ts", F.col("frame_id").cast("double")))
    return sensors.decode_messages(packed).select("frame_id", "point_id", *E.XYZ)


def _file_cloud(s, d) -> DataFrame:
    return views.cloud_emb(s, d).select("point_id", *E.XYZ, F.pmod("point_id", F.lit(16)).cast("double").alias("intensity"))


def _round_trip(ext: str, ascii: bool):
    def run(s, d):
        path = points.write_file(_file_cloud(s, d), new_path(s, "cloud") + "." + ext, ascii)
        return points.read_file(s, path).select(*E.XYZ, *(["intensity"] if ext == "ply" else []))

    return run


_PLY_SQL = "SELECT x, y, z, CAST(point_id % 16 AS DOUBLE) AS intensity FROM emb"
query("s1_ply_scan", _PLY_SQL, "emb")(_round_trip("ply", True))
query("s2_pcd_scan", "SELECT x, y, z FROM emb", "emb")(_round_trip("pcd", True))
query("s4_ply_sink", _PLY_SQL, "emb")(_round_trip("ply", False))
query("s5_pcd_sink", "SELECT x, y, z FROM emb", "emb")(_round_trip("pcd", False))


@query("s3_read_dispatch", "SELECT e.ext, x, y, z FROM emb CROSS JOIN (SELECT unnest(['ply', 'pcd']) AS ext) e", "emb")
def s3(s, d):
    """Both formats, chosen by the path's extension."""
    out = None
    for ext in points.EXTENSIONS:
        path = points.write_file(_file_cloud(s, d), new_path(s, "cloud") + "." + ext)
        one = points.read_file(s, path, intensity=False).select(F.lit(ext).alias("ext"), *E.XYZ)
        out = one if out is None else out.unionByName(one)
    return out


@query("s6_write_facade", "SELECT count(*) AS n, sum(x) AS sx, 2 * count(*) AS both_n FROM emb", "emb")
def s6(s, d):
    """Paths without an extension take that of the writer."""
    made = [w(_file_cloud(s, d), new_path(s, "cloud")) for w in (points.write_ply, points.write_pcd)]
    ply, pcd = (points.read_file(s, p).agg(F.count("*").alias("n"), F.sum("x").alias("sx")) for p in made)
    both = pcd.select(F.col("n").alias("m"))
    return ply.join(F.broadcast(both), how="cross").select("n", "sx", (F.col("n") + F.col("m")).alias("both_n"))


@query("s13_ellipsoids", _EIG + "SELECT point_id, " + ", ".join(f"{_sql_r(4, f'greatest(1e-3, sqrt(greatest(l{i}, 0e0)))')} AS s{i}" for i in range(3)) + f", {_sql_r(4, '1 - l0/(l2 + 1e-6)')} AS planarity, " + _AXIS + " FROM e", "emb")
def s13(s, d):
    e = sensors.ellipsoids(features.covariances(views.cloud_emb(s, d), 10).select("point_id", *E.COV))
    x, y, z, w = (F.col(c) for c in ("qx", "qy", "qz", "qw"))
    return e.select("point_id", *_r(4, "s0", "s1", "s2", "planarity"), *_axis(1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)))


@query("extend_union", "SELECT frame_id, point_id, x, y, z FROM emb UNION ALL SELECT frame_id, point_id, x, y, z FROM li", "emb li")
def extend(s, d):
    return filters.extend(views.cloud_emb(s, d), views.cloud_li(s, d))
