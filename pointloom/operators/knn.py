"""Spatial joins: nearest neighbours and radius search.

A bounded number of targets goes to every task as a k-d tree (functions.near). More of them fall into
cubic cells; a query meets the cells around its own by an equi-join. After m shells a query is final
when its k-th distance is below m times the cell size: every other point is farther. Queries that are
not final go on to wider shells, and the last few to a blockwise scan. All of it is exact for any
distribution."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import near

#: Targets up to this size, in rows, go to every task: as a tree, which takes about 40 bytes a row, or
#: inside groups, where they are scanned. Beyond it the cells take over.
HELD_ROWS, BROADCAST_ROWS = 250_000, 20_000
#: Queries that a task searches for at once.
CHUNK = 1 << 16


def _moved(queries: DataFrame, pose: np.ndarray | None, by: tuple[str, ...], *more: F.Column) -> DataFrame:
    p = [F.col(c) for c in E.XYZ]
    if pose is not None:
        p = E.move(E.constant(pose), p)
    return queries.where(E.finite()).select(*by, F.col("point_id").alias("query_id"), *(c.alias(f"q{n}") for c, n in zip(p, E.XYZ)), *more)


def _sides(queries: DataFrame, targets: DataFrame, pose: np.ndarray | None, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    q = _moved(queries, pose, by)
    t = targets.where(E.finite()).select(*by, F.col("point_id").alias("nbr_id"), *(F.col(c).alias(f"t{c}") for c in E.XYZ))
    return q, t


def _distance() -> F.Column:
    d = [F.col(f"q{c}") - F.col(f"t{c}") for c in E.XYZ]
    return E.dot(d, d)


def _top(pairs: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    best = Window.partitionBy(*by, "query_id").orderBy("dist_sq", "nbr_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Queries and targets that a task of brute_knn() compares.
BRUTE_QUERIES, BRUTE_TARGETS = 1 << 13, 1 << 17


def brute_knn(queries: DataFrame, targets: DataFrame, k: int, pose: np.ndarray | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., query_id, rank, nbr_id, dist_sq) by meeting every query with every target of its group. Ungrouped
    rows with whole numbers for ids meet in blocks: parts of the queries by parts of the targets, each pair of parts in a task."""
    q, t = _sides(queries, targets, pose, by)
    kinds = dict(q.dtypes) | dict(t.dtypes)
    if k > 0 and not by and {kinds["query_id"], kinds["nbr_id"]} == {"bigint"}:
        return _block_knn(q, t, k)
    pairs = q.join(t, list(by)) if by else q.join(t, how="cross")
    return _top(pairs.withColumn("dist_sq", _distance()), k, by).select(*by, "query_id", "rank", "nbr_id", "dist_sq")


def _block_knn(q: DataFrame, t: DataFrame, k: int) -> DataFrame:
    n, m = (math.ceil(max(d.count(), 1) / most) for d, most in ((q, BRUTE_QUERIES), (t, BRUTE_TARGETS)))
    n = max(n, min(q.sparkSession.sparkContext.defaultParallelism, 64))
    rows = lambda d, side, parts, others: d.select(
        F.pmod(F.xxhash64(d.columns[0]), F.lit(parts)).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("_met"), F.lit(side == "q").alias("_q"), F.col(d.columns[0]).alias("id"), *(F.col(side + c).alias(c) for c in E.XYZ)
    )
    place = lambda a, b: (F.col(a) * m + F.col(b)).cast("int").alias("_part")
    cols = ["_q", "id", *E.XYZ]
    dealt = rows(q, "q", n, m).select(place("_own", "_met"), *cols).unionByName(rows(t, "t", m, n).select(place("_met", "_own"), *cols))

    def compare(batches):
        for all_ in chunks(batches, 1 << 62):
            side, ids, xyz = all_["_q"].to_numpy(), all_["id"].to_numpy(), columns_xyz(all_, "")
            mine, theirs = ids[side], ids[~side]
            found, dist = near.brute(xyz[side], xyz[~side], theirs, k)
            row, at = np.nonzero(np.isfinite(dist))
            yield from batches_of(pa.table([pa.array(mine[row]), pa.array(found[row, at]), pa.array(dist[row, at])], names=["query_id", "nbr_id", "dist_sq"]))

    pairs = dealt.repartitionById(n * m, "_part").select(*cols).mapInArrow(compare, "query_id long, nbr_id long, dist_sq double")
    return _top(pairs, k, ()).select("query_id", "rank", "nbr_id", "dist_sq")


class Held:
    """Targets that were collected and broadcast: a tree whose ids are positions in ascending point_id,
    and the columns `more` in that order."""

    def __init__(self, rows: pa.Table, id_type: str):
        order = np.argsort(rows["point_id"].to_numpy(), kind="stable")
        self.id_type, self.columns = id_type, {c: rows[c].to_numpy()[order] for c in rows.column_names}
        self.xyz = np.stack([self.columns[c] for c in E.XYZ], 1).astype(float) if len(order) else np.zeros((0, 3))


def hold(targets: DataFrame, most: int | None = None, more: tuple[str, ...] = ()) -> Held | None:
    """The finite targets, unless they are more than `most` or HELD_ROWS, or their ids are no integers."""
    kind, most = dict(targets.dtypes)["point_id"], HELD_ROWS if most is None else most
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        return None
    cols = ["point_id", *E.XYZ, *more]
    rows = targets.where(E.finite() & F.col("point_id").isNotNull()).select(*cols).limit(most + 1).toArrow()
    return Held(rows, kind) if rows.num_rows <= most else None


def chunks(batches, most: int = CHUNK):
    """Record batches put together to tables of about `most` rows."""
    some, n = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def batches_of(table: pa.Table, rows: int = 1 << 16):
    yield from table.combine_chunks().to_batches(rows)


def columns_xyz(t: pa.Table, prefix: str) -> np.ndarray:
    return np.stack([t[prefix + c].to_numpy() for c in E.XYZ], 1).astype(float)


def held_knn(queries: DataFrame, held: Held, k: int, pose: np.ndarray | None = None, limit: float = math.inf) -> DataFrame:
    """(query_id, rank, nbr_id, dist_sq) of the k nearest held targets, `limit` (squared) away at most."""
    q = _moved(queries, pose, ())
    sc = queries.sparkSession.sparkContext
    sent = sc.broadcast((near.Tree(held.xyz, np.arange(len(held.xyz)), max(k, 1)), held.columns["point_id"]))
    kinds = {"query_id": dict(q.dtypes)["query_id"], "rank": "int", "nbr_id": held.id_type, "dist_sq": "double"}

    def search(batches):
        tree, ids = sent.value
        for t in chunks(batches):
            at, dist = tree.knn(columns_xyz(t, "q"), k, limit)
            row, rank = np.nonzero(np.isfinite(dist))
            got = [t["query_id"].take(pa.array(row)), pa.array((rank + 1).astype(np.int32)), pa.array(ids[at[row, rank]]), pa.array(dist[row, rank])]
            yield from batches_of(pa.table(got, names=list(kinds)))

    return q.repartition(max(sc.defaultParallelism, 1)).mapInArrow(search, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def cell_size(targets: DataFrame, k: int) -> float:
    """An edge at which a cell holds about k targets."""
    r = targets.where(E.finite()).agg(*(F.min(c).alias(f"a{c}") for c in E.XYZ), *(F.max(c).alias(f"b{c}") for c in E.XYZ), F.count("*").alias("n")).first()
    if not r["n"]:
        return 1.0
    sides = [r[f"b{c}"] - r[f"a{c}"] for c in E.XYZ if r[f"b{c}"] > r[f"a{c}"]]
    if not sides:
        return 1.0
    return max((math.prod(sides) * k / r["n"]) ** (1 / len(sides)), max(sides) * 1e-6, 1e-9)


def _coarser(q: DataFrame, t: DataFrame, k: int, by: tuple[str, ...], size: float) -> DataFrame:
    """The queries that no shell has settled, against ever coarser cells: each round meets the 27 cells
    around a query by an equi-join and settles those whose k-th distance is below the cell's edge; the
    last round's edge is the extent of both sides, where 27 cells hold every target."""
    t, q = t.select(*by, "nbr_id", *(f"t{c}" for c in E.XYZ)), q.select(*by, "query_id", *(f"q{c}" for c in E.XYZ))
    ends = [f(f"{s}{c}").alias(f"{n}{s}{c}") for s in "qt" for c in E.XYZ for n, f in (("a", F.min), ("b", F.max))]
    r = q.agg(*ends[:6]).first().asDict() | t.agg(*ends[6:]).first().asDict()
    known = [(min(v), max(w)) for c in E.XYZ if (v := [r[f"a{s}{c}"] for s in "qt" if r[f"a{s}{c}"] is not None]) and (w := [r[f"b{s}{c}"] for s in "qt" if r[f"b{s}{c}"] is not None])]
    extent = max((b - a for a, b in known), default=0.0)
    keys, done, last = [*by, *(f"c{c}" for c in E.XYZ)], [], False
    while not last:
        size *= 4
        last = size >= extent
        held = t.select("*", *(E.cell(f"t{c}", size).alias(f"c{c}") for c in E.XYZ))
        wide = q.select("*", *(E.cell(f"q{c}", size).alias(f"c{c}") for c in E.XYZ))
        for c in E.XYZ:
            wide = wide.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
        found = _top(wide.join(held, keys).withColumn("dist_sq", _distance()), k, by).select(*by, "query_id", "rank", "nbr_id", "dist_sq")
        if not last:
            found = found.persist()
            final = found.groupBy(*by, "query_id").agg(F.count("*").alias("n"), F.max("dist_sq").alias("d")).where((F.col("n") == k) & (F.col("d") < size * size)).select(*by, "query_id")
            q, found = q.join(final, [*by, "query_id"], "left_anti").select(*q.columns).persist(), found.join(final, [*by, "query_id"], "left_semi")
            last = not q.limit(1).count()
        done.append(found)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def grid_knn(queries: DataFrame, targets: DataFrame, k: int, pose: np.ndarray | None = None, by: tuple[str, ...] = (), size: float | None = None, shells: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    q, t = _sides(queries, targets, pose, by)
    size = size or cell_size(targets, k)
    at = [E.cell(f"t{c}", size).alias(f"c{c}") for c in E.XYZ]
    t = t.select("*", *at)
    q = q.select("*", *(E.cell(f"q{c}", size).alias(f"c{c}") for c in E.XYZ))
    done, keys = [], [*by, *(f"c{c}" for c in E.XYZ)]
    for m in shells:
        wide = q
        for c in E.XYZ:
            wide = wide.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - m, F.col(f"c{c}") + m)))
        found = _top(wide.join(t, keys).withColumn("dist_sq", _distance()), k, by).select(*by, "query_id", "rank", "nbr_id", "dist_sq").persist()
        final = found.groupBy(*by, "query_id").agg(F.count("*").alias("n"), F.max("dist_sq").alias("d")).where((F.col("n") == k) & (F.col("d") < (m * size) ** 2)).select(*by, "query_id")
        done.append(found.join(final, [*by, "query_id"], "left_semi"))
        q = q.join(final, [*by, "query_id"], "left_anti").select(*q.columns).persist()
        if not q.limit(1).count():
            break
    else:
        done.append(_coarser(q, t, k, by, size * max(shells)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def knn(queries: DataFrame, targets: DataFrame, k: int, pose: np.ndarray | None = None, by: tuple[str, ...] = (), method: str = "auto") -> DataFrame:
    """k nearest targets of each query, ties to the smaller id, after moving queries by `pose`. Inside
    groups of the columns `by`, if any. method: brute, grid, or auto (by the checked target size: a tree
    in every task, or cells)."""
    if k < 0:
        raise ValueError("k must not be negative")
    if method == "brute":
        return brute_knn(queries, targets, k, pose, by)
    if method == "auto" and not by and k:
        held = hold(targets)
        return held_knn(queries, held, k, pose) if held else grid_knn(queries, targets, k, pose)
    if method == "auto" and targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return brute_knn(queries, F.broadcast(targets), k, pose, by)
    return grid_knn(queries, targets, k, pose, by)


#: Targets that a region of radius_search() holds, about, and rows of the sample that regions are cut by.
REGION_ROWS, CUT_ROWS = 100_000, 40_000


def _region_search(queries: DataFrame, targets: DataFrame, radius: float, most: int | None, pose: np.ndarray | None, by: tuple[str, ...]) -> DataFrame:
    q, t = _sides(queries, targets, pose, by)
    for c in by:
        q, t = q.where(F.col(c).isNotNull()), t.where(F.col(c).isNotNull())
    itself, limit = queries is targets and pose is None, radius * radius
    n = targets.where(E.finite()).count()
    cut = targets.where(E.finite()).select(*E.XYZ)
    cut = (cut.sample(CUT_ROWS / n, seed=1) if n > CUT_ROWS else cut).limit(2 * CUT_ROWS).toArrow()
    regions = near.Regions(columns_xyz(cut, ""), max(math.ceil(n / REGION_ROWS), min(targets.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 1000)), 1))
    cols = [*by, "id", *E.XYZ]
    kinds = {c: k for c, k in q.dtypes if c in by} | {"id": "bigint"} | dict.fromkeys(E.XYZ, "double")
    #: whether a row is a query, and whether it is a target, of a region
    flags = {"_part": "int", "_q": "boolean", "_t": "boolean"}

    def dealt(d: DataFrame, side: str) -> DataFrame:
        def deal(batches):
            for b in chunks(batches):
                xyz = columns_xyz(b, "")
                reach = limit if side != "q" else None
                row, part, own = regions.meet(xyz, reach)
                marks = [pa.array(part.astype(np.int32)), pa.array(own & (side != "t")), pa.array(np.full(len(row), side != "q"))]
                yield from batches_of(pa.table([*b.take(pa.array(row)).columns, *marks], names=[*cols, *flags]))

        p = "t" if side == "t" else "q"
        named = d.select(*by, F.col("nbr_id" if p == "t" else "query_id").alias("id"), *(F.col(p + c).cast("double").alias(c) for c in E.XYZ))
        return named.mapInArrow(deal, ", ".join(f"{c} {k}" for c, k in (kinds | flags).items()))

    rows = dealt(q, "both") if itself else dealt(q, "q").unionByName(dealt(t, "t"))
    out = {c: kinds[c] for c in by} | {"query_id": "bigint", "rank": "int", "nbr_id": "bigint", "dist_sq": "double"}

    def search(batches):
        for b in chunks(batches, 1 << 62):
            ids, xyz, asks, held = b["id"].to_numpy(), columns_xyz(b, ""), b["_q"].to_numpy(), b["_t"].to_numpy()
            group = np.zeros(len(ids), np.int64)
            for c in by:
                code = b[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
                group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                mine, theirs = at[asks[at]], at[held[at]]
                if len(mine) and len(theirs):
                    yield from found(b, mine, near.Tree(xyz[theirs], ids[theirs], most), xyz[mine], ids)

    def found(b, mine, tree, points, ids):
        if most is None:
            pairs = ((row, np.zeros(len(row), np.int32), nbr, d) for row, nbr, d in tree.within(points, limit))
        else:
            pairs = _ranked(tree, points, most, limit)
        for row, rank, nbr, d in pairs:
            at = mine[row]
            yield from batches_of(pa.table([*(b[c].take(pa.array(at)) for c in by), pa.array(ids[at]), pa.array(rank), pa.array(nbr), pa.array(d)], names=list(out)))

    # a region that holds queries of any id has all of their targets, so nothing has to be merged
    made = rows.repartitionById(len(regions), "_part").select(*cols, "_q", "_t").mapInArrow(search, ", ".join(f"{c} {k}" for c, k in out.items()))
    if most is None:
        made = made.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("dist_sq", "nbr_id")))
    return made.select(*by, "query_id", "rank", "nbr_id", "dist_sq")


def _ranked(tree: near.Tree, points: np.ndarray, most: int, limit: float):
    for a in range(0, len(points), CHUNK):
        nbr, d = tree.knn(points[a : a + CHUNK], most, limit)
        row, rank = np.nonzero(d <= limit)
        yield row + a, (rank + 1).astype(np.int32), nbr[row, rank], d[row, rank]


def radius_search(queries: DataFrame, targets: DataFrame, radius: float, most: int | None = None, pose: np.ndarray | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Targets within `radius` of each query, nearest first, `most` at most. Space is cut into regions of
    about REGION_ROWS targets; a query lies in one, a target goes to all regions within the radius of
    it, and a task searches a region by a k-d tree. Ids that are no whole numbers meet by one equi-join over
    the 27 cells around a query, with cells as wide as the radius."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    if {dict(queries.dtypes)["point_id"], dict(targets.dtypes)["point_id"]} == {"bigint"} and (most is None or most > 0):
        return _region_search(queries, targets, radius, most, pose, by)
    q, t = _sides(queries, targets, pose, by)
    t = t.select("*", *(E.cell(f"t{c}", radius).alias(f"c{c}") for c in E.XYZ))
    q = q.select("*", *(E.cell(f"q{c}", radius).alias(f"c{c}") for c in E.XYZ))
    for c in E.XYZ:
        q = q.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    pairs = q.join(t, [*by, *(f"c{c}" for c in E.XYZ)]).withColumn("dist_sq", _distance()).where(F.col("dist_sq") <= radius * radius)
    best = Window.partitionBy(*by, "query_id").orderBy("dist_sq", "nbr_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select(*by, "query_id", "rank", "nbr_id", "dist_sq")


def without(targets: DataFrame, removed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Targets whose point_id `removed` does not name."""
    return targets.join(removed.select(*by, "point_id"), [*by, "point_id"], "left_anti")


def correspondences(source: DataFrame, target: DataFrame, pose: np.ndarray, limit: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, nbr_id, dist_sq): the nearest target of each moved source point within `limit`."""
    held = None if by else hold(target)
    near_ = held_knn(source, held, 1, pose, limit * limit) if held else knn(source, target, 1, pose, by, "auto" if by else "grid")
    return near_.where(F.col("dist_sq") <= limit * limit).drop("rank")


def statistical_outliers(points: DataFrame, k: int, factor: float, by: tuple[str, ...] = (), metric: str = "squared") -> DataFrame:
    """Points whose mean neighbour distance (k neighbours, itself included) is at most the mean of all
    plus `factor` population deviations. Distances are squared unless metric is euclidean. Fewer
    than k points stay as they are."""
    d = F.sqrt("dist_sq") if metric == "euclidean" else F.col("dist_sq")
    near = knn(points, points, k, None, by).groupBy(*by, F.col("query_id").alias("point_id")).agg(F.avg(d).alias("_d"), F.count("*").alias("_n"))
    all_ = near.groupBy(*by).agg((F.avg("_d") + F.lit(float(factor)) * F.stddev_pop("_d")).alias("_limit"))
    judged = near.join(all_, list(by)) if by else near.join(F.broadcast(all_), how="cross")
    bad = judged.where((F.col("_d") > F.col("_limit")) & (F.col("_n") >= k)).select(*by, "point_id")
    return points.join(bad, [*by, "point_id"], "left_anti")


def radius_outliers(points: DataFrame, least: int, radius: float, by: tuple[str, ...] = (), metric: str = "squared") -> DataFrame:
    """Points that have `least` neighbours besides themselves within reach: the squared distance of the
    last is at most `radius` as it stands, or its square root is if metric is euclidean."""
    limit = radius * radius if metric == "euclidean" else radius
    far = knn(points, points, least + 1, None, by).where((F.col("rank") == least + 1) & (F.col("dist_sq") <= float(limit)))
    return points.join(far.select(*by, F.col("query_id").alias("point_id")), [*by, "point_id"], "left_semi")
