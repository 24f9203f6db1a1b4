"""Embeddings: an inverted multi-index for nearest neighbours, and near duplicates by a pruned flat graph."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, store


def usable(df: DataFrame) -> DataFrame:
    """df(vec_id, embedding, ...) without vectors that are null, empty or zero or hold null or
    non-finite components; the embedding becomes an array of double."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return df.withColumn("embedding", v).where(F.coalesce(good, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def bounded_sample(df: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the `rows` rows with the smallest hash of vec_id, of the commonest length."""
    got = df.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    lists = got.column("embedding").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    kinds, n = np.unique(size, return_counts=True)
    keep = pa.array(size == kinds[n.argmax()])
    return got.column("vec_id").combine_chunks().filter(keep).to_numpy(zero_copy_only=False), matrix(lists.filter(keep))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, weights=x[:, j], minlength=len(c)) / np.maximum(n, 1), c[:, j])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([distances(x[a : a + block], c).argmin(1) for a in range(0, len(x), block)] or [np.zeros(0, np.int64)])


class MultiIndex:
    """Centroids of two vector halves; a cell is a pair of them. `probe` of all rows is what a query
    visits: the smallest share at which a bounded sample, searched by the index, finds `recall` of
    its true neighbours."""

    def __init__(self, sample: np.ndarray, k: int, neighbours: int, recall: float, audit: int = 200):
        self.dim = sample.shape[1] if sample.size else 0
        self.half = self.dim // 2
        self.first = kmeans(sample[:, : self.half], k) if self.half else np.zeros((1, 0))
        self.second = kmeans(sample[:, self.half :], k, seed=2) if self.dim else np.zeros((1, 0))
        self.probe = 1.0
        if len(sample) > 10 * neighbours:
            counts = self.counts(self.cells(sample))
            asked = sample[:audit]
            true = np.argsort(distances(asked, sample), axis=1)[:, : neighbours + 1]
            cells, need = self.cells(sample), []
            for q, rows in zip(asked, true):
                order = self.traverse(q, counts, 1.0, len(sample))
                seen = np.full(len(counts), 1.0)
                seen[order] = np.cumsum(counts[order]) / len(sample)  # the share visited once a cell is done
                need += seen[cells[rows[1:]]].tolist()
            self.probe = float(np.quantile(need, recall))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def counts(self, cells: np.ndarray) -> np.ndarray:
        return np.bincount(cells, minlength=len(self.first) * len(self.second))

    def traverse(self, q: np.ndarray, counts: np.ndarray, share: float, total: int) -> list[int]:
        """Cells in ascending order of summed half distances, by a heap over the two sorted lists,
        until they hold `share` of all rows. Empty cells are passed over."""
        a, b = distances(q[None, : self.half], self.first)[0], distances(q[None, self.half :], self.second)[0]
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y = a[i].tolist(), b[j].tolist()
        i, j = i.tolist(), j.tolist()
        heap, out, held, width = [(x[0] + y[0], 0, 0)], [], 0, len(self.second)
        while heap and held < share * total:
            _, m, n = heapq.heappop(heap)
            if counts[cell := i[m] * width + j[n]]:
                out.append(cell)
                held += int(counts[cell])
            if n + 1 < len(y):
                heapq.heappush(heap, (x[m] + y[n + 1], m, n + 1))
            if n == 0 and m + 1 < len(x):
                heapq.heappush(heap, (x[m + 1] + y[0], m + 1, 0))
        return out


def search(df: DataFrame, queries: DataFrame, neighbours: int = 10, centroids: int | None = None, sample: int = 8000, recall: float = 0.97, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows of df(vec_id, embedding) by Euclidean
    distance in double precision, without rows of its own vec_id, ties to the smaller vec_id.

    The index is fitted on a bounded sample (`sample` rows) and holds every row. Each half has `centroids`
    centroids, by default the square root of rows / 64, but at least 8 and at most an eighth of the
    sample's size to the power of 0.75 (104 for 8000 rows), so that cells keep about 64 rows while
    the table grows. How large a share of the rows a query must visit depends on the data: on vectors without cluster
    structure it is most of them, whatever the index. Cells
    lie in pages of about `block` rows, and a larger cell in parts of that size, so a cell that holds many
    rows is spread over tasks; a task meets one page with the queries that visit a cell of it, in one matrix product.
    Every visited row is reranked on the original vectors.

    Vectors that are null, zero or hold null or non-finite components, or of another length than most
    of the sample, take no part, as queries or as rows; so do null vec_ids. Of rows that share a vec_id the
    nearest counts, at one rank. Fewer rows than `neighbours` give them all. Other columns are ignored. An
    empty table gives an empty result."""
    spark = df.sparkSession
    rows = usable(df.select("vec_id", "embedding")).where("vec_id is not null")
    known = bounded_sample(rows, sample)[1]
    if centroids is None:
        centroids = int(min(max(8, (rows.count() / 64) ** 0.5), max(8, sample**0.75 / 8)))
    index = MultiIndex(known, centroids, neighbours, recall)
    dim, width = index.dim, len(index.second)
    rows = rows.where(F.size("embedding") == dim)

    def assign(batches):
        for b in batches:
            x = matrix(b.column("embedding"))
            cell = index.cells(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell, pa.int64())], names=["vec_id", "embedding", "cell"])

    cells = store(rows.mapInArrow(assign, "vec_id long, embedding array<double>, cell long"), "cells")
    sizes = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # centroids ** 2 rows at most
    counts = np.zeros(max(1, len(index.first) * width), np.int64)
    for c, n in sizes.items():
        counts[c] = n
    total = int(counts.sum())
    # a page is a run of cells with about `block` rows together, or one larger cell, which has parts
    parts_of = np.maximum(1, -(-counts // block))
    page = np.zeros(len(counts), np.int64)
    filled, at = 0, -1
    for c in np.flatnonzero(counts):
        if at < 0 or filled + counts[c] > block:
            at, filled = at + 1, 0
        page[c] = at
        filled += counts[c]

    def visit(batches):
        for b in batches:
            x, ids, vectors = matrix(b.column("embedding")), b.column("vec_id"), b.column("embedding")
            for a in range(len(x)):
                seen: dict[int, list[int]] = {}
                for c in index.traverse(x[a], counts, index.probe, total):
                    seen.setdefault(int(page[c]), []).append(c)
                rows = [(p, k, cells) for p, cells in seen.items() for k in range(int(parts_of[cells].max()))]
                same = pa.array(np.full(len(rows), a))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(same), vectors.take(same), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                    names=["vec_id", "embedding", "page", "part", "cells"],
                )

    asked = usable(queries.select("vec_id", "embedding")).where((F.size("embedding") == dim) & F.col("vec_id").isNotNull()).distinct()
    asked = asked.mapInArrow(visit, "vec_id long, embedding array<double>, page long, part long, cells array<long>")
    per_cell = spark.createDataFrame([(int(c), int(page[c]), int(parts_of[c])) for c in sizes] or [(0, 0, 1)], "cell long, page long, parts long")
    held = cells.join(F.broadcast(per_cell), "cell").select("page", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "cell", "vec_id", "embedding")

    def meet(key, left, right):
        out = []
        q, v = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if len(q) and len(v):
            a, b = matrix(left.column("embedding").combine_chunks()), matrix(right.column("embedding").combine_chunks())
            most = min(neighbours * int(np.unique(v, return_counts=True)[1].max()), len(v)) - 1  # a vec_id may have several rows
            kinds, kind = np.unique(right.column("cell").to_numpy(), return_inverse=True)
            lists = left.column("cells").combine_chunks()
            visited = np.zeros((len(q), len(kinds)), bool)
            visited[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), np.minimum(np.searchsorted(kinds, lists.flatten().to_numpy()), len(kinds) - 1)] = True
            for s in range(0, len(q), 32):
                near = distances(a[s : s + 32], b)
                near[~visited[s : s + 32][:, kind]] = np.inf
                near[q[s : s + 32, None] == v] = np.inf
                # the exact measure decides; the expanded form may err in the last digits only
                edge = np.partition(near, most, axis=1)[:, most]
                m, n = np.nonzero(near <= (edge * (1 + 1e-9) + 1e-9)[:, None])
                m, n = m[np.isfinite(near[m, n])], n[np.isfinite(near[m, n])]
                exact = np.sqrt(((a[s + m] - b[n]) ** 2).sum(1))
                order = np.lexsort((exact, v[n], m))
                m, n, exact = m[order], n[order], exact[order]
                once = np.concatenate(([True], (m[1:] != m[:-1]) | (v[n[1:]] != v[n[:-1]])))[: len(m)]
                m, n, exact = m[once], n[once], exact[once]
                order = np.lexsort((v[n], exact, m))
                m, n, exact = m[order], n[order], exact[order]
                top = np.arange(len(m)) - np.searchsorted(m, m) < neighbours
                out.append((q[s + m[top]], v[n[top]], exact[top]))
        x, y, z = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(x, pa.int64()), "vec_id": pa.array(y, pa.int64()), "score": pa.array(z, pa.float64())})

    near = asked.groupBy("page", "part").cogroup(held.groupBy("page", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 100 = 0"))


# Near duplicates ----------------------------------------------------------------------------------


def robust_prune(x: np.ndarray, radius: float, alpha: float = 1.1, block: int = 256, pool: int = 24, far: int = 16) -> np.ndarray:
    """Out-neighbours of each row of x as (from, to) pairs. Candidates are the `pool` nearest rows, all
    within `radius` and `far` rows from anywhere, which join clusters that lie apart; going by distance, one stays unless a kept one is more than alpha times closer to it
    than the row is. The degree has no bound, so from any row p each row y within radius of it can
    be reached by neighbours that come closer to y at every step. Distances are computed for `block` rows
    and their candidates at a time."""
    n = len(x)
    edges, flat = [np.zeros((0, 2), np.int64)], x.astype(np.float32)
    norm, rng = (flat * flat).sum(1), np.random.default_rng(n)
    for a in range(0, n, block):
        rows = np.arange(a, min(a + block, n))
        left = norm[rows, None] + norm - 2 * (flat[rows] @ flat.T)
        np.maximum(left, 0, out=left)
        left[np.arange(len(rows)), rows] = np.inf
        width = min(n - 1, max(pool, int((left <= radius * radius * (1 + 1e-5) + 1e-6).sum(axis=1).max())))  # all within the radius too
        if width < 1:
            continue
        names = np.argpartition(left, width - 1, axis=1)[:, :width]
        names = np.concatenate([names, np.broadcast_to(rng.integers(0, n, far), (len(rows), far))], 1)
        left = np.take_along_axis(left, names, 1)
        few = max(1, (1 << 22) // width**2)
        for c in range(0, len(rows), few):  # distances among the candidates of some rows
            mine, some = left[c : c + few], flat[names[c : c + few]]
            size = norm[names[c : c + few]]
            apart = some @ some.transpose(0, 2, 1)
            apart *= -2
            apart += size[:, :, None]
            apart += size[:, None, :]
            apart *= alpha * alpha
            every = np.arange(len(mine))
            while len(every):  # of each row the nearest candidate that is left
                j = mine[every].argmin(axis=1)
                live = np.isfinite(mine[every, j])
                every, j = every[live], j[live]
                edges.append(np.stack([rows[c + every], names[c + every, j]], 1))
                rest = mine[every]
                rest[apart[every, j] < rest] = np.inf
                rest[np.arange(len(every)), j] = np.inf
                mine[every] = rest
    return np.concatenate(edges)


def as_matrix(edges: np.ndarray, n: int) -> np.ndarray:
    """Out-neighbours of n rows as a matrix that is filled up with the row itself."""
    edges = np.unique(edges, axis=0)
    degree = np.bincount(edges[:, 0], minlength=n)
    out = np.repeat(np.arange(n)[:, None], max(1, int(degree.max(initial=1))), axis=1)
    out[edges[:, 0], np.arange(len(edges)) - np.repeat(np.cumsum(degree) - degree, degree)] = edges[:, 1]
    return out


def walk(q: np.ndarray, x: np.ndarray, graph: np.ndarray, start: int, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, squared distance) nearest to each q that a greedy search from `start` meets: it looks at the
    neighbours of its `beam` nearest rows until these stay the same."""
    flat, asked = x.astype(np.float32), q.astype(np.float32)
    half = (flat * flat).sum(1) / 2
    every = np.arange(len(q))
    at = np.full((len(q), beam), -1)
    far = np.full((len(q), beam), np.inf, np.float32)  # half the squared distance, less what is the same for all rows
    at[:, 0], far[:, 0] = start, half[start] - asked @ flat[start]
    done = np.zeros((len(q), beam), bool)
    while len(every):
        names, dist, seen = at[every], far[every], done[every]
        open_ = np.where(seen, np.inf, dist)
        k = open_.argmin(1)
        go = np.isfinite(open_[np.arange(len(every)), k])
        every, names, dist, seen, k = every[go], names[go], dist[go], seen[go], k[go]
        if not len(every):
            break
        seen[np.arange(len(every)), k] = True
        ahead = graph[names[np.arange(len(every)), k]]
        d = half[ahead] - (flat[ahead] @ asked[every][:, :, None])[..., 0]
        for j in range(beam):
            d[ahead == names[:, j, None]] = np.inf
        d[:, 1:][ahead[:, 1:] == ahead[:, :-1]] = np.inf  # a row fills its list up with itself
        names, dist, seen = np.concatenate([names, ahead], 1), np.concatenate([dist, d], 1), np.concatenate([seen, np.zeros(ahead.shape, bool)], 1)
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(every))[:, None]
        at[every], far[every], done[every] = names[row, best], dist[row, best], seen[row, best]
    best = at[np.arange(len(q)), far.argmin(1)] if len(q) else np.zeros(0, np.int64)
    return best, ((q - x[best]) ** 2).sum(1)


def range_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, radius: float, own: np.ndarray, block: int = 128):
    """(query, row, squared distance) of all rows of x within radius of each q, all of unit length;
    own[i] is the row that is q[i] itself, or -1.

    A greedy search from the medoid comes to a row near q. It has arrived if no row can be nearer: at a
    row equal to q. For the queries that have not, the start is their own row, or their nearest one by a
    scan if they are no row. From the start, at distance e, the search expands over rows within
    e + 2 * radius. With e up to radius, on a graph of robust_prune() for twice the radius, that misses
    nothing: each row y within radius of q is reached by rows that come ever closer to y, and so
    stay within e + 2 * radius of q. With a larger e there is no such y."""
    medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    width = graph.shape[1]
    for a in range(0, len(q), block):
        part, rows = q[a : a + block], own[a : a + block]
        at, best = walk(part, x, graph, medoid)
        lost = best > 1e-12
        at = np.where(lost & (rows >= 0), rows, at)
        if (stray := np.flatnonzero(lost & (rows < 0))).size:
            at[stray] = distances(part[stray], x).argmin(1)
        best = ((part - x[at]) ** 2).sum(1)
        limit = (np.sqrt(best) + 2 * radius) ** 2 * (1 + 1e-9) + 1e-12
        seen = np.zeros((len(part), len(x)), bool)
        who, node = np.arange(len(part)), at
        seen[who, node] = True
        hits = []
        while len(who):
            ahead = []
            for b in range(0, len(who), 8192):
                w, v = who[b : b + 8192], node[b : b + 8192]
                d = ((part[w] - x[v]) ** 2).sum(1)
                inside = d <= radius * radius * (1 + 1e-9) + 1e-12
                hits.append((w[inside] + a, v[inside], d[inside]))
                go = np.flatnonzero(d <= limit[w])
                step = max(1, (1 << 20) // width)
                for c in range(0, len(go), step):
                    u, y = np.repeat(w[go[c : c + step]], width), graph[v[go[c : c + step]]].ravel()
                    fresh = np.flatnonzero(~seen[u, y])
                    u, y = u[fresh], y[fresh]
                    seen[u, y] = True
                    code = np.unique(u * len(x) + y)
                    ahead.append((code // len(x), code % len(x)))
            who, node = (np.concatenate(z) for z in zip(*ahead)) if ahead else (np.zeros(0, np.int64),) * 2
        yield tuple(np.concatenate(z) for z in zip(*hits))


def local_roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in the component of each node, for links a-b between positions of ids."""
    root = ids.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            return root


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def _own_places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each of `ids` is in `of`, or -1."""
    if not len(of):
        return np.full(len(ids), -1)
    order = np.argsort(of, kind="stable")
    place = order[np.minimum(np.searchsorted(of[order], ids), len(of) - 1)]
    return np.where(of[place] == ids, place, -1)


def _flat_graph_links(classes: DataFrame, centroids: np.ndarray, threshold: float, share: float, part_rows: int) -> DataFrame:
    """Rows (id, links, null) with the links that a class has in its home shard, and (id, null, root).

    share is how much of the link radius the overlap of shards covers in the direction between two centroids."""
    radius = float(np.sqrt(max(2 - 2 * threshold, 0)))
    apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2))

    def assign(batches):
        for b in batches:
            x = _unit(matrix(b.column("embedding")))
            if not len(x):
                continue
            near = x @ centroids.T
            home = near.argmax(1)
            below = near.max(1, keepdims=True) - near
            inside = below <= share * radius * apart[home] + 1e-9
            if len(centroids) > 1:  # and the second nearest, so that every two shards that meet share rows
                inside[np.arange(len(x)), np.argpartition(-near, 1, axis=1)[:, 1]] = True
            row, shard = np.nonzero(inside)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("label").take(at), pa.array(shard, pa.int64()), pa.array(home[row] == shard), b.column("id").take(at), b.column("rows").take(at), b.column("embedding").take(at)], names=["label", "shard", "home", "id", "rows", "embedding"])

    members = store(classes.mapInArrow(assign, "label int, shard long, home boolean, id long, rows long, embedding array<double>"), "shards")
    size = members.groupBy("label", "shard").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    members = store(members.join(size, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))), "shard-parts")

    def build(key, table):
        ids = table.column("id").to_numpy()
        edges = robust_prune(_unit(matrix(table.column("embedding").combine_chunks())), 2 * radius)
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        degree = np.bincount(edges[:, 0], minlength=len(ids))
        near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(degree))).astype(np.int32)), pa.array(ids[edges[:, 1]], pa.int64()))
        return pa.table({"label": table.column("label"), "id": table.column("id"), "near": near})

    lists = members.select("label", "shard", "part", "id", "embedding").groupBy("label", "shard", "part").applyInArrow(build, "label int, id long, near array<long>")
    # the flat graph: the union of a class's lists over its shards
    graph = store(lists.groupBy("label", "id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "flat-graph")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    held = members.join(graph, ["label", "id"]).select("label", "shard", "part", every.alias("asking"), "id", "rows", "embedding", "near")
    asked = members.where("home").select("label", "shard", every.alias("part"), F.col("part").alias("asking"), "id", "embedding")
    asked = asked.toDF(*asked.columns)  # fresh attributes: both sides come from one table

    def meet(key, left, right):
        ids = [t.column("id").to_numpy() for t in (left, right)]
        found = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(ids[0]) or not len(ids[1]):
            return found
        q, x = (_unit(matrix(t.column("embedding").combine_chunks())) for t in (left, right))
        rows = right.column("rows").to_numpy()
        lists = right.column("near").combine_chunks()
        to = _own_places(lists.flatten().to_numpy(zero_copy_only=False), ids[1])  # of the flat graph, the edges inside this shard
        edges = np.stack([np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), to], 1)
        graph = as_matrix(edges[to >= 0], len(x))
        own = _own_places(ids[0], ids[1])
        own = np.where((own >= 0) & (q == x[own]).all(axis=1), own, -1)
        links, a, b = np.zeros(len(q), np.int64), [], []
        for who, node, _ in range_search(q, x, graph, radius, own):
            true = (ids[0][who] != ids[1][node]) & ((q[who] * x[node]).sum(1) >= threshold)
            who, node = who[true], node[true]
            links += np.bincount(who, weights=rows[node], minlength=len(q)).astype(np.int64)
            a.append(ids[0][who])
            b.append(ids[1][node])
        a, b = np.concatenate(a), np.concatenate(b)
        nodes = np.unique(np.concatenate([a, b]))
        root = local_roots(np.searchsorted(nodes, a), np.searchsorted(nodes, b), nodes)
        other = root != nodes
        some = links > 0
        nothing = lambda n: pa.nulls(n, pa.int64())
        return pa.table({
            "id": pa.concat_arrays([pa.array(ids[0][some]), pa.array(nodes[other])]),
            "links": pa.concat_arrays([pa.array(links[some]), nothing(int(other.sum()))]),
            "root": pa.concat_arrays([nothing(int(some.sum())), pa.array(root[other])]),
        })

    keys = ("label", "shard", "part", "asking")
    out = store(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, "id long, links long, root long"), "vector-links")
    for used in (members, graph):
        drop_stored(used)
    return out


def effective_dimension(x: np.ndarray) -> float:
    """The participation ratio of the variances of x along its principal axes."""
    v = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 if len(x) else np.zeros(1)
    return float(v.sum() ** 2 / max((v * v).sum(), 1e-300)) if v.sum() else 1.0


def near_vectors(df: DataFrame, threshold: float = 0.98, shard_rows: int = 1000, part_rows: int = 4000, spread: float = 3.0, sample: int = 8000, audit: int = 200) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for each row of df(vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in double precision, is at
    least `threshold`. Equal vectors of a label are one class that is never expanded into pairs. Every label
    has at least four shards, and as many as give about shard_rows classes each by the largest label, one
    for each centroid of a bounded sample (so at most sample / 8). A class lies in the shards of its two
    nearest centroids, and in each further one of a centroid c' that its similarity is lower to, than to its
    nearest c, by no more than `spread` standard deviations of (x - y).(c - c') for a link x-y of
    any direction: radius * |c - c'| / sqrt(effective dimension), and never more than radius * |c - c'|, beyond
    which no link reaches. Each shard becomes a robust-pruned graph; the lists that a class has in its
    shards are united by id into one flat graph, which is searched from medoids, for each class in
    its home shard, with a range expansion that loses nothing within the shard. A shard of more than
    part_rows classes is split into parts that are searched each against each, so a crowd of unequal near
    copies is spread over tasks. What goes between tasks are lists, counts and one root a class.

    An audit compares the links of `audit` classes with a full scan. audit_recall is the share that was
    found. If it is below 1, all is done again with overlaps of the full radius * |c - c'|, which lose no
    link in any data.

    Vectors that are null, zero or hold null or non-finite components, null labels and null vec_ids
    link with nothing: n_links 0, component_id their vec_id. Vectors of another length than most of
    the sample do too. Rows that share a vec_id are one node. Other columns are ignored. An empty table
    gives an empty result."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").withColumn("_row", F.monotonically_increasing_id())
    rows = store(rows, "vectors")
    good = usable(rows).where("label is not null and vec_id is not null")
    _, known = bounded_sample(good, sample)
    dim = known.shape[1] if known.size else 0
    good = good.where(F.size("embedding") == dim)
    classes = store(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("rows")), "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k = max(1, min(max(4, -(-most // shard_rows)), len(known) // 8))
    centroids = _unit(kmeans(_unit(known), k)) if k > 1 else np.ones((1, dim))
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(audit).collect()
    own, own_label, own_id = np.array([r["embedding"] for r in picked]).reshape(len(picked), dim), np.array([r["label"] for r in picked]), np.array([r["id"] for r in picked], np.int64)

    def scan(batches):
        total, asked = np.zeros(len(own_id), np.int64), _unit(own)
        for b in batches:
            x = _unit(matrix(b.column("embedding")))
            for a in range(0, len(x), 1000):
                near = (asked @ x[a : a + 1000].T >= threshold - 1e-9) & (own_label[:, None] == b.column("label").to_numpy()[a : a + 1000]) & (own_id[:, None] != b.column("id").to_numpy()[a : a + 1000])
                m, n = np.nonzero(near)
                true = (asked[m] * x[a + n]).sum(1) >= threshold
                np.add.at(total, m[true], b.column("rows").to_numpy()[a + n[true]])
        yield pa.RecordBatch.from_arrays([pa.array(own_id), pa.array(total)], names=["id", "expected"])

    share = min(1.0, spread / max(effective_dimension(_unit(known)), 1.0) ** 0.5) if len(known) else 1.0
    recall = 1.0
    while True:
        found = _flat_graph_links(classes, centroids, threshold, share, part_rows)
        counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
        if len(own_id):
            true = classes.mapInArrow(scan, "id long, expected long").groupBy("id").agg(F.sum("expected").alias("expected"))
            r = true.join(counts, "id", "left").agg(F.sum("expected"), F.sum(F.least(F.col("expected"), F.coalesce("links", F.lit(0))))).first()
            recall = r[1] / r[0] if r[0] else 1.0
        if recall >= 1 or share >= 1:
            break
        share = 1.0
        drop_stored(found)
    of = components(found.where("root is not null"), "id", "root")
    copies = classes.where("rows > 1").select("label", "embedding", F.col("id").alias("_id"), "rows")
    named = good.join(copies, ["label", "embedding"], "left").select("_row", "vec_id", F.coalesce("_id", "vec_id").alias("id"), (F.coalesce("rows", F.lit(1)) - 1).alias("same"))
    named = named.join(counts, "id", "left").join(of, "id", "left").select("_row", "vec_id", (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rest = rows.join(good.select("_row"), "_row", "left_anti").select("_row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.union(rest)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
), g AS (SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.w, r.c FROM r JOIN l ON l.u = r.n
), m AS (SELECT n, min(c) AS c FROM r GROUP BY 1)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.u = e.vec_id) AS BIGINT) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept, 1e0 AS audit_recall
FROM embeddings e JOIN m ON m.n = e.vec_id
"""
