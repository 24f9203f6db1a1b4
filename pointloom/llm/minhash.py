"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, drop_stored, maybe_in, released, split_words, store
from .tokens import slices

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """The sets of texts' distinct k-word shingles as sorted 64-bit hashes. Words are runs of
    anything but \\x20 and \\x09-\\x0D after lower-casing A-Z; fewer than k words are one shingle."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, texts: pa.Array):
        at, words, counts = split_words(texts, lower=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[at] if words else np.zeros(0, np.uint64)
        end = 0
        for n in counts.tolist():
            h, end = hashes[end : end + n], end + n
            if not n:
                yield h
                continue
            k = min(self.k, n)
            out = np.full(n - k + 1, np.uint64(k), np.uint64)
            for j in range(k):
                out = (out ^ h[j : n - k + 1 + j]) * _M3
                out ^= out >> np.uint64(29)
            yield np.unique(_mix(out))


class Signer:
    """`trees` orders of `depth` MinHash values each, as big-endian bytes, so that bytes sort as values do."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = trees * depth
        self.xor = rng.integers(0, 1 << 63, n, np.uint64)
        self.mul = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> bytes:
        low = np.full(len(self.xor), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(shingles), 512):
            x = shingles[None, a : a + 512] ^ self.xor[:, None]
            x *= self.mul[:, None]
            np.minimum(low, x.min(axis=1), out=low)
        return (low >> np.uint64(32)).astype(">u4").tobytes()


COUNT_BITS = 21


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def sampled_counts(texts: DataFrame, k: int, sample: int) -> np.ndarray:
    """How many of `sample` rows of texts(id, text), picked by id, hold a shingle of each hash bucket. It
    only makes an order in which common shingles come last; any other would give the same links."""
    picked = texts.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()

    def count(batches):
        shingler, total = Shingler(k), np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for s in sets(shingler, batch.column("text")):
                total[_bucket(s)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.join(F.broadcast(picked), "id", "left_semi").select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.uint16)
    out[found.column("bucket").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.uint16).max)
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent * n / 100) + 1 shingles in the order of sampled counts and hashes, as
    32 bits each: of two sets that link, the first shingle they share in that order is in both prefixes."""
    most = len(shingles) - -(-percent * len(shingles) // 100) + 1
    return shingles[np.argsort(counts[_bucket(shingles)], kind="stable")[:most]].astype("<u4")


FOLDED = 8  # words of 64 bits that go with each shingle of a prefix


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each hash bucket whether it holds an odd number of shingles, as bytes. Where two sets' bits
    differ, at least one shingle is in only one of them. Twice as many buckets as shingles, a power of
    two and at least FOLDED words."""
    size = 1 << max((64 * FOLDED).bit_length() - 1, (2 * len(shingles) - 1).bit_length())
    held = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits(held & 1)


def signatures(docs: DataFrame, k: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, n, h1, h2, sig): set size, a 128-bit BLAKE2 digest of the sorted set, the signature."""

    def sign(batches):
        shingler, signer = Shingler(k), Signer(trees, depth)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for a, b in slices(texts):
                rows = []
                for s in shingler(texts.slice(a, b - a)):
                    h1, h2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    rows.append((len(s), h1, h2, signer(s) if len(s) else None))
                n, h1, h2, sig = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(sign), "doc_id long, n long, h1 long, h2 long, sig binary")


def tree_rows(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """(tree, key, id, n): each row of rows(id, n, sig) in every tree."""
    width = 4 * depth
    each = rows.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return each.select("tree", F.substring("sig", F.col("tree") * width + 1, F.lit(width)).alias("key"), "id", "n")


def _arrays(batch: pa.RecordBatch, depth: int) -> tuple[np.ndarray, ...]:
    key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, depth).astype(np.int64)
    return batch.column("tree").to_numpy().astype(np.int64), key, batch.column("id").to_numpy(), batch.column("n").to_numpy()


_EDGE = 99  # a common prefix that is not known, because the other row is in another task
BLOCK_ROWS = 50_000


def _runs(lcp: np.ndarray, at: np.ndarray, window: int, forward: bool) -> np.ndarray:
    """(window + 1, rows): the common prefix of each row `at` with the w-th row after or before it, from
    the common prefixes lcp[i] of rows i - 1 and i."""
    out, m = np.empty((window + 1, len(at)), np.int64), np.full(len(at), _EDGE)
    for w in range(1, window + 2):
        j = at + w if forward else at - w + 1
        m = np.minimum(m, np.where((j >= 0) & (j < len(lcp)), lcp[np.clip(j, 0, len(lcp) - 1)], _EDGE))
        out[w - 1] = m
    return out


def forest_candidates(rows: DataFrame, trees: int, depth: int, least_depth: int, levels: tuple[int, ...], window: int, percent: int) -> DataFrame:
    """From rows(id, n, sig): neighbours (a, b) in the sorted orders, memberships (a, run) in regions (rows
    that share a prefix of a level's depth with a neighbour), and (a, loss).

    Each tree is one global order, range-partitioned on (tree, key, id), so rows with equal keys
    spread over tasks too. A row is compared with the `window` rows before it that share a prefix of
    least_depth values. In each region of the order the depth adapts to its density: a row's region
    is as deep as it must be for at most window + 1 rows, and then all of it has been compared. loss is what that costs: the
    logarithm of the chance that a link at the threshold is not met in this tree, less that chance at
    least_depth. A region that reaches over the end of a task's rows, or is still too large at the full
    depth, counts as not compared. Pairs whose sizes rule out the threshold are left out."""
    order = tree_rows(rows, trees, depth).repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    p = percent / 100
    miss = np.array([math.log(1 - p**d) if d else 0.0 for d in range(depth + 1)])  # by depth of the region; 0 for one not compared
    context = window + 1

    def neighbours(batches):
        held, done, first, waiting = None, 0, True, []

        def close(final: bool):
            nonlocal held, done, first, waiting
            tree, key, ids, n = (np.concatenate(x) for x in zip(*([held] if held is not None else []), *waiting))
            waiting = []
            lcp = np.zeros(len(ids) + 1, np.int64)
            lcp[1:-1] = np.cumprod(key[1:] == key[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            lcp[0], lcp[-1] = _EDGE if first else 0, _EDGE if final else 0
            at = np.arange(done, len(ids) if final else max(done, len(ids) - context))
            back, ahead = (_runs(lcp, at, window, f) for f in (False, True))
            a, b, run = [], [], []
            for w in range(1, window + 1):
                i = at[(back[w - 1] >= least_depth) & (at >= w)]
                i = i[(100 * np.minimum(n[i], n[i - w]) >= percent * np.maximum(n[i], n[i - w])) & (ids[i] != ids[i - w])]
                a.append(np.maximum(ids[i], ids[i - w]))
                b.append(np.minimum(ids[i], ids[i - w]))
            for level in levels:
                i = at[(back[0] >= level) & (at >= 1)]
                region = _mix(np.uint64(level) ^ tree[i].astype(np.uint64) * _M3)
                for j in range(level):
                    region = _mix((region ^ key[i, j].astype(np.uint64)) * _M3)
                region = region.view(np.int64)
                run.append((np.concatenate([ids[i], ids[i - 1]]), np.concatenate([region, region])))
            deep = np.zeros(len(at), np.int64)
            for d in range(depth, least_depth - 1, -1):
                deep[(back >= d).sum(axis=0) + (ahead >= d).sum(axis=0) <= window] = d
            loss = np.where(deep == least_depth, 0.0, miss[deep] - miss[least_depth])
            lost = np.flatnonzero(loss > 0)
            stay = max(0, (at[-1] + 1 if len(at) else done) - context)
            if len(at):
                first = first and stay == 0
            done = (at[-1] + 1 if len(at) else done) - stay
            held = tuple(x[stay:] for x in (tree, key, ids, n))
            a, b = np.concatenate(a), np.concatenate(b)
            m, g = (np.concatenate(x) for x in zip(*run))
            no = lambda *kinds: [pa.nulls(k, pa.int64()) for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(a), pa.array(m), pa.array(ids[at[lost]])]), pa.concat_arrays([pa.array(b), *no(len(m), len(lost))]),
                    pa.concat_arrays([*no(len(a)), pa.array(g), *no(len(lost))]), pa.concat_arrays([pa.nulls(len(a) + len(m), pa.float64()), pa.array(loss[lost])]),
                ],
                names=["a", "b", "run", "loss"],
            )

        rows_waiting = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(_arrays(batch, depth))
                rows_waiting += batch.num_rows
            if rows_waiting >= BLOCK_ROWS:
                yield from close(False)
                rows_waiting = 0
        if held is not None or waiting:
            yield from close(True)

    return order.mapInArrow(released(neighbours), "a long, b long, run long, loss double")


def crowded(found: DataFrame, trees: int, least_depth: int, percent: int, miss: float) -> DataFrame:
    """(id) of the rows of forest_candidates() for which a link at the threshold could stay unmet with a
    chance of more than `miss`, over all trees."""
    plain = trees * math.log(1 - (percent / 100) ** least_depth)
    return found.where("loss is not null").groupBy(F.col("a").alias("id")).agg(F.sum("loss").alias("loss")).where(F.col("loss") > math.log(miss) - plain).select("id")


def leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of each region's members with its leader: the member that shares the most regions,
    weighted by their sizes, with others. An original that many copies derive from leads its region,
    so copies that differ too much from one another still meet it; pairs grow with the members."""
    members = members.distinct()
    size = members.groupBy("run").agg(F.count("*").alias("size"))
    weight = members.join(size, "run").groupBy("a").agg(F.sum("size").alias("weight"))
    leader = members.join(weight, "a").groupBy("run").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("lead"))
    return members.join(leader, "run").where("a != lead").select(F.greatest("a", "lead").alias("a"), F.least("a", "lead").alias("b"))


def sets(shingler: Shingler, texts: pa.Array):
    for a, b in slices(texts, 2 << 20):
        yield from shingler(texts.slice(a, b - a))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full shingle sets have 100 * intersection >= percent * union."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    texts = maybe_in(texts, ["id"], needed)[0]
    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def check(batches):
        shingler = Shingler(k)
        for batch in batches:
            out = []
            left, right = (sets(shingler, batch.column(c)) for c in ("text_a", "text_b"))
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if 100 * both >= percent * union:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(released(check), "a long, b long")


def with_components(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs(a, b, ..) with c_a and c_b, their ends' components."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    return pairs


def prefixes(texts: DataFrame, k: int, counts: np.ndarray, percent: int) -> DataFrame:
    """(id, n, rare, odd) of texts(id, text): set size, the prefix and parities as bytes."""

    def make(batches):
        shingler = Shingler(k)
        for batch in batches:
            keys, column = batch.column("id"), batch.column("text")
            for a, b in slices(column):
                got = [(len(s), prefix(s, counts, percent).tobytes(), parity(s).tobytes()) if len(s) else (0, None, None) for s in shingler(column.slice(a, b - a))]
                n, rare, odd = zip(*got)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(rare, pa.binary()), pa.array(odd, pa.binary())], names=["id", "n", "rare", "odd"])

    return texts.mapInArrow(released(make), "id long, n long, rare binary, odd binary").where("n > 0").distinct()


def prefix_pairs(rows: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows(id, n, rare, odd) that share a shingle of their prefixes, are in different components
    and are not ruled out by their sizes, by how many shingles come after the shared one or by folded
    parities: all links between components are among them. Shingles whose rows are all in one
    component go first; then it is one equi-join, which adaptive execution can split at a hot shingle."""
    words = [f"p{i}" for i in range(FOLDED)]

    def shingles(batches):
        for batch in batches:
            rare = [np.frombuffer(x, "<u4") for x in batch.column("rare").to_pylist()]
            folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, FOLDED), axis=0) for x in batch.column("odd").to_pylist()]) if rare else np.zeros((0, FOLDED), np.int64)
            size = np.fromiter(map(len, rare), np.int64, len(rare))
            ends = np.cumsum(size)
            for a in range(0, len(rare), 200):
                b = min(len(rare), a + 200)
                row = np.repeat(np.arange(a, b), size[a:b])
                at = pa.array(row)
                place = np.arange(len(row)) - np.repeat(ends[a:b] - size[a:b] - (ends[a] - size[a]), size[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(rare[a:b]).view(np.int32)), batch.column("id").take(at), batch.column("component").take(at), batch.column("n").cast(pa.int32()).take(at),
                        pa.array(place.astype(np.int32)), *(pa.array(folded[row, i]) for i in range(FOLDED)),
                    ],
                    names=["shingle", "id", "component", "n", "place", *words],
                )

    named = rows.join(of, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "n", "rare", "odd")
    each = named.mapInArrow(shingles, "shingle int, id long, component long, n int, place int, " + ", ".join(f"{w} long" for w in words))
    same = Window.partitionBy("shingle")
    mixed = each.withColumn("_low", F.min("component").over(same)).withColumn("_high", F.max("component").over(same)).where("_low < _high").drop("_low", "_high")
    mixed = store(mixed, "mixed-shingles")
    x, y = mixed.alias("x"), mixed.alias("y")
    enough = F.expr(f"{100 + percent}L * least(x.n - x.place, y.n - y.place) >= {percent}L * (0L + x.n + y.n)")
    sizes = F.expr(f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n)")
    apart = F.expr(f"{100 + percent}L * (" + " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in words) + f") <= {100 - percent}L * (0L + x.n + y.n)")
    met = x.join(y, F.expr("x.shingle = y.shingle and x.id > y.id and x.component != y.component") & sizes & enough & apart)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_by_parity(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) of rows(id, n, odd) that may link: buckets of different parity are at most as many
    as the shingles in only one set, of which a link has at most (100 - percent) / (100 + percent) of both
    sizes. It spares the others' texts a shuffle."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("odd").alias(f"odd_{side}")), side)

    def check(batches):
        for batch in batches:
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("odd_a").to_pylist(), batch.column("odd_b").to_pylist())):
                least = min(len(x), len(y))  # the buckets of the larger table fold into those of the smaller one
                x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, least), axis=0) for z in (x, y))
                apart[i] = np.bitwise_count(x ^ y).sum()
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * both))

    return pairs.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(check, "a long, b long").distinct()


SALTS = 8


def _by_class(rows: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """rows joined with classes on (h1, h2), with the rows of one class dealt over SALTS tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["h1", "h2", "_salt"], how).drop("_salt")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 24, depth: int = 8, least_depth: int = 3, levels: tuple[int, ...] = (3, 8), window: int = 4, miss: float = 1e-6, sample: int = 4000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text), one row per input row.

    Documents link when 100 * intersection >= percent * union of their k-word shingle sets. Equal
    sets are one class, found by a 128-bit digest of the set and never expanded into pairs. Classes
    meet as neighbours in the forest's orders and through region leaders; each candidate is
    confirmed on full sets unless its ends are already in one component. First each class's most
    frequent candidate is confirmed, then all candidates between different components. Classes in
    regions so dense that the forest could miss a link at the threshold with a chance of more than
    `miss` go on to an exact way: a prefix-filter join among them meets every pair in different
    components that can link. Neither step depends on the number of tasks or has a cap.

    A null or blank text has an empty set and links with nothing. A text of any length is taken whole.
    Rows that share a doc_id are one node; a null doc_id links with nothing and keeps a null
    component_id. An empty table gives an empty result, and other columns of docs are ignored."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = store(signatures(docs, k, trees, depth), "signatures")
    known = rows.where("n > 0 and doc_id is not null")
    classes = store(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "classes")
    # sets that occur once go on as they are; of the others the row with the smallest doc_id does
    twice = classes.where("rows > 1").select("h1", "h2", F.col("id").alias("doc_id"))
    some, single = maybe_in(known, ["h1", "h2"], twice)
    lead = some.join(twice, ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["h1", "h2", "doc_id"])  # dealt by doc_id too
    firsts = single.unionByName(_by_class(some, twice.select("h1", "h2"), "left_anti")).unionByName(lead).select(F.col("doc_id").alias("id"), "n", "sig")
    found = store(forest_candidates(firsts, trees, depth, least_depth, levels, window, percent), "neighbours")
    dense = store(crowded(found, trees, least_depth, percent, miss), "crowded")
    pairs = found.where("b is not null").select("a", "b").union(leader_pairs(found.where("run is not null").select("a", "run")))
    pairs = store(pairs.groupBy("a", "b").agg(F.count("*").alias("seen")), "candidates")
    drop_stored(found)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    some_texts = store(maybe_in(texts, ["id"], ends)[0].join(ends, "id"), "candidate-texts")
    sided = pairs.select("a", "b", "seen", F.col("a").alias("me")).union(pairs.select("a", "b", "seen", F.col("b").alias("me")))
    best = store(sided.groupBy("me").agg(F.max_by(F.struct("a", "b"), F.struct("seen", -F.col("b"), -F.col("a"))).alias("p")).select("p.*").distinct(), "best")
    tested = store(confirm(best, some_texts, k, percent), "tested")
    of = store(components(tested, "a", "b"), "components")
    rest = store(with_components(pairs.select("a", "b"), of).where("c_a != c_b").select("a", "b").join(best, ["a", "b"], "left_anti"), "rest")
    both = store(tested.union(confirm(rest, some_texts, k, percent)), "tested")
    for used in (some_texts, best, rest, tested, of):
        drop_stored(used)
    of = store(components(both, "a", "b"), "components")
    of, both, used = _exact_links(texts, dense, of, both, pairs, k, percent, sample)
    for u in (*used, dense, pairs, both):
        drop_stored(u)
    named = classes.join(of, "id", "left").select("h1", "h2", "rows", "id", F.coalesce("component", "id").alias("component"))
    named = named.where("rows > 1 or component != id").select("h1", "h2", "component")
    plain = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = _by_class(known.select("doc_id", "n", "h1", "h2"), named, "left")
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).union(plain)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _exact_links(texts: DataFrame, dense: DataFrame, of: DataFrame, tested: DataFrame, pairs: DataFrame, k: int, percent: int, sample: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(components, links, tables that may go) after the prefix-filter join among the dense rows."""
    if not dense.limit(1).count():
        return of, tested, []
    some = store(maybe_in(texts, ["id"], dense)[0].join(dense, "id"), "dense-texts")
    rows = store(prefixes(some, k, sampled_counts(some, k, sample), percent), "prefixes")
    met = prefix_pairs(rows, of, percent).join(pairs.join(dense.select(F.col("id").alias("a")), "a").select("a", "b"), ["a", "b"], "left_anti")
    missed = store(near_by_parity(store(met, "met"), rows, percent), "missed")
    more = store(tested.union(confirm(missed, some, k, percent)), "tested")
    return store(components(more, "a", "b"), "components"), more, [some, rows, missed, tested, of]


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
