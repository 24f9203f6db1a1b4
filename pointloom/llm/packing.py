"""Vector best-fit packing of token pieces into fixed-length sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, store
from .tokens import default_tokenizer, encoded, encoder_for


TABLE_WORDS = 200_000  # what packing's tokenizer may hold of distinct words, beside two heaps in one executor


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. The attention cost of a piece is its length squared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, length: int = 2048, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each whole text of docs(doc_id, text) with the
    end id, cut every `length` ids. ids are little-endian unsigned 32-bit integers. A null text is
    empty; rows repeated in the input are repeated in the output; other columns are ignored."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encoder = encoder_for(path, table_words)
        for keys, ids, n in encoded(batches, encoder, end_id):
            count = -(-n // length)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            size = np.minimum(n[doc] - start, length)
            first = 4 * ((np.cumsum(n) - n)[doc] + start)
            data = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[d] for d in doc], pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                    pa.array([data[a : a + 4 * s] for a, s in zip(first.tolist(), size.tolist())], pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        if table_words <= TABLE_WORDS:  # between tasks a lean worker keeps the common words alone
            encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(cut), "doc_id long, piece int, start long, length long, ids binary")


def plan_packing(counts: dict[int, int], capacity: Capacity = Capacity(), rule: str = "dot") -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first sequence, items a sequence, first offset) that place
    counts[length] pieces of each length; pieces of one length are alike in every dimension.

    Lengths go down; bins in the same state (residual tokens, documents, attention) are handled as
    one with a multiplicity. Of the bins that keep every constraint, `dot` takes the largest
    weighted dot product of the piece's demand and the bin's used share (weights: each dimension's
    total demand over its capacity), `norm` the smallest weighted residual norm; ties go to fewer
    residual tokens. A bin then takes as many pieces of the length as fit."""
    cap = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    demand = np.array([[n, 1, n * n] for n in counts], float).reshape(-1, 3)
    total = (demand * np.array(list(counts.values()), float).reshape(-1, 1)).sum(0) / cap
    weight = total / max(total.sum(), 1e-300)
    least = min(counts, default=1)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residuals: runs of (first sequence, how many)
    runs, fresh = [], 0
    for n in sorted(counts, reverse=True):
        if n < 1 or n > capacity.tokens or n * n > capacity.attention:
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        rank, left, need = 0, counts[n], np.array([n, 1, n * n], float)
        while left:
            open_bins = [s for s in states if s[0] >= n and s[1] >= 1 and s[2] >= n * n]
            if open_bins:
                rest = np.array(open_bins, float)
                if rule == "dot":
                    score = ((1 - rest / cap) * (need / cap) * weight).sum(1)
                else:
                    score = -(weight * ((rest - need) / cap) ** 2).sum(1)
                s = open_bins[max(range(len(open_bins)), key=lambda i: (round(score[i], 12), -open_bins[i][0], -open_bins[i][1], -open_bins[i][2]))]
                first, many = states[s].pop()
                if not states[s]:
                    del states[s]
            else:
                s, many = (capacity.tokens, capacity.documents, capacity.attention), left
                first = fresh
            each = min(s[0] // n, s[1], s[2] // (n * n), left)
            bins = min(many, left // each)
            if not open_bins:
                fresh += bins
                many = bins
            runs.append((n, rank, bins * each, first, each, capacity.tokens - s[0]))
            rank, left = rank + bins * each, left - bins * each
            after = (s[0] - each * n, s[1] - each, s[2] - each * n * n)
            if after[0] >= least and after[1] >= 1:
                states.setdefault(after, []).append((first, bins))
            if many > bins:
                states.setdefault(s, []).append((first + bins, many - bins))
    return runs


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), order: tuple[str, ...] = ("doc_id", "piece"), rule: str = "dot", group_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, ...). Other columns, of any name, are carried; only
    columns named sequence_id or offset are replaced.

    Only the histogram of lengths, at most capacity.tokens rows, goes to the driver, where
    plan_packing() lays all bins out in runs. A piece's rank among those of its length comes from
    sub-groups of about group_rows pieces, so a length that most pieces share is spread over tasks.
    Ties of the `order` columns, nulls in them and repeated rows are pieces like any others; which of
    equal pieces comes first is open. A null length or one that fits no sequence is a ValueError; an
    empty table gives an empty result."""
    spark = pieces.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset"))).alias("row")
    rows = pieces.select(row, F.col("length").cast("long").alias("length"), F.struct(*order).alias("key"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    groups = spark.createDataFrame([(n, -(-c // group_rows)) for n, c in counts.items()], "length long, groups long")
    salted = rows.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("groups"))).drop("groups")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    runs = spark.createDataFrame(
        [(n, a, a + k, s, e, o) for n, a, k, s, e, o in plan_packing(counts, capacity, rule)],
        "length long, low long, high long, first long, each long, at long",
    )
    # each sub-group's first rank with the runs that reach it
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    reach = before.join(runs, "length").where("low < before + n and high > before")
    reach = store(reach.groupBy("length", "salt").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("low", "high", "first", "each", "at"))).alias("runs")), "pack-runs")
    in_group = Window.partitionBy("length", "salt").orderBy("key")
    ranked = salted.withColumn("rank", F.row_number().over(in_group) - 1).join(reach, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rank"))
    hit = F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    ranked = ranked.withColumn("run", hit).withColumn("k", F.col("rank") - F.col("run.low"))
    placed = ranked.select(
        "row",
        (F.col("run.first") + F.floor(F.col("k") / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod(F.col("k"), F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    )
    return placed.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tag: str, table_words: int = TABLE_WORDS) -> DataFrame:
    pieces = token_pieces(docs, table_words=table_words).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    pieces = store(pieces, tag)
    return pack(pieces, order=("doc_id", "piece", "ids_crc32"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "pieces", 800_000)  # no other operator's memory lies in its workers
