"""Mixing sources to target weights: a temperature on token shares, realised by block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, store


def count_words(text: Column) -> Column:
    """Tokens of a text: its runs of anything but \\x20 and \\x09-\\x0D. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


# The weight of a source depends on its tokens alone, so what goes to the driver is a histogram: how many
# sources have each number of tokens. Distinct numbers are at most the square root of twice all tokens.


def tempered(sources: dict[int, int], exponent: float) -> dict[int, float]:
    """Normalised weight of a source with each number of tokens, from {tokens: sources}: token shares to a
    power. Sources without tokens have weight 0."""
    total = sum(n * k for n, k in sources.items())
    raw = {n: (n / total) ** exponent if n else 0.0 for n in sources}
    norm = math.fsum(raw[n] * k for n, k in sources.items())
    return {n: x / norm if norm else 0.0 for n, x in raw.items()}


def entropy(sources: dict[int, int], weights: dict[int, float]) -> float:
    return -math.fsum(k * weights[n] * math.log(weights[n]) for n, k in sources.items() if weights[n])


def spread(weights: dict[int, float]) -> float:
    """How often the most repeated source is seen for each time that the least repeated one is."""
    rates = [w / n for n, w in weights.items() if n]
    return max(rates) / min(rates) if rates else 1.0


def find_exponent(sources: dict[int, int], target_entropy: float | None, repeat_limit: float, rounds: int = 60) -> float:
    """The exponent in [0, 1] nearest to 1 at which the weights reach target_entropy, a share of the
    greatest entropy, and not below the smallest at which no source repeats more than repeat_limit
    times as often as another: both are monotone in the exponent, so each is bisected."""
    live = {n: k for n, k in sources.items() if n}
    if sum(live.values()) < 2:
        return 1.0
    most = math.log(sum(live.values()))

    def bisect(holds, low: float, high: float) -> tuple[float, float]:
        """Narrows [low, high], where holds() is true at low and false at high."""
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low, high

    even = lambda x: entropy(live, tempered(live, x)) >= target_entropy * most
    wanted = 0.0 if target_entropy is None else 1.0 if even(1.0) else bisect(even, 0.0, 1.0)[0]
    tight = lambda x: spread(tempered(live, x)) > repeat_limit
    return wanted if not tight(wanted) else bisect(tight, wanted, 1.0)[1]


def quotas(sources: dict[int, int], weights: dict[int, float], budget: int | None = None) -> tuple[int, dict[int, int]]:
    """(budget, tokens to draw of a source with each number of tokens). Without a budget it is the smallest
    that draws every source at least once, so that no document is lost."""
    rates = {n: weights[n] / n for n in sources if n}
    if not rates:
        return 0, {n: 0 for n in sources}
    if budget is None:
        budget = math.ceil(1 / min(rates.values()) - 1e-6)
        return budget, {n: max(n, round(weights[n] * budget)) if n else 0 for n in sources}
    return budget, {n: round(weights[n] * budget) for n in sources}


ADDED = ("tokens", "weight", "copies", "blocks")


def mix(docs: DataFrame, target_entropy: float | None = None, repeat_limit: float = 2.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...) with columns tokens, weight, copies (how often each row is drawn) and
    blocks: the output block of each drawing, in order.

    Each source draws its quota by epochs, each a permutation of its own: documents fall into blocks of
    about block_tokens by a hash of row and epoch, blocks come in their order, documents in hash order.
    Whole epochs draw every row once; the last one draws the rows that begin before its remainder is
    spent, so a source overshoots its quota by less than one document (or one run of equal rows). A
    drawing's output block is its share of its source's drawn tokens, so every block holds all
    sources by their weights and about block_tokens. Only the block that the remainder ends in is
    ordered row by row, so a source that holds most rows is spread over its blocks. Each text is
    read twice: once to count, once to write.

    A null source is a source of its own. A null or blank text has no tokens: it is drawn as often as
    its source's whole epochs (once, if the source has no tokens). Repeated rows are drawn like any
    others, texts of any length count whole, an empty table stays empty. Columns of docs that clash
    with the added ones are replaced, all others are kept."""
    spark = docs.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED)).alias("row")
    key = [F.col("doc_id")] if "doc_id" in docs.columns else []
    rows = docs.select(row, F.coalesce(F.col("source").cast("string"), F.lit("\0null")).alias("s"), F.xxhash64(F.lit(seed), *key, F.col("text")).alias("u"), count_words(F.col("text").cast("string")).alias("tokens"))
    small = store(rows.select("s", "u", "tokens"), "mix-rows")
    sources = store(small.groupBy("s").agg(F.sum("tokens").alias("n")), "mix-sources")
    held = {int(r["n"]): int(r["k"]) for r in sources.groupBy("n").agg(F.count("*").alias("k")).collect()}
    weights = tempered(held, find_exponent(held, target_entropy, repeat_limit))
    total, quota = quotas(held, weights, budget)
    plan = []
    for n in held:
        whole, rest = divmod(quota[n], n) if n else (1, 0)
        plan.append((n, float(weights[n]), whole, rest, max(1, -(-n // block_tokens))))
    plan = sources.join(spark.createDataFrame(plan, "n long, weight double, whole long, rest long, parts long"), "n")
    # the last epoch: tokens of each of its blocks, the block that its remainder ends in, and where in it
    hashed = lambda e: F.xxhash64(F.col("u"), e)
    dealt = small.join(plan, "s").withColumn("v", hashed(F.col("whole"))).withColumn("b", F.pmod(F.col("v"), F.col("parts")))
    blocks = store(dealt.groupBy("s", "b").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest")), "mix-blocks")
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # blocks, not rows
    ends = blocks.withColumn("end", F.sum("t").over(upto)).withColumn("begin", F.col("end") - F.col("t"))
    cut = ends.where("begin < rest and end >= rest").groupBy("s").agg(F.min("b").alias("cut"), F.min_by(F.col("rest") - F.col("begin"), "b").alias("left"))
    plan = store(plan.join(cut, "s", "left"), "mix-cuts")
    edge = small.join(plan.where("cut is not null"), "s").withColumn("v", hashed(F.col("whole"))).where("pmod(v, parts) = cut")
    edge = edge.groupBy("s", "v", "left").agg(F.sum("tokens").alias("tokens"))
    edge = edge.withColumn("end", F.sum("tokens").over(Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.where(F.col("end") - F.col("tokens") < F.col("left")).groupBy("s").agg(F.max("v").alias("last"))
    plan = store(plan.join(last, "s", "left"), "mix-plan")  # a row for each source; a small one is broadcast
    for used in (small, blocks):
        drop_stored(used)
    drawn = rows.join(plan, "s").withColumn("v", hashed(F.col("whole"))).withColumn("b", F.pmod(F.col("v"), F.col("parts")))
    extra = F.coalesce((F.col("b") < F.col("cut")) | ((F.col("b") == F.col("cut")) & (F.col("v") <= F.col("last"))), F.lit(False))
    drawn = drawn.withColumn("copies", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long"))
    out_blocks = max(1, -(-total // block_tokens))
    span = F.greatest(F.col("whole") * F.col("n") + F.col("rest"), F.lit(1))

    def block(epoch: Column) -> Column:
        """The share of the source's drawn tokens that come before the row in an epoch, as a block."""
        v = hashed(epoch)
        place = (F.pmod(v, F.col("parts")) + (v / F.lit(2.0**63) + 1) / 2) / F.col("parts")
        return F.least(F.floor((epoch + place) * F.col("n") / span * out_blocks), F.lit(out_blocks - 1)).cast("long")

    every = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), block)).otherwise(F.array().cast("array<long>"))
    drawn = drawn.withColumn("blocks", every)  # by itself: beside row.* its names could mean the caller's columns
    return drawn.select("row.*", "tokens", "weight", "copies", "blocks")


def draw(mixed: DataFrame, columns: list[str], block: str | None = None) -> DataFrame:
    """Every row of mix() as often as it is drawn; with `block`, a column of that name holds each
    drawing's block."""
    each = mixed.select(*(F.col(f"`{c}`") for c in columns), F.explode("blocks").alias(block or "\0block"))
    return each if block else each.select(*(F.col(f"`{c}`") for c in columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, target_entropy=0.9).select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "copies", "blocks")
