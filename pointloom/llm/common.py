"""Shared folder, written intermediate tables and distributed connected components."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path, shared_dir  # noqa: F401


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut, and a lost
    executor costs no more than the tasks that were running on it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that store() wrote, once nothing reads it any more."""
    path = getattr(df, "stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Gives memory that Arrow and malloc keep for later back to the system: a Python worker goes on from
    task to task and would hold the peak of each kind of task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


def released(task):
    """A task for mapInArrow that ends with release()."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of an Arrow string array: runs of anything but \\x20 and \\x09-\\x0D. For each word in order
    its place in a list of words, that list (distinct before A-Z are lower-cased), and how many words each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    at, ends = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    if lower:  # not by Arrow's ascii_lower, which reads slices of cast arrays from the wrong place
        words = list(map(bytes.lower, words))
    if (blank := np.array([not w for w in words], bool)).any():  # beside white space at the ends of a text
        stay = ~blank[at]
        ends, at = np.concatenate(([0], np.cumsum(stay)))[ends], at[stay]
    return at, words, np.diff(ends)


FILTER_BITS = 1 << 24


def maybe_in(df: DataFrame, keys: list[str], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have their keys in `known`, rows that surely have not), without a shuffle of df.

    A bitmap of FILTER_BITS hashed keys stands for `known`: at most FILTER_BITS / 64 rows of 64 bits, which
    is what is broadcast, whatever the number of keys. Both parts come from one left join with it."""
    at = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    words = known.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("_bit"))
    words = store(words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bitmap")
    marked = df.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word", "left")
    hit = F.expr("coalesce(shiftright(_bits, cast(_at & 63 as int)) & 1L, 0L) = 1L")
    return tuple(marked.where(c).select(*df.columns) for c in (hit, ~hit))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that an edge names and that is not itself the smallest of its
    component; component is the smallest id reachable.

    Alternating large-star and small-star rounds: every round moves each edge towards the smallest
    neighbour, by an aggregate (combined before the shuffle) and an equi-join that adaptive
    execution can split at a hot node. Rounds grow with the logarithm of a component's diameter.
    No edge goes to the driver; null ids and loops are ignored."""
    e = store(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "edges",
    )
    seen = _signature(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        big = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = store(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_stored(e)
        e, before, seen = out, seen, _signature(out)
        if seen == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
