"""Odometry and maps as Structured Streaming state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import odometry as O
from ..operators.maps import VoxelMapParams
from ..functions import expr as E


def stream_odometry(rows: DataFrame, params: O.OdometryParams | None = None, inertial: bool = False) -> DataFrame:
    """Poses of a stream of rows(stream_id, ts, frame_id, point_id, x, y, z, .. , gx .. az). The state of
    a stream_id is its whole estimator; a batch must hold whole frames, late ones are refused."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = pickle.loads(state.get[0]) if state.exists else (O.LidarInertialOdometry if inertial else O.LidarOdometry)(params)
        made = O.fold(run, pd.concat(list(parts)))
        state.update((pickle.dumps(run),))
        yield pd.DataFrame([{"stream_id": key[0], **r} for r in made], columns=["stream_id", *(c.split()[0] for c in O.POSES.split(", "))])

    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id bigint, " + O.POSES, "estimator binary", "append", GroupStateTimeout.NoTimeout)


def stream_voxel_map(points: DataFrame, p: VoxelMapParams, state_path: str, checkpoint: str):
    """Starts a query that folds each batch of points(frame_id, x, y, z) into the voxel table under
    state_path, one version a batch; a batch that is run again writes the same version again."""
    from ..operators import maps

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{state_path}/v{number - 1}") if number else maps.empty_map(spark)
        maps.voxel_insert(old, batch, number + 1, p).write.mode("overwrite").parquet(f"{state_path}/v{number}")

    return points.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_occupancy_counts(points: DataFrame, size: float, delay: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """Points a voxel and event-time window, with late points dropped after `delay`: ts is a timestamp."""
    keyed = points.withWatermark("ts", delay).withColumn("key", E.voxel_key(size)).where("key is not null")
    return keyed.groupBy(F.window("ts", window), "key").agg(F.count("*").alias("n")).select("window.start", "key", "n")
