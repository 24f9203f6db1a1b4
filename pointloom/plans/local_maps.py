"""The maps of operators.maps as sorted arrays, for folds that keep one stream's map in a task."""

from __future__ import annotations

import math

import numpy as np

from ..functions import lie
from ..functions.expr import KEY_BITS, KEY_OFFSET
from ..functions.udfs import cell_keys, ray_cells
from ..operators.maps import OccupancyParams, VoxelMapParams
from ..operators.registration import Cloud


def voxel_keys(xyz: np.ndarray, size: float) -> np.ndarray:
    """Packed keys, -1 for points that have none."""
    ok = np.isfinite(xyz).all(1)
    c = np.floor(np.where(ok[:, None], xyz, 0) * (1 / size))
    ok &= ((c + KEY_OFFSET >= 0) & (c + KEY_OFFSET < 1 << KEY_BITS)).all(1)
    c = np.where(ok[:, None], c + KEY_OFFSET, 0).astype(np.int64)
    return np.where(ok, c[:, 0] | c[:, 1] << KEY_BITS | c[:, 2] << (2 * KEY_BITS), -1)


class LocalMap:
    """Columns keyed by voxel: point count, coordinate sums, log covariance sums, intensity sum."""

    WIDTH = 12

    def __init__(self):
        self.key, self.sums = np.zeros(0, np.int64), np.zeros((0, self.WIDTH))
        self.updated, self.log_odds = np.zeros(0, np.int64), np.zeros(0)

    def _add(self, key: np.ndarray, rows: np.ndarray, when: int) -> None:
        new, at = np.unique(np.concatenate([self.key, key]), return_inverse=True)
        sums, updated, odds = np.zeros((len(new), self.WIDTH)), np.zeros(len(new), np.int64), np.zeros(len(new))
        n = len(self.key)
        sums[at[:n]], updated[at[:n]], odds[at[:n]] = self.sums, self.updated, self.log_odds
        np.add.at(sums, at[n:], rows)
        updated[at[n:]] = when
        self.key, self.sums, self.updated, self.log_odds = new, sums, updated, odds

    def _keep(self, flag: np.ndarray) -> None:
        self.key, self.sums, self.updated, self.log_odds = self.key[flag], self.sums[flag], self.updated[flag], self.log_odds[flag]

    @staticmethod
    def _rows(cloud: Cloud) -> np.ndarray:
        out = np.zeros((len(cloud), LocalMap.WIDTH))
        out[:, 0], out[:, 1:4] = 1, cloud.xyz
        if cloud.cov is not None:
            out[:, 4:10] = lie.packed(lie.spd_log(cloud.cov))
        if cloud.intensity is not None:
            out[:, 10] = cloud.intensity
        out[:, 11] = float(cloud.cov is not None)
        return out

    def _cloud(self, flag: np.ndarray) -> Cloud:
        s = self.sums[flag]
        m = s / np.maximum(s[:, :1], 1)
        cov = lie.spd_exp(lie.symmetric(m[:, 4:10])) if len(s) and s[:, 11].any() else None
        return Cloud(m[:, 1:4], cov, None, None, m[:, 10])


class LocalVoxelMap(LocalMap):
    def __init__(self, p: VoxelMapParams):
        super().__init__()
        self.p, self.counter = p, 0

    def add(self, cloud: Cloud, pose: np.ndarray) -> None:
        moved = cloud.moved(pose)
        key = voxel_keys(moved.xyz, self.p.size)
        self.counter += 1
        self._add(key[key >= 0], self._rows(moved)[key >= 0], self.counter)
        if self.counter % self.p.evict_every == 0 and self.counter > self.p.stale_after:
            self._keep(self.updated >= self.counter - self.p.stale_after)

    def extract(self, centre: np.ndarray, distance: float, least: int = 1) -> Cloud:
        n = self.sums[:, 0]
        mean = self.sums[:, 1:4] / np.maximum(n, 1)[:, None]
        return self._cloud((n >= least) & (np.abs(mean - centre) <= distance).all(1))


class LocalOccupancy(LocalMap):
    def __init__(self, p: OccupancyParams):
        super().__init__()
        self.p, self.frame = p, 0

    def add(self, cloud: Cloud, pose: np.ndarray) -> None:
        moved, s, p = cloud.moved(pose), pose[:3, 3], self.p
        key = voxel_keys(moved.xyz, p.size)
        self.frame += 1
        change: dict[int, float] = {}
        for k, n in zip(*np.unique(key[key >= 0], return_counts=True)):
            change[int(k)] = n * p.hit
        if p.carve:
            own = voxel_keys(s[None], p.size)[0]
            hit_own = (key == own).any()
            for q, k in zip(moved.xyz, key):
                if k < 0 or ((q - s) ** 2).sum() <= np.finfo(np.float32).eps:
                    continue
                if not hit_own and k != own and own >= 0:
                    change[int(own)] = change.get(int(own), 0.0) + p.miss
                for c in cell_keys(ray_cells(s, q, p.size)):
                    change[int(c)] = change.get(int(c), 0.0) + p.miss
        self._add(key[key >= 0], self._rows(moved)[key >= 0], self.frame)
        touched = np.array(sorted(change), np.int64)
        self._add(touched, np.zeros((len(touched), self.WIDTH)), self.frame)
        at = np.searchsorted(self.key, touched)
        self.log_odds[at] = np.clip(self.log_odds[at] + [change[int(k)] for k in touched], p.low, p.high)
        if self.frame >= p.stale_after:
            self._keep(self.frame - self.updated <= p.stale_after)

    def extract(self, centre: np.ndarray, distance: float, least: int = 1) -> Cloud:
        n = self.sums[:, 0]
        mean = self.sums[:, 1:4] / np.maximum(n, 1)[:, None]
        limit = math.log(self.p.probability / (1 - self.p.probability))
        return self._cloud((n > 0) & (self.log_odds >= limit) & (np.abs(mean - centre).max(1) <= distance))
