"""Tightly coupled alignment: the scan's 6x6 factor inside a 15-state normal equation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions import lie
from . import registration as reg
from .imu import ACC, GYR, POS, ROT, VEL, State, imu_factor


@dataclass(frozen=True)
class DirectionalParams:
    enable: bool = False
    trans_least: float = 0.0
    rot_least: float = 0.0
    trans_weak: float = 0.0
    rot_weak: float = 0.0


@dataclass(frozen=True)
class LioParams:
    iterations: int = 10
    auto_scale: bool = False
    init_scale: float = 10.0
    min_scale: float = 0.5
    rotation_init_scale: float = 10.0
    rotation_min_scale: float = 0.5
    levels: int = 4
    directional: DirectionalParams = field(default_factory=DirectionalParams)
    invalid_regularization: float = 1e6


@dataclass
class LioResult:
    state: State
    T: np.ndarray
    covariance: np.ndarray
    H: np.ndarray
    icp: reg.Linear
    converged: bool = False
    iterations: int = 0


def embed(icp: reg.Linear, R: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The scan's factor in the 15 states: rotation stays in the body, translation turns into the world."""
    H, b = np.zeros((15, 15)), np.zeros(15)
    turn = np.zeros((15, 6))
    turn[ROT, :3], turn[POS, 3:] = np.eye(3), R
    H, b = turn @ icp.H @ turn.T, turn @ icp.b
    return weight * H, weight * b


def attenuate(H: np.ndarray, b: np.ndarray, inlier: int, p: DirectionalParams) -> tuple[np.ndarray, np.ndarray]:
    """Weakens the directions of the scan's factor with little information per inlier."""
    if not p.enable or not inlier:
        return H, b
    filt = np.eye(15)
    for at, least, weak in ((POS, p.trans_least, p.trans_weak), (ROT, p.rot_least, p.rot_weak)):
        block = (H[at, at] + H[at, at].T) / 2
        values, vectors = np.linalg.eigh(block)
        need = max(0.0, least) * inlier
        share = np.ones(3) if need <= 0 else np.maximum(min(max(weak, 0.0), 1.0), np.clip(values / need, 0, 1))
        share = np.where(values > 0, share, 0.0)
        filt[at, at] = (vectors * np.sqrt(np.clip(share, 0, 1))) @ vectors.T
    return filt @ H @ filt, filt @ filt @ b


def imu_to_lidar_jacobian(T: np.ndarray, R_world_lidar: np.ndarray) -> np.ndarray:
    J, R = np.eye(15), T[:3, :3]
    J[ROT, ROT] = R
    J[POS, ROT] = -(R_world_lidar @ R) @ lie.skew(lie.inverse_pose(T)[:3, 3])
    return J


def covariance_to_lidar(P: np.ndarray, T: np.ndarray, R_world_lidar: np.ndarray) -> np.ndarray:
    J = imu_to_lidar_jacobian(T, R_world_lidar)
    return J @ P @ J.T


def covariance_to_imu(P: np.ndarray, T: np.ndarray, R_world_lidar: np.ndarray) -> np.ndarray:
    J = np.linalg.inv(imu_to_lidar_jacobian(T, R_world_lidar))
    return J @ P @ J.T


def align(problem, params: reg.Params, p: LioParams, predicted: State, covariance: np.ndarray, update_bias: bool = True, previous: np.ndarray | None = None) -> LioResult:
    """At most p.iterations steps in all, shared out over the levels of the robust scale. The scan's
    factor is weighted by its reduced chi-square, the prediction enters as a prior, biases may be
    held. Without a usable prior the states that the scan says nothing about are pinned."""
    valid, H_imu, _ = imu_factor(predicted, predicted, covariance)
    at, start = predicted, predicted.pose()
    dims = 1 if params.reg_type in (reg.RegType.POINT_TO_PLANE, reg.RegType.GENZ) else 3
    schedule = reg.scale_schedule(params, reg.PipelineParams(auto_scale=p.auto_scale and p.iterations > 0, init_scale=p.init_scale, min_scale=p.min_scale, rotation_init_scale=p.rotation_init_scale, rotation_min_scale=p.rotation_min_scale, levels=min(p.levels, max(p.iterations, 1))))
    icp, H_last, done, converged = reg.Linear(), np.zeros((15, 15)), 0, False
    clip = lambda v, low, high: min(max(v, low), high)

    def held(d: np.ndarray) -> np.ndarray:
        if not update_bias:
            d = d.copy()
            d[ACC] = d[GYR] = 0
        return d

    def prior_cost(s: State) -> float:
        r = s.minus(predicted)
        return 0.5 * float(r @ H_imu @ r) if valid else 0.0

    for level, (scale, turn) in enumerate(schedule):
        damping, radius = params.lm_init, params.dl_init
        for _ in range(p.iterations // len(schedule) + (level < p.iterations % len(schedule))):
            done += 1
            icp = reg.regularize(problem.linearize(at.pose(), scale, turn), at.pose(), start, params.degeneracy)
            freedom = dims * icp.inlier - 6
            weight = 1 / max(1.0, 2 * icp.error / freedom) if freedom > 0 and math.isfinite(icp.error) and icp.error >= 0 else 1.0
            H, b = attenuate(*embed(icp, at.R, weight), icp.inlier, p.directional)
            if valid:
                H, b = H + H_imu, b + H_imu @ at.minus(predicted)
            else:
                for k in (VEL, ACC, GYR):
                    H[k, k] += p.invalid_regularization * np.eye(3)
            H_last = H

            def cost(s: State) -> float:
                return weight * problem.error(s.pose(), scale, turn)[0] + prior_cost(s)

            step, stop = None, False
            if params.optimizer is reg.Optimizer.GAUSS_NEWTON:
                step = reg.solve(H + params.gn_lambda * np.eye(15), b)
                stop = step is None
            elif params.optimizer is reg.Optimizer.LEVENBERG_MARQUARDT:
                now = cost(at)
                for _ in range(params.lm_inner):
                    trial = reg.solve(H + damping * np.eye(15), b)
                    if trial is not None and cost(at.plus(held(trial))) <= now:
                        step, damping = trial, clip(damping / params.lm_factor, params.lm_min, params.lm_max)
                        break
                    damping = clip(damping * params.lm_factor, params.lm_min, params.lm_max)
                stop = step is None
            else:
                radius = clip(radius, params.dl_min, params.dl_max)
                trial = held(reg.dogleg_step(H, b, radius)[0])
                gain = -float(b @ trial + 0.5 * trial @ H @ trial)
                rho = (cost(at) - cost(at.plus(trial))) / gain if gain > 0 else -1.0
                if rho < params.dl_eta1:
                    radius = clip(radius * params.dl_decrease, params.dl_min, params.dl_max)
                else:
                    step = trial
                    if rho > params.dl_eta2 and np.linalg.norm(trial) >= 0.99 * radius:
                        radius = clip(radius * params.dl_increase, params.dl_min, params.dl_max)
            if step is not None:
                step = held(step)
                at = at.plus(step)
                converged = bool(np.linalg.norm(step[ROT]) < params.criteria_rotation and np.linalg.norm(step[POS]) < params.criteria_translation)
            if stop or converged:
                break
    try:
        P = np.linalg.inv(H_last)
        P = (P + P.T) / 2 if np.isfinite(P).all() and np.linalg.eigvalsh((H_last + H_last.T) / 2)[0] > 0 else covariance
    except np.linalg.LinAlgError:
        P = covariance
    if not update_bias and previous is not None:
        P = P.copy()
        for k in (ACC, GYR):
            P[k, :] = P[:, k] = 0
            P[k, k] = previous[k, k]
    return LioResult(at, at.pose(), P, H_last, icp, converged, done)
