"""Random numbers that depend on nothing but a seed, a key, a replicate and a place: counters scrambled to 64 bits."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers: two rounds of multiply and shift."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def bits(seed: int, key: int, reps: np.ndarray, n: int) -> np.ndarray:
    """(replicates, n): for each replicate the numbers at places 0..n-1."""
    with np.errstate(over="ignore"):
        start = _scrambled(np.array([seed * 0x9E3779B97F4A7C15 + key & (1 << 64) - 1], U64))
        turn = _scrambled(start + reps.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        return _scrambled(turn[:, None] + np.arange(1, n + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))


def errors(kind: str, residual: np.ndarray, seed: int, key: int, reps: np.ndarray) -> np.ndarray:
    """(replicates, n) drawn errors: nonparametric resamples them, wild flips their signs, parametric draws normals of their size."""
    n = len(residual)
    if kind == "nonparametric":
        return residual[(bits(seed, key, reps, n) % U64(n)).astype(np.int64)]
    if kind == "wild":
        return np.where(bits(seed, key, reps, n) >> U64(63), -residual, residual)
    if kind == "parametric":
        u = (bits(seed, key, reps, 2 * n) >> U64(11)).astype(float) / 2.0**53 + 2.0**-54
        return residual.std() * np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * np.pi * u[:, n:])
    raise ValueError(f"unknown draws {kind}")


def permutations(seed: int, key: int, reps: np.ndarray, n: int) -> np.ndarray:
    """(replicates, n): permutations of 0..n-1, the order of the numbers at the places."""
    return np.argsort(bits(seed, key, reps, n), axis=1, kind="stable")
