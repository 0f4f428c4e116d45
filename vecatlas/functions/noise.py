"""The pseudo-random stream and the perturbed query vector in numpy, for the few vectors of a request."""

from __future__ import annotations

import math

import numpy as np

from vecatlas.functions.scalars import FAR, HASH_FACTOR, HASH_START, LONGEST_BIAS, NEAR, NOISE, STREAM_STEP, WORD


def hash32(*numbers: float) -> int:
    h = HASH_START
    for n in numbers:
        h = ((h ^ (math.trunc(n) & WORD)) * HASH_FACTOR) & WORD
    return h


def draws(seed: int, count: int, after: int = 0) -> np.ndarray:
    """``count`` draws of the stream, the first ``after`` left out."""
    with np.errstate(over="ignore"):
        i = np.arange(after + 1, after + count + 1, dtype=np.uint64)
        t = ((np.uint64(seed & WORD) + i * np.uint64(STREAM_STEP)) & np.uint64(WORD)).astype(np.uint32)
        r = (t ^ (t >> np.uint32(15))) * (t | np.uint32(1))
        r ^= r + (r ^ (r >> np.uint32(7))) * (r | np.uint32(61))
        return (r ^ (r >> np.uint32(14))).astype(np.float64) / 4294967296.0


def normals(seed: int, count: int) -> tuple[np.ndarray, int]:
    """Normal draws and the number of uniform draws that they took; zero draws are passed over."""
    found = draws(seed, 2 * count)
    if found.all():
        u, v, used = found[0::2], found[1::2], 2 * count
    else:
        more = draws(seed, 4 * count + 64)
        at = np.flatnonzero(more)[: 2 * count]
        u, v, used = more[at[0::2]], more[at[1::2]], int(at[-1]) + 1
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v), used


def unit(v: np.ndarray) -> np.ndarray:
    """Single precision, the length summed in double; a zero vector stays."""
    n = math.sqrt(float(np.square(v, dtype=np.float64).sum())) or 1.0
    return (v / n).astype(np.float32)


def smoothstep(low: float, high: float, x: float) -> float:
    s = min(1.0, max(0.0, (x - low) / max(high - low, 1e-9)))
    return s * s * (3 - 2 * s)


def temperature(r: float) -> float:
    return smoothstep(NEAR, FAR, r)


def weights(t: float) -> tuple[float, float, float]:
    return (1 - t) ** 2, 2 * t * (1 - t), t * t


def perturbed(vector, basis, x: float, y: float, seed: int) -> tuple[np.ndarray, int]:
    """The query vector at a place of the field: the unit vector, a step by direction, and noise; and the number of
    uniform draws that the noise took."""
    v = unit(np.asarray(vector, dtype=np.float32))
    u1, u2 = (np.asarray(b, dtype=np.float32) for b in basis[:2])
    if not len(v) == len(u1) == len(u2):
        raise ValueError("vector and basis have different dimensions")
    t, theta = temperature(math.hypot(x, y)), math.atan2(y, x)
    along = unit((np.float32(1) * u1 * math.cos(theta)).astype(np.float32) + (u2 * math.sin(theta)).astype(np.float32))
    bias = (along * (LONGEST_BIAS * t)).astype(np.float32)
    eps, used = normals(seed, len(v))
    noise = (eps.astype(np.float32) * (NOISE[0] + (NOISE[1] - NOISE[0]) * t)).astype(np.float32)
    return unit(v + bias + noise), used
