"""Column functions: vectors, hashing, the pseudo-random stream, and the geometry of the field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit hash and the pseudo-random generator.
HASH_START, HASH_FACTOR, STREAM_STEP = 2166136261, 16777619, 0x6D2B79F5
WORD = 0xFFFFFFFF
# Where the field begins to change and where it is wholly changed; noise there; the longest bias.
NEAR, FAR, NOISE, LONGEST_BIAS = 1.5, 12.0, (0.05, 0.35), 0.35


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(low: float, high: float, x: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / max(high - low, 1e-9)))
    return s * s * (3 - 2 * s)


def radius(x: Column, y: Column) -> Column:
    return F.hypot(x.cast("double"), y.cast("double"))


def temperature(r: Column) -> Column:
    return smoothstep(NEAR, FAR, r)


def weights(t: Column) -> tuple[Column, Column, Column]:
    """Shares of the similar, drifted and random pools."""
    return (1 - t) * (1 - t), 2 * t * (1 - t), t * t


def sigma(t: Column) -> Column:
    return lerp(F.lit(NOISE[0]), F.lit(NOISE[1]), t)


def directional_bias(theta: Column, t: Column, u1: Column, u2: Column) -> Column:
    """A step in the plane of the first two components, in the direction theta, longer with t."""
    return times(unit(plus(times(u1, F.cos(theta)), times(u2, F.sin(theta)))), lerp(F.lit(0.0), F.lit(LONGEST_BIAS), t))


def hash32(*numbers: Column) -> Column:
    """A 32-bit multiply-xor hash of integers."""
    items = F.array(*[n.cast("bigint") for n in numbers])
    return F.aggregate(items, F.lit(HASH_START).cast("bigint"), lambda h, n: (h.bitwiseXOR(n.bitwiseAND(F.lit(WORD))) * HASH_FACTOR).bitwiseAND(F.lit(WORD)))


def product32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, by 16-bit halves, so that no step overflows."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def stream_draw(seed: Column, i: Column) -> Column:
    """Draw i (from 1) of the stream of ``seed``, in [0, 1). Any draw is a function of seed and i alone."""
    t = (seed.cast("bigint") + i.cast("bigint") * STREAM_STEP).bitwiseAND(F.lit(WORD))
    r = product32(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1)))
    more = product32(r.bitwiseXOR(F.shiftrightunsigned(r, 7)), r.bitwiseOR(F.lit(61)))
    r = r.bitwiseXOR((r + more).bitwiseAND(F.lit(WORD)))
    return r.bitwiseXOR(F.shiftrightunsigned(r, 14)) / F.lit(4294967296.0)


def normal_draw(seed: Column, j: Column) -> Column:
    """Normal draw j (from 0), of the uniform draws 2j+1 and 2j+2 (a zero draw, 1 in 2^32, isn't redrawn here)."""
    u, v = stream_draw(seed, 2 * j + 1), stream_draw(seed, 2 * j + 2)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)


def half_up(x: Column, digits: int) -> Column:
    """Rounded with ties toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
