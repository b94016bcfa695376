"""Scores: similarity, decay, normalization, rounding, hashing of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import patterns as P
from recollect.functions.text import lookup, round_half_up

#: Share of similarity, recency, importance and reinforcement in a decayed score.
WEIGHTS = (0.4, 0.25, 0.2, 0.15)
MOST_EXTENSION = 10.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size < 1e-10, F.lit(0.0)).otherwise(dot(a, b) / size)


def _by_type(kind: Column, at: int) -> Column:
    # a profile's scale is not used
    return lookup({k: v[at] or 1.0 for k, v in P.DECAY.items()}, kind, P.DECAY["general"][at])


def decayed(score: Column, kind: Column, importance: Column, recalls: Column, uses: Column, age_days: Column) -> Column:
    """Weibull decay: what was recalled, used or important ages more slowly; profiles don't age."""
    share, recency, weight, reinforcement = WEIGHTS
    recalls, uses = F.coalesce(recalls, F.lit(0)), F.coalesce(uses, F.lit(0))
    # an importance of 0 counts as a half for the scale, but as 0 for the score
    known = F.when(F.coalesce(importance, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(importance)
    scale = _by_type(kind, 0) * F.least((0.5 + known) * (1 + 0.3 * recalls) * (1 + 0.5 * uses), F.lit(MOST_EXTENSION))
    fresh = F.when(kind == "profile", F.lit(1.0)).otherwise(F.exp(-F.pow(F.greatest(age_days, F.lit(0.0)) / scale, _by_type(kind, 1))))
    held = 1 - F.exp(-recalls / 3)
    return round_half_up(score * (share + recency * fresh + weight * F.coalesce(importance, F.lit(0.5)) + reinforcement * held), 3)


def age_days(created: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86_400_000_000.0)


def vector_hash(vector: Column) -> Column:
    """32-bit FNV-1a over about 32 sampled dimensions, each quantized to a byte."""
    step = F.greatest(F.lit(1), F.floor(F.size(vector) / 32).cast("int"))
    sampled = F.filter(vector, lambda x, i: i % step == 0)
    byte = lambda x: F.pmod(F.floor(x.cast("double") * 10000 + 0.5), F.lit(256))
    return F.aggregate(
        sampled,
        F.lit(0x811C9DC5).cast("long"),
        # 32 bits times a prime of 25 bits fit a long
        lambda h, x: F.pmod(h.bitwiseXOR(byte(x)) * 16777619, F.lit(1 << 32)),
    )
