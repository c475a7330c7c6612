"""Numeric expressions over score arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities at a temperature; NULL where a logit is null or not finite."""
    good = F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shifted = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.when(good, F.transform(shifted, lambda x: x / total))


def argmax(values: Column) -> Column:
    """0-based place of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def margin(values: Column) -> Column:
    """Greatest value less the second."""
    ordered = F.sort_array(values, asc=False)
    return ordered[0] - ordered[1]


def wilson_lower_bound(correct: Column, total: Column, z: float = 1.96) -> Column:
    n = total.cast("double")
    p = correct / n
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(total > 0, (p + z * z / (2 * n) - spread) / (1 + z * z / n)).otherwise(0.0)


def brier(probabilities: Column, target: Column) -> Column:
    """Squared distance to the one-hot target."""
    gap = F.transform(probabilities, lambda p, i: F.pow(p - F.when(i == target, 1.0).otherwise(0.0), 2))
    return F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)


def hash_share(key: Column, salt: str) -> Column:
    """A place in [0, 1) from the first 32 bits of a salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
