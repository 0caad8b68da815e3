"""Rounding, clipping and repeatable pseudo-random numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two primes below 2**31 that leave 2 when divided by 3, so cubing permutes the numbers below
# them, and the multipliers of the keys and the seed under each.
HASH_ROUNDS = ((2147483579, (7919, 104729, 1299709, 1)), (2147483549, (611953, 15485863, 49979687, 86028121)))
HASH_RANGE = 1 << 62  # the hash lies below this

# From here on a double has no digits left to round.
EXACT = float(1 << 53)


def half_up(value: Column, digits: int) -> Column:
    """Round half up by way of ``floor``.

    ``round`` differs between engines on values that end on a binary tie; this
    form is plain IEEE arithmetic and gives the same double everywhere.  Infinity, NaN and
    numbers too large to have that many digits stay as they are.
    """
    scale = float(10**digits)
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.abs(value) * F.lit(scale) < F.lit(EXACT), rounded).otherwise(value.cast("double"))


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def product_number(product_id: Column) -> Column:
    """An integer for any product id: the id itself when it is a number."""
    return F.coalesce(product_id.try_cast("bigint"), F.crc32(product_id))


def mixed_hash(product_no: Column, episode: Column, step: Column, seed: int = 0) -> Column:
    """Repeatable integer in ``[0, HASH_RANGE)`` from three keys and a seed.

    Each round folds the keys modulo a prime, which no key can overflow, and cubes; the
    rounds have different primes and multipliers, so keys that meet in one part in the other.
    """
    parts = []
    for prime, (of_product, of_episode, of_step, of_seed) in HASH_ROUNDS:
        folded = F.pmod(
            F.pmod(product_no.cast("bigint"), F.lit(prime)) * F.lit(of_product)
            + F.pmod(episode.cast("bigint"), F.lit(prime)) * F.lit(of_episode)
            + F.pmod(step.cast("bigint"), F.lit(prime)) * F.lit(of_step)
            + F.lit((seed + 1) * of_seed % prime),
            F.lit(prime),
        )
        parts.append(F.pmod(F.pmod(folded * folded, F.lit(prime)) * folded, F.lit(prime)))
    return parts[0] * F.lit(1 << 31) + parts[1]


def mixed_unit(product_no: Column, episode: Column, step: Column, seed: int = 0) -> Column:
    """Repeatable number in ``[0, 1)``."""
    return _unit(mixed_hash(product_no, episode, step, seed))


def _unit(drawn: Column) -> Column:
    # Half a unit in the last place short of 1 would round up to it.
    return F.least(drawn / F.lit(float(HASH_RANGE)), F.lit(1.0 - 2.0**-53))


def with_episode_hash(df: DataFrame, product_no: Column, episode: Column, seed: int = 0) -> DataFrame:
    """Columns ``_part0, _part1``: what ``mixed_hash`` makes of product, episode and seed, for ``with_step_unit`` to finish."""
    df = df.withColumns({"_number": product_no.cast("bigint"), "_episode": episode.cast("bigint")})
    parts = {}
    for i, (prime, (of_product, of_episode, _, of_seed)) in enumerate(HASH_ROUNDS):
        folded = F.pmod(F.col("_number"), F.lit(prime)) * F.lit(of_product) + F.pmod(F.col("_episode"), F.lit(prime)) * F.lit(of_episode)
        parts[f"_part{i}"] = F.pmod(folded + F.lit((seed + 1) * of_seed % prime), F.lit(prime))
    return df.withColumns(parts).drop("_number", "_episode")


def with_step_unit(df: DataFrame, step: Column, name: str) -> DataFrame:
    """Column ``name``: ``mixed_unit`` of what ``with_episode_hash`` was given and ``step``, each part worked out once a row."""
    primes = [prime for prime, _ in HASH_ROUNDS]
    df = df.withColumn("_step", step.cast("bigint"))
    folded = {}
    for i, (prime, (_, _, of_step, _)) in enumerate(HASH_ROUNDS):
        folded[f"_part{i}"] = F.pmod(F.col(f"_part{i}") + F.pmod(F.col("_step"), F.lit(prime)) * F.lit(of_step), F.lit(prime))
    df = df.withColumns(folded)
    cubes = [F.pmod(F.pmod(F.col(f"_part{i}") * F.col(f"_part{i}"), F.lit(p)) * F.col(f"_part{i}"), F.lit(p)) for i, p in enumerate(primes)]
    return df.withColumn(name, _unit(cubes[0] * F.lit(1 << 31) + cubes[1])).drop("_step", "_part0", "_part1")


def let(value: Column, like: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; SQL lambdas have no ``let``.

    A one-element fold does it.  ``like`` is any column of the type ``body`` returns.
    (``transform`` would do too, but it copies what ``body`` returns, arrays included.)
    """
    return F.aggregate(F.array(value), like, lambda _, bound: body(bound))
