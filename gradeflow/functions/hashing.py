"""Deterministic hash fractions, splits, shards and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("decimal(20,0)")


def fraction(text: Column) -> Column:
    """The first eight bytes of SHA-256, big-endian, over 2**64: in [0, 1]."""
    return _number(F.substring(F.sha2(text, 256), 1, 16)).cast("double") / F.lit(2.0**64)


def split_of(group: Column, seed: int, holdout: float) -> Column:
    """holdout or dev, the same for all rows of a group."""
    return F.when(fraction(F.concat(F.lit(f"{seed}:"), group)) < holdout, "holdout").otherwise("dev")


def shard_of(key: Column, shards: int) -> Column:
    return (_number(F.substring(F.sha2(key, 256), 1, 8)) % shards).cast("int")


def sample_key(key: Column, seed: int) -> Column:
    """Sorting by this and taking the first n is a fixed sample."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
