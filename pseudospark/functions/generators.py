"""Pseudonym generators as column expressions.

Random values come from ``os.urandom``. Spark's own ``uuid()`` and ``randstr()`` are seeded and so not fit for pseudonyms.
They are drawn in Arrow batches, one system call each.

Random columns are drawn anew each time a plan is evaluated: write them out once and read them back before using them twice
(``MappingStore.upsert`` does).
"""

import base64
import hashlib
import os
import platform
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of the base62 method, in order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Generator:
    """``build(value, length)`` gives the pseudonym column without prefix and suffix.

    Only a deterministic generator looks at ``value``. ``distinct`` ones give unlike values unlike pseudonyms.
    """

    build: Callable[[Column, Column], Column]
    deterministic: bool = False
    fixed_length: int | None = None
    distinct: bool = False


def sha256_hex(value: Column, length: Column) -> Column:
    return F.upper(F.sha2(value, 256))


# The functions below are nested, so that they travel by value and executors need no copy of this package.


def _uuids(length: Column, version: int) -> Column:
    """UUIDs of version 4, or of version 7 with the milliseconds in the first 48 bits."""

    @F.pandas_udf("string")
    def draw(lengths: pd.Series) -> pd.Series:
        wanted = np.flatnonzero(lengths.to_numpy(dtype=np.int64) > 0)
        raw = np.frombuffer(os.urandom(16 * len(wanted)), dtype=np.uint8).reshape(-1, 16).copy()
        if version == 7:
            raw[:, :6] = np.frombuffer((time.time_ns() // 1_000_000).to_bytes(6, "big"), dtype=np.uint8)
        raw[:, 6] = raw[:, 6] & 0x0F | version << 4
        raw[:, 8] = raw[:, 8] & 0x3F | 0x80
        text = raw.tobytes().hex()
        out = np.full(len(lengths), "", dtype=object)
        for k, i in enumerate(wanted.tolist()):
            h = text[32 * k : 32 * k + 32]
            out[i] = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
        return pd.Series(out)

    return _drawn(draw, length)


def uuid4(value: Column, length: Column) -> Column:
    return _uuids(length, 4)


def uuid7(value: Column, length: Column) -> Column:
    return _uuids(length, 7)


def random_hex(value: Column, length: Column) -> Column:
    @F.pandas_udf("string")
    def draw(lengths: pd.Series) -> pd.Series:
        wanted = lengths.to_numpy(dtype=np.int64)
        sizes = (wanted + 1) // 2  # two digits per byte, one cut off where the length is odd
        text = os.urandom(int(sizes.sum())).hex()
        starts = 2 * (np.cumsum(sizes) - sizes)
        return pd.Series([text[i : i + n] for i, n in zip(starts.tolist(), wanted.tolist())], dtype=object)

    return _drawn(draw, length)


def random_base62(value: Column, length: Column) -> Column:
    @F.pandas_udf("string")
    def draw(lengths: pd.Series) -> pd.Series:
        wanted = lengths.to_numpy(dtype=np.int64)
        total = int(wanted.sum())
        accepted = np.empty(0, dtype=np.uint8)
        while accepted.size < total:
            missing = total - accepted.size
            noise = np.frombuffer(os.urandom(missing + missing // 16 + 64), dtype=np.uint8)
            # 248 is the largest multiple of 62 below 256: larger bytes would favour the first digits.
            accepted = np.concatenate([accepted, noise[noise < 248]])
        alphabet = np.frombuffer(BASE62.encode(), dtype=np.uint8)
        text = alphabet[accepted[:total] % 62].tobytes().decode()
        starts = np.cumsum(wanted) - wanted
        return pd.Series([text[i : i + n] for i, n in zip(starts.tolist(), wanted.tolist())], dtype=object)

    return _drawn(draw, length)


def random_base64url(value: Column, length: Column) -> Column:
    """4 bytes of host digest, 4 bytes of milliseconds since system start (low byte first), then the random bytes."""

    @F.pandas_udf("string")
    def draw(lengths: pd.Series) -> pd.Series:
        wanted = lengths.to_numpy(dtype=np.int64)
        host = hashlib.sha256(platform.node().encode()).digest()[:4]
        ticks = (time.monotonic_ns() // 1_000_000 & 0xFFFFFFFF).to_bytes(4, "little")
        head = host + ticks
        noise = os.urandom(int(wanted.sum()))
        starts = np.cumsum(wanted) - wanted
        return pd.Series(
            [
                base64.urlsafe_b64encode(head + noise[i : i + n]).rstrip(b"=").decode() if n else ""
                for i, n in zip(starts.tolist(), wanted.tolist())
            ],
            dtype=object,
        )

    return _drawn(draw, length)


def _drawn(draw, length: Column) -> Column:
    return draw.asNondeterministic()(F.coalesce(length.cast("long"), F.lit(0)))


GENERATORS: dict[str, Generator] = {
    "Unspecified": Generator(random_base64url),
    "SecureRandomBase64UrlEncoded": Generator(random_base64url),
    "Sha256HexEncoded": Generator(sha256_hex, deterministic=True, fixed_length=64, distinct=True),
    "Uuid4": Generator(uuid4, fixed_length=36),
    "Uuid7": Generator(uuid7, fixed_length=36),
    "FullRandomHexEncoded": Generator(random_hex),
    "FullRandomBase62Encoded": Generator(random_base62),
}


def register_generator(name: str, generator: Generator) -> None:
    """Add a method of the caller's own."""
    if name in GENERATORS:
        raise ValueError(f"The generation method '{name}' is already registered.")
    GENERATORS[name] = generator


def fixed_length(method: Column) -> Column:
    """The length a method insists on, or null."""
    result = F.lit(None).cast("long")
    for name, generator in GENERATORS.items():
        if generator.fixed_length is not None:
            result = F.when(method == name, F.lit(generator.fixed_length).cast("long")).otherwise(result)
    return result


def with_affixes(value: Column, prefix: Column, suffix: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), value, F.coalesce(suffix, F.lit("")))


def generate(method: Column, value: Column, length: Column, methods: Iterable[str]) -> Column:
    """Dispatch on the method column. ``methods`` names those in use, so that the plan has a branch for those only."""
    used = sorted(set(methods))
    unknown = set(used) - set(GENERATORS)
    if unknown:
        raise ValueError(f"Unknown generation methods: {sorted(unknown)}")
    result = None
    for name in used:
        chosen = method == name
        # A Python function runs for every row, whatever its branch; length 0 lets it skip the others.
        own_length = F.when(chosen, length).otherwise(F.lit(0))
        candidate = GENERATORS[name].build(value, own_length)
        fixed = GENERATORS[name].fixed_length
        if fixed is not None:
            message = F.lit(f"{name} always has length {fixed}.")
            candidate = F.when(length == fixed, candidate).otherwise(F.raise_error(message).cast("string"))
        result = F.when(chosen, candidate) if result is None else result.when(chosen, candidate)
    if result is None:
        return F.lit(None).cast("string")
    return result.otherwise(F.raise_error(F.lit("Unknown generation method")).cast("string"))
