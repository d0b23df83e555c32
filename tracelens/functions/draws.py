"""Random numbers that are a function of (seed, replicate, unit): the same for any engine and any partitioning.

A unit is two numbers taken once from the md5 of its text. A draw mixes them with keys of the replicate by fifth
powers modulo the prime 2^31 - 1, which permute the residues; all products stay below 2^62, so numpy does
them over whole arrays and SQL in BIGINT. Units are put in order by (draw, unit).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = (1 << 31) - 1
IN_CACHE = 8_192  # units whose draws are worked out at once
_SEED, _REP, _KEY, _PLUS = 1_000_003, 8_191, 131_071, 17  # any odd steps do; SQL states the same


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P for 0 <= x < 2^63, by folding the upper bits down."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


def _five(x: np.ndarray) -> np.ndarray:
    square = _mod(x * x)
    return _mod(_mod(square * square) * x)


def replicate_keys(seed: int, reps) -> np.ndarray:
    """Three keys for each replicate: shape (3, replicates)."""
    reps = np.asarray(reps, np.int64)
    return np.stack([_five((seed * _SEED + reps * _REP + j * _KEY + _PLUS) % P) for j in (1, 2, 3)])


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """x below 2^64 to a number below 2^31 + 8 that is equal modulo P, in place."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, P, out=x)
        np.add(x, spare, out=x)


def _five_in(x: np.ndarray, spare: np.ndarray, root: np.ndarray) -> None:
    """The fifth power of x, which is below 2^32, as a number below 2^31 + 8, in place."""
    np.copyto(root, x)
    for factor in (x, x, root):
        np.multiply(x, factor, out=x)
        _fold(x, spare)


def draws(seed: int, reps, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The draws of all units (as columns) for all replicates (as rows)."""
    a, b, c = replicate_keys(seed, reps).astype(np.uint64)[:, :, None]
    first, second = np.asarray(first).astype(np.uint64), np.asarray(second).astype(np.uint64)
    out = np.empty((len(a), len(first)), np.int64)
    scale = b % np.uint64(P - 1) + np.uint64(1)
    many = max(1, IN_CACHE // max(len(first), 1))
    for i in range(0, len(first), IN_CACHE):
        u1, u2 = first[i:i + IN_CACHE], second[i:i + IN_CACHE]
        for r in range(0, len(a), many):
            at = slice(r, r + many)
            x = u1 + a[at]
            spare, root = np.empty_like(x), np.empty_like(x)
            _five_in(x, spare, root)
            np.multiply(x, scale[at], out=x)
            np.add(x, u2, out=x)
            _fold(x, spare)
            _five_in(x, spare, root)
            np.add(x, c[at], out=x)
            _five_in(x, spare, root)
            np.subtract(x, P, out=spare)  # below 0 it wraps to a large number
            out[at, i:i + IN_CACHE] = np.minimum(x, spare)
    return out


def chosen(seed: int, reps, first: np.ndarray, second: np.ndarray, positives: int) -> np.ndarray:
    """Which units get the positive label: the ``positives`` least draws of a replicate, ties by the order of the units."""
    n = len(first)
    out = np.zeros((len(reps), n), bool)
    if 0 < positives < n:
        key = draws(seed, reps, first, second) << 31 | np.arange(n)
        if n < IN_CACHE // 4:
            return key <= np.partition(key, positives - 1, axis=1)[:, [positives - 1]]
        # draws are uniform, so the last positive one is near its share; only keys around it are put in order
        near, wide = positives / n, 6 * (positives * (n - positives) / n) ** 0.5 / n + 12 / n
        low, high = int(max(near - wide, 0) * P) << 31, int(min(near + wide, 1) * P) + 1 << 31
        for row, mark in zip(key, out):
            below, inside = np.count_nonzero(row < low), row[(row >= low) & (row < high)]
            left = positives - below
            if 0 < left <= len(inside):
                np.less_equal(row, np.partition(inside, left - 1)[left - 1], out=mark)
            else:
                np.less_equal(row, np.partition(row, positives - 1)[positives - 1], out=mark)
    elif positives:
        out[:] = True
    return out


def redraws(seed: int, reps, units: int) -> Iterator[np.ndarray]:
    """For each replicate, how often each of the units is drawn when as many are drawn with replacement: draw i is a function of md5(seed|replicate|i)."""
    names = [b"%d" % i for i in range(units)]
    for rep in reps:
        head = b"%d|%d|" % (seed, rep)
        first = np.frombuffer(b"".join([md5(head + name).digest() for name in names]), ">u4")[::4]
        yield np.bincount(first.astype(np.int64) % units, minlength=units)


def unit_numbers(unit: str) -> tuple[Column, Column]:
    """The two numbers of a unit, 28 bits each."""
    h = F.md5(F.col(unit).cast("string"))
    return tuple(F.conv(F.substring(h, at, 7), 16, 10).cast("long") for at in (1, 8))


def with_draw(df: DataFrame, seed: int, rep: str, first: str, second: str, out: str) -> DataFrame:
    """The same draw as a column; every step is a column of its own, so none is worked out twice."""
    kept = df.columns
    step = 0

    def five(df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        nonlocal step
        step += 1
        names = [f"_x{step}", f"_s{step}", f"_f{step}"]
        df = df.withColumn(names[0], x % P).withColumn(names[1], F.col(names[0]) * F.col(names[0]) % P)
        return df.withColumn(names[2], F.col(names[1]) * F.col(names[1]) % P * F.col(names[0]) % P), F.col(names[2])

    keys = []
    for j in (1, 2, 3):
        df, k = five(df, F.lit(seed * _SEED + j * _KEY + _PLUS) + F.col(rep).cast("long") * _REP)
        keys.append(k)
    df, x = five(df, F.col(first) + keys[0])
    df, x = five(df, x * (keys[1] % (P - 1) + 1) + F.col(second))
    df, x = five(df, x + keys[2])
    return df.select(*kept, x.alias(out))
