"""Random columns."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.runtime import ship_with_tasks, stage

# Pairs that a task of `java_gaussians` draws at a time, accepted or not.
_DRAWS = 1 << 16
_MASK = (1 << 48) - 1
_STEP = 0x5DEECE66D, 0xB


def uniform_col(seed: int | None = None) -> Column:
    """U(0, 1)."""
    return F.rand(seed)


def hashed_uniform(*parts: Column) -> Column:
    """U(0, 1) from the md5 of the parts: the same for equal parts, on any number of partitions, and independent for
    different ones."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def hashed_gaussian(mean: float, stdev: float, *parts: Column) -> Column:
    """N(mean, stdev) from two hashed uniform numbers (Box and Muller, 1958). A stdev of 0 or NaN gives the mean."""
    if stdev == 0 or math.isnan(stdev):
        return F.lit(float(mean))
    radius = F.sqrt(-2.0 * F.log(hashed_uniform(*parts, F.lit("r"))))
    return F.lit(float(mean)) + F.lit(float(stdev)) * radius * F.cos(2.0 * math.pi * hashed_uniform(*parts, F.lit("a")))


def gaussian_col(mean: float, stdev: float, seed: int | None = None) -> Column:
    """N(mean, stdev). A stdev of 0 or NaN gives the mean itself."""
    if stdev == 0 or math.isnan(stdev):
        return F.lit(float(mean))
    return F.lit(float(mean)) + F.lit(float(stdev)) * F.randn(seed)


def _steps(n: int) -> tuple[int, int]:
    """(a, c): n steps of java.util.Random take state x to a x + c."""
    a, c, (a2, c2) = 1, 0, _STEP
    while n:
        if n & 1:
            a, c = a * a2 & _MASK, (c * a2 + c2) & _MASK
        a2, c2, n = a2 * a2 & _MASK, (c2 * a2 + c2) & _MASK, n >> 1
    return a, c


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for 1 to n steps."""
    a, c = (np.array([x], np.uint64) for x in _STEP)
    with np.errstate(over="ignore"):
        while len(a) < n:
            a, c = np.concatenate([a, a * a[-1]]), np.concatenate([c, a * c[-1] + c])
    return a[:n], c[:n]


def _polar(seed: int, block: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What nextGaussian of java.util.Random(seed) gives in a block of _DRAWS pairs of its polar method (Knuth 3.4.1), in order."""
    a, c = _steps(4 * _DRAWS * block)
    state = ((seed ^ _STEP[0]) & _MASK) * a + c & _MASK
    with np.errstate(over="ignore"):
        states = (table[0] * np.uint64(state) + table[1]) & np.uint64(_MASK)
    high, low = states[0::2] >> np.uint64(22), states[1::2] >> np.uint64(21)
    v = 2 * ((high << np.uint64(27)) + low).astype(np.float64).reshape(-1, 2) * 2.0 ** -53 - 1
    square = (v ** 2).sum(1)
    good = (square < 1) & (square != 0)
    return (v[good] * np.sqrt(-2 * np.log(square[good]) / square[good])[:, None]).ravel()


def java_gaussians(spark: SparkSession, n: int, names: list[str], seed: int) -> DataFrame:
    """(id, *names) for ids below n: the N(0, 1) that java.util.Random(seed).nextGaussian gives one after the other, row by row, as
    Spark ML draws them, but for the last digits. Tasks draw blocks of them; the driver holds one number a block. Stored."""
    ship_with_tasks(__name__)
    width = len(names)
    if n * width == 0:
        return spark.createDataFrame([], ", ".join(["id bigint", *[f"{c} double" for c in names]]))

    def counted(batches):
        table = _table(4 * _DRAWS)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n": [len(_polar(seed, b, table)) for b in batch["id"].tolist()]})

    def blocks(low: int, high: int) -> list[int]:
        some = spark.range(low, high, 1, max(1, (high - low) // 16)).mapInPandas(counted, "id bigint, n bigint")
        return [r["n"] for r in some.orderBy("id").collect()]

    sizes: list[int] = []
    while sum(sizes) < n * width:
        short = n * width - sum(sizes)
        sizes += blocks(len(sizes), len(sizes) + 1 + int(short / (1.5 * _DRAWS)))
    ends = np.cumsum(sizes)
    rows = max(1, _DRAWS // width)

    def drawn(batches):
        table = _table(4 * _DRAWS)
        for batch in batches:
            for chunk in batch["id"].tolist():
                low, high = chunk * rows, min(n, (chunk + 1) * rows)
                first, last = np.searchsorted(ends, [low * width, high * width - 1], "right")
                values = np.concatenate([_polar(seed, b, table) for b in range(first, last + 1)])
                at = low * width - int(ends[first] - sizes[first])
                out = pd.DataFrame(values[at:at + (high - low) * width].reshape(-1, width), columns=names)
                out.insert(0, "id", np.arange(low, high))
                yield out

    chunks = -(-n // rows)
    out = spark.range(0, chunks, 1, max(1, chunks // 4)).mapInPandas(drawn, ", ".join(["id bigint", *[f"{c} double" for c in names]]))
    # Stored, as Spark takes it for a table of a line a chunk, and would broadcast it.
    return stage(out, "gaussians")
