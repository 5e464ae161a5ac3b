"""How document filters interact: what each removes, alone and after others, in every order.

Every filter has, for each part of the corpus, a posting list: the sorted ids of the rows that fail it. What a filter
removes after others is the difference between two unions of lists, so the sizes of the unions of all subsets of
filters answer every order. Ids are cut into ranges; a task holds the lists of one range, unites them by
galloping k-way merges, and gives sizes, which Spark sums over the ranges of a part. No list of a whole part is built.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.plans.joins import lookup_join, measured_bytes
from factorloom.plans.runtime import ship_with_tasks, stage

FILTERS = "ABCDE"
#: Rows whose posting lists meet in one task: 2 to this power.
RANGE_BITS = 14
_CAPITALS = bytes(range(65, 91))
_SIGNS = re.compile(rb"[#$%&*|]")


def failures_of(text: str) -> int:
    """Bits 0 to 3: does the text fail A, B, C, D?"""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes, white space is \\x20\\x09-\\x0D
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * capitals > 5 * len(text)) << 2 | (_SIGNS.search(raw) is not None) << 3)


def judged(docs: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source") -> DataFrame:
    """(num, id, part, key, mask) for every row, stored: num numbers the rows, key is a digest of the text, mask has
    the filters A to D that look at one text only."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(map(failures_of, texts), pa.int32())],
                names=["id", "part", "key", "mask"])

    ship_with_tasks(__name__)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, part string, key binary, mask int")
    # The numbers hang on partitions and are therefore stored once, before anything uses them.
    return stage(found.withColumn("num", F.monotonically_increasing_id()), "judged")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each id of `short` stands or would stand in `long`, both sorted: a jump over whole blocks of 64 ids, then
    halves inside the block. All ids of `short` search at once."""
    if not len(long):
        return np.zeros(len(short), np.int64)
    low = np.maximum(np.searchsorted(long[::64], short) - 1, 0) * 64
    high = np.minimum(low + 64, len(long))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (long[np.minimum(middle, len(long) - 1)] < short)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of a that b lacks. Ids of the shorter list are looked up in the longer one."""
    if len(a) <= len(b):
        at = gallop(a, b)
        return a[b[np.minimum(at, len(b) - 1)] != a] if len(b) else a
    at = gallop(b, a)
    hit = at[a[np.minimum(at, len(a) - 1)] == b] if len(b) else at
    keep = np.ones(len(a), bool)
    keep[hit] = False
    return a[keep]


def united(lists: list[np.ndarray]) -> np.ndarray:
    """The k-way union of sorted lists, the longest first; what each other list adds is put in its place."""
    lists = sorted(lists, key=len, reverse=True)
    out = lists[0]
    for ids in lists[1:]:
        new = missing(ids, out)
        if len(new):
            out = np.insert(out, gallop(new, out), new)
    return out


def union_sizes(ids: np.ndarray, masks: np.ndarray, marks: list[np.ndarray], n_filters: int) -> list[list[int]]:
    """For each subset of filters [size of the union of their lists, and how many of it are in each mark's list].
    Unions grow by one list at a time; the subset of no filter comes first and has sizes 0."""
    lists = [ids[masks >> f & 1 == 1] for f in range(n_filters)]
    unions = [ids[:0]]
    for subset in range(1, 1 << n_filters):
        top = subset.bit_length() - 1
        unions.append(united([unions[subset ^ 1 << top], lists[top]]))
    return [[len(u), *(len(u) - len(missing(u, m)) for m in marks)] for u in unions]


def subset_sizes(rows: DataFrame, n_filters: int) -> DataFrame:
    """(part, subset, n, good, toxic): how many rows fail at least one filter of the subset, and how many of those are
    marked good and toxic. Subset -1 is the whole part. rows: (num, part, mask, good, toxic)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, rows in pdf.sort_values("num").groupby("part", sort=False):
            ids, masks = rows["num"].to_numpy(), rows["mask"].to_numpy()
            marks = [ids[rows[m].to_numpy()] for m in ("good", "toxic")]
            out.append((part, -1, len(ids), len(marks[0]), len(marks[1])))
            out += [(part, s, *sizes) for s, sizes in enumerate(union_sizes(ids, masks, marks, n_filters))]
        return pd.DataFrame(out, columns=["part", "subset", "n", "good", "toxic"])

    ship_with_tasks(__name__)
    ranged = rows.withColumn("_range", F.shiftright("num", RANGE_BITS))
    sizes = ranged.groupBy("_range").applyInPandas(run, "part string, subset int, n bigint, good bigint, toxic bigint")
    return sizes.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    part, each of the 120 orders of FILTERS and each step.

    Null texts are empty, null parts the part ''. E fails for a row whose text stands under a smaller id; so
    rows repeated under their smallest id do not fail it, and a null id neither fails it nor makes others fail.
    A row is good (toxic) if any row of `labels` with its id says quality = 1 (toxic = 1). Other columns are
    not read; an empty table gives no rows."""
    rows = judged(docs, text, id_col, part)
    n = len(FILTERS)
    copies = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = stage(copies.select("key", "first"), "copies")
    marks = stage(labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good OR toxic"), "marks")
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    whole = lookup_join(rows, copies, ["key"], measured_bytes(copies)).select(
        "num", "id", "part", F.when(late, F.col("mask").bitwiseOR(1 << n - 1)).otherwise(F.col("mask")).alias("mask"))
    whole = lookup_join(whole, marks, ["id"], measured_bytes(marks)).select(
        "num", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return by_order(subset_sizes(whole, n))


def by_order(sizes: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of every order, from the union sizes of a part's subsets. The plan of steps is a table of fixed size."""
    n, every = len(filters), (1 << len(filters)) - 1
    per_part = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(
        F.struct("subset", F.struct("n", "good", "toxic")))).alias("u"))
    plan = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            plan.append(("".join(filters[i] for i in order), step, 1 << f, before, before | 1 << f))
            before |= 1 << f
    steps = sizes.sparkSession.createDataFrame([(k, *row) for k, row in enumerate(plan)],
                                               "k int, filter_order string, step int, own int, before int, after int")
    # In how many of the orders exactly the filters of a subset come before a given one.
    weights = [factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) for s in range(every)]
    u = lambda subset, field="n": F.col("u")[subset][field]
    shapley = F.map_from_entries(F.array(*[F.struct(
        F.lit(1 << f), sum((weights[s] * (u(F.lit(s | 1 << f)) - u(F.lit(s))) for s in range(every) if not s >> f & 1), F.lit(0)))
        for f in range(n)]))
    per_part = per_part.withColumn("s", shapley).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(plan) - 1))))
    removed = u(F.col("after")) - u(F.col("before"))
    return per_part.join(F.broadcast(steps), "k").select(
        "part", "filter_order", "step", (u(F.lit(-1)) - u(F.col("after"))).alias("kept"), removed.alias("removed"),
        (u(F.col("own")) - removed).alias("redundant"),
        (u(F.lit(every)) - u(F.lit(every) - F.col("own"))).alias("unique_fails"),
        (u(F.col("after"), "good") - u(F.col("before"), "good")).alias("good_lost"),
        (u(F.col("after"), "toxic") - u(F.col("before"), "toxic")).alias("toxic_lost"),
        F.col("s")[F.col("own")].cast("long").alias("shapley"))

