"""Vector bin packing of groups of equal texts into shards balanced in bytes, tokens and rows at once.

Each item is a vector (bytes, tokens, rows). It goes to the shard where the dot product of the item with the
shard's residual capacity, both as shares of a shard's capacity, is highest, large items first. Items above a
fixed share of a shard are few by arithmetic and are placed first, together. The rest is placed bucket by bucket
in parallel, each bucket against its share of what the large items have left in each shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.plans.runtime import ship_with_tasks, stage

#: Parts of a text group that is too large for one item.
SALTS = 64
DIMS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, residual: np.ndarray, capacity: np.ndarray, start: int = 0) -> np.ndarray:
    """The shard of each item (n x dims), in the given order; `residual` (shards x dims) is used up in place. Both
    count as shares of `capacity`. Shards whose bytes, the first dimension and the law, still hold the item whole come
    first, so the other dimensions are balanced only as far as equal bytes allow; ties go round from `start`."""
    shards = len(residual)
    scale = 1.0 / np.maximum(capacity, 1e-12)
    left = residual * scale
    turn = (np.arange(shards) + start) % shards
    out = np.empty(len(items), np.int64)
    for k, item in enumerate(items * scale):
        score = left[turn] @ item + 1e6 * (left[turn, 0] >= item[0] - 1e-12)
        s = turn[int(score.argmax())]
        left[s] -= item
        out[k] = s
    residual[:] = left / scale
    return out


def _sizes(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in DIMS]


def shard(docs: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id", max_group: float = 0.5,
          heavy: float = 1 / 256, groups_per_bucket: int = 20_000) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row of `docs`; other columns are not read.

    size is the UTF-8 bytes of the text plus 1, a null text has none and crc 0. Rows of equal texts share a shard,
    unless their group exceeds `max_group` of a shard's capacity in some dimension: then its rows are dealt into 64
    parts by a hash, each an item of its own. `heavy` is the share of a shard from which items are placed first; at
    most 3 * shards / heavy of them exist. slot counts 0, 1, ... within a shard without gaps, in an order that
    hashes give; equal rows are interchangeable.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("-")))).alias("key"),
        (F.length(body) - F.length(F.translate(body, " \t\n\x0b\x0c\r", "")) + 1).cast("long").alias("tokens"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_col, "place"), F.lit(SALTS)).cast("int"))
    rows = stage(rows.drop("place"), "rows")

    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    capacity = np.array([float(x or 0) for x in total]) / shards
    salted = rows.groupBy("key", "salt").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"),
                                             F.count(F.lit(1)).alias("rows"))
    over = lambda share: F.expr(" OR ".join(f"{c} > {x * share!r}" for c, x in zip(DIMS, map(float, capacity))))
    per_key = salted.groupBy("key").agg(*_sizes(), F.collect_list(F.struct("salt", *DIMS)).alias("parts"))
    items = per_key.withColumn("large", over(max_group)).selectExpr(
        "key", "large", f"explode(CASE WHEN large THEN parts ELSE array(struct(-1 AS salt, {', '.join(DIMS)})) END) AS p")
    items = stage(items.select("key", "p.*"), "items")

    few = items.filter(over(heavy)).orderBy(F.desc("bytes"), F.desc("tokens"), F.desc("rows"), "key", "salt").toPandas()
    residual = np.tile(capacity, (shards, 1))
    few["shard"] = place(few[list(DIMS)].to_numpy(float).reshape(-1, 3), residual, capacity)
    first = spark.createDataFrame([(bytes(k), int(s), int(x)) for k, s, x in zip(few["key"], few["salt"], few["shard"])],
                                  "key binary, salt int, shard int")
    rest = items.filter(~over(heavy))
    n = rest.count()
    buckets = max(1, -(-n // groups_per_bucket))
    share = np.maximum(residual, 0.0)
    share = share / np.maximum(share.sum(0), 1e-12)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sizes = part[list(DIMS)].to_numpy(float)
        own = sizes.sum(0)
        weight = (sizes / np.maximum(own, 1e-12)).sum(1)
        order = np.lexsort((part["salt"].to_numpy(), part["key"].map(bytes).to_numpy(object).astype("S16"), -weight))
        shard_of = np.empty(len(part), np.int64)
        shard_of[order] = place(sizes[order], share * own, own / shards, int(key[0]))
        return pd.DataFrame({"key": part["key"], "salt": part["salt"], "shard": shard_of})

    ship_with_tasks(__name__)
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("key", "salt"), F.lit(buckets)))
    placed = rest.groupBy("bucket").applyInPandas(run, "key binary, salt int, shard int").unionByName(first)
    of_key = placed.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("salt", "shard"))).alias("at"))
    out = rows.join(of_key, "key").withColumn("shard", F.coalesce(F.expr("at[-1]"), F.expr("at[salt]")))
    return _slots(out.select(id_col, "size", "text_crc32", "shard"), id_col, int(total[2]))


def _slots(rows: DataFrame, id_col: str, n: int, rows_per_part: int = 50_000) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: the rows of the shard's earlier parts plus the place within its own
    part, so no task holds a whole shard. Parts are numbered before the rows are written, so both uses see the same."""
    parts = max(1, -(-n // rows_per_part))
    salt = F.xxhash64(id_col, "text_crc32", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("part", F.pmod(salt, F.lit(parts))), "sharded")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS before")
    order = f"row_number() OVER (PARTITION BY shard, part ORDER BY `{id_col}`, size, text_crc32) - 1"
    numbered = rows.withColumn("within", F.expr(order)).join(before, ["shard", "part"])
    return numbered.select(id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                           (F.col("within") + F.col("before")).cast("long").alias("slot"))
