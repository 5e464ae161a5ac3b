"""Joins from a big fact side to a lookup table, safe for hot keys and for big tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.plans.runtime import cut_lineage, is_stored, shuffle_width, stage

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30}


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes allowed in a broadcast: the session's own spark.sql.autoBroadcastJoinThreshold."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text).groups()
    return int(number) * _UNITS[unit]


def measured_bytes(df: DataFrame) -> int:
    """Size of a table of scalar columns by one aggregate job: counted rows, measured strings."""
    fixed, texts = 16, []
    for f in df.schema.fields:
        fixed += 16
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            texts.append(F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)))
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 reduce(lambda a, b: a + b, texts, F.lit(0).cast("bigint")).alias("texts")).first()
    return row["rows"] * fixed + row["texts"]


# Never more than this many keys are treated as hot. A key that is not among the heaviest 4096 holds
# less than 1/4096 of the rows, which a plain shuffle can carry.
_HOT_KEYS = 4096
# Parts into which the facts of a hot key are dealt.
_SALTS = 128
# Facts that a task of a shuffled join takes on average at most, about 200 MB with their sort.
_FACTS_PER_TASK = 2_000_000


def heavy_keys(facts: DataFrame, on: list[str], floor: int = 10_000) -> DataFrame:
    """The heaviest keys with more than `floor` rows, at most 4096, so always small enough to
    broadcast. One pass; counts are combined before their shuffle."""
    return heaviest(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")), on, floor)


def heaviest(counts: DataFrame, on: list[str], floor: int = 10_000) -> DataFrame:
    """The same from a table of counted keys (on, rows)."""
    return cut_lineage(counts.filter(F.col("rows") > floor).orderBy(F.desc("rows")).limit(_HOT_KEYS).select(*on))


def lookup_join(facts: DataFrame, table: DataFrame, on: list[str], table_bytes: int,
                how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join facts to a table that is unique in `on`; `how` is left or inner.

    Small table: broadcast. Big table: facts are stored, if they are not, and read in parts. Those of the few hot keys meet
    the rows of these keys, which are broadcast; those of a null key meet none; only the others are shuffled, to as many
    tasks as their number asks for. With hot keys given, facts that are not stored go through one salted join, and are
    evaluated once: facts of a hot or null key are dealt by a hash of their own columns into _SALTS parts, and the table
    rows of hot keys are copied to all of them."""
    if table_bytes <= broadcast_limit(facts.sparkSession):
        return facts.join(F.broadcast(table), on, how)
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    if hot is None or is_stored(facts):
        return _join_parts(facts if is_stored(facts) else stage(facts, "facts"), table, on, how, hot, null_key)
    tags = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    loose = null_key | F.col("_hot").isNotNull()
    salt = F.when(loose, F.pmod(F.xxhash64(*facts.columns), F.lit(_SALTS)).cast("int")).otherwise(F.lit(0))
    left = facts.join(tags, on, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(tags, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _join_parts(facts: DataFrame, table: DataFrame, on: list[str], how: str, hot: DataFrame | None,
                null_key: Column) -> DataFrame:
    """`lookup_join` of stored facts, as the union of the facts of hot keys, of other keys and of null keys."""
    hot = heavy_keys(facts, on) if hot is None else hot.select(*on)
    given = [c for c in facts.columns if c not in on]
    added = [f for f in table.schema.fields if f.name not in on]
    shape = [*on, *given, *[f.name for f in added]]
    parts, cold = [], facts.filter(~null_key)
    if not hot.isEmpty():
        known = table.join(F.broadcast(hot), on, "left_semi")
        known = hot.join(F.broadcast(known), on, "left") if how == "left" else known
        parts.append(facts.join(F.broadcast(known), on))
        cold = cold.join(F.broadcast(hot), on, "left_anti")
    tasks = -(-facts.count() // _FACTS_PER_TASK)
    if tasks > shuffle_width(facts.sparkSession):
        cold, table = cold.repartition(tasks, *on), table.repartition(tasks, *on)
    parts.append(cold.join(table, on, how))
    if how == "left":
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in added]
        parts.append(facts.filter(null_key).select("*", *nothing))
    return reduce(DataFrame.unionAll, [p.select(*shape) for p in parts])
