"""Conversations as a trie of their turns, built from digests of fixed-length blocks of turns.

Turns are replaced by two 64-bit hashes. The digest of the first d turns is the sum of hashes that hold the turn's
place, so it is a running sum. Conversations are first grouped by the digests at the ends of blocks of BLOCK turns.
Where a block has no sibling, its inner turns are nodes with the members of its end, and nothing more is grouped.
Where siblings diverge, turn boundaries are found by grouping the distinct blocks, not the conversations.

A node's smallest member stands for it. What a subtree sums up is booked on the conversations that stand for its
nodes, and summed over the members of each node by the same grouping; so no step follows the depth of the trie.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import SPACES, text_of
from factorloom.plans.joins import lookup_join, measured_bytes
from factorloom.plans.runtime import ship_with_tasks, stage

BLOCK = 4
#: Ids of one text of members before texts are joined: 2 to this power.
CHUNK_BITS = 12
_KEY = ["depth", "s1", "s2"]


def turn_hashes(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, h1, h2, words) for every turn, pos from 1 in the order of turn (null first, then role and text).
    Rows without an id are no conversation's."""
    who, what = text_of(role), text_of(text)
    trimmed = F.btrim(what, F.lit(SPACES))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), F.xxhash64(who, what).alias("h1"),
        F.xxhash64(F.lit(7), what, F.length(who), who).alias("h2"), words.alias("words"), F.md5(what).alias("tie"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "h1", "h2", "words")


def share_starts(hashed: DataFrame, span: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % span, then its own turns after its first h;
    h = crc32(c) % most. Returns (conv_id, pos, h1, h2, words); a conversation without a turn has one row with a null pos.

    A start is copied to the ids of its span only, so never more than 2 * span - 1 times."""
    ids = hashed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % span).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    ids = stage(ids, "conversations")
    bases = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = ids.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = (hashed.join(plan.select("conv_id", "h", "lent"), "conv_id").filter("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "h1", "h2", "words"))
    starts = hashed.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = starts.join(plan.select("base", "conv_id", "lent"), "base").filter("pos <= lent")
    empty = plan.filter("lent = 0 AND n <= h").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("pos", "h1", "h2", "words")])
    return own.unionByName(lent.select("conv_id", "pos", "h1", "h2", "words")).unionByName(empty)


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, s1, s2, p1, p2, from_, last, turns): one row for each block of a conversation. depth, s1, s2:
    the digest at its end; from_, p1, p2: that before it. turns: at most `block` structs (depth, s1, s2, words).
    last: nothing follows. An empty conversation has one row of depth 0."""
    place = lambda h: F.xxhash64(F.col("pos"), F.col(h)) % F.lit(1 << 61)
    wide = rows.select("conv_id", F.coalesce("pos", F.lit(0)).cast("long").alias("depth"), F.coalesce("words", F.lit(0)).cast("long").alias("words"),
                       *[F.when(F.col("pos").isNull(), F.lit(0)).otherwise(place(h)).alias(k) for h, k in (("h1", "a1"), ("h2", "a2"))])
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Sums modulo 2^61, as plain sums of longs could overflow.
    summed = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(38,0)")).over(so_far), F.lit(1 << 61).cast("decimal(38,0)")).cast("long")
    digests = wide.select("conv_id", "depth", "words", summed("a1").alias("s1"), summed("a2").alias("s2"))
    step = Window.partitionBy("conv_id").orderBy("depth")
    digests = digests.select("*", *[F.coalesce(F.lag(c).over(step), F.lit(0)).cast("long").alias(p) for c, p in (("s1", "p1"), ("s2", "p2"))],
                             F.lead("depth").over(step).isNull().alias("last"))
    turn = F.struct("depth", "s1", "s2", "words")
    found = digests.groupBy("conv_id", F.floor((F.col("depth") + block - 1) / block).alias("block")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2"),
        F.max("last").alias("last"))
    end = F.element_at("turns", -1)
    return found.select("conv_id", end["depth"].alias("depth"), end["s1"].alias("s1"), end["s2"].alias("s2"), "p1", "p2",
                        (F.col("turns")[0]["depth"] - 1).alias("from_"), "last", "turns")


def _turn_nodes(ends: DataFrame, sums: list[str], least: str | None = None) -> DataFrame:
    """Grouped block ends as turn nodes (depth, s1, s2, p1, p2, words, *sums, least). Only where blocks with one
    start diverge are their turns grouped again, and of blocks, not of conversations."""
    siblings = ends.filter("depth > 0").groupBy("from_", "p1", "p2").agg(F.count(F.lit(1)).alias("siblings")).filter("siblings > 1")
    tagged = lookup_join(ends, siblings, ["from_", "p1", "p2"], measured_bytes(siblings))
    keep = [*sums, *([least] if least else [])]
    each = tagged.select(F.col("siblings").isNotNull().alias("split"), "p1", "p2", *keep, F.posexplode("turns").alias("at", "t"), "turns")
    before = lambda c, p: F.when(F.col("at") == 0, F.col(p)).otherwise(F.get("turns", F.col("at") - 1)[c])
    each = each.select("split", *[F.col(f"t.{c}").alias(c) for c in (*_KEY, "words")], before("s1", "p1").alias("p1"),
                       before("s2", "p2").alias("p2"), *keep)
    aggs = [F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"), *[F.sum(c).alias(c) for c in sums]]
    aggs += [F.min(least).alias(least)] if least else []
    whole = each.filter("NOT split").drop("split")
    return whole.unionByName(each.filter("split").groupBy(*_KEY).agg(*aggs).select(*whole.columns))


def _with_root(nodes: DataFrame, root: DataFrame) -> DataFrame:
    return nodes.filter("depth > 0").unionByName(root.select(*nodes.columns))


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256): SHA-256 of the ids of the conversations that end in a node, in order, joined by
    commas. ends: (conv_id, depth, s1, s2). Ids meet in texts of at most 2^CHUNK_BITS ids each; a node of several such
    texts is hashed by a task that reads them one after the other and holds one at a time."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    texts = ends.groupBy(*_KEY, chunk.alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    texts = stage(texts, "members")
    chunks = texts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    single = chunks.filter("n = 1").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = texts.join(chunks.filter("n > 1").select(*_KEY), _KEY, "left_semi").repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")

    def run(batches):
        now, digest = None, None
        rows: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if key != now:
                    if now:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), r)) for r in rows], schema)
                rows = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip((*_KEY, "ends_sha256"), (*now, digest.hexdigest())))], schema)

    schema = pa.schema([("depth", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("ends_sha256", pa.string())])
    ship_with_tasks(__name__)
    long = many.select(*_KEY, "ids").mapInArrow(run, "depth bigint, s1 bigint, s2 bigint, ends_sha256 string")
    return single.unionByName(long)


def trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256). rows: (conv_id, pos, h1, h2, words), pos gapless from 1, null for a
    conversation without turns. conv_id is the node's smallest member. No rows, no nodes; else a root of depth 0."""
    blocks = stage(blocks_of(rows, block), "blocks")
    key, by = [*_KEY, "from_", "p1", "p2"], F.first("turns").alias("turns")
    ends = stage(blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), by), "block_ends")
    zero = lambda kind: F.lit(0).cast(kind)
    firsts = blocks.filter("from_ <= 0")  # the first block of every conversation, or its only row
    root = firsts.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        "*", *[zero("long").alias(c) for c in (*_KEY, "p1", "p2", "words")])
    nodes = stage(_with_root(_turn_nodes(ends, ["n_convs"], "conv_id"), root), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero("long")))
    nodes = stage(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("words")), "counted")
    # What the nodes below add is booked on the conversation that stands for them.
    after = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = stage(nodes.withColumn("below", F.sum("value").over(after)), "booked")
    booked = nodes.groupBy("conv_id").agg(F.sum("value").alias("value"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    sums = stage(blocks.join(booked, "conv_id").groupBy(*key).agg(F.sum("value").alias("all_value"), F.sum("leaves").alias("n_leaves"), by), "sums")
    total = firsts.select("conv_id").join(booked, "conv_id").agg(F.sum("value").alias("all_value"), F.sum("leaves").alias("n_leaves")).select(
        "*", *[zero("long").alias(c) for c in (*_KEY, "p1", "p2", "words")])
    totals = _with_root(_turn_nodes(sums, ["all_value", "n_leaves"]), total).select(*_KEY, "all_value", "n_leaves")
    tips = member_digests(blocks.filter("last").select("conv_id", *_KEY))
    out = nodes.join(totals, _KEY).join(tips, _KEY, "left").join(booked.select("conv_id", F.col("value").alias("own")), "conv_id")
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"),
                                                    F.col("conv_id").alias("parent_conv_id"))
    out = lookup_join(out, parents, ["depth", "p1", "p2"], measured_bytes(parents))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (F.col("below") + F.col("all_value") - F.col("own")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def shared_prefixes(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                    span: int = 20, most: int = 4, block: int = BLOCK) -> DataFrame:
    """The trie of the conversations of `turns`, whose starts are shared as in `share_starts`.

    Turns go by turn number, null first; equal numbers by role and a digest of the text; null roles and texts are
    empty. Rows without a conversation id belong to none and are left out; repeated rows are turns of their own. Other
    columns are not read; an empty table gives no rows."""
    hashed = stage(turn_hashes(turns, id_col, turn, role, text), "turns")
    return trie(share_starts(hashed, span, most), block)
