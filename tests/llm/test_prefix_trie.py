"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.llm import prefix_trie
from factorloom.plans import joins

DDL = "conv_id long, turn long, role string, text string, depth long, key string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, out = defaultdict(list), []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    for node, who in members.items():
        under = list(below(node))
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]),
                    sum(not children[n] for n in under), sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in under if n),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL)
    return sorted((tuple(r) for r in prefix_trie.shared_prefixes(df, **how).collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)  # several texts of members a node
    rng = random.Random(block)
    rows = [(c, t, rng.choice("ua"), rng.choice(["a", "b c", "", "d e f"])) for c in range(90) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "u", "the same again") for c in range(100, 160) for t in range(6)]  # a hot conversation
    rows += [(-7, 0, None, None), (-7, None, "u", "first"), (None, 1, "u", "nobody"), (5, 0, "u", "tie"), (5, 0, "u", "tie"), (500, 0, "u", "x" * 200_000)]
    assert found(spark, rows, block=block) == plain(rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "broadcast_limit", lambda spark: -1)
    rows = [(c, t, "u", str(c % 3 if t else 0)) for c in range(40) for t in range(5)]
    assert found(spark, rows) == plain(rows)


def test_long_conversations(spark):
    rows = [(c, t, "u", "w" if t < 300 else str(c)) for c in (1, 2, 21) for t in range(310)]
    got = found(spark, rows)
    assert len(got) == len(plain_nodes(rows)) and max(r[1] for r in got) >= 306


def plain_nodes(rows):
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    nodes = set()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        nodes |= {built[:d] for d in range(len(built) + 1)}
    return nodes


def test_empty_table_and_turnless(spark):
    assert found(spark, []) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "gone")]
    assert found(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_blocks_without_siblings_are_not_regrouped(spark):
    rows = spark.createDataFrame([(c, p, 5, 6, 1) for c in (1, 2) for p in range(1, 9)], "conv_id long, pos long, h1 long, h2 long, words long")
    blocks = prefix_trie.blocks_of(rows)
    assert blocks.count() == 4 and blocks.select("depth", "s1", "s2").distinct().count() == 2
    assert blocks.agg(F.max(F.size("turns"))).first()[0] == prefix_trie.BLOCK
