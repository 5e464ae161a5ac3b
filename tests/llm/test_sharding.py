"""Shards: balance, groups of equal texts, gapless slots, odd input."""

import zlib

import numpy as np
import pytest

from factorloom.llm import sharding


def rows_of(df, **kw):
    return sharding.shard(df, **kw).collect()


def check(rows, n, shards=8):
    assert len(rows) == n
    for s in {r["shard"] for r in rows}:
        assert 0 <= s < shards
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


@pytest.mark.parametrize("per_bucket", [20_000, 60])
def test_balance_and_groups(spark, per_bucket):
    rng = np.random.default_rng(0)
    texts = [f"t{rng.integers(600)} " * int(rng.integers(1, 40)) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = rows_of(df, groups_per_bucket=per_bucket)
    check(rows, 3000)
    by = {r["doc_id"]: r for r in rows}
    place = {}
    for i, t in enumerate(texts):
        assert by[i]["size"] == len(t.encode()) + 1 and by[i]["text_crc32"] == zlib.crc32(t.encode())
        assert place.setdefault(t, by[i]["shard"]) == by[i]["shard"]
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(sizes) < 1.05 * min(sizes) and max(counts) < 1.1 * min(counts)


def test_hot_group_is_split(spark):
    df = spark.createDataFrame([(i, "copy " * 20 if i % 3 else f"own {i} " * 9) for i in range(900)], "doc_id long, text string")
    rows = rows_of(df)
    check(rows, 900)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) < 1.1 * min(sizes)


def test_odd_rows(frame):
    rows = [(1, None), (1, None), (None, ""), (2, ""), (3, "ñ"), (3, "ñ"), (4, "long " * 50_000)]
    got = rows_of(frame(rows))
    check(got, len(rows))
    assert sorted((r["size"], r["text_crc32"]) for r in got)[:4] == [(1, 0)] * 4


def test_empty_table(frame):
    assert rows_of(frame([])) == []


def test_place_prefers_the_fitting_shard():
    capacity = np.array([10.0, 10, 10])
    residual = np.array([[1.0, 9, 9], [9.0, 1, 9], [5.0, 5, 5]])
    assert sharding.place(np.array([[8.0, 1, 1]]), residual, capacity).tolist() == [1]
    assert residual[1].tolist() == pytest.approx([1, 0, 8])
