"""The audit of five filters against plain loops, and the merges of posting lists against sets."""

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from factorloom.llm import filter_audit as fa
from factorloom.plans import joins


def fails(i, rows):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = text.encode().split()
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    again = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
    return out + "E" * again


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for i, (d, _, part) in enumerate(rows):
        parts[part or ""].append((d, fails(i, rows)))
    out = []
    for part, docs in parts.items():
        total = defaultdict(int)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                steps.append((order, step, len(left), len(gone), sum(f in x[1] for x in docs) - len(gone), sum(x[1] == f for x in docs),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out += [(part, *s, total[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


@pytest.mark.parametrize("limit", [None, -1])
def test_audit(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(joins, "broadcast_limit", lambda spark: limit)
    monkeypatch.setattr(fa, "RANGE_BITS", 3)
    rng = random.Random(4)
    texts = ["", None, "Short one", "a b " * 40, "#", " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)),
             "long " * 50_000, "é " * 55]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "s", "t", None, ""])) for _ in range(80)] + [(3, "#", "s")] * 2
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, source string, num long, mask int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in fa.audit(docs, marks).collect())
    assert got == plain(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert fa.audit(one, labels).filter("kept = 0").count() > 0


def test_merges():
    rng = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(400), rng.choice([0, 1, 5, 90, 300]))), np.int64) for _ in range(3)]
        sets = [set(x.tolist()) for x in lists]
        assert fa.united(lists).tolist() == sorted(set.union(*sets))
        assert fa.missing(lists[0], lists[1]).tolist() == sorted(sets[0] - sets[1])
        assert fa.gallop(lists[0], lists[1]).tolist() == np.searchsorted(lists[1], lists[0]).tolist()
