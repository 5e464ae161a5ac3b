"""Fingerprints, links and groups against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from factorloom.llm import simhash


def slow_fingerprint(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(edges, nodes):
    root = {n: n for n in nodes}
    while True:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one two", "A b C d e A b C", "é Ä ß\x0bx\x85y z " * 900])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) & (1 << 64) - 1 == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [1, 3, 256])
def test_links_have_the_components_of_all_pairs(spark, limit):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:25]:
        for _ in range(12):  # chains and crowds around some values
            v ^= 1 << rng.randrange(64)
            values.add(v if rng.random() < 0.5 else v ^ 1 << rng.randrange(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    close = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.components(simhash.links(df, bucket_limit=limit)).collect()
    want = {k: r for k, r in groups(close, signed).items() if any(k in e for e in close)}
    assert {r["node"]: r["root"] for r in found} == want


def test_near_duplicates(frame):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base.upper()), (9, base + " x"), (4, ""), (2, None), (None, "  "), (11, "other words here"), (7, base)]
    found = simhash.near_duplicates(frame(rows)).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(found) == len(rows) and by[7] == by[3] == {3} and by[4] == by[2] == by[None] == {2} and by[11] == {11}
    fps = {r["fp"] for r in found}
    linked = groups([(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2], fps)
    first = {}
    for r in found:
        if r["doc_id"] is not None:
            first[linked[r["fp"]]] = min(r["doc_id"], first.get(linked[r["fp"]], r["doc_id"]))
    assert all(r["component_id"] == first[linked[r["fp"]]] for r in found)


def test_only_null_ids(frame):
    assert [r["component_id"] for r in simhash.near_duplicates(frame([(None, "a b c d")])).collect()] == [None]


def test_empty_table(spark, frame, tmp_path):
    assert simhash.near_duplicates(frame([])).count() == 0
    frame([]).write.parquet(str(tmp_path / "none"))
    assert simhash.first_of_each(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_first_of_each_against_all_pairs(spark, frame, tmp_path):
    rng = random.Random(2)
    rows = []
    for base in range(12):
        words = [f"b{base}w{rng.randrange(500)}" for _ in range(150)]
        for copy in range(8):
            edited = list(words)
            for _ in range(copy % 3):
                edited[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 97, " ".join(edited), f"s{copy}"))
    rows += [(200, ""), (201, None), (202, " "), (None, rows[0][1]), (rows[5][0], rows[5][1])]
    frame(rows).withColumnRenamed("key", "num").write.parquet(str(tmp_path / "docs"))
    kept = simhash.first_of_each(spark.read.parquet(str(tmp_path / "docs")))
    assert kept.columns == ["doc_id", "text", "source", "num"]
    nodes = range(len(rows))
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if simhash.similarity_of(rows[a][1], rows[b][1]) >= 0.8]
    root = groups(edges, nodes)
    want = {}
    for n in nodes:
        if rows[n][0] is not None:
            want[root[n]] = min(rows[n][0], want.get(root[n], 10**9))
    got = {r["doc_id"] for r in kept.collect()}
    assert kept.count() == len(got)
    assert got == set(want.values())


def test_similar_groups_are_whole(frame):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(12):
        words = [word() for _ in range(60)]
        texts += [words, words + [word() for _ in range(13)], words[:-11], [word() for _ in range(12)] + words]
    shared = [word() for _ in range(40)]
    for _ in range(30):  # strangers around one passage, and one pair among them
        texts.append(shared + [word() for _ in range(25)])
    texts += [texts[-9] + [word()], shared, shared + [word()]]
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    nodes = range(len(texts))
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if simhash.similarity_of(texts[a], texts[b]) >= 0.8]
    want = groups(edges, nodes)
    df = frame([(i, t) for i, t in enumerate(texts)]).selectExpr("doc_id AS num", "text")
    for limit in (64, 3):
        got = {r["num"]: r["root"] for r in simhash.similar_groups(df, list_limit=limit).collect()}
        assert got == want


def test_similar_groups_start_from_the_fingerprints(frame, monkeypatch):
    """Copies of one fingerprint are linked by SimHash, and only what it does not reach meets in the lists of shingles."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base.upper(), base + " \n", " ".join(f"v{i}" for i in range(60)), base + " a b c"]
    asked, met = [], []
    plain, verified = simhash.near_duplicates, simhash._verified
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a: asked.append(a[2]) or plain(*a))
    monkeypatch.setattr(simhash, "fingerprint_of", lambda t, w=3: len((t or "").split()) // 100)  # all fingerprints meet
    monkeypatch.setattr(simhash, "_verified", lambda d, p, *a: met.append(sorted(map(tuple, p.collect()))) or verified(d, p, *a))
    df = frame(list(enumerate(texts))).selectExpr("doc_id AS num", "text")
    got = {r["num"]: r["root"] for r in simhash.similar_groups(df).collect()}
    assert asked == ["num"] and met[0] == [(0, 3), (0, 4)] and met[1] == []
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}


def test_only_texts_of_possible_pairs_are_sent(frame, monkeypatch):
    """Texts around one passage meet in its lists; by the parities of their shingles most are known to be too far apart."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(40)]
    texts = [" ".join(shared + [word() for _ in range(60)]) for _ in range(30)]
    texts += [texts[4] + " x y", texts[9] + " z", "", texts[0].upper()]
    sent, compared = simhash.similarity_of, []
    monkeypatch.setattr(simhash, "_often", lambda *a: np.empty(0, np.int64))
    plain = simhash._possible
    monkeypatch.setattr(simhash, "_possible", lambda p, *a: (lambda q: compared.append((p.count(), q.count())) or q)(plain(p, *a)))
    df = frame(list(enumerate(texts))).selectExpr("doc_id AS num", "text")
    got = {r["num"]: r["root"] for r in simhash.similar_groups(df).collect()}
    nodes = range(len(texts))
    assert got == groups([(a, b) for a, b in itertools.combinations(nodes, 2) if sent(texts[a], texts[b]) >= 0.8], nodes)
    assert sum(met for met, _ in compared) > 30 and sum(left for _, left in compared) <= 6


def test_parities_lose_no_similar_pair():
    rng = random.Random(9)
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 3000))]
        other = [w if rng.random() > 0.02 else f"e{rng.randrange(10**6)}" for w in words]
        a, b = " ".join(words), " ".join(other)
        x, y = simhash._hashes(a, 5), simhash._hashes(b, 5)
        cut = x[:rng.randrange(len(x) + 1)]
        for near in (y, cut):
            apart = len(set(x.tolist()) ^ set(near.tolist()))
            assert simhash._bits_apart(simhash._parity(x), simhash._parity(near)) <= apart
