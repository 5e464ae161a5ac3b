"""Every stage of the pipeline against a plain version of what it must keep."""

import os
import random

import pytest

import corpus_pipeline as cp
from factorloom.llm import decontaminate, line_rules, simhash

NAMES = [n for n, _ in cp.STAGES]


def test_stages_and_order():
    assert NAMES == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "packing"]
    assert cp.ORACLE_SQL is None


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    texts, labels = {}, []
    for i in range(240):
        words = [word() for _ in range(80)]
        if i % 6 == 0:
            words[10], words[50] = rng.sample(["idiot", "moron", "clown"], 2)
        labels.append((i, 1, int(i % 6 == 0)))
        texts[i] = " ".join(words)
    for i in range(5):
        texts[300 + i] = texts[i + 1]  # copies
        texts[310 + i] = texts[i + 1] + " more"  # near copies
        texts[320 + i] = texts[20 + i].replace(" ", " ; ", 1) + " " + items[i][1].upper() + " end"  # leaks
    texts |= {400: None, 401: "", 402: "too short", 403: "again and again " * 60}
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts.items()] + [(1, texts[1], "en", "s", len(texts[1]), "x")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, key string"
    for name, df in (("documents", spark.createDataFrame(rows, ddl)), ("benchmark", spark.createDataFrame(items, "item_id long, text string")),
                     ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path), texts, items


def test_each_stage(spark, corpus):
    sf_dir, texts, items = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, step) in enumerate(cp.STAGES):
        out = step(spark, docs, sf_dir)
        path = os.path.join(sf_dir, f"out{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == set(texts) - {400, 401, 402, 403}
    toxic = {i for i in kept[0] if {"idiot", "moron", "clown"} & set((texts[i] or "").split())}
    assert len(kept[0] - toxic - kept[1]) <= 2 and len(kept[1] & toxic) <= 2
    alive = sorted(kept[1])
    root = {i: i for i in alive}
    for a in alive:
        for b in alive:
            if a < b and simhash.similarity_of(texts[a], texts[b]) >= 0.8:
                root[b] = min(root[b], root[a])
    assert kept[2] == set(root.values())
    normal = {i: decontaminate.normal(texts[i]) for i in kept[2]}
    assert kept[3] == {i for i, t in normal.items() if not any(decontaminate.normal(x) in t for _, x in items)}
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == kept[3]
    for i in kept[3]:
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i)


def test_empty_documents(spark, corpus):
    sf_dir, _, _ = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, step) in enumerate(cp.STAGES):
        path = os.path.join(sf_dir, f"none{k}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0


def test_run_equals_the_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(cp.STAGES):
        step(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = cp.run(spark, sf_dir)
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}
    assert got.select(columns).schema == docs.select(columns).schema
    assert line_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kept").count() >= len({r["doc_id"] for r in docs.collect()})
