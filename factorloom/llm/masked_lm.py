"""Masked pseudo-likelihood of documents: a bidirectional window network predicts every token from both sides.

A token's context are WINDOW words before and after it; the token itself is masked. The embeddings of the context, in
their order, meet in a hidden layer, which predicts the token's class; within a class a word has its share
of the corpus counts. The document's score is the sum of the log probabilities of all its tokens.

Counts cover the corpus. Words are put into classes of about equal mass by rank. The network is trained by rounds of
parameter averaging: every task runs through its own rows from the same start, and Spark averages the parameters,
weighted by tokens, so training reads all rows too and the driver holds one model of fixed size.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut_at_zeros, split_tokens
from factorloom.plans.runtime import ship_with_tasks, stage

#: Words on each side; sizes of embeddings and hidden layer; tokens in one step of training and of scoring.
WINDOW, EMBED, HIDDEN, STEP, BLOCK = 2, 16, 24, 512, 1 << 12


@dataclass(frozen=True)
class Vocabulary:
    """Ids 1 to len(words) in order of counts, then `buckets` ids for all other words, by hash. Id 0 stands beyond a
    document's ends. Arrays by id: class, and a word's log share within the class. The words of a bucket have equal shares of
    its mass, so that the probabilities of all words of the corpus sum to 1, however many rare ones it has."""

    words: dict[str, int]
    buckets: int
    classes: np.ndarray
    share: np.ndarray
    n_classes: int

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.buckets

    def id_of(self, word: str) -> int:
        found = self.words.get(word)
        return found or 1 + len(self.words) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets


def word_counts(docs: DataFrame, text: str = "text", keep: int = 300_000) -> DataFrame:
    """(word, n): how often each word (a run of letters, digits or signs, in lower case) stands in all rows."""
    def run(batches):
        from collections import Counter

        tokens: Counter = Counter()

        def rows():
            words: Counter = Counter()
            numbers = iter(tokens.values())
            n = next(numbers, 0)
            for part in split_tokens(list(tokens)):
                if part == "\n":
                    n = next(numbers)
                else:
                    words[part.lower()] += n
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    tokens.update(t.split())
                if len(tokens) > keep:
                    yield rows()
        yield rows()

    ship_with_tasks(__name__)
    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_vocabulary(docs: DataFrame, text: str = "text", max_words: int = 1 << 14, buckets: int = 1 << 10,
                     n_classes: int = 64) -> Vocabulary:
    """The `max_words` most frequent words keep ids of their own; the others are counted by bucket, their places and the
    distinct words of them, so every word of the corpus has its mass."""
    counts = stage(word_counts(docs, text), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(max_words).collect()
    words = {r["word"]: k for k, r in enumerate(top, 1)}
    own = np.array([r["n"] for r in top], np.float64)
    rest = (counts.select("n", (F.crc32("word") % buckets).alias("bucket")).groupBy("bucket")
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect())
    mass, distinct = np.zeros(buckets), np.zeros(buckets)
    for r in rest:
        mass[r["bucket"]], distinct[r["bucket"]] = r["n"], r["distinct"]
    for r in top:
        bucket = zlib.crc32(r["word"].encode("utf-8", "surrogatepass")) % buckets
        mass[bucket] -= r["n"]
        distinct[bucket] -= 1
    every = np.concatenate([[0.0], own, np.maximum(mass, 0)]) + 0.5
    every[0] = 0
    ahead = np.cumsum(every) - every / 2
    classes = np.minimum((ahead / max(every.sum(), 1.0) * n_classes).astype(np.int64), n_classes - 1)
    in_class = np.bincount(classes, every, n_classes)
    with np.errstate(divide="ignore"):
        share = np.log(np.maximum(every, 1e-300) / np.maximum(in_class[classes], 1e-300))
    share[1 + len(top):] -= np.log(np.maximum(distinct, 1))
    return Vocabulary(words, buckets, classes.astype(np.int16), share.astype(np.float32), n_classes)


@dataclass(frozen=True)
class Network:
    """embed: size x EMBED; w1, b1: the hidden layer; w2, b2: the classes."""

    embed: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def start(cls, size: int, n_classes: int, seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(f(size, EMBED, scale=0.1), f(2 * WINDOW * EMBED, HIDDEN, scale=1 / math.sqrt(2 * WINDOW * EMBED)),
                   np.zeros(HIDDEN, np.float32), f(HIDDEN, n_classes, scale=1 / math.sqrt(HIDDEN)), np.zeros(n_classes, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.w1, self.b1, self.w2, self.b2]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> "Network":
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.take(self.embed, context.ravel(), axis=0).reshape(len(context), -1)
        h = x @ self.w1
        h += self.b1
        return x, np.tanh(h, out=h)

    def steep(self) -> bool:
        """Whether a class can have a number that exp cannot take; hidden values are at most 1."""
        return not float(np.abs(self.w2).sum(0).max(initial=0) + np.abs(self.b2).max(initial=0)) < 40

    def log_classes(self, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The log probability of the given class in each context."""
        z = self.hidden(context)[1] @ self.w2
        z += self.b2
        if self.steep():
            z -= z.max(1, keepdims=True)
        chosen = z[np.arange(len(z)), classes]
        np.exp(z, out=z)
        return chosen - np.log(z @ np.ones(z.shape[1], z.dtype))


def contexts(ids: np.ndarray) -> np.ndarray:
    """The ids around each place, masked centre left out; 0 beyond the ends."""
    padded = np.concatenate([np.zeros(WINDOW, ids.dtype), ids, np.zeros(WINDOW, ids.dtype)])
    n = len(ids)
    return np.stack([padded[k:k + n] for k in range(2 * WINDOW + 1) if k != WINDOW], axis=1)


class Ids:
    """Texts as vocabulary ids, with a bounded memory of tokens."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 500_000):
        self.vocabulary, self.keep, self.known = vocabulary, keep, {}

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self.known) > self.keep:
            self.known = {}
        new = list(set(tokens).difference(self.known))
        if new:
            find = self.vocabulary.id_of
            ids = [0 if p == "\n" else find(p.lower()) for p in split_tokens(new)]
            self.known.update(zip(new, cut_at_zeros(np.array(ids, np.uint32))))
        return np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), np.uint32).astype(np.int32)


def train_block(net: Network, context: np.ndarray, target: np.ndarray, rate: float) -> Network:
    """One pass of stochastic gradient descent over the rows, STEP at a time."""
    embed, w1, b1, w2, b2 = (a.copy() for a in net.arrays())
    now = Network(embed, w1, b1, w2, b2)
    context = context.astype(np.uint16) if len(embed) <= 1 << 16 else context  # short numbers are sorted by digits
    for at in range(0, len(target), STEP):
        c, t = context[at:at + STEP], target[at:at + STEP]
        x, h = now.hidden(c)
        p = h @ w2
        p += b2
        if now.steep():
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        each = np.ones(p.shape[1], p.dtype)
        p *= (1 / (p @ each * len(t)))[:, None]
        p[np.arange(len(t)), t] -= p.dtype.type(1 / len(t))
        back = p @ w2.T
        back *= 1 - h * h
        dx = (back @ w1.T).reshape(-1, EMBED)
        one = np.ones(len(t), p.dtype)
        w2 -= rate * (h.T @ p)
        b2 -= rate * (one @ p)
        w1 -= rate * (x.T @ back)
        b1 -= rate * (one @ back)
        # words are met rarely: their step is not averaged over the batch
        words = c.ravel()
        order = np.argsort(words, kind="stable")
        words = words[order]
        ends = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        embed[words[ends]] -= rate * 4 * np.add.reduceat(np.take(dx, order, axis=0), ends, axis=0)
    return now


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids) of every row: the vocabulary ids of the whole text, unsigned 32-bit, as bytes. Null, empty and wordless
    texts have none."""
    kind = docs.schema[id_col].dataType
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        reader = Ids(held.value)
        for batch in batches:
            ids = [reader.of(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    ship_with_tasks(__name__)
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids binary")


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4").astype(np.int32) for b in column.to_pylist()]


def train_round(rows: DataFrame, vocabulary: Vocabulary, net: Network, rate: float) -> Network:
    """Every task trains on all token places of its rows, and the parameters are averaged over the tasks by places. Partial sums are added in two steps, so that no task meets the parameters of
    all tasks."""
    held = rows.sparkSession.sparkContext.broadcast((vocabulary.classes, net))

    def run(batches):
        classes, now = held.value
        seen, waiting = 0, 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(now):
            c = np.concatenate([k[0] for k in kept])
            t = np.concatenate([k[1] for k in kept])
            kept.clear()
            mix = np.random.default_rng(len(t)).permutation(len(t))
            return train_block(now, c[mix], t[mix], rate)

        for batch in batches:
            for ids in _arrays(batch.column(0)):
                if len(ids):
                    kept.append((contexts(ids), classes[ids].astype(np.int64)))
                    seen, waiting = seen + len(ids), waiting + len(ids)
                if waiting > BLOCK:
                    now, waiting = learn(now), 0
        if kept:
            now = learn(now)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([now.flat().astype("<f4").tobytes()], pa.binary())],
                                             names=["n", "parameters"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total, n = None, 0
        for k, p in zip(parts["n"], parts["parameters"]):
            part = np.frombuffer(p, "<f4").astype(np.float64) * k
            total, n = part if total is None else total + part, n + k
        return pd.DataFrame({"n": [n], "parameters": [(total / n).astype("<f4").tobytes()]})

    ship_with_tasks(__name__)
    ddl = "n bigint, parameters binary"
    sums = stage(rows.select("ids").mapInArrow(run, ddl), "trained")
    parts = sums.count()
    while parts > 16:
        parts = -(-parts // 16)
        sums = sums.withColumn("_g", F.pmod(F.xxhash64("parameters"), F.lit(parts)))
        sums = stage(sums.groupBy("_g").applyInPandas(add, ddl), "sums")
        parts = sums.count()
    rows = sums.collect()
    if not rows:
        return net
    weights = np.array([r["n"] for r in rows], np.float64)
    mean = sum(np.frombuffer(r["parameters"], "<f4").astype(np.float64) * w for r, w in zip(rows, weights / weights.sum()))
    return net.filled(mean)


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: Vocabulary
    network: Network

    def log_probabilities(self, texts: list[np.ndarray]) -> list[float]:
        """The sum over each text's tokens. Texts are scored together, a block of places at a time."""
        ids = np.concatenate([np.zeros(0, np.int32), *texts])
        around = np.concatenate([np.zeros((0, 2 * WINDOW), np.int32), *map(contexts, texts)])
        each = np.empty(len(ids) + 1, np.float64)
        each[0] = 0
        for at in range(0, len(ids), BLOCK):
            t = ids[at:at + BLOCK]
            each[at + 1:at + 1 + len(t)] = self.network.log_classes(around[at:at + BLOCK], self.vocabulary.classes[t])
            each[at + 1:at + 1 + len(t)] += self.vocabulary.share[t]
        ends = np.cumsum([len(t) for t in texts])
        return [float(each[end - len(t) + 1:end + 1].sum()) for end, t in zip(ends, texts)]


def _train(rows: DataFrame, vocabulary: Vocabulary, rounds: int, rate: float) -> LanguageModel:
    net = Network.start(vocabulary.size, vocabulary.n_classes)
    for r in range(rounds):
        net = train_round(rows, vocabulary, net, rate / (1 + r))
    return LanguageModel(vocabulary, net)


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rounds: int = 1, rate: float = 0.5, **sizes) -> LanguageModel:
    """Counts and training over all places of all rows of `docs`, once a round. An empty table gives a model without words."""
    vocabulary = build_vocabulary(docs, text, **sizes)
    return _train(stage(encoded(docs, vocabulary, text, id_col), "ids"), vocabulary, rounds, rate)


def fit_and_score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rounds: int = 1, rate: float = 0.5,
                  **sizes) -> DataFrame:
    """`score` of `docs` by the model fitted on them; their texts become ids once, for both."""
    vocabulary = build_vocabulary(docs, text, **sizes)
    rows = stage(encoded(docs, vocabulary, text, id_col), "ids")
    return _scored(rows, _train(rows, vocabulary, rounds, rate), id_col)


def score(docs: DataFrame, model: LanguageModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, log_probability, mean_log_probability) for every row, over all tokens of its text. Null,
    empty and wordless texts have no tokens, a sum of 0 and a null mean; repeated rows equal scores."""
    return _scored(encoded(docs, model.vocabulary, text, id_col), model, id_col)


def _scored(rows: DataFrame, model: LanguageModel, id_col: str) -> DataFrame:
    kind = rows.schema[id_col].dataType
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            ids = _arrays(batch.column(1))
            sums = [x for at in range(0, len(ids), 64) for x in model.log_probabilities(ids[at:at + 64])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(sums, pa.float64()),
                 pa.array([s / len(i) if len(i) else None for s, i in zip(sums, ids)], pa.float64())],
                names=[id_col, "n_tokens", "log_probability", "mean_log_probability"])

    ship_with_tasks(__name__)
    ddl = f"`{id_col}` {kind.simpleString()}, n_tokens bigint, log_probability double, mean_log_probability double"
    return rows.select(id_col, "ids").mapInArrow(run, ddl)
