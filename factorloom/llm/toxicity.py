"""Toxicity by noisy-channel deobfuscation: Viterbi over character lattices, then weights of restored words.

A writer's word reaches us through a channel that swaps letters for look-alikes, repeats letters and puts signs or
spaces between them. Each suspicious token becomes a lattice of the letters it may stand for; the best path under a
character bigram model of the corpus and the channel's costs is the restored word. Words and their beginnings get
weights from labelled documents, and a document's score is a logistic function of the weights found in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import training_labels
from factorloom.plans.runtime import ship_with_tasks, stage

# Signs and the letters they stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "§": "s"}
#: Costs (negative log probabilities) of the channel: a look-alike, a sign between letters, a look-alike that is just a
#: sign (more than the letter it would spare), a run read as one letter, as two.
SWAP, DROP, NO_LETTER, REPEAT, KEEP_REPEAT = 1.0, 0.5, 7.0, 0.7, 2.0
#: Letters up to here count as themselves in the character model, others as one class; so it has at most 592^2 entries.
LETTERS, OTHER = 0x250, "￿"

_EDGE_LEFT = "\"'`([{<*_~#.,;:?%&^=/\\-«»“”‘’…|"
_EDGE_RIGHT = _EDGE_LEFT + ")]}>!+"
_RUN = re.compile(r"(.)\1\1", re.S)


def stripped(token: str) -> str:
    """The token without punctuation around it; a single $ at its end may be a letter, several are not."""
    body = token.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
    if body.endswith("$$"):
        body = body.rstrip("$" + _EDGE_RIGHT)
    return body.lower()


def letter_class(c: str) -> str:
    return c if ord(c) < LETTERS else OTHER


@dataclass(frozen=True)
class CharModel:
    """Negative log probabilities of a letter after another; "" before the first and after the last letter."""

    cost: dict[tuple[str, str], float]
    unseen: dict[str, float]
    default: float

    @classmethod
    def fit(cls, counts: dict[tuple[str, str], int], smooth: float = 0.5) -> "CharModel":
        total: Counter = Counter()
        for (a, _), n in counts.items():
            total[a] += n
        size = len({b for _, b in counts}) + 1
        base = {a: n + smooth * size for a, n in total.items()}
        return cls({(a, b): -math.log((n + smooth) / base[a]) for (a, b), n in counts.items()},
                   {a: -math.log(smooth / n) for a, n in base.items()}, math.log(size + 1))

    def of(self, a: str, b: str) -> float:
        a, b = a and letter_class(a), b and letter_class(b)
        found = self.cost.get((a, b))
        return found if found is not None else self.unseen.get(a, self.default)


def arcs(token: str) -> list[list[tuple[int, str, float]]]:
    """For each position, the arcs (next position, letters, cost) that leave it."""
    out: list[list[tuple[int, str, float]]] = []
    run_end = len(token)
    ends = [0] * len(token)
    for i in range(len(token) - 1, -1, -1):
        if i + 1 == len(token) or token[i + 1] != token[i]:
            run_end = i + 1
        ends[i] = run_end
    for i, c in enumerate(token):
        end = ends[i]
        options = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKALIKES.get(c, "")]
        here = [] if c.isalpha() else [(end, "", NO_LETTER if options else DROP)]
        for letter, cost in options:
            here.append((end, letter, cost + (REPEAT if end > i + 1 else 0.0)))
            if end > i + 1:
                here.append((end, letter * 2, 2 * cost + KEEP_REPEAT))
        out.append(here)
    return out


def viterbi(token: str, model: CharModel) -> str:
    """The letters of the cheapest path through the token's lattice; ties go to the path found first."""
    best: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(token) + 1)]
    best[0][""] = (0.0, "")
    lattice = arcs(token)
    for i, states in enumerate(best[:-1]):
        for last, (cost, text) in states.items():
            for j, letters, price in lattice[i]:
                total, at = cost + price, last
                for c in letters:
                    total += model.of(at, c)
                    at = c
                if at not in best[j] or total < best[j][at][0]:
                    best[j][at] = (total, text + letters)
        if i:
            states.clear()
    ends = [(cost + model.of(last, ""), text) for last, (cost, text) in best[-1].items()]
    return min(ends)[1] if ends else ""


#: Longer tokens are no words; they are restored piece by piece.
_PIECE = 64


def restore(token: str, model: CharModel) -> str:
    """The word behind a token. Tokens of letters without a run of three stand for themselves, and so do tokens
    without a letter (numbers)."""
    body = stripped(token)
    if body.isalpha() and not _RUN.search(body) or not any(map(str.isalpha, body)):
        return body
    return "".join(viterbi(body[i:i + _PIECE], model) for i in range(0, len(body), _PIECE))


def spaced(tokens: list[str]) -> list[str]:
    """Runs of three and more one-character tokens, joined: words written with spaces between their letters."""
    found = []
    for single, run in groupby(tokens, lambda t: len(t) == 1):
        if single:
            letters = "".join(run)
            if len(letters) > 2:
                found.append(letters)
    return found


PREFIXES = (4, 5, 6)


def features_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a dash."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def inner_words(letters: str) -> list[str]:
    return [letters[i:i + n] for n in range(3, 13) for i in range(len(letters) - n + 1)]


class Reader:
    """What a document holds, with a bounded memory of tokens already restored."""

    def __init__(self, model: CharModel, weights: dict[str, float] | None = None, keep: int = 500_000):
        self.model, self.weights, self.keep = model, weights or {}, keep
        self.known: dict[str, object] = {}

    def _each(self, text: str | None, value, joined) -> tuple[list, list]:
        """value(token) of the distinct tokens, and joined(letters) of words written with spaces between letters."""
        tokens = (text or "").split()
        distinct = set(tokens)
        if len(self.known) > self.keep:
            self.known = {}
        for token in distinct.difference(self.known):
            self.known[token] = value(token)
        runs = [restore(letters, self.model) for letters in spaced(tokens)]
        return list(map(self.known.__getitem__, distinct)), [x for run in runs for x in joined(run)]

    def features(self, text: str | None) -> set[str]:
        """All features of the text's words."""
        words, more = self._each(text, lambda t: features_of(restore(t, self.model)), inner_words)
        return set().union(more, *words)

    def _heaviest(self, word: str) -> tuple[str, float] | None:
        found = max((self.weights[f] for f in features_of(word) if f in self.weights), default=None)
        return None if found is None else (word, found)

    def evidence(self, text: str | None) -> float:
        """The sum of the two heaviest words of the text, each with its heaviest feature. Two, because the many faintly
        suspicious words of a long text must not add up to an insult."""
        words, more = self._each(text, lambda t: self._heaviest(restore(t, self.model)), lambda run: [
            (w, self.weights[w]) for w in inner_words(run) if w in self.weights])
        found = set(words).union(more)
        found.discard(None)
        return math.fsum(sorted((weight for _, weight in found), reverse=True)[:2])


def character_counts(docs: DataFrame, text: str = "text") -> dict[tuple[str, str], int]:
    """How often each letter follows another in the words of all rows. The result is bounded by the alphabet."""
    def run(batches):
        words: Counter = Counter()

        def rows():
            pairs: Counter = Counter()
            for word, n in words.items():
                body = stripped(word)
                if body.isalpha():
                    at = ""
                    for c in map(letter_class, body):
                        pairs[at, c] += n
                        at = c
                    pairs[at, ""] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()),
                                               pa.array(list(pairs.values()), pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    words.update(t.split())
                if len(words) > 300_000:
                    yield rows()
        yield rows()

    ship_with_tasks(__name__)
    found = docs.select(text).mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in found.toLocalIterator()}


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharModel
    weights: dict[str, float]
    bias: float
    slope: float

    def score(self, evidence: float) -> float:
        z = self.bias + self.slope * evidence
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope by Newton steps; the ridge keeps separable data finite."""
    a = np.column_stack([np.ones_like(x), x])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        gradient = a.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), gradient)
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
        max_documents: int = 20_000, min_documents: int = 3, errors: float = 1.5,
        min_weight: float = 1.5, max_features: int = 50_000) -> ToxicityModel:
    """The character model comes from all rows of `docs`; word weights from at most `max_documents` labelled rows that
    are not held out, equal texts once. Three in four of these give the weights of features found in at least
    `min_documents` toxic texts, the heaviest `max_features`; a weight is the log odds ratio less
    `errors` standard errors. The others set bias and slope."""
    characters = CharModel.fit(character_counts(docs, text))
    sample = training_labels(labels, label, max_documents)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    rows = stage(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))), "labelled")

    def count(batches):
        reader = Reader(characters)
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            names = [(f, y, n) for y, c in found.items() for f, n in c.items()]
            for c in found.values():
                c.clear()
            columns = zip(*names) if names else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))],
                                              names=["feature", "label", "n"])

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[int(y > 0)].update(reader.features(t))
                found[int(y > 0)][""] += 1  # the number of texts
                if len(found[0]) + len(found[1]) > 400_000:
                    yield out()
        yield out()

    ship_with_tasks(__name__)
    counts = rows.filter("part > 0").select("text", "label").mapInArrow(count, "feature string, label int, n bigint")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"),
                                           F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    counts = stage(counts, "features")
    total = counts.filter("feature = ''").select("bad", "good").first() or (0, 0)
    odds = F.log((F.col("bad") + 0.5) / (total[0] + 1.0)) - F.log((F.col("good") + 0.5) / (total[1] + 1.0))
    weight = odds - errors * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    kept = counts.filter((F.col("feature") != "") & (F.col("bad") >= min_documents)).withColumn("weight", weight)
    kept = kept.filter(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "feature").limit(max_features)
    weights = {r["feature"]: r["weight"] for r in kept.collect()}
    model = ToxicityModel(characters, weights, 0.0, 1.0)

    def evidence(batches):
        reader = Reader(characters, weights)
        for batch in batches:
            sums = list(map(reader.evidence, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1)], names=["x", "label"])

    points = rows.filter("part = 0").select("text", "label").mapInArrow(evidence, "x double, label int").collect()
    x = np.array([r["x"] for r in points])
    y = np.array([float(r["label"] > 0) for r in points])
    if len(set(y.tolist())) == 2:
        bias, slope = _logistic(np.minimum(x, 40.0), y)
    else:  # too few labels to calibrate: one strong word decides
        bias, slope = -4.0, 0.8
    return ToxicityModel(model.characters, weights, bias, slope)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, score) for every row: 0 to 1, higher means toxic. Null and empty texts get the score of no evidence;
    repeated rows equal scores. Other columns are not read."""
    kind = docs.schema[id_col].dataType
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(held.value.characters, held.value.weights)
        for batch in batches:
            scores = [held.value.score(reader.evidence(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    ship_with_tasks(__name__)
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold. Rows are judged in place, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(held.value.characters, held.value.weights)
        for batch in batches:
            clean = [held.value.score(reader.evidence(t)) < threshold for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    ship_with_tasks(__name__)
    return docs.mapInArrow(run, docs.schema)
