"""Benchmark items in documents, within an edit distance: pigeonhole pieces, exact hits, Myers verification.

Both sides are compared as runs of letters and digits in lower case with single spaces. An item of n characters may
differ in k of them, k a share of n. It is cut into k + 1 pieces; k edits leave one piece untouched, so every
occurrence within the budget has an exact piece hit at a known place. An automaton over all pieces finds the hits in
one pass over a document, and Myers' bit-parallel distance verifies the stretch around each hit.

Pieces are short, so most hits are chance. Each is verified outwards: over neighbouring pieces first, then over twice
as many, up to the item. A stretch of j pieces may have j - 1 edits; if it has no more, one of its halves has no more
than its own, so some piece leads up to every occurrence and nothing is lost.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factorloom.plans.runtime import ship_with_tasks

_RUNS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_RUNS.findall((text or "").lower()))


def budget(n: int, error_share: float, min_piece: int = 1) -> int:
    """Edits allowed in an item of n characters: its share, whatever `min_piece` is, but fewer than n."""
    return max(0, min(int(n * error_share), n - 1))


def cut(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces (start, end) of nearly equal length that cover n characters."""
    return [(n * j // (k + 1), n * (j + 1) // (k + 1)) for j in range(k + 1)]


def stretches(n: int, k: int, min_piece: int) -> list[list[tuple[int, int, int]]]:
    """For each piece of `cut`, the stretches to verify around it, (start, end, edits allowed), the smallest first and
    the whole item last: halves of halves. Those shorter than min_piece tell little and are passed over."""
    pieces, found = cut(n, k), [[] for _ in range(k + 1)]

    def split(low, high):
        start, end = pieces[low][0], pieces[high - 1][1]
        if high - low == k + 1 or high - low > 1 and end - start >= min_piece:
            for j in range(low, high):
                found[j].append((start, end, high - low - 1))
        if high - low > 1:
            middle = (low + high + 1) // 2
            split(low, middle)
            split(middle, high)

    split(0, k + 1)
    return [around[::-1] for around in found]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for at, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << at
    return found


def best_match(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of the pattern to any substring of `text`, and the first place
    where one ends. Myers (1999), one machine word of any width for the whole pattern."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        x = peq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | ~(vp | d0) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        x = hp << 1 & full
        vn = x & d0
        vp = hn << 1 & full | ~(x | d0) & full
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """All items at once. Items are (id, normal text)."""

    def __init__(self, items: list[tuple], error_share: float, min_piece: int):
        self.items = [(i, t, budget(len(t), error_share)) for i, t in items if t]
        self.peq: dict[tuple[int, int, int], dict[str, int]] = {}
        self.around: dict[tuple[int, int], list[list[tuple[int, int, int]]]] = {}
        places: dict[str, list[tuple[int, int, list]]] = {}
        for at, (_, t, k) in enumerate(self.items):
            n = len(t)
            if (n, k) not in self.around:
                self.around[n, k] = stretches(n, k, min_piece)
            for (start, end), up in zip(cut(n, k), self.around[n, k]):
                places.setdefault(t[start:end], []).append((at, start, up))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _match(self, at: int, start: int, end: int, text: str) -> tuple[int, int]:
        key = (at, start, end)
        if key not in self.peq:
            self.peq[key] = masks(self.items[at][1][start:end])
        return best_match(self.peq[key], end - start, text)

    def find(self, text: str | None) -> list[tuple]:
        """(item id, distance, start, end) of the best occurrence of each item in the text's normal form. Items with
        several occurrences: the smallest distance, then the first found."""
        body = normal(text)
        if not self.items or not body:
            return []
        found: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int, int]] = set()
        for last, (size, where) in self.automaton.iter(body):
            for at, first, up in where:
                if at in found and found[at][0] == 0:
                    continue
                item = self.items[at][1]
                m, origin = len(item), last + 1 - size - first  # where the item would begin without edits
                for start, end, k in up:
                    if (at, origin, start, end) in seen:
                        break
                    seen.add((at, origin, start, end))
                    low = max(0, origin + start - k)
                    if origin + start >= 0 and body.startswith(item[start:end], origin + start):
                        distance, stop = 0, origin + end
                    else:
                        distance, stop = self._match(at, start, end, body[low:origin + end + k])
                        stop += low
                    if distance > k:
                        break
                    if end - start == m and (at not in found or distance < found[at][0]):
                        found[at] = (distance, max(0, stop - m), stop)
        return [(self.items[at][0], *hit) for at, hit in sorted(found.items())]


def _blocks(items: DataFrame, text: str, id_col: str, block_bytes: int) -> list[list[tuple]]:
    """Normal texts of the items in blocks of bounded size."""
    blocks, size = [[]], 0
    for row in items.select(id_col, text).toLocalIterator():
        t = normal(row[1])
        if size + len(t) > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], t))
        size += len(t)
    return blocks


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
               item_id: str = "item_id", error_share: float = 0.1, min_piece: int = 16,
               block_bytes: int = 16 << 20) -> DataFrame:
    """(id_col, item_id, distance, start, end): the best occurrence of each item in each row of `docs` that has one
    within the budget; start and end count in the row's normal form. Rows without an item do not appear.

    Null, empty and wordless texts match nothing, on either side; repeated rows each give their matches; other columns
    are not read. Items travel to the tasks in blocks of at most `block_bytes` normal characters, one pass over `docs`
    each, so a task's memory is bounded whatever the number of items.
    """
    kinds = [docs.schema[id_col].dataType, items.schema[item_id].dataType]
    names = [id_col, "item_id", "distance", "start", "end"]
    schema = pa.schema(list(zip(names, [*map(to_arrow_type, kinds), pa.int32(), pa.int64(), pa.int64()])))
    ddl = f"`{id_col}` {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, distance int, start bigint, `end` bigint"
    out = None
    ship_with_tasks(__name__)
    for block in _blocks(items, item_text, item_id, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            matcher = Matcher(held.value, error_share, min_piece)
            for batch in batches:
                rows = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(doc, *hit) for hit in matcher.find(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        part = docs.select(id_col, text).mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text",
                  error_share: float = 0.1, min_piece: int = 16, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item. Rows are tested in place, so nothing is shuffled."""
    ship_with_tasks(__name__)
    for block in _blocks(items.withColumn("_i", F.lit(0)), item_text, "_i", block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            matcher = Matcher(held.value, error_share, min_piece)
            for batch in batches:
                clean = [not matcher.find(t) for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
