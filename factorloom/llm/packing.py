"""Packing documents into sequences of bounded length: bounded-space online best fit, leftovers merged at the end.

Each partition keeps a fixed number of open windows. Whole sequences are cut off long documents; what remains goes
into the open window it fits best. When none has room, the fullest window is completed with the head of the piece
and emitted, and the rest of the piece is placed again, so emitted sequences are full. At the end of a partition
its open windows are left over; groups of partitions merge theirs, round by round, until one tail is left, which is
cut into sequences of lengths that are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import tokens
from factorloom.plans.runtime import ship_with_tasks, stage

#: Partitions whose leftovers one task merges; a round divides their number by this.
FAN_IN = 64
_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left_over", pa.bool_())]
_DDL = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, left_over boolean"


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) and gives rows of finished sequences. Numbers count up from
    `first`. Memory: `windows` sequences."""

    def __init__(self, length: int, windows: int, first: int):
        self.length, self.windows, self.next = length, windows, first
        self.open: list[list] = []  # [used tokens, pieces]

    def _emit(self, pieces: list, left_over: bool = False) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self.next, at, left_over
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, size = len(ids) // 4, self.length
        whole = total // size * size
        for start in range(0, whole, size):
            yield from self._emit([(doc, start, ids[start * 4:(start + size) * 4], total)])
        if whole < total:
            yield from self.put((doc, whole, ids[whole * 4:], total))

    def put(self, piece: tuple) -> Iterator[tuple]:
        doc, start, ids, total = piece
        n = len(ids) // 4
        fits = [w for w in self.open if w[0] + n <= self.length]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.windows:
            best = [0, []]
            self.open.append(best)
        else:  # complete the fullest
            best = max(self.open, key=lambda w: w[0])
            room = self.length - best[0]
            yield from self._emit([*best[1], (doc, start, ids[:room * 4], total)])
            self.open.remove(best)
            yield from self.put((doc, start + room, ids[room * 4:], total))
            return
        best[0] += n
        best[1].append((doc, start, ids, total))
        if best[0] == self.length:
            yield from self._emit(best[1])
            self.open.remove(best)

    def rest(self) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield from self._emit(pieces, True)
        self.open = []


def _batches(rows: Iterator[tuple], schema: pa.Schema, many: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(docs: DataFrame, id_col: str) -> tuple[str, pa.Schema]:
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return f"`{id_col}` {kind.simpleString()}, {_DDL}", pa.schema([(id_col, to_arrow_type(kind)), *_FIELDS])


def _pack_partitions(docs: DataFrame, text: str, id_col: str, length: int, windows: int, rank_file: str | None,
                     end_id: int) -> DataFrame:
    ddl, schema = _schema(docs, id_col)

    def run(batches):
        packer = Packer(length, windows, _partition() << 32)
        encode, end = tokens.encoder(rank_file).encode, end_id.to_bytes(4, "little")

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    some = batch.slice(at, 128)
                    texts = [t or "" for t in some.column(1).to_pylist()]
                    for doc, ids in zip(some.column(0).to_pylist(), encode(texts)):
                        yield from packer.add(doc, ids + end)
            yield from packer.rest()

        yield from _batches(rows(), schema)

    return docs.select(id_col, text).mapInArrow(run, ddl)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _merge_round(left: DataFrame, id_col: str, level: int, last: bool, length: int, windows: int) -> DataFrame:
    """One round: the leftovers of FAN_IN groups, in their order, cut into full sequences and one tail."""
    ddl, schema = _schema(left, id_col)
    order = ["sequence_id", "offset"]

    def run(key: tuple, part: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer(length, 1, (level << 56) + (group << 24))
        rows: list[tuple] = []
        for row in part.sort_by([(c, "ascending") for c in order]).to_pylist():
            rows += packer.put((row[id_col], row["start"], row["ids"], row["doc_tokens"]))
        if last and packer.open:
            pieces = packer.open.pop()[1]
            while pieces:
                n = sum(len(p[2]) // 4 for p in pieces)
                pieces, head = _split(pieces, 1 << (n.bit_length() - 1))
                rows += packer._emit(head)
        rows += packer.rest()
        return pa.Table.from_batches(list(_batches(iter(rows), schema)), schema=schema)

    shift = 32 if level == 1 else 24
    mask = (1 << (56 - shift)) - 1
    group = (F.shiftrightunsigned("sequence_id", shift).bitwiseAND(mask) / FAN_IN).cast("long")
    return left.withColumn("_g", group).groupBy("_g").applyInArrow(run, ddl)


def _split(pieces: list, n: int) -> tuple[list, list]:
    """(rest, head): the first n tokens of the pieces, and what follows."""
    head, at = [], 0
    for k, (doc, start, ids, total) in enumerate(pieces):
        size = len(ids) // 4
        if at + size > n:
            cut = n - at
            head += [(doc, start, ids[:cut * 4], total)] if cut else []
            return [(doc, start + cut, ids[cut * 4:], total), *pieces[k + 1:]], head
        head.append((doc, start, ids, total))
        at += size
    return [], head


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 1024, windows: int = 16,
         rank_file: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: id_col, start and length of the piece in its document's ids, ids (little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id, offset in the sequence.

    Every document, null and empty texts too (they are just `end_id`), repeated rows as often as they come. Other
    columns are not read. All sequences have `length` ids but the last few, whose lengths are powers of two. An empty
    table gives no rows. `rank_file` is the path of a byte-level BPE rank file.
    """
    for module in (__name__, tokens.__name__):
        ship_with_tasks(module)
    packed = stage(_pack_partitions(docs, text, id_col, length, windows, rank_file, end_id), "packed")
    done = [packed.filter(~F.col("left_over"))]
    left = packed.filter("left_over")
    groups = 1 + ((left.agg(F.max("sequence_id")).first()[0] or 0) >> 32)
    level = 0
    while groups:
        level, groups = level + 1, -(-groups // FAN_IN)
        merged = stage(_merge_round(left, id_col, level, groups == 1, length, windows), f"merged-{level}")
        done.append(merged.filter(~F.col("left_over")))
        left = merged.filter("left_over")
        groups = groups if groups > 1 else 0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("left_over")
