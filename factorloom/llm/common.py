"""What the corpus operators share: table access, ASCII text rules, row keys, splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(*columns: str) -> Column:
    """16 bytes that rows share only if they are equal in these columns; nulls differ from all values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    sized = [p for part in parts for p in (F.length(part).cast("string"), part)]
    return F.unhex(F.md5(F.concat_ws(":", *sized)))


def held_out(doc_id: Column) -> Column:
    """The documents whose labels no model may see. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label) of at most `limit` labelled rows that are not held out, one a document: the first in
    the order of their hash, so the same rows on every run. `limit` bounds what a classifier is fitted on."""
    open_rows = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = open_rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


#: Runs of letters, of digits and of signs; line feeds part the tokens that are split together.
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


def split_tokens(tokens: list[str]) -> list[str]:
    """The parts of all tokens, "\\n" between one token and the next. Tokens hold no white space."""
    return _PARTS.findall("\n".join(tokens))


def cut_at_zeros(ids: np.ndarray) -> list[bytes]:
    """The bytes of the stretches between zeros."""
    ends, width, raw = np.flatnonzero(ids == 0) * ids.itemsize, ids.itemsize, ids.tobytes()
    starts = [0, *(ends + width).tolist()]
    return [raw[a:b] for a, b in zip(starts, [*ends.tolist(), len(raw)])]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, at most `rows` at a time, so that a task holds the texts and sets of so many as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
