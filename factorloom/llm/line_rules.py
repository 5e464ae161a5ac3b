"""Quality rules of a document and the frequency of its lines over other documents, in DataFrame functions only.

Base rules look at one text: its length in words and the share of its words that lie in repeated 3-word windows.
The cross-document rule hashes normalised lines, counts in how many distinct documents of a host each occurs, and
removes lines above the limit; a document that loses too many of its words is rejected as depleted.

Copies are not boilerplate. Equal texts count as one document. Near copies share nearly all of their lines, so a text
that consists mostly of lines others have too does not count for itself: all such texts with the same longest shared line
count as one document. A group of near copies, however large, so adds a few documents to the count of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import SPACES, ascii_lower, row_key, text_of
from factorloom.plans.joins import lookup_join, measured_bytes
from factorloom.plans.runtime import stage

SYMBOLS = "#*$%&|<>"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _words(trimmed: Column) -> Column:
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed. Columns of these
    names are replaced. A null text has no words. The work stays in the row: no shuffle."""
    kept = [c for c in docs.columns if c not in
            ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    df = docs.select(*kept, text_of(text).alias("_text"))
    df = df.withColumn("_h", F.transform(_words(_trimmed(F.col("_text"))), lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size("_h").cast("long"))
    df = df.withColumn("_win", F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, int(n_words) - 3), "
                                      "i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2))) END"))
    df = df.drop("_h").withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_win)) = size(_win) THEN NULL ELSE sort_array(transform(_win, (h, i) -> "
        "struct(h AS h, i AS i))) END"))
    # Sorted by hash, a window is repeated if a neighbour has its hash. A word is in one if one starts at most two before.
    df = df.drop("_win").withColumn("_at", F.expr(
        "sort_array(filter(transform(_sorted, (x, k) -> CASE WHEN x.h = get(_sorted, k - 1).h OR x.h = get(_sorted, k + 1).h "
        "THEN x.i END), p -> p IS NOT NULL))"))
    df = df.drop("_sorted").withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1), p + 3) - p)), 0L, (s, x) -> s + x), 0L)"))
    lines = F.filter(F.split("_text", "\n"), lambda x: _trimmed(x) != "")
    df = df.drop("_at").withColumn("_lines", lines)
    stats = F.struct(
        "n_words",
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))
    # A later filter on these columns must not be pushed below the steps above: written out inside each other's
    # lambdas they take the square of a text's length. Filters stop at a generator, and this one gives one row a row.
    return df.select(*kept, F.explode_outer(F.array(stats)).alias("_s")).select(*kept, "_s.*")


def normal_line(line: Column) -> Column:
    """A line for comparison: white space runs as one space, trimmed, A-Z in lower case."""
    return ascii_lower(_trimmed(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def host_key(host: str) -> Column:
    """The host as a string that is never null; null hosts are one host, unlike all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))


def document_lines(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(key, host, copy, n_words, pos, line, words) for every line with a word. key: the row; copy: its text; pos: the
    line's number in the text; line: 64-bit hash of the normalised line; words and n_words: of the line and the text."""
    df = docs.select(row_key(id_col, host, text).alias("key"), host_key(host).alias("host"),
                     F.xxhash64(text_of(text)).alias("copy"),
                     F.transform(F.split(text_of(text), "\n"), normal_line).alias("_n"))
    df = df.withColumn("_h", F.expr("filter(transform(_n, (x, i) -> struct(i AS pos, xxhash64(x) AS line, "
                                    "CASE WHEN x = '' THEN 0 ELSE 1 + length(x) - length(replace(x, ' ', '')) END AS words)), "
                                    "x -> x.words > 0)")).drop("_n")
    df = df.withColumn("n_words", F.expr("aggregate(_h, 0, (s, x) -> s + x.words)"))
    # Outer, so that no filter on the array's size makes the scan compute it all a second time, inside out.
    lines = df.select("key", "host", "copy", "n_words", F.explode_outer("_h").alias("p"))
    return lines.filter("p IS NOT NULL").select("key", "host", "copy", "n_words", "p.*")


def shared_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """(key, host, n_words, witness, lines) for every row with lines that `min_documents` distinct texts of its host have;
    lines: an array of (pos, line, words) of those. witness: what the row counts as, its text, or if half or more of
    its words are in such lines, the longest of them (of equal ones the first)."""
    seen = lines.groupBy("host", "line", "copy").agg(F.count(F.lit(1)).alias("rows"))
    often = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"), F.sum("rows").alias("rows"))
    often = stage(often.filter(F.col("documents") >= min_documents), "shared")
    hot = often.filter("rows > 10000").orderBy(F.desc("rows")).limit(4096).select("host", "line")
    hit = lookup_join(lines, often.select("host", "line"), ["host", "line"], measured_bytes(often), "inner", hot)
    found = hit.groupBy("key").agg(F.first("host").alias("host"), F.first("copy").alias("copy"), F.first("n_words").alias("n_words"),
                                   F.collect_set(F.struct("pos", "line", "words")).alias("lines"))
    words = F.expr("aggregate(lines, 0, (s, x) -> s + x.words)")
    longest = F.expr("array_max(transform(lines, x -> struct(x.words, -x.pos, x.line AS line))).line")
    own = 2 * words < F.col("n_words")
    witness = F.struct(own.alias("own"), F.when(own, F.col("copy")).otherwise(longest).alias("id"))
    return stage(found.select("key", "host", "n_words", witness.alias("witness"), "lines"), "hits")


def frequent_lines(shared: DataFrame, docs: DataFrame, text: str = "text", host: str = "source", min_documents: int = 20,
                   min_per_mille: int = 1) -> DataFrame:
    """(host, line) of the lines above the limits: they have at least `min_documents` witnesses in the host, and one for
    each thousand / `min_per_mille` distinct texts of it."""
    each = shared.select("host", "witness", F.explode("lines.line").alias("line")).distinct()
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= min_documents)
    texts = docs.select(host_key(host).alias("host"), F.xxhash64(text_of(text)).alias("copy")).distinct()
    total = texts.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    return counts.join(total, "host").filter(1000 * F.col("documents") >= min_per_mille * F.col("texts")).select("host", "line")


def removals(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id",
             min_share_left: int = 30, min_documents: int = 20, min_per_mille: int = 1) -> DataFrame:
    """(key, at, depleted): for each row that has frequent lines, the numbers of those lines, and whether less than
    `min_share_left` of 100 of its words are outside them. Rows equal in id, host and text have one key."""
    shared = shared_lines(document_lines(docs, text, host, id_col), min_documents)
    bad = stage(frequent_lines(shared, docs, text, host, min_documents, min_per_mille), "frequent")
    each = shared.select("key", "host", "n_words", F.inline("lines"))
    hit = lookup_join(each, bad, ["host", "line"], measured_bytes(bad), "inner")
    found = hit.groupBy("key").agg(F.collect_list("pos").alias("at"), F.sum("words").alias("gone"),
                                   F.first("n_words").alias("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("gone")) < min_share_left * F.col("n_words")
    return found.select("key", "at", depleted.alias("depleted"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id", **limits) -> DataFrame:
    """(id_col, base columns, kept) for every row: kept is false if the base rules fail or the row is depleted. Other
    columns are not read; an empty table gives no rows; null and empty texts fail; repeated rows all get the same verdict."""
    stats = base_stats(docs.select(id_col, row_key(id_col, host, text).alias("key"), text), text).drop(text)
    gone = removals(docs, text, host, id_col, **limits).filter("depleted").select("key", F.lit(True).alias("depleted"))
    judged = stats.join(gone, "key", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("depleted").isNull()).drop("key", "depleted")


def clean(docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id", **limits) -> DataFrame:
    """The kept rows of `docs`, all columns as they are, whatever their names, but the texts without the frequent lines. Null and
    empty texts go, repeated rows stay as often as they come, an empty table gives no rows."""
    boxed = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, host, text).alias("key"), F.col(text).alias("text"))
    passed = base_stats(boxed).filter(~F.col("base_failed")).select("row", "key")
    rows = passed.join(removals(docs, text, host, id_col, **limits), "key", "left").filter(F.coalesce(~F.col("depleted"), F.lit(True)))
    whole = F.col("row").getField(text)
    lines = F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("at", i))
    left = F.when(F.col("at").isNull(), whole).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[(left if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
