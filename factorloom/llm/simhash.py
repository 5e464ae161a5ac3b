"""Near duplicates by SimHash: fingerprints of word shingles, deletion-variant signatures, components.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two bits, one
segment differs in at most one; so with one position of that segment left out, both give the same signature.
Each distinct fingerprint is indexed under its 64 signatures (segment, position left out, rest), and candidates
come from an equality join and are verified.

A signature that many fingerprints share would give a square of pairs. Beyond `bucket_limit` its members are
linked in another exact way: every fingerprint is listed under itself and its 64 one-bit neighbours. Two
fingerprints are within two bits of each other if and only if they meet in such a list, and all members of one
list are, so a star to the smallest member carries all its links.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.plans.joins import measured_bytes
from factorloom.plans.runtime import cut_lineage, ship_with_tasks, stage

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_of(text: str | None, words_per_shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of one text; 0 without a word."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    width = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # a block at a time, so that long texts need no more memory
        block = hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words_per_shingle: int = 3) -> DataFrame:
    """(id_col, fp) for every row; null and wordless texts have fp 0. Repeated rows stay."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            found = [fingerprint_of(t, words_per_shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    ship_with_tasks(__name__)
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, fp bigint")


def _signatures(fps: DataFrame) -> DataFrame:
    """(sig, fp): the 64 signatures of each fingerprint, dealt by signature. Bits of sig: which position is left out
    (this tells the segment too) below the segment without it."""
    segment = "(CASE WHEN pos < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
    return (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
            .selectExpr(f"shiftleft({segment} & ~shiftleft(1L, pos % 32), 6) | pos AS sig", "fp").repartition("sig"))


def links(fps: DataFrame, bucket_limit: int = 256) -> DataFrame:
    """Edges (a, b), a < b, that connect all distinct values of `fp` within two bits of each other. Edges beyond
    `bucket_limit` are stars with the same components."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    # The signatures are shuffled once: counting them and looking up the shared ones read the same exchange.
    sigs = _signatures(fps)
    buckets = (sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
               .filter("n > 1"))
    members = sigs.join(buckets.filter("n > 2").select("sig", "n"), "sig").select("sig", "n", F.col("fp").alias("a"))
    twos = buckets.filter("n = 2").filter(close)
    found = stage(twos.unionByName(members.withColumn("b", F.lit(None).cast("long"))), "signatures")
    shared = found.filter("n > 2").select("sig", "n", F.col("a").alias("fp"))
    left = shared.filter(F.col("n") <= bucket_limit).select("sig", F.col("fp").alias("a"))
    some = left.join(left.withColumnRenamed("a", "b"), "sig").filter("a < b").filter(close).select("a", "b")
    crowded = shared.filter(F.col("n") > bucket_limit).select("fp").distinct()
    around = crowded.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), p -> fp ^ shiftleft(1L, p))))"
                                " AS ball")
    centre = around.groupBy("ball").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = around.join(centre.select("ball", "a"), "ball").select("a", F.col("fp").alias("b")).filter("a < b")
    return found.filter("n = 2").select("a", "b").unionByName(some).unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches, by rounds of large and small
    stars (Kiveris et al., 2014). Every round is written to the shared folder; only counts reach the driver."""
    edges = cut_lineage(edges.select("a", "b"))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a AND b <> m").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select(F.least("a", "m").alias("m"), "a", "b")
                 .selectExpr("explode(array(struct(m AS a, b AS b), struct(m AS a, a AS b))) AS e")
                 .select("e.a", "e.b").filter("a < b").distinct())
        edges = cut_lineage(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words_per_shingle: int = 3,
                    bucket_limit: int = 256) -> DataFrame:
    """(id_col, fp, component_id) for every row of `docs`; other columns are not read. component_id is the smallest
    id among the rows reachable over fingerprints at most two bits apart. Null ids are in a component but never
    name one; if all its ids are null, component_id is null. An empty table gives no rows."""
    rows = stage(fingerprints(docs, text, id_col, words_per_shingle), "fingerprints")
    firsts = stage(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "firsts")
    found = components(links(firsts.select("fp"), bucket_limit)).withColumnRenamed("node", "fp")
    rooted = firsts.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def _shingles(text: str | None, width: int) -> set[bytes]:
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    return set(map(b" ".join, zip(*(words[k:] for k in range(width))))) or {b" ".join(words)}


def similarity_of(a: str | None, b: str | None, width: int = 5) -> float:
    """Jaccard similarity of the distinct word shingles; shorter texts are one shingle."""
    x, y = _shingles(a, width), _shingles(b, width)
    return len(x & y) / len(x | y)


def _hashes(text: str | None, width: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) - (1 << 63) for s in _shingles(text, width)), np.int64)


def _often(docs: DataFrame, text: str, width: int, share: int = 8, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Shingles that look frequent in one of `share` rows, sorted. They only set the order in which shingles are
    tried: any order finds the same pairs, but with rare ones first fewer texts meet."""
    def run(batches):
        for batch in batches:
            found = [_hashes(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["tok"])

    some = docs.filter(F.pmod(F.xxhash64("num"), F.lit(share)) == 0).select(text).mapInArrow(run, "tok bigint")
    counts = some.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r["tok"] for r in counts.orderBy(F.desc("n"), "tok").limit(most).collect()], np.int64))


def _parity(toks: np.ndarray) -> bytes:
    """Bits, about two a shingle, of which each is 1 if an odd number of the shingles falls on it. A shingle that only one of
    two texts has changes one bit, so the texts differ in at least as many shingles as these in bits."""
    size = 1 << min(17, max(9, (2 * len(toks)).bit_length()))
    odd = np.bincount(toks & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _prefixes(docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """(num, key, n, bits, toks) of every row: the words' digest, the number of distinct shingles, their parity, and the first
    of them in one order for all texts. Texts of n shingles that are similar enough share at least similarity * n of them, so
    one of the first n - similarity * n + 1."""
    held = docs.sparkSession.sparkContext.broadcast(_often(docs, text, width))

    def run(batches):
        often = held.value
        for batch in batches:
            keys, sizes, bits, firsts = [], [], [], []
            for t in batch.column(1).to_pylist():
                words = _WORDS.findall((t or "").encode("utf-8", "surrogatepass").translate(_LOWER))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                toks = _hashes(t, width)
                late = np.zeros(len(toks), bool)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, toks), len(often) - 1)] == toks
                sizes.append(len(toks))
                bits.append(_parity(toks))
                firsts.append(toks[np.lexsort((toks, late))][:len(toks) - math.ceil(similarity * len(toks) - 1e-9) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
                                             names=["num", "key", "n", "bits", "toks"])

    return docs.select("num", text).mapInArrow(run, "num bigint, key binary, n bigint, bits binary, toks array<bigint>")


def _pairs(left: DataFrame, right: DataFrame, similarity: float, differ: str = "x.node < y.node") -> DataFrame:
    """(a, b), a < b: nodes of one list that can be similar enough by their sizes and by what follows the shingle they
    share. The first shingle of a similar pair passes, so no such pair is lost."""
    s = similarity
    met = left.alias("x").join(right.alias("y"), F.expr(
        f"x.tok = y.tok AND {differ} AND x.n >= {s} * y.n - 1e-9 AND y.n >= {s} * x.n - 1e-9 "
        f"AND least(x.n - x.at, y.n - y.at) >= {s / (1 + s)} * (x.n + y.n) - 1e-9"))
    return met.selectExpr("least(x.node, y.node) AS a", "greatest(x.node, y.node) AS b").distinct()


def _possible(pairs: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that can be similar enough by the parities (num, n, bits) of their shingles. Sets of x and y shingles
    with that similarity differ in at most (1 - similarity) / (1 + similarity) * (x + y) of them, so none is lost."""
    both = pairs.join(parities.toDF("a", "na", "ba"), "a").join(parities.toDF("b", "nb", "bb"), "b")
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            near = [_bits_apart(x, y) <= share * n + 1e-6 for n, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.selectExpr("a", "b", "na + nb AS n", "ba", "bb").mapInArrow(run, "a bigint, b bigint")


def _verified(docs: DataFrame, pairs: DataFrame, text: str, width: int, similarity: float, parities: DataFrame,
              broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough, stored. Only texts of possible pairs are sent; the numbers of
    these rows are broadcast if they measure at most `broadcast_bytes`."""
    pairs = stage(_possible(stage(pairs, "candidates"), parities, similarity), "possible")
    needed = stage(pairs.selectExpr("explode(array(a, b)) AS num").distinct(), "needed")
    held = F.broadcast(needed) if measured_bytes(needed) <= broadcast_bytes else needed
    texts = stage(docs.select("num", text).join(held, "num", "left_semi").toDF("num", "t"), "texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def verify(batches):
        for batch in batches:
            near = [similarity_of(x, y, width) >= similarity
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return stage(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a bigint, b bigint"), "edges")


def similar_groups(docs: DataFrame, text: str = "text", width: int = 5, similarity: float = 0.8,
                   list_limit: int = 64) -> DataFrame:
    """(num, root) for every row of `docs`, which has a unique long column num: rows whose texts are linked by
    similarities of at least `similarity` have one root. Texts of the same words in any case of A-Z are one text;
    texts without a word are all the same.

    SimHash comes first: rows of one component of `near_duplicates` are compared with its first row, on their texts, and
    those that are similar enough are linked. The exact check that follows finds what two bits of a fingerprint do not
    reach, and compares only texts that are not linked yet. Every similar pair is a candidate there: it shares one of the first shingles of both. The nodes of a list meet its first
    node, in a list of over `list_limit` sixteen of its nodes; then all pairs of a list that are not linked by then,
    which is quadratic only in texts that are no copies of each other."""
    ship_with_tasks(__name__)
    rows = stage(_prefixes(docs, text, width, similarity), "prefixes")
    parities = rows.select("num", "n", "bits")
    nodes = stage(rows.groupBy("key").agg(F.min("num").alias("node")), "nodes")
    toks = (rows.join(nodes.select(F.col("node").alias("num")), "num", "left_semi")
            .select(F.col("num").alias("node"), "n", F.posexplode("toks").alias("at", "tok")).repartition("tok"))
    sizes = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # SimHash first: the groups of near fingerprints, each a star around its first row, checked on the texts.
    hashed = near_duplicates(docs, text, "num").filter("num <> component_id")
    stars = hashed.join(nodes.select(F.col("node").alias("num")), "num", "left_semi").selectExpr("component_id AS a", "num AS b")
    linked = _verified(docs, stars, text, width, similarity, parities)
    known = stage(components(linked), "known")
    rooted = toks.join(sizes, "tok").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lists = stage(rooted, "lists")
    some = F.when(F.col("c") > list_limit, F.pmod(F.xxhash64("node"), F.lit(16))).otherwise(0)
    ends = (lists.groupBy("tok", some.alias("some")).agg(F.min(F.struct("node", "n", "at", "root")).alias("e"))
            .select("tok", "e.*"))
    edges = linked.unionByName(_verified(docs, _pairs(ends, lists, similarity, "x.node <> y.node AND x.root <> y.root"),
                                         text, width, similarity, parities))
    roots = stage(components(edges), "roots")
    # Pairs with a list's first node are known; only lists of three or more have others.
    rooted = lists.filter("c > 2").drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = rooted.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    rooted = stage(rooted.join(open_lists.select("tok"), "tok"), "open")
    rest = _pairs(rooted, rooted, similarity, "x.node < y.node AND x.root <> y.root")
    if rest.head(1):
        edges = edges.unionByName(_verified(docs, rest, text, width, similarity, parities))
    found = components(edges)
    rooted = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return rows.select("num", "key").join(rooted, "key").select("num", "root")


def first_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, one for each group of near copies: that of the smallest id (a null id comes
    last; of rows with one id, the first in the table). Rows are numbered in a table that is written once, so that every
    step means the same row by a number. An empty table gives no rows."""
    columns, num = docs.columns, "num"
    while num.lower() in (c.lower() for c in columns):
        num = f"_{num}"
    numbered = stage(docs.withColumn(num, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(num).alias("num"), F.col(text).alias("text"))
    groups = stage(similar_groups(texts, "text", width, similarity), "groups")
    ranked = groups.join(numbered.select(F.col(num).alias("num"), F.col(id_col).alias("id")), "num")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("num"))
    first = ranked.groupBy("root").agg(F.min(order).getField("num").alias("winner"))
    # A row is dropped unless its number is a winner's: no join by root, which a group of very many copies would skew.
    return numbered.join(first.select(F.col("winner").alias(num)), num, "left_semi").select(*columns)
