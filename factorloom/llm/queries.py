"""One query for each operator of this subpackage, on its whole table, and check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (decontaminate, filter_audit, html_main, line_rules, masked_lm, ngram_join, packing, prefix_trie,
                             quality, sharding, simhash, toxicity, url_cascade)
from factorloom.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# The rules of the url query, and the domains it takes as listed.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
             ("net/fr/", "block")]
BLOCKED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_ENDS = ("example.com", "example.net", "example.org")


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the depletion by frequent lines, for all documents."""
    return line_rules.judge(table(spark, sf_dir, "documents"))


ORACLE["op6_line_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, source, t, pos, line, words
       FROM (SELECT r, source, t, pos, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
                    array_to_string(list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'),
                        lambda y: translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), chr(32)) AS line
             FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS x,
                          generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d))
       WHERE words > 0),
often AS (SELECT source, line FROM ln GROUP BY source, line HAVING count(DISTINCT t) >= 20),
hit AS (SELECT ln.* FROM ln JOIN often ON ln.source IS NOT DISTINCT FROM often.source AND ln.line = often.line),
wit AS (SELECT r, CASE WHEN 2 * sum(hit.words) < len(any_value(w.ws)) THEN 'text' || any_value(hit.t)
                       ELSE 'line' || first(line ORDER BY hit.words DESC, pos) END AS witness
        FROM hit JOIN w USING (r) GROUP BY r),
many AS (SELECT source, line, count(DISTINCT witness) AS n FROM hit JOIN wit USING (r) GROUP BY source, line),
size AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
bad AS (SELECT many.source, line FROM many JOIN size ON many.source IS NOT DISTINCT FROM size.source
        WHERE n >= 20 AND 1000 * n >= texts),
gone AS (SELECT r, sum(words) AS g FROM ln JOIN bad ON ln.source IS NOT DISTINCT FROM bad.source AND ln.line = bad.line GROUP BY r),
b AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(g, 0) AS g
      FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - g) >= 30 * n_words AS kept
FROM b"""


@query
def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [(f"{site}.{end}",) for site in BLOCKED_SITES for end in BLOCKED_ENDS]
    return url_cascade.judge(table(spark, sf_dir, "pages"), URL_RULES, spark.createDataFrame(keys, "key string"))


ORACLE["op2_url_cascade"] = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, says, h, pre) AS (VALUES {', '.join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in URL_RULES)}),
b(key) AS (VALUES {', '.join(f"('{s}.{e}')" for s in BLOCKED_SITES for e in BLOCKED_ENDS)}),
f AS (SELECT page_id, host, path, (SELECT max(struct_pack(n := length(rule), rule := rule, says := says)) FROM r
             WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, pre)) AS best,
             EXISTS (SELECT 1 FROM b WHERE host = key OR host LIKE '%.' || key) AS listed FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM f"""


@query
def op4_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, and how much of each page went as a recurring template."""
    found = html_main.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by the network trained on every place of them."""
    return masked_lm.fit_and_score(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations: one row a node."""
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


ORACLE["op12_prefix_trie"] = r"""
WITH tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda s, _: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END) AS v FROM (SELECT unnest(range(256)) AS n))),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, (xor(list_reduce(list_prepend(4294967295, list_transform(
             string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda s, b: xor(s // 256, tab[xor(s, b) % 256 + 1])), 4294967295) % 4)::BIGINT AS h FROM o, tab),
r AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM h AS a LEFT JOIN o AS b ON a.base = b.conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
             FILTER (WHERE ends), '')) AS ends_sha256, row_number() OVER () AS node FROM p GROUP BY d, prefix),
m AS (SELECT p.conv_id, p.d, n.node FROM p JOIN n ON p.d = n.d AND p.prefix = n.prefix),
k AS (SELECT n.*, u.node AS up, u.conv_id AS parent_conv_id, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1)
             * len(regexp_extract_all(n.prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS val
      FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.prefix = n.prefix[1:n.d - 1]),
ch AS (SELECT up AS node, count(*) AS n_children FROM k WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.node AS top, b.node FROM m AS a JOIN m AS b ON a.conv_id = b.conv_id AND b.d >= a.d),
s AS (SELECT top, sum(val)::BIGINT AS saved_tokens, count(*) FILTER (WHERE ch.node IS NULL) AS n_leaves
      FROM below JOIN k USING (node) LEFT JOIN ch USING (node) GROUP BY top)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM k JOIN s ON s.top = k.node LEFT JOIN ch ON ch.node = k.node"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_filter_audit"] = r"""
WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (SELECT unnest(string_split('ABCDE', '')) AS f)
                             WHERE NOT contains(o, f)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
                    CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' END,
                    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN again THEN 'E' END) AS fails
      FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, fails),
s AS (SELECT o, k + 1 AS step, o[k + 1] AS f, o[1:k] AS before FROM (SELECT o, unnest(range(5)) AS k FROM orders WHERE length(o) = 5)),
r AS (SELECT part, o, step, f, sum(CASE WHEN fails = '' OR translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM g, s GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a similarity of 0.85 or more over four-word shingles."""
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents"))
