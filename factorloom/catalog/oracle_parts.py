"""Shared pieces of the check SQL."""

EVENT_ROWS = """ev AS (
  SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS u, event_type AS i, CAST(hour(ts) AS VARCHAR) AS h,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 100 AS k, value / 500 AS y
  FROM events)"""

EVENT_ENTRIES = EVENT_ROWS + """, entries AS (
  SELECT row_id, 0 AS block, 'user' AS cat, u AS key, 1e0 AS val FROM ev
  UNION ALL SELECT row_id, 1, 'item', i, 1e0 FROM ev
  UNION ALL SELECT row_id, 2, 'context_numerical', 'k', k FROM ev
  UNION ALL SELECT row_id, 3, 'context_categorical', h, 1e0 FROM ev
  UNION ALL SELECT row_id, 4, 'label', 'y', y FROM ev)"""

RATING_ROWS = """ra AS (
  SELECT CAST((o_custkey * (SELECT max(p_partkey) + 1 FROM part) + l_partkey) * 5
              + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS BIGINT) AS row_id,
         o_custkey, l_partkey, o_orderpriority, avg(l_discount) AS discount, avg(l_quantity) / 50 AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey, o_orderpriority)"""

RATING_ENTRIES = RATING_ROWS + """, entries AS (
  SELECT row_id, 0 AS block, 'user' AS cat, CAST(o_custkey AS VARCHAR) AS key, 1e0 AS val FROM ra
  UNION ALL SELECT row_id, 1, 'item', CAST(l_partkey AS VARCHAR), 1e0 FROM ra
  UNION ALL SELECT row_id, 2, 'context_numerical', 'discount', discount FROM ra
  UNION ALL SELECT row_id, 3, 'context_categorical', o_orderpriority, 1e0 FROM ra
  UNION ALL SELECT row_id, 4, 'label', 'y', y FROM ra)"""

SET_WEIGHTS = """sw AS (
  SELECT o_custkey AS row_id, o_orderpriority AS key,
         count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_custkey) AS DOUBLE) AS val
  FROM orders GROUP BY o_custkey, o_orderpriority)"""

PROFILE_ENTRIES = SET_WEIGHTS + """, entries AS (
  SELECT c_custkey AS row_id, 0 AS block, 'user' AS cat, CAST(c_custkey AS VARCHAR) AS key, 1e0 AS val FROM customer
  UNION ALL SELECT c_custkey, 1, 'context_categorical', c_mktsegment, 1e0 FROM customer
  UNION ALL SELECT row_id, 2, 'context_categorical_set', key, val FROM sw
  UNION ALL SELECT c_custkey, 3, 'label', 'y', c_acctbal / 10000 FROM customer)"""

TERM_ENTRIES = """words AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents),
tw AS (
  SELECT doc_id AS row_id, term AS key,
         count(*) / CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE) AS val
  FROM words WHERE term <> '' GROUP BY doc_id, term),
entries AS (
  SELECT doc_id AS row_id, 0 AS block, 'item' AS cat, source AS key, 1e0 AS val FROM documents
  UNION ALL SELECT row_id, 1, 'context_categorical_set', key, val FROM tw)"""

DICT = """dict AS (
  SELECT block, cat, key,
         row_number() OVER (ORDER BY block, substr(md5(key), 1, 3), key) - 1 AS col
  FROM (SELECT DISTINCT block, cat, key FROM entries WHERE key IS NOT NULL AND val IS NOT NULL)),
cells AS (
  SELECT row_id, d.col, e.cat, e.val
  FROM entries e JOIN dict d ON e.block = d.block AND e.key = d.key WHERE e.val IS NOT NULL),
dim AS (SELECT max(col) AS n FROM cells)"""

# For documents there is no label, so the width is one past the last column.
DICT_NO_LABEL = DICT.replace("SELECT max(col) AS n", "SELECT max(col) + 1 AS n")


def factors(k: int = 2, n: str = "(SELECT n FROM dim)") -> str:
    ms = ", ".join(f"((c * 7919 + {104729 * f + 13}) % 101 - 50) / 103e0 AS m{f}" for f in range(k))
    return (f"factors AS (SELECT c AS col, ((c * 31) % 17 - 8) / 97e0 AS v, {ms} "
            f"FROM (SELECT unnest(range({n})) AS c))")


def row_parts(k: int = 2, cells: str = "cells", n: str = "(SELECT n FROM dim)") -> str:
    sums = ", ".join(f"sum(coalesce(m{f}, 0) * x) AS s{f}, sum(coalesce(m{f}, 0) * x * coalesce(m{f}, 0) * x) AS q{f}"
                     for f in range(k))
    return f"""parts AS (
  SELECT row_id, sum(coalesce(v, 0) * x) AS linear, {sums}
  FROM (SELECT c.row_id, f.*, CASE WHEN c.col < {n} AND c.val > 0 THEN c.val ELSE 0 END AS x
        FROM {cells} c LEFT JOIN factors f ON c.col = f.col)
  GROUP BY row_id)"""


def equation(k: int = 2, c: str = "0.1e0", linear: str = "linear") -> str:
    pair = " + ".join(f"s{f} * s{f} - q{f}" for f in range(k))
    return f"({c} + {linear} + 0.5e0 * ({pair}))"


EVENTS_BASE = f"WITH {EVENT_ENTRIES}, {DICT}"
RATINGS_BASE = f"WITH {RATING_ENTRIES}, {DICT}"
PROFILE_BASE = f"WITH {PROFILE_ENTRIES}, {DICT}"


def descent(base: str, steps: int, k: int = 2, lr: str = "0.1e0", reg_c: str = "0.01e0", reg_v: str = "0.02e0",
            reg_m: str = "0.03e0") -> str:
    """Full-batch steps from the lattice model, one group of CTEs per step; ends with w{steps} and c{steps}."""
    ms = [f"m{f}" for f in range(k)]
    sql = f"""{base}, {factors(k)},
tgt AS (SELECT row_id, val AS target FROM cells WHERE col = (SELECT n FROM dim)),
feat AS (SELECT c.row_id, c.col, c.val AS x FROM cells c JOIN tgt t ON c.row_id = t.row_id
         WHERE c.col < (SELECT n FROM dim) AND c.val > 0),
cnt AS (SELECT CAST(count(*) AS DOUBLE) AS rows FROM tgt),
w0 AS (SELECT * FROM factors), c0 AS (SELECT 0.1e0 AS c)"""
    for t in range(steps):
        sums = ", ".join(f"sum({m} * x) AS s{f}, sum({m} * x * {m} * x) AS q{f}" for f, m in enumerate(ms))
        sql += f""",
p{t} AS (SELECT row_id, sum(v * x) AS linear, {sums} FROM feat JOIN w{t} USING (col) GROUP BY row_id),
e{t} AS (SELECT g.row_id, {", ".join(f"coalesce(s{f}, 0) AS s{f}" for f in range(k))},
          (SELECT c FROM c{t}) + coalesce(linear, 0)
          + coalesce(0.5e0 * ({" + ".join(f"s{f} * s{f} - q{f}" for f in range(k))}), 0) - target AS e
          FROM tgt g LEFT JOIN p{t} p ON g.row_id = p.row_id),
g{t} AS (SELECT col, sum(e * x) / (SELECT rows FROM cnt) AS gv,
          {", ".join(f"sum(e * (s{f} * x - {m} * x * x)) / (SELECT rows FROM cnt) AS g{f}" for f, m in enumerate(ms))}
          FROM feat JOIN w{t} USING (col) JOIN e{t} USING (row_id) GROUP BY col),
w{t + 1} AS (SELECT w.col, v - {lr} * (coalesce(gv, 0) + {reg_v} * v) AS v,
          {", ".join(f"{m} - {lr} * (coalesce(g{f}, 0) + {reg_m} * {m}) AS {m}" for f, m in enumerate(ms))}
          FROM w{t} w LEFT JOIN g{t} g ON w.col = g.col),
c{t + 1} AS (SELECT c - {lr} * ((SELECT avg(e) FROM e{t}) + {reg_c} * c) AS c FROM c{t})"""
    return sql


def weight_lines(table: str, c: str, k: int = 2, digits: int = 6) -> str:
    """(col, part, value) lines of a weight table; the bias has column -1."""
    ms = "".join(f" UNION ALL SELECT col, 'm{f}', round(m{f}, {digits}) + 0.0 FROM {table}" for f in range(k))
    return (f" SELECT CAST(-1 AS BIGINT) AS col, 'c' AS part, round({c}, {digits}) + 0.0 AS value"
            f" UNION ALL SELECT col, 'v', round(v, {digits}) + 0.0 FROM {table}{ms}")
