"""Validation queries over the response fixture.

The oracle never parses JSON: it states, from the base tables, what each damage class of the
fixture must produce (FIXTURES.md §3).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import strip_fences
from cohortkit.operators import validate as V
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import view, with_views
from cohortkit.sources.fixtures import responses_fx
from cohortkit.sources.tables import load

view("resp_lines", """
SELECT order_key, cast(order_key % 20 AS INTEGER) AS c, pos, n_lines,
       CASE WHEN s19 = 2 AND pos < 3 THEN ['True', '1.0', '7'][pos + 1] ELSE item_name END AS item_name,
       CASE WHEN order_key % 20 = 14 THEN 'None' ELSE category END AS category,
       CASE WHEN order_key % 20 = 10 THEN [2, 2, 2, 1][pos % 4 + 1] WHEN order_key % 20 = 15 THEN 99
            WHEN s19 = 0 AND pos = 0 THEN 3000000000 WHEN s19 = 1 AND pos = 0 THEN 2000000000
            ELSE quantity END AS quantity,
       CASE WHEN order_key % 20 = 15 THEN cast(900.00 AS DECIMAL(18,2))
            WHEN s19 = 1 AND pos = 0 THEN cast(99999999999.99 AS DECIMAL(18,2))
            WHEN s19 = 0 AND pos = 0 THEN cast(0.01 AS DECIMAL(18,2)) ELSE unit_price END AS unit_price,
       CASE WHEN order_key % 20 = 12 THEN cast(declared_total + 0.02 AS DECIMAL(18,2)) ELSE declared_total END
         AS declared_total,
       CASE WHEN order_key % 20 = 16 AND pos = 0 THEN 'bad_structure'
            WHEN (order_key % 20 = 5 AND pos = 0) OR order_key % 20 IN (11, 17) THEN 'bad_types'
            WHEN s19 = 1 AND pos = 0 THEN 'amount_overflow' END AS problem
FROM (SELECT *, CASE WHEN order_key % 20 = 19 THEN (order_key // 20) % 4 END AS s19, cast(row_number() OVER (PARTITION BY order_key
                       ORDER BY item_name, category, quantity, unit_price, declared_total) - 1 AS INTEGER) AS pos,
             count(*) OVER (PARTITION BY order_key) AS n_lines
      FROM priced_lines_fx) t
WHERE order_key % 20 NOT IN (1, 2, 4, 7, 8)
""", ["priced_lines_fx"])

view("resp_outcome", """
SELECT o.o_orderkey + 1 AS attempt, o.o_orderkey AS order_key, o.o_custkey, o.o_orderdate, o.o_orderkey % 20 AS c,
       CASE WHEN o.o_orderkey % 20 = 1 THEN 'empty_content'
            WHEN o.o_orderkey % 20 = 2 THEN 'bad_json'
            WHEN o.o_orderkey % 20 = 8 THEN 'not_an_object'
            WHEN o.o_orderkey % 20 = 3 THEN 'missing_keys'
            WHEN o.o_orderkey % 20 IN (4, 7) THEN 'no_items'
            WHEN coalesce(v.n_valid, 0) = 0 THEN 'no_valid_items'
            WHEN o.o_orderkey % 20 IN (6, 9) THEN 'bad_datetime' END AS reason,
       CASE WHEN o.o_orderkey % 20 IN (1, 2, 7, 8) THEN NULL WHEN o.o_orderkey % 20 = 4 THEN 0
            ELSE v.n_lines END AS n_lines,
       CASE WHEN o.o_orderkey % 20 IN (1, 2, 7, 8) THEN NULL WHEN o.o_orderkey % 20 = 4 THEN 0
            ELSE v.n_valid END AS n_valid_lines,
       v.sub_cents
FROM orders o
JOIN (SELECT DISTINCT order_key FROM priced_lines_fx) h ON h.order_key = o.o_orderkey
LEFT JOIN (SELECT order_key, max(n_lines) AS n_lines, count(*) FILTER (WHERE problem IS NULL) AS n_valid,
                  sum(CASE WHEN problem IS NULL THEN CAST(quantity AS HUGEINT) * cast(unit_price * 100 AS BIGINT) END) AS sub_cents
           FROM resp_lines GROUP BY order_key) v ON v.order_key = o.o_orderkey
""", ["priced_lines_fx", "resp_lines"])

view("resp_receipts", """
SELECT attempt,
       CASE WHEN c = 14 THEN NULL ELSE 'ORD_' || cast(order_key AS VARCHAR) END AS receipt_id,
       'CUST_S_' || substr(sha1(cast(o_custkey AS VARCHAR)), 1, 8) AS customer_id,
       CASE WHEN c = 15 THEN 'Nowhere Market' ELSE n_name END AS store_name, r_name AS store_location,
       cast(o_orderdate AS TIMESTAMP) AS receipt_datetime, cast(weekofyear(o_orderdate) AS INTEGER) AS week_num,
       cast(n_valid_lines AS INTEGER) AS num_items,
       cast(cast(sub_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) AS subtotal,
       cast(round(cast(cast(sub_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) * 0.08, 2) AS DECIMAL(18,2)) AS tax,
       cast(cast(cast(sub_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))
            + round(cast(cast(sub_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) * 0.08, 2) AS DECIMAL(18,2))
         AS total_amount,
       'LLM' AS generator
FROM resp_outcome JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE reason IS NULL
""", ["resp_outcome"])

N_SQL = "(SELECT count(*) // 3 FROM orders)"


def _parsed(spark, sf_dir):
    return V.parse_responses(responses_fx(spark, sf_dir))


def _n(spark, sf_dir):
    """Target of the first-n loop: a third of the orders, so the 3n attempt budget covers them."""
    return load(spark, sf_dir, "orders", "o_orderkey").agg(F.floor(F.count(F.lit(1)) / 3)).scalar()


# the cleaned text of every response, restated from the base tables
view("resp_texts", """
SELECT o_orderkey AS order_key, c,
       '{' || concat_ws(', ',
         '"receipt_id": ' || CASE WHEN c = 14 THEN 'null' ELSE '"ORD_' || cast(o_orderkey AS VARCHAR) || '"' END,
         '"customer_id": "CUST_S_' || substr(sha1(cast(o_custkey AS VARCHAR)), 1, 8) || '"',
         '"store_name": ' || to_json(CASE WHEN c = 15 THEN 'Nowhere Market' ELSE n_name END),
         '"store_location": ' || to_json(r_name),
         '"receipt_datetime": ' || CASE WHEN c IN (6, 17) THEN '"soon"' WHEN c = 9 THEN 'null'
             ELSE '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN c = 18 THEN '+05:00' ELSE '' END || '"' END,
         '"items": ' || CASE WHEN c = 4 THEN '[]' WHEN c = 7 THEN js[1] ELSE '[' || array_to_string(js, ', ') || ']' END,
         '"subtotal": ' || cast(subtotal + bump AS VARCHAR),
         CASE WHEN c <> 3 THEN '"tax": ' || cast(tax + bump AS VARCHAR) END,
         '"total_amount": ' || cast(cast(subtotal + tax AS DECIMAL(18,2)) AS VARCHAR)) || '}' AS obj
FROM (SELECT order_key, c, list(j ORDER BY pos) AS js, cast(sum(item_total) AS DECIMAL(18,2)) AS subtotal,
             cast(round(cast(sum(item_total) AS DECIMAL(18,2)) * 0.08, 2) AS DECIMAL(18,2)) AS tax,
             cast(CASE WHEN c = 13 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS bump
      FROM (SELECT *, '{' || concat_ws(', ',
              '"item_name": ' || CASE WHEN s19 = 2 AND pos < 3 THEN ['true', '1.0', '7'][pos + 1] ELSE to_json(item_name) END,
              CASE WHEN c = 14 THEN '"category": null' WHEN c = 16 AND pos = 0 THEN NULL
                   ELSE '"category": ' || to_json(category) END,
              '"quantity": ' || CASE WHEN c = 5 AND pos = 0 THEN '"two"' WHEN c = 11 THEN '"2.9"' WHEN c = 15 THEN '99'
                   WHEN c = 10 THEN ['"2"', '" 2 "', '2.9', 'true'][pos % 4 + 1] WHEN c = 17 THEN '"x"'
                   WHEN s19 = 0 AND pos = 0 THEN '3000000000' WHEN s19 = 1 AND pos = 0 THEN '2000000000'
                   ELSE cast(quantity AS VARCHAR) END,
              '"unit_price": ' || CASE WHEN c = 15 THEN '900.00' WHEN s19 = 0 AND pos = 0 THEN '0.01'
                   WHEN s19 = 1 AND pos = 0 THEN '99999999999.99' ELSE cast(unit_price AS VARCHAR) END,
              '"item_total": ' || cast(cast(declared_total + CASE WHEN c = 12 THEN 0.02 ELSE 0 END AS DECIMAL(18,2)) AS VARCHAR)) || '}' AS j
            FROM (SELECT *, order_key % 20 AS c, CASE WHEN order_key % 20 = 19 THEN (order_key // 20) % 4 END AS s19,
                         row_number() OVER (PARTITION BY order_key
                           ORDER BY item_name, category, quantity, unit_price, declared_total) - 1 AS pos
                  FROM priced_lines_fx) l) t
      GROUP BY order_key, c) r
JOIN orders ON r.order_key = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""", ["priced_lines_fx"])


@register("strip_fences", with_views("""
SELECT order_key + 1 AS attempt, md5(clean) AS clean_md5, cast(length(clean) AS INTEGER) AS clean_len, c = 0 AS was_fenced
FROM (SELECT order_key, c, CASE c WHEN 1 THEN '' WHEN 2 THEN 'Sorry, I cannot produce that receipt.'
                                  WHEN 8 THEN '[' || obj || ']' ELSE obj END AS clean FROM resp_texts) t
""", "resp_texts"))
def q_strip_fences(spark, sf_dir):
    """Cleaned text (C3, C4) of every response: digest, length, and whether it was fenced."""
    clean = strip_fences(F.col("raw"))
    return responses_fx(spark, sf_dir).select(
        "attempt", F.md5(clean.cast("binary")).alias("clean_md5"), F.length(clean).alias("clean_len"),
        ((F.col("raw") != clean) & F.col("raw").startswith("```")).alias("was_fenced"))


@register("response_validate", with_views("""
SELECT attempt, reason, reason IS NULL AS accepted, cast(n_lines AS INTEGER) AS n_lines,
       cast(n_valid_lines AS INTEGER) AS n_valid_lines
FROM resp_outcome""", "resp_outcome"))
def q_response_validate(spark, sf_dir):
    return V.validation_outcome(_parsed(spark, sf_dir))


@register("validated_receipts", with_views("SELECT * FROM resp_receipts", "resp_receipts"))
def q_validated_receipts(spark, sf_dir):
    return V.accepted_receipts(_parsed(spark, sf_dir))


@register("validated_items", with_views("""
SELECT o.attempt, l.pos, CASE WHEN o.c = 14 THEN NULL ELSE 'ORD_' || cast(o.order_key AS VARCHAR) END AS receipt_id,
       'CUST_S_' || substr(sha1(cast(o.o_custkey AS VARCHAR)), 1, 8) AS customer_id,
       l.item_name, l.category, cast(l.quantity AS BIGINT) AS quantity, l.unit_price,
       cast(CAST(l.quantity AS DECIMAL(18,0)) * l.unit_price AS DECIMAL(18,2)) AS item_total, 'LLM' AS generator
FROM resp_outcome o JOIN resp_lines l ON l.order_key = o.order_key
WHERE o.reason IS NULL AND l.problem IS NULL""", "resp_outcome"))
def q_validated_items(spark, sf_dir):
    return V.accepted_items(_parsed(spark, sf_dir))


@register("item_total_audit", with_views("""
SELECT o.attempt, l.pos, l.declared_total, cast(CAST(l.quantity AS DECIMAL(18,0)) * l.unit_price AS DECIMAL(18,2)) AS item_total,
       abs(cast(CAST(l.quantity AS DECIMAL(18,0)) * l.unit_price AS DECIMAL(18,2)) - l.declared_total) > 0.01 AS item_total_mismatch
FROM resp_outcome o JOIN resp_lines l ON l.order_key = o.order_key
WHERE o.reason IS NULL AND l.problem IS NULL""", "resp_outcome"))
def q_item_total_audit(spark, sf_dir):
    return V.item_total_audit(_parsed(spark, sf_dir))


@register("item_validate", with_views("""
SELECT order_key + 1 AS attempt, pos, problem IS NULL AS valid, problem FROM resp_lines""", "resp_lines"))
def q_item_validate(spark, sf_dir):
    return V.line_checks(_parsed(spark, sf_dir))


@register("reject_summary", with_views("""
SELECT reason, count(*) AS n_attempts FROM resp_outcome WHERE reason IS NOT NULL GROUP BY reason""",
                                       "resp_outcome"))
def q_reject_summary(spark, sf_dir):
    return V.reject_summary(_parsed(spark, sf_dir))


FIRST_N_SQL = f"""
SELECT * FROM (
  SELECT r.*, row_number() OVER (ORDER BY attempt) AS accept_rank FROM resp_receipts r
  WHERE attempt <= 3 * {N_SQL}) t
WHERE accept_rank <= {N_SQL}"""


@register("first_n_accepted", with_views(FIRST_N_SQL, "resp_receipts"))
def q_first_n_accepted(spark, sf_dir):
    return V.first_n_accepted(_parsed(spark, sf_dir), _n(spark, sf_dir))


@register("attempt_summary", with_views(f"""
WITH f AS ({FIRST_N_SQL}),
s AS (SELECT count(*) AS n_accepted, max(CASE WHEN accept_rank = {N_SQL} THEN attempt END) AS nth FROM f)
SELECT cast({N_SQL} AS BIGINT) AS target, cast(3 * {N_SQL} AS BIGINT) AS max_attempts,
       (SELECT count(*) FROM resp_outcome WHERE attempt <= coalesce((SELECT nth FROM s), 3 * {N_SQL})) AS attempts_used,
       (SELECT n_accepted FROM s) AS n_accepted
""", "resp_receipts", "resp_outcome"))
def q_attempt_summary(spark, sf_dir):
    return V.attempt_summary(_parsed(spark, sf_dir), _n(spark, sf_dir))
