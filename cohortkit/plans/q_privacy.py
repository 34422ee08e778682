"""Privacy queries over the receipt fixture."""

from __future__ import annotations

from cohortkit.operators import privacy as P
from cohortkit.operators.pii import LETTERS, PATTERNS, pii_scan
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import with_views
from cohortkit.sources.fixtures import receipts_fx
from cohortkit.sources.tables import load

COHORTS_SQL = "(VALUES ('Statistical'), ('LLM')) AS g(generator)"
UNIQ_COLS = ["customer_id", "store_name", "store_location", "receipt_datetime", "week_num", "num_items",
             "subtotal", "tax", "total_amount"]

UNIQ_SQL = "\nUNION ALL\n".join(
    f"SELECT generator, '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct "
    f"FROM receipts_fx GROUP BY generator" for c in UNIQ_COLS)

UNIQ_BODY = f"""
SELECT generator, column_name, n_rows, n_distinct, round(n_distinct / n_rows, 6) AS ratio,
       (n_distinct / n_rows > 0.95 AND n_distinct > 10) AS flagged
FROM ({UNIQ_SQL}) u WHERE n_rows > 1"""


@register("privacy_extremes", with_views(f"""
SELECT g.generator, coalesce(r.n_receipts, 0) AS n_receipts, r.max_total_amount, r.max_num_items
FROM {COHORTS_SQL}
LEFT JOIN (SELECT generator, count(*) AS n_receipts, max(total_amount) AS max_total_amount,
                  max(num_items) AS max_num_items FROM receipts_fx GROUP BY generator) r ON r.generator = g.generator
""", "receipts_fx"))
def q_privacy_extremes(spark, sf_dir):
    return P.extremes(spark, receipts_fx(spark, sf_dir))


@register("privacy_uniqueness", with_views(UNIQ_BODY, "receipts_fx"))
def q_privacy_uniqueness(spark, sf_dir):
    return P.uniqueness(receipts_fx(spark, sf_dir))


@register("privacy_verdict", with_views(f"""
WITH u AS ({UNIQ_BODY})
SELECT p.generator, coalesce(list_sort(list(u.column_name) FILTER (WHERE u.flagged)), []) AS flagged_columns,
       CASE WHEN count(*) FILTER (WHERE u.flagged) > 0 THEN 'warning' ELSE 'clean' END AS verdict
FROM (SELECT DISTINCT generator FROM receipts_fx) p LEFT JOIN u ON u.generator = p.generator
GROUP BY p.generator
""", "receipts_fx"))
def q_privacy_verdict(spark, sf_dir):
    return P.uniqueness_verdict(spark, receipts_fx(spark, sf_dir))


_MOVED = "(substr(x, 5) || substr(x, 1, 4))"
VALID_SQL = {
    "long_number": "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(x), i, 1) AS INTEGER) "
                   "ELSE (2 * CAST(substr(reverse(x), i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse(x), i, 1) AS INTEGER)) % 10 END)) % 10 = 0",
    "ipv4": "len(list_filter(string_split(x, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0",
    "iban": f"list_reduce(list_prepend(0, list_transform(range(1, len{_MOVED} + 1), lambda i: CAST(position(substr({_MOVED}, i, 1) IN '{LETTERS}') - 1 AS INTEGER))), "
            "lambda r, v: (r * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1",
}


@register("pii_scan", "\nUNION ALL\n".join(f"""
SELECT source, '{k}' AS kind, count(*) AS n_docs, count(*) FILTER (WHERE len(found) > 0) AS n_with, cast(sum(len(found)) AS BIGINT) AS n_matches,
       cast(sum(len(list_filter(found, lambda x: {VALID_SQL.get(k, 'true')}))) AS BIGINT) AS n_valid
FROM (SELECT source, regexp_extract_all(coalesce(text, ''), '{p}') AS found FROM documents) t GROUP BY source"""
                                           for k, p in PATTERNS.items()))
def q_pii_scan(spark, sf_dir):
    """Personal-data patterns and their valid matches per source of all documents (V7)."""
    return pii_scan(load(spark, sf_dir, "documents", "source", "text"))
