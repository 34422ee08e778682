"""Generator queries over the customer table.

The oracle restates every keyed draw in DuckDB SQL: the same md5 slices, the same integer
arithmetic, with lines as rows (``unnest``) instead of arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import generate as G
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import view, with_views
from cohortkit.sources.catalog import categories
from cohortkit.sources.tables import load

SEED = K.SEED


def md5_sql(*parts: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


def slot_sql(m: str, i: int) -> str:
    return f"cast('0x' || substr({m}, {8 * i + 1}, 8) AS BIGINT)"


def uniform_sql(h: str) -> str:
    return f"((cast({h} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296.0 AS DOUBLE))"


def list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CATS_SQL = list_sql(categories())
ITEM_CATS_SQL = list_sql([c for c, _, _ in K.CATALOG])
CATALOG_SQL = "[" + ", ".join(
    "{'item_name': '%s', 'category': '%s', 'base_cents': %d}" % (n, c, round(float(p) * 100)) for c, n, p in K.CATALOG) + "]"

view("gen_kept", f"""
SELECT c_custkey AS cust_key, 'CUST_S_' || substr(sha1(cast(c_custkey AS VARCHAR)), 1, 8) AS customer_id,
       cast(w.week_num AS INTEGER) AS week_num
FROM customer, (SELECT unnest(range(0, {K.N_WEEKS})) AS week_num) w
WHERE {uniform_sql(slot_sql(md5_sql('c_custkey', 'w.week_num', "'keep'"), 0))} < {K.KEEP_PROB}
""")

_M1 = md5_sql("cust_key", "week_num", "'receipt'")
_M2 = md5_sql("cust_key", "week_num", "'shape'")
_M3 = md5_sql("cust_key", "week_num", "'pref'")
view("gen_draws", f"""
SELECT cust_key, customer_id, week_num, receipt_id, store_name, store_location, day_offset, hour, minute,
       TIMESTAMP '{K.START_DATE}' + to_days(week_num * 7 + day_offset) + to_hours(hour) + to_minutes(minute)
         AS receipt_datetime,
       num_items,
       list_slice([{CATS_SQL}[c1 + 1], {CATS_SQL}[c2 + 1], {CATS_SQL}[c3 + 1]], 1, k) AS preferred
FROM (
SELECT *, x3 + CASE WHEN x3 >= greatest(c1, c2) THEN 1 ELSE 0 END AS c3
FROM (
SELECT *, t3 + CASE WHEN t3 >= least(c1, c2) THEN 1 ELSE 0 END AS x3
FROM (
SELECT *, t2 + CASE WHEN t2 >= c1 THEN 1 ELSE 0 END AS c2
FROM (
  SELECT cust_key, customer_id, week_num,
         'STAT_' || md5(concat_ws(':', '{SEED}', cust_key, week_num)) AS receipt_id,
         {list_sql(K.STORE_NAMES)}[1 + {slot_sql('m1', 0)} % {len(K.STORE_NAMES)}] AS store_name,
         {list_sql(K.STORE_LOCATIONS)}[1 + {slot_sql('m1', 1)} % {len(K.STORE_LOCATIONS)}] AS store_location,
         cast({slot_sql('m1', 2)} % 7 AS INTEGER) AS day_offset,
         cast(8 + {slot_sql('m1', 3)} % 13 AS INTEGER) AS hour,
         cast({slot_sql('m2', 0)} % 60 AS INTEGER) AS minute,
         greatest(1, cast(trunc(CAST({float(K.ITEMS_MEAN)} AS DOUBLE) + CAST({float(K.ITEMS_SD)} AS DOUBLE)
           * (sqrt(CAST(-2.0 AS DOUBLE) * ln({uniform_sql(slot_sql('m2', 1))}))
              * cos(CAST({2.0 * math.pi!r} AS DOUBLE) * {uniform_sql(slot_sql('m2', 2))}))) AS INTEGER)) AS num_items,
         cast(1 + {slot_sql('m2', 3)} % 3 AS INTEGER) AS k,
         cast({slot_sql('m3', 0)} % 7 AS INTEGER) AS c1,
         cast({slot_sql('m3', 1)} % 6 AS INTEGER) AS t2,
         cast({slot_sql('m3', 2)} % 5 AS INTEGER) AS t3
  FROM (SELECT *, {_M1} AS m1, {_M2} AS m2, {_M3} AS m3 FROM gen_kept) x
) y) y2) y3) y4
""", ["gen_kept"])

_LM = md5_sql("cust_key", "week_num", "'line'", "line_no")
view("gen_lines", f"""
SELECT receipt_id, customer_id, line_no, it.item_name, it.category, quantity,
       cast(cast(unit_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) AS unit_price,
       cast(cast(quantity * unit_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) AS item_total,
       quantity * unit_cents AS total_cents
FROM (
  SELECT receipt_id, customer_id, line_no, it, quantity,
         (it.base_cents * ppm + 500000) // 1000000 AS unit_cents
  FROM (
    SELECT receipt_id, customer_id, line_no,
           {CATALOG_SQL}[1 + len(list_filter(cum, lambda c: c <= {slot_sql('lm', 0)} % cum[{len(K.CATALOG)}]))] AS it,
           cast(1 + {slot_sql('lm', 1)} % 3 AS INTEGER) AS quantity,
           {K.PRICE_PPM_MIN} + {slot_sql('lm', 2)} % {K.PRICE_PPM_MAX - K.PRICE_PPM_MIN + 1} AS ppm
    FROM (
      SELECT *, {_LM} AS lm FROM (
        SELECT receipt_id, customer_id, cust_key, week_num,
               list_transform(wts, lambda x, i: list_sum(wts[1:i])) AS cum,
               cast(unnest(range(1, num_items + 1)) AS INTEGER) AS line_no
        FROM (SELECT *, list_transform({ITEM_CATS_SQL},
                         lambda c: CASE WHEN list_contains(preferred, c) THEN {K.PREF_WEIGHT} ELSE 1 END) AS wts
              FROM gen_draws) a
      ) b
    ) c
  ) d
) e
""", ["gen_draws"])

view("gen_receipts_v", """
SELECT receipt_id, customer_id, store_name, store_location, receipt_datetime, week_num,
       cast(n AS INTEGER) AS num_items, subtotal,
       cast(round(subtotal * 0.08, 2) AS DECIMAL(18,2)) AS tax,
       cast(subtotal + round(subtotal * 0.08, 2) AS DECIMAL(18,2)) AS total_amount,
       'Statistical' AS generator
FROM gen_draws JOIN (SELECT receipt_id, count(*) AS n,
                            cast(cast(sum(total_cents) AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) AS subtotal
                     FROM gen_lines GROUP BY receipt_id) USING (receipt_id)
""", ["gen_draws", "gen_lines"])


def _customers(spark, sf_dir):
    return load(spark, sf_dir, "customer", "c_custkey")


@register("customer_ids", """
SELECT c_custkey AS cust_key, 'CUST_S_' || substr(sha1(cast(c_custkey AS VARCHAR)), 1, 8) AS customer_id FROM customer
""")
def q_customer_ids(spark, sf_dir):
    return G.customer_ids(_customers(spark, sf_dir))


@register("customer_week_grid", f"""
SELECT c_custkey AS cust_key, 'CUST_S_' || substr(sha1(cast(c_custkey AS VARCHAR)), 1, 8) AS customer_id,
       cast(unnest(range(0, {K.N_WEEKS})) AS INTEGER) AS week_num FROM customer
""")
def q_customer_week_grid(spark, sf_dir):
    return G.customer_week_grid(G.customer_ids(_customers(spark, sf_dir)))


@register("bernoulli_keep", with_views("SELECT cust_key, customer_id, week_num FROM gen_kept", "gen_kept"))
def q_bernoulli_keep(spark, sf_dir):
    return G.retained(G.customer_week_grid(G.customer_ids(_customers(spark, sf_dir))))


def _draws(spark, sf_dir):
    return G.receipt_draws(G.retained(G.customer_week_grid(G.customer_ids(_customers(spark, sf_dir)))))


@register("draw_choice", with_views("SELECT receipt_id, store_name, store_location FROM gen_draws", "gen_draws"))
def q_draw_choice(spark, sf_dir):
    return _draws(spark, sf_dir).select("receipt_id", "store_name", "store_location")


@register("draw_randint", with_views("SELECT receipt_id, day_offset, hour, minute, receipt_datetime FROM gen_draws",
                                     "gen_draws"))
def q_draw_randint(spark, sf_dir):
    return _draws(spark, sf_dir).select("receipt_id", "day_offset", "hour", "minute", "receipt_datetime")


@register("draw_normal_int", with_views("SELECT receipt_id, num_items FROM gen_draws", "gen_draws"))
def q_draw_normal_int(spark, sf_dir):
    return _draws(spark, sf_dir).select("receipt_id", "num_items")


@register("draw_preferred", with_views("SELECT receipt_id, preferred FROM gen_draws", "gen_draws"))
def q_draw_preferred(spark, sf_dir):
    return _draws(spark, sf_dir).select("receipt_id", "preferred")


@register("gen_receipts", with_views("SELECT * FROM gen_receipts_v", "gen_receipts_v"))
def q_gen_receipts(spark, sf_dir):
    return G.statistical_receipts(spark, _customers(spark, sf_dir))


@register("gen_items", with_views("""
SELECT receipt_id, customer_id, line_no, item_name, category, quantity, unit_price, item_total,
       'Statistical' AS generator FROM gen_lines
""", "gen_lines"))
def q_gen_items(spark, sf_dir):
    return G.statistical_items(spark, _customers(spark, sf_dir))


@register("catalog_item_draws", with_views("""
SELECT c.item_idx, c.item_name, c.base_price, c.category, coalesce(n.cnt, 0) AS n_lines
FROM (SELECT cast(i - 1 AS INTEGER) AS item_idx, s.item_name, s.category,
             cast(cast(s.base_cents AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2)) AS base_price
      FROM (SELECT unnest(range(1, 28)) AS i) r, LATERAL (SELECT """ + CATALOG_SQL + """[i] AS s) x) c
LEFT JOIN (SELECT item_name, count(*) AS cnt FROM gen_lines GROUP BY item_name) n ON n.item_name = c.item_name
""", "gen_lines"))
def q_catalog_item_draws(spark, sf_dir):
    """The flattened catalog (S1) with how often the generator drew each item."""
    from cohortkit.sources.catalog import catalog_df
    items = G.statistical_items(spark, _customers(spark, sf_dir))
    n = items.groupBy("item_name").agg(F.count(F.lit(1)).alias("n_lines"))
    cat = catalog_df(spark)
    return F.broadcast(cat).join(n, "item_name", "left").select(
        "item_idx", "item_name", "base_price", "category", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
