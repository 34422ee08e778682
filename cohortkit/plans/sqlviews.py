"""DuckDB statements of the fixture views, used as CTEs by the oracle SQL.

They restate FIXTURES.md §2 directly on the base tables so the oracle never shares code with
the Spark side.
"""

from __future__ import annotations

SQL_VIEWS: dict[str, str] = {}
SQL_DEPS: dict[str, list[str]] = {}


def view(name: str, sql: str, deps: list[str] | None = None) -> None:
    SQL_VIEWS[name] = sql.strip()
    SQL_DEPS[name] = deps or []


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs ``names`` (and their dependencies) in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in SQL_DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{SQL_VIEWS[n]}\n)" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def sql_cents(expr: str) -> str:
    return f"cast(floor({expr} * 100.0 + 0.5) AS BIGINT)"


def sql_money_of_cents(expr: str) -> str:
    return f"cast(cast({expr} AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))"


def sql_customer_id(expr: str) -> str:
    return f"'CUST_S_' || substr(sha1(cast({expr} AS VARCHAR)), 1, 8)"


view("priced_lines_fx", f"""
SELECT l_orderkey AS order_key, p_name AS item_name, p_type AS category,
       cast(l_quantity AS INTEGER) AS quantity,
       {sql_money_of_cents(sql_cents('p_retailprice'))} AS unit_price,
       {sql_money_of_cents('cast(l_quantity AS INTEGER) * ' + sql_cents('p_retailprice'))} AS item_total,
       {sql_money_of_cents(sql_cents('l_extendedprice'))} AS declared_total
FROM lineitem JOIN part ON l_partkey = p_partkey
""")

view("items_fx", f"""
SELECT 'ORD_' || cast(order_key AS VARCHAR) AS receipt_id,
       {sql_customer_id('o_custkey')} AS customer_id,
       item_name, category, quantity, unit_price, item_total, declared_total,
       CASE WHEN order_key % 10 = 0 THEN 'LLM' ELSE 'Statistical' END AS generator
FROM priced_lines_fx JOIN orders ON order_key = o_orderkey
""", ["priced_lines_fx"])

view("receipts_fx", f"""
SELECT 'ORD_' || cast(o_orderkey AS VARCHAR) AS receipt_id,
       {sql_customer_id('o_custkey')} AS customer_id,
       n_name AS store_name, r_name AS store_location,
       cast(o_orderdate AS TIMESTAMP) AS receipt_datetime,
       cast(CASE WHEN o_orderkey % 10 = 0 THEN weekofyear(o_orderdate)
            ELSE floor(date_diff('day', DATE '1995-01-01', cast(o_orderdate AS DATE)) / 7) END AS INTEGER) AS week_num,
       r.num_items, r.subtotal,
       cast(round(r.subtotal * 0.08, 2) AS DECIMAL(18,2)) AS tax,
       cast(r.subtotal + cast(round(r.subtotal * 0.08, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total_amount,
       CASE WHEN o_orderkey % 10 = 0 THEN 'LLM' ELSE 'Statistical' END AS generator
FROM (SELECT order_key, cast(count(*) AS INTEGER) AS num_items,
             cast(sum(item_total) AS DECIMAL(18,2)) AS subtotal
      FROM priced_lines_fx GROUP BY order_key) r
JOIN orders ON r.order_key = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
""", ["priced_lines_fx"])

view("weekly_fx", """
SELECT generator, customer_id, week_num, cast(sum(total_amount) AS DECIMAL(18,2)) AS weekly_total
FROM receipts_fx
WHERE customer_id IS NOT NULL AND week_num IS NOT NULL AND total_amount IS NOT NULL
  AND generator IN (SELECT generator FROM receipts_fx
                    WHERE customer_id IS NOT NULL AND week_num IS NOT NULL AND total_amount IS NOT NULL
                    GROUP BY generator
                    HAVING min(customer_id) <> max(customer_id) AND min(week_num) <> max(week_num))
GROUP BY generator, customer_id, week_num
""", ["receipts_fx"])

view("avg_weekly_fx", """
SELECT generator, customer_id, count(*) AS n_weeks,
       cast(sum(weekly_total) AS DOUBLE) / count(*) AS avg_weekly
FROM weekly_fx GROUP BY generator, customer_id
""", ["weekly_fx"])

view("features_fx", """
SELECT generator, 'num_items' AS feature, cast(num_items AS DECIMAL(18,2)) AS value FROM receipts_fx
UNION ALL SELECT generator, 'subtotal', cast(subtotal AS DECIMAL(18,2)) FROM receipts_fx
UNION ALL SELECT generator, 'total_amount', cast(total_amount AS DECIMAL(18,2)) FROM receipts_fx
""", ["receipts_fx"])

view("weekdays", """
SELECT * FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
                      (6, 'Saturday'), (7, 'Sunday')) AS d(day_idx, day_of_week)
""")


def sql_topn(source: str, column: str, n: int) -> str:
    return f"""
SELECT generator, {column}, cnt, rank FROM (
  SELECT generator, {column}, count(*) AS cnt,
         cast(row_number() OVER (PARTITION BY generator ORDER BY count(*) DESC, {column} ASC) AS INTEGER) AS rank
  FROM {source} WHERE {column} IS NOT NULL GROUP BY generator, {column}) t
WHERE rank <= {n}"""


def sql_ks_pvalue(d: str, n_a: str, n_b: str) -> str:
    lam = f"({d} * sqrt(cast({n_a} AS DOUBLE) * {n_b} / ({n_a} + {n_b})))"
    series = (f"list_reduce(list_transform(range(1, 101), lambda k: "
              f"(CASE WHEN k % 2 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) * "
              f"exp(CAST(-2 AS DOUBLE) * cast(k * k AS DOUBLE) * {lam} * {lam})), lambda a, x: a + x)")
    return f"(CASE WHEN {lam} < 0.2 THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 2 * {series})) END)"
