"""Item catalog and domains as literal Columns and small DataFrames.

The catalog is a fixed 27-row dimension, so it travels inside the plan as a literal array
(element lookup, no join) or as a tiny broadcast DataFrame; its size never grows with data.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit import constants as K

CATALOG_SCHEMA = T.StructType([
    T.StructField("item_idx", T.IntegerType(), False),
    T.StructField("item_name", T.StringType(), False),
    T.StructField("base_price", T.DecimalType(18, 2), False),
    T.StructField("category", T.StringType(), False),
])


def categories() -> list[str]:
    """Category domain in catalog order."""
    seen: list[str] = []
    for cat, _, _ in K.CATALOG:
        if cat not in seen:
            seen.append(cat)
    return seen


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def catalog_array() -> Column:
    """Literal ``array<struct<item_idx, item_name, base_cents, category>>`` in catalog order
    (one SQL expression)."""
    items = ",".join(
        f"named_struct('item_idx', {i}, 'item_name', {_sql_str(name)}, "
        f"'base_cents', cast({int(Decimal(price) * 100)} as bigint), 'category', {_sql_str(cat)})"
        for i, (cat, name, price) in enumerate(K.CATALOG))
    return F.expr(f"array({items})")


def catalog_categories_array() -> Column:
    """Category of every catalog item, in catalog order (27 entries)."""
    return F.array(*[F.lit(cat) for cat, _, _ in K.CATALOG])


def category_array() -> Column:
    return F.array(*[F.lit(c) for c in categories()])


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def catalog_nested() -> Column:
    """The catalog as a nested map category -> item -> price (the original shape)."""
    by_cat: dict[str, list[tuple[str, str]]] = {}
    for cat, name, price in K.CATALOG:
        by_cat.setdefault(cat, []).append((name, price))
    return F.create_map(*[
        x for cat, items in by_cat.items() for x in (
            F.lit(cat),
            F.create_map(*[y for name, price in items for y in (F.lit(name), F.lit(Decimal(price)).cast("decimal(18,2)"))]),
        )
    ])


def catalog_df(spark: SparkSession) -> DataFrame:
    """Flatten the nested map to ``(item_idx, item_name, base_price, category)``.

    ``explode`` of the outer and inner maps keeps insertion order, so the position is the
    catalog index.
    """
    one = spark.range(1).select(catalog_nested().alias("m"))
    cats = one.select(F.posexplode("m").alias("cat_pos", "category", "items"))
    flat = cats.select("cat_pos", "category", F.posexplode("items").alias("pos", "item_name", "base_price"))
    # item index = items in earlier categories + position inside the category (27 rows, fixed)
    offsets = F.array(*[F.lit(v) for v in _category_offsets()])
    return flat.select(
        (F.element_at(offsets, F.col("cat_pos") + 1) + F.col("pos")).cast("int").alias("item_idx"),
        "item_name", F.col("base_price").cast("decimal(18,2)").alias("base_price"), "category")


def _category_offsets() -> list[int]:
    offsets, n = [], 0
    for cat in categories():
        offsets.append(n)
        n += sum(1 for c, _, _ in K.CATALOG if c == cat)
    return offsets
