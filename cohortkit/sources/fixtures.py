"""Driver tables mapped onto the receipt / line / response / page shapes (FIXTURES.md §2).

``items_fx``   lineitem ⋈ part ⋈ orders, one row per order line.
``receipts_fx`` roll-up of the lines per order ⋈ orders ⋈ customer ⋈ nation ⋈ region.

Cohort: ``LLM`` when ``o_orderkey % 10 = 0`` else ``Statistical`` (uneven cohorts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.functions.scalars import MONEY, cents_to_money, hashed_customer_id, tax_of
from cohortkit.sources.tables import load

WEEK_EPOCH = "1995-01-01"


def cents_of_double(c: Column) -> Column:
    """Round a binary double to whole cents as ``floor(x*100 + 0.5)``: the same IEEE steps in
    every engine, unlike decimal casts of doubles, which differ between engines on halves."""
    return F.floor(c * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def cohort_of(orderkey: Column) -> Column:
    return F.when(orderkey % 10 == 0, F.lit("LLM")).otherwise(F.lit("Statistical"))


def joined(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Inner join of two tables that grow with the input, by sorted shuffles: a broadcast would hold one of them whole in
    the driver, and the size by which Spark decides is that of compressed files."""
    return left.join(right.hint("merge"), on)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


def _priced_lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Order lines with their part and amounts, also in whole cents; ``lines``: of :func:`_lines`, with further columns, which are kept."""
    lines = _lines(spark, sf_dir) if lines is None else lines
    part = load(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_retailprice")
    j = joined(lines, part, F.col("l_partkey") == F.col("p_partkey"))
    qty = F.col("l_quantity").cast("int")
    unit_cents = cents_of_double(F.col("p_retailprice"))
    total_cents = qty.cast("bigint") * unit_cents
    declared_cents = cents_of_double(F.col("l_extendedprice"))
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("category"),
        qty.alias("quantity"),
        unit_cents.alias("unit_cents"), total_cents.alias("total_cents"), declared_cents.alias("declared_cents"),
        cents_to_money(unit_cents).alias("unit_price"),
        cents_to_money(total_cents).alias("item_total"),
        cents_to_money(declared_cents).alias("declared_total"),
        *[c for c in lines.columns if not c.startswith("l_")],
    )


def items_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the receipt-line shape, with ``generator`` and ``declared_total``."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    # the orders first, so that no names and types of parts are shuffled
    j = _priced_lines(spark, sf_dir, joined(_lines(spark, sf_dir), orders, F.col("l_orderkey") == F.col("o_orderkey")))
    return j.select(
        F.concat(F.lit("ORD_"), F.col("order_key").cast("string")).alias("receipt_id"),
        hashed_customer_id(F.col("o_custkey")).alias("customer_id"),
        "item_name", "category", "quantity", "unit_price", "item_total", "declared_total",
        cohort_of(F.col("order_key")).alias("generator"),
    )


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation and region of their customer."""
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = load(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast is size-proven.
    geo = F.broadcast(load(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
                      .join(F.broadcast(load(spark, sf_dir, "region", "r_regionkey", "r_name")),
                            F.col("n_regionkey") == F.col("r_regionkey")))
    return joined(orders, customer, F.col("o_custkey") == F.col("c_custkey")).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))


def receipts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per order that has lines (inner roll-up, A1)."""
    lines = _priced_lines(spark, sf_dir)
    # Pre-aggregate lines per order before joining the header tables: the join then sees one
    # row per order instead of one per line.
    roll = lines.groupBy("order_key").agg(
        F.count(F.lit(1)).cast("int").alias("num_items"),
        cents_to_money(F.sum("total_cents")).alias("subtotal"),
    )
    hdr = joined(roll, _headers(spark, sf_dir), F.col("order_key") == F.col("o_orderkey"))
    gen = cohort_of(F.col("order_key"))
    subtotal = F.col("subtotal")
    tax = tax_of(subtotal)
    week = F.when(gen == "LLM", F.weekofyear("o_orderdate")).otherwise(
        F.floor(F.datediff(F.to_date("o_orderdate"), F.lit(WEEK_EPOCH).cast("date")) / 7).cast("int"))
    return hdr.select(
        F.concat(F.lit("ORD_"), F.col("order_key").cast("string")).alias("receipt_id"),
        hashed_customer_id(F.col("o_custkey")).alias("customer_id"),
        F.col("o_custkey").alias("customer_key"),
        F.col("n_name").alias("store_name"),
        F.col("r_name").alias("store_location"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("receipt_datetime"),
        week.cast("int").alias("week_num"),
        "num_items",
        subtotal.alias("subtotal"),
        tax.alias("tax"),
        (subtotal + tax).cast(MONEY).alias("total_amount"),
        gen.alias("generator"),
    )


# ---- model responses (FIXTURES.md §3 classes, residue o_orderkey % 20) ------------------------

def _jstr(c: Column) -> Column:
    """JSON text of a string value (``null`` for NULL), escaped by Spark's JSON writer."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _money_text(cents: Column) -> Column:
    """Whole cents as the text of a decimal with two places."""
    size = F.abs(cents)
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), F.call_function("div", size, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((size % 100).cast("string"), 2, "0"))


def _pair(key: str, value_json: Column) -> Column:
    return F.concat(F.lit(f'"{key}": '), value_json)


QTY_VARIANTS = ['"2"', '" 2 "', "2.9", "true"]   # class 10, cycled by line position


def responses_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw model response per order that has lines: ``(attempt, raw, damage)``.

    The clean text is the order as a receipt object, lines ordered by all their columns;
    ``o_orderkey % 20`` selects one damage class of FIXTURES.md §3 (first variant of each).
    Lines are numbered by a window partitioned by order, each line's JSON is plain string
    expressions, and a window over the same order lists the texts, so an order's lines are sorted once;
    the headers are put together before they meet them, so no text is shuffled.
    """
    lines = _priced_lines(spark, sf_dir)
    order = ["item_name", "category", "quantity", "unit_cents", "declared_cents"]
    w = Window.partitionBy("order_key").orderBy(*order)
    numbered = lines.select("order_key", *order, "total_cents", (F.row_number().over(w) - 1).cast("int").alias("pos"))
    cls = (F.col("order_key") % 20).cast("int")
    i = F.col("pos")
    sub19 = F.when(cls == 19, F.floor(F.col("order_key") / 20) % 4)  # 0 huge quantity, 1 huge product, 2 odd names
    q = (F.when((sub19 == 0) & (i == 0), F.lit("3000000000"))
         .when((sub19 == 1) & (i == 0), F.lit("2000000000"))
         .when((cls == 5) & (i == 0), F.lit('"two"'))
         .when(cls == 10, F.element_at(F.array(*[F.lit(v) for v in QTY_VARIANTS]), (i % 4 + 1).cast("int")))
         .when(cls == 11, F.lit('"2.9"'))
         .when(cls == 15, F.lit("99"))
         .when(cls == 17, F.lit('"x"'))
         .otherwise(F.col("quantity").cast("string")))
    price = F.when(cls == 15, F.lit("900.00")).when((sub19 == 1) & (i == 0), F.lit("99999999999.99")) \
        .when((sub19 == 0) & (i == 0), F.lit("0.01")).otherwise(_money_text(F.col("unit_cents")))
    total = _money_text(F.col("declared_cents") + F.when(cls == 12, 2).otherwise(0))
    cat = F.when(cls == 14, F.lit("null")).when((cls == 16) & (i == 0), F.lit(None)).otherwise(_jstr(F.col("category")))
    name = (F.when((sub19 == 2) & (i == 0), F.lit("true")).when((sub19 == 2) & (i == 1), F.lit("1.0"))
            .when((sub19 == 2) & (i == 2), F.lit("7")).otherwise(_jstr(F.col("item_name"))))
    line_json = F.concat(F.lit("{"), F.concat_ws(
        ", ", _pair("item_name", name), F.when(cat.isNotNull(), _pair("category", cat)),
        _pair("quantity", q), _pair("unit_price", price), _pair("item_total", total)), F.lit("}"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_order = numbered.select("order_key", *order, "total_cents", "pos", line_json.alias("j")).select(
        "order_key", "pos", F.collect_list("j").over(whole).alias("item_texts"), F.sum("total_cents").over(whole).alias("sub_cents"),
    ).where("pos = 0").select("order_key", "item_texts", cents_to_money(F.col("sub_cents")).alias("subtotal"))
    o = joined(per_order, _headers(spark, sf_dir), F.col("order_key") == F.col("o_orderkey"))
    item_texts = F.col("item_texts")
    items = (F.when(cls == 4, F.lit("[]"))
             .when(cls == 7, F.element_at(item_texts, 1))
             .otherwise(F.concat(F.lit("["), F.array_join(item_texts, ", "), F.lit("]"))))
    ts = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    dt = (F.when(cls.isin(6, 17), F.lit('"soon"')).when(cls == 9, F.lit("null"))
          .when(cls == 18, _jstr(F.concat(ts, F.lit("+05:00")))).otherwise(_jstr(ts)))
    subtotal = F.col("subtotal")
    tax = tax_of(subtotal)
    bump = F.lit(1).cast("decimal(3,2)")
    obj = F.concat(F.lit("{"), F.concat_ws(
        ", ",
        _pair("receipt_id", F.when(cls == 14, F.lit("null"))
              .otherwise(_jstr(F.concat(F.lit("ORD_"), F.col("order_key").cast("string"))))),
        _pair("customer_id", _jstr(hashed_customer_id(F.col("o_custkey")))),
        _pair("store_name", _jstr(F.when(cls == 15, F.lit("Nowhere Market")).otherwise(F.col("n_name")))),
        _pair("store_location", _jstr(F.col("r_name"))),
        _pair("receipt_datetime", dt),
        _pair("items", items),
        _pair("subtotal", F.when(cls == 13, (subtotal + bump).cast(MONEY)).otherwise(subtotal).cast("string")),
        F.when(cls != 3, _pair("tax", F.when(cls == 13, (tax + bump).cast(MONEY)).otherwise(tax).cast("string"))),
        _pair("total_amount", (subtotal + tax).cast(MONEY).cast("string"))), F.lit("}"))
    # the object is written once: as a branch each, its code would be too long to be compiled
    before = F.when(cls == 0, F.lit("```json\n")).when(cls == 8, F.lit("[")).otherwise(F.lit(""))
    after = F.when(cls == 0, F.lit("\n```")).when(cls == 8, F.lit("]")).otherwise(F.lit(""))
    raw = (F.when(cls == 1, F.lit(""))
           .when(cls == 2, F.lit("Sorry, I cannot produce that receipt."))
           .otherwise(F.concat(before, obj, after)))
    return o.select((F.col("order_key") + 1).alias("attempt"), raw.alias("raw"), cls.alias("damage"))


# ---- page responses (FIXTURES.md §2: page_id % 7 = 0 no summary, 1 '{}', 2 broken JSON) ----

TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"


def page_type_draw(key: Column, seed=42) -> Column:
    """Uniform page type per key."""
    from cohortkit import constants as K
    from cohortkit.functions import draws as D
    return D.choice(F.array(*[F.lit(t) for t in K.PAGE_TYPES]), D.slot(D.key_md5(seed, key, "page_type"), 0))


def page_responses_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, page_type, raw)``: each page as a generated ``{html, summary}`` response."""
    pages = load(spark, sf_dir, "pages", "page_id", "html")
    title = F.regexp_extract("html", TITLE_PATTERN, 1)
    cls = (F.col("page_id") % 7).cast("int")
    even = F.floor(F.col("page_id") / 7) % 10 == 0  # every tenth of a class: text after the object, empty results
    full = F.to_json(F.struct("html", title.alias("summary")))
    raw = (F.when(cls == 0, F.to_json(F.struct("html")))
           .when(cls == 1, F.lit("{}"))
           .when(cls == 2, F.lit('{"html": "<p>unterminated'))
           .when((cls == 3) & even, F.concat(full, F.lit(" and that is the page.")))
           .when((cls == 4) & even, F.lit("[]"))
           .when((cls == 5) & even, F.lit("null"))
           .when((cls == 6) & even, F.concat(full, full))
           .otherwise(full))
    return pages.select(F.col("page_id").alias("sample_id"), page_type_draw(F.col("page_id")).alias("page_type"),
                        raw.alias("raw"))
