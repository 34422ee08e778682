"""Statistical receipt generator.

Plan shape: customer scan -> explode weeks -> keyed Bernoulli filter -> per-receipt draws ->
explode lines -> per-line draws, all as plain column expressions inside whole-stage codegen
(no higher-order lambdas, which Spark interprets row by row). Lines need no shuffle. Receipt
totals are a ``groupBy`` over the lines; the customer keys are hash-partitioned before the
fan-out, so that aggregate runs without an exchange after the explode. Every draw is a pure
function of (seed, customer key, week, purpose): output does not depend on partitioning or
task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions import draws as D
from cohortkit.functions.scalars import MONEY, cents_to_money, hashed_customer_id, tax_of
from cohortkit.sources.catalog import catalog_array, categories, category_array, string_array

HEADER_COLUMNS = ["receipt_id", "customer_id", "store_name", "store_location", "receipt_datetime", "week_num",
                  "num_items", "subtotal", "tax", "total_amount", "generator"]
ITEM_COLUMNS = ["receipt_id", "customer_id", "line_no", "item_name", "category", "quantity", "unit_price",
                "item_total", "generator"]


def customer_ids(customers: DataFrame, key: str = "c_custkey") -> DataFrame:
    """``(cust_key, customer_id)`` with ``customer_id = 'CUST_S_' + sha1(str(key))[:8]``.

    Draws are keyed on the numeric key, not the 8-hex id, which collides at scale.
    """
    return customers.select(F.col(key).alias("cust_key"), hashed_customer_id(F.col(key)).alias("customer_id"))


def customer_week_grid(ids: DataFrame, n_weeks: int = K.N_WEEKS) -> DataFrame:
    """Every customer x week ``0 .. n_weeks-1`` (J1): a generator on the row, no join."""
    return ids.select("cust_key", "customer_id",
                      F.explode(F.sequence(F.lit(0), F.lit(n_weeks - 1))).alias("week_num"))


def keep_draw(seed=K.SEED) -> Column:
    return D.slot(D.key_md5(seed, F.col("cust_key"), F.col("week_num"), "keep"), 0)


def retained(grid: DataFrame, seed=K.SEED, p: float = K.KEEP_PROB) -> DataFrame:
    """Keep each (customer, week) with probability ``p``."""
    return grid.filter(D.bernoulli(keep_draw(seed), p))


def pick_tables() -> Column:
    """For every preferred-category bit mask (0..127), the item index for each draw ``r`` in
    ``0 .. W-1`` where ``W`` is the total weight (R8).

    Built by rule from the catalog: items of a preferred category weigh 3, others 1, so item
    ``j`` owns ``w_j`` consecutive values of ``r``. Masks that are not 1..3 categories map to an
    empty array. A draw is then one array lookup (codegen'd) instead of a search over
    cumulative weights. The literal is written as one SQL expression (one call, not thousands).
    """
    cats = categories()
    item_cats = [cats.index(c) for c, _, _ in K.CATALOG]
    tables = []
    for mask in range(1 << len(cats)):
        chosen = [i for i in range(len(cats)) if mask >> i & 1]
        if not K.PREF_MIN <= len(chosen) <= K.PREF_MAX:
            tables.append("cast(array() as array<int>)")
            continue
        owner = [j for j, ci in enumerate(item_cats) for _ in range(K.PREF_WEIGHT if ci in chosen else 1)]
        tables.append("array(" + ",".join(str(j) for j in owner) + ")")
    return F.expr("array(" + ",".join(tables) + ")")


def _pick_without_replacement(a: Column, b: Column, c: Column, n: int = 7):
    """Three distinct category positions drawn in order without replacement (R6): the first of
    n, the second of the remaining n-1, the third of the remaining n-2 (integer arithmetic)."""
    c1 = (a % n).cast("int")
    t2 = (b % (n - 1)).cast("int")
    c2 = t2 + F.when(t2 >= c1, 1).otherwise(0)
    lo, hi = F.least(c1, c2), F.greatest(c1, c2)
    t3 = (c % (n - 2)).cast("int")
    x = t3 + F.when(t3 >= lo, 1).otherwise(0)
    c3 = x + F.when(x >= hi, 1).otherwise(0)
    return c1, c2, c3


def receipt_draws(kept: DataFrame, start: str = K.START_DATE, seed=K.SEED, carried: list[str] | None = None) -> DataFrame:
    """Per-receipt draws: store, location, day, time, line count, preferred categories and their
    bit mask (R1, R2, R5, R6, R9, C13); ``carried`` columns go along. Plain column expressions only (whole-stage codegen).

    The md5 strings are computed in their own projection and then sliced; Catalyst keeps the
    projections apart because each md5 is read several times, so it runs once per row.
    """
    ck, wk, more = F.col("cust_key"), F.col("week_num"), carried or []
    hashed = kept.select("cust_key", "customer_id", "week_num", *more,
                         D.key_md5(seed, ck, wk, "receipt").alias("_m1"), D.key_md5(seed, ck, wk, "shape").alias("_m2"),
                         D.key_md5(seed, ck, wk, "pref").alias("_m3"))
    slots = hashed.select(
        "cust_key", "customer_id", "week_num", *more,
        *[D.slot(F.col(m), i).alias(f"{m}_{i}") for m in ("_m1", "_m2") for i in range(4)],
        *[D.slot(F.col("_m3"), i).alias(f"_m3_{i}") for i in range(3)])
    day = D.randint(F.col("_m1_2"), 0, 6)
    hour = D.randint(F.col("_m1_3"), 8, 20)
    minute = D.randint(F.col("_m2_0"), 0, 59)
    k = D.randint(F.col("_m2_3"), K.PREF_MIN, K.PREF_MAX)
    c1, c2, c3 = _pick_without_replacement(F.col("_m3_0"), F.col("_m3_1"), F.col("_m3_2"), len(categories()))
    parts = slots.select(
        "cust_key", "customer_id", "week_num", *more,
        D.surrogate_id(K.STAT_RECEIPT_PREFIX, seed, [ck, wk]).alias("receipt_id"),
        D.choice(string_array(K.STORE_NAMES), F.col("_m1_0")).alias("store_name"),
        D.choice(string_array(K.STORE_LOCATIONS), F.col("_m1_1")).alias("store_location"),
        day.alias("day_offset"), hour.alias("hour"), minute.alias("minute"),
        D.normal_int(F.col("_m2_1"), F.col("_m2_2"), K.ITEMS_MEAN, K.ITEMS_SD, 1).alias("num_items"),
        k.alias("k"), c1.alias("c1"), c2.alias("c2"), c3.alias("c3"))
    when = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(
        F.col("week_num") * 7 + F.col("day_offset"), F.col("hour"), F.col("minute"), F.lit(0))
    cats = category_array()
    def bit(c):
        return F.pow(F.lit(2), c).cast("int")

    mask = bit(F.col("c1")) + F.when(F.col("k") >= 2, bit(F.col("c2"))).otherwise(0) \
        + F.when(F.col("k") >= 3, bit(F.col("c3"))).otherwise(0)
    preferred = F.slice(F.array(*[F.element_at(cats, F.col(c) + 1) for c in ("c1", "c2", "c3")]), 1, F.col("k"))
    return parts.select("cust_key", "customer_id", "week_num", *more, "receipt_id", "store_name", "store_location",
                        "day_offset", "hour", "minute", when.alias("receipt_datetime"), "num_items",
                        preferred.alias("preferred"), mask.cast("int").alias("pref_mask"))


def draw_lines(draws: DataFrame, seed=K.SEED) -> DataFrame:
    """One row per receipt line (R3, R8, J2, J5): weighted item draw with replacement, catalog
    lookup by position, quantity 1..3, unit price within ±5 % rounded to cents (integer
    arithmetic). Header columns ride along; every expression is a plain column (codegen)."""
    ck, wk = F.col("cust_key"), F.col("week_num")
    keep = [c for c in draws.columns if c not in ("preferred",)]
    exploded = draws.select(*keep, F.explode(F.sequence(F.lit(1), F.col("num_items"))).alias("line_no"))
    hashed = exploded.select(*keep, "line_no", D.key_md5(seed, ck, wk, "line", F.col("line_no")).alias("_lm"))
    slots = hashed.select(*keep, "line_no", *[D.slot(F.col("_lm"), j).alias(f"_h{j}") for j in range(3)],
                          F.element_at(pick_tables(), F.col("pref_mask") + 1).alias("_table"))
    table = F.col("_table")
    idx = F.element_at(table, (F.col("_h0") % F.size(table)).cast("int") + 1)
    picked = slots.select(
        *keep, "line_no", F.element_at(catalog_array(), idx + 1).alias("_item"),
        D.randint(F.col("_h1"), K.QTY_MIN, K.QTY_MAX).alias("quantity"),
        (F.lit(K.PRICE_PPM_MIN) + F.col("_h2") % F.lit(K.PRICE_PPM_MAX - K.PRICE_PPM_MIN + 1)).alias("_ppm"))
    x = F.col("_item.base_cents") * F.col("_ppm") + F.lit(500_000)
    priced = picked.select(*keep, "line_no", F.col("_item.item_name").alias("item_name"),
                           F.col("_item.category").alias("category"), "quantity",
                           ((x - x % F.lit(1_000_000)) / F.lit(1_000_000)).cast("bigint").alias("unit_cents"))
    total = F.col("quantity").cast("bigint") * F.col("unit_cents")
    return priced.select(*keep, "line_no", "item_name", "category", "quantity",
                         cents_to_money(F.col("unit_cents")).alias("unit_price"),
                         cents_to_money(total).alias("item_total"), total.alias("total_cents"),
                         F.lit("Statistical").alias("generator"))


LINES_PER_PARTITION = 4_000_000


def fanout_partitions(spark: SparkSession, n_keys: int, fanout: float, per_partition: int = LINES_PER_PARTITION) -> int:
    """Partitions for a key set that fans out ``fanout`` rows per key: enough that no task
    produces more than about ``per_partition`` rows, and at least the cluster's parallelism."""
    want = int(n_keys * fanout / per_partition) + 1
    return max(spark.sparkContext.defaultParallelism, want)


def _kept(customers: DataFrame, n_weeks: int, seed, keep_prob: float) -> DataFrame:
    ids = customer_ids(customers)
    spark = customers.sparkSession
    # Each customer becomes ~n_weeks x 15 lines. Hash-partition the customer keys (one small
    # row each) before the fan-out, into a partition count sized by the expected line count:
    # a scan split of keys would otherwise expand into billions of lines in one task. Explode,
    # filter and projections keep this partitioning, so the per-receipt aggregate needs no
    # further exchange; no line is ever shuffled.
    n = fanout_partitions(spark, ids.count(), n_weeks * keep_prob * K.ITEMS_MEAN)
    ids = ids.repartition(n, "cust_key")
    return retained(customer_week_grid(ids, n_weeks), seed, keep_prob)


def statistical_receipts_from(lines: DataFrame, start: str = K.START_DATE, seed=K.SEED, keep_key: bool = False) -> DataFrame:
    """Receipt headers rolled up from their lines (A1). Grouping starts with ``cust_key`` so a
    hash partitioning on it already satisfies the aggregate's distribution."""
    # (cust_key, week_num) is the receipt key, and the header fields are functions of it: they are drawn again per
    # receipt, so the aggregate holds numbers alone (strings among its values would make it sort the lines).
    agg = lines.groupBy("cust_key", "week_num").agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.sum("total_cents").alias("sub_cents"))
    kept = agg.select("cust_key", hashed_customer_id(F.col("cust_key")).alias("customer_id"), "week_num", "n_lines", "sub_cents")
    sub = receipt_draws(kept, start, seed, ["n_lines", "sub_cents"]).withColumn("subtotal", cents_to_money(F.col("sub_cents"))).withColumn(
        "tax", tax_of(F.col("subtotal")))
    return sub.select("receipt_id", "customer_id", "store_name", "store_location", "receipt_datetime", "week_num",
                      F.col("n_lines").alias("num_items"), "subtotal", "tax", (F.col("subtotal") + F.col("tax")).cast(MONEY).alias("total_amount"),
                      F.lit("Statistical").alias("generator"), *([F.col("cust_key").cast("string").alias("customer_key")] if keep_key else []))


def statistical_lines(spark: SparkSession, customers: DataFrame, n_weeks: int = K.N_WEEKS,
                      start: str = K.START_DATE, seed=K.SEED, keep_prob: float = K.KEEP_PROB) -> DataFrame:
    """Line-level frame with header columns."""
    return draw_lines(receipt_draws(_kept(customers, n_weeks, seed, keep_prob), start, seed), seed)


def statistical_receipts(spark: SparkSession, customers: DataFrame, n_weeks: int = K.N_WEEKS,
                         start: str = K.START_DATE, seed=K.SEED, keep_prob: float = K.KEEP_PROB,
                         keep_key: bool = False) -> DataFrame:
    """Receipt headers of the statistical cohort (G1, G2); ``keep_key`` adds ``customer_key`` (as text), since the shown
    ``customer_id`` is a short hash."""
    return statistical_receipts_from(statistical_lines(spark, customers, n_weeks, start, seed, keep_prob), start, seed, keep_key)


def statistical_items(spark: SparkSession, customers: DataFrame, n_weeks: int = K.N_WEEKS,
                      start: str = K.START_DATE, seed=K.SEED, keep_prob: float = K.KEEP_PROB) -> DataFrame:
    """Receipt lines of the statistical cohort: the only exchange is the key repartition."""
    return statistical_lines(spark, customers, n_weeks, start, seed, keep_prob).select(*ITEM_COLUMNS)


def generate_statistical(spark: SparkSession, customers: DataFrame, n_weeks: int = K.N_WEEKS,
                         start: str = K.START_DATE, seed=K.SEED) -> tuple[DataFrame, DataFrame]:
    """``(receipts, items)`` of the statistical cohort."""
    return (statistical_receipts(spark, customers, n_weeks, start, seed),
            statistical_items(spark, customers, n_weeks, start, seed))
