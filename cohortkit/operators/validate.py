"""Bulk validation of model-written receipts.

Every response is parsed once into a VARIANT and checked with native expressions; the first
failing rule (in the original order) becomes the ``reason``:

  empty_content -> bad_json -> not_an_object -> missing_keys -> no_items -> no_valid_items
  -> bad_datetime -> amount_overflow

A line whose quantity x price does not fit the money type is not valid (``amount_overflow``), nor is a
receipt whose sums do not: no response can abort the job, and every output agrees on it.

Lines are validated inside the row: the item array is decoded natively (per element and per
field) and a light ``transform`` combines the checks, so totals need no shuffle and raw text is
never moved between tasks. Typed ``from_json`` is not
used: it nulls a quoted number and a whole array for one bad element, both of which the
original accepts or skips line by line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.functions.scalars import MONEY, coerce_datetime, iso_week, strip_fences, tax_of
from cohortkit.operators.ranking import ranked
from cohortkit.session import materialize

REASONS = ["empty_content", "bad_json", "not_an_object", "missing_keys", "no_items", "no_valid_items",
           "bad_datetime", "amount_overflow"]


def _vget(v: Column, typ: str) -> Column:
    return F.try_variant_get(v, "$", typ)


def _as_struct(keys: list[str]) -> str:
    """Struct type with one VARIANT field per key: casting an object to it yields SQL NULL for a
    missing key and a variant null for a JSON null; a non-object yields NULL."""
    return "struct<" + ",".join(f"{k}:variant" for k in keys) + ">"


def _all_present(st: Column, keys: list[str]) -> Column:
    cond = st.isNotNull()
    for k in keys:
        cond = cond & st[k].isNotNull()
    return F.coalesce(cond, F.lit(False))


WIDE = "decimal(28,2)"  # amounts as declared; sums and products that fit MONEY are kept
LINE_TYPES = f"array<struct<item_name:string,category:string,quantity:bigint,unit_price:{WIDE},item_total:{WIDE}>>"


def _fits(c: Column) -> Column:
    """The amount as MONEY, NULL where it does not fit."""
    return c.try_cast(MONEY)


def _py_text(v: Column, text: Column) -> Column:
    """``str(x)`` of a JSON value (C7): ``True``/``False``, ``None``, and numbers with a fraction part keep one
    (``1.0``); other values as their JSON text."""
    kind = F.schema_of_variant(v)
    return (F.when(text.isNull(), F.lit("None"))
            .when(kind == "BOOLEAN", F.when(text == "true", F.lit("True")).otherwise(F.lit("False")))
            .when((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & ~F.contains(text, F.lit(".")), F.concat(text, F.lit(".0")))
            .otherwise(text))


def _check_line(z: Column, i: Column) -> Column:
    """One line from its two native decodings: ``_pres`` (every key as VARIANT: NULL when the
    key is missing) and ``_typed`` (int, decimal, decimal, strings: NULL when a value does not
    convert). Structure first (object with the 5 keys), then types (P7, P8)."""
    pres, typed = z["_pres"], z["_typed"]
    shaped = _all_present(pres, K.ITEM_KEYS)
    ok_types = typed["quantity"].isNotNull() & typed["unit_price"].isNotNull() & typed["item_total"].isNotNull()
    total = _fits(F.try_multiply(typed["quantity"].cast("decimal(19,0)"), typed["unit_price"]))
    return F.struct(
        i.alias("pos"),
        F.when(~shaped, F.lit("bad_structure")).when(~ok_types, F.lit("bad_types"))
        .when(total.isNull() | _fits(typed["unit_price"]).isNull() | _fits(typed["item_total"]).isNull(),
              F.lit("amount_overflow")).alias("problem"),
        _py_text(pres["item_name"], typed["item_name"]).alias("item_name"),
        _py_text(pres["category"], typed["category"]).alias("category"),
        typed["quantity"].alias("quantity"), _fits(typed["unit_price"]).alias("unit_price"),
        _fits(typed["item_total"]).alias("declared_total"), total.alias("line_total"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """``(attempt, raw)`` -> one row per attempt with ``reason`` (NULL when accepted), the
    recomputed header fields and the checked line array ``lines``."""
    # Each of these steps is read twice by the next one, so Catalyst keeps them apart and each runs once per row.
    clean = responses.select("attempt", strip_fences(F.col("raw")).alias("_clean"))
    # Wrapping in [...] makes trailing text or a second object a parse error (Q23).
    wrapped = clean.select("attempt", (F.length("_clean") == 0).alias("_empty"), _vget(
        F.try_parse_json(F.concat(F.lit("["), F.col("_clean"), F.lit("]"))), "array<variant>").alias("_all"))
    stage1 = wrapped.select("attempt", "_empty", F.when(F.size("_all") == 1, F.element_at("_all", 1)).alias("_v"))
    stage2 = stage1.select("attempt", "_empty", F.col("_v").isNull().alias("_bad_json"),
                           _vget(F.col("_v"), _as_struct(K.RECEIPT_KEYS)).alias("_obj"))
    o = F.col("_obj")
    # The item array is decoded natively, element by element and field by field, twice: all
    # keys as VARIANT (presence) and typed (conversion). A non-array gives NULL (no_items).
    decoded = stage2.select(
        "attempt", "_empty", "_bad_json", "_obj",
        _vget(o["items"], "array<" + _as_struct(K.ITEM_KEYS) + ">").alias("_pres"),
        _vget(o["items"], LINE_TYPES).alias("_typed"))
    stage3 = decoded.select(
        "attempt", "_empty", "_bad_json", "_obj",
        _all_present(o, K.RECEIPT_KEYS).alias("_has_keys"),
        F.transform(F.arrays_zip("_pres", "_typed"), _check_line).alias("lines"))
    valid = F.filter("lines", lambda l: l["problem"].isNull())
    stage4 = stage3.withColumn("_valid", valid)
    amount = F.aggregate("_valid", F.lit(0).cast(WIDE), lambda a, l: F.try_add(a, l["line_total"]).try_cast(WIDE))
    ts = coerce_datetime(_vget(o["receipt_datetime"], "string"))
    stage5 = stage4.select(
        "attempt", "_empty", "_bad_json", "_obj", "_has_keys", "lines", "_valid",
        F.size("_valid").alias("n_valid_lines"), _fits(amount).alias("_subtotal"), ts.alias("receipt_datetime"))
    subtotal = F.col("_subtotal")
    reason = (F.when(F.col("_empty"), F.lit("empty_content"))
              .when(F.col("_bad_json"), F.lit("bad_json"))
              .when(F.col("_obj").isNull(), F.lit("not_an_object"))
              .when(~F.col("_has_keys"), F.lit("missing_keys"))
              .when(F.coalesce(F.size("lines"), F.lit(0)) <= 0, F.lit("no_items"))
              .when(F.col("n_valid_lines") == 0, F.lit("no_valid_items"))
              .when(F.col("receipt_datetime").isNull(), F.lit("bad_datetime"))
              .when(_fits(F.try_add(subtotal, tax_of(subtotal))).isNull(), F.lit("amount_overflow")))
    checked = stage5.select("*", reason.alias("reason"))
    # Named metrics (attempts seen, accepted) per validation run. They also fence the plan:
    # filters on `reason` stay above this node instead of being rewritten into copies of the
    # whole parse-and-check expression below it.
    checked = checked.observe(f"response_validation_{uuid.uuid4().hex[:12]}",
                              F.count(F.lit(1)).alias("n_attempts"),
                              F.count_if(F.col("reason").isNull()).alias("n_accepted"))
    return checked.select(
        "attempt", "reason",
        F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"), "n_valid_lines",
        _vget(o["receipt_id"], "string").alias("receipt_id"),
        _vget(o["customer_id"], "string").alias("customer_id"),
        _vget(o["store_name"], "string").alias("store_name"),
        _vget(o["store_location"], "string").alias("store_location"),
        "receipt_datetime", subtotal.alias("subtotal"), "lines")


def validation_outcome(parsed: DataFrame) -> DataFrame:
    """Per attempt: accepted flag and first failing rule."""
    return parsed.select("attempt", "reason", F.col("reason").isNull().alias("accepted"), "n_lines", "n_valid_lines")


def accepted_receipts(parsed: DataFrame) -> DataFrame:
    """Validated receipt headers with recomputed totals."""
    ok = parsed.filter(F.col("reason").isNull())
    tax = tax_of(F.col("subtotal"))
    return ok.select(
        "attempt", "receipt_id", "customer_id", "store_name", "store_location", "receipt_datetime",
        iso_week(F.col("receipt_datetime")).alias("week_num"),
        F.col("n_valid_lines").cast("int").alias("num_items"),
        "subtotal", tax.alias("tax"), (F.col("subtotal") + tax).cast(MONEY).alias("total_amount"),
        F.lit("LLM").alias("generator"))


def _accepted_lines(parsed: DataFrame) -> DataFrame:
    ok = parsed.filter(F.col("reason").isNull())
    return ok.select("attempt", "receipt_id", "customer_id", F.inline_outer("lines")) \
        .filter(F.col("problem").isNull())


def accepted_items(parsed: DataFrame) -> DataFrame:
    """Surviving lines of accepted receipts, item total recomputed as quantity x unit price (Q4, Q5)."""
    return _accepted_lines(parsed).select(
        "attempt", "pos", "receipt_id", "customer_id", "item_name", "category", "quantity", "unit_price",
        F.col("line_total").alias("item_total"), F.lit("LLM").alias("generator"))


def item_total_audit(parsed: DataFrame) -> DataFrame:
    """Declared versus recomputed line total on accepted lines; mismatch above 0.01."""
    it = _accepted_lines(parsed)
    recomputed = F.col("line_total")
    return it.select("attempt", "pos", "declared_total", recomputed.alias("item_total"),
                     (F.abs(recomputed - F.col("declared_total")) > F.lit(0.01)).alias("item_total_mismatch"))


def line_checks(parsed: DataFrame) -> DataFrame:
    """Every line of every response that has an item array, with its problem."""
    return parsed.select("attempt", F.inline_outer("lines")).filter(F.col("pos").isNotNull()).select(
        "attempt", "pos", F.col("problem").isNull().alias("valid"), "problem")


def reject_summary(parsed: DataFrame) -> DataFrame:
    """Rejected attempts per reason."""
    return parsed.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_attempts"))


def first_n_accepted(parsed: DataFrame, n) -> DataFrame:
    """First ``n`` accepted receipts in attempt order among attempts ``1 .. 3n``.

    ``n`` is an int or a scalar Column.
    """
    n = F.lit(n) if isinstance(n, int) else n
    budget = n * K.MAX_ATTEMPTS_PER_RECEIPT
    # validated headers within the budget: read by the count and the ranking
    acc = materialize(accepted_receipts(parsed.filter(F.col("attempt") <= budget)), of=parsed)
    return ranked(acc, "attempt", "accept_rank").filter(F.col("accept_rank") <= n)


def first_n_items(first: DataFrame, parsed: DataFrame) -> DataFrame:
    """Lines of the first-n receipts (G4): the accepted lines of their attempts."""
    return accepted_items(parsed).join(first.select("attempt"), "attempt", "left_semi")


def attempt_summary(parsed: DataFrame, n) -> DataFrame:
    """Target, attempt budget, attempts consumed and accepted count of the first-n loop.

    Attempts consumed: up to the attempt of the n-th acceptance, else all attempts within the
    budget (``attempt`` numbers the tries from 1).
    """
    n = F.lit(n) if isinstance(n, int) else n
    budget = n * K.MAX_ATTEMPTS_PER_RECEIPT
    # (attempt, accepted) is all the loop needs: parse once, keep two columns
    out = materialize(parsed.select("attempt", F.col("reason").isNull().alias("ok")), of=parsed)
    acc = out.filter(F.col("ok") & (F.col("attempt") <= budget))
    firsts = ranked(acc, "attempt", "accept_rank").filter(F.col("accept_rank") <= n)
    # one row, read by two scalar subqueries: computed once
    stats = materialize(firsts.agg(F.count(F.lit(1)).alias("n_accepted"),
                                   F.max(F.when(F.col("accept_rank") == n, F.col("attempt"))).alias("nth")))
    nth = stats.select("nth").scalar()
    stop = F.coalesce(nth, budget)
    used = out.filter(F.col("attempt") <= stop).agg(F.count(F.lit(1)).alias("attempts_used"))
    return used.select(n.cast("bigint").alias("target"), budget.cast("bigint").alias("max_attempts"),
                       "attempts_used", stats.select("n_accepted").scalar().alias("n_accepted"))
