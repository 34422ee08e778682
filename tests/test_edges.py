"""Hand-made edge tables (FIXTURES.md §3): one row per rule and quirk, expected result by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import validate as V

ITEM = '{"item_name": "Milk", "category": "Dairy", "quantity": %s, "unit_price": 3.55, "item_total": 3.55}'


def receipt(items=None, dt='"2025-04-07T15:30:00"', drop=None, extra=""):
    items = items if items is not None else "[" + ITEM % "1" + "]"
    keys = {"receipt_id": '"LLM_1"', "customer_id": '"CUST_L_1"', "store_name": '"MegaMart"',
            "store_location": '"Downtown"', "receipt_datetime": dt, "items": items, "subtotal": "3.55",
            "tax": "0.28", "total_amount": "3.83"}
    if drop:
        keys.pop(drop)
    return "{" + ", ".join(f'"{k}": {v}' for k, v in keys.items()) + extra + "}"


EDGE = [
    (1, "```json\n" + receipt() + "\n```", None),
    (2, "", "empty_content"),
    (3, "   \n\t ", "empty_content"),
    (4, "```json```", "empty_content"),
    (5, "not json at all", "bad_json"),
    (6, receipt() + " trailing words", "bad_json"),
    (7, receipt() + receipt(), "bad_json"),
    (8, receipt(drop="tax"), "missing_keys"),
    (9, receipt(items="[]"), "no_items"),
    (10, receipt(items="[" + ITEM % '"two"' + ", " + ITEM % "2" + "]"), None),
    (11, receipt(dt='"soon"'), "bad_datetime"),
    (12, receipt(dt='"2025-13-07T10:00:00"'), "bad_datetime"),
    (13, receipt(items=ITEM % "1"), "no_items"),
    (14, "[" + receipt() + "]", "not_an_object"),
    (15, receipt(dt="null"), "bad_datetime"),
    (16, receipt(items="[" + ", ".join(ITEM % q for q in ['"2"', '" 2 "', "2.9", "true"]) + "]"), None),
    (17, receipt(items="[" + ITEM % '"2.9"' + "]"), "no_valid_items"),
    (18, receipt(items="[" + ITEM % '"x"' + "]", dt='"soon"'), "no_valid_items"),
    (19, receipt(dt='"2025-04-07T15:30:00+05:00"'), None),
    (20, receipt(dt='"2025-04-07T15:30:00Z"'), None),
    (21, receipt(), None),
    (22, receipt(dt='"April 7, 2025"'), "bad_datetime"),
    (23, receipt(dt='"12345"'), "bad_datetime"),
    (24, '{"a": NaN}', "bad_json"),
    (25, receipt(items="[" + '{"item_name": "Milk", "quantity": 1, "unit_price": 1.0, "item_total": 1.0}' + ", "
                 + ITEM % "1" + "]"), None),
    (26, receipt(extra=', "tax": 9.99'), None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(a, r) for a, r, _ in EDGE], "attempt long, raw string")
    return V.parse_responses(df).cache()


def test_reasons(parsed):
    got = {r["attempt"]: r["reason"] for r in V.validation_outcome(parsed).collect()}
    assert got == {a: e for a, _, e in EDGE}


def test_quantity_coercion(parsed):
    items = {(r["attempt"], r["pos"]): r["quantity"] for r in V.accepted_items(parsed).collect()}
    assert [items[(16, i)] for i in range(4)] == [2, 2, 2, 1]
    # invalid first line dropped, totals over the rest (Q4)
    assert (10, 0) not in items and items[(10, 1)] == 2
    rec = {r["attempt"]: r for r in V.accepted_receipts(parsed).collect()}
    assert rec[10]["num_items"] == 1 and rec[10]["subtotal"] == Decimal("7.10")
    assert rec[10]["tax"] == Decimal("0.57") and rec[10]["total_amount"] == Decimal("7.67")


def test_wall_clock_kept(parsed):
    rec = {r["attempt"]: r for r in V.accepted_receipts(parsed).collect()}
    assert str(rec[19]["receipt_datetime"]) == "2025-04-07 15:30:00"
    assert str(rec[20]["receipt_datetime"]) == "2025-04-07 15:30:00"
    assert rec[21]["week_num"] == 15


def test_conservation(parsed):
    out = V.validation_outcome(parsed)
    assert out.count() == len(EDGE)
    acc = out.filter("accepted").count()
    assert acc + out.filter("not accepted").count() == len(EDGE)


def test_audit_flags(spark):
    raw = receipt(items='[{"item_name": "A", "category": "C", "quantity": 2, "unit_price": 1.25, "item_total": 2.52}, '
                        '{"item_name": "B", "category": null, "quantity": 1, "unit_price": 1.00, "item_total": 1.00}]')
    p = V.parse_responses(spark.createDataFrame([(1, raw)], "attempt long, raw string"))
    a = {r["pos"]: r["item_total_mismatch"] for r in V.item_total_audit(p).collect()}
    assert a == {0: True, 1: False}
    cats = {r["pos"]: r["category"] for r in V.accepted_items(p).collect()}
    assert cats[1] == "None"


def test_ks_known(spark):
    from cohortkit.operators.fidelity import ks_statistic
    rows = [("Statistical", v) for v in (1, 2, 3, 4)] + [("LLM", v) for v in (3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "generator string, num_items int").select(
        "generator", "num_items", F.col("num_items").cast("decimal(18,2)").alias("subtotal"),
        F.lit(None).cast("decimal(18,2)").alias("total_amount"))
    for rows_per_part in (1, 3, 100):
        ks = {r["feature"]: r for r in ks_statistic(spark, df, rows_per_part=rows_per_part).collect()}
        assert ks["num_items"]["d"] == 0.5 and ks["subtotal"]["d"] == 0.5
        assert ks["total_amount"]["status"] == "missing"
    same = spark.createDataFrame([(g, v) for g in ("Statistical", "LLM") for v in range(10)], "generator string, num_items int")
    same = same.select("*", F.col("num_items").cast("decimal(18,2)").alias("subtotal"),
                       F.col("num_items").cast("decimal(18,2)").alias("total_amount"))
    r = ks_statistic(spark, same).collect()
    assert all(x["d"] == 0.0 and x["p_value"] == 1.0 for x in r)


def test_ks_not_enough_points(spark):
    from cohortkit.operators.fidelity import ks_statistic
    df = spark.createDataFrame([("Statistical", 1), ("Statistical", 2), ("LLM", 3)], "generator string, num_items int")
    df = df.select("*", F.col("num_items").cast("decimal(18,2)").alias("subtotal"),
                   F.col("num_items").cast("decimal(18,2)").alias("total_amount"))
    assert {r["status"] for r in ks_statistic(spark, df).collect()} == {"not_enough_points"}


def test_ks_pvalue_series(spark):
    from cohortkit.operators.fidelity import ks_pvalue
    df = spark.createDataFrame([(1.0, 1, 1)], "d double, a bigint, b bigint")
    # lambda = D * sqrt(a*b/(a+b)) = sqrt(1/2); Q(1) is a known constant
    df = spark.createDataFrame([(1.0 / (0.5 ** 0.5), 1, 1)], "d double, a bigint, b bigint")
    p = df.select(ks_pvalue(F.col("d"), F.col("a"), F.col("b")).alias("p")).first()["p"]
    assert abs(p - 0.26999967167735456) < 1e-12


def test_weekday_gap(spark):
    from cohortkit.operators.utility import day_of_week
    df = spark.createDataFrame([("Statistical", "2025-01-06 10:00:00"), ("Statistical", "2025-01-10 10:00:00"),
                                ("Statistical", None)], "generator string, receipt_datetime string") \
        .withColumn("receipt_datetime", F.col("receipt_datetime").cast("timestamp_ntz"))
    rows = sorted((r["day_idx"], r["day_of_week"], r["n_receipts"]) for r in day_of_week(spark, df).collect())
    assert rows[0] == (1, "Monday", 1) and rows[4] == (5, "Friday", 1)
    assert [r[2] for r in rows] == [1, 0, 0, 0, 1, 0, 0]


def test_uniqueness(spark):
    from cohortkit.operators.privacy import uniqueness
    rows = [("Statistical", f"R{i}", i, i % 96, i % 95, i % 11, None if i % 2 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "generator string, receipt_id string, c100 int, c96 int, c95 int, c11 int, cnull int")
    got = {r["column_name"]: r["flagged"] for r in uniqueness(df).collect()}
    assert got == {"c100": True, "c96": True, "c95": False, "c11": False, "cnull": False}
    small = spark.createDataFrame([("LLM", f"R{i}", i) for i in range(10)], "generator string, receipt_id string, c int")
    assert [r["flagged"] for r in uniqueness(small).collect()] == [False]


def test_topn_ties(spark):
    from cohortkit.operators.utility import top_n, value_counts
    df = spark.createDataFrame([("Statistical", n) for n in ["b", "a", "c", "c"]], "generator string, item_name string")
    got = [r["item_name"] for r in top_n(value_counts(df, "item_name"), "item_name", 2).orderBy("rank").collect()]
    assert got == ["c", "a"]


@pytest.mark.parametrize("n,expected", [(2, 1), (4, 1), (5, 1), (10, 2), (11, 3)])
def test_split_sizes(spark, n, expected):
    from cohortkit.operators.textprep import split_exact
    df = spark.range(n).withColumnRenamed("id", "sample_id")
    assert split_exact(df).filter("is_test").count() == expected


def test_encode_len(spark):
    from cohortkit.operators.textprep import encode, vocabulary
    texts = [(i, 0, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([0, 1, 510, 511, 600])]
    df = spark.createDataFrame(texts, "sample_id long, label int, combined string")
    out = {r["sample_id"]: r for r in encode(df, vocabulary(df)).collect()}
    assert all(len(r["input_ids"]) == 512 and len(r["attention_mask"]) == 512 for r in out.values())
    assert out[0]["input_ids"][:3] == [2, 3, 0] and sum(out[0]["attention_mask"]) == 2
    assert sum(out[4]["attention_mask"]) == 512 and out[4]["input_ids"][511] == 3


def test_labels_unknown(spark):
    from cohortkit.operators.pages import label_encode
    df = spark.createDataFrame([(1, "commercial"), (2, "blog")], "sample_id long, page_type string")
    got = {r["sample_id"]: (r["label"], r["reason"]) for r in label_encode(df).collect()}
    assert got == {1: (2, None), 2: (None, "unknown_page_type")}
    with pytest.raises(Exception):
        label_encode(df, strict=True).collect()


def test_rounding(spark):
    from cohortkit.functions.scalars import tax_of
    df = spark.createDataFrame([(Decimal(x),) for x in ("2.675", "1.005", "0.125", "2.665")], "v decimal(18,3)")
    got = [r[0] for r in df.select(F.round("v", 2)).collect()]
    assert got == [Decimal("2.68"), Decimal("1.01"), Decimal("0.13"), Decimal("2.67")]
    t = spark.createDataFrame([(Decimal("6.35"),)], "s decimal(18,2)").select(tax_of(F.col("s"))).first()[0]
    assert t == Decimal("0.51")


def test_strip_fences(spark):
    from cohortkit.functions.scalars import strip_fences
    df = spark.createDataFrame([("```json\n{}\n```",), ("  {} \t",), ("json{}n",)], "s string")
    assert [r[0] for r in df.select(strip_fences(F.col("s"))).collect()] == ["{}", "{}", "{}"]


def test_page_validation(spark):
    from cohortkit.operators.pages import validate_page_responses
    rows = [(1, "commercial", '{"html": "<p>x</p>", "summary": "s"}'), (2, "commercial", "{}"),
            (3, "commercial", '{"html": "<p>x</p>"}'), (4, "commercial", "oops"), (5, "commercial", "[1]"),
            (6, "commercial", '{"html": null, "summary": "s"}')]
    df = spark.createDataFrame(rows, "sample_id long, page_type string, raw string")
    got = {r["sample_id"]: r["reason"] for r in validate_page_responses(df).collect()}
    assert got == {1: None, 2: "generation_failed", 3: "incomplete", 4: "generation_failed", 5: "not_an_object",
                   6: "incomplete"}


def test_first_n_accepted(spark):
    raws = [(a, receipt() if a % 3 else "bad") for a in range(1, 31)]
    p = V.parse_responses(spark.createDataFrame(raws, "attempt long, raw string"))
    first = [r["attempt"] for r in V.first_n_accepted(p, 4).orderBy("attempt").collect()]
    assert first == [1, 2, 4, 5]
    s = V.attempt_summary(p, 4).first()
    assert (s["target"], s["max_attempts"], s["attempts_used"], s["n_accepted"]) == (4, 12, 5, 4)
    s = V.attempt_summary(p, 30).first()   # fewer than n accepted within 3n -> all attempts used
    assert s["n_accepted"] == 20 and s["attempts_used"] == 30


def test_receipts_all_null(spark):
    """One cohort without any total (missing), one with a single value (not enough points)."""
    from cohortkit.operators.fidelity import ks_statistic
    from cohortkit.operators.utility import spend_summary
    rows = [("Statistical", i, Decimal(i), Decimal(i)) for i in range(1, 6)] + \
        [("LLM", 3, Decimal(2), None), ("LLM", 4, None, None)]
    df = spark.createDataFrame(rows, "generator string, num_items int, subtotal decimal(18,2), total_amount decimal(18,2)")
    ks = {r["feature"]: r["status"] for r in ks_statistic(spark, df).collect()}
    assert ks == {"num_items": "ok", "subtotal": "not_enough_points", "total_amount": "missing"}
    sp = {r["generator"]: r["status"] for r in spend_summary(spark, df).collect()}
    assert sp == {"Statistical": "ok", "LLM": "missing"}


def test_receipts_empty_cohort(spark):
    from cohortkit.operators.utility import spend_summary, utility_flag
    df = spark.createDataFrame([("Statistical", "c1", 1, Decimal("5.00"))],
                               "generator string, customer_id string, week_num int, total_amount decimal(18,2)") \
        .withColumn("receipt_datetime", F.lit(None).cast("timestamp_ntz"))
    items = spark.createDataFrame([], "generator string, item_name string")
    sp = {r["generator"]: r["status"] for r in spend_summary(spark, df).collect()}
    assert sp == {"Statistical": "ok", "LLM": "empty"}
    fl = {r["generator"]: r["analysis_possible"] for r in utility_flag(spark, df, items).collect()}
    assert fl == {"Statistical": True, "LLM": False}


def test_weekly_guard(spark):
    from cohortkit.operators.utility import weekly_spend
    one_cust = [("Statistical", "c1", w, Decimal("1.00")) for w in range(5)]
    one_week = [("LLM", f"c{i}", 3, Decimal("1.00")) for i in range(5)]
    df = spark.createDataFrame(one_cust + one_week, "generator string, customer_id string, week_num int, total_amount decimal(18,2)")
    assert weekly_spend(df).count() == 0


def test_latest_dataset(spark):
    from cohortkit.session import scratch_path
    from cohortkit.sources import datasets as DS
    base = scratch_path(spark, "ds-test")
    with pytest.raises(FileNotFoundError):
        DS.latest_dataset(spark, base)
    old = spark.createDataFrame([(1, "old")], "sample_id long, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "sample_id long, v string")
    DS.write_dataset(old, base, "20250101_000000")
    import time
    time.sleep(1.1)
    DS.write_dataset(new, base, "20250102_000000")
    got = DS.latest_dataset(spark, base, "sample_id long, v string")
    assert sorted(r["v"] for r in got.collect()) == ["new", "new"]
    with pytest.raises(Exception):
        DS.write_dataset(new, base, "20250102_000000")   # an existing dataset is never overwritten


def test_any_amount_leaves_the_other_responses_alone(spark):
    line = '{"item_name": "A", "category": "C", "quantity": %s, "unit_price": %s, "item_total": 1.00}'
    raws = [(1, receipt()), (2, receipt(items="[" + line % ("3000000000", "1.00") + "]")),
            (3, receipt(items="[" + line % ("2000000000", "99999999999.99") + "]")),
            (4, receipt(items="[" + ", ".join(line % ("99999", "99999999999.99") for _ in range(3)) + "]")),
            (5, receipt(items="[" + line % ("9" * 30, "1.00") + ", " + line % ("1", "9" * 40) + ", " + line % ("2", "3.00") + "]"))]
    p = V.parse_responses(spark.createDataFrame(raws, "attempt long, raw string"))
    assert {r["attempt"]: r["reason"] for r in V.validation_outcome(p).collect()} == {
        1: None, 2: None, 3: "no_valid_items", 4: "amount_overflow", 5: None}
    assert {r["attempt"]: str(r["subtotal"]) for r in V.accepted_receipts(p).collect()} == {1: "3.55", 2: "3000000000.00", 5: "6.00"}
    for lines in (V.accepted_items(p), V.item_total_audit(p)):
        assert sorted(r["attempt"] for r in lines.collect()) == [1, 2, 5]


def test_names_read_as_text(spark):
    names = ["true", "false", "null", "1.0", "2.50", "7", '"x"']
    items = "[" + ", ".join('{"item_name": %s, "category": "C", "quantity": 1, "unit_price": 1, "item_total": 1}' % n for n in names) + "]"
    p = V.parse_responses(spark.createDataFrame([(1, receipt(items=items))], "attempt long, raw string"))
    assert [r["item_name"] for r in V.accepted_items(p).orderBy("pos").collect()] == ["True", "False", "None", "1.0", "2.5", "7", "x"]


def test_page_responses_hold_one_object(spark):
    from cohortkit.operators.pages import validate_page_responses
    ok = '{"html": "<p>", "summary": "s"}'
    raws = [(1, ok, None), (2, ok + " trailing", "generation_failed"), (3, ok + ok, "generation_failed"), (4, "[]", "generation_failed"),
            (5, "null", "generation_failed"), (6, "{}", "generation_failed"), (7, '""', "generation_failed"), (8, "0", "generation_failed"),
            (9, "false", "generation_failed"), (10, "[1]", "not_an_object"), (11, "3", "not_an_object"), (12, '{"html": "x"}', "incomplete"),
            (13, ok + ", " + ok, "generation_failed"), (14, "", "generation_failed"), (15, " " + ok + "\n", None)]
    df = spark.createDataFrame([(i, "commercial", r) for i, r, _ in raws], "sample_id long, page_type string, raw string")
    assert {r["sample_id"]: r["reason"] for r in validate_page_responses(df).collect()} == {i: why for i, _, why in raws}


def test_split_exact_takes_any_fraction(spark):
    from cohortkit.operators.textprep import split_exact
    df = spark.range(100).withColumnRenamed("id", "sample_id")
    for fraction, n in ((0.3, 30), (0.6, 60), (0.2, 20), (0.333, 34), (0.0, 0), (1.0, 100)):
        assert split_exact(df, test_fraction=fraction).filter("is_test").count() == n


def test_third_cohort_is_not_dropped(spark):
    from cohortkit.operators import utility as U
    from cohortkit.operators.privacy import extremes
    items = spark.createDataFrame([(g, f"i{k % 4}", "c") for g in ("Statistical", "LLM", "Other") for k in range(9)],
                                  "generator string, item_name string, category string")
    top = U.top_n(U.value_counts(items, "item_name"), "item_name", 2)
    assert {(r["generator"], r["rank"]) for r in top.collect()} == {(g, k) for g in ("Statistical", "LLM", "Other") for k in (1, 2)}
    r = spark.createDataFrame([("Other", Decimal("2.00"), 3)], "generator string, total_amount decimal(18,2), num_items int")
    for df in (extremes(spark, r), U.spend_summary(spark, r)):
        assert {x["generator"]: x["n_receipts"] for x in df.collect()} == {"Statistical": 0, "LLM": 0, "Other": 1}


def test_reconcile_ids_of_both_cohorts(spark):
    from cohortkit.operators.report import header_line_reconcile
    h = spark.createDataFrame([("R1", "Statistical"), ("R1", "LLM"), (None, "LLM")], "receipt_id string, generator string")
    lines = spark.createDataFrame([("R1", "Statistical"), ("R1", "Statistical"), ("R1", "LLM"), (None, "LLM"), ("R9", "LLM")],
                                  "receipt_id string, generator string")
    got = {r["generator"]: (r["n_headers"], r["n_headers_with_lines"], r["n_lines"], r["n_orphan_lines"])
           for r in header_line_reconcile(h, lines).collect()}
    assert got == {"Statistical": (1, 1, 2, 0), "LLM": (2, 2, 2, 1)}


def test_customers_that_share_an_id_stay_apart(spark):
    from cohortkit.operators import privacy as P
    from cohortkit.operators import utility as U
    rows = [("LLM", "CUST_1", k, w, Decimal("10.00") * k) for k in (1, 2) for w in (1, 2)]
    df = spark.createDataFrame(rows, "generator string, customer_id string, customer_key int, week_num int, total_amount decimal(18,2)")
    assert sorted(r["avg_weekly_spend"] for r in U.avg_weekly_spend(df).collect()) == [10.0, 20.0]
    assert {r["column_name"]: r["n_distinct"] for r in P.uniqueness(df).collect()}["customer_id"] == 2


def test_tuple_files_of_the_original_form(spark, tmp_path):
    import json
    from cohortkit.sources.tuple_files import read_tuple_files
    data = [["<p>a</p>", "commercial", "one"], ["<p>b</p>", "navigational", 'two "quoted"']]
    (tmp_path / "data_1.json").write_text(json.dumps(data, indent=2))
    (tmp_path / "data_2.json").write_text("[]")
    got = read_tuple_files(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["file"], r["html"], r["page_type"], r["summary"]) for r in got] == [("data_1.json", *x) for x in data]


def test_report_sink(spark, tmp_path):
    from cohortkit.operators.report import summary_report, write_report
    yields = spark.createDataFrame([("LLM", 0.5)], "generator string, yield_ratio double")
    flags = spark.createDataFrame([("LLM", True)], "generator string, analysis_possible boolean")
    report = summary_report(spark, yields, flags)
    write_report(report, str(tmp_path / "metrics"))
    back = spark.read.parquet(str(tmp_path / "metrics")).select(*report.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, report.collect()), key=repr)
