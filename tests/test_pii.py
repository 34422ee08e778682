"""Checks of personal-data matches against plain versions and known numbers."""

import random

from pyspark.sql import functions as F

from cohortkit.operators import pii


def luhn(x):
    total = 0
    for k, c in enumerate(reversed(x)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_checks(spark):
    rnd = random.Random(4)
    numbers = ["4111111111111111", "4111111111111112", "0" * 13, "6011000990139424"] + ["".join(rnd.choice("0123456789") for _ in range(rnd.randint(13, 19))) for _ in range(60)]
    ibans = ["GB82WEST12345698765432", "DE89370400440532013000", "DE89370400440532013001", "FR1420041010050500013M02606"]
    ibans += [rnd.choice(["DE", "FR"]) + "".join(rnd.choice("0123456789ABCZ") for _ in range(20)) for _ in range(60)]
    for values, check, want in ((numbers, pii.luhn_valid, luhn), (ibans, pii.iban_valid, iban)):
        got = spark.createDataFrame([(v,) for v in values], "x string").select("x", check(F.col("x")).alias("ok")).collect()
        assert {r["x"]: r["ok"] for r in got} == {v: want(v) for v in values}
        assert len({want(v) for v in values}) == 2


def test_scan_counts_valid_matches(spark):
    rows = [("a", "card 4111111111111111 and 4111111111111112, DE89370400440532013000, 10.0.0.1 and 10.0.0.999"), ("a", None), (None, ""), ("b", "x@y.org")]
    got = {(r["source"], r["kind"]): (r["n_docs"], r["n_with"], r["n_matches"], r["n_valid"])
           for r in pii.pii_scan(spark.createDataFrame(rows, "source string, text string")).collect()}
    # the digits of the IBAN are a long number too
    assert got["a", "long_number"] == (2, 1, 3, sum(map(luhn, ("4111111111111111", "4111111111111112", "89370400440532013000"[:19]))))
    assert got["a", "iban"] == (2, 1, 1, 1) and got["a", "ipv4"] == (2, 1, 2, 1)
    assert got["b", "email"] == (1, 1, 1, 1) and got[None, "email"] == (1, 0, 0, 0)
