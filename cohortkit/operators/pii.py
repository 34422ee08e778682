"""Personal-data scan of texts (V7): documents and matches per source and kind, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds and their patterns: the same in Java and RE2 (no look-around).
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3} \(?[0-9]{2,4}\)? [0-9]{3}-?[0-9]{4}",
    "long_number": r"[0-9]{13,19}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}


LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # a character's number in an IBAN is its place here


def luhn_valid(number: Column) -> Column:
    """Whether the digits pass the Luhn check: from the right, every second digit counts double, less 9 above 9."""
    digits = F.reverse(number)

    def add(total: Column, at: Column) -> Column:
        d = F.substr(digits, at, F.lit(1)).cast("int") * F.when(at % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def iban_valid(iban: Column) -> Column:
    """Whether the rest of the number, with its first four characters moved to the end, is 1 modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def take(rest: Column, at: Column) -> Column:
        v = F.position(F.substr(moved, at, F.lit(1)), F.lit(LETTERS)) - 1
        return (rest * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), take) == 1


def ipv4_valid(address: Column) -> Column:
    """Whether no part is above 255."""
    return F.forall(F.split(address, r"\."), lambda part: part.cast("int") <= 255)


# Kinds whose matches carry a check of their own; matches of the others are valid as they are.
CHECKS = {"long_number": luhn_valid, "ipv4": ipv4_valid, "iban": iban_valid}


def pii_scan(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, kind, n_docs, n_with, n_matches, n_valid)`` over whole texts; null texts count as documents without a match.
    ``n_valid`` counts the matches that pass their kind's check (Luhn, modulo 97, parts of an address).

    One pass: per document two numbers per kind, combined map-side per source, so a source with most documents costs
    one partial row per task.
    """
    counts = []
    for k, p in PATTERNS.items():
        if k in CHECKS:
            found = F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
            counts += [F.coalesce(F.size(found), F.lit(0)).cast("bigint").alias(k),
                       F.coalesce(F.size(F.filter(found, CHECKS[k])), F.lit(0)).cast("bigint").alias(f"v_{k}")]
        else:
            n = F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).cast("bigint")
            counts += [n.alias(k), n.alias(f"v_{k}")]
    per_source = docs.select(F.col(source).alias("source"), *counts).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(k) > 0).alias(f"w_{k}") for k in PATTERNS],
        *[F.sum(k).alias(f"m_{k}") for k in PATTERNS], *[F.sum(f"v_{k}").alias(f"s_{k}") for k in PATTERNS])
    pairs = ", ".join(f"'{k}', w_{k}, m_{k}, s_{k}" for k in PATTERNS)
    return per_source.selectExpr("source", "n_docs", f"stack({len(PATTERNS)}, {pairs}) as (kind, n_with, n_matches, n_valid)").select(
        "source", "kind", "n_docs", "n_with", "n_matches", "n_valid")
