"""Scalar formulas as column expressions. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 90.0
SECONDS_A_DAY = 86_400


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double (not on the decimal text, as round(x, n) would)."""
    k = 10.0**digits
    return F.round(x * F.lit(k)) / F.lit(k)


def maintainability(density: Column, dead_ratio: Column, fan_out: Column, lines: Column) -> Column:
    raw = (
        F.lit(100.0) - density * 30.0 * F.least(lines.cast("double") / 50.0, F.lit(1.0)) - dead_ratio * 20.0
        - F.least(F.log(fan_out.cast("double") + 1.0) * 4.0, F.lit(15.0))
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))


def crap(cyclomatic: Column, coverage: Column) -> Column:
    cc, bare = cyclomatic.cast("double"), F.lit(1.0) - coverage / 100.0
    return cc * cc * bare * bare * bare + cc


def commit_weight(age_days: Column) -> Column:
    return F.exp(-age_days / HALF_LIFE_DAYS * math.log(2))


def size_bin(lines: Column) -> Column:
    return F.when(lines <= 15, "low").when(lines <= 30, "medium").when(lines <= 60, "high").otherwise("very_high")


def parameter_bin(n: Column) -> Column:
    return F.when(n <= 2, "low").when(n <= 4, "medium").when(n <= 6, "high").otherwise("very_high")


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def trend(first: Column, second: Column) -> Column:
    ratio = second / F.nullif(first, F.lit(0.0))
    return (
        F.when((first == 0) & (second == 0), "stable").when(first == 0, "accelerating")
        .when(ratio > 1.5, "accelerating").when(ratio < 0.67, "cooling").otherwise("stable")
    )


def fnv1a(text: Column) -> Column:
    """FNV-1a (32 bits) of an ASCII string as eight hex digits."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16_777_619, F.lit(1 << 32))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2_166_136_261).cast("bigint"), step)
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def baseline_key(path: Column, category: Column) -> Column:
    """What a baseline lists of a target: the path and the category without separators."""
    return F.concat_ws(":", path.cast("string"), F.translate(category, "_", ""))


def line_count(text: Column) -> Column:
    """Lines as editors count them: nothing has none, one final newline does not begin another."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    return low.startswith("tests/") | low.contains("/tests/") | name.contains("spec") | name.contains("test")
