"""Verdict rules. A verdict code is 0 = pass, 1 = fail, 2 = anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, OTHER = 0, 1, 2

FAIL_RULES = ("fail_only", "not_pass", "counts")


def strip(c: Column) -> Column:
    """Without white space at either end, line breaks and tabs included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def verdict_code(result: Column) -> Column:
    """Exact `Pass` / `Fail` after trimming; every other verdict, and null, is OTHER."""
    r = strip(result)
    return (
        F.when(r == "Fail", F.lit(FAIL)).when(r == "Pass", F.lit(PASS)).otherwise(F.lit(OTHER))
    )


def is_failure(rule: str = "fail_only", result: Column | None = None,
               failures: Column | None = None, errors: Column | None = None) -> Column:
    """The three failure rules in use: exact `Fail`, anything but pass, or counters."""
    if rule == "fail_only":
        flag = strip(result) == "Fail"
    elif rule == "not_pass":
        flag = F.upper(strip(result)) != "PASS"
    elif rule == "counts":
        flag = (F.coalesce(failures, F.lit(0)) > 0) | (F.coalesce(errors, F.lit(0)) > 0)
    else:
        raise ValueError(f"unknown fail rule {rule!r}, expected one of {FAIL_RULES}")
    return F.coalesce(flag, F.lit(False)).cast("int")


def fail_from_code(code: Column, rule: str = "fail_only") -> Column:
    """The same choice on an already coded verdict."""
    if rule == "fail_only":
        return (code == FAIL).cast("int")
    if rule == "not_pass":
        return (code != PASS).cast("int")
    raise ValueError(f"rule {rule!r} does not apply to verdict codes")
