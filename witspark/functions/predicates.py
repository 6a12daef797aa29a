"""Compiling path predicates of detection rules to boolean columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from witspark.functions.payload import NUMBERS, Resolver

# Operator names, in the order of precedence inside one predicate.
OPERATORS = ("in", "exists", "prefix", "suffix", "regex", "not", "gt", "gte", "lt", "lte")
MAX_PATTERN = 256


def check_predicate(expected) -> None:
    """Reject a predicate that names an unknown operator or a wrong operand type."""

    if not isinstance(expected, dict):
        return
    for name, operand in expected.items():
        if name not in OPERATORS:
            raise ValueError(f"unsupported predicate operator: {name}")
        if name == "in" and not isinstance(operand, list):
            raise ValueError("operator in needs a list")
        if name == "exists" and not isinstance(operand, bool):
            raise ValueError("operator exists needs a boolean")
        if name in ("prefix", "suffix", "regex") and not isinstance(operand, str):
            raise ValueError(f"operator {name} needs a string")
        if name == "regex" and len(operand) > MAX_PATTERN:
            raise ValueError("regex pattern is too long")


class _Value:
    """One resolved value, seen as text, number, boolean or missing."""

    def __init__(self, resolver: Resolver, path: str):
        if resolver.complete(path):
            self.text = resolver.envelope(path).cast("string")
            self.number, self.flag = F.lit(None).cast("double"), F.lit(None).cast("boolean")
            self.present = self.text.isNotNull()
            return
        inner = resolver.inner(path)
        column = resolver.envelope(path)
        kind = resolver.kind(path)
        text = F.when(kind == "STRING", F.try_variant_get(inner, "$", "string"))
        number = F.when(kind.isin(*NUMBERS), F.try_variant_get(inner, "$", "double"))
        flag = F.when(kind == "BOOLEAN", F.try_variant_get(inner, "$", "boolean"))
        present = inner.isNotNull()
        if column is not None:
            found = column.isNotNull()
            text = F.coalesce(column.cast("string"), text)
            number = F.when(~found, number)
            flag = F.when(~found, flag)
            present = found | present
        self.text, self.number, self.flag, self.present = text, number, flag, present


def _false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _equals(value: _Value, expected) -> Column:
    if expected is None:
        return ~value.present
    if isinstance(expected, bool):
        return _false(value.flag == F.lit(expected))
    if isinstance(expected, (int, float)):
        return _false(value.number == F.lit(float(expected)))
    if isinstance(expected, str):
        return _false(value.text == F.lit(expected))
    raise ValueError(f"unsupported literal: {expected!r}")


def _instant(text: str):
    try:
        return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None


def _compare(value: _Value, name: str, threshold) -> Column:
    def test(left, right):
        return {
            "gt": left > right,
            "gte": left >= right,
            "lt": left < right,
            "lte": left <= right,
        }[name]

    if isinstance(threshold, (int, float)):
        # A boolean counts as 0 or 1; a numeric string is never a number.
        number = F.coalesce(value.number, value.flag.cast("double"))
        return _false(test(number, F.lit(float(threshold))))
    instant = _instant(threshold) if isinstance(threshold, str) else None
    if instant is None:
        return F.lit(False)
    return _false(test(F.try_to_timestamp(value.text), F.lit(instant)))


def _regex(value: _Value, pattern: str) -> Column:
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return _false(value.text.rlike(f"(?U){pattern}"))


def _matches(value: _Value, expected) -> Column:
    if not isinstance(expected, dict):
        return _equals(value, expected)
    for name in OPERATORS:
        if name not in expected:
            continue
        operand = expected[name]
        if name == "in":
            tests = [_equals(value, item) for item in operand]
            result = F.lit(False)
            for one in tests:
                result = result | one
            return result
        if name == "exists":
            return value.present if operand else ~value.present
        if name == "prefix":
            return _false(F.startswith(value.text, F.lit(operand)))
        if name == "suffix":
            return _false(F.endswith(value.text, F.lit(operand)))
        if name == "regex":
            return _regex(value, operand)
        if name == "not":
            return value.present & ~_matches(value, operand)
        if operand is not None:
            return _compare(value, name, operand)
    return F.lit(False)


def predicate(resolver: Resolver, path: str, expected) -> Column:
    """Boolean, never null, column for one path and its expectation."""

    check_predicate(expected)
    return _matches(_Value(resolver, path), expected)
