"""Filter and bind expressions over solution columns.

A variable ``x`` is the string column ``x`` plus a numeric twin ``x__num``.  Every function here returns
an ordinary Column, so conditions push down and stay in generated code.  A condition over an unbound or
ill-typed value is NULL, which a filter treats as false; :func:`negate` is two-valued.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trivane.terms import is_var, twin, var_name

Operand = "Column | str | int | float"


def text(name: str) -> Column:
    return F.col(var_name(name))


def num(name: str) -> Column:
    return F.col(twin(var_name(name)))


# Fixed value: the text of a decimal number.  Words such as nan and suffixes such as 1d are no numbers.
NUMBER = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def as_number(column: Column) -> Column:
    """The number a text stands for, or NULL.

    The pattern also spares most terms a failed cast, which costs far more than a match.
    """
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


def _literal_number(value) -> float | None:
    if isinstance(value, str) and not re.match(NUMBER, value):
        return None
    return float(value)


def _ordered(left: Column, op: str, right: Column) -> Column:
    if op == "=":
        return left == right
    if op == "!=":
        return left != right
    if op == "<":
        return left < right
    if op == "<=":
        return left <= right
    if op == ">":
        return left > right
    if op == ">=":
        return left >= right
    raise ValueError(f"unknown comparison {op!r}")


def compare(left: str, op: str, right: str | int | float) -> Column:
    """``?x op constant`` or ``?x op ?y``.

    Numbers compare as numbers.  Anything else supports only ``=`` and ``!=`` on the text.
    """
    if isinstance(right, str) and is_var(right):
        both = num(left).isNotNull() & num(right).isNotNull()
        numeric, textual = _ordered(num(left), op, num(right)), (text(left), text(right))
    else:
        value = _literal_number(right)
        if value is None:
            return _ordered(text(left), op, F.lit(right)) if op in ("=", "!=") else F.lit(False)
        if op not in ("!=",):
            # A value equal to a number is itself a number, so this alone is complete and pushes down.
            return _ordered(num(left), op, F.lit(value))
        both = num(left).isNotNull()
        numeric, textual = num(left) != F.lit(value), (text(left), F.lit(str(right)))
    if op in ("=", "!="):
        return F.when(both, numeric).otherwise(_ordered(*textual[:1], op, textual[1]))
    return F.when(both, numeric)


def arith(left: Column, op: str, right: Column | int | float) -> Column:
    """``+ - * /`` on numbers; division by zero and non-numbers give NULL."""
    other = right if isinstance(right, Column) else F.lit(float(right))
    if op == "+":
        return left + other
    if op == "-":
        return left - other
    if op == "*":
        return left * other
    if op == "/":
        return F.try_divide(left, other)
    raise ValueError(f"unknown operator {op!r}")


def compare_arith(left: Column, op: str, right: Column | int | float) -> Column:
    other = right if isinstance(right, Column) else F.lit(float(right))
    return _ordered(left, op, other)


def truthy(value: Column) -> Column:
    """A bare arithmetic condition holds when it is a number other than zero."""
    return value != F.lit(0.0)


def negate(condition: Column) -> Column:
    """Two-valued NOT: a condition that cannot be evaluated counts as false."""
    return ~F.coalesce(condition, F.lit(False))


def concat(*parts: str) -> Column:
    """Concatenate variables and constants; an unbound variable is the empty string."""
    return F.concat(*[F.coalesce(text(p), F.lit("")) if is_var(p) else F.lit(p) for p in parts])
