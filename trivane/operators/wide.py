"""Property tables: one row per subject, one column per single-valued predicate.

Triples are often kept, or already given, in this wide form.  A star, that is all patterns about one
subject, then is one scan with a projection instead of a join per pattern: no shuffle, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number
from trivane.terms import Pattern, is_var, twin, var_name


@dataclass(frozen=True)
class PropertyTable:
    """``subject`` and, per predicate, ``(text, number)`` as SQL expressions over ``df``.

    A subject has one row, in one table only; a NULL text means the subject lacks the predicate.
    """

    df: DataFrame
    subject: str
    columns: dict[str, tuple[str, str]]


def stars(patterns: Sequence[Pattern]) -> tuple[list[list[Pattern]], list[Pattern]]:
    """Patterns with constant predicates, grouped by subject, and the rest."""
    groups: dict[str, list[Pattern]] = {}
    rest = []
    for pattern in patterns:
        if is_var(pattern.p):
            rest.append(pattern)
        else:
            groups.setdefault(pattern.s, []).append(pattern)
    return list(groups.values()), rest


def star_variables(star: Sequence[Pattern]) -> list[str]:
    return list(dict.fromkeys(v for p in star for v in p.variables))


def scan_star(tables: Sequence[PropertyTable], star: Sequence[Pattern]) -> DataFrame | None:
    """Solutions of a star, or None if no table has all its predicates."""
    wanted = {p.p for p in star}
    parts = [_scan_table(t, star) for t in tables if wanted <= set(t.columns)]
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scan_table(table: PropertyTable, star: Sequence[Pattern]) -> DataFrame:
    subject = star[0].s
    bound: dict[str, tuple[Column, Column]] = {}
    conditions: list = []
    if is_var(subject):
        bound[subject] = (F.expr(table.subject), as_number(F.expr(table.subject).cast("string")))
    else:
        conditions.append(F.expr(table.subject) == F.lit(subject))
    for pattern in star:
        text, number = table.columns[pattern.p]
        conditions.append(F.expr(text).isNotNull())
        if not is_var(pattern.o):
            conditions.append(F.expr(text) == F.lit(pattern.o))
        elif pattern.o in bound:
            conditions.append(bound[pattern.o][0] == F.expr(text))
        else:
            bound[pattern.o] = (F.expr(text), F.expr(number))
    rows = table.df
    for condition in conditions:
        rows = rows.filter(condition)
    columns = []
    for term, (text, number) in bound.items():
        name = var_name(term)
        columns += [text.alias(name), number.alias(twin(name))]
    return rows.select(*columns)
