"""Query terms: variables, constants, prefixes and triple patterns.

These objects live on the driver only.  They compile to Column predicates and join keys; no row of
data ever holds one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

# The RDF type predicate and the numeric twin suffix of a variable column.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TWIN = "__num"

POSITIONS = ("s", "p", "o")


def is_var(term: str) -> bool:
    return term.startswith("?") and len(term) > 1


def var_name(term: str) -> str:
    return term[1:] if is_var(term) else term


def twin(name: str) -> str:
    """Column that holds the numeric reading of variable ``name``."""
    return f"{name}{TWIN}"


class Prefixes(dict):
    """Prefix table; expands the terms a user writes in a query."""

    def expand(self, term: str) -> str:
        if is_var(term):
            return term
        if term.startswith("<") and term.endswith(">"):
            return term[1:-1]
        if len(term) >= 2 and term.startswith('"') and term.endswith('"'):
            return term[1:-1]
        head, colon, local = term.partition(":")
        if colon and not term.startswith(("http://", "https://")) and head in self:
            return self[head] + local
        return term

    def merged(self, other: Mapping[str, str]) -> Prefixes:
        return Prefixes({**self, **other})


@dataclass(frozen=True)
class Pattern:
    """One triple pattern; a term that starts with ``?`` is a variable."""

    s: str
    p: str
    o: str

    @classmethod
    def of(cls, value: Pattern | Iterable[str], prefixes: Prefixes | None = None) -> Pattern:
        s, p, o = (value.s, value.p, value.o) if isinstance(value, Pattern) else tuple(value)
        known = prefixes or Prefixes()
        return cls(known.expand(s), RDF_TYPE if p == "a" else known.expand(p), known.expand(o))

    def terms(self) -> tuple[tuple[str, str], ...]:
        return tuple(zip(POSITIONS, (self.s, self.p, self.o)))

    @property
    def variables(self) -> list[str]:
        """Variable names in order of first use."""
        return list(dict.fromkeys(var_name(t) for _, t in self.terms() if is_var(t)))

    @property
    def bound(self) -> int:
        return sum(not is_var(t) for _, t in self.terms())


def about(subject: str, *pairs: tuple[str, str]) -> list[tuple[str, str, str]]:
    """Triples that share a subject: ``about("?c", ("name", "?n"), ("segment", "?g"))``."""
    return [(subject, p, o) for p, o in pairs]
