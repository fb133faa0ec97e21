"""Triples, rules and RDF streams as Spark DataFrames."""

from trivane.builder import TripleQuery
from trivane.query import Select, avg, maximum, minimum, total
from trivane.store import TripleStore
from trivane.terms import Pattern, Prefixes

__all__ = [
    "Pattern",
    "Prefixes",
    "Select",
    "TripleQuery",
    "TripleStore",
    "avg",
    "maximum",
    "minimum",
    "total",
]
