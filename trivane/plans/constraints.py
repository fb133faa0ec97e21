"""Denial constraints, repairs and inconsistency-tolerant answers.

A denial constraint is a rule body that must have no solution.  The facts of one solution are a conflict.
Whether a fact takes part in a conflict is decided by semi-joins, so conflicts are never listed per group;
only :func:`violations`, whose answer is that list, joins the atoms out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number
from trivane.operators.bgp import join_patterns, join_solutions, linked_order, scan, variables
from trivane.plans.rules import FACT, Rule, infer, union_all
from trivane.session import StepLog, materialize
from trivane.store import SPO, TripleStore
from trivane.terms import Pattern, Prefixes, twin

RANK = "__rank"


@dataclass(frozen=True)
class Denial:
    """No solution of ``body`` may meet all ``filters``."""

    body: Sequence[Sequence[str]]
    filters: Sequence[Column] = ()
    name: str = ""

    def atoms(self, prefixes: Prefixes | None = None) -> list[Pattern]:
        return [Pattern.of(t, prefixes) for t in self.body]


def violations(facts: DataFrame, denial: Denial, prefixes: Prefixes | None = None) -> DataFrame:
    """The variable bindings that break the constraint."""
    found = join_patterns(facts, denial.atoms(prefixes))
    for condition in denial.filters:
        found = found.filter(condition)
    return found.select(*variables(found))


def is_violated(facts: DataFrame, denials: Sequence[Denial], prefixes: Prefixes | None = None) -> bool:
    return any(not violations(facts, d, prefixes).isEmpty() for d in denials)


# What orders the facts of a repair: their text, or a digest of it.
ORDERS = ("text", "digest")


def ranked(facts: DataFrame, order: int = 0, by: str = "text") -> DataFrame:
    """Facts with their place in the deletion order: a lower rank is kept first.

    The rank names the fact, so it holds the number too: objects may have a number and no text.
    """
    if by not in ORDERS:
        raise ValueError(f"unknown order {by!r}")
    words = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FACT])
    digest = [F.md5(words).alias("digest")] if by == "digest" else []
    return facts.select(*FACT, F.struct(F.lit(order).alias("order"), *digest, *FACT).alias(RANK))


def _atom(facts: DataFrame, atom: Pattern, name: str) -> DataFrame:
    """Solutions of one atom with the rank of the matched fact."""
    return scan(facts, atom, [RANK]).withColumnRenamed(RANK, name)


def _others(facts: DataFrame, atoms: Sequence[Pattern], skip: int) -> DataFrame:
    """Joint solutions of all atoms but one, with each matched fact's rank as ``__rank<i>``."""
    return _matched(None, facts, [(i, a) for i, a in enumerate(atoms) if i != skip])


def _matched(first: DataFrame | None, facts: DataFrame, atoms: Sequence[tuple[int, Pattern]]) -> DataFrame:
    """Joint solutions of numbered atoms, starting from ``first``; linked atoms come one after another."""
    known = variables(first) if first is not None else ()
    ordered = linked_order(atoms, lambda e: e[1].variables, lambda e: e[1].bound, known)
    parts = [_atom(facts, a, f"{RANK}{i}") for i, a in ordered]
    return reduce(join_solutions, parts if first is None else [first, *parts])


def _linked(atoms: Sequence[Pattern]) -> bool:
    """Whether the atoms hang together by variables."""
    if not atoms:
        return True
    known, rest = set(atoms[0].variables), list(atoms[1:])
    while rest:
        near = next((a for a in rest if known & set(a.variables)), None)
        if near is None:
            return False
        known |= set(near.variables)
        rest.remove(near)
    return True


def _semi(mine: DataFrame, others: DataFrame, denial: Denial, extra: Column) -> DataFrame:
    """Rows of ``mine`` that have a partner; the shared variables of ``others`` are renamed away."""
    shared = [v for v in variables(mine) if v in set(variables(others))]
    partner = others.drop(*[twin(v) for v in shared]).withColumnsRenamed({v: f"__other_{v}" for v in shared})
    condition = reduce(lambda a, b: a & b, [*[F.col(v) == F.col(f"__other_{v}") for v in shared], extra])
    return mine.join(partner, reduce(lambda c, f: c & f, denial.filters, condition), "left_semi")


def _latest_in_conflict(mine: DataFrame, alive: DataFrame, denials: Sequence[Denial], prefixes) -> DataFrame:
    """Ranks of facts of ``mine`` that come last in a conflict whose other facts are all in ``alive``."""
    parts = []
    for denial in denials:
        atoms = denial.atoms(prefixes)
        if len(atoms) == 1:
            continue  # removed beforehand
        for i, atom in enumerate(atoms):
            candidates = _atom(mine, atom, RANK)
            ranks = [F.col(f"{RANK}{j}") for j in range(len(atoms)) if j != i]
            latest = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
            if not _linked([a for j, a in enumerate(atoms) if j != i]):
                # Only this atom holds the others together, so the search for partners starts from its facts.
                met = _matched(candidates, alive, [(j, a) for j, a in enumerate(atoms) if j != i])
                met = reduce(DataFrame.filter, denial.filters, met)
                parts.append(met.filter(latest <= F.col(RANK)).select(RANK))
                continue
            others = _others(alive, atoms, i)
            shared = [v for v in variables(candidates) if v in set(variables(others))]
            if not denial.filters and shared:
                # Without filters only the earliest partner per key matters: one row per key to join.
                others = others.groupBy(*shared).agg(F.min(latest).alias(f"{RANK}_last"))
                for v in shared:
                    others = others.withColumn(twin(v), F.lit(None).cast("double"))
                latest = F.col(f"{RANK}_last")
            parts.append(_semi(candidates, others, denial, latest <= F.col(RANK)).select(RANK))
    if not parts:
        return mine.select(RANK).limit(0)
    return union_all(parts).distinct()


def _alone(facts: DataFrame, denials: Sequence[Denial], prefixes) -> DataFrame:
    """Facts that break a constraint all by themselves: they are in no repair."""
    parts = []
    for denial in denials:
        # One fact matches every atom, so all constants and variables are about its three positions: one filter.
        places: dict[str, str] = {}
        tests, fixed, possible = [], {}, True
        for place, term in [pair for atom in denial.atoms(prefixes) for pair in atom.terms()]:
            if term.startswith("?"):
                if places.setdefault(term[1:], place) != place:
                    tests.append(F.col(places[term[1:]]) == F.col(place))
            elif fixed.setdefault(place, term) != term:
                possible = False
        if not possible:
            continue
        tests += [F.col(place) == F.lit(term) for place, term in fixed.items()]
        found = reduce(DataFrame.filter, tests, facts)
        bound = [F.col(place).alias(name) for name, place in places.items()]
        bound += [(F.col("o_num") if place == "o" else as_number(F.col(place))).alias(twin(n)) for n, place in places.items()]
        found = reduce(DataFrame.filter, denial.filters, found.select(RANK, *bound))
        parts.append(found.select(RANK))
    return union_all(parts).distinct() if parts else facts.select(RANK).limit(0)


def _in_conflict(facts: DataFrame, denials: Sequence[Denial], prefixes) -> DataFrame:
    """Ranks of facts that take part in a minimal conflict of two or more facts.

    ``facts`` holds no fact that is inconsistent alone.  One fact may match several atoms, so the matches of a denial
    of three or more atoms are taken as sets; a set counts only if no pair in it is a conflict of a two-atom denial
    and no smaller set in it is a conflict itself.
    """
    pairs = [d for d in denials if len(d.atoms(prefixes)) == 2]
    parts = []
    for denial in pairs:
        atoms = denial.atoms(prefixes)
        for i, atom in enumerate(atoms):
            mine = _atom(facts, atom, RANK)
            others = _others(facts, atoms, i)
            other = F.col(f"{RANK}{1 - i}")
            shared = [v for v in variables(mine) if v in set(variables(others))]
            differs = other != F.col(RANK)
            if not denial.filters and shared:
                others = others.groupBy(*shared).agg(F.min(other).alias("__low"), F.max(other).alias("__high"))
                for v in shared:
                    others = others.withColumn(twin(v), F.lit(None).cast("double"))
                differs = (F.col("__low") != F.col(RANK)) | (F.col("__high") != F.col(RANK))
            parts.append(_semi(mine, others, denial, differs).select(RANK))
    sets = []
    for denial in denials:
        atoms = denial.atoms(prefixes)
        if len(atoms) < 3:
            continue
        matches = _matched(None, facts, list(enumerate(atoms)))
        for condition in denial.filters:
            matches = matches.filter(condition)
        members = matches.select(*[f"{RANK}{i}" for i in range(len(atoms))])
        for pair in pairs:
            members = _without_pairs(members, len(atoms), pair, prefixes)
        ranks = F.array(*[f"{RANK}{i}" for i in range(len(atoms))])
        sets.append(members.select(F.array_sort(F.array_distinct(ranks)).alias("facts")))
    if sets:
        parts.append(_smallest(materialize(union_all(sets).distinct(), "conflicts"), denials, prefixes))
    return union_all(parts).distinct() if parts else facts.select(RANK).limit(0)


def _smallest(sets: DataFrame, denials: Sequence[Denial], prefixes) -> DataFrame:
    """Ranks in the sets that hold no other set; a set is a sorted array of two or more ranks."""
    longest = max(len(d.atoms(prefixes)) for d in denials)
    picks = F.expr("sequence(1, shiftleft(1, size(facts)) - 2)")
    chosen = F.transform(picks, lambda mask: F.filter("facts", lambda _, i: F.getbit(mask, i) == 1))
    wide = sets.filter(F.size("facts").between(3, longest))
    inner = wide.select("facts", F.explode(F.filter(chosen, lambda x: F.size(x) > 1)).alias("part"))
    held = inner.join(sets.select(F.col("facts").alias("part")), "part", "left_semi").select("facts").distinct()
    return sets.join(held, "facts", "left_anti").select(F.explode("facts").alias(RANK))


def _without_pairs(members: DataFrame, size: int, pair: Denial, prefixes) -> DataFrame:
    """Drop matches two of whose facts are a conflict under ``pair``, judged on the row itself."""
    first, second = pair.atoms(prefixes)
    names = list(dict.fromkeys(first.variables + second.variables))
    kept = members
    for i in range(size):
        for j in range(size):
            if i == j:
                continue
            tests, bound, numbers = [F.col(f"{RANK}{i}") != F.col(f"{RANK}{j}")], {}, {}
            for atom, at in ((first, i), (second, j)):
                for place, term in atom.terms():
                    value = F.col(f"{RANK}{at}.{place}")
                    if not term.startswith("?"):
                        tests.append(value == F.lit(term))
                    elif term[1:] in bound:
                        tests.append(bound[term[1:]] == value)
                    else:
                        bound[term[1:]] = value
                        numbers[term[1:]] = F.col(f"{RANK}{at}.o_num") if place == "o" else as_number(value)
            row = kept
            for name in names:
                row = row.withColumn(name, bound[name]).withColumn(twin(name), numbers[name])
            condition = reduce(lambda a, b: a & b, [*tests, *pair.filters])
            row = row.filter(~F.coalesce(condition, F.lit(False)))
            kept = row.select(*members.columns)
    return kept


def _drop_ranks(facts: DataFrame, ranks: DataFrame) -> DataFrame:
    return facts.join(ranks, RANK, "left_anti")


def consistent_core(facts: DataFrame, denials: Sequence[Denial], prefixes: Prefixes | None = None) -> DataFrame:
    """Facts that are in every subset-maximal repair: those in no minimal conflict."""
    numbered = ranked(facts)
    sound = _drop_ranks(numbered, _alone(numbered, denials, prefixes))
    return _drop_ranks(sound, _in_conflict(sound, denials, prefixes)).select(*FACT)


def answers_in_all_repairs(store: TripleStore, denials: Sequence[Denial], pattern: Sequence[str]) -> DataFrame:
    core = consistent_core(store.df, denials, store.prefixes)
    return TripleStore(core, store.prefixes).solutions(pattern)


def _settle(open_facts: DataFrame, settled: DataFrame, denials: Sequence[Denial], prefixes) -> DataFrame:
    """Decide facts in rank order and return the ranks that have to go.

    A fact goes when it comes last in a conflict whose other facts all stay.  Every round settles at least
    the lowest open fact, and usually nearly all: a fact stays as soon as no open or kept fact can still
    speak against it.
    """
    open_facts = materialize(open_facts, "open-facts")
    kept, gone = StepLog(open_facts, "kept"), StepLog(open_facts.select(RANK), "gone")
    while not open_facts.isEmpty():
        standing = settled.unionByName(kept.all()) if len(kept) else settled
        alive = standing.unionByName(open_facts)
        blocked = materialize(_latest_in_conflict(open_facts, alive, denials, prefixes), "blocked")
        kept.append(_drop_ranks(open_facts, blocked))
        waiting = open_facts.join(blocked, RANK, "left_semi")
        standing = settled.unionByName(kept.all())
        rejected = gone.append(_latest_in_conflict(waiting, standing, denials, prefixes))
        open_facts = materialize(_drop_ranks(waiting, rejected), "open-facts")
    return gone.all()


def removed_by_repair(
    facts: DataFrame, denials: Sequence[Denial], prefixes: Prefixes | None = None, by: str = "text"
) -> DataFrame:
    """Facts a deterministic, subset-maximal repair deletes: lower triples are kept first.

    The order is that of the text, or that of a digest.  A fact waits for those before it that it conflicts with, and
    they for others: in text order such a chain may be as long as the data make it, in the order of a digest it is short,
    whatever the data, since every part of a chain has a first fact of its own.  The repair is maximal, since each
    deleted fact conflicts with kept ones; it need not be of maximum size, which would take a search over all subsets.
    """
    return _removed(facts, denials, prefixes, by).select(f"{RANK}.s", f"{RANK}.p", f"{RANK}.o")


def _removed(facts: DataFrame, denials: Sequence[Denial], prefixes: Prefixes | None, by: str) -> DataFrame:
    """Ranks of the facts that a repair deletes."""
    numbered = ranked(facts, by=by)
    alone = materialize(_alone(numbered, denials, prefixes), "alone")
    sound = _drop_ranks(numbered, alone)
    involved = sound.join(_touched(sound, denials, prefixes), RANK, "left_semi")
    nothing = numbered.limit(0)
    rejected = _settle(involved, nothing, denials, prefixes)
    return alone.unionByName(rejected)


def _touched(facts: DataFrame, denials: Sequence[Denial], prefixes) -> DataFrame:
    """Ranks of facts in some conflict, minimal or not."""
    pairs = [d for d in denials if len(d.atoms(prefixes)) == 2]
    wide = [d for d in denials if len(d.atoms(prefixes)) > 2]
    parts = [_in_conflict(facts, pairs, prefixes)]
    for denial in wide:
        parts.append(_in_conflict(facts, [denial], prefixes))
    return union_all(parts).distinct()


def repair(
    facts: DataFrame, denials: Sequence[Denial], prefixes: Prefixes | None = None, by: str = "text"
) -> DataFrame:
    """A consistent, subset-maximal set of the given facts."""
    gone = materialize(_removed(facts, denials, prefixes, by), "repair")
    return _drop_ranks(ranked(facts, by=by), gone).select(*FACT)


def infer_with_repair(
    facts: DataFrame,
    rules: Sequence[Rule],
    denials: Sequence[Denial],
    prefixes: Prefixes | None = None,
    by: str = "text",
) -> DataFrame:
    """Repair the given facts, then derive, dropping each conclusion that conflicts with what is kept.

    Conclusions of one round are decided in the given order, after all known facts.
    """
    start = materialize(repair(facts, denials, prefixes, by), "consistent")

    def accept(candidates: DataFrame, known: DataFrame) -> DataFrame:
        fresh = ranked(candidates, 1, by)
        fresh = _drop_ranks(fresh, materialize(_alone(fresh, denials, prefixes), "alone"))
        rejected = _settle(fresh, ranked(known, 0, by), denials, prefixes)
        return _drop_ranks(fresh, rejected).select(*FACT)

    return infer(start, rules, accept=accept, prefixes=prefixes)
