"""Datalog-style rules evaluated to a fixpoint.

Each round is one Spark job: premise joins, head templates, one distinct, one anti join against what is
known.  The round's new facts are written to shared storage and read back as a file scan, so plans stay
flat and a lost executor costs one task, not the history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.bloom import bloom, may_hold
from trivane.operators.bgp import join_order, join_solutions, linked_order, scan, variables
from trivane.operators.keyed import join_keyed, with_fixed
from trivane.operators.wide import PropertyTable, scan_star, star_variables, stars
from trivane.session import StepLog, materialize
from trivane.store import SPO, TripleStore, instantiate
from trivane.terms import Pattern, Prefixes, is_var

FACT = [*SPO, "o_num"]
# Known facts pass a Bloom filter of a round's candidates once they are so many times the round before.
MANY_KNOWN = 4
# With fewer known facts than that, moving them costs less than the filter.
SIEVE_FROM = 5_000_000


@dataclass(frozen=True)
class Rule:
    """``head`` holds for every solution of ``body`` that meets all ``filters``.

    ``transform`` may add columns to the body's solutions, for instance a model's output.
    """

    body: Sequence[Sequence[str]]
    head: Sequence[Sequence[str]]
    filters: Sequence[Column] = ()
    name: str = ""
    transform: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def premises(self, prefixes: Prefixes | None = None) -> list[Pattern]:
        return [Pattern.of(t, prefixes) for t in self.body]

    def conclusions(self, prefixes: Prefixes | None = None) -> list[Pattern]:
        return [Pattern.of(t, prefixes) for t in self.head]


def _predicates(patterns: Sequence[Pattern]) -> set[str] | None:
    """Constant predicates, or None when some predicate is a variable."""
    return None if any(is_var(p.p) for p in patterns) else {p.p for p in patterns}


def _with_predicates(df: DataFrame, predicates: set[str] | None) -> DataFrame:
    return df if predicates is None else df.filter(F.col("p").isin(*sorted(predicates)))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def body_solutions(
    premises: Sequence[Pattern],
    relation_of: Callable[[int], DataFrame],
    carry: Sequence[str] = (),
    background: DataFrame | None = None,
    tables: Sequence[PropertyTable] = (),
    given: set[int] | None = None,
    new_at: int | None = None,
) -> DataFrame:
    """Join the premises, premise ``i`` taken from ``relation_of(i)``.

    ``given`` are the premises no rule can add facts for; where ``tables`` hold their predicates, those
    about one subject are a single scan.

    With ``background`` a premise may match either a carried fact or a background fact, which belongs to
    every carried key.  Solutions then come in two kinds, keyed and unkeyed, and a join of the two kinds
    is keyed; only keyed solutions are returned.  The premise at ``new_at`` takes new facts only.
    """
    if tables and given and not carry and background is None:
        return _body_over_tables(premises, relation_of, tables, given)
    index = {id(p): i for i, p in enumerate(premises)}
    solutions = None
    for pattern in join_order(premises):
        at = index[id(pattern)]
        if background is None:
            here = scan(relation_of(at), pattern, carry)
            solutions = here if solutions is None else join_solutions(solutions, here, carry)
            continue
        fixed = None if at == new_at else background
        here = scan(with_fixed(relation_of(at), fixed, carry, FACT), pattern, carry)
        solutions = here if solutions is None else join_keyed(solutions, here, carry)
    if background is not None:
        solutions = solutions.filter(F.col(carry[0]).isNotNull()).dropDuplicates([*carry, *variables(solutions)])
    return solutions


def _body_over_tables(
    premises: Sequence[Pattern],
    relation_of: Callable[[int], DataFrame],
    tables: Sequence[PropertyTable],
    given: set[int],
) -> DataFrame:
    whole, rest = stars([premises[i] for i in sorted(given)])
    parts: list[tuple[list[Pattern], DataFrame]] = []
    alone = [premises[i] for i in range(len(premises)) if i not in given] + rest
    for star in whole:
        found = scan_star(tables, star)
        if found is None:
            alone += star
        else:
            parts.append((star, found))
    index = {id(p): i for i, p in enumerate(premises)}
    parts += [([p], scan(relation_of(index[id(p)]), p)) for p in alone]
    ordered = linked_order(parts, lambda e: star_variables(e[0]), lambda e: sum(p.bound for p in e[0]) - len(e[0]) + 1)
    return reduce(join_solutions, [df for _, df in ordered])


def apply_rule(
    rule: Rule,
    relation_of: Callable[[int], DataFrame],
    carry: Sequence[str] = (),
    background: DataFrame | None = None,
    prefixes: Prefixes | None = None,
    tables: Sequence[PropertyTable] = (),
    derivable: set[str] | None = None,
    new_at: int | None = None,
) -> DataFrame:
    """Facts the rule concludes in one step, not yet made distinct."""
    premises = rule.premises(prefixes)
    given = set()
    if derivable is not None:
        given = {i for i, p in enumerate(premises) if not is_var(p.p) and p.p not in derivable}
    solutions = body_solutions(premises, relation_of, carry, background, tables, given, new_at)
    for condition in rule.filters:
        solutions = solutions.filter(condition)
    if rule.transform is not None:
        solutions = rule.transform(solutions)
    return instantiate(solutions, rule.conclusions(prefixes), carry)


def _refuse_growth(rules: Sequence[Rule], prefixes: Prefixes | None) -> None:
    """Raise for a rule with a transform whose conclusions can reach its own body again."""
    bodies = [_predicates(r.premises(prefixes)) for r in rules]
    heads = [_predicates(r.conclusions(prefixes)) for r in rules]
    feeds = [
        [j for j, body in enumerate(bodies) if head is None or body is None or head & body] for head in heads
    ]
    for i, rule in enumerate(rules):
        if rule.transform is None:
            continue
        seen, open_ = set(), list(feeds[i])
        while open_:
            j = open_.pop()
            if j not in seen:
                seen.add(j)
                open_ += feeds[j]
        if i in seen:
            raise ValueError(f"rule {rule.name or i} has a transform and feeds itself, so it need not end; set max_rounds")


def transitive(rules: Sequence[Rule], prefixes: Prefixes | None = None) -> dict[int, str]:
    """Rules ``p(x, y), p(y, z) -> p(x, z)``, by number, where all other facts of p come in the first round.

    That is so if p is concluded besides only by rules that no derived fact can start.  After round k all pairs with a
    path of up to 2^(k-1) first facts are known, and those with exactly so many are new.  A shortest path of up to
    twice that many begins with such a pair, so new facts at the first premise lead to all there is.
    """
    heads = _predicates([c for r in rules for c in r.conclusions(prefixes)])
    if heads is None:
        return {}
    found = {}
    for i, rule in enumerate(rules):
        body, head = rule.premises(prefixes), rule.conclusions(prefixes)
        if rule.filters or rule.transform is not None or len(body) != 2 or len(head) != 1:
            continue
        (a, b), c = body, head[0]
        chained = (a.s, a.o, b.o) == (c.s, b.s, c.o) and len({a.s, a.o, b.o}) == 3 and all(map(is_var, (a.s, a.o, b.o)))
        if not chained or not a.p == b.p == c.p or is_var(a.p):
            continue
        others = [r for j, r in enumerate(rules) if j != i and a.p in _predicates(r.conclusions(prefixes))]
        starts = [_predicates(r.premises(prefixes)) for r in others]
        if all(r.transform is None for r in others) and all(s is not None and not s & heads for s in starts):
            found[i] = a.p
    return found


def without_known(candidates: DataFrame, known: DataFrame, key: Sequence[str], sieve: bool) -> DataFrame:
    """Candidates that are not known.

    With ``sieve`` only known facts that a Bloom filter of the candidates lets pass are moved to be compared.
    """
    known = known.select(*key)
    if sieve:
        candidates = materialize(candidates, "candidates")
        words, bits = bloom(candidates.select(F.xxhash64(*key).alias("key")), "key")
        known = known.crossJoin(F.broadcast(words)).filter(may_hold(F.col("words"), bits, F.xxhash64(*key))).select(*key)
    return candidates.join(known, key, "left_anti")


def infer(
    facts: DataFrame,
    rules: Sequence[Rule],
    *,
    carry: Sequence[str] = (),
    semi_naive: bool = True,
    max_rounds: int | None = None,
    accept: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    background: DataFrame | None = None,
    prefixes: Prefixes | None = None,
    tables: Sequence[PropertyTable] = (),
) -> DataFrame:
    """All facts the rules add to ``facts``: ``(carry, s, p, o, o_num)`` without the given ones.

    ``semi_naive`` joins only combinations that use a fact of the round before.  ``max_rounds`` bounds the
    depth of derivations; without it the loop ends when a round finds nothing, which it must, because
    rules create no new terms; a ``transform`` may, so recursion through a rule that has one is refused.  ``accept`` may drop candidate facts of a round.  ``tables`` may hold
    ``facts`` in wide form.
    """
    if max_rounds is None:
        _refuse_growth(rules, prefixes)
    columns, key = [*carry, *FACT], [*carry, *SPO]
    premises = [p for r in rules for p in r.premises(prefixes)]
    heads = [c for r in rules for c in r.conclusions(prefixes)]
    body_predicates, head_predicates = _predicates(premises), _predicates(heads)
    base = facts.select(*columns)
    relevant = _with_predicates(base, body_predicates)
    # Only facts with a head predicate can collide with a conclusion.
    known_base = _with_predicates(base, head_predicates)
    if background is not None:
        fixed = _with_predicates(background.select(*FACT), head_predicates)

    def step(rule: Rule, relation_of: Callable[[int], DataFrame], new_at: int | None = None) -> DataFrame:
        return apply_rule(rule, relation_of, carry, background, prefixes, tables, head_predicates, new_at)

    # Given facts of the predicate would be facts of a round before the first.
    chains = transitive(rules, prefixes) if semi_naive and accept is None and background is None and max_rounds is None else {}
    chains = {i for i, p in chains.items() if base.filter(F.col("p") == p).isEmpty()}
    log = StepLog(base, "rules")
    delta: DataFrame | None = None
    rounds = latest = 0
    known_rows: int | None = None
    while max_rounds is None or rounds < max_rounds:
        found = log.all()
        everything = relevant.unionByName(found) if len(log) else relevant
        earlier = relevant.unionByName(log.before_last()) if len(log) > 1 else relevant
        conclusions = []
        for number, rule in enumerate(rules):
            body = rule.premises(prefixes)
            if delta is None or not semi_naive:
                conclusions.append(step(rule, lambda i, facts=everything: facts))
                continue
            for position, premise in enumerate(body):
                if head_predicates is not None and not is_var(premise.p) and premise.p not in head_predicates:
                    continue  # no new fact can match this premise
                if number in chains and position:
                    continue

                # Premises before the one that takes the new facts see only older ones, so a combination of
                # new facts is formed once.
                def relation_of(i, at=position, new=delta, old=earlier, both=everything) -> DataFrame:
                    return new if i == at else old if i < at else both

                conclusions.append(step(rule, relation_of, position))
        if not conclusions:
            break
        candidates = union_all([c.select(*columns) for c in conclusions]).dropDuplicates(key)
        known = known_base.unionByName(found) if len(log) else known_base
        if len(log) and known_rows is None:
            known_rows = latest + known_base.count()
        fresh = without_known(candidates, known, key, bool(len(log)) and known_rows > max(SIEVE_FROM, MANY_KNOWN * latest))
        if background is not None:
            fresh = fresh.join(fixed.select(*SPO), SPO, "left_anti")
        if accept is not None:
            fresh = accept(materialize(fresh, "candidates"), base.unionByName(found) if len(log) else base)
        delta = log.append(fresh)
        rounds += 1
        latest = delta.count()
        if known_rows is not None:
            known_rows += latest
        if latest == 0:
            log.drop_last()
            break
    return log.all()


class RuleBase:
    """A store with rules: forward inference, goal-directed queries, matches on given and derived facts."""

    def __init__(self, store: TripleStore, rules: Sequence[Rule] = ()) -> None:
        self.store = store
        self.rules = list(rules)

    def add_rule(self, rule: Rule) -> None:
        self.rules.append(rule)

    def infer_naive(self) -> DataFrame:
        store = self.store
        return infer(store.df, self.rules, semi_naive=False, prefixes=store.prefixes, tables=store.tables)

    def infer_semi_naive(self) -> DataFrame:
        return infer(self.store.df, self.rules, prefixes=self.store.prefixes, tables=self.store.tables)

    def closed_store(self) -> TripleStore:
        """The store with everything the rules add."""
        added = self.infer_semi_naive()
        return TripleStore(self.store.df.select(*FACT).unionByName(added), self.store.prefixes)

    def query(self, pattern: Sequence[str]) -> DataFrame:
        """Bindings among given and derived facts; constants of the pattern steer the derivation."""
        parsed = Pattern.of(pattern, self.store.prefixes)
        added = self.derived_for(parsed)
        return TripleStore(self.store.df.select(*FACT).unionByName(added)).solutions((parsed.s, parsed.p, parsed.o))

    def inferred_query(self, pattern: Sequence[str]) -> DataFrame:
        """Bindings among derived facts only."""
        parsed = Pattern.of(pattern, self.store.prefixes)
        return TripleStore(self.derived_for(parsed)).solutions((parsed.s, parsed.p, parsed.o))

    def derived_for(self, goal: Pattern) -> DataFrame:
        """Derived facts among which are all that match the goal.

        Where the goal binds a position only facts that its bindings lead to are derived, else what the rules
        that can reach it conclude.
        """
        from trivane.plans.goals import directed, without_asked

        store = self.store
        facts, rules = store.df.select(*FACT), self.goal_rules(goal)
        if not rules:
            return facts.limit(0)
        rewritten = directed(rules, goal, store.prefixes)
        if rewritten is None:
            return infer(facts, rules, prefixes=store.prefixes, tables=store.tables)
        steered, asked = rewritten
        seeds = store.spark.createDataFrame([(*t, None) for t in asked], "s string, p string, o string, o_num double")
        # The rewritten rules hold expanded terms, so no prefix applies any more.
        return without_asked(infer(facts.unionByName(seeds), steered, tables=store.tables))

    def goal_rules(self, goal: Pattern) -> list[Rule]:
        """Rules that can contribute to the goal, found from the head predicates backwards."""
        wanted, picked = {goal.p}, []
        grown = True
        while grown:
            grown = False
            for rule in self.rules:
                if any(rule is other for other in picked):
                    continue
                heads = {c.p for c in rule.conclusions(self.store.prefixes)}
                if any(is_var(p) for p in wanted | heads) or heads & wanted:
                    picked.append(rule)
                    wanted |= {p.p for p in rule.premises(self.store.prefixes)}
                    grown = True
        return picked

    def prove(self, goal: Sequence[str], depth: int | None = None) -> DataFrame:
        """Distinct bindings of a goal, by the rules that can reach it.

        All proofs are found; ``depth`` limits the answer to proofs that nest at most so many rule applications.
        """
        parsed = Pattern.of(goal, self.store.prefixes)
        if depth is None:
            return self.query(goal).distinct()
        facts, rules = self.store.df.select(*FACT), self.goal_rules(parsed)
        if rules:
            store = self.store
            added = infer(facts, rules, max_rounds=depth, prefixes=store.prefixes, tables=store.tables)
            facts = facts.unionByName(added)
        return TripleStore(facts).solutions((parsed.s, parsed.p, parsed.o)).distinct()


def rule_alerts(store: TripleStore, predicate: str, value: str = "true") -> DataFrame:
    """Subjects for which a rule has concluded ``predicate``."""
    return store.lookup(p=predicate, o=value).select("s").distinct()


def highest_reading(store: TripleStore, alert: str, location: str, reading: str, value: str = "true") -> DataFrame:
    """Per alerted subject the highest integer reading of the sensors located there."""
    alerted = rule_alerts(store, alert, value)
    expand = store.prefixes.expand
    placed = store.df.filter(F.col("p") == expand(location)).select(F.col("s").alias("sensor"), F.col("o").alias("s"))
    readings = (
        store.df.filter(F.col("p") == expand(reading))
        .select(F.col("s").alias("sensor"), F.col("o").try_cast("bigint").alias("value"))
        .filter(F.col("value").isNotNull())
    )
    # Readings are reduced per sensor before they meet the locations.
    best = readings.groupBy("sensor").agg(F.max("value").alias("value"))
    per_place = placed.join(best, "sensor").groupBy("s").agg(F.max("value").alias("value"))
    return alerted.join(per_place, "s")
