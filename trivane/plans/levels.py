"""Facts on reasoning levels: rules within a level, rules across levels, certainty."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.plans.rules import FACT, Rule, apply_rule, infer, union_all
from trivane.session import materialize
from trivane.store import SPO, with_number

# The levels in order, and the certainty of a fact first found on each of them.
LEVELS = ["base", "deductive", "abductive", "meta"]
CERTAINTY = {"base": 1.0, "deductive": 0.9, "abductive": 0.6, "meta": 0.4}
UNKNOWN_CERTAINTY = 0.0


@dataclass(frozen=True)
class LevelRule:
    """A rule that reads the dependency levels once and concludes into ``level``."""

    rule: Rule
    level: str
    dependencies: Sequence[str]
    priority: int = 0


class LevelStore:
    """Facts with a ``level`` column."""

    def __init__(self, df: DataFrame) -> None:
        self.df = with_number(df).select("level", *FACT)
        self._local: dict[str, list[Rule]] = {level: [] for level in LEVELS}
        self._across: list[LevelRule] = []

    def add_rule_at_level(self, rule: Rule, level: str, priority: int = 0) -> None:
        """A rule of a level: runs inside the level, and once over the base level and the level itself."""
        self._local[level].append(rule)
        self._across.append(LevelRule(rule, level, list(dict.fromkeys(["base", level])), priority))

    def add_cross_level_rule(self, rule: LevelRule) -> None:
        self._across.append(rule)

    def _at(self, facts: DataFrame, levels: Sequence[str]) -> DataFrame:
        return facts.filter(F.col("level").isin(*levels)).select(*FACT)

    def infer(self) -> LevelStore:
        """Level by level: the level's own fixpoint, then each rule that targets the level, once."""
        facts = self.df
        for level in LEVELS:
            if self._local[level]:
                found = infer(self._at(facts, [level]), self._local[level])
                facts = facts.unionByName(found.select(F.lit(level).alias("level"), *FACT))
            for cross in self._across:
                if cross.level != level:
                    continue
                seen = self._at(facts, cross.dependencies).dropDuplicates(SPO)
                concluded = apply_rule(cross.rule, lambda i, seen=seen: seen).dropDuplicates(SPO)
                fresh = concluded.join(self._at(facts, [level]).select(*SPO), SPO, "left_anti")
                added = materialize(fresh.select(*FACT), "level-rule")
                facts = facts.unionByName(added.select(F.lit(level).alias("level"), *FACT))
        result = LevelStore(facts)
        result._local, result._across = self._local, self._across
        return result

    def lookup(
        self, level: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None
    ) -> DataFrame:
        found = self.df
        for place, term in zip(["level", *SPO], (level, s, p, o)):
            if term is not None:
                found = found.filter(F.col(place) == F.lit(term))
        return found.select("level", *SPO)

    def certainty(self, facts: DataFrame) -> DataFrame:
        """Certainty of each asked fact, from the lowest level that holds it."""
        rank = F.create_map(*[x for i, name in enumerate(LEVELS) for x in (F.lit(name), F.lit(i))])
        lowest = self.df.groupBy(*SPO).agg(F.min(rank[F.col("level")]).alias("__rank"))
        scale = F.lit(None).cast("double")
        for i, name in enumerate(LEVELS):
            scale = F.when(F.col("__rank") == i, F.lit(CERTAINTY[name])).otherwise(scale)
        asked = facts.select(*SPO).distinct().join(lowest, SPO, "left")
        return asked.select(*SPO, F.coalesce(scale, F.lit(UNKNOWN_CERTAINTY)).alias("certainty"))


def at_level(level: str, *stores: DataFrame) -> DataFrame:
    """Tag facts with a level."""
    return union_all([with_number(df).select(F.lit(level).alias("level"), *FACT) for df in stores])
