"""Joins between two triple relations; every result is a set of triples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.operators.bgp import weight
from trivane.operators.skew import salted_join
from trivane.session import materialize

SPO = ["s", "p", "o"]
# A side of a join on the predicate is folded into one value if its counted bytes are at most these.
SMALL_BYTES = 8 << 20
# A task of a band join compares about this many pairs.
PAIRS_PER_TASK = 1 << 20


@dataclass(frozen=True)
class Band:
    """``|left - right| <= width`` between a left and a right number, written over ``l_*``/``r_*`` columns."""

    left: str
    right: str
    width: float


def sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _emit(joined: DataFrame, s: str, p: str, o: str) -> DataFrame:
    number = f"{o[0]}_o_num"
    return joined.select(
        F.col(s).alias("s"), F.col(p).alias("p"), F.col(o).alias("o"), F.col(number).alias("o_num")
    ).dropDuplicates(SPO)


def on_subject(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l.s, l.p, r.o); both sides are reduced to what is emitted.

    The objects of a hot subject are dealt over tasks, and its predicates are repeated for each.
    """
    predicates = left.select("s", "p").distinct()
    objects = right.select("s", "o", "o_num").dropDuplicates(["s", "o"])
    return salted_join(objects, predicates, ["s"]).select("s", "p", "o", "o_num").dropDuplicates(SPO)


def on_predicate(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l.s, l.p, r.o).

    Both sides are reduced to what is emitted.  One predicate may cover most rows, so the smaller side is
    folded into one value, predicate to objects, while its counted bytes allow; beyond that the join is
    salted.
    """
    l_side = left.select("s", "p").distinct()
    r_side = right.select("p", "o", "o_num").dropDuplicates(["p", "o"])
    if weight(r_side) <= SMALL_BYTES:
        joined = _unfold(l_side, r_side)
    elif weight(l_side) <= SMALL_BYTES:
        joined = _unfold(r_side, l_side)
    else:
        joined = salted_join(l_side, r_side, ["p"])
    return joined.select("s", "p", "o", "o_num").dropDuplicates(SPO)


def _unfold(large: DataFrame, small: DataFrame) -> DataFrame:
    """Join on ``p`` with a side of checked size, held as a map from predicate to rows."""
    rest = [c for c in small.columns if c != "p"]
    groups = small.groupBy("p").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    lookup = groups.agg(F.map_from_entries(F.collect_list(F.struct("p", "rows")))).scalar()
    return large.withColumn("__row", F.explode(lookup[F.col("p")])).select(*large.columns, "__row.*")


def on_object(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l.s, r.p, r.o); an object shared by many left subjects is salted."""
    l_side = left.select("s", "o").distinct()
    r_side = right.select("p", "o", "o_num").dropDuplicates(["p", "o"])
    return salted_join(l_side, r_side, ["o"]).select("s", "p", "o", "o_num").dropDuplicates(SPO)


def theta(
    left: DataFrame,
    right: DataFrame,
    equal: Sequence[tuple[str, str]] = (),
    band: Band | None = None,
    where: Column | None = None,
) -> DataFrame:
    """(l.s, r.p, r.o) for pairs that meet the condition.

    ``equal`` lists (left, right) column pairs and ``band`` a numeric distance; at least one of them is
    needed, because a bare condition would compare every row with every other.  A band joins on cells of
    its own width: the left row looks into its cell and both neighbours.  Cells are dealt over as many tasks as their
    counted pairs need, and one with more pairs than a task compares is cut into pieces.  Without ``where`` both sides are
    first reduced to what is compared and emitted.
    """
    if not equal and band is None:
        raise ValueError("a theta join needs an equality or a band")
    if where is None:
        left = _reduced(left, ["s"], [a for a, _ in equal], band and band.left)
        right = _reduced(right, ["p", "o", "o_num"], [b for _, b in equal], band and band.right)
    l_side, r_side = sided(left, "l"), sided(right, "r")
    keys = [F.col(f"l_{a}") == F.col(f"r_{b}") for a, b in equal]
    if band is not None:
        cell = F.floor(F.col(f"l_{band.left}") / F.lit(band.width)).cast("bigint")
        cells = F.explode(F.array(cell - 1, cell, cell + 1))
        l_side = l_side.filter(F.col(f"l_{band.left}").isNotNull()).withColumn("l_cell", cells)
        r_cell = F.floor(F.col(f"r_{band.right}") / F.lit(band.width)).cast("bigint")
        r_side = r_side.filter(F.col(f"r_{band.right}").isNotNull()).withColumn("r_cell", r_cell)
        distance = F.abs(F.col(f"l_{band.left}") - F.col(f"r_{band.right}"))
        l_side, r_side = _dealt(l_side, r_side, [*[(f"l_{a}", f"r_{b}") for a, b in equal], ("l_cell", "r_cell")])
        keys += [F.col("l_cell") == F.col("r_cell"), F.col("l_piece") == F.col("r_piece"), distance <= F.lit(band.width)]
    condition = keys[0]
    for extra in keys[1:]:
        condition = condition & extra
    if where is not None:
        condition = condition & where
    return _emit(l_side.join(r_side, condition), "l_s", "r_p", "r_o")


def _reduced(df: DataFrame, emitted: Sequence[str], equal: Sequence[str], number: str | None) -> DataFrame:
    wanted = dict.fromkeys([*emitted, *equal, *([number] if number else [])])
    return df.select(*wanted).distinct()


def _dealt(l_side: DataFrame, r_side: DataFrame, keys: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Both sides by key and ``piece``, over so many tasks that each compares about PAIRS_PER_TASK pairs.

    The left rows of a key with more pairs are dealt over pieces, and its right rows are repeated for each.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    l_keys, r_keys = [a for a, _ in keys], [b for _, b in keys]
    count = lambda df, own, n: df.groupBy(*[F.col(c).alias(k) for c, k in zip(own, names, strict=True)]).agg(F.count("*").alias(n))
    pairs = count(l_side, l_keys, "l_n").join(count(r_side, r_keys, "r_n"), names)
    pairs = materialize(pairs.select(*names, (F.col("l_n") * F.col("r_n")).alias("n")), "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS_PER_TASK))
    pieces = F.ceil(F.col("n") / F.lit(PAIRS_PER_TASK)).cast("int").alias("__pieces")
    cut = materialize(pairs.filter(F.col("n") > PAIRS_PER_TASK).select(*names, pieces), "pieces")

    def cut_up(df: DataFrame, own: list[str]) -> DataFrame:
        own_cut = cut.select(*[F.col(k).alias(c) for c, k in zip(own, names, strict=True)], "__pieces")
        return df.join(own_cut, own, "left").withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))

    dealt = F.pmod(F.xxhash64(*l_side.columns), F.col("__pieces")).cast("int")
    l_cut = cut_up(l_side, l_keys).withColumn("l_piece", dealt).drop("__pieces")
    every = F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))
    r_cut = cut_up(r_side, r_keys).withColumn("r_piece", every).drop("__pieces")
    return l_cut.repartition(tasks, *l_keys, "l_piece"), r_cut.repartition(tasks, *r_keys, "r_piece")


def store_join(left: DataFrame, right: DataFrame, predicate: str) -> DataFrame:
    """Chain two stores over one predicate: the left object is the right subject or the right object.

    Emits (l.s, predicate, r.o).  When the left object is the right object the emitted triple is the left
    one itself, so that case is a semi-join.
    """
    l_side = left.filter(F.col("p") == predicate)
    r_side = right.filter(F.col("p") == predicate)
    over_subject = (
        sided(l_side.select("s", "o"), "l")
        .join(sided(r_side, "r"), F.col("l_o") == F.col("r_s"))
        .select(F.col("l_s").alias("s"), F.col("r_p").alias("p"), F.col("r_o").alias("o"), F.col("r_o_num").alias("o_num"))
    )
    over_object = l_side.join(r_side.select("o"), "o", "left_semi").select("s", "p", "o", "o_num")
    return over_subject.unionByName(over_object).dropDuplicates(SPO)
