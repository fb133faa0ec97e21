"""Property tables found from triples answer stars as the triples do, without a shuffle."""

import random

import pytest

from tests.conftest import tuples
from trivane import Select, TripleStore
from trivane.operators.characteristic import load_tables, save_tables, single_valued

SCHEMA = "s string, p string, o string, o_num double"


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Subjects with many sets of predicates, one predicate with several objects, one with numbers only."""
    draw = random.Random(6)
    rows = []
    for k in range(200):
        for p in draw.sample(["name", "age", "http://e/x.y", "kind"], draw.randint(0, 4)):
            rows.append((f"s{k}", p, f"{p[:2]}{draw.randint(0, 5)}", None))
        rows += [(f"s{k}", "tag", f"t{j}", None) for j in range(draw.randint(0, 2))]
        if k % 3 == 0:
            rows.append((f"s{k}", "weight", None, float(k)))
    path = str(tmp_path_factory.mktemp("stored") / "store")
    flat = TripleStore(spark.createDataFrame(rows, SCHEMA))
    flat.save_with_tables(path, rows_per_file=100)
    return flat, TripleStore.load_with_tables(spark, path)


STARS = [
    [("?s", "name", "?n"), ("?s", "age", "?a")],
    [("?s", "name", "na3"), ("?s", "http://e/x.y", "?x"), ("?s", "kind", "?k")],
    [("?s", "name", "?v"), ("?s", "age", "?w"), ("?s", "tag", "?t")],
    [("?s", "name", "?v"), ("?r", "kind", "?k"), ("?r", "age", "?w"), ("?s", "kind", "?k")],
    [("s3", "name", "?v")],
    [("?s", "unknown", "?v"), ("?s", "name", "?n")],
]


@pytest.mark.parametrize("patterns", STARS)
def test_stars_over_tables_are_those_over_triples(mixed, patterns):
    flat, stored = mixed
    assert tuples(Select().where(*patterns).run(stored)) == tuples(Select().where(*patterns).run(flat))


def test_a_star_is_a_scan(mixed):
    _, stored = mixed
    plan = Select().where(*STARS[0]).run(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_predicates_that_become_columns(mixed):
    flat, _ = mixed
    assert set(single_valued(flat.df)) == {"name", "age", "http://e/x.y", "kind"}


def test_sets_beyond_the_tables_of_their_own_share_one(spark, mixed, tmp_path):
    flat, _ = mixed
    save_tables(flat.df, str(tmp_path / "t"), most_sets=2)
    tables = load_tables(spark, str(tmp_path / "t"))
    assert len(tables) == 3
    few = TripleStore(flat.df, tables=tables)
    for patterns in STARS[:3]:
        assert tuples(Select().where(*patterns).run(few)) == tuples(Select().where(*patterns).run(flat))


def test_no_column_and_no_triple(spark, tmp_path):
    several = spark.createDataFrame([("a", "p", "1", None), ("a", "p", "2", None)], SCHEMA)
    for name, df in (("several", several), ("none", several.limit(0))):
        save_tables(df, str(tmp_path / name))
        assert load_tables(spark, str(tmp_path / name)) == []
