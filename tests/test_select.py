import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane import Select, TripleStore, avg, minimum, total
from trivane.functions.durations import seconds
from trivane.functions.expressions import arith, compare, compare_arith, concat, negate, num, truthy
from trivane.functions.registry import FunctionRegistry
from trivane.terms import RDF_TYPE, Pattern, Prefixes, about


def test_terms():
    known = Prefixes({"ex": "http://example.org/"})
    assert known.expand("ex:a") == "http://example.org/a"
    assert known.expand("<http://x>") == "http://x" and known.expand('"lit"') == "lit"
    assert known.expand("other:a") == "other:a" and known.expand("http://a:b") == "http://a:b"
    assert Pattern.of(("?s", "a", "ex:T"), known) == Pattern("?s", RDF_TYPE, "http://example.org/T")
    assert seconds("PT10M") == 600 and seconds("PT1H") == 3600 and seconds("7") == 7
    with pytest.raises(ValueError):
        seconds("10 minutes")


def test_employees_younger_than_30(people):
    asked = (
        Select("?who")
        .where(
            *about("?p", ("ex:name", "?who"), ("ex:age", "?age"), ("ex:worksFor", "?c")), ("?c", "ex:name", "ACME Corp")
        )
        .filter(compare("?age", "<", 30))
    )
    assert tuples(asked.run(people)) == [("Jane Doe",)]


def test_constants_filter_in_every_position(people):
    assert len(Select("?p", "?o").where(("http://example.org/person1", "?p", "?o")).run(people).collect()) == 4
    assert tuples(Select("?o").where(("http://example.org/person1", "ex:age", "?o")).run(people)) == [("30",)]


def test_select_star_is_sorted(people):
    assert Select().where(("?z", "ex:age", "?a")).run(people).columns == ["a", "z"]


def test_constant_pattern_is_an_existence_test(people):
    fact = ("http://example.org/person1", "ex:age", "30")
    rows = Select("?s").where(("?s", "ex:industry", "?i"), fact).run(people)
    assert len(rows.collect()) == 1
    rows = Select("?s").where(("?s", "ex:industry", "?i"), (fact[0], fact[1], "31")).run(people)
    assert rows.collect() == []


@pytest.fixture(scope="module")
def edge(make_store):
    values = ["5", "7.5", "-3", "abc", "", "2024-01-02", "http://a/b-c", "5"]
    return make_store([(f"s{i}", "v", v) for i, v in enumerate(values)] + [("s0", "w", "5"), ("s1", "w", "8"), ("s3", "w", "abc")])


def values(edge, condition):
    return sorted(r.v for r in Select("?v").where(("?s", "v", "?v")).filter(condition).run(edge).collect())


def test_typed_comparison(edge):
    assert values(edge, compare("?v", ">", 4)) == ["5", "5", "7.5"]
    assert values(edge, compare("?v", "=", "5.0")) == ["5", "5"]
    assert values(edge, compare("?v", "=", "2024-01-02")) == ["2024-01-02"]
    assert values(edge, compare("?v", "=", "http://a/b-c")) == ["http://a/b-c"]
    assert values(edge, compare("?v", "!=", 5)) == ["", "-3", "2024-01-02", "7.5", "abc", "http://a/b-c"]
    assert values(edge, compare("?v", "<", "abd")) == []
    assert len(values(edge, negate(compare("?v", ">", 4)))) == 5


def test_arithmetic(edge):
    assert values(edge, compare_arith(arith(num("?v"), "*", 2), ">=", 10)) == ["5", "5", "7.5"]
    assert values(edge, compare_arith(arith(F.lit(1.0), "/", arith(num("?v"), "-", 5)), ">", -100)) == ["-3", "7.5"]
    assert values(edge, truthy(arith(num("?v"), "-", 5))) == ["-3", "7.5"]


def test_variable_against_variable(edge):
    same = Select("?s").where(("?s", "v", "?a"), ("?s", "w", "?b")).filter(compare("?a", "=", "?b")).run(edge)
    assert tuples(same) == [("s0",), ("s3",)]
    less = Select("?s").where(("?s", "v", "?a"), ("?s", "w", "?b")).filter(compare("?a", "<", "?b")).run(edge)
    assert tuples(less) == [("s1",)]


def test_repeated_variable_and_cycles(make_store):
    data = make_store([("a", "p", "a"), ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")])
    assert tuples(Select("?x").where(("?x", "p", "?x")).run(data)) == [("a",)]
    ring = Select("?x", "?y", "?z").where(("?x", "p", "?y"), ("?y", "p", "?z"), ("?z", "p", "?x")).run(data)
    assert set(tuples(ring)) == {("a", "a", "a"), ("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")}


def test_values_with_unbound_cells(make_store):
    data = make_store([("a", "p", "1"), ("b", "p", "2"), ("c", "p", "3")])
    rows = Select("?s", "?t").values(["?s", "?o", "?t"], [("a", None, "x"), (None, "2", "y"), (None, None, "z")])
    assert tuples(rows.where(("?s", "p", "?o")).run(data)) == [("a", "x"), ("a", "z"), ("b", "y"), ("b", "z"), ("c", "z")]
    alone = Select("?s").values(["?s"], [("q",)]).run(data)
    assert tuples(alone) == [("q",)]


def test_subselect_joins_and_honours_limit(make_store):
    data = make_store([(f"s{i}", "p", str(i)) for i in range(10)] + [(f"s{i}", "q", "t") for i in range(5, 10)])
    best = Select("?s", "?v").where(("?s", "p", "?v")).order_by(("?v", "desc")).limit(7)
    assert tuples(Select("?s").where(("?s", "q", "?t")).subselect(best).run(data)) == [(f"s{i}",) for i in range(5, 10)]
    assert tuples(Select("?s").where(("?s", "q", "t")).subselect(best.limit(2)).run(data)) == [("s8",), ("s9",)]


def test_bind_and_functions(people):
    labels = Select("?l").where(("?p", "ex:industry", "?i")).bind("?l", concat("<", "?i", "|", "?i", ">"))
    assert tuples(labels.run(people)) == [("<Technology|Technology>",)]
    functions = FunctionRegistry()
    functions.register("shout", lambda v, mark: F.concat(F.upper(v), mark))
    loud = Select("?l").where(("?p", "ex:industry", "?i")).call(functions, "shout", ["?i", "!"], "?l")
    assert tuples(loud.run(people)) == [("TECHNOLOGY!",)]
    with pytest.raises(KeyError):
        Select("?l").where(("?p", "ex:industry", "?i")).call(functions, "missing", ["?i"], "?l")


def test_a_bound_number_can_be_filtered(people):
    asked = Select("?d").where(("?p", "ex:age", "?a")).bind("?d", (num("?a") * 2).cast("string")).filter(compare("?d", ">", 55))
    assert tuples(asked.run(people)) == [("60.0",)]


def test_aggregates_skip_what_is_not_a_number(edge):
    rows = Select("?n", "?lo", "?m").where(("?s", "v", "?v")).agg(total("?v", "n"), minimum("?v", "lo"), avg("?v", "m"))
    assert tuples(rows.run(edge)) == [(14.5, -3.0, 14.5 / 4)]
    grouped = Select("?s", "?n").where(("?s", "w", "?v")).group_by("?s").agg(total("?v", "n")).run(edge)
    assert tuples(grouped) == [("s0", 5.0), ("s1", 8.0), ("s3", None)]


def test_order_puts_numbers_before_text(edge):
    rows = Select("?v").where(("?s", "v", "?v")).order_by("?v").run(edge)
    assert [r.v for r in rows.collect()] == ["-3", "5", "5", "7.5", "", "2024-01-02", "abc", "http://a/b-c"]


def test_unbound_prints_as_empty(people):
    rows = Select("?i", "?nothing").where(("?p", "ex:industry", "?i"))
    assert tuples(rows.run(people)) == [("Technology", None)]
    assert tuples(rows.rows_as_text(people)) == [("Technology", "")]


def test_unrelated_patterns_of_any_size(make_store):
    data = make_store([(f"s{i}", "p", "x") for i in range(20)] + [("a", "q", "1"), ("b", "q", "2")])
    asked = Select("?s", "?t").where(("?s", "p", "x"), ("?t", "q", "?v"))
    found = asked.run(data)
    assert len(set(found.collect())) == len(found.collect()) == 40
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_store_changes(spark, make_store):
    data = make_store([("a", "p", "1"), ("b", "p", "2")])
    more = data.add_rows([("a", "p", "1"), ("c", "p", "3"), ("c", "p", "3")])
    assert tuples(more.lookup()) == [("a", "p", "1"), ("b", "p", "2"), ("c", "p", "3")]
    gone = spark.createDataFrame([("b", "p", "2"), ("z", "p", "9")], "s string, p string, o string")
    assert tuples(more.remove(gone).lookup()) == [("a", "p", "1"), ("c", "p", "3")]
    assert tuples(more.removed(gone)) == [("b", "p", "2")]
    assert more.contains("c", "p", "3") and not data.contains("c", "p", "3")
    assert tuples(data.third(p="p", o="2")) == [("b",)]
    assert tuples(data.union(make_store([("b", "p", "2"), ("d", "p", "4")])).lookup()) == [("a", "p", "1"), ("b", "p", "2"), ("d", "p", "4")]
    with pytest.raises(ValueError):
        data.third(s="a")


def test_insert_where_fills_the_template(people):
    found = Select("?p", "?c").where(("?p", "ex:worksFor", "?c")).solutions(people)
    grown = people.insert_where([("?c", "ex:employs", "?p"), ("?p", "ex:employed", "true")], found)
    assert len(grown.lookup().collect()) == 15
    with pytest.raises(ValueError):
        people.insert_where([("?c", "ex:x", "?missing")], found)


def test_insert_leaves_the_stored_rows_alone(spark):
    rows = spark.createDataFrame([("a", "p", "1"), ("a", "p", "1")], "s string, p string, o string")
    for n in (1, 3000):
        more = TripleStore(rows).add_rows([("a", "p", "1"), *[(f"b{k}", "p", "2") for k in range(n)], ("b0", "p", "2")])
        assert more.lookup().count() == 2 + n


def test_predicates_stay_text_when_saved(make_store, spark, tmp_path):
    data = make_store([("x", "01", "a"), ("x", "1", "b"), ("y", "1", "c")])
    data.save(str(tmp_path / "numbers"), rows_per_file=1)
    assert tuples(TripleStore.load(spark, str(tmp_path / "numbers")).lookup()) == tuples(data.lookup())


def test_type_shorthand_in_data_and_queries(make_store):
    data = make_store([("x", "a", "Person")])
    assert tuples(Select("?x").where(("?x", "a", "Person")).run(data)) == [("x",)]
    assert len(tuples(data.lookup(p="a"))) == 1


def test_words_and_suffixes_are_no_numbers(make_store):
    data = make_store([(f"s{k}", "p", o) for k, o in enumerate(["nan", "1d", "1f", "inf", "6", "1", "-.5e1", " 7 "])])
    ask = lambda op, value: [r[0] for r in tuples(Select("?s").where(("?s", "p", "?o")).filter(compare("?o", op, value)).run(data))]
    assert ask(">", 5) == ["s4", "s7"] and ask("=", 1) == ["s5"] and ask("<", 0) == ["s6"]


def test_save_and_load(people, spark, tmp_path):
    people.save(str(tmp_path / "store"))
    again = TripleStore.load(spark, str(tmp_path / "store"))
    assert tuples(again.lookup()) == tuples(people.lookup())
    plan = again.lookup(p="ex:age")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
