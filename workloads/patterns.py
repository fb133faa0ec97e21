"""Graph patterns, filters, bindings, VALUES, subselects, aggregation and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions.expressions import arith, compare, compare_arith, concat, negate, num, truthy
from trivane.functions.registry import FunctionRegistry
from trivane.query import Select, avg, maximum, minimum, total
from trivane.session import new_step_dir
from trivane.sources.text import read_ntriples, write_ntriples
from trivane.store import TripleStore
from trivane.terms import about
from workloads.registry import query
from workloads.tables import LINE, store, table, with_triples

SHOP = ("region", "nation", "customer", "orders")


def shop(spark, sf):
    return store(spark, sf, *SHOP)


@query(
    "region_revenue",
    """SELECT r_name AS region, c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue, max(o_totalprice) AS largest
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY ALL""",
)
def region_revenue(spark, sf):
    """Chain of five patterns with a numeric filter and two aggregates."""
    found = (
        Select("?region", "?segment", "?revenue", "?largest")
        .where(
            ("?o", "placedBy", "?c"),
            ("?o", "total", "?total"),
            *about("?c", ("partOf", "?n"), ("segment", "?segment"), ("balance", "?balance")),
            ("?n", "partOf", "?r"),
            ("?r", "name", "?region"),
        )
        .filter(compare("?balance", ">", 0))
        .group_by("?region", "?segment")
        .agg(total("?total", "revenue"), maximum("?total", "largest"))
        .run(shop(spark, sf))
    )
    return found.withColumn("revenue", F.round("revenue", 2))


@query("select_vars", "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def select_vars(spark, sf):
    return Select("?name", "?segment").where(("?c", "name", "?name"), ("?c", "segment", "?segment")).run(shop(spark, sf))


@query(
    "select_star",
    "SELECT concat('customer/', c_custkey) AS c, concat('nation/', c_nationkey) AS n, c_mktsegment AS seg FROM customer",
)
def select_star(spark, sf):
    return Select().where(("?c", "segment", "?seg"), ("?c", "partOf", "?n")).run(shop(spark, sf))


@query(
    "bgp_star",
    """SELECT concat('order/', o_orderkey) AS o, o_orderstatus AS status, o_orderpriority AS priority,
       cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS total FROM orders""",
)
def bgp_star(spark, sf):
    star = about("?o", ("status", "?status"), ("priority", "?priority"), ("total", "?total"))
    return Select("?o", "?status", "?priority", "?total").where(*star).run(shop(spark, sf))


@query(
    "bgp_constants",
    """SELECT concat('customer/', c_custkey) AS c, concat('nation/', c_nationkey) AS n FROM customer JOIN nation
       ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 1""",
)
def bgp_constants(spark, sf):
    return (
        Select("?c", "?n")
        .where(("?c", "segment", "BUILDING"), ("?c", "partOf", "?n"), ("?n", "partOf", "region/1"))
        .run(shop(spark, sf))
    )


@query("bgp_constant_subject", with_triples("SELECT p, o FROM triples WHERE s = 'nation/7'", *SHOP))
def bgp_constant_subject(spark, sf):
    return Select("?p", "?o").where(("nation/7", "?p", "?o")).run(shop(spark, sf))


JOIN2 = """SELECT concat('order/', o_orderkey) AS o, c_mktsegment AS seg FROM orders JOIN customer
           ON o_custkey = c_custkey"""


def _join2(spark, sf, strategy, data=None):
    return (
        Select("?o", "?seg")
        .where(("?o", "placedBy", "?c"), ("?c", "segment", "?seg"))
        .strategy(strategy)
        .run(data or shop(spark, sf))
    )


def loaded(spark, sf):
    """The shop as N-Triples files, read, saved with the property tables found in it, and loaded."""
    folder = new_step_dir(spark, "loaded")
    write_ntriples(TripleStore(shop(spark, sf).df).df, f"{folder}/nt")
    TripleStore.of(read_ntriples(spark, f"{folder}/nt")).save_with_tables(f"{folder}/store")
    return TripleStore.load_with_tables(spark, f"{folder}/store")


@query(
    "bgp_star_stored",
    """SELECT concat('order/', o_orderkey) AS o, o_orderstatus AS status, o_orderpriority AS priority,
       cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS total FROM orders""",
)
def bgp_star_stored(spark, sf):
    """A star over loaded triples: one scan of the table of its subjects."""
    star = about("?o", ("status", "?status"), ("priority", "?priority"), ("total", "?total"))
    return Select("?o", "?status", "?priority", "?total").where(*star).run(loaded(spark, sf))


@query("bgp_join2_stored", JOIN2)
def bgp_join2_stored(spark, sf):
    """Two stars of loaded triples that meet in one join."""
    return _join2(spark, sf, "auto", loaded(spark, sf))


@query("bgp_join2", JOIN2)
def bgp_join2(spark, sf):
    return _join2(spark, sf, "auto")


@query("bgp_join2_merge", JOIN2)
def bgp_join2_merge(spark, sf):
    return _join2(spark, sf, "merge")


@query("bgp_join2_shuffle_hash", JOIN2)
def bgp_join2_shuffle_hash(spark, sf):
    return _join2(spark, sf, "shuffle_hash")


@query("bgp_join2_broadcast", JOIN2)
def bgp_join2_broadcast(spark, sf):
    return _join2(spark, sf, "broadcast")


@query(
    "bgp_chain3",
    f"""SELECT {LINE} AS l, concat('nation/', c_nationkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey""",
)
def bgp_chain3(spark, sf):
    return (
        Select("?l", "?n")
        .where(("?l", "inOrder", "?o"), ("?o", "placedBy", "?c"), ("?c", "partOf", "?n"))
        .run(store(spark, sf, "lineitem", "orders", "customer"))
    )


@query(
    "bgp_triangle",
    """SELECT concat('order/', o_orderkey) AS o, concat('supplier/', s_suppkey) AS s, concat('nation/', c_nationkey) AS n
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey""",
)
def bgp_triangle(spark, sf):
    """The last pattern closes a cycle: customer and supplier live in the same nation."""
    return (
        Select("?o", "?s", "?n")
        .where(
            ("?l", "inOrder", "?o"),
            ("?o", "placedBy", "?c"),
            ("?c", "partOf", "?n"),
            ("?l", "supplier", "?s"),
            ("?s", "partOf", "?n"),
        )
        .run(store(spark, sf, "lineitem", "orders", "customer", "supplier"))
    )


@query(
    "bgp_cross",
    """SELECT concat('customer/', c_custkey) AS c, concat('nation/', n_nationkey) AS n FROM customer, nation
       WHERE n_regionkey = 0""",
)
def bgp_cross(spark, sf):
    """Two unrelated patterns; the one of checked small size is attached to each row of the other."""
    return Select("?c", "?n").where(("?c", "segment", "?g"), ("?n", "partOf", "region/0")).run(shop(spark, sf))


@query(
    "bgp_self_loop",
    "SELECT DISTINCT concat('key/', l_partkey) AS x FROM lineitem WHERE l_partkey = l_suppkey",
)
def bgp_self_loop(spark, sf):
    pairs = table(spark, sf, "lineitem").selectExpr(
        "concat('key/', l_partkey) AS s", "'pairedWith' AS p", "concat('key/', l_suppkey) AS o"
    )
    return Select("?x").where(("?x", "pairedWith", "?x")).run(TripleStore.of(pairs))


# -- filters -------------------------------------------------------------------------------------------


@query("filter_numeric", "SELECT c_name AS name FROM customer WHERE c_acctbal >= 5000")
def filter_numeric(spark, sf):
    return (
        Select("?name").where(("?c", "name", "?name"), ("?c", "balance", "?b")).filter(compare("?b", ">=", 5000))
    ).run(shop(spark, sf))


@query("filter_string", "SELECT c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_string(spark, sf):
    return (
        Select("?name").where(("?c", "name", "?name"), ("?c", "segment", "?g")).filter(compare("?g", "!=", "BUILDING"))
    ).run(shop(spark, sf))


PART_NAMES = "concat('part/', p_partkey) AS x, cast(p_size AS varchar) AS size FROM part WHERE"


def _parts(spark, sf, condition):
    rows = Select("?x", "?size").where(*about("?x", ("size", "?size"), ("brand", "?brand"), ("price", "?price")))
    return rows.filter(condition).run(store(spark, sf, "part"))


@query("filter_and", f"SELECT {PART_NAMES} p_size > 10 AND p_brand = 'Brand#17'")
def filter_and(spark, sf):
    return _parts(spark, sf, compare("?size", ">", 10) & compare("?brand", "=", "Brand#17"))


@query("filter_or", f"SELECT {PART_NAMES} p_size < 5 OR p_brand = 'Brand#17'")
def filter_or(spark, sf):
    return _parts(spark, sf, compare("?size", "<", 5) | compare("?brand", "=", "Brand#17"))


@query("filter_not", f"SELECT {PART_NAMES} NOT (p_size > 10 AND p_brand <> 'Brand#2')")
def filter_not(spark, sf):
    return _parts(spark, sf, negate(compare("?size", ">", 10) & compare("?brand", "!=", "Brand#2")))


@query("filter_not_error", f"SELECT {PART_NAMES} true")
def filter_not_error(spark, sf):
    """An ordered comparison of text cannot be evaluated, so its negation holds everywhere."""
    return _parts(spark, sf, negate(compare("?brand", "<", "Brand#3")))


@query("filter_arith", f"SELECT {PART_NAMES} p_size * 2 + 3 > p_retailprice / 20 - 1")
def filter_arith(spark, sf):
    left = arith(arith(num("?size"), "*", 2), "+", 3)
    right = arith(arith(num("?price"), "/", 20), "-", 1)
    return _parts(spark, sf, compare_arith(left, ">", right))


@query("filter_arith_zero", f"SELECT {PART_NAMES} p_size <> 7 AND 100 / nullif(p_size - 7, 0) > 4")
def filter_arith_zero(spark, sf):
    quotient = arith(F.lit(100.0), "/", arith(num("?size"), "-", 7))
    return _parts(spark, sf, compare_arith(quotient, ">", 4))


@query("filter_truthy", f"SELECT {PART_NAMES} p_size - 12 <> 0")
def filter_truthy(spark, sf):
    return _parts(spark, sf, truthy(arith(num("?size"), "-", 12)))


@query(
    "filter_var_var",
    """SELECT concat('order/', o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_totalprice < c_acctbal""",
)
def filter_var_var(spark, sf):
    return (
        Select("?o")
        .where(("?o", "placedBy", "?c"), ("?o", "total", "?t"), ("?c", "balance", "?b"))
        .filter(compare("?t", "<", "?b"))
        .run(shop(spark, sf))
    )


# -- VALUES, subselect, BIND ---------------------------------------------------------------------------


@query(
    "values_single",
    "SELECT concat('customer/', c_custkey) AS c, c_mktsegment AS g FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def values_single(spark, sf):
    return (
        Select("?c", "?g").values(["?g"], [("BUILDING",), ("MACHINERY",)]).where(("?c", "segment", "?g"))
    ).run(shop(spark, sf))


@query(
    "values_multi",
    """SELECT concat('order/', o_orderkey) AS o FROM orders WHERE (o_orderstatus, o_orderpriority) IN
       (('F', '1-URGENT'), ('O', '5-LOW'))""",
)
def values_multi(spark, sf):
    return (
        Select("?o")
        .values(["?s", "?p"], [("F", "1-URGENT"), ("O", "5-LOW")])
        .where(("?o", "status", "?s"), ("?o", "priority", "?p"))
        .run(shop(spark, sf))
    )


@query(
    "values_undef",
    """SELECT concat('order/', o_orderkey) AS o, tag FROM orders JOIN (VALUES ('F', '1-URGENT', 'a'), ('O', NULL, 'b'),
       (NULL, '5-LOW', 'c')) v(s, p, tag) ON (s IS NULL OR o_orderstatus = s) AND (p IS NULL OR o_orderpriority = p)""",
)
def values_undef(spark, sf):
    return (
        Select("?o", "?tag")
        .values(["?s", "?p", "?tag"], [("F", "1-URGENT", "a"), ("O", None, "b"), (None, "5-LOW", "c")])
        .where(("?o", "status", "?s"), ("?o", "priority", "?p"))
        .run(shop(spark, sf))
    )


@query(
    "subselect",
    """WITH rich AS (SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_name, concat('customer/', c_custkey) LIMIT 50)
       SELECT concat('order/', o_orderkey) AS o, c_name AS name FROM orders JOIN rich ON o_custkey = c_custkey""",
)
def subselect(spark, sf):
    """Orders of the fifty customers with the highest balance; the inner limit counts."""
    rich = (
        Select("?c", "?name")
        .where(("?c", "name", "?name"), ("?c", "balance", "?b"))
        .order_by(("?b", "desc"), "?name", "?c")
        .limit(50)
    )
    return Select("?o", "?name").where(("?o", "placedBy", "?c")).subselect(rich).run(shop(spark, sf))


@query(
    "subselect_aggregate",
    """SELECT concat('order/', o_orderkey) AS o FROM orders JOIN (SELECT o_custkey AS k, max(o_totalprice) AS m
       FROM orders GROUP BY 1) ON o_custkey = k AND o_totalprice = m""",
)
def subselect_aggregate(spark, sf):
    largest = (
        Select("?c", "?most").where(("?x", "placedBy", "?c"), ("?x", "total", "?t")).group_by("?c").agg(maximum("?t", "most"))
    )
    return (
        Select("?o")
        .where(("?o", "placedBy", "?c"), ("?o", "total", "?t"))
        .subselect(largest)
        .filter(compare("?t", "=", "?most"))
        .run(shop(spark, sf))
    )


@query(
    "bind_concat",
    "SELECT concat(c_name, ' [', c_mktsegment, ']') AS label FROM customer",
)
def bind_concat(spark, sf):
    return (
        Select("?label")
        .where(("?c", "name", "?n"), ("?c", "segment", "?g"))
        .bind("?label", concat("?n", " [", "?g", "]"))
        .run(shop(spark, sf))
    )


@query("bind_udf", "SELECT concat(lower(c_mktsegment), ':', reverse(c_name)) AS code FROM customer")
def bind_udf(spark, sf):
    functions = FunctionRegistry()
    functions.register("code", lambda g, sep, n: F.concat(F.lower(g), sep, F.reverse(n)))
    return (
        Select("?code")
        .where(("?c", "name", "?n"), ("?c", "segment", "?g"))
        .call(functions, "code", ["?g", ":", "?n"], "?code")
        .run(shop(spark, sf))
    )


# -- aggregation and order -----------------------------------------------------------------------------


def _orders_by_priority(spark, sf, *aggregates):
    return (
        Select("?p", *[f"?{a.alias}" for a in aggregates])
        .where(("?o", "priority", "?p"), ("?o", "total", "?t"))
        .group_by("?p")
        .agg(*aggregates)
        .run(shop(spark, sf))
    )


@query("agg_sum", "SELECT o_orderpriority AS p, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1")
def agg_sum(spark, sf):
    return _orders_by_priority(spark, sf, total("?t", "v")).withColumn("v", F.round("v", 2))


@query("agg_min", "SELECT o_orderpriority AS p, min(o_totalprice) AS v FROM orders GROUP BY 1")
def agg_min(spark, sf):
    return _orders_by_priority(spark, sf, minimum("?t", "v"))


@query("agg_max", "SELECT o_orderpriority AS p, max(o_totalprice) AS v FROM orders GROUP BY 1")
def agg_max(spark, sf):
    return _orders_by_priority(spark, sf, maximum("?t", "v"))


@query("agg_avg", "SELECT o_orderpriority AS p, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1")
def agg_avg(spark, sf):
    return _orders_by_priority(spark, sf, avg("?t", "v")).withColumn("v", F.round("v", 4))


@query(
    "agg_multi",
    """SELECT o_orderpriority AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY 1""",
)
def agg_multi(spark, sf):
    rows = _orders_by_priority(spark, sf, minimum("?t", "lo"), maximum("?t", "hi"), total("?t", "total"))
    return rows.withColumn("total", F.round("total", 2))


@query(
    "agg_group",
    """SELECT c_mktsegment AS g, concat('nation/', c_nationkey) AS n, max(c_acctbal) AS hi FROM customer GROUP BY ALL""",
)
def agg_group(spark, sf):
    return (
        Select("?g", "?n", "?hi")
        .where(*about("?c", ("segment", "?g"), ("partOf", "?n"), ("balance", "?b")))
        .group_by("?g", "?n")
        .agg(maximum("?b", "hi"))
        .run(shop(spark, sf))
    )


@query("agg_global", "SELECT round(sum(c_acctbal), 2) AS s, min(c_acctbal) AS lo FROM customer")
def agg_global(spark, sf):
    rows = Select("?s", "?lo").where(("?c", "balance", "?b")).agg(total("?b", "s"), minimum("?b", "lo"))
    return rows.run(shop(spark, sf)).withColumn("s", F.round("s", 2))


@query("agg_non_numeric", "SELECT CAST(NULL AS DOUBLE) AS s FROM (SELECT count(*) FROM customer)")
def agg_non_numeric(spark, sf):
    """Text does not count as a number."""
    return Select("?s").where(("?c", "segment", "?g")).agg(total("?g", "s")).run(shop(spark, sf))


@query("order_by", "SELECT concat('part/', p_partkey) AS x, cast(p_size AS varchar) AS size FROM part")
def order_by(spark, sf):
    return Select("?x", "?size").where(("?x", "size", "?size")).order_by(("?size", "desc"), "?x").run(store(spark, sf, "part"))


@query(
    "order_limit",
    """SELECT concat('order/', o_orderkey) AS o, o_orderpriority AS p FROM orders
       ORDER BY o_orderpriority, o_totalprice DESC, concat('order/', o_orderkey) LIMIT 100""",
)
def order_limit(spark, sf):
    return (
        Select("?o", "?p")
        .where(("?o", "priority", "?p"), ("?o", "total", "?t"))
        .order_by("?p", ("?t", "desc"), "?o")
        .limit(100)
        .run(shop(spark, sf))
    )
