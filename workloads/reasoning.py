"""Rules, goal queries, constraints, repairs and reasoning levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions.expressions import compare
from trivane.plans.constraints import (
    Denial,
    answers_in_all_repairs,
    infer_with_repair,
    removed_by_repair,
    violations,
)
from trivane.plans.levels import LevelRule, LevelStore, at_level
from trivane.plans.rules import Rule, RuleBase, highest_reading
from trivane.store import TripleStore
from workloads.registry import query
from workloads.tables import store, table, triples_sql, with_triples

SPO = ["s", "p", "o"]


def recursive(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + select


def places(spark, sf):
    return store(spark, sf, "region", "nation", "customer", "supplier")


def tree(spark, sf):
    return TripleStore(store(spark, sf, "part").df.filter("p = 'parent'"))


ABOVE = [
    Rule([("?x", "parent", "?y")], [("?x", "above", "?y")]),
    Rule([("?x", "parent", "?y"), ("?y", "above", "?z")], [("?x", "above", "?z")]),
]
# Doubling: the path length doubles per round, so the rounds grow with the logarithm of the depth.
ABOVE_DOUBLING = [ABOVE[0], Rule([("?x", "above", "?y"), ("?y", "above", "?z")], [("?x", "above", "?z")])]

PART_EDGE = """edge(x, y) AS (SELECT concat('part/', p_partkey), concat('part/', cast(floor(p_partkey / 2) AS bigint))
    FROM part WHERE p_partkey > 1)"""
PART_ABOVE = PART_EDGE, "up(x, y) AS (SELECT x, y FROM edge UNION SELECT u.x, e.y FROM up u JOIN edge e ON u.y = e.x)"


@query(
    "kg_rule_single",
    "SELECT concat('order/', o_orderkey) AS s, 'large' AS p, concat('customer/', o_custkey) AS o FROM orders WHERE o_totalprice > 300000",
)
def kg_rule_single(spark, sf):
    rule = Rule(
        [("?o", "placedBy", "?c"), ("?o", "total", "?t")], [("?o", "large", "?c")], [compare("?t", ">", 300000)]
    )
    return RuleBase(store(spark, sf, "orders"), [rule]).infer_semi_naive().select(*SPO)


WITHIN = [
    Rule([("?x", "partOf", "?y")], [("?x", "within", "?y")]),
    Rule([("?x", "within", "?y"), ("?y", "partOf", "?z")], [("?x", "within", "?z")]),
]
WITHIN_SQL = recursive(
    triples_sql("region", "nation", "customer", "supplier"),
    """w(s, o) AS (SELECT s, o FROM triples WHERE p = 'partOf'
       UNION SELECT w.s, t.o FROM w JOIN triples t ON w.o = t.s AND t.p = 'partOf')""",
    select="SELECT s, 'within' AS p, o FROM w",
)


@query("kg_transitive", WITHIN_SQL)
def kg_transitive(spark, sf):
    return RuleBase(places(spark, sf), WITHIN).infer_naive().select(*SPO)


@query("kg_transitive_seminaive", recursive(*PART_ABOVE, select="SELECT x AS s, 'above' AS p, y AS o FROM up"))
def kg_transitive_seminaive(spark, sf):
    return RuleBase(tree(spark, sf), ABOVE_DOUBLING).infer_semi_naive().select(*SPO)


@query(
    "kg_cyclic",
    recursive(
        """trade(x, y) AS (SELECT DISTINCT concat('nation/', c_nationkey), concat('nation/', s_nationkey) FROM lineitem
           JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)""",
        "r(x, y) AS (SELECT x, y FROM trade UNION SELECT r.x, t.y FROM r JOIN trade t ON r.y = t.x)",
        select="SELECT x AS s, 'reaches' AS p, y AS o FROM r",
    ),
)
def kg_cyclic(spark, sf):
    """Closure of a cyclic graph: who buys, directly or through others, from whom."""
    bought = Rule(
        [
            ("?l", "inOrder", "?o"),
            ("?o", "placedBy", "?c"),
            ("?c", "partOf", "?n"),
            ("?l", "supplier", "?s"),
            ("?s", "partOf", "?m"),
        ],
        [("?n", "trades", "?m")],
    )
    reach = [
        Rule([("?x", "trades", "?y")], [("?x", "reaches", "?y")]),
        Rule([("?x", "reaches", "?y"), ("?y", "trades", "?z")], [("?x", "reaches", "?z")]),
    ]
    data = store(spark, sf, "lineitem", "orders", "customer", "supplier")
    trades = RuleBase(data, [bought]).infer_semi_naive()
    return RuleBase(TripleStore(trades), reach).infer_semi_naive().select(*SPO)


@query("kg_datalog_query", recursive(*PART_ABOVE, select="SELECT x FROM up WHERE y = 'part/3'"))
def kg_datalog_query(spark, sf):
    return RuleBase(tree(spark, sf), ABOVE).query(("?x", "above", "part/3"))


@query(
    "kg_datalog_inferred",
    """SELECT concat('part/', p_partkey) AS x, concat('part/', cast(floor(floor(p_partkey / 2) / 2) AS bigint)) AS y
       FROM part WHERE p_partkey > 3""",
)
def kg_datalog_inferred(spark, sf):
    """A two-premise rule that adds to its own predicate's facts; only the new facts are matched."""
    data = tree(spark, sf)
    skip = Rule([("?x", "parent", "?y"), ("?y", "parent", "?z")], [("?x", "grandparent", "?z")])
    return RuleBase(data, [skip]).inferred_query(("?x", "grandparent", "?y"))


@query(
    "kg_backward",
    recursive(
        PART_EDGE,
        "up(x, y) AS (SELECT x, y FROM edge UNION SELECT u.x, e.y FROM up u JOIN edge e ON u.y = e.x)",
        select="SELECT x, y FROM up",
    ),
)
def kg_backward(spark, sf):
    """Goal-directed: only rules that can reach the goal are used, to the fixpoint."""
    unrelated = Rule([("?x", "brand", "?b")], [("?b", "brandOf", "?x")])
    return RuleBase(store(spark, sf, "part"), [*ABOVE, unrelated]).prove(("?x", "above", "?y"))


@query("kg_backward_bound", recursive(*PART_ABOVE, select="SELECT y FROM up WHERE x = 'part/190'"))
def kg_backward_bound(spark, sf):
    """A bound subject: only the parts above this one are visited, of a rule that doubles paths."""
    return RuleBase(store(spark, sf, "part"), ABOVE_DOUBLING).prove(("part/190", "above", "?y"))


PEERS = [
    Rule([("?x", "parent", "?y"), ("?z", "parent", "?y")], [("?x", "peer", "?z")]),
    Rule([("?x", "parent", "?u"), ("?u", "peer", "?v"), ("?z", "parent", "?v")], [("?x", "peer", "?z")]),
]


@query(
    "kg_backward_same_level",
    recursive(
        PART_EDGE,
        """asked(x, d) AS (SELECT 'part/50', 0 UNION SELECT e.y, d + 1 FROM asked a JOIN edge e ON e.x = a.x)""",
        """level(z, d) AS (SELECT x, d FROM asked UNION SELECT e.x, l.d - 1 FROM level l JOIN edge e ON e.y = l.z WHERE l.d > 0)""",
        select="SELECT DISTINCT z FROM level WHERE d = 0",
    ),
)
def kg_backward_same_level(spark, sf):
    """Parts as deep as a given one, by a rule that asks for its own goal with other bindings."""
    return RuleBase(tree(spark, sf), PEERS).prove(("part/50", "peer", "?z"))


EVERY_USE = ("nation", "region", "customer", "part")


@query(
    "kg_predicate_var",
    with_triples(
        """SELECT p AS s, 'usedBy' AS p, s AS o FROM triples UNION SELECT 'usedBy', 'usedBy', p FROM triples
           UNION SELECT 'usedBy', 'usedBy', 'usedBy' FROM triples""",
        *EVERY_USE,
    ),
)
def kg_predicate_var(spark, sf):
    rule = Rule([("?x", "?p", "?y")], [("?p", "usedBy", "?x")])
    return RuleBase(store(spark, sf, *EVERY_USE), [rule]).infer_semi_naive().select(*SPO)


@query(
    "kg_multi_conclusion",
    """SELECT concat('order/', o_orderkey) AS s, 'rush' AS p, 'true' AS o FROM orders WHERE o_orderpriority = '1-URGENT'
       UNION SELECT concat('customer/', o_custkey), 'hasRush', concat('order/', o_orderkey) FROM orders
       WHERE o_orderpriority = '1-URGENT'""",
)
def kg_multi_conclusion(spark, sf):
    rule = Rule(
        [("?o", "priority", "1-URGENT"), ("?o", "placedBy", "?c")], [("?o", "rush", "true"), ("?c", "hasRush", "?o")]
    )
    return RuleBase(store(spark, sf, "orders"), [rule]).infer_semi_naive().select(*SPO)


@query(
    "kg_rule_filter",
    """SELECT concat('part/', p_partkey) AS s, 'offer' AS p, p_brand AS o FROM part
       WHERE p_size < 5 OR (p_type = 'PROMO' AND p_retailprice < 950)""",
)
def kg_rule_filter(spark, sf):
    """Filters with OR and with text equality."""
    keep = compare("?z", "<", 5) | (compare("?t", "=", "PROMO") & compare("?m", "<", 950))
    body = [("?x", "size", "?z"), ("?x", "type", "?t"), ("?x", "price", "?m"), ("?x", "brand", "?b")]
    return RuleBase(store(spark, sf, "part"), [Rule(body, [("?x", "offer", "?b")], [keep])]).infer_semi_naive().select(*SPO)


@query(
    "rule_construct",
    """SELECT DISTINCT concat('nation/', c_nationkey) AS s, 'wealthAlert' AS p, 'true' AS o FROM customer WHERE c_acctbal > 9000""",
)
def rule_construct(spark, sf):
    """A named rule applied to the store; the query asks for its conclusion."""
    rule = Rule(
        [("?c", "partOf", "?n"), ("?c", "balance", "?b")],
        [("?n", "wealthAlert", "true")],
        [compare("?b", ">", 9000)],
        name="wealth",
    )
    closed = RuleBase(store(spark, sf, "customer"), [rule]).closed_store()
    return closed.lookup(p="wealthAlert", o="true")


@query(
    "rule_call_max",
    """SELECT concat('order/', l_orderkey) AS s, max(cast(l_quantity AS bigint)) AS value FROM lineitem
       GROUP BY 1 HAVING max(l_quantity) > 45""",
)
def rule_call_max(spark, sf):
    """Orders a rule has flagged, each with its highest line quantity."""
    rule = Rule(
        [("?l", "inOrder", "?o"), ("?l", "quantity", "?q")], [("?o", "bulk", "true")], [compare("?q", ">", 45)]
    )
    closed = RuleBase(store(spark, sf, "lineitem"), [rule]).closed_store()
    return highest_reading(closed, "bulk", "inOrder", "quantity")


# -- constraints ---------------------------------------------------------------------------------------


def overdrawn():
    return Denial(
        [("?o", "placedBy", "?c"), ("?o", "status", "F"), ("?c", "balance", "?b")], [compare("?b", "<", 0)], "overdrawn"
    )


@query(
    "kg_violations",
    """SELECT concat('order/', o_orderkey) AS o, concat('customer/', c_custkey) AS c,
       cast(cast(c_acctbal AS decimal(18,2)) AS varchar) AS b FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'F' AND c_acctbal < 0""",
)
def kg_violations(spark, sf):
    return violations(store(spark, sf, "orders", "customer").df, overdrawn()).select("o", "c", "b")


URGENT_DONE = Denial([("?o", "status", "F"), ("?o", "priority", "1-URGENT")], name="urgent orders are open")


@query(
    "kg_repair_greedy",
    """SELECT concat('order/', o_orderkey) AS s, 'status' AS p, 'F' AS o FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
)
def kg_repair_greedy(spark, sf):
    """What the repair deletes: the later triple of each conflict in text order."""
    return removed_by_repair(store(spark, sf, "orders").df, [URGENT_DONE])


@query(
    "kg_repair_single",
    """SELECT concat('customer/', c_custkey) AS s, 'balance' AS p, cast(cast(c_acctbal AS decimal(18,2)) AS varchar) AS o
       FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT concat('customer/', c_custkey), 'segment', 'BUILDING' FROM customer
       WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000""",
)
def kg_repair_single(spark, sf):
    """One constraint that a fact breaks alone, one with a filter over two facts."""
    negative = Denial([("?c", "balance", "?b")], [compare("?b", "<", 0)])
    builder = Denial([("?c", "balance", "?b"), ("?c", "segment", "BUILDING")], [compare("?b", ">", 9000)])
    return removed_by_repair(store(spark, sf, "customer").df, [negative, builder])


@query(
    "kg_iar_query",
    """SELECT concat('order/', o_orderkey) AS x, o_orderstatus AS v FROM orders
       WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
)
def kg_iar_query(spark, sf):
    """Statuses that hold in every repair."""
    return answers_in_all_repairs(store(spark, sf, "orders"), [URGENT_DONE], ("?x", "status", "?v"))


@query(
    "kg_infer_repair",
    """SELECT concat('order/', o_orderkey) AS s, 'priority' AS p, '1-URGENT' AS o FROM orders
       WHERE o_totalprice > 400000 AND o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'""",
)
def kg_infer_repair(spark, sf):
    """Large orders become urgent unless that contradicts what is kept."""
    rule = Rule([("?o", "total", "?t")], [("?o", "priority", "1-URGENT")], [compare("?t", ">", 400000)])
    return infer_with_repair(store(spark, sf, "orders").df, [rule], [URGENT_DONE]).select(*SPO)


def dear_done():
    return Denial([("?o", "status", "F"), ("?o", "priority", "1-URGENT"), ("?o", "total", "?t")], [compare("?t", ">", 300000)])


@query(
    "kg_repair_three",
    """SELECT concat('order/', o_orderkey) AS s, 'total' AS p, cast(cast(o_totalprice AS decimal(18,2)) AS varchar) AS o FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000""",
)
def kg_repair_three(spark, sf):
    """Conflicts of three facts: the last of each in text order goes."""
    return removed_by_repair(store(spark, sf, "orders").df, [dear_done()])


@query(
    "kg_repair_digest",
    """WITH RECURSIVE f AS (SELECT c_custkey AS k, md5(concat_ws(chr(31), concat('customer/', c_custkey), 'nextTo', concat('customer/', c_custkey + 1), '')) AS d
          FROM customer),
       r AS (SELECT k, d, (SELECT count(*) FROM f g WHERE abs(g.k - f.k) = 1 AND g.d < f.d) AS earlier FROM f),
       step(n, kept, gone) AS (
         SELECT 0, CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
         UNION ALL
         SELECT n + 1, list_concat(kept, new), list_distinct(list_concat(gone, flatten(list_transform(new, lambda k: [k - 1, k + 1]))))
         FROM (SELECT n, kept, gone, (SELECT coalesce(list(k), []) FROM r WHERE NOT list_contains(kept, k) AND NOT list_contains(gone, k)
                 AND NOT EXISTS (SELECT 1 FROM f g WHERE abs(g.k - r.k) = 1 AND g.d < r.d AND NOT list_contains(gone, g.k))) AS new FROM step)
         WHERE len(new) > 0)
       SELECT concat('customer/', k) AS s, 'nextTo' AS p, concat('customer/', k + 1) AS o FROM f
       WHERE NOT list_contains((SELECT kept FROM step ORDER BY n DESC LIMIT 1), k)""",
)
def kg_repair_digest(spark, sf):
    """A chain of conflicts from one end of the table to the other, decided in the order of a digest."""
    chain = table(spark, sf, "customer").selectExpr(
        "concat('customer/', c_custkey) AS s", "'nextTo' AS p", "concat('customer/', c_custkey + 1) AS o", "cast(NULL AS double) AS o_num"
    )
    return removed_by_repair(chain, [Denial([("?a", "nextTo", "?b"), ("?b", "nextTo", "?c")])], by="digest")


@query(
    "kg_infer_repair_three",
    """SELECT concat('order/', o_orderkey) AS s, 'priority' AS p, '1-URGENT' AS o FROM orders
       WHERE o_totalprice > 250000 AND o_orderpriority <> '1-URGENT' AND NOT (o_orderstatus = 'F' AND o_totalprice > 300000)""",
)
def kg_infer_repair_three(spark, sf):
    """Large orders become urgent unless that completes a conflict of three facts."""
    rule = Rule([("?o", "total", "?t")], [("?o", "priority", "1-URGENT")], [compare("?t", ">", 250000)])
    return infer_with_repair(store(spark, sf, "orders").df, [rule], [dear_done()]).select(*SPO)


# -- levels --------------------------------------------------------------------------------------------


def levels(spark, sf):
    rich = Rule([("?c", "balance", "?b")], [("?c", "isA", "wealthy")], [compare("?b", ">", 9000)])
    target = Rule([("?c", "isA", "wealthy"), ("?c", "segment", "BUILDING")], [("?c", "likely", "investor")])
    review = Rule([("?c", "likely", "investor")], [("?c", "needs", "review")])
    known = at_level("base", store(spark, sf, "customer").df)
    held = LevelStore(known)
    held.add_rule_at_level(rich, "deductive")
    held.add_cross_level_rule(LevelRule(target, "abductive", ["base", "deductive"]))
    held.add_cross_level_rule(LevelRule(review, "meta", ["abductive"]))
    return held


LEVEL_FACTS = """lf(level, s, p, o) AS (
    SELECT 'deductive', concat('customer/', c_custkey), 'isA', 'wealthy' FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT 'abductive', concat('customer/', c_custkey), 'likely', 'investor' FROM customer
      WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'meta', concat('customer/', c_custkey), 'needs', 'review' FROM customer
      WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING')"""


@query("kg_levels_infer", f"WITH {LEVEL_FACTS} SELECT * FROM lf")
def kg_levels_infer(spark, sf):
    return levels(spark, sf).infer().lookup().filter("level <> 'base'")


@query("kg_levels_query", f"WITH {LEVEL_FACTS} SELECT * FROM lf WHERE level = 'abductive'")
def kg_levels_query(spark, sf):
    return levels(spark, sf).infer().lookup(level="abductive", p="likely")


@query(
    "kg_certainty",
    """SELECT concat('customer/', c_custkey) AS s, 'isA' AS p, 'wealthy' AS o,
         CAST(CASE WHEN c_acctbal > 9000 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS certainty FROM customer
       UNION ALL SELECT concat('customer/', c_custkey), 'likely', 'investor',
         CASE WHEN c_acctbal > 9000 AND c_mktsegment = 'BUILDING' THEN 0.6 ELSE 0.0 END FROM customer
       UNION ALL SELECT concat('customer/', c_custkey), 'segment', c_mktsegment, 1.0 FROM customer""",
)
def kg_certainty(spark, sf):
    """Certainty of three claims about every customer, held or not."""
    people = table(spark, sf, "customer").select(F.expr("concat('customer/', c_custkey)").alias("s"), "c_mktsegment")
    claims = F.array(
        F.struct(F.lit("isA").alias("p"), F.lit("wealthy").alias("o")),
        F.struct(F.lit("likely").alias("p"), F.lit("investor").alias("o")),
        F.struct(F.lit("segment").alias("p"), F.col("c_mktsegment").alias("o")),
    )
    asked = people.select("s", F.explode(claims).alias("c")).select("s", "c.p", "c.o")
    return levels(spark, sf).infer().certainty(asked)
