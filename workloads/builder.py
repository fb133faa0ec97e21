"""The fluent triple filter, store changes, lookups and set operations."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from trivane.builder import TripleQuery
from trivane.operators.dictionary import build, decode, encode
from trivane.operators.joins import Band, store_join
from trivane.query import Select
from trivane.session import materialize
from trivane.store import TripleStore
from workloads.registry import query
from workloads.tables import store, table, with_triples

SHOP = ("region", "nation", "customer", "orders")


def shop(spark, sf):
    return store(spark, sf, *SHOP)


def ask(spark, sf):
    return TripleQuery(shop(spark, sf))


# -- conditions ----------------------------------------------------------------------------------------


@query("qb_exact", with_triples("SELECT s, p, o FROM triples WHERE p = 'segment' AND o = 'BUILDING'", *SHOP))
def qb_exact(spark, sf):
    return ask(spark, sf).with_predicate("segment").with_object("BUILDING").triples()


@query("qb_contains", with_triples("SELECT s, p, o FROM triples WHERE contains(s, 'er/1') AND contains(o, 'I')", *SHOP))
def qb_contains(spark, sf):
    return ask(spark, sf).with_subject_like("er/1").with_object_like("I").triples()


@query("qb_startswith", with_triples("SELECT s, p, o FROM triples WHERE s LIKE 'nation/%' AND o LIKE 'region%'", *SHOP))
def qb_startswith(spark, sf):
    return ask(spark, sf).with_subject_starting("nation/").with_object_starting("region").triples()


@query("qb_endswith", with_triples("SELECT s, p, o FROM triples WHERE p LIKE '%Of' AND o LIKE '%4'", *SHOP))
def qb_endswith(spark, sf):
    return ask(spark, sf).with_predicate_ending("Of").with_object_ending("4").triples()


@query("qb_custom", with_triples("SELECT s, p, o FROM triples WHERE o_num > 400000 AND length(s) < 12", *SHOP))
def qb_custom(spark, sf):
    return ask(spark, sf).filter((F.col("o_num") > 400000) & (F.length("s") < 12)).triples()


@query(
    "qb_custom_python",
    with_triples(
        """SELECT s, p, o FROM triples WHERE p = 'name' AND (
             (length(o) + list_sum(list_transform(range(1, length(o) + 1), lambda i: (length(o) - i + 1) * ascii(o[i])))) % 65521 * 65536
             + (1 + list_sum(list_transform(range(1, length(o) + 1), lambda i: ascii(o[i])))) % 65521) % 7 < 3""",
        *SHOP,
    ),
)
def qb_custom_python(spark, sf):
    """The slow path: a checksum that no built-in function computes, in Arrow batches."""

    @F.pandas_udf("boolean")
    def in_share(values: pd.Series) -> pd.Series:
        return values.map(lambda text: zlib.adler32(text.encode()) % 7 < 3)

    return ask(spark, sf).with_predicate("name").filter(in_share(F.col("o"))).triples()


@query(
    "triple_ask",
    """SELECT concat('customer/', a.c_custkey) AS s, 'segment' AS p, b.c_mktsegment AS o, a.c_mktsegment = b.c_mktsegment AS there
       FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
       UNION ALL SELECT concat('nobody/', c_custkey), 'segment', c_mktsegment, false FROM customer""",
)
def triple_ask(spark, sf):
    """Many exact triples asked for at once: does each customer have the segment of the next one?"""
    customers = table(spark, sf, "customer")
    following = customers.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_mktsegment").alias("o"))
    asked = customers.join(following, "c_custkey").select(F.expr("concat('customer/', c_custkey)").alias("s"), F.lit("segment").alias("p"), "o")
    nobody = customers.selectExpr("concat('nobody/', c_custkey) AS s", "'segment' AS p", "c_mktsegment AS o")
    return store(spark, sf, "customer").ask(asked.unionByName(nobody))


@query(
    "solution_distinct",
    """SELECT DISTINCT c_mktsegment AS segment, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey""",
)
def solution_distinct(spark, sf):
    """Solutions projected to a few variables, each once."""
    asked = Select("?segment", "?status").where(("?o", "placedBy", "?c"), ("?o", "status", "?status"), ("?c", "segment", "?segment"))
    return asked.run(store(spark, sf, "customer", "orders")).distinct()


@query("qb_subjects", with_triples("SELECT s AS subject FROM triples WHERE p = 'partOf' AND o = 'nation/3'", *SHOP))
def qb_subjects(spark, sf):
    return ask(spark, sf).with_predicate("partOf").with_object("nation/3").subjects()


@query("qb_predicates", with_triples("SELECT DISTINCT p AS predicate FROM triples", *SHOP))
def qb_predicates(spark, sf):
    return ask(spark, sf).distinct().predicates()


@query("qb_objects", with_triples("SELECT o AS object FROM triples WHERE p = 'status'", *SHOP))
def qb_objects(spark, sf):
    return ask(spark, sf).with_predicate("status").objects()


@query("qb_distinct", with_triples("SELECT DISTINCT o AS object FROM triples WHERE p = 'priority'", *SHOP))
def qb_distinct(spark, sf):
    return ask(spark, sf).with_predicate("priority").distinct().objects()


@query("qb_count", with_triples("SELECT count(*) AS n FROM triples WHERE s LIKE 'order/%'", *SHOP))
def qb_count(spark, sf):
    return ask(spark, sf).with_subject_starting("order/").count()


# -- groups --------------------------------------------------------------------------------------------

CHUNK = 1000


def _groups_sql(key: str, where: str = "true") -> str:
    digest = "cast(('0x' || substr(md5(s || chr(31) || p || chr(31) || o), 1, 8)) AS bigint)"
    return with_triples(
        f""", t AS (SELECT {key} AS key, s, p, o, {digest} AS d FROM triples WHERE {where}),
        n AS (SELECT key, count(*) AS size FROM t GROUP BY key),
        c AS (SELECT t.*, d % greatest(cast(ceil(size / {CHUNK}.0) AS bigint), 1) AS chunk FROM t JOIN n USING (key))
        SELECT key, chunk, count(*) AS n, string_agg(s || ' ' || p || ' ' || o, '|' ORDER BY s, p, o) AS members
        FROM c GROUP BY key, chunk""",
        *SHOP,
    )


def _flat(groups):
    texts = F.transform("members", lambda m: F.concat_ws(" ", m["s"], m["p"], m["o"]))
    return groups.select("key", "chunk", "n", F.array_join(texts, "|").alias("members"))


@query("qb_group_predicate", _groups_sql("p"))
def qb_group_predicate(spark, sf):
    return _flat(ask(spark, sf).group_by_predicate(CHUNK))


@query("qb_group_subject", _groups_sql("s"))
def qb_group_subject(spark, sf):
    return _flat(ask(spark, sf).group_by_subject(CHUNK))


@query("qb_group_object", _groups_sql("o", "p <> 'total'"))
def qb_group_object(spark, sf):
    return _flat(ask(spark, sf).filter(F.col("p") != "total").group_by_object(CHUNK))


@query("qb_group_sizes", with_triples("SELECT p AS key, count(*) AS n FROM triples GROUP BY p", *SHOP))
def qb_group_sizes(spark, sf):
    return ask(spark, sf).group_sizes(F.col("p"))


# -- joins between stores ------------------------------------------------------------------------------


@query(
    "qb_join_subject",
    with_triples(
        "SELECT DISTINCT l.s, l.p, r.o FROM triples l JOIN triples r ON l.s = r.s WHERE l.p = 'placedBy' AND r.s LIKE 'order/%'",
        *SHOP,
    ),
)
def qb_join_subject(spark, sf):
    left = ask(spark, sf).with_predicate("placedBy")
    return left.join(store(spark, sf, "orders")).join_on_subject().triples()


@query(
    "qb_join_predicate",
    """SELECT DISTINCT concat('nation/', n_nationkey) AS s, 'name' AS p, r_name AS o FROM nation, region
       UNION SELECT DISTINCT concat('customer/', c_custkey), 'name', r_name FROM customer, region""",
)
def qb_join_predicate(spark, sf):
    left = TripleQuery(store(spark, sf, "nation", "customer")).with_predicate("name")
    return left.join(store(spark, sf, "region")).join_on_predicate().triples()


@query(
    "qb_join_object",
    with_triples(
        """SELECT DISTINCT l.s, r.p, r.o FROM triples l JOIN triples r ON l.o = r.o WHERE l.p = 'partOf'
           AND l.s LIKE 'customer/%' AND r.s LIKE 'supplier/%'""",
        "customer", "supplier",
    ),
)
def qb_join_object(spark, sf):
    left = TripleQuery(store(spark, sf, "customer")).with_predicate("partOf")
    return left.join(store(spark, sf, "supplier")).join_on_object().triples()


@query(
    "qb_join_theta",
    """SELECT DISTINCT concat('customer/', c_custkey) AS s, 'balance' AS p, cast(cast(s_acctbal AS decimal(18,2)) AS varchar) AS o
       FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 0.5""",
)
def qb_join_theta(spark, sf):
    """A numeric band, joined on cells of the band's width."""
    left = TripleQuery(store(spark, sf, "customer")).with_predicate("balance")
    suppliers = TripleStore(store(spark, sf, "supplier").df.filter("p = 'balance'"))
    return left.join(suppliers).join_with(band=Band("o_num", "o_num", 0.5)).triples()


@query(
    "qb_join_multi",
    with_triples(
        """SELECT l.s, l.p, r.o FROM triples l JOIN triples r ON l.s = r.s WHERE l.p = 'partOf' AND l.s LIKE 'nation/%'
             AND r.s LIKE 'nation/%'
           UNION SELECT l.s, r.p, r.o FROM triples l JOIN triples r ON l.o = r.o WHERE l.p = 'partOf'
             AND l.s LIKE 'nation/%' AND r.s LIKE 'nation/%'""",
        "nation",
    ),
)
def qb_join_multi(spark, sf):
    left = TripleQuery(store(spark, sf, "nation")).with_predicate("partOf")
    return left.join(store(spark, sf, "nation")).join_on_subject().join_on_object().triples()


@query(
    "store_join",
    with_triples(
        """SELECT DISTINCT l.s, l.p, r.o FROM triples l JOIN triples r ON (l.o = r.s OR l.o = r.o)
           WHERE l.p = 'partOf' AND r.p = 'partOf' AND l.s LIKE 'customer/%' AND r.s LIKE 'nation/%'""",
        "customer", "nation",
    ),
)
def store_join_query(spark, sf):
    left, right = store(spark, sf, "customer"), store(spark, sf, "nation")
    return store_join(left.df, right.df, "partOf").select("s", "p", "o")


# -- order and slices ----------------------------------------------------------------------------------


@query(
    "qb_order_limit",
    with_triples("SELECT s, p, o FROM triples WHERE p = 'total' ORDER BY o_num DESC, s, p, o LIMIT 40 OFFSET 10", *SHOP),
)
def qb_order_limit(spark, sf):
    return ask(spark, sf).with_predicate("total").order_by("o_num").desc().offset(10).limit(40).triples()


@query(
    "qb_offset",
    with_triples("SELECT s, p, o FROM triples WHERE p = 'segment' ORDER BY o, s, p OFFSET 200", *SHOP),
)
def qb_offset(spark, sf):
    return ask(spark, sf).with_predicate("segment").order_by("o").offset(200).triples()


# -- store changes and lookups -------------------------------------------------------------------------

DISCOUNTED = "SELECT concat('customer/', c_custkey) AS s, 'segment' AS p, 'PREMIUM' AS o FROM customer WHERE c_acctbal > 9000"


def _premium(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000")
    return rich.selectExpr("concat('customer/', c_custkey) AS s", "'segment' AS p", "'PREMIUM' AS o")


@query("triple_insert", with_triples(f"SELECT s, p, o FROM triples UNION {DISCOUNTED}", "customer"))
def triple_insert(spark, sf):
    """The inserted rows come twice; the store stays a set."""
    new = _premium(spark, sf)
    return store(spark, sf, "customer").add(new.union(new)).lookup()


DELETED = "SELECT concat('customer/', c_custkey), 'segment', 'BUILDING' FROM customer"


@query("triple_delete", with_triples(f"SELECT s, p, o FROM triples EXCEPT {DELETED}", "customer"))
def triple_delete(spark, sf):
    gone = table(spark, sf, "customer").selectExpr(
        "concat('customer/', c_custkey) AS s", "'segment' AS p", "'BUILDING' AS o"
    )
    return store(spark, sf, "customer").remove(gone).lookup()


@query("triple_delete_found", with_triples(f"SELECT s, p, o FROM triples INTERSECT {DELETED}", "customer"))
def triple_delete_found(spark, sf):
    gone = table(spark, sf, "customer").selectExpr(
        "concat('customer/', c_custkey) AS s", "'segment' AS p", "'BUILDING' AS o"
    )
    return store(spark, sf, "customer").removed(gone)


@query(
    "insert_where",
    with_triples(
        """SELECT s, p, o FROM triples UNION SELECT concat('customer/', o_custkey), 'ordered', concat('order/', o_orderkey)
           FROM orders WHERE o_orderstatus = 'F'
           UNION SELECT concat('order/', o_orderkey), 'closed', 'true' FROM orders WHERE o_orderstatus = 'F'""",
        "orders",
    ),
)
def insert_where(spark, sf):
    data = store(spark, sf, "orders")
    closed = Select("?o", "?c").where(("?o", "status", "F"), ("?o", "placedBy", "?c")).solutions(data)
    return data.insert_where([("?c", "ordered", "?o"), ("?o", "closed", "true")], closed).lookup()


@query("abox_lookup", with_triples("SELECT s, p, o FROM triples WHERE p = 'partOf' AND o = 'nation/11'", *SHOP))
def abox_lookup(spark, sf):
    return shop(spark, sf).lookup(p="partOf", o="nation/11")


SHAPES = {
    "spo": dict(s="nation/3", p="partOf", o="region/3"),
    "sp": dict(s="nation/4", p="name"),
    "so": dict(s="nation/3", o="region/3"),
    "po": dict(p="segment", o="BUILDING"),
    "s": dict(s="customer/5"),
    "p": dict(p="segment"),
    "o": dict(o="nation/6"),
    "all": {},
}


def _shape_sql(bound: dict[str, str]) -> str:
    return " AND ".join(f"{c} = '{v}'" for c, v in bound.items()) or "true"


@query(
    "scan_shapes",
    with_triples(
        " UNION ALL ".join(
            f"SELECT '{k}' AS shape, count(*) AS n, min(s || p || o) AS first FROM triples WHERE {_shape_sql(v)}"
            for k, v in SHAPES.items()
        ),
        *SHOP,
    ),
)
def scan_shapes(spark, sf):
    """All eight ways to bind positions: row count and smallest triple of each."""
    data, parts = shop(spark, sf), None
    for name, bound in SHAPES.items():
        part = data.lookup(**bound).agg(
            F.lit(name).alias("shape"), F.count("*").alias("n"), F.min(F.concat("s", "p", "o")).alias("first")
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


KEY_PAIRS = {
    "sp": (dict(s="nation/4", p="partOf"), "o"),
    "so": (dict(s="nation/3", o="region/3"), "p"),
    "po": (dict(p="segment", o="BUILDING"), "s"),
}


@query(
    "scan_two_key",
    with_triples(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{k}' AS keys, {c} AS third FROM triples WHERE {_shape_sql(v)}" for k, (v, c) in KEY_PAIRS.items()
        ),
        *SHOP,
    ),
)
def scan_two_key(spark, sf):
    data, parts = shop(spark, sf), None
    for name, (bound, third) in KEY_PAIRS.items():
        part = data.third(**bound).select(F.lit(name).alias("keys"), F.col(third).alias("third"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


DICTIONARY = """, terms AS (SELECT s AS t FROM triples UNION SELECT p FROM triples UNION SELECT o FROM triples),
    d AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS id FROM terms) """


@query(
    "dict_encode",
    with_triples(
        DICTIONARY
        + """SELECT a.id AS s_id, b.id AS p_id, c.id AS o_id FROM triples JOIN d a ON s = a.t JOIN d b ON p = b.t
             JOIN d c ON o = c.t""",
        "nation", "customer",
    ),
)
def dict_encode(spark, sf):
    data = store(spark, sf, "nation", "customer").df
    return encode(data, build(data))


@query("dict_decode", with_triples("SELECT s, p, o FROM triples", "nation", "customer"))
def dict_decode(spark, sf):
    """One dictionary over two stores; decoding gives the triples back."""
    nations, customers = store(spark, sf, "nation").df, store(spark, sf, "customer").df
    shared = build(nations, customers)
    return decode(materialize(encode(nations.union(customers), shared), "coded"), shared)


@query(
    "store_profile",
    with_triples(
        "SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM triples GROUP BY p",
        *SHOP,
    ),
)
def store_profile(spark, sf):
    return shop(spark, sf).profile(exact=True)


@query(
    "store_profile_estimate",
    with_triples("SELECT p, count(*) AS triples, true AS subjects_near, true AS objects_near FROM triples GROUP BY p", *SHOP),
)
def store_profile_estimate(spark, sf):
    """The profile with sketched distinct counts, each within four standard errors (5 %) of the exact one."""
    data = shop(spark, sf)
    exact = data.profile(exact=True).select("p", F.col("subjects").alias("n_s"), F.col("objects").alias("n_o"))
    both = data.profile().join(exact, "p")
    near = lambda sketch, count: F.abs(F.col(sketch) - F.col(count)) <= 0.2 * F.col(count)
    return both.select("p", "triples", near("subjects", "n_s").alias("subjects_near"), near("objects", "n_o").alias("objects_near"))


@query(
    "store_union",
    with_triples("SELECT s, p, o FROM triples UNION " + DISCOUNTED, "customer", "nation"),
)
def store_union(spark, sf):
    left = store(spark, sf, "customer", "nation")
    overlapping = TripleStore(_premium(spark, sf)).union(store(spark, sf, "nation"))
    return left.union(overlapping).lookup()


@query(
    "store_minus",
    with_triples("SELECT s, p, o FROM triples WHERE NOT (p = 'status' AND o = 'F')", "orders"),
)
def store_minus(spark, sf):
    data = store(spark, sf, "orders")
    return data.minus(TripleStore(data.lookup(p="status", o="F"))).lookup()
