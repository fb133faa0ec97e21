"""The given tables as one triple relation, and the same relation in SQL.

The relation is a union of projections with constant predicates.  A pattern with a constant predicate keeps
only the branches that can match, and of those only the columns it binds.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.operators.wide import PropertyTable
from trivane.store import TripleStore

# Fixed values: (table, subject, [(predicate, object, number)]) with expressions both engines understand.
# Order and line number alone are not unique in the given lines; part and price make them so.
LINE = "concat('line/', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', cast(floor(l_extendedprice * 100 + 0.5) as bigint))"


def _money(column: str) -> tuple[str, str]:
    return f"cast(cast({column} as decimal(18,2)) as {{text}})", column


def _words(column: str) -> tuple[str, str]:
    return column, "cast(null as double)"


def _link(kind: str, column: str) -> tuple[str, str]:
    return f"concat('{kind}/', {column})", "cast(null as double)"


def _whole(column: str) -> tuple[str, str]:
    return f"cast({column} as {{text}})", f"cast({column} as double)"


MAPPING = [
    ("region", "concat('region/', r_regionkey)", [("name", *_words("r_name"))]),
    ("nation", "concat('nation/', n_nationkey)", [("name", *_words("n_name")), ("partOf", *_link("region", "n_regionkey"))]),
    (
        "customer",
        "concat('customer/', c_custkey)",
        [
            ("name", *_words("c_name")),
            ("segment", *_words("c_mktsegment")),
            ("partOf", *_link("nation", "c_nationkey")),
            ("balance", *_money("c_acctbal")),
        ],
    ),
    (
        "supplier",
        "concat('supplier/', s_suppkey)",
        [("name", *_words("s_name")), ("partOf", *_link("nation", "s_nationkey")), ("balance", *_money("s_acctbal"))],
    ),
    (
        "part",
        "concat('part/', p_partkey)",
        [
            ("brand", *_words("p_brand")),
            ("type", *_words("p_type")),
            ("size", *_whole("p_size")),
            ("price", *_money("p_retailprice")),
        ],
    ),
    (
        "orders",
        "concat('order/', o_orderkey)",
        [
            ("placedBy", *_link("customer", "o_custkey")),
            ("status", *_words("o_orderstatus")),
            ("priority", *_words("o_orderpriority")),
            ("total", *_money("o_totalprice")),
        ],
    ),
    (
        "lineitem",
        LINE,
        [
            ("inOrder", *_link("order", "l_orderkey")),
            ("part", *_link("part", "l_partkey")),
            ("supplier", *_link("supplier", "l_suppkey")),
            ("flag", *_words("l_returnflag")),
            ("quantity", *_whole("cast(l_quantity as bigint)")),
            ("discount", *_money("l_discount")),
            ("tax", *_money("l_tax")),
        ],
    ),
]

# Parts form a binary tree: part k hangs under part k div 2.
PARENT = ("concat('part/', p_partkey)", "parent", "concat('part/', cast(floor(p_partkey / 2) as bigint))")


# The columns of the given tables.  Stated, so that opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _selects(name: str, source: str, text: str) -> list[str]:
    """One SELECT per predicate of a table, in the words of one engine."""
    ((_, subject, entries),) = [m for m in MAPPING if m[0] == name]
    parts = [
        f"SELECT {subject} AS s, '{p}' AS p, {value.format(text=text)} AS o, {number} AS o_num FROM {source}"
        for p, value, number in entries
    ]
    if name == "part":
        s, p, o = PARENT
        parts.append(f"SELECT {s}, '{p}', {o}, cast(null as double) FROM {source} WHERE p_partkey > 1")
    return parts


def _names(tables: tuple[str, ...]) -> list[str]:
    return [m[0] for m in MAPPING if not tables or m[0] in tables]


def triples(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Triples of the named tables, or of all; no triple occurs twice, since subjects are keys."""
    names = _names(tables)
    sql = " UNION ALL ".join(part for n in names for part in _selects(n, "{" + n + "}", "string"))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def property_tables(spark: SparkSession, sf_dir: str, *tables: str) -> list[PropertyTable]:
    """The tables as what they are: one row per subject."""
    out = []
    for name, subject, entries in MAPPING:
        if tables and name not in tables:
            continue
        columns = {p: (value.format(text="string"), number) for p, value, number in entries}
        if name == "part":
            columns[PARENT[1]] = (f"if(p_partkey > 1, {PARENT[2]}, null)", "cast(null as double)")
        out.append(PropertyTable(table(spark, sf_dir, name), subject, columns))
    return out


def store(spark: SparkSession, sf_dir: str, *tables: str) -> TripleStore:
    return TripleStore(triples(spark, sf_dir, *tables), tables=property_tables(spark, sf_dir, *tables))


@cache
def triples_sql(*tables: str) -> str:
    """Body of the common table expression ``triples(s, p, o, o_num)``."""
    parts = [part for n in _names(tables) for part in _selects(n, n, "varchar")]
    return "triples(s, p, o, o_num) AS (" + " UNION ALL ".join(parts) + ")"


def with_triples(sql: str, *tables: str) -> str:
    return f"WITH {triples_sql(*tables)} {sql}"


# -- events as a stream --------------------------------------------------------------------------------

# Whole minutes since 1970, whatever the session's time zone.
MINUTE = "cast(datediff(ts, date'1970-01-01') * 1440 + hour(ts) * 60 + minute(ts) as bigint)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timestamped triples ``(user, type, event id)`` with minutes as logical time."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('user/', user_id)").alias("s"),
        F.col("event_type").alias("p"),
        F.col("event_id").cast("string").alias("o"),
        F.col("value").alias("o_num"),
        F.expr(MINUTE).alias("ts"),
    )


EVENTS_SQL = (
    "events_t(s, p, o, o_num, ts) AS (SELECT concat('user/', user_id), event_type, cast(event_id as varchar), value, "
    "cast(floor(epoch_us(ts) / 1000000 / 60) as bigint) FROM events)"
)
