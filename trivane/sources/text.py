"""Line- and statement-based RDF text as Spark jobs.

Files are split by Spark at line or statement ends, so one large file is read by many tasks.  Terms are
taken apart with built-in string functions.  Every reader returns triples
``(s, p, o, o_kind, o_datatype, o_lang, o_num)`` with ``o`` the lexical value; lines that are neither
triples nor noise are available from the matching ``*_rejects`` function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number
from trivane.operators.bgp import BROADCAST_BYTES, weight
from trivane.operators.skew import hot_keys, salted_join

# Term patterns of the line formats.
IRI = r"<[^>]*>"
BLANK = r"_:\S+"
# Possessive repeats keep the matcher iterative, so a literal of any length fits the stack.
QUOTED = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
LITERAL = rf'"{QUOTED}"(?:\^\^(?:<[^>]*>|[^\s;,.]+)|@[A-Za-z0-9-]+)?'
NTRIPLES_LINE = rf"^\s*({IRI}|{BLANK})\s*({IRI})\s*({IRI}|{BLANK}|{LITERAL})\s*\.\s*$"
LITERAL_PARTS = rf'^"({QUOTED})"(?:\^\^(.+)|@([A-Za-z0-9-]+))?$'
BARE = r'[^\s;,"<>]+'

# Separates the groups of one match.
MARK = "\x1f"


def unescape(column: Column) -> Column:
    """Resolve the string escapes of a literal; a doubled backslash is set aside first."""
    mark = "\x01"
    out = F.replace(column, F.lit("\\\\"), F.lit(mark))
    for escaped, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def _plain(column: Column) -> Column:
    return F.when(F.instr(column, "\\") > 0, unescape(column)).otherwise(column)


def escape(column: Column) -> Column:
    out = column
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def groups(column: Column | str, pattern: str, *order: int) -> Column:
    """Groups of a pattern that covers the whole value, from one match; no match gives a shorter array.

    The last group may hold any character.
    """
    return F.split(F.regexp_replace(column, pattern, MARK.join(f"${i}" for i in order)), MARK, len(order))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly value that later filters and columns use, computed once per row.

    A plain projection would be merged into the filter above it and evaluated again there.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def typed_terms(df: DataFrame, s: Column, p: Column, o: Column) -> DataFrame:
    """Triples from raw term text: brackets and quotes removed, literal parts in their own columns."""
    strip = lambda c: F.when(c.startswith("<"), F.substring(c, 2, F.length(c) - 2)).otherwise(c)
    raw = df.select(s.alias("__s"), p.alias("__p"), o.alias("__o"))
    literal = F.col("__o").startswith('"')
    raw = once(raw, F.when(literal, groups("__o", LITERAL_PARTS, 2, 3, 1)), "__parts")
    part = lambda i: F.nullif(F.col("__parts")[i], F.lit(""))
    kind = F.when(literal, "literal").when(F.col("__o").startswith("_:"), "bnode")
    kind = kind.when(F.col("__o").startswith("<") | F.col("__o").contains(":"), "iri").otherwise("literal")
    out = raw.select(
        strip(F.col("__s")).alias("s"),
        strip(F.col("__p")).alias("p"),
        F.when(literal, _plain(F.col("__parts")[2])).otherwise(strip(F.col("__o"))).alias("o"),
        kind.alias("o_kind"),
        strip(part(0)).alias("o_datatype"),
        part(1).alias("o_lang"),
    )
    return once(out, F.when(F.col("o_kind") == "literal", as_number(F.col("o"))), "o_num")


# -- N-Triples -----------------------------------------------------------------------------------------


def _content(lines: DataFrame) -> DataFrame:
    trimmed = F.trim(F.col("value"))
    return lines.filter((F.length(trimmed) > 0) & ~trimmed.startswith("#"))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """Triples from a ``value`` column of lines."""
    parts = once(_content(lines), groups("value", NTRIPLES_LINE, 1, 2, 3), "t").filter(F.size("t") == 3)
    return typed_terms(parts, F.col("t")[0], F.col("t")[1], F.col("t")[2])


def ntriples_rejects(lines: DataFrame) -> DataFrame:
    return _content(lines).filter(~F.col("value").rlike(NTRIPLES_LINE))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple; without ``o_kind`` an object is a literal."""
    has = set(triples.columns)
    bracket = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'))
    if "o_lang" in has:
        quoted = F.concat(
            quoted,
            F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
            .when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
            .otherwise(F.lit("")),
        )
    obj = F.when(F.col("o_kind") == "literal", quoted).otherwise(bracket(F.col("o"))) if "o_kind" in has else quoted
    line = F.concat_ws(" ", bracket(F.col("s")), bracket(F.col("p")), obj, F.lit("."))
    return triples.select(line.alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.text(path)


def plain_lines(triples: DataFrame) -> DataFrame:
    """``s p o .`` per triple, as a person reads it."""
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


# -- Turtle, one triple per line -----------------------------------------------------------------------


def parse_turtle_lines(lines: DataFrame) -> DataFrame:
    """Three whitespace-separated terms per line, quotes and final dot removed, prefix lines left out.

    A quoted object may hold spaces.
    """
    term = rf"{IRI}|{LITERAL}|{BARE}"
    shape = rf"^\s*({term})\s+({term})\s+({IRI}|{LITERAL}|[^\s;,\"<>]+?)\s*\.?\s*$"
    kept = _content(lines).filter(~F.trim(F.col("value")).startswith("@"))
    parts = once(kept, groups("value", shape, 1, 2, 3), "t").filter(F.size("t") == 3)
    return typed_terms(parts, F.col("t")[0], F.col("t")[1], F.col("t")[2])


def read_turtle_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_turtle_lines(spark.read.text(path))


# -- N3 statements -------------------------------------------------------------------------------------


def read_n3(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples with expanded prefixes, and the prefixes, of N3 files; :mod:`trivane.sources.n3` also gives rejects."""
    from trivane.sources import n3

    found = n3.read_n3(spark, path)
    return found.triples, found.prefixes.select("prefix", "iri").distinct()


# -- prefixes ------------------------------------------------------------------------------------------


def _prefix_of(column: str) -> Column:
    short = F.col(column).contains(":") & ~F.col(column).rlike(r"^(https?://|_:)")
    return F.when(short, F.split_part(F.col(column), F.lit(":"), F.lit(1)))


def expand_column(df: DataFrame, column: str, prefixes: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Replace ``prefix:local`` in one column; unknown prefixes, full IRIs and blank nodes stay.

    A prefix may have one IRI only, in however many rows; two are an error.  One prefix is often shared by most rows, so
    the table is broadcast while its counted bytes are few and joined with salting beyond that.  ``source`` is a cheaper relation with
    the same column, in which to look for prefixes that are shared by many rows.
    """
    keyed = df.withColumn("__prefix", _prefix_of(column))
    meant = prefixes.groupBy(F.col("prefix").alias("__prefix")).agg(F.min("iri").alias("__iri"), F.max("iri").alias("__last"))
    several = F.concat(F.lit("several IRIs for the prefix "), F.col("__prefix"))
    one = F.when(F.col("__iri") != F.col("__last"), F.raise_error(several)).otherwise(F.col("__iri"))
    table = meant.select("__prefix", one.alias("__iri"))
    if weight(prefixes.select("prefix", "iri")) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(table), "__prefix", "left")
    else:
        heads = (source if source is not None else df).select(_prefix_of(column).alias("__prefix")).dropna()
        joined = salted_join(keyed, table, ["__prefix"], "left", hot=hot_keys(heads, ["__prefix"]))
    local = F.substring(F.col(column), F.length("__prefix") + 2, F.length(column))
    whole = F.when(F.col("__iri").isNotNull(), F.concat("__iri", local)).otherwise(F.col(column))
    return joined.withColumn(column, whole).select(*df.columns)


def expand_prefixes(triples: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Expand subjects, predicates, IRI objects and datatypes."""
    typed = "o_kind" in triples.columns
    link = F.when(F.col("o_kind") == "iri", F.col("o")) if typed else F.col("o")
    source = triples.withColumn("__link", link)
    out = source
    for column in ["s", "p", "__link", *(["o_datatype"] if typed and "o_datatype" in triples.columns else [])]:
        out = expand_column(out, column, prefixes, source)
    return out.withColumn("o", F.coalesce("__link", "o")).select(*triples.columns)
