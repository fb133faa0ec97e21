"""N3 statements read by a scanner, with prefixes that hold per file from where they are declared.

Spark splits files at line ends, and each task scans its splits line by line: no term crosses a line end, so only the
statement that a split border cuts is left over.  Its pieces, two rows per split, are put together afterwards and
scanned by the same machine.  Every row carries its place (split start, statement number), by which a prefix applies to
the statements after its declaration in its own file and to no other file.  A task knows what the prefixes declared in
its own split mean; names with other prefixes get the meaning that was in force before the split, found from the last
declarations of each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.operators.bgp import BROADCAST_BYTES, weight
from trivane.session import materialize
from trivane.sources.text import QUOTED, typed_terms
from trivane.terms import RDF_TYPE

# The tokens of a line.  A dot within a name belongs to it, a dot at its end ends the statement.
TOKEN = re.compile(
    r"<[^<>\s]*>"
    rf'|"{QUOTED}"(?:\^\^(?:<[^<>\s]*>|[^\s;,."<>]+(?:\.[^\s;,."<>]+)*)|@[A-Za-z0-9-]+)?'
    r"|\#.*"
    r"|[.;,]"
    r'|[^\s;,."<>\#][^\s;,."<>]*(?:\.[^\s;,."<>]+)*'
    r"|\S"
)
TYPE = "a"
PREFIX = "@prefix"
# What begins a split comes before its whole statements, what a split border cuts off comes after them.
HEAD, CUT = -1, 1 << 60

# The last three columns are the IRIs meant by the prefixes of s, p and o (or of its type) where the split declares them.
SCHEMA = (
    "file string, block bigint, no bigint, kind string, part int, ended boolean, s string, p string, o string, "
    "s_iri string, p_iri string, o_iri string"
)
NAMES = ["file", "block", "no", "kind", "part", "ended", "s", "p", "o", "s_iri", "p_iri", "o_iri"]
NOWHERE = (None, None, None)
LITERAL_TYPE = re.compile(rf'"{QUOTED}"\^\^([^<].*)$')


def tokens(line: str) -> list[str]:
    return [t for t in TOKEN.findall(line) if t[0] != "#"]


def meant_by(term: str, known: dict[str, str]) -> str | None:
    """The IRI that the prefix of a term, or of a literal's type, stands for; None if it has none or it is not known."""
    if term[0] == "<" or not known:
        return None
    if term[0] == '"':
        typed = LITERAL_TYPE.match(term) if '"^^' in term else None
        if typed is None:
            return None
        term = typed[1]
    prefix, colon, _ = term.partition(":")
    return known.get(prefix) if colon and not term.startswith("_:") else None


class Statement:
    """Takes the tokens of one statement and knows what they say so far."""

    def __init__(self) -> None:
        self.seen: list[str] = []
        self.triples: list[tuple[str, str, str]] = []
        self.subject = self.predicate = None
        self.state = "subject"

    def feed(self, token: str) -> None:
        self.seen.append(token)
        term = token[0] in '<"' and len(token) > 1 or token[0] not in '.;,<"@'
        if self.state == "subject" and token == PREFIX:
            self.state = "prefix"
        elif self.state == "prefix":
            # The name and its IRI are looked at when the statement ends.
            pass
        elif self.state == "subject" and term and token[0] != '"':
            self.subject, self.state = token, "predicate"
        elif self.state in ("predicate", "next") and term and token[0] != '"':
            self.predicate, self.state = (f"<{RDF_TYPE}>" if token == TYPE else token), "object"
        elif self.state == "object" and term:
            self.triples.append((self.subject, self.predicate, token))
            self.state = "more"
        elif self.state in ("more", "next") and token == ";":
            self.state = "next"  # a repeated or a last semicolon says nothing
        elif self.state == "more" and token == ",":
            self.state = "object"
        else:
            self.state = "bad"

    def rows(self) -> Iterator[tuple[str, str | None, str | None, str | None]]:
        """(kind, s, p, o) of the statement, which has come to its end."""
        if self.state in ("more", "next"):
            yield from (("triple", *t) for t in self.triples)
        elif self.state == "prefix" and len(self.seen) == 3 and self.seen[1].endswith(":") and self.seen[2][0] == "<":
            yield "prefix", self.seen[1][:-1], None, self.seen[2][1:-1]
        elif self.seen:
            yield "reject", None, None, " ".join([*self.seen, "."])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), *[pa.string()] * 6]
    columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole statements, and the pieces of cut ones: part 0 before a split's first end, part 1 after its last."""
    here, number, statement, first = None, 0, Statement(), False
    known: dict[str, str] = {}
    rows: list[tuple] = []

    def piece(part: int, ended: bool) -> None:
        rows.append((*here, CUT if part else HEAD, "piece", part, ended, None, None, " ".join(statement.seen), *NOWHERE))

    for batch in batches:
        for file, block, line in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (file, block) != here:
                if here is not None and statement.seen:
                    piece(0 if first else 1, False)
                here, number, statement, first = (file, block), 0, Statement(), block > 0
                known = {}
            for token in tokens(line):
                if token != ".":
                    statement.feed(token)
                    continue
                if first:
                    piece(0, True)
                else:
                    for kind, *terms in statement.rows():
                        iris = [meant_by(t, known) for t in terms] if kind == "triple" else NOWHERE
                        rows.append((*here, number, kind, None, None, *terms, *iris))
                        if kind == "prefix":
                            known[terms[0]] = terms[2]
                    number += 1
                statement, first = Statement(), False
        yield _batch(rows)
        rows.clear()
    if here is not None and statement.seen:
        piece(0 if first else 1, False)
    yield _batch(rows)


def scan_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of statements put together from pieces; one that never ends is rejected."""
    for batch in batches:
        rows: list[tuple] = []
        for file, block, number, ended, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            statement = Statement()
            for token in tokens(text):
                statement.feed(token)
            found = list(statement.rows()) if ended else [("reject", None, None, text)] if text else []
            rows += [(file, block, number, kind, None, None, s, p, o, *NOWHERE) for kind, s, p, o in found]
        yield _batch(rows)


@dataclass(frozen=True)
class N3:
    """What N3 files say.

    ``triples`` have their prefixes expanded, ``prefixes`` is ``(file, prefix, iri, place)`` and ``rejects`` is
    ``(file, place, value)``: statements without three terms, with stray characters, or without an end.
    """

    triples: DataFrame
    prefixes: DataFrame
    rejects: DataFrame


def read_n3(spark: SparkSession, path: str) -> N3:
    """Read N3 files: comments, ``@prefix``, predicate lists with ``;`` and object lists with ``,``, ``a`` for the type.

    Any number of statements may share a line and a statement may take any number of lines; line ends may be of any
    kind.  Unknown prefixes stay as written.  A task holds one statement of a split at a time.
    """
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    scanned = materialize(lines.mapInArrow(scan_lines, SCHEMA), "n3")
    pieces = scanned.filter("kind = 'piece'")
    before = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    # One or two rows per split: those up to an end belong to one statement.
    joined = pieces.withColumn("statement", F.coalesce(F.sum(F.col("ended").cast("int")).over(before), F.lit(0)))
    whole = joined.groupBy("file", "statement").agg(
        F.min(F.struct("block", "no")).alias("place"),
        F.max("ended").alias("ended"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "o"))), lambda x: x["o"]), " ").alias("text"),
    )
    put_together = whole.select("file", "place.block", "place.no", "ended", "text").mapInArrow(scan_pieces, SCHEMA)
    found = scanned.filter("kind != 'piece'").unionByName(materialize(put_together, "n3-cut"))
    place = F.struct("block", "no").alias("place")
    prefixes = found.filter("kind = 'prefix'").select("file", F.col("s").alias("prefix"), F.col("o").alias("iri"), place)
    raw = found.filter("kind = 'triple'").select("file", "block", _part().alias("part"), *NAMES[6:])
    rejects = found.filter("kind = 'reject'").select("file", place, F.col("o").alias("value"))
    declared = found.filter("kind = 'prefix'").select("file", "block", "no", F.col("s").alias("prefix"), F.col("o").alias("iri"))
    return N3(_expanded(raw, declared), prefixes, rejects)


def _part() -> Column:
    """The part of a split a statement lies in: what begins it, its whole statements, or what its border cuts off."""
    return F.when(F.col("no").isin(HEAD, CUT), F.col("no")).otherwise(F.lit(0).cast("bigint"))


def _prefixed(name: Column) -> Column:
    return F.contains(name, F.lit(":")) & ~name.startswith("_:")


def _prefix(name: Column) -> Column:
    return F.split_part(name, F.lit(":"), F.lit(1))


def _in_force(raw: DataFrame, declared: DataFrame, names: dict[str, Column]) -> DataFrame:
    """What prefixes mean before a part of a split: ``(file, block, part, prefix, iri)`` for those asked for there.

    Asked for are the prefixes that the split itself has not declared before.  Of a split's declarations the last of each
    prefix counts for what follows, so rows are counted by splits and prefixes, not by declarations or triples.
    """
    unknown = [F.when(_prefixed(n) & F.col(f"{c}_iri").isNull(), _prefix(n)) for c, n in names.items()]
    asked = raw.select("file", "block", "part", F.explode(F.array_compact(F.array(*unknown))).alias("prefix")).distinct()
    last = declared.groupBy("file", "block", _part().alias("part"), "prefix").agg(F.max_by("iri", "no").alias("iri"))
    both = asked.select("*", F.lit(None).cast("string").alias("iri"), F.lit(0).alias("told")).unionByName(
        last.select("*", F.lit(1).alias("told"))
    )
    # A part that asks comes before what its own split declares.
    before = Window.partitionBy("file", "prefix").orderBy("block", "part", "told").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("iri", F.last("iri", ignorenulls=True).over(before))
    return known.filter("told = 0 AND iri IS NOT NULL").drop("told")


def _expanded(raw: DataFrame, declared: DataFrame) -> DataFrame:
    """Triples with full terms: one join per row with the table of what prefixes meant before its part of a split.

    Such a table is one row.  They are broadcast if their counted bytes are few; else the join is by shuffle, with the rows of
    one split for each.
    """
    literal_type = F.regexp_extract("o", rf'^"{QUOTED}"\^\^([^<].*)$', 1)
    marked = lambda c: F.col(c).startswith("<") | F.col(c).startswith('"')
    names = {c: F.when(~marked(c), F.col(c)) for c in ("s", "p")}
    names["o"] = F.when(~marked("o"), F.col("o")).when(literal_type != "", literal_type)
    known = materialize(_in_force(raw, declared, names), "n3-prefixes")
    tables = known.groupBy("file", "block", "part").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "iri"))).alias("table"))
    if weight(known.select("file", "prefix", "iri")) <= BROADCAST_BYTES:
        tables = F.broadcast(tables)
    joined = raw.join(tables, ["file", "block", "part"], "left")

    def full(name: Column, column: str) -> Column:
        """A name with its prefix replaced by what it meant last before this place."""
        meant = F.coalesce(F.col(f"{column}_iri"), F.col("table")[_prefix(name)])
        local = F.substring(name, F.instr(name, ":") + 1, F.length(name))
        return F.when(_prefixed(name) & meant.isNotNull(), F.concat(meant, local)).otherwise(name)

    def term(column: str) -> Column:
        return F.when(F.col(column).startswith("<") | F.col(column).startswith('"'), F.col(column)).otherwise(
            F.concat(F.lit("<"), full(F.col(column), column), F.lit(">"))
        )

    typed = F.when(literal_type != "", F.concat(F.regexp_extract("o", rf'^("{QUOTED}"\^\^)', 1), F.lit("<"), full(literal_type, "o"), F.lit(">")))
    # Only names are marked as IRIs; numbers and other bare words stay what they are.
    bare = ~F.col("o").rlike('^[<"]') & ~F.contains(F.col("o"), F.lit(":"))
    blank = F.col("o").startswith("_:")
    obj = F.when(bare | blank, F.col("o")).otherwise(F.coalesce(typed, term("o")))
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(term("s"))
    full_rows = joined.select(subject.alias("s"), term("p").alias("p"), obj.alias("o"))
    return typed_terms(full_rows, F.col("s"), F.col("p"), F.col("o"))
