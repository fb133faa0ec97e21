"""RDF/XML with flat ``rdf:Description`` elements, read and written by many tasks.

Files are cut after each closing ``rdf:Description``.  A task feeds each piece to an incremental XML parser and takes its
events; namespaces declared within a piece are in scope there, those of a file's root element are found in its first
piece and joined to all others by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number
from trivane.operators.bgp import BROADCAST_BYTES, weight
from trivane.operators.skew import CHUNK_ROWS, chunked
from trivane.session import materialize
from trivane.store import SPO
from trivane.terms import RDF_TYPE

# The end of an element, the namespaces of RDF and XML, and the characters XML escapes.
DESCRIPTION_END = "</rdf:Description>"
RDF_NAMESPACE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"
BASE_SCOPE = {"rdf": RDF_NAMESPACE, "xml": XML_NAMESPACE}
NOTHING: dict[str, str] = {}
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
# A predicate that is an IRI is cut before its longest end that can be an element's name.
IRI_PARTS = r"^(.*?[^\w.-])([A-Za-z_][\w.-]*)$"
ROOT = re.compile(r"<(?:[\w.-]+:)?RDF[\s>]")
ROOT_END = re.compile(r"</(?:[\w.-]+:)?RDF\s*>")
DESCRIPTION = re.compile(r"<(?:[\w.-]+:)?Description[\s>/]")

SCHEMA = "file string, kind string, s string, p string, o string, o_kind string, o_datatype string, o_lang string, prefix string"
NAMES = ["file", "kind", "s", "p", "o", "o_kind", "o_datatype", "o_lang", "prefix"]


def xml_escape(column: Column) -> Column:
    for plain, entity in ENTITIES:
        column = F.replace(column, F.lit(plain), F.lit(entity))
    return column


@lru_cache(1 << 14)
def _base_name(name: str, attribute: bool) -> tuple[str, str | None]:
    """(IRI or name as written, prefix that only the root can declare) where a piece declares nothing."""
    prefix, colon, local = name.rpartition(":")
    if attribute and not colon:
        return name, None
    return (BASE_SCOPE[prefix] + local, None) if prefix in BASE_SCOPE else (name, prefix)


class Description:
    """Takes the events of one piece: a description element, in the first piece of a file below the root."""

    def __init__(self, depth: int) -> None:
        # How deep the description lies; the root, where there is one, is above it.
        self._at = depth
        self._scopes: list[dict[str, str]] = [BASE_SCOPE]
        self._declares = False
        self.namespaces: dict[str, str] = {}
        self.rows: list[tuple] = []
        self.fault: str | None = None
        self._subject: str | None = None
        self._property: tuple | None = None
        self._text: list[str] = []

    def _name(self, name: str, attribute: bool = False) -> tuple[str, str | None]:
        """(IRI or name as written, prefix that only the root can declare)."""
        if not self._declares:
            return _base_name(name, attribute)
        prefix, colon, local = name.rpartition(":")
        if attribute and not colon:
            return name, None
        for scope in reversed(self._scopes):
            if prefix in scope:
                return scope[prefix] + local, None
        return name, prefix

    def start(self, name: str, attributes: dict[str, str]) -> None:
        depth = len(self._scopes) - 1
        if not attributes and depth == self._at + 1:
            # The most frequent element, a property with text.
            self._scopes.append(NOTHING)
            self._property = (*self._name(name), None, None, None)
            self._text = []
            return
        declared = {k[6:]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        self._declares |= bool(declared)
        self._scopes.append(declared)
        if depth < self._at:
            self.namespaces.update(declared)
            return
        plain = {self._name(k, True): v for k, v in attributes.items() if not k.startswith("xmlns")}
        known = {k: v for (k, prefix), v in plain.items() if prefix is None}
        rdf = lambda local: known.get(RDF_NAMESPACE + local)
        if depth == self._at:
            node = rdf("nodeID")
            self._subject = rdf("about") if rdf("about") is not None else f"_:{node}" if node else None
            if self._subject is None:
                self.fault = "a description without a subject"
                return
            kind, prefix = self._name(name)
            if kind != RDF_NAMESPACE + "Description":
                self.rows.append((self._subject, RDF_TYPE, kind, "iri", None, None, prefix))
            for (key, prefix), value in plain.items():
                if not key.startswith((RDF_NAMESPACE, XML_NAMESPACE)):
                    self.rows.append((self._subject, key, value, "literal", None, None, prefix))
        elif depth == self._at + 1:
            predicate, prefix = self._name(name)
            node = rdf("nodeID")
            link = rdf("resource") if rdf("resource") is not None else f"_:{node}" if node else None
            self._property = (predicate, prefix, link, rdf("datatype"), known.get(XML_NAMESPACE + "lang"))
            self._text = []
        else:
            self.fault = f"an element within a property: {name}"

    def text(self, data: str) -> None:
        if self._property is not None:
            self._text.append(data)

    def end(self, name: str) -> None:
        self._scopes.pop()
        if self._property is None or len(self._scopes) - 1 != self._at + 1:
            return
        predicate, prefix, link, datatype, lang = self._property
        self._property = None
        value = "".join(self._text).strip()
        if self._subject is None:
            return
        if link is not None:
            kind = "bnode" if link.startswith("_:") else "iri"
            self.rows.append((self._subject, predicate, link, kind, None, None, prefix))
        elif value:
            self.rows.append((self._subject, predicate, value, "literal", datatype, lang, prefix))


def parse_piece(text: str) -> Description:
    """The events of one piece, with or without its end tag; ``fault`` says what is wrong with it."""
    whole = "RDF" in text and bool(ROOT.search(text))
    found = Description(1)
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = found.start, found.end
    parser.CharacterDataHandler = found.text
    try:
        end = "" if text.rstrip().endswith(DESCRIPTION_END) else DESCRIPTION_END
        parser.Parse((text.lstrip() if whole else f"<piece>{text}") + end)
    except expat.ExpatError as error:
        found.fault = str(error)
    return found


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces: triples, namespaces of roots, and what can't be read."""
    for batch in batches:
        rows: list[tuple] = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rest = (ROOT_END.sub("", text) if "RDF" in text else text).strip()
            if not rest:
                continue
            if "<" not in rest or not DESCRIPTION.search(rest):
                # What follows the last description: comments, or a root without any.
                if not ROOT.search(rest) and not rest.startswith("<!--"):
                    rows.append((file, "reject", None, None, text, None, None, "no description", None))
                continue
            found = parse_piece(text)
            rows += [(file, "namespace", None, None, iri, None, None, None, prefix) for prefix, iri in found.namespaces.items()]
            if found.fault is not None:
                rows.append((file, "reject", None, None, text, None, None, found.fault, None))
                continue
            rows += [(file, "triple", *row) for row in found.rows]
        columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=NAMES)


@dataclass(frozen=True)
class RdfXml:
    """``triples`` with full names, ``namespaces`` ``(file, prefix, iri)``, ``rejects`` ``(file, value, fault)``."""

    triples: DataFrame
    namespaces: DataFrame
    rejects: DataFrame


def scan_rdfxml(spark: SparkSession, path: str) -> RdfXml:
    """Read RDF/XML files.

    Subjects by ``rdf:about`` or ``rdf:nodeID``, property elements with text, ``rdf:resource``, ``rdf:datatype`` or ``xml:lang``, and
    property attributes.  A description within a description, a fault of the XML or a missing subject makes a reject of
    its piece.  Names whose namespace nobody declares stay as written.  A large file spreads over tasks, and no pass
    over the data finds a schema.
    """
    records = spark.read.option("lineSep", DESCRIPTION_END).text(path).select("_metadata.file_path", "value")
    found = materialize(records.mapInArrow(scan, SCHEMA), "rdfxml")
    namespaces = found.filter("kind = 'namespace'").select("file", "prefix", F.col("o").alias("iri")).distinct()
    raw = found.filter("kind = 'triple'")
    tables = namespaces.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "iri"))).alias("table"))
    if weight(namespaces) <= BROADCAST_BYTES:
        tables = F.broadcast(tables)
    # Names with a prefix of their own scope are full already.
    joined = raw.join(tables, "file", "left")
    base = F.col("table")[F.col("prefix")]

    def full(name: str, here: Column) -> Column:
        local = F.element_at(F.split(F.col(name), ":"), -1)
        return F.when(here & F.col("prefix").isNotNull() & base.isNotNull(), F.concat(base, local)).otherwise(F.col(name))

    is_type = (F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")
    literal = F.col("o_kind") == "literal"
    triples = joined.select(
        "s",
        full("p", ~is_type).alias("p"),
        full("o", is_type).alias("o"),
        "o_kind",
        "o_datatype",
        "o_lang",
        F.when(literal, as_number(F.col("o"))).alias("o_num"),
    )
    rejects = found.filter("kind = 'reject'").select("file", F.col("o").alias("value"), F.col("o_lang").alias("fault"))
    return RdfXml(triples, namespaces, rejects)


def read_rdfxml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples and namespaces (prefix, iri); :func:`scan_rdfxml` also gives rejects."""
    found = scan_rdfxml(spark, path)
    return found.triples, found.namespaces.select("prefix", "iri").distinct()


def _element(df: DataFrame, prefixes: dict[str, str]) -> Column:
    """The property element of a triple; a predicate that is an IRI gets a prefix, a known one or its own."""
    name, space = F.col("p"), F.lit("")
    is_iri = F.contains("p", F.lit("://")) | F.col("p").startswith("urn:")
    head, local = F.regexp_extract("p", IRI_PARTS, 1), F.regexp_extract("p", IRI_PARTS, 2)
    unnamed = F.raise_error(F.concat(F.lit("no element can be named after the predicate "), F.col("p")))
    known = F.lit(None).cast("string")
    for prefix, iri in {**prefixes, "rdf": RDF_NAMESPACE}.items():
        if prefix:
            known = F.when(head == iri, F.lit(prefix)).otherwise(known)
    own = F.concat(F.lit(' xmlns:ns="'), xml_escape(head), F.lit('"'))
    name = F.when(is_iri, F.when(local == "", unnamed).otherwise(F.concat(F.coalesce(known, F.lit("ns")), F.lit(":"), local))).otherwise(name)
    space = F.when(is_iri & known.isNull(), own).otherwise(space)
    has = set(df.columns)
    words = F.concat(F.lit(">"), xml_escape(F.col("o")), F.lit("</"), name, F.lit(">\n"))
    if "o_lang" in has:
        words = F.concat(F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).otherwise(""), words)
    if "o_datatype" in has:
        words = F.concat(
            F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), xml_escape(F.col("o_datatype")), F.lit('"'))).otherwise(""),
            words,
        )
    if "o_kind" in has:
        link = F.concat(F.lit(' rdf:resource="'), xml_escape(F.col("o")), F.lit('"/>\n'))
        blank = F.concat(F.lit(' rdf:nodeID="'), F.substring("o", 3, 1 << 20), F.lit('"/>\n'))
        words = F.when(F.col("o_kind") == "iri", link).when(F.col("o_kind") == "bnode", blank).otherwise(words)
    return F.concat(F.lit("    <"), name, space, words)


def render_rdfxml(triples: DataFrame, chunk_rows: int = CHUNK_ROWS, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One ``rdf:Description`` element per subject: ``(s, chunk, xml)``.

    A subject with more than ``chunk_rows`` triples gets several elements, which RDF/XML reads as one
    subject, so a hot subject is not rendered by one task.  ``prefixes`` are those the document declares.  With ``o_kind``
    links, blank nodes, languages and datatypes are written as such, without it every object is text.
    """
    kept = [c for c in (*SPO, "o_kind", "o_datatype", "o_lang") if c in triples.columns]
    split = chunked(triples.select(*kept), ["s"], SPO, chunk_rows)
    # In a projection of its own, so that what is constant in a branch of a union is folded there.
    tagged = split.select("s", "chunk", _element(split, prefixes or {}).alias("tag"))
    bodies = tagged.groupBy("s", "chunk").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    about = F.when(F.col("s").startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.substring("s", 3, 1 << 20)))
    element = F.concat(
        F.lit("  <rdf:Description "),
        about.otherwise(F.concat(F.lit('rdf:about="'), xml_escape(F.col("s")))),
        F.lit('">\n'),
        F.array_join("tags", ""),
        F.lit("  " + DESCRIPTION_END),
    )
    return bodies.select("s", "chunk", element.alias("xml"))


def header(prefixes: dict[str, str]) -> str:
    spaces = {**{k: v for k, v in prefixes.items() if k != "rdf"}, "rdf": RDF_NAMESPACE}
    names = "".join(f' xmlns{":" + k if k else ""}="{v}"' for k, v in spaces.items())
    return f'<?xml version="1.0"?>\n<rdf:RDF{names}>'


def write_rdfxml(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Write part files, each a whole document: every task puts the header before its elements."""
    first, last = header(prefixes or {}), "</rdf:RDF>"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            lines = batch.column(0)
            if not opened and len(lines):
                lines = pa.array([f"{first}\n{lines[0].as_py()}", *lines[1:].to_pylist()], pa.string())
                opened = True
            yield pa.RecordBatch.from_arrays([lines], names=["value"])
        if opened:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string())], names=["value"])

    render_rdfxml(triples, prefixes=prefixes).select("xml").mapInArrow(documents, "value string").write.text(path)
