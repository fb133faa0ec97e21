import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane import Select, TripleStore
from trivane.functions.expressions import compare
from trivane.operators.wide import PropertyTable
from trivane.sources import n3, rdfxml, text
from trivane.terms import RDF_TYPE


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_ntriples(spark):
    src = lines(
        spark,
        "# comment", "", "  ",
        "<http://a> <http://p> <http://b> .",
        '<http://a> <http://p> "x \\"quoted\\" \\\\n <tag> . end" .',
        '<http://a><http://q>"5"^^<http://int>.',
        '_:b1 <http://p> "hallo"@de .',
        "<http://a> <http://p> <http://nodot>",
        "<http://a> <http://p> .",
    )
    got = tuples(text.parse_ntriples(src), "s", "p", "o", "o_kind", "o_datatype", "o_lang", "o_num")
    assert got == sorted(
        [
            ("http://a", "http://p", "http://b", "iri", None, None, None),
            ("http://a", "http://p", 'x "quoted" \\n <tag> . end', "literal", None, None, None),
            ("http://a", "http://q", "5", "literal", "http://int", None, 5.0),
            ("_:b1", "http://p", "hallo", "literal", None, "de", None),
        ],
        key=str,
    )
    assert len(text.ntriples_rejects(src).collect()) == 2


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("http://a", "http://p", 'line\nbreak\t"q" \\ back', "literal", None, "en"), ("_:x", "http://p", "_:y", "bnode", None, None)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    text.write_ntriples(df, str(tmp_path / "nt"))
    back = text.read_ntriples(spark, str(tmp_path / "nt"))
    assert tuples(back, *df.columns) == tuples(df)


def test_a_literal_of_any_length_parses(spark):
    long = "word " * 200_000
    row = text.parse_ntriples(lines(spark, f'<a> <b> "{long}\\"{long}" .')).first()
    assert row.o == f'{long}"{long}'


def test_turtle_lines(spark):
    src = lines(spark, "@prefix ex: <http://e/> .", 'ex:a ex:name "John Smith" .', "ex:a ex:knows ex:b .", "ex:a ex:short", "ex:a ex:age 30 .")
    got = tuples(text.parse_turtle_lines(src), "s", "p", "o")
    assert got == [("ex:a", "ex:age", "30"), ("ex:a", "ex:knows", "ex:b"), ("ex:a", "ex:name", "John Smith")]


N3 = """@prefix ex: <http://example.org/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# people
ex:John
    ex:name "John; the first. Really" ;   # with a comment
    ex:annualSalary "75000"^^xsd:integer ;
    ex:knows ex:Jane , ex:Jim .
<http://other.org/x> ex:site <http://a.b/c#d> .
"""


def test_n3(spark, tmp_path):
    (tmp_path / "data.n3").write_text(N3)
    triples, prefixes = text.read_n3(spark, str(tmp_path / "data.n3"))
    got = tuples(text.expand_prefixes(triples, prefixes), "s", "p", "o", "o_datatype", "o_num")
    john, ex = "http://example.org/John", "http://example.org/"
    assert got == sorted(
        [
            (john, ex + "name", "John; the first. Really", None, None),
            (john, ex + "annualSalary", "75000", "http://www.w3.org/2001/XMLSchema#integer", 75000.0),
            (john, ex + "knows", ex + "Jane", None, None),
            (john, ex + "knows", ex + "Jim", None, None),
            ("http://other.org/x", ex + "site", "http://a.b/c#d", None, None),
        ],
        key=str,
    )


def test_prefixes_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(text, "BROADCAST_BYTES", 1)
    df = spark.createDataFrame([(f"ex:a{i}", "o:p", "zz:q") for i in range(50)], "s string, p string, o string")
    prefixes = spark.createDataFrame([("ex", "E/"), ("o", "O/")], "prefix string, iri string")
    assert tuples(text.expand_prefixes(df, prefixes)) == sorted([(f"E/a{i}", "O/p", "zz:q") for i in range(50)], key=str)


XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:foaf="http://xmlns.com/foaf/0.1/" xmlns:ds="http://d/">
  <rdf:Description rdf:about="http://e/1">
    <foaf:title>Developer &amp; Lead</foaf:title>
    <foaf:workplaceHomepage rdf:resource="http://work/1"/>
    <ds:annual_salary>75000.5</ds:annual_salary>
    <ds:empty></ds:empty>
  </rdf:Description>
  <rdf:Description rdf:about="http://e/2"><foaf:title>Manager</foaf:title></rdf:Description>
</rdf:RDF>
"""


def test_rdfxml(spark, tmp_path):
    (tmp_path / "d.rdf").write_text(XML)
    triples, spaces = rdfxml.read_rdfxml(spark, str(tmp_path / "d.rdf"))
    got = tuples(text.expand_prefixes(triples, spaces), "s", "p", "o", "o_num")
    foaf = "http://xmlns.com/foaf/0.1/"
    assert got == sorted(
        [
            ("http://e/1", foaf + "title", "Developer & Lead", None),
            ("http://e/1", foaf + "workplaceHomepage", "http://work/1", None),
            ("http://e/1", "http://d/annual_salary", "75000.5", 75000.5),
            ("http://e/2", foaf + "title", "Manager", None),
        ],
        key=str,
    )
    assert ("ds", "http://d/") in tuples(spaces)


def test_rdfxml_splits_a_hot_subject(spark, tmp_path):
    rows = [("hot", "p:x", f"v{i}") for i in range(500)] + [("cold", "p:x", "v")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    rendered = rdfxml.render_rdfxml(df, chunk_rows=50)
    sizes = [r.xml.count("<p:x>") for r in rendered.filter("s = 'hot'").collect()]
    assert sum(sizes) == 500 and len(sizes) > 5 and max(sizes) < 120
    rdfxml.write_rdfxml(df, str(tmp_path / "x"))
    back, _ = rdfxml.read_rdfxml(spark, str(tmp_path / "x"))
    assert tuples(back, "s", "p", "o") == sorted(rows, key=str)


def test_two_iris_for_a_prefix_are_an_error(spark):
    df = spark.createDataFrame([("ex:a", "p", "o")], "s string, p string, o string")
    twice = spark.createDataFrame([("ex", "E/"), ("ex", "E/")], "prefix string, iri string")
    assert tuples(text.expand_prefixes(df, twice)) == [("E/a", "p", "o")]
    with pytest.raises(Exception, match="several IRIs"):
        text.expand_prefixes(df, twice.union(spark.createDataFrame([("ex", "F/")], "prefix string, iri string"))).collect()


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of so few bytes that most statements lie across a border."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield cut
    for n, value in before.items():
        spark.conf.set(n, value)


def n3_text(end="\n"):
    """Statements over and within lines, and what they say."""
    out, want = ["@prefix ex: <http://one/> .", "@prefix x.y: <http://dot/> ."], []
    for i in range(40):
        if i == 25:
            out.append("@prefix ex: <http://later/> .")
        ex = "http://one/" if i < 25 else "http://later/"
        if i % 3 == 0:
            out += [f"ex:s{i}", f'  a ex:Thing ;  # a "comment" . with dots', f'  ex:says "a. b; c, # {i}" , ex:o{i}', ";", "  ex:n", f"    {i}.5", "."]
            want += [(f"{ex}s{i}", RDF_TYPE, f"{ex}Thing"), (f"{ex}s{i}", f"{ex}says", f"a. b; c, # {i}"), (f"{ex}s{i}", f"{ex}says", f"{ex}o{i}")]
            want += [(f"{ex}s{i}", f"{ex}n", f"{i}.5")]
        else:
            out.append(f"ex:s{i} ex:p ex:o.{i} . <http://a#b> ex:q x.y:z{i}. _:b{i} ex:t \"5\"^^ex:int.")
            want += [(f"{ex}s{i}", f"{ex}p", f"{ex}o.{i}"), ("http://a#b", f"{ex}q", f"http://dot/z{i}"), (f"_:b{i}", f"{ex}t", "5")]
    return end.join(out) + end, want


@pytest.mark.parametrize("size, end", [(160, "\r\n"), (1 << 20, "\n")])
def test_n3_over_split_borders(spark, tmp_path, small_splits, end, size):
    written, want = n3_text(end)
    (tmp_path / "data.n3").write_bytes(written.encode())
    small_splits(size)
    found = n3.read_n3(spark, str(tmp_path / "data.n3"))
    assert found.rejects.collect() == []
    assert tuples(found.triples, "s", "p", "o") == sorted(want, key=str)
    assert found.triples.filter("o_datatype = 'http://one/int'").count() > 5


def test_n3_prefixes_hold_in_their_file(spark, tmp_path):
    (tmp_path / "a.n3").write_text("@prefix ex: <http://a/> . ex:x ex:p ex:y . ex:z ex:p un:known .")
    (tmp_path / "b.n3").write_text("ex:early ex:p 1 . @prefix ex: <http://b/> . ex:x ex:p ex:y .")
    found = n3.read_n3(spark, str(tmp_path))
    assert tuples(found.triples, "s", "p", "o") == sorted(
        [("http://a/x", "http://a/p", "http://a/y"), ("http://a/z", "http://a/p", "un:known"), ("http://b/x", "http://b/p", "http://b/y"), ("ex:early", "ex:p", "1")],
        key=str,
    )
    assert tuples(found.prefixes, "prefix", "iri") == [("ex", "http://a/"), ("ex", "http://b/")]


def test_n3_rejects(spark, tmp_path, small_splits):
    lines = ["<a> <p> <b> .", "<a> <p> .", "<a> <p> <b> <c> .", '"lit" <p> <b> .', "<a> <p> <b c> .", '<a> <p> "open .', "<a> <p> <b> ; ; <q> <c> ; .", "<a> <p> <b> , .", ". <a> <p> <end>"]
    (tmp_path / "bad.n3").write_text("\n".join(lines))
    for size in (30, 1 << 20):
        small_splits(size)
        found = n3.read_n3(spark, str(tmp_path / "bad.n3"))
        assert tuples(found.triples, "s", "p", "o") == [("a", "p", "b"), ("a", "p", "b"), ("a", "q", "c")]
        assert len(found.rejects.collect()) == 7


ODD_XML = """<?xml version='1.0'?>
<!-- two kinds of quotes -->
<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:f="http://f/" xmlns='http://plain/'>
  <rdf:Description rdf:about='u1'><f:t xml:lang='en'>&#65;&apos;&lt;b&gt; "q"</f:t><name><![CDATA[a < b]]></name></rdf:Description>
  <rdf:Description rdf:about="u2" xmlns:g="http://g/"><g:x rdf:resource='u&amp;3'/><f:n rdf:datatype="http://int">5</f:n></rdf:Description>
  <rdf:Description f:short="v" rdf:nodeID="n1"><f:to rdf:nodeID="n2"/></rdf:Description>
  <rdf:Description><f:t>nobody</f:t></rdf:Description>
  <rdf:Description rdf:about="u4"><f:t>broken</f:x></rdf:Description>
  <rdf:Description rdf:about="u5"><un:known>k</un:known></rdf:Description>
</rdf:RDF>
"""


def test_rdfxml_events(spark, tmp_path, small_splits):
    (tmp_path / "a.rdf").write_text(ODD_XML)
    (tmp_path / "b.rdf").write_text(XML.replace("http://xmlns.com/foaf/0.1/", "http://other/").replace("http://e/", "http://b/"))
    small_splits(200)
    found = rdfxml.scan_rdfxml(spark, str(tmp_path))
    got = tuples(found.triples.filter("s not like 'http%'"), "s", "p", "o", "o_kind", "o_datatype", "o_lang", "o_num")
    assert got == sorted(
        [
            ("u1", "http://f/t", "A'<b> \"q\"", "literal", None, "en", None),
            ("u1", "http://plain/name", "a < b", "literal", None, None, None),
            ("u2", "http://g/x", "u&3", "iri", None, None, None),
            ("u2", "http://f/n", "5", "literal", "http://int", None, 5.0),
            ("_:n1", "http://f/short", "v", "literal", None, None, None),
            ("_:n1", "http://f/to", "_:n2", "bnode", None, None, None),
            ("u5", "un:known", "k", "literal", None, None, None),
        ],
        key=str,
    )
    assert {r["p"] for r in found.triples.filter("s like 'http%'").collect()} >= {"http://other/title", "http://d/annual_salary"}
    assert sorted(r["fault"].split(":")[0] for r in found.rejects.collect()) == ["a description without a subject", "mismatched tag"]


def test_rdfxml_round_trip_of_any_predicate(spark, tmp_path):
    rows = [
        ("http://s/1?a=1&b=2", "http://e/name", 'x "<&>"', "literal", None, "en"),
        ("http://s/1?a=1&b=2", "http://e#born", "5", "literal", "http://int", None),
        ("http://s/2", "urn:isbn:title", "http://o/2", "iri", None, None),
        ("_:b", "plain", "_:c", "bnode", None, None),
        ("http://s/2", "http://known/p", "v", "literal", None, None),
    ]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    rdfxml.write_rdfxml(df, str(tmp_path / "x"), {"k": "http://known/"})
    back = rdfxml.scan_rdfxml(spark, str(tmp_path / "x"))
    assert back.rejects.collect() == [] and tuples(back.triples, *df.columns) == tuples(df)
    with pytest.raises(Exception, match="no element can be named"):
        rdfxml.render_rdfxml(spark.createDataFrame([("s", "http://e/1", "o")], "s string, p string, o string")).collect()


def test_short_type_predicate_of_loaded_triples(spark, tmp_path):
    (tmp_path / "t.n3").write_text("<x> a <T> .")
    assert TripleStore.of(text.read_n3(spark, str(tmp_path))[0]).lookup(p="a").count() == 1
    given = spark.createDataFrame([("x", "a", "T"), ("x", RDF_TYPE, "T")], "s string, p string, o string")
    assert tuples(Select("?x").where(("?x", "a", "T")).run(TripleStore.of(given))) == [("x",)]


def test_words_are_no_numbers_in_any_form(spark):
    """Subjects 1d and nan are text over a property table, over triples and in a feed."""
    wide = spark.createDataFrame([("1d", "v"), ("nan", "v"), ("7", "v")], "id string, t string")
    table = PropertyTable(wide, "id", {"t": ("t", "cast(NULL AS double)")})
    flat = TripleStore(wide.selectExpr("id AS s", "'t' AS p", "t AS o"))
    asked = Select("?x").where(("?x", "t", "?v")).filter(compare("?x", "<", 1000))
    assert tuples(asked.run(TripleStore(flat.df, tables=[table]))) == tuples(asked.run(flat)) == [("7",)]
    from trivane.sources.feeds import to_triples

    messages = spark.createDataFrame([("a", "1d"), ("b", "nan"), ("c", "5")], "k string, v string")
    assert tuples(to_triples(messages, F.col("k"), {"v": F.col("v")}), "s", "o_num") == [("a", None), ("b", None), ("c", 5.0)]


def test_feed(spark):
    from trivane.sources.feeds import json_fields, to_triples

    messages = spark.createDataFrame([("t1", '{"v": 5}'), ("t2", '{"w": 1}')], "topic string, body string")
    parsed = json_fields(messages, "body", "v int, w int")
    got = to_triples(parsed, F.col("topic"), {"v": F.col("v"), "w": F.col("w")})
    assert tuples(got) == [("t1", "v", "5", 5.0), ("t2", "w", "1", 1.0)]
