"""Ingestion and rendering: text written from the tables by Spark, read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.query import Select
from trivane.session import new_step_dir
from trivane.sources import messages, n3, rdfxml, text
from trivane.sources.feeds import json_fields, to_triples
from trivane.store import TripleStore
from workloads.registry import query
from workloads.tables import store, table, with_triples

SHOP = ("region", "nation", "customer", "orders")
EX = "http://example.org/"


def written(df, label):
    """Write lines to shared storage and return the folder."""
    path = new_step_dir(df.sparkSession, label)
    df.write.text(path)
    return path


@query("nt_render", with_triples("SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM triples", *SHOP))
def nt_render(spark, sf):
    return text.plain_lines(store(spark, sf, *SHOP).df)


@query("nt_ingest", with_triples("SELECT s, p, o, o_num FROM triples", *SHOP))
def nt_ingest(spark, sf):
    """Triples to N-Triples files and back; each file also carries a comment and a broken line per customer."""
    data = store(spark, sf, *SHOP).df
    noise = table(spark, sf, "customer").select(
        F.explode(F.array(F.concat(F.lit("# "), "c_name"), F.concat(F.lit("<customer> missing end "), "c_name"))).alias("value")
    )
    path = written(text.ntriples_lines(data).union(noise), "nt")
    return text.read_ntriples(spark, path).select("s", "p", "o", "o_num")


@query("nt_rejects", "SELECT '<customer> missing end ' || c_name AS value FROM customer")
def nt_rejects(spark, sf):
    lines = text.ntriples_lines(store(spark, sf, "customer").df)
    noise = table(spark, sf, "customer").select(F.concat(F.lit("<customer> missing end "), "c_name").alias("value"))
    return text.ntriples_rejects(lines.union(noise))


@query(
    "nt_documents",
    """SELECT concat('doc/', doc_id) AS s, 'text' AS p, text AS o, 'literal' AS o_kind, lang AS o_lang FROM documents
       UNION ALL SELECT concat('doc/', doc_id), 'source', concat('source/', source), 'iri', NULL FROM documents""",
)
def nt_documents(spark, sf):
    """Whole documents as language-tagged literals: line breaks, quotes and backslashes survive the round trip."""
    docs = table(spark, sf, "documents")
    subject = F.expr("concat('doc/', doc_id)").alias("s")
    none = F.lit(None).cast("string").alias("o_datatype")
    texts = docs.select(subject, F.lit("text").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), none,
                        F.col("lang").alias("o_lang"))
    sources = docs.select(subject, F.lit("source").alias("p"), F.expr("concat('source/', source)").alias("o"),
                          F.lit("iri").alias("o_kind"), none, F.lit(None).cast("string").alias("o_lang"))
    path = written(text.ntriples_lines(texts.union(sources)), "nt")
    return text.read_ntriples(spark, path).select("s", "p", "o", "o_kind", "o_lang")


@query(
    "turtle_line_ingest",
    "SELECT concat('ex:customer', c_custkey) AS s, 'ex:name' AS p, replace(c_name, '#', ' no ') AS o FROM customer",
)
def turtle_line_ingest(spark, sf):
    lines = table(spark, sf, "customer").select(
        F.explode(
            F.array(
                F.lit(f"@prefix ex: <{EX}> ."),
                F.concat(F.lit("ex:customer"), "c_custkey", F.lit(' ex:name "'), F.replace("c_name", F.lit("#"), F.lit(" no ")), F.lit('" .')),
                F.lit("too short"),
            )
        ).alias("value")
    )
    return text.read_turtle_lines(spark, written(lines, "turtle")).select("s", "p", "o")


@query(
    "n3_ingest",
    f"""SELECT '{EX}customer' || c_custkey AS s, '{EX}name' AS p, c_name AS o, NULL AS o_datatype FROM customer
        UNION ALL SELECT '{EX}customer' || c_custkey, '{EX}balance', cast(cast(c_acctbal AS decimal(18,2)) AS varchar),
          'http://www.w3.org/2001/XMLSchema#decimal' FROM customer
        UNION ALL SELECT '{EX}customer' || c_custkey, '{EX}tag', t, NULL FROM customer, (VALUES ('{EX}active'), ('{EX}known')) v(t)""",
)
def n3_ingest(spark, sf):
    """Statements over several lines with predicate and object lists, prefixes and comments."""
    head = F.lit(f"@prefix ex: <{EX}> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n# a customer\n")
    statement = F.concat(
        head,
        F.lit("ex:customer"), F.col("c_custkey"), F.lit(' ex:name "'), F.col("c_name"), F.lit('" ;\n    ex:balance "'),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string"),
        F.lit('"^^xsd:decimal ; # in dollars\n    ex:tag ex:active , ex:known .'),
    )
    path = written(table(spark, sf, "customer").select(statement.alias("value")), "n3")
    triples, prefixes = text.read_n3(spark, path)
    return text.expand_prefixes(triples, prefixes).select("s", "p", "o", "o_datatype")


@query(
    "prefix_expand",
    f"""SELECT '{EX}customer/' || c_custkey AS s, CASE WHEN c_nationkey < 10 THEN '{EX}geo#nation' ELSE 'unknown:nation' END AS p,
        'http://other.org/' || c_nationkey AS o FROM customer""",
)
def prefix_expand(spark, sf):
    short = table(spark, sf, "customer").selectExpr(
        "concat('ex:customer/', c_custkey) AS s",
        "if(c_nationkey < 10, 'geo:nation', 'unknown:nation') AS p",
        "concat('http://other.org/', c_nationkey) AS o",
    )
    prefixes = spark.createDataFrame([("ex", EX), ("geo", f"{EX}geo#")], "prefix string, iri string")
    return text.expand_prefixes(short, prefixes)


XML_TAG = "'    <' || p || '>' || replace(replace(replace(replace(o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</' || p || '>' || chr(10)"


@query(
    "rdfxml_render",
    with_triples(
        f"""SELECT s, cast(0 AS bigint) AS chunk, '  <rdf:Description rdf:about="' || s || '">' || chr(10) ||
            string_agg({XML_TAG}, '' ORDER BY {XML_TAG}) || '  </rdf:Description>' AS xml FROM triples GROUP BY s""",
        *SHOP,
    ),
)
def rdfxml_render(spark, sf):
    return rdfxml.render_rdfxml(store(spark, sf, *SHOP).df)


@query("rdfxml_ingest", with_triples("SELECT s, p, o, o_num FROM triples", *SHOP))
def rdfxml_ingest(spark, sf):
    """Triples to RDF/XML documents and back."""
    path = new_step_dir(spark, "rdfxml")
    rdfxml.write_rdfxml(store(spark, sf, *SHOP).df, path, {"ex": EX})
    return rdfxml.read_rdfxml(spark, path)[0].select("s", "p", "o", "o_num")


@query(
    "events_to_triples",
    """SELECT concat('event/', event_id) AS s, 'type' AS p, event_type AS o FROM events
       UNION ALL SELECT concat('event/', event_id), 'user', concat('user/', user_id) FROM events
       UNION ALL SELECT concat('event/', event_id), 'k', json_extract_string(props, '$.k') FROM events""",
)
def events_to_triples(spark, sf):
    """Messages with a JSON payload as triples."""
    messages = json_fields(table(spark, sf, "events"), "props", "k int")
    fields = {"type": F.col("event_type"), "user": F.expr("concat('user/', user_id)"), "k": F.col("k")}
    return to_triples(messages, F.expr("concat('event/', event_id)"), fields).select("s", "p", "o")


@query(
    "n3_two_files",
    """SELECT 'http://nations/' || n_nationkey AS s, 'http://nations/name' AS p, n_name AS o FROM nation
       UNION ALL SELECT 'http://nations/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://nations/Place' FROM nation
       UNION ALL SELECT 'http://regions/' || r_regionkey, 'http://regions/name', r_name FROM region
       UNION ALL SELECT 'http://regions/' || r_regionkey, 'http://regions/says', 'a. b; c, # d' FROM region
       UNION ALL SELECT 'http://later/' || r_regionkey, 'http://later/name', r_name FROM region""",
)
def n3_two_files(spark, sf):
    """Two sets of files use one prefix for different IRIs, one of them changes it halfway; statements share lines."""
    folder = new_step_dir(spark, "n3-two")
    ex = lambda iri: F.lit(f"@prefix ex: <{iri}> . ")
    nations = table(spark, sf, "nation").select(
        F.concat(ex("http://nations/"), F.lit("ex:"), "n_nationkey", F.lit(' a ex:Place; ex:name "'), "n_name", F.lit('".\r')).alias("value")
    )
    regions = table(spark, sf, "region").select(
        F.concat(
            ex("http://regions/"), F.lit("ex:"), "r_regionkey", F.lit(' ex:name "'), "r_name", F.lit('" ; # known\n ex:says "a. b; c, # d" . '),
            ex("http://later/"), F.lit("ex:"), "r_regionkey", F.lit(' ex:name "'), "r_name", F.lit('" .'),
        ).alias("value")
    )
    nations.write.text(f"{folder}/nations")
    regions.write.text(f"{folder}/regions")
    return n3.read_n3(spark, f"{folder}/*").triples.select("s", "p", "o")


@query(
    "n3_rejects",
    """SELECT 'ex:' || c_custkey || ' ex:name .' AS value FROM customer
       UNION ALL SELECT 'ex:' || c_custkey || ' ex:p ex:b ex:c .' FROM customer WHERE c_nationkey < 5""",
)
def n3_rejects(spark, sf):
    """Statements of two and of four terms, among good ones on the same lines."""
    short = F.concat(F.lit("ex:"), "c_custkey", F.lit(" ex:name . ex:ok ex:is ex:good . "))
    long = F.when(F.col("c_nationkey") < 5, F.concat(F.lit("ex:"), "c_custkey", F.lit(" ex:p ex:b ex:c ."))).otherwise("")
    path = written(table(spark, sf, "customer").select(F.concat(short, long).alias("value")), "n3-bad")
    return n3.read_n3(spark, path).rejects.select("value")


@query(
    "rdfxml_iri_roundtrip",
    with_triples(
        f"""SELECT '{EX}' || s AS s, '{EX}terms#' || p AS p, o, 'literal' AS o_kind FROM triples
            UNION ALL SELECT '{EX}' || s, 'http://other.org/' || p, '{EX}' || o, 'iri' FROM triples WHERE p IN ('partOf', 'placedBy')""",
        "region", "nation", "customer",
    ),
)
def rdfxml_iri_roundtrip(spark, sf):
    """Predicates that are IRIs of two namespaces, only one of which the document declares; links and text."""
    data = store(spark, sf, "region", "nation", "customer").df
    iri = lambda base, c: F.concat(F.lit(base), F.col(c))
    words = data.select(iri(EX, "s").alias("s"), iri(f"{EX}terms#", "p").alias("p"), "o", F.lit("literal").alias("o_kind"))
    links = data.filter("p IN ('partOf', 'placedBy')").select(
        iri(EX, "s").alias("s"), iri("http://other.org/", "p").alias("p"), iri(EX, "o").alias("o"), F.lit("iri").alias("o_kind")
    )
    path = new_step_dir(spark, "rdfxml-iri")
    rdfxml.write_rdfxml(words.union(links), path, {"t": f"{EX}terms#"})
    return rdfxml.scan_rdfxml(spark, path).triples.select("s", "p", "o", "o_kind")


@query("rdfxml_rejects", "SELECT c_name AS name, 'mismatched tag' AS fault FROM customer WHERE c_nationkey < 5")
def rdfxml_rejects(spark, sf):
    """One broken element in five or so; the others of the same file are read."""
    end = F.when(F.col("c_nationkey") < 5, "</t:other>").otherwise("</t:name>")
    element = F.concat(
        F.lit("<rdf:Description rdf:about='c'><t:name>"), "c_name", end, F.lit(rdfxml.DESCRIPTION_END)
    )
    path = written(table(spark, sf, "customer").select(element.alias("value")), "rdfxml-bad")
    found = rdfxml.scan_rdfxml(spark, path).rejects
    return found.select(F.regexp_extract("value", "<t:name>([^<]*)<", 1).alias("name"), F.split_part("fault", F.lit(":"), F.lit(1)).alias("fault"))


@query("type_shorthand", "SELECT concat('part/', p_partkey) AS x FROM part WHERE p_size > 25")
def type_shorthand(spark, sf):
    """``a`` in loaded statements and in the query both mean the type predicate."""
    kind = F.when(F.col("p_size") > 25, "large").otherwise("small")
    lines = table(spark, sf, "part").select(F.concat(F.lit("<part/"), "p_partkey", F.lit("> a <"), kind, F.lit("> .")).alias("value"))
    loaded = TripleStore.of(n3.read_n3(spark, written(lines, "n3-types")).triples)
    return Select("?x").where(("?x", "a", "large")).run(loaded)


@query("store_save_load", with_triples("SELECT s, p, o, o_num FROM triples", *SHOP))
def store_save_load(spark, sf):
    """A store saved by predicate and read back."""
    path = new_step_dir(spark, "saved")
    store(spark, sf, *SHOP).save(path, rows_per_file=5000)
    return TripleStore.load(spark, path).df.select("s", "p", "o", "o_num")


@query(
    "message_readings",
    """SELECT concat('user/', user_id) AS s, 'reading' AS p, cast(event_id AS varchar) AS o, cast(event_id AS double) AS o_num,
       cast(floor(epoch_us(ts) / 1000000) AS bigint) AS ts FROM events""",
)
def message_readings(spark, sf):
    """Messages written to a log of JSON lines, with broken lines among them, read as timestamped triples."""
    folder = new_step_dir(spark, "messages")
    sent = table(spark, sf, "events").selectExpr(
        "concat('user/', user_id) AS topic",
        "cast(floor(unix_micros(cast(ts AS timestamp)) / 1000000) AS bigint) AS at",
        "cast(event_id AS string) AS value",
    )
    messages.write_messages(sent, folder)
    table(spark, sf, "nation").select(F.concat(F.lit('{"topic": '), "n_name").alias("value")).write.mode("append").text(folder)
    return messages.readings(messages.read_messages(spark, folder))
