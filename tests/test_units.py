import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.cli import parse
from quadloom.config import ConvertConfig, EntityConfig, ErrorHandling, InstanceFilterConfig, OutputConfig, ParserConfig, QuadFilterConfig, RdfConfig, RelationStrategy, SaveMode, StatsConfig
from quadloom.functions.naming import add_retry_suffix, clean_uri_suffix, format_names, remove_special_chars, unique_names
from quadloom.functions.xsd import XSD, literal_type, literal_value
from quadloom.operators.filters import filter_instances, filter_quads
from quadloom.operators.flavors import Bio2RdfFlavor, WikidataFlavor, flavor
from quadloom.operators.ids import dense_ids, partition_by_type, unique_ids
from quadloom.operators.rdfschema import ClassGraph, collect_schema
from quadloom.plans.stats import run_stats, summary
from quadloom.sinks import CsvPersistor, JdbcPersistor, JsonPersistor, persistor
from quadloom.sinks.persistors import Manifest, booleans_to_int, copy_chunks, copy_line
from quadloom.sources import is_line_based, parse_lines, read_quads, to_lines
from quadloom.sources.nquads import QUAD_COLUMNS
from quadloom.sources.jsonld import parse_jsonld
from quadloom.sources.rdfxml import parse_rdfxml
from quadloom.sources.turtle import parse_turtle
from tests.data import LABEL, SKY, SUBCLASS, TYPE, quads, sky

TERM = f"{SKY}term/"


def test_names():
    assert remove_special_chars("1 A/b!!") == "N1_a_b" and remove_special_chars("__") == ""
    assert add_retry_suffix("abcdef", 5, 2) == "abc_2" and add_retry_suffix("abc", 5, 1) == "abc"
    assert clean_uri_suffix("http://a.org/x%20y/", "[/:#=]", 25) == "x_y" and clean_uri_suffix("", "[/:#=]", 25) == "undefined"
    assert format_names(["http://a/name", "http://b/name", "http://c/name_2", "http://d/select"], 25, reserved=["SELECT"]) == {"http://a/name": "name", "http://b/name": "name_3", "http://c/name_2": "name_2", "http://d/select": "select_2"}
    assert format_names(["http://a/q1"], 25, labels={"http://a/q1": "The Label"}) == {"http://a/q1": "the_label"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abAB/", max_size=6), st.sampled_from(["n", "N", "n_2", "x", "long_name_here"])), max_size=12, unique_by=lambda x: x[0]))
def test_names_are_unique(groups):
    names = unique_names(groups, 8, reserved=["x"])
    assert len({n.lower() for n in names.values()}) == len(groups) and "x" not in names.values()


def test_class_graph():
    g = ClassGraph([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")])
    assert g.skipped == [("c", "a")] and g.super_classes("c") == {"a", "b", "d"}
    assert g.super_class_first() == ["a", "b", "d", "c"] and g.has_sub_classes("a") and not g.has_super_classes("a")
    assert g.keep_only(["a", "c"]).edges == []


def test_statement_forms(spark):
    lines = ['<http://a> <http://p> "x\\"y\\\\n\\u00e9\\U0001F600" <http://g> . # "c" .', "_:b <http://p> _:c.", '<a> <b> "5"^^<int> .', '<a> <b> "x"@en-GB.', "# no", "", "<a> <b> .", '<a> <b> <c>@en .', '<a> <b> "' + "x\\n" * 50_000 + '" .']
    rows = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["ok"] for r in rows] == [True, True, True, True, False, False, True]
    assert rows[0]["o"] == 'x"y\\né😀' and rows[0]["g"] == "http://g" and rows[1]["s_kind"] == rows[1]["o_kind"] == "blank"
    assert rows[2]["o_datatype"] == "int" and rows[3]["o_lang"] == "en-GB" and len(rows[6]["o"]) == 100_000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="﷐﷑﷒\x0b\x0c\x85  \x1c\x1d\x1e"), max_size=30), min_size=1, max_size=8))
def test_round_trip(spark, texts):
    rows = [("s", "uri", "p", t, "literal", None, "en" if i % 2 else None, None) for i, t in enumerate(texts)]
    q = spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string")
    back = parse_lines(to_lines(q)).select("o", "o_lang", "ok").collect()
    assert sorted(((r["o"], r["o_lang"] or "") for r in back)) == sorted((t, "en" if i % 2 else "") for i, t in enumerate(texts))


def test_turtle():
    text = """@base <http://b.org/> . PREFIX e: <http://e.org/>
    e:a a e:T , <rel> ; e:n 5, -1.5, 2e3, true ; e:l "x"@cs, '''long "q"'''^^e:dt . # c
    e:b e:p [ e:q (1) ] . e:bad e:missing . e:c e:p e:d. <x> <y> "z" <g> . e:g { e:s e:p e:o . }"""
    found = list(parse_turtle(text))
    good = [q for q, bad in found if q]
    assert len([bad for _, bad in found if bad]) == 1 and len(good) == 15
    assert ("http://e.org/c", "uri", "http://e.org/p", "http://e.org/d", "uri", None, None, None) in good
    assert ("http://b.org/x", "uri", "http://b.org/y", "z", "literal", None, None, "http://b.org/g") in good
    assert ("http://e.org/s", "uri", "http://e.org/p", "http://e.org/o", "uri", None, None, "http://e.org/g") in good


def test_files(spark, tmp_path):
    m = sky()
    lines = m.lines()
    (tmp_path / "x.nq").write_text("\n".join([*lines, "bad line"]))
    (tmp_path / "x.ttl").write_text("\n".join(x.replace(f" <{SKY}log> .", " .") for x in lines) + "\nbad line .")
    assert is_line_based("x.nt.gz") and not is_line_based("x.ttl") and is_line_based("x.ttl", True)
    found, bad = read_quads(spark, str(tmp_path / "x.nq"), ParserConfig(error_handling=ErrorHandling.STORE))
    assert [r["line"] for r in bad.collect()] == ["bad line"] and found.count() == len(lines)
    turtle, bad = read_quads(spark, str(tmp_path / "x.ttl"), ParserConfig(error_handling=ErrorHandling.STORE))
    cols = [c for c in QUAD_COLUMNS if c != "g"]
    assert bad.count() == 1 and turtle.select(cols).exceptAll(found.select(cols)).count() == 0 and turtle.count() == len(lines)
    with pytest.raises(Exception, match="not a statement"):
        read_quads(spark, str(tmp_path / "x.nq"), ParserConfig(error_handling=ErrorHandling.THROW))[0].count()


RDFXML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e.org/" xml:base="http://b.org/d">
<e:T rdf:about="a" e:n="5"><e:l xml:lang="cs">x &amp; y</e:l><e:k rdf:datatype="http://e.org/int">7</e:k><e:r rdf:resource="#z"/>
<e:in><rdf:Description rdf:nodeID="q"><e:v>1</e:v></rdf:Description></e:in><e:pr rdf:parseType="Resource"><e:w>2</e:w></e:pr>
<e:c rdf:parseType="Collection"><e:T rdf:about="i1"/></e:c><e:x rdf:parseType="Literal">a <b>c</b></e:x></e:T>
<rdf:Seq rdf:ID="s"><rdf:li>one</rdf:li><rdf:li rdf:resource="two"/></rdf:Seq></rdf:RDF>"""


def test_rdfxml():
    ns = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    found = list(parse_rdfxml(RDFXML))
    assert all(bad is None for _, bad in found)
    said = {(q[0], q[2], q[3], q[4], q[5], q[6]) for q, _ in found}
    a = "http://b.org/a"
    assert {(a, ns + "type", "http://e.org/T", "uri", None, None), (a, "http://e.org/n", "5", "literal", None, None), (a, "http://e.org/l", "x & y", "literal", None, "cs"), (a, "http://e.org/k", "7", "literal", "http://e.org/int", None), (a, "http://e.org/r", "http://b.org/d#z", "uri", None, None)} <= said
    assert {(a, "http://e.org/x", "a <b>c</b>", "literal", ns + "XMLLiteral", None), ("http://b.org/d#s", ns + "_1", "one", "literal", None, None), ("http://b.org/d#s", ns + "_2", "http://b.org/two", "uri", None, None)} <= said
    of = lambda s, p: [q[3] for q, _ in found if q[0] == s and q[2] == p]
    assert of(of(a, "http://e.org/in")[0], "http://e.org/v") == ["1"] and of(of(a, "http://e.org/pr")[0], "http://e.org/w") == ["2"]
    (head,) = of(a, "http://e.org/c")
    assert of(head, ns + "first") == ["http://b.org/i1"] and of(head, ns + "rest") == [ns + "nil"]
    assert [bad is not None for _, bad in parse_rdfxml("no xml")] == [True] and list(parse_rdfxml(RDFXML[:420]))[-1][1]


JSONLD = """{"@context": {"@vocab": "http://v.org/", "e": "http://e.org/", "name": {"@id": "e:name", "@language": "en"}, "knows": {"@type": "@id"}, "day": {"@type": "http://e.org/date"},
"l": {"@container": "@list"}, "t": {"@container": "@language"}, "of": {"@reverse": "e:has"}},
"@graph": [{"@id": "http://x.org/1", "@type": "T", "name": "N", "knows": ["http://x.org/2", "_:b"], "day": "2020-01-01", "n": 5, "d": 1.5, "b": true, "l": [1], "t": {"en": "E", "cs": ["C"]}, "of": {"@id": "http://x.org/3"},
"sub": {"deep": {"@value": "v", "@language": "fr"}}, "none": null}, {"@id": "http://g.org", "@graph": [{"@id": "http://x.org/9", "p": "q"}]}]}"""


def test_jsonld():
    x, xsd, ns = "http://x.org/1", "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    found = list(parse_jsonld(JSONLD))
    assert all(bad is None for _, bad in found)
    said = {(q[0], q[2], q[3], q[4], q[5], q[6], q[7]) for q, _ in found}
    literal = lambda p, v, d=None, lang=None: (x, p, v, "literal", d, lang, None)
    assert {literal("http://e.org/name", "N", None, "en"), literal("http://v.org/day", "2020-01-01", "http://e.org/date"), literal("http://v.org/n", "5", xsd + "integer"), literal("http://v.org/d", "1.5E0", xsd + "double"), literal("http://v.org/b", "true", xsd + "boolean"), literal("http://v.org/t", "C", None, "cs")} <= said
    assert {(x, ns + "type", "http://v.org/T", "uri", None, None, None), (x, "http://v.org/knows", "http://x.org/2", "uri", None, None, None), ("http://x.org/3", "http://e.org/has", x, "uri", None, None, None), ("http://x.org/9", "http://v.org/p", "q", "literal", None, None, "http://g.org")} <= said
    assert not any("none" in q[2] for q, _ in found)
    assert len(list(parse_jsonld("{"))) == 1 and "address" in list(parse_jsonld('{"@context": "http://c.org", "a": 1}'))[0][1]


def test_folder_of_formats(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(RDFXML)
    (tmp_path / "b.jsonld").write_text(JSONLD)
    (tmp_path / "c.ttl").write_text("<http://x> <http://y> 5 .")
    expected = len(list(parse_rdfxml(RDFXML))) + len(list(parse_jsonld(JSONLD))) + 1
    assert read_quads(spark, str(tmp_path))[0].count() == expected
    with pytest.raises(ValueError, match="unknown syntax"):
        read_quads(spark, str(tmp_path), ParserConfig(syntax="n3"))


def test_literal_types(spark):
    cases = [("5", "int", "INTEGER", "5"), ("+05", "integer", "INTEGER", "5"), ("300", "byte", None, None), ("99999999999", "integer", "LONG", "99999999999"), ("9" * 25, "integer", "STRING", "9" * 25), ("x", "long", None, None), ("t", "boolean", None, None), ("1", "boolean", "BOOLEAN", "true"), ("INF", "double", "DOUBLE", "Infinity"), ("1e10", "double", "DOUBLE", "1.0E10"), ("1.5", "float", "FLOAT", "1.5"), ("2016-01-01", "date", "DATETIME", "2016-01-01"), ("1.50", "decimal", "STRING", "1.50"), ("a\0b", "other", "STRING", "ab")]
    df = spark.createDataFrame([(a, XSD + b) for a, b, _, _ in cases], "l string, d string").withColumn("t", literal_type(F.col("l"), F.col("d")))
    got = [tuple(r) for r in df.select("t", literal_value(F.col("l"), F.col("t"))).collect()]
    assert [(t, v if t else None) for t, v in got] == [(c, e) for _, _, c, e in cases]


def test_neighbourhood(spark):
    """Against the same filter in plain Python over the generated links."""
    m = sky()
    q = quads(spark, m.lines())
    said = [(s, t) for s, ts in m.types.items() for t in ts] + [(k[0], None) for k, vs in m.values.items() for _ in vs] + [(s, o) for s, _, o in m.links] + [(b, a) for a, b in m.edges]

    def expected(resources, depth=0, directed=True, black=()):
        own = set(resources)
        for _ in range(depth):
            own |= {o for s, o in said if o and s in own} | (set() if directed else {s for s, o in said if o in own})
        return sum(1 for s, _ in said if (s in own or not resources) and s not in black)

    night, scope = f"{SKY}night/003", f"{SKY}scope/04"
    for resources, depth, directed, black in [((), 0, True, ()), ((night,), 0, True, ()), ((night,), 1, True, ()), ((night,), 2, True, (scope,)), ((night, scope), 1, False, ()), ((scope,), 3, False, (night,)), ((), 0, True, (night, scope))]:
        got = filter_quads(q, QuadFilterConfig(resources, black, depth, directed)).count()
        assert got == expected(resources, depth, directed, black), (resources, depth, directed, black)
    with pytest.raises(ValueError):
        filter_quads(q, QuadFilterConfig(related_depth=1))


def test_instance_filter(spark):
    df = spark.createDataFrame([("1", ["a"]), ("2", ["b", "c"]), ("3", ["c"])], "uri string, types array<string>")
    assert sorted(map(tuple, filter_instances(df, InstanceFilterConfig(("a", "b"))).select("uri", F.array_join("types", ",")).collect())) == [("1", "a"), ("2", "b")]
    assert sorted(r[1] for r in filter_instances(df, InstanceFilterConfig(("b",), False)).select("uri", F.array_join("types", ",")).collect()) == ["b,c"]
    with pytest.raises(ValueError, match="no such type"):
        filter_instances(df, InstanceFilterConfig(("z",)), ["a"])


def test_schema_cache(spark, tmp_path):
    path, m = f"file://{tmp_path}/schema", sky()
    q = quads(spark, [*m.lines(), f'<{TERM}Night> <{LABEL}> "night"@en .', f'<{TERM}Night> <{LABEL}> "Nacht"@de .', f'<{SKY}night/001> <{LABEL}> "no type" .'])
    first = collect_schema(q, RdfConfig(cache_file=path))
    assert first.labels == {TERM + "Night": "Nacht"} and first.graph.edges == sorted(m.edges)
    assert set(first.types) >= {t for ts in m.types.values() for t in ts} | {x for e in m.edges for x in e[:1]} and set(first.predicates) >= {TYPE, SUBCLASS, LABEL}
    again = collect_schema(q.limit(0), RdfConfig(cache_file=path))
    assert again.types == first.types and again.predicates == first.predicates and again.labels == first.labels
    with pytest.raises(ValueError, match="other settings"):
        collect_schema(q, RdfConfig(cache_file=path, collect_labels=False))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=14))
def test_cycles_are_cut_in_order(edges):
    """As if every edge were checked against all before it."""
    g, above, skipped = ClassGraph(edges), {}, []
    for a, b in sorted(set(edges)):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += above.get(x, [])
        if b in seen:
            skipped.append((a, b))
        else:
            above.setdefault(b, []).append(a)
    assert g.skipped == skipped and g.edges == sorted((a, b) for b, xs in above.items() for a in xs)


def test_ids(spark):
    df = spark.createDataFrame([(f"u{i:03d}", [f"t{i % 3}"]) for i in range(200)], "uri string, types array<string>").repartition(5)
    assert [r["id"] for r in dense_ids(df).orderBy("uri").collect()] == list(range(1, 201))
    assert unique_ids(df).select("id").distinct().count() == 200
    assert partition_by_type(dense_ids(df), 4, 10).count() == 200


def test_flavors(spark):
    q = quads(spark, ['<http://www.wikidata.org/entity/P5> <http://www.w3.org/2000/01/rdf-schema#label> "x"@en .', "<http://a> <http://b> <http://c> ."])
    assert WikidataFlavor().modify_quads(q).count() == 5
    assert Bio2RdfFlavor().format_name("http://bio2rdf.org/drug_vocabulary:Resource", None, 25) == "drug_resource"
    config = ConvertConfig()
    flavor("Wikidata").set_defaults(config)
    assert config.relations.strategy == RelationStrategy.PREDICATES and config.naming.max_table_length == 50
    with pytest.raises(ValueError):
        flavor("wikidata")


def test_stats(spark):
    import collections

    m = sky()
    found = run_stats(spark, quads(spark, m.lines()), StatsConfig())
    said = [(s, TYPE, t) for s, ts in m.types.items() for t in ts] + [(k[0], k[1], None) for k, vs in m.values.items() for _ in vs] + list(m.links) + [(b, SUBCLASS, a) for a, b in m.edges]
    for i, s in enumerate(found):
        counts = collections.Counter(x[i] for x in said if x[i])
        assert s.total == len(counts) and [tuple(r) for r in s.top.collect()] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:100]
    assert f"SUBJECT_URI_COUNT: {found[0].total}" in summary(found)


def test_sinks(spark, tmp_path):
    rows = [(1, 1.5, None, True), (2, -0.0, "", False), (3, 2.0, 'a"b|c\\d\ne, č 中', True)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d boolean")
    sink = CsvPersistor(f"file://{tmp_path}/csv")
    sink.write_frame("t", df)
    assert sorted(map(tuple, sink.read_frame(spark, "t", df.schema).collect())) == sorted(rows)
    JsonPersistor(f"file://{tmp_path}/json").write_frame("t", df)
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"file://{tmp_path}/json/t").collect())) == sorted(rows)
    with pytest.raises(Exception):
        sink.write_frame("t", df)
    assert copy_line((1, None, 'a"b')) == '"1"|NULL|"a""b"\n' and len(list(copy_chunks([(1,)] * 5, 2))) == 3


def test_csv_keeps_odd_texts(spark, tmp_path):
    """White space at the ends, line ends, NUL, quotes and marks come back as they were, in every place of the row and alone."""
    from quadloom.queries import QUERIES

    odd = [None, "", " ", " a", "a ", "\ta\t", "\r", "\n", "\r\n", "\na", "a\r\n", "a\rb", "\0", "a\0b", 'a\0"b', "\0\n", '"\0', '"', '""', ' "a" ', '",\n', "\\", '\\"', "\ufdd3", "\ufdd3\ufdd3", "\ufeff", "\x01", "#", "null", " \n" + 'long "word", \r\n' * 100_000]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(odd, [*odd[1:], "x"]))] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = QUERIES["csv_round_trip"](spark, f"file://{tmp_path}")
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(rows, key=key)
    assert found.count() == len(rows) and found.filter("lang = ''").count() == 1 and found.filter("text is null").count() == 2
    sink = CsvPersistor(f"file://{tmp_path}/csv")
    first = spark.createDataFrame([r[::-1] for r in rows], "`a\r\"b` string, `c.d` string, k long").coalesce(1)
    sink.write_frame("first", first)
    assert sorted((tuple(r)[::-1] for r in sink.read_frame(spark, "first", first.schema).collect()), key=key) == sorted(rows, key=key)
    alone = spark.createDataFrame([(x,) for x in odd if x is not None], "a string").coalesce(1)
    sink.write_frame("alone", alone)
    assert sorted(r[0] for r in sink.read_frame(spark, "alone", alone.schema).collect()) == sorted(x for x in odd if x is not None)


def test_jdbc(spark):
    config = OutputConfig("DB", SaveMode.OVERWRITE, db_url="jdbc:derby:memory:quadloom;create=true", db_user="app")
    sink = persistor(config)
    assert isinstance(sink, JdbcPersistor)
    sink.write_frame("t", spark.createDataFrame([(1, "x")], "ID int, URI string"))
    assert spark.read.jdbc(config.db_url, '"t"', properties=sink.properties()).count() == 1
    assert sink.execute(['CREATE INDEX "ix_t" ON "t" ("ID")', "NO STATEMENT", 'CREATE INDEX "ix_u" ON "t" ("nothing")']) == sink.failures and len(sink.failures) == 2
    with pytest.raises(ValueError):
        persistor(OutputConfig("CSV"))


def test_convert_into_a_database(spark):
    """Tables, primary and foreign keys and indexes of a whole conversion are there."""
    from quadloom.plans.convert import convert

    m = sky()
    config = ConvertConfig(output=OutputConfig("DB", SaveMode.OVERWRITE, db_url="jdbc:derby:memory:sky;create=true", db_user="app", db_strict=True))
    sink = persistor(config.output)
    c = convert(spark, quads(spark, m.lines()), config, sink)
    assert sink.failures == []
    read = lambda sql: spark.read.jdbc(config.output.db_url, f"({sql}) x", properties=sink.properties())
    kinds = {r["T"]: r["N"] for r in read("select cast(TYPE as varchar(1)) T, count(*) N from SYS.SYSCONSTRAINTS group by TYPE").collect()}
    assert kinds == {"P": len(c.manifest.primary_keys), "F": sum(x[:2] not in sink.unkeyed for x in c.manifest.foreign_keys)}
    assert sink.unkeyed == {("_attributes", "datatype"), ("_attributes", "language"), ("_META_Properties", "language"), ("_META_Relations", "from_name"), ("_META_Relations", "to_name")}  # nullable text
    assert read("select count(*) N from SYS.SYSCONGLOMERATES where CONGLOMERATENAME like 'ix\\_%' escape '\\'").first()["N"] == sum(x not in sink.unkeyed for x in c.manifest.indexes)
    assert read('select "URI" U from "night"').count() == len(m.members(TERM + "Night"))


def test_bad_records_are_kept(spark, tmp_path):
    from quadloom.cli import store_bad_records

    bad = spark.createDataFrame([("one",), ("two\nlines",)], "line string")
    path = store_bad_records(spark, bad, f"file://{tmp_path}/out")
    assert sorted(r["line"] for r in spark.read.json(path).collect()) == ["one", "two\nlines"]


def test_other_sinks(spark, capsys):
    df = spark.createDataFrame([(1, True, "x")], "a int, b boolean, c string")
    persistor(OutputConfig("Preview")).write_frame("shown", df)
    assert "shown" in capsys.readouterr().out
    assert [f.dataType.simpleString() for f in booleans_to_int(df).schema] == ["int", "int", "string"]
    es = persistor(OutputConfig("ES", es_index="i"))
    assert es.options("t") == {"es.resource": "i/t", "es.index.auto.create": "true"}
    pg = persistor(OutputConfig("DB", db_url="jdbc:postgresql://h/d", db_user="u"))
    assert "select" in pg.reserved_names() and Manifest(indexes=[("t", "c")]).ddl() == Manifest(indexes=[("t", "c")]).ddl()


def test_command_line(capsys):
    assert parse(["--help"]) is None and parse(["convert"]) is None and parse([]) is None
    c = parse(["convert", "--input.file", "x.nq", "--flavor", "Wikidata", "--relations.schema", "Types", "--filter.type", "a", "--filter.type", "b", "--entities.minColumnNonNullFraction", "0.5", "--filter.ignoreOtherTypes", "false"])
    assert c.relations.strategy == RelationStrategy.TYPES and c.instances_filter.types == ("a", "b") and not c.instances_filter.ignore_other_types
    assert c.naming.use_labels and math.isclose(c.entities.min_non_null_fraction, 0.5)
    s = parse(["stats", "--input.file", "x.nq", "--stat", "SUBJECT_URI_COUNT"])
    assert isinstance(s, StatsConfig) and s.stats == ("SUBJECT_URI_COUNT",)
    assert isinstance(ConvertConfig().entities, EntityConfig)
