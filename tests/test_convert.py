"""The convert job over generated observatories: every table against the model of ``tests.data``."""

import pytest
from tests.data import LABEL, RESOURCE, SKY, SUBCLASS, TYPE, quads, sky

from quadloom.config import ERROR_PREDICATES, ConvertConfig, EntityConfig, InstanceConfig, NamingConfig, RelationConfig, RelationStrategy
from quadloom.plans.convert import convert
from quadloom.sinks import MapPersistor

TERM = f"{SKY}term/"
NAMES = {f"{TERM}{x}": x.lower() for x in ("Instrument", "Refractor", "Reflector", "Site", "Night")} | {RESOURCE: "resource"}


def run(spark, model, lines=None, **groups):
    sink = MapPersistor()
    c = convert(spark, quads(spark, lines or model.lines()), ConvertConfig(**groups), sink)
    return sink.result, c


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def plain(found):
    return sorted(found, key=str)


def predicate_numbers(model):
    used = {k[1] for k in model.values} | {p for _, p, _ in model.links} | {TYPE, SUBCLASS} | set(ERROR_PREDICATES)
    return {p: i for i, p in enumerate(sorted(used))}


def test_entity_tables(spark):
    m = sky()
    tables, c = run(spark, m)
    ids = m.ids()
    expected = {
        "site": (["elevation", "title_de", "title_en"], lambda s: (m.least(s, TERM + "elevation", "int"), m.least(s, TERM + "title", None, "de"), m.least(s, TERM + "title", None, "en"))),
        "instrument": (["aperture"], lambda s: (m.least(s, TERM + "aperture", "double"),)),
        "refractor": ([], lambda s: ()),
        "reflector": ([], lambda s: ()),
        "night": (["seeing", "remark"], lambda s: (m.least(s, TERM + "seeing", "int"), m.least(s, TERM + "remark", None))),
        "resource": ([], lambda s: ()),
    }
    types = {n: t for t, n in NAMES.items()}
    for name, (columns, values) in expected.items():
        assert tables[name].columns == ["ID", "URI", *columns], name
        assert rows(tables[name]) == plain((ids[s], s, *values(s)) for s in m.members(types[name])), name
        assert [f.nullable for f in tables[name].schema][:2] == [False, False]
    assert {t for t in tables if t in NAMES.values()} == set(NAMES.values())
    meta = {r["entity_name"]: r["num_rows"] for r in tables["_META_Entities"].collect()}
    assert meta == {n: len(m.members(t)) for t, n in NAMES.items()}
    inherited = {(r["entity_name"], r["in_superclass"]) for r in tables["_META_Properties"].collect() if r["in_superclass"]}
    assert inherited == {("refractor", "instrument.aperture"), ("reflector", "instrument.aperture")}


def test_attributes_are_the_multivalued(spark):
    m = sky()
    tables, _ = run(spark, m)
    ids, number = m.ids(), predicate_numbers(m)
    assert {r["predicate_URI"]: r["predicate"] for r in tables["_META_Predicates"].collect()} == number
    several = {k[1] for k, v in m.values.items() if len(v) > 1}
    assert several == {TERM + "seeing"}
    assert rows(tables["_attributes"]) == plain((ids[s], number[p], "INTEGER", None, v) for (s, p, _, _), vs in m.values.items() if p in several for v in vs)
    whole, _ = run(spark, m, entities=EntityConfig(redundant_eav=True))
    kind = {"int": "INTEGER", "double": "DOUBLE", None: "STRING"}
    text = lambda v, d: repr(float(v)) if d == "double" else v
    assert rows(whole["_attributes"]) == plain((ids[s], number[p], kind[d], lang, text(v, d)) for (s, p, d, lang), vs in m.values.items() for v in vs)


def test_relation_layouts(spark):
    m = sky()
    ids, number, related = m.ids(), predicate_numbers(m), m.related()
    tables, c = run(spark, m)
    pairs = {(a, b) for _, a, _, b, _ in related}
    assert {r.name for r in c.relation_tables} == {f"{NAMES[a]}_{NAMES[b]}" for a, b in pairs}
    for a, b in pairs:
        assert rows(tables[f"{NAMES[a]}_{NAMES[b]}"]) == plain((ids[s], ids[o], number[p]) for p, x, s, y, o in related if (x, y) == (a, b)), (a, b)
    assert tables["night_night"].columns == ["night_ID_from", "night_ID_to", "predicate"] and tables["night_instrument"].columns == ["night_ID", "instrument_ID", "predicate"]
    all_links = m.links | {(b, SUBCLASS, a) for a, b in m.edges}
    tables, c = run(spark, m, relations=RelationConfig(strategy=RelationStrategy.PREDICATES))
    for p in {p for _, p, _ in all_links}:
        name = p.replace("#", "/").rsplit("/", 1)[1].lower()
        assert rows(tables[name]) == plain((ids[s], ids[o]) for s, q, o in all_links if q == p)
    tables, _ = run(spark, m, relations=RelationConfig(strategy=RelationStrategy.SINGLE_TABLE))
    assert rows(tables["_relations"]) == plain((ids[s], ids[o], number[p]) for s, p, o in all_links)
    tables, c = run(spark, m, relations=RelationConfig(strategy=RelationStrategy.TYPE_PREDICATES))
    triples = {(p, a, b) for p, a, _, b, _ in related}
    assert len(c.relation_tables) == len(triples) and sum(tables[r.name].count() for r in c.relation_tables) == len(related)
    tables, c = run(spark, m, relations=RelationConfig(strategy=RelationStrategy.NONE))
    assert not c.relation_tables and "_META_Relations" not in tables


def test_keys(spark):
    _, c = run(spark, sky(), naming=NamingConfig(entity_prefix="e_", relation_prefix="r_"))
    k = c.manifest
    assert {("e_" + n, "ID") for n in NAMES.values()} <= set(k.primary_keys) and {("e_" + n, "URI") for n in NAMES.values()} <= set(k.indexes)
    assert {("e_refractor", "ID", "e_instrument", "ID"), ("r_night_instrument", "night_ID", "e_night", "ID"), ("_META_Relations", "from_name", "_META_Entities", "entity_name"), ("_attributes", "predicate", "_META_Predicates", "predicate")} <= set(k.foreign_keys)
    order = [n for n in c.tables if n.startswith("e_")]
    assert order.index("e_refractor") < order.index("e_instrument") and order.index("e_reflector") < order.index("e_instrument")


def test_column_rules(spark):
    m = sky()
    tables, _ = run(spark, m, entities=EntityConfig(max_columns=1))
    assert tables["site"].columns == ["ID", "URI", "elevation"] and tables["night"].columns == ["ID", "URI", "seeing"]
    tables, _ = run(spark, m, entities=EntityConfig(min_non_null_fraction=0.5))
    assert tables["night"].columns == ["ID", "URI", "seeing"]
    meta = {(r["entity_name"], r["datatype"]): r for r in tables["_META_Properties"].collect()}
    assert meta["night", "STRING"]["column_name"] is None and not meta["night", "STRING"]["is_column"]
    assert meta["night", "STRING"]["non_null"] == pytest.approx(sum(1 for k in m.values if k[1] == TERM + "remark") / len(m.members(TERM + "Night")))
    tables, c = run(spark, m, entities=EntityConfig(min_rows=1000))
    assert tables == {} and c.entities.tables == []
    tables, _ = run(spark, m, entities=EntityConfig(force_type_suffix=True, sort_columns=True, redundant_subclass_columns=True))
    assert tables["night"].columns == ["ID", "URI", "remark_string", "seeing_integer"] and tables["refractor"].columns == ["ID", "URI", "aperture_double"]


def test_instance_options(spark):
    m = sky()
    tables, _ = run(spark, m, instances=InstanceConfig(default_language="de"))
    assert tables["site"].columns == ["ID", "URI", "elevation", "title", "title_en"]
    tables, _ = run(spark, m, instances=InstanceConfig(add_super_types=False))
    assert "instrument" not in tables and tables["refractor"].columns == ["ID", "URI", "aperture"]
    by_type, _ = run(spark, m, instances=InstanceConfig(repartition_by_type=True))
    usual, _ = run(spark, m)
    assert {n: rows(f) for n, f in by_type.items()} == {n: rows(f) for n, f in usual.items()}


def test_labels_and_clashes(spark):
    m = sky()
    extra = [f'<{TERM}Night> <{LABEL}> "Observing night"@en .', f'<{SKY}x/1> <{TYPE}> <{SKY}other#Site> .', f'<{SKY}x/1> <{SKY}other#title> "t" .', f'<{SKY}x/1> <{TERM}title> "u" .', f"<{SKY}x/1> <{SKY}p#links> <{SKY}x/1> ."]
    tables, c = run(spark, m, m.lines() + extra, naming=NamingConfig(use_labels=True))
    assert "observing_night" in tables and tables["_META_Entities"].filter("entity_name = 'observing_night'").first()["entity_label"] == "Observing night"
    assert {"site", "site_2"} <= set(tables) and tables["site"].columns[2:] == ["title", "title_2"]
    assert len(set(tables)) == len(tables)
    other, c = run(spark, m, m.lines() + [f"<{SKY}x/1> <{SKY}p#Night> <{SKY}x/2> ."], relations=RelationConfig(strategy=RelationStrategy.PREDICATES))
    assert {"night", "night_2"} <= set(other) and other["night_2"].columns == ["ID_from", "ID_to"]  # a relation named like a table


def test_errors_become_instances(spark):
    m = sky()
    bad = [f'<{SKY}n> <{TERM}seeing> "many"^^<http://www.w3.org/2001/XMLSchema#int> .', f"_:b <{TERM}seeing> <{SKY}n> ."]
    tables, _ = run(spark, m, m.lines() + bad)
    (name,) = [t for t in tables if "error" in t]
    assert tables[name].count() == 2 and len(tables[name].columns) == 5


def test_layout_does_not_change_results(spark):
    q = quads(spark, sky().lines() * 2)
    one, two = MapPersistor(), MapPersistor()
    convert(spark, q.repartition(7), ConvertConfig(), one)
    convert(spark, q.coalesce(1), ConvertConfig(), two)
    assert one.result.keys() == two.result.keys()
    for name, frame in one.result.items():
        assert rows(frame) == rows(two.result[name])
