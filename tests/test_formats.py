"""File formats, reasoning over properties, subsets, macros, profiles and steps on small fixtures."""

import pytest
from pyspark.sql import functions as F

from axiograph import pipeline
from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import export, metrics, patterns, reason, setops
from axiograph.sources import files, store
from tests.test_graph import triples_of

C = lambda x: V.EX + x
S = lambda x, lang=None: (x, V.LANG_STRING if lang else V.XSD_STRING, lang)


def test_every_format_round_trips(spark, tmp_path):
    odd = [S('a"b\\n\n\t! x'), S("ü😀", "fr-CA"), ("1", V.XSD_INTEGER, None), S("{\\"), S("")]
    rows = triples_of(spark, [(C("a"), V.LABEL, o) for o in odd] + [("_:x", V.SEE_ALSO, C("b")), (C("a"), V.TYPE, V.CLASS)])
    for ending in ("nt", "nt.gz", "jsonl", "jsonl.gz", "parquet"):
        path = f"file://{tmp_path}/x.{ending}"
        files.save(rows, path)
        assert setops.diff(rows, files.load(spark, path), shared=True).isEmpty(), ending  # names of blank nodes stay, too
    assert files.load(spark, "urn:x", f"file://{tmp_path}/x.jsonl", catalog={"urn:x": f"file://{tmp_path}/x.nt"}).count() == rows.count()
    with pytest.raises(ValueError):
        files.load(spark, "x.doc")
    files.save(rows.limit(0), f"file://{tmp_path}/none.nt")
    assert files.load(spark, f"file://{tmp_path}/none.nt").count() == 0


def test_jsonld_names_and_plain_values(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"@id":"ex:a","@type":["ex:T"],"label":["x",3,true,{"@value":"y","@language":"de"}],"ex:to":[{"@id":"_:b"}]}\n\n')
    got = {(r["s"], r["p"], r["o"], r["o_kind"], r["o_dt"], r["o_lang"]) for r in files.read_jsonld(spark, f"file://{tmp_path}/x.jsonl", {"ex": V.EX, "label": V.LABEL}).collect()}
    lit = lambda o, dt, lang=None: (C("a"), V.LABEL, o, "lit", dt, lang)
    assert got == {(C("a"), V.TYPE, C("T"), "iri", None, None), lit("x", V.XSD_STRING), lit("3", V.XSD_INTEGER), lit("true", V.XSD_BOOLEAN), lit("y", V.LANG_STRING, "de"), (C("a"), C("to"), "_:b", "bnode", None, None)}


def test_obo_writer(spark, tmp_path):
    a, b, p = (f"{V.OBO}GO_{i}" for i in (1, 2, 3))
    rows = [(a, V.TYPE, V.CLASS), (b, V.TYPE, V.CLASS), (p, V.TYPE, V.OBJECT_PROPERTY), (a, V.LABEL, S("one ! two\\\n")), (a, V.DEFINITION, S('it"s\n\nlong')), (a, V.SUBCLASS, b), (a, V.EXACT, S("uno"))]
    rows += [(b, V.DEPRECATED, ("true", V.XSD_BOOLEAN, None)), (a, V.SUBCLASS, "_:r"), ("_:r", V.TYPE, V.RESTRICTION), ("_:r", V.ON_PROPERTY, p), ("_:r", V.SOME, b)]
    files.save(triples_of(spark, rows), f"file://{tmp_path}/x.obo")
    back = files.load(spark, f"file://{tmp_path}/x.obo")
    got = {(r["s"], r["p"], r["o"]) for r in back.where("o_kind <> 'bnode' AND s_kind = 'iri'").collect()}
    assert got == {(a, V.TYPE, V.CLASS), (b, V.TYPE, V.CLASS), (p, V.TYPE, V.OBJECT_PROPERTY), (a, V.LABEL, "one ! two\\"), (a, V.DEFINITION, 'it"s\n\nlong'), (a, V.SUBCLASS, b), (a, V.EXACT, "uno"), (b, V.DEPRECATED, "true")}
    assert [tuple(r) for r in reason.restrictions(Ontology(back)).collect()] == [(a, p, b)]


def test_tables_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', "x\ny"), ("", " z ")], "k string, v string")
    for fmt in ("csv", "tsv", "json"):
        files.write_rows(rows, f"file://{tmp_path}/t.{fmt}", fmt)
        assert {tuple(r) for r in files.read_rows(spark, f"file://{tmp_path}/t.{fmt}", fmt).select("k", "v").collect()} == {('a "b", c', "x\ny"), ("", " z ")}
    assert {r["value"] for r in files.yaml_rows(spark.createDataFrame([("it's", "1")], "a string, b string")).collect()} == {"- a: 'it''s'\n  b: '1'"}
    assert files.read_catalog('<catalog xmlns="urn:c"><group><uri name="urn:a" uri="a.owl"/></group></catalog>') == {"urn:a": "a.owl"}
    with pytest.raises(ValueError):
        files.write_rows(rows, "x", "doc")


def test_properties_and_subset(spark):
    rows = [(C(x), V.TYPE, V.OBJECT_PROPERTY) for x in "pqr"] + [(C("p"), V.SUBPROPERTY, C("q")), (C("q"), V.INVERSE, C("r")), (C("q"), V.DOMAIN, C("D")), (C("a"), C("p"), C("b"))]
    ont = Ontology(triples_of(spark, rows))
    assert {tuple(x.removeprefix(V.EX) for x in r) for r in reason.property_assertions(ont).collect()} == {("a", "p", "b"), ("a", "q", "b"), ("b", "r", "a")}
    assert ("PropertyDomain", C("p"), C("D")) in {tuple(r) for r in reason.inferred_property_axioms(ont).collect()}
    tree = [(C(x), V.TYPE, V.CLASS) for x in "ABC"] + [(C("A"), V.SUBCLASS, C("B")), (C("B"), V.SUBCLASS, C("C")), (C("B"), V.SUBCLASS, "_:1"), ("_:1", V.ON_PROPERTY, C("p")), ("_:1", V.SOME, C("C"))]
    ont = Ontology(triples_of(spark, tree))
    nodes = spark.createDataFrame([(C("A"),), (C("C"),)], "node string")
    assert {tuple(r) for r in reason.subset(ont, nodes).collect()} == {(C("A"), V.SUBCLASS, C("C")), (C("A"), C("p"), C("C"))}
    assert {(r["s"], r["o"]) for r in reason.reasoned(ont, new_ontology=True, indirect=True).collect()} == {(C("A"), C("C"))}
    assert reason.profile_violations(ont, "EL").count() == 0 and reason.profile_violations(ont, "RL").count() == 1
    with pytest.raises(ValueError):
        reason.reasoned(ont, "other")


def test_incoherent_module_and_reasoner_metrics(spark):
    rows = [(C(x), V.TYPE, V.CLASS) for x in "ABCDE"] + [(C("A"), V.DISJOINT, C("B")), (C("C"), V.SUBCLASS, C("A")), (C("C"), V.SUBCLASS, C("B")), (C("E"), V.SUBCLASS, C("D"))]
    ont = Ontology(triples_of(spark, rows))
    assert {(r["subject"], r["object"]) for r in reason.incoherent_module(ont).where(F.col("ax_type") != "Declaration").collect()} >= {(C("C"), C("A")), (C("C"), C("B")), (C("A"), C("B"))}
    assert reason.incoherent_module(ont).where(F.col("subject") == C("E")).count() == 0
    assert {r["metric"]: r["metric_value"] for r in metrics.reasoner_metrics(ont).collect()} == {"unsatisfiable_class_count": "1", "consistent": "true"}


def test_macros_json_rows_and_steps(spark):
    rows = triples_of(spark, [(C("a"), V.SUBCLASS, C("b")), (C("a"), V.TYPE, V.CLASS), (C("a"), V.LABEL, S("x"))])
    g = patterns.Graph(rows)
    macros = {"ex:m": (g.match(("?c", "rdfs:subClassOf", "?d")), [("?d", "ex:over", "?c")]), "ex:n": (g.match(("?c", "rdfs:subClassOf", "?d")), [("?d", "ex:n", "?c")])}
    made = {tuple(r) for r in patterns.expand_macros(g, macros, include=["ex:m"], source="dcterms:source").collect()}
    assert made == {(f"<{C('b')}>", f"<{C('over')}>", f"<{C('a')}>"), (f"<{C('b')}>", f"<{V.DCTERMS}source>", f"<{C('m')}>")}
    assert patterns.expand_macros(g, {}).count() == 0
    assert [r["value"] for r in export.json_rows(export.export(Ontology(rows), ["ID", "LABEL", "SubClass Of [IRI]"], ["classes"])).collect()] == [f'{{"ID":"ex:a","LABEL":["x"],"SubClass Of [IRI]":["{C("b")}"]}}']
    out = pipeline.Chain(rows).then("rename-prefixes", prefixes={V.EX: "urn:y:"}).then("unmerge", others=[rows]).triples
    assert {r["s"] for r in out.collect()} == {"urn:y:a"}


def test_a_file_of_the_store_holds_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 10, raising=False)
    none = F.lit(None).cast("string")
    rows = spark.range(35).select(F.lit("root").alias("graph"), F.concat(F.lit("n"), "id").alias("s"), F.lit("iri").alias("s_kind"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    store.write_store(rows, f"{tmp_path}/store")
    held = store.read_store(spark, f"{tmp_path}/store").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in held) == 35 and max(r["count"] for r in held) <= 10  # a task reads whole files
