"""Rules, reports, repair, export, reasoning, patterns, templates and files on small fixtures."""

import pytest
from pyspark.sql import functions as F

from axiograph import pipeline
from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import export, patterns, reason, repair, report, rules, setops, template
from axiograph.plans.registry import ORACLE_SQL, QUERIES
from axiograph.sources import files
from axiograph.streaming.checks import check_stream
from tests.test_graph import triples_of

C = lambda x: V.EX + x
S = lambda x, lang=None: (x, V.LANG_STRING if lang else V.XSD_STRING, lang)


def found(df):
    return {tuple(r) for r in df.collect()}


def test_missing_label(spark):
    rows = [(C("A"), V.TYPE, V.CLASS), (C("B"), V.SUBCLASS, C("A")), (C("C"), V.COMMENT, S("x")), (C("D"), V.LABEL, S("")), (C("E"), V.LABEL, S("e"))]
    assert {r[0] for r in found(rules.missing_label(rules.Graph(triples_of(spark, rows))))} == {C("B"), C("C"), C("D")}


def test_duplicate_label_needs_a_live_entity(spark):
    dep = lambda x: (C(x), V.DEPRECATED, ("true", V.XSD_BOOLEAN, None))
    rows = [(C(x), V.LABEL, S(t)) for x, t in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", "3"), ("f", "3"), ("g", "4"))] + [dep("a"), dep("c"), dep("d")]
    rows += [(C("h"), V.LABEL, S("3", "en"))]  # a language-tagged text is another term
    assert {r[0] for r in found(rules.duplicate_label(rules.Graph(triples_of(spark, rows))))} == {C("a"), C("b"), C("e"), C("f")}


def test_every_rule_runs_on_an_empty_graph(spark):
    g = rules.Graph(triples_of(spark, [(C("A"), V.TYPE, V.CLASS)]).limit(0))
    for rule in rules.RULES.values():
        assert rule(g).count() == 0


def test_report(spark):
    rows = triples_of(spark, [(C("A"), V.LABEL, S(" a")), (V.RDFS + "x", V.LABEL, S("b ")), (C("B"), V.LABEL, S("c\nd")), (C("C"), V.LABEL, S("e ")), (C("E"), V.TYPE, V.CLASS)])
    profile = report.read_profile("ERROR\tlabel_whitespace\nWARN\tlabel_formatting\n")
    got = report.report(rows, profile)
    assert {(r[0], r[1], r[2]) for r in found(got)} == {("ERROR", "label_whitespace", C("A")), ("ERROR", "label_whitespace", C("C")), ("WARN", "label_formatting", C("B"))}
    assert report.report(rows, profile, limit=1).count() == 2 and report.report(rows, profile, [C("C")]).count() == 1
    assert report.fails(got, "error") and not report.fails(got.where("level = 'WARN'"), "error") and not report.fails(got, "none")
    report.register_rule("own", lambda g: rules.violations(g.with_p(V.TYPE)))
    assert report.report(rows, {"own": "INFO"}).count() == 1
    with pytest.raises(ValueError):
        report.read_profile("LOUD\tlabel_whitespace")


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("WARN", "b", "x", "p", 'a "b"\tc'), ("ERROR", "z", "y", None, "<v>"), ("ERROR", "a", "x", "p", None), ("INFO", "c", "it's", "p", "1")], "level string, rule string, entity string, property string, value string")
    said = report.write(rows, f"{tmp_path}/r.tsv")
    assert said == "Violations: 4\n-------------\nERROR: 2\nWARN:  1\nINFO:  1"
    assert [tuple(r) for r in report.table(rows).collect()] == [("ERROR", "a", "x", "p", ""), ("ERROR", "z", "y", "", "<v>"), ("WARN", "b", "x", "p", 'a "b"\tc'), ("INFO", "c", "it's", "p", "1")]
    assert found(files.read_rows(spark, f"{tmp_path}/r.tsv", "tsv")) == found(report.table(rows))
    for ending, part in (("html", "<td>&lt;v&gt;</td>"), ("yaml", "Subject: 'it''s'"), ("json", '"Rule Name":"z"')):
        report.write(rows, f"{tmp_path}/r.{ending}")
        assert part in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/r.{ending}").collect())
    assert report.write(rows.limit(0), f"{tmp_path}/none", "csv") == "No violations found."


def test_repair(spark):
    rows = [(C("new"), V.TYPE, V.CLASS), (C("old"), V.TYPE, V.CLASS), (C("old"), V.DEPRECATED, ("true", V.XSD_BOOLEAN, None)), (C("old"), V.REPLACED_BY, C("new")), (C("x"), V.SUBCLASS, C("old")), (C("old"), V.XREF, S("R:1"))]
    ont = Ontology(triples_of(spark, rows))
    got = {(r["s"], r["p"], r["o"]) for r in repair.repair_references(ont, [V.XREF]).collect()}
    assert (C("x"), V.SUBCLASS, C("new")) in got and (C("new"), V.XREF, "R:1") in got and (C("old"), V.REPLACED_BY, C("new")) in got and (C("old"), V.XREF, "R:1") not in got


def test_annotations_kept_and_merged(spark):
    rows = [(C("1"), V.LABEL, S("Test one")), (C("1"), V.LABEL, S("Test 1")), (C("2"), V.LABEL, S("Test deux", "fr")), (C("2"), V.LABEL, S("Test two"))]
    ont = Ontology(triples_of(spark, rows))
    assert {(r["s"], r["o"]) for r in repair.one_annotation(ont, [V.LABEL]).collect()} == {(C("1"), "Test 1"), (C("2"), "Test two")}
    assert {(r["s"], r["o"]) for r in repair.joined_annotations(ont, [V.LABEL]).collect()} == {(C("1"), "Test 1 Test one"), (C("2"), "Test deux Test two")}


def test_sets(spark):
    a = triples_of(spark, [(C("a"), V.LABEL, S("x")), (C("b"), V.LABEL, S("y", "en"))])
    b = triples_of(spark, [(C("b"), V.LABEL, S("y", "en")), (C("c"), V.LABEL, S("z"))])
    assert setops.merge(a, b, a).count() == 3 and setops.unmerge(a, b).count() == 1
    assert {(r["side"], r["s"]) for r in setops.diff(a, b).collect()} == {("left", C("a")), ("right", C("c"))}
    assert setops.equal(a, a) and not setops.equal(a, b)
    with pytest.raises(ValueError):
        setops.check_mapping(spark.createDataFrame([("a", "x"), ("a", "y")], "old string, new string"))


def test_classification(spark):
    """XA = some p B, A under some q C, q under p, C under B: so A is under XA; then chains and direct links."""
    rows = [(C(x), V.TYPE, V.CLASS) for x in ("A", "B", "C", "XA", "D")]
    rows += [(C("XA"), V.EQUIVALENT, "_:1"), ("_:1", V.TYPE, V.RESTRICTION), ("_:1", V.ON_PROPERTY, C("p")), ("_:1", V.SOME, C("B"))]
    rows += [(C("A"), V.SUBCLASS, "_:2"), ("_:2", V.TYPE, V.RESTRICTION), ("_:2", V.ON_PROPERTY, C("q")), ("_:2", V.SOME, C("C"))]
    rows += [(C("q"), V.SUBPROPERTY, C("p")), (C("C"), V.SUBCLASS, C("B")), (C("D"), V.SUBCLASS, C("A")), (C("D"), V.SUBCLASS, C("XA")), (C("B"), V.DISJOINT, C("XA"))]
    ont = Ontology(triples_of(spark, rows))
    pairs = {(r["child"].removeprefix(V.EX), r["parent"].removeprefix(V.EX)) for r in reason.classify(ont).collect()}
    assert pairs == {("A", "XA"), ("C", "B"), ("D", "A"), ("D", "XA")}
    direct = {(r["child"].removeprefix(V.EX), r["parent"].removeprefix(V.EX), r["is_inferred"]) for r in reason.inferred(ont).collect()}
    assert direct == {("A", "XA", True), ("C", "B", False), ("D", "A", False)}
    assert {(r["cls"].removeprefix(V.EX), r["prop"].removeprefix(V.EX), r["filler"].removeprefix(V.EX)) for r in reason.materialized(ont).collect()} == {("A", "p", "C"), ("D", "p", "B"), ("D", "p", "C"), ("D", "q", "C")}
    assert reason.unsatisfiable(ont).count() == 0
    chain = [(r["subject"], r["object"]) for r in reason.explanations(ont, C("D"), C("XA"), 1).orderBy("step").collect()]
    assert chain == [(C("D"), C("XA"))]


def test_unsatisfiable_and_equivalences(spark):
    rows = [(C(x), V.TYPE, V.CLASS) for x in "ABCDE"] + [(C("A"), V.DISJOINT, C("B")), (C("C"), V.SUBCLASS, C("A")), (C("C"), V.SUBCLASS, C("B")), (C("D"), V.SUBCLASS, C("C"))]
    ont = Ontology(triples_of(spark, rows))
    assert {r["iri"] for r in reason.unsatisfiable(ont).collect()} == {C("C"), C("D")}
    ring = Ontology(triples_of(spark, [(C("A"), V.SUBCLASS, C("B")), (C("B"), V.SUBCLASS, C("A")), (C("D"), V.EQUIVALENT, C("E"))]))
    assert found(reason.equivalences(ring, "none")) == {(C("A"), C("B")), (C("D"), C("E"))}
    assert found(reason.equivalences(ring, "asserted-only")) == {(C("A"), C("B"))} and reason.equivalences(ring).count() == 0


def test_export(spark):
    rows = [(C("A"), V.TYPE, V.CLASS), (C("B"), V.TYPE, V.CLASS), (C("A"), V.LABEL, S("the A")), (C("B"), V.SUBCLASS, C("A")), (C("B"), V.COMMENT, S("x|y")), (C("A"), V.COMMENT, S("p|q")), (C("A"), V.COMMENT, S("r"))]
    ont = Ontology(triples_of(spark, rows))
    table = export.flat(export.export(ont, ["ID", "LABEL", "SubClass Of", "rdfs:comment"], ["classes"]))
    assert found(table) == {("ex:A", "the A", "", "p\\|q|r"), ("ex:B", "", "'the A'", "x|y")}
    assert [r["ID"] for r in export.sorted_table(table, ["LABEL"]).collect()] == ["ex:A", "ex:B"]
    assert [r["ID"] for r in export.sorted_table(table, ["^LABEL"]).collect()] == ["ex:B", "ex:A"]
    with pytest.raises(ValueError):
        export.export(ont, ["ID", "ID"])


def test_patterns(spark):
    rows = triples_of(spark, [(C("a"), V.LABEL, S("x")), (C("b"), V.LABEL, S("x", "en")), (C("b"), V.SUBCLASS, C("a")), (C("c"), V.SUBCLASS, C("b")), ("_:n", V.LABEL, S("n"))])
    g = patterns.Graph(rows)
    assert found(g.match(("?s", "rdfs:label", "'x'")).select("?s")) == {(f"<{C('a')}>",)}
    assert found(g.match(("?s", "rdfs:label", "?v")).filter(~patterns.is_blank("s")).bind("?l", patterns.language("v")).select("?s", "?l")) == {(f"<{C('a')}>", ""), (f"<{C('b')}>", "en")}
    assert found(g.match(("?s", "rdfs:subClassOf", "?m"), ("?m", "rdfs:subClassOf", "?t")).select("?s", "?t")) == {(f"<{C('c')}>", f"<{C('a')}>")}
    assert found(g.reachable("?s", "rdfs:subClassOf", "?t").select("?s", "?t")) == {(f"<{C(x)}>", f"<{C(y)}>") for x, y in ("ba", "cb", "ca")}
    made = g.match(("?s", "rdfs:subClassOf", "?t")).construct(("_:b", "rdfs:seeAlso", "?t"))
    assert made.select("s").distinct().count() == 2
    assert not g.match(("?s", "rdfs:label", "'none'")).ask()


def test_template(spark):
    table = spark.createDataFrame([("ex:a", "first", "second|ex:z", "note", "n2"), ("ex:b", "second", None, None, None), (None, None, "x", None, None), ("ex:c", "third", "nobody", "", "")], "ID string, Label string, Parents string, Note string, On string")
    made, errors = template.template(table, ["ID", "LABEL", "SC % SPLIT=|", "A rdfs:comment", ">A rdfs:seeAlso"])
    got = {(r["s"], r["p"], r["o"]) for r in made.collect()}
    assert {(C("a"), V.SUBCLASS, C("b")), (C("a"), V.SUBCLASS, C("z")), (C("a"), V.COMMENT, "note"), (C("b"), V.TYPE, V.CLASS)} <= got
    assert len([1 for s, p, o in got if p == V.ANN_SOURCE and o == C("a")]) == 1
    assert found(errors) == {("Parents", "nobody", "names no entity")}
    with pytest.raises(ValueError):
        template.plan(["a"], ["A rdfs:label"])


def test_ntriples(spark, tmp_path):
    odd = [S('a"b\\n\n\t'), S("ü😀", "fr-CA"), ("1", V.XSD_INTEGER, None), S("\\\\"), S("")]
    rows = triples_of(spark, [(C("a"), V.LABEL, o) for o in odd] + [("_:x", V.SEE_ALSO, C("b"))])
    files.write_ntriples(rows, f"file://{tmp_path}/nt", compressed=True)
    back = files.read_ntriples(spark, f"file://{tmp_path}/nt", strict=True)
    assert setops.equal(rows, back)
    (tmp_path / "bad.nt").write_text("<a> <b> <c> .\n# fine\n<a> <b> oops .\n")
    assert files.read_ntriples(spark, f"file://{tmp_path}/bad.nt").count() == 1
    with pytest.raises(files.ParseError):
        files.read_ntriples(spark, f"file://{tmp_path}/bad.nt", strict=True)


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: GO:1\nname: one ! two\nis_a: GO:2 ! parent\nrelationship: part_of GO:3\nsynonym: "uno" EXACT []\ndef: "what it is" [r:1]\n\n[Term]\nid: GO:2\nis_obsolete: true\nreplaced_by: GO:3\n')
    got = {(r["s"], r["p"], r["o"]) for r in files.read_obo(spark, f"file://{tmp_path}/x.obo").collect()}
    o = lambda n: f"{V.OBO}GO_{n}"
    assert {(o(1), V.TYPE, V.CLASS), (o(1), V.SUBCLASS, o(2)), (o(1), V.EXACT, "uno"), (o(1), V.DEFINITION, "what it is"), (o(2), V.DEPRECATED, "true"), (o(2), V.REPLACED_BY, o(3))} <= got
    assert reason.restrictions(Ontology(files.read_obo(spark, f"file://{tmp_path}/x.obo"))).collect()[0]["filler"] == o(3)


def test_small_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("ex:a # first\n# none\nhttps://example.org/b\n\nnonsense\n")
    assert {r["node"] for r in files.read_terms(spark, f"file://{tmp_path}/t.txt").collect()} == {C("a"), C("b")}
    (tmp_path / "m.tsv").write_text("Old\tNew\na\tb\n")
    assert found(files.read_mapping(spark, f"file://{tmp_path}/m.tsv")) == {("a", "b")}
    (tmp_path / "t.csv").write_text('ID,Label\nID,LABEL\nex:a,"x, y"\n')
    rows, strings = files.read_table(spark, f"file://{tmp_path}/t.csv")
    assert strings == ["ID", "LABEL"] and found(rows) == {("ex:a", "x, y")}
    assert files.read_prefixes(files.prefixes_json(V.PREFIXES)) == V.PREFIXES
    assert terms.cell_name(1, 1) == "A1" and terms.cell_name(26, 2) == "Z2" and terms.cell_name(28, 3) == "AB3"
    assert not files.write_if_any(rows.limit(0), f"file://{tmp_path}/none") and files.write_if_any(rows, f"file://{tmp_path}/some")
    with pytest.raises(ValueError):
        terms.expand("nope:x")


def test_stream(spark, tmp_path):
    for k, row in enumerate([(C("A"), V.TYPE, V.CLASS), (C("A"), V.LABEL, S(" a")), (C("B"), V.COMMENT, S("b"))]):
        triples_of(spark, [row]).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    schema = spark.read.parquet(f"{tmp_path}/in/part=0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    check_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", {"label_whitespace": "ERROR", "missing_label": "ERROR"}, once=True).awaitTermination()
    reports = spark.read.parquet(f"{tmp_path}/out/report")
    last = reports.where("batch = 2").collect()  # on all that has come, however it was cut
    assert sorted((r["rule"], r["entity"]) for r in last) == [("label_whitespace", C("A")), ("missing_label", C("B"))]


def test_chain(spark):
    if "drop-labels" not in pipeline.registered():
        pipeline.register("drop-labels", lambda ont: ont.triples.where(F.col("p") != V.LABEL))
    rows = triples_of(spark, [(C("A"), V.LABEL, S("a")), (C("A"), V.TYPE, V.CLASS)])
    assert pipeline.Chain(rows).then("drop-labels").triples.count() == 1
    with pytest.raises(ValueError):
        pipeline.Chain(rows).then("no-such-step")


def test_registry():
    assert len(QUERIES) > 150 and set(ORACLE_SQL) <= set(QUERIES)
    assert sum(n.startswith("rul_") for n in QUERIES) == 33
