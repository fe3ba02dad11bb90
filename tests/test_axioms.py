"""Names inside of expressions, axioms without a named subject, and ontologies compared across loads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import axfilter, setops
from axiograph.sources.shared import settle
from tests.test_reasoning import COLUMNS, Builder


def frame(spark, names):
    return spark.createDataFrame([(x,) for x in names], "node string")


def full(b):
    """An axiom of every kind, over nested expressions."""
    b.axiom("A", V.SUBCLASS, ("some", "p", ("and", "B", ("all", "q", ("not", "C")))))
    b.general(("some", "p", "B"), V.SUBCLASS, "C")
    b.axiom("D", V.EQUIVALENT, ("min", "2", "p", ("one", "i", "j")))
    b.axiom("D", V.SUBCLASS, ("value", "q", "i"))
    b.axiom("E", V.SUBCLASS, ("max", "3", "q", None))
    b.several(V.ALL_DISJOINT, V.MEMBERS, ["C", "A", ("some", "q", "B")])
    b.several(V.ALL_DIFFERENT, V.DISTINCT_MEMBERS, ["j", "i"])
    b.list_of("r", V.CHAIN, ["q", "p"])
    b.list_of("C", V.DISJOINT_UNION, ["E", "D"])
    b.list_of("C", V.KEY, ["q"])
    b.negative("i", "p", "j")
    return b


@pytest.fixture(scope="module")
def ont(spark):
    return full(Builder("x")).ontology(spark, "ABCDE", "pqr")


def logical(df):
    return {(r["ax_type"], r["subject"], r["object"]) for r in df.where("ax_type <> 'Declaration'").collect()}


def test_axioms_of_every_kind(ont):
    assert logical(ont.axioms) == {
        ("SubClassOf", "A", "some(p and(B all(q not(C))))"), ("SubClassOf", "some(p B)", "C"), ("EquivalentClasses", "D", "min(2 p one(i j))"), ("SubClassOf", "D", "value(q i)"),
        ("SubClassOf", "E", f"max(3 q {V.THING})"), ("DisjointClasses", "A", "list(A C some(q B))"), ("DifferentIndividuals", "i", "list(i j)"), ("SubPropertyChainOf", "r", "chain(q p)"),
        ("DisjointUnion", "C", "list(D E)"), ("HasKey", "C", "list(q)"), ("NegativePropertyAssertion", "i", "j"),
    }
    of = {(r["ax_type"], r["subject"]): set(r["sig"]) for r in ont.axioms.collect()}
    assert of["SubClassOf", "A"] == {"A", "p", "B", "q", "C"} and of["SubClassOf", "some(p B)"] == {"p", "B", "C"}
    assert of["DisjointClasses", "A"] == {"A", "C", "q", "B"} and of["EquivalentClasses", "D"] == {"D", "p", "i", "j"} and of["SubPropertyChainOf", "r"] == {"r", "q", "p"}
    assert {(r["node"], r["depth"]) for r in ont.inside.join(ont.labels.select(F.col("node").alias("expr"), "text"), "expr").where("text = 'some(p and(B all(q not(C))))' AND node_kind = 'iri'").collect()} == {("p", 1), ("B", 2), ("q", 3), ("C", 4)}


def test_filters_see_names_inside(spark, ont):
    sub = axfilter.of_type(ont.axioms, ["subclass"])
    assert logical(axfilter.partial(sub, frame(spark, "C"))) == {("SubClassOf", "A", "some(p and(B all(q not(C))))"), ("SubClassOf", "some(p B)", "C")}
    assert ("SubClassOf", "A", "some(p and(B all(q not(C))))") not in logical(axfilter.complete(sub, frame(spark, "ABpq")))
    assert ("SubClassOf", "A", "some(p and(B all(q not(C))))") in logical(axfilter.complete(sub, frame(spark, "ABCpq")))
    assert logical(axfilter.partial(sub, frame(spark, ["all(q not(C))"]), named_only=False)) == {("SubClassOf", "A", "some(p and(B all(q not(C))))")}
    gone = {(r["subject"], r["object"]) for r in axfilter.remove(ont, frame(spark, "C"), ["subclass"], signature=True).where("ax_type = 'SubClassOf'").collect()}
    assert gone == {("D", "value(q i)"), ("E", f"max(3 q {V.THING})")}
    assert {(r["subject"], r["object"]) for r in axfilter.keep(ont, frame(spark, "AB")).where("ax_type = 'SubClassOf'").collect()} == set()
    objects = frame(spark, "pqr")
    assert {x[1] for x in logical(axfilter.by_properties(sub, ["q"], objects))} == {"D", "E"}


def test_what_no_axiom_takes_up(spark):
    b = full(Builder("x"))
    assert b.ontology(spark, "ABCDE", "pqr").unconsumed().isEmpty()
    b.add("_:lost", V.SOME, "A")
    b.add("_:self", V.ON_PROPERTY, "p")
    b.add("_:self", V.SOME, "_:self")
    b.add("_:c1", V.FIRST, "A")
    b.add("_:c1", V.REST, "_:c1")
    assert {r["s"] for r in b.ontology(spark, "ABCDE", "pqr").unconsumed().collect()} == {"_:lost", "_:self", "_:c1"}


def annotated(b, tag):
    n = f"_:note{tag}"
    for p, o in ((V.TYPE, V.AXIOM), (V.ANN_SOURCE, "A"), (V.ANN_PROPERTY, V.SUBCLASS), (V.ANN_TARGET, "B"), (V.COMMENT, "why")):
        b.add(n, p, o)
    b.add("A", V.SUBCLASS, "B")
    for x, y in (("u", "v"), ("v", "u")):  # two nodes in a circle
        b.add(f"_:{x}{tag}", "knows", f"_:{y}{tag}")
    b.add(f"_:u{tag}", V.TYPE, "A")
    b.add("i", "knows", f"_:v{tag}")
    return b


def test_two_loads_are_one(spark):
    loads = []
    for tag in "xy":
        b = annotated(full(Builder(tag)), tag)
        random.Random(tag).shuffle(b.rows)
        loads.append(b.ontology(spark, "ABCDE", "pqr"))
    left, right = (settle(setops.canonical(o.rows)) for o in loads)
    n = left.count()
    assert setops.diff(left, right, shared=True).isEmpty() and setops.unmerge(left, right, shared=True).isEmpty() and setops.merge(loads[0].rows, loads[1].rows).count() == n
    assert setops.same_axioms(*loads) and setops.merged_axioms(*loads).count() == loads[0].axioms.count() and setops.unmerged_axioms(*loads).isEmpty()
    again = Ontology(left)
    assert setops.same_axioms(loads[0], again) and setops.diff(left, setops.canonical(left), shared=True).isEmpty()
    b = annotated(full(Builder("z")), "z")
    b.axiom("A", V.SUBCLASS, ("some", "p", ("and", "B", "E")))
    b.rows.remove(("i", "iri", "knows", "_:vz", "bnode", None, None))
    other = b.ontology(spark, "ABCDE", "pqr")
    assert {(r["side"], r["object"]) for r in setops.axiom_diff(loads[0], other).where("ax_type = 'SubClassOf'").collect()} == {("right", "some(p and(B E))")}
    assert not setops.diff(left, setops.canonical(other.rows), shared=True).isEmpty()


def test_loads_without_blank_nodes_or_rows(spark):
    rows = spark.createDataFrame([("A", "iri", V.SUBCLASS, "B", "iri", None, None)], COLUMNS)
    assert setops.equal(rows, rows) and setops.merge(rows, rows.limit(0)).count() == 1 and Ontology(rows.limit(0)).axioms.isEmpty() and setops.canonical(rows.limit(0)).isEmpty()


def test_axioms_are_not_shuffled_by_predicate(spark, monkeypatch):
    plans, real = [], settle

    def kept(df, what="step"):
        if what == "axioms":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, what)

    monkeypatch.setattr("axiograph.model.settle", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the sizes of tables are not known
    try:
        made = Builder("y")
        made.axiom("A", V.SUBCLASS, "B")
        made.add("A", "p", "B")
        assert made.ontology(spark, "AB", "p").axioms.where("ax_type = 'ObjectPropertyAssertion'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 1 and not re.search(r"SortMergeJoin \[p#\d+L?\], \[p#", plans[0])


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_long_texts_are_not_shuffled_to_make_axioms_distinct(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=20_000)) for _ in range(60)]
    rows = [(f"a:{i}", "iri", "a:says", x, "lit", None, None) for i, x in enumerate(texts)]
    rows += [("a:0", "iri", "a:says", texts[0], "lit", "", ""), ("a:1", "iri", "a:says", texts[1], "lit", None, None), ("a:1", "iri", "a:says", texts[1], "lit", None, "en")]
    triples = settle(spark.createDataFrame(rows, COLUMNS), "triples")
    before = shuffled(spark)
    axioms = Ontology(triples).axioms
    assert shuffled(spark) - before < 300_000  # of 1,200,000
    assert axioms.count() == axioms.select("ax_id").distinct().count() == 61
    assert axioms.where("subject = 'a:0'").count() == 1 and {r["lang"] for r in axioms.where("subject = 'a:1'").collect()} == {"", "en"}
