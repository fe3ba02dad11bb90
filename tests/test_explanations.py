"""Justifications, unsatisfiable classes by kind and tautologies against plain Python on small ontologies."""

import random
from itertools import combinations

from axiograph.functions import vocab as V
from axiograph.operators import explain, reason
from tests.test_reasoning import Builder, brute

GOALS = "child string, parent string"


def text(e):
    """The canonical text of an expression of the Builder."""
    if isinstance(e, str):
        return e
    return f"some({e[1]} {text(e[2])})" if e[0] == "some" else f"{e[0]}({' '.join(sorted(text(x) for x in e[1:]))})"


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault((r["child"], r["parent"]), {}).setdefault(r["rank"], set()).add((r["ax_type"], r["subject"], r["object"]))
    return {k: {frozenset(s) for s in v.values()} for k, v in out.items()}


def test_all_justifications_against_all_subsets(spark):
    rng = random.Random(5)
    b, goals, wanted, names = Builder(), [], {}, []
    for k in range(4):  # ontologies of names of their own, in one
        classes, props = [f"C{k}{i}" for i in range(5)], [f"p{k}", f"q{k}"]
        simple = lambda: ("some", rng.choice(props), rng.choice(classes))  # noqa: B023, E731
        right = lambda: rng.choice([lambda: rng.choice(classes), simple, lambda: ("and", *sorted(rng.sample(classes, 2)))])()  # noqa: B023, E731
        axioms = {("sub" if rng.random() < 0.7 else "eq", rng.choice(classes), right()) for _ in range(7)}
        axioms = sorted((a for a in axioms if a[1] != a[2]), key=str) + [("subprop", *props), ("dis", classes[3], classes[4]), ("domain", props[1], classes[0])]
        kinds = {"sub": V.SUBCLASS, "eq": V.EQUIVALENT, "subprop": V.SUBPROPERTY, "dis": V.DISJOINT, "domain": V.DOMAIN}
        shown = {"sub": "SubClassOf", "eq": "EquivalentClasses", "subprop": "SubPropertyOf", "dis": "DisjointClasses", "domain": "PropertyDomain"}
        for kind, s, o in axioms:
            b.axiom(s, kinds[kind], o)
        names += classes
        expressions = [(e, "sub", e) for _, _, e in axioms if not isinstance(e, str)]  # nodes even where their axiom is left out
        local = {p: "pq"[i] for i, p in enumerate(props)}
        renamed = lambda e: e if isinstance(e, str) else ("some", local[e[1]], e[2]) if e[0] == "some" else e  # noqa: B023, E731

        def holds(chosen, expressions=expressions, classes=classes, renamed=renamed, local=local):
            told = [(s, kind, renamed(o)) for kind, s, o in chosen if kind in ("sub", "eq")] + [(renamed(a), "sub", renamed(c)) for a, _, c in expressions]
            pick = lambda kind: [(s, o) for k, s, o in chosen if k == kind]
            return brute(classes, told, set(), [(local[s], local[o]) for s, o in pick("subprop")], [(local[s], o) for s, o in pick("domain")], pick("dis"))

        ends = {(x, y) for x in classes for y in [*classes, V.NOTHING] if x != y}
        goals += sorted(ends)
        for n in range(len(axioms) + 1):
            for chosen in combinations(axioms, n):
                sets = frozenset((shown[kind], s, text(o)) for kind, s, o in chosen)
                open_ = [e for e in ends if not any(w <= sets for w in wanted.get(e, ()))]
                if open_:
                    sub = holds(chosen)
                    for x, y in open_:
                        if (x, y) in sub or (x, V.NOTHING) in sub:
                            wanted.setdefault((x, y), set()).add(sets)
    ont = b.ontology(spark, names, [f"{p}{k}" for p in "pq" for k in range(4)])
    table = spark.createDataFrame(goals, GOALS)
    assert found(explain.justifications(ont, table)) == wanted
    assert any(len(v) > 1 for v in wanted.values()) and any(y == V.NOTHING for _, y in wanted)
    small = {k: [s for s in v if len(s) < 3] for k, v in wanted.items()}
    best = found(explain.justifications(ont, table, most=1, largest=2))  # of at most two axioms, the first set
    assert {k: [len(s) for s in v] for k, v in best.items()} == {k: [min(map(len, v))] for k, v in small.items() if v} and all(v <= wanted[k] for k, v in best.items())


def test_definitions_chains_groups_and_fillers_are_explained(spark):
    b = Builder()
    b.axiom("A", V.EQUIVALENT, ("and", "B", ("some", "p", "C")))
    b.axiom("D", V.SUBCLASS, "B")
    b.axiom("D", V.SUBCLASS, ("some", "p", "C"))
    b.list_of("r", V.CHAIN, ["p", "q", "p"])
    b.axiom("C", V.SUBCLASS, ("some", "q", "E"))
    b.axiom("E", V.SUBCLASS, ("some", "p", "F"))
    b.general(("some", "r", "F"), V.SUBCLASS, "G")
    b.several(V.ALL_DISJOINT, V.MEMBERS, ["G", "H", "K"])
    b.axiom("L", V.SUBCLASS, "D")
    b.axiom("L", V.SUBCLASS, "H")
    ont = b.ontology(spark, "ABCDEFGHKL", "pqr")
    sets = found(explain.justifications(ont, spark.createDataFrame([("D", "A"), ("D", "G"), ("L", V.NOTHING), ("K", "A"), ("D", "D"), ("D", None)], GOALS)))
    definition, step = ("EquivalentClasses", "A", "and(B some(p C))"), ("SubClassOf", "D", "some(p C)")
    assert sets["D", "A"] == {frozenset({definition, ("SubClassOf", "D", "B"), step})}
    to_g = {step, ("SubClassOf", "C", "some(q E)"), ("SubClassOf", "E", "some(p F)"), ("SubPropertyChainOf", "r", "chain(p q p)"), ("SubClassOf", "some(r F)", "G")}
    assert sets["D", "G"] == {frozenset(to_g)}
    assert sets["L", V.NOTHING] == {frozenset(to_g | {("SubClassOf", "L", "D"), ("SubClassOf", "L", "H"), ("DisjointClasses", "G", "list(G H K)")})}
    assert set(sets) == {("D", "A"), ("D", "G"), ("L", V.NOTHING)}


def test_kinds_of_unsatisfiable_classes_impact_and_markdown(spark):
    b = Builder()
    b.add("B", V.DISJOINT, "C")
    for s, o in (("A", "B"), ("A", "C"), ("S", "A"), ("X", ("some", "p", "S")), ("Y", "B")):
        b.axiom(s, V.SUBCLASS, o)
    b.rows.append(("A", "iri", V.LABEL, "apple pie", "literal", None, None))
    ont = b.ontology(spark, "ABCSXY", "p")
    kinds = {r["iri"]: (r["is_root"], r["is_most_general"]) for r in explain.unsatisfiable_kinds(ont).collect()}
    assert kinds == {"A": (True, True), "S": (False, False), "X": (False, True)}
    reasons = explain.clash_justifications(ont)
    uses = {(r["subject"], r["object"]): r["uses"] for r in explain.axiom_impact(reasons).collect()}
    assert uses == {("B", "C"): 3, ("A", "B"): 3, ("A", "C"): 3, ("S", "A"): 2, ("X", "some(p S)"): 1}
    assert {r["child"] for r in explain.clash_justifications(ont, "root").collect()} == {"A"}
    texts = {r["child"]: r["text"] for r in explain.markdown(ont, reasons).collect()}
    assert texts["A"] == f"## [apple pie](A) SubClassOf [{V.NOTHING}]({V.NOTHING}) ##\n\n  - [apple pie](A) SubClassOf B\n  - [apple pie](A) SubClassOf C\n  - B DisjointWith C"
    assert texts["X"].splitlines()[2] == "  - X SubClassOf some(p S)"


def test_tautologies_follow_from_no_axiom(spark):
    b = Builder()
    inner = ("some", "p", ("and", "A", "B"))
    true = [("A", V.SUBCLASS, "A"), ("A", V.SUBCLASS, V.THING), ("A", V.SUBCLASS, ("or", "A", "C")), ("p", V.DOMAIN, V.THING), ("p", V.SUBPROPERTY, "p"), (V.NOTHING, V.SUBCLASS, "A"), ("A", V.DISJOINT, V.NOTHING)]
    false = [("A", V.SUBCLASS, "B"), ("B", V.SUBCLASS, "C"), ("A", V.SUBCLASS, ("and", "A", "B")), ("A", V.DISJOINT, "C"), ("p", V.DOMAIN, "A"), (V.THING, V.SUBCLASS, "C")]
    for s, p, o in true + false:
        b.axiom(s, p, o)
    b.general(inner, V.SUBCLASS, ("some", "p", "A"))
    b.general(("and", "A", "B"), V.SUBCLASS, "B")
    b.general(("some", "p", "A"), V.SUBCLASS, ("some", "p", V.THING))
    b.general(("some", "p", V.NOTHING), V.SUBCLASS, "C")
    b.general(("some", "p", "A"), V.SUBCLASS, ("some", "p", "B"))  # follows from another axiom, so it isn't one
    ont = b.ontology(spark, "ABC", "p")
    got = {(r["subject"], r["property"], r["object"]) for r in ont.axioms.join(explain.tautologies(ont), "ax_id", "left_semi").collect()}
    both = {("some(p and(A B))", "some(p A)"), ("and(A B)", "B"), ("some(p A)", f"some(p {V.THING})"), (f"some(p {V.NOTHING})", "C")}
    assert got == {(s, p, text(o)) for s, p, o in true} | {(s, V.SUBCLASS, o) for s, o in both}


def test_empty_ontologies_have_nothing_to_explain(spark):
    ont = Builder()
    ont.add("A", V.TYPE, V.CLASS)
    ont = ont.ontology(spark, "")
    assert explain.justifications(ont, spark.createDataFrame([("A", "B")], GOALS)).count() == 0
    assert explain.justifications(ont, spark.createDataFrame([], GOALS)).count() == 0
    assert explain.unsatisfiable_kinds(ont).count() == 0 and explain.tautologies(ont).count() == 0
    assert reason.classify(ont).count() == 0


def test_intersections_with_a_common_part_do_not_meet_each_other(spark, monkeypatch):
    b, steps, settle = Builder(), {}, explain.settle
    for i in range(12):
        b.add(f"D{i}", V.EQUIVALENT, b.node(("and", "Common", f"P{i}")))
    b.add(b.node(("and", "Common", "P3")), V.SUBCLASS, "P3")
    monkeypatch.setattr(explain, "settle", lambda df, what: steps.setdefault(what, []).append(out := settle(df, what)) or out)
    ont = b.ontology(spark, [f"{k}{i}" for k in "PD" for i in range(12)] + ["Common"])
    assert {r["subject"] for r in ont.axioms.join(explain.tautologies(ont), "ax_id", "left_semi").collect()} == {"and(Common P3)"}
    assert max(t.count() for t in steps["held"]) <= 24  # 144 pairs share the part
