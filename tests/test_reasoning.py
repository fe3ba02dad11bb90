"""Classification, expressions and modules against plain Python on small ontologies."""

import random

import pytest
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import graph, reason

COLUMNS = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


class Builder:
    """Triples of axioms whose expressions are names or tuples: ("some", p, x), ("all", p, x), ("value", p, i), ("and", x, ...), ("or", x, ...), ("one", i, ...), ("not", x), ("min", n, p, x or None)."""

    def __init__(self, tag=""):
        self.rows, self.n, self.tag = [], 0, tag

    def add(self, s, p, o):
        kind = lambda x: "bnode" if x.startswith("_:") else "iri"
        self.rows.append((s, kind(s), p, o, kind(o), None, None))

    def blank(self):
        self.n += 1
        return f"_:{self.tag}{self.n}"

    def node(self, e):
        if isinstance(e, str):
            return e
        at = self.blank()
        if e[0] in ("some", "all", "value"):
            self.add(at, V.ON_PROPERTY, e[1])
            self.add(at, {"some": V.SOME, "all": V.ALL, "value": V.VALUE}[e[0]], self.node(e[2]))
            return at
        if e[0] in ("min", "max"):
            self.add(at, V.ON_PROPERTY, e[2])
            self.add(at, V.OWL + (f"{e[0]}QualifiedCardinality" if e[3] else f"{e[0]}Cardinality"), e[1])
            if e[3]:
                self.add(at, V.ON_CLASS, self.node(e[3]))
            return at
        if e[0] == "not":
            self.add(at, V.COMPLEMENT, self.node(e[1]))
            return at
        self.list_of(at, {"and": V.INTERSECTION, "or": V.UNION, "one": V.ONE_OF}[e[0]], e[1:])
        return at

    def list_of(self, s, p, items):
        cells = [self.blank() for _ in items]
        self.add(s, p, cells[0])
        for i, (cell, part) in enumerate(zip(cells, items, strict=True)):
            self.add(cell, V.FIRST, self.node(part))
            self.add(cell, V.REST, cells[i + 1] if i + 1 < len(cells) else V.NIL)

    def general(self, left, p, right):
        self.add(self.node(left), p, self.node(right))

    def several(self, kind, p, items):
        at = self.blank()
        self.add(at, V.TYPE, kind)
        self.list_of(at, p, items)

    def negative(self, s, p, o):
        at = self.blank()
        for a, b in ((V.TYPE, V.NEGATIVE), (V.NEG_SOURCE, s), (V.NEG_PROPERTY, p), (V.NEG_TARGET, o)):
            self.add(at, a, b)

    def axiom(self, s, p, o):
        self.add(s, p, self.node(o))

    def ontology(self, spark, classes, properties=()):
        for c in classes:
            self.add(c, V.TYPE, V.CLASS)
        for p in properties:
            self.add(p, V.TYPE, V.OBJECT_PROPERTY)
        return Ontology(spark.createDataFrame(self.rows, COLUMNS))


def brute(classes, axioms, rules, sub_props, domains, apart, groups=()):
    """All (x, y), by rules applied until nothing is new; axioms: (left, "sub" or "eq", right); rules: (p, q, r) for p followed by q below r."""
    parts = set()

    def visit(e):
        parts.add(e)
        for x in () if isinstance(e, str) else e[1:] if e[0] in ("and", "or") else e[2:]:
            visit(x)

    for s, _, e in axioms:
        visit(s)
        visit(e)
    nodes = set(classes) | parts
    told = {(s, e) for s, _, e in axioms} | {(e, s) for s, k, e in axioms if k == "eq"} | {(e, m) for e in nodes if e[0] == "and" for m in e[1:]}
    above = {p: {p} for p in ("p", "q", "t")}
    for _ in range(3):
        for a, b in sub_props:
            above[a] |= above[b]
    sub, edge = {(x, x) for x in nodes} | {(x, V.THING) for x in nodes}, set()
    while True:
        size = len(sub) + len(edge)
        sub |= {(x, z) for x, y in sub for a, z in told if a == y}
        sub |= {(x, e) for x in nodes for e in nodes if e[0] == "and" and all((x, m) in sub for m in e[1:])}
        edge |= {(x, q, e[2]) for x, e in sub if e[0] == "some" for q in above[e[1]]}
        edge |= {(x, r2, z) for x, p, y in edge for p1, q1, r in rules if p1 == p for a, q, z in edge if a == y and q == q1 for r2 in above[r]}
        sub |= {(x, e) for x, p, y in edge for e in nodes if e[0] == "some" and e[1] == p and ((y, e[2]) in sub or e[2] == V.THING)}
        sub |= {(x, c) for x, p, _ in edge for d, c in domains if d == p}
        sub |= {(x, V.NOTHING) for x in nodes for a, b in apart if (x, a) in sub and (x, b) in sub}
        sub |= {(x, V.NOTHING) for x in nodes for g in groups if sum((x, m) in sub for m in g) > 1}
        sub |= {(x, V.NOTHING) for x, _, y in edge if (y, V.NOTHING) in sub}
        if len(sub) + len(edge) == size:
            return sub


@pytest.mark.parametrize("seed", [0])
def test_classification_against_plain_rules(spark, seed):
    rng = random.Random(seed)
    classes = [f"C{i}" for i in range(9)]
    expression = lambda depth: rng.choice(classes) if depth == 0 or rng.random() < 0.3 else ("some", rng.choice("pqt"), expression(depth - 1)) if rng.random() < 0.6 else ("and", *sorted({str(rng.choice(classes)), str(rng.choice(classes))}), ("some", rng.choice("pqt"), rng.choice(classes)))
    axioms = [(rng.choice(classes), rng.choice(["sub", "sub", "eq"]), expression(2)) for _ in range(14)]
    axioms = [(s, k, e) for s, k, e in axioms if s != e]
    domains, apart, sub_props = [("q", "C1")], [("C7", "C8")], [("p", "q")]
    b = Builder()
    for s, k, e in axioms:
        b.axiom(s, V.SUBCLASS if k == "sub" else V.EQUIVALENT, e)
    b.add("p", V.SUBPROPERTY, "q")
    b.add("t", V.TYPE, V.OWL + "TransitiveProperty")
    b.add("q", V.DOMAIN, "C1")
    b.add("C7", V.DISJOINT, "C8")
    ont = b.ontology(spark, classes, "pqt")
    sub = brute(classes, axioms, {("t", "t", "t")}, sub_props, domains, apart)
    got = {(r["child"], r["parent"]) for r in reason.classify(ont).collect()}
    assert got == {(x, y) for x, y in sub if x in classes and y in classes and x != y}
    assert {r["iri"] for r in reason.unsatisfiable(ont).collect()} == {x for x in classes if (x, V.NOTHING) in sub}


def test_definitions_and_transitive_properties_classify(spark):
    b = Builder()
    b.axiom("A", V.EQUIVALENT, ("and", "B", ("some", "p", "C")))
    b.axiom("D", V.SUBCLASS, "B")
    b.axiom("D", V.SUBCLASS, ("some", "p", "C"))
    b.add("t", V.TYPE, V.OWL + "TransitiveProperty")
    b.axiom("K", V.SUBCLASS, ("some", "t", "L"))
    b.axiom("L", V.SUBCLASS, ("some", "t", "M"))
    b.axiom("X", V.EQUIVALENT, ("some", "t", "M"))
    ont = b.ontology(spark, "ABCDKLMX", "pt")
    assert {(r["child"], r["parent"]) for r in reason.classify(ont).collect()} == {("A", "B"), ("D", "A"), ("D", "B"), ("L", "X"), ("K", "X")}


def test_expression_texts_hold_no_blank_names(spark):
    deep = ("and", "Z", ("some", "p", ("or", "B", ("all", "q", "C"))), "A")
    texts = []
    for tag, e in (("x", deep), ("y", ("and", "A", ("some", "p", ("or", ("all", "q", "C"), "B")), "Z"))):
        b = Builder(tag)
        b.axiom("N", V.EQUIVALENT, e)
        ont = b.ontology(spark, "N")
        texts.append({(r["ax_id"], r["object"]) for r in ont.axioms.where("ax_type = 'EquivalentClasses'").collect()})
    assert texts[0] == texts[1] and {o for _, o in texts[0]} == {"and(A Z some(p or(B all(q C))))"}


def test_expressions_that_hold_themselves_end(spark):
    b = Builder()
    b.add("_:r", V.ON_PROPERTY, "p")
    b.add("_:r", V.SOME, "_:r")
    b.add("A", V.SUBCLASS, "_:r")
    ont = b.ontology(spark, "A")
    assert ont.expressions.where("label IS NOT NULL").count() == 0 and reason.classify(ont).count() == 0


def brute_module(axioms, signature, bottom):
    """Axioms (kind, left, right) that are not local, and all that follow; names outside of the signature are empty or full."""
    sigma, found = set(signature), set()

    def names(e):
        return {e} if isinstance(e, str) else set().union(*(names(x) for x in e[1:]))

    def empty(e):
        if isinstance(e, str):
            return bottom and e not in sigma
        if e[0] == "some":
            return (bottom and e[1] not in sigma) or empty(e[2])
        return False if e[0] == "all" else any(map(empty, e[1:])) if e[0] == "and" else all(map(empty, e[1:]))

    def full(e):
        if isinstance(e, str):
            return not bottom and e not in sigma
        if e[0] == "some":
            return not bottom and e[1] not in sigma and full(e[2])
        if e[0] == "all":
            return (bottom and e[1] not in sigma) or full(e[2])
        return all(map(full, e[1:])) if e[0] == "and" else any(map(full, e[1:]))

    while True:
        size = len(found)
        for a in axioms:
            kind, x, y = a
            local = {
                "sub": lambda: empty(x) or full(y), "eq": lambda: (empty(x) and empty(y)) or (full(x) and full(y)), "dis": lambda: empty(x) or empty(y),
                "domain": lambda: full(y) or (bottom and x not in sigma), "subprop": lambda: (x if bottom else y) not in sigma,
            }[kind]()
            if a not in found and not local:
                found.add(a)
                sigma |= names(x) | names(y)
        if len(found) == size:
            return found


def test_modules_against_plain_locality(spark):
    predicates = {"sub": V.SUBCLASS, "eq": V.EQUIVALENT, "dis": V.DISJOINT, "domain": V.DOMAIN, "subprop": V.SUBPROPERTY}
    rng = random.Random(5)
    classes, properties = [f"C{i}" for i in range(12)], ["p", "q", "r"]
    cls = lambda: rng.choice(classes)
    expression = lambda: rng.choice([cls(), cls(), ("some", rng.choice(properties), cls()), ("all", rng.choice(properties), cls()), ("and", "C0", ("some", "p", cls())), ("or", "C1", ("all", "q", cls()))])
    axioms = [(rng.choice(["sub", "sub", "eq"]), cls(), expression()) for _ in range(16)] + [("dis", "C2", "C3"), ("domain", "p", "C4"), ("subprop", "q", "r")]
    axioms = [("sub", "C0", ("some", "p", "C5")), ("sub", "C5", "C6"), *axioms]
    axioms = list(dict.fromkeys(a for a in axioms if a[1] != a[2]))
    b = Builder()
    for kind, x, y in axioms:
        b.axiom(x, predicates[kind], y)
    ont = b.ontology(spark, classes, properties)

    def text(e):
        if isinstance(e, str):
            return e
        inside = sorted(map(text, e[1:])) if e[0] in ("and", "or") else [e[1], text(e[2])]
        return f"{e[0]}({' '.join(inside)})"

    for kind in ("BOT", "TOP", "STAR"):
        signature = ["C0", "q"]
        want = set(axioms)
        if kind == "STAR":
            size = -1
            while len(want) != size:
                size = len(want)
                want = brute_module(sorted(want, key=str), signature, True)
                want = brute_module(sorted(want, key=str), signature, False)
        else:
            want = brute_module(axioms, signature, kind == "BOT")
        got = {(r["property"], r["subject"], r["object"]) for r in graph.module(ont, spark.createDataFrame([(x,) for x in signature], "node string"), kind).collect() if r["ax_type"] != "Declaration"}
        assert got == {(predicates[k], x, text(y)) for k, x, y in want}, kind


def test_general_axioms_chains_groups_and_thing_against_plain_rules(spark):
    rng = random.Random(11)
    classes = [f"C{i}" for i in range(8)]
    cls = lambda: rng.choice(classes)
    some = lambda x=None: ("some", rng.choice("pqt"), x or rng.choice([cls(), V.THING]))
    axioms = [(cls(), rng.choice(["sub", "eq"]), rng.choice([cls(), some(), some(some()), ("and", cls(), some())])) for _ in range(8)]
    axioms += [(some(), "sub", cls()), (("and", cls(), some()), "sub", some()), (("some", "p", "C0"), "sub", ("some", "q", V.THING)), ("C2", "sub", ("some", "p", "C3")), ("C3", "sub", ("some", "q", "C4")), ("C5", "eq", ("some", "t", V.THING))]
    axioms = [(s, k, e) for s, k, e in dict.fromkeys(axioms) if s != e]
    b = Builder()
    for s, k, e in axioms:
        b.general(s, V.SUBCLASS if k == "sub" else V.EQUIVALENT, e)
    b.list_of("t", V.CHAIN, ["p", "q"])
    b.several(V.ALL_DISJOINT, V.MEMBERS, ["C5", "C6", "C7"])
    ont = b.ontology(spark, classes, "pqt")
    sub = brute(classes, axioms, {("p", "q", "t")}, [], [], [], [("C5", "C6", "C7")])
    got = {(r["child"], r["parent"]) for r in reason.classify(ont).collect()}
    want = {(x, y) for x, y in sub if x in classes and y in classes and x != y}
    assert got == want and len(want) > 5
    assert {r["iri"] for r in reason.unsatisfiable(ont).collect()} == {x for x in classes if (x, V.NOTHING) in sub}


def test_probes_of_reasoning(spark):
    b = Builder()
    b.general(("some", "p", "B"), V.SUBCLASS, "G")
    b.axiom("A", V.SUBCLASS, ("some", "p", "B"))
    b.axiom("Y", V.EQUIVALENT, ("some", "p", V.THING))
    b.list_of("r", V.CHAIN, ["p", "q", "p"])
    b.axiom("B", V.SUBCLASS, ("some", "q", "D"))
    b.axiom("D", V.SUBCLASS, ("some", "p", "E"))
    b.axiom("R", V.EQUIVALENT, ("some", "r", "E"))
    b.several(V.ALL_DISJOINT, V.MEMBERS, ["E", "F", ("some", "q", "D")])
    b.axiom("Z", V.SUBCLASS, ("and", "E", "F"))
    b.axiom("W", V.SUBCLASS, ("and", "E", "B"))
    b.add("u", V.DOMAIN, "E")
    b.add("u", V.DOMAIN, "F")
    b.add("i", V.TYPE, V.INDIVIDUAL)
    b.add("j", V.TYPE, V.INDIVIDUAL)
    b.add("j", V.TYPE, "B")
    b.add("i", "p", "j")
    b.axiom("H", V.EQUIVALENT, ("value", "p", "j"))
    ont = b.ontology(spark, "ABDEFGHRWYZ", "pqru")
    got = {(r["child"], r["parent"]) for r in reason.classify(ont).collect()}
    assert {("A", "G"), ("A", "Y"), ("A", "R"), ("D", "Y")} <= got and ("B", "R") not in got
    assert {r["iri"] for r in reason.unsatisfiable(ont).collect()} == {"Z", "W"}
    assert [r["iri"] for r in reason.unsatisfiable_properties(ont).collect()] == ["u"]
    assert {(r["individual"], r["cls"]) for r in reason.realized(ont).collect()} == {("j", "B"), ("i", "G"), ("i", "Y"), ("i", "R"), ("i", "H")}


def test_relaxing_and_reduction(spark):
    b = Builder()
    b.axiom("A", V.EQUIVALENT, ("and", "B", ("and", "C", ("some", "p", ("all", "q", "D")), ("not", "E"))))
    b.axiom("M", V.EQUIVALENT, ("min", "2", "p", "C"))
    b.axiom("N", V.EQUIVALENT, "M")
    b.general(("some", "q", "B"), V.EQUIVALENT, "O")
    b.axiom("S", V.SUBCLASS, ("and", "T", ("some", "p", "C")))
    ont = b.ontology(spark, "ABCDEMNOST", "pq")
    pairs = lambda df: {(r["subject"], r["object"]) for r in df.collect()}
    plain = {("A", "B"), ("A", "C"), ("A", "some(p all(q D))"), ("M", "some(p C)"), ("N", "M"), ("M", "N"), ("O", "some(q B)")}
    assert pairs(reason.relaxed(ont)) == plain
    assert pairs(reason.relaxed(ont, include_subclass=True, exclude_named=True, obo_only=True)) == {("A", "B"), ("A", "C"), ("M", "some(p C)"), ("O", "some(q B)"), ("S", "T"), ("S", "some(p C)")}
    b = Builder()
    b.axiom("B", V.SUBCLASS, "C")
    for e in (("some", "p", "B"), ("some", "p", "C"), ("some", "q", "C"), ("some", "p", V.THING)):
        b.axiom("X", V.SUBCLASS, e)
    b.axiom("Y", V.SUBCLASS, "X")
    b.axiom("Y", V.SUBCLASS, ("some", "q", "C"))
    b.axiom("Y", V.SUBCLASS, ("some", "q", "D"))
    b.add("p", V.SUBPROPERTY, "q")
    for x, y in (("K", "L"), ("L", "K")):
        b.axiom(x, V.EQUIVALENT, y)
        b.axiom(x, V.SUBCLASS, ("some", "p", "D"))
    ont = b.ontology(spark, "BCDKLXY", "pq")
    assert pairs(reason.reduced_expressions(ont)) == {("X", "some(p B)"), ("Y", "some(q D)"), ("K", "some(p D)")}


def test_generators_and_filters_of_inferred_axioms(spark):
    b = Builder()
    b.axiom("A", V.SUBCLASS, "B")
    b.axiom("B", V.SUBCLASS, "C")
    b.axiom("D", V.EQUIVALENT, ("and", "B", ("some", "p", V.THING)))
    b.axiom("E", V.SUBCLASS, "B")
    b.axiom("E", V.SUBCLASS, ("some", "p", "A"))
    b.axiom("A", V.SUBCLASS, "out")
    for s, p, o in (("p", V.SUBPROPERTY, "q"), ("q", V.SUBPROPERTY, "p"), ("q", V.DOMAIN, "C"), ("p", V.INVERSE, "r"), ("q", V.TYPE, V.OWL + "TransitiveProperty"), ("i", V.TYPE, V.INDIVIDUAL), ("j", V.TYPE, V.INDIVIDUAL), ("i", V.TYPE, "B"), ("i", "p", "j")):
        b.add(s, p, o)
    ont = b.ontology(spark, "ABCDE", "pqr")
    got = lambda *a, **k: {(r["ax_type"], r["subject"], r["object"]) for r in reason.inferred_axioms(ont, *a, **k).collect()}
    top = ("SubClassOf", "C", V.THING)
    assert got(["subclass"]) == {("SubClassOf", "A", "B"), ("SubClassOf", "B", "C"), ("SubClassOf", "D", "B"), ("SubClassOf", "E", "D"), ("SubClassOf", "A", "out"), top}
    assert got(["subclass"], exclude_duplicates=True) == {("SubClassOf", "D", "B"), ("SubClassOf", "E", "D")}
    assert top not in got(["subclass"], exclude_tautologies=True) and top not in got(["subclass"], exclude_thing=True)
    assert got(["classassertion"]) == {("ClassAssertion", "i", x) for x in "BCD"}
    rows = reason.inferred_axioms(ont, ["equivalentobjectproperty", "inverseobjectproperties", "objectpropertydomain", "objectpropertycharacteristic"], annotate=True).collect()
    assert {(r["ax_type"], r["subject"], r["object"]) for r in rows} == {("EquivalentProperties", "p", "q"), ("InverseProperties", "p", "r"), ("InverseProperties", "r", "p"), ("PropertyDomain", "p", "C"), ("PropertyDomain", "q", "C"), ("TransitiveProperty", "q", V.OWL + "TransitiveProperty")}
    assert {tuple(r["notes"]) for r in rows} == {(f"{V.IS_INFERRED}=true",)}
    with pytest.raises(ValueError):
        reason.inferred_axioms(ont, ["nonsense"])


def test_profiles_by_side(spark):
    b = Builder()
    b.axiom("A1", V.SUBCLASS, ("some", "p", ("and", "B", "C")))  # EL; not QL (filler), not RL (some on the right)
    b.axiom("A2", V.SUBCLASS, ("all", "p", ("not", "B")))  # RL only
    b.general(("or", "B", ("some", "p", "C")), V.SUBCLASS, "A3")  # RL only
    b.general(("some", "p", V.THING), V.SUBCLASS, ("not", ("some", "q", V.THING)))  # QL; not EL; RL, too
    b.axiom("A5", V.SUBCLASS, ("max", "1", "p", "B"))  # RL only
    b.axiom("A6", V.SUBCLASS, ("max", "2", "p", "B"))  # none
    b.axiom("A7", V.EQUIVALENT, ("one", "i", "j"))  # none
    b.axiom("A8", V.EQUIVALENT, ("value", "p", "i"))  # EL and RL
    b.several(V.ALL_DISJOINT, V.MEMBERS, ["A1", ("one", "i")])  # EL and RL
    b.list_of("q", V.CHAIN, ["p", "p"])  # not QL
    ont = b.ontology(spark, [f"A{i}" for i in range(1, 9)] + ["B", "C"], "pq")
    wrong = {p: {r["subject"] for r in reason.profile_violations(ont, p).collect()} for p in ("EL", "QL", "RL")}
    assert wrong["EL"] == {"A2", "or(B some(p C))", f"some(p {V.THING})", "A5", "A6", "A7"}
    assert wrong["QL"] == {"A1", "A2", "or(B some(p C))", "A5", "A6", "A7", "A8", "q"}  # of the disjoint ones A1 is the subject
    assert wrong["RL"] == {"A1", "A6", "A7"}


def test_classes_that_are_the_same_cost_no_pairs_of_them(spark):
    b, every = Builder(), [f"{k}{i}" for k in "NRI" for i in range(30)]
    for i in range(30):  # all the same, and so are the restrictions of them and the intersections of these
        b.add(f"N{i}", V.EQUIVALENT, f"N{(i * 7) % 30 if i else 1}")
        b.add(f"R{i}", V.EQUIVALENT, b.node(("some", "p", f"N{i}")))
        b.add(f"I{i}", V.EQUIVALENT, b.node(("and", f"N{i}", ("some", "p", f"N{i}"))))
        b.add(f"N{i}", V.EQUIVALENT, "N0")
    ont = b.ontology(spark, every, ["p"])
    sub, _ = reason._saturated(ont)
    assert sub.count() < 30
    got = {(r["child"], r["parent"]) for r in reason.classify(ont).collect()}
    assert got == {(x, y) for x in every for y in every if x != y and (x[0] == y[0] or x[0] == "I")}
    direct = {(r["child"], r["parent"]) for r in reason.inferred(ont).collect()}
    assert direct == got


def test_intersections_are_met_at_their_rarest_part(spark):
    b = Builder()
    for i in range(12):
        b.add(f"P{i}", V.SUBCLASS, "Common")
        b.add(f"D{i}", V.EQUIVALENT, b.node(("and", "Common", f"P{i}")))
    ont = b.ontology(spark, [f"{k}{i}" for k in "PD" for i in range(12)] + ["Common"])
    got = {(r["child"], r["parent"]) for r in reason.classify(ont).collect()}
    assert got == {(f"{k}{i}", "Common") for k in "PD" for i in range(12)} | {(f"{a}{i}", f"{c}{i}") for a, c in ("PD", "DP") for i in range(12)}


def test_rounds_of_reasoning_hold_numbers_only(spark, monkeypatch):
    b, types, write = Builder(), {}, reason.written
    b.add("A", V.SUBCLASS, "B")
    b.add("A", V.SUBCLASS, b.node(("some", "p", "C")))
    b.add("D", V.EQUIVALENT, b.node(("and", "B", ("some", "p", "C"))))
    b.add("A", V.DISJOINT, "B")
    monkeypatch.setattr(reason, "written", lambda df, what: types.setdefault(what, {t for _, t in df.dtypes}) and write(df, what))
    ont = b.ontology(spark, "ABCD", ["p"])
    assert {r["iri"] for r in reason.unsatisfiable(ont).collect()} == {"A"}  # Nothing comes up in a round only
    assert {(r["child"], r["parent"]) for r in reason.classify(ont).collect()} == {("A", "B"), ("A", "D"), ("D", "B")}
    assert set(types) == {"sub", "edge", "held"} and set().union(*types.values()) <= {"bigint", "int"}


def test_texts_of_the_same_number_get_others(spark, monkeypatch):
    rows, hashed, seeds = spark.createDataFrame([("A", "B"), ("B", "C")], "y string, z string"), F.xxhash64, []

    def alike(text, seed):  # the first seed gives all texts one number
        seeds.append(seed)
        return F.lit(1).cast("bigint") if len(seeds) == 1 else hashed(text, seed)

    monkeypatch.setattr(reason.F, "xxhash64", alike)
    tables, ids, _ = reason._numbered({"told": rows})
    names = {r["id"]: r["text"] for r in ids.collect()}
    assert set(names.values()) == {"A", "B", "C", V.THING, V.NOTHING}
    assert {(names[r["y"]], names[r["z"]]) for r in tables["told"].collect()} == {("A", "B"), ("B", "C")}


def test_pairs_of_a_large_kind_are_made_by_many_tasks(spark):
    kinds = spark.range(1200).select(F.concat(F.lit("K"), "id").alias("iri"), F.lit("K0").alias("rep")).unionByName(spark.createDataFrame([("L", "L")], "iri string, rep string"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pairs = reason._for_all(spark.createDataFrame([("K0", "L")], "child string, parent string"), kinds)
        tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == pairs.distinct().count() == 1200 * 1199 + 1200
        assert max(tasks) < sum(tasks) * 0.7
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_direct_links_take_the_closure_as_it_is(spark, monkeypatch):
    b = Builder()
    for s, o in ("AB", "BC", "AC", "CD", "DC", "AE"):
        b.add(s, V.SUBCLASS, o)
    ont = b.ontology(spark, "ABCDE")
    pairs, kinds = reason._named(ont)
    want = {(r["child"], r["parent"]) for r in reason._for_all(graph.reduction(pairs), kinds).collect()}
    monkeypatch.setattr(graph, "closure", lambda edges: pytest.fail("the classified pairs are closed"))
    assert {(r["child"], r["parent"]) for r in reason._direct(ont).collect()} == want
